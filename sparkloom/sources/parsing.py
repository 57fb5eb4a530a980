"""Files to typed blocks by one table function: the suffix picks the parser, warnings come beside the blocks."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

# Byte-order marks and encodings that are tried, suffixes of each parser, block elements.
MARKS = {b"\xef\xbb\xbf": "utf-8", b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}
ENCODINGS = ("utf-8", "gb18030", "utf-16")
PARSERS = {"": "text", ".txt": "text", ".md": "text", ".rst": "text", ".csv": "table", ".tsv": "table", ".html": "html", ".htm": "html", ".json": "layout"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "title"}
BREAKS = HEADINGS | {"p", "div", "li", "td", "th", "article", "section", "footer", "header", "nav", "ul", "ol", "table", "tr", "blockquote", "pre", "br", "body", "html"}
SCANNED = "SCANNED_PDF_SUSPECTED"


def read_text(data: bytes) -> tuple[str, str]:
    """Text and encoding: by its mark, else the first that fits, else UTF-8 with replacement signs."""
    marked = next(((mark, name) for mark, name in MARKS.items() if data.startswith(mark)), None)
    if marked:
        return data[len(marked[0]) :].decode(marked[1], errors="replace"), marked[1]
    fits = (name for name in ENCODINGS if _fits(data, name))
    name = next(fits, None)
    return (data.decode(name), name) if name else (data.decode("utf-8", errors="replace"), "utf-8?")


def _fits(data: bytes, name: str) -> bool:
    try:
        data.decode(name)
    except UnicodeError:
        return False
    return True


def text_blocks(text: str) -> Iterator[tuple]:
    """(kind, text, page, locator) of parts between blank lines; empty parts count in the numbering."""
    lines, number, held = text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), 1, []
    for line in [*lines, ""]:
        if line.strip():
            held.append(line)
            continue
        body = "\n".join(held).strip()
        if body:
            first = body.split(None, 1)[0]
            kind = "heading" if first.strip("#") == "" and len(first) <= 6 and body != first else "table" if "|" in body and "\n" in body else "paragraph"
            yield kind, body, None, f"block:{number}"
            number += 1
        held = []


def table_blocks(text: str, delimiter: str) -> Iterator[tuple]:
    rows = csv.reader(io.StringIO(text), delimiter=delimiter)
    head = next(rows, [])
    for i, cells in enumerate(rows, 2):
        names = [*head, *(f"column_{k + 1}" for k in range(len(head), len(cells)))]
        yield "table_row", " | ".join(f"{n}={c}" for n, c in zip(names, cells, strict=False)), None, f"row:{i}"


class _Html(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.held, self.kind, self.hidden = [], [], "paragraph", 0

    def close_block(self, kind: str = "paragraph") -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.out.append((self.kind, text, None, f"element:{len(self.out) + 1}"))
        self.held, self.kind = [], kind

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in BREAKS:
            self.close_block("heading" if tag in HEADINGS else "list_item" if tag == "li" else "table" if tag in ("td", "th") else "paragraph")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in BREAKS:
            self.close_block()

    def handle_data(self, data):
        if not self.hidden:
            self.held.append(data)


def html_blocks(text: str) -> list[tuple]:
    parser = _Html()
    parser.feed(text)
    parser.close()
    parser.close_block()
    return parser.out


def layout_blocks(text: str) -> tuple[list[tuple], int, int]:
    """Blocks, pages and empty pages of {"pages": [{"text"} or {"blocks": [{"kind", "text"}]}]}: what a reader
    of paged files hands on."""
    out, empty, pages = [], 0, json.loads(text).get("pages") or []
    for number, page in enumerate(pages, 1):
        found = [(b.get("kind") or "paragraph", (b.get("text") or "").strip()) for b in page["blocks"]] if "blocks" in page else [(kind, body) for kind, body, *_ in text_blocks(page.get("text") or "")]
        found = [(kind, body) for kind, body in found if body]
        empty += not found
        out += [(kind, body, number, f"page:{number}:block:{i}") for i, (kind, body) in enumerate(found, 1)]
    return out, len(pages), empty


@udtf
class ParseFile:
    """ParseFile(content, path[, with_source]) gives a row a block, and one without text for a file that has
    warnings or no block. With the constant `true` as third argument rows also carry the encoding."""

    @staticmethod
    def analyze(content: AnalyzeArgument, path: AnalyzeArgument, with_source: AnalyzeArgument | None = None) -> AnalyzeResult:
        if content.dataType.typeName() != "binary" or path.dataType.typeName() != "string":
            raise ValueError("ParseFile takes binary content and a path")
        schema = StructType()
        for name, kind in (("parser", StringType()), ("block_no", LongType()), ("kind", StringType()), ("text", StringType()), ("page", IntegerType()), ("locator", StringType()), ("page_count", IntegerType()), ("empty_pages", IntegerType()), ("warning", StringType())):
            schema = schema.add(name, kind)
        if with_source is not None and with_source.isConstantExpression and with_source.value:
            schema = schema.add("encoding", StringType())
        return AnalyzeResult(schema)

    def eval(self, content, path, with_source=None):
        more = lambda encoding: (encoding,) if with_source else ()
        name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
        dot = name.rfind(".")
        suffix = name[dot:].lower() if dot > 0 else ""
        parser = PARSERS.get(suffix)
        if parser is None or content is None:
            yield (parser, 0, None, None, None, None, 0, 0, f"unsupported:{suffix}" if parser is None else "no_content", *more(None))
            return
        text, encoding = read_text(bytes(content))
        pages = empty = 0
        warning = "undecodable" if encoding.endswith("?") else None
        if parser == "layout":
            try:
                blocks, pages, empty = layout_blocks(text)
            except (ValueError, AttributeError, TypeError, KeyError):
                blocks, warning = [], "invalid_layout"
        else:
            blocks = list(text_blocks(text) if parser == "text" else table_blocks(text, "\t" if suffix == ".tsv" else ",") if parser == "table" else html_blocks(text))
        if pages and 2 * empty >= pages:
            warning = SCANNED
        if warning or not blocks:
            yield (parser, 0, None, None, None, None, pages, empty, warning, *more(encoding))
        for i, (kind, body, page, locator) in enumerate(blocks, 1):
            yield (parser, i, kind, body, page, locator, pages, empty, None, *more(encoding))


def parsed(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """files(path, content, ...) with the columns of ParseFile, a row a block; other columns stay."""
    return files.lateralJoin(ParseFile(F.col(content).outer(), F.col(path).outer())).drop(content)


def parsed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of all files of a folder."""
    return parsed(spark.read.format("binaryFile").load(folder).select("path", "content"))
