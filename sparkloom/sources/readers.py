"""Sources: text of unknown encoding, delimited files as row blocks, strict JSON lines, HTML, admission."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.sources.parsing import read_text

# Suffixes a text reader takes, a layout parser takes, and nobody takes.
TEXT, LAYOUT, REFUSED = {".txt", ".md", ".csv", ".tsv", ".json", ".log"}, {".pdf", ".docx", ".pptx", ".xlsx", ".html"}, {".doc", ".docm"}


def decode(content: bytes | None) -> str | None:
    """Text of bytes whose encoding is not known; null stays null."""
    return None if content is None else read_text(bytes(content))[0]


def decoded():
    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(decode)

    return run


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, decoded by the cascade."""
    return spark.read.format("binaryFile").load(path).select("path", decoded()("content").alias("text"))


def admission(files: DataFrame, path_col: str = "path") -> DataFrame:
    """files with suffix and route: text, layout, or the reason for refusal."""
    suffix = F.lower(F.regexp_extract(path_col, r"(\.[^./\\]+)$", 1))
    route = F.when(suffix.isin(*sorted(REFUSED)), "refused:legacy_format").when(suffix.isin(*sorted(TEXT)), "text").when(suffix.isin(*sorted(LAYOUT)), "layout").otherwise("refused:unsupported")
    return files.withColumns({"suffix": suffix, "route": route})


def read_delimited_blocks(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """One block a data row: 'h1=v1 | h2=v2', with locator row:i counted from 2 in file order.

    Cells beyond the header are named column_k."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def blocks(batches):
        import csv
        import io

        for pdf in batches:
            out = []
            for p, text in zip(pdf["path"], pdf["value"], strict=True):
                lines = list(csv.reader(io.StringIO(text), delimiter=sep))
                head = lines[0] if lines else []
                for i, cells in enumerate(lines[1:], 2):
                    names = [head[k] if k < len(head) else f"column_{k + 1}" for k in range(len(cells))]
                    out.append((p, f"row:{i}", " | ".join(f"{n}={c}" for n, c in zip(names, cells, strict=True))))
            yield pd.DataFrame(out, columns=["path", "locator", "block"])

    return rows.mapInPandas(blocks, "path string, locator string, block string")


def read_jsonl_strict(spark: SparkSession, path: str, schema: StructType, id_col: str) -> DataFrame:
    """Rows of JSON lines of exactly this schema. Unknown fields, bad lines and repeated ids are errors;
    blank lines are skipped."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    keys = raw.select(F.explode(F.json_object_keys("value")).alias("k")).distinct()
    unknown = [r["k"] for r in keys.where(~F.col("k").isin(schema.fieldNames())).limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    rows = raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    twice = rows.groupBy(id_col).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated {id_col}: {twice[0][0]}")
    return rows


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, pos, kind, text): text of block elements in page order; scripts and styles left out."""

    def run(batches):
        from html.parser import HTMLParser

        blocks = {"p", "div", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "footer", "header", "nav", "ul", "ol", "table", "tr", "blockquote", "pre", "br", "title", "body", "html"}

        class Blocks(HTMLParser):
            def __init__(self):
                super().__init__()
                self.out, self.held, self.kind, self.skip = [], [], "paragraph", 0

            def flush(self):
                text = " ".join("".join(self.held).split())
                if text:
                    self.out.append((self.kind, text))
                self.held = []

            def handle_starttag(self, tag, attrs):
                if tag in ("script", "style"):
                    self.skip += 1
                if tag in blocks:
                    self.flush()
                    self.kind = "heading" if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "title") else "list_item" if tag == "li" else "table" if tag in ("td", "th") else "paragraph"

            def handle_endtag(self, tag):
                if tag in ("script", "style") and self.skip:
                    self.skip -= 1
                if tag in blocks:
                    self.flush()
                    self.kind = "paragraph"

            def handle_data(self, data):
                if not self.skip:
                    self.held.append(data)

        for pdf in batches:
            rows = []
            for key, page in zip(pdf[id_col], pdf[html_col], strict=True):
                parser = Blocks()
                parser.feed(page or "")
                parser.close()
                parser.flush()
                rows += [(key, i, kind, text) for i, (kind, text) in enumerate(parser.out)]
            yield pd.DataFrame(rows, columns=[id_col, "pos", "kind", "text"])

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {dict(pages.dtypes)[id_col]}, pos long, kind string, text string")
