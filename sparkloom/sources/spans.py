"""A sink for spans: JSON lines in files of bounded size, of which a bounded number is kept.

    spark.dataSource.register(SpanSink)
    df.write.format("spans").option("path", ...).option("maxBytes", ...).option("keep", ...).mode("append").save()

Tasks write parts under hidden names; the commit gives them their numbers, oldest first, and deletes what is
beyond `keep`. A task that is tried again leaves a part without a number, which the next commit removes;
readers take span-*.jsonl. It serves batches and, as writeStream.format("spans"), streams, where a batch that
is committed again is known by its number.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

PREFIX, HIDDEN, LAST = "span-", ".part-", ".last"


@dataclass
class Parts(WriterCommitMessage):
    names: list[str]
    rows: int


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Writer:
    def __init__(self, options: dict, fields: list[str]):
        self.path, self.fields = options["path"].rstrip("/"), fields
        self.most, self.keep = int(options.get("maxbytes", 20 << 20)), int(options.get("keep", 5))

    def write(self, rows) -> Parts:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size, count = [], None, 0, 0
        for row in rows:
            line = (json.dumps(dict(zip(self.fields, row, strict=True)), ensure_ascii=False, sort_keys=True, default=str) + "\n").encode()
            if out is None or size + len(line) > self.most:
                if out is not None:
                    out.close()
                names.append(f"{HIDDEN}{uuid.uuid4().hex}")
                out, size = fs.open_output_stream(f"{root}/{names[-1]}"), 0
            out.write(line)
            size, count = size + len(line), count + 1
        if out is not None:
            out.close()
        return Parts(names, count)

    def _files(self, fs, root) -> list[str]:
        from pyarrow.fs import FileSelector

        return sorted(f.base_name for f in fs.get_file_info(FileSelector(root, allow_not_found=True)))

    def publish(self, messages) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        have = [n for n in self._files(fs, root) if n.startswith(PREFIX)]
        number = int(have[-1][len(PREFIX) : -len(".jsonl")]) + 1 if have else 1
        for name in (n for m in messages if m is not None for n in m.names):
            fs.move(f"{root}/{name}", f"{root}/{PREFIX}{number:012d}.jsonl")
            number += 1
        for name in [n for n in self._files(fs, root) if n.startswith(PREFIX)][: -self.keep]:
            fs.delete_file(f"{root}/{name}")
        for name in self._files(fs, root):
            if name.startswith(HIDDEN):
                fs.delete_file(f"{root}/{name}")

    def discard(self, messages) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for name in m.names if m is not None else []:
                fs.delete_file(f"{root}/{name}")


class _Batch(_Writer, DataSourceWriter):
    def commit(self, messages) -> None:
        self.publish(messages)

    def abort(self, messages) -> None:
        self.discard(messages)


class _Stream(_Writer, DataSourceStreamWriter):
    def commit(self, messages, batchId) -> None:
        fs, root = _fs(self.path)
        if LAST in self._files(fs, root):
            with fs.open_input_stream(f"{root}/{LAST}") as f:
                if int(f.read()) >= batchId:
                    return self.discard(messages)
        self.publish(messages)
        with fs.open_output_stream(f"{root}/{LAST}") as f:
            f.write(str(batchId).encode())
        return None

    def abort(self, messages, batchId) -> None:
        self.discard(messages)


class SpanSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spans"

    def _options(self) -> dict:
        options = {k.lower(): v for k, v in self.options.items()}
        if "path" not in options:
            raise ValueError("spans: a path is needed")
        return options

    def writer(self, schema, overwrite) -> DataSourceWriter:
        if overwrite:
            raise ValueError("spans: rows are only appended")
        return _Batch(self._options(), schema.fieldNames())

    def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:
        return _Stream(self._options(), schema.fieldNames())
