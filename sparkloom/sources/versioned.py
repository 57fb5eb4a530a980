"""Tables on plain files that change as a whole: a reader sees the state before a commit or after it.

A store keeps named tables, their rows dealt to a fixed number of buckets by the hash of a key (say a
source). A commit writes the buckets that it touches to a new folder, then a manifest that says for every
table and bucket which folder holds it, and then gives the manifest its number by a rename that fails if
that number is taken. The highest number is the state; until the rename, nothing that was written counts.
A stream's batch number goes into the same manifest, so a batch that is run again after a failure finds
either nothing of itself or all of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit came first; read the new state and try again."""


@dataclass(frozen=True)
class State:
    """One manifest: its number, the schema of each table, the folder of each table's buckets, the last
    batch of each stream."""

    number: int = 0
    schemas: dict[str, str] = field(default_factory=dict)
    folders: dict[str, dict[str, str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # files -----------------------------------------------------------------------------------------
    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._hadoop(f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        return sorted(int(n[:-5]) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.endswith(".json") and n[:-5].isdigit())

    def state(self, number: int | None = None) -> State:
        """The newest state, or that of a number; an empty one where nothing was committed."""
        numbers = self._numbers()
        if not numbers:
            return State()
        body = "".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{number or numbers[-1]}.json", wholetext=True).collect())
        return State(**json.loads(body))

    def _publish(self, state: State) -> None:
        fs, tmp = self._hadoop(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        _, final = self._hadoop(f"{self.path}/manifests/{state.number}.json")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(tmp, final):
            fs.delete(tmp, False)
            raise Conflict(f"{self.path}: state {state.number} is there already")

    # rows ------------------------------------------------------------------------------------------
    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, table: str, state: State | None = None, only: set[int] | None = None) -> DataFrame:
        """Rows of a table in a state (the newest by default); tables of one state belong together."""
        state = state or self.state()
        schema = StructType.fromJson(json.loads(state.schemas[table]))
        folders = [f for b, f in state.folders.get(table, {}).items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def replace(
        self,
        keys: DataFrame,
        rows: dict[str, DataFrame],
        merge: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None,
        stream: str | None = None,
        batch: int | None = None,
        before_publish: Callable[[], None] | None = None,
    ) -> State:
        """Commit: of each table given in `rows`, what it had for `keys` goes and the new rows, which must
        have a key among them, come. `merge[table](old, new)` gives the rows of the touched buckets instead.
        With `stream` and `batch`, a batch that was committed before changes nothing."""
        base = self.state()
        if stream is not None and batch is not None and base.batches.get(stream, -1) >= batch:
            return base
        keys = keys.select(self.key).distinct()
        touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # `buckets` numbers at most
        schemas, folders = dict(base.schemas), {t: dict(f) for t, f in base.folders.items()}
        stage = f"data/{uuid.uuid4().hex}"
        for table, new in rows.items():
            old = self.read(table, base, touched) if table in base.schemas else new.limit(0)
            if merge and table in merge:
                after = merge[table](old, new)
            else:
                after = old.join(keys, self.key, "left_anti").unionByName(new)
            after.withColumn("_bucket", self._bucket()).write.partitionBy("_bucket").parquet(f"{self.path}/{stage}/{table}")
            schemas.setdefault(table, new.schema.json())
            fs, root = self._hadoop(f"{self.path}/{stage}/{table}")
            written = {int(n.split("=")[1]) for n in (s.getPath().getName() for s in fs.listStatus(root)) if n.startswith("_bucket=")}
            held = {b: f for b, f in folders.get(table, {}).items() if int(b) not in touched}
            folders[table] = held | {str(b): f"{stage}/{table}/_bucket={b}" for b in sorted(written)}
        batches = dict(base.batches) | ({stream: batch} if stream is not None else {})
        if before_publish:
            before_publish()
        after = State(base.number + 1, schemas, folders, batches)
        self._publish(after)
        return after

    def sweep(self, keep: int = 2) -> list[str]:
        """Delete manifests but the newest `keep`, and folders that none of these names; what a failed or
        running commit has staged goes too, so no commit may run meanwhile. The names that went."""
        numbers, gone = self._numbers(), []
        states = [self.state(n) for n in numbers[-keep:]]
        used = {f.split("/")[1] for s in states for t in s.folders.values() for f in t.values()}
        fs, data = self._hadoop(f"{self.path}/data")
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)
                gone.append(f"data/{s.getPath().getName()}")
        for n in numbers[:-keep]:
            fs.delete(self._hadoop(f"{self.path}/manifests/{n}.json")[1], False)
            gone.append(f"manifests/{n}.json")
        return sorted(gone)


def longest(keys: list[str], text: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps one row per keys: that of the longest `text`, of equals the smallest; nulls last."""

    def run(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new)
        rest = [c for c in both.columns if c not in keys]
        best = F.min_by(F.struct(*rest), F.struct(-F.coalesce(F.length(text), F.lit(-1)), F.coalesce(text, F.lit("")), F.to_json(F.struct(*rest))))
        return both.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*").select(*both.columns)

    return run


def committing(store: Store, table: str, stream: str, before_publish: Callable[[int], None] | None = None):
    """For foreachBatch: each batch's rows replace those of their keys, once whatever is run again."""

    def run(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            hook = (lambda: before_publish(batch)) if before_publish else None
            store.replace(df.select(store.key), {table: df}, stream=stream, batch=batch, before_publish=hook)
        finally:
            df.unpersist()

    return run
