"""Structured Streaming forms: windowed counts, job states, compaction of conversations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.graph import scratch


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A Parquet file or folder as a stream of its files."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # a single file is found as the one name in its folder that matches
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()


def windowed_counts(events: DataFrame, size: str, slide: str | None, late: str = "10 minutes") -> DataFrame:
    """(w, event_type, n) of events(ts, event_type); events later than the watermark are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))


def latest_status(transitions: DataFrame) -> DataFrame:
    """(job_id, status, seq) of transitions(job_id, status, ts, event_id): the newest by time and id."""
    seq = F.struct("ts", "event_id")
    return transitions.groupBy("job_id").agg(F.max_by("status", seq).alias("status"), F.max(seq).alias("seq"))


def compacted(messages: DataFrame, keep: int, longest: int) -> DataFrame:
    """(conv_id, seen, n_kept, summary): per conversation the newest `keep` messages stay, older ones go
    to a summary of at most `longest` characters. State is bounded by these two numbers."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, turns, lines, summary = state.get if state.exists else (0, [], [], "")
        rows = sorted(zip(turns, lines, strict=True))
        for pdf in batches:
            seen += len(pdf)
            rows += [(int(t), f"{r}: {' '.join((x or '').split())}") for t, r, x in zip(pdf["turn"], pdf["role"], pdf["text"], strict=True)]
        rows.sort()
        for _, line in rows[:-keep]:
            summary = f"{summary}\n{line}" if summary else line
        rows, summary = rows[-keep:], summary[-longest:]
        state.update((seen, [t for t, _ in rows], [x for _, x in rows], summary))
        yield pd.DataFrame([(key[0], seen, len(rows), summary)], columns=["conv_id", "seen", "n_kept", "summary"])

    return messages.groupBy("conv_id").applyInPandasWithState(
        run, "conv_id long, seen long, n_kept long, summary string", "seen long, turns array<long>, lines array<string>, summary string", "update", "NoTimeout"
    )


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what its source holds now; its batches' rows, written to the shared folder, each batch
    in a folder of its own that a repeated run of it replaces. Of a stream in complete mode the last batch is
    the result."""
    root = scratch(stream.sparkSession)

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/out/_batch={batch}" if mode != "complete" else f"{root}/out")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")
