"""Metrics as lines of the text exposition format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _labels(columns: list[str], more: Column | None = None) -> Column:
    def escaped(c):
        value = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for sign, to in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            value = F.replace(value, F.lit(sign), F.lit(to))
        return F.concat(F.lit(f'{c}="'), value, F.lit('"'))

    parts = [escaped(c) for c in columns] + ([more] if more is not None else [])
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _head(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(f"# TYPE {name} {kind}").alias("line"), F.lit(name).alias("name"), F.lit(-1).alias("place"))


def counter_lines(samples: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """(line, name, place) of samples(labels, value): sorted by name, place, line they make a page."""
    line = F.concat(F.lit(name), _labels(labels), F.lit(" "), F.col("value").cast("string"))
    return _head(samples, name, "counter").unionByName(samples.select(line.alias("line"), F.lit(name).alias("name"), F.lit(0).alias("place")))


def histogram_lines(rows: DataFrame, name: str, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets and the count of a column's values by label; the last bucket holds nulls, too."""
    counts = rows.groupBy(*labels).agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("n"))
    marks = [(f"b{i}", f"{b:g}", i + 1) for i, b in enumerate(bounds)] + [("n", "+Inf", len(bounds) + 1)]
    each = F.array(*[F.struct(F.concat(F.lit(f"{name}_bucket"), _labels(labels, F.lit(f'le="{le}"')), F.lit(" "), F.col(c).cast("string")).alias("line"), F.lit(at).alias("place")) for c, le, at in marks],
                   F.struct(F.concat(F.lit(f"{name}_count"), _labels(labels), F.lit(" "), F.col("n").cast("string")).alias("line"), F.lit(len(marks) + 1).alias("place")))
    lines = counts.select(F.inline(each)).select("line", F.lit(name).alias("name"), "place")
    return _head(rows, name, "histogram").unionByName(lines)
