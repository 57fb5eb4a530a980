"""Column expressions shared by the operators that stay inside the JVM: words, k-gram hashes, and
membership tests in a constant bitmap of fixed size."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lowering A-Z; of null, none."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(low, _SEPARATORS), ""), F.array().cast("array<string>"))


def runs(values: Column, k: int) -> Column:
    """xxhash64 of every k consecutive values of an array column; none if it holds fewer.

    `values` must be a column that a projection below has computed: an expression would be evaluated
    anew for every place."""
    n = F.size(values)
    return F.when(
        n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.slice(values, i + 1, F.lit(k))))
    ).otherwise(F.array().cast("array<bigint>"))


def bitmap_literal(values: DataFrame, column: str, log2_bits: int) -> Column:
    """Constant array of 2**log2_bits / 64 bigints, whose set bits are the low bits of the column's
    values. The driver receives no more than that array, whatever the number of values."""
    slot = F.col(column).bitwiseAND(F.lit((1 << log2_bits) - 1))
    rows = (
        values.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .collect()
    )
    bits = [0] * (1 << (log2_bits - 6))
    for r in rows:
        bits[r["word"]] = r["bits"]
    return F.lit(np.array(bits, dtype=np.int64))


def in_bitmap(bits: Column, value: Column, log2_bits: int) -> Column:
    slot = value.bitwiseAND(F.lit((1 << log2_bits) - 1))
    word = F.element_at(bits, (F.shiftright(slot, 6) + 1).cast("int"))
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))) != 0


def log2_size(entries: int) -> int:
    """Bits for about 1 % false passes, between 2**12 and 2**20."""
    return max(12, min(20, (entries * 100).bit_length()))
