"""Features of sales as of a moment: what was known then of a client's last days, and what came after.

Whatever is counted at t is active in an interval: a click from when it had happened and arrived (plus a
lag) until d days after it happened; a sale likewise; a line while its sale is, once shipped; an item
while any of its lines is. An interval becomes a plus at its begin and a minus at its end, moments to ask
about become rows without either, and running sums over (client, time) answer all at once: no join on
ranges, no row per pair. The last click needs no minus, since clicks end in the order in which they
happened: the latest that has begun is active or none is. A label is an interval too: a sale marks the
moments of the seven days before it.

Distinct items: of the lines of a client's item, each covers what no line begun before it covers, from the
latest end so far on. Such parts don't overlap, so their pluses and minuses count items. All lines of an
item end d days after their sale, so the latest sale so far gives the latest end for each d.

Hot clients are those with more than HOT rows, and at least a 2**16th of all rows, so there never are more
than 2**16 and their list may be part of the plan. Their time is cut into chunks of ten minutes: running values
within a chunk, and those of the chunks before as one row a chunk. Hot (client, item) pairs likewise.
Everything else is one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.store import cut

DAY, MINUTE = 86_400_000_000, 60_000_000
HOT, CHUNK = 20_000, 10 * MINUTE
WINDOWS = (2, 14)
COUNTS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents", "n_items")
_LAST = "struct<ts: bigint, click_id: bigint>"


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds of a timestamp since 1970; one without a zone is UTC, whatever the session's zone."""
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return F.unix_micros(column)
    since = f"cast(`{column}` as timestamp_ntz) - TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    return F.expr(f"cast(cast(cast({since} as interval second) as decimal(20, 6)) * 1000000 as bigint)")


def cents(amount: Column) -> Column:
    """floor(100 x + 0.5); 0 for null, and for what is no number or beyond 9e15."""
    x = F.floor(F.lit(100.0) * amount + F.lit(0.5))
    return F.when(F.abs(F.lit(100.0) * amount) < F.lit(9e15), x).otherwise(F.lit(0)).cast("long")


def _hot(counts: DataFrame, keys: list[str], rows: int) -> Column:
    """Whether a row's keys have more than HOT rows of their own and at least a 2**16th of all: a list of
    2**16 keys at most, which goes into the plan and, where it is a filter, to the scan."""
    found = counts.where(F.col("n") > max(HOT, rows >> 16)).select(*[F.col(k).cast("long") for k in keys]).collect()
    if not found:
        return F.lit(False)
    if len(keys) == 1:
        return F.coalesce(F.col(keys[0]).isin([r[0] for r in found]), F.lit(False))
    listed = ", ".join(f"({', '.join(f'{x}L' for x in r)})" for r in found)
    return F.expr(f"coalesce(({', '.join(f'cast({k} as bigint)' for k in keys)}) IN ({listed}), false)")


def _chunk(hot: Column, time: str) -> Column:
    return F.when(hot, F.floor(F.col(time) / CHUNK)).otherwise(F.lit(-1)).cast("long")


def _deltas(df: DataFrame, time: Column, mask: Column, sign: int = 1, last: Column | None = None, label: int = 0, **values: Column) -> DataFrame:
    """Rows of one kind: at `time`, for the windows whose bits are in `mask`, add (or take away) `values`."""
    amounts = [(values[c] * sign if c in values else F.lit(0)).cast("long").alias(c) for c in COUNTS]
    none = F.lit(None).cast(_LAST)
    fixed = [F.lit(0).alias("probe"), F.lit(label).cast("long").alias("label"), F.lit(None).cast("long").alias("sale_id"), (none if last is None else last).cast(_LAST).alias("last")]
    return df.select("client_id", time.cast("long").alias("time"), mask.cast("int").alias("mask"), *fixed, *amounts)


def _alive(begin: str, at: str, days: tuple[int, int]) -> Column:
    """The windows in which something that happened at `at` and begins to count at `begin` ever counts."""
    return sum((F.when(F.col(begin) < F.col(at) + d * DAY, F.lit(1 << i)).otherwise(F.lit(0)) for i, d in enumerate(days)), F.lit(0))


def _sums(days: tuple[int, int]) -> list[tuple[str, Column]]:
    """Name and amount of every running sum."""
    each = [(f"{c}_{i}", F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col(c)).otherwise(F.lit(0))) for c in COUNTS for i in range(len(days))]
    return [*each, ("label", F.col("label"))]


def _covering(lines: DataFrame, rows: int) -> DataFrame:
    """lines with `covered`: the latest sale of the item's lines of that client that began before."""
    pairs = lines.where("item_id IS NOT NULL").groupBy("client_id", "item_id").agg(F.count("*").alias("n"))
    hot = _hot(pairs, ["client_id", "item_id"], rows)
    # lines without an item need no order: by time, so that no client's are one group
    chunk = F.when(F.col("item_id").isNull(), F.floor(F.col("begin") / CHUNK)).otherwise(_chunk(hot, "begin"))
    named = lines.withColumn("chunk", chunk)
    within = Window.partitionBy("client_id", "item_id", "chunk").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    inside = named.withColumn("inside", F.max("sold").over(within))
    each = lines.where(hot).withColumn("chunk", _chunk(hot, "begin")).groupBy("client_id", "item_id", "chunk").agg(F.max("sold").alias("own"))
    past = Window.partitionBy("client_id", "item_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("client_id", "item_id", "chunk", F.max("own").over(past).alias("before"))
    joined = inside.join(before, ["client_id", "item_id", "chunk"], "left")
    return joined.withColumn("covered", F.greatest("inside", "before")).drop("inside", "before", "chunk")


def features(clicks: DataFrame, sales: DataFrame, lines: DataFrame, probes: DataFrame, days: tuple[int, int] = WINDOWS, lag_minutes: int = 240, ahead_days: int = 7) -> DataFrame:
    """For each row of probes(sale_id, client_id, time: microseconds) and each of two window lengths d: what
    was known of the client at that time from the d days before, and whether a sale follows within
    ahead_days. Columns as in the contract of op13: sale_id, d, t_us, label, n_clicks, n_purchases,
    click_cents, last_click_id, n_sales, sale_cents, n_lines, n_items, line_cents.

    clicks(click_id, ts, arrived_at, client_id, kind, value, ...): fully equal rows count once.
    sales(sale_id, client_id, total, sold_at, arrived_at, ...), lines(sale_id, item_id, amount, shipped_at,
    ...): repeated rows count again, and so do a sale's lines for each row of the sale. What lacks a client, a
    time or an arrival is never counted (but a sale that never arrived still marks labels); a line without
    item counts as a line, not as an item; null, infinite and other unusable amounts are 0 cents. A probe
    without time has no label and counts nothing; one without client is left out. A latest click without id gives a null id. Ties: all that begins or
    ends at the probe's very time has begun or ended. Other columns make no difference, but for the
    equality of clicks. Empty tables count as nothing; without probes there is no row."""
    small, large = days
    lag = lag_minutes * MINUTE
    seen = clicks.where("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL").distinct()
    seen = seen.select("client_id", "click_id", "kind", "value", micros(clicks, "ts").alias("ts"), micros(clicks, "arrived_at").alias("arrived"))
    c = cut(
        seen.select("client_id", "click_id", "ts", F.greatest("ts", F.col("arrived") + lag).alias("begin"), (F.col("kind").eqNullSafe("purchase")).cast("long").alias("purchase"), cents(F.col("value")).alias("cents"))
        .where(F.col("begin") < F.col("ts") + large * DAY)
        .withColumn("alive", _alive("begin", "ts", days))
    )
    sold = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL")
    s = sold.select("sale_id", "client_id", micros(sales, "sold_at").alias("sold"), micros(sales, "arrived_at").alias("arrived"), cents(F.col("total")).alias("cents"))
    s = s.withColumn("begin", F.greatest("sold", F.col("arrived") + lag)).withColumn("begin", F.when(F.col("arrived").isNotNull(), F.col("begin")))
    counted = s.where(F.col("begin") < F.col("sold") + large * DAY).withColumn("alive", _alive("begin", "sold", days))
    # lines of a sale that ship together are one row from here on, so a hot sale is as many rows as it has items and shippings
    packed = (
        lines.where("sale_id IS NOT NULL AND shipped_at IS NOT NULL")
        .select("sale_id", "item_id", micros(lines, "shipped_at").alias("shipped"), cents(F.col("amount")).alias("cents"))
        .groupBy("sale_id", "item_id", "shipped")
        .agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    )
    of_sales = counted.select("sale_id", "client_id", "sold", "begin")
    own = packed.join(of_sales, "sale_id").withColumn("begin", F.greatest("begin", "shipped")).where(F.col("begin") < F.col("sold") + large * DAY)
    found = cut(own.select("client_id", "item_id", "begin", "sold", "n", "cents"))
    rows = c.count() + s.count() + found.count()
    ln = cut(_covering(found, rows).withColumn("alive", _alive("begin", "sold", days)))

    one, col = F.lit(1), F.col
    parts = [
        _deltas(c, col("begin"), col("alive"), last=F.struct("ts", "click_id"), n_clicks=one, n_purchases=col("purchase"), click_cents=col("cents")),
        _deltas(counted, col("begin"), col("alive"), n_sales=one, sale_cents=col("cents")),
        _deltas(s, col("sold") - ahead_days * DAY, F.lit(0), label=1),
        _deltas(s, col("sold"), F.lit(0), label=-1),
    ]
    # an item's lines that nothing covers begin with them: one row for both
    fresh = col("covered").isNull() & col("item_id").isNotNull()
    parts.append(_deltas(ln, col("begin"), col("alive"), n_lines=col("n"), line_cents=col("cents"), n_items=fresh.cast("long")))
    for i, d in enumerate(days):
        bit, end = F.lit(1 << i), d * DAY
        on = (col("alive").bitwiseAND(1 << i)) != 0
        parts.append(_deltas(c.where(on), col("ts") + end, bit, -1, n_clicks=one, n_purchases=col("purchase"), click_cents=col("cents")))
        parts.append(_deltas(counted.where(on), col("sold") + end, bit, -1, n_sales=one, sale_cents=col("cents")))
        start = F.greatest(col("begin"), col("covered") + end)
        item = (col("item_id").isNotNull() & (start < col("sold") + end)).cast("long")
        parts.append(_deltas(ln.where(on), col("sold") + end, bit, -1, n_lines=col("n"), line_cents=col("cents"), n_items=item))
        parts.append(_deltas(ln.where(on & ~fresh & (item == 1)), start, bit, n_items=one))
    asked = probes.where("client_id IS NOT NULL").select("client_id", col("time").cast("long").alias("time"), F.lit(3).alias("mask"), one.alias("probe"), F.lit(0).cast("long").alias("label"), "sale_id", F.lit(None).cast(_LAST).alias("last"), *[F.lit(0).cast("long").alias(x) for x in COUNTS])
    moves = asked
    for part in parts:
        moves = moves.unionByName(part)

    by_client = c.select("client_id").unionByName(found.select("client_id")).unionByName(s.select("client_id"))
    hot = _hot(by_client.groupBy("client_id").agg(F.count("*").alias("n")), ["client_id"], rows)
    sums = _sums(days)
    placed = moves.withColumn("chunk", _chunk(hot, "time"))
    within = Window.partitionBy("client_id", "chunk").orderBy("time", "probe").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.select("client_id", "chunk", "time", "probe", "sale_id", *[F.sum(x).over(within).alias(f"in_{n}") for n, x in sums], F.max("last").over(within).alias("in_last")).where("probe = 1")
    each = moves.where(hot).withColumn("chunk", _chunk(hot, "time")).groupBy("client_id", "chunk").agg(*[F.sum(x).alias(n) for n, x in sums], F.max("last").alias("last"))
    past = Window.partitionBy("client_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("client_id", "chunk", *[F.sum(n).over(past).alias(f"be_{n}") for n, _ in sums], F.max("last").over(past).alias("be_last"))
    joined = inside.join(before, ["client_id", "chunk"], "left")

    def value(name: str) -> Column:
        return F.coalesce(f"in_{name}", F.lit(0)) + F.coalesce(f"be_{name}", F.lit(0))

    last = F.greatest("in_last", "be_last")
    out = [
        F.struct(
            F.lit(d).cast("int").alias("d"),
            *[value(f"{x}_{i}").alias(x) for x in COUNTS],
            F.when(F.col("last.ts") > F.col("time") - d * DAY, F.col("last.click_id")).alias("last_click_id"),
        )
        for i, d in enumerate(days)
    ]
    rows_out = joined.withColumn("last", last).select("sale_id", F.col("time").alias("t_us"), (value("label") > 0).alias("label"), F.inline(F.array(*out)))
    order = "sale_id d t_us label n_clicks n_purchases click_cents last_click_id n_sales sale_cents n_lines n_items line_cents"
    return rows_out.select(*order.split())


def with_probe(sales: DataFrame, spread_seconds: int = 259_200) -> DataFrame:
    """sale_id, client_id and time of each sale with a client and a moment: that moment and, by the crc32
    of its id, up to spread_seconds more."""
    known = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL")
    after = F.crc32(F.col("sale_id").cast("string").cast("binary")) % spread_seconds
    return known.select("sale_id", "client_id", (micros(sales, "sold_at") + after * 1_000_000).alias("time"))
