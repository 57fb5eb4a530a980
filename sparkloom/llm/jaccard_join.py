"""N-gram Jaccard self-join: which texts share at least num/den of their distinct word shingles.

Method. Every text is the set of its distinct shingle hashes. Tokens are hashed into groups, the
group counts are a point, and no two sets can share more tokens than the sum of their points'
coordinate minima. Points lie in STR-packed R-trees whose nodes keep the largest count of each group
and the smallest set size, so the same bound dismisses whole nodes; what survives is verified on the
sets themselves.

One R-tree over all points would not prune: in some 64 coordinates the boxes of random texts overlap
everywhere. The forest is therefore cut by a lossless rule. Two sets of a Jaccard similarity t share
at least t|A| and t|B| tokens, so in any one order of all tokens the first of those they share is among the
first |A| - t|A| + 1 of A and the first |B| - t|B| + 1 of B. Texts meet at these tokens (`_route_rows`), and
only there a tree is searched. The order is that of rarity, so that a line which many texts hold stands
last and brings none of them together while they have enough words of their own: meetings don't grow
with the table unless texts as a whole are alike. Rarity is counted for tokens together that have their
high bits in common (`_count_rows`), in a fixed number of counters; it decides the order alone, which loses
nothing whatever it is.

Work is linear in meetings: first every meeting is linked to one centre and those links are
verified and merged to components; then only meetings that still hold several components are searched
for pairs between different components, one of several meetings of the same texts. Meetings hold keys
alone; points, which take a quarter byte a token, are joined to distinct pairs and members, and token sets
are made for the texts that the bound leaves. Nothing is capped, and copies (equal sets) count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import vec
from sparkloom.llm.components import components
from sparkloom.llm.store import arrow_map, bitmap, cut, drop, in_bitmap, mix, row_slot, unique_ids

SHARE = 4  # tokens to a coordinate of a point, at least half of that
LEAF, FAN = 32, 8  # points in a leaf of the R-tree, leaves under a node
BLOCK, BLOCK_TOKENS = 1024, 1 << 20  # members, and their tokens, that one task compares with as many others
COUNTERS, ROW = 22, 12  # high bits of a token that choose its counter; bits of the counters in one row


def _digest(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit identity of each set: equal sets, and (but for a chance of 2**-64 a pair) only these."""
    return mix(vec.row_sums(mix(values), sizes) ^ mix(sizes.astype(np.uint64) + np.uint64(77))).view(np.int64)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    column = batch.column(batch.schema.get_field_index("text"))
    for lo, hi, values, sizes in vec.shingle_sets(column, k):
        yield lo, hi, values, sizes, _digest(values, sizes)


def point_of(tokens: np.ndarray) -> np.ndarray:
    """Counts of the tokens' groups, as bytes. Groups are low bits and their number is a power of two, so
    that a point of more groups can be folded to one of fewer."""
    groups = 1 << max(4, (len(tokens) // SHARE).bit_length())
    while True:
        counts = np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        groups *= 2


def _class_rows(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, values, sizes, keys in _sets(batch, k):
                ends = np.cumsum(sizes)
                points = [point_of(values[e - n : e]).tobytes() if n else b"" for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(keys), pa.array(sizes), pa.array(points, pa.binary())], ["doc_id", "k1", "n", "point"]
                )

    return run


def _first_rows(batch: pa.RecordBatch, rep_bits) -> pa.RecordBatch:
    """Rows whose id may be the first of its set, and those without id: copies are few among them."""
    rep = batch.column(1).to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(in_bitmap(rep_bits.value, rep) | np.asarray(batch.column(2))))


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _count_rows(k: int, rep_bits):
    """A task's counters of tokens, (part, counts) for each part of them that isn't zero, in bytes where these do."""

    def run(batches):
        counts = np.zeros(1 << COUNTERS, dtype=np.uint32)
        for batch in batches:
            for _, _, values, _, _ in _sets(_first_rows(batch, rep_bits), k):
                np.add.at(counts, _counter(values), 1)
        rows = counts.reshape(-1, 1 << ROW)
        most = rows.max(1)
        parts = np.flatnonzero(most)
        for at in range(0, len(parts), 64):
            some = parts[at : at + 64]
            packed = [(rows[i].astype(np.uint8) if most[i] < 256 else rows[i]).tobytes() for i in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])

    return run


def _level_rows(batches):
    """Logarithms of the tasks' summed counters, in eighths of a doubling, a byte each."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            row = np.frombuffer(counts, dtype=np.uint8 if len(counts) == 1 << ROW else np.uint32)
            sums[part] = sums[part] + row if part in sums else row.astype(np.int64)
    levels = [np.minimum(8 * np.log2(row + 1.0), 255).astype(np.uint8).tobytes() for row in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])


def _levels(texts: DataFrame, k: int, rep_bits) -> np.ndarray:
    """How common the tokens of each counter are: 2**COUNTERS bytes whatever the input."""
    rows = (
        texts.transform(arrow_map, _count_rows(k, rep_bits), "part int, counts binary")
        .repartition("part")
        .transform(arrow_map, _level_rows, "part int, levels binary")
        .toArrow()
    )
    out = np.zeros((1 << (COUNTERS - ROW), 1 << ROW), dtype=np.uint8)
    for part, levels in zip(rows.column("part").to_pylist(), rows.column("levels").to_pylist(), strict=True):
        out[part] = np.frombuffer(levels, dtype=np.uint8)
    return out.ravel()


def _route_rows(k: int, num: int, den: int, rep_bits, levels):
    """(sig, k1) of the rarest tokens of each set, as many as one of those shared with any partner is among.
    A sig is the token's level and low bits, in whose order tokens are taken; tokens that have it in
    common are one to this rule."""

    def run(batches):
        for batch in batches:
            for _, _, values, sizes, keys in _sets(_first_rows(batch, rep_bits), k):
                if not len(values):
                    continue
                order = (levels.value[_counter(values)].astype(np.uint64) << np.uint64(56)) | (values & np.uint64((1 << 56) - 1))
                ends = np.cumsum(sizes)
                takes = np.where(sizes > 0, sizes + (-num * sizes) // den + 1, 0)
                picked = [np.partition(order[e - n : e], p - 1)[:p] for e, n, p in zip(ends.tolist(), sizes.tolist(), takes.tolist(), strict=True) if n]
                sig, key = np.concatenate(picked).view(np.int64), np.repeat(keys, takes)
                for at in range(0, len(sig), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(sig[at : at + (1 << 17)]), pa.array(key[at : at + (1 << 17)])], ["sig", "k1"])

    return run


def _meeting_rows(batches):
    """Of rows (sig, k1) in this order, (sig, mn, k1) of every key but the first (mn) of a signature, once."""
    last_sig = last_key = least = None
    for batch in batches:
        sig, key = (batch.column(i).to_numpy() for i in range(2))
        if not len(sig):
            continue
        new = np.concatenate(([sig[0] != last_sig], sig[1:] != sig[:-1]))
        again = ~new & (key == np.concatenate(([last_key if last_key is not None else 0], key[:-1])))
        begin = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        mn = np.where(begin >= 0, key[np.maximum(begin, 0)], 0 if least is None else least)
        keep = ~new & ~again
        last_sig, last_key, least = sig[-1], key[-1], mn[-1]
        yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(mn[keep]), pa.array(key[keep])], ["sig", "mn", "k1"])


def _token_rows(k: int, key_bits, rep_bits):
    def run(batches):
        for batch in batches:
            for _, _, values, sizes, keys in _sets(_first_rows(batch, rep_bits), k):
                ends = np.cumsum(sizes)
                seen = np.flatnonzero(in_bitmap(key_bits.value, _jvm_slot(keys)) & (sizes > 0))
                if len(seen):
                    sets = [values[ends[i] - sizes[i] : ends[i]].tobytes() for i in seen.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[seen]), pa.array(sets, pa.binary())], ["k1", "tokens"])

    return run


def _jvm_slot(keys: np.ndarray) -> np.ndarray:
    """Slot of bigint keys in a bitmap of hashes: plain low bits."""
    return keys & np.int64((1 << 24) - 1)


def _points(column: pa.Array, groups: int = 0) -> np.ndarray:
    """Points folded to the groups that the one of fewest has, or to so many."""
    rows = [np.frombuffer(x, dtype=np.uint8) for x in column.to_pylist()]
    groups = groups or min(map(len, rows), default=1)
    return np.array([x if len(x) == groups else x.reshape(-1, groups).sum(0) for x in rows], dtype=np.int32).reshape(len(rows), groups)


def _bounded(num: int, den: int):
    """Keep pairs whose bound (the sum of coordinate minima) allows the similarity."""

    def run(batches):
        for batch in batches:
            fewer = pc.min_element_wise(pc.binary_length(batch.column("pa")), pc.binary_length(batch.column("pb"))).to_numpy()
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            keep = np.zeros(len(batch), dtype=bool)
            for groups in np.unique(fewer).tolist():
                rows = np.flatnonzero(fewer == groups)
                step = max(1, (1 << 20) // groups)
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    left, right = (_points(batch.column(c).take(pa.array(some)), groups) for c in ("pa", "pb"))
                    shared = np.minimum(left, right).sum(1)
                    keep[some] = den * shared >= num * (total[some] - shared)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return run


def _verified(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            left, right = batch.column("ta"), batch.column("tb")
            for i in range(len(batch)):
                a, b = (np.frombuffer(x[i].as_py(), dtype=np.uint64) for x in (left, right))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = den * shared >= num * (len(a) + len(b) - shared)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return run


def minima(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of each two points: min(a, b) is the number of t up to a and b."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for t in range(1, int(min(left.max(initial=0), right.max(initial=0))) + 1):
        out += (left >= t).astype(np.float32) @ (right >= t).astype(np.float32).T
    return out.astype(np.int64)


class RTree:
    """STR-packed R-tree over count points: for each node the largest count of every group and the
    smallest and largest set size, two levels above the points."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((points[:, 0], points[:, : points.shape[1] // 2].sum(1) // 4, sizes // 8))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.starts = np.arange(0, len(order), LEAF)
        self.upper = np.maximum.reduceat(self.points, self.starts, axis=0)
        self.least, self.most = np.minimum.reduceat(self.sizes, self.starts), np.maximum.reduceat(self.sizes, self.starts)
        self.top = np.arange(0, len(self.starts), FAN)
        self.top_upper = np.maximum.reduceat(self.upper, self.top, axis=0)
        self.top_least, self.top_most = np.minimum.reduceat(self.least, self.top), np.maximum.reduceat(self.most, self.top)

    def join(self, other: RTree, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
        """Places of the points of other whose bound with one of these reaches the similarity, point by
        point; of a tree joined to itself every pair comes in one order at least. Node by node, only the
        leaves whose bound does so are compared."""
        for t, (upper, least, most) in enumerate(zip(self.top_upper, self.top_least, self.top_most, strict=True)):
            shared = np.minimum(np.minimum(other.upper, upper).sum(1), np.minimum(other.most, most))
            fits = den * shared >= num * (least + other.least - shared)
            fits &= (den * most >= num * other.least) & (den * other.most >= num * least)
            if self is other:
                fits[: t * FAN] = False  # met from the other side
            leaves = np.flatnonzero(fits)
            if not len(leaves):
                continue
            at = (other.starts[leaves][:, None] + np.arange(LEAF)).ravel()
            at = at[at < len(other.order)]
            rows = np.arange(t * FAN * LEAF, min((t + 1) * FAN * LEAF, len(self.order)))
            shared = minima(self.points[rows], other.points[at])
            near = den * shared >= num * (self.sizes[rows][:, None] + other.sizes[at] - shared)
            for i in np.flatnonzero(near.any(1)).tolist():
                yield int(self.order[rows[i]]), other.order[at[near[i]]]


def _blocks(table, first: int, second: int):
    block = table.column("block").to_numpy()
    return np.flatnonzero(block == first), np.flatnonzero(block == second)


def _near_pairs(points: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int):
    """Pairs (one of left, those of right) whose bound reaches the similarity."""
    if len(left) and len(right):
        tree = RTree(points[left], sizes[left])
        same = len(left) == len(right) and left[0] == right[0]
        for i, found in tree.join(tree if same else RTree(points[right], sizes[right]), num, den):
            yield int(left[i]), right[found]


def _partners(num: int, den: int):
    """Of meetings (or two blocks of a large one, in rows that follow each other), which members a tree
    search gives partners in other components: links (a, b) that span the groups of partners of a
    meeting, so fewer than the members."""

    def links(table):
        k1, comp = table.column("k1").to_numpy(), table.column("comp").to_numpy()
        sizes = table.column("n").to_numpy()
        left, right = _blocks(table, table.column("b1")[0].as_py(), table.column("b2")[0].as_py())
        union, points = Union(), _points(table.column("point"))
        for i, found in _near_pairs(points, sizes, left, right, num, den):
            for j in found[comp[found] != comp[i]].tolist():
                if union.join(int(k1[i]), int(k1[j])):
                    yield int(k1[i]), int(k1[j])

    def run(batches):
        held = None
        for batch in chain(batches, (None,)):
            table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table is None or not len(table):
                continue
            ids = np.stack([table.column(c).to_numpy() for c in ("sig", "b1", "b2")])
            begins = np.concatenate(([0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1, [len(table)])).tolist()
            if batch is None:
                held = None
            else:
                held = table.slice(begins[-2])
                begins.pop()
            out = [x for lo, hi in zip(begins, begins[1:], strict=False) for x in links(table.slice(lo, hi - lo).combine_chunks())]
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


class Union:
    """Disjoint sets of bigints."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.root(a), self.root(b)
        self.parent[a] = b
        return a != b


def _spanning(num: int, den: int):
    """Of one cluster (or two blocks of a large one), verified links that join different components: as
    many as span them. Pairs already joined aren't verified, so the links are fewer than the members."""

    def run(key, table):
        k1, comp = table.column("k1").to_numpy(), table.column("comp").to_numpy().tolist()
        points, sizes = _points(table.column("point")), table.column("n").to_numpy()
        sets = table.column("tokens").to_pylist()
        left, right = _blocks(table, key[1].as_py(), key[2].as_py())
        union = Union()
        a, b = [], []
        for i, found in _near_pairs(points, sizes, left, right, num, den):
            own = np.frombuffer(sets[i], dtype=np.uint64)
            for j in found.tolist():
                if union.root(comp[i]) == union.root(comp[j]):
                    continue
                shared = len(np.intersect1d(own, np.frombuffer(sets[j], dtype=np.uint64), assume_unique=True))
                if den * shared >= num * (int(sizes[i]) + int(sizes[j]) - shared):
                    union.join(comp[i], comp[j])
                    a.append(k1[i])
                    b.append(k1[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _dealt(members: DataFrame, key: str) -> DataFrame:
    """members with the pairs of blocks (b1, b2) they take part in; a group of up to BLOCK members and
    BLOCK_TOKENS tokens is one block."""
    sizes = members.groupBy(key).agg(F.count("*").alias("m"), F.sum("n").alias("tokens_all"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("tokens_all") / BLOCK_TOKENS)).cast("int")
    return (
        members.join(sizes.where("m > 1").select(key, blocks.alias("blocks")), key)
        .withColumn("block", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")})
        .drop("other", "blocks")
    )


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, n_verified_links, component_id) of every row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered; a set holds the distinct k-word shingles, of a
    shorter text the whole word sequence. Two rows link when den * shared >= num * united; rows of the
    same set link too; n_verified_links counts the row's set's links that the search verified
    (a spanning part of all links), component_id is the smallest id that links reach. Null or empty
    texts have no set, link with nothing and are components of their own. Repeated rows are rows.
    A null id takes no part in minima, and is its component's id only if all ids of it are null.
    Columns beyond the two named ones are ignored. An empty table gives an empty result."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    classes = cut(docs.transform(arrow_map, _class_rows(k), "doc_id long, k1 long, n long, point binary"))
    nodes = cut(classes.where("n > 0").groupBy("k1").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("point").alias("point")))
    rep_bits = spark.sparkContext.broadcast(bitmap(nodes.where("rep is not null"), "rep"))
    texts = docs.select("text", F.coalesce(row_slot("doc_id"), F.lit(0)).alias("slot"), F.col("doc_id").isNull().alias("nameless"))

    def tokens(keys):
        """(k1, tokens) of these keys, and of some more."""
        key_bits = spark.sparkContext.broadcast(bitmap(keys, "k1", hashed=True))
        return texts.transform(arrow_map, _token_rows(k, key_bits, rep_bits), "k1 long, tokens binary").join(keys, "k1", "left_semi").dropDuplicates(["k1"])

    levels = spark.sparkContext.broadcast(_levels(texts, k, rep_bits))
    routes = texts.transform(arrow_map, _route_rows(k, num, den, rep_bits, levels), "sig long, k1 long")
    live = cut(routes.repartition("sig").sortWithinPartitions("sig", "k1").transform(arrow_map, _meeting_rows, "sig long, mn long, k1 long"))
    drop()
    points = nodes.select("k1", "n", "point")
    near = cut(
        live.select(F.col("mn").alias("a"), F.col("k1").alias("b")).distinct()
        .join(points.toDF("a", "na", "pa"), "a")
        .join(points.toDF("b", "nb", "pb"), "b")
        .transform(arrow_map, _bounded(num, den), "a long, b long")
    )
    sets = tokens(near.select(F.col("a").alias("k1")).union(near.select("b")).distinct())
    links = cut(near.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b").transform(arrow_map, _verified(num, den), "a long, b long"))
    drop(near)
    roots = components(links)

    # meetings that hold several components still, one of those of the same texts
    member = live.select("sig", "k1").unionAll(live.select("sig", F.col("mn").alias("k1")).distinct())
    member = member.join(roots.withColumnRenamed("node", "k1"), "k1", "left").select("sig", "k1", F.coalesce("root", "k1").alias("comp"))
    mixed = member.groupBy("sig").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.bit_xor("k1").alias("x"), F.bit_xor(F.xxhash64("k1")).alias("y")
    )
    mixed = mixed.where("lo < hi and m > 2").groupBy("x", "y", "m").agg(F.min("sig").alias("sig"))
    met = cut(member.join(mixed.select("sig"), "sig").join(points.select("k1", "n"), "k1"))
    drop(live)  # and with it what was shuffled for the meetings, before their points are
    met = _dealt(met, "sig").join(points.select("k1", "point"), "k1")
    closer = cut(
        met.select("sig", "b1", "b2", "block", "k1", "comp", "n", "point")
        .repartition("sig", "b1", "b2")
        .sortWithinPartitions("sig", "b1", "b2")
        .transform(arrow_map, _partners(num, den), "a long, b long")
    )
    if not closer.isEmpty():
        # each text once, with those that its partners lead to
        clusters = components(closer).toDF("k1", "cluster")
        comps = roots.withColumnRenamed("node", "k1").withColumnRenamed("root", "comp")
        grouped = cut(clusters.join(points, "k1").join(comps, "k1", "left").withColumn("comp", F.coalesce("comp", "k1")))
        apart = _dealt(grouped, "cluster").join(tokens(grouped.select("k1")), "k1")
        more = cut(
            apart.select("cluster", "b1", "b2", "block", "k1", "comp", "n", "point", "tokens")
            .groupBy("cluster", "b1", "b2")
            .applyInArrow(_spanning(num, den), "a long, b long")
        )
        links = links.unionAll(more)
        roots = components(links)
    reps = nodes.select("k1", "rep")
    degree = links.select("a").unionAll(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("k1")).agg(F.count("*").alias("n_verified_links"))
    named = (
        roots.withColumnRenamed("node", "k1")
        .join(reps, "k1")
        .select("k1", F.min("rep").over(Window.partitionBy("root")).alias("least"))
        .join(degree, "k1", "left")
    )
    sets = reps.join(named, "k1", "left").select("k1", F.coalesce("least", "rep").alias("component"), F.coalesce("n_verified_links", F.lit(0)).alias("n_verified_links"))
    out = classes.join(sets, "k1", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("n_verified_links")).otherwise(0).cast("long").alias("n_verified_links"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Near-duplicate removal: of each component the row with the smallest doc_id stays, of rows with
    the same id any one. Null and empty texts and those without words stay; long ones are compared whole; an
    empty table stays empty. Columns are those of docs, whatever they are called."""
    rows, _, row = unique_ids(docs)
    groups = jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), k, num, den)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)
