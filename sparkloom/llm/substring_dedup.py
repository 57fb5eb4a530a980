"""Fuzzy repeated passages by collinear chaining.

Seeds are word k-mers, one (the smallest hash) out of every WINDOW consecutive ones of a text, so two
texts with WINDOW + K - 1 words in common share a seed. Every seed that several texts hold links each of
them to the first that holds it (the smallest id): as many anchors as occurrences, never all pairs. So
does the seed with the next words up to SPANS in all, where the first text that has the seed goes on
otherwise: parts of a passage may stand in other, earlier texts, to which its seeds all lead, but every
run of WINDOW - 1 words more than a span also leads to the first text that has this span of it. A seed
that a text holds again is linked to the place before, too, so passages that repeat inside a text are found.
One anchor is enough to align; passages that reach the end of the pieces that are aligned first are
aligned again over the whole texts.
Anchors of a text and its reference are chained: a chain's score is the words its seeds cover less a cost
for the words between them, and each anchor finds its best predecessor as a prefix maximum in a Fenwick
tree over reference places. Chains around which too few pairs of neighbouring words agree for any passage
go first, by a bound that loses none. The others are aligned word by word, banded around their
diagonals, beyond their ends as far as the words agree, and passages of MIN_WORDS or more that are alike
to IDENTITY are kept; a chain over words that don't match is parted there and every part of it aligned.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import vec
from sparkloom.llm.store import arrow_map, bitmap, cut, drop, free, in_bitmap, mix, row_slot, unique_ids

K, WINDOW = 6, 4
MIN_WORDS, IDENTITY = 50, 0.8
SPANS = (20, MIN_WORDS)
RESUME = 4  # words that must agree where an alignment changes its diagonal
HOT = 2000  # pairs with one reference that one task aligns
SLICES = 2  # of the texts with a reference, aligned one after the other: words of one slice are shuffled at a time
LAYOUT = 1 << 19  # words that are compared at once
GAP, MARGIN = 0.15, 24  # cost of a word between seeds; words that may outweigh those that agree where an alignment goes on
BITS, BUCKETS = 25, 12  # of the bitmap of seeds that several places have; the first of a slot's bits, by which seeds are counted
PACKED = 1 << 20  # seeds of a task that are packed at once
LANES = 1 << 11  # chains whose ends are followed at once
CELLS = 1 << 18  # words of them that are compared at once


def winnow(values: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and values of the smallest (leftmost) of every `width` consecutive values of a row,
    each once; of rows of fewer values, of all of them."""
    n = len(values)
    rows = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate(([0], np.cumsum(counts)))
    if not n:
        return rows, rows, values
    best = np.arange(n)
    top = begin[rows + 1]
    span = 1
    while span < width:  # doubling: best of span values from here, cut off at the row's end
        step = min(span, width - span)
        other = np.minimum(np.arange(n) + step, top - 1)
        other = best[other]
        best = np.where(values[other] < values[best], other, best)
        span += step
    whole = np.arange(n) + width <= top
    whole |= (np.arange(n) == begin[rows]) & (counts[rows] < width)
    chosen = best[whole]  # they never fall
    chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
    return rows[chosen], chosen - begin[rows[chosen]], values[chosen]


def _hashed(data, offsets):
    starts, ends, counts = vec.words(data, offsets, vec.ALNUM)
    return vec.word_hashes(data, starts, ends), counts, starts, ends


def _winnowed(batches):
    """Of some megabytes of text each: ids, word hashes, words of each text, and rows, places and values
    of the seeds."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = vec.text_bytes(batch.column(1))
        for lo, hi in vec.chunks(offsets, vec.CHUNK >> 2):
            hashes, counts, _, _ = _hashed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            grams, sizes = vec.shingles(hashes, counts, K)
            enough = counts >= K
            grams, sizes = grams[np.repeat(enough, sizes)], np.where(enough, sizes, 0)
            yield ids[lo:hi], hashes, counts, winnow(grams, sizes, WINDOW)


def _again(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key the index of the same key of the same row before it, -1 for the first."""
    before = np.full(len(keys), -1, dtype=np.int64)
    keys = keys ^ mix(rows)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    group = np.cumsum(np.concatenate(([0], ~same)))[: len(order)]
    some = np.concatenate((same, [False])) | np.concatenate(([False], same))
    order, group = order[some[: len(order)]], group[some[: len(order)]]
    order = order[np.lexsort((order, group))]  # places rise within a key
    same = group[1:] == group[:-1]
    before[order[1:][same]] = order[:-1][same]
    return before


def _seed_rows(batches):
    """(bucket, seeds): some texts' seeds in the order of their slots in the bitmap, packed by the slots' first
    bits; each once, or twice if it is there more often."""

    def packed(seeds):
        seeds = np.sort(np.concatenate(seeds))
        seeds = seeds[np.concatenate((np.ones(min(2, len(seeds)), dtype=bool), seeds[2:] != seeds[:-2]))]
        at = np.searchsorted(seeds, np.arange(1 << BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKETS))
        sizes = np.diff(np.append(at, len(seeds)))
        offsets = np.concatenate(([0], np.cumsum(8 * sizes[sizes > 0]))).astype(np.int32)
        held = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(seeds)])
        return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sizes).astype(np.int32)), held], ["bucket", "seeds"])

    held, n = [], 0
    for _, _, _, (_, _, seeds) in _winnowed(batches):
        held.append((seeds << np.uint64(64 - BITS)) | (seeds >> np.uint64(BITS)))
        n += len(seeds)
        if n >= PACKED:
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def _live_bits(table: pa.Table) -> pa.Table:
    """The bucket's part of the bitmap of seeds that are there more than once."""
    column = table.column("seeds").combine_chunks()
    seeds = np.sort(np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64))
    slots = seeds[1:][seeds[1:] == seeds[:-1]] >> np.uint64(64 - BITS)
    flags = np.zeros(1 << (BITS - BUCKETS), dtype=bool)
    flags[slots & np.uint64(len(flags) - 1)] = True
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})


def _live_seeds(docs: DataFrame) -> np.ndarray:
    """Bitmap of the seeds that stand in docs twice or oftener."""
    found = docs.transform(arrow_map, _seed_rows, "bucket int, seeds binary").groupBy("bucket").applyInArrow(_live_bits, "bucket int, bits binary").toArrow()
    out = np.zeros((1 << BUCKETS, 1 << (BITS - BUCKETS - 6)), dtype=np.int64)
    for bucket, bits in zip(found.column("bucket").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[bucket] = np.frombuffer(bits, dtype=np.int64)
    return out.ravel()


def _marked_rows(live, min_words: int):
    """(seed, span0, span1, doc, pos, before) of every place of a live seed: the hashes of the words from
    there on, null where the text ends first or has had them, and the place of the seed before in this
    text (-2 where those around it say as much). Seeds inside min_words that repeat in their text word by
    word are only linked to it: the seed is null, too."""

    def run(batches):
        for ids, hashes, counts, (rows, places, seeds) in _winnowed(batches):
            keep = in_bitmap(live.value, (seeds & np.uint64((1 << BITS) - 1)).astype(np.int64))
            rows, places, seeds = rows[keep], places[keep], seeds[keep]
            back = _again(rows, seeds)
            before = np.where(back >= 0, places[back], -1)
            covered = np.zeros(len(rows), dtype=bool)
            at = np.flatnonzero(before >= 0)
            if len(at):
                shift = places[at] - before[at]
                new = np.concatenate(([True], (rows[at][1:] != rows[at][:-1]) | (shift[1:] != shift[:-1]) | (np.diff(places[at]) > K)))
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:], [len(at)])) - 1
                long = places[at[last]] + K - places[at[first]] >= min_words
                covered[at] = np.repeat(long, last - first + 1)
                # of a run only what holds it together: the first and last place of every K words
                run = np.repeat(np.arange(len(first)), last - first + 1)
                cell = (places[at] - places[at[first]][run]) // K
                inner = (run[1:] == run[:-1]) & (cell[1:] == cell[:-1])
                before[at[1:-1][inner[1:] & inner[:-1]]] = -2
            rows, places, seeds, before, covered = (x[~covered | (before != -2)] for x in (rows, places, seeds, before, covered))
            begin = (np.cumsum(counts) - counts)[rows]
            cols = [pa.array(seeds.view(np.int64), mask=covered)]
            for span in SPANS:
                fits = np.flatnonzero((places + span <= counts[rows]) & ~covered)
                around = vec.long_runs(hashes, begin[fits] + places[fits], span)
                fits, around = fits[(new := _again(rows[fits], around) < 0)], around[new]
                hold, none = np.zeros(len(rows), dtype=np.uint64), np.ones(len(rows), dtype=bool)
                hold[fits], none[fits] = around, False
                cols.append(pa.array(hold.view(np.int64), mask=none))
            cols += [pa.array(ids[rows].astype(np.int64)), pa.array(places.astype(np.int32)), pa.array(before.astype(np.int32), mask=before == -1)]
            yield pa.RecordBatch.from_arrays(cols, ["seed", "span0", "span1", "doc", "pos", "before"])

    return run


class Fenwick:
    """Prefix maxima over ranks: put(i, value, who), best(i) among ranks below i."""

    def __init__(self, n: int):
        self.value, self.who = [-np.inf] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.value):
            if value > self.value[i]:
                self.value[i], self.who[i] = value, who
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        value, who = -np.inf, -1
        while i > 0:
            if self.value[i] > value:
                value, who = self.value[i], self.who[i]
            i -= i & -i
        return value, who


def segments(pair: np.ndarray, pos: np.ndarray, rpos: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Runs of anchors of one pair and diagonal that overlap or nearly do: pair, start, end, ref start and
    ref end of each, in the order of pairs, starts and ends."""
    diagonal = pos - rpos
    by = np.lexsort((pos, diagonal, pair))
    q, d, p = pair[by], diagonal[by], pos[by]
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (d[1:] != d[:-1]) | (p[1:] - p[:-1] > WINDOW + k)))
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(p)])) - 1
    q, s, e, d = q[at], p[at], p[last] + k, d[at]
    by = np.lexsort((e, s, q))
    q, s, e, d = q[by], s[by], e[by], d[by]
    return q, s, e, s - d, e - d


def chain_segments(s: np.ndarray, e: np.ndarray, rs: np.ndarray, re: np.ndarray, gap: float = GAP) -> list[tuple[list[int], float]]:
    """Best chains of the segments of one pair, as (segments in order, score), each segment in one chain
    at most."""
    n = len(s)
    ranks = np.unique(re)
    tree = Fenwick(len(ranks))
    score, back = [0.0] * n, [-1] * n
    rank_end, rank_start = np.searchsorted(ranks, re).tolist(), np.searchsorted(ranks, rs, side="right").tolist()
    by_end = np.argsort(e, kind="stable").tolist()
    own, in_cost, out_cost = (e - s).tolist(), (gap * (s + rs)).tolist(), (gap * (e + re)).tolist()
    s, e = s.tolist(), e.tolist()
    put = 0
    for i in range(n):  # in order of starts: all that end by then are in the tree
        while put < n and e[by_end[put]] <= s[i]:
            j = by_end[put]
            if j < i:
                tree.put(rank_end[j], score[j] + out_cost[j], j)
            put += 1
        value, who = tree.best(rank_start[i])
        value -= in_cost[i]
        score[i], back[i] = (own[i] + value, who) if value > 0 else (own[i], -1)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda x: -score[x]):
        links, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            links.append(j)
            j = back[j]
        if links:
            out.append((links[::-1], float(score[i])))
    return out


def chain(pos: np.ndarray, rpos: np.ndarray, k: int = 8, gap: float = GAP) -> list[tuple[int, int, int, int, float]]:
    """Best chains of the anchors of one text and one reference; those of one diagonal that overlap count
    as one segment."""
    s, e, rs, re = segments(np.zeros(len(pos), np.int64), pos.astype(np.int64), rpos.astype(np.int64), k)[1:]
    return [(int(s[i[0]]), int(e[i[-1]]), int(rs[i[0]]), int(re[i[-1]]), score) for i, score in chain_segments(s, e, rs, re, gap)]


def _chain_rows(batches):
    """Chains of the anchors (doc, ref, pos, rpos), sorted by text and reference: a row for each pair,
    with the segments of the best chain first and the number of each segment's chain."""

    def chained(doc, ref, pos, rpos):
        at = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]))))
        pair = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(doc))))
        q, *ends = segments(pair, pos.astype(np.int64), rpos.astype(np.int64), K)
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        sizes = np.diff(np.append(first, len(q)))
        number = np.zeros(len(q), dtype=np.int64)
        for a, n in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            chains = [links for links, _ in chain_segments(*(x[a : a + n] for x in ends))]
            order = a + np.concatenate(chains)
            for x in ends:
                x[a : a + n] = x[order]
            number[a : a + n] = np.repeat(np.arange(len(chains)), [len(c) for c in chains])
        offsets = pa.array(np.append(first, len(q)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (*ends, number)]
        return pa.RecordBatch.from_arrays([pa.array(doc[at], pa.int64()), pa.array(ref[at], pa.int64()), *lists], ["doc", "ref", "s", "e", "rs", "re", "chain"])

    held = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
        end = int(change[-1]) + 1 if len(change) else 0
        held = [c[end:] for c in cols]
        if end:
            yield chained(*(c[:end] for c in cols))
    if held is not None:
        yield chained(*held)


def _word_rows(wanted):
    """(doc, words): the 32-bit word hashes of wanted texts."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(wanted.value, batch.column(2).to_numpy(zero_copy_only=False))))
            data, offsets = vec.text_bytes(batch.column(1))
            for lo, hi in vec.chunks(offsets):
                hashes, counts, _, _ = _hashed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ends = np.cumsum(counts)
                low = hashes.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([low[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary())],
                    ["doc", "words"],
                )

    return run


def least_share(identity: float) -> float:
    """The least share of words with an equal neighbour on their diagonal, less one word, of passages alike
    to identity. Of n words n * identity are the same at least; the others, in either text, part them into
    one run more than they are, and all runs but the last may be of one word."""
    return 3 * identity - 2


def promising(a, b, first, size, diagonal, rfirst, rsize, band: int, min_words: int, identity: float) -> np.ndarray:
    """Which pieces may hold a passage, as enough words have an equal neighbour in the band: of words
    a[first : first + size] against b[rfirst : rfirst + rsize], where diagonal is the place in the second
    that the first's start lies on. Many pieces are laid in a row and compared at once."""
    out = np.zeros(len(first), dtype=bool)
    width = size + 2 * band + 1
    share = round(100 * least_share(identity))
    groups = (np.cumsum(width) // LAYOUT).tolist()
    at = 0
    while at < len(first):
        end = int(np.searchsorted(groups, groups[at], side="right"))
        w, n = width[at:end], size[at:end]
        off = np.cumsum(w) - w
        unit = np.repeat(np.arange(end - at), w)
        k = np.arange(len(unit)) - off[unit] - band
        mine = (k >= 0) & (k < n[unit])
        own = np.where(mine, a[np.where(mine, first[at:end][unit] + k, 0)] | np.uint32(2), np.uint32(0))
        j = k + diagonal[at:end][unit]
        there = (j >= 0) & (j < rsize[at:end][unit])
        other = np.where(there, b[np.where(there, rfirst[at:end][unit] + j, 0)] | np.uint32(2), np.uint32(1))
        m = len(own)
        hit = np.zeros(m, dtype=bool)
        for d in range(-band, band + 1):
            lo, hi = max(0, -d), min(m, m - d)
            same = own[lo:hi] == other[lo + d : hi + d]
            both = same[1:] & same[:-1]
            hit[lo + 1 : hi] |= both
            hit[lo : hi - 1] |= both
        unit = unit[mine]
        sums = np.concatenate(([0], np.cumsum(100 * hit[mine].astype(np.int64) - share)))
        big = 200 * (m + 1)
        sums[1:] -= unit * big  # so that minima are those of the own piece
        starts = sums.copy()
        starts[:-1] = np.concatenate(([0], sums[1:-1] - np.diff(unit) * big)) if len(unit) else starts[:-1]
        low = np.minimum.accumulate(starts)
        gain = np.full(len(unit), -big, dtype=np.int64)
        if len(unit) >= min_words:
            gain[min_words - 1 :] = sums[min_words:] - low[: len(sums) - min_words]
        ok = gain >= -100
        out[at:end] = np.bincount(unit[ok], minlength=end - at) > 0
        at = end
    return out


def resumed(a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
    """The nearest places of two word runs, another diagonal than the first words', from which RESUME
    words agree, among the first words of each."""
    a, b = a[: MARGIN + RESUME], b[: MARGIN + RESUME]
    n, m = len(a) - RESUME + 1, len(b) - RESUME + 1
    if n <= 0 or m <= 0:
        return None
    same = a[:, None] == b
    run = same[:n, :m]
    for i in range(1, RESUME):
        run = run & same[i : i + n, i : i + m]
    u, v = np.nonzero(run)
    u, v = u[u != v], v[u != v]
    if not len(u):
        return None
    i = int(np.argmin(np.maximum(u, v) * 1000 + u + v))
    return int(u[i]), int(v[i])


def onward(a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[int, int, np.ndarray]], bool, bool]:
    """From the start of two word runs along their diagonal as long as the words that agree outweigh the
    others by all but MARGIN, then along the diagonal where they agree again: pieces (start, ref start,
    which words agree), and which of the runs ended."""
    out, i, j = [], 0, 0
    while True:
        n = min(len(a) - i, len(b) - j)
        size = 0
        step = 256
        while True:  # ever longer looks, as most end soon
            m = min(n, step)
            hit = a[i : i + m] == b[j : j + m]
            sums = np.cumsum(np.where(hit, 1, -1))
            fallen = np.flatnonzero(np.maximum(np.maximum.accumulate(sums), 0) - sums > MARGIN) if m else sums
            if len(fallen) or m == n:
                break
            step *= 8
        if len(fallen):
            sums = sums[: fallen[0]]
        if len(sums) and sums.max() > 0:
            size = len(sums) - int(np.argmax(sums[::-1]))
            out.append((i, j, hit[:size]))
        ended = not len(fallen), len(a) - i - n == 0, len(b) - j - n == 0
        i, j = i + size, j + size
        jump = resumed(a[i:], b[j:])
        if jump is None:  # words that agree further on don't outweigh the others, but a passage may need them
            m = min(len(a) - i, len(b) - j, MIN_WORDS)
            rest = np.flatnonzero(a[i : i + m] == b[j : j + m])
            if len(rest):
                out.append((i, j, a[i : i + rest[-1] + 1] == b[j : j + rest[-1] + 1]))
            return out, ended[0] and ended[1], ended[0] and ended[2]
        i, j = i + jump[0], j + jump[1]


#: Pairs of places that resumed() may take, as places in a square, the nearest first.
_NEAREST = np.array(sorted((max(u, v) * 1000 + u + v, u, v) for u in range(MARGIN + 1) for v in range(MARGIN + 1) if u != v))
_NEAREST = _NEAREST[:, 1] * (MARGIN + 1) + _NEAREST[:, 2]


def _along(a, b, i, j, n, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For n words from a[i] and b[j] on, in direction step, of many runs at once: how many words go along the
    diagonal as onward() has it, how many of them agree, and whether the others outweighed those."""
    size, top, fell = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int32), np.zeros(len(i), dtype=bool)
    lane, done, total = np.flatnonzero(n > 0), 0, np.zeros(int((n > 0).sum()), dtype=np.int32)
    while len(lane):
        width = min(max(CELLS // len(lane), MARGIN), 4096, 2 * MARGIN if not done else 4 * done)  # ever longer looks, as most end soon
        k = np.arange(width)
        left = np.minimum(n[lane] - done, width)[:, None]
        short = bool((left < width).any())
        far = step * (np.minimum(k, left - 1) if short else k)
        same = a[(i[lane] + step * done)[:, None] + far] == b[(j[lane] + step * done)[:, None] + far]
        sums = np.cumsum(same.view(np.int8) * np.int8(2) - np.int8(1), axis=1, dtype=np.int32)
        sums += total[:, None]
        fallen = np.maximum(np.maximum.accumulate(sums, axis=1), top[lane, None]) - sums > MARGIN
        if short:
            fallen &= k < left
        gone = fallen.any(axis=1)
        total = sums[np.arange(len(lane)), left[:, 0] - 1]
        sums[k >= np.where(gone, fallen.argmax(axis=1), left[:, 0])[:, None]] = -1
        last = width - 1 - sums[:, ::-1].argmax(axis=1)
        best = sums[np.arange(len(lane)), last]
        better = (best >= top[lane]) & (best > 0)
        top[lane[better]], size[lane[better]] = best[better], done + last[better] + 1
        fell[lane[gone]] = True
        done += width
        more = ~gone & (n[lane] > done)
        lane, total = lane[more], total[more]
    return size, (top + size) // 2, fell


def _words_from(a, i, n, step: int, width: int, none: int) -> np.ndarray:
    """The first words of many runs of n words from a[i] on, in direction step; `none` after their end."""
    k = np.arange(width)
    inside = k < n[:, None]
    return np.where(inside, a[np.where(inside, i[:, None] + step * k, 0)].astype(np.int64), none)


def onward_all(a, b, i, na, j, nb, step: int):
    """onward() for many pairs of runs at once, na words from a[i] on and nb from b[j] on, in direction step:
    the pieces (lane, start, ref start, length) in the order of lanes, how many words of a lane agree, and
    which of its runs ended (two columns)."""
    p, q, agree = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
    ended = np.zeros((len(i), 2), dtype=bool)
    lane, pieces = np.arange(len(i)), []
    while len(lane):  # those that still go on
        n = np.minimum(na[lane] - p[lane], nb[lane] - q[lane])
        size, hits, fell = _along(a, b, i[lane] + step * p[lane], j[lane] + step * q[lane], n, step)
        some = size > 0
        pieces.append((lane[some], p[lane[some]], q[lane[some]], size[some]))
        agree[lane] += hits
        ended[lane] = ~fell[:, None] & np.stack((na[lane] - p[lane] == n, nb[lane] - q[lane] == n), axis=1)
        p[lane] += size
        q[lane] += size
        left, rleft, at, rat = na[lane] - p[lane], nb[lane] - q[lane], i[lane] + step * p[lane], j[lane] + step * q[lane]
        ours, others = _words_from(a, at, left, step, MARGIN + RESUME, -1), _words_from(b, rat, rleft, step, MARGIN + RESUME, -2)
        same = ours[:, :, None] == others[:, None, :]
        run = same[:, : MARGIN + 1, : MARGIN + 1]
        for x in range(1, RESUME):
            run = run & same[:, x : x + MARGIN + 1, x : x + MARGIN + 1]
        run = run.reshape(len(lane), -1)[:, _NEAREST]
        u, v = np.divmod(_NEAREST[run.argmax(axis=1)], MARGIN + 1)
        jump = run.any(axis=1)
        end = ~jump
        hit = _words_from(a, at[end], left[end], step, MIN_WORDS, -1) == _words_from(b, rat[end], rleft[end], step, MIN_WORDS, -2)
        some = hit.any(axis=1)
        tail = lane[end][some]
        pieces.append((tail, p[tail], q[tail], MIN_WORDS - hit[some][:, ::-1].argmax(axis=1)))
        agree[tail] += hit[some].sum(axis=1)
        lane = lane[jump]
        p[lane] += u[jump]
        q[lane] += v[jump]
    pieces = [np.concatenate(x) for x in zip(*pieces, strict=True)] if pieces else [np.zeros(0, dtype=np.int64)] * 4
    order = np.argsort(pieces[0], kind="stable")
    return [x[order] for x in pieces], agree, ended


def _followed(a, b, s, rs, e, re, a_at, a_n, b_at, b_n):
    """Both ends of chains from (s, rs) to (e, re) in runs a[a_at : a_at + a_n] and b[b_at : b_at + b_n]: how many
    words agree there, which runs ended (the starts of both, the ends of both), and a function that gives a
    chain's own pieces as _columns takes them."""
    agree, ended, parts = np.zeros(len(s), dtype=np.int64), np.zeros((len(s), 4), dtype=bool), ([], [])
    for lo in range(0, max(len(s), 1), LANES):  # there may be none
        x = slice(lo, lo + LANES)
        for end, at, n, rat, rn, step in ((0, a_at[x] + s[x] - 1, s[x], b_at[x] + rs[x] - 1, rs[x], -1), (1, a_at[x] + e[x], a_n[x] - e[x], b_at[x] + re[x], b_n[x] - re[x], 1)):
            (lane, *piece), hits, flags = onward_all(a, b, at, n, rat, rn, step)
            agree[x] += hits
            ended[x, 2 * end : 2 * end + 2] = flags
            parts[end].append((lane + lo, *piece))
    flat = [[np.concatenate(c) for c in zip(*part, strict=True)] for part in parts]
    begins = [np.searchsorted(f[0], np.arange(len(s) + 1)).tolist() for f in flat]
    flat = [np.stack(f[1:], axis=1) for f in flat]

    def ends(c: int):
        back, ahead = (f[begin[c] : begin[c + 1]].tolist() for f, begin in zip(flat, begins, strict=True))
        return back, ended[c, :2].tolist(), (int(e[c]), int(re[c])), ahead, ended[c, 2:].tolist()

    return agree, ended, ends


def _columns(a: np.ndarray, b: np.ndarray, links: list[tuple[int, int, int]], ends=None):
    """The alignment along a chain of segments (start, end, ref start): places in both runs and whether the
    words agree, column by column (a word without a partner takes a column of its own; a last place
    closes them), and whether the alignment came to the start of either run and to the end of either. What
    _followed has found at the chain's ends is not sought again."""
    s, e, rs = links[0]
    if ends is None:
        back, *at_start = onward(a[:s][::-1], b[:rs][::-1])
        pieces = [(s - i - len(hit), rs - j - len(hit), hit[::-1]) for i, j, hit in back[::-1]]
    else:
        back, at_start, last, ahead, at_end = ends
        pieces = [(s - i - n, rs - j - n, a[s - i - n : s - i] == b[rs - j - n : rs - j]) for i, j, n in back[::-1]]
    pieces.append((s, rs, a[s:e] == b[rs : rs + e - s]))
    for s2, e2, rs2 in links[1:]:
        s, rs, hit = pieces[-1]
        i, j = s + len(hit), rs + len(hit)
        over = max(i - s2, j - rs2, 0)  # what the segments before have taken
        if s2 + over >= e2:
            continue
        s2, rs2 = s2 + over, rs2 + over
        if s2 - i != rs2 - j and min(s2 - i, rs2 - j) > RESUME:
            between = [(i + u, j + v, hit) for u, v, hit in onward(a[i:s2], b[j:rs2])[0]]
            if between:
                pieces += between
                s, rs, hit = pieces[-1]
                i, j = s + len(hit), rs + len(hit)
        m = min(s2 - i, rs2 - j)
        if m:
            left, right = a[i : i + m] == b[j : j + m], a[s2 - m : s2] == b[rs2 - m : rs2]
            if s2 - i == rs2 - j:
                t = m
            else:  # the place to change diagonals at which most words agree
                t = int(np.argmax(np.concatenate(([0], np.cumsum(left))) + np.concatenate((np.cumsum(right[::-1])[::-1], [0]))))
            pieces.append((i, j, left[:t]))
            pieces.append((s2 - m + t, rs2 - m + t, right[t:]))
        pieces.append((s2, rs2, a[s2:e2] == b[rs2 : rs2 + e2 - s2]))
    s, rs, hit = pieces[-1]
    i, j = s + len(hit), rs + len(hit)
    if ends is None or (i, j) != last:
        ahead, *at_end = onward(a[i:], b[j:])
        pieces += [(i + x, j + y, hit) for x, y, hit in ahead]
    else:
        pieces += [(i + x, j + y, a[i + x : i + x + n] == b[j + y : j + y + n]) for x, y, n in ahead]
    pa_, pb_, same, i, j = [], [], [], *pieces[0][:2]
    for s, rs, hit in pieces:
        gap = max(s - i, rs - j)
        if gap:
            pa_.append(np.minimum(np.arange(i, i + gap), s))
            pb_.append(np.minimum(np.arange(j, j + gap), rs))
            same.append(np.zeros(gap, dtype=bool))
        i, j = s + len(hit), rs + len(hit)
        pa_.append(np.arange(s, i))
        pb_.append(np.arange(rs, j))
        same.append(hit)
    return np.append(np.concatenate(pa_), i), np.append(np.concatenate(pb_), j), np.concatenate(same), at_start, at_end


def alike(x: np.ndarray, y: np.ndarray, same: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """All passages (start, end, ref start, ref end, words that agree) of min_words alike to identity in an
    alignment's columns. A run of columns below identity has bridged what doesn't match: its best part is
    sought again with a higher cost of columns that don't, until that parts it; what stands before and
    behind a passage is looked at by itself."""
    hits = np.concatenate(([0], np.cumsum(same)))

    def passage(lo, hi):
        return int(x[lo]), int(x[hi - 1]) + 1, int(y[lo]), int(y[hi - 1]) + 1, int(hits[hi] - hits[lo])

    def enough(p, q, rp, rq, n):
        return min(q - p, rq - rp) >= min_words and n >= identity * max(q - p, rq - rp) - 1e-9

    out, rest = [], [(0, len(same))]
    while rest:
        lo, hi = rest.pop()
        if hits[hi] - hits[lo] < identity * min_words - 1e-9:
            continue
        for cost in range(1, max(1, round(identity / max(1 - identity, 0.01))) + 1):
            sums = np.concatenate(([0], np.cumsum(np.where(same[lo:hi], 1, -cost))))
            low = np.minimum.accumulate(sums)
            end = int(np.argmax(sums - low))
            if not end or (cost == 1 and sums[end] - low[end] < least_share(identity) * min_words - 1e-9):
                end = 0  # no passage scores less
                break
            start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
            found = _widened(passage, same, lo, hi, lo + start, lo + end, min_words, identity)
            if enough(*passage(*found)):
                break
        if not end:
            continue
        start, end = found
        if enough(*passage(start, end)):
            out.append(passage(start, end))
        rest += [(lo, start), (end, hi)]
    return sorted(out)


def _widened(passage, same, lo: int, hi: int, start: int, end: int, min_words: int, identity: float) -> tuple[int, int]:
    """A run of columns of fewer than min_words carried on to words that agree, where most do: the best run
    leaves out ends that would lower its score, though all may still be alike enough."""
    p, q, rp, rq, _ = passage(start, end)
    if min(q - p, rq - rp) >= min_words:
        return start, end
    first = np.flatnonzero(same[max(lo, start - min_words) : start])[::-1] + max(lo, start - min_words)
    last = np.flatnonzero(same[end : min(hi, end + min_words)]) + end + 1
    first, last = np.append([start], first), np.append([end], last)
    length = last - first[:, None]
    n = np.arange(len(first))[:, None] + np.arange(len(last)) + int(same[start:end].sum())
    share = np.where(length >= min_words, n / np.maximum(length, 1), 0.0)
    u, v = np.unravel_index(int(share.argmax()), share.shape)
    return (int(first[u]), int(last[v])) if share[u, v] else (start, end)


_FOUND = ["doc_id", "ref_id", "start_word", "end_word", "ref_start", "ref_end", "n_same"]


def _pair_passages(a, b, s, e, rs, number, ends, more, min_words: int, identity: float):
    """Passages of two word runs along their chains (segments in order, and the chain of each, the best
    first; ends gives what was found at a chain's ends); None if one may go on beyond the runs: more tells
    for the starts of both and for the ends of both whether their texts do. A chain whose segments lie in
    the alignments of better ones is left out."""
    out, done = set(), np.zeros(len(s), dtype=bool)
    begins = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    for c, (i, j) in enumerate(zip(begins.tolist(), [*begins[1:].tolist(), len(s)], strict=True)):
        if done[i:j].all():
            continue
        x, y, same, at_start, at_end = _columns(a, b, list(zip(s[i:j].tolist(), e[i:j].tolist(), rs[i:j].tolist(), strict=True)), ends(c))
        here = alike(x[:-1], y[:-1], same, min_words, identity)
        if any(m and t for m, t in zip(more, (*at_start, *at_end), strict=True)) and (here or same.sum() >= MARGIN):
            return None
        out.update(here)
        at = np.searchsorted(x, s, side="right") - 1
        done |= (at >= 0) & (x[at] == s) & (y[at] == rs)
    return sorted(out)


def _run_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of a column of word runs, and the start and length of each run."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    words = np.frombuffer(data, dtype=np.uint32) if data is not None and data.size else np.zeros(1, np.uint32)
    return words, offsets[:-1], np.diff(offsets)


def _aligned(min_words: int, identity: float):
    """Passages of pairs; of a pair whose pieces of text turn out too short just one row without places."""
    margin, band = max(MARGIN, min_words + WINDOW + K), 16

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            a, a_at, a_n = _run_words(batch.column("a"))
            b, b_at, b_n = _run_words(batch.column("b"))
            a0, b0, na, nb, doc, ref = (batch.column(c).to_numpy() for c in ("a0", "b0", "na", "nb", "doc", "ref"))
            sizes = pc.list_value_length(batch.column("s")).to_numpy().astype(np.int64)
            pair = np.repeat(np.arange(len(sizes)), sizes)
            s, e, rs, re, number = (batch.column(c).flatten().to_numpy() for c in ("s", "e", "rs", "re", "chain"))
            s, e, rs, re = s - a0[pair], e - a0[pair], rs - b0[pair], re - b0[pair]
            # chains
            new = np.concatenate(([True], (pair[1:] != pair[:-1]) | (number[1:] != number[:-1])))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(s)) - 1
            of = pair[first]
            left = np.minimum(margin, s[first])
            size = np.minimum(e[last] + margin, a_n[of]) - (s[first] - left)
            keep = promising(a, b, a_at[of] + s[first] - left, size, rs[first] - left, b_at[of], b_n[of], band, min_words, identity)
            keep |= e[last] - s[first] != re[last] - rs[first]
            first, last, of = first[keep], last[keep], of[keep]
            more = np.stack((a0 > 0, b0 > 0, a0 + a_n < na, b0 + b_n < nb), axis=1)
            agree, ended, ends = _followed(a, b, s[first], rs[first], e[last], re[last], a_at[of], a_n[of], b_at[of], b_n[of])
            # of one segment: whether enough words agree for a passage, or for one that goes on beyond the pieces
            agree += e[first] - s[first]
            fit = (first < last) | (agree >= identity * min_words - 1e-9) | ((agree >= MARGIN) & (more[of] & ended).any(axis=1))
            out = []
            at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else of
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(of)], strict=True) if len(of) else ():
                while hi > lo and not fit[hi - 1]:  # those before may hold what better ones leave out
                    hi -= 1
                if hi == lo:
                    continue
                i = of[lo]
                x = np.concatenate([np.arange(u, v + 1) for u, v in zip(first[lo:hi].tolist(), last[lo:hi].tolist(), strict=True)])
                here = _pair_passages(
                    a[a_at[i] : a_at[i] + a_n[i]], b[b_at[i] : b_at[i] + b_n[i]], s[x], e[x], rs[x], number[x],
                    lambda c, lo=lo: ends(lo + c), more[i].tolist(), min_words, identity,
                )
                if here is None:
                    out.append((doc[i], ref[i], *[None] * 5))
                for p, q, rp, rq, same in here or []:
                    if doc[i] != ref[i] or p + a0[i] > rp + b0[i]:
                        out.append((doc[i], ref[i], a0[i] + p, a0[i] + q, b0[i] + rp, b0[i] + rq, same))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array([None if v is None else int(v) for v in c], pa.int64()) for c in cols], _FOUND)

    return run


def passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """(doc_id, ref_id, start_word, end_word, ref_start, ref_end, n_same): passages of docs(doc_id,
    text) that repeat in another row, each with the place in the row that had it first (the smaller
    id); a row's own places of first occurrence aren't reported. Ends are exclusive.

    Words are runs of digits, letters and all beyond ASCII; A-Z count as a-z. doc_id is a bigint and
    must be unique and not null: see `unique_ids` for tables where it isn't. Null and empty texts and
    texts of fewer than K words have no passages. Other columns are ignored."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    bits = spark.sparkContext.broadcast(_live_seeds(docs))
    drop()  # the seeds' shuffle
    marked = cut(docs.transform(arrow_map, _marked_rows(bits, min_words), "seed long, span0 long, span1 long, doc long, pos int, before int"))
    bits.unpersist()

    # the first text that has a seed; no more than that of seeds that one text has
    held = marked.where("seed IS NOT NULL")
    first = held.where("before IS NULL").groupBy("seed").agg(F.min("doc").alias("ref"), F.max("doc").alias("last"), F.min_by("pos", "doc").alias("rpos"), F.count("*").alias("texts"))
    linked = held.join(first.where("ref < last").drop("last"), "seed")
    # where two texts have a seed, its words go on alike in no other
    linked = cut(linked.select(*(F.when(F.col("texts") > 2, F.col(c)).alias(c) for c in ("span0", "span1")), "doc", "pos", "ref", "rpos"))
    own = cut(marked.where("before >= 0").select("doc", F.col("doc").alias("ref"), "pos", F.col("before").alias("rpos")))
    drop(marked)
    pairs = [linked.where("doc > ref").select("doc", "ref", "pos", "rpos"), own]
    for span in ("span0", "span1"):
        rows = linked.where(F.col(span).isNotNull())
        # of texts with the same span, whose seeds have the same reference, only where that goes on otherwise
        others = rows.groupBy(span).agg(F.min("doc").alias("near"), F.max("doc").alias("last"), F.min_by("pos", "doc").alias("at"), F.first("ref").alias("r"))
        others = others.where("near < last AND near > r").select(span, "near", "at")
        pairs.append(rows.join(others, span).where("doc > near").select("doc", F.col("near").alias("ref"), "pos", F.col("at").alias("rpos")))
    anchors = pairs[0].unionAll(pairs[1]).unionAll(pairs[2]).unionAll(pairs[3])
    chains = cut(
        anchors.repartition("doc")
        .sortWithinPartitions("doc", "ref")
        .transform(arrow_map, _chain_rows, "doc long, ref long, s array<long>, e array<long>, rs array<long>, re array<long>, chain array<long>")
    )
    drop(linked, own)

    def aligned(chains, margin, among=docs):
        def texts(rows, column):
            asked = spark.sparkContext.broadcast(bitmap(chains, column))
            return rows.select("doc_id", "text", row_slot("doc_id").alias("slot")).transform(arrow_map, _word_rows(asked), "doc long, words binary")

        def side(start, end, name):
            begin = F.greatest(F.array_min(start) - margin, F.lit(0)).cast("int")
            piece = F.substring(F.col("words"), begin * 4 + 1, ((F.array_max(end) + margin) * 4).cast("int") - begin * 4)
            return begin.cast("long").alias(f"{name}0"), (F.octet_length("words") / 4).cast("long").alias(f"n{name}"), piece.alias(name)

        one = ["doc", "ref", "s", "e", "rs", "re", "chain"]
        # a reference of many texts is dealt to several tasks
        salts = chains.groupBy("ref").count().where(F.col("count") > HOT).select("ref", F.ceil(F.col("count") / HOT).cast("int").alias("salts"))
        dealt = chains.join(salts, "ref", "left").withColumn("salt", F.pmod(F.xxhash64("doc"), F.coalesce("salts", F.lit(1))).cast("int"))
        spread = texts(docs, "ref").toDF("ref", "words").join(salts, "ref", "left")
        spread = spread.select("ref", "words", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        sides = dealt.join(texts(among, "doc"), "doc").select(*one, "salt", *side("s", "e", "a"))
        sides = sides.join(spread, ["ref", "salt"]).select(*one, "a0", "na", "a", *side("rs", "re", "b"))
        return sides.transform(arrow_map, _aligned(min_words, identity), ", ".join(f"{c} long" for c in _FOUND))

    def part(rows, column, i):  # other bits than salts and bitmaps take
        return rows.where(F.pmod(F.shiftright(F.xxhash64(column), 40), F.lit(SLICES)) == i)

    parts = []
    for i in range(SLICES):
        parts.append(cut(aligned(part(chains, "doc", i), max(MARGIN, min_words + WINDOW + K), part(docs, "doc_id", i))))
        drop()  # what the slice has shuffled
    found = reduce(DataFrame.unionAll, parts)
    far = found.where("start_word IS NULL").select(F.col("doc_id").alias("doc"), F.col("ref_id").alias("ref"))
    again = cut(chains.join(far, ["doc", "ref"], "left_semi"))
    drop(chains)
    return found.where("start_word IS NOT NULL").unionAll(aligned(again, 1 << 26)).distinct()


def repeated_passages(docs: DataFrame) -> DataFrame:
    """passages() for any docs(doc_id, text): rows with the same or a null id are rows of their own,
    whose passages carry the ids as they are (a repeated row's reference may have its own id)."""
    rows, plain, row = unique_ids(docs.select("doc_id", "text"))
    found = passages(rows.select(F.col(row).alias("doc_id"), "text"))
    if plain:
        return found
    names = rows.select(row, F.col("doc_id").alias("name"))
    return (
        found.join(names.toDF("doc_id", "own"), "doc_id")
        .join(names.toDF("ref_id", "other"), "ref_id")
        .select(F.col("own").alias("doc_id"), F.col("other").alias("ref_id"), "start_word", "end_word", "ref_start", "ref_end", "n_same")
    )


def _without(held: str):
    """Texts less the spans in column `held` (arrays of start and end words), which reach to the start of the
    next word; without that column."""

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            spans = batch.column(batch.schema.get_field_index(held))
            texts = column.to_pylist()
            for i in range(len(batch)):
                cuts = spans[i].as_py()
                if cuts and texts[i]:
                    data, offsets = vec.text_bytes(column.slice(i, 1))
                    starts, _, counts = vec.words(data, offsets, vec.ALNUM)
                    edges = np.concatenate((starts, [len(data)]))
                    keep = np.ones(len(data), dtype=bool)
                    for x in cuts:
                        keep[edges[min(x["start_word"], counts[0])] : edges[min(x["end_word"], counts[0])]] = False
                    texts[i] = data[keep].tobytes().decode("utf-8", "ignore")
            arrays = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(j) for j, f in enumerate(batch.schema)]
            kept = [j for j, f in enumerate(batch.schema) if f.name != held]
            yield pa.RecordBatch.from_arrays([arrays[j] for j in kept], [batch.schema.field(j).name for j in kept])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage cut out except where it stands first; n_chars, if docs has it,
    follows. Rows of which no word is left go; null and empty texts and those that had no word stay as they
    are. Of repeated rows the first keeps its text; long texts are cut like others; an empty table stays
    empty. Columns are those of docs, whatever they are called."""
    rows, _, row = unique_ids(docs)
    held, was_cut = free(docs, "__spans"), free(docs, "__cut")
    found = passages(rows.select(F.col(row).alias("doc_id"), "text"))
    spans = found.groupBy(F.col("doc_id").alias(row)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(held))
    joined = rows.join(spans, row, "left")
    schema = joined.drop(held).schema
    out = joined.select(*schema.names, held).transform(arrow_map, _without(held), schema)
    some = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")) > 0
    cut_rows = spans.select(row, F.lit(True).alias(was_cut))
    out = out.join(cut_rows, row, "left").where(F.col(was_cut).isNull() | some)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(was_cut), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
