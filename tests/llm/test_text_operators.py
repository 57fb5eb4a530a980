import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from brute import alnum_words, contamination, jaccard_components, shingle_set

from sparkloom.llm import decontaminate, jaccard_join, licenses, substring_dedup, vec
from sparkloom.llm.components import components
from sparkloom.llm.store import unique_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k1 long, spans string, w string, row int, label string"


def frame(spark, rows):
    """Rows (doc_id, text) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9.0, 7, "x", "y", 3, "z") for i, t in rows], SCHEMA)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def mutated(rng, text, share):
    return " ".join(f"m{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


ODD = [(None, None), (None, "null id text of a few words"), (1, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (4, "one two"), (5, "???")]


def test_sets_match_plain_shingles():
    texts = ["", "a", "a b", "A a A a", None, "x y z x y z", "é É ß 漢字 漢字", "tab\tand\nline\x0bfeed"] + [sentence(random.Random(i), 50, 5) for i in range(5)]
    for k in (1, 3, 5):
        sizes = np.concatenate([s for *_, s in vec.shingle_sets(pa.array(texts), k)])
        assert sizes.tolist() == [len(shingle_set(t, k)) for t in texts]


def test_components_are_those_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(30)}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, k, num):
    rng = random.Random(k)
    rows = list(ODD)
    for group in range(6):
        base = sentence(rng, rng.choice([6, 30, 120, 400]), 60 if group % 2 else 5000)
        rows += [(100 * (group + 1) + j, mutated(rng, base, rng.choice([0, 0, 0.01, 0.03, 0.05]))) for j in range(14)]
    rows += [(900, "Exact COPY of words"), (901, "exact copy OF words"), (902, "word " * 3000)]
    got = jaccard_join.jaccard_components(frame(spark, rows), k, num, 100).collect()
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    want = jaccard_components(rows, k, num, 100)
    # a row of several with one id is told apart by its set size
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)


def test_late_links_of_a_large_group_are_found(spark):
    """Copies of one text that its centre does not reach: links between any two must still be found."""
    rng = random.Random(2)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for j in range(60):
        w = list(base)
        for p in rng.sample(range(200), 3 if j else 0):
            w[p] = f"x{j}_{p}"
        rows.append((j, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame(spark, rows), 3, 90, 100).collect()}
    assert got == {a: c for a, _, c in jaccard_components(rows, 3, 90, 100)}


def test_a_line_in_all_texts_does_not_bring_them_together(spark, monkeypatch):
    """Rows of meetings follow the texts that are alike, not those that hold a common notice."""
    rng, met, real = random.Random(11), [], jaccard_join.cut

    def counted(df, *more):
        out = real(df, *more)
        met.extend([out.count()] * ("sig" in out.columns))
        return out

    monkeypatch.setattr(jaccard_join, "cut", counted)
    notice = sentence(rng, 60, 10**6)
    rows = [(i, f"{notice} {sentence(rng, 40, 10**6)}") for i in range(500)]
    rows += [(1000 + i, rows[i][1] + " and more") for i in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame(spark, rows), 5, 80, 100).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert len(met) == 2 and sum(met) < len(rows)


@pytest.mark.parametrize("num", [50, 80, 90])
def test_similar_texts_meet_whatever_the_order_of_tokens(num):
    rng, every = random.Random(num), SimpleNamespace(value=np.full(1 << 18, -1))
    levels = SimpleNamespace(value=np.random.default_rng(num).integers(0, 3, 1 << jaccard_join.COUNTERS).astype(np.uint8))
    texts = [sentence(rng, rng.choice([1, 2, 5, 9, 30, 200]), 300) for _ in range(40)]
    texts += [mutated(rng, t, rng.choice([0.02, 0.05, 0.2])) for t in texts for _ in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0] * len(texts)), pa.array([False] * len(texts))], ["text", "slot", "nameless"])
    sets = {int(key[0]): shingle_set(t, 1) for t in texts for *_, key in jaccard_join._sets(pa.RecordBatch.from_arrays([pa.array([t])], ["text"]), 1)}
    sigs = {key: set() for key in sets}
    for out in jaccard_join._route_rows(1, num, 100, every, levels)([batch]):
        for sig, key in zip(*(c.to_pylist() for c in out.columns), strict=True):
            sigs[key].add(sig)
    alike = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    assert len(alike) > 10 and all(sigs[a] & sigs[b] for a, b in alike)


def test_tree_search_never_loses_a_pair_that_the_bound_allows():
    rng = np.random.default_rng(4)
    points = rng.poisson(0.8, (700, 128)).astype(np.int32)
    points[1::2] = np.maximum(points[::2] + rng.integers(-1, 2, points[::2].shape) * (rng.random(points[::2].shape) < 0.1), 0)
    sizes = points.sum(1).astype(np.int64)
    shared = np.minimum(points[:, None], points[None]).sum(2)
    want = 100 * shared >= 80 * (sizes[:, None] + sizes - shared)
    tree, part = jaccard_join.RTree(points, sizes), jaccard_join.RTree(points[:90], sizes[:90])
    own = {(min(i, j), max(i, j)) for i, found in tree.join(tree, 80, 100) for j in found.tolist()}
    assert own == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True) if i <= j}
    assert {(i, j) for i, found in part.join(tree, 80, 100) for j in found.tolist()} == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(want[:90])), strict=True)}


def test_points_fold_to_fewer_groups_and_bound_what_is_shared():
    rng = np.random.default_rng(5)
    for n, m in ((3, 5), (40, 47), (700, 880), (5000, 6000)):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 2**63, m - n // 2, dtype=np.uint64))))
        points = jaccard_join._points(pa.array([jaccard_join.point_of(x).tobytes() for x in (a, b)]))
        assert points.sum(1).tolist() == [len(a), len(b)]
        assert np.minimum(*points).sum() >= len(np.intersect1d(a, b))


def test_near_copies_leave_one(spark):
    rng = random.Random(5)
    base = sentence(rng, 150, 9000)
    rows = [(9, base), (4, mutated(rng, base, 0.01)), (30, sentence(rng, 80, 9000)), (31, None), (32, "")]
    out = jaccard_join.keep_one(frame(spark, rows))
    assert sorted(r["doc_id"] for r in out.collect()) == [4, 30, 31, 32]
    assert out.columns == frame(spark, []).columns


def test_contamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, n, 3000)) for i, n in enumerate([40, 13, 14, 12, 5, 1, 30])] + [(50, None), (51, "?!"), (None, sentence(rng, 20, 3000))]
    items += [(60, items[0][1]), (61, items[4][1].upper())]
    docs = list(ODD) + [(100 + i, sentence(rng, 60, 3000)) for i in range(5)]
    for i, (_, text) in enumerate(items[:7]):
        docs.append((200 + i, f"{sentence(rng, 30, 3000)}, {text.upper()}! {sentence(rng, 20, 3000)}"))
        docs.append((300 + i, " ".join(text.split(" ")[: len(text.split(" ")) - 1]) + " tail"))
    docs += [(400, items[0][1] + " " + items[6][1]), (401, " ".join([items[1][1]] * 4)), (402, sentence(rng, 4000, 3000) + " " + items[0][1])]
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for key, n, hit, names in contamination(docs, [x for x in items if x[0] is not None]):
        want.append((key, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * hit >= n))
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_one_passage_in_all_items_and_texts(spark):
    rng = random.Random(16)
    passage = sentence(rng, 30, 3000)
    items = [(i, f"{passage} {sentence(rng, 5, 3000)}") for i in range(60)]
    docs = [(i, f"{sentence(rng, 20, 3000)} {passage} {sentence(rng, i % 3, 10**6)}x") for i in range(80)] + [(100, items[7][1])]
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    every = hashlib.sha256(",".join(sorted(str(i) for i, _ in items)).encode()).hexdigest()
    assert {r["doc_id"] for r in got if r["n_items"] == 60 and r["items_sha256"] == every and r["contaminated"]} == {d for d, _ in docs}
    assert {r["n_hit"] for r in got if r["doc_id"] < 100} == {30}


def test_license_scan_finds_whole_and_near_whole_notices(spark):
    rng = random.Random(7)
    notice = licenses.TEMPLATES["Apache-2.0-notice"]
    broken = notice.split(" ")
    broken[5] = "changed"
    docs = list(ODD) + [
        (10, f"{sentence(rng, 37)}\n{licenses.TEMPLATES['MIT']}\n{sentence(rng, 50)}"),
        (11, f"{sentence(rng, 301)} {notice} {sentence(rng, 10)}"),
        (12, f"{sentence(rng, 5)} {' '.join(broken)}"),
        (13, sentence(rng, 500)),
        (14, "licensed under the apache license"),
        (15, licenses.TEMPLATES["GPL-3.0"].upper() + " " + licenses.TEMPLATES["CC-BY-NC-4.0"]),
    ]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(frame(spark, docs)).collect()}
    want = {}
    texts = {k: alnum_words(v) for k, v in licenses.TEMPLATES.items()}
    for key, text in docs:
        w = alnum_words(text)
        have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for name, t in texts.items():
            need = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            if len(need & have) >= 0.8 * len(need):
                want[key, name] = len(need & have) / len(need)
    assert {k: r["containment"] for k, r in got.items()} == pytest.approx(want)
    assert (got[10, "MIT"]["start_word"], got[10, "MIT"]["end_word"]) == (37, 42)


def test_bands_promise_what_they_say():
    for width in (1, 2, 4, 8, 16, 64, 256):
        assert 1 <= licenses.bands(width) <= 40
    assert [licenses.size_class(n)[0] for n in (1, 2, 3, 4, 7, 8)] == [1, 2, 4, 4, 8, 16]


def test_winnowing_keeps_a_seed_in_every_window():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 5, 11, 12, 13, 200])
    values = rng.integers(0, 50, counts.sum()).astype(np.uint64)
    rows, places, seeds = substring_dedup.winnow(values, counts, 12)
    begin = np.cumsum(counts) - counts
    for r, n in enumerate(counts):
        at = places[rows == r]
        assert all(values[begin[r] + p] == s for p, s in zip(at, seeds[rows == r], strict=True))
        for w in range(max(1, n - 11) if n else 0):
            assert ((at >= w) & (at < w + 12)).any()


def test_chain_joins_ordered_segments_over_a_gap():
    pos = np.array([0, 5, 10, 30, 36, 100])
    rpos = np.array([50, 55, 60, 83, 89, 5])
    chains = substring_dedup.chain(pos, rpos)
    assert (0, 44, 50, 97) in [c[:4] for c in chains]
    assert (100, 108, 5, 13) in [c[:4] for c in chains]


def test_alignment_bridges_changes_and_gaps():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 10**6, 80).astype(np.uint32)
    b = np.concatenate((a[:30], [1, 2, 3], a[30:50], a[52:])).astype(np.uint32)
    for links in ([(10, 16, 10)], [(10, 16, 10), (70, 76, 71)], [(60, 66, 61)]):
        x, y, same, at_start, at_end = substring_dedup._columns(a, b, links)
        assert substring_dedup.alike(x[:-1], y[:-1], same, 50, 0.8) == [(0, 80, 0, 81, 78)], links
        assert at_start == [True, True] and at_end == [True, True]


def test_ends_followed_together_equal_those_followed_alone():
    rng = np.random.default_rng(5)
    for words, lanes in ((3, 40), (12, 60), (10**6, 60), (12, 0)):
        a = rng.integers(0, words, 4000).astype(np.uint32)
        b = np.concatenate((a[:1500], rng.integers(0, words, 7), a[1500:])).astype(np.uint32)
        b[rng.choice(len(b), 600, replace=False)] = 10**7
        for step in (1, -1):
            i, na, nb = rng.integers(1000, 3000, lanes), rng.integers(0, 1000, lanes), rng.integers(0, 1000, lanes)
            j = i + rng.integers(0, 2, lanes) * 7
            (lane, p, q, n), agree, ended = substring_dedup.onward_all(a, b, i, na, j, nb, step)
            for k in range(lanes):
                mine, other = a[i[k] :][: na[k]], b[j[k] :][: nb[k]]
                if step < 0:
                    mine, other = a[i[k] - na[k] + 1 : i[k] + 1][::-1], b[j[k] - nb[k] + 1 : j[k] + 1][::-1]
                pieces, *ends = substring_dedup.onward(mine, other)
                at = lane == k
                assert list(zip(p[at], q[at], n[at], strict=True)) == [(u, v, len(hit)) for u, v, hit in pieces]
                assert (agree[k], ended[k].tolist()) == (sum(hit.sum() for *_, hit in pieces), ends)


@pytest.mark.parametrize("words", [12, 10**6])
def test_chains_without_enough_words_are_not_aligned_one_by_one(monkeypatch, words):
    rng, n, aligned = np.random.default_rng(6), 50, []
    columns = substring_dedup._columns
    monkeypatch.setattr(substring_dedup, "_columns", lambda *x: aligned.append(1) or columns(*x))
    runs = rng.integers(0, words, (2, n, 300)).astype(np.uint32)
    runs[1, :, 100:106] = runs[0, :, 100:106]
    runs[1, 0] = runs[0, 0]
    for first, want in ((0, [(0, 1000, 0, 300, 0, 300, 300)]), (1, [])):
        ids, place = np.arange(first, n), pa.array([[100]] * (n - first), pa.list_(pa.int64()))
        end, none, size = pa.array([[106]] * (n - first), pa.list_(pa.int64())), pa.array(0 * ids), pa.array(0 * ids + 300)
        a, b = (pa.array([r.tobytes() for r in side[first:]], pa.binary()) for side in runs)
        columns_of = {"doc": pa.array(ids), "ref": pa.array(ids + 1000), "s": place, "e": end, "rs": place, "re": end, "chain": pa.array([[0]] * (n - first), pa.list_(pa.int64()))}
        columns_of |= {"a0": none, "na": size, "a": a, "b0": none, "nb": size, "b": b}
        out = pa.Table.from_batches(substring_dedup._aligned(50, 0.8)([pa.RecordBatch.from_pydict(columns_of)]))
        assert [tuple(r.values()) for r in out.to_pylist()] == want
    assert len(aligned) == 1


def test_seeds_of_several_places_are_marked(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PACKED", 50)
    rng = random.Random(31)
    texts = [sentence(rng, n, 10**6) for n in (40, 80, 5, 30)]
    texts += [texts[0], f"{texts[3]} {texts[3]}", ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    seeds, counts = np.unique(np.concatenate([s for *_, (_, _, s) in substring_dedup._winnowed([batch])]), return_counts=True)
    slots = seeds & np.uint64((1 << substring_dedup.BITS) - 1)
    bits = substring_dedup._live_seeds(frame(spark, list(enumerate(texts))).select("doc_id", "text"))
    assert substring_dedup.in_bitmap(bits, slots.astype(np.int64)).tolist() == (counts > 1).tolist()
    assert sum(int(x).bit_count() for x in bits.view(np.uint64)) == (counts > 1).sum() > 0


def test_bound_by_neighbours_loses_no_passage():
    rng = np.random.default_rng(3)
    runs, others, first, rfirst, diagonal, want = [], [], [], [], [], []
    for _ in range(200):
        a = rng.integers(0, 40, 150).astype(np.uint32)
        b = rng.integers(0, 40, 150).astype(np.uint32)
        if rng.random() < 0.5:
            b[60:110] = a[60:110]
            b[60 + rng.choice(50, rng.integers(5, 30), replace=False)] += np.uint32(1000)
        plain = np.zeros(150, dtype=bool)
        for d in range(-16, 17):
            same = np.array([0 <= i + d < 150 and a[i] | 2 == b[i + d] | 2 for i in range(150)])
            plain[1:] |= same[1:] & same[:-1]
            plain[:-1] |= same[1:] & same[:-1]
        want.append(any(plain[i:j].sum() - 0.4 * (j - i) >= -1 - 1e-9 for i in range(101) for j in range(i + 50, 151)))
        runs.append(a), others.append(b), first.append(150 * len(first)), rfirst.append(150 * len(rfirst)), diagonal.append(0)
    n = np.full(200, 150)
    got = substring_dedup.promising(np.concatenate(runs), np.concatenate(others), np.array(first), n, np.array(diagonal), np.array(rfirst), n, 16, 50, 0.8)
    assert got.tolist() == want and 20 < sum(want) < 180


def test_repeats_inside_a_text_and_parts_of_a_passage_in_earlier_texts(spark):
    rng = random.Random(21)
    words = sentence(rng, 70, 10**6).split(" ")
    docs = [(1, " ".join(words[:38])), (2, " ".join(words[-38:])), (5, " ".join(words)), (9, f"{sentence(rng, 30, 10**6)} {' '.join(words)}")]
    own = sentence(rng, 70, 10**6)
    docs += [(20, f"{own} {sentence(rng, 20, 10**6)} {own}"), (21, "line of eight words that comes on and " * 100)]
    found = {(r["doc_id"], r["ref_id"], r["start_word"], r["end_word"]) for r in substring_dedup.repeated_passages(frame(spark, docs)).collect()}
    assert found == {(9, 5, 30, 100), (20, 20, 90, 160), (21, 21, 8, 800)}
    left = {r["doc_id"]: alnum_words(r["text"]) for r in substring_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert len(left[20]) == 90 and len(left[21]) == 8 and len(left[9]) == 30


def test_exact_passages_equal_brute_force(spark):
    """Texts made of shared and own stretches: every word in a run of 53 words that another place has
    before is reported, and no word that no run of 50 words at 0.8 can hold."""
    rng = random.Random(22)
    pool = [sentence(rng, n, 10**6).split(" ") for n in (30, 55, 80, 120, 200)]
    texts = [sum((rng.choice(pool)[rng.choice([0, 0, 10]) :] if rng.random() < 0.5 else sentence(rng, 25, 10**6).split(" ") for _ in range(6)), []) for _ in range(40)]
    found = {}
    for r in substring_dedup.repeated_passages(frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        part, other = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["ref_id"]][r["ref_start"] : r["ref_end"]]
        assert len(set(part) & set(other)) >= 0.6 * len(set(part))
    seen = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - 52):
            run = tuple(t[at : at + 53])
            if seen.setdefault(run, (i, at)) != (i, at):
                assert found.get(i, set()) >= set(range(at, at + 53)), (i, at)


def test_passages_that_repeat_are_found_and_cut_out(spark):
    rng = random.Random(8)
    shared = sentence(rng, 60, 10**6)
    docs = [(i, f"{sentence(rng, 70, 10**6)}. {shared}. {sentence(rng, 40, 10**6)}") for i in range(12)]
    docs += [(50, mutated(rng, shared, 0.06)), (60, sentence(rng, 300, 10**6)), (61, " ".join(shared.split(" ")[:30])), (62, shared.upper())]
    found = substring_dedup.repeated_passages(frame(spark, docs)).collect()
    by = {r["doc_id"]: r for r in found}
    assert set(by) == {*range(1, 12), 50, 62} and all(r["ref_id"] == 0 for r in found)
    assert all((by[i]["start_word"], by[i]["end_word"]) == (70, 130) for i in range(1, 12))
    out = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert set(out) == {*range(12), 60, 61} | ({50} if 50 in out else set())
    assert shared in out[0]["text"] and all(len(alnum_words(out[i]["text"])) == 110 for i in range(1, 12))
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())


@pytest.mark.parametrize(("parts", "between"), [((200, 200), 150), ((60, 60), 100), ((300, 60, 200), 150)])
def test_all_passages_of_a_chain_are_found(spark, parts, between):
    rng = random.Random(11)
    shared = [sentence(rng, n, 10**6) for n in parts]
    texts, at = [], []
    for _ in range(2):
        words = []
        for text in shared:
            words += sentence(rng, between, 10**6).split(" ")
            at.append((len(words), len(words) + len(text.split(" "))))
            words += text.split(" ")
        texts.append(" ".join(words))
    found = substring_dedup.repeated_passages(frame(spark, [(0, texts[0]), (1, texts[1])])).collect()
    assert sorted((r["start_word"], r["end_word"]) for r in found) == at[len(parts) :]


def test_passages_whose_parts_stand_in_earlier_texts_are_found(spark):
    rng = random.Random(12)
    words = sentence(rng, 60, 10**6).split(" ")

    def text(part):
        return f"{sentence(rng, 70, 10**6)} {' '.join(part)} {sentence(rng, 40, 10**6)}"

    for earlier in ([words[:45]], [words[:45], words[15:]]):
        docs = [(i, text(part)) for i, part in enumerate([*earlier, words, words])]
        found = substring_dedup.repeated_passages(frame(spark, docs)).collect()
        last, at = len(docs) - 1, {(r["doc_id"], r["ref_id"]): (r["start_word"], r["end_word"]) for r in found}
        assert at == {(last, last - 1): (70, 130)}


def test_changed_passages_reach_the_recall_that_is_stated(spark):
    rng = random.Random(13)
    docs, asked = [], {}
    for n in (50, 80):
        for share in (0.8, 0.85, 0.9, 0.95):
            for _ in range(15):
                words = sentence(rng, n, 10**6).split(" ")
                other = list(words)
                for i in rng.sample(range(1, n - 1), round(n * (1 - share))):
                    other[i] = f"m{rng.randrange(10**6)}"
                pair = len(docs)
                docs += [(pair + j, f"{sentence(rng, 30, 10**6)} {' '.join(x)} {sentence(rng, 30, 10**6)}") for j, x in enumerate((words, other))]
                asked[pair + 1] = share
    found = {r["doc_id"] for r in substring_dedup.repeated_passages(frame(spark, docs)).collect()}
    assert found <= set(asked)
    for share in (0.8, 0.85, 0.9, 0.95):
        of = [d for d, s in asked.items() if s == share]
        assert sum(d in found for d in of) >= 0.9 * len(of), (share, sum(d in found for d in of), len(of))


def test_texts_are_aligned_in_slices(spark, monkeypatch):
    rng = random.Random(21)
    texts = [sentence(rng, 80, 5000) for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(texts + texts)]
    slices, cut = [], substring_dedup.cut

    def noted(df):
        if df.columns == substring_dedup._FOUND:
            slices.append({r["doc_id"] for r in df.collect()})
        return cut(df)

    monkeypatch.setattr(substring_dedup, "cut", noted)
    found = {(r["doc_id"], r["ref_id"]) for r in substring_dedup.repeated_passages(frame(spark, docs)).collect()}
    assert found == {(i + 12, i) for i in range(12)}
    assert len(slices) > 1 and all(slices) and sum(map(len, slices)) == 12


def test_odd_rows_have_no_passages(spark):
    rng = random.Random(9)
    text = sentence(rng, 80, 10**6)
    rows = [*ODD, (7, text), (7, text), (8, "x" * 300_000)]
    assert len(substring_dedup.repeated_passages(frame(spark, rows)).collect()) == 1  # the repeated row, once
    kept = substring_dedup.remove_repeats(frame(spark, rows))
    assert kept.count() == len(rows) - 1 and kept.columns == frame(spark, []).columns


def test_empty_tables(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.jaccard_components(none).count() == 0
    assert jaccard_join.keep_one(none).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert [tuple(r)[1:4] for r in decontaminate.contamination(frame(spark, [(1, "a b")]), items).collect()] == [(2, 0, 0)]
    assert licenses.scan(none).count() == 0
    assert licenses.scan(frame(spark, [(1, "a b")]), spark.createDataFrame([], "license string, text string")).count() == 0
    assert substring_dedup.repeated_passages(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0


def test_rows_get_ids_of_their_own_only_if_needed(spark):
    assert unique_ids(frame(spark, [(1, "a"), (2, "b")]))[1]
    rows, plain, row = unique_ids(frame(spark, [(2, "a"), (2, "b"), (None, "c"), (1, "d")]))
    got = [(r["text"], r[row]) for r in rows.orderBy(row).collect()]
    assert not plain and [t for t, _ in got][0] == "d" and [t for t, _ in got][-1] == "c" and len({i for _, i in got}) == 4
    assert zlib.crc32(b"1") % 5 in range(5)
