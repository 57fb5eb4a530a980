import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sparkloom.llm.periodic_runs import digests, find_runs, looped, recurrence, runs_of, z_function


def brute_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, times * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    drop = {j for s, m, q in runs for j in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    text = " ".join(w for j, w in enumerate(words) if j not in drop)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_z_function_counts_agreement_with_the_start():
    rnd = random.Random(3)
    for _ in range(300):
        s = [rnd.randrange(2) for _ in range(rnd.randrange(1, 20))]
        z = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert z_function(s, len(s)) == z and z_function(s, 1 + len(s) // 2) == z[: 1 + len(s) // 2]


def test_runs_equal_those_found_by_trying_every_period():
    rnd = random.Random(1)
    for _ in range(3000):
        n, k = rnd.randint(0, 70), rnd.choice([1, 2, 3, 5, 30])
        x = [rnd.randrange(k) for _ in range(n)]
        if rnd.random() < 0.6 and n > 8:
            a, p = rnd.randrange(n), rnd.randint(1, 9)
            x = [x[i] if i < a else x[min(n - 1, a + (i - a) % p)] for i in range(n)]
            if rnd.random() < 0.5:
                x[rnd.randrange(n)] = 99
        least, times = rnd.choice([(6, 4), (6, 4), (4, 2), (5, 3), (2, 2)])
        ids = np.array(x, dtype=np.int64)
        assert runs_of(ids, recurrence(ids), least, times) == brute_runs(x, least, times), (x, least, times)


def test_query_columns_equal_the_plain_version(spark):
    rnd = random.Random(5)
    pool = [f"w{i}" for i in range(40)] + ["A", "a", "é", "　", "\x1c", " "]
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \t\n "), (4, "a b " * 9), (4, "a b " * 9), (5, "x " * 3000), (6, "A a A a a a a a a a")]
    for i in range(10, 160):
        words = [rnd.choice(pool) for _ in range(rnd.randrange(1, 120))]
        if i % 3 == 0:
            at = rnd.randrange(len(words))
            words[at:at] = words[at : at + 3] * rnd.randrange(3, 7)
        rows.append((i, rnd.choice([" ", "\n", " \r\n"]).join(words)))
    rows.append((500, " ".join(f"v{i % 700}" for i in range(6000))))
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id long, text string, runs string, n_words int")
    got = digests(find_runs(docs.select("doc_id", looped(docs["doc_id"], docs["text"]).alias("text"), "runs", "n_words"))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute_row(*r)) for r in rows)


def test_whole_table_equals_the_plain_version(spark):
    from sparkloom.llm.queries import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries()["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    assert got[0].asDict().keys() == {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}
    short = {tuple(r) for r in docs if len(r["text"] or "") < 20000}
    want = {repr(brute_row(*r)) for r in short}
    ids = {r[0] for r in short}
    assert {repr(tuple(r)) for r in got if r["doc_id"] in ids} == want and len(got) == len(docs)


def test_empty_table_and_bounds(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert find_runs(none).collect() == [] and find_runs(none).columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert find_runs(spark.createDataFrame([(1, "a b a b")], "doc_id long, text string"), 4, 2).first()["collapsed"] == "a b"
    with pytest.raises(ValueError):
        find_runs(none, 6, 1)
