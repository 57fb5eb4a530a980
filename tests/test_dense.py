import numpy as np

from sparkloom.operators import dense


def test_nearest_equal_a_plain_product(spark, monkeypatch):
    monkeypatch.setattr(dense, "ROWS", 7)
    monkeypatch.setattr(dense, "QUERIES", 3)
    rng = np.random.default_rng(5)
    m = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties, some zeros
    m[:3] = 0
    rows = spark.createDataFrame([(f"r{i:02}", v.tolist()) for i, v in enumerate(m)] + [("null", None), ("short", [1.0]), ("hole", [1.0, None, 1.0, 1.0])], "id string, vector array<double>")
    queries = spark.createDataFrame([(f"r{i:02}", m[i].tolist()) for i in range(0, 60, 5)] + [("none", None)], "query_id string, vector array<double>")
    size = np.linalg.norm(m, axis=1)
    unit = np.divide(m, size[:, None], out=np.zeros_like(m), where=size[:, None] > 0)
    for itself in (False, True):
        got = {}
        for r in dense.nearest(rows, queries, 6, but_self=itself).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
        assert len(got) == 12
        for i in range(0, 60, 5):
            score = np.round(unit @ unit[i], 9)
            order = sorted((-s, f"r{j:02}") for j, s in enumerate(score) if not (itself and j == i))[:6]
            assert [got[f"r{i:02}"][k + 1] for k in range(6)] == [(name, -s) for s, name in order]


def test_nearest_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, vector array<float>")
    assert dense.nearest(none, none.withColumnRenamed("id", "query_id"), 3).collect() == []


def test_banded_pairs_are_those_that_planes_leave(spark):
    rng = np.random.default_rng(5)
    m, planes = rng.standard_normal((60, 8)), rng.standard_normal((2, 6, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    queries = rows.where("id < 9").withColumnRenamed("id", "query_id")
    signs = np.einsum("bpd,nd->nbp", planes, m) > 0
    near = ((signs[:, None] != signs[None]).sum(axis=3) <= 1).any(axis=2)
    got = {(r["query_id"], r["id"]) for r in dense.nearest(rows, queries, 60, but_self=True, planes=planes).collect()}
    assert got == {(q, i) for q in range(9) for i in range(60) if q != i and near[q, i]} and len(got) > 9
    assert dense.nearest(rows, queries, 3, planes=planes[:, :, :7]).count() == 0
