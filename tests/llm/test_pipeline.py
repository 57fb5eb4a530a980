import random

from brute import alnum_words, contamination, jaccard_components

import corpus_pipeline
from sparkloom.llm import queries
from sparkloom.llm.substring_dedup import repeated_passages


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)

    def sentence(n):
        return " ".join(f"wort{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}{rng.choice('uvwxyz')}{rng.choice('abcdefgh')}{rng.randrange(9)}" for _ in range(n))

    passage, item = sentence(70), sentence(40)
    docs = [(i, sentence(120)) for i in range(20)]
    docs += [(20, docs[3][1]), (21, docs[4][1].replace("a", "b", 2)), (22, None), (23, "12 34"), (24, f"{sentence(50)} {passage}"), (25, f"{passage} {sentence(60)}"), (26, f"{sentence(30)} {item} {sentence(20)}")]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    state, columns = spark.read.parquet(f"{d}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in state.collect()]
        out = stage(spark, state, d)
        if name != "packing":
            assert out.columns == state.columns
        out.write.parquet(f"{d}/{name}")
        state = spark.read.parquet(f"{d}/{name}")
        got = {r["doc_id"] for r in state.collect()}
        if name == "language_id":
            assert got == {i for i, t in rows if any(c.isalpha() for c in t or "")}
        elif name == "jaccard_join":
            assert got == {i for i, _, c in jaccard_components(rows, 5, 80, 100) if i == c}
        elif name == "substring_dedup":
            assert got == {i for i, _ in rows}
            texts = {r["doc_id"]: r["text"] for r in state.collect()}
            assert passage in texts[24] and len(alnum_words(texts[25])) == 60
            assert repeated_passages(state).count() == 0
        elif name == "decontaminate":
            assert got == {i for i, n, hit, _ in contamination(rows, [(1, item)]) if not hit or 20 * hit < n}
        else:
            assert got == {i for i, _ in rows}
        columns = state.columns
    assert columns[0] == "doc_id"
    assert corpus_pipeline.run(spark, d).count() == state.count()


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]


def test_stages_leave_columns_of_any_name_alone(spark):
    from sparkloom.llm.decontaminate import keep_clean
    from sparkloom.llm.jaccard_join import keep_one
    from sparkloom.llm.substring_dedup import remove_repeats

    passage = " ".join(f"word{i}" for i in range(70))
    rows = [(1, f"one {passage} {' '.join(f'own{i}' for i in range(60))}", 77, "a", "b", 5), (2, f"{' '.join(f'other{i}' for i in range(60))} {passage}", 88, "c", "d", 6), (3, None, 99, None, None, None), (4, "", 11, "e", "f", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row int, __spans string, __CUT string, __row_ int")
    items = spark.createDataFrame([(1, "nothing of it")], "item_id long, text string")
    for stage in (keep_one, lambda x: keep_clean(x, items), remove_repeats):
        out = stage(docs)
        assert out.columns == docs.columns
        assert {(r["doc_id"], r["__row"], r["__spans"], r["__CUT"], r["__row_"]) for r in out.collect()} == {(i, n, s, c, m) for i, _, n, s, c, m in rows}
        repeated = stage(docs.unionAll(docs.where("doc_id = 4")))
        assert repeated.columns == docs.columns and {r["__row"] for r in repeated.collect()} == {77, 88, 99, 11}
        assert stage(docs.limit(0)).collect() == []
