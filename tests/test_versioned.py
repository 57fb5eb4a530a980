import pytest
from pyspark.sql import functions as F

from sparkloom.sources.versioned import Conflict, Store, committing, longest

CHUNKS = "source string, version string, text string"


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", "source", 4)
    s.replace(*given(spark, [("a", "v1", "one"), ("a", "v1", "two"), ("b", "v1", "bee")]))
    return s


def given(spark, chunks, entities=()):
    c = spark.createDataFrame(chunks, CHUNKS)
    e = spark.createDataFrame(list(entities), "source string, name string, description string")
    return c.select("source").distinct(), {"chunks": c, "entities": e}


def test_a_version_replaces_its_sources_rows_and_no_others(spark, store):
    before = store.state()
    old = store.read("chunks", before)
    store.replace(*given(spark, [("a", "v2", "new")], [("a", "Alpha", "x")]))
    assert rows(store.read("chunks"), "source", "version", "text") == [("a", "v2", "new"), ("b", "v1", "bee")]
    # who has opened a state goes on seeing all of it, in every table
    assert rows(old, "source", "version") == [("a", "v1"), ("a", "v1"), ("b", "v1")] and store.read("entities", before).count() == 0
    store.replace(spark.createDataFrame([("b",)], "source string"), {"chunks": spark.createDataFrame([], CHUNKS)})
    assert rows(store.read("chunks"), "source") == [("a",)]


def test_what_fails_before_the_swap_changes_nothing(spark, store):
    def fail():
        raise OSError("lost")

    with pytest.raises(OSError):
        store.replace(*given(spark, [("a", "v2", "new")]), before_publish=fail)
    assert rows(store.read("chunks"), "version") == [("v1",)] * 3 and store.state().number == 1
    assert any(name.startswith("data/") for name in store.sweep()) and store.read("chunks").count() == 3


def test_of_two_commits_on_one_state_the_second_is_refused(spark, store):
    def other():
        store.replace(*given(spark, [("b", "v9", "first")]))

    with pytest.raises(Conflict):
        store.replace(*given(spark, [("a", "v2", "second")]), before_publish=other)
    assert rows(store.read("chunks"), "version") == [("v1",), ("v1",), ("v9",)]


def test_a_batch_counts_once(spark, store):
    run = committing(store, "chunks", "s1")
    for batch, version in ((0, "v2"), (0, "v3"), (1, "v4"), (0, "v5")):
        run(spark.createDataFrame([("a", version, "x")], CHUNKS), batch)
    assert rows(store.read("chunks").where("source = 'a'"), "version") == [("v4",)]
    committing(store, "chunks", "s2")(spark.createDataFrame([("a", "v6", "x")], CHUNKS), 0)
    assert rows(store.read("chunks").where("source = 'a'"), "version") == [("v6",)]


def test_entities_keep_the_longer_description(spark, tmp_path):
    s = Store(spark, str(tmp_path), "name", 2)
    schema = "name string, description string, source string"
    for part in ([("A", "short", "s1"), ("B", None, "s1")], [("A", "much longer", "s2"), ("B", "b", "s2")], [("A", "x", "s3"), ("C", None, "s3")]):
        df = spark.createDataFrame(part, schema)
        s.replace(df.select("name"), {"entities": df}, merge={"entities": longest(["name"], "description")})
    assert {r["name"]: (r["description"], r["source"]) for r in s.read("entities").collect()} == {"A": ("much longer", "s2"), "B": ("b", "s2"), "C": (None, "s3")}


def test_old_states_go_with_what_only_they_name(spark, store):
    for v in ("v2", "v3", "v4"):
        store.replace(*given(spark, [("a", v, "x")]))
    gone = store.sweep(keep=1)
    assert sum(n.startswith("manifests/") for n in gone) == 3 and rows(store.read("chunks"), "version") == [("v1",), ("v4",)]
    assert Store(spark, store.path + "-none", "source").state().number == 0
