import pytest
from pyspark.sql import functions as F

from sparkloom.sources import readers, sinks
from sparkloom.streaming import jobs


def test_encodings_in_turn(spark, tmp_path):
    for name, data in (("a.txt", "hé".encode("utf-8-sig")), ("b.txt", "漢字汉字".encode("gb18030"))):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "hé", "b.txt": "漢字汉字"} and readers.decode(None) is None and readers.decode(b"") == ""


def test_delimited_rows_become_blocks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('name,value\na,1\n"b, c",2,extra\n')
    got = [(r["locator"], r["block"]) for r in readers.read_delimited_blocks(spark, str(tmp_path)).orderBy("locator").collect()]
    assert got == [("row:2", "name=a | value=1"), ("row:3", "name=b, c | value=2 | column_3=extra")]


def test_json_lines_are_strict(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType().add("query_id", "string").add("n", "long")
    good, unknown, twice = tmp_path / "g.jsonl", tmp_path / "u.jsonl", tmp_path / "t.jsonl"
    good.write_text('{"query_id":"a","n":1}\n\n{"query_id":"b"}\n')
    unknown.write_text('{"query_id":"a","x":1}\n')
    twice.write_text('{"query_id":"a"}\n{"query_id":"a"}\n')
    assert readers.read_jsonl_strict(spark, str(good), schema, "query_id").count() == 2
    for path, what in ((unknown, "unknown fields: x"), (twice, "repeated query_id: a")):
        with pytest.raises(ValueError, match=what):
            readers.read_jsonl_strict(spark, str(path), schema, "query_id")


def test_admission_routes(spark):
    df = spark.createDataFrame([("a.TXT",), ("b.pdf",), ("c.doc",), ("d.exe",)], "path string")
    assert [r["route"] for r in readers.admission(df).orderBy("path").collect()] == ["text", "layout", "refused:legacy_format", "refused:unsupported"]


def test_html_blocks_in_order(spark):
    df = spark.createDataFrame([(1, "<h1>A</h1><script>x</script><p>b <b>c</b></p><ul><li>d"), (2, None)], "page_id long, html string")
    got = [(r["kind"], r["text"]) for r in readers.html_blocks(df, "page_id", "html").orderBy("pos").collect()]
    assert got == [("heading", "A"), ("paragraph", "b c"), ("list_item", "d")]


def test_sinks_upsert_delete_and_verify(spark):
    cur = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, sinks.upsert(cur, new, ["k"], [F.desc("v")]).select("k", "v").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert [r["k"] for r in sinks.delete(cur, new, ["k"]).collect()] == ["a"]
    m = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, "z", 1)], "id int, sha string, size int")
    a = spark.createDataFrame([(1, "x", 1), (2, "q", 1), (3, "zz", 2), (4, "w", 1)], "id int, sha string, size int")
    assert {r["id"]: r["error"] for r in sinks.verify_manifest(m, a, "id").collect()} == {2: "hash_mismatch", 3: "size_mismatch", 4: "unexpected"}
    known = spark.createDataFrame([], "sha string")
    assert sinks.new_artifacts(spark.createDataFrame([("x",), ("x",), ("y",)], "t string"), "t", known).count() == 2


def test_streams_reach_the_batch_result(spark, tmp_path):
    rows = [(1, i, "user", f"m{i}") for i in range(8)]
    path = str(tmp_path / "conv")
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(path)
    out = jobs.run_to_end(jobs.compacted(jobs.table_stream(spark, path, 1), 4, 1000), "update")
    last = out.orderBy(F.desc("seen")).first()
    assert (last["seen"], last["n_kept"]) == (8, 4) and last["summary"].count("\n") == 3
