import json

import pytest

from sparkloom.sources import backup
from sparkloom.sources.parsing import SCANNED, ParseFile, parsed, parsed_files
from sparkloom.sources.spans import SpanSink

FILES = [
    ("a/x.txt", b"# Head\n\npara one\r\nline\n\n\n\na | b\nc | d"), ("b.csv", b"n,v\na,1\n\"b, c\",2,3"), ("c.HTML", b"<h1>T</h1><p>b <b>c</b><script>x</script><ul><li>d"),
    ("scan.json", b'{"pages":[{"text":"one\\n\\ntwo"},{"text":""},{"blocks":[{"text":" "}]}]}'), ("full.json", b'{"pages":[{"text":"one"},{"blocks":[{"kind":"table","text":"a|b"}]}]}'),
    ("bad.json", b"[1"), ("d.pdf", b"%PDF"), ("gone.txt", None), ("noext", "hé".encode("utf-16")), ("gb.md", "漢字".encode("gb18030")), ("empty.txt", b""),
]


def test_one_function_parses_by_suffix_and_warns(spark):
    got = {}
    for r in parsed(spark.createDataFrame(FILES, "path string, content binary")).collect():
        got.setdefault(r["path"], []).append(r)
    shown = {p: [(r["kind"], r["text"], r["locator"]) for r in rs if r["kind"]] for p, rs in got.items()}
    assert shown["a/x.txt"] == [("heading", "# Head", "block:1"), ("paragraph", "para one\nline", "block:2"), ("table", "a | b\nc | d", "block:3")]
    assert shown["b.csv"] == [("table_row", "n=a | v=1", "row:2"), ("table_row", "n=b, c | v=2 | column_3=3", "row:3")]
    assert [x[:2] for x in shown["c.HTML"]] == [("heading", "T"), ("paragraph", "b c"), ("list_item", "d")]
    assert shown["noext"][0][1] == "hé" and shown["gb.md"][0][1] == "漢字" and shown["empty.txt"] == []
    warnings = {p: {r["warning"] for r in rs if r["warning"]} for p, rs in got.items()}
    assert {p: w for p, w in warnings.items() if w} == {"scan.json": {SCANNED}, "bad.json": {"invalid_layout"}, "d.pdf": {"unsupported:.pdf"}, "gone.txt": {"no_content"}}
    assert [(r["page"], r["page_count"], r["empty_pages"]) for r in got["scan.json"] if r["kind"]] == [(1, 3, 2), (1, 3, 2)] and got["full.json"][-1]["kind"] == "table"


def test_the_schema_follows_a_constant_argument(spark):
    spark.udtf.register("parse_file", ParseFile)
    spark.createDataFrame(FILES, "path string, content binary").createOrReplaceTempView("files_in")
    rows = spark.sql("SELECT f.path, p.* FROM files_in f, LATERAL parse_file(f.content, f.path, true) p")
    assert rows.columns[-1] == "encoding" and {r["path"]: r["encoding"] for r in rows.collect()}["gb.md"] == "gb18030"
    with pytest.raises(Exception, match="binary content"):
        spark.sql("SELECT * FROM parse_file('a', 'b')").collect()


def test_files_of_a_folder(spark, tmp_path):
    for name, data in FILES[:3]:
        (tmp_path / name.replace("/", "_")).write_bytes(data)
    assert parsed_files(spark, str(tmp_path)).where("kind IS NOT NULL").count() == 8


def spans(folder):
    return [[json.loads(line) for line in f.read_text().splitlines()] for f in sorted(folder.glob("span-*.jsonl"))]


def test_spans_round_trip_rotate_and_expire(spark, tmp_path):
    spark.dataSource.register(SpanSink)
    out = tmp_path / "spans"
    df = spark.range(100).selectExpr("id", "concat('span é ', id) AS name", "map('k', id) AS attributes").coalesce(1)
    df.write.format("spans").option("path", str(out)).option("maxBytes", 1 << 20).mode("append").save()
    (rows,) = spans(out)
    assert [r["id"] for r in rows] == list(range(100)) and rows[7] == {"attributes": {"k": 7}, "id": 7, "name": "span é 7"}
    df.write.format("spans").option("path", str(out)).option("maxBytes", 1000).option("keep", 5).mode("append").save()
    files = spans(out)
    assert len(files) == 5 and files[-1][-1]["id"] == 99 and all(f.stat().st_size <= 1000 for f in out.glob("span-*.jsonl"))
    assert [r["id"] for f in files for r in f] == list(range(100 - sum(map(len, files)), 100)) and not list(out.glob(".part-*"))


def test_spans_of_a_failed_write_are_not_there(spark, tmp_path):
    spark.dataSource.register(SpanSink)
    out = tmp_path / "spans"
    with pytest.raises(Exception, match="boom"):
        spark.range(5).selectExpr("IF(id = 4, raise_error('boom'), id) AS x").coalesce(1).write.format("spans").option("path", str(out)).mode("append").save()
    assert spans(out) == []


def test_spans_of_a_stream(spark, tmp_path):
    spark.dataSource.register(SpanSink)
    for i in range(2):
        spark.range(i * 3, i * 3 + 3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("spans").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for f in spans(tmp_path / "out") for r in f) == list(range(6))


@pytest.fixture
def copy(spark, tmp_path):
    src = tmp_path / "src"
    (src / "deep" / "er").mkdir(parents=True)
    (src / "a.bin").write_bytes(b"x" * 3_000_000)
    (src / "deep" / "b.txt").write_text("bee")
    (src / "deep" / "er" / ".hidden").write_text("")
    backup.backup(spark, str(src), str(tmp_path / "copy"))
    return tmp_path / "copy"


def test_a_copy_is_whole_and_comes_back(spark, copy, tmp_path):
    assert backup.verify(spark, str(copy)).collect() == [] and backup.manifest(spark, str(copy)).count() == 3
    assert backup.restore(spark, str(copy), str(tmp_path / "back")) == 3
    assert (tmp_path / "back" / "a.bin").read_bytes() == b"x" * 3_000_000 and (tmp_path / "back" / "deep" / "er" / ".hidden").exists()
    for again in (lambda: backup.backup(spark, str(tmp_path / "src"), str(copy)), lambda: backup.restore(spark, str(copy), str(tmp_path / "back"))):
        with pytest.raises(FileExistsError):
            again()
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(("copy.", "back."))]


@pytest.mark.parametrize(("change", "error"), [
    (lambda f: (f / "deep" / "b.txt").unlink(), "missing"), (lambda f: (f / "new.txt").write_text("n"), "unexpected"),
    (lambda f: (f / "deep" / "b.txt").write_text("bees"), "size_mismatch"), (lambda f: (f / "deep" / "b.txt").write_text("bef"), "hash_mismatch"),
])
def test_a_damaged_copy_is_refused(spark, copy, tmp_path, change, error):
    change(copy / "files")
    assert [r["error"] for r in backup.verify(spark, str(copy)).collect()] == [error]
    with pytest.raises(backup.Damaged, match=error):
        backup.restore(spark, str(copy), str(tmp_path / "back"))
    assert not (tmp_path / "back").exists()
