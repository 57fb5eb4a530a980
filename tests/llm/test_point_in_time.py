import datetime as dt
import random

import duckdb
import pytest

from sparkloom.llm import point_in_time
from sparkloom.llm.point_in_time import cents, features, micros
from sparkloom.llm.queries import FEATURES_SQL, queries

NAMES = ("clicks", "sales", "sale_lines")
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def equal(spark, folder, files):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{files}'")
    out = con.execute(FEATURES_SQL)
    columns, want = [d[0] for d in out.description], out.fetchall()
    got = queries()["op13_point_in_time"](spark, str(folder))
    assert sorted(got.columns) == sorted(columns)
    got = got.select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    return got


@pytest.mark.parametrize("hot", [20_000, 15])
def test_features_equal_sql(spark, monkeypatch, hot):
    monkeypatch.setattr(point_in_time, "HOT", hot)
    assert equal(spark, "/root/testdata/sf0.001", "")


@pytest.mark.parametrize("hot", [20_000, 3])
def test_nulls_ties_repeats_and_bounds(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(point_in_time, "HOT", hot)
    rnd, base = random.Random(7), dt.datetime(2024, 1, 1)

    def maybe(x, share=0.1):
        return None if rnd.random() < share else x

    def moment(days):
        return base + dt.timedelta(hours=rnd.randrange(days * 8) * 3)

    clicks = [(maybe(rnd.randrange(30)), maybe(t := moment(12)), maybe(t + dt.timedelta(hours=rnd.choice([-9, 0, 1, 47, 400]))), maybe(rnd.randrange(4)), maybe(rnd.choice(["purchase", "view"])), maybe(rnd.choice([1.005, -2.5, 0.0, float("nan"), float("inf")])), "{}") for _ in range(150)]
    clicks += clicks[:40]
    sales = [(i % 70, maybe(rnd.randrange(4)), "x", maybe(rnd.random() * 100), maybe(t := moment(25)), maybe(t + dt.timedelta(hours=rnd.choice([0, 2, 50, 400]))), 1) for i in range(90)]
    lines = [(maybe(rnd.randrange(75)), 1, maybe(rnd.randrange(3)), 1, 1, maybe(rnd.random() * 50), 0.0, "f", maybe(moment(40))) for _ in range(300)]
    lines += lines[:30]
    for name, rows, schema in (("clicks", clicks, CLICKS), ("sales", sales, SALES), ("sale_lines", lines, LINES)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = equal(spark, tmp_path, "/*.parquet")
    assert any(r["label"] for r in got) and any(r["n_items"] < r["n_lines"] for r in got) and any(r["n_clicks"] for r in got)


def test_empty_tables_and_probes_without_time_or_client(spark):
    clicks, sales, lines = (spark.createDataFrame([], s + ", chunk long, probe int, label string, hot boolean") for s in (CLICKS, SALES, LINES))
    probes = spark.createDataFrame([(1, 5, None), (2, None, 9), (3, 6, 10)], "sale_id long, client_id long, time long")
    got = sorted(map(tuple, features(clicks, sales, lines, probes).collect()), key=repr)
    zero = (False, 0, 0, 0, None, 0, 0, 0, 0, 0)
    assert got == [(1, 14, None, *zero), (1, 2, None, *zero), (3, 14, 10, *zero), (3, 2, 10, *zero)]
    assert features(clicks, sales, lines, probes.limit(0)).collect() == []


def test_micros_and_cents_do_not_depend_on_the_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 0, 7), 1.005), (dt.datetime(1969, 12, 31, 23, 59, 59, 999999), float("nan")), (None, None)], "t timestamp_ntz, x double")
        got = [tuple(r) for r in df.select(micros(df, "t"), cents(df["x"])).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(1710037800000007, 100), (-1, 0), (None, 0)]
