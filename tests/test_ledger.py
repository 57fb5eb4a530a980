import datetime as dt
import glob

from sparkloom.plans import lifecycle
from sparkloom.streaming.ledger import OUTCOME, outcomes, step

TTL = 100


def play(*requests):
    state, out = None, []
    for op, owner, fingerprint, at in requests:
        state, outcome, result = step(state, op, owner, fingerprint, f"r{at}", at, TTL)
        out.append((outcome, result))
    return out


def test_steps_of_a_call():
    assert play(("reserve", "a", "f", 0), ("reserve", "b", "f", 1), ("reserve", "b", "g", 2), ("complete", "b", "f", 3), ("complete", "a", "f", 4), ("reserve", "b", "f", 500), ("reserve", "b", "g", 501)) == [
        ("reserved", None), ("in_progress", None), ("conflict", None), ("ownership_lost", None), ("completed", "r4"), ("completed", "r4"), ("conflict", None)]
    assert play(("reserve", "a", "f", 0), ("reserve", "b", "f", 99), ("reserve", "b", "f", 100), ("complete", "a", "f", 101)) == [("reserved", None), ("in_progress", None), ("indeterminate", None), ("ownership_lost", None)]
    assert play(("complete", "a", "f", 0), ("give_up", "a", "f", 0), ("reserve", "a", "f", 1), ("give_up", "b", "f", 2), ("give_up", "a", "f", 3), ("reserve", "a", "f", 4)) == [
        ("ownership_lost", None), ("ignored", None), ("reserved", None), ("ignored", None), ("indeterminate", None), ("indeterminate", None)]


def test_reservations_expire_as_time_goes_on_and_state_outlives_a_restart(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = "tool string, call_key string, seq long, op string, owner string, fingerprint string, result string, at long, ts timestamp"

    def batch(*rows):
        data = [("t", key, seq, op, owner, "f", "done", int((base.timestamp() + s) * 1e6), base + dt.timedelta(seconds=s)) for key, seq, op, owner, s in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = outcomes(stream, 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination()

    batch(("k1", 1, "reserve", "a", 0), ("k2", 2, "reserve", "a", 1))
    batch(("k2", 3, "complete", "a", 5), ("k3", 4, "reserve", "a", 200))
    batch(("k1", 5, "reserve", "b", 300), ("k2", 6, "reserve", "b", 300))
    got = {(r["call_key"], r["seq"], r["outcome"], r["result"]) for r in spark.read.schema(OUTCOME).parquet(str(tmp_path / "out")).collect()}
    assert {("k1", 1, "reserved", None), ("k2", 2, "reserved", None), ("k2", 3, "completed", "done"), ("k3", 4, "reserved", None), ("k1", 5, "indeterminate", None), ("k2", 6, "completed", "done"), ("k1", None, "expired", None)} <= got
    assert not any(key == "k2" and outcome == "expired" for key, _, outcome, _ in got)


def test_a_batch_is_written_by_many_tasks_and_taken_at_once(spark, tmp_path, monkeypatch):
    rows = [(i, dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=7 * i), i % 3, "view", 50.0 + i % 2, '{"k": 7}') for i in range(800)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.repartition(6).write.parquet(str(tmp_path / "in/events.parquet"))
    monkeypatch.setattr(lifecycle, "scratch", lambda _: str(tmp_path / "work"))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    try:
        got = {r["seq"]: (r["outcome"], r["result"]) for r in lifecycle.idempotency_ledger(spark, str(tmp_path / "in")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    states, wanted = {}, {}
    for i, ts, user, _, value, _ in rows:
        op = {3: "complete", 6: "complete", 7: "give_up"}.get(i % 8, "reserve")
        states[user], *told = step(states.get(user), op, f"w{str(value > 50).lower()}", "f", f"r{i}", int(ts.timestamp() * 1e6), 86_400_000_000)
        wanted[i] = tuple(told)
    assert got == wanted
    assert len(glob.glob(str(tmp_path / "work/requests/*.parquet"))) == 24
    assert len(glob.glob(str(tmp_path / "work/checkpoint/sources/0/[0-9]*"))) == 4
