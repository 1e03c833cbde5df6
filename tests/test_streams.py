"""Event-time streams against the batch results: files in any order, late rows, restarts, bounded state."""

import json
import os
import random

from trialyst.streaming import live

BASE = 1_700_000_000
FAR = BASE + 10_000_000


def _write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def _ts(second):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(second, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def _run(stream, out, mark):
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(mark)).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(out))


def _calls(n, seed):
    rng = random.Random(seed)
    return [{"run_id": rng.choice([1, 1, 1, 2]), "seq": i, "ts": _ts(BASE + i // 3), "tokens": rng.randrange(9)} for i in range(n)]


def _want(calls, budget=50):
    used, out = {}, set()
    for c in sorted(calls, key=lambda c: (c["ts"], c["seq"])):
        used[c["run_id"]] = used.get(c["run_id"], 0) + c["tokens"]
        u = used[c["run_id"]]
        out.add((c["run_id"], c["seq"], c["tokens"], u, budget, u >= budget, u > budget, False))
    return out


CALL = "run_id bigint, seq bigint, ts timestamp, tokens bigint"


def test_files_in_the_wrong_order(spark, tmp_path):
    """Later calls arrive first; each file is a batch of its own."""
    calls = _calls(120, 1)
    rest = [calls[80:], calls[40:80], calls[:40]]
    random.Random(2).shuffle(rest[1])
    budgets = spark.createDataFrame([(1, 50), (2, 50)], "run_id bigint, budget bigint")

    def go():
        s = live.stream_trials(spark, str(tmp_path / "in"), CALL, per_trigger=1)
        return {tuple(r) for r in _run(live.stream_ledger(s, budgets, "10 minutes"), tmp_path / "out", tmp_path / "mark").collect()}

    for i, part in enumerate(rest):
        _write(tmp_path / "in", f"{i}.json", part)
        assert go() == set()  # all within the delay: nothing is settled, nothing is lost over restarts
    _write(tmp_path / "in", "end.json", [{"run_id": 2, "seq": 10**6, "ts": _ts(FAR), "tokens": 0}])
    assert go() == _want(calls)


def test_a_late_call_is_told(spark, tmp_path):
    budgets = spark.createDataFrame([(1, 10)], "run_id bigint, budget bigint")

    def go():
        s = live.stream_trials(spark, str(tmp_path / "in"), CALL, per_trigger=1)
        return sorted(tuple(r)[1:] for r in _run(live.stream_ledger(s, budgets, "1 minute"), tmp_path / "out", tmp_path / "mark").collect())

    _write(tmp_path / "in", "a.json", [{"run_id": 1, "seq": 2, "ts": _ts(BASE + 20), "tokens": 4}, {"run_id": 1, "seq": 1, "ts": _ts(BASE + 10), "tokens": 5}])
    _write(tmp_path / "in", "b.json", [{"run_id": 1, "seq": 9, "ts": _ts(BASE + 1000), "tokens": 1}])
    settled = [(1, 5, 5, 10, False, False, False), (2, 4, 9, 10, False, False, False)]
    assert go() == settled
    _write(tmp_path / "in", "c.json", [{"run_id": 1, "seq": 3, "ts": _ts(BASE + 30), "tokens": 2}])
    assert go() == [*settled, (3, 2, 11, 10, True, True, True)]
    _write(tmp_path / "in", "d.json", [{"run_id": 1, "seq": 99, "ts": _ts(FAR), "tokens": 0}])
    assert go() == [*settled, (3, 2, 11, 10, True, True, True), (9, 1, 12, 10, True, True, False)]


def test_copies_by_event_time(spark, tmp_path):
    """The earliest record of a key is first, whatever arrives first; copies and late copies come out with their status."""

    def go():
        s = live.stream_trials(spark, str(tmp_path / "in"), "k string, id bigint, ts timestamp", per_trigger=1)
        return sorted((r["k"], r["id"], r["status"]) for r in _run(live.stream_dedupe(s, ["k"], "ts", "1 minute", ["id"]), tmp_path / "out", tmp_path / "mark").collect())

    def put(name, *rows):
        _write(tmp_path / "in", name, [{"k": k, "id": i, "ts": _ts(BASE + at)} for k, i, at in rows])

    put("a.json", ("x", 2, 20), ("y", 5, 30), ("y", 4, 30))
    put("b.json", ("x", 1, 10), ("x", 3, 25))
    put("c.json", ("z", 9, 1000))
    first = [("x", 1, "first"), ("x", 2, "duplicate"), ("x", 3, "duplicate"), ("y", 4, "first"), ("y", 5, "duplicate")]
    assert go() == first
    put("d.json", ("x", 7, 40), ("w", 8, 15), ("x", 6, 1001))
    late = [("w", 8, "late"), ("x", 7, "late")]
    assert go() == sorted(first + late)
    put("e.json", ("end", 0, FAR - BASE))
    assert go() == sorted([*first, *late, ("z", 9, "first"), ("x", 6, "first")])  # the delay after x's first is over


def test_state_ends_with_the_delay(spark, tmp_path):
    rows = [{"k": f"k{i}", "id": i, "ts": _ts(BASE + i)} for i in range(300)]
    _write(tmp_path / "in", "a.json", rows)
    _write(tmp_path / "in", "b.json", [{"k": "end", "id": -1, "ts": _ts(FAR)}])
    s = live.stream_trials(spark, str(tmp_path / "in"), "k string, id bigint, ts timestamp", per_trigger=1)
    q = live.stream_dedupe(s, ["k"], "ts", "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark"))
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    left = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    assert spark.read.parquet(str(tmp_path / "out")).filter("status = 'first'").count() == 300
    assert max(left) >= 300 and left[-1] <= 62  # a minute of keys


def test_first_wins_store_stays_small(spark, tmp_path):
    """Files of a bucket are put together as they grow in number."""
    for b in range(12):
        _write(tmp_path / "in", f"{b:02d}.json", [{"run": r, "v": b} for r in range(40)] + [{"run": 1000 + b, "v": b}])
        os.utime(tmp_path / "in" / f"{b:02d}.json", (BASE + b, BASE + b))  # arrival order
    s = live.stream_trials(spark, str(tmp_path / "in"), "run bigint, v bigint", per_trigger=1)
    live.ingest_first(s, ["run"], ["v"], str(tmp_path / "store"), str(tmp_path / "mark"), buckets=2, most_files=3).awaitTermination()
    kept = {r["run"]: r["v"] for r in live.read_first(spark, str(tmp_path / "store")).collect()}
    assert kept == {**{r: 0 for r in range(40)}, **{1000 + b: b for b in range(12)}}
    current = live._current(spark.read.parquet(str(tmp_path / "store"))).select(live.BUCKET, live.BATCH).distinct().count()
    assert current <= 2 * (3 + 1)
    assert len(list((tmp_path / "store").glob("*/*"))) < 2 * 10  # of 24 additions and their copies


def test_keys_share_the_state_of_a_group(spark, tmp_path, monkeypatch):
    """Many keys with a few records each meet in a few pages, and each key still has its own first and its own total."""
    monkeypatch.setattr(live, "GROUPS", 4)
    _write(tmp_path / "in", "a.json", [{"k": f"k{i % 300}", "id": i, "ts": _ts(BASE + i // 300 * 40)} for i in range(900)])
    _write(tmp_path / "in", "b.json", [{"k": "end", "id": -1, "ts": _ts(FAR)}])
    s = live.stream_trials(spark, str(tmp_path / "in"), "k string, id bigint, ts timestamp", per_trigger=1)
    q = live.stream_dedupe(s, ["k"], "ts", "1 minute", ["id"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark"))
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) < 100
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("id", "status").collect()))
    assert got == [(i, "duplicate" if 300 <= i < 600 else "first") for i in range(900)]
    calls = [{"run_id": i % 50, "seq": i, "ts": _ts(BASE + i), "tokens": 1} for i in range(200)]
    _write(tmp_path / "calls", "a.json", calls)
    _write(tmp_path / "calls", "b.json", [{"run_id": 50, "seq": 999, "ts": _ts(FAR), "tokens": 0}])
    budgets = spark.range(51).selectExpr("id AS run_id", "50L AS budget")
    c = live.stream_trials(spark, str(tmp_path / "calls"), CALL)
    assert {tuple(r) for r in _run(live.stream_ledger(c, budgets), tmp_path / "told", tmp_path / "mark2").collect()} == _want(calls)
