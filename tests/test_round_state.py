"""Rounds as stream state: one notice across a restart, a timer for trainings that tell nothing, the same as step() by step."""

import json
import random
import time

from quarrymill.operators import rounds
from quarrymill.streaming import round_state


def run(spark, src, out, mark, patience=0, wait=None):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", round_state.PROVIDER)
    events = spark.readStream.schema(round_state.EVENTS).json(str(src))
    query = round_state.actions(events, patience).writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(mark)).outputMode("append")
    if wait is None:
        query.trigger(availableNow=True).start().awaitTermination(240)
    else:
        q = query.trigger(processingTime="1 second").start()
        until = time.time() + 90
        while time.time() < until and not wait():
            time.sleep(1)
        q.stop()
    return [tuple(r) for r in spark.read.schema(round_state.ACTIONS).json(str(out)).select("project", "event", "action").collect()] if out.exists() else []


def put(src, name, events):
    src.mkdir(exist_ok=True)
    (src / f".{name}").write_text("\n".join(json.dumps({"project": p, "event": e, "ts": f"2024-01-01T00:{k // 60:02d}:{k % 60:02d}"}) for p, e, k in events))
    (src / f".{name}").rename(src / f"{name}.json")


def test_one_notice_across_a_restart(spark, tmp_path):
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    put(src, "1", [("a", "training_started", 1), ("a", "quota_met", 2), ("b", "quota_met", 2)])
    assert sorted(run(spark, src, out, mark)) == [("a", "quota_met", "notice"), ("a", "training_started", "nothing"), ("b", "quota_met", "setup")]
    put(src, "2", [("a", "quota_met", 3), ("b", "quota_met", 3)])
    put(src, "3", [("a", "training_succeeded", 4), ("a", "quota_met", 5)])
    got = run(spark, src, out, mark)
    assert [x for x in got if x[2] == "notice"] == [("a", "quota_met", "notice")]
    assert sorted(got)[:1] + [x for x in got if x[1] == "training_succeeded"] == [("a", "quota_met", "nothing"), ("a", "training_succeeded", "setup")]
    assert sorted(x[2] for x in got if x[:2] == ("a", "quota_met")) == ["nothing", "notice", "setup"]  # armed again


def test_equal_to_steps(spark, tmp_path):
    rng = random.Random(6)
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    events = [(rng.choice("abc"), rng.choice(["quota_met", "training_started", "training_succeeded", "training_failed", "training_step"]), k) for k in range(120)]
    want, states = [], {}
    for p, e, _ in events:
        if e != "training_step":
            states[p], action = rounds.step(states.get(p, rounds.RoundState()), e)
            want.append((p, e, action))
    for k in range(0, 120, 40):
        put(src, str(k), events[k : k + 40])
        got = run(spark, src, out, mark)
    assert sorted(got) == sorted(want)


def test_silent_trainings_fail(spark, tmp_path):
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    put(src, "1", [("a", "training_started", 1), ("a", "quota_met", 2)])
    seen = lambda: out.exists() and any("training_failed" in f.read_text() for f in out.glob("*.json"))
    got = run(spark, src, out, mark, patience=2000, wait=seen)
    assert got.count(("a", "training_failed", "nothing")) == 1 and ("a", "quota_met", "notice") in got
