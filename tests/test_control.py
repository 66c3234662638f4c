"""Control replay against a sequential model."""

import json
import random
from datetime import datetime, timedelta

import pytest

from fleetskein.operators import control

START = datetime(2024, 1, 1)
SCHEMA = "msg_id long, node_id string, payload string, received_at timestamp_ntz"


def sequential(messages):
    """Messages of (msg_id, node, payload object, time) one by one."""
    until, outcomes = {}, {}
    for msg_id, node, p, at in sorted(messages, key=lambda m: (m[3], m[0])):
        runner, action = p.get("runner", ""), p.get("action", "") or "start"
        key = (node, runner)
        active = key in until and at < until[key]
        if not runner or action not in ("start", "abort"):
            outcomes[msg_id] = "invalid"
        elif action == "abort":
            outcomes[msg_id] = "aborted" if active else "abort_ignored"
            until.pop(key, None)
        elif runner == "unknown":
            outcomes[msg_id] = "unknown_runner"
        elif active:
            outcomes[msg_id] = "duplicate_ignored"
        else:
            duration = p.get("params", {}).get("duration_sec", 60)
            until[key] = at + timedelta(seconds=int(duration) if not isinstance(duration, str) else 60)
            outcomes[msg_id] = "started"
    return outcomes


def random_log(seed, nodes, size):
    rng = random.Random(seed)
    log = []
    for msg_id in range(size):
        p = {"action": rng.choice(["start"] * 12 + ["", "abort", "pause"]), "runner": rng.choice(["benchmark"] * 8 + ["soak", "unknown", ""])}
        if rng.random() < 0.9:
            p["params"] = {"duration_sec": rng.choice([0, -5, 30, 90.7, 300, 4000, 20000, "7"])}
        log.append((msg_id, f"n{rng.randint(1, nodes)}", p, START + timedelta(seconds=rng.randint(0, 200_000))))
    return log


def frame(spark, log):
    return spark.createDataFrame([(i, n, json.dumps(p), t) for i, n, p, t in log], SCHEMA)


@pytest.mark.parametrize("seed", [2_000, 3])
def test_random_logs(spark, seed):
    log = random_log(seed, 8, 1500)
    got = control.replay(frame(spark, log), ["benchmark", "soak"], 3600).collect()
    assert len(got) == len(log)
    assert {r["msg_id"]: r["outcome"] for r in got} == sequential(log)


def test_one_busy_key_without_aborts(spark):
    """A stretch that never ends is replayed by links alone."""
    rng = random.Random(9)
    log = [
        (i, "n", {"action": "start", "runner": "benchmark", "params": {"duration_sec": rng.randint(1, 50)}},
         START + timedelta(seconds=rng.randint(0, 9000)))
        for i in range(1200)
    ]
    got = control.replay(frame(spark, log), ["benchmark"], 600).collect()
    assert {r["msg_id"]: r["outcome"] for r in got} == sequential(log)


def test_hand_made(spark):
    def start(seconds=None):
        return {"runner": "benchmark", "params": {} if seconds is None else {"duration_sec": seconds}}

    abort = {"runner": "benchmark", "action": "abort"}
    log = [
        (1, "n", abort, START),
        (2, "n", start(10), START + timedelta(seconds=1)),
        (3, "n", start(10), START + timedelta(seconds=10.999)),
        (4, "n", start(), START + timedelta(seconds=11)),
        (5, "n", start(5), START + timedelta(seconds=70.9)),
        (6, "n", abort, START + timedelta(seconds=70.95)),
        (7, "n", abort, START + timedelta(seconds=70.95)),
        (8, "n", {"runner": "unknown", "action": "abort"}, START),
        (9, "n", {"runner": "unknown"}, START),
        (10, "n", start(1.9), START + timedelta(seconds=100)),
        (11, "n", start(1), START + timedelta(seconds=101)),
    ]
    got = control.replay(frame(spark, log), ["benchmark"]).collect()
    assert {r["msg_id"]: r["outcome"] for r in got} == {
        1: "abort_ignored", 2: "started", 3: "duplicate_ignored", 4: "started", 5: "duplicate_ignored", 6: "aborted",
        7: "abort_ignored", 8: "abort_ignored", 9: "unknown_runner", 10: "started", 11: "started",
    }


def test_validation(spark):
    texts = {
        1: '{"runner":"r"', 2: "[]", 3: "null", 4: '{"runner":5}', 5: '{"runner":"r","action":"pause"}',
        6: '{"runner":"r","params":7}', 7: '{"runner":"r"} x', 8: '{"runner":"r","action":"","params":{"duration_sec":"9"}}', 9: "",
    }
    df = spark.createDataFrame([(i, "n", p, START) for i, p in texts.items()], SCHEMA)
    got = {r["msg_id"]: (r["error"], r["action"], r["duration_sec"]) for r in control.parse(df).collect()}
    assert {i: e for i, (e, _, _) in got.items()} == {
        1: "invalid envelope", 2: "invalid envelope", 3: "missing runner execution name", 4: "invalid envelope",
        5: "invalid action: pause", 6: "invalid envelope", 7: "invalid envelope", 8: None, 9: "invalid envelope",
    }
    assert got[8][1:] == ("start", 60)


def test_durations_out_of_range_are_held_within_the_longest(spark):
    """No message fails the replay; the run of the first start outlasts the second, a negative one ends at once."""
    payload = '{"runner":"benchmark","params":{"duration_sec":%s}}'
    sent = [("a", "1e12"), ("a", "5"), ("b", "1e300"), ("b", "5"), ("c", "-1e15"), ("c", "5"), ("d", "1000000000000000")]
    rows = [(i, node, payload % d, START + timedelta(seconds=i)) for i, (node, d) in enumerate(sent)]
    got = {r["msg_id"]: r["outcome"] for r in control.replay(spark.createDataFrame(rows, SCHEMA), ["benchmark"]).collect()}
    assert got == dict(enumerate(["started", "duplicate_ignored"] * 2 + ["started", "started", "started"]))
