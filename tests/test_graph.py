"""Lineage and artifacts against sequential models."""

import random
import re

import compare
import pytest
from pyspark.sql import functions as F

from fleetskein.operators import artifacts, lineage
from fleetskein.schemas import TRACES

EDGE = "source_id string, verb string, target_id string, node_id string, run_id string, meta string, event_timestamp timestamp"


def walk(edges, root, depth):
    """The recursive walk, edge set by edge set."""
    level = {e for e in edges if root in (e[0], e[1])}
    found = set(level)
    seen_levels = [level]
    for _ in range(depth - 1):
        level = {t for t in edges for e in level if t[0] == e[1] or t[1] == e[0]}
        found |= level
        if level in seen_levels[-2:]:
            break
        seen_levels.append(level)
    return found


def traces(spark, edges):
    rows = [(s, "v", t, None, None, "{}", None) for s, t in edges]
    return spark.createDataFrame(rows, EDGE)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_random_graphs(spark, depth):
    rng = random.Random(depth)
    edges, roots = [], []
    for g in range(40):
        vertices = [f"g{g}:{v}" for v in range(rng.randint(2, 9))]
        edges += [(rng.choice(vertices), rng.choice(vertices)) for _ in range(rng.randint(1, 14))]
        roots += rng.sample(vertices, 2)
    roots_df = spark.createDataFrame([(r,) for r in roots], "root_id string")
    found = lineage.lineage_edges_of_many(traces(spark, edges), roots_df, depth)
    got = {(r["root_id"], r["source_id"], r["target_id"]) for r in found.collect()}
    assert got == {(root, *e) for root in roots for e in walk(set(edges), root, depth)}


def test_hand_made_walks(spark):
    edges = [("root", "d"), ("x", "d"), ("d", "e"), ("e", "root"), ("s", "s"), ("far", "x")]
    all_edges = traces(spark, edges + [("root", "d")])

    def found(root, depth):
        return sorted((r["source_id"], r["target_id"]) for r in lineage.lineage_edges(all_edges, root, depth).collect())

    assert found("root", 1) == [("e", "root"), ("root", "d")]
    assert found("root", 2) == [("d", "e"), ("e", "root"), ("root", "d")]
    assert ("x", "d") in found("root", 3)
    assert found("s", 0) == [("s", "s")]
    assert found("nobody", -1) == []


@pytest.mark.parametrize("few", [0, 1000])
def test_rows_of_all_roots_come_once_and_are_not_shuffled_for_it(spark, monkeypatch, few):
    """Edges that are there twice, met at both ends, without an end, or by roots that are there twice."""
    monkeypatch.setattr(lineage, "FEW", few)
    edges = [("a", "b"), ("a", "b"), ("b", "a"), ("b", "b"), ("b", "c"), ("c", "d"), ("x", "c"), (None, "b"), ("c", None), ("far", "off")]
    table = traces(spark, edges)
    roots = spark.createDataFrame([("a",), ("a",), ("c",), (None,), ("none",)], "root_id string")
    named = {(s or "no source", t or "no target") for s, t in edges}
    for depth in (1, 2, 3, None):
        found = lineage.lineage_edges_of_many(table, roots, depth)
        got = sorted((r["root_id"], r["source_id"] or "no source", r["target_id"] or "no target") for r in found.collect())
        assert got == sorted((root, *e) for root in "ac" for e in walk(named, root, depth or 10))
        text = found._jdf.queryExecution().executedPlan().toString()
        assert few or not re.search(r"Aggregate\(keys=\[[^\]]*root_id", text)


def test_far_edges_do_not_reach_the_join(spark):
    many = spark.range(20_000).select(F.concat(F.lit("v"), "id").alias("source_id"), F.concat(F.lit("w"), "id").alias("target_id"))
    states = spark.createDataFrame([("r", "v7", "out"), ("r", "w9", "in"), ("r", None, "in")], "root_id string, vertex string, heading string")
    for heading, met in (("out", "v7"), ("in", "w9")):
        near = [r[lineage._END[heading]] for r in lineage._near(many, states, heading).collect()]
        assert met in near and len(near) < 20


def test_edges_differing_only_in_key_order_are_one(spark):
    raw = spark.createDataFrame(
        [("a", "b", {"z": "1", "a": "2"}), ("a", "b", {"a": "2", "z": "1"})], "s string, t string, m map<string,string>"
    )
    from fleetskein.functions.values import canonical_json

    rows = raw.select(
        F.col("s").alias("source_id"), F.lit("v").alias("verb"), F.col("t").alias("target_id"),
        F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("string").alias("run_id"),
        canonical_json(F.col("m")).alias("meta"), F.lit(None).cast("timestamp").alias("event_timestamp"),
    )
    assert lineage.lineage_edges(rows, "a").count() == 1


def test_hydration(spark):
    edges = traces(spark, [("a", "b"), ("b", "c")])
    known = spark.createDataFrame(
        [("a", "node", "n1", "{}", None), ("c", "data", None, "{}", None), ("z", "data", None, "{}", None),
         ("root", "data", None, "{}", None)],
        "id string, kind string, node_id string, meta string, created_at timestamp",
    )
    got = lineage.lineage_artifacts(edges, known, "root").orderBy("id").collect()
    assert [(r["id"], r["node_id"]) for r in got] == [("a", "n1"), ("c", ""), ("root", "")]


def fold(log):
    """Upserts one by one."""
    table = {}
    for seq, from_event, key, kind, node, meta, created, at in log:
        if key not in table:
            table[key] = {"kind": kind, "node_id": node, "meta": dict(meta or {}), "created_at": created}
        else:
            row = table[key]
            row["meta"].update(meta or {})
            if from_event:
                row["kind"] = kind
                row["node_id"] = node or row["node_id"]
        table[key]["updated_at"] = at
    return table


def test_random_upserts(spark):
    import json
    from datetime import datetime, timedelta

    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    log = []
    for seq in range(600):
        meta = None if rng.random() < 0.2 else {rng.choice("abc"): str(rng.randint(0, 9)) for _ in range(rng.randint(0, 3))}
        at = start + timedelta(minutes=seq)
        log.append((
            seq, rng.random() < 0.5, f"id{int(rng.random() ** 3 * 40)}", f"kind{rng.randint(0, 3)}",
            rng.choice([None, "n1", "n2"]), meta, at - timedelta(days=1), at,
        ))
    df = spark.createDataFrame(
        rng.sample(log, len(log)),
        "seq long, from_event boolean, id string, kind string, node_id string, meta map<string,string>, "
        "created_at timestamp_ntz, ingested_at timestamp_ntz",
    )
    expected = fold(log)
    got = {r["id"]: r.asDict() for r in artifacts.compact(df).collect()}
    assert got.keys() == expected.keys()
    for key, row in expected.items():
        row["meta"] = json.dumps(row["meta"], sort_keys=True, separators=(",", ":"))
        assert {c: got[key][c] for c in row} == row


def test_direct_upsert_defaults(spark):
    rows = spark.createDataFrame(
        [(1, "a", "k", "", {"x": "1"}, None, "2024-01-01 00:00:00")],
        "seq long, id string, kind string, node_id string, meta map<string,string>, created_at timestamp, at string",
    ).withColumn("ingested_at", F.col("at").cast("timestamp")).drop("at")
    row = artifacts.compact(artifacts.direct_upserts(rows)).first()
    assert row["node_id"] is None and row["created_at"] == row["updated_at"]
