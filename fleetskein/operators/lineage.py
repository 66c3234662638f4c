"""Bounded walk over lineage edges.

An edge follows another when it leaves the vertex the other arrived at, or
arrives at the vertex the other left. The walk may therefore turn round, and
plain ancestors plus descendants would miss edges. It is run over states
(root, vertex, heading): heading ``out`` expands the edges that leave the vertex,
``in`` those that arrive. Any edge taken leads to (target, ``out``) and
(source, ``in``). A state is entered once per root, so cycles end by themselves.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from fleetskein.operators.artifacts import hydrate
from fleetskein.schemas import EDGE_COLUMNS
from fleetskein.session import written

#: The depth of a usual walk; callers pass it.
USUAL_DEPTH = 10

_STATE = ["root_id", "vertex", "heading"]
#: Where an edge meets the states of a heading.
_END = {"out": "source_id", "in": "target_id"}
#: Bits of the map that keeps edges away from a join where they meet no state: a power of two, broadcast as words of 64 bits.
MARK_BITS = 1 << 24
#: Up to so many states meet the edges as they are, and equal rows are made one afterwards.
FEW = 1000


def lineage_edges_of_many(traces: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Edges within ``max_depth`` steps of each root (``roots.root_id``); all reachable ones without it, or with 0 or less.

    Only (root, vertex, heading) states go round the loop, over two edge columns;
    every level is written, so that its real size decides between broadcast and
    shuffle, and the edges themselves are fetched once at the end.

    With more than ``FEW`` states, equal edges are made one before they meet the states, not after: a state is there
    once, so no (root, edge) that leaves a state comes twice, and those that arrive at one are left out where they
    leave one too. The rows of all roots are so never shuffled, and the caller's sums see them as the join makes them.
    """
    bounded = max_depth is not None and max_depth > 0
    ends = traces.select("source_id", "target_id")
    both_ways = F.explode(F.array(F.lit("out"), F.lit("in")))
    seen = frontier = written(
        roots.select("root_id", F.col("root_id").alias("vertex")).distinct().withColumn("heading", both_ways),
        "lineage-0",
    )
    few = (known := seen.count()) <= FEW
    for level in range(1, max_depth) if bounded else itertools.count(1):
        reached = F.explode(F.array(
            F.struct(F.col("target_id").alias("vertex"), F.lit("out").alias("heading")),
            F.struct(F.col("source_id").alias("vertex"), F.lit("in").alias("heading")),
        ))
        near = (ends if few else _near(ends, frontier, h) for h in _END)
        states = _touching(*near, frontier).select("root_id", reached.alias("state")).select("root_id", "state.*")
        fresh = states.distinct().join(seen, _STATE, "left_anti")
        frontier = written(fresh, f"lineage-{level}")
        entered = frontier.count()
        if not entered:
            break
        seen = seen.unionByName(frontier)
        few = (known := known + entered) <= FEW
    columns = ["root_id", *EDGE_COLUMNS]
    edges = _comparable(traces)
    if few:
        return _touching(edges, edges, seen).select(columns).distinct()
    leaving, arriving = (_once(_near(edges, seen, h), h).join(_at(seen, h), _END[h]).select(columns) for h in _END)
    arriving = written(arriving, "lineage-arriving")
    if arriving.isEmpty():
        return leaving
    return leaving.unionByName(arriving.join(_at(seen, "out"), ["root_id", "source_id"], "left_anti").select(columns))


def lineage_edges(traces: DataFrame, root_id: str, max_depth: int | None = None) -> DataFrame:
    """Edges around one artifact."""
    root = traces.sparkSession.range(1).select(F.lit(root_id).alias("root_id"))
    return lineage_edges_of_many(traces, root, max_depth).drop("root_id")


def vertices(edges: DataFrame, root_id: str | None = None) -> DataFrame:
    """The distinct ``id`` of both edge ends and of the root."""
    ids = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    if root_id is not None:
        ids = ids.union(edges.sparkSession.range(1).select(F.lit(root_id).alias("id")))
    return ids.distinct()


def lineage_artifacts(edges: DataFrame, artifacts: DataFrame, root_id: str | None = None) -> DataFrame:
    """Registered artifacts among the vertices of the found edges."""
    return hydrate(artifacts, vertices(edges, root_id))


def _comparable(traces: DataFrame) -> DataFrame:
    return traces.withColumn("run_id", F.coalesce("run_id", F.lit(""))).select(*EDGE_COLUMNS)


def _at(states: DataFrame, heading: str) -> DataFrame:
    """The states of one heading, by the end of the edges that they expand."""
    return states.filter(F.col("heading") == heading).select("root_id", F.col("vertex").alias(_END[heading]))


def _touching(leaving: DataFrame, arriving: DataFrame, states: DataFrame) -> DataFrame:
    """Edges that the states expand. Two equi joins: a join on "source or target" would try all pairs."""
    return leaving.join(_at(states, "out"), "source_id").unionByName(arriving.join(_at(states, "in"), "target_id"))


def _once(edges: DataFrame, heading: str) -> DataFrame:
    """Distinct edges, dealt out as the join with the states of the heading needs them."""
    return edges.repartition(_END[heading]).distinct()


def _near(edges: DataFrame, states: DataFrame, heading: str) -> DataFrame:
    """``edges`` without most of those that meet no state of the heading. The others are left to the join."""
    end = _END[heading]
    word, bit = _place(F.col(end))
    marks = _at(states, heading).select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits")
    )
    # Broadcast whatever the session's threshold: the size is bounded by ``MARK_BITS``, and a join by exchange would shuffle all edges.
    return edges.join(F.broadcast(marks), (word == F.col("word")) & (F.getbit("bits", bit) == 1), "left_semi")


def _place(vertex: Column) -> tuple[Column, Column]:
    """Word and bit of a vertex."""
    slot = F.xxhash64(vertex).bitwiseAND(MARK_BITS - 1)
    return F.shiftright(slot, 6), slot.bitwiseAND(63).cast("int")
