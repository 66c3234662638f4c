"""Physical plans that must hold at scale."""

import pytest
from pyspark.sql import functions as F

from fleetskein.operators import latest, lineage, runs, silence, unload
from fleetskein.plans import catalog
from fleetskein.session import scratch_folder, written
from fleetskein.sources.fixtures import Fixtures
from fleetskein.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ledger") / "table")
    ingest.append_ledger(Fixtures(spark, FOLDER).ledger(), path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", ["lineage_edges", "lineage_of_suppliers", "all_run_telemetry", "control_log", "cluster_status"])
def test_no_nested_loops(spark, name):
    text = plan(catalog.run(name, spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_latest_n_is_limited_before_the_shuffle(ledger):
    text = plan(latest.latest_n(ledger, 5))
    assert text.count("WindowGroupLimit") == 2


def test_latest_row_is_reduced_before_the_shuffle(ledger):
    text = plan(latest.latest_row(ledger, "status"))
    assert "partial_max_by" in text
    assert "metrics" not in text


def test_last_seen_reads_two_columns(ledger):
    text = plan(latest.last_seen(ledger))
    assert "ReadSchema: struct<node_id:string,event_timestamp:timestamp_ntz>" in text
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_sessions_reduce_rows_to_slots_first(ledger):
    text = plan(silence.activity_sessions(ledger, 3600))
    assert "partial_min" in text
    assert text.rindex("partial_min(event_timestamp") > text.rindex("Window")


def test_unload_prunes_and_pushes(spark, ledger):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(unload.unload(ledger, "node-1%", "observer", "2024-01-10 00:00:00", 10))
    assert "TakeOrderedAndProject" in text
    scan = [x for x in text.splitlines() if "FileScan" in x]
    assert all("event_date" in x.split("PartitionFilters:")[1].split("PushedFilters")[0] for x in scan)
    assert all("StringStartsWith(node_id,node-1)" in x and "EqualTo(pillar,observer)" in x for x in scan)


def test_one_node_filter_is_pushed(ledger):
    assert "EqualTo(node_id,node-7)" in plan(latest.latest_of_node(ledger, "node-7"))


def test_small_run_table_is_broadcast_by_size_only(spark, ledger):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    assert "BroadcastHashJoin" in plan(runs.all_run_telemetry(ledger))
    spark.conf.set(threshold, "-1")
    try:
        text = plan(runs.all_run_telemetry(ledger))
        assert "SortMergeJoin [node_id" in text and "BroadcastHashJoin" not in text
    finally:
        spark.conf.unset(threshold)


def test_lineage_plan_does_not_grow_with_depth(spark):
    fx = Fixtures(spark, FOLDER)
    sizes = [len(plan(lineage.lineage_edges(fx.traces(), "order:5", d))) for d in (3, 10)]
    assert sizes[1] < sizes[0] * 2


class FakeSession:
    """A session of a cluster, as far as the scratch folder looks at it."""

    def __init__(self, named=None, master="yarn"):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master = master


def test_scratch_folder_is_the_one_the_cluster_names(spark):
    assert scratch_folder(FakeSession("hdfs://shared/cp/")) == "hdfs://shared/cp"
    assert scratch_folder(FakeSession("/named", "local[2]")) == "/named"
    with pytest.raises(ValueError):
        scratch_folder(FakeSession())
    assert written(spark.range(3), "x").agg(F.sum("id")).first()[0] == 3
