"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a query go when it ends; what the written table needs is in the table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_scratch: dict[str, str] = {}
#: Folders of the tables that ``written`` made, and per thread the open ``passing`` blocks.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_open = threading.local()


def build_session(app: str = "fleetskein", master: str | None = None, **conf: str) -> SparkSession:
    """Session for jobs and tests. Shuffle partitions are left to the caller and to AQE."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Merge session windows before the shuffle, so that a busy node ships sessions, not rows.
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Settings that results depend on, for a session someone else created."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may do
    without; it then gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="fleetskein-")
    return _local_scratch[app]


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    This cuts the lineage of iterative plans, survives the loss of executors and
    gives the planner the real size, so that Spark broadcasts the table only when
    it is below ``spark.sql.autoBroadcastJoinThreshold``. ``keep`` hands the table
    past the innermost ``passing`` block to the one around it.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _places[table] = path
    around = _blocks()[:-1] if keep else _blocks()
    if around:
        around[-1].append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        place = _places.pop(table, None)
        if place:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(place)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def passing() -> Iterator[None]:
    """Tables written inside are deleted when the block ends, so results that leave it must not read them.

    Those written with ``keep`` stay, or end with the block around this one.
    """
    _blocks().append([])
    try:
        yield
    finally:
        discard(*_blocks().pop())


def _blocks() -> list[list[DataFrame]]:
    if not hasattr(_open, "blocks"):
        _open.blocks = []
    return _open.blocks
