"""The library's input tables, derived from the shared test tables.

The derivations are SQL expressions that Spark and DuckDB read alike, so that a
check can rebuild the same input on its own side. Nothing else is shared: the
operators and the SQL they are compared with are written separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetskein.session import configure

# `events` with its derived keys; {k} is the engine's way to read the number in `props`.
BASE = """
SELECT event_id, ts, user_id, event_type, value,
       cast({k} as bigint) AS k,
       'node-' || cast(user_id % 20 as string) AS node_id,
       'rack-' || cast(user_id % 20 % 4 as string) AS node_group,
       cast(event_id % 20 as bigint) AS form,
       cast(event_id % 13 as bigint) AS flaw
FROM {events}
"""
SPARK_K = "get_json_object(props, '$.k')"
DUCKDB_K = "json_extract_string(props, '$.k')"

_COMPONENT = """CASE event_type WHEN 'view' THEN 'host-os' WHEN 'click' THEN 'nvidia-gpu-0'
  WHEN 'purchase' THEN 'hailo-npu-0' WHEN 'error' THEN 'net-eth0' ELSE 'runner:benchmark' END"""
_STATUS = """CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'error'
  WHEN event_type = 'error' THEN 'sensor-fail'
  WHEN event_type = 'signup' THEN 'runner-start' ELSE 'active' END"""
_PILLAR = "CASE WHEN event_type = 'signup' THEN 'runner' ELSE 'observer' END"
_METRICS = """CASE WHEN event_type = 'signup' THEN
    '{"run_id":' || cast(1700000000000000000 + event_id as string) || ',"duration_sec":' || cast(k * 600 as string) || '}'
  ELSE '{"temperature_c":' || cast(value as string) || ',"k":' || cast(k as string) || '}' END"""
_TIME = "replace(cast(ts as string), ' ', 'T') || 'Z'"

LEDGER = f"""
SELECT event_id, node_id, node_group, 'session-live' AS session_id,
       {_PILLAR} AS pillar, {_COMPONENT} AS component, {_STATUS} AS status,
       ts AS event_timestamp, {_METRICS} AS metrics, '{{}}' AS params,
       ts AS ingested_at, cast(ts as date) AS event_date
FROM base
"""

_BODY = f"""'"pillar":"' || {_PILLAR} || '","component":"' || {_COMPONENT} || '","status":"' || {_STATUS}
  || '","event_timestamp":"' || {_TIME} || '","metrics":' || {_METRICS}"""
_NODE = """'{"node_id":"' || node_id || '",'"""

# By form: 0 cut off, 1 numeric node, 2 date for a timestamp, 3 no pillar, 4 an extra member, 5 null,
# 6 with a trace, 7 with an artifact, 8 a registry topic, 9 a topic outside the firehose,
# 10 text after the value, 11 a parameter that is no text, 12 an array, else plain.
MESSAGES = f"""
SELECT event_id AS msg_id,
  CASE form WHEN 8 THEN 'fleet/ctd/v1/registry/agent-' || node_id || '/status'
            WHEN 9 THEN 'fleet/other/' || node_id
            ELSE 'fleet/ctd/v1/' || {_PILLAR} || '/' || node_id || '/' || {_COMPONENT} END AS topic,
  CASE form
    WHEN 0 THEN {_NODE} || {_BODY}
    WHEN 1 THEN '{{"node_id":' || cast(user_id as string) || ',' || {_BODY} || '}}'
    WHEN 2 THEN {_NODE} || '"event_timestamp":"' || cast(cast(ts as date) as string) || '"}}'
    WHEN 3 THEN {_NODE} || '"component":"x","status":"active","event_timestamp":"' || {_TIME} || '"}}'
    WHEN 4 THEN {_NODE} || '"extra":[1,{{"deep":true}}],' || {_BODY} || '}}'
    WHEN 5 THEN 'null'
    WHEN 6 THEN {_NODE} || {_BODY} || ',"trace":{{"source_id":"node:' || node_id || '","verb":"ran","target_id":"run:'
      || cast(event_id as string) || '","run_id":"r' || cast(k as string) || '","meta":{{"z":"1","a":"'
      || event_type || '"}},"timestamp":"' || {_TIME} || '"}}}}'
    WHEN 7 THEN {_NODE} || {_BODY} || ',"artifact":{{"id":"artifact:' || cast(user_id as string)
      || '","kind":"dataset","meta":{{"k":"' || cast(k as string) || '"}},"created_at":"0001-01-01T00:00:00Z"}}}}'
    WHEN 8 THEN 'ONLINE'
    WHEN 10 THEN {_NODE} || {_BODY} || '}} trailing'
    WHEN 11 THEN {_NODE} || {_BODY} || ',"params":{{"a":1}}}}'
    WHEN 12 THEN '[' || {_NODE} || {_BODY} || '}}]'
    ELSE {_NODE} || {_BODY} || ',"params":{{"b":"2","a":"' || event_type || '"}}}}'
  END AS payload,
  ts AS received_at
FROM base
"""

# Every message with its redeliveries, some minutes later and, for one in ten, again after the time that counts.
REDELIVERED = """
SELECT msg_id, topic, payload, received_at FROM msgs
UNION ALL SELECT msg_id + 1000000000, topic, payload, {later_1} FROM msgs
UNION ALL SELECT msg_id + 2000000000, topic, payload, {later_2} FROM msgs WHERE msg_id % 10 = 0
"""
SPARK_LATER = "received_at + make_dt_interval(0, 0, 0, {n})"
DUCKDB_LATER = "received_at + to_seconds({n})"
REDELIVERY_DELAYS = ("1 + msg_id % 900", "9000 + msg_id % 900")

# Start and end events of runs: every third run stays open, one in seven ends twice, some ends belong to no run.
RUN_MARKS = """
SELECT event_id, node_id, 'runner:benchmark' AS component, 'runner-start' AS status, ts AS event_timestamp,
  '{{"run_id":' || cast(1700000000000000000 + event_id as string) || ',"duration_sec":' || cast(k * 60 as string) || ',"target_system":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
  || ',"target_npu":' || CASE WHEN k % 3 = 0 THEN 'true' ELSE '"yes"' END || CASE WHEN k % 5 = 0 THEN '' ELSE ',"target_gpu":true' END || '}}' AS metrics
FROM base WHERE event_type = 'signup'
UNION ALL SELECT event_id + 1000000000, node_id, 'runner:benchmark', 'runner-end', {end_1},
  '{{"run_id":' || cast(1700000000000000000 + event_id as string) || '}}' FROM base WHERE event_type = 'signup' AND event_id % 3 <> 0
UNION ALL SELECT event_id + 2000000000, node_id, 'runner:benchmark', 'runner-end', {end_2},
  '{{"run_id":' || cast(1700000000000000000 + event_id as string) || '}}' FROM base WHERE event_type = 'signup' AND event_id % 7 = 0 AND event_id % 3 <> 0
UNION ALL SELECT event_id + 3000000000, node_id, 'runner:benchmark', 'runner-end', ts, '{{"run_id":' || cast(event_id as string) || '}}'
FROM base WHERE event_type = 'error'
"""
RUN_LENGTHS = ("k * 31 + 0.25", "k * 31 + 7200")

REGISTRY_MESSAGES = """
SELECT event_id AS msg_id,
  CASE WHEN event_type = 'purchase' THEN 'fleet/v1/registry/agent-' || node_id || '/status'
       ELSE 'fleet/ctd/v1/registry/agent-' || node_id || '/status' END AS topic,
  CASE event_type WHEN 'signup' THEN 'ONLINE' WHEN 'error' THEN 'OFFLINE' WHEN 'click' THEN 'DEGRADED'
       WHEN 'purchase' THEN 'ONLINE' ELSE 'online' END AS payload,
  ts AS received_at
FROM base
"""

CONTROL_MESSAGES = """
SELECT event_id AS msg_id, node_id,
  '{"action":"' || CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'abort' WHEN 'click' THEN 'pause'
     WHEN 'error' THEN 'start' ELSE '' END
  || '","runner":"' || CASE WHEN event_type = 'error' THEN '' WHEN event_id % 11 = 0 THEN 'unknown' ELSE 'benchmark' END
  || '","params":{' || CASE WHEN k % 5 = 0 THEN '' ELSE '"duration_sec":' || CASE WHEN event_id % 97 = 0 THEN '1000000000000' ELSE cast(k * 600 as string) END || ',' END
  || '"target_system":true}}' AS payload,
  ts AS received_at
FROM base
"""

ARTIFACT_LOG = """
SELECT event_id AS seq, event_id % 3 <> 0 AS from_event, 'artifact:' || cast(user_id as string) AS id,
  event_type AS kind, CASE WHEN k % 4 = 0 THEN NULL ELSE node_id END AS node_id,
  event_type AS meta_key, cast(k as string) AS meta_value,
  'k' || cast(k % 3 as string) AS meta_key2, cast(event_id as string) AS meta_value2,
  ts AS created_at, ts AS ingested_at
FROM base
"""

TRACES = """
SELECT 'customer:' || cast(o_custkey as string) AS source_id, 'placed' AS verb,
  'order:' || cast(o_orderkey as string) AS target_id, cast(NULL as string) AS node_id, cast(NULL as string) AS run_id,
  '{{}}' AS meta, o_orderdate AS event_timestamp FROM {orders}
UNION ALL
SELECT 'part:' || cast(l_partkey as string), 'stacked_into', 'order:' || cast(l_orderkey as string),
  cast(NULL as string), cast(NULL as string), '{{}}', l_shipdate FROM {lineitem}
UNION ALL
SELECT 'supplier:' || cast(l_suppkey as string), 'supplied', 'part:' || cast(l_partkey as string),
  cast(NULL as string), cast(NULL as string), '{{}}', {epoch} FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem})
"""
SPARK_EPOCH = "timestamp_ntz '1992-01-01 00:00:00'"
DUCKDB_EPOCH = "timestamp '1992-01-01 00:00:00'"

# Registered vertices of the graph: the orders.
ORDER_ARTIFACTS = """
SELECT 'order:' || cast(o_orderkey as string) AS id, 'order' AS kind, cast(NULL as string) AS node_id,
  '{{"status":"' || o_orderstatus || '"}}' AS meta, o_orderdate AS created_at FROM {orders}
"""

_V, _K = "cast(value as string)", "cast(k as string)"
# sensor -> (device, raw text)
RAW_TEXTS: dict[str, tuple[str, str]] = {
    "nvidia": ("NULL", f"""CASE flaw WHEN 0 THEN '0, [N/A], ' || {_K} || ', 512, ' || {_V} WHEN 1 THEN '0, 1, 2'
      WHEN 2 THEN '0, ' || {_V} || ', ' || {_K} || ', 256' WHEN 3 THEN '  '
      ELSE '0, ' || {_V} || ', ' || {_K} || ', 1024, 7.5' || chr(10) || '1, ' || {_K} || ', 5, 6, ' || {_V} END"""),
    "amd": ("NULL", f"""CASE flaw WHEN 0 THEN '{{"card0":' WHEN 1 THEN '{{"card0":{{"GPU use (%)":99}}}}'
      WHEN 2 THEN '{{"card0":5}}' ELSE '{{"card0":{{"Temperature (Sensor edge) (C)":"' || {_V} || '","GPU use (%)":"' || {_K}
      || '","VRAM Total Used Memory (B)":"' || cast(k * 1048576 as string) || '"}},"card1":{{"GPU use (%)":"[N/A]"}}}}' END"""),
    "intel": ("NULL", f"""CASE flaw WHEN 0 THEN '' WHEN 1 THEN '[{{"power":{{"GPU":"5"}}}}]'
      WHEN 2 THEN '[{{"power":{{"GPU":' || {_V} || '}}}},5,{{"power":{{"GPU":1}}}}]'
      ELSE '[{{"power":{{"GPU":' || {_V} || '}},"engines":{{"Render/3D/0":{{"busy":' || {_K} || '}}}}}},{{"power":{{}}}}]' END"""),
    "darwin_gpu": ("NULL", f"""CASE flaw WHEN 0 THEN 'GPU Power: n/a' WHEN 1 THEN 'GPU active residency:  ' || {_V} || '%'
      ELSE 'GPU Power: ' || {_K} || ' mW' || chr(10) || 'GPU active residency: ' || {_V} || ' %' END"""),
    "darwin_ane": ("NULL", f"""CASE flaw WHEN 0 THEN 'ANE Power: n/a' ELSE 'ANE Power: ' || {_K} || ' mW' END"""),
    "hailo_scan": ("NULL", """CASE flaw WHEN 0 THEN 'no devices' ELSE 'Hailo Devices:' || chr(10)
      || 'Device 0000:01:00.0' || chr(10) || '---' || chr(10) || 'PCIe 0000:02:00.0' END"""),
    "hailo_temp": ("'0000:01:00.0'", f"CASE flaw WHEN 1 THEN 'error' ELSE 'Temp: ' || {_V} || ' C' END"),
    "hailo_power": ("'0000:02:00.0'", f"CASE flaw WHEN 2 THEN '0 W' ELSE {_K} || '.5 W' END"),
    "ubus_net": ("NULL", f"""CASE flaw WHEN 0 THEN '{{"eth0":' WHEN 1 THEN '{{"eth0":{{"up":"yes"}}}}'
      ELSE '{{"eth0":{{"up":true,"statistics":{{"rx_bytes":' || cast(event_id * 1000 as string) || ',"tx_bytes":' || {_K}
      || '}}}},"lo":{{"up":true,"statistics":{{"rx_bytes":1,"tx_bytes":1}}}},"wlan0":{{"up":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || '}}}}' END"""),
    "ubus_system": ("NULL", f"""CASE flaw WHEN 0 THEN '{{"uptime":"1"}}' WHEN 1 THEN '{{}}'
      ELSE '{{"uptime":' || cast(event_id as string) || ',"memory":{{"total":' || cast(k * 1048576 as string) || ',"free":' || cast(k * 524288 as string) || '}}}}' END"""),
    "loadavg": ("NULL", f"CASE flaw WHEN 0 THEN 'x y z' ELSE {_V} || ' 0.58 0.59 1/80 4' END"),
    "meminfo": ("NULL", f"""CASE flaw WHEN 0 THEN 'MemFree: 5 kB' WHEN 1 THEN 'MemTotal:' ELSE 'MemFree: 7 kB' || chr(10)
      || 'MemTotal:       ' || cast(k * 1024 as string) || ' kB' END"""),
    "win_cim": ("NULL", f"""CASE flaw WHEN 0 THEN '{{"TotalVisibleMemorySize":-1}}' WHEN 1 THEN '{{"FreePhysicalMemory":1.5}}'
      ELSE '{{"TotalVisibleMemorySize":' || cast(k * 2048 as string) || ',"FreePhysicalMemory":' || cast(k * 512 as string) || '}}' END"""),
    "coral": ("'/sys/class/apex/apex_' || cast(k % 2 as string)", f"CASE flaw WHEN 0 THEN 'n/a' ELSE ' ' || cast(k * 1000 as string) || chr(10) END"),
}


def raw_sensor_sql(*kinds: str) -> str:
    """One raw row per event and sensor; ``base`` must be in scope."""
    parts = []
    for position, (kind, (device, raw)) in enumerate(RAW_TEXTS.items()):
        if kind in (kinds or RAW_TEXTS):
            parts.append(
                f"SELECT event_id * 100 + {position} AS raw_id, node_id, '{kind}' AS sensor, "
                f"cast({device} as string) AS device, ts AS captured_at, {raw} AS raw FROM base"
            )
    return "\nUNION ALL\n".join(parts)


class Fixtures:
    """Lazy DataFrames over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def _table(self, name: str) -> str:
        return f"parquet.`{self.folder}/{name}.parquet`"

    def _derive(self, sql: str) -> DataFrame:
        base = BASE.format(k=SPARK_K, events=self._table("events"))
        return self.spark.sql(f"WITH base AS ({base}) {sql}")

    def ledger(self) -> DataFrame:
        return self._derive(LEDGER)

    def messages(self) -> DataFrame:
        return self._derive(MESSAGES)

    def redelivered(self) -> DataFrame:
        later = [SPARK_LATER.format(n=n) for n in REDELIVERY_DELAYS]
        return self._derive(f", msgs AS ({MESSAGES}) {REDELIVERED.format(later_1=later[0], later_2=later[1])}")

    def run_marks(self) -> DataFrame:
        ends = [SPARK_LATER.format(n=n).replace("received_at", "ts") for n in RUN_LENGTHS]
        return self._derive(RUN_MARKS.format(end_1=ends[0], end_2=ends[1]))

    def registry_messages(self) -> DataFrame:
        return self._derive(REGISTRY_MESSAGES)

    def control_messages(self) -> DataFrame:
        return self._derive(CONTROL_MESSAGES)

    def artifact_log(self) -> DataFrame:
        pairs = "map(meta_key, meta_value, meta_key2, meta_value2)"
        columns = ["seq", "from_event", "id", "kind", "node_id", f"{pairs} AS meta", "created_at", "ingested_at"]
        return self._derive(ARTIFACT_LOG).selectExpr(*columns)

    def traces(self) -> DataFrame:
        names = {"orders": self._table("orders"), "lineitem": self._table("lineitem")}
        return self.spark.sql(TRACES.format(epoch=SPARK_EPOCH, **names))

    def order_artifacts(self) -> DataFrame:
        return self.spark.sql(ORDER_ARTIFACTS.format(orders=self._table("orders")))

    def suppliers(self) -> DataFrame:
        return self.spark.sql(
            f"SELECT 'supplier:' || cast(s_suppkey as string) AS root_id FROM {self._table('supplier')}"
        )

    def raw_sensor(self, *kinds: str) -> DataFrame:
        return self._derive(raw_sensor_sql(*kinds))
