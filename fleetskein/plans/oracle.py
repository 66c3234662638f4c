"""The same questions as DuckDB SQL over the shared test tables.

Only the derivation of the input tables comes from ``fixtures``; each question is
asked here in its own words, mostly as the row store would be asked.
"""

from __future__ import annotations

from fleetskein.plans import catalog
from fleetskein.sources import fixtures, messages

_BASE = fixtures.BASE.format(k=fixtures.DUCKDB_K, events="events")
_GRAPH = {"orders": "orders", "lineitem": "lineitem", "epoch": fixtures.DUCKDB_EPOCH}

_TABLES = {
    "base": _BASE,
    "ledger": fixtures.LEDGER,
    "now": "SELECT max(event_timestamp) AS as_of FROM ledger",
    "msgs": fixtures.MESSAGES,
    "redelivered": fixtures.REDELIVERED.format(**{f"later_{i}": fixtures.DUCKDB_LATER.format(n=n) for i, n in enumerate(fixtures.REDELIVERY_DELAYS, 1)}),
    "run_marks": fixtures.RUN_MARKS.format(**{f"end_{i}": f"ts + to_seconds({n})" for i, n in enumerate(fixtures.RUN_LENGTHS, 1)}),
    "registry": fixtures.REGISTRY_MESSAGES,
    "control": fixtures.CONTROL_MESSAGES,
    "artifact_log": fixtures.ARTIFACT_LOG,
    "traces": fixtures.TRACES.format(**_GRAPH),
    "order_artifacts": fixtures.ORDER_ARTIFACTS.format(orders="orders"),
}


def _with(tables: str, query: str, recursive: bool = False) -> str:
    """A statement over the named derived tables; ``query`` may add tables of its own after a comma."""
    parts = ",\n".join(f"{t} AS ({_TABLES[t]})" for t in tables.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{query}"


def _elapsed(start: str, end: str) -> str:
    s = f"cast(round((epoch_us({end}) - epoch_us({start})) / 1000000.0) AS bigint)"
    return (
        f"CASE WHEN {s} >= 3600 THEN ({s} // 3600) || 'h' || ({s} % 3600 // 60) || 'm' || ({s} % 60) || 's' "
        f"WHEN {s} >= 60 THEN ({s} // 60) || 'm' || ({s} % 60) || 's' ELSE {s} || 's' END"
    )


_LATEST = """, latest AS (
  SELECT DISTINCT ON (node_id) node_id, component, status, metrics, event_timestamp FROM ledger
  ORDER BY node_id, event_timestamp DESC, event_id DESC)"""
_STATES = _LATEST + """, states AS (
  SELECT node_id, component,
    CASE WHEN as_of - event_timestamp > INTERVAL 1 HOUR THEN 'oof!!!'
         WHEN lower(status) LIKE '%error%' OR lower(status) LIKE '%fail%' THEN 'degraded' ELSE 'running' END AS state,
    CASE WHEN as_of - event_timestamp > INTERVAL 1 HOUR
         THEN 'unreachable (' || cast(round_even((epoch_us(as_of) - epoch_us(event_timestamp)) / 60000000.0, 0) AS bigint) || 'm ago)'
         WHEN lower(status) LIKE '%error%' OR lower(status) LIKE '%fail%' THEN status ELSE 'clean' END AS detail
  FROM latest, now)"""
_SESSIONS = """, marked AS (
  SELECT node_id, event_timestamp, lag(event_timestamp) OVER w AS before FROM ledger
  WINDOW w AS (PARTITION BY node_id ORDER BY event_timestamp, event_id)
), numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR event_timestamp - before >= INTERVAL 3 HOUR THEN 1 ELSE 0 END)
    OVER (PARTITION BY node_id ORDER BY event_timestamp) AS session FROM marked)"""
_RUNS = """, runs AS (
  SELECT node_id, event_id, json_extract_string(metrics, '$.run_id')::bigint AS run_id, event_timestamp AS start_time,
    event_timestamp + to_seconds(json_extract_string(metrics, '$.duration_sec')::double) AS end_time
  FROM ledger WHERE status = 'runner-start'
), latest_run AS (
  SELECT DISTINCT ON (node_id) * FROM runs ORDER BY node_id, start_time DESC, event_id DESC)"""
_RUN_ROWS = """ FROM {runs} lr JOIN ledger t ON t.node_id = lr.node_id
  AND t.event_timestamp BETWEEN lr.start_time AND lr.end_time WHERE t.component <> 'runner:benchmark'"""

_PARSED = """, parsed AS (
  SELECT msg_id, node_id, received_at, json_extract_string(payload, '$.runner') AS runner,
    json_extract_string(payload, '$.action') AS raw_action,
    least(coalesce(json_extract_string(payload, '$.params.duration_sec')::bigint, 60), 3153600000) AS duration_sec FROM control
), validated AS (
  SELECT msg_id, node_id, runner, received_at, CASE WHEN raw_action = '' THEN 'start' ELSE raw_action END AS action,
    duration_sec,
    CASE WHEN runner = '' THEN 'missing runner execution name'
         WHEN raw_action NOT IN ('', 'start', 'abort') THEN 'invalid action: ' || raw_action END AS error
  FROM parsed)"""
_CONTROL = _PARSED + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY received_at, msg_id) AS rn
  FROM validated WHERE error IS NULL AND runner = 'benchmark'
), walk AS (
  SELECT node_id, rn, msg_id, CASE action WHEN 'abort' THEN 'abort_ignored' ELSE 'started' END AS outcome,
    CASE action WHEN 'start' THEN received_at + to_seconds(duration_sec) END AS until
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.node_id, r.rn, r.msg_id,
    CASE WHEN r.action = 'abort' AND coalesce(r.received_at < w.until, false) THEN 'aborted'
         WHEN r.action = 'abort' THEN 'abort_ignored'
         WHEN coalesce(r.received_at < w.until, false) THEN 'duplicate_ignored' ELSE 'started' END,
    CASE WHEN r.action = 'abort' THEN NULL WHEN coalesce(r.received_at < w.until, false) THEN w.until
         ELSE r.received_at + to_seconds(r.duration_sec) END
  FROM walk w JOIN ranked r ON r.node_id = w.node_id AND r.rn = w.rn + 1
)
SELECT v.msg_id, v.node_id, v.runner, v.received_at, v.action,
  CASE WHEN v.error IS NOT NULL THEN 'invalid' WHEN v.runner <> 'benchmark' AND v.action = 'abort' THEN 'abort_ignored'
       WHEN v.runner <> 'benchmark' THEN 'unknown_runner' ELSE k.outcome END AS outcome, v.error
FROM validated v LEFT JOIN walk k ON k.msg_id = v.msg_id"""


def _lineage(roots: str, depth: int) -> str:
    """The recursive walk; each step may leave by the target or by the source."""
    return f""", ends AS (
  SELECT source_id AS vertex, 'out' AS heading, * FROM traces UNION ALL
  SELECT target_id AS vertex, 'in' AS heading, * FROM traces
), roots AS ({roots}
), walk AS (
  SELECT r.root_id, t.source_id, t.verb, t.target_id, t.node_id, coalesce(t.run_id, '') AS run_id, t.meta,
    t.event_timestamp, 1 AS depth
  FROM traces t JOIN roots r ON t.source_id = r.root_id
  UNION
  SELECT r.root_id, t.source_id, t.verb, t.target_id, t.node_id, coalesce(t.run_id, ''), t.meta, t.event_timestamp, 1
  FROM traces t JOIN roots r ON t.target_id = r.root_id
), lineage AS (
  SELECT * FROM walk
  UNION
  SELECT l.root_id, t.source_id, t.verb, t.target_id, t.node_id, coalesce(t.run_id, ''), t.meta, t.event_timestamp,
    l.depth + 1
  FROM (SELECT root_id, depth, unnest([target_id, source_id]) AS vertex, unnest(['out', 'in']) AS heading FROM lineage
        WHERE depth < {depth}) l
  JOIN ends t ON t.vertex = l.vertex AND t.heading = l.heading
), edges AS (
  SELECT DISTINCT root_id, source_id, verb, target_id, node_id, run_id, meta, event_timestamp FROM lineage)"""


_ONE_ROOT = f"SELECT '{catalog.ROOT}' AS root_id"
_EDGE = "source_id, verb, target_id, node_id, run_id, meta, event_timestamp"

_ARTIFACTS = """, pairs AS (
  SELECT seq, id, meta_key AS key, meta_value AS value FROM artifact_log UNION ALL
  SELECT seq, id, meta_key2, meta_value2 FROM artifact_log
), merged AS (
  SELECT id, key, arg_max(value, seq) AS value FROM pairs GROUP BY id, key
), meta AS (
  SELECT id, '{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}' AS meta FROM merged GROUP BY id
), heads AS (
  SELECT id, list(kind ORDER BY seq DESC) FILTER (from_event) AS event_kinds, list(kind ORDER BY seq) AS kinds,
    list(node_id ORDER BY seq DESC) FILTER (from_event AND node_id IS NOT NULL) AS event_nodes,
    list(node_id ORDER BY seq) AS nodes, list(created_at ORDER BY seq) AS created, max(ingested_at) AS updated_at
  FROM artifact_log GROUP BY id
)
SELECT h.id, coalesce(event_kinds[1], kinds[1]) AS kind, coalesce(event_nodes[1], nodes[1]) AS node_id, m.meta,
  created[1] AS created_at, h.updated_at FROM heads h JOIN meta m ON m.id = h.id"""

_FIREHOSE = r"^fleet/ctd/v1(/.*)?$"
_REGISTRY = r"^fleet/ctd/v1/registry/[^/]*/status$"
_DOCS = f""", docs AS MATERIALIZED (
  SELECT *, CASE WHEN json_valid(payload) THEN payload END AS doc FROM msgs
  WHERE regexp_matches(topic, '{_FIREHOSE}') AND NOT regexp_matches(topic, '{_REGISTRY}')
), decoded AS MATERIALIZED (
  SELECT *, CASE WHEN doc IS NULL THEN 'bad_json' WHEN payload = 'null' THEN NULL
    WHEN json_type(doc) <> 'OBJECT' THEN 'not_object'
    WHEN json_type(doc, '$.node_id') NOT IN ('VARCHAR', 'NULL')
      OR len(list_filter(json_type(doc, '$.params.*'), lambda x: x NOT IN ('VARCHAR', 'NULL'))) > 0 THEN 'wrong_type'
    WHEN NOT regexp_matches(json_extract_string(doc, '$.event_timestamp'),
      '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?(Z|[+-]\\d{{2}}:\\d{{2}})$') THEN 'bad_timestamp' END AS reason
  FROM docs
), good AS MATERIALIZED (
  SELECT *, coalesce(replace(replace(json_extract_string(doc, '$.event_timestamp'), 'T', ' '), 'Z', '')::timestamp,
    received_at) AS event_timestamp FROM decoded WHERE reason IS NULL)"""


def _text(path: str, default: str = "''") -> str:
    return f"coalesce(json_extract_string(doc, '$.{path}'), {default})"


def _canonical(path: str) -> str:
    return (
        f"'{{' || coalesce(array_to_string(list_transform(list_sort(json_keys(doc, '$.{path}')), "
        f"lambda x: '\"' || x || '\":\"' || json_extract_string(doc, '$.{path}.' || x) || '\"'), ','), '') || '}}'"
    )


def _number(text: str) -> str:
    pattern = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return f"CASE WHEN regexp_matches({text}, '{pattern}') THEN try_cast({text} AS double) END"


def _or_zero(text: str) -> str:
    return f"coalesce({_number(text)}, 0.0)"


def _long(rows: str, component: str, **metrics: str) -> str:
    """Long form of wide readings; NULL metrics give no row."""
    return "\nUNION ALL\n".join(
        f"SELECT node_id, {component} AS component, captured_at AS event_timestamp, '{name}' AS metric, "
        f"cast({value} AS double) AS value FROM ({rows}) WHERE ({value}) IS NOT NULL"
        for name, value in metrics.items()
    )


def _where(kind: str) -> str:
    return f"SELECT * FROM raw WHERE sensor = '{kind}'"


_NV = (
    "SELECT node_id, captured_at, string_split(line, ',') AS f FROM (SELECT node_id, captured_at, "
    "unnest(string_split(trim(raw, ' ' || chr(9) || chr(10) || chr(13)), chr(10))) AS line FROM raw WHERE sensor = 'nvidia') "
    "WHERE len(string_split(line, ',')) >= 4"
)
_AMD = (
    "SELECT node_id, captured_at, card, json_extract(doc, '$.' || card) AS r FROM (SELECT node_id, captured_at, doc, "
    "unnest(json_keys(doc)) AS card FROM (SELECT node_id, captured_at, CASE WHEN json_valid(raw) THEN raw END AS doc "
    "FROM raw WHERE sensor = 'amd') WHERE doc IS NOT NULL AND len(list_filter(json_type(doc, '$.*'), lambda x: x <> 'OBJECT')) = 0)"
)


def _amd_value(name: str) -> str:
    path = f"'$.\"{name}\"'"
    return _or_zero(f"(CASE WHEN json_type(r, {path}) = 'VARCHAR' THEN json_extract_string(r, {path}) END)")


_INTEL = (
    "SELECT node_id, captured_at, e FROM (SELECT node_id, captured_at, unnest(json_extract(doc, '$[*]')) AS e, "
    "generate_subscripts(json_extract(doc, '$[*]'), 1) AS i, "
    "list_position(list_transform(json_type(doc, '$[*]'), lambda x: x IN ('OBJECT', 'NULL')), false) AS bad "
    "FROM (SELECT node_id, captured_at, CASE WHEN json_valid(raw) THEN raw END AS doc FROM raw WHERE sensor = 'intel') "
    "WHERE doc IS NOT NULL) WHERE bad IS NULL OR bad = 0 OR i < bad"
)


def _intel_value(path: str) -> str:
    return (
        f"(CASE WHEN json_type(e, '{path}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') "
        f"THEN json_extract_string(e, '{path}')::double END)"
    )


def _group(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, '{pattern}', 1)"


_HAILO_RE = r"(?i)(?:Device|PCIe)\s+([0-9a-fA-F:\.]+)"
_HAILO = (
    "SELECT s.node_id, s.captured_at, s.i, s.device, "
    f"coalesce({_or_zero(_group('t.raw', '([0-9.]+)\\s*C'))}, 0.0) AS temp, "
    f"coalesce({_or_zero(_group('p.raw', '([0-9.]+)\\s*W'))}, 0.0) AS power FROM ("
    "SELECT node_id, captured_at, unnest(ids) AS device, generate_subscripts(ids, 1) - 1 AS i FROM ("
    f"SELECT node_id, captured_at, list_filter(list_transform(string_split(raw, chr(10)), lambda x: regexp_extract(x, '{_HAILO_RE}', 1)), "
    "lambda x: x <> '') AS ids FROM raw WHERE sensor = 'hailo_scan')) s "
    "LEFT JOIN raw t ON t.sensor = 'hailo_temp' AND t.node_id = s.node_id AND t.captured_at = s.captured_at AND t.device = s.device "
    "LEFT JOIN raw p ON p.sensor = 'hailo_power' AND p.node_id = s.node_id AND p.captured_at = s.captured_at AND p.device = s.device"
)
_HAILO_SEEN = f"SELECT * FROM ({_HAILO}) WHERE temp <> 0 OR power <> 0"
_NET = (
    "SELECT node_id, captured_at, iface, json_extract(doc, '$.' || iface) AS d FROM (SELECT node_id, captured_at, doc, "
    "unnest(json_keys(doc)) AS iface FROM (SELECT node_id, captured_at, CASE WHEN json_valid(raw) THEN raw END AS doc "
    "FROM raw WHERE sensor = 'ubus_net') WHERE doc IS NOT NULL "
    "AND len(list_filter(json_type(doc, '$.*.up'), lambda x: x <> 'BOOLEAN')) = 0) "
    "WHERE json_extract_string(json_extract(doc, '$.' || iface), '$.up') = 'true' AND iface <> 'lo'"
)
_SYS = (
    "SELECT node_id, captured_at, raw AS doc FROM raw WHERE sensor = 'ubus_system' AND json_valid(raw) "
    "AND coalesce(json_type(raw, '$.uptime'), 'BIGINT') <> 'VARCHAR'"
)
_CIM = (
    "SELECT node_id, captured_at, coalesce(try_cast(json_extract_string(raw, '$.TotalVisibleMemorySize') AS bigint), 0) AS total, "
    "coalesce(try_cast(json_extract_string(raw, '$.FreePhysicalMemory') AS bigint), 0) AS free FROM raw "
    "WHERE sensor = 'win_cim' AND json_valid(raw) AND coalesce(json_type(raw, '$.FreePhysicalMemory'), 'UBIGINT') = 'UBIGINT'"
)
_UNIX = (
    "SELECT l.node_id, l.captured_at, regexp_extract(l.raw, '^\\s*(\\S+)', 1) AS load, "
    "regexp_extract(m.raw, '(?m)^MemTotal:\\s+(\\S+)', 1) AS total FROM raw l JOIN raw m ON l.sensor = 'loadavg' "
    "AND m.sensor = 'meminfo' AND l.node_id = m.node_id AND l.captured_at = m.captured_at"
)
_CORAL = (
    "SELECT node_id, captured_at, string_split(device, '/')[-1] AS dev, trim(raw, ' ' || chr(10)) AS t FROM raw "
    "WHERE sensor = 'coral'"
)

# sensor -> (rows, component expression, metric -> expression)
_SENSORS: dict[str, tuple[str, str, dict[str, str]]] = {
    "nvidia": (_NV, "'nvidia-gpu-' || trim(f[1])", {
        "temperature_c": _or_zero("trim(f[2])"), "utilization_pct": _or_zero("trim(f[3])"),
        "memory_used_mb": _or_zero("trim(f[4])"), "power_w": _or_zero("trim(f[5])"),
    }),
    "amd": (_AMD, "'amd-gpu-' || card", {
        "temperature_c": _amd_value("Temperature (Sensor edge) (C)"), "utilization_pct": _amd_value("GPU use (%)"),
        "memory_used_mb": _amd_value("VRAM Total Used Memory (B)") + " / 1024 / 1024",
    }),
    "intel": (_INTEL, "'intel-gpu'", {
        "power_w": _intel_value("$.power.GPU"), "utilization_pct": _intel_value('$.engines."Render/3D/0".busy'),
    }),
    "darwin_gpu": (_where("darwin_gpu"), "'gpu-darwin'", {
        "gpu_power_w": f"({_number(_group('raw', 'GPU Power:\\s+(\\d+)\\s+mW'))}) / 1000.0",
        "gpu_utilization_pct": _number(_group("raw", r"GPU active residency:\s+([\d\.]+)\s*%")),
    }),
    "darwin_ane": (
        f"SELECT * FROM (SELECT *, {_number(_group('raw', 'ANE Power:\\s+(\\d+)\\s+mW'))} AS mw FROM raw "
        "WHERE sensor = 'darwin_ane') WHERE mw > 0", "'npu-ane'", {"npu_power_w": "mw / 1000.0"},
    ),
    "hailo": (_HAILO_SEEN, "'hailo-npu-' || i", {"temperature_c": "temp", "power_w": "power"}),
    "ubus_net": (_NET, "'net-' || iface", {
        x: f"coalesce(json_extract_string(d, '$.statistics.{x}')::double, 0.0)" for x in ("rx_bytes", "tx_bytes")
    }),
    "ubus_system": (_SYS, "'host-os'", {
        "uptime_s": "coalesce(json_extract_string(doc, '$.uptime')::double, 0.0)",
        "mem_total_mb": "coalesce(json_extract_string(doc, '$.memory.total')::double, 0.0) / 1024 / 1024",
        "mem_free_mb": "coalesce(json_extract_string(doc, '$.memory.free')::double, 0.0) / 1024 / 1024",
    }),
    "unix_host": (_UNIX, "'host-os'", {"load_1m": _number("load"), "mem_total_mb": f"({_number('total')}) / 1024"}),
    "win_cim": (f"SELECT * FROM ({_CIM}) WHERE total >= 0 AND free >= 0", "'host-os'", {
        "mem_total_mb": "total / 1024.0", "mem_free_mb": "free / 1024.0",
    }),
    "coral": (_CORAL, "'npu-coral-' || dev", {"npu_temp_c": f"({_number('t')}) / 1000.0"}),
}
_RAW_OF = {"hailo": ("hailo_scan", "hailo_temp", "hailo_power"), "unix_host": ("loadavg", "meminfo")}


def _sensor(name: str) -> str:
    raw = fixtures.raw_sensor_sql(*_RAW_OF.get(name, (name,)))
    rows, component, metrics = _SENSORS[name]
    return _with("base", f", raw AS MATERIALIZED ({raw})\n{_long(rows, component, **metrics)}")


def _sensor_all() -> str:
    parts = [_long(rows, component, **metrics) for rows, component, metrics in _SENSORS.values()]
    joined = "\nUNION ALL\n".join(parts)
    return _with("base", f", raw AS MATERIALIZED ({fixtures.raw_sensor_sql()})\n{joined}")


def _sensor_ledger() -> str:
    parts = []
    for name, (rows, component, metrics) in _SENSORS.items():
        empty = " AND ".join(f"({m}) IS NULL" for m in metrics.values())
        device = "device" if name == "hailo" else "NULL"
        skip = f"WHERE NOT ({empty})" if name in ("darwin_gpu", "coral") else ""
        parts.append(
            f"SELECT node_id, {component} AS component, 'active' AS status, 'session-live' AS session_id, "
            f"'observer' AS pillar, captured_at AS event_timestamp, {device} AS device_id, ({empty}) AS no_metrics "
            f"FROM ({rows}) {skip}"
        )
    joined = "\nUNION ALL\n".join(parts)
    return _with("base", f", raw AS MATERIALIZED ({fixtures.raw_sensor_sql()})\n{joined}")


_LINE = "'[' || strftime({t}, '{f}') || '] ' || component || ': ' || metrics AS line"
_SECONDS = _LINE.format(t="event_timestamp", f="%H:%M:%S")
_MILLIS = "'[' || strftime(t.event_timestamp, '%H:%M:%S.%g') || '] ' || t.component || ': ' || t.metrics AS line"


def statements() -> dict[str, str]:
    sql = {
        "cluster_status": _with("base ledger now", _LATEST + """
            SELECT node_id, event_timestamp AS last_seen, status, metrics,
              event_timestamp > as_of - INTERVAL 1 HOUR AND status NOT IN ('error', 'critical') AS is_healthy
            FROM latest, now"""),
        "node_list": _with("base ledger now", """
            SELECT node_id, strftime(max(event_timestamp), '%Y-%m-%dT%H:%M:%SZ') AS last_seen,
              CASE WHEN any_value(as_of) - max(event_timestamp) > INTERVAL 1 HOUR THEN 'offline' ELSE 'active' END AS status
            FROM ledger, now GROUP BY node_id"""),
        "node_states": _with("base ledger now", _STATES + " SELECT * FROM states"),
        "degraded_report": _with("base ledger now", _STATES + """
            SELECT 'The following nodes are currently degraded or unreachable:' || chr(10)
              || string_agg('- ' || node_id || ' (' || detail || ')' || chr(10), '' ORDER BY node_id) AS report
            FROM states WHERE state <> 'running' HAVING count(*) > 0"""),
        "offline_nodes": _with("base ledger now", f""", seen AS (
              SELECT node_id, max(event_timestamp) AS last_seen FROM ledger GROUP BY node_id)
            SELECT node_id, last_seen, {_elapsed('last_seen', 'as_of')} AS elapsed FROM seen, now
            WHERE last_seen < as_of - INTERVAL 60 SECOND"""),
        "last_seen": _with("base ledger", " SELECT node_id, max(event_timestamp) AS last_seen FROM ledger GROUP BY node_id"),
        "silent_gaps": _with("base ledger", _SESSIONS + f"""
            SELECT node_id, before AS silent_since, event_timestamp AS back_at,
              {_elapsed('before', 'event_timestamp')} AS silent_for
            FROM marked WHERE event_timestamp - before >= INTERVAL 3 HOUR"""),
        "activity_sessions": _with("base ledger", _SESSIONS + """
            SELECT node_id, cast(session AS bigint) AS session, min(event_timestamp) AS session_start,
              max(event_timestamp) AS last_seen, count(*) AS n_events FROM numbered GROUP BY node_id, session"""),
        "latest_n": _with("base ledger", f"""
            SELECT * FROM (SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY event_timestamp DESC, event_id DESC)
              AS rank, event_id, component, metrics, event_timestamp, {_SECONDS} FROM ledger) WHERE rank <= 5"""),
        "latest_of_node": _with("base ledger", f"""
            SELECT node_id, event_id, component, metrics, event_timestamp, {_SECONDS} FROM ledger
            WHERE node_id = '{catalog.NODE}' ORDER BY event_timestamp DESC LIMIT 5"""),
        "hot_metrics_text": _with("base ledger", """
            SELECT event_id, node_id, component, json_extract_string(metrics, '$.temperature_c') AS value
            FROM ledger WHERE json_extract_string(metrics, '$.temperature_c') > '45'"""),
        "hot_metrics_number": _with("base ledger", """
            SELECT event_id, node_id, component, json_extract_string(metrics, '$.temperature_c')::double AS value
            FROM ledger WHERE json_extract_string(metrics, '$.temperature_c')::double > 45"""),
        "degraded_rows": _with("base ledger", """
            SELECT event_id, node_id, status, status IN ('error', 'critical') AS blocking FROM ledger
            WHERE component != 'runner:benchmark' AND (lower(status) LIKE '%error%' OR lower(status) LIKE '%fail%')"""),
        "unload_filtered": _with("base ledger", f"""
            SELECT cast(event_id AS varchar) AS event_id, node_id, pillar, component, status, event_timestamp, metrics, params
            FROM ledger WHERE node_id LIKE 'node-1%' AND pillar = 'observer' AND event_timestamp >= '{catalog.SINCE}'
            ORDER BY event_timestamp, ledger.event_id LIMIT 1000"""),
        "unload_default": _with("base ledger", """
            SELECT cast(event_id AS varchar) AS event_id, node_id, pillar, component, status, event_timestamp, metrics, params
            FROM ledger ORDER BY event_timestamp, ledger.event_id LIMIT 100000"""),
        "unload_matching": _with("base ledger", f"""
            SELECT event_id, node_id, pillar, event_timestamp FROM ledger
            WHERE node_id LIKE 'node-_' AND pillar = 'runner' AND event_timestamp >= '{catalog.SINCE}'"""),
        "run_starts": _with("base ledger", _RUNS + " SELECT node_id, event_id, run_id, start_time, end_time FROM runs"),
        "run_events": _with("base ledger", """
            SELECT node_id, event_id, status, json_extract_string(metrics, '$.run_id')::bigint AS run_id,
              json_extract_string(metrics, '$.duration_sec')::double AS duration_sec, event_timestamp
            FROM ledger WHERE status IN ('runner-start', 'runner-end')"""),
        "latest_runs": _with("base ledger", _RUNS + " SELECT node_id, run_id, start_time, end_time FROM latest_run"),
        "latest_run_telemetry": _with("base ledger", _RUNS + f"""
            SELECT t.node_id, lr.run_id, t.event_id, t.component, t.metrics, t.event_timestamp, {_MILLIS}
            {_RUN_ROWS.format(runs='latest_run')}"""),
        "latest_run_counts": _with("base ledger", _RUNS + f""", hits AS (
              SELECT lr.node_id, count(*) AS n {_RUN_ROWS.format(runs='latest_run')} GROUP BY lr.node_id)
            SELECT lr.node_id, lr.run_id, coalesce(n, 0) AS n FROM latest_run lr LEFT JOIN hits USING (node_id)"""),
        "all_run_telemetry": _with("base ledger", _RUNS + f"""
            SELECT t.node_id, lr.run_id, t.event_id, t.component, t.event_timestamp {_RUN_ROWS.format(runs='runs')}"""),
        "control_log": _with("base control", _CONTROL, recursive=True),
        "control_validated": _with("base control", _PARSED + " SELECT * FROM validated"),
        "lineage_edges": _with("traces", _lineage(_ONE_ROOT, 3) + f" SELECT {_EDGE} FROM edges", recursive=True),
        "lineage_default_depth": _with("traces", _lineage(_ONE_ROOT, 10) + f" SELECT {_EDGE} FROM edges", recursive=True),
        "lineage_artifacts": _with("traces order_artifacts", _lineage(_ONE_ROOT, 3) + f"""
            SELECT id, kind, coalesce(node_id, '') AS node_id, meta, created_at FROM order_artifacts
            WHERE id IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges UNION SELECT '{catalog.ROOT}')""",
            recursive=True),
        "lineage_of_suppliers": _with(
            "traces",
            _lineage("SELECT 'supplier:' || s_suppkey AS root_id FROM supplier", 2) + """
            SELECT root_id, verb, count(*) AS edges, count(DISTINCT source_id) AS sources, max(event_timestamp) AS newest
            FROM edges GROUP BY root_id, verb""",
            recursive=True,
        ),
        "compacted_artifacts": _with("base artifact_log", _ARTIFACTS),
        "topic_routes": _with("base msgs", f"""
            SELECT msg_id, regexp_matches(topic, '{_FIREHOSE}') AS firehose, regexp_matches(topic, '{_REGISTRY}') AS registry,
              len(string_split(topic, '/')) AS levels, string_split(topic, '/')[5] AS fifth FROM msgs"""),
        "ingest_ledger": _with("base msgs", _DOCS + f"""
            SELECT msg_id AS event_id, {_text('node_id')} AS node_id,
              json_extract_string(doc, '$.node_group') AS node_group, json_extract_string(doc, '$.session_id') AS session_id,
              received_at AS ingested_at,
              coalesce(nullif(json_extract_string(doc, '$.pillar'), ''), 'observer') AS pillar,
              {_text('component')} AS component, {_text('status')} AS status, event_timestamp,
              {_canonical('params')} AS params, event_timestamp::date AS event_date,
              json_extract_string(doc, '$.metrics.temperature_c')::double AS temperature_c,
              json_extract_string(doc, '$.metrics.run_id')::bigint AS run_id
            FROM good"""),
        "current_run_telemetry": _with("base ledger", _RUNS + """
            SELECT t.node_id, r.run_id, t.event_id, t.component, t.event_timestamp FROM ledger t JOIN runs r
              ON r.node_id = t.node_id AND r.start_time <= t.event_timestamp WHERE t.component <> 'runner:benchmark' AND r.end_time IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY t.event_id ORDER BY r.start_time DESC, r.event_id DESC) = 1 AND r.end_time >= t.event_timestamp"""),
        "run_spans": _with("base run_marks", """, marks AS (
              SELECT *, json_extract_string(metrics, '$.run_id')::bigint AS run_id, json_extract_string(metrics, '$.duration_sec')::double AS d FROM run_marks)
            SELECT s.node_id, s.event_id, s.run_id, s.event_timestamp AS start_time, s.event_timestamp + to_seconds(s.d) AS planned_end,
              min(e.event_timestamp) AS end_time, (epoch_us(min(e.event_timestamp)) - epoch_us(s.event_timestamp)) / 1000000.0 AS lasted_sec,
              CASE WHEN count(e.event_id) = 0 THEN 'open' ELSE 'ended' END AS state
            FROM marks s LEFT JOIN marks e ON e.status = 'runner-end' AND e.node_id = s.node_id AND e.run_id = s.run_id AND e.event_timestamp >= s.event_timestamp
            WHERE s.status = 'runner-start' GROUP BY s.node_id, s.event_id, s.run_id, s.event_timestamp, s.d"""),
        "run_marks": _with("base run_marks", """
            SELECT node_id, event_id, status, json_extract_string(metrics, '$.run_id')::bigint AS run_id, json_extract_string(metrics, '$.duration_sec')::double AS duration_sec,
              json_extract_string(metrics, '$.target_system') = 'true' AS target_system, json_extract_string(metrics, '$.target_npu') = 'true' AS target_npu,
              json_extract_string(metrics, '$.target_gpu') = 'true' AS target_gpu, event_timestamp FROM run_marks"""),
        "first_deliveries": _with("base msgs redelivered", """
            SELECT msg_id, topic, payload, received_at FROM redelivered
            QUALIFY coalesce(received_at - lag(received_at) OVER (PARTITION BY topic, payload ORDER BY received_at, msg_id) > INTERVAL 1 HOUR, true)"""),
        "ingest_quarantine": _with("base msgs", _DOCS + """
            SELECT msg_id, topic, payload, received_at, reason FROM decoded WHERE reason IS NOT NULL"""),
        "ingest_artifacts": _with("base msgs", _DOCS + f""", log AS (
              SELECT msg_id AS seq, {_text('artifact.id')} AS id, {_text('artifact.kind')} AS kind,
                json_extract_string(doc, '$.artifact.meta.k') AS k, event_timestamp, received_at
              FROM good WHERE json_type(doc, '$.artifact') = 'OBJECT')
            SELECT id, arg_max(kind, seq) AS kind, cast(NULL AS varchar) AS node_id,
              '{{"k":"' || arg_max(k, seq) || '"}}' AS meta, arg_min(event_timestamp, seq) AS created_at,
              max(received_at) AS updated_at FROM log GROUP BY id"""),
        "ingest_traces": _with("base msgs", _DOCS + f"""
            SELECT {_text('trace.source_id')} AS source_id, {_text('trace.verb')} AS verb,
              {_text('trace.target_id')} AS target_id, {_text('trace.node_id')} AS node_id, {_text('trace.run_id')} AS run_id,
              {_canonical('trace.meta')} AS meta,
              replace(replace(json_extract_string(doc, '$.trace.timestamp'), 'T', ' '), 'Z', '')::timestamp AS event_timestamp
            FROM good WHERE json_type(doc, '$.trace') = 'OBJECT'"""),
        "registry_alerts": _with("base registry", """
            SELECT msg_id, split_part(topic, '/', 5) AS node_id, payload AS status,
              CASE payload WHEN 'OFFLINE' THEN '🚨 CRITICAL: ' || split_part(topic, '/', 5) || ' has dropped off the network.'
                ELSE '✅ RECOVERY: ' || split_part(topic, '/', 5) || ' is back online.' END AS message,
              'Hardware Alert' AS title, CASE payload WHEN 'OFFLINE' THEN 'warning,skull' ELSE 'white_check_mark' END AS tags,
              CASE payload WHEN 'OFFLINE' THEN 'high' END AS priority, received_at
            FROM registry WHERE len(string_split(topic, '/')) >= 6 AND payload IN ('OFFLINE', 'ONLINE')"""),
        "built_events": _with("base ledger", """
            SELECT 'fleet/ctd/observer/' || node_id || '/' || component AS topic,
              '{"node_id":"' || node_id || '","pillar":"observer","component":"' || component || '","status":"' || status
              || '","event_timestamp":"' || replace(event_timestamp::varchar, ' ', 'T') || 'Z","metrics":{"seq":' || event_id
              || '}}' AS payload FROM ledger"""),
        "built_traces": _with("base ledger", """
            SELECT event_id, 'fleet/ctd/tracer/' || node_id || '/' || component AS topic,
              '{"event_id":"' || event_id || '","node_id":"' || node_id || '","pillar":"tracer","component":"' || component
              || '","status":"' || status || '","event_timestamp":"' || t || '","artifact":{"id":"run:' || event_id
              || '","kind":"process","created_at":"' || t || '"},"trace":{"source_id":"node:' || node_id
              || '","verb":"ran","target_id":"run:' || event_id || '","node_id":"' || node_id || '","meta":{"from":"'
              || component || '"},"timestamp":"' || t || '"}}' AS payload
            FROM (SELECT *, replace(event_timestamp::varchar, ' ', 'T') || 'Z' AS t FROM ledger)"""),
        "view_query": _with("base ledger", """
            SELECT node_id, component, count(*) AS n FROM ledger WHERE status = 'error' AND node_id LIKE 'node-1%'
            GROUP BY node_id, component"""),
        "view_maps": _with("base ledger", """
            SELECT '{"node_id":"' || node_id || '","pillar":"' || pillar || '","n":' || count(*) || '}' AS "row"
            FROM ledger GROUP BY node_id, pillar"""),
        "ask_telemetry": _with("base ledger", f"""
            SELECT {_SECONDS} FROM ledger WHERE node_id = '{catalog.NODE}' ORDER BY event_timestamp DESC LIMIT 5"""),
        "ask_benchmark": _with("base ledger", _RUNS + f""", hits AS (
              SELECT {_MILLIS} {_RUN_ROWS.format(runs='latest_run')} AND t.node_id = '{catalog.NODE}')
            SELECT line FROM hits UNION ALL
            SELECT CASE WHEN count(*) = 0 THEN 'No telemetry was recorded during the last benchmark run for {catalog.NODE}'
              ELSE 'Found ' || count(*) || ' hardware telemetry events during the benchmark:' END FROM hits"""),
        "ask_offline": _with("base ledger now", f""", seen AS (
              SELECT node_id, max(event_timestamp) AS last_seen FROM ledger GROUP BY node_id)
            , lines AS (SELECT '⚠️ ' || node_id || ' (Last seen: ' || {_elapsed('last_seen', 'as_of')} || ')' AS line
            FROM seen, now WHERE last_seen < as_of - INTERVAL 60 SECOND)
            SELECT line FROM lines UNION ALL SELECT 'All nodes are currently online and reporting.'
            WHERE NOT EXISTS (SELECT 1 FROM lines)"""),
        "sensor_all": _sensor_all(),
        "sensor_ledger": _sensor_ledger(),
    }
    sql["merged_artifacts"] = sql["compacted_artifacts"]
    sql |= {f"sensor_{name}": _sensor(name) for name in _SENSORS}
    return sql
