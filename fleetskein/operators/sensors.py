"""Vendor sensor dumps to metric rows.

Input: ``raw_id, node_id, sensor, device, captured_at, raw``. Every parser gives
readings ``node_id, component, event_timestamp, metrics, labels``; one dump gives
none, one or several. ``as_metrics`` and ``as_ledger`` are the two output forms.
The raw table is best partitioned by ``sensor``: each parser then reads its own files.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from fleetskein.functions.values import exact_names, is_json_value, number_or_null, number_or_zero, with_document
from fleetskein.schemas import LIVE_SESSION

_BLANKS = " \t\r\n\x0b\x0c"
_MIB = 1024.0 * 1024.0

# Fixed patterns of the tools' text output.
_GPU_POWER = r"GPU Power:\s+(\d+)\s+mW"
_GPU_RESIDENCY = r"GPU active residency:\s+([\d\.]+)\s*%"
_ANE_POWER = r"ANE Power:\s+(\d+)\s+mW"
_HAILO_DEVICE = r"(?i)(?:Device|PCIe)\s+([0-9a-fA-F:\.]+)"
_CELSIUS = r"([0-9.]+)\s*C"
_WATTS = r"([0-9.]+)\s*W"


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _of(raw: DataFrame, *kinds: str) -> DataFrame:
    return raw.filter(F.col("sensor").isin(*kinds))


def _captured(pattern: str, text: Column | None = None) -> Column:
    """First capture group, NULL without a match."""
    subject = F.col("raw") if text is None else text
    return F.when(subject.rlike(pattern), F.regexp_extract(subject, pattern, 1))


def _metrics(**values: Column) -> Column:
    """Metric map; a NULL value stands for a metric that is not there and is left out by the output forms."""
    pairs = [x for name, value in values.items() for x in (F.lit(name), value.cast("double"))]
    return F.create_map(*pairs)


def _readings(rows: DataFrame, component: Column | str, metrics: Column, labels: Column | None = None) -> DataFrame:
    name = F.lit(component) if isinstance(component, str) else component
    return rows.select(
        "node_id",
        name.alias("component"),
        F.col("captured_at").alias("event_timestamp"),
        metrics.alias("metrics"),
        (F.lit(None).cast("map<string,string>") if labels is None else labels).alias("labels"),
    )


def _document(rows: DataFrame, ddl: str) -> DataFrame:
    """Add ``doc``, the typed JSON document; rows that do not fit the type are dropped, JSON null is kept."""
    read = with_document(rows, "raw", "_json", ddl)
    return read.filter("_json.ok").withColumn("doc", F.col("_json.value")).drop("_json")


def nvidia(raw: DataFrame) -> DataFrame:
    """CSV lines ``index, temperature, utilisation, memory, power``; power may be missing."""
    lines = F.split(_strip(F.col("raw")), "\n")
    cards = _of(raw, "nvidia").select(
        "node_id", "captured_at", F.explode(F.transform(lines, lambda line: F.split(line, ","))).alias("f")
    ).filter(F.size("f") >= 4)

    def number(i: int) -> Column:
        return number_or_zero(_strip(F.get("f", F.lit(i))))

    return _readings(
        cards,
        F.concat(F.lit("nvidia-gpu-"), _strip(F.get("f", F.lit(0)))),
        _metrics(temperature_c=number(1), utilization_pct=number(2), memory_used_mb=number(3), power_w=number(4)),
    )


def amd(raw: DataFrame) -> DataFrame:
    """JSON of card -> readings; only values that are JSON strings count."""
    docs = _document(_of(raw, "amd"), "map<string,map<string,variant>>")
    cards = docs.select("node_id", "captured_at", F.explode("doc").alias("card", "readings"))

    def number(name: str) -> Column:
        v = F.col("readings")[name]
        return number_or_zero(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))

    return _readings(
        cards,
        F.concat(F.lit("amd-gpu-"), "card"),
        _metrics(
            temperature_c=number("Temperature (Sensor edge) (C)"),
            utilization_pct=number("GPU use (%)"),
            memory_used_mb=number("VRAM Total Used Memory (B)") / _MIB,
        ),
    )


def _whole_values(pieces: Column) -> Column:
    """The values that consecutive pieces make up, as text; NULL at the end for what makes up none."""
    start = F.struct(F.array().cast("array<string>").alias("whole"), F.lit(None).cast("string").alias("begun"))

    def step(done: Column, piece: Column) -> Column:
        text = F.concat_ws(",", done["begun"], piece)
        ended = is_json_value(text)
        return F.struct(
            F.when(ended, F.concat(done["whole"], F.array(text))).otherwise(done["whole"]).alias("whole"),
            F.when(~ended, text).alias("begun"),
        )

    rest = F.array(F.lit(None).cast("string"))
    return F.aggregate(pieces, start, step, lambda done: F.when(done["begun"].isNull(), done["whole"]).otherwise(F.concat(done["whole"], rest)))


def intel(raw: DataFrame) -> DataFrame:
    """A JSON array, often cut off: elements count up to the first that is no object.

    A dump that is no complete array is taken apart behind each ``},``; pieces that are no whole
    value, since the border lay inside an element, are put together again.
    """
    text = F.col("raw")
    pieces = F.split(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), r"(?<=\})\s*,")
    elements = F.coalesce(
        F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"),
        F.transform(_whole_values(pieces), F.try_parse_json),
    )
    usable = lambda v: F.coalesce(F.schema_of_variant(v).rlike("^(OBJECT|VOID)"), F.lit(False))
    first_bad = F.array_position(F.transform("elements", usable), F.lit(False))
    good = F.when(first_bad > 0, F.slice("elements", F.lit(1), (first_bad - 1).cast("int"))).otherwise(F.col("elements"))
    samples = (
        _of(raw, "intel")
        .filter(F.ltrim(text).startswith("["))
        .withColumn("elements", elements)
        .select("node_id", "captured_at", F.explode(good).alias("v"))
    )

    def number(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("v", path, "variant"))
        is_number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        return F.when(is_number, F.try_variant_get("v", path, "double"))

    return _readings(
        samples,
        "intel-gpu",
        _metrics(power_w=number("$.power.GPU"), utilization_pct=number("$.engines['Render/3D/0'].busy")),
    )


def darwin_gpu(raw: DataFrame) -> DataFrame:
    power = number_or_null(_captured(_GPU_POWER)) / 1000.0
    busy = number_or_null(_captured(_GPU_RESIDENCY))
    rows = _of(raw, "darwin_gpu").filter(power.isNotNull() | busy.isNotNull())
    return _readings(rows, "gpu-darwin", _metrics(gpu_power_w=power, gpu_utilization_pct=busy))


def darwin_ane(raw: DataFrame) -> DataFrame:
    """Only an engine that draws power gives a reading."""
    milliwatts = number_or_null(_captured(_ANE_POWER))
    return _readings(
        _of(raw, "darwin_ane").filter(milliwatts > 0), "npu-ane", _metrics(npu_power_w=milliwatts / 1000.0)
    )


def hailo(raw: DataFrame) -> DataFrame:
    """Scan text, and one temperature and one power text per device of the same capture.

    The position among the scanned devices is the index; a device without any reading is left out.
    """
    lines = F.filter(F.split("raw", "\n"), lambda line: line.rlike(_HAILO_DEVICE))
    ids = F.transform(lines, lambda line: F.regexp_extract(line, _HAILO_DEVICE, 1))
    devices = _of(raw, "hailo_scan").select("node_id", "captured_at", F.posexplode(ids).alias("index", "device"))

    def newest(sensor: str, pattern: str) -> Column:
        of_sensor = F.when(F.col("sensor") == sensor, F.col("raw_id"))
        return number_or_zero(_captured(pattern, F.max_by("raw", of_sensor)))

    measured = (
        _of(raw, "hailo_temp", "hailo_power")
        .groupBy("node_id", "captured_at", "device")
        .agg(newest("hailo_temp", _CELSIUS).alias("temp"), newest("hailo_power", _WATTS).alias("power"))
    )
    joined = devices.join(measured, ["node_id", "captured_at", "device"], "left").fillna(0.0, ["temp", "power"])
    return _readings(
        joined.filter((F.col("temp") != 0) | (F.col("power") != 0)),
        F.concat(F.lit("hailo-npu-"), F.col("index").cast("string")),
        _metrics(temperature_c=F.col("temp"), power_w=F.col("power")),
        F.create_map(F.lit("device_id"), F.col("device")),
    )


def ubus_net(raw: DataFrame) -> DataFrame:
    """Interfaces that are up, loopback left out."""
    docs = _document(
        _of(raw, "ubus_net"),
        "map<string,struct<up boolean, statistics struct<rx_bytes double, tx_bytes double>>>",
    )
    links = docs.select("node_id", "captured_at", F.explode("doc").alias("iface", "link"))
    counter = lambda name: F.coalesce(F.col(f"link.statistics.{name}"), F.lit(0.0))
    return _readings(
        links.filter(F.col("link.up") & (F.col("iface") != "lo")),
        F.concat(F.lit("net-"), "iface"),
        _metrics(rx_bytes=counter("rx_bytes"), tx_bytes=counter("tx_bytes")),
    )


def ubus_system(raw: DataFrame) -> DataFrame:
    text = exact_names(F.col("raw"), ["uptime", "memory"], {"memory": ["total", "free"]})
    docs = _document(_of(raw, "ubus_system").withColumn("raw", text), "struct<uptime double, memory struct<total double, free double>>")
    value = lambda path: F.coalesce(F.col(f"doc.{path}"), F.lit(0.0))
    return _readings(
        docs,
        "host-os",
        _metrics(
            uptime_s=value("uptime"),
            mem_total_mb=value("memory.total") / _MIB,
            mem_free_mb=value("memory.free") / _MIB,
        ),
    )


def unix_host(raw: DataFrame) -> DataFrame:
    """Load average and memory total of one capture; a reading is given even when neither can be read."""

    def newest(sensor: str) -> Column:
        return F.max_by("raw", F.when(F.col("sensor") == sensor, F.col("raw_id")))

    captures = (
        _of(raw, "loadavg", "meminfo")
        .groupBy("node_id", "captured_at")
        .agg(newest("loadavg").alias("load"), newest("meminfo").alias("mem"))
    )
    load = number_or_null(F.regexp_extract("load", r"^\s*(\S+)", 1))
    line = F.regexp_extract("mem", r"(?m)^(MemTotal:.*)$", 1)
    total = number_or_null(F.regexp_extract(line, r"^\S+\s+(\S+)", 1))
    return _readings(captures, "host-os", _metrics(load_1m=load, mem_total_mb=total / 1024.0))


def win_cim(raw: DataFrame) -> DataFrame:
    """Kilobyte counts, whole numbers below 2^64; a missing or null one is 0."""
    names = ["totalvisiblememorysize", "freephysicalmemory"]
    docs = _document(
        _of(raw, "win_cim").withColumn("raw", exact_names(F.col("raw"), names)),
        f"struct<{', '.join(f'{name} variant' for name in names)}>",
    )

    def count(name: str) -> Column:
        v = F.col(f"doc.{name}")
        whole = F.schema_of_variant(v).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
        nothing = F.coalesce(F.schema_of_variant(v), F.lit("VOID")) == "VOID"
        return F.when(nothing, F.lit(0)).when(whole, F.try_variant_get(v, "$", "decimal(20,0)"))

    total, free = count(names[0]), count(names[1])
    most = F.lit(Decimal(2**64 - 1))
    return _readings(
        docs.filter(total.between(0, most) & free.between(0, most)),
        "host-os",
        _metrics(mem_total_mb=total.cast("double") / 1024.0, mem_free_mb=free.cast("double") / 1024.0),
    )


def coral(raw: DataFrame) -> DataFrame:
    """Millidegrees per device path; text that is no number is skipped."""
    celsius = number_or_null(_strip(F.col("raw"))) / 1000.0
    name = F.regexp_extract("device", r"([^/]+)/*$", 1)
    return _readings(
        _of(raw, "coral").filter(celsius.isNotNull()),
        F.concat(F.lit("npu-coral-"), name),
        _metrics(npu_temp_c=celsius),
    )


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "nvidia": nvidia,
    "amd": amd,
    "intel": intel,
    "darwin_gpu": darwin_gpu,
    "darwin_ane": darwin_ane,
    "hailo": hailo,
    "ubus_net": ubus_net,
    "ubus_system": ubus_system,
    "unix_host": unix_host,
    "win_cim": win_cim,
    "coral": coral,
}


def normalise(raw: DataFrame) -> DataFrame:
    """Readings of all sensors in one table."""
    parts = [parse(raw) for parse in PARSERS.values()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def as_metrics(readings: DataFrame) -> DataFrame:
    """Long form: one row per metric.

    The outer form of the generator keeps Catalyst from adding a "map is not
    empty" filter, which would build every map twice.
    """
    metric = F.explode_outer("metrics").alias("metric", "value")
    return readings.select("node_id", "component", "event_timestamp", metric).filter(F.col("value").isNotNull())


def as_ledger(readings: DataFrame) -> DataFrame:
    """Ledger form, the metrics and labels as one JSON object. The row id is a hash of the reading, equal on every run."""
    labels = F.transform_values(
        F.coalesce("labels", F.create_map().cast("map<string,string>")), lambda _k, v: v.cast("variant")
    )
    there = F.map_filter("metrics", lambda _k, v: v.isNotNull())
    numbers = F.transform_values(there, lambda _k, v: v.cast("variant"))
    rows = readings.select(
        "node_id",
        F.lit(LIVE_SESSION).alias("session_id"),
        F.lit("observer").alias("pillar"),
        "component",
        F.lit("active").alias("status"),
        "event_timestamp",
        F.to_json(F.map_concat(labels, numbers)).alias("metrics"),
        F.lit("{}").alias("params"),
    )
    return rows.withColumn("event_id", F.xxhash64("node_id", "component", "event_timestamp", "metrics"))
