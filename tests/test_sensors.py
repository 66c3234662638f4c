"""One dump per case and sensor."""

import json
from datetime import datetime

import pytest

from fleetskein.operators import sensors

AT = datetime(2024, 1, 1)
SCHEMA = "raw_id long, node_id string, sensor string, device string, captured_at timestamp_ntz, raw string"


def parse(spark, name, *texts, device=None):
    """Readings of ``name`` as (component, metrics), NULL metrics left out. A text may name its own sensor."""
    rows = []
    for i, text in enumerate(texts):
        sensor, dev, raw = text if isinstance(text, tuple) else (name, device, text)
        rows.append((i, "n", sensor, dev, AT, raw))
    df = sensors.PARSERS[name](spark.createDataFrame(rows, SCHEMA))
    found = [(r["component"], {k: v for k, v in r["metrics"].items() if v is not None}) for r in df.collect()]
    return sorted(found, key=str)


def test_nvidia(spark):
    got = parse(spark, "nvidia", "0, 45, 99, 512, 30.5\n 1 , [N/A], 1d, NaN, 7 \n\n2, 1, 2\n3, 1, 2, 3\n", "  \n ")
    zero = {"temperature_c": 0.0, "utilization_pct": 0.0, "memory_used_mb": 0.0, "power_w": 7.0}
    assert got == [
        ("nvidia-gpu-0", {"temperature_c": 45.0, "utilization_pct": 99.0, "memory_used_mb": 512.0, "power_w": 30.5}),
        ("nvidia-gpu-1", zero),
        ("nvidia-gpu-3", {"temperature_c": 1.0, "utilization_pct": 2.0, "memory_used_mb": 3.0, "power_w": 0.0}),
    ]


def test_amd(spark):
    good = '{"card0":{"Temperature (Sensor edge) (C)":"45.0","GPU use (%)":99,"VRAM Total Used Memory (B)":"1048576"},"card1":null}'
    got = parse(spark, "amd", good, '{"card0":', '{"card0":5}', "null", good + " x")
    assert got == [
        ("amd-gpu-card0", {"temperature_c": 45.0, "utilization_pct": 0.0, "memory_used_mb": 1.0}),
        ("amd-gpu-card1", {"temperature_c": 0.0, "utilization_pct": 0.0, "memory_used_mb": 0.0}),
    ]


@pytest.mark.parametrize("raw, expected", [
    ('[{"power":{"GPU":5},"engines":{"Render/3D/0":{"busy":1.5}}}]', [{"power_w": 5.0, "utilization_pct": 1.5}]),
    ('[{"power":{"GPU":"5"}},{"engines":5}]', [{}, {}]),
    ('[{"power":{"GPU":1}},7,{"power":{"GPU":2}}]', [{"power_w": 1.0}]),
    ('[{"power":{"GPU":1}},\n{"power":{"GPU":2}}', [{"power_w": 1.0}, {"power_w": 2.0}]),
    ('[{"power":{"GPU":1}},\n{"power":{"GP', [{"power_w": 1.0}]),
    ('[{"power":{"GPU":1}},{"pow},{"power":{"GPU":2}}', [{"power_w": 1.0}]),
    ('[{"clients":[{"pid":1},{"pid":2}],"power":{"GPU":1}},{"clients":[{},{"a":{}}],"power":{"GPU":2}} ,{"clients":[{"pid":3},', [{"power_w": 1.0}, {"power_w": 2.0}]),
    ('[{"power":{"GPU":1}},7,{"power":{"GPU":2}', [{"power_w": 1.0}]),
    ('[{"name":"{}, {","power":{"GPU":1}},{"name":"},{"', [{"power_w": 1.0}]),
    ("[]", []), ("", []), ('{"power":{"GPU":1}}', []), ("[null]", [{}]),
])
def test_intel(spark, raw, expected):
    assert [m for _, m in parse(spark, "intel", raw)] == expected


def test_powermetrics(spark):
    got = parse(spark, "darwin_gpu", "x\nGPU Power: 1500 mW\nGPU active residency:  12.5%", "GPU active residency: 3 %", "none")
    assert got == [
        ("gpu-darwin", {"gpu_power_w": 1.5, "gpu_utilization_pct": 12.5}), ("gpu-darwin", {"gpu_utilization_pct": 3.0}),
    ]
    assert parse(spark, "darwin_ane", "ANE Power: 250 mW", "ANE Power: 0 mW", "-") == [("npu-ane", {"npu_power_w": 0.25})]


def test_hailo(spark):
    got = sensors.hailo(spark.createDataFrame([
        (1, "n", "hailo_scan", None, AT, "Devices:\nDevice 0000:01:00.0\npcie 0000:02:00.0\nDevice: 0000:03:00.0\nDevice aa:bb"),
        (2, "n", "hailo_temp", "0000:01:00.0", AT, "Temp 45.5 C"),
        (3, "n", "hailo_power", "0000:01:00.0", AT, "1.2.3 W"),
        (4, "n", "hailo_power", "aa:bb", AT, "2 W"),
        (5, "other", "hailo_temp", "0000:02:00.0", AT, "50 C"),
    ], SCHEMA)).orderBy("component").collect()
    assert [(r["component"], r["metrics"], r["labels"]) for r in got] == [
        ("hailo-npu-0", {"temperature_c": 45.5, "power_w": 0.0}, {"device_id": "0000:01:00.0"}),
        ("hailo-npu-2", {"temperature_c": 0.0, "power_w": 2.0}, {"device_id": "aa:bb"}),
    ]


def test_ubus(spark):
    net = '{"eth0":{"up":true,"statistics":{"rx_bytes":10,"tx_bytes":2.5}},"lo":{"up":true},"w":{"up":false},"x":{"up":true}}'
    got = parse(spark, "ubus_net", net, '{"e":{"up":"yes"}}')
    assert got == [("net-eth0", {"rx_bytes": 10.0, "tx_bytes": 2.5}), ("net-x", {"rx_bytes": 0.0, "tx_bytes": 0.0})]
    system = parse(spark, "ubus_system", '{"uptime":5,"memory":{"total":2097152,"free":1048576}}', '{"uptime":"5"}', "{}")
    assert system == [
        ("host-os", {"uptime_s": 0.0, "mem_total_mb": 0.0, "mem_free_mb": 0.0}),
        ("host-os", {"uptime_s": 5.0, "mem_total_mb": 2.0, "mem_free_mb": 1.0}),
    ]


def test_hosts(spark):
    got = parse(spark, "unix_host", ("loadavg", None, "0.52 0.58 x"), ("meminfo", None, "MemFree: 1 kB\nMemTotal:  2048 kB\nMemTotal: 9 kB"))
    assert got == [("host-os", {"load_1m": 0.52, "mem_total_mb": 2.0})]
    assert parse(spark, "unix_host", ("meminfo", None, "MemTotal:\n5 kB")) == [("host-os", {})]
    got = parse(
        spark, "win_cim", '{"TotalVisibleMemorySize":2048,"FreePhysicalMemory":512}', '{"TotalVisibleMemorySize":-1}',
        '{"TotalVisibleMemorySize":1.5}', '{"TotalVisibleMemorySize":"5"}',
    )
    assert got == [("host-os", {"mem_total_mb": 2.0, "mem_free_mb": 0.5})]


def test_coral(spark):
    got = parse(spark, "coral", " 45500\n", "n/a", device="/sys/class/apex/apex_0")
    assert got == [("npu-coral-apex_0", {"npu_temp_c": 45.5})]


def test_ledger_form(spark):
    raw = spark.createDataFrame([
        (1, "n", "coral", "/x/apex_1", AT, "1000"), (2, "n", "meminfo", None, AT, "-"),
    ], SCHEMA)
    rows = {r["component"]: r for r in sensors.as_ledger(sensors.normalise(raw)).collect()}
    assert json.loads(rows["npu-coral-apex_1"]["metrics"]) == {"npu_temp_c": 1.0}
    assert rows["host-os"]["metrics"] == "{}" and rows["host-os"]["status"] == "active"
    assert sensors.as_metrics(sensors.normalise(raw)).count() == 1


def test_names_in_any_case_and_unsigned_counts(spark):
    system = parse(spark, "ubus_system", '{"Uptime":5,"uptime":6,"MEMORY":{"Total":2097152,"free":1048576}}')
    assert system == [("host-os", {"uptime_s": 6.0, "mem_total_mb": 2.0, "mem_free_mb": 1.0})]
    for text in ('{"totalvisiblememorysize":2048,"FreePhysicalMemory":512}', '{"TOTALVisibleMemorySize":2048,"freephysicalmemory":512}'):
        assert parse(spark, "win_cim", text) == [("host-os", {"mem_total_mb": 2.0, "mem_free_mb": 0.5})]
    large = parse(spark, "win_cim", '{"TotalVisibleMemorySize":%d}' % 2**63, '{"TotalVisibleMemorySize":%d}' % 2**64, '{"TotalVisibleMemorySize":1.5}')
    assert large == [("host-os", {"mem_total_mb": 2.0**53, "mem_free_mb": 0.0})]
