"""Secret scanning: base patterns, and a linear-chain conditional random field that adds spans.

The field tags words as begin, inside or outside of a secret from their shape, their neighbours
and features of the file. It is trained here on what the base patterns mark in a bounded
sample of documents, and decoded by Viterbi.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetskein.llm.words import blocks, raw, words

ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORD = re.compile(rb"passw|secret|token|api_?key|auth|credential|bearer|private")
KINDS = ["assign", "access", "hex", "crf"]
#: Documents of the training sample, drawn by a hash of the text.
SAMPLE = 4_000
#: Words on either side of a place that a training window holds.
REACH = 10
O, B, I = 0, 1, 2
#: Numbers of values of the feature groups: length and digits, character kinds and changes, marks,
#: keyword, left neighbour, right neighbour, two words to the left, file.
GROUPS = [28, 64, 16, 2, 7, 7, 7, 4]
OFFSETS = np.concatenate([[0], np.cumsum(GROUPS)[:-1]])


def base_spans(body: np.ndarray, offsets: np.ndarray, low: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of the block, leftmost and without overlap per kind, in order."""
    found: list[tuple[int, int, int]] = []
    data = body.tobytes()
    with_key = np.unique(np.searchsorted(offsets, [m.start() for m in re.finditer(rb"passw|secret|token|api", low)], "right") - 1)
    for k in with_key.tolist():
        a, b = int(offsets[k]), int(offsets[k + 1])
        found += [(a + m.start(), a + m.end(), 0) for m in ASSIGN.finditer(data[a:b]) if m.end(2) - m.start(2) >= 6]
    for k in np.unique(np.searchsorted(offsets, [m.start() for m in re.finditer(rb"AKIA", data)], "right") - 1).tolist():
        a, b = int(offsets[k]), int(offsets[k + 1])
        found += [(a + m.start(), a + m.end(), 1) for m in ACCESS.finditer(data[a:b]) if m.end() - m.start() >= 20]
    is_hex = np.zeros(256, bool)
    is_hex[[*range(48, 58), *range(97, 103)]] = True
    other = np.concatenate([[-1], np.flatnonzero(~is_hex[body]), [len(body)]])
    for k in np.flatnonzero(np.diff(other) > 24).tolist():
        a, b = int(other[k]) + 1, int(other[k + 1])
        inner = offsets[(offsets > a) & (offsets < b)].tolist()
        found += [(x, y, 2) for x, y in zip([a, *inner], [*inner, b], strict=True) if y - x >= 24]
    return sorted(found, key=lambda s: (s[0], s[2]))


@dataclass
class Tokens:
    """Words of a block with their feature values, one column per group."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    features: np.ndarray


def tokens(texts: pa.Array) -> tuple[Tokens, np.ndarray, np.ndarray, bytes]:
    body, offsets = raw(texts)
    w = words(texts)
    low = w.body.tobytes()
    s, e = w.start, w.end
    kind = np.full(256, 3, np.uint8)  # digit, upper, lower, other
    kind[48:58], kind[65:91], kind[97:123] = 0, 1, 2
    kinds = kind[body]

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(body) + 1, np.int32)
        np.cumsum(flags, out=total[1:])
        return total[e] - total[s]

    digits, upper, lower = (count(kinds == k) for k in range(3))
    size = e - s
    symbols = size - digits - upper - lower
    change = np.zeros(len(body), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change[s] = False
    changes = count(change)
    mark = np.isin(body, [58, 61])
    marks = count(mark)
    quote = np.isin(body[s], [34, 39]) if len(s) else np.zeros(0, bool)
    last_mark = mark[e - 1] if len(s) else np.zeros(0, bool)
    key = np.zeros(len(s), bool)
    key[np.searchsorted(s, [m.start() for m in KEYWORD.finditer(low)], "right") - 1] = True if len(s) else False
    steps = lambda x, bounds: np.searchsorted(bounds, x, "right")
    around = np.select([key & last_mark, key, marks == size, (size >= 12) & (digits >= 3), digits > 0], [1, 2, 3, 4, 5], 6)
    f = np.zeros((len(s), len(GROUPS)), np.int16)
    f[:, 0] = steps(size, [2, 4, 8, 12, 20, 32]) * 4 + steps(digits, [1, 3, 6])
    f[:, 1] = ((digits > 0) * 8 + (upper > 0) * 4 + (lower > 0) * 2 + (symbols > 0)) * 4 + steps(changes, [1, 3, 6])
    f[:, 2] = quote * 8 + last_mark * 4 + (marks == size) * 2 + (marks > 0)
    f[:, 3] = key
    same = np.zeros(len(s) + 2, bool)
    same[2:-1] = w.row[1:] == w.row[:-1] if len(s) > 1 else False
    f[1:, 4] = np.where(same[2:-1], around[:-1], 0)
    f[:-1, 5] = np.where(same[2:-1], around[1:], 0)
    f[2:, 6] = np.where(w.row[2:] == w.row[:-2], around[:-2], 0)
    # The file: share of words with a colon or an equals sign.
    per = np.maximum(np.bincount(w.row, minlength=w.rows), 1)
    share = np.bincount(w.row, weights=marks > 0, minlength=w.rows) / per
    f[:, 7] = steps(share, [0.001, 0.02, 0.1])[w.row]
    return Tokens(s, e, w.row, f), body, offsets, low


def labels(t: Tokens, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of the base spans: the first word a span touches is its begin."""
    out = np.zeros(len(t.start), np.int8)
    for a, b, _ in spans:
        first, stop = int(np.searchsorted(t.end, a, "right")), int(np.searchsorted(t.start, b))
        if first < stop:
            free = out[first:stop] == O
            out[first:stop][free] = I
            out[first] = B if free[0] else out[first]
    return out


def _windows(reach: int):
    """Arrow task: windows around every base span, and one window per document elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            t, body, offsets, low = tokens(block.column("text"))
            tag = labels(t, base_spans(body, offsets, low))
            bounds = np.searchsorted(t.row, np.arange(block.num_rows + 1))
            out = []
            for at in np.flatnonzero(tag == B).tolist():
                out.append((max(at - reach, bounds[t.row[at]]), min(at + reach, bounds[t.row[at] + 1])))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b > a:
                    mid = a + (b - a) // 2
                    out.append((max(a, mid - reach), min(b, mid + reach)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([t.features[a:b].tobytes() for a, b in out], pa.binary()), pa.array([tag[a:b].tobytes() for a, b in out], pa.binary())], names=["features", "tags"]
            )

    return run


@dataclass
class Field:
    """Weights of all feature values per tag, and of transitions; text borders count as outside."""

    emit: np.ndarray
    move: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for k, offset in enumerate(OFFSETS):
            out += self.emit[offset + features[:, k]]
        return out


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.15, decay: float = 1e-4) -> Field | None:
    """Maximum likelihood by Adam, forward-backward over all windows at once; None without any secret."""
    if not any((y == B).any() for _, y in sequences):
        return None
    n, length = len(sequences), max(len(y) for _, y in sequences)
    x = np.zeros((n, length, len(GROUPS)), np.int64)
    y = np.zeros((n, length), np.int64)
    live = np.zeros((n, length), bool)
    for k, (features, tags) in enumerate(sequences):
        x[k, : len(tags)], y[k, : len(tags)], live[k, : len(tags)] = features, tags, True
    x += OFFSETS
    params = [np.zeros((sum(GROUPS), 3)), np.zeros((3, 3))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    before = np.concatenate([np.zeros((n, 1), np.int64), y[:, :-1]], axis=1)
    gold = [np.zeros_like(p) for p in params]
    np.add.at(gold[0], (x[live], y[live][:, None]), 1)
    np.add.at(gold[1], (before[live], y[live]), 1)
    top = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    for step in range(1, rounds + 1):
        emit, move = params
        e = emit[x].sum(axis=2)
        alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        last = np.full((n, 3), -1e9)
        last[:, O] = 0
        starts = [last]
        for t in range(length):
            now = top(last[:, :, None] + move, 1) + e[:, t]
            last = np.where(live[:, t, None], now, last)
            alpha[:, t] = last
            starts.append(last)
        z = top(last, 1)
        ahead = np.zeros((n, 3))
        pairs = np.zeros((3, 3))
        for t in range(length - 1, -1, -1):
            beta[:, t] = ahead
            joint = starts[t][:, :, None] + move + (e[:, t] + ahead)[:, None, :] - z[:, None, None]
            pairs += np.exp(joint[live[:, t]]).sum(axis=0)
            ahead = np.where(live[:, t, None], top(move + (e[:, t] + ahead)[:, None, :], 2), ahead)
        share = np.exp(alpha + beta - z[:, None, None])[live]
        expected = np.zeros_like(emit)
        for k in range(3):
            expected[:, k] = np.bincount(x[live].ravel(), weights=np.repeat(share[:, k], len(GROUPS)), minlength=len(emit))
        for k, grad in enumerate((gold[0] - expected, gold[1] - pairs)):
            g = grad / n - decay * params[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Field(*params)


def viterbi(field: Field, t: Tokens) -> np.ndarray:
    """Best tags. Words that no neighbours can pull away from outside split the chain; the rest is solved exactly."""
    e, move = field.emissions(t.features), field.move
    out = np.zeros(len(e), np.int8)
    pull = [(move[:, None, s] + move[None, s, :].reshape(1, 3) - move[:, None, O] - move[None, O, :].reshape(1, 3)).max() for s in (B, I)]
    open_ = np.flatnonzero((e[:, B] - e[:, O] + pull[0] >= 0) | (e[:, I] - e[:, O] + pull[1] >= 0))
    if not len(open_):
        return out
    head = np.ones(len(open_), bool)
    head[1:] = (np.diff(open_) > 1) | (t.row[open_[1:]] != t.row[open_[:-1]])
    first = np.flatnonzero(head)
    size = np.diff(np.concatenate([first, [len(open_)]]))
    order = np.argsort(-size, kind="stable")
    at, size = open_[first[order]], size[order]
    back = np.zeros((len(e), 3), np.int8)
    score = np.full((len(at), 3), -np.inf)
    score[:, O] = 0
    live = len(at)
    for k in range(int(size[0])):
        live = int(np.searchsorted(-size, -k, "left"))
        step = score[:live, :, None] + move
        back[at[:live] + k] = step.argmax(axis=1)
        score[:live] = step.max(axis=1) + e[at[:live] + k]
    tag = (score + move[:, O]).argmax(axis=1)
    for k in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -k, "left"))
        out[at[:live] + k] = tag[:live]
        tag[:live] = back[at[:live] + k, tag[:live]]
    return out


def field_spans(field: Field | None, t: Tokens, body: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the field that touch no base span, quotes and end marks trimmed."""
    if field is None or not len(t.start):
        return []
    tag, out = viterbi(field, t), []
    taken = np.array([s[:2] for s in base]).reshape(-1, 2)
    for k in np.flatnonzero((tag == B) | ((tag == I) & (np.concatenate([[O], tag[:-1]]) == O))).tolist():
        stop = k + 1
        while stop < len(tag) and tag[stop] == I and t.row[stop] == t.row[k]:
            stop += 1
        a, b = int(t.start[k]), int(t.end[stop - 1])
        while a < b and body[a] in b"\"'([{<`":
            a += 1
        while a < b and body[b - 1] in b"\"')]}>`,;.!?":
            b -= 1
        if a < b and not ((taken[:, 0] < b) & (taken[:, 1] > a)).any():
            out.append((a, b, 3))
    return out


def _scan(field: Field | None, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for block in blocks(batches):
            t, body, offsets, low = tokens(block.column("text"))
            base = base_spans(body, offsets, low)
            spans: list[list[dict]] = [[] for _ in range(block.num_rows)]
            for a, b, k in sorted(base + field_spans(field, t, body, base), key=lambda s: (s[0], s[2])):
                row = int(np.searchsorted(offsets, a, "right")) - 1
                points = lambda x, o=int(offsets[row]): int(np.count_nonzero((body[o:x] & 0xC0) != 0x80))
                spans[row].append({"kind": KINDS[k], "start": points(a), "end": points(b)})
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in block.schema.names], pa.array(spans, kind)], names=[*block.schema.names, into])

    return run


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field from at most about ``sample`` documents, all of them if there are fewer."""
    total = max(docs.count(), 1)
    share = F.xxhash64(F.coalesce("text", F.lit(""))) / F.lit(2.0**64) + 0.5
    drawn = docs.select("text").where(share < sample / total).mapInArrow(_windows(REACH), "features binary, tags binary")
    rows = drawn.orderBy("features", "tags").toArrow()
    windows = []
    for x, y in zip(rows.column("features").to_pylist(), rows.column("tags").to_pylist(), strict=True):
        windows.append((np.frombuffer(x, np.int16).reshape(-1, len(GROUPS)), np.frombuffer(y, np.int8)))
    return fit(windows)


def scan(docs: DataFrame, field: Field | None, into: str = "secrets") -> DataFrame:
    """``docs`` plus ``into``: array of (kind, start, end) in code points, by start, then kind as in KINDS.

    Null and empty texts have none. Every row gives one row, and all columns stay; a column that has
    the result's name is replaced.
    """
    given = docs.drop(into)
    spans = T.StructType.fromDDL("spans array<struct<kind:string,start:long,end:long>>")["spans"].dataType
    return given.mapInArrow(_scan(field, into), T.StructType([*given.schema, T.StructField(into, spans)]))


def redacted(docs: DataFrame, spans: str = "secrets", mask: str = "[secret]") -> DataFrame:
    """``text`` with all spans of the column replaced, and without it; overlapping spans are replaced as one."""
    joined = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                F.when(s["start"] < a["at"], a["done"]).otherwise(F.concat(a["done"], F.substr("text", (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mask))).alias("done"),
                s["end"].alias("at"),
            )
        ),
    )
    rest = F.concat(joined["done"], F.substr("text", (joined["at"] + 1).cast("int")))
    return docs.withColumn("text", F.when(F.size(spans) > 0, rest).otherwise(F.col("text"))).drop(spans)


def digest(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Counts per kind and the spans as text, from the operator's output."""
    given = docs.select("doc_id", "text")
    found = scan(given, learn(given, sample)).drop("text")
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, KINDS[:3]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"), n("crf"))


def brute(text: str) -> str:
    """Base spans by the patterns on the text itself, for tests."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?a)(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)).encode()).hexdigest()
