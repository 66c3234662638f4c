"""License scans by ordered signature rules, with built-in functions only.

A text's words are numbered in place (`` word#7;``), so that a match says by itself which words it covers. Texts without a word
of any rule are done after one look; in the others a rule is tried only where its keywords stand. Detections that lie
inside one of the same or a higher priority are suppressed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetskein.llm.license_rules import BASE, RULES, WEIGHT, Rule

#: Fixed value: what separates words; A-Z count as the letters they are lower-cased to.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
#: Detections that are compared with each other at a time.
STRETCH = 64


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_of(text: Column) -> Column:
    """The words of a text, in their own letters, with one blank between."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), APART, " "), F.lit(" "))


def spelled(plain: Column) -> Column:
    """Words to look for keywords in: lower-cased, one spelling of "license"."""
    return F.replace(F.lower(plain), F.lit("licenc"), F.lit("licens"))


def detections(plain: Column, hits: Column, rules: Iterable[Rule]) -> Column:
    """All places where a rule holds, in order: first word, -last word, -priority, rule, label, words. ``hits``: words of rules that occur."""
    # Written as SQL text: a constant of hundreds of parts is read faster than it is put together.
    fields = lambda k, r: f"{k} AS rule, {_quoted(r.label)} AS label, {r.priority} AS priority, {_quoted(r.word)} AS word, {_quoted(r.keyword)} AS keyword, r{_quoted(r.pattern)} AS pattern"
    table = F.expr(f"array({', '.join(f'struct({fields(k, r)})' for k, r in enumerate(rules))})")
    numbered = F.array_join(F.transform(F.split(F.translate(plain, UPPER, LOWER), " "), lambda w, i: F.concat(F.lit(" "), w, F.lit("#"), i.cast("string"), F.lit(";"))), "")
    number = lambda m, at: F.regexp_extract(m, at, 1).cast("int")

    def places(text: Column, r: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(text, r["pattern"], F.lit(0)),
            lambda m: F.struct(
                number(m, "#([0-9]+);").alias("first"), (-number(m, "#([0-9]+);$")).alias("minus_last"), (-r["priority"]).alias("minus_priority"), r["rule"].alias("rule"),
                r["label"].alias("label"), F.btrim(F.regexp_replace(m, "#[0-9]+;", "")).alias("words"),
            ),
        )

    padded = F.concat(F.lit(" "), spelled(plain), F.lit(" "))
    tried = _bound(F.struct(padded.alias("text"), hits.alias("hits")), lambda own: F.filter(table, lambda r: F.array_contains(own["hits"], r["word"]) & F.contains(own["text"], r["keyword"])))
    return F.sort_array(F.flatten(_bound(numbered, lambda text: F.transform(tried, lambda r: places(text, r)))))


def unsuppressed(found: Column) -> Column:
    """Of ordered detections those that lie in no other one of the same or a higher priority.

    What contains a detection stands before it. Detections are taken in stretches: those before in the same one are compared
    one by one, earlier stretches by how far they reach at each priority.
    """
    last, priority = lambda d: -d["minus_last"], lambda d: -d["minus_priority"]
    furthest = lambda ends: F.coalesce(F.array_max(ends), F.lit(-1))
    levels = sorted(WEIGHT)

    def sifted(every: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / STRETCH).cast("int")), lambda k: F.slice(every, k * STRETCH + 1, STRETCH))
        return _bound(stretches, lambda parts: _bound(F.array(*[reaches(parts, p) for p in levels]), lambda reached: F.flatten(F.transform(parts, lambda part, k: outside(part, k, reached)))))

    def reaches(parts: Column, level: int) -> Column:
        return F.transform(parts, lambda part: furthest(F.transform(F.filter(part, lambda d: priority(d) >= level), last)))

    def outside(part: Column, k: Column, reached: Column) -> Column:
        before = F.transform(reached, lambda ends: furthest(F.slice(ends, F.lit(1), k)))
        inside = lambda d, j: F.exists(F.slice(part, F.lit(1), j), lambda b: (priority(b) >= priority(d)) & (last(b) >= last(d)))
        return _bound(before, lambda ends: F.filter(part, lambda d, j: (F.element_at(ends, priority(d)) < last(d)) & ~inside(d, j)))

    return _bound(found, lambda every: F.when(F.size(every) == 0, every).otherwise(sifted(every)))


def scan(docs: DataFrame, text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """``docs`` with what its texts say about licenses; columns of the same names are replaced, all others stay.

    ``n_words``: words (runs of digits, a-z and characters beyond ASCII; A-Z lower-cased). ``n_base``, ``first_word``, ``last_word``:
    number of places of the base phrases, their smallest and largest first word (null without any), words from 0.
    ``detections``: label, rule, priority, first and last word, words, in order of the text, without those suppressed; equal intervals
    of one priority go to the earlier rule. ``base_labels``, ``labels``: distinct, sorted arrays; the base's labels stay in both.
    ``score``: the weight of the highest priority found, 0 without any. Null and empty texts have no words; every row gives one row,
    equal rows equal ones. Rules match runs of bounded length, so one long text costs no more than its length.
    """
    rules = list(rules)
    n_base = len(BASE)
    others = [c for c in docs.columns if c not in RESULTS or c == text]
    spare = "_" * (1 + max(map(len, docs.columns)))
    # The caller's columns travel as one struct, so that no name can clash with the steps' own.
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], F.lit(None).cast("boolean").alias(spare)).alias("others"), F.col(f"`{text}`").alias("whole"))
    plain = given.select("others", words_of(F.col("whole")).alias("plain"))
    wanted = F.expr(f"array({', '.join(dict.fromkeys(_quoted(r.word) for r in rules))})")
    counted = plain.select("others", "plain", F.split(spelled(F.col("plain")), " ").alias("w"))
    counted = counted.select("others", "plain", F.when(F.col("plain") == "", F.lit(0)).otherwise(F.size("w")).cast("long").alias("n_words"), F.array_intersect("w", wanted).alias("hits"))
    found = counted.select("others", "n_words", F.when(F.size("hits") > 0, detections(F.col("plain"), F.col("hits"), rules)).alias("found"))
    base = F.filter("found", lambda d: d["rule"] < n_base)
    sifted = found.select("others", "n_words", base.alias("base"), unsuppressed(F.col("found")).alias("kept"))
    labels = lambda of: F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"])))
    empty = F.array().cast("array<string>")
    clean = F.transform("kept", lambda d: F.struct(d["label"].alias("label"), d["rule"].alias("rule"), (-d["minus_priority"]).alias("priority"), d["first"].alias("first"), (-d["minus_last"]).alias("last"), d["words"].alias("words")))
    weight = F.create_map(*[F.lit(x) for pair in WEIGHT.items() for x in pair])
    return sifted.select(
        *[F.col("others")[c].alias(c) for c in others if c not in RESULTS],
        "n_words",
        F.when(F.col("base").isNull(), F.lit(0)).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.try_element_at("base", F.lit(1))["first"].cast("long").alias("first_word"),
        F.try_element_at("base", F.lit(-1))["first"].cast("long").alias("last_word"),
        F.coalesce(labels(F.col("base")), empty).alias("base_labels"),
        F.coalesce(F.array_sort(F.array_union(labels(F.col("base")), labels(F.col("kept")))), empty).alias("labels"),
        F.coalesce(F.element_at(weight, F.array_max(F.transform("kept", lambda d: -d["minus_priority"]))), F.lit(0.0)).alias("score"),
        F.coalesce(clean, F.array().cast("array<struct<label:string,rule:int,priority:int,first:int,last:int,words:string>>")).alias("detections"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``, one row per row of ``docs``; labels joined by commas."""
    found = scan(docs.select("doc_id", "text"))
    return found.select("doc_id", *RESULTS[:4], *[F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")], "score")


_LETTERS = f"translate(text, '{UPPER}', '{LOWER}')"
SQL = rf"""
WITH rules AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_quoted(r.label)}, {r.priority}, {_quoted(r.keyword)}, {_quoted(r.pattern)})" for k, r in enumerate(RULES))}) r(rule, label, priority, keyword, pattern)),
texts AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce({_LETTERS}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
numbered AS (
  SELECT row, w, ' ' || array_to_string(w, ' ') || ' ' AS plain, array_to_string(list_transform(w, lambda x, i: ' ' || x || '#' || (i - 1) || ';'), '') AS text FROM texts),
pairs AS (SELECT row, rule, label, priority, text, pattern FROM numbered JOIN rules ON contains(plain, keyword)),
matches AS (SELECT row, rule, label, priority, unnest(regexp_extract_all(text, pattern)) AS m FROM pairs),
found AS (
  SELECT row, rule, label, priority, regexp_extract(m, '#([0-9]+);', 1)::BIGINT AS first, regexp_extract(m, '#([0-9]+);$', 1)::BIGINT AS last FROM matches),
kept AS (
  SELECT * FROM found a WHERE NOT EXISTS (
    FROM found b WHERE b.row = a.row AND b.first <= a.first AND b.last >= a.last AND b.priority >= a.priority
      AND (b.last - b.first > a.last - a.first OR b.priority > a.priority OR b.rule < a.rule))),
base AS (
  SELECT row, label, pos FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS pos FROM texts), (VALUES {", ".join(f"({_quoted(label)}, {words.split()})" for label, words in BASE)}) p(label, words)
  WHERE w[pos : pos + len(words) - 1] = words),
of_base AS (SELECT row, count(*) AS n_base, min(pos) - 1 AS first_word, max(pos) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY row),
of_all AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM base UNION SELECT row, label FROM kept) GROUP BY row),
of_kept AS (SELECT row, max(CASE priority {" ".join(f"WHEN {p} THEN {w}" for p, w in WEIGHT.items())} END)::DOUBLE AS score FROM kept GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM texts LEFT JOIN of_base USING (row) LEFT JOIN of_all USING (row) LEFT JOIN of_kept USING (row)
"""
