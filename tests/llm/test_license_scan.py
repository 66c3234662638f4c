"""License scans: rules, suppression, places, odd rows, long texts, against a plain model."""

import re
import time

import pytest

from fleetskein.llm import license_scan
from fleetskein.llm.license_rules import BASE, COMMON, RULES, WEIGHT, Rule, expression, keyword, word

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def model(text, rules=RULES):
    """Labels, kept detections, base places and score; every rule tried on every text, every pair of detections compared."""
    w = WORD.findall(low(text))
    numbered = "".join(f" {x}#{k};" for k, x in enumerate(w))
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, numbered):
            at = re.findall("#([0-9]+);", m[0])
            found.append((int(at[0]), int(at[-1]), r.priority, k, r.label))
    kept = [
        a for a in found
        if not any(b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and (b[1] - b[0] > a[1] - a[0] or b[2] > a[2] or b[3] < a[3]) for b in found)
    ]
    base = [(k, label) for label, p in BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    labels = {label for _, label in base} | {d[4] for d in kept}
    return w, sorted(base), labels, sorted(kept), max((WEIGHT[d[2]] for d in kept), default=0.0)


TEXTS = [
    None, "", " -- ", "nothing to see", "ALL RIGHTS RESERVED", "all rights reserved all rights reserved, CC-BY cc by",
    "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public Licence, version 3.", "Released under the MIT License.",
    "mit Lizenz und mit license", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: LGPL-2.1 and SPDX-License-Identifier: MIT", "GPLv2 or gpl v3, not GPLv9", "Copyright (c) 2021 X. Redistribution and use in source and binary forms, with or without modification, are permitted",
    "No part of this little book may be reproduced.", "Published into the public domain; cc0 universal", "the Apache Software License 1.1, apache license", "Kelvin licenſe K CC BY cc bý",
    "cc x by", "mozilla public license 2.0 mozilla public license 1.1 mozilla public license", "gnu lesser general public license v2.1 gnu library general public license",
]
SCHEMA = "doc_id long, text string, labels string, others string, plain string, hits int, found int"


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, t, "x", "y", "z", 1, 2) for k, t in enumerate(TEXTS)], SCHEMA)
    return {r.doc_id: r for r in license_scan.scan(docs).collect()}


def test_equals_a_plain_model(found):
    for k, text in enumerate(TEXTS):
        w, base, labels, kept, score = model(text)
        r = found[k]
        assert (r.n_words, r.n_base, r.score) == (len(w), len(base), score), text
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == sorted({b for _, b in base}) and r.labels == sorted(labels), text
        assert sorted((d.first, d.last, d.priority, d.rule, d.label) for d in r.detections) == kept
        assert all(d.words.split() == w[d.first : d.last + 1] for d in r.detections)
        assert (r.others, r.plain, r.hits, r.found) == ("y", "z", 1, 2)
    assert found[7].labels == ["gpl-3.0"] and found[8].labels == ["mit"] and found[6].labels == ["cc-by", "cc-by-nc-4.0"]


def test_rules_are_hundreds_and_found_by_what_they_need():
    assert 200 <= len(RULES) < 1000 and [r.label for r in RULES[:3]] == [label for label, _ in BASE] and len(set(RULES)) == len(RULES)
    # A plain reading of every pattern: without its optional parts, the first choice of each token.
    for r in RULES:
        needed = re.sub(r"\(\?: [^ ]+\)\?", "", r.pattern)
        tokens = [t for t in re.findall(r" \(\?:(.*?)\)#\[0-9\]\+;(?!\)\{)", needed)]
        example = [re.sub(r"\[cs\]", "s", t.split("|")[0] if not t.startswith("(?:re)?") else "licensed") for t in tokens]
        assert r.word in example or any(re.fullmatch(t, r.word) for t in tokens), r
    assert sum(r.word in COMMON for r in RULES) < 10


def test_expressions():
    p = expression("(the) licen[cs]e *2 only")
    assert re.search(p, " the#0; licence#1; x#2; only#3;")[0].startswith(" the") and not re.search(p, " license#0; a#1; b#2; c#3; only#4;")
    assert keyword("(the) mit licen[cs]e text") == " mit licen" and word("mit licen[cs]e") == "license" and word("apache licen[cs]e") == "apache"


def test_priority_and_containment(spark):
    rule = lambda label, priority, p: Rule(label, priority, word(p), keyword(p), expression(p))
    rules = [rule("whole", 1, "alpha beta gamma delta"), rule("inner", 2, "beta gamma"), rule("part", 1, "gamma delta epsilon"), rule("twin", 2, "beta gamma"), rule("low", 1, "beta"), rule("end", 4, "delta epsilon")]
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "doc_id long, text string")
    r = license_scan.scan(docs, rules=rules).first()
    # inner outranks what contains it; twin has the same interval and comes later; low lies in both; part and end overlap, end lies in part but outranks it.
    assert [d.label for d in r.detections] == ["whole", "inner", "part", "end"] and r.score == 1.0


def test_long_text(spark):
    line = "Licensed under the MIT license. All rights reserved.\n"
    n = 60_000
    start = time.time()
    r = license_scan.scan(spark.createDataFrame([(1, line * n + " " * 1_000_000)], "doc_id long, text string")).first()
    assert (r.n_base, r.first_word, r.last_word, r.n_words) == (n, 5, 8 * n - 3, 8 * n) and len(r.detections) == 2 * n and r.labels == ["mit", "reserved"]
    assert time.time() - start < 60


def test_native(spark):
    plan = license_scan.digest(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_empty_table(spark):
    assert license_scan.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
