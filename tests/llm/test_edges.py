"""Odd rows through every operator and pipeline stage: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pytest

import corpus_pipeline
from fleetskein.llm import bpe_duckdb, katz, langid, minhash_oph, perspectives, quality_lines, registry, retrieval_packing, secrets_crf, sentence_spans, topk_svd

RANKS = registry.vocabulary("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, secrets string, cleaned string, component_id string, n_removed string, held string, rid string, a string"
LONG = " ".join(f"word{k} goes{k * 7} on." for k in range(30_000))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", None, 4),
    (None, "no id here, but words.", None, "s", 1),
    (None, None, None, None, None),
    (4, LONG, "en", "s", len(LONG)),
    (5, LONG, "en", "s", len(LONG)),
    (6, "same row twice is still two rows.", "en", "s", 33),
    (6, "same row twice is still two rows.", "en", "s", 33),
    (7, 'token = "0123456789abcdef0123456789abcdef" é', "de", "s", 44),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *"zzzzzzzz") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "katz": lambda d: katz.score_texts(d),
    "secrets": lambda d: secrets_crf.digest(d),
    "bpe": lambda d: bpe_duckdb.encode_decode(d, RANKS, registry.PATTERN),
    "langid": lambda d: langid.identify(d, RANKS),
    "minhash": lambda d: minhash_oph.near_duplicates(d),
    "spans": lambda d: sentence_spans.remove_repeats(d),
    "quality": lambda d: quality_lines.clean_lines(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row(odd, none, name):
    assert OPERATORS[name](odd).count() == len(ROWS)
    assert OPERATORS[name](none).count() == 0


def test_packing_of_odd_rows(odd, none):
    pack = lambda d: retrieval_packing.pack(d, registry.vocabulary("byte_bpe_50k.tiktoken"), registry.PATTERN)
    rows = pack(odd).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1 and sum(r.length for r in rows if r.doc_id == 6) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 6)
    assert sum(r.length for r in rows if r.doc_id == 4) == next(r.doc_tokens for r in rows if r.doc_id == 4)
    assert pack(none).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages(odd, none, spark, stage):
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, odd, "")
    if stage < 4:
        assert out.columns == odd.columns and out.schema.simpleString() == odd.schema.simpleString()
    found = [r.doc_id for r in out.collect()]
    if name == "quality":
        assert sorted(found) == [4, 5]
    if name == "near_dedup":
        assert 4 in found and 5 not in found and found.count(6) == 1
    if name == "secrets":
        assert len(found) == len(ROWS)
        assert '"[secret]"' in out.where("doc_id = 7").first().text or "[secret]" in out.where("doc_id = 7").first().text
    assert function(spark, none, "").count() == 0


def test_minhash_classes_of_odd_rows(odd):
    rows = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash_oph.near_duplicates(odd).collect()}
    assert rows[(1, 0)] == (1, True) and rows[(None, 0)] == (None, True)
    assert {v for (d, n), v in rows.items() if d == 5} == {(4, False)}


def test_turns(spark):
    schema = "conv_id long, turn long, role string, text string, part string, start long"
    turns = [(1, 1, "a", "x", "p", 1), (1, None, "b", "y", "p", 1), (1, 1, "a", "x", "p", 1), (None, 1, None, None, None, None), (2, 1, "a", "", "p", 0)]
    rows = {(r.conv_id, r.perspective): r for r in perspectives.dialogues(spark.createDataFrame(turns, schema)).collect()}
    assert rows[(1, "a")].text == "<|user:b|>\ny\n<|assistant|>\nx\n<|assistant|>\nx\n"
    assert [rows[(1, "a")].text[int(a) : int(b)] for a, b in (m.split(":") for m in rows[(1, "a")].masks.split(","))] == ["x\n", "x\n"]
    assert rows[(None, "unknown")].text == "<|assistant|>\n\n" and rows[(1, "b")].n_turns == 3
    assert perspectives.dialogues(spark.createDataFrame([], schema)).count() == 0


def test_long_dialogue_in_parts(spark):
    turns = spark.range(3000).selectExpr("1 AS conv_id", "id AS turn", "concat('r', id % 2) AS role", "repeat('w', 20) AS text")
    rows = perspectives.dialogues(turns, part_chars=5000).where("perspective = 'r0'").orderBy("part").collect()
    assert len(rows) > 10 and all(len(r.text) < 5050 for r in rows)
    assert [r.char_start for r in rows[1:]] == [r.char_start + len(r.text) for r in rows[:-1]]


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, rank string"
    rows = [(0, [1.0, 0.0], "z"), (1, [1.0, 2.0], "z"), (2, [1.0, -3.0], "z"), (2, [1.0, -3.0], "z"), (None, [9.0, 9.0], "z"), (3, None, "z"), (4, [float("nan"), 1.0], "z"), (5, [None, 1.0], "z"), (6, [2.0], "z"), (100, [0.0, 0.0], "z"), (7, [], "z")]
    found = [tuple(r) for r in topk_svd.top_k(spark.createDataFrame(rows, schema), k=4).collect()]
    one = 1024 * 1024
    assert sorted(found) == [(0, 1, 6, 2 * one), (0, 2, 1, one), (0, 3, 2, one), (0, 4, 2, one), *[(100, k + 1, i, 0) for k, i in enumerate([0, 1, 2, 2])]]
    assert topk_svd.top_k(spark.createDataFrame([], schema)).count() == 0
