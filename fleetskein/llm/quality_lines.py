"""Line-first cleaning with built-in functions only.

Every line is judged on its own: end punctuation, navigation, boilerplate. Failing
lines go; a document that loses too much of its text goes as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE_RUN = "[^\\x20\\x09-\\x0D]"
#: Fixed values of the line rules, as RE2 and Java both read them.
END = "[.!?:;\"'”’»…。！？)\\]]$"
SEPARATOR = "[|»›•·]"
NAVIGATION = (
    "(?i)^(home|menu|login|log in|sign in|sign up|register|next|previous|back|top|search|share|reply|print|"
    "read more|click here|subscribe|contact|contact us|about|about us|sitemap|site map|skip to content)[ .!:>]*$"
)
BOILERPLATE = (
    "(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses? cookies|"
    "enable javascript|javascript is (disabled|required)|lorem ipsum|powered by|copyright (©|\\(c\\))|"
    "licensed under|permission is hereby granted|without warrant(y|ies) of any kind)"
)
#: Texts without any of these, lower-cased, hold no boilerplate.
STEMS = ("reserved", "terms of", "policy", "cookies", "javascript", "lorem", "powered by", "copyright", "licensed", "hereby", "warrant")
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: F.length(w) > 0)


def n_words(text: Column) -> Column:
    """Number of words: a blank stands for every run of spaces, one more word than inner blanks."""
    plain = F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")
    return F.when(F.length(plain) == 0, F.lit(0)).otherwise(F.length(plain) - F.length(F.translate(plain, " ", "")) + 1).cast("long")


def line_fails(line: Column, boilerplate: Column, max_separators: int = 3, max_symbol_share: float = 0.15, min_open_words: int = 4) -> Column:
    """True for a line that one of the three rules removes. Lines without a word never fail.

    An open line (without an end mark) of few words, many symbols, navigation, or, where the text may hold any (``boilerplate``), a
    boilerplate phrase. Cheap conditions stand first.
    """
    bare = F.trim(line, F.lit(BLANKS))
    symbols = F.regexp_count(line, F.lit(f"[{SYMBOLS}]"))
    size = F.length(F.regexp_replace(bare, SPACE, ""))
    open_line = ~F.right(bare, F.lit(1)).rlike(END) & (F.regexp_count(bare, F.lit(NOT_SPACE_RUN + "+")) < min_open_words)
    many_symbols = (symbols > 0) & (symbols > size * max_symbol_share)
    navigation = (F.regexp_count(line, F.lit(SEPARATOR)) >= max_separators) | bare.rlike(NAVIGATION)
    return (bare != "") & (open_line | many_symbols | navigation | (boilerplate & line.rlike(BOILERPLATE)))


def may_hold_boilerplate(text: Column) -> Column:
    """False for texts without any stem of the boilerplate phrases; one look at the text instead of one per line."""
    stems = F.array(*[F.lit(s) for s in STEMS])
    return F.element_at(F.transform(F.array(F.lower(text)), lambda low: F.exists(stems, lambda s: F.contains(low, s))), 1)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with struct ``_m`` of counts; input columns stay as they are.

    Null text counts as empty. Each text is split once; arrays are bound as lambda
    variables, so that no step is evaluated again per element.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    blank = F.regexp_replace(whole, SPACE, "")
    return docs.withColumn(
        "_m",
        F.element_at(
            F.transform(
                F.array(F.struct(words_of(whole).alias("w"), F.split(whole, "\n").alias("l"), may_hold_boilerplate(whole).alias("b"))),
                lambda s: F.struct(
                    F.size(s["w"]).cast("long").alias("n_words"),
                    F.length(blank).cast("long").alias("word_chars"),
                    F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
                    _repeated_lines(s["l"]).alias("n_dup_lines"),
                    _repeated_words(s["w"]).alias("n_repeat_words"),
                    F.array_join(F.filter(s["l"], lambda x: ~line_fails(x, s["b"])), "\n").alias("cleaned"),
                ),
            ),
            1,
        ),
    )


def _repeated_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    kept = F.filter(lines, lambda x: x.rlike(NOT_SPACE_RUN))
    return F.element_at(F.transform(F.array(kept), lambda k: F.size(k) - F.size(F.array_distinct(k))), 1).cast("long")


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    The windows are counted by hash first; only a text with an equal pair sorts its
    windows by (content, position). Repeated windows are then compared as words.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)),
    )
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        F.element_at(F.transform(F.array(windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h, words))), 1)
    )


def _covered(hashes: Column, words: Column) -> Column:
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(pairs: Column) -> Column:
        # Equal hashes stand side by side; only there are the words themselves looked at.
        near = F.filter(
            F.transform(pairs, lambda x, j: F.struct(x["i"].alias("i"), x["h"].alias("h"), F.coalesce(F.get(pairs, j - 1)["h"] == x["h"], F.lit(False)).alias("b"), F.coalesce(F.get(pairs, j + 1)["h"] == x["h"], F.lit(False)).alias("a"))),
            lambda x: x["a"] | x["b"],
        )
        return F.array_sort(F.transform(near, lambda x: F.struct(window(x["i"]).alias("w"), x["i"].alias("i"))))

    def positions(near: Column) -> Column:
        return F.array_sort(
            F.transform(
                F.filter(
                    F.transform(near, lambda x, j: F.struct(x["i"].alias("i"), (F.coalesce(F.get(near, j - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(near, j + 1)["w"] == x["w"], F.lit(False))).alias("t"))),
                    lambda x: x["t"],
                ),
                lambda x: x["i"],
            )
        )

    bind = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    start = F.struct(F.lit(-3).alias("p"), F.lit(0).cast("long").alias("n"))
    total = lambda at: F.aggregate(at, start, lambda a, i: F.struct(i.alias("p"), (a["n"] + F.least(F.lit(3), i - a["p"])).alias("n")), lambda a: a["n"])
    return bind(ordered, lambda p: bind(repeated(p), lambda near: total(positions(near))))


def clean_lines(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat: float = 0.5, max_loss: float = 0.3) -> DataFrame:
    """Line-first cleaning; ``docs`` plus ``cleaned``, ``base_failed``, ``kept`` and the counts.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat`` of them in
    repeated 3-word windows. ``kept``: not base_failed, and the removed lines held at
    most ``max_loss`` of the words. Null or empty text has no words, so it fails; every
    input row gives one row, repeated rows and null ids included. Result columns that
    clash with input columns replace them.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned", "base_failed", "kept"]
    kept_columns = [c for c in docs.columns if c not in names or c == text]
    out = measured(docs.select(*[F.col(f"`{c}`") for c in kept_columns]), text)
    m = F.col("_m")
    failed = (m["n_words"] < min_words) | (m["n_repeat_words"] > m["n_words"] * max_repeat)
    lost = m["n_words"] - n_words(m["cleaned"])
    return out.select(
        *[F.col(f"`{c}`") for c in kept_columns if c not in names],
        *[m[c].alias(c) for c in names[:6]],
        failed.alias("base_failed"),
        (~failed & (lost <= m["n_words"] * max_loss)).alias("kept"),
    )
