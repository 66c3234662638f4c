"""JSON access, map merging and lenient number parsing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

_NUMBER_CHARS = r"^[0-9+\-.eE]+$"


def json_text(doc: Column, key: str) -> Column:
    """``doc ->> key``: the member as text, NULL when absent or JSON null."""
    return F.get_json_object(doc, f"$['{key}']")


def json_bigint(doc: Column, key: str) -> Column:
    """Exact 64-bit member; text that is not an integer gives NULL."""
    return json_text(doc, key).try_cast("bigint")


_STRICT = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "unread",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}


def with_document(df: DataFrame, source: str, name: str, ddl: str) -> DataFrame:
    """Read JSON text strictly: add struct ``name`` with ``value`` (of type ``ddl``) and ``ok``.

    Spark's reader ignores what follows the first value. The text is therefore read
    as an object member with a sentinel behind it, and must also count as exactly
    one array item; no text with something behind its value passes both.

    The generator keeps Catalyst from copying the parser into every later
    expression that touches the result, so each text is parsed once.
    """
    text = F.col(source)
    wrapped = F.concat(F.lit('{"value":'), text, F.lit(',"end":1}'))
    read = F.from_json(wrapped, f"value {ddl}, end bigint, unread string", _STRICT)
    raw = f"_{name}"
    parsed = df.withColumn(raw, F.explode(F.array(read)))
    one_item = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    ok = one_item & F.col(f"{raw}.unread").isNull() & (F.col(f"{raw}.end") == 1)
    result = F.struct(F.col(f"{raw}.value").alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))
    return parsed.withColumn(name, result).drop(raw)


def is_json_value(text: Column) -> Column:
    """The text is one JSON value with nothing behind it."""
    as_item = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    as_member = F.get_json_object(F.concat(F.lit('{"p":'), text, F.lit(',"end":1}')), "$.end") == "1"
    return F.coalesce(as_item & as_member, F.lit(False))


_NAME_WITH_CAPITAL = r'"[^"\\]*[A-Z][^"\\]*"\s*:'


def exact_names(text: Column, names: Iterable[str], inner: dict[str, Iterable[str]] | None = None) -> Column:
    """JSON object text whose members called like ``names`` in another case get the name given there.

    ``inner`` lists the member names of nested objects. Of members that so become equal the last one stays.
    Text without a capital in any name, and text that is not one JSON object, comes back as it is.
    """
    inner = inner or {}

    def respelled(members: Column, wanted: Iterable[str]) -> Column:
        spelling = F.create_map(*[F.lit(x) for name in wanted for x in (name.lower(), name)])
        named = F.transform(
            F.map_entries(members),
            lambda m: F.struct(F.coalesce(spelling[F.lower(m["key"])], m["key"]).alias("key"), m["value"].alias("value")),
        )
        keys = F.transform(named, lambda m: m["key"])
        return F.filter(named, lambda m, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), m["key"]))

    def joined(members: Column, value) -> Column:
        return F.concat(F.lit("{"), F.array_join(F.transform(members, value), ","), F.lit("}"))

    def plain(m: Column) -> Column:
        one = F.to_json(F.create_map(m["key"], m["value"]))
        return F.substr(one, F.lit(2), F.length(one) - 2)

    def member(m: Column) -> Column:
        out = plain(m)
        for name, wanted in inner.items():
            nested = joined(respelled(F.try_variant_get(m["value"], "$", "map<string,variant>"), wanted), plain)
            is_object = F.schema_of_variant(m["value"]).startswith("OBJECT")
            out = F.when((m["key"] == name) & is_object, F.concat(F.lit(f'"{name}":'), nested)).otherwise(out)
        return out

    members = F.from_json(text, "map<string,variant>", _STRICT)
    other = text.rlike(_NAME_WITH_CAPITAL) & F.ltrim(text).startswith("{") & is_json_value(text)
    return F.when(other, F.coalesce(joined(respelled(members, names), member), text)).otherwise(text)


def number_or_null(text: Column) -> Column:
    """Decimal number text as double. The pattern keeps out forms only the cast takes, such as ``1.0d`` or `` 1``."""
    return F.when(text.rlike(_NUMBER_CHARS), text.try_cast("double"))


def number_or_zero(text: Column) -> Column:
    return F.coalesce(number_or_null(text), F.lit(0.0))


def merge_maps(left: Column, right: Column) -> Column:
    """Keys of both maps; the right side wins."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(
        F.coalesce(left, empty), F.coalesce(right, empty), lambda _key, old, new: F.coalesce(new, old)
    )


def canonical_json(text_map: Column) -> Column:
    """A ``map<string,string>`` as JSON text with sorted keys; NULL counts as empty."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(text_map)))
    return F.coalesce(F.to_json(ordered), F.lit("{}"))


def non_empty(map_or_text: Column) -> Column:
    """NULL for an empty map, so that JSON output leaves the field out."""
    return F.when(F.size(map_or_text) > 0, map_or_text)
