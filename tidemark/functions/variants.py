"""JSON objects held in text, read through the VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.text import as_column


def json_object(text: Column | str) -> Column:
    """VARIANT object: the whole text, else the span from the first { to the last }.

    Text that is JSON but no object gives null, also when it holds an object. Of a key that the
    object repeats the last member counts; inside its members a repeated key is refused.
    """
    raw = as_column(text)
    span = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    whole, inner = F.try_parse_json(raw), F.try_parse_json(span)
    listed = raw.rlike(r"(?s)^\s*\[.*\]\s*$")
    return F.when(raw.rlike(r"^\s*\{"), F.coalesce(whole, inner, _last_members(span))).when(
        whole.isNull(), F.coalesce(inner, F.when(~listed, _last_members(span)))
    )


def _last_members(span: Column) -> Column:
    """The object that a span is, with the last member of each key; null if it is none."""
    # As the one item of a list, so that nothing may follow the object.
    items = F.from_json(F.concat(F.lit("["), span, F.lit("]")), "array<map<string,variant>>")
    entries = F.map_entries(F.get(items, F.lit(0)))

    def is_last(entry: Column, place: Column) -> Column:
        rest = F.slice(entries, place + 2, F.size(entries))
        return ~F.exists(rest, lambda later: later["key"] == entry["key"])

    return F.when(F.size(items) == 1, F.to_variant_object(F.map_from_entries(F.filter(entries, is_last))))


def member(value: Column, key: str) -> Column:
    """Member as VARIANT; SQL null when absent, a VARIANT null when JSON null."""
    return F.try_variant_get(value, f"$.{key}", "variant")


def member_schema(value: Column, key: str) -> Column:
    return F.schema_of_variant(member(value, key))


def schema_kind(schema: Column) -> Column:
    """absent, null, boolean, integer, number, string or other, from a VARIANT's schema."""
    return (
        F.when(schema.isNull(), "absent")
        .when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "BIGINT", "integer")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "number")
        .when(schema == "STRING", "string")
        .otherwise("other")
    )


def member_text(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "string")
