"""JSON typing on VARIANT columns.

Transcript fields change type between records, so a field counts as a string only if it *is* one: a plain string extraction
would turn the number 5 into the text ``5``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closes the wrapped document. The built-in parser stops after the first value and ignores what follows, so a damaged line such as
# two records run together would pass; inside an array the next element must be this mark.
END_MARK = "end-of-record-5b1c9e"
ROOT = "$[0]"

RFC3339 = r"\A\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})\z"


def parse(text: Column) -> Column:
    """VARIANT array ``[document, mark]``; null if the text does not even start with a JSON document."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END_MARK}"]')))


def well_formed(v: Column) -> Column:
    """Was the parsed text exactly one JSON document?"""
    return F.coalesce(F.try_variant_get(v, "$[1]", "string") == END_MARK, F.lit(False))


def parse_strict(text: Column) -> Column:
    """``parse``, with null for anything but one JSON document."""
    v = parse(text)
    return F.when(well_formed(v), v)


def get(v: Column, path: str = "") -> Column:
    """Field as VARIANT; SQL null only if the field is absent."""
    return F.try_variant_get(v, f"{ROOT}{path}", "variant")


def type_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return F.coalesce(type_of(value) == "STRING", F.lit(False))


def as_string(value: Column) -> Column:
    """The text if the value is a JSON string, else null."""
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def as_long(value: Column) -> Column:
    """The number if the value is a JSON integer in the 64-bit range, else null."""
    return F.when(type_of(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def string_at(v: Column, path: str) -> Column:
    return as_string(get(v, path))


def long_at(v: Column, path: str) -> Column:
    return as_long(get(v, path))


def item_string(item: Column, path: str) -> Column:
    """String field of an array element."""
    return as_string(F.try_variant_get(item, f"${path}", "variant"))


def item_long(item: Column, path: str) -> Column:
    return as_long(F.try_variant_get(item, f"${path}", "variant"))


def content_text(value: Column) -> Column:
    """Message content: empty if absent, the string itself, or compact JSON with sorted keys."""
    return (
        F.when(value.isNull(), F.lit(""))
        .when(is_string(value), F.try_variant_get(value, "$", "string"))
        .when(F.is_variant_null(value), F.lit("null"))
        .otherwise(F.to_json(value))
    )


def digits_to_long(text: Column) -> Column:
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def iso_to_ms(text: Column) -> Column:
    """RFC 3339 text to epoch milliseconds, null for anything else."""
    return F.when(text.rlike(RFC3339), F.unix_millis(F.try_to_timestamp(F.upper(text))))


def timestamp_any(value: Column) -> Column:
    """Integer, digit string or RFC 3339 string to epoch milliseconds."""
    text = as_string(value)
    return F.coalesce(as_long(value), digits_to_long(text), iso_to_ms(text))


def timestamp_number(value: Column) -> Column:
    """Integer or digit string only."""
    return F.coalesce(as_long(value), digits_to_long(as_string(value)))


def string_array(text: Column) -> Column:
    """JSON text to ``array<string>``; null unless it is an array of strings only."""
    items = as_array(get(parse_strict(text)))
    return F.when(F.forall(items, is_string), F.transform(items, as_string))


def text_blocks(text: Column) -> Column:
    """The ``text`` blocks of a JSON content array, joined by newlines; null if that is empty."""
    items = as_array(get(parse_strict(text)))
    blocks = F.filter(
        items,
        lambda x: (item_string(x, ".type") == "text") & item_string(x, ".text").isNotNull(),
    )
    return F.nullif(F.array_join(F.transform(blocks, lambda x: item_string(x, ".text")), "\n"), F.lit(""))


def computed_once(df: DataFrame, keep: list[str], **fields: Column) -> DataFrame:
    """``keep`` plus ``fields``, as the single element of an exploded array.

    A later filter on a field would otherwise be rewritten onto the field's definition and pushed below it, which evaluates
    the definition a second time; a filter cannot pass the generator that makes the field.
    """
    made = F.struct(*[c.alias(name) for name, c in fields.items()])
    return df.select(*keep, F.explode(F.array(made)).alias("__f")).select(*keep, *[F.col(f"__f.{n}") for n in fields])
