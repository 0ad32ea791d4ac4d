"""Values typed by their text, JSON encode/decode, identifier and list texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_PATTERN = (
    r"^[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)$"
)


def infer(text: Column) -> Column:
    """Struct `kind, v_bool, v_int, v_double, v_text` for a parameter given as text."""
    low = F.lower(text)
    trimmed = F.trim(low)
    kind = (
        F.when(text.isNull() | text.isin("None", "null"), "null")
        .when(low.isin("true", "false"), "bool")
        .when(text.rlike(r"^-?[0-9]+$"), "int")
        .when(trimmed.rlike(FLOAT_PATTERN), "double")
        .otherwise("text")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "bool", low == "true").alias("v_bool"),
        F.when(kind == "int", text.try_cast("bigint")).alias("v_int"),
        F.when(kind == "double", F.regexp_replace(trimmed, "_", "").try_cast("double")).alias("v_double"),
        F.when(kind != "null", text).alias("v_text"),
    )


def encode_json(value: Column) -> Column:
    """Any value to JSON text (scalars too); null stays null."""
    boxed = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(boxed, F.lit(2), F.length(boxed) - 2))


#: Marks the end of a text inside a list; a text that contains it takes the slower test.
END_MARK = "flowlens:end"


def parse_json(text: Column) -> Column:
    """JSON text to VARIANT, null when it is not exactly one JSON value.

    The built-in parser stops after the first value and ignores what follows. In `[text, mark]` the
    mark is the second and last element only when the text is one whole value.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END_MARK}"]')))
    whole = (F.try_variant_get(listed, "$[1]", "string") == END_MARK) & F.variant_get(listed, "$[2]", "variant").isNull()
    boxed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.when(text.contains(END_MARK), F.when(alone, F.variant_get(boxed, "$.v", "variant"))).when(
        whole, F.variant_get(listed, "$[0]", "variant")
    )


def decode_json(text: Column) -> Column:
    """JSON text to VARIANT; text that is not JSON is kept as a string value."""
    quoted = F.concat(
        F.lit('"'),
        F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"'),
        F.lit('"'),
    )
    return F.coalesce(parse_json(text), F.try_parse_json(quoted))


def identifier(text: Column) -> Column:
    """A valid identifier: other characters become `_`, a leading digit gets a `_` before it."""
    clean = F.regexp_replace(text, "[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def join_nested(values: Column, sep: str) -> Column:
    """A flat array of texts joined by `sep`; a null prints `None`. For lists of any depth see `outputs.join_lists`."""
    return F.array_join(values, sep, "None")


def display_name(name: Column, shard: Column, attempt: Column) -> Column:
    """`step (shard-2, attempt-3)`."""
    opts = F.array_compact(
        F.array(
            F.when(shard >= 0, F.concat(F.lit("shard-"), shard.cast("string"))),
            F.when(attempt > 1, F.concat(F.lit("attempt-"), attempt.cast("string"))),
        )
    )
    return F.when(F.size(opts) > 0, F.concat(name, F.lit(" ("), F.array_join(opts, ", "), F.lit(")"))).otherwise(name)
