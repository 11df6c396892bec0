"""JSON objects embedded in free response text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark.functions.columns import computed, let

#: pieces of a text as JSON sees it from an opening brace on: whole strings, braces, the rest
PIECES = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}]|[^{}"]++|"'
STRINGS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: the first object when its braces close within one level of inner objects; braces in strings do not count
_INNER = r'[^{}"]++|"[^"\\]*+(?:\\.[^"\\]*+)*+"'
FLAT_FIRST = rf"(?s)^[^{{]*+(\{{(?:{_INNER}|\{{(?:{_INNER})*+\}})*+\}})"
#: how every JSON object starts
OBJECT_START = r'^\{\s*["}]'


def decodes(text: Column) -> Column:
    """Whether a text that starts with a brace is one JSON object; NaN and Infinity are numbers."""
    read = F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    other_infinity = F.regexp_replace(text, STRINGS, "").rlike(r"\bINF\b|\+I")
    return read.isNotNull() & ~other_infinity


def balanced(tail: Column) -> Column:
    """The text from its first brace to the one that closes it, braces inside strings left out of account;
    null where nothing closes it."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        at = state["at"] + F.length(piece)
        moved = F.struct(at.alias("at"), depth.alias("depth"), F.when(depth == 0, at).otherwise(0).alias("end"))
        return F.when(state["end"] > 0, state).otherwise(moved)

    end = F.aggregate(F.regexp_extract_all(tail, F.lit(PIECES), F.lit(0)), start, step, lambda s: s["end"])
    return let(end, lambda n: F.when(n > 0, F.substring(tail, F.lit(1), n)))


def first_object(raw: Column) -> Column:
    """The first {...} that decodes, tried from every opening brace in turn, or null."""
    count = F.length(raw) - F.length(F.replace(raw, F.lit("{"), F.lit("")))

    def tried(found: Column, i: Column) -> Column:
        at = F.length(F.call_function("substring_index", raw, F.lit("{"), i)) + 1
        text = let(F.substring(raw, at, F.length(raw)), lambda t: F.when(t.rlike(OBJECT_START), balanced(t)))
        return F.coalesce(found, let(text, lambda t: F.when(decodes(t), t)))

    starts = F.filter(F.sequence(F.lit(0), count), lambda i: i > 0)
    return F.aggregate(starts, F.lit(None).cast("string"), tried)


def flat_object(raw: Column) -> Column:
    """The first {...} when it is at most one object deep and decodes, or null."""
    return let(
        F.nullif(F.regexp_extract(raw, FLAT_FIRST, 1), F.lit("")),
        lambda flat: F.when(flat.rlike(OBJECT_START) & F.try_parse_json(flat).isNotNull(), flat),
    )


def with_object(rows: DataFrame, raw: str, name: str) -> DataFrame:
    """Add the text of the first decodable {...} of a response, or null.

    Most responses start with one shallow object; only others are scanned brace by brace.
    """
    flat = computed(rows, _flat=flat_object(F.col(raw)))
    found = F.coalesce("_flat", F.when(F.col(raw).contains("{"), first_object(F.col(raw))))
    return computed(flat, **{name: found}).drop("_flat")


def missing_reason(raw: Column, found: Column) -> Column:
    """Why no object was found: json_decode_error or parse_error; null when one was."""
    return F.when(
        found.isNull(),
        F.when(raw.contains("{"), "json_decode_error").otherwise("parse_error"),
    )


def greedy_object(raw: Column) -> Column:
    """Everything from the first '{' to the last '}', or null."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))


def truthy(text: Column) -> Column:
    """Whether a JSON scalar, given as text, counts as true."""
    return F.coalesce(~F.lower(text).isin("false", "0", "0.0", "", "null"), F.lit(False))


def plain_text(value: Column) -> Column:
    """A VARIANT predicate value as text.

    Lists are joined by blanks, objects give their value, name, text or label, else their strings
    joined in key order; nothing gives ''.
    """

    def opened(found: Column) -> Column:
        kind, val = found["kind"], found["val"]
        fields = F.try_variant_get(val, "$", "map<string,variant>")
        named = F.coalesce(
            *[F.try_variant_get(val, f"$.{k}", "string") for k in ("value", "name", "text", "label")]
        )
        strings = F.filter(
            F.map_entries(fields), lambda e: F.schema_of_variant(e["value"]) == "STRING"
        )
        joined = F.array_join(F.transform(strings, lambda e: e["value"].cast("string")), " ")
        listed = F.array_join(F.try_variant_get(val, "$", "array<string>"), " ", "None")
        scalar = F.try_variant_get(val, "$", "string")
        return (
            F.when(kind == "VOID", "")
            .when(kind == "STRING", scalar)
            .when(kind.startswith("ARRAY"), listed)
            .when(kind.startswith("OBJECT"), F.coalesce(named, joined))
            .when(kind == "BOOLEAN", F.when(scalar == "true", "True").otherwise(""))
            .when(scalar.try_cast("double") == 0, "")
            .otherwise(F.coalesce(scalar, F.lit("")))
        )

    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    return let(F.struct(value.alias("val"), kind.alias("kind")), opened)
