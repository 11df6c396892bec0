"""Shape blocks in Turtle: a strict check of their grammar and their triples, as column expressions.

The subset has statements with predicate and object lists, nested blank nodes (up to DEPTH levels),
collections, literals with language or type, and prefix lines. A block is cut into tokens by one
pattern; each token gets a letter for its kind, and the grammar is a pattern over these letters, from
which blank nodes and collections are taken out from the inside. Members of collections give no triples.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.functions.columns import let

DEPTH = 8
TOKEN = (
    r'(?s)"""(?:[^"\\]++|\\.|"{1,2}(?!"))*+"""'
    r'|"[^"\\\n\r]*+(?:\\.[^"\\\n\r]*+)*+"'
    r"|'[^'\\\n\r]*+(?:\\.[^'\\\n\r]*+)*+'"
    r'|<[^<>"{}|^`\\\s]*+>|#[^\n]*+|\s++|@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^'
    r"|_:\w[\w-]*|(?:[A-Za-z][\w-]*)?:(?:[\w:%.-]*[\w:%-])?"
    r"|[+-]?(?:\d+\.\d+|\.?\d+)(?:[eE][+-]?\d+)?|[A-Za-z]\w*|."
)
# letters: P name, B blank node, S string, O other object, a, K prefix line, L language, T type mark
LIST = "[aP][PBO](?:,[PBO])*(?:;+[aP][PBO](?:,[PBO])*)*;*"
INNERMOST = rf"\[(?:{LIST})?\]"
COLLECTION = r"\([PBO]*\)"
WHOLE = rf"^(?:P{LIST}\.|B(?:{LIST})?\.)*$"

TRIPLES = "array<struct<s:string,p:string,o:string,kind:string>>"


def tokens(text: Column) -> Column:
    """(text, kind) of all tokens but blanks and comments."""
    found = F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^(\s|#)"))

    def kind(t: Column) -> Column:
        quoted = (F.length(t) > 1) & t.rlike("^[\"']") & (F.substring(t, 1, 1) == F.substring(t, -1, 1))
        return (
            F.when(quoted, "S").when(t.rlike("^<.*>$"), "P").when(F.lower(t) == "@prefix", "K")
            .when(t.rlike("^@."), "L").when(t == "^^", "T").when(t.startswith("_:"), "B")
            .when(t.contains(":"), "P").when(t.rlike(r"^[+-]?\.?\d") | t.isin("true", "false"), "O")
            .when(t.isin("a", "[", "]", "(", ")", ";", ",", "."), t).otherwise("X")
        )

    return F.transform(found, lambda t, i: F.struct(t.alias("t"), kind(t).alias("k"), i.alias("i")))


def prefixes(config: Config) -> Column:
    known = (
        ("rdf", v.NS_RDF), ("rdfs", v.NS_RDFS), ("sh", v.NS_SHACL), ("xsd", v.NS_XSD),
        ("deontic", v.NS_DEONTIC), (config.prefix, config.namespace),
    )
    return F.array(*(F.struct(F.lit(n + ":").alias("name"), F.lit(iri).alias("iri")) for n, iri in known))


def declared(found: Column) -> Column:
    """Prefix lines of the block itself."""
    lines = F.filter(found, lambda t: t["k"] == "K")

    def line(t: Column) -> Column:
        iri = F.get(found, t["i"] + 2)["t"]
        name = F.get(found, t["i"] + 1)["t"]
        return F.struct(name.alias("name"), F.substring(iri, F.lit(2), F.length(iri) - 2).alias("iri"))

    return F.transform(lines, line)


def well_formed(text: Column, config: Config) -> Column:
    """Whether a block is a list of whole statements, names with known prefixes, and a node shape."""

    def checked(found: Column) -> Column:
        letters = F.array_join(F.transform(found, lambda t: t["k"]), "")
        plain = F.regexp_replace(F.regexp_replace(letters, "S(?:L|TP)?", "O"), r"KPP\.", "")

        def inward(rest: Column, _: Column) -> Column:
            return F.regexp_replace(F.regexp_replace(rest, INNERMOST, "B"), COLLECTION, "O")

        statements = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), plain, inward)
        names = F.filter(found, lambda t: (t["k"] == "P") & ~t["t"].startswith("<"))
        known = F.concat(declared(found), prefixes(config))
        strange = F.exists(names, lambda t: ~F.exists(known, lambda p: p["name"] == prefix_of(t["t"])))
        shape = F.exists(found, lambda t: t["t"].isin("sh:NodeShape", f"<{v.NS_SHACL}NodeShape>"))
        return statements.rlike(WHOLE) & ~strange & shape

    return F.coalesce(let(tokens(text), checked), F.lit(False))


def prefix_of(name: Column) -> Column:
    return F.concat(F.substring_index(name, ":", 1), F.lit(":"))


def expanded(t: Column, known: Column) -> Column:
    """A token as (value, kind): full names, strings without quotes."""
    text = t["t"]
    name = F.get(F.filter(known, lambda p: p["name"] == prefix_of(text)), F.lit(0))["iri"]
    quote = F.when(text.startswith('"""'), 3).otherwise(1)
    inner = F.substring(text, quote + 1, F.length(text) - 2 * quote)
    iri = (t["k"] == "P") | (t["k"] == "a")
    value = (
        F.when(t["k"] == "a", v.RDF_TYPE).when(text.startswith("<"), F.substring(text, F.lit(2), F.length(text) - 2))
        .when(t["k"] == "P", F.concat(F.coalesce(name, F.lit("")), F.substring(text, F.length(prefix_of(text)) + 1, F.length(text))))
        .when(t["k"] == "S", F.regexp_replace(inner, r"\\([\"'\\])", "$1")).otherwise(text)
    )
    kind = F.when(iri, "iri").when(t["k"].isin("B", "["), "bnode").otherwise("literal")
    return F.struct(value.alias("value"), kind.alias("kind"))


def triples(text: Column, config: Config) -> Column:
    """(s, p, o, kind) of a well-formed block, read token by token with a stack of open subjects."""
    nothing = F.lit(None).cast("string")
    start = F.struct(
        F.array(nothing).alias("subjects"), F.array(nothing).alias("verbs"), F.lit(0).alias("mute"),
        F.lit(0).alias("deep"), F.array().cast(TRIPLES).alias("out"),
    )

    def state(s: Column, **new: Column) -> Column:
        fields = ("subjects", "verbs", "mute", "deep", "out")
        return F.struct(*(new.get(f, s[f]).alias(f) for f in fields))

    def top(stack: Column) -> Column:
        return F.element_at(stack, F.lit(-1))

    def under(stack: Column) -> Column:
        return F.slice(stack, F.lit(1), F.size(stack) - 1)

    def put(stack: Column, value: Column) -> Column:
        return F.array_append(under(stack), value)

    def read(known: Column):
        def step(s: Column, t: Column) -> Column:
            k, subject, verb = t["k"], top(s["subjects"]), top(s["verbs"])
            term = expanded(t, known)
            value = F.when(k == "[", F.concat(F.lit("_:b"), t["i"])).when(k == "(", "()").otherwise(term["value"])
            made = F.struct(subject.alias("s"), verb.alias("p"), value.alias("o"), term["kind"].alias("kind"))
            added = F.array_append(s["out"], made)
            is_object = subject.isNotNull() & verb.isNotNull()
            placed = (
                F.when(is_object, state(s, out=added))
                .when(subject.isNull(), state(s, subjects=put(s["subjects"], value)))
                .otherwise(state(s, verbs=put(s["verbs"], value)))
            )

            def opened(after: Column) -> Column:
                return state(
                    after,
                    subjects=F.array_append(after["subjects"], value),
                    verbs=F.array_append(after["verbs"], nothing),
                )

            return (
                F.when(s["mute"] > 0, state(s, mute=s["mute"] - 1))
                .when(k == "K", state(s, mute=F.lit(3)))
                .when(k == "T", state(s, mute=F.lit(1)))
                .when(k == "L", s)
                .when(k == ")", state(s, deep=s["deep"] - 1))
                .when((k == "(") & (s["deep"] > 0), state(s, deep=s["deep"] + 1))
                .when(s["deep"] > 0, s)
                .when(k == "(", let(placed, lambda after: state(after, deep=F.lit(1))))
                .when(k == "[", let(placed, opened))
                .when(k == "]", state(s, subjects=under(s["subjects"]), verbs=under(s["verbs"])))
                .when(k == ";", state(s, verbs=put(s["verbs"], nothing)))
                .when(k == ",", s)
                .when(k == ".", state(s, subjects=F.array(nothing), verbs=F.array(nothing)))
                .otherwise(placed)
            )

        return step

    def all_of(found: Column) -> Column:
        known = F.concat(declared(found), prefixes(config))
        return let(known, lambda names: F.aggregate(found, start, read(names), lambda s: s["out"]))

    return let(tokens(text), all_of)
