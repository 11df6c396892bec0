"""Formulas to shapes: constraints, Turtle text, overrides, response shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.functions import turtle
from normspark.functions.columns import computed, first_contained, local_name, strip
from normspark.operators.align import text_class
from normspark.operators.keyed import lookup
from normspark.operators.responses import DIRECT_VERSION, request_key

DIRECT_REQUEST_KIND = "direct_shacl"


def min_count(deontic_type: Column) -> Column:
    return F.when(deontic_type == "prohibition", F.lit(None).cast("int")).otherwise(
        F.when(deontic_type == "permission", 0).otherwise(1)
    )


def max_count(deontic_type: Column) -> Column:
    return F.when(deontic_type == "prohibition", 0)


def severity(deontic_type: Column, confidence: Column) -> Column:
    """Info for permissions and weak rules, Warning from 0.6, Violation from 0.85."""
    return (
        F.when(deontic_type == "permission", "Info")
        .when(confidence >= v.SEVERITY_VIOLATION, "Violation")
        .when(confidence >= v.SEVERITY_WARNING, "Warning")
        .otherwise("Info")
    )


def datatype(path: Column) -> Column:
    """Value type named by the path, or null."""
    return first_contained(F.lower(path), v.DATATYPES)


def value_pattern(path: Column) -> Column:
    return first_contained(F.lower(path), v.VALUE_PATTERNS)


def shape_name(rule_id: Column) -> Column:
    return F.concat(F.replace(rule_id, F.lit("-"), F.lit("_")), F.lit("Shape"))


def message(text: Column) -> Column:
    one_line = F.translate(text, "\n\r", "  ")
    return F.substring(F.replace(one_line, F.lit('"'), F.lit("'")), 1, v.MESSAGE_CHARS)


def built(formulas: DataFrame, config: Config) -> DataFrame:
    """One shape with one property per formula that has a class and a path."""
    kind = F.col("deontic_type")
    weight = F.col("confidence") if config.severity_by_confidence else F.lit(1.0)
    person = F.col("target_class") == v.DEFAULT_CLASS
    name = shape_name(F.col("rule_id"))
    return formulas.filter(
        F.col("prop_path").isNotNull() & F.col("target_class").isNotNull()
    ).withColumns(
        {
            "shape_name": name,
            "shape_id": F.concat(F.lit(config.namespace), name),
            "prop_name": F.concat(name, F.lit("_prop1")),
            "target_kind": F.when(person, "subjects_of").otherwise("class"),
            "target_name": F.when(person, F.col("prop_path")).otherwise(F.col("target_class")),
            "severity": severity(kind, weight),
            "min_count": min_count(kind),
            "max_count": max_count(kind),
            "datatype": datatype(F.col("prop_path")),
            "pattern": value_pattern(F.col("prop_path")),
            "message": message(F.col("text")),
            "generation_method": F.lit(v.METHOD_FORMULA),
            "syntax_valid": F.lit(True),
        }
    )


def rendered(shapes: DataFrame, config: Config) -> DataFrame:
    """turtle_text of each built shape."""
    p = config.prefix + ":"
    target = F.concat(
        F.when(F.col("target_kind") == "class", "sh:targetClass ").otherwise(
            "sh:targetSubjectsOf "
        ),
        F.lit(p),
        F.col("target_name"),
    )
    count = F.when(
        F.col("max_count").isNotNull(), F.concat(F.lit("sh:maxCount "), F.col("max_count"))
    ).otherwise(F.concat(F.lit("sh:minCount "), F.col("min_count")))
    typed = F.coalesce(
        F.concat(F.lit("; sh:datatype xsd:"), F.col("datatype")), F.lit("")
    )
    safe = F.replace(
        F.replace(F.col("pattern"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')
    )
    formed = F.coalesce(F.concat(F.lit('; sh:pattern "'), safe, F.lit('"')), F.lit(""))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("# Rule: "), F.col("rule_id"), F.lit(" | "), F.upper("deontic_type")),
        F.concat(F.lit("# FOL: "), F.col("deontic_formula")),
        F.concat(F.lit(p), F.col("shape_name"), F.lit(" a sh:NodeShape ;")),
        F.concat(F.lit("    "), target, F.lit(" ;")),
        F.concat(F.lit("    sh:severity sh:"), F.col("severity"), F.lit(" ;")),
        F.concat(F.lit("    sh:property " + p), F.col("prop_name"), F.lit(" .")),
        F.lit(""),
        F.concat(F.lit(p), F.col("prop_name"), F.lit(" a sh:PropertyShape ;")),
        F.concat(F.lit("    sh:path " + p), F.col("prop_path"), F.lit(" ;")),
        F.concat(F.lit("    "), count, typed, formed, F.lit(" ;")),
        F.concat(F.lit('    sh:message "'), F.col("message"), F.lit('" .')),
        F.lit(""),
    )
    return shapes.withColumn("turtle_text", block)


def prefix_text(config: Config) -> str:
    """Prefix header of a shape file."""
    names = (
        ("rdf:    ", v.NS_RDF), ("rdfs:   ", v.NS_RDFS), ("sh:     ", v.NS_SHACL),
        ("xsd:    ", v.NS_XSD), (f"{config.prefix}:    ", config.namespace),
        ("deontic: ", v.NS_DEONTIC),
    )
    return "".join(f"@prefix {name}<{iri}> .\n" for name, iri in names) + "\n"


def overrides(shapes: DataFrame) -> DataFrame:
    """(permission, obligation) pairs on the same class and path; the last obligation counts."""
    key = F.struct("target_class", "prop_path")
    keyed = shapes.withColumn("_key", key)
    last = (
        keyed.filter(F.col("deontic_type") == "obligation")
        .groupBy("_key")
        .agg(F.max_by("shape_name", "ordinal").alias("obligation"))
    )
    allowed = keyed.filter(F.col("deontic_type") == "permission").select(
        "_key", F.col("shape_name").alias("permission")
    )
    return lookup(allowed, last, "_key", "inner").select("permission", "obligation")


def override_triples(pairs: DataFrame, config: Config) -> DataFrame:
    """The overrides links as triples and as Turtle lines."""
    ns, p = F.lit(config.namespace), F.lit(config.prefix + ":")
    return pairs.select(
        F.concat(ns, F.col("permission")).alias("s"),
        F.lit(v.NS_DEONTIC + "overrides").alias("p"),
        F.concat(ns, F.col("obligation")).alias("o"),
        F.lit("iri").alias("o_kind"),
        F.lit(None).cast("string").alias("datatype"),
        F.concat(
            p, F.col("permission"), F.lit(" deontic:overrides "), p, F.col("obligation"),
            F.lit(" ."),
        ).alias("line"),
    )


# --- shapes given as responses --------------------------------------------------------------


def direct_key() -> Column:
    return request_key(F.col("text"), "default", DIRECT_REQUEST_KIND, DIRECT_VERSION)


def without_fences(text: Column) -> Column:
    """Response text without code fences around it."""
    opened = F.regexp_replace(strip(text), r"(?md)^```[a-z]*\n?", "")
    return strip(F.regexp_replace(opened, r"(?md)```$", ""))


def chosen_turtle(attempts: DataFrame, config: Config) -> DataFrame:
    """One block per key: the first valid attempt of at most three, else the last, marked invalid.

    An empty first answer is not repaired.
    """
    read = computed(attempts, turtle_text=without_fences(F.col("response_json")))
    read = computed(read, syntax_valid=turtle.well_formed(F.col("turtle_text"), config))
    bad = ~F.col("syntax_valid")
    order = F.struct(bad, F.when(bad, -F.col("attempt")).otherwise(F.col("attempt")))
    return (
        read.filter(F.col("attempt") <= 2)
        .groupBy("cache_key")
        .agg(
            F.min_by(F.struct("turtle_text", "syntax_valid"), order).alias("_best"),
            F.min_by("turtle_text", "attempt").alias("_first"),
        )
        .filter(F.col("_first") != "")
        .select("cache_key", "_best.*")
        .filter(F.col("turtle_text") != "")
    )


def direct_shapes(failed_rules: DataFrame, attempts: DataFrame, config: Config) -> DataFrame:
    """Shapes answered directly for rules without formula."""
    if not config.use_direct_shapes:
        failed_rules = failed_rules.filter(F.lit(False))
    keyed = failed_rules.drop("cache_key").withColumn("cache_key", direct_key())
    return lookup(keyed, chosen_turtle(attempts, config), "cache_key", "inner").select(
        "rule_id",
        "text",
        "turtle_text",
        F.lit("Unknown").alias("target_class"),
        F.col("rule_type").alias("deontic_type"),
        "syntax_valid",
        F.lit(v.METHOD_DIRECT).alias("generation_method"),
    )


def fallback_shapes(
    formulas: DataFrame, shapes: DataFrame, attempts: DataFrame, config: Config
) -> DataFrame:
    """Shapes answered directly for formulas that could not be rendered."""
    missing = formulas.join(shapes.select("rule_id"), "rule_id", "left_anti")
    keyed = missing.drop("cache_key").withColumn("cache_key", direct_key())
    return lookup(keyed, chosen_turtle(attempts, config), "cache_key", "inner").select(
        "rule_id",
        "text",
        "turtle_text",
        text_class(F.lower("text"), config).alias("target_class"),
        "deontic_type",
        "syntax_valid",
        F.lit(v.METHOD_FALLBACK).alias("generation_method"),
    )


def response_tables(answered: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Valid response blocks as the shapes and constraints tables of the validation.

    answered has rule_id, turtle_text and syntax_valid. A node shape may have several targets and
    properties; those in brackets are anonymous. Blocks are read inside their rows.
    """
    usable = answered.filter("syntax_valid")
    rows = computed(usable.select("rule_id", "turtle_text"), t=turtle.triples(F.col("turtle_text"), config))
    is_shape = lambda x: (x["p"] == v.RDF_TYPE) & (x["o"] == v.NS_SHACL + "NodeShape")
    nodes = rows.select("rule_id", "t", F.explode(F.array_distinct(F.filter("t", is_shape))).alias("n"))

    def objects(subject: Column, *names: str) -> Column:
        wanted = [v.NS_SHACL + n for n in names]
        return F.filter("t", lambda x: (x["s"] == subject) & x["p"].isin(wanted))

    def first(subject: Column, name: str) -> Column:
        return F.get(objects(subject, name), F.lit(0))["o"]

    shape = F.col("n.s")
    given = local_name(first(shape, "severity"))
    targets = nodes.select(
        shape.alias("shape_id"), F.coalesce(given, F.lit("Violation")).alias("severity"),
        F.explode(objects(shape, "targetClass", "targetSubjectsOf")).alias("x"),
    )
    by_class = F.col("x.p") == v.NS_SHACL + "targetClass"
    kind = F.when(by_class, "class").otherwise("subjects_of")
    shapes = targets.select("shape_id", kind.alias("target_kind"), F.col("x.o").alias("target"), "severity")

    props = nodes.select("rule_id", "t", shape.alias("shape_id"), F.explode(objects(shape, "property")).alias("x"))
    prop = F.col("x.o")
    named = F.col("x.kind") == "iri"
    constraints = props.select(
        "shape_id",
        F.when(named, prop).otherwise(F.concat(F.lit("_:"), "rule_id", F.lit("/"), prop)).alias("prop_id"),
        named.alias("named"),
        F.explode(F.transform(objects(prop, "path"), lambda x: x["o"])).alias("path"),
        first(prop, "minCount").alias("min_count"),
        first(prop, "maxCount").alias("max_count"),
        local_name(first(prop, "datatype")).alias("datatype"),
        first(prop, "pattern").alias("pattern"),
        first(prop, "message").alias("message"),
        local_name(first(prop, "severity")).alias("severity"),
    )
    return shapes.distinct(), constraints


# --- shape files ----------------------------------------------------------------------------

RULE_MARK = r"(?m)^(?=# Rule:\s+AIT-\d+)"


def rule_blocks(files: DataFrame, config: Config) -> DataFrame:
    """(source, rule_id, block) of shape files given whole, one row per file.

    A file is cut in front of its rule marks, so no lines have to be put together again. A rule
    that occurs twice keeps its last block.
    """
    mark = RULE_MARK.replace("AIT", config.rule_prefix)
    cut = files.select(
        "source",
        F.posexplode(F.split(F.regexp_replace("ttl_text", "\r\n?", "\n"), mark, -1)).alias(
            "pos", "block"
        ),
    ).withColumn(
        "rule_id", F.regexp_extract("block", rf"^# Rule:\s+({config.rule_prefix}-\d+)", 1)
    )
    return (
        cut.filter(F.col("rule_id") != "")
        .groupBy("source", "rule_id")
        .agg(F.max_by("block", "pos").alias("block"))
        .withColumn("block", strip(F.col("block")))
    )


def rule_block(files: DataFrame, rule_id: str, config: Config) -> DataFrame:
    return rule_blocks(files, config).filter(F.col("rule_id") == rule_id)


def prefix_blocks(files: DataFrame) -> DataFrame:
    """Text in front of the first rule mark of each file."""
    return files.select(
        "source", F.substring_index("ttl_text", "# Rule:", 1).alias("prefix_text")
    )


def generated_tables(shapes: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Built shapes as the shapes and constraints tables of the validation."""
    ns = F.lit(config.namespace)
    text = F.lit(None).cast("string")
    return (
        shapes.select(
            "shape_id", "target_kind", F.concat(ns, F.col("target_name")).alias("target"), "severity"
        ),
        shapes.select(
            "shape_id",
            F.concat(ns, F.col("prop_name")).alias("prop_id"),
            F.lit(True).alias("named"),
            F.concat(ns, F.col("prop_path")).alias("path"),
            "min_count",
            "max_count",
            "datatype",
            "pattern",
            "message",
            text.alias("severity"),
        ),
    )
