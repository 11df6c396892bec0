"""Entities against constraints: targets, counts, value checks, results and person reports.

Tables
  triples      s, p, o, o_kind, datatype
  shapes       shape_id, target_kind ('class' | 'subjects_of'), target, severity, ...
  constraints  shape_id, prop_id, named, path, min_count, max_count, datatype, pattern, message,
               severity (of the property; null means the default)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.functions.columns import computed, local_name
from normspark.operators.keyed import broadcast_checked, checkpoint, spread_join, stored

# --- shape set ------------------------------------------------------------------------------


def merged_shapes(curated: DataFrame, generated: DataFrame) -> DataFrame:
    """Curated shapes and the generated ones that are valid and not empty."""
    usable = generated.filter(F.col("syntax_valid") & (F.coalesce("turtle_text", F.lit("")) != ""))
    return curated.unionByName(usable.select(*curated.columns))


def single_paths(constraints: DataFrame) -> DataFrame:
    """Constraints with one path per anonymous property; named ones stay as they are."""
    anonymous = constraints.filter(~F.col("named"))
    fields = [c for c in constraints.columns if c not in ("shape_id", "prop_id")]
    one = (
        anonymous.groupBy("shape_id", "prop_id")
        .agg(F.min_by(F.struct(*fields), "path").alias("_one"))
        .select("shape_id", "prop_id", "_one.*")
    )
    return constraints.filter("named").unionByName(one.select(*constraints.columns))


def whole_counts(constraints: DataFrame) -> DataFrame:
    """Counts given as text become integers, unreadable ones 0; was_fixed marks changed rows."""
    whole = r"^\s*[+-]?[0-9]+\s*$"

    def fixed(name: str) -> Column:
        raw = F.col(name)
        return F.when(
            raw.isNotNull(),
            F.coalesce(F.when(raw.rlike(whole), F.expr(f"try_cast(trim({name}) AS INT)")), F.lit(0)),
        )

    def changed(name: str) -> Column:
        return F.coalesce(~F.col(name).rlike("^[0-9]+$"), F.lit(False)).cast("int")

    return constraints.withColumns(
        {
            "fixed": changed("min_count") + changed("max_count"),
            "min_count": fixed("min_count"),
            "max_count": fixed("max_count"),
        }
    )


def curated_subset(shapes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Only the shapes listed."""
    return shapes.join(broadcast_checked(allowed.select("shape_id")), "shape_id", "left_semi")


def person_check_shapes(config: Config) -> list[str]:
    return [
        f"{config.namespace}{config.rule_prefix}_{n}Shape" for n in v.PERSON_CHECK_RULES
    ]


def presence_only(constraints: DataFrame) -> DataFrame:
    """Constraints without value checks."""
    none = F.lit(None).cast("string")
    return constraints.withColumns({"datatype": none, "pattern": none})


# --- targets --------------------------------------------------------------------------------


def subclass_closure(edges: DataFrame) -> DataFrame:
    """(sub, sup) for every class and each of its ancestors, itself included.

    Paths are doubled until no pair is new, so a chain of n edges takes about log2(n) rounds, and
    cycles and classes with several parents add no rows: pairs stay distinct. Edges without one of
    their ends are left out.
    """
    edges = edges.filter("sub IS NOT NULL AND sup IS NOT NULL").select("sub", "sup")
    ends = edges.select("sub").unionByName(edges.select(F.col("sup").alias("sub")))
    pairs = edges.unionByName(ends.select("sub", F.col("sub").alias("sup")))
    pairs, known = checkpoint(pairs.distinct()), -1
    while (n := pairs.count()) != known:
        known = n
        upper = pairs.select(F.col("sub").alias("_via"), F.col("sup").alias("_top"))
        doubled = pairs.join(upper, F.col("sup") == F.col("_via"))
        pairs = checkpoint(doubled.select("sub", F.col("_top").alias("sup")).distinct())
    return pairs


def entity_types(
    triples: DataFrame, edges: DataFrame | None = None, domains: DataFrame | None = None
) -> DataFrame:
    """(focus, class) pairs: asserted ones and, given an ontology, all inferred ones.

    Inference: superclasses, the domain of each property for its subject, the range for an object
    that is a node. Without edges only asserted types count.
    """
    types = triples.filter(F.col("p") == v.RDF_TYPE).select(
        F.col("s").alias("focus"), F.col("o").alias("class")
    )
    if edges is None:
        return types.distinct()
    if domains is not None:
        used = spread_join(triples, domains, ["p"], ["s", "o"])
        by_domain = used.filter(F.col("domain").isNotNull()).select(
            F.col("s").alias("focus"), F.col("domain").alias("class")
        )
        by_range = used.filter(
            F.col("range").isNotNull() & (F.col("o_kind") == "iri")
        ).select(F.col("o").alias("focus"), F.col("range").alias("class"))
        types = types.unionByName(by_domain).unionByName(by_range)
    closure = subclass_closure(edges)
    supers = closure.withColumnRenamed("sub", "class")
    up = spread_join(types, supers, ["class"], ["focus"], "left")
    return up.select("focus", F.coalesce("sup", "class").alias("class")).distinct()


def without_idle(shapes: DataFrame, constraints: DataFrame) -> DataFrame:
    """Constraints that can fail.

    A subject found by having a property always has at least one value of it, so a minimum of at
    most one on that path needs no check; neither does a minimum of zero anywhere.
    """
    own = shapes.select("shape_id", "target_kind", "target")
    own_path = (F.col("target_kind") == "subjects_of") & (F.col("path") == F.col("target"))
    floor = F.when(own_path, 1).otherwise(0)
    return (
        constraints.join(own, "shape_id")
        .withColumn("min_count", F.when(F.col("min_count") > floor, F.col("min_count")))
        .filter(
            F.col("min_count").isNotNull()
            | F.col("max_count").isNotNull()
            | F.col("datatype").isNotNull()
            | F.col("pattern").isNotNull()
        )
        .drop("target_kind", "target")
    )


def class_targets(types: DataFrame, shapes: DataFrame) -> DataFrame:
    """(focus, target_kind, target) for nodes of a target class."""
    wanted = shapes.filter(F.col("target_kind") == "class").select(F.col("target").alias("class"))
    return spread_join(types, wanted.distinct(), ["class"], ["focus"], "left_semi").select(
        "focus", F.lit("class").alias("target_kind"), F.col("class").alias("target")
    )


def subject_targets(triples: DataFrame, shapes: DataFrame) -> DataFrame:
    """(focus, target_kind, target) for subjects that have a target property."""
    wanted = shapes.filter(F.col("target_kind") == "subjects_of").select(F.col("target").alias("p"))
    return (
        spread_join(triples, wanted.distinct(), ["p"], ["s"], "left_semi")
        .select(
            F.col("s").alias("focus"),
            F.lit("subjects_of").alias("target_kind"),
            F.col("p").alias("target"),
        )
        .distinct()
    )


def focus_targets(triples: DataFrame, types: DataFrame, shapes: DataFrame) -> DataFrame:
    return class_targets(types, shapes).unionByName(subject_targets(triples, shapes))


def focus_nodes(targets: DataFrame, shapes: DataFrame) -> DataFrame:
    """(focus, shape_id) pairs to check."""
    own = shapes.select("shape_id", "target_kind", "target")
    return spread_join(targets, own, ["target_kind", "target"], ["focus"]).select(
        "focus", "shape_id"
    )


# --- checks ---------------------------------------------------------------------------------

CARRIED = ("shape_id", "prop_id", "named", "path", "message", "prop_severity", "shape_severity")


def checks(shapes: DataFrame, constraints: DataFrame) -> DataFrame:
    """Constraints with the target and severity of their shape: the table the checks join."""
    own = shapes.select(
        "shape_id", "target_kind", "target", F.col("severity").alias("shape_severity")
    )
    return constraints.withColumnRenamed("severity", "prop_severity").join(own, "shape_id")


def value_counts(triples: DataFrame, check_rows: DataFrame) -> DataFrame:
    """Distinct values per subject and checked path."""
    paths = check_rows.select(F.col("path").alias("p")).distinct()
    return (
        spread_join(triples, paths, ["p"], ["s"], "left_semi")
        .groupBy(F.col("s").alias("focus"), F.col("p").alias("path"))
        .agg(F.countDistinct("o", "o_kind", F.coalesce("datatype", F.lit(""))).alias("n"))
    )


def count_results(triples: DataFrame, targets: DataFrame, check_rows: DataFrame) -> DataFrame:
    """Too few or too many values: one result per node and constraint.

    A node may lack values altogether, so minimum counts start from the targets. Too many values are
    seen in the counts themselves: only those above a maximum are joined with the targets.
    """
    key = ["target_kind", "target"]
    counted = check_rows.filter(F.col("min_count").isNotNull() | F.col("max_count").isNotNull())
    counted = counted.select(*CARRIED, *key, "min_count", "max_count")
    seen = value_counts(triples, counted)
    least = counted.filter(F.col("min_count").isNotNull()).drop("max_count")
    most = counted.filter(F.col("max_count").isNotNull()).drop("min_count")
    expected = spread_join(targets, least, key, ["focus"])
    few = expected.join(seen, ["focus", "path"], "left").filter(
        F.coalesce("n", F.lit(0)) < F.col("min_count")
    )
    above = spread_join(seen, most, ["path"], ["focus"])
    many = above.filter(F.col("n") > F.col("max_count")).join(targets, ["focus", *key], "left_semi")
    return few.select(
        "focus", *CARRIED, F.lit("min_count").alias("component"), F.lit("").alias("value")
    ).unionByName(
        many.select(
            "focus", *CARRIED, F.lit("max_count").alias("component"), F.lit("").alias("value")
        )
    )


def lexical_ok(value: Column, datatype: Column) -> Column:
    """Whether a value has the written form of its type; types without a form accept all."""
    ok = None
    for name, form in v.LEXICAL_FORMS:
        test = value.rlike(form)
        if name == "date":
            test = test & F.substring(value, 1, 10).try_cast("date").isNotNull()
        if name == "duration":
            test = test & value.rlike("[0-9][A-Z]") & ~value.endswith("T")
        ok = F.when(datatype == name, test) if ok is None else ok.when(datatype == name, test)
    return ok.otherwise(F.lit(True))


def value_results(triples: DataFrame, targets: DataFrame, check_rows: DataFrame) -> DataFrame:
    """One result per value of another type or form, and one per value without the pattern.

    Both checks share one pass over the triples. Good values are dropped before the join with the
    targets, so only bad ones move.
    """
    used = check_rows.filter(
        F.col("datatype").isNotNull() | F.col("pattern").isNotNull()
    ).select(*CARRIED, "target_kind", "target", F.col("datatype").alias("_type"), "pattern")
    named = triples.withColumnsRenamed({"s": "focus", "p": "path"})
    rows = spread_join(named, used, ["path"], ["focus", "o"])
    value = F.col("o")
    wrong_type = F.col("_type").isNotNull() & (
        (F.col("o_kind") != "literal")
        | (F.coalesce("datatype", F.lit("")) != F.col("_type"))
        | ~lexical_ok(value, F.col("_type"))
    )
    no_match = F.col("pattern").isNotNull() & ~F.regexp_like(value, F.col("pattern"))
    marked = computed(
        rows,
        _bad=F.array_compact(
            F.array(
                F.when(wrong_type, F.lit("datatype")), F.when(no_match, F.lit("pattern"))
            )
        ),
    ).filter(F.size("_bad") > 0)
    return (
        marked.select("focus", *CARRIED, "target_kind", "target", "o", "o_kind", "datatype", "_bad")
        .distinct()
        .join(targets, ["focus", "target_kind", "target"], "left_semi")
        .select("focus", *CARRIED, F.explode("_bad").alias("component"), value.alias("value"))
    )


def owner() -> Column:
    """Shape a result is reported under: a named property itself, else its node shape."""
    return F.when(F.col("named"), F.coalesce("prop_id", F.lit("unknown"))).otherwise(
        F.coalesce("shape_id", "prop_id", F.lit("unknown"))
    )


def results(
    triples: DataFrame,
    shapes: DataFrame,
    constraints: DataFrame,
    config: Config,
    edges: DataFrame | None = None,
    domains: DataFrame | None = None,
) -> DataFrame:
    """All results: focus_node, source_shape, source_path, result_message, severity, component.

    triples is read several times and should be a stored or checkpointed table. Every check counts
    or compares distinct values, so repeated triples need no pass of their own.
    """
    types = entity_types(triples, edges, domains)
    return results_of(triples, types, shapes, constraints, config)


def results_of(
    triples: DataFrame,
    types: DataFrame,
    shapes: DataFrame,
    constraints: DataFrame,
    config: Config,
) -> DataFrame:
    """Results for the nodes that types and triples name; triples need only hold their own ones."""
    wanted = stored(checks(shapes, without_idle(shapes, constraints)))
    targets = stored(focus_targets(triples, types, wanted))
    found = count_results(triples, targets, wanted).unionByName(
        value_results(triples, targets, wanted)
    )
    return result_rows(found, config)


def result_counts(
    triples: DataFrame,
    shapes: DataFrame,
    constraints: DataFrame,
    config: Config,
    edges: DataFrame | None = None,
    domains: DataFrame | None = None,
) -> DataFrame:
    """(source_shape, n): how many results() there are under each shape, without a row for each.

    Very many shapes may ask the same of one class, and nearly all of its nodes may fail them, so the
    results grow with shapes times nodes. Equal checks are made once, and the nodes with too few values
    are all targets but those with enough: what moves grows with the triples and the different checks.
    """
    key = ["target_kind", "target"]
    wanted = stored(checks(shapes, without_idle(shapes, constraints)))
    targets = stored(focus_targets(triples, entity_types(triples, edges, domains), wanted))
    nodes = targets.groupBy(*key).agg(F.count("*").alias("_nodes"))
    parts = []

    # counts: every check row has its own results
    counted = wanted.filter(F.col("min_count").isNotNull() | F.col("max_count").isNotNull())
    seen = stored(value_counts(triples, counted))
    for name, hit_if in (("min_count", F.col("n") >= F.col("_bound")), ("max_count", F.col("n") > F.col("_bound"))):
        rows = counted.filter(F.col(name).isNotNull()).select(
            owner().alias("source_shape"), *key, "path", F.col(name).alias("_bound")
        )
        asked = [*key, "path", "_bound"]
        equal = rows.groupBy("source_shape", *asked).agg(F.count("*").alias("_times"))
        hits = spread_join(seen, rows.select(*asked).distinct(), ["path"], ["focus"]).filter(hit_if)
        hits = hits.join(targets, ["focus", *key], "left_semi").groupBy(*asked).agg(F.count("*").alias("_hits"))
        each = equal.join(nodes, key).join(
            hits.withColumnsRenamed({x: f"_{x}" for x in asked}),
            # a check without path has results too
            [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in asked],
            "left",
        )
        hit = F.coalesce("_hits", F.lit(0))
        n = F.col("_nodes") - hit if name == "min_count" else hit
        parts.append(each.select("source_shape", (F.col("_times") * n).alias("n")))

    # values: check rows that differ in type or pattern only report a value once, so such sets are compared
    test = F.struct("_type", "pattern")
    valued = wanted.filter(F.col("datatype").isNotNull() | F.col("pattern").isNotNull()).withColumnRenamed(
        "datatype", "_type"
    )
    sets = valued.groupBy(*CARRIED, *key).agg(F.array_sort(F.collect_set(test)).alias("_tests"))
    members = sets.groupBy(owner().alias("source_shape"), *key, "path", "_tests").agg(F.count("*").alias("_times"))
    alike = [*key, "path", "_tests"]
    one = stored(
        members.select(*alike).distinct().withColumn("_class", F.monotonically_increasing_id().cast("string"))
    )
    none = F.lit(None).cast("string")
    plain = one.select(
        F.col("_class").alias("shape_id"), F.col("_class").alias("prop_id"), F.lit(True).alias("named"), "path",
        none.alias("message"), none.alias("prop_severity"), none.alias("shape_severity"), *key,
        F.inline("_tests"),
    ).withColumnRenamed("_type", "datatype")
    bad = value_results(triples, targets, plain).groupBy(F.col("shape_id").alias("_class")).agg(F.count("*").alias("n"))
    found = one.join(bad, "_class").withColumnsRenamed({x: f"_{x}" for x in alike})
    parts.append(
        members.join(found, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in alike]).select(
            "source_shape", (F.col("_times") * F.col("n")).alias("n")
        )
    )
    whole = reduce(DataFrame.unionByName, parts).groupBy("source_shape").agg(F.sum("n").alias("n"))
    return whole.filter("n > 0")


def result_rows(found: DataFrame, config: Config) -> DataFrame:
    """Check findings in the form of results."""
    own = F.col("prop_severity")
    if config.severity_mode == "inherit":
        own = F.coalesce("prop_severity", "shape_severity")
    plain = F.concat(F.lit("Constraint "), F.col("component"), F.lit(" not met"))
    return found.select(
        F.col("focus").alias("focus_node"),
        owner().alias("source_shape"),
        F.col("path").alias("source_path"),
        F.coalesce("message", plain).alias("result_message"),
        F.concat(F.lit(v.NS_SHACL), F.coalesce(own, F.lit("Violation"))).alias("severity"),
        "component",
        "value",
    )


# --- outcome --------------------------------------------------------------------------------


def summary(
    triples: DataFrame, shapes: DataFrame, result_table: DataFrame, generated: DataFrame | None
) -> DataFrame:
    """One row: conforms, shape, entity and result counts. No data means skipped, not conforming."""
    entities = triples.agg(F.countDistinct("s").alias("n")).scalar()
    shape_count = shapes.agg(F.countDistinct("shape_id").alias("n")).scalar()
    found = result_table.agg(F.count("*").alias("violation_count"))
    row = found.select(
        "violation_count", entities.alias("entity_count"), shape_count.alias("shape_count")
    )
    if generated is not None:
        made = generated.agg(F.count("*").alias("n")).scalar()
        valid = generated.agg(F.count_if("syntax_valid").alias("n")).scalar()
        row = row.withColumns({"pipeline_shapes": made, "valid_shapes": valid})
    return row.withColumns(
        {
            "skipped": F.col("entity_count") == 0,
            "conforms": (F.col("violation_count") == 0) & (F.col("entity_count") > 0),
        }
    )


def by_entity(result_table: DataFrame) -> DataFrame:
    """Results under local names: (id, rule_id, rule_text, severity, message), one row each."""
    return result_table.select(
        local_name(F.col("focus_node")).alias("id"),
        local_name(F.col("source_shape")).alias("rule_id"),
        local_name(F.col("source_path")).alias("rule_text"),
        local_name(F.col("severity")).alias("severity"),
        F.col("result_message").alias("message"),
    )


def person_rows(persons: DataFrame, result_table: DataFrame) -> DataFrame:
    """Every person with their results, one row each; a compliant person has one row of nulls."""
    return persons.select("id", "name", "type").join(by_entity(result_table), "id", "left")


def person_report(persons: DataFrame, presence_results: DataFrame) -> DataFrame:
    """Every person with the list of their results, empty if none.

    For results of presence checks over a curated shape set: a list then holds at most one entry
    per curated constraint. Results with value checks have no such bound; they stay in rows, see
    person_rows.
    """
    lists = (
        by_entity(presence_results)
        .groupBy("id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rule_id", "rule_text", "severity", "message"))
            ).alias("not_conforms")
        )
    )
    empty = F.array().cast(lists.schema["not_conforms"].dataType)
    return (
        persons.select("id", "name", "type")
        .join(lists, "id", "left")
        .withColumn("not_conforms", F.coalesce("not_conforms", empty))
    )


def compliant(persons: DataFrame, result_table: DataFrame) -> DataFrame:
    """Whether each person is without results."""
    hit = (
        result_table.select(local_name(F.col("focus_node")).alias("id"))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    return persons.join(hit, "id", "left").select(
        "id", "name", "type", F.col("_hit").isNull().alias("compliant")
    )


def content_hash(triples: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(s, content): fingerprint of the triples of each entity, independent of their order.

    With types (focus, class), as inferred from the whole graph, these count too: an entity then
    also differs if another one has given it a class. Sums of hashes combine map-side, so an entity
    with very many triples is no hot group.
    """
    parts = [F.coalesce(c, F.lit("")) for c in ("p", "o", "o_kind", "datatype")]
    graph = triples.select("s", "p", "o", "o_kind", "datatype")
    if types is not None:
        none = F.lit(None).cast("string")
        graph = graph.unionByName(
            types.select(
                F.col("focus").alias("s"),
                F.lit("inferred type").alias("p"),
                F.col("class").alias("o"),
                none.alias("o_kind"),
                none.alias("datatype"),
            )
        )
    # Rows are made small and dealt by subject and hash before any are held: a task then keeps one
    # shuffle partition, not all rows of a split, which unpacks to many times its size on disk.
    small = graph.select(
        "s", F.xxhash64(*parts).alias("_one"), F.xxhash64(F.lit("b"), *parts).alias("_two"),
        # null and '' have the same hash, but are different triples
        F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in ("p", "o", "o_kind", "datatype")])
        .alias("_nulls"),
    )
    once = small.repartition("s", "_one").dropDuplicates()
    return once.groupBy("s").agg(
        F.concat_ws(
            ":",
            F.count("*"),
            F.sum(F.col("_one").cast("decimal(38,0)")),
            F.sum(F.col("_two").cast("decimal(38,0)")),
        ).alias("content")
    )


def changed_entities(
    triples: DataFrame, known: DataFrame, types: DataFrame | None = None
) -> DataFrame:
    """(s, content, changed): entities whose fingerprint is new or differs from the known one."""
    now = content_hash(triples, types)
    old = known.select("s", F.col("content").alias("_old"))
    return now.join(old, "s", "left").select(
        "s", "content", (~F.col("content").eqNullSafe(F.col("_old"))).alias("changed")
    )


def recheck(
    triples: DataFrame,
    known: DataFrame,
    known_results: DataFrame,
    shapes: DataFrame,
    constraints: DataFrame,
    config: Config,
    edges: DataFrame | None = None,
    domains: DataFrame | None = None,
) -> DataFrame:
    """Results after a change: changed entities are checked again, the others keep theirs.

    Types come from the whole graph, and known must be a content_hash() with the types of its time.
    A node typed by another one's triple is thus judged with all of its own triples, and counts as
    changed if it gains or loses a type.
    """
    types = stored(entity_types(triples, edges, domains))
    state = stored(changed_entities(triples, known, types))
    changed = state.filter("changed").select("s")
    kept = state.filter("NOT changed").select(F.col("s").alias("focus_node"))
    fresh = results_of(
        triples.join(changed, "s", "left_semi"),
        types.join(changed.withColumnRenamed("s", "focus"), "focus", "left_semi"),
        shapes,
        constraints,
        config,
    )
    same = known_results.join(kept, "focus_node", "left_semi")
    return fresh.unionByName(same.select(*fresh.columns))
