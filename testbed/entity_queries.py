"""Check queries over entities: mapping, validation, triage, quality, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark import values as v
from normspark.functions import turtle
from normspark.operators import entities as en
from normspark.operators import quality, triage
from normspark.operators import validate as va
from normspark.operators.keyed import checkpoint, stored, work_dir
from normspark.plans import person_check, pipeline
from normspark.sources import sinks
from oracles import base as o
from testbed import mapping as m
from testbed import rule_queries
from testbed import tables as t
from testbed.registry import Bed, query

# --- latest records and flags ---------------------------------------------------------------


def on_entities(select: str, *more: str) -> str:
    return o.with_(*o.ENTITY_CHAIN, *more) + select


@query(
    "latest_fee",
    on_entities(
        """SELECT student_id, payment_status, first_installment_paid,
           round(CAST(amount_paid AS DOUBLE), 2) AS amount_paid FROM latest_fee"""
    ),
)
def _(b: Bed):
    return en.latest_fee(b.entity_tables["fee_records"], m.TIES["fee_records"]).select(
        "student_id", "payment_status", "first_installment_paid",
        F.round(F.col("amount_paid").cast("double"), 2).alias("amount_paid"),
    )


@query(
    "latest_housing",
    on_entities(
        """SELECT student_id, building, room_number, rent_current, room_clean, vacated_on_time
           FROM latest_housing"""
    ),
)
def _(b: Bed):
    return en.latest_housing(b.entity_tables["accommodations"], m.TIES["accommodations"]).select(
        "student_id", "building", "room_number", "rent_current", "room_clean", "vacated_on_time"
    )


@query(
    "student_profiles",
    on_entities(
        """SELECT student_id, payment_status, building, ethical_conduct, cooking_in_dorm,
           registered_with_registry FROM profiles"""
    ),
)
def _(b: Bed):
    return en.student_profiles(b.entity_tables, m.TIES).select(
        "student_id", "payment_status", "building", "ethical_conduct", "cooking_in_dorm",
        "registered_with_registry",
    )


@query(
    "entity_by_id",
    on_entities(f"SELECT p, o FROM entity_triples WHERE s = '{m.NS}ST42'"),
)
def _(b: Bed):
    one = en.entities(b.entity_tables, "ST42", "Student", m.TIES)
    return en.triples(one, b.config).select("p", "o")


@query(
    "entities_by_names",
    on_entities(
        f"""SELECT s, p, o FROM entity_triples WHERE s IN (
        SELECT '{m.NS}' || id FROM (
        SELECT student_id AS id FROM students WHERE first_name IN ('BUILDING', 'MACHINERY')
        UNION ALL SELECT faculty_id FROM faculty
            WHERE replace(replace(title || first_name || last_name, ' ', ''), '.', '')
                  IN ('DrSupplier000000007', 'ProfSupplier000000009')
        UNION ALL SELECT staff_id FROM staff WHERE first_name IN ('PROMO')
        UNION ALL SELECT {o.COMMITTEE_ID} FROM committees
            WHERE {o.COMMITTEE_ID} = 'BoardAndPanelNATION_3'))"""
    ),
)
def _(b: Bed):
    """Triples of the entities listed by name."""
    rows = en.of_names(
        b.entity_tables, ["BUILDING", "MACHINERY"], ["DrSupplier000000007", "ProfSupplier000000009"],
        ["PROMO"], ["BoardAndPanelNATION_3"], m.TIES,
    )
    return en.triples(rows, b.config).select("s", "p", "o")


@query("entity_class", on_entities("SELECT id, class FROM entity_rows"))
def _(b: Bed):
    return b.entities.select(F.col("entity_id").alias("id"), "class")


def _flags(name: str, group: str, flags):
    @query(
        name,
        on_entities(o.kept_facts("profiles", "student_id", o.FLAG_GROUPS[group])),
    )
    def _(b: Bed):
        profiles = en.student_profiles(b.entity_tables, m.TIES)
        props = F.array_compact(F.array(*en._present(flags())))
        return profiles.select(
            F.col("student_id").alias("id"), F.explode(props).alias("f")
        ).select("id", "f.p", "f.o")


_flags("fee_flags", "fee", en.fee_flags)
_flags("housing_flags", "housing", en.housing_flags)
_flags("conduct_flags", "conduct", en.conduct_flags)
_flags("prohibition_flags", "prohibition", en.prohibition_flags)
_flags("academic_flags", "academic", en.academic_flags)


def _facts(name: str, facts: str, build):
    @query(name, on_entities(f"SELECT id, p, o FROM {facts}"))
    def _(b: Bed):
        return (
            build(b)
            .select(F.col("entity_id").alias("id"), F.explode("props").alias("f"))
            .select("id", "f.p", "f.o")
        )


_facts(
    "student_triples", "student_facts",
    lambda b: en.student_entities(en.student_profiles(b.entity_tables, m.TIES)),
)
_facts("faculty_triples", "faculty_facts", lambda b: en.faculty_entities(b.entity_tables["faculty"]))
_facts("staff_triples", "staff_facts", lambda b: en.staff_entities(b.entity_tables["staff"]))
_facts(
    "committee_triples", "committee_facts",
    lambda b: en.committee_entities(b.entity_tables["committees"]),
)


@query("all_triples", on_entities("SELECT s, p, o, o_kind, datatype FROM entity_triples"))
def _(b: Bed):
    return en.triples(b.entities, b.config)


#: property lines of an entity's text, in one order
TEXT_LINES = """
text_lines AS (
    SELECT id, 'rdfs:label "' || label || '"' AS line FROM entity_rows
    UNION ALL SELECT id, 'ait:' || p || ' ' || o FROM facts),
texts AS (
    SELECT e.id AS entity_id, e.class, string_agg(line, chr(10) ORDER BY line) AS lines
    FROM entity_rows e JOIN text_lines l ON l.id = e.id GROUP BY ALL)
"""


@query("entity_text_blocks", on_entities("SELECT * FROM texts", TEXT_LINES))
def _(b: Bed):
    """Class and all property lines as the text has them; comment lines are left out."""
    blocks = en.text_blocks(b.entities, b.config)
    line = F.regexp_extract_all("block", F.lit("(?m)^    (.*) [;.]$"), F.lit(1))
    head = F.regexp_extract("block", r"(?m)^ait:(\S+) a ait:(\w+) ;$", 2)
    return blocks.select(
        "entity_id", head.alias("class"), F.array_join(F.array_sort(line), "\n").alias("lines")
    )


@query(
    "block_counts",
    on_entities(
        """SELECT (SELECT count(*) FROM entity_rows) AS entity_count,
           (SELECT count(*) FROM facts) AS property_count"""
    ),
)
def _(b: Bed):
    return en.block_counts(b.entities)


_OVERVIEW = f"""
incidents AS (SELECT student_id, count(*) AS n FROM conduct_records GROUP BY 1),
issue_rows AS (
    SELECT s.first_name AS name, 'Student' AS type,
        s.first_name || ' ' || s.last_name || ' (' || degree_level || ' - ' || program || ')'
            AS label, 30 AS properties, enrollment_status AS status,
        list_filter([CASE WHEN f.payment_status IN ('Overdue', 'Partial')
                          THEN 'Fee: ' || f.payment_status END,
            CASE WHEN cooking_in_dorm THEN 'Cooking violation' END,
            CASE WHEN pet_in_dorm THEN 'Pet violation' END,
            CASE WHEN noisy_in_dorm THEN 'Noise violation' END,
            CASE WHEN disturbing_residents THEN 'Disturbing residents' END],
            lambda x: x IS NOT NULL) AS issues, coalesce(i.n, 0) AS incidents
    FROM students s LEFT JOIN incidents i ON i.student_id = s.student_id
    LEFT JOIN latest_fee f ON f.student_id = s.student_id
    LEFT JOIN student_conduct c ON c.student_id = s.student_id
    UNION ALL
    SELECT replace(replace(title || first_name || last_name, ' ', ''), '.', ''), 'Faculty',
        title || ' ' || first_name || ' ' || last_name || ' (' || position || ', ' || department
        || ')', 5, 'Active',
        list_filter([CASE WHEN NOT coalesce(grading_criteria_published, FALSE)
                          THEN 'No grading criteria' END,
            CASE WHEN NOT coalesce(follows_disciplinary_procedures, FALSE)
                 THEN 'No disciplinary procedures' END,
            CASE WHEN NOT coalesce(discloses_conflicts, FALSE) THEN 'Undisclosed conflicts' END,
            CASE WHEN NOT coalesce(reports_cheating_suspects, FALSE)
                 THEN 'Not reporting cheating' END], lambda x: x IS NOT NULL), 0 FROM faculty
    UNION ALL
    SELECT first_name, 'Employee', first_name || ' ' || last_name || ' (' || role || ', '
        || department || ')', 7, 'Active',
        list_filter([CASE WHEN NOT gifts_reported THEN 'Unreported gifts' END,
            CASE WHEN NOT settlements_reported THEN 'Unsettled obligations' END,
            CASE WHEN NOT ethical_authority_use THEN 'Authority misuse' END],
            lambda x: x IS NOT NULL), 0 FROM staff
    UNION ALL
    SELECT {o.COMMITTEE_ID}, 'Committee', committee_name || ' (' || committee_type || ')', 14,
        'Active', list_filter([CASE WHEN NOT chair_elected THEN 'No chair elected' END],
            lambda x: x IS NOT NULL), 0 FROM committees)
"""


@query(
    "entity_overview",
    on_entities(
        """SELECT name, type, label, properties, status, len(issues) AS issues, incidents,
           CASE WHEN type = 'Student' THEN status || ' | ' ELSE '' END
           || CASE WHEN len(issues) = 0 THEN 'No known issues'
                   ELSE array_to_string(issues, ', ') END AS detail FROM issue_rows""",
        _OVERVIEW,
    ),
)
def _(b: Bed):
    return en.overview(b.entity_tables, m.TIES)


_PERSONS = """
persons AS (
    SELECT student_id AS id, first_name || ' ' || last_name AS name, 'Student' AS type,
           0 AS rank, student_id AS ord FROM students
    UNION ALL SELECT faculty_id, title || ' ' || first_name || ' ' || last_name, 'Faculty', 1,
           lpad(CAST(id AS VARCHAR), 20, '0') FROM faculty
    UNION ALL SELECT staff_id, first_name || ' ' || last_name, 'Employee', 2,
           lpad(CAST(id AS VARCHAR), 20, '0') FROM staff)
"""


@query("person_list", on_entities("SELECT id, name, type FROM persons", _PERSONS))
def _(b: Bed):
    return b.persons.select("id", "name", "type")


@query(
    "person_by_name",
    on_entities(
        """SELECT id, name, type FROM persons WHERE contains(lower(name), 'large hot')
           ORDER BY CASE WHEN lower(name) = 'large hot' THEN 0 ELSE 1 END, rank, ord LIMIT 1""",
        _PERSONS,
    ),
)
def _(b: Bed):
    return en.person_by_name(b.persons, " Large HOT ").select("id", "name", "type")


@query(
    "person_by_id",
    on_entities("SELECT id, name, type FROM persons WHERE id = 'FA7'", _PERSONS),
)
def _(b: Bed):
    return en.person_by_id(b.persons, "FA7").select("id", "name", "type")


@query(
    "entity_total",
    on_entities(
        """SELECT CAST((SELECT count(*) FROM students) + (SELECT count(*) FROM faculty)
           + (SELECT count(*) FROM staff) + (SELECT count(*) FROM committees) AS BIGINT)
           AS entities"""
    ),
)
def _(b: Bed):
    return en.entity_total(b.entity_tables)


# --- validation -----------------------------------------------------------------------------

GRAPH_CHAIN = (
    *o.ENTITY_CHAIN, o.CONFIG_TABLES, o.CONSTRAINTS, o.GRAPH, o.CLOSURE, o.INFERRED_TYPES,
)


def on_graph(select: str, *more: str) -> str:
    return o.with_(*GRAPH_CHAIN, *more) + select


def on_results(select: str, *more: str) -> str:
    return o.with_(*o.RESULT_CHAIN, *more) + select


#: node shapes and constraints that the chosen answers of rules without formula spell out
ANSWERED = f"""
answered AS (
    SELECT '{m.NS}' || regexp_extract(best.block, '^ait:(\\w+) a ', 1) AS shape_id, regexp_extract(best.block,
           'sh:path ait:(\\w+)', 1) AS path,
           CASE WHEN contains(best.block, 'sh:Info') THEN 'Info' ELSE 'Violation' END AS severity
    FROM failed f JOIN best ON best.text = f.text WHERE best.ok)
"""


@query(
    "merged_shapes",
    rule_queries.on_formulas(
        f"""SELECT shape_id, target_kind, target, severity FROM shapes UNION ALL
            SELECT DISTINCT shape_id, 'class', '{m.NS}Student', severity FROM answered""",
        rule_queries.FAILED, rule_queries.DIRECT, o.CONFIG_TABLES, ANSWERED,
    ),
)
def _(b: Bed):
    """Curated shapes and those of all answers; of several attempts the chosen one counts."""
    return b.shapes.unionByName(b.answered[0].select(*b.shapes.columns))


@query(
    "response_constraints",
    rule_queries.on_formulas(
        f"""SELECT shape_id, false AS named, '{m.NS}' || path AS path,
                CASE WHEN path = 'feesPaid' THEN 1 END AS min_count,
                CASE WHEN path = 'cookInUnit' THEN 0 END AS max_count,
                CASE WHEN path = 'cookInUnit' THEN 'boolean' END AS datatype,
                CASE WHEN path = 'x' THEN '^a\\d' END AS pattern,
                'a ] b' AS message
            FROM answered""",
        rule_queries.FAILED, rule_queries.DIRECT, ANSWERED,
    ),
)
def _(b: Bed):
    return b.answered[1].select(
        "shape_id", "named", "path", "min_count", "max_count", "datatype", "pattern", "message"
    )


def generated_constraints(b: Bed) -> DataFrame:
    """Constraints of generated shapes, with a second path and odd counts on some anonymous ones."""
    return b.rules.select(
        F.concat(F.lit("S"), F.col("rule_id")).alias("shape_id"),
        F.concat(F.lit("_:"), F.col("rule_id")).alias("prop_id"),
        (F.col("rule_type") == "permission").alias("named"),
        F.explode(F.array(F.col("source_document"), F.col("rule_type"))).alias("path"),
        F.when(F.col("rule_type") == "obligation", F.lit("1"))
        .when(F.col("rule_type") == "permission", F.lit("one"))
        .alias("min_count"),
        F.when(F.col("rule_type") == "prohibition", F.lit("0.5")).alias("max_count"),
    )


GENERATED_CONSTRAINTS = """
gen AS (
    SELECT 'S' || rule_id AS shape_id, '_:' || rule_id AS prop_id, rule_type = 'permission'
           AS named, unnest([source_document, rule_type]) AS path,
           CASE rule_type WHEN 'obligation' THEN '1' WHEN 'permission' THEN 'one' END AS min_count,
           CASE rule_type WHEN 'prohibition' THEN '0.5' END AS max_count FROM part_rules)
"""


@query(
    "single_paths",
    o.with_(o.RULES, GENERATED_CONSTRAINTS)
    + """SELECT shape_id, prop_id, path FROM gen WHERE named UNION ALL
         SELECT shape_id, prop_id, min(path) FROM gen WHERE NOT named GROUP BY ALL""",
)
def _(b: Bed):
    return va.single_paths(generated_constraints(b)).select("shape_id", "prop_id", "path")


@query(
    "whole_counts",
    o.with_(o.RULES, GENERATED_CONSTRAINTS)
    + """SELECT shape_id, path, CASE WHEN min_count = 'one' THEN 0
         ELSE CAST(min_count AS INTEGER) END AS min_count,
         CASE WHEN max_count IS NOT NULL THEN 0 END AS max_count,
         CASE WHEN min_count = 'one' OR max_count IS NOT NULL THEN 1 ELSE 0 END AS fixed FROM gen""",
)
def _(b: Bed):
    return va.whole_counts(generated_constraints(b)).select(
        "shape_id", "path", "min_count", "max_count", "fixed"
    )


@query("inferred_types", on_graph("SELECT focus, class FROM types"))
def _(b: Bed):
    return va.entity_types(b.triples, b.edges, b.domains)


@query(
    "subclass_closure",
    o.with_(o.CONFIG_TABLES, o.CLOSURE, *o.ENTITY_CHAIN)
    + """SELECT c.sup AS class, count(DISTINCT e.id) AS entities FROM entity_rows e
         JOIN closure c ON c.sub = 'http://example.org/ait-policy#' || e.class GROUP BY 1""",
)
def _(b: Bed):
    closure = va.subclass_closure(b.edges)
    own = b.entities.select("entity_id", F.concat(F.lit(m.NS), F.col("class")).alias("sub"))
    return (
        own.join(closure, "sub")
        .groupBy(F.col("sup").alias("class"))
        .agg(F.countDistinct("entity_id").alias("entities"))
    )


@query(
    "class_targets",
    on_graph(
        """SELECT DISTINCT focus, class AS target FROM types
           WHERE class IN (SELECT target FROM shapes WHERE target_kind = 'class')"""
    ),
)
def _(b: Bed):
    types = va.entity_types(b.triples, b.edges, b.domains)
    return va.class_targets(types, b.shapes).select("focus", "target")


@query(
    "subject_targets",
    on_graph(
        """SELECT DISTINCT s AS focus, p AS target FROM triples
           WHERE p IN (SELECT target FROM shapes WHERE target_kind = 'subjects_of')"""
    ),
)
def _(b: Bed):
    return va.subject_targets(b.triples, b.shapes).select("focus", "target")


def _component(name: str, component: str, check):
    @query(
        name,
        on_results(
            f"""SELECT focus, prop_id, path, value FROM findings
                WHERE component = '{component}'"""
        ),
    )
    def _(b: Bed):
        wanted = checkpoint(va.checks(b.shapes, va.without_idle(b.shapes, b.constraints)))
        types = va.entity_types(b.triples, b.edges, b.domains)
        found = check(b.triples, va.focus_targets(b.triples, types, b.shapes), wanted)
        return found.filter(F.col("component") == component).select(
            "focus", "prop_id", "path", "value"
        )


_component("min_count_check", "min_count", va.count_results)
_component("max_count_check", "max_count", va.count_results)
_component("datatype_check", "datatype", va.value_results)
_component("pattern_check", "pattern", va.value_results)

RESULT = "focus_node, source_shape, source_path, result_message, severity, component, value"


@query("validation_results", on_results(f"SELECT {RESULT} FROM results"))
def _(b: Bed):
    return b.results


@query(
    "owning_shape",
    on_results(
        """SELECT source_shape, component, count(*) AS n, count(DISTINCT focus_node) AS nodes
           FROM results GROUP BY ALL"""
    ),
)
def _(b: Bed):
    return b.results.groupBy("source_shape", "component").agg(
        F.count("*").alias("n"), F.countDistinct("focus_node").alias("nodes")
    )


@query(
    "conformance_summary",
    on_results(
        """SELECT count(*) = 0 AS conforms, (SELECT count(DISTINCT s) FROM triples) AS entity_count,
           (SELECT count(*) FROM shapes) AS shape_count, count(*) AS violation_count,
           FALSE AS skipped, (SELECT count(*) FROM direct_responses) AS pipeline_shapes,
           (SELECT count(*) FROM direct_responses WHERE starts_with(response_json, '```'))
               AS valid_shapes FROM results""",
        o.role("direct_responses", m.DIRECT_RESPONSES),
    ),
)
def _(b: Bed):
    from normspark.operators import shapes as shp

    made = b.role(m.DIRECT_RESPONSES).select(
        turtle.well_formed(shp.without_fences(F.col("response_json")), b.config).alias("syntax_valid")
    )
    return va.summary(b.triples, b.shapes, b.results, made)


def on_persons(select: str, *more: str) -> str:
    return o.with_(*o.PERSON_CHAIN, *more) + select


@query(
    "curated_shapes",
    on_persons(
        """SELECT a.shape_id, count(f.focus) AS nodes FROM allowed a
           LEFT JOIN focus f ON f.shape_id = a.shape_id GROUP BY 1"""
    ),
)
def _(b: Bed):
    types = va.entity_types(b.entity_triples)
    targets = va.focus_targets(b.entity_triples, types, b.allowed_shapes)
    nodes = va.focus_nodes(targets, b.allowed_shapes)
    return (
        b.allowed_shapes.join(nodes, "shape_id", "left")
        .groupBy("shape_id")
        .agg(F.count("focus").alias("nodes"))
    )


@query(
    "presence_only_results",
    on_persons("SELECT focus_node, source_shape, source_path, component FROM results"),
)
def _(b: Bed):
    return b.presence_results.select("focus_node", "source_shape", "source_path", "component")


@query(
    "asserted_types",
    o.with_(*o.ENTITY_CHAIN, o.GRAPH, o.ASSERTED_TYPES) + "SELECT focus, class FROM types",
)
def _(b: Bed):
    return va.entity_types(b.triples)


_LOCAL = "split_part({}, '#', -1)"
_BY_ENTITY = f"""
by_entity AS (
    SELECT {_LOCAL.format('focus_node')} AS id,
           CASE WHEN contains(source_shape, '#') THEN {_LOCAL.format('source_shape')}
                ELSE source_shape END AS rule_id,
           {_LOCAL.format('source_path')} AS rule_text, {_LOCAL.format('severity')} AS severity,
           result_message AS message FROM results)
"""


@query(
    "results_by_entity",
    on_results("SELECT id, rule_id, rule_text, severity, message FROM by_entity", _BY_ENTITY),
)
def _(b: Bed):
    return va.by_entity(b.results)


@query(
    "person_compliance",
    on_persons(
        """SELECT p.id, p.name, p.type, count(b.id) AS broken,
           coalesce(string_agg(b.rule_id || ': ' || b.message, '; '
               ORDER BY b.rule_id, b.rule_text, b.severity, b.message), '') AS not_conforms
           FROM persons p LEFT JOIN by_entity b ON b.id = p.id GROUP BY ALL""",
        _BY_ENTITY,
    ),
)
def _(b: Bed):
    report = va.person_report(b.persons, b.presence_results)
    lines = F.transform(
        "not_conforms", lambda r: F.concat(r["rule_id"], F.lit(": "), r["message"])
    )
    return report.select(
        "id", "name", "type", F.size("not_conforms").cast("long").alias("broken"),
        F.array_join(lines, "; ").alias("not_conforms"),
    )


def _one_person(name: str, where: str, check):
    @query(
        name,
        on_persons(
            f"""SELECT p.id, p.name, p.type, b.rule_id, b.message FROM persons p LEFT JOIN by_entity b ON b.id = p.id
                WHERE {where}""",
            _BY_ENTITY,
        ),
    )
    def _(b: Bed):
        report = check(b.entity_tables, b.shapes, b.constraints, b.config, m.TIES)
        rule = F.explode_outer("not_conforms").alias("r")
        return report.select("id", "name", "type", rule).select("id", "name", "type", "r.rule_id", "r.message")


_one_person(
    "person_check_by_id", "p.id = 'ST42'",
    lambda tables, *rest: person_check.check_by_id(tables, "ST42", *rest),
)
_one_person(
    "person_check_by_name",
    """p.id = (SELECT id FROM persons WHERE contains(lower(name), 'large hot')
       ORDER BY lower(name) <> 'large hot', list_position(['Student', 'Faculty', 'Employee'], type),
       CASE type WHEN 'Student' THEN 0 ELSE length(id) END, id LIMIT 1)""",
    lambda tables, *rest: person_check.check_by_name(tables, " Large HOT ", *rest),
)


@query(
    "person_rows",
    on_results(
        """SELECT p.id, p.name, p.type, b.rule_id, b.rule_text, b.message
           FROM persons p LEFT JOIN by_entity b ON b.id = p.id""",
        _PERSONS, _BY_ENTITY,
    ),
)
def _(b: Bed):
    return va.person_rows(b.persons, b.results).select(
        "id", "name", "type", "rule_id", "rule_text", "message"
    )


@query(
    "compliant_persons",
    on_persons(
        """SELECT p.id, p.name, p.type, NOT EXISTS (SELECT 1 FROM results r
           WHERE r.focus_node = 'http://example.org/ait-policy#' || p.id) AS compliant
           FROM persons p"""
    ),
)
def _(b: Bed):
    return va.compliant(b.persons, b.presence_results)


def older_triples(triples: DataFrame) -> DataFrame:
    """The graph as it was: without cooking, and committees with another label."""
    return triples.filter(~F.col("p").endswith("cookInUnit")).withColumn(
        "o",
        F.when(
            F.col("p").endswith("label") & F.col("s").contains("Board"),
            F.concat(F.lit("Old "), F.col("o")),
        ).otherwise(F.col("o")),
    )


@query(
    "changed_entities",
    on_entities(
        """SELECT s, max(CASE WHEN ends_with(p, 'cookInUnit') OR (ends_with(p, 'label')
           AND contains(s, 'Board')) THEN 1 ELSE 0 END) = 1 AS changed
           FROM entity_triples GROUP BY s"""
    ),
)
def _(b: Bed):
    known = va.content_hash(older_triples(b.entity_triples))
    return va.changed_entities(b.entity_triples, known).select("s", "changed")


@query(
    "incremental_recheck",
    o.with_(*o.INFERRED_PERSON_CHAIN)
    + "SELECT focus_node, source_shape, source_path, component FROM results",
)
def _(b: Bed):
    old = older_triples(b.entity_triples)
    constraints = va.presence_only(b.constraints).join(
        b.allowed_shapes.select("shape_id"), "shape_id", "left_semi"
    )
    ontology = (b.edges, b.domains)
    known = stored(va.results(old, b.allowed_shapes, constraints, b.config, *ontology))
    state = va.content_hash(old, va.entity_types(old, *ontology))
    return va.recheck(
        b.entity_triples, state, known, b.allowed_shapes, constraints, b.config, *ontology
    ).select("focus_node", "source_shape", "source_path", "component")


@query(
    "first_results",
    on_results(
        """SELECT focus_node, source_shape, component, value FROM results
           ORDER BY focus_node, source_shape, source_path, component, value LIMIT 50"""
    ),
)
def _(b: Bed):
    return sinks.first_results(b.results).select("focus_node", "source_shape", "component", "value")


# --- triage ---------------------------------------------------------------------------------

BY_SHAPE = """
per_shape AS (
    SELECT source_shape AS shape, count(*) AS count, count(DISTINCT focus_node)
           AS distinct_entities, substr(min(result_message), 1, 150) AS sample_message
    FROM results GROUP BY 1),
nodes AS (SELECT count(DISTINCT focus) AS n FROM types WHERE ends_with(class, '#Student')),
by_shape AS (
    SELECT *, round(distinct_entities / n * 100, 1) AS pct_entities,
           distinct_entities / n * 100 >= 80 AS likely_false_positive FROM per_shape, nodes)
"""


def shape_rows(b: Bed) -> DataFrame:
    """Share of the students, so that some shapes reach the false-positive mark."""
    types = va.entity_types(b.triples, b.edges, b.domains)
    students = (
        types.filter(F.col("class").endswith("#Student"))
        .agg(F.countDistinct("focus").alias("n"))
        .scalar()
    )
    return triage.by_shape(stored(b.results), students)


@query(
    "results_by_severity",
    on_results("SELECT split_part(severity, '#', -1) AS severity, count(*) AS n FROM results GROUP BY 1"),
)
def _(b: Bed):
    return triage.by_severity(b.results)


@query(
    "results_by_shape",
    on_results(
        """SELECT shape, count, distinct_entities, pct_entities, likely_false_positive,
           sample_message FROM by_shape""",
        BY_SHAPE,
    ),
)
def _(b: Bed):
    return shape_rows(b)


@query(
    "false_positive_shapes",
    on_results("SELECT shape, pct_entities FROM by_shape WHERE likely_false_positive", BY_SHAPE),
)
def _(b: Bed):
    return shape_rows(b).filter("likely_false_positive").select("shape", "pct_entities")


@query(
    "top_shapes",
    on_results("SELECT shape, count FROM by_shape ORDER BY count DESC, shape LIMIT 5", BY_SHAPE),
)
def _(b: Bed):
    return triage.top_shapes(shape_rows(b), v.SUMMARY_SHAPES).select("shape", "count")


@query(
    "triage_totals",
    on_results(
        """SELECT CAST(coalesce(sum(count) FILTER (likely_false_positive), 0) AS BIGINT)
           AS likely_false_positives, CAST(coalesce(sum(count) FILTER
           (NOT likely_false_positive), 0) AS BIGINT) AS actionable FROM by_shape""",
        BY_SHAPE,
    ),
)
def _(b: Bed):
    return triage.totals(shape_rows(b))


@query(
    "rule_type_distribution",
    o.with_(o.RULES)
    + """SELECT CASE WHEN confidence < 0.1::DOUBLE THEN 'unknown' ELSE rule_type END AS rule_type,
         count(*) AS n FROM part_rules GROUP BY 1""",
)
def _(b: Bed):
    typed = F.when(F.col("confidence") >= 0.1, F.col("rule_type"))
    return triage.rule_types(b.rules.withColumn("rule_type", typed))


@query(
    "generation_methods",
    o.with_(*o.FORMULA_CHAIN, """
    failed AS (SELECT * FROM part_rules r WHERE NOT EXISTS (
        SELECT 1 FROM completed c WHERE c.rule_id = r.rule_id))""",
        o.role("direct_responses", m.DIRECT_RESPONSES), """
    direct_store AS (SELECT text, attempt, min(response_json) AS j FROM direct_responses
                     GROUP BY ALL),
    firsts AS (SELECT text, min(j) FILTER (attempt = 0) AS j0,
                      max(CASE WHEN starts_with(j, '```') THEN 1 ELSE 0 END) AS any_ok,
                      arg_max(j, attempt) AS last_j FROM direct_store GROUP BY text),
    direct AS (SELECT any_ok FROM failed f JOIN firsts USING (text)
               WHERE j0 <> '' AND (any_ok = 1 OR last_j <> ''))""")
    + """SELECT (SELECT count(*) FROM completed) + (SELECT count(*) FROM direct) AS shapes_total,
         (SELECT count(*) FROM completed) + (SELECT count(*) FROM direct WHERE any_ok = 1)
             AS shapes_valid, (SELECT count(*) FROM completed) AS shapes_fol_mediated,
         (SELECT count(*) FROM direct) AS shapes_direct_nl,
         CAST(0 AS BIGINT) AS shapes_fol_fallback""",
)
def _(b: Bed):
    from normspark.operators import formalize
    from normspark.operators import shapes as shp

    direct = shp.direct_shapes(formalize.failed(b.formalised), b.direct_store, b.config)
    both = b.built.select("generation_method", "syntax_valid").unionByName(
        direct.select("generation_method", "syntax_valid")
    )
    return triage.methods(both)


# --- quality --------------------------------------------------------------------------------

ANNOTATIONS = o.role("annotations", m.ANNOTATIONS)
CELLS = """
cells AS (SELECT item_id, label, count(*) AS n FROM annotations GROUP BY ALL),
rated AS (SELECT item_id, sum(n) AS raters, sum(n * n) AS squares FROM cells GROUP BY 1)
"""
MAJORITY = """
majority AS (SELECT item_id, label AS majority FROM (SELECT *, row_number() OVER (
    PARTITION BY item_id ORDER BY n DESC, label) AS rn FROM cells) WHERE rn = 1)
"""


@query(
    "fleiss_kappa",
    o.with_(ANNOTATIONS, CELLS)
    + """SELECT items, round(observed, 9) AS observed, round(expected, 9) AS expected,
         round((observed - expected) / (1 - expected), 9) AS kappa FROM (
           SELECT count(*) AS items, avg((squares - raters) / (raters * (raters - 1))) AS observed
           FROM rated), (SELECT sum(share * share) AS expected FROM (
             SELECT sum(n) / (SELECT sum(raters) FROM rated) AS share FROM cells GROUP BY label))""",
)
def _(b: Bed):
    k = quality.fleiss_kappa(b.role(m.ANNOTATIONS))
    return k.select(
        "items", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")]
    )


@query(
    "accuracy_vs_majority",
    o.with_(ANNOTATIONS, CELLS, MAJORITY, o.role("predictions", m.PREDICTIONS))
    + """SELECT count(*) AS items, count(*) FILTER (label = majority) AS correct,
         round(avg(CASE WHEN label = majority THEN 1.0 ELSE 0.0 END), 9) AS accuracy
         FROM predictions JOIN majority USING (item_id)""",
)
def _(b: Bed):
    return quality.accuracy(b.role(m.PREDICTIONS), b.role(m.ANNOTATIONS)).withColumn(
        "accuracy", F.round("accuracy", 9)
    )


@query(
    "cohen_kappa",
    o.with_(ANNOTATIONS, CELLS, MAJORITY, o.role("predictions", m.PREDICTIONS), """
    pairs AS (SELECT label AS a, majority AS b FROM predictions JOIN majority USING (item_id)),
    total AS (SELECT count(*) AS n FROM pairs)""")
    + """SELECT items, round(observed, 9) AS observed, round(expected, 9) AS expected,
         round((observed - expected) / (1 - expected), 9) AS kappa FROM (
           SELECT count(*) AS items, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS observed
           FROM pairs), (SELECT sum(x.n * y.n) / (SELECT n * n FROM total) AS expected
           FROM (SELECT a AS l, count(*) AS n FROM pairs GROUP BY 1) x
           JOIN (SELECT b AS l, count(*) AS n FROM pairs GROUP BY 1) y USING (l))""",
)
def _(b: Bed):
    pairs = (
        b.role(m.PREDICTIONS)
        .join(quality.majority(b.role(m.ANNOTATIONS)), "item_id")
        .select("item_id", F.col("label").alias("a"), F.col("majority").alias("b"))
    )
    k = quality.cohen_kappa(pairs)
    return k.select(
        F.col("items").cast("long").alias("items"),
        *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")],
    )


_STEPS = " + ".join(
    f"CASE WHEN u > {p!r}::DOUBLE THEN 1 ELSE 0 END" for p in quality.POISSON
)


@query(
    "bootstrap_interval",
    o.with_(ANNOTATIONS, CELLS, MAJORITY, o.role("predictions", m.PREDICTIONS))
    + f"""
    , scored AS (SELECT item_id, CASE WHEN label = majority THEN 1.0 ELSE 0.0 END AS score
                 FROM predictions JOIN majority USING (item_id)),
    drawn AS (SELECT r, score, CAST('0x' || substr(md5(item_id || ':' || r), 1, 8) AS BIGINT)
                     / 4294967296::DOUBLE AS u
              FROM (SELECT *, unnest(range(1, 201)) AS r FROM scored)),
    weighted AS (SELECT r, score, {_STEPS} AS w FROM drawn),
    means AS (SELECT r, sum(w * score) / sum(w) AS mean FROM weighted GROUP BY r)
    SELECT count(*) AS replicates, round(quantile_cont(mean, 0.025), 9) AS low,
           round(quantile_cont(mean, 0.975), 9) AS high FROM means""",
)
def _(b: Bed):
    hit = (F.col("label") == F.col("majority")).cast("double")
    scores = (
        b.role(m.PREDICTIONS)
        .join(quality.majority(b.role(m.ANNOTATIONS)), "item_id")
        .select("item_id", hit.alias("score"))
    )
    return quality.bootstrap(scores).select(
        "replicates", F.round("low", 9).alias("low"), F.round("high", 9).alias("high")
    )


@query(
    "output_stability",
    o.with_(*o.FORMULA_CHAIN) + "SELECT count(*) AS rows, TRUE AS stable FROM completed",
)
def _(b: Bed):
    columns = ["rule_id", "shape_name", "target_name", "prop_path", "severity", "message"]
    other = Bed(b.spark, b.sf_dir)
    return quality.stable(b.built.select(*columns), other.built.select(*columns))


# --- runs -----------------------------------------------------------------------------------


def run_funnels(b: Bed) -> DataFrame:
    """Funnel rows of every run setting: document sentences up to the rules, the rules of the parts, which
    have stored formula responses, from there on."""
    return pipeline.run_counts(
        b.sentences, lambda req: t.classification_store(req), t.second_store,
        lambda _: b.rules, b.formula_store, b.direct_store,
    )


RUNS = (*o.CLASSIFIED_CHAIN, o.SECOND, """
    hintless AS (SELECT b.*, CASE WHEN raw_type IN ('obligation', 'permission', 'prohibition')
            THEN raw_confidence ELSE greatest(raw_confidence - 0.1::DOUBLE, 0.4::DOUBLE) END AS c
        FROM read b),
    plain AS (SELECT e.*, s.text FROM sentences s JOIN """ + o._expected(o.EXPECTED) + """
        ON e.kind = substr(md5(s.text), 1, 1)),
    plain_c AS (SELECT *, CASE WHEN raw_type IN ('obligation', 'permission', 'prohibition')
            THEN raw_confidence ELSE greatest(raw_confidence - 0.1::DOUBLE, 0.4::DOUBLE) END AS c
        FROM plain),
    no_may AS (SELECT s.text, strength, e.* FROM strengths s JOIN """ + o._expected(o.EXPECTED) + """
        ON e.kind = substr(md5(s.text), 1, 1) WHERE strength <> 'none' AND n_words <= 150),
    no_may_c AS (SELECT *, least(greatest(CASE WHEN raw_type IN ('obligation', 'permission',
            'prohibition') THEN raw_confidence ELSE greatest(raw_confidence - 0.1::DOUBLE,
            0.4::DOUBLE) END + CASE strength WHEN 'strong' THEN 0.15::DOUBLE WHEN 'consequence'
            THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END, 0::DOUBLE), 1::DOUBLE) AS c FROM no_may),
    sure AS (
        SELECT 'no-prefilter' AS run, text, c FROM plain_c WHERE is_rule
        UNION ALL SELECT 'no-hints', text, c FROM hintless WHERE is_rule
        UNION ALL SELECT 'no-may-disambig', text, c FROM no_may_c WHERE is_rule
        UNION ALL SELECT unnest(['baseline', 'no-fallback', 'no-fol-retry']), text, confidence
                  FROM banded WHERE is_rule
        UNION ALL SELECT 'no-reclassify', text, confidence FROM banded WHERE is_rule),
    ruled AS (SELECT run, count(*) AS n FROM sure WHERE c >= 0.6::DOUBLE OR (c >= 0.4::DOUBLE
        AND run <> 'no-reclassify' AND substr(md5(text), 2, 1) NOT IN ('1', '2', '5', 'f'))
        GROUP BY run)""", """
    fronts AS (SELECT run, n AS rules_classified, CASE run
        WHEN 'no-prefilter' THEN (SELECT count(*) FROM sentences)
        WHEN 'no-may-disambig' THEN (SELECT count(*) FROM strengths WHERE strength <> 'none'
                                     AND n_words <= 150)
        ELSE (SELECT count(*) FROM decided WHERE is_candidate) END AS candidates_prefiltered
        FROM ruled)""", *o.FORMULA_CHAIN, rule_queries.FAILED, rule_queries.DIRECT, """
    answers_of AS (SELECT best.ok FROM failed f JOIN best ON best.text = f.text),
    formed AS (SELECT count(*) AS ok, count(*) FILTER (attempt > 0) AS retried FROM completed),
    funnels AS (
        SELECT run, candidates_prefiltered, rules_classified, ok AS formulas_ok,
               (SELECT count(*) FROM failed) AS formulas_failed,
               CASE run WHEN 'no-fol-retry' THEN 0 ELSE retried END AS formulas_retried,
               ok + n AS shapes_total, ok + n_ok AS shapes_valid, n AS shapes_direct_nl
        FROM fronts, formed, LATERAL (
            SELECT CASE run WHEN 'no-fallback' THEN 0 ELSE (SELECT count(*) FROM answers_of) END AS n,
                   CASE run WHEN 'no-fallback' THEN 0 ELSE (SELECT count(*) FROM answers_of WHERE ok) END AS n_ok))""")


@query("run_settings", o.with_(*RUNS) + "SELECT * FROM funnels")
def _(b: Bed):
    return run_funnels(b)


@query(
    "run_comparison",
    o.with_(*RUNS, """
    metrics AS (UNPIVOT funnels ON COLUMNS(* EXCLUDE run) INTO NAME metric VALUE value)""")
    + """SELECT m.run, m.metric, b.value AS base, m.value, m.value - b.value AS change
         FROM metrics m JOIN metrics b ON b.metric = m.metric AND b.run = 'baseline'
         WHERE m.run <> 'baseline'""",
)
def _(b: Bed):
    """Differences of the run settings against the baseline."""
    return triage.compare_runs(stored(run_funnels(b)))


@query(
    "step_statistics",
    o.with_(*o.CLASSIFIED_CHAIN, o.SECOND, *o.FORMULA_CHAIN)
    + """SELECT 'sentences' AS step, count(*) AS rows FROM sentences
         UNION ALL SELECT 'candidates', count(*) FROM decided WHERE is_candidate
         UNION ALL SELECT 'requests', count(*) FROM decided WHERE is_candidate
         UNION ALL SELECT 'classified', count(*) FROM banded
         UNION ALL SELECT 'rules', count(*) FROM final_rules
         UNION ALL SELECT 'formulas', count(*) FROM part_rules""",
)
def _(b: Bed):
    """Rows of the steps, counted in the passes that write them."""
    from normspark.operators import classify, formalize, prefilter, segment

    run = pipeline.Run(None, b.config, scratch(b, "steps"))
    sentences = run.step("sentences", segment.sentences(b.pages))
    candidates = run.step("candidates", prefilter.candidates(sentences, b.config))
    requests = run.step("requests", classify.requests(candidates, b.config).drop("request"))
    answered = run.step("classified", classify.classified(requests, t.classification_store(requests)))
    run.step("rules", classify.second_opinion(answered, t.second_store(answered), b.config))
    run.step("formulas", formalize.formalised(b.rules, b.formula_store, b.config))
    return run.statistics_table(b.spark)


@query(
    "error_log",
    o.with_(
        *o.CLASSIFIED_CHAIN, *o.FORMULA_CHAIN, *rule_queries.SHAPE_PARTS, rule_queries.OVERRIDES,
    )
    + """SELECT 'classify' AS step, text AS message FROM (SELECT DISTINCT text, deontic_strength, speech_act
             FROM decided WHERE is_candidate AND substr(md5(text), 1, 1) = 'f')
         UNION ALL
         SELECT 'shapes', 'ait:' || permission || ' deontic:overrides ait:' || obligation || ' .' FROM overrides""",
)
def _(b: Bed):
    """Requests without a response, and overrides."""
    from normspark.operators import responses
    from normspark.operators import shapes as shp

    missing = responses.pending(b.requests, b.store).select(F.col("text").alias("message"))
    links = shp.override_triples(shp.overrides(b.built), b.config).select(F.col("line").alias("message"))
    return triage.error_log({"classify": missing, "shapes": links})


@query(
    "generated_shape_results",
    o.with_(
        *o.FORMULA_CHAIN, *rule_queries.SHAPE_PARTS, rule_queries.FAILED, rule_queries.DIRECT, ANSWERED,
        o.ENTITY_TABLES, o.LATEST, o.ENTITY_FACTS,
        o.role("edges2", m.SUBCLASS_EDGES),
        o.CLOSURE.replace("edges", "edges2"),
        f"""
    wanted AS (
        SELECT '{m.NS}' || replace(rule_id, '-', '_') || 'Shape_prop1' AS source_shape, prop_path AS path,
               target_class, deontic_type FROM built WHERE target_kind = 'class'
        UNION ALL
        SELECT shape_id, path, 'Student', CASE path WHEN 'feesPaid' THEN 'obligation' WHEN 'cookInUnit'
               THEN 'prohibition' END FROM answered),
    expected AS (
        SELECT w.*, e.id FROM wanted w
        JOIN closure c ON c.sup = '{m.NS}' || w.target_class
        JOIN entity_rows e ON c.sub = '{m.NS}' || e.class),
    seen AS (SELECT x.*, (SELECT count(*) FROM facts f WHERE f.id = x.id AND f.p = x.path)
             AS n FROM expected x)""",
    )
    + """SELECT source_shape, count(*) AS n FROM seen
         WHERE (deontic_type = 'obligation' AND n < 1) OR (deontic_type = 'prohibition' AND n > 0)
         GROUP BY 1""",
)
def _(b: Bed):
    """Results of the shapes made from formulas and of those given as answers."""
    from normspark.operators import shapes as shp

    own, answered = shp.generated_tables(stored(b.built), b.config), b.answered
    shapes, constraints = (x.unionByName(y.select(*x.columns)) for x, y in zip(own, answered, strict=True))
    return va.result_counts(b.entity_triples, shapes, constraints, b.config, b.edges)


@query(
    "funnel_report",
    o.with_(
        *o.CLASSIFIED_CHAIN, o.SECOND, *o.FORMULA_CHAIN, *o.RESULT_CHAIN, BY_SHAPE,
    )
    + """SELECT 'baseline' AS run, (SELECT count(*) FROM sentences) AS sentences_extracted,
         (SELECT count(*) FROM decided WHERE is_candidate) AS candidates_prefiltered,
         (SELECT count(*) FROM final_rules) AS rules_classified,
         (SELECT count(*) FROM completed) AS formulas_ok,
         (SELECT count(*) FROM part_rules) - (SELECT count(*) FROM completed) AS formulas_failed,
         (SELECT count(*) FROM completed) AS shapes_total,
         (SELECT count(*) FROM completed) AS shapes_valid,
         (SELECT count(*) FROM completed) AS shapes_fol_mediated,
         CAST(0 AS BIGINT) AS shapes_direct_nl, CAST(0 AS BIGINT) AS shapes_fol_fallback,
         FALSE AS validation_conforms, (SELECT count(*) FROM results) AS violations,
         (SELECT CAST(coalesce(sum(count) FILTER (likely_false_positive), 0) AS BIGINT)
          FROM by_shape) AS likely_false_positives,
         (SELECT CAST(sum(count) FILTER (NOT likely_false_positive) AS BIGINT) FROM by_shape)
             AS actionable_violations,
         (SELECT count(*) FROM (SELECT DISTINCT text, deontic_strength, speech_act FROM decided
          WHERE is_candidate AND substr(md5(text), 1, 1) = 'f')) AS total_errors""",
)
def _(b: Bed):
    from normspark.operators import classify, formalize, responses

    students = (
        va.entity_types(b.triples, b.edges, b.domains)
        .filter(F.col("class").endswith("#Student"))
        .agg(F.countDistinct("focus").alias("n"))
        .scalar()
    )
    rows = stored(b.classified)
    missing = responses.pending(b.requests, b.store)
    errors = triage.error_log({"classify": missing.select(F.col("text").alias("message"))})
    return triage.funnel(
        "baseline",
        stored(b.sentences),
        b.requests,
        classify.second_opinion(rows, t.second_store(rows), b.config),
        b.formulas,
        formalize.failed(b.formalised),
        b.built,
        stored(b.results),
        students,
        errors,
    )


# --- sinks: written to the work folder and read back -----------------------------------------


def scratch(b: Bed, name: str) -> str:
    import uuid

    return f"{work_dir(b.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "rules_and_formulas_sink",
    rule_queries.on_formulas("SELECT rule_id, deontic_formula, subject FROM completed"),
)
def _(b: Bed):
    """Written twice for one run and once for another; the rerun replaces its own run."""
    folder = scratch(b, "rules")
    for run in ("baseline", "no-hints", "baseline"):
        sinks.rules_and_formulas(b.rules, b.formulas, run, folder)
    schema = "rule_id STRING, deontic_formula STRING, subject STRING"
    return sinks.committed(b.spark, f"{folder}/fol_formulas", schema, "baseline", "json")


@query(
    "shape_text_sink",
    rule_queries.on_shapes(
        """
        SELECT source, value, count(*) AS n FROM (
            SELECT source_document AS source, unnest(string_split(turtle_text, chr(10))) AS value FROM rendered
            UNION ALL
            SELECT b.source_document, 'ait:' || permission || ' deontic:overrides ait:' || obligation || ' .'
            FROM overrides o JOIN built b ON b.shape_name = o.permission
            UNION ALL
            SELECT f.source_document, unnest(string_split(best.block, chr(10)))
            FROM failed f JOIN best ON best.text = f.text)
        WHERE value <> '' GROUP BY ALL
        """,
        rule_queries.RENDERED, rule_queries.OVERRIDES, rule_queries.FAILED, rule_queries.DIRECT,
    ),
)
def _(b: Bed):
    """Lines of the shape files: rendered blocks, answered blocks and overrides; without prefixes."""
    from normspark.operators import formalize
    from normspark.operators import shapes as shp

    folder = scratch(b, "shapes")
    rendered = shp.rendered(stored(b.built), b.config).withColumn("source", F.col("source_document"))
    failed = formalize.failed(b.formalised)
    direct = shp.direct_shapes(failed, b.direct_store, b.config).join(
        failed.select("rule_id", "ordinal", F.col("source_document").alias("source")), "rule_id"
    )
    names = rendered.select("source", F.col("shape_name").alias("permission"))
    links = shp.override_triples(shp.overrides(rendered), b.config).withColumn(
        "permission", F.substring_index("s", "#", -1)
    )
    sinks.shape_text(rendered, b.config, folder, direct, links.join(names, "permission"))
    lines = b.spark.read.text(folder).filter("value <> '' AND value NOT LIKE '@prefix%'")
    return lines.groupBy("source", "value").agg(F.count("*").alias("n"))


@query(
    "report_sink",
    on_results(
        """SELECT count(*) AS violation_count, (SELECT count(DISTINCT s) FROM triples) AS entity_count,
           count(*) = 0 AS conforms FROM results"""
    ),
)
def _(b: Bed):
    folder = scratch(b, "report")
    sinks.report(va.summary(b.triples, b.shapes, b.results, None), "baseline", folder)
    schema = "violation_count BIGINT, entity_count BIGINT, conforms BOOLEAN"
    return sinks.committed(b.spark, f"{folder}/pipeline_report", schema, "baseline", "json")


@query(
    "validation_sink",
    on_results(
        """SELECT source_shape, component, count(*) AS n, (SELECT count(*) FROM results) AS violation_count
           FROM results GROUP BY ALL"""
    ),
)
def _(b: Bed):
    """All results and the counts beside them, as the validation sink leaves them."""
    folder = scratch(b, "validation")
    results = stored(b.results)
    sinks.validation(va.summary(b.triples, b.shapes, results, None), results, folder)
    total = b.spark.read.schema("violation_count BIGINT").json(f"{folder}/validation_summary")
    by_shape = b.spark.read.parquet(f"{folder}/results").groupBy("source_shape", "component")
    return by_shape.agg(F.count("*").alias("n")).withColumn(
        "violation_count", total.select("violation_count").scalar()
    )


@query(
    "formula_pair_sink",
    rule_queries.on_formulas(
        f"""SELECT 'Write the rule as a deontic formula.' || chr(10) || 'Type: ' || rule_type
            || chr(10) || 'Rule: "' || text || '"' AS prompt, deontic_formula, 2 * count(*) AS n
            FROM completed WHERE NOT ({rule_queries.PLACEHOLDER_AFTER}) GROUP BY ALL"""
    ),
)
def _(b: Bed):
    """Appended twice, so every pair is there twice."""
    folder = scratch(b, "pairs")
    sinks.append_formula_pairs(b.formulas, folder)
    sinks.append_formula_pairs(b.formulas, folder)
    pairs = b.spark.read.schema("prompt STRING, completion STRING").json(folder)
    formula = F.get_json_object("completion", "$.deontic_formula").alias("deontic_formula")
    return pairs.groupBy("prompt", formula).agg(F.count("*").alias("n"))


@query(
    "run_partition_sink",
    o.with_(o.RULES)
    + """SELECT run, rule_type, count(*) AS n FROM (SELECT unnest(['baseline', 'no-hints']) AS run, rule_type
         FROM part_rules) GROUP BY ALL""",
)
def _(b: Bed):
    """Three writes of two runs; what is committed has each run once."""
    folder, rules = scratch(b, "runs"), stored(b.rules)
    for run in ("baseline", "no-hints", "baseline"):
        sinks.commit(rules, run, folder)
    whole = sinks.committed(b.spark, folder, rules.schema)
    return whole.groupBy("run", "rule_type").agg(F.count("*").alias("n"))


@query(
    "entity_text_sink",
    on_entities(
        """SELECT value, count(*) AS n FROM (
               SELECT unnest(string_split(lines, chr(10))) AS value FROM texts
               UNION ALL SELECT 'ait:' || entity_id || ' a ait:' || class FROM texts
               UNION ALL SELECT DISTINCT '# --- ' || CASE class WHEN 'Faculty' THEN 'Faculty' WHEN 'Employee'
                   THEN 'Staff' WHEN 'Committee' THEN 'Committees' ELSE 'Students' END || ' ---' FROM texts)
           GROUP BY value""",
        TEXT_LINES,
    ),
)
def _(b: Bed):
    """Lines of the entity text: section titles, heads and properties, without comments and prefixes."""
    folder = scratch(b, "entities")
    sinks.entity_text(en.text_blocks(b.entities, b.config), b.config, folder)
    lines = b.spark.read.text(folder).filter(r"value RLIKE '^(    |ait:|# --- )'")
    bare = F.regexp_replace(F.trim("value"), " [;.]$", "")
    return lines.groupBy(bare.alias("value")).agg(F.count("*").alias("n"))
