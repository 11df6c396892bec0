"""The given test tables in the roles of the rule model.

Each text is a SELECT both engines accept; {customer} and the like stand for the given tables.
Every row of a given table takes part. CASEs on keys only vary the kind of row.
"""

from __future__ import annotations

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

STUDENTS = """
SELECT 'ST' || CAST(c_custkey AS STRING) AS student_id,
       c_mktsegment AS first_name,
       substring(c_name, 10) AS last_name,
       lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@example.org' AS email,
       'Program ' || CAST(c_nationkey AS STRING) AS program,
       CASE WHEN c_nationkey < 5 THEN 'PhD' ELSE 'Master' END AS degree_level,
       CASE WHEN c_acctbal < 0 THEN 'Suspended' WHEN c_acctbal > 9000 THEN 'Graduated'
            ELSE 'Active' END AS enrollment_status,
       c_nationkey > 20 AS is_new_student
FROM {customer}
"""

FEE_RECORDS = """
SELECT 'ST' || CAST(o_custkey AS STRING) AS student_id,
       CAST(year(o_orderdate) AS STRING) || '-' || CAST(quarter(o_orderdate) AS STRING) AS semester,
       CAST(o_totalprice AS DECIMAL(12,2)) AS tuition_amount,
       CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'
                 THEN CAST(o_totalprice AS DECIMAL(12,2))
            WHEN o_orderstatus = 'P' THEN CAST(1000 AS DECIMAL(12,2))
            WHEN o_orderstatus = 'F' THEN CAST(1 AS DECIMAL(12,2))
            ELSE NULL END AS amount_paid,
       CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'P' THEN 'Partial' ELSE 'Overdue' END
            AS payment_status,
       o_orderstatus <> 'O' AS first_installment_paid,
       o_orderkey AS record_no
FROM {orders}
"""

ACCOMMODATIONS = """
SELECT 'ST' || CAST(o_custkey AS STRING) AS student_id,
       'Block ' || CAST(l_suppkey AS STRING) AS building,
       'R' || CAST(l_partkey AS STRING) AS room_number,
       CASE WHEN l_quantity > 25 THEN 'Double' ELSE 'Single' END AS room_type,
       CAST(l_shipdate AS DATE) AS check_in_date,
       l_returnflag = 'A' AS deposit_paid,
       l_returnflag <> 'R' AS rent_current,
       l_linestatus = 'O' AS with_spouse,
       l_quantity < 5 AS on_waiting_list,
       l_quantity > 10 AS provided_arrival_date,
       l_discount < 0.08 AS room_clean,
       l_tax < 0.06 AS common_area_clean,
       l_linenumber < 6 AS unit_hygiene,
       l_quantity > 5 AS confirmed_offer,
       CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_returnflag = 'N' END AS vacated_on_time,
       l_orderkey AS tie_order, l_linenumber AS tie_line, l_partkey AS tie_part,
       CAST(l_extendedprice AS DECIMAL(14,2)) AS tie_price
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

STUDENT_CONDUCT = """
SELECT 'ST' || CAST(user_id AS STRING) AS student_id,
       count(CASE WHEN event_type = 'error' THEN 1 END) < 18 AS ethical_conduct,
       CASE WHEN count(CASE WHEN event_type = 'view' THEN 1 END) < 9 THEN NULL
            ELSE count(CASE WHEN event_type = 'view' THEN 1 END) < 16 END AS peaceful_environment,
       count(CASE WHEN event_type = 'click' THEN 1 END) < 17 AS library_responsible_use,
       count(CASE WHEN event_type = 'signup' THEN 1 END) < 16 AS it_acceptable_use,
       count(CASE WHEN event_type = 'purchase' THEN 1 END) > 10 AS brings_concerns_to_attention,
       max(CASE WHEN event_type = 'error' THEN value END) > 120 AS cooking_in_dorm,
       max(CASE WHEN event_type = 'view' THEN value END) > 110 AS noisy_in_dorm,
       max(CASE WHEN event_type = 'click' THEN value END) > 140 AS pet_in_dorm,
       max(CASE WHEN event_type = 'signup' THEN value END) > 100 AS disturbing_residents
FROM {events} GROUP BY user_id
"""

ACADEMIC_RECORDS = """
SELECT 'ST' || CAST(doc_id AS STRING) AS student_id,
       quality = 1 AS registered_with_registry,
       CASE WHEN toxic = 1 THEN NULL ELSE quality = 1 END AS grade_determined_in_courses,
       toxic = 0 AS makeup_classes_scheduled,
       quality = 1 AND toxic = 0 AS serves_as_corresponding_author,
       toxic = 1 AS corresponds_with_journal,
       quality = 0 AS first_author_in_multi_authored
FROM {labels}
"""

CONDUCT_RECORDS = """
SELECT 'ST' || CAST(user_id AS STRING) AS student_id,
       event_type AS incident_type,
       CAST(ts AS DATE) AS incident_date,
       CASE WHEN value > 20 THEN 'Escalated' ELSE 'Open' END AS status
FROM {events}
"""

FACULTY = """
SELECT s_suppkey AS id,
       'FA' || CAST(s_suppkey AS STRING) AS faculty_id,
       CASE WHEN s_nationkey < 12 THEN 'Dr.' ELSE 'Prof.' END AS title,
       'Supplier' AS first_name,
       substring(s_name, 10) AS last_name,
       'Nation ' || CAST(s_nationkey AS STRING) AS department,
       CASE WHEN s_acctbal > 5000 THEN 'Professor' ELSE 'Lecturer' END AS position,
       s_acctbal > 0 AS grading_criteria_published,
       s_nationkey <> 3 AS follows_disciplinary_procedures,
       s_acctbal < 8000 AS discloses_conflicts,
       CASE WHEN s_nationkey = 5 THEN NULL ELSE s_acctbal > 2000 END AS reports_cheating_suspects
FROM {supplier}
"""

STAFF = """
SELECT p_partkey AS id,
       'SF' || CAST(p_partkey AS STRING) AS staff_id,
       p_type AS first_name,
       p_name AS last_name,
       p_brand AS department,
       CASE WHEN p_size > 25 THEN 'Officer' ELSE 'Clerk' END AS role,
       p_size > 10 AS gifts_reported,
       p_retailprice < 1500 AS settlements_reported,
       p_size < 40 AS fees_managed_properly,
       p_type <> 'PROMO' AS ethical_authority_use
FROM {part}
"""

COMMITTEES = """
SELECT n_nationkey AS id,
       'Board & Panel ' || n_name AS committee_name,
       CASE WHEN n_regionkey = 0 THEN 'Grievance' ELSE 'Standing' END AS committee_type,
       n_regionkey <> 1 AS chair_elected,
       n_nationkey > 2 AS is_active,
       n_regionkey = 0 AS handles_grievances,
       n_nationkey < 20 AS maintains_confidentiality,
       n_nationkey <> 4 AS records_facts,
       n_regionkey = 2 AS convenes_tribunals
FROM {nation}
"""

ENTITY_TABLES = {
    "students": STUDENTS,
    "fee_records": FEE_RECORDS,
    "accommodations": ACCOMMODATIONS,
    "student_conduct": STUDENT_CONDUCT,
    "academic_records": ACADEMIC_RECORDS,
    "conduct_records": CONDUCT_RECORDS,
    "faculty": FACULTY,
    "staff": STAFF,
    "committees": COMMITTEES,
}
TIES = {
    "fee_records": ["record_no"],
    "accommodations": ["tie_order", "tie_line", "tie_part", "tie_price"],
}

# --- typed values of students, for the value checks -----------------------------------------

NS = "http://example.org/ait-policy#"

VALUE_TRIPLES = f"""
SELECT '{NS}ST' || CAST(o_custkey AS STRING) AS s, '{NS}feeAmount' AS p,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 'about ' ELSE '' END
           || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) AS o,
       'literal' AS o_kind,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'string' ELSE 'decimal' END AS datatype
FROM {{orders}}
UNION ALL
SELECT '{NS}ST' || CAST(o_custkey AS STRING), '{NS}dueDate',
       CASE WHEN o_orderstatus = 'P' THEN CAST(year(o_orderdate) AS STRING) || '-13-01'
            ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END,
       'literal', 'date'
FROM {{orders}}
UNION ALL
SELECT '{NS}ST' || CAST(c_custkey AS STRING), '{NS}studentid',
       CASE WHEN c_nationkey < 10 THEN c_name ELSE 'AB' || substring(c_name, 10) END,
       'literal', 'string'
FROM {{customer}}
UNION ALL
SELECT '{NS}ST' || CAST(c_custkey AS STRING), '{NS}sponsoredBy',
       '{NS}Nation' || CAST(c_nationkey AS STRING), 'iri', CAST(NULL AS STRING)
FROM {{customer}}
"""

# --- configuration tables: ontology, curated shapes -----------------------------------------


def _rows(columns: tuple, rows: list[tuple]) -> str:
    def sql(x):
        if x is None:
            return "CAST(NULL AS STRING)"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    parts = []
    for row in rows:
        cells = ", ".join(f"{sql(x)} AS {c}" for x, c in zip(row, columns))
        parts.append(f"SELECT {cells}")
    return "\nUNION ALL\n".join(parts)


SUBCLASS_EDGES = _rows(
    ("sub", "sup"),
    [
        (NS + a, NS + b)
        for a, b in (
            ("Student", "Person"), ("PostgraduateStudent", "Student"),
            ("UndergraduateStudent", "Student"), ("Employee", "Person"),
            ("Faculty", "Employee"), ("Staff", "Employee"), ("GrievanceCommittee", "Committee"),
        )
    ],
)
DOMAINS = _rows(
    ("p", "domain", "range"),
    [
        (NS + "sponsoredBy", NS + "Student", NS + "Sponsor"),
        (NS + "feeAmount", NS + "Payer", None),
        (NS + "dueDate", NS + "Payer", None),
    ],
)


def _shape(name: str, target: str, severity: str, kind: str = "class") -> tuple:
    return (NS + name, kind, NS + target, severity)


SHAPES = _rows(
    ("shape_id", "target_kind", "target", "severity"),
    [
        _shape("AIT_0007Shape", "Student", "Violation"),
        _shape("AIT_0219Shape", "Student", "Warning"),
        _shape("AIT_0068Shape", "Student", "Violation"),
        _shape("AIT_0056Shape", "Student", "Info"),
        _shape("AIT_0086Shape", "Student", "Violation"),
        _shape("AIT_0089Shape", "PostgraduateStudent", "Violation"),
        _shape("AIT_0005Shape", "Faculty", "Violation"),
        _shape("AIT_0101Shape", "Employee", "Warning"),
        _shape("AIT_0301Shape", "Person", "Violation"),
        _shape("AIT_0302Shape", "Payer", "Violation"),
        _shape("AIT_0303Shape", "cookInUnit", "Violation", "subjects_of"),
        _shape("AIT_0304Shape", "studentid", "Warning", "subjects_of"),
        _shape("AIT_0305Shape", "Sponsor", "Violation"),
        _shape("AIT_0306Shape", "Committee", "Info"),
        _shape("AIT_0307Shape", "Nobody", "Info"),
    ],
)


def _check(shape, prop, path, least=None, most=None, kind=None, pattern=None, named=True, msg=None):
    return (
        NS + shape, NS + prop if named else prop, named, NS + path, least, most, kind, pattern,
        msg, None,
    )


CONSTRAINTS = _rows(
    (
        "shape_id", "prop_id", "named", "path", "min_count", "max_count", "datatype", "pattern",
        "message", "severity",
    ),
    [
        _check("AIT_0007Shape", "AIT_0007Shape_prop1", "payFirstSemesterFee", "1",
               msg="Students must pay the first semester fee."),
        _check("AIT_0219Shape", "AIT_0219Shape_prop1", "feesPaid", "1",
               msg="Fees must be paid."),
        _check("AIT_0068Shape", "AIT_0068Shape_prop1", "confirmOfferMove", "1",
               msg="Students must confirm the offer."),
        _check("AIT_0056Shape", "_:b56a", "vacateRoom", "1", named=False),
        _check("AIT_0056Shape", "_:b56b", "vacateRoom", "1", named=False),
        _check("AIT_0086Shape", "AIT_0086Shape_prop1", "cookInProhibitedDormitory", None, "0",
               msg="Students must not cook in dormitories."),
        _check("AIT_0089Shape", "AIT_0089Shape_prop1", "petInStudentAccommodation", None, "none",
               msg="No pets."),
        _check("AIT_0005Shape", "AIT_0005Shape_prop1", "followProceduresForDisciplinaryActions",
               "1", msg="Faculty must follow procedures."),
        _check("AIT_0101Shape", "AIT_0101Shape_prop1", "disclose", "1.0",
               msg="Employees must disclose conflicts."),
        _check("AIT_0301Shape", "_:b301", "sponsoredBy", "1", named=False),
        _check("AIT_0302Shape", "AIT_0302Shape_prop1", "feeAmount", "2", "12", "decimal",
               msg="Fee amounts are decimals, two to twelve of them."),
        _check("AIT_0302Shape", "AIT_0302Shape_prop2", "dueDate", None, None, "date",
               msg="Due dates are dates."),
        _check("AIT_0303Shape", "AIT_0303Shape_prop1", "cookInUnit", None, "0",
               msg="Cooking in units is forbidden."),
        _check("AIT_0304Shape", "AIT_0304Shape_prop1", "studentid", "1", None, "string",
               "^[A-Z0-9]{6,12}$", msg="Student numbers have six to twelve characters."),
        _check("AIT_0305Shape", "AIT_0305Shape_prop1", "sponsorStatus", "1", named=True,
               msg="Sponsors must state their status."),
        _check("AIT_0306Shape", "_:b306", "recordFacts", "1", named=False),
        _check("AIT_0306Shape", "_:b306", "writeDownGrievanceFacts", "1", named=False),
    ],
)

# --- rules written out of parts -------------------------------------------------------------

VERB = (
    "CASE p_type WHEN 'STANDARD' THEN 'pay' WHEN 'PROMO' THEN 'submit' WHEN 'LARGE' THEN 'maintain'"
    " WHEN 'MEDIUM' THEN 'attend' WHEN 'ECONOMY' THEN 'keep' ELSE 'disturb' END"
)
NOUN = "split_part(p_name, ' ', 2)"
NOUN_UP = f"upper(substring({NOUN}, 1, 1)) || substring({NOUN}, 2)"
SUBJECT = (
    "CASE p_partkey % 13 WHEN 0 THEN 'Students' WHEN 1 THEN 'The faculty' WHEN 2 THEN 'Employees'"
    " WHEN 3 THEN 'Researchers' WHEN 4 THEN 'Applicants' WHEN 5 THEN 'Residents'"
    " WHEN 6 THEN 'Guests' WHEN 7 THEN 'Members' WHEN 8 THEN 'Department'"
    " WHEN 9 THEN 'The committee' WHEN 10 THEN 'Postgraduate students' WHEN 11 THEN 'Sponsors'"
    " ELSE 'Every adviser' END"
)
MODAL = (
    "CASE p_size % 8 WHEN 0 THEN ' must ' WHEN 1 THEN ' shall ' WHEN 2 THEN ' may '"
    " WHEN 3 THEN ' must not ' WHEN 4 THEN ' is required to ' WHEN 5 THEN ' cannot '"
    " WHEN 6 THEN ' should ' ELSE ' ' END"
)
TAIL = (
    "CASE p_brand WHEN 'Brand#1' THEN ' before the deadline.' WHEN 'Brand#2' THEN"
    " ' by the end of the semester.' WHEN 'Brand#3' THEN ' in residential areas.'"
    " WHEN 'Brand#4' THEN ' with payment of the fee.' WHEN 'Brand#5' THEN"
    " ' if the visa extension is approved by the director of the office.'"
    " WHEN 'Brand#6' THEN ' for the grade assessment, and leave for travel.'"
    " WHEN 'Brand#7' THEN ' \"as is\" at the account center.' ELSE '.' END"
)
PART_RULES = f"""
SELECT p_partkey AS ordinal,
       'AIT-' || CASE WHEN length(CAST(p_partkey AS STRING)) < 4
                      THEN lpad(CAST(p_partkey AS STRING), 4, '0')
                      ELSE CAST(p_partkey AS STRING) END AS rule_id,
       {SUBJECT} || {MODAL} || {VERB} || ' the ' || p_name || {TAIL} AS text,
       p_brand AS source_document,
       CASE WHEN p_size % 8 IN (3, 5) THEN 'prohibition' WHEN p_size % 8 = 2 THEN 'permission'
            ELSE 'obligation' END AS rule_type,
       CAST(p_size AS DOUBLE) / 50 AS confidence
FROM {{part}}
"""

VOCABULARY = f"""
SELECT prop, CAST(row_number() OVER (ORDER BY prop) AS BIGINT) AS ord FROM (
    SELECT DISTINCT {VERB} || {NOUN_UP} AS prop FROM {{part}}
    UNION
    SELECT DISTINCT replace(p_name, ' ', '_') FROM {{part}}
    UNION
    SELECT DISTINCT lower({VERB} || {NOUN_UP}) FROM {{part}}
    UNION
    SELECT DISTINCT 'semester' || split_part(p_name, ' ', 1) || 'payment' FROM {{part}}
) v
"""

_PRED = (
    f"CASE p_size % 5 WHEN 0 THEN {VERB} || {NOUN_UP} WHEN 1 THEN lower({VERB} || {NOUN_UP})"
    f" WHEN 2 THEN {VERB} || {NOUN_UP} || 's' WHEN 3 THEN 'zzUnrelated_Qq'"
    f" ELSE upper(substring({VERB}, 1, 1)) || substring({VERB}, 2) || {NOUN_UP} END"
)
_ROLE = (
    "CASE p_partkey % 13 WHEN 0 THEN 'the students' WHEN 1 THEN 'faculty' WHEN 2 THEN 'employee'"
    " WHEN 10 THEN 'postgraduate students' WHEN 6 THEN '' ELSE 'person' END"
)
_SYMBOL = "CASE WHEN p_size % 8 IN (3, 5) THEN 'F' WHEN p_size % 8 = 2 THEN 'P' ELSE 'O' END"
_KIND = (
    "CASE WHEN p_size % 8 IN (3, 5) THEN 'prohibition' WHEN p_size % 8 = 2 THEN 'permission'"
    " ELSE 'obligation' END"
)


def _json(formula: str, predicates: str | None, expansion: bool = True) -> str:
    """SQL text that builds a formula response."""
    tail = '", "fol_expansion": "ALL x"' if expansion else '"'
    parts = [
        """'{"deontic_type": "'""", _KIND, """'", "deontic_formula": "'""", formula, f"'{tail}'",
    ]
    if predicates:
        parts += ["""', "predicates": '""", predicates]
    return " || ".join(parts + ["'}'"])


_GOOD = _SYMBOL + " || '(' || " + _PRED + " || '(x' || " + NOUN + " || '))'"
_STOCK = _SYMBOL + " || '(Action(x))'"
_PREDS = " || ".join(
    ["""'{"subject": "'""", _ROLE, """'", "action": "'""", _PRED, """'", "condition": ""}'"""]
)
_STOCK_PREDS = """'{"subject": "x", "action": "Action"}'"""
_LIST_PREDS = " || ".join(
    [
        """'{"subject": {"name": "'""", _ROLE, """'"}, "action": ["'""", VERB, """'", "'""", NOUN,
        """'"], "condition": {"a": "on", "b": "time"}}'""",
    ]
)

# Response kinds by p_partkey % 10: good at attempt 0, 1 or 2; never good; no object; no
# expansion; list and object predicates; no predicates; never good with one attempt. Rules of
# one brand have no response yet.
FORMULA_RESPONSES = f"""
SELECT r.rule_id, r.text, r.rule_type, a.attempt,
       CASE
         WHEN p_partkey % 10 IN (0, 1, 2) AND a.attempt >= p_partkey % 10
              THEN 'Here: ' || {_json(_GOOD, _PREDS)}
         WHEN p_partkey % 10 IN (1, 2, 3) THEN {_json(_STOCK, _STOCK_PREDS)}
         WHEN p_partkey % 10 = 4 THEN 'cannot be expressed'
         WHEN p_partkey % 10 = 5 THEN {_json(_GOOD, _PREDS, False)}
         WHEN p_partkey % 10 = 6 THEN {_json(_GOOD, _LIST_PREDS)}
         WHEN p_partkey % 10 = 7 THEN {_json(_GOOD, None)}
         ELSE {_json(_STOCK, _STOCK_PREDS)}
       END AS response_json
FROM ({PART_RULES}) r
JOIN {{part}} ON p_partkey = r.ordinal
JOIN (SELECT 0 AS attempt UNION ALL SELECT 1 UNION ALL SELECT 2) a
  ON a.attempt <= CASE WHEN p_partkey % 10 IN (1, 2, 3) THEN 2 ELSE 0 END
WHERE p_brand <> 'Brand#9'
"""

DIRECT_RESPONSES = """
SELECT rule_id, text, rule_type, attempt,
       CASE WHEN ordinal % 3 = 0 OR attempt = 2 OR (ordinal % 3 = 1 AND attempt = 1)
            THEN '```turtle' || chr(10) || 'ait:' || replace(rule_id, '-', '_')
                 || 'Shape a sh:NodeShape ; sh:targetClass ait:Student ;' || chr(10)
                 || '  sh:severity sh:' || CASE WHEN ordinal % 2 = 0 THEN 'Info' ELSE 'Violation' END
                 || ' ; sh:property [ sh:path ait:' || CASE rule_type
                    WHEN 'obligation' THEN 'feesPaid ; sh:minCount 1' WHEN 'prohibition'
                    THEN 'cookInUnit ; sh:maxCount "0" ; sh:datatype xsd:boolean'
                    ELSE 'x ; sh:pattern "^a' || chr(92) || chr(92) || 'd"' END
                 || ' ; sh:message "a ] b" ] . # end' || chr(10) || '```'
            WHEN ordinal % 7 = 3 AND attempt = 0
            THEN 'ait:' || replace(rule_id, '-', '_') || 'Shape a sh:NodeShape ; sh:property [ sh:minCount ] .'
            WHEN ordinal % 7 = 4 AND attempt = 0
            THEN 'ait:' || replace(rule_id, '-', '_') || 'Shape a sh:NodeShape ; other:p "x" .'
            WHEN ordinal % 7 = 2 THEN ''
            ELSE 'ait:' || replace(rule_id, '-', '_') || 'Shape a sh:NodeShape ; sh:property [ sh:path'
       END AS response_json
FROM (RULES) r
JOIN (SELECT 0 AS attempt UNION ALL SELECT 1 UNION ALL SELECT 2) a
  ON a.attempt <= CASE WHEN ordinal % 3 = 0 THEN 0 WHEN ordinal % 5 = 0 THEN 1 ELSE 2 END
""".replace("RULES", PART_RULES)

# --- annotations ----------------------------------------------------------------------------

ANNOTATIONS = """
SELECT doc_id AS item_id, 'a' AS rater,
       CASE WHEN quality = 1 THEN 'obligation' ELSE 'none' END AS label FROM {labels}
UNION ALL
SELECT doc_id, 'b', CASE WHEN toxic = 1 THEN 'prohibition' WHEN quality = 1 THEN 'obligation'
       ELSE 'none' END FROM {labels}
UNION ALL
SELECT l.doc_id, 'c', CASE WHEN d.n_chars > 2000 THEN 'obligation' WHEN l.toxic = 1
       THEN 'prohibition' ELSE 'none' END
FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id
"""
PREDICTIONS = """
SELECT l.doc_id AS item_id,
       CASE WHEN d.n_chars > 1500 THEN 'obligation' WHEN l.toxic = 1 THEN 'prohibition'
            ELSE 'none' END AS label
FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id
"""

# --- response store with access times -------------------------------------------------------

STORE = """
SELECT sha2_hex AS cache_key, model, prompt_type, response_json, created_at, last_accessed,
       access_count
FROM (
    SELECT 'key' || CAST(event_id AS STRING) AS sha2_hex,
           CASE WHEN value > 20 THEN 'second' ELSE 'default' END AS model,
           event_type AS prompt_type, props AS response_json, ts AS created_at,
           ts AS last_accessed, user_id % 5 + 1 AS access_count
    FROM {events}
) s
"""


def _resolved(sql: str, name) -> str:
    for table in GIVEN:
        sql = sql.replace("{" + table + "}", name(table))
    return sql


def for_duckdb(sql: str) -> str:
    return _resolved(sql, lambda table: table)


def for_spark(sql: str) -> str:
    """The text for spark.sql with the tables as arguments; all other braces are literal."""
    marked = _resolved(sql, lambda table: f"\x01{table}\x02")
    escaped = marked.replace("{", "{{").replace("}", "}}")
    return escaped.replace("\x01", "{").replace("\x02", "}")
