"""DuckDB statements the check queries share: the test tables in their roles, step by step.

Each constant is a chain of CTEs; with_(...) puts chains together.
"""

from __future__ import annotations

from normspark import values as v
from testbed import mapping as m
from testbed import tables as t


#: stands in chains that hold a recursive step
RECURSIVE = "/* recursive */"


def with_(*parts: str) -> str:
    kind = "WITH RECURSIVE " if any(RECURSIVE in p for p in parts) else "WITH "
    return kind + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick(values: tuple, number: str) -> str:
    return f"([{', '.join(text(x) for x in values)}])[(({number}) % {len(values)}) + 1]"


def listed(values) -> str:
    return "(" + ", ".join(text(x) for x in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(text(x) for x in values) + "]"


def any_of(patterns) -> str:
    return text("(?i)" + "|".join(patterns))


def role(name: str, sql: str) -> str:
    return f"{name} AS ({m.for_duckdb(sql)})"


def cases(value: str, table, test: str, default: str = "NULL") -> str:
    """CASE over an ordered table; test is 'contains' or 'regexp_matches'."""
    whens = " ".join(
        f"WHEN {test}({value}, {text(k)}) THEN {text(x) if isinstance(x, str) else x}"
        for k, x in table
    )
    return f"CASE {whens} ELSE {default} END"


# --- pages to sentences ---------------------------------------------------------------------

PAGES = rf"""
rule_pages AS (
    SELECT source, doc_id AS page,
           {pick(t.HEADERS, 'doc_id + 4')} || chr(10) || {pick(t.PHRASES, 'doc_id')} || ' '
           || regexp_replace(
                regexp_replace(
                  regexp_replace(text, '\n([^\n]*)\n',
                    chr(10) || {pick(t.HEADERS, 'doc_id')} || chr(10) || '\1' || chr(10) || chr(10)
                    || '(a) ', 'g'),
                  '([.!?]) +([A-Z])', '\1 ' || {pick(t.PHRASES, 'doc_id')} || ' \2', 'g'),
                ', ([a-z])', ',' || chr(10) || '\1', 'g')
           || ' 3.' AS raw_text
    FROM documents)
"""

_SOFT = r"'([a-z,;:])\n([a-z])', '\1 \2', 'g'"
NORMALISED = rf"""
normalised AS (
    SELECT source, page, raw_text,
           regexp_replace(regexp_replace(
               regexp_replace(regexp_replace(raw_text, {_SOFT}), {_SOFT}),
               '\n{{2,}}', chr(10), 'g'), '[ \t]+', ' ', 'g') AS text
    FROM rule_pages)
"""
ITEMS = r"""
item_lists AS (
    SELECT source, page, string_split(regexp_replace(text,
        '\n\s*(\d+\.|\([a-z]\)|[a-z]\)|\*|\-)\s+', chr(1), 'g'), chr(1)) AS l
    FROM normalised),
items AS (
    SELECT source, page, generate_subscripts(l, 1) - 1 AS item_pos,
           regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS item
    FROM item_lists)
"""
PARTS = r"""
part_lists AS (
    SELECT source, page, item_pos, string_split(regexp_replace(regexp_replace(item,
        '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'),
        '([:;])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l
    FROM items),
parts AS (
    SELECT source, page, item_pos, generate_subscripts(l, 1) - 1 AS sent_pos, unnest(l) AS part
    FROM part_lists)
"""
FRAGMENTS = r"""
cleaned AS (
    SELECT source, page, item_pos, sent_pos,
           regexp_replace(regexp_replace(regexp_replace(part, '^\s+|\s+$', '', 'g'),
               '\s*\n?\s*\d+\.\s*$', ''), '\s+', ' ', 'g') AS text
    FROM parts),
fragments AS (SELECT * FROM cleaned WHERE length(text) >= 5)
"""
NOISE = r"""
noisy AS (
    SELECT *, len(string_split(text, ' ')) AS n_words,
           len(string_split(text, ' ')) NOT BETWEEN 5 AND 250
           OR regexp_matches(text,
              '(?i)^(page\s+\d+|\d+\s*$|www\.|http|©|\bait\b\s*\d{4}|_{3,}|-{3,})')
           OR (upper(text) = text AND regexp_matches(text, '\p{Lu}')
               AND len(string_split(text, ' ')) < 8) AS noise
    FROM fragments)
"""
SENTENCES = """
sentences AS (
    SELECT source, page, item_pos, sent_pos, text, n_words,
           regexp_replace(text, '[^\\x00-\\x7F]', 'q', 'g') AS plain
    FROM noisy WHERE NOT noise)
"""
SENTENCE_CHAIN = (PAGES, NORMALISED, ITEMS, PARTS, FRAGMENTS, NOISE, SENTENCES)

# --- prefilter ------------------------------------------------------------------------------
# plain has every letter beyond ASCII replaced by one, so that \b means the same in both engines.

MARKERS = f"""
markers AS (
    SELECT *, regexp_extract_all(plain, {any_of(v.STRONG_MARKERS)}) AS strong,
           regexp_extract_all(plain, {any_of(v.CONSEQUENCE_MARKERS)}) AS conseq,
           regexp_extract_all(plain, {any_of(v.WEAK_MARKERS)}) AS weak
    FROM sentences),
strengths AS (
    SELECT *, CASE WHEN len(strong) > 0 THEN 'strong' WHEN len(conseq) > 0 THEN 'consequence'
                   WHEN len(weak) > 0 THEN 'weak' ELSE 'none' END AS strength
    FROM markers)
"""
_SENSES = " ".join(
    f"WHEN regexp_matches(plain, {any_of(group)}) THEN '{sense}'"
    for group, sense in (
        (v.MAY_DEONTIC, "deontic"), (v.MAY_EPISTEMIC, "epistemic"),
        (v.MAY_EPISTEMIC_FINE, "epistemic"), (v.MAY_DEONTIC_FINE, "deontic"),
    )
)
MAY_SENSE = (
    f"CASE WHEN NOT regexp_matches(plain, {any_of((v.MAY,))}) THEN 'n/a' {_SENSES}"
    " ELSE 'ambiguous' END"
)
SPEECH_ACT = cases(
    "lower(text)",
    [(x, act) for act, group in v.SPEECH_ACTS for x in group],
    "contains",
    text(v.SPEECH_ACT_DEFAULT),
)


def section_weight(title: str) -> str:
    exact = " ".join(f"WHEN lower(trim({title})) = {text(k)} THEN {w}" for k, w in v.SECTION_WEIGHTS)
    partial = " ".join(
        f"WHEN contains(lower({title}), {text(k)}) THEN {w}" for k, w in v.SECTION_WEIGHTS
    )
    return f"CAST(CASE WHEN trim({title}) = '' THEN 1.0 {exact} {partial} ELSE 1.0 END AS DOUBLE)"


def decided(section: str) -> str:
    """Candidate decisions for sentences with a section given by an expression over page."""
    return f"""
placed AS (
    SELECT *, {section} AS title, {section_weight(section)} AS w, {MAY_SENSE} AS sense,
           {SPEECH_ACT} AS act FROM strengths),
reasons AS (
    SELECT *, n_words < 5 OR n_words > 150 AS off_length,
        CASE WHEN n_words < 5 THEN 'Too short (' || n_words || ' words < 5)'
             WHEN n_words > 150 THEN 'Too long (' || n_words || ' words > 150), needs splitting'
             WHEN strength = 'none' AND w < 1.2 THEN 'No deontic markers found'
             WHEN strength = 'weak' AND contains(lower(text), 'may') AND sense = 'epistemic'
                  THEN 'Epistemic ''may'' (possibility, not permission)'
             WHEN strength = 'weak' AND w < 0.5
                  THEN 'Weak deontic marker in non-rule section ''' || title || ''''
             ELSE '' END AS reason
    FROM placed),
decided AS (
    SELECT source, page, item_pos, sent_pos, text, n_words, plain,
           reason AS rejection_reason, reason = '' AS is_candidate,
           CASE WHEN off_length OR starts_with(reason, 'Epistemic') THEN 'none' ELSE strength END
                AS deontic_strength,
           CASE WHEN NOT off_length AND starts_with(reason, 'Epistemic') THEN 'assertive'
                ELSE act END AS speech_act,
           CASE WHEN off_length THEN '' ELSE title END AS section_context,
           CASE WHEN off_length THEN 1.0::DOUBLE ELSE w END AS section_weight,
           CASE WHEN reason <> '' THEN 0.0::DOUBLE WHEN strength = 'none' THEN -0.1::DOUBLE
                WHEN strength = 'strong' THEN 0.15::DOUBLE * w
                WHEN strength = 'consequence' THEN 0.10::DOUBLE * w
                ELSE 0.05::DOUBLE * w END AS confidence_boost
    FROM reasons)
"""


DECIDED_CHAIN = (*SENTENCE_CHAIN, MARKERS, decided("''"))

# --- classification -------------------------------------------------------------------------


def request_key(**parts: str) -> str:
    cells = ", ".join(f"'{name}=' || {parts[name]}" for name in sorted(parts))
    return f"sha256(concat_ws(chr(31), {cells}))"


CLASSIFY_KEY = request_key(
    text="text", model="'default'", prompt_type="'classification'", prompt_version="'2'",
    temperature="'0.0'", deontic_strength="deontic_strength", speech_act="speech_act",
)
SECOND_KEY = request_key(
    text="text", model="'second'", prompt_type="'reclassification'", prompt_version="'v1'",
    temperature="'0.0'",
)
FORMULA_KEY = request_key(
    text="text", model="'default'", prompt_type="'fol_generation'", prompt_version="'3'",
    temperature="'0.0'", rule_type="rule_type",
)
DIRECT_KEY = request_key(
    text="text", model="'default'", prompt_type="'direct_shacl'", prompt_version="'v1'",
    temperature="'0.0'",
)

# What each kind of stored answer says: is_rule, type, confidence, reasoning, object text.
EXPECTED = {
    "0": (True, "obligation", 0.9, "duty"),
    "1": (True, "permission", 0.7, "right"),
    "2": (True, "prohibition", 0.65, "ban"),
    "3": (True, "exemption", 0.75, "odd"),
    "4": (True, "none", 0.45, "unsure"),
    "5": (False, "none", 0.9, "fact"),
    "6": (False, "none", 0.0, "parse_error"),
    "7": (False, "none", 0.0, "json_decode_error"),
    "8": (True, "obligation", 0.45, ""),
    "9": (True, "obligation", 0.8, ""),
    "a": (True, "permission", 0.42, ""),
    "b": (True, "obligation", 0.5, ""),
    "c": (True, "prohibition", 0.38, ""),
    "d": (True, "obligation", 0.97, "a } b"),
    "e": (True, "", 0.62, "empty"),
}


def _expected(answers: dict) -> str:
    rows = ", ".join(
        f"('{k}', {str(r).lower()}, {text(ty)}, {c}::DOUBLE, {text(why)})"
        for k, (r, ty, c, why) in answers.items()
    )
    return f"(VALUES {rows}) e(kind, is_rule, raw_type, raw_confidence, reasoning)"


CLASSIFIED = f"""
keyed AS (SELECT *, {CLASSIFY_KEY} AS cache_key, substr(md5(text), 1, 1) AS kind
          FROM decided WHERE is_candidate),
read AS (SELECT keyed.* EXCLUDE (kind), e.* FROM keyed JOIN {_expected(EXPECTED)}
         ON e.kind = keyed.kind),
repaired AS (
    SELECT *, CASE WHEN raw_type IN ('obligation', 'permission', 'prohibition') THEN raw_type
                   ELSE 'obligation' END AS rule_type,
           CASE WHEN raw_type IN ('obligation', 'permission', 'prohibition') THEN raw_confidence
                ELSE greatest(raw_confidence - 0.1::DOUBLE, 0.4::DOUBLE) END AS base_confidence
    FROM read),
boosted AS (
    SELECT *, least(greatest(base_confidence + confidence_boost, 0::DOUBLE), 1::DOUBLE)
           AS confidence FROM repaired),
banded AS (
    SELECT *, CASE WHEN NOT is_rule THEN 'dropped' WHEN confidence >= 0.6::DOUBLE THEN 'rule'
                   WHEN confidence >= 0.4::DOUBLE THEN 'uncertain' ELSE 'dropped' END AS band
    FROM boosted)
"""
CLASSIFIED_CHAIN = (*DECIDED_CHAIN, CLASSIFIED)
# second answers: 0 and anything not listed confirm with 0.8, 3 keeps the type, 4 sets 'waiver'
SECOND = """
second AS (
    SELECT *, substr(md5(text), 2, 1) AS kind2 FROM banded WHERE band = 'uncertain'),
final_rules AS (
    SELECT source, page, item_pos, sent_pos, text, rule_type, confidence FROM banded
    WHERE band = 'rule'
    UNION ALL
    SELECT source, page, item_pos, sent_pos, text,
           CASE kind2 WHEN '3' THEN rule_type WHEN '4' THEN 'waiver' ELSE 'obligation' END,
           CASE kind2 WHEN '3' THEN 0.9 WHEN '4' THEN 0.66 ELSE 0.8 END
    FROM second WHERE kind2 NOT IN ('1', '2', '5', 'f'))
"""

# --- formulas -------------------------------------------------------------------------------

STOCK = listed(v.STOCK_WORDS)
STOCK_NOUNS = listed(v.STOCK_NOUNS)
PLACEHOLDER = (
    "regexp_matches(formula, '(?i)[OPF]\\(\\s*(Action|Subject|Predicate|Condition|Thing|Entity"
    "|x|y|z|\\?\\w)\\s*[()]')"
    f" OR (readable AND (lower(action) IN {STOCK} OR lower(subject) IN {STOCK}"
    " OR length(action) <= 1))"
)


def _value(name: str) -> str:
    at = f"'$.predicates.{name}'"
    return (
        f"CASE json_type(j, {at}) WHEN 'ARRAY' THEN array_to_string("
        f"CAST(json_extract(j, {at}) AS VARCHAR[]), ' ') WHEN 'OBJECT' THEN coalesce("
        f"json_extract_string(j, '$.predicates.{name}.name'),"
        f" json_extract_string(j, '$.predicates.{name}.a') || ' '"
        f" || json_extract_string(j, '$.predicates.{name}.b'))"
        f" ELSE coalesce(json_extract_string(j, {at}), '') END"
    )


RULES = role("part_rules", m.PART_RULES)
FORMULA_READ = f"""
{role("formula_responses", m.FORMULA_RESPONSES)},
formula_store AS (
    SELECT text, rule_type, attempt, min(response_json) AS response_json
    FROM formula_responses GROUP BY ALL),
opened AS (
    SELECT *, CASE WHEN contains(response_json, '{{')
                   THEN CAST(regexp_extract(response_json, '\\{{.*\\}}') AS JSON) END AS j
    FROM formula_store),
fields AS (
    SELECT text, rule_type, attempt, json_extract_string(j, '$.deontic_type') AS deontic_type,
           json_extract_string(j, '$.deontic_formula') AS formula,
           json_extract_string(j, '$.fol_expansion') AS expansion,
           json_type(j, '$.predicates') IS NOT NULL AS has_object, TRUE AS readable,
           {_value('subject')} AS subject, {_value('action')} AS action,
           {_value('condition')} AS condition
    FROM opened),
read_formulas AS (
    SELECT *, formula IS NOT NULL AND expansion IS NOT NULL AS parsed,
           {PLACEHOLDER} AS placeholder FROM fields)
"""
CHOSEN = """
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY text, rule_type ORDER BY placeholder,
               CASE WHEN placeholder THEN -attempt ELSE attempt END) AS rn,
           min(attempt) OVER (PARTITION BY text, rule_type) AS first_attempt
    FROM read_formulas WHERE parsed AND attempt <= 2),
chosen AS (SELECT * EXCLUDE (rn, first_attempt) FROM ranked WHERE rn = 1 AND first_attempt = 0)
"""

_HEAD = "^(?:" + "|".join(p.removeprefix("^") for p, _ in v.SUBJECT_PATTERNS) + ")"
_CAP = "upper(w[1]) || lower(w[2:])"


def _camel(words: str) -> str:
    return (
        f"{words}[1] || array_to_string(list_transform({words}[2:], lambda w: {_CAP}), '')"
    )


def _pascal(words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda w: {_CAP}), '')"


_PHRASE_WORDS = ", ".join(
    "regexp_extract_all(regexp_replace(trim(regexp_replace(regexp_extract(rest, "
    + text(rf"(?:{head})\s+(.+?){v.ACTION_END}")
    + r", 1), '\s+', ' ', 'g')), '^(?:to\s+|the\s+|a\s+|an\s+)', ''), '\b[a-z]+')"
    + f" AS w{i}"
    for i, head in enumerate(v.MODAL_HEADS)
)
_VERBS = ", ".join(
    f"regexp_extract(rest, {text(rf'\b({verbs})\b')}, 1) AS verb{i}, "
    f"length(regexp_extract(rest, {text(rf'^(.*?)\b(?:{verbs})\b')}, 1)) AS at{i}"
    for i, verbs in enumerate(v.ACTION_VERBS)
)
_WINDOWS = ", ".join(
    f"CASE WHEN verb{i} <> '' THEN regexp_extract_all(substr(rest, greatest(at{i} - 10, 0) + 1,"
    f" at{i} + length(verb{i}) + 20 - greatest(at{i} - 10, 0)), '\\b[a-z]+') ELSE [] END AS win{i}"
    for i in range(3)
)
_VERB_ACTION = "coalesce(" + ", ".join(
    f"CASE WHEN verb{i} <> '' AND len(win{i}) >= 2 THEN "
    + _pascal(
        f"list_concat([verb{i}], win{i}[greatest(list_position(win{i}, verb{i}), 1) + 1"
        f":greatest(list_position(win{i}, verb{i}), 1) + 2])"
    )
    + " END"
    for i in range(3)
) + ")"
_KEPT = f"list_filter(long_words, lambda w: w NOT IN {listed(v.LEADING_STOP_WORDS)})"
TEXT_PREDICATES = f"""
lowered AS (SELECT *, lower(text) AS low FROM part_rules),
rests AS (
    SELECT *, {cases("low", v.SUBJECT_PATTERNS, "regexp_matches", "'person'")} AS text_subject,
           trim(regexp_replace(low, {text(_HEAD)}, '')) AS rest FROM lowered),
worded AS (
    SELECT *, {_PHRASE_WORDS}, {_VERBS},
           regexp_extract_all(rest, '\\b[a-z]{{3,}}') AS long_words FROM rests),
windowed AS (SELECT *, {_WINDOWS} FROM worded),
acted AS (
    SELECT *,
        CASE WHEN len(w0) > 0 THEN {_camel("w0")} WHEN len(w1) > 0 THEN {_camel("w1")}
             WHEN len(w2) > 0 THEN {_camel("w2")} WHEN len(w3) > 0 THEN {_camel("w3")}
             END AS modal_action,
        {_VERB_ACTION} AS verb_action,
        CASE WHEN len(long_words) >= 2 AND len({_KEPT}) > 0
             THEN {_pascal(f"{_KEPT}[1:3]")} END AS leading_action
    FROM windowed),
text_actions AS (
    SELECT *, coalesce(modal_action, verb_action, leading_action, '') AS text_action FROM acted),
bare1 AS (
    SELECT *, regexp_replace(rest, {text(_HEAD)}, '') AS b0,
           lower(regexp_replace(text_action, '([a-z])([A-Z])', '\\1 \\2', 'g')) AS spaced
    FROM text_actions),
bare2 AS (
    SELECT *, regexp_replace(regexp_replace(trim(regexp_replace(
        CASE WHEN text_action = '' THEN b0 ELSE replace(b0, spaced, '') END, '\\s+', ' ', 'g')),
        {text(v.CONDITION_HEAD)}, ''), {text(v.CONDITION_TAIL)}, '') AS b FROM bare1),
text_predicates AS (
    SELECT * EXCLUDE (text_action), CASE WHEN text_action = '' THEN 'action' ELSE text_action END
           AS text_action,
           trim(CASE WHEN length(b) > 50 THEN substr(b, 1, 50) || '...' ELSE b END)
           AS text_condition FROM bare2)
"""
_SYMBOL = (
    "CASE deontic_type WHEN 'permission' THEN 'P' WHEN 'prohibition' THEN 'F' ELSE 'O' END"
)


def _stock(c: str) -> str:
    return f"(lower({c}) IN {STOCK_NOUNS} OR length({c}) <= 1)"


COMPLETED = f"""
joined AS (
    SELECT r.*, c.deontic_type, c.formula, c.expansion, c.attempt, c.has_object, c.placeholder,
           c.subject, c.action, c.condition
    FROM text_predicates r JOIN chosen c ON c.text = r.text AND c.rule_type = r.rule_type),
filled AS (
    SELECT * EXCLUDE (action, subject, condition),
           placeholder AND has_object AS redo,
           CASE WHEN placeholder AND has_object AND {_stock("action")} THEN text_action
                ELSE action END AS action,
           CASE WHEN placeholder AND has_object AND {_stock("subject")} THEN text_subject
                WHEN NOT placeholder AND attempt = 2 AND length(trim(subject)) <= 1
                     AND length(regexp_extract(formula, '[OPF]\\(\\w+\\(([a-zA-Z_]\\w*)', 1)) > 1
                THEN regexp_extract(formula, '[OPF]\\(\\w+\\(([a-zA-Z_]\\w*)', 1)
                ELSE subject END AS subject,
           CASE WHEN placeholder AND has_object AND condition = '' THEN text_condition
                ELSE condition END AS condition
    FROM joined),
completed AS (
    SELECT * EXCLUDE (formula, expansion),
           CASE WHEN redo THEN {_SYMBOL} || '(' || action || '(' || subject || '))'
                ELSE formula END AS deontic_formula,
           CASE WHEN redo THEN '∀x (' || upper(subject[1]) || lower(subject[2:]) || '(x) ∧ '
                || condition || '(x) → ' || {_SYMBOL} || '(' || action || '(x)))'
                ELSE expansion END AS fol_expansion
    FROM filled)
"""
FORMULA_CHAIN = (RULES, FORMULA_READ, CHOSEN, TEXT_PREDICATES, COMPLETED)

# --- entities and graph ---------------------------------------------------------------------

ENTITY_TABLES = ", ".join(role(name, sql) for name, sql in m.ENTITY_TABLES.items())
LATEST = """
latest_fee AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY
        semester DESC NULLS FIRST, record_no DESC) AS rn FROM fee_records) WHERE rn = 1),
latest_housing AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY
        check_in_date DESC NULLS FIRST, tie_order DESC, tie_line DESC, tie_part DESC,
        tie_price DESC) AS rn FROM accommodations) WHERE rn = 1),
profiles AS (
    SELECT s.*, f.payment_status, f.first_installment_paid, f.amount_paid, f.tuition_amount,
           a.* EXCLUDE (student_id, rn, tie_order, tie_line, tie_part, tie_price),
           sc.* EXCLUDE (student_id), ar.* EXCLUDE (student_id)
    FROM students s
    LEFT JOIN latest_fee f ON f.student_id = s.student_id
    LEFT JOIN latest_housing a ON a.student_id = s.student_id
    LEFT JOIN student_conduct sc ON sc.student_id = s.student_id
    LEFT JOIN academic_records ar ON ar.student_id = s.student_id)
"""


def _facts(pairs) -> str:
    return ", ".join(
        f"struct_pack(p := '{p}', flag := {flag})" for flag, names in pairs for p in names
    )


_HOUSED = "building IS NOT NULL"
_FEE = [
    ("payment_status IS NOT DISTINCT FROM 'Paid'", ["payFee"]),
    ("coalesce(first_installment_paid, FALSE)", ["payFirstSemesterFee"]),
    (
        "coalesce(payment_status = 'Paid' AND amount_paid >= tuition_amount, FALSE)",
        ["fullPayment", "paidinadvanceorfully", "feesPaid"],
    ),
]
_HOUSING = [
    (f"{_HOUSED} AND coalesce(confirmed_offer, FALSE)", ["confirmOfferMove"]),
    (f"{_HOUSED} AND coalesce(with_spouse, FALSE)", ["moveWithSpouse"]),
    (
        f"{_HOUSED} AND coalesce(provided_arrival_date, FALSE)",
        ["provideapproximatedateofarrivaloncampus"],
    ),
    (f"NOT ({_HOUSED}) OR coalesce(rent_current, FALSE)", ["payRentForStayOnCampus"]),
    (f"NOT ({_HOUSED}) OR coalesce(vacated_on_time, FALSE)", ["vacatesRoom", "vacateRoom"]),
    (
        f"NOT ({_HOUSED}) OR coalesce(room_clean, FALSE)",
        ["clean", "maintainCleanlinessOfBedroomAndFacilities"],
    ),
    (f"NOT ({_HOUSED}) OR coalesce(unit_hygiene, FALSE)", ["regularcleaningandhygieneoftheunit"]),
    (
        f"NOT ({_HOUSED}) OR coalesce(common_area_clean, FALSE)",
        ["maintainCleanlinessOfCommonAreaAndLandscape"],
    ),
]
_CONDUCT = [
    ("coalesce(brings_concerns_to_attention, TRUE)", ["bringConcernsToAttention"]),
    ("coalesce(ethical_conduct, TRUE)", ["meetHighestStandardsOfPersonalEthicalAndMoralConduct"]),
    (
        "coalesce(peaceful_environment, TRUE)",
        ["maintainPeacefulHealthyLearningEnvironmentForFreeDiscussion"],
    ),
    (
        "coalesce(library_responsible_use, TRUE)",
        ["useAITLibraryAndEducationalResourcesResponsibly"],
    ),
    ("coalesce(it_acceptable_use, TRUE)", ["abideByAcceptableUsePolicyForITResources"]),
]
_PROHIBITED = [
    ("coalesce(cooking_in_dorm, FALSE)", ["cookInUnit", "cookInProhibitedDormitory"]),
    ("coalesce(noisy_in_dorm, FALSE)", ["noisyGroupStudyOrPartyInStudentAccommodation"]),
    ("coalesce(pet_in_dorm, FALSE)", ["petInStudentAccommodation"]),
    (
        "coalesce(disturbing_residents, FALSE)",
        ["disturbFellowStudentsInResidentialAreas", "disturbingpeace"],
    ),
]
_ACADEMIC = [
    ("coalesce(registered_with_registry, TRUE)", ["registry"]),
    ("coalesce(grade_determined_in_courses, TRUE)", ["determineGradeInCourse"]),
    ("coalesce(makeup_classes_scheduled, TRUE)", ["scheduledoutsideregularhoursmakeupclasses"]),
    (
        "coalesce(serves_as_corresponding_author, FALSE)",
        ["serveAsCorrespondingAuthor", "correspondAsAuthorWithJournal"],
    ),
    (
        "coalesce(first_author_in_multi_authored, FALSE)",
        ["multiAuthoredArticleWrittenByStudentShouldBeFirstAuthorUnless"
         "JournalRequiresDifferentOrder"],
    ),
]
FLAG_GROUPS = {
    "fee": _FEE, "housing": _HOUSING, "conduct": _CONDUCT, "prohibition": _PROHIBITED,
    "academic": _ACADEMIC,
}
_FACULTY = [
    ("coalesce(grading_criteria_published, FALSE)", ["makeKnownCriteriaForGrading"]),
    ("coalesce(follows_disciplinary_procedures, FALSE)", ["followProceduresForDisciplinaryActions"]),
    ("coalesce(discloses_conflicts, FALSE)", ["disclose"]),
    (
        "coalesce(reports_cheating_suspects, FALSE)",
        ["suspectCheatingDuringExamOrAssignmentOrResearchProject", "reported"],
    ),
]
_STAFF = [
    ("coalesce(gifts_reported, FALSE)", ["reported"]),
    ("coalesce(settlements_reported, FALSE)", ["settled"]),
    ("coalesce(fees_managed_properly, FALSE)", ["feesPaid", "payFees"]),
    (
        "coalesce(ethical_authority_use, FALSE)",
        ["usesAuthorityEthicallyWithRespectAndSensitivityAndInAccordanceWithInstitutesPolicies",
         "disclose"],
    ),
    ("TRUE", ["expresses_personal_opinion", "undergoDisciplinaryAction"]),
]
_COMMITTEE = [
    ("chair_elected", ["electsChair"]),
    ("handles_grievances", ["receive_grievance", "grievanceProcedureInvolvement",
                            "analyzeGrievance"]),
    ("is_active AND handles_grievances", ["grievanceCommitteePerformsRole"]),
    ("is_active", ["prepared"]),
    ("maintains_confidentiality", ["confidentiality_and_due_regard"]),
    ("records_facts", ["writeDownGrievanceFacts", "recordFacts", "ascertainFactsOfCase",
                       "expressesInWriting", "submitWrittenAgreementsToGrievanceCommittee"]),
    ("convenes_tribunals", ["conveneGrievanceTribunal", "attendHearing"]),
]


def kept_facts(table: str, key: str, pairs) -> str:
    """(id, p, o) of the flags that hold."""
    return (
        f"SELECT id, f.p AS p, 'true' AS o FROM (SELECT {key} AS id,"
        f" unnest([{_facts(pairs)}]) AS f FROM {table}) WHERE f.flag"
    )


def valued_facts(table: str, key: str, pairs) -> str:
    return (
        f"SELECT id, f.p AS p, CAST(f.flag AS VARCHAR) AS o FROM (SELECT {key} AS id,"
        f" unnest([{_facts(pairs)}]) AS f FROM {table})"
    )


_ALL_STUDENT = _FEE + _HOUSING + _CONDUCT + _PROHIBITED + _ACADEMIC
COMMITTEE_ID = "replace(replace(committee_name, ' ', ''), '&', 'And')"
ENTITY_FACTS = f"""
student_facts AS (
    {valued_facts("profiles", "student_id", [
        ("TRUE", ["student"]), ("enrollment_status = 'Active'", ["enrolled"]),
        ("is_new_student", ["newStudent"])])}
    UNION ALL {kept_facts("profiles", "student_id", _ALL_STUDENT)}),
faculty_facts AS ({kept_facts("faculty", "faculty_id", _FACULTY)}),
staff_facts AS ({kept_facts("staff", "staff_id", _STAFF)}),
committee_facts AS ({valued_facts("committees", COMMITTEE_ID, _COMMITTEE)}),
entity_rows AS (
    SELECT student_id AS id,
           CASE WHEN degree_level = 'PhD' THEN 'PostgraduateStudent' ELSE 'Student' END AS class,
           first_name || ' ' || last_name || ' - ' || degree_level || ' Student ('
           || enrollment_status || ')' AS label FROM students
    UNION ALL
    SELECT faculty_id, 'Faculty', title || ' ' || first_name || ' ' || last_name || ' - '
           || position FROM faculty
    UNION ALL
    SELECT staff_id, 'Employee', first_name || ' ' || last_name || ' - ' || role FROM staff
    UNION ALL
    SELECT {COMMITTEE_ID}, 'Committee', committee_name FROM committees),
facts AS (
    SELECT * FROM student_facts UNION ALL SELECT * FROM faculty_facts
    UNION ALL SELECT * FROM staff_facts UNION ALL SELECT * FROM committee_facts),
entity_triples AS (
    SELECT '{m.NS}' || id AS s, '{v.RDF_TYPE}' AS p, '{m.NS}' || class AS o, 'iri' AS o_kind,
           CAST(NULL AS VARCHAR) AS datatype FROM entity_rows
    UNION ALL
    SELECT '{m.NS}' || id, '{v.RDFS_LABEL}', label, 'literal', 'string' FROM entity_rows
    UNION ALL
    SELECT '{m.NS}' || id, '{m.NS}' || p, o, 'literal', 'boolean' FROM facts)
"""
ENTITY_CHAIN = (ENTITY_TABLES, LATEST, ENTITY_FACTS)

# --- validation -----------------------------------------------------------------------------

CONFIG_TABLES = ", ".join(
    role(n, s)
    for n, s in (
        ("shapes", m.SHAPES), ("raw_constraints", m.CONSTRAINTS),
        ("edges", m.SUBCLASS_EDGES), ("domains", m.DOMAINS),
    )
)
CONSTRAINTS = """
constraints AS (
    SELECT shape_id, prop_id, named, min(path) AS path,
           arg_min(CASE WHEN min_count IS NULL THEN NULL
                WHEN regexp_matches(min_count, '^[+-]?[0-9]+$') THEN CAST(min_count AS INTEGER)
                ELSE 0 END, path) AS min_count,
           arg_min(CASE WHEN max_count IS NULL THEN NULL
                WHEN regexp_matches(max_count, '^[+-]?[0-9]+$') THEN CAST(max_count AS INTEGER)
                ELSE 0 END, path) AS max_count,
           min(datatype) AS datatype, min(pattern) AS pattern, min(message) AS message
    FROM raw_constraints GROUP BY shape_id, prop_id, named)
"""
GRAPH = f"""
{role("value_triples", m.VALUE_TRIPLES)},
triples AS (
    SELECT DISTINCT * FROM (SELECT * FROM entity_triples UNION ALL SELECT * FROM value_triples))
"""
CLOSURE = """
closure AS (
    SELECT DISTINCT sub, sup FROM (
        SELECT sub, sup FROM edges
        UNION SELECT a.sub, b.sup FROM edges a JOIN edges b ON a.sup = b.sub
        UNION SELECT a.sub, c.sup FROM edges a JOIN edges b ON a.sup = b.sub
              JOIN edges c ON b.sup = c.sub
        UNION SELECT sub, sub FROM edges UNION SELECT sup, sup FROM edges))
"""
ASSERTED_TYPES = f"""
types AS (SELECT DISTINCT s AS focus, o AS class FROM triples WHERE p = '{v.RDF_TYPE}')
"""
INFERRED_TYPES = f"""
base_types AS (
    SELECT s AS focus, o AS class FROM triples WHERE p = '{v.RDF_TYPE}'
    UNION SELECT s, domain FROM triples JOIN domains ON domains.p = triples.p
          WHERE domain IS NOT NULL
    UNION SELECT o, "range" FROM triples JOIN domains ON domains.p = triples.p
          WHERE "range" IS NOT NULL AND o_kind = 'iri'),
types AS (
    SELECT DISTINCT focus, coalesce(sup, class) AS class
    FROM base_types LEFT JOIN closure ON closure.sub = base_types.class)
"""


def findings(constraint_table: str = "constraints", shape_table: str = "shapes") -> str:
    lexical = (
        "CASE c.datatype WHEN 'decimal' THEN regexp_matches(t.o,"
        " '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)$') WHEN 'date' THEN try_cast(t.o AS DATE)"
        " IS NOT NULL AND regexp_matches(t.o, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') ELSE TRUE END"
    )
    return f"""
focus AS (
    SELECT DISTINCT t.focus, s.shape_id FROM types t
    JOIN {shape_table} s ON s.target_kind = 'class' AND s.target = t.class
    UNION
    SELECT DISTINCT t.s, s.shape_id FROM triples t
    JOIN {shape_table} s ON s.target_kind = 'subjects_of' AND s.target = t.p),
counted AS (
    SELECT f.focus, c.*, (SELECT count(*) FROM triples t WHERE t.s = f.focus AND t.p = c.path) AS n
    FROM focus f JOIN {constraint_table} c ON c.shape_id = f.shape_id),
findings AS (
    SELECT focus, shape_id, prop_id, named, path, message, 'min_count' AS component, '' AS value
    FROM counted WHERE n < min_count
    UNION ALL
    SELECT focus, shape_id, prop_id, named, path, message, 'max_count', '' FROM counted
    WHERE n > max_count
    UNION ALL
    SELECT f.focus, c.shape_id, c.prop_id, c.named, c.path, c.message, 'datatype', t.o
    FROM focus f JOIN {constraint_table} c ON c.shape_id = f.shape_id
    JOIN triples t ON t.s = f.focus AND t.p = c.path
    WHERE c.datatype IS NOT NULL AND (t.o_kind <> 'literal' OR coalesce(t.datatype, '')
          <> c.datatype OR NOT ({lexical}))
    UNION ALL
    SELECT f.focus, c.shape_id, c.prop_id, c.named, c.path, c.message, 'pattern', t.o
    FROM focus f JOIN {constraint_table} c ON c.shape_id = f.shape_id
    JOIN triples t ON t.s = f.focus AND t.p = c.path
    WHERE c.pattern IS NOT NULL AND NOT regexp_matches(t.o, c.pattern)),
results AS (
    SELECT focus AS focus_node, CASE WHEN named THEN prop_id ELSE shape_id END AS source_shape,
           path AS source_path,
           coalesce(message, 'Constraint ' || component || ' not met') AS result_message,
           '{v.NS_SHACL}Violation' AS severity, component, value, shape_id
    FROM findings)
"""


RESULT_CHAIN = (
    *ENTITY_CHAIN, CONFIG_TABLES, CONSTRAINTS, GRAPH, CLOSURE, INFERRED_TYPES, findings()
)
PERSON_INPUT = (
    *ENTITY_CHAIN, CONFIG_TABLES, CONSTRAINTS,
    f"""
{role("value_triples", m.VALUE_TRIPLES)},
triples AS (SELECT DISTINCT * FROM entity_triples),
allowed AS (SELECT * FROM shapes WHERE shape_id IN {listed(
    f"{m.NS}AIT_{n}Shape" for n in v.PERSON_CHECK_RULES)}),
presence AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS pattern)
             FROM constraints)
""",
)
PERSON_CHAIN = (
    *PERSON_INPUT,
    ASSERTED_TYPES,
    findings("presence", "allowed"),
    """
persons AS (
    SELECT student_id AS id, first_name || ' ' || last_name AS name, 'Student' AS type FROM students
    UNION ALL SELECT faculty_id, title || ' ' || first_name || ' ' || last_name, 'Faculty'
    FROM faculty
    UNION ALL SELECT staff_id, first_name || ' ' || last_name, 'Employee' FROM staff)
""",
)
INFERRED_PERSON_CHAIN = (
    *PERSON_INPUT, CLOSURE, INFERRED_TYPES, findings("presence", "allowed")
)
