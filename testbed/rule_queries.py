"""Check queries over rules: formulas, classes, property paths, shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from normspark import values as v
from normspark.functions import formula as fx
from normspark.functions import naming, turtle
from normspark.functions.columns import computed
from normspark.operators import align, formalize, quality
from normspark.operators import shapes as shp
from normspark.sources import sinks
from oracles import base as o
from testbed import mapping as m
from testbed.registry import Bed, query


def on_formulas(select: str, *more: str) -> str:
    return o.with_(*o.FORMULA_CHAIN, *more) + select


# --- formalisation --------------------------------------------------------------------------


@query(
    "formula_parse",
    o.with_(o.FORMULA_READ)
    + f"""SELECT {o.FORMULA_KEY} AS cache_key, attempt, parsed,
          CASE WHEN parsed THEN formula ELSE '' END AS formula FROM read_formulas""",
)
def _(b: Bed):
    return formalize.read_responses(b.formula_store).select(
        "cache_key", "attempt", "parsed",
        F.when(F.col("parsed"), F.col("deontic_formula")).otherwise("").alias("formula"),
    )


@query(
    "placeholder_test",
    o.with_(o.FORMULA_READ)
    + f"""SELECT {o.FORMULA_KEY} AS cache_key, attempt, placeholder FROM read_formulas
          WHERE parsed""",
)
def _(b: Bed):
    return (
        formalize.read_responses(b.formula_store)
        .filter("parsed")
        .select("cache_key", "attempt", "placeholder")
    )


@query(
    "attempt_selection",
    o.with_(o.FORMULA_READ, o.CHOSEN)
    + f"SELECT {o.FORMULA_KEY} AS cache_key, attempt, placeholder, formula FROM chosen",
)
def _(b: Bed):
    best = formalize.chosen_attempt(formalize.read_responses(b.formula_store), 2)
    return best.select(
        "cache_key", "attempt", "placeholder", F.col("deontic_formula").alias("formula")
    )


_BACK = "[OPF]\\(([a-zA-Z_]\\w*)"
_BACK_SUBJECT = "[OPF]\\(\\w+\\(([a-zA-Z_]\\w*)"


@query(
    "formula_backfill",
    o.with_(o.FORMULA_READ)
    + f"""SELECT {o.FORMULA_KEY} AS cache_key, attempt,
        CASE WHEN (length(trim(action)) <= 1 OR lower(trim(action)) IN {o.STOCK})
              AND length(regexp_extract(formula, '{_BACK}', 1)) > 1
              AND lower(regexp_extract(formula, '{_BACK}', 1)) NOT IN {o.STOCK}
             THEN regexp_extract(formula, '{_BACK}', 1) ELSE action END AS action,
        CASE WHEN (length(trim(subject)) <= 1 OR lower(trim(subject)) IN {o.STOCK})
              AND length(regexp_extract(formula, '{_BACK_SUBJECT}', 1)) > 1
             THEN regexp_extract(formula, '{_BACK_SUBJECT}', 1) ELSE subject END AS subject
        FROM read_formulas WHERE parsed""",
)
def _(b: Bed):
    read = formalize.read_responses(b.formula_store).filter("parsed")
    return read.select(
        "cache_key",
        "attempt",
        fx.backfilled(F.col("action"), F.col("deontic_formula"), "action").alias("action"),
        fx.backfilled(F.col("subject"), F.col("deontic_formula"), "subject").alias("subject"),
    )


def _text(name: str, column: str, sql: str):
    @query(
        name,
        o.with_(o.RULES, o.TEXT_PREDICATES) + f"SELECT rule_id, {sql} AS value FROM text_predicates",
    )
    def _(b: Bed):
        return formalize.text_predicates(b.rules).select("rule_id", F.col(column).alias("value"))


_text("text_subject", "_text_subject", "text_subject")
_text("text_action", "_text_action", "text_action")
_text("text_condition", "_text_condition", "text_condition")


def _action(name: str, sql: str, fn):
    @query(
        name,
        o.with_(o.RULES, o.TEXT_PREDICATES)
        + f"SELECT rule_id, coalesce({sql}, '') AS value FROM text_predicates",
    )
    def _(b: Bed):
        rest = computed(b.rules, rest=fx.without_subject(F.lower("text")))
        return rest.select("rule_id", F.coalesce(fn(F.col("rest")), F.lit("")).alias("value"))


_action("modal_action", "modal_action", fx.modal_action)
_action("verb_action", "verb_action", fx.verb_action)
_action("leading_action", "leading_action", fx.leading_action)


@query(
    "composed_formulas",
    on_formulas("SELECT rule_id, deontic_formula, fol_expansion FROM completed"),
)
def _(b: Bed):
    return b.formulas.select("rule_id", "deontic_formula", "fol_expansion")


@query(
    "value_coercion",
    o.with_(o.FORMULA_READ)
    + f"""SELECT {o.FORMULA_KEY} AS cache_key, attempt, subject, action, condition
          FROM read_formulas""",
)
def _(b: Bed):
    return formalize.read_responses(b.formula_store).select(
        "cache_key", "attempt", "subject", "action", "condition"
    )


@query(
    "formula_split",
    on_formulas(
        """SELECT r.rule_id, c.rule_id IS NOT NULL AS parse_success FROM part_rules r
           LEFT JOIN completed c ON c.rule_id = r.rule_id"""
    ),
)
def _(b: Bed):
    return formalize.formulas(b.formalised).select("rule_id", "parse_success").unionByName(
        formalize.failed(b.formalised).select("rule_id", "parse_success")
    )


@query(
    "formula_requests",
    o.with_(o.RULES, o.role("vocabulary", m.VOCABULARY))
    + f"""SELECT rule_id, {o.FORMULA_KEY} AS cache_key,
          md5('Write the rule as a deontic formula O, P or F(predicate(subject)).' || chr(10)
          || 'Type: ' || rule_type || chr(10) || 'Rule: "' || text || '"' || chr(10)
          || 'Prefer predicates from: ' || (SELECT string_agg(prop, ', ' ORDER BY ord)
             FROM vocabulary) || chr(10) || 'Answer with one JSON object: deontic_type,'
          || ' deontic_formula, fol_expansion, predicates, shacl_hint.') AS digest
          FROM part_rules""",
)
def _(b: Bed):
    return formalize.requests(b.rules, b.vocabulary).select(
        "rule_id", "cache_key", F.md5("request").alias("digest")
    )


PLACEHOLDER_AFTER = o.PLACEHOLDER.replace("formula,", "deontic_formula,").replace(
    "readable", "(TRUE)"
)


@query(
    "formula_pairs",
    on_formulas(
        f"""SELECT 'Write the rule as a deontic formula.' || chr(10) || 'Type: ' || rule_type
            || chr(10) || 'Rule: "' || text || '"' AS prompt, deontic_formula
            FROM completed WHERE NOT ({PLACEHOLDER_AFTER})"""
    ),
)
def _(b: Bed):
    return sinks.formula_pairs(b.formulas).select(
        "prompt", F.get_json_object("completion", "$.deontic_formula").alias("deontic_formula")
    )


@query(
    "formula_quality",
    on_formulas(
        f"""SELECT count(*) AS formulas, count(*) FILTER (NOT ({PLACEHOLDER_AFTER})) AS semantic,
            round(avg(CASE WHEN {PLACEHOLDER_AFTER} THEN 0 ELSE 1 END), 9) AS quality
            FROM completed"""
    ),
)
def _(b: Bed):
    return quality.formula_quality(b.formulas).withColumn("quality", F.round("quality", 9))


# --- classes --------------------------------------------------------------------------------

CANDIDATES = f"""
subject_words AS (
    SELECT rule_id, list_transform(list_filter(regexp_extract_all(lower(subject), '[a-z]+'),
               lambda w: w NOT IN {o.listed(v.DETERMINERS)}),
               lambda w: CASE WHEN w[-1:] = 's' AND length(w) > 3 THEN w[1:length(w) - 1]
                              ELSE w END) AS words FROM completed),
subject_names AS (
    SELECT rule_id, list_transform(words, lambda w: upper(w[1]) || lower(w[2:])) AS names
    FROM subject_words),
candidates AS (
    SELECT rule_id, CASE WHEN len(names) = 0 THEN names
        ELSE list_concat([array_to_string(names, '')], names) END AS names FROM subject_names)
"""


@query(
    "subject_candidates",
    on_formulas("SELECT rule_id, array_to_string(names, ',') AS names FROM candidates", CANDIDATES),
)
def _(b: Bed):
    return b.formulas.select(
        "rule_id", F.array_join(naming.subject_candidates(F.col("subject")), ",").alias("names")
    )


CLASSES = f"""
{o.role("edges", m.SUBCLASS_EDGES)},
classes AS (SELECT DISTINCT split_part(c, '#', 2) AS class FROM (
    SELECT sub AS c FROM edges UNION SELECT sup FROM edges)),
matched AS (
    SELECT rule_id, arg_min(c.class, n) AS ontology_class FROM (
        SELECT rule_id, unnest(names) AS name, generate_subscripts(names, 1) AS n FROM candidates) x
    JOIN classes c ON c.class = x.name GROUP BY rule_id)
"""


@query(
    "subject_class",
    on_formulas("SELECT rule_id, ontology_class FROM matched", CANDIDATES, CLASSES),
)
def _(b: Bed):
    return align.subject_class(b.formulas, b.classes)


@query(
    "ontology_classes",
    o.with_(*o.ENTITY_CHAIN, o.role("edges", m.SUBCLASS_EDGES))
    + f"""SELECT DISTINCT split_part(s, '#', -1) AS class FROM (
          SELECT s, p FROM entity_triples UNION ALL SELECT sub, '{v.RDFS_SUBCLASS}' FROM edges)
          WHERE p = '{v.RDFS_SUBCLASS}' OR starts_with(s, '{m.NS}')""",
)
def _(b: Bed):
    tree = b.edges.select(
        F.col("sub").alias("s"),
        F.lit(v.RDFS_SUBCLASS).alias("p"),
        F.col("sup").alias("o"),
        F.lit("iri").alias("o_kind"),
        F.lit(None).cast("string").alias("datatype"),
    )
    return align.ontology_classes(b.entity_triples.unionByName(tree), b.config)


def _pattern_class(name: str, table, column):
    @query(
        name,
        o.with_(o.RULES)
        + f"""SELECT rule_id, {o.cases('lower(text)', table, 'regexp_matches', "''")} AS class
              FROM part_rules""",
    )
    def _(b: Bed):
        return b.rules.select(
            "rule_id", F.coalesce(column(F.lower("text")), F.lit("")).alias("class")
        )


_pattern_class("topic_class", v.TOPIC_CLASSES, align.topic_class)
_pattern_class("word_class", v.WORD_CLASSES, align.word_class)


@query(
    "corpus_class",
    o.with_(o.RULES)
    + f"""SELECT rule_id, {o.cases('lower(text)', v.CORPUS_CLASSES, 'regexp_matches', "'Person'")}
          AS class FROM part_rules""",
)
def _(b: Bed):
    return b.rules.select(
        "rule_id", align.corpus_class(F.lower("text"), b.config).alias("class")
    )


TARGETS = f"""
targets AS (
    SELECT c.*, coalesce(m.ontology_class,
        {o.cases('lower(text)', v.TOPIC_CLASSES + v.WORD_CLASSES + v.CORPUS_CLASSES,
                 'regexp_matches', "'Person'")}) AS target_class
    FROM completed c LEFT JOIN matched m ON m.rule_id = c.rule_id)
"""


@query(
    "target_class",
    on_formulas("SELECT rule_id, target_class FROM targets", CANDIDATES, CLASSES, TARGETS),
)
def _(b: Bed):
    return align.with_class(b.formulas, b.classes, b.config).select("rule_id", "target_class")


# --- property paths -------------------------------------------------------------------------


def _slug(value: str, n: int) -> str:
    words = (
        "list_filter(string_split(trim(regexp_replace(regexp_replace("
        f"{value}, '\\s+', ' ', 'g'), '[^a-zA-Z0-9 ]', '', 'g')), ' '), lambda w: w <> '')[1:{n}]"
    )
    joined = f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || lower(w[2:])), '')"
    return f"CASE WHEN len({words}) = 0 THEN 'policyRule' ELSE lower({joined}[1]) || {joined}[2:] END"


@query("text_slug", f"SELECT doc_id, {_slug('text', 4)} AS slug FROM documents")
def _(b: Bed):
    return b.given("documents").select("doc_id", naming.slug(F.col("text"), 4).alias("slug"))


_PRED = "regexp_extract(deontic_formula, '[OPF]\\(([a-zA-Z_]+)', 1)"
_PARTS = (
    f"list_filter(string_split(regexp_replace({_PRED}, '([A-Z])', ' \\1', 'g'), ' '),"
    " lambda w: w <> '')"
)
RAW_PATHS = f"""
raw_paths AS (
    SELECT *, CASE
        WHEN length({_PRED}) > 1 AND lower({_PRED}) NOT IN {o.STOCK}
        THEN lower({_PARTS}[1][1]) || {_PARTS}[1][2:] || array_to_string(list_transform(
             {_PARTS}[2:], lambda w: upper(w[1]) || lower(w[2:])), '')
        WHEN action <> '' AND lower(action) NOT IN {o.STOCK} THEN {_slug('action', 3)}
        ELSE {_slug('text', 4)} END AS raw_path
    FROM completed)
"""


@query("raw_path", on_formulas("SELECT rule_id, raw_path FROM raw_paths", RAW_PATHS))
def _(b: Bed):
    return b.raw_paths.select("rule_id", "raw_path")


VOCABULARY = f"""
{o.role("vocabulary", m.VOCABULARY)},
folded AS (SELECT lower(prop) AS low, arg_min(prop, ord) AS prop, min(ord) AS ord
           FROM vocabulary GROUP BY 1)
"""
MATCHED_PATHS = """
matched_paths AS (
    SELECT r.*, e.prop AS exact_prop, f.prop AS fold_prop, lower(raw_path) AS path_low
    FROM raw_paths r LEFT JOIN vocabulary e ON e.prop = r.raw_path
    LEFT JOIN folded f ON f.low = lower(r.raw_path))
"""


@query(
    "exact_and_fold_match",
    on_formulas(
        "SELECT rule_id, exact_prop, fold_prop FROM matched_paths",
        RAW_PATHS, VOCABULARY, MATCHED_PATHS,
    ),
)
def _(b: Bed):
    return align.exact_or_fold(b.raw_paths, b.vocabulary).select(
        "rule_id", "exact_prop", "fold_prop"
    )


_BLOCK = """list_max(list_transform(runs, lambda r: struct_pack(
    n := least(r.n, a1 - r.i, b1 - r.j) - greatest(0, a0 - r.i, b0 - r.j),
    i := -(r.i + greatest(0, a0 - r.i, b0 - r.j)), j := -(r.j + greatest(0, a0 - r.i, b0 - r.j)))))"""

#: names under 200 characters, as all are here
FUZZY = f"""
{o.RECURSIVE}
compared AS (
    SELECT f.low AS a, r.low AS b FROM folded f, (SELECT DISTINCT lower(raw_path) AS low FROM raw_paths) r
    WHERE 2.0::DOUBLE * least(length(f.low), length(r.low)) / (length(f.low) + length(r.low)) >= {v.FUZZY_CUTOFF}::DOUBLE),
cells AS (
    SELECT a, b, i, j, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS island
    FROM (SELECT *, unnest(range(length(b))) AS j FROM (SELECT *, unnest(range(length(a))) AS i FROM compared))
    WHERE a[i + 1] = b[j + 1]),
common_runs AS (
    SELECT a, b, list(r) AS runs FROM (
        SELECT a, b, struct_pack(i := min(i), j := min(j), n := count(*)) AS r FROM cells GROUP BY a, b, i - j, island)
    GROUP BY a, b),
spans AS (
    SELECT a, b, runs, 0::BIGINT AS a0, length(a) AS a1, 0::BIGINT AS b0, length(b) AS b1 FROM common_runs
    UNION ALL
    SELECT a, b, runs, s.a0, s.a1, s.b0, s.b1 FROM (
        SELECT a, b, runs, best.n AS n, unnest([
            struct_pack(a0 := a0, a1 := -best.i, b0 := b0, b1 := -best.j),
            struct_pack(a0 := -best.i + best.n, a1 := a1, b0 := -best.j + best.n, b1 := b1)]) AS s
        FROM (SELECT *, {_BLOCK} AS best FROM spans))
    WHERE n > 0 AND s.a0 < s.a1 AND s.b0 < s.b1),
similar_names AS (
    SELECT a, b, 2.0::DOUBLE * sum(greatest(0, {_BLOCK}.n)) / (length(a) + length(b)) AS score
    FROM spans GROUP BY a, b),
fuzzy AS (
    SELECT b AS low, prop AS fuzzy_prop, score FROM (
        SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, a DESC) AS nth
        FROM similar_names WHERE score >= {v.FUZZY_CUTOFF}::DOUBLE)
    JOIN folded ON folded.low = a WHERE nth = 1)
"""


@query("fuzzy_match", on_formulas("SELECT * FROM fuzzy", RAW_PATHS, VOCABULARY, FUZZY))
def _(b: Bed):
    return align.fuzzy(b.raw_paths.select(F.lower("raw_path").alias("low")), b.vocabulary)


@query(
    "edit_distance_match",
    on_formulas(
        """SELECT low, arg_min(prop, struct_pack(d := d, ord := ord)) AS edit_prop,
                  min(d) AS distance
           FROM (SELECT r.low, f.prop, f.ord, levenshtein(r.low, f.low) AS d
                 FROM (SELECT DISTINCT lower(raw_path) AS low FROM raw_paths) r, folded f)
           WHERE d <= 3 GROUP BY low""",
        RAW_PATHS, VOCABULARY,
    ),
)
def _(b: Bed):
    return align.edit_match(b.raw_paths.select(F.lower("raw_path").alias("low")), b.vocabulary)


STOP = o.listed(v.STOP_WORDS + v.CORPUS_STOP_WORDS)
_LONG = "list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))"


@query(
    "keyword_tokens",
    o.with_(o.RULES)
    + f"""SELECT rule_id, array_to_string(list_sort(list_filter({_LONG}, lambda w: w NOT IN {STOP})),
          ',') AS words FROM part_rules""",
)
def _(b: Bed):
    return b.rules.select(
        "rule_id",
        F.array_join(F.array_sort(naming.keywords(F.col("text"), b.config)), ",").alias("words"),
    )


def name_words(name: str) -> str:
    """Keywords of a lower-case name, run-together names cut at domain words."""
    cut = (
        f"list_reduce(list_concat([{name} || '|'], {o.array(sorted(v.DOMAIN_WORDS, key=len, reverse=True))}),"
        " lambda acc, w: CASE WHEN contains(split_part(acc, '|', 1), w) THEN"
        " substr(split_part(acc, '|', 1), 1, instr(split_part(acc, '|', 1), w) - 1) || ' ' ||"
        " substr(split_part(acc, '|', 1), instr(split_part(acc, '|', 1), w) + length(w)) || '|' ||"
        " split_part(acc, '|', 2) || w || ',' ELSE acc END)"
    )
    return f"""
    SELECT name, list_filter(CASE WHEN len(parts) <= 1 AND length(name) > 10 AND len(cut) >= 2
                             THEN cut ELSE parts END, lambda w: w NOT IN {STOP}) AS words
    FROM (SELECT name, list_distinct(regexp_extract_all(replace(name, '_', ' '), '[a-z]{{3,}}'))
                 AS parts,
                 list_distinct(list_concat(
                     list_filter(string_split(split_part(acc, '|', 2), ','), lambda w: w <> ''),
                     list_filter(regexp_extract_all(split_part(acc, '|', 1), '[a-z]{{4,}}'),
                                 lambda w: w NOT IN {STOP}))) AS cut
          FROM (SELECT name, {cut} AS acc FROM ({{names}})))
    """


def _name_words(names: str) -> str:
    return name_words("name").replace("{names}", names)


@query(
    "name_tokens",
    o.with_(o.role("vocabulary", m.VOCABULARY))
    + "SELECT name AS prop, array_to_string(list_sort(words), ',') AS words FROM ("
    + _name_words("SELECT lower(prop) AS name FROM vocabulary GROUP BY 1")
    + ")",
)
def _(b: Bed):
    low = b.vocabulary.select(F.lower("prop").alias("prop")).distinct()
    words = naming.name_keywords(F.col("prop"), b.config)
    return low.select("prop", F.array_join(F.array_sort(words), ",").alias("words"))


@query(
    "domain_word_cut",
    o.with_(o.role("vocabulary", m.VOCABULARY))
    + """SELECT low, len(words) >= 2 AS was_cut FROM (SELECT name AS low, words FROM ("""
    + _name_words("SELECT replace(lower(prop), '_', '') || 'payment' AS name FROM vocabulary GROUP BY 1")
    + "))",
)
def _(b: Bed):
    low = b.vocabulary.select(
        F.concat(F.replace(F.lower("prop"), F.lit("_"), F.lit("")), F.lit("payment")).alias("low")
    ).distinct()
    return low.select(
        "low", (F.size(naming.cut_domain_words(F.col("low"), b.config)) >= 2).alias("was_cut")
    )


KEYWORD = f"""
term_words AS (
    SELECT f.prop, f.ord, unnest(w.words) AS word FROM folded f
    JOIN ({_name_words("SELECT low AS name FROM folded")}) w ON w.name = f.low),
raw_words AS ({_name_words("SELECT DISTINCT lower(raw_path) AS name FROM raw_paths")}),
rule_words AS (
    SELECT r.rule_id, unnest(list_distinct(list_concat(
        list_filter(list_distinct(regexp_extract_all(lower(r.text), '[a-z]{{3,}}')),
                    lambda w: w NOT IN {STOP}), x.words))) AS word
    FROM raw_paths r JOIN raw_words x ON x.name = lower(r.raw_path)),
scored AS (
    SELECT rule_id, prop, ord, sum(length(word)) AS score, count(*) AS n,
           max(length(word)) AS longest
    FROM rule_words JOIN term_words USING (word) GROUP BY ALL)
"""


@query(
    "keyword_match",
    on_formulas(
        """SELECT rule_id, prop AS keyword_prop, score FROM (
           SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, ord) AS rn
           FROM scored WHERE (n >= 2 OR longest >= 6) AND score >= 8) WHERE rn = 1""",
        RAW_PATHS, VOCABULARY, KEYWORD,
    ),
)
def _(b: Bed):
    return align.keyword_match(b.raw_paths, b.vocabulary, b.config)


LADDER = """
by_keyword AS (
    SELECT rule_id, prop AS keyword_prop FROM scored WHERE (n >= 2 OR longest >= 6) AND score >= 8
    QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, ord) = 1),
ladder AS (
    SELECT p.rule_id, raw_path, coalesce(exact_prop, fold_prop, fuzzy_prop, keyword_prop, path_low) AS prop_path,
        CASE WHEN exact_prop IS NOT NULL THEN 'exact' WHEN fold_prop IS NOT NULL THEN 'fold'
             WHEN fuzzy_prop IS NOT NULL THEN 'fuzzy' WHEN keyword_prop IS NOT NULL THEN 'keyword'
             ELSE 'raw' END AS path_method
    FROM matched_paths p LEFT JOIN fuzzy z ON z.low = path_low LEFT JOIN by_keyword k ON k.rule_id = p.rule_id)
"""
LADDER_PARTS = (RAW_PATHS, VOCABULARY, MATCHED_PATHS, FUZZY, KEYWORD, LADDER)


@query("path_ladder", on_formulas("SELECT * FROM ladder", *LADDER_PARTS))
def _(b: Bed):
    """All five steps: exact, case fold, matching blocks, keywords, raw."""
    return align.with_path(b.raw_paths, b.vocabulary, b.config).select(
        "rule_id", "raw_path", "prop_path", "path_method"
    )


# --- shapes ---------------------------------------------------------------------------------

BUILT = f"""
paths AS (
    SELECT t.*, p.prop_path FROM targets t JOIN ladder p ON p.rule_id = t.rule_id),
built AS (
    SELECT *, replace(rule_id, '-', '_') || 'Shape' AS shape_name,
           CASE WHEN target_class = 'Person' THEN 'subjects_of' ELSE 'class' END AS target_kind,
           CASE WHEN target_class = 'Person' THEN prop_path ELSE target_class END AS target_name,
           CASE deontic_type WHEN 'prohibition' THEN NULL WHEN 'permission' THEN 0 ELSE 1 END
                AS min_count,
           CASE deontic_type WHEN 'prohibition' THEN 0 END AS max_count,
           CASE deontic_type WHEN 'permission' THEN 'Info' ELSE 'Violation' END AS severity,
           {o.cases('lower(prop_path)', v.DATATYPES, 'contains')} AS datatype,
           {o.cases('lower(prop_path)', v.VALUE_PATTERNS, 'contains')} AS pattern,
           substr(replace(text, '"', ''''), 1, 200) AS message
    FROM paths)
"""
SHAPE_PARTS = (CANDIDATES, CLASSES, TARGETS, *LADDER_PARTS, BUILT)


def on_shapes(select: str, *more: str) -> str:
    return on_formulas(select, *SHAPE_PARTS, *more)


def _shape(name: str, columns: list[str], sql: str | None = None):
    @query(name, on_shapes(f"SELECT rule_id, {sql or ', '.join(columns)} FROM built"))
    def _(b: Bed):
        return b.built.select("rule_id", *columns)


_shape("shape_cardinality", ["min_count", "max_count"])
_shape("shape_target", ["target_kind", "target_name"])
_shape("shape_names", ["shape_name", "message"])


@query(
    "severity_tiers",
    o.with_(o.RULES)
    + """SELECT rule_id, CASE WHEN rule_type = 'permission' THEN 'Info'
         WHEN confidence >= 0.85::DOUBLE THEN 'Violation' WHEN confidence >= 0.6::DOUBLE
         THEN 'Warning' ELSE 'Info' END AS severity FROM part_rules""",
)
def _(b: Bed):
    return b.rules.select(
        "rule_id", shp.severity(F.col("rule_type"), F.col("confidence")).alias("severity")
    )


_NAME = "lower(p_type) || CASE p_brand WHEN 'Brand#1' THEN 'Fee' WHEN 'Brand#2' THEN 'DueDate'" \
    " WHEN 'Brand#3' THEN 'IdCode' WHEN 'Brand#4' THEN 'Time' WHEN 'Brand#5' THEN 'Email'" \
    " WHEN 'Brand#6' THEN 'year' WHEN 'Brand#7' THEN 'percentage' WHEN 'Brand#8' THEN 'Phone'" \
    " WHEN 'Brand#9' THEN 'ApprovedRule' ELSE split_part(p_name, ' ', 2) END"


@query(
    "datatype_inference",
    f"""SELECT p_partkey, path, {o.cases('lower(path)', v.DATATYPES, 'contains', "''")} AS datatype
        FROM (SELECT p_partkey, {_NAME} AS path FROM part)""",
)
def _(b: Bed):
    named = b.given("part").select("p_partkey", F.expr(_NAME).alias("path"))
    return named.select(
        "p_partkey", "path", F.coalesce(shp.datatype(F.col("path")), F.lit("")).alias("datatype")
    )


@query(
    "pattern_inference",
    f"""SELECT p_partkey, {o.cases('lower(path)', v.VALUE_PATTERNS, 'contains', "''")} AS pattern
        FROM (SELECT p_partkey, {_NAME} AS path FROM part)""",
)
def _(b: Bed):
    named = b.given("part").select("p_partkey", F.expr(_NAME).alias("path"))
    return named.select(
        "p_partkey", F.coalesce(shp.value_pattern(F.col("path")), F.lit("")).alias("pattern")
    )


RENDERED = """
rendered AS (
    SELECT *, '# Rule: ' || rule_id || ' | ' || upper(deontic_type) || chr(10)
        || '# FOL: ' || deontic_formula || chr(10)
        || 'ait:' || shape_name || ' a sh:NodeShape ;' || chr(10)
        || '    ' || CASE target_kind WHEN 'class' THEN 'sh:targetClass' ELSE 'sh:targetSubjectsOf'
           END || ' ait:' || target_name || ' ;' || chr(10)
        || '    sh:severity sh:' || severity || ' ;' || chr(10)
        || '    sh:property ait:' || shape_name || '_prop1 .' || chr(10) || chr(10)
        || 'ait:' || shape_name || '_prop1 a sh:PropertyShape ;' || chr(10)
        || '    sh:path ait:' || prop_path || ' ;' || chr(10)
        || '    ' || CASE WHEN max_count IS NOT NULL THEN 'sh:maxCount ' || max_count
                     ELSE 'sh:minCount ' || min_count END
        || coalesce('; sh:datatype xsd:' || datatype, '')
        || coalesce('; sh:pattern "' || replace(replace(pattern, '\\', '\\\\'), '"', '\\"') || '"',
                    '') || ' ;' || chr(10)
        || '    sh:message "' || message || '" .' || chr(10) AS turtle_text
    FROM built)
"""


@query("shape_turtle", on_shapes("SELECT rule_id, turtle_text FROM rendered", RENDERED))
def _(b: Bed):
    return shp.rendered(b.built, b.config).select("rule_id", "turtle_text")


OVERRIDES = """
last_obligation AS (
    SELECT target_class, prop_path, arg_max(shape_name, ordinal) AS obligation
    FROM built WHERE deontic_type = 'obligation' GROUP BY ALL),
overrides AS (
    SELECT b.shape_name AS permission, l.obligation FROM built b JOIN last_obligation l
      ON l.target_class = b.target_class AND l.prop_path = b.prop_path
    WHERE b.deontic_type = 'permission')
"""


@query("overrides", on_shapes("SELECT permission, obligation FROM overrides", OVERRIDES))
def _(b: Bed):
    return shp.overrides(b.built)


@query(
    "override_triples",
    on_shapes(
        f"""SELECT '{m.NS}' || permission AS s, '{v.NS_DEONTIC}overrides' AS p,
            '{m.NS}' || obligation AS o, 'ait:' || permission || ' deontic:overrides ait:'
            || obligation || ' .' AS line FROM overrides""",
        OVERRIDES,
    ),
)
def _(b: Bed):
    return shp.override_triples(shp.overrides(b.built), b.config).select("s", "p", "o", "line")


# An answer is usable when it is the fenced block; the other kinds are cut off or empty.
DIRECT = f"""
{o.role("direct_responses", m.DIRECT_RESPONSES)},
direct_store AS (
    SELECT text, attempt, min(response_json) AS response_json FROM direct_responses GROUP BY ALL),
answers AS (
    SELECT text, attempt, regexp_replace(regexp_replace(response_json, '^```turtle\\n', ''),
           '\\n```$', '') AS block, starts_with(response_json, '```') AS ok,
           first_value(response_json) OVER (PARTITION BY text ORDER BY attempt) AS first_answer,
           row_number() OVER (PARTITION BY text ORDER BY NOT starts_with(response_json, '```'),
               CASE WHEN starts_with(response_json, '```') THEN attempt ELSE -attempt END) AS rn
    FROM direct_store),
best AS (SELECT * FROM answers WHERE rn = 1 AND first_answer <> '' AND block <> '')
"""


@query(
    "repair_selection",
    o.with_(o.RULES, DIRECT)
    + f"SELECT {o.DIRECT_KEY} AS cache_key, block AS turtle_text, ok AS syntax_valid FROM best",
)
def _(b: Bed):
    return shp.chosen_turtle(b.direct_store, b.config)


FAILED = """
failed AS (SELECT * FROM part_rules r WHERE NOT EXISTS (
    SELECT 1 FROM completed c WHERE c.rule_id = r.rule_id))
"""


@query(
    "direct_shapes",
    on_formulas(
        """SELECT f.rule_id, best.block AS turtle_text, best.ok AS syntax_valid,
           f.rule_type AS deontic_type, 'direct_nl' AS generation_method, 'Unknown' AS target_class
           FROM failed f JOIN best ON best.text = f.text""",
        FAILED, DIRECT,
    ),
)
def _(b: Bed):
    return shp.direct_shapes(formalize.failed(b.formalised), b.direct_store, b.config).drop("text")


@query(
    "fallback_shapes",
    on_shapes(
        f"""SELECT b.rule_id, best.ok AS syntax_valid, 'fol_fallback' AS generation_method,
            {o.cases('lower(b.text)', v.TOPIC_CLASSES + v.WORD_CLASSES + v.CORPUS_CLASSES,
                     'regexp_matches', "'Person'")} AS target_class
            FROM built b JOIN best ON best.text = b.text WHERE b.target_class = 'Person'""",
        DIRECT,
    ),
)
def _(b: Bed):
    """Formulas of class Person stand for the ones that could not be rendered."""
    done = b.built.filter(F.col("target_class") != "Person")
    return shp.fallback_shapes(b.formulas, done, b.direct_store, b.config).select(
        "rule_id", "syntax_valid", "generation_method", "target_class"
    )


@query(
    "well_formed_shapes",
    o.with_(o.role("direct_responses", m.DIRECT_RESPONSES))
    + """SELECT rule_id, attempt, starts_with(response_json, '```') AS ok FROM direct_responses""",
)
def _(b: Bed):
    block = shp.without_fences(F.col("response_json"))
    return b.role(m.DIRECT_RESPONSES).select(
        "rule_id", "attempt", turtle.well_formed(block, b.config).alias("ok")
    )


# one file per document: a header, then a rule block per paragraph; rule numbers repeat
FILES = """
SELECT source || '-' || CAST(doc_id AS STRING) AS source,
       '@prefix ait: <x> .' || chr(10) || '# Rule: AIT-' || CAST(n_chars AS STRING) || chr(10)
       || replace(text, chr(10), chr(10) || '# Rule:  AIT-' || CAST(doc_id AS STRING) || ' | O'
                  || chr(10)) AS ttl_text
FROM {documents}
"""


@query(
    "rule_blocks",
    o.with_(o.role("files", FILES))
    + r"""
    , pieces AS (SELECT source, string_split(regexp_replace(chr(10) || ttl_text,
        '\n(# Rule:\s+AIT-\d+)', chr(1) || '\1', 'g'), chr(1)) AS l FROM files),
    cut AS (SELECT source, unnest(l) AS block, generate_subscripts(l, 1) AS n FROM pieces)
    SELECT source, regexp_extract(block, '^# Rule:\s+(AIT-\d+)', 1) AS rule_id,
           md5(regexp_replace(arg_max(block, n), '^\s+|\s+$', '', 'g')) AS digest
    FROM cut WHERE regexp_matches(block, '^# Rule:\s+AIT-\d+') GROUP BY ALL
    """,
)
def _(b: Bed):
    return shp.rule_blocks(b.role(FILES), b.config).select(
        "source", "rule_id", F.md5("block").alias("digest")
    )


@query(
    "prefix_blocks",
    o.with_(o.role("files", FILES))
    + "SELECT source, split_part(ttl_text, '# Rule:', 1) AS prefix_text FROM files",
)
def _(b: Bed):
    return shp.prefix_blocks(b.role(FILES))
