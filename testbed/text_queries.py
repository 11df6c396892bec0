"""Check queries over text: sources, segmentation, prefilter, classification, response store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from normspark import values as v
from normspark.functions import deontic, jsontext
from normspark.functions import segment as seg
from normspark.functions.columns import computed
from normspark.operators import classify, prefilter, responses, sections, segment
from normspark.operators.keyed import stored, work_dir
from normspark.sources import readers
from oracles import base as o
from testbed import mapping as m
from testbed import tables as t
from testbed.registry import Bed, query

KEY = ["source", "page", "item_pos", "sent_pos"]
KEYS = "source, page, item_pos, sent_pos"


def on_sentences(select: str, *more: str) -> str:
    return o.with_(*o.SENTENCE_CHAIN, *more) + select


# --- sources --------------------------------------------------------------------------------


@query(
    "page_source",
    o.with_(o.PAGES)
    + """SELECT source || '-' || page % 3 || '.txt' AS source, (row_number() OVER (PARTITION BY source, page % 3
         ORDER BY page))::INTEGER AS page, length(raw_text) AS chars, md5(raw_text) AS digest FROM rule_pages""",
)
def _(b: Bed):
    """The pages as text files of several pages, read by the page reader."""
    folder = f"{work_dir(b.spark)}/pages-{uuid.uuid4().hex}"
    name = F.concat("source", F.lit("-"), F.col("page") % 3, F.lit(".txt")).alias("file")
    # Spark names its files itself: one folder per document, whose name stands for the file's
    files = b.pages.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("page", "raw_text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["raw_text"]), "\f").alias("value")
    files.select("file", text).write.partitionBy("file").option("lineSep", "\f").text(folder)
    read = readers.pages(b.spark, f"{folder}/*", F.regexp_extract(F.input_file_name(), "file=([^/]*)/", 1))
    return read.filter("raw_text <> ''").select(
        "source", "page", F.length("raw_text").alias("chars"), F.md5("raw_text").alias("digest")
    )


@query(
    "sentence_json_source",
    """
    SELECT CASE WHEN role = 'system' THEN '' ELSE text END AS text,
           CASE WHEN turn = 0 THEN 0 ELSE CAST(conv_id AS INTEGER) END AS page,
           CASE WHEN role = 'user' THEN '' ELSE role END AS source
    FROM conversations
    """,
)
def _(b: Bed):
    record = F.struct(
        F.when(F.col("role") != "system", F.col("text")).alias("text"),
        F.when(F.col("turn") != 0, F.col("conv_id").cast("int")).alias("page"),
        F.when(F.col("role") != "user", F.col("role")).alias("source"),
    )
    # one file that holds one array
    folder = f"{work_dir(b.spark)}/sentences-{uuid.uuid4().hex}"
    lines = b.given("conversations").select(F.lit(1).alias("n"), F.concat(F.to_json(record), F.lit(",")).alias("value"))
    around = b.spark.createDataFrame([(0, "["), (2, '{"text": "end"}]')], "n INT, value STRING")
    whole = lines.unionByName(around).repartition(1).sortWithinPartitions("n").select("value")
    whole.write.text(folder)
    return readers.sentences_json(b.spark, folder).filter("text <> 'end' OR page <> 0 OR source <> ''")


@query(
    "entity_tables_source",
    o.with_(o.ENTITY_TABLES)
    + " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in m.ENTITY_TABLES
    ),
)
def _(b: Bed):
    from functools import reduce

    from pyspark.sql import DataFrame

    folder = f"{work_dir(b.spark)}/entities-{uuid.uuid4().hex}"
    for name, df in b.entity_tables.items():
        df.write.parquet(f"{folder}/{name}")
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count("*").alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, df in readers.entity_tables(b.spark, folder).items()
        ],
    )


@query(
    "triple_source",
    "WITH " + o.role("value_triples", m.VALUE_TRIPLES)
    + " SELECT p, o_kind, datatype, count(*) AS n FROM (SELECT DISTINCT * FROM value_triples) GROUP BY ALL",
)
def _(b: Bed):
    """Triples written twice and read as a set."""
    folder, triples = f"{work_dir(b.spark)}/triples-{uuid.uuid4().hex}", b.role(m.VALUE_TRIPLES)
    triples.unionByName(triples).write.parquet(folder)
    read = readers.triples(b.spark, folder)
    return read.groupBy("p", "o_kind", "datatype").agg(F.count("*").alias("n"))


@query(
    "shape_source",
    "WITH " + o.CONFIG_TABLES
    + """ SELECT s.shape_id, s.target_kind, s.target, c.path, c.min_count, c.max_count, c.datatype, c.pattern
          FROM shapes s LEFT JOIN raw_constraints c ON c.shape_id = s.shape_id""",
)
def _(b: Bed):
    folder = f"{work_dir(b.spark)}/shapes-{uuid.uuid4().hex}"
    b.shapes.write.parquet(f"{folder}/shapes")
    b.role(m.CONSTRAINTS).write.parquet(f"{folder}/constraints")
    shapes, constraints = readers.shapes(b.spark, folder)
    columns = ["shape_id", "path", "min_count", "max_count", "datatype", "pattern"]
    return shapes.drop("severity").join(constraints.select(*columns), "shape_id", "left")


@query(
    "vocabulary_source",
    """
    SELECT trim(line) AS prop, min(n) AS ord FROM (
        SELECT CASE WHEN p_size > 25 THEN ' ' || split_part(p_name, ' ', 2) || '  '
                    WHEN p_size > 12 THEN substr(p_type, 1, 2) || ' ' ELSE p_type END AS line,
               p_partkey AS n FROM part)
    WHERE length(trim(line)) > 2 GROUP BY 1
    """,
)
def _(b: Bed):
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    line = (
        F.when(F.col("p_size") > 25, F.concat(F.lit(" "), noun, F.lit("  ")))
        .when(F.col("p_size") > 12, F.concat(F.substring("p_type", 1, 2), F.lit(" ")))
        .otherwise(F.col("p_type"))
    )
    lines = b.given("part").select(line.alias("value"), "p_partkey")
    return (
        readers.vocabulary_lines(lines, F.col("p_partkey"))
        .groupBy("prop")
        .agg(F.min("ord").alias("ord"))
    )


# --- segmentation ---------------------------------------------------------------------------


@query(
    "normalised_pages",
    o.with_(o.PAGES, o.NORMALISED)
    + "SELECT source, page, length(text) AS chars, md5(text) AS digest FROM normalised",
)
def _(b: Bed):
    return segment.normalised_pages(b.pages).select(
        "source", "page", F.length("text").alias("chars"), F.md5("text").alias("digest")
    )


@query(
    "list_items",
    o.with_(o.PAGES, o.NORMALISED, o.ITEMS)
    + "SELECT source, page, CAST(item_pos AS INTEGER) AS item_pos, md5(item) AS digest FROM items",
)
def _(b: Bed):
    return segment.items(b.pages).select("source", "page", "item_pos", F.md5("item").alias("digest"))


@query(
    "sentence_parts",
    o.with_(o.PAGES, o.NORMALISED, o.ITEMS, o.PARTS) + f"SELECT {KEYS}, part FROM parts",
)
def _(b: Bed):
    return segment.parts(b.pages)


@query(
    "clean_fragments",
    o.with_(o.PAGES, o.NORMALISED, o.ITEMS, o.PARTS, o.FRAGMENTS)
    + f"SELECT {KEYS}, text FROM fragments",
)
def _(b: Bed):
    return segment.fragments(b.pages)


@query(
    "noise_filter",
    o.with_(o.PAGES, o.NORMALISED, o.ITEMS, o.PARTS, o.FRAGMENTS, o.NOISE)
    + "SELECT source, noise, count(*) AS n, sum(length(text)) AS chars FROM noisy GROUP BY ALL",
)
def _(b: Bed):
    marked = computed(segment.fragments(b.pages), noise=seg.is_noise(F.col("text")))
    return marked.groupBy("source", "noise").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )


@query("sentence_table", on_sentences(f"SELECT {KEYS}, text FROM sentences"))
def _(b: Bed):
    return b.sentences


@query("sentence_total", on_sentences("SELECT count(*) AS total_sentences FROM sentences"))
def _(b: Bed):
    return segment.sentence_total(b.sentences)


NUMBERED = f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY {KEYS}) - 1 AS ordinal
             FROM decided WHERE is_candidate)
"""


@query(
    "rule_ids",
    o.with_(*o.DECIDED_CHAIN, NUMBERED)
    + f"""SELECT {KEYS}, ordinal, 'AIT-' || CASE WHEN length(CAST(ordinal AS VARCHAR)) < 4
          THEN lpad(CAST(ordinal AS VARCHAR), 4, '0') ELSE CAST(ordinal AS VARCHAR) END AS rule_id
          FROM numbered""",
)
def _(b: Bed):
    return segment.numbered(stored(b.candidates().select(*KEY)), b.config).select(
        *KEY, "ordinal", "rule_id"
    )


# --- prefilter ------------------------------------------------------------------------------


def _marker_query(name: str, column: str, found):
    @query(
        name,
        on_sentences(
            f"""SELECT {KEYS}, len({column}) AS n, coalesce(len(array_to_string({column}, '')), 0)
                AS chars, lower(coalesce(substr({column}[1], 1, 9), '')) AS head FROM strengths""",
            o.MARKERS,
        ),
    )
    def _(b: Bed):
        read = computed(b.sentences, found=found(F.col("text")))
        return read.select(
            *KEY,
            F.size("found").alias("n"),
            F.length(F.array_join("found", "")).alias("chars"),
            F.lower(F.coalesce(F.substring(F.get("found", F.lit(0)), 1, 9), F.lit(""))).alias(
                "head"
            ),
        )


_marker_query("strong_markers", "strong", deontic.strong_markers)
_marker_query("consequence_markers", "conseq", deontic.consequence_markers)
_marker_query("weak_markers", "weak", deontic.weak_markers)


@query(
    "deontic_strength",
    on_sentences(
        f"""SELECT {KEYS}, strength AS deontic_strength, CASE strength WHEN 'strong' THEN len(strong)
            WHEN 'consequence' THEN len(conseq) WHEN 'weak' THEN len(weak) ELSE 0 END AS n_markers
            FROM strengths""",
        o.MARKERS,
    ),
)
def _(b: Bed):
    return prefilter.with_strength(b.sentences).select(
        *KEY, "deontic_strength", F.size("deontic_markers").alias("n_markers")
    )


@query("may_sense", on_sentences(f"SELECT {KEYS}, {o.MAY_SENSE} AS sense FROM sentences"))
def _(b: Bed):
    return b.sentences.select(*KEY, deontic.may_sense(F.col("text")).alias("sense"))


@query("speech_act", on_sentences(f"SELECT {KEYS}, {o.SPEECH_ACT} AS act FROM sentences"))
def _(b: Bed):
    return b.sentences.select(*KEY, deontic.speech_act(F.col("text")).alias("act"))


@query(
    "subject_presence",
    on_sentences(
        f"""SELECT {KEYS}, n_words >= 3 AND list_has_any(string_split(lower(text), ' ')[1:5],
            {o.array(v.SUBJECT_WORDS)}) AS has_subject FROM sentences"""
    ),
)
def _(b: Bed):
    return b.sentences.select(*KEY, deontic.has_subject(F.col("text")).alias("has_subject"))


@query(
    "length_gate",
    o.with_(o.PAGES, o.NORMALISED, o.ITEMS, o.PARTS, o.FRAGMENTS, o.NOISE)
    + f"""SELECT {KEYS}, CASE WHEN n_words < 5 THEN 'Too short (' || n_words || ' words < 5)'
          WHEN n_words > 150 THEN 'Too long (' || n_words || ' words > 150), needs splitting'
          ELSE '' END AS reason FROM noisy""",
)
def _(b: Bed):
    from normspark.functions.columns import strip, word_count

    bare = computed(segment.fragments(b.pages), text=strip(F.col("text")))
    counted = computed(bare, n=word_count(F.col("text")))
    return counted.select(
        *KEY, F.coalesce(deontic.length_reason(F.col("n")), F.lit("")).alias("reason")
    )


def _headers_sql() -> str:
    parts = []
    for i, p in enumerate(v.HEADER_PATTERNS):
        whole = o.text(f"(?m)({p})")
        one = o.text(f"(?m){p}")
        parts.append(f"""
            SELECT source, page, {i} AS rank, unnest(list_transform(range(1, len(l)), lambda i:
                struct_pack(pos := CAST(list_sum(list_transform(l[1:i], lambda x: length(x))) AS BIGINT),
                title := regexp_replace(regexp_replace(regexp_extract(l[i + 1], {one}, 1),
                         '^\\s+|\\s+$', '', 'g'), '[:.]+$', '')))) AS h
            FROM (SELECT source, page, string_split(regexp_replace(raw_text, {whole},
                  chr(1) || '\\1', 'g'), chr(1)) AS l FROM rule_pages)""")
    return (
        o.with_(o.PAGES)
        + "SELECT source, page, h.pos AS pos, rank, h.title AS title FROM ("
        + " UNION ALL ".join(parts)
        + ")"
    )


@query("section_headers", _headers_sql())
def _(b: Bed):
    return sections.headers(b.pages).withColumn("pos", F.col("pos").cast("long"))


def _positions_sql() -> str:
    """The cursor goes on by one sentence of every page in each recursive step."""
    return o.with_(
        *o.SENTENCE_CHAIN,
        f"""
        {o.RECURSIVE} numbered AS MATERIALIZED (
            SELECT source, page, text, row_number() OVER (PARTITION BY source, page ORDER BY item_pos, sent_pos) - 1
                AS ord FROM sentences),
        whole_pages AS MATERIALIZED (SELECT source, page, raw_text FROM rule_pages),
        walk AS (
            SELECT source, page, -1::BIGINT AS ord, '' AS text, 0::BIGINT AS cursor, 0::BIGINT AS pos FROM whole_pages
            UNION ALL
            SELECT source, page, ord, text, CASE WHEN hit > 0 THEN cursor + hit - 1 + length(text) ELSE cursor END,
                   CASE WHEN hit > 0 THEN cursor + hit - 1 ELSE cursor END
            FROM (SELECT w.source, w.page, n.ord, n.text, w.cursor, instr(substr(p.raw_text, w.cursor + 1), n.text) AS hit
                  FROM walk w JOIN numbered n ON n.source = w.source AND n.page = w.page AND n.ord = w.ord + 1
                  JOIN whole_pages p ON p.source = w.source AND p.page = w.page)),
        headers AS ({_headers_sql().split(o.PAGES.strip(), 1)[1]}),
        titled AS (
            SELECT w.source, w.page, w.ord, w.text, w.pos, coalesce(arg_max(h.title, h.pos * 100 + h.rank), '') AS title
            FROM walk w LEFT JOIN headers h ON h.source = w.source AND h.page = w.page AND h.pos < w.pos
            WHERE w.ord >= 0 GROUP BY ALL)
        """,
    ) + f"""SELECT source, page, ord, text, pos, title AS section_context,
            {o.section_weight('title')} AS section_weight FROM titled"""


@query("sentence_positions", _positions_sql())
def _(b: Bed):
    """Sentences found in their page by the moving cursor, with the nearest header before them."""
    pages = computed(b.pages, found=seg.page_sentences(F.col("raw_text")))
    listed = pages.select(
        "source", "page", "raw_text", F.transform("found", lambda s: s["text"]).alias("sentences")
    )
    return sections.place_sentences(listed)


@query(
    "section_asof",
    """
    SELECT user_id, event_id AS pos, value AS amount,
           coalesce(last_value(CASE WHEN event_type IN ('signup', 'purchase')
                    THEN event_type || ' ' || props END IGNORE NULLS)
               OVER (PARTITION BY user_id ORDER BY event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS section_context
    FROM events
    """,
)
def _(b: Bed):
    events = b.given("events")
    header = F.concat_ws(" ", "event_type", "props")
    heads = events.filter(F.col("event_type").isin("signup", "purchase")).select(
        "user_id", F.col("event_id").alias("pos"), header.alias("title")
    )
    rows = events.select(
        "user_id", F.col("event_id").alias("pos"), F.col("value").alias("amount")
    )
    return sections.assign_sections(rows, heads, ["user_id"])


TITLE = o.pick(t.TITLES, "page")


@query(
    "section_weights",
    o.with_(o.PAGES)
    + f"SELECT source, page, {TITLE} AS title, {o.section_weight(TITLE)} AS weight FROM rule_pages",
)
def _(b: Bed):
    title = t.section_title(F.col("page"))
    return b.pages.select(
        "source", "page", title.alias("title"), deontic.section_weight(title).alias("weight")
    )


def in_sections(b: Bed):
    placed = b.sentences.withColumn("section_context", t.section_title(F.col("page")))
    return prefilter.decide(sections.with_weight(placed), b.config)


@query(
    "candidate_decision",
    o.with_(*o.SENTENCE_CHAIN, o.MARKERS, o.decided(TITLE))
    + f"""SELECT {KEYS}, rejection_reason, is_candidate, deontic_strength, speech_act,
          section_context, section_weight, round(confidence_boost, 9) AS boost FROM decided""",
)
def _(b: Bed):
    return in_sections(b).select(
        *KEY, "rejection_reason", "is_candidate", "deontic_strength", "speech_act",
        "section_context", "section_weight", F.round("confidence_boost", 9).alias("boost"),
    )


@query(
    "candidates",
    o.with_(*o.DECIDED_CHAIN)
    + f"""SELECT {KEYS}, text, deontic_strength, speech_act, round(confidence_boost, 9) AS boost
          FROM decided WHERE is_candidate""",
)
def _(b: Bed):
    return b.candidates().select(
        *KEY, "text", "deontic_strength", "speech_act", F.round("confidence_boost", 9).alias("boost")
    )


@query(
    "prefilter_statistics",
    o.with_(*o.DECIDED_CHAIN)
    + """
    , totals AS (SELECT count(*) AS n, count(*) FILTER (is_candidate) AS k FROM decided)
    SELECT 'total_sentences' AS stat, '' AS key, CAST(n AS DOUBLE) AS n FROM totals
    UNION ALL SELECT 'candidates', '', k FROM totals
    UNION ALL SELECT 'rejected', '', n - k FROM totals
    UNION ALL SELECT 'filter_rate', '', round((n - k) / n * 100, 1) FROM totals
    UNION ALL SELECT 'deontic_strength', deontic_strength, count(*) FROM decided GROUP BY 2
    UNION ALL SELECT 'speech_act', speech_act, count(*) FROM decided GROUP BY 2
    UNION ALL SELECT 'reason', trim(split_part(rejection_reason, '(', 1)), count(*) FROM decided
              WHERE rejection_reason <> '' GROUP BY 2
    """,
)
def _(b: Bed):
    return prefilter.statistics(b.decided)


# --- classification -------------------------------------------------------------------------


@query(
    "classification_requests",
    o.with_(*o.DECIDED_CHAIN)
    + f"""SELECT {KEYS}, {o.CLASSIFY_KEY} AS cache_key,
          md5('Decide whether the sentence states a binding rule.' || chr(10) || 'Strength: '
          || deontic_strength || chr(10) || 'Speech act: ' || speech_act || chr(10) || 'Section: '
          || section_context || chr(10) || 'Sentence: "' || text || '"' || chr(10)
          || 'Answer with one JSON object: is_rule, rule_type, confidence, reasoning.') AS digest
          FROM decided WHERE is_candidate""",
)
def _(b: Bed):
    return classify.requests(b.candidates(), b.config).select(
        *KEY, "cache_key", F.md5("request").alias("digest")
    )


@query(
    "answered_requests",
    o.with_(*o.DECIDED_CHAIN)
    + f"""SELECT {KEYS}, substr(md5(text), 1, 1) <> 'f' AS answered
          FROM decided WHERE is_candidate""",
)
def _(b: Bed):
    return responses.answered(b.requests, b.store).select(
        *KEY, F.col("response_json").isNotNull().alias("answered")
    )


@query(
    "pending_requests",
    o.with_(*o.DECIDED_CHAIN)
    + f"""SELECT DISTINCT {o.CLASSIFY_KEY} AS cache_key, text FROM decided
          WHERE is_candidate AND substr(md5(text), 1, 1) = 'f'""",
)
def _(b: Bed):
    return responses.pending(b.requests, b.store)


def _object(kind: str) -> str | None:
    text = t.ANSWERS[kind]
    if kind in "67":
        return None
    if kind == "8":
        return text[len("Sure: "): text.index(" Done")]
    return text[text.index('{"is_rule"'):]


_OBJECTS = ", ".join(
    f"('{k}', {'NULL' if _object(k) is None else o.text(_object(k))},"
    f" {o.text({'6': 'parse_error', '7': 'json_decode_error'}.get(k, ''))})"
    for k in t.ANSWERS
)


@query(
    "first_json_object",
    o.with_(*o.SENTENCE_CHAIN)
    + f"""SELECT {KEYS}, e.obj, e.reason FROM sentences JOIN (VALUES {_OBJECTS})
          e(kind, obj, reason) ON e.kind = substr(md5(text), 1, 1)""",
)
def _(b: Bed):
    kind = t.response_kind(F.col("text"))
    raw = b.sentences.withColumn("raw", t._answer(kind, t.ANSWERS)).filter(
        F.col("raw").isNotNull()
    )
    found = jsontext.with_object(raw, "raw", "obj")
    reason = jsontext.missing_reason(F.col("raw"), F.col("obj"))
    return found.select(*KEY, "obj", F.coalesce(reason, F.lit("")).alias("reason"))


@query(
    "greedy_json_object",
    """
    SELECT event_id, CAST(json_extract_string(j, '$.is_rule') AS VARCHAR) AS is_rule,
           json_extract_string(j, '$.rule_type') AS rule_type FROM (
        SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE
               '{"is_rule": true, "rule_type": "' || event_type || '", "k": ' || props || '}' END
               AS j FROM events)
    """,
)
def _(b: Bed):
    raw = F.when(F.col("event_type") == "view", F.lit("no object")).otherwise(
        F.concat(
            F.lit('Answer:\n{"is_rule": true, "rule_type": "'), F.col("event_type"),
            F.lit('", "k": '), F.col("props"), F.lit("}\nend"),
        )
    )
    read = b.given("events").select(
        "event_id", classify.sentence_check(raw).alias("r")
    )
    return read.select("event_id", "r.is_rule", "r.rule_type")


def _classified(columns: str) -> str:
    return o.with_(*o.CLASSIFIED_CHAIN) + f"SELECT {KEYS}, {columns} FROM banded"


@query(
    "label_repair",
    _classified("is_rule, raw_type, rule_type, round(base_confidence, 9) AS base, reasoning"),
)
def _(b: Bed):
    return b.classified.select(
        *KEY, "is_rule", "raw_type", "rule_type", F.round("base_confidence", 9).alias("base"),
        "reasoning",
    )


@query("boosted_confidence", _classified("round(confidence, 9) AS confidence"))
def _(b: Bed):
    return b.classified.select(*KEY, F.round("confidence", 9).alias("confidence"))


@query("confidence_bands", _classified("band"))
def _(b: Bed):
    return b.classified.select(*KEY, "band")


@query(
    "second_opinion",
    o.with_(*o.CLASSIFIED_CHAIN, o.SECOND)
    + f"SELECT {KEYS}, rule_type, round(confidence, 9) AS confidence FROM final_rules",
)
def _(b: Bed):
    # read three times below
    rows = stored(b.classified)
    rules = classify.second_opinion(rows, t.second_store(rows), b.config)
    return rules.select(*KEY, "rule_type", F.round("confidence", 9).alias("confidence"))


@query(
    "rule_list",
    o.with_(o.RULES)
    + """SELECT rule_id, text, (SELECT count(*) FROM part_rules WHERE rule_type = 'prohibition')
         AS total_matching FROM part_rules WHERE rule_type = 'prohibition'
         ORDER BY ordinal LIMIT 50""",
)
def _(b: Bed):
    return classify.rule_list(b.rules, "prohibition").select("rule_id", "text", "total_matching")


# --- response store -------------------------------------------------------------------------


@query(
    "request_key",
    "SELECT event_id, "
    + o.request_key(
        text="event_type || props", model="'default'", prompt_type="'classification'",
        prompt_version="'2'", temperature="'0.0'", deontic_strength="CAST(user_id AS VARCHAR)",
    )
    + " AS cache_key FROM events",
)
def _(b: Bed):
    key = responses.request_key(
        F.concat("event_type", "props"), "default", "classification", "2",
        deontic_strength=F.col("user_id").cast("string"),
    )
    return b.given("events").select("event_id", key.alias("cache_key"))


@query(
    "versioned_key",
    "SELECT prompt_version, count(DISTINCT k) AS keys FROM (SELECT e.*, "
    + o.request_key(
        text="event_type || props", model="'default'", prompt_type="'classification'",
        prompt_version="prompt_version", temperature="'0.0'",
    )
    + " AS k FROM (SELECT *, unnest(['1', '2']) AS prompt_version FROM events) e) GROUP BY 1",
)
def _(b: Bed):
    from functools import reduce

    from pyspark.sql import DataFrame

    text = F.concat("event_type", "props")
    both = [
        b.given("events").select(
            F.lit(version).alias("prompt_version"),
            responses.request_key(text, "default", "classification", version).alias("k"),
        )
        for version in ("1", "2")
    ]
    return (
        reduce(DataFrame.unionByName, both)
        .groupBy("prompt_version")
        .agg(F.countDistinct("k").alias("keys"))
    )


@query("text_hash", "SELECT doc_id, substr(md5(text), 1, 16) AS request_hash FROM documents")
def _(b: Bed):
    return b.given("documents").select(
        "doc_id", responses.text_hash(F.col("text")).alias("request_hash")
    )


STORE = o.role("store", m.STORE)


@query(
    "touch_on_read",
    o.with_(STORE)
    + """, reads AS (SELECT 'key' || CAST(user_id AS VARCHAR) AS cache_key, count(*) AS n
                    FROM events GROUP BY 1)
    SELECT s.cache_key, s.access_count + coalesce(n, 0) AS access_count, n IS NOT NULL AS was_read
    FROM store s LEFT JOIN reads r ON r.cache_key = s.cache_key""",
)
def _(b: Bed):
    hits = b.given("events").select(
        F.concat(F.lit("key"), F.col("user_id").cast("string")).alias("cache_key")
    )
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    return responses.touch(b.role(m.STORE), hits, now).select(
        "cache_key", "access_count", (F.col("last_accessed") == now).alias("was_read")
    )


NEW_ROWS = """
SELECT 'key' || CAST(o_custkey AS STRING) AS cache_key, 'default' AS model, 'order' AS prompt_type,
       o_orderpriority AS response_json, o_orderdate AS created_at, o_orderdate AS last_accessed,
       CAST(1 AS BIGINT) AS access_count
FROM {orders}
"""


@query(
    "store_upsert",
    o.with_(STORE, o.role("new_rows", NEW_ROWS))
    + """SELECT cache_key, model, prompt_type, response_json FROM (
           SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY fresh DESC,
                  created_at DESC, response_json DESC) AS rn
           FROM (SELECT *, 0 AS fresh FROM store UNION ALL SELECT *, 1 FROM new_rows))
         WHERE rn = 1""",
)
def _(b: Bed):
    return responses.upsert(b.role(m.STORE), b.role(NEW_ROWS)).select(
        "cache_key", "model", "prompt_type", "response_json"
    )


@query(
    "store_eviction",
    o.with_(STORE)
    + """SELECT cache_key, access_count FROM (SELECT *, row_number() OVER (ORDER BY last_accessed,
         cache_key) AS rn, count(*) OVER () AS n FROM store) WHERE NOT (n >= 1000 AND rn <= 100)""",
)
def _(b: Bed):
    return responses.evict(b.role(m.STORE)).select("cache_key", "access_count")


@query(
    "store_statistics",
    o.with_(STORE)
    + """SELECT 'total_entries' AS stat, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM store
    UNION ALL SELECT 'total_reads', '', sum(access_count) FROM store
    UNION ALL SELECT 'average_reuse', '', round(sum(access_count) / count(*), 2) FROM store
    UNION ALL SELECT 'by_model', model, count(*) FROM store GROUP BY 2
    UNION ALL SELECT 'by_prompt_type', prompt_type, count(*) FROM store GROUP BY 2""",
)
def _(b: Bed):
    return responses.store_statistics(b.role(m.STORE))
