"""The test tables as DataFrames in the roles of the rule model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.config import Config
from normspark.operators import classify, formalize, shapes
from normspark.operators.keyed import spread
from testbed import mapping as m

# Words put in front of the sentences of a document, by doc_id % 14.
PHRASES = (
    "Students must", "Faculty may request", "Employees are required to", "It may be",
    "Residents must not", "Failure to pay will", "Members should", "The committee",
    "Guests may wander", "Tenants are subject to action and", "Applicants may not",
    "Results may occur when", "Researchers may choose to", "Plagiarism is prohibited and",
)
# Header lines, by doc_id % 9; the title is what a header line names.
HEADERS = (
    "2. Requirements", "GENERAL RULES", "Section 3: Conduct", "IV. Procedures",
    "B. Definitions", "5. Unknown Matters", "Article 4. Code of Conduct Overview",
    "1.2 Glossary", "CHAPTER 7: Fees and History",
)
TITLES = (
    "Requirements", "GENERAL RULES", "Conduct", "Procedures", "Definitions", "Unknown Matters",
    "Code of Conduct Overview", "Glossary", "Fees and History",
)


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Keys the big tables are grouped or joined by, for scans with too few splits. A file of parts or customers
# is one split up to 128 MB, and rules, answers and entities made of it would be the work of one task.
SPREAD_BY = {
    "lineitem": "l_orderkey", "orders": "o_custkey", "events": "user_id", "part": "p_partkey",
    "customer": "c_custkey", "supplier": "s_suppkey",
}


def role(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {x: given(spark, sf_dir, x) for x in m.GIVEN if "{" + x + "}" in sql}
    for x, key in SPREAD_BY.items():
        if x in tables:
            tables[x] = spread(tables[x], key)
    return spark.sql(m.for_spark(sql), **tables) if tables else spark.sql(sql)


def entity_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: role(spark, sf_dir, sql) for name, sql in m.ENTITY_TABLES.items()}


def pick(values: tuple, number: Column) -> Column:
    """One of the values by number modulo their count."""
    return F.get(F.array(*[F.lit(x) for x in values]), (number % len(values)).cast("int"))


def rule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of rule text: headers, list items, soft wraps and modal wording."""
    docs = spread(given(spark, sf_dir, "documents"), "doc_id")
    n = F.col("doc_id")
    phrase = pick(PHRASES, n)
    headed = F.regexp_replace(
        F.col("text"),
        F.lit(r"\n([^\n]*)\n"),
        F.concat(F.lit("\n"), pick(HEADERS, n), F.lit("\n$1\n\n(a) ")),
    )
    worded = F.regexp_replace(
        headed, F.lit(r"([.!?]) +([A-Z])"), F.concat(F.lit("$1 "), phrase, F.lit(" $2"))
    )
    wrapped = F.regexp_replace(worded, r", ([a-z])", ",\n$1")
    return docs.select(
        "source",
        n.alias("page"),
        F.concat(
            pick(HEADERS, n + 4), F.lit("\n"), phrase, F.lit(" "), wrapped, F.lit(" 3.")
        ).alias("raw_text"),
    )


def section_title(page: Column) -> Column:
    return pick(TITLES, page)


def response_kind(text: Column) -> Column:
    """Hex digit that selects the kind of stored response."""
    return F.substring(F.md5(text), 1, 1)


# Stored answers by response kind; kind f has none.
ANSWERS = {
    "0": '{"is_rule": true, "rule_type": "obligation", "confidence": 0.9, "reasoning": "duty"}',
    "1": '{"is_rule": true, "rule_type": "permission", "confidence": 0.7, "reasoning": "right"}',
    "2": '{"is_rule": true, "rule_type": "prohibition", "confidence": 0.65, "reasoning": "ban"}',
    "3": '{"is_rule": true, "rule_type": "exemption", "confidence": 0.75, "reasoning": "odd"}',
    "4": '{"is_rule": true, "rule_type": "none", "confidence": 0.45, "reasoning": "unsure"}',
    "5": '{"is_rule": false, "rule_type": "none", "confidence": 0.9, "reasoning": "fact"}',
    "6": "no answer could be given",
    "7": 'broken {"is_rule": true, "rule_type": ',
    "8": 'Sure: {"is_rule": true, "rule_type": "obligation", "confidence": 0.45} Done {x}.',
    "9": '{"is_rule": true, "rule_type": "obligation", "confidence": 0.8, "extra": {"a": 1}}',
    "a": 'As in {x} we get {"is_rule": true, "rule_type": "permission", "confidence": 0.42}',
    "b": '{"is_rule": true, "rule_type": "obligation"}',
    "c": '{"is_rule": true, "rule_type": "prohibition", "confidence": 0.38}',
    "d": '{"is_rule": true, "rule_type": "obligation", "confidence": 0.97, "reasoning": "a } b"}',
    "e": '{"is_rule": true, "rule_type": null, "confidence": 0.62, "reasoning": "empty"}',
}
SECOND_ANSWERS = {
    "0": '{"is_rule": true, "rule_type": "obligation", "confidence": 0.8}',
    "1": '{"is_rule": false, "rule_type": "none", "confidence": 0.8}',
    "2": '{"is_rule": true, "rule_type": "permission", "confidence": 0.5}',
    "3": '{"is_rule": true, "confidence": 0.9}',
    "4": '{"is_rule": true, "rule_type": "waiver", "confidence": 0.66}',
    "5": "no answer could be given",
}


def _answer(kind: Column, answers: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in answers.items() for x in kv])
    return F.try_element_at(table, kind)


def classification_store(requests: DataFrame) -> DataFrame:
    """A stored response per distinct request key; some keys have none."""
    # the key holds the text, so rows of a key have one answer; distinct rows need no sort as min(text) does
    answer = _answer(response_kind(F.col("text")), ANSWERS)
    keys = requests.select("cache_key", answer.alias("response_json"))
    return keys.filter(F.col("response_json").isNotNull()).distinct()


def second_store(rows: DataFrame) -> DataFrame:
    """Second responses, one per distinct text, by the second hex digit of its hash."""
    kind = F.substring(F.md5("text"), 2, 1)
    answers = F.coalesce(
        _answer(kind, SECOND_ANSWERS), F.when(kind != "f", F.lit(SECOND_ANSWERS["0"]))
    )
    keys = rows.select(classify.second_key().alias("cache_key"), answers.alias("response_json"))
    return keys.filter(F.col("response_json").isNotNull()).distinct()


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role(spark, sf_dir, m.PART_RULES)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role(spark, sf_dir, m.VOCABULARY)


def _keyed(df: DataFrame, key: Column) -> DataFrame:
    return (
        df.withColumn("cache_key", key)
        .groupBy("cache_key", "attempt")
        .agg(F.min("response_json").alias("response_json"))
    )


def formula_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(role(spark, sf_dir, m.FORMULA_RESPONSES), formalize.formula_key())


def direct_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(role(spark, sf_dir, m.DIRECT_RESPONSES), shapes.direct_key())


def classes(config: Config, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class names of the test ontology."""
    return (
        role(spark, sf_dir, m.SUBCLASS_EDGES)
        .select(F.explode(F.array("sub", "sup")).alias("c"))
        .select(F.substring_index("c", "#", -1).alias("class"))
        .distinct()
    )
