"""Readers for the input tables; every schema is given, none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normspark.functions.columns import computed

SENTENCE = "text STRING, page INT, source STRING"
TRIPLE = "s STRING, p STRING, o STRING, o_kind STRING, datatype STRING"
SHAPE = "shape_id STRING, target_kind STRING, target STRING, severity STRING"
CONSTRAINT = (
    "shape_id STRING, prop_id STRING, named BOOLEAN, path STRING, min_count STRING,"
    " max_count STRING, datatype STRING, pattern STRING, message STRING, severity STRING"
)
ENTITY_TABLES = (
    "students", "fee_records", "accommodations", "student_conduct", "academic_records",
    "conduct_records", "faculty", "staff", "committees",
)


def pages(spark: SparkSession, folder: str, name: Column | None = None) -> DataFrame:
    """Extracted page text, one file per document, pages parted by form feeds, counted from 1.

    The source is the file's name, or what `name` makes of its path."""
    if name is None:
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    files = spark.read.text(folder, wholetext=True).select("value", name.alias("source"))
    return files.select(
        "source", F.posexplode(F.split("value", "\f")).alias("page", "raw_text")
    ).withColumn("page", F.col("page") + 1)


def page_rows(df: DataFrame, source: Column, page: Column, text: Column) -> DataFrame:
    """Pages held in a table already."""
    return df.select(
        source.alias("source"), page.alias("page"), F.coalesce(text, F.lit("")).alias("raw_text")
    )


def filled_sentences(records: DataFrame) -> DataFrame:
    """Sentence records with missing fields set: no text, page 0, no source."""
    return records.select(
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce("source", F.lit("")).alias("source"),
    )


#: a string, closed or cut off at the end; what is left of one at the start of a piece
STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|$)'
STRING_REST = r'(?s)^[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|$)'


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(object): the texts of the objects of JSON arrays, however large a file, read in splits.

    Files are cut at closing braces, which Spark does in every split on its own. Whether a brace closes
    an object depends on the strings and braces before it: each piece says how it changes both, for a
    start inside and outside of a string; the totals of the splits, one row each, are added up, then the
    pieces inside each split. A piece that is an object stays where it is; only the pieces of objects with
    inner braces are put together by a shuffle.
    """
    read = spark.read.text(path, lineSep="}").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    value = F.col("value")

    def count(text: Column, char: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))

    def outside(text: Column) -> Column:
        return F.regexp_replace(text, STRING, "")

    quotes = count(F.regexp_replace(value, r"(?s)\\.", ""), '"')
    pieces = computed(
        read.withColumn("id", F.monotonically_increasing_id()),
        odd=quotes % 2,
        plain=count(outside(value), "{"),
        late=count(outside(F.regexp_replace(value, STRING_REST, "")), "{"),
    )

    def running(by: list[str], order: str, last: int):
        return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, last)

    def before(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    # inside a string at the start: by split, then by piece
    quoted = pieces.groupBy("file", "block").agg(F.sum("odd").alias("odds"))
    quoted = quoted.select("file", "block", before("odds", running(["file"], "block", -1)).alias("odd_before"))
    inner = running(["file", "block"], "id", -1)
    rows = pieces.join(quoted, ["file", "block"])
    rows = rows.withColumn("within", (F.col("odd_before") + before("odd", inner)) % 2)
    closes = (F.col("within") + F.col("odd")) % 2 == 0
    opened = F.when(F.col("within") == 1, F.col("late")).otherwise(F.col("plain"))
    rows = rows.withColumn("closes", closes).withColumn("change", opened - F.col("closes").cast("int"))
    # depth after each piece, in the same two steps
    deep = rows.groupBy("file", "block").agg(F.sum("change").alias("changes"))
    deep = deep.select("file", "block", before("changes", running(["file"], "block", -1)).alias("deep_before"))
    upto = running(["file", "block"], "id", 0)
    rows = rows.join(deep, ["file", "block"])
    rows = rows.withColumn("ends", F.col("closes") & (F.col("deep_before") + F.sum("change").over(upto) == 0))
    # a piece after an end begins an object; the number of ends before tells objects apart
    ends = rows.groupBy("file", "block").agg(F.sum(F.col("ends").cast("int")).alias("n"))
    ends = ends.select("file", "block", before("n", running(["file"], "block", -1)).alias("ends_before"))
    rows = rows.join(ends, ["file", "block"]).withColumn("end", F.col("ends").cast("int"))
    rows = rows.withColumn("nth", F.col("ends_before") + before("end", inner))
    whole = F.col("ends") & (F.col("within") == 0) & (opened == 1) & F.col("closes")
    alone = rows.filter(whole).select(value)
    parts = F.array_sort(F.collect_list(F.struct("block", "id", "value")))
    glued = rows.filter(~whole).groupBy("file", "nth").agg(parts.alias("parts"))
    texts = glued.select(F.array_join(F.transform("parts", lambda p: p["value"]), "}").alias("value"))
    made = F.concat(F.regexp_replace("value", r"^[\s,\[]+", ""), F.lit("}"))
    return alone.unionByName(texts).select(made.alias("object")).filter(F.col("object").startswith("{"))


def sentences_json(spark: SparkSession, path: str) -> DataFrame:
    """Sentences stored earlier as a JSON list."""
    return sentence_records(json_objects(spark, path), "object")


def sentence_records(lines: DataFrame, column: str) -> DataFrame:
    """Sentences held as JSON objects in a text column."""
    return filled_sentences(lines.select(F.from_json(column, SENTENCE).alias("r")).select("r.*"))


def entity_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The nine entity tables as parquet folders."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ENTITY_TABLES}


def entity_tables_jdbc(spark: SparkSession, url: str, **options: str) -> dict[str, DataFrame]:
    """The nine entity tables of a database; filters on ids are pushed down to it."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return {name: reader.option("dbtable", name).load() for name in ENTITY_TABLES}


def vocabulary_lines(lines: DataFrame, order: Column) -> DataFrame:
    """Vocabulary out of text lines: trimmed, more than two characters, with its order."""
    return lines.select(F.trim("value").alias("prop"), order.alias("ord")).filter(
        F.length("prop") > 2
    )


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Property list, one name per line, in file order."""
    return vocabulary_lines(spark.read.text(path), F.monotonically_increasing_id())


def triples(spark: SparkSession, path: str) -> DataFrame:
    """A stored graph; a graph is a set, so repeated triples count once."""
    return spark.read.schema(TRIPLE).parquet(path).dropDuplicates()


def shapes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stored shapes and their constraints."""
    return (
        spark.read.schema(SHAPE).parquet(f"{folder}/shapes"),
        spark.read.schema(CONSTRAINT).parquet(f"{folder}/constraints"),
    )
