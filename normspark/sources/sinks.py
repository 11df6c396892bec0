"""Writers of step tables, shape files and reports.

Tables of a run are staged and then committed: the rows go into a folder of their own, and a line in
the manifest beside them names it for the run. Readers follow the manifest, so a run that fails half
way leaves nothing visible, a rerun replaces exactly its own run, and other runs stay as they are.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.operators.shapes import prefix_text


MANIFEST = "run STRING, part STRING, at LONG, rows LONG"


def commit(df: DataFrame, run: str, folder: str, form: str = "parquet") -> int:
    """Write one run's table and commit it; the number of rows is counted in the same pass."""
    part, seen = uuid.uuid4().hex, Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.format(form).save(f"{folder}/parts/{part}")
    line = [(run, part, time.time_ns(), seen.get["n"])]
    manifest = df.sparkSession.createDataFrame(line, MANIFEST).coalesce(1)
    manifest.write.mode("append").json(f"{folder}/manifest")
    return line[0][3]


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The committed part of every run: run, part, at, rows."""
    lines = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
    newest = F.max_by(F.struct("part", "at", "rows"), F.struct("at", "part")).alias("x")
    return lines.groupBy("run").agg(newest).select("run", "x.*")


def committed(spark: SparkSession, folder: str, schema, run: str | None = None, form: str = "parquet") -> DataFrame:
    """What is committed for one run, or for all runs with a column `run`; one path per run."""
    lines = [r for r in manifest(spark, folder).collect() if run in (None, r.run)]
    tables = [
        spark.read.schema(schema).format(form).load(f"{folder}/parts/{r.part}").withColumn("run", F.lit(r.run))
        for r in lines
    ]
    if not tables:
        tables = [spark.createDataFrame([], schema).withColumn("run", F.lit(""))]
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole if run is None else whole.drop("run")


def rules_and_formulas(rules: DataFrame, formulas: DataFrame, run: str, folder: str) -> None:
    commit(rules, run, f"{folder}/classified_rules", "json")
    commit(formulas, run, f"{folder}/fol_formulas", "json")


def shape_lines(
    rendered: DataFrame,
    config: Config,
    answered: DataFrame | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """(source, part, ordinal, value): the prefix header, the blocks in rule order, then blocks
    answered for rules that could not be rendered (answered, as rendered) and the lines of overrides
    (links: source, line)."""
    header = rendered.select("source").distinct().select(
        "source", F.lit(0).alias("part"), F.lit(0).cast("long").alias("ordinal"),
        F.lit(prefix_text(config)).alias("value"),
    )

    def blocks(df: DataFrame, part: int) -> DataFrame:
        return df.select(
            "source", F.lit(part).alias("part"), F.col("ordinal").cast("long"),
            F.col("turtle_text").alias("value"),
        )

    lines = header.unionByName(blocks(rendered, 1))
    if answered is not None:
        lines = lines.unionByName(blocks(answered, 2))
    if links is not None:
        last = links.select(
            "source", F.lit(3).alias("part"), F.lit(0).cast("long").alias("ordinal"),
            F.col("line").alias("value"),
        )
        lines = lines.unionByName(last)
    return lines


def shape_text(
    rendered: DataFrame,
    config: Config,
    folder: str,
    answered: DataFrame | None = None,
    links: DataFrame | None = None,
) -> None:
    """Shape files, one folder per source; its part files in name order give the whole text.

    Rows are range-partitioned by source and order, so a source with very many shapes is written
    by many tasks.
    """
    (
        shape_lines(rendered, config, answered, links)
        .repartitionByRange("source", "part", "ordinal", "value")
        .sortWithinPartitions("source", "part", "ordinal", "value")
        .select("source", "value")
        .write.mode("overwrite")
        .partitionBy("source")
        .text(folder)
    )


def first_results(results: DataFrame, n: int = v.SAVED_RESULTS) -> DataFrame:
    """The results saved beside the counts."""
    return results.orderBy("focus_node", "source_shape", "source_path", "component", "value").limit(n)


def validation(summary: DataFrame, results: DataFrame, folder: str) -> None:
    """Counts and first results as JSON, all results as parquet."""
    summary.write.mode("overwrite").json(f"{folder}/validation_summary")
    first_results(results).write.mode("overwrite").json(f"{folder}/validation_results")
    results.write.mode("overwrite").parquet(f"{folder}/results")


def report(summary: DataFrame, run: str, folder: str) -> None:
    """One document per run."""
    commit(summary.coalesce(1), run, f"{folder}/pipeline_report", "json")


def formula_pairs(formulas: DataFrame) -> DataFrame:
    """Request and answer pairs of formulas that are no placeholders."""
    answer = F.to_json(
        F.struct(
            "deontic_type",
            "deontic_formula",
            "fol_expansion",
            F.struct("subject", "action", "condition").alias("predicates"),
        )
    )
    request = F.concat(
        F.lit("Write the rule as a deontic formula.\nType: "), F.col("rule_type"),
        F.lit('\nRule: "'), F.col("text"), F.lit('"'),
    )
    return formulas.filter(~F.col("placeholder")).select(
        request.alias("prompt"),
        answer.alias("completion"),
        F.struct("text", "rule_type").alias("metadata"),
    )


def append_formula_pairs(formulas: DataFrame, folder: str) -> None:
    formula_pairs(formulas).write.mode("append").json(folder)


# Section titles of the entity text.
SECTIONS = (
    ("students", "Students"), ("faculty", "Faculty"), ("staff", "Staff"),
    ("committees", "Committees"),
)


def entity_lines(blocks: DataFrame, config: Config) -> DataFrame:
    """(rank, entity_id, value): prefixes, then per section its title and its blocks."""
    spark = blocks.sparkSession
    head = spark.range(1).select(
        F.lit(0).alias("rank"), F.lit("").alias("entity_id"),
        F.lit(prefix_text(config)).alias("value"),
    )
    rank, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (section, name) in enumerate(SECTIONS):
        rank = F.when(F.col("section") == section, 2 * i + 1).otherwise(rank)
        title = F.when(F.col("section") == section, f"# --- {name} ---").otherwise(title)
    titles = (
        blocks.select("section")
        .distinct()
        .select(rank.alias("rank"), F.lit("").alias("entity_id"), title.alias("value"))
    )
    rows = blocks.select((rank + 1).alias("rank"), "entity_id", F.col("block").alias("value"))
    return head.unionByName(titles).unionByName(rows)


def entity_text(blocks: DataFrame, config: Config, folder: str) -> None:
    """Entity Turtle; the part files in name order give the whole text."""
    (
        entity_lines(blocks, config)
        .repartitionByRange("rank", "entity_id")
        .sortWithinPartitions("rank", "entity_id")
        .select("value")
        .write.mode("overwrite")
        .text(folder)
    )
