"""Registry of check queries: a Spark query and, where SQL can say it, the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.config import Config
from normspark.operators import align, classify, entities, formalize, prefilter, segment
from normspark.operators import shapes as shp
from normspark.operators import validate as va
from normspark.operators.keyed import checkpoint, stored
from testbed import mapping as m
from testbed import tables as t

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over a Bed."""

    def add(fn: Callable[[Bed], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Bed(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Bed:
    """The test tables of one scale in their roles; tables several steps read are checkpointed."""

    config = Config()

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def given(self, table: str) -> DataFrame:
        return t.given(self.spark, self.sf_dir, table)

    def role(self, sql: str) -> DataFrame:
        return t.role(self.spark, self.sf_dir, sql)

    # text
    @cached_property
    def pages(self) -> DataFrame:
        return t.rule_pages(self.spark, self.sf_dir)

    @cached_property
    def sentences(self) -> DataFrame:
        return segment.sentences(self.pages)

    @cached_property
    def decided(self) -> DataFrame:
        return prefilter.decide(prefilter.without_sections(self.sentences), self.config)

    def candidates(self, config: Config | None = None) -> DataFrame:
        return prefilter.candidates(self.sentences, config or self.config)

    @cached_property
    def requests(self) -> DataFrame:
        return stored(classify.requests(self.candidates(), self.config).drop("request"))

    @cached_property
    def store(self) -> DataFrame:
        return t.classification_store(self.requests)

    @cached_property
    def classified(self) -> DataFrame:
        return classify.classified(self.requests, self.store)

    # rules and formulas
    @cached_property
    def rules(self) -> DataFrame:
        return t.part_rules(self.spark, self.sf_dir)

    @cached_property
    def vocabulary(self) -> DataFrame:
        return checkpoint(t.vocabulary(self.spark, self.sf_dir))

    @cached_property
    def formula_store(self) -> DataFrame:
        return t.formula_store(self.spark, self.sf_dir)

    @cached_property
    def direct_store(self) -> DataFrame:
        return t.direct_store(self.spark, self.sf_dir)

    @cached_property
    def classes(self) -> DataFrame:
        return t.classes(self.config, self.spark, self.sf_dir)

    @cached_property
    def formalised(self) -> DataFrame:
        return stored(formalize.formalised(self.rules, self.formula_store, self.config))

    @cached_property
    def formulas(self) -> DataFrame:
        return formalize.formulas(self.formalised)

    @cached_property
    def raw_paths(self) -> DataFrame:
        return self.formulas.withColumn(
            "raw_path",
            align.raw_path(F.col("deontic_formula"), F.col("action"), F.col("text")),
        )

    @cached_property
    def paths(self) -> DataFrame:
        """Formulas with class and path."""
        classed = align.with_class(self.raw_paths, self.classes, self.config)
        return stored(align.with_path(classed, self.vocabulary, self.config))

    @cached_property
    def built(self) -> DataFrame:
        return shp.built(self.paths, self.config)

    @cached_property
    def answered(self) -> tuple[DataFrame, DataFrame]:
        """Shapes and constraints of the answers for rules without formula."""
        direct = shp.direct_shapes(formalize.failed(self.formalised), self.direct_store, self.config)
        # read several times by the checks: the blocks are parsed once
        shapes, constraints = (stored(x) for x in shp.response_tables(stored(direct), self.config))
        return shapes, va.single_paths(va.whole_counts(constraints).drop("fixed"))

    # entities and validation
    @cached_property
    def entity_tables(self) -> dict[str, DataFrame]:
        return t.entity_tables(self.spark, self.sf_dir)

    @cached_property
    def entities(self) -> DataFrame:
        return entities.entities(self.entity_tables, ties=m.TIES)

    @cached_property
    def entity_triples(self) -> DataFrame:
        return stored(entities.triples(self.entities, self.config))

    @cached_property
    def triples(self) -> DataFrame:
        return stored(
            entities.triples(self.entities, self.config).unionByName(self.role(m.VALUE_TRIPLES))
        )

    @cached_property
    def shapes(self) -> DataFrame:
        return self.role(m.SHAPES)

    @cached_property
    def constraints(self) -> DataFrame:
        return va.single_paths(va.whole_counts(self.role(m.CONSTRAINTS)).drop("fixed"))

    @cached_property
    def edges(self) -> DataFrame:
        return self.role(m.SUBCLASS_EDGES)

    @cached_property
    def domains(self) -> DataFrame:
        return self.role(m.DOMAINS)

    @cached_property
    def results(self) -> DataFrame:
        return va.results(
            self.triples, self.shapes, self.constraints, self.config, self.edges, self.domains
        )

    @cached_property
    def allowed_shapes(self) -> DataFrame:
        names = self.spark.createDataFrame(
            [(x,) for x in va.person_check_shapes(self.config)], "shape_id STRING"
        )
        return va.curated_subset(self.shapes, names)

    @cached_property
    def presence_results(self) -> DataFrame:
        """Results of the person check: listed shapes, presence only, asserted types only."""
        constraints = va.presence_only(self.constraints).join(
            self.allowed_shapes.select("shape_id"), "shape_id", "left_semi"
        )
        return va.results(self.entity_triples, self.allowed_shapes, constraints, self.config)

    @cached_property
    def persons(self) -> DataFrame:
        return entities.persons(self.entity_tables)
