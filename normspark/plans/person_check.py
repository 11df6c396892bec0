"""Compliance of persons in one plan: records to triples to results to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark.config import Config
from normspark.operators import entities as en
from normspark.operators import validate as va
from normspark.operators.keyed import stored


def person_results(
    triples: DataFrame, shapes: DataFrame, constraints: DataFrame, config: Config
) -> DataFrame:
    """Presence checks of the curated shapes on asserted types."""
    own = va.presence_only(constraints).join(shapes.select("shape_id"), "shape_id", "left_semi")
    return va.results(triples, shapes, own, config)


def person_check(
    tables: dict[str, DataFrame],
    shapes: DataFrame,
    constraints: DataFrame,
    config: Config,
    ties: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Every person with the curated rules they break."""
    graph = stored(en.triples(en.entities(tables, ties=ties), config))
    wanted = shapes.filter(F.col("shape_id").isin(va.person_check_shapes(config)))
    found = person_results(graph, wanted, constraints, config)
    return va.person_report(en.persons(tables), found)


def check_by_id(
    tables: dict[str, DataFrame],
    person_id: str,
    shapes: DataFrame,
    constraints: DataFrame,
    config: Config,
    ties: dict[str, list[str]] | None = None,
) -> DataFrame:
    """The report of one person, or no row; only that person's records are read."""
    return person_check(en.only_person(tables, person_id), shapes, constraints, config, ties)


def check_by_name(
    tables: dict[str, DataFrame],
    name: str,
    shapes: DataFrame,
    constraints: DataFrame,
    config: Config,
    ties: dict[str, list[str]] | None = None,
) -> DataFrame:
    """The report of the first person of that name, else of the first whose name contains it."""
    found = en.person_by_name(en.persons(tables), name).select("id", "type").collect()
    report = check_by_id(tables, found[0].id if found else "", shapes, constraints, config, ties)
    return report.filter(F.col("type") == found[0].type) if found else report.limit(0)
