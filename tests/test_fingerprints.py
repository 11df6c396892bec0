"""Fingerprints of entities."""

from normspark.operators import validate as va


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()



def test_fingerprints_hold_no_rows_before_they_are_dealt_out(spark):
    """Triples are reduced and dealt by subject and hash before the first aggregate; null and '' stay apart."""
    triples = spark.createDataFrame(
        [("s", "p", "o", "iri", None), ("s", "p", "o", "iri", ""), ("s", "p", "o", "iri", None), ("t", "p", "o", "iri", "")],
        "s STRING, p STRING, o STRING, o_kind STRING, datatype STRING",
    )
    hashes = va.content_hash(triples)
    lines = plan(hashes).splitlines()
    first = max(i for i, x in enumerate(lines) if "HashAggregate" in x)
    assert any("REPARTITION_BY_COL" in x for x in lines[first:])
    assert {r["s"]: r["content"].split(":")[0] for r in hashes.collect()} == {"s": "2", "t": "1"}
