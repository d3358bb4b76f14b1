"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest
from pyspark.sql import functions as F

import brute
from tickloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    r = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    ours = sorted(tuple(str(x[c]) for c in sorted(df.columns)) for x in df.collect())
    cols = [r.columns.index(c) for c in sorted(r.columns)]
    assert ours == sorted(tuple(str(x[i]) for i in cols) for x in r.fetchall())


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op2_token_counts", "op3_quality_rules", "op7_secret_scan", "op9_toxicity", "op10_suffix_dedup"])
def test_a_row_per_document(spark, name):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(x["doc_id"] for x in queries.queries()[name](spark, SF).collect()) == sorted(x["doc_id"] for x in d.select("doc_id").collect())


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]
    seen = {"documents": docs}
    for n, stage in p.STAGES:
        out = stage(spark, docs, SF).cache()
        assert out.count() <= docs.count()
        if n != "mixing":
            assert out.columns == docs.columns
        seen[n] = docs = out
    items = {str(r["item_id"]): (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    hit = {r["doc_id"] for r in seen["near dedup"].collect() if brute.decontamination((r["text"] or "").encode(), items)[2]}
    assert {r["doc_id"] for r in seen["decontamination"].collect()} == {r["doc_id"] for r in seen["near dedup"].collect()} - hit
    assert docs.where("repeats < 1").count() == 0
    a = sorted(map(str, docs.select("doc_id", "repeats", "taken").collect()))
    assert a == sorted(map(str, p.run(spark, SF).select("doc_id", "repeats", "taken").collect()))


def test_pipeline_takes_odd_rows(spark):
    import corpus_pipeline as p

    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "a b " * 3000, "en", None, 1), (3, None, "en", "b", 1)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    odd = odd.withColumn("taken_by", F.lit("x"))
    odd = odd.withColumn("whole", F.lit("y")).withColumn("th", F.lit(1)).withColumn("_lines_gone", F.lit(1))
    kept = []
    for _, stage in p.STAGES:
        odd = stage(spark, odd, SF)
        kept.append(sorted(str((r["doc_id"], len(r["text"] or ""))) for r in odd.collect()))
        assert {"taken_by", "whole", "th", "_lines_gone"} <= set(odd.columns)
    rows = sorted(str(x) for x in [(None, 0), (1, 0), (1, 0), (2, 12000), (3, 0)])
    assert kept[:4] == [rows] * 4 and "(2, 12000)" in kept[4] and set(kept[4]) <= set(rows)
