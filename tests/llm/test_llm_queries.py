import pytest

from glossa.llm.oracles import ORACLES
from glossa.llm.queries import QUERIES

from oracle import DATA, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_pipeline(spark):
    import corpus_pipeline
    from glossa.llm import decontaminate, near_dedup

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    left = docs.where(docs["doc_id"].isin(list(rows)))
    assert left.select("text").distinct().count() == len(rows)
    assert near_dedup.groups(left).where("not kept").count() == 0
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.report(left, bench).where("contaminated").count() == 0
    assert all(r["round_trip"] for r in rows.values())
    assert len(rows) > 0.6 * docs.count()
