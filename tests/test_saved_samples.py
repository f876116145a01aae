"""Samples that are read several times are made once."""

from glossa.operators import metrics
from glossa.plans import encoded
from glossa.plans.queries import QUERIES

from oracle import DATA


def test_encoded_retrieval_hands_over_saved_rows(spark, monkeypatch):
    plans, made = [], metrics.paired_retrieval
    monkeypatch.setattr(encoded.metrics, "paired_retrieval", lambda df, k: plans.append(df._jdf.queryExecution().logical().toString()) or made(df, k))
    QUERIES["encoded_retrieval"](spark, DATA)
    assert len(plans) == 1 and "ExistingRDD" in plans[0].replace("LogicalRDD", "ExistingRDD") and "Join" not in plans[0]
