import pytest

from glossa.plans.oracles import ORACLES
from glossa.plans.queries import QUERIES

from oracle import DATA, same

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == {"semantic_split", "dict_tokens"}  # each cut depends on the one before; whole texts are too long for a recursive query


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8
    assert DATA.endswith("sf0.001")
