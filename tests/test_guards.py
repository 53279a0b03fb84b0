import pytest

from cinderline.operators.keys import natural_left_join
from cinderline.plans.catalog import load

SF = "/root/testdata/sf0.001"


def test_natural_join_needs_a_shared_column(spark):
    with pytest.raises(ValueError, match="shared"):
        natural_left_join(spark.range(3).toDF("a"), spark.range(4).toDF("b"))


@pytest.mark.parametrize("name", ["q05_share_by_landcover", "q06_share_by_region"])
def test_shares_have_values(spark, name):
    assert load()[0][name](spark, SF).filter("percent_one_day is not null").count() > 0
