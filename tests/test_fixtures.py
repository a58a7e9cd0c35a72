import pytest

from checks.fixtures import VIEWS, spark_view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [v for v, text in VIEWS.items() if "{feeds}" in text])
def test_estimated_size_of_a_view_covers_its_rows(spark, name):
    """A view that multiplies its table's rows must not look like a small side of a join."""
    view = spark_view(spark, SF, name)
    estimate = int(str(view._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert estimate >= view.count() * 8 * len(view.columns)
