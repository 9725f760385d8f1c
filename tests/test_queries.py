"""Every query with SQL against DuckDB; the others for rows and schema."""

import pytest

from fidelis.plans import catalogue
from tests.oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_sql(spark, name):
    assert difference(catalogue.queries()[name](spark, SF), catalogue.oracles()[name], SF) == ""


@pytest.mark.parametrize("name", ["mean", "std", "homogeneity", "cluster_analysis", "stationarity", "covariances", "local_clusters", "arima"])
def test_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
