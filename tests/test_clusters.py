import pytest

from vicinal.operators import residuals


def test_too_many_patterns_are_an_error(spark):
    top = spark.createDataFrame([(p,) for p in ("AAAA", "AAAC", "TTTT", "TTTG")], "pattern string")
    assert residuals.clusters(top, 2, most=4).count() == 4
    with pytest.raises(ValueError, match="more than 3"):
        residuals.clusters(top, 2, most=3)
