import math

import pytest
from pyspark.sql import functions as F

from panelwright.functions import stats


@pytest.mark.parametrize("t, df, p", [(12.706204736, 1, 0.05), (2.228138852, 10, 0.05), (2.749995654, 30, 0.01), (1.959963985, 1e7, 0.05), (0.0, 5, 1.0)])
def test_student_tail(t, df, p):
    assert stats.t_two_sided(t, df) == pytest.approx(p, rel=1e-6)


@pytest.mark.parametrize("n, d, p", [(10, 0.40925, 0.05), (20, 0.29408, 0.05), (10, 0.48893, 0.01), (8, 0.45427, 0.05)])
def test_kolmogorov_tables(spark, n, d, p):
    assert ks(spark, d, n) == pytest.approx(p, rel=5e-2)


def ks(spark, d, n):
    df = spark.createDataFrame([(d, n)], "d double, n long")
    return df.select(stats.ks_p_value(F.col("d"), F.col("n"))).first()[0]


def test_kolmogorov_law_has_no_step(spark):
    assert ks(spark, 1.36 / math.sqrt(4000), 4000) == pytest.approx(0.0494, abs=1e-3)
    values = [ks(spark, 0.03, n) for n in (998, 999, 1000, 1001, 1002)]
    assert values == sorted(values, reverse=True) and max(a - b for a, b in zip(values, values[1:])) < 1e-3
    assert ks(spark, 0.0, 50) == 1.0 and ks(spark, 1.0, 50) < 1e-20 and ks(spark, None, 50) is None


def test_normal_distribution(spark):
    df = spark.createDataFrame([(0.0,), (stats.Z90,), (-stats.Z95,), (None,)], "z double")
    got = [r[0] for r in df.select(stats.norm_cdf(F.col("z"))).collect()]
    assert got[:3] == pytest.approx([0.5, 0.9, 0.05]) and got[3] is None
