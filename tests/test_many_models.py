"""Models fitted together equal those fitted one by one."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.operators import many_models, models


def plain_fit(x, y, balance=True):
    """Newton's method for one model, in NumPy."""
    n, d = x.shape
    w = np.where(y == 1, n / (2 * (y == 1).sum()), n / (2 * (y == 0).sum())) if balance else np.ones(n)
    a, b = np.c_[x, np.ones(n)], np.zeros(d + 1)
    keep = np.r_[np.ones(d), 0.0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve((a.T * (w * p * (1 - p))) @ a + np.diag(keep), a.T @ (w * (p - y)) + keep * b)
    return b


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3)) * [1.0, 40.0, 0.01] + [0, 300, 1]
    y = (x @ [1.5, 0.05, 60] + rng.normal(size=900) * 2 > 75).astype(int)
    data = [(float(a), float(b), float(c), int(k), i, None if i % 50 == 7 else float(i % 3)) for i, ((a, b, c), k) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "a double, b double, c double, y int, day int, regime double").repartition(4)


def test_all_models_are_as_if_fitted_alone(rows):
    cuts = [100, 250, 400, 899]
    members = {str(c): (F.col("day") <= c, F.col("y")) for c in cuts} | {"none": (F.lit(False), F.col("y")), "one class": (F.col("y") == 1, F.col("y"))}
    got = many_models.fit_many(rows, ["a", "b", "c"], members)
    data = rows.toPandas()
    for k, c in enumerate(cuts):
        part = data[data["day"] <= c]
        want = plain_fit(part[["a", "b", "c"]].to_numpy(), part["y"].to_numpy())
        assert np.allclose(got.weights[k], want[:3], rtol=1e-6, atol=1e-8) and got.intercepts[k] == pytest.approx(want[3], rel=1e-6)
    assert got.fitted.tolist() == [True] * 4 + [False] * 2


def test_a_model_is_that_of_the_library(rows):
    got = many_models.fit_many(rows, ["a", "b", "c"], {"all": (F.lit(True), F.col("y"))})
    weighted = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(models.balanced(rows, "y"))
    one = LogisticRegression(labelCol="y", weightCol="weight", maxIter=500, tol=1e-12, regParam=1 / 900, standardization=False).fit(weighted)
    assert np.allclose(got.weights[0], one.coefficients.toArray(), rtol=1e-3)


def test_probabilities_of_odd_rows(spark, rows):
    members = {"all": (F.lit(True), F.col("y")), "none": (F.lit(False), F.col("y"))}
    fitted = many_models.fit_many(rows, ["a", "b", "c"], members)
    odd = spark.createDataFrame([(1.0, None, 1.0), (0.0, 300.0, 1.0)], "a double, b double, c double")
    got = [r["probabilities"] for r in many_models.probabilities(odd, fitted).orderBy(F.col("b").isNull().desc()).collect()]
    assert got[0] == [None, None] and 0 < got[1][0] < 1 and got[1][1] is None
    assert many_models.probabilities(odd.limit(0), fitted).count() == 0


def test_rolling_refits_never_see_what_comes(spark, rows):
    dated = rows.withColumn("end_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")))
    cuts = ["2020-06-01", "2020-09-01", "2021-03-01"]
    got = many_models.rolling_refits(dated, ["a", "b", "c"], "y", cuts, gap_days=10)
    assert got.where("end_date <= cutoff or age > 12").isEmpty()
    data = dated.toPandas()
    data["end_date"] = data["end_date"].astype("datetime64[ns]")
    part = data[data["end_date"] <= np.datetime64("2020-08-22")]  # ten days before the second cutoff
    want = plain_fit(part[["a", "b", "c"]].to_numpy(), part["y"].to_numpy())
    for r in got.where("cutoff = '2020-09-01'").limit(20).collect():
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(np.dot(want[:3], [r["a"], r["b"], r["c"]]) + want[3]))), abs=1e-6)
    changed = dated.withColumn("y", F.when(F.col("end_date") > "2020-08-25", 1 - F.col("y")).otherwise(F.col("y")))
    again = many_models.rolling_refits(changed, ["a", "b", "c"], "y", cuts, gap_days=10)
    first = lambda df: sorted((r["day"], round(r["score"], 9)) for r in df.where("cutoff <= '2020-09-01'").collect())
    assert first(got) == first(again)


def test_rows_are_gated_by_their_regime(rows):
    got = many_models.gated_scores(rows, ["a", "b", "c"], "y", "regime", 3, F.col("day") < 600).toPandas()
    data = rows.toPandas()
    for k in range(3):
        part = data[(data["day"] < 600) & (data["regime"] == k)]
        want = plain_fit(part[["a", "b", "c"]].to_numpy(), part["y"].to_numpy())
        mine = got[got["regime"] == k]
        z = mine[["a", "b", "c"]].to_numpy() @ want[:3] + want[3]
        assert np.allclose(mine["gated"], 1 / (1 + np.exp(-z)), atol=1e-6)
    none = got[got["regime"].isna()]
    assert len(none) and (none["gated"] == none["pooled"]).all()
