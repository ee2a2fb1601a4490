"""Exact percentiles by narrowing, against a plain sort, with heavy values, few values and many passes."""

import numpy as np
import pytest

from rangeforge.operators.quantiles import exact_percentiles


@pytest.mark.parametrize(("splitters", "bucket"), [(4, 5), (256, 10_000)])
def test_against_sort(spark, splitters, bucket):
    draw = np.random.default_rng(1)
    groups = {"normal": draw.normal(0, 1, 3000), "heavy": np.concatenate([np.full(2500, 7.0), draw.uniform(0, 10, 500)]), "skewed": np.exp(draw.normal(0, 40, 1000)), "two": np.array([1.0, 4.0]), "one": np.array([3.0]), "same": np.full(900, -2.5), None: draw.integers(0, 5, 400).astype(float)}
    rows = [(k, float(x), 0) for k, xs in groups.items() for x in xs] + [("empty", None, 0), ("normal", None, 0), ("nan", float("nan"), 0)]
    df = spark.createDataFrame(rows, "name string, x double, value long").repartition(4).cache()
    at = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r.name: (r.n, r.q) for r in exact_percentiles(df, ["name"], "x", at, splitters=splitters, bucket=bucket).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert got[k][0] == len(xs)
        np.testing.assert_allclose(got[k][1], np.percentile(xs, [100 * p for p in at]), rtol=1e-12)
    assert exact_percentiles(df.limit(0), ["name"], "x", at).count() == 0
