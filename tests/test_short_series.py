"""Maximum-likelihood trends of many short series together are those of each alone."""

import datetime

import numpy as np

from geostrain.operators import noise


def test_short_series_together(spark, monkeypatch):
    rng = np.random.default_rng(3)
    day = datetime.date(2001, 1, 1)
    rows = []
    for k in range(60):
        n = int(rng.integers(1, 28)) if k else 140
        at = np.sort(rng.choice(40 if k else 160, n, replace=False))
        y = rng.normal(size=n) + 0.3 * at + rng.normal(size=n).cumsum() * (k % 3)
        rows += [(k, day + datetime.timedelta(int(91 * a)), None if i == 3 and k % 5 == 0 else float(v)) for i, (a, v) in enumerate(zip(at, y, strict=True))]
    df = spark.createDataFrame(rows, "site int, d date, disp double")
    for model in (noise.TrendModel(periods=(), sampling_days=91.0), noise.TrendModel(periods=(1.0,), noise="RWWN", sampling_days=91.0), noise.TrendModel(periods=(), noise="WN", sampling_days=91.0)):
        one = noise.ml_trends(df, ["site"], model).toPandas().sort_values("site").set_index("site")
        two = noise.ml_trends_of_short(df, ["site"], model).toPandas().sort_values("site").set_index("site")
        assert two.error.isna().all() and (one.rate.isna() == two.rate.isna()).all() and len(two) == 60 and two.rate.notna().sum() > 30
        for c in ("rate", "sigma", "loglik"):
            np.testing.assert_allclose(one[c].astype(float), two[c].astype(float), rtol=1e-6, atol=1e-9)
        np.testing.assert_allclose(one.fraction.astype(float), two.fraction.astype(float), atol=2e-5)


def test_pixels_are_solved_together():
    """A thousand pixels took a decomposition and a search each."""
    rng = np.random.default_rng(4)
    days = np.sort(np.stack([rng.choice(28, 18, replace=False) for _ in range(1000)]), axis=1) * 91.3125
    obs = rng.normal(size=days.shape)
    got = noise._many(days, obs, noise.TrendModel(periods=(), sampling_days=91.3125))
    one = noise.ml_trend(days[7], obs[7], noise.TrendModel(periods=(), sampling_days=91.3125))
    assert len(got["rate"]) == 1000 and abs(got["rate"][7] - one["rate"]) < 1e-8 and abs(got["loglik"][7] - one["loglik"]) < 1e-8
