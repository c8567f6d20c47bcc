"""Window rates, their deviations and reductions against a loop of least-squares solutions."""

import datetime

import numpy as np
import pandas as pd
import pytest

from geostrain.operators import robust, windows

ORIGIN = datetime.date(2000, 1, 1)


def loop_anchors(days, years, offset):
    """As stated: the next start is the first epoch beyond the last one plus the advance."""
    advance = int(365 * (years / 2)) if offset is None else int(365 * offset)
    out, at = [days[0]], days[0]
    while (days > at + advance).any():
        at = days[days > at + advance][0]
        if days.max() - at > int(365 * years):
            out.append(at)
    return out


def loop_fit(t, y, periods, steps):
    """(rate, deviation) by lstsq on the whole design, or None where it isn't determined."""
    if len(t) < 2:
        return None
    inside = [s for s in np.unique(steps) if t.min() < s < t.max()]
    x = (t - t[0]) / 365.25
    cols = [np.ones(len(t)), x]
    for p in periods:
        cols += [np.cos(2 * np.pi * x / p), np.sin(2 * np.pi * x / p)]
    for s in inside:
        h = (t > s).astype(float)
        if not any(np.array_equal(h, c) for c in cols):
            cols.append(h)
    a = np.stack(cols, 1)
    if len(t) <= a.shape[1] or np.linalg.matrix_rank(a, tol=1e-9 * np.linalg.norm(a)) < a.shape[1]:
        return None
    m = np.linalg.lstsq(a, y, rcond=None)[0]
    e2 = float(((y - a @ m) ** 2).sum())
    return m[1], np.sqrt(np.linalg.inv(a.T @ a)[1, 1] * e2 / (len(t) - a.shape[1]))


def loop_rates(days, disp, years, method, offset, periods, steps):
    out = []
    for a in loop_anchors(days, years, offset):
        m = (days > a) & (days < a + int(365 * years))
        if method == "robust":
            found = robust.trend(days[m], disp[m], steps)
            found = None if found["vel"] is None else (found["vel"], found["sigma"])
        else:
            found = loop_fit(days[m], disp[m], periods, steps)
        if found:
            out.append((a, *found))
    return out


def series(rng, n, every, gaps=0.1):
    days = np.arange(n) * every + rng.integers(0, 3, n)
    days = np.unique(days[rng.random(n) > gaps]).astype(float)
    t = days / 365.25
    return days, 0.02 * t + 0.003 * np.sin(2 * np.pi * t) + 0.05 * (t > 3) + rng.normal(0, 0.002, len(t)) + 5.0


@pytest.mark.parametrize("periods,n_steps", [((), 0), ((1.0, 0.5), 0), ((1.0,), 4), ((), 7)])
def test_sliding_fits_equal_a_loop(periods, n_steps):
    rng = np.random.default_rng(n_steps)
    for n, every in ((170, 12), (60, 30), (900, 3)):
        days, disp = series(rng, n, every)
        steps = np.sort(rng.choice(days, n_steps, replace=False) + rng.integers(-1, 2, n_steps)) if n_steps else ()
        for years, offset in ((1.1, None), (2.0, 0.25), (3.0, None), (2.0, 1.0)):
            want = loop_rates(days, disp, years, "ols", offset, periods, steps)
            got = windows.window_rates(days, disp, years, steps, "ols", offset, periods)
            assert [w["anchor"] for w in got] == [w[0] for w in want]
            assert np.allclose([[w["vel"], w["sigma"]] for w in got], [w[1:] for w in want], rtol=1e-6, atol=1e-9)


def test_offset_is_the_advance():
    days = np.arange(0.0, 2000.0, 30)
    got = windows.window_rates(days, days * 0.001, 2.0, method="ols", offset=0.25)
    assert [w["anchor"] for w in got] == [120.0 * i for i in range(11)]
    assert list(windows.anchors(days, 2.0)) == loop_anchors(days, 2.0, None)
    assert all(w["vel"] == pytest.approx(0.36525) and w["sigma"] < 1e-9 for w in got)


def frame(spark, rows, keys):
    pdf = pd.DataFrame([(*k, ORIGIN + datetime.timedelta(days=int(t)), float(x)) for k, days, disp in rows for t, x in zip(days, disp, strict=True)], columns=[*keys, "d", "disp"])
    return spark.createDataFrame(pdf.astype({k: "int64" if k == "site" else "int32" for k in keys})).repartition(4)


@pytest.mark.parametrize("method", ["ols", "robust"])
def test_reductions_equal_a_loop(spark, method):
    rng = np.random.default_rng(3)
    rows = [((y, x), *series(rng, 260, 12 if method == "ols" else 7, 0.05)) for y in range(3) for x in range(2)]
    steps = [400.0, 401.0, 1500.0]
    df = frame(spark, rows, ["y", "x"])
    cuts = spark.createDataFrame([(ORIGIN + datetime.timedelta(days=int(s)),) for s in [*steps, 1500]], "d date")
    periods = (1.0,) if method == "ols" else ()
    for reduce in ("mad", "median", "wrms"):
        got = {(r.y, r.x): r for r in windows.variability(df, 1, 5, reduce, method, offset=0.75, periods=periods, steps=cuts).collect()}
        for key, days, disp in rows:
            found = [w for years in (1.1, 2.0, 3.0, 4.0) for w in loop_rates(days, disp, years, method, 0.75, periods, steps)]
            whole = robust.trend(days, disp, steps)["vel"] if method == "robust" else loop_fit(days, disp, periods, steps)[0]
            off, sigma = np.array([w[1] for w in found]) - whole, np.array([w[2] for w in found], float)
            known = np.isfinite(sigma) & (sigma > 0)
            want = {"mad": np.median(np.abs(off - np.median(off))), "median": np.sqrt(np.median(off**2)), "wrms": np.sqrt((off**2 / sigma**2)[known].sum() / (1 / sigma[known] ** 2).sum())}[reduce]
            assert got[key].vel == pytest.approx(whole) and got[key].n_windows == len(found) and got[key].variability == pytest.approx(want, rel=1e-6)


def test_weights_of_exact_fits():
    off = np.array([1.0, 2.0, 4.0])
    assert windows.reduced(off, np.array([0.0, np.nan, 2.0]), "wrms") == 4.0
    assert windows.reduced(off, np.zeros(3), "wrms") is None


def test_steps_of_each_site_and_large_keys(spark):
    """Neighbouring integers above 2^53 are two series, beside a null key too; steps go to their own site."""
    rng = np.random.default_rng(4)
    sites = [2**53, 2**53 + 1, 7]
    rows = [((s,), *series(rng, 120, 15)) for s in sites]
    df = frame(spark, rows, ["site"])
    df = df.unionByName(df.where("site = 7").selectExpr("cast(null as long) as site", "d", "disp"))
    cuts = spark.createDataFrame([(2**53, ORIGIN + datetime.timedelta(days=700)), (7, ORIGIN + datetime.timedelta(days=900)), (99, ORIGIN)], "site long, d date")
    got = windows.temporal_variability(df, 2.0, method="ols", steps=cuts).collect()
    by_site = {s: [700.0] if s == 2**53 else [900.0] if s == 7 else [] for s in sites}
    for (site,), days, disp in rows:
        want = loop_rates(days, disp, 2.0, "ols", None, (), by_site[site])
        own = sorted((r.anchor, r.vel, r.sigma) for r in got if r.site == site)
        assert np.allclose(own, want, rtol=1e-6)
    days, disp = rows[2][1:]
    assert np.allclose(sorted((r.anchor, r.vel, r.sigma) for r in got if r.site is None), loop_rates(days, disp, 2.0, "ols", None, (), []), rtol=1e-6)


def test_run_over_a_patch(spark):
    rng = np.random.default_rng(5)
    days, disp = series(rng, 200, 12)
    rows = [((0, 0), days, disp * 1000), ((0, 1), days, disp * 0), ((1, 0), days, disp * 0), ((1, 1), days, disp * np.nan), ((2, 2), days[:3], disp[:3])]
    values, metadata = windows.variability_run(frame(spark, rows, ["y", "x"]), {"UNIT": "mm", "REF_DATE": "20000203", "X": "kept"}, (1, 0), ["2000-01-13"], least=2, most=4, reduce="median", method="ols", offset=0.5)
    got = {(r.y, r.x): (r.fitted, r.dv) for r in values.collect()}
    keep = days != 12
    found = [w[1] for years in (2.0, 3.0) for w in loop_rates(days[keep], disp[keep], years, "ols", 0.5, (), [])]
    want = np.sqrt(np.median((np.array(found) - loop_fit(days[keep], disp[keep], (), [])[0]) ** 2))
    assert got[0, 0] == (True, pytest.approx(want, rel=1e-6)) and got[0, 1] == got[1, 1] == (False, 0.0)
    assert got[1, 0] == (True, pytest.approx(0.0, abs=1e-12)) and got[2, 2] == (True, 0.0)
    meta = {r.key: r.value for r in metadata.collect()}
    assert meta["UNIT"] == "m/year" and meta["FILE_TYPE"] == "velocity" and meta["X"] == "kept" and meta["REF_DATE"] == "20000203"
    assert meta["window_offset"] == "0.5" and meta["max_window"] == "4" and meta["REF_Y"] == "1" and meta["excludeDate"] == "2000-01-13"
    assert meta["DATE12"] == f"{meta['START_DATE']}_{meta['END_DATE']}"


def test_no_windows(spark):
    empty = spark.createDataFrame([], "site long, d date, disp double")
    assert windows.temporal_variability(empty, 2.0, method="ols").count() == 0
    assert windows.rate_deviation(empty, steps=empty.select("site", "d")).count() == 0
    assert not windows.window_rates([], [], 2.0, method="ols") and not windows.window_rates([5.0], [1.0], 2.0, method="ols")


def test_windows_of_all_sizes_are_solved_together(monkeypatch):
    """Each size was solved alone, and the whole series again: most of a pixel's time."""
    rng = np.random.default_rng(11)
    t = np.sort(rng.choice(2600, 40, replace=False)).astype(float)
    x = rng.gamma(2.0, 1.0, 40)
    calls, solve = [], windows.SlidingFits.solve
    monkeypatch.setattr(windows.SlidingFits, "solve", lambda self, *a: calls.append(1) or solve(self, *a))
    whole, rate, sigma = windows.all_rates(t, x, [2.0, 3.0, 4.0], method="ols")
    assert len(calls) == 1
    alone = [w for s in (2.0, 3.0, 4.0) for w in windows.window_rates(t, x, s, method="ols")]
    assert np.allclose(rate, [w["vel"] for w in alone], rtol=0, atol=1e-12) and np.allclose(sigma, [w["sigma"] for w in alone])
    assert abs(whole - np.polyfit(t / 365.25, x, 1)[0]) < 1e-9


def test_rates_alone_equal_whole_trends():
    rng = np.random.default_rng(12)
    for n, cuts in ((0, ()), (1, ()), (2, ()), (30, ()), (60, (900.0, 1500.0)), (61, (1200.0,))):
        t = np.sort(rng.choice(2600, n, replace=False)).astype(float)
        x = np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n))
        found = robust.trend(t, x, cuts)
        assert robust.rate_of(t, x, cuts) == (found["vel"], found["sigma"])


@pytest.mark.parametrize("method,n_steps", [("ols", 0), ("ols", 5), ("robust", 0), ("robust", 3)])
def test_many_series_at_once_equal_one_after_another(method, n_steps):
    """Series of very different lengths, one of a single epoch, some beginning before 2000; a few solves, not one each."""
    rng = np.random.default_rng(11)
    rows = [(np.sort(rng.choice(4000, n, replace=False)) - 1500.0) for n in (1, 2, 30, 400, 31, 33, 900, 28)] + [np.arange(0.0, 2600, 91) + i % 3 for i in range(20)]
    rows = [(t, rng.normal(0, 1, len(t)) + t / 400) for t in rows]
    own = [np.unique(rng.choice(t, min(len(t), n_steps))) for t, _ in rows]
    steps = np.full((len(rows), n_steps), np.inf)
    for i, s in enumerate(own):
        steps[i, : len(s)] = s
    periods = (1.0,) if method == "ols" else ()
    many = windows.ManySeries(*(np.concatenate([r[i] for r in rows]) for i in (0, 1)), np.r_[0, np.cumsum([len(t) for t, _ in rows])], steps)
    for years, offset in ((2.0, 0.25), (3.0, None)):
        k, start, first, last = many.windows(years, offset, np.arange(len(rows)))
        rate, sigma = many.rates(k, first, last, method, periods)
        for i, (t, x) in enumerate(rows):
            want = windows.window_rates(t, x, years, own[i], method, offset, periods)
            mine = (k == i) & np.isfinite(rate)
            assert start[k == i].tolist() == windows.anchors(t, years, offset).tolist()
            assert [w["anchor"] for w in want] == start[mine].tolist()
            got = np.stack([rate[mine], sigma[mine]], 1)
            assert np.allclose(got, np.array([[w["vel"], w["sigma"]] for w in want], float).reshape(-1, 2), rtol=1e-7, atol=1e-9, equal_nan=True)


def test_reductions_of_groups():
    rng = np.random.default_rng(12)
    k, off, sigma = rng.integers(0, 5, 60), rng.normal(size=60), np.where(rng.random(60) < 0.2, 0.0, rng.random(60))
    sigma[k == 2] = np.nan
    for reduce in ("mad", "median", "wrms"):
        want = [windows.reduced(off[k == i], sigma[k == i], reduce) for i in range(5)]
        assert np.allclose(windows.reduced_by(k, off, sigma, 5, reduce), np.array(want, float), equal_nan=True)
