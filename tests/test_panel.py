"""The panel operators beside pandas, on a panel with gaps, missing values and missing keys."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from perilens.operators import compliance, panel


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(30):
        for year in range(109, 114):
            if rng.random() < 0.15:
                continue
            value = None if rng.random() < 0.1 else float(rng.choice([0, 100, 100, 120, 150, -20]))
            out.append((i, None if i % 7 == 0 else f"c{i % 3}", year, value, None if rng.random() < 0.1 else float(rng.randint(0, 90))))
    return out


@pytest.fixture(scope="module")
def frames(spark, rows):
    schema = "id long, county string, year int, x double, students double"
    return spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=["id", "county", "year", "x", "students"]).sort_values(["id", "year"])


def same(df, column, want):
    got = {(r.id, r.year): r[column] for r in df.collect()}
    assert len(got) == len(want)
    for key, w in want.items():
        g = got[key]
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert g is None, key
        else:
            assert g == pytest.approx(w, rel=1e-9, abs=1e-9), key


def by_key(p, values):
    return {(int(i), int(y)): (None if pd.isna(v) else float(v)) for i, y, v in zip(p.id, p.year, values)}


def test_row_growth_and_runs(frames):
    df, p = frames
    prev = p.groupby("id").x.shift(1)
    growth = (p.x - prev) / prev.abs().replace(0, np.nan)
    same(panel.row_growth(df, ["x"], ["id"], "year"), "x_growth", by_key(p, growth))

    def run(s):
        with np.errstate(all="ignore"):
            grew = s.pct_change(fill_method=None) > 0
        return grew.groupby((~grew).cumsum()).cumsum()

    same(panel.growth_run(df, ["x"], ["id"], "year"), "x_run", by_key(p, p.groupby("id").x.transform(run)))


def test_volatility_and_self_z(frames):
    df, p = frames
    vol = p.groupby("id").x.transform(lambda s: s.std() / abs(s.mean()) if s.notna().sum() >= 2 and s.mean() else np.nan)
    same(panel.volatility(df, ["x"], ["id"]), "x_volatility", by_key(p, vol))

    def z(s):
        past = s.shift(1).expanding(min_periods=2)
        sd = past.std()
        return (s - past.mean()) / sd.where(sd > 1e-9)

    same(df.withColumn("z", panel.self_z("x", ["id"], "year")), "z", by_key(p, p.groupby("id").x.transform(z)))


def test_peer_z_falls_back(frames):
    df, p = frames
    p = p.assign(band=(p.students // 20))
    result = pd.Series(np.nan, index=p.index)
    for keys in (["year", "band", "county"], ["year", "county"], ["year", "band"], ["year"]):
        g = p.groupby(keys).x
        n, mean, sd = g.transform("count"), g.transform("mean"), g.transform("std")
        z = (p.x - mean) / sd.where(sd > 1e-9)
        fill = result.isna() & (n >= 3)
        result[fill] = z[fill]
    same(panel.with_peer_z(df, {"x": "z"}, "year", "county", "students"), "z", by_key(p, result))


def test_history(frames):
    df, p = frames
    df = df.selectExpr("*", "if(id % 2 = 0, 'a', 'b') as category")
    p = p[(p.year >= 110) | (p.id % 2 == 0)]
    g = p.groupby("id").x
    out = panel.history_z(df, ["id"], "year", "x", "category", {"a": 109, "b": 110})
    same(out, "history_mean", by_key(p, g.transform(lambda s: s.expanding(1).mean())))
    same(out, "moving_mean", by_key(p, g.transform(lambda s: s.rolling(3, min_periods=1).mean())))


def test_year_aligned_prior_skips_gaps(spark):
    df = spark.createDataFrame([(1, 109, 5.0), (1, 111, 9.0), (1, 112, 0.0), (1, 113, 3.0)], "id long, year int, x double")
    out = {r.year: (r.prior, r.rate) for r in panel.yoy(df.selectExpr("*", "'c' as category"), ["id"], "year", "x", "category", {"c": 109}).collect()}
    assert out == {109: (None, None), 111: (None, None), 112: (9.0, -1.0), 113: (0.0, None)}


def test_levels_and_index(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None,), (0.99,), (1.0,), (2.0,), (-5.0,)], "z double")
    got = [r[0] for r in df.select(compliance.level_name(compliance.level_rank(F.col("z")))).collect()]
    assert got == ["N/A", "GREEN", "YELLOW", "RED", "GREEN"]
    assert [r[0] for r in df.select(compliance.level_rank(F.col("z"), higher_bad=False)).collect()] == [0, 1, 1, 1, 3]


def test_missing_indicators_stay_in_the_denominator(spark):
    rows = [(i, "c", y, 10.0, 100.0 + (50 * (i == 0 and y == 113))) for i in range(4) for y in range(109, 114)]
    df = spark.createDataFrame(rows, "id long, county string, year int, students double, cost_per_student double")
    out = {(r.id, r.year): r for r in compliance.warnings_before(compliance.score(df), 114).collect()}
    top = out[0, 113]
    assert top.cost_per_student_level == "YELLOW" and top.turnover_level == "N/A"
    assert top.compliance_index == pytest.approx(round(100 / 19.2, 1))
    assert top.warning == "cost_per_student(YELLOW)" and out[1, 113].warning == "(no warning before the event)"
