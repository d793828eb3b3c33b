"""Baselines over runs: rows scored in several runs have the scores of one; one frame or parts give the same counts."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import baselines, scoring, state
from tidewatch.operators.windows import KEY

from .test_engine import frames, history

FIGURES = ("n_bucket", "stats_n", "lines_mean", "lines_var", "rarity", "drift", "volume", "total", "centroid_norm")


def by_row(df, *names):
    return {(r.tenant_id, r.device_key, r.ws): [float(r[n]) for n in names] for r in df.collect()}


def varied(rows):
    return rows.withColumns({"lines": F.lit(3) + F.pmod(F.xxhash64(*KEY), F.lit(40)), "bytes": F.lit(9) + F.pmod(F.xxhash64("ws"), F.lit(900))})


def runs_of(spark, tmp_path, rows, features, cuts, **caps):
    """Scores of the rows between cuts, each run from the folder that the last one left; and the baselines in the end."""
    found, past = {}, None
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 1 << 60])):
        own = (F.col("ws") >= a) & (F.col("ws") < b)
        got, seen = scoring.scored(rows.where(own), features.where(own), 3600, past=past, carry=True)
        found |= by_row(got, *FIGURES)
        state.save(state.advanced(past or state.empty(spark), got, seen, **caps), str(tmp_path / f"b{k}"))
        past = state.load(spark, str(tmp_path / f"b{k}"))
    return found, past


@pytest.mark.parametrize("seed,crowd", [(1, None), (2, 0)])
def test_runs_score_as_one(spark, tmp_path, monkeypatch, seed, crowd):
    if crowd is not None:
        monkeypatch.setattr(baselines, "CROWD", crowd)
    listed = history(seed)
    rows, features = frames(spark, listed)
    rows = varied(rows).cache()
    features = features.cache()
    whole, seen = scoring.scored(rows, features, 3600, carry=True)
    want = by_row(whole, *FIGURES)
    times = sorted({r[2] for r in listed})
    rng = random.Random(seed)
    cuts = sorted(rng.sample(times, 2)) + [times[-1] + 1]  # the last run has no rows
    found, past = runs_of(spark, tmp_path, rows, features, cuts)
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert found[k] == pytest.approx(v, abs=1e-6), k
    once = state.advanced(state.empty(spark), whole, seen)
    for name, keys in (("windows", 3), ("features", 4)):
        assert sorted(map(tuple, getattr(past, name).collect())) == sorted(map(tuple, getattr(once, name).collect()))
    for name, keys in (("groups", 3), ("centroids", 4)):
        a, b = ({tuple(r)[:keys]: list(tuple(r)[keys:]) for r in getattr(x, name).collect()} for x in (past, once))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_merged_moments(spark):
    rng = random.Random(4)
    x = [rng.random() * 100 for _ in range(50)]

    def of(v):
        mean = sum(v) / len(v) if v else 0.0
        return len(v), mean, sum((y - mean) ** 2 for y in v)

    for cut in (0, 1, 20, 50):
        a, b, both = of(x[:cut]), of(x[cut:]), of(x)
        mean, m2 = baselines.merged_moments(*[F.lit(v) for v in (*a, *b)])
        got = spark.range(1).select(mean.alias("mean"), m2.alias("m2")).first()
        assert (got.mean, got.m2) == pytest.approx(both[1:])


def test_slots_and_caps(spark, tmp_path):
    """A slot keeps its latest day, of all buckets; caps keep the largest."""
    day, rows = 86_400, [("t", "a", 1 * 86_400, ["w=x", "k=y"]), ("t", "a", 8 * 86_400 + 3600, ["w=x", "q"]), ("t", "b", 9 * 86_400, ["q"]), ("u", "a", 1 * 86_400, ["q"])]
    r, f = frames(spark, rows)
    _, past = runs_of(spark, tmp_path, r, f, [8 * day])
    assert sorted((x.tenant_id, x.day) for x in past.windows.collect()) == [("t", 8), ("t", 9), ("u", 1)]
    assert sorted((x.tenant_id, x.feature, x.day, x.c) for x in past.features.collect()) == [("t", "q", 8, 1), ("t", "q", 9, 1), ("t", "w=x", 8, 1), ("u", "q", 1, 1)]
    _, past = runs_of(spark, tmp_path / "capped", r, f, [8 * day], most_features=1, most_values=1)
    assert past.features.where("day = 8").count() == 1 and {x.n for x in past.centroids.groupBy("tenant_id", "device_key", "bucket").agg(F.count("*").alias("n")).collect()} == {1}


def test_no_rows(spark, tmp_path):
    r, f = frames(spark, history(1))
    found, past = runs_of(spark, tmp_path, r.limit(0), f.limit(0), [])
    assert found == {} and all(getattr(past, n).count() == 0 for n in state.SCHEMAS)
