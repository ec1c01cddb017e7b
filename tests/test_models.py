"""Mixed models with categories, two-group tests and the choice between them, against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphlake.functions import tails
from morphlake.operators import stats


def _study(spark, animals=14, seed=4):
    rng = np.random.default_rng(seed)
    data = []
    for i in range(animals):
        own = rng.normal() * 2
        for label in ("in", "mid", "out"):
            for day in range(int(rng.integers(1, 4))):
                c = "treated" if (i + day) % 2 else "control"
                y = 10 + own + (3 if c == "treated" else 0) + {"in": 0, "mid": 1, "out": -2}[label] + rng.normal()
                data.append((i, c, label, float(day), float(y)))
    return data, spark.createDataFrame(data, "animal_id int, condition string, region_label string, day double, y double")


def test_categories_and_interactions_against_the_dense_likelihood(spark):
    data, frame = _study(spark)
    terms = [("condition",), ("region_label",), ("condition", "region_label"), "day"]
    got = {r["term"]: r for r in stats.mixed_model(frame, terms, "y", "animal_id").collect()}
    ids, y = np.array([r[0] for r in data]), np.array([r[4] for r in data])
    treated, mid, out, day = (np.array([float(f(r)) for r in data]) for f in (lambda r: r[1] == "treated", lambda r: r[2] == "mid", lambda r: r[2] == "out", lambda r: r[3]))
    x = np.column_stack([np.ones(len(y)), treated, mid, out, treated * mid, treated * out, day])
    names = ["intercept", "condition[treated]", "region_label[mid]", "region_label[out]", "condition[treated]:region_label[mid]", "condition[treated]:region_label[out]", "day"]
    same = (ids[:, None] == ids[None]).astype(float)

    def likelihood(residual, group):
        v = residual * np.eye(len(y)) + group * same
        inverse = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y)
        r = y - x @ beta
        return -0.5 * (len(y) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ inverse @ r), beta, np.sqrt(np.diag(np.linalg.inv(x.T @ inverse @ x)))

    residual, group = got["residual_variance"]["estimate"], got["group_variance"]["estimate"]
    best, beta, errors = likelihood(residual, group)
    assert all(likelihood(residual * a, group * b)[0] < best for a, b in ((1.02, 1), (0.98, 1), (1, 1.05), (1, 0.95), (1.02, 0.95)))
    for name, b, s in zip(names, beta, errors, strict=True):
        assert got[name]["estimate"] == pytest.approx(b, abs=1e-6) and got[name]["se"] == pytest.approx(s, rel=1e-5)
        assert got[name]["low"] == pytest.approx(b - 1.959964 * s, abs=1e-4)
    assert set(got) == {*names, "residual_variance", "group_variance"}
    ordered = sorted((got[n]["p"] for n in names), reverse=True)
    running = 1.0
    for rank, p in zip(range(len(names), 0, -1), ordered, strict=True):
        running = min(running, p * len(names) / rank)
        assert any(got[n]["p"] == p and got[n]["p_fdr"] == pytest.approx(running) for n in names)


def test_models_that_cannot_be_fitted(spark):
    _, frame = _study(spark)
    with pytest.raises(ValueError, match="depend"):
        stats.mixed_model(frame.withColumn("twice", F.col("day") * 2), ["day", "twice"], "y", "animal_id")
    with pytest.raises(ValueError, match="no variance"):
        stats.mixed_model(frame.withColumn("y", F.lit(1.0)), [], "y", "animal_id")
    with pytest.raises(ValueError, match="two groups"):
        stats.mixed_model(frame.where("animal_id = 0"), [], "y", "animal_id")
    with pytest.raises(ValueError, match="levels"):
        stats.design_columns(frame, [("region_label",)], most_levels=2)


def test_choice_and_fall_back(spark):
    _, frame = _study(spark)
    decide = lambda f, *a, **k: (lambda d, r: (d.first(), r))(*stats.study_statistics(f, "y", *a, **k))
    d, results = decide(frame, True, [("condition",)])
    assert (d.selected, d.reason, d.fallback) == ("mixed", "repeated_structure", None) and {r.term for r in results.collect()} >= {"intercept", "condition[treated]"}
    twice = frame.withColumn("twice", F.col("day") * 2)
    d, results = decide(twice, True, ["day", "twice"])
    assert (d.selected, d.fallback) == ("simple", "the terms depend on each other") and {r.term for r in results.collect()} == {"welch_t", "mann_whitney"}
    with pytest.raises(ValueError, match="depend"):
        stats.study_statistics(twice, "y", True, ["day", "twice"], mode="mixed")
    with pytest.raises(ValueError, match="repeated"):
        stats.study_statistics(frame, "y", False, [], mode="mixed")
    d, results = decide(frame.where("condition = 'control'"), False, [])
    assert (d.selected, d.reason, results.count()) == ("none", "no_repeated_structure", 0)
    d, results = decide(frame, False, [], by=["region_label"])
    assert d.selected == "simple" and {r.term for r in results.collect()} == {f"{r}:{t}" for r in ("in", "mid", "out") for t in ("welch_t", "mann_whitney")}


def test_two_group_tests_and_regions(spark):
    a, b = [12.0, 15.0, 11.0, 18.0, 15.0], [20.0, 15.0, 24.0, 21.0]
    frame = spark.createDataFrame([("r", c, v) for c, vs in (("a", a), ("b", b)) for v in vs] + [("one", "a", 1.0), ("one", "b", 2.0)], "region string, condition string, y double")
    got = {(r.region, r.test): r for r in stats.two_group_tests(frame, "y", ["region"]).collect()}
    assert set(got) == {("r", "welch_t"), ("r", "mann_whitney")}
    va, vb = np.var(a, ddof=1) / len(a), np.var(b, ddof=1) / len(b)
    t, df = (np.mean(a) - np.mean(b)) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / 4 + vb**2 / 3)
    assert got["r", "welch_t"].statistic == pytest.approx(t) and got["r", "welch_t"].p == pytest.approx(tails.t_two_sided(t, df))
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got["r", "mann_whitney"].statistic == u
    pooled = math.sqrt((4 * np.var(a, ddof=1) + 3 * np.var(b, ddof=1)) / 7)
    assert got["r", "welch_t"].effect == pytest.approx((np.mean(a) - np.mean(b)) / pooled)
    assert stats.two_group_tests(frame.withColumn("condition", F.lit("a")), "y").count() == 0


def _nested(spark, seed=9):
    rng = np.random.default_rng(seed)
    data = []
    for animal in range(12):
        own = rng.normal() * 2
        for eye in ("OD", "OS")[: 1 + animal % 2 + (animal % 3 > 0)]:
            of_eye = rng.normal() * 1.5
            for sample in range(int(rng.integers(1, 4))):
                of_sample = rng.normal()
                for label in ("in", "out"):
                    for _ in range(int(rng.integers(1, 3))):
                        treated = float((animal + sample) % 2)
                        data.append((f"A{animal}", eye, f"S{sample}", label, treated, float(5 + 3 * treated - 2 * (label == "out") + own + of_eye + of_sample + rng.normal() * 0.7)))
    return data, spark.createDataFrame(data, "animal_id string, eye string, sample_id string, region_label string, treated double, y double")


@pytest.mark.parametrize("most", [100_000, 0])
def test_nested_variances_against_the_dense_likelihood(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "MOST_CLUSTERS", most)
    data, frame = _nested(spark)
    nested = ["eye", "sample_id"] if most else ["eye"]
    got = {r["term"]: r for r in stats.nested_model(frame, ["treated", ("region_label",)], "y", "animal_id", nested).collect()}
    y = np.array([r[5] for r in data])
    x = np.column_stack([np.ones(len(y)), [r[4] for r in data], [float(r[3] == "out") for r in data]])
    same = [np.array([[float(a[: k + 1] == b[: k + 1]) for b in data] for a in data]) for k in range(1 + len(nested))]

    def likelihood(variances):
        v = variances[-1] * np.eye(len(y)) + sum(g * s for g, s in zip(variances, same, strict=False))
        inverse = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y)
        r = y - x @ beta
        return -0.5 * (len(y) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ inverse @ r), beta, np.sqrt(np.diag(np.linalg.inv(x.T @ inverse @ x)))

    names = ["group_variance", *[f"{n}_variance" for n in nested], "residual_variance"]
    found = np.array([got[n]["estimate"] for n in names])
    best, beta, errors = likelihood(found)
    assert (found >= 0).all() and (found > 0.01).sum() >= 2
    for k in range(len(found)):
        for factor in (0.8, 0.95, 1.05, 1.2):
            moved = found.copy()
            moved[k] *= factor
            assert likelihood(moved)[0] <= best + 1e-8
    for name, b, s in zip(["intercept", "treated", "region_label[out]"], beta, errors, strict=True):
        assert got[name]["estimate"] == pytest.approx(b, abs=1e-6) and got[name]["se"] == pytest.approx(s, rel=1e-5)


def test_one_level_equals_the_plain_model(spark):
    _, frame = _nested(spark)
    plain = {r["term"]: r for r in stats.mixed_model(frame, ["treated"], "y", "animal_id").collect()}
    same = {r["term"]: r for r in stats.nested_model(frame, ["treated"], "y", "animal_id", []).collect()}
    assert set(plain) == set(same) and all(plain[t]["estimate"] == pytest.approx(same[t]["estimate"], rel=1e-5, abs=1e-6) for t in plain)


def test_the_ladder_drops_what_cannot_be_fitted(spark):
    _, frame = _nested(spark)
    one_eye = frame.where("eye = 'OD'")
    _, rung, reasons = stats.mixed_model_ladder(one_eye, ["treated"], "y", "animal_id", ["eye", "sample_id"])
    assert rung == ["sample_id"] and len(reasons) == 2 and "eye" in reasons[0]
    once = frame.groupBy("animal_id", "eye").agg(F.first("treated").alias("treated"), F.avg("y").alias("y"))
    model, rung, reasons = stats.mixed_model_ladder(once, ["treated"], "y", "animal_id", ["eye"])
    assert rung == [] and len(reasons) == 1 and "group_variance" in {r["term"] for r in model.collect()}
    with pytest.raises(ValueError, match="two groups"):
        stats.mixed_model_ladder(frame.where("animal_id = 'A1'"), ["treated"], "y", "animal_id", ["eye"])
    decision, results = stats.study_statistics(frame.withColumn("condition", F.col("treated").cast("string")), "y", True, ["treated"], nested=["eye", "sample_id"])
    assert decision.first()["selected"] == "mixed" and "sample_id_variance" in {r["term"] for r in results.collect()}
