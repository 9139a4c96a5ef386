"""Quantiles by selection and cuts by descent, against plain sorts, with the rows that a task holds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgelens.operators import bootstrap
from judgelens.operators.cuts import first_cuts, next_cuts, run_sums, run_widths, weighted_queue_yield, yields_at
from judgelens.operators.quantiles import _bracketed, _classes, exact_quantiles, values_at
from judgelens.operators.review import review_queue

FRACTIONS = (0.0, 0.025, 0.5, 0.77, 0.975, 1.0)


def shapes(n=20_000):
    rng = random.Random(11)
    return {
        "distinct": [rng.uniform(-1, 1) for _ in range(n)],
        "one value": [0.25] * n,
        "mostly one": [0.0 if rng.random() < 0.974 else rng.random() for _ in range(n)],
        "two values": [rng.choice([1.0, 2.0]) for _ in range(n)],
        "steep": [10.0 ** rng.uniform(-300, 300) for _ in range(n)],
        "few": [3.0, 1.0, None, 2.0],
        "one": [5.0],
        "none": [None, None],
        None: [float(rng.randrange(50)) for _ in range(n)],
    }


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(label, x) for label, values in shapes().items() for x in values]
    return spark.createDataFrame(rows, "label string, p double").repartition(6)


@pytest.mark.parametrize("small", [64, 100_000])
def test_quantiles_equal_sorted_values(scores, small):
    log = []
    found = {r.label: r for r in exact_quantiles(scores, "p", FRACTIONS, "label", small=small, log=log).collect()}
    expected = shapes()
    assert set(found) == set(expected)
    for label, values in expected.items():
        values = [x for x in values if x is not None]
        assert found[label].n_valid == len(values)
        if values:
            assert found[label].quantiles == pytest.approx(np.quantile(values, FRACTIONS).tolist(), rel=1e-12), label
        else:
            assert found[label].quantiles == [None] * len(FRACTIONS)
    assert (small == 64) == bool(log)
    if log:
        # Rows that go on to the next turn: a few hundredths for each wanted rank, none for a value that fills a bracket.
        ranks = 2 * len(FRACTIONS) * len(expected)
        assert log[0] < ranks * 20_000 * 0.03 and log[-1] <= ranks * 64


def test_no_task_holds_more_rows_of_a_rank_than_asked(spark, scores):
    values = scores.where("p IS NOT NULL").select("label", F.col("p").alias("v"))
    wanted = values.groupBy("label").agg((F.count("*") / 2 + 1).cast("long").alias("rank")).select("label", F.lit(0).alias("want"), "rank")
    seen = []
    rows = values_at(values, wanted, ["label"], small=50, log=seen).collect()
    plain = {label: sorted(x for x in v if x is not None) for label, v in shapes().items()}
    assert {r.label: r.value for r in rows} == {k: v[len(v) // 2] for k, v in plain.items() if v}
    assert seen[-1] <= 50 * len(plain)


def test_rows_of_a_large_group_stay_where_they_are(spark, scores):
    """Neither turn nor end sorts all rows of a group in one task, however the sizes of tables are judged."""
    values = scores.where("p IS NOT NULL").select("label", F.col("p").alias("v"))
    wanted = spark.createDataFrame([("distinct", 0, 10_000)], "label string, want int, rank long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _classes(_bracketed(values, wanted, ["label"]), values, ["label"])
        assert [(r.part, r.n_open < 1000) for r in found.collect()] in ([(1, True)], [(2, True)], [(3, True)])
        joined = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count("broadcast") >= 2, joined


def test_quantiles_without_groups_or_rows_and_of_nan(spark):
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "p double")
    (row,) = exact_quantiles(nan, "p", [0.0, 0.5, 1.0]).collect()
    assert row.n_valid == 3 and row.quantiles[:2] == [1.0, 2.0] and math.isnan(row.quantiles[2])
    assert exact_quantiles(nan.limit(0), "p", [0.5], "p").count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(nan, "p", [1.5])


# Cuts


def test_widths():
    assert run_widths(0) == [1] and run_widths(256) == [1] and run_widths(257) == [256, 1]
    assert run_widths(10, 2) == [8, 4, 2, 1]
    for n, fan in ((1, 2), (999, 3), (10**12, 256)):
        assert -(-n // run_widths(n, fan)[0]) <= fan
    with pytest.raises(ValueError):
        run_widths(5, 1)


def weighted_rows(spark, n=3000):
    rng = random.Random(5)
    rows = [(g, rank, rng.choice([0, 1, 1, 5, 400 if g == 2 else 2]), int(rng.random() < 0.3)) for g in range(3) for rank in range(1, n + 1) if g < 2 or rank % 7 == 0]
    rows = [r for r in rows if r[2]]
    return rows, spark.createDataFrame(rows, "g int, queue_rank long, weight long, is_error long").repartition(4)


@pytest.mark.parametrize("fan", [2, 16, 256, 5000])
def test_cuts_equal_the_expanded_queue(spark, fan):
    rows, df = weighted_rows(spark)
    budgets = [0.0, 0.0001, 0.05, 0.05, 0.3, 1.0]
    got = sorted((r.g, r.budget_fraction, r.n_reviewed, r.n_errors_found, r.priority_yield, r.random_yield) for r in weighted_queue_yield(df, "g", budgets, fan).collect())
    expected = []
    for g in range(3):
        items = [e for x, _, w, e in sorted(rows) if x == g for _ in range(w)]
        for b in budgets:
            k = math.floor(len(items) * b)
            if k:
                expected.append((g, b, k, sum(items[:k]), sum(items[:k]) / k, sum(items) / len(items)))
    assert got == sorted(expected)


def test_no_window_of_a_cut_holds_more_rows_than_the_fan(spark):
    _, df = weighted_rows(spark)
    fan, widths = 8, run_widths(3000, 8)
    sums = run_sums(df, "g", widths[0])
    cuts = first_cuts(sums, "g", [0.05, 0.6])
    assert sums.groupBy("g").count().agg(F.max("count")).first()[0] <= fan
    for width in widths[1:]:
        sums = run_sums(df, "g", width)
        parents = cuts.select("g", F.col("run").alias("p")).distinct()
        dealt = sums.withColumn("p", F.expr(f"run div {fan}L")).join(parents, ["g", "p"], "left_semi")
        assert dealt.groupBy("g", "p").count().agg(F.max("count")).first()[0] <= fan
        cuts = next_cuts(cuts, sums, "g", fan)
    assert yields_at(cuts, "g").count() == 6


def test_queue_without_rows(spark):
    _, df = weighted_rows(spark, 10)
    assert weighted_queue_yield(df.limit(0), "g", [0.5]).count() == 0


@pytest.mark.parametrize("fan", [3, 64])
def test_replicates_descend_to_the_same_cuts(spark, fan):
    rng = random.Random(8)
    rows = [(i, rng.randrange(40), rng.choice("ESCI"), "E", round(rng.random(), 2)) for i in range(700)]
    scored = spark.createDataFrame(rows, "example_id long, query_id long, label string, prediction string, p_e double")
    sampler = bootstrap.Resampler(scored, replicates=6, seed=3, chunk=16, fan=fan)
    weights = {(r.replicate, r.query_id): r.weight for r in sampler.cluster_weights().collect()}
    queue = review_queue(scored).orderBy("queue_rank").collect()
    for r in sampler.audit_yield(0.1).collect():
        items = [q.label != "E" for q in queue for _ in range(weights.get((r.replicate, q.query_id), 0))]
        k = math.floor(len(items) * 0.1)
        assert (r.n_reviewed, r.priority_yield, r.random_yield) == (k, pytest.approx(sum(items[:k]) / k), pytest.approx(sum(items) / len(items)))


def test_a_turn_sums_only_open_runs(spark):
    rows = [(i, i % 40, "S", "E", i / 1000) for i in range(900)]
    scored = spark.createDataFrame(rows, "example_id long, query_id long, label string, prediction string, p_e double")
    sampler = bootstrap.Resampler(scored, replicates=5, seed=3, chunk=16, fan=4)
    entries = sampler.queue_entries(sampler.ranked(), 4)
    run = 12
    span = (bootstrap.CELL_COUNT + 2 * run, bootstrap.CELL_COUNT + 2 * (run + 4))
    some = sampler.weighted_sums(entries, {2: span})
    everything = sampler.weighted_sums(entries).where(f"replicate = 2 AND feature >= {span[0]} AND feature < {span[1]}")
    found = sorted(map(tuple, some.collect()))
    assert found == sorted(map(tuple, everything.collect())) and 0 < len(found) <= 8
