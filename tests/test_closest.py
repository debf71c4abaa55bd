"""Links from the cheapest candidates of each row: equal to those from the whole table of candidates."""

import random

import pytest
from pyspark.sql import functions as F

from gyrelake.operators import closest, pairs, tracking


@pytest.fixture(scope="module")
def obs(spark):
    rng = random.Random(3)
    rows = [(k, k % 3, rng.choice([0.0, 0.25, 0.5, 359.75]), rng.choice([0.0, 0.25]), rng.choice([0.0, 1.0, 2.0, 5.0]), rng.choice([1e4, 2e4])) for k in range(90)]
    return spark.createDataFrame(rows, "obs_id long, time int, lon double, lat double, amplitude double, radius_s double")


@pytest.mark.parametrize("by_cost", [True, False])
def test_links_with_two_candidates_at_hand(obs, by_cost):
    plain = pairs.assigned if by_cost else tracking.assigned_in_order
    want = {(r["step"], r["a"], r["b"]) for r in plain(pairs.step_candidates(obs)).collect()}
    assert {(r["step"], r["a"], r["b"]) for r in closest.linked(obs, by_cost=by_cost, kept=2).collect()} == want


def test_only_the_cheapest_leave_a_task(obs):
    found = closest.closest(obs, obs, 1.0, closest.partial(closest.step_cost, 125_000.0), 2)
    all_of = {r["a"]: r["n"] for r in pairs.step_candidates(obs).groupBy("a").agg(F.count("*").alias("n")).collect()}
    assert {r["a"]: r["n"] for r in found.groupBy("a").agg(F.count("*").alias("n")).collect()} == {a: min(n, 2) for a, n in all_of.items()}
