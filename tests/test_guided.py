"""Proposals from a model: the process itself, and searches with and without it."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidgraph.operators import guided, search
from lucidgraph.operators.guided import C_RANGE, T_RANGE, proposed_trials
from lucidgraph.sources import read_trials, vertices_of


def history(spark, rows):
    return spark.createDataFrame(rows, "study string, trial long, c double, t double, score double")


def test_process_follows_its_points():
    random = np.random.default_rng(1)
    points = random.random((12, 2))
    values = np.sin(5 * points[:, 0]) + points[:, 1]
    model = guided.Process(points, values - values.mean(), 0.4)
    mean, deviation = model.predict(points)
    assert np.abs(mean - (values - values.mean())).max() < 0.01 and deviation.max() < 0.02
    far, unsure = model.predict(np.array([[30.0, 30.0]]))
    assert abs(far[0]) < 1e-6 and unsure[0] == pytest.approx(1.0)


def test_likelihood_is_that_of_a_normal_density():
    points, values = np.array([[0.1, 0.2], [0.4, 0.9]]), np.array([1.0, -1.0])
    model = guided.Process(points, values, 0.8)
    covariance = guided.matern(points, points, 0.8) + guided.NOISE * np.eye(2)
    wanted = -0.5 * values @ np.linalg.inv(covariance) @ values - 0.5 * math.log(np.linalg.det(covariance))
    assert model.log_likelihood() == pytest.approx(wanted)


def test_expected_improvement_equals_its_integral():
    grid = np.linspace(-12, 12, 200_001)
    density = np.exp(-0.5 * grid * grid) / math.sqrt(2 * math.pi)
    for mean, deviation, best in ((0.3, 0.5, 0.0), (-1.0, 0.1, 0.5), (2.0, 1.5, -1.0)):
        wanted = np.trapezoid(np.maximum(best - mean - deviation * grid, 0) * density, grid)
        found = guided.expected_improvement(np.array([mean]), np.array([deviation]), best)[0]
        assert found == pytest.approx(wanted, abs=1e-6)


def test_studies_are_proposed_side_by_side(spark):
    rows = [("a", i, 1.0 + i, 5.0 * i + 1, float((i - 4) ** 2)) for i in range(10)]
    rows += [("b", 0, 10.0, 50.0, 1.0), ("c", 0, 10.0, 50.0, None), ("d", 1, 2.0, 3.0, 7.0), ("d", 2, 2.0, 3.0, 7.0)]
    frame = history(spark, rows)
    found = proposed_trials(frame, 3, ["study"], candidates=64).collect()
    assert sorted((r.study, r.place) for r in found) == [(s, i) for s in "abd" for i in range(3)]
    assert all(C_RANGE[0] <= r.c <= C_RANGE[1] and T_RANGE[0] <= r.t <= T_RANGE[1] for r in found)
    assert all(r.expected_improvement >= 0 for r in found)
    # trials of a round differ, and a study alone gets the same
    assert len({(r.study, r.c, r.t) for r in found}) == 9
    alone = proposed_trials(frame.where("study = 'a'"), 3, candidates=64).orderBy("place").collect()
    both = sorted((r for r in found if r.study == "a"), key=lambda r: r.place)
    assert [(r.c, r.t) for r in alone] == [(r.c, r.t) for r in both]


def test_a_long_study_is_fitted_to_its_best_and_its_latest(spark):
    rows = [("a", i, 1.0 + i % 19, 0.5 + i % 90, float(i % 17)) for i in range(300)]
    seen = guided._observed(history(spark, rows + rows[:3]), ["study"], 40).collect()
    trials = {r.trial for r in seen}
    assert {i for i in range(300) if i % 17 == 0} <= trials and set(range(280, 300)) <= trials
    assert len(seen) <= 40
    assert proposed_trials(history(spark, rows), 1, observations=40).count() == 1


def test_empty_history(spark):
    assert proposed_trials(history(spark, [])).count() == 0
    trials = search.next_trials(history(spark, []).drop("study"), 5, 2, "model", 3, 0.5, 42)
    wanted = search.trial_candidates(spark.createDataFrame([(5,), (6,)], "trial long"))
    assert sorted(trials.collect()) == sorted(wanted.collect())
    with pytest.raises(ValueError):
        search.next_trials(history(spark, []), 5, 2, "other", 3, 0.5, 42)


def _score(c, t, centre):
    """Worse away from a point, with ripples that have minima of their own."""
    u, v = (c - 1.0) / 19.0 - centre[0], (t - 0.1) / 99.9 - centre[1]
    return 4 * (u * u + v * v) + 0.15 * (2 - math.cos(14 * u) - math.cos(14 * v))


def _trials_needed(spark, guide, centre, goal, per_round=4, rounds=9):
    rows = []
    for number in range(rounds):
        first = number * per_round
        if number == 0:
            ids = spark.range(per_round).withColumnRenamed("id", "trial")
            trials = search.trial_candidates(ids, int(100 * centre[0]))
        else:
            frame = spark.createDataFrame(rows, "trial long, c double, t double, score double")
            trials = search.next_trials(frame, first, per_round, guide, 3, 0.5**number, 42)
        for r in sorted(trials.collect()):
            rows.append((r.trial, r.c, r.t, _score(r.c, r.t, centre)))
            if rows[-1][-1] <= goal:
                return len(rows)
    return per_round * rounds + 1


def test_the_model_needs_fewer_trials(spark):
    centres = [(0.22, 0.71), (0.8, 0.35), (0.55, 0.5)]
    needed = {
        guide: [_trials_needed(spark, guide, centre, 0.06) for centre in centres]
        for guide in ("model", "near")
    }
    assert sum(needed["model"]) < 0.7 * sum(needed["near"]), needed


def test_a_broken_round_is_written_over(spark, make, tmp_path):
    edges, _ = make({"a": (0, 0)}, [("a", "b"), ("b", "c"), ("c", "d")])
    vertices, path = vertices_of(edges), str(tmp_path / "search")
    options = dict(per_round=3, iterations=1, r=1.0, g=0.5, path=path)
    whole = sorted(search.sweep(vertices, edges, rounds=2, **options).drop("nc_t", "ec_t").collect())
    assert [r.trial for r in whole] == list(range(6))
    # a round of which one row was written
    folder = tmp_path / "search" / "history" / "round=1"
    lines = [x for f in folder.glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 3
    for file in [*folder.glob("*.json"), *folder.glob(".*.crc"), *folder.glob("_SUCCESS")]:
        file.unlink()
    (folder / "part-0.json").write_text(json.dumps(json.loads(lines[0])) + "\n")
    assert read_trials(spark, search.history_path(path)).count() == 4
    for _ in range(2):
        again = search.sweep(vertices, edges, rounds=2, **options).drop("nc_t", "ec_t").collect()
        assert sorted(again) == whole


def test_the_whole_history_streams(spark, make, tmp_path):
    from lucidgraph.streaming import stream_trials

    edges, _ = make({"a": (0, 0)}, [("a", "b"), ("b", "c")])
    path = str(tmp_path / "search")
    search.sweep(vertices_of(edges), edges, rounds=2, per_round=2, iterations=1, g=0.5, path=path)
    stream = stream_trials(spark, search.history_path(path)).writeStream.outputMode("complete")
    query = stream.format("memory").queryName("searched").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("searched").head().trials == 4
    assert spark.table("searched").select(F.col("best_trial").isNotNull()).count() == 1
