"""Slices against a pass per slice."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weakloom.operators import evaluation as ev
from weakloom.operators import slices as sl


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(5)
    data = [(i, pick.choice([1, 2, 3, None]), pick.choice([1, 2, 3]), pick.random() * 10, pick.choice(["a", "b", None])) for i in range(500)]
    return spark.createDataFrame(data, "id int, gold int, pred int, x double, kind string").cache()


PARTS = {"all": "true", "a": "kind = 'a'", "large": "x > 5", "none": "false", "even": "id % 2 = 0", "not a": "kind <> 'a'"}


def test_scores_equal_a_pass_per_slice(rows):
    marked = sl.with_slices(rows, PARTS)
    found = {(r["slice"], r["class"]): tuple(r)[2:] for r in sl.slice_scores(marked, "gold", "pred", list(PARTS)).collect()}
    want = {(name, r["class"]): tuple(r)[1:] for name, part in PARTS.items()
            for r in ev.class_scores(ev.confusion(rows.where(part), "gold", "pred")).collect()}
    assert found == want and ("none", 1) not in found


def test_overlaps(rows):
    marked = sl.with_slices(rows, PARTS)
    found = {(r.left, r.right): r.n for r in sl.slice_overlaps(marked, list(PARTS)).collect()}
    names = list(PARTS)
    for i, a in enumerate(names):
        for b in names[i:]:
            n = rows.where(f"({PARTS[a]}) and ({PARTS[b]})").count()
            assert found.get((a, b), 0) == n


def test_weights(rows):
    marked = sl.with_slices(rows.withColumn("wrong", (F.col("gold") != F.col("pred")).cast("double")), PARTS)
    residuals = sl.slice_residuals(marked, "wrong", list(PARTS))
    every = marked.agg(F.avg("wrong")).first()[0]
    by_name = {r["slice"]: r for r in residuals.collect()}
    assert "none" not in by_name and abs(by_name["all"].residual) < 1e-12
    for name in ("a", "large", "even"):
        mean = marked.where(PARTS[name]).agg(F.avg("wrong")).first()[0]
        assert math.isclose(by_name[name].residual, mean / every - 1, abs_tol=1e-9)
    weighted = sl.residual_weights(marked, residuals, len(PARTS)).collect()
    for r in weighted[:50]:
        inside = [n for i, n in enumerate(PARTS) if r.slices >> i & 1]
        assert math.isclose(r.weight, 1 + sum(max(0.0, by_name[n].residual) for n in inside), abs_tol=1e-9)


def test_one_pass_and_bounds(spark, rows):
    """One count over the table, with 63 slices as with two; more do not fit."""
    many = {f"s{i}": F.col("id") % (i + 2) == 0 for i in range(63)}
    marked = sl.with_slices(rows, many)
    scored = sl.slice_scores(marked, "gold", "pred", list(many))
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1
    n = {r["slice"]: r.hits + r.missed for r in scored.where("class = 1").collect()}
    assert n["s62"] == rows.where("id % 64 = 0 and gold = 1").count()
    for wrong in ({}, {f"s{i}": "true" for i in range(64)}):
        with pytest.raises(ValueError):
            sl.with_slices(rows, wrong)
    empty = sl.with_slices(rows.where("false"), PARTS)
    assert sl.slice_scores(empty, "gold", "pred", list(PARTS)).count() == 0
    assert sl.slice_residuals(empty.withColumn("l", F.lit(1.0)), "l", list(PARTS)).count() == 0
