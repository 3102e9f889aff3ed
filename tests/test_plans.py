"""Plans: hooks, errors, time limits, configuration texts."""

import time

import pytest
from pyspark.sql import functions as F

from marginalia.plans.pipeline import Plan, Step, read_config


def slow(df):
    wait = F.udf(lambda x: time.sleep(30) or x, "long")
    return df.withColumn("id", wait("id"))


def test_a_step_over_its_time_is_cancelled(spark):
    errors = []
    plan = Plan((Step("slow", slow), Step("fast", lambda df: df.withColumn("b", F.lit(2)))), aborted=errors.append)
    begin = time.time()
    out = plan.run(spark.range(2), ignore_errors=True, time_limit=3).collect()
    assert time.time() - begin < 25 and len(errors) == 1
    assert sorted((r.id, r.b) for r in out) == [(0, 2), (1, 2)]


def test_errors_end_a_plan_unless_ignored(spark):
    seen = []
    plan = Plan((Step("bad", lambda df: df.select("none")),), aborted=seen.append)
    with pytest.raises(Exception):
        plan.run(spark.range(1))
    assert len(seen) == 1
    assert plan.run(spark.range(1), ignore_errors=True).count() == 1


def test_configuration():
    c = read_config("# a\n---\nprrun:\n  a: never\n  b: lang=en # why\nprparm:\n  a.n: 3\n  b.x: 'y'\n  b.z: 1.5\n  b.t: true\n")
    assert c == {"prrun": {"a": "never", "b": "lang=en"}, "prparm": {"a.n": 3, "b.x": "y", "b.z": 1.5, "b.t": True}}
    plan = Plan((Step("a", None), Step("b", None))).configure(c)
    assert [s.when for s in plan.steps] == ["never", ("lang", "en")] and plan.steps[1].params == {"x": "y", "z": 1.5, "t": True}
    for bad in ({"nosuch": {}}, {"prrun": {"c": "never"}} | {"prparm": {"c.n": 1}}):
        with pytest.raises(KeyError):
            Plan((Step("a", None),)).configure(bad)
    with pytest.raises(ValueError):
        read_config("  lost: 1")
