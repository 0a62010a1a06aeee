"""The probe plan against a plain greedy walk over all candidates."""

import math
import random

import pytest

from tessera.operators import planner as N
from tessera.operators.profile import PROBE_COSTS


def plain_priority(status, category):
    belief, s = N.BELIEFS[status], N.SIGNALS[category]
    seen = [[1 - s, s], [s, 1 - s], [0.55, 0.45]]
    h = lambda p: -sum(x * math.log(x + 1e-12) for x in p)
    value = h(belief)
    for o in range(2):
        joint = [b * row[o] for b, row in zip(belief, seen, strict=True)]
        p = sum(joint)
        value += -p * h([j / p for j in joint]) + joint[0] - joint[1]
    out = math.tanh(value + 0.5) * 0.5 + 0.5
    return out if status == "ok" else min(1.0, out + 0.15)


def plain_plan(mappings, budget, iterations):
    requests = [(-round(plain_priority(s, c), 12), PROBE_COSTS[c], place, i, t, n, c) for t, n, s, place in mappings if s in N.BELIEFS and s != "no_match" for i, c in enumerate(N.SIGNALS)]
    used, out, taken, stop = 0, {}, 0, False
    for _, cost, _, _, t, n, c in sorted(requests):
        if stop:
            out[t, n, c] = ("cut", None, None)
        elif used + cost > budget:
            out[t, n, c] = ("deferred", None, None)
        else:
            used += cost
            out[t, n, c] = ("scheduled", taken, used)
            taken += 1
            stop = taken >= 6 * iterations
    return out | {(t, n, None): ("excluded", None, None) for t, n, s, _ in mappings if s not in N.BELIEFS or s == "no_match"}


@pytest.mark.parametrize("budget,iterations", [(30_000, 20), (2_000, 20), (299, 20), (99_999, 2), (20_000, 1), (0, 20)])
def test_plan(spark, budget, iterations):
    r = random.Random(budget)
    mappings = [("t", f"c{i}", r.choice([*N.BELIEFS, "odd"]), i) for i in range(15)]
    df = spark.createDataFrame(mappings, "table_name string, column_name string, status string, place int").repartition(3)
    got = N.probe_plan(df, budget, iterations).collect()
    assert {(x.table_name, x.column_name, x.category): (x.state, x.place, x.used) for x in got} == plain_plan(mappings, budget, iterations) and len(got) == len({tuple(x[:3]) for x in got})
    assert all(x.category is None or abs(x.priority - plain_priority(dict((n, s) for _, n, s, _ in mappings)[x.column_name], x.category)) < 1e-12 for x in got)
    probed = {x.column_name for x in got if x.state == "scheduled"}
    assert {x.column_name for x in N.unprobed(N.probe_plan(df, budget, iterations)).collect()} == {f"c{i}" for i in range(15)} - probed
    assert all(("deferred" in x.reason) == (x.state == "deferred") for x in got if x.reason)


def test_uncertain_mappings_come_first(spark):
    v = {(x.status, x.category): x.priority for x in N.probe_values(spark).collect()}
    assert len(v) == 18 and all(v["low_confidence", c] > v["ok", c] - 0.15 for c in N.SIGNALS)
    mean = {s: sum(v[s, c] for c in N.SIGNALS) / 6 for s in ("ok", "low_confidence")}
    assert mean["low_confidence"] > mean["ok"]
    assert N.probe_plan(spark.createDataFrame([], "table_name string, column_name string, status string, place int")).count() == 0
