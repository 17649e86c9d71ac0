"""Budgets against the loops they replace."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mixloom.config import TEMPLATE_TYPES
from mixloom.operators import budgets


def split_by_hand(total, ratio):
    floors = [math.floor(round(total * r / sum(ratio), 9)) for r in ratio]
    left = total - sum(floors)
    return [f + (place < left) for place, f in enumerate(floors)]


def fill_by_passes(given, caps):
    kept = [min(b, c) for b, c in zip(given, caps)]
    excess = sum(given) - sum(kept)
    while excess:
        for i, c in enumerate(caps):
            if excess and kept[i] < c:
                kept[i] += 1
                excess -= 1
    return kept


def test_split_of_many_ratios(spark):
    rng = random.Random(1)
    cases = []
    for case in range(300):
        ratio = [rng.choice([1, 2, 3, rng.random()]) for _ in range(rng.randint(1, 9))]
        cases.append((case, rng.randint(0, 500), ratio))
    rows = [(c, i, float(r), t) for c, t, ratio in cases for i, r in enumerate(ratio)]
    df = spark.createDataFrame(rows, "c int, i int, ratio double, t bigint")
    got = budgets.budget_split(df, F.col("t"), "ratio", "i", ["c"]).collect()
    parts = {(r["c"], r["i"]): r["budget"] for r in got}
    for c, t, ratio in cases:
        assert [parts[c, i] for i in range(len(ratio))] == split_by_hand(t, ratio)


def test_redistribution_equals_the_passes(spark):
    rng = random.Random(2)
    cases = []
    for case in range(400):
        caps = [rng.randint(0, 12) for _ in range(rng.randint(1, 9))]
        total = rng.randint(0, sum(caps))
        given = split_by_hand(total, [rng.random() + 0.01 for _ in caps])
        cases.append((case, given, caps))
    rows = [(c, i, b, t) for c, given, caps in cases for i, (b, t) in enumerate(zip(given, caps))]
    df = spark.createDataFrame(rows, "c int, pick int, budget bigint, total bigint")
    got = budgets.cap_redistribute(df, by=["c"]).collect()
    kept = {(r["c"], r["pick"]): r["budget"] for r in got}
    for c, given, caps in cases:
        assert [kept[c, i] for i in range(len(caps))] == fill_by_passes(given, caps)


def templates_by_hand(budget, counts):

    def split2(total, a, b):
        return split_by_hand(total, [a, b]) if a + b else [0, 0]

    zs, fs = split2(budget, counts[0] + counts[1], counts[2] + counts[3])
    return split2(zs, *counts[:2]) + split2(fs, *counts[2:])


def test_template_budgets_of_all_shapes(spark):
    rng = random.Random(3)
    tasks, given = [], []
    for case in range(300):
        counts = [rng.choice([0, rng.randint(1, 30)]) for _ in TEMPLATE_TYPES]
        if not sum(counts):
            counts[rng.randrange(4)] = 5
        tasks.append(("s", f"t{case}", *counts))
        given.append(("s", f"t{case}", rng.randint(0, sum(counts))))
    key = "submixture string, task_name string"
    counts = spark.createDataFrame(tasks, f"{key}, {', '.join(t + ' bigint' for t in TEMPLATE_TYPES)}")
    split = budgets.template_budgets(spark.createDataFrame(given, f"{key}, budget bigint"), counts)
    parts = {(r["task_name"], r["template_type"]): (r["budget"], r["rows"]) for r in split.collect()}
    for task, budget in zip(tasks, given):
        got = [parts[task[1], t][0] for t in TEMPLATE_TYPES]
        assert got == templates_by_hand(budget[2], list(task[2:]))
        assert sum(got) == budget[2]
        assert all(b <= n for b, n in zip(got, task[2:]))


def test_billions_stay_exact(spark):
    counts = spark.createDataFrame([("s", "t", 7 * 10**10, 3, 10**10 + 1, 0)], "submixture string, task_name string, "
                                   + ", ".join(t + " bigint" for t in TEMPLATE_TYPES))
    given = spark.createDataFrame([("s", "t", 5 * 10**10 + 7)], "submixture string, task_name string, budget bigint")
    got = {r["template_type"]: r["budget"] for r in budgets.template_budgets(given, counts).collect()}
    total, zs_rows, fs_rows = 5 * 10**10 + 7, 7 * 10**10 + 3, 10**10 + 1
    zs = -(-total * zs_rows // (zs_rows + fs_rows))
    assert got["zs_opt"] == -(-zs * 7 * 10**10 // zs_rows)
    assert sum(got.values()) == total


@pytest.mark.parametrize("order", [0, 1, 3])
def test_taylor_order_must_be_even(spark, order):
    with pytest.raises(ValueError):
        budgets.taylor_softmax(spark.createDataFrame([(1.0,)], "gain double"), order=order)


def test_softmax_is_positive_for_any_sign(spark):
    gains = spark.createDataFrame([(float(v),) for v in (-50, -1, 0, 1, 80)], "gain double")
    probs = [r["prob"] for r in budgets.taylor_softmax(gains).collect()]
    assert min(probs) > 0 and abs(sum(probs) - 1) < 1e-12


def test_zero_fill(spark):
    tasks = spark.createDataFrame([("a", "t"), ("b", "t")], "submixture string, task_name string")
    given = spark.createDataFrame([("b", "t", 4)], "submixture string, task_name string, budget bigint")
    got = {r["submixture"]: r["budget"] for r in budgets.zero_fill(tasks, given).collect()}
    assert got == {"a": 0, "b": 4}
