"""Orderings of groups: edge cases, chunks, budgets, partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixloom import cluster
from mixloom.config import GROUP_KEY
from mixloom.functions.greedy import greedy
from mixloom.operators import exact, facility, ordering, passes, similarity, tasks

SCHEMA = (
    "submixture string, task_name string, template_type string, row_idx bigint, embedding array<float>"
)


def rows_of(sizes, width=6, seed=1):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            v = rng.normal(size=width)
            rows.append(("s", name, "zs_opt", at, [float(x) for x in v]))
            at += 1
    return rows


def in_order(df):
    orders = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        orders.setdefault((r["submixture"], r["task_name"], r["template_type"]), []).append(r["row_idx"])
    return orders


@pytest.mark.parametrize("objective", ["fl", "gc", "logdet", "random"])
def test_every_row_is_ranked_once(spark, objective):
    rows = rows_of({"one": 1, "two": 2, "many": 45})
    rows.append(("s", "zero", "fs_opt", 1000, [0.0] * 6))
    rows.append(("s", "zero", "other", 1001, [1.0] * 6))
    got = ordering.order_instances(spark.createDataFrame(rows, SCHEMA), objective)
    ranks = {}
    for r in got.collect():
        ranks.setdefault(r["task_name"], []).append(r["rank"])
    assert {k: sorted(v) for k, v in ranks.items()} == {
        "one": [1],
        "two": [1, 2],
        "many": list(range(1, 46)),
        "zero": [1],
    }


@pytest.mark.parametrize("objective", ["fl", "random"])
def test_partitioning_does_not_matter(spark, objective):
    df = spark.createDataFrame(rows_of({"a": 30, "b": 50}), SCHEMA)
    assert in_order(ordering.order_instances(df.repartition(1), objective)) == in_order(
        ordering.order_instances(df.repartition(13, "row_idx"), objective)
    )


def merged_by_hand(x, idx, objective, size, quota=None):
    chunks = [list(range(s, min(s + size, len(idx)))) for s in range(0, len(idx), size)]
    orders = [[idx[c[0] + j] for j in greedy(x[c], objective, len(c))[0]] for c in chunks]
    merged = []
    for r in range(size):
        merged += [order[r] for order in orders if r < len(order)]
    return merged[:quota]


@pytest.mark.parametrize("objective", ["fl", "gc", "logdet"])
@pytest.mark.parametrize("n", [21, 32])
def test_chunks_keep_all_rows_and_interleave(spark, objective, n):
    rows = rows_of({"small": 9, "large": n})
    df = spark.createDataFrame(rows, SCHEMA)
    got = in_order(ordering.order_instances(df, objective, threshold=20, chunk_rows=16))
    large = [r for r in rows if r[1] == "large"]
    x = np.array([r[4] for r in large], dtype=np.float32)
    idx = [r[3] for r in large]
    assert got["s", "large", "zs_opt"] == merged_by_hand(x, idx, objective, 16)
    whole = in_order(ordering.order_instances(df, objective))
    assert got["s", "small", "zs_opt"] == whole["s", "small", "zs_opt"]


@pytest.mark.parametrize("objective", ["fl", "random"])
@pytest.mark.parametrize("quota", [2, 33, 40])
def test_budget_stops_the_same_ordering(spark, objective, quota):
    df = spark.createDataFrame(rows_of({"large": 41, "unused": 30}), SCHEMA)
    kw = {} if objective == "random" else {"threshold": 20, "chunk_rows": 16}
    whole = in_order(ordering.order_instances(df, objective, **kw))
    quotas = spark.createDataFrame([("s", "large", "zs_opt", quota)], ", ".join(f"{c} string" for c in GROUP_KEY) + ", quota bigint")
    cut = in_order(ordering.order_instances(df, objective, quotas, 1, **kw))
    assert cut == {("s", "large", "zs_opt"): whole["s", "large", "zs_opt"][:quota]}


def test_group_similarity_by_blocks(spark):
    rows = rows_of({"a": 37, "b": 5})
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["row_idx"]: r for r in similarity.group_similarity(df, block_rows=8).collect()}
    for name in ("a", "b"):
        part = [r for r in rows if r[1] == name]
        x = np.array([r[4] for r in part], dtype=np.float32).astype(float)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u @ u.T
        for r, total, positive in zip(part, s.sum(axis=1), np.maximum(s, 0).sum(axis=1)):
            assert abs(got[r[3]]["sim_sum"] - total) < 1e-9
            assert abs(got[r[3]]["positive_sum"] - positive) < 1e-9


@pytest.mark.parametrize("clustered", [True, False])
def test_positive_sums_skip_what_angles_tell(spark, clustered):
    rng = np.random.default_rng(12)
    axes = np.vstack([np.eye(6), -np.eye(6)]) * (10 if clustered else 0)
    x = (axes[rng.integers(0, 12, 400)] + rng.normal(size=(400, 6))).astype(np.float32)
    x[5] = x[6] = 0
    x[8] = x[7]
    rows = [("s", "t", "src", "zs_opt", i, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "submixture string, task_name string, task_source string, template_type string, row_idx bigint, embedding array<float>")
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    wanted = np.maximum(u @ u.T, 0).sum(axis=1)
    got = {r["row_idx"]: r["positive_sum"] for r in similarity.positive_sums(df, block_rows=20).collect()}
    assert len(got) == 400 and all(abs(got[i] - wanted[i]) < 1e-9 for i in got)
    keys = list(GROUP_KEY)
    blocked = similarity.blocks_of(df.select(*keys, "row_idx", "embedding"), keys, 20).where("_pivot >= 0")
    bounds = similarity.block_bounds(blocked, keys, ", ".join(f"{c} string" for c in keys), 7)
    blocks, cells = bounds.agg(F.count_distinct("_block"), F.sum(F.size("_open"))).head()
    if clustered:
        # Opposite axes and the same one are told, right angles are not; those that are told lie in bounds alone.
        assert cells < blocks * blocks
    else:
        assert cells <= blocks * blocks


def test_few_cells_are_left_where_vectors_keep_apart(spark):
    rng = np.random.default_rng(3)
    # Two bundles in opposite directions and wide shells inside them: every pair of blocks is on one side.
    side = np.where(rng.random(600) < 0.5, 1.0, -1.0)
    x = np.column_stack([10 * side, rng.normal(size=(600, 4))])
    rows = [("s", "t", "zs_opt", i, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "submixture string, task_name string, template_type string, row_idx bigint, embedding array<double>")
    keys = list(GROUP_KEY)
    blocked = similarity.blocks_of(df, keys, 20).where("_pivot >= 0")
    bounds = similarity.block_bounds(blocked, keys, ", ".join(f"{c} string" for c in keys))
    blocks, cells = bounds.agg(F.count_distinct("_block"), F.sum(F.size("_open"))).head()
    assert blocks > 20 and cells < blocks * blocks / 3


@pytest.fixture(scope="module")
def profile(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 5))
    x[7] = x[3]
    x[11] = 0.0
    rows = [(f"s{i % 3}", f"t{i:02}", i % 3, i, [float(v) for v in x[i]]) for i in range(90)]
    schema = "submixture string, task_name string, submixture_ord int, first_row bigint, embedding array<double>"
    return spark.createDataFrame(rows, schema).cache()


@pytest.mark.parametrize("objective", ["fl", "gc", "logdet"])
def test_picks_by_jobs_equal_picks_in_one_task(profile, objective, monkeypatch):
    monkeypatch.setattr(exact, "HEADS", 8)

    def names(picks):
        return [(r["task_name"], round(r["gain"], 6)) for r in sorted(picks.collect(), key=lambda r: r["pick"])]

    small = tasks.select_tasks(profile, objective, 9)
    large = tasks.select_tasks(profile, objective, 9, one_task=False)
    assert names(small) == names(large)


def test_too_many_tasks(profile):
    with pytest.raises(ValueError, match="below"):
        tasks.select_tasks(profile, "gc", 90)


@pytest.mark.parametrize("objective", ["fl", "gc", "logdet"])
@pytest.mark.parametrize("heads", [3, 64])
def test_distributed_order_is_the_order_of_one_task(spark, objective, heads, monkeypatch):
    """Ties (equal and zero vectors) included, few and many picks per pass, picks written in between."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 5))
    x[7], x[20], x[30] = x[3], x[3], 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx bigint, embedding array<double>")
    monkeypatch.setattr(exact, "WRITTEN_AT", 9)
    monkeypatch.setattr(facility, "BLOCK_ROWS", 6)
    monkeypatch.setattr(facility, "HEADS", heads)
    monkeypatch.setattr(facility, "BROUGHT", 1 + heads // 32)
    places, gains = greedy(x, objective, 40)
    found = exact.exact_picks(df.repartition(3), objective, 40, heads).orderBy("place").collect()
    assert [r["row_idx"] for r in found] == places.tolist()
    assert np.allclose([r["gain"] for r in found], gains, atol=1e-8)


def test_size_decides_no_result(spark):
    rng = np.random.default_rng(12)
    rows = [("s", f"t{i % 3}", "zs_opt", i, rng.normal(size=4).tolist()) for i in range(60 + 30)]
    schema = "submixture string, task_name string, template_type string, row_idx bigint, embedding array<double>"
    df = spark.createDataFrame(rows, schema)
    quotas = spark.createDataFrame([("s", "t0", "zs_opt", 5), ("s", "t1", "zs_opt", 30)], schema.split(", row_idx")[0] + ", quota bigint")
    for kw in ({}, {"quotas": quotas, "quota_groups": 2}):
        one, apart = (ordering.order_instances(df, "gc", one_task_rows=n, **kw).collect() for n in (1000, 20))
        key = lambda r: (r["task_name"], r["rank"], r["row_idx"], round(r["gain"], 8))
        assert sorted(map(key, one)) == sorted(map(key, apart)) and len(one) == (90 if not kw else 35)


def test_facility_location_commits_many_picks_per_cycle(spark):
    """Clustered rows: disjoint picks are committed together, and are those of the one-task greedy."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 24)) / np.sqrt(24)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx bigint, embedding array<double>")
    places, gains = greedy(x, "fl", 150)
    run = facility.Facility(cluster.stored(df.repartition(4)))
    found = run.picks(150, exact.Picks(spark)).orderBy("place").collect()
    assert [r["row_idx"] for r in found] == places.tolist()
    assert np.allclose([r["gain"] for r in found], gains, atol=1e-8)
    assert run.cycles < 40
    assert all(len(getattr(run, name)) <= facility.BLOCKS for name in ("centres", "radius"))


def test_picks_leave_the_driver(spark, monkeypatch):
    monkeypatch.setattr(exact, "WRITTEN_AT", 16)
    held = []
    add = exact.Picks.add
    monkeypatch.setattr(exact.Picks, "add", lambda self, *a: (add(self, *a), held.append(len(self.open)))[0])
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx bigint, embedding array<double>")
    for objective in ("gc", "logdet"):
        places, _ = greedy(x, objective, 120)
        found = exact.exact_picks(df, objective, 120, 8).orderBy("place").collect()
        assert [r["row_idx"] for r in found] == places.tolist()
    assert max(held) < 16 + 8


@pytest.mark.parametrize("objective", ["gc", "logdet"])
@pytest.mark.parametrize("heads", [40, 400])
def test_large_groups_are_ordered_together(spark, objective, heads, monkeypatch):
    """Picks are made in tasks, in all groups at once: no row of a group comes to the driver, ties and quotas included."""
    monkeypatch.setattr(passes, "SPARE", 2)
    monkeypatch.setattr(ordering, "facility_picks", None)
    rng = np.random.default_rng(14)
    rows, wanted = [], {}
    for name, n, quota in (("a", 60, None), ("b", 41, 9), ("c", 33, 100)):
        x = rng.normal(size=(n, 5))
        x[7], x[20], x[30] = x[3], x[3], 0.0
        rows += [("s", name, "zs_opt", 100 * len(wanted) + i, v.tolist(), quota) for i, v in enumerate(x)]
        places, gains = greedy(x, objective, min(n, quota or n))
        wanted[name] = [(100 * len(wanted) + p, round(g, 7)) for p, g in zip(places.tolist(), gains)]
    schema = "submixture string, task_name string, template_type string, row_idx bigint, embedding array<double>, quota bigint"
    df = cluster.stored(spark.createDataFrame(rows, schema).repartition(3))
    found = {}
    for r in sorted(passes.group_picks(df, objective, part_rows=25, head_rows=heads).collect(), key=lambda r: r["place"]):
        found.setdefault(r["task_name"], []).append((r["row_idx"], round(r["gain"], 7)))
    assert found == wanted
    whole, apart = (in_order(ordering.order_instances(df.drop("quota"), objective, one_task_rows=n)) for n in (100, 20))
    assert whole == apart


@pytest.mark.parametrize("one_task", [200, 1000])
def test_facility_location_orders_blocks_apart_in_tasks(spark, one_task, monkeypatch):
    """Clusters that have come apart need no cycle for every pick; ties and quotas stay as in one task."""
    monkeypatch.setattr(facility, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    centres = np.eye(12)
    x = centres[rng.integers(0, 12, 500)] + 0.02 * rng.normal(size=(500, 12))
    x[77], x[301] = x[5], x[5]
    df = cluster.stored(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx bigint, embedding array<double>").repartition(4))
    places, gains = greedy(x, "fl", 400)
    run = facility.Facility(df, one_task)
    found = run.picks(400, exact.Picks(spark)).orderBy("place").collect()
    assert [r["row_idx"] for r in found] == places.tolist()
    assert np.allclose([r["gain"] for r in found], gains, atol=1e-8)
    assert run.cycles == 0 if one_task == 1000 else 0 < run.cycles < 30, run.cycles


def test_blocks_of_a_large_group_do_not_grow_in_number(spark, monkeypatch):
    """A row is sent to every open block, so few rows per block would send each row to as many cells as the group has rows."""
    rows = rows_of({"a": 600, "b": 7}, seed=5)
    df = spark.createDataFrame(rows, SCHEMA)
    bounds, counts = similarity.block_bounds, []

    def counted(blocked, keys, *a):
        counts.extend(r["n"] for r in blocked.groupBy(*keys).agg(F.count_distinct("_block").alias("n")).collect())
        return bounds(blocked, keys, *a)

    monkeypatch.setattr(similarity, "block_bounds", counted)
    got = {r["row_idx"]: r["positive_sum"] for r in similarity.positive_sums(df, block_rows=2).collect()}
    x = np.array([r[4] for r in rows if r[1] == "a"], dtype=np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = np.maximum(u @ u.T, 0).sum(axis=1)
    assert len(got) == 607 and all(abs(got[r[3]] - w) < 1e-9 for r, w in zip(rows, wanted))
    assert max(counts) <= similarity.PIVOTS + similarity.FULL_BLOCKS


@pytest.mark.parametrize("near_rows", [1, 7, 100])
def test_logdet_picks_among_near_rows_are_the_greedy_ones(near_rows, monkeypatch):
    """What is left aside inside a task is bounded like what parts keep back; ties, zeros and quotas included."""
    monkeypatch.setattr(passes._LogDet, "near_rows", near_rows)
    rng = np.random.default_rng(15)
    x = rng.normal(size=(90, 5))
    x[7], x[20], x[30] = x[3], x[3], 0.0
    x[40:60] = x[39]
    ids = np.arange(90) * 3
    for count in (1, 37, 90):
        places, gains = greedy(x, "logdet", count)
        found, made = passes.sure_picks(passes._LogDet(similarity.unit_rows(x), []), ids, count, -np.inf)
        assert found == (3 * places).tolist() and np.allclose(made, gains, atol=1e-9)
    # The state after the picks is the one a next cycle starts from.
    scored = passes._LogDet(similarity.unit_rows(x), [])
    found, _ = passes.sure_picks(scored, ids, 30, -np.inf)
    u = similarity.unit_rows(x)[np.array(found) // 3]
    assert np.allclose(scored.state().reshape(5, 5), np.linalg.inv(np.eye(5) + u.T @ u))


def test_a_group_of_bounded_bytes_is_ordered_in_one_cycle(spark, monkeypatch):
    """Gains of log-determinant are all alike at first, so a part of the rows would give a pick or two per cycle."""
    rng = np.random.default_rng(16)
    x = rng.normal(size=(18_000, 3))
    rows = spark.createDataFrame([("s", "a", "zs_opt", i, v.tolist(), 30) for i, v in enumerate(x)], SCHEMA.replace("float", "double") + ", quota bigint")
    cycles = []
    best = passes.F.explode
    monkeypatch.setattr(passes.F, "explode", lambda c: (cycles.append(1), best(c))[1])
    found = passes.group_picks(cluster.stored(rows.repartition(4)), "logdet").orderBy("place").collect()
    assert [r["row_idx"] for r in found] == greedy(x, "logdet", 30)[0].tolist()
    assert len(cycles) == 1


def test_few_vectors_come_to_the_driver(spark, monkeypatch):
    """Whatever the number of blocks, a cycle brings no more vectors than bytes allow; the picks stay the greedy ones."""
    monkeypatch.setattr(facility, "BLOCK_ROWS", 6)
    monkeypatch.setattr(facility, "HEADS", 50)
    monkeypatch.setattr(facility, "FRESH_BYTES", 1)
    brought = []
    bring = facility.Facility._brought
    monkeypatch.setattr(facility.Facility, "_brought", lambda self, *a: (found := bring(self, *a), brought.append(len(found[2])))[0])
    rng = np.random.default_rng(17)
    x = rng.normal(size=(120, 5))
    x[7], x[20], x[30] = x[3], x[3], 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx bigint, embedding array<double>")
    places, gains = greedy(x, "fl", 2)
    found = exact.exact_picks(cluster.stored(df.repartition(3)), "fl", 2).orderBy("place").collect()
    assert [r["row_idx"] for r in found] == places.tolist()
    assert np.allclose([r["gain"] for r in found], gains, atol=1e-8)
    assert 0 < max(brought) <= 50


def test_groups_of_much_work_lie_in_tasks_of_their_own(spark, monkeypatch):
    """By bytes or hash, groups whose work grows with the square of their rows would meet in one task."""
    monkeypatch.setattr(ordering, "DEALT_ROWS", 0, raising=False)
    rows = rows_of({f"t{i}": 20 + i for i in range(12)})
    rows += [("s", None, "zs_opt", 1000 + i, r[4]) for i, r in enumerate(rows[:25])]
    got = ordering.order_instances(spark.createDataFrame(rows, SCHEMA), "fl").withColumn("task", F.spark_partition_id())
    tasks_of = {}
    for r in got.collect():
        tasks_of.setdefault(r["task_name"], set()).add(r["task"])
    assert len(tasks_of) == 13 and all(len(t) == 1 for t in tasks_of.values())
    assert len(set.union(*tasks_of.values())) == 13
    # The largest come first.
    assert tasks_of["t11"] == {0}
    quotas = spark.createDataFrame([("s", f"t{i}", "zs_opt", 3 + i) for i in range(12)], ", ".join(f"{c} string" for c in GROUP_KEY) + ", quota bigint")
    cut = in_order(ordering.order_instances(spark.createDataFrame(rows, SCHEMA), "fl", quotas, 12, 40))
    whole = in_order(got)
    assert cut == {("s", f"t{i}", "zs_opt"): whole["s", f"t{i}", "zs_opt"][: 3 + i] for i in range(12)}


def test_groups_beyond_the_limit_share_their_first_gains(spark, monkeypatch):
    """Groups that are work for one task need no blocks and no jobs of their own; ties, quotas, zero rows and a null key included."""
    monkeypatch.setattr(ordering, "facility_picks", None)
    rng = np.random.default_rng(26)
    rows = []
    for k, (name, n) in enumerate((("a", 70), ("b", 41), (None, 33), ("small", 12))):
        x = rng.normal(size=(n, 5))
        x[7], x[9], x[10] = x[3], x[3], 0.0
        rows += [("s", name, "zs_opt", 100 * k + i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    alone, apart = (ordering.order_instances(df, "fl", one_task_rows=n).collect() for n in (1000, 20))
    key = lambda r: (r["task_name"] or "", r["rank"], r["row_idx"], round(r["gain"], 8))
    assert sorted(map(key, apart)) == sorted(map(key, alone)) and len(apart) == 156
    quotas = spark.createDataFrame([("s", "a", "zs_opt", 60), ("s", "b", "zs_opt", 5)], ", ".join(f"{c} string" for c in GROUP_KEY) + ", quota bigint")
    cut = ordering.order_instances(df, "fl", quotas, 2, one_task_rows=20).collect()
    most = {"a": 60, "b": 5}
    assert sorted(map(key, cut)) == sorted(key(r) for r in alone if r["rank"] <= most.get(r["task_name"], 0))


def test_sums_by_grid_send_a_row_to_few_cells(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SIDE", 7)
    rows = rows_of({"a": 101, "b": 5}, seed=8)
    rows.append(("s", "b", "zs_opt", 999, [0.0] * 6))
    df = cluster.stored(spark.createDataFrame(rows, SCHEMA).select("task_name", "row_idx", "embedding"))
    cells = []
    made = similarity._positive_cells
    monkeypatch.setattr(similarity, "_positive_cells", lambda spread, *a: (cells.append(spread.count()), made(spread, *a))[1])
    for block_rows in (30, 1000):
        got = {r["row_idx"]: r["positive_sum"] for r in similarity.grid_sums(df, ["task_name"], block_rows).collect()}
        assert len(got) == 107
        for name in ("a", "b"):
            part = [r for r in rows if r[1] == name]
            x = np.array([r[4] for r in part], dtype=np.float32).astype(float)
            u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            assert all(abs(got[r[3]] - w) < 1e-9 for r, w in zip(part, np.maximum(u @ u.T, 0).sum(axis=1)))
    assert cells == [4 * 101 + 6, 107]
