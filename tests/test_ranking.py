"""Positions and prefixes of skewed groups, under any partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from mixloom.functions.columns import seeded_digest
from mixloom.operators import prepare, ranking


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 40)}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, row_idx bigint").repartition(7)
    return df.withColumn("digest", seeded_digest(1, "row_idx")).cache()


def expected(df, order):
    rows = sorted(df.collect(), key=lambda r: tuple(r[c] for c in order))
    seen, place = {}, {}
    for r in rows:
        place[r["g"], r["row_idx"]] = seen.setdefault(r["g"], 0)
        seen[r["g"]] += 1
    return place


def test_positions_by_digest(skewed):
    got = ranking.positions(skewed, ["g"], ranking.digest_bucket("digest"), ["digest", "row_idx"])
    want = expected(skewed, ["digest", "row_idx"])
    assert {(r["g"], r["row_idx"]): r["pos"] for r in got.collect()} == want


def test_positions_by_index_over_many_buckets(skewed, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 17)
    got = ranking.positions(skewed, ["g"], ranking.index_bucket(), ["row_idx"])
    assert {(r["g"], r["row_idx"]): r["pos"] for r in got.collect()} == expected(skewed, ["row_idx"])


def test_positions_without_groups(skewed):
    got = ranking.positions(skewed, [], ranking.digest_bucket("digest"), ["digest", "row_idx"])
    assert sorted(r["pos"] for r in got.collect()) == list(range(6000))


def test_leading_rows(spark, skewed):
    want = expected(skewed, ["digest", "row_idx"])
    sizes = {}
    for g, _ in want:
        sizes[g] = sizes.get(g, 0) + 1
    rng = random.Random(6)
    quota = {g: rng.choice([1, n // 2 or 1, n, n + 9]) for g, n in sizes.items() if rng.random() < 0.8}
    quota["hot"] = 1234
    quotas = spark.createDataFrame(list(quota.items()), "g string, quota bigint")
    got = ranking.leading_rows(
        skewed, quotas, ["g"], ranking.digest_bucket("digest"), ["digest", "row_idx"], len(quota)
    )
    keys = {(r["g"], r["row_idx"]) for r in got.collect()}
    assert keys == {k for k, place in want.items() if k[0] in quota and place < quota[k[0]]}


@pytest.mark.parametrize("kind", ["int", "double", "string", "date", "timestamp"])
def test_row_idx_along_any_type(spark, kind):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else "cold", i, rng.randint(0, 50) ** 4) for i in range(2000)]
    df = spark.createDataFrame(rows, "submixture string, id bigint, v bigint")
    key = {
        "int": F.col("v"),
        "double": F.col("v") / 7.0 - 1e6,
        "string": F.concat(F.lit("common "), F.col("v").cast("string")),
        "date": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("v") % 900).cast("int")),
        "timestamp": F.timestamp_seconds("v"),
    }[kind]
    df = df.withColumn("k", key)
    got = prepare.with_row_idx(df.repartition(5), ["k", "id"]).collect()
    for name in ("hot", "cold"):
        part = sorted((r for r in got if r["submixture"] == name), key=lambda r: (r["k"], r["id"]))
        assert [r["row_idx"] for r in part] == list(range(len(part)))


@pytest.mark.parametrize("kind", ["int", "string"])
def test_row_idx_with_one_value_on_a_third_of_the_rows(spark, kind):
    rng = random.Random(8)
    rows = [("s", i, 5 if i % 3 == 0 else rng.randint(0, 9) * rng.randint(1, 400)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "submixture string, id bigint, v bigint")
    df = df.withColumn("k", F.col("v") if kind == "int" else F.format_string("text %05d", "v"))
    got = sorted(prepare.with_row_idx(df, ["k", "id"]).collect(), key=lambda r: (r["k"], r["id"]))
    assert [r["row_idx"] for r in got] == list(range(3000))
    plan = prepare.with_row_idx(df, ["k", "id"])
    assert plan.columns == ["submixture", "id", "v", "k", "row_idx"]


def test_no_window_over_a_whole_group(skewed):
    """Windows partition by group and bucket; only counts are summed per group."""
    placed = ranking.positions(skewed, ["g"], ranking.digest_bucket("digest"), ["digest", "row_idx"])
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(g#" in plan and "_bucket#" in plan
    for line in plan.splitlines():
        if "row_number()" in line and "Window" in line:
            assert "_bucket#" in line.split("windowspecdefinition", 1)[1].split("specifiedwindowframe")[0]


@pytest.mark.parametrize("kind", ["sparse", "url"])
def test_positions_spread_whatever_the_distribution(spark, kind):
    """Hashed ids and strings with a long common prefix: every task gets about its share."""
    df = spark.range(4000).select(F.xxhash64("id").alias("h"))
    key = F.col("h") if kind == "sparse" else F.concat(F.lit("https://example.org/a/very/long/path/"), F.hex("h"))
    df = df.select(key.alias("k"))
    dealt = df.repartitionByRange(8, "k")
    shares = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(shares) > 4 and max(shares) < 3 * 4000 / len(shares)
    got = sorted(ranking.range_positions(df, [], ["k"]).collect(), key=lambda r: r["k"])
    assert [r["pos"] for r in got] == list(range(4000))


def test_positions_of_an_empty_frame(spark):
    assert ranking.range_positions(spark.range(0), [], ["id"]).count() == 0
