"""Inputs that must fail or be numbered right: null and ragged vectors, split columns, mixed settings, folders."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixloom import MixtureConfig, cluster
from mixloom.operators import checks, exact, selection, similarity
from mixloom.plans import mixture
from mixloom.sources import artifacts, datasets


def lists(rows):
    return pa.chunked_array([pa.array(rows, pa.list_(pa.float64()))])


@pytest.mark.parametrize("bad", [None, [1.0, 2.0], [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, None, 3.0, 4.0], []])
def test_vectors_are_never_shifted(bad):
    good = [[1.0, 0.0, 0.0, 0.0]] * 3
    keys = pa.chunked_array([pa.array([10, 11, 12, 13])])
    with pytest.raises(ValueError, match="12"):
        similarity.matrix(lists(good[:2] + [bad] + good[2:]), keys)
    assert similarity.matrix(lists(good)).shape == (3, 4)


def test_positions_with_split_as_a_column(spark, tmp_path):
    for f in range(3):
        rows = [(f * 100 + i, "validation" if i % 3 == 0 else "train") for i in range(40 if f else 7)]
        spark.createDataFrame(rows, "doc bigint, split string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
    for split in ("train", "validation", None):
        got = datasets.load_submixtures(spark, {"a": f"{tmp_path}/a"}, split=split).collect()
        assert sorted(r["row_idx"] for r in got) == list(range(len(got))) and len(got) > 20
        per_file = {}
        for r in sorted(got, key=lambda r: r["row_idx"]):
            per_file.setdefault(r["doc"] // 100, []).append(r["doc"])
        assert all(docs == sorted(docs) for docs in per_file.values())


@pytest.fixture(scope="module")
def instances(spark):
    rng = np.random.default_rng(3)
    rows = [
        ("t0", f"task{i % 7}", "zs_opt" if i % 2 else "fs_noopt", i, f"in {i}", f"out {i}", rng.normal(size=4).tolist())
        for i in range(140)
    ]
    schema = "submixture string, task_name string, template_type string, row_idx bigint, inputs string, targets string"
    return spark.createDataFrame(rows, schema + ", embedding array<double>").cache()


def test_settings_of_a_sweep_stay_their_own(instances):
    base = {"num_tasks": 4, "num_instances": 30, "submixtures": ("t0",)}
    grid = [
        MixtureConfig(task_objective="random", instance_objective="random", **base),
        MixtureConfig(
            task_objective="random", instance_objective="random", task_seed=4, ordering_seed=9, taylor_order=4,
            temperature=3.0, **base,
        ),
        MixtureConfig(task_objective="gc", instance_objective="random", ordering_seed=5, temperature=0.5, **base),
    ]
    got = mixture.sweep(instances, grid).collect()
    for i, cfg in enumerate(grid):
        alone = mixture.build_mixture(instances, cfg).rows.collect()
        assert sorted(r["row_idx"] for r in got if r["config_id"] == i) == sorted(r["row_idx"] for r in alone)
    with pytest.raises(ValueError):
        mixture.sweep(instances, [])
    with pytest.raises(ValueError):
        mixture.sweep(instances, [grid[0], MixtureConfig(4, 30, submixtures=("t0", "cot"))])


def test_violations_name_nulls_widths_and_repeats(spark, instances):
    odd = instances.limit(1).withColumns({"inputs": F.lit(None).cast("string"), "embedding": F.lit(None).cast("array<double>")})
    short = instances.limit(1).withColumn("row_idx", F.lit(999).cast("bigint")).withColumn("embedding", F.array(F.lit(1.0)))
    found = checks.violations(instances.unionByName(odd).unionByName(short), MixtureConfig(4, 30))
    rules = {r["rule"]: r["violations"] for r in found.collect()}
    assert rules["null_inputs"] == rules["null_embedding"] == rules["ragged_embedding"] == rules["repeated_row"] == 1
    assert rules["null_targets"] == rules["null_row_idx"] == 0


@pytest.mark.parametrize("column", ["inputs", "embedding"])
def test_a_null_stops_the_mixture(instances, column):
    kind = dict(instances.dtypes)[column]
    value = F.when(F.col("row_idx") % 5 == 0, F.lit(None).cast(kind)).otherwise(F.col(column))
    cfg = MixtureConfig(5, 90, "gc", "fl", submixtures=("t0",))
    with pytest.raises(Exception, match=f"null {column}|embeddings must be whole"):
        mixture.build_mixture(instances.withColumn(column, value), cfg).train.collect()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cluster.shared_dir(Session())


def test_values_that_are_no_numbers_are_named(spark, instances):
    for value in ("NaN", "Infinity"):
        wrong = F.array(*[F.lit(float(value))] * 4)
        odd = instances.withColumn("embedding", F.when(F.col("row_idx") == 3, wrong).otherwise(F.col("embedding")))
        rules = {r["rule"]: r["violations"] for r in checks.violations(odd, MixtureConfig(4, 30)).collect()}
        assert rules["not_finite_embedding"] == 1
    x = pa.chunked_array([pa.array([[1.0, 2.0], [float("nan"), 1.0], [1.0, float("inf")]])])
    with pytest.raises(ValueError, match=r"finite; 2 are not.*\[8, 9\]"):
        similarity.matrix(x, pa.chunked_array([pa.array([7, 8, 9])]))
    rows = spark.createDataFrame([(i, [1.0, float(i) if i != 4 else float("nan")]) for i in range(6)], "row_idx bigint, embedding array<double>")
    with pytest.raises(Exception, match="finite"):
        exact.exact_picks(rows, "gc", 6).collect()


def test_split_columns_are_numbered_without_a_text_shuffle(spark, tmp_path):
    rows = spark.range(5000).select(
        F.col("id").alias("doc"), F.md5(F.col("id").cast("string")).alias("inputs"), F.when(F.col("id") % 7 == 0, "b").otherwise("a").alias("split")
    )
    rows.repartitionByRange(3, "doc").sortWithinPartitions("doc").write.option("parquet.block.size", 20_000).parquet(f"{tmp_path}/x")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        loaded = datasets.load_submixtures(spark, {"x": f"{tmp_path}/x"}, split="a")
        plan = loaded._jdf.queryExecution().executedPlan().toString()
        got = {r["doc"]: r["row_idx"] for r in loaded.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = [i for i in range(5000) if i % 7]
    assert got == {doc: place for place, doc in enumerate(wanted)}
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_many_picks_are_filtered_at_the_scan(spark, monkeypatch):
    rows = spark.range(-200, 90_000).select(
        (F.when(F.col("id") % 2 == 0, "s").otherwise("t")).alias("submixture"), F.col("id").alias("row_idx"), F.md5(F.col("id").cast("string")).alias("inputs"),
        F.lit("y").alias("targets"),
    )
    picks = rows.where(F.pmod(F.xxhash64("row_idx"), F.lit(50)) == 0).select("submixture", "row_idx")
    wanted = sorted(map(tuple, picks.collect()))
    monkeypatch.setattr(selection, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(cluster.small, "__defaults__", (None, 10))
    for limit in (selection.BITMAPS_LIMIT, 1000):
        monkeypatch.setattr(selection.only_picked, "__defaults__", (limit,))
        found = selection.select_rows(rows, picks)
        assert sorted((r["submixture"], r["row_idx"]) for r in found.collect()) == wanted
        train = selection.train_split(rows, picks, picks_bound=2_000_000)
        assert sorted((r["submixture"], r["row_idx"]) for r in train.collect()) == wanted
        plan = train._jdf.queryExecution().executedPlan().toString()
        assert ("getbit" in plan.lower() or "bit_get" in plan.lower()) == (limit > 1000)
    same = selection.only_picked(rows, picks, selection.BITMAPS_LIMIT)
    assert sorted((r["submixture"], r["row_idx"]) for r in same.collect()) == wanted


def test_stages_are_reused_only_when_complete(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "submixture string, n bigint")
    calls = []

    def build(frame=rows):
        calls.append(1)
        return frame

    def run(inputs="1", frame=rows, names=("a", "b", "none")):
        made = artifacts.stage(spark, "st", lambda: build(frame), str(tmp_path), names, inputs)
        return sorted((r["submixture"], r["n"]) for r in made.collect())

    assert run() == run() == [("a", 1), ("a", 2), ("b", 3)] and len(calls) == 1
    assert run(inputs="2") and len(calls) == 2
    assert run(inputs="2", names=("a", "new")) and len(calls) == 3

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        artifacts.stage(spark, "st", broken, str(tmp_path), ("a",), "3")
    assert run(inputs="2", names=("a",)) and len(calls) == 4  # an interrupted stage is not complete
    assert run(inputs="4", frame=rows.limit(0)) == run(inputs="4") == [] and len(calls) == 5
    one, two = (artifacts.fingerprint(f) for f in (rows, rows.repartition(3)))
    assert one == two != artifacts.fingerprint(rows.where("n < 3"))


def test_queries_remain_without_optional_libraries():
    code = (
        "import sys, warnings; warnings.simplefilter('ignore')\n"
        "for name in ('ahocorasick', 'public_tokenizers', 'xxhash'): sys.modules[name] = None\n"
        "import __spark_entry__ as e; print(len(e.queries()), e.llm)"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.split()[-1] == "None" and int(said.stdout.split()[0]) >= 89, said.stderr


def test_written_sources_have_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    """More documents are more files, with the same row numbers."""
    import __spark_entry__ as entry

    docs = [(i, ("en", "de", "fr", "es")[i % 4], f"s{i % 3}", f"text {i}") for i in range(400)]
    schema = "doc_id bigint, lang string, source string, text string"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    dealt = []
    by_range = type(spark.range(1)).repartitionByRange
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *c: (dealt.append(n), by_range(self, n, *c))[1])
    found = {}
    for rows in (25_000, 20):
        monkeypatch.setattr(entry, "FILE_ROWS", rows)
        for name in ("load_submixtures_split_column", "load_submixtures"):
            found[name, rows] = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))
    assert [n for n in dealt if isinstance(n, int)] and max(n for n in dealt if isinstance(n, int)) == 20
    for name in ("load_submixtures_split_column", "load_submixtures"):
        assert found[name, 25_000] == found[name, 20] and len(found[name, 20]) == 360
