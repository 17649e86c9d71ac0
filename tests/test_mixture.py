"""The whole plan on small tables, its failures, and what it writes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixloom.cluster import scratch_path, stored
from mixloom.config import GROUP_KEY, TEMPLATE_TYPES, MixtureConfig
from mixloom.operators import checks, ordering, prepare
from mixloom.plans import mixture
from mixloom.sources import artifacts, datasets

SCHEMA = (
    "submixture string, task_name string, task_source string, template_type string, row_idx bigint,"
    " inputs string, targets string, embedding array<float>"
)
NAMES = ("x", "y")


def cfg(tasks, rows, f1="gc", f2="fl", **kw):
    return MixtureConfig(tasks, rows, f1, f2, submixtures=NAMES, **kw)


@pytest.fixture(scope="module")
def instances(spark):
    """The same task name in both submixtures, one hot task, a task with few-shot rows only."""
    rng = np.random.default_rng(4)
    rows = []
    for s in NAMES:
        for i in range(400):
            task = "hot" if i % 3 else ("shared" if i % 2 else "few")
            if task == "few":
                template = ("fs_opt", "fs_noopt")[i % 4 // 2]
            else:
                template = (*TEMPLATE_TYPES, "other")[i % 5]
            v = [float(x) for x in rng.normal(size=4)]
            rows.append((s, task, "src", template, i, f"{s} prompt {i}", f"{s} answer {i}", v))
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


@pytest.mark.parametrize("f1, f2", [("fl", "logdet"), ("gc", "fl"), ("logdet", "random"), ("random", "gc")])
def test_exactly_the_wanted_rows(instances, f1, f2):
    built = mixture.build_mixture(instances, cfg(3, 150, f1, f2))
    train = built.train.collect()
    assert sorted(r["pos"] for r in train) == list(range(150))
    assert len({(r["submixture"], r["row_idx"]) for r in train}) == 150
    assert built.budgets.agg(F.sum("budget")).head()[0] == 150
    assert set(built.train.columns) == {"submixture", "row_idx", "pos", "prompt", "response"}
    for r in train:
        assert r["prompt"] == f"{r['submixture']} prompt {r['row_idx']}"


def test_partitioning_does_not_matter(instances):
    c = cfg(4, 200)
    runs = []
    for n in (1, 9):
        train = mixture.build_mixture(instances.repartition(n), c).train
        runs.append(sorted((r["pos"], r["submixture"], r["row_idx"]) for r in train.collect()))
    assert runs[0] == runs[1]


def test_vectors_may_come_apart_from_texts(instances):
    c = cfg(3, 120)
    vectors = instances.select(*GROUP_KEY, "row_idx", "embedding")
    texts = instances.drop("embedding", "template_type")
    apart = mixture.build_mixture(texts, c, vectors=vectors).train
    both = mixture.build_mixture(instances, c).train
    assert sorted(map(tuple, apart.select("pos", "prompt").collect())) == sorted(
        map(tuple, both.select("pos", "prompt").collect())
    )


def test_chunks_do_not_lose_rows(instances):
    built = mixture.build_mixture(instances, cfg(3, 150, chunk_threshold=20, chunk_rows=16))
    assert built.train.count() == 150


def test_all_rows_of_the_picked_tasks(instances):
    c = cfg(5, 1)
    profile = mixture.profile_of(instances, c)
    names = mixture.group_budgets(profile, c).tasks.select("submixture", "task_name")
    total = profile.join(names, ["submixture", "task_name"]).agg(F.sum("total")).head()[0]
    assert mixture.build_mixture(instances, cfg(5, total)).train.count() == total
    with pytest.raises(ValueError, match="hold"):
        mixture.build_mixture(instances, cfg(5, total + 1))


def test_settings_are_checked(instances):
    with pytest.raises(ValueError, match="objective"):
        MixtureConfig(3, 10, "best", "fl")
    with pytest.raises(ValueError):
        MixtureConfig(0, 10)
    with pytest.raises(ValueError, match="below"):
        mixture.build_mixture(instances, cfg(6, 10))
    with pytest.raises(ValueError, match="missing columns: targets"):
        mixture.build_mixture(instances.drop("targets"), cfg(3, 10))
    with pytest.raises(ValueError, match="num_tasks"):
        checks.validate(instances, cfg(6, 10))
    assert checks.validate(instances, cfg(5, 10)) is instances


def test_null_keys_are_reported(spark, instances):
    broken = instances.withColumn("task_name", F.when(F.col("row_idx") != 3, F.col("task_name")))
    found = {r["rule"]: r["violations"] for r in checks.violations(broken, cfg(3, 10)).collect()}
    assert found["null_task_name"] == 2


def test_sweep_equals_single_runs(instances):
    grid = [cfg(m, n, f1, f2) for m, n in ((2, 40), (4, 150)) for f1, f2 in (("fl", "random"), ("random", "gc"))]
    swept = {}
    for r in mixture.sweep(instances, grid).collect():
        swept.setdefault(r["config_id"], set()).add((r["submixture"], r["row_idx"]))
    for i, c in enumerate(grid):
        rows = mixture.build_mixture(instances, c).rows.collect()
        assert swept[i] == {(r["submixture"], r["row_idx"]) for r in rows}


def test_a_loaded_ordering_gives_the_same_mixture(spark, instances):
    root = scratch_path(spark, "orderings")
    c = cfg(3, 120, "gc", "logdet")
    artifacts.write_ordering(ordering.order_instances(instances, "logdet"), "logdet", root)
    groups = prepare.known_templates(instances).select(*GROUP_KEY).distinct()
    loaded = artifacts.load_ordering(spark, "logdet", root, NAMES, groups)
    keys = [
        {(r["submixture"], r["row_idx"]) for r in mixture.build_mixture(instances, c, ordering=o).rows.collect()}
        for o in (loaded, None)
    ]
    assert keys[0] == keys[1]


def test_a_missing_ordering_is_an_error(spark, instances):
    root = scratch_path(spark, "orderings")
    with pytest.raises(FileNotFoundError):
        artifacts.load_ordering(spark, "gc", root, NAMES)
    part = ordering.order_instances(instances.where("submixture = 'x'"), "random")
    artifacts.write_ordering(part, "random", root)
    with pytest.raises(FileNotFoundError, match="y"):
        artifacts.load_ordering(spark, "random", root, NAMES)
    groups = spark.createDataFrame([("x", "lost", "zs_opt")], ", ".join(f"{c} string" for c in GROUP_KEY))
    with pytest.raises(FileNotFoundError, match="lost"):
        artifacts.load_ordering(spark, "random", root, ["x"], groups)


def test_stage_is_rebuilt_until_complete(spark, instances):
    root = scratch_path(spark, "stages")
    built = []

    def build(df):
        built.append(1)
        return prepare.task_totals(df)

    one = artifacts.stage(spark, "totals", lambda: build(instances.where("submixture = 'x'")), root, NAMES)
    assert len(built) == 1 and one.select("submixture").distinct().count() == 1
    both = artifacts.stage(spark, "totals", lambda: build(instances), root, NAMES)
    artifacts.stage(spark, "totals", lambda: build(instances), root, NAMES)
    assert len(built) == 2 and both.select("submixture").distinct().count() == 2


def test_written_mixture_is_a_prepared_dataset(spark, instances):
    root = scratch_path(spark, "mixture")
    c = cfg(3, 100)
    held_out = instances.where("row_idx < 5")
    built = mixture.build_mixture(instances, c, held_out)
    path = artifacts.write_mixture(built.train, built.validation, root, c)
    assert path.endswith("4096-3-tasks-gc-100-instances-fl")
    splits = datasets.load_instruction_dataset(spark, path)
    assert splits["train"].count() == 100 and splits["validation"].count() == held_out.count()
    with pytest.raises(Exception):
        datasets.load_instruction_dataset(spark, root)


def test_a_sweep_writes_what_its_settings_build_alone(spark, instances):
    root = scratch_path(spark, "sweep")
    grid = [cfg(3, 100), cfg(2, 60, "random", "gc", shuffle_seed=5), cfg(3, 100, task_seed=4), cfg(4, 150, "fl", "random")]
    assert artifacts.dataset_names(grid)[2] == f"{grid[2].name}-2"
    # Columns that clash with those of the datasets.
    wide = instances.withColumns({"taken": F.lit(1), "split": F.lit("old"), "mixture": F.lit(2)})
    held_out = wide.where("row_idx < 5")
    built = mixture.build_sweep(wide, grid, held_out)
    paths = artifacts.write_mixtures(built.train, built.validation, root, grid)
    for c, path in zip(grid, paths):
        splits = datasets.load_instruction_dataset(spark, path)
        alone = mixture.build_mixture(instances, c).train
        got, wanted = (sorted((r["pos"], r["submixture"], r["row_idx"], r["prompt"]) for r in t.collect()) for t in (splits["train"], alone))
        assert got == wanted and splits["validation"].count() == held_out.count()
    # Written again without validation rows: both splits are there, and other datasets stay.
    again = mixture.build_sweep(instances, grid[:1], instances.limit(0))
    first = artifacts.write_mixtures(again.train, again.validation, root, grid[:1])
    assert datasets.load_instruction_dataset(spark, first[0])["validation"].count() == 0
    assert datasets.load_instruction_dataset(spark, paths[1])["validation"].count() == held_out.count()


def test_a_sweep_reads_texts_once_and_keeps_the_order_of_files(spark, instances, monkeypatch):
    root = scratch_path(spark, "sweep")
    instances.write.parquet(f"{root}/in")
    rows = spark.read.parquet(f"{root}/in")
    grid = [cfg(3, 100, "random", "random"), cfg(4, 150, "random", "random", ordering_seed=3)]
    built = mixture.build_sweep(rows, grid, rows.where("row_idx < 3"))
    plan = built.train._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    monkeypatch.setattr(artifacts, "FILE_ROWS", 30)
    paths = artifacts.write_mixtures(built.train, built.validation, f"{root}/out", grid)
    for c, path in zip(grid, paths):
        train = spark.read.parquet(f"{path}/split=train").select("pos", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
        files = {}
        for r in sorted(train.collect(), key=lambda r: (r["file"], r["at"])):
            files.setdefault(r["file"], []).append(r["pos"])
        assert [p for f in sorted(files) for p in files[f]] == list(range(c.num_instances))
        assert max(map(len, files.values())) <= 30


def test_a_sweep_refuses_a_setting_that_cannot_be_met(instances):
    with pytest.raises(ValueError, match="fewer rows"):
        mixture.build_sweep(instances, [cfg(3, 100), cfg(1, 5000)])
    doubled = instances.unionByName(instances.where("row_idx < 200"))
    with pytest.raises(ValueError, match="keys instead of"):
        mixture.build_sweep(doubled, [cfg(5, 600, "random", "random")])
    with pytest.raises(Exception, match="null targets"):
        bad = instances.withColumn("targets", F.lit(None).cast("string"))
        mixture.build_sweep(bad, [cfg(3, 100, "random", "random")]).train.collect()


def test_file_positions_are_dense(spark, instances):
    root = scratch_path(spark, "sources")
    paths = {s: f"{root}/{s}" for s in NAMES}
    for s, path in paths.items():
        part = instances.where(F.col("submixture") == s).withColumnRenamed("row_idx", "id").drop("submixture")
        part.repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path)
    loaded = datasets.load_submixtures(spark, paths)
    assert loaded.where("row_idx <> id").count() == 0
    assert loaded.count() == instances.count()
    as_json = f"{root}/json"
    instances.drop("embedding").write.json(as_json)
    assert datasets.load_submixtures(spark, {"j": as_json}, fmt="json").count() == instances.count()


@pytest.mark.parametrize("kind", ["equal", "proportional"])
def test_baselines(instances, kind):
    rows = mixture.baseline_mixture(instances, kind, cfg(3, 180))
    assert rows.count() == 180 and rows.distinct().count() == 180
    counts = [r["count"] for r in rows.groupBy("submixture", "task_name").count().collect()]
    if kind == "equal":
        assert max(counts) - min(counts) <= 1
