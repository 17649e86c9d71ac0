
from __future__ import annotations

import os
import sys
import warnings
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import registered_sql
from mixloom.cluster import scratch_path, spread, stored
from mixloom.config import GROUP_KEY, SHUFFLE_SEED, SUBMIXTURES, TASK_KEY, TEMPLATE_TYPES, MixtureConfig
from mixloom.operators import budgets as bud
from mixloom.operators import checks, metrics, ordering, prepare, selection, similarity, tasks, tuning
from mixloom.operators.embed import embed
from mixloom.plans import mixture, training
from mixloom.sources import artifacts, datasets, samples

try:
    from mixloom.llm import registry as llm
except ImportError as missing:
    # Without the optional subpackage, or a library that only it needs, the other queries remain.
    if not (missing.name or "").startswith(("mixloom.llm", "corpus_pipeline")):
        warnings.warn(f"queries of mixloom.llm are left out: {missing}", stacklevel=1)
    llm = None

NUM_TASKS = 6
NUM_INSTANCES = 250
DOCUMENT_TASKS = 24
DOCUMENT_ROWS = 80
MAX_LEN = 512
SHORT_LEN = 64
# Rows of a file where a query writes documents to read them back.
FILE_ROWS = 25_000
# Groups above this are ordered by distributed passes, to compare that path as well.
DISTRIBUTED_ABOVE = 49
TRAIN_RUN = {"batch_size": 4, "devices": 2, "accumulation": 4, "epochs": 2, "seed": 23}


def config(f1: str, f2: str, **kw) -> MixtureConfig:
    return MixtureConfig(NUM_TASKS, NUM_INSTANCES, f1, f2, **kw)


def document_config(f1: str, f2: str) -> MixtureConfig:
    return MixtureConfig(DOCUMENT_TASKS, DOCUMENT_ROWS, f1, f2, submixtures=samples.DOCUMENT_SUBMIXTURES)


def entry(spark: SparkSession) -> DataFrame:
    """Default objectives (graph cut over tasks, facility location over rows) on the sample vectors."""
    return mixture_gc_fl(spark, "/root/testdata/sf0.001")


# Inputs -----------------------------------------------------------------------------------------


def instances(spark, sf):
    return samples.vector_instances(spark, sf)


def profile(spark, sf, vectors=True):
    return stored(prepare.task_profile(instances(spark, sf), vectors=vectors))


def train_pairs(spark, sf):
    return prepare.as_pairs(prepare.strip_metadata(samples.conversation_pairs(spark, sf, validation=False)))


def rounded(*columns):
    return [F.round(c, 6).alias(c) for c in columns]


def joined(column):
    return F.concat_ws(",", F.col(column).cast("array<string>")).alias(column)


# Sources and sinks ------------------------------------------------------------------------------


def load_submixtures(spark, sf):
    root = scratch_path(spark, "submixtures")
    paths = {}
    for lang in samples.DOCUMENT_SUBMIXTURES:
        paths[lang] = f"{root}/{lang}"
        part = samples.document_instances(spark, sf).where(F.col("submixture") == lang)
        part = part.withColumnRenamed("row_idx", "doc_id").drop("submixture")
        part = part.withColumn("split", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train"))
        parts = max(4, -(-part.count() // FILE_ROWS))
        # The writer sorts by split: an order that begins with it stays, any other is lost.
        part = part.repartitionByRange(parts, "doc_id").sortWithinPartitions("split", "doc_id")
        part.write.partitionBy("split").parquet(paths[lang])
    loaded = datasets.load_submixtures(spark, paths, split="train")
    return loaded.select("submixture", "row_idx", "doc_id", "task_name", F.md5("inputs").alias("digest"))


def load_submixtures_split_column(spark, sf):
    """The split is a column inside the files, so files are kept in part."""
    root = scratch_path(spark, "split_column")
    docs = samples.document_instances(spark, sf).withColumnRenamed("row_idx", "doc_id")
    split = F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train")
    # A file has so many rows at most, so what one task reads does not grow with the input.
    parts = max(3, -(-docs.count() // FILE_ROWS))
    docs = docs.withColumn("split", split).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    docs.drop("submixture").write.parquet(f"{root}/all")
    loaded = datasets.load_submixtures(spark, {"all": f"{root}/all"}, split="train")
    return loaded.select("submixture", "row_idx", "doc_id", "task_name", F.md5("inputs").alias("digest"))


def load_instruction_dataset(spark, sf):
    root = scratch_path(spark, "dataset")
    train = train_pairs(spark, sf).withColumn("pos", F.col("row_idx"))
    held_out = selection.validation_split(samples.conversation_pairs(spark, sf, validation=True))
    path = artifacts.write_mixture(train, held_out, root, config("random", "random"))
    splits = datasets.load_instruction_dataset(spark, path)
    return selection.assemble(
        rows.select(F.lit(name).alias("split"), "conv_id", "turn", "prompt", "response")
        for name, rows in splits.items()
    )


def stage_reuse(spark, sf):
    root = scratch_path(spark, "stages")

    def never():
        raise AssertionError("a complete stage must not be built again")

    # One submixture has no rows; it is complete all the same.
    declared = (*SUBMIXTURES, "empty")
    made_of = artifacts.fingerprint(instances(spark, sf).select(*GROUP_KEY, "row_idx"))
    artifacts.stage(spark, "task_index", lambda: prepare.task_index(instances(spark, sf)), root, declared, made_of)
    index = artifacts.stage(spark, "task_index", never, root, declared, made_of)
    return index.select(*GROUP_KEY, "row_idx", "place")


def written_ordering(spark, sf):
    root = scratch_path(spark, "ordering")
    rows = instances(spark, sf)
    artifacts.write_ordering(ordering.order_instances(rows, "random"), "random", root)
    return artifacts.load_ordering(spark, "random", root).select(*GROUP_KEY, "rank", "row_idx", "gain")


def loaded_ordering(spark, sf):
    root = scratch_path(spark, "ordering")
    rows = instances(spark, sf)
    artifacts.write_ordering(ordering.order_instances(rows, "gc"), "gc", root)
    groups = prepare.known_templates(rows).select(*GROUP_KEY).distinct()
    loaded = artifacts.load_ordering(spark, "gc", root, SUBMIXTURES, groups)
    return loaded.select(*GROUP_KEY, "rank", "row_idx", *rounded("gain"))


def written_mixture(spark, sf):
    root = scratch_path(spark, "mixture")
    cfg = config("random", "random")
    held_out = samples.conversation_pairs(spark, sf, validation=True)
    built = mixture.build_mixture(instances(spark, sf), cfg, held_out)
    path = artifacts.write_mixture(built.train, built.validation, root, cfg)
    train = spark.read.parquet(f"{path}/split=train").select("pos", "submixture", "row_idx", "prompt", "response")
    held_out = spark.read.parquet(f"{path}/split=validation").select("submixture", "row_idx", "prompt", "response")
    return selection.assemble(
        rows.withColumns({"split": F.lit(name), "pos": F.col("pos").cast("bigint")})
        for name, rows in (("train", train), ("validation", held_out.withColumn("pos", F.lit(None))))
    )


def written_metrics(spark, sf):
    losses = samples.batch_losses(spark, sf)
    scored = metrics.eval_metrics(losses).join(metrics.train_loss(losses), "epoch")
    path = artifacts.write_metrics(scored, scratch_path(spark, "metrics"))
    schema = "epoch bigint, eval_loss double, perplexity double, train_loss double"
    back = spark.read.schema(schema).json(path)
    return back.select("epoch", *rounded("eval_loss", "perplexity", "train_loss"))


# Preparation ------------------------------------------------------------------------------------


def input_violations(spark, sf):
    return checks.violations(instances(spark, sf), MixtureConfig(10, NUM_INSTANCES))


def known_templates(spark, sf):
    return prepare.known_templates(instances(spark, sf)).select(*GROUP_KEY, "row_idx")


def decoded_labels(spark, sf):
    rows = instances(spark, sf)
    names = rows.select("submixture", F.col("task_label").alias("label"), F.col("task_name").alias("name"))
    coded = rows.select("submixture", "row_idx", "task_label")
    return prepare.decode_labels(coded, stored(names.distinct())).select("submixture", "row_idx", "task_name")


def row_positions(spark, sf):
    docs = samples.document_instances(spark, sf).withColumnRenamed("row_idx", "doc_id")
    return prepare.with_row_idx(docs, ["doc_id"]).select("submixture", "doc_id", "row_idx")


def row_positions_by_text(spark, sf):
    docs = samples.document_instances(spark, sf).withColumnRenamed("row_idx", "doc_id")
    docs = docs.withColumn("digest", F.md5("inputs"))
    return prepare.with_row_idx(docs, ["digest", "doc_id"]).select("submixture", "doc_id", "row_idx")


def stripped_metadata(spark, sf):
    rows = samples.document_instances(spark, sf)
    return prepare.strip_metadata(rows).select("submixture", "row_idx", "inputs", "targets")


def renamed_pairs(spark, sf):
    return prepare.as_pairs(samples.document_instances(spark, sf)).select(
        "submixture", "row_idx", "prompt", "response"
    )


# Joins and similarity ---------------------------------------------------------------------------


def selected_rows(spark, sf):
    docs = samples.document_instances(spark, sf)
    picks = instances(spark, sf).select("row_idx").join(docs, "row_idx")
    return selection.select_rows(docs, picks).select("submixture", "row_idx", F.md5("inputs").alias("digest"))


def attached_embeddings(spark, sf):
    rows = instances(spark, sf)
    index = prepare.task_index(rows)
    vectors = rows.select("submixture", "row_idx", "embedding")
    found = prepare.with_embeddings(index, vectors)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v)
    return found.select(
        *GROUP_KEY, "row_idx", F.size("embedding").alias("width"), F.round(total, 6).alias("total")
    )


def cosine_kernel(spark, sf):
    rows = instances(spark, sf)
    placed = prepare.task_embeddings(rows).join(prepare.task_positions(rows), list(TASK_KEY))
    return similarity.cosine_pairs(stored(placed), block_rows=4).select("i", "j", *rounded("s"))


def group_similarity(spark, sf):
    result = similarity.group_similarity(instances(spark, sf), block_rows=16)
    return result.select(*GROUP_KEY, "row_idx", *rounded("sim_sum", "positive_sum"))


def zero_filled_budgets(spark, sf):
    prof = profile(spark, sf, vectors=False)
    picks = tasks.random_tasks(prof, NUM_TASKS)
    given = bud.task_budgets(picks, prof, NUM_INSTANCES, picks_bound=NUM_TASKS)
    return bud.zero_fill(prof.select(*TASK_KEY), given, NUM_TASKS)


# Aggregations -----------------------------------------------------------------------------------


def task_index(spark, sf):
    return prepare.task_index(instances(spark, sf))


def task_totals(spark, sf):
    return prepare.task_totals(instances(spark, sf))


def template_counts(spark, sf):
    return prepare.template_counts(instances(spark, sf))


def task_embeddings(spark, sf):
    means = prepare.task_embeddings(instances(spark, sf))
    long = means.select(*TASK_KEY, F.posexplode("embedding").alias("dim", "value"))
    return long.select(*TASK_KEY, "dim", *rounded("value"))


def task_positions(spark, sf):
    return prepare.task_positions(instances(spark, sf))


def task_profile(spark, sf):
    return profile(spark, sf, vectors=False).select(*TASK_KEY, "first_row", "total", *TEMPLATE_TYPES)


def feasibility(spark, sf):
    prof = profile(spark, sf, vectors=False)
    return checks.feasibility(tasks.random_tasks(prof, NUM_TASKS), prof, NUM_INSTANCES)


def conservation(spark, sf):
    prof = profile(spark, sf, vectors=False)
    picks = tasks.random_tasks(prof, NUM_TASKS)
    given = bud.task_budgets(picks, prof, NUM_INSTANCES, picks_bound=NUM_TASKS)
    split = bud.template_budgets(given.select(*TASK_KEY, "budget"), prof, NUM_TASKS)
    return checks.conservation(given, split)


def train_size(spark, sf):
    built = mixture.build_mixture(instances(spark, sf), config("random", "random"))
    return checks.size_check(built.train, NUM_INSTANCES)


def eval_metrics(spark, sf):
    return metrics.eval_metrics(samples.batch_losses(spark, sf)).select(
        "epoch", *rounded("eval_loss", "perplexity")
    )


def train_loss(spark, sf):
    return metrics.train_loss(samples.batch_losses(spark, sf)).select("epoch", *rounded("train_loss"))


# Greedy selection -------------------------------------------------------------------------------


def picked_tasks(objective):
    def run(spark, sf):
        picks = tasks.select_tasks(profile(spark, sf), objective, NUM_TASKS)
        return picks.select("pick", *TASK_KEY, *rounded("gain"))

    return run


def picks_by_jobs(spark, sf):
    vectors = profile(spark, sf)
    return selection.assemble(
        tasks.picks_by_jobs(vectors, objective, NUM_TASKS).select(
            F.lit(objective).alias("objective"), "pick", *TASK_KEY, *rounded("gain")
        )
        for objective in ("fl", "gc", "logdet")
    )


def row_ordering(objective, **kw):
    def run(spark, sf):
        ordered = ordering.order_instances(instances(spark, sf), objective, **kw)
        return ordered.select(*GROUP_KEY, "rank", "row_idx", *rounded("gain"))

    return run


def chunked_random_ordering(spark, sf):
    return ordering.chunked_random_ordering(instances(spark, sf), threshold=20, chunk_rows=16)


# Budgets ----------------------------------------------------------------------------------------


def gains(spark, sf):
    """Any gains: here per task the mean length of its texts, in kilobytes."""
    docs = samples.document_instances(spark, sf)
    return docs.groupBy(*TASK_KEY).agg(
        (F.avg(F.length("inputs")) / 1000 - 1).alias("gain"), F.count(F.lit(1)).alias("total")
    )


def softmax_probabilities(spark, sf):
    plain = bud.taylor_softmax(gains(spark, sf), by=["submixture"], order=4, temperature=2.0)
    logs = bud.taylor_softmax(plain.drop("prob"), by=["submixture"], order=4, temperature=2.0, log=True)
    both = plain.join(logs.select(*TASK_KEY, F.col("prob").alias("log_prob")), list(TASK_KEY))
    return both.select(*TASK_KEY, *rounded("prob", "log_prob"))


def integer_split(spark, sf):
    parts = gains(spark, sf).withColumn("ratio", F.col("total").cast("double"))
    split = bud.budget_split(parts, F.lit(1001), "ratio", "task_name", by=["submixture"])
    return split.select(*TASK_KEY, "budget")


def capped_budgets(spark, sf):
    parts = gains(spark, sf).withColumn("budget", F.col("total") * (F.length("task_name") - 3) * 3 - 2)
    parts = parts.withColumn("budget", F.greatest("budget", F.lit(0))).withColumn("cap", F.col("total") * 5)
    capped = bud.cap_redistribute(parts, "task_name", ["submixture"], cap="cap")
    return capped.select(*TASK_KEY, "cap", "budget")


def task_budgets(objective):
    def run(spark, sf):
        prof = profile(spark, sf)
        given = mixture.group_budgets(prof, config(objective, "random"))
        return mixture.all_task_budgets(prof, given.tasks, config(objective, "random"))

    return run


def template_budgets(spark, sf):
    prof = profile(spark, sf)
    given = mixture.group_budgets(prof, config("gc", "random"))
    return given.split.select(*GROUP_KEY, "rows", "budget")


# Selection and assembly -------------------------------------------------------------------------


def group_subsets(spark, sf):
    rows = instances(spark, sf)
    prof = profile(spark, sf, vectors=False)
    given = mixture.group_budgets(prof, config("random", "random"))
    split = given.split.select(*GROUP_KEY, "budget")
    chosen = selection.select_subset(ordering.order_instances(rows, "random"), split, given.groups)
    return chosen.select(*GROUP_KEY, "rank", "row_idx")


def assembled(spark, sf):
    rows = instances(spark, sf)
    index = prepare.known_templates(rows).select("submixture", "row_idx")
    return selection.assemble(index.where(F.col("submixture") == s) for s in SUBMIXTURES)


def shuffled(spark, sf):
    return selection.shuffle(instances(spark, sf).select("submixture", "row_idx"), SHUFFLE_SEED)


def validation_rows(spark, sf):
    held_out = selection.validation_split(samples.conversation_pairs(spark, sf, validation=True))
    return held_out.select("submixture", "row_idx", "prompt", "response")


def _train(built):
    return built.train.select("pos", "submixture", "row_idx", F.md5("prompt").alias("prompt_md5"))


def mixture_of(f1, f2):
    def run(spark, sf):
        return _train(mixture.build_mixture(instances(spark, sf), config(f1, f2)))

    return run


mixture_gc_fl = mixture_of("gc", "fl")


def mixture_from_loaded_ordering(spark, sf):
    """The stored flow: an ordering is written, read back and cut to the budgets."""
    root = scratch_path(spark, "ordering")
    rows = instances(spark, sf)
    artifacts.write_ordering(ordering.order_instances(rows, "fl"), "fl", root)
    loaded = artifacts.load_ordering(spark, "fl", root, SUBMIXTURES)
    return _train(mixture.build_mixture(rows, config("gc", "fl"), ordering=loaded))


def document_mixture(f1, f2):
    def run(spark, sf):
        docs = samples.document_instances(spark, sf)
        vectors = artifacts.stage(
            spark,
            "vectors",
            lambda: embed(spread(docs)).select(*GROUP_KEY, "row_idx", "embedding"),
            scratch_path(spark, "document_vectors"),
            samples.DOCUMENT_SUBMIXTURES,
        )
        return _train(mixture.build_mixture(docs, document_config(f1, f2), vectors=vectors))

    return run


SWEEP = [
    MixtureConfig(m, n, f1, f2)
    for m in (4, NUM_TASKS)
    for n in (60, 120)
    for f1 in ("random", "gc")
    for f2 in ("random", "fl")
]
# Settings that differ in what the others share.
SWEEP += [
    MixtureConfig(5, 80, "random", "random", task_seed=5, ordering_seed=7, taylor_order=4, temperature=2.0),
    MixtureConfig(5, 80, "gc", "random", ordering_seed=7, temperature=0.5),
]


def mixture_sweep(spark, sf):
    return mixture.sweep(instances(spark, sf), SWEEP)


# Datasets of one sweep: settings with their own shuffle, task objective, or name that another setting has too.
WRITTEN = [
    MixtureConfig(4, 60, "random", "random"),
    MixtureConfig(4, 60, "random", "random", task_seed=5, ordering_seed=7, shuffle_seed=11),
    MixtureConfig(NUM_TASKS, 120, "gc", "fl"),
    MixtureConfig(5, 90, "gc", "random", ordering_seed=7),
    MixtureConfig(5, 90, "fl", "fl", shuffle_seed=11),
]


def written_sweep(spark, sf):
    """The datasets of several settings, from stored vectors and a loaded ordering, written by one job and read back."""
    root = scratch_path(spark, "sweep")
    rows = instances(spark, sf)
    artifacts.write_ordering(ordering.order_instances(rows, "fl"), "fl", root)
    built = mixture.build_sweep(
        rows.drop("embedding"),
        WRITTEN,
        samples.conversation_pairs(spark, sf, validation=True),
        vectors=rows.select(*GROUP_KEY, "row_idx", "embedding"),
        orderings={"fl": artifacts.load_ordering(spark, "fl", root, SUBMIXTURES)},
    )
    paths = artifacts.write_mixtures(built.train, built.validation, f"{root}/mixtures", built.grid)
    columns = ("submixture", "row_idx", "pos", "prompt", "response")
    return selection.assemble(
        part.select(F.lit(i).alias("config_id"), F.lit(name).alias("split"), *columns)
        for i, path in enumerate(paths)
        for name, part in datasets.load_instruction_dataset(spark, path).items()
    )


def baseline_mixture(kind):
    def run(spark, sf):
        return mixture.baseline_mixture(instances(spark, sf), kind, config("random", "random"))

    return run


# Embedding and tuning preparation ---------------------------------------------------------------


def embedded_prompts(spark, sf):
    vectors = embed(spread(samples.document_instances(spark, sf)))
    long = vectors.select("row_idx", F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0")
    return long.select("row_idx", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))


def concatenated_pairs(spark, sf):
    return tuning.concat_pair(train_pairs(spark, sf)).select("row_idx", "text")


def _tokenized(spark, sf, max_len):
    return tuning.tokenize(tuning.concat_pair(train_pairs(spark, sf)), max_len)


def tokenized_pairs(spark, sf):
    return _tokenized(spark, sf, SHORT_LEN).select("row_idx", joined("input_ids"), joined("prompt_ids"))


def effective_length(spark, sf):
    settings = spark.createDataFrame([(None, 512), (None, 4096), (48, 4096), (4096, 128)], "requested int, model int")
    pairs = tuning.concat_pair(train_pairs(spark, sf))
    parts = []
    for row in settings.collect():
        length = tuning.resolve_max_len(row["requested"], row["model"])
        sized = tuning.tokenize(pairs, length).select("row_idx", F.size("input_ids").alias("ids"))
        parts.append(sized.withColumn("max_len", F.lit(length)))
    return selection.assemble(parts)


def masked_labels(spark, sf):
    return tuning.mask_labels(_tokenized(spark, sf, MAX_LEN)).select(
        "row_idx", joined("input_ids"), joined("attention_mask"), joined("labels")
    )


def batch_plan(spark, sf):
    return tuning.batch_plan(train_pairs(spark, sf), ["row_idx"], **TRAIN_RUN)


def eval_batch_plan(spark, sf):
    held_out = samples.conversation_pairs(spark, sf, validation=True)
    placed = tuning.given_order(held_out.select("row_idx"), "row_idx")
    return tuning.batch_plan(placed, ["row_idx"], 4, devices=2, seed=None, order="place")


def eval_batch_plan_sparse(spark, sf):
    held_out = samples.conversation_pairs(spark, sf, validation=True)
    keys = held_out.select((F.col("row_idx") * 7_919_000_003 % 1_000_000_007).alias("key"))
    return tuning.batch_plan(tuning.given_order(keys, "key"), ["key"], 4, devices=2, seed=None, order="place")


def padded_batches(spark, sf):
    cfg = training.TuningConfig(MAX_LEN, devices=2, accumulation=4, epochs=2, seed=23)
    return _strings(training.training_batches(train_pairs(spark, sf), ["row_idx"], cfg))


def padded_eval_batches(spark, sf):
    held_out = prepare.as_pairs(samples.conversation_pairs(spark, sf, validation=True))
    return _strings(training.eval_batches(held_out, "row_idx", training.TuningConfig(MAX_LEN)))


def _strings(batches):
    return batches.select(
        "epoch", "batch_id", "row_idx", joined("input_ids"), joined("attention_mask"), joined("labels")
    )


def resumed_plan(spark, sf):
    plan = tuning.batch_plan(train_pairs(spark, sf), ["row_idx"], **TRAIN_RUN)
    return tuning.skip_batches(plan, 0, 3).select("epoch", "row_idx", "batch_id")


def resumed_from_updates(spark, sf):
    """Resume after two optimizer steps of a run, wherever in the epochs that is."""
    pairs = train_pairs(spark, sf)
    steps = step_counts(spark, sf).head()["device_batches"]
    epoch, done = tuning.resume_point(2, TRAIN_RUN["accumulation"], steps)
    plan = tuning.batch_plan(pairs, ["row_idx"], **TRAIN_RUN)
    return tuning.skip_batches(plan, epoch, done).select("epoch", "row_idx", "batch_id")


def sampled_rows(spark, sf):
    return tuning.peek(train_pairs(spark, sf), ["row_idx"], 3, 23).select("row_idx", "prompt")


def step_counts(spark, sf):
    return training.run_steps(train_pairs(spark, sf), training.TuningConfig(devices=2))


def step_counts_by_updates(spark, sf):
    return training.run_steps(train_pairs(spark, sf), training.TuningConfig(devices=2, max_updates=100))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "load_submixtures": load_submixtures,
        "load_submixtures_split_column": load_submixtures_split_column,
        "load_instruction_dataset": load_instruction_dataset,
        "stage_reuse": stage_reuse,
        "written_ordering": written_ordering,
        "loaded_ordering": loaded_ordering,
        "written_mixture": written_mixture,
        "written_metrics": written_metrics,
        "input_violations": input_violations,
        "known_templates": known_templates,
        "decoded_labels": decoded_labels,
        "row_positions": row_positions,
        "row_positions_by_text": row_positions_by_text,
        "stripped_metadata": stripped_metadata,
        "renamed_pairs": renamed_pairs,
        "selected_rows": selected_rows,
        "attached_embeddings": attached_embeddings,
        "cosine_kernel": cosine_kernel,
        "group_similarity": group_similarity,
        "zero_filled_budgets": zero_filled_budgets,
        "task_index": task_index,
        "task_totals": task_totals,
        "template_counts": template_counts,
        "task_embeddings": task_embeddings,
        "task_positions": task_positions,
        "task_profile": task_profile,
        "feasibility": feasibility,
        "conservation": conservation,
        "train_size": train_size,
        "eval_metrics": eval_metrics,
        "train_loss": train_loss,
        "tasks_fl": picked_tasks("fl"),
        "tasks_gc": picked_tasks("gc"),
        "tasks_logdet": picked_tasks("logdet"),
        "tasks_random": picked_tasks("random"),
        "picks_by_jobs": picks_by_jobs,
        "ordering_fl": row_ordering("fl"),
        "ordering_gc": row_ordering("gc"),
        "ordering_logdet": row_ordering("logdet"),
        "ordering_random": row_ordering("random"),
        **{f"ordering_{f}_distributed": row_ordering(f, one_task_rows=DISTRIBUTED_ABOVE) for f in ("fl", "gc", "logdet")},
        "chunked_random_ordering": chunked_random_ordering,
        "chunked_gc_ordering": row_ordering("gc", threshold=20, chunk_rows=16),
        "chunked_fl_ordering": row_ordering("fl", threshold=20, chunk_rows=16),
        "chunked_logdet_ordering": row_ordering("logdet", threshold=20, chunk_rows=16),
        "softmax_probabilities": softmax_probabilities,
        "integer_split": integer_split,
        "capped_budgets": capped_budgets,
        "task_budgets_random": task_budgets("random"),
        "task_budgets_gc": task_budgets("gc"),
        "task_budgets_fl": task_budgets("fl"),
        "task_budgets_logdet": task_budgets("logdet"),
        "template_budgets": template_budgets,
        "group_subsets": group_subsets,
        "assembled": assembled,
        "shuffled": shuffled,
        "validation_rows": validation_rows,
        "mixture_random_random": mixture_of("random", "random"),
        "mixture_gc_fl": mixture_gc_fl,
        "mixture_fl_gc": mixture_of("fl", "gc"),
        "mixture_logdet_logdet": mixture_of("logdet", "logdet"),
        **{
            f"mixture_{f1}_{f2}": mixture_of(f1, f2)
            for f1, f2 in (
                ("fl", "fl"), ("fl", "logdet"), ("gc", "gc"), ("gc", "logdet"), ("logdet", "fl"), ("logdet", "gc"),
            )
        },
        "mixture_from_loaded_ordering": mixture_from_loaded_ordering,
        "document_mixture_gc_fl": document_mixture("gc", "fl"),
        "mixture_sweep": mixture_sweep,
        "written_sweep": written_sweep,
        "baseline_equal": baseline_mixture("equal"),
        "baseline_proportional": baseline_mixture("proportional"),
        "embedded_prompts": embedded_prompts,
        "concatenated_pairs": concatenated_pairs,
        "tokenized_pairs": tokenized_pairs,
        "effective_length": effective_length,
        "masked_labels": masked_labels,
        "batch_plan": batch_plan,
        "eval_batch_plan": eval_batch_plan,
        "eval_batch_plan_sparse": eval_batch_plan_sparse,
        "padded_batches": padded_batches,
        "padded_eval_batches": padded_eval_batches,
        "resumed_plan": resumed_plan,
        "resumed_from_updates": resumed_from_updates,
        "sampled_rows": sampled_rows,
        "step_counts": step_counts,
        "step_counts_by_updates": step_counts_by_updates,
        **(llm.queries() if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    return {**registered_sql.statements(SWEEP, WRITTEN), **(llm.oracle_sql() if llm else {})}
