"""Tokens to padded batches, and loss metrics."""

import math

import pytest
from pyspark.sql import functions as F

from mixloom.functions.hashing import HashingEncoder
from mixloom.operators import metrics, tuning
from mixloom.operators.embed import embed
from mixloom.plans.training import TuningConfig, eval_batches, training_batches


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(0, "a b c", "d"), (1, "x " * 30, "tail"), (2, "", "only answer"), (3, " lead  gap\t", ""), (4, "q", "r s t u")]
    return spark.createDataFrame(rows, "id int, prompt string, response string")


def prepared(pairs, max_len):
    return tuning.mask_labels(tuning.tokenize(tuning.concat_pair(pairs), max_len))


def test_labels_hide_the_prompt(pairs):
    got = {r["id"]: r for r in prepared(pairs, 8).collect()}
    assert got[0]["labels"][:3] == [-100] * 3 and got[0]["labels"][3] == got[0]["input_ids"][3]
    assert got[1]["labels"] == [-100] * 8 and len(got[1]["input_ids"]) == 8
    assert got[2]["labels"] == got[2]["input_ids"]
    assert got[3]["labels"] == [-100, -100]
    assert all(len(r["labels"]) == len(r["input_ids"]) == len(r["attention_mask"]) for r in got.values())
    assert set(prepared(pairs, 8).columns) == {"id", "input_ids", "attention_mask", "labels"}


def test_own_tokenizer(pairs):
    def make():
        return lambda texts: [[ord(c) for c in t] for t in texts]

    got = tuning.tokenize(tuning.concat_pair(pairs), 4, make).where("id = 0").head()
    assert got["input_ids"] == [ord(c) for c in "a b "] and got["prompt_ids"] == [ord(c) for c in "a b "]


def test_effective_length():
    assert tuning.resolve_max_len(None, 4096) == 1024
    assert tuning.resolve_max_len(None, 512) == 512
    assert tuning.resolve_max_len(4096, 512) == 512
    assert tuning.resolve_max_len(48, 512) == 48


def test_null_side_does_not_vanish(spark):
    df = spark.createDataFrame([("p", None)], "prompt string, response string")
    assert tuning.concat_pair(df).head()["text"] is None


def test_batches_are_full_and_padded(spark, pairs):
    rows = spark.range(103).withColumnRenamed("id", "row")
    plan = tuning.batch_plan(rows, ["row"], 10, devices=2, accumulation=2, epochs=3, seed=5)
    by_epoch = {}
    for r in plan.collect():
        by_epoch.setdefault(r["epoch"], []).append(r)
        assert r["device"] == r["batch_id"] % 2 and r["step"] == r["batch_id"] // 2
        assert r["update"] == r["batch_id"] // 4
    orders = []
    for part in by_epoch.values():
        assert sorted(r["place"] for r in part) == list(range(103))
        assert sorted(r["row"] for r in part) == list(range(103))
        orders.append([r["row"] for r in sorted(part, key=lambda r: r["place"])])
    assert orders[0] != orders[1] != orders[2]
    ids = prepared(pairs, 8).withColumn("epoch", F.lit(0)).withColumn("batch_id", F.col("id") % 2)
    for r in tuning.collate(ids, pad_id=7).collect():
        longest = {0: 5, 1: 8}[r["batch_id"]]
        assert len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"]) == longest
        pads = r["attention_mask"].count(0)
        assert r["input_ids"][longest - pads :] == [7] * pads and r["labels"][longest - pads :] == [-100] * pads


def test_resume(spark):
    plan = tuning.batch_plan(spark.range(40), ["id"], 4, devices=2, epochs=3, seed=1)
    left = tuning.skip_batches(plan, 1, 2).select("epoch", "step").distinct().collect()
    assert {tuple(r) for r in left} == {(1, 2), (1, 3), (1, 4), *((2, s) for s in range(5))}


def test_step_summary(spark):
    row = tuning.step_summary(spark.range(1001), 4, 8, 16, 3, 0.01).head().asDict()
    assert row == {
        "rows": 1001,
        "batches": 251,
        "device_batches": 32,
        "updates_per_epoch": 2,
        "epochs": 3,
        "updates": 6,
        "warmup_updates": math.floor(0.01 * 3 * 16),
        "total_batch": 512,
    }


def test_updates_may_set_the_epochs(spark):
    row = tuning.step_summary(spark.range(1001), 4, 8, 16, 3, 0.1, max_updates=5).head()
    assert (row["epochs"], row["updates"], row["warmup_updates"]) == (3, 5, 0)
    assert tuning.resume_point(7, 16, 50) == (2, 12)


def test_batches_end_to_end(spark, pairs):
    cfg = TuningConfig(8, train_batch_size=2, eval_batch_size=2, epochs=2)
    train = training_batches(pairs, ["id"], cfg).collect()
    assert sorted((r["epoch"], r["id"]) for r in train) == [(e, i) for e in (0, 1) for i in range(5)]
    held_out = eval_batches(pairs, "id", cfg).collect()
    assert {r["id"]: r["batch_id"] for r in held_out} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    for batches in (train, held_out):
        widths = {}
        for r in batches:
            widths.setdefault((r["epoch"], r["batch_id"]), set()).add(len(r["input_ids"]))
        assert all(len(w) == 1 for w in widths.values())


def test_losses(spark):
    rows = [(0, 0, 4, 1.0), (0, 1, 1, 6.0), (1, 0, 2, 1000.0)]
    losses = spark.createDataFrame(rows, "epoch int, batch_id bigint, n int, loss double")
    got = {r["epoch"]: r for r in metrics.eval_metrics(losses).collect()}
    assert got[0]["eval_loss"] == 2.0 and got[0]["perplexity"] == math.exp(2.0)
    assert got[1]["perplexity"] == math.inf
    assert {r["epoch"]: r["train_loss"] for r in metrics.train_loss(losses).collect()} == {0: 3.5, 1: 1000.0}


def test_embedding_keeps_rows_and_order(spark):
    texts = spark.createDataFrame([(i, "w" * (i % 7) + f" t{i}") for i in range(700)], "id int, inputs string")

    def make():
        calls = []

        def encode(batch):
            calls.append(len(batch))
            assert len(batch) <= 50
            import numpy as np

            return np.array([[len(t), calls[-1]] for t in batch])

        return encode

    for r in embed(texts.repartition(3), encoder=make, batch_rows=50).collect():
        assert r["embedding"][0] == len(r["inputs"])


def test_default_encoder():
    x = HashingEncoder(16)(["a b a", "", "b a a"])
    assert abs((x[0] ** 2).sum() - 1) < 1e-6 and not x[1].any() and (x[0] == x[2]).all()
