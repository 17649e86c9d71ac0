"""Language identification in two levels: the language family, then one-versus-one linear support vector machines.

Both levels use hashed byte n-grams of folded letters. A support vector machine per pair of families votes on the
family; a machine per pair of languages inside it decides between close relatives.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.llm.arrow import filtered, slices, strings, with_columns

# Families of languages by code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi".split(),
    "romance": "fr es pt it ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz tk ky tt".split(),
    "semitic": "ar he mt am".split(),
    "indo-aryan": "hi bn ur mr gu pa ne si".split(),
    "iranian": "fa ps ku tg".split(),
}
UNDETERMINED = "und"
# Hash buckets of n-grams, the n-gram lengths in bytes, and the bound on training rows per language.
BUCKETS = 4096
LENGTHS = (1, 2, 3, 4)
TRAIN_ROWS = 600
# Documents below this score have no language for a filter.
LEAST_SCORE = 0.4
# Training: passes and regularisation of the machines, and the steepness of votes.
PASSES = 12
# Rows whose counts are dense at a time.
BLOCK_ROWS = 64
REGULARISATION = 1e-4
STEEPNESS = 6.0


def family_of(language: str, families: Mapping[str, list[str]] = FAMILIES) -> str:
    return next((f for f, members in families.items() if language in members), f"only {language}")


class NgramHasher:
    """Texts to L2-normalised square roots of hashed n-gram counts; also whether a text has letters."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        keep = np.full(256, 0x20, np.uint8)
        keep[97:123] = np.arange(97, 123)
        keep[0x80:] = np.arange(0x80, 0x100)
        self.fold = keep

    def letters(self, column: pa.Array) -> np.ndarray:
        return np.array([bool(t) and any(map(str.isalpha, t)) for t in column.to_pylist()], bool)

    def __call__(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), self.buckets), np.float32)
        for start in range(0, len(column), BLOCK_ROWS):
            out[start : start + BLOCK_ROWS] = self._block(column.slice(start, BLOCK_ROWS))
        return out

    def _block(self, column: pa.Array) -> np.ndarray:
        lowered = pa.array([(t or "").lower() for t in column.to_pylist()], pa.large_string())
        data, offsets = strings(lowered)
        rows = len(lowered)
        folded = self.fold[data]
        owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
        blank = folded == 0x20
        # One blank between words: a blank after a blank of the same row goes.
        drop = np.zeros(len(folded), bool)
        drop[1:] = blank[1:] & blank[:-1] & (owner[1:] == owner[:-1])
        folded, owner = folded[~drop].astype(np.uint64), owner[~drop]
        out = np.zeros((rows, self.buckets))
        for n in LENGTHS:
            count = max(0, len(folded) - n + 1)
            gram = np.full(count, n, np.uint64)
            for k in range(n):
                gram *= np.uint64(0x100000001B3)
                gram ^= folded[k : k + count]
            gram *= np.uint64(0x9E3779B97F4A7C15)
            bucket = (gram >> np.uint64(40)).astype(np.int64) % self.buckets
            inside = owner[:count] == owner[n - 1 : n - 1 + count]
            key = owner[:count][inside] * self.buckets + bucket[inside]
            out += np.bincount(key, minlength=rows * self.buckets).reshape(rows, self.buckets)
        out = np.sqrt(out)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def train_machine(x: np.ndarray, y: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """A linear support vector machine (hinge loss, averaged stochastic subgradient); y is +1 or -1; last weight: bias.

    Rows are visited in one fixed shuffled order per pass, so the result depends on the rows alone.
    """
    x = np.hstack([x, np.full((len(x), 1), 0.3, np.float32)]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, t, seen = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, 0
    rng = np.random.default_rng(len(y))
    for p in range(passes):
        for block in np.array_split(rng.permutation(len(y)), max(1, len(y) // 16)):
            t += 1
            rate = 1.0 / (REGULARISATION * (t + 1000))
            bad = block[y[block] * (x[block] @ w) < 1]
            w *= 1 - rate * REGULARISATION
            if len(bad):
                w += rate / len(block) * ((weight[bad] * y[bad]) @ x[bad])
            if p >= passes // 2:
                mean += w
                seen += 1
    mean /= max(1, seen)
    mean[-1] *= 0.3
    return mean.astype(np.float32)


def _machines(x: np.ndarray, labels: np.ndarray, classes: list[str]) -> tuple[list[tuple[int, int]], np.ndarray]:
    pairs, weights = list(combinations(range(len(classes)), 2)), []
    for a, b in pairs:
        rows = np.flatnonzero((labels == classes[a]) | (labels == classes[b]))
        weights.append(train_machine(x[rows], np.where(labels[rows] == classes[a], 1.0, -1.0)))
    return pairs, np.array(weights, np.float32).reshape(len(pairs), x.shape[1] + 1)


def _votes(x: np.ndarray, pairs: list[tuple[int, int]], weights: np.ndarray, classes: int) -> np.ndarray:
    """Share of every class in the soft votes of all pairs it takes part in."""
    if classes == 1:
        return np.ones((len(x), 1))
    votes = np.zeros((len(x), classes))
    margins = x @ weights[:, :-1].T + weights[:, -1]
    for k, (a, b) in enumerate(pairs):
        p = 1 / (1 + np.exp(-STEEPNESS * np.clip(margins[:, k], -8, 8)))
        votes[:, a] += p
        votes[:, b] += 1 - p
    return votes / (classes - 1)


@dataclass
class LanguageModel:
    """Machines between families, and for every family between its languages."""

    families: list[str]
    between: tuple[list[tuple[int, int]], np.ndarray]
    within: list[tuple[list[str], list[tuple[int, int]], np.ndarray]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        votes = _votes(x, *self.between, len(self.families))
        family = votes.argmax(axis=1)
        names = np.full(len(x), UNDETERMINED, object)
        score = votes[np.arange(len(x)), family] if len(x) else np.zeros(0)
        for f, (languages, pairs, weights) in enumerate(self.within):
            rows = np.flatnonzero(family == f)
            if len(rows):
                inner = _votes(x[rows], pairs, weights, len(languages))
                best = inner.argmax(axis=1)
                names[rows] = np.array(languages, object)[best]
                score[rows] *= inner[np.arange(len(rows)), best]
        return names, np.clip(score, 0, 1)


def train(x: np.ndarray, languages: np.ndarray, families: Mapping[str, list[str]] = FAMILIES) -> LanguageModel | None:
    """A model of the languages that occur; None without rows."""
    if not len(languages):
        return None
    family = np.array([family_of(l, families) for l in languages], object)
    names = sorted(set(family))
    within = []
    for f in names:
        rows = np.flatnonzero(family == f)
        members = sorted(set(languages[rows]))
        within.append((members, *_machines(x[rows], languages[rows], members)))
    return LanguageModel(names, _machines(x, family, names), within)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether a row is kept from training: crc32 of the id as text modulo `parts`. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    rows: int = TRAIN_ROWS,
    families: Mapping[str, list[str]] = FAMILIES,
    buckets: int = BUCKETS,
) -> LanguageModel | None:
    """Train on about `rows` different texts per language, chosen by their hash; on all of them where there are fewer.

    Copies of a text count once, so they take no room in the sample. The different texts are counted by sketches.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()}
    if not counts:
        return None
    scale = 1 << 30
    cut = F.lit(0)
    for name, n in counts.items():
        cut = F.when(F.col("lang") == name, F.lit(int(scale * min(1.0, rows / max(1, n))))).otherwise(cut)
    chosen = known.withColumn("_hash", F.xxhash64("text")).where(F.pmod("_hash", F.lit(scale)) < cut)
    chosen = chosen.groupBy("lang", "_hash").agg(F.min("text").alias("text")).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = NgramHasher(buckets)
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = hasher(batch.column(1).slice(start, stop - start)).astype(np.float16)
                packed = pa.array([v.tobytes() for v in part], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), packed], ["lang", "v"])

    found = sorted((r["lang"], bytes(r["v"])) for r in chosen.mapInArrow(vectors, "lang string, v binary").collect())
    if not found:
        return None
    x = np.stack([np.frombuffer(v, np.float16) for _, v in found]).astype(np.float32)
    return train(x, np.array([l for l, _ in found], object), families)


def _predictor(model: LanguageModel | None, buckets: int):
    hasher = NgramHasher(buckets)

    def run(column):
        letters = hasher.letters(column)
        names, score = np.full(len(column), UNDETERMINED, object), np.zeros(len(column))
        rows = np.flatnonzero(letters)
        if model is not None and len(rows):
            names[rows], score[rows] = model.predict(hasher(column.take(pa.array(rows))))
        return names, score

    return run


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Add `lang_pred` and `score` (0 to 1) of every whole text.

    A null text, or one without letters, is `und` with score 0; so is every text where nothing could be learned.
    """

    def kernel():
        predict = _predictor(model, buckets)

        def run(column):
            names, score = predict(column)
            return pa.array(names, pa.string()), score

        return run

    return with_columns(docs, text, "lang_pred string, score double", kernel)


def recognised(
    docs: DataFrame, model: LanguageModel | None, text: str = "text", least: float = LEAST_SCORE, buckets: int = BUCKETS
) -> DataFrame:
    """The documents with a language: not `und`, and a score of at least `least`. They keep their own columns."""

    def kernel():
        predict = _predictor(model, buckets)

        def run(column):
            names, score = predict(column)
            return (names != UNDETERMINED) & (score >= least)

        return run

    return filtered(docs, text, kernel)
