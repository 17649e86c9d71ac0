"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, exception phrases, normalised by length.

The lexicon has seed terms and terms learned from labelled rows; a logistic curve over the normalised weight, fitted on
other labelled rows, turns hits into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixloom.llm.arrow import slices, with_columns

# Seed terms (folded) and the weight they have before any label is seen.
SEEDS = (
    "idiot idiots moron morons stupid scum loser losers worthless pathetic disgusting trash clown imbecile dumbass"
    " asshole bastard bitch degenerate filth vermin subhuman"
).split()
SEED_WEIGHT = 3.0
# Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "sore loser", "stupid simple", "trash collection")
# Labelled rows to learn from, by label; the share of them that fits the curve instead of the lexicon.
TRAIN_ROWS = {1: 3000, 0: 4000}
CURVE_SHARE = 0.3
# In how many different surroundings of toxic texts a learned term must occur, and its least weight.
MIN_PLACES = 3
MIN_WEIGHT = 1.5
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones, and digits or signs that stand for letters.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕһԁԛԝɡνοαερτικυⅼ" + "".join(chr(0xFF41 + i) for i in range(26)),
    "aeopcyxijshdqwgvoaeptikul" + "abcdefghijklmnopqrstuvwxyz",
)
_LOOKALIKE = re.compile("[Ͱ-֏ɡⅼＡ-ｚ]")
SIGNS = str.maketrans("0134578@$!|", "oieastbasil")
_SIGN_IN_WORD = re.compile(r"(?<=[a-z])[0134578@$!|]+(?=[a-z])|(?<![^\W_])[0134578@$!|]+(?=[a-z]{2})")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­​-‍⁠﻿]")


def fold(text: str) -> str:
    """Lower case; look-alike letters, and signs inside words, as the letters they stand for; no invisible characters."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if _LOOKALIKE.search(text):
            # Latin words only: a word wholly in another script is that script's own.
            text = re.sub(r"[^\W_]+", lambda m: _latin(m[0]), text)
    return _SIGN_IN_WORD.sub(lambda m: m[0].translate(SIGNS), text.lower())


def _latin(word: str) -> str:
    mapped = word.lower().translate(HOMOGLYPHS)
    return mapped if mapped.isascii() else word


class Matcher:
    """Weights of lexicon terms in folded texts. A term must be a whole word; exception phrases hide what they hold."""

    def __init__(self, lexicon: Mapping[str, float], exceptions: Sequence[str] = EXCEPTIONS):
        self.terms = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.terms.add_word(term, (len(term), weight, False))
        for phrase in exceptions:
            self.terms.add_word(phrase, (len(phrase), 0.0, True))
        if len(self.terms):
            self.terms.make_automaton()

    def hits(self, folded: str) -> list[float]:
        if not len(self.terms):
            return []
        found, hidden = [], []
        for last, (size, weight, exception) in self.terms.iter(folded):
            first = last + 1 - size
            if (first and folded[first - 1].isalnum()) or folded[last + 1 : last + 2].isalnum():
                continue
            (hidden if exception else found).append((first, last, weight))
        return [w for a, b, w in found if not any(x <= a and b <= y for x, y, _ in hidden)]

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight of all hits, and the same per hundred words with a floor, both damped."""
        folded = fold(text or "")
        total = sum(self.hits(folded))
        words = max(20, len(folded) / 6)
        return float(np.log1p(max(0.0, total))), float(np.log1p(max(0.0, total) * 100 / words))


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    curve: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.curve[0] + features @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# Without labels: a few seed terms in a text of usual length pass the threshold.
DEFAULT_CURVE = (-3.0, 1.5, 1.0)


def held_out(doc_id: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text modulo `parts`. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: Mapping[int, int] = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic, curve) of at most rows[label] labelled documents, those with the lowest hash of their id.

    `curve` marks the share that fits the curve. A document labelled both ways counts as toxic; of rows with one doc_id the
    smallest text counts. Only ids are sorted and broadcast, at most as many as `rows` allows; of the texts, those chosen
    are shuffled, once per task at most.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    h = F.xxhash64(F.col("doc_id"), F.lit(7))
    chosen = None
    for label, most in rows.items():
        part = known.where(F.col("toxic") == label).orderBy(h, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1000)) < int(1000 * CURVE_SHARE)
    chosen = chosen.withColumn("curve", part)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "toxic", "curve").agg(F.min("text").alias("text"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Log odds of terms: in how many different surroundings (the words beside it) toxic and other texts have them.

    Surroundings, not rows, are counted, so that copies of one text count once.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                seen: set[tuple[str, str, int]] = set()
                part = batch.slice(start, stop - start)
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = _WORD.findall(fold(text or ""))
                    for before, word, after in zip(["", *found], found, [*found[1:], ""]):
                        if 2 < len(word) < 40:
                            seen.add((word, f"{before} {after}", toxic))
                rows = list(zip(*seen)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32())],
                    ["term", "beside", "toxic"],
                )

    texts = sample.where(~F.col("curve")).select("text", F.col("toxic").cast("int").alias("toxic"))
    found = texts.mapInArrow(places, "term string, beside string, toxic int")
    found = found.select("term", F.xxhash64("beside").alias("beside"), "toxic").distinct()
    counts = found.groupBy("term").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    all_places = found.groupBy("toxic").count().collect()
    total = {r["toxic"]: r["count"] for r in all_places}
    lexicon = dict.fromkeys(SEEDS, SEED_WEIGHT)
    if not total.get(1) or not total.get(0):
        return lexicon
    rate = total[1] / total[0]
    weight = F.log((F.col("bad") + 0.1) / ((F.col("n") - F.col("bad") + 0.5) * rate))
    sure = weight - F.lit(1.0) / F.sqrt(F.col("bad"))
    top = counts.where(F.col("bad") >= MIN_PLACES).select("term", sure.alias("weight")).where(F.col("weight") >= MIN_WEIGHT)
    return lexicon | {r["term"]: float(r["weight"]) for r in top.collect()}


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, slopes kept from being negative."""
    x1, w = np.hstack([np.ones((len(x), 1)), x]), np.array(DEFAULT_CURVE)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + ridge * np.array([0, w[1], w[2]])
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def fit(docs: DataFrame, labels: DataFrame, rows: Mapping[int, int] = TRAIN_ROWS) -> ToxicityModel:
    """Lexicon and curve from labelled rows of (doc_id, text) and (doc_id, toxic)."""
    sample = labelled_sample(docs, labels, rows).checkpoint()
    lexicon = learn_lexicon(sample)
    matcher_terms = dict(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(matcher_terms)
        for batch in batches:
            pairs = [matcher.features(t) for t in batch.column(0).to_pylist()]
            columns = [pa.array([p[i] for p in pairs], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["total", "density", "toxic"])

    texts = sample.where("curve").select("text", F.col("toxic").cast("int").alias("toxic"))
    found = sorted(texts.mapInArrow(measure, "total double, density double, toxic int").collect())
    y = np.array([r["toxic"] for r in found], float)
    curve = DEFAULT_CURVE
    if 3 <= y.sum() <= len(y) - 3:
        curve = fit_curve(np.array([[r["total"], r["density"]] for r in found]), y)
    return ToxicityModel(lexicon, curve)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add `score` (0 to 1) and `predicted` (1 from the threshold on) of every whole text; a null text counts as empty."""

    def kernel():
        matcher = Matcher(model.lexicon, model.exceptions)

        def run(column):
            features = np.array([matcher.features(t) for t in column.to_pylist()]).reshape(-1, 2)
            found = model.score(features)
            return found, (found >= threshold).astype(np.int32)

        return run

    return with_columns(docs, text, "score double, predicted int", kernel)
