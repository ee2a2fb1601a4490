"""Quality classifier by Bradley-Terry pairwise ranking.

Every labelled row is learned from. The rows are dealt by a hash of the id into
blocks of some ROWS; in each, preference pairs (a document labelled 1 over one
labelled 0) are drawn, every row being in one at least, and weights minimise the
logistic loss of the feature differences. The mean of the blocks' weights, by
their rows, gives a document's strength in the Bradley-Terry model. A document is described by the shape of its text (counts,
their squares and roots) and by what it says: the frequencies of its words and
pairs of words, each hashed to one of HASHED places. The threshold is the exact quantile of all labelled
rows' strengths that leaves as many of them below it as are labelled 0; the logistic of the distance to it
is the score that is given.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .language_id import remainder

#: Labelled rows of a block, about, and pairs drawn in it besides one for each row.
ROWS, PAIRS, STEPS, SEED, RIDGE = 8_000, 40_000, 250, 11, 1e-3
#: Places for words, and as many for pairs of words.
HASHED = 256
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = np.frombuffer(b".,;:?!", np.uint8)
NAMES = ("log_words", "few_words", "word_length", "long_words", "distinct", "repeats", "symbols", "pipes", "capitals", "digits", "marks", "shouts", "stops", "lines", "dup_lines", "entropy", "other_bytes", "title_words")


def features(text: str) -> list[float]:
    """Shape of a whole text; an empty one is all zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum() + 1e-9
    kinds = len(set(words))
    repeats = sum(map(str.__eq__, words[1:], words))
    lines = [x for x in text.split("\n") if x.strip()]
    p = counts[counts > 0] / len(raw)
    return [
        math.log1p(n), max(0.0, 1 - n / 25), len(text) / n, sum(map((12).__lt__, map(len, words))) / n, kinds / n, repeats / n,
        min(2.0, counts[_SYMBOLS].sum() / n), min(2.0, counts[124] / n), counts[_UPPER].sum() / letters, counts[_DIGIT].sum() / len(raw), min(2.0, counts[_MARKS].sum() / n), min(2.0, counts[33] / n), counts[46] / n,
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), float(-(p * np.log2(p)).sum()), counts[128:].sum() / len(raw), sum(map(str.istitle, words)) / n,
    ]


def content(text: str) -> np.ndarray:
    """Square roots of the shares of words and of pairs of neighbouring words that fall to each place; an empty text is all zeros."""
    words = text.encode().split()
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    pairs = (h[:-1] ^ (h[1:] >> np.uint32(7)) ^ (h[1:] << np.uint32(25))) * np.uint32(2654435761) >> np.uint32(24)
    counts = np.concatenate([np.bincount(h % HASHED, minlength=HASHED) / max(1, len(h)), np.bincount(pairs % HASHED, minlength=HASHED) / max(1, len(pairs))])
    return np.sqrt(counts).astype(np.float32)


def described(texts: list[str | None]) -> np.ndarray:
    """One row for each text: shape features, their squares and square roots, then content."""
    shape = np.array([features(t or "") for t in texts]).reshape(-1, len(NAMES))
    says = np.array([content(t or "") for t in texts], np.float32).reshape(-1, 2 * HASHED)
    return np.concatenate([shape, shape * shape, np.sqrt(np.abs(shape)), says], axis=1, dtype=np.float32)


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.threshold) / self.spread, -30, 30)))


def fit_ranking(x: np.ndarray, good: np.ndarray, *, pairs: int = PAIRS, steps: int = STEPS, seed: int = SEED) -> Ranking | None:
    """None if one of the two labels is missing: there are no pairs to learn from."""
    if not good.any() or good.all():
        return None
    mean, scale = x.mean(axis=0, dtype=np.float64).astype(np.float32), x.std(axis=0, dtype=np.float64).astype(np.float32) + np.float32(1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    w = fit_weights(z, good, pairs=pairs, steps=steps, seed=seed)
    strength = z @ w
    threshold = float(np.quantile(strength, 1 - good.mean()))
    return Ranking(mean, scale, w, threshold, float(max(1e-6, np.median(np.abs(strength - threshold)) / 3)))


def fit_weights(z: np.ndarray, good: np.ndarray, *, pairs: int = PAIRS, steps: int = STEPS, seed: int = SEED) -> np.ndarray:
    """Weights of scaled features: `pairs` drawn pairs, and one more for each row."""
    rng, ours, theirs = np.random.default_rng(seed), np.flatnonzero(good), np.flatnonzero(~good)
    better, worse = rng.choice(ours, pairs), rng.choice(theirs, pairs)
    better, worse = np.concatenate([better, ours, rng.choice(ours, len(theirs))]), np.concatenate([worse, rng.choice(theirs, len(ours)), theirs])
    w, speed, square = (np.zeros(z.shape[1], np.float32) for _ in range(3))
    for step in range(1, steps + 1):
        strength = z @ w
        pull = 1 / (1 + np.exp(np.clip(strength[better] - strength[worse], -30, 30)))
        # A row's pull is that of all its pairs, so the pairs' differences need not be held.
        each = np.bincount(better, pull, len(z)) - np.bincount(worse, pull, len(z))
        slope = -(each.astype(np.float32) @ z) / len(better) + RIDGE * w
        speed, square = 0.9 * speed + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        w -= 0.05 * (speed / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


def _described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns of docs behind x, the described text as bytes."""
    small_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [row.tobytes() for row in described(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), *batch.columns[1:]], names=["x", *keep])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(measure, f"x binary, {kept}")


def _each(described: DataFrame, measure, schema: str) -> DataFrame:
    """measure(features, labels) for each batch of described rows, as a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(measure(np.stack([np.frombuffer(v.as_py(), np.float32) for v in batch.column(0)]), batch.column(1)))

    return described.select("x", "__rf_label").mapInArrow(run, schema)


def _scales(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over all rows, from sums by batch that Spark adds up."""

    def sums(x: np.ndarray, _) -> dict:
        x = x.astype(np.float64)
        return {"k": np.arange(x.shape[1]), "n": np.full(x.shape[1], len(x)), "s": x.sum(axis=0), "q": (x * x).sum(axis=0)}

    rows = _each(described, sums, "k long, n long, s double, q double").groupBy("k").agg(*[F.sum(c).alias(c) for c in "nsq"]).orderBy("k").collect()  # a row for each feature
    n, s, q = (np.array([r[c] for r in rows], float) for c in "nsq")
    return (s / n).astype(np.float32), np.sqrt(np.maximum(0, q / n - (s / n) ** 2)).astype(np.float32) + np.float32(1e-6)


def quantile_of(rows: DataFrame, column: str, n: int, share: float, *, fine: int = 1 << 12) -> float:
    """np.quantile of a column of n numbers: counts by steps of 1 / fine tell the two steps that hold it, and only those are looked into."""
    place = (n - 1) * share
    low, high = math.floor(place), min(math.floor(place) + 1, n - 1)
    step = F.floor(F.col(column) * fine)
    counts = sorted(rows.groupBy(step.alias("step")).agg(F.count("*").alias("many")).collect())
    steps, ends = np.array([r["step"] for r in counts]), np.cumsum([r["many"] for r in counts])
    at = np.searchsorted(ends, [low, high], side="right")
    before = int(ends[at[0] - 1]) if at[0] else 0
    inside = np.sort([r[0] for r in rows.where(step.isin([int(v) for v in steps[at]])).select(column).collect()])
    a, b = inside[low - before], inside[high - before]
    return float(a + (b - a) * (place - low))


def learn_quality(docs: DataFrame, labels: DataFrame, *, rows: int = ROWS) -> Ranking | None:
    """Ranking from all labelled documents, in blocks of about `rows`. Rows without id or label are passed over, and so are blocks in which all labels are equal.

    Both tables are shuffled at any size, so that no label table is broadcast.
    """
    labels = labels.select("doc_id", F.col("quality").alias("__rf_label")).where("doc_id IS NOT NULL AND __rf_label IS NOT NULL")
    learned = cut(_described(docs.select("doc_id", "text").join(labels.hint("merge"), "doc_id"), ["doc_id", "__rf_label"]))
    n, n_good = learned.agg(F.count("*"), F.coalesce(F.sum((F.col("__rf_label") == 1).cast("long")), F.lit(0))).first()
    if not 0 < n_good < n:
        return None
    mean, scale = _scales(learned)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        good = (pdf["__rf_label"] == 1).to_numpy()
        if not good.any() or good.all():
            return pd.DataFrame({"block": [], "many": [], "weights": []})
        z = np.clip((np.stack([np.frombuffer(x, np.float32) for x in pdf["x"]]) - mean) / scale, -6, 6)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "many": len(pdf), "weights": [fit_weights(z, good).tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.stack([np.frombuffer(x, np.float32) for x in pdf["weights"]]).astype(float)
        return pd.DataFrame({"many": [pdf["many"].sum()], "weights": [(pdf["many"].to_numpy() @ w).astype(np.float64).tobytes()]})

    block = F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // rows))).alias("block")
    fitted = learned.select(block, "doc_id", "x", "__rf_label").groupBy("block").applyInPandas(fit, "block long, many long, weights binary")
    # A hundred sums at most come to the driver.
    sums = fitted.groupBy(F.pmod("block", F.lit(100))).applyInPandas(add, "many long, weights binary").collect()
    if not sums:
        return None
    w = (np.sum([np.frombuffer(r["weights"], np.float64) for r in sums], axis=0) / sum(r["many"] for r in sums)).astype(np.float32)
    bare = Ranking(mean, scale, w, 0.0, 1.0)
    strengths = cut(_each(learned, lambda x, _: {"strength": bare.strength(x).astype(float)}, "strength double"))
    threshold = quantile_of(strengths, "strength", n, 1 - n_good / n)
    off = strengths.select(F.abs(F.col("strength") - threshold).alias("off"))
    return Ranking(mean, scale, w, threshold, max(1e-6, quantile_of(off, "off", n, 0.5) / 3))


def score_quality(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """One row (doc_id, score, predicted) for each row of docs; without a ranking all scores are 0.5.

    Null texts count as empty. Repeated rows are scored each; other columns are
    left out. Narrow: nothing is shuffled.
    """
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = ranking.score(described(batch.column(1).to_pylist())).astype(float) if ranking else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def op9_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranking = learn_quality(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    return score_quality(docs, ranking).select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
