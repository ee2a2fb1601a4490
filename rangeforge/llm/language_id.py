"""Language identification by prediction by partial matching.

For each language a byte context tree of up to `order` bytes is counted on a
bounded sample and frozen. A byte costs its code length in the longest context
that was seen, by escape method C: a context with n bytes of d kinds gives a
seen byte n_s / (n + d), and the escape d / (n + d) to the next shorter
context, down to one in 256. As the statistics are frozen, that length depends
on the last `order` + 1 bytes alone, so the trees are laid out as tables and a
whole text is scored by lookups; the language with the shortest code wins.

Every language is learned, and all with the same order. Languages whose contexts
are much the same share a table, others get their own, so tables grow with the
number of languages and not with its square.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Bounds on what is learned from, for each language: documents, bytes, and characters of one document. Of a longer text that many
#: characters are learned from, at a place told by a hash of its id. Every text is scored whole.
DOCUMENTS, BYTES, EXCERPT = 400, 1_500_000, 200_000
ORDER = 3
#: Languages share a table while it is at most this many times as large as tables of their own.
SLACK = 2
#: Bytes of evidence that the score counts a text as, at most.
EVIDENCE = 24.0
START = 10  # a text begins behind a line feed


def remainder(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def sample_texts(docs: DataFrame, *, documents: int = DOCUMENTS, excerpt: int = EXCERPT) -> dict[str, list[bytes]]:
    """For each language, texts of about `documents` rows, chosen by a hash of the id; of a long text an excerpt."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, documents / n))])
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    spot = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.shiftright(hashed, 30), F.greatest(F.length("text") - excerpt, F.lit(0)) + 1).cast("int") + 1
    chosen = rows.where(spot < F.element_at(share, F.col("lang"))).select("lang", "doc_id", F.encode(F.substring("text", place, F.lit(excerpt)), "utf-8").alias("raw")).limit(2 * documents * len(counts))
    found: dict[str, list] = {lang: [] for lang in sorted(counts)}
    for r in chosen.toLocalIterator():
        found[r["lang"]].append((str(r["doc_id"]), bytes(r["raw"])))
    return {lang: [raw for _, raw in sorted(texts)] for lang, texts in found.items() if texts}


class Trees:
    """Counts of all contexts of up to `order` bytes for each language: by order, (context and byte as one number, how often)."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER, limit: int = BYTES):
        self.languages, self.order = sorted(texts), order
        self.counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in self.languages:
            taken, size = [], 0
            for raw in texts[lang]:
                if size + len(raw) > limit and taken:
                    continue
                taken.append(bytes([START]) * order + raw[:limit])
                size += len(raw)
            c = np.frombuffer(b"".join(taken), np.uint8).astype(np.int64)
            by_order = []
            for k in range(order + 1):
                grams = np.zeros(len(c) - order, np.int64)
                for back in range(k, -1, -1):
                    grams = grams * 256 + c[order - back : len(c) - back]
                by_order.append(np.unique(grams, return_counts=True))
            self.counts.append(by_order)

    def key(self) -> str:
        return hashlib.sha256(pickle.dumps((self.languages, self.order, self.counts))).hexdigest()

    def families(self, slack: int = SLACK) -> list[list[int]]:
        """Languages (by number) that share a table."""
        contexts = [np.unique(c[self.order][0] >> 8) for c in self.counts]
        found: list[tuple[list[int], np.ndarray]] = []
        for j, own in enumerate(contexts):
            for k, (members, union) in enumerate(found):
                both = np.union1d(union, own)
                if len(both) * (len(members) + 1) <= slack * sum(len(contexts[m]) for m in [*members, j]):
                    found[k] = [*members, j], both
                    break
            else:
                found.append(([j], own))
        return [members for members, _ in found]


class Tables:
    """Code lengths of some languages laid out: row[context] leads to the longest context seen, cost[row, byte] holds a length for each language.

    Bytes that none of them has seen are class 0: all of them cost the same.
    """

    def __init__(self, trees: Trees, members: list[int]):
        self.order, self.languages = trees.order, [trees.languages[j] for j in members]
        order, counts = trees.order, [trees.counts[j] for j in members]
        seen = np.unique(np.concatenate([*(c[0][0] for c in counts), np.array([START])]))
        self.classes = np.zeros(256, np.int32)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.width = a = len(seen) + 1
        lengths, rows = None, None
        for k in range(order + 1):
            coded = [sum(self.classes[grams >> 8 * i & 255].astype(np.int64) * a**i for i in range(k + 1)) for grams, _ in (c[k] for c in counts)]
            contexts = np.unique(np.concatenate(coded) // a)
            shorter = rows[contexts % a ** (k - 1)] if k > 1 else np.zeros(len(contexts), np.int64)
            new = np.empty((len(contexts), a, len(members)), np.float32)
            for j, grams in enumerate(coded):
                n = counts[j][k][1]
                at = np.searchsorted(contexts, grams // a)
                total = np.bincount(at, n, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                below = np.full((len(contexts), a), 8.0) if k == 0 else lengths[shorter, :, j].astype(float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(total > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0.0)
                cost = below + escape[:, None]
                cost[at, grams % a] = np.log2((total[at] + kinds[at]) / n)
                new[:, :, j] = cost
            if k == 0:
                lengths, rows = new, np.zeros(1, np.int64)
            else:
                all_rows = np.tile(rows, a) if k > 1 else np.zeros(a, np.int64)
                all_rows[contexts] = np.arange(len(contexts)) + len(lengths)
                lengths, rows = np.concatenate([lengths, new]), all_rows
        self.rows = rows.astype(np.int32)
        self.costs = np.ascontiguousarray(lengths.reshape(-1, len(members)))

    def bits(self, data: np.ndarray, starts: np.ndarray, block: int = 1 << 19) -> np.ndarray:
        """Code length of each text by language. data holds the texts' bytes one after another; starts has where each begins, and the end."""
        out = np.zeros((len(starts) - 1, len(self.languages)))
        a, first = np.int32(self.width), self.classes[START]
        carried = [first] * self.order
        for lo in range(0, len(data), block):
            c = self.classes[data[lo : lo + block]]
            begin = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + len(c))] - lo
            begin = begin[begin < len(c)]
            context, older, scale = np.zeros(len(c), np.int32), c, np.int32(1)
            for k in range(self.order):
                prior = np.empty_like(c)
                prior[1:], prior[0] = older[:-1], carried[k]
                prior[begin] = first
                carried[k] = older[-1]
                context += prior * scale
                older, scale = prior, scale * a
            cost = self.costs[self.rows[context].astype(np.int64) * a + c]
            owner = np.searchsorted(starts, lo, "right") - 1
            edges = np.concatenate([[0], begin[begin > 0]])
            owners = np.concatenate([[owner], np.searchsorted(starts, begin[begin > 0] + lo, "right") - 1])
            np.add.at(out, owners, np.add.reduceat(cost, np.unique(edges), axis=0, dtype=np.float64)[np.searchsorted(np.unique(edges), edges)] if len(edges) else 0.0)
        return out


class Model:
    """Tables of all languages, laid out by families; code lengths by language in the order of their names."""

    def __init__(self, trees: Trees, slack: int = SLACK):
        self.languages = trees.languages
        self.families = [(members, Tables(trees, members)) for members in trees.families(slack)]

    def bits(self, data: np.ndarray, starts: np.ndarray, block: int = 1 << 19) -> np.ndarray:
        out = np.empty((len(starts) - 1, len(self.languages)))
        for members, tables in self.families:
            out[:, members] = tables.bits(data, starts, block)
        return out


_MODELS: dict[str, Model] = {}


def worker_model(key: str, shared) -> Model:
    """The latest model, laid out once a Python worker."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(shared.value)
    return _MODELS[key]


def identify_languages(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """One row (doc_id, lang_pred, score, bits_per_byte) for each row of docs.

    Null texts and texts without a letter are `und` with score 0; so is all
    when nothing was learned (trees is None). Equal code lengths go to the
    first language by name. Repeated rows are scored each; other columns are
    left out. Narrow: nothing is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double"
    if trees is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    key, shared = trees.key(), spark.sparkContext.broadcast(trees)  # its size follows BYTES and the number of languages, not the rows

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        model, letter = worker_model(key, shared), regex.compile(r"\p{L}").search
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spoken = [bool(t) and letter(t) is not None for t in texts]
            raw = [t.encode() if s else b"" for t, s in zip(texts, spoken, strict=True)]
            sizes = np.array([len(r) for r in raw], np.int64)
            full = np.flatnonzero(sizes)
            best, score, rate = ["und"] * len(raw), np.zeros(len(raw)), np.zeros(len(raw))
            if len(full):
                bits = model.bits(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(sizes[full])]))
                least = bits.min(axis=1)
                gap = (bits - least[:, None]) * np.minimum(1.0, EVIDENCE / sizes[full])[:, None]
                score[full] = 1 / np.exp2(-gap).sum(axis=1)
                rate[full] = least / sizes[full]
                for i, j in zip(full, bits.argmin(axis=1), strict=True):
                    best[i] = model.languages[j]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(score), pa.array(rate, mask=sizes == 0)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select("doc_id", "text").mapInArrow(identify, schema)


def learn_languages(docs: DataFrame, **bounds) -> Trees | None:
    """Trees of a bounded sample of docs (doc_id, text, lang); None if no row has text and lang."""
    texts = sample_texts(docs, **bounds)
    return Trees(texts) if texts else None


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = learn_languages(docs.where(remainder(F.col("doc_id"), 4) != 2))
    return identify_languages(docs, trees).select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
