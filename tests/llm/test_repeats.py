"""Removal of repeated passages against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rangeforge.llm import repeats
from rangeforge.llm.repeats import Shape, cut_repeats, op4_repeats

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone, until = bytearray(len(r)), 0
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                lo = max(i, until)
                gone[lo : i + length] = b"\1" * (i + length - lo)
                until = i + length
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a)
            at = len(r) if at < 0 else at
            spans.append((a, at))
        out.append((len(r), spans, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(30), prose(200)
    texts = [None, "", "short", "ab" * 300, "x" * 39, "x" * 41, base, base, passage, "\n".join(["same line again and again"] * 40)]
    for _ in range(25):
        w = base.split(" ")
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
        texts.append(prose(rng.randint(5, 60)) + " " + passage[rng.randint(0, 20) : rng.randint(40, len(passage))] + " " + prose(rng.randint(5, 60)))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("length", "part"), [(40, 1 << 19), (40, 300), (64, 1000)])
def test_brute_force(spark, length, part):
    texts = corpus(length)
    if part < 1000:
        texts.append(" ".join(t or "" for t in texts))
    rows = [(i, t, "r", [1]) for i, t in enumerate(texts)] + [(None, "no id but " + "z" * 90, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, marks array<int>").coalesce(3)
    expected = brute([r[1] for r in rows], length)
    got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in cut_repeats(docs, Shape(length, part, 4000)).collect()}
    assert got == {r[0]: e for r, e in zip(rows, expected, strict=True)}


def test_small_packs_and_other_ids(spark):
    """Windows alike within a task, over tasks, and in phrases that are repeated themselves; ids that are no numbers."""
    texts = corpus(3)
    rows = [(f"id{i}" if i % 7 else None, t, "extra") for i, t in enumerate([*texts, *texts[:9]])]
    docs = spark.createDataFrame(rows, "doc_id string, text string, block string").repartition(3).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = sorted(((d, *e) for (d, _), e in zip(rows, brute([t for _, t in rows], 40), strict=True)), key=str)
    got = sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in cut_repeats(docs, Shape(40, 1 << 19, 700, 500)).collect()), key=str)
    assert got == expected


def test_equal_first_digests_are_told_apart():
    """Windows whose first digests collide: only those equal in the second one too are repeated."""
    w, x = np.array([5, 5, 5, 9, 9, 7], np.uint64), np.array([1, 2, 1, 3, 4, 6], np.uint32)
    block, at = np.array([10, 11, 12, 13, 14, 15]), np.array([0, 1, 2, 3, 4, 5])
    out = repeats._pack(w, x, block, at, 1)
    lanes = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    hits = [np.array(v).tolist() for k, b in lanes.items() if k >= 1 for v in repeats._unpack_known(b)]
    assert sorted(map(tuple, np.array(hits).T.tolist())) == [(10, 0), (12, 2)]
    got = repeats._unpack(lanes[0])
    assert sorted(zip(*(v.tolist() for v in got), strict=True)) == [(5, 1, -1, 0), (5, 2, 11, 1), (7, 6, 15, 5), (9, 3, 13, 3), (9, 4, 14, 4)]


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = {d.doc_id: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for d, (n, s, k) in zip(docs, brute([d.text for d in docs], 200), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op4_repeats(spark, SF).collect()} == expected


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert cut_repeats(docs).count() == 0
