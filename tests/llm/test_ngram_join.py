"""N-gram Jaccard join against brute force, on near copies, boilerplate and odd rows, and with small blocks and lists."""

import random
import re

import pyarrow as pa
import pytest

from rangeforge.llm import ngram_join as j


def plain_sets(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain_components(rows, words, percent):
    sets = [plain_sets(r[1], words) for r in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return sorted(((r[0], len(sets[i]), least.get(top(i))) for i, r in enumerate(rows)), key=str)


def edited(text, draw, times):
    w = text.split()
    for _ in range(times):
        at = draw.randrange(len(w))
        w[at : at + draw.choice([0, 1, 1, 1])] = [f"e{draw.randrange(10**6)}"]
    return " ".join(w)


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    shared, long = text(120), text(3000)
    texts = [None, "", " \t\n", "one", "ONE", "two words", "two  WORDS", "a b c", "a b c d", "É x y", "é x y", "c a b a b c a b c", long, edited(long, draw, 20), edited(long, draw, 500)]
    for _ in range(12):
        base = text(draw.randrange(5, 220))
        texts += [edited(base, draw, draw.randrange(0, 9)) for _ in range(draw.randrange(1, 8))]
    big = text(150)
    chain = [big]
    for _ in range(60):  # each near the one before, the ends far apart
        chain.append(edited(chain[-1], draw, 1))
    texts += chain + [edited(big, draw, draw.randrange(1, 6)) for _ in range(60)] + [big] * 20
    texts += [f"{shared} {text(draw.randrange(1, 60))}" for _ in range(60)]
    rows = [(i, t, 1, 0) for i, t in enumerate(texts)] + [(None, texts[-1], 1, 0), (None, "alone with no id", 1, 0), (20, texts[20], 1, 0)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "words", "percent", "hot", "block"), [(1, 3, 90, None, None), (2, 3, 90, 4, 5), (3, 2, 80, 0, 20)])
def test_brute_force(spark, monkeypatch, seed, words, percent, hot, block):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, node int").repartition(4).cache()
    if block:
        monkeypatch.setattr(j, "BLOCK", block)
        monkeypatch.setattr(j, "LONG", 60)
    if hot is not None:  # any order must do
        monkeypatch.setattr(j, "_hot_shingles", lambda prints, most: j.shingle_sets(pa.array([max((r[1] or "" for r in rows), key=len)]), words)[0][:: max(1, 4 - hot)])
    got = sorted((tuple(r) for r in j.jaccard_components(docs, words=words, percent=percent).collect()), key=str)
    assert got == plain_components(rows, words, percent)


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, j.jaccard_components(docs).collect())) == [(1, 0, 1), (2, 0, 2)]
    assert j.jaccard_components(docs.limit(0)).count() == 0


def test_prefix_rule():
    """Two sets that share none of their first shingles can't have the similarity."""
    for percent in (50, 80, 90, 99):
        for n in range(1, 400):
            k = j.prefix_length(n, percent)
            # all but the prefix is shared at most, with a set that is no smaller than these
            assert 100 * (n - k) < percent * n <= 100 * (n - k + 1)


def test_last_plan_is_small(spark):
    """The driver runs all leaves of one plan at once; what leads to the components is cut before, not repeated in it."""
    docs = spark.createDataFrame([(i, f"a b c {i % 3}") for i in range(9)], "doc_id long, text string").repartition(2).cache()
    plan = j.jaccard_components(docs)._jdf.queryExecution().sparkPlan().toString()
    assert sum(plan.count(kind) for kind in ("Join", "Scan")) <= 12
