"""SimHash against brute force: fingerprints, pairs in groups, components, and copies that must go or stay."""

import random
import re

import numpy as np
import pytest
import xxhash

from rangeforge.llm.common import joined_by_hot_keys
from rangeforge.llm.simhash import (
    CORPUS_RULE, PARITY, NearRule, _across_large, _across_small, _best_of, _link_large, _mask_keys, _may_link, _nearest_large, _nearest_small, _parity, drop_near_copies, mask_blocks, near_components, near_pairs, op5_simhash,
)

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, k=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(top(i))) for i, d in enumerate(ids)), key=str)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op5_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()), key=str) == brute_components(docs)


def test_chains_and_odd_rows(spark):
    rng = random.Random(5)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 999)) for _ in range(400)]
    texts = [None, "", " \n", "one", "one two three", "ONE two\tthree", "é È ß x y", " ".join(base) * 40]
    for _ in range(60):
        k = rng.randrange(len(base))
        base = [*base[:k], "changed" + str(k), *base[k + 1 :]]
        texts.append(" ".join(base))
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)] + [(3, "one", 1, None), (None, "one", 1, None), (None, "nobody else", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int, fp string")
    got = sorted((tuple(r) for r in near_components(docs).selectExpr("doc_id", "lower(hex(fp)) AS f", "component_id").collect()), key=str)
    assert got == brute_components(rows)
    assert near_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("bits", "radius"), [(64, 4), (64, 3), (256, 51), (512, 92)])
def test_bit_sliced_pairs(bits, radius):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, (12, bits // 64), dtype=np.uint64)
    rows = []
    for i in range(500):
        x = [int(v) for v in centre[i % 12]]
        for b in rng.integers(0, bits, rng.integers(0, radius + 2)):
            x[b // 64] ^= 1 << int(b % 64)
        rows.append(x)
    fp, group = np.array(rows, np.uint64), np.sort(rng.integers(0, 40, 500))
    group[300:] = 99
    close = lambda i, j: sum(int(a ^ b).bit_count() for a, b in zip(fp[i], fp[j], strict=True)) <= radius
    expected = {(i, j) for i in range(500) for j in range(i + 1, 500) if group[i] == group[j] and close(i, j)}
    a, b = near_pairs(fp, group, radius)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == expected and len(a) == len(expected)
    root = list(range(500))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(500):
        for j in range(i):
            if close(i, j):
                root[top(i)] = top(j)
    want = [top(i) for i in range(500)]
    root = list(range(500))
    for i, j in _link_large(fp, radius):
        assert close(i, j)
        root[top(i)] = top(j)
    have = [top(i) for i in range(500)]
    assert len(set(zip(want, have, strict=True))) == len(set(want)) == len(set(have))


def test_corpus_rule_drops_near_copies_only(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioubcdfghklmnprst") for _ in range(rng.randint(3, 8)))
    rows, copies = [], set()
    for d in range(60):
        w = [word() for _ in range(rng.randint(150, 400))]
        rows.append((1000 + d, " ".join(w), "s"))
        if d % 3 == 0:
            for k in range(2):
                v = list(w)
                for _ in range(max(1, len(w) // 100)):
                    v[rng.randrange(len(v))] = word()
                rows.append((2000 + 10 * d + k, " ".join(v), "s"))
                copies.add(2000 + 10 * d + k)
    rows += [(1, None, "s"), (2, "", "s"), (3, " ", "s"), (1000, rows[0][1], "again")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    left = [r.doc_id for r in drop_near_copies(docs, CORPUS_RULE).collect()]
    assert drop_near_copies(docs).columns == docs.columns and drop_near_copies(docs.limit(0)).count() == 0
    assert len(left) == len(set(left)) and {1, 2, 3} <= set(left) and {r[0] for r in rows} - copies <= set(left)
    assert len(copies & set(left)) <= 1


def shingle_set(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def brute_left(rows, similarity=0.8):
    """Ids that stay: the least of each component of pairs with the similarity."""
    rows = sorted(rows)
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [d for i, (d, _) in enumerate(rows) if top(i) == i]


def test_corpus_rule_equals_brute_force(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeioubcdfghklmnprst") for _ in range(rng.randint(3, 8)))
    rows = []
    for d in range(40):
        # Own words after a shared passage: similarities of 0.65 to 0.9, on both sides of the bar.
        shared, n = [word() for _ in range(rng.randint(120, 400))], len(rows)
        for k in range(6):
            own = int(len(shared) * rng.uniform(0.03, 0.27))
            rows.append((n + k, " ".join(shared + [word() for _ in range(own)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingle_set(t) for _, t in rows]
    assert sum(0.65 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.8 for i in range(240) for j in range(i)) > 50
    assert sorted(r.doc_id for r in drop_near_copies(docs, CORPUS_RULE).collect()) == brute_left(rows)


def test_corpus_rule_counts_a_shingle_once(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioubcdfghklmnprst") for _ in range(rng.randint(3, 8)))
    rows = []
    for n, times in ((900, 10), (900, 15), (300, 7)):
        words, line = [word() for _ in range(n)], [word() for _ in range(10)]
        rows += [(len(rows), " ".join(words + line)), (len(rows) + 1, " ".join(words + line * times))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_copies(docs, CORPUS_RULE).collect()) == brute_left(rows) == [0, 2, 4]


def distance(x, y):
    return sum(int(v).bit_count() for v in x ^ y)


def test_rounds_of_small_and_large_groups():
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 1 << 63, (6, 8), dtype=np.uint64)
    fp = centre[np.arange(300) % 6].copy()
    for x in fp[6:]:
        for b in rng.integers(0, 512, rng.integers(0, 90)):
            x[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    group, kinds, part = np.zeros(300, int), rng.integers(90, 130, 300), rng.integers(0, 5, 300)
    fits = lambda i, j: i != j and distance(fp[i], fp[j]) <= CORPUS_RULE.radius and min(kinds[i], kinds[j]) >= 0.8 * max(kinds[i], kinds[j])
    near = {i: {j for j in range(300) if fits(i, j)} for i in range(300)}
    item, other, d = _nearest_small(fp, group, kinds, CORPUS_RULE)
    assert item.tolist() == [i for i in range(300) if near[i]]
    assert all(j in near[i] and k == min(distance(fp[i], fp[x]) for x in near[i]) for i, j, k in zip(item.tolist(), other.tolist(), d.tolist(), strict=True))
    item, other, d = _nearest_large(fp, kinds, CORPUS_RULE)
    assert item.tolist() == [i for i in range(300) if near[i]]
    assert all(j in near[i] and k == distance(fp[i], fp[j]) for i, j, k in zip(item.tolist(), other.tolist(), d.tolist(), strict=True))
    expected = {(i, j) for i in near for j in near[i] if i < j and part[i] != part[j]}
    wide = np.concatenate([fp, np.zeros((300, PARITY // 64), np.uint64)], axis=1)
    for rounds in (lambda: _across_small(wide, group, kinds, part, CORPUS_RULE), lambda: _across_large(wide, kinds, part, CORPUS_RULE)):
        pairs = [(min(i, j), max(i, j)) for a, b, _ in rounds() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(pairs) == len(set(pairs)) and set(pairs) == expected and expected
        ((item, other, _),) = _best_of(rounds(), 300)
        assert item.tolist() == sorted({i for p in expected for i in p}) and {(min(p), max(p)) for p in zip(item.tolist(), other.tolist(), strict=True)} <= expected


def test_parity_sketch_keeps_links():
    rng = np.random.default_rng(12)
    kept = {True: 0, False: 0}
    for n in (20, 150, 1000, 5000):
        for _ in range(60):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            own = int(n * rng.uniform(0.05, 0.2))
            y = np.concatenate([x[own:], rng.integers(0, 1 << 63, own, dtype=np.uint64)])
            both = n - own
            link = both >= 0.8 * (2 * n - both)
            a, b = (np.frombuffer(_parity(v), np.uint64)[None] for v in (x, y))
            may = bool(_may_link(a, b, np.array([n]), np.array([n]), 0.8)[0][0])
            assert may or not link
            kept[may] += 0 if link else 1
    assert kept[False] > kept[True]


def test_blocks_keep_every_pair_and_groups_small():
    assert [mask_blocks(n, 4) for n in (0, 10**6, 10**8, 10**10, 10**15)] == [6, 6, 6, 8, 13]
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    b = a.copy()
    for i in range(200):
        for k in rng.choice(64, 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    for blocks in (6, 7, 8, 13):
        x, y = (_mask_keys(v[:, None], 4, blocks) for v in (a, b))
        assert (x == y).any(axis=1).all() and len(set(x[0].tolist())) == x.shape[1]


def test_hot_keys_join_as_others(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(3000)], "doc_id long, k long")
    named = rows.groupBy("k").count().selectExpr("k", "k * 2 AS name", "count AS copies")
    assert sorted(map(tuple, joined_by_hot_keys(rows, named, "k", "copies", hot=10).select("doc_id", "name").collect())) == [(i, 0 if i % 3 else 2 * i) for i in range(3000)]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 5, "x", 0.5), (2, "a b c d e f g", 6, None, None), (None, None, None, None, None)], "doc_id long, text string, row_number long, node string, first double")
    left = drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=str) == [(1, "a b c d e f g", 5, "x", 0.5), (None,) * 5]


def test_large_group_of_copies_that_differ(spark):
    """More copies of one text than a small group holds, each with words of its own, and two texts on one template that stay under the bar."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("aeioubcdfghklmnprst") for _ in range(rng.randint(4, 9)))
    base, rows = [word() for _ in range(120)], []
    for d in range(700):
        v = list(base)
        for _ in range(rng.randint(0, 2)):
            v[rng.randrange(len(v))] = word()
        rows.append((d, " ".join(v)))
    rows += [(1000 + d, " ".join(base[:95] + [word() for _ in range(60)])) for d in range(2)]
    got = sorted(r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_left(rows)


def test_rules_are_checked():
    with pytest.raises(ValueError):
        NearRule(bits=128)
