"""Language identification against a plain reading of the model and held-out accuracy; quality ranking by held-out order."""

import math
import zlib
from collections import Counter

import numpy as np

from rangeforge.llm.language_id import START, Model, Trees, identify_languages, learn_languages, op10_language_id, sample_texts
from rangeforge.llm.quality_rank import HASHED, NAMES, RIDGE, SEED, content, described, features, fit_ranking, learn_quality, op9_quality_rank, score_quality

SF = "/root/testdata/sf0.01"
TEXTS = {"en": [b"the cat and the hat are on the mat. " * 9, b"this is that and then there"], "de": ["der über die straße und das haus ist groß ".encode() * 9]}


def plain_bits(lang, raw, order=3):
    joined = b"".join(bytes([START]) * order + t for t in TEXTS[lang])
    counts: list[dict] = [{} for _ in range(order + 1)]
    for i in range(order, len(joined)):
        for k in range(order + 1):
            counts[k].setdefault(joined[i - k : i], Counter())[joined[i]] += 1
    data, total = bytes([START]) * order + raw, 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = counts[k].get(data[i - k : i])
            if seen is None:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if data[i] in seen:
                total += math.log2((n + kinds) / seen[data[i]])
                break
            total += math.log2((n + kinds) / kinds)
        else:
            total += 8
    return total


def test_code_lengths():
    tests = [b"the mat", b"x", "größe über".encode() * 5, bytes(range(256)), b"t", "дом и кот".encode()]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in tests])])
    for slack in (0, 2, 99):
        model = Model(Trees(TEXTS), slack)
        assert slack != 0 or len(model.families) == len(TEXTS)
        for block in (1 << 19, 5):
            got = model.bits(np.frombuffer(b"".join(tests), np.uint8), starts, block)
            for i, raw in enumerate(tests):
                for j, lang in enumerate(model.languages):
                    assert math.isclose(got[i, j], plain_bits(lang, raw), rel_tol=1e-4)


def test_any_number_of_languages():
    """90 languages of words of their own: each is told by its words, with contexts as long as for two."""
    rng = np.random.default_rng(6)
    letters = [chr(c) for c in range(0x0430, 0x0450)] + list("abcdefghijklmnopqrstuvwxyz")
    words = {f"l{k:02d}": ["".join(rng.choice(letters, 6)) for _ in range(30)] for k in range(90)}
    model = Model(Trees({lang: [" ".join(w).encode()] * 3 for lang, w in words.items()}))
    assert {t.order for _, t in model.families} == {3} and sorted(j for m, _ in model.families for j in m) == list(range(90))
    tests = [" ".join(w[5:15]).encode() for w in words.values()]
    bits = model.bits(np.frombuffer(b"".join(tests), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tests])]))
    assert bits.argmin(axis=1).tolist() == list(range(90))


def test_long_texts_are_learned_from(spark):
    docs = spark.createDataFrame([(1, "the hat and the cat " * 100, "en"), (2, "der hut über straßen " * 60000, "de")], "doc_id long, text string, lang string")
    found = sample_texts(docs, excerpt=1000)
    assert sorted(found) == ["de", "en"] and len(found["de"][0].decode()) == len(found["en"][0].decode()) == 1000
    assert [r.lang_pred for r in identify_languages(docs, learn_languages(docs)).collect()] == ["en", "de"]


def test_language_query(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op10_language_id(spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 0.0), (2, "", None, 0.0), (3, "12 34 ½ …", "en", 0.0), (4, "the hat " * 20000, None, 0.0), (None, "über das haus", None, None), (4, "the hat", None, None)], "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.lang_pred, r.score) for r in identify_languages(docs, Trees(TEXTS)).collect()]
    assert [(d, p) for d, p, _ in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de"), (4, "en")] and got[0][2] == 0
    assert learn_languages(docs.limit(0)) is None and {r.lang_pred for r in identify_languages(docs, None).collect()} == {"und"}
    assert identify_languages(docs.limit(0), Trees(TEXTS)).count() == 0


def test_quality_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op9_quality_rank(spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    learned = [(t, labels[d]) for d, t in texts if d in labels and zlib.crc32(str(d).encode()) % 3 != 1]
    plain = fit_ranking(described([t for t, _ in learned]), np.array([y == 1 for _, y in learned]))
    score = dict(zip((d for d, _ in texts), plain.score(described([t for _, t in texts])).tolist(), strict=True))
    assert all(abs(r.score - score[r.doc_id]) < 1e-4 for r in rows)
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_content_against_plain_counts():
    words = "the cat the hat Ünder the cat".encode().split()
    h = [zlib.crc32(w) for w in words]
    pairs = [((a ^ (b >> 7) ^ (b << 25 & 0xFFFFFFFF)) * 2654435761 & 0xFFFFFFFF) >> 24 for a, b in zip(h, h[1:], strict=False)]
    want = [math.sqrt(sum(x % HASHED == k for x in h) / 7) for k in range(HASHED)] + [math.sqrt(sum(x % HASHED == k for x in pairs) / 6) for k in range(HASHED)]
    assert np.allclose(content("the cat  the hat\nÜnder the\tcat"), want) and not content("").any() and content("one").sum() == 1


def test_ranking_against_plain_loss():
    """The fit is near the least loss over its pairs, weights find what told the labels apart, and scores are the logistic of the distance to the quantile."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    true = np.array([2.0, -1.0, 0.5, 0, 0, 0])
    good = x @ true + rng.logistic(size=300) > 0
    ranking = fit_ranking(x, good, pairs=3000)
    draw = np.random.default_rng(SEED)
    pairs = list(zip(draw.choice(np.flatnonzero(good), 3000).tolist(), draw.choice(np.flatnonzero(~good), 3000).tolist(), strict=True))
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -6, 6).astype(float)

    def loss(w):
        return sum(math.log1p(math.exp(-float((z[a] - z[b]) @ w))) for a, b in pairs) / len(pairs) + RIDGE / 2 * float(w @ w)

    w = ranking.weights.astype(float)
    least = loss(w)
    assert least < loss(np.zeros(6)) and all(loss(w + 0.3 * step / np.linalg.norm(step)) > least for step in rng.normal(size=(12, 6)))
    strength = z @ w
    threshold = np.quantile(strength, 1 - good.mean())
    spread = np.median(np.abs(strength - threshold)) / 3
    assert np.allclose(ranking.score(x), 1 / (1 + np.exp(-np.clip((strength - threshold) / spread, -30, 30))), atol=1e-4)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "word " * 30000, 3), (None, "a b", None), (3, "again", 3)], "doc_id long, text string, score int")
    rng = np.random.default_rng(0)
    x = described([" ".join(rng.choice(["a", "bb", "***", "CCC"], 20)) for _ in range(60)])
    ranking = fit_ranking(x, x[:, NAMES.index("symbols")] < 1.0)
    assert len(score_quality(docs, ranking).collect()) == 5 and {r.score for r in score_quality(docs, None).collect()} == {0.5}
    assert fit_ranking(x, np.ones(60, bool)) is None
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (1, 1)], "doc_id long, quality int")
    assert learn_quality(docs, labels) is None and learn_quality(docs.limit(0), labels.limit(0)) is None
    assert score_quality(docs.limit(0), ranking).count() == 0


def test_every_label_is_learned_from(spark):
    """Blocks of few rows: the threshold and spread are those of all labelled rows' strengths, and weights come from all blocks."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["plain", "word", "***", "CCC"], 30, p=[0.45, 0.35, 0.1, 0.1] if k % 3 else [0.1, 0.1, 0.4, 0.4])) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(400)], "doc_id long, quality int")
    ranking = learn_quality(docs, labels, rows=60)
    x, good = described(texts), np.array([k % 3 > 0 for k in range(400)])
    assert np.allclose(ranking.mean, x.mean(axis=0, dtype=float), atol=1e-5)
    strength = ranking.strength(x)
    assert abs(ranking.threshold - np.quantile(strength, 1 - good.mean())) < 1e-4
    assert abs(ranking.spread - np.median(np.abs(strength - ranking.threshold)) / 3) < 1e-4
    assert ((ranking.score(x) >= 0.5) == good).mean() > 0.97
    assert np.abs(ranking.weights - learn_quality(docs, labels).weights).max() > 1e-3
