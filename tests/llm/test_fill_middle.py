"""Fill-in-the-middle: odd texts against a plain version, whatever the chunks, and exact round trips."""

import hashlib
import random
import re

import pytest

from rangeforge.llm.fill_middle import Scan, fill_in_middle


def plain_version(doc_id, text):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, t, t
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t


def odd_texts():
    draw = random.Random(5)
    texts = [None, "", " ", "a", "<", "<P>", "a<S>b", "<M", "<P<P", "x<<M>", "<S<", "P>", "<" * 700, "ab" * 700, "é\U0001f600\u0000\n" * 300, "word " * 4000, "<p>", "<P >", "M" * 255 + "<P>", "a" * 254 + "<M>"]
    return texts + ["".join(draw.choice(["a", "Zb", "<", "P", "S", "M", ">", " ", "é", "\U0001f600", "\n"]) for _ in range(draw.randrange(1, 2000))) for _ in range(80)] + ["".join(draw.choice("ab <P é") for _ in range(draw.randrange(1, 900))) for _ in range(200)]


@pytest.mark.parametrize("chunk", [61, 1 << 20])
def test_against_plain(spark, chunk):
    rows = [(i, t, 1, "x") for i, t in enumerate(odd_texts())] + [(None, "no id here", 2, "y"), (21, odd_texts()[21], 1, "x"), (21, odd_texts()[21], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string").repartition(3)
    got = sorted((tuple(r) for r in fill_in_middle(docs, chunk=chunk).collect()), key=str)
    assert got == sorted((plain_version(r[0], r[1]) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0), chunk=chunk).count() == 0


def test_scan_composes():
    """A text cut anywhere gives what the whole gives, each piece entered in the state the one before left."""
    for text in filter(None, odd_texts()[:60]):
        whole = Scan([text])
        for at in (1, len(text) // 2, len(text) - 1):
            left = Scan([text[:at], text])
            state = {"<": 2}.get(text[at - 1], 1 if re.match("[A-Za-z]", text[at - 1]) else 0)
            if at > 1 and text[at - 2] == "<" and text[at - 1] in "PSM":
                state = 3
            if at:
                right = Scan([text[at:]], [state])
                assert int(left.counts[0] + right.counts[0]) == int(whole.counts[0]) == int(left.counts[1])
