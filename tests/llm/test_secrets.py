"""Secret scans against a plain reading of the base patterns, and the inferred formats on credentials not seen."""

import hashlib
import math
import random
import re
import string

import pyarrow as pa

from rangeforge.llm.secret_scan import find_secrets, infer_formats, labelled_credentials, op8_secret_scan, redact_secrets, scan_secrets

SF = "/root/testdata/sf0.001"
KEY = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"


def plain(text):
    found = []
    for kind, pattern, group, least in (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ):
        found += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [x for _, _, x in sorted(found)]


TEXTS = [None, "", f'token = "{KEY}" of', "secret: token: abcdefgh", "PASSWORD='hunter2222' passwd=abc", "AKIA" + "Z9" * 9 + " AKIAABC", "é" * 5 + "api-key api_key:zzzzzz ſecret=aaaaaaa", f"x{KEY}{KEY}" * 3, "token" * 5000]


def test_base_spans_are_those_of_the_patterns():
    formats = infer_formats()
    for text in TEXTS:
        if text is not None:
            assert [":".join(map(str, s[:3])) for s in find_secrets(text, formats) if s[0] != "format"] == plain(text)


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_secret_scan(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) | {""} and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in spans) for k in ("assign", "access", "hex"))


def test_inferred_formats():
    formats = infer_formats()
    credentials, others = labelled_credentials(seed=1234)
    assert sum(formats.score(x) > formats.bar for x in credentials) > 0.95 * len(credentials)
    assert sum(formats.score(x) > formats.bar for x in others) < 0.06 * len(others)
    text = "see ghp_" + "a1B2c3D4e5" * 3 + "F6g7H8 there, internationalisation-of-2024 and https://www.example.com/abc/4711"
    assert [s[0] for s in find_secrets(text, formats)] == ["format"]


def plain_ratio(word, formats):
    """Walks both automata by their nodes."""
    totals = []
    for automaton in (formats.credential, formats.other):
        at, total = 0, 0.0
        for k, c in enumerate(word):
            kind = "0" if c in string.digits else "a" if c in "abcdef" else "z" if c in string.ascii_lowercase else "Z" if c in string.ascii_uppercase else c
            s, node = c if k < automaton.head else kind, automaton.nodes[at]
            total += math.log((node.counts.get(s, 0) + 0.5) / (node.passed + 0.5 * (automaton.alphabet + 1)))
            if automaton.head <= k < 4:
                total -= math.log({"0": 10, "a": 6, "z": 20, "Z": 26}.get(kind, 1))
            at = node.arcs.get(s, at)
        totals.append(total)
    return totals[0] - totals[1]


def test_format_spans_against_plain_scores(spark):
    """All runs of all texts, of any length, scored one by one."""
    formats, rng = infer_formats(), random.Random(2)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pick = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    texts += [f"see {pick(n)}. and ({pick(40)}), é{pick(30)}ß {'z' * 700} {pick(600)}" for n in range(1, 40)]
    found = 0
    for text in texts:
        spans = find_secrets(text, formats)
        base = [s for s in spans if s[0] != "format"]
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
            word = m[0].rstrip(".-=")
            if any(a < m.end() and m.start() < b for _, a, b, _ in base) or not re.search("[A-Za-z0-9]", word):
                continue
            ratio = plain_ratio(word, formats)
            if ratio > formats.evidence and ratio / len(word) > formats.bar:
                want.append((m.start(), m.start() + len(word)))
        got = [s[1:3] for s in spans if s[0] == "format"]
        assert [g for g in got if not any(a <= g[1] and g[0] <= b for _, a, b, _ in base)] == [x for x in want if not any(a <= x[1] and x[0] <= b for _, a, b, _ in base)]
        found += len(want)
    assert found > 60


def test_scores_together_equal_scores_alone():
    formats, rng = infer_formats(), random.Random(5)
    words = ["".join(rng.choice(string.ascii_letters + string.digits + "+/_.=-") for _ in range(rng.choice((1, 2, 3, 4, 5, 17, 40, 511, 512, 513)))) for _ in range(300)]
    for k, total in enumerate(formats.totals(pa.array(words)).tolist()):
        assert math.isclose(total, plain_ratio(words[k], formats), abs_tol=1e-6)
    assert len(formats.totals(pa.array([], pa.string()))) == 0


def test_formats_not_learned_from():
    """Recall on public formats that the labelled ones don't hold, and no span in plain prose of the documents."""
    formats, rng = infer_formats(), random.Random(3)
    alnum = string.ascii_letters + string.digits
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    held = [lambda: "npm_" + pick(alnum, 36), lambda: "pk_live_" + pick(alnum, 24), lambda: "SG." + pick(alnum, 22) + "." + pick(alnum, 43), lambda: "pypi-" + pick(alnum + "_-", 60), lambda: pick(alnum + "+/", 86) + "==", lambda: "hf_" + pick(string.ascii_letters, 34)]
    for make in held:
        assert sum(formats.score(make()) > formats.bar for _ in range(100)) >= 80


def test_every_candidate_is_scored():
    formats = infer_formats()
    for word in ("glpat-" + "aBxQzRtKwLmNpVyGhJdS", "sk_live_" + "QwErTyUiOpAsDfGhJkLzXcVb"):
        assert [s[:3] for s in find_secrets(f"see {word} there", formats)] == [("format", 4, 4 + len(word))]
    assert not find_secrets(f"{'_' * 40} {'+' * 20} {'=' * 30} internationalisation Geschwindigkeitsbegrenzung", formats)
    access, secret = "AKIA" + "Q7W2E9R4T1Y6U3I8", "wJ4lrXUtn7EMI/K7MDE+G9bPxRfi2CYzEXk8M0PL"
    assert [s[:3] for s in find_secrets(f"{access}/{secret} end", formats)] == [("access", 0, 20), ("format", 21, 61)]
    assert [s[:3] for s in find_secrets(f"{secret}/{access} end", formats)] == [("format", 0, 40), ("access", 41, 61)]


def test_odd_rows_and_redaction(spark):
    docs = spark.createDataFrame([(i, t, "src", 7, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], None, None, None), (2, TEXTS[2], "src", 7, "x")], "doc_id long, text string, source string, n_chars long, spans string")
    assert scan_secrets(docs).count() == len(TEXTS) + 2 and scan_secrets(docs.limit(0)).count() == 0
    rows = redact_secrets(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and redact_secrets(docs).columns == docs.columns
    by = {r.doc_id: r for r in rows}
    assert by[0].text is None and by[1].text == "" and by[1].n_chars == 7
    assert by[2].text == '[redacted]" of' and by[2].n_chars == len(by[2].text)
    assert by[3].text == TEXTS[3]
