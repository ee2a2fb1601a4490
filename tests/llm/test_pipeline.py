"""The pipeline against a plain version of its stages, stage by stage and as a whole."""

import re
import zlib

import corpus_pipeline
import pytest

from rangeforge.llm.secret_scan import find_secrets, infer_formats, redact
from tests.llm.test_tokens import piece_lengths, whole_ids

SF = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]+"


def passes(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(w) < 10:
        return False
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    again = {x for x in windows if windows.count(x) > 1}
    covered = {i + k for i, x in enumerate(windows) if x in again for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    caps = sum(not any(c.islower() for c in x) and sum(c.isupper() for c in x) > 1 for x in w)
    return not (100 * len(covered) > 20 * len(w) or 100 * len(re.findall(r"[#*$%&|<>]", text)) > 25 * len(w) or 2 * (len(lines) - len(set(lines))) > len(lines) or 2 * caps > len(w))


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / max(1, len(x | y))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, docs := spark.read.parquet(path))
    return out


def test_stages_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns


def test_quality_rules(stages):
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages["quality_rules"])
    assert after == {k: r for k, r in before.items() if passes(r.text)}


def test_exact_dedup(stages):
    before, after = (d.collect() for d in stages["exact_dedup"])
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(re.sub(SPACE, " ", r.text), r)
    assert sorted(after, key=lambda r: r.doc_id) == sorted(first.values(), key=lambda r: r.doc_id)


def test_near_dedup(stages):
    before, after = (d.collect() for d in stages["near_dedup"])
    left = {r.doc_id for r in after}
    assert len(left) == len(after) and set(after) <= set(before)
    near = lambda r, s: jaccard(r.text, s.text)
    for r in before:
        others = [near(r, s) for s in before if s.doc_id < r.doc_id]
        if r.doc_id not in left:
            assert max(near(r, s) for s in before if s.doc_id != r.doc_id) > 0.55
        elif others:
            assert max(others) < 0.85


def test_secret_scan(stages):
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages["secret_scan"])
    formats = infer_formats()
    assert before.keys() == after.keys()
    for k, r in before.items():
        text = redact(r.text, find_secrets(r.text, formats), "[redacted]")
        assert after[k].text == text and (text == r.text or after[k].n_chars == len(text))
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", text)


def test_packing(stages):
    before, after = (d.collect() for d in stages["packing"])
    got = {(r.doc_id, r.start, r.length, zlib.crc32(bytes(r.token_ids))) for r in after}
    expected = set()
    for r, ids in zip(before, whole_ids([r.text for r in before]), strict=True):
        at = 0
        for k in piece_lengths(len(ids), 2048):
            expected.add((r.doc_id, at, k, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + k]))))
            at += k
    assert got == expected


def test_run(spark, stages):
    columns = ["doc_id", "start", "length", "token_ids"]
    got = corpus_pipeline.run(spark, SF).select(columns).collect()
    assert sorted(got) == sorted(stages["packing"][1].select(columns).collect())
