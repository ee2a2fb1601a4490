"""Packing and byte-level BPE against the tokenizers and tiktoken libraries."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rangeforge.llm.byte_bpe import Decoder, decode_documents, encode_documents, load_ranks, op3_byte_bpe, worker_encoder
from rangeforge.llm.packing import END_ID, VOCABULARY, op2_packing, pack_documents, pieces
from rangeforge.llm.packing import worker_encoder as word_encoder

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  ", "áb  ́", "ÀÉ <|endoftext|> x", "日本語 😀👍🏽", "x" * 5000, "don't I'll  \n\n we've\t\r\n  ", "word " * 3000, "aaaaaaaaaaaaaaaa bbbbb"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "a", "b") for i, t in enumerate(ODD)] + [(3, ODD[3], None, None), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, token_ids string, length string")


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def reference_bpe():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def piece_lengths(n, longest):
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def test_piece_lengths():
    assert piece_lengths(1, 2048) == [1] and piece_lengths(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1]
    for longest in (1, 2, 16, 64):
        doc, length = pieces(np.arange(1, 200), longest)
        assert [(d, k) for d, k in zip(doc.tolist(), length.tolist(), strict=True)] == [(n - 1, k) for n in range(1, 200) for k in piece_lengths(n, longest)]


@given(st.lists(st.text(st.sampled_from("aAÀéß日9 \t\n\x1c\xa0\u0301.,!?*|<>'-") | st.characters(exclude_categories=["Cs"])) | st.sampled_from([None, "<|endoftext|>", "x<|startoftext|>Y <|ENDOFTEXT|>", "it's I'M"]), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_words_together_equal_the_library(texts):
    ids, bounds = word_encoder(public_tokenizers.path(VOCABULARY)).encode(pa.array(texts, pa.string()), END_ID)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == whole_ids(texts)


def test_packing_covers_every_id_once(spark, odd):
    rows = pack_documents(odd, longest=256).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length == 1 << r.bucket for r in rows)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc, text in [*enumerate(ODD), (None, "no id")]:
        expected, copies = whole_ids([text])[0], 2 if doc == 3 else 1
        assert len(by_doc[doc]) == copies * len(piece_lengths(len(expected), 256))
        got = sorted({(r.start, bytes(r.token_ids)) for r in by_doc[doc]})
        assert list(struct.unpack(f"<{len(expected)}I", b"".join(x for _, x in got))) == expected


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = set()
    for d, ids in zip(docs, whole_ids([d.text for d in docs]), strict=True):
        at = 0
        for k in piece_lengths(len(ids), 2048):
            expected.add((d.doc_id, at, k, zlib.crc32(struct.pack(f"<{k}I", *ids[at : at + k])), len(ids)))
            at += k
    rows = op2_packing(spark, SF).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows} == expected and len(rows) == len(expected)


def test_bpe_query(spark):
    bpe = reference_bpe()
    got = {r.doc_id: r for r in op3_byte_bpe(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = bpe.encode_ordinary(d.text or "")
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_bpe_odd_rows(spark, odd):
    rows = decode_documents(encode_documents(odd), chunk=3).collect()
    assert sorted((r.text for r in rows)) == sorted((t or "") for t in [*ODD, ODD[3], "no id"])
    assert encode_documents(odd.limit(0)).collect() == [] and pack_documents(odd.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="abtheinor '\n", max_size=60)))
def test_bpe_equals_library(text):
    encoder = worker_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = encoder.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference_cached().encode_ordinary(text)


_CACHE = []


def reference_cached():
    if not _CACHE:
        _CACHE.append(reference_bpe())
    return _CACHE[0]


def test_bounded_memory_within_one_word(monkeypatch):
    from rangeforge.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "STATES", 200)
    monkeypatch.setattr(byte_bpe, "LOOKBACK", 50)
    rng = random.Random(3)
    encoder = byte_bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for n in (10, 3000, 20000):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n))
        ids = encoder.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference_cached().encode_ordinary(text)
    assert len(encoder.words.transducer.prefixes) <= 402


def test_decoder_replaces_what_is_not_utf8():
    ranks, rng = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(1)
    decoder = Decoder({i: t for t, i in ranks.items()})
    for _ in range(2000):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE0, 0xA0, 0x80, 0xF0, 0x9F, 0x98, 0xFF, 0xED, 0xBF]) for _ in range(rng.randint(0, 12)))
        ids = [ranks[data[i : i + 1]] for i in range(len(data))]
        k = rng.randint(0, len(ids))
        assert decoder.feed(ids[:k]) + decoder.feed(ids[k:]) + decoder.finish() == data.decode("utf-8", "replace")
