"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of n ids is cut into full sequences and then into the binary digits
of what is left, largest first. Every piece is a sequence of its own whose
length is a power of two; pieces of one length form a bucket, and a bucket's
sequences are dealt into batches of equal token count, so a training step reads
one length only. The whole operator is one narrow pass over the documents:
nothing is shuffled and no group is collected.

Texts are cut into words, dictionary-encoded and put together again by Arrow, so
that Python sees each distinct run of letters of a batch once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import no_collection, public_tokenizer, small_batches, table, trimmed

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Runs of letters or marks that a worker remembers, emptied when full; longer ones are not remembered.
PARTS, LONGEST_WORD = 400_000, 80
#: Documents of a batch: the more, the fewer distinct words are met again.
ROWS = 1000
#: Latin letters, then marks: the vocabulary's rules cut between the two, and lower-casing maps these letters one to one.
LETTERS_THEN_MARKS = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?*$%&#|]*)$"


def pieces(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of every piece: full sequences, then the binary digits of the rest, largest first."""
    full, rest = np.divmod(sizes, longest)
    digits = np.arange(longest.bit_length() - 2, -1, -1)
    doc, place = np.nonzero(rest[:, None] >> digits & 1)
    docs = np.concatenate([np.repeat(np.arange(len(sizes)), full), doc])
    order = np.argsort(docs, kind="stable")
    return docs[order], np.concatenate([np.full(full.sum(), longest), np.int64(1) << digits[place]])[order]


class WordEncoder:
    """Ids of whole texts, each distinct word of a batch encoded once by the tokenizers library, as it does by default.

    The vocabulary's rules never look across white space: it is dropped, and
    normalisation and merges stay within the words beside it. Texts are cut at
    blanks and line feeds; other white space stays within a word, for the
    library to drop.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For runs of lower-case letters or of marks, which normalisation and the splitting rules leave as they are: the same merges without those.
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {"": b""}

    def _parts(self, wanted: pa.Array) -> pa.Array:
        """Ids of runs of lower-case letters, or of marks: each is one word to the merges."""
        done = self.parts
        if len(done) > PARTS:
            done.clear()
            done[""] = b""
        words = wanted.to_pylist()
        found = list(map(done.get, words))
        gaps = [k for k, x in enumerate(found) if x is None]
        if gaps:
            # The last token of a word says so: one long text gives the ids of all.
            ids = np.array(self.merges.encode_batch_fast([" ".join([words[k] for k in gaps])], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            raw = ids.tobytes()
            for k, lo, hi in zip(gaps, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                found[k] = raw[lo:hi]
                if len(words[k]) <= LONGEST_WORD:
                    done[words[k]] = raw[lo:hi]
        return pa.array(found, pa.binary())

    def _odd(self, words: list[str]) -> pa.Array:
        """Ids of any other words, each by the library."""
        return pa.array([pack("<%dI" % len(e.ids), *e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)], pa.binary())

    def _words(self, words: pa.StringArray) -> pa.Array:
        """Ids of distinct words."""
        match = pc.extract_regex(words, LETTERS_THEN_MARKS)
        plain = match.is_valid()
        letters = pc.utf8_lower(match.field(0).filter(plain)).dictionary_encode()
        marks = match.field(1).filter(plain).dictionary_encode()
        parts = [self._parts(x.dictionary).take(x.indices) for x in (letters, marks)]
        odd = self._odd(words.filter(pc.invert(plain)).to_pylist())
        both = pa.concat_arrays([pc.binary_join_element_wise(*parts, b""), odd])
        rank = np.empty(len(words), np.int64)
        which = plain.to_numpy(zero_copy_only=False)
        rank[which], rank[~which] = np.arange(which.sum()), np.arange(which.sum(), len(words))
        return both.take(pa.array(rank))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, the end id behind each, and where each text's ids begin, with the end of all."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        words, ends = lists.flatten().dictionary_encode(), np.cumsum(pc.list_value_length(lists).to_numpy())
        known = pa.concat_arrays([self._words(words.dictionary), pa.array([pack("<I", end_id)], pa.binary())])
        # The end id is one more word behind each text.
        codes = np.insert(words.indices.to_numpy(), ends, len(known) - 1)
        raw = known.take(pa.array(codes))
        offsets = np.frombuffer(raw.buffers()[1], np.int32, len(codes) + 1)
        return np.frombuffer(raw.buffers()[2], "<u4", int(offsets[-1]) // 4), offsets[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])].astype(np.int64) // 4


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> WordEncoder:
    """One encoder a Python worker: later tasks find its words warm."""
    return WordEncoder(path)


def pack_documents(docs: DataFrame, *, tokenizer_path: str | None = None, end_id: int = END_ID, longest: int = 2048, batch_tokens: int = 1 << 16) -> DataFrame:
    """One row for each piece: doc_id, start, length, token_ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, bucket, batch_id.

    Null and empty texts are one piece that holds the end id. Repeated rows are
    packed each, in sequences of their own. sequence_id is unique; batch_id
    groups sequences of one bucket, and only the last batch of a bucket in each
    task is short. Other columns of docs are left out. longest must be a power
    of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = tokenizer_path or public_tokenizer(VOCABULARY)
    small_batches(docs.sparkSession, ROWS)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = worker_encoder(path), TaskContext.get().partitionId() << 33
        made, in_bucket = 0, np.zeros(longest.bit_length(), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            with no_collection():
                ids, bounds = encoder.encode(batch.column(1), end_id)
            doc, lengths = pieces(np.diff(bounds), longest)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            bucket = np.log2(lengths).astype(np.int64)
            full = np.empty(len(doc), np.int64)
            for k in np.unique(bucket).tolist():
                own = np.flatnonzero(bucket == k)
                full[own] = (in_bucket[k] + np.arange(len(own))) // max(1, batch_tokens >> k)
                in_bucket[k] += len(own)
            token_ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((4 * starts).astype(np.int32)), pa.py_buffer(ids)])
            columns = [starts[:-1] - bounds[doc], lengths, token_ids, np.diff(bounds)[doc], task + made + np.arange(len(doc)), np.zeros(len(doc), np.int64), bucket.astype(np.int32), task | bucket << 28 | full]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *(c if c is token_ids else pa.array(c) for c in columns)], names=NAMES)
            made += len(doc)

    schema = f"doc_id {id_type}, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long, bucket int, batch_id long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


NAMES = ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset", "bucket", "batch_id"]


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
