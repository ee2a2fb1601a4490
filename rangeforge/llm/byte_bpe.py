"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding. A prefix of a word has one valid encoding, and every pair of
neighbours in a valid encoding is itself the encoding of the two tokens' bytes.
So the encodings of all prefixes can be extended byte by byte: a state is the set
of open prefixes (those from which a token may still grow), each as the trie
node of the bytes since its end and the last token of its encoding. Reading a
byte leads to the next set and writes the last token of the prefix that ends
here; tokens are emitted, by following these back, up to the last boundary that
all open prefixes share: the lookahead is bounded by the longest token. States
and their arcs are made when first met and kept in bounded memory.

Decoding. An incremental UTF-8 machine whose arcs are whole tokens: the state is
the bytes of the character that is still open (at most three), and an arc gives
the text that a token completes. Its arcs, too, are made when first met.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import no_collection, public_tokenizer, small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bounds on what a worker remembers: states, token pairs, words (all emptied when one is full), decoding arcs.
STATES, PAIRS, WORDS, ARCS = 450_000, 600_000, 600_000, 150_000
LONGEST_WORD = 60
#: Bytes of a word after which settled tokens are emitted.
LOOKBACK = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int, parts_left: int = 1) -> list[int]:
    """Plain BPE with the ranks under a bound, lowest first; it tells which two tokens a token is made of."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > parts_left:
        rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.next: dict[int, int] = {}  # (node << 8 | byte) to node; node 0 is the root
        self.ends: list[int] = [-1]  # the token that ends at a node
        self.depth: list[int] = [0]
        self.inner: list[bool] = [True]  # whether longer tokens go on from a node
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                to = self.next.get(node << 8 | byte)
                if to is None:
                    to = self.next[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(False)
                node = to
            self.ends[node] = rank
        self.below: dict[int, list[int]] = {}  # tokens of three bytes or more, by the node of their first two
        for token, rank in ranks.items():
            if len(token) > 2:
                self.below.setdefault(self.next[self.next[token[0]] << 8 | token[1]], []).append(rank)
        self.halves: dict[int, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.grows: dict[tuple[int, int], bool] = {}
        # State 0 is the start. A state's prefixes are node << 32 | last token + 1; the last one ends where the state stands.
        self.prefixes: list[tuple[int, ...]] = []
        self.states: dict[tuple[int, ...], int] = {}
        self.last: list[int] = []  # last token of the encoding that ends in a state
        self.arcs: dict[int, int] = {}  # (state << 8 | byte) to state
        self.forget()

    def full(self) -> bool:
        return len(self.prefixes) > STATES or len(self.pairs) > PAIRS or len(self.grows) > PAIRS

    def forget(self) -> None:
        """Begins anew, with no states or pairs known."""
        for known in (self.pairs, self.grows, self.prefixes, self.states, self.last, self.arcs):
            known.clear()
        self._state((0,), -1)

    def _state(self, prefixes: tuple[int, ...], last: int) -> int:
        number = self.states[prefixes] = len(self.prefixes)
        self.prefixes.append(prefixes)
        self.last.append(last)
        return number

    def _halves(self, token: int) -> list[int]:
        """The tokens that its last merge joins; one token if it is a byte, more than two if merges never reach it."""
        known = self.halves.get(token)
        if known is None:
            known = self.halves[token] = merge_by_rank(self.token[token], self.ranks, token)
        return known

    def _follows(self, left: int, right: int) -> bool:
        """Whether merges leave both tokens as they are when one stands behind the other.

        Undoes merges along the seam, the latest first. Two neighbours at the
        seam would merge if their pair's rank comes before the merge that takes
        the left one away, or no later than the one that takes the right one,
        as equal ranks merge from the left.
        """
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = len(self._halves(right)) <= 2 and (left < 0 or self._apart(left, right))
        return known

    def _apart(self, a: int, b: int) -> bool:
        a_gone = b_gone = len(self.ranks)
        while True:
            rank = self.ranks.get(self.token[a] + self.token[b])
            if rank is not None and rank < a_gone and rank <= b_gone:
                return False
            left, right = self._halves(a), self._halves(b)
            if len(left) == 2 and (a > b or len(right) == 1):
                a_gone, a = a, left[1]
            elif len(right) == 2:
                b_gone, b = b, right[0]
            else:
                return True

    def _can_grow(self, left: int, node: int) -> bool:
        """Whether any token that goes on from this node of two bytes may stand behind the left one; a prefix that can't grow is closed early."""
        found = self.grows[left, node] = any(self._apart(left, t) for t in self.below[node] if len(self._halves(t)) <= 2)
        return found

    def _arc(self, state: int, byte: int) -> int:
        ended, opened = -1, []
        follow, ends, inner, pairs, below, grows = self.next.get, self.ends, self.inner, self.pairs, self.below, self.grows
        for prefix in self.prefixes[state]:
            node = follow(prefix >> 32 << 8 | byte)
            if node is None:
                continue
            left = (prefix & 0xFFFFFFFF) - 1
            if ended < 0 and (token := ends[node]) >= 0:
                fits = pairs.get((left, token))
                if self._follows(left, token) if fits is None else fits:
                    ended = token
            if inner[node]:
                if left >= 0 and node in below:
                    alive = grows.get((left, node))
                    if not (self._can_grow(left, node) if alive is None else alive):
                        continue
                opened.append(node << 32 | left + 1)
        if ended < 0:
            raise ValueError(f"no token for byte {byte}; the vocabulary must hold all 256 bytes")
        opened.append(ended + 1)
        key = tuple(opened)
        target = self.states.get(key)
        if target is None:
            if len(self.prefixes) > 2 * STATES or len(self.pairs) > 2 * PAIRS:  # within one very long word
                self.forget()
                return self._state(key, ended)
            target = self._state(key, ended)
        self.arcs[state << 8 | byte] = target
        return target

    def _back(self, lasts: list[int], end: int) -> list[int]:
        """Tokens of the prefix that ends at `end`, the last one first."""
        token, out = self.token, []
        while end:
            out.append(lasts[end - 1])
            end -= len(token[out[-1]])
        return out

    def _settled(self, lasts: list[int], state: int) -> list[int]:
        """Tokens that all open prefixes share, in order; their bytes leave lasts."""
        paths = [self._back(lasts, len(lasts) - self.depth[p >> 32])[::-1] for p in self.prefixes[state]]
        shared = 0
        while all(shared < len(p) and p[shared] == paths[0][shared] for p in paths):
            shared += 1
        del lasts[: sum(len(self.token[t]) for t in paths[0][:shared])]
        return paths[0][:shared]

    def encode(self, piece: bytes) -> list[int]:
        arcs, last, state, lasts, out = self.arcs.get, self.last, 0, [], []
        for byte in piece:
            arc = state << 8 | byte
            state = arcs(arc)
            if state is None:
                state = self._arc(arc >> 8, byte)
            lasts.append(last[state])
            if len(lasts) > LOOKBACK:
                out += self._settled(lasts, state)
        return out + self._back(lasts, len(lasts))[::-1]


class Words(dict):
    """Ids of words as bytes; a word that isn't there runs through the transducer.

    When full, words, states and pairs are all forgotten at once, so that their
    memory comes back in whole; what is in use is soon learned again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.transducer = ranks, Transducer(ranks)

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        whole = self.ranks.get(raw)
        found = self.transducer.encode(raw) if whole is None else [whole]
        ids = pack("<%dI" % len(found), *found)
        if len(self) >= WORDS or self.transducer.full():
            self.clear()
            self.transducer.forget()
        if len(word) <= LONGEST_WORD:
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str, pattern: str):
        import regex

        self.find, self.words = regex.compile(pattern).findall, Words(load_ranks(path))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(text)))


@lru_cache(maxsize=1)
def worker_encoder(path: str, pattern: str) -> Encoder:
    """One encoder a Python worker: later tasks find its states and words warm."""
    return Encoder(path, pattern)


class Decoder:
    """Text of token ids, given in chunks of any length. Bytes that are not UTF-8 become U+FFFD as in Python's own decoder."""

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.arcs: dict[bytes, dict[int, tuple[bytes, str]]] = {}
        self.made = 0
        self.state = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """Bytes at the end that begin a character and can still become a valid one."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead < 0x80 or 0xC0 <= lead < 0xC2 or lead > 0xF4:
                return 0
            if lead >= 0xC2:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                if back >= need:
                    return 0
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                return back if back == 1 or low <= data[-back + 1] <= high else 0
        return 0

    def _arc(self, state: bytes, token: int) -> tuple[bytes, str]:
        if self.made >= ARCS:
            self.arcs, self.made = {}, 0
        data = state + self.token[token]
        keep = self._open(data)
        arc = (data[len(data) - keep :], data[: len(data) - keep].decode("utf-8", "replace"))
        self.arcs.setdefault(state, {})[token] = arc
        self.made += 1
        return arc

    def feed(self, ids: Iterable[int]) -> str:
        state, out = self.state, []
        arcs = self.arcs.get(state, {})
        for token in ids:
            arc = arcs.get(token) or self._arc(state, token)
            out.append(arc[1])
            if arc[0] != state or not arcs:
                state = arc[0]
                arcs = self.arcs.setdefault(state, {})
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        rest, self.state = self.state, b""
        return rest.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def worker_decoder(path: str) -> Decoder:
    return Decoder({i: t for t, i in load_ranks(path).items()})


def encode_documents(docs: DataFrame, *, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row (doc_id, token_ids) for each row of docs; token_ids are little-endian unsigned 32-bit.

    Null and empty texts have no ids. Repeated rows are encoded each; other
    columns are left out. Narrow: nothing is shuffled.
    """
    import public_tokenizers

    path, pattern = ranks_path or public_tokenizer(VOCABULARY), pattern or public_tokenizers.PATTERN
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, pattern)
        for batch in batches:
            with no_collection():
                ids = [encoder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "token_ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, token_ids binary")


def decode_documents(encoded: DataFrame, *, ranks_path: str | None = None, chunk: int = 1 << 16) -> DataFrame:
    """One row (doc_id, token_ids, text) for each row of encoded. Ids are read in chunks; null ids give empty text."""
    path = ranks_path or public_tokenizer(VOCABULARY)
    small_batches(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker_decoder(path)
        decoder.finish()
        for batch in batches:
            texts = [_decoded(decoder, ids, chunk) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "token_ids", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(decode, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, token_ids binary, text string")


def round_trip(docs: DataFrame, *, ranks_path: str | None = None, pattern: str | None = None, chunk: int = 1 << 16) -> DataFrame:
    """One row (doc_id, token_ids, text) for each row of docs: encoded, and decoded from the ids in chunks, in one worker."""
    import public_tokenizers

    path, pattern = ranks_path or public_tokenizer(VOCABULARY), pattern or public_tokenizers.PATTERN
    small_batches(docs.sparkSession)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = worker_encoder(path, pattern), worker_decoder(path)
        for batch in batches:
            with no_collection():
                ids = [encoder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([_decoded(decoder, x, chunk) for x in ids], pa.string())], names=["doc_id", "token_ids", "text"])

    return docs.select("doc_id", "text").mapInArrow(both, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, token_ids binary, text string")


def _decoded(decoder: Decoder, ids: bytes | None, chunk: int) -> str:
    view = memoryview(ids or b"").cast("I")
    return "".join([decoder.feed(view[k : k + chunk]) for k in range(0, len(view), chunk)]) + decoder.finish()


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(table(spark, sf_dir, "documents"))
    return both.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))
