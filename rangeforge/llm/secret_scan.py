"""Secret scans: fixed patterns, and formats inferred from labelled credentials.

Grammar inference. Labelled credentials are written in symbols (their first
characters as they are, the others by class) and put into a prefix tree with
counts. Two states whose continuations could come from one distribution (the
Hoeffding test, in each symbol and the end, and so on below) are merged, which
turns the tree into a probabilistic automaton with loops. A second automaton is
inferred from words that are no credentials. Every candidate of a text (a run of
the characters that credentials are made of, of any length), and what base spans
leave of one, is scored by the log-likelihood ratio of the two: those that pass
the bar both a symbol and in all, as credentials are rare, are spans of kind
"format". A batch's distinct candidates are scored together, walking both
automata one symbol at a time over all of them.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, trimmed

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CUES = ("passw", "secret", "token", "key")
#: Characters of credentials; a candidate is a run of them without the marks in TAIL at its end.
CHARACTERS = string.ascii_letters + string.digits + "+/_.=-"
TAIL = ".-="
CANDIDATE = re.compile("[A-Za-z0-9+/_.=-]+")
FREE = re.compile(b"\0+")
#: Symbols that stay as they are at the start of a credential; a bound on what is inferred from; the bar for a span, a symbol and in all.
HEAD, SAMPLES, SEED, ALPHA, BAR, EVIDENCE = 4, 1320, 7, 0.05, 0.5, 8.0
#: Candidates over this length are scored one by one.
LONG = 512


def symbols(text: str, head: int = HEAD) -> list[str]:
    """The first `head` characters as they are, then classes: a for letters of hexadecimal digits, z for other small letters, Z for capitals, 0 for digits."""
    return [*text[:head], *("0" if c.isdigit() else "a" if c in "abcdef" else "z" if c.islower() else "Z" if c.isupper() else c for c in text[head:])]


#: Characters of a class.
SIZES = {"0": 10, "a": 6, "z": 20, "Z": 26}


def labelled_credentials(samples: int = SAMPLES, seed: int = SEED) -> tuple[list[str], list[str]]:
    """(credentials, other words) of public formats, made from a seed. Stands in for a labelled set, which a caller may give instead."""
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    formats = [
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "gho_" + pick(alnum, 36),
        lambda: f"xoxb-{pick(string.digits, 11)}-{pick(string.digits, 12)}-{pick(alnum, 24)}",
        lambda: "sk_live_" + pick(alnum, 24),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: f"eyJ{pick(alnum, 33)}.eyJ{pick(alnum, rng.randint(30, 60))}.{pick(alnum + '_-', 43)}",
        lambda: "glpat-" + pick(alnum, 20),
        lambda: pick("0123456789abcdef", rng.choice((32, 40, 64))),
        lambda: pick("0123456789ABCDEF", rng.choice((32, 40, 64))),
        lambda: pick(b64, 40),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
    ]
    credentials = [make() for make in formats for _ in range(samples // len(formats))]
    syllables = "an er on in re the ti st en ou ed ing tion and ha le es ra co de lich keit ung ment eau".split()
    def word() -> str:
        w, v = ("".join(rng.choice(syllables) for _ in range(n)) for n in (rng.randint(1, 9), rng.randint(1, 4)))
        digits = lambda n: pick(string.digits, n)
        return rng.choice((
            w, w, w.title(), w.upper(), w[:2].upper() + w[2:], w + v.title(), f"{w}-{v}", f"{w}_{v}", f"{w}.{v}", f"{w}/{v}", f"www.{w}.com/{digits(5)}", f"{v}{digits(rng.randint(0, 2))}.{w}.{rng.choice(('com', 'org', 'net'))}", f"{v}{digits(rng.randint(1, 4))}",
            digits(rng.randint(1, 16)), f"20{digits(2)}-{digits(2)}-{digits(rng.choice((2, 8)))}", f"+{digits(2)}-{digits(3)}-{digits(7)}", f"{digits(1)}.{digits(2)}.{digits(1)}",
        ))

    return credentials, [word() for _ in range(2 * samples)]


@dataclass
class Node:
    ended: int = 0
    passed: int = 0
    arcs: dict[str, int] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton, merged from the prefix tree of samples in canonical order (red and blue states).

    One with head 0 knows classes only: each of the first HEAD characters of a
    text then has an equal share of its class, so that likelihoods compare.
    """

    def __init__(self, samples: Iterable[str], alpha: float = ALPHA, head: int = HEAD):
        self.alpha, self.head = alpha, head
        self.nodes = [Node()]
        for text in samples:
            at = 0
            for s in symbols(text, head):
                node = self.nodes[at]
                node.passed += 1
                node.counts[s] = node.counts.get(s, 0) + 1
                if s not in node.arcs:
                    node.arcs[s] = len(self.nodes)
                    self.nodes.append(Node())
                at = node.arcs[s]
            self.nodes[at].passed += 1
            self.nodes[at].ended += 1
        self.alphabet = len({s for n in self.nodes for s in n.arcs}) + 1
        self._merge_states()
        self.cost = [{s: math.log((k + 0.5) / (n.passed + 0.5 * (self.alphabet + 1))) for s, k in n.counts.items()} for n in self.nodes]
        self.missing = [math.log(0.5 / (n.passed + 0.5 * (self.alphabet + 1))) for n in self.nodes]

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        if not n or not m:
            return False
        return abs(a / n - b / m) > (math.sqrt(1 / n) + math.sqrt(1 / m)) * math.sqrt(0.5 * math.log(2 / self.alpha))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            p, q = self.nodes[x], self.nodes[y]
            if self._differ(p.ended, p.passed, q.ended, q.passed) or any(self._differ(p.counts.get(s, 0), p.passed, q.counts.get(s, 0), q.passed) for s in p.counts.keys() | q.counts.keys()):
                return False
            todo += [(p.arcs[s], q.arcs[s]) for s in p.arcs.keys() & q.arcs.keys() if p.arcs[s] != q.arcs[s]]
        return True

    def _fold(self, red: int, tree: int) -> None:
        """Adds a subtree's counts to a state and what lies below it."""
        todo = [(red, tree)]
        while todo:
            x, y = todo.pop()
            p, q = self.nodes[x], self.nodes[y]
            p.ended, p.passed = p.ended + q.ended, p.passed + q.passed
            for s, to in q.arcs.items():
                p.counts[s] = p.counts.get(s, 0) + q.counts[s]
                if s in p.arcs:
                    todo.append((p.arcs[s], to))
                else:
                    p.arcs[s] = to

    def _merge_states(self) -> None:
        red = [0]
        while True:
            blue = sorted({(to, r, s) for r in red for s, to in self.nodes[r].arcs.items() if to not in red})
            if not blue:
                break
            to, parent, s = blue[0]
            same = next((r for r in red if self._compatible(r, to)), None)
            if same is None:
                red.append(to)
            else:
                self.nodes[parent].arcs[s] = same
                self._fold(same, to)
        self.states = red

    def total(self, text: str) -> float:
        """Log-likelihood. A symbol that a state hasn't seen costs its escape, and the walk goes on from the same state."""
        at, total = 0, 0.0
        for k, s in enumerate(symbols(text, self.head)):
            total += self.cost[at].get(s, self.missing[at])
            if self.head <= k < HEAD:
                total -= math.log(SIZES.get(s, 1))
            at = self.nodes[at].arcs.get(s, at)
        return total

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(next state, cost) by state and place of the symbol in CHARACTERS; states are numbered from 0, the start."""
        number = {x: k for k, x in enumerate(self.states)}
        onward = np.repeat(np.arange(len(self.states))[:, None], len(CHARACTERS), axis=1)
        cost = np.repeat(np.array([self.missing[x] for x in self.states])[:, None], len(CHARACTERS), axis=1)
        for x, k in number.items():
            for s, c in self.cost[x].items():
                cost[k, CHARACTERS.index(s)] = c
                onward[k, CHARACTERS.index(s)] = number[self.nodes[x].arcs[s]]
        return onward, cost


_PLACE = np.zeros(256, np.int64)
_PLACE[list(CHARACTERS.encode())] = np.arange(len(CHARACTERS))
_CLASS = np.array([CHARACTERS.index(symbols(c, 0)[0]) for c in CHARACTERS])
_SHARE = np.array([math.log(SIZES.get(c, 1)) for c in CHARACTERS])


@dataclass(frozen=True)
class Formats:
    credential: Automaton
    other: Automaton
    bar: float = BAR
    evidence: float = EVIDENCE

    def totals(self, words: pa.Array) -> np.ndarray:
        """Log-likelihood ratios of words of CHARACTERS, all walked together."""
        walks = [(automaton, automaton.tables()) for automaton in (self.credential, self.other)]
        words = words.cast(pa.binary())
        size = pc.binary_length(words).to_numpy().astype(np.int64)
        begin = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1 + words.offset)[words.offset : -1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
        out = np.zeros(len(words))
        order = np.argsort(-size, kind="stable")
        order = order[np.searchsorted(-size[order], -LONG) :]
        ends = np.searchsorted(-size[order], -np.arange(int(size[order[0]]) if len(order) else 0))
        at, total = [np.zeros(len(order), np.int64) for _ in walks], [np.zeros(len(order)) for _ in walks]
        for k, n in enumerate(ends.tolist()):
            place = _PLACE[data[begin[order[:n]] + k]]
            for j, (automaton, (onward, cost)) in enumerate(walks):
                mark = place if k < automaton.head else _CLASS[place]
                total[j][:n] += cost[at[j][:n], mark]
                if automaton.head <= k < HEAD:
                    total[j][:n] -= _SHARE[mark]
                at[j][:n] = onward[at[j][:n], mark]
        out[order] = total[0] - total[1]
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = self.total(words[k].as_py().decode())
        return out

    def total(self, text: str) -> float:
        return self.credential.total(text) - self.other.total(text)

    def score(self, text: str) -> float:
        """The ratio a symbol; 0 if it lacks evidence in all."""
        total = self.total(text)
        return total / len(text) if total > self.evidence else 0.0

    def passing(self, texts: pa.Array) -> dict[str, float]:
        """The candidates of texts that pass, with their scores."""
        runs = pc.split_pattern(pc.replace_substring_regex(pc.fill_null(texts, ""), "[^A-Za-z0-9+/_.=-]+", " "), " ").flatten().unique()
        words = pc.utf8_rtrim(runs, TAIL).unique()
        words = words.filter(pc.match_substring_regex(words, "[A-Za-z0-9]"))
        if not len(words):
            return {}
        total = self.totals(words)
        score = total / pc.binary_length(words).to_numpy()
        good = np.flatnonzero((total > self.evidence) & (score > self.bar))
        return dict(zip(words.take(pa.array(good)).to_pylist(), score[good].tolist(), strict=True))


def infer_formats(credentials: list[str] | None = None, others: list[str] | None = None) -> Formats:
    made = labelled_credentials()
    return Formats(Automaton(credentials or made[0]), Automaton(others or made[1], head=0))


def find_secrets(text: str, formats: Formats, passing: dict[str, float] | None = None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind. Base spans have score 1; format spans touch no base span. passing: as formats.passing gives it for texts with this one."""
    if passing is None:
        passing = formats.passing(pa.array([text]))
    spans, small = [], text.lower()
    if any(cue in small for cue in CUES):
        spans += [("assign", m.start(), m.end(), 1.0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), 1.0) for m in ACCESS.finditer(text)]
    base = spans + [("hex", m.start(), m.end(), 1.0) for m in HEX.finditer(text)]
    if not base and not any(word in text for word in passing):
        return []
    taken = bytearray(len(text))
    for _, a, b, _ in base:
        taken[a:b] = b"\1" * (b - a)
    more = []
    for m in CANDIDATE.finditer(text):
        for a, b in [f.span() for f in FREE.finditer(taken, m.start(), m.end())]:
            if b - a == m.end() - m.start():
                word = text[a:b].rstrip(TAIL)
                if word in passing:
                    more.append(("format", a, a + len(word), passing[word]))
                continue
            # Beside a base span a mark parts two credentials; where that gives none, it may belong to one.
            inner = text[a:b].lstrip("+/_.=-")
            for start, word in ((b - len(inner), inner.rstrip("+/_.=-")), (a, text[a:b].rstrip(TAIL))):
                # Lines of marks alone hold nothing to score.
                if any(c.isalnum() for c in word) and (score := formats.score(word)) > formats.bar:
                    more.append(("format", start, start + len(word), score))
                    break
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def secrets_of(texts: pa.Array, formats: Formats) -> list[list[tuple[str, int, int, float]]]:
    """find_secrets of each text; null and empty texts have none."""
    passing = formats.passing(texts)
    return [find_secrets(t, formats, passing) if t else [] for t in texts.to_pylist()]


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan_secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """One row (doc_id, spans) for each row of docs; places count code points, the end is exclusive.

    Null and empty texts have no spans. Repeated rows are scanned each; other
    columns are left out. Narrow: nothing is shuffled.
    """
    formats = formats or infer_formats()
    small_batches(docs.sparkSession)

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans] for spans in secrets_of(batch.column(1), formats)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact(text: str, spans: list[tuple[str, int, int, float]], mark: str) -> str:
    """text with every run of overlapping spans replaced by the mark."""
    out, at = [], 0
    runs: list[list[int]] = []
    for _, a, b, _ in spans:
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, formats: Formats | None = None, *, mark: str = "[redacted]") -> DataFrame:
    """docs with secrets in text replaced by the mark; every row and column stays. n_chars, where there is one, follows a text that changed."""
    formats = formats or infer_formats()
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    counts = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    @trimmed
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [redact(t, spans, mark) if spans else t for t, spans in zip(old, secrets_of(batch.column(at), formats), strict=True)]
            columns = batch.columns
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if counts is not None:
                columns[counts] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[counts].to_pylist(), old, new, strict=True)], batch.schema.field(counts).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "format")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
