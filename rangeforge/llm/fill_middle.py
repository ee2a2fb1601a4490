"""Fill-in-the-middle transformation by a parallel automaton scan.

A text is cut into units (runs of letters, single other characters) and checked
for sentinel marks by one automaton of four states. A piece of a text can be
scanned without knowing what stands before it: for each state that it may be
entered in, it gives the state it leaves in and what it has counted on the way.
Such summaries compose associatively, so that

1. within a batch, all texts are laid out in lanes of LANE characters that are
   stepped through together, and a prefix composition over the lanes resolves the
   state in which each is entered;
2. a text of over CHUNK characters is cut into chunks that any task may scan;
   their summaries are composed for each text, which gives the number of units,
   the chunks that hold the two cuts and their entry states. Only those chunks
   are looked at again, by whichever tasks hold them, to select the cuts.

Cut places are characters (code points), and the pieces are put together by
column functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table, text_or_empty

#: Characters that are stepped through one after another; characters of a chunk of a long text.
LANE, CHUNK = 256, 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: States: after another character (and at the start), after a letter, after `<`, after `<P`, `<S` or `<M`.
OTHER, LETTER, OPEN, NAMED = range(4)
#: Characters: any other, a letter, one of P, S and M, `<`, `>`, and none (padding).
_OTHER, _LETTER, _NAME, _OPEN, _CLOSE, _NONE = range(6)
#: Units are counted in the low half of a number, sentinel marks in the high one.
MARK = 1 << 32


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of a character up to 127, next state, what is counted), the last two by 8 * state + class."""
    kinds = np.full(128, _OTHER, np.uint8)
    for c in range(128):
        if chr(c).isalpha():
            kinds[c] = _NAME if chr(c) in "PSM" else _LETTER
    kinds[ord("<")], kinds[ord(">")] = _OPEN, _CLOSE
    after, counted = np.zeros(32, np.uint8), np.zeros(32, np.int64)
    for state in range(4):
        for kind in range(6):
            at = 8 * state + kind
            inside = state in (LETTER, NAMED)
            if kind == _NONE:
                after[at] = state
            elif kind in (_LETTER, _NAME):
                after[at] = NAMED if kind == _NAME and state == OPEN else LETTER
                counted[at] = 0 if inside else 1
            else:
                after[at] = OPEN if kind == _OPEN else OTHER
                counted[at] = 1 + (MARK if kind == _CLOSE and state == NAMED else 0)
    return kinds, after, counted


def _classes(text: str) -> np.ndarray:
    return _automaton()[0][np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 127)]


def _lanes(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(lanes x LANE classes, first lane of each text and the end); every text has a lane at least."""
    ends = np.cumsum([0, *(max(1, -(-len(c) // LANE)) for c in classes)])
    out = np.full(int(ends[-1]) * LANE, _NONE, np.uint8)
    for c, lo in zip(classes, ends.tolist(), strict=False):
        out[lo * LANE : lo * LANE + len(c)] = c
    return out.reshape(-1, LANE), ends


def scan(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state after, counted) of each lane for each state it may be entered in."""
    _, after, counted = _automaton()
    state = np.tile(np.arange(4, dtype=np.uint8), (len(lanes), 1))
    total = np.zeros((len(lanes), 4), np.int64)
    for column in np.ascontiguousarray(lanes.T):
        at = 8 * state + column[:, None]
        total += counted[at]
        state = after[at]
    return state, total


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of each piece of `first` followed by the piece of `then` at the same place."""
    return np.take_along_axis(then[0], first[0].astype(np.int64), 1), first[1] + np.take_along_axis(then[1], first[0].astype(np.int64), 1)


def running(state: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summary of all pieces up to each one, itself included, by doubling steps."""
    step = 1
    while step < len(state):
        joined = compose((state[:-step], total[:-step]), (state[step:], total[step:]))
        state, total = np.concatenate([state[:step], joined[0]]), np.concatenate([total[:step], joined[1]])
        step *= 2
    return state, total


def _place(lane: np.ndarray, entry: int, rank: int) -> int:
    """Place in the lane of the character that begins unit `rank` (from 0) of those that begin there."""
    _, after, counted = _automaton()
    state = entry
    for i, kind in enumerate(lane.tolist()):
        rank -= int(counted[8 * state + kind]) & (MARK - 1)
        if rank < 0:
            return i
        state = int(after[8 * state + kind])
    raise ValueError("the lane has fewer units")


class Scan:
    """Texts (or chunks of them) scanned together; entries: the state in which each is entered, OTHER if not told."""

    def __init__(self, texts: list[str], entries: list[int] | None = None):
        self.lanes, self.ends = _lanes([_classes(t) for t in texts])
        self.lengths, first = [len(t) for t in texts], self.ends[:-1]
        entered = np.array(entries or [OTHER] * len(texts), np.int64)
        state, total = scan(self.lanes)
        # Entered in a known state, a text's first lane is a constant function, so that no state goes on from the text before.
        state[first], total[first] = state[first, entered][:, None], total[first, entered][:, None]
        state, total = running(state, total)
        self.state = np.concatenate([[OTHER], state[:-1, 0]]).astype(np.int64)
        self.state[first] = entered
        self.total = np.concatenate([[0], total[:, 0]])
        self.counts = self.total[self.ends[1:]] - self.total[first]

    def units(self) -> np.ndarray:
        return self.counts & (MARK - 1)

    def marks(self) -> np.ndarray:
        return self.counts >> 32

    def place(self, i: int, rank: int) -> int:
        """Characters of text i before the one that begins unit `rank` (from 0); all of them where it has no more units."""
        if rank >= int(self.units()[i]):
            return self.lengths[i]
        lo, hi = int(self.ends[i]), int(self.ends[i + 1])
        before = (self.total[lo:hi] - self.total[lo]) & (MARK - 1)
        lane = int(np.searchsorted(before, rank, side="right")) - 1
        return lane * LANE + _place(self.lanes[lo + lane], int(self.state[lo + lane]), rank - int(before[lane]))


_CUTS = "n long, marks long, cut_a long, cut_b long"


def _short_cuts(docs: DataFrame, text: str, h1: str, h2: str) -> DataFrame:
    """docs with the units and marks of the text and its two cuts, by one scan."""
    names = [*docs.columns, "n", "marks", "cut_a", "cut_b"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            done = Scan(batch.column(text).to_pylist())
            n = done.units()
            ranks = np.sort(np.stack([batch.column(h).to_numpy() % (n + 1) for h in (h1, h2)]), axis=0)
            cuts = [pa.array([done.place(i, int(r)) for i, r in enumerate(row)], pa.int64()) for row in ranks]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(done.marks()), *cuts], names=names)

    return docs.mapInArrow(measure, "".join(f"`{c}` {t}, " for c, t in docs.dtypes) + _CUTS)


def _long_cuts(docs: DataFrame, text: str, h1: str, h2: str, row: str, chunk: int) -> DataFrame:
    """As _short_cuts, but each text is cut into chunks that are dealt to all tasks. row: a number of each row of docs."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes, ends = _lanes([_classes(piece) for piece in batch.column(2).to_pylist()])
            state, total = scan(lanes)
            last = [[x[-1] for x in running(state[lo:hi], total[lo:hi])] for lo, hi in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([x[k].tolist() for x in last], pa.list_(pa.int64())) for k in range(2))], names=["row", "k", "ends", "counts"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, pieces, entries, ranks = (c.to_pylist() for c in batch.columns[2:])
            done = Scan(pieces, entries)
            places = [k * chunk + done.place(i, rank) for i, (k, rank) in enumerate(zip(ks, ranks, strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(places, pa.int64())], names=["row", "which", "place"])

    k = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length(`{text}`) - 1) div {chunk}"))).alias("k")
    chunks = docs.select(F.col(row).alias("row"), k, text).select("row", "k", F.substring(text, F.col("k") * chunk + 1, F.lit(chunk)).alias("piece"))
    chunks = cut(chunks.repartition("row", "k"))
    # A text has no more than 2^31 bytes, so these lists are short: at most 2^31 / chunk summaries of eight numbers.
    known = chunks.mapInArrow(summarise, "row long, k long, ends array<long>, counts array<long>").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ends", "counts"))).alias("parts"))
    step = """aggregate(parts, named_struct('state', 0L, 'total', 0L, 'entered', cast(array() as array<struct<k: bigint, state: bigint, before: bigint>>)), (x, p) -> named_struct(
        'state', p.ends[int(x.state)], 'total', x.total + p.counts[int(x.state)], 'entered', concat(x.entered, array(named_struct('k', p.k, 'state', x.state, 'before', x.total % 4294967296L)))))"""
    composed = known.select("row", F.expr(step).alias("x")).select("row", F.expr("x.total % 4294967296L").alias("n"), F.expr("x.total div 4294967296L").alias("marks"), "x.entered")
    ranked = docs.select(F.col(row).alias("row"), h1, h2).join(composed, "row").withColumn("ranks", F.sort_array(F.array(*(F.col(h) % (F.col("n") + 1) for h in (h1, h2)))))
    # The chunk that holds a cut is the last one with no more units before it than the cut's rank.
    wanted = ranked.select("row", F.posexplode("ranks").alias("which", "rank"), "entered").withColumn("at", F.element_at(F.expr("filter(entered, e -> e.before <= rank)"), -1))
    wanted = wanted.select("row", "which", F.col("at.k").alias("k"), F.col("at.state").alias("entry"), (F.col("rank") - F.col("at.before")).alias("rank"))
    found = wanted.join(chunks, ["row", "k"]).select("row", "which", "k", "piece", "entry", "rank").mapInArrow(select, "row long, which int, place long")
    cuts = found.groupBy("row").agg(F.min(F.when(F.col("which") == 0, F.col("place"))).alias("cut_a"), F.min(F.when(F.col("which") == 1, F.col("place"))).alias("cut_b"))
    named = ranked.select("row", "n", "marks").join(cuts, "row").withColumnRenamed("row", row)
    return docs.join(named, row)


def _group(key: Column, k: int) -> Column:
    """The k-th (from 1) eight-digit group of a hexadecimal digest as a number."""
    return F.conv(F.substring(key, 8 * k - 7, 8), 16, 10).cast("long")


def _restored(form: Column, output: Column) -> Column:
    """The text, from what was made of it: a text with marks of its own is plain, so the first mark of each kind is the right one."""
    after = lambda text, mark: F.substring(text, F.instr(text, mark) + len(mark), F.length(text))
    upto = lambda text, mark: F.substring(text, F.lit(1), F.instr(text, mark) - 1)
    psm = F.concat(upto(after(output, PREFIX), SUFFIX), after(output, MIDDLE), upto(after(output, SUFFIX), MIDDLE))
    spm = F.concat(upto(after(output, PREFIX), MIDDLE), after(output, MIDDLE), upto(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, *, plain_percent: int = 10, spm_percent: int = 20, chunk: int = CHUNK) -> DataFrame:
    """One row (doc_id, n, form, prefix_chars, middle_chars, output, restored) for each row of docs.

    n is the number of units. Cuts and form are drawn from a digest of the id,
    so that a rerun gives the same; a null id is drawn as the word `null`. Null
    texts count as empty, and an empty text or one with a sentinel mark of its
    own stays plain, with null lengths. Repeated rows give repeated results, an
    empty table none; other columns are left out. Texts of over `chunk`
    characters are scanned in chunks by many tasks; the result is the same.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    rows = docs.select("doc_id", text_or_empty().alias("text"), digest.alias("digest"))
    rows = rows.select("doc_id", "text", *(_group("digest", k).alias(f"h{k}") for k in range(1, 5)))
    # The long texts are written once, so that their numbers hold for all that is joined by them.
    long = cut(rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()))
    done = _short_cuts(rows.where(F.length("text") <= chunk), "text", "h1", "h2").unionByName(_long_cuts(long, "text", "h1", "h2", "row", chunk).select(*rows.columns, "n", "marks", "cut_a", "cut_b"))
    plain = (F.col("text") == "") | (F.col("marks") > 0) | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    a, b = F.col("cut_a").cast("int"), F.col("cut_b").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    made = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    made = made.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    own = F.col("form") != "plain"
    cuts = done.withColumn("form", form).withColumn("output", made)
    return cuts.select("doc_id", "n", "form", F.when(own, F.col("cut_a")).alias("prefix_chars"), F.when(own, F.col("cut_b") - F.col("cut_a")).alias("middle_chars"), "output", _restored(F.col("form"), F.col("output")).alias("restored"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM documents),
u AS (SELECT doc_id, text, length(regexp_replace(text, '[A-Za-z]+', 'a', 'g')) AS n, ('0x' || digest[1:8])::UBIGINT AS h1, ('0x' || digest[9:16])::UBIGINT AS h2, ('0x' || digest[17:24])::UBIGINT AS h3, ('0x' || digest[25:32])::UBIGINT AS h4 FROM d),
r AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM r),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM t)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
