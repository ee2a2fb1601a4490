"""Frame-ordered operators: consensus, smoothing, runs. Frames are counted, not timed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grids import LIT
from .ordered import carried


def global_consensus(states: DataFrame, keys: list[str], frac: float) -> DataFrame:
    """(keys, iu, iv, share): cells lit in more than `frac` of all frames of the recording; absent rows count as not lit."""
    frames = states.groupBy(*keys).agg(F.count_distinct("frame_idx").alias("frames"))
    lit = states.where(F.col("st") == LIT).groupBy(*keys, "iu", "iv").agg(F.count("*").alias("lit"))
    return lit.join(frames, keys).withColumn("share", F.col("lit") / F.col("frames")).where(F.col("share") > frac)


def sliding_consensus(states: DataFrame, key: str, size: int, frac: float, *, current: bool, lag: int = 1) -> DataFrame:
    """(key, frame_idx, iu, iv, share): cells lit in more than `frac` of the last `size` frames, with or without the current one.

    Frames are numbered without gaps (seq). A lit row is emitted once for each
    window that holds it, which counts absent rows as zeros without a grid
    of all cells and frames; frames before the window is full give nothing.
    """
    frames = states.select(key, "frame_idx").distinct()
    frames = frames.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("frame_idx")))
    start = 0 if current else lag
    lit = states.where(F.col("st") == LIT).join(frames, [key, "frame_idx"]).select(key, "iu", "iv", F.explode(F.sequence(F.col("seq") + start, F.col("seq") + start + size - 1)).alias("seq"))
    share = lit.groupBy(key, "seq", "iu", "iv").agg((F.count("*") / size).alias("share")).where(F.col("share") > frac)
    full = frames.where(F.col("seq") >= size + start)
    return share.join(full, [key, "seq"]).select(key, "frame_idx", "iu", "iv", "share")


def shadows_and_objects(states: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, iu, iv, kind): shadow where the reference is lit and the cell is not (open cells too), object where it is lit and the reference is not.
    `reference` has the frames' keys and lit cells."""
    r = reference.select(*keys, "iu", "iv", F.lit(True).alias("ref"))
    both = states.select(*keys, "iu", "iv", "st").join(r, [*keys, "iu", "iv"], "full")
    ref, lit = F.coalesce("ref", F.lit(False)), F.coalesce("st", F.lit(0)) == LIT
    return both.withColumn("kind", F.when(ref & ~lit, "shadow").when(lit & ~ref, "object")).where("kind IS NOT NULL").select(*keys, "iu", "iv", "kind")


def dilated(cells: DataFrame, keys: list[str], radius: int = 1, *, cross: bool = False) -> DataFrame:
    """Cells within `radius` of a set cell: the square around it, or the diamond of an iterated cross."""
    offsets = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if not cross or abs(a) + abs(b) <= radius]
    moved = F.explode(F.array(*[F.struct((F.col("iu") + a).alias("iu"), (F.col("iv") + b).alias("iv")) for a, b in offsets]))
    return cells.select(*keys, moved.alias("c")).select(*keys, "c.iu", "c.iv").distinct()


def stable_cells(cells: DataFrame, key: str, frames: int = 3) -> DataFrame:
    """Cells set, after dilation, in this frame and the `frames` - 1 before it. A recording's first frames, which have too few before them, keep their own cells as they are."""
    first = cells.groupBy(key).agg(F.min("frame_idx").alias("_first"))
    wide = dilated(cells, [key, "frame_idx"])
    order = Window.partitionBy(key, "iu", "iv").orderBy("frame_idx").rangeBetween(-(frames - 1), 0)
    late = wide.withColumn("_n", F.count("*").over(order)).where(F.col("_n") == frames).drop("_n").join(first, key).where(F.col("frame_idx") >= F.col("_first") + frames - 1)
    early = cells.select(key, "frame_idx", "iu", "iv").distinct().join(first, key).where(F.col("frame_idx") < F.col("_first") + frames - 1)
    return late.unionByName(early).drop("_first")


def moving_median(rows: DataFrame, keys: list[str], order: str, value: str, half: int = 1) -> DataFrame:
    """Median over `half` rows to each side; at the ends, and for a null, what lies next towards the row is repeated. Only rows within reach are looked at."""
    by = Window.partitionBy(*keys).orderBy(order)
    side = lambda move: [F.coalesce(*[move(value, j).over(by) for j in range(k, 0, -1)], F.col(value)) for k in range(1, half + 1)]
    near, after = side(F.lag), side(F.lead)
    middle = F.element_at(F.sort_array(F.array(*near, F.col(value), *after)), half + 1)
    return rows.withColumn("smooth", middle)


def background_median(rows: DataFrame, keys: list[str], order: str, value: str, half: int = 10, floor: float = 1.0) -> DataFrame:
    """Median of the rows up to `half` before and after, at least `floor`."""
    return rows.withColumn("background", F.greatest(F.lit(floor), F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half))))


def ema_with_reset(rows: DataFrame, key: str, order: str, value: str, miss: Column, keep: float = 0.7, patience: int = 30) -> DataFrame:
    """(key, order, ema): smoothed value after each row; a miss leaves it, more than `patience` misses in a row clear it. Rows pass in order, with two numbers carried on."""
    marked = rows.select(key, order, F.when(~miss, F.col(value)).cast("double").alias("_x"))

    def step(state: tuple, x: float | None) -> tuple:
        ema, misses = state
        if x is None:
            misses += 1
            ema = None if misses > patience else ema
        else:
            ema, misses = x if ema is None else keep * ema + (1 - keep) * x, 0
        return (ema, misses), ema

    return carried(marked, [key], [order], ["_x"], lambda: (None, 0), step, "ema double").drop("_x")


def runs(rows: DataFrame, keys: list[str], position: str, set_: Column) -> DataFrame:
    """(keys, first, last, length): maximal stretches of consecutive positions that are set."""
    kept = rows.where(set_).select(*keys, position).distinct()
    island = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return kept.withColumn("_g", island).groupBy(*keys, "_g").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length")).drop("_g")


def longest_circular_run(rows: DataFrame, keys: list[str], position: str, size: int) -> DataFrame:
    """(keys, streak): longest run of set positions on a circle of `size`, at most size."""
    twice = rows.select(*keys, F.explode(F.array(F.col(position), F.col(position) + size)).alias(position))
    return runs(twice, keys, position, F.lit(True)).groupBy(*keys).agg(F.least(F.max("length"), F.lit(size).cast("long")).alias("streak"))


def gap_clusters(rows: DataFrame, keys: list[str], position: str, gap: float) -> DataFrame:
    """rows with `cluster`: positions whose gap to the one before is at most `gap` share a number, from 0."""
    by = Window.partitionBy(*keys).orderBy(position)
    new = F.when(F.col(position) - F.lag(position).over(by) > gap, 1).otherwise(0)
    return rows.withColumn("_n", new).withColumn("cluster", F.sum("_n").over(by.rangeBetween(Window.unboundedPreceding, 0))).drop("_n")


def eroded_runs(rows: DataFrame, keys: list[str], position: str, width: int) -> DataFrame:
    """Set positions all of whose window of `width`, centred, is set; beyond the first and last position of a key counts as set only within the data."""
    left = width // 2
    order = Window.partitionBy(*keys).orderBy(position).rangeBetween(-left, width - 1 - left)
    return rows.withColumn("_n", F.count("*").over(order)).where(F.col("_n") == width).drop("_n")


def band_around_peak(rows: DataFrame, keys: list[str], position: str, count: str, share: float = 0.5) -> DataFrame:
    """(keys, first, last): the stretch around the highest count in which counts stay over `share` of it."""
    peak = rows.groupBy(*keys).agg(F.max(count).alias("_p"), F.min_by(position, F.struct((-F.col(count)).alias("s"), position)).alias("_at"))
    band = runs(rows.join(peak, keys), [*keys, "_at"], position, F.col(count) > share * F.col("_p"))
    return band.where("first <= _at AND _at <= last").select(*keys, "first", "last")


def notches(rows: DataFrame, keys: list[str], position: str, value: str, dip: float = 0.4, least: int = 3, before: float = 0.8, slack: float = 1.5) -> DataFrame:
    """(keys, onset, length): the `least`-th place of the first run of values at most `dip` whose `least` + 2 places before that one have a median of at least `before`,
    if the places from `least` behind it on have one of at most `slack` times the dip. A profile's first place begins no run; length is the run's."""
    inner = rows.withColumn("_start", F.min(position).over(Window.partitionBy(*keys))).where(F.col(position) > F.col("_start"))
    low = runs(inner, keys, position, F.col(value) <= dip).where(F.col("length") >= least).withColumn("onset", F.col("first") + least - 1)
    median = lambda kept: F.percentile(F.when(kept, F.col(value)), 0.5)
    near = F.col(position).between(F.col("onset") - least - 2, F.col("onset") - 1)
    tested = rows.join(low, keys).groupBy(*keys, "onset", "length").agg(median(near).alias("_b"), median(F.col(position) >= F.col("onset") + least).alias("_a"))
    first = tested.where(F.col("_b") >= before).groupBy(*keys).agg(F.min("onset").alias("onset"), F.min_by(F.struct("length", "_a"), "onset").alias("_r"))
    return first.where(F.col("_r._a") <= slack * dip).select(*keys, "onset", F.col("_r.length").alias("length"))


def sharp_drops(rows: DataFrame, keys: list[str], k: str, value: str, *, least: float = 5, ramp: int = 6, ratio: float = 1.5) -> DataFrame:
    """(keys, k_drop): first screen k at which the value falls from `least` or more to at most max(2, a quarter), and was not ramping down before."""
    by = Window.partitionBy(*keys).orderBy(k)
    one, six = F.lag(value, 1).over(by), F.coalesce(F.lag(value, ramp).over(by), F.first(value).over(by))
    fell = (F.col("_1") >= least) & (F.col(value) <= F.greatest(F.lit(2.0), 0.25 * F.col("_1"))) & ~(F.col("_6") > ratio * F.col("_1") + 2)
    return rows.withColumns({"_1": one, "_6": six}).where(fell).groupBy(*keys).agg(F.min(k).alias("k_drop"))


def first_lit(cells: DataFrame, keys: list[str], column: str, row: str, family: str, order: list[str], walls: DataFrame | None = None) -> DataFrame:
    """(keys, column, row, family): nearest lit row of each column; of several families there the first in `order`. walls (keys, last_row): rows behind a key's wall don't count."""
    if walls is not None:
        cells = cells.join(walls, keys, "left").where(F.col("last_row").isNull() | (F.col(row) < F.col("last_row"))).drop("last_row")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(family))
    return cells.groupBy(*keys, column).agg(F.min_by(F.struct(row, family), F.struct(row, rank)).alias("b")).select(*keys, column, F.col(f"b.{row}").alias(row), F.col(f"b.{family}").alias(family))


def first_crossing(rows: DataFrame, keys: list[str], t: str, value: str, *, last: bool = False) -> DataFrame:
    """(keys, t_cross): midpoint of the first step along t on which the value changes sign (the last one on request)."""
    by = Window.partitionBy(*keys).orderBy(t)
    before, t0 = F.lag(value).over(by), F.lag(t).over(by)
    crossed = rows.withColumns({"_b": before, "_t": t0}).where((F.col("_b") * F.col(value) <= 0) & (F.col("_b") != 0))
    return crossed.groupBy(*keys).agg((F.max if last else F.min)((F.col("_t") + F.col(t)) / 2).alias("t_cross"))


def window_median(rows: DataFrame, keys: list[str], order: str, value: str, back: int, real: Column | None = None) -> DataFrame:
    """Median of the real values in rows order - back to order."""
    v = F.col(value) if real is None else F.when(real, F.col(value))
    return rows.withColumn("median", F.percentile(v, F.lit(0.5)).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(-back, 0)))


def last_within(rows: DataFrame, keys: list[str], order: str, value: Column, back: int) -> DataFrame:
    """Last known value in the `back` frames before this one, as-of."""
    return rows.withColumn("last_real", F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(-back, -1)))


def hold_between(rows: DataFrame, keys: list[str], order: str, value: str, every: int = 2) -> DataFrame:
    """Each every-th frame is processed; the ones between reuse its result."""
    taken = F.when(F.pmod(F.col(order), F.lit(every)) == 0, F.col(value))
    return rows.withColumn("held", F.last(taken, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
