"""Pairs of sequences that share an item, and distances of the groups that they belong to."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ground_distance, round_half_even
from ..kernels.dtw import normalized_distances
from ..session import written
from . import running


def collected_frames(df: DataFrame, group: Sequence[str], order: str, vector: str) -> DataFrame:
    """Each group's vectors in order, as frames."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vector).alias("v"))))
    return df.groupBy(*group).agg(F.transform(rows, lambda x: x["v"]).alias("frames"))


def item_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], blocks: int = 1, tasks: int | None = None) -> DataFrame:
    """Rows of left and right (each with its own further column names, and `id_a` and `id_b`) with equal keys.

    Items are few, so their join alone would make few, large tasks: with blocks > 1 each side is dealt into that
    many by its id, and block pairs are the join's key as well; every row is sent `blocks` times. With tasks the join
    has that many, where Spark would otherwise go by the size of its input, which is small beside the pairs.
    """

    def dealt(side: DataFrame, *by: str) -> DataFrame:
        return side.repartition(tasks, *by) if tasks else side

    if blocks <= 1:
        return dealt(left, *keys).join(dealt(right, *keys), list(keys))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = left.withColumn("__a", F.pmod(F.hash("id_a"), F.lit(blocks))).withColumn("__b", every)
    right = right.withColumn("__b", F.pmod(F.hash("id_b"), F.lit(blocks))).withColumn("__a", every)
    by = [*keys, "__a", "__b"]
    return dealt(left, *by).join(dealt(right, *by), by).drop("__a", "__b")


#: Recordings of one word, and about how many bytes of their frames, that a block holds; a task has two blocks.
PAIR_ROWS, PAIR_BYTES = 256, 128 << 20


def blocks_for(frames: DataFrame, keys: Sequence[str] = ("model", "layer")) -> int:
    """Blocks that hold about PAIR_ROWS recordings of one word and PAIR_BYTES at most, from the words' counts and
    sizes. Frames of a recording have one width."""
    size = F.coalesce(F.size("frames") * F.size(F.get("frames", F.lit(0))), F.lit(0)).cast("long") * 8
    words = frames.groupBy(*keys, "word").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    most = words.agg(F.max("n").alias("n"), F.max("bytes").alias("bytes")).first()
    return max(1, -(-(most["n"] or 1) // PAIR_ROWS), -(-(most["bytes"] or 0) // PAIR_BYTES))


#: Points of a group that a block holds (each is sent once for each block of the other side), and pairs of a task, about.
POINT_ROWS, TASK_PAIRS = 256, 8 << 20


def point_blocks(points: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Blocks that hold about POINT_ROWS points of the largest group each, and tasks for all pairs inside groups."""
    sizes = points.groupBy(*keys).agg(F.count("*").alias("n"))
    most, every = sizes.agg(F.max("n"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    return max(1, -(-(most or 0) // POINT_ROWS)), int((every or 0) // TASK_PAIRS) + 1


#: Distances are told apart by bands of so many different values, so that Parquet's dictionaries hold them and number
#: them by two bytes. The last of BANDS bands has all longer ones, and those that are no number or missing.
BAND_VALUES, BANDS = (1 << 16) - 2, 32


def point_distances(points: DataFrame, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """a, b, cost: ids and rounded distance of all pairs of rows of points (keys, id, x, y) with equal keys, none null.

    There are so many pairs that the order they come in decides how much disk they take as files of columns. A block holds
    POINT_ROWS points at most that lie near each other (slabs by x, cut by y). A pair of blocks goes to each band that its
    distances can be in, and yields its pairs of that band there; a task has pairs of blocks of one band (or of neighbours),
    so its distances are few different ones. A point's pairs with a whole other block are followed by the same ones
    turned round, which have the same distances. Rows are numbered by running sums, so equal points or a group with most
    rows are dealt out like all others.
    """
    keys, width = list(keys), BAND_VALUES / 10.0**digits
    blocks, tasks = point_blocks(points, keys)
    # Written once, so that numbers of rows and what blocks hold don't change in between.
    rows = written(points.dropna(subset=keys).withColumn("row", F.monotonically_increasing_id()), "points")
    slabs = running.numbered(rows, keys, ["x", "row"]).withColumn("slab", F.floor(F.col("ord") / (POINT_ROWS * math.ceil(blocks**0.5)))).drop("ord")
    cut = running.numbered(slabs, [*keys, "slab"], ["y", "row"]).withColumn("cut", F.floor(F.col("ord") / POINT_ROWS))
    ends = {f"{f.__name__}_{c}": f(F.coalesce(F.col(c).cast("double"), F.lit(math.nan))) for f in (F.min, F.max) for c in "xy"}
    held = cut.groupBy(*keys, F.struct("slab", "cut").alias("block")).agg(F.collect_list(F.struct("id", "x", "y")).alias("points"), *[v.alias(k) for k, v in ends.items()])
    held = written(held, "blocks")

    def box(s: str) -> DataFrame:
        return held.select(*keys, F.col("block").alias(f"block_{s}"), F.size("points").cast("long").alias(f"n_{s}"), F.struct(*ends).alias(f"box_{s}"))

    def band(far: Column) -> Column:
        return F.when(far < width * (BANDS - 1), F.floor(far / width).cast("int")).otherwise(BANDS - 1)

    def apart(far: bool) -> Column:
        """The most or the least that points of two boxes can be apart."""
        out = []
        for c in "xy":
            one, two = (F.col(f"box_{p}.{'max' if far else 'min'}_{c}") - F.col(f"box_{q}.{'min' if far else 'max'}_{c}") for p, q in ("ab", "ba"))
            out.append(F.greatest(one, two, F.lit(0.0)))
        return F.sqrt(out[0] * out[0] + out[1] * out[1])

    turned, by = F.col("block_a") < F.col("block_b"), [*keys, "block_a", "block_b"]
    met = box("a").join(box("b"), keys).filter("block_a <= block_b").withColumn("most", apart(True))
    # With a point that has a place missing or without end, a block's distances can be in any band.
    least = F.when(F.col("most") < F.lit(math.inf), apart(False)).otherwise(0.0)
    # A thousandth of a band to each side is more than roundings can move a distance.
    met = met.withColumn("bands", F.sequence(band(F.greatest(least - width / 1000, F.lit(0.0))), band(F.col("most") + width / 1000)))
    share = F.col("n_a") * F.col("n_b") * F.when(turned, 2).otherwise(1) / F.size("bands")
    met = met.select(*by, share.alias("n"), F.explode("bands").alias("band"))
    summed = running.running_sums(met, [], ["band", *by], {"upto": F.col("n")})
    task = F.least(F.floor(F.greatest(F.col("upto") - F.col("n"), F.lit(0.0)) / TASK_PAIRS), F.lit(tasks - 1)).cast("int")
    dealt = written(summed.select(*by, "band", task.alias("task")), "tiles")

    def side(s: str) -> DataFrame:
        few, mine = tasks // 32 + 1, [*keys, f"block_{s}"]
        sent = held.select(*keys, F.col("block").alias(f"block_{s}"), F.col("points").alias(f"points_{s}"))
        return dealt.repartition(few, *mine).join(sent.repartition(few, *mine).hint("shuffle_hash"), mine).repartitionById(tasks, "task")

    # A broadcast would leave all pairs to few tasks. Coordinates stay numbers, as functions of arrays aren't generated code.
    met = side("a").join(side("b").hint("shuffle_hash"), ["task", "band", *by])
    met = met.withColumn("a", F.explode("points_a")).withColumn("turn", F.explode(F.when(turned, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    met = met.withColumn("b", F.explode("points_b"))
    x, y = (F.col(f"a.{c}").cast("double") - F.col(f"b.{c}").cast("double") for c in "xy")
    square = x * x + y * y
    # Squares before they are rounded decide, with the same bounds in every task: a pair is in one band.
    below = lambda i: F.coalesce(square < (i * width) * (i * width), F.lit(False))
    inside = (F.col("band") == 0) | ~below(F.col("band")), (F.col("band") == BANDS - 1) | below(F.col("band") + 1)
    first, second = (F.when(F.col("turn"), F.col(f"{p}.id")).otherwise(F.col(f"{q}.id")) for p, q in ("ba", "ab"))
    return met.filter(inside[0] & inside[1]).select(first.alias("a"), second.alias("b"), round_half_even(F.sqrt(square), digits).alias("cost"))


def _frames(column: pa.ListArray) -> list[np.ndarray]:
    """Each row's frames as a matrix; no frames where they are null."""
    inner = column.flatten()
    flat, starts = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64), inner.offsets.to_numpy() if len(inner) else np.zeros(1, np.int64)
    offsets, base = column.offsets.to_numpy(), column.offsets.to_numpy()[0] if len(column) else 0
    out = []
    for a, b, ok in zip(offsets[:-1] - base, offsets[1:] - base, column.is_valid().to_pylist(), strict=True):
        cut = flat[starts[a] - starts[0] : starts[b] - starts[0]] if ok and b > a else flat[:0]
        out.append(cut.reshape(b - a, -1) if len(cut) else np.zeros((0, 1)))
    return out


def sequence_distances(frames: DataFrame, keys: Sequence[str] = ("model", "layer"), blocks: int = 1, symmetric: bool = True) -> DataFrame:
    """keys, a, b, word and distance for all pairs of recordings that share a word, in ordered pairs of villages;
    null where a recording has no frames.

    frames: keys, village, word, recording, frames. With symmetric each pair of different villages is computed once,
    village a before b (a null village is in none); a village with itself has all its ordered pairs of recordings.

    Recordings are dealt into blocks by their names, and a group is a word with two blocks: a recording is sent once for
    each block, `blocks` times, and pairs are made where the groups are, so that none is shuffled or copied.
    """
    keys = list(keys)
    kinds = dict(frames.select(*keys, "village", "word").dtypes)
    own = frames.select(*keys, "word", "village", "frames", F.pmod(F.xxhash64("recording"), F.lit(blocks)).cast("int").alias("__own"))
    sent = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.withColumns({"__x": F.least("__own", "__other"), "__y": F.greatest("__own", "__other")}).drop("__other")
    head = "".join(f"{c} {kinds[c]}, " for c in keys)
    schema = f"{head}a {kinds['village']}, b {kinds['village']}, word {kinds['word']}, distance double"

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        village, block, x, y = (table.column(c).to_pylist() for c in ("village", "__own", "__x", "__y"))
        made = _frames(table.column("frames").combine_chunks() if isinstance(table.column("frames"), pa.ChunkedArray) else table.column("frames"))
        one = range(len(block)) if x[0] == y[0] else [k for k, v in enumerate(block) if v == x[0]]
        pairs: list[tuple[int, int]] = []  # computed ones
        given: list[tuple[int, int, int]] = []  # rows: computed pair, a, b
        for i in one:
            for j in range(i, len(block)) if x[0] == y[0] else (k for k, v in enumerate(block) if v == y[0]):
                if symmetric and (village[i] is None or village[j] is None):
                    continue
                if not symmetric or village[i] == village[j]:
                    given += [(len(pairs), i, j)] + [(len(pairs), j, i)] * (i != j)
                else:
                    given.append((len(pairs), *((i, j) if village[i] < village[j] else (j, i))))
                pairs.append((i, j))
        distance = normalized_distances([(made[i], made[j]) for i, j in pairs])
        at = np.array(given, np.int64).reshape(-1, 3)
        first = pa.array(np.zeros(len(at), np.int64))
        values = distance[at[:, 0]]
        columns = {c: table.column(c).take(first) for c in keys}
        columns |= {"a": table.column("village").take(pa.array(at[:, 1])), "b": table.column("village").take(pa.array(at[:, 2])), "word": table.column("word").take(first)}
        columns["distance"] = pa.array(values, pa.float64(), mask=np.isnan(values))
        return pa.table(columns)

    return sent.groupBy(*keys, "word", "__x", "__y").applyInArrow(run, schema)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def warping(a: Column, b: Column) -> Column:
    """Normalised warping distance of two arrays of frames, in DataFrame functions; null without frames.

    Cells of g are made diagonal by diagonal (i + j = k), as a cell follows from the two diagonals before its own. A
    diagonal's first cell is the one with the least i."""

    def distance(a: Column, b: Column) -> Column:
        def least(k: Column) -> Column:
            return F.greatest(F.lit(0), k - F.size(b) + 1)

        def diagonal(done: Column, k: Column) -> Column:
            def cell(i: Column) -> Column:
                # Missing neighbours lie outside the diagonals and are null, which least passes over.
                before = i - least(k - 1)
                across = F.get(done["two"], i - 1 - least(k - 2))
                best = lambda d: F.coalesce(F.least(F.get(done["one"], before - 1) + d, across + 2 * d, F.get(done["one"], before) + d), d)
                return _let(ground_distance(F.get(a, i), F.get(b, k - i)), best)

            cells = F.transform(F.sequence(least(k), F.least(k, F.size(a) - 1)), cell)
            return F.struct(cells.alias("one"), done["one"].alias("two"))

        none = F.array().cast("array<double>")
        every = F.sequence(F.lit(0), F.size(a) + F.size(b) - 2)
        last = F.aggregate(every, F.struct(none.alias("one"), none.alias("two")), diagonal, lambda s: F.get(s["one"], F.lit(0)))
        return last / (F.size(a) + F.size(b))

    given = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(given, _let(a.cast("array<array<double>>"), lambda x: _let(b.cast("array<array<double>>"), lambda y: distance(x, y))))


#: Frames of a word's longest recording up to which warping is worth while: a cell of it takes some microseconds, one of
#: the kernel some 20 nanoseconds; and blocks, at least, so that a few words give many tasks.
COLUMN_FRAMES, LEAST_BLOCKS = 64, 4


def column_distances(frames: DataFrame, keys: Sequence[str] = ("model", "layer")) -> DataFrame:
    """sequence_distances of different villages' pairs once (a before b) and of a village with itself, made by warping,
    without Python; words that have a recording of more than COLUMN_FRAMES frames go to sequence_distances."""
    keys = list(keys)
    longest = frames.groupBy(*keys, "word").agg(F.coalesce(F.max(F.size("frames")), F.lit(0)).alias("__longest"))
    known = frames.join(longest, [*keys, "word"])
    short, long = (known.filter(F.col("__longest") <= COLUMN_FRAMES).drop("__longest"), known.filter(F.col("__longest") > COLUMN_FRAMES).drop("__longest"))

    def side(x: str) -> DataFrame:
        return short.select(*keys, "word", F.col("village").alias(x), F.col("recording").alias(f"id_{x}"), F.col("frames").alias(f"frames_{x}"))

    blocks = max(LEAST_BLOCKS, blocks_for(frames, keys))
    met = item_pairs(side("a"), side("b"), [*keys, "word"], blocks).filter("a <= b")
    made = met.select(*keys, "a", "b", "word", warping(F.col("frames_a"), F.col("frames_b")).alias("distance"))
    return made.unionByName(sequence_distances(long, keys, blocks))


def locality_distances(frames: DataFrame, keys: Sequence[str] = ("model", "layer"), digits: int | None = 4, blocks: int = 1, words: bool = False) -> DataFrame:
    """keys, row_loc, col_loc, dist and n_pairs: the mean over all pairs of recordings that share a word, for both
    orders of two villages; villages that share no word have no row (see matrix.scaffold). words: also the list of
    the words that they share, in order (as many as there are words at most)."""
    used = [F.array_sort(F.collect_set("word")).alias("words")] if words else []
    half = sequence_distances(frames, keys, blocks).groupBy(*keys, "a", "b").agg(F.avg("distance").alias("dist"), F.count("distance").alias("n_pairs"), *used)
    if digits is not None:
        half = half.withColumn("dist", round_half_even(F.col("dist"), digits))
    # Each row gives both orders, so that the half is computed once.
    orders = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("r"), F.col("b").alias("c")))).otherwise(F.array(F.struct(F.col("a").alias("r"), F.col("b").alias("c")), F.struct(F.col("b").alias("r"), F.col("a").alias("c"))))
    return half.withColumn("o", F.explode(orders)).select(*keys, F.col("o.r").alias("row_loc"), F.col("o.c").alias("col_loc"), "dist", "n_pairs", *(["words"] if words else []))
