"""Vector code compression (operator 13): product codes whose codebooks are fitted with annular norm pruning.

A codebook's entries are sorted by their norm. A part first meets the entry whose norm is nearest to its own; by the
triangle inequality no entry whose norm differs from the part's by more than the best distance so far can be nearer,
so a binary search finds the interval of norms that this distance allows, and only entries in that annulus, its edges
included, are measured, from the middle outwards, while the best distance narrows it.

Norms are compared in floating point with room for rounding; distances that decide are sums of squares of whole
numbers, ties go to the smaller index. So the codes are those of full scans.

A round is one pass over the vectors. A task reports counts and sums of the entries of each part, which Spark adds up
before they come to the driver: they have the size of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .arrow_text import bounded_batches
from .vectors import finite, matrix, mean_floor, rows_of, squared, whole

#: Parts of a vector, entries of a part's codebook, rounds, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors that a kernel has at once.
ROWS = 8192
#: Labels' sums that are broadcast, at most; more are joined by shuffle, each label in SALTS shares.
BROADCAST_LABELS, SALTS = 200_000, 64


class Annulus:
    """A codebook (entries x width, whole numbers), searched by norm."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        norm = np.sqrt((book.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norm, kind="stable")
        self.norm = norm[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and exact squared distance of each row's nearest entry, and how many distances were measured."""
        n, size = len(x), len(self.book)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        at = np.searchsorted(self.norm, norm)
        low = np.maximum(at - 1, 0)
        at = np.minimum(at, size - 1)
        start = np.where(norm - self.norm[low] < self.norm[at] - norm, low, at)
        code, best = self.order[start], squared(x, self.book[self.order[start]])
        slack = 1e-12 * (norm + self.norm[-1]) + 1e-9
        reach = np.sqrt(best.astype(np.float64)) + slack
        first, end = np.searchsorted(self.norm, norm - reach, "left"), np.searchsorted(self.norm, norm + reach, "right")
        measured = n
        for far in range(1, size):
            for side in (-far, far):
                place = start + side
                rows = np.flatnonzero((place >= first) & (place < end))
                rows = rows[np.abs(self.norm[place[rows]] - norm[rows]) <= reach[rows]]
                if not len(rows):
                    continue
                measured += len(rows)
                entry = self.order[place[rows]]
                d2 = squared(x[rows], self.book[entry])
                better = (d2 < best[rows]) | ((d2 == best[rows]) & (entry < code[rows]))
                rows, entry, d2 = rows[better], entry[better], d2[better]
                code[rows], best[rows] = entry, d2
                reach[rows] = np.sqrt(d2.astype(np.float64)) + slack[rows]
            if not ((start - far > first) | (start + far < end - 1)).any():
                break
        return code, best, measured


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def _reports(rows: DataFrame, books: list[np.ndarray], scale: int) -> DataFrame:
    """part, entry, n and sums: what each task's vectors add to each entry of each part."""
    searches = [Annulus(b) for b in books]
    width, size = books[0].shape[1], len(books[0])
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((len(books), size), np.int64), np.zeros((len(books), size, width), np.int64)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                x = whole(matrix(whole_batch.slice(at, ROWS).column(0)), scale)
                for p, (part, search) in enumerate(zip(_parts(x, len(books)), searches, strict=True)):
                    code, _, _ = search.nearest(part)
                    count[p] += np.bincount(code, minlength=size)
                    np.add.at(sums[p], code, part)
        used = np.argwhere(count > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used[:, 0].astype(np.int32)), pa.array(used[:, 1].astype(np.int32)), pa.array([int(count[p, e]) for p, e in used], pa.int64()), pa.array([sums[p, e].tolist() for p, e in used], schema.field("sums").type)], schema=schema)

    return rows.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")


def _codes(rows: DataFrame, books: list[np.ndarray], scale: int, kind: str) -> DataFrame:
    searches = [Annulus(b) for b in books]
    schema = f"id long, label {kind}, code string, codes array<int>, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                x = whole(matrix(batch.column(2)), scale)
                found = [s.nearest(part) for part, s in zip(_parts(x, len(books)), searches, strict=True)]
                codes = np.stack([f[0] for f in found], 1)
                text = [bytes(c).hex() for c in codes.astype(np.uint8)]
                error = np.sum([f[1] for f in found], axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(error)], ["id", "label", "code", "codes", "error"])

    return rows.select("id", "label", "v").mapInArrow(run, schema)


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def fit_books(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """Each part's codebook after the rounds, from rows (id, v) of one width."""
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = _parts(whole(np.array([r["v"] for r in first], np.float64), scale), parts)
    for _ in range(rounds):
        told = _reports(rows, books, scale).select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("i", "v"))
        made: dict[tuple[int, int], dict[int, int]] = {}
        for r in told.groupBy("part", "entry", "i").agg(F.sum("v").alias("v")).collect():
            made.setdefault((r["part"], r["entry"]), {})[r["i"]] = r["v"]
        books = [b.copy() for b in books]
        for (part, entry), v in made.items():
            books[part][entry] = mean_floor([v[i] for i in range(1, len(v))], v[0])
    return books


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), codes (array<int>), error (squared distances summed over the parts),
    label_error (error summed over equal labels, null ones together) and codebooks_sha256, one row per vector that
    takes part.

    Those are vectors without null or non-finite components whose number of components is a positive multiple of
    `parts`, and the most common of these numbers (the smaller of equally common ones), as a codebook has one width.
    Components are floor(scale * x). A part's codebook starts as that part of the vectors with the smallest ids, ascending
    (of rows with one id the smaller vector first, null ids last); with fewer vectors than `entries` it has as many.
    After each round an entry is the componentwise floor of its parts' mean, one without parts stays.

    Repeated rows each count and fare alike, a null id takes part, an empty table gives an empty result. Components over
    2**27 after scaling are an error, as distances would not fit. Other columns are not read. Codebooks, and the counts
    and sums of their entries, come to the driver; labels' sums are broadcast up to BROADCAST_LABELS, counted before.
    """
    spark = vectors.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("entries must fit two hex digits")
    bounded_batches(spark)
    kind = vectors.schema[label_col].dataType.simpleString()
    rows = rows_of(vectors, id_col, vec_col, F.col(f"`{label_col}`").alias("label")).filter(finite(F.col("v")) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "vec_id long, code string, codes array<int>, error long, label_error long, codebooks_sha256 string")
    rows = rows.filter(F.size("v") == lengths[0]["n"])
    books = fit_books(rows, parts, entries, rounds, scale)
    coded = written(_codes(rows, books, scale, kind), "codes")
    totals = coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    few = totals.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    if few:
        met = coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("own")))
    else:  # a label may hold a third of all rows, so each meets its sum in SALTS shares
        left = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        right = totals.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = left.join(right, F.col("label").eqNullSafe(F.col("own")) & (F.col("salt") == F.col("share")))
    return met.select(F.col("id").alias("vec_id"), "code", "codes", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
