"""Queries on sequences, matrices and clusterings. Recordings are made of `embeddings`: the label is the village,
vec_id % 5 the word, and a word's vectors in order of vec_id are its frames. Points are a vector's first two numbers,
vec_id % 4 the predicted cluster, label % 4 the gold one."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ground_distance, round_half_even
from ..kernels.linkage import METHODS
from ..operators import ancestry, clustering, evaluate, featurize, matrix, pairs, running, select, spanning
from ..session import shared_folder, written
from ..sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DROPPED = (3, 7)
KEYS = ["model", "layer"]


def query(sql: str | None = None, name: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE[name or fn.__name__] = sql
        return fn

    return add


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def frames(spark: SparkSession, sf_dir: str, word: str = "vec_id % 5") -> DataFrame:
    """model, layer, village, word, recording, frames of the recordings."""
    vectors = embeddings(spark, sf_dir).withColumns({"model": F.lit("m"), "layer": F.lit(1), "village": F.col("label"), "word": F.expr(word)})
    made = pairs.collected_frames(vectors, ["model", "layer", "village", "word"], "vec_id", "embedding")
    return made.withColumn("recording", F.concat_ws("_", "village", "word"))


def distances(spark: SparkSession, sf_dir: str, digits: int | None = 4) -> DataFrame:
    made = frames(spark, sf_dir)
    return pairs.locality_distances(made, KEYS, digits, pairs.blocks_for(made, KEYS))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locality and ord (the place among the villages, from 0) of the villages."""
    named = embeddings(spark, sf_dir).select(F.col("label").alias("locality")).distinct()
    return running.numbered(named, [], ["locality"])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locality, point, gold and label."""
    e = embeddings(spark, sf_dir)
    point = F.array(*[F.col("embedding")[i].cast("double") for i in range(2)])
    return e.select(F.col("vec_id").alias("locality"), point.alias("point"), (F.col("label") % 4).alias("gold"), (F.col("vec_id") % 4).cast("int").alias("label"))


FRAMES_SQL = "frames AS (SELECT label AS village, vec_id % 5 AS word, list(embedding::DOUBLE[] ORDER BY vec_id) AS frames FROM embeddings GROUP BY 1, 2)"
# Warping distances of all pairs: g by rows, each from the row above by running sums and minima.
DTW_SQL = f"""{FRAMES_SQL},
pairs AS (SELECT a.village AS a, b.village AS b, word, a.frames AS fa, b.frames AS fb, len(a.frames) AS n, len(b.frames) AS m
          FROM frames a JOIN frames b USING (word)),
cells AS (SELECT a, b, word, n, m, i, j, list_distance(fa[i], fb[j]) AS d
          FROM (SELECT *, unnest(range(1, m + 1)) AS j FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM pairs))),
sums AS (SELECT *, sum(d) OVER (PARTITION BY a, b, word, i ORDER BY j) AS along FROM cells),
g(a, b, word, i, j, g) AS (
  SELECT a, b, word, i, j, along FROM sums WHERE i = 1
  UNION ALL
  SELECT a, b, word, i, j, along + min(up - along) OVER (PARTITION BY a, b, word ORDER BY j)
  FROM (SELECT s.a, s.b, s.word, s.i, s.j, s.along,
               least(o.g + s.d, coalesce(lag(o.g) OVER (PARTITION BY s.a, s.b, s.word ORDER BY s.j) + 2 * s.d, 1e300)) AS up
        FROM g o JOIN sums s ON s.a = o.a AND s.b = o.b AND s.word = o.word AND s.i = o.i + 1 AND s.j = o.j)),
dtw AS (SELECT a, b, word, g / (n + m) AS distance FROM g JOIN pairs USING (a, b, word) WHERE i = n AND j = m)"""
DIST_SQL = f"{DTW_SQL},\ndist AS (SELECT a AS row_loc, b AS col_loc, round_even(avg(distance), 4) AS dist, count(*) AS n_pairs FROM dtw GROUP BY 1, 2)"
DROPPED_SQL = ", ".join(map(str, DROPPED))


# Every number counts, by its place among the frames and inside its own.
@query(f"WITH {FRAMES_SQL} SELECT village, word, len(frames) AS n_frames, round_even(list_sum(list_transform(frames, lambda f, i: i * list_sum(list_transform(f, lambda v, c: c * v)))), 5) AS weighted FROM frames")
def frames_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    weighted = total(F.transform("frames", lambda f, i: (i + 1) * total(F.transform(f, lambda v, c: (c + 1) * v.cast("double")))))
    return frames(spark, sf_dir).select("village", "word", F.size("frames").cast("long").alias("n_frames"), round_half_even(weighted, 5).alias("weighted"))


def windows_of(waves: np.ndarray, lengths: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """A model of two layers for batches: mean and maximum of windows of 64 samples, 32 apart, and how far they are from
    the recording's own means of them."""
    counts = (lengths - 64) // 32 + 1
    cut = np.lib.stride_tricks.sliding_window_view(waves.astype(np.float64), 64, axis=1)[:, ::32]
    one = np.stack([cut.mean(2), cut.max(2)], 2)
    there = (np.arange(one.shape[1]) < counts[:, None])[:, :, None]
    return [(1, one, counts), (2, one - (one * there).sum(1, keepdims=True) / counts[:, None, None], counts)]


# The numbers of a recording's frames, one after the other, are its waveform; every number of a layer counts, by its place.
@query(f"""WITH {FRAMES_SQL},
cut AS (SELECT village, word, w, unnest(range(0, (len(w) - 64) // 32 + 1)) AS t FROM (SELECT village, word, flatten(frames) AS w FROM frames)),
one AS (SELECT village, word, t, list_avg(w[t * 32 + 1 : t * 32 + 64]) AS x, list_max(w[t * 32 + 1 : t * 32 + 64]) AS y FROM cut),
two AS (SELECT 1 AS layer, village, word, t, x, y FROM one
         UNION ALL SELECT 2, village, word, t, x - avg(x) OVER (PARTITION BY village, word), y - avg(y) OVER (PARTITION BY village, word) FROM one)
SELECT layer::INT AS layer, village::VARCHAR AS village, word::VARCHAR AS word, count(*) AS n_frames, round_even(sum((t + 1) * (x::FLOAT::DOUBLE + 2 * y::FLOAT::DOUBLE)), 3) AS weighted FROM two GROUP BY 1, 2, 3""")
def batch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = frames(spark, sf_dir)
    waves = made.select(F.col("recording").alias("path"), F.col("village").cast("string").alias("village_key"), F.col("word").cast("string").alias("word"), F.flatten("frames").alias("waveform"))
    out = featurize.featurize_batches(waves, "windows", lambda _: windows_of)
    weighted = F.aggregate(F.transform("frames", lambda f, i: (i + 1) * (f[0].cast("double") + 2 * f[1].cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return out.select("layer", "village", "word", F.size("frames").cast("long").alias("n_frames"), round_half_even(weighted, 3).alias("weighted"))


@query(f"WITH {FRAMES_SQL} SELECT a.village AS a, b.village AS b, word FROM frames a JOIN frames b USING (word)")
def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)

    def side(x: str) -> DataFrame:
        return f.select("word", F.col("village").alias(x), F.col("recording").alias(f"id_{x}"))

    return pairs.item_pairs(side("a"), side("b"), ["word"], 2).select("a", "b", "word")


@query(f"WITH RECURSIVE {DTW_SQL} SELECT a, b, word, round_even(distance, 6) AS distance FROM dtw WHERE a <= b")
def dtw_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.sequence_distances(frames(spark, sf_dir), KEYS).select("a", "b", "word", round_half_even(F.col("distance"), 6).alias("distance"))


@query(ORACLE["dtw_distance"])
def dtw_distance_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dtw_distance in DataFrame functions, without Python, where a word's recordings are short."""
    made = pairs.column_distances(frames(spark, sf_dir), KEYS)
    return made.select("a", "b", "word", round_half_even(F.col("distance"), 6).alias("distance"))


@query(f"WITH RECURSIVE {DIST_SQL} SELECT row_loc, col_loc, dist, n_pairs FROM dist")
def locality_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).drop(*KEYS)


# Villages below 5 have other words than the rest, so that some pairs share none.
TWO_SETS = "vec_id % 5 + CASE WHEN label < 5 THEN 0 ELSE 5 END"


@query(f"WITH RECURSIVE {DIST_SQL.replace('vec_id % 5 AS word', f'{TWO_SETS} AS word')}, loc AS (SELECT DISTINCT label AS l FROM embeddings) SELECT x.l AS row_loc, y.l AS col_loc, dist, n_pairs FROM loc x CROSS JOIN loc y LEFT JOIN dist ON row_loc = x.l AND col_loc = y.l")
def locality_distance_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairs.locality_distances(frames(spark, sf_dir, TWO_SETS), KEYS)
    return matrix.scaffold(d, labels(spark, sf_dir), KEYS).drop(*KEYS)


@query(f"WITH RECURSIVE {DIST_SQL} SELECT row_loc, " + ", ".join(f'max(dist) FILTER (WHERE col_loc = {i}) AS v{i}' for i in range(10)) + " FROM dist GROUP BY 1")
def distance_matrix_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = matrix.wide(distances(spark, sf_dir), range(10))
    return w.withColumnsRenamed({str(i): f"v{i}" for i in range(10)})


@query(f"WITH RECURSIVE {DIST_SQL} SELECT row_loc, 'v' || col_loc AS col_loc, dist FROM dist")
def distance_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.long(distance_matrix_wide(spark, sf_dir))


@query(f"WITH RECURSIVE {DIST_SQL} SELECT row_loc, col_loc, dist FROM dist WHERE row_loc NOT IN ({DROPPED_SQL}) AND col_loc NOT IN ({DROPPED_SQL})")
def submatrix_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.without(distances(spark, sf_dir), DROPPED).select("row_loc", "col_loc", "dist")


@query(f"WITH RECURSIVE {DIST_SQL} SELECT row_loc, col_loc, dist FROM dist WHERE row_loc > col_loc")
def lower_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.lower_triangle(distances(spark, sf_dir), labels(spark, sf_dir)).select("row_loc", "col_loc", "dist")


@query(f"WITH RECURSIVE {DIST_SQL}, loc AS (SELECT DISTINCT label AS l FROM embeddings) SELECT 0 AS kind, 0 AS i, 0 AS j, CAST(count(*) AS DOUBLE) AS value FROM loc UNION ALL SELECT 1, l, 0, l FROM loc UNION ALL SELECT 2, row_loc, col_loc, round_even(dist, 7) FROM dist WHERE row_loc > col_loc")
def dif_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = labels(spark, sf_dir).withColumn("locality", F.col("locality").cast("string"))
    cells = distances(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in ("row_loc", "col_loc")})
    return writers.dif_lines(cells, names).select("kind", "i", "j", F.col("line").cast("double").alias("value"))


@query(f"WITH RECURSIVE {DIST_SQL} SELECT row_loc::VARCHAR AS row_loc, col_loc::VARCHAR AS col_loc, round_even(dist, 7) AS dist FROM dist WHERE row_loc > col_loc")
def dif_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangular matrix file of each model and layer, written in one job and read in splits."""
    names = labels(spark, sf_dir).withColumn("locality", F.col("locality").cast("string"))
    cells = distances(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in ("row_loc", "col_loc")})
    folder = f"{shared_folder(spark).rstrip('/')}/isogloss-dif-{uuid.uuid4().hex}"
    writers.dif(cells, names, folder, KEYS)
    return readers.dif(spark, folder).select("row_loc", "col_loc", "dist")


@query(f"WITH {FRAMES_SQL} SELECT village::VARCHAR AS village_key, word::VARCHAR AS word, len(frames) AS n_frames, round_even(list_sum(list_transform(frames, lambda f, i: i * list_sum(list_transform(f, lambda x, j: j * x)))), 4) AS content FROM frames")
def npy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames through files that tasks write, one for each recording; content weighs each number by its place."""
    folder = f"{shared_folder(spark).rstrip('/')}/isogloss-npy-{uuid.uuid4().hex}"
    writers.npy_features(frames(spark, sf_dir), folder)
    weighed = F.transform("frames", lambda f, i: (i + 1) * F.aggregate(F.transform(f, lambda x, j: (j + 1) * x.cast("double")), F.lit(0.0), lambda s, v: s + v))
    total = F.aggregate(weighed, F.lit(0.0), lambda s, v: s + v)
    return readers.npy_features(spark, f"{folder}/*/*/*").select("village_key", "word", F.size("frames").cast("long").alias("n_frames"), round_half_even(total, 4).alias("content"))


@query(f"WITH RECURSIVE {DIST_SQL} SELECT row_loc, col_loc, CASE WHEN row_loc = col_loc THEN 0 ELSE dist END AS dist FROM dist")
def full_from_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = matrix.lower_triangle(distances(spark, sf_dir), labels(spark, sf_dir))
    return matrix.full(low, labels(spark, sf_dir)).select("row_loc", "col_loc", "dist")


def clustered(spark: SparkSession, sf_dir: str, methods=METHODS) -> DataFrame:
    return clustering.cluster(distances(spark, sf_dir, None).withColumn("dist", round_half_even(F.col("dist"), 9)), 4, methods, KEYS)


# Heights of single linkage are the lengths of the edges in the minimum spanning tree: an edge is in the tree unless
# its ends are joined by shorter ones, which the minimax path tells.
MINIMAX_SQL = f"""{DTW_SQL},
nine AS (SELECT a AS x, b AS y, round_even(avg(distance), 9) AS d FROM dtw WHERE a <> b GROUP BY 1, 2),
steps AS (SELECT DISTINCT d FROM nine),
hop(x, y, worst) AS (SELECT x, y, d FROM nine UNION SELECT h.x, n.y, greatest(h.worst, n.d) FROM hop h JOIN nine n ON n.x = h.y WHERE n.y <> h.x AND greatest(h.worst, n.d) < (SELECT d FROM nine k WHERE k.x = h.x AND k.y = n.y)),
coph AS (SELECT x, y, min(worst) AS h FROM hop GROUP BY 1, 2)"""

# Agglomeration in SQL: a state is the distances d between clusters x and y of nx and ny members, in both orders. The
# nearest pair (p, q) merges into p, whose distances follow from those of p and q by the method's rule.
RULES = {
    "sl": "least(dp, dq)",
    "cl": "greatest(dp, dq)",
    "ga": "(np * dp + nq * dq) / (np + nq)",
    "wa": "(dp + dq) / 2",
    "uc": "(np * dp + nq * dq) / (np + nq) - np * nq * d0 / ((np + nq) * (np + nq))",
    "wc": "(dp + dq) / 2 - d0 / 4",
    "wm": "((nk + np) * dp + (nk + nq) * dq - nk * d0) / (nk + np + nq)",
}


def merge_sql(methods: Sequence[str], digits: int = 9) -> str:
    """merges(method, step, a, b, height, size) and clusters(method, step, village, cluster) after each step."""
    rule = " ".join(f"WHEN '{m}' THEN {RULES[m]}" for m in methods)
    return f"""{DTW_SQL},
apart AS MATERIALIZED (SELECT a AS x, b AS y, round_even(avg(distance), {digits}) AS d FROM dtw WHERE a <> b GROUP BY 1, 2),
state(method, step, x, y, d, nx, ny) AS (
  SELECT method, 0, x, y, d, 1, 1 FROM apart CROSS JOIN (SELECT unnest({list(methods)!r}) AS method)
  UNION ALL
  SELECT method, step + 1, x, y, CASE WHEN x = p OR y = p THEN CASE method {rule} END ELSE d END, CASE WHEN x = p THEN np + nq ELSE nx END, CASE WHEN y = p THEN np + nq ELSE ny END
  FROM (SELECT *, CASE WHEN y = p THEN nx ELSE ny END AS nk,
               CASE WHEN y = p THEN max(CASE WHEN y = p THEN d END) OVER rows ELSE max(CASE WHEN x = p THEN d END) OVER cols END AS dp,
               CASE WHEN y = p THEN max(CASE WHEN y = q THEN d END) OVER rows ELSE max(CASE WHEN x = q THEN d END) OVER cols END AS dq
        FROM (SELECT *, first_value(x) OVER near AS p, first_value(y) OVER near AS q, first_value(d) OVER near AS d0, first_value(nx) OVER near AS np, first_value(ny) OVER near AS nq
              FROM state WINDOW near AS (PARTITION BY method ORDER BY d, x, y))
        WINDOW rows AS (PARTITION BY method, x), cols AS (PARTITION BY method, y))
  WHERE x <> q AND y <> q),
merges AS MATERIALIZED (SELECT method, step, x AS a, y AS b, d AS height, nx + ny AS size FROM (SELECT *, row_number() OVER (PARTITION BY method, step ORDER BY d, x, y) AS n FROM state) WHERE n = 1),
clusters(method, step, village, cluster) AS (
  SELECT method, 0, label, label FROM (SELECT DISTINCT label FROM embeddings) CROSS JOIN (SELECT unnest({list(methods)!r}) AS method)
  UNION ALL
  SELECT c.method, c.step + 1, village, CASE WHEN cluster = b THEN a ELSE cluster END FROM clusters c JOIN merges m ON m.method = c.method AND m.step = c.step),
coph AS (SELECT x.method, x.village AS x, y.village AS y, arg_min(m.height, m.step) AS h
         FROM clusters x JOIN clusters y ON x.method = y.method AND x.step = y.step AND x.cluster = y.cluster AND x.village <> y.village
         JOIN merges m ON m.method = x.method AND m.step = x.step - 1 GROUP BY 1, 2, 3)"""


for _method in METHODS:

    def _linkage(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        rows = clustering.merge_rows(clustered(spark, sf_dir, [method]))
        return rows.select("step", "a", "b", round_half_even(F.col("height"), 6).alias("height"), "size")

    query(f"WITH RECURSIVE {merge_sql([_method])} SELECT step, a::VARCHAR AS a, b::VARCHAR AS b, round_even(height, 6) AS height, size FROM merges", f"linkage_{_method}")(_linkage)


@query(ORACLE["linkage_sl"])
def linkage_sl_by_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """linkage_sl from the least edges of components, without a task that holds a matrix."""
    cells = distances(spark, sf_dir, None).withColumn("dist", round_half_even(F.col("dist"), 9))
    rows = spanning.single_linkage(spanning.spanning_edges(cells, KEYS), KEYS)
    return rows.select("step", "a", "b", round_half_even(F.col("height"), 6).alias("height"), "size")


@query(f"WITH RECURSIVE {MINIMAX_SQL} SELECT x::VARCHAR AS row_loc, y::VARCHAR AS col_loc, round_even(h, 6) AS coph FROM coph UNION ALL SELECT DISTINCT label::VARCHAR, label::VARCHAR, 0.0::DOUBLE FROM embeddings")
def cophenetic_sl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustering.cophenetic_rows(clustered(spark, sf_dir, ["sl"]))
    return rows.select("row_loc", "col_loc", round_half_even(F.col("coph"), 6).alias("coph"))


@query(f"WITH RECURSIVE {merge_sql(METHODS)} SELECT method, x::VARCHAR AS row_loc, y::VARCHAR AS col_loc, round_even(h, 6) AS coph FROM coph UNION ALL SELECT DISTINCT method, village::VARCHAR, village::VARCHAR, 0.0::DOUBLE FROM clusters")
def cophenetic_by_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven methods' cophenetic distances, from merges and the pairs that are asked for."""
    cells = written(distances(spark, sf_dir, None).withColumn("dist", round_half_even(F.col("dist"), 9)), "cells")
    merges = written(clustering.merge_rows(clustering.cluster(cells, 4, METHODS, KEYS)), "merges")
    every = F.explode(F.array(*[F.lit(m) for m in METHODS]))
    asked = cells.select(*KEYS, *[F.col(c).cast("string").alias(c) for c in ("row_loc", "col_loc")], every.alias("method"))
    rows = ancestry.cophenetic_heights(asked, merges, [*KEYS, "method"])
    return rows.select("method", "row_loc", "col_loc", round_half_even(F.col("coph"), 6).alias("coph"))


@query(f"""WITH RECURSIVE {MINIMAX_SQL},
tree AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM nine JOIN coph USING (x, y) WHERE x < y AND d = h),
villages AS (SELECT DISTINCT label AS l FROM embeddings),
joined AS (SELECT x, y FROM coph WHERE h <= (SELECT max(d) FROM tree WHERE n <= (SELECT count(*) - 4 FROM villages))),
least AS (SELECT l, least(l, coalesce(min(y), l)) AS first FROM villages LEFT JOIN joined ON x = l GROUP BY l)
SELECT l::VARCHAR AS locality, (dense_rank() OVER (ORDER BY first) - 1)::INT AS label FROM least""")
def cut_k4_sl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.partition_rows(clustered(spark, sf_dir, ["sl"])).select("locality", "label")


@query(f"WITH RECURSIVE {MINIMAX_SQL}, dist AS (SELECT a AS x, b AS y, round_even(avg(distance), 9) AS d FROM dtw GROUP BY 1, 2) SELECT round_even(corr(d, coalesce(h, 0)), 6) AS r FROM dist LEFT JOIN coph USING (x, y)")
def cophenetic_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distances(spark, sf_dir, None).withColumn("dist", round_half_even(F.col("dist"), 9)).withColumns({c: F.col(c).cast("string") for c in ("row_loc", "col_loc")})
    coph = clustering.cophenetic_rows(clustering.cluster(d, 4, ["sl"], KEYS))
    met = d.join(coph, [*KEYS, "row_loc", "col_loc"])
    return select.pearson(met, [*KEYS, "method"], "dist", "coph").select(round_half_even(F.col("r"), 6).alias("r"))


BEST_R_SQL = f"""WITH RECURSIVE {merge_sql(METHODS, 4)},
dist AS (SELECT a AS x, b AS y, round_even(avg(distance), 4) AS d FROM dtw GROUP BY 1, 2),
r AS (SELECT method, corr(d, CASE WHEN dist.x = dist.y THEN 0 ELSE h END) AS r FROM dist CROSS JOIN (SELECT unnest({list(METHODS)!r}) AS method) LEFT JOIN coph USING (method, x, y) GROUP BY 1)
SELECT 'm' AS model, 1 AS layer, method, round_even(r, 6) AS r, CASE WHEN r = max(r) OVER () THEN 'X' ELSE '' END AS max_r FROM r"""


@query(BEST_R_SQL)
def cophenetic_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven methods' correlations, the best one marked; one clustering pass."""
    d = distances(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in ("row_loc", "col_loc")})
    coph = clustering.cophenetic_rows(clustering.cluster(d, 4, METHODS, KEYS))
    r = select.pearson(d.join(coph, [*KEYS, "row_loc", "col_loc"]), [*KEYS, "method"], "dist", "coph")
    return select.marked(select.best_with_ties(r, KEYS, "r")).withColumn("r", round_half_even(F.col("r"), 6))


@query(f"""WITH RECURSIVE {merge_sql(("ga", "wm"))}
SELECT method, village::VARCHAR AS locality, (dense_rank() OVER (PARTITION BY method ORDER BY cluster) - 1)::INT AS label
FROM clusters WHERE step = (SELECT count(DISTINCT label) - 4 FROM embeddings)""")
def cut_k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.partition_rows(clustered(spark, sf_dir, ["ga", "wm"])).select("method", "locality", "label")


@query(f"WITH RECURSIVE {DTW_SQL} SELECT a AS row_loc, b AS col_loc, list(DISTINCT word ORDER BY word) AS words FROM dtw GROUP BY 1, 2")
def words_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.locality_distances(frames(spark, sf_dir, TWO_SETS.replace("ELSE 5", "ELSE 0")), KEYS, words=True).select("row_loc", "col_loc", "words")


@query("SELECT label % 4 AS label, round_even(avg(embedding[1]::DOUBLE), 6) AS x, round_even(avg(embedding[2]::DOUBLE), 6) AS y FROM embeddings GROUP BY 1")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evaluate.centroids(points(spark, sf_dir).withColumn("label", F.col("gold")), [])
    return made.select("label", *[round_half_even(F.col("centroid")[i], 6).alias(c) for i, c in enumerate(("x", "y"))])


# Distances of transcriptions stand beside those of the model: here absolute differences of the villages' mean first
# numbers.
LD_SQL = "means AS (SELECT label, avg(embedding[1]::DOUBLE) AS x FROM embeddings GROUP BY 1), ld AS (SELECT a.label AS x, b.label AS y, round_even(abs(a.x - b.x), 9) AS d FROM means a CROSS JOIN means b)"


def transcription_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model and layer `LD`, row_loc, col_loc, dist."""
    means = embeddings(spark, sf_dir).groupBy(F.col("label").cast("string").alias("locality")).agg(F.avg(F.col("embedding")[0].cast("double")).alias("x"))
    grid = matrix.scaffold(spark.createDataFrame([], "row_loc string, col_loc string"), means.select("locality"), [])
    met = grid.join(means.select(F.col("locality").alias("row_loc"), F.col("x").alias("a")), "row_loc").join(means.select(F.col("locality").alias("col_loc"), F.col("x").alias("b")), "col_loc")
    return met.select(F.lit("LD").alias("model"), F.lit("LD").alias("layer"), "row_loc", "col_loc", round_half_even(F.abs(F.col("a") - F.col("b")), 9).alias("dist"))


LD_R_SQL = merge_sql(METHODS).replace("apart AS MATERIALIZED (SELECT a AS x, b AS y, round_even(avg(distance), 9) AS d FROM dtw WHERE a <> b GROUP BY 1, 2)", f"{LD_SQL}, apart AS MATERIALIZED (SELECT x, y, d FROM ld WHERE x <> y)")


@query(f"WITH RECURSIVE {LD_R_SQL} SELECT 'LD' AS model, 'LD' AS layer, method AS clustering, round_even(corr(d, CASE WHEN ld.x = ld.y THEN 0 ELSE h END), 6) AS r FROM ld CROSS JOIN (SELECT unnest({list(METHODS)!r}) AS method) LEFT JOIN coph USING (method, x, y) GROUP BY 3")
def cophenetic_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcription matrix against each method's cophenetic distances."""
    d = transcription_distances(spark, sf_dir)
    coph = clustering.cophenetic_rows(clustering.cluster(d, 4, METHODS, KEYS))
    r = select.pearson(d.join(coph, [*KEYS, "row_loc", "col_loc"]), [*KEYS, "method"], "dist", "coph")
    return r.select("model", "layer", F.col("method").alias("clustering"), round_half_even(F.col("r"), 6).alias("r"))


# Every point counts, by its place in the cluster.
@query("SELECT label % 4 AS label, count(*) AS size, round_even(list_sum(list_transform(list([embedding[1]::DOUBLE, embedding[2]::DOUBLE] ORDER BY vec_id), lambda p, i: i * (p[1] + 2 * p[2]))), 5) AS weighted FROM embeddings GROUP BY 1")
def clusterify(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evaluate.clusterify(points(spark, sf_dir).withColumn("label", F.col("gold")), [])
    weighted = F.aggregate(F.transform("points", lambda p, i: (i + 1) * (p[0] + 2 * p[1])), F.lit(0.0), lambda s, v: s + v)
    return made.select("label", F.size("points").cast("long").alias("size"), round_half_even(weighted, 5).alias("weighted"))


@query("SELECT (vec_id % 4)::INT AS label, count(*) AS size, round_even(count(*)::DOUBLE / (SELECT count(*) FROM embeddings), 9) AS weight FROM embeddings GROUP BY 1")
def cluster_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cluster_weights(points(spark, sf_dir), []).withColumn("weight", round_half_even(F.col("weight"), 9))


GROUND_SQL = "pts AS (SELECT vec_id, label, [embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS p FROM embeddings)"


@query(f"WITH {GROUND_SQL} SELECT a.vec_id AS a, b.vec_id AS b, round_even(list_distance(a.p, b.p), 6) AS cost FROM pts a JOIN pts b USING (label)")
def ground_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embeddings(spark, sf_dir).select("label", F.col("vec_id").alias("id"), *[F.col("embedding")[i].alias(c) for i, c in enumerate("xy")])
    return pairs.point_distances(p, ["label"])


# The first dimension: transport cost is the area between two distribution functions.
EMD_SQL = """v AS (SELECT label % 2 AS gold, vec_id % 2 AS pred, embedding[1]::DOUBLE AS x FROM embeddings),
sides AS (SELECT 'g' || gold AS side, x, 1.0 / count(*) OVER (PARTITION BY gold) AS mass FROM v UNION ALL SELECT 'p' || pred, x, 1.0 / count(*) OVER (PARTITION BY pred) FROM v),
arms AS (SELECT DISTINCT i, j FROM (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j)),
moves AS (SELECT i, j, x, sum(CASE WHEN side = 'p' || i THEN mass ELSE -mass END)::DOUBLE AS w FROM arms JOIN sides ON side IN ('p' || i, 'g' || j) GROUP BY 1, 2, 3),
area AS (SELECT i, j, abs(sum(w) OVER (PARTITION BY i, j ORDER BY x)) * (lead(x) OVER (PARTITION BY i, j ORDER BY x) - x) AS part FROM moves),
emd AS (SELECT i, j, sum(part) AS cost FROM area GROUP BY 1, 2)"""


def _line(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = embeddings(spark, sf_dir).select(F.col("vec_id").alias("locality"), F.array(F.col("embedding")[0].cast("double")).alias("point"), (F.col("label") % 2).cast("int").alias("gold"), (F.col("vec_id") % 2).cast("int").alias("label"))
    return e.select("locality", "label"), e.select("locality", F.col("gold").alias("label")), e.select("locality", "point")


def transport_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j, cost between predicted and gold clusters of the first dimension."""
    predicted, gold, where = _line(spark, sf_dir)
    x = where.select("locality", F.col("point")[0].alias("x"))
    return evaluate.line_costs(predicted.join(x, "locality"), gold.join(x, "locality"))


@query(f"WITH {EMD_SQL} SELECT i, j, round_even(cost, 6) AS cost FROM emd")
def emd_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_table(spark, sf_dir).withColumn("cost", round_half_even(F.col("cost"), 6))


@query(f"""WITH {EMD_SQL}, w AS (SELECT pred AS i, count(*) / sum(count(*)) OVER () AS p FROM v GROUP BY 1), u AS (SELECT gold AS j, count(*) / sum(count(*)) OVER () AS q FROM v GROUP BY 1)
SELECT round_even(sum(p * q * cost), 6) AS naive FROM emd JOIN w USING (i) JOIN u USING (j)""")
def naive_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted, gold, _ = _line(spark, sf_dir)
    p = evaluate.cluster_weights(predicted, []).select(F.col("label").alias("i"), F.col("weight").alias("p"))
    q = evaluate.cluster_weights(gold, []).select(F.col("label").alias("j"), F.col("weight").alias("q"))
    met = transport_table(spark, sf_dir).join(p, "i").join(q, "j")
    return met.agg(round_half_even(F.sum(F.col("p") * F.col("q") * F.col("cost")), 6).alias("naive"))


@query(f"""WITH {EMD_SQL}, w AS (SELECT count(*) FILTER (WHERE pred = 0) / count(*) AS p, count(*) FILTER (WHERE gold = 0) / count(*) AS q FROM v),
c AS (SELECT max(cost) FILTER (WHERE i = 0 AND j = 0) AS c00, max(cost) FILTER (WHERE i = 0 AND j = 1) AS c01, max(cost) FILTER (WHERE i = 1 AND j = 0) AS c10, max(cost) FILTER (WHERE i = 1 AND j = 1) AS c11 FROM emd),
t AS (SELECT *, unnest([greatest(0, p + q - 1), least(p, q)]) AS t FROM w, c)
SELECT round_even(min(t * c00 + (p - t) * c01 + (q - t) * c10 + (1 - p - q + t) * c11) / max(p * q * c00 + p * (1 - q) * c01 + (1 - p) * q * c10 + (1 - p) * (1 - q) * c11), 6) AS cdistance FROM t""")
def cdistance_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer problem has one free variable, so SQL finds its least value at an end."""
    predicted, gold, _ = _line(spark, sf_dir)
    model = F.lit("m").alias("model")
    p, q = evaluate.cluster_weights(predicted, []).select("*", model), evaluate.cluster_weights(gold, [])
    found = evaluate.outer_cdistances(transport_table(spark, sf_dir).select("*", model), p, q, ["model"], "cdistance")
    return found.select(round_half_even(F.col("cdistance"), 6).alias("cdistance"))


# Masses are multiples of one part, so an optimal flow moves whole parts: points of one side are served one after
# another, in all ways to split their parts over what the other side can still take, and of equal remainders the
# cheapest is kept.
EXACT_SQL = f"""{merge_sql(METHODS, 4)},
means AS MATERIALIZED (SELECT label AS village, avg(embedding[1]::DOUBLE) AS x, avg(embedding[2]::DOUBLE) AS y FROM embeddings GROUP BY 1),
mine AS MATERIALIZED (SELECT method, cluster AS i, village, x, y, row_number() OVER (PARTITION BY method, cluster ORDER BY village) AS k, count(*) OVER (PARTITION BY method, cluster) AS a
         FROM clusters JOIN means USING (village) WHERE step = (SELECT count(DISTINCT label) - 4 FROM embeddings)),
gold AS MATERIALIZED (SELECT village % 4 AS j, village, x, y, count(*) OVER (PARTITION BY village % 4) AS b FROM means),
problems AS MATERIALIZED (SELECT method, i, j, k, a, b, lcm(a, b) AS n, list(sqrt((m.x - g.x) ** 2 + (m.y - g.y) ** 2) ORDER BY g.village) AS d FROM mine m CROSS JOIN gold g GROUP BY ALL),
splits(w, s, parts) AS (SELECT 0, 0, []::BIGINT[] UNION ALL SELECT w + 1, s + v, list_append(parts, v) FROM splits CROSS JOIN (SELECT unnest(range(11)) AS v) WHERE w < 4 AND s + v <= 10),
serve(method, i, j, k, room, cost) AS (
  SELECT DISTINCT method, i, j, 0::BIGINT, list_transform(range(b), lambda t: n // b)::BIGINT[], 0::DOUBLE FROM problems
  UNION ALL
  SELECT method, i, j, k, room, cost FROM (
    SELECT p.method, p.i, p.j, p.k, list_transform(range(1, b + 1), lambda t: room[t] - parts[t])::BIGINT[] AS room, cost + list_sum(list_transform(range(1, b + 1), lambda t: parts[t] * d[t])) / n AS cost
    FROM serve s JOIN problems p ON p.method = s.method AND p.i = s.i AND p.j = s.j AND p.k = s.k + 1 JOIN splits ON w = b AND splits.s = n // a
    WHERE list_min(list_transform(range(1, b + 1), lambda t: room[t] - parts[t])) >= 0)
  QUALIFY row_number() OVER (PARTITION BY method, i, j, room ORDER BY cost) = 1),
emds AS MATERIALIZED (SELECT DISTINCT s.method, s.i, s.j, a, b, cost FROM serve s JOIN problems p ON p.method = s.method AND p.i = s.i AND p.j = s.j AND s.k = a)"""


@query(f"""WITH RECURSIVE {EXACT_SQL}
SELECT method, (dense_rank() OVER (PARTITION BY method ORDER BY i) - 1)::INT AS i, j::INT AS j, round_even(cost, 6) AS cost, 0::DOUBLE AS short, 0::DOUBLE AS over, 0::DOUBLE AS gap FROM emds""")
def transport_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport between each cluster of each method and each gold cluster, with what proves it cheapest."""
    cut, where = villages_cut(spark, sf_dir)
    keys = ["method", "i", "j"]
    other = [r[0] for r in where.select("label").distinct().orderBy("label").collect()]
    mine = cut.join(where.select("locality", "point"), "locality").select("method", F.col("label").alias("i"), F.col("locality").alias("name"), "point")
    gold = where.select(F.col("label").cast("int").alias("j"), F.col("locality").alias("name"), "point")
    left = mine.withColumn("j", F.explode(F.array(*[F.lit(v).cast("int") for v in other]))).select(*keys, "name", "point")
    right = gold.join(mine.select("method", "i").distinct().withColumn("j", F.explode(F.array(*[F.lit(v).cast("int") for v in other]))), "j").select(*keys, "name", "point")
    left, right = written(left, "left"), written(right, "right")
    return certified(evaluate.certificates(written(evaluate.transport_plans(left, right, keys), "plans"), left, right, keys))


def certified(found: DataFrame) -> DataFrame:
    return found.withColumns({"cost": round_half_even(F.col("cost"), 6), "short": F.abs(round_half_even(F.col("short"), 9)), "over": F.greatest(round_half_even(F.col("over"), 9), F.lit(0.0)), "gap": F.abs(round_half_even(F.col("gap"), 9))})


@query("""WITH p AS (SELECT vec_id, vec_id // 64 AS block, [embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS p FROM embeddings)
SELECT a.block, round_even(avg(list_distance(a.p, b.p)), 6) AS naive, true AS at_most_naive, 0::DOUBLE AS short, 0::DOUBLE AS over, 0::DOUBLE AS gap
FROM p a JOIN p b ON a.block = b.block AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY 1""")
def transport_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport from the even to the odd vectors of each 64 by id: the flow's and the potentials' proof, as many
    problems as the table has blocks."""
    p = embeddings(spark, sf_dir).select(F.expr("vec_id div 64").alias("block"), F.col("vec_id").alias("name"), F.array(*[F.col("embedding")[i].cast("double") for i in range(2)]).alias("point"))
    left, right = p.filter("name % 2 = 0"), p.filter("name % 2 = 1")
    plans = written(evaluate.transport_plans(left, right, ["block"]), "plans")
    found = evaluate.certificates(plans, left, right, ["block"])
    met = left.select("block", F.col("point").alias("a")).join(right.select("block", F.col("point").alias("b")), "block")
    naive = written(met.groupBy("block").agg(F.avg(ground_distance(F.col("a"), F.col("b"))).alias("naive")), "naive")
    out = certified(found).join(naive, "block")
    return out.select("block", round_half_even(F.col("naive"), 6).alias("naive"), (F.col("cost") <= F.col("naive") + 1e-6).alias("at_most_naive"), "short", "over", "gap")


# A circle of length 1: the area of F - G under its maximum; k turns the gold halves by k - 1 parts of 28.
@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE - floor(embedding[1]::DOUBLE) AS x FROM embeddings),
turned AS (SELECT k, x, CASE WHEN (x - (k - 1) / 28.0::DOUBLE) - floor(x - (k - 1) / 28.0::DOUBLE) < 0.5 THEN 0 ELSE 1 END AS i, CASE WHEN x < 0.5 THEN 0 ELSE 1 END AS j FROM v CROSS JOIN (SELECT unnest(range(1, 16)) AS k)),
sides AS (SELECT k, 'p' || i AS side, x, 1.0::DOUBLE / count(*) OVER (PARTITION BY k, i) AS mass FROM turned UNION ALL SELECT k, 'q' || j, x, 1.0::DOUBLE / count(*) OVER (PARTITION BY k, j) FROM turned),
moves AS (SELECT k, i, j, x, sum(CASE WHEN side = 'p' || i THEN mass ELSE -mass END) AS w FROM sides JOIN (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(i, j)) ON side IN ('p' || i, 'q' || j) GROUP BY 1, 2, 3, 4),
apart AS (SELECT k, i, j, x, sum(w) OVER o AS h, coalesce(lead(x) OVER o - x, 0) AS dx FROM moves WINDOW o AS (PARTITION BY k, i, j ORDER BY x)),
c AS (SELECT k, i, j, greatest(max(h), 0) - sum(h * dx) AS cost FROM apart GROUP BY 1, 2, 3),
p AS (SELECT k, avg(1 - i) AS p, avg(1 - j) AS q FROM turned GROUP BY 1),
t AS (SELECT k, p, q, unnest([greatest(0, p + q - 1), least(p, q)]) AS t FROM p),
wide AS (SELECT k, max(cost) FILTER (WHERE i = 0 AND j = 0) AS c00, max(cost) FILTER (WHERE i = 0 AND j = 1) AS c01, max(cost) FILTER (WHERE i = 1 AND j = 0) AS c10, max(cost) FILTER (WHERE i = 1 AND j = 1) AS c11 FROM c GROUP BY 1)
SELECT k::INT AS k, round_even(min(t * c00 + (p - t) * c01 + (q - t) * c10 + (1 - p - q + t) * c11) / max(p * q * c00 + p * (1 - q) * c01 + (1 - p) * q * c10 + (1 - p) * (1 - q) * c11), 6) AS cdistance FROM t JOIN wide USING (k) GROUP BY 1""")
def circle_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split of a circle into halves against the same split turned by k - 1 parts of 28: 0 at k = 1."""
    value = F.col("embedding")[0].cast("double")
    x = embeddings(spark, sf_dir).select((value - F.floor(value)).alias("x"))
    turned = F.col("x") - (F.col("k") - 1) / F.lit(28.0)
    rows = x.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(15)))).select("k", "x", F.when(F.col("x") < 0.5, 0).otherwise(1).alias("i"), F.when(turned - F.floor(turned) < 0.5, 0).otherwise(1).alias("j"))
    predicted, fixed = rows.select("k", F.col("j").alias("label"), "x"), rows.filter("k = 1").select(F.col("i").alias("label"), "x")
    costs = evaluate.line_costs(predicted, fixed, ["k"], circle=True)
    p = evaluate.cluster_weights(predicted, ["k"])
    return evaluate.outer_cdistances(costs, p, evaluate.cluster_weights(fixed, []), ["k"], "cdistance").withColumn("cdistance", round_half_even(F.col("cdistance"), 6))


def villages_cut(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each method's partition of the villages into four, and the villages' points with their gold labels."""
    rows = distances(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in ("row_loc", "col_loc")})
    cut = clustering.partition_rows(clustering.cluster(rows, 4, METHODS, KEYS))
    means = embeddings(spark, sf_dir).groupBy("label").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"x{i}") for i in range(2)])
    return cut, means.select(F.col("label").cast("string").alias("locality"), F.array("x0", "x1").alias("point"), (F.col("label") % 4).alias("label"))


@query(f"""WITH RECURSIVE {EXACT_SQL},
outer_problems AS MATERIALIZED (SELECT method, i, a, row_number() OVER (PARTITION BY method ORDER BY i) AS k, list(cost ORDER BY j) AS d, list(b ORDER BY j)::BIGINT[] AS sizes FROM emds GROUP BY 1, 2, 3),
share(method, k, room, cost) AS (
  SELECT DISTINCT method, 0::BIGINT, sizes, 0::DOUBLE FROM outer_problems
  UNION ALL
  SELECT method, k, room, cost FROM (
    SELECT p.method, p.k, list_transform(range(1, len(d) + 1), lambda t: room[t] - parts[t])::BIGINT[] AS room, cost + list_sum(list_transform(range(1, len(d) + 1), lambda t: parts[t] * d[t])) / list_sum(sizes) AS cost
    FROM share s JOIN outer_problems p ON p.method = s.method AND p.k = s.k + 1 JOIN splits ON w = len(d) AND splits.s = a
    WHERE list_min(list_transform(range(1, len(d) + 1), lambda t: room[t] - parts[t])) >= 0)
  QUALIFY row_number() OVER (PARTITION BY method, room ORDER BY cost) = 1),
naive AS (SELECT method, sum(a * b * cost) / ((SELECT count(*) FROM means) * (SELECT count(*) FROM means)) AS naive FROM emds GROUP BY 1),
found AS (SELECT method, cost / naive AS d FROM share JOIN naive USING (method) WHERE k = 4)
SELECT 'm' AS model, 1 AS layer, method, round_even(d, 6) AS "CDistance", round_even(d, 6) = round_even(min(d) OVER (), 6) AS is_best FROM found""")
def cdistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method's partition of the villages into four against label % 4, over the means of their vectors' first
    two numbers: the whole evaluation, from frames to scores, with each method's rank."""
    cut, where = villages_cut(spark, sf_dir)
    found = evaluate.cdistances(cut, where.select("locality", "label"), where, [*KEYS, "method"])
    return select.best_with_ties(found.withColumn("CDistance", round_half_even(F.col("CDistance"), 6)), ["model"], "CDistance", False)
