"""Writers of matrices, partitions and scores."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import natural_key, round_half_even, zero_padded
from ..operators.matrix import lower_triangle, wide
from .files import write_files


def features(frames: DataFrame, folder: str) -> None:
    """Frames as Parquet, partitioned by model and layer; what was there is overwritten."""
    frames.write.mode("overwrite").partitionBy("model", "layer").parquet(folder)


def npy_features(frames: DataFrame, folder: str) -> None:
    """Frames as `<model>/layer-<l>/<recording>/layer-<ll>.npy` files below a folder, for programs that read those; what
    was there is overwritten. Tasks write the files and their commit moves them into place; features() is the way for
    large sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = []
            for x in batch["frames"]:
                out = io.BytesIO()
                np.save(out, np.stack(x).astype(np.float32) if len(x) else np.zeros((0, 0), np.float32))
                content.append(out.getvalue())
            yield pd.DataFrame({"path": batch["path"], "content": content})

    layer = F.col("layer").cast("string")
    path = F.concat_ws("/", "model", F.concat(F.lit("layer-"), layer), "recording", F.concat(F.lit("layer-"), zero_padded(layer, 2), F.lit(".npy")))
    write_files(frames.select(path.alias("path"), "frames").mapInPandas(run, "path string, content binary"), folder)


def _parted(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sorted rows of one file, or of a file for each group `by`."""
    rows = rows.repartition(*by) if by else rows.coalesce(1)
    return rows.sortWithinPartitions(*by, *order)


def matrix_csv(cells: DataFrame, labels: Sequence[str], folder: str, by: Sequence[str] = ()) -> None:
    """A matrix as CSV with a header and row labels, columns in the labels' order. by: a matrix for each group, all in one
    job, each in its own folder `<name>=<value>/...`."""
    _parted(wide(cells, labels, by), by, ["row_loc"]).write.mode("overwrite").partitionBy(*by).option("header", True).csv(folder)


def dif_lines(cells: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """kind, i, j and line of a triangular matrix file for each group `by`: the number of labels, the labels, then
    the strict lower triangle row by row, rounded to 7 digits. A missing distance is an error."""
    by = list(by)
    groups = cells.select(*by).distinct() if by else None

    def each(df: DataFrame) -> DataFrame:
        return df if groups is None else groups.crossJoin(df)

    head = each(labels.agg(F.count("*").alias("n"))).select(*by, F.lit(0).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("n").cast("string").alias("line"))
    names = each(labels).select(*by, F.lit(1).alias("kind"), F.col("ord").alias("i"), F.lit(0).alias("j"), F.col("locality").alias("line"))
    low = lower_triangle(cells, labels)
    value = F.when(F.col("dist").isNull(), F.raise_error(F.lit("a distance is missing"))).otherwise(round_half_even(F.col("dist"), 7).cast("string"))
    values = low.select(*by, F.lit(2).alias("kind"), F.col("row_ord").alias("i"), F.col("col_ord").alias("j"), value.alias("line"))
    return head.unionByName(names).unionByName(values)


def dif(cells: DataFrame, labels: DataFrame, folder: str, by: Sequence[str] = ()) -> None:
    """A matrix as a triangular matrix file (one part). by: a file for each group, all in one job, each in its own folder
    `<name>=<value>/...`."""
    rows = _parted(dif_lines(cells, labels, by), by, ["kind", "i", "j"])
    rows.select(*by, "line").write.mode("overwrite").partitionBy(*by).text(folder)


def cophenetic_tab(cells: DataFrame, labels: Sequence[str], folder: str) -> None:
    """Cophenetic distances of one matrix, tab-separated without a header."""
    wide(cells.withColumnRenamed("coph", "dist"), labels).coalesce(1).sortWithinPartitions("row_loc").write.mode("overwrite").option("sep", "\t").csv(folder)


def merges(rows: DataFrame, folder: str) -> None:
    """The merges of one clustering as tab-separated lines without a header, in order: step, height, size and the two
    clusters, named by their smallest members."""
    rows.select("step", "height", "size", "a", "b").coalesce(1).sortWithinPartitions("step").write.mode("overwrite").option("sep", "\t").csv(folder)


def partition(labelled: DataFrame, folder: str) -> None:
    """A partition as text: one locality a line, a blank line between clusters."""
    last = labelled.agg(F.max("label")).first()[0]
    blank = labelled.filter(F.col("label") < F.lit(last)).select("label").distinct().select("label", F.lit(1).alias("k"), F.lit("").alias("line"))
    rows = labelled.select("label", F.lit(0).alias("k"), F.col("locality").alias("line")).unionByName(blank)
    rows.coalesce(1).sortWithinPartitions("label", "k", "line").select("line").write.mode("overwrite").text(folder)


def r_scores(scores: DataFrame, folder: str, best_only: bool = False) -> None:
    """Cophenetic correlations as CSV, layers in natural order; best_only: the winners, else all with their mark."""
    rows = scores.filter("max_r = 'X'").drop("max_r") if best_only else scores
    layer = F.col("layer").cast("string")
    rows.coalesce(1).sortWithinPartitions("model", *natural_key(layer), "clustering").write.mode("overwrite").option("header", True).csv(folder)


def c_scores(scores: DataFrame, folder: str) -> None:
    """Clustering distances as CSV, rounded to 2 digits."""
    rows = scores.withColumn("CDistance", round_half_even(F.col("CDistance"), 2))
    rows.coalesce(1).sortWithinPartitions("model", "layer", "clustering").write.mode("overwrite").option("header", True).csv(folder)
