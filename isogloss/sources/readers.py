"""Readers: everything goes through Spark's own file readers, so that any store works."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import contains, file_stem, path_part
from ..operators.running import running_sums
from ..session import written

# Cells of a matrix file without a distance.
NOT_AVAILABLE = ("", "NA", "N/A", "nan", "NaN", "null", "NULL", "None")
# Folders of transcription distances and of triangular matrix files, whose distances are model `ld`.
TRANSCRIPTIONS, TRIANGULAR = "transcription-distances", "data-l04-106"


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """path, village_key, word and content of `<village>_<word>.wav` files in a folder; an empty folder is an error."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    parts = F.split(file_stem(path_part(F.col("path"), 1)), "_")
    df = df.select("path", F.upper(parts[0]).alias("village_key"), F.try_element_at(parts, F.lit(2)).alias("word"), "content")
    if df.select("path").isEmpty():
        raise FileNotFoundError(f"no .wav files in {folder}")
    return df


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (float32, -1 to 1, channels averaged) of PCM or float WAV data."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, code, channels, bits = 12, 0, 0, 1, 16
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if code == 0xFFFE:
                code = struct.unpack("<H", body[24:26])[0]
        elif name == b"data":
            if code == 3:
                x = np.frombuffer(body, "<f4" if bits == 32 else "<f8").astype(np.float32)
            elif bits == 24:
                raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
            elif bits == 8:
                x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
            else:
                x = np.frombuffer(body, f"<i{bits // 8}").astype(np.float32) / float(1 << (bits - 1))
            return rate, x[: len(x) // channels * channels].reshape(-1, channels).mean(1, dtype=np.float32) if channels > 1 else x
        at += 8 + size + (size & 1)
    raise ValueError("no samples in the WAV file")


def waveforms(recorded: DataFrame, rate: int = 16_000) -> DataFrame:
    """recordings() with rate and waveform in place of content; another rate is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [decode_wav(c) for c in frame.pop("content")]
            for (r, _), path in zip(made, frame["path"], strict=True):
                if r != rate:
                    raise ValueError(f"{path} has {r} samples a second, not {rate}")
            yield frame.assign(rate=[r for r, _ in made], waveform=[x for _, x in made])

    return recorded.mapInPandas(run, schemas.WAVEFORM)


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Frames written by writers.features()."""
    return spark.read.schema(schemas.FRAMES).parquet(folder)


def npy_features(spark: SparkSession, pattern: str) -> DataFrame:
    """path, model, layer, village_key, word and frames of `<model>/layer-<l>/<village>_<word>/<file>.npy` files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in batch.pop("content")]
            yield batch.assign(frames=[[row.astype(np.float32) for row in np.atleast_2d(a)] for a in arrays])

    path = F.col("path")
    speaker = F.split(path_part(path, 2), "_")
    named = df.select("path", path_part(path, 4).alias("model"), F.regexp_extract(path_part(path, 3), r"(\d+)", 1).try_cast("int").alias("layer"), F.upper(speaker[0]).alias("village_key"), F.try_element_at(speaker, F.lit(2)).alias("word"), "content")
    return named.mapInPandas(run, "path string, model string, layer int, village_key string, word string, frames array<array<float>>")


def _number(x: Column) -> Column:
    """A cell as a double: null where it says that there is none, an error where it says something else."""
    value = x.try_cast("double")
    none = F.trim(x).isin(*NOT_AVAILABLE) | x.isNull() | F.isnan(value)
    wrong = F.raise_error(F.concat(F.lit("not a number: "), x)).cast("double")
    return F.when(none, F.lit(None).cast("double")).when(value.isNull(), wrong).otherwise(value)


def _long(df: DataFrame, value: str, rows: str = "row_loc") -> DataFrame:
    cells = df.unpivot([rows], [c for c in df.columns if c != rows], "col_loc", value)
    return cells.withColumnRenamed(rows, "row_loc")


def matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """row_loc, col_loc, dist of a CSV file with a header and row labels; empty, NA and nan are null, any other text
    that is not a number is an error."""
    df = spark.read.option("header", True).csv(path)
    first = df.columns[0]
    df = df.select(F.col(f"`{first}`").alias("row_loc"), *[F.col(f"`{c}`") for c in df.columns[1:]])
    return _long(df, "dist").withColumn("dist", _number(F.col("dist")))


def cophenetic_tab(spark: SparkSession, path: str, labels: Sequence[str]) -> DataFrame:
    """row_loc, col_loc, coph of a tab-separated file without a header, whose columns are the labels in order."""
    schema = ", ".join(["row_loc string", *[f"`{n}` double" for n in labels]])
    return _long(spark.read.option("sep", "\t").schema(schema).csv(path), "coph")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """locality, label of a CSV file with a header (a byte order mark and CRLF are fine)."""
    return spark.read.option("header", True).schema(schemas.GOLD).csv(path)


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """locality, longitude, latitude of a CSV file without a header."""
    return spark.read.schema(schemas.COORDINATES).csv(path)


def _lines(spark: SparkSession, pattern: str) -> DataFrame:
    """path, pos (from 0) and line of whole text files, in order."""
    df = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return df.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def partition_labels(lines: DataFrame, group: Sequence[str], pos: str = "pos", line: str = "line", blank=None) -> DataFrame:
    """Lines with a label: how many blank lines came before in the group. Blank lines themselves go, so a group
    without members leaves a gap in the labels; without any blank line all is one cluster. A group may have any
    number of lines; their places differ."""
    blank = F.trim(F.col(line)) == "" if blank is None else blank
    marked = running_sums(lines.withColumn("__blank", blank), group, [pos], {"label": F.col("__blank").cast("int")}).withColumn("label", F.col("label").cast("int"))
    return marked.filter(~F.col("__blank")).drop("__blank")


def partitions(spark: SparkSession, pattern: str) -> DataFrame:
    """path, locality, label of partition files: one locality a line, clusters parted by a blank line."""
    return partition_labels(_lines(spark, pattern), ["path"]).select("path", F.col("line").alias("locality"), "label")


def dif(spark: SparkSession, pattern: str) -> DataFrame:
    """path, row_loc, col_loc, dist (row after column in the file's order) of triangular matrix files: the number of
    labels, the labels, then the strict lower triangle row by row; blank lines don't count. A file that has more or fewer
    lines than its number asks for is an error; one without lines has no cells.

    Files are read in splits, lines are numbered by running sums, and a line's number gives its row and column, so that
    no task has to hold a file.
    """
    lines = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    # A split is read by one task from its start on, so ids are in the order of its lines.
    at = running_sums(lines.filter(F.trim("line") != ""), ["path"], ["block", "id"], {"at": F.lit(1).cast("long")}).select("path", "line", (F.col("at") - 1).alias("at"))
    n = F.max(F.when(F.col("at") == 0, F.trim("line").try_cast("long")))
    heads = at.groupBy("path").agg(n.alias("n"), F.count("*").alias("lines"))
    wrong = F.raise_error(F.concat(F.lit("not as many lines as a matrix of its size has: "), F.col("path"))).cast("long")
    heads = written(heads.select("path", F.when(F.col("lines") == 1 + F.col("n") + F.col("n") * (F.col("n") - 1) / 2, F.col("n")).otherwise(wrong).alias("n")), "heads")
    # A row a file, broadcast once counted.
    sized = at.join(F.broadcast(heads) if heads.count() <= 500_000 else heads, "path")
    k = F.col("at") - F.col("n") - 1
    cells = sized.filter("at > n").withColumn("k", k).withColumn("i", F.floor((1 + F.sqrt(1.0 + 8 * F.col("k"))) / 2))
    # The root of a large number may be off by one.
    first = F.expr("i * (i - 1) div 2")
    cells = cells.withColumn("i", F.when(first > F.col("k"), F.col("i") - 1).when(first + F.col("i") <= F.col("k"), F.col("i") + 1).otherwise(F.col("i"))).withColumn("j", F.col("k") - first)
    names = sized.filter("at between 1 and n").select("path", (F.col("at") - 1).alias("i"), F.col("line").alias("name"))
    rows, columns = names.withColumnRenamed("name", "row_loc"), names.select("path", F.col("i").alias("j"), F.col("name").alias("col_loc"))
    return cells.join(rows, ["path", "i"]).join(columns, ["path", "j"]).select("path", "row_loc", "col_loc", _number(F.col("line")).alias("dist"))


def file_metadata(paths: DataFrame, path: str = "path") -> DataFrame:
    """model, layer and method that a result file's path names: `<model>/<layer>/<file>.<method>.<kind>.<suffix>`."""
    p = F.col(path)
    return paths.withColumns({"model": path_part(p, 3), "layer": path_part(p, 2), "method": path_part(path_part(p, 1), 3, ".")})


def file_counts(paths: DataFrame, path: str = "path") -> DataFrame:
    """model, layer and n, the number of files that are in the folder of each; paths may repeat and count once."""
    return file_metadata(paths.select(path).distinct(), path).groupBy("model", "layer").agg(F.count("*").alias("n"))


def result_files(paths: DataFrame, path: str = "path", models: Sequence[str] | None = None, method: str | None = None) -> DataFrame:
    """The paths of matrices, with kind, model, layer and method. kind: `layer` where the folders name one, else
    `ld` where they are those of transcription distances; other paths go. model: `ld` in the folder of triangular
    files. models and method: only these are kept (distances of transcriptions have no model to be kept by)."""
    named = file_metadata(paths, path)
    folders = F.concat_ws("-", "model", "layer")
    kind = F.when(contains(folders, "layer"), "layer").when(contains(folders, TRANSCRIPTIONS), "ld")
    named = named.withColumn("kind", kind).filter("kind is not null")
    if models is not None:
        named = named.filter((F.col("kind") == "ld") | F.col("model").isin(list(models)))
    if method is not None:
        named = named.filter(F.col("method") == method)
    return named.withColumn("model", F.when(F.col("model") == TRIANGULAR, "ld").otherwise(F.col("model")))
