"""Stages on tables of documents that keep every column: rows kept or texts rewritten by a kernel on whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import bounded_batches, frugal, slices


def keep_rows(docs: DataFrame, keep: Callable[[list[int | None], list[bytes | None]], list[bool]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, for which keep(ids, texts) is true. keep gets null ids and texts as None, and
    repeated rows each; an empty table gives an empty result, and names of further columns don't matter."""
    bounded_batches(docs.sparkSession)
    i, t = docs.columns.index(id_col), docs.columns.index(text_col)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            mask = keep(batch.column(i).to_pylist(), batch.column(t).cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array(np.asarray(mask, bool)))

    return docs.mapInArrow(run, docs.schema)


def rewrite_texts(docs: DataFrame, rewrite: Callable[[list[bytes | None]], list[bytes | None]], text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with each text replaced, and its number of characters where there is a column for it and it changed.
    rewrite gets a null text as None and may leave it; repeated rows give repeated results, an empty table an empty
    one, and names of further columns don't matter."""
    bounded_batches(docs.sparkSession)
    t = docs.columns.index(text_col)
    n = docs.columns.index(size_col) if size_col in docs.columns else -1

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns, kind = list(batch.columns), batch.schema.field(t).type
            old = columns[t].cast(pa.binary()).to_pylist()
            new = rewrite(old)
            columns[t] = pa.array(new, pa.binary()).cast(kind)
            if n >= 0:
                size, changed = columns[n].to_pylist(), [a != b for a, b in zip(old, new, strict=True)]
                columns[n] = pa.array([(None if b is None else len(b.decode())) if c else v for v, b, c in zip(size, new, changed, strict=True)], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def one_of_each(docs: DataFrame, members: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is the component_id of members(doc_id, component_id), one row for an id that is
    repeated (the one whose text form sorts first, by a digest of all columns), and all rows with a null id. An empty
    table gives an empty result; names of further columns don't matter, and they may be of any type."""
    key, n = ("_".join(["__own", name, *docs.columns]) for name in ("key", "n"))  # longer than any name of a column
    ids = members.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias(n))

    def kept(which: str) -> DataFrame:
        return docs.join(ids.filter(F.expr(f"`{n}` {which}")).select(key), F.col(f"`{id_col}`") == F.col(key), "left_semi")

    text = F.sha2(F.concat_ws("\n", *[F.coalesce(F.to_json(F.struct(F.col(f"`{c}`"))), F.lit("")) for c in docs.columns]), 256)
    first = Window.partitionBy(F.col(f"`{id_col}`")).orderBy(text)
    some = kept("> 1").withColumn(n, F.row_number().over(first)).filter(F.col(n) == 1).drop(n)
    return kept("= 1").unionByName(some).unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))
