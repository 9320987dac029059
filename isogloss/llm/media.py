"""Media columns (operator 3): byte payloads as lossless WebP images, and images as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .arrow_text import bounded_batches, map_texts, slices

#: Bytes of a row of samples; a payload is a whole number of rows. Rows of one image, at most.
ROW, ROWS = 576, 4096
#: Payloads from this size on get prefix codes of their own; those of smaller ones hold the preset code.
OWN_CODE = 1 << 14


@lru_cache(maxsize=2)
def preset(copies: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code lengths for all 256 samples, by the rule that the n-th of the usual text bytes weighs 1/n; with copies also
    for their lengths, and for all distances alike."""
    usual = b" etaoinsrhldcumfpgwybvkxjqz.,\n\xc3" + bytes(range(0x80, 0xC0)) + bytes(range(0x21, 0x7F))
    weight = np.ones(280, np.int64)
    for n, b in reversed(list(enumerate(usual))):
        weight[b] = 100_000 // (n + 1)
    weight[255] = 3000
    weight[256:] = 1000 * copies
    return webp.code_lengths(weight), webp.code_lengths(np.ones(40, np.int64))


def payload(text: bytes | None) -> bytes:
    """The text with bytes 255 up to a positive multiple of ROW."""
    text = text or b""
    return text + b"\xff" * (-len(text) % ROW if text else ROW)


def store(data: bytes) -> bytes:
    """Samples as grey images of ROW columns, one after the other where ROWS rows aren't enough."""
    out = []
    for at in range(0, len(data), ROW * ROWS):
        grey = np.frombuffer(data, np.uint8, min(ROW * ROWS, len(data) - at), at).reshape(-1, ROW)
        out.append(webp.encode_grey(grey, None if len(data) >= OWN_CODE else preset))
    return b"".join(out)


def images(stored: bytes) -> list[np.ndarray]:
    """The pixels of each image of a stored form."""
    out, at = [], 0
    while at < len(stored):
        size = 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        out.append(webp.decode(stored[at : at + size]))
        at += size
    return out


def load(stored: bytes) -> np.ndarray:
    """The samples of a stored form."""
    return np.concatenate([(p & np.uint32(255)).astype(np.uint8).ravel() for p in images(stored)])


def feature(samples: np.ndarray) -> str:
    """mean, standard deviation, entropy in bits and number of distinct samples, from their histogram."""
    counts = np.bincount(samples, minlength=256)
    p = counts / counts.sum()
    mean = float((p * np.arange(256)).sum())
    spread = float(np.sqrt(max(0.0, (p * np.arange(256) ** 2).sum() - mean * mean)))
    some = p[p > 0]
    return f"mean={mean:.4f};std={spread:.4f};entropy={abs(float((some * np.log2(some)).sum())):.4f};distinct={len(some)}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: the stored form of the text's payload (payload(), store()).

    A null text counts as empty; repeated rows give repeated results, a null id stays null, an empty table gives an
    empty result; other columns are not read.
    """
    return map_texts(docs, lambda ids, texts: {"doc_id": ids, "media": [store(payload(t)) for t in texts]}, "doc_id long, media binary", id_col, text_col)


def decode_images(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """doc_id, image (from 0), width, height and pixels (the ARGB bytes of each pixel in that order, row by row) of
    every image in a binary column. A null or empty value gives no rows; bytes that aren't lossless WebP are an
    error; repeated rows give repeated results."""
    bounded_batches(df.sparkSession)
    schema = "doc_id long, image int, width int, height int, pixels binary"

    def run(batches):
        for batch in slices(batches, 100):
            rows = [(i, k, p.shape[1], p.shape[0], p.astype(">u4").tobytes()) for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, p in enumerate(images(m or b""))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "image", "width", "height", "pixels"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{media_col}`").alias("media")).mapInArrow(run, schema)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As store_texts, then read back: sizes and digests of payload and stored form, and a feature of the samples.
    The stored forms stay in the task that makes them."""

    def batch(ids: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {f.split()[0]: [] for f in SCHEMA.split(", ")}
        out["doc_id"] = ids
        for text in texts:
            media = store(payload(text))
            samples = load(media)
            data = samples.tobytes()
            out["n_bytes"].append(len(text or b""))
            out["payload_bytes"].append(len(data))
            out["payload_sha256"].append(hashlib.sha256(data).hexdigest())
            out["tail_crc32"].append(zlib.crc32(data[-32:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(feature(samples))
        return out

    return map_texts(docs, batch, SCHEMA, id_col, text_col)
