"""Frames of recordings by a pluggable featurizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructType

from .. import dims, schemas

#: From a waveform to (layer, frames) for each layer, all in one pass.
Featurizer = Callable[[np.ndarray], list[tuple[int, np.ndarray]]]
#: From waveforms of one batch (a row each, zeros after its end) and their lengths to (layer, frames of each row, numbers
#: of frames) for each layer. Frames after a row's number don't count, and a row's frames mustn't depend on the others.
BatchFeaturizer = Callable[[np.ndarray, np.ndarray], list[tuple[int, np.ndarray, np.ndarray]]]
#: Waveforms of a batch are at most so many times as long as its shortest one, so that little of it is padding.
SPREAD = 1.25


def resolve_model(name: str) -> str:
    """The hub's name of a model; names that aren't known stay."""
    return dims.MODELS.get(name, name)


def spectral_featurizer(layers: Sequence[int] = (1,), width: int = 400, hop: int = 320, size: int = 16) -> Featurizer:
    """A deterministic stand-in for a neural model: log band energies of windows, smoothed once more per layer."""

    def run(wave: np.ndarray) -> list[tuple[int, np.ndarray]]:
        wave = np.pad(wave, (0, max(0, width - len(wave))))
        rows = np.lib.stride_tricks.sliding_window_view(wave, width)[::hop] * np.hanning(width)
        bands = np.array_split(np.abs(np.fft.rfft(rows, axis=1)), size, axis=1)
        x = np.log1p(np.stack([b.mean(1) for b in bands], 1))
        out = []
        for layer in range(1, max(layers) + 1):
            x = (x + np.roll(x, 1, 0)) / 2 if layer > 1 else x
            if layer in layers:
                out.append((layer, x.astype(np.float32)))
        return out

    return run


def spectral_batches(layers: Sequence[int] = (1,), width: int = 400, hop: int = 320, size: int = 16) -> BatchFeaturizer:
    """spectral_featurizer for batches."""

    def run(waves: np.ndarray, lengths: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        waves = np.pad(waves, ((0, 0), (0, max(0, width - waves.shape[1]))))
        counts = (np.maximum(lengths, width) - width) // hop + 1
        rows = np.lib.stride_tricks.sliding_window_view(waves, width, axis=1)[:, ::hop] * np.hanning(width)
        bands = np.array_split(np.abs(np.fft.rfft(rows, axis=2)), size, axis=2)
        x = np.log1p(np.stack([b.mean(2) for b in bands], 2))
        out = []
        for layer in range(1, max(layers) + 1):
            if layer > 1:
                last = x[np.arange(len(x)), counts - 1]
                x = (x + np.concatenate([last[:, None], x[:, :-1]], 1)) / 2
            if layer in layers:
                out.append((layer, x, counts))
        return out

    return run


def batches_of_lengths(lengths: np.ndarray, rows: int) -> list[np.ndarray]:
    """Places of the lengths, shortest first, in batches of at most `rows` whose longest is at most SPREAD times the
    shortest; those of length 0 stand alone."""
    order, out = np.argsort(lengths, kind="stable"), []
    for at in order:
        if out and len(out[-1]) < rows and lengths[at] <= SPREAD * lengths[out[-1][0]]:
            out[-1].append(at)
        else:
            out.append([at])
    return [np.array(batch) for batch in out]


def featurizer_of(encode: Callable[[np.ndarray, int], list[np.ndarray]], convolve: Callable[[np.ndarray], np.ndarray], project: Callable[[np.ndarray], np.ndarray], layer: int | None = None) -> Featurizer:
    """The featurizer of a model of three parts, in the mode that `layer` stands for: None gives the hidden states of
    all layers (0 is what the first one gets), l >= 0 the last state of a model cut off after layer l, -1 the
    convolutional features after projection, and below -1 those before it.

    encode(waveform, depth): states of layers 0 to depth, -1 for all; convolve: frames of a waveform; project: frames.
    """

    def run(wave: np.ndarray) -> list[tuple[int, np.ndarray]]:
        if layer is None:
            return list(enumerate(encode(wave, -1)))
        if layer >= 0:
            return [(layer, encode(wave, layer)[layer])]
        frames = convolve(wave)
        return [(layer, project(frames) if layer == -1 else frames)]

    return run


def featurize(waves: DataFrame, model: str, load: Callable[[str], Featurizer]) -> DataFrame:
    """Frames of each layer of each recording. `load` makes the featurizer of a model once per task; village is the
    recording's key until lookup_strict names the locality."""
    name = resolve_model(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        featurizer = load(name)
        for batch in batches:
            rows = [
                (model, layer, village, word, path, [f.astype(np.float32) for f in frames])
                for path, village, word, wave in zip(batch["path"], batch["village_key"], batch["word"], batch["waveform"], strict=True)
                for layer, frames in featurizer(np.asarray(wave, np.float32))
            ]
            yield pd.DataFrame(rows, columns=["model", "layer", "village", "word", "recording", "frames"])

    return waves.mapInPandas(run, schemas.FRAMES)


def featurize_batches(waves: DataFrame, model: str, load: Callable[[str], BatchFeaturizer], rows: int = 16) -> DataFrame:
    """featurize() for models that are fed batches: a worker loads the model once and keeps it from task to task, and gets
    up to `rows` waveforms of about one length at a time, padded to the longest. Null waveforms count as empty."""
    name = resolve_model(model)

    def make() -> Callable[[np.ndarray, np.ndarray], list[dict[str, np.ndarray]]]:
        featurizer = load(name)

        def predict(waveforms: np.ndarray, lengths: np.ndarray) -> list[dict[str, np.ndarray]]:
            parts: list[list[tuple[int, np.ndarray]]] = [[] for _ in lengths]
            for batch in batches_of_lengths(lengths, rows):
                padded = np.zeros((len(batch), int(lengths[batch].max())), np.float32)
                for row, at in enumerate(batch):
                    padded[row, : lengths[at]] = waveforms[at]
                for layer, frames, counts in featurizer(padded, lengths[batch]):
                    for row, at in enumerate(batch):
                        parts[at].append((layer, np.asarray(frames[row, : counts[row]], np.float32)))
            return [
                {
                    "layers": np.array([layer for layer, _ in made], np.int32),
                    "counts": np.array([len(x) for _, x in made], np.int32),
                    "widths": np.array([x.shape[1] for _, x in made], np.int32),
                    "starts": np.cumsum([0] + [x.size for _, x in made[:-1]]).astype(np.int32)[: len(made)],
                    "numbers": np.concatenate([x.ravel() for _, x in made] or [np.zeros(0, np.float32)]),
                }
                for made in parts
            ]

        return predict

    # A prediction has flat arrays only; frames are cut out of them where rows of layers are made.
    flat = StructType()
    for column in ("layers", "counts", "widths", "starts"):
        flat = flat.add(column, ArrayType(IntegerType()))
    predicted = predict_batch_udf(make, return_type=flat.add("numbers", ArrayType(FloatType())), batch_size=8 * rows, input_tensor_shapes=[None, None])
    known = waves.withColumn("waveform", F.coalesce("waveform", F.array().cast("array<float>")))
    known = known.select("path", "village_key", "word", predicted("waveform", F.size("waveform")).alias("made"))

    def layer(k):
        start, width = F.col("made.starts")[k], F.col("made.widths")[k]
        frames = F.transform(F.sequence(F.lit(1), F.col("made.counts")[k]), lambda i: F.slice("made.numbers", start + (i - 1) * width + 1, width))
        none = F.array().cast("array<array<float>>")
        return F.struct(F.col("made.layers")[k].alias("layer"), F.when(F.col("made.counts")[k] > 0, frames).otherwise(none).alias("frames"))

    each = F.transform(F.sequence(F.lit(0), F.size("made.layers") - 1), layer)
    rows_of = known.filter(F.size("made.layers") > 0).select("path", "village_key", "word", F.explode(each).alias("made"))
    return rows_of.select(F.lit(model).alias("model"), "made.layer", F.col("village_key").alias("village"), "word", F.col("path").alias("recording"), "made.frames")
