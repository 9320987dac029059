"""Language identification (operator 6): the language family first, then, within the family, one linear support
vector machine for each pair of languages.

A text's features are hashed counts of byte n-grams (1 to 3 bytes) of the lower-cased text in which everything but
letters is a space; counts are square-rooted and the vector has length one. Machines have a squared hinge loss and
are fitted by accelerated gradient descent on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import bounded_batches, map_texts, slices

#: Families of ISO 639-1 codes. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indo-aryan": "hi bn ur pa gu mr ne si",
    "semitic": "ar he am mt",
    "malayo-polynesian": "id ms jv tl mg",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Hashed features.
WIDTH = 4096
#: Labelled rows that the machines learn from, about: for each language, and of all together (8 KB each); where there
#: are so many languages that this is less, each has as many.
PER_LANGUAGE, SAMPLE = 500, 20_000
UNKNOWN = "und"
#: Of the likeness that all but the least like RARE of a language's labelled rows have, the share that a text needs to
#: count as being in it; and labelled rows of about one size that such a likeness is taken from, at least.
NEEDED, RARE, SIZE_ROWS = 0.8, 0.01, 10
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of float32 per text; zeros without any letter."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        b = np.frombuffer(b" ".join((b" " + text.decode().lower().encode().translate(_TABLE) + b" ").split(b"  ")), np.uint8).astype(np.uint32)
        one = b * _MIX[0]
        two = one[:-1] ^ (b[1:] * _MIX[1])
        three = two[:-1] ^ (b[2:] * _MIX[2])
        row[:] = np.bincount(np.concatenate([((x * np.uint32(0x2C1B3C6D)) >> np.uint32(20)) for x in (one[b != 32], two, three)]), minlength=WIDTH)
    np.sqrt(out, out)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return any(map(str.isalpha, text.decode()))


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 60) -> np.ndarray:
    """Weights and bias of min |w|^2 / 2 + c * mean(max(0, 1 - y f)^2), classes weighing the same."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    w, v, rate = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), np.float32(1 / (1 + 4 * c))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = v - np.float32(2 * c) * ((weight * y * slack) @ x)
        new = v - rate * grad
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


@dataclass(frozen=True)
class Model:
    """languages, sorted; families, sorted; gates: a column of weights for each family against the rest (empty with
    one family); pairs: (i, j) of languages of one family, machines: a column for each, positive for i.

    centres: a row of length one for each language; sizes, floors: the cosine with the nearest centre that a text with
    2 ** size distinct features needs to be in a learned language at all."""

    languages: tuple[str, ...]
    families: tuple[str, ...]
    gates: np.ndarray
    pairs: tuple[tuple[int, int], ...]
    machines: np.ndarray
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, WIDTH), np.float32))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    floors: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def like(self, x: np.ndarray) -> np.ndarray:
        """Whether feature rows are like those of a learned language. Below the smallest calibrated size, what is
        needed falls with the root of the size, as cosines with a centre do."""
        if not len(self.sizes):
            return np.ones(len(x), bool)
        size = np.log2(np.maximum(1, (x > 0).sum(1)))
        needed = np.interp(size, self.sizes, self.floors) * 2 ** (np.minimum(0, size - self.sizes[0]) / 2)
        return (x @ self.centres.T).max(1) >= needed

    def predict(self, texts: list[bytes | None], reject: bool = False) -> tuple[list[str], list[float]]:
        """Languages and scores. reject: a text that is not like any learned language gets `und`, too."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        x = features(texts)
        like = self.like(x) if reject else np.ones(len(x), bool)
        x = np.column_stack([x, np.ones(len(x), x.dtype)])
        family = np.array([self.families.index(FAMILY.get(l, l)) for l in self.languages])
        margin = x @ self.gates if self.gates.size else np.ones((len(x), 1))
        best = margin.argmax(1)
        second = np.partition(margin, -2, axis=1)[:, -2] if margin.shape[1] > 1 else -np.ones(len(x))
        gate = 1 / (1 + np.exp(-2 * (margin.max(1) - second)))
        votes, sure = np.zeros((len(x), len(self.languages))), np.ones((len(x), len(self.languages)))
        duel = x @ self.machines if self.pairs else None
        for k, (i, j) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-2 * duel[:, k]))
            votes[:, i] += p > 0.5
            votes[:, j] += p <= 0.5
            sure[:, i] = np.minimum(sure[:, i], p)
            sure[:, j] = np.minimum(sure[:, j], 1 - p)
        rank = np.where(family[None, :] == best[:, None], votes + sure, -1.0)
        pick = rank.argmax(1)
        score = gate * sure[np.arange(len(x)), pick]
        known = [bool(l) and has_letter(t) for t, l in zip(texts, like, strict=True)]
        return [self.languages[p] if k else UNKNOWN for p, k in zip(pick, known, strict=True)], [float(s) if k else 0.0 for s, k in zip(score, known, strict=True)]


def fit(x: np.ndarray, languages: list[str]) -> Model:
    """The model of feature rows and their languages."""
    names = tuple(sorted(set(languages)))
    families = tuple(sorted({FAMILY.get(l, l) for l in names}))
    at = np.array([names.index(l) for l in languages])
    group = np.array([families.index(FAMILY.get(l, l)) for l in languages])
    gates = np.column_stack([fit_machine(x, np.where(group == g, 1.0, -1.0)) for g in range(len(families))]) if len(families) > 1 else np.zeros((0, 0))
    pairs = tuple((i, j) for i in range(len(names)) for j in range(i) if FAMILY.get(names[i], names[i]) == FAMILY.get(names[j], names[j]))
    machines = [fit_machine(x[(at == i) | (at == j)], np.where(at[(at == i) | (at == j)] == i, 1.0, -1.0)) for i, j in pairs]
    machines = np.column_stack(machines).astype(np.float32) if machines else np.zeros((0, 0), np.float32)
    return Model(names, families, gates.astype(np.float32), pairs, machines, *calibrate(x, at, len(names)))


def calibrate(x: np.ndarray, at: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, sizes and floors of a Model from feature rows and the numbers of their languages. A row is compared
    with the centre of the others of its language; rows of sizes within a factor of two give one floor. Without
    enough rows of any size there are no floors, and every text is like a learned language."""
    sums = np.stack([x[at == k].sum(0) for k in range(languages)]).astype(np.float64)
    own, norm2 = (x @ sums.T.astype(np.float32))[np.arange(len(x)), at], np.einsum("ij,ij->i", x, x)
    rest = np.sqrt(np.maximum(0, (sums * sums).sum(1)[at] - 2 * own + norm2))
    size, cosine = np.log2(np.maximum(1, (x > 0).sum(1))), (own - norm2) / np.maximum(rest, 1e-9)
    counted = (norm2 > 0) & (np.bincount(at, minlength=languages)[at] > 1)
    bins = [counted & (np.floor(size) == k) for k in range(WIDTH.bit_length())]
    bins = [b for b in bins if b.sum() >= SIZE_ROWS]
    centres = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-9)
    return centres.astype(np.float32), np.array([np.median(size[b]) for b in bins]), np.array([NEEDED * np.quantile(cosine[b], RARE) for b in bins])


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """The model of about `per_language` rows of each language (SAMPLE of all), chosen by a hash of the id, among rows
    with an id, a language and a text that are not held out. Only their feature vectors (8 KB each) come to the
    driver, repeated rows once, and in the order of their ids, so that equal tables give equal models. Every language
    of these rows can be predicted; an empty table gives a model without languages."""
    bounded_batches(docs.sparkSession)
    i, t, l = (F.col(f"`{c}`") for c in (id_col, text_col, lang_col))
    rows = docs.filter(i.isNotNull() & l.isNotNull() & t.isNotNull() & ~held_out(id_col)).select(i.cast("long").alias("id"), t.cast("string").alias("text"), l.cast("string").alias("lang"))
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return Model((), (), np.zeros((0, 0)), (), np.zeros((0, 0)))
    space = 1 << 40
    each = max(1, min(per_language, SAMPLE // len(counts)))
    # Some more than are wanted by a hash's threshold, so that a language of few rows has one, then those that come first.
    spare = each + 4 * math.isqrt(each) + 16
    limit = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(space, space * spare // r["count"])))])
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(space))
    first = Window.partitionBy("lang").orderBy("place", "id", "text")
    chosen = rows.withColumn("place", place).filter(F.col("place") < limit[F.col("lang")]).distinct()
    chosen = chosen.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= each)

    def vectors(batches):
        for batch in slices(batches, 200):
            x = features(batch.column(1).cast(pa.binary()).to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), batch.column(2)], ["id", "x", "lang"])

    # A repeated row is one example, and sums run in the order of the rows, however they come in.
    got = sorted(tuple(r) for r in chosen.select("id", "text", "lang").mapInArrow(vectors, "id long, x binary, lang string").collect())
    if not got:
        return Model((), (), np.zeros((0, 0)), (), np.zeros((0, 0)))
    return fit(np.stack([np.frombuffer(x, np.float16) for _, x, _ in got]).astype(np.float32), [lang for _, _, lang in got])


SCHEMA = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred (a learned language, `und` for a text that is null or has no letter, or if nothing was
    learned) and score (0 to 1, 0 for `und`), from the whole text alone.

    Equal texts get equal results; repeated rows give repeated results, a null id stays null, an empty table gives
    an empty result; other columns are not read.
    """

    def batch(ids: list, texts: list) -> dict[str, list]:
        names, scores = model.predict(texts)
        return {"doc_id": ids, "lang_pred": names, "score": scores}

    return map_texts(docs, batch, SCHEMA, id_col, text_col)
