"""Mixing sources to target weights (operator 10), with soft membership.

A classifier learned from a labelled table gives each document posteriors over domains. Projected gradient descent
then fits a rate of at least 0 (and at most a bound, if there is one) for each document, so that the expected tokens of
each domain, the sum of rate times tokens times posterior, match targets in the least-squares sense.

The step is implicit: rates are those at the start, 1, less the gradient at the rates arrived at times a length, projected
onto the bounds. However long, such a step doesn't overshoot, and a long one ends where descent does. The gradient is
a document's posteriors times one number for each domain, so what is to be found are these few numbers, `pull`. They are found
by Newton's method: their equations' residual and slope, and the merit of some lengths of a Newton step, are sums over
the documents, made where these are, in one pass for each step. A document's rate follows from its posteriors and the
pull alone. Descent has settled when targets are met, or when an ordinary projected gradient step from there moves
no rates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .arrow_text import bounded_batches, map_texts

#: Labelled rows that the classifier learns from, at most; words that it knows, at most; and the chi-square of a
#: word's rows with a domain's from which on it is known.
SAMPLE, WORDS, TELLING = 8000, 2048, 24.0
#: Passes over the documents, at most; the distance of each domain from its target, and the projected gradient (what an
#: ordinary step moves rates by, as the root of the mean square over tokens), at which descent has settled; the inverse of
#: the implicit step's length; and parts of a Newton step that a pass compares.
STEPS, TOLERANCE, OPTIMAL, NEAR, LENGTHS = 100, 1e-6, 1e-5, 1e-8, 2.0 ** np.arange(6, -26, -1)
_WORD = re.compile(rb"[^\x00-@\[-`{-\x7f]+")
_STYLE = 6


def word_ids(text: bytes) -> tuple[np.ndarray, int]:
    """Distinct words (letters, A-Z lower-cased) as 64-bit hashes, and the number of white-space separated words."""
    import xxhash

    words = {*_WORD.findall(text.lower())}
    return np.array([xxhash.xxh3_64_intdigest(w) >> 1 for w in words], np.int64), len(text.split())


def style(text: bytes, distinct: int, words: int) -> list[float]:
    """Shares of letters, capitals, digits and other signs, of distinct words, and the usual word length."""
    if not text:
        return [0.0] * _STYLE
    b = np.frombuffer(text, np.uint8)
    upper, digit = ((b >= 65) & (b <= 90)).mean(), ((b >= 48) & (b <= 57)).mean()
    lower, space = ((b >= 97) & (b <= 122) | (b >= 128)).mean(), (b <= 32).mean()
    return [float(v) for v in (lower, upper * 4, digit * 4, (1 - upper - digit - lower - space) * 4, distinct / max(1, words), min(4.0, len(text) / max(1, words) / 8))]


@dataclass(frozen=True)
class Classifier:
    """domains, sorted; words: sorted hashes of the known words; weights: a column for each domain, with rows for
    the words, the style and the bias."""

    domains: tuple[str, ...]
    words: np.ndarray
    weights: np.ndarray

    def posteriors(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[int]]:
        """Posteriors, a row for each text, and the texts' numbers of words."""
        out, tokens = np.zeros((len(texts), len(self.domains))), []
        for row, text in zip(out, texts, strict=True):
            ids, n = word_ids(text or b"")
            tokens.append(n)
            at = np.searchsorted(self.words, ids)
            at = at[(at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == ids)] if len(self.words) else at[:0]
            tail = np.array([*style(text or b"", len(ids), n), 1.0])
            z = self.weights[at].sum(0) + tail @ self.weights[len(self.words) :]
            p = np.exp(z - z.max())
            row[:] = p / p.sum()
        return out, tokens


def fit_classifier(ids: list[np.ndarray], styles: np.ndarray, domains: list[str], known: int = WORDS, steps: int = 1000, decay: float = 1e-4) -> Classifier:
    """Multinomial logistic regression on the words that tell a domain from the rest, and on style."""
    names = tuple(sorted(set(domains)))
    own = np.array([names.index(d) for d in domains])
    values, place = np.unique(np.concatenate(ids), return_inverse=True)
    where = np.repeat(own, [len(v) for v in ids])
    rows, n = np.bincount(place, minlength=len(values)).astype(float), float(len(ids))
    telling = np.zeros(len(values))
    for k in range(len(names)):
        in_k, size = np.bincount(place[where == k], minlength=len(values)), float((own == k).sum())
        under = rows * (n - rows) * size * (n - size)
        telling = np.maximum(telling, np.where(under > 0, n * (in_k * n - rows * size) ** 2 / np.maximum(under, 1), 0))
    best = np.lexsort((values, -telling))[:known]
    words = np.sort(values[best[(telling[best] >= TELLING) & (rows[best] >= 5)]])
    x = np.zeros((len(ids), len(words) + _STYLE + 1), np.float32)
    for row, mine in zip(x, ids, strict=True):
        at = np.searchsorted(words, mine)
        ok = at < len(words)
        ok[ok] = words[at[ok]] == mine[ok]
        row[at[ok]] = 1
    x[:, len(words) : -1], x[:, -1] = styles, 1
    y = np.eye(len(names), dtype=np.float32)[own]
    share = y.mean(0)
    w = np.zeros((x.shape[1], len(names)), np.float32)
    w[-1] = np.log(share)
    grad2 = np.full_like(w, 1e-8)
    for _ in range(steps):  # steps scaled by each weight's past gradients
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = x.T @ (p - y) / len(x) + decay * w
        grad2 += grad * grad
        w -= 0.3 * grad / np.sqrt(grad2)
    return Classifier(names, words, w.astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, domain, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """The classifier of about `sample` ids of docs with a label, chosen by a hash of the id. domain: the domain's
    name from the columns of labels, null for rows without one; the smallest where an id has several. Rows with a null
    id or text don't count, and of several texts of an id the smallest does. Word hashes of those rows come to the
    driver, in the order of their ids, so that equal tables give equal classifiers; without any row there is one
    domain, `all`."""
    bounded_batches(docs.sparkSession)
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), domain.alias("domain")).filter("id is not null and domain is not null")
    space = 1 << 40
    count = named.count()
    keep = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(space)) < F.lit(min(space, space * sample // max(1, count)))
    named = named.filter(keep).groupBy("id").agg(F.min("domain").alias("domain"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text, name in zip(frame["id"], frame["text"], frame["domain"], strict=True):
                data = text.encode()
                ids, n = word_ids(data)
                out.append((key, ids.tobytes(), style(data, len(ids), n), name))
            yield pd.DataFrame(out, columns=["id", "ids", "style", "domain"])

    chosen = rows.filter(keep & F.col("text").isNotNull()).join(F.broadcast(named), "id").groupBy("id", "domain").agg(F.min("text").alias("text"))
    got = chosen.mapInPandas(describe, "id long, ids binary, style array<double>, domain string").toPandas().sort_values("id")
    if not len(got):
        return Classifier(("all",), np.zeros(0, np.int64), np.zeros((_STYLE + 1, 1)))
    return fit_classifier([np.frombuffer(b, np.int64) for b in got["ids"]], np.stack(got["style"].tolist()), got["domain"].tolist())


@dataclass
class Mix:
    """The fitted mix. totals: tokens of each domain at rate 1; targets: those asked for; reached: those expected;
    pull: what a document's posteriors take from its rate; most: the largest rate; steps: passes over the documents;
    settled: whether targets are met or no rates come nearer, else the passes were used up."""

    domains: tuple[str, ...]
    totals: np.ndarray
    targets: np.ndarray
    reached: np.ndarray
    pull: np.ndarray
    most: float = np.inf
    steps: int = 0
    settled: bool = True

    def rates(self, posteriors: np.ndarray) -> np.ndarray:
        return np.clip(1.0 - posteriors @ self.pull, 0.0, self.most)


def _totals(p: np.ndarray, t: np.ndarray, most: float, pull: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each of some other pulls: its tokens of each domain, the gram matrix of documents between the bounds, and by
    how much its merit departs from that of its tangent at `pull`. All summands of the last are positive, so that
    nothing is lost between large numbers."""
    out, rate = [], np.clip(1.0 - p @ pull, 0.0, most)
    for other in others:
        u = 1.0 - p @ other
        free = (u > 0) & (u <= most)
        new = np.clip(u, 0.0, most)
        out += [(t * new) @ p, ((p[free] * t[free, None]).T @ p[free]).ravel(), [t @ ((new - rate) ** 2 / 2 + (new - rate) * (u - new))]]
    return np.concatenate(out)


def fit_mix(posteriors: DataFrame, domains: tuple[str, ...], targets: Callable[[dict[str, float]], dict[str, float]], steps: int = STEPS, most: float = np.inf) -> Mix:
    """Rates of at most `most` for posteriors(n_tokens, p), neither of them null. targets: tokens wanted of each domain,
    from its tokens at rate 1. Repeated rows count each; an empty table is settled at totals of 0.

    What is least is the sum over domains of (reached - target) squared by the domain's tokens. A pass is one sum over
    all documents; for each compared length as many numbers as domains (squared, twice) come to the driver.
    """
    k = len(domains)

    def sums(kernel, size: int) -> np.ndarray:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for frame in frames:
                if len(frame):
                    part = kernel(np.stack(frame["p"].tolist()), frame["n_tokens"].to_numpy(np.float64))
                    total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"place": np.arange(total.size), "value": total})

        found = posteriors.select("n_tokens", "p").mapInPandas(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(size)
        for r in found:
            out[r["place"]] = r["value"]
        return out

    one = k + k * k + 1
    both = sums(lambda p, t: np.concatenate([t @ p, _totals(p, t, most, np.zeros(k), np.zeros((1, k)))]), k + one)
    totals, at = both[:k], both[k:]
    wanted = targets(dict(zip(domains, totals.tolist(), strict=True)))
    goal = np.array([wanted[d] for d in domains])
    some = totals > 0
    scale = np.where(some, 1 / np.maximum(totals, 1e-12), 0.0)
    root = np.sqrt(scale)
    gram = at[k : k + k * k].reshape(k, k)
    top = max(float(np.linalg.eigvalsh(root[:, None] * gram * root).max()), 1e-12)
    mix = Mix(domains, totals, goal, at[:k], np.zeros(k), most, 1, not totals.any())
    far = np.where(goal > 0, 1 / np.maximum(goal, 1e-12), scale)
    # A domain without tokens pulls nothing.
    stiff = NEAR * np.where(some, totals, 1.0)
    while not mix.settled and mix.steps < steps:
        if (np.abs(mix.reached - goal) * far)[some].max() <= TOLERANCE:
            mix.settled = True
            break
        slope = np.diag(stiff) + at[k : k + k * k].reshape(k, k)
        rest = np.where(some, stiff * mix.pull + goal - mix.reached, 0.0)
        steps_by = np.concatenate([[0.0], LENGTHS])[:, None] * -np.linalg.solve(slope, rest)
        pulls = mix.pull + steps_by
        gradient = scale * (mix.reached - goal) / top

        def compared(p: np.ndarray, t: np.ndarray, pulls=pulls, gradient=gradient, mix=mix) -> np.ndarray:
            rate = mix.rates(p)
            moved = np.clip(rate - p @ gradient, 0.0, most) - rate
            return np.append(_totals(p, t, most, mix.pull, pulls), t @ (moved * moved))

        found = sums(compared, one * len(pulls) + 1)
        mix.steps += 1
        mix.settled = bool(np.sqrt(found[-1] / totals.sum()) <= OPTIMAL)
        merits = found[:-1].reshape(len(pulls), one)
        best = int((merits[:, -1] + steps_by @ rest + steps_by**2 @ stiff / 2).argmin())
        if mix.settled or not best:  # no part of the step has more merit
            break
        at, mix.pull, mix.reached = merits[best], pulls[best], merits[best][:k]
    return mix


def document_posteriors(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (white-space separated words) and p (posteriors in the classifier's order). A null text counts
    as empty, a null id stays null, repeated rows give repeated results, an empty table gives an empty result; other
    columns are not read."""

    def batch(ids: list, texts: list) -> dict[str, list]:
        p, tokens = classifier.posteriors(texts)
        return {"doc_id": ids, "n_tokens": tokens, "p": p.tolist()}

    return map_texts(docs, batch, "doc_id long, n_tokens long, p array<double>", id_col, text_col)


def mix_sources(docs: DataFrame, labels: DataFrame, domain, targets, id_col: str = "doc_id", text_col: str = "text", most: float = np.inf) -> tuple[DataFrame, Mix, Classifier]:
    """doc_id, n_tokens, domain (the likeliest), posterior (its), p, rate (`most` at most), target and reached (expected
    tokens of each domain, in the order of p), steps (passes of the descent) and settled (whether targets are met or no rates
    come nearer), the same in each row, for each row of docs; with the mix and the classifier.

    A null text counts as empty; without labelled rows there is one domain, `all`; repeated rows count each, a null
    id stays null, an empty table gives an empty result; other columns are not read.
    """
    classifier = train(docs, labels, domain, id_col, text_col)
    table = written(document_posteriors(docs, classifier, id_col, text_col), "posteriors")
    mix = fit_mix(table, classifier.domains, targets, most=most)

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(rate=mix.rates(np.stack(frame["p"].tolist())))

    rated = table.mapInPandas(rate, "doc_id long, n_tokens long, p array<double>, rate double")
    best = F.array_max("p")
    names = F.array(*[F.lit(d) for d in classifier.domains])
    out = rated.select("doc_id", "n_tokens", F.element_at(names, F.array_position("p", best).cast("int")).alias("domain"), best.alias("posterior"), "p", "rate", *(F.array(*[F.lit(float(v)) for v in values]).alias(c) for c, values in (("target", mix.targets), ("reached", mix.reached))), F.lit(mix.steps).alias("steps"), F.lit(mix.settled).alias("settled"))
    return out, mix, classifier


def label_domain():
    """The domain of a row of labels: toxic, or else its quality; null without both."""
    return F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("quality").isNotNull(), F.concat(F.lit("quality"), F.col("quality").cast("string")))


def weighted(weights: dict[str, float], other: float = 1.0) -> Callable[[dict[str, float]], dict[str, float]]:
    """Targets that are each domain's tokens times its weight."""
    return lambda totals: {d: n * weights.get(d, other) for d, n in totals.items()}
