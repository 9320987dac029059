"""N-gram Jaccard join (operator 4) by partitioning the universe of shingles.

Sets of similar size share a band. In a band, every shingle belongs to one of m segments, by its hash. Two sets that
link differ in H shingles at most, H following from their sizes. A set gives segment i an allowance v[i] of 0, 1 or
2, and these add up to H + 1 (for the largest H that a partner can have): for a linked set there is a segment in
which the two differ in fewer than v[i] shingles (pigeonhole). v = 1 finds it by the signature of the segment's
subset; v = 2 by that of the subset or of one with a shingle less on either side, its one-deletion neighbourhood. A
subset without shingles would meet every other such set, and one of shingles that many documents have (a passage, a
license) very many; so these get 0, and as many others among the first K segments get 2 instead; K is chosen for each
band by the cost of signatures and of chance candidates. So all index the subsets of all segments and the
neighbourhoods of the first K; a set without enough segments for 2 also asks for its empty subsets, or leaves
frequent ones at 1. Which shingles are frequent is counted over all documents, in each task first.

Texts with equal words are one class from the start. Sets that share a signature are candidates: members of a bucket
are first compared with one of them, then those that are still in different components in groups, inside tasks.
Before texts are moved, sketches are: a byte for each of about as many segments as there are shingles. The bytes in
which two sketches differ are fewer than the shingles in which the sets do, so too many of them rule a link out.
What is left is verified by the shingles themselves, not by hashes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written
from .arrow_text import frugal, map_texts, slices, texts_of
from .components import connected_components

#: Bytes whose words are held as objects at once.
CHUNK = 1 << 21
#: Ids up to this number (8 bytes each) are broadcast to choose texts; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Documents of a group that one task compares with each other, or with as many others: by sketches, by texts.
SKETCH_ROWS, GROUP_ROWS = 2048, 1024
#: What a chance candidate costs, in signatures.
CANDIDATE_COST = 50.0
#: A segment needs so many shingles to get the allowance 2.
LEAST_TWO = 3
#: Sets of one task's BUFFER of shingles that have a shingle, at least, for it to be counted over all; sets that have a
#: frequent shingle, at least; and frequent shingles (8 bytes each), the most frequent ones. They change costs only.
BUFFER, LOCAL_SETS, FREQUENT_SETS, FREQUENT = 1_000_000, 6, 100, 1 << 16
#: Rows of one signature that a task sends on, at most, from each SIGNED of its signatures; further ones are compared
#: with one of these.
LOCAL_ROWS, SIGNED = 8, 500_000
#: Shingles that sets of hashes may lack: where they come so near the threshold, the shingles are compared.
SLACK = 2
_GAP = re.compile(rb"[ \t-\r]")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: What a row of a bucket is: a subset that also asks for neighbourhoods (or an empty one that asks), a subset, a
#: member of a neighbourhood that asks for subsets, one that only answers, and an empty subset, which only answers,
#: too. It stands above the digest's 60 bits.
ASKS, SUBSET, NEAR, ANSWERS, EMPTY = range(5)
_DIGEST = np.uint64((1 << 60) - 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text (runs without white space, A-Z lower-cased) in lists, each from about CHUNK bytes."""
    at, text = 0, text or b""
    while at < len(text):
        gap = _GAP.search(text, at + CHUNK) if len(text) - at > CHUNK else None
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(_LOWER).split()  # without an argument, bytes are split at space and \t to \r
        at = end


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of a text's words."""
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) for words in words_of(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(h: np.ndarray, words: int) -> np.ndarray:
    """The distinct shingles of a sequence of words as sorted 64-bit hashes; fewer words than `words` are one."""
    n = min(words, len(h))
    if not n:
        return h
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s += h[i : len(h) - n + 1 + i] * (mix(np.array([i + 1], np.uint64)) | np.uint64(1))
    return np.unique(mix(s))


def exact_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted numbers. Equal shingles of these texts have equal numbers, and
    only they: words are compared as bytes, shingles as sequences of words."""
    known: dict[bytes, int] = {}
    rows = [np.array([known.setdefault(w, len(known) + 1) for part in words_of(t) for w in part], np.int64) for t in texts]
    sizes = np.array([max(len(r) - words + 1, min(1, len(r))) for r in rows], np.int64)
    number = np.zeros(int(sizes.sum()), np.int64)
    for i in range(words):  # numbers of sequences of 1, 2, ... words; 0 stands for no further word
        column = np.concatenate([r[i : i + n] if len(r) >= words else np.append(r, np.zeros(words, np.int64))[i : i + n] for r, n in zip(rows, sizes.tolist(), strict=True)] or [number])
        number = np.unique(number * (len(known) + 1) + column, return_inverse=True)[1]
    return [np.unique(part) for part in np.split(number, np.cumsum(sizes)[:-1])] if len(texts) else []


@dataclass(frozen=True)
class Threshold:
    """Sets link when whole * |A and B| >= part * |A or B|."""

    part: int
    whole: int

    def differences(self, sizes: int) -> int:
        """Shingles that two linked sets whose sizes add up to `sizes` differ in, at most."""
        return (self.whole - self.part) * sizes // (self.whole + self.part)

    def largest(self, size: int) -> int:
        """Of the sets that link with one of this size, the largest size."""
        return size * self.whole // self.part

    def smallest(self, size: int) -> int:
        return -(-size * self.part // self.whole)

    def bands(self, most: int) -> list[int]:
        """The smallest size of each band, up to one past `most`: a set's partners lie in its band and the ones
        beside it."""
        out = [1]
        while out[-1] <= most:
            out.append(self.largest(out[-1]) + 1)
        return [*out, self.largest(out[-1]) + 1]

    def link(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether sorted sets link."""
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        if not len(a) or self.whole * len(a) < self.part * len(b):
            return False
        at = np.searchsorted(b, a)
        both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return both > 0 and self.whole * both >= self.part * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> np.ndarray:
    """A byte for each of 2**k segments of the universe, the sum (xor) of hashes of the shingles there; 2**k is the
    size of the set or up to twice less."""
    m = 1 << max(0, len(s).bit_length() - 1)
    out = np.zeros(m, np.uint8)
    h = mix(s ^ np.uint64(0xA0761D6478BD642F))
    at = (h & np.uint64(m - 1)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, byte = at[order], (h >> np.uint64(56)).astype(np.uint8)[order]
    head = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
    if len(head):
        out[at[head]] = np.bitwise_xor.reduceat(byte, head)
    return out


def folded(x: np.ndarray, m: int) -> np.ndarray:
    """A sketch of 2**k segments as one of m, a smaller power of two."""
    while len(x) > m:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _beyond(mean: float, most: float) -> float:
    """The chance that a Poisson variable exceeds `most`."""
    term = total = math.exp(-mean)
    for i in range(1, int(most) + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def allocate(sets: int, threshold: Threshold, low: int, high: int) -> int:
    """K for a band of sizes low to high - 1 that `sets` sets take part in: the number of segments with
    neighbourhoods at which these signatures, and chance meetings of empty subsets of sets that don't have enough
    segments for the allowance 2, cost least."""
    m = threshold.differences(2 * (high - 1)) + 1
    most = min(m, threshold.differences(threshold.smallest(low) + low) + 1)
    best = (math.inf, 0)
    sizes = sorted({threshold.smallest(low), low, (low + high) // 2, high - 1})
    for k in sorted({0, *range(1, min(most, 33)), *(most * i // 32 for i in range(33))}):
        cost = 0.0
        for n in sizes:
            each = n / m
            empty, small = math.exp(-each), math.exp(-each) * sum(each**i / math.factorial(i) for i in range(LEAST_TWO))
            need = threshold.differences(n + min(threshold.largest(n), high - 1)) + 1
            cost += sets * k * each + CANDIDATE_COST * sets * sets * empty * _beyond(need * empty, k * (1 - small))
        best = min(best, (cost, k))
    return best[1]


@dataclass(frozen=True)
class Scheme:
    """bands: smallest sizes; near: for each band, how many segments have neighbourhoods (K); frequent: sorted hashes of
    shingles that many documents have."""

    threshold: Threshold
    bands: tuple[int, ...]
    near: tuple[int, ...]
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def rare(self, s: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.ones(len(s), bool)
        return self.frequent[np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)] != s

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a set, and what each is (ASKS, SUBSET, NEAR, ANSWERS or EMPTY)."""
        n, out, kinds = len(s), [], []
        all_rare = self.rare(s)
        own = int(np.searchsorted(self.bands, n, side="right")) - 1
        for band in (own, own + 1):
            if band + 1 >= len(self.bands) or self.threshold.largest(n) < self.bands[band]:
                continue
            high = self.bands[band + 1] - 1
            m, k = self.threshold.differences(2 * high) + 1, self.near[band]
            need = self.threshold.differences(n + min(self.threshold.largest(n), high)) + 1
            token = mix(s + np.uint64(band * 2 + 1))
            segment = (token % np.uint64(m)).astype(np.int64)
            token, rare = mix(token), all_rare
            if need < m:  # a pair's segments are the first that it needs, which both sets have
                used = segment < need
                token, segment, rare = token[used], segment[used], rare[used]
            count, rares = np.bincount(segment, minlength=need), np.bincount(segment[rare], minlength=need)
            order = np.argsort(segment, kind="stable")
            token, segment = token[order], segment[order]
            some = np.flatnonzero(count)
            total = np.zeros(need, np.uint64)
            if len(some):
                total[some] = np.add.reduceat(token, (np.cumsum(count) - count)[some])
            key = mix(np.arange(need, dtype=np.uint64) + np.uint64((band + 1) << 32))
            kind = np.where(count > 0, SUBSET, EMPTY)
            two = np.zeros(need, bool)
            # Segments to give nothing: empty ones, then those with frequent shingles only, fewest first.
            costly = np.flatnonzero(rares == 0)
            if len(costly):
                costly = costly[np.argsort(count[costly], kind="stable")]
                # A neighbour of a subset with two rare shingles has one, so it never meets those that get nothing.
                first = np.flatnonzero((count[:k] >= LEAST_TWO) & (rares[:k] >= 2))
                two[first[np.argsort(-rares[first], kind="stable")][: len(costly)]] = True
                kind[two] = ASKS
                met, left = costly[: int(two.sum())], costly[int(two.sum()) :]
                kind[met[count[met] > 0]] = NEAR  # it still answers those that ask
                kind[left[count[left] == 0]] = ASKS
            out.append(mix(total + key))
            kinds.append(kind)
            # A subset that asks has LEAST_TWO shingles at least, so that smaller neighbours never answer.
            near = (segment < k) & ((count > LEAST_TWO) | two)[segment]
            if near.any():
                at = segment[near]
                out.append(mix(total[at] - token[near] + key[at]))
                kinds.append(np.where(two[at], NEAR, ANSWERS))
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(out), np.concatenate(kinds)


DIGESTS = "doc_id long, n_shingles long, d1 long, d2 long"


def _text_digest(text: bytes | None, ident: int | None) -> tuple[int, int]:
    """128 bits that stand for the words of a text; those of a text without words are its id."""
    h = hashlib.blake2b(digest_size=16)
    some = False
    for words in words_of(text):
        if words:
            h.update(b" " * some + b" ".join(words))
            some = True
    return (int.from_bytes(h.digest()[:8], "little", signed=True), int.from_bytes(h.digest()[8:], "little", signed=True)) if some else (ident or 0, 0)


def _digest_rows(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the size of its set, and 128 bits that stand for its sequence of words; and for shingles that LOCAL_SETS
    different texts of a task have: the hash as doc_id, and less the number of texts as size."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_shingles", "d1", "d2")])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        sets: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            token = np.concatenate(sets or [np.zeros(0, np.uint64)])
            sets.clear()
            token.sort()
            head = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
            count = np.diff(np.append(head, len(token)))
            token, count = token[head[count >= LOCAL_SETS]].view(np.int64), count[count >= LOCAL_SETS]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (token, -count, 0 * count, 0 * count)], schema=schema)

        for batch in slices(batches):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s, key = shingle_set(word_hashes(text), words), _text_digest(text, i)
                rows.append((i, len(s), *key))
                if len(s) and key not in seen:
                    seen.add(key)
                    sets.append(s)
                    size += len(s)
                if size >= BUFFER:
                    yield counted()
                    size = 0
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, schema=schema)
        yield counted()

    return texts_of(docs, id_col, text_col).mapInArrow(run, DIGESTS)


def _short(d1: np.ndarray) -> np.ndarray:
    return d1.view(np.uint64) >> np.uint64(4)


def collapse(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sig, node and hub: of signatures with more than LOCAL_ROWS rows, the first (smallest) node stays (hub 0), the
    others get it as their hub. Empty subsets all stay."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(sig)))
    first = np.repeat(head, count)
    later = (np.repeat(count, count) > LOCAL_ROWS) & (np.arange(len(sig)) > first) & (node >> 60 < EMPTY)
    return sig, node, np.where(later, node[first], 0) if len(sig) else node


_SIGNED = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("hub", pa.int64())])


def _signature_rows(docs: DataFrame, scheme: Scheme, words: int, id_col: str, text_col: str) -> DataFrame:
    """sig, node (what the row is, and 60 bits of the text's digest) and hub. Texts of one class that a task has seen
    lately are signed once."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        sigs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        size = 0

        def made() -> pa.RecordBatch:
            sig, node = np.concatenate(sigs).view(np.int64), np.concatenate(nodes)
            sigs.clear()
            nodes.clear()
            sig, node, hub = collapse(sig, node)
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.array(hub)], schema=_SIGNED)

        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                key = _text_digest(text, None)
                if key in seen or key == (0, 0):
                    continue
                if len(seen) > 50_000:
                    seen.clear()
                seen.add(key)
                sig, kind = scheme.signatures(shingle_set(word_hashes(text), words))
                sigs.append(sig)
                nodes.append((kind << 60) | int(_short(np.array(key[:1], np.int64))[0]))
                size += len(sig)
                if size >= SIGNED:
                    yield made()
                    size = 0
        if sigs:
            yield made()

    return texts_of(docs.filter(F.col(f"`{id_col}`").isNotNull()), id_col, text_col).mapInArrow(run, "sig long, node long, hub long")


_MET = pa.schema([("sig", pa.int64()), ("hub", pa.int64()), ("node", pa.int64())])


def _met(signed: DataFrame) -> DataFrame:
    """sig, hub and node: for each signature that candidates share, every other member with one of them.

    Rows are sorted by signature, and in it those that can be a hub come first, so that only the last hub is held.
    Rows that have a hub already are dealt out evenly.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2), np.int64)
        for batch in batches:
            sig, node, hub = (c.to_numpy() for c in batch.columns)
            known = hub != 0
            out = [np.stack([sig[known], hub[known], node[known]])]
            rows = np.concatenate([held, np.stack([sig[~known], node[~known]], 1)])
            if len(rows):
                head = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
                first = np.repeat(head, np.diff(np.append(head, len(rows))))
                asked, kind = rows[first, 1] >> 60, rows[:, 1] >> 60
                keep = (rows[:, 1] != rows[first, 1]) & ((asked == ASKS) | (asked == SUBSET) & (kind <= NEAR))
                out.append(np.stack([rows[keep, 0], rows[first[keep], 1], rows[keep, 1]]))
                held = rows[head[-1] : head[-1] + 1]
            sig, hub, node = np.concatenate(out, 1)
            hub, node = hub & int(_DIGEST), node & int(_DIGEST)
            differ = hub != node
            yield pa.RecordBatch.from_arrays([pa.array(c[differ]) for c in (sig, hub, node)], schema=_MET)

    dealt = F.when(F.col("hub") == 0, F.col("sig")).otherwise(F.xxhash64("sig", "node"))
    return signed.repartition(dealt).sortWithinPartitions("sig", "node").mapInArrow(run, "sig long, hub long, node long")


def _maybe(pairs: DataFrame, texts: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs (a, b) that sketches don't rule out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (c.to_pylist() for c in batch.columns)
            keep = []
            for n, m, x, y in zip(na, nb, sa, sb, strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                keep.append(max(n, m) <= threshold.largest(min(n, m)) and int((folded(x, size) != folded(y, size)).sum()) <= threshold.differences(n + m))
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (a, b)], schema=schema)

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa")), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb")), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: Threshold, words: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            sets = dict(zip(here := list({*ta, *tb}), exact_sets(here, words), strict=True))
            keep = [threshold.link(sets[x], sets[y]) for x, y in zip(ta, tb, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (a, b)], schema=schema)

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _labelled(rows: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """rows with the component of the node in `column`, the node itself where it has no link."""
    labels = nodes.select(F.col("node").alias(column), F.col("component").alias(f"{column}_component"))
    return rows.join(labels, column, "left").withColumn(f"{column}_component", F.coalesce(f"{column}_component", column))


def _texts(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """node, n_shingles, sketch and text of the classes in wanted(node, rep, n_shingles, d1, d2), from a document that
    has the id and the words."""
    few = wanted.count() <= BROADCAST_IDS
    ids = wanted.select(F.col("rep").alias("id")).distinct()
    source = texts_of(docs, id_col, text_col).join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def batch(ids: list, texts: list) -> dict[str, list]:
        two = [_text_digest(t, i) for t, i in zip(texts, ids, strict=True)]
        return {"d1": [d[0] for d in two], "d2": [d[1] for d in two], "sketch": [sketch(shingle_set(word_hashes(t), words)).tobytes() for t in texts], "text": texts}

    digested = map_texts(source, batch, "d1 long, d2 long, sketch binary, text binary", "id", "text")
    some = digested.join(F.broadcast(wanted) if few else wanted, ["d1", "d2"])
    return some.groupBy("node", "n_shingles").agg(F.first("sketch").alias("sketch"), F.first("text").alias("text"))


def similar_documents(docs: DataFrame, words: int = 5, threshold: Threshold = Threshold(80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach), one row per row of docs.

    A document's set: the distinct `words`-word shingles of its whole text, A-Z lower-cased; with fewer words, the
    whole sequence as one; without words or text it is empty and links with nothing. Linked are texts with equal
    words (by a 128-bit digest) and candidates whose shingles, compared as such, reach the threshold. Rows with one
    doc_id are one node, whatever their texts; rows with a null id have a null component. Repeated rows are kept, an
    empty table gives an empty result; other columns are not read. Sizes of sets are counted over all documents, for
    the bands; only those counts and the most frequent shingles' hashes come to the driver.
    """
    both = written(_digest_rows(docs, words, id_col, text_col), "digests")
    digests = both.filter("n_shingles >= 0")
    tokens = both.filter("n_shingles < 0").groupBy("doc_id").agg((-F.sum("n_shingles")).alias("n")).filter(F.col("n") >= FREQUENT_SETS)
    frequent = tokens.orderBy(F.desc("n"), "doc_id").limit(FREQUENT).select("doc_id").toPandas()["doc_id"].to_numpy(np.int64)
    known = digests.filter(F.col("doc_id").isNotNull())
    # Classes get numbers when they are written, so that these stay as they are.
    named = known.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = written(named.withColumn("node", F.monotonically_increasing_id()).withColumn("short", F.shiftrightunsigned("d1", 4)), "classes")
    # Classes that one id brings together.
    several = known.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y")).filter("x <> y").select("doc_id")
    shared = known.join(several, "doc_id", "left_semi").distinct().join(classes.select("n_shingles", "d1", "d2", "node"), ["n_shingles", "d1", "d2"]).select("doc_id", "node")
    joined = shared.join(shared.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("a <> node").select("a", F.col("node").alias("b"))

    sets = classes.filter("n_shingles > 0")
    bands = threshold.bands(sets.agg(F.max("n_shingles")).first()[0] or 1)
    of_band = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bands]), lambda b: b <= F.col("n_shingles"))) - 1
    counts = {r["band"]: r["count"] for r in sets.groupBy(of_band.alias("band")).count().collect()}
    near = [allocate(max(1, counts.get(k, 0) + counts.get(k - 1, 0)), threshold, low, high) for k, (low, high) in enumerate(zip(bands, bands[1:], strict=False))]
    scheme = Scheme(threshold, tuple(bands), tuple(near), np.sort(frequent.view(np.uint64)))
    met = written(_met(_signature_rows(docs, scheme, words, id_col, text_col)), "met")

    # From here on classes go by their numbers; the short digests of two may be equal, and then both are meant.
    short = classes.filter("n_shingles > 0").select("short", "node")
    pairs = met.select("hub", "node").distinct().withColumnRenamed("node", "other")
    ends = pairs.join(short.select(F.col("short").alias("hub"), F.col("node").alias("x")), "hub").join(short.select(F.col("short").alias("other"), F.col("node").alias("y")), "other")
    stars = written(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "stars")
    ids = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    wanted = written(classes.join(ids, "node", "left_semi").select("node", "rep", "n_shingles", "d1", "d2"), "wanted")
    texts = written(_texts(docs, wanted, words, id_col, text_col), "texts")
    stars, before = written(_maybe(stars, texts, threshold), "stars"), stars
    discard(before)

    first = written(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = [written(_verified(first, texts, threshold, words).unionByName(joined), "links")]
    nodes = connected_components(links[0])
    # Then each bucket's members with its hub, where they aren't connected yet.
    apart = _labelled(_labelled(stars, nodes, "a"), nodes, "b").filter("a_component <> b_component").select("a", "b")
    for step in (lambda _: written(_verified(apart.join(first, ["a", "b"], "left_anti"), texts, threshold, words), "links"), lambda now: _linked_in_groups(met, short, now, texts, threshold, words)):
        links.append(step(nodes))
        if not links[-1].isEmpty():
            before, nodes = nodes, connected_components(reduce(DataFrame.unionByName, links))
            discard(before)
    # A component is named by its smallest document.
    names = _labelled(classes.select("node", "rep", "n_shingles", "d1", "d2"), nodes, "node")
    smallest = names.groupBy("node_component").agg(F.min("rep").alias("least"))
    labels = written(names.join(smallest, "node_component").select("n_shingles", "d1", "d2", "least"), "labels")
    for table in (met, stars, wanted, texts, first, nodes, classes, *links):
        if hasattr(table, "written_path"):
            discard(table)
    out = digests.join(labels, ["n_shingles", "d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"))


def _dealt(units: DataFrame, rows: int) -> DataFrame:
    """unit, node, block, i and j: the members of units(unit, node), dealt into blocks of about `rows`, once for each
    pair (i, j) of blocks (equal ones where there is one) that has theirs."""
    blocks = units.groupBy("unit").agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = units.join(blocks, "unit").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", other)
    return dealt.select("unit", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _linked_in_groups(met: DataFrame, short: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: Threshold, words: int) -> DataFrame:
    """Links (a, b) that join the components which share a bucket: enough of them, not all.

    Documents that buckets with several components connect are a group, if they are SKETCH_ROWS at most; else each of
    the buckets is one (buckets with equal members once), so that only documents of a bucket meet. Tasks compare
    sketches, block by block, and give enough of the pairs that may link to connect them all. What these connect are
    groups of texts, which tasks compare by their shingles' postings; they give a link only where its ends aren't
    joined yet. So pairs are never written out.
    """
    members = met.select("sig", "hub").unionByName(met.select("sig", F.col("node").alias("hub"))).distinct()
    named = members.join(short, F.col("hub") == F.col("short")).select("sig", "node")
    held = written(_labelled(named, nodes, "node").withColumnRenamed("node_component", "component"), "members")
    # Of two members, one is the other's hub, and they have been compared.
    mixed = held.groupBy("sig").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("own")).filter("x <> y and n > 2")
    once = mixed.groupBy("n", "x", "y", "own").agg(F.min("sig").alias("sig")).select("sig")
    rows = written(held.join(once, "sig"), "mixed")
    if rows.isEmpty():
        discard(held)
        return rows.select(F.col("node").alias("a"), F.col("node").alias("b"))
    groups = connected_components(rows.join(rows.groupBy("sig").agg(F.min("node").alias("b")), "sig").select(F.col("node").alias("a"), "b"))
    of_bucket = rows.select("sig", "node").join(groups.withColumnRenamed("component", "group"), "node")
    sizes = groups.groupBy(F.col("component").alias("group")).agg(F.count("*").alias("size"))
    whole = F.col("size") <= SKETCH_ROWS
    units = of_bucket.join(sizes, "group").select(F.struct(whole.alias("whole"), F.when(whole, F.col("group")).otherwise(F.col("sig")).alias("name")).alias("unit"), "node").distinct()
    inside = rows.groupBy("node").agg(F.min("component").alias("inside"))
    sketches = _dealt(units, SKETCH_ROWS).join(inside, "node").join(texts.select("node", "n_shingles", "sketch"), "node")

    order = ["unit", "i", "j", "n_shingles", "node"]
    sorted_rows = sketches.repartition("unit", "i", "j").sortWithinPartitions(*order)
    columns = [F.col("unit.whole").cast("long").alias("whole"), F.col("unit.name").alias("name"), *(F.col(c).cast("long") for c in ("i", "j", "node", "n_shingles", "inside", "block")), "sketch"]
    close = connected_components(sorted_rows.select(*columns).mapInArrow(_near_rows(threshold), "a long, b long"))
    units = close.select(F.col("component").alias("unit"), "node")
    held_texts = _dealt(units, GROUP_ROWS).join(inside, "node").join(texts.select("node", "text"), "node")

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("node").reset_index(drop=True)
        texts, node = frame["text"].tolist(), frame["node"].to_numpy()
        found = links_of([shingle_set(word_hashes(t), words) for t in texts], frame["inside"].tolist(), frame["block"].to_numpy(), threshold, lambda i, j: threshold.link(*exact_sets([texts[i], texts[j]], words)))
        return pd.DataFrame({"a": node[[a for a, _ in found]], "b": node[[b for _, b in found]]}, dtype="int64")

    links = written(held_texts.groupBy("unit", "i", "j").applyInPandas(run, "a long, b long"), "links")
    for table in (held, rows, groups, close):
        discard(table)
    return links


def _near_rows(threshold: Threshold) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """near_of each group (unit, i, j) of sorted rows; only the last group of a batch is held for the next. A partition
    may be without rows, and then has no group."""

    def pairs(table: np.ndarray, sketches: list[bytes]) -> list[tuple[int, int]]:
        found = near_of([np.frombuffer(x, np.uint8) for x in sketches], table[:, 5], table[:, 6], table[:, 7], threshold)
        return [(int(table[a, 4]), int(table[b, 4])) for a, b in found]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sketches = np.zeros((0, 8), np.int64), []
        for batch in chain(batches, [None]):
            if batch is not None:
                table = np.vstack([table, np.column_stack([batch.column(i).to_numpy() for i in range(8)])])
                sketches += batch.column(8).to_pylist()
            edge = np.flatnonzero((table[1:, :4] != table[:-1, :4]).any(1)) + 1
            edges = [0, *edge.tolist(), *([len(table)] if batch is None and len(table) else [])]
            found = [p for x, y in zip(edges, edges[1:], strict=False) for p in pairs(table[x:y], sketches[x:y])]
            table, sketches = table[edges[-1] :], sketches[edges[-1] :]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


class _Joined:
    """Which of some things pairs have joined."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they weren't joined."""
        i, j = self.root(i), self.root(j)
        self.parent[i] = j
        return i != j


def near_of(sketches: list[np.ndarray], size: np.ndarray, inside: np.ndarray, block: np.ndarray, threshold: Threshold) -> list[tuple[int, int]]:
    """Pairs (a < b) in different blocks (of the same one if there is one only) and different `inside` that sketches,
    in ascending order of size, don't rule out: enough to connect all that do."""
    joined, one, out = _Joined(len(sketches)), len(set(block.tolist())) == 1, []
    if len(np.unique(inside)) < 2:
        return []
    width = np.array([len(x) for x in sketches])
    for m in np.unique(width).tolist():
        # Sizes ascend, and partners' widths are equal or one is twice the other.
        left = np.flatnonzero(width == m)
        right = np.flatnonzero((width == m) | (width == 2 * m))
        wide = np.stack([folded(sketches[k], m) for k in right.tolist()])
        for at in range(0, len(left), step := max(1, (1 << 22) // (len(right) * m))):
            rows = left[at : at + step]
            first, last = np.searchsorted(right, rows[0]), len(right)
            far = (wide[rows - left[0], None] != wide[None, first:last]).sum(2)
            other = right[first:last]
            total = size[rows][:, None] + size[other][None]
            hit = (far <= (threshold.whole - threshold.part) * total // (threshold.whole + threshold.part)) & (rows[:, None] < other[None])
            hit &= (size[other][None] <= size[rows][:, None] * threshold.whole // threshold.part) & (inside[rows][:, None] != inside[other][None])
            if not one:
                hit &= block[rows][:, None] != block[other][None]
            out += [(a, b) for a, b in zip(rows[np.nonzero(hit)[0]].tolist(), other[np.nonzero(hit)[1]].tolist(), strict=True) if joined.join(a, b)]
    return out


def links_of(sets: list[np.ndarray], inside: list[int], block: np.ndarray, threshold: Threshold, confirm: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Linked pairs (a < b) of sets in different blocks (of the same one if there is one only) whose ends neither
    `inside` nor an earlier pair has joined; sets are of hashes, and confirm(a, b) compares the shingles."""
    n, size = len(sets), np.array([len(s) for s in sets])
    joined, first = _Joined(n), {}
    for i, c in enumerate(inside):
        joined.join(i, first.setdefault(c, i))
    if n < 2:
        return []
    owner = np.repeat(np.arange(n), size)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    posted = owner[order]
    count = np.bincount(token)
    start = np.cumsum(count) - count
    split, one, out = np.cumsum(size)[:-1], len(set(block.tolist())) == 1, []
    for i, own in enumerate(np.split(token, split)):
        own = own[count[own] > 1]
        if not len(own):
            continue
        c = count[own]
        at = np.repeat(start[own] - np.cumsum(c) + c, c) + np.arange(c.sum())
        both = np.bincount(posted[at], minlength=n)[:i]
        hit = (both > 0) & (threshold.whole * (both + SLACK) >= threshold.part * (size[:i] + size[i] - both - SLACK))
        if not one:
            hit &= block[:i] != block[i]
        for j in np.flatnonzero(hit).tolist():
            if joined.root(i) != joined.root(j) and confirm(j, i):
                joined.join(i, j)
                out.append((j, i))
    return out
