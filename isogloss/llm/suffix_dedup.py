"""Suffix-array dedup (operator 7): repeated strings by distributed prefix doubling over candidate positions.

Prefix doubling ranks each position by its first h bytes, pairs its rank with that of the position h further, and
sorts the pairs for ranks of 2h bytes; a position whose rank is unique leaves, and past the threshold the rest are
repeats. Most positions of a corpus are unique, so candidates are found first: every window of `length` bytes has one
anchor, the smallest fingerprint of `gram` bytes in it (the leftmost of equal ones), which depends on the window's
bytes alone. Windows that follow each other share anchors; equal windows have equal anchors.

1. Anchors are sorted by (rank of the gram, digest of the bytes of all windows that share the anchor). Equal ones are
   repeats of the first. A gram with one such context only is unique there, and its windows leave.
2. The windows of the other contexts are open. Positions in them are ranked by `start` bytes; pairs of ranks at
   offsets `start`, 2 * `start`, ... are sorted, unique ones leave, and the others are reranked and paired again,
   until ranks are of `length` bytes.

A rank of h bytes is a name of 64 bits (32 for the first ones) made of the two names that it joins, so that each
position can be renamed where its text is; sorting decides which names are unique. Names only decide what stays open:
two different strings that a name confuses go on together. What is removed has been compared by a digest of 128 bits of
its bytes as well, in both steps.

Rows with a key that a task has already seen aren't sorted: of each task's rows, one stands for all with its key, so that
a key that a third of all positions has doesn't fill one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written
from .arrow_text import bounded_batches, slices
from .jaccard_join import mix

#: Bytes of text whose windows are anchored together (their places must fit in PLACE bits of a sort key).
PLACE = 20
SEGMENT = 1 << PLACE
#: Texts and stretches of theirs that are broadcast to meet the texts, at most (about 40 bytes each); more are joined
#: by shuffle.
BROADCAST_ROWS = 2_000_000
#: Bytes of a gram that anchors are chosen by, and of the first ranks.
GRAM, START = 64, 25
#: A null id counts as the largest: as this one, with offsets above those of any text.
LAST_ID, LAST = (1 << 63) - 1, 1 << 40


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, tag (tells rows with one id and different texts apart; negative for a null id), text as UTF-8."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ident = F.col(f"`{id_col}`").cast("long")
    half = F.shiftrightunsigned(F.xxhash64(text), 1)
    return docs.select(F.coalesce(ident, F.lit(LAST_ID)).alias("doc"), F.when(ident.isNull(), -1 - half).otherwise(half).alias("tag"), text.cast("binary").alias("text"))


def _shift(tags: np.ndarray) -> np.ndarray:
    """What offsets of a text with this tag are raised by."""
    return np.where(tags < 0, LAST, 0)


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, made once and grown where needed."""

    size = 0

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.size < n:
            cls.size = max(n, SEGMENT + 4096)
            cls.up, cls.down = _powers(_BASE, cls.size), _powers(pow(_BASE, -1, 1 << 64), cls.size)
        return cls.up, cls.down


class Fingerprints:
    """Fingerprints of any stretch of some bytes, from sums of their powers."""

    def __init__(self, data: bytes) -> None:
        b = np.frombuffer(data, np.uint8)
        up, self.down = _Powers.get(len(b) + 1)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of 128 bits of stretches of data, in two halves."""
    made = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    halves = np.frombuffer(made, np.uint64).reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def anchors(data: bytes, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts that follow each other in data (up to SEGMENT bytes) and end at `ends`: rank of the gram, the context's
    digest in two halves, first and last window start, for each anchor in order."""
    windows = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return *[none.astype(np.uint64)] * 3, none, none
    prints = Fingerprints(data)
    grams = np.arange(len(data) - gram + 1)
    rank = prints.of(grams, grams + gram)
    low = (rank >> np.uint64(PLACE) << np.uint64(PLACE)) | grams.astype(np.uint64)
    wide, width = low, 1
    span = length - gram + 1
    while width * 2 <= span:  # least key of 1, 2, 4, ... grams, then of all grams of a window
        wide = np.minimum(wide[:-width], wide[width:])
        width *= 2
    least = np.minimum(wide[:windows], wide[span - width : span - width + windows])
    place = (least & np.uint64(SEGMENT - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:windows]
    inside = np.arange(windows) + length <= ends[np.minimum(text, len(ends) - 1)]
    new = np.ones(windows, bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    final = np.append(new[1:] | ~inside[1:], True)
    last = np.flatnonzero(final & inside)
    at = place[first]
    context, check = digests(data, first, last + length)
    return rank[at], mix(context + (at - first).astype(np.uint64)), check, first, last


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[int], list[int], np.ndarray]]:
    """Bytes to anchor together, with the texts' numbers, the offset in its text of each part, and the parts' ends.
    A text that is too long is cut into parts that share length - 1 bytes, so that each window lies in one."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def made() -> tuple[bytes, list[int], list[int], np.ndarray]:
        return b"".join(p for _, _, p in parts), [k for k, _, _ in parts], [o for _, o, _ in parts], np.cumsum([len(p) for _, _, p in parts])

    step = SEGMENT - length
    for k, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, step):
            part = text[at : at + step + length - 1]
            if size + len(part) > SEGMENT and parts:
                yield made()
                parts, size = [], 0
            parts.append((k, at, part))
            size += len(part)
    if parts:
        yield made()


#: A stretch is one number, its first place with how much further its last one is in the low bits.
FAR = PLACE + 1
#: kind 0: an anchor; kind 1: a stretch of repeated windows already known from the same batch; kind 2: an open one, whose
#: gram has other contexts in the batch; kind 4: an anchor that stands for these.
_ANCHORS = pa.schema([("kind", pa.int8()), *((c, pa.int64()) for c in ("gram", "context", "doc", "tag", "at", "check"))])
_STRETCHES = pa.schema([("kind", pa.int8()), *((c, pa.int64()) for c in ("doc", "tag", "at"))])
_COMPANY = pa.schema([("kind", pa.int8()), *((c, pa.int64()) for c in ("r1", "doc", "tag", "at"))])
_PAIRS = pa.schema([("kind", pa.int8()), *((c, pa.int64()) for c in ("r1", "r2", "doc", "tag", "at", "check"))])


def _ddl(schema: pa.Schema) -> str:
    names = {"int8": "byte", "int64": "long"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def _batch(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(f.type.to_pandas_dtype())) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Seen:
    """Rows that a task has met, as many as there are slots: of a key that comes again and again one is there."""

    def __init__(self, bits: int = 17) -> None:
        self.shift = np.uint64(64 - bits)
        self.key = [np.zeros(1 << bits, np.uint64) for _ in range(3)]
        self.doc, self.lo = np.full(1 << bits, LAST_ID), np.full(1 << bits, np.iinfo(np.int64).max)

    def slot(self, keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Each key's slot, and whether it holds this key."""
        at = (mix(keys[0] ^ mix(keys[1] ^ mix(keys[2]))) >> self.shift).astype(np.int64)
        return at, np.logical_and.reduce([own[at] == k for own, k in zip(self.key, keys, strict=True)])

    def put(self, at: np.ndarray, keys: tuple[np.ndarray, ...], doc: np.ndarray, lo: np.ndarray) -> None:
        for own, k in zip((*self.key, self.doc, self.lo), (*keys, doc, lo), strict=True):
            own[at] = k

    def earlier(self, keys: tuple[np.ndarray, ...], doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Whether a row with the same key that starts earlier has been met; these rows are met now."""
        at, known = self.slot(keys)
        later = (doc > self.doc[at]) | ((doc == self.doc[at]) & (lo > self.lo[at]))
        new = np.flatnonzero(~(known & later))
        self.put(at[new], tuple(k[new] for k in keys), doc[new], lo[new])
        return known & later


def _repeats(keys: tuple[np.ndarray, ...], doc: np.ndarray, lo: np.ndarray, seen: Seen) -> np.ndarray:
    """Whether a row with the same key starts earlier, among these and those that the task has seen."""
    # Most keys are alone: only the others are sorted by all that counts.
    joint = mix(keys[0]) ^ mix(keys[1] + keys[2])
    order = np.argsort(joint)
    same = joint[order[1:]] == joint[order[:-1]]
    edge = np.zeros(min(1, len(order)), bool)
    order = order[np.concatenate([edge, same]) | np.concatenate([same, edge])]
    order = order[np.lexsort((lo[order], doc[order], *[k[order] for k in keys[::-1]]))]
    d, s = doc[order], lo[order]
    new = np.ones(len(d), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    head = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    out = np.zeros(len(doc), bool)
    out[order] = (d != d[head]) | (s != s[head])
    first = np.flatnonzero(~out)
    out[first] = seen.earlier(tuple(k[first] for k in keys), doc[first], lo[first])
    return out


def _ranked(schema: pa.Schema, again: np.ndarray, number: np.ndarray, keys: tuple[np.ndarray, ...], doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Rows of kind 0 with their keys, and stretches of kind 1 of those that are repeats already: repeats that follow
    each other in one text are one stretch. Stretches get ranks of their own, so that they are dealt out evenly."""
    joint = again[1:] & again[:-1] & (number[1:] == number[:-1]) & (lo[1:] == hi[:-1] + 1)
    edge = np.zeros(min(1, len(again)), bool)
    head, tail = np.flatnonzero(again & ~np.concatenate([edge, joint])), np.flatnonzero(again & ~np.concatenate([joint, edge]))
    n, m = int((~again).sum()), len(head)
    one, *further = ([np.concatenate([k[~again], k[head]]) for k in keys])
    one[n:] = mix(one[n:] + np.arange(m, dtype=np.uint64))
    two, check = ([k.view(np.int64)] for k in further) if further else ([], [])
    first, last = np.concatenate([lo[~again], lo[head]]), np.concatenate([hi[~again], hi[tail]])
    places = [np.concatenate([doc[~again], doc[head]]), np.concatenate([tag[~again], tag[head]]), first << FAR | (last - first)]
    columns = [np.concatenate([np.zeros(n), np.ones(m)]), one.view(np.int64), *two, *places, *check]
    return _batch(schema, columns)


def _anchor_rows(source: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, grams = Seen(), Seen()
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for data, numbers, offsets, ends in _segments(texts, length):
                rank, context, check, first, last = anchors(data, ends, length, gram)
                part = np.searchsorted(ends, first, side="right")
                shift = np.asarray(offsets)[part] - np.concatenate([[0], ends[:-1]])[part]
                number = np.asarray(numbers)[part]
                doc, tag = docs[number], tags[number]
                lo, hi = first + shift + _shift(tag), last + shift + _shift(tag)
                again = _repeats((rank, context, check), doc, lo, seen)
                yield _with_contexts(_ranked(_ANCHORS, again, number, (rank, context, check), doc, tag, lo, hi), grams)

    return source.mapInArrow(run, _ddl(_ANCHORS))


def _with_contexts(anchors: pa.RecordBatch, grams: Seen) -> pa.RecordBatch:
    """Of anchors whose gram has several contexts in a batch, one stands for all where grams are sorted, unless the task
    has already sent such a one. The windows of the others are open, and are dealt out evenly."""
    kind, gram, context = (anchors.column(i).to_numpy() for i in range(3))
    own = np.flatnonzero(kind == 0)
    order = own[np.argsort(gram[own])]
    new = np.append(True, gram[order[1:]] != gram[order[:-1]]) if len(order) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(order)))
    several = np.repeat(count > 1, count)
    kind, gram = kind.copy(), gram.copy()
    rest = order[several & ~new]
    kind[order[several & new]], kind[rest] = 4, 2
    # A gram that the task has sent as one of several needs no further row.
    lone = order[new]
    keys = (gram[lone].view(np.uint64), np.zeros(len(lone), np.uint64), np.zeros(len(lone), np.uint64))
    at, known = grams.slot(keys)
    told = np.flatnonzero(known & (gram[lone] != 0))
    kind[lone[told]] = 2
    sent = np.flatnonzero(~known & (kind[lone] == 4))
    grams.put(at[sent], tuple(k[sent] for k in keys), np.zeros(len(sent), np.int64), np.zeros(len(sent), np.int64))
    rest = np.concatenate([rest, lone[told]])
    gram[rest] = mix(context[rest].view(np.uint64) + np.arange(len(rest), dtype=np.uint64)).view(np.int64)
    return _batch(_ANCHORS, (kind, gram, context, *(anchors.column(i).to_numpy() for i in range(3, 7))))


def _rerank_anchors(rows: DataFrame) -> DataFrame:
    """Sorted anchors to stretches: kind 1, windows that repeat earlier ones; kind 2, windows of the first of each
    context of a gram that has several. Only the last row of a batch is kept for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # the first of the last context, and whether it has been given
        given = True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(7)])
            passed = (table[:, 0] == 1) | (table[:, 0] == 2)
            out = [table[passed][:, [0, 3, 4, 5]]]
            table = table[~passed]
            if len(table):
                if held is not None:
                    table = np.vstack([held, table])
                gram, context, check = table[:, 1], table[:, 2], table[:, 6]
                new = np.ones(len(table), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]) | (check[1:] != check[:-1])
                head = np.flatnonzero(new)
                at = head[np.cumsum(new) - 1]
                again = ~new & ((table[:, 3] != table[at, 3]) | (table[:, 5] >> FAR != table[at, 5] >> FAR))
                repeated = table[again][:, [0, 3, 4, 5]]
                repeated[:, 0] = 1
                same = gram[head[1:]] == gram[head[:-1]]
                several = np.append(False, same) | np.append(same, False) | (np.maximum.reduceat(table[:, 0], head) == 4)
                if held is not None and given:
                    several[0] = False
                # The last context's first waits, unless it is known to be one of several.
                first = table[head[several]][:, [0, 3, 4, 5]]
                first[:, 0] = 2
                out += [repeated, first]
                given = bool(several[-1]) or (held is not None and given and len(head) == 1)
                held = table[head[-1] : head[-1] + 1]
            yield _batch(_STRETCHES, np.vstack(out).T)

    # Known stretches come with keys of their own and are only passed on.
    return rows.repartition("gram").sortWithinPartitions("gram", "context", "check", "doc", "at").mapInArrow(run, _ddl(_STRETCHES))


def _with_texts(source: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """source joined with a few rows for each text, by broadcast where these are few and else by shuffle."""
    few = (rows.agg(F.sum(1 + F.size("stretches"))).first()[0] or 0) <= BROADCAST_ROWS
    return source.join(F.broadcast(rows) if few else rows, ["doc", "tag"], how)


def _stretches_of(rows: DataFrame) -> DataFrame:
    """For each text its stretches, at most as many as it has bytes, merged where they touch."""
    grouped = rows.groupBy("doc", "tag").agg(F.collect_list("at").alias("at"))
    schema = "doc long, tag long, stretches array<struct<lo:long,hi:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy()
            ends = []
            for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True):
                at = np.sort(flat[a:b])
                ends.append(_merged(at >> FAR, (at >> FAR) + (at & ((1 << FAR) - 1))))
            bounds = np.cumsum([0, *[len(lo) for lo, _ in ends]]).astype(np.int32)
            pairs = [pa.array(np.concatenate([e[i] for e in ends] or [np.zeros(0)]).astype(np.int64)) for i in (0, 1)]
            merged = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(pairs, ["lo", "hi"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), merged], ["doc", "tag", "stretches"])

    return grouped.mapInArrow(run, schema)


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches sorted by lo as disjoint ones that don't touch."""
    if not len(lo):
        return lo, hi
    reach = np.maximum.accumulate(hi)
    new = np.append(True, lo[1:] > reach[:-1] + 1)
    return lo[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]


def _ends(stretches: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """lo and hi of each row's stretches, merged."""
    flat, offsets = stretches.flatten(), stretches.offsets.to_numpy()
    lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    base = offsets[0]
    for a, b, ok in zip(offsets[:-1] - base, offsets[1:] - base, stretches.is_valid().to_pylist(), strict=True):
        yield _merged(lo[a:b], hi[a:b]) if ok else (lo[:0], hi[:0])


def _pieces(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends (exclusive) of stretches in pieces of SEGMENT at most."""
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        for at in range(a, b + 1, SEGMENT):
            yield at, min(at + SEGMENT, b + 1)


def _name(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    return mix(mix(one) * np.uint64(0x9E3779B97F4A7C15) + two)


def _packed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The name of a pair of first ranks: 32 bits of each."""
    return (one >> np.uint64(32) << np.uint64(32)) | (two >> np.uint64(32))


def _made(keys: tuple[np.ndarray, ...], doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, last: bool, seen: Seen) -> pa.RecordBatch:
    """Rows for a round of sorting. In the last one repeats among them are known at once (kind 1). Before, of rows with
    the same name one stands for all (kind 2), and the others are known not to be unique (kind 1), as are those with a
    name that the task has sent so before."""
    number = np.cumsum(np.append(0, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))[: len(lo)]
    if last:
        return _ranked(_PAIRS, _repeats(keys, doc, lo, seen), number, keys, doc, tag, lo, lo)
    (name,) = keys
    order = np.argsort(name)
    new = np.append(True, name[order[1:]] != name[order[:-1]])[: len(lo)]
    head = np.flatnonzero(new)
    known, company = np.zeros(len(lo), bool), np.zeros(len(lo), bool)
    known[order[~new]] = True
    company[order[head[np.diff(np.append(head, len(lo))) > 1]]] = True
    first, none = order[new], np.zeros(len(head), np.uint64)
    at, met = seen.slot((name[first], none, none))
    some = ~met & company[first]
    seen.put(at[some], (name[first[some]], none[some], none[some]), doc[first[some]], lo[first[some]])
    known[first[met]] = True
    rows = _ranked(_COMPANY, known, number, keys, doc, tag, lo, lo)
    kind = rows.column(0).to_numpy().copy()
    kind[: int((~known).sum())] = np.where(company[~known], 2, 0)
    return rows.set_column(0, _COMPANY.field(0), pa.array(kind))


def _ranks(data: bytes, start: int, steps: list[int]) -> np.ndarray:
    """Ranks of all places in data, after rounds that paired at these offsets."""
    prints, p = Fingerprints(data), np.arange(len(data) - start + 1)
    rank = prints.of(p, p + start)
    for k, step in enumerate(steps):
        one, two = rank[: len(rank) - step], rank[step:]
        rank = mix(_packed(one, two)) if not k else _name(one, two)
    return rank


def _held(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether places lie in one of the stretches."""
    at = np.searchsorted(lo, q, side="right") - 1
    return (at >= 0) & (q <= hi[np.maximum(at, 0)]) if len(lo) else np.zeros(len(q), bool)


def _pairs(texts: DataFrame, start: int, steps: list[int], step: int, beyond: int, last: bool) -> DataFrame:
    """Pairs of ranks at offset `step`, after rounds at offsets `steps`. In the first one, of all positions in the
    texts' stretches and `beyond` further ones, which later rounds need; else of those that lie, with the place `step`
    further, in the stretches, where ranks aren't unique."""
    reached = start + sum(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in slices(batches):
            docs, tags, parts, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(), [], 0

            def made(parts: list) -> pa.RecordBatch:
                number, p, one, two, *digest = (np.concatenate(c) for c in zip(*parts, strict=True))
                # In the last round the name of the pair and the bytes' digest, else the name that the pair gets.
                keys = (_name(one, two), *digest) if last else (_name(one, two) if steps else _packed(one, two),)
                return _made(keys, docs[number], tags[number], p, last, seen)

            for k, (text, (lo, hi)) in enumerate(zip(batch.column(2).to_pylist(), _ends(batch.column(3)), strict=True)):
                shift = int(_shift(tags[k]))
                lo, hi = lo - shift, hi - shift
                for a, b in _pieces(*_merged(lo, np.minimum(hi + beyond, len(text) - reached - step))):
                    rank, p = _ranks(text[a : b + step + reached - 1], start, steps), np.arange(a, b)
                    some = _held(p + step, lo, hi) if steps else np.ones(len(p), bool)
                    places = p[some]
                    digest = digests(text, places, places + reached + step) if last else ()
                    parts.append((np.full(len(places), k), places + shift, rank[: b - a][some], rank[step : step + b - a][some], *digest))
                    held += len(parts[-1][0])
                    if held >= SEGMENT:
                        yield made(parts)
                        parts, held = [], 0
            if parts:
                yield made(parts)

    return texts.select("doc", "tag", "text", "stretches").mapInArrow(run, _ddl(_PAIRS if last else _COMPANY))


def _later(pairs: DataFrame) -> DataFrame:
    """Sorted pairs to repeated positions (kind 1, one window each); only the last first row is kept for the next
    batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(7)])
            known = table[table[:, 0] == 1]
            table = table[table[:, 0] == 0]
            if len(table):
                if held is not None:
                    table = np.vstack([held, table])
                new = np.ones(len(table), bool)
                new[1:] = (table[1:, [1, 2, 6]] != table[:-1, [1, 2, 6]]).any(1)
                head = np.flatnonzero(new)
                at = head[np.cumsum(new) - 1]
                again = ~new & ((table[:, 3] != table[at, 3]) | (table[:, 5] >> FAR != table[at, 5] >> FAR))
                held = table[head[-1] : head[-1] + 1]
                known = np.vstack([known, table[again]])
            known[:, 0] = 1
            yield _batch(_STRETCHES, known[:, [0, 3, 4, 5]].T)

    return pairs.repartition("r1", "r2").sortWithinPartitions("r1", "r2", "check", "doc", "at").mapInArrow(run, _ddl(_STRETCHES))


def _in_company(pairs: DataFrame) -> DataFrame:
    """Sorted names to the positions (stretches of kind 1) whose name isn't unique. Only the last row of a batch is kept
    for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)  # the first row of the last name, if it may be unique
        last: int | None = None  # the last name, if its rows are known not to be unique
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)])
            out = table[table[:, 0] == 1]
            table = np.vstack([held, table[table[:, 0] != 1]])
            if len(table):
                head = np.flatnonzero(np.append(True, table[1:, 1] != table[:-1, 1]))
                count = np.diff(np.append(head, len(table)))
                several = (count > 1) | (np.maximum.reduceat(table[:, 0], head) == 2)
                if last is not None and int(table[0, 1]) == last:
                    several[0] = True
                out = np.vstack([out, table[np.repeat(several, count)]])
                held = table[:0] if several[-1] else table[head[-1] :]
                last = int(table[-1, 1]) if several[-1] else None
            out[:, 0] = 1
            yield _batch(_STRETCHES, out[:, [0, 2, 3, 4]].T)

    return pairs.repartition("r1").sortWithinPartitions("r1").mapInArrow(run, _ddl(_STRETCHES))


def repeated_stretches(docs: DataFrame, length: int = 100, gram: int = GRAM, start: int = START, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, tag and stretches (lo, hi): starts of the windows of `length` bytes that also start earlier (in a smaller
    doc, or at a smaller offset of the same doc)."""
    source = _source(docs, id_col, text_col)
    sorted_anchors = written(_rerank_anchors(_anchor_rows(source, length, gram)), "anchors")
    open_windows = written(_stretches_of(sorted_anchors.filter("kind = 2").select("doc", "tag", "at")), "open")
    done = [sorted_anchors, open_windows]
    steps, reached, beyond = [], start, max(0, length - 2 * start)
    while True:
        step = min(reached, length - reached)
        pairs = _pairs(_with_texts(source, open_windows, "inner"), start, steps, step, 0 if steps else beyond, reached + step == length)
        steps, reached = [*steps, step], reached + step
        if reached == length:
            break
        open_windows = written(_stretches_of(_in_company(pairs).select("doc", "tag", "at")), "open")
        done.append(open_windows)
    found = sorted_anchors.filter("kind = 1").unionByName(_later(pairs))
    out = written(_stretches_of(found.select("doc", "tag", "at")), "stretches")
    for table in done:
        discard(table)
    return out


def _spans(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of bytes that windows lo..hi cover."""
    start, last = _merged(lo, hi + length - 1)
    return start, last + 1


SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = GRAM, start: int = START, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (of removed bytes, as maximal runs), kept (the bytes that remain; null
    without `texts`) and kept_sha256, one row per row of docs.

    Removed is each byte that a string of `length` bytes covers which also starts earlier: in a smaller doc_id, or
    at a smaller offset of the same one; matches lie within one text, and all are judged on the input. A null or
    empty text has no bytes. Rows with one doc_id are one document: neither of two starts at the same offset is
    earlier, so repeated rows have equal results. A null id counts as the largest. An empty table gives an empty
    result; other columns are not read.
    """
    stretches = repeated_stretches(docs, length, gram, start, id_col, text_col)
    joined = _with_texts(_source(docs, id_col, text_col), stretches, "left").select("doc", "tag", "text", "stretches")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, tag, text, (lo, hi) in zip(*(c.to_pylist() for c in batch.columns[:3]), _ends(batch.column(3)), strict=True):
                shift = LAST if tag < 0 else 0
                begin, end = _spans(lo - shift, hi - shift, length)
                edges = zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)
                kept = b"".join(text[a:b] for a, b in edges)
                spans = [{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                rows.append((None if tag < 0 else doc, len(text), len(text) - len(kept), spans, kept if texts else None, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, SCHEMA)
