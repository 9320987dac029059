"""Byte-level BPE encoding and decoding (operator 9) with the tiktoken library and a local rank file.

A long text is cut where no match of the splitting pattern can cross: between a character that is not white space
and white space after it (as the pattern's engine has it: Python's class has U+001C to U+001F, too). No alternative
of the pattern goes on past white space once it has taken another character, and lookahead only looks at white space
that a piece keeps whole, so the pieces' matches are the text's. The engine can't match a million white-space
characters in a row; a long run of them is a match by the pattern's rule: all of it but the last character, which
begins the next match, or all of it at the end of a text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from .arrow_text import map_texts

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a piece, at least, before it is cut at the next safe place.
PIECE = 1 << 16
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])")
_RUN = re.compile(rf"[{_SPACE}]+")


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file's content, without special tokens."""
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[str, bool]]:
    """The text cut at safe places, and whether a piece is one match (a run of over `size` white-space characters); a
    stretch without a safe place stays whole."""
    at = 0
    runs = (r.span() for r in _RUN.finditer(text) if r.end() - r.start() > size) if len(text) > size else iter(())
    for start, stop in [*runs, (len(text), len(text))]:
        while start - at > size and (cut := _SAFE.search(text, at + size, start)):
            yield text[at : cut.start()], False
            at = cut.start()
        if at < start:
            yield text[at:start], False
        at = stop - (start < stop < len(text))
        if start < at:
            yield text[start:at], True


def encode(text: str, enc: tiktoken.Encoding, size: int = PIECE) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece, match in pieces(text, size):
        out += enc._encode_single_piece(piece) if match else enc.encode_ordinary(piece)
    return out


def read_ranks(path: str | None = None) -> bytes:
    """The rank file's bytes, read on the driver: under 1 MB for the public vocabularies, more is refused."""
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a rank file of over 64 MB isn't sent to the tasks")
    return data


SCHEMA = "doc_id long, ids array<int>, decoded binary"


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (the token ids of the whole text) and decoded (the bytes that the ids give back).

    A null text counts as empty: no ids, no bytes. Repeated rows give repeated results, a null id stays null, an
    empty table gives an empty result; other columns are not read.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def batch(ids: list, texts: list) -> dict[str, list]:
        enc = encoding(ranks.value)
        out: dict[str, list] = {"doc_id": ids, "ids": [], "decoded": []}
        for t in texts:
            tokens = encode((t or b"").decode(), enc)
            out["ids"].append(np.array(tokens, np.int32))  # a tenth of what a list takes
            out["decoded"].append(enc.decode_bytes(tokens))
        return out

    return map_texts(docs, batch, SCHEMA, id_col, text_col)


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_texts, with digests in place of ids and bytes, so that only those leave the kernel."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def batch(ids: list, texts: list) -> dict[str, list]:
        enc = encoding(ranks.value)
        names = _names(enc.n_vocab)
        out: dict[str, list] = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in texts:
            tokens = encode((t or b"").decode(), enc)
            out["n_tokens"].append(len(tokens))
            out["ids_sha256"].append(hashlib.sha256(",".join([names[i] for i in tokens]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(enc.decode_bytes(tokens)).hexdigest())
        return out

    return map_texts(docs, batch, DIGEST_SCHEMA, id_col, text_col)


@lru_cache(maxsize=2)
def _names(n: int) -> list[str]:
    return [str(i) for i in range(n + 1)]
