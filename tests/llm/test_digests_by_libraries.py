"""Digest columns of the registered queries against the libraries that define them, on whole tables."""

import base64
import hashlib
import zlib

import tiktoken
from isogloss.llm import byte_bpe, media, queries

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_token_ids_are_those_of_tiktoken(spark):
    names = byte_bpe.public_tokenizers
    with open(names.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    plain = tiktoken.Encoding("plain", pat_str=names.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known, rows = texts(spark), queries.QUERIES["op9_byte_bpe"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(known)
    for r in rows:
        ids = plain.encode_ordinary(known[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(known[r.doc_id].encode()).hexdigest()


def test_media_columns_are_those_of_hashlib_and_zlib(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known, rows = texts(spark), queries.QUERIES["op3_media_webp"](spark, SF).collect()
    stored = {r[0]: next(bytes(v) for v in r if isinstance(v, (bytes, bytearray))) for r in media.store_texts(docs).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(known) == sorted(stored)
    for r in rows:
        data = known[r.doc_id].encode()
        padded = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
