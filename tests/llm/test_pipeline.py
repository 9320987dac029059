import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from isogloss.llm import byte_bpe, mixing, secret_scan

from .test_kernels_llm import brute_sets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("kept"))
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, "1 2 3 !!", "en", "s", 8), (900004, None, "de", None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    out = [docs.unionByName(odd.withColumn("extra", F.lit("kept")))]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "secrets", "mix", "tokens"]


def test_language_stage_drops_what_has_no_letter(stages):
    gone = {r.doc_id for r in stages[0].select("doc_id").subtract(stages[1].select("doc_id")).collect()}
    assert {900001, 900002, 900003, 900004} == gone


def test_language_stage_drops_languages_that_were_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(3)
    words = [
        "вчера вечером мы долго гуляли по набережной и говорили о том как быстро меняется город",
        "χθες το βράδυ περπατήσαμε πολλή ώρα στην παραλία και μιλήσαμε για την πόλη όπου μεγαλώσαμε",
        "昨天晚上 我们在河边散步 聊了很久 关于这座城市 变化得多么快",
        "wczoraj wieczorem długo spacerowaliśmy nad rzeką i rozmawialiśmy jak szybko zmienia się miasto",
        " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(400)),
    ]
    # Without a language, as nobody has labelled them.
    odd = spark.createDataFrame([(910000 + k, " ".join(rng.choices(words[k % 5].split(), k=15 * (k // 5 + 1))), None, "s", 0) for k in range(25)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(odd), SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_copies_stage(stages):
    rows = {r.doc_id: brute_sets(r.text, 5) for r in stages[1].collect()}
    label = {d: d for d in rows}
    ids = sorted(rows)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            if 5 * len(rows[a] & rows[b]) >= 4 * len(rows[a] | rows[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if v == high else v for d, v in label.items()}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(label.values()))


def test_secrets_stage(stages):
    scanner = secret_scan.Scanner(secret_scan.compile_rules())
    before = {r.doc_id: r for r in stages[2].collect()}
    for r in stages[3].collect():
        assert r.text.encode() == secret_scan.redact([before[r.doc_id].text.encode()], scanner)[0]
        assert not scanner.scan(r.text.encode())
        assert r.n_chars == (len(r.text) if r.text != before[r.doc_id].text else before[r.doc_id].n_chars)


def test_mix_stage_keeps_clean_documents(spark, stages):
    kept = {r.doc_id for r in stages[4].collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r.doc_id for r in stages[3].collect() if r.doc_id in labels and labels[r.doc_id].toxic == 0]
    assert len([d for d in clean if d in kept]) >= 0.95 * len(clean)


def test_mix_stage_meets_its_targets(spark, stages):
    rated, mix, _ = mixing.mix_sources(stages[3], spark.read.parquet(f"{SF}/labels.parquet"), mixing.label_domain(), mixing.weighted(corpus_pipeline.WEIGHTS), most=1.0)
    rows = rated.collect()
    kept = {r.doc_id for r in stages[4].collect()}
    t, p, rate = np.array([r.n_tokens for r in rows]), np.array([r.p for r in rows]), np.array([r.rate for r in rows])
    assert (mix.targets <= mix.totals).all() and (rate >= 0).all() and (rate <= 1).all()
    assert (t * rate) @ p == pytest.approx(mix.targets, rel=1e-2)
    # Tokens kept of each domain: the targets, within what chance allows.
    got = (t * [r.doc_id in kept for r in rows]) @ p
    assert (np.abs(got - mix.targets) <= 3 * np.sqrt((t * t * rate * (1 - rate)) @ (p * p)) + 1e-2 * mix.targets).all()


def test_tokens_stage(stages):
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.encoding(byte_bpe.read_ranks())._mergeable_ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_on_odd_tables(spark, tmp_path):
    """Repeated ids and rows, nulls, long texts and clashing columns; then tables without rows."""
    rng = random.Random(1)
    words = {lang: rng.choices(text.split(), k=400) for lang, text in (("en", "the quick brown fox jumps over a lazy dog and then it sleeps under warm sun"), ("de", "der schnelle braune fuchs springt und dann schlafen wir unter warmer sonne"))}
    rows = [(i, " ".join(rng.choices(words[lang], k=60)), lang, "s", 1, {"a": i}) for i in range(60) for lang in (("en", "de")[i % 2],)]
    rows += [rows[3], (4, rows[9][1], "de", "s", 1, None), (None, rows[5][1], "de", None, None, None), (70, None, None, None, None, None), (71, "", "en", "s", 0, None), (72, rows[8][1] + " zzz", "en", "s", 1, None), (73, " ".join(rng.choices(words["en"], k=200_000)), "en", "s", 1, None), (74, rows[10][1] + " token = abcdef0123456789", "en", "s", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id map<string,int>")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/some/{name}.parquet")
        df.filter("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    ids = [r.doc_id for r in out]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and not {70, 71, 72} & set(ids)
    assert 73 in ids and len(out) >= 50 and all(len(r.ids) == r.n_tokens for r in out)
    empty = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
