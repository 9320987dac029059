"""A corpus pipeline over documents: language, near copies, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
reads it again for the next stage. Further columns of docs, whatever their names and types, are carried along by all
stages but the last. An empty table gives an empty result in each stage.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isogloss.llm import byte_bpe, jaccard_join, language_id, mixing, secret_scan, table_filters
from isogloss.session import written

#: Tokens wanted of each domain, relative to what the stage is given. A document is kept once at most, so none is over 1,
#: and they leave what clean documents must give up for the share of `toxic` that their posteriors hold.
WEIGHTS = {"toxic": 0.45, "quality0": 0.95, "quality1": 0.98}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language isn't recognised: null, without a letter, or not like any language that was
    learned, as calibrated on labelled rows (language_id.calibrate). Repeated rows fare alike; a null id doesn't
    matter. Without labelled rows only texts that can have no language go."""
    model = language_id.train(docs)

    def keep(ids: list, texts: list) -> list[bool]:
        names, _ = model.predict(texts, reject=True)
        if not model.languages:  # nothing was learned: only what can have no language goes
            return [language_id.has_letter(t) for t in texts]
        return [n != language_id.UNKNOWN for n in names]

    return table_filters.keep_rows(docs, keep)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of 5-word shingles with a similarity of 0.8 or more join, the one with
    the smallest doc_id; of rows that repeat it, one. Rows with a null id and texts without words stay."""
    return table_filters.one_of_each(docs, jaccard_join.similar_documents(docs, 5, jaccard_join.Threshold(80, 100)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows. A null text stays null, repeated rows get equal texts."""
    automaton = secret_scan.compile_rules()
    holder: list[secret_scan.Scanner] = []

    def rewrite(texts: list) -> list:
        if not holder:
            holder.append(secret_scan.Scanner(automaton))
        return secret_scan.redact(texts, holder[0])

    return table_filters.rewrite_texts(docs, rewrite)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each document with a chance of its fitted rate, 1 at most: where a hash of its id (of its text without one)
    lies below the rate. The tokens kept of each domain are then expected to be those of WEIGHTS. A null text counts as
    empty, rows that repeat an id and a text fare alike; without labels every row stays. A fit that ran out of passes before
    it settled is used, with a warning that says how far it got."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    _, fitted, classifier = mixing.mix_sources(docs, labels, mixing.label_domain(), mixing.weighted(WEIGHTS), most=1.0)
    if not fitted.settled:
        warnings.warn(f"the mix has not settled: {fitted.reached.tolist()} of {fitted.targets.tolist()} tokens", stacklevel=2)

    def keep(ids: list, texts: list) -> list[bool]:
        import xxhash

        rates = fitted.rates(classifier.posteriors(texts)[0])
        keys = [(t or b"") if i is None else str(i) for i, t in zip(ids, texts, strict=True)]
        return [r >= 1 or xxhash.xxh3_64_intdigest(k) / 2**64 < r for k, r in zip(keys, rates.tolist(), strict=True)]

    return table_filters.keep_rows(docs, keep)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the bytes that the ids decode to, a row for each row; a null text counts
    as empty, a null id stays null."""
    out = byte_bpe.encode_texts(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_copies", near_copies), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]

#: SQL can't express the language, mix and token stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
