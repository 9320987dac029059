"""The registered query of each operator, with its production parameters, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroid_clusters, jaccard_join, kmeans_tree, language_id, license_rules, license_scan, media, mixing, secret_scan, suffix_dedup, token_counts, url_filter, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of documents."""
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.RULES if r.base]

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select("doc_id", *[count(k) for k in base], F.sha2(joined(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _secret_sql() -> str:
    kinds = ", ".join(f"({i}, '{r.kind}', '{r.expression.replace(chr(39), chr(39) * 2)}', {r.least}, {str(r.base).lower()})" for i, r in enumerate(secret_scan.RULES))
    # The bytes counted by `least` are those after the expression's shortest match; its last loop is greedy.
    heads = ", ".join(f"({i}, '{r.expression[: r.expression.rindex('[')].replace(chr(39), chr(39) * 2)}')" for i, r in enumerate(secret_scan.RULES) if r.least > 1)
    return f"""
WITH kinds(ord, kind, expr, least, base) AS (VALUES {kinds}),
heads(ord, head) AS (VALUES {heads}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT rid, k.ord, kind, least, base, string_split_regex(text, expr) AS gaps, regexp_extract_all(text, expr) AS hits, text
          FROM docs, kinds k WHERE regexp_matches(text, expr)),
each AS (SELECT rid, ord, kind, least, base, i, gaps[i] AS gap, hits[i] AS hit FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM parts)),
spans AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, ord ORDER BY i) AS e FROM each),
kept AS (SELECT rid, ord, kind, base, e - length(hit) AS s, e FROM spans LEFT JOIN heads USING (ord)
         WHERE least = 1 OR length(hit) - length(regexp_extract(hit, '^' || head)) >= least)
SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(concat(kind, ':', s::BIGINT, ':', e::BIGINT), ',' ORDER BY s, ord) FILTER (WHERE base), '')) AS base_sha256,
       coalesce(string_agg(concat(kind, ':', s::BIGINT, ':', e::BIGINT), ',' ORDER BY s, ord) FILTER (WHERE ord IS NOT NULL), '') AS spans
FROM docs LEFT JOIN kept USING (rid) GROUP BY rid, doc_id"""


ORACLE["op1_secret_scan"] = _secret_sql()


@_query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for every URL of pages."""
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


ORACLE["op8_url_filters"] = f"""
WITH rules(action, host, path) AS (VALUES {", ".join(str(r) for r in url_filter.RULES)}),
rest AS (SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT rid, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest),
parts AS (SELECT rid, page_id, translate(raw, '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
          regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
fits AS (SELECT p.*, r.host || r.path AS rule, r.action, row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
         FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE n = 1"""


@_query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text of documents, and the bytes that they decode to, as digests."""
    return byte_bpe.encode_digests(_table(spark, sf_dir, "documents"))


@_query
def op2_ann_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every embedding whose vec_id is divisible by 20."""
    return kmeans_tree.nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every text of documents; learned from rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@_query
def op3_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as lossless WebP, read back."""
    return media.media_digests(_table(spark, sf_dir, "documents"))


@_query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"), 3, jaccard_join.Threshold(90, 100))


ORACLE["op4_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                          ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach(node, least) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.node WHERE r.least < l.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.least AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT node, min(least) AS least FROM reach GROUP BY node) m ON m.node = d.doc_id"""


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every text of documents."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


#: Tokens that op10_mixing wants of each domain, relative to what there is.
MIX_WEIGHTS = {"toxic": 0.05, "quality0": 0.5, "quality1": 1.25}


@_query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain, posteriors and fitted rate of every document."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rated, _, _ = mixing.mix_sources(docs, labels, mixing.label_domain(), mixing.weighted(MIX_WEIGHTS))
    return rated


@_query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents that repeat earlier strings of 100 bytes, removed."""
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


# Bytes as pairs of hex digits; a window that isn't the first of its string is a repeat.
ORACLE["op7_suffix_dedup"] = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM docs)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM again)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, b AS a FROM spans UNION ALL SELECT doc_id, 0 FROM docs),
pieces AS (SELECT e.doc_id, e.a, coalesce((SELECT min(s.a) FROM spans s WHERE s.doc_id = e.doc_id AND s.a >= e.a), d.n) AS b FROM edges e JOIN docs d USING (doc_id)),
kept AS (SELECT p.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM pieces p JOIN docs USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, n AS n_bytes, n - length(k) // 2 AS n_removed, (SELECT count(*) FROM spans s WHERE s.doc_id = d.doc_id) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM docs d JOIN kept USING (doc_id)"""


# Vectors as whole numbers; sums of squares are exact.
_WHOLE = "len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0"


def _floor(total: str, n: str) -> str:
    return f"CAST(({total} - ((({total} % {n}) + {n}) % {n})) // {n} AS BIGINT)"


@_query
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every embedding after ten rounds."""
    return centroid_clusters.cluster_vectors(_table(spark, sf_dir, "embeddings")).drop("centroid")


def _cluster_sql() -> str:
    k, width, scale, seed, rounds = centroid_clusters.CENTROIDS, centroid_clusters.WIDTH, centroid_clusters.SCALE, centroid_clusters.SEED, centroid_clusters.ROUNDS
    d = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {width} AND {_WHOLE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS j, x AS c FROM v QUALIFY j < {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, vec_id, x, j, d FROM (SELECT *, {d} AS d FROM v CROSS JOIN c{t}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)")
        if t < rounds:
            parts.append(f"m{t} AS (SELECT j, list({_floor('s', 'n')} ORDER BY i) AS c FROM (SELECT j, i, sum(e) AS s, count(*) AS n FROM (SELECT j, unnest(range(1, {width + 1})) AS i, unnest(x) AS e FROM a{t}) GROUP BY 1, 2) GROUP BY 1)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (j))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, j::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"""


ORACLE["op11_centroid_clusters"] = _cluster_sql()


@_query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every embedding, eight parts of a half byte's range each."""
    return vector_codes.compress_vectors(_table(spark, sf_dir, "embeddings")).drop("codes")


def _code_sql() -> str:
    parts, entries, rounds, scale = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS, vector_codes.SCALE
    out = [
        f"fit AS (SELECT * FROM embeddings WHERE {_WHOLE} AND len(embedding) > 0 AND len(embedding) % {parts} = 0)",
        "wide AS (SELECT len(embedding) AS w FROM fit GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x, w // {parts} AS w FROM fit JOIN wide ON len(embedding) = w)",
        f"p AS MATERIALIZED (SELECT r, k, x[k * w + 1 : k * w + w] AS x, w FROM (SELECT *, unnest(range({parts})) AS k FROM v))",
        f"first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS j FROM v QUALIFY j < {entries})",
        "c0 AS MATERIALIZED (SELECT k, j, x AS c FROM p JOIN first USING (r))",
    ]
    for t in range(rounds + 1):
        out.append(f"a{t} AS MATERIALIZED (SELECT r, k, x, w, j, d FROM (SELECT p.*, j, list_sum(list_transform(range(1, w + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM p JOIN c{t} USING (k)) QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY d, j) = 1)")
        if t < rounds:
            out.append(f"m{t} AS (SELECT k, j, list({_floor('s', 'n')} ORDER BY i) AS c FROM (SELECT k, j, i, sum(e) AS s, count(*) AS n FROM (SELECT k, j, unnest(range(1, w + 1)) AS i, unnest(x) AS e FROM a{t}) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            out.append(f"c{t + 1} AS MATERIALIZED (SELECT k, j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (k, j))")
    return f"""WITH {", ".join(out)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, j)) AS codebooks_sha256 FROM c{rounds}),
coded AS (SELECT r, string_agg(printf('%02x', j), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (r) CROSS JOIN books"""


ORACLE["op13_vector_codes"] = _code_sql()


@_query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every text of documents."""
    scanned = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))

    def labels(*found):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(f, lambda d: d["label"]) for f in found]))), ",")

    starts = F.transform("base", lambda d: d["start"])
    spans = F.array_join(F.transform("found", lambda d: F.concat_ws(":", d["label"], d["start"].cast("string"), d["end"].cast("string"))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "found").alias("labels"), license_scan.sureness(F.col("found")).alias("score"), spans.alias("spans"),
    )


def _license_sql() -> str:
    kinds = license_rules.rules()
    table = ", ".join(f"({r.level}, {i}, '{r.label}', {str(r.base).lower()}, '{license_scan.pattern(r.expression)}')" for i, r in enumerate(kinds))
    keys = "|".join(sorted({w for r in kinds for g in r.words for w in g}))
    sure = ", ".join(map(str, license_rules.SURE))
    return rf"""
WITH rules(level, rule, label, base, pattern) AS (VALUES {table}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.WORD}') AS w FROM documents),
spaced AS MATERIALIZED (SELECT rid, ' ' || array_to_string(w, '  ') || ' ' AS t FROM docs),
likely AS (SELECT * FROM spaced WHERE regexp_matches(t, ' ({keys}) ')),
met AS (SELECT * FROM likely JOIN rules ON regexp_matches(t, pattern)),
marked AS (SELECT *, string_split(trim(regexp_replace(t, pattern, E' \1', 'g'), ' '), '  ') AS m, regexp_extract_all(t, pattern, 1) AS hits FROM met),
each AS (SELECT rid, level, rule, label, base, unnest(list_filter(range(len(m)), lambda i: starts_with(m[i + 1], E''))) AS s, unnest(hits) AS hit FROM marked),
found AS MATERIALIZED (SELECT rid, level, rule, label, base, s, s + len(string_split(rtrim(hit, ' '), '  ')) AS e FROM each),
kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.rid = f.rid AND g.s <= f.s AND g.e >= f.e AND g.level <= f.level AND (g.s < f.s OR g.e > f.e OR g.level < f.level OR g.rule < f.rule))),
bases AS (SELECT rid, count(*) AS n, min(s) AS a, max(s) AS b, list(DISTINCT label) AS l FROM found WHERE base GROUP BY rid),
stays AS (SELECT rid, list(DISTINCT label) AS l, max([{sure}][level + 1]) AS score, string_agg(concat(label, ':', s, ':', e), ',' ORDER BY s, e DESC, level, rule) AS spans FROM kept GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(bases.l, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.l, []), coalesce(stays.l, [])))), ',') AS labels,
       coalesce(score, 0)::DOUBLE AS score, coalesce(spans, '') AS spans
FROM docs LEFT JOIN bases USING (rid) LEFT JOIN stays USING (rid)"""


ORACLE["op12_license_scan"] = _license_sql()
