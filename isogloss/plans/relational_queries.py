"""Queries on the driver's relational tables, one for each relational operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import file_stem, natural_key, partition_name, path_part, round_half_even, without_ending, zero_padded
from ..operators import lookup, running, select
from ..sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BEST_SQL = "s AS (SELECT l_returnflag AS model, l_linenumber AS layer, l_linestatus AS clustering, max(l_quantity) AS r FROM lineitem GROUP BY 1, 2, 3)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("layer"), F.col("l_linestatus").alias("clustering"))
    return rows.agg(F.max("l_quantity").alias("r"))


@query(f"WITH {BEST_SQL} SELECT model, layer, clustering, r, CASE WHEN rank() OVER (PARTITION BY model, layer ORDER BY r DESC) = 1 THEN 'X' ELSE '' END AS max_r FROM s")
def best_method_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.marked(select.best_with_ties(_scores(spark, sf_dir), ["model", "layer"], "r"))


@query(f"WITH {BEST_SQL} SELECT count(*) AS n FROM lineitem l WHERE EXISTS (SELECT 1 FROM (SELECT *, rank() OVER (PARTITION BY model, layer ORDER BY r DESC) AS k FROM s) w WHERE k = 1 AND w.model = l_returnflag AND w.layer = l_linenumber AND w.clustering = l_linestatus)")
def semi_join_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    winners = select.best_with_ties(_scores(spark, sf_dir), ["model", "layer"], "r").filter("is_best")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("layer"), F.col("l_linestatus").alias("clustering"))
    return select.of_winners(lines, winners, ["model", "layer", "clustering"]).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS model, o_orderkey AS layer, round_even(o_totalprice, 2) AS CDistance FROM (SELECT *, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS k FROM orders) WHERE k = 1")
def min_per_group_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = select.best_with_ties(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", False).filter("is_best")
    return best.select(F.col("o_orderstatus").alias("model"), F.col("o_orderkey").alias("layer"), round_half_even(F.col("o_totalprice"), 2).alias("CDistance"))


@query("SELECT event_type AS locality, user_id % 10 AS g, event_id, label FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 10 ORDER BY event_id ROWS UNBOUNDED PRECEDING)::INT AS label FROM events) WHERE event_type <> 'error'")
def partition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("g"), "event_id", F.col("event_type").alias("locality"))
    return readers.partition_labels(lines, ["g"], "event_id", "locality", F.col("locality") == "error")


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def strict_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return lookup.lookup_strict(n, r, "n_regionkey", "r_regionkey", "r_name", "r_name").select("n_nationkey", "r_name")


@query("SELECT n_nationkey, coalesce(r_name, n_regionkey::VARCHAR) AS name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def default_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").filter("r_regionkey < 3")
    n, r = n.withColumn("n_regionkey", F.col("n_regionkey").cast("string")), r.withColumn("r_regionkey", F.col("r_regionkey").cast("string"))
    return lookup.lookup_or_keep(n, r, "n_regionkey", "r_regionkey", "r_name", "name").select("n_nationkey", "name")


@query("SELECT CASE event_type WHEN 'error' THEN '-' WHEN 'click' THEN 'tap' ELSE event_type END AS event_type, count(*) AS n FROM events GROUP BY 1")
def value_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.replaced(table(spark, sf_dir, "events"), "event_type", {"error": "-", "click": "tap"}).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT p_brand, row_number() OVER (ORDER BY regexp_extract(p_brand, '^(\\D*)', 1), try_cast(regexp_extract(p_brand, '(\\d+)', 1) AS INT)) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def natural_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, number = natural_key(F.col("p_brand"))
    brands = table(spark, sf_dir, "part").select("p_brand").distinct().withColumns({"text": text, "number": number})
    return running.numbered(brands, [], ["text", "number", "p_brand"], "place").select("p_brand", (F.col("place") + 1).alias("place"))


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS n FROM events) WHERE n = 1")
def first_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.first_best(table(spark, sf_dir, "events"), ["event_type"], ["user_id", "event_id"]).select("event_type", "user_id", "event_id")


@query("SELECT source, count(*) AS n, round_even(sum(v), 2) AS total FROM (SELECT 'orders' AS source, o_totalprice AS v FROM orders UNION ALL SELECT 'events', value FROM events) GROUP BY 1")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_totalprice").alias("v"))
    e = table(spark, sf_dir, "events").select(F.lit("events").alias("source"), F.col("value").alias("v"))
    return o.unionByName(e).groupBy("source").agg(F.count("*").alias("n"), round_half_even(F.sum("v"), 2).alias("total"))


@query("SELECT page_id, string_split(url, '/')[-1] AS last, string_split(url, '/')[-2] AS before, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS stem, upper(string_split(url, '/')[-2]) AS up, CASE WHEN page_id < 10 THEN '0' ELSE '' END || page_id::VARCHAR AS padded FROM pages")
def path_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", path_part(u, 1).alias("last"), path_part(u, 2).alias("before"), file_stem(path_part(u, 1)).alias("stem"), F.upper(path_part(u, 2)).alias("up"), zero_padded(F.col("page_id"), 2).alias("padded"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT p_brand, p_size FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2'))")
def distinct_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = table(spark, sf_dir, "part").select("p_brand").filter(F.col("p_brand").isin("Brand#1", "Brand#2")).distinct()
    return table(spark, sf_dir, "part").join(dropped, "p_brand", "left_anti").select("p_brand", "p_size").distinct().agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, round_even(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.pearson(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("r", round_half_even(F.col("r"), 6))


RESULT_SQL = """files AS (SELECT 'out/' || CASE WHEN page_id % 5 = 0 THEN 'data-l04-106' ELSE 'm' || page_id % 3 END || '/' || CASE page_id % 4 WHEN 0 THEN 'other' WHEN 1 THEN 'transcription-distances' ELSE 'layer-' || page_id % 7 END || '/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.ga.' ELSE '.wm.' END || 'initclust.n4' AS path FROM pages)"""


@query(f"""WITH {RESULT_SQL},
cut AS (SELECT path, string_split(path, '/') AS p FROM files)
SELECT path, CASE WHEN contains(p[-3] || '-' || p[-2], 'layer') THEN 'layer' ELSE 'ld' END AS kind, CASE WHEN p[-3] = 'data-l04-106' THEN 'ld' ELSE p[-3] END AS model, p[-2] AS layer, 'wm' AS method
FROM cut WHERE (contains(p[-3] || '-' || p[-2], 'layer') OR contains(p[-3] || '-' || p[-2], 'transcription-distances')) AND contains(path, '.wm.')
  AND (NOT contains(p[-3] || '-' || p[-2], 'layer') OR p[-3] IN ('m0', 'm1', 'data-l04-106'))""")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    model = F.when(i % 5 == 0, readers.TRIANGULAR).otherwise(F.concat(F.lit("m"), i % 3))
    layer = F.when(i % 4 == 0, "other").when(i % 4 == 1, readers.TRANSCRIPTIONS).otherwise(F.concat(F.lit("layer-"), i % 7))
    name = F.concat(i.cast("string"), F.when(i % 2 == 0, ".ga.").otherwise(".wm."), F.lit("initclust.n4"))
    paths = table(spark, sf_dir, "pages").select(F.concat_ws("/", F.lit("out"), model, layer, name).alias("path"))
    return readers.result_files(paths, models=["m0", "m1", readers.TRIANGULAR], method="wm").select("path", "kind", "model", "layer", "method")


MATRIX_SQL = "files AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'LD' ELSE 'm' || page_id % 3 END AS model, 'layer-' || page_id % 7 AS layer, CASE WHEN page_id % 2 = 0 THEN 'ga' ELSE 'wm' END AS method, CASE WHEN page_id % 5 = 0 THEN 'indiff/' ELSE 'out/' END || page_id % 3 || CASE WHEN page_id % 6 = 0 THEN '.tab' ELSE '.dif' END AS path FROM pages)"


@query(f"WITH {MATRIX_SQL} SELECT page_id, regexp_replace(path, '.dif', '') || '.' || method || '.coph.clust' AS coph, CASE WHEN model = 'LD' THEN model ELSE model || '-' || layer END || '.' || method || '.initclust.n4' AS partition_file FROM files")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a clustering's files, from its matrix file and from model, layer and method."""
    i = F.col("page_id")
    model, layer = F.when(i % 4 == 0, "LD").otherwise(F.concat(F.lit("m"), i % 3)), F.concat(F.lit("layer-"), i % 7)
    method = F.when(i % 2 == 0, "ga").otherwise("wm")
    path = F.concat(F.when(i % 5 == 0, "indiff/").otherwise("out/"), i % 3, F.when(i % 6 == 0, ".tab").otherwise(".dif"))
    coph = F.concat_ws(".", without_ending(path, "dif"), method, F.lit("coph.clust"))
    return table(spark, sf_dir, "pages").select("page_id", coph.alias("coph"), partition_name(model, layer, method).alias("partition_file"))


@query("SELECT string_split(url, '/')[-3] AS model, string_split(url, '/')[-2] AS layer, count(DISTINCT url) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1, 2")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.file_counts(table(spark, sf_dir, "pages").filter("url is not null"), "url")
