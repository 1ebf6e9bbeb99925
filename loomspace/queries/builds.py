"""Incremental builds: the stored graph after batches and changes, cluster features, and clustering of a stream."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import birch
from ..plans import chunks
from ..sources import tables as t
from ..sources.code_store import CodeStore
from ..sources.graph_store import GraphStore
from ..streaming import clusters
from . import register
from .graphs import K, knn_sql
from .indexes import folder
from .vectors import M

SHOWN = "SELECT source, target, round(sim, 6) AS sim FROM"


def shown(edges):
    return edges.select("source", "target", F.round("sim", 6).alias("sim"))


@register("graph_upserts", f"{M} {SHOWN} ({knn_sql('E1')})")
def graph_upserts(spark, d):
    """The graph after three batches of memories and a replay of the second."""
    store, m = GraphStore(spark, folder(spark), K), t.vectors(spark, d)
    for batch in (0, 1, 2, 1):
        store.upsert(m.filter(f"memory_id % 3 = {batch}"), batch, F.col("E1"))
    return shown(store.edges())


@register("graph_after_changes", M.replace("WITH m AS (", "WITH m0 AS (", 1) + f", m AS (SELECT * FROM m0 WHERE memory_id % 10 <> 3) {SHOWN} ({knn_sql('E1')})")
def graph_after_changes(spark, d):
    """The graph after a batch that first stored some memories under their neighbours' vectors, one that mends those, and one that removes
    a tenth."""
    store, m = GraphStore(spark, folder(spark), K), t.vectors(spark, d).select("memory_id", F.col("E1").alias("v"))
    wrong = F.when(F.col("memory_id") % 7 == 0, F.reverse("v")).otherwise(F.col("v")).alias("v")
    store.upsert(m.select("memory_id", wrong), 0)
    store.upsert(m.filter("memory_id % 7 = 0"), 1)
    store.upsert(m.filter("memory_id % 10 = 3").select("memory_id", F.lit(None).cast("array<double>").alias("v")), 2)
    return shown(store.edges())


@register("birch_totals", M + ", s AS (SELECT count(*) AS n, round(sum(list_sum(list_transform(e, lambda x: x * x))), 4) AS ss, [round(sum(e[1]), 4), round(sum(e[33]), 4), round(sum(e[64]), 4)] AS ls FROM m) SELECT n, ss, ls[1] AS ls_first, ls[2] AS ls_middle, ls[3] AS ls_last, true AS bounded FROM s")
def birch_totals(spark, d):
    """The sums over all cluster features, and whether they are as few as asked for."""
    found = birch.features(t.vectors(spark, d), F.col("E1"))
    at = lambda k: F.round(F.sum(F.element_at("ls", k)), 4)
    return found.agg(
        F.sum("n").alias("n"), F.round(F.sum("ss"), 4).alias("ss"), at(1).alias("ls_first"), at(33).alias("ls_middle"), at(64).alias("ls_last"),
        (F.count("*") <= birch.MOST).alias("bounded"))


@register("birch_clusters")
def birch_clusters(spark, d):
    """The features as clusters: size, radius and first dimension of the centroid."""
    own = birch.clusters(birch.features(t.vectors(spark, d), F.col("E1"), threshold=0.5))
    return own.select("cluster", "n", F.round("radius", 6).alias("radius"), F.round(F.col("centroid")[0], 6).alias("first"))


@register("stream_clusters", "WITH n AS (SELECT count(*) AS n, count(*) // 100 AS f FROM embeddings) SELECT s.space, n AS n_inserted, 50 * f * (f + 1) AS n_reclustered FROM n, (VALUES ('E1'), ('E7')) s(space) WHERE n <= 4000")
def stream_clusters(spark, d):
    """A stream of memories in two spaces, clustered anew after each hundred: rows by kind. Buffers hold 4,000 memories, so the counts of
    the SQL are those of tables up to that."""
    where = folder(spark)
    m = t.vectors(spark, d)
    parts = F.explode(F.array(*(F.struct(F.lit(s).alias("space"), t.part(s).alias("v")) for s in ("E1", "E7")))).alias("x")
    m.select("memory_id", parts).select("x.space", "memory_id", "x.v").write.parquet(f"{where}/in")
    stream = spark.readStream.schema("space string, memory_id long, v array<double>").parquet(f"{where}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, clusters.PROVIDER)
    try:
        q = clusters.clustered(stream).writeStream.format("parquet").option("checkpointLocation", f"{where}/cp").trigger(availableNow=True).start(f"{where}/out")
        q.awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    out = spark.read.schema(clusters.OUT).parquet(f"{where}/out")
    return out.groupBy("space").agg(F.count(F.when(F.col("kind") == "insert", 1)).alias("n_inserted"), F.count(F.when(F.col("kind") == "recluster", 1)).alias("n_reclustered"))


def code_store(spark, d):
    """Pages as entities, in three batches: all of them, every seventh under a new name and signature, and a tenth deleted."""
    host, number = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/?#]*/([a-z]+)/([0-9]+)", 2)
    lang = F.regexp_extract("url", "://[^/?#]*/([a-z]+)/([0-9]+)", 1)
    rows = t.read(spark, d, "pages").select(
        F.col("page_id").alias("id"), F.lit("page").alias("entity_type"), F.concat_ws("_", lang, number).alias("name"), F.substring("html", 1, 40).alias("code"), lang.alias("language"),
        host.alias("file_path"), F.lit(1).cast("long").alias("line_start"), F.lit(1).cast("long").alias("line_end"), F.concat(F.lit("page("), lang, F.lit(", "), (F.length("html") % 20).cast("string"), F.lit(")")).alias("signature"))
    store = CodeStore(spark, folder(spark))
    store.upsert(rows, 0)
    store.upsert(rows.filter("id % 7 = 0").withColumn("name", F.concat(F.lit("new_"), "name")).withColumn("signature", F.lit("renamed()")), 1)
    store.upsert(rows.limit(0), 2, rows.filter("id % 10 = 3").select("id"))
    return store


C = r"WITH p AS (SELECT page_id AS id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/([a-z]+)/([0-9]+)', 1) AS lang, regexp_extract(url, '://[^/?#]*/([a-z]+)/([0-9]+)', 2) AS no, length(html) % 20 AS k FROM pages WHERE page_id % 10 <> 3), c AS (SELECT id, host AS file_path, CASE WHEN id % 7 = 0 THEN 'new_' ELSE '' END || concat_ws('_', lang, no) AS name, CASE WHEN id % 7 = 0 THEN 'renamed()' ELSE 'page(' || lang || ', ' || k || ')' END AS signature FROM p)"


@register("code_by_name_prefix", C + " SELECT id, name FROM c WHERE starts_with(name, 'en_1')")
def code_by_name_prefix(spark, d):
    return code_store(spark, d).by_name_prefix("en_1").select("id", "name")


@register("code_by_signature", C + " SELECT id, name, signature FROM c WHERE signature IN ('page(en, 3)', 'renamed()')")
def code_by_signature(spark, d):
    store = code_store(spark, d)
    return store.by_key("by_signature", "page(en, 3)").unionByName(store.by_key("by_signature", "renamed()")).select("id", "name", "signature")


@register("code_files", C + " SELECT file_path, count(*) AS n FROM c GROUP BY file_path")
def code_files(spark, d):
    return code_store(spark, d).files()


@register("code_chunk_lines", "SELECT page_id, len(string_split(html, chr(10))) AS lines, length(regexp_replace(html, '[ \\t\\n\\r\\f\\v]', '', 'g')) AS characters, true AS in_order FROM pages WHERE length(regexp_replace(html, '[ \\t\\n\\r\\f\\v]', '', 'g')) > 0")
def code_chunk_lines(spark, d):
    """Chunks of the pages' markup: together they are all lines and characters, in order."""
    pages = t.spread(t.read(spark, d, "pages")).select("page_id", "html", F.lit("javascript").alias("kind"))
    own = chunks.chunked_code(pages, "page_id", "html", "kind")
    before = F.lag("line_end").over(W.partitionBy("page_id").orderBy("chunk"))
    own = own.withColumn("ok", F.col("line_start") == F.coalesce(before, F.lit(0)) + 1)
    return own.groupBy("page_id").agg(F.max("line_end").alias("lines"), F.sum("characters").alias("characters"), F.bool_and("ok").alias("in_order"))
