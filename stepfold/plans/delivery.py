"""Queries over deliveries: unpack reports, verified indexes, rebuilt manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery
from .fixtures import table
from .registry import query


def _plan(spark, d):
    n = F.col("page_id").cast("string")
    more = F.when(F.col("page_id") % 4 == 0, F.array(F.concat(F.lit("alt/"), n), F.concat(F.lit("old/"), n)))
    return table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "a").otherwise("b").alias("dataset"), F.concat(F.lit("p/"), n).alias("path"), more.alias("alternatives"))


STATUS_SQL = "CASE WHEN page_id % 5 = 1 OR page_id % 8 = 4 THEN 'verified' WHEN page_id % 5 = 2 OR page_id % 16 = 8 THEN 'unverified' ELSE 'missing' END"


def _report(spark, d):
    plan, i = _plan(spark, d), F.col("page_id")
    n = i.cast("string")
    good = plan.filter(i % 5 == 1).select("path").union(plan.filter(i % 8 == 4).select(F.concat(F.lit("old/"), n)))
    there = plan.filter(i % 5 == 2).select("path").union(plan.filter(i % 16 == 8).select(F.concat(F.lit("alt/"), n))).union(good)
    return delivery.unpack_report(plan.drop("page_id"), good, there)


@query("q109_unpack_report", f"SELECT CASE WHEN page_id % 3 = 0 THEN 'a' ELSE 'b' END AS dataset, 'p/' || page_id AS path, {STATUS_SQL} AS status FROM pages")
def unpack_report(spark, d):
    return _report(spark, d)


@query("q110_delivery_summary", f"""WITH r AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'a' ELSE 'b' END AS dataset, {STATUS_SQL} AS status FROM pages)
    SELECT dataset, CASE WHEN count(*) FILTER (status <> 'verified') > 0 THEN 'missing-inputs' ELSE 'unpacked' END AS status, count(*) AS files, count(*) FILTER (status <> 'verified') AS missing, count(*) FILTER (status = 'unverified') AS unverified FROM r GROUP BY 1""")
def delivery_summary(spark, d):
    return delivery.delivery_summary(_report(spark, d))


@query("q111_index_verification", """WITH i AS (SELECT doc_id, 'doc/' || doc_id AS image_ref, sha256(coalesce(text, '')) AS digest, n_chars, lang FROM documents WHERE doc_id % 20 <> 0),
    r AS (SELECT doc_id, 'doc/' || doc_id AS image_ref, CASE WHEN doc_id % 13 = 1 THEN 'x' ELSE sha256(coalesce(text, '')) END AS digest, CASE WHEN doc_id % 13 IN (1, 2) THEN n_chars + 1 ELSE n_chars END AS n_chars, lang FROM documents WHERE doc_id % 17 <> 0)
    SELECT image_ref, 'repeated' AS rule, '2' AS detail FROM i WHERE doc_id % 19 = 3
    UNION ALL SELECT image_ref, CASE WHEN doc_id % 11 = 5 THEN 'file_missing' ELSE 'file_modified' END, 'image_path' FROM i, range(CASE WHEN doc_id % 19 = 3 THEN 2 ELSE 1 END) WHERE doc_id % 11 IN (5, 6)
    UNION ALL SELECT image_ref, 'not_in_reference', NULL FROM i WHERE doc_id % 17 = 0 UNION ALL SELECT image_ref, 'not_in_index', NULL FROM r WHERE doc_id % 20 = 0
    UNION ALL SELECT image_ref, 'differs', concat_ws(',', CASE WHEN i.digest <> r.digest THEN 'digest' END, CASE WHEN i.n_chars <> r.n_chars THEN 'n_chars' END, CASE WHEN i.lang IS DISTINCT FROM r.lang THEN 'lang' END) FROM i JOIN r USING (image_ref)
      WHERE i.digest <> r.digest OR i.n_chars <> r.n_chars OR i.lang IS DISTINCT FROM r.lang""")
def index_verification(spark, d):
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), n.cast("string")).alias("image_ref"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), "n_chars", "lang", F.concat(F.lit("f/"), n.cast("string")).alias("image_path"))
    index = docs.filter(n % 20 != 0)
    index = index.union(index.filter(n % 19 == 3))
    files = docs.filter(n % 11 != 5).select(F.col("image_path").alias("path"), F.when(n % 11 == 6, F.lit("y")).otherwise(F.col("digest")).alias("sha256"))
    other = docs.filter(n % 17 != 0).withColumns({"digest": F.when(n % 13 == 1, "x").otherwise(F.col("digest")), "n_chars": F.when((n % 13).isin(1, 2), F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return delivery.verify_index(index, files, other, ["digest", "n_chars", "lang"], {"image_path": "digest"})


@query("q112_reference_order", """WITH c AS (SELECT conv_id, list(md5(text) ORDER BY turn) AS names FROM conversations GROUP BY 1)
    SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'invalid' WHEN 2 THEN CASE WHEN list_reverse(names) <> names THEN 'order' END END AS problem FROM c""")
def reference_order(spark, d):
    s = F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("name"))))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(s.alias("s")).withColumn("names", F.transform("s", lambda x: x["name"]))
    n = F.col("conv_id") % 4
    refs = F.when(n == 1, "[not json").when(n == 2, F.to_json(F.reverse("names"))).when(n == 3, F.to_json("names"))
    return c.select("conv_id", delivery.order_problem(refs, F.col("names")).alias("problem"))


@query("q113_embedded_images", """WITH u AS (SELECT DISTINCT text FROM conversations), c AS (SELECT conv_id, list(md5(c.text) ORDER BY turn) AS refs, bool_and(length(c.text) % 9 <> 0) AS whole, string_agg(md5(c.text) || ':' || length(c.text), ',' ORDER BY turn) AS embedded FROM conversations c GROUP BY 1)
    SELECT conv_id, CASE WHEN whole THEN embedded END AS embedded FROM c""")
def embedded_images(spark, d):
    c = table(spark, d, "conversations")
    rows = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("name")))), lambda x: x["name"]).alias("refs"))
    images = c.filter(F.length("text") % 9 != 0).select(F.md5("text").alias("name"), F.col("text").alias("content")).dropDuplicates(["name"])
    shown = F.transform("embedded", lambda x: F.concat_ws(":", x["name"], F.length(x["content"]).cast("string")))
    return delivery.rebuilt(rows, images, "conv_id", "refs").select("conv_id", F.array_join(shown, ",").alias("embedded"))


@query("q114_substituted_paths", """SELECT conv_id, string_agg(CASE WHEN turn % 3 <> 1 THEN 'assets/' || left(md5(text), 6) ELSE md5(text) END, ',' ORDER BY turn) AS paths FROM (SELECT conv_id, turn, text FROM conversations) GROUP BY 1""")
def substituted_paths(spark, d):
    ref = F.concat_ws("#", "conv_id", "turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", ref.alias("ref"), F.md5("text").alias("name"))
    rows = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 3 != 1, F.col("ref")).otherwise(F.col("name")).alias("r")))), lambda x: x["r"]).alias("paths"))
    assets = c.filter("turn % 3 <> 1").select(F.col("ref").alias("image_ref"), F.concat(F.lit("assets/"), F.left("name", F.lit(6))).alias("asset_path"))
    return delivery.substitute_paths(rows, assets, "conv_id", "paths").select("conv_id", F.array_join("paths", ",").alias("paths"))


@query("q115_manifest_warnings", """SELECT o_custkey AS run, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'rows disagree: ' || count(DISTINCT o_orderstatus) ELSE 'recorded as ' || min(o_orderstatus) END AS warning
    FROM orders WHERE length(o_orderstatus) > 0 GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 OR min(o_orderstatus) <> 'F'""")
def manifest_warnings(spark, d):
    """A customer's orders as the rows of a run."""
    return delivery.manifest_warning(table(spark, d, "orders"), "F", "o_orderstatus", ["o_custkey"]).withColumnRenamed("o_custkey", "run")
