"""Contract queries: key joins, duplicates, coverage, rules and their precedence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rules
from ..operators.contain import contained
from ..operators.rules import Rule
from .fixtures import STEPS_SQL, step_records, table
from .registry import query


@query("q11_missing_keys", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("q12_unexpected_keys", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unexpected_keys(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "q13_id_set_diff",
    """WITH a AS (SELECT DISTINCT doc_id FROM documents WHERE lang <> 'fr'), b AS (SELECT DISTINCT doc_id FROM labels)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left' ELSE 'right' END AS side
    FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""",
)
def id_set_diff(spark, d):
    return rules.key_difference(table(spark, d, "documents").filter("lang <> 'fr'"), table(spark, d, "labels"), "doc_id")


@query("q14_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS first_at FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return rules.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query(
    "q15_step_contiguity",
    """SELECT conv_id, count(*) AS steps, list(turn ORDER BY turn) = range(0, count(*)::BIGINT)::INT[] AS contiguous FROM conversations GROUP BY 1""",
)
def step_contiguity(spark, d):
    # without repeats, turns are 0 .. n-1 exactly if the least is 0 and the largest n - 1
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("steps"), F.min("turn").alias("a"), F.max("turn").alias("b"), F.collect_set("turn").alias("s"))
    return g.select("conv_id", "steps", ((F.col("a") == 0) & (F.col("b") == F.col("steps") - 1) & (F.size("s") == F.col("steps"))).alias("contiguous"))


@query(
    "q16_rule_violations",
    """SELECT event_id, 'value_range' AS rule FROM events WHERE NOT (value BETWEEN 10 AND 90)
    UNION ALL SELECT event_id, 'known_type' FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')
    UNION ALL SELECT event_id, 'props_key' FROM events WHERE NOT coalesce(json_extract_string(props, '$.k')::BIGINT < 90, false)
    UNION ALL SELECT event_id, 'props_pattern' FROM events WHERE NOT regexp_matches(props, '^[{]"k": [0-9]+[}]$')""",
)
def rule_violations(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    checks = [
        Rule("value_range", F.col("value").between(10, 90)),
        Rule("known_type", F.col("event_type").isin("click", "view", "purchase")),
        Rule("props_key", k < 90),
        Rule("props_pattern", F.col("props").rlike('^[{]"k": [0-9]+[}]$')),
    ]
    return rules.violations(table(spark, d, "events"), ["event_id"], checks).select("event_id", "rule")


PRECEDENCE = """bad AS (SELECT 1 AS priority, id, 'odd_step' AS rule FROM steps WHERE NOT step < 7 UNION ALL SELECT 0, id, 'matched_bound' FROM steps WHERE NOT num_matched < 4
    UNION ALL SELECT 2, id, 'unit' FROM steps WHERE action_unit <> 'm')"""


@query("q17_error_precedence", f"WITH {STEPS_SQL}, {PRECEDENCE} SELECT priority, id, rule FROM bad ORDER BY priority, id, rule LIMIT 1")
def error_precedence(spark, d):
    checks = [Rule("odd_step", F.expr("step < 7"), 1), Rule("matched_bound", F.expr("num_matched < 4"), 0), Rule("unit", F.expr("action_unit = 'm'"), 2)]
    return rules.first_violation(rules.violations(step_records(spark, d), ["id"], checks), ["id"]).select("priority", "id", "rule")


@query("q18_single_value_check", "SELECT source, count(DISTINCT lang) AS langs, count(*) FILTER (lang IS NULL) AS nulls, count(DISTINCT lang) = 1 AND count(*) FILTER (lang IS NULL) = 0 AS single FROM documents GROUP BY 1")
def single_value_check(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.count_if(F.col("lang").isNull()).alias("nulls"))
    return g.withColumn("single", (F.col("langs") == 1) & (F.col("nulls") == 0))


@query(
    "q19_safe_id_and_path",
    """SELECT page_id, regexp_matches(replace(url, '/', '.'), '^[A-Za-z0-9][A-Za-z0-9._:-]*$') AS safe_id, NOT list_contains(string_split(url, '/'), '..') AND NOT starts_with(url, '/') AS safe_path FROM pages
    UNION ALL SELECT c_custkey, regexp_matches(c_name, '^[A-Za-z0-9][A-Za-z0-9._:-]*$'), NOT list_contains(string_split(c_name, '/'), '..') AND NOT starts_with(c_name, '/') FROM customer""",
)
def safe_id_and_path(spark, d):
    def checked(df, key, text, name):
        safe = name.rlike("^[A-Za-z0-9][A-Za-z0-9._:-]*$")
        return df.select(F.col(key).alias("page_id"), safe.alias("safe_id"), (~F.array_contains(F.split(text, "/"), "..") & ~text.startswith("/")).alias("safe_path"))

    url, name = F.col("url"), F.col("c_name")
    pages = checked(table(spark, d, "pages"), "page_id", url, F.translate(url, "/", "."))
    return pages.union(checked(table(spark, d, "customer"), "c_custkey", name, name))


@query("q20_content_leakage", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def content_leakage(spark, d):
    """Containment through an equi-join on the rarest run of words of each item."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    return contained(table(spark, d, "documents").select("doc_id", "text"), items)


@query(
    "q21_enrich_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus, coalesce(c_name, 'unknown') AS c_name, coalesce(n_name, 'unknown') AS n_name
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def enrich_join(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customer = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey")
    j = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    j = j.join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderstatus", F.coalesce("c_name", F.lit("unknown")).alias("c_name"), F.coalesce("n_name", F.lit("unknown")).alias("n_name"))


@query(
    "q22_attribute_diff",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 15 = 0 THEN 'o_totalprice,o_orderstatus' WHEN o_orderkey % 10 = 0 THEN 'o_totalprice' ELSE 'o_orderstatus' END AS differing
    FROM orders WHERE (o_orderkey % 10 = 0) OR (o_orderkey % 15 = 0 AND o_orderstatus IS NOT NULL)""",
)
def attribute_diff(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    price = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") * (1 + 1e-12))
    status = F.when(F.col("o_orderkey") % 15 != 0, F.col("o_orderstatus"))
    other = orders.select("o_orderkey", price.alias("o_totalprice"), status.alias("o_orderstatus"))
    diff = rules.attribute_diff(orders, other, "o_orderkey", ["o_totalprice", "o_orderstatus"], 1e-9, 1e-9)
    return diff.select("o_orderkey", F.array_join("columns", ",").alias("differing"))


@query(
    "q23_coverage_check",
    """SELECT s_suppkey, count(l_orderkey) AS used, count(l_orderkey) > 0 AS covered FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 45 GROUP BY 1""",
)
def coverage_check(spark, d):
    used = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy("l_suppkey").agg(F.count("*").alias("used"))
    j = table(spark, d, "supplier").select("s_suppkey").join(used, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    n = F.coalesce("used", F.lit(0))
    return j.select("s_suppkey", n.alias("used"), (n > 0).alias("covered"))


@query(
    "q25_ordered_equality",
    """WITH l AS (SELECT conv_id, list(role ORDER BY turn) AS a, list(role ORDER BY turn DESC) AS b FROM conversations GROUP BY 1)
    SELECT conv_id, a = b AS same_order, list_sort(a) = list_sort(b) AS same_set FROM l""",
)
def ordered_equality(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("s"))
    a = F.transform("s", lambda x: x["role"])
    return g.select("conv_id", (a == F.reverse(a)).alias("same_order"), (F.array_sort(a) == F.array_sort(F.reverse(a))).alias("same_set"))


@query("q26_dataset_subset", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'es')")
def dataset_subset(spark, d):
    return table(spark, d, "documents").filter(F.col("lang").isin("de", "es")).select("doc_id", "lang", "source")


@query(
    "q66_content_hash_duplicates",
    "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def content_hash_duplicates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(
    "q67_canonical_line_hash",
    """SELECT sha256(string_agg('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}', chr(10) ORDER BY r_regionkey) || chr(10)) AS digest, count(*) AS n FROM region""",
)
def canonical_line_hash(spark, d):
    from ..sources.jsonl import canonical_line

    lines = table(spark, d, "region").select("r_regionkey", canonical_line(["r_regionkey", "r_name"]).alias("line"))
    one = lines.agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "line"))).alias("s"), F.count("*").alias("n"))
    text = F.concat(F.array_join(F.transform("s", lambda x: x["line"]), "\n"), F.lit("\n"))
    return one.select(F.sha2(text.cast("binary"), 256).alias("digest"), "n")


@query(
    "q69_identity_conflicts",
    "SELECT user_id, count(DISTINCT event_type) AS kinds, count(DISTINCT value) AS vals FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1",
)
def identity_conflicts(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.countDistinct("value").alias("vals")).filter("kinds > 1")


@query(
    "q83_problem_report",
    """WITH m AS (SELECT o_orderpriority AS dataset, o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)),
    r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM m)
    SELECT dataset, n AS problems, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (k <= 5) || CASE WHEN n > 5 THEN ' +' || (n - 5) || ' more' ELSE '' END AS examples FROM r GROUP BY dataset, n""",
)
def problem_report(spark, d):
    lost = missing_keys(spark, d).join(table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("dataset")), "o_orderkey")
    # the rank filter is pushed before the shuffle; only five ids a group are ever collected
    w = Window.partitionBy("dataset").orderBy("o_orderkey")
    top = lost.withColumn("k", F.row_number().over(w)).filter("k <= 5").groupBy("dataset").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("shown"))
    count = lost.groupBy("dataset").agg(F.count("*").alias("problems"))
    more = F.when(F.col("problems") > 5, F.concat(F.lit(" +"), (F.col("problems") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return count.join(top, "dataset").select("dataset", "problems", F.concat("shown", more).alias("examples"))


@query(
    "q85_set_algebra",
    """WITH a AS (SELECT DISTINCT p_size AS k FROM part WHERE p_size % 2 = 0), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
    SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
    UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""",
)
def set_algebra(spark, d):
    a = table(spark, d, "part").filter("p_size % 2 = 0").select(F.col("p_size").alias("k")).distinct()
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    # one pass over both sides gives all three sets
    both = a.withColumn("side", F.lit(1)).union(b.withColumn("side", F.lit(2))).groupBy("k").agg(F.sum("side").alias("m"))
    ops = F.array_compact(F.array(F.lit("union"), F.when(F.col("m") == 3, "intersect"), F.when(F.col("m") == 1, "except")))
    return both.select(F.explode(ops).alias("op"), "k")


@query(
    "q93_integrity_verify",
    """SELECT doc_id, sha256(text) = sha256(trim(text)) AS hash_ok, n_chars = length(text) AS size_ok, CASE WHEN n_chars <> length(text) THEN 'size' WHEN sha256(text) <> sha256(trim(text)) THEN 'hash' END AS first_problem FROM documents""",
)
def integrity_verify(spark, d):
    docs = table(spark, d, "documents")

    def digest(c):
        return F.sha2(c.cast("binary"), 256)

    hash_ok, size_ok = digest(F.col("text")) == digest(F.trim("text")), F.col("n_chars") == F.length("text")
    return docs.select("doc_id", hash_ok.alias("hash_ok"), size_ok.alias("size_ok"), F.when(~size_ok, "size").when(~hash_ok, "hash").alias("first_problem"))
