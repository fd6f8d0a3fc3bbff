"""Label and token queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from .fixtures import table
from .registry import query

STOP = ", ".join(f"'{w}'" for w in labels.STOPWORDS)


def _norm_sql(x: str) -> str:
    a = f"regexp_replace(regexp_replace(trim(lower({x})), '^[\"''`]+|[\"''`]+$', '', 'g'), '^(a|an|the)\\s+', '')"
    b = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({a}, '[_-]', ' ', 'g'), '\\s+', ' ', 'g'), '[^a-z0-9 /]+', '', 'g'), '^[ /]+|[ /]+$', '', 'g')"
    return f"trim(split_part({b}, '/', 1))"


RAW_SQL = "CASE p_partkey % 4 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN '\"' || p_type || '/x\"' WHEN 2 THEN ' A_' || p_brand || '-thing ' ELSE 'walls' END"


@query("q35_label_normalise", f"WITH n AS (SELECT p_partkey, {_norm_sql(RAW_SQL)} AS x FROM part) SELECT p_partkey, CASE WHEN x IN ({STOP}) THEN '' ELSE x END AS label FROM n")
def label_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", labels.normalise(_raw()).alias("label"))


def _raw():
    k = F.col("p_partkey") % 4
    return F.when(k == 0, F.concat(F.lit("The "), "p_name")).when(k == 1, F.concat(F.lit('"'), "p_type", F.lit('/x"'))).when(k == 2, F.concat(F.lit(" A_"), "p_brand", F.lit("-thing "))).otherwise("walls")


@query(
    "q37_index_parse",
    """WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'g' || c_custkey WHEN 1 THEN 'pick G # ' || (c_custkey % 50) WHEN 2 THEN ' ' || (c_custkey % 30) || ' ' ELSE c_name END AS raw FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey < 40 THEN c_custkey WHEN c_custkey % 4 = 1 AND c_custkey % 50 < 40 THEN c_custkey % 50 WHEN c_custkey % 4 = 2 AND c_custkey % 30 < 40 THEN c_custkey % 30 END::INT AS idx FROM t""",
)
def index_parse(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("g"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("pick G # "), (k % 50).cast("string"))).when(k % 4 == 2, F.concat(F.lit(" "), (k % 30).cast("string"), F.lit(" "))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", labels.parse_index(raw, "G", F.lit(40)).alias("idx"))


@query(
    "q75_token_filters",
    """SELECT p_partkey, contains(p_name, ' ') AS has_space, p_partkey % 8 = 3 AS in_shard, list_has_any(string_split(p_type, ' '), ['STEEL', 'BRASS']) AS metal, left(regexp_replace(p_name, '\\s+', ' ', 'g'), 12) AS short FROM part""",
)
def token_filters(spark, d):
    metal = F.arrays_overlap(F.split("p_type", " "), F.array(F.lit("STEEL"), F.lit("BRASS")))
    return table(spark, d, "part").select("p_partkey", F.contains("p_name", F.lit(" ")).alias("has_space"), (F.pmod("p_partkey", F.lit(8)) == 3).alias("in_shard"), metal.alias("metal"), F.left(F.regexp_replace("p_name", r"\s+", " "), F.lit(12)).alias("short"))


@query(
    "q87_nested_label_choice",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ',k' WHEN event_id % 3 = 1 THEN event_type ELSE 'k' END AS labels FROM events""",
)
def nested_label_choice(spark, d):
    n = F.col("event_id") % 3
    target = F.when(n == 0, F.array("event_type", F.lit("k"), "event_type"))
    step = F.when(n == 1, F.array(F.lit("The wall"), "event_type"))
    names = F.json_object_keys("props")
    return table(spark, d, "events").select("event_id", F.array_join(labels.distinct_labels(F.coalesce(target, step, names), 20), ",").alias("labels"))
