"""Score queries: step scores, folds, summaries and leaderboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scores import object_components
from ..operators import fold, rules
from ..operators.order import radix_quantiles
from .fixtures import STEPS_SQL, step_records, table
from .registry import query, r9

W = f"WITH {STEPS_SQL}"
KEYS = ("l_orderkey", "case_id")


@query("q01_step_score", f"{W} SELECT id, round(score, 9) AS score FROM scored")
def step_score(spark, d):
    return fold.with_action_score(step_records(spark, d)).select("id", r9("score").alias("score"))


@query("q02_case_score", f"{W} SELECT case_id, subtype, round(avg(score), 9) AS case_score, count(*) AS num_steps FROM scored GROUP BY ALL")
def case_score(spark, d):
    return fold.case_scores(step_records(spark, d), KEYS).select("case_id", "subtype", r9("case_score").alias("case_score"), "num_steps")


@query(
    "q03_macro_score",
    f"""{W}, cases AS (SELECT case_id, subtype, avg(score) AS s, count(*) AS k FROM scored GROUP BY ALL),
    kind AS (SELECT subtype, avg(s) AS s, count(*) AS n, sum(k) AS k FROM cases GROUP BY 1),
    one AS (SELECT max(s) FILTER (subtype = 'atomic') AS a, max(s) FILTER (subtype = 'chain') AS c, max(s) FILTER (subtype = 'cycle') AS y,
      coalesce(max(n) FILTER (subtype = 'atomic'), 0) AS na, coalesce(max(n) FILTER (subtype = 'chain'), 0) AS nc, coalesce(max(n) FILTER (subtype = 'cycle'), 0) AS ny, sum(n) AS n, sum(k) AS k FROM kind)
    SELECT round((a + c + y) / 3, 9) AS cmg, round(a, 9) AS cmg_atomic, round(c, 9) AS cmg_chain, round(y, 9) AS cmg_cycle,
      na::BIGINT AS num_atomic_cases, nc::BIGINT AS num_chain_cases, ny::BIGINT AS num_cycle_cases, n::BIGINT AS num_valid_cases, k::BIGINT AS num_valid_steps FROM one""",
)
def macro_score(spark, d):
    one = fold.macro_score(step_records(spark, d), KEYS)
    return one.select(*(r9(c).alias(c) if c.startswith("cmg") else F.col(c) for c in one.columns))


@query("q04_object_step_components", f"{W} SELECT id, round(recall, 9) AS recall, round(f1, 9) AS f1, round(spatial, 9) AS spatial, round(integrity, 9) AS integrity, round((f1 + spatial + integrity) / 3, 9) AS ssp_step FROM components")
def object_step_components(spark, d):
    valid = fold.mask_invalid_cases(step_records(spark, d), "l_orderkey")
    c = object_components(*(F.col(x) for x in ("num_gt_objects", "num_pred_all", "num_matched", "center_error_norm", "object_integrity", "relative_topology")))
    return valid.select("id", *(r9(v).alias(k) for k, v in c.items()))


@query("q05_case_mean_plus_worst", f"{W} SELECT case_id, subtype, round((avg(f1) + min(f1)) / 2, 9) AS f1, round((avg(spatial) + min(spatial)) / 2, 9) AS spatial, round((avg(integrity) + min(integrity)) / 2, 9) AS integrity FROM components GROUP BY ALL")
def case_mean_plus_worst(spark, d):
    cases = fold.case_pillars(step_records(spark, d), KEYS)
    return cases.select("case_id", "subtype", *(r9(p).alias(p) for p in fold.PILLARS))


PILLARS_SQL = """cp AS (SELECT case_id, subtype, (avg(f1) + min(f1)) / 2 AS f1, (avg(spatial) + min(spatial)) / 2 AS spatial, (avg(integrity) + min(integrity)) / 2 AS integrity FROM components GROUP BY ALL),
    kp AS (SELECT subtype, count(*) AS num_cases, avg(f1) AS f1, avg(spatial) AS spatial, avg(integrity) AS integrity FROM cp GROUP BY 1)"""


@query("q06_masked_pillar_fold", f"{W}, {PILLARS_SQL} SELECT subtype, num_cases, round(f1, 9) AS f1, round(spatial, 9) AS spatial, round(integrity, 9) AS integrity, round((f1 + spatial + integrity) / 3, 9) AS ssp FROM kp")
def masked_pillar_fold(spark, d):
    return fold.pillar_fold(step_records(spark, d), KEYS).select("subtype", "num_cases", *(r9(c).alias(c) for c in (*fold.PILLARS, "ssp")))


@query("q07_invalid_cases", f"{W} SELECT case_id, count(*) AS bad_steps FROM steps WHERE num_gt_objects <= 0 GROUP BY 1")
def invalid_cases(spark, d):
    return fold.invalid_cases(step_records(spark, d))


@query(
    "q08_overall_result",
    f"""{W}, {PILLARS_SQL}, ca AS (SELECT case_id, subtype, avg(score) AS s FROM scored GROUP BY ALL),
    a AS (SELECT avg(s) AS cmg FROM (SELECT subtype, avg(s) AS s FROM ca GROUP BY 1)), b AS (SELECT avg((f1 + spatial + integrity) / 3) AS ssp FROM kp)
    SELECT round(cmg, 9) AS cmg, round(ssp, 9) AS ssp, round((cmg + ssp) / 2, 9) AS overall, cmg BETWEEN 0 AND 1 AND ssp BETWEEN 0 AND 1 AS in_range FROM a, b""",
)
def overall_result(spark, d):
    one = fold.overall(step_records(spark, d), KEYS)
    return one.select(r9("cmg").alias("cmg"), r9("ssp").alias("ssp"), r9((F.col("cmg") + F.col("ssp")) / 2).alias("overall"), (F.col("cmg").between(0, 1) & F.col("ssp").between(0, 1)).alias("in_range"))


@query(
    "q09_count_bounds_violations",
    f"""{W}, m AS (SELECT id, num_gt_objects AS g, num_pred_all - 3 AS p, num_matched AS m FROM steps)
    SELECT id, 'matched_over_gt' AS rule FROM m WHERE NOT m <= g UNION ALL SELECT id, 'matched_over_pred' FROM m WHERE NOT m <= p
    UNION ALL SELECT id, 'no_gt' FROM m WHERE NOT g > 0 UNION ALL SELECT id, 'negative_pred' FROM m WHERE NOT p >= 0""",
)
def count_bounds_violations(spark, d):
    m = step_records(spark, d).select("id", F.col("num_gt_objects").alias("g"), (F.col("num_pred_all") - 3).alias("p"), F.col("num_matched").alias("m"))
    found = rules.violations(m, ["id"], [rules.Rule("matched_over_gt", F.expr("m <= g")), rules.Rule("matched_over_pred", F.expr("m <= p")), rules.Rule("no_gt", F.expr("g > 0")), rules.Rule("negative_pred", F.expr("p >= 0"))])
    return found.select("id", "rule")


@query("q10_case_frequency_by_subtype", f"{W} SELECT subtype, count(*) AS num_steps, count(DISTINCT case_id) AS num_cases FROM steps GROUP BY 1")
def case_frequency(spark, d):
    per_case = step_records(spark, d).groupBy("l_orderkey", "subtype").agg(F.count("*").alias("k"))
    return per_case.groupBy("subtype").agg(F.sum("k").alias("num_steps"), F.count("*").alias("num_cases"))


@query(
    "q53_wide_mean_summary",
    f"{W} SELECT count(*) AS n, "
    + ", ".join(f"round(avg({c}), 9) AS {c}_mean, round(median({c}), 9) AS {c}_median, round(min({c}), 9) AS {c}_min, round(max({c}), 9) AS {c}_max" for c in ("action_expected", "action_abs_err", "center_error_norm", "object_integrity"))
    + " FROM steps",
)
def wide_mean_summary(spark, d):
    cols = ["action_expected", "action_abs_err", "center_error_norm", "object_integrity"]
    s = fold.summary(step_records(spark, d), cols, direct=fold.is_small(spark, f"{d}/lineitem.parquet"))
    return s.select(F.col("action_expected_count").alias("n"), *(r9(f"{c}_{k}").alias(f"{c}_{k}") for c in cols for k in ("mean", "median", "min", "max")))


WIDE = ("l_quantity", "l_extendedprice", "l_discount")
PLACES = (0.05, 0.5, 0.98)


@query(
    "q123_radix_quantiles",
    "SELECT l_returnflag AS kind, "
    + ", ".join(f"round(quantile_cont({c}, {p}::DOUBLE), 6) AS {c}_{round(100 * p)}" for c in WIDE for p in PLACES)
    + " FROM lineitem GROUP BY 1 UNION ALL SELECT NULL, "
    + ", ".join(f"round(quantile_cont({c} * (l_linenumber - 3), {p}::DOUBLE), 6)" for c in WIDE for p in PLACES)
    + " FROM lineitem",
)
def radix_places(spark, d):
    """The way of large tables: quantiles of all columns by histograms of digits, in groups and (with signs) over all rows."""
    line = table(spark, d, "lineitem")

    def wide(found, *by):
        return found.groupBy(*by).agg(*(F.round(F.max(F.when((F.col("column") == c) & (F.col("p") == p), F.col("quantile"))), 6).alias(f"{c}_{round(100 * p)}") for c in WIDE for p in PLACES))

    grouped = wide(radix_quantiles(line.withColumnRenamed("l_returnflag", "kind"), list(WIDE), list(PLACES), ["kind"]), "kind")
    signed = line.select(*((F.col(c) * (F.col("l_linenumber") - 3)).alias(c) for c in WIDE))
    return grouped.union(wide(radix_quantiles(signed, list(WIDE), list(PLACES))).select(F.lit(None).cast("string").alias("kind"), "*"))


MODELS_SQL = f"""{W}, m AS (SELECT c_mktsegment AS model, s.* FROM scored s JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
    mc AS (SELECT model, subtype, case_id, avg(score) AS s FROM m GROUP BY ALL), mk AS (SELECT model, subtype, avg(s) AS s, count(*) AS n FROM mc GROUP BY ALL),
    mm AS (SELECT model, round(avg(s), 9) AS cmg, sum(n)::BIGINT AS num_cases FROM mk GROUP BY 1)"""


def _by_model(spark, d):
    steps = fold.with_action_score(step_records(spark, d))
    cases = steps.groupBy("l_orderkey", "subtype").agg(F.avg("score").alias("s"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("model"))
    named = cases.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    kinds = named.groupBy("model", "subtype").agg(F.avg("s").alias("s"), F.count("*").alias("n"))
    return kinds.groupBy("model").agg(r9(F.avg("s")).alias("cmg"), F.sum("n").alias("num_cases"))


@query("q54_group_model_summary", f"{MODELS_SQL} SELECT * FROM mm")
def group_model_summary(spark, d):
    return _by_model(spark, d)


@query("q70_ranked_leaderboard", f"{MODELS_SQL} SELECT model, cmg, rank() OVER (ORDER BY cmg DESC)::INT AS place FROM mm")
def ranked_leaderboard(spark, d):
    # one row per model: the ranking is over a handful of rows
    return _by_model(spark, d).select("model", "cmg", F.rank().over(Window.orderBy(F.desc("cmg"))).alias("place"))
