"""Step queries: explode and lag, picks, caps, ordering, shapes and paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels
from ..operators.fold import is_small, quantiles
from ..sources.jsonl import parse_lines
from .fixtures import STEPS_SQL, step_records, table
from .registry import query, r9


@query(
    "q24_positional_zip",
    """WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(length(text) ORDER BY turn) AS sizes FROM conversations GROUP BY 1),
    z AS (SELECT conv_id, roles, sizes, unnest(range(1, len(roles) + 1)) AS i FROM t)
    SELECT conv_id, (i - 1)::INT AS pos, roles[i] AS role, sizes[i]::INT AS size, len(roles) = len(sizes) AS same_length FROM z""",
)
def positional_zip(spark, d):
    s = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("size"))))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(s.alias("s"))
    g = g.select("conv_id", F.transform("s", lambda x: x["role"]).alias("roles"), F.transform("s", lambda x: x["size"]).alias("sizes"))
    same = F.size("roles") == F.size("sizes")
    return g.select("conv_id", same.alias("same_length"), F.posexplode(F.arrays_zip("roles", "sizes")).alias("pos", "z")).select("conv_id", "pos", F.col("z.roles").alias("role"), F.col("z.sizes").alias("size"), "same_length")


@query(
    "q27_explode_steps_with_lag",
    """SELECT conv_id || '__step' || (turn + 1) AS id, (turn + 1)::INT AS step, lag(md5(text)) OVER w AS current_view, coalesce(lag(CASE WHEN role = 'assistant' THEN md5(text) END) OVER w, md5('input')) AS generated_view
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def explode_steps_with_lag(spark, d):
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = F.when(F.col("role") == "assistant", F.md5("text"))
    step = (F.col("turn") + 1).cast("int")
    return c.select(F.concat(F.col("conv_id").cast("string"), F.lit("__step"), step.cast("string")).alias("id"), step.alias("step"), F.lag(F.md5("text")).over(w).alias("current_view"), F.coalesce(F.lag(own).over(w), F.md5(F.lit("input"))).alias("generated_view"))


@query(
    "q28_interface_type",
    f"""WITH {STEPS_SQL}, k AS (SELECT id, CASE step % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'Image-Editing' WHEN 2 THEN 'world_model' WHEN 3 THEN ' pose_conditioned ' ELSE 'audio' END AS raw, num_matched AS views FROM steps),
    m AS (SELECT *, CASE lower(trim(raw)) WHEN 'image' THEN 'image' WHEN 'image-editing' THEN 'image' WHEN 'world_model' THEN 'world-model' WHEN 'pose_conditioned' THEN 'pose-conditioned' END AS model_type FROM k)
    SELECT id, model_type, CASE WHEN model_type IS NULL THEN NULL WHEN model_type = 'pose-conditioned' THEN 'pose-conditioned' WHEN model_type = 'world-model' THEN 'autoregressive-rollout' WHEN views > 1 THEN 'multi-image-editing' ELSE 'image-editing' END AS interface_type FROM m""",
)
def interface_type(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("image", "Image-Editing", "world_model", " pose_conditioned ", "audio"))), F.col("step") % 5 + 1)
    s = step_records(spark, d).select("id", labels.model_type(raw).alias("model_type"), "num_matched")
    return s.select("id", "model_type", F.when(F.col("model_type").isNotNull(), labels.interface_type(F.col("model_type"), F.col("num_matched"))).alias("interface_type"))


@query(
    "q29_input_ids",
    """SELECT conv_id, turn, 'c' || conv_id || CASE WHEN turn = 0 THEN ':input:1' ELSE ':generated:step' || turn END
       || coalesce(',' || list_aggregate(list_transform(range(2, (turn % 4) + 1), lambda x: 'c' || conv_id || ':input:' || x), 'string_agg', ','), '') AS ids FROM conversations""",
)
def input_ids(spark, d):
    case = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    ids = labels.input_ids(case, F.col("turn") + 1, (F.col("turn") % 4).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(ids, ",").alias("ids"))


@query(
    "q30_frame_pick",
    """WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, max(event_id) FILTER (i = n - 1) AS last_id, max(event_id) FILTER (i = n - 2) AS second_last_id, max(event_id) FILTER (i = round_even(0.5::DOUBLE * (n - 1), 0)::BIGINT) AS middle_id FROM f GROUP BY 1""",
)
def frame_pick(spark, d):
    w = Window.partitionBy("user_id")
    f = table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w.orderBy("ts")) - 1).alias("i"), F.count("*").over(w).alias("n"))

    def at(place):
        return F.max(F.when(F.col("i") == place, F.col("event_id")))

    return f.groupBy("user_id").agg(at(F.col("n") - 1).alias("last_id"), at(F.col("n") - 2).alias("second_last_id"), at(F.bround(F.lit(0.5) * (F.col("n") - 1), 0).cast("bigint")).alias("middle_id"))


@query(
    "q32_path_rewrite_and_token",
    """SELECT page_id, CASE WHEN starts_with(url, 'https://a') THEN '/mnt/a' || substr(url, 10) WHEN starts_with(url, 'https://') THEN '/mnt/' || substr(url, 9) ELSE url END AS rewritten,
    regexp_extract('${ROOT}/' || url, '^\\$\\{([A-Z_]+)\\}/', 1) AS token, TRY_CAST(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS BIGINT) AS frame FROM pages""",
)
def path_rewrite_and_token(spark, d):
    url = F.col("url")
    rewritten = F.when(url.startswith("https://a"), F.concat(F.lit("/mnt/a"), F.substr(url, F.lit(10)))).when(url.startswith("https://"), F.concat(F.lit("/mnt/"), F.substr(url, F.lit(9)))).otherwise(url)
    token = F.regexp_extract(F.concat(F.lit("${ROOT}/"), url), r"^\$\{([A-Z_]+)\}/", 1)
    return table(spark, d, "pages").select("page_id", rewritten.alias("rewritten"), token.alias("token"), F.nullif(F.regexp_extract(url, "([0-9]+)", 1), F.lit("")).try_cast("bigint").alias("frame"))


@query("q33_asset_id", "SELECT page_id, substr(sha256(url), 1, 24) AS asset_id FROM pages")
def asset_id(spark, d):
    return table(spark, d, "pages").select("page_id", F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 24).alias("asset_id"))


@query(
    "q34_coalesce_shapes",
    """SELECT event_id, coalesce(json_extract_string(props, '$.path'), json_extract_string(props, '$.item.path'), nullif(json_extract_string(props, '$.k'), '5'), event_type) AS path FROM events""",
)
def coalesce_shapes(spark, d):
    def at(p):
        return F.get_json_object("props", p)

    return table(spark, d, "events").select("event_id", F.coalesce(at("$.path"), at("$.item.path"), F.nullif(at("$.k"), F.lit("5")), "event_type").alias("path"))


@query("q45_outlier_clip_p98", "SELECT e.event_id, CASE WHEN value > q THEN 0.0::DOUBLE ELSE value END AS clipped FROM events e JOIN (SELECT user_id, quantile_cont(value, 0.98::DOUBLE) AS q FROM events WHERE value > 0 GROUP BY 1) USING (user_id)")
def outlier_clip(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    # a hot user's values are never held by one task
    q = quantiles(e.filter("value > 0"), ["value"], 0.98, ["user_id"], is_small(spark, f"{d}/events.parquet")).select("user_id", F.col("quantile").alias("q"))
    return e.join(q, "user_id").select("event_id", F.when(F.col("value") > F.col("q"), 0.0).otherwise(F.col("value")).alias("clipped"))


@query(
    "q65_tolerant_json",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 4 <> 3 AS parsed FROM events WHERE event_id % 4 <> 3
    UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 4 = 3""",
)
def tolerant_json(spark, d):
    from ..functions.json import tolerant_object

    fenced = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```"))
    comma = F.concat(F.substr("props", F.lit(1), F.length("props") - 1), F.lit(",}"))
    raw = F.when(F.col("event_id") % 4 == 0, fenced).when(F.col("event_id") % 4 == 1, comma).when(F.col("event_id") % 4 == 2, F.col("props")).otherwise(F.lit("no object here"))
    v = table(spark, d, "events").select("event_id", tolerant_object(raw).alias("v"))
    return v.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.col("v").isNotNull().alias("parsed"))


@query(
    "q68_plan_fanout",
    """WITH p AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'a' WHEN page_id % 3 = 1 THEN 'b' ELSE 'c' END AS dataset, page_id // 5 AS scene FROM pages)
    SELECT DISTINCT dataset, scene || '/' || f AS path FROM p, unnest(CASE dataset WHEN 'a' THEN ['rgb.zip', 'depth.zip'] WHEN 'b' THEN ['scene.sens'] ELSE ['pose.txt', 'depth.png', 'meta.json'] END) AS u(f)""",
)
def plan_fanout(spark, d):
    k = F.col("page_id") % 3
    p = table(spark, d, "pages").select(F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("dataset"), F.floor(F.col("page_id") / 5).alias("scene"))

    def names(*xs):
        return F.array(*map(F.lit, xs))

    files = F.when(F.col("dataset") == "a", names("rgb.zip", "depth.zip")).when(F.col("dataset") == "b", names("scene.sens")).otherwise(names("pose.txt", "depth.png", "meta.json"))
    return p.distinct().select("dataset", F.explode(F.transform(files, lambda f: F.concat(F.col("scene").cast("string"), F.lit("/"), f))).alias("path"))


@query(
    "q71_line_scan_with_quarantine",
    """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, true AS good FROM events WHERE event_id % 10 >= 2 UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 10 = 0""",
)
def line_scan(spark, d):
    n = F.col("event_id") % 10
    line = F.when(n == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(n == 1, "  ").otherwise(F.col("props"))
    good, bad = parse_lines(table(spark, d, "events").select("event_id", line.alias("line")), "k bigint")
    return good.select("event_id", "k", F.lit(True).alias("good")).union(bad.select("event_id", F.lit(None).cast("bigint"), F.lit(False)))


@query(
    "q72_listing_to_expected_steps",
    """WITH files AS (SELECT 'case' || (page_id // 4) || '/step' || (page_id % 4) || CASE WHEN page_id % 3 = 0 THEN '.png' WHEN page_id % 3 = 1 THEN '.JPG' ELSE '.txt' END AS path FROM pages),
    found AS (SELECT regexp_extract(path, '^(.*)/step', 1) AS case_id, regexp_extract(path, '/step_?0*([0-9]+)', 1)::INT AS step FROM files WHERE regexp_matches(path, '(?i)[.](png|jpg|jpeg|webp)$')),
    expected AS (SELECT DISTINCT 'case' || (page_id // 4) AS case_id, s::INT AS step FROM pages, range(0, 4) r(s))
    SELECT e.case_id, e.step, count(f.case_id) AS candidates, CASE WHEN count(f.case_id) = 0 THEN 'missing' WHEN count(f.case_id) > 1 THEN 'ambiguous' ELSE 'ok' END AS status
    FROM expected e LEFT JOIN found f ON f.case_id = e.case_id AND f.step = e.step GROUP BY ALL""",
)
def listing_to_expected_steps(spark, d):
    from ..sources.discovery import match_expected

    page = F.col("page_id")
    case = F.concat(F.lit("case"), F.floor(page / 4).cast("string"))
    suffix = F.when(page % 3 == 0, ".png").when(page % 3 == 1, ".JPG").otherwise(".txt")
    pages = table(spark, d, "pages")
    listing = pages.select(F.concat(case, F.lit("/step"), (page % 4).cast("string"), suffix).alias("path"))
    expected = pages.select(case.alias("case_id")).distinct().select("case_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("step"))
    return match_expected(listing, expected).select("case_id", "step", "candidates", "status")


@query(
    "q74_null_safe_projection",
    """WITH v AS (SELECT event_id, user_id % 5 AS g, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE ELSE value END AS x FROM events)
    SELECT g, round(avg(x) FILTER (NOT isnan(x)), 9) AS mean, count(*) AS n, count(*) FILTER (x IS NOT NULL AND NOT isnan(x)) AS finite FROM v GROUP BY 1""",
)
def null_safe_projection(spark, d):
    from ..functions.scores import finite, present

    x = F.when(F.col("event_id") % 4 == 1, float("nan")).when(F.col("event_id") % 4 != 0, F.col("value"))
    v = table(spark, d, "events").select((F.col("user_id") % 5).alias("g"), x.alias("x"))
    return v.groupBy("g").agg(r9(F.avg(present(F.col("x")))).alias("mean"), F.count("*").alias("n"), F.count_if(finite(F.col("x"))).alias("finite"))


@query(
    "q76_cross_field_contract",
    """WITH c AS (SELECT conv_id, count(*) AS n, list(turn ORDER BY turn) AS turns, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1)
    SELECT conv_id, 'num_calls' AS rule FROM c WHERE n <> 4 UNION ALL SELECT conv_id, 'alternating' FROM c WHERE list_contains(list_transform(range(2, len(roles) + 1), lambda i: roles[i] = roles[i - 1]), true)
    UNION ALL SELECT conv_id, 'starts_at_zero' FROM c WHERE turns[1] <> 0""",
)
def cross_field_contract(spark, d):
    from ..operators.rules import Rule, violations

    s = F.array_sort(F.collect_list(F.struct("turn", "role")))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(s.alias("s"))
    following = F.transform("s", lambda x, i: F.when(i > 0, x["role"] == F.get("s", i - 1)["role"]).otherwise(False))
    return violations(c, ["conv_id"], [Rule("num_calls", F.size("s") == 4), Rule("alternating", ~F.exists(following, lambda x: x)), Rule("starts_at_zero", F.get("s", F.lit(0))["turn"] == 0)]).select("conv_id", "rule")


@query(
    "q80_priority_lookup",
    """SELECT p.page_id, coalesce(a.doc_id, b.doc_id, -1) AS doc_id, CASE WHEN a.doc_id IS NOT NULL THEN 'exact' WHEN b.doc_id IS NOT NULL THEN 'digits' ELSE 'none' END AS how
    FROM pages p LEFT JOIN documents a ON a.doc_id = p.page_id AND a.lang = 'en' LEFT JOIN documents b ON b.doc_id = p.page_id + 1 AND b.lang <> 'en'""",
)
def priority_lookup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    p = table(spark, d, "pages").select("page_id")
    a = docs.filter("lang = 'en'").select(F.col("doc_id").alias("a"))
    b = docs.filter("lang <> 'en'").select(F.col("doc_id").alias("b"))
    j = p.join(a, F.col("page_id") == F.col("a"), "left").join(b, F.col("page_id") + 1 == F.col("b"), "left")
    return j.select("page_id", F.coalesce("a", "b", F.lit(-1)).alias("doc_id"), F.when(F.col("a").isNotNull(), "exact").when(F.col("b").isNotNull(), "digits").otherwise("none").alias("how"))


@query(
    "q84_ordering_and_caps",
    """WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations)
    SELECT conv_id, turn, role, k::INT AS place FROM r WHERE k <= 2""",
)
def ordering_and_caps(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("size"), "turn")
    return c.withColumn("place", F.row_number().over(w)).filter("place <= 2").select("conv_id", "turn", "role", "place")


@query(
    "q86_id_tokens_and_paths",
    f"""WITH {STEPS_SQL} SELECT id, string_split(id, '__')[3] AS subtype, regexp_extract(id, '^(.*)__step', 1) AS case_id, regexp_extract(id, '__step([0-9]+)$', 1)::INT AS step FROM steps""",
)
def id_tokens(spark, d):
    i = F.col("id")
    return step_records(spark, d).select("id", labels.subtype_of(i).alias("subtype"), labels.case_of(i).alias("case_id"), labels.step_of(i).alias("step"))


@query(
    "q92_embedded_rebuild",
    """SELECT conv_id, string_agg(role || ':' || md5(text), ',' ORDER BY turn) AS embedded, bool_and(length(text) > 0) AS complete FROM conversations GROUP BY 1""",
)
def embedded_rebuild(spark, d):
    s = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.md5("text")).alias("x"))))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(s.alias("s"), F.bool_and(F.length("text") > 0).alias("complete"))
    return g.select("conv_id", F.array_join(F.transform("s", lambda x: x["x"]), ",").alias("embedded"), "complete")
