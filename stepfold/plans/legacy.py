"""Queries over older case documents, which are made from events as JSON text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legacy
from .fixtures import OBJECTS_SQL, objects, table
from .registry import query
from .texts import STOP, _norm_sql

#: The documents of labels, as SQL that Spark and DuckDB read alike ({0} is the type, {1} the number).
LABEL_DOC = """CASE event_id % 6
  WHEN 0 THEN '{"object_prompt_labels": ["The ' || event_type || '", "wall", "tv"], "detector_prompt_labels": "sofa"}'
  WHEN 1 THEN '{"stage2": {"detector_prompt_labels": ["bed", "' || event_type || '"], "vlm": {"object_anchor_tags": {"main_objects": [{"category": "a lamp"}, {"other": 1}, {"category": "bed"}], "primary_anchor": {"category": "' || event_type || '"}}}}}'
  WHEN 2 THEN '{"stage2": {"vlm": {"object_anchor_tags": {"repeated_instance_groups": [{"category": "chair"}], "primary_anchor": "none"}, "spatial_relation_tags": {"camera_object_relations": [{"object": "desk_' || user_id || '"}]}}}}'
  WHEN 3 THEN '{"stage2": {"vlm": {"spatial_relation_tags": {"object_object_depth_pairs": [{"front": "mug", "back": "desk"}, {"front": "tv"}], "object_object_left_right_pairs": [{"left": "plant", "right": "mug"}], "object_region_relations": [{"object": "rug/mat"}]}}}}'
  WHEN 4 THEN '{"object_prompt_labels": null, "stage2": []}' ELSE 'no document' END"""
_PLACES = """coalesce(CASE WHEN json_type(j, '$.object_prompt_labels') = 'ARRAY' THEN j->>'$.object_prompt_labels[*]' WHEN json_type(j, '$.object_prompt_labels') = 'VARCHAR' THEN [j->>'$.object_prompt_labels'] END, [])
  || coalesce(CASE WHEN json_type(j, '$.detector_prompt_labels') = 'VARCHAR' THEN [j->>'$.detector_prompt_labels'] END, [])
  || coalesce(j->>'$.stage2.detector_prompt_labels[*]', []) || coalesce(j->>'$.stage2.vlm.object_anchor_tags.main_objects[*].category', [])
  || CASE WHEN j->>'$.stage2.vlm.object_anchor_tags.primary_anchor.category' IS NOT NULL THEN [j->>'$.stage2.vlm.object_anchor_tags.primary_anchor.category'] ELSE [] END
  || coalesce(j->>'$.stage2.vlm.object_anchor_tags.repeated_instance_groups[*].category', []) || coalesce(j->>'$.stage2.vlm.spatial_relation_tags.camera_object_relations[*].object', [])
  || coalesce(flatten(list_transform(json_extract(j, '$.stage2.vlm.spatial_relation_tags.object_object_depth_pairs[*]'), lambda o: [json_extract_string(o, '$.front'), json_extract_string(o, '$.back')])), [])
  || coalesce(flatten(list_transform(json_extract(j, '$.stage2.vlm.spatial_relation_tags.object_object_left_right_pairs[*]'), lambda o: [json_extract_string(o, '$.left'), json_extract_string(o, '$.right')])), [])
  || coalesce(j->>'$.stage2.vlm.spatial_relation_tags.object_region_relations[*].object', [])"""


@query("q103_nested_prompt_labels", f"""WITH t AS (SELECT event_id, {LABEL_DOC} AS doc FROM events), p AS (SELECT event_id, doc, CASE WHEN json_valid(doc) THEN doc::JSON END AS j FROM t),
    l AS (SELECT event_id, {_PLACES} AS all_labels FROM p), n AS (SELECT event_id, list_filter(list_transform(all_labels, lambda x: {_norm_sql('x')}), lambda x: x IS NOT NULL AND x NOT IN ({STOP})) AS k FROM l)
    SELECT event_id, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i)[:3], ',') AS labels FROM n""")
def nested_prompt_labels(spark, d):
    doc = F.try_parse_json(F.expr(LABEL_DOC))
    return table(spark, d, "events").select("event_id", F.array_join(F.coalesce(legacy.prompt_labels(doc, 3), F.array().cast("array<string>")), ",").alias("labels"))


STEP_DOC = """'{"target": ' || CASE WHEN event_id % 3 = 0 THEN '{"qwen3vl_gt_object_labels": {"detector_prompt_labels": ["' || event_type || '", "rug"]}}' WHEN event_id % 3 = 1 THEN '{"qwen3vl_gt_object_labels": {"detector_prompt_labels": [], "object_labels": ["wall"]}}' ELSE 'null' END
  || ', "records": [{"step": ' || CASE WHEN event_id % 2 = 0 THEN '1' ELSE '3' END || ', "qwen3vl_gt_object_labels": {"object_labels": ["lamp", "Lamp", "the ' || event_type || '"]}}, {"step": 1, "detector_prompt_labels": ["plant"]}]}'"""


@query("q104_frozen_step_labels", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ',rug' WHEN event_id % 2 = 0 THEN 'lamp,' || event_type ELSE 'plant' END AS labels FROM events""")
def frozen_step_labels(spark, d):
    doc = F.parse_json(F.expr(STEP_DOC))
    found = legacy.step_labels(F.try_variant_get(doc, "$.target", "variant"), F.try_variant_get(doc, "$.records", "array<variant>"), F.lit(0), F.lit(1))
    return table(spark, d, "events").select("event_id", F.array_join(found, ",").alias("labels"))


CASE_DOC = """CASE event_id % 7
  WHEN 0 THEN '{"context": [{"image_path": "c' || user_id || '.png"}, "d.png", {}], "target": {"path": "t.png"}}'
  WHEN 1 THEN '{"input_images": [{"path": "i1.png"}, {"path": "i2.png"}], "target_images": [{"image_path": "t' || user_id || '.png"}, {"path": "u.png"}]}'
  WHEN 2 THEN '{"protocol": "two_image_instruction", "input": {"image_1": {"path": "a.png"}, "image_2": {"path": "b' || user_id || '.png"}, "image": {"path": "x.png"}}, "target": {"path": "t.png"}}'
  WHEN 3 THEN '{"protocol": "single_image_cycle", "input_forward": {"image": {"path": "f.png"}}, "target_forward": {"path": "t' || user_id || '.png"}, "target": {"path": "no.png"}}'
  WHEN 4 THEN '{"protocol": "single_image_3step_chain", "input": {"image": {"path": "s.png"}}, "targets": [{"path": "t1.png"}, {"path": "t3.png"}], "target": {"path": "no.png"}}'
  WHEN 5 THEN '{"protocol": "single_image_cycle", "input": {"image_2": {"path": "late.png"}}, "targets": [{"path": "z.png"}]}'
  ELSE '{"input_images": [{"path": "i.png"}], "target_image": {"image": "only.png"}}' END"""


@query("q105_legacy_case_frames", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'c' || user_id || '.png,d.png' WHEN 1 THEN 'i1.png,i2.png' WHEN 2 THEN 'a.png,b' || user_id || '.png' WHEN 3 THEN 'f.png' WHEN 4 THEN 's.png' WHEN 5 THEN 'late.png' ELSE 'i.png' END AS context,
    CASE event_id % 7 WHEN 0 THEN 't.png' WHEN 1 THEN 't' || user_id || '.png' WHEN 2 THEN 't.png' WHEN 3 THEN 't' || user_id || '.png' WHEN 4 THEN 't3.png' WHEN 5 THEN 'z.png' ELSE 'only.png' END AS target FROM events""")
def legacy_case_frames(spark, d):
    x = table(spark, d, "events").select("event_id", legacy.case_frames(F.parse_json(F.expr(CASE_DOC))).alias("x"))
    return x.select("event_id", F.array_join("x.context", ",").alias("context"), "x.target")


RERUN_DOC = """CASE event_id % 5 WHEN 0 THEN '{"cycle_step2_strict_rerun": {"original_cycle_step": 2}, "frame_ids": ["f' || user_id || '", "g", "h"]}' WHEN 1 THEN '{"cycle_step2_strict_rerun": {"original_cycle_step": 2}, "frame_ids": ["f"]}'
  WHEN 2 THEN '{"cycle_step2_strict_rerun": {"original_cycle_step": 0}}' WHEN 3 THEN '{"cycle_step2_strict_rerun": [], "frame_ids": ["f", "g"]}' ELSE '{"cycle_step2_strict_rerun": {"original_cycle_step": 4}, "frame_ids": ["a", "b", "c", "d' || user_id || '"]}' END"""


@query("q106_cycle_step_numbers", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 4 THEN 4 ELSE 1 END AS step, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 4 THEN 4 ELSE 1 END AS steps,
    CASE event_id % 5 WHEN 0 THEN 'g' WHEN 4 THEN 'd' || user_id END AS source_frame FROM events""")
def cycle_step_numbers(spark, d):
    doc = F.parse_json(F.expr(RERUN_DOC))
    return table(spark, d, "events").select("event_id", legacy.step_number(doc, F.lit(0)).alias("step"), legacy.number_of_steps(doc, F.lit(1)).alias("steps"), legacy.source_frame(doc).alias("source_frame"))


@query("q107_names_and_keys", r"""WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '__' || url || '..' WHEN 2 THEN '/?/' ELSE repeat('ab', 80) || url END AS raw FROM pages),
    c AS (SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(raw, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'unknown') AS token FROM t)
    SELECT page_id, CASE WHEN length(token) > 120 THEN left(token, 107) || '_' || left(sha256(token), 12) ELSE token END AS token,
      CASE page_id % 3 WHEN 0 THEN 's' || page_id || '/img/1.jpg' WHEN 1 THEN 'h' || page_id || '/2.jpg' ELSE 'other/' || page_id || '.jpg' END AS image_key,
      CASE WHEN page_id % 4 = 1 THEN '7104910700000' ELSE page_id::VARCHAR END AS official, CASE page_id % 4 WHEN 3 THEN 'ai' ELSE 'ai_' || page_id END AS scene, CASE page_id % 4 WHEN 0 THEN 'cam_00' WHEN 1 THEN 'cam_' || page_id WHEN 2 THEN NULL ELSE 'cam_x' END AS camera FROM c""")
def names_and_keys(spark, d):
    i, n = F.col("page_id"), F.col("page_id").cast("string")
    raw = F.when(i % 4 == 0, F.col("url")).when(i % 4 == 1, F.concat(F.lit("__"), F.col("url"), F.lit(".."))).when(i % 4 == 2, "/?/").otherwise(F.concat(F.lit("ab" * 80), F.col("url")))
    path = F.when(i % 3 == 0, F.concat(F.lit("D:\\data\\matterport3d\\s"), n, F.lit("\\img\\1.jpg"))).when(i % 3 == 1, F.concat(F.lit("/x/matterport3d/scans/h"), n, F.lit("/2.jpg"))).otherwise(F.concat(F.lit("other/"), n, F.lit(".jpg")))
    scene = F.when(i % 4 == 0, F.concat(F.lit("ai_"), n, F.lit("__cam_00"))).when(i % 4 == 1, F.concat(F.lit("ai_"), n, F.lit("/cam_"), n)).when(i % 4 == 2, F.concat(F.lit("ai_"), n)).otherwise("ai\\cam_x")
    split = legacy.scene_and_camera(scene)
    return table(spark, d, "pages").select("page_id", legacy.file_token(raw, 120).alias("token"), legacy.image_key(path, "matterport3d").alias("image_key"), legacy.official_scene(F.when(i % 4 == 1, "7104910700").otherwise(n)).alias("official"), split["scene"].alias("scene"), split["camera"].alias("camera"))


@query("q108_box_catalogue", f"""WITH {OBJECTS_SQL}, l AS (SELECT step_id, idx, '- G' || (row_number() OVER (PARTITION BY step_id ORDER BY idx) - 1) || ': label=' || label || ', box_xyxy=[' || round_even(gx1, 0)::BIGINT || ', ' || round_even(gy1, 0)::BIGINT || ', ' || round_even(gx2, 0)::BIGINT || ', ' || round_even(gy2, 0)::BIGINT || ']' AS line FROM objects WHERE step_id % 7 <> 0 AND matched)
    SELECT s.step_id, coalesce(string_agg(line, chr(10) ORDER BY idx), '- No G objects.') AS catalogue FROM (SELECT DISTINCT step_id FROM objects) s LEFT JOIN l USING (step_id) GROUP BY 1""")
def box_catalogue(spark, d):
    o = objects(spark, d)
    shown = F.when((F.col("step_id") % 7 != 0) & F.col("matched"), F.struct("idx", "label", F.col("gt").alias("box")))
    return o.groupBy("step_id").agg(F.array_sort(F.collect_list(shown)).alias("o")).select("step_id", legacy.catalogue(F.col("o"), "G").alias("catalogue"))
