"""Command line: ``python -m stepfold COMMAND``; what is wrong goes to stderr with exit code 2, results to stdout as JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prepare, run, schema
from .operators import contract, delivery, rules
from .plans import registry
from .sources import jsonl, sinks
from .sources.jsonl import numbered_lines, parse_lines

OBJECTS = "id string, num_gt_objects int, num_pred_all int, num_matched int, center_error_norm double, object_integrity double, relative_topology double"
GENERATED = "case_id string, step_id int, output_path string, output_sha256 string"
SOURCES = "image_ref string, image_path string, depth_path string"
CAMERAS = "image_ref string, extrinsics_c2w array<array<double>>, intrinsics array<array<double>>, image_height int, image_width int"
PLAN = "dataset string, path string, alternatives array<string>"


def _rows(spark: SparkSession, path: str, ddl: str, numbered: bool = True) -> DataFrame:
    """Parquet, or JSON Lines whose first bad line is an error."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    good, bad = parse_lines(numbered_lines(spark, path), ddl)
    first = bad.orderBy("row_no").first()
    if first is not None:
        raise ValueError(f"{path}: line {first['row_no']} is not an object")
    return good.drop("file") if numbered else good.drop("file", "row_no")


def roots(pairs: list[str]) -> dict[str, str]:
    """NAME=PATH arguments; a name may be given once."""
    out: dict[str, str] = {}
    for pair in pairs:
        name, sep, path = pair.partition("=")
        if not sep or not name or not path:
            raise ValueError(f"a root is NAME=PATH, not {pair}")
        if name in out:
            raise ValueError(f"root {name} is given twice")
        out[name] = path.rstrip("/")
    return out


def under_roots(df: DataFrame, columns: list[str], where: dict[str, str]) -> DataFrame:
    """Paths that start with ``${NAME}/`` put under the root of that name; an unknown name is an error."""
    names = F.create_map(*(F.lit(x) for pair in where.items() for x in pair)) if where else F.lit(None).cast("map<string,string>")

    def put(c: str):
        token = F.regexp_extract(c, r"^\$\{([A-Za-z0-9_-]+)\}/", 1)
        root = F.coalesce(F.try_element_at(names, token), F.raise_error(F.concat(F.lit("unknown root: "), token)).cast("string"))
        return F.when(token != "", F.concat(root, F.substr(F.col(c), F.length(token) + 4))).otherwise(F.col(c))

    return df.withColumns({c: put(c) for c in columns})


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stepfold")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run a registered query over a folder of tables")
    q.add_argument("name", choices=sorted(registry.QUERIES))
    q.add_argument("tables")
    q.add_argument("--out", help="write Parquet here instead of printing rows")
    v = sub.add_parser("validate", help="check a manifest and, where given, predictions")
    v.add_argument("manifest")
    v.add_argument("--predictions")
    v.add_argument("--sha256", default="", help="digest of the manifest")
    s = sub.add_parser("score", help="fold pose and object records into a result")
    s.add_argument("pose")
    s.add_argument("objects")
    s.add_argument("--provenance", required=True, help="a JSON object")
    s.add_argument("--run", help="folder that keeps the run's configuration, stages and report")
    s.add_argument("--resume", action="store_true", help="go on with the run in that folder")
    sub.add_parser("health", help="versions and settings")
    f = sub.add_parser("frames", help="the frames that a manifest needs, by data set")
    f.add_argument("manifest")
    f.add_argument("--out", help="write them as JSON Lines here")
    u = sub.add_parser("delivery", help="what of a plan of source files has arrived")
    u.add_argument("plan")
    u.add_argument("verified")
    u.add_argument("existing")
    b = sub.add_parser("build", help="materialise, verify and publish the frames of a manifest")
    b.add_argument("manifest")
    b.add_argument("sources")
    b.add_argument("cameras")
    b.add_argument("folder")
    b.add_argument("--revision", required=True)
    b.add_argument("--reference", help="frozen index to compare with")
    b.add_argument("--root", action="append", default=[], metavar="NAME=PATH", help="what ${NAME} in source paths stands for")
    b.add_argument("--resume", action="store_true")
    i = sub.add_parser("verify", help="check an index against a manifest and a reference")
    i.add_argument("index")
    i.add_argument("manifest")
    i.add_argument("--reference")
    w = sub.add_parser("labels", help="check a label bank against a manifest")
    w.add_argument("bank")
    w.add_argument("manifest")
    r = sub.add_parser("predictions", help="prediction rows of generated files")
    r.add_argument("manifest")
    r.add_argument("generated")
    r.add_argument("out")
    r.add_argument("--model-id", required=True)
    r.add_argument("--model-type", required=True)
    r.add_argument("--sha256", required=True, help="digest of the manifest")
    c = sub.add_parser("settings", help="evaluator settings as they are resolved")
    c.add_argument("--config")
    c.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    return p


#: Evaluator settings and their environment variables.
SETTINGS = {"model_id": "STEPFOLD_MODEL_ID", "device": "STEPFOLD_DEVICE", "verdict_backend": "STEPFOLD_VERDICT_BACKEND", "pose_backend": "STEPFOLD_POSE_BACKEND", "match_policy": "STEPFOLD_MATCH_POLICY", "proposal_mode": "STEPFOLD_PROPOSAL_MODE"}
DEFAULTS = {"device": "cpu", "verdict_backend": "table", "pose_backend": "table", "match_policy": "relaxed", "proposal_mode": "text"}


def _score(spark: SparkSession, a: argparse.Namespace) -> str:
    pose, objects = _rows(spark, a.pose, schema.POSE_RECORD, False), _rows(spark, a.objects, OBJECTS, False)
    rules.assert_clean(contract.check_records(pose, objects).withColumn("priority", F.lit(0)), ["id"])
    provenance = json.loads(a.provenance)
    if a.run is None:
        return contract.result(pose, objects, provenance).toJSON().first()
    own = run.Run(spark, a.run, {"provenance": provenance}, {"pose": pose, "objects": objects}, a.resume)
    text = own.stage("result", lambda: contract.result(pose, objects, provenance)).toJSON().first()
    own.report(result=json.loads(text))
    sinks.write_document(spark, text + "\n", f"{own.folder}/result.json")
    return text


def _execute(spark: SparkSession, a: argparse.Namespace) -> dict | str | None:
    def manifest() -> DataFrame:
        return _rows(spark, a.manifest, schema.MANIFEST)

    if a.command == "health":
        return {"spark": spark.version, "master": spark.sparkContext.master, "adaptive": spark.conf.get("spark.sql.adaptive.enabled"), "queries": len(registry.QUERIES)}
    if a.command == "query":
        df = registry.QUERIES[a.name](spark, a.tables)
        if a.out:
            df.write.mode("errorifexists").parquet(a.out)
        else:
            df.show(20, truncate=False)
        return None
    if a.command == "validate":
        rows = manifest()
        rules.assert_clean(contract.check_manifest(rows), ["row_no"])
        if a.predictions:
            rules.assert_clean(contract.check_predictions(_rows(spark, a.predictions, schema.PREDICTION), rows, a.sha256), ["row_no"])
        return {"cases": rows.count(), "steps": contract.expected_steps(rows).count()}
    if a.command == "score":
        return _score(spark, a)
    if a.command == "frames":
        wanted = prepare.requests(manifest())
        if a.out:
            jsonl.write_lines(wanted.drop("identities").withColumn("_ref", F.col("image_ref")), a.out, "_ref")
        by = {r["dataset"]: {"frames": r["frames"], "scenes": r["scenes"]} for r in wanted.groupBy("dataset").agg(F.count("*").alias("frames"), F.count_distinct("scene_id").alias("scenes")).collect()}
        return {"datasets": by, "conflicts": wanted.filter("identities > 1").count()}
    if a.command == "delivery":
        report = delivery.unpack_report(_rows(spark, a.plan, PLAN, False), _rows(spark, a.verified, "path string", False), _rows(spark, a.existing, "path string", False))
        found = [r.asDict() for r in delivery.delivery_summary(report).orderBy("dataset").collect()]
        print(json.dumps(found))
        if any(r["missing"] for r in found):
            raise ValueError("files are missing")
        return None
    if a.command == "build":
        sources = under_roots(_rows(spark, a.sources, SOURCES, False), ["image_path", "depth_path"], roots(a.root))
        reference = _rows(spark, a.reference, schema.FRAME, False) if a.reference else None
        return prepare.build(spark, manifest().drop("row_no"), sources, _rows(spark, a.cameras, CAMERAS, False), a.folder, a.revision, reference, resume=a.resume)
    if a.command == "verify":
        index = spark.read.parquet(a.index) if not a.index.endswith(".jsonl") else _rows(spark, a.index, schema.FRAME, False)
        problems = prepare.verify(index, manifest(), _rows(spark, a.reference, schema.FRAME, False) if a.reference else None)
        if problems:
            raise ValueError("; ".join(problems))
        return {"status": "verified", "frames": index.count(), "reference_checked": bool(a.reference)}
    if a.command == "labels":
        found = contract.check_label_bank(_rows(spark, a.bank, schema.LABELS, False), manifest())
        lines = prepare.problem_list(found.select(F.col("sample_id").alias("image_ref"), F.col("rule").alias("problem")))
        if lines:
            raise ValueError("; ".join(lines))
        return {"status": "valid"}
    if a.command == "predictions":
        made = contract.build_predictions(manifest(), _rows(spark, a.generated, GENERATED, False), a.model_id, a.model_type, a.sha256)
        order = F.format_string("%012d-%06d", F.col("row_no").cast("bigint"), F.col("place").cast("bigint"))
        jsonl.write_lines(made.withColumn("_order", order).drop("row_no", "place"), a.out, "_order")
        return {"predictions": made.count()}
    given = roots(a.set)
    return run.settings(SETTINGS, given, file=run.read_settings(a.config) if a.config else None, defaults=DEFAULTS)


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("stepfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        said = _execute(spark, a)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if said is not None:
        print(said if isinstance(said, str) else json.dumps(said))
    return 0


if __name__ == "__main__":
    sys.exit(main())
