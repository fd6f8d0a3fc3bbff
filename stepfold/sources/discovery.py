"""Discovery of outputs: listing, what belongs to which step, expected against found, frames of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Suffixes of still images and of encoded videos.
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "ppm", "tif", "tiff")
VIDEOS = ("mp4", "mov", "avi", "mkv", "webm", "gif")
#: A step's marker: ``step3``, ``step03``, ``step_3`` or ``step_03``.
_TOKEN = r"step_?(0?[0-9]|[1-9][0-9]+)"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.select("path", F.col("length").alias("size"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def relative(path: Column, root: str | None = None) -> Column:
    """The path below ``root`` and below its ``outputs/`` if it has one; without a root, below the first ``outputs/``."""
    below = path if root is None else F.regexp_replace(path, r"^.*?" + _quoted(root.split(":", 1)[-1].strip("/")) + "/", "")
    return F.regexp_replace(below, r"^(?:.*?/)?outputs/" if root is None else "^outputs/", "")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else f"\\{c}" for c in text)


def candidates(files: DataFrame, root: str | None = None) -> DataFrame:
    """(case_id, step, artefact): what may be the output of a step, each once.

    ``case/step3.png`` and ``case_step3.png`` are files of a usable kind; a folder
    ``case/step3/`` is one artefact, however many frames it holds.  ``case.png`` has a
    null step: it stands for the only step of a case.  As names may hold dots and
    markers themselves, every reading of a name is a candidate.
    """
    rel = files.select(relative(F.col("path"), root).alias("rel"))
    kind = "array<struct<case_id:string,step:int,artefact:string>>"

    def reading(case: Column, step: Column, artefact: Column) -> Column:
        return F.struct(case.alias("case_id"), step.cast("int").alias("step"), artefact.alias("artefact"))

    def below(pattern: str, artefact: str) -> Column:
        """A marker that is a name of its own; the artefact is a file or the folder."""
        found = F.regexp_extract("rel", pattern, 1) != ""
        return F.when(found, F.array(reading(F.regexp_extract("rel", pattern, 1), F.regexp_extract("rel", pattern, 2), F.regexp_extract("rel", artefact, 1)))).otherwise(F.array().cast(kind))

    usable = suffix(F.col("rel")).isin(*IMAGES, *VIDEOS)
    file = F.when(usable, below(rf"^(.+)/{_TOKEN}\.[^/]*$", "^(.*)$")).otherwise(F.array().cast(kind))
    folder = below(rf"^(.+?)/{_TOKEN}(?:\.[^/]*)?/", rf"^(.+?/{_TOKEN}(?:\.[^/]*)?)/")
    # the rest of the name decides for markers and dots in it: each cut is tried
    marks, dots = F.split("rel", "_(?=step)"), F.split("rel", r"\.")
    top = usable & ~F.col("rel").contains("/")

    def cuts(parts: Column, glue: str, read) -> Column:
        many = F.when(top & (F.size(parts) > 1), F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(many, lambda i: read(F.array_join(F.slice(parts, F.lit(1), i), glue), F.array_join(F.slice(parts, i + 1, F.size(parts)), glue)))

    marked = F.filter(cuts(marks, "_", lambda case, rest: reading(case, F.nullif(F.regexp_extract(rest, rf"^{_TOKEN}\.", 1), F.lit("")), F.col("rel"))), lambda x: x["step"].isNotNull())
    bare = cuts(dots, ".", lambda case, rest: reading(case, F.lit(None), F.col("rel")))
    return rel.select(F.explode(F.concat(file, folder, marked, bare)).alias("x")).select("x.*").filter("case_id <> ''").distinct()


def match_expected(files: DataFrame, expected: DataFrame, root: str | None = None) -> DataFrame:
    """Each expected (case_id, step) with its candidates' number, status (ok, missing, ambiguous) and the artefact if ok."""
    found = candidates(files, root)

    def counted(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("artefact").alias("artefact"))

    named = counted(found.filter("step IS NOT NULL"), "case_id", "step").toDF("c", "s", "n", "a")
    bare = counted(found.filter("step IS NULL"), "case_id").toDF("bc", "bn", "ba")
    steps = expected.select("case_id", "step").withColumn("steps", F.count("*").over(Window.partitionBy("case_id")))
    j = steps.join(named, (F.col("case_id") == F.col("c")) & (F.col("step") == F.col("s")), "left")
    j = j.join(bare, (F.col("case_id") == F.col("bc")) & (F.col("steps") == 1), "left")
    n = F.coalesce("n", F.lit(0)) + F.coalesce("bn", F.lit(0))
    status = F.when(n == 0, "missing").when(n > 1, "ambiguous").otherwise("ok")
    return j.select("case_id", "step", n.alias("candidates"), status.alias("status"), F.when(n == 1, F.coalesce("a", "ba")).alias("artefact"))


def frame_index(count: Column, policy: str = "last", index: int = -1, ratio: float = 1.0) -> Column:
    """Which of ``count`` frames stands for a step, from 0: the last, a given one (negative: from the end), or a share of the way.

    Null where the segment is empty or has no such frame.
    """
    if policy == "last":
        at = count - 1
    elif policy == "index":
        at = F.lit(index) if index >= 0 else count + index
    elif policy == "ratio":
        if not 0 <= ratio <= 1:
            raise ValueError(f"ratio {ratio} is not between 0 and 1")
        at = F.bround(F.lit(float(ratio)) * (count - 1)).cast("int")
    else:
        raise ValueError(f"unknown policy: {policy}")
    return F.when((at >= 0) & (at < count), at).cast("int")


def chosen_frames(files: DataFrame, **selection) -> DataFrame:
    """(folder, frames, path): the chosen still image of each folder of frames, in the order of their names.

    A folder's names are one row; a segment has a bounded number of frames.
    """
    frames = files.filter(suffix(F.col("path")).isin(*IMAGES)).select(F.regexp_replace("path", "/[^/]+$", "").alias("folder"), "path")
    each = frames.groupBy("folder").agg(F.array_sort(F.collect_list("path")).alias("p"))
    return each.select("folder", F.size("p").alias("frames"), F.get("p", frame_index(F.size("p"), **selection)).alias("path"))
