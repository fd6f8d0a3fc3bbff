"""Image measures over pixel rows: resampling, structural similarity, colour histograms, moments of masks.

An image is rows (id, x, y, value columns).  Separable filters are two joins with small
tables of taps (output place, input place, weight) and two sums; rows are dealt by id
once, which serves all of it.  Histograms and moments are counts and sums, so parts of an image may be aggregated anywhere
and added.  The tables of taps have a few entries for each row or column of the image size and are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Taps = list[tuple[int, int, float]]


def _cubic(x: float, a: float) -> float:
    x = abs(x)
    if x < 1:
        return ((a + 2) * x - (a + 3)) * x * x + 1
    return a * (((x - 5) * x + 8) * x - 4) if x < 2 else 0.0


def taps(n: int, to: int, kind: str = "bilinear", antialias: bool = False) -> Taps:
    """Weights that take a line of ``n`` values to ``to`` values, pixel centres at halves.

    ``nearest`` takes the pixel at or before, ``area`` the mean of what a target pixel
    covers, ``bilinear`` and ``cubic`` (a of -0.75, with ``antialias`` -0.5) neighbours, the edge repeated; with ``antialias``
    their reach grows with the reduction and weights are cut at the edge instead.  ``blur`` is a Gaussian of sigma 1.5 over seven places, mirrored.
    """
    out: Taps = []
    scale = n / to
    for i in range(to):
        weights: dict[int, float] = {}

        def add(j: int, w: float, weights=weights) -> None:
            weights[j] = weights.get(j, 0.0) + w

        if kind == "nearest":
            add(i * n // to, 1.0)
        elif kind == "area":
            low, high = i * scale, (i + 1) * scale
            for j in range(int(low), min(n, math.ceil(high))):
                add(j, (min(high, j + 1) - max(low, j)) / scale)
        elif kind in ("bilinear", "cubic"):
            middle, wide = (i + 0.5) * scale, max(scale, 1.0) if antialias else 1.0
            reach = (1 if kind == "bilinear" else 2) * wide
            for j in range(math.floor(middle - reach - 0.5), math.ceil(middle + reach + 0.5)):
                x = (j + 0.5 - middle) / wide
                w = max(0.0, 1 - abs(x)) if kind == "bilinear" else _cubic(x, -0.5 if antialias else -0.75)
                if w and (not antialias or 0 <= j < n):
                    add(min(max(j, 0), n - 1), w)
        elif kind == "blur":
            for k in range(-3, 4):
                j = i + k
                while not 0 <= j < n:
                    j = -j if j < 0 else 2 * (n - 1) - j
                    j = 0 if n == 1 else j
                add(j, math.exp(-(k**2) / 4.5))
        else:
            raise ValueError(f"no kind {kind}")
        total = sum(weights.values())
        out += [(i, j, w / total) for j, w in sorted(weights.items()) if w]
    return out


def filtered(pixels: DataFrame, across: Taps, down: Taps, values: Sequence[str] = ("value",)) -> DataFrame:
    """id, x, y and ``values`` after the taps ``across`` each line and ``down`` each column."""
    spark = pixels.sparkSession
    now = pixels.select("id", "x", "y", *values).repartition("id")
    for axis, rest, some in (("x", "y", across), ("y", "x", down)):
        table = F.broadcast(_taps_table(spark, some, axis))
        now = now.join(table, axis).groupBy("id", rest, "to").agg(*(F.sum(F.col(v) * F.col("weight")).alias(v) for v in values)).withColumnRenamed("to", axis)
    return now.select("id", "x", "y", *values)


def _taps_table(spark: SparkSession, some: Taps, axis: str) -> DataFrame:
    return spark.createDataFrame([(i, j, float(w)) for i, j, w in some], f"to int, {axis} int, weight double")


def resized(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], kind: str = "bilinear", antialias: bool = False, values: Sequence[str] = ("value",)) -> DataFrame:
    """Images of one ``size`` (width, height) brought to another."""
    return filtered(pixels, taps(size[0], to[0], kind, antialias), taps(size[1], to[1], kind, antialias), values)


def ssim(pairs: DataFrame, size: tuple[int, int], top: float = 255.0) -> DataFrame:
    """id, ssim of image pairs (id, x, y, a, b) of one ``size``."""
    made = pairs.select("id", "x", "y", *(e.cast("double").alias(n) for n, e in (("a", F.col("a")), ("b", F.col("b")), ("aa", F.col("a") * F.col("a")), ("bb", F.col("b") * F.col("b")), ("ab", F.col("a") * F.col("b")))))
    s = filtered(made, taps(size[0], size[0], "blur"), taps(size[1], size[1], "blur"), ("a", "b", "aa", "bb", "ab"))
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    a, b = F.col("a"), F.col("b")
    va, vb, cov = F.col("aa") - a * a, F.col("bb") - b * b, F.col("ab") - a * b
    each = ((2 * a * b + c1) * (2 * cov + c2)) / ((a * a + b * b + c1) * (va + vb + c2))
    return s.groupBy("id").agg(F.avg(each).alias("ssim"))


HUE_BINS, SATURATION_BINS = 30, 32


def hue_bins(pixels: DataFrame) -> DataFrame:
    """id, bin, n: counts of hue and saturation of pixels (id, r, g, b); they add over parts of an image."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    turn = F.when(d == 0, 0.0).when(high == r, F.pmod((g - b) / F.when(d != 0, d), F.lit(6.0))).when(high == g, (b - r) / F.when(d != 0, d) + 2).otherwise((r - g) / F.when(d != 0, d) + 4)
    hue = F.pmod(turn / 6, F.lit(1.0))
    saturation = F.when(high > 0, d / F.when(high > 0, high)).otherwise(0.0)
    place = F.least(F.floor(hue * HUE_BINS), F.lit(HUE_BINS - 1)) * SATURATION_BINS + F.least(F.floor(saturation / 1.0000001 * SATURATION_BINS), F.lit(SATURATION_BINS - 1))
    return pixels.select("id", place.cast("int").alias("bin")).groupBy("id", "bin").agg(F.count("*").alias("n"))


def colour_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, similarity: correlation of the histograms (id, bin, n) of two images, as 0 to 1; 1 where either is flat."""
    both = a.select("id", "bin", F.col("n").alias("p")).join(b.select("id", "bin", F.col("n").alias("q")), ["id", "bin"], "full").fillna(0, ["p", "q"])
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    s = both.groupBy("id").agg(F.sum(p).alias("sp"), F.sum(q).alias("sq"), F.sum(p * p).alias("pp"), F.sum(q * q).alias("qq"), F.sum(p * q).alias("pq"))
    n = float(HUE_BINS * SATURATION_BINS)
    vp, vq, cov = F.col("pp") - F.col("sp") ** 2 / n, F.col("qq") - F.col("sq") ** 2 / n, F.col("pq") - F.col("sp") * F.col("sq") / n
    den = F.sqrt(vp * vq)
    return s.select("id", F.when(den > 0, (cov / F.when(den > 0, den) + 1) / 2).otherwise(1.0).alias("similarity"))


ORDERS = [(p, q) for p in range(4) for q in range(4 - p)]


def moments(pixels: DataFrame) -> DataFrame:
    """id and s00 to s30: sums of x^p y^q over a mask's pixels (id, x, y), exact; they add over tiles."""
    x, y = (F.col(c).cast("decimal(12,0)") for c in "xy")

    def power(p: int, q: int) -> Column:
        out = F.lit(1).cast("decimal(12,0)")
        for v in [x] * p + [y] * q:
            out = (out * v).cast("decimal(26,0)")
        return out

    return pixels.groupBy("id").agg(*(F.sum(power(p, q)).cast("decimal(38,0)").alias(f"s{p}{q}") for p, q in ORDERS))


def add_moments(tiles: DataFrame) -> DataFrame:
    """The moments of whole images from those of their tiles."""
    return tiles.groupBy("id").agg(*(F.sum(f"s{p}{q}").cast("decimal(38,0)").alias(f"s{p}{q}") for p, q in ORDERS))


def log_hu(sums: DataFrame) -> DataFrame:
    """id, area, hu: logarithms of the seven invariants, from moments; central moments are whole numbers over n or n squared."""
    s = {(p, q): F.col(f"s{p}{q}") for p, q in ORDERS}
    big = lambda e: e.cast("decimal(38,0)")
    n, x, y = s[0, 0], s[1, 0], s[0, 1]
    second = {(2, 0): n * s[2, 0] - x * x, (1, 1): n * s[1, 1] - x * y, (0, 2): n * s[0, 2] - y * y}
    nn = big(n * n)
    third = {
        (3, 0): big(nn * s[3, 0]) - big(big(3 * n * x) * s[2, 0]) + big(2 * big(x * x) * x),
        (0, 3): big(nn * s[0, 3]) - big(big(3 * n * y) * s[0, 2]) + big(2 * big(y * y) * y),
        (2, 1): big(nn * s[2, 1]) - big(big(2 * n * x) * s[1, 1]) - big(big(n * y) * s[2, 0]) + big(2 * big(x * x) * y),
        (1, 2): big(nn * s[1, 2]) - big(big(2 * n * y) * s[1, 1]) - big(big(n * x) * s[0, 2]) + big(2 * big(y * y) * x),
    }
    area = n.cast("double")
    # over n (n squared), and by area ** (1 + order / 2)
    fields = [(big(e).cast("double") / F.pow(area, F.lit(3.0))).alias(f"n{p}{q}") for (p, q), e in second.items()] + [(e.cast("double") / F.pow(area, F.lit(4.5))).alias(f"n{p}{q}") for (p, q), e in third.items()]
    each = sums.select("id", n.cast("bigint").alias("area"), F.inline(F.array(F.struct(*fields))))
    eta = {k: F.col(f"n{k[0]}{k[1]}") for k in [*second, *third]}
    named = {"a": eta[3, 0] + eta[1, 2], "b": eta[2, 1] + eta[0, 3], "c": eta[3, 0] - 3 * eta[1, 2], "d": 3 * eta[2, 1] - eta[0, 3], "s": eta[2, 0] + eta[0, 2], "t": eta[2, 0] - eta[0, 2], "u": eta[1, 1]}
    each = each.select("id", "area", F.inline(F.array(F.struct(*(v.alias(k) for k, v in named.items())))))
    a, b, c, d, s, t, u = (F.col(k) for k in "abcdstu")
    hu = [s, t * t + 4 * u * u, c * c + d * d, a * a + b * b, c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b), t * (a * a - b * b) + 4 * u * a * b, d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b)]
    return each.select("id", "area", F.transform(F.array(*hu), lambda h: -F.signum(h) * F.log10(F.abs(h) + 1e-12)).alias("hu"))


def shape_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, iou, similarity of mask pairs (id, x, y, a pixel once): 0.6 overlap and 0.4 nearness of the invariants; ids that both have."""
    shared = a.join(b, ["id", "x", "y"]).groupBy("id").agg(F.count("*").alias("shared"))
    p, q = log_hu(moments(a)), log_hu(moments(b))
    both = p.select("id", F.col("area").alias("pa"), F.col("hu").alias("ph")).join(q.select("id", F.col("area").alias("qa"), F.col("hu").alias("qh")), "id").join(shared, "id", "left")
    both = both.withColumn("shared", F.coalesce("shared", F.lit(0)))
    iou = F.col("shared") / (F.col("pa") + F.col("qa") - F.col("shared"))
    off = F.aggregate(F.zip_with("ph", "qh", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 7
    return both.select("id", iou.alias("iou"), (0.6 * iou + 0.4 * F.exp(-off / 3)).alias("similarity"))
