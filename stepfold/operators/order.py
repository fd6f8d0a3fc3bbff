"""Exact order statistics by radix selection: histograms of digits, no sort and no window.

A number's key is its 64-bit pattern as a signed long that keeps the order.  The first pass
counts the keys of each column (and group) by their highest sixteen bits; a wanted rank
starts with the least and largest key of the digit that holds it.  Each further pass counts,
for all columns, groups and ranks at once, the keys of an interval by the values of the
highest bits in which its ends differ (sixteen bits, or eight where over ``FEW`` intervals
are open), and narrows it in the same way.  An interval of up to ``EXACT`` keys is counted key by
key, and one whose ends are equal is done: of a few columns and groups, four passes at most
over the input, usually three.  The intervals are broadcast up to ``HELD`` of them, so that
rows are counted where they are read and no key is moved.  A task sends at most 65,536 counts an
interval, so a hot group is no burden to anybody.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import present
from ..lineage import cut

_MANTISSA = 1 << 52
#: Up to so many open intervals have digits of sixteen bits, up to so many are broadcast; so many keys are counted one by one.
FEW, HELD, EXACT = 64, 1 << 16, 1 << 16


def _power(e: Column) -> Column:
    """Two to an integer power in the range of normal numbers."""
    return F.pow(F.lit(2.0), e.cast("double"))


def _rough(a: Column) -> Column:
    """The exponent of a positive number; the logarithm may be off by one beside a power of two."""
    return F.least(F.lit(1023), F.greatest(F.lit(-1022), F.floor(F.log2(a)))).cast("int")


def _exponent(a: Column, rough: Column) -> Column:
    return rough - (_power(rough) > a).cast("int") + ((rough < 1023) & (_power(F.least(rough + 1, F.lit(1023))) <= a)).cast("int")


def _pattern(x: Column, a: Column, e: Column) -> Column:
    normal = (e.cast("bigint") + 1023) * _MANTISSA + ((a / _power(e) - 1) * float(_MANTISSA)).cast("bigint")
    subnormal = (a * 2.0**537 * 2.0**537).cast("bigint")
    bits = F.when(a == float("inf"), F.lit(2047 * _MANTISSA)).when(a < 2.0**-1022, subnormal).otherwise(normal)
    return F.when(x.isNull() | F.isnan(x), F.lit(None)).otherwise(F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)) * bits)


def double_key(x: Column) -> Column:
    """The 64-bit pattern of |x| with the sign of x: equal keys are equal numbers (-0 is 0), larger keys larger numbers; NaN and NULL have none."""
    a = F.abs(x)
    return _pattern(x, a, _exponent(a, _rough(a)))


def key_double(key: Column) -> Column:
    """The number of a key."""
    bits = F.abs(key)
    e = F.shiftright(bits, 52)
    part = bits.bitwiseAND(F.lit(_MANTISSA - 1)).cast("double")
    size = F.when(e == 2047, float("inf")).when(e == 0, part * 2.0**-537 * 2.0**-537).otherwise((1 + part / float(_MANTISSA)) * _power(e - 1023))
    return F.when(key < 0, -size).otherwise(size)


def _bits(x: Column) -> Column:
    """The number of bits of a non-negative long (64 for a negative one: the ends have different signs)."""
    return F.when(x < 0, 64).when(x == 0, 0).otherwise(F.length(F.bin(x)))


def _same(left: str, right: str, names: list[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return on


def _keys(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by..., column, key of each number; what the key rests on is computed once a row, step by step."""
    each = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v"))
    each = each.select(*by, "v.column", "v.x").filter("x IS NOT NULL AND NOT isnan(x)").withColumn("a", F.abs("x"))
    each = each.withColumn("rough", _rough(F.col("a"))).withColumn("e", _exponent(F.col("a"), F.col("rough")))
    return each.select(*by, "column", _pattern(F.col("x"), F.col("a"), F.col("e")).alias("key"))


def _bin() -> list[Column]:
    return [F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last")]


def _bins() -> Column:
    return F.array_sort(F.collect_list(F.struct("digit", "n", "first", "last"))).alias("bins")  # 65,536 at most


def _digit() -> Column:
    """Of the digit in ``bins`` that holds ``rank``: the rank within it, its least and largest key, its number of keys."""
    fields = ("rest", "first", "last", "inside")
    start = F.struct(F.col("rank").alias("rest"), *(F.lit(None).cast("bigint").alias(c) for c in fields[1:]))
    return F.aggregate(
        "bins",
        start,
        lambda s, b: F.when(s["first"].isNotNull(), s).when(s["rest"] < b["n"], F.struct(s["rest"].alias("rest"), b["first"].alias("first"), b["last"].alias("last"), b["n"].alias("inside"))).otherwise(F.struct((s["rest"] - b["n"]).alias("rest"), *(s[c].alias(c) for c in fields[1:]))),
    )


_NEW = (("rank", "rest"), ("lo", "first"), ("hi", "last"), ("inside", "inside"))


def _first(keys: DataFrame, names: list[str], ps: list[float]) -> DataFrame:
    """The wanted ranks (names, p, at, wanted) with their first intervals (lo, hi, inside) and ``rank`` counted from the start of them."""
    counts = keys.groupBy(*names, F.shiftright("key", 48).alias("digit")).agg(*_bin())
    bins = counts.groupBy(*names).agg(F.sum("n").alias("n"), _bins())
    at = ((F.col("n") - 1) * F.col("p")).alias("at")
    ranks = bins.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in ps)))).select(*names, "p", at, "bins")
    ranks = ranks.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).withColumn("wanted", F.col("rank")).withColumn("s", _digit())
    return ranks.select(*names, "p", "at", "wanted", *(F.col(f"s.{new}").alias(old) for old, new in _NEW))


def _narrowed(keys: DataFrame, ranks: DataFrame, names: list[str], n_open: int = 1) -> DataFrame:
    """One pass: ``ranks`` (names, p, at, wanted, rank, lo, hi and, if known, inside) with ``rank`` counted from the start of the narrower interval."""
    if "inside" not in ranks.columns:
        ranks = ranks.withColumn("inside", F.lit(None).cast("bigint"))
    shift = F.greatest(F.lit(0), _bits(F.col("lo").bitwiseXOR(F.col("hi"))) - (16 if n_open <= FEW else 8))
    open_ = ranks.filter("lo < hi").select(*names, "lo", "hi", F.when(F.col("inside") <= EXACT, 0).otherwise(shift).alias("shift")).distinct()
    open_ = F.broadcast(open_) if n_open <= HELD else open_
    # the coalesce keeps the optimiser from asking for keys that are not null, which would compute them twice
    within = F.coalesce(F.col("k.key").between(F.col("o.lo"), F.col("o.hi")), F.lit(False))
    inside = keys.alias("k").join(open_.alias("o"), _same("k", "o", names) & within)
    digit = F.expr("shiftright(k.key, o.shift)").alias("digit")
    counts = inside.select(*(F.col(f"k.{n}") for n in names), "o.lo", "o.hi", digit, "k.key").groupBy(*names, "lo", "hi", "digit").agg(*_bin())
    bins = counts.groupBy(*names, "lo", "hi").agg(_bins())
    both = ranks.alias("r").join(bins.alias("b"), _same("r", "b", [*names, "lo", "hi"]), "left").select("r.*", "b.bins").withColumn("s", _digit())
    done = F.col("bins").isNull()
    return both.select(*names, "p", "at", "wanted", *(F.when(done, F.col(old)).otherwise(F.col(f"s.{new}")).alias(old) for old, new in _NEW))


def _passes(keys: DataFrame, ranks: DataFrame, names: list[str]) -> DataFrame:
    """Narrow until every interval is one key.  Only the ranks are written between passes."""
    now = cut(ranks)
    while n_open := now.filter("lo < hi").select(*names, "lo", "hi").distinct().count():
        now = cut(_narrowed(keys, now, names, n_open))
    return now


def radix_quantiles(df: DataFrame, columns: list[str], ps: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., column, p, quantile) of numeric columns, by linear interpolation, NULL and NaN left out.

    As ``percentile`` has it: between two order statistics of different values the
    quantile is on the line, which is NaN from -infinity to infinity.  A group without a value in a column has no row for it.
    """
    by = by or []
    names = [*by, "column"]
    keys = _keys(df, columns, by)
    found = _passes(keys, _first(keys, names, ps), names).withColumn("x", key_double(F.col("lo")))
    pair = found.groupBy(*names, "p", "at").agg(F.min_by("x", "wanted").alias("a"), F.max_by("x", "wanted").alias("b"))
    line = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    return pair.select(*names, "p", line.alias("quantile"))
