"""Personal data: fixed patterns and terms that disclose what the patterns protect.

DataFrame functions only.  E-mail addresses, IP addresses, card and phone numbers
are found by pattern; each distinct value is a protected entity.  The words of a
document outside its e-mail addresses are its terms, those of documents with an
entity its candidates.  Over the whole corpus, the different texts with the entity, with
the term and with both give the pointwise mutual information PMI(e; t), and the entity's
information content is IC(e) = -log p(e).  PMI reaches IC exactly when the term never
occurs without the entity.  A term discloses an entity where both are together in at
least ``support`` different texts (copies are no further evidence) and PMI is at least
``threshold`` * IC; its occurrences in every document with the entity are spans of kind
``term``.  ``sanitise`` generalises base spans to their kind and removes disclosing terms.

Only entities in ``support`` texts make pairs: a text makes its distinct terms times
its distinct such entities.  Texts with a term are counted over the whole corpus, for
the terms that the texts with entities leave possible.  Copies and common entities
are salted in every join.

The patterns are written so that Java's matcher needs no recursion and no second
look at a run: a match may start at a run's start or at the previous match's end.
Positions come from the lengths of the matches and of the pieces between them.

Spans are code points, end exclusive.  Defined results: null text counts as empty
and has no spans; repeated rows give repeated rows; an empty table gives no rows; a long
text is one value, looked at by linear patterns; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, text_or_empty

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?![A-Za-z0-9-]|\.[A-Za-z0-9-])",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){15})[0-9][0-9\x20-]*?(?![0-9]|[\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"\A{_PART}\.{_PART}\.{_PART}\.{_PART}\z"
_BLOCK = 128
_SPANS = "array<struct<kind:string,start:int,end:int>>"
_FOUND = "array<struct<kind:string,start:int,end:int,entity:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; what a lambda captures is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(lengths: Column) -> Column:
    """Inclusive prefix sums of an int array, in blocks, so that long arrays aren't copied for each element."""
    zero = F.array().cast("array<int>")

    def total(block):
        return F.aggregate(block, F.lit(0), lambda a, x: a + x)

    def running(block, at):
        empty = F.struct(zero.alias("a"), at.alias("s"))
        return F.aggregate(block, empty, lambda acc, x: F.struct(F.concat(acc["a"], F.array(acc["s"] + x)).alias("a"), (acc["s"] + x).alias("s")))["a"]

    def offsets(blocks):
        return F.aggregate(blocks, F.struct(zero.alias("a"), F.lit(0).alias("s")), lambda acc, b: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"), (acc["s"] + total(b)).alias("s")))["a"]

    def blocks(values):
        last = F.ceil(F.size(values) / _BLOCK).cast("int") - 1
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))).otherwise(F.array().cast("array<array<int>>"))

    return _let(lengths, lambda values: _let(blocks(values), lambda bs: F.flatten(F.zip_with(bs, offsets(bs), running))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c, i):
        d = c.cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(_IP)
    n = F.length(_digits(m))
    return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(False) if kind == "card" else n.between(8, 15)


def _entity(kind: str, m: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(m) if kind in ("email", "ip") else _digits(m))


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, m, before, after) of a pattern's matches and the pieces between them."""
    both = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(x):
        ends = _sums(F.zip_with(x["p"], x["m"], lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0))))
        return _let(
            ends,
            lambda e: F.transform(x["m"], lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), m.alias("m"), F.get(x["p"], i).alias("before"), F.get(x["p"], i + 1).alias("after"))),
        )

    return _let(both, placed)


def _found(text: Column) -> Column:
    """Array of (kind, start, end, entity), by kind as listed, then start."""
    found = []
    for kind in KINDS:
        good = F.filter(_located(text, PATTERNS[kind]), lambda x: _passes(kind, x["m"]))
        found.append(F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), _entity(kind, x["m"]).alias("entity"))))
    return F.concat(*found)


def _term(shortest: int) -> str:
    return rf"\p{{L}}{{{shortest},}}"


def _terms(text: Column, shortest: int) -> Column:
    """The distinct terms of a text: lower-case words outside its e-mail addresses, the one kind that holds letters."""
    free = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(free, F.lit(_term(shortest)), F.lit(0)), lambda m: F.lower(m)))


def _word_spans(text: Column, shortest: int) -> Column:
    """Array of (term, start, end) of every word outside e-mail addresses that may be a term."""
    both = F.struct(F.split(text, PATTERNS["email"], -1).alias("p"), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)).alias("m"))

    def words(part, at):
        return F.transform(_located(part, _term(shortest)), lambda w: F.struct(F.lower(w["m"]).alias("term"), (at + w["start"]).alias("start"), (at + w["start"] + F.length(w["m"])).alias("end")))

    def pieces(x):
        ends = _sums(F.zip_with(x["p"], x["m"], lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0))))
        return _let(ends, lambda e: F.flatten(F.transform(x["p"], lambda p, i: words(p, F.when(i > 0, F.get(e, i - 1)).otherwise(0)))))

    return _let(both, pieces)


def _possible(text: Column) -> Column:
    """False for texts that no pattern can match; most texts end at the cheap first look."""
    return text.rlike("[@+0-9]") & text.rlike(r"@|\+[0-9]|[0-9]\.[0-9]|[0-9][0-9\x20-]{14}")


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def looked_at(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2, base, entities, text: a row for each row, text null where there is no entity.

    It is computed once, into the shared folder, so that the patterns run once.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("doc_id", *_key(F.col("text")), "text", F.when(_possible(F.col("text")), _found(F.col("text"))).otherwise(F.array().cast(_FOUND)).alias("found"))
    base = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    entities = F.array_distinct(F.transform("found", lambda x: x["entity"]))
    return cut(rows.select("doc_id", "k1", "k2", base.alias("base"), entities.alias("entities"), F.when(F.size("found") > 0, F.col("text")).alias("text")))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """k1, k2, text, entities, copies: a row for each different text with an entity, computed once."""
    held = rows.filter(F.col("text").isNotNull()).groupBy("k1", "k2")
    return cut(held.agg(F.first("text").alias("text"), F.first("entities").alias("entities"), F.count("*").alias("copies")))


def _pairs(seen: DataFrame, support: int, shortest: int) -> DataFrame:
    """k1, k2, entity, n_entity, term: the terms of each different text with each of its entities that ``support`` of them hold."""
    held = seen.select("k1", "k2", F.explode("entities").alias("entity"))
    entity = cut(held.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= support))
    held = lookup(held, entity.withColumn("__n", F.col("n_entity")), ["entity"], "__n", held.count(), ["k1"])
    terms = seen.select("k1", "k2", _terms(F.col("text"), shortest).alias("terms"))
    return held.join(terms, ["k1", "k2"]).select("k1", "k2", "entity", "n_entity", F.explode("terms").alias("term"))


def _texts_with(documents: DataFrame, terms: DataFrame, text_col: str, shortest: int, broadcast_terms: int) -> DataFrame:
    """t, n_term: in how many different texts of all each of ``terms`` (t) is."""
    each = documents.select(*_key(text_or_empty(text_col)), F.explode(_terms(text_or_empty(text_col), shortest)).alias("t"))
    if terms.count() <= broadcast_terms:
        each = each.join(F.broadcast(terms), "t", "left_semi")
    else:  # as terms may be common, each goes to sixteen tasks
        wide = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        each = each.withColumn("salt", F.pmod("k1", F.lit(16)).cast("int")).join(wide, ["t", "salt"], "left_semi")
    return each.groupBy("t", "k1", "k2").count().groupBy("t").agg(F.count("*").alias("n_term"))


def disclosing_terms(documents: DataFrame, rows: DataFrame, seen: DataFrame | None = None, text_col: str = "text", support: int = 3, threshold: float = 0.9, shortest: int = 4, broadcast_terms: int = 100_000) -> DataFrame:
    """(entity, term, n_both, n_entity, n_term, disclosure) of the terms that disclose an entity.

    ``rows`` is what ``looked_at`` gives, ``seen`` what ``distinct_texts`` makes of
    it.  The numbers of texts, entities and terms are single numbers; everything else
    stays distributed.
    """
    seen = distinct_texts(rows) if seen is None else seen
    n = float(max(rows.select("k1", "k2").distinct().count(), 1))
    both = _pairs(seen, support, shortest).groupBy("entity", "n_entity", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= support)
    # a term's texts are at least those with an entity: common words end here
    least = seen.select(F.explode(_terms(F.col("text"), shortest)).alias("t")).groupBy("t").agg(F.count("*").alias("n_seen"))

    def disclosure(n_term: Column) -> Column:
        content = -F.log(F.least(F.col("n_entity") / n, F.lit(1.0)))
        pmi = F.log(F.col("n_both") * n / (F.col("n_entity") * n_term))
        # where an entity is in every document nothing more can be disclosed
        return F.when(content > 0, pmi / content).otherwise(0.0)

    both = both.join(least, F.col("term") == F.col("t")).filter(disclosure(F.col("n_seen")) >= threshold)
    both = cut(both.select("entity", "n_entity", "term", "n_both"))
    words = _texts_with(documents, both.select(F.col("term").alias("t")).distinct(), text_col, shortest, broadcast_terms)
    joined = both.join(words, F.col("term") == F.col("t"))
    return joined.select("entity", "term", "n_both", "n_entity", "n_term", disclosure(F.col("n_term")).alias("disclosure")).filter(F.col("disclosure") >= threshold)


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, shortest: int = 4, **options) -> DataFrame:
    """doc_id, k1, k2, base and terms (arrays of (kind, start, end)): a row for each row.

    What a text discloses depends on the text alone, so rows with an entity meet their
    terms by a 128-bit key of the text and copies are looked at together.
    """
    rows = looked_at(documents, id_col, text_col)
    seen = distinct_texts(rows)
    told = cut(disclosing_terms(documents, rows, seen, text_col, support=support, shortest=shortest, **options).select("entity", "term", "n_both"))
    total = told.agg(F.sum("n_both")).first()[0] or 0
    hit = lookup(_pairs(seen, support, shortest), told, ["entity", "term"], "n_both", total, ["k1"], "left_semi")
    # the words of texts with a disclosing term meet the text's terms by key, however many there are of either
    said = cut(hit.select("k1", "k2", "term").distinct())
    words = seen.join(said.select("k1", "k2").distinct(), ["k1", "k2"]).select("k1", "k2", F.inline(_word_spans(F.col("text"), shortest)))
    each = F.array_sort(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end")))
    terms = words.join(said, ["k1", "k2", "term"]).groupBy("k1", "k2").agg(each.alias("terms"))
    spans = cut(terms.join(seen.select("k1", "k2", "copies"), ["k1", "k2"]))
    none = F.array().cast(_SPANS)
    rows = rows.drop("entities")
    free = rows.filter("text IS NULL").select("doc_id", "k1", "k2", "base", none.alias("terms"))
    held = lookup(rows.filter("text IS NOT NULL").drop("text"), spans, ["k1", "k2"], "copies", rows.count(), ["doc_id", F.spark_partition_id()], "left")
    return held.select("doc_id", "k1", "k2", "base", F.coalesce("terms", none).alias("terms")).unionAll(free)


def digest_columns(found: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = [F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    both = F.concat("base", "terms")
    return found.select("doc_id", *count, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(both).alias("spans"))


def rewritten(text: Column, spans: Column) -> Column:
    """``text`` with base spans generalised to ``[kind]`` and terms removed; overlapping spans go together."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("inv"), x["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(acc, x):
        label = F.when(x["kind"] == "term", "").otherwise(F.concat(F.lit("["), x["kind"], F.lit("]")))
        fresh = x["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), label)).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], -x["inv"]).alias("at"))

    return F.aggregate(ordered, start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, with their texts rewritten; a text without spans is unchanged."""
    spans = find(documents, id_col, text_col, **options).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.concat("base", "terms").alias("__spans")).filter(F.size("__spans") > 0)
    spans = cut(spans.groupBy("__k1", "__k2").agg(F.first("__spans").alias("__spans"), F.count("*").alias("__n")))
    text = text_or_empty(text_col)
    k1, k2 = _key(text)
    # only texts that a pattern may match are dealt out
    some = documents.filter(_possible(text)).withColumns({"__k1": k1, "__k2": k2})
    joined = lookup(some, spans, ["__k1", "__k2"], "__n", documents.count(), ["__k1", F.spark_partition_id()], "left")
    new = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(rewritten(text, F.col("__spans")))
    return joined.withColumn(text_col, new).select(*documents.columns).unionAll(documents.filter(~_possible(text)))
