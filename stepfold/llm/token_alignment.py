"""Alignment of two tokenisations: groups between common ends, links of overlapping tokens, counts of linked pairs.

Tokens are exploded with their positions, a windowed sum of their lengths gives their
ends, an equi-join of both sides on text and end gives the cuts (ends of both), a running
count of cuts numbers the groups, and links come from the joined ends by rank: between one end
and the next lies exactly one overlap, that of the next token to end on either side.  So
links are as many as there are different ends, whatever the size of a group.

That is done once for each different *piece* of the corpus, not for each of its
occurrences.  A text with a space before it is parted before a space that stands between
two characters that aren't white space, between a Latin letter and an ASCII character that
is no letter, and after a line feed that stands between two characters that aren't white space.  Both tokenisers
part there in any case (:func:`separable` checks the second's vocabulary; the first's
pattern ends its run of letters or of white space there), so tokens, groups and links of a text are those of its
pieces one after another.  Texts are read in blocks of about ``block_chars`` characters; a block
is one row with its documents as codes into a dictionary of its pieces, and a row for each
piece.  Equal pieces become one row with their places (block and code; of each ``NEAR_PARTS`` input
partitions, so that no row grows with the corpus), and what is found for it goes to those places,
where the blocks put their documents together.

Defined results: texts that are null, empty, or whose tokens' joined bytes differ from
space and text on either side have no tokens (zeros, '' for the groups) and count in no
pair; repeated rows count each time and give a row each; a long text, and a text that is one
piece, are read whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, shared_dir, text_or_empty
from .ranked import packed, unpacked

_LETTERS, _OTHERS = r"A-Za-zÀ-ÖØ-öø-ɏ", r"\x00-\x40\x5b-\x60\x7b-\x7f"
_CUT = rf"(?<=[{_LETTERS}])(?=[{_OTHERS}])|(?<=\S)(?= \S)|(?<=\S\n)(?=\S)"
#: A Latin word up to what isn't one, or what stands up to the next cut.
_PIECE = re.compile(rf" ?[{_LETTERS}]+(?=[{_OTHERS}]|\Z)|(?:[^{_LETTERS}\s]+\n?|[\s\S])(?:(?!{_CUT})[\s\S])*")
NEAR_PARTS = 4096
#: A block's number is its input partition's and so many bits for its place there; with 32 bits for the code it is one long.
BLOCK_BITS = 11


def pieces_of(text: str) -> list[str]:
    """The pieces of a text that isn't empty; joined they are a space and the text."""
    return _PIECE.findall(" " + text)


def kept(df: DataFrame) -> DataFrame:
    """Write once to the shared folder, compressed, and read from there."""
    path = f"{shared_dir(df.sparkSession)}/align-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizer(NamedTuple):
    """ids of each of some texts, and the bytes of an id."""

    encode: Callable[[list[str]], list[list[int]]]
    bytes_of: list[bytes]


def byte_level(path: str) -> Tokenizer:
    """A: texts are encoded as they are, strings of special tokens as plain text."""
    from tokenizers import Tokenizer as Own

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    own = Own.from_file(path)
    own.encode_special_tokens = True
    letters = _byte_letters()
    with open(path, encoding="utf-8") as f:
        special = {x["id"]: x["content"] for x in json.load(f).get("added_tokens", [])}
    names = sorted(own.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
    size = names[-1][1] + 1
    table = [b""] * size
    for name, i in names:
        table[i] = special[i].encode() if i in special else bytes(letters[c] for c in name)
    return Tokenizer(lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)], table)


def sentence_pieces(path: str) -> Tokenizer:
    """B: the model adds a space to what it encodes; what must not begin with one is encoded after a line feed."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    none = [own.is_control(i) or own.is_unknown(i) for i in range(len(names))]  # no text has these
    table = [b"" if none[i] else bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    skip = len(own.encode("\n"))

    def encode(texts: list[str]) -> list[list[int]]:
        begins = [len(t) > 1 and t[0] == " " for t in texts]  # to nothing at all it adds no space
        ids = own.encode([t[1:] if s else "\n" + t for t, s in zip(texts, begins, strict=True)], num_threads=1)
        return [x if s else x[skip:] for x, s in zip(ids, begins, strict=True)]

    return Tokenizer(encode, table)


def separable(b: Tokenizer) -> bool:
    """Whether no token goes on across a place where :func:`pieces_of` parts texts, nor across a line feed."""
    across = re.compile(rf"[{_LETTERS}][{_OTHERS}]|[^ ] |\n.|.\n", re.DOTALL)
    return not any(across.search(t.decode(errors="replace")) for t in b.bytes_of)


def blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1 << 24, part: bool = True) -> DataFrame:
    """block, and either ids, sizes, codes (of a block's documents) or code, piece, n (of its dictionary)."""
    rows = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, coded, number, held = TaskContext.get().partitionId() << BLOCK_BITS, [], [], {}, 0

        def flush(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(id_type)), ("sizes", pa.binary()), ("codes", pa.binary()), ("code", pa.int32()), ("piece", pa.string()), ("n", pa.int64())])
            n, names = np.bincount(np.concatenate(coded), minlength=len(number)), list(number)
            sizes = np.array([len(c) for c in coded], np.int64)
            codes = b"".join([packed(c.astype(np.int64))[0].tobytes() for c in coded])
            first = [[block], [ids], [packed(sizes)[0].tobytes()], [codes], [None], [None], [None]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(first, schema, strict=True)], schema=schema)
            for lo in range(0, len(names), 1 << 16):
                some = names[lo : lo + (1 << 16)]
                none = [pa.nulls(len(some), schema.field(c).type) for c in ("ids", "sizes", "codes")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), *none, pa.array(np.arange(lo, lo + len(some), dtype=np.int32)), pa.array(some, pa.string()), pa.array(n[lo : lo + len(some)])], schema=schema)

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                text = t.as_py()
                some = (pieces_of(text) if part else [" " + text]) if text else []
                ids.append(i.as_py())
                coded.append(np.array([number.setdefault(p, len(number)) for p in some], np.int32))
                held += len(text)
                if held >= block_chars:
                    yield from flush(batch.schema.field(0).type)
                    block, ids, coded, number, held = block + 1, [], [], {}, 0
                    if not block % (1 << BLOCK_BITS):
                        raise ValueError(f"an input partition has over {1 << BLOCK_BITS} blocks of {block_chars} characters")
        if ids:
            yield from flush(batch.schema.field(0).type)

    return rows.mapInArrow(run, f"block bigint, ids array<{kind}>, sizes binary, codes binary, code int, piece string, n bigint")


def encoded(pieces: DataFrame, a: Callable[[], Tokenizer], b: Callable[[], Tokenizer]) -> DataFrame:
    """``pieces`` with ok, n_a and the ids and lengths in bytes of both sides' tokens (the first n_a are A's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = a(), b()
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                texts = batch.column("piece").to_pylist()
                want = [t.encode() for t in texts]
                ok, ids, lens = np.ones(len(texts), bool), [], []
                for side in (one, two):
                    own = side.encode(texts)
                    parts = [[side.bytes_of[i] for i in x] for x in own]
                    ok &= np.fromiter((b"".join(p) == w and b"" not in p for p, w in zip(parts, want, strict=True)), bool, len(texts))
                    ids.append(own)
                    lens.append([[len(x) for x in p] for p in parts])
                both = [pa.array([x + y for x, y in zip(*side, strict=True)], pa.list_(pa.int32())) for side in (ids, lens)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok), pa.array([len(x) for x in ids[0]], pa.int32()), *both], [*batch.schema.names, "ok", "n_a", "ids", "lens"])

    fields = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return pieces.mapInArrow(run, f"{fields}, ok boolean, n_a int, ids array<int>, lens array<int>")


def _ends(dealt: DataFrame) -> DataFrame:
    """piece_id, n, end, a_ends, b_ends: each place where a token ends, with the ids that do.

    Both sides are exploded as one list.  The equi-join of their ends is a grouping by
    piece and end, which the partitioning by piece serves: nothing is shuffled.
    """
    each = dealt.select("piece_id", "n", "n_a", F.posexplode(F.arrays_zip(F.col("ids").alias("id"), F.col("lens").alias("len"))).alias("pos", "token"))
    each = each.select("piece_id", "n", (F.col("pos") >= F.col("n_a")).alias("second"), "pos", "token.id", "token.len")
    so_far = Window.partitionBy("piece_id", "second").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum("len").over(so_far))
    return each.groupBy("piece_id", "end").agg(F.max("n").alias("n"), F.max(F.when(~F.col("second"), F.col("id"))).alias("a_ends"), F.max(F.when(F.col("second"), F.col("id"))).alias("b_ends"))


def overlaps(dealt: DataFrame) -> DataFrame:
    """A row for each link: piece_id, n, end, in_group, a_id, b_id, a_ends, b_ends (the ids of tokens that end here).

    From the last end backwards a running count of cuts numbers the groups (downwards from
    -1), and the last id seen of each side is the token that covers what lies before the end.
    """
    back = Window.partitionBy("piece_id").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    is_cut = F.col("a_ends").isNotNull() & F.col("b_ends").isNotNull()
    return _ends(dealt).select(
        "piece_id",
        "n",
        "end",
        (-F.sum(is_cut.cast("int")).over(back)).alias("in_group"),
        F.last("a_ends", ignorenulls=True).over(back).alias("a_id"),
        F.last("b_ends", ignorenulls=True).over(back).alias("b_id"),
        "a_ends",
        "b_ends",
    )


def _text_of(groups: Column) -> Column:
    """``a1,a2|b1;a3|b2`` of a sorted array of (in_group, side, end, id); the column must be a plain attribute."""

    def one(x: Column, i: Column) -> Column:
        last = F.get(groups, i - 1)
        between = F.when(i == 0, "").when(last["in_group"] != x["in_group"], ";").when(last["side"] != x["side"], "|").otherwise(",")
        return F.concat(between, x["id"].cast("string"))

    return F.array_join(F.transform(groups, one), "")


def aligned(pieces: DataFrame) -> DataFrame:
    """piece_id, n, links (array of a_id, b_id), n_a, n_b, n_groups, text of each piece that both sides write as it is."""
    dealt = pieces.filter("ok").select("piece_id", "n", "n_a", "ids", "lens").repartition("piece_id")

    def tokens(side: str, number: int) -> Column:
        ends = F.col(f"{side}_ends")
        return F.collect_list(F.when(ends.isNotNull(), F.struct("in_group", F.lit(number).alias("side"), "end", ends.alias("id"))))

    each = overlaps(dealt).groupBy("piece_id").agg(
        F.max("n").alias("n"),
        F.collect_list(F.struct("a_id", "b_id")).alias("links"),
        F.count("a_ends").alias("n_a"),
        F.count("b_ends").alias("n_b"),
        (-F.min("in_group")).alias("n_groups"),
        F.array_sort(F.concat(tokens("a", 0), tokens("b", 1))).alias("groups"),
    )
    return each.withColumn("text", _text_of(F.col("groups"))).drop("groups")


def pair_counts(found: DataFrame) -> DataFrame:
    """a_id, b_id, count (links of the corpus that hold the pair), is_best (none of its B id's is higher), rows (of all pieces)."""
    pairs = found.select("n", F.inline("links")).groupBy("a_id", "b_id").agg(F.sum("n").alias("count"), F.count("*").alias("rows"))
    return pairs.withColumn("is_best", F.col("count") == F.max("count").over(Window.partitionBy("b_id")))


def counted(pieces: DataFrame, found: DataFrame, pairs: DataFrame, held: int = 1 << 20) -> DataFrame:
    """For each piece: places, NUMBERS but n_links, text.

    Up to ``held`` pairs (16 bytes each) go to every task, more are met by key, the hot ones salted.
    """
    total, number = pairs.agg(F.sum("rows"), F.count("*")).first()
    each = found.select("piece_id", F.inline("links"))
    if number <= held:
        each = each.join(F.broadcast(pairs.drop("rows")), ["a_id", "b_id"])
    else:
        each = lookup(each, pairs, ["a_id", "b_id"], "rows", max(total or 1, 1), ["piece_id"])
    sums = each.groupBy("piece_id").agg(F.count_if("is_best").alias("n_best"), F.sum("count").alias("count_sum"))
    return found.drop("links", "n").join(sums, "piece_id").join(pieces.select("piece_id", "places"), "piece_id").drop("piece_id")


def _part(block: Column) -> Column:
    return F.floor(block / float(NEAR_PARTS << BLOCK_BITS)).cast("int")


def _lost(coded: DataFrame, bad: DataFrame) -> DataFrame:
    """piece, part, lost: how often each piece occurs in documents that hold a piece of ``bad``."""
    words = coded.filter(F.col("piece").isNotNull()).join(bad.select("piece", F.lit(True).alias("bad")).distinct(), "piece", "left")
    touched = words.filter("bad").select("block").distinct()
    words = words.join(touched, "block", "left_semi").select("block", "code", "piece", F.coalesce("bad", F.lit(False)).alias("bad"))
    docs = coded.filter(F.col("piece").isNull()).join(touched, "block", "left_semi").select(F.col("block").alias("of"), "sizes", "codes")

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("code")
        flag = words.column("bad").to_numpy(zero_copy_only=False)
        lost = np.zeros(len(flag), np.int64)
        for sizes, codes in zip(docs.column("sizes"), docs.column("codes"), strict=True):
            codes, ends = unpacked(np.frombuffer(codes.as_py(), np.uint8)), np.cumsum(unpacked(np.frombuffer(sizes.as_py(), np.uint8)))
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if flag[codes[lo:hi]].any():
                    lost += np.bincount(codes[lo:hi], minlength=len(lost))
        at = np.flatnonzero(lost)
        of = np.full(len(at), docs.column("of")[0].as_py())
        return pa.table({"of": of, "piece": words.column("piece").take(pa.array(at)), "lost": pa.array(lost[at])})

    found = docs.groupBy("of").cogroup(words.groupBy("block")).applyInArrow(run, "of bigint, piece string, lost bigint")
    return found.groupBy("piece", _part(F.col("of")).alias("part")).agg(F.sum("lost").alias("lost"))


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _together(coded: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the documents, from their codes and ``found`` (places, NUMBERS, text); a piece without a row there spoils its documents."""
    kind = coded.schema["ids"].dataType.elementType.simpleString()
    sent = [c for c in NUMBERS if c != "n_links"]
    words = found.select(F.explode("places").alias("place"), *sent, "text")
    words = words.select(F.shiftright("place", 32).alias("block"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("code"), *sent, "text")
    docs = coded.filter(F.col("piece").isNull()).select(F.col("block").alias("of"), "ids", "sizes", "codes")
    id_type = coded.select(F.get("ids", F.lit(0)).alias("x")).limit(0).toArrow().schema.field(0).type

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        code, many = words.column("code").to_numpy(), words.num_rows
        each = [unpacked(np.frombuffer(c.as_py(), np.uint8)) for c in docs.column("codes")]
        size = 1 + max((int(c.max(initial=0)) for c in each), default=0)
        ok, value, text = np.zeros(size, bool), np.zeros((len(NUMBERS), size), np.int64), [""] * size
        ok[code] = True
        for name in sent:
            value[NUMBERS.index(name), code] = words.column(name).to_numpy() if many else 0
        # each end is a link's, and a cut ends a token on both sides
        value[NUMBERS.index("n_links")] = sum(value[NUMBERS.index(n)] for n in ("n_a", "n_b")) - value[NUMBERS.index("n_groups")]
        for k, t in zip(code.tolist(), words.column("text").to_pylist(), strict=True):
            text[k] = t
        ids, rows, digests = [], [], []
        for own, sizes, codes in zip(docs.column("ids"), docs.column("sizes"), each, strict=True):
            ends = np.cumsum(unpacked(np.frombuffer(sizes.as_py(), np.uint8)))
            ids += own.as_py()
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                part = codes[lo:hi]
                if len(part) and ok[part].all():
                    rows.append(value[:, part].sum(axis=1))
                    digests.append(hashlib.sha256(";".join([text[k] for k in part.tolist()]).encode()).hexdigest())
                else:
                    rows.append(np.zeros(len(NUMBERS), np.int64))
                    digests.append("")
        columns = np.array(rows, np.int64).reshape(-1, len(NUMBERS)).T
        return pa.Table.from_arrays([pa.array(ids, id_type), *map(pa.array, np.ascontiguousarray(columns)), pa.array(digests, pa.string())], ["doc_id", *NUMBERS, "groups_sha256"])

    fields = ", ".join(f"{c} bigint" for c in NUMBERS)
    return docs.groupBy("of").cogroup(words.groupBy("block")).applyInArrow(run, f"doc_id {kind}, {fields}, groups_sha256 string")


class Alignment(NamedTuple):
    documents: DataFrame  #: doc_id, NUMBERS, groups_sha256
    pieces: DataFrame  #: see encoded()
    found: DataFrame  #: of pieces, see aligned()
    pairs: DataFrame  #: a_id, b_id, count, is_best


def align(documents: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1 << 24, held: int = 1 << 20) -> Alignment:
    """Align the tokens of a byte-level model (``a_path``) with those of a sentencepiece model (``b_path``)."""
    part = separable(sentence_pieces(b_path))
    coded = kept(blocks(documents, id_col, text_col, block_chars, part))
    words = coded.filter(F.col("piece").isNotNull()).withColumn("part", _part(F.col("block")))
    distinct = words.groupBy("piece", "part").agg(F.sum("n").alias("n"), F.collect_list(F.shiftleft("block", 32) + F.col("code")).alias("places"))
    numbered = distinct.select(F.monotonically_increasing_id().alias("piece_id"), "piece", "part", "n", "places")
    pieces = kept(encoded(numbered, lambda: byte_level(a_path), lambda: sentence_pieces(b_path)))
    bad = pieces.filter(~F.col("ok"))
    if not bad.isEmpty():
        left = pieces.join(_lost(coded, bad.select("piece")), ["piece", "part"], "left")
        pieces = kept(left.withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))).select(*pieces.columns))
    found = kept(aligned(pieces))
    pairs = kept(pair_counts(found))
    return Alignment(_together(coded, counted(pieces, found, pairs, held)), pieces, found, pairs)
