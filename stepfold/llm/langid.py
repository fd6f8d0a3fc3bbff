"""Language identification by multilingual mixture inference.

A language's model is its distribution over hashed byte trigrams of lower-case
text.  A document is a mixture: expectation-maximisation finds the proportions
of languages under which its trigrams are most likely.  The set of languages is
chosen by penalised likelihood: languages are added in the order of their
proportions, each at the price of ``penalty * ln(n) / 2`` for n trigrams, up to all
learned ones, and the best set is taken.  The
prediction is the largest proportion of the chosen set, its score that proportion.

Training: trigram counts of whole texts of a sample of labelled rows, at most
about ``max_docs`` per language, picked by a hash of the id; the rows' counts are
summed by Spark, and only languages x ``DIMS`` sums come to the driver.

Defined results: null text and text without a letter give ``und`` with score 0,
and so does everything if there is nothing to learn from; a null id counts as
empty text for the held-out rule; repeated rows give repeated rows; of equal
proportions the language first in code-point order wins; a very long text is counted in
blocks; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

DIMS = 4096
_LETTER = regex.compile(r"\p{L}")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def counts(texts: list[str]) -> np.ndarray:
    """Hashed trigram counts, a row for each text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    step = 1 << 21
    for row, text in enumerate(texts):
        for lo in range(0, len(text), step):
            data = np.frombuffer(f" {text[lo : lo + step].lower()} ".encode(), np.uint8).astype(np.uint32)
            if len(data) > 2:
                gram = data[:-2] | data[1:-1] << 8 | data[2:] << 16
                out[row] += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    return out


class Model:
    def __init__(self, langs: list[str], totals: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        self.p = ((totals + smooth) / (totals + smooth).sum(axis=1, keepdims=True)).astype(np.float32)

    def _mixture(self, c: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log likelihood by EM, each row restricted to its allowed languages."""
        n = np.maximum(c.sum(axis=1, keepdims=True), 1)
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            pi = pi * ((c / (pi @ self.p)) @ self.p.T) / n
        return pi, (c * np.log(pi @ self.p)).sum(axis=1)

    def proportions(self, c: np.ndarray, penalty: float = 4.0, rounds: int = 8) -> np.ndarray:
        """Proportions over the languages of each row's chosen set; zero elsewhere."""
        full, likely = self._mixture(c, np.ones((len(c), len(self.langs)), np.float32), rounds)
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        n = c.sum(axis=1)
        cost = penalty * np.log(np.maximum(n, 2)) / 2
        # no mixture is likelier than this (Jensen): what a further language costs can then not come back
        grown = ((c / (full @ self.p)) @ self.p.T).max(axis=1) / np.maximum(n, 1)
        bound = likely + n * np.log(np.maximum(grown, 1))
        best, pi = np.full(len(c), -np.inf), np.zeros_like(full)
        left = np.arange(len(c))
        for k in range(1, len(self.langs) + 1):
            mix, likelihood = self._mixture(c[left], (rank[left] < k).astype(np.float32), rounds if k > 1 else 1)
            value = likelihood - cost[left] * k
            gain = value > best[left]
            pi[left[gain]], best[left[gain]] = mix[gain], value[gain]
            left = left[bound[left] - cost[left] * (k + 1) > best[left]]
            if not len(left):
                break
        return pi

    def predict(self, texts: list[str | None], batch: int = 128) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for lo in range(0, len(texts), batch):
            part = [t or "" for t in texts[lo : lo + batch]]
            if self.langs:
                pi = self.proportions(counts(part))
                top = pi.argmax(axis=1)
                share = np.clip(pi[np.arange(len(part)), top] / np.maximum(pi.sum(axis=1), 1e-30), 0, 1)
            for i, t in enumerate(part):
                known = bool(self.langs) and _LETTER.search(t) is not None
                langs.append(self.langs[top[i]] if known else "und")
                scores.append(float(share[i]) if known else 0.0)
        return langs, scores


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 3000, max_langs: int = 500) -> Model:
    """Learn from the rows given (the caller leaves out what is held out)."""
    labelled = labelled.filter(F.col(lang_col).isNotNull())
    there = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().limit(max_langs + 1).collect()}
    if len(there) > max_langs:
        raise ValueError(f"over {max_langs} languages")
    langs = sorted(there)
    if not langs:
        return Model([], np.zeros((0, DIMS)))
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, max_docs / there[k]))))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), DIMS))
        place = {k: i for i, k in enumerate(langs)}
        for b in batches:
            at = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
            for lo in range(0, b.num_rows, 128):
                np.add.at(total, at[lo : lo + 128], counts(b.column(1).slice(lo, 128).to_pylist()))
        row, col = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(total[row, col])], ["row", "col", "n"])

    total = np.zeros((len(langs), DIMS))
    for r in sample.mapInArrow(run, "row int, col int, n double").groupBy("row", "col").agg(F.sum("n").alias("n")).collect():
        total[r["row"], r["col"]] = r["n"]
    return Model(langs, total)


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: only the text is looked at."""
    shared = documents.sparkSession.sparkContext.broadcast((model.langs, model.p))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.langs, own.p = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                langs, scores = own.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def accepted(documents: DataFrame, model: Model, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The documents in a known language, all columns: not ``und``, and one language at ``least`` this strong."""
    shared = documents.sparkSession.sparkContext.broadcast((model.langs, model.p))
    place = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.langs, own.p = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                langs, scores = own.predict(part.column(place).to_pylist())
                yield part.filter(pa.array([k != "und" and s >= least for k, s in zip(langs, scores, strict=True)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
