"""Language identification by a string kernel: n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge regression.

Kernel (blended spectrum): texts are lower-cased, everything but letters becomes single spaces, and a text's features are the byte
n-grams of 2, 3 and 4 bytes that are present in it. For each n the kernel of two texts is the number of grams both have,
divided by the geometric mean of their numbers of grams; the blend is the mean over n. Grams are those whose presence
varies most over the landmarks.

Fit: at most ``PER_LANG`` labelled documents of each language (those with the smallest hash of their id) are the training rows,
however often a document is repeated (of rows with one id and language the one of the smallest hash of its text), the first ``LANDMARKS`` of each of them landmarks. With C the kernel between training rows and landmarks and W the one
among landmarks, every language has the coefficients a = (C'C + ridge W)^-1 C'y, y = 1 for its rows and -1 for others.

Score: a text's kernel row against the landmarks times a. As the kernel is a product of presence vectors, landmarks and
coefficients are multiplied once into one matrix per n, and a batch of texts is scored by products of presence matrices
with it; texts are read whole, and memory is bounded by a slice of text and a fixed number of grams.

``lang_pred`` is the language of the largest score, ``score`` is (1 + that score) / 2 within 0 and 1. Edge cases: a text that is
NULL or has no letter is ``und`` with score 0; with no training rows everything is ``und``; equal scores go to the first
language in alphabetical order; rows without an id or a language are never trained on; other columns are kept. Two short-
comings of a bounded fit: a language with no training row can't be predicted, and a rare one has few rows to learn from.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import give_back, small_batches

PER_LANG, LANDMARKS = 512, 64
SIZES = {2: 1024, 3: 4096, 4: 4096}
RIDGE = 1e-3
SLOTS = 1 << 20
SLICE = 1 << 18
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)
UND = "und"


def letters(text: str, first: bool = True, last: bool = True) -> np.ndarray:
    """Lower-case UTF-8 bytes with single spaces for all that is no letter; a space at the text's ends."""
    b = LETTERS[np.frombuffer(f"{' ' * first}{text.lower()}{' ' * last}".encode("utf-8", "replace"), np.uint8)]
    return b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]


def codes(b: np.ndarray, n: int) -> np.ndarray:
    """Every n-gram as a number."""
    if len(b) < n:
        return np.zeros(0, np.uint32)
    out = b[: len(b) - n + 1].astype(np.uint32)
    for i in range(1, n):
        out = (out << np.uint32(8)) | b[i : len(b) - n + 1 + i]
    return out


def slot(c: np.ndarray) -> np.ndarray:
    return (c * np.uint32(2654435761)) >> np.uint32(12)


class Grams:
    """The chosen grams of one size and where they are."""

    def __init__(self, chosen: np.ndarray):
        """Grams that share a slot with an earlier one are left out, so a look-up is one access and a comparison."""
        at = slot(chosen)
        first = np.unique(at, return_index=True)[1]
        self.codes = chosen[np.sort(first)]

    def __len__(self) -> int:
        return len(self.codes)

    def table(self) -> np.ndarray:
        table = np.zeros(SLOTS, np.int16)
        table[slot(self.codes)] = np.arange(len(self.codes))
        return table

    def present(self, c: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in c, gram numbers) of chosen grams."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = table[slot(c)]
        at = np.flatnonzero(self.codes[g] == c)
        return at, g[at]


class Model:
    def __init__(self, langs: list[str], grams: dict[int, Grams], weights: dict[int, np.ndarray]):
        self.langs, self.grams, self.weights = langs, grams, weights
        self.tables: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.langs, self.grams, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        """texts x languages, 256 texts at a time."""
        if not self.tables:
            self.tables = {n: g.table() for n, g in self.grams.items()}
        texts = list(texts)
        parts = [self._scores(texts[at : at + 256]) for at in range(0, len(texts), 256)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)

    def _scores(self, texts: list[str]) -> np.ndarray:
        present = {n: np.zeros((len(texts), max(len(g), 1)), np.float32) for n, g in self.grams.items()}
        pieces, owners, size = [], [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), SLICE):  # pieces of a long text share three characters
                last = at + SLICE >= len(text)
                pieces.append(letters(text[max(0, at - 3) : at + SLICE], at == 0, last))
                owners.append(i)
                size += len(pieces[-1])
                if size >= SLICE:
                    self._mark(pieces, owners, present)
                    pieces, owners, size = [], [], 0
        self._mark(pieces, owners, present)
        total = np.zeros((len(texts), len(self.langs)), np.float32)
        for n, p in present.items():
            total += (p @ self.weights[n]) / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))
        return total

    def _mark(self, pieces: list[np.ndarray], owners: list[int], present: dict[int, np.ndarray]) -> None:
        if not pieces:
            return
        b = np.concatenate(pieces)
        piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        owner = np.array(owners)
        for n, g in self.grams.items():
            at, gram = g.present(codes(b, n), self.tables[n])
            inside = piece[at] == piece[at + n - 1]
            present[n][owner[piece[at[inside]]], gram[inside]] = 1


def presence(held: list[np.ndarray], g: Grams) -> np.ndarray:
    """Rows of presence over square root of their number, for texts given by their distinct grams."""
    table, p = g.table(), np.zeros((len(held), max(len(g), 1)))
    for i, c in enumerate(held):
        p[i, g.present(c, table)[1]] = 1
    return p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))


def fit(rows: Iterable[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model from (text, language) rows; only the distinct grams of each text are kept in memory."""
    held: dict[int, list[np.ndarray]] = {n: [] for n in SIZES}
    labels: list[str] = []
    for text, lang in rows:
        b = letters(text)
        for n in SIZES:
            held[n].append(np.unique(codes(b, n)))
        labels.append(lang)
    if not labels:
        return None
    langs, y = np.unique(np.array(labels, object), return_inverse=True)
    marks = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(langs))])
    grams, kernel, rows_of = {}, 0, {}
    for n, most in SIZES.items():
        seen, count = np.unique(np.concatenate([held[n][i] for i in marks]), return_counts=True)
        share = count / len(marks)
        grams[n] = Grams(seen[np.argsort(-(share * (1 - share)), kind="stable")[:most]])
        p = presence(held[n], grams[n])
        rows_of[n] = p[marks]
        kernel = kernel + p @ p[marks].T / len(SIZES)
    among = kernel[marks]
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    system = kernel.T @ kernel + ridge * len(labels) * among + 1e-8 * len(labels) * np.eye(len(marks))
    a = np.linalg.solve(system, kernel.T @ target)
    return Model(list(langs), grams, {n: (p.T @ a / len(SIZES)).astype(np.float32) for n, p in rows_of.items()})


def chosen_rows(docs: DataFrame, keep: Column, per_lang: int = PER_LANG) -> DataFrame:
    """(text, lang) of at most ``per_lang`` documents of each language among ``keep``, those of the smallest hash of ``doc_id``.

    Rows are first reduced to one an id, combined before the shuffle, and ranked without texts (each task passes on ``per_lang`` ids a
    language at most); then the few chosen texts are read, equal ones once.
    """
    rows = docs.where(F.coalesce(keep, F.lit(False)) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rows = rows.select("lang", "doc_id", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.xxhash64("text").alias("t"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = rows.groupBy("lang", "doc_id", "h").agg(F.min("t").alias("t"))
    ranked = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang).drop("r")
    # A row per training document, a bounded number for each language.
    return rows.join(F.broadcast(ranked), ["lang", "doc_id", "h", "t"], "left_semi").distinct().select("text", "lang", "h")


def trained(docs: DataFrame, keep: Column, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> Model | None:
    """A model fitted in one task on the bounded sample."""

    def run(batches):
        rows = ((t, g) for b in batches for t, g in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()))
        model = fit(rows, landmarks)
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    sample = chosen_rows(docs, keep, per_lang).repartition(1).sortWithinPartitions("h", "text").select("text", "lang")
    row = sample.mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else None


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the text alone; one pass, no shuffle."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        s = model.scores(text)
        give_back()
        best = s.argmax(axis=1)
        score = np.clip((1 + s[np.arange(len(s)), best]) / 2, 0, 1).astype(np.float64)
        return pd.DataFrame({"lang_pred": np.array(model.langs, object)[best], "score": score})

    small_batches(docs.sparkSession)
    spoken = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UND)).withColumn("score", F.lit(0.0))
    out = docs.withColumn("__lang", predict(F.coalesce("text", F.lit(""))))
    pred = F.when(spoken, F.col("__lang.lang_pred")).otherwise(UND)
    return out.withColumn("lang_pred", pred).withColumn("score", F.when(spoken, F.col("__lang.score")).otherwise(0.0)).drop("__lang")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op5_string_kernel(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = trained(docs, ~held_out())
    return predicted(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_string_kernel": op5_string_kernel}
