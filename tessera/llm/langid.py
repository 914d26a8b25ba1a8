"""Language identification by word-first backoff.

Known words score by their per-language log frequency; an unseen word falls back to its
character n-grams, from the longest down to single characters.

The model is fitted on a bounded sample of labelled rows: at most PER_LANGUAGE documents
of each label, chosen by a hash of the id. All words and n-grams that the sample holds are
known with their counts in every language. The model's size follows the sample alone, so it can be
sent to every executor. Prediction covers every whole text and reads nothing but the text.

Defined cases: null text, or text without letters: ``und`` with score 0; no labelled
rows at all: ``und``; ties go to the label that sorts first; equal texts get equal
predictions; null ids are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm import common as C

PER_LANGUAGE, ORDER = 1500, 5
FOLDS, HELD_OUT = 4, 2
UND = "und"

_letters = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> Counter:
    """Lower-cased runs of letters and how often each occurs."""
    found = Counter(_letters.findall(text.lower()))
    return found if all(map(str.isalpha, found)) else Counter({w: n for w, n in found.items() if w.isalpha()})


def grams(word: str, order: int):
    """Positions of the bounded word, each with its n-grams from the longest to one character."""
    w = f"^{word}$"
    return [[w[k : k + n] for n in range(min(order, len(w) - k), 0, -1)] for k in range(len(w))]


def _count(order: int):
    def run(rows):
        words, chars = defaultdict(Counter), defaultdict(Counter)
        for b in C.batches(rows):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words[lang].update(tokens(text or ""))
        for lang, found in words.items():
            for w, n in found.items():
                for at in grams(w, order):
                    for g in at:
                        chars[lang][g] += n
        for kind, table in enumerate((words, chars)):
            for lang, found in table.items():
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(found), pa.int32()), pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["kind", "lang", "item", "n"])

    return run


class Model:
    """Log probabilities: a row for each known word and n-gram, a column for each language.

    The counts stay an Arrow table until words, n-grams or tables are first asked for. So the driver, which only sends
    the model on, never builds them, and a worker builds them once.
    """

    def __init__(self, counts: pa.Table, totals: dict[tuple[int, str], int], order: int):
        """``counts``: kind (0 word, 1 n-gram), lang, item, n; one row each."""
        self.order, self.langs = order, sorted({lang for _, lang in totals})
        self.counts, self.totals = counts, totals

    def __getattr__(self, name: str):
        if name not in ("words", "chars", "tables") or "counts" not in self.__dict__:
            raise AttributeError(name)
        self._build(self.__dict__.pop("counts"), self.totals)
        return self.__dict__[name]

    def _build(self, counts: pa.Table, totals: dict[tuple[int, str], int]) -> None:
        at = {lang: k for k, lang in enumerate(self.langs)}
        self.words, self.chars = ({}, {})  #: row of each known word, of each known n-gram
        self.tables = []
        for kind, index in ((0, self.words), (1, self.chars)):
            some = counts.filter(pc.equal(counts.column("kind"), kind))
            items = some.column("item").combine_chunks().dictionary_encode()
            items = items if isinstance(items, pa.DictionaryArray) else items.combine_chunks()
            index.update((x, k) for k, x in enumerate(items.dictionary.to_pylist()))
            table = np.zeros((len(index), len(at)), np.float32)
            table[items.indices.to_numpy(), [at[x] for x in some.column("lang").to_pylist()]] = some.column("n").to_numpy()
            total = np.array([totals.get((kind, lang), 0) for lang in self.langs], np.float32)
            table = np.log((table + np.float32(0.5)) / (total + np.float32(0.5) * (len(index) + 1)))
            if kind:  # n-grams overlap: each counts by its length
                table /= np.fromiter(map(len, index), np.float32, len(index))[:, None]
            self.tables.append(table.astype(np.float32))

    def backoff(self, w: str) -> list[int]:
        """Rows of the longest known n-gram at each position of an unseen word."""
        w, out, get, order = f"^{w}$", [], self.chars.get, self.order
        for k in range(len(w)):
            for n in range(order, 0, -1):
                row = get(w[k : k + n])
                if row is not None:
                    out.append(row)
                    break
        return out

    def word(self, w: str) -> np.ndarray:
        """Evidence of one word for each language."""
        row = self.words.get(w)
        return self.tables[0][row] if row is not None else self.tables[1][self.backoff(w)].sum(axis=0)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on rows with a label whose fold is not held out, at most ``per_language`` of each label."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.filter(F.col("lang").isNotNull() & (C.fold(F.col("doc_id"), FOLDS) != HELD_OUT)).withColumn("h", F.xxhash64("doc_id"))
    sizes = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, (1.3 * per_language + 20) / n)).otherwise(share)
    some = d.filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)) if sizes else d
    some = some.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= per_language)
    counted = some.select("lang", "text").mapInArrow(_count(order), "kind int, lang string, item string, n long").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n")).persist()  # bounded by the sample; lost blocks are counted again
    totals = {(r["kind"], r["lang"]): r["n"] for r in counted.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    # the sample bounds this table
    table = counted.orderBy("kind", "item", "lang").select("kind", "lang", "item", "n").toArrow()
    counted.unpersist()
    return Model(table, totals, order)


class _Seen(dict):
    """Row of each word's evidence in ``table``: the known words, and unseen words met lately."""

    NEW, FLOATS = 400_000, 4 << 20  #: unseen words held at most, and their evidence

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.LIMIT = len(model.words) + max(1000, min(self.NEW, self.FLOATS // max(1, len(model.langs))))
        self.model, self.table, self.new = model, np.zeros((self.LIMIT, len(model.langs)), np.float32), []
        self.table[: len(model.words)] = model.tables[0]

    def __missing__(self, w: str) -> int:
        k = self[w] = len(self)
        self.new.append(w)
        return k

    def score(self, found: Counter) -> np.ndarray:
        if len(self) + len(found) > self.LIMIT:
            self.clear()
            self.update(self.model.words)
            if len(self) + len(found) > self.LIMIT:
                return sum(n * self.model.word(w) for w, n in found.items())
        rows = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if self.new:
            parts = [self.model.backoff(w) for w in self.new]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            sums = np.vstack([np.zeros((1, self.table.shape[1])), self.model.tables[1][np.fromiter((r for p in parts for r in p), np.int64, sizes.sum())].cumsum(axis=0, dtype=np.float64)])
            ends = sizes.cumsum()
            self.table[len(self) - len(parts) : len(self)] = sums[ends] - sums[ends - sizes]
            self.new.clear()
        return np.fromiter(found.values(), np.float64, len(found)) @ self.table[rows]


def _predict(shared):
    def run(rows):
        model = shared.value
        seen = _Seen(model)
        for b in C.cut(rows, 2000, 16 << 20):
            langs, scores = [], []
            for text in b.column(1).to_pylist():
                found = tokens(text) if text else None
                if not found or not model.langs:
                    langs.append(UND)
                    scores.append(0.0)
                    continue
                s = seen.score(found)
                best = int(s.argmax())
                langs.append(model.langs[best])
                scores.append(1 / math.fsum(np.exp(s - s[best])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): score is the posterior of the predicted language under equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return C.id_text(docs, id_col, text_col).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``documents``, the model fitted on its other folds.

    Null text or text without letters: ``und``, 0; null ids are kept and count as empty text in the fold; ties go
    to the label that sorts first; an empty table gives no rows; other columns are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = predict(docs, fit(docs))
    return got.select("doc_id", (C.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


LEAST_SCORE = 0.5


def _keep(shared, least):
    def run(rows):
        predict_rows = _predict(shared)
        for b in C.cut(rows, 2000, 16 << 20):
            names = b.schema.names
            part = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(names.index("text"))], ["doc_id", "text"])
            ok: list[bool] = []
            for got in predict_rows(iter([part])):  # a slice may come back in several pieces
                ok += [lang != UND and score >= least for lang, score in zip(got.column(1).to_pylist(), got.column(2).to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_()))

    return run


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` (all columns as they are) whose text has letters and whose predicted language is at least ``least_score`` likely."""
    C.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return docs.mapInArrow(_keep(shared, least_score), docs.schema)
