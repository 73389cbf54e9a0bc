"""Language identification with a string kernel.

Two texts are compared by the blended spectrum presence kernel: the number of
distinct character n-grams (n = 1..3) they share, divided by the root of the
product of their own numbers. A Nystroem map over landmark texts makes the
kernel a finite feature map, and one-versus-rest kernel ridge regression is
solved in it on a bounded, language-balanced sample of the labelled rows (the
bounds are parameters of ``fit``).

Landmark kernels are one product of the texts' n-gram presence with the
landmarks' presence, and scores one more with the regression weights; the two
right-hand factors are multiplied once, so a batch of texts is scored by a
single sparse product with a table of (n-gram, language) weights.

One-versus-rest values say little of a text in none of the languages: they are
near each other or, without known n-grams, all 0. What tells it is how clearly
one language is ahead: the share of its n-grams that the landmarks know times the
margin of the best value over the second. A text counts as known from a quarter
of the lowest percentile that rows of the learned languages reach in folds of the
fit that leave them out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.llm.common import set_aside, written

UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray:
    """Sorted distinct n-grams (n = 1..3) of the lower-cased text, every run of
    non-letters one space; code points packed 21 bits each. Empty without a letter."""
    plain = _NOT_LETTERS.sub(" ", text.lower())
    if not any(map(str.isalpha, plain)):
        return np.empty(0, dtype=np.int64)
    c = np.frombuffer(f" {plain.strip()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    return np.unique(np.concatenate([c, two, three]))


@dataclass
class Landmarks:
    """Sorted n-grams of all landmarks and, per n-gram, the landmarks that have it."""

    grams: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> "Landmarks":
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        flat = np.concatenate(texts)
        order = np.argsort(flat, kind="stable")
        every, first = np.unique(flat[order], return_index=True)
        return cls(every, np.append(first, len(flat)), owner[order], np.array([len(t) for t in texts]))

    def places(self, g: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        return at[self.grams[at] == g]

    def kernel(self, g: np.ndarray) -> np.ndarray:
        at = self.places(g)
        n = self.first[at + 1] - self.first[at]
        hits = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.owners[hits], minlength=len(self.sizes))
        return shared / np.sqrt(max(len(g), 1) * self.sizes)


@dataclass
class LanguageModel:
    langs: list[str]
    grams: np.ndarray            # sorted
    weights: np.ndarray          # (n-gram, language)
    least_clear: float = 0.0     # below: in none of the languages
    common: int = 0              # number of the most frequent language

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Regression values (text, language): one sparse product for the batch."""
        return self._scores(texts)[0]

    def _scores(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Regression values and the share of each text's n-grams that landmarks have."""
        out, share = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        full = [i for i, t in enumerate(texts) if len(t)]
        if not full or not len(self.grams):
            return out, share
        size = np.array([len(texts[i]) for i in full])
        flat = np.concatenate([texts[i] for i in full])
        at = np.minimum(np.searchsorted(self.grams, flat), len(self.grams) - 1)
        # a zero row stands for n-grams that no landmark has
        at[self.grams[at] != flat] = len(self.grams)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        out[full] = np.add.reduceat(self.weights[at], starts, axis=0) / np.sqrt(size)[:, None]
        share[full] = np.add.reduceat(at < len(self.grams), starts, dtype=np.int64) / size
        return out, share

    def predict(self, texts: list[str], reject: bool = False) -> tuple[list[str], list[float]]:
        """The best language of every text and its score. Null, letterless texts are und, and
        with ``reject`` those that are not clearly in one language; else a text without a
        known n-gram gets the most frequent language."""
        g = [grams(t or "") for t in texts]
        s, share = self._scores(g)
        clear = clearness(s, share)
        langs, conf = [], []
        for i, x in enumerate(g):
            if not len(x) or not self.langs or reject and (not share[i] or clear[i] < self.least_clear):
                langs.append(UNKNOWN)
                conf.append(0.0)
            elif not share[i]:
                langs.append(self.langs[self.common])
                conf.append(0.0)
            else:
                best = int(np.argmax(s[i]))
                langs.append(self.langs[best])
                conf.append(float(min(1.0, max(0.0, (s[i, best] + 1) / 2))))
        return langs, conf


def clearness(values: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Known share of a text's n-grams times the margin of its best value over the
    second one (over 0 with a single language)."""
    if not values.shape[1]:
        return np.zeros(len(values))
    top = np.sort(values, axis=1)
    return share * (top[:, -1] - (top[:, -2] if values.shape[1] > 1 else 0.0))


def _least_clear(phi: np.ndarray, y: np.ndarray, share: np.ndarray, unseen: np.ndarray, ridge: float,
                 folds: int = 4) -> float:
    """A quarter of the first percentile of the clearness of rows that the regression was
    not solved on and gets right; landmark texts (not ``unseen``) count only if no others are there."""
    values = np.zeros_like(y)
    fold = np.arange(len(y)) % folds
    for f in range(folds):
        rest = phi[fold != f]
        if len(rest):
            values[fold == f] = phi[fold == f] @ np.linalg.solve(
                rest.T @ rest + ridge * np.eye(phi.shape[1]), rest.T @ y[fold != f])
    right = np.argmax(values, axis=1) == np.argmax(y, axis=1)
    clear = clearness(values, share)
    clear = clear[right & unseen] if (right & unseen).any() else clear[right]
    return max(0.0, float(np.quantile(clear, 0.01)) / 4) if len(clear) else 0.0


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1 (false for a null id)."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1, F.lit(False))


def _sample(rows: DataFrame, counts: list[tuple[str, int]], per_lang: int) -> DataFrame:
    """Up to ``per_lang`` texts of each counted language, the ones with the smallest text
    hash; copies of a text count once, in ``counts`` as well. A first cut by the hash
    leaves about twice as many, so that ranking them is bounded work whatever share of
    the corpus a language has."""
    sizes = rows.sparkSession.createDataFrame(counts, "lang string, n long")
    spread = 2.0 ** 31
    rows = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(sizes), "lang") \
        .where(F.pmod("h", F.lit(2 ** 31)) < F.lit(spread * (2 * per_lang + 50)) / F.col("n")) \
        .groupBy("lang", "h").agg(F.min("text").alias("text"))
    w = Window.partitionBy("lang").orderBy("h")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_lang).select("lang", "text", "k")


def fit(docs: DataFrame, per_lang: int = 400, landmarks: int = 160, ridge: float = 0.1,
        id_col: str = "doc_id", max_langs: int = 250, max_rows: int = 20_000) -> LanguageModel:
    """Fit on rows that are not held out and have text with a letter and a lang.

    ``per_lang`` bounds the sampled distinct texts of a language, ``max_rows`` those of all,
    ``landmarks`` the landmark texts in all (at least 4 a language) and
    ``max_langs`` the languages that are learned, the most frequent ones. Without
    any such row the model knows no language.
    """
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col("lang").isNotNull()
                      & (F.length("text") > 0)).select("lang", "text")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([grams(t.as_py()) for t in b.column(1)], pa.list_(pa.int64()))],
                names=["lang", "k", "g"])

    copies = rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.count("*").alias("n"))
    counts = [(r["lang"], r["texts"]) for r in copies.groupBy("lang").agg(
        F.sum("n").alias("n"), F.count("*").alias("texts")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()]
    per_lang = min(per_lang, max_rows // max(1, len(counts)))
    sample = written(_sample(rows, counts, per_lang).mapInArrow(spell, "lang string, k int, g array<bigint>")
                     .where(F.size("g") > 0), "langid-sample")
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([], np.empty(0, dtype=np.int64), np.zeros((1, 0)))
    each = max(4, landmarks // len(langs))
    # at most `each` n-gram sets of a language
    marks = Landmarks.of([np.array(r["g"]) for r in sample.orderBy("lang", "k").where(F.col("k") <= each).collect()])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1),
                 pa.array([marks.kernel(g.values.to_numpy()) for g in b.column(2)], pa.list_(pa.float64())),
                 pa.array([len(marks.places(g.values.to_numpy())) / len(g) for g in b.column(2)], pa.float64())],
                names=["lang", "k", "row", "share"])

    got = sample.orderBy("lang", "k").mapInArrow(
        compare, "lang string, k int, row array<double>, share double").collect()
    k = np.array([r["row"] for r in got])                                   # (sample, landmarks)
    y = np.where(np.array([r["lang"] for r in got])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    parts = [marks.grams[_slices(marks, j)] for j in range(len(marks.sizes))]
    kmm = np.array([marks.kernel(g) for g in parts])
    value, vector = np.linalg.eigh((kmm + kmm.T) / 2)
    good = value > 1e-8 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])                           # K_mm^(-1/2)
    phi = k @ root
    w = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
    alpha = (root @ w) / np.sqrt(marks.sizes)[:, None]                      # (landmark, language)
    weights = np.add.reduceat(alpha[marks.owners], marks.first[:-1], axis=0)
    least = _least_clear(phi, y, np.array([r["share"] for r in got]), np.array([r["k"] > each for r in got]), ridge)
    return LanguageModel(langs, marks.grams, np.vstack([weights, np.zeros((1, len(langs)))]), least,
                         next(langs.index(x) for x, _ in counts if x in langs))


def _slices(marks: Landmarks, j: int) -> np.ndarray:
    """Numbers of the n-grams that landmark ``j`` has."""
    row = np.repeat(np.arange(len(marks.grams)), np.diff(marks.first))
    return row[marks.owners == j]


def predicted(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
              carry: bool = False, reject: bool = False) -> DataFrame:
    """(id, lang_pred, score) of every row, or with ``carry`` all columns and these two
    (in place of columns of the same names).

    Only the text is used. Null text and text without a letter is ``und`` with score 0,
    and so is every text if the model knows no language; with ``reject`` also text that is
    not clearly in one of the learned languages (foreign, random or mixed). Text without
    a known n-gram is in the most frequent language, with score 0. The score is
    the best regression value moved from -1..1 to 0..1 and cut there.
    """
    # arrays only, of a size that the landmarks bound: executors need not know the class to load them
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.langs, model.grams, model.weights, model.least_clear, model.common))
    cols = [c for c in docs.columns if c not in ("lang_pred", "score")] if carry else [id_col]
    part = docs.select(*cols) if carry else docs.select(id_col, text_col)
    schema = ", ".join(f"`{c}` {t}" for c, t in part.select(*cols).dtypes) + ", lang_pred string, score double"
    at = part.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(*shared.value)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                s = b.slice(start, 256)
                langs, conf = m.predict(s.column(at).to_pylist(), reject)
                yield pa.RecordBatch.from_arrays(
                    [*(s.column(i) for i in range(len(cols))), pa.array(langs, pa.string()),
                     pa.array(conf, pa.float64())], names=[*cols, "lang_pred", "score"])

    return part.mapInArrow(run, schema)


MIN_SCORE = 0.25


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` in a known language: prediction not ``und`` (which sorts out
    texts in none of the learned languages), score of at least ``min_score``."""
    plain, back = set_aside(docs, [id_col, "text", "lang"])
    found = predicted(plain, fit(plain, id_col=id_col), id_col, carry=True, reject=True)
    return back(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)))
