"""Toxicity by a classifier chain. Categories are predicted in order; each linear model sees the words of a text, their
beginnings and the probabilities of the categories before it. In training those probabilities are out-of-fold: they come from models that
did not see the document.

The last category is the label `toxic`. The labels name no kinds of toxicity, so the earlier categories are found in the
labelled documents: telling features are grouped around a few centres that rarely occur together, and a document is of a
category if it is toxic and has a feature of that group. Models are fitted on a bounded number of labelled rows, with every
feature that tells the labels apart there, and scored on every whole text.

Null or empty text, or one without words: the models' intercepts. Very long texts: whole, as the set of their words. Null
labels and labels of null ids are left out; if labels of one id differ, the larger counts. Without any label, or with labels
of one kind only, all models are intercepts of -12, or 12 where all labels are toxic, that is probabilities of 6e-6 or nearly
1. Ties: of equally telling features the first by name is a centre; a probability equal to the threshold is toxic. Repeated
rows are each scored, and each counts in the fit. An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, checkpointed

WORD = re.compile(r"[^\W\d_]+")

#: Categories before the last one.
GROUPS = 3
#: The bound of the fit: labelled documents.
MAX_DOCS = 10_000
#: How far apart, in standard deviations, the labels must be in a feature's presence. Without this, chance features add up in long texts.
LEAST_Z = 4.0
#: Letters of a word's beginning that count as a feature of its own, for words with many endings.
STEM = 5
FOLDS = 4


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def distinct_features(text: str | None) -> set[str]:
    """The words, and the beginnings of longer ones, marked by a hyphen."""
    words = distinct_words(text)
    return words | {f"{w[:STEM]}-" for w in words if len(w) > STEM}


class Linear:
    """Logistic regression on sets of present features and a few dense ones."""

    def __init__(self, n_features: int, n_dense: int, l2: float = 0.05, rounds: int = 400):
        self.w, self.v, self.b = np.zeros(n_features), np.zeros(n_dense), 0.0
        self.l2, self.rounds = l2, rounds

    def score(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.w[col], len(dense)) + dense @ self.v + self.b

    def fit(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Linear:
        """Adaptive gradient steps over all rows, so that the result doesn't depend on an order."""
        if not len(y) or y.min() == y.max():
            self.b = 12.0 if len(y) and y[0] else -12.0
            return self
        seen = [np.full_like(x, 1e-8) for x in (self.w, self.v)] + [1e-8]
        for k in range(self.rounds):
            off = 1 / (1 + np.exp(-self.score(row, col, dense))) - y
            grads = [np.bincount(col, off[row], len(self.w)) + self.l2 * self.w, dense.T @ off + self.l2 * self.v, off.sum()]
            seen = [s + g * g for s, g in zip(seen, grads, strict=True)]
            step = 1.0
            self.w, self.v, self.b = self.w - step * grads[0] / np.sqrt(seen[0]), self.v - step * grads[1] / np.sqrt(seen[1]), self.b - step * grads[2] / np.sqrt(seen[2])
        return self

    def prob(self, row, col, dense) -> np.ndarray:
        return 1 / (1 + np.exp(-self.score(row, col, dense)))


def take(row: np.ndarray, col: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the rows where keep, with rows numbered anew."""
    at, some = np.cumsum(keep) - 1, keep[row]
    return at[row[some]], col[some]


def fit_chain(row: np.ndarray, col: np.ndarray, labels: np.ndarray, folds: np.ndarray, n_features: int) -> list[Linear]:
    """labels[document, category]. A model for each category; those after the first see out-of-fold probabilities."""
    chain, before = [], np.zeros((len(labels), 0))
    for k in range(labels.shape[1]):
        y, out = labels[:, k].astype(float), np.zeros(len(labels))
        if k + 1 < labels.shape[1]:
            for f in range(FOLDS):
                seen, held = folds != f, folds == f
                m = Linear(n_features, k).fit(*take(row, col, seen), before[seen], y[seen])
                out[held] = m.prob(*take(row, col, held), before[held])
        chain.append(Linear(n_features, k).fit(row, col, before, y))
        before = np.column_stack([before, out])
    return chain


def sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """fold, y, words of about max_docs labelled documents, picked by a hash of the id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, max_docs / max(1, known.count())) * (1 << 30))
    got = docs.join(F.broadcast(known), "doc_id").select((F.crc32(F.col("doc_id").cast("string")) % FOLDS).cast("int").alias("fold"), F.col("y").cast("int"), "text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(distinct_features(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))], names=["fold", "y", "words"])

    return checkpointed(got.mapInArrow(run, "fold int, y int, words array<string>"), shuffled=False)


def features(rows: DataFrame) -> dict[str, bool]:
    """The words and beginnings that five documents have and whose presence differs clearly between the labels, by a normal score,
    in order, and whether toxic documents have them more often. As many as a bounded sample has."""
    n = {r.y > 0: r.n for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    a, b = n.get(True, 0), n.get(False, 0)
    if not a or not b:
        return {}
    w = rows.select((F.col("y") > 0).alias("y"), F.explode("words").alias("w")).groupBy("w").agg(F.count(F.when(F.col("y"), 1)).alias("a"), F.count(F.when(~F.col("y"), 1)).alias("b")).where("a + b >= 5")
    p = (F.col("a") + F.col("b")) / (a + b)
    z = (F.col("a") / a - F.col("b") / b) / F.sqrt(p * (1 - p) * (1 / a + 1 / b) + 1e-9)
    return dict(sorted((r.w, r.z > 0) for r in w.withColumn("z", F.round(z, 6)).where(F.abs("z") >= LEAST_Z).collect()))


def grouped(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, names: list[str], more: np.ndarray, k: int = GROUPS) -> np.ndarray:
    """The group, from 0, of each feature that toxic documents have more often, -1 for others. The first centre is the most frequent
    one, the next is the one that is frequent without those before; a feature joins the centre it occurs with most, by cosine."""
    on = toxic[row] & more[col]
    row, col = row[on], col[on]
    n = np.bincount(col, minlength=len(names)).astype(float)
    order = sorted(np.flatnonzero(n), key=lambda f: names[f])
    alike, centres = np.zeros((0, len(names))), []
    while len(centres) < min(k, len(order)):
        free = n * (1 - alike.max(0, initial=0.0))
        free[centres] = -1
        c = max(order, key=lambda f: round(free[f], 9))  # the first by name of equals
        with_it = np.zeros(len(toxic), bool)
        with_it[row[col == c]] = True
        both = np.bincount(col[with_it[row]], minlength=len(names))
        alike = np.vstack([alike, both / np.sqrt(np.maximum(n * n[c], 1))])
        centres.append(c)
    return np.where(n > 0, alike.argmax(0), -1) if centres else np.full(len(names), -1)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> tuple[dict[str, int], list[Linear]]:
    rows = sample(docs, labels, max_docs)
    known = features(rows)
    names = list(known)
    place = {w: k for k, w in enumerate(names)}
    row, col, toxic, folds = [], [], [], []
    for k, r in enumerate(rows.toLocalIterator()):  # at most about max_docs rows
        has = [place[w] for w in r.words if w in place]
        row += [k] * len(has)
        col += has
        toxic.append(r.y > 0)
        folds.append(r.fold)
    row, col, toxic = np.array(row, int), np.array(col, int), np.array(toxic, bool)
    group = grouped(row, col, toxic, names, np.array([known[w] for w in names], bool))
    y = np.zeros((len(toxic), GROUPS + 1), int)
    on = toxic[row] & (group[col] >= 0)
    y[row[on], group[col[on]]] = 1
    y[:, -1] = toxic
    return place, fit_chain(row, col, y, np.array(folds, int), len(place))


def scored(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **bounds) -> DataFrame:
    """doc_id, p_group1 and so on, p_toxic, toxic for each row."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    place, chain = fit(docs, labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")), **bounds)
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((place, chain))
    names = [*(f"p_group{k + 1}" for k in range(GROUPS)), "p_toxic"]

    def run(batches):
        for batch in batches:
            place, chain = sent.value
            n, row, col = batch.num_rows, [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                has = [place[w] for w in distinct_features(text) & place.keys()]
                row += [k] * len(has)
                col += has
            row, col, before = np.array(row, int), np.array(col, int), np.zeros((n, 0))
            for m in chain:
                before = np.column_stack([before, m.prob(row, col, before)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(before[:, k]) for k in range(len(chain))), pa.array(before[:, -1] >= threshold)], names=["doc_id", *names, "toxic"])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in names) + ", toxic boolean")
