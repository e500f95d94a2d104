"""Language identification by unigram pieces, summed over all segmentations.

A word's probability in a language is the sum, over all ways to cut it into pieces of a fixed public vocabulary, of the
product of the pieces' probabilities there; a forward pass computes it. Expectation-maximisation with the backward pass
learns the probabilities, each language for itself, from the whole texts of a bounded number of labelled documents. Every
language that has a labelled document is learned, with all its words and pieces. A text is scored by all its words.

Words are runs of letters with their combining marks, lowered, of any length. A null text, an empty one, or one without a
letter gets `und` and 0.0; so does every text if nothing could be learned. Very long texts: whole, each distinct word is
scored once; a word takes time in proportion to its length. Equal scores: the first language by name. Repeated rows are each
predicted, and each counts in the fit. An empty table gives no rows. Extra columns, whatever their names, are ignored.
The model takes a quarter of a megabyte for a language, on the driver and in each task.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches


def _mark_ranges() -> str:
    """All combining marks, as the inside of a character class."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(marks), lambda x: x[1] - x[0])]
    return "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs)


MARKS = _mark_ranges()
LETTERS = re.compile(rf"[^\W\d_]+(?:[{MARKS}]+[^\W\d_]*)*")
PIECE = re.compile(rf"(?:[^\W\d_]|[{MARKS}])+")
START = "▁"
#: Letters of a word whose sums need no scaling, and the probability of a letter outside the vocabulary.
LONGEST, UNKNOWN = 24, 1e-8
#: Words whose scores a task remembers, of LONGEST letters each on average; and letters that are scored at once.
MEMO, AT_ONCE = 300_000, 4096 * LONGEST
#: The bound of the fit: labelled documents of each language.
MAX_DOCS = 1000

_B, _MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that consist of lower-case letters and marks, with or without the word's start."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (p.id_to_piece(i) for i in range(p.get_piece_size()))
    return sorted({x for x in pieces if (y := x.removeprefix(START)) and PIECE.fullmatch(y) and y == y.lower()} | {START})


class Lattice:
    """Finds which substrings of many words of equal length are pieces, by an open-addressing table of their hashes."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.none, self.unknown = self.n, self.n + 1  # the ids of no piece and of a letter outside the vocabulary
        self.bits = max(4, (8 * self.n).bit_length())
        self.hash = np.zeros(1 << self.bits, np.uint64)
        self.id = np.full(1 << self.bits, self.none, np.int32)
        self.probes = 1
        for i, p in enumerate(pieces):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in p:
                    h = h * _B + np.uint64(ord(c))
                slot, k = int((h * _MIX) >> np.uint64(64 - self.bits)), 1
            while self.id[slot] != self.none:
                slot, k = (slot + 1) % (1 << self.bits), k + 1
            self.hash[slot], self.id[slot], self.probes = h, i, max(self.probes, k)

    def look(self, h: np.ndarray) -> np.ndarray:
        slot = ((h * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.hash[slot] == h, self.id[slot], self.none)
        for _ in range(1, self.probes):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            out = np.where((out == self.none) & (self.hash[slot] == h), self.id[slot], out)
        return out

    def edges(self, chars: np.ndarray) -> list[np.ndarray]:
        """For each length l from 1: ids[word, start] of the pieces of that length; chars[word, place] are code points."""
        h, out = np.zeros_like(chars), []
        for n in range(1, min(self.longest, chars.shape[1]) + 1):
            h = h[:, : chars.shape[1] - n + 1] * _B + chars[:, n - 1 :]
            ids = self.look(h)
            out.append(np.where(ids == self.none, self.unknown, ids) if n == 1 else ids)
        return out


def by_length(words: list[str]):
    """(places in words, code points [word, place]) for each length; the code points begin with START."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        flat = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), "<u4").reshape(len(at), n)
        yield at, np.concatenate([np.full((len(at), 1), ord(START), np.uint64), flat.astype(np.uint64)], axis=1)


def forward(edges: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    """alpha[place, word, language]: the summed probability of all segmentations of the first `place` characters."""
    words, size = edges[0].shape
    alpha = np.zeros((size + 1, words, prob.shape[1]))
    alpha[0] = 1
    for e in range(1, size + 1):
        for n in range(1, min(len(edges), e) + 1):
            alpha[e] += alpha[e - n] * prob[edges[n - 1][:, e - n]]
    return alpha


def log_forward(edges: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    """Logarithm of forward()'s last place, [word, language], for words of any length: the sums are scaled at each letter."""
    words, size = edges[0].shape
    reach = len(edges)
    # last[:, n - 1] is the sum n places back.
    last, logs = np.zeros((words, reach, prob.shape[1])), np.zeros((words, prob.shape[1]))
    last[:, 0] = 1
    for e in range(1, size + 1):
        n = min(reach, e)
        ids = np.stack([edges[k][:, e - 1 - k] for k in range(n)], axis=1)
        new = (last[:, :n] * prob[ids]).sum(1)
        logs += np.log(new)
        last[:, 1:] = last[:, :-1] / new[:, None]
        last[:, 0] = 1
    return logs


def log_sums(edges: list[np.ndarray], prob: np.ndarray, places: range, step: int) -> np.ndarray:
    """[place, word]: logarithm of the sums over all segmentations of what lies before a place (step 1, places from 1) or behind
    it (step -1, places downwards); scaled at each letter, so for words of any length."""
    words, size = edges[0].shape
    logs, last = np.zeros((size + 1, words)), np.zeros((words, len(edges)))
    last[:, 0] = 1  # last[:, n - 1]: the sum n places back, relative to the last one
    for done, at in enumerate(places):
        n = min(len(edges), done + 1)
        ids = np.stack([edges[k][:, at - 1 - k if step > 0 else at] for k in range(n)], axis=1)
        new = (last[:, :n] * prob[ids]).sum(1)
        logs[at] = logs[at - step] + np.log(new)
        last[:, 1:] = last[:, :-1] / new[:, None]
        last[:, 0] = 1
    return logs


def expected(edges: list[np.ndarray], prob: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
    """Adds each piece's expected number of uses, over all segmentations by their probability, by forward and backward sums."""
    size = edges[0].shape[1]
    before, behind = log_sums(edges, prob, range(1, size + 1), 1), log_sums(edges, prob, range(size - 1, -1, -1), -1)
    for n in range(1, min(len(edges), size) + 1):
        for s in range(size - n + 1):
            ids = edges[n - 1][:, s]
            use = np.exp(before[s] + behind[s + n] - before[size]) * prob[ids]
            counts += np.bincount(ids, use * weight, len(counts))


def learn(words: list[str], weight: np.ndarray, lattice: Lattice, rounds: int = 4, smooth: float = 0.05) -> np.ndarray:
    """prob[piece] in a language from its words and how often each occurs, with an entry for no piece and one for unknown letters."""
    groups = []
    for at, chars in by_length(words):
        step = max(1, AT_ONCE // chars.shape[1])
        groups += [(chars[k : k + step], weight[at[k : k + step]]) for k in range(0, len(at), step)]
    p = np.full(lattice.n + 2, 1 / max(1, lattice.n))
    for _ in range(rounds):
        p[lattice.none], p[lattice.unknown] = 0, UNKNOWN
        counts = np.zeros(lattice.n + 2)
        for chars, w in groups:
            expected(lattice.edges(chars), p, w, counts)
        p[: lattice.n] = (counts[: lattice.n] + smooth) / (counts[: lattice.n].sum() + smooth * lattice.n)
    p[lattice.none], p[lattice.unknown] = 0, UNKNOWN
    return p


def split_words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


class Scorer:
    def __init__(self, pieces: list[str], langs: list[str], prob: np.ndarray):
        self.lattice, self.langs, self.prob = Lattice(pieces), langs, prob
        self.place: dict[str, int] = {}
        self.logs, self.letters = np.zeros((0, len(langs))), 0

    def learn_words(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if len(new) + len(self.place) > MEMO or sum(map(len, new)) + self.letters > MEMO * LONGEST:
            self.place, self.logs, self.letters, new = {}, self.logs[:0], 0, list(words)
        self.letters += sum(map(len, new))
        logs = np.zeros((len(new), len(self.langs)))
        for at, chars in by_length(new):
            long = chars.shape[1] > LONGEST + 1
            step = max(1, AT_ONCE // chars.shape[1])
            for k in range(0, len(at), step):
                edges = self.lattice.edges(chars[k : k + step])
                logs[at[k : k + step]] = log_forward(edges, self.prob) if long else np.log(np.maximum(forward(edges, self.prob)[-1], 1e-300))
        self.place.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
        self.logs = np.concatenate([self.logs, logs])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [split_words(t) for t in texts]
        self.learn_words(set().union(*split))
        out = []
        for words in split:
            if not words or not self.langs:
                out.append(("und", 0.0))
                continue
            total = self.logs[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(0)
            share = np.exp(total - total.max())
            k = int(total.argmax())
            out.append((self.langs[k], float(share[k] / share.sum())))
        return out


def fold(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 4


def learned(labelled: DataFrame, pieces: list[str], max_docs: int = MAX_DOCS) -> tuple[list[str], np.ndarray]:
    """The languages, and prob[piece, language], from about max_docs documents of each, picked by a hash of the id; labelled:
    doc_id, text, lang. A language is learned in one task, from the words of its sample."""
    bounded_batches(labelled.sparkSession)
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((len(pieces) + 2, 0))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, max_docs / n))))
    picked = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30)).select("lang", "text")

    def count(batches):
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((lang, w) for w in split_words(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "c"])

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("word")
        prob = learn(t["word"].to_pylist(), t["c"].to_numpy().astype(float), Lattice(pieces))
        return pa.table({"lang": [t["lang"][0].as_py()], "prob": pa.array([prob], pa.list_(pa.float64()))})

    words = picked.mapInArrow(count, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    rows = sorted((r.lang, r.prob) for r in words.groupBy("lang").applyInArrow(fit, "lang string, prob array<double>").collect())
    return [r[0] for r in rows], np.array([r[1] for r in rows]).reshape(len(rows), -1).T


def predicted(df: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; learns from the rows that aren't held out and have a language."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), (fold(id_col) == 2).alias("held_out"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    langs, prob = learned(rows.where("lang IS NOT NULL AND NOT held_out").select("doc_id", "text", "lang"), pieces, **bounds)
    sent = df.sparkSession.sparkContext.broadcast((pieces, langs, prob))
    bounded_batches(df.sparkSession)

    def run(batches):
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(*sent.value)
            got = scorer.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
