"""Text as vectors: tokens, a vector for each token's first characters, their sum."""

from __future__ import annotations

import re
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tokens' pattern; the seed's base, characters and modulus.
TOKEN, BASE, CHARS, MODULUS = r"\b[a-z0-9_-]+\b", 31, 6, 2147483647


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_seed(token: Column) -> Column:
    terms = [F.when(F.length(token) > i, F.ascii(F.substring(token, i + 1, 1)).cast("long") * BASE**i).otherwise(F.lit(0).cast("long")) for i in range(CHARS)]
    return sum(terms[1:], terms[0]) % MODULUS


def seed_of(token: str) -> int:
    return sum(ord(c) * BASE**i for i, c in enumerate(token[:CHARS])) % MODULUS


def seeds_of(tokens: list[str], known: dict[str, int]) -> dict[int, int]:
    """How often each seed stands among tokens. known: seeds of tokens' first characters; it is emptied at MEMO of them."""
    out = {}
    for start, n in Counter(map(itemgetter(slice(CHARS)), tokens)).items():
        seed = known.get(start)
        if seed is None:
            if len(known) >= MEMO:
                known.clear()
            seed = known[start] = seed_of(start)
        out[seed] = out.get(seed, 0) + n
    return out


#: Seeds whose vectors a task remembers, and texts whose sums are made at once.
MEMO, TEXTS = 100_000, 200


def embedded(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """id, v of unit length for each row; no tokens: zeros. No shuffle: a task makes the vectors of the tokens it meets, each once,
    and adds them up for many texts together."""

    def run(batches):
        find, place, known, random, seeds = re.compile(TOKEN).findall, {}, np.zeros((0, dim)), np.random.RandomState(), {}

        def vector(seed):
            random.seed(seed)
            return random.normal(size=(1, dim))

        for batch in batches:
            for s in range(0, batch.num_rows, TEXTS):
                part = batch.slice(s, TEXTS)
                counts = [seeds_of(find((t or "").lower()), seeds) for t in part.column(1).to_pylist()]
                new = {w for c in counts for w in c if w not in place}
                if len(place) + len(new) > MEMO:
                    place, known, new = {}, known[:0], {w for c in counts for w in c}
                place.update(zip(sorted(new), range(len(place), len(place) + len(new)), strict=True))
                have = len(place) - len(new)
                if len(place) > len(known):  # grows to twice what it holds, so that each vector is copied a few times at most
                    known = np.concatenate([known[:have], np.zeros((max(2 * len(place), 1024) - have, dim))])
                for k, w in enumerate(sorted(new)):
                    known[have + k] = vector(w)
                size = np.array([len(c) for c in counts])
                at = np.fromiter((place[w] for c in counts for w in c), np.int64, size.sum())
                n = np.fromiter((k for c in counts for k in c.values()), float, size.sum())
                total, begin = np.zeros((len(counts), dim)), np.cumsum(size) - size
                some = np.flatnonzero(size)
                if len(some):
                    total[some] = np.add.reduceat(known[at] * n[:, None], begin[some])
                norm = np.sqrt((total * total).sum(1))[:, None]
                v = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), total)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.arange(0, len(v) * dim + 1, dim, dtype=np.int32), v.ravel())], names=["id", "v"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, v array<double>")


def semantic_search(df: DataFrame, id_col: str, text_col: str, questions: list[tuple[int, str]], k: int = 5, dim: int = 64) -> DataFrame:
    """qid, id, rank, distance, similarity: cosine neighbours of each question among the embedded texts."""
    from nearfield.operators.knn import nearest

    asked = df.sparkSession.createDataFrame(questions, "qid long, text string")
    q = embedded(asked, "qid", "text", dim).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    hits = nearest(embedded(df, id_col, text_col, dim), q, k, "cosine")
    return hits.select("qid", "id", "rank", F.round("dist", 4).alias("distance"), F.round(F.greatest(F.lit(0.0), 1 - F.col("dist")), 4).alias("similarity"))
