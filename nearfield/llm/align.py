"""Which tokens of two tokenizers cover the same bytes, and which id pairs go together corpus-wide.

The tokens of a text are nodes of a bipartite graph, with an edge where a token of A and one of B share a byte. Its connected
components, found by union-find, are the smallest groups that both tokenizers cut out: a component begins and ends where tokens
of both end. The members of a component, each of A with each of B, are its links. Tasks do this for a batch of texts at once:
edges come from one pass over the sorted ends of tokens, and roots are hooked and paths halved as array operations. A group of very
many tokens, as a text where ends seldom meet has, is linked by its distinct ids and how often they occur.

The links of a text are written as distinct id pairs with their number. Counting in how many texts a pair is linked sums within
tasks before the shuffle. Up to max_pairs counts are broadcast to the rows; more are joined in a shuffle, where a pair's rows are
dealt over several keys, of which each text has one.

Texts that are null or empty, or whose bytes either tokenizer changes, have no tokens: zeros and an empty digest. Rows of equal id or
text are documents of their own, each counted. Null ids stay null. Very long texts: whole; what a task holds of a text is its tokens
and distinct pairs. Ties for an A id's highest count: all count as best. An empty table gives no rows; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.bpe import MEMO
from nearfield.llm.common import BATCH_BYTES, bounded_batches, checkpointed, few, id_and_text, remove, sha256, shared_folder

#: Links of a group that are written one by one; counts that are broadcast, some 50 bytes each; keys that a pair's rows are dealt over.
LARGE, MAX_PAIRS, SHARES = 256, 1 << 20, 8
#: Characters of a segment that is remembered.
LONG = 64

SPACE = "▁"


def entry_bytes(vocab: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary by bytes: printable characters of Latin-1 stand for themselves, the other bytes for 256 and on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return {bytes(byte[c] for c in entry): i for entry, i in vocab.items()}


class ByteLevel:
    """The tokens of a byte-level BPE given as JSON. Its merges are in the order of ids, which is looked at, so ids are ranks."""

    def __init__(self, data: bytes, pattern: str):
        spec = json.loads(data)
        special = {t["content"] for t in spec["added_tokens"]}
        self.ranks = entry_bytes({e: i for e, i in spec["model"]["vocab"].items() if e not in special})
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        if made != sorted(made) or len(made) + 256 != len(self.ranks):
            raise ValueError("the merges are not in the order of ids")
        self.encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.bytes_of[i] = b

        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)

    def encode(self, text: str) -> np.ndarray | None:
        """Tokens are bytes of the text one behind the other, so they are the text if their sizes add up to its own."""
        ids = self.encoding.encode_to_numpy(text)
        return ids if self.sizes[ids].sum() == len(text.encode()) else None


class Changed(Exception):
    """The tokens of a segment are not its bytes."""


class Pieces(dict):
    """The tokens of a piece model; as a mapping, those of a segment. No piece goes on behind a word's end, which is looked at, so
    that texts are encoded by segments, runs of spaces with what follows, and those of common ones are remembered."""

    def __init__(self, data: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.segments = re.compile("(?s)..*" if any(SPACE in p.lstrip(SPACE) for p in pieces) else " +[^ ]*").findall

    def __missing__(self, segment: str) -> list[int]:
        # The model puts a space in front, but of an empty text.
        ids = self.model.encode(segment[1:]) if segment != " " else [self.model.piece_to_id(SPACE)]
        if b"".join(map(self.bytes_of.__getitem__, ids)) != segment.encode():
            raise Changed
        if len(segment) < LONG:
            if len(self) > MEMO:
                self.clear()
            self[segment] = ids
        return ids

    def encode(self, text: str) -> list[int] | None:
        """Of a text that begins with a space."""
        if SPACE in text:
            return None  # it would come back as a space
        try:
            return list(chain.from_iterable(map(self.__getitem__, self.segments(text))))
        except Changed:
            return None


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over the nodes 0 .. n - 1 with edges u, v: the least node of each one's component."""
    parent = np.arange(n)
    while len(u):
        u, v = parent[u], parent[v]
        apart = u != v
        u, v = u[apart], v[apart]
        parent[np.maximum(u, v)] = np.minimum(u, v)  # a root goes below a lesser one
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the number of its group, in order; the last ends are equal."""
    ends = np.zeros(int(a_ends[-1]) + 1 if len(a_ends) else 1, np.uint8)
    ends[a_ends] = 1
    ends[b_ends] |= 2
    kind = ends[np.flatnonzero(ends)]
    in_a, in_b = kind & 1, kind >> 1
    # Between two ends that follow each other, one token of each side covers the bytes.
    u, v = np.cumsum(in_a, dtype=np.int64) - in_a, np.cumsum(in_b, dtype=np.int64) - in_b
    n = len(a_ends)
    root = roots(n + len(b_ends), u, n + v)
    number = np.cumsum(root[:n] == np.arange(n)) - 1  # the least node of a component is a token of A
    return number[root[:n]], number[root[n:]]


def links(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, base: int, large: int = LARGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id of A * base + id of B, number) of the links; in_a, in_b: groups of the tokens, in order."""
    na, nb = np.bincount(in_a), np.bincount(in_b)
    first_a, first_b, each = np.cumsum(na) - na, np.cumsum(nb) - nb, na * nb
    small = np.flatnonzero(each <= large)
    n = each[small]
    g = np.repeat(small, n)
    k = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
    out = [(g, a[first_a[g] + k // nb[g]] * base + b[first_b[g] + k % nb[g]], np.ones(len(g), np.int64))]
    for g in np.flatnonzero(each > large):
        (x, cx), (y, cy) = (np.unique(t[f[g] : f[g] + m[g]], return_counts=True) for t, f, m in ((a, first_a, na), (b, first_b, nb)))
        out.append((np.full(len(x) * len(y), g), np.add.outer(x * base, y).ravel(), np.multiply.outer(cx, cy).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Aligner:
    def __init__(self, byte_level: bytes, pattern: str, pieces: bytes):
        self.a, self.b = ByteLevel(byte_level, pattern), Pieces(pieces)
        self.len_a, self.len_b = self.a.sizes, np.array([len(b) for b in self.b.bytes_of], np.int64)
        self.base, self.most = len(self.len_b), max(len(self.len_a), len(self.len_b))
        self.shown = [f"{i}{sep}" for sep in ",|;" for i in range(self.most)]

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """The tokens of a text; none if one side changes its bytes."""
        return tuple(t.tolist() for t in self._tokens(text))

    def _tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if text:
            b = self.b.encode(" " + text)
            a = self.a.encode(" " + text) if b is not None else None
            if a is not None:
                return a, np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def batch(self, texts: list[str | None]) -> tuple:
        """n_a, n_b, n_groups, n_links, digests, and the distinct pairs with their numbers and where each text's begin."""
        tokens = [self._tokens(t) for t in texts]
        n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in range(2))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(t[k] for t in tokens)]).astype(np.int64) for k in range(2))
        text_of, size = np.repeat(np.arange(len(texts)), n_a), len(texts)
        in_a, in_b = groups(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))
        na, nb = np.bincount(in_a), np.bincount(in_b)
        owner = text_of[np.cumsum(na) - na] if len(a) else np.zeros(0, np.int64)
        n_groups = np.bincount(owner, minlength=size)
        n_links = np.zeros(size, np.int64)
        np.add.at(n_links, owner, na * nb)
        order = self._shown(a, b, in_a, in_b, na, nb)
        at = np.concatenate([[0], np.cumsum(n_a + n_b)])
        digests = ["" if x == y else sha256("".join(map(self.shown.__getitem__, order[x:y].tolist()))[:-1]) for x, y in zip(at[:-1], at[1:], strict=True)]
        g, key, n = links(a, b, in_a, in_b, self.base)
        whose = owner[g]
        by = np.lexsort((key, whose))
        key, whose, n = key[by], whose[by], n[by]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (whose[1:] != whose[:-1])]) if len(key) else np.zeros(0, np.int64)
        begins = np.searchsorted(whose[new], np.arange(size + 1))
        return n_a, n_b, n_groups, n_links, digests, key[new], np.add.reduceat(n, new) if len(new) else n, begins

    def _shown(self, a, b, in_a, in_b, na, nb) -> np.ndarray:
        """The places in self.shown of a group's tokens of A, then of B, group after group."""
        out = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[np.cumsum(na) - 1] = self.most
        last_b[np.cumsum(nb) - 1] = 2 * self.most
        out[np.arange(len(a)) + (np.cumsum(nb) - nb)[in_a]] = a + last_a
        out[np.arange(len(b)) + np.cumsum(na)[in_b]] = b + last_b
        return out


@lru_cache(maxsize=1)
def aligner(byte_level: bytes, pattern: str, pieces: bytes) -> Aligner:
    """One for each Python worker, not for each task."""
    return Aligner(byte_level, pattern, pieces)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def linked_pairs(df: DataFrame, byte_level: bytes, pattern: str, pieces: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (id of A * size of B's vocabulary + id of B), times."""
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((byte_level, pattern, pieces))

    def run(batches):
        for batch in batches:
            own, texts = aligner(*sent.value), batch.column(1).to_pylist()
            start, size = 0, 0
            for k, t in enumerate(texts):  # some bytes at once, as a batch of rows may have long texts
                size += len(t or "")
                if size > BATCH_BYTES // 8 or k == len(texts) - 1:
                    *counts, digests, pairs, times, begins = own.batch(texts[start : k + 1])
                    lists = [pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(x, pa.int64())) for x in (pairs, times)]
                    ids = batch.column(0).slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), *lists], names=["doc_id", *COUNTS, "groups_sha256", "pairs", "times"])
                    start, size = k + 1, 0

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def pair_counts(texts: DataFrame, base: int) -> DataFrame:
    """pair, n (texts that have it), best (no pair of the same A id is in more)."""
    counts = texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair DIV {base}")))  # as many rows as B has ids, at most
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def aligned(df: DataFrame, byte_level: bytes, pattern: str, pieces: bytes, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many texts as any of its A id), count_sum (texts of
    each link's pair, summed), groups_sha256."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/alignment-{uuid.uuid4()}"
    rows = linked_pairs(df, byte_level, pattern, pieces, id_col, text_col)
    rows.withColumn("k", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    texts = spark.read.parquet(path)
    counts = checkpointed(pair_counts(texts, sentencepiece.SentencePieceProcessor(model_proto=pieces).vocab_size()))
    each = texts.select("k", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("k", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    if counts.count() <= max_pairs:
        met = each.join(F.broadcast(counts), "pair")
    else:
        met = each.withColumn("s", F.pmod("k", F.lit(SHARES))).join(counts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), ["pair", "s"])
    sums = met.groupBy("k").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    of = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = checkpointed(few(texts.join(sums, "k", "left")).select("doc_id", *COUNTS, of("n_best"), of("count_sum"), "groups_sha256"), shuffled=False)
    remove(spark, path)
    return out
