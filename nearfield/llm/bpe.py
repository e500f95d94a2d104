"""Byte-level BPE. A pre-token that is a vocabulary entry is resolved by one probe of a minimal perfect hash;
any other is merged with a heap over a linked list of its bytes.

Null text: as the empty text. Empty text: no ids. Very long texts and pre-tokens: n log n in the pre-token.
Ties: of pairs of equal rank the leftmost is merged. Repeated rows are each encoded. Null ids stay null. An empty table gives
no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from nearfield.llm.common import id_and_text, per_text, sha256

#: The largest vocabulary that is sent to the executors, in bytes of its file; about 100 bytes of memory for each.
MAX_VOCAB_BYTES = 64 << 20
#: Pre-tokens whose ids a task remembers.
MEMO = 300_000


class PerfectHash:
    """key -> value for a fixed set of byte strings: as many slots as keys, and two small integers for each bucket of keys.

    Buckets are placed from the largest on: each gets the first displacement that puts all its keys on free slots;
    buckets of one key get a free slot outright, kept as a negative displacement.
    """

    def __init__(self, items: dict[bytes, int], load: int = 4):
        n = self.n = len(items)
        self.m = max(1, n // load)
        buckets: dict[int, list[tuple[bytes, int]]] = {}
        for key in items:
            h = xxhash.xxh3_64_intdigest(key)
            buckets.setdefault(h % self.m, []).append((key, h))
        self.shift = [0] * self.m
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        order = sorted(buckets.items(), key=lambda x: -len(x[1]))
        free = n
        for b, members in order:
            if len(members) > 1:
                d = 0
                while True:
                    slots = [self._slot(h, d) for _, h in members]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                    d += 1
            else:
                free -= 1
                while self.keys[free] is not None:
                    free -= 1
                d, slots = -free - 1, [free]
            self.shift[b] = d
            for (key, _), s in zip(members, slots, strict=True):
                self.keys[s], self.values[s] = key, items[key]

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 20) + d * ((h >> 7) | 1) + d * d) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else None


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: again and again the adjacent pair of least rank, the leftmost of equals, becomes one part."""
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends
    start = list(range(-1, n))  # start[e]: where the part that ends at e starts
    alive = bytearray(b"\1") * n
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, e = heappop(heap)
        if not alive[i] or end[i] >= e or end[end[i]] != e:
            continue
        alive[end[i]] = 0
        end[i], start[e] = e, i
        if e < n and (r := get(piece[i : end[e]])) is not None:
            heappush(heap, (r, i, end[e]))
        if i and (r := get(piece[start[i] : e])) is not None:
            heappush(heap, (r, start[i], e))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Memo(dict):
    """A mapping that computes what it lacks. trim() keeps it bounded."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self, most: int = MEMO) -> None:
        if len(self) > most:
            self.clear()


class Encoder:
    def __init__(self, vocab: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocab.splitlines())}
        self.whole = PerfectHash(self.ranks)
        self.find = regex.compile(pattern).findall
        self.match = regex.compile(pattern).match
        self.bytes_of = {str(i): b for b, i in self.ranks.items()}

    def piece(self, text: str) -> list[int]:
        b = text.encode()
        i = self.whole.get(b)
        return merge(b, self.ranks) if i is None else [i]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.find(text) for i in self.piece(p)]


def read_vocab(path: str) -> bytes:
    """The vocabulary's file, whose size is checked before it is sent to executors."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCAB_BYTES + 1)
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCAB_BYTES} bytes")
    return data


@lru_cache(maxsize=2)
def encoder(vocab: bytes, pattern: str) -> Encoder:
    """One for each Python worker, not for each task."""
    return Encoder(vocab, pattern)


def decimal_ids(vocab: bytes, pattern: str):
    """A function from a text to its ids as decimals, each behind a space, and the mapping from a decimal to its bytes."""
    e = encoder(vocab, pattern)
    memo = _memo(vocab, pattern)
    find, get = e.find, memo.__getitem__

    def run(text: str) -> str:
        ids = "".join(map(get, find(text)))
        memo.trim()
        return ids

    return run, e.bytes_of


@lru_cache(maxsize=2)
def _memo(vocab: bytes, pattern: str) -> Memo:
    e = encoder(vocab, pattern)
    return Memo(lambda p: "".join(f" {i}" for i in e.piece(p)))


def encode_decode(df: DataFrame, vocab: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; ids: also the ids themselves."""
    sent = df.sparkSession.sparkContext.broadcast(vocab)

    def make():
        run, bytes_of = decimal_ids(sent.value, pattern)

        def f(text):
            s = run(text or "")
            parts = s.split()
            decoded = b"".join(map(bytes_of.__getitem__, parts))
            out = len(parts), sha256(s[1:]), sha256(decoded)
            return (*out, np.array(s.split(), np.int32)) if ids else out

        return f

    return per_text(id_and_text(df, id_col, text_col), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids, make)
