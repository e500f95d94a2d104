"""Benchmark decontamination. One Aho-Corasick automaton over the benchmark's items; a text is scanned once.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lowered. A document word is hit if it
lies in an occurrence of a window: `window` consecutive words of an item, or the whole of a shorter one. The automaton holds
blocks of fewer words, at every few words of an item, such that each window contains one; that takes a sixth of what all
windows would. Around a block found, the few windows that may contain it are looked up as a whole. Texts are scanned as words joined by spaces, between spaces, so that matches begin and end at words; a
match's place there gives the words that are hit, and these their places in the original text.

Null or empty texts: no words, not contaminated. An item with no words has no window. Very long texts: whole, in one scan.
Repeated items and rows each count; ties don't arise, as every item found is listed. Items of null id hit words, but aren't
listed. An empty table gives no rows, an empty benchmark hits nothing. Extra columns, whatever their names, are ignored
(contaminated) or left as they are (clean_rows).

Up to max_bytes of blocks make one automaton, of some 50 bytes for each, and some 200 bytes for each window beside it. A larger
benchmark is dealt into several, of which a task holds one at a time; what each finds is written and then joined to the documents.
The driver holds the items of two automata at most, too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, checkpointed, sha256

WINDOW = 10
#: Characters of the blocks in one automaton.
MAX_BYTES = 4 << 20

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def blocks(n: int, window: int) -> list[tuple[int, int]]:
    """(first word, word behind the last) of the blocks of an item of n words: each of its windows contains one."""
    if n <= window:
        return [(0, n)] if n else []
    step = -(-window // 3)
    return [(k, k + window - step + 1) for k in range(0, n - window + step, step) if k + window - step < n]


class Finder:
    """items: (id, text). The automaton has a block once, with the places that windows around it may begin; which windows there are,
    and the items of each, is one mapping. So what an occurrence of a block costs doesn't depend on how many items share it."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.ids = [i for i, _ in items]
        around: dict[bytes, set[tuple[int, int]]] = {}
        windows: dict[bytes, list[int]] = {}
        for k, (_, text) in enumerate(items):
            w = words(text)
            n = min(window, len(w))
            for a, b in blocks(len(w), window):
                starts = range(max(0, b - n), min(a, len(w) - n) + 1)
                around.setdefault(b" ".join(w[a:b]), set()).update((a - s, n) for s in starts)
                for s in starts:
                    own = windows.setdefault(b" ".join(w[s : s + n]), [])
                    if not own or own[-1] != k:
                        own.append(k)
        shared: dict[tuple, tuple] = {}
        same = lambda x: shared.setdefault(x, x)
        self.windows = {key: same(tuple(own)) for key, own in windows.items()}
        self.automaton = ahocorasick.Automaton() if around else None
        for block, places in around.items():
            self.automaton.add_word(f" {block.decode('latin-1')} ", (block.count(b" ") + 1, same(tuple(sorted(places)))))
        if around:
            self.automaton.make_automaton()

    def scan(self, w: list[bytes]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """For each window that occurs: its first word, the word behind its last, and the items that have it."""
        if self.automaton is None:
            return
        joined = (b" " + b" ".join(w) + b" ").decode("latin-1")
        at, seen = 0, 0
        for end, (n, places) in self.automaton.iter(joined):
            seen += joined.count(" ", at, end)
            at = end
            for left, size in places:
                s = seen - n - left
                if s >= 0 and s + size <= len(w):
                    items = self.windows.get(b" ".join(w[s : s + size]))
                    if items:
                        yield s, s + size, items


_FINDERS: dict[bytes, Finder] = {}


def _finder(sent: tuple[bytes, list, int]) -> Finder:
    """The last one is kept for a worker's next task."""
    digest, items, window = sent
    if digest not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[digest] = Finder(items, window)
    return _FINDERS[digest]


def finders(items: DataFrame, item_col: str, text_col: str, window: int, max_bytes: int) -> Iterator:
    """A broadcast for each max_bytes of blocks; at least one."""
    rows = items.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    sc = items.sparkSession.sparkContext

    def sent(held):
        return sc.broadcast((hashlib.sha256(repr((held, window)).encode()).digest(), held, window))

    held, size, some = [], 0, False
    for i, t in rows.toLocalIterator():
        w = words(t)
        own = sum(sum(map(len, w[a:b])) + b - a + 1 for a, b in blocks(len(w), window))
        if held and size + own > max_bytes:
            yield sent(held)
            held, size, some = [], 0, True
        if w:
            held.append((i, t))
            size += own
    if held or not some:
        yield sent(held)


def _union(runs: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(runs):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _looked(finder: Finder, text: str | None) -> tuple[int, list[int], list[str]]:
    """The number of words, the runs of words that are hit, and the items."""
    w = words(text)
    found = list(finder.scan(w))
    items = {k for own in {id(f[2]): f[2] for f in found}.values() for k in own}
    return len(w), _union([f[:2] for f in found]), sorted(i for i in {finder.ids[k] for k in items} if i is not None)


def _shown(text: str | None, n: int, hit: list[int], names: list[str], listed: bool) -> tuple:
    """The row of the result behind its id."""
    places = [m.span() for m in WORD.finditer(text.translate(_LOWER))] if hit else []
    spans = [(places[a][0], places[b - 1][1]) for a, b in zip(hit[::2], hit[1::2], strict=True)]
    names = sorted(names)
    out = n, sum(b - a for a, b in zip(hit[::2], hit[1::2], strict=True)), len(names), sha256(",".join(names)), bool(hit), ",".join(f"{a}:{b}" for a, b in spans)
    return (*out, names) if listed else out


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES, listed: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of the hit runs in the text, start:end) for each row; listed: also the items."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", *(["items"] if listed else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), *([pa.list_(pa.string())] if listed else [])]
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string" + ", items array<string>" * listed

    def table(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * (len(kinds) - 1)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, kinds[1:], strict=True))], names=names)

    one, more = _several(finders(items, item_col, item_text_col, window, max_bytes))
    if more is None:

        def run(batches):
            finder = _finder(one.value)
            for batch in batches:
                yield table(batch.column(0), [_shown(t, *_looked(finder, t), listed) for t in batch.column(1).to_pylist()])

        return docs.mapInArrow(run, schema)

    found = hits(docs, more).groupBy("key").agg(F.flatten(F.collect_list("hit")).alias("hit"), F.flatten(F.collect_list("names")).alias("names"))  # a row for each automaton
    both = docs.withColumn("key", F.sha2("text", 256)).join(found, "key", "left").select("doc_id", "text", "hit", "names")

    def finish(batches):
        for batch in batches:
            rows = [_shown(t, len(words(t)), _union(list(zip(h[::2], h[1::2], strict=True))) if h else [], list(set(n or ())), listed) for t, h, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield table(batch.column(0), rows)

    return both.mapInArrow(finish, schema)


def _several(sent: Iterator) -> tuple:
    """The first of one or more broadcasts, and None or all of several."""
    first = next(sent)
    second = next(sent, None)
    return first, None if second is None else chain([first, second], sent)


def hits(docs: DataFrame, sent: Iterable) -> DataFrame:
    """key (a digest of the text), hit, names: for each automaton a row for each different text in which it finds something. What one
    found is written before the next is made, and its broadcast goes."""
    out = None
    for one in sent:

        def run(batches, one=one):
            finder = _finder(one.value)
            for batch in batches:
                rows = [(key, hit, names) for key, t in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True) for _, hit, names in [_looked(finder, t)] if hit]
                cols = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())), strict=True)], names=["key", "hit", "names"])

        got = docs.select(F.sha2("text", 256).alias("key"), "text").mapInArrow(run, "key string, hit array<int>, names array<string>")
        got = checkpointed(got.groupBy("key").agg(F.first("hit").alias("hit"), F.first("names").alias("names")))  # equal texts have equal hits
        one.destroy()
        out = got if out is None else out.unionByName(got)
    return out


def clean_rows(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of df, with df's columns, whose text no window occurs in."""
    bounded_batches(df.sparkSession)
    one, more = _several(finders(items, item_col, item_text_col, window, max_bytes))
    if more is not None:
        text = F.col(f"`{text_col}`").cast("string")
        found = hits(df.select(text.alias("text")), more).select("key").distinct()
        rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.sha2(text, 256).alias("key"))
        return rows.join(found, "key", "left_anti").select(*(F.col(f"row.`{c}`") for c in df.columns))
    k = df.columns.index(text_col)

    def run(batches):
        finder = _finder(one.value)
        for batch in batches:
            yield batch.filter(pa.array([next(finder.scan(words(t)), None) is None for t in batch.column(k).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


SQL = r"""
WITH b AS (SELECT DISTINCT item_id::VARCHAR AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
v AS (SELECT item, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS w FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
x AS (SELECT k, i, l.n, array_to_string(ws[i : i + l.n - 1], ' ') AS w FROM p, (SELECT DISTINCT n FROM v) l WHERE i + l.n - 1 <= len(ws)),
m AS (SELECT k, i, x.n, item FROM x JOIN v ON x.n = v.n AND x.w = v.w),
j AS (SELECT DISTINCT k, unnest(range(i, i + n)) AS j FROM m),
h AS (SELECT k, count(*)::BIGINT AS n_hit FROM j GROUP BY k),
z AS (SELECT k, list_transform(string_split_regex(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: length(x)) AS gaps, list_transform(ws, lambda x: length(x)) AS sizes FROM d WHERE k IN (SELECT k FROM j)),
e AS (SELECT k, j, list_sum(gaps[1:j]) + coalesce(list_sum(sizes[1:j - 1]), 0) AS b, sizes[j] AS n, j - row_number() OVER (PARTITION BY k ORDER BY j) AS run FROM j JOIN z USING (k)),
o AS (SELECT k, string_agg(b || ':' || e, ',' ORDER BY b) AS spans FROM (SELECT k, min(b)::BIGINT AS b, max(b + n)::BIGINT AS e FROM e GROUP BY k, run) GROUP BY k),
s AS (SELECT k, count(DISTINCT item)::BIGINT AS n_items, coalesce(string_agg(DISTINCT item, ',' ORDER BY item), '') AS items FROM m GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN h USING (k) LEFT JOIN s USING (k) LEFT JOIN o USING (k)
"""
