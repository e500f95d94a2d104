"""Removal of repeated byte strings: a byte goes if a string of `least` bytes around it also starts in a smaller document.

What has to meet is found by anchors. Of the 16-byte grams in a window of `least` bytes, the one of least hash is the
window's anchor, so equal windows have equal anchors. Consecutive windows with one anchor are a segment of `least` to
2 * least - 16 bytes. The steps, each a shuffle of packed arrays by a part of the documents or a bucket of hashes:

1. each part of the documents sends its distinct anchor hashes, 8 bytes each;
2. buckets answer with two bits for each: whether more than one document has it, and whether it is hot;
3. parts send the segments of shared anchors, one of each content, with its place and its document;
4. in a bucket, segments are sorted, and of each content one goes on; all suffixes of these that begin a window are
   sorted, and equal strings get the least document of all; the answer is, for each segment, its windows to strike;
5. parts strike the bytes of those windows.

Both sorts in 4 are the same mergesort, whose comparisons find two suffixes' common extension by binary search over
prefix polynomial hashes. Its order is then verified byte by byte, and redone from the bytes if a collision misled it.
Hashes only bring together what may be equal: wherever strings are taken for equal, their bytes were compared.

An anchor with HOT segments or more sends its windows singly, to buckets by the window's own hash: then what one task
gets for one string is one record from each part, however many documents have it and whatever stands around it.

Memory: a part holds PART_BYTES of texts and a bucket some BUCKET_BYTES of compressed segments, of which it sorts about
SLICE_BYTES at a time. A document longer than a part is a part of its own, hashed in chunks of CHUNK_BYTES.

Null text: as the empty text. Texts shorter than `least` are kept whole. Very long texts: whole, in chunks that overlap.
Rows that share a doc_id, and equal rows, don't strike each other. A null id counts as larger than all others, and such
rows don't strike each other; they are dealt by their texts. Strings that repeat within one document only are kept. An
empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, sha256

LEAST, GRAM = 50, 16
#: Segments of different content in a part, summed over parts, from which on an anchor is hot: some MB in one bucket.
HOT = 1 << 14
#: Bytes of text in a part, for a bucket, hashed at once, and of segments sorted at once.
PART_BYTES, BUCKET_BYTES, CHUNK_BYTES, SLICE_BYTES = 8 << 20, 16 << 20, 1 << 19, 1 << 20
#: Bytes of text whose rows make a partition of the result.
OUT_BYTES = 32 << 20
#: Into how many ranges of hashes a bucket's segments are ordered, so that slices can be cut.
RANGES = 256
NULL_ID = (1 << 63) - 1

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
#: Bits of a place in a chunk. The others of a gram's hash choose the anchor, the first place of equals, in any chunk alike.
_PLACE = U(CHUNK_BYTES.bit_length() + 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    size = 1
    with np.errstate(over="ignore"):
        while size < n:
            step = U(pow(base, size, 1 << 64))
            out[size : 2 * size] = out[: min(size, n - size)] * step
            size *= 2
    return out


class Prefix:
    """Polynomial hashes, modulo 2**64, of any substrings of a buffer."""

    _pow = _inv = np.ones(1, np.uint64)

    def __init__(self, buf: np.ndarray):
        n = len(buf) + 1
        if len(Prefix._pow) < n:
            Prefix._pow, Prefix._inv = _powers(_BASE, n), _powers(_INV, n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((buf.astype(np.uint64) + U(1)) * Prefix._pow[: n - 1], out=self.sums[1:])

    def of(self, at: np.ndarray, n) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * Prefix._inv[at]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def gram_hashes(buf: bytes) -> np.ndarray:
    """Of the 16 bytes from each place."""
    n = len(buf) - GRAM + 1
    word = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    return mix(mix(word[:n] * U(_BASE)) + word[8 : 8 + n])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - width + size], a[width - size :]) if size < width else a


def segments(buf: bytes, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and last window of each segment, and its anchor's hash; windows don't reach over the ends of texts."""
    if len(buf) < least:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h = gram_hashes(buf)
    key = ((h >> _PLACE) << _PLACE) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_min(key, least - GRAM + 1) & ((U(1) << _PLACE) - U(1))).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, np.int64)
    stops = np.asarray(ends[:-1], np.int64)
    np.add.at(edge, np.clip(stops - least + 1, 0, len(anchor)), 1)
    np.add.at(edge, np.minimum(stops, len(anchor)), -1)
    valid = np.cumsum(edge[:-1]) == 0
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.ones(len(anchor), bool)
    stop[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    return first, last, h[anchor[first]]


class Part:
    """The rows of one part, in the order of their ids and texts, so that a place in their joined bytes is a row's for good."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int):
        data = [(t or "").encode() for t in texts]
        self.rows = sorted(range(len(ids)), key=lambda k: (ids[k], data[k]))
        self.ids, self.data, self.least = np.array([ids[k] for k in self.rows], np.int64), [data[k] for k in self.rows], least
        self.ends = np.cumsum([len(b) for b in self.data], dtype=np.int64) if self.data else np.zeros(0, np.int64)

    def _chunks(self):
        """The place of a chunk, its bytes, and the ends of texts in it. A longer text comes in chunks that share least - 1 bytes."""
        held, size, at = [], 0, 0
        for b in self.data:
            if held and size + len(b) > CHUNK_BYTES:
                yield at, held
                at, held, size = at + size, [], 0
            if len(b) > CHUNK_BYTES:
                for k in range(0, len(b) - self.least + 1, CHUNK_BYTES):
                    yield at + k, [b[k : k + CHUNK_BYTES + self.least - 1]]
                at += len(b)
            else:
                held.append(b)
                size += len(b)
        if held:
            yield at, held

    def each(self):
        """For each chunk: its bytes, and of its segments the first and the last window in it, the hash, the place in the part, the document."""
        for at, held in self._chunks():
            buf = b"".join(held)
            first, last, h = segments(buf, np.cumsum([len(b) for b in held]), self.least)
            place = at + first
            yield buf, first, last, h, place, self.ids[np.searchsorted(self.ends, place, side="right")]


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Compressed, each behind its size and its compressed size; what parts and buckets exchange is mostly text and close numbers."""
    out = []
    for a in arrays:
        data = a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes()
        z = pa.compress(data, codec="zstd", asbytes=True) if data else b""
        out += [len(data).to_bytes(8, "little"), len(z).to_bytes(8, "little"), z]
    return b"".join(out)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n, z = int.from_bytes(blob[at : at + 8], "little"), int.from_bytes(blob[at + 8 : at + 16], "little")
        out.append(np.frombuffer(pa.decompress(blob[at + 16 : at + 16 + z], n, codec="zstd") if n else b"", kind))
        at += 16 + z
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which compress better."""
    return np.diff(a, prepend=a.dtype.type(0))


def _bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a hash, and its range within the bucket."""
    m = mix(h)
    return (m >> U(33)).astype(np.int64) % buckets, (m & U(RANGES - 1)).astype(np.int64)


def _split(by: np.ndarray):
    """The places of each value in by, in order."""
    order = np.argsort(by, kind="stable")
    cuts = np.flatnonzero(np.diff(by[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            yield int(by[group[0]]), group


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count in turn."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


I64, BIN = pa.int64(), pa.binary()


def _rows(names: list[str], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, BIN if n == "data" else I64) for c, n in zip(cols, names, strict=True)], names=names)


def _anchors(part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part's distinct anchor hashes, whether several documents here have each, and how many segments of different hash each has."""
    got = []
    for buf, first, last, h, _, doc in part.each():
        n = last - first + part.least
        got.append((h, doc, Prefix(np.frombuffer(buf, np.uint8)).of(first, n) + n.astype(np.uint64)))
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint32)
    h, doc, content = (np.concatenate([g[k] for g in got]) for k in range(3))
    order = np.lexsort((content, h))
    h, doc, content = h[order], doc[order], content[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    other = new.copy()
    other[1:] |= content[1:] != content[:-1]
    start = np.flatnonzero(new)
    if not len(start):
        return h, np.zeros(0, bool), np.zeros(0, np.uint32)
    several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
    return h[start], several, np.add.reduceat(other.astype(np.uint32), start)


def part_anchors(table: pa.Table, least: int, buckets: int) -> pa.Table:
    """Step 1: bucket, part, and packed: the hashes, whether several documents here have each, how many segments."""
    h, several, n = _anchors(Part(table["id"].to_pylist(), table["text"].to_pylist(), least))
    pid = table["pid"][0].as_py()
    return _rows(["bucket", "pid", "data"], [(b, pid, _pack(_steps(h[g]), np.packbits(several[g]), n[g])) for b, g in _split(_bucket(h, buckets)[0])])


def bucket_shared(table: pa.Table) -> pa.Table:
    """Step 2: part, bucket, and packed for each of the part's hashes, in order: whether it is shared, whether it is hot."""
    got = [_unpack(x.as_py(), np.uint64, np.uint8, np.uint32) for x in table["data"]]
    h = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
    several = np.concatenate([np.unpackbits(g[1], count=len(g[0])).astype(bool) for g in got])
    n = np.concatenate([g[2] for g in got])
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, int)
    size = np.diff(np.r_[start, len(h)])
    shared, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h):
        shared[order] = np.repeat((size > 1) | np.logical_or.reduceat(several[order], start), size)
        hot[order] = np.repeat(np.add.reduceat(n[order].astype(np.int64), start) >= HOT, size)
    rows, at = [], 0
    for pid, bucket, g in zip(table["pid"].to_pylist(), table["bucket"].to_pylist(), got, strict=True):
        mine = slice(at, at + len(g[0]))
        at += len(g[0])
        if shared[mine].any():
            rows.append((pid, bucket, _pack(np.packbits(shared[mine]), np.packbits(hot[mine]))))
    return _rows(["pid", "bucket", "data"], rows)


def _member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h


def part_segments(docs: pa.Table, told: pa.Table, least: int, buckets: int) -> pa.Table:
    """Step 3: bucket, part, and packed: of each segment of different content the least place, document, size and bytes, by
    ranges; and of equal ones the place, which one it equals, and whether its document is larger."""
    names = ["bucket", "pid", "data"]
    if not told.num_rows or not docs.num_rows:
        return _rows(names, [])
    part = Part(docs["id"].to_pylist(), docs["text"].to_pylist(), least)
    h, _, _ = _anchors(part)
    flags = np.zeros((2, len(h)), bool)
    answers = dict(zip(told["bucket"].to_pylist(), told["data"].to_pylist(), strict=True))
    for b, g in _split(_bucket(h, buckets)[0]):
        if b in answers:
            for k, bits in enumerate(_unpack(answers[b], np.uint8, np.uint8)):
                flags[k, g] = np.unpackbits(bits, count=len(g)).astype(bool)
    shared, hot = h[flags[0]], h[flags[1]]

    # The first of each content, in the order of places and so of documents, stands for all; a dictionary compares the bytes.
    known: dict[bytes, int] = {}
    kept, twins = [], []
    total = 0
    for buf, first, last, hashes, place, doc in part.each():
        k = np.flatnonzero(_member(hashes, shared))
        if not len(k):
            continue
        at, size, doc, place, to = first[k], last[k] - first[k] + least, doc[k], place[k], hashes[k]
        single = _member(to, hot)
        if single.any():
            count = np.where(single, size - least + 1, 1)
            off = _within(count)
            at, doc, place, to, single = np.repeat(at, count) + off, np.repeat(doc, count), np.repeat(place, count) + off, np.repeat(to, count), np.repeat(single, count)
            size = np.where(single, least, np.repeat(size, count))
            to[single] = Prefix(np.frombuffer(buf, np.uint8)).of(at[single], least)
        which = [known.setdefault(buf[a : a + n], total + i) for i, (a, n) in enumerate(zip(at.tolist(), size.tolist(), strict=True))]
        which = np.array(which, np.int64)
        own = which == total + np.arange(len(which))
        kept.append((total + np.flatnonzero(own), place[own], doc[own], size[own], to[own]))
        twins.append((which[~own], place[~own], doc[~own]))
        total += len(which)
    if not total:
        return _rows(names, [])
    number, place, doc, size, to = (np.concatenate([x[k] for x in kept]) for k in range(5))
    equals, twin_place, twin_doc = (np.concatenate([x[k] for x in twins]) for k in range(3))
    equals = np.searchsorted(number, equals)
    data = list(known)  # in the order of their numbers
    bucket, rank = _bucket(to, buckets)
    twins_of = dict(_split(bucket[equals])) if len(equals) else {}
    pid, rows = docs["pid"][0].as_py(), []
    for b, g in _split(bucket):
        g = g[np.argsort(rank[g], kind="stable")]
        t = twins_of.get(b, np.zeros(0, np.int64))
        back = np.zeros(len(place), np.int64)
        back[g] = np.arange(len(g))
        text = b"".join([data[i] for i in g.tolist()])
        ranges = np.bincount(rank[g], minlength=RANGES).astype(np.uint32)
        rows.append((b, pid, _pack(ranges, _steps(place[g]), doc[g], size[g].astype(np.uint8), text, _steps(twin_place[t]), back[equals[t]].astype(np.int32), twin_doc[t] > doc[equals[t]])))
    return _rows(names, rows)


class Suffixes:
    """Suffixes of a buffer, compared in their first bytes, as many as `depth` says: one number, or one for each place."""

    def __init__(self, buf: np.ndarray, depth: int | np.ndarray):
        self.buf, self.prefix = buf, Prefix(buf)
        self.most = int(depth if np.isscalar(depth) else depth.max(initial=1))
        self.depth = depth if np.isscalar(depth) else depth.astype(np.int64)
        self.steps = [1 << k for k in range(self.most.bit_length() - 1, -1, -1)]

    def _depth(self, at: np.ndarray) -> np.ndarray:
        return np.full(len(at), self.depth) if np.isscalar(self.depth) else self.depth[at]

    def below(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a < suffix b, or a <= b where or_equal, both of one depth, by a binary search for their common extension."""
        same, depth = np.zeros(len(a), np.int64), self._depth(a)
        for step in self.steps:
            fits = same + step <= depth
            n = np.where(fits, step, 0)
            same += np.where(fits & (self.prefix.of(a + same, n) == self.prefix.of(b + same, n)), step, 0)
        done = same == depth
        k = np.where(done, 0, same)
        return np.where(done, or_equal, self.buf[a + k] < self.buf[b + k])

    def sorted(self, pos: np.ndarray) -> np.ndarray:
        """pos by depth, then in the order of their suffixes: dealt by the first bytes, then each run of equals merged bottom-up,
        all runs at once."""
        head = np.zeros(len(pos), np.uint64)
        for k in range(8):
            head = (head << U(8)) | self.buf[pos + k].astype(np.uint64)
        depth = self._depth(pos)
        order = np.lexsort((head, depth)) if not np.isscalar(self.depth) else np.argsort(head, kind="stable")
        pos, head, depth = pos[order], head[order], depth[order]
        start = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (depth[1:] != depth[:-1])])
        size = np.diff(np.r_[start, len(pos)])
        begin, count = np.repeat(start, size), np.repeat(size, size)
        width = 1
        while width < size.max(initial=0):
            at = np.flatnonzero(count > width)
            rank = at - begin[at]
            block = rank // width
            lo = begin[at] + (block ^ 1) * width
            hi = np.minimum(lo + width, begin[at] + count[at])
            lo = np.minimum(lo, hi)
            sibling, right, x = lo.copy(), block % 2 == 1, pos[at]
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) // 2
                up = self.below(pos[mid], x[open_], right[open_])
                lo[open_[up]], hi[open_[~up]] = mid[up] + 1, mid[~up]
                open_ = open_[lo[open_] < hi[open_]]
            merged = begin[at] + (block // 2) * 2 * width + (rank - block * width) + (lo - sibling)
            pos[merged] = x
            width *= 2
        return pos

    def runs(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """pos in order, and whether each begins a run of equal suffixes; both verified on the bytes."""
        by_hash = self.sorted(pos.copy())
        seen = np.zeros(len(self.buf), bool)
        seen[by_hash] = True  # comparisons that collisions make inconsistent may lose a place to another
        new = self._compared(by_hash) if seen.sum() == len(pos) else None
        if new is not None:
            return by_hash, new
        rows, depth = self._bytes(pos)
        pos = pos[np.lexsort((*rows.T[::-1], depth))]
        return pos, self._compared(pos)

    def _bytes(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        depth, rows = self._depth(pos), np.zeros((self.most, len(pos)), np.uint8)
        for k in range(self.most):
            np.multiply(self.buf[pos + k], k < depth, out=rows[k])
        return rows.T, depth

    def _compared(self, pos: np.ndarray) -> np.ndarray | None:
        new = np.ones(len(pos), bool)
        for k in range(0, len(pos) - 1, 20_000):
            rows, depth = self._bytes(pos[k : k + 20_001])
            differ = rows[1:] != rows[:-1]
            first = differ.argmax(1)
            some, as_deep = differ[np.arange(len(first)), first], depth[1:] == depth[:-1]
            i = np.flatnonzero(some & as_deep)
            if (rows[i, first[i]] > rows[i + 1, first[i]]).any():
                return None
            new[k + 1 : k + 1 + len(first)] = some | ~as_deep
        return new


def _strikes(data: bytes, size: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each segment its windows that start in a smaller document too, as bits; data: the segments' bytes in turn."""
    begin = np.cumsum(size) - size
    buf = np.frombuffer(data + b"\0" * (2 * least), np.uint8)
    depth = np.full(len(buf), least, np.uint8)
    depth[begin] = size
    s = Suffixes(buf, depth)
    # One of each content goes on, with the least document that has it.
    order, new = s.runs(begin)
    back = np.searchsorted(begin, order)
    starts = np.flatnonzero(new)
    doc_of = np.minimum.reduceat(doc[back], starts)
    of = np.zeros(len(size), np.int64)
    of[back] = np.cumsum(new) - 1
    one = back[starts]
    count = size[one] - least + 1
    at, least_doc = np.repeat(begin[one], count) + _within(count), np.repeat(doc_of, count)
    # A string whose hash none shares equals no other.
    s.depth, s.most = least, least
    h = s.prefix.of(at, least)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    some = np.sort(order[np.r_[same, False] | np.r_[False, same]])
    if len(some):
        by_place = some[np.argsort(at[some])]
        pos, new = s.runs(at[by_place])
        back = by_place[np.searchsorted(at[by_place], pos)]
        starts = np.flatnonzero(new)
        least_doc[back] = np.repeat(np.minimum.reduceat(least_doc[back], starts), np.diff(np.r_[starts, len(pos)]))
    first, bits = np.cumsum(count) - count, np.zeros(len(size), np.uint64)
    for k in range(int(count.max(initial=0))):
        has = np.flatnonzero(count[of] > k)
        bits[has] |= (least_doc[first[of[has]] + k] < doc[has]).astype(np.uint64) << U(k)
    return bits


def bucket_matches(table: pa.Table, least: int) -> pa.Table:
    """Step 4: part, bucket, and packed: places of segments and their windows to strike, as bits."""
    kinds = (np.uint32, np.int64, np.int64, np.uint8, np.uint8, np.int64, np.int32, np.bool_)
    got = [_unpack(x.as_py(), *kinds) for x in table["data"]]
    if not got:
        return _rows(["pid", "bucket", "data"], [])
    # behind[row, r], bytes[row, r]: the segments of a row before range r, and their bytes.
    behind = np.stack([np.r_[0, np.cumsum(g[0], dtype=np.int64)] for g in got])
    sizes = [np.r_[0, np.cumsum(g[3], dtype=np.int64)] for g in got]
    bytes_ = np.stack([z[b] for z, b in zip(sizes, behind, strict=True)])
    bits = [np.zeros(len(g[3]), np.uint64) for g in got]
    total, lo = bytes_.sum(0), 0
    while lo < RANGES:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + SLICE_BYTES, side="right")) - 1)
        rows = np.flatnonzero(behind[:, hi] > behind[:, lo])
        if len(rows):
            cut = [slice(behind[r, lo], behind[r, hi]) for r in rows]
            data = b"".join([got[r][4][bytes_[r, lo] : bytes_[r, hi]].tobytes() for r in rows])
            found = _strikes(data, np.concatenate([got[r][3][c] for r, c in zip(rows, cut, strict=True)]).astype(np.int64), np.concatenate([got[r][2][c] for r, c in zip(rows, cut, strict=True)]), least)
            at = 0
            for r, c in zip(rows, cut, strict=True):
                bits[r][c] = found[at : at + c.stop - c.start]
                at += c.stop - c.start
        lo = hi
    out = []
    for pid, bucket, g, own in zip(table["pid"].to_pylist(), table["bucket"].to_pylist(), got, bits, strict=True):
        place, twin_place = np.cumsum(g[1]), np.cumsum(g[5])
        all_ = (U(1) << (g[3][g[6]] - least + 1).astype(np.uint64)) - U(1)
        place, strike = np.r_[place, twin_place], np.r_[own, np.where(g[7], all_, own[g[6]])]
        keep = np.flatnonzero(strike)
        if len(keep):
            keep = keep[np.argsort(place[keep])]
            out.append((pid, bucket, _pack(_steps(place[keep]), strike[keep])))
    return _rows(["pid", "bucket", "data"], out)


def part_removals(docs: pa.Table, told: pa.Table, least: int):
    """Step 5: yields for each row its number, bytes and a mask of the bytes that go."""
    part = Part(docs["id"].to_pylist(), docs["text"].to_pylist(), least)
    total = int(part.ends[-1]) if len(part.ends) else 0
    struck = np.zeros(total, bool)  # the places where a window to strike begins
    for x in told["data"]:
        place, bits = _unpack(x.as_py(), np.int64, np.uint64)
        place = np.cumsum(place)
        for k in range(2 * least):
            if not bits.any():
                break
            struck[place[(bits & U(1)).astype(bool)] + k] = True
            bits = bits >> U(1)
    begin = 0
    for k, data, end in zip(part.rows, part.data, part.ends.tolist(), strict=True):
        own = struck[begin:end]
        begin = end
        if own.any():
            upto = np.cumsum(own, dtype=np.int32)
            upto[least:] -= upto[:-least].copy()
            own = upto > 0
        yield k, data, own


def dealt(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) with id, in whose order documents are, and pid, the part: by id, or by text where there is none."""
    by = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("pid", F.pmod(by, F.lit(parts)))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row; kept: also the bytes that stay, and the removed runs as (start, end)."""
    if not 24 <= least <= 78:  # the anchor's gram, and the bits of a segment's windows
        raise ValueError("least must be from 24 to 78")
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts, buckets = max(2 * cores, -(-size // PART_BYTES)), max(2 * cores, -(-size // BUCKET_BYTES))
    by_part = dealt(docs, parts).repartition(parts, "pid").groupBy("pid")  # about a part for a task, so that a sort by pid is small
    kinds = "pid long, bucket long, data binary"
    anchors = by_part.applyInArrow(lambda t: part_anchors(t, least, buckets), "bucket long, pid long, data binary")
    shared = anchors.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(bucket_shared, kinds)
    found = by_part.cogroup(shared.groupBy("pid")).applyInArrow(lambda t, s: part_segments(t, s, least, buckets), "bucket long, pid long, data binary")
    told = found.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: bucket_matches(t, least), kinds)

    def removed(t: pa.Table, s: pa.Table) -> pa.Table:
        ids, rows = t["doc_id"].to_pylist(), []
        for k, data, gone in part_removals(t, s, least):
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            rest = np.frombuffer(data, np.uint8)[~gone].tobytes() if len(edges) else data
            rows.append((ids[k], len(data), int(gone.sum()), len(edges) // 2, sha256(rest), *((rest, edges.tolist()) if kept else ())))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        kinds = [I64, I64, I64, I64, pa.string(), BIN, pa.list_(pa.int32())]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds[: 7 if kept else 5], strict=False)], names=names[: 7 if kept else 5])

    out = by_part.cogroup(told.groupBy("pid")).applyInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<int>" * kept)
    return out.coalesce(max(2 * cores, -(-size // OUT_BYTES)))  # else a small file for each part


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT k, doc_id, i, substr(h, (2 * i + 1)::BIGINT, 100) AS s FROM (SELECT *, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT k, i FROM p JOIN (SELECT s, min(doc_id) AS least FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)) USING (s) WHERE doc_id > least),
c AS (SELECT DISTINCT k, unnest(range(i, i + 50)) AS j FROM m),
b AS (SELECT k, j, NOT coalesce(lag(j) OVER (PARTITION BY k ORDER BY j) = j - 1, false) AS new FROM c),
r AS (SELECT k, count(*)::BIGINT AS n, count(*) FILTER (new)::BIGINT AS spans FROM b GROUP BY k),
y AS (SELECT k, unnest(range(0, length(h) // 2)) AS j, h FROM d WHERE k IN (SELECT k FROM r)),
t AS (SELECT k, string_agg(substr(h, (2 * j + 1)::BIGINT, 2), '' ORDER BY j) AS rest FROM y ANTI JOIN c USING (k, j) GROUP BY k)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN r.k IS NULL THEN h ELSE coalesce(rest, '') END)) AS kept_sha256 FROM d LEFT JOIN r USING (k) LEFT JOIN t USING (k)
"""
