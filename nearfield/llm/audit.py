"""What filters of a corpus remove alone, together and in each order.

Four filters look at a text; the fifth is failed by a document whose text stands under a smaller id as well. For that one, texts
are routed by fingerprint: a pair RDD is dealt by xxhash and sorted by it, and a chain for each fingerprint holds the full texts
that share it, each with its least id. What is not of the least id is emitted as a copy. A task settles the copies among its own
rows before they are routed, so that of a text in any number of rows each task sends a few at most, and chains are held for one
fingerprint at a time. A document is then a mask of the filters that it fails; combineByKey adds vectors of counts by mask for
each part, and everything that is asked about orders follows from the 32 counts of a part.

Null text: as the empty text. Null part: as the empty string. Null id: neither a copy nor the origin of one. Rows of one id and one
text: none is a copy of another; each counts. An id that has several labels has each kind that one of them gives; null labels give
none. Very long texts: whole. Texts of equal fingerprint are compared in full. An empty table gives no rows; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Bytes of texts that a task holds to settle copies before it routes them.
LOCAL_BYTES = 16 << 20
#: Bytes of texts that a shuffle partition of routed texts gets about, and has to sort.
PARTITION_BYTES = 32 << 20
#: Settled rows that are routed together.
TOGETHER = 1000

_UPPER, _SIGNS = bytes(range(65, 91)), b"#$%&*|"


def failed(text: str, data: bytes) -> int:
    """The mask of A to D: few words, repeated words, capitals, signs."""
    words = data.split()  # at ASCII white space
    few = len(words) < 200
    dull = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(data) - len(data.translate(None, _UPPER))) > 2 * len(text)
    signs = len(data.translate(None, _SIGNS)) < len(data)
    return few | dull << 1 | loud << 2 | signs << 3


class Chains:
    """For each fingerprint the texts that have it, as [text, mask, least id, {part: rows of that id}]."""

    def __init__(self):
        self.held: dict[int, list[list]] = {}
        self.size = 0

    def add(self, h: int, text: bytes, mask: int, i: int, parts: dict[str, int]) -> Iterable[tuple]:
        """Takes rows of one id and text; returns those known to be copies now, as (id, part, mask, rows)."""
        chain = self.held.setdefault(h, [])
        for entry in chain:
            if entry[0] == text:
                break
        else:
            chain.append([text, mask, i, parts])
            self.size += len(text)
            return ()
        if i == entry[2]:
            for p, n in parts.items():
                entry[3][p] = entry[3].get(p, 0) + n
            return ()
        if i < entry[2]:
            i, parts, entry[2:] = entry[2], entry[3], [i, parts]
        return [(i, p, mask | COPY, n) for p, n in parts.items()]

    def drained(self) -> Iterator[tuple]:
        """(fingerprint, text, mask, least id, parts), and no more is held."""
        held, self.held, self.size = self.held, {}, 0
        return ((h, *entry) for h, chain in held.items() for entry in chain)


def masked(docs: DataFrame, id_col: str, text_col: str, part_col: str, bits: int = 64, local_bytes: int = LOCAL_BYTES, partitions: int | None = None) -> RDD:
    """(id, part, mask, rows) of all documents. bits: of the fingerprint."""
    col = lambda c: F.col(f"`{c}`")
    table = docs.select(col(id_col).cast("long"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(col(part_col).cast("string"), F.lit("")))
    cut = (1 << bits) - 1

    def route(rows):
        chains, settled = Chains(), []

        def batch():
            out = xxhash.xxh3_64_intdigest(repr(settled[0])) & cut, (None, 0, 0, settled[:])
            settled.clear()
            return out

        for i, text, part in rows:
            data = text.encode()
            mask = failed(text, data)
            if i is None:
                settled.append((None, part, mask, 1))
            else:
                settled += chains.add(xxhash.xxh3_64_intdigest(data) & cut, data, mask, i, {part: 1})
            if len(settled) >= TOGETHER:
                yield batch()
            if chains.size > local_bytes:
                yield from ((h, entry) for h, *entry in chains.drained())
        yield from ((h, entry) for h, *entry in chains.drained())
        if settled:
            yield batch()

    def settle(routed):
        now, chains = None, Chains()

        def least():
            return ((i, p, mask, n) for _, _, mask, i, parts in chains.drained() for p, n in parts.items())

        for h, (text, mask, i, parts) in routed:
            if text is None:
                yield from parts
                continue
            if h != now:
                yield from least()
                now = h
            yield from chains.add(h, text, mask, i, parts)
        yield from least()

    n = partitions
    if n is None:
        size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    return table.rdd.mapPartitions(route).repartitionAndSortWithinPartitions(n, lambda h: h).mapPartitions(settle)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id of each row whose text stands under a smaller id as well."""
    rows = masked(docs.withColumn("__part", F.lit("")), id_col, text_col, "__part", **how)
    return docs.sparkSession.createDataFrame(rows.filter(lambda r: r[2] & COPY).flatMap(lambda r: [(r[0],)] * r[3]), "doc_id long", verifySchema=False)


def flags(labels: DataFrame) -> DataFrame:
    """id, good, toxic of ids that have a label of either kind."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def vectors(rows: RDD, partitions: int) -> RDD:
    """(part, counts by mask of rows, of good ones and of toxic ones) from (part, (mask, rows, good, toxic))."""
    size = 1 << len(FILTERS)

    def add(v, x):
        mask, n, good, toxic = x
        v[mask] += n
        v[size + mask] += good * n
        v[2 * size + mask] += toxic * n
        return v

    return rows.combineByKey(lambda x: add([0] * (3 * size), x), add, lambda a, b: [x + y for x, y in zip(a, b, strict=True)], partitions)


def report(part: str, v: list[int]) -> Iterator[tuple]:
    """A row for each order and step of a part."""
    size = 1 << len(FILTERS)
    counts = [(m, v[m], v[size + m], v[2 * size + m]) for m in range(size) if v[m]]
    total = lambda want, k=1: sum(c[k] for c in counts if want(c[0]))
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    # What a filter does depends on the set of those before it only.
    seen: dict[tuple[str, int], tuple] = {}
    for f, b in bit.items():
        for before in range(size):
            if not before & b:
                here = lambda m: m & b and not m & before  # noqa: E731, B023
                seen[f, before] = (total(lambda m: not m & (before | b)), total(here), total(lambda m: m & b and m & before), total(here, 2), total(here, 3))  # noqa: B023
    steps = [(order, k, f, sum(bit[x] for x in order[:k])) for order in ORDERS for k, f in enumerate(order)]
    shapley = dict.fromkeys(FILTERS, 0)
    for _, _, f, before in steps:
        shapley[f] += seen[f, before][1]
    alone = {f: total(lambda m: m == b) for f, b in bit.items()}  # noqa: B023
    for order, k, f, before in steps:
        kept, removed, redundant, good, toxic = seen[f, before]
        yield part, order, k + 1, kept, removed, redundant, alone[f], good, toxic, shapley[f]


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", **how) -> DataFrame:
    """For each part, order of the filters and step: documents kept, removed, failed but gone already, failing this filter only;
    removed ones labelled good or toxic; and removed ones summed over all orders. labels: doc_id, quality, toxic."""
    spark = docs.sparkSession
    slim = spark.createDataFrame(masked(docs, id_col, text_col, part_col, **how), "id long, part string, mask int, n long", verifySchema=False)
    known = flags(labels)
    rows = slim.join(known, slim["id"] == known["__id"], "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    counts = vectors(rows.rdd.map(lambda r: (r[0], tuple(r[1:]))), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.createDataFrame(counts.flatMap(lambda x: report(*x)), SCHEMA, verifySchema=False)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS s, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * s::INT + 16 * e::INT AS mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN g USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM x p, x q, x r, x s, x t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
k AS (SELECT filter_order, step, x.b AS bit, (SELECT coalesce(sum(y.b), 0) FROM x y WHERE instr(filter_order, y.l) < step) AS before
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o) JOIN x ON x.l = filter_order[step]),
u AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (bit | before::INT) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before::INT = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before::INT > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before::INT = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before::INT = 0), 0) AS toxic_lost
  FROM v CROSS JOIN k GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM u
"""
