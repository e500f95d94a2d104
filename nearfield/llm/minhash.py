"""Near-duplicate documents by min-max hashing. Of each permutation both the least and the largest value are kept, so 60
hash evaluations a shingle give a signature of 120 values, cut into 24 bands of 5.

Only one document of each distinct shingle set goes on. Documents that agree in a band share a bucket. The bucket's
centre is the member that lies in the fullest buckets, which for copies of one text tends to be the original; links of
members to centres are confirmed on full sets and joined into components. Where members of a bucket are in different
components after that, the other pairs of it are compared as well. Large buckets are dealt into blocks, each pair of
blocks, a cell, to one task, so no task holds more than two blocks. A cell compares signatures only; pairs that pass
are confirmed on full sets by a join with the texts. A cell in which more than PAIRS pairs a member pass is dense: its
members come together once more with their texts, and pairs are confirmed there one at a time, without being written.

No bucket is capped. A pair of similarity 0.85 shares no band with probability 1e-6, one of 0.8 with 1e-4.

Words are runs without white space, with A-Z lowered; a text of fewer words than a shingle is one shingle as a whole.
Null or empty text, or no words: empty set, linked with nothing, a component of its own. Very long texts: whole; a
bucket's blocks are smaller by their shingles. Ties: of equal sets, or of centres of equal score, the least doc_id. Rows that
share a doc_id are one document with the links of all of them. Null ids: not linked, kept. An empty table gives no rows.
Extra columns, whatever their names, are left as they are (one_of_each) or ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.bpe import Memo
from nearfield.llm.common import bounded_batches, checkpointed, few
from nearfield.llm.components import components

SHINGLE, BANDS, ROWS = 5, 24, 5
PERMUTATIONS = BANDS * ROWS // 2
#: Members of a bucket's block, and their shingles; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 2000, 500_000
#: How far below the threshold a pair's estimated similarity may be: over four standard deviations.
SLACK = 0.15
#: Of a text, for each of its shingles.
BYTES = 8
#: Likely pairs for each member from which on a cell is dense.
PAIRS = 4

_SEEDS = np.random.RandomState(20240229)
_MASK = np.array([_SEEDS.randint(0, 1 << 62) for _ in range(PERMUTATIONS)], np.uint64)
_ODD = np.array([_SEEDS.randint(0, 1 << 62) * 2 + 1 for _ in range(PERMUTATIONS)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_words = Memo(xxhash.xxh3_64_intdigest)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    _words.trim()
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = out * _STEP + _mix(h[k : k + n])
    return np.unique(_mix(out + np.uint64(min(len(words), SHINGLE))))


def signature(s: np.ndarray) -> np.ndarray:
    """The least values, then the largest, of a non-empty set."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max), np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(s), 2048):
        h = (s[k : k + 2048, None] ^ _MASK) * _ODD
        low, high = np.minimum(low, h.min(0)), np.maximum(high, h.max(0))
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """sig[document, value] -> a key for each band, which holds least values or largest ones only."""
    out = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = _mix(out * _STEP + sig[:, k::ROWS])
    return out.view(np.int64)


def signed(df: DataFrame) -> DataFrame:
    """df: doc_id, text. Returns doc_id, n (set size), set (a digest of the set), text_key, sig (a byte of each value), bands."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            some = [k for k, s in enumerate(sets) if len(s)]
            sigs = np.stack([signature(sets[k]) for k in some]) if some else np.zeros((0, 2 * PERMUTATIONS), np.uint64)
            keys, short = band_keys(sigs), (sigs >> np.uint64(56 - 8)).astype(np.uint8)
            row = dict(zip(some, range(len(some)), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    batch.column(2),
                    pa.array([short[row[k]].tobytes() if k in row else None for k in range(len(sets))], pa.binary()),
                    pa.array([keys[row[k]] if k in row else None for k in range(len(sets))], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "set", "text_key", "sig", "bands"],
            )

    return df.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, n long, set binary, text_key long, sig binary, bands array<long>")


def _alike(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The share of equal signature bytes of each row's two signatures."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS) for c in (a, b))
    return (x == y).mean(1)


def likely(edges: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The edges a, b whose signatures agree in a share of at least `least`; nodes: rep, sig."""
    for end in ("a", "b"):
        edges = edges.join(nodes.select(F.col("rep").alias(end), F.col("sig").alias(f"sig_{end}")), end)
    cols = edges.select("a", "b", "sig_a", "sig_b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array(_alike(batch.column(2), batch.column(3)) >= least))

    return cols.mapInArrow(run, "a long, b long").distinct()


def confirmed(edges: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The edges a, b whose full shingle sets have 100 * intersection >= percent * union; texts: rep, text."""
    for end in ("a", "b"):
        edges = edges.join(texts.select(F.col("rep").alias(end), F.col("text").alias(f"text_{end}")), end)

    def run(batches):
        known: dict = {}

        def of(node, text):
            got = known.get(node)
            if got is None or got[0] != text:
                if len(known) > 200:
                    known.clear()
                got = known[node] = text, shingles(text)
            return got[1]

        for batch in batches:
            keep = []
            for a, b, s, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = of(a, s), of(b, t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return edges.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


class _Cell:
    """rows: rep, comp, centre, size, sig, bands, and, where links are confirmed, text."""

    def __init__(self, rows: list[tuple], key: int, least: float, percent: int):
        self.rows, self.key, self.least, self.percent = rows, key, least, percent
        self.rep, self.comp, self.size = (np.array([r[k] for r in rows]) for k in (0, 1, 3))
        self.sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        self.bands = np.array([r[5] for r in rows])
        self.other = self.rep != np.array([r[2] for r in rows])

    def likely(self, k: int) -> np.ndarray:
        """The rows behind k in other components, neither one the centre, whose sizes and signatures allow a link; a pair that
        shares several bands counts in the bucket of the first."""
        if not self.other[k]:
            return np.zeros(0, int)
        n, size = self.size[k + 1 :], self.size[k]
        fits = 100 * np.minimum(n, size) >= self.percent * np.maximum(n, size)
        rest = np.flatnonzero(self.other[k + 1 :] & (self.comp[k + 1 :] != self.comp[k]) & fits) + k + 1
        rest = rest[(self.sig[rest] == self.sig[k]).mean(1) >= self.least]
        return rest[self.bands[k][(self.bands[rest] == self.bands[k]).argmax(1)] == self.key]

    def pairs(self) -> list[tuple[int, int]] | None:
        """The likely pairs, or None if the cell is dense."""
        out: list[tuple[int, int]] = []
        for k in range(len(self.rows) - 1):
            out += [(min(self.rep[k], self.rep[x]), max(self.rep[k], self.rep[x])) for x in self.likely(k)]
            if len(out) > PAIRS * len(self.rows):
                return None
        return out

    def links(self):
        """The links that tie different components, each confirmed on full sets when its turn comes."""
        sets: dict[int, np.ndarray] = {}

        def of(k):
            if k not in sets:
                sets[k] = shingles(self.rows[k][6])
            return sets[k]

        for k in range(len(self.rows) - 1):
            for x in self.likely(k).tolist():
                if self.comp[x] != self.comp[k]:
                    both = len(np.intersect1d(of(k), of(x), assume_unique=True))
                    if 100 * both >= self.percent * (self.size[k] + self.size[x] - both):
                        self.comp[self.comp == self.comp[x]] = self.comp[k]
                        yield min(self.rep[k], self.rep[x]), max(self.rep[k], self.rep[x])


CELL = ["key", "i", "j"]
MEMBER = ["rep", "comp", "centre", "size", "sig", "bands"]


def _by_cell(rows: DataFrame, columns: list[str], out, schema: str) -> DataFrame:
    """out(cell, its rows) -> a list of rows of `schema`, for each cell in turn; a cell's rows are all a task holds."""
    dealt = rows.select(F.xxhash64(*CELL).alias("cell"), *CELL, *columns).repartition("cell").sortWithinPartitions("cell", *CELL)
    names, kinds = [c.split()[0] for c in schema.split(", ")], [pa.int32() if c.endswith("int") else pa.int64() for c in schema.split(", ")]

    def run(batches):
        now, held = None, []

        def done():
            cols = list(zip(*out(now, held), strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for _, key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != now:
                    if len(held) > 1:
                        yield done()
                    now, held = (key, i, j), []
                held.append(tuple(row))
        if len(held) > 1:
            yield done()

    return dealt.mapInArrow(run, schema)


def other_links(members: DataFrame, texts: DataFrame, least: float, percent: int) -> DataFrame:
    """Links a, b between members of a bucket in different components, without those of its centre, which are done: in a dense cell
    as few as tie the components, in others all. members: key, blocks, rep, centre, comp, size, sig, bands; texts: rep, text."""
    members = members.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def look(cell, rows):
        got = _Cell(rows, cell[0], least, percent).pairs()
        return [(None, None, *cell)] if got is None else [(a, b, None, None, None) for a, b in got]

    found = checkpointed(_by_cell(cells, MEMBER, look, "a long, b long, key long, i int, j int"))
    links = confirmed(found.where("key IS NULL").select("a", "b").distinct(), texts, percent)
    dense = found.where("key IS NOT NULL").select(*CELL)
    if not dense.limit(1).count():
        return links
    both = members.join(dense, "key").where("own = i OR own = j").join(texts, "rep")
    more = _by_cell(both, [*MEMBER, "text"], lambda cell, rows: list(_Cell(rows, cell[0], least, percent).links()), "a long, b long")
    return links.unionByName(more).distinct()


def linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; percent: the least similarity of linked documents."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    least = percent / 100 - SLACK
    signs = checkpointed(signed(docs), shuffled=False)
    size = BYTES * (signs.agg(F.sum("n")).first()[0] or 0)
    some = signs.where("doc_id IS NOT NULL AND n > 0")
    first = F.min(F.struct("doc_id", "text_key"))
    nodes = some.groupBy("set").agg(first.alias("f"), F.first("n").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).select("set", F.col("f.doc_id").alias("rep"), F.col("f.text_key").alias("text_key"), "size", "sig", "bands")
    nodes = checkpointed(nodes, size=size)

    rows = nodes.select("rep", "size", F.explode("bands").alias("key"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), blocks.alias("blocks")).where("n > 1")
    rows = rows.drop("size")
    rows = checkpointed(rows.join(sizes, "key"), size=size)
    scores = rows.groupBy("rep").agg(F.sum("n").alias("score"))
    centres = rows.join(scores, "rep").groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("c"))).alias("m")).select("key", (-F.col("m.c")).alias("centre"))
    rows = checkpointed(rows.join(centres, "key"), size=size)
    stars = rows.where("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()

    texts = nodes.join(rows.select("rep").distinct(), "rep", "left_semi").select("rep", "text_key")
    texts = docs.withColumn("text_key", F.xxhash64("text")).withColumnRenamed("doc_id", "rep").join(texts, ["rep", "text_key"], "left_semi").dropDuplicates(["rep", "text_key"]).select("rep", "text")
    texts = checkpointed(texts, size=size)
    sigs = nodes.select("rep", "sig")

    links = checkpointed(confirmed(likely(stars, sigs, least), texts, percent))
    comp = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    in_comp = rows.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    mixed = in_comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    members = in_comp.where("n > 2").join(mixed, "key").select("key", "blocks", "rep", "centre", "comp")
    members = members.join(nodes.select("rep", "size", "sig", "bands"), "rep")
    more = checkpointed(other_links(members, texts, least, percent))
    if more.limit(1).count():
        comp = components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    # A document with several texts ties their sets together.
    ids = some.select("doc_id", "set").join(nodes.select("set", "rep"), "set").where("doc_id <> rep")
    split = some.groupBy("doc_id").agg(F.min("set").alias("x"), F.max("set").alias("y")).where("x <> y").select("doc_id")
    ties = ids.join(split, "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    if ties.limit(1).count():
        comp = components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(ties))

    comp = nodes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("set", F.coalesce("component", "rep").alias("component"))
    out = signs.select("doc_id", F.col("n").alias("n_shingles"), "set").join(comp, "set", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of df, with df's columns, that are the first of their component; of repeated rows of one id, one."""
    got = linked(df, id_col, text_col, percent)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    rest = rows.join(got.where("NOT kept").select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti")
    twice = got.where("kept AND doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    if twice.limit(1).count():
        rest = rest.join(twice, "id", "left_anti").unionByName(rest.join(twice, "id", "left_semi").dropDuplicates(["id"]))
    size = BYTES * (got.agg(F.sum("n_shingles")).first()[0] or 0)
    return few(rest, size).select(*(F.col(f"row.`{c}`") for c in df.columns))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh FROM g),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.d WHERE r.m < e.y)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, w.doc_id = c AS kept FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(m) AS c FROM r GROUP BY d) ON d = w.doc_id
"""
