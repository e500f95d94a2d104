"""Graphs as edge tables: degrees, entry point, deletion, healing, compaction, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.vectors import l2
from nearfield.operators.evaluate import in_ranges
from nearfield.plans.session import kept


def degrees(edges: DataFrame, end: str) -> DataFrame:
    return edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree"))


def selected(candidates: DataFrame, x: DataFrame, m: Column, degrees: DataFrame | None = None, penalty: float = 0.15) -> DataFrame:
    """src, dst: of each src's candidates (src, dst, dist) up to m, by a sequential rule: the nearest first, one is taken unless one
    taken before is nearer to it than src is; free places go to the nearest rejected. x: id, v of the candidates. m: a column over
    src. degrees (id, degree): distances from a taken node count more by penalty times its degree over the mean.

    A src's candidates are sorted and folded in one expression, so a group is as large as its candidates; a dst of many candidates
    is joined with a single row. Ties: by dst. Candidates without a vector are left out; a src of null m gets none.
    """
    rows = candidates.select("src", "dst", "dist").join(x.select(F.col("id").alias("dst"), "v"), "dst").where("v IS NOT NULL")
    weight = F.lit(1.0)
    if degrees is not None:
        mean = degrees.agg(F.greatest(F.lit(1.0), F.avg("degree")).alias("__mean"))
        rows = rows.join(degrees.select(F.col("id").alias("dst"), "degree"), "dst", "left").join(F.broadcast(mean), F.lit(True))  # one row
        weight = 1 + F.lit(penalty) * F.coalesce("degree", F.lit(0)) / F.col("__mean")
    by = rows.select("src", F.struct("dist", "dst", "v", weight.alias("w")).alias("c")).groupBy("src").agg(F.array_sort(F.collect_list("c")).alias("cs")).withColumn("m", m)
    none = F.array().cast(by.schema["cs"].dataType)
    nearer = lambda a, c: F.exists(a.yes, lambda s: F.round(l2(s.v, c.v), 9) * s.w < c.dist)

    def step(a, c):
        take = (F.size(a.yes) < F.col("m")) & ~nearer(a, c)
        return F.struct(F.when(take, F.concat(a.yes, F.array(c))).otherwise(a.yes).alias("yes"), F.when(take, a.no).otherwise(F.concat(a.no, F.array(c))).alias("no"))

    folded = F.aggregate("cs", F.struct(none.alias("yes"), none.alias("no")), step, lambda a: F.slice(F.concat(a.yes, a.no), F.lit(1), F.greatest(F.col("m"), F.lit(0))))
    return by.where("m IS NOT NULL").select("src", F.explode(folded).alias("c")).select("src", F.col("c.dst").alias("dst"))


def entry_point(edges: DataFrame, live: DataFrame) -> DataFrame:
    """The live node of most edges on the highest layer that has a live one with an edge; the least id of equals. edges: layer, src, dst."""
    by = edges.groupBy("layer", "src").agg(F.count("*").alias("degree")).join(live.select(F.col("id").alias("src")), "src", "left_semi")
    return by.orderBy(F.desc("layer"), F.desc("degree"), "src").limit(1).select(F.col("src").alias("id"), "layer", "degree")


def tombstones_after(tombstones: DataFrame, asked: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all tombstones, those that are new): ids that exist and aren't dead yet, once each."""
    new = asked.select("id").distinct().join(nodes.select("id"), "id", "left_semi").join(tombstones, "id", "left_anti")
    return tombstones.unionByName(new), new


#: Edges into a dead node whose sources meet its other neighbours in one group.
HEAL_ROWS = 10_000


def _torn(edges: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges between live nodes (src, dst); (x, src) and (x, dst): live nodes with an edge to and from a dead x."""
    gone = dead.select(F.col("id").alias("x"))
    alive = lambda d, c: d.join(gone, d[c] == gone["x"], "left_anti")
    lost = alive(edges, "src").join(gone, edges.dst == F.col("x")).select("x", "src")
    out = alive(edges, "dst").join(gone, edges.src == F.col("x")).select("x", "dst")
    return alive(alive(edges, "src"), "dst").select("src", "dst"), lost, out


def heal_pairs(edges: DataFrame, dead: DataFrame, rows: int = HEAL_ROWS) -> DataFrame:
    """src, dst: the pairs that healing may link: live nodes with edges to and from one dead node. The sources of a dead hub are dealt
    into groups of about `rows`, each of which meets the hub's few own neighbours."""
    _, lost, out = _torn(edges, dead)
    shares = lost.groupBy("x").agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("n"))
    dealt = lost.join(shares, "x").withColumn("s", F.pmod(F.xxhash64("src"), F.col("n")).cast("int")).drop("n")  # each x is one row of shares
    copied = out.join(shares, "x").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    return dealt.join(copied, ["x", "s"]).where("src <> dst").select("src", "dst").distinct()


def healed(edges: DataFrame, dead: DataFrame, dist: DataFrame, capacity: int, repairs: int = 1) -> DataFrame:
    """src, dst: edges to and from dead nodes go, and a live node that lost one gets links to the nearest other live neighbours of
    the dead node that it has no link to yet, up to `repairs` for each dead node while it has less than `capacity`.

    edges: src, dst; dist: src, dst, dist of the pairs that may be linked, once each. These meet the dead nodes that their src has
    lost, which are few, and then the edges (dead node, dst): so a hub's sources never meet its neighbours on the hub alone.
    """
    live, lost, out = _torn(edges, dead)
    may = dist.where("src <> dst").join(live, ["src", "dst"], "left_anti")
    cand = may.join(lost, "src").join(out, ["x", "dst"], "left_semi")
    w = Window.partitionBy("x", "src").orderBy("dist", "dst")
    new = cand.withColumn("r", F.row_number().over(w)).where(F.col("r") <= repairs).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    room = live.groupBy("src").agg(F.count("*").alias("n"))
    new = new.join(room, "src", "left").withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst")))
    return live.unionByName(new.where(F.coalesce("n", F.lit(0)) + F.col("r") <= capacity).select("src", "dst"))


def compact_ids(nodes: DataFrame, dead: DataFrame) -> DataFrame:
    """id, new_id: survivors numbered from 0 in order, by counts of id ranges, so that no task numbers them all."""
    ranged = in_ranges(nodes.select("id").join(dead.select("id"), "id", "left_anti"), ["id"])
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("c"))
    before = sizes.select("__p", F.coalesce(F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("__p").orderBy("id")) - 1
    return ranged.withColumn("__k", place).join(F.broadcast(before), "__p").select("id", (F.col("__before") + F.col("__k")).alias("new_id"))


def compact_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    a, b = ids.select(F.col("id").alias("src"), F.col("new_id").alias("new_src")), ids.select(F.col("id").alias("dst"), F.col("new_id").alias("new_dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def reachable(edges: DataFrame, start: DataFrame, max_rounds: int = 1000, every: int = 5) -> DataFrame:
    """id: breadth first, one join a round on the frontier; lineage is cut every few rounds."""
    seen = frontier = start.select(F.col("id").cast("long"))
    step = kept(edges.select("src", F.col("dst").alias("id")).distinct())
    for k in range(max_rounds):
        frontier = kept(step.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select("id").distinct().join(seen, "id", "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier)
        if k % every == every - 1:
            seen = kept(seen)
    raise RuntimeError(f"not all reached in {max_rounds} rounds")
