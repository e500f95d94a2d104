"""Quality rules with DataFrame functions only: fixed base rules, then thresholds that each language and source sets itself.

The thresholds come from mergeable quantile sketches: a value is rounded down to its six leading bits, and a sketch is
the count for each such value. Sketches merge by adding counts, so tasks and groups combine in any order with equal
results; a group has at most some two thousand counts, and a quantile is off by at most 1/32 of its value.

A document fails where a measure lies beyond the quartiles of its group by more than `reach` times their distance plus
the measure's slack. That of `repeats`, 200 per mille, is the base rule's cutoff, so its threshold rejects nothing that the
base rule keeps, in any group: it has no effect, the fixed cutoff alone decides. Groups of fewer than min_group documents use their language's thresholds, or else everyone's.

Null or empty text: no words, so base_failed. Null language or source: a group of its own. Very long texts: whole. Ties lie
on the same side of a threshold. Repeated rows each count and are each judged. An empty table gives no rows. Other columns,
whatever their names, are left as they are (filtered) or ignored (report).

Counts are computed once, as rows of some hundred bytes without the text. The filter then drops the rows whose text, language
and source were rejected, by a join on a digest of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.common import bounded_scans, checkpointed, few

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: For each measure: its slack, and whether low values fail as well. Per mille, but for ten times the word length.
#: Lines count as ten at least and words get twenty of five letters, so that one line or word doesn't decide on a short text.
MEASURES = {"symbols": (40, False), "dup_lines": (300, False), "repeats": (200, False), "word_len": (20, True)}

#: The most groups whose thresholds are broadcast: 100 bytes each. More are joined by a shuffle, with skewed keys split.
MAX_GROUPS = 50_000


def _positions(pairs: Column) -> Column:
    """The sorted starts of windows that another start shares, from sorted (hash, start) structs."""
    near = F.zip_with(pairs, F.slice(pairs, F.lit(2), F.size(pairs)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    same = F.filter(near, lambda p: (p.a.h == p.b.h) & (F.slice("__w", p.a.i + 1, F.lit(WINDOW)) == F.slice("__w", p.b.i + 1, F.lit(WINDOW))))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p.a.i, p.b.i)))))


def measured(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **more: Column) -> DataFrame:
    """A struct column __q with the counts of each row's text, beside the struct __row of lang, source and the columns `more`."""
    bounded_scans(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = {"lang": F.col(f"`{lang_col}`"), "source": F.col(f"`{source_col}`"), **more}
    out = df.select(F.struct(*(c.alias(k) for k, c in row.items())).alias("__row"), text.alias("__t"))
    out = out.withColumn("__w", F.array_remove(F.split("__t", SPACE), ""))
    out = out.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("__w")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("__w", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("__h", hashes)
    # Most texts repeat no window; only the others are sorted.
    pairs = F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    out = out.withColumn("__p", pairs)
    out = out.withColumn("__p", _positions(F.col("__p")))
    gaps = F.zip_with("__p", F.slice("__p", F.lit(2), F.size("__p")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    q = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count("__t", F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.when(F.size("__p") > 0, F.aggregate(gaps, F.lit(0), lambda s, x: s + x)).otherwise(0).cast("long"),
    }
    # The row number keeps the optimizer from pushing conditions on the counts below this, where each use would compute them again.
    return out.select("__row", F.struct(*(c.alias(k) for k, c in q.items())).alias("__q"), F.monotonically_increasing_id().alias("__k"))


def base_failed(q: Column) -> Column:
    return (q.n_words < 10) | (100 * q.n_repeat_words > 20 * q.n_words)


def measures(q: Column) -> dict[str, Column]:
    ratio = lambda a, b, k: F.floor(F.lit(k) * a / F.greatest(b, F.lit(1))).cast("long")
    return {"symbols": ratio(q.n_symbols, q.word_chars, 1000), "dup_lines": ratio(q.n_dup_lines, F.greatest(q.n_lines, F.lit(10)), 1000), "repeats": ratio(q.n_repeat_words, q.n_words, 1000), "word_len": ratio(q.word_chars + 100, q.n_words + 20, 10)}


def leading_bits(v: Column) -> Column:
    """v >= 0 with all but its six leading bits cleared."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - 6)
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(df: DataFrame, lang: Column, source: Column) -> DataFrame:
    """lang, source, measure, lo, c: the sketch of each measure in each group, from rows that have __q."""
    got = measures(F.col("__q"))
    each = df.select(lang.alias("lang"), source.alias("source"), F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), leading_bits(v).alias("lo")) for k, v in got.items()))).alias("m"))
    return each.groupBy("lang", "source", "m.measure", "m.lo").agg(F.count("*").alias("c"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "measure", "lo").agg(F.sum("c").alias("c"))


def fences(sketch: DataFrame, by: list[str], reach: float) -> DataFrame:
    """For each group its size n and the bounds of each measure, low_* and high_*."""
    w = Window.partitionBy(*by, "measure")
    cum = sketch.withColumn("n", F.sum("c").over(w)).withColumn("up", F.sum("c").over(w.orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)))
    q = cum.groupBy(*by, "measure").agg(F.max("n").alias("n"), F.min(F.when(4 * F.col("up") >= F.col("n"), F.col("lo"))).alias("q1"), F.min(F.when(4 * F.col("up") >= 3 * F.col("n"), F.col("lo"))).alias("q3"))
    reached = F.lit(float(reach)) * (F.col("q3") - F.col("q1"))
    pick = lambda k, c: F.max(F.when(F.col("measure") == k, c))
    cols = [pick(k, F.col("q3") + reached + slack).alias(f"high_{k}") for k, (slack, _) in MEASURES.items()]
    cols += [pick(k, F.col("q1") - reached - slack).alias(f"low_{k}") for k, (slack, low) in MEASURES.items() if low]
    return q.groupBy(*by).agg(F.max("n").alias("n"), *cols)


def thresholds(sketch: DataFrame, reach: float, min_group: int) -> DataFrame:
    """One row for each language and source with the bounds that hold there, from its own sketch or from a merged one."""
    names = [f"high_{k}" for k in MEASURES] + [f"low_{k}" for k, (_, low) in MEASURES.items() if low]
    renamed = lambda d, p: d.select(*(F.col(c).alias(f"{p}_{c}") for c in d.columns))
    own = fences(sketch, ["lang", "source"], reach)
    langs = renamed(fences(merged(sketch, "lang"), ["lang"], reach), "l")
    all_ = renamed(fences(merged(sketch), [], reach), "a")
    out = own.join(langs, own["lang"].eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(all_), F.lit(True), "left")  # all_ has one row
    value = lambda c: F.when(F.col("n") >= min_group, F.col(c)).when(F.col("l_n") >= min_group, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    return out.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *(value(c).alias(f"__{c}") for c in names))


def judged(rows: DataFrame, sketch: DataFrame, lang: Column, source: Column, reach: float = 3.0, min_group: int = 50, max_groups: int = MAX_GROUPS) -> DataFrame:
    """rows, which have __q, with __failed (the base rules) and __kept."""
    bounds = checkpointed(thresholds(sketch, reach, min_group))
    if bounds.count() <= max_groups:
        bounds = F.broadcast(bounds)
    rows = rows.join(bounds, lang.eqNullSafe(F.col("__lang")) & source.eqNullSafe(F.col("__source")), "left")
    q, got = F.col("__q"), measures(F.col("__q"))
    ok = (F.col("__k") >= 0) & ~base_failed(q)
    for k, (_, low) in MEASURES.items():
        ok = ok & F.coalesce(got[k] <= F.col(f"__high_{k}"), F.lit(True))
        if low:
            ok = ok & F.coalesce(got[k] >= F.col(f"__low_{k}"), F.lit(True))
    return rows.withColumn("__failed", base_failed(q)).withColumn("__kept", ok)


def _verdicts(slim: DataFrame, **how) -> DataFrame:
    lang, source = F.col("__row.lang"), F.col("__row.source")
    return judged(slim, sketches(slim, lang, source), lang, source, **how)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **how) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row."""
    slim = checkpointed(measured(df, text_col, lang_col, source_col, doc_id=F.col(f"`{id_col}`").cast("long")), shuffled=False)  # the texts are read once
    out = _verdicts(slim, **how)
    return out.select("__row.doc_id", *(F.col(f"__q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))


def filtered(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **how) -> DataFrame:
    """The rows of df that are kept, with df's columns."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256))
    slim = checkpointed(measured(df, text_col, lang_col, source_col, digest=digest), shuffled=False)
    out, size = _verdicts(slim, **how), slim.agg(F.sum("__q.word_chars")).first()[0] or 0
    drop = out.where("NOT __kept").select("__row.*").distinct()
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), digest.alias("__d"))
    same = (F.col("__d") == drop["digest"]) & F.col(f"__row.`{lang_col}`").eqNullSafe(drop["lang"]) & F.col(f"__row.`{source_col}`").eqNullSafe(drop["source"])
    return few(rows.join(drop, same, "left_anti"), size).select(*(F.col(f"__row.`{c}`") for c in df.columns))


#: The same with one quantile step spelled out; {reach} and {min_group} are the production parameters.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT k, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS s FROM g),
r AS (SELECT k, i FROM h QUALIFY count(*) OVER (PARTITION BY k, s) > 1),
rw AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM r) GROUP BY k),
q AS (SELECT w.k, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rw.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rw USING (k)),
m AS (SELECT k, lang, source, unnest([{'m': 'symbols', 'v': 1000 * n_symbols // greatest(word_chars, 1)}, {'m': 'dup_lines', 'v': 1000 * n_dup_lines // greatest(n_lines, 10)},
  {'m': 'repeats', 'v': 1000 * n_repeat_words // greatest(n_words, 1)}, {'m': 'word_len', 'v': 10 * (word_chars + 100) // (n_words + 20)}]) AS u FROM q),
b AS (SELECT k, lang, source, u.m AS m, u.v AS v, (u.v >> greatest(0, length(bin(u.v)) - 6)) << greatest(0, length(bin(u.v)) - 6) AS lo FROM m),
o AS (SELECT lang, source, m, count(*) AS n, quantile_disc(lo, 0.25) AS q1, quantile_disc(lo, 0.75) AS q3 FROM b GROUP BY ALL),
l AS (SELECT lang, m, count(*) AS n, quantile_disc(lo, 0.25) AS q1, quantile_disc(lo, 0.75) AS q3 FROM b GROUP BY ALL),
a AS (SELECT m, quantile_disc(lo, 0.25) AS q1, quantile_disc(lo, 0.75) AS q3 FROM b GROUP BY ALL),
s AS (SELECT * FROM (VALUES ('symbols', 40), ('dup_lines', 300), ('repeats', 200), ('word_len', 20)) AS x(m, slack)),
t AS (SELECT o.lang, o.source, o.m, slack, CASE WHEN o.n >= 50 THEN o.q1 WHEN l.n >= 50 THEN l.q1 ELSE a.q1 END AS q1, CASE WHEN o.n >= 50 THEN o.q3 WHEN l.n >= 50 THEN l.q3 ELSE a.q3 END AS q3
  FROM o JOIN l ON o.m = l.m AND o.lang IS NOT DISTINCT FROM l.lang JOIN a ON a.m = o.m JOIN s ON s.m = o.m),
f AS (SELECT b.k, bool_or(b.v > t.q3 + 3 * (t.q3 - t.q1) + slack OR (b.m = 'word_len' AND b.v < t.q1 - 3 * (t.q3 - t.q1) - slack)) AS bad
  FROM b JOIN t ON b.m = t.m AND b.lang IS NOT DISTINCT FROM t.lang AND b.source IS NOT DISTINCT FROM t.source GROUP BY b.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT bad AS kept FROM q JOIN f USING (k)
"""
