"""Secret scans with DataFrame functions only: known forms by pattern, and strings that look drawn at random.

Candidates are runs of `shortest` to `longest` characters of the encodings' alphabets; a longer run is an encoded file, not a secret.
The smallest alphabet that holds a run is its encoding; runs of one kind of letters or of digits alone have none. Two questions are asked of a
run. Would a string drawn evenly from the alphabet look like it? A battery says no if, after Bonferroni's correction, the upper tail
of chi-squared over the alphabet, the runs above and below its middle, or the serial correlation of neighbours is less likely than
`alpha`. Would a natural string look so even? Its chi-squared is larger by the length times what the coincidence of its letters says,
so that long runs are told apart and short ones hardly. For each encoding and class of length, the Benjamini-Hochberg procedure picks the
runs of which at most a share `q` is natural. It works on p-values rounded up to a tenth of a power of ten, so that counts of
these are all it needs: they merge in any order, and a thousand or so lie in the largest table.

A run that overlaps a base span is left out. Null text: as the empty text, no spans. Very long texts: whole. Ties and repeated rows
are each judged by themselves, and count in the procedure as often as they stand. Null ids stay null. An empty table gives no rows;
extra columns, whatever their names, are ignored.

Texts are read once; what was found in them, without the text, is checkpointed and judged when all counts are known.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_scans, checkpointed


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The kinds in their order, with the pattern of each. For assign the value is what group 1 holds; the others' lengths
#: are in the pattern, which finds the same, as a run that is too short has no longer one within.
KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
BASE = {
    "assign": "(?:" + "|".join(map(_either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
}
VALUE = 6
KINDS = [*BASE, "random"]

#: Encodings in the order they are tried: what a run looks like, what it has to hold besides, its alphabet, and the chance that two
#: letters of a natural string are equal (of words and names 0.066; of numbers with some letters, twice that of even digits about).
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BOTH = "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", _BOTH, DIGITS + LOWER[:6], 0.125),
    "HEX": ("^[0-9A-F]+$", _BOTH, DIGITS + UPPER[:6], 0.125),
    "base32": ("^[A-Z2-7]+$", _BOTH, UPPER + "234567", 0.066),
    "base36": ("^[0-9a-z]+$", _BOTH, DIGITS + LOWER, 0.066),
    "BASE36": ("^[0-9A-Z]+$", _BOTH, DIGITS + UPPER, 0.066),
    "letters": ("^[A-Za-z]+$", "[A-Z].*[a-z]|[a-z].*[A-Z]", UPPER + LOWER, 0.066),
    "base62": ("^[0-9A-Za-z]+$", _BOTH, DIGITS + UPPER + LOWER, 0.066),
    "base64": ("^[0-9A-Za-z+/]+$", _BOTH, UPPER + LOWER + DIGITS + "+/", 0.066),
    "base64url": ("^[0-9A-Za-z_-]+$", _BOTH, UPPER + LOWER + DIGITS + "-_", 0.066),
}
RUN = r"[A-Za-z0-9+/_-]{%d,}"
SHORTEST, LONGEST, ALPHA, Q = 20, 4096, 0.001, 0.05
#: Tenths of powers of ten that p-values are counted by; lengths of a class, up to the last one.
BINS, CLASS, CLASSES = 300, 8, 8
#: Elements of a block of scan().
BLOCK = 256

#: Coefficients of a fit of the complementary error function, whose relative error is below 1.2e-7 everywhere.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def upper_tail(z: str) -> str:
    """In SQL: the chance that a standard normal value is above z."""
    x = f"(abs({z}) / sqrt(2.0D))"
    t = f"(1 / (1 + 0.5D * {x}))"
    poly = f"{ERFC[-1]}D"
    for c in ERFC[-2::-1]:
        poly = f"({c}D + {t} * {poly})"
    half = f"0.5D * {t} * exp({poly} - {x} * {x})"
    return f"(CASE WHEN {z} >= 0 THEN {half} ELSE 1 - {half} END)"


def scan(df: DataFrame, out: dict[str, tuple]) -> DataFrame:
    """df with, for each {name: (array column, zero, f)} and element of the array, f over those before it. By blocks, so that a long
    array isn't copied for each element."""
    kind = "bigint"

    def before(part: Column, start: Column, f) -> Column:
        acc = F.struct(start.cast(kind).alias("s"), F.array().cast(f"array<{kind}>").alias("o"))
        return F.aggregate(part, acc, lambda a, v: F.struct(f(a.s, v).cast(kind).alias("s"), F.concat(a.o, F.array(a.s)).alias("o")), lambda a: a.o)

    def blocks(c: str) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(c) - 1) / BLOCK).cast("int"))
        return F.when(F.size(c) > 0, F.transform(starts, lambda b: F.slice(c, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast(f"array<array<{kind}>>"))

    df = df.withColumns({f"__b{o}": blocks(c) for o, (c, _, _) in out.items()})
    df = df.withColumns({f"__s{o}": F.transform(f"__b{o}", lambda b: F.aggregate(b, F.lit(z).cast(kind), lambda a, v: f(a, v).cast(kind))) for o, (_, z, f) in out.items()})  # noqa: B023
    df = df.withColumns({f"__s{o}": before(F.col(f"__s{o}"), F.lit(z), f) for o, (_, z, f) in out.items()})
    df = df.withColumns({o: F.flatten(F.zip_with(f"__b{o}", f"__s{o}", lambda b, s: before(b, s, f))) for o, (_, _, f) in out.items()})  # noqa: B023
    return df.drop(*(f"__{x}{o}" for x in "bs" for o in out))


def matches(df: DataFrame, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """df with, for each {name: (pattern, group)}, an array of (start, end, value) of what pattern matches in __t; places in code
    points, values of group."""
    strings = F.array().cast("array<string>")
    some = lambda p, c: F.when(F.col("__t").rlike(p), c).otherwise(strings)
    size = lambda a: F.transform(a, lambda x: F.length(x).cast("bigint"))
    cols = {}
    for o, (p, group) in patterns.items():
        cols |= {f"__m{o}": some(p, F.regexp_extract_all("__t", F.lit(p), F.lit(0))), f"__g{o}": some(p, F.split("__t", p, -1))}  # matches, and what lies between them
        if group:
            cols[f"__v{o}"] = some(p, F.regexp_extract_all("__t", F.lit(p), F.lit(group)))
    df = df.withColumns(cols)
    df = df.withColumns({f"__n{o}": F.zip_with(size(F.col(f"__m{o}")), F.slice(f"__g{o}", F.lit(1), F.size(f"__m{o}")), lambda m, g: m + F.length(g)) for o in patterns})
    df = scan(df, {f"__at{o}": (f"__n{o}", 0, lambda a, v: a + v) for o in patterns})

    def spans(o: str, group: int) -> Column:
        ends = F.zip_with(F.zip_with(f"__at{o}", f"__n{o}", lambda a, n: a + n), f"__m{o}", lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end")))
        return F.zip_with(ends, f"__v{o}" if group else f"__m{o}", lambda s, v: F.struct(s.start.alias("start"), s.end.alias("end"), v.alias("value")))

    df = df.withColumns({o: spans(o, group) for o, (_, group) in patterns.items()})
    return df.drop(*(f"__{x}{o}" for x in ("m", "g", "v", "n", "at") for o in patterns))


def tested(df: DataFrame, col: str, longest: int, alpha: float) -> DataFrame:
    """df whose array `col` of (start, end, value) holds, of the values that have an encoding, (start, end, class, bin, even): class
    of encoding and length, bin of the chance that a natural string is as even, and whether the battery takes it for drawn evenly."""
    encoding = " ".join(f"WHEN x.value RLIKE '{form}' AND x.value RLIKE '{needs}' THEN named_struct('k', {k}, 'letters', '{letters}', 'same', {same}D)" for k, (form, needs, letters, same) in enumerate(ENCODINGS.values()))
    big = lambda *names: ", ".join(f"'{n}', 0L" for n in names)
    steps = [
        f"transform(filter({col}, x -> length(x.value) <= {longest}), x -> named_struct('start', x.start, 'end', x.end, 's', x.value, 'e', CASE {encoding} END))",
        f"transform(filter({col}, x -> x.e IS NOT NULL), x -> named_struct('start', x.start, 'end', x.end, 'k', x.e.k, 'size', length(x.e.letters), 'same', x.e.same, 'v', filter(transform(split(x.s, ''), c -> bigint(instr(x.e.letters, c))), v -> v > 0)))",
        # sq: the sum of the squares of how often each letter stands; the products begin with the first value's own square.
        f"""transform({col}, x -> named_struct('start', x.start, 'end', x.end, 'k', x.k, 'size', x.size, 'same', x.same, 'n', double(size(x.v)), 'v1', x.v[0], 'vn', element_at(x.v, -1),
          'sq', aggregate(array_sort(x.v), named_struct({big("last", "run", "sum")}), (a, v) -> named_struct('last', v, 'run', if(a.last = v, a.run + 1, 1L), 'sum', a.sum + if(a.last = v, 2 * a.run + 1, 1L)), a -> a.sum),
          'a', aggregate(x.v, named_struct('last', x.v[0], {big("x", "xx", "xy", "high", "turns")}), (a, v) -> named_struct('last', v, 'x', a.x + v, 'xx', a.xx + v * v, 'xy', a.xy + a.last * v,
            'high', a.high + if(2 * v > x.size, 1L, 0L), 'turns', a.turns + if((2 * v > x.size) <> (2 * a.last > x.size), 1L, 0L)))))""",
        f"""transform({col}, x -> named_struct('start', x.start, 'end', x.end, 'k', x.k, 'n', x.n, 'df', x.size - 1, 'chi', x.size * x.sq / x.n - x.n, 'var', 2 * (x.size - 1) * (x.n - 1) / x.n, 'more', x.n * (x.size * x.same - 1),
          'mid', 2 * x.a.high * (x.n - x.a.high) / x.n, 'turns', x.a.turns, 'dev', x.a.xx - x.n * (x.a.x / x.n) * (x.a.x / x.n), 'along', x.a.xy - x.v1 * x.v1 - (x.a.x / x.n) * (2 * x.a.x - x.v1 - x.vn) + (x.n - 1) * (x.a.x / x.n) * (x.a.x / x.n)))""",
        f"""transform({col}, x -> named_struct('start', x.start, 'end', x.end, 'k', x.k, 'n', x.n, 'even', (x.chi - x.df) / sqrt(x.var), 'natural', (x.chi - x.df - x.more) / sqrt(x.var + 4 * x.more),
          'runs', if(x.mid * (x.mid - 1) > 0, (x.turns - x.mid) / sqrt(x.mid * (x.mid - 1) / (x.n - 1)), 99D), 'serial', if(x.dev > 0, (x.along / x.dev + 1 / x.n) * sqrt(x.n), 99D)))""",
        f"""transform({col}, x -> named_struct('start', x.start, 'end', x.end, 'class', int(x.k * {CLASSES + 1} + least(floor(x.n / {CLASS}), {CLASSES})), 'p', {upper_tail("(-x.natural)")},
          'random', 3 * least({upper_tail("x.even")}, 2 * {upper_tail("abs(x.runs)")}, 2 * {upper_tail("abs(x.serial)")})))""",
        f"transform({col}, x -> named_struct('start', x.start, 'end', x.end, 'class', x.class, 'bin', int(if(x.p > 1e-{BINS // 10}D, least({BINS}, floor(-10 * log10(x.p))), {BINS})), 'even', x.random >= {alpha}D))",
    ]
    for step in steps:
        df = df.withColumn(col, F.expr(step))
    return df


def apart(df: DataFrame, runs: str, base: str) -> DataFrame:
    """df without those of `runs` that overlap a span of `base`; both are arrays of (start, end, ...)."""
    far = 1 << 62
    at = lambda c, k: F.transform(c, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(k).alias("base")))
    df = df.withColumn("__all", F.array_sort(F.concat(at(base, 1), at(runs, 0))))
    either = lambda yes, no: F.transform("__all", lambda s: F.when(s.base == 1, s[yes]).otherwise(no).cast("bigint"))
    df = df.withColumns({"__ends": either("end", 0), "__starts": F.reverse(either("start", far))})
    df = scan(df, {"__upto": ("__ends", 0, F.greatest), "__from": ("__starts", far, F.least)})
    # Both are in order of their places, so what is left of `all` without the base is in the order of the runs.
    met = F.zip_with("__all", F.zip_with("__upto", F.reverse("__from"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s, o: F.when(s.base == 0, (o.a <= s.start) & (o.b >= s.end)))
    df = df.withColumn("__free", F.filter(met, lambda x: x.isNotNull()))
    kept = F.filter(F.zip_with(runs, "__free", lambda r, x: F.when(x, r)), lambda r: r.isNotNull())
    return df.withColumn(runs, kept).drop("__all", "__ends", "__starts", "__upto", "__from", "__free")


def looked_at(df: DataFrame, id_col: str, text_col: str, shortest: int = SHORTEST, longest: int = LONGEST, alpha: float = ALPHA) -> DataFrame:
    """doc_id, __base: (start, end, kind) of the base kinds; __runs: tested candidates beside them."""
    bounded_scans(df.sparkSession)
    out = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__t"))
    out = matches(out, {f"__{kind}": (pattern, int(kind == "assign")) for kind, pattern in BASE.items()} | {"__runs": (RUN % shortest, 0)})
    spans = [F.expr(f"transform(filter(__{kind}, s -> length(s.value) >= {VALUE * (kind == 'assign')}), s -> named_struct('start', s.start, 'end', s.end, 'kind', {k}))") for k, kind in enumerate(BASE)]
    out = out.select("doc_id", F.array_sort(F.concat(*spans)).alias("__base"), "__runs")
    return tested(apart(out, "__runs", "__base"), "__runs", longest, alpha)


def least_bins(found: DataFrame, q: float) -> DataFrame:
    """One row with a map from class to its least bin that is taken, for classes that have one: the step-up procedure on counts."""
    counts = found.select(F.explode("__runs").alias("r")).groupBy("r.class", "r.bin").agg(F.count("*").alias("c"))
    by = counts.groupBy("class").agg(F.sum("c").alias("m"), F.collect_list(F.struct("bin", "c")).alias("bins"))  # at most BINS + 1 in each
    up = lambda b: F.aggregate(F.filter("bins", lambda x: x.bin >= b.bin), F.lit(0).cast("bigint"), lambda a, x: a + x.c)
    taken = F.filter("bins", lambda b: F.col("m") * F.pow(F.lit(10.0), -b.bin / F.lit(10.0)) <= q * up(b))
    by = by.select("class", F.array_min(F.transform(taken, lambda b: b.bin)).alias("least")).where("least IS NOT NULL")
    return by.agg(F.map_from_entries(F.collect_list(F.struct("class", "least"))).alias("__least"))


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q, **how) -> DataFrame:
    """doc_id, spans: (start, end, kind) of each document in order, kind being a place in KINDS."""
    found = checkpointed(looked_at(df, id_col, text_col, **how), shuffled=False)
    rows = found.crossJoin(F.broadcast(least_bins(found, q)))  # one row
    random = F.filter("__runs", lambda r: r.even & (r.bin >= F.coalesce(F.try_element_at("__least", r["class"]), F.lit(BINS + 1))))
    added = F.transform(random, lambda r: F.struct(r.start.alias("start"), r.end.alias("end"), F.lit(len(BASE)).alias("kind")))
    by_start = lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"))
    spans = F.array_sort(F.concat(F.transform("__base", by_start), F.transform(added, by_start)))
    return rows.select("doc_id", F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))).alias("spans"))


def report(df: DataFrame, **how) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for each row."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s.start.cast("string"), s.end.cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    base = F.filter("spans", lambda s: s.kind < len(BASE))
    return scanned(df, **how).select("doc_id", *(n(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def _sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"

    def tail(z: str) -> str:
        return re.sub(r"(\d)D", r"\1", upper_tail(z))  # doubles as this dialect writes them

    def found(name: str, pattern: str, group: int) -> str:
        form = text(pattern)
        return f"""
{name}_m AS (SELECT k, regexp_extract_all(t, {form}) AS m, regexp_extract_all(t, {form}, {group}) AS v, regexp_split_to_array(t, {form}) AS g FROM d WHERE regexp_matches(t, {form})),
{name}_i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
{name}_s AS (SELECT k, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start, m[i] AS m, v[i] AS v FROM {name}_i),"""

    cases = " ".join(f"WHEN regexp_matches(m, {text(form)}) AND regexp_matches(m, {text(needs)}) THEN {k}" for k, (form, needs, _, _) in enumerate(ENCODINGS.values()))
    values = ", ".join(f"({k}, {text(a)}, {len(a)}, {c})" for k, (_, _, a, c) in enumerate(ENCODINGS.values()))
    base = " UNION ALL ".join(f"SELECT k, start, start + length(m) AS stop, {k} AS kind FROM {name}_s" + f" WHERE length(v) >= {VALUE}" * (name == "assign") for k, name in enumerate(BASE))
    names = "[" + ", ".join(map(text, KINDS)) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),{"".join(found(name, p, int(name == "assign")) for name, p in BASE.items())}{found("run", RUN % SHORTEST, 0)}
b AS ({base}),
e AS (SELECT * FROM (VALUES {values}) AS e(enc, alphabet, size, same)),
c AS (SELECT k, start, start + length(m) AS stop, m, CASE {cases} END AS enc FROM run_s WHERE length(m) <= {LONGEST}),
r AS (SELECT k, start, stop, m, enc, alphabet, size, same::DOUBLE AS same FROM c JOIN e USING (enc) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = c.k AND b.start < c.stop AND c.start < b.stop)),
l AS (SELECT k, start, size, i, instr(alphabet, m[i]) AS v FROM (SELECT *, unnest(range(1, length(m) + 1)) AS i FROM r)),
w AS (SELECT *, lag(v) OVER (PARTITION BY k, start ORDER BY i) AS u FROM l),
a AS (SELECT k, start, count(*)::DOUBLE AS n, sum(v)::DOUBLE AS x, sum(v * v)::DOUBLE AS xx, sum(u * v)::DOUBLE AS xy, (count(*) FILTER (2 * v > size))::DOUBLE AS high,
  (count(*) FILTER ((2 * v > size) <> (2 * u > size)))::DOUBLE AS turns, arg_min(v, i)::DOUBLE AS v1, arg_max(v, i)::DOUBLE AS vn FROM w GROUP BY ALL),
q AS (SELECT k, start, sum(c * c)::DOUBLE AS sq FROM (SELECT k, start, v, count(*) AS c FROM l GROUP BY ALL) GROUP BY ALL),
f AS (SELECT k, start, stop, enc, n, size - 1 AS df, size * sq / n - n AS chi, 2 * (size - 1) * (n - 1) / n AS var, n * (size * same - 1) AS more, 2 * high * (n - high) / n AS mid, turns,
  xx - n * (x / n) * (x / n) AS dev, xy - (x / n) * (2 * x - v1 - vn) + (n - 1) * (x / n) * (x / n) AS along FROM r JOIN a USING (k, start) JOIN q USING (k, start)),
z AS (SELECT k, start, stop, enc, n, (chi - df) / sqrt(var) AS even, (chi - df - more) / sqrt(var + 4 * more) AS nat,
  CASE WHEN mid * (mid - 1) / (n - 1) > 0 THEN (turns - mid) / sqrt(mid * (mid - 1) / (n - 1)) ELSE 99 END AS runs, CASE WHEN dev > 0 THEN (along / dev + 1 / n) * sqrt(n) ELSE 99 END AS serial FROM f),
p AS (SELECT k, start, stop, enc * {CLASSES + 1} + least(floor(n / {CLASS}), {CLASSES}) AS class, {tail("(-nat)")} AS p, 3 * least({tail("even")}, 2 * {tail("abs(runs)")}, 2 * {tail("abs(serial)")}) AS random FROM z),
o AS (SELECT *, CASE WHEN p > 1e-{BINS // 10} THEN least({BINS}, floor(-10 * log10(p))) ELSE {BINS} END AS bin FROM p),
h AS (SELECT class, bin, sum(count(*)) OVER (PARTITION BY class) AS m, sum(count(*)) OVER (PARTITION BY class ORDER BY bin DESC) AS up FROM o GROUP BY class, bin),
x AS (SELECT class, min(bin) AS least FROM h WHERE m * pow(10.0, -bin / 10.0) <= {Q} * up GROUP BY class),
s AS (SELECT * FROM b UNION ALL SELECT k, start, stop, {len(BASE)} FROM o JOIN x USING (class) WHERE bin >= least AND random >= {ALPHA}),
g AS (SELECT k, {", ".join(f"count(*) FILTER (kind = {j}) AS n_{name}" for j, name in enumerate(KINDS))},
  string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM s GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (k)
"""


SQL = _sql()
