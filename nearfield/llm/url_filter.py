"""URL filter. Rules sit in a trie over reversed host labels, then path segments; a url follows it as far as it goes.

A rule fits its host and all subdomains if the url's path starts with the rule's path. The fit with most host labels,
then the longest path, wins, whether it allows or blocks; a url that no rule fits gets the method's verdict, default.
Null url, or one without "://": host and path are empty and no rule fits. Of rules with equal host and path, a block wins. Very
long urls: whole; a lookup takes time in proportion to the labels and segments that rules have. Repeated rows are each judged.
An empty table gives no rows; without rules every url gets the default. Extra columns, whatever their names, are ignored.
Up to max_rules rules are broadcast as one trie; beyond that, each url's possible rules are joined with the rules.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches

#: The most rules that are broadcast: some hundred bytes each.
MAX_RULES = 200_000

#: The rules of the query, (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:end]


class Trie:
    """A node: labels (host), segments (whole path segments), tails (the begun last segment of a rule's path -> rule)."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root = ({}, {}, {})
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node[0].setdefault(label, ({}, {}, {}))
            *whole, tail = path.split("/") if slash else ["", None]
            if slash:
                for segment in ["", *whole]:
                    node = node[1].setdefault(segment, ({}, {}, {}))
            key = tail if slash else None
            if key not in node[2] or verdict == "block":
                node[2][key] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        nodes, node = [], self.root
        if host:
            for label in reversed(host.split(".")):
                node = node[0].get(label)
                if node is None:
                    break
                nodes.append(node)
        segments = path.split("/")
        for node in reversed(nodes):
            if best := self._path(node, segments):
                return best
        return None

    def _path(self, node, segments: list[str]) -> tuple[str, str] | None:
        best = node[2].get(None)
        for k, segment in enumerate(segments):
            if k:
                tails = node[2]
                if tails:
                    for n in range(len(segment), -1, -1):
                        if segment[:n] in tails:
                            best = tails[segment[:n]]
                            break
            if k == len(segments) - 1:
                break
            node = node[1].get(segment)
            if node is None:
                break
        return best


def judge(df: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row."""
    rules = list(rules)
    bounded_batches(df.sparkSession)
    df = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    if len(rules) > max_rules:
        return _joined(df, rules, default)
    sent = df.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches):
        find = sent.value.find
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            got = [find(*p) or (None, default) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in ([p[0] for p in parts], [p[1] for p in parts], [g[0] for g in got], [g[1] for g in got]))], names=["page_id", "host", "path", "rule", "verdict"])

    return df.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _joined(df: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """For more rules than a broadcast bears: a url meets each (host suffix, path prefix of a length that rules have) by a join."""
    spark = df.sparkSession
    parts = [(v, r, r.partition("/")[0].translate(_LOWER), "".join(r.partition("/")[1:])) for v, r in rules]
    table = spark.createDataFrame(parts, "verdict string, rule string, r_host string, r_path string").groupBy("r_host", "r_path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.col("verdict") == "block", "rule")).alias("r"))
    lengths = sorted({len(p[3]) for p in parts})
    rest = F.expr("substring(url, locate('://', url) + 3)")
    url = df.withColumn("k", F.monotonically_increasing_id()).withColumn("rest", F.when(F.instr("url", "://") > 0, rest).otherwise(""))
    url = url.withColumn("raw", F.regexp_extract("rest", r"^[^/?#]*", 0)).withColumn("path", F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), r"^[^?#]*", 0))
    url = url.withColumn("host", F.translate("raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).select("k", "page_id", "host", "path")
    labels = F.split("host", r"\.")
    keys = url.where("host <> ''").withColumn("labels", labels).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("labels"))))
    keys = keys.withColumn("r_host", F.array_join(F.expr("slice(labels, -n, n)"), ".")).withColumn("l", F.explode(F.array(*map(F.lit, lengths)))).where("length(path) >= l").withColumn("r_path", F.expr("substring(path, 1, l)"))
    best = keys.join(table, ["r_host", "r_path"]).groupBy("k").agg(F.max_by("r", F.struct("n", "l")).alias("r"))
    return url.join(best, "k", "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
WITH r AS (SELECT * FROM (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')) AS x(verdict, rule, h, p)),
u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
b AS (SELECT k, rule, verdict FROM v JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(h) DESC, length(p) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM v LEFT JOIN b USING (k)
"""
