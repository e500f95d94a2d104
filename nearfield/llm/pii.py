"""Personal data: fixed patterns, and what a semi-Markov conditional random field adds to them.

Base spans come from the patterns, leftmost and non-overlapping for each kind; a match that fails its check is dropped.
The field then reads each place where a span can be: a run of digit groups with separators, the surroundings of an `@` or
of its spelt form, or a long string of letters and digits, which may be a secret such as a key or a token. Its units are
the groups; each segment of up to MAX_UNITS units is scored as a whole, by features of the whole string, as one of the kinds
or as nothing. A dynamic programme over units finds the best way to cut a run into segments with their kinds, and forward
and backward sums give the probability that a place is of a kind. Segments that overlap no base span are added if that of
their last unit, over all ways to draw boundaries, reaches `least`.

The field is fitted here, by stochastic gradient on runs of known kind: on a bounded number of runs of the documents, where
base spans are the truth, and on written variants of made-up addresses, numbers and keys, which teach it forms that the
patterns miss, and numbers that stand beside others.

Null text: as the empty text, without spans. Very long texts: whole; a run is read in linear time, and in the fit a long one
makes several examples. Equal scores: the shorter first segment, then the kind listed first. Repeated rows are each read.
An empty table gives no rows, and the field is then fitted on made-up runs alone. Extra columns, whatever their names, are
left as they are (redacted) or ignored.
"""

from __future__ import annotations

import math
import random
import re
from array import array
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, change_text, id_and_text, per_text, sha256

KINDS = ("email", "ip", "card", "phone")
#: What the field knows: the kinds of base spans, and one that has no pattern.
ALL_KINDS = (*KINDS, "secret")
#: The domain of an address, and the patterns of numbers; possessive where that can't change a match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str) -> list[Span]:
    out, behind, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > behind and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        behind = m.end() if m else at + 1  # no later match can begin in what was read
        at = text.find("@", behind)
    return out


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind as listed, then start."""
    out = emails(text)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m[0]) if 16 <= m.end() - m.start() else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


#: A run of digit groups: two groups or seven digits at least are looked at; and addresses, spelt out or not.
RUN = re.compile(r"[+(]?[0-9]++(?:[\x20().\-/]{1,2}[+(]?[0-9]++)*+")
GROUP = re.compile(r"[+(]*[0-9]+\)?")
SPELT = re.compile(r"(?:@|[\[(]at[\])]|\bat\b)", re.IGNORECASE)
ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:@|[\[(]at[\])]|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[(]dot[\])]|\sdot\s)\s?[A-Za-z0-9-]{2,63}){0,4}", re.IGNORECASE)
#: Long strings in which letters and digits alternate are looked at.
STRING = re.compile(r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}")
MAX_UNITS = 8
#: The probability that a span of the field needs.
LEAST = 0.9
#: Units of a run that make one example of the fit; a segment is never cut.
EXAMPLE_UNITS = 64

#: Words that stand before personal data, and before strings that are no secrets.
CUES = {"email": "email e-mail mail contact address", "ip": "ip address host server", "card": "card visa mastercard credit karte", "phone": "phone tel telephone mobile call fax cell"}
CUES |= {"secret": "token key secret password passwd pwd apikey api_key api-key access_key bearer auth credential", "digest": "sha sha1 sha256 md5 commit hash checksum digest id uuid file version"}
CUES = {w: k for k, words in CUES.items() for w in words.split()}


def runs(text: str, spelt: bool = True) -> list[list[tuple[int, int]]]:
    """The units, as (start, end), of each place where the field looks."""
    out = []
    for m in RUN.finditer(text):
        if m.end() - m.start() >= 7:
            units = [(m.start() + g.start(), m.start() + g.end()) for g in GROUP.finditer(m[0])]
            if sum(b - a for a, b in units) >= 7:
                out.append(units)
    if spelt and SPELT.search(text):
        out += [[m.span()] for m in ADDRESS.finditer(text)]
    return out + [[m.span()] for m in STRING.finditer(text)]


def features(text: str, start: int, end: int) -> list[str]:
    """Of the whole segment and what stands beside it."""
    s = text[start:end]
    digits = digits_of(s)
    n, groups = len(digits), re.findall(r"[0-9]+", s)
    before, behind = text[start - 1 : start], text[end : end + 1]
    glued = (before.isalnum() or before in tuple("@._-/+") and before != "") or behind.isalnum() or behind == "@"
    out = ["bias", f"digits={min(n, 20)}", f"groups={min(len(groups), 6)}", f"glued={glued}"]
    if n and groups[0] != s and STRING.fullmatch(s):
        case = ("hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) else "word") + ("+" if re.search(r"[+/_=-]", s) else "")
        turns = len(re.findall(r"(?:[0-9](?=[A-Za-z])|[a-z](?=[A-Z0-9])|[A-Z](?=[0-9]))", s))
        set_ = text[max(0, start - 3) : start].strip().strip("\"'").strip()[-1:] in ("=", ":") and start > 0
        out += [f"string={case}", f"long={min(end - start, 64) // 8}", f"turns={min(9, 16 * turns // len(s))}", f"set={set_}", f"quoted={before in tuple(chr(34) + chr(39)) and before != ''}", f"set={set_}|{case}"]
    elif "@" in s or re.search(r"[A-Za-z]", s):
        tail = re.search(r"(?:\.|dot)[\])]?\s?([A-Za-z]{2,10})$", s, re.IGNORECASE)
        mark = "@" if "@" in s else "(at)" if re.search(r"[\[(]at[\])]", s, re.IGNORECASE) else "at"
        out += [f"mark={mark}", f"tail={bool(tail)}", f"mark={mark}|tail={bool(tail)}", f"spaced={' ' in s}|{mark}|{' dot ' in s}"]
    else:
        seps = "".join(sorted(set(re.sub(r"[0-9]", "", s))))
        shape = "-".join(str(min(len(g), 17)) for g in groups)
        out += [f"shape={shape}", f"seps={seps}", f"plus={s[:1] == '+'}", f"luhn={16 <= n <= 19 and luhn(digits)}", f"bytes={len(groups) == 4 and seps == '.' and all(len(g) <= 3 and int(g) < 256 for g in groups)}", f"open={s.count('(') == s.count(')')}"]
    cue = next((CUES[w] for w in reversed(re.findall(r"[\w-]+", text[max(0, start - 24) : start].lower())[-2:]) if w in CUES), "none")
    return [*out, f"cue={cue}"]


class Field:
    """Weights of (feature, kind); the kind None has none, so that its segments score 0, and is one unit long."""

    def __init__(self):
        self.w: dict[tuple[str, str], float] = {}

    def scores(self, f: list[str]) -> list[float]:
        return [sum(self.w.get((x, k), 0.0) for x in f) for k in ALL_KINDS]

    def lattice(self, text: str, units: list[tuple[int, int]]):
        """For each segment (first unit, unit behind): its features, and the scores of the kinds."""
        out = {}
        for i in range(len(units)):
            for j in range(i + 1, min(i + MAX_UNITS, len(units)) + 1):
                f = features(text, units[i][0], units[j - 1][1])
                out[i, j] = f, self.scores(f)
        return out

    def sums(self, n: int, lattice) -> tuple[list[float], list[float]]:
        """Logarithms of the forward and backward sums over all ways to cut the units."""
        a, b = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for j in range(1, n + 1):
            a[j] = _logsum([a[j - 1], *(a[i] + s for i in range(max(0, j - MAX_UNITS), j) for s in lattice[i, j][1])])
        for i in range(n - 1, -1, -1):
            b[i] = _logsum([b[i + 1], *(b[j] + s for j in range(i + 1, min(n, i + MAX_UNITS) + 1) for s in lattice[i, j][1])])
        return a, b

    def fit(self, examples: list[tuple[str, list[tuple[int, int]], dict]], rounds: int = 6, rate: float = 0.3, l2: float = 1e-3, seed: int = 7) -> Field:
        """examples: a text, the units of a run, and {(first, behind): kind} of its true segments. Gradient of the log likelihood."""
        seen: dict = {}
        rng = random.Random(seed)
        ready = [(len(units), {k: f for k, (f, _) in self.lattice(text, units).items()}, truth) for text, units, truth in examples]
        for _ in range(rounds):
            rng.shuffle(ready)
            for n, found, truth in ready:
                lat = {k: (f, self.scores(f)) for k, f in found.items()}
                a, b = self.sums(n, lat)
                for (i, j), (f, scores) in lat.items():
                    for k, s in zip(ALL_KINDS, scores, strict=True):
                        g = (truth.get((i, j)) == k) - math.exp(a[i] + s + b[j] - a[-1])
                        if abs(g) > 1e-4:
                            for x in f:
                                key = x, k
                                h = g - l2 * self.w.get(key, 0.0)
                                seen[key] = seen.get(key, 1e-6) + h * h
                                self.w[key] = self.w.get(key, 0.0) + rate * h / math.sqrt(seen[key])
        return self

    def decode(self, text: str, units: list[tuple[int, int]]) -> list[tuple[str, int, int, float]]:
        """The segments of the best cut of the whole run, as (kind, start, end, probability)."""
        return [x[:4] for x in self.segments(text, units)]

    def segments(self, text: str, units: list[tuple[int, int]]) -> list[tuple[str, int, int, float, float]]:
        """As decode, with the probability that any segment of the kind holds the last unit, wherever it begins and ends. Of a
        segment only the sum over its kinds is kept, so that a unit takes some hundred bytes in a run of any length."""
        n = len(units)
        a, both = array("d", [0.0]), array("d", bytes(8 * MAX_UNITS * n))  # both[MAX_UNITS * (j - 1) + j - 1 - i]: segment i, j
        best, first, kinds, score = array("d", [0.0]), array("q", [0]), bytearray(1), array("d", [0.0])  # kinds: 0 for none
        for j in range(1, n + 1):
            top, terms = (best[j - 1], j - 1, 0, 0.0), [a[j - 1]]
            for i in range(j - 1, max(0, j - MAX_UNITS) - 1, -1):
                scores = self.scores(features(text, units[i][0], units[j - 1][1]))
                for k, s in enumerate(scores, 1):
                    if best[i] + s > top[0] + 1e-12:
                        top = best[i] + s, i, k, s
                g = both[MAX_UNITS * (j - 1) + j - 1 - i] = _logsum(scores)
                terms.append(a[i] + g)
            a.append(_logsum(terms))
            for column, x in zip((best, first, kinds, score), top, strict=True):
                column.append(x)
        if not any(kinds):
            return []
        b = array("d", bytes(8 * (n + 1)))
        for i in range(n - 1, -1, -1):
            b[i] = _logsum([b[i + 1], *(b[j] + both[MAX_UNITS * (j - 1) + j - 1 - i] for j in range(i + 1, min(n, i + MAX_UNITS) + 1))])
        out, j = [], n
        while j:
            i = first[j]
            if kinds[j]:
                k, held = kinds[j] - 1, 0.0
                for x in range(max(0, j - MAX_UNITS), j):
                    for y in range(j, min(n, x + MAX_UNITS) + 1):
                        held += math.exp(a[x] + self.scores(features(text, units[x][0], units[y - 1][1]))[k] + b[y] - a[-1])
                out.append((ALL_KINDS[k], units[i][0], units[j - 1][1], math.exp(a[i] + score[j] + b[j] - a[-1]), held))
            j = i
        return out[::-1]


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x)) if top > -math.inf else top


def examples_of(text: str, spans: list[Span]) -> list[tuple[str, list[tuple[int, int]], dict]]:
    """The runs of a text with the spans that begin and end at their units."""
    out, by_place = [], {(a, b): k for k, a, b in spans}
    for run in runs(text):
        truth = {(i, j): by_place[p] for i in range(len(run)) for j in range(i + 1, min(len(run), i + MAX_UNITS) + 1) if (p := (run[i][0], run[j - 1][1])) in by_place}
        within = {k for i, j in truth for k in range(i + 1, j)}
        i = 0
        while i < len(run):
            j = min(len(run), i + EXAMPLE_UNITS)
            while j < len(run) and j in within:
                j += 1
            lo, hi = max(0, run[i][0] - 40), run[j - 1][1] + 10
            out.append((text[lo:hi], [(a - lo, b - lo) for a, b in run[i:j]], {(x - i, y - i): k for (x, y), k in truth.items() if i <= x and y <= j}))
            i = j
    return out


def made_up(n: int = 40, seed: int = 11) -> list:
    """Made-up runs of known kind in many written forms, and strings that are no personal data; alone, or beside numbers."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    num = lambda k: some("0123456789", k)
    word = lambda: some("abcdefghiklmnoprstu", r.randint(3, 9))
    mixed = lambda k, chars: next(s for s in iter(lambda: some(chars, k), None) if STRING.fullmatch(s))
    small, large = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card():
        d = r.choice("3456") + num(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    out = []

    def add(kind, s, before, behind):
        if kind is None and 16 <= len(digits_of(s)) <= 19 and luhn(digits_of(s)):
            return
        text = f"{word()} {before}{s}{behind}"
        a = len(text) - len(behind) - len(s)
        out.extend(examples_of(text, [(kind, a, a + len(s))] if kind else []))

    for _ in range(n):
        d, c, ip = card(), f"{num(3)} {num(3)} {num(4)}".split(), [str(r.randint(0, 255)) for _ in range(4)]
        forms = (
            ("card", "-".join((d[:4], d[4:8], d[8:12], d[12:]))), ("card", ".".join((d[:4], d[4:8], d[8:12], d[12:]))), ("card", " ".join((d[:4], d[4:8], d[8:12], d[12:]))), ("card", d),
            ("phone", f"({c[0]}) {c[1]}-{c[2]}"), ("phone", f"({c[0]}) {c[1]} {c[2]}"), ("phone", f"+1 ({c[0]}) {c[1]}-{c[2]}"), ("phone", f"1 ({c[0]}) {c[1]}-{c[2]}"), ("phone", f"+{r.randint(20, 99)} {c[0]} {num(7)}"), ("phone", f"+1-{'-'.join(c)}"), ("phone", "-".join(c)), ("phone", ".".join(c)),
            ("ip", ".".join(ip)), ("email", f"{word()}.{word()}@{word()}.com"), ("email", f"{word()} (at) {word()} (dot) org"), ("email", f"{word()} [at] {word()}.net"), ("email", f"{word()} at {word()} dot com"), ("email", f"{word()} at {word()}.{r.choice(('com', 'org', 'net'))}"),
            (None, f"{num(4)}-{num(4)}"), (None, f"{num(2)}.{num(2)}.{num(4)}"), (None, f"{num(4)} {num(4)} {num(4)} {num(3)}"), (None, num(r.randint(7, 15))), (None, num(20)), (None, f"{num(1)}.{num(2)}.{num(5)}"),
            (None, f"{num(4)}/{num(2)}/{num(2)} {num(2)}"), (None, " ".join(num(r.randint(1, 3)) for _ in range(6))), (None, f"{word()} at {word()}"), (None, f"{word()}@{word()}"), (None, f"{word()} @ {word()}"),
            (None, f"{num(4)}-{num(2)}-{num(2)}"), (None, f"{num(2)}/{num(2)}/{num(4)} {num(2)}"), (None, f"{num(3)}.{num(3)}.{num(3)}"), (None, f"{num(3)} {num(4)}"),
        )
        for kind, s in forms:
            cue = r.choice(("", "", word() + " ", "call ", "card ", "ref ", "tel: "))
            add(kind, s, cue, f" {word()}")
            if "a" < s[-1]:  # an address; the others are put beside numbers as well
                continue
            near = lambda: r.choice((str(r.randint(1900, 2030)), num(r.randint(1, 3)), f"{num(2)}.{num(2)}.{num(4)}", num(5), "/".join("123"[: r.randint(1, 3)]), f"{num(1)}."))
            for _ in range(2):
                add(kind, s, f"{cue}{near()}{r.choice((' ', ' ', ' / ', '. '))}", f" {word()}")
            if kind in ("phone", "ip") and r.random() < 0.3:
                text = f"{word()} {s} {s} {word()}"
                a = text.index(s)
                out.extend(examples_of(text, [(kind, a, a + len(s)), (kind, a + len(s) + 1, a + 2 * len(s) + 1)]))
        for s in (mixed(r.choice((32, 40, 64)), small), mixed(r.choice((32, 40)), small).upper(), mixed(r.randint(20, 48), large), "AKIA" + mixed(16, large[:26] + large[52:]), f"{some(large, 3)}_{mixed(36, large)}"):
            name, sign, mark = r.choice(("token", "key", "secret", "password", "api_key", "auth")), r.choice((" = ", "=", ": ", ":")), r.choice(('"', "'", ""))
            add("secret", s, f"{name}{sign}{mark}", f"{mark} {word()}")
            add(None, s, r.choice(("commit ", "sha256 ", "md5: ", "file ", "id ")), f" {word()}")
            add(None, s, f"{word()}{r.choice((' ', ': ', '-', '/'))}", f" {word()}")
        for s in (f"{word()}-{word()}-{word()}-{num(2)}", f"{word()}_{word()}_{num(4)}_{word()}", f"{word()}/{word()}/{num(4)}/{word()}", num(4) + word() * 3):
            if STRING.fullmatch(s):
                add(None, s, r.choice(("", "key ", "see ", "file: ")), f" {word()}")
    return out


def fit(docs: DataFrame, max_docs: int = 300, max_runs: int = 3000) -> Field:
    """The field from made-up runs and from at most max_runs runs of about max_docs documents; both picked by a hash."""
    bounded_batches(docs.sparkSession)
    part = min(1.0, max_docs / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part * (1 << 30)).select("doc_id", "text")

    def run(batches):
        for batch in batches:
            rows = [(t, [x for u in units for x in u], [y for (i, j), k in truth.items() for y in (i, j, ALL_KINDS.index(k))]) for text in batch.column(1).to_pylist() for t, units, truth in examples_of(text or "", base_spans(text or ""))]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=["text", "units", "truth"])

    found = picked.mapInArrow(run, "text string, units array<int>, truth array<int>").orderBy(F.xxhash64("text", "units"), "text", "units").limit(max_runs)
    got = made_up()
    for text, units, truth in found.collect():
        got.append((text, list(zip(units[::2], units[1::2], strict=True)), {(i, j): ALL_KINDS[k] for i, j, k in zip(truth[::3], truth[1::3], truth[2::3], strict=True)}))
    return Field().fit(got)


def all_spans(text: str, field: Field, least: float = LEAST) -> tuple[list[Span], list[Span]]:
    """The base spans, and those with the field's, both by kind as listed, then start."""
    base = base_spans(text)
    order = sorted((a, b) for _, a, b in base)
    begins, most = [a for a, _ in order], []
    for _, b in order:
        most.append(max(b, most[-1] if most else 0))
    added = []
    for units in runs(text):
        k = bisect_left(begins, units[-1][1])
        if k and most[k - 1] >= units[-1][1] and k == 1 + bisect_left(begins, units[0][0]) and begins[k - 1] <= units[0][0]:
            continue  # a base span is all there is
        for kind, a, b, _, p in field.segments(text, units):
            i = bisect_left(begins, b)
            if p >= least and not (i and most[i - 1] > a):
                added.append((kind, a, b))
    if not added:
        return base, base
    return base, sorted({*base, *added}, key=lambda s: (ALL_KINDS.index(s[0]), s[1:]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, **bounds) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all of them), n_added (by the field) for each row."""
    docs = id_and_text(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(fit(docs, **bounds))

    def make():
        field = sent.value

        def f(text):
            base, spans = all_spans(text or "", field, least)
            n = [0] * len(KINDS)
            for k, _, _ in base:
                n[KINDS.index(k)] += 1
            return (*n, sha256(joined(base)), joined(spans), len(spans), len(spans) - len(base))

        return f

    return per_text(docs, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long", make)


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind; of spans that overlap, the first, or else the longest, gives the kind."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", least: float = LEAST, **bounds) -> DataFrame:
    """df with each span in its texts replaced by a mark of its kind, and the size of such texts brought up to date."""
    sent = df.sparkSession.sparkContext.broadcast(fit(id_and_text(df, id_col, text_col), **bounds))

    def make():
        field = sent.value
        return lambda text: masked(text, all_spans(text or "", field, least)[1])

    return change_text(df, text_col, make, size_col)
