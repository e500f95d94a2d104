"""The filter audit and the alignment of tokenizers, against plain Python and on odd tables."""

import random
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
import public_tokenizers as tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nearfield.llm import align, audit, bpe, queries

SF = "/root/testdata/sf0.001"
FILES = [bpe.read_vocab(tokenizers.path(n)) for n in (queries.BYTE_LEVEL, queries.PIECES)]
ALIGNER = align.aligner(FILES[0], tokenizers.PATTERN, FILES[1])
A = Tokenizer.from_file(tokenizers.path(queries.BYTE_LEVEL))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_proto=FILES[1])

ODD = [
    (1, "one two", "a", 1), (1, "one two", "a", 2), (1, "one two", None, 3), (2, "one two", "b", 4), (None, "one two", "a", 5), (3, None, None, 6), (4, "", "a", 7),
    (5, "LOUD # " * 9000, "b", 8), (7, "LOUD # " * 9000, "b", 9), (6, "LOUD # " * 9000, "c", 10), (8, "ñandú \x00 日本語<|endoftext|>", "a", 11), (9, "▁ a", "a", 12), (10, "aaaa" * 3000, "a", 13),
]
COLUMNS = "doc_id long, text string, source string, part long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, None), (5, None, None), (None, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")


def plain_audit(rows, labels):
    """By walking through the documents for each order."""
    least, docs = {}, []
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, s, _ in rows:
        t = t or ""
        w = t.encode().split()
        fails = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and least[t] < i), strict=True) if x}
        mine = [x for x in labels if x[0] == i and i is not None]
        docs.append((s or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {d[0] for d in docs}:
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = gone = None
            left, gone = [d for d in docs if d[0] == part], []
            for k, f in enumerate(order):
                now = [d for d in left if f in d[1]]
                out[part, order, k + 1] = [len(left) - len(now), len(now), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in left + gone), sum(d[2] for d in now), sum(d[3] for d in now)]
                total[f] += len(now)
                left, gone = [d for d in left if f not in d[1]], gone + now
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("how", [{}, {"bits": 1}, {"bits": 2, "local_bytes": 0, "partitions": 3}])
def test_audit_of_odd_rows(spark, odd, labels, how):
    got = audit.audited(odd, labels, **how).collect()
    assert len(got) == len({tuple(r) for r in got}) == 4 * 600
    assert {tuple(r) for r in got} == plain_audit(ODD, [tuple(r) for r in labels.collect()])
    assert sorted(r.doc_id for r in audit.duplicates(odd, **how).collect()) == [2, 4, 6, 7]


def test_audit_settles_copies_before_the_shuffle(spark):
    rows = spark.createDataFrame([(i, "the same text", "a") for i in range(5000)] + [(i, f"own {i}", "a") for i in range(5000, 5100)], "doc_id long, text string, source string").repartition(4)
    routed = audit.masked(rows, "doc_id", "text", "source", partitions=2)
    assert sum(n for _, _, mask, n in routed.collect() if mask & audit.COPY) == 4999
    chains = audit.Chains()
    assert sum(len(chains.add(7, b"x", 0, i, {"": 1})) for i in (5, 3, 9, 3)) == 2 and [e[1:] for e in chains.drained()] == [(b"x", 0, 3, {"": 2})]


def test_audit_and_alignment_of_empty_tables(spark, odd, labels):
    none = odd.limit(0)
    assert not audit.audited(none, labels).count() and not align.aligned(none, FILES[0], tokenizers.PATTERN, FILES[1]).count()
    assert audit.audited(odd, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def plain_tokens(text):
    if not text:
        return [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    spelt = b"".join(bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b)
    return (a, b) if spelt == (" " + text).encode() else ([], [])


def plain_groups(a, b):
    out, i, j, ea, eb = [], 0, 0, 0, 0
    while i < len(a):
        x, y = [], []
        while not x or ea != eb:
            if ea <= eb:
                x.append(a[i]), (ea := ea + len(ALIGNER.a.bytes_of[a[i]])), (i := i + 1)
            else:
                y.append(b[j]), (eb := eb + len(ALIGNER.b.bytes_of[b[j]])), (j := j + 1)
        out.append((x, y))
    assert j == len(b)
    return out


def plain_alignment(rows):
    docs = [(i, *plain_tokens(t)) for i, t in rows]
    docs = [(i, a, b, plain_groups(a, b)) for i, a, b in docs]
    linked = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for *_, g in docs]
    count = Counter(p for c in linked for p in c)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, a, b, g), c in zip(docs, linked, strict=True):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        digest = sha256(shown.encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [align.MAX_PAIRS, 0])
def test_alignment_equals_plain_python(spark, odd, most):
    rows = [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t, *_ in ODD]
    rows += [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, pairs int, n_a int")
    got = align.aligned(df, FILES[0], tokenizers.PATTERN, FILES[1], max_pairs=most)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment(rows)


def test_large_groups_are_linked_by_distinct_ids():
    rng = np.random.RandomState(0)
    in_a, in_b = np.sort(rng.randint(0, 5, 200)), np.sort(rng.randint(0, 5, 150))
    a, b = rng.randint(0, 9, 200), rng.randint(0, 9, 150)
    want = Counter((int(g), int(x) * 10 + int(y)) for g, x in zip(in_a, a, strict=True) for h, y in zip(in_b, b, strict=True) if g == h)
    for large in (0, 1 << 20):
        got = Counter()
        for g, k, n in zip(*align.links(a, b, in_a, in_b, 10, large), strict=True):
            got[int(g), int(k)] += int(n)
        assert got == want


@given(st.lists(st.tuples(st.integers(0, 59), st.integers(0, 59)), max_size=120))
@settings(max_examples=200, deadline=None)
def test_roots_are_those_of_components(edges):
    want = list(range(60))
    for _ in range(60):
        for u, v in edges:
            want[u] = want[v] = min(want[u], want[v])
    u, v = (np.array([e[k] for e in edges], np.int64) for k in range(2))
    assert align.roots(60, u, v).tolist() == want


@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("ab .\n\t1'é日", max_size=80))
@settings(max_examples=400, deadline=None)
def test_tokens_equal_the_libraries(text):
    assert ALIGNER.encode(text) == plain_tokens(text)


def test_tokens_of_letters_of_all_scripts_and_of_long_runs():
    rng = random.Random(1)
    texts = ["".join(map(chr, range(c, c + 64))) for c in range(0x20, 0x3000, 64)] + [" ".join(chr(rng.randrange(0x3000, 0xD800)) for _ in range(200)) for _ in range(20)]
    texts += ["<|endoftext|> <s> </s> <unk> <0x41>", "  two  spaces   and more    ", "x" * 3000, " " * 500 + "y", "a b　c"]
    for t in texts:
        assert ALIGNER.encode(t) == plain_tokens(t)
