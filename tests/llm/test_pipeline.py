import re

import duckdb
import public_tokenizers as tokenizers
import tiktoken
from test_operators import brute_components, brute_spans

import corpus_pipeline as pipeline
from nearfield.llm import bpe, minhash, pii, quality
from nearfield.llm.decontaminate import WINDOW, words

SF = "/root/testdata/sf0.001"


def test_stages_equal_their_operators_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.report(docs).where("kept").collect()}
    first = docs.where(docs.doc_id.isin(sorted(good)))
    good = {r.doc_id for r in minhash.linked(first).where("kept").collect()}
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {b" " + b" ".join(w[k : k + WINDOW]) + b" " for w in items if w for k in range(max(1, len(w) - WINDOW + 1))}
    good = {i for i in good if not any(w in b" " + b" ".join(words(want[i])) + b" " for w in windows)}
    field = pii.fit(docs.where(docs.doc_id.isin(sorted(good))).select("doc_id", "text"))
    e = bpe.encoder(bpe.read_vocab(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN)
    want = {i: e.encode(pii.masked(want[i], pii.all_spans(want[i], field)[1])) for i in good}
    got = {r.doc_id: r.ids for r in pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_rows_equal_brute_force(spark):
    """Each stage by plain means: SQL, sets of shingles, strings in strings, regular expressions and the library tiktoken. Only where
    the field adds spans is taken from it."""
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    names = con.sql(quality.SQL).columns
    good = {r[names.index("doc_id")] for r in con.sql(quality.SQL).fetchall() if r[names.index("kept")]}
    texts = {i: t for i, t in con.sql("select doc_id, text from documents").fetchall() if i in good}
    parts = brute_components(list(texts.items()), 80)
    texts = {i: t for i, t in texts.items() if parts[i][1] == i}
    low = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [low(r[0]) for r in con.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    windows = {" " + " ".join(w[k : k + 10]) + " " for w in items if w for k in range(max(1, len(w) - 9))}
    texts = {i: t for i, t in texts.items() if not any(w in " " + " ".join(low(t)) + " " for w in windows)}
    field = pii.fit(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    coder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.encoder(bpe.read_vocab(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN).ranks, special_tokens={})
    want, masks = {}, 0
    for i, t in texts.items():
        base, spans = brute_spans(t), pii.all_spans(t, field)[1]
        assert set(base) <= set(spans)
        chars, at = list(t), {}
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if all(not (x < b and a < y) for x, y in at):  # spans of these texts don't overlap in part
                at[a, b] = kind
        for (a, b), kind in at.items():
            chars[a:b] = [f"<{kind.upper()}>"] + [""] * (b - a - 1)
            masks += 1
        want[i] = coder.encode_ordinary("".join(chars))
    assert {r.doc_id: r.ids for r in pipeline.run(spark, SF).collect()} == want and masks > 0


def test_stages_are_named_and_return_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "minhash_dedup", "decontamination", "pii", "byte_bpe"]
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_whole_pipeline_on_odd_rows_and_on_none(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    good = "The committee met on Tuesday to discuss plans for the new bridge across the river and its cost to the town"
    other = "Farmers in the valley have harvested far more apples this year than they did in any of the ten years before"
    rows = [
        (1, good, "en", "a", len(good), None), (1, good, "en", "a", len(good), None), (2, good, None, None, None, "x"), (3, None, "en", "a", None, None), (4, "", "en", "a", 0, None),
        (None, other, "en", "a", 1, None), (None, None, None, None, None, None), (5, f"{other} write to joe@example.org", "en", "a", 2, None), (6, " ".join(f"w{i:x}" for i in range(60_000)), "en", "a", 3, None),
        (7, "short", "en", "a", 5, None),
    ]
    items = [(0, "in any of the ten years before write to joe example org"), (1, None), (None, "")]
    for name, own, some in (("odd", rows, items), ("none", [], items), ("no_items", rows, [])):
        spark.createDataFrame(own, columns).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(some, "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = {str(r.doc_id): r for r in pipeline.run(spark, str(tmp_path / "odd")).collect()}
    assert set(got) == {"1", "None", "6"} and got["6"].n_tokens > 60_000
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert sorted(str(r.doc_id) for r in pipeline.run(spark, str(tmp_path / "no_items")).collect()) == ["1", "5", "6", "None"]
