"""The queries of this subpackage, each of an operator with production parameters on its whole table."""

from __future__ import annotations

import public_tokenizers as tokenizers

from nearfield.llm import align, audit, bpe, decontaminate, lang_id, minhash, pii, quality, secrets, suffix_dedup, token_counts, toxicity, url_filter
from nearfield.llm.common import table

VOCAB, BYTE_LEVEL, PIECES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_token_counts(spark, sf_dir, vocab=None):
    return token_counts.edited_counts(table(spark, sf_dir, "documents"), bpe.read_vocab(vocab or tokenizers.path(VOCAB)), tokenizers.PATTERN)


def op2_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.RULES)


def op3_language_id(spark, sf_dir, model=None):
    return lang_id.predicted(table(spark, sf_dir, "documents"), lang_id.vocabulary(model or tokenizers.path(PIECES)))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op5_pii(spark, sf_dir):
    return pii.found(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark, sf_dir, vocab=None):
    return bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.read_vocab(vocab or tokenizers.path(VOCAB)), tokenizers.PATTERN)


def op8_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash(spark, sf_dir):
    return minhash.linked(table(spark, sf_dir, "documents"), percent=85)


def op11_filter_audit(spark, sf_dir):
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark, sf_dir, byte_level=None, pieces=None):
    read = lambda path, name: bpe.read_vocab(path or tokenizers.path(name))
    return align.aligned(table(spark, sf_dir, "documents"), read(byte_level, BYTE_LEVEL), tokenizers.PATTERN, read(pieces, PIECES))


def op13_secret_scan(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


OPERATORS = (op1_token_counts, op2_url_filter, op3_language_id, op4_suffix_dedup, op5_pii, op6_quality_rules, op7_byte_bpe, op8_decontamination, op9_toxicity, op10_minhash, op11_filter_audit, op12_token_alignment, op13_secret_scan)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.SQL, "op4_suffix_dedup": suffix_dedup.SQL, "op6_quality_rules": quality.SQL, "op8_decontamination": decontaminate.SQL, "op10_minhash": minhash.SQL, "op11_filter_audit": audit.SQL, "op13_secret_scan": secrets.SQL}
