"""From raw documents to tokens: quality rules, near-duplicates, benchmark decontamination, personal data, byte-level BPE.

Rows with nulls, empty and very long texts, repeated rows and extra columns pass through the stages as the operators say: a
null or empty text fails the quality rules, of repeated rows and near copies one stays, other columns are kept as they are up
to the last stage, whose rows are ids with tokens. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers as tokenizers

from nearfield.llm import bpe, decontaminate, minhash, pii, quality
from nearfield.llm.common import remove, shared_folder, table


def keep_good(spark, docs, sf_dir):
    return quality.filtered(docs)


def drop_copies(spark, docs, sf_dir):
    return minhash.one_of_each(docs)


def drop_contaminated(spark, docs, sf_dir):
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark, docs, sf_dir):
    return pii.redacted(docs)


def tokenize(spark, docs, sf_dir):
    return bpe.encode_decode(docs, bpe.read_vocab(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN, ids=True)


STAGES = [("quality_rules", keep_good), ("minhash_dedup", drop_copies), ("decontamination", drop_contaminated), ("pii", mask_personal), ("byte_bpe", tokenize)]

#: Permutations, the field's fit and the vocabulary's merges have no form in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after another, each one's result written to the shared folder and read again. A result that the next stage
    has read goes; the last one written stays, as the rows returned are made from it."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
