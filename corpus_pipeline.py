"""Corpus preparation: five stages from raw documents to binary token shards.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All stages but the last return the columns of ``docs``.
"""

from pricebook.llm import decontaminate, mixing, quality_rules, simhash, token_shards
from pricebook.llm.common import stored


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark, docs, sf_dir):
    """Documents that fail the base rule or a proven cutoff go."""
    return quality_rules.keep_documents(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of fingerprints linked within three bits stays."""
    return simhash.keep_one(docs)


def clean_of_benchmarks(spark, docs, sf_dir):
    """Documents with a benchmark window go."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"), mode="documents")


def mixed(spark, docs, sf_dir):
    """Every document once, those of rarer sources up to the repetition limit."""
    return mixing.mix(docs)


def tokens(spark, docs, sf_dir):
    """Token shards in the shared folder; per document its place in them, as read back."""
    return token_shards.encode_documents(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", clean_of_benchmarks),
          ("mixing", mixed), ("token shards", tokens)]

# XXH64, the content order of equal rows and the tokenizer are not SQL; tests compare with a plain version
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
