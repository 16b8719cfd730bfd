"""The registered queries: each operator over its whole table, and SQL twins where SQL can express them."""

from pyspark.sql import functions as F

from pricebook.llm import (cotraining, decontaminate, exact_dedup, license_scan, line_dedup, mixing, periodic_runs, prefix_trie, quality_rules,
                           secret_scan, simhash, surrogates, token_shards)
from pricebook.llm.common import computed, space_words
from pricebook.llm.sql import ORACLE_SQL  # noqa: F401


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _digest(col):
    return F.sha2(col.cast("binary"), 256)


def op1_secret_scan(spark, sf_dir):
    r = secret_scan.digest(_table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_assign", "n_access", "n_hex", _digest(F.col("base_spans")).alias("base_sha256"), "spans",
                    "n_live", "n_copied")


def op2_token_shards(spark, sf_dir):
    r = token_shards.encode_documents(_table(spark, sf_dir, "documents"))
    return r.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_line_dedup(spark, sf_dir):
    return line_dedup.report(_table(spark, sf_dir, "documents"), least=1)


def op4_decontaminate(spark, sf_dir):
    r = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", "n_items",
                    _digest(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op5_simhash(spark, sf_dir):
    r = simhash.cluster(_table(spark, sf_dir, "documents"))
    return r.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_license_scan(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op7_cotraining(spark, sf_dir):
    return cotraining.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_temperature_mixing(spark, sf_dir):
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op9_surrogates(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(docs, counts=True)


def op10_quality_rules(spark, sf_dir):
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def with_planted_periods(docs):
    """Documents as op11 reads them: every tenth by checksum of its id turns periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, space_words(F.col("text"))).alias("w"))
    d = computed(d, "w")
    n = F.size("w")
    a = F.col("g") % n
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    a = a.cast("int")
    period = F.slice("w", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")
    return d.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.report(with_planted_periods(_table(spark, sf_dir, "documents")))


def op12_exact_dedup(spark, sf_dir):
    return exact_dedup.report(_table(spark, sf_dir, "documents"))


def rebuilt_paths(conversations):
    """(conv_id, path) as op13 reads them: the first turns come from the conversation at the last multiple of five."""
    p = prefix_trie.paths(conversations)
    heads = p.select(F.col("conv_id").alias("base"), F.slice("path", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    own = F.slice("path", h + 1, F.size("path"))
    joined = p.join(heads, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base"), "left")
    return joined.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", 1, h), own)).alias("path"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(rebuilt_paths(_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_token_shards, op3_line_dedup, op4_decontaminate, op5_simhash, op6_license_scan, op7_cotraining,
    op8_temperature_mixing, op9_surrogates, op10_quality_rules, op11_periodic_runs, op12_exact_dedup, op13_prefix_trie)}
