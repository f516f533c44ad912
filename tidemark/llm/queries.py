"""The thin queries over whole tables, one an operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, editfp, fim, licenses, linededup, lm, mixing, quality, simhash, spelling, suffix, tokenbin, urls
from tidemark.llm.shared import cut


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores. Null text is empty: its end token only; a null id is the empty text to the folds; equal rows count twice; no rows give none."""
    return lm.score(_read(spark, sf_dir, "documents"))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document repeats of smaller ids, in bytes. Null text is empty; null ids are the largest; rows of one id do not repeat each other; no rows give none."""
    return suffix.report(_read(spark, sf_dir, "documents"), length=50)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components. Null and empty texts have fingerprint zero; a null id never names a component; equal rows share all; no rows give none."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_editfp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and their edits, and classes by bands. Null text is empty; null ids are the smallest; equal ids go by text; one document is its own next; no rows give none."""
    return editfp.with_edits(_read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and taken words. A null source is a source, the last; null text has size 0 and is never taken; equal rows share their fate; no rows give none."""
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "epochs", "copies")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts. Null text is empty and rejected, as it has no words; rows are judged one by one; no rows give none."""
    judged = quality.judge(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = quality.compiled(quality.BASE_RULES)
    return judged.select(
        "doc_id",
        *[F.col(f"quality.{c}") for c in base],
        (F.size(failed) > 0).alias("base_failed"),
        (F.size("quality_failed") == 0).alias("kept"),
        F.array_join("quality_failed", ",").alias("broken_rules"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licence notices. Null text has no words and no labels; rows are scanned one by one; no rows give none."""
    scanned = licenses.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    at = F.col("licenses.places.at")
    base = F.array_sort(F.array_distinct(F.col("licenses.places.label")))
    found = F.col("licenses.found.label")
    best = F.coalesce(F.array_max(F.col("licenses.found.score")), F.lit(0.0))
    return scanned.select(
        "doc_id",
        F.col("licenses.n_words").alias("n_words"),
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, found)), ",").alias("labels"),
        # a phrase by itself is half a notice
        F.greatest(best, F.when(F.size(at) > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def op8_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and digests of ids read back from shard files. Null text is its end id only; null ids come first, ties go by text; no rows give none."""
    return tokenbin.written(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and of what they decode to. Null text is empty: no ids, empty text; rows are encoded one by one; no rows give none."""
    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# The rules that the query applies.
URL_RULES = (
    urls.UrlRule("block", "net"),
    urls.UrlRule("allow", "example.net", "/en/"),
    urls.UrlRule("block", "example.com", "/de/"),
    urls.UrlRule("allow", "org", "/fr/"),
)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, rules and verdicts. A null url, or one without ://, has an empty host and is allowed; null html has no links; rows are judged one by one; no rows give none."""
    return urls.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def urls_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph part of op10 on pages that link to one another: forty hosts, a page's host and link by rule of its id. SQL does the same rounds."""
    p = _read(spark, sf_dir, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit('<a href="http://'), _host((F.col("page_id") * F.col("page_id") + 3) % 40), F.lit('/fr/">x</a>')))
    judged = urls.judge(p.withColumn("url", F.concat(F.lit("http://"), _host(F.col("page_id") % 40), F.lit("/fr/"))), URL_RULES)
    return judged.select("page_id", "host", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def _host(n):
    """The n-th host: five under net, which a rule blocks, five under org, which one allows, and thirty others."""
    return F.concat(F.lit("h"), n.cast("string"), F.when(n < 5, ".net").when(n < 10, ".org").otherwise(".com"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses of lines that three or more have. Null text is one empty line; null ids are one document, the smallest; rows of one id lose the same; no rows give none."""
    kept = linededup.drop_lines(_read(spark, sf_dir, "documents"), least=20, documents=3)
    return cut(kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their near words and forms, one run in 97 with a planted typo. Null text has no words; a null id counts as an empty one; equal rows count twice; no rows give none."""
    found = spelling.variants(_read(spark, sf_dir, "documents"), least_length=5, least_count=3, ratio=2, typos=97)
    return found.select("word", "n", "form", "form_n", "n_near", "root")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the outputs and of the texts restored from them. Null text is empty and plain; a null id draws as an empty one; equal rows give equal rows; no rows give none."""
    made = fim.transform(_read(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return cut(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests))


QUERIES = {q.__name__: q for q in (op1_lm, op2_suffix, op3_simhash, op4_editfp, op5_mixing, op6_quality, op7_licenses, op8_tokenbin, op9_bpe, op10_urls, urls_linked, op11_lines, op12_spelling, op13_fim)}
