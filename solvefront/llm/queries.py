"""The operators bound to the driver's tables: one query each, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvefront.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvefront.llm.tokenization import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op7_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvefront.llm.packing import pack_documents

    return pack_documents(spark, table(spark, sf_dir, "documents"), keep_ids=False)


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvefront.llm.mixing import with_copies

    mixed = with_copies(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvefront.llm.quality_rules import judge

    judged = judge(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvefront.llm.url_filter import QUERY_RULES, filter_urls

    judged = filter_urls(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"), QUERY_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op3_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvefront.llm.ann import build_index, search
    from solvefront.llm.common import stage

    index = stage(spark, build_index(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "index")
    return search(spark, index, F.col("id") % 50 == 0)


@query
def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvefront.llm.common import fold
    from solvefront.llm.ctw import score_corpus

    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    scored = score_corpus(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query
def op6_segmentation_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvefront.llm.common import fold
    from solvefront.llm.langid import identify

    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    found = identify(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op9_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvefront.llm import quality_crf
    from solvefront.llm.common import fold

    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality_crf.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return quality_crf.score(spark, docs, field).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op2_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvefront.llm.ngram_join import join_components

    return join_components(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")


@query
def op11_bootstrapped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvefront.llm.pii import KINDS, extract, written

    found = extract(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query
def op12_main_lorentz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvefront.llm.periodic_runs import periodic_runs, repeated_tail

    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs).select("doc_id", "runs", "collapsed")
    best = lambda a, b: F.when(a.isNull() | (b["length"] > a["length"]), b).otherwise(a)
    # Runs come by start and period, so the first of the longest is the one wanted.
    longest = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), best)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") == 0, F.lit("")).otherwise(F.concat(listed, F.lit("\n")))
    return found.withColumn("_best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op13_escaped_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvefront.llm.fill_middle import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _oracles() -> dict[str, str]:
    from solvefront.llm import fill_middle, mixing, quality_rules, url_filter

    return {"op13_escaped_markers": fill_middle.ORACLE, "op4_mix_sources": mixing.ORACLE, "op5_redirect_equivalence": url_filter.ORACLE, "op8_line_frequency": quality_rules.ORACLE}


ORACLE_SQL.update(_oracles())
