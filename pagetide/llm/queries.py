"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from . import bpe, mainpage, minhash, oracles, ordered, quality, runs, search, shards, substrings, tiling, toxicity, vectors, warc
from .common import prepare, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_virtual_slots")
def op1_virtual_slots(spark, sf_dir):
    out = shards.assign(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


@query("op2_warc_index", oracles.WARC)
def op2_warc_index(spark, sf_dir):
    return warc.archive_and_index(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer() -> tuple[str, str]:
    """Rank file and split pattern of the production vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op5_byte_bpe")
def op5_byte_bpe(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"), *tokenizer())


@query("op7_repeated_passages", oracles.REPEATS)
def op7_repeated_passages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = store(substrings.repeats(docs), "repeats")
    return substrings.cut(docs, found).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_minmax_near_duplicates", oracles.NEAR)
def op8_minmax_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query("op9_greedy_tiling")
def op9_greedy_tiling(spark, sf_dir):
    return tiling.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn(
        "kept", ~F.col("contaminated"))


@query("op6_quality_ranking")
def op6_quality_ranking(spark, sf_dir):
    features = store(quality.measure(table(spark, sf_dir, "documents")), "features")
    return quality.score_measured(features, quality.train_measured(features, table(spark, sf_dir, "labels")))


@query("op10_toxicity_chain")
def op10_toxicity_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).drop("text").withColumn("kept", ~F.col("toxic"))


@query("op4_binary_code_duplicates", oracles.VECTORS)
def op4_binary_code_duplicates(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op3_crf_main_text")
def op3_crf_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return mainpage.extract(pages, mainpage.train(pages))


@query("op12_periodic_runs", oracles.RUNS)
def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a tenth of the documents, drawn by a checksum, get a run as the contract says
    h = F.crc32(F.col("doc_id").cast("string"))
    cut = docs.withColumn("h", h).withColumn("words", F.when(
        F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    cut = cut.withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at("words", (
        F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int")))
    found = runs.find(cut.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(
        F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c] for c in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_ranked_search", oracles.SEARCH)
def op13_ranked_search(spark, sf_dir):
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_order_minhash")
def op11_order_minhash(spark, sf_dir):
    found = ordered.compare_edited(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[
        ordered.to_text(c).alias(c) for c in ("fingerprint", "edited_fingerprint")], "near_edited", "near_next")


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
