"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes and reads
again for the next one. All but the last keep the columns of documents.

* toxicity: documents that the classifier chain rejects go.
* near_duplicates: of rows linked by five-word shingle sets of similarity 0.8 or more, one stays:
  that with the smallest identifier (none comes last), of these the longest text, then the one of
  the smallest hash. Unequal texts of one identifier are judged each for itself; of equal rows,
  one stays.
* repeated_passages: words of passages of 50 words or more that an earlier document has go; the
  rest of such a text is its kept words, joined by single spaces, and n_chars follows. Texts
  that lose nothing stay as they are. A text that is all repeats becomes empty.
* decontamination: rows that contain a benchmark item in tiles go, by a hash of identifier and
  text, so those without an identifier too.
* tokens: every text is encoded, and decoded again as a proof.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm import bpe, minhash, substrings, tiling, toxicity
from pagetide.llm.common import filtered, marked, prepare, spread_join, table
from pagetide.llm.queries import tokenizer
from pagetide.session import store

SHINGLE = 5


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).where("not toxic").select(*docs.columns)


def by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a hash of identifier and text, ``row``."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def without(docs: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` without the rows in ``gone``, by ``columns``, the first of which is a number that is
    never null; only rows that may be among them are joined."""
    lost = gone.select(*(F.col(c).alias(f"_{c}") for c in columns)).distinct()
    touched = filtered(docs, gone, columns[0])
    same = [touched[c].eqNullSafe(lost[f"_{c}"]) for c in columns]
    return filtered(docs, gone, columns[0], keep=False).union(touched.join(lost, same, "left_anti"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    groups = store(minhash.row_groups(docs, SHINGLE).withColumnRenamed("name", "doc_id"), "groups")
    best = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(
        F.col("doc_id").isNull(), F.col("doc_id").alias("best_id"), -F.col("size"), F.col("row").alias("best_row"))).alias("b")
        ).where("n > 1").select("root", "b.best_id", "b.best_row")
    linked = store(spread_join(groups, best, ["root"], "inner").withColumn(
        "best", F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("row") == F.col("best_row"))), "linked")
    again = store(linked.where("best").groupBy("row", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    lost = linked.where("not best").select(F.col("row").alias("_row"), F.col("doc_id").alias("_doc_id")).distinct()
    rows = marked(by_row(docs), "row", _lost=linked.where("not best"), _again=again)
    judged = rows.where("_lost").join(lost, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left_anti")
    kept = rows.where("not _lost").union(judged)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = kept.where("_again").groupBy("doc_id", "text").agg(
        F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", "rest.*")
    return kept.where("not _again").select(*docs.columns).union(once.select(*docs.columns))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    columns = docs.columns
    found = store(substrings.repeats(docs), "repeats")
    changed = F.col("_removed") > 0
    cut = substrings.cut_listed(docs, found, "_words", "_removed", "_kept").withColumns({
        "text": F.when(changed, F.col("_kept")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.length("_kept").cast("long")).otherwise(F.col("n_chars")),
    }).select(*columns)
    # the others keep their words and are not read word by word again
    return cut.union(filtered(docs, found, "doc_id", keep=False))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = by_row(docs)
    leaks = store(tiling.leaks(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")), "leaks")
    return without(rows, leaks.select(F.col("doc_id").alias("row")), ["row"]).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.digest(docs, *tokenizer())


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("decontamination", decontaminate),
    ("tokens", tokens),
]

# Classifier, minimum hashes and merges have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
