"""Text of documents: extract, redact and verify, OCR routing, salvage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import ranges as R
from ..functions import values as V
from ..session import store
from .pages import checked_options
from .skew import beside_pages

# OCR thresholds.
NATIVE_TEXT_MIN_CHARS = 50
MIN_CONFIDENCE = 30


def extract_text(pages: DataFrame, options: DataFrame) -> DataFrame:
    """One text per document from the pages its ``spec`` names.

    Page ends lose their line feeds, pages are parted by a blank line, the whole is
    trimmed and ends in one line feed. The result is one value per document.
    """
    checked = checked_options(pages, options, R.spec_code(F.col("spec"), F.col("page_count"), blank_ok=True),
                              _iv=R.parsed(F.col("spec")))
    df = beside_pages(pages, checked.filter("error_code IS NULL").select("doc_id", "_last", "_iv"))
    part = F.struct("page_no", F.regexp_replace("text", r"\n+\z", "").alias("text"))
    joined = df.filter(R.contains_page(F.col("_iv"), F.col("page_no"), True)).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(part)).alias("_p"))
    text = F.concat(V.strip(F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n")), F.lit("\n"))
    rows = joined.select("doc_id", text.alias("text"), F.lit(None).cast("string").alias("error_code"))
    return rows.unionByName(checked.filter("error_code IS NOT NULL").select("doc_id", "error_code"),
                            allowMissingColumns=True)


def write_texts(texts: DataFrame, path: str, file_per_document: bool = False) -> None:
    """Write extracted texts: by default as rows (few large files); on demand as one
    folder of plain text per document."""
    good = texts.filter("error_code IS NULL").select("doc_id", "text")
    if file_per_document:
        good.write.mode("overwrite").partitionBy("doc_id").text(path)
    else:
        good.write.mode("overwrite").parquet(path)


# ------------------------------------------------------------------- redact

def found_literals(text: Column, literals: Column) -> Column:
    """Distinct literals that occur in ``text``, sorted (the order they are applied in)."""
    return F.array_sort(F.array_distinct(F.filter(literals, lambda p: text.contains(p))))


def redact_text(text: Column, found: Column) -> Column:
    """Replace each found literal by blanks of the same length, one after the other."""
    return F.aggregate(found, text, lambda acc, p: F.replace(acc, p, F.repeat(F.lit(" "), F.length(p))))


def match_count(text: Column, found: Column) -> Column:
    """Occurrences of the found literals in the original text."""
    counts = F.transform(found, lambda p: (
        (F.length(text) - F.length(F.replace(text, p, F.lit("")))) / F.length(p)).cast("long"))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, n: acc + n)


def redaction_options(pages: DataFrame, options: DataFrame) -> DataFrame:
    """Options per document with the literals, read once, and ``error_code``."""
    code = F.when(V.blank_to_null(F.col("patterns")).isNull(), S.MISSING_OPTION).when(
        F.size("_lits") == 0, S.INVALID_OPTION)
    return checked_options(pages, options.withColumn("_lits", V.literal_list(F.col("patterns"))), code).select(
        "doc_id", "page_count", "_last", "_lits", "error_code")


def _redacted(pages: DataFrame, checked: DataFrame) -> DataFrame:
    """(doc_id, page_no, text, matches, survives) of the documents with good options."""
    df = beside_pages(pages, checked.filter("error_code IS NULL").select("doc_id", "_last", "_lits"))
    # Found literals are a column of their own: the passes over the text read them from there.
    df = df.withColumn("_found", found_literals(F.col("text"), F.col("_lits")))
    df = df.withColumns({"_redacted": redact_text(F.col("text"), F.col("_found")),
                         "matches": match_count(F.col("text"), F.col("_found"))})
    survives = F.exists("_lits", lambda p: F.col("_redacted").contains(p))
    return df.select("doc_id", "page_no", F.col("_redacted").alias("text"), "matches", survives.alias("survives"))


def redact_pages(pages: DataFrame, options: DataFrame) -> DataFrame:
    """Redacted text and match count per page. ``options(doc_id, patterns)``; the
    pattern list belongs to the document, so a page meets only its own patterns."""
    return _redacted(pages, redaction_options(pages, options))


def _judged(redacted: DataFrame, checked: DataFrame) -> DataFrame:
    code = F.when(F.col("matches") == 0, S.NO_MATCHES).when(F.col("_left"), S.REDACTION_FAILED)
    judged = redacted.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("matches").alias("matches"), F.bool_or("survives").alias("_left"))
    bad = checked.filter("error_code IS NOT NULL").select(
        "doc_id", F.col("page_count").alias("pages"), F.lit(0).cast("long").alias("matches"), "error_code")
    return judged.select("doc_id", "pages", "matches", code.alias("error_code")).unionByName(bad)


def redaction_verdicts(pages: DataFrame, options: DataFrame) -> DataFrame:
    """Per document: pages, matches and error code. Every literal must be gone from every page."""
    checked = redaction_options(pages, options)
    return _judged(_redacted(pages, checked), checked)


def redact_documents(pages: DataFrame, options: DataFrame) -> DataFrame:
    """Redacted pages of the documents that pass verification; the others yield one
    row with their error code. Pages are redacted once and written; the verdicts and
    the pages given back both read what was written."""
    checked = redaction_options(pages, options)
    done = store(_redacted(pages, checked), "redacted")
    verdicts = _judged(done, checked).filter("error_code IS NOT NULL").select("doc_id", "error_code")
    good = done.join(verdicts, "doc_id", "left_anti").select(
        "doc_id", "page_no", "text", "matches", F.lit(None).cast("string").alias("error_code"))
    return good.unionByName(verdicts, allowMissingColumns=True)


# ---------------------------------------------------------------------- OCR

def needs_ocr(text: Column, min_chars: int = NATIVE_TEXT_MIN_CHARS) -> Column:
    return F.length(V.strip(F.coalesce(text, F.lit("")))) < min_chars


def ocr_plan(pages: DataFrame) -> DataFrame:
    scanned = F.count_if(needs_ocr(F.col("text")))
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), scanned.alias("ocr_pages"), (F.count(F.lit(1)) - scanned).alias("skipped"))


def usable_words(words: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Recognised words worth keeping: text, a readable confidence, a real box."""
    conf = F.col("conf").try_cast("double")
    return words.withColumn("text", V.strip(F.col("text"))).filter(
        (F.col("text") != "") & (conf >= min_confidence) & (F.col("width") > 0) & (F.col("height") > 0))


def words_from_arrays(pages: DataFrame) -> DataFrame:
    """Parallel OCR arrays per page to word rows."""
    names = ("text", "conf", "left", "top", "width", "height")
    zipped = F.posexplode(F.arrays_zip(*names)).alias("word_no", "_w")
    return pages.select("doc_id", "page_no", zipped).select(
        "doc_id", "page_no", "word_no", *[F.col(f"_w.{n}").alias(n) for n in names])


def interleave(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Native text where a page has it, recognised words elsewhere.

    Only words of pages that need them reach the group: the semi join comes first.
    """
    wanted = pages.filter(needs_ocr(F.col("text"))).select("doc_id", "page_no")
    item = F.struct("word_no", "text")
    read = usable_words(words.join(wanted, ["doc_id", "page_no"], "left_semi")).groupBy("doc_id", "page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda w: w["text"]), " ").alias("_ocr"))
    return pages.join(read, ["doc_id", "page_no"], "left").select(
        "doc_id", "page_no", needs_ocr(F.col("text")).alias("from_ocr"),
        F.when(needs_ocr(F.col("text")), F.coalesce("_ocr", F.lit(""))).otherwise(F.col("text")).alias("text"))


# ------------------------------------------------------------------ salvage

def triage(pages: DataFrame) -> DataFrame:
    """Status per document from page rows with ``readable`` and ``encrypted``."""
    code = F.when(F.col("encrypted"), S.ENCRYPTED_PDF).when(F.col("kept") == 0, S.UNREPAIRABLE)
    return pages.groupBy("doc_id").agg(
        F.bool_or("encrypted").alias("encrypted"), F.count_if("readable").alias("kept"),
        F.count_if(~F.col("readable")).alias("dropped"),
    ).select("doc_id", "kept", "dropped", code.alias("error_code"))


def salvage(pages: DataFrame) -> DataFrame:
    """Readable pages of unlocked documents; bad pages are dropped, order kept."""
    return pages.filter(F.col("readable") & ~F.col("encrypted"))
