"""Fingerprints by order MinHash: likeness falls with edit distance, not only with lost words.

A text's k-mers (runs of ``K`` words) are numbered by occurrence, so a repeated k-mer counts as
often as it stands there. Each of ``M`` permutations picks the ``L`` smallest numbered k-mers, puts
them back into text order and hashes that tuple to one entry of the fingerprint. Likeness is the
share of equal entries. Texts with the same words in another order share k-mers but not tuples.

The permutations are rotations of one random order of the hashes: number i starts at the i-th of
``M`` fixed points and goes round. So hashes are sorted once per text, and each permutation's
smallest ones are found by bisection. Everything is DataFrame functions on one row: no join, no
shuffle, no Python.

Hashes keep 40 bits and share a long with 24 bits of the place in the text.

Cases: a null or empty text counts as empty and all empty texts have one fingerprint, of entries
that no other text has; a text of fewer than ``K`` words is one k-mer, with fewer than ``L`` k-mers
the tuple is what there is; texts of over 2**24 words count places modulo that; repeated rows have
equal fingerprints; an empty table gives no rows; further columns are passed through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import width

K, L, M = 2, 2, 64
PLACE_BITS = 24
# Fixed starting points of the permutations, evenly apart on the circle of 40-bit hashes.
STARTS = tuple((i * 2**40 // M - 2**39) << PLACE_BITS for i in range(M))
# Most pieces of the order of documents.
PIECES = 65_536


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _packed(hash_: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(hash_, PLACE_BITS), PLACE_BITS).bitwiseOR(
        place.cast("long").bitwiseAND(_long(2**PLACE_BITS - 1)))


def _climb(size: Column, still: Callable[[Column], Column]) -> Column:
    """Largest number up to ``size`` for which ``still`` holds; it holds for all smaller ones too.
    By steps of falling powers of two."""
    steps = F.array(*[F.lit(1 << b) for b in range(PLACE_BITS, -1, -1)])
    used = F.slice(steps, PLACE_BITS + 1 - F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int"), PLACE_BITS + 1)
    return F.aggregate(used, F.lit(0), lambda at, step: F.when((at + step <= size) & still(at + step), at + step).otherwise(at))


def numbered_kmers(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """``df`` with the sorted array ``out`` of the hashes of the text's k-mers and their occurrence
    numbers, each with its place."""
    words = F.transform(
        F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    df = df.withColumn("_words", words)
    last = F.greatest(F.size("_words") - k, F.lit(0))
    kmer = lambda i: F.xxhash64(*[F.get("_words", i + F.lit(j)) for j in range(k)])
    places = F.when(F.size("_words") > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_kmers", F.sort_array(F.transform(places, lambda i: _packed(kmer(i), i))))

    def numbered(x: Column, j: Column) -> Column:
        kind = F.shiftright(x, PLACE_BITS)
        like = lambda n: F.shiftright(F.get("_kmers", j - n), PLACE_BITS) == kind
        before = F.when((j > 0) & like(F.lit(1)), _climb(j, like)).otherwise(0)
        return _packed(F.xxhash64(kind, before.cast("long")), x)

    return df.withColumn(out, F.sort_array(F.transform("_kmers", numbered))).drop("_words", "_kmers")


def fingerprint(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """``df`` with the fingerprint of the column ``text``: an array of ``M`` integers."""
    df = numbered_kmers(df, text, "_sorted", k)

    def entry(start: Column) -> Column:
        n = F.size("_sorted")
        at = _climb(n, lambda i: F.get("_sorted", i - 1) < start)
        picked = [F.get("_sorted", (at + i) % n) for i in range(L)]
        place = lambda x: x.bitwiseAND(_long(2**PLACE_BITS - 1))
        swap = place(picked[0]) > place(picked[1])
        kinds = [F.shiftright(x, PLACE_BITS) for x in picked]
        return F.xxhash64(F.when(swap, kinds[1]).otherwise(kinds[0]),
                          F.when(swap, kinds[0]).otherwise(kinds[1])).cast("long")

    starts = F.array(*[_long(s) for s in STARTS])
    few = F.transform(starts, lambda s: F.xxhash64(F.get("_sorted", F.lit(0))))
    return df.withColumn(out, F.when(F.size("_sorted") >= L, F.transform(starts, entry)).when(
        F.size("_sorted") > 0, few).otherwise(F.transform(starts, lambda s: F.lit(0).cast("long")))).drop("_sorted")


def likeness(a: str, b: str) -> Column:
    """Share of equal entries of two fingerprints."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.lit(float(M))


def to_text(fingerprint_: str) -> Column:
    return F.array_join(F.transform(fingerprint_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, id_: str, text: str, columns: dict[str, str]) -> DataFrame:
    """Each row beside its follower by descending integer ``id_`` (nulls last; rows of one identifier
    by a hash of the text); the last is followed by the first. ``columns`` maps columns to the names
    of their follower's values.

    The order is cut into at most PIECES pieces at quantiles of the identifier, which alone pass the
    driver. Rows move once, to their piece; the first row of a piece also goes to the piece before,
    to be its last one's follower. The first rows are one a piece, so they are sent round. An
    identifier that spans several quantiles is cut further by the hash; rows equal in both stay
    together and stream through one task.
    """
    id64 = F.col(id_).cast("long")
    n = min(PIECES, 4 * width(docs.sparkSession))
    seen = docs.agg(F.percentile_approx(id64, [i / n for i in range(1, n)], 10 * n).alias("cuts"),
                    F.count_if(id64.isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows")).first()
    spans = Counter(seen.cuts or [])
    bounds = F.array(*[_long(c) for c in sorted(spans)]) if spans else F.array().cast("array<bigint>")
    # pieces ascend as identifiers fall, with room between two bounds for the parts of a hot one
    up_to = _climb(F.lit(len(spans)), lambda i: F.get(bounds, i - 1) <= id64)
    piece = F.when(id64.isNull(), F.lit(len(spans) + 1)).otherwise(F.lit(len(spans)) - up_to).cast("long") * PIECES
    hot = [_long(x) for c, m in spans.items() if m > 1 for x in (c, m)]
    parts = F.coalesce(F.try_element_at(F.create_map(*hot), id64), _long(1)) if hot else _long(1)
    parts = F.when(id64.isNull(), _long(max(1, n * seen.nulls // max(1, seen.rows)))).otherwise(parts)
    placed = docs.withColumn("_tie", F.shiftrightunsigned(F.xxhash64(text), 34))  # 30 bits
    placed = placed.withColumns({
        "_piece": piece + F.shiftright(F.col("_tie") * parts, 30),
        "_key": F.struct(id64.isNull().alias("none"), F.coalesce(F.bitwise_not(id64), _long(0)).alias("down"), F.col("_tie").alias("tie"))})
    pieces = Window.orderBy("_piece")
    heads = placed.groupBy("_piece").agg(F.min("_key").alias("_head")).withColumn(
        "_before", F.coalesce(F.lag("_piece").over(pieces), F.max("_piece").over(Window.partitionBy())))
    at = lambda guest, where: F.struct(F.lit(guest).alias("guest"), F.col(where).alias("piece"))
    both = F.when(F.col("_key") == F.col("_head"), F.array(at(0, "_piece"), at(1, "_before"))).otherwise(F.array(at(0, "_piece")))
    spread = placed.join(F.broadcast(heads), "_piece").select(*docs.columns, "_key", F.explode(both).alias("_at"))
    window = Window.partitionBy("_at.piece").orderBy("_at.guest", "_key")
    return spread.withColumns({new: F.lead(c).over(window) for c, new in columns.items()}).where(
        "_at.guest = 0").drop("_key", "_at")


def compare_edited(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its text with the last third replaced by the start of the
    next document's, and the likeness to that and to the next document's: (id, n_chars, edited,
    fingerprint, edited_fingerprint, near_edited, near_next), fingerprints as arrays."""
    plain = docs.select(F.col(id_), F.coalesce(text, F.lit("")).alias("_text"))
    marked = fingerprint(plain, "_text", "fingerprint")
    paired = with_next(marked, id_, "_text", {"_text": "_next", "fingerprint": "_next_fingerprint"})
    n = F.char_length("_text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - third), F.substring(F.col("_next"), F.lit(1), third))
    paired = paired.select(id_, "fingerprint", n.cast("long").alias("n_chars"), edited.alias("edited"), "_next_fingerprint")
    both = fingerprint(paired, "edited", "edited_fingerprint")
    return both.select(id_, "n_chars", "edited", "fingerprint", "edited_fingerprint",
                       likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                       likeness("fingerprint", "_next_fingerprint").alias("near_next"))
