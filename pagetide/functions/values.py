"""Small value functions: dates, names, labels, options, uploads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

# MIME types and the extensions they imply.
PDF_MIME = "application/pdf"
IMAGE_MIMES = ("image/png", "image/jpeg", "image/webp")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp")
MIME_EXTENSIONS = {"application/pdf": "pdf", "image/png": "png", "image/jpeg": "jpg"}

BLANKS = r"[ \t\n\r\f\x0B]"


def strip(text: Column) -> Column:
    """Trim ASCII white space (not only spaces) on both ends."""
    return F.regexp_replace(text, rf"^{BLANKS}+|{BLANKS}+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def label_or(text: Column, default: str) -> Column:
    """Null and '' print as ``default``."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def short_error(error: Column, default: str = "Unknown error", limit: int = 200) -> Column:
    return F.left(label_or(error, default), F.lit(limit))


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hour_start(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def utc_instant(wall: Column) -> Column:
    """Zone-free UTC time to an instant, whatever the session zone (streams need instants)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), wall))


def utc_wall(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch())


def quota_key(ip: Column, tool: Column, ts: Column) -> Column:
    return F.concat_ws("|", ip, tool, F.date_format(ts, "yyyyMMddHH"))


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a time; blank or unreadable gives null."""
    return F.nullif(text, F.lit("")).try_cast("timestamp_ntz")


def extension(filename: Column, mime: Column) -> Column:
    by_mime = F.coalesce(*[F.when(mime == m, F.lit(e)) for m, e in MIME_EXTENSIONS.items()],
                         F.lit("bin"))
    return F.when(
        filename.contains("."),
        F.left(F.lower(F.substring_index(filename, ".", -1)), F.lit(10)),
    ).otherwise(by_mime)


def storage_key(sha256: Column, ext: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(ext), r"^\.+", "")
    return F.concat(sha256, F.lit("."), label_or(cleaned, "bin"))


def media_kind(filename: Column, mime: Column) -> Column:
    """pdf, image or other, by MIME type or by file suffix."""
    kind, name = F.lower(F.coalesce(mime, F.lit(""))), F.lower(filename)
    suffixed = F.lit(False)
    for suffix in IMAGE_SUFFIXES:
        suffixed = suffixed | name.endswith(suffix)
    return (
        F.when((kind == PDF_MIME) | name.endswith(".pdf"), "pdf")
        .when(kind.isin(*IMAGE_MIMES) | suffixed, "image")
        .otherwise("other")
    )


def intake_code(size: Column, head: Column, filename: Column, mime: Column,
                max_bytes: int | None = None) -> Column:
    """First failing intake rule, or null: size (if bounded), emptiness, PDF mark, type."""
    kind = media_kind(filename, mime)
    return (
        F.when(F.lit(False) if max_bytes is None else size > max_bytes, S.FILE_TOO_LARGE)
        .when(size == 0, "empty_file")
        .when((kind == "pdf") & ~F.coalesce(head.startswith("%PDF-"), F.lit(False)), "not_a_pdf")
        .when(kind == "other", "unsupported_type")
    )


def exhibit_letter(index: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA, ... (bijective base 26, any length)."""
    state = "struct<letters:string,rest:bigint>"
    # 13 digits cover the whole bigint range
    folded = F.aggregate(
        F.sequence(F.lit(1), F.lit(14)),
        F.struct(F.lit("").alias("letters"), index.cast("long").alias("rest")).cast(state),
        lambda acc, _: F.when(acc["rest"] < 0, acc).otherwise(
            F.struct(
                F.concat(F.char((acc["rest"] % 26 + 65).cast("int")), acc["letters"]).alias("letters"),
                (F.floor(acc["rest"] / 26) - 1).cast("long").alias("rest"),
            ).cast(state)
        ),
    )
    return folded["letters"]


def bates_label(prefix: str | Column, number: Column) -> Column:
    """At least six digits; wider numbers are not cut."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.format_string("-%06d", number))


def label_code(label: Column) -> Column:
    return F.when(label.rlike(r"\A[A-Za-z0-9 _-]+\z"), F.lit(None)).otherwise(S.INVALID_OPTION)


def int_option(value: Column, minimum: int, maximum: int | None = None,
               is_text: Column | None = None) -> tuple[Column, Column]:
    """(integer, error code) of an option given as text.

    ``is_text`` tells options that arrived as strings: ``"2.0"`` is not an integer
    there, while the number 2.0 is. Booleans are never integers.
    """
    text = strip(value)
    as_text = text.rlike(r"\A[+-]?\d+\z")
    as_number = as_text | text.rlike(r"\A[+-]?\d+\.0*\z")
    whole = as_number if is_text is None else F.when(is_text, as_text).otherwise(as_number)
    number = F.regexp_replace(text, r"\.0*$", "").try_cast("long")
    upper = F.lit(True) if maximum is None else number <= maximum
    good = F.coalesce(whole & (number >= minimum) & upper, F.lit(False))
    return F.when(good, number), F.when(~good, F.lit(S.INVALID_OPTION))


def normal_angle(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360))


def is_quarter_turn(angle: Column) -> Column:
    return angle.isin(90, 180, 270)


def literal_list(patterns: Column) -> Column:
    """Comma list to trimmed, non-empty literals."""
    return F.filter(F.transform(F.split(patterns, ","), strip), lambda p: p != "")


def ocr_box(left: Column, top: Column, width: Column, height: Column, page_height_pt: Column,
            dpi: int = 200) -> dict[str, Column]:
    """Pixel box (origin top left) to page points (origin bottom left)."""
    scale = F.lit(72.0) / F.lit(dpi)
    return {
        "x_pt": left * scale,
        "y_pt": page_height_pt - (top + height) * scale,
        "font_pt": F.greatest(height * scale, F.lit(1.0)),
    }


def split_name(first: Column, last: Column) -> Column:
    """Name of one split output."""
    return F.when(first == last, F.format_string("page-%03d", first)).when(
        first < last, F.format_string("pages-%03d-%03d", first, last)
    )
