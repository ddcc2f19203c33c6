"""Locale tags, localised paths and translated messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import strip

# Supported locales (URL segment -> language tag) and top-level pages.
LOCALES = {
    "en": "en",
    "zh-cn": "zh-CN",
    "hi": "hi",
    "es": "es",
    "ar": "ar",
    "fr": "fr",
    "bn": "bn",
    "pt": "pt",
    "id": "id",
    "ur": "ur",
}
PREFIXED_LOCALES = tuple(seg for seg in LOCALES if seg != "en")
TOP_PAGES = ("lawyers", "how-we-handle-files", "privacy", "terms", "about", "contact", "admin")
# Words that may stay untranslated. Product names are passed by the caller.
NEUTRAL_WORDS = ("PDF", "ZIP", "OCR", "EXIF", "GPS", "XMP", "C2PA", "Bates")


def match_locale(tag: Column) -> Column:
    """Supported locale of one browser tag: exact, then base language; else null."""
    lowered = F.lower(F.coalesce(tag, F.lit("")))
    base = F.split_part(lowered, F.lit("-"), F.lit(1))
    traditional = lowered.startswith("zh-tw") | lowered.startswith("zh-hk")
    return (
        F.when(traditional, F.lit(None).cast("string"))
        .when(lowered.isin(*LOCALES), lowered)
        .when(base.isin(*LOCALES), base)
    )


def match_locales(tags: Column) -> Column:
    """First supported locale of an ordered tag array."""
    return F.get(F.filter(F.transform(tags, match_locale), lambda m: m.isNotNull()), F.lit(0))


def locale_path(path: Column, locale: Column) -> Column:
    """Path under its locale segment; the default locale has none."""
    return F.when(
        locale.isin(*PREFIXED_LOCALES),
        F.concat(F.lit("/"), locale, F.when(path == "/", "").otherwise(path)),
    ).otherwise(path)


def locale_url(base_url: str, path: Column, locale: Column) -> Column:
    return F.concat(F.lit(base_url), locale_path(path, locale))


def is_known_route(path: Column, slugs: tuple[str, ...]) -> Column:
    """Whether a site with these tool slugs generates ``path``."""
    def any_of(words: tuple[str, ...]) -> str:
        return "(?:" + "|".join(rf"\Q{w}\E" for w in words) + ")"

    locale = any_of(PREFIXED_LOCALES)
    page = rf"(?:{any_of(TOP_PAGES)}|tools/{any_of(slugs)})"
    return F.coalesce(path.rlike(rf"\A/*(?:(?:{locale}/)?{page}|{locale})?/*\z"), F.lit(False))


def variables(message: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(message, F.lit(r"\{([a-zA-Z0-9_]+)[,\}]"), F.lit(1)))


def tags(message: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(message, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)>"), F.lit(1)))


def plurals(message: Column) -> Column:
    pattern = r"\{([a-zA-Z0-9_]+),\s*(plural|select|selectordinal)"
    names = F.regexp_extract_all(message, F.lit(pattern), F.lit(1))
    kinds = F.regexp_extract_all(message, F.lit(pattern), F.lit(2))
    return F.array_distinct(F.zip_with(names, kinds, lambda n, k: F.concat(n, F.lit(":"), k)))


# Texts that need no translation.
URL_START, SLUG, NUMBER = r"^https?://", r"\A[a-z0-9_\-./]+\z", r"\A\d+\z"
UNIT_TEXT, UNIT = r"(?i)\A[A-Z0-9 _\-/().,%°×→]+\z", "(?i)pdf|mb|kb|dpi"


def may_stay_identical(value: Column, brands: tuple[str, ...] = ()) -> Column:
    """URLs, slugs, units, brand words and numbers need no translation."""
    text = strip(value)
    tests = [text.rlike(URL_START), text.rlike(SLUG), text.rlike(UNIT_TEXT) & text.rlike(UNIT),
             text.isin(*brands, *NEUTRAL_WORDS), text.rlike(NUMBER)]
    return F.coalesce((text != "") & reduce(lambda a, b: a | b, tests), F.lit(False))

