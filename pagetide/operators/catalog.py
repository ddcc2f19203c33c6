"""Tool catalog, routes, translations and consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import locales as L
from ..functions.values import strip
from ..session import store

# The tool catalog (key, category, input kind, min files, max files, output kind).
TOOLS = (
    ("merge", "organize", "pdf", 2, 20, "pdf"),
    ("split", "organize", "pdf", 1, 1, "zip"),
    ("rotate_pages", "organize", "pdf", 1, 1, "pdf"),
    ("delete_pages", "organize", "pdf", 1, 1, "pdf"),
    ("reorder_pages", "organize", "pdf", 1, 1, "pdf"),
    ("n_up", "organize", "pdf", 1, 1, "pdf"),
    ("repair", "optimize", "pdf", 1, 1, "pdf"),
    ("extract_text", "convert", "pdf", 1, 1, "text"),
    ("pdf_to_images", "convert", "pdf", 1, 1, "zip"),
    ("images_to_pdf", "convert", "image", 1, 20, "pdf"),
    ("ocr", "convert", "pdf", 1, 1, "pdf"),
    ("metadata", "edit", "pdf", 1, 1, "text"),
    ("edit_metadata", "edit", "pdf", 1, 1, "pdf"),
    ("watermark", "edit", "pdf", 1, 1, "pdf"),
    ("page_numbers", "edit", "pdf", 1, 1, "pdf"),
    ("crop", "edit", "pdf", 1, 1, "pdf"),
    ("grayscale", "optimize", "pdf", 1, 1, "pdf"),
    ("password_protect", "security", "pdf", 1, 1, "pdf"),
    ("unlock_pdf", "security", "pdf", 1, 1, "pdf"),
    ("redact", "security", "pdf", 1, 1, "pdf"),
    ("flatten", "security", "pdf", 1, 1, "pdf"),
    ("pdf_to_word", "convert", "pdf", 1, 1, "document"),
    ("compress", "optimize", "pdf", 1, 10, "zip"),
    ("strip_metadata", "security", "pdf", 1, 10, "zip"),
    ("exhibit_combine", "organize", "pdf", 2, 20, "pdf"),
    ("strip_image_metadata", "security", "image", 1, 10, "zip"),
)
# Options of the tools (tool, name, kind, required, default).
TOOL_OPTIONS = (
    ("merge", "page_order", "text", False, None),
    ("split", "mode", "select", False, "ranges"),
    ("split", "ranges", "text", False, None),
    ("rotate_pages", "angle", "select", False, None),
    ("rotate_pages", "pages", "pages", False, None),
    ("rotate_pages", "rotations", "text", False, None),
    ("delete_pages", "pages", "pages", True, None),
    ("reorder_pages", "order", "text", True, None),
    ("n_up", "layout", "select", False, None),
    ("n_up", "sheet", "select", False, None),
    ("n_up", "orientation", "select", False, None),
    ("extract_text", "pages", "pages", False, None),
    ("ocr", "language", "text", False, "eng"),
    ("edit_metadata", "title", "text", False, None),
    ("edit_metadata", "author", "text", False, None),
    ("edit_metadata", "subject", "text", False, None),
    ("edit_metadata", "keywords", "text", False, None),
    ("page_numbers", "vertical", "select", False, None),
    ("page_numbers", "horizontal", "select", False, None),
    ("page_numbers", "start_number", "number", False, "1"),
    ("page_numbers", "prefix", "text", False, None),
    ("page_numbers", "suffix", "text", False, None),
    ("page_numbers", "font_size", "number", False, "10"),
    ("page_numbers", "pages", "pages", False, None),
    ("redact", "patterns", "text", True, None),
    ("redact", "rasterise", "boolean", False, "false"),
    ("compress", "target_mb", "select", False, None),
    ("exhibit_combine", "exhibit_prefix", "text", False, "Exhibit"),
    ("exhibit_combine", "bates_prefix", "text", False, "BATES"),
    ("exhibit_combine", "bates_start", "number", False, "1"),
    ("exhibit_combine", "slip_sheets", "boolean", False, "true"),
    ("pdf_to_images", "format", "select", False, "png"),
    ("pdf_to_images", "dpi", "number", False, "150"),
    ("pdf_to_images", "pages", "pages", False, None),
    ("watermark", "text", "text", True, None),
    ("watermark", "opacity", "number", False, "0.2"),
    ("crop", "top", "number", False, "0"),
    ("crop", "bottom", "number", False, "0"),
    ("crop", "left", "number", False, "0"),
    ("crop", "right", "number", False, "0"),
    ("crop", "pages", "pages", False, None),
    ("grayscale", "dpi", "number", False, "200"),
    ("password_protect", "password", "text", True, None),
    ("unlock_pdf", "password", "text", True, None),
)
# ---- end of fixed values ----

TOOL_KEYS = tuple(t[0] for t in TOOLS)


def tool_catalog(spark: SparkSession) -> DataFrame:
    """The catalog as a nested dimension table (26 rows)."""
    schema = (
        "key string, category string, input_kinds array<string>, min_files int, max_files int, "
        "output_kind string, "
        "options array<struct<name:string,kind:string,required:boolean,default:string>>"
    )
    rows = [
        (key, category, [kind], low, high, out, [o[1:] for o in TOOL_OPTIONS if o[0] == key])
        for key, category, kind, low, high, out in TOOLS
    ]
    return spark.createDataFrame(rows, schema)


def tool_options(catalog: DataFrame) -> DataFrame:
    """One row per (tool, option)."""
    return catalog.select("key", F.explode_outer("options").alias("o")).select(
        "key", F.col("o.name").alias("option"), F.col("o.kind").alias("kind"),
        F.col("o.required").alias("required"), F.col("o.default").alias("default"),
    )


def catalog_diff(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """Keys in only one of two catalogs; both sides are made distinct first."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right")
    return a.join(b, key, "full_outer").select(key, side.alias("side")).filter("side IS NOT NULL")


def sitemap(paths: DataFrame, base_url: str) -> DataFrame:
    """Every (path, locale) entry with all its language alternates.

    The ten locales are an array literal, so the expansion is a row generator on
    the paths and needs neither a join nor a shuffle.
    """
    segments = F.array(*[F.lit(s) for s in L.LOCALES])
    pairs = [("x-default", "en"), *[(tag, seg) for seg, tag in L.LOCALES.items()]]
    alternates = F.create_map(*[
        c for tag, seg in pairs for c in (F.lit(tag), L.locale_url(base_url, F.col("path"), F.lit(seg)))
    ])
    return paths.withColumn("locale", F.explode(segments)).select(
        "path", "locale", L.locale_url(base_url, F.col("path"), F.col("locale")).alias("url"),
        alternates.alias("alternates"),
    )


# ------------------------------------------------------------- translations

# Levels of nesting opened between two writes.
LEVELS = 8


def _numbers_quoted(text: Column) -> Column:
    """JSON text with every number as a string, so that its spelling lasts. Escaped quotes are out
    of the way meanwhile; the four control characters used cannot stand in JSON text."""
    hidden = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x03")), F.lit('\\"'), F.lit("\x04"))
    split = F.regexp_replace(hidden, r'("[^"]*+")|(-?[0-9][0-9.eE+-]*+)', "$1\x01$2\x02")
    quoted = F.translate(F.replace(split, F.lit("\x01\x02"), F.lit("")), "\x01\x02", '""')
    return F.replace(F.replace(quoted, F.lit("\x04"), F.lit('\\"')), F.lit("\x03"), F.lit("\\\\"))


def _node(path: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), value.alias("value"))


def _one_level(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Containers replaced by what they hold, leaves as they are. A variant is read where it lies;
    no text is parsed again. A string is no container, whatever it reads like."""
    path, value = F.col("_node.path"), F.col("_node.value")
    members = F.transform(
        F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")),
        lambda m: _node(F.when(path == "", m["key"]).otherwise(F.concat(path, F.lit("."), m["key"])), m["value"]))
    items = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda v, i: _node(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), v))
    return nodes.select(*ids, F.explode(F.coalesce(members, items, F.array("_node"))).alias("_node"))


def _is_container(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "map<string,variant>").isNotNull()
                      | F.try_variant_get(value, "$", "array<variant>").isNotNull(), F.lit(False))


def flatten_json(df: DataFrame, text_col: str) -> DataFrame:
    """Nested JSON text to (key path, value) rows: ``a.b`` for members, ``a[0]`` for items, at any
    depth the engine's parser reads (a thousand levels). Numbers keep their spelling; containers
    without content have no row. Text that is not JSON, nests deeper, or names a key of an object
    twice is one row without key and value.

    The text is parsed once. LEVELS levels are opened a round; what is still a container goes to
    the next round, until none is left.
    """
    ids = [c for c in df.columns if c != text_col]
    # Few bytes of a file are much work here, so rows are dealt over the whole width first.
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    top = df.withColumn("_top", F.try_parse_json(_numbers_quoted(F.col(text_col))))
    valid = F.when(F.try_parse_json(text_col).isNotNull(), F.col("_top"))
    nodes, out = top.select(*ids, _node(F.lit(""), valid).alias("_node")), None
    while True:
        for _ in range(LEVELS):
            nodes = _one_level(nodes, ids)
        nodes = nodes.select(*ids, "_node", _is_container(F.col("_node.value")).alias("_open"))
        nodes = store(nodes, "nodes")
        leaves = nodes.filter("NOT _open")
        out = leaves if out is None else out.union(leaves)
        nodes = nodes.filter("_open").drop("_open")
        if nodes.isEmpty():
            return out.select(*ids, F.col("_node.path").alias("key"),
                              F.try_variant_get("_node.value", "$", "string").alias("value"))


def _missing(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) > 0


def check_translations(messages: DataFrame, locales: DataFrame, default: str = "en",
                       brands: tuple[str, ...] = ()) -> DataFrame:
    """Problems per (locale, key): missing, empty, broken, untranslated, extra.

    The expected rows are the default-locale keys repeated for each *present* locale, whichever
    these are, then joined once to the translated rows.
    """
    source = messages.filter(F.col("locale") == default).select("key", F.col("value").alias("en_value"))
    present = locales.filter(F.col("locale") != default).agg(F.collect_set("locale")).scalar()
    wanted = source.withColumn("locale", F.explode(present))
    have = messages.filter(F.col("locale") != default).select("locale", "key", "value", F.lit(True).alias("_have"))
    both = wanted.withColumn("_want", F.lit(True)).join(have, ["locale", "key"], "full_outer")
    en, val = F.col("en_value"), F.col("value")
    neutral = L.may_stay_identical(en, brands)
    ev, lv = L.variables(en), L.variables(val)
    broken = ~neutral & (
        _missing(ev, lv) | _missing(lv, ev) | _missing(L.tags(en), L.tags(val))
        | _missing(L.plurals(en), L.plurals(val))
    )
    blank = strip(val) == ""
    problems = F.filter(F.array(
        F.when(F.col("_have").isNull(), F.lit("missing")),
        F.when(blank & (strip(en) != ""), F.lit("empty")),
        F.when(~blank & broken, F.lit("broken")),
        F.when(~blank & (val == en) & ~neutral, F.lit("untranslated")),
        F.when(F.col("_want").isNull(), F.lit("extra")),
    ), lambda p: p.isNotNull())
    return both.select("locale", "key", F.explode(problems).alias("problem"))


def locale_coverage(messages: DataFrame, problems: DataFrame, locales: DataFrame,
                    default: str = "en") -> DataFrame:
    """Keys present per locale and percent of the default's keys."""
    total = messages.filter(F.col("locale") == default).agg(F.count(F.lit(1))).scalar()
    absent = problems.filter(F.col("problem").isin("missing", "empty")).groupBy("locale").agg(
        F.count(F.lit(1)).alias("absent"))
    keyed = locales.filter(F.col("locale") != default).select("locale").distinct().withColumn("total", total)
    present = F.col("total") - F.coalesce("absent", F.lit(0))
    return keyed.join(absent, "locale", "left").select(
        "locale", present.alias("present"), "total",
        F.round(present * 100.0 / F.col("total"), 1).alias("percent"),
    )


# How many keys of each class a report lists; the others are listed in full.
LISTED = {"missing": 30, "broken": 30, "untranslated": 20, "extra": 10}


def sample_keys(problems: DataFrame, listed: dict[str, int] | None = None) -> DataFrame:
    """First keys per (locale, problem), as many as ``listed`` has for the class (default LISTED);
    ranked before they are collected."""
    limits = LISTED if listed is None else listed
    limit = F.coalesce(*[F.when(F.col("problem") == p, n) for p, n in limits.items()], F.lit(None).cast("int"))
    rank = Window.partitionBy("locale", "problem").orderBy("key")
    return (
        problems.withColumn("_r", F.row_number().over(rank)).filter(limit.isNull() | (F.col("_r") <= limit))
        .groupBy("locale", "problem")
        .agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"))
    )
