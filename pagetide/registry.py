"""Operator registry: name -> function from DataFrames and options to a DataFrame.

Options are checked before any job runs and raise :class:`OptionError` with a stable
code. Problems of single rows never raise; they go to an ``error_code`` column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from . import schema as S
from .operators import catalog, edits, layout, metadata, pages, text, traffic, usage


class OptionError(ValueError):
    """A bad operator option, with a stable code."""

    def __init__(self, message: str, code: str = S.INVALID_OPTION):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    options: dict[str, tuple[type, tuple | None]] = field(default_factory=dict)

    def __call__(self, *frames: DataFrame, **options: Any) -> DataFrame:
        if len(frames) != len(self.inputs):
            raise OptionError(f"{self.name} needs {', '.join(self.inputs)}", S.MISSING_INPUT)
        for name, value in options.items():
            if name not in self.options:
                raise OptionError(f"{self.name} has no option {name}", S.BAD_OPTION)
            kind, allowed = self.options[name]
            if isinstance(value, bool) != (kind is bool) or not isinstance(value, kind):
                raise OptionError(f"{name} must be {kind.__name__}")
            if allowed is not None and value not in allowed:
                raise OptionError(f"{name} must be one of {allowed}")
        return self.run(*frames, **options)


OPERATORS: dict[str, Operator] = {}


def register(name: str, run: Callable[..., DataFrame], inputs: tuple[str, ...],
             **options: tuple[type, tuple | None]) -> None:
    if name in OPERATORS:
        raise ValueError(f"duplicate operator: {name}")
    OPERATORS[name] = Operator(name, run, inputs, options)


def _n_up(frame: DataFrame, layout: int = 4, orientation: str = "portrait") -> DataFrame:
    return pages.n_up(frame, layout, orientation == "landscape")


_DOC = ("pages", "options")
register("select_pages", pages.select_pages, _DOC)
register("delete_pages", pages.delete_pages, _DOC)
register("rotate_pages", pages.rotate_pages, _DOC)
register("rotate_by_map", pages.rotate_by_map, _DOC)
register("reorder_pages", pages.reorder_pages, _DOC)
register("split", pages.split_pages, _DOC)
register("page_numbers", pages.label_pages, _DOC)
register("merge", pages.merge_documents, ("pages", "members"))
register("merge_by_order", pages.merge_by_order, ("pages", "members", "orders"))
register("exhibit_combine", pages.combine_exhibits, ("pages", "members"), exhibit_prefix=(str, None),
         bates_prefix=(str, None), bates_start=(int, None), slip_sheets=(bool, None))
register("n_up", _n_up, ("pages",), layout=(int, (2, 4, 6, 9)), orientation=(str, ("portrait", "landscape")))
register("compare", pages.compare_documents, ("left", "right"))
register("extract_text", text.extract_text, _DOC)
register("redact", text.redact_documents, _DOC)
register("ocr_plan", text.ocr_plan, ("pages",))
register("ocr", text.interleave, ("pages", "words"))
register("repair", text.salvage, ("pages",))
register("blocks", layout.build_blocks, ("chars",))
register("metadata", metadata.inspect, ("info",))
register("edit_metadata", metadata.patch, ("info", "edits"))
register("strip_metadata", metadata.strip_report, ("info",), producer_after=(str, None))
register("strip_image_metadata", metadata.image_report, ("images",))
register("edit_state", edits.fold_state, ("items", "log"))
register("edit_order", edits.fold_order, ("log",))
register("geo_lookup", traffic.geo_lookup, ("requests", "blocks"))
register("dashboard", traffic.dashboard_breakdowns, ("visits",), k=(int, None))
register("digest", traffic.digest, ("located", "jobs"), k=(int, None))
register("quota_usage", usage.quota_usage, ("attempts",), limit=(int, None))
register("quota_gate", usage.quota_gate, ("attempts",), limit=(int, None))
register("lockouts", usage.lockouts, ("logins",), max_failures=(int, None), window_seconds=(int, None))
register("reuse_duplicates", usage.reuse_duplicates, ("jobs",), window_seconds=(int, None))
register("triage", text.triage, ("pages",))
register("group_by_dividers", pages.group_by_dividers, _DOC)
register("heading_levels", layout.heading_levels, ("blocks", "sizes"), compatible=(bool, None))
register("check_translations", catalog.check_translations, ("messages", "locales"), default=(str, None))
register("sitemap", catalog.sitemap, ("paths",), base_url=(str, None))
