"""User-level library maintenance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quantra.operators import library, promotion
from quantra.operators.promotion import Promotion
from quantra.operators.store import stored


@dataclass(frozen=True)
class Imported:
    """What an import makes: rows to append to the target, rows for review, its counters, and every mapped row with its outcome."""

    target: str
    appended: DataFrame
    candidates: DataFrame
    summary: DataFrame
    routed: DataFrame


def import_rates(rows: DataFrame, existing: DataFrame, kind: str, as_of: str, source_file: str, source_sheet: str = "", mapper: Callable[[DataFrame], DataFrame] | None = None, **given: str) -> Imported:
    """Rows of a source (any headers, `ordinal` is their order) into the target table of a kind of library.KINDS; given values win over the kind's presets."""
    if kind not in library.KINDS:
        raise ValueError(f"no import kind {kind}: {', '.join(library.KINDS)}")
    target, presets = library.KINDS[kind]
    overrides = {k: given.get(k) or v for k, v in presets.items()}
    if mapper:
        mapped = mapper(rows)
    elif target == "RateLibrary":
        mapped = library.to_library(rows, source_file, overrides, source_sheet)
    else:
        mapped = library.to_inputs(rows, source_file, overrides)
    routed = library.route_import(existing, mapped)
    columns = library.LIBRARY_COLUMNS if target == "RateLibrary" else library.INPUT_COLUMNS
    appended = routed.where("outcome = 'append'").select("ordinal", *(c for c in columns if c in routed.columns))
    return Imported(target, appended, library.candidate_rows(routed, target, source_file, as_of, source_sheet), library.import_summary(rows, routed, target, source_file), routed)


@dataclass(frozen=True)
class Review:
    """What a review makes: the candidates after its decisions, a log row for each, counters, and the promotion of what was approved."""

    merged: DataFrame
    log: DataFrame
    summary: DataFrame
    promotion: Promotion


def review_cycle(candidates: DataFrame, decisions: DataFrame, aliases: DataFrame, rates: DataFrame, as_of: str, reviewer: str = "reviewer", file: str = "") -> Review:
    """Decisions into the candidates, then approved candidates into the tables they name."""
    merged = stored(library.merge_reviews(candidates, decisions, reviewer), "reviewed")
    return Review(merged, promotion.review_log(candidates, decisions, file), promotion.merge_summary(candidates, decisions), promotion.promote(merged, aliases, rates, as_of, file))
