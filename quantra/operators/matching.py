"""Section inference and fuzzy matching of bill lines to a rate library.

The text scores depend on two texts alone, and everything else on a few attributes of the line. So lines are reduced to distinct match keys, items to
distinct texts, and textindex.py finds for each key the texts that can hold one of its best items, by bounds that are read best first; no text meets all the others. Items of one
text differ in their bonuses alone: of those that share the section, region and unit a key asks for (each or any of the three), only the first few by
hint and table order can be among its best. So a key meets a bounded number of items a text, whatever the size of the library, and the library is read once, for these. All of this is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantra.functions.phrases import occurring, replaced
from quantra.functions.text import normalize_text, normalize_unit, sheet_section
from quantra.operators.store import spread, stored
from quantra.operators.textindex import Costs, reachable_texts


@dataclass(frozen=True)
class Weights:
    """D13."""

    threshold: float = 78
    review: float = 65
    strong: float = 88
    region: float = 4
    section: float = 8
    unit: float = 6
    alias: float = 5
    unit_penalty: float = 18


#: What a line's match depends on: lines that agree in these are matched and priced alike.
CONTEXT = ["sheet_name", "headings", "description", "unit", "region"]
#: Rows of a sheet that one task scans for headings; longer sheets are several blocks.
BLOCK = 4096


def heading_context(lines: DataFrame, last: int = 5) -> DataFrame:
    """Adds headings: the last five heading texts before the row in its sheet. The rows are written once, so that what follows reads them as often as it likes.

    A scan in two passes: blocks of rows are scanned by themselves, and a block begins with what the blocks before it end with (their last five, the only state that matters), so a
    sheet of any length is spread over tasks. The second pass is left out where no sheet has a second block.
    """
    sheet = ["boq_id", "sheet_name"]
    tail = lambda x: F.slice(x, F.greatest(F.size(x) - last + 1, F.lit(1)), last)
    own = F.collect_list(F.when(F.col("is_heading"), F.col("description"))).over(Window.partitionBy(*sheet, "__block").orderBy("row_number").rowsBetween(Window.unboundedPreceding, -1))
    blocked = stored(lines.withColumn("__block", F.floor(F.col("row_number") / BLOCK)).withColumn("headings", tail(own)), "headed-lines")
    later = blocked.where("__block <> 0").select(*sheet, "__block")
    if later.isEmpty():
        return blocked.drop("__block")
    long = blocked.join(later.select(*sheet).distinct(), sheet, "left_semi")
    ends = long.where("is_heading").groupBy(*sheet, "__block").agg(tail(F.transform(F.array_sort(F.collect_list(F.struct("row_number", "description"))), lambda x: x["description"])).alias("end"))
    # of the blocks with headings, a block needs at most the five before it
    seen = long.select(*sheet, "__block").distinct().join(ends, [*sheet, "__block"], "left")
    before = F.collect_list("end").over(Window.partitionBy(*sheet).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    carried = seen.withColumn("carry", tail(F.flatten(tail(before)))).where("size(carry) > 0").select(*sheet, "__block", "carry")
    none = F.array().cast("array<string>")
    joined = blocked.join(carried, [*sheet, "__block"], "left")
    return stored(joined.withColumn("headings", tail(F.concat(F.coalesce("carry", none), "headings"))).drop("__block", "carry"), "headed-lines")


def priceable(lines: DataFrame) -> DataFrame:
    """Without headings and summary rows."""
    return lines.where("NOT is_heading AND NOT is_summary_row")


def infer_sections(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds inferred_section: of the rules whose trigger occurs in sheet name, hint, headings and description, the one with the highest priority
    (table order on ties); else the sheet's hint. All triggers are looked for in one pass over a line's corpus."""
    ranked = rules.select((-F.col("priority")).alias("rank"), "ordinal", "inferred_section", "trigger_text")
    parts = F.filter(F.concat(F.array("sheet_name", sheet_section("sheet_name")), F.col("headings"), F.array("description")), lambda x: x.isNotNull() & (x != ""))
    found = lines.withColumn("__found", occurring(normalize_text(F.array_join(parts, " ")), ranked, normalize_text("trigger_text"), "rank", "ordinal"))
    return found.withColumn("inferred_section", F.coalesce(F.try_element_at("__found", F.lit(1))["inferred_section"], sheet_section("sheet_name"))).drop("__found")


def apply_aliases(lines: DataFrame, aliases: DataFrame, column: str = "description") -> DataFrame:
    """Adds query (the normalized text after every alias in table order, whole words only) and alias_hits (struct of alias, section_bias of those
    whose alias occurs as a substring, whether or not a whole word was replaced)."""
    done = replaced(normalize_text(column), aliases, normalize_text("alias"), normalize_text("canonical_term"), F.col("section_bias"), "ordinal")
    return lines.withColumn("__done", done).withColumn("query", F.col("__done.t")).withColumn("alias_hits", F.col("__done.h")).drop("__done")


#: A key's best item and its alternates.
PLACES, ANY = 4, "\x00"


def first_items(items: DataFrame) -> DataFrame:
    """The first PLACES items, by confidence hint and table order, of each text, section, region and unit: no other can be among a key's best, nor among the first of a wider choice. Written once.
    A task keeps PLACES of a kind before kinds are brought together, so that a large kind is not a single task's work."""
    kind = ["item_text", F.lower("item_section"), F.lower("item_region"), _unit_of_item()]
    order = Window.partitionBy(*kind).orderBy(F.desc("confidence_hint"), "ordinal")
    return stored(items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PLACES).drop("place"), "first-items")


def _unit_of_item() -> Column:
    return F.when(F.col("item_unit") == "", F.lit("")).otherwise(F.col("item_unit_key"))


def leading_items(items: DataFrame) -> DataFrame:
    """(item_text, at_section, at_region, at_unit, ordinal): the first PLACES items, by confidence hint and table order, of each text and each choice of a section, region and unit or ANY of them."""
    wide = items.select("item_text", "ordinal", "confidence_hint", F.explode(F.array(F.lower("item_section"), F.lit(ANY))).alias("at_section"), F.lower("item_region").alias("__region"), _unit_of_item().alias("__unit"))
    wide = wide.withColumn("at_region", F.explode(F.array("__region", F.lit(ANY)))).withColumn("at_unit", F.explode(F.array("__unit", F.lit(ANY))))
    order = Window.partitionBy("item_text", "at_section", "at_region", "at_unit").orderBy(F.desc("confidence_hint"), "ordinal")
    return wide.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PLACES).select("item_text", "at_section", "at_region", "at_unit", "ordinal")


def candidate_items(met: DataFrame, items: DataFrame) -> DataFrame:
    """met (keys with an item_text and its scores) with the ordinals of all items that can be among a key's best PLACES."""
    columns = [c for c in met.columns if c != "item_text"]
    levels = lambda c, *more: F.explode(F.array_distinct(F.array(c, *more, F.lit(ANY))))
    met = met.withColumn("at_section", levels(F.lower("inferred_section"))).withColumn("at_region", levels(F.lower("region"))).withColumn("at_unit", levels(F.col("line_unit"), F.lit("")))
    return met.join(leading_items(items), ["item_text", "at_section", "at_region", "at_unit"]).select(*columns, "item_text", "ordinal").distinct()


KEYS = ["query", "inferred_section", "region", "line_unit", "alias_count", "alias_section"]


def best_matches(lines: DataFrame, library: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """One row a line with its best active item, up to three alternates and the decision.

    lines: query, alias_hits (apply_aliases), inferred_section, unit, region. score = text score + section, region, unit and alias bonuses - 1.25 penalty for
    another unit + confidence_hint; ties to the first item of the table.
    """
    items = spread(library.where("active"), "ordinal").select("ordinal", "item_code", F.col("description").alias("item_description"), normalize_text("normalized_description" if "normalized_description" in library.columns else "description").alias("item_text"), F.col("section").alias("item_section"), F.col("unit").alias("item_unit"), normalize_unit("unit").alias("item_unit_key"), F.col("region").alias("item_region"), F.col("rate").alias("item_rate"), "basis", (F.col("source") if "source" in library.columns else F.lit("")).alias("item_source"), "confidence_hint")
    items = first_items(items)
    same = F.filter("alias_hits", lambda h: (h["b"] != "") & (F.col("inferred_section") != "") & (F.lower(h["b"]) == F.lower("inferred_section")))
    keyed = lines.withColumn("line_unit", normalize_unit("unit")).withColumn("alias_count", F.least(F.size("alias_hits"), F.lit(2))).withColumn("alias_section", F.size(same) > 0)
    keys = stored(keyed.select(*KEYS).distinct().withColumn("key_id", F.monotonically_increasing_id()), "match-keys")  # from here on a key goes by its number: queries may be long
    costs = Costs(weights.section, weights.region, weights.unit, weights.unit_penalty * 1.25, weights.alias, weights.review)
    met = reachable_texts(keys, items, costs, PLACES).drop("query").withColumn("text_score", F.expr("sort_score * 0.45D + partial_score * 0.20D + set_score * 0.35D"))
    product = candidate_items(met, items).join(items.drop("item_text"), "ordinal")
    both_sections = (F.col("inferred_section") != "") & (F.col("item_section") != "")
    section_same = both_sections & (F.lower("inferred_section") == F.lower("item_section"))
    region_same = (F.col("region") != "") & (F.col("item_region") != "") & (F.lower("region") == F.lower("item_region"))
    both_units = (F.col("line_unit") != "") & (F.col("item_unit") != "")
    unit_same = both_units & (F.col("line_unit") == F.col("item_unit_key"))
    bonus = lambda test, x: F.when(test, F.lit(float(x))).otherwise(F.lit(0.0))
    score = (
        F.col("text_score") + bonus(section_same, weights.section) + bonus(region_same, weights.region) + bonus(unit_same, weights.unit) - bonus(both_units & ~unit_same, weights.unit_penalty * 1.25)
        + F.col("alias_count") * F.lit(float(weights.alias)) + bonus(F.col("alias_section"), weights.alias) + F.col("confidence_hint")
    )
    note = lambda test, x: F.when(F.col(test) if isinstance(test, str) else test, x if isinstance(x, Column) else F.lit(x)).otherwise(F.lit(""))
    flags = F.filter(
        F.array(
            note(both_sections & ~section_same, "section mismatch"),
            note(both_units & ~unit_same, F.concat(F.lit("unit mismatch: boq="), F.col("line_unit"), F.lit(" library="), F.col("item_unit_key"))),
            note(F.col("line_unit") == "", "missing boq unit"),
            note(F.col("unstable"), "unstable text score"),
        ),
        lambda x: x != "",
    )
    order = Window.partitionBy("key_id").orderBy(F.desc("raw_score"), "ordinal")
    parts = ["text_score", "sort_score", "partial_score", "set_score"]
    slim = product.select("key_id", *KEYS[1:], "ordinal", *parts, (F.abs(F.col("sort_score") - F.col("partial_score")) > 20).alias("unstable"), section_same.alias("section_bonus"), region_same.alias("region_bonus"), unit_same.alias("unit_bonus"), (both_units & ~unit_same).alias("unit_penalty"), score.alias("raw_score"))
    top = slim.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PLACES)
    scored = top.join(items, "ordinal")
    said = [F.format_string(f"{n}=%.1f", f"{n}_score") for n in ("text", "sort", "set")]
    said += [note(F.col(n), F.lit(n.replace("_", "-"))) for n in ("section_bonus", "region_bonus", "unit_bonus", "unit_penalty")]
    said += [note(F.col("alias_count") > 0, "alias-bonus"), note("alias_section", "alias-section-bonus")]
    why = F.concat(F.filter(F.array(*said), lambda x: x != ""), flags)
    option = F.format_string("%s | %s | %s | %.2f | %.1f", "item_code", "item_description", "item_unit", F.col("item_rate").cast("double"), "raw_score")
    first = lambda c: F.max(F.when(F.col("place") == 1, c if isinstance(c, Column) else F.col(c)))
    best = scored.groupBy("key_id").agg(
        *(first(c).alias(n) for c, n in (("item_code", "matched_item_code"), ("item_description", "matched_description"), ("item_unit", "matched_unit"), ("item_rate", "rate"), ("item_section", "section_used"), ("item_region", "item_region"), ("item_source", "source"), ("basis", "basis"), ("raw_score", "raw_score"))),
        first(flags).alias("flags"),
        first(why).alias("match_rationale"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("place") > 1) & (F.col("raw_score") >= weights.review), F.struct("place", option.alias("o"))))), lambda x: x["o"]).alias("alternates"),
    )
    out = keyed.join(keys.join(best, "key_id").drop("key_id"), KEYS, "left").withColumn("region_used", F.when(F.col("raw_score").isNotNull(), F.coalesce(F.nullif("item_region", F.lit("")), "region"))).drop("item_region")
    return decide(out, weights).drop("line_unit", "alias_count", "alias_section")


def decide(results: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """D09 and C26's rounding: matched at the threshold by the unrounded score, flagged under the strong one, on another unit or unmatched; no item: unmatched."""
    none = F.col("raw_score").isNull()
    decision = F.when(none, F.lit("unmatched")).when(F.col("raw_score") >= weights.threshold, F.lit("matched")).otherwise(F.lit("review"))
    mismatch = F.exists(F.coalesce("flags", F.array().cast("array<string>")), lambda x: x.startswith("unit mismatch:"))
    return (
        results.withColumn("decision", decision)
        .withColumn("review_flag", none | (F.col("raw_score") < weights.strong) | mismatch | (decision != "matched"))
        .withColumn("confidence_score", F.coalesce(F.round("raw_score", 2), F.lit(0.0)))
        .withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
        .withColumn("alternates", F.coalesce("alternates", F.array().cast("array<string>")))
        .withColumn("match_rationale", F.coalesce("match_rationale", F.array(F.lit("no-active-items"))))
        .withColumn("built_up", F.lit(False))
    )


def review_floor(results: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Under the review threshold a line is unmatched and flagged with a note; code and rate stay."""
    low = F.col("confidence_score") < weights.review
    note = F.array(F.lit("low confidence requires manual pricing review"))
    return (
        results.withColumn("decision", F.when(low, F.lit("unmatched")).otherwise(F.col("decision")))
        .withColumn("review_flag", F.col("review_flag") | low)
        .withColumn("flags", F.when(low, F.concat("flags", note)).otherwise(F.col("flags")))
    )
