"""User-level pricing: price one or many bills in one job, from lines, from grids of cells or from a folder of bill files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantra.operators import buildup, commercial, grid, matching, sinks
from quantra.operators.commercial import Terms
from quantra.operators.matching import Weights
from quantra.operators.store import joined_back, stored
from quantra.sources.tables import bill_files


@dataclass(frozen=True)
class Database:
    """The dimension tables of a run; adjustments may be empty. controls (key, value), assumptions and exclusions may be missing."""

    library: DataFrame
    aliases: DataFrame
    rules: DataFrame
    inputs: DataFrame
    recipes: DataFrame
    adjustments: DataFrame
    controls: DataFrame | None = None
    assumptions: DataFrame | None = None
    exclusions: DataFrame | None = None


@dataclass(frozen=True)
class Cases:
    """Lines and what they are told, apart: `lines` have their inferred section, query and alias hits; `priced` has one row for lines that agree in `keys`, with all else that is said of them."""

    lines: DataFrame
    priced: DataFrame
    keys: list[str]

    def whole(self, said: DataFrame | None = None) -> DataFrame:
        """The lines, each with its result, or with what `said` (keys and more, a row a row of `priced`) has in its place."""
        return joined_back(self.lines, self.priced if said is None else stored(said, "said"), self.keys)


def price_cases(lines: DataFrame, db: Database, weights: Weights = Weights(), terms: Terms = Terms()) -> Cases:
    """price, with lines and results apart, for sinks that do their work once a case and not once a line."""
    return _cases(matching.priceable(matching.heading_context(lines.drop("rate", "amount"))), db, weights, terms)  # a bill's own prices are no prices of the library


def price(lines: DataFrame, db: Database, weights: Weights = Weights(), terms: Terms = Terms()) -> DataFrame:
    """Results of all priceable lines of all bills. lines: boq_id, sheet_name, row_number, description, unit, quantity, region, is_heading, is_summary_row."""
    return price_cases(lines, db, weights, terms).whole()


def price_whole(lines: DataFrame, db: Database, weights: Weights = Weights(), terms: Terms = Terms()) -> DataFrame:
    """All lines of all bills, priceable or not, each with its result, null where it is not priceable: for results that hold whole bills, so that these need not be made again and joined to their prices.
    lines: as for price, without prices of their own."""
    told = matching.heading_context(lines).withColumn("priceable", F.coalesce(F.expr("NOT is_heading AND NOT is_summary_row"), F.lit(False)))
    return _cases(told, db, weights, terms, ["priceable"]).whole()


#: What the section of a line depends on, and what its price does once that is told: of the headings only the section counts.
SECTIONED = ["sheet_name", "headings", "description"]
CASE = ["sheet_name", "description", "unit", "region", "inferred_section"]


def _cases(rows: DataFrame, db: Database, weights: Weights, terms: Terms, only: list[str] | None = None) -> Cases:
    """Nothing in a result depends on a line's bill, row or quantity. Sections depend on sheet, headings and description, prices on a case, and each is joined to the lines by itself:
    the lines' contexts are the product of both, and too many to be sent to every task long before either is. only: columns of rows that are true where a line is priced."""
    only = only or []
    priced_rows = reduce(lambda df, c: df.where(c), only, rows)
    texts = stored(priced_rows.select(*matching.CONTEXT, *only).distinct(), "contexts")
    sectioned, case = [*SECTIONED, *only], [*CASE, *only]
    told = stored(matching.apply_aliases(matching.infer_sections(texts, db.rules), db.aliases), "sectioned")
    sections = stored(told.groupBy(*sectioned).agg(*(F.first(c).alias(c) for c in ("inferred_section", "query", "alias_hits"))), "sections")
    cases = told.groupBy(*case).agg(F.first("query").alias("query"), F.first("alias_hits").alias("alias_hits"))
    priced = stored(_price_cases(cases, db, weights, terms).drop("query", "alias_hits"), "priced-cases")
    return Cases(joined_back(rows, sections, sectioned), priced, case)


def _price_cases(cases: DataFrame, db: Database, weights: Weights, terms: Terms) -> DataFrame:
    cases = stored(cases, "cases")
    matched = matching.best_matches(cases, db.library, weights)
    arbitrated = buildup.arbitrate(matched, buildup.build_ups(cases, db.recipes, db.inputs, weights), weights)
    floored = matching.review_floor(arbitrated, weights)
    section = F.coalesce(F.nullif("section_used", F.lit("")), F.nullif("inferred_section", F.lit("")), F.col("sheet_name"))
    priced = commercial.regional_rates(floored.withColumn("section", section), db.adjustments)
    factor = F.col("regional_factor")
    told = F.filter(F.array(F.format_string("regional-factor=%.3f", factor.cast("double")), F.col("factor_notes")), lambda x: x != "")
    priced = priced.withColumn("rationale", F.when(factor != 1, F.concat("rationale", told)).otherwise(F.col("rationale")))
    return priced.withColumn("flags", commercial.commercial_flags(F.col("flags"))).withColumn("approval_status", commercial.approval_status(terms)).withColumn("flagged", F.size("flags") > 0)


@dataclass(frozen=True)
class Priced:
    """What a run over bills makes. Lines, cases and the sums of sections are stored, and a result is a line with its case: no table holds the lines' results once more. `whole` has all lines, priceable or not,
    with their results, and their own prices as old_rate and old_amount; `tables` has B01 to B08."""

    lines: DataFrame
    maps: DataFrame
    whole: DataFrame
    results: DataFrame
    sections: DataFrame
    quotes: DataFrame
    counters: DataFrame
    terms: Terms
    tables: dict[str, DataFrame]


#: The names of a line's own prices beside those of its result.
OLD = {"rate": "old_rate", "amount": "old_amount"}


def price_bills(cells: DataFrame, merged: DataFrame, db: Database, region: str | DataFrame, given: dict[str, str] | None = None, weights: Weights = Weights(), apply: bool = True, overrides: dict[str, int] | None = None, **run: str) -> Priced:
    """Bills as grids (cells, merged: see grid.py) to their lines, prices, quotations and result tables.

    region: one for all bills, or a table (boq_id, region). Terms come from `given`, else the database's controls, else zero (VAT 16). overrides: columns by field that win over inferred ones.
    """
    terms = commercial.terms_of(db.controls, given)
    maps, found = grid.sheets(cells, merged, overrides)
    found = found.withColumn("region", F.lit(region)) if isinstance(region, str) else found.join(region.select("boq_id", "region"), "boq_id", "left").withColumn("region", F.coalesce("region", F.lit("")))
    columns = found.columns
    told = matching.heading_context(found).withColumnsRenamed(OLD).withColumn("priceable", F.coalesce(F.expr("NOT is_heading AND NOT is_summary_row"), F.lit(False)))
    whole = _cases(told, db, weights, terms, ["priceable"]).whole()
    lines, results = told.select(*(F.col(OLD.get(c, c)).alias(c) for c in columns)), whole.where("priceable").drop("priceable", *OLD.values())
    sums = stored(commercial.section_sums(results), "section-sums")
    sections, quotes = sums.where("subtotal IS NOT NULL").select("boq_id", "section", "subtotal"), commercial.totals_of(sums, terms)
    counters = results.groupBy("boq_id").agg(F.count("*").alias("processed"), F.count_if(F.col("decision") == "matched").alias("matched"), F.count_if("review_flag").alias("flagged"))
    notices = {n: sinks.notice_table(t) for n, t in (("assumptions", db.assumptions), ("exclusions", db.exclusions)) if t is not None}
    tables = {
        "priced_bill": sinks.whole_bill(whole, columns, maps, apply), "suggestions": sinks.suggestions(results), "summary": sinks.summary_rows(quotes, sections, terms), **notices, "basis_of_rates": sinks.basis_of_rates(results),
        "commercial_review": sinks.commercial_review(results), "audit": sinks.audit_json(results, run or None), "audit_heads": sinks.audit_heads(quotes, sections, terms, **run), "unmatched": sinks.unmatched(results),
    }
    return Priced(lines, maps, whole, results, sections, quotes, counters, terms, tables)


#: The columns of a bill file: a cell a row.
CELLS = "sheet_name string, row int, col int, value string"


def price_folder(spark: SparkSession, folder: str, db: Database, region: str | DataFrame, given: dict[str, str] | None = None, weights: Weights = Weights(), apply: bool = True, bill: str | None = r"([^/]+)\.parquet$") -> Priced:
    """All bill files of a folder (A16; cells as CELLS says) in one job. A bill is named by its file, or by what `bill` finds in the path; with bill None the files have boq_id
    themselves, and may hold many bills. Merged ranges are taken as filled already."""
    cells = bill_files(spark, folder, CELLS, bill) if bill else bill_files(spark, folder).select("boq_id", "sheet_name", "row", "col", "value")
    none = spark.createDataFrame([], f"boq_id {dict(cells.dtypes)['boq_id']}, sheet_name string, min_row int, max_row int, min_col int, max_col int, anchor string")
    return price_bills(cells, none, db, region, given, weights, apply, folder=folder)


def quote_by_code(lines: DataFrame, library: DataFrame, adjustments: DataFrame, terms: Terms = Terms()) -> DataFrame:
    """Bills whose lines carry item codes: equi join with the active library, regional rates, quotation totals. lines: boq_id, item_code, quantity, region, approved."""
    items = library.where("active").select("item_code", "section", "rate", "basis")
    joined = lines.join(items, "item_code", "left").withColumn("section", F.coalesce("section", F.lit("")))
    priced = commercial.regional_rates(joined, adjustments)
    judged = priced.withColumn("decision", F.when(F.col("rate").isNull(), F.lit("unmatched")).otherwise(F.lit("matched")))
    judged = judged.withColumn("review_flag", F.col("rate").isNull() | ~F.col("approved")).withColumn("flagged", F.coalesce("basis", F.lit("")) == "")
    return commercial.quotation_totals(judged, terms)
