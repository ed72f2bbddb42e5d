"""Regional factors, flags and quotation totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


@dataclass(frozen=True)
class Terms:
    """Markups in percent of the subtotal; VAT on the total before it. D14: a parameter wins over a control, a control over the default."""

    overhead: str = "8"
    profit: str = "5"
    risk: str = "3"
    vat: str = "16"
    default_status: str = "Pending Commercial Review"
    currency: str = "KES"

    @staticmethod
    def resolve(given: dict[str, str], controls: dict[str, str]) -> Terms:
        def number(name: str, default: str) -> str:
            if given.get(name) is not None:
                return given[name]
            try:
                return str(float(controls[name].strip()))
            except (KeyError, ValueError):
                return default

        # a percent that is given wins as it is; blank texts of controls are no numbers
        status = given.get("default_approval_status") or controls.get("default_approval_status") or "Pending Commercial Review"
        return Terms(number("overheads_pct", "0"), number("profit_pct", "0"), number("risk_pct", "0"), number("vat_pct", "16"), status)


def terms_of(controls: DataFrame | None, given: dict[str, str] | None = None) -> Terms:
    """The terms of a run from its controls table (key, value; one row a key, as A06 leaves it) and what is given, which wins."""
    names = ["overheads_pct", "profit_pct", "risk_pct", "vat_pct", "default_approval_status"]
    held = {r.key: r.value or "" for r in controls.where(F.col("key").isin(names)).limit(len(names)).collect()} if controls is not None else {}
    return Terms.resolve(given or {}, held)


def regional_factors(lines: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Adds regional_factor and factor_notes: the first active adjustment for region and section (case ignored), else for the region with section
    blank or *, else 1. The adjustments are one row a region and section, so Spark broadcasts them or not by their size."""
    live = adjustments.where("active").select(F.lower("region").alias("__region"), F.lower(F.trim("section")).alias("__section"), "ordinal", F.col("factor").cast("decimal(9,4)").alias("factor"), "notes")
    pick = lambda kind: F.min_by(F.struct("factor", "notes"), "ordinal").alias(kind)
    exact = live.groupBy("__region", "__section").agg(pick("exact"))
    wild = live.where("__section IN ('', '*')").groupBy("__region").agg(pick("wild"))
    keyed = lines.withColumn("__region", F.lower("region")).withColumn("__section", F.lower("section"))
    joined = keyed.join(exact, ["__region", "__section"], "left").join(wild, "__region", "left")
    best = F.coalesce("exact", "wild")
    return joined.withColumn("regional_factor", F.coalesce(best["factor"], F.lit(1).cast("decimal(9,4)"))).withColumn("factor_notes", F.coalesce(best["notes"], F.lit(""))).drop("__region", "__section", "exact", "wild")


def regional_rates(lines: DataFrame, adjustments: DataFrame) -> DataFrame:
    """base_rate kept, rate times factor to two places half up."""
    priced = regional_factors(lines, adjustments).withColumn("base_rate", F.col("rate").cast(MONEY))
    return priced.withColumn("rate", F.round(F.col("base_rate") * F.col("regional_factor"), 2).cast(MONEY))


def commercial_flags(flags: Column) -> Column:
    """Adds the commercial flags to `flags` (array of strings), blanks dropped, first occurrences kept (C27). Needs basis, alternates, review_flag, built_up."""
    when = lambda test, text: F.when(test, F.lit(text)).otherwise(F.lit(""))
    more = F.array(
        when(F.coalesce("basis", F.lit("")) == "", "Missing basis of rate"),
        when(F.size("alternates") > 0, "Alternate rate options available"),
        when(F.col("review_flag"), "Confidence below strong threshold"),
        when(F.col("built_up"), "Build-up fallback used"),
    )
    return F.array_distinct(F.filter(F.concat(flags, more), lambda x: x != ""))


def approval_status(terms: Terms) -> Column:
    """C28."""
    return F.when((F.col("decision") == "matched") & ~F.col("review_flag"), F.lit("Approved for Pricing")).otherwise(F.lit(terms.default_status))


def section_totals(results: DataFrame) -> DataFrame:
    """of matched lines with a rate, quantity (null: 0) times rate by bill and section, rounded. Bills are many, so the sums are partial before the one shuffle."""
    amount = F.coalesce(F.col("quantity"), F.lit(0)).cast("decimal(18,4)") * F.col("rate")
    live = results.where("decision = 'matched' AND rate IS NOT NULL")
    return live.groupBy("boq_id", "section").agg(F.round(F.sum(amount), 2).cast(MONEY).alias("subtotal"))


def section_sums(results: DataFrame) -> DataFrame:
    """One row a bill and section, with all that section_totals and quotation_totals say of it: subtotal (null where no line is matched with a rate), matched, flags, n.

    A matched, rated line counts once if its review_flag or `flagged` is set; another line only for review_flag.
    """
    rated = F.expr("decision = 'matched' AND rate IS NOT NULL")
    flag = F.when(rated, F.col("review_flag") | F.col("flagged")).otherwise(F.col("review_flag"))
    amount = F.when(rated, F.coalesce(F.col("quantity"), F.lit(0)).cast("decimal(18,4)") * F.col("rate"))
    return results.groupBy("boq_id", "section").agg(F.round(F.sum(amount), 2).cast(MONEY).alias("subtotal"), F.sum(rated.cast("long")).alias("matched"), F.sum(flag.cast("long")).alias("flags"), F.count("*").alias("n"))


def quotation_totals(results: DataFrame, terms: Terms = Terms()) -> DataFrame:
    """one row a bill. Each markup is on the subtotal of rounded sections and rounded itself; VAT on the total before it. Ready: no flags and a positive subtotal."""
    return totals_of(section_sums(results), terms)


def totals_of(sections: DataFrame, terms: Terms = Terms()) -> DataFrame:
    """quotation_totals from section_sums."""
    bills = sections.groupBy("boq_id").agg(F.coalesce(F.sum("subtotal"), F.lit(0)).cast(MONEY).alias("subtotal"), F.sum("matched").alias("matched_items"), F.sum("flags").alias("flagged_items"), F.sum("n").alias("processed_items"))
    part = lambda x, pct: F.round(F.col(x) * F.lit(pct).cast("decimal(9,4)") * F.lit("0.01").cast("decimal(3,2)"), 2).cast(MONEY)
    out = bills.withColumns({"overhead_amount": part("subtotal", terms.overhead), "profit_amount": part("subtotal", terms.profit), "risk_amount": part("subtotal", terms.risk)})
    out = out.withColumn("pre_vat_total", F.expr("subtotal + overhead_amount + profit_amount + risk_amount").cast(MONEY))
    out = out.withColumn("vat_amount", part("pre_vat_total", terms.vat)).withColumn("grand_total", F.expr("pre_vat_total + vat_amount").cast(MONEY))
    ready = F.expr("flagged_items = 0 AND subtotal > 0")
    return out.withColumn("bid_ready", ready).withColumn("bid_ready_reason", F.when(ready, F.lit("Ready for issue")).otherwise(F.lit("Human review required before issue"))).withColumn("currency", F.lit(terms.currency))
