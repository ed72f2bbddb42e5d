"""Promotion of reviewed candidates to the live tables (D16, E16, E17, F11, J05's and J06's log, B14, B15).

What a promotion makes are tables: rows to append to the aliases and the rate library, candidates with their new status, log rows, training texts and counters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantra.functions.text import normalize_region, normalize_text, normalize_unit, safe_number, text
from quantra.operators.library import APPROVED, LIBRARY_COLUMNS, MONEY, PROMOTION_COLUMNS, REJECTED, candidate_defaults, log_rows
from quantra.operators.store import stored

#: Columns of the aliases table, and what stands where a promoted row says nothing.
ALIAS_COLUMNS = ["alias", "canonical_term", "section_bias", "notes"]
BLANKS = {"currency": "KES", "source": "Reviewed Match", "source_sheet": "Candidate Review", "basis": "Estimator-reviewed promotion"}
KEY = ["target", "k1", "k2", "k3"]


@dataclass(frozen=True)
class Promotion:
    """looked: each candidate that was up for promotion with its target, promotion_status and whether it was promoted; aliases and library: rows to append, by candidate_row_number."""

    looked: DataFrame
    aliases: DataFrame
    library: DataFrame
    candidates: DataFrame
    log: DataFrame
    training: DataFrame
    summary: DataFrame


def _get(rows: DataFrame):
    """The first of these columns that is there and not blank, as text."""

    def get(*names: str, default: str = "") -> Column:
        return F.coalesce(*(F.nullif(text(c), F.lit("")) for c in names if c in rows.columns), F.lit(default))

    return get


def _number(rows: DataFrame, *names: str, kind: str = "double") -> Column:
    """The first of these columns that is a number other than zero, else zero."""
    zero = F.lit(0).cast(kind)
    return F.coalesce(*(F.nullif(safe_number(c, kind), zero) for c in names if c in rows.columns), zero)


def promotable(candidates: DataFrame) -> DataFrame:
    """Approved candidates not promoted before, with target (lower case), term, its key in the target table (k1 to k3) and `named`: whether they have what the target needs."""
    base = candidate_defaults(candidates)
    status, before = F.lower(F.trim("reviewer_status")), F.lower(F.trim(text("promotion_status")))
    rows = base.where(status.isin(APPROVED) & ~before.isin("promoted", "retained_in_candidates")).withColumn("target", F.lower(F.trim("promote_target")))
    get = _get(rows)
    term = F.when(F.col("target") == "aliases", F.trim(get("approved_canonical_term", "approved_description", "description"))).otherwise(F.trim(get("approved_description", "description")))
    rows = rows.withColumns({"term": term, "alias": F.trim(get("description")), "code": F.trim(get("approved_item_code", "item_code"))})
    is_alias, is_rate, number = F.col("target") == "aliases", F.col("target") == "ratelibrary", F.col("candidate_row_number").cast("string")
    return rows.withColumns(
        {
            "k1": F.when(is_alias, F.lower("alias")).when(is_rate, F.col("code")).otherwise(number),
            "k2": F.when(is_alias, F.lower("term")).when(is_rate, normalize_text("term")).otherwise(F.lit("")),
            "k3": F.when(is_rate, normalize_unit(get("unit"))).otherwise(F.lit("")),
            "named": F.when(is_alias, (F.col("alias") != "") & (F.col("term") != "")).when(is_rate, F.col("term") != "").otherwise(F.lit(True)),
        }
    )


def existing_keys(aliases: DataFrame, library: DataFrame) -> DataFrame:
    """The keys that the target tables have."""
    low = lambda c: F.lower(F.trim(text(c))).alias(c)
    pairs = aliases.select(F.lit("aliases").alias("target"), low("alias").alias("k1"), low("canonical_term").alias("k2"), F.lit("").alias("k3"))
    words = normalize_text(_get(library)("normalized_description", "description"))
    rates = library.select(F.lit("ratelibrary").alias("target"), F.trim(text("item_code")).alias("k1"), words.alias("k2"), normalize_unit("unit").alias("k3"))
    return pairs.unionByName(rates).distinct().withColumn("there", F.lit(True))


def promote(candidates: DataFrame, aliases: DataFrame, library: DataFrame, as_of: str, file: str = "") -> Promotion:
    """Approved candidates into the table they name. Of several with one key the first row is promoted; a key that its table has, or a row without a term, counts as existing.

    A target other than aliases and the rate library leaves the row where it is: retained_in_candidates if it names the candidates themselves, else promoted, as any handled row.
    The first of a key is a grouped minimum joined back, so rows that share a key never meet in one task.
    """
    rows = promotable(candidates)
    first = rows.where("named").groupBy(*KEY).agg(F.min("candidate_row_number").alias("first"))
    joined = rows.join(first, KEY, "left").join(existing_keys(aliases, library), KEY, "left")
    new = F.col("named") & F.col("there").isNull() & (F.col("first") == F.col("candidate_row_number"))
    listed = F.col("target").isin("aliases", "ratelibrary")
    status = F.when(F.col("target") == "candidatematches", F.lit("retained_in_candidates")).when(~listed | new, F.lit("promoted")).otherwise(F.lit("already_exists"))
    joined = stored(joined.withColumn("promoted", F.coalesce(~listed | new, F.lit(False))).withColumn("promotion_status", status).drop("first", "there"), "promotion")
    get = _get(joined)
    note = lambda x: get("reviewer_note", default=x)
    live = joined.where("promoted")
    alias_rows = live.where("target = 'aliases'").select("candidate_row_number", "alias", F.col("term").alias("canonical_term"), get("approved_section_bias", "section").alias("section_bias"), note("Promoted from review").alias("notes"))
    made = {
        "item_code": F.col("code"), "description": F.col("term"), "normalized_description": F.col("k2"), "unit": F.col("k3"), "rate": _number(joined, "approved_rate", "rate", kind=MONEY), "region": normalize_region(get("region")),
        "confidence_hint": _number(joined, "confidence_override", "confidence_hint"), "notes": note(""), "active": F.lit(True), **{c: get(c, default=x) for c, x in BLANKS.items()},
    }
    rate_rows = live.where("target = 'ratelibrary'").select("candidate_row_number", *((made[c] if c in made else get(c)).alias(c) for c in LIBRARY_COLUMNS))
    looked = joined.select("candidate_row_number", "target", "promotion_status", "promoted")
    sheet = F.when(F.col("target") == "candidatematches", F.lit("CandidateMatches")).otherwise(F.col("target"))
    log = log_rows(
        joined, as_of, file, sheet_name=sheet, row_number=F.col("candidate_row_number").cast("long"), boq_description=get("description"), decision=F.concat(F.lit("promoted-to-"), "target"), matched_item_code=get("approved_item_code", "matched_item_code"),
        matched_description=get("approved_description", "description"), confidence_score=_number(joined, "confidence_override", "confidence_hint"), reviewer_note=note("Promoted approved review"),
    )
    texts = joined.withColumn("timestamp", F.lit(as_of)).withColumn("promote_target", F.col("target"))
    training = texts.select("candidate_row_number", F.to_json(F.struct(*((F.col(c) if c in texts.columns else F.lit("")).alias(c) for c in PROMOTION_COLUMNS)), {"ignoreNullFields": "false"}).alias("json"))
    skipped = ~F.col("promoted") & (F.col("target") != "candidatematches")
    summary = joined.agg(F.count_if("promoted").alias("promoted"), F.count_if(skipped).alias("skipped_duplicates"), F.count("*").alias("training_records"))
    return Promotion(looked, alias_rows, rate_rows, updated(candidates, looked, as_of), log, training, summary)


def updated(candidates: DataFrame, looked: DataFrame, as_of: str) -> DataFrame:
    """The candidates with promotion_status and promoted_at of those that were looked at."""
    base = candidate_defaults(candidates)
    new = looked.select("candidate_row_number", F.col("promotion_status").alias("__status"))
    at = F.when(F.col("__status").isNotNull(), F.lit(as_of)).otherwise(text("promoted_at") if "promoted_at" in base.columns else F.lit(""))
    return base.join(new, "candidate_row_number", "left").withColumn("promotion_status", F.coalesce("__status", "promotion_status")).withColumn("promoted_at", at).drop("__status")


def reviewed(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decisions that count, each with its candidate: those that are not pending and name a candidate."""
    given = decisions.where(~F.lower(F.trim(text("reviewer_status"))).isin("", "pending"))
    own = [c for c in ("description", "matched_item_code", "confidence_hint") if c in candidates.columns]
    return given.join(candidates.select("candidate_row_number", *(F.col(c).alias(f"own_{c}") for c in own)), "candidate_row_number")


def review_log(candidates: DataFrame, decisions: DataFrame, file: str = "") -> DataFrame:
    """A log row of 10 columns for each decision that counts, later ones of a candidate too; what is not approved is logged as rejected. The time is the decision's own."""
    rows = reviewed(candidates, decisions)
    get = _get(rows)
    label = F.when(F.lower(F.trim("reviewer_status")).isin(APPROVED), F.lit("review-approved")).otherwise(F.lit("review-rejected"))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss") if dict(rows.dtypes)["ts"].startswith("timestamp") else text("ts")
    out = rows.withColumn("__time", time)
    logged = log_rows(
        out, "", file, sheet_name=F.lit("CandidateMatches"), row_number=F.col("candidate_row_number").cast("long"), boq_description=get("own_description"), decision=label, matched_item_code=get("own_matched_item_code"), matched_description=F.coalesce(F.nullif(F.trim(get("approved_description")), F.lit("")), get("own_description")),
        confidence_score=_number(rows, "confidence_override", "own_confidence_hint"), reviewer_note=F.coalesce(F.nullif(F.trim(get("reviewer_note")), F.lit("")), F.trim(get("review_decision", default="hold"))), timestamp=F.col("__time"),
    )
    return logged


def merge_summary(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """one row with the decisions that were merged: rejected, and reviewed (all others)."""
    no = F.lower(F.trim("reviewer_status")).isin(REJECTED)
    return reviewed(candidates, decisions).agg(F.count_if(~no).alias("reviewed"), F.count_if(no).alias("rejected"))
