"""Rate library maintenance: import, deduplicate, review, merge (D03, D05-D08, D16, E14, E15, E18, F11, G09, J01-J05, J07, M03, M05-M07, M09); promotion.py promotes.

Tables carry `ordinal`, their row order, which the semantics need. Keys of a row: its code, and (normalized description, unit); a blank
part makes no key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantra.functions.text import active, normalize_region, normalize_text, normalize_unit, plain_normalized, safe_number, text
from quantra.operators.store import checkpointed

# Source column names by field, in order of preference.
SOURCE_NAMES = {
    "item_code": ["item_code", "code", "item", "rate_code"],
    "input_code": ["input_code", "code", "item_code", "resource_code"],
    "description": ["description", "item_description", "particulars", "resource_description", "name"],
    "section": ["section", "trade", "bill_section", "category"],
    "subsection": ["subsection", "sub_section", "subtrade"],
    "unit": ["unit", "uom", "measure"],
    "rate": ["rate", "price", "unit_rate", "cost"],
    "currency": ["currency"],
    "region": ["region", "county", "location", "market"],
    "source": ["source", "manual", "library", "origin"],
    "source_sheet": ["source_sheet", "sheet", "sheet_name"],
    "source_page": ["source_page", "page", "page_no"],
    "basis": ["basis", "basis_of_rate"],
    "crew_type": ["crew_type", "labour_type"],
    "plant_type": ["plant_type", "equipment_type"],
    "material_type": ["material_type", "material_group"],
    "keywords": ["keywords", "tags"],
    "alias_group": ["alias_group"],
    "build_up_recipe_id": ["build_up_recipe_id", "recipe_id"],
    "confidence_hint": ["confidence_hint", "confidence"],
    "notes": ["notes", "remark", "remarks"],
    "active": ["active", "status"],
    "input_type": ["input_type", "resource_type", "type"],
}

# Columns of the tables that imports and reviews write.
LIBRARY_COLUMNS = [
    "item_code", "description", "normalized_description", "section", "subsection", "unit", "rate", "currency", "region", "source", "source_sheet", "source_page", "basis", "crew_type", "plant_type", "material_type", "keywords", "alias_group", "build_up_recipe_id",
    "confidence_hint", "notes", "active",
]
INPUT_COLUMNS = [
    "input_code", "input_type", "description", "unit", "rate", "region", "source", "active",
]
CANDIDATE_COLUMNS = [
    "timestamp", "import_batch_id", "source_file", "source_sheet", "target_sheet", "item_code", "description", "normalized_description", "section", "subsection", "unit", "rate", "currency", "region", "source", "source_page", "basis",
    "crew_type", "plant_type", "material_type", "keywords", "alias_group", "build_up_recipe_id", "confidence_hint", "notes", "active", "duplicate_reason", "matched_item_code", "reviewer_status", "reviewer_name", "reviewed_at",
    "review_decision", "promote_target", "approved_item_code", "approved_description", "approved_rate", "approved_canonical_term", "approved_section_bias", "confidence_override", "reviewer_note", "promotion_status", "promoted_at",
]
LOG_COLUMNS = [
    "timestamp", "boq_file", "sheet_name", "row_number", "boq_description", "decision", "matched_item_code", "matched_description", "confidence_score", "reviewer_note",
]
REVIEW_COLUMNS = [
    "candidate_row_number", "reviewer_status", "reviewer_name", "reviewed_at", "review_decision", "promote_target", "approved_item_code", "approved_description", "approved_rate", "approved_canonical_term", "approved_section_bias",
    "confidence_override", "reviewer_note", "source_file", "target_sheet", "item_code", "matched_item_code", "description", "section", "subsection", "unit", "rate", "currency", "region", "basis", "duplicate_reason", "promotion_status",
]
SNAPSHOT_COLUMNS = [
    "candidate_row_number", "reviewer_status", "reviewer_name", "reviewed_at", "review_decision", "promote_target", "description", "normalized_description", "unit", "rate", "region", "matched_item_code", "approved_item_code",
    "approved_description", "approved_canonical_term", "confidence_hint", "confidence_override", "reviewer_note",
]
PROMOTION_COLUMNS = [
    "timestamp", "candidate_row_number", "reviewer_status", "reviewer_name", "review_decision", "promote_target", "promotion_status", "description", "normalized_description", "unit", "rate", "approved_rate", "matched_item_code",
    "approved_item_code", "approved_description", "approved_canonical_term", "confidence_hint", "confidence_override", "reviewer_note",
]

# Target table, fields and their presets of the import kinds.
KINDS = {
    "rate-library": ("RateLibrary", {"section": "", "subsection": "", "region": "", "source": ""}),
    "materials": ("RateLibrary", {"section": "Materials", "material_type": "general", "region": "", "source": ""}),
    "labour": ("RateLibrary", {"section": "Dayworks", "crew_type": "labour", "region": "", "source": ""}),
    "plant": ("RateLibrary", {"section": "Dayworks", "plant_type": "plant", "region": "", "source": ""}),
    "buildup-inputs": ("BuildUpInputs", {"input_type": "", "region": "", "source": ""}),
}

APPROVED, REJECTED = ["approved", "merge", "approved_for_merge"], ["rejected", "reject"]
MERGEABLE = ["approved", "approve_append", "approve_update"]
MONEY = "decimal(18,2)"


def lookup(source: DataFrame, field: str, default: str = "") -> Column:
    """C14: the first non-blank of the source's columns for this field, else the default. Headers are compared as normalized texts; of those that are then equal the last counts."""
    headers = {plain_normalized(c): c for c in source.columns}
    names = [headers[k] for n in SOURCE_NAMES.get(field, [field]) if (k := plain_normalized(n)) in headers]
    return F.coalesce(*(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names), F.lit(default))


def _replaced(rows: DataFrame, overrides: dict[str, str] | None) -> DataFrame:
    """Non-blank overrides replace mapped values as they are. D07: then rows without description go."""
    for name, value in (overrides or {}).items():
        if value not in (None, "") and name in rows.columns:
            rows = rows.withColumn(name, F.lit(value).cast(rows.schema[name].dataType))
    return rows.where("description <> ''")


def to_library(source: DataFrame, source_file: str, overrides: dict[str, str] | None = None, source_sheet: str = "") -> DataFrame:
    """Source rows (with `ordinal`) as library rows of 22 columns; rows without description go."""
    get = lambda f, x="": F.trim(lookup(source, f, x))
    number = lambda f, kind: F.coalesce(safe_number(lookup(source, f), kind), F.lit(0).cast(kind)).alias(f)
    made = {
        "description": get("description"), "normalized_description": normalize_text(get("description")), "unit": normalize_unit(get("unit")), "region": normalize_region(get("region")), "currency": get("currency", "KES"),
        "source": get("source", source_file), "source_sheet": get("source_sheet", source_sheet), "basis": get("basis", "Imported source table"), "rate": number("rate", MONEY), "confidence_hint": number("confidence_hint", "double"),
        "active": active(lookup(source, "active")),
    }
    return _replaced(source.select("ordinal", *((made[c] if c in made else get(c)).alias(c) for c in LIBRARY_COLUMNS)), overrides)


def to_inputs(source: DataFrame, source_file: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """Source rows as build-up inputs of 8 columns."""
    get = lambda f, x="": F.trim(lookup(source, f, x))
    made = {"unit": normalize_unit(get("unit")), "rate": F.coalesce(safe_number(lookup(source, "rate"), MONEY), F.lit(0).cast(MONEY)), "region": normalize_region(get("region")), "source": get("source", source_file), "active": active(lookup(source, "active"))}
    return _replaced(source.select("ordinal", *((made[c] if c in made else get(c)).alias(c) for c in INPUT_COLUMNS)), overrides)


def keyed(rows: DataFrame) -> DataFrame:
    """Adds code_key and text_key; null where the row has no such key."""
    words = text("normalized_description") if "normalized_description" in rows.columns else normalize_text("description")
    both = F.struct(words.alias("d"), normalize_unit("unit").alias("u"))
    out = rows.withColumn("__both", both)
    code = "item_code" if "item_code" in rows.columns else "input_code"
    return out.withColumn("code_key", F.nullif(F.trim(text(code)), F.lit(""))).withColumn("text_key", F.when((F.col("__both.d") != "") & (F.col("__both.u") != ""), F.concat_ws("|", "__both.d", "__both.u"))).drop("__both")


#: Pieces of settled rows that are kept side by side before they become one table.
SETTLED = 64


def greedy_keep(rows: DataFrame) -> DataFrame:
    """(ordinal, kept): a row is a duplicate iff an earlier kept row has its code key or its text key; duplicates register no keys.

    rows: ordinal, code_key, text_key and optionally fixed (kept from the start). Each round keeps the open rows that are first among the open ones on both keys and drops
    open rows that share a key with a kept one, until none is open; every round is checkpointed. The first open row of all is always settled, so it ends; a chain of n rows
    that alternate in both keys takes about n / 2 rounds, as it is inherently sequential. Minima are grouped (partial sums before the shuffle) and joined back, so no key's rows meet in
    one task.
    """
    if "fixed" not in rows.columns:
        rows = rows.withColumn("fixed", F.lit(False))
    state = rows.select("ordinal", "code_key", "text_key", F.when(F.col("fixed"), F.lit(True)).alias("kept"))
    # keys of rows that are there from the start beat all others, wherever these stand
    for key in ("code_key", "text_key"):
        held = state.where(F.col("kept") & F.col(key).isNotNull()).select(key).distinct().withColumn("__held", F.lit(True))
        state = state.join(held, key, "left").withColumn("kept", F.when(F.col("kept").isNull() & F.col("__held"), F.lit(False)).otherwise(F.col("kept"))).drop("__held")
    state = checkpointed(state.select("ordinal", "code_key", "text_key", "kept"))
    done, open_rows = [state.where("kept IS NOT NULL").select("ordinal", "kept")], state.where("kept IS NULL").drop("kept")
    while not open_rows.isEmpty():
        marked = open_rows
        for key, name in (("code_key", "c"), ("text_key", "t")):
            least = open_rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("ordinal").alias(f"__{name}"))
            marked = marked.join(least, key, "left")
        first = lambda name: F.coalesce(F.col(f"__{name}") == F.col("ordinal"), F.lit(True))
        marked = checkpointed(marked.select("ordinal", "code_key", "text_key", (first("c") & first("t")).alias("kept")))
        kept = marked.where("kept")
        judged = marked.where("NOT kept")
        for key, name in (("code_key", "c"), ("text_key", "t")):
            by = kept.where(F.col(key).isNotNull()).select(key, F.col("ordinal").alias(f"__{name}"))
            judged = judged.join(by, key, "left")
        beaten = F.coalesce(F.col("__c") < F.col("ordinal"), F.lit(False)) | F.coalesce(F.col("__t") < F.col("ordinal"), F.lit(False))
        judged = checkpointed(judged.select("ordinal", "code_key", "text_key", beaten.alias("beaten")))
        done += [kept.select("ordinal", "kept"), judged.where("beaten").select("ordinal", F.lit(False).alias("kept"))]
        if len(done) > SETTLED:  # rarely: what each round settles is written with the round, and once more here
            done = [checkpointed(reduce(DataFrame.unionByName, done))]
        open_rows = judged.where("NOT beaten").drop("beaten")
    return reduce(DataFrame.unionByName, done)


def route_import(existing: DataFrame, arriving: DataFrame, mapper: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each arriving row (ordinal order) with outcome (append, skip: a duplicate with the same rate, or candidate: another rate, over 0.001 apart or missing), duplicate_reason
    and matched_code: the row's own code, or the ordinal of the row it meets where it has none. Existing rows are there from the start, a key's last one counting;
    appended rows are there for later ones. The code decides before the text."""
    if mapper:
        arriving = mapper(arriving)
    old, new = keyed(existing), keyed(arriving)
    code = "item_code" if "item_code" in arriving.columns else "input_code"
    shift = F.lit(1 << 40)
    both = old.select((F.col("ordinal") - shift).alias("ordinal"), "code_key", "text_key", F.lit(True).alias("fixed")).unionByName(new.select("ordinal", "code_key", "text_key", F.lit(False).alias("fixed")))
    kept = greedy_keep(both).where("ordinal >= 0").select("ordinal", "kept")
    accepted = new.join(kept.where("kept").select("ordinal"), "ordinal", "left_semi")
    value = F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.col("rate").cast("double").alias("rate"))
    known = lambda k, name: old.where(F.col(k).isNotNull()).groupBy(k).agg(F.max_by(value, "ordinal").alias(f"old_{name}"))
    fresh = lambda k, name: accepted.where(F.col(k).isNotNull()).groupBy(k).agg(F.max_by(value, "ordinal").alias(f"new_{name}"))
    joined = new.join(kept, "ordinal")
    for k, name in (("code_key", "code"), ("text_key", "text")):
        joined = joined.join(known(k, name), k, "left").join(fresh(k, name), k, "left")
    earlier = lambda c: F.when(F.col(c)["ordinal"] < F.col("ordinal"), F.col(c))
    by_code, by_text = F.coalesce(earlier("new_code"), F.col("old_code")), F.coalesce(earlier("new_text"), F.col("old_text"))
    joined = joined.withColumn("__code", F.when(~F.col("kept"), by_code)).withColumn("__match", F.when(~F.col("kept"), F.coalesce("__code", by_text)))
    differs = F.coalesce(F.abs(F.col("__match.rate") - F.col("rate").cast("double")) > 0.001, F.lit(True))
    outcome = F.when(F.col("kept"), F.lit("append")).when(differs, F.lit("candidate")).otherwise(F.lit("skip"))
    reason = F.when(F.col("kept"), F.lit("")).when(F.col("__code").isNotNull(), F.lit(f"duplicate {code}")).otherwise(F.lit("duplicate normalized description + unit"))
    matched = F.when(~F.col("kept"), F.coalesce("code_key", F.col("__match.ordinal").cast("string")))
    return joined.withColumn("outcome", outcome).withColumn("duplicate_reason", reason).withColumn("matched_code", matched).select(*arriving.columns, "outcome", "duplicate_reason", "matched_code")


def batch_id(as_of: str) -> str:
    """Import- and the digits of an ISO time in seconds."""
    return f"import-{as_of.replace(':', '').replace('-', '')}"


def candidate_rows(routed: DataFrame, target: str, source_file: str, as_of: str, source_sheet: str = "") -> DataFrame:
    """The rows for review in the 42 columns of candidates."""
    named = {
        "timestamp": F.lit(as_of), "import_batch_id": F.lit(batch_id(as_of)), "source_file": F.lit(source_file), "source_sheet": F.lit(source_sheet), "target_sheet": F.lit(target), "matched_item_code": F.col("matched_code"),
        "normalized_description": normalize_text("description"), "unit": normalize_unit("unit"), "reviewer_status": F.lit("pending"), "review_decision": F.lit("hold"), "promote_target": F.lit("candidatematches"), "promotion_status": F.lit("not_promoted"),
    }
    if "item_code" not in routed.columns:
        named["item_code"] = F.col("input_code")
    if "confidence_hint" not in routed.columns:
        named["confidence_hint"] = F.lit(0.0)
    column = lambda c: named.get(c, F.col(c) if c in routed.columns else F.lit(""))
    return routed.where("outcome = 'candidate'").select("ordinal", *(column(c).alias(c) for c in CANDIDATE_COLUMNS))


def import_summary(source: DataFrame, routed: DataFrame, target: str, source_file: str) -> DataFrame:
    """one row with the counters of an import."""
    count = lambda x: F.count_if(F.col("outcome") == x)
    counts = routed.agg(count("append").alias("appended"), count("skip").alias("skipped_duplicates"), count("candidate").alias("candidates_created"), F.count("*").alias("mapped"))
    total = source.agg(F.count("*").alias("total_rows"))
    return total.crossJoin(counts).select(F.lit(target).alias("target_sheet"), F.lit(source_file).alias("source_file"), "total_rows", "appended", "skipped_duplicates", "candidates_created", (F.col("total_rows") - F.col("mapped")).alias("blank_descriptions"))  # one row each


def normalize_table(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with unit, region and normalized_description cleaned, and the number of changed unit and region cells."""
    new = rows.withColumn("__unit", normalize_unit("unit")).withColumn("__region", normalize_region("region"))
    changed = new.agg(F.sum((F.col("__unit") != F.col("unit")).cast("long")).alias("units_changed"), F.sum((F.col("__region") != F.col("region")).cast("long")).alias("regions_changed"))
    return new.withColumn("unit", F.col("__unit")).withColumn("region", F.col("__region")).withColumn("normalized_description", normalize_text("description")).drop("__unit", "__region"), changed


def deactivate_duplicates(rows: DataFrame) -> DataFrame:
    """Rows with active false for duplicates (by greedy_keep, whatever was active before); `duplicate` tells them, for the log."""
    kept = greedy_keep(keyed(rows))
    return rows.join(kept, "ordinal").withColumn("active", F.col("active") & F.col("kept")).withColumn("duplicate", ~F.col("kept")).drop("kept")


def log_rows(rows: DataFrame, as_of: str, file: str, **columns: Column) -> DataFrame:
    """Rows in the 10 columns of the review log; those not given are blank."""
    given = {"timestamp": F.lit(as_of), "boq_file": F.lit(file), "row_number": F.lit(None).cast("long"), "confidence_score": F.lit(0.0), **columns}
    return rows.select(*(given.get(c, F.lit("")).alias(c) for c in LOG_COLUMNS))


def duplicate_log(deactivated: DataFrame, as_of: str, file: str) -> DataFrame:
    """A log row of confidence 100 for each duplicate."""
    return log_rows(deactivated.where("duplicate"), as_of, file, sheet_name=F.lit("RateLibrary"), row_number=F.col("ordinal").cast("long"), boq_description=text("description"), decision=F.lit("duplicate-deactivated"), matched_item_code=text("item_code"), matched_description=text("description"), confidence_score=F.lit(100.0))


def candidate_defaults(candidates: DataFrame) -> DataFrame:
    """Blanks of the workflow columns by their defaults."""
    fixed = {"reviewer_status": "pending", "review_decision": "hold", "promote_target": "candidatematches", "promotion_status": "not_promoted"}
    return candidates.withColumns({k: F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(v)) if k in candidates.columns else F.lit(v) for k, v in fixed.items()})


def review_report(candidates: DataFrame) -> DataFrame:
    """Every candidate in the 27 columns of a review, with the workflow's defaults; columns that candidates lack are blank."""
    rows = candidate_defaults(candidates)
    return rows.select(*((F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in REVIEW_COLUMNS))


def review_snapshots(candidates: DataFrame) -> DataFrame:
    """One JSON text of 18 fields for each candidate whose status is not pending."""
    rows = candidate_defaults(candidates).where("lower(reviewer_status) <> 'pending'")
    return rows.select("candidate_row_number", F.to_json(F.struct(*((F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in SNAPSHOT_COLUMNS)), {"ignoreNullFields": "false"}).alias("json"))


def review_summary(candidates: DataFrame) -> DataFrame:
    """one row with the counters of a review (D16's sets)."""
    status = F.lower(F.trim("reviewer_status"))
    rows = candidate_defaults(candidates)
    return rows.agg(F.count("*").alias("report_rows"), F.count_if(status.isin(APPROVED)).alias("reviewed"), F.count_if(status.isin(REJECTED)).alias("rejected"), F.count_if(status != "pending").alias("training_records"))


#: The fields of a candidate that a decision overwrites, with what stands where it says nothing.
DECIDED = {
    "reviewer_status": "pending", "reviewer_name": "", "reviewed_at": "", "review_decision": "hold", "promote_target": "candidatematches", "approved_item_code": "", "approved_description": "", "approved_rate": None, "approved_canonical_term": "", "approved_section_bias": "",
    "confidence_override": None, "reviewer_note": "",
}


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each candidate, by time and event, that is not pending."""
    live = decisions.where(~F.lower(F.trim(text("reviewer_status"))).isin("", "pending"))
    return live.groupBy("candidate_row_number").agg(F.max_by(F.struct(*(c for c in decisions.columns if c != "candidate_row_number")), F.struct("ts", "event_id")).alias("d"))


def merge_reviews(candidates: DataFrame, decisions: DataFrame, reviewer: str = "reviewer", settled: bool = False) -> DataFrame:
    """The last decision of each candidate overwrites its fields (those of DECIDED that decisions have, blanks too); log_label tells how it is logged (anything not approved is logged as rejected). settled: decisions
    have one row a candidate already."""
    base = candidate_defaults(candidates)
    last = decisions.select("candidate_row_number", F.struct(*(c for c in decisions.columns if c != "candidate_row_number")).alias("d")) if settled else last_decisions(decisions)
    joined = base.join(last, "candidate_row_number", "left")
    here, lower = F.col("d").isNotNull(), ("reviewer_status", "review_decision", "promote_target")

    def decided(name: str) -> Column:
        value = F.col(f"d.{name}")
        if DECIDED[name] is None:  # numbers, null where none is given
            return value
        value = F.coalesce(F.nullif(F.trim(text(value)), F.lit("")), F.lit(DECIDED[name]))
        return F.lower(value) if name in lower else value

    new = {c: F.when(here, decided(c)).otherwise(F.col(c) if c in base.columns else F.lit(None)) for c in DECIDED if c in decisions.columns}
    name = F.coalesce(F.nullif(F.trim(text("d.reviewer_name")), F.lit("")), F.lit(reviewer)) if "reviewer_name" in decisions.columns else F.lit(reviewer)
    new["reviewer_name"] = F.when(here, name)
    new["reviewed_at"] = F.when(here, F.coalesce(F.nullif(text("d.reviewed_at"), F.lit("")), text("d.ts")) if "reviewed_at" in decisions.columns else F.col("d.ts"))
    label = F.when(here, F.when(F.lower(F.trim("d.reviewer_status")).isin(APPROVED), F.lit("review-approved")).otherwise(F.lit("review-rejected")))
    return joined.withColumn("log_label", label).withColumns(new).drop("d")


def merge_candidates(candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(library rows, build-up input rows, candidates): approved candidates are appended to their target whatever is there, and their status becomes merged.
    An input's type is the first non-blank of material, plant and crew type and notes."""
    ready = F.lower(F.trim("reviewer_status")).isin(MERGEABLE)
    take = lambda c: F.col(c) if c in candidates.columns else F.lit("")
    target = F.coalesce(F.nullif(text("target_sheet"), F.lit("")), F.lit("RateLibrary")) if "target_sheet" in candidates.columns else F.lit("RateLibrary")
    live = candidates.where(ready).withColumn("__target", target)
    blank = lambda c: F.nullif(text(take(c)), F.lit(""))
    to_library_rows = live.where("__target = 'RateLibrary'").select("candidate_row_number", *(take(c).alias(c) for c in LIBRARY_COLUMNS))
    inputs = {"input_code": take("item_code"), "input_type": F.coalesce(blank("material_type"), blank("plant_type"), blank("crew_type"), text(take("notes")))}
    to_input_rows = live.where("__target <> 'RateLibrary'").select("candidate_row_number", *(inputs.get(c, take(c)).alias(c) for c in INPUT_COLUMNS))
    return to_library_rows, to_input_rows, candidates.withColumn("reviewer_status", F.when(ready, F.lit("merged")).otherwise(F.col("reviewer_status")))


def merge_log(candidates: DataFrame, as_of: str, file: str) -> DataFrame:
    """A log row for each candidate that `merge_candidates` appends."""
    ready = candidates.where(F.lower(F.trim("reviewer_status")).isin(MERGEABLE))
    get = lambda c: text(c) if c in candidates.columns else F.lit("")
    code = F.coalesce(F.nullif(get("matched_item_code"), F.lit("")), get("item_code"))
    hint = F.coalesce(F.col("confidence_hint").cast("double"), F.lit(0.0)) if "confidence_hint" in candidates.columns else F.lit(0.0)
    sheet = F.coalesce(F.nullif(get("target_sheet"), F.lit("")), F.lit("RateLibrary"))
    note = F.coalesce(F.nullif(get("reviewer_note"), F.lit("")), F.lit("Merged from CandidateMatches"))
    return log_rows(ready, as_of, file, sheet_name=sheet, row_number=F.col("candidate_row_number").cast("long"), boq_description=get("description"), decision=F.lit("candidate-merged"), matched_item_code=code, matched_description=get("description"), confidence_score=hint, reviewer_note=note)


def schema_gaps(expected: DataFrame, actual: DataFrame, optional: list[str]) -> DataFrame:
    """Expected and actual: (table_name, column_name). Missing required tables alone if there are any, with a null column; else missing columns by table."""
    tables = expected.select("table_name").distinct().join(actual.select("table_name").distinct(), "table_name", "left_anti").where(~F.col("table_name").isin(optional))
    columns = expected.join(actual, ["table_name", "column_name"], "left_anti").join(actual.select("table_name").distinct(), "table_name", "left_semi")
    any_table = tables.agg((F.count("*") > 0).alias("broken"))
    gaps = columns.groupBy("table_name").agg(F.array_sort(F.collect_list("column_name")).alias("missing"))
    return tables.select("table_name", F.lit(None).cast("array<string>").alias("missing")).unionByName(gaps.join(F.broadcast(any_table)).where("NOT broken").drop("broken"))
