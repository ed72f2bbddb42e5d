"""Registered queries of library maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantra.operators import library, promotion, store
from quantra.plans import imports
from quantra.plans.sql_pricing import sql_normalized, sql_unit
from quantra.sources import tables
from quantra.sources.fixtures import view, with_views

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


KEYS = f"nullif(trim(item_code), '') AS code_key, CASE WHEN {sql_normalized('description')} <> '' AND {sql_unit('unit')} <> '' THEN concat({sql_normalized('description')}, '|', {sql_unit('unit')}) END AS text_key"

# The rows in order, one recursion step each; the state is the list of keys that kept rows have.
REPLAY = """
s(n, codes, texts, ordinal, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST({codes} AS VARCHAR[]), CAST({texts} AS VARCHAR[]), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN)
  UNION ALL
  SELECT s.n + 1, CASE WHEN o.ok AND o.code_key IS NOT NULL THEN list_append(s.codes, o.code_key) ELSE s.codes END, CASE WHEN o.ok AND o.text_key IS NOT NULL THEN list_append(s.texts, o.text_key) ELSE s.texts END, o.ordinal, o.ok
  FROM s JOIN LATERAL (SELECT ordinal, code_key, text_key, NOT (coalesce(list_contains(s.codes, code_key), FALSE) OR coalesce(list_contains(s.texts, text_key), FALSE)) AS ok FROM k WHERE k.n = s.n + 1) o ON TRUE)"""


@query(f"WITH RECURSIVE {with_views('incoming')}, k AS MATERIALIZED (SELECT ordinal, row_number() OVER (ORDER BY ordinal) AS n, {KEYS} FROM incoming), {REPLAY.format(codes='[]', texts='[]')} SELECT ordinal, NOT kept AS duplicate FROM s WHERE n > 0")
def j03_g09_deactivate_duplicates(spark, sf) -> DataFrame:
    rows = view(spark, sf, "incoming").withColumn("active", F.lit(True))
    return library.deactivate_duplicates(rows).select("ordinal", "duplicate")


@query(
    f"""WITH RECURSIVE {with_views('existing', 'arriving')}, e AS (SELECT {KEYS} FROM existing), k AS MATERIALIZED (SELECT ordinal, row_number() OVER (ORDER BY ordinal) AS n, {KEYS} FROM arriving),
{REPLAY.format(codes="(SELECT list(code_key) FROM e WHERE code_key IS NOT NULL)", texts="(SELECT list(text_key) FROM e WHERE text_key IS NOT NULL)")} SELECT ordinal, kept AS appended FROM s WHERE n > 0"""
)
def j01_import_appended(spark, sf) -> DataFrame:
    got = library.route_import(view(spark, sf, "existing"), view(spark, sf, "arriving"))
    return got.select("ordinal", (F.col("outcome") == "append").alias("appended"))


REGION_SQL = "array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"

# The rows of `offers` as they are mapped, in order, each with its outcome.
IMPORT_SQL = f"""WITH RECURSIVE {with_views('existing', 'offers')}, e AS (SELECT ordinal, rate, {KEYS} FROM existing),
mp AS MATERIALIZED (SELECT ordinal, trim(Rate_Code) AS item_code, Particulars AS description, {sql_unit('UOM')} AS unit, CAST(coalesce(TRY_CAST(Unit_Rate AS DECIMAL(18,2)), 0) AS DECIMAL(18,2)) AS rate, {REGION_SQL.format(x='County')} AS region, Status IN ('', 'yes') AS active,
  Page_No AS source_page, labour_type AS crew_type, Tags AS keywords FROM offers WHERE Particulars <> ''),
k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ordinal) AS n, {KEYS} FROM mp),
{REPLAY.format(codes="(SELECT list(code_key) FROM e WHERE code_key IS NOT NULL)", texts="(SELECT list(text_key) FROM e WHERE text_key IS NOT NULL)")},
o AS MATERIALIZED (SELECT k.*, s.kept FROM k JOIN s ON s.n = k.n),
reg AS (SELECT code_key, text_key, ordinal, rate, 0 AS src FROM e UNION ALL SELECT code_key, text_key, ordinal, rate, 1 FROM o WHERE kept),
cm AS (SELECT o.ordinal, arg_max(r.ordinal, r.src * 1000000000000 + r.ordinal) AS m_ordinal, arg_max(CAST(r.rate AS DOUBLE), r.src * 1000000000000 + r.ordinal) AS m_rate FROM o JOIN reg r ON r.code_key = o.code_key AND (r.src = 0 OR r.ordinal < o.ordinal) WHERE NOT o.kept GROUP BY o.ordinal),
tm AS (SELECT o.ordinal, arg_max(r.ordinal, r.src * 1000000000000 + r.ordinal) AS m_ordinal, arg_max(CAST(r.rate AS DOUBLE), r.src * 1000000000000 + r.ordinal) AS m_rate FROM o JOIN reg r ON r.text_key = o.text_key AND (r.src = 0 OR r.ordinal < o.ordinal) WHERE NOT o.kept GROUP BY o.ordinal),
z AS MATERIALIZED (SELECT o.*, CASE WHEN kept THEN 'append' WHEN abs(CASE WHEN cm.m_ordinal IS NOT NULL THEN cm.m_rate ELSE tm.m_rate END - CAST(o.rate AS DOUBLE)) > 0.001 THEN 'candidate' ELSE 'skip' END AS outcome,
  CASE WHEN kept THEN '' WHEN cm.m_ordinal IS NOT NULL THEN 'duplicate item_code' ELSE 'duplicate normalized description + unit' END AS duplicate_reason,
  CASE WHEN NOT kept THEN coalesce(code_key, CAST(tm.m_ordinal AS VARCHAR)) END AS matched_code FROM o LEFT JOIN cm ON cm.ordinal = o.ordinal LEFT JOIN tm ON tm.ordinal = o.ordinal)"""
AS_OF, OFFER = "2026-01-02T03:04:05", "offers.csv"


def _import(spark, sf) -> imports.Imported:
    return imports.import_rates(view(spark, sf, "offers"), view(spark, sf, "existing"), "labour", AS_OF, OFFER, source="Supplier")


@query(IMPORT_SQL + " SELECT ordinal, item_code, outcome, duplicate_reason, matched_code FROM z")
def m05_j01_e14_import_outcomes(spark, sf) -> DataFrame:
    return _import(spark, sf).routed.select("ordinal", "item_code", "outcome", "duplicate_reason", "matched_code")


APPENDED_SQL = f"""item_code, description, {sql_normalized('description')} AS normalized_description, 'Dayworks' AS section, '' AS subsection, unit, rate, 'KES' AS currency, region, 'Supplier' AS source, '' AS source_sheet, source_page, 'Imported source table' AS basis, {{crew}} AS crew_type,
  '' AS plant_type, '' AS material_type, keywords, '' AS alias_group, '' AS build_up_recipe_id, CAST(0 AS DOUBLE) AS confidence_hint, '' AS notes, active"""


@query(IMPORT_SQL + f" SELECT ordinal, {APPENDED_SQL.format(crew=chr(39) + 'labour' + chr(39))} FROM z WHERE outcome = 'append'")
def m05_d03_d08_import_appended(spark, sf) -> DataFrame:
    return _import(spark, sf).appended


@query(
    IMPORT_SQL
    + f""" SELECT ordinal, '{AS_OF}' AS "timestamp", 'import-20260102T030405' AS import_batch_id, '{OFFER}' AS source_file, 'RateLibrary' AS target_sheet, {APPENDED_SQL.format(crew=chr(39) + 'labour' + chr(39))}, duplicate_reason, matched_code AS matched_item_code, 'pending' AS reviewer_status,
  '' AS reviewer_name, '' AS reviewed_at, 'hold' AS review_decision, 'candidatematches' AS promote_target, '' AS approved_item_code, '' AS approved_description, '' AS approved_rate, '' AS approved_canonical_term, '' AS approved_section_bias, '' AS confidence_override,
  '' AS reviewer_note, 'not_promoted' AS promotion_status, '' AS promoted_at FROM z WHERE outcome = 'candidate'"""
)
def m05_b16_c30_import_candidates(spark, sf) -> DataFrame:
    return _import(spark, sf).candidates


@query(IMPORT_SQL + f" SELECT 'RateLibrary' AS target_sheet, '{OFFER}' AS source_file, (SELECT count(*) FROM offers) AS total_rows, count(*) FILTER (outcome = 'append') AS appended, count(*) FILTER (outcome = 'skip') AS skipped_duplicates, count(*) FILTER (outcome = 'candidate') AS candidates_created, (SELECT count(*) FROM offers) - count(*) AS blank_descriptions FROM z")
def f11_d07_import_summary(spark, sf) -> DataFrame:
    return _import(spark, sf).summary


@query(f"""
WITH {with_views('offers')} SELECT row_number() OVER (ORDER BY ordinal) AS place, trim(Rate_Code) AS item_code, Particulars AS description, region FROM (SELECT *, {REGION_SQL.format(x='County')} AS region FROM offers) WHERE Particulars <> ''""")
def a10_d03_import_from_csv(spark, sf) -> DataFrame:
    """The source as a CSV file with a header, in its order."""
    path = f"{store.shared_folder(spark)}/offers-{uuid.uuid4().hex}"
    view(spark, sf, "offers").orderBy("ordinal").drop("ordinal").coalesce(1).write.option("header", True).option("emptyValue", "").csv(path)  # one CSV file, as a user has it
    rows = library.to_library(tables.structured(spark, path), "offers.csv")
    return rows.select(F.row_number().over(Window.orderBy("ordinal")).cast("long").alias("place"), "item_code", "description", "region")


@query(f"""
WITH {with_views('offers')}, r AS (SELECT ordinal, trim(Rate_Code) AS input_code, Particulars AS description, {sql_unit('UOM')} AS unit, CAST(coalesce(TRY_CAST(Unit_Rate AS DECIMAL(18,2)), 0) AS DECIMAL(18,2)) AS rate, Status IN ('', 'yes') AS active FROM offers WHERE Particulars <> '')
SELECT ordinal, input_code, 'material' AS input_type, description, unit, rate, 'Coast' AS region, '{OFFER}' AS source, active FROM r""")
def d05_d06_build_up_inputs(spark, sf) -> DataFrame:
    offers = view(spark, sf, "offers").withColumnRenamed("Rate_Code", "Resource Code")
    return library.to_inputs(offers, OFFER, {**library.KINDS["buildup-inputs"][1], "input_type": "material", "region": "Coast"})


@query(f"""
WITH {with_views('incoming')} SELECT p_partkey AS ordinal, concat('I', CAST(p_partkey AS VARCHAR)) AS item_code, p_name AS description, {sql_normalized('p_name')} AS normalized_description, p_brand AS section, CASE WHEN p_partkey % 2 = 0 THEN 'm2' ELSE 'nr' END AS unit,
  CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_retailprice END AS DECIMAL(18,2)) AS rate, 'Nyanza' AS region, 'prices.csv' AS source, p_partkey % 3 <> 0 AS active FROM part""")
def d03_c14_map_source_rows(spark, sf) -> DataFrame:
    part = view(spark, sf, "part")
    source = part.select(F.col("p_partkey").alias("ordinal"), F.expr("concat('I', p_partkey)").alias("Rate Code"), F.col("p_name").alias("Particulars"), F.col("p_brand").alias("Trade"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'SQM' ELSE 'Nos' END").alias("UOM"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'call' ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) END").alias("Price"), F.lit("Kisumu").alias("County"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'no' WHEN 1 THEN '' ELSE 'yes' END").alias("Status"))
    return library.to_library(source, "prices.csv").select("ordinal", "item_code", "description", "normalized_description", "section", "unit", "rate", "region", "source", "active")


@query(f"WITH {with_views('incoming')} SELECT CAST(sum(CASE WHEN {sql_unit('unit')} <> unit THEN 1 ELSE 0 END) AS BIGINT) AS units_changed, CAST(sum(CASE WHEN {REGION_SQL.format(x='region')} <> region THEN 1 ELSE 0 END) AS BIGINT) AS regions_changed FROM incoming")
def j02_m06_cells_changed(spark, sf) -> DataFrame:
    return library.normalize_table(view(spark, sf, "incoming"))[1]


@query(f"WITH {with_views('incoming')} SELECT ordinal, item_code, {sql_unit('unit')} AS unit, {REGION_SQL.format(x='region')} AS region, {sql_normalized('description')} AS normalized_description FROM incoming")
def m06_normalize_table(spark, sf) -> DataFrame:
    return library.normalize_table(view(spark, sf, "incoming"))[0].select("ordinal", "item_code", "unit", "region", "normalized_description")


@query(
    f"""WITH RECURSIVE {with_views('incoming')}, k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ordinal) AS n, {KEYS} FROM incoming), {REPLAY.format(codes='[]', texts='[]')}
SELECT '{AS_OF}' AS "timestamp", 'rates' AS boq_file, 'RateLibrary' AS sheet_name, k.ordinal AS row_number, k.description AS boq_description, 'duplicate-deactivated' AS decision, k.item_code AS matched_item_code, k.description AS matched_description, 100.0::DOUBLE AS confidence_score, '' AS reviewer_note
FROM s JOIN k ON k.n = s.n WHERE NOT s.kept"""
)
def b15_m07_duplicate_log(spark, sf) -> DataFrame:
    rows = view(spark, sf, "incoming").withColumn("active", F.lit(True))
    return library.duplicate_log(library.deactivate_duplicates(rows), AS_OF, "rates")


MERGE_SQL = f"""
WITH {with_views('candidates', 'decisions', 'known_aliases', 'known_rates')}, d AS (SELECT *, row_number() OVER (PARTITION BY candidate_row_number ORDER BY ts DESC, event_id DESC) AS n FROM decisions WHERE reviewer_status <> 'pending'),
m AS MATERIALIZED (SELECT c.candidate_row_number, c.section, c.target_sheet, c.material_type, c.plant_type, c.notes, c.item_code, c.description, c.unit, c.rate, coalesce(d.reviewer_status, 'pending') AS reviewer_status, d.approved_rate,
  CASE WHEN d.n IS NULL THEN CASE WHEN c.promote_target = '' THEN 'candidatematches' ELSE c.promote_target END WHEN d.promote_target = '' THEN 'candidatematches' ELSE lower(trim(d.promote_target)) END AS promote_target,
  d.approved_item_code, d.approved_description, d.approved_canonical_term, d.approved_section_bias, d.confidence_override, d.reviewer_note,
  CASE WHEN d.n IS NULL THEN NULL WHEN d.reviewer_status IN ('approved', 'merge', 'approved_for_merge') THEN 'review-approved' ELSE 'review-rejected' END AS log_label FROM candidates c LEFT JOIN d ON d.candidate_row_number = c.candidate_row_number AND d.n = 1)"""


DECIDED = "candidate_row_number, reviewer_status, promote_target, approved_item_code, approved_description, approved_canonical_term, approved_section_bias, confidence_override, reviewer_note, log_label"


@query(MERGE_SQL + f" SELECT {DECIDED}, approved_rate FROM m")
def j05_e15_merge_reviews(spark, sf) -> DataFrame:
    return _merged(spark, sf).select(*DECIDED.split(", "), F.col("approved_rate").cast("decimal(18,2)").alias("approved_rate"))


@query(
    MERGE_SQL
    + """ SELECT strftime(d.ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", 'rates' AS boq_file, 'CandidateMatches' AS sheet_name, d.candidate_row_number AS row_number, c.description AS boq_description, CASE WHEN d.reviewer_status IN ('approved', 'merge') THEN 'review-approved' ELSE 'review-rejected' END AS decision,
  '' AS matched_item_code, CASE WHEN d.approved_description <> '' THEN d.approved_description ELSE c.description END AS matched_description, coalesce(d.confidence_override, 0.0) AS confidence_score, CASE WHEN d.reviewer_note <> '' THEN d.reviewer_note ELSE 'hold' END AS reviewer_note
FROM d JOIN candidates c ON c.candidate_row_number = d.candidate_row_number"""
)
def j05_b15_review_log(spark, sf) -> DataFrame:
    return promotion.review_log(view(spark, sf, "candidates"), view(spark, sf, "decisions"), "rates")


@query(MERGE_SQL + " SELECT count(*) FILTER (d.reviewer_status <> 'rejected') AS reviewed, count(*) FILTER (d.reviewer_status = 'rejected') AS rejected FROM d JOIN candidates c ON c.candidate_row_number = d.candidate_row_number")
def f11_merge_summary(spark, sf) -> DataFrame:
    return promotion.merge_summary(view(spark, sf, "candidates"), view(spark, sf, "decisions"))


# Approved candidates with the term and key of their target, and what became of them.
PROMOTE_SQL = (
    MERGE_SQL
    + f""", r AS (SELECT *, CASE WHEN approved_description <> '' THEN approved_description ELSE description END AS said, CASE WHEN approved_item_code <> '' THEN approved_item_code ELSE item_code END AS code FROM m WHERE reviewer_status IN ('approved', 'merge', 'approved_for_merge')),
q AS (SELECT *, CASE WHEN promote_target = 'aliases' AND approved_canonical_term <> '' THEN approved_canonical_term ELSE said END AS term FROM r),
z AS (SELECT *, CASE promote_target WHEN 'aliases' THEN concat_ws('|', lower(description), lower(term)) WHEN 'ratelibrary' THEN concat_ws('|', code, {sql_normalized('term')}, {sql_unit('unit')}) ELSE CAST(candidate_row_number AS VARCHAR) END AS k FROM q),
e AS (SELECT 'aliases' AS t, concat_ws('|', lower(trim(alias)), lower(trim(canonical_term))) AS k FROM known_aliases UNION SELECT 'ratelibrary', concat_ws('|', item_code, {sql_normalized('description')}, {sql_unit('unit')}) FROM known_rates),
w AS MATERIALIZED (SELECT z.*, promote_target NOT IN ('aliases', 'ratelibrary') OR (e.k IS NULL AND row_number() OVER (PARTITION BY promote_target, z.k ORDER BY candidate_row_number) = 1) AS promoted FROM z LEFT JOIN e ON e.t = z.promote_target AND e.k = z.k),
p AS MATERIALIZED (SELECT *, CASE WHEN promote_target = 'candidatematches' THEN 'retained_in_candidates' WHEN promoted THEN 'promoted' ELSE 'already_exists' END AS promotion_status FROM w)"""
)


def _promotion(spark, sf) -> promotion.Promotion:
    return promotion.promote(_merged(spark, sf), view(spark, sf, "known_aliases"), view(spark, sf, "known_rates"), AS_OF, "rates")


@query(PROMOTE_SQL + " SELECT candidate_row_number, promote_target AS target, promotion_status, promoted FROM p")
def j06_e16_e17_promote(spark, sf) -> DataFrame:
    return _promotion(spark, sf).looked


@query(PROMOTE_SQL + " SELECT candidate_row_number, description AS alias, term AS canonical_term, CASE WHEN approved_section_bias <> '' THEN approved_section_bias ELSE section END AS section_bias, CASE WHEN reviewer_note <> '' THEN reviewer_note ELSE 'Promoted from review' END AS notes FROM p WHERE promoted AND promote_target = 'aliases'")
def e16_promoted_aliases(spark, sf) -> DataFrame:
    return _promotion(spark, sf).aliases


@query(
    PROMOTE_SQL
    + f""" SELECT candidate_row_number, code AS item_code, term AS description, {sql_normalized('term')} AS normalized_description, section, '' AS subsection, {sql_unit('unit')} AS unit, CAST(CASE WHEN approved_rate <> 0 THEN approved_rate ELSE rate END AS DECIMAL(18,2)) AS rate, 'KES' AS currency, '' AS region,
  'Reviewed Match' AS source, 'Candidate Review' AS source_sheet, '' AS source_page, 'Estimator-reviewed promotion' AS basis, '' AS crew_type, plant_type, material_type, '' AS keywords, '' AS alias_group, '' AS build_up_recipe_id, coalesce(confidence_override, 0.0) AS confidence_hint, reviewer_note AS notes, TRUE AS active
FROM p WHERE promoted AND promote_target = 'ratelibrary'"""
)
def e17_promoted_rates(spark, sf) -> DataFrame:
    return _promotion(spark, sf).library


@query(PROMOTE_SQL + f" SELECT m.candidate_row_number, m.reviewer_status, m.promote_target, coalesce(p.promotion_status, 'not_promoted') AS promotion_status, CASE WHEN p.candidate_row_number IS NULL THEN '' ELSE '{AS_OF}' END AS promoted_at FROM m LEFT JOIN p USING (candidate_row_number)")
def j06_updated_candidates(spark, sf) -> DataFrame:
    return _promotion(spark, sf).candidates.select("candidate_row_number", "reviewer_status", "promote_target", "promotion_status", "promoted_at")


@query(
    PROMOTE_SQL
    + f""" SELECT '{AS_OF}' AS "timestamp", 'rates' AS boq_file, CASE promote_target WHEN 'candidatematches' THEN 'CandidateMatches' ELSE promote_target END AS sheet_name, candidate_row_number AS row_number, description AS boq_description, concat('promoted-to-', promote_target) AS decision,
  approved_item_code AS matched_item_code, said AS matched_description, coalesce(confidence_override, 0.0) AS confidence_score, CASE WHEN reviewer_note <> '' THEN reviewer_note ELSE 'Promoted approved review' END AS reviewer_note FROM p"""
)
def j06_b15_promotion_log(spark, sf) -> DataFrame:
    return _promotion(spark, sf).log


@query(PROMOTE_SQL + " SELECT count(*) FILTER (promoted) AS promoted, count(*) FILTER (NOT promoted) AS skipped_duplicates, count(*) AS training_records FROM p")
def f11_promotion_summary(spark, sf) -> DataFrame:
    return _promotion(spark, sf).summary


def _merged(spark, sf) -> DataFrame:
    return library.merge_reviews(view(spark, sf, "candidates"), view(spark, sf, "decisions"))


READY_SQL = "lower(trim(reviewer_status)) IN ('approved', 'approve_append', 'approve_update')"


@query(MERGE_SQL + f" SELECT candidate_row_number, item_code, description, section, unit, rate, material_type, plant_type, notes FROM m WHERE {READY_SQL} AND target_sheet <> 'BuildUpInputs'")
def j07_m09_merged_rates(spark, sf) -> DataFrame:
    return library.merge_candidates(_merged(spark, sf))[0].select("candidate_row_number", "item_code", "description", "section", "unit", "rate", "material_type", "plant_type", "notes")


@query(MERGE_SQL + f" SELECT candidate_row_number, item_code AS input_code, coalesce(nullif(material_type, ''), nullif(plant_type, ''), notes) AS input_type, description, unit, rate FROM m WHERE {READY_SQL} AND target_sheet = 'BuildUpInputs'")
def j07_merged_inputs(spark, sf) -> DataFrame:
    return library.merge_candidates(_merged(spark, sf))[1].select("candidate_row_number", "input_code", "input_type", "description", "unit", "rate")


@query(MERGE_SQL + f" SELECT candidate_row_number, CASE WHEN {READY_SQL} THEN 'merged' ELSE reviewer_status END AS reviewer_status FROM m")
def j07_merged_statuses(spark, sf) -> DataFrame:
    return library.merge_candidates(_merged(spark, sf))[2].select("candidate_row_number", "reviewer_status")


@query(
    MERGE_SQL
    + f""" SELECT '{AS_OF}' AS "timestamp", 'rates' AS boq_file, CASE WHEN target_sheet = '' THEN 'RateLibrary' ELSE target_sheet END AS sheet_name, candidate_row_number AS row_number, description AS boq_description, 'candidate-merged' AS decision, item_code AS matched_item_code,
  description AS matched_description, 0.0::DOUBLE AS confidence_score, CASE WHEN reviewer_note <> '' THEN reviewer_note ELSE 'Merged from CandidateMatches' END AS reviewer_note FROM m WHERE {READY_SQL}"""
)
def b15_merge_log(spark, sf) -> DataFrame:
    return library.merge_log(_merged(spark, sf), AS_OF, "rates")


@query(
    MERGE_SQL
    + """ SELECT candidate_row_number, reviewer_status, CASE WHEN log_label IS NULL THEN NULL ELSE 'reviewer' END AS reviewer_name, 'hold' AS review_decision, promote_target, approved_rate, '' AS source_file, target_sheet, item_code, '' AS matched_item_code, description, section, unit, rate,
  '' AS duplicate_reason, 'not_promoted' AS promotion_status FROM m"""
)
def j04_d16_review_report(spark, sf) -> DataFrame:
    rows = library.review_report(_merged(spark, sf))
    assert rows.columns == library.REVIEW_COLUMNS
    return rows.select("candidate_row_number", "reviewer_status", "reviewer_name", "review_decision", "promote_target", F.col("approved_rate").cast("decimal(18,2)").alias("approved_rate"), "source_file", "target_sheet", "item_code", "matched_item_code", "description", "section", "unit", "rate", "duplicate_reason", "promotion_status")


@query(MERGE_SQL + " SELECT count(*) AS report_rows, count(*) FILTER (reviewer_status IN ('approved', 'merge', 'approved_for_merge')) AS reviewed, count(*) FILTER (reviewer_status IN ('rejected', 'reject')) AS rejected, count(*) FILTER (reviewer_status <> 'pending') AS training_records FROM m")
def f11_review_summary(spark, sf) -> DataFrame:
    return library.review_summary(_merged(spark, sf))


@query(MERGE_SQL + " SELECT candidate_row_number, reviewer_status, promote_target, description, unit, CAST(rate AS DOUBLE) AS rate, approved_item_code, CAST(18 AS BIGINT) AS fields FROM m WHERE reviewer_status <> 'pending'")
def b14_review_snapshots(spark, sf) -> DataFrame:
    """The training texts, read back."""
    j = F.from_json("json", "map<string,string>")
    got = library.review_snapshots(_merged(spark, sf)).select("candidate_row_number", j.alias("j"))
    return got.select("candidate_row_number", *(F.col("j")[c].alias(c) for c in ("reviewer_status", "promote_target", "description", "unit")), F.col("j")["rate"].cast("double").alias("rate"), F.col("j")["approved_item_code"].alias("approved_item_code"), F.size("j").cast("long").alias("fields"))


@query(PROMOTE_SQL + f" SELECT candidate_row_number, '{AS_OF}' AS at, promote_target, promotion_status, CAST(approved_rate AS DOUBLE) AS approved_rate, approved_canonical_term, description, CAST(19 AS BIGINT) AS fields FROM p")
def b14_m08_promotion_log(spark, sf) -> DataFrame:
    """The training texts of a whole review cycle, read back."""
    review = imports.review_cycle(*(view(spark, sf, x) for x in ("candidates", "decisions", "known_aliases", "known_rates")), AS_OF)
    got = review.promotion.training.select("candidate_row_number", F.from_json("json", "map<string,string>").alias("j"))
    return got.select("candidate_row_number", F.col("j")["timestamp"].alias("at"), *(F.col("j")[c].alias(c) for c in ("promote_target", "promotion_status", "approved_canonical_term", "description")), F.col("j")["approved_rate"].cast("double").alias("approved_rate"), F.size("j").cast("long").alias("fields"))
