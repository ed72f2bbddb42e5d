"""Registered queries of scalar functions, matching, costing, quotations and their sinks."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantra.functions import scores
from quantra.functions import text as X
from quantra.operators import buildup, commercial, matching, sinks, store
from quantra.plans import pricing
from quantra.plans.sql_pricing import ALIAS_SQL, BUILD_SQL, COSTS_SQL, HEADINGS_SQL, LCS_SQL, MATCH_SQL, PRICE_SQL, SCORES_SQL, SECTION_SQL, sql_normalized, sql_unit
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


# C: scalar functions


@query(f"SELECT doc_id, md5({sql_normalized('text')}) AS normalized FROM documents")
def c01_normalize_text(spark, sf) -> DataFrame:
    return view(spark, sf, "documents").select("doc_id", F.md5(X.normalize_text("text")).alias("normalized"))


@query(f"WITH {with_views('lines')} SELECT boq_id, row_number, {sql_unit('unit')} AS unit_key FROM lines")
def c02_normalize_unit(spark, sf) -> DataFrame:
    return view(spark, sf, "lines").select("boq_id", "row_number", X.normalize_unit("unit").alias("unit_key"))


@query(f"""
SELECT c_custkey, CASE k WHEN 'nrb' THEN 'Nairobi' WHEN 'kisumu' THEN 'Nyanza' ELSE array_to_string(list_transform(string_split(k, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS region
FROM (SELECT c_custkey, {sql_normalized("CASE c_custkey % 3 WHEN 0 THEN 'NRB' WHEN 1 THEN 'Kisumu' ELSE c_mktsegment || ' side' END")} AS k FROM customer)""")
def c03_normalize_region(spark, sf) -> DataFrame:
    label = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'NRB' WHEN 1 THEN 'Kisumu' ELSE concat(c_mktsegment, ' side') END")
    return view(spark, sf, "customer").select("c_custkey", X.normalize_region(label).alias("region"))


@query("""
SELECT event_id, TRY_CAST(replace(trim(v), ',', '') AS DOUBLE) AS number, coalesce(TRY_CAST(trim(v) AS DOUBLE), 0.0) AS plain,
  lower(trim(a)) IN ('1', 'true', 'yes', 'y', 'active') AS truth, a = '' OR lower(trim(a)) IN ('1', 'true', 'yes', 'y', 'active') AS active
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' 1,250.5 ' WHEN 1 THEN CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) WHEN 2 THEN 'n/a' ELSE '' END AS v,
  CASE event_id % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN '' WHEN 2 THEN 'no' WHEN 3 THEN 'ACTIVE' ELSE '0' END AS a FROM events)""")
def c04_c06_numbers_and_flags(spark, sf) -> DataFrame:
    v = F.expr("CASE event_id % 4 WHEN 0 THEN ' 1,250.5 ' WHEN 1 THEN CAST(CAST(value AS DECIMAL(12,2)) AS STRING) WHEN 2 THEN 'n/a' ELSE '' END")
    a = F.expr("CASE event_id % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN '' WHEN 2 THEN 'no' WHEN 3 THEN 'ACTIVE' ELSE '0' END")
    return view(spark, sf, "events").select("event_id", X.safe_number(v).alias("number"), X.plain_number(v).alias("plain"), X.truthy(a).alias("truth"), X.active(a).alias("active"))


@query(r"""
SELECT page_id, CASE WHEN s = '' THEN 'output' ELSE s END AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)""")
def c07_slugify(spark, sf) -> DataFrame:
    return view(spark, sf, "pages").select("page_id", X.slugify("url").alias("slug"))


@query(r"""
WITH t AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS v FROM conversations)
SELECT conv_id, turn, md5(v) AS cleaned, md5(lower(v)) AS lowered, v <> '' AND ((upper(v) = v AND lower(v) <> v) OR ends_with(v, ':') OR len(string_split(v, ' ')) <= 6) AS heading FROM t""")
def c08_c11_tender_text(spark, sf) -> DataFrame:
    return view(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.clean_text("text")).alias("cleaned"), F.md5(X.lowered("text")).alias("lowered"), X.heading_like("text").alias("heading"))


@query(f"""
WITH {with_views('lines')} SELECT boq_id, row_number, CASE WHEN contains(lower(sheet_name), 'plant') THEN 'Dayworks' WHEN contains(lower(sheet_name), 'earthworks') THEN 'Earthworks' ELSE '' END AS hint,
  contains(lower(description), 'subtotal') AS subtotal, contains(lower(description), 'total') AS total FROM lines""")
def c15_c16_sheet_hints_and_totals(spark, sf) -> DataFrame:
    text = X.normalize_text(F.concat_ws(" ", "description", "unit"))
    return view(spark, sf, "lines").select("boq_id", "row_number", X.sheet_section("sheet_name").alias("hint"), X.subtotal_flag(text).alias("subtotal"), X.total_flag(text).alias("total"))


@query(f"WITH {with_views('lines')}, {ALIAS_SQL.format(rows='(SELECT * FROM lines WHERE NOT is_heading AND NOT is_summary_row)')} SELECT boq_id, row_number, q3 AS query, CAST(h1 AS INT) + CAST(h2 AS INT) + CAST(h3 AS INT) AS hits FROM a3")
def c13_apply_aliases(spark, sf) -> DataFrame:
    done = matching.apply_aliases(matching.priceable(view(spark, sf, "lines")), view(spark, sf, "aliases"))
    return done.select("boq_id", "row_number", "query", F.size("alias_hits").alias("hits"))


# L: scores of distinct texts

@query(f"""
WITH RECURSIVE n AS (SELECT DISTINCT p_name AS x FROM part), k AS (SELECT x, array_to_string(list_sort(string_split(x, ' ')), ' ') AS s FROM n),
pairs AS (SELECT DISTINCT p.s AS a, q.s AS b FROM k p CROSS JOIN k q), {LCS_SQL}
SELECT p.x AS one, q.x AS other, CAST(r.score AS DOUBLE) AS score FROM k p CROSS JOIN k q JOIN ratios r ON r.a = p.s AND r.b = q.s""")
def l01_token_sort(spark, sf) -> DataFrame:
    names = view(spark, sf, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("one")).crossJoin(names.select(F.col("p_name").alias("other"))).withColumn("score", scores.token_sort(F.col("one"), F.col("other")))


NAME_PAIRS = f"WITH RECURSIVE n AS (SELECT DISTINCT p_name AS x FROM part), qp AS (SELECT p.x AS one, q.x AS other FROM n p CROSS JOIN n q), {SCORES_SQL}"


@query(NAME_PAIRS + " SELECT one, other, partial_score AS score FROM scored")
def l02_partial(spark, sf) -> DataFrame:
    names = view(spark, sf, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("one")).crossJoin(names.select(F.col("p_name").alias("other"))).withColumn("score", scores.partial_of("one", "other"))


@query(NAME_PAIRS + " SELECT one, other, set_score AS score FROM scored")
def l03_token_set(spark, sf) -> DataFrame:
    names = view(spark, sf, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("one")).crossJoin(names.select(F.col("p_name").alias("other"))).withColumn("score", scores.token_set(F.col("one"), F.col("other")))


# G, E: context, sections, matches

@query(f"WITH {with_views('lines')}, h AS ({HEADINGS_SQL}) SELECT boq_id, row_number, array_to_string(coalesce(hs, []), '|') AS headings FROM h WHERE NOT is_heading AND NOT is_summary_row")
def g01_heading_context(spark, sf) -> DataFrame:
    return matching.priceable(matching.heading_context(view(spark, sf, "lines"))).select("boq_id", "row_number", F.array_join("headings", "|").alias("headings"))


def _contexts(spark, sf) -> DataFrame:
    return matching.priceable(matching.heading_context(view(spark, sf, "lines")))


@query(f"WITH {with_views('lines')}, {SECTION_SQL} SELECT boq_id, row_number, inferred_section FROM sec")
def e02_infer_sections(spark, sf) -> DataFrame:
    rules = view(spark, sf, "rules")
    told = store.by_distinct(_contexts(spark, sf), ["sheet_name", "headings", "description"], lambda texts: matching.infer_sections(texts, rules))
    return told.select("boq_id", "row_number", "inferred_section")


def _database(spark, sf) -> pricing.Database:
    return pricing.Database(*(view(spark, sf, x) for x in ("library", "aliases", "rules", "inputs", "recipes", "adjustments")))


def _sectioned(spark, sf, texts: DataFrame) -> DataFrame:
    """Distinct lines with their sections and aliases, written once."""
    db = _database(spark, sf)
    return store.stored(matching.apply_aliases(matching.infer_sections(texts, db.rules), db.aliases), "sectioned")


@query(MATCH_SQL + " SELECT boq_id, row_number, matched_item_code, round(raw_score, 4) AS score, decision, review_flag, array_to_string(flags, ';') AS flags, array_to_string(alternates, '||') AS alternates, array_to_string(why, ';') AS rationale FROM bm")
def e01_g02_best_matches(spark, sf) -> DataFrame:
    got = store.by_distinct(_contexts(spark, sf), matching.CONTEXT, lambda texts: matching.best_matches(_sectioned(spark, sf, texts), view(spark, sf, "library")))
    return got.select("boq_id", "row_number", "matched_item_code", F.round("raw_score", 4).alias("score"), "decision", "review_flag", F.array_join("flags", ";").alias("flags"), F.array_join("alternates", "||").alias("alternates"), F.array_join("match_rationale", ";").alias("rationale"))


@query(f"WITH {with_views('inputs', 'recipes')}, {COSTS_SQL} SELECT recipe_id, region, cost FROM costs")
def e05_f07_recipe_costs(spark, sf) -> DataFrame:
    regions = view(spark, sf, "region").select(F.col("r_name").alias("region"))
    return buildup.recipe_costs(view(spark, sf, "recipes"), view(spark, sf, "inputs"), regions)


@query(f"{MATCH_SQL}, {BUILD_SQL} SELECT description, inferred_section, unit, region, recipe_id, output_description, output_unit, recipe_section, cost, round(buildup_score, 6) AS buildup_score, buildup_decision, buildup_flag FROM bu")
def e04_g06_build_ups(spark, sf) -> DataFrame:
    db = _database(spark, sf)
    got = buildup.build_ups(_sectioned(spark, sf, _contexts(spark, sf).select(*matching.CONTEXT).distinct()), db.recipes, db.inputs)
    return got.withColumn("buildup_score", F.round("buildup_score", 6))


# E03, F, M14: rates and totals

CODED_SQL = f"""
WITH {with_views('library', 'coded_lines', 'adjustments')},
j AS (SELECT l.*, i.section AS sec, i.rate AS base, i.basis FROM coded_lines l LEFT JOIN library i ON l.item_code = i.item_code AND i.active),
f AS (SELECT j.*, coalesce(sec, '') AS section, coalesce((SELECT arg_min(factor, ordinal) FROM adjustments a WHERE a.active AND lower(a.region) = lower(j.region) AND lower(a.section) = lower(j.sec)),
  (SELECT arg_min(factor, ordinal) FROM adjustments a WHERE a.active AND lower(a.region) = lower(j.region) AND trim(a.section) IN ('', '*')), 1.0000) AS factor FROM j),
p AS (SELECT *, CAST(round(base * factor, 2) AS DECIMAL(18,2)) AS rate FROM f)"""


@query(CODED_SQL + " SELECT boq_id, row_number, CAST(factor AS DECIMAL(9,4)) AS regional_factor, base AS base_rate, rate FROM p")
def e03_m14_regional_rates(spark, sf) -> DataFrame:
    items = view(spark, sf, "library").where("active").select("item_code", "section", "rate")
    lines = view(spark, sf, "coded_lines").join(items, "item_code", "left")
    return commercial.regional_rates(lines.withColumn("section", F.coalesce("section", F.lit(""))), view(spark, sf, "adjustments")).select("boq_id", "row_number", "regional_factor", "base_rate", "rate")


@query(CODED_SQL + " SELECT boq_id, section, CAST(round(sum(quantity * rate), 2) AS DECIMAL(18,2)) AS subtotal FROM p WHERE rate IS NOT NULL GROUP BY boq_id, section")
def f01_section_totals(spark, sf) -> DataFrame:
    items = view(spark, sf, "library").where("active").select("item_code", "section", "rate")
    lines = view(spark, sf, "coded_lines").join(items, "item_code").withColumn("decision", F.lit("matched"))
    return commercial.section_totals(commercial.regional_rates(lines, view(spark, sf, "adjustments")))


QUOTES_SQL = (
    CODED_SQL
    + """,
s AS (SELECT boq_id, section, CAST(round(sum(quantity * rate), 2) AS DECIMAL(18,2)) AS subtotal, count(rate) AS matched, sum(CASE WHEN rate IS NULL THEN 1 WHEN NOT approved OR basis = '' THEN 1 ELSE 0 END) AS flags, count(*) AS n FROM p GROUP BY boq_id, section),
b AS (SELECT boq_id, CAST(coalesce(sum(subtotal), 0) AS DECIMAL(18,2)) AS subtotal, CAST(sum(matched) AS BIGINT) AS matched_items, CAST(sum(flags) AS BIGINT) AS flagged_items, CAST(sum(n) AS BIGINT) AS processed_items FROM s GROUP BY boq_id),
m AS (SELECT *, CAST(round(subtotal * 0.08, 2) AS DECIMAL(18,2)) AS overhead_amount, CAST(round(subtotal * 0.05, 2) AS DECIMAL(18,2)) AS profit_amount, CAST(round(subtotal * 0.03, 2) AS DECIMAL(18,2)) AS risk_amount FROM b),
t AS (SELECT *, CAST(subtotal + overhead_amount + profit_amount + risk_amount AS DECIMAL(18,2)) AS pre_vat_total FROM m),
v AS (SELECT *, CAST(round(pre_vat_total * 0.16, 2) AS DECIMAL(18,2)) AS vat_amount FROM t)"""
)


@query(QUOTES_SQL + " SELECT *, CAST(pre_vat_total + vat_amount AS DECIMAL(18,2)) AS grand_total, flagged_items = 0 AND subtotal > 0 AS bid_ready, CASE WHEN flagged_items = 0 AND subtotal > 0 THEN 'Ready for issue' ELSE 'Human review required before issue' END AS bid_ready_reason, 'KES' AS currency FROM v")
def m02_batch_quotations(spark, sf) -> DataFrame:
    return pricing.quote_by_code(*(view(spark, sf, x) for x in ("coded_lines", "library", "adjustments")))


# A bill's summary rows from its totals (w) and its sections (s): boq_id, section, subtotal.
SUMMARY_SQL = """, w AS (SELECT *, CAST(pre_vat_total + vat_amount AS DECIMAL(18,2)) AS grand_total FROM {totals}), rows_ AS (
SELECT boq_id, 0 AS s, unnest(range(1, 13)) AS k, unnest(['Field', 'Currency', 'Bid Ready Status', 'Bid Ready Note', 'Matched Items', 'Flagged Items', 'Overheads %', 'Profit %', 'Risk %', 'VAT %', '', 'Section']) AS label,
  unnest(['Value', 'KES', CASE WHEN flagged_items = 0 AND subtotal > 0 THEN 'YES' ELSE 'NO' END, CASE WHEN flagged_items = 0 AND subtotal > 0 THEN 'Ready for issue' ELSE 'Human review required before issue' END, CAST(matched_items AS VARCHAR), CAST(flagged_items AS VARCHAR), {percents}, '', 'Subtotal']) AS value FROM w
UNION ALL SELECT boq_id, 1, row_number() OVER (PARTITION BY boq_id ORDER BY section), section, CAST(subtotal AS VARCHAR) FROM {sections} WHERE subtotal IS NOT NULL
UNION ALL SELECT boq_id, 2, unnest([1, 2, 3, 4, 5, 6, 7]), unnest(['Subtotal', 'Overheads', 'Profit', 'Risk', 'Pre-VAT Total', 'VAT', 'Grand Total']), unnest([CAST(x AS VARCHAR) for x in [subtotal, overhead_amount, profit_amount, risk_amount, pre_vat_total, vat_amount, grand_total]]) FROM w)
SELECT boq_id, CAST(row_number() OVER (PARTITION BY boq_id ORDER BY s, k) AS INT) AS row_ord, label, value FROM rows_"""


@query(QUOTES_SQL + SUMMARY_SQL.format(totals="v", sections="s", percents="'8', '5', '3', '16'"))
def b03_h05_summary_rows(spark, sf) -> DataFrame:
    items = view(spark, sf, "library").where("active").select("item_code", "section", "rate")
    lines = view(spark, sf, "coded_lines").join(items, "item_code").withColumn("decision", F.lit("matched"))
    sections = commercial.section_totals(commercial.regional_rates(lines, view(spark, sf, "adjustments")))
    return sinks.summary_rows(m02_batch_quotations(spark, sf), sections)


def _price_cases(spark, sf) -> pricing.Cases:
    return pricing.price_cases(view(spark, sf, "lines"), _database(spark, sf))


def _priced(spark, sf) -> DataFrame:
    return _price_cases(spark, sf).whole()


WORD_SQL = "CASE WHEN {x} THEN 'YES' ELSE 'NO' END AS {x}"
SUGGESTED_SQL = f"""SELECT boq_id, sheet_name, row_number, description AS boq_description, unit AS boq_unit, quantity AS boq_quantity, decision, matched_item_code, matched_description, matched_unit, base_rate, rate, round(confidence_score, 4) AS confidence_score,
  {WORD_SQL.format(x='review_flag')}, section_used, source, region_used, {WORD_SQL.format(x='built_up')}, basis AS basis_of_rate, approval_status, array_to_string(all_flags, '; ') AS commercial_review_flags, CAST(regional_factor AS DECIMAL(9,4)) AS regional_factor,
  array_to_string(alternates, ' || ') AS alternate_options, array_to_string(all_rationale, '; ') AS rationale FROM priced"""
_rounded = lambda df: df.withColumn("confidence_score", F.round("confidence_score", 4))


@query(f"{PRICE_SQL} {SUGGESTED_SQL}")
def m01_b02_price(spark, sf) -> DataFrame:
    cases = _price_cases(spark, sf)
    return _rounded(sinks.suggested(cases.whole(sinks.said_of_cases(cases.priced, cases.keys))))


# Section and bill totals of priced lines.
TOTALS_SQL = (
    PRICE_SQL
    + """,
fs AS (SELECT boq_id, section, CAST(round(sum(CASE WHEN decision = 'matched' AND rate IS NOT NULL THEN coalesce(quantity, 0) * rate END), 2) AS DECIMAL(18,2)) AS subtotal, sum(CASE WHEN decision = 'matched' AND rate IS NOT NULL THEN 1 ELSE 0 END) AS matched,
  sum(CASE WHEN decision = 'matched' AND rate IS NOT NULL THEN CAST(review_flag OR len(all_flags) > 0 AS INT) ELSE CAST(review_flag AS INT) END) AS flags, count(*) AS n FROM priced GROUP BY boq_id, section),
fb AS (SELECT boq_id, CAST(coalesce(sum(subtotal), 0) AS DECIMAL(18,2)) AS subtotal, CAST(sum(matched) AS BIGINT) AS matched_items, CAST(sum(flags) AS BIGINT) AS flagged_items, CAST(sum(n) AS BIGINT) AS processed_items FROM fs GROUP BY boq_id),
fm AS (SELECT *, CAST(round(subtotal * 0.08, 2) AS DECIMAL(18,2)) AS overhead_amount, CAST(round(subtotal * 0.05, 2) AS DECIMAL(18,2)) AS profit_amount, CAST(round(subtotal * 0.03, 2) AS DECIMAL(18,2)) AS risk_amount FROM fb),
ft AS (SELECT *, CAST(subtotal + overhead_amount + profit_amount + risk_amount AS DECIMAL(18,2)) AS pre_vat_total FROM fm), fv AS (SELECT *, CAST(round(pre_vat_total * 0.16, 2) AS DECIMAL(18,2)) AS vat_amount FROM ft)"""
)


@query(TOTALS_SQL + " SELECT *, CAST(pre_vat_total + vat_amount AS DECIMAL(18,2)) AS grand_total, flagged_items = 0 AND subtotal > 0 AS bid_ready, CASE WHEN flagged_items = 0 AND subtotal > 0 THEN 'Ready for issue' ELSE 'Human review required before issue' END AS bid_ready_reason, 'KES' AS currency FROM fv")
def m02_price_batch(spark, sf) -> DataFrame:
    return commercial.quotation_totals(_priced(spark, sf))


# Bills as grids of cells, a row lower than the lines they are made of: their totals and summaries are those of the lines.


def _bills(spark, sf) -> pricing.Priced:
    db = dataclasses.replace(_database(spark, sf), controls=tables.controls(view(spark, sf, "controls")))
    cells = view(spark, sf, "bill_cells")
    none = view(spark, sf, "merged").where("false")
    return pricing.price_bills(cells, none, db, view(spark, sf, "bill_regions"), run="cells")


@query(TOTALS_SQL + " SELECT *, CAST(pre_vat_total + vat_amount AS DECIMAL(18,2)) AS grand_total, flagged_items = 0 AND subtotal > 0 AS bid_ready, CASE WHEN flagged_items = 0 AND subtotal > 0 THEN 'Ready for issue' ELSE 'Human review required before issue' END AS bid_ready_reason, 'KES' AS currency FROM fv")
def m01_d14_price_from_cells(spark, sf) -> DataFrame:
    """Cells to lines, prices and grand totals, with the terms of the controls."""
    return _bills(spark, sf).quotes


@query(
    PRICE_SQL
    + """ SELECT l.boq_id, l.sheet_name, CAST(l.row_number + 1 AS INT) AS row_number, l.description, l.quantity, p.decision IS NOT NULL AND p.decision = 'matched' AS priced, CASE WHEN p.decision = 'matched' AND p.rate IS NOT NULL THEN p.rate WHEN l.row_number % 5 = 2 THEN 7.25 END::DECIMAL(18,2) AS rate,
  CASE WHEN p.decision = 'matched' THEN CAST(round(l.quantity * coalesce(p.rate, CASE WHEN l.row_number % 5 = 2 THEN 7.25 END), 2) AS DECIMAL(18,2)) END AS amount
FROM lines l LEFT JOIN priced p ON p.boq_id = l.boq_id AND p.sheet_name = l.sheet_name AND p.row_number = l.row_number WHERE NOT l.is_summary_row"""
)
def b01_priced_bill_from_cells(spark, sf) -> DataFrame:
    """The bills with their new rates and amounts; cells that were not priced hold what they held."""
    made = _bills(spark, sf)
    rows = sinks.whole_bill(made.whole, made.lines.columns, made.maps, more=("decision",))
    return rows.select("boq_id", "sheet_name", "row_number", "description", "quantity", F.coalesce(F.col("decision") == "matched", F.lit(False)).alias("priced"), "rate", "amount")


@query(TOTALS_SQL + SUMMARY_SQL.format(totals="fv", sections="(SELECT * FROM fs)", percents="'8', '5', '3', '16'"))
def m02_b03_price_folder(spark, sf) -> DataFrame:
    """Bills written as files, many to a file, and priced in one job: their summaries."""
    base = f"{store.shared_folder(spark)}/bill-files-{uuid.uuid4().hex}"
    view(spark, sf, "bill_cells").write.parquet(base)  # as they come: a bill's cells meet when it is priced
    made = pricing.price_folder(spark, base, _database(spark, sf), view(spark, sf, "bill_regions"), {"overheads_pct": "8", "profit_pct": "5", "risk_pct": "3"}, bill=None)
    return made.tables["summary"]


@query(PRICE_SQL + " SELECT l.*, CASE WHEN p.decision = 'matched' AND NOT l.is_summary_row THEN p.rate END AS rate, CAST(round(l.quantity * CASE WHEN p.decision = 'matched' AND NOT l.is_summary_row THEN p.rate END, 2) AS DECIMAL(18,2)) AS amount FROM lines l LEFT JOIN priced p ON p.boq_id = l.boq_id AND p.sheet_name = l.sheet_name AND p.row_number = l.row_number")
def b01_e06_priced_bill(spark, sf) -> DataFrame:
    lines = view(spark, sf, "lines")
    return sinks.whole_bill(pricing.price_whole(lines, _database(spark, sf)), lines.columns)


@query(PRICE_SQL + " SELECT boq_id, sheet_name, row_number, description AS boq_description, matched_item_code, matched_description, source, basis AS basis_of_rate, region_used, CAST(regional_factor AS DECIMAL(9,4)) AS regional_factor FROM priced")
def b05_basis_of_rates(spark, sf) -> DataFrame:
    return sinks.basis_of_rates(_priced(spark, sf))


@query(PRICE_SQL + " SELECT boq_id, sheet_name, row_number, description AS boq_description, decision, approval_status, array_to_string(all_flags, '; ') AS commercial_review_flags, array_to_string(alternates, ' || ') AS alternate_options FROM priced WHERE len(all_flags) > 0 OR review_flag")
def b06_commercial_review(spark, sf) -> DataFrame:
    return sinks.commercial_review(_priced(spark, sf))


@query(
    PRICE_SQL
    + """ SELECT boq_id, row_number, 'one' AS run, sheet_name, description, CAST(quantity AS DOUBLE) AS quantity, decision, matched_item_code, CAST(base_rate AS DOUBLE) AS base_rate, CAST(rate AS DOUBLE) AS rate, review_flag, built_up, basis AS basis_of_rate, approval_status,
  array_to_string(all_flags, ';') AS commercial_review_flags, array_to_string(alternates, ';') AS alternate_options, array_to_string(all_rationale, ';') AS rationale FROM priced"""
)
def b07_audit_json(spark, sf) -> DataFrame:
    """The audit texts, whole and one a line, read back: what a reader of the JSON finds. The schema names the fields that are returned."""
    cases = _price_cases(spark, sf)
    texts = sinks.audited(cases.whole(sinks.audited_cases(cases.priced, cases.keys, {"run": "one"})))
    schema = "metadata struct<run:string>, result struct<sheet_name:string,row_number:int,description:string,quantity:double,decision:string,matched_item_code:string,base_rate:double,rate:double,review_flag:boolean,built_up:boolean,basis_of_rate:string,approval_status:string,commercial_review_flags:array<string>,alternate_options:array<string>,rationale:array<string>>"
    read = texts.select("boq_id", "row_number", F.from_json("json", schema).alias("j"))
    plain = ("sheet_name", "description", "quantity", "decision", "matched_item_code", "base_rate", "rate", "review_flag", "built_up", "basis_of_rate", "approval_status")
    return read.select("boq_id", "row_number", "j.metadata.run", *(f"j.result.{c}" for c in plain), *(F.array_join(f"j.result.{c}", ";").alias(c) for c in ("commercial_review_flags", "alternate_options", "rationale")))


UNMATCHED_SQL = "SELECT boq_id, sheet_name, row_number, description AS boq_description, unit AS boq_unit, decision, matched_item_code, matched_description, round(confidence_score, 4) AS confidence_score, {flag}, approval_status, array_to_string(all_flags, '; ') AS commercial_review_flags FROM priced WHERE NOT (decision = 'matched' AND NOT review_flag)"


@query(f"{PRICE_SQL} {UNMATCHED_SQL.format(flag='review_flag')}")
def b08_unmatched(spark, sf) -> DataFrame:
    return _rounded(sinks.unmatched(_priced(spark, sf)))


@query(f"{PRICE_SQL} {SUGGESTED_SQL} WHERE NOT (decision = 'matched' AND NOT review_flag)")
def m04_b09_export_unmatched(spark, sf) -> DataFrame:
    """From the suggestions as a run has stored them."""
    path = f"{store.shared_folder(spark)}/suggestions-{uuid.uuid4().hex}"
    cases = _price_cases(spark, sf)
    sinks.store_suggestions(cases.lines, _rounded(sinks.said_of_cases(cases.priced, cases.keys)), cases.keys, path)
    return sinks.unmatched_from_stored(sinks.stored_suggestions(spark, path))
