"""Registered queries of grids, scans and incremental runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantra.operators import commercial, grid, library, sinks, store
from quantra.plans import pricing
from quantra.plans.queries_library import MERGE_SQL
from quantra.plans.queries_pricing import ORACLES as ORACLES_OF_PRICING
from quantra.plans.sql_pricing import sql_normalized
from quantra.sources import tables
from quantra.sources.fixtures import view, with_views
from quantra.streaming import incremental

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""
WITH {with_views('cells', 'merged')}, s AS (SELECT DISTINCT boq_id, sheet_name FROM cells), m AS (SELECT s.boq_id, s.sheet_name, 1 AS row, c.col, anchor FROM merged JOIN s USING (boq_id) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS col) c)
SELECT coalesce(c.boq_id, m.boq_id) AS boq_id, coalesce(c.sheet_name, m.sheet_name) AS sheet_name, coalesce(c.row, m.row) AS row, coalesce(c.col, m.col) AS col, trim(coalesce(nullif(c.value, ''), m.anchor, '')) AS value
FROM cells c FULL JOIN m ON c.boq_id = m.boq_id AND c.sheet_name = m.sheet_name AND c.row = m.row AND c.col = m.col""")
def e07_merged_cells(spark, sf) -> DataFrame:
    return grid.filled(view(spark, sf, "cells"), view(spark, sf, "merged"))


@query(f"WITH {with_views('cells')} SELECT DISTINCT boq_id, sheet_name, CASE WHEN sheet_name = 'Summary' THEN 'summary' ELSE 'boq' END AS classification FROM cells")
def f12_sheet_classes(spark, sf) -> DataFrame:
    return grid.sheet_classes(view(spark, sf, "cells"))


@query(f"""
WITH {with_views('cells')} SELECT boq_id, sheet_name, CAST(2 + boq_id % 3 AS INT) AS header_row, 1 AS description_col, 2 AS unit_col, 3 AS quantity_col, 4 AS rate_col FROM cells GROUP BY boq_id, sheet_name""")
def f04_f05_column_maps(spark, sf) -> DataFrame:
    return grid.column_maps(view(spark, sf, "cells")).drop("amount_col")


@query(f"""
WITH {with_views('cells')} SELECT boq_id, sheet_name, row AS row_number, max(CASE WHEN col = 1 THEN value END) AS description, max(CASE WHEN col = 2 THEN value END) AS unit, CAST(max(CASE WHEN col = 3 THEN value END) AS DECIMAL(18,4)) AS quantity, CAST(max(CASE WHEN col = 4 THEN value END) AS DECIMAL(18,4)) AS rate, FALSE AS is_heading
FROM cells WHERE sheet_name <> 'Summary' AND row > 2 + boq_id % 3 GROUP BY boq_id, sheet_name, row""")
def a11_d04_g03_grid_lines(spark, sf) -> DataFrame:
    return grid.grid_lines(view(spark, sf, "cells"), view(spark, sf, "merged")).select("boq_id", "sheet_name", "row_number", "description", "unit", "quantity", "rate", "is_heading")


@query(f"WITH {with_views('cells')} SELECT boq_id AS doc_id, row AS line_no, concat(sheet_name, '!R', row) AS source_reference, string_agg(value, ' | ' ORDER BY col) AS text, sheet_name FROM cells WHERE value <> '' GROUP BY boq_id, sheet_name, row")
def a14_grid_tender_lines(spark, sf) -> DataFrame:
    return tables.joined_rows(view(spark, sf, "cells").withColumnRenamed("boq_id", "doc_id"))


@query("SELECT event_type AS key, arg_max(CASE WHEN user_id = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END, event_id) AS value FROM events GROUP BY event_type")
def a06_controls(spark, sf) -> DataFrame:
    return tables.controls(view(spark, sf, "events").select(F.concat(F.lit(" "), "event_type").alias("key"), F.col("user_id").cast("string").alias("value"), F.col("event_id").alias("ordinal")))


@query("SELECT p_partkey AS ordinal, p_name AS normalized_description, CAST(p_retailprice AS DECIMAL(18,2)) AS rate, 'KES' AS currency, p_partkey % 3 <> 1 AS active FROM part WHERE p_partkey % 10 <> 0")
def a01_rate_library_scan(spark, sf) -> DataFrame:
    raw = view(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), F.expr("CASE WHEN p_partkey % 10 = 0 THEN '' ELSE upper(p_name) END").alias("description"), F.lit("").alias("normalized_description"), F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("rate"), F.lit("").alias("currency"), F.lit("").alias("confidence_hint"), F.expr("CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'no' ELSE 'Yes' END").alias("active"))
    return tables.rate_library(raw).select("ordinal", "normalized_description", "rate", "currency", "active")


@query("SELECT c_custkey AS ordinal, CASE WHEN c_custkey % 4 = 0 THEN '*' ELSE c_mktsegment END AS section, CAST(CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 1.25 END AS DECIMAL(9,4)) AS factor FROM customer")
def a07_adjustments_scan(spark, sf) -> DataFrame:
    raw = view(spark, sf, "customer").select(F.col("c_custkey").alias("ordinal"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END").alias("section"), F.expr("CASE c_custkey % 3 WHEN 0 THEN '0' WHEN 1 THEN 'n/a' ELSE '1.25' END").alias("factor"), F.lit("").alias("active"))
    return tables.regional_adjustments(raw).select("ordinal", "section", "factor")


# Sheets with headings, noise, subtotals, gaps and headers that don't name their columns: classes, header scores, inferred columns and lines by rule.
FIELD_WORDS = {f: "|".join(w) for f, w in grid.HEADERS.items()}
LEDGER_SQL = f"""WITH {with_views('ledger')}, g AS MATERIALIZED (SELECT boq_id, sheet_name, row, col, trim(value) AS value, {sql_normalized('value')} AS key, TRY_CAST(replace(trim(value), ',', '') AS DOUBLE) IS NOT NULL AS is_num FROM ledger),
cls AS (SELECT boq_id, sheet_name, CASE WHEN sheet_name = 'Recap' THEN 'summary' WHEN sheet_name = 'Bill' THEN 'boq' WHEN bool_or(row <= 8 AND contains(key, 'summary')) THEN 'summary' ELSE 'boq' END AS classification FROM g GROUP BY boq_id, sheet_name),
lv AS MATERIALIZED (SELECT g.* FROM g JOIN cls USING (boq_id, sheet_name) WHERE classification = 'boq'),
br AS (SELECT boq_id, sheet_name, row, {', '.join(f"min(col) FILTER (regexp_matches(key, '{w}')) AS {f}" for f, w in FIELD_WORDS.items())}, sum(CASE WHEN key IN ('item description', 'description', 'particulars', 'qty', 'quantity', 'rate', 'amount') THEN 2.0 ELSE 0.0 END) AS exact, count(*) FILTER (is_num) AS numbers FROM lv GROUP BY boq_id, sheet_name, row),
sp AS (SELECT boq_id, sheet_name, CAST(unnest(range(1, max(row) + 1)) AS INT) AS row FROM lv GROUP BY boq_id, sheet_name),
sc AS (SELECT s.boq_id, s.sheet_name, s.row, b.* EXCLUDE (boq_id, sheet_name, row), (CASE WHEN b.description IS NULL THEN 0 ELSE 5 END) + (CASE WHEN b.unit IS NULL THEN 0 ELSE 3 END) + (CASE WHEN b.quantity IS NULL THEN 0 ELSE 3 END) + (CASE WHEN b.rate IS NULL THEN 0 ELSE 3 END) + (CASE WHEN b.amount IS NULL THEN 0 ELSE 3 END)
  + coalesce(b.exact, 0) + coalesce((SELECT sum(least(n.numbers, 3) * 0.5) FROM br n WHERE n.boq_id = s.boq_id AND n.sheet_name = s.sheet_name AND n.row > s.row AND n.row <= s.row + 4), 0) AS score FROM sp s LEFT JOIN br b USING (boq_id, sheet_name, row) WHERE s.row <= 20),
hd AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY boq_id, sheet_name ORDER BY score DESC, row) = 1),
bl AS (SELECT l.*, h.row AS header_row FROM lv l JOIN hd h USING (boq_id, sheet_name) WHERE l.row > h.row AND l.row <= h.row + 8),
cs AS (SELECT boq_id, sheet_name, col, count(*) FILTER (value <> '') AS texts, count(*) FILTER (is_num) AS numbers, min(row) FILTER (is_num) AS first_row, min(row) FILTER (value <> '') AS first_text, bool_or(key IN ('m2', 'm3', 'nr', 'sum', 'day', 'item', 'ton')) AS has_unit FROM bl GROUP BY boq_id, sheet_name, col),
nr AS (SELECT *, row_number() OVER (PARTITION BY boq_id, sheet_name ORDER BY numbers DESC, first_row, col) AS place FROM cs WHERE numbers > 0),
inf AS (SELECT c.boq_id, c.sheet_name, arg_min(c.col, -c.texts * 1000000 + c.first_text * 100 + c.col) AS i_description, min(c.col) FILTER (c.has_unit) AS i_unit, max(n.col) FILTER (n.place = 1) AS i_first, max(n.col) FILTER (n.place = 2) AS i_second FROM cs c LEFT JOIN nr n ON n.boq_id = c.boq_id AND n.sheet_name = c.sheet_name AND n.col = c.col GROUP BY c.boq_id, c.sheet_name),
mp AS MATERIALIZED (SELECT h.boq_id, h.sheet_name, h.row AS header_row, coalesce(h.description, i.i_description, 1) AS description_col, coalesce(h.unit, i.i_unit) AS unit_col, coalesce(h.quantity, i.i_first) AS quantity_col, coalesce(h.rate, i.i_second) AS rate_col, coalesce(h.amount, i.i_first) AS amount_col FROM hd h LEFT JOIN inf i USING (boq_id, sheet_name)),
rs AS (SELECT s.boq_id, s.sheet_name, s.row, coalesce(max(l.value) FILTER (l.col = m.description_col), '') AS description, coalesce(max(l.value) FILTER (l.col = m.unit_col), '') AS unit, {', '.join(f"TRY_CAST(replace(max(l.value) FILTER (l.col = m.{c}_col), ',', '') AS DECIMAL(18,4)) AS {c}" for c in ('quantity', 'rate', 'amount'))}
  FROM (SELECT boq_id, sheet_name, CAST(unnest(range(1, max(row) + 1)) AS INT) AS row FROM lv GROUP BY boq_id, sheet_name) s JOIN mp m USING (boq_id, sheet_name) LEFT JOIN lv l ON l.boq_id = s.boq_id AND l.sheet_name = s.sheet_name AND l.row = s.row WHERE s.row > m.header_row GROUP BY s.boq_id, s.sheet_name, s.row),
rt AS (SELECT *, {sql_normalized("concat_ws(' ', nullif(description, ''), nullif(unit, ''))")} AS rtext, description = '' AND unit = '' AND coalesce(quantity, 0) = 0 AND coalesce(rate, 0) = 0 AND coalesce(amount, 0) = 0 AS blank, quantity IS NULL AND rate IS NULL AND amount IS NULL AS bare FROM rs),
rl AS (SELECT *, regexp_matches(rtext, 'subtotal|sub total|carried forward|brought forward') AS is_subtotal, regexp_matches(rtext, 'total|contract sum') AS is_total FROM rt),
rk AS (SELECT *, NOT blank AND rtext NOT IN ('', 'page', 'continued', 'subtotal', 'sub total', 'total', 'carried forward', 'brought forward', 'sum') AND NOT ((is_subtotal OR is_total) AND bare) AS line FROM rl),
ri AS (SELECT *, sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY boq_id, sheet_name ORDER BY row) AS island, bool_or(line) OVER (PARTITION BY boq_id, sheet_name ORDER BY row) AS seen FROM rk),
rj AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY boq_id, sheet_name, island ORDER BY row) AS streak FROM ri),
rz AS (SELECT *, bool_or(seen AND blank AND streak >= 5) OVER (PARTITION BY boq_id, sheet_name ORDER BY row) AS stopped FROM rj)"""


@query(LEDGER_SQL + " SELECT boq_id, sheet_name, classification FROM cls")
def f12_ledger_classes(spark, sf) -> DataFrame:
    return grid.sheet_classes(view(spark, sf, "ledger"))


@query(LEDGER_SQL + " SELECT * FROM mp")
def f05_g04_inferred_columns(spark, sf) -> DataFrame:
    return grid.bill_maps(view(spark, sf, "ledger"))


@query(LEDGER_SQL + " SELECT boq_id, sheet_name, row AS row_number, description, unit, quantity, rate, amount, bare AND (regexp_matches(rtext, 'preliminaries|dayworks|earthworks|concrete|finishes|general items|contractor equipment|contractors equipment') OR (description <> '' AND unit = '')) AS is_heading, is_subtotal, is_total, is_subtotal OR is_total AS is_summary_row FROM rz WHERE line AND NOT stopped")
def g03_c17_c18_ledger_lines(spark, sf) -> DataFrame:
    none = view(spark, sf, "merged").where("false")
    return grid.grid_lines(view(spark, sf, "ledger"), none)


# Dimension scans from tables with blanks, words for flags and numbers as text.


@query("SELECT p_partkey AS ordinal, p_name AS alias, p_type AS canonical_term, p_brand AS section_bias FROM part WHERE p_partkey % 4 <> 0")
def a02_aliases_scan(spark, sf) -> DataFrame:
    raw = view(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), F.expr("CASE p_partkey % 4 WHEN 0 THEN CASE p_partkey % 8 WHEN 0 THEN '' END ELSE p_name END").alias("alias"), F.col("p_type").alias("canonical_term"), F.col("p_brand").alias("section_bias"))
    return tables.aliases(raw)


@query("SELECT p_partkey AS ordinal, p_name AS trigger_text, p_brand AS inferred_section, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(p_size AS INT) END AS priority FROM part WHERE p_partkey % 5 <> 0")
def a03_section_rules_scan(spark, sf) -> DataFrame:
    raw = view(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END").alias("trigger_text"), F.col("p_brand").alias("inferred_section"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'high' ELSE CAST(p_size AS STRING) END").alias("priority"))
    return tables.section_rules(raw)


FLAG = "CASE {k} % 4 WHEN 0 THEN '' WHEN 1 THEN 'No' WHEN 2 THEN ' YES ' ELSE '1' END"


@query("SELECT s_suppkey AS ordinal, s_name AS input_code, s_suppkey % 4 <> 1 AS active FROM supplier WHERE s_suppkey % 6 <> 0")
def a04_inputs_scan(spark, sf) -> DataFrame:
    raw = view(spark, sf, "supplier").select(F.col("s_suppkey").alias("ordinal"), F.expr("CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE s_name END").alias("input_code"), F.expr(FLAG.format(k="s_suppkey")).alias("active"))
    return tables.buildup_inputs(raw)


@query("SELECT o_orderkey AS ordinal, CAST(o_custkey AS VARCHAR) AS recipe_id, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS factor, CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE 0.05 END::DOUBLE AS waste_factor FROM orders WHERE o_orderkey % 7 <> 0")
def a05_recipes_scan(spark, sf) -> DataFrame:
    raw = view(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END").alias("recipe_id"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END").alias("factor"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '0.05' END").alias("waste_factor"))
    return tables.buildup_recipes(raw)


@query("SELECT c_mktsegment AS category, c_name AS text FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 1")
def a08_b04_assumptions(spark, sf) -> DataFrame:
    raw = view(spark, sf, "customer").select(F.col("c_mktsegment").alias("category"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END").alias("text"), F.expr(FLAG.format(k="c_custkey")).alias("active"))
    return sinks.notice_table(tables.notices(raw))


@query("SELECT c_custkey AS doc_id, CAST(1 AS INT) AS line_no, 'R1' AS source_reference, concat(c_name, ' | a, \"b\" | ', c_mktsegment) AS text FROM customer UNION ALL SELECT c_custkey, 3, 'R3', c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def a13_csv_tender_lines(spark, sf) -> DataFrame:
    """Each customer as a CSV text of three rows, the second blank."""
    text = F.concat(F.col("c_name"), F.lit(',"a, ""b""",, '), "c_mktsegment", F.lit("\n,,\n"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("")))
    return tables.csv_lines(view(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


@query("SELECT concat('bill-', o_orderpriority) AS boq_id, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY o_orderpriority")
def a16_bill_files(spark, sf) -> DataFrame:
    """A file a priority, read in one job."""
    base = f"{store.shared_folder(spark)}/bills-{uuid.uuid4().hex}"
    rows = view(spark, sf, "orders").select("o_orderpriority", "o_custkey")
    rows.repartition("o_orderpriority").write.partitionBy("o_orderpriority").parquet(base)
    files = tables.bill_files(spark, base, "o_custkey long", "o_orderpriority=([^/]+)/")
    return files.groupBy(F.concat(F.lit("bill-"), "boq_id").alias("boq_id")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


@query("SELECT o_orderpriority AS boq_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'second' ELSE 'first' END AS run, count(*) AS n FROM orders GROUP BY ALL")
def b17_refresh_on_rerun(spark, sf) -> DataFrame:
    """All bills written once, then two of them again: the others stay as they were."""
    path = f"{store.shared_folder(spark)}/refreshed-{uuid.uuid4().hex}"
    rows = view(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("boq_id"))
    sinks.refresh(rows.withColumn("run", F.lit("first")), path, "boq_id")
    sinks.refresh(rows.where("boq_id IN ('1-URGENT', '2-HIGH')").withColumn("run", F.lit("second")), path, "boq_id")
    return spark.read.parquet(path).groupBy("boq_id", "run").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS notes FROM customer UNION ALL SELECT s_suppkey, s_name, 'new' FROM supplier")
def b18_b16_evolving_table(spark, sf) -> DataFrame:
    """Rows with a column more are appended to a table; older rows have nothing there."""
    path = f"{store.shared_folder(spark)}/evolving-{uuid.uuid4().hex}"
    sinks.append_table(view(spark, sf, "customer").select("c_custkey", "c_name"), path)
    sinks.append_table(view(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("new").alias("notes")), path)
    return sinks.conform(spark.read.option("mergeSchema", True).parquet(path), [("notes", "string")])


@query("SELECT doc_id % 100 AS table_name, string_agg(DISTINCT lang, ',' ORDER BY lang) AS missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id % 100 = d.doc_id % 100 AND x.lang = d.lang AND x.n_chars % 3 = 0) AND doc_id % 100 IN (SELECT doc_id % 100 FROM documents WHERE n_chars % 3 = 0) GROUP BY doc_id % 100")
def e18_m03_schema_gaps(spark, sf) -> DataFrame:
    """What is expected and what is there, from rows of a table: names are numbers, columns are languages."""
    rows = view(spark, sf, "documents").select((F.col("doc_id") % 100).cast("string").alias("table_name"), F.col("lang").alias("column_name"), "n_chars")
    actual = rows.where("n_chars % 3 = 0").drop("n_chars").distinct()
    optional = [r[0] for r in rows.select("table_name").distinct().join(actual.select("table_name").distinct(), "table_name", "left_anti").collect()]  # at most 100 names
    got = library.schema_gaps(rows.drop("n_chars").distinct(), actual, optional)
    return got.select(F.col("table_name").cast("long").alias("table_name"), F.array_join("missing", ",").alias("missing"))


@query(ORACLES_OF_PRICING["m02_price_batch"])
def k01_price_stream(spark, sf) -> DataFrame:
    """Bills that arrive as files, priced by a stream as a batch prices them; a bill is in one file."""
    base = f"{store.shared_folder(spark)}/bills-{uuid.uuid4().hex}"
    lines = view(spark, sf, "lines")
    db = pricing.Database(*(view(spark, sf, x) for x in ("library", "aliases", "rules", "inputs", "recipes", "adjustments")))
    store.spread(lines, "boq_id").write.parquet(f"{base}/in")
    incremental.price_new_bills(spark, f"{base}/in", lines.schema, lambda new: commercial.quotation_totals(pricing.price(new, db)), f"{base}/out", f"{base}/progress").awaitTermination()
    return incremental.priced_bills(spark, f"{base}/out")


OPENED = {"RateLibrary": "library", "Aliases": "aliases", "SectionRules": "rules", "BuildUpInputs": "inputs", "BuildUpRecipes": "recipes", "Controls": "supplier", "CandidateMatches": "candidates", "ReviewLog": "decisions"}


@query(f"WITH {with_views(*OPENED.values())} " + " UNION ALL ".join([*(f"SELECT '{n}' AS name, count(*) AS n FROM {t}" for n, t in OPENED.items()), *(f"SELECT '{n}', 0" for n in tables.OPTIONAL)]))
def a09_open_tables(spark, sf) -> DataFrame:
    """The rows of a database's tables; optional ones that are missing are empty."""
    for name, source in OPENED.items():
        view(spark, sf, source).createOrReplaceTempView(name)
    found, out = tables.open_tables(spark), None
    for name, df in found.items():
        rows = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(MERGE_SQL + " SELECT candidate_row_number, reviewer_status, log_label FROM m")
def k02_decision_stream(spark, sf) -> DataFrame:
    base = f"{store.shared_folder(spark)}/decisions-{uuid.uuid4().hex}"
    rows = view(spark, sf, "decisions")
    rows.repartitionByRange(4, "event_id").write.parquet(f"{base}/in")
    incremental.apply_decisions(spark, f"{base}/in", rows.schema, f"{base}/out", f"{base}/progress").awaitTermination()
    got = incremental.decided(view(spark, sf, "candidates"), spark.read.parquet(f"{base}/out"))
    return got.select("candidate_row_number", "reviewer_status", "log_label")
