"""The driver tables as rate libraries, bills of quantities, dimensions, grids and tender texts.

Each projection is one SQL text that Spark and other engines read alike ({name} stands for a driver table or an earlier projection), so the queries
and their SQL start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

REGION = "CASE {key} % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE' ELSE 'MIDDLE EAST' END"

VIEWS = {
    "library": f"""
        SELECT p_partkey AS ordinal, concat('P', CAST(p_partkey AS VARCHAR(20))) AS item_code, p_name AS description, p_brand AS section, p_type AS subsection,
          CASE p_size % 5 WHEN 0 THEN 'm2' WHEN 1 THEN 'SQM' WHEN 2 THEN 'nr' WHEN 3 THEN 'No' ELSE 'day' END AS unit,
          CAST(p_retailprice AS DECIMAL(18,2)) AS rate, {REGION.format(key='p_partkey')} AS region,
          CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'list' END AS basis, CAST(p_size % 7 AS DOUBLE) AS confidence_hint, p_partkey % 11 <> 0 AS active, concat('cat', CAST(p_partkey % 3 AS VARCHAR(4))) AS source
        FROM {{part}}""",
    "ranked": """
        SELECT l.*, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
          l_returnflag, l_linestatus, l_shipdate) AS INT) AS row_number FROM {lineitem} l""",
    "lines": f"""
        SELECT r.l_orderkey AS boq_id, CASE r.l_orderkey % 3 WHEN 0 THEN 'Bill No 1 Earthworks' WHEN 1 THEN 'Plant hire' ELSE 'Sheet' END AS sheet_name, r.row_number,
          CASE WHEN r.row_number = 1 THEN concat('Works in ', p.p_brand) WHEN r.row_number % 6 = 0 THEN 'Subtotal' WHEN r.l_partkey % 4 = 0 THEN p.p_name
            WHEN r.l_partkey % 4 = 1 THEN upper(p.p_name) WHEN r.l_partkey % 4 = 2 THEN concat(split_part(p.p_name, ' ', 2), ' and ', split_part(p.p_name, ' ', 1))
            ELSE concat(substr(p.p_name, 1, 2), substr(p.p_name, 4)) END AS description,
          CASE WHEN r.row_number = 1 OR r.row_number % 6 = 0 THEN '' WHEN r.l_suppkey % 4 = 0 THEN 'm2' WHEN r.l_suppkey % 4 = 1 THEN 'SQM' WHEN r.l_suppkey % 4 = 2 THEN 'pcs' ELSE '' END AS unit,
          CASE WHEN r.row_number = 1 THEN NULL ELSE CAST(r.l_quantity AS DECIMAL(18,4)) END AS quantity, {REGION.format(key='r.l_orderkey')} AS region,
          r.row_number = 1 AS is_heading, r.row_number % 6 = 0 AS is_summary_row
        FROM {{ranked}} r JOIN {{part}} p ON r.l_partkey = p.p_partkey""",
    "bill_cells": """
        SELECT boq_id, sheet_name, row_number + 1 AS row, c.col, CASE c.col WHEN 1 THEN description WHEN 2 THEN unit WHEN 3 THEN coalesce(CAST(quantity AS VARCHAR(24)), '') WHEN 4 THEN CASE WHEN row_number % 5 = 2 THEN '7.25' ELSE '' END ELSE '' END AS value
        FROM {lines} CROSS JOIN (SELECT 1 AS col UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) c
        UNION ALL SELECT DISTINCT boq_id, sheet_name, 1, h.col, h.name FROM {lines} CROSS JOIN (SELECT 1 AS col, 'Particulars' AS name UNION ALL SELECT 2, 'UOM' UNION ALL SELECT 3, 'Qty' UNION ALL SELECT 4, 'Unit Rate' UNION ALL SELECT 5, 'Amount') h""",
    "bill_regions": f"SELECT DISTINCT boq_id, {REGION.format(key='boq_id')} AS region FROM {{lines}}",
    "controls": "SELECT * FROM (VALUES (1, 'overheads_pct', '8'), (2, 'profit_pct', '4'), (3, ' profit_pct', ' 5 '), (4, 'risk_pct', '3'), (5, 'vat_pct', 'none'), (6, 'default_approval_status', 'Pending Commercial Review'), (7, 'company', 'x')) AS t(ordinal, key, value)",
    "coded_lines": f"""
        SELECT r.l_orderkey AS boq_id, r.row_number, concat('P', CAST(r.l_partkey AS VARCHAR(20))) AS item_code, CAST(r.l_quantity AS DECIMAL(18,4)) AS quantity, g.r_name AS region,
          r.l_returnflag <> 'R' AS approved
        FROM {{ranked}} r JOIN {{supplier}} s ON r.l_suppkey = s.s_suppkey JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey JOIN {{region}} g ON n.n_regionkey = g.r_regionkey""",
    "adjustments": """
        SELECT CAST(r_regionkey AS BIGINT) * 1000 AS ordinal, r_name AS region, '*' AS section, CAST(1.00 + r_regionkey * 0.01 AS DECIMAL(9,4)) AS factor, concat('base ', r_name) AS notes, TRUE AS active FROM {region}
        UNION ALL SELECT CAST(r_regionkey AS BIGINT) * 1000 + b.k, r_name, concat('Brand#', CAST(b.k AS VARCHAR(4))), CAST(1.00 + b.k * 0.005 AS DECIMAL(9,4)), 'exact', b.k <> 4
        FROM {region} CROSS JOIN (SELECT 2 AS k UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) b WHERE r_regionkey < 3""",
    "aliases": "SELECT * FROM (VALUES (1, 'ring', 'ring band', 'Brand#2'), (2, 'widget', 'gadget', ''), (3, 'red', 'scarlet', 'Brand#3'), (4, '', 'none', '')) AS t(ordinal, alias, canonical_term, section_bias)",
    "rules": "SELECT * FROM (VALUES (1, 'widget', 'Brand#2', 10), (2, 'ring', 'Brand#3', 20), (3, 'small', 'Brand#4', 20), (4, 'plant', 'Brand#5', 1)) AS t(ordinal, trigger_text, inferred_section, priority)",
    "inputs": f"""
        SELECT p_partkey AS ordinal, p_type AS input_code, CAST(p_retailprice AS DECIMAL(18,2)) AS rate, {REGION.format(key='p_partkey')} AS region, p_partkey % 3 <> 0 AS active FROM {{part}}""",
    "recipes": """
        SELECT * FROM (VALUES (1, 'R1', 'small ring', 'm2', 'Brand#3', 'ECONOMY', 0.5, 0.05), (2, 'R1', 'x', '', '', 'STANDARD', 0.25, 0.0), (3, 'R2', 'large gear', 'nr', '', 'PROMO', 1.5, 0.1),
          (4, 'R3', 'blue bolt', 'day', 'Brand#4', 'MISSING', 1.0, 0.0)) AS t(ordinal, recipe_id, output_description, output_unit, section, component_code, factor, waste_factor)""",
    "incoming": f"""
        SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat('I', CAST(p_partkey % 700 AS VARCHAR(20))) END AS item_code, concat(p_name, ' ', CAST(p_size AS VARCHAR(4)), ' ', p_brand) AS description,
          CASE p_size % 5 WHEN 0 THEN 'm2' WHEN 1 THEN 'SQM' WHEN 2 THEN 'nr' WHEN 3 THEN 'No' ELSE '' END AS unit, CAST(p_retailprice AS DECIMAL(18,2)) AS rate, {REGION.format(key='p_partkey')} AS region
        FROM {{part}}""",
    "offers": """
        SELECT ordinal, item_code AS Rate_Code, CASE WHEN ordinal % 23 = 0 THEN '' ELSE description END AS Particulars, unit AS UOM, CASE WHEN ordinal % 17 = 0 THEN 'on request' ELSE CAST(rate AS VARCHAR(24)) END AS Unit_Rate, region AS County,
          CASE ordinal % 4 WHEN 0 THEN 'no' WHEN 1 THEN '' ELSE 'yes' END AS Status, concat('p', CAST(ordinal % 9 AS VARCHAR(4))) AS Page_No, CASE WHEN ordinal % 2 = 0 THEN 'gang' ELSE '' END AS labour_type, concat('tag', CAST(ordinal % 3 AS VARCHAR(4))) AS Tags
        FROM {arriving}""",
    "existing": "SELECT * FROM {incoming} WHERE ordinal % 3 = 0",
    "arriving": "SELECT * FROM {incoming} WHERE ordinal % 3 <> 0",
    "candidates": """
        SELECT o_orderkey AS candidate_row_number, concat('C', CAST(o_orderkey % 97 AS VARCHAR(8))) AS item_code, concat('item ', CAST(o_orderkey % 211 AS VARCHAR(8))) AS description, o_orderpriority AS section,
          CASE o_orderkey % 3 WHEN 0 THEN 'm2' WHEN 1 THEN 'nr' ELSE 'SQM' END AS unit, CAST(o_totalprice AS DECIMAL(18,2)) AS rate, '' AS reviewer_status,
          CASE o_orderkey % 4 WHEN 0 THEN 'aliases' WHEN 1 THEN 'ratelibrary' WHEN 2 THEN '' ELSE 'ratelibrary' END AS promote_target,
          CASE o_orderkey % 5 WHEN 0 THEN 'BuildUpInputs' WHEN 1 THEN '' ELSE 'RateLibrary' END AS target_sheet, CASE o_orderkey % 7 WHEN 0 THEN 'cement' ELSE '' END AS material_type,
          CASE o_orderkey % 3 WHEN 0 THEN 'crane' ELSE '' END AS plant_type, concat('note ', CAST(o_orderkey % 13 AS VARCHAR(8))) AS notes
        FROM {orders}""",
    "decisions": """
        SELECT event_id, ts, user_id AS candidate_row_number, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'merge' ELSE 'hold' END AS reviewer_status,
          CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS DECIMAL(18,2)) AS approved_rate,
          CASE event_id % 7 WHEN 0 THEN 'aliases' WHEN 1 THEN 'RateLibrary' WHEN 2 THEN '' WHEN 3 THEN 'archive' WHEN 4 THEN 'Aliases ' ELSE 'ratelibrary' END AS promote_target,
          CASE event_id % 3 WHEN 0 THEN concat('A', CAST(user_id % 50 AS VARCHAR(8))) ELSE '' END AS approved_item_code, CASE event_id % 4 WHEN 0 THEN concat('Item with ', CAST(user_id % 50 AS VARCHAR(8))) ELSE '' END AS approved_description,
          CASE event_id % 5 WHEN 0 THEN concat('Term ', CAST(user_id % 40 AS VARCHAR(8))) ELSE '' END AS approved_canonical_term, CASE event_id % 2 WHEN 0 THEN 'Concrete' ELSE '' END AS approved_section_bias,
          CAST(CASE WHEN event_id % 4 = 1 THEN event_id % 90 END AS DOUBLE) AS confidence_override, CASE event_id % 6 WHEN 0 THEN '' ELSE concat('seen ', CAST(event_id % 11 AS VARCHAR(8))) END AS reviewer_note
        FROM {events}""",
    "known_aliases": "SELECT DISTINCT concat('Item ', CAST(p_size AS VARCHAR(8))) AS alias, concat(' item ', CAST(p_size AS VARCHAR(8))) AS canonical_term FROM {part} UNION ALL SELECT DISTINCT concat('item ', CAST(p_size AS VARCHAR(8))), concat('term ', CAST(p_size AS VARCHAR(8))) FROM {part}",
    "known_rates": "SELECT DISTINCT concat('A', CAST(p_size AS VARCHAR(8))) AS item_code, concat('ITEM ', CAST(p_size AS VARCHAR(8))) AS description, 'm2' AS unit FROM {part}",
    "phrases": """
        SELECT * FROM (VALUES ('securities', 1, 'loser', 1, 'Commercial Manager'), ('securities', 1, 'license', 2, 'Commercial Manager'), ('meetings', 2, 'stupid', 1, 'Estimator'), ('periods', 3, 'the thing', 1, 'Planner'),
          ('pricing_instructions', 4, 'worthless', 1, 'QS'), ('technical_compliance', 5, 'ation the', 1, 'Technical Lead'), ('submission_documents', 6, 'einheit', 1, 'Estimator')) AS t(category, cat_ord, phrase, phrase_ord, owner)""",
    "scopes": """
        SELECT * FROM (VALUES ('Earthworks', 1, 'erthe', 1), ('Earthworks', 1, 'tion the', 2), ('Dayworks', 2, 'queque', 1), ('Plumbing', 3, 'einheit', 1), ('Concrete', 4, 'trash', 1), ('Concrete', 4, 'clown', 2)) AS t(section, sec_ord, keyword, key_ord)""",
    "patterns": "SELECT * FROM (VALUES ('unclear_scope', 1, 'idiot'), ('missing_measurements', 2, 'would the'), ('conflicting_instructions', 3, 'pathetic'), ('unusual_requirements', 4, 'license')) AS t(category, cat_ord, pattern)",
    "cells": """
        SELECT o_custkey AS boq_id, CASE o_custkey % 4 WHEN 0 THEN 'Summary' ELSE concat('Bill ', CAST(o_custkey % 4 AS VARCHAR(2))) END AS sheet_name, CAST(k + 2 + o_custkey % 3 AS INT) AS row, c.col,
          CASE c.col WHEN 1 THEN concat('supply of item ', CAST(o_orderkey AS VARCHAR(12))) WHEN 2 THEN CASE o_orderkey % 3 WHEN 0 THEN 'm2' WHEN 1 THEN 'nr' ELSE '' END
            WHEN 3 THEN CAST(o_orderkey % 50 AS VARCHAR(12)) WHEN 4 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(24)) ELSE '' END AS value
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM {orders}) o CROSS JOIN (SELECT 1 AS col UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) c
        UNION ALL SELECT DISTINCT o_custkey, CASE o_custkey % 4 WHEN 0 THEN 'Summary' ELSE concat('Bill ', CAST(o_custkey % 4 AS VARCHAR(2))) END, CAST(2 + o_custkey % 3 AS INT), h.col, h.name
        FROM {orders} CROSS JOIN (SELECT 1 AS col, 'Particulars' AS name UNION ALL SELECT 2, 'UOM' UNION ALL SELECT 3, 'Qty' UNION ALL SELECT 4, 'Unit Rate') h""",
    "ledger": """
        SELECT c.o_custkey AS boq_id, CASE c.o_custkey % 5 WHEN 0 THEN 'Recap' WHEN 1 THEN 'Sheet' ELSE 'Bill' END AS sheet_name, CAST(c.k + 2 + c.o_custkey % 3 + CASE WHEN c.o_custkey % 6 = 0 AND c.k > 3 THEN 5 WHEN c.k > 5 THEN 4 ELSE 0 END AS INT) AS row, x.col,
          CASE x.col WHEN 1 THEN CASE c.o_orderkey % 10 WHEN 0 THEN 'Concrete works' WHEN 1 THEN 'Continued' WHEN 2 THEN 'Subtotal' WHEN 3 THEN 'carried forward' WHEN 4 THEN 'General notes' ELSE concat('supply of item ', CAST(c.o_orderkey AS VARCHAR(12))) END
            WHEN 2 THEN CASE WHEN c.o_orderkey % 10 < 5 THEN '' WHEN c.o_orderkey % 3 = 0 THEN 'm2' WHEN c.o_orderkey % 3 = 1 THEN 'item' ELSE 'pcs' END
            WHEN 3 THEN CASE WHEN c.o_orderkey % 10 < 5 THEN '' ELSE CAST(c.o_orderkey % 50 AS VARCHAR(12)) END WHEN 4 THEN CASE WHEN c.o_orderkey % 10 < 5 OR c.o_orderkey % 4 = 0 THEN '' ELSE CAST(CAST(c.o_totalprice AS DECIMAL(18,2)) AS VARCHAR(24)) END
            ELSE CASE WHEN c.o_orderkey % 10 = 2 THEN '1,250.50' ELSE '' END END AS value
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM {orders}) c CROSS JOIN (SELECT 1 AS col UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) x
        UNION ALL SELECT DISTINCT o_custkey, CASE o_custkey % 5 WHEN 0 THEN 'Recap' WHEN 1 THEN 'Sheet' ELSE 'Bill' END, CAST(2 + o_custkey % 3 AS INT), h.col, CASE WHEN h.col > 1 AND o_custkey % 7 = 0 THEN concat('x', CAST(h.col AS VARCHAR(2))) ELSE h.name END
        FROM {orders} CROSS JOIN (SELECT 1 AS col, 'Particulars' AS name UNION ALL SELECT 2, 'UOM' UNION ALL SELECT 3, 'Qty' UNION ALL SELECT 4, 'Unit Rate' UNION ALL SELECT 5, 'Amount') h
        UNION ALL SELECT DISTINCT o_custkey, 'Sheet', 1, 1, CASE WHEN o_custkey % 2 = 0 THEN 'Quotation summary' ELSE 'Works' END FROM {orders} WHERE o_custkey % 5 = 1""",
    "merged": "SELECT DISTINCT o_custkey AS boq_id, 1 AS min_row, 1 AS max_row, 1 AS min_col, 4 AS max_col, concat('Customer ', CAST(o_custkey AS VARCHAR(12))) AS anchor FROM {orders} WHERE o_custkey % 5 = 0",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection, or a driver table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{x: view(spark, sf_dir, x) for x in used})


def with_views(*names: str) -> str:
    """The WITH list of these projections and what they need, for the SQL of a query."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            for x in re.findall(r"\{(\w+)\}", VIEWS[name]):
                add(x)
            out[name] = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])

    for name in names:
        add(name)
    return ", ".join(f"{k} AS ({v})" for k, v in out.items())
