"""Large ranges and long sheets, spread over tasks, against plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quantra.operators import grid, matching, tender
from quantra.plans import pricing


def test_merged_ranges_meet_cells_by_tiles(spark):
    r = random.Random(1)
    cells = {(s, row, col): r.choice(["", "x", " y ", None]) for s in ("A", "B") for row in range(1, 40) for col in range(1, 9) if r.random() < 0.6}
    ranges = [("A", 1, 3, 1, 8, "top"), ("A", 2, 30, 2, 4, "mid"), ("A", 250, 260, 30, 70, "far"), ("B", 5, 5, 5, 5, "one")]
    got_rows = grid.filled(spark.createDataFrame([(1, *k, v) for k, v in cells.items()], "boq_id int, sheet_name string, row int, col int, value string"), spark.createDataFrame([(1, *x) for x in ranges], "boq_id int, sheet_name string, min_row int, max_row int, min_col int, max_col int, anchor string")).collect()
    want = {k: (v or "") for k, v in cells.items()}
    for s, a, b, c, d, anchor in sorted(ranges, key=lambda x: x[-1], reverse=True):
        for row in range(a, b + 1):
            for col in range(c, d + 1):
                if not cells.get((s, row, col)):
                    want[s, row, col] = anchor
    got = {(x.sheet_name, x.row, x.col): x.value for x in got_rows}
    assert len(got) == len(got_rows) and got == {k: v.strip() for k, v in want.items()}


def test_one_very_large_range(spark):
    cells = spark.range(1, 100_001).select(F.lit(1).alias("boq_id"), F.lit("S").alias("sheet_name"), F.col("id").cast("int").alias("row"), F.lit(3).alias("col"), F.when(F.col("id") % 2 == 0, F.lit("own")).otherwise(F.lit("")).alias("value"))
    merged = spark.createDataFrame([(1, "S", 1, 100_000, 1, 20, "anchor")], "boq_id int, sheet_name string, min_row int, max_row int, min_col int, max_col int, anchor string")
    out = grid.filled(cells, merged)
    counts = {r.value: r["count"] for r in out.groupBy("value").count().collect()}
    assert counts == {"own": 50_000, "anchor": 1_950_000}


def plain_headings(rows: list[tuple]) -> dict:
    out, seen = {}, {}
    for boq, sheet, number, text, heading in sorted(rows, key=lambda x: x[:3]):
        out[boq, sheet, number] = seen.get((boq, sheet), [])[-5:]
        if heading:
            seen.setdefault((boq, sheet), []).append(text)
    return out


def test_headings_carry_over_blocks(spark, monkeypatch):
    schema = "boq_id int, sheet_name string, row_number int, description string, is_heading boolean"
    for seed, block, share in ((1, 4, 0.3), (2, 7, 0.05), (3, 1, 0.9), (4, 4096, 0.3)):
        monkeypatch.setattr(matching, "BLOCK", block)
        r = random.Random(seed)
        rows = [(b, s, n, f"t{n}", r.random() < share) for b in (1, 2) for s in ("x", "y") for n in sorted(r.sample(range(1, 200), 60))]
        table = spark.createDataFrame(rows, schema).repartition(3)
        got = {(x.boq_id, x.sheet_name, x.row_number): x.headings for x in matching.heading_context(table).collect()}
        assert got == plain_headings(rows)


def test_a_sheet_of_a_million_rows(spark):
    lines = spark.range(1_000_000).select(F.lit(1).alias("boq_id"), F.lit("S").alias("sheet_name"), F.col("id").cast("int").alias("row_number"), F.concat(F.lit("t"), "id").alias("description"), (F.col("id") % 1000 == 0).alias("is_heading"))
    got = matching.heading_context(lines).where("row_number IN (0, 4999, 5000, 999999)").select("row_number", "headings").collect()
    heads = lambda *k: [f"t{x}000" if x else "t0" for x in k]
    assert {x.row_number: x.headings for x in got} == {0: [], 4999: heads(0, 1, 2, 3, 4), 5000: heads(0, 1, 2, 3, 4), 999999: heads(995, 996, 997, 998, 999)}


def test_lines_that_agree_are_priced_once(spark, monkeypatch):
    """The steps that look at texts get distinct lines, whatever the number of lines."""
    seen = {}

    def counted(name):
        f = getattr(matching, name)

        def run(rows, *more):
            seen[name] = rows.count()
            return f(rows, *more)

        monkeypatch.setattr(matching, name, run)

    for name in ("infer_sections", "apply_aliases", "best_matches"):
        counted(name)
    lines = spark.sql("SELECT id DIV 10 AS boq_id, 'Sheet' AS sheet_name, CAST(id % 10 AS INT) AS row_number, CASE id % 10 WHEN 0 THEN 'Works' ELSE concat('item ', id % 3) END AS description, CASE id % 2 WHEN 0 THEN 'm2' END AS unit, CAST(id AS DECIMAL(18,4)) AS quantity, 'N' AS region, id % 10 = 0 AS is_heading, false AS is_summary_row FROM range(2000)")
    empty = lambda s: spark.createDataFrame([], s)
    db = pricing.Database(
        spark.createDataFrame([(k, f"I{k}", f"item {k}", "A", "m2", 10 + k, "N", "list", 1.0, True) for k in range(3)], "ordinal int, item_code string, description string, section string, unit string, rate int, region string, basis string, confidence_hint double, active boolean"),
        empty("ordinal int, alias string, canonical_term string, section_bias string"), empty("ordinal int, trigger_text string, inferred_section string, priority int"), empty("ordinal int, input_code string, rate decimal(18,2), region string, active boolean"),
        empty("ordinal int, recipe_id string, output_description string, output_unit string, section string, component_code string, factor double, waste_factor double"), empty("ordinal int, region string, section string, factor decimal(9,4), notes string, active boolean"),
    )
    got = pricing.price(lines, db).select("boq_id", "row_number", "quantity", "description", "unit", "matched_item_code", "headings").collect()
    assert len(got) == 1800 and {int(r.quantity) for r in got} == {k for k in range(2000) if k % 10}
    assert all(r.matched_item_code == f"I{r.description[-1]}" and r.headings == ["Works"] and r.boq_id * 10 + r.row_number == r.quantity for r in got)
    assert seen == dict.fromkeys(("infer_sections", "apply_aliases", "best_matches"), 6)


def test_cells_are_read_once_and_lines_are_those_of_the_rule(spark):
    """Without merged ranges a cell is read once, and sheets of many shapes give the header, columns and lines that the rules say."""
    r = random.Random(8)
    head = ["Particulars", "UOM", "Qty", "Unit Rate", "Amount"]
    rows = []
    for b in range(30):
        at = 1 + b % 4
        rows += [(b, "Sheet" if b % 3 else "Bill", at, c + 1, h) for c, h in enumerate(head) if c < 3 or b % 2]
        k = at
        for n in range(12):
            k += r.choice([1, 1, 1, 2, 6])
            rows += [(b, "Sheet" if b % 3 else "Bill", k, c + 1, v) for c, v in enumerate([f"item {n}", "m2", str(n + 1), "2.5", ""]) if c < 4]
    rows += [(30, "Sheet", 1, 1, "Match"), (30, "Sheet", 1, 2, "suggestions"), (30, "Sheet", 9, 1, "x"), (31, "Sheet", 9, 1, "recap")]
    schema, read = "boq_id int, sheet_name string, row int, col int, value string", spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            read.add(len(x))
            yield x

    table = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "boq_id int, sheet_name string, min_row int, max_row int, min_col int, max_col int, anchor string")
    maps, lines = grid.sheets(table.mapInPandas(counted, schema), none)
    got = {(x.boq_id, x.row_number): (x.description, x.unit, x.quantity, x.rate) for x in lines.collect()}
    assert read.value == len(rows)
    assert {x.boq_id: x.header_row for x in maps.collect() if x.boq_id < 30} == {b: 1 + b % 4 for b in range(30)} and {x.boq_id for x in maps.collect()} == {*range(30), 31}
    for b in range(30):
        own, last = sorted({x[2] for x in rows if x[0] == b and x[2] > 1 + b % 4}), None
        for k in own:
            if last is not None and k - last > 5:
                assert (b, k) not in got
                break
            assert got[b, k][1:] == ("m2", got[b, k][2], 2.5) and got[b, k][0] == f"item {int(got[b, k][2]) - 1}"
            last = k


def test_handoff_rows_are_dealt_once(spark):
    """First rows and their numbers are found where a document's rows are: texts are not shuffled a second time."""
    drafts = spark.createDataFrame([(1, 1, "A", "two words", "m", "TBD", "x", "L1", 60.0), (1, 2, "A", "Two  Words", "m", "TBD", "x", "L2", 60.0)], "doc_id int, suggestion_ord int, section string, description string, unit string, quantity_placeholder string, source_basis string, source_reference string, confidence double")
    bill = spark.createDataFrame([(1, "A", "Bill", k, t, "m", 1.0, False, False, f"Bill!R{k}") for k, t in ((1, "one"), (2, "ONE"), (3, "two"))], "doc_id int, section string, sheet_name string, row_number int, description string, unit string, quantity double, is_heading boolean, is_summary_row boolean, source_reference string")
    made = tender.handoff(drafts, drafts, bill.withColumn("quantity", F.col("quantity").cast("decimal(18,4)")), include_gaps=False)
    assert [(r.handoff_ord, r.source_origin, r.description) for r in made.orderBy("handoff_ord").collect()] == [(1, "existing_boq", "one"), (2, "existing_boq", "two"), (3, "tender_draft", "two words")]
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1

