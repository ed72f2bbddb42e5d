"""Pricing, library and tender operators on small tables, against plain versions and asserted values."""

from __future__ import annotations

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quantra.functions import scores
from quantra.functions import text as X
from quantra.operators import commercial, grid, library, matching, promotion, sinks, tender
from quantra.operators.textindex import set_scores
from quantra.plans import imports, pricing, tenders
from quantra.sources import tables
from quantra.streaming import incremental


def values(spark, function, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in rows.select("i", function("x").alias("v")).orderBy("i").collect()]


def test_text_functions(spark):
    assert values(spark, X.normalize_text, "Ø0.3 – 0.7 m³/min", "The Tonnes of Litres, 5 Hrs", "C.F.M type", None, "tons") == ["0.3 0.7 m3/min", "ton litre 5 hr", "cfm", "", "tons"]
    assert values(spark, X.normalize_unit, "No", "m^2", "tonne", "kW", "No.", "furlong", "m³") == ["nr", "m2", "ton", "kw", "no.", "furlong", "m3"]
    assert values(spark, X.normalize_region, "NRB", " kisumu ", "coast a/b", "") == ["Nairobi", "Nyanza", "Coast A/B", ""]
    assert values(spark, X.safe_number, "1,250.5", "12d", "", "abc", " 7 ") == [1250.5, None, None, None, 7.0]
    assert values(spark, X.sheet_section, "Bill No. 3 Earthworks", "Plant Hire", "Contractor's Equipment", "x") == ["Earthworks", "Dayworks", "Dayworks", ""]
    assert values(spark, X.heading_like, "ALL UPPER CASE WORDS IN ONE LONG LINE", "short", "one two three four five six seven", "ends with colon but is rather long:") == [True, True, False, True]
    assert values(spark, X.bullet_text, "- Supply pipes:", "--x", "y") == ["Supply pipes", "x", "y"]
    assert values(spark, X.slugify, "a b--C", "//", "x_") == ["a_b_C", "output", "x"]


def test_scores(spark):
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            old = row[:]
            for j, d in enumerate(b, 1):
                row[j] = old[j - 1] + 1 if c == d else max(old[j], row[j - 1])
        return row[-1]

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(12))) for _ in "xy")
        assert scores.lcs(a, b) == slow(a, b)
    pairs = spark.createDataFrame([("red ring", "ring red"), ("red ring", "red"), ("a b c", "c d"), ("", "")], "a string, b string")
    got = pairs.select(scores.token_sort(F.col("a"), F.col("b")).alias("s"), scores.token_set(F.col("a"), F.col("b")).alias("t")).collect()
    assert got[0].s == 100 and got[0].t == 100 and got[1].t == 100 and got[3].s == 100


LIBRARY = [(1, "PL001", "15 tonne tipper lorry", "Dayworks", "day", 18500, "Nyanza", "hire", 4.0, True), (2, "CO001", "concrete class 25", "Concrete", "m3", 12000, "Nyanza", "", 3.0, True), (3, "XX", "tipper lorry 15 ton", "Dayworks", "day", 1, "Nyanza", "x", 9.0, False)]


def database(spark):
    lib = spark.createDataFrame(LIBRARY, "ordinal int, item_code string, description string, section string, unit string, rate int, region string, basis string, confidence_hint double, active boolean").withColumn("rate", F.col("rate").cast("decimal(18,2)"))
    alias = spark.createDataFrame([(1, "tipper", "tipper lorry", "Dayworks")], "ordinal int, alias string, canonical_term string, section_bias string")
    rules = spark.createDataFrame([(1, "earthworks", "Earthworks", 100), (2, "tipper", "Dayworks", 50)], "ordinal int, trigger_text string, inferred_section string, priority int")
    inputs = spark.createDataFrame([(1, "CEM", 850, "Nyanza", True), (2, "SAND", 100, "Coast", True)], "ordinal int, input_code string, rate int, region string, active boolean").withColumn("rate", F.col("rate").cast("decimal(18,2)"))
    recipes = spark.createDataFrame([(1, "R1", "blinding layer", "m3", "Concrete", "CEM", 6.0, 0.05), (2, "R1", "", "", "", "SAND", 1.0, 0.0)], "ordinal int, recipe_id string, output_description string, output_unit string, section string, component_code string, factor double, waste_factor double")
    adj = spark.createDataFrame([(1, "Nyanza", "*", 1.02, "base", True), (2, "nyanza", "Dayworks", 1.05, "exact", True)], "ordinal int, region string, section string, factor double, notes string, active boolean")
    return pricing.Database(lib, alias, rules, inputs, recipes, adj)


LINES = "boq_id int, sheet_name string, row_number int, description string, unit string, quantity decimal(18,4), region string, is_heading boolean, is_summary_row boolean"


def test_price(spark):
    from decimal import Decimal as D

    lines = spark.createDataFrame([(1, "Bill 1", 1, "Earthworks", "", None, "Nyanza", True, False), (1, "Plant", 2, "15 tonne tipper", "day", D(2), "Nyanza", False, False), (1, "Bill 1", 3, "Blinding layer", "m3", D(3), "Nyanza", False, False), (1, "Bill 1", 4, "Total", "", None, "Nyanza", False, True)], LINES)
    got = {r.row_number: r for r in pricing.price(lines, database(spark)).collect()}
    assert set(got) == {2, 3}
    tip, layer = got[2], got[3]
    assert tip.matched_item_code == "PL001" and tip.decision == "matched" and tip.rate == D("19425.00") and tip.base_rate == D("18500.00") and tip.inferred_section == "Dayworks"
    assert layer.built_up and layer.matched_item_code == "R1" and layer.base_rate == D("5455.00") and layer.rate == D("5564.10") and "Build-up fallback used" in layer.flags
    totals = commercial.quotation_totals(pricing.price(lines, database(spark))).first()
    assert totals.subtotal == 2 * D("19425.00") + 3 * D("5564.10") and totals.processed_items == 2


def test_unit_mismatch_is_flagged(spark):
    lines = spark.createDataFrame([(1, "Plant", 1, "15 tonne tipper lorry", "m3", None, "Nyanza", False, False)], LINES)
    db = database(spark)
    row = matching.best_matches(matching.apply_aliases(matching.infer_sections(matching.heading_context(lines), db.rules), db.aliases), db.library).first()
    assert "unit mismatch: boq=m3 library=day" in row.flags and row.review_flag


def test_quotation_arithmetic(spark):
    rows = spark.createDataFrame([(1, "A", "matched", 10, 100, False, False)], "boq_id int, section string, decision string, quantity int, rate int, review_flag boolean, flagged boolean")
    got = commercial.quotation_totals(rows.withColumn("rate", F.col("rate").cast("decimal(18,2)"))).first()
    assert [float(x) for x in (got.subtotal, got.overhead_amount, got.profit_amount, got.risk_amount, got.pre_vat_total, got.grand_total)] == [1000, 80, 50, 30, 1160, 1345.6] and got.bid_ready
    terms = commercial.Terms.resolve({"vat_pct": "10"}, {"vat_pct": "16", "profit_pct": "x", "risk_pct": " 3 "})
    assert (terms.vat, terms.profit, terms.risk) == ("10", "0", "3.0")


def test_greedy_keep_equals_replay(spark):
    for seed in range(2):
        r = random.Random(seed)
        rows = [(k, r.choice([None, *"abcdef"]), r.choice([None, *"uvwxyz"])) for k in range(40)] + [(100 + k, f"c{(k + 1) // 2}", f"d{k // 2}") for k in range(24)]
        codes, texts, expected = set(), set(), {}
        for k, c, t in rows:
            expected[k] = not (c is not None and c in codes or t is not None and t in texts)
            if expected[k]:
                codes.add(c)
                texts.add(t)
        table = spark.createDataFrame(rows, "ordinal long, code_key string, text_key string")
        assert {x.ordinal: x.kept for x in library.greedy_keep(table).collect()} == expected


def test_import_routing(spark):
    old = spark.createDataFrame([(1, "A", "steel bar", "m", 10.0), (2, "B", "sand", "m3", 5.0)], "ordinal long, item_code string, description string, unit string, rate double")
    new = spark.createDataFrame([(1, "A", "other", "m", 10.0), (2, "C", "Sand", "m3", 6.0), (3, "D", "gravel", "m3", 7.0), (4, "D", "x", "", 7.5), (5, "", "gravel", "m3", 7.0)], old.schema)
    got = {r.ordinal: (r.outcome, r.matched_code) for r in library.route_import(old, new).collect()}
    assert got == {1: ("skip", "A"), 2: ("candidate", "C"), 3: ("append", None), 4: ("candidate", "D"), 5: ("skip", "3")}
    summary = library.import_summary(new, library.route_import(old, new), "RateLibrary", "f.csv").first()
    assert (summary.total_rows, summary.appended, summary.skipped_duplicates, summary.candidates_created, summary.blank_descriptions) == (5, 1, 2, 2, 0)


def test_import_kinds(spark):
    source = spark.createDataFrame([(1, "L1", "Mason", "day", "1,500", ""), (2, "L2", "", "day", "9", ""), (3, "L3", "Helper", "day", "700", "NRB")], "ordinal long, Code string, Description string, Unit string, Rate string, Region string")
    old = spark.createDataFrame([(1, "L3", "helper", "day", 650.0)], "ordinal long, item_code string, description string, unit string, rate double")
    got = imports.import_rates(source, old, "labour", "2026-01-02T03:04:05", "labour.csv", source="Yard")
    row, candidate = got.appended.first(), got.candidates.first()
    assert (row.section, row.crew_type, row.source, row.basis, float(row.rate)) == ("Dayworks", "labour", "Yard", "Imported source table", 1500.0) and got.appended.columns == ["ordinal", *library.LIBRARY_COLUMNS]
    assert got.candidates.columns == ["ordinal", *library.CANDIDATE_COLUMNS] and (candidate.import_batch_id, candidate.duplicate_reason, candidate.region) == ("import-20260102T030405", "duplicate item_code", "Nairobi")
    assert got.summary.first().blank_descriptions == 1
    inputs = imports.import_rates(source, spark.createDataFrame([], "ordinal long, input_code string, description string, unit string, rate double"), "buildup-inputs", "2026-01-02T03:04:05", "x.csv", input_type="labour")
    assert inputs.target == "BuildUpInputs" and {r.input_type for r in inputs.appended.collect()} == {"labour"} and inputs.appended.columns == ["ordinal", *library.INPUT_COLUMNS]
    with pytest.raises(ValueError, match="no import kind"):
        imports.import_rates(source, old, "other", "", "")
    typed = spark.createDataFrame([(1, "A", "x")], "ordinal long, Code string, Type string")  # a header of stop words alone meets the name `type`
    assert library.to_inputs(typed.withColumn("Description", F.lit("d")), "f").first().input_type == "x"

def test_source_mapping(spark):
    source = spark.createDataFrame([(1, "IMP1", "Cement", "", "Bag", "1,200", "kisumu"), (2, "IMP2", "", "", "m2", "3", "")], "ordinal long, Code string, Particulars string, name string, UOM string, `Unit Rate` string, County string")
    row = library.to_library(source, "f.csv", overrides={"section": "Materials"}).collect()
    assert len(row) == 1 and (row[0].item_code, float(row[0].rate), row[0].region, row[0].section, row[0].source, row[0].active) == ("IMP1", 1200.0, "Nyanza", "Materials", "f.csv", True)


def test_review_and_promotion(spark):
    cand = spark.createDataFrame([(1, "tip", "tipper", "", 5.0, "", "aliases"), (2, "X", "sand", "m3", 5.0, "", "ratelibrary"), (3, "X", "sand", "m3", 6.0, "", "ratelibrary")], "candidate_row_number long, item_code string, description string, unit string, rate double, reviewer_status string, promote_target string").withColumn("rate", F.col("rate").cast("decimal(18,2)"))
    dec = spark.createDataFrame([(1, "2024-01-01", 1, "rejected", 1.0), (2, "2024-01-02", 1, "approved", 0.0), (3, "2024-01-01", 2, "merge", 9.0), (4, "2024-01-01", 3, "approved", 0.0)], "event_id long, ts string, candidate_row_number long, reviewer_status string, approved_rate double").withColumn("approved_rate", F.col("approved_rate").cast("decimal(18,2)"))
    merged = library.merge_reviews(cand, dec)
    assert {r.candidate_row_number: r.log_label for r in merged.collect()} == {1: "review-approved", 2: "review-approved", 3: "review-approved"}
    db = database(spark)
    made = promotion.promote(merged, db.aliases, db.library, "2026-01-01T00:00:00")
    assert {r.candidate_row_number: (r.target, r.promotion_status) for r in made.looked.collect()} == {1: ("aliases", "promoted"), 2: ("ratelibrary", "promoted"), 3: ("ratelibrary", "already_exists")}
    assert [(r.item_code, float(r.rate), r.unit, r.basis) for r in made.library.collect()] == [("X", 9.0, "m3", "Estimator-reviewed promotion")] and made.library.columns[1:] == library.LIBRARY_COLUMNS


def test_a_reviewed_alias_is_promoted_once(spark):
    """One candidate, approved as an alias of another term; a second run finds it handled, and in the table."""
    names = ["candidate_row_number", *library.CANDIDATE_COLUMNS]
    given = {"candidate_row_number": 2, "item_code": "PL001X", "description": "Tipper truck hire", "section": "Dayworks", "unit": "day", "rate": 17800.0, "confidence_hint": 72.0, "matched_item_code": "PL001", "promote_target": "candidatematches"}
    rows = [given, given | {"candidate_row_number": 3, "description": " tipper TRUCK hire "}, given | {"candidate_row_number": 4, "promote_target": "archive", "reviewer_status": "approved"}, given | {"candidate_row_number": 5, "description": "", "promote_target": "ratelibrary", "reviewer_status": "merge"}, given | {"candidate_row_number": 6, "reviewer_status": "Approved "}]
    kinds = {"candidate_row_number": "long", "rate": "double", "confidence_hint": "double", "confidence_override": "double", "approved_rate": "double", "active": "boolean"}
    cand = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in names))
    dec = spark.createDataFrame([(1, "2026-03-17", 2, "approved", "aliases", "tipper lorry", 91.0, "Prefer alias"), (2, "2026-03-17", 3, "Approved", "Aliases", "Tipper Lorry", None, ""), (3, "2026-03-18", 99, "approved", "aliases", "x", None, ""), (4, "2026-03-18", 5, " ", "", "", None, "")], "event_id long, ts string, candidate_row_number long, reviewer_status string, promote_target string, approved_canonical_term string, confidence_override double, reviewer_note string")
    none = spark.createDataFrame([], "alias string, canonical_term string, section_bias string, notes string"), spark.createDataFrame([], "item_code string, description string, unit string")
    review = imports.review_cycle(cand, dec, *none, "2026-03-20T00:00:00", "Senior QS", "db")
    made = review.promotion
    assert [tuple(r)[1:] for r in made.aliases.collect()] == [("Tipper truck hire", "tipper lorry", "Dayworks", "Prefer alias")] and made.aliases.columns[1:] == promotion.ALIAS_COLUMNS
    assert {r.candidate_row_number: r.promotion_status for r in made.candidates.collect()} == {2: "promoted", 3: "already_exists", 4: "promoted", 5: "already_exists", 6: "retained_in_candidates"}
    assert tuple(review.summary.first()) == (2, 0) and tuple(made.summary.first()) == (3, 2, 5)
    log = {r.row_number: r for r in review.log.collect()}
    assert set(log) == {2, 3} and (log[2].decision, log[2].confidence_score, log[2].matched_item_code, log[2].reviewer_note, log[3].confidence_score, log[3].reviewer_note) == ("review-approved", 91.0, "PL001", "Prefer alias", 72.0, "hold")
    logged = {r.row_number: (r.sheet_name, r.decision) for r in made.log.collect()}
    assert logged[2] == ("aliases", "promoted-to-aliases") and logged[4] == ("archive", "promoted-to-archive") and logged[6][0] == "CandidateMatches" and made.log.columns == library.LOG_COLUMNS
    assert len(json.loads(made.training.first().json)) == 19
    again = promotion.promote(made.candidates, made.aliases, none[1], "2026-03-21T00:00:00")
    assert {r.candidate_row_number: r.promotion_status for r in again.looked.collect()} == {3: "already_exists", 5: "already_exists"} and again.aliases.count() == 0


def test_tender(spark):
    docs = spark.createDataFrame([(1, "NOTICE\r\n\r\nTenderers shall submit a bid bond of 2% within 14 days.\nConcrete works:\nconcrete class 25 in bases\nconcrete class 25 in bases\nprovisional sum"), (2, None)], "doc_id long, text string")
    lines = tables.text_lines(docs)
    assert [(r.line_no, r.source_reference) for r in lines.orderBy("line_no").collect()] == [(1, "L1"), (3, "L3"), (4, "L4"), (5, "L5"), (6, "L6"), (7, "L7")]
    phrases = spark.createDataFrame([("securities", 1, "bid bond", 1, "CM")], "category string, cat_ord int, phrase string, phrase_ord int, owner string")
    req = tender.requirements(lines, phrases).first()
    assert (req.requirement_id, req.confidence, req.description, req.mandatory, req.review_flag) == ("REQ-001", 96.0, "Securities: 2%", True, False)
    scopes = spark.createDataFrame([("Concrete", 1, "concrete", 1), ("Provisional Items", 2, "provisional", 1)], "section string, sec_ord int, keyword string, key_ord int")
    sections, drafts = tender.scope_sections(lines, scopes), tender.draft_suggestions(lines, scopes)
    assert {r.section: r.confidence for r in sections.collect()} == {"Concrete": 78.0, "Provisional Items": 78.0}
    assert [(r.section, r.description, r.unit) for r in drafts.orderBy("suggestion_ord").collect()] == [("Concrete", "Concrete works", "m3"), ("Concrete", "concrete class 25 in bases", "m3"), ("Provisional Items", "provisional sum", "sum")]
    bill = spark.createDataFrame([(1, "Concrete", "concrete class 25")], "doc_id long, section string, key string")
    found = tender.gaps(sections, drafts, bill)
    assert {(r.gap_type, r.section) for r in found.collect()} == {("Missing Section", "Provisional Items"), ("Missing Item", "Concrete"), ("Missing Item", "Provisional Items"), ("Measurement Clarification", "Provisional Items")}
    rows = tender.handoff(drafts, found)
    assert rows.count() == 5 and [r.source_origin for r in rows.orderBy("handoff_ord").collect()] == ["tender_draft"] * 3 + ["gap_check"] * 2
    assert len(tender.handoff_table(rows, True).columns) == 13 and tender.handoff_table(rows, False).count() == 3 and tender.placeholders(sections, lines.limit(0)).count() == 2
    files = docs.withColumn("path", F.expr("concat('in/t', doc_id, '.txt')")).withColumn("title", F.lit(""))
    named = {r.doc_id: (r.document_name, r.document_type, r.title, r.line_count) for r in tender.assembled(lines, files).collect()}
    assert named == {1: ("t1.txt", "text", "NOTICE", 6), 2: ("t2.txt", "text", "t2", 0)}
    with pytest.raises(Exception, match="unsupported tender document"):
        tender.assembled(lines, files.withColumn("path", F.lit("a.pdf"))).collect()


def test_tender_price_without_a_bill(spark):
    docs = spark.createDataFrame([(1, "NOTICE\nhire of 15 tonne tipper lorry\nconcrete class 25 in bases"), (2, "nothing of note")], "doc_id long, text string")
    words = tenders.Dictionary(
        spark.createDataFrame([("securities", 1, "bid bond", 1, "CM")], "category string, cat_ord int, phrase string, phrase_ord int, owner string"),
        spark.createDataFrame([("Concrete", 1, "concrete", 1), ("Dayworks", 2, "tipper", 1)], "section string, sec_ord int, keyword string, key_ord int"),
        spark.createDataFrame([("unclear_scope", 1, "hire", )], "category string, cat_ord int, pattern string"),
    )
    got = tenders.tender_price(docs, words, database(spark), "Nyanza")
    priced = {r.description: r.matched_item_code for r in got.results.collect()}
    assert priced == {"hire of 15 tonne tipper lorry": "PL001", "concrete class 25 in bases": "CO001"}
    made = {r.doc_id: json.loads(r.json) for r in got.json.collect()}
    assert len(made[1]["pricing_handoff_rows"]) == 2 and made[1]["quotation_summary"]["processed_items"] == 2 and made[1]["counts"]["tender_draft"] == 2 and made[2]["tender_summary"][0]["draft_suggestions"] == 0
    assert tenders.draft_boq(docs, words).gaps.count() == 0 and set(tenders.gap_check(docs, words).tables()) == {"summary", "checklist", "scope", "drafts", "gaps", "clarifications", "requirements"}


def test_leading_items_keep_every_best_match(spark):
    r = random.Random(4)
    texts = ["red ring", "small red ring", "blue bolt", "large gear"]
    items = [(k, f"I{k}", r.choice(texts), r.choice(["A", "B", ""]), r.choice(["m2", "nr", "day", ""]), 10 + k, r.choice(["N", "S", ""]), "", float(r.randrange(8)), True) for k in range(300)]
    lib = spark.createDataFrame(items, "ordinal int, item_code string, description string, section string, unit string, rate int, region string, basis string, confidence_hint double, active boolean")
    lines = spark.createDataFrame([(k, "s", k, r.choice([*texts, "red bolt"]), r.choice(["m2", "nr", ""]), r.choice(["A", "C", ""]), r.choice(["N", "S", ""])) for k in range(40)], "boq_id int, sheet_name string, row_number int, query string, unit string, inferred_section string, region string")
    lines = lines.withColumn("alias_hits", F.array().cast("array<struct<a:string,b:string>>"))
    got = {x.boq_id: (x.matched_item_code, x.raw_score, [a.split(" | ")[0] for a in x.alternates]) for x in matching.best_matches(lines, lib).collect()}
    w = matching.Weights()
    whole = lambda a, b: 0.45 * scores.ratio(*(" ".join(sorted(x.split())) for x in (a, b))) + 0.20 * scores.partial(a, b) + 0.35 * set_scores([sorted(set(a.split()))], [sorted(set(b.split()))])[0]
    score = {(x.query, t): whole(x.query, t) for x in lines.collect() for t in texts}
    for line in lines.collect():
        ranked = []
        for k, code, text, section, unit, _, region, _, hint, _ in items:
            s = score[line.query, text] + (w.section if section and section == line.inferred_section else 0) + (w.region if region and region == line.region else 0)
            s += (w.unit if unit == line.unit else -w.unit_penalty * 1.25) if unit and line.unit else 0
            ranked.append((-(s + hint), k, code))
        ranked.sort()
        assert got[line.boq_id][0] == ranked[0][2] and got[line.boq_id][1] == pytest.approx(-ranked[0][0])
        assert got[line.boq_id][2] == [c for s, _, c in ranked[1:4] if -s >= w.review]

def test_grid(spark):
    data = {1: ["Project X"], 2: ["Particulars", "UOM", "Qty", "Unit Rate", "Total"], 3: ["Earthworks"], 4: ["Excavate foundations", "m3", "12", "", ""], 5: ["Subtotal"], 11: ["after the gap", "nr", "1"]}
    cells = [(1, s, r, c + 1, v) for s in ("Bill 1", "Summary") for r, vs in data.items() for c, v in enumerate(vs)]
    table = spark.createDataFrame(cells, "boq_id int, sheet_name string, row int, col int, value string")
    merged = spark.createDataFrame([(1, "Bill 1", 1, 1, 1, 5, "Project X")], "boq_id int, sheet_name string, min_row int, max_row int, min_col int, max_col int, anchor string")
    got = grid.grid_lines(table, merged).collect()
    assert [(r.sheet_name, r.row_number, r.description, r.is_heading) for r in sorted(got, key=lambda r: r.row_number)] == [("Bill 1", 3, "Earthworks", True), ("Bill 1", 4, "Excavate foundations", False)]
    m = grid.column_maps(grid.filled(table, merged)).where("sheet_name = 'Bill 1'").first()
    assert (m.header_row, m.description_col, m.unit_col, m.quantity_col, m.rate_col, m.amount_col) == (2, 1, 2, 3, 4, 5)


def test_scans_and_sinks(spark, tmp_path):
    raw = spark.createDataFrame([(1, " vat_pct ", "16"), (2, "vat_pct", "18"), (3, "x", "0"), (4, "", "1")], "ordinal int, key string, value string")
    assert {r.key: r.value for r in tables.controls(raw).collect()} == {"vat_pct": "18", "x": ""}
    (tmp_path / "in.csv").write_text("﻿code,rate\nA,1\n")
    assert tables.structured(spark, str(tmp_path / "in.csv")).count() == 1
    (tmp_path / "many.csv").write_text("code\n" + "".join(f"c{k:06d}\n" for k in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = tables.structured(spark, str(tmp_path / "many.csv")).orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.code for r in rows] == [f"c{k:06d}" for k in range(4000)] and len({r.ordinal for r in rows}) == 4000
    with pytest.raises(ValueError, match="Aliases, RateLibrary"):
        tables.open_tables(spark, ["RateLibrary", "Aliases"])
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "boq_id int, v string")
    out = str(tmp_path / "t")
    sinks.refresh(rows, out, "boq_id")
    for _ in range(2):
        sinks.refresh(rows.where("boq_id = 2").withColumn("v", F.lit("c")), out, "boq_id")
    assert {(r.boq_id, r.v) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "c")}
    assert sinks.conform(rows, [("v", "string"), ("w", "double")]).columns == ["boq_id", "v", "w"]
    with pytest.raises(ValueError):
        sinks.unmatched_from_stored(rows)


def test_incremental_pricing_equals_batch(spark, tmp_path):
    rows = spark.range(20).selectExpr("cast(id % 4 as int) AS boq_id", "cast(id as int) AS n")
    rows.where("boq_id < 2").write.parquet(str(tmp_path / "in"))
    total = lambda df: df.groupBy("boq_id").agg(F.sum("n").alias("total"))
    go = lambda: incremental.price_new_bills(spark, str(tmp_path / "in"), rows.schema, total, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    go()
    rows.where("boq_id >= 2").write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert {(r.boq_id, r.total) for r in incremental.priced_bills(spark, str(tmp_path / "out")).collect()} == {(r.boq_id, r.total) for r in total(rows).collect()}


def test_decisions_arrive_late_and_again(spark, tmp_path):
    """Files in any order, one of them twice: the table has the last decision of each candidate once, as the batch has it."""
    r = random.Random(5)
    schema = "event_id long, ts string, candidate_row_number long, reviewer_status string, approved_rate double"
    rows = [(n, f"2024-01-{1 + n % 28:02d}", r.randrange(40), r.choice(["approved", "rejected", "pending", "hold"]), float(n)) for n in range(200)]
    table = spark.createDataFrame(rows, schema)
    cand = spark.createDataFrame([(k, "", "") for k in range(45)], "candidate_row_number long, reviewer_status string, promote_target string")
    for part in ("event_id >= 120", "event_id < 60", "event_id BETWEEN 60 AND 119", "event_id < 60"):
        table.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.apply_decisions(spark, str(tmp_path / "in"), table.schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    held = spark.read.parquet(str(tmp_path / "out"))
    live = table.where("reviewer_status <> 'pending'")
    assert held.count() == live.select("candidate_row_number").distinct().count()
    key = lambda df: sorted((x.candidate_row_number, x.reviewer_status, x.approved_rate, x.log_label) if x.approved_rate is not None else (x.candidate_row_number, x.reviewer_status, -1.0, x.log_label) for x in df.collect())
    assert key(incremental.decided(cand, held)) == key(library.merge_reviews(cand, table))


def test_documents_of_one_partition_are_dealt_to_tasks_and_gaps_are_written_once(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('concrete class ', id, ' in bases\\nhire of tipper') AS text").coalesce(1)
    scopes = spark.createDataFrame([("Concrete", 1, "concrete", 1), ("Dayworks", 2, "tipper", 1)], "section string, sec_ord int, keyword string, key_ord int")
    phrases = spark.createDataFrame([], "category string, cat_ord int, phrase string, phrase_ord int, owner string")
    patterns = spark.createDataFrame([], "category string, cat_ord int, pattern string")
    bill = docs.selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN 'Concrete' ELSE 'Other' END AS section", "'S' AS sheet_name", "1 AS row_number", "concat('class ', doc_id % 4) AS description", "'m3' AS unit", "CAST(1 AS DECIMAL(18,4)) AS quantity", "false AS is_heading", "false AS is_summary_row", "'S!R1' AS source_reference")
    got = tenders.analyze(docs, tenders.Dictionary(phrases, scopes, patterns), bill)
    assert len(got.lines.inputFiles()) > 1
    assert got.gaps.inputFiles() and all("/gaps-" in f for f in got.gaps.inputFiles())
    missing = {(r.doc_id, r.section) for r in got.gaps.where("gap_type = 'Missing Item'").collect()}
    assert missing == {(d, "Dayworks") for d in range(40)} | {(d, "Concrete") for d in range(40) if d % 2 or not f"concrete class {d} in bases".count(f"class {d % 4}")}


def test_the_first_items_of_a_kind_are_all_that_is_read_again(spark):
    names = "ordinal int, item_text string, item_section string, item_region string, item_unit string, item_unit_key string, confidence_hint double"
    r = random.Random(5)
    rows = [(k, r.choice(["red ring", "bolt"]), r.choice(["A", "a", None]), r.choice(["N", ""]), r.choice(["m2", "SQM", ""]), "m2", float(r.randrange(4))) for k in range(400)]
    items = spark.createDataFrame(rows, names).coalesce(1)
    kept = matching.first_items(items)
    kinds = {}
    for k, text, section, region, unit, key, hint in rows:
        kinds.setdefault((text, section and section.lower(), region.lower(), unit and key), []).append((-hint, k))
    assert {x.ordinal for x in kept.collect()} == {k for found in kinds.values() for _, k in sorted(found)[: matching.PLACES]}
    assert {tuple(x) for x in matching.leading_items(kept).collect()} == {tuple(x) for x in matching.leading_items(items).collect()}


def test_whole_bills_equal_lines_joined_to_their_prices(spark):
    """Headings and totals keep their rows without a price, also where a priceable line looks just like them."""
    from decimal import Decimal as D

    tip = ("15 tonne tipper", "day", D(2), "Nyanza")
    rows = [(1, "Plant", 1, *tip, False, False), (1, "Plant", 2, *tip, True, False), (1, "Plant", 3, *tip, False, True), (2, "Plant", 1, *tip, None, False), (2, "Bill 1", 2, "Blinding layer", "m3", D(3), "Nyanza", False, False), (2, "Bill 1", 3, "Total", "", None, "Nyanza", False, True)]
    lines = spark.createDataFrame([*rows, (3, "Plant", 1, *tip, False, False)], LINES)
    db = database(spark)
    plain = sinks.priced_bill(lines, pricing.price(lines, db))
    got = sinks.whole_bill(pricing.price_whole(lines, db), lines.columns)
    assert got.columns == plain.columns and got.dtypes == plain.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert {(r.boq_id, r.row_number): r.amount for r in got.collect() if r.amount is not None} == {(1, 1): D("38850.00"), (2, 2): D("16692.30"), (3, 1): D("38850.00")}


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_a_priced_bill_reads_its_lines_once(spark):
    from quantra.plans.queries_pricing import QUERIES

    got = QUERIES["b01_e06_priced_bill"](spark, SMALL)
    assert not [f for f in got.inputFiles() if "lineitem" in f]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_streamed_bills_are_written_by_all_tasks_of_a_shuffle(spark):
    from quantra.operators.store import shared_folder
    from quantra.plans.queries_grid import QUERIES

    folder = shared_folder(spark).removeprefix("file:")
    held, old = set(glob.glob(f"{folder}/bills-*")), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tasks stay apart
        QUERIES["k01_price_stream"](spark, SMALL)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (made,) = set(glob.glob(f"{folder}/bills-*")) - held
    assert len(glob.glob(f"{made}/in/*.parquet")) == 7


def _many(spark):
    """Lines of two bills, some alike in all but bill, row and quantity, with headings, quotes, line ends and nulls."""
    from decimal import Decimal as D

    rows = []
    for b in (1, 2, 3):
        rows += [(b, "Plant", 1, f"Heading {b % 2}", "", None, "Nyanza", True, False), (b, "Plant", 2, "15 tonne tipper", "day", D(b), "Nyanza", False, False), (b, "Plant", 3, 'Say "so"\n\tor \\ not', None, None, "Coast", False, False)]
        rows += [(b, "Plant", 4, "Blinding layer", "m3", D("0.0001"), "Nyanza", False, False), (b, "Bill 1", 5, None, "m3", D("12345678901234.5"), None, False, False), (b, "Bill 1", 6, "", "", D(0), "", False, False), (b, "Bill 1", 7, "Total", "", None, "Nyanza", False, True)]
    return spark.createDataFrame(rows, LINES)


def test_stored_suggestions_are_whole(spark, tmp_path):
    """Lines and cases apart hold every suggestion, row by row and column by column."""
    lines, db = _many(spark), database(spark)
    cases = pricing.price_cases(lines, db)
    sinks.store_suggestions(cases.lines, sinks.said_of_cases(cases.priced, cases.keys), cases.keys, f"{tmp_path}/s")
    plain, got = sinks.suggestions(pricing.price(lines, db)), sinks.stored_suggestions(spark, f"{tmp_path}/s")
    assert got.dtypes == plain.dtypes and len(got.columns) == 24 and got.count() == 15
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert sorted(map(str, sinks.unmatched_from_stored(got).collect())) == sorted(map(str, sinks.unmatched_from_stored(plain).collect()))
    assert spark.read.parquet(f"{tmp_path}/s/cases").count() < 15


def test_lines_are_not_shuffled_where_only_their_contexts_are_many(spark, monkeypatch):
    """Sections and cases are few enough to be sent, the combinations of headings and cases are not."""
    from quantra.operators import store

    lines = spark.sql("SELECT id DIV 4 AS boq_id, 'Plant' AS sheet_name, CAST(id % 4 AS INT) AS row_number, CASE id % 4 WHEN 0 THEN concat('Heading ', id DIV 4 % 20) ELSE '15 tonne tipper' END AS description, concat('u', id % 4) AS unit, CAST(1 AS DECIMAL(18,4)) AS quantity, concat('r', id DIV 80) AS region, id % 4 = 0 AS is_heading, false AS is_summary_row FROM range(800)")
    plain = sorted(map(str, sinks.suggestions(pricing.price(lines, database(spark))).collect()))
    monkeypatch.setattr(store, "SENT_ROWS", 100)  # 600 contexts, 20 sections, 30 cases
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # small files say nothing here
        got = pricing.price(lines, database(spark))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(map(str, sinks.suggestions(got).collect())) == plain and len(plain) == 600


def test_audit_texts_made_by_case_are_those_of_whole_rows(spark):
    lines, db = _many(spark), database(spark)
    cases = pricing.price_cases(lines, db)
    run = {"run": 'o"ne', "more": "x"}
    got = sinks.audited(cases.whole(sinks.audited_cases(cases.priced, cases.keys, run)))
    plain = sinks.audit_json(pricing.price(lines, db), run)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() == 15
    wide = cases.whole(sinks.audited_cases(cases.priced, cases.keys, run)).withColumn("quantity", F.col("quantity").cast("double") / 3)
    texts = sinks.audit_json(pricing.price(lines, db).withColumn("quantity", F.col("quantity").cast("double") / 3), run)
    assert sorted(map(str, sinks.audited(wide).collect())) == sorted(map(str, texts.collect()))
