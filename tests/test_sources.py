"""Files as documents, CSV records, imports from folders, and bills from cells and files to quotations, against plain versions."""

from __future__ import annotations

import csv
import dataclasses
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from quantra.operators import commercial, matching, sinks
from quantra.plans import pricing, queries_tender, tenders
from quantra.sources import tables

CSV = [
    'a,b\nc', '"a\nb",c', "﻿x,y\r\nz", 'say "hi",x', '"he said ""no""" tail,z', ",,\n,\n q ,", '"open, never\nclosed', "one", "", "\n\na", '"",""\n"x"', "a\rb", '"a\r\nb"\r\n\r\n"c"', "x,\"y\nz\",\"\n\"\nlast", " \t ,   ,w",
]


def plain_csv(text: str) -> list[tuple]:
    out = []
    for n, row in enumerate(csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")), 1):
        cells = [c for c in (" ".join(x.split()) for x in row) if c]
        if cells:
            out.append((n, f"R{n}", " | ".join(cells)))
    return out


def test_csv_records_match_a_csv_reader(spark):
    r = random.Random(1)
    texts = CSV + ["".join(r.choice(['"', ",", "\n", "a", " ", '""', "b,", "\r\n"]) for _ in range(r.randrange(25))) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts), (9999, None)], "doc_id long, text string")
    got: dict[int, list] = {}
    for row in tables.csv_lines(docs).orderBy("doc_id", "line_no").collect():
        got.setdefault(row.doc_id, []).append((row.line_no, row.source_reference, row.text))
    for n, t in enumerate(texts):
        assert got.get(n, []) == plain_csv(t), repr(t)


def test_a_folder_of_documents(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text("Notice\n\n  two   words   end", encoding="utf-8")
    (tmp_path / "B.MD").write_text("# Title", encoding="utf-8")
    (tmp_path / "deep" / "c.csv").write_bytes('﻿"x\ny",1\n,\n"q ""z"""\n'.encode())
    (tmp_path / "other.pdf").write_bytes(b"%PDF")
    (tmp_path / "empty.txt").write_text(" \n")
    docs = tables.tender_files(spark, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} == {"a.txt", "B.MD", "deep/c.csv", "empty.txt"}
    got = {(r.doc_id, r.source_reference): r.text for r in tables.document_lines(docs).collect()}
    assert got == {("a.txt", "L1"): "Notice", ("a.txt", "L3"): "two words", ("a.txt", "L4"): "end", ("B.MD", "L1"): "# Title", ("deep/c.csv", "R1"): "x y | 1", ("deep/c.csv", "R3"): 'q "z"'}
    none = lambda schema: spark.createDataFrame([], schema)
    words = tenders.Dictionary(none("category string, cat_ord int, phrase string, phrase_ord int, owner string"), none("section string, sec_ord int, keyword string, key_ord int"), none("category string, cat_ord int, pattern string"))
    made = {r.doc_id: (r.document_type, r.title, r.line_count) for r in tenders.analyze(docs, words).documents.collect()}
    assert made == {"a.txt": ("text", "Notice", 3), "B.MD": ("text", "# Title", 1), "deep/c.csv": ("csv", "x y | 1", 2), "empty.txt": ("text", "empty", 0)}
    book = docs.limit(1).withColumn("doc_id", F.lit("w.xlsx")).withColumn("path", F.lit("in/w.xlsx"))
    cells = spark.createDataFrame([("w.xlsx", "S", 2, 1, "one"), ("w.xlsx", "S", 2, 2, "two"), ("a.txt", "S", 1, 1, "no")], "doc_id string, sheet_name string, row int, col int, value string")
    assert [(r.source_reference, r.text) for r in tables.document_lines(book, cells).collect()] == [("S!R2", "one | two")]
    with pytest.raises(Exception, match="unsupported tender document"):
        tables.document_lines(docs.withColumn("path", F.lit("in/x.docx"))).collect()


def test_ordinals_of_a_folder_of_csv_files(spark, tmp_path):
    for name, rows in (("b.csv", "3,4"), ("a.csv", "1,2"), ("c.csv", "5")):
        (tmp_path / name).write_text("Code,Rate\n" + "\n".join(f"I{x},{x}" for x in rows.split(",")), encoding="utf-8")
    got = tables.structured(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r.Code for r in got] == ["I1", "I2", "I3", "I4", "I5"] and len({r.ordinal for r in got}) == 5


def test_priced_bill_keeps_what_it_does_not_price(spark):
    lines = spark.createDataFrame([(1, "S", n, 2.0, r, a, n == 5, n == 6) for n, r, a in ((1, 1.0, 9.0), (2, 1.5, None), (3, None, 7.0), (4, 4.0, 8.0), (5, 5.0, 5.0), (6, 6.0, 1.0))] + [(1, "T", 1, 3.0, 1.0, 2.0, False, False)], "boq_id int, sheet_name string, row_number int, quantity double, rate double, amount double, is_summary_row boolean, amount_is_formula boolean")
    found = spark.createDataFrame([(1, "S", 1, 10.0, "matched"), (1, "S", 2, 10.0, "review"), (1, "S", 4, None, "matched"), (1, "S", 5, 3.0, "matched"), (1, "S", 6, 3.0, "matched"), (1, "T", 1, 10.0, "matched")], "boq_id int, sheet_name string, row_number int, rate double, decision string")
    maps = spark.createDataFrame([(1, "S", 3, 4, 5), (1, "T", 3, 4, None)], "boq_id int, sheet_name string, quantity_col int, rate_col int, amount_col int")
    rows = sinks.priced_bill(lines, found, maps)
    assert rows.columns.count("rate") == 1 and rows.columns.count("amount") == 1
    number = lambda x: None if x is None else float(x)
    got = {(r.sheet_name, r.row_number): (number(r.rate), number(r.amount)) for r in rows.collect()}
    assert got == {("S", 1): (10, 20), ("S", 2): (1.5, None), ("S", 3): (None, 7), ("S", 4): (4, 8), ("S", 5): (5, 5), ("S", 6): (3, 1), ("T", 1): (10, 2)}
    assert {number(r.rate) for r in sinks.priced_bill(lines, found, maps, apply=False).collect()} == {1.0, 1.5, None, 4.0, 5.0, 6.0}


def test_stored_suggestions_with_blanks(spark):
    rows = spark.createDataFrame([("matched", "NO"), ("matched", "yes"), (None, "NO"), ("review", None), ("matched", None)], "decision string, review_flag string")
    assert sinks.unmatched_from_stored(rows).count() == 3


def test_terms_come_from_controls(spark):
    raw = spark.createDataFrame([(1, "vat_pct", "10"), (2, " vat_pct", "12"), (3, "profit_pct", "x"), (4, "risk_pct", ""), (5, "default_approval_status", "Hold"), (6, "z", "1")], "ordinal int, key string, value string")
    terms = commercial.terms_of(tables.controls(raw), {"overheads_pct": "7"})
    assert (terms.overhead, float(terms.profit), float(terms.risk), float(terms.vat), terms.default_status) == ("7", 0, 0, 12, "Hold")
    assert float(commercial.terms_of(None).vat) == 16


GRID = {1: ["Project X"], 2: ["Particulars", "UOM", "Qty", "Unit Rate", "Total"], 3: ["Dayworks"], 4: ["hire of 15 tonne tipper lorry", "day", "2", "", ""], 5: ["concrete class 25 in bases", "m3", "3", "1", "3"], 6: ["polished marble statue", "nr", "1", "5", ""], 7: ["Subtotal", "", "", "", "99"]}


def test_bills_from_cells_and_files(spark, tmp_path):
    from tests.test_pricing import database

    cells = [(s, r, c + 1, v) for s in ("Bill 1", "Summary") for r, vs in GRID.items() for c, v in enumerate(vs)]
    table = spark.createDataFrame(cells, pricing.CELLS)
    controls = spark.createDataFrame([("vat_pct", "10"), ("overheads_pct", "5")], "key string, value string")
    notices = spark.createDataFrame([("c", "t", True)], "category string, text string, active boolean")
    db = dataclasses.replace(database(spark), controls=controls, assumptions=notices)
    merged = spark.createDataFrame([("one", "Bill 1", 1, 1, 1, 5, "Project X")], "boq_id string, sheet_name string, min_row int, max_row int, min_col int, max_col int, anchor string")
    made = pricing.price_bills(table.withColumn("boq_id", F.lit("one")), merged, db, "Nyanza", db_path="db")
    quote = made.quotes.first()
    results = {r.row_number: r for r in made.results.collect()}
    # the subtotal row is noise, the heading row gives context alone
    assert set(results) == {4, 5, 6} and results[4].matched_item_code == "PL001" and results[5].matched_item_code == "CO001" and results[6].decision == "unmatched"
    total = sum(float(r.quantity) * float(r.rate) for r in results.values() if r.decision == "matched")
    assert float(quote.subtotal) == pytest.approx(total) and float(quote.grand_total) == pytest.approx(round(total * 1.05 * 1.10, 2)) and made.terms.vat == "10.0"
    bill = {r.row_number: (r.rate, r.amount) for r in made.tables["priced_bill"].collect()}
    assert float(bill[6][0]) == 5 and bill[6][1] is None and float(bill[5][0]) == float(results[5].rate) and float(bill[5][1]) == pytest.approx(3 * float(results[5].rate))
    assert set(made.tables) == {"priced_bill", "suggestions", "summary", "assumptions", "basis_of_rates", "commercial_review", "audit", "audit_heads", "unmatched"}
    assert [(r.label, r.value) for r in made.tables["summary"].orderBy("row_ord").collect()][:3] == [("Field", "Value"), ("Currency", "KES"), ("Bid Ready Status", "NO")]
    assert '"db_path":"db"' in made.tables["audit_heads"].first().json and tuple(made.counters.first())[1:] == (3, 2, made.results.where("review_flag").count())
    assert made.tables["assumptions"].count() == 1 and all(df.count() for df in made.tables.values())
    for name in ("alpha", "beta"):
        table.coalesce(1).write.parquet(f"{tmp_path}/raw-{name}")
        (part,) = (tmp_path / f"raw-{name}").glob("*.parquet")
        (tmp_path / "bills").mkdir(exist_ok=True)
        part.rename(tmp_path / "bills" / f"{name}.parquet")
    (tmp_path / "bills" / "~lock.parquet").write_bytes(b"no bill")
    got = pricing.price_folder(spark, f"{tmp_path}/bills", db, "Nyanza").quotes.collect()
    assert {(r.boq_id, r.grand_total) for r in got} == {("alpha", quote.grand_total), ("beta", quote.grand_total)}


def test_tender_documents_keep_their_path(spark):
    """the query and its SQL have every column of an assembled document."""
    from quantra.plans.registry import ORACLES, QUERIES

    got = QUERIES["a15_tender_documents"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "document_name", "source_path", "document_type", "title", "line_count", "full_text"] and " AS source_path" in ORACLES["a15_tender_documents"]
    assert all(r.source_path == f"in/{r.document_name}" for r in got.collect())


def test_tender_files_are_read_once(spark, tmp_path):
    """What was read is held: later steps open no file again."""
    (tmp_path / "a.txt").write_text("one\ntwo")
    docs = tables.tender_files(spark, str(tmp_path))
    (tmp_path / "a.txt").unlink()
    assert [(r.doc_id, r.line_no, r.text) for r in tables.document_lines(docs).orderBy("line_no").collect()] == [("a.txt", 1, "one"), ("a.txt", 2, "two")]


def test_documents_files_are_written_by_many_tasks(spark):
    """A small table is a single task's after a shuffle that Spark sizes itself, though each of its rows becomes a folder and a file."""
    made = queries_tender._files(spark, "/root/testdata/sf0.001").select("path").collect()
    tasks = {re.search(r"part-(\d+)-", r.path)[1] for r in made}
    assert len(made) == spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count() and len(tasks) > 1


def test_bills_from_cells_store_their_lines_once(spark, monkeypatch):
    """Results are lines with their cases, and the priced bill is made of them: as from results that are joined to the lines."""
    from tests.test_pricing import database

    names = []
    for module in (pricing, matching):
        own = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, own=own: names.append(name) or own(df, name))
    cells = spark.createDataFrame([(b, "Bill 1", r, c + 1, v) for b in ("one", "two") for r, vs in GRID.items() for c, v in enumerate(vs)], "boq_id string, " + pricing.CELLS)
    none = spark.createDataFrame([], "boq_id string, sheet_name string, min_row int, max_row int, min_col int, max_col int, anchor string")
    made = pricing.price_bills(cells, none, database(spark), "Nyanza")
    assert not {"bill-lines", "priced-lines"} & set(names) and names.count("headed-lines") == 1
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    assert rows(made.tables["priced_bill"]) == rows(sinks.priced_bill(made.lines, made.results, made.maps)) and made.lines.count() > made.results.count() == 6
    assert rows(made.sections) == rows(commercial.section_totals(made.results)) and rows(made.quotes) == rows(commercial.quotation_totals(made.results, made.terms))

