"""Typed scans of the dimension tables and of import and tender files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantra.functions.text import active, clean_text, normalize_text, plain_number, text
from quantra.operators.store import stored

REQUIRED = ["RateLibrary", "Aliases", "SectionRules", "BuildUpInputs", "BuildUpRecipes", "Controls", "CandidateMatches", "ReviewLog"]


def rate_library(raw: DataFrame) -> DataFrame:
    """Rows with a description; normalized_description normalized anew; currency KES and active unless said otherwise; rate and hint 0 by default."""
    rows = raw.where("description IS NOT NULL AND description <> ''")
    stored = F.coalesce(F.nullif("normalized_description", F.lit("")), F.col("description"))
    return rows.withColumns({"normalized_description": normalize_text(stored), "rate": F.coalesce(F.col("rate").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")), "confidence_hint": plain_number("confidence_hint"), "currency": F.coalesce(F.nullif("currency", F.lit("")), F.lit("KES")), "active": active("active")})


def aliases(raw: DataFrame) -> DataFrame:
    """A02."""
    return raw.where("alias IS NOT NULL AND alias <> ''")


def section_rules(raw: DataFrame) -> DataFrame:
    """A03."""
    return raw.where("trigger_text IS NOT NULL AND trigger_text <> ''").withColumn("priority", F.coalesce(F.col("priority").try_cast("int"), F.lit(0)))


def buildup_inputs(raw: DataFrame) -> DataFrame:
    """A04."""
    return raw.where("input_code IS NOT NULL AND input_code <> ''").withColumn("active", active("active"))


def buildup_recipes(raw: DataFrame) -> DataFrame:
    """A05."""
    return raw.where("recipe_id IS NOT NULL AND recipe_id <> ''").withColumns({c: plain_number(c) for c in ("factor", "waste_factor")})


def controls(raw: DataFrame) -> DataFrame:
    """The last value of each trimmed, non-blank key; a value 0 becomes blank."""
    rows = raw.withColumn("key", F.trim(text("key"))).where("key <> ''")
    value = F.when(text("value") == "0", F.lit("")).otherwise(text("value"))
    return rows.groupBy("key").agg(F.max_by(value, "ordinal").alias("value"))


def regional_adjustments(raw: DataFrame) -> DataFrame:
    """Section * by default; a factor of 0 or no number is 1."""
    factor = F.coalesce(F.nullif(plain_number("factor", 1.0), F.lit(0.0)), F.lit(1.0))
    return raw.withColumns({"section": F.coalesce(F.nullif("section", F.lit("")), F.lit("*")), "factor": factor.cast("decimal(9,4)"), "active": active("active")})


def notices(raw: DataFrame) -> DataFrame:
    """Assumptions or exclusions with a text that are active."""
    return raw.where("text IS NOT NULL AND text <> ''").withColumn("active", active("active")).where("active")


#: Optional tables and the columns of the empty ones that stand for them.
OPTIONAL = {
    "RegionalAdjustments": "ordinal long, region string, section string, factor decimal(9,4), notes string, active boolean",
    "Assumptions": "text string, category string, active boolean",
    "Exclusions": "text string, category string, active boolean",
}


def open_tables(spark: SparkSession, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The required tables of the catalog (the error lists the missing ones by name) and the optional ones, empty where they are missing."""
    names = names or REQUIRED
    missing = sorted(n for n in names if not spark.catalog.tableExists(n))
    if missing:
        raise ValueError(f"missing tables: {', '.join(missing)}")
    found = {n: spark.table(n) for n in names}
    return found | {n: spark.table(n) if spark.catalog.tableExists(n) else spark.createDataFrame([], schema) for n, schema in OPTIONAL.items()}


# Line ends of text files.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> lines with their number from 1, white space collapsed, blanks dropped."""
    each = docs.select("doc_id", F.posexplode(F.split("text", LINE_ENDS)).alias("k", "raw"))
    return each.select("doc_id", (F.col("k") + 1).alias("line_no"), F.concat(F.lit("L"), F.col("k") + 1).alias("source_reference"), clean_text("raw").alias("text")).where("text <> ''")


#: A field of a CSV row: quoted, with what follows up to the next comma, or plain; a record is fields with commas between them. A quote that is never closed goes on to the end.
FIELD = r'(?:"(?:[^"]++|"")*+"?[^,\r\n]*+|[^,\r\n]*+)'
RECORD = rf"({FIELD}(?:,{FIELD})*+)(?:\r\n|\r|\n|$)"


def without_mark(x: Column | str) -> Column:
    """A text without a byte order mark at its beginning."""
    return F.regexp_replace(text(x), "^\ufeff", "")


def csv_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of CSV files -> a tender line for each record with a non-blank cell: its non-blank cells joined by ' | ', with reference R and the record's number from 1. Cells may be quoted,
    line ends within quotes are part of a cell, and a byte order mark is no text. A null text has no lines."""
    body = without_mark("text")
    records = F.regexp_extract_all(body, F.lit(RECORD), F.lit(1))
    rows = docs.select("doc_id", F.posexplode(records).alias("k", "row"))
    cells = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "row"), F.lit(rf",({FIELD})"), F.lit(1)), _unquoted)
    joined = F.array_join(F.filter(F.transform(cells, clean_text), lambda c: c != ""), " | ")
    return rows.select("doc_id", (F.col("k") + 1).alias("line_no"), F.concat(F.lit("R"), F.col("k") + 1).alias("source_reference"), joined.alias("text")).where("text <> ''")


def _unquoted(cell: Column) -> Column:
    quoted = r'(?s)^"((?:[^"]++|"")*+)"?(.*)$'
    inner = F.replace(F.regexp_extract(cell, quoted, 1), F.lit('""'), F.lit('"'))
    return F.when(cell.startswith('"'), F.concat(inner, F.regexp_extract(cell, quoted, 2))).otherwise(cell)


def structured(spark: SparkSession, path: str | None = None, table: str | None = None, database: str | None = None) -> DataFrame:
    """A10: a CSV file with a header, or a folder of such files, every column text; or a table of the catalog: the named one, else the database's first by name. ordinal rises with the rows: first by
    the file's place among the files by name, then by where its block starts and the row's place in the block, so a file that is read in several parts keeps its order and no two rows share an ordinal; a
    table has its own ordinal, or gets one in its files' order."""
    if path is None:
        name = table or min(t.name for t in spark.catalog.listTables(database))
        rows = spark.table(f"{database}.{name}" if database else name)
        return rows if "ordinal" in rows.columns else rows.withColumn("ordinal", F.monotonically_increasing_id())
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE").csv(path)
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    names = F.array(*map(F.lit, sorted({f.rsplit("/", 1)[-1] for f in rows.inputFiles()})))  # the import's files, a few
    rank = F.array_position(names, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)) - 1
    return rows.select("*", (F.shiftleft(rank, 40) + place).alias("ordinal"))


def joined_rows(cells: DataFrame, with_sheet: bool = True) -> DataFrame:
    """Grid rows as tender lines: non-blank cells joined by ' | ', with the sheet in the reference if there is one."""
    value = clean_text("value")
    rows = cells.withColumn("value", value).where("value <> ''").groupBy("doc_id", "sheet_name", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]), " | ").alias("text"))
    reference = F.concat("sheet_name", F.lit("!R"), F.col("row")) if with_sheet else F.concat(F.lit("R"), F.col("row"))
    return rows.select("doc_id", F.col("row").alias("line_no"), reference.alias("source_reference"), "text", "sheet_name")


def bill_files(spark: SparkSession, folder: str, schema: str | None = None, bill: str = r"([^/]+)\.parquet$") -> DataFrame:
    """All bill files below a folder but lock files in one read; boq_id is what `bill` finds in a file's path, its name by default, unless the files have that column."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "[!~]*.parquet")
    rows = (reader.schema(schema) if schema else reader).parquet(folder)
    if "boq_id" in rows.columns:
        return rows
    return rows.withColumn("boq_id", F.url_decode(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), bill, 1))))  # a path in a URI: encoded once by the writer, once by the URI


#: What a tender document is by its file's suffix.
DOCUMENT_TYPES = {"txt": "text", "md": "text", "csv": "csv", "xlsx": "excel"}


def document_type(path: Column | str) -> Column:
    """Text, csv or excel by a path's suffix; another suffix is an error."""
    path = F.col(path) if isinstance(path, str) else path
    kinds = F.create_map(*(F.lit(x) for pair in DOCUMENT_TYPES.items() for x in pair))
    kind = F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
    return F.coalesce(kind, F.raise_error(F.concat(F.lit("unsupported tender document: "), path)).cast("string"))


def tender_files(spark: SparkSession, folder: str) -> DataFrame:
    """The text and CSV files of a folder as documents: doc_id (the file's path below the folder), path, text. Other files and files without a byte are left alone; each file is one row, whatever its size. The rows are written to a table."""
    names = "*.{" + ",".join(c for k in ("txt", "md", "csv") for c in (k, k.upper())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", True).load(folder)
    below = F.regexp_replace("path", f"^.*?{re.escape(folder.rstrip('/').split('://')[-1].lstrip('/'))}/", "")
    return stored(files.select(below.alias("doc_id"), "path", F.decode("content", "UTF-8").alias("text")), "tender-files")  # each file is opened once, however many steps read its text


def document_lines(docs: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The lines of documents (doc_id, path, text) by their type: a text's lines, a CSV's records; those of workbooks come from cells (doc_id, sheet_name, row, col, value). Another type is an error."""
    typed = docs.select("doc_id", "text", document_type("path").alias("__type"))
    columns = ["doc_id", "line_no", "source_reference", "text"]
    plain = text_lines(typed.where("__type = 'text'").select("doc_id", "text")).select(*columns)
    out = plain.unionByName(csv_lines(typed.where("__type = 'csv'").select("doc_id", "text")).select(*columns)).withColumn("sheet_name", F.lit(""))
    if cells is None:
        return out
    books = typed.where("__type = 'excel'").select("doc_id")
    return out.unionByName(joined_rows(cells.join(books, "doc_id", "left_semi")).select(*columns, "sheet_name"))
