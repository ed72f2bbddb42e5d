"""Registered queries of tender mining, gaps and handoff."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantra.operators import store, tender
from quantra.plans import pricing, tenders
from quantra.plans.sql_pricing import sql_normalized
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


LINES_SQL = r"""
l0 AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]')) AS raw, generate_subscripts(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]'), 1) AS line_no FROM documents WHERE text IS NOT NULL),
tl AS (SELECT doc_id, line_no, concat('L', line_no) AS source_reference, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text FROM l0 WHERE trim(regexp_replace(raw, '\s+', ' ', 'g')) <> '')"""

REQ_SQL = LINES_SQL + r""",
rh AS (SELECT t.*, lower(t.text) AS low, p.*, row_number() OVER (PARTITION BY doc_id, line_no, category ORDER BY phrase_ord) AS turn FROM tl t JOIN phrases p ON contains(lower(t.text), p.phrase)),
r1 AS (SELECT *, least(73.0 + CASE WHEN phrase = low THEN 18.0 ELSE 0 END + CASE WHEN regexp_matches(low, 'shall|must|mandatory|required|submit|attach') THEN 12.0 ELSE 0 END
  + CASE WHEN regexp_matches(low, '\b\d+(?:\.\d+)?\s*%') OR regexp_matches(low, '\b(?:kes|kshs?|usd)\s*[\d,]+(?:\.\d+)?') THEN 6.0 ELSE 0 END + CASE WHEN regexp_matches(low, '\b\d+\s*(?:calendar\s+)?(?:days?|weeks?|months?)\b') THEN 6.0 ELSE 0 END, 96.0) AS confidence,
  CASE category WHEN 'securities' THEN CASE WHEN regexp_extract(text, '\b\d+(?:\.\d+)?\s*%') <> '' THEN regexp_extract(text, '\b\d+(?:\.\d+)?\s*%') ELSE regexp_extract(text, '(?i)\b(?:kes|kshs?|usd)\s*[\d,]+(?:\.\d+)?') END
    WHEN 'periods' THEN regexp_extract(text, '(?i)\b\d+\s*(?:calendar\s+)?(?:days?|weeks?|months?)\b') WHEN 'meetings' THEN CASE WHEN contains(low, 'mandatory') THEN 'Mandatory meeting/site visit referenced' ELSE 'Meeting/site visit referenced' END ELSE '' END AS detail,
  regexp_matches(low, 'shall|must|mandatory|required|submit|attach') OR category IN ('submission_documents', 'securities') AS mandatory,
  CASE category WHEN 'securities' THEN 'Securities' WHEN 'meetings' THEN 'Meetings' WHEN 'periods' THEN 'Periods' WHEN 'pricing_instructions' THEN 'Pricing Instructions' WHEN 'technical_compliance' THEN 'Technical Compliance' ELSE 'Submission Documents' END AS title FROM rh WHERE turn = 1),
req AS (SELECT *, confidence < 70 OR (category IN ('securities', 'periods', 'meetings', 'pricing_instructions') AND detail = '') AS review_flag, concat(title, ': ', CASE WHEN detail <> '' THEN detail ELSE text END) AS description,
  concat('REQ-', lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, cat_ord) AS VARCHAR), CAST(greatest(3, len(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, cat_ord) AS VARCHAR))) AS INT), '0')) AS requirement_id FROM r1)"""

SCOPE_SQL = r""",
sh AS (SELECT t.doc_id, t.line_no, t.source_reference, t.text, s.section, list(s.keyword ORDER BY s.key_ord) AS kws FROM tl t JOIN scopes s ON contains(lower(t.text), s.keyword) GROUP BY ALL),
sg AS (SELECT doc_id, section, least(max(58.0 + least(len(kws) * 10.0, 20.0) + CASE WHEN (upper(text) = text AND lower(text) <> text) OR ends_with(text, ':') OR len(string_split(text, ' ')) <= 6 THEN 10.0 ELSE 0.0 END), 95.0) AS confidence,
  list(source_reference ORDER BY line_no) AS refs, flatten(list(kws ORDER BY line_no)) AS kk FROM sh GROUP BY doc_id, section),
sec AS (SELECT doc_id, section, confidence, array_to_string(refs, ', ') AS refs, array_to_string(list_filter(kk, lambda x, i: list_position(kk, x) = i), ', ') AS words, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, section) AS section_ord FROM sg)"""

DRAFT_SQL = SCOPE_SQL + rf""",
d0 AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(text), '^-+', '')), ':+$', '')) AS description FROM sh),
d1 AS (SELECT *, {sql_normalized('description')} AS key, row_number() OVER (PARTITION BY doc_id, section, {sql_normalized('description')} ORDER BY line_no) AS turn FROM d0 WHERE description <> '' AND len(string_split(description, ' ')) >= 2),
draft AS (SELECT d.doc_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY s.section_ord, d.line_no) AS suggestion_ord, d.section, d.description, d.key,
  CASE WHEN d.section = 'Dayworks' THEN 'day' WHEN regexp_matches(lower(d.description), 'excavation|concrete|backfill') THEN 'm3' WHEN regexp_matches(lower(d.description), 'paint|plaster|tiling|screed') THEN 'm2' WHEN regexp_matches(lower(d.description), 'fence|pipe|cabling') THEN 'm' WHEN regexp_matches(lower(d.description), 'manhole|light|pump|visit') THEN 'nr' ELSE 'item' END AS unit,
  d.source_reference, concat('Tender text matched via ', s.words) AS source_basis, greatest(55.0, least(s.confidence, 88.0)) AS confidence FROM d1 d JOIN sec s USING (doc_id, section) WHERE turn = 1)"""

#: A bill for each document: all its lines, in sections by line number.
BILL_SECTION = "CASE line_no % 4 WHEN 0 THEN 'Earthworks' WHEN 1 THEN 'Plumbing' WHEN 2 THEN 'Concrete' ELSE 'Other' END"
BILL_SQL = f", bill_rows AS (SELECT doc_id, {BILL_SECTION} AS section, line_no AS row_number, text AS description, CASE line_no % 3 WHEN 0 THEN '' ELSE 'm2' END AS unit, CASE line_no % 2 WHEN 0 THEN CAST(line_no AS DECIMAL(18,4)) END AS quantity FROM tl), bill AS (SELECT DISTINCT doc_id, section, {sql_normalized('description')} AS key FROM bill_rows)"

GAP_SQL = DRAFT_SQL + BILL_SQL + r""",
gap AS (SELECT s.doc_id, 1 AS stage, section_ord AS ord, 'Missing Section' AS gap_type, section, concat('Tender scope indicates section ''', section, ''' but no equivalent BOQ section was detected.') AS description, refs AS source_reference, greatest(55.0, least(confidence, 82.0)) AS confidence FROM sec s WHERE NOT EXISTS (SELECT 1 FROM bill b WHERE b.doc_id = s.doc_id AND b.section = s.section)
UNION ALL SELECT d.doc_id, 2, suggestion_ord, 'Missing Item', section, description, source_reference, greatest(50.0, least(confidence, 78.0)) FROM draft d WHERE NOT EXISTS (SELECT 1 FROM bill b WHERE b.doc_id = d.doc_id AND b.section = d.section AND b.key <> '' AND (contains(b.key, d.key) OR contains(d.key, b.key)))
UNION ALL SELECT doc_id, 3, suggestion_ord, 'Measurement Clarification', section, description, source_reference, 62.0 FROM draft WHERE contains(lower(description), 'provisional') OR contains(lower(description), 'dayworks'))"""


def _docs(spark, sf) -> DataFrame:
    return view(spark, sf, "documents").select("doc_id", "text", F.expr("concat('in/doc-', doc_id, CASE doc_id % 2 WHEN 0 THEN '.txt' ELSE '.MD' END)").alias("path"), F.expr("CASE WHEN doc_id % 50 = 0 THEN 'Given title' ELSE '' END").alias("title"))


def _words(spark, sf) -> tenders.Dictionary:
    return tenders.Dictionary(*(view(spark, sf, x) for x in ("phrases", "scopes", "patterns")))


def _bill_rows(spark, sf) -> DataFrame:
    """Written once, however many steps read them."""
    rows = tables.text_lines(store.spread(view(spark, sf, "documents").select("doc_id", "text"), "doc_id"))
    unit, quantity = "CASE line_no % 3 WHEN 0 THEN '' ELSE 'm2' END", "CASE line_no % 2 WHEN 0 THEN CAST(line_no AS DECIMAL(18,4)) END"
    made = rows.select("doc_id", F.expr(BILL_SECTION).alias("section"), F.lit("Bill").alias("sheet_name"), F.col("line_no").alias("row_number"), F.col("text").alias("description"), F.expr(unit).alias("unit"), F.expr(quantity).alias("quantity"), F.lit(False).alias("is_heading"), F.lit(False).alias("is_summary_row"), F.concat(F.lit("Bill!R"), "line_no").alias("source_reference"))
    return store.stored(made, "bill-rows")


def _analysis(spark, sf, bill: DataFrame | None = None) -> tenders.Analysis:
    return tenders.analyze(_docs(spark, sf), _words(spark, sf), bill)


def _lines(spark, sf) -> DataFrame:
    return tables.text_lines(view(spark, sf, "documents"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, source_reference, md5(text) AS text FROM tl")
def a12_tender_lines(spark, sf) -> DataFrame:
    return _lines(spark, sf).select("doc_id", "line_no", "source_reference", F.md5("text").alias("text"))


@query(
    f"""WITH {LINES_SQL}, t AS (SELECT doc_id, arg_min(text, line_no) AS title, count(*) AS line_count, string_agg(text, chr(10) ORDER BY line_no) AS full_text FROM tl GROUP BY doc_id)
SELECT d.doc_id, concat('doc-', d.doc_id, CASE d.doc_id % 2 WHEN 0 THEN '.txt' ELSE '.MD' END) AS document_name, concat('in/doc-', d.doc_id, CASE d.doc_id % 2 WHEN 0 THEN '.txt' ELSE '.MD' END) AS source_path, 'text' AS document_type, CASE WHEN d.doc_id % 50 = 0 THEN 'Given title' ELSE coalesce(t.title, concat('doc-', d.doc_id)) END AS title,
  coalesce(line_count, 0) AS line_count, md5(coalesce(full_text, '')) AS full_text FROM documents d LEFT JOIN t USING (doc_id)"""
)
def a15_tender_documents(spark, sf) -> DataFrame:
    return tender.assembled(_lines(spark, sf), _docs(spark, sf)).withColumn("full_text", F.md5("full_text"))


@query(f"WITH {with_views('phrases')}, {REQ_SQL} SELECT doc_id, requirement_id, title AS category, description, mandatory, source_reference, CAST(confidence AS DOUBLE) AS confidence, owner, phrase AS matched_phrase, review_flag FROM req")
def e08_g07_requirements(spark, sf) -> DataFrame:
    return tender.requirements(_lines(spark, sf), view(spark, sf, "phrases")).select("doc_id", "requirement_id", "category", "description", "mandatory", "source_reference", "confidence", "owner", "matched_phrase", "review_flag")


# What the templates make of a requirement's category, detail and flag.
TEXT_SQL = """CASE WHEN NOT review_flag THEN '' WHEN detail = '' THEN concat('Review exact tender wording for ', lower(title), '.') ELSE 'Review extracted detail against the tender source before submission.' END"""
ACTION_SQL = """CASE category WHEN 'submission_documents' THEN 'Confirm document is available and include it in submission pack.' WHEN 'securities' THEN 'Confirm instrument type, value, and issuing bank.' WHEN 'meetings' THEN 'Confirm attendance requirement and record evidence.'
  WHEN 'periods' THEN CASE WHEN detail <> '' THEN concat('Record period in tender tracker: ', detail, '.') ELSE 'Confirm the governing completion, delivery, or validity period.' END WHEN 'pricing_instructions' THEN 'Review pricing instruction before BOQ gap check and pricing.'
  ELSE CASE WHEN mandatory THEN 'Confirm compliance before submission.' ELSE 'Review and decide whether tender response action is needed.' END END"""


@query(f"WITH {with_views('phrases')}, {REQ_SQL} SELECT doc_id, requirement_id, title AS category, description, mandatory, source_reference, CAST(round(confidence, 1) AS DOUBLE) AS confidence, {ACTION_SQL} AS action_needed, owner, 'pending review' AS status, CASE WHEN review_flag THEN trim(concat({TEXT_SQL}, ' Human review required.')) ELSE {TEXT_SQL} END AS notes FROM req")
def d15_c22_checklist(spark, sf) -> DataFrame:
    return tender.checklist(tender.requirements(_lines(spark, sf), view(spark, sf, "phrases")))


@query(f"WITH {with_views('scopes')}, {LINES_SQL}{SCOPE_SQL} SELECT doc_id, section, CAST(confidence AS DOUBLE) AS confidence, refs, words, section_ord FROM sec")
def e09_f08_scope_sections(spark, sf) -> DataFrame:
    return tender.scope_sections(_lines(spark, sf), view(spark, sf, "scopes")).select("doc_id", "section", "confidence", F.array_join("source_references", ", ").alias("refs"), F.array_join("matched_keywords", ", ").alias("words"), "section_ord")


@query(f"WITH {with_views('scopes')}, {LINES_SQL}{DRAFT_SQL} SELECT doc_id, suggestion_ord, section, description, unit, 'TBD' AS quantity_placeholder, source_basis, source_reference, CAST(confidence AS DOUBLE) AS confidence FROM draft")
def e11_i05_draft_suggestions(spark, sf) -> DataFrame:
    return tender.draft_suggestions(_lines(spark, sf), view(spark, sf, "scopes"))


CLARIFY_SQL = r""",
c1 AS (SELECT DISTINCT t.doc_id, 1 AS stage, t.line_no AS a, p.cat_ord AS b, CASE p.category WHEN 'unclear_scope' THEN 'Unclear Scope' WHEN 'missing_measurements' THEN 'Missing Measurements' WHEN 'conflicting_instructions' THEN 'Conflicting Instructions' ELSE 'Unusual Requirements' END AS category, t.text AS description, t.source_reference, 68.0 AS confidence, CASE p.category WHEN 'unclear_scope' THEN 'Confirm the intended scope wording and BOQ treatment.' WHEN 'missing_measurements' THEN 'Request missing dimensions, quantities, or measurement rules.' WHEN 'conflicting_instructions' THEN 'Resolve the conflicting instruction before submission or pricing.' ELSE 'Record the requirement in the tender clarification tracker.' END AS action_needed, 'Tender wording may require clarification before pricing or submission.' AS notes FROM tl t JOIN patterns p ON contains(lower(t.text), p.pattern)),
c2 AS (SELECT doc_id, 2, line_no, cat_ord, 'Requirement Review', description, source_reference, greatest(55.0, least(confidence, 80.0)), 'Confirm the exact tender requirement and record the response route.', notes FROM (SELECT *, {notes} AS notes, row_number() OVER (PARTITION BY doc_id, source_reference ORDER BY cat_ord) AS n FROM req WHERE review_flag) WHERE n = 1),
c3 AS (SELECT doc_id, 3, section_ord, 0, 'Unclear Scope', concat('Scope section ''', section, ''' is weakly inferred from the tender text.'), refs, confidence, 'Confirm whether this section should appear in the BOQ or tender scope tracker.', 'Low-confidence scope inference.' FROM sec WHERE confidence < 70),
u AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY stage, a, b) AS VARCHAR) AS k FROM u)""".replace("{notes}", TEXT_SQL)
CLARIFIED = "SELECT doc_id, concat('CL-', lpad(k, CAST(greatest(3, len(k)) AS INT), '0')) AS clarification_id, category, description, source_reference, CAST(confidence AS DOUBLE) AS confidence, action_needed, notes FROM n"


@query(f"WITH {with_views('phrases', 'scopes', 'patterns')}, {REQ_SQL}{SCOPE_SQL}{CLARIFY_SQL} {CLARIFIED}")
def e10_i01_clarifications(spark, sf) -> DataFrame:
    return _analysis(spark, sf).clarifications


@query(f"WITH {with_views('scopes')}, {LINES_SQL}{GAP_SQL} SELECT doc_id, stage, ord, gap_type, section, description, source_reference, CAST(confidence AS DOUBLE) AS confidence FROM gap")
def e12_e13_i02_gaps(spark, sf) -> DataFrame:
    return _analysis(spark, sf, _bill_rows(spark, sf)).gaps


@query(
    f"WITH {with_views('scopes')}, {LINES_SQL}{DRAFT_SQL}"
    + """ SELECT doc_id, 1 AS stage, section_ord AS ord, 'Scope Review' AS gap_type, section, 'No BOQ workbook supplied. Confirm whether this tender scope section should appear in the draft BOQ.' AS description, refs AS source_reference, CAST(greatest(50.0, least(confidence, 75.0)) AS DOUBLE) AS confidence FROM sec
UNION ALL SELECT doc_id, 2, suggestion_ord, 'Draft Review', section, description, source_reference, CAST(greatest(50.0, least(confidence, 72.0)) AS DOUBLE) FROM draft WHERE suggestion_ord <= 10"""
)
def i04_h06_review_only_gaps(spark, sf) -> DataFrame:
    return _analysis(spark, sf).gaps


NOTE = {k: "'" + v.replace("'", "''") + "'" for k, v in tender.NOTES.items()}
HANDOFF_SQL = f""", every AS (SELECT doc_id, 2 AS stage, 'tender_draft' AS source_origin, suggestion_ord AS ord, section, description, unit, CAST(NULL AS DECIMAL(18,4)) AS quantity, source_basis, TRUE AS inferred_from_tender, confidence, TRUE AS review_required, {NOTE['draft']} AS notes, source_reference FROM draft
UNION ALL SELECT b.doc_id, 1, 'existing_boq', b.row_number, b.section, b.description, b.unit, b.quantity, 'Existing BOQ row from Bill', FALSE, 95.0, b.quantity IS NULL OR b.unit = '', {NOTE['existing_boq']}, concat('Bill!R', b.row_number) FROM bill_rows b
UNION ALL SELECT doc_id, 3, 'gap_check', stage * 1000000 + ord, section, description, '', NULL, concat('Gap-check finding: ', gap_type), TRUE, confidence, TRUE, CASE gap_type WHEN 'Missing Item' THEN {NOTE['Missing Item']} ELSE {NOTE['Measurement Clarification']} END, source_reference FROM gap WHERE gap_type <> 'Missing Section'),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source_origin, section, {sql_normalized('description')} ORDER BY ord) AS turn FROM every),
hand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage, ord, section) AS handoff_ord FROM k WHERE turn = 1)"""


@query(f"WITH {with_views('scopes')}, {LINES_SQL}{GAP_SQL}{HANDOFF_SQL} SELECT doc_id, handoff_ord, section, description, unit, quantity, source_basis, source_origin, CASE WHEN inferred_from_tender THEN 'YES' ELSE 'NO' END AS inferred_from_tender, CAST(round(confidence, 1) AS DOUBLE) AS confidence, CASE WHEN review_required THEN 'YES' ELSE 'NO' END AS review_required, notes, source_reference FROM hand")
def i03_b12_handoff(spark, sf) -> DataFrame:
    bill = _bill_rows(spark, sf)
    got = _analysis(spark, sf, bill)
    return tender.handoff_table(tender.handoff(got.drafts, got.gaps, bill), True)


@query(f"WITH {with_views('scopes')}, {LINES_SQL}{DRAFT_SQL} SELECT doc_id, suggestion_ord AS handoff_ord, section, description, unit, CAST(NULL AS DECIMAL(18,4)) AS quantity, CAST(NULL AS DECIMAL(18,2)) AS rate, CAST(NULL AS DECIMAL(18,2)) AS amount, source_basis, 'tender_draft' AS source_origin, 'YES' AS inferred_from_tender, CAST(confidence AS DOUBLE) AS confidence, 'YES' AS review_required, {NOTE['draft']} AS notes, source_reference FROM draft")
def m11_b12_draft_handoff(spark, sf) -> DataFrame:
    got = tenders.draft_boq(_docs(spark, sf), _words(spark, sf))
    return tender.handoff_table(tender.handoff(got.drafts, got.gaps), False)


SUMMARY_SQL = f"""
rc AS (SELECT doc_id, count(*) AS total_requirements, count(*) FILTER (mandatory) AS mandatory_requirements, count(*) FILTER (review_flag) AS flagged_requirements, string_agg(description, ' | ' ORDER BY requirement_id) FILTER (title IN ('Securities', 'Periods', 'Pricing Instructions')) AS clues,
  string_agg(concat(requirement_id, ': ', CASE WHEN {TEXT_SQL} <> '' THEN {TEXT_SQL} ELSE description END), ' | ' ORDER BY requirement_id) FILTER (review_flag) AS rnotes FROM req GROUP BY doc_id),
sc AS (SELECT doc_id, count(*) AS n, string_agg(section, ', ' ORDER BY section_ord) AS scope FROM sec GROUP BY doc_id), dc AS (SELECT doc_id, count(*) AS n FROM draft GROUP BY doc_id),
gc AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM sec UNION ALL SELECT doc_id FROM draft WHERE suggestion_ord <= 10) GROUP BY doc_id), cc AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
sums AS (SELECT d.doc_id, coalesce(rc.total_requirements, 0) AS total_requirements, coalesce(rc.mandatory_requirements, 0) AS mandatory_requirements, coalesce(rc.flagged_requirements, 0) AS flagged_requirements, coalesce(sc.n, 0) AS scope_sections, coalesce(sc.scope, '') AS detected_scope,
  coalesce(rc.clues, '') AS commercial_clues, coalesce(rc.rnotes, '') AS review_notes, coalesce(gc.n, 0) AS gap_items, coalesce(dc.n, 0) AS draft_suggestions, coalesce(cc.n, 0) AS clarifications
  FROM documents d LEFT JOIN rc USING (doc_id) LEFT JOIN sc USING (doc_id) LEFT JOIN dc USING (doc_id) LEFT JOIN gc USING (doc_id) LEFT JOIN cc USING (doc_id))"""
ANALYSIS_SQL = f"WITH {with_views('phrases', 'scopes', 'patterns')}, {REQ_SQL}{DRAFT_SQL}{CLARIFY_SQL}, {SUMMARY_SQL}"


@query(f"{ANALYSIS_SQL} SELECT * FROM sums")
def m10_f09_d17_tender_summary(spark, sf) -> DataFrame:
    got = _analysis(spark, sf).summary.drop("document_name", "source_path", "document_type", "title", "line_count", "checklist_items")
    return got.withColumns({"detected_scope": F.array_join("detected_scope", ", "), "commercial_clues": F.array_join("commercial_clues", " | "), "review_notes": F.array_join("review_notes", " | ")})


# The seven result tables, each row as one text of its cells in order.
CELLS_SQL = f"""
SELECT 'checklist' AS name, doc_id, concat_ws('|', requirement_id, title, description, CASE WHEN mandatory THEN 'Yes' ELSE 'No' END, source_reference, CAST(CAST(round(confidence, 1) AS DECIMAL(9,1)) AS VARCHAR), {ACTION_SQL}, owner, 'pending review', CASE WHEN review_flag THEN trim(concat({TEXT_SQL}, ' Human review required.')) ELSE {TEXT_SQL} END) AS cells FROM req
UNION ALL SELECT 'scope', doc_id, concat_ws('|', section_ord, section, CAST(CAST(round(confidence, 1) AS DECIMAL(9,1)) AS VARCHAR), refs, words, '') FROM sec
UNION ALL SELECT 'drafts', doc_id, concat_ws('|', suggestion_ord, section, description, unit, 'TBD', '{tender.RATE_PLACEHOLDER}', 'TBD', source_basis, source_reference, CAST(CAST(round(confidence, 1) AS DECIMAL(9,1)) AS VARCHAR), 'Yes', {NOTE['draft']}) FROM draft
UNION ALL SELECT 'gaps', doc_id, concat_ws('|', 1, section_ord, 'Scope Review', section, 'No BOQ workbook supplied. Confirm whether this tender scope section should appear in the draft BOQ.', refs, '', CAST(CAST(greatest(50.0, least(confidence, 75.0)) AS DECIMAL(9,1)) AS VARCHAR), 'Yes', {NOTE['Scope Review']}) FROM sec
UNION ALL SELECT 'gaps', doc_id, concat_ws('|', 2, suggestion_ord, 'Draft Review', section, description, source_reference, '', CAST(CAST(greatest(50.0, least(confidence, 72.0)) AS DECIMAL(9,1)) AS VARCHAR), 'Yes', {NOTE['Draft Review']}) FROM draft WHERE suggestion_ord <= 10
UNION ALL SELECT 'clarifications', doc_id, concat_ws('|', concat('CL-', lpad(k, CAST(greatest(3, len(k)) AS INT), '0')), category, description, source_reference, CAST(CAST(round(confidence, 1) AS DECIMAL(9,1)) AS VARCHAR), action_needed, 'Yes', notes) FROM n
UNION ALL SELECT 'requirements', doc_id, concat_ws('|', requirement_id, title, description, CASE WHEN mandatory THEN 'Yes' ELSE 'No' END, source_reference, CAST(CAST(round(confidence, 1) AS DECIMAL(9,1)) AS VARCHAR), CASE WHEN review_flag THEN 'Yes' ELSE 'No' END, phrase, text, {TEXT_SQL}) FROM req
UNION ALL SELECT 'summary', doc_id, concat_ws('|', k, f, v) FROM (SELECT doc_id, unnest([1, 2, 3, 4]) AS k, unnest(['Document Name', 'Source Path', 'Document Type', 'Title']) AS f, unnest([document_name, concat('in/', document_name), 'text', title]) AS v FROM named
  UNION ALL SELECT doc_id, unnest([5, 6, 7, 8, 9, 10, 11, 12, 13, 14]) AS k, unnest(['Total Requirements', 'Mandatory Requirements', 'Flagged For Review', 'Checklist Items', 'Detected Scope Sections', 'Draft BOQ Suggestions', 'BOQ Gap Findings', 'Clarification Items', 'Commercial Clues', 'Review Notes']) AS f,
  unnest([CAST(total_requirements AS VARCHAR), CAST(mandatory_requirements AS VARCHAR), CAST(flagged_requirements AS VARCHAR), CAST(total_requirements AS VARCHAR), detected_scope, CAST(draft_suggestions AS VARCHAR), CAST(gap_items AS VARCHAR), CAST(clarifications AS VARCHAR), commercial_clues, review_notes]) AS v FROM sums)"""


NAMED_SQL = """, ttl AS (SELECT doc_id, arg_min(text, line_no) AS title FROM tl GROUP BY doc_id), named AS (SELECT d.doc_id, concat('doc-', d.doc_id, CASE d.doc_id % 2 WHEN 0 THEN '.txt' ELSE '.MD' END) AS document_name, CASE WHEN d.doc_id % 50 = 0 THEN 'Given title' ELSE coalesce(t.title, concat('doc-', d.doc_id)) END AS title FROM documents d LEFT JOIN ttl t USING (doc_id))"""


@query(f"{ANALYSIS_SQL}{NAMED_SQL} {CELLS_SQL}")
def m10_b10_result_tables(spark, sf) -> DataFrame:
    made, out = _analysis(spark, sf).tables(), None
    for name, df in made.items():
        cells = [F.col(c).cast("decimal(9,1)").cast("string") if c == "confidence" else F.col(c).cast("string") for c in df.columns if c != "doc_id"]
        rows = df.select(F.lit(name).alias("name"), "doc_id", F.concat_ws("|", *cells).alias("cells"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"{ANALYSIS_SQL}, tcount AS (SELECT doc_id, count(*) AS n FROM tl GROUP BY doc_id) SELECT s.doc_id, coalesce(t.n, 0) AS line_count, total_requirements AS requirements, scope_sections AS scope, draft_suggestions AS drafts, gap_items AS gaps, clarifications, review_notes FROM sums s LEFT JOIN tcount t USING (doc_id)")
def b11_analysis_json(spark, sf) -> DataFrame:
    """The JSON texts, read back: the header, the length of each list and the notes of the summary."""
    kind = "line_count long, requirements array<string>, scope array<string>, drafts array<string>, gaps array<string>, clarifications array<string>, summary array<struct<review_notes:array<string>>>"
    got = _analysis(spark, sf).json().select("doc_id", F.from_json("json", kind).alias("j"))
    size = lambda c: F.greatest(F.size(f"j.{c}"), F.lit(0)).cast("long").alias(c)
    return got.select("doc_id", "j.line_count", *map(size, ("requirements", "scope", "drafts", "gaps", "clarifications")), F.array_join(F.element_at("j.summary", 1)["review_notes"], " | ").alias("review_notes"))


@query()
def m13_b13_tender_price(spark, sf) -> DataFrame:
    """The tenders priced against bills of all their lines, whole; the JSON texts, read back. SQL is too slow for the scores of whole lines; tests hold what small tenders match."""
    db = pricing.Database(*(view(spark, sf, x) for x in ("library", "aliases", "rules", "inputs", "recipes", "adjustments")))
    made = tenders.tender_price(_docs(spark, sf), _words(spark, sf), db, "ASIA", _bill_rows(spark, sf))
    kind = "pricing_handoff_rows array<struct<handoff_ord:int,source_origin:string>>, counts struct<existing_boq:long,tender_draft:long,gap_check:long>, quotation_summary struct<processed_items:long,grand_total:double,section_totals:array<struct<section:string,subtotal:double>>>"
    got = made.json.select("doc_id", F.from_json("json", kind).alias("j")).where("j.pricing_handoff_rows IS NOT NULL")
    return got.select("doc_id", F.size("j.pricing_handoff_rows").cast("long").alias("handoff_rows"), F.array_join("j.pricing_handoff_rows.source_origin", ",").alias("origins"), "j.counts.existing_boq", "j.counts.gap_check", "j.quotation_summary.processed_items", "j.quotation_summary.grand_total", F.size("j.quotation_summary.section_totals").alias("sections"))


FILES_SQL = """WITH l AS (SELECT s_suppkey AS k, 1 AS line_no, 'L1' AS source_reference, s_name AS text FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 3, 'L3', concat('nation ', s_nationkey) FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 1, 'R1', concat(s_name, ' | a, "b" c | ', s_nationkey) FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 2, 'R2', concat('nation ', s_nationkey) FROM supplier WHERE s_suppkey % 2 = 1)"""


#: Tasks put their files in place themselves: with a folder a document the driver would else move each of them, one after another.
COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def _files(spark, sf) -> DataFrame:
    """Half the suppliers as text files, half as CSV files with cells that hold quotes, commas and line ends; a folder each, read back."""
    base = f"{store.shared_folder(spark)}/tender-files-{uuid.uuid4().hex}"
    rows = view(spark, sf, "supplier").withColumn("k", F.col("s_suppkey"))
    nation = F.concat(F.lit("nation "), "s_nationkey")
    rows.where("k % 2 = 0").select("k", F.concat(F.col("s_name"), F.lit("\n \t\n"), nation).alias("value")).transform(store.spread, "k").write.options(**COMMIT).partitionBy("k").text(f"{base}/texts")
    cells = rows.where("k % 2 = 1").select("k", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.col("s_name").alias("a"), F.lit('a, "b"\nc').alias("b"), F.col("s_nationkey").cast("string").alias("c")), F.struct(F.lit(2).alias("n"), nation.alias("a"), F.lit("").alias("b"), F.lit(" ").alias("c")))).alias("r")).select("k", "r.*")
    cells.transform(store.spread, "k").sortWithinPartitions("k", "n").drop("n").write.options(**COMMIT).option("escape", '"').option("emptyValue", "").option("ignoreTrailingWhiteSpace", False).partitionBy("k").csv(f"{base}/tables")
    return tables.tender_files(spark, base)


@query(FILES_SQL + " SELECT * FROM l")
def a12_a13_tender_files(spark, sf) -> DataFrame:
    """Files of a folder by their type, to lines."""
    return tables.document_lines(_files(spark, sf)).select(F.regexp_extract("doc_id", r"k=(\d+)/", 1).cast("long").alias("k"), "line_no", "source_reference", "text")


@query(FILES_SQL + " SELECT k, CASE k % 2 WHEN 0 THEN 'text' ELSE 'csv' END AS document_type, arg_min(text, line_no) AS title, count(*) AS line_count FROM l GROUP BY k")
def a15_m10_file_documents(spark, sf) -> DataFrame:
    """The documents that an analysis of a folder starts from."""
    made = tenders.analyze(_files(spark, sf), _words(spark, sf)).documents
    return made.select(F.regexp_extract("doc_id", r"k=(\d+)/", 1).cast("long").alias("k"), "document_type", "title", "line_count")
