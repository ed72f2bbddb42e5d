"""The SQL of matching and pricing: every line against every item, in the terms of the operators' contracts."""

from __future__ import annotations

from quantra.functions import text as X
from quantra.sources.fixtures import with_views


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_normalized(x: str) -> str:
    """normalize_text as SQL, step by step."""
    v = f"lower(regexp_replace(translate(coalesce({x}, ''), {quoted(X.FOLD_FROM)}, {quoted(X.FOLD_TO)}), '[^\\x00-\\x7F]', '', 'g'))"
    v = f"replace(replace({v}, 'm^3', 'm3'), 'm^2', 'm2')"
    for a, b in (("(\\d)\\s*[^a-z0-9./ ]+\\s*(\\d)", "\\1 \\2"), ("\\bc\\.?f\\.?m\\b", "cfm"), ("\\btonnes?\\b", "ton"), ("\\blitres?\\b", "litre"), ("\\bhrs?\\b", "hr"), ("[^a-z0-9./ ]+", " ")):
        v = f"regexp_replace({v}, '{a}', '{b}', 'g')"
    words = ", ".join(map(quoted, X.STOP_WORDS))
    return f"array_to_string(list_filter(string_split_regex({v}, ' +'), lambda w: w <> '' AND w NOT IN ({words})), ' ')"


def sql_unit(x: str) -> str:
    v = f"replace({sql_normalized(x)}, ' ', '')"
    return f"CASE {v} " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in X.UNIT_SYNONYMS.items()) + f" ELSE {v} END"


# Longest common subsequences of `pairs`: one recursion step a character of a; r[j + 1] is that of a's beginning with b's first j.
LCS_SQL = """
lcs(a, b, i, r) AS (
  SELECT a, b, 0, list_transform(range(0, len(b) + 1), lambda j: 0) FROM pairs
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda t: CASE WHEN t = 0 THEN 0 ELSE greatest(r[t + 1], r[t] + CASE WHEN substr(b, t, 1) = substr(a, i + 1, 1) THEN 1 ELSE 0 END) END)))
  FROM lcs WHERE i < len(a)),
ratios AS (SELECT a, b, r, CASE WHEN len(a) + len(b) = 0 THEN 100.0 ELSE CAST(200 AS DOUBLE) * r[len(b) + 1] / (len(a) + len(b)) END AS score FROM lcs WHERE i = len(a))"""

# The three scores of the pairs (one, other) of `qp`; a recursive WITH.
SCORES_SQL = f"""
tk AS (SELECT x, list_sort(list_filter(string_split(x, ' '), lambda w: w <> '')) AS ws FROM (SELECT one AS x FROM qp UNION SELECT other FROM qp)),
td AS (SELECT x, array_to_string(ws, ' ') AS sorted, list_sort(list_distinct(ws)) AS t FROM tk),
st AS (SELECT p.one, p.other, u.sorted AS s1, v.sorted AS s2, len(u.t) = 0 OR len(v.t) = 0 AS none, list_sort(list_intersect(u.t, v.t)) AS i, list_sort(list_filter(u.t, lambda w: NOT list_contains(v.t, w))) AS e, list_sort(list_filter(v.t, lambda w: NOT list_contains(u.t, w))) AS f
  FROM qp p JOIN td u ON u.x = p.one JOIN td v ON v.x = p.other),
sx AS (SELECT *, array_to_string(i, ' ') AS x0, array_to_string(list_concat(i, e), ' ') AS x1, array_to_string(list_concat(i, f), ' ') AS x2 FROM st),
ab AS (SELECT one, other, CASE WHEN len(one) > len(other) THEN other ELSE one END AS s, CASE WHEN len(one) > len(other) THEN one ELSE other END AS l FROM qp),
mid AS (SELECT one, other, s AS a, unnest(list_transform(range(0, len(l) - len(s) + 1), lambda k: substr(l, CAST(k AS INT) + 1, len(s)))) AS b FROM ab WHERE s <> ''),
edge AS (SELECT one, other, s AS a, left(l, len(s) - 1) AS b FROM ab WHERE s <> '' UNION ALL SELECT one, other, reverse(s), left(reverse(l), len(s) - 1) FROM ab WHERE s <> ''
  UNION ALL SELECT one, other, l, left(s, len(s) - 1) FROM ab WHERE s <> '' AND len(s) = len(l) UNION ALL SELECT one, other, reverse(l), left(reverse(s), len(s) - 1) FROM ab WHERE s <> '' AND len(s) = len(l)),
pairs AS (SELECT s1 AS a, s2 AS b FROM sx UNION SELECT x0, x1 FROM sx UNION SELECT x0, x2 FROM sx UNION SELECT x1, x2 FROM sx UNION SELECT a, b FROM mid UNION SELECT a, b FROM edge), {LCS_SQL},
part_of AS (SELECT one, other, max(score) AS score FROM (SELECT one, other, score FROM mid JOIN ratios USING (a, b) UNION ALL SELECT one, other, list_max(list_transform(range(0, len(b) + 1), lambda j: CAST(200 AS DOUBLE) * r[j + 1] / (len(a) + j))) FROM edge JOIN ratios USING (a, b)
  UNION ALL SELECT one, other, CASE WHEN l = '' THEN 100.0 ELSE 0.0 END FROM ab WHERE s = '') GROUP BY one, other),
scored AS (SELECT sx.one, sx.other, q.score AS sort_score, p.score AS partial_score, CAST(CASE WHEN none THEN 0.0 WHEN len(i) > 0 AND (len(e) = 0 OR len(f) = 0) THEN 100.0 ELSE greatest(CASE WHEN len(i) > 0 THEN greatest(u.score, v.score) ELSE 0.0 END, w.score) END AS DOUBLE) AS set_score
  FROM sx JOIN part_of p ON p.one = sx.one AND p.other = sx.other JOIN ratios q ON q.a = s1 AND q.b = s2 JOIN ratios u ON u.a = x0 AND u.b = x1 JOIN ratios v ON v.a = x0 AND v.b = x2 JOIN ratios w ON w.a = x1 AND w.b = x2)"""

HEADINGS_SQL = "SELECT *, list(description) FILTER (is_heading) OVER (PARTITION BY boq_id, sheet_name ORDER BY row_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hs FROM lines"

SECTION_SQL = f"""
h AS ({HEADINGS_SQL}),
c AS (SELECT *, CASE WHEN contains(lower(sheet_name), 'plant') THEN 'Dayworks' WHEN contains(lower(sheet_name), 'earthworks') THEN 'Earthworks' ELSE '' END AS hint,
  lower(concat_ws(' ', sheet_name, array_to_string(coalesce(hs, []), ' '), description)) AS corpus FROM h WHERE NOT is_heading AND NOT is_summary_row),
sec AS (SELECT *, CASE WHEN contains(corpus, 'ring') THEN 'Brand#3' WHEN contains(corpus, 'small') THEN 'Brand#4' WHEN contains(corpus, 'widget') THEN 'Brand#2' WHEN contains(corpus, 'plant') THEN 'Brand#5' ELSE hint END AS inferred_section FROM c)"""

# The alias fold over {rows}: ring -> ring band, widget -> gadget, red -> scarlet, whole words; hits are substrings.
ALIAS_SQL = """
a0 AS (SELECT *, {norm} AS q0 FROM {rows}),
a1 AS (SELECT *, contains(q0, 'ring') AS h1, CASE WHEN contains(q0, 'ring') THEN regexp_replace(q0, '\\bring\\b', 'ring band', 'g') ELSE q0 END AS q1 FROM a0),
a2 AS (SELECT *, contains(q1, 'widget') AS h2, CASE WHEN contains(q1, 'widget') THEN regexp_replace(q1, '\\bwidget\\b', 'gadget', 'g') ELSE q1 END AS q2 FROM a1),
a3 AS (SELECT *, contains(q2, 'red') AS h3, CASE WHEN contains(q2, 'red') THEN regexp_replace(q2, '\\bred\\b', 'scarlet', 'g') ELSE q2 END AS q3 FROM a2)""".replace("{norm}", sql_normalized("description"))

MATCH_SQL = f"""WITH RECURSIVE {with_views('lines', 'library', 'inputs', 'recipes', 'adjustments')}, {SECTION_SQL}, {ALIAS_SQL.format(rows='sec')},
kd AS MATERIALIZED (SELECT *, {sql_unit('unit')} AS line_unit, least(CAST(h1 AS INT) + CAST(h2 AS INT) + CAST(h3 AS INT), 2) AS alias_count, (h1 AND lower(inferred_section) = 'brand#2') OR (h3 AND lower(inferred_section) = 'brand#3') AS alias_section FROM a3),
it AS MATERIALIZED (SELECT *, {sql_normalized('description')} AS item_text, {sql_unit('unit')} AS item_key FROM library WHERE active),
ky AS MATERIALIZED (SELECT DISTINCT q3, inferred_section, region, line_unit, alias_count, alias_section FROM kd),
hd AS (SELECT recipe_id, min(ordinal) AS head, arg_min(output_description, ordinal) AS output_description, arg_min(output_unit, ordinal) AS output_unit, arg_min(section, ordinal) AS recipe_section FROM recipes GROUP BY recipe_id),
qp AS MATERIALIZED (SELECT a.x AS one, b.x AS other FROM (SELECT DISTINCT q3 AS x FROM ky) a CROSS JOIN (SELECT DISTINCT item_text AS x FROM it) b UNION SELECT a.x, b.x FROM (SELECT DISTINCT q0 AS x FROM a0) a CROSS JOIN (SELECT {sql_normalized('output_description')} AS x FROM hd) b),
{SCORES_SQL},
pr AS (SELECT ky.*, it.ordinal, s.sort_score, s.partial_score, s.set_score, s.sort_score * 0.45 + s.partial_score * 0.20 + s.set_score * 0.35 AS text_score, it.section AS i_section, it.region AS i_region, it.unit AS i_unit, it.item_key, it.confidence_hint,
    ky.inferred_section <> '' AND it.section <> '' AS both_sections, lower(ky.inferred_section) = lower(it.section) AS sections_same, ky.region <> '' AND it.region <> '' AND lower(ky.region) = lower(it.region) AS region_same,
    ky.line_unit <> '' AND it.unit <> '' AS both_units, ky.line_unit = it.item_key AS units_same
  FROM ky JOIN scored s ON s.one = ky.q3 JOIN it ON it.item_text = s.other),
rw AS (SELECT *, text_score + CASE WHEN both_sections AND sections_same THEN 8.0 ELSE 0.0 END + CASE WHEN region_same THEN 4.0 ELSE 0.0 END + CASE WHEN both_units AND units_same THEN 6.0 ELSE 0.0 END
    - CASE WHEN both_units AND NOT units_same THEN 22.5 ELSE 0.0 END + alias_count * 5.0 + CASE WHEN alias_section THEN 5.0 ELSE 0.0 END + confidence_hint AS raw_score FROM pr),
rk AS (SELECT *, row_number() OVER (PARTITION BY q3, inferred_section, region, line_unit, alias_count, alias_section ORDER BY raw_score DESC, ordinal) AS place FROM rw QUALIFY place <= 4),
nt AS (SELECT rk.*, it.item_code, it.description AS item_description, it.rate AS item_rate, it.basis AS item_basis, it.source AS item_source,
    list_filter([CASE WHEN both_sections AND NOT sections_same THEN 'section mismatch' ELSE '' END, CASE WHEN both_units AND NOT units_same THEN concat('unit mismatch: boq=', line_unit, ' library=', rk.item_key) ELSE '' END,
      CASE WHEN line_unit = '' THEN 'missing boq unit' ELSE '' END, CASE WHEN abs(sort_score - partial_score) > 20 THEN 'unstable text score' ELSE '' END], lambda x: x <> '') AS flags,
    list_filter([printf('text=%.1f', round(text_score, 1)), printf('sort=%.1f', round(sort_score, 1)), printf('set=%.1f', round(set_score, 1)), CASE WHEN both_sections AND sections_same THEN 'section-bonus' ELSE '' END, CASE WHEN region_same THEN 'region-bonus' ELSE '' END,
      CASE WHEN both_units AND units_same THEN 'unit-bonus' ELSE '' END, CASE WHEN both_units AND NOT units_same THEN 'unit-penalty' ELSE '' END, CASE WHEN alias_count > 0 THEN 'alias-bonus' ELSE '' END, CASE WHEN alias_section THEN 'alias-section-bonus' ELSE '' END], lambda x: x <> '') AS why,
    concat(it.item_code, ' | ', it.description, ' | ', it.unit, ' | ', printf('%.2f', CAST(it.rate AS DOUBLE)), ' | ', printf('%.1f', round(raw_score, 1))) AS option_text
  FROM rk JOIN it USING (ordinal)),
al AS (SELECT q3, inferred_section, region, line_unit, alias_count, alias_section, list(option_text ORDER BY place) FILTER (place > 1 AND raw_score >= 65) AS alternates FROM nt GROUP BY ALL),
bm AS MATERIALIZED (SELECT k.*, n.item_code AS matched_item_code, n.item_description AS matched_description, n.i_unit AS matched_unit, n.item_rate AS rate, n.i_section AS section_used, coalesce(nullif(n.i_region, ''), k.region) AS region_used, n.item_basis AS basis, n.item_source AS source,
    n.raw_score, n.flags, list_concat(n.why, n.flags) AS why, coalesce(al.alternates, []) AS alternates, CASE WHEN n.raw_score >= 78 THEN 'matched' ELSE 'review' END AS decision, round(n.raw_score, 2) AS confidence_score,
    n.raw_score < 88 OR len(list_filter(n.flags, lambda x: starts_with(x, 'unit mismatch:'))) > 0 OR n.raw_score < 78 AS review_flag
  FROM kd k JOIN nt n ON n.place = 1 AND n.q3 = k.q3 AND n.inferred_section = k.inferred_section AND n.region = k.region AND n.line_unit = k.line_unit AND n.alias_count = k.alias_count AND n.alias_section = k.alias_section
    JOIN al ON al.q3 = k.q3 AND al.inferred_section = k.inferred_section AND al.region = k.region AND al.line_unit = k.line_unit AND al.alias_count = k.alias_count AND al.alias_section = k.alias_section)"""

COSTS_SQL = """
live AS (SELECT * FROM inputs WHERE active), regions AS (SELECT r_name AS region FROM region),
crates AS (SELECT r.recipe_id, g.region, r.factor, r.waste_factor, coalesce((SELECT arg_min(rate, ordinal) FROM live i WHERE i.input_code = r.component_code AND i.region = g.region), (SELECT arg_min(rate, ordinal) FROM live i WHERE i.input_code = r.component_code)) AS rate FROM recipes r CROSS JOIN regions g),
costs AS (SELECT recipe_id, region, CAST(round(sum(rate * CAST(factor AS DECIMAL(9,4)) * (1 + CAST(waste_factor AS DECIMAL(9,4)))), 2) AS DECIMAL(18,2)) AS cost FROM crates GROUP BY recipe_id, region HAVING count(*) = count(rate))"""

BUILD_SQL = f"""{COSTS_SQL},
bk AS (SELECT DISTINCT description, inferred_section, unit, region, q0 FROM kd WHERE description <> ''),
bs AS (SELECT bk.*, hd.*, c.cost, s.sort_score + CASE WHEN recipe_section <> '' AND inferred_section <> '' AND lower(recipe_section) = lower(inferred_section) THEN 8.0 ELSE 0.0 END
    + CASE WHEN unit <> '' AND output_unit <> '' AND {sql_unit('unit')} = {sql_unit('output_unit')} THEN 6.0 ELSE 0.0 END AS buildup_raw
  FROM bk CROSS JOIN hd JOIN scored s ON s.one = bk.q0 AND s.other = {sql_normalized('output_description')} JOIN costs c ON c.recipe_id = hd.recipe_id AND c.region = bk.region),
bu AS (SELECT *, least(buildup_raw, 95.0) AS buildup_score, CASE WHEN buildup_raw >= 78 THEN 'matched' ELSE 'review' END AS buildup_decision, buildup_raw < 78 AS buildup_flag,
    row_number() OVER (PARTITION BY description, inferred_section, unit, region ORDER BY least(buildup_raw, 95.0) DESC, head) AS turn FROM bs WHERE buildup_raw >= 60 QUALIFY turn = 1)"""

PRICE_SQL = f"""{MATCH_SQL}, {BUILD_SQL},
ar AS (SELECT m.*, b.recipe_id, b.output_description, b.output_unit, b.recipe_section, b.cost, b.buildup_score, b.buildup_decision, b.buildup_flag, m.confidence_score < 78 AS weak,
    coalesce(m.confidence_score < 78 AND b.buildup_score >= m.confidence_score, FALSE) AS wins FROM bm m LEFT JOIN bu b ON b.description = m.description AND b.inferred_section = m.inferred_section AND b.unit = m.unit AND b.region = m.region),
ab2 AS (SELECT boq_id, sheet_name, row_number, description, unit, quantity, region, inferred_section, wins AS built_up,
    CASE WHEN wins THEN recipe_id ELSE matched_item_code END AS matched_item_code, CASE WHEN wins THEN output_description ELSE matched_description END AS matched_description, CASE WHEN wins THEN output_unit ELSE matched_unit END AS matched_unit,
    CASE WHEN wins THEN cost ELSE rate END AS base_rate, CASE WHEN wins THEN recipe_section ELSE section_used END AS section_used, CASE WHEN wins THEN buildup_decision ELSE decision END AS decision, CASE WHEN wins THEN buildup_flag ELSE review_flag END AS review_flag,
    CASE WHEN wins THEN 'BuildUpRecipes' ELSE source END AS source, CASE WHEN wins THEN concat('Build-up recipe ', recipe_id) ELSE basis END AS basis, CASE WHEN wins THEN region ELSE region_used END AS region_used, CASE WHEN wins THEN [] ELSE flags END AS flags, CASE WHEN wins THEN [] ELSE alternates END AS alternates,
    CASE WHEN wins THEN buildup_score ELSE confidence_score END AS confidence_score,
    list_concat(CASE WHEN wins THEN [] ELSE why END, CASE WHEN NOT weak THEN [] WHEN buildup_score IS NULL THEN ['no build-up candidate available']
      WHEN wins THEN ['build-up fallback', concat('recipe ', recipe_id), printf('direct-match-score=%.2f', confidence_score), 'build-up selected over direct match', printf('direct-rate=%.2f', CAST(rate AS DOUBLE))]
      ELSE [printf('build-up-score=%.2f', round(buildup_score, 2)), 'direct match retained over build-up'] END) AS rationale FROM ar),
fl AS (SELECT * REPLACE (CASE WHEN confidence_score < 65 THEN 'unmatched' ELSE decision END AS decision, review_flag OR confidence_score < 65 AS review_flag, CASE WHEN confidence_score < 65 THEN list_append(flags, 'low confidence requires manual pricing review') ELSE flags END AS flags),
    coalesce(nullif(section_used, ''), nullif(inferred_section, ''), sheet_name) AS section FROM ab2),
adj AS (SELECT lower(region) AS region, lower(trim(section)) AS section, ordinal, factor, notes FROM adjustments WHERE active),
fa AS (SELECT fl.*, coalesce((SELECT arg_min(factor, ordinal) FROM adj WHERE adj.region = lower(fl.region) AND adj.section = lower(fl.section)), (SELECT arg_min(factor, ordinal) FROM adj WHERE adj.region = lower(fl.region) AND adj.section IN ('', '*')), 1) AS regional_factor,
    coalesce((SELECT arg_min(notes, ordinal) FROM adj WHERE adj.region = lower(fl.region) AND adj.section = lower(fl.section)), (SELECT arg_min(notes, ordinal) FROM adj WHERE adj.region = lower(fl.region) AND adj.section IN ('', '*')), '') AS factor_notes FROM fl),
pz AS (SELECT *, CAST(round(base_rate * regional_factor, 2) AS DECIMAL(18,2)) AS rate, CASE WHEN decision = 'matched' AND NOT review_flag THEN 'Approved for Pricing' ELSE 'Pending Commercial Review' END AS approval_status,
    CASE WHEN regional_factor <> 1 THEN list_concat(rationale, list_filter([printf('regional-factor=%.3f', CAST(regional_factor AS DOUBLE)), factor_notes], lambda x: x <> '')) ELSE rationale END AS all_rationale,
    list_filter(list_concat(flags, [CASE WHEN coalesce(basis, '') = '' THEN 'Missing basis of rate' ELSE '' END, CASE WHEN len(alternates) > 0 THEN 'Alternate rate options available' ELSE '' END, CASE WHEN review_flag THEN 'Confidence below strong threshold' ELSE '' END, CASE WHEN built_up THEN 'Build-up fallback used' ELSE '' END]), lambda x: x <> '') AS with_flags FROM fa),
priced AS MATERIALIZED (SELECT *, list_filter(with_flags, lambda x, i: list_position(with_flags, x) = i) AS all_flags FROM pz)"""
