"""Queries of the general data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.common import table
from pulsegrid.operators import faults, nested, timestamps, units

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.moments(table(spark, sf_dir, "records"), table(spark, sf_dir, "sites"))


def p1_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = timestamps.readings(table(spark, sf_dir, "records"), table(spark, sf_dir, "sites"))
    return df.withColumn("posterior", F.round("posterior", 6))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.common_units(table(spark, sf_dir, "records"), table(spark, sf_dir, "leads"), table(spark, sf_dir, "sites"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.lead_faults(table(spark, sf_dir, "leads"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_payloads(table(spark, sf_dir, "raw_payloads"))


def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_payloads(table(spark, sf_dir, "raw_payloads"), True)


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_readings": p1_readings, "p2_found": p2_found, "p6_found": p6_found, "p7_found": p7_found, "p7_values": p7_values}


def _units_sql() -> str:
    """Problem 2 by what the texts declare; the scales found through links must agree with these."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    words = {(q, w.replace("µ", "u").replace("μ", "u") if q == "sample_step" else w): v for q, ws in units.DECLARED.items() for w, v in ws.items()}
    declared = ", ".join(f"({quote(q)}, {quote(w)}, CAST({v!r} AS DOUBLE))" for (q, w), v in words.items())
    double = quote(r"""^(\d{1,3}) ?(st|stones?|ft|feet|foot|'|′|’)\.? ?(\d{1,2}(?:[.,]\d+)?) ?(lbs?|pounds?|in|inch|inches|"|″|”|'')?\.?$""")
    single = quote(r"^(\d+(?:[.,]\d+)?) ?([^\d\s]*)$")
    number = lambda s: f"CAST(replace(nullif({s}, ''), ',', '.') AS DOUBLE)"
    count = "units?|counts?|lsbs?|adus?|bits?|steps?|digits?|1"
    clean = lambda c: f"regexp_replace(regexp_replace(regexp_replace(lower({c}), '[\\s\\-_.]+', '', 'g'), '[µμ]', 'u', 'g'), '(/|per)({count})$', '')"
    word = lambda c: f"CASE WHEN regexp_full_match({c}, '\\p{{L}}{{1,12}}') AND {c} NOT IN ('na', 'arb', 'none', 'null', 'unknown', 'au') THEN {c} END"
    pair = lambda x, w: f"WHEN {w} IS NOT NULL AND {x} IS NOT NULL THEN {{'x': {x}, 'w': {w}}} "
    noted, inches, words_in = quote(units.NOTED_PATTERN), quote(units.NOTED_INCHES), lambda q: ", ".join(map(quote, units.NOTED[q]))
    return f"""
WITH declared(quantity, notation, scale) AS (VALUES {declared}),
typed AS (
  SELECT record_id, site_id, annotations, 'weight' AS quantity, patient.weight AS t FROM records UNION ALL SELECT record_id, site_id, annotations, 'height', patient.height FROM records
),
said AS (SELECT record_id, quantity, measure_system, list_filter(list_transform(string_split_regex(lower(array_to_string(map_values(annotations), ' ; ')), '[;|]'), lambda x: regexp_extract(regexp_replace(x, {inches}, ' inches'), {noted}, 1)), lambda w: CASE quantity WHEN 'weight' THEN w IN ({words_in("weight")}) ELSE w IN ({words_in("height")}) END)[1] AS noted, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS s FROM typed LEFT JOIN sites USING (site_id)),
parts AS (
  SELECT record_id, quantity, measure_system, noted, CASE WHEN regexp_matches(s, {double})
    THEN {number(f"regexp_extract(s, {double}, 1)")} + {number(f"regexp_extract(s, {double}, 3)")} / CASE WHEN starts_with(regexp_extract(s, {double}, 2), 'st') THEN 14 ELSE 12 END
    ELSE {number(f"regexp_extract(s, {single}, 1)")} END AS x,
    CASE WHEN regexp_matches(s, {double}) THEN regexp_extract(s, {double}, 2) ELSE rtrim(regexp_extract(s, {single}, 2), '.') END AS w FROM said
),
body AS (SELECT record_id, -1 AS lead_no, quantity, x, CASE WHEN w = '' THEN coalesce(noted, 'bare:' || measure_system) ELSE w END AS notation FROM parts WHERE x > 0),
l0 AS (
  SELECT record_id, lead_no, coalesce(is_raw, trim(coalesce(units, '')) = '') AS raw, CASE WHEN resolution > 0 THEN resolution END AS r, CASE WHEN adc_resolution > 0 THEN adc_resolution END AS a,
    {clean("resolution_unit")} AS res, {clean("units")} AS u, {clean("adc_resolution_unit")} AS adc,
    {clean("regexp_extract(lower(array_to_string(map_values(annotations), ' | ')), '(?:^|[^\\p{L}])((?:nano|micro|milli)?[ -]?volts?|[nuµμm]v)(?:[^\\p{L}]|$)', 1)")} AS note FROM leads
),
l1 AS (SELECT *, nullif(regexp_extract(res, '^(?:{count})(?:/|per)(\\p{{L}}+)$', 1), '') AS per, {word("res")} AS wr, {word("u")} AS wu, {word("adc")} AS wa, {word("note")} AS wn FROM l0),
l2 AS (
  SELECT record_id, lead_no, CASE WHEN raw THEN CASE {pair("1 / r", "per")}{pair("r", "wr")}{pair("a", "wa")}{pair("r", "wn")}{pair("r", "wu")}END
    ELSE CASE {pair("CAST(1 AS DOUBLE)", "wu")}{pair("CAST(1 AS DOUBLE)", "wr")}{pair("CAST(1 AS DOUBLE)", "wn")}END END AS c FROM l1
),
every AS (SELECT record_id, lead_no, quantity, x, notation FROM body UNION ALL SELECT record_id, lead_no, 'sample_step', c.x, c.w FROM l2 WHERE c IS NOT NULL)
SELECT DISTINCT record_id, CAST(lead_no AS BIGINT) AS lead_no, quantity, CAST(round(round(x * scale, 6)) AS BIGINT) AS amount FROM every JOIN declared USING (quantity, notation)"""


_NESTED_SQL = r"""
WITH p AS (SELECT DISTINCT record_id, CAST(payload AS JSON) AS j FROM raw_payloads WHERE json_valid(payload)),
o AS (SELECT record_id, j FROM p WHERE json_type(j) = 'OBJECT'),
l AS (
  SELECT record_id, j->'$.leads' AS lead, '0' AS k FROM o WHERE json_type(j, '$.leads') = 'OBJECT'
  UNION ALL
  SELECT record_id, json_extract(j, '$.leads[' || i || ']'), CAST(i AS VARCHAR) FROM (SELECT record_id, j, unnest(range(0, CAST(json_array_length(j, '$.leads') AS BIGINT))) AS i FROM o WHERE json_type(j, '$.leads') = 'ARRAY')
),
named AS (
  SELECT record_id, 'lead_annotation' AS child, k AS parent_key, lead->'$.annotations' AS a FROM l WHERE json_type(lead) = 'OBJECT'
  UNION ALL SELECT record_id, 'annotation', '', j->'$.annotations' FROM o
  UNION ALL SELECT record_id, 'measurement', '', j->'$.measurements' FROM o
),
names AS (
  SELECT record_id, child, parent_key, a, unnest(json_keys(a)) AS child_key FROM named WHERE json_type(a) = 'OBJECT'
  UNION ALL
  SELECT record_id, child, parent_key, json_object(e->>'$.name', e->'$.value'), e->>'$.name' FROM (SELECT record_id, child, parent_key, unnest(CAST(a AS JSON[])) AS e FROM named WHERE json_type(a) = 'ARRAY') WHERE json_type(e, '$.name') = 'VARCHAR'
),
m0 AS (SELECT record_id, CASE WHEN json_type(j, '$.raw_metadata') = 'VARCHAR' THEN j->>'$.raw_metadata' ELSE CAST(j->'$.raw_metadata' AS VARCHAR) END AS t FROM o),
m AS (SELECT record_id, CAST(t AS JSON) AS j FROM m0 WHERE t IS NOT NULL AND json_valid(t)),
tree AS (SELECT m.record_id, t.fullkey, t.type FROM m, json_tree(m.j) AS t),
leaf AS (SELECT record_id, replace(replace(replace(replace(substr(fullkey, 2), '].', '/'), '[', '/'), ']', ''), '.', '/') AS path FROM tree WHERE type NOT IN ('OBJECT', 'ARRAY') AND fullkey <> '$')
SELECT DISTINCT * FROM (
  SELECT record_id, 'lead' AS child, '' AS parent_key, k AS child_key FROM l
  UNION ALL SELECT record_id, child, parent_key, child_key FROM names WHERE child <> 'measurement' OR json_type(a, '$."' || child_key || '"') <> 'NULL'
  UNION ALL SELECT record_id, 'metadata', CASE WHEN contains(substr(path, 2), '/') THEN regexp_replace(substr(path, 2), '/[^/]*$', '') ELSE '' END, substr(path, 2) FROM leaf
)"""
ORACLES: dict[str, str] = {"p2_found": _units_sql(), "p7_found": _NESTED_SQL}
