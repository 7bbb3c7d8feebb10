"""Queries of the data-pipeline operators (problems 1 to 7), over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.column_profile import count_loads, profile_loads
from panelspark.operators.drift import field_changes, read_studies, schema_changes
from panelspark.operators.grid import holdout_error, regular_grid
from panelspark.operators.parse_rows import CLOSE_NAMES, DATE_NAMES, DELIMITERS, MISSING, SYMBOL_NAMES, parse_lines
from panelspark.operators.rolling import trailing_totals
from panelspark.operators.spikes import flag_readings, source_cutoffs
from panelspark.operators.timestamps import normalise_timestamps

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    flags = flag_readings(table(spark, d, "long_prices"))
    return flags.where("implausible OR spike OR stuck").select(F.col("source").alias("symbol"), "day_iso")


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    return flag_readings(table(spark, d, "long_prices"))


def p1_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """The fit behind each source's cutoff."""
    return source_cutoffs(table(spark, d, "long_prices"))


def p2_times(spark: SparkSession, d: str) -> DataFrame:
    feeds = table(spark, d, "feeds")
    parts = [normalise_timestamps(table(spark, d, t), feeds).select(F.lit(t).alias("table_name"), "*") for t in ("long_feed", "wide_prices")]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_times(spark, d).where("epoch_ms IS NOT NULL").select("table_name", "row_id", "epoch_ms")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "long_lines"))[1]


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "long_lines"))[0]


def p4_trailing(spark: SparkSession, d: str) -> DataFrame:
    r = trailing_totals(table(spark, d, "long_prices"))
    figures = [c for w in (7, 30) for c in (F.round(f"total_{w}", 6).alias(f"total_{w}"), F.try_divide(F.round(f"total_{w}", 6), f"n_{w}").alias(f"mean_{w}"))]
    return r.select(F.col("entity").alias("symbol"), F.col("day").cast("string").alias("day_iso"), "n_7", "n_30", *figures)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    r = trailing_totals(table(spark, d, "long_prices"))
    return r.where("n_7 = 0").select(F.col("entity").alias("symbol"), F.col("day").cast("string").alias("day_iso"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "study_files")).select("stream_id", F.col("file_no").cast("int").alias("file_no"), "field_name", "change_kind", "new_name")


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    return field_changes(table(spark, d, "study_files"))


def p5_studies(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "study_files")
    return read_studies(files, approved=field_changes(files).where("change_kind = 'renamed'"))


LOAD_COLUMNS = {"date": "date", "symbol": "text", "close": "number"}


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile_loads(table(spark, d, "long_loads"), LOAD_COLUMNS).withColumn("departs", F.array_join("departs", ","))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """The exact part of the profile: counts, distinct and most frequent values."""
    r = count_loads(table(spark, d, "long_loads"), LOAD_COLUMNS)
    return r.select("load_id", "column_name", "n", "n_null", "n_distinct", F.round("mode_share", 9).alias("mode_share"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return profile_loads(table(spark, d, "long_loads"), LOAD_COLUMNS).where(F.size("departs") > 0).select("load_id", "column_name")


def p7_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "long_marks"), table(spark, d, "feeds"))


def p7_periods(spark: SparkSession, d: str) -> DataFrame:
    """The grid without what imputation makes of the missing periods."""
    known = F.when(~F.col("filled"), F.round("value", 6))
    return p7_grid(spark, d).select("source", "slot_s", "n", "filled", known.alias("value"))


def p7_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the imputation and of a straight line at hidden readings."""
    return holdout_error(table(spark, d, "long_marks"), table(spark, d, "feeds"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_grid(spark, d).where("filled").select(F.col("source").alias("symbol"), "slot_s")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_flags, p1_cutoffs, p2_found, p2_times, p3_found, p3_loaded, p4_found, p4_trailing, p5_found, p5_changes, p5_studies, p6_found, p6_counts, p6_profile, p7_found, p7_grid, p7_periods, p7_holdout)}

_CLOSES = """
closes AS (SELECT DISTINCT upper(trim(symbol)) AS symbol, date AS day, close FROM long_prices
           WHERE symbol IS NOT NULL AND trim(symbol) <> '' AND date IS NOT NULL AND close IS NOT NULL AND NOT isnan(close)),
spans AS (SELECT symbol, min(day) AS a, max(day) AS z FROM closes GROUP BY 1),
calendar AS (SELECT symbol, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
daily AS (SELECT symbol, day, count(*) AS n, sum(close) AS s FROM closes GROUP BY 1, 2),
dense AS (SELECT symbol, day, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM calendar LEFT JOIN daily USING (symbol, day)),
rolled AS (SELECT symbol, day,
  CAST(sum(n) OVER (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS n_7, sum(s) OVER (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING) AS s_7,
  CAST(sum(n) OVER (PARTITION BY symbol ORDER BY day ROWS 29 PRECEDING) AS BIGINT) AS n_30, sum(s) OVER (PARTITION BY symbol ORDER BY day ROWS 29 PRECEDING) AS s_30 FROM dense)
"""

ORACLE: dict[str, str] = {
    "p4_found": f"WITH {_CLOSES} SELECT symbol, CAST(day AS VARCHAR) AS day_iso FROM rolled WHERE n_7 = 0",
    "p4_trailing": f"""WITH {_CLOSES} SELECT symbol, CAST(day AS VARCHAR) AS day_iso, n_7, n_30,
      CASE WHEN n_7 > 0 THEN round(s_7, 6) END AS total_7, CASE WHEN n_7 > 0 THEN round(s_7, 6) / n_7 END AS mean_7,
      CASE WHEN n_30 > 0 THEN round(s_30, 6) END AS total_30, CASE WHEN n_30 > 0 THEN round(s_30, 6) / n_30 END AS mean_30 FROM rolled""",
    "p6_counts": """WITH l AS (SELECT vendor_id, load_id, 'date' AS column_name, date AS v FROM long_loads UNION ALL SELECT vendor_id, load_id, 'symbol', symbol FROM long_loads UNION ALL SELECT vendor_id, load_id, 'close', CAST(close AS VARCHAR) FROM long_loads),
      c AS (SELECT vendor_id, load_id, column_name, v, count(*) AS k FROM l GROUP BY 1, 2, 3, 4)
      SELECT load_id, column_name, CAST(sum(k) AS BIGINT) AS n, CAST(coalesce(sum(k) FILTER (v IS NULL), 0) AS BIGINT) AS n_null, count(v) AS n_distinct, round(max(k) FILTER (v IS NOT NULL) / sum(k) FILTER (v IS NOT NULL), 9) AS mode_share FROM c GROUP BY vendor_id, load_id, column_name""",
    "p7_found": """WITH marks AS (SELECT upper(trim(symbol)) AS symbol, CAST(floor(epoch(date)) AS BIGINT) AS t, CAST(grid_s AS BIGINT) AS g
        FROM long_marks JOIN feeds USING (feed_id) WHERE symbol IS NOT NULL AND trim(symbol) <> '' AND close IS NOT NULL AND isfinite(close)),
      slots AS (SELECT DISTINCT symbol, g, t - t % g AS slot_s FROM marks),
      days AS (SELECT symbol, g, slot_s // 86400 AS d, min(slot_s) AS a, max(slot_s) AS z FROM slots GROUP BY 1, 2, 3),
      grid AS (SELECT symbol, unnest(generate_series(a, z, g)) AS slot_s FROM days)
      SELECT symbol, slot_s FROM grid EXCEPT SELECT symbol, slot_s FROM slots""",
    "p7_periods": """WITH marks AS (SELECT upper(trim(symbol)) AS symbol, CAST(floor(epoch(date)) AS BIGINT) AS t, CAST(grid_s AS BIGINT) AS g, close
        FROM long_marks JOIN feeds USING (feed_id) WHERE symbol IS NOT NULL AND trim(symbol) <> '' AND close IS NOT NULL AND isfinite(close)),
      slots AS (SELECT symbol, g, t - t % g AS slot_s, count(*) AS n, avg(close) AS v FROM marks GROUP BY 1, 2, 3),
      days AS (SELECT symbol, g, slot_s // 86400 AS d, min(slot_s) AS a, max(slot_s) AS z FROM slots GROUP BY 1, 2, 3),
      grid AS (SELECT symbol, unnest(generate_series(a, z, g)) AS slot_s FROM days)
      SELECT symbol AS source, slot_s, coalesce(n, 0) AS n, n IS NULL AS filled, round(v, 6) AS value FROM grid LEFT JOIN slots USING (symbol, slot_s)""",
}


def _cells(d: str, line: str) -> str:
    c = {"\t": r"\t", "|": r"\|"}.get(d, d)
    raw = f"""regexp_extract_all('{d}' || {line}, '{c}("[^"]*(?:""[^"]*)*"|[^{c}"]*)', 1)"""
    return f"""list_transform({raw}, lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END)"""


def _quoted(d: str, line: str) -> str:
    c = {"\t": r"\t", "|": r"\|"}.get(d, d)
    field = f"""(?:"[^"]*(?:""[^"]*)*"|[^{c}"]*)"""
    return f"regexp_full_match({line}, '{field}(?:{c}{field})*')"


def _each(f, line: str) -> str:
    return "CASE " + " ".join(f"WHEN d = '{d}' THEN {f(d, line)}" for d in DELIMITERS) + " END"


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279))"
_ROLE = f"CASE WHEN n IN {_in(DATE_NAMES)} THEN 'date' WHEN n IN {_in(SYMBOL_NAMES)} THEN 'symbol' WHEN n IN {_in(CLOSE_NAMES)} THEN 'close' END"
_COUNTS = "[" + ", ".join(f"{{'k': length(b) - length(replace(b, '{d}', '')), 'i': {-i}, 'd': '{d}'}}" for i, d in enumerate(DELIMITERS)) + "]"

LINES = f"""WITH t AS (SELECT line_id, file_id, line_no, regexp_replace(regexp_replace(line, chr(13) || '$', ''), '^' || chr(65279), '') AS t FROM long_lines),
  h AS (SELECT file_id, arg_min(t, line_id) AS h FROM t WHERE line_no = 1 GROUP BY 1), b AS (SELECT file_id, h, regexp_replace(h, '"[^"]*(?:""[^"]*)*"', '', 'g') AS b FROM h),
  e AS (SELECT file_id, h, list_max({_COUNTS}).d AS d FROM b), n AS (SELECT file_id, d, list_transform({_each(_cells, 'h')}, lambda x: lower({_TRIM.format('x')})) AS names FROM e),
  r AS (SELECT file_id, d, list_transform(names, lambda n: {_ROLE}) AS roles FROM n), l AS (SELECT line_id, t, d, roles FROM t LEFT JOIN r USING (file_id) WHERE line_no <> 1 AND {_TRIM.format('t')} <> ''),
  q AS (SELECT line_id, {_each(_quoted, 't')} AS ok, {_each(_cells, 't')} AS c, roles FROM l),
  v AS (SELECT line_id, ok, length(c) = length(roles) AS wide, {", ".join(_TRIM.format(f"c[list_position(roles, '{x}')]") + f" AS {x}" for x in ("date", "symbol", "close"))} FROM q),
  z AS (SELECT line_id, date, symbol, close, CASE WHEN NOT ok THEN 'quoting' WHEN NOT wide THEN 'column_count' WHEN NOT coalesce(regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(date AS DATE) IS NOT NULL, false) OR date LIKE '0000%' THEN 'bad_date'
    WHEN NOT coalesce(regexp_full_match(symbol, '[A-Za-z0-9.-]{{1,12}}'), false) THEN 'bad_symbol'
    WHEN NOT coalesce(lower(close) IN {_in(MISSING)} OR (regexp_full_match(close, '[+-]?([0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]*)?|[0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(try_cast(replace(close, ',', '') AS DOUBLE))), false) THEN 'bad_close' END AS reason FROM v)"""

ORACLE["p3_found"] = f"{LINES} SELECT line_id, reason FROM z WHERE reason IS NOT NULL"
ORACLE["p3_loaded"] = f"""{LINES} SELECT line_id, CAST(date AS DATE) AS date, upper(symbol) AS symbol, CASE WHEN lower(close) NOT IN {_in(MISSING)} THEN CAST(replace(close, ',', '') AS DOUBLE) END AS close
  FROM z WHERE reason IS NULL"""

_KIND = "CASE json_type({0}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END"

# fields of one file pair up by type and parent; the tables hold at most one such pair a file, so no closeness is needed
ORACLE["p5_found"] = f"""WITH f AS (SELECT stream_id, file_no, arg_min(CAST(body AS JSON), received_at) AS body FROM study_files GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY file_no) AS r, count(*) OVER (PARTITION BY stream_id) AS n FROM f),
  a AS (SELECT stream_id, file_no, r, n, body, unnest(json_keys(body)) AS k FROM o), p AS (SELECT stream_id, file_no, r, n, json_extract(body, '$.performance') AS body, unnest(json_keys(body, '$.performance')) AS k FROM o),
  x AS (SELECT stream_id, file_no, r, n, '' AS parent, k AS name, {_KIND.format("json_extract(body, '$.' || k)")} AS jtype FROM a UNION ALL SELECT stream_id, file_no, r, n, 'performance', 'performance.' || k, {_KIND.format("json_extract(body, '$.' || k)")} FROM p),
  s AS (SELECT stream_id, parent, name, max(n) AS n, count(*) AS c, min(r) AS lo, max(r) AS hi, arg_min(file_no, r) AS first_no, arg_min(jtype, r) FILTER (jtype IS NOT NULL) AS t0, arg_max(jtype, r) FILTER (jtype IS NOT NULL) AS t1 FROM x GROUP BY 1, 2, 3),
  late AS (SELECT stream_id, parent, name, lo AS r, first_no AS file_no, t0 AS t FROM s WHERE lo > 1 AND hi = n AND c = n - lo + 1), gone AS (SELECT s.stream_id, parent, name, hi + 1 AS r, o.file_no, t1 AS t FROM s JOIN o ON o.stream_id = s.stream_id AND o.r = hi + 1 WHERE lo = 1 AND hi < s.n AND c = hi),
  m AS (SELECT g.stream_id, g.file_no, g.name AS old, l.name AS new FROM gone g JOIN late l ON g.stream_id = l.stream_id AND g.r = l.r AND g.parent = l.parent AND g.t = l.t),
  y AS (SELECT stream_id, name, jtype, min(r) AS lo, max(r) AS hi, arg_min(file_no, r) AS no FROM x WHERE jtype IS NOT NULL GROUP BY 1, 2, 3), w AS (SELECT *, lag(hi) OVER (PARTITION BY stream_id, name ORDER BY lo) AS before FROM y)
  SELECT stream_id, CAST(file_no AS INTEGER) AS file_no, name AS field_name, 'added' AS change_kind, '' AS new_name FROM late WHERE (stream_id, name) NOT IN (SELECT (stream_id, new) FROM m)
  UNION ALL SELECT stream_id, CAST(file_no AS INTEGER), name, 'removed', '' FROM gone WHERE (stream_id, name) NOT IN (SELECT (stream_id, old) FROM m)
  UNION ALL SELECT stream_id, CAST(file_no AS INTEGER), old, 'renamed', new FROM m
  UNION ALL SELECT stream_id, CAST(no AS INTEGER), name, 'type_changed', '' FROM w WHERE before < lo"""
