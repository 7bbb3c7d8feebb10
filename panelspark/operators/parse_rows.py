"""Problem 3: rows that fail to parse, apart from those that load, with the first reason that holds.

Each line is judged by one anchored grammar for its file's delimiter, cut into cells, and exploded into row,
column and value. The cells meet a table of rules by the role of their column; the violations alone are
aggregated to one reason a line, and the lines without any are the loaded records (an anti-join). All of it is
column expressions: quantifiers are possessive, so that long fields neither backtrack nor recurse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.exprs import strip
from panelspark.plans.local import local_table

# --- fixed values: header names of the three columns, spellings of a missing number, delimiters ------------------
DATE_NAMES = ["date", "time", "timestamp", "dt", "day", "asof", "as_of"]
SYMBOL_NAMES = ["symbol", "ticker", "name", "instrument", "asset", "id"]
CLOSE_NAMES = ["close", "price", "value", "adj_close", "adjclose", "return", "returns", "ret", "pnl"]
MISSING = ["", "na", "n/a", "nan", "null", "none", "-"]
DELIMITERS = [",", ";", "\t", "|"]
# ----------------------------------------------------------------------------------------------------------------

#: in order of precedence: reason, role of the column it looks at (None: the whole line)
RULES = [("quoting", None), ("column_count", None), ("bad_date", "date"), ("bad_symbol", "symbol"), ("bad_close", "close")]

QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})++(?:\.\d*+)?|\d++(?:\.\d*+)?|\.\d++)(?:[eE][+-]?\d++)?"


def _cls(d: str) -> str:
    return {"\t": r"\t", "|": r"\|"}.get(d, d)


def _by_delimiter(delim: Column, f) -> Column:
    out = F.lit(None)
    for d in DELIMITERS:
        out = F.when(delim == F.lit(d), f(d)).otherwise(out)
    return out


def well_quoted(line: Column, delim: Column) -> Column:
    """Whether every quote opens at a field's start, is closed at its end and doubled inside."""

    def grammar(d: str) -> Column:
        c = _cls(d)
        field = rf'(?:{QUOTED}|[^{c}"]*+)'
        return F.regexp(line, F.lit(rf"(?s)\A{field}(?:{c}{field})*+\z"))

    return _by_delimiter(delim, grammar)


def cells(line: Column, delim: Column) -> Column:
    """Fields of a well quoted line, without their quotes."""

    def cut(d: str) -> Column:
        c = _cls(d)
        return F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(rf'(?s){c}({QUOTED}|[^{c}"]*+)'), F.lit(1))

    raw = _by_delimiter(delim, cut)
    return F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def close_number(text: Column) -> Column:
    """The decimal number a text denotes, or null: sign, exponent, thousands commas in groups of three."""
    t = strip(text)
    v = F.regexp_replace(t, ",", "").try_cast("double")
    return F.when(F.regexp(t, F.lit(r"\A" + NUMBER + r"\z")) & (F.abs(v) < float("inf")), v)


def real_day(text: Column) -> Column:
    """The date a text YYYY-MM-DD denotes, or null where there is no such day."""
    t = strip(text)
    return F.when(F.regexp(t, F.lit(r"\A\d{4}-\d{2}-\d{2}\z")) & ~t.startswith("0000"), t.try_cast("date"))


def _role(name: Column) -> Column:
    n = F.lower(strip(name))
    return F.when(n.isin(DATE_NAMES), "date").when(n.isin(SYMBOL_NAMES), "symbol").when(n.isin(CLOSE_NAMES), "close")


def _ok(role: Column, value: Column) -> Column:
    t = strip(value)
    return (
        F.when(role == "date", real_day(value).isNotNull())
        .when(role == "symbol", F.regexp(t, F.lit(r"\A[A-Za-z0-9.\-]{1,12}\z")))
        .when(role == "close", F.lower(t).isin(MISSING) | close_number(value).isNotNull())
    )


def _body(df: DataFrame, line_id: str, file_id: str, line_no: str, line: str) -> DataFrame:
    """``line_id, _roles, _q, _c`` of each body line: its file's roles, whether it is well quoted, its cells."""
    text = F.regexp_replace(F.col(line), r"(?s)\A﻿|\r\z", "")
    rows = df.select(F.col(line_id).alias("line_id"), F.col(file_id).alias("_f"), F.col(line_no).alias("_n"), text.alias("_t"))
    # headers: the delimiter whose split of the header names the three roles, else the one that occurs most
    head = rows.where("_n = 1").groupBy("_f").agg(F.min(F.struct("line_id", "_t"))["_t"].alias("_h"))
    bare = F.regexp_replace("_h", QUOTED, "")
    scored = F.array(*[F.struct(F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))), F.lit(-i), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    head = head.select("_f", "_h", F.array_max(scored)["d"].alias("_d"))
    head = head.select("_f", "_d", F.transform(cells(F.col("_h"), F.col("_d")), _role).alias("_roles"))
    usable = F.array_contains("_roles", "date") & F.array_contains("_roles", "symbol") & F.array_contains("_roles", "close")
    head = head.select("_f", "_d", F.when(usable, F.col("_roles")).alias("_roles"))
    body = rows.where("_n IS NULL OR _n <> 1").where(strip(F.col("_t")) != "")
    body = body.join(head, "_f", "left")
    fine = F.coalesce(well_quoted(F.col("_t"), F.col("_d")), F.lit(True))
    return body.select("line_id", "_roles", fine.alias("_q"), F.when(fine, cells(F.col("_t"), F.col("_d"))).alias("_c"))


def close_cells(df: DataFrame, line_id: str = "line_id", file_id: str = "file_id", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """``line_id, cell``: the whole close cell of every body line; null where the line is badly quoted or too short, or its file names no close."""
    body = _body(df, line_id, file_id, line_no, line)
    return body.select("line_id", F.get("_c", (F.array_position("_roles", "close") - 1).cast("int")).alias("cell"))


def parse_lines(
    df: DataFrame, line_id: str = "line_id", file_id: str = "file_id", line_no: str = "line_no", line: str = "line"
) -> tuple[DataFrame, DataFrame]:
    """``(loaded, failed)``: ``loaded`` has ``line_id, date, symbol, close``, ``failed`` has ``line_id, reason``.

    * line number 1 is its file's header (of repeated ones the first by line id); headers and blank lines are in neither;
    * null lines count as blank; one closing carriage return and a byte order mark at the start of a line are no part of it;
    * a file without a header, or one that names no date, symbol or close, can't be read: its lines fail as ``column_count``;
    * of several columns for a role the first is used; other columns only count;
    * ``line_id`` names a line: rows that repeat one fail together, as one row, by their first reason, or load one by one;
      null is a line id of its own; an empty table gives two empty ones;
    * columns beyond the four named are ignored, whatever their names.
    """
    body = _body(df, line_id, file_id, line_no, line)
    width = F.col("_roles").isNotNull() & (F.size("_c") == F.size("_roles"))
    body = body.select("line_id", "_q", F.coalesce(width, F.lit(False)).alias("_w"), "_c", "_roles")

    # row, column, value: the whole line is the column without a role
    first = lambda role: F.col("_c")[F.array_position("_roles", role).cast("int") - 1]
    cell = lambda role, value: F.struct(F.lit(role).alias("role"), value.alias("value"))
    whole = F.array(F.struct(F.lit("line").alias("role"), F.when(F.col("_q"), F.lit("columns")).otherwise("quotes").alias("value")))
    parsed = F.array(*[cell(r, first(r)) for r in ("date", "symbol", "close")])
    long = body.select("line_id", F.explode(F.when(F.col("_q") & F.col("_w"), parsed).otherwise(whole)).alias("x")).select("line_id", "x.role", "x.value")
    spark = df.sparkSession
    rules = local_table(spark, [(role or "line", reason, k) for k, (reason, role) in enumerate(RULES)], "rule_role string, reason string, precedence int")
    broken = (
        F.when(F.col("reason") == "quoting", F.col("value") == "quotes")
        .when(F.col("reason") == "column_count", F.col("value") == "columns")
        .otherwise(~F.coalesce(_ok(F.col("role"), F.col("value")), F.lit(False)))
    )
    violations = long.join(rules, long["role"] == rules["rule_role"]).where(broken)
    failed = violations.groupBy("line_id").agg(F.min(F.struct("precedence", "reason"))["reason"].alias("reason"))
    bad = failed.select(F.col("line_id").alias("_bad"))
    sound = body.where("_q AND _w").join(bad, F.col("line_id").eqNullSafe(F.col("_bad")), "left_anti")
    loaded = sound.select("line_id", real_day(first("date")).alias("date"), F.upper(strip(first("symbol"))).alias("symbol"), close_number(first("close")).alias("close"))
    return loaded, failed
