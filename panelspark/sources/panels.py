"""Reading panels: delimited and columnar files of three shapes, recognised by their header alone, to long form.

The driver peeks at the first 8 KB for delimiter and header; everything else is one native scan with all columns as
text, so parsing stays distributed. A gap in a wide file is a gap: nothing is filled.
"""

from __future__ import annotations

import csv
import importlib.util
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import clean_symbol, div, strip
from panelspark.operators.parse_rows import CLOSE_NAMES, DATE_NAMES, DELIMITERS, MISSING, SYMBOL_NAMES

PEEK = 8192
COLUMNAR = (".parquet", ".pq")


class ShapeError(ValueError):
    """The file is none of: long (date, symbol, value), series (date, value or one column), wide (date, a column per name)."""


@dataclass
class Panel:
    """``long`` and ``wide`` files give ``symbol, date, close``, ``series`` gives ``series_id, pos, value``."""

    shape: str
    data: DataFrame


def number(c: Column) -> Column:
    """Numbers with thousands commas; spellings of a missing value and anything unreadable are null."""
    t = F.regexp_replace(strip(c.cast("string")), ",", "")
    v = t.try_cast("double")
    return F.when(~F.lower(t).isin([m for m in MISSING if m]) & ~F.isnan(v), v)


def _clean(name: str) -> str:
    return name.strip().lstrip("﻿").strip().lower()


def sniff_delimiter(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        return ","


def classify(header: list[str]) -> str:
    names = [_clean(h) for h in header]
    has = lambda known: any(n in known for n in names)
    if has(DATE_NAMES) and has(SYMBOL_NAMES) and has(CLOSE_NAMES):
        return "long"
    if (has(DATE_NAMES) and has(CLOSE_NAMES) and len(names) == 2) or len(names) == 1:
        return "series"
    if has(DATE_NAMES):
        return "wide"
    raise ShapeError(f"columns {names}: neither long (date, symbol, close), nor series (date, close), nor wide (date and a column per name)")


def _first(columns: list[str], known: list[str]) -> str:
    return next(c for c in columns if _clean(c) in known)


def long_panel(rows: DataFrame, date: str, symbol: str, value: str, order: str | None = None) -> DataFrame:
    """``symbol, date, close``: null values and blank symbols are left out; of rows for one symbol and date the last by ``order`` counts."""
    r = rows.select(clean_symbol(F.col(symbol)).alias("symbol"), strip(F.col(date).cast("string")).alias("date"), number(F.col(value)).alias("close"), (F.col(order) if order else F.lit(0)).alias("_o"))
    return r.where("symbol IS NOT NULL AND close IS NOT NULL").groupBy("symbol", "date").agg(F.max_by("close", F.struct("_o", "close")).alias("close"))


def wide_panel(rows: DataFrame, date: str, names: list[str] | None = None, order: str | None = None) -> DataFrame:
    """The same from one column per name; names without any value don't appear."""
    names = names or [c for c in rows.columns if c not in (date, order) and _clean(c)]
    each = F.explode(F.array(*[F.struct(F.lit(_clean(c)).alias("symbol"), F.col(f"`{c}`").cast("string").alias("value")) for c in names]))
    flat = rows.select(F.col(date).cast("string").alias("date"), (F.col(order) if order else F.lit(0)).alias("_o"), each.alias("x")).select("date", "_o", "x.symbol", "x.value")
    return long_panel(flat, "date", "symbol", "value", "_o")


def load_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> Panel:
    file = Path(path)
    if not file.exists():
        raise ShapeError(f"no file at {path}")
    try:
        with file.open(encoding="utf-8-sig") as f:
            sample = f.read(PEEK)
    except UnicodeDecodeError as e:
        raise ShapeError(f"{path} is no text") from e
    lines = [x for x in sample.splitlines() if x.strip()]
    if not lines:
        raise ShapeError(f"{path} is empty")
    sep = delimiter or sniff_delimiter(sample)
    header = next(csv.reader([lines[0]], delimiter=sep))
    bare = len(header) == 1 and _parses(header[0])
    shape = classify(header)
    if len(lines) == 1 and not bare:
        raise ShapeError(f"{path} has a header and no rows")
    columns = ["value"] if bare else [_clean(h) or f"_c{i}" for i, h in enumerate(header)]
    schema = ", ".join(f"`{c}` string" for c in columns)
    # rows keep the file's order through their position: partition and offset rise with it
    rows = spark.read.schema(schema).csv(path, sep=sep, header=not bare, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, encoding="UTF-8", mode="PERMISSIVE").withColumn("_o", F.monotonically_increasing_id())
    first = F.lit(columns[0])
    if shape == "long":
        return Panel(shape, long_panel(rows, _first(columns, DATE_NAMES), _first(columns, SYMBOL_NAMES), _first(columns, CLOSE_NAMES), "_o"))
    if shape == "wide":
        date = _first(columns, DATE_NAMES)
        return Panel(shape, wide_panel(rows, date, [c for c in columns if c != date and not c.startswith("_c")], "_o"))
    value = columns[0] if len(columns) == 1 else _first(columns, CLOSE_NAMES)
    got = rows.select(number(F.regexp_replace(F.col(value), "^﻿", "")).alias("value"), "_o").where("value IS NOT NULL")
    return Panel("series", file_positions(got).select(first.alias("series_id"), "pos", "value"))


def file_positions(rows: DataFrame) -> DataFrame:
    """Adds ``pos``, the row's place in the file from 0: places inside each split of the scan plus the rows of the splits before.

    ``_o`` is an increasing id whose upper bits are the split; the filter before it leaves gaps, which ranks close.
    """
    split = rows.withColumn("_p", F.shiftright("_o", 33))
    sizes = split.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.select(F.col("_p").alias("_q"), (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))  # a row per split
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_o")) - 1
    return split.withColumn("_i", inside).join(before, F.col("_p") == F.col("_q")).withColumn("pos", F.col("_i") + F.col("_before")).drop("_p", "_q", "_i", "_before")


def _parses(text: str) -> bool:
    try:
        float(text.strip().lstrip("﻿").replace(",", ""))
    except ValueError:
        return text.strip().lower() in MISSING
    return True


def load_columnar(spark: SparkSession, path: str) -> Panel:
    """Parquet with its own types: pruned and pushed down, no text in between."""
    df = spark.read.parquet(path)
    shape = classify(df.columns)
    if shape == "long":
        return Panel(shape, long_panel(df, _first(df.columns, DATE_NAMES), _first(df.columns, SYMBOL_NAMES), _first(df.columns, CLOSE_NAMES)))
    if shape == "wide":
        return Panel(shape, wide_panel(df, _first(df.columns, DATE_NAMES)))
    value = df.columns[0] if len(df.columns) == 1 else _first(df.columns, CLOSE_NAMES)
    by = next((c for c in df.columns if _clean(c) in DATE_NAMES), None)
    rows = df.select(number(F.col(value)).alias("value"), (F.col(by) if by else F.monotonically_increasing_id()).alias("_o")).where("value IS NOT NULL")
    return Panel("series", rows.select(F.lit(_clean(value)).alias("series_id"), (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_o")) - 1).alias("pos"), "value"))


def load_panel(spark: SparkSession, path: str) -> Panel:
    return load_columnar(spark, path) if path.lower().endswith(COLUMNAR) else load_delimited(spark, path)


def load_project(spec: str) -> dict:
    """``data``, ``backtest_fn`` and ``GRID`` of a user's module, those it has."""
    module = importlib.import_module(spec)
    return {k: getattr(module, k) for k in ("data", "backtest_fn", "GRID") if hasattr(module, k)}


def classify_source(token: str) -> str:
    """``file`` for a path that exists or has a known ending, ``module`` for a dotted name that imports, else ``universe``."""
    if Path(token).exists() or token.lower().endswith((*COLUMNAR, ".csv", ".tsv", ".txt")):
        return "file"
    try:
        return "module" if importlib.util.find_spec(token) else "universe"
    except (ImportError, ValueError):
        return "universe"


def coverage(panel: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The panel's rows of wanted symbols, and the wanted symbols it doesn't have."""
    w = wanted.select(clean_symbol(F.col("symbol")).alias("symbol")).where("symbol IS NOT NULL").distinct()
    return panel.join(w, "symbol", "left_semi"), w.join(panel.select("symbol"), "symbol", "left_anti")


def symbol_returns(panel: DataFrame, date: str = "date") -> DataFrame:
    """``series_id, pos, ret`` of every symbol; null where the close before is zero."""
    w = Window.partitionBy("symbol").orderBy(date)
    r = panel.select(F.col("symbol").alias("series_id"), (F.row_number().over(w) - 2).alias("pos"), (div(F.col("close"), F.lag("close").over(w)) - 1).alias("ret"))
    return r.where("pos >= 0")
