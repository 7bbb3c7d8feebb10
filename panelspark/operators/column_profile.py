"""Problem 6: column profile of each load, and the columns that depart from the same source's other loads.

Columns are unpivoted and reduced to exact counts per load, column and value (map-side combined, spread over all
values, so no load or vendor is one task's work). From the counts come nulls, distinct and most frequent values,
ranges, and the frequencies by which loads are compared: of nulls, of patterns, of words of a text, of bins of a
number or day. A load's nulls, patterns and words are compared with those of the source's other loads by chi-square;
its p-value is corrected for all comparisons of the source, and a departure has to move a share of the values that
counts. Bins have an order: they are compared by the stability index and by the gap between cumulated frequencies,
with medians over the loads, so that one bad load can't move what is expected, beyond what the source's loads scatter.

Frequencies are kept sparse: besides those a load has, only cells that many loads share are set against it (their
number times that of the loads never exceeds the rows). Nothing is materialised on the way; all parts of the
comparison read one exchange of the reduced counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import strip
from panelspark.plans.lineage import shared

SHARE = 0.12  # share of values that has to depart; "about a sixth" less the noise of a load of some hundred rows
ALPHA = 0.01  # probability, over all comparisons of a source, that sampling alone makes a column depart
GAP, PSI = 1.2, 12.0  # gap between cumulated frequencies and stability index beyond the vendor's medians, times sqrt(rows) and rows: what sampling alone hardly reaches
GAP_SCATTER, PSI_SCATTER = 0.3, 6.0  # scatter of the two among a vendor's loads, in the same units, up to which those limits hold; they grow with it
LEAST_GAP = SHARE / 2  # gap that counts, however many rows
AROUND = 5  # loads before and after that tell a load's expected day
JITTER = 6  # times the usual distance from its expected day that a load may lie apart
LOG_BINS = 8  # bins per doubling of a number
# limits of the words that describe a departure; they decide nothing
MODE_SHARE, DISTINCT, BINS_BEYOND = 0.15, 0.4, {"number": 2, "date": 0}


def _number_pattern(x: Column) -> Column:
    cents = x * 100
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), "not finite").when(F.abs(cents - F.rint(cents)) < 1e-6, "up to 2 decimals").otherwise("more decimals")


def _pattern(v: Column) -> Column:
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    plain = F.translate(v, upper + lower + digits, "A" * 26 + "a" * 26 + "9" * 10)
    other = F.regexp_replace(F.regexp_replace(plain, r"\p{Lu}", "A"), r"\p{Ll}", "a")
    shape = F.when(F.length(v) == F.octet_length(v), plain).otherwise(other)  # letters beyond ASCII are rare and cost more
    short = F.regexp_replace(shape, r"(.)\1+", "$1+")
    long = F.when(F.length(short) <= 64, short).otherwise(F.concat(F.substring(short, 1, 40), F.lit(" #"), F.hex(F.xxhash64(short))))
    return F.when(F.length(v) <= 24, shape).otherwise(long)


def _number_bin(x: Column) -> Column:
    """Signed logarithmic bin; 0 for zero, null for NaN and infinities (a pattern of their own)."""
    size = F.greatest(F.floor(F.log2(F.abs(x)) * LOG_BINS) + 1000 * LOG_BINS, F.lit(1)).cast("int")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).when(x == 0, 0).when(x > 0, size).when(x < 0, -size)


def _by_kind(columns: dict[str, str], f) -> Column:
    out = F.lit(None)
    for name, kind in columns.items():
        out = F.when(F.col("c") == name, f(kind)).otherwise(out)
    return out


def _value_counts(df: DataFrame, columns: dict[str, str], load: str, group: str) -> DataFrame:
    """``g, l, c, v, x, k``: how often each value comes in a load's column; numbers stay numbers (x), all else is text (v)."""

    def cell(name: str, kind: str) -> Column:
        if kind != "number":
            return F.struct(F.lit(name).alias("c"), F.col(name).cast("string").alias("v"), F.lit(None).cast("double").alias("x"))
        x = F.col(name).try_cast("double")
        text = F.when(x.isNull(), F.col(name)) if df.schema[name].dataType.simpleString() == "string" else F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("c"), text.alias("v"), x.alias("x"))

    each = F.explode(F.array(*[cell(c, kind) for c, kind in columns.items()]))
    key = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("\u0000"))
    long = df.select(key(group).alias("g"), key(load).alias("l"), each.alias("e")).select("g", "l", "e.c", "e.v", "e.x")
    return long.groupBy("g", "l", "c", "v", "x").agg(F.count("*").alias("k"))


def _totals(rows: DataFrame, some: Column, k: Column, distinct: Column, mode: Column, least: list[Column], greatest: list[Column], *more: Column) -> DataFrame:
    """One row per load and column with its exact figures."""
    none = F.lit(0).cast("bigint")
    one = rows.groupBy("g", "l", "c").agg(
        F.sum(k).alias("n"), F.coalesce(F.sum(F.when(~some, k)), none).alias("n_null"), F.coalesce(F.sum(F.when(some, distinct)), none).alias("n_distinct"),
        F.coalesce(F.min(least[0]).cast("string"), F.min(least[1])).alias("least"), F.coalesce(F.max(greatest[0]).cast("string"), F.max(greatest[1])).alias("greatest"),
        F.max(F.when(some, mode)).alias("mode_n"), *more,
    )
    return one.withColumn("m", F.col("n") - F.col("n_null")).withColumn("mode_share", F.try_divide("mode_n", "m"))


def count_loads(df: DataFrame, columns: dict[str, str], load: str = "load_id", group: str = "vendor_id") -> DataFrame:
    """``group_id, load_id, column_name, n, n_null, n_distinct, least, greatest, mode_share``: the exact part of :func:`profile_loads` alone."""
    counts = _value_counts(df, columns, load, group)
    x, v, k = F.col("x"), F.col("v"), F.col("k")
    finite = F.when(~F.isnan(x), x)
    r = _totals(counts, v.isNotNull() | x.isNotNull(), k, F.lit(1), k, [finite, v], [finite, v])
    return r.select(*_ids(df, load), "n", "n_null", "n_distinct", "least", "greatest", "mode_share")


def _ids(df: DataFrame, load: str) -> list[Column]:
    back = lambda c: F.when(F.col(c) != "\u0000", F.col(c))
    return [back("g").alias("group_id"), back("l").cast(df.schema[load].dataType).alias("load_id"), F.col("c").alias("column_name")]


def _cells(counts: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Counts reduced to ``g, l, c, pattern, bin, day, word, v`` with ``k, nd, mode`` and extremes, in one exchange that all readers share."""
    x, v = F.col("x"), F.col("v")
    finite = F.when(~F.isnan(x), x)
    day = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_date(F.substring(v, 1, 10).try_cast("date")))
    counts = counts.select(
        "g", "l", "c", "k", "v", finite.alias("x"), F.when(x.isNotNull(), _number_pattern(x)).otherwise(_pattern(v)).alias("pattern"), _number_bin(x).alias("bin"),
        _by_kind(columns, lambda kind: day if kind == "date" else F.lit(None).cast("int")).alias("day"), _by_kind(columns, lambda kind: F.upper(strip(v)) if kind == "text" else F.lit(None).cast("string")).alias("word"),
    )
    # numbers shrink to their bins; a text is a cell of its own, so that no text has to be compared on the way
    cells = counts.groupBy("g", "l", "c", "pattern", "bin", "day", "word", "v").agg(F.sum("k").alias("k"), F.count("*").alias("nd"), F.max("k").alias("mode"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    return shared(cells, "g", "c")


def profile_loads(df: DataFrame, columns: dict[str, str], load: str = "load_id", group: str = "vendor_id") -> DataFrame:
    """One row per load and column with its profile and, in ``departs``, the reasons it departs from the group's other loads.

    ``columns`` gives each column's kind: ``text``, ``number`` or ``date`` (ISO text or dates). Result: ``group_id,
    load_id, column_name, n, n_null, n_distinct, least, greatest, mode_share, null_shift, pattern_shift, unseen_share,
    outside_share, distinct_shift, gap, psi, p_value, departs`` (an array, empty where nothing departs).

    * a column departs by ``nulls``, ``pattern`` or ``distribution``; what else is unusual of one that does is named too:
      ``unseen`` words, ``range``, ``distinct`` values, ``mode``; ``p_value`` is the least of the three comparisons, at most
      what sampling gives by chance over all comparisons of the group (an upper bound of the normal tail);
    * ``unseen_share`` is that of words which few other loads have, ``outside_share`` that of bins beyond the usual range; each is
      null for columns of the other kind;
    * a text's ``gap`` is the share of words in excess of the other loads' shares, its ``psi`` that of the words; words that
      come less than once a load count together, and where all do, only nulls and patterns can depart;
    * NaN is a value of its own pattern, not null; text in a number's column that is no number is a value by its own pattern; blank texts are values; symbols differ by spelling only in pattern;
    * a load is one of its group; rows with a null load or group form a load or group of their own;
    * a group with a single load has nothing to compare with, so nothing departs; repeated rows count as often as they come;
    * an empty table gives no rows; a column that is null throughout has null ``least``, ``greatest`` and ``mode_share``;
    * columns not named are ignored, whatever their names.
    """
    cells = _cells(_value_counts(df, columns, load, group), columns)
    key = ["g", "c", "l"]
    some = F.col("pattern").isNotNull()
    summary = _totals(cells, some, F.col("k"), F.col("nd"), F.col("mode"), [F.col("x0"), F.col("v")], [F.col("x1"), F.col("v")], F.percentile("day", F.lit(0.5), F.col("k")).cast("int").alias("mid_day"))
    # a load's expected middle day: that of the loads around it, carried on at the vendor's pace
    every = Window.partitionBy("g", "c")
    mid = lambda c: F.percentile_approx(c, 0.5).over(every)
    step = every.orderBy(F.col("l").try_cast("bigint"), "l")
    summary = summary.withColumn("pace", F.col("mid_day") - F.lag("mid_day").over(step)).withColumn("pace", mid("pace"))
    near = F.array_compact(F.array(*[f("mid_day", k).over(step) + sign * k * F.col("pace") for f, sign in ((F.lag, 1), (F.lead, -1)) for k in range(1, AROUND + 1)]))
    summary = summary.withColumn("near", F.array_sort(near)).withColumn("astray", F.coalesce(F.col("mid_day") - F.get("near", F.floor(F.size("near") / 2).cast("int")), F.lit(0))).withColumn("jitter", mid(F.abs("astray")))
    apart = F.signum("astray") * F.greatest(F.abs("astray") - JITTER * F.col("jitter"), F.lit(0))
    summary = summary.withColumn("origin", (F.col("mid_day") - apart).cast("int")).drop("near")
    size = lambda kind: F.col("n") if kind == "null" else F.col("m")  # noqa: E731  values that a load has for a comparison
    summary = summary.select("*", *[f.alias(f"{a}_{kind}") for kind in ("null", "value") for a, f in (("loads", F.count_if(size(kind) > 0).over(every)), ("rows", F.sum(size(kind)).over(every)))])
    summary = shared(summary, "g", "c")

    # frequencies of a load; a date's bin is its distance from the load's expected day
    sizes = ["n", "m", "loads_null", "rows_null", "loads_value", "rows_value"]
    days = cells.join(summary.select(*key, "origin", *sizes), key)
    spot = F.coalesce("bin", F.col("day") - F.col("origin"))
    # a facet is a number or a text
    facet = lambda kind, f: F.when(f.isNotNull(), F.struct(F.lit(kind).alias("kind"), (f if kind == "bin" else F.lit(None)).cast("int").alias("b"), (F.lit(None) if kind == "bin" else f).cast("string").alias("t")))
    null = F.when(some, F.lit("some")).otherwise("null")
    facets = F.array_compact(F.array(facet("null", null), facet("pattern", F.col("pattern")), facet("bin", spot), facet("word", F.col("word"))))
    shares = days.select(*key, "k", *sizes, F.explode(facets).alias("f")).groupBy(*key, *sizes, "f.kind", "f.b", "f.t").agg(F.sum("k").alias("k"))
    pick = lambda c: F.when(F.col("kind") == "null", F.col(f"{c}_null")).otherwise(F.col(f"{c}_value"))
    shares = shares.select(*key, "kind", "b", "t", "k", F.when(F.col("kind") == "null", F.col("n")).otherwise(F.col("m")).alias("tot"), pick("loads").alias("loads"), pick("rows").alias("rows"))
    cell = Window.partitionBy("g", "c", "kind", "b", "t")
    shares = shares.withColumn("s", F.col("k") / F.col("tot"))
    shares = shares.select("*", F.row_number().over(cell.orderBy("s")).alias("rank"), F.sum("k").over(cell).alias("total"), F.count("*").over(cell).alias("held"))
    # the median of a facet's shares, zero in loads without it
    absent = F.col("loads") - F.col("held")
    at = F.floor((F.col("loads") - 1) / 2)
    shares = shares.withColumn("e", F.coalesce(F.max(F.when(F.col("rank") == at - absent + 1, F.col("s"))).over(cell), F.lit(0.0)))
    shares = shares.withColumn("rare", F.col("held") <= F.greatest(F.lit(1), F.floor(F.col("loads") / 4))).withColumn("common", F.when(F.col("kind") == "bin", F.col("e") > 0).otherwise(F.col("total") >= F.col("loads")))
    # cells that many loads share are set against every load
    shares = shared(shares, "g", "c")
    usual_cells = shares.where("common AND rank = 1").select("g", "c", "kind", "b", "t", "total", "e", "rare", "common")
    held = summary.select("g", "c", "l", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), size(kind).alias("tot"), F.col("rows_null" if kind == "null" else "rows_value").alias("rows")) for kind in ("null", "pattern", "bin", "word")])).alias("h"))
    held = held.select("g", "c", "l", "h.*").where("tot > 0")
    zeros = usual_cells.join(held, ["g", "c", "kind"]).withColumns({"k": F.lit(0).cast("bigint"), "s": F.lit(0.0)})
    whole = [*key, "kind", "b", "t", "k", "s", "tot", "total", "rows", "e", "rare", "common"]
    grid = shares.select(whole).unionByName(zeros.select(whole))
    grid = grid.groupBy(*key, "kind", "b", "t").agg(*[F.max(c).alias(c) for c in ("k", "s", "tot", "total", "rows", "e", "rare", "common")])
    grid = grid.withColumn("x", F.try_divide((F.col("total") - F.col("k")) * F.col("tot"), F.col("rows") - F.col("tot")))
    grid = shared(grid, "g", "c")
    k, x = F.col("k"), F.col("x")
    stability = lambda k, x, m: (k - x) / (m + 1) * F.ln((k + 0.5) / (x + 0.5))
    common = lambda c: F.sum(F.when(F.col("common"), c))
    per = grid.where("kind <> 'bin'").groupBy(*key, "kind").agg(
        F.first("tot").alias("tot"), F.first("rows").alias("rows"),
        F.sum(F.greatest(F.col("s") - F.col("e"), F.lit(0.0))).alias("shift"),
        F.coalesce(F.sum(F.when(F.col("rare"), F.col("s"))), F.lit(0.0)).alias("unseen"),
        common((k - x) * (k - x) / F.greatest(x, F.lit(0.5))).alias("chi"), F.count_if("common").alias("cells"), common(stability(k, x, F.col("tot"))).alias("psi"),
        common(F.greatest(k - x, F.lit(0.0)) / F.col("tot")).alias("gap"), F.coalesce(common(F.col("total")), F.lit(0)).alias("in_common"), F.coalesce(common(k), F.lit(0)).alias("k_common"),
    )
    # all other facets are one cell together
    k = F.col("tot") - F.col("k_common")
    x = F.coalesce((F.col("rows") - F.col("in_common") - k) * F.try_divide("tot", F.col("rows") - F.col("tot")), F.lit(0.0))
    chi = F.col("chi") + (k - x) * (k - x) / F.greatest(x, F.lit(1.0))
    tail = 2 / (9 * F.col("cells"))
    tested = F.col("cells") > 0
    per = per.select(
        *key, "kind", "shift", "unseen", F.when(tested, F.col("gap") + F.greatest(k - x, F.lit(0.0)) / F.col("tot")).alias("gap"), F.when(tested, F.col("psi") + stability(k, x, F.col("tot"))).alias("psi"),
        F.when(tested, (F.cbrt(chi / F.col("cells")) - (1 - tail)) / F.sqrt(tail)).alias("z"), F.when(tested, (chi - F.col("cells")) / F.col("tot")).alias("effect"),
    )
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    per = per.groupBy(*key).agg(
        of("pattern", "shift").alias("pattern_shift"), of("word", "unseen").alias("unseen_share"), of("word", "gap").alias("word_gap"), of("word", "psi").alias("word_psi"), of("word", "effect").alias("word_effect"),
        *[of(kind, "z").alias(f"{kind}_z") for kind in ("null", "pattern", "word")],
    )
    # bins in order: cumulated frequencies, shares beyond the usual range, stability index over ten groups
    bins = grid.where("kind = 'bin'").select(*key, F.col("tot").alias("m"), "b", "s", "e")
    load_bins = Window.partitionBy(*key)
    bins = bins.withColumn("e", F.try_divide("e", F.sum("e").over(load_bins)))
    ordered = load_bins.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.select("*", F.sum("s").over(ordered).alias("cs"), F.sum("e").over(ordered).alias("ce"), F.min(F.when(F.col("s") > 0, F.col("b"))).over(load_bins).alias("lo"), F.max(F.when(F.col("s") > 0, F.col("b"))).over(load_bins).alias("hi"), F.row_number().over(load_bins.orderBy("b")).alias("one"))
    usual = lambda c: F.percentile_approx(F.when(F.col("one") == 1, F.col(c)), 0.5).over(every)
    bins = bins.withColumn("low", usual("lo")).withColumn("high", usual("hi"))
    # days that no load is expected to have are a group of their own; numbers have too many bins for that
    group_of = F.when((F.col("e") == 0) & _by_kind(columns, lambda kind: F.lit(kind == "date")), 10).otherwise(F.least(F.floor((F.col("ce") - F.col("e") / 2) * 10), F.lit(9)))
    still = _by_kind(columns, lambda kind: F.lit(BINS_BEYOND.get(kind, 0)))
    beyond = (F.col("b") < F.col("low") - still) | (F.col("b") > F.col("high") + still)
    parts = bins.groupBy(*key, "m", group_of.alias("part")).agg(F.sum("s").alias("s"), F.sum("e").alias("e"), F.max(F.abs(F.col("cs") - F.col("ce"))).alias("gap"), F.sum(F.when(beyond, F.col("s"))).alias("outside"))
    a, e = (F.col("s") * F.col("m") + 0.5) / (F.col("m") + 5), (F.col("e") * F.col("m") + 0.5) / (F.col("m") + 5)
    x = F.col("e") * F.col("m")
    per_bin = parts.groupBy(*key).agg(
        F.sum((a - e) * F.ln(a / e)).alias("psi"), F.max("gap").alias("gap"), F.coalesce(F.sum("outside"), F.lit(0.0)).alias("outside_share"), F.sum(F.pow(F.col("s") * F.col("m") - x, F.lit(2.0)) / F.greatest(x, F.lit(1.0))).alias("chi"), F.count("*").alias("cells")
    )
    tail = 2 / (9 * F.col("cells"))
    per_bin = per_bin.select(*key, "psi", "gap", "outside_share", ((F.cbrt(F.col("chi") / F.col("cells")) - (1 - tail)) / F.sqrt(tail)).alias("bin_z"))
    # against the medians of the group's loads
    both = summary.join(per, key, "left").join(per_bin, key, "left").withColumns({"gap": F.coalesce("gap", "word_gap"), "psi": F.coalesce("psi", "word_psi")})
    per_row = F.try_divide("n_distinct", "m")
    log_of = lambda c: F.when(c > 0, F.ln(c))
    distinct = [log_of(c) - log_of(mid(c)) for c in (F.col("n_distinct").cast("double"), per_row)]
    smaller = F.when(F.signum(distinct[0]) == F.signum(distinct[1]), F.when(F.abs(distinct[0]) < F.abs(distinct[1]), distinct[0]).otherwise(distinct[1])).otherwise(0.0)
    both = both.select("*", F.try_divide("n_null", "n").alias("null_share"), F.count("*").over(every).alias("n_loads"))
    both = both.select(
        *both.columns,
        (F.col("null_share") - mid("null_share")).alias("null_shift"),
        smaller.alias("distinct_shift"),
        (F.col("unseen_share") - mid("unseen_share")).alias("unseen_shift"),
        (F.col("outside_share") - mid("outside_share")).alias("outside_shift"),
        (F.col("mode_share") - mid("mode_share")).alias("mode_shift"),
        mid("mode_share").alias("mode_mid"),
        *[(F.col(f"{kind}_z") - mid(f"{kind}_z")).alias(f"{kind}_dz") for kind in ("null", "pattern", "word", "bin")],
        ((F.col("gap") - mid("gap")) * F.sqrt("m")).alias("gap_shift"),
        ((F.col("psi") - mid("psi")) * F.col("m")).alias("psi_shift"),
        (F.abs("astray") > F.greatest(F.abs("pace") / 2, JITTER * F.col("jitter"))).alias("misdated"),
    )
    # chance of so great a deviate, as the source's own loads scatter, over all its comparisons (Mills' bound of the tail)
    tests = F.col("n_loads") * len(columns) * 3
    wide = lambda c, usual: F.greatest(F.lit(1.0), mid(F.abs(c)) / usual)
    deviate = lambda kind: F.col(f"{kind}_dz") / F.greatest(F.lit(1.0), 1.4826 * mid(F.abs(F.col(f"{kind}_dz"))))
    chance = lambda z: F.when(z > 1, F.least(F.lit(1.0), tests * F.exp(-z * z / 2) / (z * 2.5066282746310002))).when(z.isNotNull(), 1.0)
    both = both.withColumns({f"{kind}_d": deviate(kind) for kind in ("null", "pattern", "word", "bin")})
    both = both.withColumns({f"{kind}_p": chance(F.col(f"{kind}_d")) for kind in ("null", "pattern", "word", "bin")})
    both = both.withColumn("uneven", (F.col("gap_shift") > F.greatest(GAP * wide("gap_shift", GAP_SCATTER), LEAST_GAP * F.sqrt("m"))) & (F.col("psi_shift") > PSI * wide("psi_shift", PSI_SCATTER)))
    sd = F.sqrt(F.col("mode_mid") * (1 - F.col("mode_mid")) / F.col("m"))
    moved = {
        "nulls": (F.col("null_p") < ALPHA) & (F.col("null_shift") > SHARE),
        "pattern": (F.col("pattern_p") < ALPHA) & (F.col("pattern_shift") > SHARE),
        "distribution": _by_kind(columns, lambda kind: (F.col("word_p") < ALPHA) & (F.col("word_effect") > 4 * SHARE**2) if kind == "text" else F.col("uneven")),
    }
    described = {
        "unseen": F.col("unseen_shift") > SHARE,
        "range": (F.col("outside_shift") > SHARE) | F.col("misdated"),
        "distinct": F.abs("distinct_shift") > DISTINCT,
        "mode": F.col("mode_shift") > MODE_SHARE + 3 * sd,
    }
    named = lambda reasons: F.array_compact(F.array(*[F.when(r, F.lit(name)) for name, r in reasons.items()]))
    both = both.withColumn("moved", F.when(F.col("n_loads") > 1, named(moved)).otherwise(F.array().cast("array<string>"))).withColumn("described", named(described))
    departs = F.when(F.size("moved") > 0, F.concat("moved", "described")).otherwise(F.col("moved"))
    p = F.least("null_p", "pattern_p", F.coalesce("word_p", "bin_p"))
    return both.select(
        *_ids(df, load), "n", "n_null", "n_distinct", "least", "greatest",
        *[F.col(c).cast("double").alias(c) for c in ("mode_share", "null_shift", "pattern_shift", "unseen_share", "outside_share", "distinct_shift", "gap", "psi")], p.alias("p_value"), departs.alias("departs"),
    )
