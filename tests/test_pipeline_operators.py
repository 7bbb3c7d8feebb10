"""The data-pipeline operators against brute force and planted cases, with the edge cases their docstrings define."""

import datetime as dt
import json
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from panelspark.operators.column_profile import profile_loads
from panelspark.operators.drift import field_changes, read_studies, schema_changes
from panelspark.operators.grid import choose_embedding, holdout_error, impute, regular_grid, ssa_fill, ssa_settle
from panelspark.operators.parse_rows import parse_lines
from panelspark.operators.rolling import trailing_totals
from panelspark.operators.spikes import NORMAL_MOVES, burst_sizes, fit_tail, flag_readings, pareto_cutoff, pareto_shape, score_series, source_cutoffs, tail_excesses
from panelspark.operators.timestamps import normalise_timestamps

PRICES = "symbol string, date date, close double, loaded_at timestamp, source string, day int, value double, entity string, v double"


def _prices(spark, rows):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, d, c, at, "x", 1, 2.0, "e", 3.0) for s, d, c in rows], PRICES)


def _walk(seed, n, sd=0.01):
    rng = np.random.default_rng(seed)
    return 50 * np.exp(np.cumsum(rng.normal(0, sd, n)))


DAY0 = dt.date(2023, 1, 2)


def _day(i):
    return DAY0 + dt.timedelta(days=int(i))


# --- problem 1 ----------------------------------------------------------------------------------------------------


def test_spikes_stuck_and_impossible(spark):
    a, b, sticky = _walk(1, 300), _walk(2, 300), np.round(_walk(3, 300, 0.002), 1)
    a[100] *= 1.6
    a[150:153] *= 0.5
    a[200:] *= 2  # a level that lasts
    b[50:58] = b[50]
    b[80] = -1.0
    b[90] = 0.0
    b[95] = float("nan")
    rows = [(" aa ", _day(i), float(x)) for i, x in enumerate(a)] + [("BB", _day(i), float(x)) for i, x in enumerate(b)] + [("ST", _day(i), float(x)) for i, x in enumerate(sticky)]
    rows += rows[:40] + [(None, _day(0), 1.0), ("AA", None, 1.0), ("AA", _day(400), None), ("", _day(1), 5.0)]
    got = {(r.source, r.day_iso): r for r in flag_readings(_prices(spark, rows)).collect()}
    flagged = lambda k: {key for key, r in got.items() if r[k]}
    iso = lambda s, *i: {(s, _day(k).isoformat()) for k in i}
    assert flagged("spike") == iso("AA", 100, 150, 151, 152)
    assert flagged("stuck") == iso("BB", *range(51, 58))
    assert flagged("implausible") == iso("BB", 80, 90, 95)
    assert len(got) == 900  # repeated rows and rows without source, day or value add none


def test_spikes_of_short_flat_and_empty_sources(spark):
    rows = [("ONE", _day(0), 5.0), *[("FLAT", _day(i), 7.0) for i in range(20)], ("NAN", _day(0), float("nan"))]
    got = flag_readings(_prices(spark, rows)).collect()
    assert not any(r.spike or r.stuck for r in got) and [r.source for r in got if r.implausible] == ["NAN"]
    assert flag_readings(_prices(spark, [])).count() == 0


def test_scores_equal_brute_force():
    x = _walk(5, 120)
    got = score_series(np.arange(120), x)["score"]
    lx = np.log(x)
    for i in range(120):
        sides = [np.median(w) for w in (lx[max(0, i - 9) : i], lx[i + 1 : i + 10]) if len(w)]
        assert got[i] == pytest.approx(min(abs(lx[i] - m) for m in sides) / np.median(np.abs(np.diff(lx))), rel=0.05)


def test_burst_sizes_equal_brute_force():
    rng = np.random.default_rng(11)
    for n in (3, 4, 7, 60):
        x, score = np.cumsum(rng.normal(0, 1, n)), rng.exponential(2, n)
        want = np.zeros(n)
        for a in range(1, n - 1):
            for b in range(a, min(a + 5, n - 1)):
                enter, leave = x[a] - x[a - 1], x[b] - x[b + 1]
                if enter * leave > 0:
                    for i in range(a, b + 1):
                        want[i] = max(want[i], min(abs(enter), abs(leave), score[i]))
        assert burst_sizes(x, score) == pytest.approx(want)


def test_pareto_cutoff_recovers_an_exponential_tail():
    y = np.sort(np.random.default_rng(0).exponential(1.0, 20_000))
    above = y[y > 2.0] - 2.0
    got = pareto_cutoff(2.0, above.mean(), pareto_shape(above), len(above) / len(y), 1e-4)
    assert got == pytest.approx(-np.log(1e-4), rel=0.12)


def test_faults_leave_the_fit_of_a_tail_alone():
    size = np.random.default_rng(4).exponential(0.7, 600)
    clean = fit_tail(size, 0.6, 0.0)
    for share in (10, 25, 60):  # up to a tenth of the readings
        size[rng_at := np.random.default_rng(share).choice(600, share, replace=False)] = 40.0
        threshold, excesses, in_tail, mean, cutoff = fit_tail(size, 0.6, 0.0)
        assert cutoff == pytest.approx(clean[-1], rel=0.25) and in_tail < excesses and (size[rng_at] > cutoff).all()
    assert tail_excesses(np.zeros(5))[1].size == 0


def test_cutoffs_come_from_the_tails(spark):
    """The same burst is a fault of a source whose moves are even, and none of one that jumps; no constant gives both."""
    rng = np.random.default_rng(8)
    rows, size = [], {}
    for k in range(8):
        jumpy = k % 2 == 1
        move = rng.normal(0, 0.01, 700)
        if jumpy:  # bursts of its own, smaller than what is planted
            at = rng.choice(np.arange(5, 695, 4), 45, replace=False)
            up = rng.exponential(0.022, 45)
            move[at] += up
            move[at + 1] -= up
        x = np.cumsum(move)
        x[350] += 0.085
        rows += [(f"S{k}", _day(i), float(np.exp(v))) for i, v in enumerate(x)]
    fits = {r.source: r for r in source_cutoffs(_prices(spark, rows)).collect()}
    assert max(fits[f"S{k}"].cutoff for k in (0, 2, 4, 6)) < min(fits[f"S{k}"].cutoff for k in (1, 3, 5, 7))
    assert all(r.in_tail >= 20 and r.risk == 1e-8 and r.n == 700 for r in fits.values())
    for r in flag_readings(_prices(spark, rows)).collect():
        assert (r.cutoff, r.spike) == (fits[r.source].cutoff, r.size > r.cutoff)
        if r.day_iso == _day(350).isoformat():
            size[r.source] = r.size
            assert r.spike == (int(r.source[1]) % 2 == 0)
    assert len(size) == 8
    alone = source_cutoffs(_prices(spark, [("ONE", _day(0), 5.0), ("NAN", _day(0), float("nan"))])).collect()
    assert {(r.source, r.n, r.cutoff, r.shape) for r in alone} == {("ONE", 1, None, None), ("NAN", 0, None, None)}
    assert source_cutoffs(_prices(spark, [])).count() == 0 and NORMAL_MOVES[0] < 700 / 5


# --- problem 2 ----------------------------------------------------------------------------------------------------

FEEDS = [(1, "America/New_York", "mdy"), (3, "Europe/London", "dmy"), (4, "Europe/Berlin", "dmy"), (10, "UTC", "ymd"), (14, None, "ymd"), (7, "Asia/Kolkata", "dmy")]


def _ms(*a, micro=0):
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1000) + micro // 1000


TIMES = [
    (1, "2021-03-24 23:11 America/New_York", _ms(2021, 3, 25, 3, 11)),
    (1, "2021-01-04T11:20+11:00[Australia/Sydney]", _ms(2021, 1, 4, 0, 20)),
    (1, "01/09/2021 6:47 PM", _ms(2021, 1, 9, 23, 47)),
    (3, "01/09/2021 6:47 pm", _ms(2021, 9, 1, 17, 47)),
    (1, "12:00 am", None),
    (1, "01/09/2021 12:00 am", _ms(2021, 1, 9, 5)),
    (1, "01/09/2021 13:00 pm", None),
    (4, "5. Januar 2021, 00:54 Uhr", _ms(2021, 1, 4, 23, 54)),
    (4, "15. März 2021, 14:46 Uhr", _ms(2021, 3, 15, 13, 46)),
    (4, "10 de março de 2021 06:30", _ms(2021, 3, 10, 5, 30)),
    (4, "1 août 2021 22:53", _ms(2021, 8, 1, 20, 53)),
    (1, "Jan 8, 2021 1:20:42 AM EST", _ms(2021, 1, 8, 6, 20, 42)),
    (1, "Jul 8, 2021 1:20:42 AM EST", _ms(2021, 7, 8, 6, 20, 42)),
    (7, "2021-01-07 10:12:27 IST", _ms(2021, 1, 7, 4, 42, 27)),
    (1, "2021-01-07 10:12:27 JST", None),
    (14, "2021-01-07 10:12:27", None),
    (14, "2021-01-07 10:12:27 GMT", _ms(2021, 1, 7, 10, 12, 27)),
    (14, "2021-01-07t10:12:27.123999999z", _ms(2021, 1, 7, 10, 12, 27) + 123),
    (10, "2021-01-07 10:12:27,072", _ms(2021, 1, 7, 10, 12, 27) + 72),
    (7, "2021-01-13 09:09:12 UTC+05:30", _ms(2021, 1, 13, 3, 39, 12)),
    (7, "2021-01-13T09:09:12+05", _ms(2021, 1, 13, 4, 9, 12)),
    (3, "Thu, 11 Nov 2021 00:10:11 GMT", _ms(2021, 11, 11, 0, 10, 11)),
    (3, "Mon, 04 Jan 2021 13:04:55 -0300", _ms(2021, 1, 4, 16, 4, 55)),
    (10, "20210107155651", _ms(2021, 1, 7, 15, 56, 51)),
    (1, "20210107", _ms(2021, 1, 7, 5)),
    (10, "20210105T053428Z", _ms(2021, 1, 5, 5, 34, 28)),
    (10, "1609745034", 1609745034000),
    (10, "1609745034.999", 1609745034999),
    (10, "1609745034672", 1609745034672),
    (10, "1609745034672999", 1609745034672),
    (10, "44201.5", _ms(2021, 1, 5, 12)),
    (4, "07.01.21 15:55", _ms(2021, 1, 7, 14, 55)),
    (10, "21-01-07", _ms(2021, 1, 7)),
    (1, "2021-01-10 24:00:00", _ms(2021, 1, 11, 5)),
    (1, "2021-01-10 24:00:01", None),
    (1, "2021-01-10 27:36:00", None),
    (1, "2021-02-30", None),
    (10, "31/06/2021 09:30", None),
    (1, "2021-13-14 14:09", None),
    (1, "0000-00-00", None),
    (1, "T07:10:48Z", None),
    (1, "2021-01-10T10:00:00+25:00", None),
    (1, "2021-03-14 02:30:00", _ms(2021, 3, 14, 7, 30)),  # skipped: the offset before
    (1, "2021-11-07 01:30:00", _ms(2021, 11, 7, 5, 30)),  # repeated: the offset before
    (1, " 2021-01-17T21:00:54 ", _ms(2021, 1, 18, 2, 0, 54)),
    (99, "2021-01-17 21:00:54", None),
    (99, "2021-01-17 21:00:54Z", _ms(2021, 1, 17, 21, 0, 54)),
    (1, "2021-01-17 21:00 Mars/Base", None),
    (1, "n/a", None),
    (1, "x" * 50_000, None),
    (1, "", None),
    (1, None, None),
]


def _times(spark, rows, **kw):
    feeds = spark.createDataFrame(FEEDS, "feed_id int, zone_id string, day_order string")
    df = spark.createDataFrame([(i, f, t, "k", 1) for i, (f, t) in enumerate(rows)], "row_id bigint, feed_id int, date string, kind string, _t int")
    return {r.row_id: r for r in normalise_timestamps(df, feeds, **kw).collect()}


def test_timestamps(spark):
    got = _times(spark, [(f, t) for f, t, _ in TIMES])
    assert len(got) == len(TIMES)
    for i, (_, text, want) in enumerate(TIMES):
        assert got[i].epoch_ms == want, (text, got[i])
        assert (got[i].failure is None) == (want is not None), text
    zoneless = TIMES.index((14, "2021-01-07 10:12:27", None))
    assert got[len(TIMES) - 1].failure == "missing" and got[zoneless].failure == "zone"


@pytest.mark.parametrize("policy,skipped,repeated", [("after", _ms(2021, 3, 14, 6, 30), _ms(2021, 11, 7, 6, 30)), ("null", None, None)])
def test_clock_change_policies(spark, policy, skipped, repeated):
    got = _times(spark, [(1, "2021-03-14 02:30:00"), (1, "2021-11-07 01:30:00"), (1, "2021-11-07 03:30:00")], policy=policy)
    assert [got[i].epoch_ms for i in range(3)] == [skipped, repeated, _ms(2021, 11, 7, 8, 30)]


def test_no_timestamps(spark):
    assert _times(spark, []) == {}


# --- problem 3 ----------------------------------------------------------------------------------------------------


def _split(line, d):
    """Cells of a line, or None where its quoting is broken: a state machine."""
    out, cur, i, n = [], "", 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i += 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                cur += line[i:j]
                i = j + 1
                if i < n and line[i] == '"':
                    cur += '"'
                    i += 1
                else:
                    break
            if i < n and line[i] != d:
                return None
        else:
            j = i
            while j < n and line[j] != d:
                if line[j] == '"':
                    return None
                j += 1
            cur, i = line[i:j], j
        out.append(cur)
        cur = ""
        if i >= n:
            return out
        i += 1


def _reason(line, d, roles):
    line = line[:-1] if line.endswith("\r") else line
    cells = _split(line, d)
    if cells is None:
        return "quoting"
    if len(cells) != len(roles):
        return "column_count"
    got = {r: c.strip() for r, c in zip(roles, cells, strict=True)}
    try:
        if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", got["date"]):
            return "bad_date"
        dt.date.fromisoformat(got["date"])
    except ValueError:
        return "bad_date"
    if not re.fullmatch(r"[A-Za-z0-9.\-]{1,12}", got["symbol"]):
        return "bad_symbol"
    c = got["close"]
    if c.lower() in ("", "na", "n/a", "nan", "null", "none", "-"):
        return None
    if re.fullmatch(r"[+-]?([0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?|[0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", c) and np.isfinite(float(c.replace(",", ""))):
        return None
    return "bad_close"


LINES = "line_id bigint, file_id bigint, line_no int, line string, reason string, role string"


def test_lines_equal_a_state_machine(spark):
    rnd = random.Random(4)
    heads = [("date,symbol,close", ["date", "symbol", "close"]), ("note;Date;price;Symbol", ["", "date", "close", "symbol"]), ("as_of|ticker|volume|Close\r", ["date", "symbol", "", "close"]), ('﻿"day"\tinstrument\tadj_close', ["date", "symbol", "close"])]
    pool = {"date": ["2024-02-29", "2023-02-29", " 2024-01-05 ", '"2024-01-06"', "2024-1-5", "", "0000-01-01"], "symbol": ["ABC", ' "AB"', '"A.B-1"', "A B", "", "TOOLONGSYMBOL", "é"], "close": ["1.5", '"1,234.50"', "-", "NaN", "1e999", "+.5", "abc", "1e", '" 2,000 "', '"12" x'], "": ["", "7", '"a ""q"" b"', '"two\nlines"', 'x"y', '"open']}
    rows, want, k = [], {}, 0
    for f in range(12):
        head, roles = heads[f % 4]
        d = {0: ",", 1: ";", 2: "|", 3: "\t"}[f % 4]
        rows.append((k, f, 1, head, "c", "c"))
        k += 1
        for n in range(80):
            cells = [rnd.choice(pool[r]) for r in roles]
            if rnd.random() < 0.1:
                cells = cells[1:] if rnd.random() < 0.5 else [*cells, "extra"]
            line = d.join(cells) + ("\r" if rnd.random() < 0.3 else "")
            if rnd.random() < 0.05:
                line = rnd.choice(["", "  ", "\r"])
            rows.append((k, f, n + 2, line, "c", "c"))
            if line.strip():
                want[k] = _reason(line, d, roles)
            k += 1
    rnd.shuffle(rows)
    loaded, failed = parse_lines(spark.createDataFrame(rows, LINES))
    assert {r.line_id: r.reason for r in failed.collect()} == {i: r for i, r in want.items() if r}
    assert {r.line_id for r in loaded.collect()} == {i for i, r in want.items() if r is None}


def test_lines_edges(spark):
    long = "2024-01-01,AB,1," + "x" * 200_000
    rows = [(0, 1, 1, "date,symbol,close,note", "", ""), (1, 1, 2, long, "", ""), (1, 1, 2, long, "", ""), (2, 1, 3, '2024-01-01,AB,1,"' + '""' * 50_000, "", ""), (3, 1, 4, None, "", ""), (4, 2, 2, "2024-01-01,AB,1", "", ""), (5, 3, 1, "a,b", "", ""), (6, 3, 2, "1,2", "", ""), (None, 1, 5, "2024-13-01,AB,1,", "", "")]
    loaded, failed = parse_lines(spark.createDataFrame(rows, LINES))
    assert {(r.line_id, r.reason) for r in failed.collect()} == {(2, "quoting"), (4, "column_count"), (6, "column_count"), (None, "bad_date")}
    assert [(r.line_id, r.date, r.symbol, r.close) for r in loaded.collect()] == [(1, dt.date(2024, 1, 1), "AB", 1.0)] * 2
    loaded, failed = parse_lines(spark.createDataFrame([], LINES))
    assert loaded.count() == failed.count() == 0


# --- problem 4 ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("windows", [(7, 30), (1, 2, 16), (31, 5)])
def test_trailing_totals_equal_brute_force(spark, windows):
    rnd = random.Random(9)
    rows = [(s, _day(d), round(rnd.uniform(1, 9), 2)) for s in ("A", "B") for d in sorted(rnd.sample(range(120), 40))]
    rows += rows[:20] + [(" a ", rows[0][1], 99.5), ("A", _day(3), float("nan")), ("A", _day(500), None), (None, _day(1), 1.0), ("C", _day(7), 2.0)]
    days = defaultdict(set)
    for s, d, v in rows:
        if s and v is not None and v == v:
            days[s.strip().upper()].add((d, v))
    got = {(r.entity, r.day): r for r in trailing_totals(_prices(spark, rows), windows).collect()}
    n = 0
    for s, values in days.items():
        first, last = min(d for d, _ in values), max(d for d, _ in values)
        for k in range((last - first).days + 1):
            day = first + dt.timedelta(days=k)
            n += 1
            for w in windows:
                inside = [v for d, v in values if day - dt.timedelta(days=w) < d <= day]
                r = got[s, day]
                assert r[f"n_{w}"] == len(inside)
                assert r[f"total_{w}"] == (pytest.approx(sum(inside)) if inside else None)
                assert r[f"mean_{w}"] == (pytest.approx(sum(inside) / len(inside)) if inside else None)
    assert n == len(got)


def test_trailing_totals_of_nothing(spark):
    assert trailing_totals(_prices(spark, [])).count() == 0
    with pytest.raises(ValueError):
        trailing_totals(_prices(spark, []), (0,))


# --- problem 5 ----------------------------------------------------------------------------------------------------

FILES = "file_id bigint, stream_id string, file_no int, received_at timestamp, body string, name string, jtype string"


def _files(spark, streams, extra=()):
    rows, k = [], 0
    for s, bodies in streams.items():
        for no, b in bodies:
            rows.append((k, s, no, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), b if b is None or isinstance(b, str) else json.dumps(b), "c", "c"))
            k += 1
    return spark.createDataFrame(rows + list(extra), FILES)


def test_schema_changes(spark):
    base = {"label": "x", "n": 1, "performance": {"sharpe": 1.0, "vol": 2}, "tag": True}
    bodies = []
    for no in range(1, 13):
        b = json.loads(json.dumps(base))
        if no >= 4:
            b["label_text"] = b.pop("label")  # renamed
        if no >= 6:
            b["performance"]["ann_vol"] = b["performance"].pop("vol")
        if no >= 8:
            b["n"] = str(b["n"])  # type changed
        if no >= 9:
            b["extra"] = [1]  # added
        if no >= 10:
            del b["tag"]  # removed
        if no % 3:
            b["sometimes"] = None if no % 2 else 5
        if no == 5:
            b["label_text"] = None
            b["n"] = 1.5
        bodies.append((no, b))
    shuffled = [bodies[i] for i in (3, 0, 1, 2, 4, 5, 6, 8, 7, 9, 10, 11)]
    got = schema_changes(_files(spark, {"s": [*shuffled, bodies[2], bodies[11]], "one": [(1, {"a": 1})], "bad": [(1, "{"), (2, None), (3, "[1]")], None: [(1, {"a": 1}), (2, {"b": 1})]})).collect()
    assert {(r.stream_id, r.file_no, r.field_name, r.change_kind, r.new_name) for r in got} == {
        ("s", 4, "label", "renamed", "label_text"),
        ("s", 6, "performance.vol", "renamed", "performance.ann_vol"),
        ("s", 8, "n", "type_changed", ""),
        ("s", 9, "extra", "added", ""),
        ("s", 10, "tag", "removed", ""),
    }
    assert schema_changes(_files(spark, {})).count() == 0


def test_several_renames_in_one_file_pair_by_closeness(spark):
    before, after = {"created_at": "a", "verdict": "b", "gone": "c"}, {"createdAt": "a", "verdict_text": "b"}
    got = {(r.field_name, r.change_kind, r.new_name) for r in schema_changes(_files(spark, {"s": [(1, before), (2, before), (3, after), (4, after)]})).collect()}
    assert got == {("created_at", "renamed", "createdAt"), ("verdict", "renamed", "verdict_text"), ("gone", "removed", "")}


def test_studies_are_rescued_and_replayed(spark):
    old = {"label": "x", "n_trials": 3, "schema_version": "v1.0", "performance": {"sharpe": 1.0, "odd": 7}, "unknown": {"a": 1}}
    new = {"title": "y", "n_trials": {"n": 3}, "schema_version": {"major": 1, "minor": 2}, "performance": {"sharpe": "2.5"}}
    files = _files(spark, {"s": [(1, old), (2, old), (3, new), (4, new)], "bad": [(1, "{nope")]})
    plain = {(r.stream_id, r.file_no): r for r in read_studies(files).collect()}
    assert plain["s", 3].label is None and "title" in plain["s", 3]._rescued
    got = {(r.stream_id, r.file_no): r for r in read_studies(files, schema_changes(files).where("change_kind = 'renamed'")).collect()}
    assert (got["s", 1].label, got["s", 3].label) == ("x", "y")
    assert got["s", 1].n_trials == 3 and got["s", 3].n_trials is None
    assert set(json.loads(got["s", 3]._rescued)) == {"n_trials"}
    assert set(json.loads(got["s", 1]._rescued)) == {"unknown", "performance.odd"}
    assert (got["s", 1].schema_version, got["s", 3].schema_version) == ("1.0", "1.2")
    assert got["s", 3].performance_sharpe == 2.5
    assert json.loads(got["bad", 1]._rescued) == {"_body": "{nope"}
    assert read_studies(_files(spark, {})).count() == 0


def test_chains_of_renames_and_passing_fields(spark):
    names = ["deflated_sharpe", "dsr", "dsr_value", "dsr_final"]
    bodies = []
    for no in range(1, 9):
        b = {"label": "x", names[(no - 1) // 2]: no / 10}
        if 3 <= no <= 5:
            b["passing"] = {"a": no}
        if no == 4:
            b["once"] = "o"
        bodies.append((no, b))
    later = [(1, {"old_label": "a", "n_trials": 1}), (2, {"old_label": "b", "n_trials": 2.5}), (3, {"label": "c", "n_trials": "3"})]
    files = _files(spark, {"s": bodies, "t": later})
    changes = field_changes(files)
    got = {(r.stream_id, r.file_no, r.field_name, r.change_kind, r.new_name, r.origin, r.lasting) for r in changes.collect()}
    assert got == {
        ("s", 3, "deflated_sharpe", "renamed", "dsr", "deflated_sharpe", False),
        ("s", 5, "dsr", "renamed", "dsr_value", "deflated_sharpe", False),
        ("s", 7, "dsr_value", "renamed", "dsr_final", "deflated_sharpe", False),
        ("s", 3, "deflated_sharpe", "removed", "", "deflated_sharpe", True),
        ("s", 7, "dsr_final", "added", "", "deflated_sharpe", True),
        ("s", 3, "passing", "added", "", "passing", False),
        ("s", 6, "passing", "removed", "", "passing", False),
        ("t", 3, "old_label", "renamed", "label", "old_label", True),
        ("t", 3, "n_trials", "type_changed", "", "n_trials", True),
    }
    assert {tuple(r) for r in schema_changes(files).collect()} == {g[:5] for g in got if g[6]}
    rows = {(r.stream_id, r.file_no): r for r in read_studies(files, changes.where("change_kind = 'renamed'")).collect()}
    assert [rows["s", no].deflated_sharpe for no in range(1, 9)] == [no / 10 for no in range(1, 9)]
    assert [json.loads(rows["s", no]._rescued or "{}") for no in (1, 4, 8)] == [{}, {"passing": '{"a":4}', "once": '"o"'}, {}]
    assert [rows["t", no].label for no in (1, 2, 3)] == ["a", "b", "c"] and [rows["t", no].n_trials for no in (1, 2, 3)] == [1, None, 3]
    assert json.loads(rows["t", 2]._rescued) == {"n_trials": "2.5"}


def test_changes_across_blocks_of_numbers(spark):
    from panelspark.operators import drift

    bodies = [(no, {"label" if no < 40 else "title": "x", **({"extra": 1} if no >= 25 else {}), **({"gone": "g"} if no < 30 else {})}) for no in range(1, 61)]
    files = _files(spark, {"s": bodies, "n": [(-5, {"a": 1}), (3, {"b": 1})]})
    whole = {tuple(r) for r in field_changes(files).collect()}
    block, drift.BLOCK = drift.BLOCK, 10
    try:
        assert {tuple(r) for r in field_changes(files).collect()} == whole
    finally:
        drift.BLOCK = block
    assert {g[1:5] for g in whole if g[0] == "s"} == {(40, "label", "renamed", "title"), (25, "extra", "added", ""), (30, "gone", "removed", "")}


# --- problem 6 ----------------------------------------------------------------------------------------------------

LOADS = "load_id bigint, vendor_id string, date string, symbol string, close double, c string, l int, n int"


def _loads(seed=0, loads=12, rows=220):
    rng = np.random.default_rng(seed)
    names = [f"SYM{chr(65 + i)}{chr(65 + j)}X" for i in range(5) for j in range(8)]
    level = {s: float(np.exp(rng.normal(3.5, 1))) for s in names}
    out = []
    for k in range(loads):
        for i in range(rows):
            s = names[i % 40]
            out.append([k, "v", (dt.date(2025, 1, 6) + dt.timedelta(days=7 * k + int(rng.integers(5)))).isoformat(), s if rng.random() > 0.01 else s.lower(), round(level[s] * float(np.exp(rng.normal(0, 0.02))), 4), "x", 1, 2])
    return out, rng


def test_departing_columns(spark):
    rows, rng = _loads()
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    some = lambda k, share=0.3: [r for r in by[k] if rng.random() < share]
    for r in some(1):
        r[4] = None
    for r in some(2):
        r[4] = round(r[4] * 100, 4)
    for r in some(3):
        r[3] = r[3][:3] + "." + r[3][3:]
    for r in some(4):
        r[2] = "1900-01-01"
    for r in some(5):
        r[2] = "/".join(reversed(r[2].split("-")))
    for r in by[6]:
        r[4] = round(r[4] * 2.5, 4)
    for r in by[7]:
        r[3] = "SYMAAX"
    for r in some(8):
        r[3] = None
    for r in some(9):
        r[4] = float("nan")
    got = {(r.load_id, r.column_name): list(r.departs) for r in profile_loads(spark.createDataFrame([tuple(r) for r in rows], LOADS), {"date": "date", "symbol": "text", "close": "number"}).collect()}
    assert len(got) == 36
    assert {k for k, v in got.items() if v} == {(1, "close"), (2, "close"), (3, "symbol"), (4, "date"), (5, "date"), (6, "close"), (7, "symbol"), (8, "symbol"), (9, "close")}
    assert "nulls" in got[1, "close"] and "distribution" in got[6, "close"] and "distinct" in got[7, "symbol"]


def test_a_shifted_mix_of_known_symbols_departs(spark):
    rows, rng = _loads()
    for r in rows:
        if r[0] == 3 and rng.random() < 0.3:
            r[3] = f"SYMA{chr(65 + int(rng.integers(6)))}X"  # other loads hold these too; none gains 15 points
    got = {(r.load_id, r.column_name): r for r in profile_loads(spark.createDataFrame([tuple(r) for r in rows], LOADS), {"symbol": "text"}).collect()}
    assert {k: list(r.departs) for k, r in got.items() if r.departs} == {(3, "symbol"): ["distribution"]}
    assert all(r.gap is not None and r.psi is not None for r in got.values()) and got[3, "symbol"].psi == max(r.psi for r in got.values())


def test_a_fifth_of_the_values_and_small_shifts_of_days_depart(spark):
    rows, rng = _loads()
    for r in rows:
        if r[0] == 2:
            r[2] = (dt.date.fromisoformat(r[2]) + dt.timedelta(days=2)).isoformat()  # a whole load two days late
        if r[0] == 5 and rng.random() < 0.2:
            r[2] = (dt.date(2025, 1, 6) + dt.timedelta(days=7 * 5 + (5 if rng.random() < 0.5 else -1))).isoformat()  # a day beside the usual ones
        if r[0] == 8:
            r[2] = (dt.date.fromisoformat(r[2]) - dt.timedelta(days=14)).isoformat()
        if r[0] == 10 and rng.random() < 0.2:
            r[4] = 250.0 + round(30 * float(rng.random()), 4)  # inside the usual range
    got = {(r.load_id, r.column_name): list(r.departs) for r in profile_loads(spark.createDataFrame([tuple(r) for r in rows], LOADS), {"date": "date", "close": "number"}).collect()}
    assert {k for k, v in got.items() if v} == {(2, "date"), (5, "date"), (8, "date"), (10, "close")}, got
    assert "distribution" in got[10, "close"] and "range" in got[8, "date"]


def test_profile_counts_and_edges(spark):
    rows = [(1, "v", "2025-01-01", "A", 1.0, "", 1, 1)] * 3 + [(1, "v", None, "b", None, "", 1, 1), (None, None, None, None, None, None, None, None)]
    got = {(r.load_id, r.column_name): r for r in profile_loads(spark.createDataFrame(rows, LOADS), {"date": "date", "symbol": "text", "close": "number"}).collect()}
    r = got[1, "symbol"]
    assert (r.n, r.n_null, r.n_distinct, r.least, r.greatest, r.mode_share, list(r.departs)) == (4, 0, 2, "A", "b", 0.75, [])
    assert (got[1, "close"].n_null, got[1, "close"].least) == (1, "1.0")
    assert got[None, "date"].n_null == 1 and got[None, "date"].mode_share is None
    assert profile_loads(spark.createDataFrame([], LOADS), {"close": "number"}).count() == 0


# --- problem 7 ----------------------------------------------------------------------------------------------------

MARKS = "mark_id bigint, symbol string, feed_id int, date timestamp, close double, grid int, slot bigint"


def test_grid_equals_brute_force(spark):
    rnd = random.Random(2)
    grids = {1: 60, 2: 900}
    rows, base = [], dt.datetime(2025, 9, 1, 22)
    for s, f in (("A", 1), ("B", 2)):
        for _ in range(300):
            rows.append((0, s, f, base + dt.timedelta(seconds=rnd.uniform(0, 5 * 3600)), rnd.choice([None, float("nan"), 1.0 + rnd.random()]), 1, 1))
    rows += rows[:50] + [(0, None, 1, base, 1.0, 1, 1), (0, "C", 9, base, 1.0, 1, 1), (0, "D", None, base, 1.0, 1, 1), (0, "E", 1, None, 1.0, 1, 1), (0, "F", 2, base, 3.0, 1, 1)]
    want = defaultdict(set)
    for _, s, f, t, c, *_ in rows:
        if s and t and f in grids and c is not None and c == c:
            e = int(t.replace(tzinfo=dt.UTC).timestamp())
            want[s, grids[f], e // 86400].add(e - e % grids[f])
    filled = {(s, x) for (s, g, _), slots in want.items() for x in range(min(slots), max(slots) + 1, g) if x not in slots}
    feeds = spark.createDataFrame([(1, 60), (2, 900), (5, None)], "feed_id int, grid_s int")
    got = regular_grid(spark.createDataFrame(rows, MARKS), feeds).collect()
    assert {(r.source, r.slot_s) for r in got if r.filled} == filled
    assert {(r.source, r.slot_s) for r in got if not r.filled} == {(s, x) for (s, _, _), v in want.items() for x in v}
    assert all(r.value is not None and (r.n == 0) == r.filled for r in got)
    assert regular_grid(spark.createDataFrame([], MARKS), feeds).count() == 0


def test_imputation_recovers_a_periodic_series():
    t = np.arange(400)
    x = 10 + np.sin(2 * np.pi * t / 24)
    known = np.random.default_rng(1).random(400) > 0.2
    known[[0, -1]] = True
    got = ssa_fill(np.where(known, x, 0.0), known, window=24, rounds=60)
    assert np.abs(got - x)[~known].max() < 0.05 and (got[known] == pytest.approx(x[known]))
    line = np.array([1.0, 0, 3.0])
    assert ssa_fill(line, np.array([True, False, True])).tolist() == [1.0, 2.0, 3.0]


def test_embedding_is_chosen_by_hidden_readings(spark):
    rng = np.random.default_rng(6)
    t = np.arange(240)
    known = rng.random(240) > 0.2
    known[[0, -1]] = True
    cycle, noise, walk = np.sin(2 * np.pi * t / 24), rng.normal(0, 1, 240), np.cumsum(np.convolve(rng.normal(0, 1, 241), [0.5, 0.5], "valid"))
    assert max(w for w, _, _ in choose_embedding(cycle, known)) == 12 and max((w for w, _, _ in choose_embedding(walk, known)), default=1) <= 3
    assert max((w for w, _, _ in choose_embedding(noise, known)), default=1) <= 3
    assert impute(np.array([1.0, 0, 3.0]), np.array([True, False, True]))[0].tolist() == [1.0, 2.0, 3.0]
    assert impute(np.full(9, 2.0) * (np.arange(9) != 4), np.arange(9) != 4)[0].tolist() == [2.0] * 9
    errors = {"fill": [], "line": []}
    for k in range(60):
        x = np.cumsum(np.convolve(np.random.default_rng(k).normal(0, 1, 241), [0.5, 0.5], "valid"))
        hidden = np.arange(5, 235, 10)
        seen = np.ones(240, bool)
        seen[hidden] = False
        errors["fill"].append(impute(np.where(seen, x, 0.0), seen)[0][hidden] - x[hidden])
        errors["line"].append((x[hidden - 1] + x[hidden + 1]) / 2 - x[hidden])
    assert np.square(errors["fill"]).mean() < np.square(errors["line"]).mean()
    base = dt.datetime(2025, 9, 1)
    rows = [(0, "A", 1, base + dt.timedelta(minutes=int(i)), float(v), 1, 1) for i, v in zip(t, cycle, strict=True)]
    feeds = spark.createDataFrame([(1, 60)], "feed_id int, grid_s int")
    every, r = holdout_error(spark.createDataFrame(rows, MARKS), feeds).orderBy("grid_s").collect()
    assert every[1:] == r[1:] and (r.grid_s, r.n_hidden, r.n_unsettled) == (60, 24, 0) and r.rmse_fill < 0.2 * r.rmse_line
    assert holdout_error(spark.createDataFrame([], MARKS), feeds).count() == 0


def test_imputation_settles_with_the_parameters_in_use(spark):
    t = np.arange(96)
    x = 10 + np.sin(2 * np.pi * t / 24)
    known = np.ones(96, bool)
    known[20:44] = False  # a whole period
    start = np.where(known, x, 0.0)
    got, settled = ssa_settle(start, known)
    assert settled and got[known] == pytest.approx(x[known]) and (ssa_fill(start, known) == got).all()
    assert np.abs(got - x).max() < 0.05 * x[known].std()
    assert not ssa_settle(start, known, rounds=12)[1]
    base = dt.datetime(2025, 9, 1)
    rows = [(0, "A", 1, base + dt.timedelta(minutes=int(i)), float(v), 1, 1) for i, v, k in zip(t, x, known, strict=True) if k]
    r = regular_grid(spark.createDataFrame(rows, MARKS), spark.createDataFrame([(1, 60)], "feed_id int, grid_s int")).orderBy("slot_s").collect()
    assert all(q.settled for q in r) and [q.value for q in r] == pytest.approx(list(got), abs=1e-9)
