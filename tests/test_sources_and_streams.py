import datetime as dt
import json

import numpy as np
import pytest

from panelspark import operations
from panelspark.figures import MOST, TooLarge, chart, guard, rows_of, tidy
from panelspark.operators import sweep
from panelspark.sources import artifacts as art
from panelspark.sources import panels as src
from panelspark.streaming import readings as st


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def _rows(panel):
    return {(r.symbol, r.date): r.close for r in panel.data.collect()}


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_long_files(spark, tmp_path, sep):
    lines = ["﻿Date,Ticker,Adj_Close,note", "2024-01-02, aa ,1.5,x", '2024-01-01,AA,"1,000",y', "2024-01-02,AA,2.5,z", "2024-01-03,BB,n/a,", "", "2024-01-03,,5,"]
    text = "\n".join(x.replace('"1,000"', "QUOTED").replace(",", sep).replace("QUOTED", '"1,000"') for x in lines)
    p = src.load_panel(spark, _write(tmp_path, "long.csv", text))
    assert p.shape == "long" and _rows(p) == {("AA", "2024-01-01"): 1000.0, ("AA", "2024-01-02"): 2.5}


def test_wide_files_keep_gaps(spark, tmp_path):
    p = src.load_panel(spark, _write(tmp_path, "wide.csv", "date,aaa,bbb,empty\n2024-01-01,1,,\n2024-01-02,,3,-\n"))
    assert p.shape == "wide" and _rows(p) == {("AAA", "2024-01-01"): 1.0, ("BBB", "2024-01-02"): 3.0}


def test_series_files(spark, tmp_path):
    p = src.load_panel(spark, _write(tmp_path, "s.csv", "date,close\n1,5\n2,none\n3,7\n"))
    assert p.shape == "series" and [(r.pos, r.value) for r in p.data.orderBy("pos").collect()] == [(0, 5.0), (1, 7.0)]
    p = src.load_panel(spark, _write(tmp_path, "b.csv", "1.5\n2.5\n"))
    assert [r.value for r in p.data.orderBy("pos").collect()] == [1.5, 2.5]
    p = src.load_panel(spark, _write(tmp_path, "h.csv", "pnl\n1.5\n"))
    assert [r.value for r in p.data.collect()] == [1.5]


@pytest.mark.parametrize("text", ["", "date,symbol,close\n", "a,b\n1,2\n"])
def test_files_of_no_shape_are_refused(spark, tmp_path, text):
    with pytest.raises(src.ShapeError):
        src.load_panel(spark, _write(tmp_path, "x.csv", text))
    with pytest.raises(src.ShapeError):
        src.load_panel(spark, str(tmp_path / "missing.csv"))


def test_columnar_files_are_pruned(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame([("2024-01-01", "a", 1.0, "big"), ("2024-01-01", "b", float("nan"), "big")], "date string, symbol string, close double, other string").write.parquet(path)
    p = src.load_panel(spark, path)
    assert _rows(p) == {("A", "2024-01-01"): 1.0}
    assert "other" not in p.data._jdf.queryExecution().executedPlan().toString()


def test_coverage_and_returns(spark):
    p = spark.createDataFrame([("A", "1", 1.0), ("A", "2", 2.0), ("A", "3", 0.0), ("A", "4", 1.0), ("B", "1", 1.0)], "symbol string, date string, close double")
    kept, missing = src.coverage(p, spark.createDataFrame([(" a",), ("Z",), (None,), ("z",)], "symbol string"))
    assert {r.symbol for r in kept.collect()} == {"A"} and [r.symbol for r in missing.collect()] == ["Z"]
    assert [r.ret for r in src.symbol_returns(p).where("series_id = 'A'").orderBy("pos").collect()] == [1.0, -1.0, None]
    assert (src.classify_source("x.csv"), src.classify_source("json"), src.classify_source("no such thing")) == ("file", "module", "universe")


def test_studies_events_and_signals(spark, tmp_path):
    path = str(tmp_path / "study.json")
    art.save_study(art.Study(label="x", n_trials=3), path)
    raw = json.loads(open(path).read())
    assert art.load_study(path).n_trials == 3
    open(path, "w").write(json.dumps(raw | {"later": 1, "schema_version": "1.9"}))
    assert art.load_study(path).label == "x"
    open(path, "w").write(json.dumps(raw | {"schema_version": "2.0"}))
    with pytest.raises(ValueError):
        art.load_study(path)
    odd = {"why": 7, "usage": {"prompt_tokens": "12", "total_tokens": None, "other_tokens": 9}, "answer_caveats": ["c"] * 20, "choice": {"a": 1}, "error": None, "model": "m"}
    assert art.allowed_event(odd) == {"why": 7, "usage": {"prompt_tokens": 12}, "answer_caveats": ["c"] * 16, "model": "m"}
    event = art.allowed_event({"kind": "pick", "why": "w" * 999, "secret": 1, "choice": [1, 2], "usage": {"prompt_tokens": 3, "x": 1}})
    assert event == {"kind": "pick", "why": "w" * 240, "usage": {"prompt_tokens": 3}}
    assert art.append_events([event], str(tmp_path / "e.jsonl")) == 1
    ranked = spark.createDataFrame([("A", 1, 0.5), ("B", 2, 0.4)], "ticker string, rank int, score double")
    where = str(tmp_path / "signals")
    assert [art.file_signals(r, where, "mom", "2024-01-01") for r in (ranked, ranked, ranked.limit(1))] == [1, 1, 2]


def test_figures_are_bounded(spark):
    assert rows_of(spark.range(3)) == [{"id": 0}, {"id": 1}, {"id": 2}]
    with pytest.raises(TooLarge):
        rows_of(spark.range(MOST + 1))
    with pytest.raises(TooLarge):
        guard({"a": {str(i): 1 for i in range(MOST + 1)}})
    assert tidy({"x": float("nan"), "y": [0.12345678]}) == {"x": None, "y": [0.123457]}
    with pytest.raises(ValueError):
        chart("pie", "x", "y")


def test_operations_by_name(spark):
    s = spark.createDataFrame([("a", i, 0.01 * (i % 3 - 1)) for i in range(40)], "series_id string, pos int, ret double")
    assert operations.run("compute.drawdown_anatomy", s).count() == 1
    assert operations.run("mine", 2, handlers={"mine": lambda x: x + 1}) == 3
    with pytest.raises(KeyError):
        operations.run("nothing")
    assert len(operations.OPERATIONS) == 56


def test_operations_do_what_their_names_say(spark):
    run = operations.run
    c = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.01]])
    long = spark.createDataFrame([("abc"[i], "abc"[j], float(c[i, j])) for i in range(3) for j in range(i, 3)], "a string, b string, v double")
    even = {r.symbol: r for r in run("compute.risk_parity", long).collect()}
    assert [r.risk_share for r in even.values()] == pytest.approx([1 / 3] * 3)
    assert sum(r.weight for r in run("compute.hrp", long).collect()) == pytest.approx(1)
    assert [r.weight for r in run("compute.hrp", long).collect()] != pytest.approx([r.weight for r in even.values()])
    rng = np.random.default_rng(2)
    panel = spark.createDataFrame([(s, t, float(x)) for s in "abcd" for t, x in enumerate(rng.normal(0, 0.01, 40))], "symbol string, t int, ret double")
    for cov in ("sample", "ewma", "lw", "denoise"):
        assert [r.risk_share for r in run("compute.risk_parity", panel, cov=cov).collect()] == pytest.approx([0.25] * 4)
    assert run("compute.denoise_cov", long, 100).where("a = b").count() == run("compute.detone_cov", long).where("a = b").count() == 3
    scores = spark.createDataFrame([(s, "d", float(i)) for i, s in enumerate("abcde")], "symbol string, ts string, value double")
    for method, column in (("zscore", "zscore"), ("rank", "rank"), ("winsorize", "winsorized"), ("neutralize", "residual")):
        assert column in run("compute.panel_transform", scores, method=method).columns
    with pytest.raises(ValueError):
        run("compute.panel_transform", scores, method="nothing")
    assert run("record.note", text="a", n=1) == {"text": "a", "n": 1}
    for name in ("screen", "monitor", "sizing_decision", "signal_report", "health", "stress", "overlap", "process_report"):
        assert set(run(f"emit.{name}", x=1)) == {"x", "engine_version", "schema_version"}


def test_study_of_a_sweep(spark):
    rng = np.random.default_rng(5)
    grid = sweep.expand_grid(spark, {"fast": [1, 2], "slow": [5]})
    returns = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(rng.normal(0.002, 0.01, 200))], "trial_id int, pos int, ret double")
    study = operations.run("emit.study", grid, returns, label="x")
    assert (study["n_trials"], study["n_failed_trials"], study["n_trials_source"], study["best_params"], study["label"]) == (2, 1, "derived_from_grid", {"fast": 1, "slow": 5}, "x")
    assert 0 <= study["deflated_sharpe"] <= 1 and study["performance"]["n_obs"] == 200 and len(study["data_hash"]) == 16
    with pytest.raises(ValueError):
        operations.run("emit.study", grid, returns.limit(0))


def _stream(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def _drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return stream.sparkSession.table(name).collect()
    finally:
        q.stop()


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def test_streamed_windows_and_deliveries(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    parts = [[(1, t(5), 1, "a", 1.0), (1, t(5), 1, "a", 1.0), (2, t(50), 1, "a", 2.0)], [(3, t(200), 2, "a", 5.0)], [(4, t(10), 1, "a", 99.0), (5, t(400), 1, "b", 1.0)]]
    got = _drain(st.windowed_totals(st.first_deliveries(_stream(spark, tmp_path, parts, EVENTS), ["event_id"]), late=None), "w")
    assert {(r.window_start.hour, r.key): (r.n, r.total) for r in got} == {(0, "a"): (2, 3.0), (3, "a"): (1, 5.0)}
    batch = st.sessions(spark.createDataFrame([x for p in parts for x in p], EVENTS))
    assert sum(r.n for r in batch.collect()) == 6


def test_streamed_gaps_equal_the_batch(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 10) + dt.timedelta(seconds=s)
    schema = "source string, ts timestamp"
    got = _drain(st.period_gaps(_stream(spark, tmp_path, [[("A", t(0)), ("A", t(70))], [("A", t(250)), ("B", t(0)), (None, t(9))], [("B", t(190))]], schema)), "g")
    base = int(dt.datetime(2024, 1, 1, 10, tzinfo=dt.UTC).timestamp())
    assert {(r.source, r.slot_s - base) for r in got} == {("A", 120), ("A", 180), ("B", 60), ("B", 120)}


def test_numbers_come_from_whole_close_cells(spark):
    from pyspark.sql import functions as F

    from panelspark.operators.parse_rows import close_cells

    lines = ["date,symbol,volume,close,note", "2022-02-11,QOXOWA.B,754961,2002.18,", '2022-02-12,A,1,"1,234.5",late', "2022-02-13,A,1,-1.5e3,\r", "2022-02-14,A,1,n/a,x 7", "2022-02-15,A.3", '2022-02-16,"A,1,2,']
    df = spark.createDataFrame([(i, 1, i + 1, x) for i, x in enumerate(lines)], "line_id bigint, file_id bigint, line_no int, line string")
    got = {r.line_id: r.v for r in close_cells(df).select("line_id", src.number(F.col("cell")).alias("v")).collect()}
    assert got == {1: 2002.18, 2: 1234.5, 3: -1500.0, 4: None, 5: None, 6: None}
