"""Text operators against the public tokenizer library, brute force and round trips."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelspark.llm.bpe import Encoder
from panelspark.llm.encode import TOKENIZER, count_tokens, encode_corpus
from panelspark.llm.mix import mix_sources
from panelspark.llm.split import IMBALANCE, PENALTY, PER_PIECE, check_pieces, count_between, cut_positions, split_oversized, split_text

DOCS = "doc_id bigint, text string, source string, ids string, limit int"
SOURCES = "source string, target_share double, max_repeats int, max_tokens int, overlap_tokens int"


@pytest.fixture(scope="module")
def enc():
    with open(TOKENIZER, "rb") as f:
        return Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


ALPHABETS = ["ab", "aeiourst", "the quick brown", "的是不了人", "\n \t\r", "éàüß€𝄞👍🏽", "0123456789", "-=_.#*/'", "'s 'll don't"]


def test_encoder_equals_library(enc, library):
    rnd = random.Random(7)
    for _ in range(800):
        x = "".join(rnd.choice(rnd.choice(ALPHABETS)) for _ in range(rnd.choice([0, 1, 2, 9, 50, 400])))
        assert enc.encode(x) == library(x)
        assert enc.count(x) == len(library(x))


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_library_on_any_text(enc, library, x):
    assert enc.encode(x) == library(x)
    assert b"".join(enc.bytes[i] for i in enc.encode(x)).decode() == x


def test_run_without_breaks_is_linear_and_exact(enc, library):
    x = "ab" * 60_000
    assert enc.encode(x) == library(x)


def test_special_strings_are_text(enc, library):
    assert enc.encode("<|endoftext|>") == library("<|endoftext|>") != [50256]


def test_every_token_encodes_to_itself(enc):
    assert all(enc.stable(i) for i in enc.bytes)


def _docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_corpus_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, "a b", "s", "x", 1), (1, "a b", "s", "x", 1), (2, "", None, None, None), (3, None, "s", None, None), (None, " \n", "s", None, 2), (4, "x" * 70_000, "s", "", 0)]
    got = sorted(((r.doc_id or -1, list(r.ids)) for r in encode_corpus(_docs(spark, rows)).collect()), key=str)
    assert got == sorted(((i or -1, library(t or "")) for i, t, *_ in rows), key=str)
    assert encode_corpus(_docs(spark, [])).count() == 0
    counts = {r.doc_id: r.n_tokens for r in count_tokens(_docs(spark, rows), ["doc_id", "ids"]).collect()}
    assert counts[2] == counts[3] == 0 and counts[1] == 2


def test_mixture_meets_targets(spark, library):
    rnd = random.Random(3)
    words = "price signal return panel drawdown".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))), "big" if i % 3 else "small" if i % 2 else "tiny" if i % 50 == 0 else "mid", None, None) for i in range(3000)]
    rows += [(9001, "no source", None, None, None), (9002, "unlisted", "other", None, None), (9003, None, "big", None, None), (9004, "", "mid", None, None)]
    shares = [("big", 0.3, 2, 1, 0), ("small", 0.4, 5, 1, 0), ("mid", 0.2, 3, 1, 0), ("tiny", 0.09, 2, 1, 0), ("none", 0.01, 9, 1, 0), (None, 0.5, 1, 1, 0)]
    taken, report = mix_sources(_docs(spark, rows), spark.createDataFrame(shares, SOURCES))
    size = {}
    for i, t, s, *_ in rows:
        size.setdefault(s, []).append(len(library(t or "")))
    budget = sum(sum(size.get(s, [])) for s, *_ in shares if s)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big", "small", "mid", "tiny", "none"}
    for s, share, repeats, *_ in shares[:-1]:
        total = sum(size.get(s, []))
        assert got[s].source_tokens == total and got[s].target_tokens == pytest.approx(share * budget)
        assert got[s].short == (total * repeats < share * budget)
        if got[s].short:
            assert got[s].used_tokens == total * repeats
        else:
            assert abs(got[s].used_tokens - share * budget) <= max(size[s])
    kept = taken.collect()
    assert {r.source for r in kept} <= {"big", "small", "mid", "tiny"}
    cap = {s: r for s, _, r, *_ in shares}
    assert all(1 <= r.copies <= cap[r.source] for r in kept)
    assert sum(r.reached_share or 0 for r in got.values()) == pytest.approx(1)


def test_mixture_of_empty_tables(spark):
    taken, report = mix_sources(_docs(spark, []), spark.createDataFrame([("a", 1.0, 2, 1, 0)], SOURCES))
    assert taken.count() == 0 and [(r.source, r.n_docs, r.used_tokens) for r in report.collect()] == [("a", 0, 0)]
    taken, report = mix_sources(_docs(spark, [(1, "x", "a", None, None)]), spark.createDataFrame([], SOURCES))
    assert taken.count() == 0 and report.count() == 0


TEXTS = [
    "One sentence here. Another one follows! " * 60,
    "line one\nline two is longer\n\nnew paragraph\n" * 40,
    "x" * 5_000,
    "市场今天上涨。趋势仍然向上!" * 90,
    "👍🏽𝄞" * 300,
    " ".join(str(i) for i in range(900)),
    "short",
]


@pytest.mark.parametrize("limit,overlap", [(50, 0), (64, 16), (128, 32), (40, 39), (8, 3)])
def test_pieces_rebuild_the_text_within_the_limit(enc, library, limit, overlap):
    for text in TEXTS:
        total, pieces = split_text(enc, text, limit, overlap)
        assert total == len(library(text))
        rebuilt = ""
        for n, a, b, shared, _ in pieces:
            assert a <= len(rebuilt) < b or not rebuilt
            rebuilt += text[len(rebuilt) : b]
            assert n == len(library(text[a:b])) <= limit or b - a == 1
            assert a == 0 or shared >= min(overlap, limit // 2) or limit <= 8
        assert rebuilt == text
        if total <= limit:
            assert len(pieces) == 1


def test_cuts_fall_on_paragraphs_where_there_are_any(enc):
    text = ("A few words about prices and signals in one paragraph, some thirty tokens long or so." + "\n\n") * 30
    _, pieces = split_text(enc, text, 100, 0)
    assert {g for *_, g in pieces[:-1]} == {"paragraph"}


def _best_cost(grade, limit, overlap):
    """The least cost over all places, one by one."""
    n = len(grade) - 1
    whole = [i for i in range(n + 1) if grade[i] >= 0]
    back = [max(w for w in whole if w <= max(i - overlap, 0)) if i else 0 for i in whole]
    count = max(1, -(-(n - overlap) // (limit - overlap)))
    even = (n + (count - 1) * overlap) / count
    cost = [0.0]
    for j in range(1, len(whole)):
        fits = [c + IMBALANCE * ((whole[j] - b) / even - 1) ** 2 for c, b in zip(cost, back, strict=False) if whole[j] - b <= limit]
        cost.append(min(fits) + PER_PIECE + (PENALTY[grade[whole[j]]] if whole[j] < n else 0.0))
    return cost[-1], even


@pytest.mark.parametrize("limit,overlap", [(65, 0), (70, 33), (100, 20), (200, 64), (20, 5)])
def test_cuts_cost_the_least(limit, overlap):
    rng = np.random.default_rng(limit)
    for shares in ([0.01, 0.02, 0.05, 0.3, 0.6, 0.02], [0, 0, 0, 0, 0.1, 0.9], [0.2, 0.2, 0.2, 0.2, 0.1, 0.1], [0, 0.001, 0.002, 0.8, 0.197, 0]):
        for n in (limit + 1, 3 * limit, 1200):
            grade = rng.choice(6, n + 1, p=shares).astype("int8")
            grade[rng.choice(np.arange(2, n, 3), n // 40, replace=False)] = -1
            grade[0] = grade[-1] = 0
            spans = cut_positions(grade, limit, overlap)
            want, even = _best_cost(grade, limit, overlap)
            got = sum(IMBALANCE * ((e - s) / even - 1) ** 2 + PER_PIECE + (PENALTY[grade[e]] if e < n else 0.0) for s, e in spans)
            assert got == pytest.approx(want) and all(e - s <= limit for s, e in spans) and all(grade[e] >= 0 and grade[s] >= 0 for s, e in spans)


@given(st.text(alphabet=st.sampled_from(list("ab  \n\n\t1.'sté的👍\u00a0\u0301")), max_size=60), st.data())
@settings(max_examples=300, deadline=None)
def test_counts_between_two_places(enc, text, data):
    parts, ids = enc.pieces(text)
    ends, upto = np.cumsum([0, *map(len, parts)]), np.cumsum([0, *map(len, ids)])
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    assert count_between(enc, text, ends, upto, a, b) == enc.count(text[a:b])


def test_split_table(spark, library):
    rows = [(1, TEXTS[0], "a", "clash", 3), (2, TEXTS[0], None, None, None), (3, TEXTS[0], "unlisted", None, None), (4, None, "a", None, None), (5, "", "a", None, None), (6, "tiny", "a", None, None), (1, TEXTS[0], "a", "clash", 3)]
    limits = spark.createDataFrame([("a", 0.1, 1, 64, 8), ("a", 0.1, 1, 90, 8), (None, 0.1, 1, 1, 0)], SOURCES)
    got = split_oversized(_docs(spark, rows), limits).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 6}
    assert {r.doc_id for r in got if r.oversized} == {1}
    ones = [r for r in got if r.doc_id == 1]
    assert len(ones) == 2 * ones[0].n_pieces and all(r.n_tokens <= 64 for r in ones)
    assert [r.n_pieces for r in got if r.doc_id in (2, 3, 6)] == [1, 1, 1]
    assert split_oversized(_docs(spark, []), limits).count() == 0
    good = split_oversized(_docs(spark, rows[:-1]), limits)
    assert check_pieces(good, _docs(spark, rows[:-1]), limits).first().asDict() == {"n_texts": 4, "n_over_limit": 0, "n_short_overlap": 0, "n_not_rebuilt": 0, "n_oversized": 1}
    lost = check_pieces(good.where("NOT oversized OR piece_no <> 1"), _docs(spark, rows[:-1]), limits).first()
    assert lost.n_not_rebuilt == 1 and lost.n_short_overlap == 1
