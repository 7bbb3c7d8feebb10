"""Problem 10: oversized texts cut at natural boundaries, under a size limit and with a stated overlap.

The limit and overlap come from the source's row. Inside a worker a text is encoded once; the places where it may
be cut are graded (paragraph, line, sentence, blank, word, inside a word) and a dynamic program over all of them
chooses the cuts that minimise the grades' penalties and the imbalance of sizes, such that every piece, its overlap
with the one before included, stays under the limit. The program is run on those places alone that can be part of a
best solution: a coarse program over bins of places bounds from below what any solution through a place costs, and
the places left out are proven to cost more than the solution found. A piece's tokens are counted from those of the
text; only where its ends fall is it encoded again. One pass without a shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.bpe import Encoder
from panelspark.llm.encode import FLUSH, TOKENIZER, load, texts_of

GRADES = ("paragraph", "line", "sentence", "blank", "word", "inside")
PENALTY = np.array([0.0, 1.0, 2.0, 6.0, 12.0, 40.0])
PER_PIECE = 3.0  # keeps pieces few
IMBALANCE = 8.0  # weight of the squared relative distance from the even size
BIN = 32  # positions that the bound takes together; any width gives the same cuts


def _graded(data: np.ndarray, offset: np.ndarray, piece_start: np.ndarray) -> np.ndarray:
    """Grade of a cut before each token; -1 where it would split a character."""
    n = len(data)
    at = np.minimum(offset, n - 1)
    prev = lambda k: np.where(offset >= k, data[np.maximum(offset - k, 0)], 0)
    nxt, p1, p2, p3 = data[at], prev(1), prev(2), prev(3)
    blank = lambda b: (b == 32) | ((b >= 9) & (b <= 13))
    grade = np.full(len(offset), 5, "int8")
    grade[piece_start] = 4
    grade[blank(nxt) | blank(p1)] = 3
    stop = np.isin(p1, np.frombuffer(b".!?", "uint8")) & blank(nxt)
    wide = ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x82)) | ((p3 == 0xEF) & (p2 == 0xBC) & np.isin(p1, [0x81, 0x9F]))
    grade[stop | wide] = 2
    line = (p1 == 10) | (p1 == 13)
    line &= ~((p1 == 13) & (nxt == 10))
    grade[line] = 1
    grade[line & ((p2 == 10) | ((p2 == 13) & (p3 == 10)) | ((p1 == 13) & (p2 == 13)))] = 0
    grade[(nxt & 0xC0) == 0x80] = -1
    return grade


def _bounds(grade: np.ndarray, limit: int, overlap: int, even: float) -> tuple[np.ndarray, float]:
    """For each position no more than what the best solution with a cut there costs, and the least of all.

    Positions are taken together in bins: a bin has the least toll of its positions, and between two bins any size that
    some of their positions allow. Costs to reach a bin and from it to the end are least sums over those."""
    n = len(grade) - 1
    toll = np.where(grade >= 0, PENALTY[np.maximum(grade, 0)], np.inf)
    bins = n // BIN + 1
    least = np.full(bins * BIN, np.inf)
    least[1:n] = toll[1:n]
    least = least.reshape(bins, BIN).min(axis=1)
    off = lambda lo, hi: np.where(lo <= limit, IMBALANCE * np.square(np.clip(even, lo, np.minimum(hi, limit)) / even - 1) + PER_PIECE, np.inf)
    reach = (limit - overlap + BIN) // BIN + 1
    apart = BIN * np.arange(1, reach + 1)  # distance of bins
    between = off(apart - BIN + 1 + overlap, apart + BIN - 1 + overlap + 3)[::-1]
    first = BIN * np.arange(bins)
    ahead = off(first, first + BIN - 1)  # from the text's start
    left = n - first
    home = off(np.maximum(left - BIN + 1 + overlap, 0), left + overlap + 3)  # to its end
    there, back = ahead.copy(), home.copy()
    for j in range(1, bins):
        k = max(0, j - reach)
        there[j] = min(there[j], (there[k:j] + least[k:j] + between[reach - (j - k) :]).min())
    forth = between[::-1]
    for i in range(bins - 2, -1, -1):
        k = min(bins, i + 1 + reach)
        back[i] = min(back[i], (back[i + 1 : k] + least[i + 1 : k] + forth[: k - i - 1]).min())
    at = np.arange(n + 1) // BIN
    through = there[at] + back[at] + toll
    return through, float(min(through[1:n].min(initial=np.inf), off(np.array(n), np.array(n))))


def _program(place: np.ndarray, start: np.ndarray, toll: np.ndarray, limit: int, even: float, force: bool) -> tuple[float, list[int]]:
    """Least cost of cutting at some of the places, the first and last one included, and the indices of the pieces' ends.

    With ``force`` a step to the next place is taken even if it doesn't fit: a character of many tokens stays whole."""
    m = len(place)
    scale, slope = IMBALANCE / even**2, 2 * IMBALANCE / even
    s = start.astype("float64")
    fixed = scale * s * s + slope * s  # of a piece's squared size, what its start alone contributes
    base = np.full(m, np.inf)
    base[0] = fixed[0]
    prev = np.full(m, -1)
    first = np.searchsorted(start, place - limit).tolist()  # the earliest cut from which a piece to each place fits
    last = np.inf
    for j in range(1, m):
        i = min(first[j], j - 1) if force else first[j]
        if i >= j:
            continue
        x = float(place[j])
        c = base[i:j] - (2 * scale * x) * s[i:j]
        k = int(c.argmin())
        cost = c[k] + scale * x * x - slope * x + IMBALANCE + toll[j] + PER_PIECE
        base[j], prev[j] = cost + fixed[j], i + k
        last = cost
    if not np.isfinite(base[-1]):
        return np.inf, []
    ends, j = [], m - 1
    while j > 0:
        ends.append(j)
        j = int(prev[j])
    return float(last), ends[::-1]


def cut_positions(grade: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece in tokens. Pieces but the first start ``overlap`` tokens before the end of the one before,
    or a little earlier where that would split a character."""
    n = len(grade) - 1
    overlap = min(max(overlap, 0), limit // 2)
    whole = np.flatnonzero(grade >= 0)
    back_to = whole[np.searchsorted(whole, np.maximum(np.arange(n + 1) - overlap, 0), side="right") - 1]  # start for a cut at each position
    back_to[0] = 0
    count = max(1, -(-(n - overlap) // max(1, limit - overlap)))
    even = (n + (count - 1) * overlap) / count
    toll = PENALTY[np.maximum(grade, 0)]
    toll[n] = 0.0
    ends: list[int] = []
    place = whole
    if limit > 2 * BIN:  # below, bins are wider than pieces and bound nothing
        through, least = _bounds(grade, limit, overlap, even)
        through[[0, n]] = -np.inf
        most = least + 1.0 + 0.25 * count
        while np.isfinite(most):
            place = np.flatnonzero(through <= most + 1e-6)
            cost, ends = _program(place, back_to[place], toll[place], limit, even, False)
            if cost <= most:  # whatever was left out costs more
                break
            most = cost if np.isfinite(cost) else (most - least) * 4 + least if len(place) < len(whole) else np.inf
    if not ends:
        place = whole
        ends = _program(place, back_to[place], toll[place], limit, even, True)[1]
    starts = [0, *(int(back_to[place[j]]) for j in ends[:-1])]
    return [(a, int(place[e])) for a, e in zip(starts, ends, strict=True)]


def count_between(enc: Encoder, text: str, ends: np.ndarray, upto: np.ndarray, a: int, b: int) -> int:
    """Tokens of ``text[a:b]``, given where the text's own parts end (from 0) and the tokens up to there.

    From the first place on where a part of the text ends the piece falls into the same parts, up to where its end may
    matter to one: the last two parts before it, and those of a run of blanks that reaches into them."""
    k = int(np.searchsorted(ends, a))
    head, at = 0, a
    if ends[k] != a:
        for m in enc.matches(text, a, b):
            head += enc.count_part(m.group())
            at = m.end()
            k = int(np.searchsorted(ends, at))
            if ends[k] == at:
                break
    j = int(np.searchsorted(ends, b)) - 2
    while j > k and text[ends[j] - 1].isspace():
        j -= 1
    if j <= k:
        return head + (enc.count(text[at:b]) if at < b else 0)
    return head + int(upto[j] - upto[k]) + enc.count(text[ends[j] : b])


def split_text(enc: Encoder, text: str, limit: int | None, overlap: int) -> tuple[int, list[tuple[int, int, int, int, str]]]:
    """Tokens of the text, and its pieces as (tokens, first character, end, tokens shared with the one before, grade of its end)."""
    parts, ids = enc.pieces(text)
    lengths = np.fromiter(map(len, ids), "int64", len(ids))
    total = int(lengths.sum())
    if limit is None or total <= limit:
        return total, [(total, 0, len(text), 0, "end")]
    data = np.frombuffer(text.encode("utf-8", "replace"), "uint8")
    sizes = enc.sizes[np.fromiter(chain.from_iterable(ids), "int64", total)]
    offset = np.concatenate([[0], np.cumsum(sizes)])
    piece_start = np.concatenate([[0], np.cumsum(lengths)])
    grade = _graded(data, offset, piece_start)
    grade[0] = grade[-1] = 0
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), "int64", len(parts)))])
    room = limit
    while True:
        spans = cut_positions(grade, room, overlap)
        out, end_before, worst = [], 0, 0
        for s, e in spans:
            a, b = int(chars[offset[s]]), int(chars[offset[e]])
            size = count_between(enc, text, ends, piece_start, a, b)  # a piece may encode differently from its place in the text
            worst = max(worst, size - limit if b - a > 1 else 0)
            out.append((size, a, b, max(0, end_before - s), GRADES[grade[e]] if e < total else "end"))
            end_before = e
        if worst <= 0 or room <= 1:
            return total, out
        room = max(1, room - worst)


def _limits(sources: DataFrame, source: str) -> DataFrame:
    """``_s, limit, overlap`` of each source, the least limit where there are several."""
    one = F.min(F.struct(F.col("max_tokens").cast("int").alias("m"), F.coalesce(F.col("overlap_tokens").cast("int"), F.lit(0)).alias("o")))
    return sources.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("_s")).agg(one.alias("_l")).select("_s", F.col("_l.m").alias("limit"), F.col("_l.o").alias("overlap"))


def check_pieces(pieces: DataFrame, docs: DataFrame, sources: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row on the pieces of :func:`split_oversized`: ``n_texts, n_oversized, n_over_limit, n_short_overlap, n_not_rebuilt``.

    Of all texts that are neither null nor empty: pieces above the limit of their source (a single character may be),
    pieces that share too little with the one before, and texts that their pieces, joined without overlaps, don't give
    back. Ids must be unique. Null ids take no part.
    """
    p = pieces.where("doc_id IS NOT NULL").join(_limits(sources, source), F.col("source") == F.col("_s"), "left")
    most = F.when(F.col("limit") < 1, 1).otherwise(F.col("limit"))  # null: none
    share = F.least("overlap", F.floor(most / 2))
    over = (F.col("n_tokens") > most) & (F.col("end_char") - F.col("start_char") > 1)
    short = F.col("oversized") & (F.col("piece_no") > 0) & (F.col("shared_tokens") < share)
    ordered = F.array_sort(F.collect_list(F.struct("piece_no", "start_char", "end_char", "text")))
    one = p.groupBy("doc_id").agg(ordered.alias("p"), F.count_if(over).alias("over"), F.count_if(short).alias("short"), F.bool_or("oversized").alias("oversized"))
    joined = F.expr("aggregate(p, CAST(struct('' AS t, 0L AS n) AS struct<t:string,n:bigint>), (got, x) -> struct(concat(got.t, substring(x.text, int(got.n - x.start_char) + 1)) AS t, x.end_char AS n), got -> got.t)")
    gaps = F.expr("size(filter(p, (x, i) -> i > 0 AND x.piece_no <> p[i - 1].piece_no + 1))")
    one = one.select("doc_id", "over", "short", "oversized", joined.alias("rebuilt"), gaps.alias("gaps"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    both = texts.join(one, "doc_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return both.agg(
        F.count("*").alias("n_texts"), none(F.count_if("oversized")).alias("n_oversized"), none(F.sum("over")).alias("n_over_limit"), none(F.sum(F.col("short") + F.col("gaps"))).alias("n_short_overlap"),
        none(F.count_if(F.coalesce(F.col("rebuilt") != F.col("text"), F.lit(True)))).alias("n_not_rebuilt"),
    )


def split_oversized(
    docs: DataFrame,
    sources: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """``doc_id, source, doc_tokens, oversized, piece_no, n_pieces, n_tokens, start_char, end_char, shared_tokens, boundary, text``.

    Texts of at most ``max_tokens`` of their source, and texts of a null or unlisted source or one without a limit, are
    one piece. Joined without their overlaps, the pieces of a text are the text.

    * null and empty texts have no pieces; a limit below 1 counts as 1; an overlap beyond half the limit counts as half;
    * a single character of more tokens than the limit stays whole, since a piece is text;
    * ``shared_tokens`` exceeds the overlap by at most three where the overlap would split a character;
    * of several rows for a source the one with the least limit counts; repeated documents are each split;
    * an empty table gives no rows; other columns are ignored, whatever their names.
    """
    limits = _limits(sources, source)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).cast("string").alias("text"))
    rows = rows.join(limits, F.col("source") == F.col("_s"), "left").select("doc_id", "source", "limit", "overlap", "text")
    get = load(docs.sparkSession, tokenizer)
    key = docs.schema[doc_id].dataType.simpleString()
    schema = (
        f"doc_id {key}, source string, doc_tokens bigint, oversized boolean, piece_no int, n_pieces int, n_tokens int, "
        "start_char bigint, end_char bigint, shared_tokens int, boundary string, text string"
    )
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = get()
        names = [c.split()[0] for c in schema.split(", ")]

        def pack(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            take = keys.take(pa.array([r[0] for r in rows], pa.int64()))
            return pa.RecordBatch.from_arrays([take, *[pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[1:], kinds, strict=True)]], names)

        for batch in batches:
            sources_, limits_, overlaps = (batch.column(i).to_pylist() for i in (1, 2, 3))
            rows, size = [], 0
            for k, t in enumerate(texts_of(batch.column(4))):
                if not t:
                    continue
                limit = None if limits_[k] is None else max(1, limits_[k])
                total, pieces = split_text(enc, t, limit, overlaps[k] or 0)
                over = limit is not None and total > limit
                for i, (n, a, b, shared, grade) in enumerate(pieces):
                    rows.append((k, sources_[k], total, over, i, len(pieces), n, a, b, shared, grade, t[a:b]))
                    size += b - a
                if size >= FLUSH:
                    yield pack(batch.column(0), rows)
                    rows, size = [], 0
            if rows:
                yield pack(batch.column(0), rows)

    return rows.mapInArrow(run, schema)
