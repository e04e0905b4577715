"""Periodic stretches of words: maximal runs found by way of Lyndon arrays, in linear time and by comparisons alone.

The words of a batch are numbered by sorting them. A word that occurs fewer than E times in a text, or in what is left
of it, is in no run of exponent E, so it parts the text; what is left between such words is searched. `lyndon_edges`
goes over a sequence once, with a stack of the positions whose next smaller suffix is not met yet. How far two suffixes
match is read off earlier matches: within the stretch that is known to repeat an earlier one the answers of that one are
copied, and one stack entry after the other is decided from the match of the two entries themselves. Words are compared
only beyond the end of what has been matched, which never moves back, so all comparisons are linear in number. Every
Lyndon root of a run is an edge under one of two orders of the words, the plain and the reversed one; the edges that
repeat often enough are extended to the left and give the runs.

Defined cases: a null text has no words; words are the stretches between the characters 9 to 13 and 32, compared byte by
byte; texts are taken whole, whatever their length; rows are independent, so repeated rows give repeated results; a null
id is kept; an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_bytes, limit_batches

#: Fixed value: the characters between words.
GAPS = bytes([9, 10, 11, 12, 13, 32])
_IS_GAP = np.isin(np.arange(256), list(GAPS))
#: Words that agree in so many groups of eight bytes are compared as they are.
_GROUPS = 4


def lyndon_edges(w: Sequence[int]) -> tuple[list[int], list[int]]:
    """For each position the next one whose suffix is smaller (the length of `w` if none is), and how many items the two suffixes share.
    A suffix that is a prefix of another one is smaller."""
    n = len(w)
    after, after_match = [n] * n, [0] * n  # the next smaller suffix of a position
    before_match = [0] * n  # the match with the nearest earlier smaller suffix
    stack = [0] if n else []
    end = shift = 0  # what lies from the last compared position to `end` repeats what lies `shift` before it
    for r in range(1, n):
        copies, known, popped = r < end, 0, -1
        while stack:
            left = stack[-1]
            if copies:
                smaller = after[left - shift] == r - shift
                match = after_match[left - shift] if smaller else before_match[r - shift]
                compare = match >= end - r
                if compare:
                    match, copies = end - r, False
            elif popped < 0:
                match, compare = 0, True
            else:  # the popped entry matched its own entry below in so many items
                between = before_match[popped]
                smaller, match, compare = between > known, min(between, known), between == known
            if compare:
                while r + match < n and w[r + match] == w[left + match]:
                    match += 1
                smaller = r + match == n or w[r + match] < w[left + match]
                end, shift = r + match, r - left
            if not smaller:
                before_match[r] = match
                break
            after[left], after_match[left] = r, match
            known, popped = match, stack.pop()
        stack.append(r)
    return after, after_match


def runs_of(w: Sequence[int], min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of `min_length` items and `min_exponent` (2 or more) periods at least, by start, then period."""
    n, found = len(w), []
    for items in (w, [-x for x in w]):
        for left, (right, match) in enumerate(zip(*lyndon_edges(items), strict=True)):
            period = right - left
            if right == n or match < (min_exponent - 2) * period or match + 2 * period < min_length:
                continue
            back = 0
            while back < period and back < left and items[left - back - 1] == items[right - back - 1]:
                back += 1
            length = back + period + match
            if back < period and length >= max(min_length, min_exponent * period):
                found.append((left - back, length, period))
    found.sort(key=lambda x: (x[0], x[2]))
    return [x for x, y in zip(found, [None, *found], strict=False) if x != y]


def numbered_words(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only; found by sorting."""
    if not len(starts):
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)

    def group(of: np.ndarray, at: int, most: int) -> np.ndarray:
        key = np.ascontiguousarray(windows[starts[of] + at]).view("<u8").ravel()
        left = np.minimum(sizes[of] - at, most).astype(np.uint64)
        return np.where(left == 8, key, key & ((np.uint64(1) << (left * np.uint64(8))) - np.uint64(1)))

    everything = np.arange(len(starts))
    first = group(everything, 0, 7) | np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56)
    number, counts = np.unique(first, return_inverse=True, return_counts=True)[1:]
    number, used = number.astype(np.int64), len(counts)
    open_ = everything[(sizes > 7) & (counts[number] > 1)]
    for k in range(_GROUPS):
        if not len(open_):
            return number
        key = group(open_, 7 + 8 * k, 8)
        order = np.lexsort((sizes[open_], key, number[open_]))
        by = open_[order]
        new = np.r_[True, (number[by][1:] != number[by][:-1]) | (key[order][1:] != key[order][:-1]) | (sizes[by][1:] != sizes[by][:-1])]
        ranks = np.cumsum(new) - 1
        many = np.bincount(ranks)[ranks] > 1
        number[by] = used + ranks
        used += ranks[-1] + 1
        open_ = by[many & (sizes[by] > 15 + 8 * k)]
    words = sorted((number[i], raw[starts[i] : starts[i] + sizes[i]].tobytes(), i) for i in open_.tolist())
    for one, other in zip(words, [None, *words], strict=False):
        used += other is None or one[:2] != other[:2]
        number[one[2]] = used
    return number


def searched(number: np.ndarray, of: np.ndarray, min_length: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches that can hold runs: of one text, long enough, with every word `least` times or more."""
    part, inside = of, np.ones(len(number), bool)
    while True:
        at = np.flatnonzero(inside)
        inverse, counts = np.unique(part[at] << 32 | number[at], return_inverse=True, return_counts=True)[1:]
        inside[at] = counts[inverse] >= least
        fresh = np.r_[True, ~inside[:-1] | (part[1:] != part[:-1])] if len(part) else inside
        starts = np.flatnonzero(inside & fresh)
        ends = np.flatnonzero(inside & np.r_[~inside[1:] | fresh[1:], True]) + 1 if len(part) else starts
        long = ends - starts >= min_length
        starts, ends = starts[long], ends[long]
        steps = np.zeros(len(number) + 1, np.int64)
        steps[starts] += 1
        part = np.cumsum(steps[:-1])
        np.subtract.at(steps, ends, 1)
        inside = np.cumsum(steps[:-1]) > 0
        if np.count_nonzero(inside) == len(at):
            return starts, ends


def runs_in_batch(texts: pa.Array, min_length: int, min_exponent: int) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
    """The number of words of each text, and its runs, in word numbers from 0."""
    raw, offsets = arrow_bytes(texts)
    gap = _IS_GAP[raw]
    first = np.zeros(len(raw), bool)
    first[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(~gap & (np.r_[True, gap[:-1]] | first)) if len(raw) else np.zeros(0, np.int64)
    last = np.zeros(len(raw), bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(~gap & (np.r_[gap[1:], True] | last)) + 1 if len(raw) else starts
    of = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(of, minlength=len(texts))
    before = np.r_[0, np.cumsum(n_words)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    number = numbered_words(raw, starts, ends - starts)
    a, b = searched(number, of, min_length, min_exponent)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        text = int(of[x])
        base = x - int(before[text])
        found[text] += [(base + s, size, period) for s, size, period in runs_of(number[x:y].tolist(), min_length, min_exponent)]
    return n_words, found


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds behind its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [x for x, y in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not y]


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text", min_length: int = 24, min_exponent: int = 3, with_runs: bool = True, with_text: bool = True) -> DataFrame:
    """For each row: id, n_runs; start, length, period and exponent_milli of its run with the greatest exponent (ties: smallest start,
    then period; nulls without a run); digests of the list of all runs and of the collapsed text; and, as asked for, the runs and that text,
    which has each run's first period only. No shuffle."""
    limit_batches(df.sparkSession)
    run_type = "array<struct<start:bigint,length:bigint,period:bigint>>"
    ddl = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    ddl += f", runs {run_type}" * with_runs + ", collapsed string" * with_text

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(1), runs_in_batch(batch.column(1), min_length, min_exponent)[1], strict=True):
                best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
                listed = "".join(f"{s},{size},{period}\n" for s, size, period in runs)
                collapsed = b" ".join(kept_words(text.as_py().encode().split(), runs))
                row = {"n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2]}
                row |= {"runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed).hexdigest()}
                row |= {"runs": [dict(zip(("start", "length", "period"), x, strict=True)) for x in runs]} if with_runs else {}
                rows.append(row | ({"collapsed": collapsed.decode()} if with_text else {}))
            kinds = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
            kinds += [("runs", pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])))] * with_runs + [("collapsed", pa.string())] * with_text
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in kinds)], names=[id_col, *(k for k, _ in kinds)])

    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return df.select(F.col(id_col), F.coalesce(text.cast("string"), F.lit("")).alias("text")).mapInArrow(search, ddl)


def with_periodic_ends(id_col: str, text_col: str) -> Column:
    """The text of a row, with a planted periodic end in one row of ten, chosen by the checksum of its id: from word a on, the words from a repeat with period p."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, period), times)), 1, n - a)
    return F.when((h % 10 == 0) & (n > 0), F.concat_ws(" ", F.slice(words, 1, a), tail)).otherwise(F.col(text_col))
