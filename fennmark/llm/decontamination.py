"""Benchmark decontamination: documents that hold a passage within a small edit distance of a benchmark item.

A CGK embedding walks over a sequence of bytes: at each step it writes down the byte it stands on, and goes on to the next
byte or stays, as a random bit of the byte and the step says. Bytes that two walks share bring them together again after
an insertion or deletion, so a small edit distance becomes a small Hamming distance between the two walks. A key
is some drawn steps of a walk (bit sampling); several walks with several keys each are the repetitions. An item has a window from each of its
words on, so that its windows together are as long as the item; their steps and repetitions go by the item's size (PLANS): the shorter the item, the shorter and the more.
Every word of every document begins a window as well, and so does every character of three or more bytes, as in scripts without spaces. Windows of a document and an item
that share a key are a hit; as many hits of different windows at about the same place as the plan asks for, or one where the item has few windows, are a candidate. It is
verified: the least number of edits of characters between the whole item and any stretch of the document around the place.

Steps and repetitions are set for a recall of 0.9 at least up to RATE, for random insertions, deletions and replacements of characters in
items of every size from SHORTEST bytes on (`tests/llm` measures it by size and rate); edits of whole words spare more windows. Items that are shorter
are looked for word by word, without edits. Plans without items cost nothing.

Documents are never shuffled. The items are sent to the tasks in blocks of bounded size, one pass over the documents for each block.

Defined cases: a null text, or one without words, holds nothing; an item without words is in nothing; items of less than SHORTEST bytes, or of punctuation
only, are looked for word by word; a zero byte counts as another control character; repeated items and repeated documents each give their own pairs (one for each pair of ids); a null id of a
document is kept as null; `clean_documents` judges each row by its own text, whatever its id; empty tables give an empty result; columns other than those named are
kept by `clean_documents` and ignored by the rest. Case of A-Z and the kind of white space do not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard import word_hashes
from .shared import arrow_bytes, limit_batches, mixed

#: Edits between an item and a passage, as a share of the item's characters, up to which the passage counts.
RATE = 0.25
#: An item with FEW windows or more must have as many hits as its plan says; bytes by which the places of two hits may differ.
FEW, NEAR = 8, 40
#: One window in so many must hit, where that is more than the plan asks for.
SHARE = 9
#: Bytes from which an item is looked for with edits.
SHORTEST = 12
#: Windows of a document that are walked together, bytes of text that are normalised together.
CHUNK, SLICE = 1 << 15, 2 << 20
#: Candidates that are kept until they are verified, and pairs that are verified together.
WAITING, PAIRS = 4096, 1024
#: Items and bytes of items that a pass takes at most; an item of fewer than SMALL bytes, which has more candidates, counts as MANY.
SMALL, MANY = 45, 16
MOST_ITEMS, MOST_BYTES = 20_000, 16 << 20

_SPACES = re.compile("[\\x20\\x09-\\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)} | {0: 1}
_BITS = 22

_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(32)], np.uint64)


@dataclass(frozen=True)
class Plan:
    """How items of `least` bytes and more are looked for: steps of a walk (it goes over about half as many bytes), steps drawn for a key, walks, keys of each, hits."""

    least: int
    steps: int
    drawn: int
    walks: int
    keys: int
    hits: int

    @cached_property
    def random(self) -> tuple[np.ndarray, list[list[list[int]]]]:
        """Whether a walk goes on, by walk, step and byte; and the keys that are drawn at each walk and step."""
        rng = np.random.default_rng(20240229)
        onward = rng.integers(0, 2, (self.walks, self.steps, 256)).astype(np.int64)
        onward[:, :, 0] = 0  # a zero ends a text: walks stay there
        drawn: list[list[list[int]]] = [[[] for _ in range(self.steps)] for _ in range(self.walks)]
        for key in range(self.walks * self.keys):
            for t in rng.choice(self.steps, self.drawn, replace=False).tolist():
                drawn[key // self.keys][t].append(key)
        return onward, drawn

    def window_keys(self, text: np.ndarray, starts: np.ndarray, whole: bool) -> np.ndarray:
        """The keys of the windows that begin at `starts`, a row for each of walks * keys. With `whole`, a key that looks beyond the end of its text is 0."""
        onward, drawn = self.random
        keys = np.zeros((self.walks * self.keys, len(starts)), np.uint64)
        beyond = np.zeros(keys.shape, bool) if whole else None
        for walk in range(self.walks):
            place = starts.copy()
            for t in range(self.steps):
                now = text.take(place).astype(np.int64)
                weighed = now.view(np.uint64) * _ODD[t]
                for key in drawn[walk][t]:
                    keys[key] += weighed
                    if whole:
                        beyond[key] |= now == 0
                place += onward[walk, t].take(now)
        keys ^= keys >> np.uint64(31)
        keys *= _ODD[0]
        keys ^= np.arange(1, len(keys) + 1, dtype=np.uint64)[:, None] << np.uint64(40)
        if whole:
            keys[beyond] = 0
        return keys


PLANS = [Plan(SHORTEST, 16, 8, 8, 5, 1), Plan(26, 20, 10, 4, 6, 1), Plan(SMALL, 20, 10, 4, 6, 2), Plan(80, 28, 14, 3, 4, 2)]


def normalised(text: str) -> list[str]:
    return [x for x in _SPACES.split(text.translate(_LOWER)) if x]


def normalised_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in lower case, with single spaces, a zero after each; and where each row begins (one more: the end)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]
    flat = data[keep]
    flat = flat + ((flat >= 65) & (flat <= 90)).view(np.uint8) * np.uint8(32)
    flat[space[keep]] = 32
    flat[flat == 0] = 1
    ends = np.r_[0, np.cumsum(np.add.reduceat(np.r_[keep, False].view(np.uint8), offsets[:-1], dtype=np.int64) * (np.diff(offsets) > 0))] if len(offsets) > 1 else offsets
    begins = ends + np.arange(len(ends))
    out = np.zeros(begins[-1], np.uint8)
    for a, b, to in zip(ends[:-1].tolist(), ends[1:].tolist(), begins[:-1].tolist(), strict=True):
        out[to : to + b - a] = flat[a:b]
    return out, begins


def window_starts(text: np.ndarray) -> np.ndarray:
    """Letters and digits behind anything else of ASCII, and characters of three or more bytes."""
    start = text >= 48
    start[1:] &= (text[:-1] < 48) | (text[1:] >= 0xE0)
    return np.flatnonzero(start)


def edits(patterns: list[str], texts: list[str]) -> np.ndarray:
    """The least edit distance between each pattern and any stretch of its text: bit-parallel columns, for all pairs together, by the patterns' number of 64-bit words and the lengths of the texts."""
    out = np.array([len(p) for p in patterns], np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    words = -(-out // 64)
    for w in np.unique(words[words > 0]).tolist():
        some = np.flatnonzero(words == w)
        some = some[np.argsort(lengths[some], kind="stable")]
        for at in range(0, len(some), PAIRS):
            part = some[at : at + PAIRS].tolist()
            out[part] = _edits_of_words(w, [patterns[k] for k in part], [texts[k] for k in part])
    return out


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in strings], np.int64)
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), sizes


def _edits_of_words(w: int, patterns: list[str], texts: list[str]) -> np.ndarray:
    n = len(patterns)
    flat, sizes = _codes(patterns)
    letters, letter = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    masks = np.zeros((w, n * (len(letters) + 1)), np.uint64)  # the last letter stands for all that are in no pattern
    np.bitwise_or.at(masks, (place // 64, row * (len(letters) + 1) + letter), np.uint64(1) << (place % 64).astype(np.uint64))
    flat, lengths = _codes(texts)
    found = np.searchsorted(letters, flat)
    found[letters[np.minimum(found, len(letters) - 1)] != flat] = len(letters)
    columns = np.full((int(lengths.max()), n), len(letters), np.int64)
    row = np.repeat(np.arange(n), lengths)
    columns[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = found
    columns += np.arange(n) * (len(letters) + 1)

    one, high = np.uint64(1), np.uint64(63)
    last = ((sizes - 1) % 64).astype(np.uint64)
    up, down = [np.full(n, ~np.uint64(0)) for _ in range(w)], [np.zeros(n, np.uint64) for _ in range(w)]
    score, best = sizes.copy(), sizes.copy()
    none = np.zeros(n, np.uint64)
    for column in columns:
        more_in = less_in = none
        for k in range(w):
            eq = masks[k].take(column)
            vertical = eq | down[k]
            eq |= less_in
            across = (((eq & up[k]) + up[k]) ^ up[k]) | eq
            more, less = down[k] | ~(across | up[k]), up[k] & across
            if k == w - 1:
                score += ((more >> last) & one).view(np.int64) - ((less >> last) & one).view(np.int64)
            more_out, less_out = more >> high, less >> high
            more, less = (more << one) | more_in, (less << one) | less_in
            up[k], down[k] = less | ~(vertical | more), more & vertical
            more_in, less_in = more_out, less_out
        np.minimum(best, score, out=best)
    return best


class Windows:
    """The keys, sorted, of the windows of those items of a block that a plan takes."""

    def __init__(self, plan: Plan, text: np.ndarray, begins: np.ndarray, taken: np.ndarray):
        self.plan = plan
        starts = window_starts(text)
        item = np.searchsorted(begins, starts, "right") - 1
        starts, item = starts[taken[item]], item[taken[item]]
        keys = plan.window_keys(text, starts, whole=True)
        key, at = np.nonzero(keys)
        order = np.argsort(keys[key, at], kind="stable")
        self.keys = keys[key, at][order]
        self.item, self.start = item[at][order].astype(np.int32), (starts - begins[item])[at][order].astype(np.int32)
        self.of_item = np.bincount(item[keys.any(0)], minlength=len(taken))
        self.needed = np.where(self.of_item >= FEW, np.maximum(plan.hits, self.of_item // SHARE), 1)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `text` where the item would begin, item, place of the window in the item) of every hit."""
        out: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        for at in range(0, len(starts), CHUNK):
            some = starts[at : at + CHUNK]
            keys = self.plan.window_keys(text, some, whole=False)
            draw, which = np.nonzero(self.maybe[(keys >> np.uint64(64 - _BITS)).astype(np.int64)])
            key = keys[draw, which]
            low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            counts = high - low
            entry = np.repeat(low - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            start = self.start[entry].astype(np.int64)
            out.append((np.repeat(some[which], counts) - start, self.item[entry].astype(np.int64), start))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def candidates(self, text: np.ndarray, begins: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first and last place where the item may begin) with hits of enough different windows."""
        place, item, start = self.hits(text, starts)
        row = np.searchsorted(begins, np.clip(place + start, 0, None), "right") - 1
        order = np.lexsort((place, item, row))
        place, item, start, row = place[order], item[order], start[order], row[order]
        cuts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(place) > NEAR), True][: len(row) + 1]) if len(row) else np.zeros(1, np.int64)
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        windows = np.unique(np.stack([group, start]), axis=1)[0] if len(group) else group
        enough = np.flatnonzero(np.bincount(windows, minlength=len(cuts) - 1) >= self.needed[item[cuts[:-1]]])
        yield from zip(row[cuts[enough]].tolist(), item[cuts[enough]].tolist(), place[cuts[enough]].tolist(), place[cuts[enough + 1] - 1].tolist(), strict=True)


class Items:
    """A block of items: the windows of each plan, and the items that are looked for word by word."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        self.texts = [" ".join(normalised(t)) for t in texts]
        text, begins = normalised_bytes(*arrow_bytes(pa.array(self.texts, pa.string())))
        plan = np.searchsorted([p.least for p in PLANS], np.diff(begins) - 1, "right") - 1
        every = [Windows(p, text, begins, plan == k) for k, p in enumerate(PLANS) if (plan == k).any()]
        self.windows = [w for w in every if len(w.keys)]
        hashes, bounds, _ = _words(text, begins)
        self.plain: dict[int, dict[int, list[int]]] = {}
        for k in np.flatnonzero(sum((w.of_item for w in self.windows), np.zeros(len(ids), np.int64)) == 0).tolist():
            a, b = bounds[k], bounds[k + 1]
            if b > a:
                self.plain.setdefault(int(b - a), {}).setdefault(int(sequence_hashes(hashes[a:b], b - a)[0]), []).append(k)

    def candidates(self, text: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first and last place where the item may begin)."""
        starts = window_starts(text)
        for windows in self.windows:
            yield from windows.candidates(text, begins, starts)
        if self.plain:
            hashes, bounds, places = _words(text, begins)
            for n, known in self.plain.items():
                found = sequence_hashes(hashes, n)
                for p in np.flatnonzero(np.isin(found, np.array(list(known), np.uint64))).tolist():
                    r = int(np.searchsorted(bounds, p, "right")) - 1
                    if p + n <= bounds[r + 1]:
                        yield from ((r, k, int(places[p]), int(places[p])) for k in known[int(found[p])])


def _words(text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word, where each row's words begin and end among them, and the place of each."""
    spaced = np.where(text == 0, np.uint8(32), text)
    word = spaced != 32
    word[1:] &= spaced[:-1] == 32
    return *word_hashes(spaced, begins), np.flatnonzero(word)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = mixed(out * _ODD[0] + words[k : len(words) - n + 1 + k])
    return out


@lru_cache(maxsize=2)
def _items(packed: bytes) -> Items:
    table = pa.ipc.open_stream(packed).read_all()
    return Items(table.column("item_id").to_pylist(), table.column("text").to_pylist())


_PAIR = "doc_id bigint, item_id bigint, edits bigint, item_chars bigint, at_byte bigint"


def pairs_in_rows(items: Items, texts: pa.Array, rate: float) -> list[tuple[int, int, int, int, int]]:
    """(row, item_id, edits, item_chars, at_byte of the normalised text) of each row and item that it holds. The rows are looked at in slices."""
    at, (_, ends) = 0, arrow_bytes(texts)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    waiting: list[tuple[int, int, int, str]] = []

    def verify() -> None:
        for (r, k, p, _), d in zip(waiting, edits([items.texts[k] for _, k, _, _ in waiting], [x[3] for x in waiting]).tolist(), strict=True):
            if d <= rate * len(items.texts[k]):
                best[r, k] = min(best.get((r, k), (d, p)), (d, p))
        waiting.clear()

    while at < len(texts):
        n = max(1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1 - at)
        text, begins = normalised_bytes(*arrow_bytes(texts.slice(at, n)))
        for r, k, first, last in items.candidates(text, begins):
            whole = items.texts[k]
            size = len(whole.encode())
            slack = NEAR + int(rate * size)
            low, high = max(int(begins[r]), first - slack), min(int(begins[r + 1]) - 1, last + size + slack)
            region, p = text[low:high].tobytes().decode("utf-8", "ignore"), max(0, first - int(begins[r]))
            if whole in region:
                best[at + r, k] = min(best.get((at + r, k), (0, p)), (0, p))
            else:
                waiting.append((at + r, k, p, region))
            if len(waiting) >= WAITING:
                verify()
        at += n
    if waiting:
        verify()
    return [(r, items.ids[k], d, len(items.texts[k]), p) for (r, k), (d, p) in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator:
    """The distinct items, as broadcast blocks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    short = F.octet_length(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ")) < SMALL
    n, size = items.agg(F.coalesce(F.sum(F.when(short, MANY).otherwise(1)), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // MOST_ITEMS), -(-size // MOST_BYTES), 1)
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, block.schema) as writer:
            writer.write_table(block)
        yield spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """A row for each document and item that it holds: ids, the number of edits, the item's characters, and the byte of the normalised text about which it begins."""
    limit_batches(df.sparkSession, 8)
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), _text(text_col).alias("text"))

    def searched(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = pairs_in_rows(_items(sent.value), batch.column(1), rate)
                if found:
                    row, *columns = zip(*found, strict=True)
                    names = ["doc_id", "item_id", "edits", "item_chars", "at_byte"]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *[pa.array(c, pa.int64()) for c in columns]], names=names)

        return rows.mapInArrow(run, _PAIR)

    return reduce(DataFrame.union, [searched(x) for x in _blocks(benchmark, item_col, item_text_col)])


def clean_documents(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of `df` that hold no item, each judged by its own text."""
    limit_batches(df.sparkSession, 8)
    extra = "text" + "_" * max(map(len, df.columns))
    schema = df.schema

    def without(rows: DataFrame, sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in pairs_in_rows(_items(sent.value), batch.column(batch.num_columns - 1), rate)]] = False
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=schema.names).filter(pa.array(clean))

        return rows.withColumn(extra, _text(text_col)).mapInArrow(run, schema)

    return reduce(without, _blocks(benchmark, item_col, item_text_col), df)
