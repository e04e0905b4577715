"""Token counts that follow edits: a segment tree of pre-tokens for each document, kept as a table from one round of edits to the next.

A leaf stands for LEAF pre-tokens or so, an inner node holds the sums of characters and tokens below it. `trees` encodes every text once and keeps the sums. `edited` starts
from kept trees: an edit descends by characters to the leaf that holds its begin and so much context before it as can depend on it, and splits the text from there
anew, leaf by leaf, until a boundary falls on the end of an old leaf behind the edit: from there on nothing changes. Only the new pre-tokens are encoded (for all documents of a
batch together), in leaves of LEAF again, and the sums above are brought up to date. Texts without edits are passed on as they are.

Defined cases: a null text is empty; null edits are none; places are code points of the text before any edit of the round and are cut to its length; an edit that
begins before the end of the one before it (by begin, then end, then replacement) is left out, so equal edits count once; a null replacement is empty;
rows are independent, so repeated rows give repeated results and null ids stay; an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, vocabulary
from .secrets import located
from .shared import limit_batches, stored

LEAF = 32
#: Characters behind a stretch that are split with it, up to the next one that is not white space.
AHEAD = 64


def summed(leaves: list[int]) -> np.ndarray:
    """The nodes of a segment tree: 1 is the root, 2k and 2k + 1 are below k, the second half are the leaves (and noughts)."""
    size = 1 << max(0, len(leaves) - 1).bit_length()
    nodes = np.zeros(2 * size, np.int64)
    nodes[size : size + len(leaves)] = leaves
    while size > 1:
        nodes[size // 2 : size] = nodes[size : 2 * size : 2] + nodes[size + 1 : 2 * size : 2]
        size //= 2
    return nodes


def leaf_at(nodes: list[int] | np.ndarray, place: int) -> tuple[int, int]:
    """The leaf that holds the character at `place` (the last that holds any, if none does), and the place where it begins."""
    size, node, begin = len(nodes) // 2, 1, 0
    place = min(place, max(0, int(nodes[1]) - 1))
    while node < size:
        node *= 2
        if place - begin >= nodes[node]:
            begin += int(nodes[node])
            node += 1
    return node - size, begin


class Tree:
    """The leaves of one document while it is edited, from the last edit to the first; leaves made anew hold their pre-tokens."""

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self.text, self.chars = text, chars
        self.leaves: list[int | list[str]] = list(tokens)
        self.nodes = summed(chars)
        self.resplit = 0

    def edit(self, words: Vocabulary, start: int, end: int, replacement: str) -> None:
        """Replace the characters from `start` to `end`. Nothing to the left of an edit has been changed before, so the tree still tells where it begins."""
        margin = max([2, *map(len, words.added)])
        first, at = leaf_at(self.nodes, max(0, start - margin))
        last, stop = first, at + self.chars[first]
        while stop < end and last + 1 < len(self.chars):
            last += 1
            stop += self.chars[last]
        while True:
            whole = self.text[at:start] + replacement + self.text[end:stop]
            behind = stop + AHEAD + margin
            while behind < len(self.text) and self.text[behind - 1].isspace():
                behind += AHEAD
            pieces, length = [], 0
            for x in words.pieces(whole + self.text[stop:behind]):
                if length >= len(whole):
                    break
                pieces.append(x)
                length += len(x)
            if length == len(whole) and (stop >= len(self.text) or len(whole) >= start - at + len(replacement) + 1):
                break
            last += 1
            stop += self.chars[last]
        self.text = self.text[:start] + replacement + self.text[end:]
        new = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self.leaves[first : last + 1] = new
        self.chars[first : last + 1] = [sum(map(len, x)) for x in new]
        self.resplit += len(pieces)

    def unknown(self) -> Iterator[str]:
        for leaf in self.leaves:
            if isinstance(leaf, list):
                yield from leaf

    def tokens(self, known: dict[str, tuple[int, ...]]) -> list[int]:
        return [leaf if isinstance(leaf, int) else sum([len(known[x]) for x in leaf]) for leaf in self.leaves]


def in_order(edits: list[dict] | None, length: int) -> list[tuple[int, int, str]]:
    """The edits that are made, by place."""
    out: list[tuple[int, int, str]] = []
    cut = lambda x: min(max(x or 0, 0), length)
    rows = sorted((cut(e["start"]), max(cut(e["start"]), cut(e["end"])), e["replacement"] or "") for e in edits or [] if e)
    for e in rows:
        if not out or (e[0] >= out[-1][1] and e != out[-1]):
            out.append(e)
    return out


def planted(words: Vocabulary, texts: list[str]) -> list[tuple[list[int], list[int], int]]:
    """Characters and tokens of each leaf, and the number of pre-tokens, of each text."""
    pieces = [words.pieces(t) for t in texts]
    known = words.learnt(set().union(*pieces))
    out = []
    for p in pieces:
        starts = np.arange(0, max(1, len(p)), LEAF)
        both = (np.fromiter(map(len, p), np.int64, len(p)), np.fromiter(map(len, map(known.__getitem__, p)), np.int64, len(p)))
        chars, tokens = (np.add.reduceat(x, starts).tolist() if p else [0] for x in both)
        out.append((chars, tokens, len(p)))
    return out


def grown(words: Vocabulary, texts: list[str], chars: list[list[int]], tokens: list[list[int]], edits: list[list[dict] | None]) -> list[tuple[str, list[int], list[int], int, int]]:
    """The text, the leaves' characters and tokens, the number of edits made and of pre-tokens split anew, of each text after its edits."""
    trees: dict[int, Tree] = {}
    made = [in_order(e, len(t)) if e else [] for e, t in zip(edits, texts, strict=True)]
    for k, m in enumerate(made):
        if m:
            trees[k] = Tree(texts[k], list(chars[k]), tokens[k])
            for e in reversed(m):
                trees[k].edit(words, *e)
    known = words.learnt({x for tree in trees.values() for x in tree.unknown()})
    return [(tree.text, tree.chars, tree.tokens(known), len(m), tree.resplit) if (tree := trees.get(k)) else (texts[k], chars[k], tokens[k], 0, 0) for k, m in enumerate(made)]


_TREE = "text string, chars array<int>, tokens array<int>"
_INTS = pa.list_(pa.int32())


def trees(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, the characters and tokens of the leaves, n_tokens and n_pieces of each row. No shuffle."""
    limit_batches(df.sparkSession, 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(vocabulary_path)
        for batch in batches:
            chars, tokens, n = zip(*planted(words, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            columns = [pa.array(chars, _INTS), pa.array(tokens, _INTS), pa.array([sum(x) for x in tokens], pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[id_col, "text", "chars", "tokens", "n_tokens", "n_pieces"])

    ddl = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {_TREE}, n_tokens bigint, n_pieces bigint"
    return df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, ddl)


def edited(kept: DataFrame, edits: Column, vocabulary_path: str) -> DataFrame:
    """Rows of `trees` or of `edited` after their edits (an array of struct<start, end, replacement>): the same columns, with text, leaves and `n_after` as they are now, and n_edits and n_resplit added to
    what they were. No shuffle."""
    limit_batches(kept.sparkSession, 8)
    plain = F.transform(edits, lambda e: F.struct(e["start"].cast("bigint").alias("start"), e["end"].cast("bigint").alias("end"), e["replacement"].cast("string").alias("replacement")))
    counted = [c for c in ("n_edits", "n_resplit") if c in kept.columns]
    rest = [c for c in kept.columns if c not in ("text", "chars", "tokens", "n_after", "n_edits", "n_resplit")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(vocabulary_path)
        for batch in batches:
            out = grown(words, *(batch.column(c).to_pylist() for c in ("text", "chars", "tokens", "edits")))
            text, chars, tokens, made, resplit = zip(*out, strict=True) if out else ((),) * 5
            before = [batch.column(c).to_pylist() if c in counted else [0] * len(out) for c in ("n_edits", "n_resplit")]
            sums = [pa.array([a + b for a, b in zip(x, y, strict=True)], pa.int64()) for x, y in zip((made, resplit), before, strict=True)]
            columns = [pa.array(text, pa.string()), pa.array(chars, _INTS), pa.array(tokens, _INTS), pa.array([sum(x) for x in tokens], pa.int64()), *sums]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], names=[*rest, "text", "chars", "tokens", "n_after", "n_edits", "n_resplit"])

    ddl = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in rest) + f", {_TREE}, n_after bigint, n_edits bigint, n_resplit bigint"
    return kept.select(*rest, "text", "chars", "tokens", *counted, plain.alias("edits")).mapInArrow(run, ddl)


def count_with_edits(df: DataFrame, rounds: list, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and n_pieces of each text, and after all rounds of edits (functions of the text at that time, to a column of edits) n_after, n_edits and n_resplit. The trees are kept as a table between rounds."""
    now = trees(df, vocabulary_path, id_col, text_col)
    for edits in rounds:
        now = stored(now, "token-trees", "zstd")  # whole texts
        now = edited(now, edits(F.col("text")), vocabulary_path)
    return now.select(id_col, "n_tokens", "n_pieces", *(["n_after", "n_edits", "n_resplit"] if rounds else []))


def masks(text: Column, pattern: str, mask: str) -> Column:
    """Edits that put `mask` in place of every match of `pattern`."""
    return F.transform(located(text, pattern), lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), F.lit(mask).alias("replacement")))
