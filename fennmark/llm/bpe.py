"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A batch's texts are cut into pre-tokens; the distinct ones not met before go, as symbols, into one flat array. In each
round the rank of every adjacent pair is found by binary search over the sorted pair keys, every word merges all
occurrences of its lowest-ranked pair from left to right, and words without a ranked pair leave the array. A merged
symbol only ever takes part in merges of a later rank, so rounds by rank give what a merge queue gives.

Defined cases: a null text is empty and has no tokens; the strings of added tokens inside a text are those tokens;
texts of any length are taken whole; rows are independent, so repeated rows give repeated results; an empty table
gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import limit_batches

#: Fixed value: the pattern of byte-level pre-tokenisation, with white space by its Unicode property.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A task keeps the tokens of so many pre-tokens at most.
MOST_KEPT = 300_000
#: Characters that are split into pieces at once; a longer text is split by itself.
SLICE = 1 << 20
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next free one from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def _check(spec: dict, path: str) -> None:
    """Raise on settings that this encoder would not follow."""
    model, pre, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    odd = {
        "model.type": model.get("type", "BPE") != "BPE", "model.ignore_merges": model.get("ignore_merges"), "model.dropout": model.get("dropout"), "model.byte_fallback": model.get("byte_fallback"),
        "model.continuing_subword_prefix": model.get("continuing_subword_prefix"), "model.end_of_word_suffix": model.get("end_of_word_suffix"), "normalizer": spec.get("normalizer"),
        "pre_tokenizer": pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True), "decoder": decoder.get("type") != "ByteLevel",
        "added_tokens": any(x.get(k) for x in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")),
    }
    found = [k for k, v in odd.items() if v]
    if found:
        raise ValueError(f"{path}: not supported: {', '.join(found)}")


class Vocabulary:
    """A tokenizer file's merges as sorted arrays, its tokens as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec, path)
        ids: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {x: b for b, x in enumerate(letters)}
        as_bytes = lambda s: bytes(of_letter[x] for x in s) if all(x in of_letter for x in s) else s.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.of_byte = np.array([ids[x] for x in letters], np.int64)
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.tokens = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for s, i in {**ids, **added}.items():
            self.tokens[i] = as_bytes(s)
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.added = added
        self._split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._pre_tokens = regex.compile(PRE_TOKEN)
        self._kept: dict[str, tuple[int, ...]] = {}

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of each word."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank = np.full(len(symbol), _NONE, np.int32)
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            found = np.flatnonzero((self.pair_keys[at] == key) & (word[:-1] == word[1:]))
            rank[found] = self.pair_ranks[at[found]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbol)]))
            going = lowest != _NONE
            chosen = np.flatnonzero(going & (rank == lowest))
            if len(chosen):  # in a run of overlapping occurrences every other one is merged, from the left
                first = np.r_[True, np.diff(chosen) != 1]
                run = chosen[first][np.cumsum(first) - 1]
                chosen = chosen[(chosen - run) % 2 == 0]
                symbol[chosen] = self.merged[rank[chosen]]
            keep = np.ones(len(symbol), bool)
            keep[chosen + 1] = False
            ended = keep & ~going
            done.append((word[ended], symbol[ended]))
            keep &= going
            symbol, word = symbol[keep], word[keep]
        of, out = (np.concatenate(x) if done else np.zeros(0, np.int64) for x in (list(zip(*done, strict=True)) or [[], []]))
        order = np.argsort(of, kind="stable")
        flat, ends = out[order].tolist(), np.cumsum(np.bincount(of, minlength=len(words))).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def pieces(self, text: str) -> list[str]:
        if self._split_added is None or not any(x in text for x in self.added):
            return self._pre_tokens.findall(text)
        return list(chain.from_iterable([x] if x in self.added else self._pre_tokens.findall(x) for x in self._split_added.split(text)))

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text. Texts are split in slices, as their pieces take some ten times their room."""
        at = 0
        while at < len(texts):
            size, end = len(texts[at]), at + 1
            while end < len(texts) and size + len(texts[end]) <= SLICE:
                size, end = size + len(texts[end]), end + 1
            pieces = [self.pieces(t) for t in texts[at:end]]
            kept = self.learnt(set().union(*pieces))
            for x in pieces:
                yield list(chain.from_iterable(map(kept.__getitem__, x)))
            at = end

    def learnt(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """The tokens of these pre-tokens at least, from what is kept of earlier batches and a merge of the new ones."""
        kept = self._kept
        if len(kept) > MOST_KEPT:
            kept.clear()
        kept.update({x: (i,) for x, i in self.added.items()})
        new = [x for x in pieces if x not in kept]
        kept.update(zip(new, self.merge([x.encode("utf-8", "surrogatepass") for x in new]), strict=True))
        return kept

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_documents(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, as asked for, the ids and the decoded text. No shuffle."""
    limit_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for batch in batches:
            n, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
            for ids in v.encode_batch(batch.column(1).to_pylist()):
                raw = v.decode_bytes(ids)
                text = raw.decode("utf-8", "replace")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(v.decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                if with_text:
                    decoded.append(text)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            columns += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids + [pa.array(decoded, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_text)

    return df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, ddl)
