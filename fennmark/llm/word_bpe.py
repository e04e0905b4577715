"""BPE with word ends over whole batches of texts: each distinct stretch between white space is encoded once a batch.

Texts are cut at ASCII white space; the distinct stretches are normalised and cut into pieces, whose bytes are symbols in one flat
array, the last of a piece one that ends a word. Rounds merge the lowest-ranked pair of every piece at once. A stretch with letters
beyond the Latin blocks, or with the string of an added token, is given to the tokenizers library as it is.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .bpe import byte_letters

_NONE = np.iinfo(np.int64).max
#: Fixed value: the pieces that the vocabulary's file cuts texts into, with white space by its Unicode property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Letters up to here have one code point each and lower-case forms that need no context.
_LATIN = regex.compile("[\x00-ɏ]*")


def taken(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists that lie one after another in `flat`, those at these places, one after another, and their sizes."""
    starts, n = np.r_[0, np.cumsum(sizes)][at], sizes[at]
    return flat[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())], n


class WordVocabulary:
    """A tokenizer file with word ends, its merges as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model["continuing_subword_prefix"] or model["dropout"] or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError(f"{path}: settings that are not followed here")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        ids: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.merged = keys[self.order], np.array([ids[a + b] for a, b in pairs], np.int64)
        letters = byte_letters()
        self.of_byte, self.of_end = np.array([ids[x] for x in letters], np.int64), np.array([ids[f"{x}</w>"] for x in letters], np.int64)
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.size = 1 + max([*ids.values(), *(x["id"] for x in spec["added_tokens"])])
        self._pieces = regex.compile(PIECES)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbol, piece = self.of_byte[raw], np.repeat(np.arange(len(pieces)), sizes)
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbol[ends] = self.of_end[raw[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = [(piece[:0], symbol[:0])]
        while len(symbol):
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbol), _NONE)
            pairs = np.flatnonzero((self.keys[at] == key) & (piece[:-1] == piece[1:]))
            rank[pairs] = self.order[at[pairs]]
            new = np.r_[True, piece[1:] != piece[:-1]]
            lowest = np.minimum.reduceat(rank, np.flatnonzero(new))[np.cumsum(new) - 1]
            open_ = lowest != _NONE
            done.append((piece[~open_], symbol[~open_]))
            chosen = np.flatnonzero(open_ & (rank == lowest))
            if len(chosen):  # of overlapping occurrences every other one counts, from the left
                first = np.r_[True, np.diff(chosen) != 1]
                chosen = chosen[(np.arange(len(chosen)) - np.maximum.accumulate(np.where(first, np.arange(len(chosen)), 0))) % 2 == 0]
                symbol[chosen] = self.merged[rank[chosen]]
                open_[chosen + 1] = False
            symbol, piece = symbol[open_], piece[open_]
        of, out = (np.concatenate(x) for x in zip(*done, strict=True))
        return out[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(pieces))

    def encode_stretches(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all stretches, one after another, and how many each has."""
        index: dict[bytes, int] = {}
        pieces: list[int] = []
        n_pieces = np.zeros(len(stretches), np.int64)
        given: dict[int, list[int]] = {}
        for k, x in enumerate(stretches):
            if x.isascii() and x.isalpha():
                pieces.append(index.setdefault(x.lower().encode(), len(index)))
                n_pieces[k] = 1
            elif _LATIN.fullmatch(x) and not any(a in x for a in self.added):
                found = self._pieces.findall(x.lower())
                pieces += [index.setdefault(p.encode(), len(index)) for p in found]
                n_pieces[k] = len(found)
            else:
                given[k] = self.library.encode(x, add_special_tokens=False).ids
        ids, sizes = taken(*self.merge(list(index)), np.array(pieces, np.int64))
        counts = np.diff(np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(n_pieces)]])
        if not given:
            return ids, counts
        own = np.ones(len(stretches), bool)
        own[list(given)] = False
        counts[~own] = [len(given[k]) for k in sorted(given)]
        out, mine = np.zeros(counts.sum(), np.int64), np.repeat(own, counts)
        out[mine] = ids
        out[~mine] = [i for k in sorted(given) for i in given[k]]
        return out, counts

    def encode_column(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow column without nulls, `end_id` behind each, and how many each has."""
        listed = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(listed.offsets).astype(np.int64)
        words = listed.flatten().dictionary_encode()
        ids, counts = self.encode_stretches(words.dictionary.to_pylist())
        flat, sizes = taken(ids, counts, np.asarray(words.indices))
        n = np.diff(np.r_[0, np.cumsum(sizes)][offsets - offsets[0]])
        if end_id is None:
            return flat, n
        out = np.full(len(flat) + len(n), end_id, np.int64)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
        return out, n + 1


@lru_cache(maxsize=2)
def word_vocabulary(path: str) -> WordVocabulary:
    return WordVocabulary(path)
