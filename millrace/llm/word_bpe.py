"""Word BPE by words and pieces: a tokenizer file's own model, asked once for each distinct piece.

No piece of such a file crosses white space, so a text's ids are those of its words one after another. Words
are hashed straight from Arrow buffers and looked up in a table; only words that are new to a worker become
strings. The file's normaliser and splitter (composition, lower case, contractions, letter runs, single
digits, other runs; white space goes) are done here, and the ids of a piece are looked up in a memory that
the library's model fills. A word with a special token or with characters that were assigned or reclassified
after Unicode 3.2, where two Unicode tables might differ, is encoded by the library as a whole. With another
normaliser, splitter or model in the file, whole texts always are.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from millrace.llm.words import hash_spans, text_buffer

#: Distinct words and pieces that a worker remembers (it then begins anew); results do not depend on them.
WORDS, MEMORY = 2_000_000, 300_000
#: Pieces that are held as strings at a time, and characters of a text that are split at a time.
PIECES, PART = 1 << 20, 1 << 20
#: What a tokenizer file must hold for texts to be split here.
_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = r"\t-\r \x85\xa0  -     　"


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """The splitter over explicit classes, and a character that is not surely the same in all Unicode tables."""
    old = unicodedata.ucd_3_2_0
    kinds: dict[str, list[list[int]]] = {"L": [], "N": [], "other": []}
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        category = unicodedata.category(c)
        if i >= 128 and (category != old.category(c) or category in ("Cn", "Cs", "Co")):
            continue
        runs = kinds[category[0] if category[0] in "LN" else "other"]
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    letters, digits, stable = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) for runs in (kinds["L"], kinds["N"], [x for k in kinds.values() for x in k]))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{_SPACE}{letters}{digits}]+"), re.compile(f"[^{stable}]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Table:
    """Numbers by 64-bit hash, open addressing."""

    def __init__(self, bits: int = 16):
        self.used, self.shift, self.mask = 0, np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(hashes, np.uint64(1)), (hashes >> self.shift).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for strangers."""
        keys, slot = self._slots(hashes)
        out = np.full(len(hashes), -1, np.int32)
        open_ = np.arange(len(hashes))
        while len(open_):
            held = self.keys[slot]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (held != 0)
            open_, slot = open_[on], (slot[on] + 1) & self.mask
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct hashes that are not in the table yet; it stays at most half full."""
        if 2 * (self.used + len(hashes)) > len(self.keys):
            held = self.keys != 0
            keys, values = self.keys[held], self.values[held]
            self.__init__(int(4 * (len(keys) + len(hashes))).bit_length())
            self.add(keys, values)
        self.used += len(hashes)
        keys, slot = self._slots(hashes)
        while len(keys):
            empty = self.keys[slot] == 0
            self.keys[slot[empty]] = keys[empty]
            mine = empty & (self.keys[slot] == keys)
            self.values[slot[mine]] = numbers[mine]
            keys, numbers, slot = keys[~mine], numbers[~mine], (slot[~mine] + 1) & self.mask


def _parts(text: str) -> Iterator[str]:
    """The text in parts that begin at spaces, which no piece and no composition crosses."""
    start = 0
    while len(text) - start > PART and (stop := text.find(" ", start + PART)) > 0:
        yield text[start:stop]
        start = stop
    yield text[start:]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        split = told["pre_tokenizer"].get("pretokenizers", [{}])
        self.known = (
            (told["normalizer"] or {}).get("normalizers") == _NORMALISER and told["model"]["type"] == "BPE" and not told["model"].get("dropout") and not told["truncation"] and len(split) == 2
            and split[0] == {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
            and (split[1]["type"], split[1]["add_prefix_space"], split[1]["use_regex"]) == ("ByteLevel", False, False)
        )
        self.special = [t["content"] for t in told["added_tokens"]]
        self.begins = os.path.commonprefix(self.special)
        self.split, self.odd = _patterns()
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.stop = 0

    def begin(self, end: int) -> None:
        """A table of words that knows only `end`, as word 0."""
        self.table, self.end = Table(), end
        self.words, self.word_ids, self.word_ends = 1, np.full(1 << 16, end, np.uint32), np.array([0, 1])

    def encode_column(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, for a string column; null is an empty text."""
        if not self.known:
            return self.encode([t or "" for t in column.to_pylist()], end)
        if getattr(self, "end", None) != end or self.words > WORDS:
            self.begin(end)
        data, at = text_buffer(column)
        hashes, first, start, stop = hash_spans(data, at)
        number = self.table.find(hashes)
        if (number < 0).any():
            new, index = np.unique(hashes[number < 0], return_index=True)
            index = np.flatnonzero(number < 0)[index]
            raw = data.tobytes() if len(index) > 64 else None
            spans = zip(start[index].tolist(), stop[index].tolist(), strict=True)
            ids, counts = self.encode([(raw[a:b] if raw else data[a:b].tobytes()).decode() for a, b in spans], end)
            ends = np.cumsum(counts)
            keep = np.ones(len(ids), bool)
            keep[ends - 1] = False
            old = int(self.word_ends[-1])
            ids = ids[keep]
            if old + len(ids) > len(self.word_ids):
                self.word_ids = np.resize(self.word_ids, 2 * (old + len(ids)))
            self.word_ids[old : old + len(ids)] = ids
            self.word_ends = np.concatenate((self.word_ends, old + ends - np.arange(1, len(ends) + 1)))
            self.table.add(new, np.arange(self.words, self.words + len(new), dtype=np.int32))
            self.words += len(new)
            number = self.table.find(hashes)
        number = np.insert(number, first[1:], 0)
        begins, lengths = self.word_ends[number], self.word_ends[number + 1] - self.word_ends[number]
        ends = np.cumsum(lengths)
        ids = self.word_ids[np.repeat(begins - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.diff(ends[first[1:] + np.arange(len(first) - 1)], prepend=0)

    def plain(self, text: str) -> bool:
        return self.known and (text.isascii() or not self.odd.search(text)) and not (self.begins in text and any(t in text for t in self.special))

    def _learn(self, pieces: set[str]) -> None:
        ends, found, tokenize = [], [], self.library.model.tokenize
        for piece in pieces:
            plain = piece.isascii() and piece.isprintable()
            ids = [t.id for t in tokenize(piece if plain else "".join(map(self.letters.__getitem__, piece.encode())))]
            found += ids
            ends.append(len(found))
        n = len(self.number)
        for name, need in (("flat", self.stop + len(found)), ("ends", n + len(ends) + 1)):
            if need > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * need))
        self.flat[self.stop : self.stop + len(found)] = found
        self.ends[n + 1 : n + 1 + len(ends)] = self.stop + np.array(ends, np.int64)
        self.ends[0] = 0
        self.stop += len(found)
        self.number.update(zip(pieces, range(n, n + len(ends)), strict=True))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        if new := set(pieces).difference(self.number):
            self._learn(new)
        return np.fromiter(map(self.number.__getitem__, pieces), np.int32, len(pieces))

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, `end` behind each, and the number of each one's ids."""
        pieces: list[str] = []
        parts, seen, stops, whole = [], 0, [], {}
        for i, text in enumerate(texts):
            # A word of letters is a piece.
            if text.isascii() and text.isalpha() and self.known:
                pieces.append(text.lower())
                seen += 1
            elif self.plain(text):
                for part in _parts(text):
                    if not part.isascii():
                        part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                    found = self.split.findall(part.lower())
                    pieces += found
                    seen += len(found)
                    if len(pieces) > PIECES:
                        parts.append(self._numbers(pieces))
                        pieces = []
            else:
                whole[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
            stops.append(seen)
        parts.append(self._numbers(pieces))
        at = np.concatenate(parts)
        starts, lengths = self.ends[at], self.ends[at + 1] - self.ends[at]
        begins = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.flat[np.arange(begins[-1]) + np.repeat(starts - begins[:-1], lengths)]
        per = np.diff(begins[np.array([0, *stops])])
        # The end ids, and the texts that the library encoded, go between.
        for i in whole:
            per[i] = len(whole[i])
        counts = per + 1
        out = np.full(int(counts.sum()), end, np.uint32)
        stop = np.cumsum(counts)
        mine = np.ones(len(out), bool)
        mine[stop - 1] = False
        for i, found in whole.items():
            out[stop[i] - counts[i] : stop[i] - 1] = found
            mine[stop[i] - counts[i] : stop[i] - 1] = False
        out[mine] = ids
        if len(self.number) > MEMORY:
            self.forget()
        return out, counts
