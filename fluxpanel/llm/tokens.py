"""Token ids of whole texts by the ``tokenizers`` library, with its answers for the units of a text kept.

A text is cut into units where the tokenizer's own pre-tokenizer always starts anew: around white space and between a
letter and another character, but never beside an apostrophe (contractions) or a character whose class is not plainly
known here (ASCII without U+001C..U+001F, and the letters U+00C0..U+00FF). The string of an added token (<|endoftext|>) is
a unit of its own, as the library takes it out of a text first. The library encodes each distinct unit once
for a worker, and ids of whole texts are gathered by array work. Units are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from . import kernel as K

#: Bytes of units and their ids that a worker keeps; beyond them it starts anew.
KEPT_BYTES = 48 << 20
SLICE = 1 << 20
UNKNOWN, LETTER, OTHER, WHITE, QUOTE = range(5)
CLASS = np.full(256, UNKNOWN, np.int8)
CLASS[:128] = [LETTER if chr(b).isalpha() else OTHER for b in range(128)]
CLASS[0x1C:0x20] = UNKNOWN
CLASS[K.SPACE] = WHITE
CLASS[ord("'")] = QUOTE
#: Whether to cut between two classes. A byte-level tokenizer keeps white space with what follows it.
CUT = {"spaces": np.zeros(25, bool), "words": np.zeros(25, bool), "whole": np.zeros(25, bool)}
for _kind in ("spaces", "words"):
    for _a, _b in ((LETTER, WHITE), (OTHER, WHITE), (QUOTE, WHITE), (LETTER, OTHER), (OTHER, LETTER)):
        CUT[_kind][_a * 5 + _b] = True
for _b in (LETTER, OTHER, QUOTE):
    CUT["words"][WHITE * 5 + _b] = True


def _byte_names() -> dict[int, int]:
    """Byte -> the character that stands for it in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = {}, 256
    for b in range(256):
        out[b] = b if b in plain else more
        more += b not in plain
    return out


NAMES = _byte_names()


class Encoder:
    """kind: "spaces" (byte-level, keeps spaces), "words" (byte-level with word ends, lower-cases, drops white space) or "whole" (no cuts)."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that are not plain strings of the text are not supported")
        names = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.kind = kind
        self._forget()

    def _forget(self) -> None:
        self.keys, self.types = np.zeros(0, K.U64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _ids(self, unit: bytes, letters: bool) -> list[int]:
        if letters:  # one pre-token: straight to the library's model
            word = unit.decode().lower().encode() if self.kind == "words" else unit
            return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(NAMES))]
        return self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids

    def _learn(self, keys: np.ndarray, units: list[bytes], letters: list[bool]) -> np.ndarray:
        """Types of new keys (ascending)."""
        found = [self._ids(u, x) for u, x in zip(units, letters, strict=True)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        total, new = int(n.sum()), np.arange(self.count, self.count + len(found))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(found) > len(self.begin):
            self.begin, self.length = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.length, np.zeros_like(self.length)])
        self.begin[new], self.length[new] = self.used + np.cumsum(n) - n, n
        self.flat[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.uint32, total)
        self.used, self.count = self.used + total, self.count + len(found)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.types = np.insert(self.keys, at, keys), np.insert(self.types, at, new)
        return new

    def encode(self, col: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); ``end`` is appended to each text. Null is empty."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for _, n, data, at in K.slices(K.texts(col), SLICE):
            if 32 * self.count + 4 * self.used > KEPT_BYTES:
                self._forget()
            out, edges = self._slice(data, at)
            if end is not None:
                out, edges = np.insert(out, edges[1:], end), edges + np.arange(n + 1)
            ids.append(out)
            counts.append(np.diff(edges))
        return np.concatenate(ids), np.concatenate(counts)

    def _added(self, raw: bytes, at: np.ndarray) -> list[tuple[int, int]]:
        """Spans of the added tokens' strings that lie within one text."""
        found, pos = [], 0
        while self.added and (m := self.added.search(raw, pos)):
            s, e = m.span()
            whole = np.searchsorted(at, s, "right") == np.searchsorted(at, e, "left")
            if whole:
                found.append((s, e))
            pos = e if whole else s + 1
        return found

    def _slice(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        cls = CLASS[data]
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        cls[lead] = cls[lead + 1] = LETTER
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = CUT[self.kind][cls[:-1] * np.int8(5) + cls[1:]]
        cut[at] = True
        raw, own = data.tobytes(), np.zeros(len(data), bool)
        for s, e in self._added(raw, at):
            cut[s : e + 1], own[s] = False, True
            cut[[s, e]] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        if self.kind == "words":
            full = (cls[starts] != WHITE) | (ends - starts > 1)
            starts, ends = starts[full], ends[full]
        key = K.span_hashes(data, starts, ends, lower=self.kind == "words")
        key = np.where(own[starts], K.mix(key), key)  # the same letters in another case are no added token
        uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        types = np.full(len(uniq), -1)
        if len(self.keys):
            pos = np.minimum(np.searchsorted(self.keys, uniq), len(self.keys) - 1)
            types = np.where(self.keys[pos] == uniq, self.types[pos], -1)
        new = np.flatnonzero(types < 0)
        if len(new):
            s, e = starts[first[new]], ends[first[new]]
            letters = np.concatenate([[0], np.cumsum(cls == LETTER)])
            pure = letters[e] - letters[s] == e - s
            if self.kind == "spaces":
                pure |= (data[s] == 32) & (e - s > 1) & (letters[e] - letters[s] == e - s - 1)
            types[new] = self._learn(uniq[new], [raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)], (pure & ~own[s]).tolist())
        kind = types[inverse]
        length = self.length[kind]
        total = np.concatenate([[0], np.cumsum(length)])
        out = self.flat[np.repeat(self.begin[kind] - total[:-1], length) + np.arange(total[-1])]
        return out, total[np.searchsorted(starts, at)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder for a worker process."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
