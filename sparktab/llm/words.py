"""Texts as arrays of words for the tokenizer operators.

A word is what the tokenizer's own splitting pattern finds in normalized text. Words are found, hashed
and made unique in numpy, so whatever is costly is done once for each different word.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from tokenizers import Regex, normalizers, pre_tokenizers

from sparktab.llm.common import mixed, ragged, run_starts

SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)
UNICODE, LETTERS = 0x110000, 0x40000


@dataclass(frozen=True)
class Characters:
    """What the tokenizers library makes of each code point, as short arrays."""

    kind_from: np.ndarray
    kinds: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    #: Code points that become several.
    long: dict[str, str]
    compose_from: np.ndarray
    compose: np.ndarray


@lru_cache
def character_kinds() -> Characters:
    """Kinds and lower-case forms, asked of the library, whose Unicode version may differ from Python's.

    ``compose`` marks code points that composition (NFC) may change or join to others, in any
    version: texts with such a one are normalized by the library itself.
    """
    kind = np.full(UNICODE, OTHER, np.uint8)
    # Surrogates can't occur in a text, so a space stands for them.
    # All that follows the last plane with letters is private, unassigned or a tag: other characters.
    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, LETTERS)))
    for pattern, value in ((r"\s+", SPACE), (r"[\p{L}]+", LETTER), (r"[\p{N}]+", NUMBER)):
        split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for _, (start, stop) in split.pre_tokenize_str(every):
            kind[start:stop] = value
    parts = [c for c in every if c != "\n"]
    lowered = normalizers.Lowercase().normalize_str("\n".join(parts)).split("\n")
    changed = {c: x for c, x in zip(parts, lowered, strict=True) if c != x}
    one = {ord(c): ord(x) for c, x in changed.items() if len(x) == 1}
    first = np.flatnonzero(run_starts(kind))
    flags = _composing(every)
    flags_from = np.flatnonzero(run_starts(flags))
    return Characters(
        first, kind[first], np.array(list(one), np.uint32), np.array(list(one.values()), np.uint32),
        {c: x for c, x in changed.items() if len(x) != 1}, flags_from, flags[flags_from],
    )


def _composing(every: str) -> np.ndarray:
    """True for marks, code points that a composition may take in, and those that Python doesn't know."""
    flags = np.zeros(UNICODE, bool)
    seconds = set()
    for i, c in enumerate(every):
        kind = unicodedata.category(c)
        flags[i] = kind in ("Cn", "Mn", "Mc", "Me") or bool(unicodedata.combining(c))
        split = unicodedata.decomposition(c)
        if split and split[0] != "<":
            seconds.add(int(split.split()[-1], 16))
            flags[i] |= unicodedata.normalize("NFC", c) != c
    flags[LETTERS:0xF0000] = True
    flags[list(seconds)] = True
    # Vowels and final consonants of composed Korean syllables (fixed values).
    flags[0x1161:0x1176] = flags[0x11A8:0x11C3] = True
    # A letter that is only the second part by name may be very common.
    flags[:0x300] = False
    return flags


class Splitter:
    """Normalization and splitting of the word-level BPE files.

    Normalization composes characters (NFC) and lower-cases them one by one, both as the library has them. Words are contractions,
    runs of letters, single digits, and runs of other characters; white space is dropped. Strings of
    special tokens are cut out before anything else. ``kinds`` is what ``character_kinds`` gives.
    """

    def __init__(self, specials: list[str], kinds: Characters) -> None:
        self.specials = specials
        self.cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.kind = np.repeat(kinds.kinds, np.diff(np.append(kinds.kind_from, UNICODE)))
        self.kind = np.append(self.kind, np.full(len(specials), SPECIAL, np.uint8))
        self.lower = np.arange(UNICODE, dtype=np.uint32)
        self.lower[kinds.upper] = kinds.lower
        self.long = kinds.long
        self.compose = np.repeat(kinds.compose, np.diff(np.append(kinds.compose_from, UNICODE)))
        self.nfc = normalizers.NFC()
        # What may follow an apostrophe in a contraction (fixed values of the pattern).
        self.tails = {1: ["s", "t", "m", "d"], 2: ["re", "ve", "ll"]}

    def normal(self, text: str) -> np.ndarray:
        """Code points of a text in normal form, lower-cased one by one as the library does."""
        if text.isascii():
            return np.frombuffer(text.lower().encode("ascii"), np.uint8).astype(np.uint32)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if self.compose[points].any():
            text = self.nfc.normalize_str(text)
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        for c, parts in self.long.items():
            if c in text:
                text = text.replace(c, parts)
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return self.lower[points]

    def code_points(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all normalized texts, a space after each, and the texts' offsets."""
        parts, sizes = [], np.zeros(len(texts) + 1, np.int64)
        space = np.array([32], np.uint32)
        for i, text in enumerate(texts):
            pieces = self.cut.split(text) if self.cut and "<" in text else [text]
            found = [
                np.array([UNICODE + self.specials.index(p)], np.uint32) if p in self.specials else self.normal(p) for p in pieces
            ]
            parts += [*found, space]
            sizes[i + 1] = sum(map(len, found)) + 1
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.cumsum(sizes)

    def split(self, texts: list[str]) -> Words:
        points, offsets = self.code_points(texts)
        n = len(points)
        kind = self.kind[points]
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (kind[1:] == SPECIAL)
        start &= kind != SPACE
        # An apostrophe that begins a match takes the tail of a contraction with it.
        marks = np.flatnonzero(points == ord("'"))
        marks = marks[(marks == 0) | (kind[marks - 1] != OTHER)]
        for size, tails in self.tails.items():
            for tail in tails:
                at = marks[marks + size < n]
                for j, c in enumerate(tail, 1):
                    at = at[points[at + j] == ord(c)]
                start[at + 1] = False
                after = at + size + 1
                after = after[after < n]
                start[after] = kind[after] != SPACE
        held = kind != SPACE
        stop = held.copy()
        stop[:-1] &= ~held[1:] | start[1:]
        starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
        return Words(points, starts, stops, np.searchsorted(starts, offsets))


class Words:
    """Words of several texts: [starts[i], stops[i]) in ``points``; text t has words bounds[t] to bounds[t + 1]."""

    def __init__(self, points, starts, stops, bounds) -> None:
        self.points, self.starts, self.stops, self.bounds = points, starts, stops, bounds
        self.place = None

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.stops - self.starts
        if self.place is None:
            begin = np.zeros(len(self.points), np.int64)
            begin[self.starts] = self.starts
            self.place = np.arange(len(self.points)) - np.maximum.accumulate(begin)
            # Spaces between words add nothing to the word before them.
            np.minimum(self.place, int(lengths.max()) - 1, out=self.place)
        power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15 + 2 * seed, np.uint64), dtype=np.uint64)
        codes = self.codes(seed)
        codes *= power[self.place]
        ends = np.cumsum(codes, dtype=np.uint64)
        first = np.where(self.starts > 0, ends[self.starts - 1], np.uint64(0))
        return mixed(ends[self.stops - 1] - first + lengths.astype(np.uint64))

    def codes(self, seed: int) -> np.ndarray:
        """A 64-bit code for each code point."""
        salt = np.uint64(1 + (seed << 32))
        if int(self.points.max()) < 1 << 16:
            return mixed(np.arange(1 << 16, dtype=np.uint64) + salt)[self.points]
        return mixed(self.points.astype(np.uint64) + salt)

    def spelled(self, which: np.ndarray) -> list[str | int]:
        """The named words; a special token as its number."""
        lengths = self.stops[which] - self.starts[which]
        ends = np.cumsum(lengths + 1)
        flat = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint32)
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False
        flat[inside] = self.points[ragged(self.starts[which], lengths)]
        # A word holds no space, so one stands behind each.
        special = flat >= UNICODE
        numbers = flat[special].astype(np.int64) - UNICODE
        at = np.searchsorted(ends, np.flatnonzero(special), side="right")
        flat[special] = ord("x")
        words = flat.astype("<u4").tobytes().decode("utf-32-le").split(" ")[:-1]
        for i, n in zip(at.tolist(), numbers.tolist(), strict=True):
            words[i] = n
        return words


class WordCodes:
    """Ids of words, kept over calls. ``encode`` maps a list of words to (flat ids, ids of each word).

    Words are told apart by two 64-bit hashes; should only one of them agree, the table starts again
    with other hashes. A table of more than ``most`` words is emptied to bound its memory.
    """

    def __init__(self, encode, most: int = 400_000) -> None:
        self.encode, self.most, self.seed, self.cleared = encode, most, 0, 0
        self.clear()

    def clear(self) -> None:
        self.cleared += 1
        self.keys = self.checks = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def codes(self, words: Words) -> np.ndarray:
        """Row of each word in (ids, offsets)."""
        if len(self.keys) > self.most:
            self.clear()
        while True:
            one, two = words.hashes(2 * self.seed), words.hashes(2 * self.seed + 1)
            order = np.argsort(one)
            new = run_starts(one[order])
            inverse = np.empty(len(one), np.int64)
            inverse[order] = np.cumsum(new) - 1
            first = order[new]
            key, check = one[first], two[first]
            if np.array_equal(check[inverse], two):
                at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
                known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
                if np.array_equal(self.checks[at[known]], check[known]):
                    break
            self.seed += 1
            self.clear()
        if not known.all():
            flat, lengths = self.encode(words.spelled(first[~known]))
            row = np.arange(len(lengths)) + len(self.offsets) - 1
            self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
            # Both sides are sorted, so new words go to their places without a sort of the whole.
            place = np.searchsorted(self.keys, key[~known])
            self.checks = np.insert(self.checks, place, check[~known])
            self.rows = np.insert(self.rows, place, row)
            self.keys = np.insert(self.keys, place, key[~known])
            at = np.searchsorted(self.keys, key)
        return self.rows[at][inverse]
