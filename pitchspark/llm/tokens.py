"""Token ids of whole texts by a file of the ``tokenizers`` library, with a cache of pieces.

Byte-pair tokenizers cut a text into pieces by a pattern and then encode each piece for itself. For
the two patterns known here, texts of ASCII and Latin letters are cut by an equal pattern of Python's
own, so that the library's model is asked for each different piece once and its ids are kept.
Whether that gives the same ids is tried when a tokenizer is loaded. Other texts, those that hold a
special token and other tokenizers' are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import random
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np

# Pieces that one Python worker keeps: about 80 MB. The frequent ones come early, so what comes when
# the cache is full is encoded where it is met; after REFRESH times as many it is filled anew.
CACHED_PARTS = 300_000
REFRESH = 20
# Characters that are encoded at a time.
CHUNK_CHARS = 1_000_000
# The letters and the white space that the patterns are stated for; no other
# character of a text they cut is a letter, a digit beyond 0-9 or white space.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPACE = "\t-\r "
_ODD = re.compile(f"[^\x00-\x7f{_LETTERS}]")
# How the known tokenizers cut a text, as their files and the library state it. Letters
# are tried first here, since most pieces are words; no other alternative begins with one.
_SHORT = "'(?:[stmd]|re|ve|ll)"
_OTHER = f"[^{_SPACE}0-9{_LETTERS}]"
_BYTE_LEVEL = re.compile(
    f" ?[{_LETTERS}]+|{_SHORT}| ?[0-9]+| ?{_OTHER}+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_WORDS = re.compile(f"[{_LETTERS}]+|{_SHORT}|[0-9]|{_OTHER}+")
_WORDS_STATED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# A space that no pattern looks across.
_CUT = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")


def _pattern_of(spec: dict) -> tuple[re.Pattern, bool] | None:
    """The pattern that cuts texts for a tokenizer, and whether they are lower-cased before."""
    cuts, changes = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if spec["model"]["type"] != "BPE" or spec["model"].get("byte_fallback"):
        return None
    if cuts.get("type") == "ByteLevel":
        plain = cuts["use_regex"] and not cuts["add_prefix_space"] and not changes
        return (_BYTE_LEVEL, False) if plain else None
    steps = cuts.get("pretokenizers", [])
    kinds = [x["type"] for x in changes.get("normalizers", [])]
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"]:
        return None
    if steps[0]["pattern"].get("Regex") != _WORDS_STATED or set(kinds) - {"NFC", "Replace", "Lowercase"}:
        return None
    return _WORDS, "Lowercase" in kinds


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_starts = {t[0] for t in self.special}
        known = _pattern_of(spec)
        self.cut, self.lower = known or (None, False)
        self.names = self._byte_names()
        self._clear()
        if known and not self._works():
            self.cut = None
        self._clear()

    def _whole(self, text: str) -> np.ndarray:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype=np.int32)

    def _byte_names(self) -> dict[int, str]:
        """The library's names of the bytes that the letters' codes and ASCII have."""
        from tokenizers import pre_tokenizers

        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        names = {}
        for c in map(chr, range(0x100)):
            raw = c.encode()
            names |= dict(zip(raw, level.pre_tokenize_str(c)[0][0], strict=True))
        return names

    def _works(self) -> bool:
        rng = random.Random(1)
        letters = [chr(c) for c in range(0x41, 0x100) if re.match(f"[{_LETTERS}]", chr(c))]
        others = [chr(c) for c in range(0x80)]
        short = ["'s", "'LL", "'re", " '", "  ", "\n\n", " \n", "don't", "<|", "12"]
        for i in range(400):
            kinds = (letters[:52] * 2 + [" "] * 20, letters + [" "] * 20, letters + others, short + others)[i % 4]
            text = "".join(rng.choices(kinds, k=i % 23))
            if self._usual(text) and not np.array_equal(next(self.encode([text])), self._whole(text)):
                return False
        return True

    def _usual(self, text: str) -> bool:
        """Whether a text can be cut by the pattern."""
        if self.cut is None or _ODD.search(text):
            return False
        return not any(c in text for c in self.special_starts) or not any(t in text for t in self.special)

    def _clear(self) -> None:
        self.code = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)
        self.passed = 0

    def _add(self, pieces: list[str]) -> dict[str, int]:
        """Codes of different pieces not met before, which are kept if there is room. The ids of
        others stand behind those that are kept until the next call."""
        tokenize, names, found = self.model.tokenize, self.names, []
        for piece in pieces:
            if not piece.isascii() or piece[0] <= " " or not piece.isprintable():
                piece = piece.encode().decode("latin-1").translate(names)
            found.append([t.id for t in tokenize(piece)])
        n, sizes = len(self.code), np.fromiter(map(len, found), np.int64, len(found))
        used = int(self.ends[n])
        after = used + np.cumsum(sizes)
        while after[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(pieces) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used : after[-1]] = np.fromiter(chain.from_iterable(found), np.int32, int(after[-1]) - used)
        self.ends[n + 1 : n + 1 + len(pieces)] = after
        codes = dict(zip(pieces, range(n, n + len(pieces)), strict=True))
        if n < CACHED_PARTS:
            self.code |= codes
        else:
            self.passed += len(pieces)
        return codes

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the number of ids of each."""
        if self.passed > REFRESH * CACHED_PARTS:
            self._clear()
        codes = np.fromiter(map(self.code.get, pieces, repeat(-1)), np.int64, len(pieces))
        if missing := np.flatnonzero(codes < 0).tolist():
            new = [pieces[i] for i in missing]
            added = self._add(list(dict.fromkeys(new)))
            codes[missing] = np.fromiter(map(added.__getitem__, new), np.int64, len(new))
        starts = self.ends[codes]
        sizes = self.ends[codes + 1] - starts
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(starts - before, sizes) + np.arange(sizes.sum())], sizes

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; a missing text has none."""
        waiting: list[str] = []
        numbers: list[int] = []
        held = 0

        def flush():
            ids, sizes = self._pieces(waiting)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            place = 0
            for n in numbers:
                yield ids[ends[place] : ends[place + n]]
                place += n

        for text in texts:
            text = text or ""
            usual = self._usual(text)
            if not usual or len(text) > CHUNK_CHARS:
                yield from flush()
                waiting, numbers, held = [], [], 0
                yield self._long(text) if usual else self._whole(text)
                continue
            pieces = self.cut.findall(text.lower() if self.lower else text)
            waiting += pieces
            numbers.append(len(pieces))
            held += len(text)
            if held >= CHUNK_CHARS:
                yield from flush()
                waiting, numbers, held = [], [], 0
        yield from flush()

    def _long(self, text: str) -> np.ndarray:
        """Ids of a long text, cut where nothing crosses."""
        found, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + CHUNK_CHARS)
            end = cut.start() if cut else len(text)
            part = text[at:end]
            found.append(self._pieces(self.cut.findall(part.lower() if self.lower else part))[0])
            at = end
        return np.concatenate(found)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
