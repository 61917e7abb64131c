"""Token ids of whole texts with a public tokenizer file, remembered per part of a text.

Both tokenizers cut a text before they look up ids, and never across a space that follows
something other than white space. So a text can be cut there. A piece of common letters, digits,
signs and line ends is cut again into runs of each kind, as both tokenizers do; any other piece
stays whole. Each distinct part goes through the ``tokenizers`` library once in a worker's memory;
the ids are those of the whole text. A run of letters is one word to the tokenizer, so it goes to
the library's normaliser and model without the cutting in between.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PARTS = 600_000  # in the memory of a worker

# A space that does not follow a plain character: there the text stays in one piece.
_NOT_PLAIN = "\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u206f\u2e80-\u303f\ufe00-\ufe0f\ufeff"
_CUT = re.compile(f"(?<=[^{_NOT_PLAIN}])(?= )")
# Bytes that only plain characters and line ends have.
_PLAIN_BYTES = bytes(b for b in range(256) if b == 10 or 32 <= b < 127
                     or b > 127 and b not in (0xC2, 0xE1, 0xE2, 0xE3, 0xEF))

# Letters that are one character in every normal form used here, in upper and lower case, and
# signs without the apostrophe, which joins letters, and the start of special tokens.
_LETTERS = ("A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e"
            "\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0400-\u045f")
_SIGNS = r"!-&(-/:;=-@\[-`{-~"
_LETTER_BYTES = (r"[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbe]"
                 r"|\xce[\x91-\xa1\xa3-\xa9\xb1-\xbf]|\xcf[\x80-\x89]|\xd0[\x80-\xbf]|\xd1[\x80-\x9f]")
_SIMPLE = f"(?:{_LETTER_BYTES}|[0-9]|[{_SIGNS}])+"
_SIMPLE_PIECE = f"^ ?{_SIMPLE}(?:\\n{_SIMPLE})*$"
_BORDER = "\x00"  # before each piece; no simple piece has it
_WHOLE = 2 * _BORDER  # before a part that is a piece of another kind

# Byte-level models write a byte that has no visible sign of its own as one from U+0100 on.
_HIDDEN = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b > 173)]
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(_HIDDEN)}


def is_plain(text: bytes) -> bool:
    """Whether every space of a text surely follows a plain character."""
    return not (text[:1] == b" " or b"  " in text or b"\n " in text
                or text.translate(None, _PLAIN_BYTES))


class _Slots(dict):
    """Numbers of parts in the order in which they were first met."""

    def __init__(self):
        super().__init__({_BORDER: 0})
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        slot = self[part] = len(self)
        self.new.append(part)
        return slot


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``values[start:start + count]``, one after the other."""
    return values[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]


def _joined(lead: bytes, pieces: pa.Array) -> bytes:
    """All pieces in one, each after ``lead``."""
    if not len(pieces):
        return b""
    together = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
    return lead + pc.binary_join(together, lead)[0].as_py()


def _byte_letters(word: str) -> str:
    """A word as a byte-level model takes it."""
    if word.isascii():  # letters, and a blank in front
        return word.replace(" ", "\u0120")
    return word.encode().decode("latin-1").translate(_BYTE_LETTERS)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._normalizer = self._tokenizer.model, self._tokenizer.normalizer
        added = self._tokenizer.get_added_tokens_decoder()
        self._mark, self._mark_id = max((token.content, at) for at, token in added.items())
        self._cuts_parts = all(token.content[:1] == "<" for token in added.values())
        space = " ?" if self._ids(" a") != self._ids("a") else ""
        self._parts = re.compile(f"{space}[{_LETTERS}]+|{space}[0-9]+|{space}[{_SIGNS}]+|\n|{_BORDER}")
        self._word = re.compile(f"{space}[{_LETTERS}]+")
        self._cuts_parts &= not (space and self._normalizer)
        self._forget()
        self._cuts_parts &= self._cuts_agree()

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _cuts_agree(self) -> bool:
        """Whether the cut into parts gives this tokenizer's ids; else pieces stay whole."""
        text = "Ab,cd 12x\xc9t\xe9ŠΣ a_b3.\nC-d Жз(9)[ef]"
        return self._cuts_parts and self.encode([text.encode()]) == [
            np.array(self._ids(text), "<u4").tobytes()]

    def _forget(self) -> None:
        self._slots = _Slots()
        self._values = np.zeros(0, "<u4")  # ids of all parts by slot
        self._ends = np.zeros(1, np.int64)  # slot 0 has none

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self._slots) > CACHE_PARTS:
            self._forget()
        plain = [is_plain(text) for text in texts]
        order = np.argsort(~np.array(plain, bool), kind="stable")
        words = pc.split_pattern(pa.array([t for t, ok in zip(texts, plain) if ok], pa.binary()), b" ")
        coded = words.flatten().dictionary_encode()
        # Pieces that follow a space stand without it in ``coded``, the others as they are.
        own: dict[bytes, int] = {}
        number = lambda piece: own.setdefault(piece, len(own))
        starts = words.offsets.to_numpy()[:-1]
        firsts = [number(t.partition(b" ")[0]) for t, ok in zip(texts, plain) if ok]
        whole = [[number(part.encode()) for part in _CUT.split(text.decode("utf-8", "replace"))]
                 for text, ok in zip(texts, plain) if not ok]
        known = len(coded.dictionary)
        pieces = np.concatenate([coded.indices.to_numpy(), np.array(
            [code for codes in whole for code in codes], np.int64) + known])
        pieces[starts] = np.array(firsts, np.int64) + known
        values, at, counts = self._pieces(coded.dictionary, pa.array(list(own), pa.binary()))
        sizes = counts[pieces]
        data = _gather(values, at[pieces], sizes).tobytes()
        borders = np.cumsum([0, *pc.list_value_length(words).to_pylist(), *map(len, whole)])
        ends = (4 * np.concatenate([[0], np.cumsum(sizes)])[borders]).tolist()
        out = [b""] * len(texts)
        for text, start, end in zip(order.tolist(), ends, ends[1:]):
            out[text] = data[start:end]
        return out

    def _pieces(self, later: pa.Array, own: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, and where each piece's begin and how many they are."""
        simple = [pc.match_substring_regex(some, _SIMPLE_PIECE) if self._cuts_parts
                  else pa.array([False] * len(some), pa.bool_()) for some in (later, own)]
        parts: list[str] = []
        for some, chosen, lead in zip((later, own), simple, (b" ", b"")):
            parts += self._parts.findall(_joined(_BORDER.encode() + lead, some.filter(chosen)).decode())
        for some, chosen, lead in zip((later, own), simple, (" ", "")):
            for piece in some.filter(pc.invert(chosen)).to_pylist():
                parts += (_BORDER, _WHOLE + lead + piece.decode("utf-8", "replace"))
        slots = np.fromiter(map(self._slots.__getitem__, parts), np.int64, len(parts))
        if self._slots.new:
            self._learn(self._slots.new)
            self._slots.new = []
        first = np.concatenate([[0], self._ends[:-1]])
        sizes = (self._ends - first)[slots]
        values = _gather(self._values, first[slots], sizes)
        starts = (np.cumsum(sizes) - sizes)[slots == 0]
        counts = np.diff(np.append(starts, len(values)))
        chosen = np.concatenate([c.to_numpy(zero_copy_only=False) for c in simple])
        place = np.empty(len(chosen), np.int64)  # simple pieces stand before the others
        place[np.concatenate([np.flatnonzero(chosen), np.flatnonzero(~chosen)])] = np.arange(len(chosen))
        return values, starts[place], counts[place]

    def _learn(self, parts: list[str]) -> None:
        """Add the ids of new parts in their order."""
        is_word = np.array([self._word.fullmatch(part) is not None for part in parts], bool)
        values, counts = zip(
            self._word_ids([part for part, word in zip(parts, is_word.tolist()) if word]),
            self._other_ids([part.removeprefix(_WHOLE)
                             for part, word in zip(parts, is_word.tolist()) if not word]))
        values, found = np.concatenate(values), np.concatenate(counts)
        place = np.argsort(~is_word, kind="stable")  # words come first in ``found``
        counts, starts = np.empty_like(found), np.empty_like(found)
        counts[place], starts[place] = found, np.cumsum(found) - found
        self._ends = np.concatenate([self._ends, np.cumsum(counts) + len(self._values)])
        self._values = np.concatenate([self._values, _gather(values, starts, counts)])

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of runs of letters, which the model takes as they are."""
        codes = np.arange(len(words))
        if self._normalizer is not None and words:
            # A blank between two words keeps them apart in every normal form.
            words = self._normalizer.normalize_str(" ".join(words)).split(" ")
            distinct = {word: at for at, word in enumerate(dict.fromkeys(words))}
            codes = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
            words = list(distinct)
        tokenize, ids, ends = self._model.tokenize, [], [0]
        for word in words:
            ids += [token.id for token in tokenize(_byte_letters(word))]
            ends.append(len(ids))
        counts = np.diff(np.array(ends, np.int64))
        starts = np.array(ends[:-1], np.int64)[codes]
        return _gather(np.array(ids, "<u4"), starts, counts[codes]), counts[codes]

    def _other_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts from few calls of the library, set apart by a special token that cuts
        the text."""
        found: list[list[int]] = [[]] * len(parts)
        joined = [at for at, part in enumerate(parts) if "<|" not in part]
        for start in range(0, len(joined), 256):
            some = joined[start:start + 256]
            ids = np.array(self._ids("".join(parts[at] + self._mark for at in some)), np.int64)
            ends = np.flatnonzero(ids == self._mark_id).tolist()
            for at, first, end in zip(some, [-1, *ends[:-1]], ends, strict=True):
                found[at] = ids[first + 1:end].tolist()
        for at, part in enumerate(parts):
            if "<|" in part:
                found[at] = self._ids(part)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(counts.sum())), counts


def encoder(path: str) -> Callable[[], Encoder]:
    """One encoder per worker process and file, made where the task runs."""
    def get() -> Encoder:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    return get


_ENCODERS: dict[str, Encoder] = {}


def public_file(name: str) -> str:
    """Place of one of the installed public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path(name)
