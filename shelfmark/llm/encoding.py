"""Token ids of whole texts with a public tokenizer file, each distinct word encoded once per task.

The library encodes about 1 MB a second and core, and most words of a corpus repeat. So a text is cut where
the tokenizer's own first step always cuts, the pieces are encoded by the library, and their
ids are kept for the next text. The ids are those of the whole text encoded at once:

* byte-level files: before a space that a non-space follows; the space always goes with what follows.
* word files (white space dropped): at spaces and line breaks.
* in both: between a run of Latin letters and an ASCII character that is no letter.
* byte-level files whose first step makes it a piece of its own: around a line break between two characters that are not white space.

Pieces that start with white space of their own, and letters outside the Latin ranges, stay uncut.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import tokenizers

from shelfmark.llm.common import kept

_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")  # without U+0130, whose lower case holds a mark
_OTHER_CASE = re.compile("[\u0130\u0250-\U0010ffff]")
_INNER_SPACE = re.compile(r" (?:\s|\Z)")
_LINE = re.compile(r"(?:(?<=[!-~])|\A)\n(?=[!-~À-ÖØ-öø-ɏ])")  # of what follows a letter
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: How byte-level files write a byte, by its Latin-1 character: printed ones as they are, the others by characters from 256 on.
_ALPHABET = {b: 256 + i for i, b in enumerate(sorted({*range(256)}.difference(_PRINTED)))}
_GENERATION = 300_000
_LONGEST_KEPT = 64


class _Kept(dict):
    """Ids by piece; at most two generations of pieces are held."""

    def __init__(self, encode):
        super().__init__()
        self._encode, self._old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self._old.get(piece)
        if ids is None:
            ids = self._encode(piece)
        if len(piece) <= _LONGEST_KEPT:
            if len(self) >= _GENERATION:
                self._old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """``encode(text)``: the ids of a text as little-endian unsigned 32-bit numbers.

    With ``special`` a special token's string in a text becomes its id, as by the library's own setting; otherwise it is ordinary text.
    """

    def __init__(self, path: str, special: bool = False):
        self._library = tokenizers.Tokenizer.from_file(path)
        self._library.encode_special_tokens = True  # their strings are cut out before; lower-casing makes no new ones
        added = {t.content: (i, t) for i, t in self._library.get_added_tokens_decoder().items() if special and t.special}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added.values()):
            raise ValueError(f"special tokens that depend on the text around them: {path}")
        self._special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._mark_ids = {c: struct.pack("<I", i) for c, (i, _) in added.items()}
        self._drops_space = self._library.normalizer is not None
        self._before = "" if self._drops_space else " "
        self._mark = "" if self._drops_space else "\u0120"  # how the byte-level alphabet writes a space
        self._raw = _Kept(self._whole)
        self._model = self._library.model
        self._core = _Kept(self._letters)
        self._first = _Kept(lambda word: self._letters(word, ""))
        self._word = _Kept(self._piece)
        step = self._library.pre_tokenizer
        self._cuts_lines = not self._drops_space and [p for p, _ in step.pre_tokenize_str("a.\nb")] == ["a", ".", "\u010a", "b"]

    def _whole(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, word: str, mark: str | None = None) -> bytes:
        mark = self._mark if mark is None else mark
        # For ASCII letters (in a word file, lower-case ones) the steps before the model change nothing but the space; byte-level
        # files write the bytes of others in their alphabet.
        if not word.isascii() and not self._drops_space:
            written = word.encode().decode("latin-1").translate(_ALPHABET)
        elif word.isascii() and (not self._drops_space or word.islower()):
            written = word
        else:
            return self._whole((self._before if mark == self._mark else "") + word)
        ids = [t.id for t in self._model.tokenize(mark + written)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        letters = _LETTERS.match(piece)
        if letters:
            rest = piece[letters.end():]
            if not rest:
                return self._core[piece]
            if rest[0].isascii():
                return self._core[letters.group()] + self._lines(rest)
        return self._whole(self._before + piece)

    def _lines(self, rest: str) -> bytes:
        """Ids of what follows a run of letters, cut around its line breaks."""
        if not self._cuts_lines or "\n" not in rest:
            return self._raw[rest]
        head, *lines = _LINE.split(rest)
        if not lines:
            return self._raw[rest]
        out = [self._raw[head]]
        for line in lines:
            out += self._raw["\n"], self._line(line)
        return b"".join(out)

    def _line(self, line: str) -> bytes:
        """Ids of a piece that no space stands before."""
        letters = _LETTERS.match(line)
        if letters:
            rest = line[letters.end():]
            if not rest:
                return self._first[line]
            if rest[0].isascii():
                return self._first[letters.group()] + self._raw[rest]
        return self._raw[line]

    def encode(self, text: str) -> bytes:
        if self._special is None:
            return self._ordinary(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            if m.start() > at:
                out.append(self._ordinary(text[at:m.start()]))
            out.append(self._mark_ids[m.group()])
            at = m.end()
        if at < len(text):
            out.append(self._ordinary(text[at:]))
        return b"".join(out)

    def _ordinary(self, text: str) -> bytes:
        if self._drops_space:
            if text.isascii() or not _OTHER_CASE.search(text):
                text = text.lower()  # as the file's own normalizer does; more pieces are then the same
            return b"".join(map(self._word.__getitem__, filter(None, text.replace("\n", " ").split(" "))))
        first, *rest = text.split(" ")
        if not _INNER_SPACE.search(text):
            return self._raw[first] + b"".join(map(self._word.__getitem__, rest))
        out, piece, plain = [], first, False
        for part in rest:
            if part and not part[0].isspace():
                out.append(self._word[piece] if plain else self._raw[piece])
                piece, plain = part, True
            else:
                piece, plain = (" " + piece if plain else piece) + " " + part, False
        out.append(self._word[piece] if plain else self._raw[piece])
        return b"".join(out)


def encoder(path: str, special: bool = False) -> Encoder:
    """One encoder per file, setting and Python worker, kept from task to task."""
    return kept((path, special), lambda: Encoder(path, special))
