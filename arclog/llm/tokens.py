"""Token ids of whole texts with the tokenizers library.

A byte-level BPE of this kind never merges across the matches of its splitting pattern, so a
text may be cut between two matches: each piece is encoded by the library, common ones once
(``Kept`` bounds their bytes), and the ids of the text are the pieces' ids put together. Cuts are
made where a match always begins:

* before a space that stands before other than white space;
* in texts without white space but spaces and line ends, no three of them together and no two
  at the end, before every space and around every line end: a run of white space gives its last
  character to what follows, so of two each is a match of its own;
* in texts in which every comma and full stop follows a letter or digit and stands before
  one, white space or the end, before those as well: they are matches of their own.

A run of Latin letters is one match too and goes to the library's model without the pattern.
The result equals encoding the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

from arclog.llm.common import Kept, of_worker

#: Bytes of pieces that a worker keeps.
KEPT_PIECES = 176 << 20

#: Letters of every Unicode version: those of ASCII, Latin-1 and Latin Extended-A and -B.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LETTERS = re.compile(f"[{LATIN}]+")

#: Commas and full stops that may be part of a longer match.
JOINED = re.compile(rf"[,.](?:(?<![0-9{LATIN}].)|(?![0-9{LATIN} \n]|\Z))", re.DOTALL)
#: White space but spaces and line ends, and what marks the cuts.
OTHER_SPACE = re.compile("[\0\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LONG_SPACE = re.compile(r"[ \n]{3}|[ \n]{2}\Z")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for
    themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class Encoder:
    """Ids as little-endian unsigned bytes of ``code`` ('H': two bytes, 'I': four)."""

    def __init__(self, path: str, code: str = "I", kept: int = KEPT_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.space = self.letters[0x20]
        self.code = code
        self.pieces = Kept(self._piece, kept)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece that begins with a match; the space before a word is its own."""
        space = piece.startswith(" ")
        word = piece[1:] if space else piece
        if word.isascii() and word.isalpha():
            return array(self.code, [t.id for t in self.tokenize(self.space + word if space else word)]).tobytes()
        head = LETTERS.match(word)
        end = head.end() if head else 0
        if end and end == len(word):
            mapped = word.encode().decode("latin-1").translate(self.letters)
            return array(self.code, [t.id for t in self.tokenize(self.space + mapped if space else mapped)]).tobytes()
        if end and word[end] < "\u0250" and not word[end].isalpha():
            return self.pieces[piece[: space + end]] + self.pieces[word[end:]]
        return self._whole(piece) if piece else b""

    def _cut(self, text: str) -> list[str]:
        """The pieces of a text; see the module's text."""
        if not OTHER_SPACE.search(text):
            lines = "\n" in text
            wide = "  " in text or lines and ("\n\n" in text or " \n" in text or "\n " in text)
            if not (wide and LONG_SPACE.search(text)):
                marked = text.replace(" ", "\0 ")
                if lines:
                    marked = marked.replace("\n", "\0\n\0")
                if not JOINED.search(text):
                    marked = marked.replace(",", "\0,").replace(".", "\0.")
                return marked.split("\0")
        first, *rest = text.split(" ")
        parts = [first]
        for word in rest:
            if not word or word[0].isspace():
                parts[-1] += " " + word
            else:
                parts.append(" " + word)
        return parts

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text."""
        ids = self.pieces.__getitem__
        return [b"".join(map(ids, self._cut(text))) for text in texts]


def encoder(path: str, code: str = "I", kept: int = KEPT_PIECES) -> Encoder:
    """One encoder for each worker, kept from task to task while no other is asked for."""
    return of_worker(("encoder", path, code, kept), lambda: Encoder(path, code, kept))


def encoded(texts: Iterable[str | None], path: str, code: str = "I", group: int = 64, most: int = 1 << 22, kept: int = KEPT_PIECES) -> Iterable[bytes]:
    """Ids text by text, a null text as an empty one, in groups of bounded length."""
    held: list[str] = []
    chars = 0
    for text in texts:
        held.append(text or "")
        chars += len(held[-1])
        if len(held) == group or chars >= most:
            yield from encoder(path, code, kept).encode(held)
            held, chars = [], 0
    if held:
        yield from encoder(path, code, kept).encode(held)
