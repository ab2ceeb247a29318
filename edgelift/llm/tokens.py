"""Token ids of whole texts, by the ``tokenizers`` library.

A BPE model works on one pre-token at a time, so the ids of a text are the ids
of its pre-tokens in a row.  Texts repeat their pre-tokens, hence each distinct
one goes through the library once per worker and is remembered.  The cut into
pre-tokens is done here only for texts over an alphabet on which the two
supported pre-tokenizers are plain regular expressions and their normalizers
reduce to lower-casing (tab, line breaks, printable ASCII, printable Latin-1).
Every other text, and one that may hold a special token, is handed to the
library as a whole.
"""

from __future__ import annotations

import os
import re

LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBER = "0-9²³¹¼½¾"
SPACE = r" \t\n\r"
OTHER = f"[^{SPACE}{LETTER}{NUMBER}]"

_PLAIN = re.compile(r"[\t\n\r -~¡-¬®-ÿ]*").fullmatch

#: Pre-tokenizer patterns, fixed by the vocabulary files; the alternative that hits most often stands first.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_CUT = {
    "byte": re.compile(f" ?[{LETTER}]+|{_SHORT}| ?[{NUMBER}]+| ?{OTHER}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall,
    "word": re.compile(f"[{LETTER}]+|{_SHORT}|[{NUMBER}]|{OTHER}+").findall,
}

#: Pre-tokens that a worker remembers in each of two generations.
MEMO = 300_000


def byte_alphabet() -> dict[int, str]:
    """The visible character for each byte in byte-level BPE: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder(dict):
    """Maps pre-tokens to their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kind: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy
        from tokenizers import Tokenizer

        self.pack = lambda ids: numpy.array(ids, "<u4").tobytes()
        self.library = Tokenizer.from_file(path)
        # special tokens that stand in a text are found by the library, as the whole text goes there
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)", re.I).search
        self.cut, self.lower, self.memo = _CUT[kind], kind == "word", memo
        self.visible, self.model, self.older = byte_alphabet(), self.library.model, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            shown = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.visible)  # A-Z, a-z and 0-9 stand for themselves
            out = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        self[piece] = out
        return out

    def whole(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _PLAIN(text) or self.special(text):
            return self.whole(text)
        if len(self) > self.memo:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.cut(text.lower() if self.lower else text)))


_encoders: dict[tuple[str, str, int], Encoder] = {}


def encoder(path: str, kind: str, memo: int = MEMO) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if (path, kind, memo) not in _encoders:
        _encoders[path, kind, memo] = Encoder(path, kind, memo)
    return _encoders[path, kind, memo]
