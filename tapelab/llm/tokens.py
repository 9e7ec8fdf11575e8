"""Texts to token ids with a public tokenizer, through per-worker caches of word pieces.

The two supported pre-tokenizers never join what stands on both sides of white space, so a text is
split at single blanks and line feeds, and the ids of a piece are looked up or made once by the
``tokenizers`` library. A text with any other white space (runs, tabs, at its ends) or a control
character that could matter goes to the library whole.

Ids are returned as little-endian unsigned bytes, two per id where the vocabulary allows.
"""

from __future__ import annotations

import json

import numpy as np

END_ID = 2
LIMIT = 240_000  # pieces that a worker remembers, even while it waits for its next task: those that came again
FRESH = 100_000  # pieces that came once; all are forgotten when there are more
_PUNCTUATION = ".,!?;:|\"()[]-"
# bytes of a byte-level vocabulary: those without a sign of their own are written as signs from 256 on
_ODD = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b > 173)]
_SPELLING = {b: chr(256 + i) for i, b in enumerate(_ODD)}
_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes whole texts; ``dtype`` is the type of one id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        with open(path) as f:
            spec = json.load(f)
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        #: blanks are part of the following word unless the pre-tokenizer drops them
        self.blank = " " if (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" else ""
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.pieces: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.line_feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _made(self, piece: str) -> bytes:
        """Ids of letters or anything else after a blank; after a line feed, if that comes first."""
        first = self.blank
        if piece[0] == "\n":
            first, piece = "", piece[1:]
        word = first + piece
        if piece.isalpha() and _latin(piece) and not (self.lower and piece != piece.lower()):
            # one token group of letters that no normalizer changes: only merges are left to do
            spelled = (first and _SPELLING[32]) + piece if piece.isascii() else word.encode().decode("latin-1").translate(_SPELLING)
            out = b"".join([t.id.to_bytes(self.dtype.itemsize, "little") for t in self.model.tokenize(spelled)])
        else:
            out = self.whole(word)
        return out if first or not self.blank else self.line_feed + out

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that follows a blank, or starts with the line feed before it."""
        known = self.fresh.pop(piece, None)
        if known is not None:
            if len(self.pieces) < LIMIT:
                self.pieces[piece] = known
            else:
                self._keep(piece, known)
            return known
        word = piece.rstrip(_PUNCTUATION)
        tail = piece[len(word):]
        if tail and word.lstrip("\n").isalpha():  # a run of signs is a token group of its own
            known = self.pieces.get(word) or self.fresh.get(word)
            if tail not in self.tails:
                self.tails[tail] = self.whole(tail)
            if known is None:  # what stays with signs is kept once its word comes again
                self._keep(word, known := self._made(word))
                out = known + self.tails[tail]
            else:
                self._keep(piece, out := known + self.tails[tail])
            if len(self.tails) > 10_000:
                self.tails.clear()
        else:
            self._keep(piece, out := self._made(piece))
        return out

    def _keep(self, piece: str, ids: bytes) -> None:
        if len(piece) <= 64:
            if len(self.fresh) >= FRESH:
                self.fresh.clear()
            self.fresh[piece] = ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        plain = text.replace("\n", " \n")
        pieces = plain.split(" ")
        if (len(text) < 2 or "  " in plain or "\n " in text or text[0] in " \n" or text[-1] in " \n" or "\n \n" in plain
                or len(pieces) != len(text.split()) or any(s in text for s in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f")):
            return self.whole(text)
        if self.lower and _latin(text):  # there Python and the library agree on small letters
            pieces = plain.lower().split(" ")
        get, make = self.pieces.get, self._piece
        if self.blank:  # as after a line feed, without it
            start = "\n" + pieces[0]
            first = (get(start) or make(start))[len(self.line_feed):]
        else:
            first = get(pieces[0]) or make(pieces[0])
        return first + b"".join([get(p) or make(p) for p in pieces[1:]])


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def as_words(ids: bytes, dtype) -> np.ndarray:
    return np.frombuffer(ids, dtype)


def crc(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
