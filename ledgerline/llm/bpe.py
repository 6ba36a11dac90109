"""Whole-text token ids from a public byte-level BPE file, one word piece at a time.

The byte-level pre-tokenizer ends a piece before a blank that stands before a visible
character, and around a single line end between visible characters.  So lines and then blanks
cut a text into pieces that can be encoded alone.  Natural text repeats its words: each
piece's ids are kept in a bounded dictionary and the tokenizer itself runs on new pieces only.
A plain word is one piece of the pre-tokenizer, so it goes to the tokenizer's model at once.
Texts with other white space go through the tokenizer whole; all ways give the same ids.
"""

from __future__ import annotations

import numpy as np

#: Bytes, about, of pieces learned in one Python worker before the older ones go, but for those met again since; twice this is held at most.
MAX_BYTES = 96 << 20
#: Bytes that a kept piece takes besides its characters and ids.
OVERHEAD = 200
#: Longer pieces (texts without blanks) are not kept.
MAX_KEPT = 100
#: Letters below this are letters in every Unicode version at hand; words of them alone need no pre-tokenizer.
LETTERS_BELOW = "\u0500"
#: The character that stands for each byte in the vocabulary: printable ones of Latin-1 for themselves, others from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: A word before a run of these is encoded apart from the run (all ASCII marks but the apostrophe).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_path() -> str:
    """The public byte-level BPE vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _visible(c: str) -> bool:
    return bool(c) and ("!" <= c <= "~" or c.isalnum())


class Encoder:
    """ids(text) -> little-endian unsigned 32-bit ids as bytes; None and "" give b""."""

    def __init__(self, path: str, max_bytes: int = MAX_BYTES):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._model._resize_cache(0)  # the dictionary holds what the model's own cache would
        self._four = [i.to_bytes(4, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._line_end = self._whole("\n")
        self._max, self._held = max_bytes, 0
        self._known: dict[str, bytes] = {}  # ids of a piece after a blank, or of a line end and a piece
        self._older: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of letters alone, with or without a blank before them: one piece, which the model takes by its bytes."""
        if word.isascii():
            text = word.replace(" ", "\u0120")
        elif max(word) < LETTERS_BELOW:
            text = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        else:
            return self._whole(word)
        four = self._four
        return b"".join([four[t.id] for t in self._model.tokenize(text)])

    def _piece(self, p: str) -> bytes | None:
        """Ids of a new piece; None if it can't stand alone."""
        start = p[:1] == "\n"
        word = p.rstrip(MARKS)
        letters = word[1:] if start else word
        if not letters.isalpha():
            if not p or not _visible(p[start : start + 1]):
                return None
            return self._line_end + self._whole(p[1:]) if start else self._whole(" " + p)
        if len(word) == len(p):
            return self._line_end + self._word(letters) if start else self._word(" " + p)
        run = p[len(word) :]
        marks = self._marks.get(run)
        if marks is None:
            marks = self._whole(run)
            if len(run) <= MAX_KEPT:
                self._keep(self._marks, run, marks)
        ids = self._known.get(word) or self._older.get(word)
        if ids is None:
            ids = self._line_end + self._word(letters) if start else self._word(" " + word)
            if len(word) <= MAX_KEPT:
                self._keep(self._known, word, ids)
        return ids + marks

    def _keep(self, pieces: dict[str, bytes], p: str, ids: bytes) -> None:
        pieces[p] = ids
        self._held += OVERHEAD + len(p) + len(ids)

    def forget(self) -> None:
        """Drop the pieces learned so far: what a task gathered does not stay in its Python worker."""
        self._known, self._older, self._marks, self._held = {}, {}, {}, 0

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        known = self._known
        pieces = ("\n" + text).replace("\n", " \n").split(" ")[1:]
        found = list(map(known.get, pieces))
        if None in found:
            if self._held > self._max:
                self._older, known = known, {}
                self._known, self._marks, self._held = known, {}, 0
            older = self._older
            for i, ids in enumerate(found):
                if ids is None:
                    p = pieces[i]
                    ids = known.get(p) or older.get(p) or self._piece(p)
                    if ids is None:
                        return self._whole(text)
                    found[i] = ids
                    if len(p) <= MAX_KEPT:
                        self._keep(known, p, ids)
        return b"".join(found)[len(self._line_end) :]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, max_bytes: int = MAX_BYTES) -> Encoder:
    """The worker's encoder for this vocabulary file, built once per Python worker; the bound is the last caller's."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path]._max = max_bytes
    return _encoders[path]
