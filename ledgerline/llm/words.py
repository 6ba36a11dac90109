"""Words of whole texts as numpy arrays, without a Python object a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .jaccard import mix

_BYTES = np.arange(256)
#: Bytes of words between white space.
BETWEEN_BLANKS = ~np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
#: Bytes of ASCII letters and of characters beyond ASCII; the same with digits.
LETTERS = (_BYTES >= 0x80) | ((_BYTES | 0x20 >= 0x61) & (_BYTES | 0x20 <= 0x7A))
LETTERS_DIGITS = LETTERS | ((_BYTES >= 0x30) & (_BYTES <= 0x39))
_LOWER = _BYTES.astype(np.uint8)
_LOWER[0x41:0x5B] += 0x20

_PLACE = np.uint64(0x9E3779B97F4A7C15)


def blobs(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    return [b or b"" for b in texts.cast(pa.large_binary()).to_pylist()]


def spans(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one byte array, start and end of each word in it, and the word's text.

    `inside` says of each byte whether words hold it; blanks, which no word holds, part the texts.
    """
    data = np.frombuffer(b" ".join(texts), np.uint8)
    edge = np.flatnonzero(np.diff(inside[data], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    stops = np.cumsum([len(t) + 1 for t in texts])
    return data, start, end, np.searchsorted(stops, start, side="right")


def encoded(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's text and its place in the distinct words, A-Z lower-cased, and the distinct words as bytes."""
    data, start, end, doc = spans(texts, inside)
    body = _LOWER[data[inside[data]]]
    ends = np.append(0, np.cumsum(end - start)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(body)]).dictionary_encode()
    return doc, words.indices.to_numpy().astype(np.int64), words.dictionary


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; another salt gives an independent one."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.zeros(len(data), np.int64)
    first[start[1:]] = start[1:] - start[:-1]
    first[start[0]] = start[0]
    place = (np.arange(len(data)) - np.cumsum(first)).astype(np.uint64)
    total = np.cumsum(mix(data.astype(np.uint64) + place * _PLACE, 40 + salt))  # each byte with its place in the word
    return mix(total[end - 1] - np.where(start > 0, total[start - 1], np.uint64(0)), 50 + salt)


def runs(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of `size` words: hashes of runs twice as long from two of the shorter ones."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    h, length = words, 1
    while length < size:
        step = min(length, size - length)
        h = mix(h[: len(h) - step] * _PLACE + h[step:], 60 + salt)
        length += step
    return h
