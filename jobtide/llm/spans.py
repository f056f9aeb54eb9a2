"""Words and word n-grams of texts as NumPy arrays of positions, without a Python object for each word.

Texts are joined and cut as bytes: a table says of every byte whether it belongs to a word, is a gap or
ends a run that no n-gram crosses (bytes of longer UTF-8 characters belong to words). Words are then laid
out anew with one space between neighbours, so an n-gram is one slice of that buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORD, GAP, BREAK = 0, 1, 2


def byte_kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """The kind of every byte; the new line that joins texts is a gap at least."""
    kinds = np.full(256, WORD, np.uint8)
    kinds[list(gaps + b"\n")] = GAP
    kinds[list(breaks)] = BREAK
    return kinds


class Cut:
    """The words of some texts, or of a part of one long text.

    ``text`` holds the words with one space between; word ``i`` is ``text[starts[i]:ends[i]]`` in lower
    case (A-Z only) and belongs to text ``docs[i]``, of which it is word ``number[i]``. N-grams lie within a run. The first ``carry`` words belonged to the part before.
    """

    def __init__(self, texts: list[bytes], kinds: np.ndarray, first: int = 0, base: int = 0, carry: int = 0):
        raw = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8) if texts else np.zeros(0, np.uint8)
        kind = kinds[raw]
        inside = kind == WORD
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(raw) and inside[0]:
            edges = np.concatenate([[0], edges])
        begin, end = edges[0::2], edges[1::2]
        self.begin = begin  # places in the raw bytes
        keep = inside.copy()
        keep[end] = True
        laid = raw.copy()
        laid[end] = 32
        self.text = np.concatenate([laid[keep], np.zeros(8, np.uint8)])
        size = (end - begin).astype(np.int64)
        self.starts = np.cumsum(size + 1) - size - 1
        self.ends = self.starts + size
        heads = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        doc = np.searchsorted(heads, begin, "right") - 1
        firsts = np.searchsorted(begin, heads)
        self.number = np.arange(len(begin)) - (firsts[doc] if len(doc) else 0) + base
        stops = np.flatnonzero(kind == BREAK)
        self.runs = np.searchsorted(stops, begin) + doc
        self.docs = doc + first
        self.carry = carry

    def grams(self, n: int) -> np.ndarray:
        """Numbers of the words where an n-gram starts that no earlier part has counted."""
        total = len(self.starts) - n + 1
        if total <= 0:
            return np.zeros(0, np.int64)
        inside = self.runs[:total] == self.runs[n - 1 :]
        inside[: max(0, self.carry - n + 1)] = False
        return np.flatnonzero(inside)


def cuts(texts: list[bytes], kinds: np.ndarray, longest: int, size: int = 1 << 19) -> Iterator[Cut]:
    """Cuts of some ``size`` bytes. A longer text comes in parts that share ``longest - 1`` words."""
    first, some, total = 0, [], 0
    gap = kinds != WORD
    for i, text in enumerate(texts):
        if len(text) <= size:
            some.append(text)
            total += len(text)
            if total >= size:
                yield Cut(some, kinds, first)
                first, some, total = i + 1, [], 0
            continue
        if some:
            yield Cut(some, kinds, first)
        first, some, total = i + 1, [], 0
        raw, start, stop, base, carry = np.frombuffer(text, np.uint8), 0, 0, 0, 0
        while stop < len(text):
            stop = min(len(text), stop + size)
            while stop < len(text):  # on to the end of the word
                ahead = np.flatnonzero(gap[raw[stop : stop + 65536]])
                if len(ahead):
                    stop += int(ahead[0])
                    break
                stop = min(len(text), stop + 65536)
            part = Cut([text[start:stop]], kinds, i, base, carry)
            yield part
            words = len(part.begin)
            carry = min(longest - 1, words)
            base += words - carry
            start = start + int(part.begin[-carry]) if carry else stop
    if some:
        yield Cut(some, kinds, first)


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``text[a:a+size]`` equals ``text[b:b+size]``, for arrays of places; ``text`` ends in eight spare bytes."""
    a, b, size = (x.astype(np.int64) for x in (a, b, size))
    eights = np.ndarray((len(text) - 7,), "<u8", buffer=text, strides=(1,))
    equal = np.ones(len(a), bool)
    todo, at = np.arange(len(a)), 0
    while len(todo):
        left = size[todo] - at
        differ = eights[a[todo] + at] ^ eights[b[todo] + at]
        short = left < 8
        differ[short] &= (np.uint64(1) << (8 * np.maximum(left[short], 0)).astype(np.uint64)) - np.uint64(1)
        equal[todo[differ != 0]] = False
        todo = todo[(differ == 0) & (left > 8)]
        at += 8
    return equal


def raw_texts(column: pa.Array) -> list[bytes]:
    """Texts as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of many slices at once; ``text`` ends in eight spare bytes. Slices of 32 bytes or more go one by one."""
    eights = np.ndarray((len(text) - 7,), "<u8", buffer=text, strides=(1,))
    fours = np.ndarray((len(text) - 7,), "<u4", buffer=text, strides=(1,))
    out = P5 + sizes.astype(np.uint64)
    for j in range(3):
        at = np.flatnonzero(sizes >= 8 * j + 8)
        if len(at):
            out[at] = _turned(out[at] ^ (_turned(eights[starts[at] + 8 * j] * P2, 31) * P1), 27) * P1 + P4
    done = sizes & ~7
    at = np.flatnonzero(sizes & 4)
    out[at] = _turned(out[at] ^ (fours[starts[at] + done[at]].astype(np.uint64) * P1), 23) * P2 + P3
    done = sizes & ~3
    for j in range(3):
        at = np.flatnonzero((sizes & 3) > j)
        out[at] = _turned(out[at] ^ (text[starts[at] + done[at] + j].astype(np.uint64) * P5), 11) * P1
    out = (out ^ (out >> np.uint64(33))) * P2
    out = (out ^ (out >> np.uint64(29))) * P3
    out ^= out >> np.uint64(32)
    long_ = np.flatnonzero(sizes >= 32)
    if len(long_):
        data, digest = text.tobytes(), xxhash.xxh64_intdigest
        out[long_] = [digest(data[a : a + z]) for a, z in zip(starts[long_].tolist(), sizes[long_].tolist())]
    return out


def _shift_tables(most: int) -> np.ndarray:
    """``[n, byte, value]``: a CRC-32 whose byte has that value, moved on by ``n`` zero bytes (fixed value: the reflected polynomial)."""
    unit = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        unit = np.where(unit & 1, unit >> 1 ^ np.uint32(0xEDB88320), unit >> 1)
    out = np.zeros((most, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, most):
        out[n] = unit[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out


#: Checksums are moved by up to so many bytes at once (512 KB of tables).
MOST = 128
SHIFT = _shift_tables(MOST)


def crc_joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two parts one after the other, from theirs; ``size`` is the second part's length."""
    moved, left = first.copy(), size.astype(np.int64)
    while True:
        n = np.minimum(left, MOST - 1)
        moved = (SHIFT[n, 0, moved & 255] ^ SHIFT[n, 1, moved >> np.uint32(8) & 255]
                 ^ SHIFT[n, 2, moved >> np.uint32(16) & 255] ^ SHIFT[n, 3, moved >> np.uint32(24)])
        left = left - n
        if not left.any():
            return moved ^ second
