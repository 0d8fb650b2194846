"""Pre-tokens of byte-level BPE in whole Arrow batches, and their ids through the ``tokenizers`` library.

The splitter applies the vocabulary's published pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
as array operations on code-point classes, so that no text is scanned character by character in Python.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK_BYTES = 1 << 20
#: Distinct pre-tokens whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 500_000


@functools.cache
def classes() -> np.ndarray:
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    out[WHITE_SPACE] = SPACE
    return out


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``size`` bytes each; a longer text stays whole."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, texts.slice(start, end - start)
        start = end


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of a chunk's texts in order, and the row of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] is not None else b""
    offsets = offsets - offsets[0]
    if not data:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # the first byte of each code point
    first = np.zeros(n + 1, bool)  # where a text begins
    first[np.searchsorted(lead, offsets)] = True
    kind = classes()[points]
    space, blank = kind == SPACE, points == 0x20
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first[:n]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~first[:n]
    last = np.ones(n, bool)  # of a run of white space with something behind it
    last[:-1] = kind[1:] != SPACE
    last &= ~first[1:]
    begins = (~space & change & ~after_blank) | (space & (change | last))
    quotes = np.flatnonzero((points == 0x27) & begins)
    if len(quotes):
        _contract(points, first, begins, quotes)
    starts = np.flatnonzero(begins)
    at = np.append(lead[starts], len(data))
    rows = np.searchsorted(offsets, at[:-1], "right") - 1
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)), rows


def _contract(points: np.ndarray, first: np.ndarray, begins: np.ndarray, quotes: np.ndarray) -> None:
    """Cuts off ``'s 't 're 've 'm 'll 'd`` where a pre-token begins with the quote."""
    n = len(points)
    for i in quotes.tolist():
        while i + 1 < n and points[i] == 0x27 and not first[i + 1]:
            pair = "".join(map(chr, points[i + 1 : i + 3])) if i + 2 < n and not first[i + 2] else chr(points[i + 1])
            size = 2 if pair[:1] in "stmd" else 3 if pair in ("re", "ve", "ll") else 0
            if not size:
                break
            begins[i] = True
            begins[i + 1 : i + size] = False
            i += size
            if i < n:
                begins[i] = True  # the rest begins anew, even with a quote


class Encoder:
    """Ids of pre-tokens; each distinct one goes through the library once, as long as it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # the library's byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.heads = array("I"), array("q", [0])

    def numbered(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece among the remembered ones."""
        if len(self.index) > REMEMBERED:
            self.forget()
        index, tokenize, flat, heads = self.index, self.library.model.tokenize, self.flat, self.heads
        for p in pieces:
            if p not in index:
                index[p] = len(index)
                flat.extend([t.id for t in tokenize(p.encode().decode("latin-1").translate(self.alphabet))])
                heads.append(len(flat))
        return np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))

    def sizes(self, pieces: list[str]) -> np.ndarray:
        at = self.numbered(pieces)
        return np.diff(np.frombuffer(self.heads, np.int64))[at]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For chunk after chunk: its first row, all ids, and each row's bounds among them."""
        for start, part in chunks(texts):
            if any(pc.any(pc.match_substring(part, s)).as_py() for s in self.specials):  # it cuts a text where the pattern would not
                each = [self.whole(t) for t in part.to_pylist()]
                yield start, np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each]))
                continue
            pieces, rows = split(part)
            coded = pieces.dictionary_encode()
            at = self.numbered(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
            heads, flat = np.frombuffer(self.heads, np.int64).copy(), np.frombuffer(self.flat, np.uint32).copy()
            n = heads[at + 1] - heads[at]
            ends = np.cumsum(n)
            ids = flat[np.arange(len(n) and ends[-1]) + np.repeat(heads[at] - (ends - n), n)]
            yield start, ids, np.append(0, np.cumsum(np.bincount(rows, n, len(part)).astype(np.int64)))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
