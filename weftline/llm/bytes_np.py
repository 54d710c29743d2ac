"""Numpy helpers on the bytes of Arrow batches: concatenated texts, polynomial prefix hashes, word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Any odd multiplier works; its inverse modulo 2**64 is derived.
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
#: A fixed random word for each byte value.
BYTE_WORDS = np.random.Generator(np.random.PCG64(20240601)).integers(0, 1 << 64, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are hashed at once.
CHUNK = 1 << 19


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finalizer)."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        if n > 4 * CHUNK:  # for one very long text; not kept
            return np.concatenate([np.ones(1, U64), np.multiply.accumulate(np.full(n - 1, base, U64))])
        have = _powers[int(base)] = np.concatenate([np.ones(1, U64), np.multiply.accumulate(np.full(max(n, CHUNK) - 1, base, U64))])
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[0] = 0; `substring_hash` reads the hash of any substring of bytes or of 64-bit symbols from it."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((BYTE_WORDS[data] if data.dtype == np.uint8 else mix(data, 23)) * powers(BASE_INVERSE, len(data)), out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal substrings wherever they start."""
    return mix((prefix[end] - prefix[start]) * powers(BASE, len(prefix))[start] + (end - start).astype(U64))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, offsets); null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about CHUNK bytes; only a run is copied."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    row, rows = 0, len(ends)
    while row < rows:
        before = ends[row - 1] if row else 0
        end = min(max(row + 1, int(np.searchsorted(ends, before + CHUNK, "right"))), rows)
        yield row, end, *joined(column.slice(row, end - row))
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the words [^\\x20\\x09-\\x0D]+ of each text; first word of each text, with the end appended."""
    word = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased if lower; first word of each text, with the end appended."""
    starts, ends, firsts = word_spans(data, offsets)
    return substring_hash(prefix_hash(LOWER[data] if lower else data), starts, ends), firsts


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles of so many words (fewer words: one of all)."""
    factors = mix(np.arange(words, dtype=U64), 7) | U64(1)
    for first, end, data, offsets in text_chunks(column):
        hashes, firsts = word_hashes(data, offsets)
        n = len(hashes) - words + 1
        whole = np.zeros(max(n, 0), U64)
        for j in range(words if n > 0 else 0):
            whole += hashes[j : j + n] * factors[j]
        whole = mix(whole, words)
        for i in range(end - first):
            a, b = int(firsts[i]), int(firsts[i + 1])
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                yield mix((hashes[a:b] * factors[: b - a]).sum(keepdims=True, dtype=U64), b - a)
            else:
                yield np.zeros(0, U64)
