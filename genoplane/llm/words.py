"""Words of a batch of texts as numbers, by Arrow's own kernels."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words per text, index of each word, distinct words): words are runs free of ASCII white space; null: none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = parts.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    distinct = [w.encode() for w in coded.dictionary.to_pylist()]
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in distinct:  # before and after white space at the ends
        empty = distinct.index(b"")
        keep = index != empty
        row = np.repeat(np.arange(len(lengths)), lengths)
        lengths = np.bincount(row[keep], minlength=len(lengths))
        index = index[keep]
        index = index - (index > empty)
        del distinct[empty]
    return lengths.astype(np.int64), index, distinct


def word_hashes(distinct: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in distinct), dtype=np.uint64, count=len(distinct))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of the ordered pair (a, b) of 64-bit hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def crc_fold(ids: list, modulus: int) -> np.ndarray:
    """crc32 of each id as decimal text, modulo modulus; null: of empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in ids], dtype=np.int64)
