"""Scalar text, time and hash functions, as column expressions wherever Spark has the parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_TOKEN, MAX_TOKEN = 2, 50
SIMHASH_TOKENS = 200
DEDUP_CHARS = 1000


def tokens(text: Column) -> Column:
    """OP-B9, OP-F4: lower-cased runs of letters, digits and underscores, 2 to 50 characters long. Null gives [].

    Both forms of the small sigma are one letter, so that a word's place in a line cannot change it.
    """
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ς", "σ")
    runs = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"))
    return F.filter(runs, lambda t: F.length(t).between(MIN_TOKEN, MAX_TOKEN))


def raw_terms(text: Column) -> Column:
    """OP-B7: terms of a query taken as they stand, cut at white space only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def epoch_seconds(ts: Column, now: int | Column) -> Column:
    """OP-T1: seconds of an ISO time ending in Z; ``now`` where it cannot be read."""
    now = now if isinstance(now, Column) else F.lit(now)
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(ts, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))), now.cast("long"))


def vbyte_length(v: Column) -> Column:
    """OP-C1: bytes of a number in the variable-byte code."""
    return sum((F.when(v >= 1 << 7 * k, 1).otherwise(0) for k in range(1, 5)), F.lit(1))


def hamming(a: Column, b: Column) -> Column:
    """OP-D2."""
    return F.bit_count(a.bitwiseXOR(b))


def bands(fp: Column, n: int, bits: int) -> Column:
    """OP-D3: the bands of a fingerprint, lowest bits first."""
    return F.array(*(F.shiftrightunsigned(fp, bits * i).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for i in range(n)))


def _fingerprints(texts: Iterator[pd.Series], most: int | None) -> Iterator[pd.Series]:
    """64-bit sign of the summed bit votes of the MD5 of the first ``most`` words, or of all; 0 for a text without words or null.

    Each word votes with the first eight bytes of its digest, big-endian; a bit is set if it has more votes for than
    against. Words repeat often, so digests are kept per worker.
    """
    import hashlib

    import numpy as np

    seen: dict[str, int] = {}
    shifts = np.arange(64, dtype=np.uint64)
    weights = np.uint64(1) << shifts
    for batch in texts:
        out = np.zeros(len(batch), np.int64)
        for i, t in enumerate(batch):
            words = t.lower().split()[:most] if t is not None else []
            if not words:
                continue
            if len(seen) > 500_000:
                seen.clear()
            for w in words:
                if w not in seen:
                    seen[w] = int.from_bytes(hashlib.md5(w.encode("utf-8", "replace")).digest()[:8], "big")
            h = np.fromiter((seen[w] for w in words), np.uint64, len(words))
            # By blocks, so that a long text does not become 64 numbers a word at once.
            ones = sum(((h[k : k + 8192, None] >> shifts) & np.uint64(1)).sum(0, dtype=np.int64) for k in range(0, len(h), 8192))
            out[i] = (weights[2 * ones > len(words)]).sum(dtype=np.uint64).astype(np.int64)
        yield pd.Series(out)


@F.pandas_udf(T.LongType())
def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """OP-D1, OP-F12: fingerprint of the first 200 words."""
    yield from _fingerprints(texts, SIMHASH_TOKENS)


@F.pandas_udf(T.LongType())
def simhash_whole(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same of all words."""
    yield from _fingerprints(texts, None)


@F.pandas_udf(T.LongType())
def xxh64(texts: pd.Series) -> pd.Series:
    """OP-D6: XXH64 with seed 0 of the UTF-8 text, as signed bits. Spark's own ``xxhash64`` has another seed."""
    import xxhash

    def one(t):
        if t is None:
            return None
        h = xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), 0)
        return h - (1 << 64) if h >= 1 << 63 else h

    return texts.map(one, na_action=None).astype("Int64")
