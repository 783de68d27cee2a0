"""Text batches as numpy arrays: code points, lines, words and 64-bit hashes without a Python loop per line.

Arrow hands over some thousand texts at once. They are joined by line feeds into one array of code points, so that
every line, word and n-gram of the batch is a pair of offsets and every count a difference of running sums. A text
that is null counts as empty here; callers that must tell the two apart look at ``TextBatch.null``.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

import numpy as np

WORD, LETTER, DIGIT, UPPER, SPACE = 1, 2, 4, 8, 16
BMP = 0x10000
_M = np.uint64(0x9E3779B97F4A7C15)


def _flags(c: str) -> int:
    return (
        (c.isalnum() or c == "_") * WORD | c.isalpha() * LETTER | c.isdecimal() * DIGIT | c.isupper() * UPPER | c.isspace() * SPACE
    )


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags and lower case of each character of the basic plane, and a random 64-bit number for each."""
    flags = np.fromiter((_flags(chr(i)) for i in range(BMP)), np.uint8, BMP)
    lower = np.fromiter((ord(chr(i).lower()[0]) for i in range(BMP)), np.uint32, BMP)
    return flags, lower, mix(np.arange(1, BMP + 1, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h + _M).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = 0x2545F4914F6CDD1D
    inv = pow(r, -1, 1 << 64)
    up, down = np.full(n, r, np.uint64), np.full(n, inv, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


def running(x: np.ndarray) -> np.ndarray:
    """Running sums with a leading zero, so that a span's sum is one difference."""
    out = np.empty(len(x) + 1, np.int64)
    out[0] = 0
    np.cumsum(x, out=out[1:])
    return out


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span of ``values`` (64-bit numbers), the same wherever the span stands."""
    up, down = powers(len(values) + 1)
    run = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class TextBatch:
    """Texts of one Arrow batch."""

    def __init__(self, texts: list[str | None]):
        self.null = np.fromiter((t is None for t in texts), bool, len(texts))
        self.texts = texts = [t or "" for t in texts]
        self.n = len(texts)
        self.text = "\n".join(texts)
        self.size = np.fromiter(map(len, texts), np.int64, self.n)
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)[:-1]]).astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.end = self.start + self.size
        self.cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)

    @cached_property
    def base(self) -> np.ndarray:
        """Code points folded into the basic plane; what lies beyond is folded by its low bits for hashing only."""
        return np.where(self.cp < BMP, self.cp, self.cp & 0x7FF | 0xE000)

    @cached_property
    def flags(self) -> np.ndarray:
        out = tables()[0][self.base]
        far = np.flatnonzero(self.cp >= BMP)
        if len(far):
            codes, back = np.unique(self.cp[far], return_inverse=True)
            out[far] = np.fromiter((_flags(chr(c)) for c in codes), np.uint8, len(codes))[back]
        return out

    @cached_property
    def lower(self) -> np.ndarray:
        return tables()[1][self.base]

    @cached_property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n, dtype=np.int32), self.size + 1)[: len(self.cp)]

    # lines

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, document and number in the document of each line; a null or empty text is one empty line."""
        cut = np.flatnonzero(self.cp == 10)
        starts = np.concatenate([[0], cut + 1]).astype(np.int64)
        ends = np.concatenate([cut, [len(self.cp)]]).astype(np.int64)
        doc = np.searchsorted(self.start, starts, "right") - 1
        first = np.searchsorted(doc, np.arange(self.n))
        return starts, ends, doc, np.arange(len(starts)) - first[doc] if self.n else starts

    # words

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each run of letters, digits and underscores."""
        w = np.zeros(len(self.cp) + 2, np.int8)
        w[1:-1] = self.flags & WORD
        d = np.diff(w)
        return np.flatnonzero(d == 1), np.flatnonzero(d == -1)

    @cached_property
    def word_hash(self) -> np.ndarray:
        """Of the lower-cased word."""
        return span_hash(tables()[2][self.lower], *self.words)

    @cached_property
    def word_doc(self) -> np.ndarray:
        return np.searchsorted(self.start, self.words[0], "right") - 1

    @cached_property
    def word_range(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of the words of each document."""
        return np.searchsorted(self.word_doc, np.arange(self.n)), np.searchsorted(self.word_doc, np.arange(self.n), "right")

    def ngram_hash(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Place (number of its first word) and hash of each run of k words within one document."""
        n = len(self.word_hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.word_doc[: n - k + 1] == self.word_doc[k - 1 :])
        return at, span_hash(self.word_hash, at, at + k)


def hash_word(word: str) -> np.uint64:
    """The hash ``TextBatch.word_hash`` gives this word."""
    return TextBatch([word]).word_hash[0]


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    i = np.searchsorted(table, values)
    i[i == len(table)] = 0
    return table[i] == values


SLICE = 1 << 19
"""Characters handled at once; a longer text is handled alone. It bounds a Python worker's memory, not the result."""


def slices(sizes: np.ndarray, limit: int = SLICE):
    """Ranges of neighbouring texts of about ``limit`` characters."""
    a, room = 0, limit
    for i, n in enumerate(sizes):
        if i > a and n + 1 > room:
            yield a, i
            a, room = i, limit
        room -= int(n) + 1
    if len(sizes):
        yield a, len(sizes)


def mapped(df, text: str, keep: list[str], schema: str, make):
    """``df.mapInArrow`` over slices of the text column.

    ``make(batch, kept)`` gets a TextBatch and the kept columns as Arrow arrays and returns a list of columns in the
    order of ``schema``; it may return any number of rows. Only the text and the kept columns travel to Python.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = [f"k{i}" for i in range(len(keep))]
    # Parsing needs a session; the Arrow schema is plain data and travels with the closure.
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for got in batches:
            texts = got.column("t").to_pylist()
            sizes = np.fromiter((len(x or "") for x in texts), np.int64, len(texts))
            for a, b in slices(sizes):
                cols = make(TextBatch(texts[a:b]), [got.column(n).slice(a, b - a) for n in names])
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(cols, out)], schema=out
                )

    return df.select(df[text].cast("string").alias("t"), *(df[k].alias(n) for k, n in zip(keep, names))).mapInArrow(run, schema)
