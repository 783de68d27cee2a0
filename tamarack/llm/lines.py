"""What can be told of each line of a page, for a whole batch at once."""

from __future__ import annotations

from functools import cached_property, lru_cache

import numpy as np

from tamarack.llm.arrays import DIGIT, LETTER, SPACE, UPPER, WORD, TextBatch, hash_word, member, mix, running, tables
from tamarack.llm.words import FUNCTION_WORDS

BITS = 15
"""Hashed line features have 2**BITS weights for each label."""
LONG = 30
"""Words of a longer line share the weight of so many."""


@lru_cache(1)
def lookup() -> dict:
    langs = sorted(FUNCTION_WORDS)
    common = np.unique(np.array([hash_word(w) for v in FUNCTION_WORDS.values() for w in v], np.uint64))
    share = np.zeros((len(langs), len(common)), np.float32)
    for i, lang in enumerate(langs):
        share[i, np.searchsorted(common, np.unique(np.array([hash_word(w) for w in FUNCTION_WORDS[lang]], np.uint64)))] = 1
    return {"langs": langs, "common": common, "by_lang": share}


def bucket(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, "right")


class Lines:
    """Of the lines of a batch that are not blank: place, counts, and hashed features for the line labeller."""

    def __init__(self, batch: TextBatch):
        self.b = batch
        s, e, doc, no = batch.lines
        sp = running(~((batch.flags & SPACE) > 0))
        full = np.flatnonzero((sp[e] - sp[s] > 0) & (doc >= 0))
        self.s, self.e, self.doc, self.no = s[full], e[full], doc[full], no[full]
        self.n = len(full)

    def count(self, mask: np.ndarray) -> np.ndarray:
        r = running(mask)
        return r[self.e] - r[self.s]

    @cached_property
    def chars(self) -> np.ndarray:
        """Characters but white space."""
        return self.count((self.b.flags & SPACE) == 0)

    @cached_property
    def letters(self) -> np.ndarray:
        return self.count((self.b.flags & LETTER) > 0)

    @cached_property
    def digits(self) -> np.ndarray:
        return self.count((self.b.flags & DIGIT) > 0)

    @cached_property
    def uppers(self) -> np.ndarray:
        return self.count((self.b.flags & UPPER) > 0)

    @cached_property
    def symbols(self) -> np.ndarray:
        return self.count((self.b.flags & (WORD | SPACE)) == 0)

    @cached_property
    def word_span(self) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.b.words[0], self.s), np.searchsorted(self.b.words[0], self.e)

    @cached_property
    def words(self) -> np.ndarray:
        return self.word_span[1] - self.word_span[0]

    @cached_property
    def common_at(self) -> np.ndarray:
        return member(self.b.word_hash, lookup()["common"])

    @cached_property
    def common(self) -> np.ndarray:
        """Words that are frequent in one of the five languages."""
        r = running(self.common_at)
        return r[self.word_span[1]] - r[self.word_span[0]]

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.count((self.b.flags & WORD) > 0)

    def edge(self, last: bool) -> np.ndarray:
        """First or last character of the line that is not white space."""
        solid = np.flatnonzero((self.b.flags & SPACE) == 0)
        if not len(solid):
            return np.zeros(self.n, np.uint32)
        i = np.searchsorted(solid, self.e if last else self.s) - last
        return self.b.cp[solid[np.clip(i, 0, len(solid) - 1)]]

    @cached_property
    def ends_sentence(self) -> np.ndarray:
        """Ends in . ! ? or an ellipsis, closing quotes set aside."""
        solid = np.flatnonzero(~np.isin(self.b.cp, np.array([ord(c) for c in "\"'”’»“)"])) & ((self.b.flags & SPACE) == 0))
        if not len(solid):
            return np.zeros(self.n, bool)
        i = np.clip(np.searchsorted(solid, self.e) - 1, 0, len(solid) - 1)
        return np.isin(self.b.cp[solid[i]], np.array([ord(c) for c in ".!?…"])) & (solid[i] >= self.s)

    @cached_property
    def first(self) -> np.ndarray:
        """First line of the document among these lines."""
        return np.searchsorted(self.doc, self.doc)

    @cached_property
    def rank(self) -> np.ndarray:
        return np.arange(self.n) - self.first

    @cached_property
    def back(self) -> np.ndarray:
        return np.searchsorted(self.doc, self.doc, "right") - 1 - np.arange(self.n)

    @cached_property
    def kind(self) -> np.ndarray:
        """A coarse shape of the line: length, sentence end, common words; also seen by its neighbours."""
        size = bucket(self.words, [1, 3, 5, 9, 16, 30])
        share = bucket(self.common / np.maximum(self.words, 1), [0.01, 0.12, 0.25])
        return (size * 4 + share) * 2 + self.ends_sentence

    @cached_property
    def marked(self) -> np.ndarray:
        """Begins with a bullet, a dash or a number."""
        head = self.edge(False)
        return np.isin(head, np.array([ord(c) for c in "•*-–—·#>"])) | ((head >= 48) & (head <= 57))

    @cached_property
    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, hashed feature and weight, one row for each that holds.

        Shape and place weigh 1; so do the words and pairs of words of a line up to LONG words. Those of a longer line share
        the weight of LONG words, so that its words are heard and its length alone decides nothing.
        """
        cp, b = self.b.cp, self.b
        head, tail = self.edge(False), self.edge(True)
        kind = self.kind
        before = np.where(self.rank > 0, np.roll(kind, 1), 90)
        after = np.where(self.back > 0, np.roll(kind, -1), 91)
        before2 = np.where(self.rank > 1, np.roll(kind, 2), 92)
        after2 = np.where(self.back > 1, np.roll(kind, -2), 93)
        sep = self.count(np.isin(cp, np.array([ord(c) for c in "/|>»·›"])))
        dense = [
            np.zeros(self.n),
            kind,
            np.minimum(self.rank, 9),
            np.minimum(self.back, 7),
            before,
            after,
            before * 100 + kind,
            after * 100 + kind,
            before2,
            after2,
            np.where(tables()[0][np.minimum(head, 0xFFFF)] & LETTER, 1 + ((tables()[0][np.minimum(head, 0xFFFF)] & UPPER) > 0), head + 10),
            np.where(tables()[0][np.minimum(tail, 0xFFFF)] & WORD, 1, tail + 10),
            bucket(sep, [1, 2, 4]) * 8 + bucket(self.words, [2, 4, 8]),
            bucket(self.digits, [1, 3, 5]) * 8 + bucket(self.words, [2, 4, 8]),
            bucket(self.uppers / np.maximum(self.letters, 1), [0.02, 0.1, 0.3, 0.9]) * 8 + bucket(self.words, [2, 4, 8]),
            bucket(self.symbols / np.maximum(self.chars, 1), [0.02, 0.06, 0.15, 0.3]),
            bucket(self.count(cp == 58), [1, 2]) * 8 + bucket(self.count(np.isin(cp, [0x2013, 0x2014])), [1]) * 4 + bucket(self.words, [3, 6, 12]),
            bucket(self.count(cp == ord("@")), [1]) + 2 * bucket(self.count(cp == 0xA9), [1]),
        ]
        mask = np.uint64((1 << BITS) - 1)
        at = np.arange(self.n)
        ids = [mix(np.uint64(j << 32) + x.astype(np.int64).astype(np.uint64)) & mask for j, x in enumerate(dense)]
        where = [at] * len(ids)
        dense_rows = self.dense_rows = self.n * len(ids)
        a = self.word_span[0]
        some = np.flatnonzero(self.words > 0)
        if len(some):
            k = self.words[some]
            line = np.repeat(some, k)
            place = np.arange(len(line)) - np.repeat(np.cumsum(k) - k, k)
            w = np.repeat(a[some], k) + place
            h = b.word_hash[w].copy()
            number = (b.flags[b.words[0][w]] & DIGIT) > 0
            h[number] = np.uint64(0)
            ids.append(mix(h + np.uint64(101)) & mask)
            where.append(line)
            pair = np.flatnonzero(place[1:] > 0) + 1
            ids.append(mix(h[pair - 1] * np.uint64(3) + h[pair] + np.uint64(202)) & mask)
            where.append(line[pair])
            for edge, salt in ((np.flatnonzero(place == 0), 303), (np.flatnonzero(place == np.repeat(k, k) - 1), 404)):
                ids.append(mix(h[edge] + np.uint64(salt)) & mask)
                where.append(line[edge])
        where = np.concatenate(where)
        weight = np.ones(len(where))
        weight[dense_rows:] = (LONG / np.maximum(self.words, LONG))[where[dense_rows:]]
        return where, np.concatenate(ids).astype(np.int64), weight

    # tokens: runs without white space

    @cached_property
    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        t = np.zeros(len(self.b.cp) + 2, np.int8)
        t[1:-1] = (self.b.flags & SPACE) == 0
        d = np.diff(t)
        return np.flatnonzero(d == 1), np.flatnonzero(d == -1)

    @cached_property
    def link_chars(self) -> np.ndarray:
        """Characters of addresses, host names, hash tags and bracketed tags."""
        s, e = self.tokens
        cp = self.b.cp
        if not len(s):
            return np.zeros(self.n, np.int64)
        at = lambda k: np.concatenate([cp[k:], np.zeros(min(k, len(cp)), np.uint32)])
        span = lambda m: (r := running(m))[e] - r[s]
        proto = span((cp == 58) & (at(1) == 47) & (at(2) == 47)) > 0
        www = span((cp == 119) & (at(1) == 119) & (at(2) == 119) & (at(3) == 46)) > 0
        letter = ((self.b.flags & LETTER) > 0) & (cp < 128) & ((self.b.flags & UPPER) == 0)
        dot = (cp == 46) & np.concatenate([[False], letter[:-1]]) & np.concatenate([letter[1:], [False]])
        inner = letter | (cp == 46) | (cp == 45) | ((cp >= 48) & (cp <= 57))
        host = (span(dot) > 0) & (span(~inner) == 0)
        tag = (e - s > 2) & ((cp[s] == 35) | ((cp[s] == 60) & (span(cp == 62) > 0)))
        r = running(np.where(proto | www | host | tag, e - s, 0))
        return r[np.searchsorted(s, self.e)] - r[np.searchsorted(s, self.s)]
