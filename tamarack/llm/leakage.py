"""Problem 8: evaluation texts in the corpus, by suffix arrays over shards of the corpus.

A shard is the texts of one slice. Markup tags are dropped and everything but letters and digits, so that case,
punctuation, white space and breaks within a word cannot part a passage; suffixes begin where words begin. The shard's
suffixes are sorted by their leading characters, every suffix of every test item is located among them by binary search,
and with each corpus suffix met the longest common prefix is measured on the whole text. Twelve consecutive words of an
item in one match are a leak. An item with one word in eight altered still has a run of so many unaltered words that such
a run meets it (pigeonhole); documents met by a run that long are aligned with the whole item by words.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.arrays import DIGIT, LETTER, TextBatch, mapped, running

VERBATIM = 12
ALTERED = 8
"""One word in so many may be altered."""
MOST_ITEMS = 100_000
"""Test items kept in memory on an executor at once; a larger set is searched for in parts."""
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_ANY_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
"""Longer tags and those over several lines. Prose between two signs looks alike, so such a text is read both ways."""
KEY = 10
"""Characters in one sort key, 6 bits each; two keys make the order."""


def least_run(n: int) -> int:
    """The longest run of unaltered words that an item of n words is sure to keep."""
    a = n // ALTERED
    return min(VERBATIM, -(-(n - a) // (a + 1))) if n > a else 1


class Letters:
    """Letters and digits of a batch in one row, texts kept apart, with the places where words begin.

    What ``tag`` matches is passed over as if it were not there.
    """

    def __init__(self, texts: list[str | None], tags: list[re.Pattern] | None = None):
        b = TextBatch(texts)
        live = np.ones(len(b.cp), bool)
        for i, t in enumerate(b.texts):
            if "<" in t:
                for m in (tags[i] if tags else _TAG).finditer(t):
                    live[b.start[i] + m.start() : b.start[i] + m.end()] = False
        shown = np.flatnonzero(live)
        keep = (b.flags[shown] & (LETTER | DIGIT)) > 0
        self.v = b.lower[shown][keep]
        self.place = shown[keep]
        """Of each letter, its place in the batch; less ``origin`` of its text, in the text."""
        self.origin = b.start
        at = running(keep)
        seen = running(live)
        self.start, self.end = at[seen[b.start]], at[seen[b.end]]
        first = keep & ~np.concatenate([[False], keep[:-1]])
        self.words = at[:-1][first] if len(shown) else np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.start, self.words, "right") - 1
        # Empty texts share their start with the next; the last of them owns the words.
        self.stop = self.end[self.doc] if len(self.words) else self.words

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The first characters of each suffix as two numbers; beyond the text's end they are zero."""
        code = np.where(self.v < 97, self.v % 61 + 1, np.where(self.v < 123, self.v - 96 + 26, self.v % 61 + 1)).astype(np.uint64)
        code = np.concatenate([code, np.zeros(2 * KEY, np.uint64)])
        out = []
        for k in (0, KEY):
            x = np.zeros(len(self.words), np.uint64)
            for i in range(k, k + KEY):
                x = x << np.uint64(6) | np.where(self.words + i < self.stop, code[self.words + i], np.uint64(0))
            out.append(x)
        return out[0], out[1]

    def tokens(self, doc: int, a: int = 0, z: int | None = None) -> list[str]:
        """Words a to z of a text."""
        s, e = np.searchsorted(self.doc, doc), np.searchsorted(self.doc, doc, "right")
        e2 = e if z is None else min(e, s + z)
        cuts = self.words[s + a : e2 + 1].tolist() if e2 < e else [*self.words[s + a : e].tolist(), int(self.end[doc])]
        if len(cuts) < 2:
            return []
        row = self.v[cuts[0] : cuts[-1]].tobytes().decode("utf-32-le", "surrogatepass")
        return [row[x - cuts[0] : y - cuts[0]] for x, y in zip(cuts, cuts[1:])]


def _before(a1, a2, b1, b2, or_equal: bool):
    return (a1 < b1) | (a1 == b1) & ((a2 <= b2) if or_equal else (a2 < b2))


def _bound(s1, s2, q1, q2, upper: bool) -> np.ndarray:
    """Binary search of all queries at once in the sorted pairs of keys."""
    lo, hi = np.zeros(len(q1), np.int64), np.full(len(q1), len(s1), np.int64)
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        m = np.minimum(mid, len(s1) - 1)
        go = _before(s1[m], s2[m], q1, q2, upper) & (lo < hi)
        lo, hi = np.where(go, mid + 1, lo), np.where(go | (lo >= hi), hi, mid)
    return lo


def _common(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffixes i of a and j of b."""
    n = np.minimum(a.stop[i] - a.words[i], b.stop[j] - b.words[j])
    out, live = np.zeros(len(i), np.int64), np.arange(len(i))
    step = 16
    while len(live):
        k = out[live][:, None] + np.arange(step)
        ok = k < n[live][:, None]
        x = a.v[np.minimum(a.words[i[live]][:, None] + k, len(a.v) - 1)]
        y = b.v[np.minimum(b.words[j[live]][:, None] + k, len(b.v) - 1)]
        same = (x == y) & ok
        run = np.where(same.all(1), step, same.argmin(1))
        out[live] += run
        live = live[run == step]
    return out


def altered_words(item: list[str], doc: list[str], limit: int) -> bool:
    """Whether the item lies in the words with at most ``limit`` of its words altered, dropped or put in between.

    A word of the item may stand broken in two in the document at no cost.
    """
    there = {*doc, *(x + y for x, y in zip(doc, doc[1:]))}
    if sum(t not in there for t in item) > limit:
        return False
    best = list(range(len(item) + 1))
    older = None
    for d, w in enumerate(doc):
        row = [0] * (len(item) + 1)
        joined = doc[d - 1] + w if d else ""
        for i, t in enumerate(item, 1):
            c = best[i - 1] + (t != w)
            if best[i] + 1 < c:
                c = best[i] + 1
            if row[i - 1] + 1 < c:
                c = row[i - 1] + 1
            if older is not None and t == joined and older[i - 1] < c:
                c = older[i - 1]
            row[i] = c
        if row[-1] <= limit:
            return True
        older, best = best, row
    return False


class Items:
    """Test items, ready to be searched for."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids, self.letters = ids, Letters(texts)
        t = self.letters
        self.first = np.searchsorted(t.doc, np.arange(len(ids)))
        self.count = np.searchsorted(t.doc, np.arange(len(ids)), "right") - self.first
        self.run = np.array([least_run(int(n)) for n in self.count])
        self.ends = np.concatenate([t.words, [len(t.v)]])
        last = np.concatenate([t.words[1:], t.end[-1:]]) if len(t.words) else t.words
        self.word_end = np.minimum(last, t.stop)
        # Suffixes with room for a run of the least length, and the fewest characters such a run has.
        place = np.arange(len(t.words)) - self.first[t.doc]
        self.use = np.flatnonzero(place + self.run[t.doc] <= self.count[t.doc]) if len(t.words) else np.zeros(0, np.int64)
        # Every suffix is located by as many characters as its own shortest run has, so a short item widens no other's range.
        size = self.word_end[self.use + self.run[t.doc[self.use]] - 1] - t.words[self.use] if len(self.use) else np.zeros(0, np.int64)
        self.low, self.high = [], []
        for k, x in enumerate(t.keys()):
            known = np.clip(size - k * KEY, 0, KEY)
            free = (np.uint64(1) << (6 * (KEY - known)).astype(np.uint64)) - np.uint64(1)
            self.low.append(x[self.use] & ~free)
            self.high.append(x[self.use] | free)

    def found_in(self, texts: list[str | None], tags: list[re.Pattern] | None = None) -> list[tuple[int, int, int, int, int, bool]]:
        """(text number, item id, start, length, words, whole) of each pair of text and leaked item.

        Start and length, in characters of the text, are those of the longest verbatim match, ``words`` its words of the item;
        ``whole``: all of the item is there with few words altered.
        """
        c, t = Letters(texts, tags), self.letters
        if not len(c.words) or not len(self.use):
            return []
        k1, k2 = c.keys()
        order = np.lexsort((k2, k1))
        s1, s2 = k1[order], k2[order]
        lo, hi = _bound(s1, s2, *self.low, False), _bound(s1, s2, *self.high, True)
        n = hi - lo
        q = np.repeat(self.use, n)
        at = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        length = _common(t, q, c, at)
        item = t.doc[q]
        # Whole words of the item in the match.
        words = np.searchsorted(self.word_end, t.words[q] + length, "right") - q
        pair = c.doc[at].astype(np.int64) * len(self.ids) + item
        leak = dict.fromkeys(pair[words >= np.minimum(VERBATIM, self.count[item])].tolist(), False)
        for p in sorted(set(pair[words >= self.run[item]].tolist()) - set(leak)):
            d, i = divmod(p, len(self.ids))
            n_words = int(self.count[i])
            here = at[(pair == p) & (words >= self.run[item])]
            base = int(np.searchsorted(c.doc, d))
            mine = t.tokens(i)
            from_item = q[(pair == p) & (words >= self.run[item])] - self.first[i]
            seen: set[int] = set()
            for w, k in sorted(zip((here - base).tolist(), from_item.tolist())):
                a = max(0, w - k - n_words // 4 - 2)
                if a // 4 in seen:
                    continue
                seen.add(a // 4)
                if altered_words(mine, c.tokens(d, a, a + n_words + n_words // 2 + 4), n_words // ALTERED):
                    leak[p] = True
                    break
        # The longest match of each pair.
        order = np.lexsort((c.words[at], -words, pair))
        first = order[np.concatenate([[True], pair[order][1:] != pair[order][:-1]])] if len(order) else order
        out = []
        for j in first.tolist():
            p = int(pair[j])
            if p in leak:
                d, a, z = int(c.doc[at[j]]), int(c.words[at[j]]), int(c.words[at[j]] + length[j])
                begin = int(c.place[a])
                out.append((d, self.ids[p % len(self.ids)], begin - int(c.origin[d]), int(c.place[z - 1]) + 1 - begin, int(words[j]), leak[p]))
        return out


SCHEMA = "doc_id bigint, item_id bigint, start int, length int, words int, whole boolean"


def matches(docs: DataFrame, items: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """SCHEMA: every document that holds twelve consecutive words of an item, or the whole item with at most one word in eight
    altered, with the place of the longest verbatim match; an item of fewer than twelve words must be there whole.

    The items are collected, ``most`` at once; the corpus is not. Null and empty texts on either side match nothing; repeated
    rows of a document give repeated rows.
    """
    rows = items.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct()
    parts = -(-rows.count() // most)
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        part.sort()
        got = _searched(docs, [r["item_id"] for r in part], [r["text"] for r in part])
        found = got if k == 0 else found.unionByName(got)
    return found


def _searched(docs: DataFrame, ids: list[int], texts: list[str]) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast((ids, texts))
    held: list[Items] = []

    def make(b, kept):
        import pyarrow as pa

        if not held:
            held.append(Items(*known.value))
        texts, tags, of = list(b.texts), [_TAG] * b.n, list(range(b.n))
        for i, t in enumerate(b.texts):
            if "<" in t and len(_ANY_TAG.findall(t)) > len(_TAG.findall(t)):
                texts.append(t)
                tags.append(_ANY_TAG)
                of.append(i)
        best: dict[tuple[int, int], tuple] = {}
        for d, item, *rest in held[0].found_in(texts, tags):
            key = of[d], item
            if key not in best or rest[2] > best[key][2]:
                best[key] = tuple(rest)
        at = sorted(best)
        cols = list(zip(*(best[k] for k in at))) if at else [[]] * 4
        return [kept[0].take(pa.array([k[0] for k in at], pa.int64())), [k[1] for k in at], *(list(x) for x in cols)]

    return mapped(docs, "text", ["doc_id"], SCHEMA, make)


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of ``matches``, each once."""
    return matches(docs, items).select("doc_id", "item_id").distinct()


def cleaned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns, without those that hold an item; rows with a null doc_id stay."""
    return docs.join(leaked(docs, items).select("doc_id").distinct(), "doc_id", "left_anti")
