"""Problem 4: lines repeated across one site's documents, found by content-defined chunks.

Each text is normalised and cut where a rolling hash over 16 characters falls on a fixed pattern; a line feed is a
content-defined cut too, so that a short line is a chunk of its own. The same line therefore has the same chunks in
every document. Distinct documents are counted per site and chunk, batches being summed before the shuffle. A line can
only be frequent if each of its chunks is, so one chunk of a line (the one of least hash) chooses the candidates, and the
exact count per whole line follows on those alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.arrays import DIGIT, LETTER, SPACE, TextBatch, mapped, mix, running, span_hash, tables

MIN_DOCS, MIN_SHARE = 5, 0.04
CUT_BITS = 6
"""A cut about every 2**6 characters within a line."""
TRAIL = ".,:;!?… "


def site_of(url: Column) -> Column:
    """Host of the address in lower case, without port and leading ``www.``; null without a host."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


class Normal:
    """Normalised lines of a batch and their chunks."""

    def __init__(self, b: TextBatch):
        v, flags = b.lower.copy(), b.flags
        digit = (flags & DIGIT) > 0
        feed = b.cp == 10
        blank = ((flags & SPACE) > 0) & ~feed
        v[digit], v[blank] = 48, 32
        before = lambda m: np.concatenate([[False], m[:-1]])
        keep = ~(digit & before(digit)) & ~(blank & (before(blank) | np.concatenate([[True], feed[:-1]])))
        s, e, doc, no = b.lines
        solid = ~np.isin(v, np.array([ord(c) for c in TRAIL]))
        last = np.maximum.accumulate(np.where(solid & ~feed, np.arange(len(v)), -1)) if len(v) else np.zeros(0, np.int64)
        tail = np.where(e > s, last[np.maximum(e - 1, 0)] if len(v) else -1, -1) + 1
        drop = np.zeros(len(v) + 1, np.int64)
        np.add.at(drop, np.maximum(tail, s), 1)
        np.add.at(drop, e, -1)
        keep &= np.cumsum(drop[:-1]) == 0
        at = running(keep)
        letter = running((flags & LETTER) > 0)
        ok = (letter[e] > letter[s]) & (at[e] > at[s])
        self.s, self.e, self.doc, self.no = at[s][ok], at[e][ok], doc[ok], no[ok]
        self.place = np.flatnonzero(keep)
        """Of each normalised character, its place in the batch."""
        self.line_start, self.line_end = s[ok], e[ok]
        self.v = v[keep]
        self.gear = tables()[2][self.v]

    def line_hash(self) -> np.ndarray:
        return span_hash(self.gear, self.s, self.e)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, hash and first chunk of each line's chunks."""
        line, starts, ends = self.cuts()
        return line, span_hash(self.gear, starts, ends), np.flatnonzero(np.diff(np.concatenate([[-1], line])) > 0)

    def cuts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, start and end of each chunk."""
        h = (self.gear >> np.uint64(32)).astype(np.uint32)
        for k in (1, 2, 4, 8):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if len(h) > k else h[k:]
        cut = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0)
        line = np.searchsorted(self.s, cut, "right") - 1
        ok = (line >= 0) & (cut - 15 >= self.s[np.maximum(line, 0)]) & (cut + 1 < self.e[np.maximum(line, 0)])
        starts = np.concatenate([self.s, cut[ok] + 1])
        line = np.concatenate([np.arange(len(self.s)), line[ok]])
        order = np.argsort(starts, kind="stable")
        starts, line = starts[order], line[order]
        ends = np.concatenate([np.minimum(starts[1:], self.e[line[:-1]]), self.e[-1:]])
        return line, starts, ends


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def chunk_counts(df: DataFrame) -> DataFrame:
    """(site, chunk, n): distinct documents of each chunk, summed over one slice of a task."""

    def make(b, kept):
        t = Normal(b)
        if not len(t.s):
            return [[], [], []]
        site = kept[0].to_numpy(zero_copy_only=False)
        line, h, _ = t.chunks()
        doc = t.doc[line]
        key = mix(h ^ mix(site[doc].view(np.uint64)))
        order = np.lexsort((doc, key))
        k, d = key[order], doc[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
        pick = order[new]
        k = key[pick]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return [site[doc[pick[first]]], _signed(h[pick[first]]), np.diff(np.concatenate([first, [len(k)]]))]

    return mapped(df, "text", ["site"], "site bigint, chunk bigint, n int", make)


def line_keys(df: DataFrame) -> DataFrame:
    """(rec_id, line_no, site, line, chunk) of each line with a letter; chunk is its chunk of least hash."""

    def make(b, kept):
        t = Normal(b)
        if not len(t.s):
            return [[], [], [], [], []]
        site = kept[1].to_numpy(zero_copy_only=False)
        _, h, first = t.chunks()
        return [kept[0].take(t.doc), t.no, site[t.doc], _signed(t.line_hash()), _signed(np.minimum.reduceat(h, first))]

    return mapped(df, "text", ["rec_id", "site"], "rec_id bigint, line_no int, site bigint, line bigint, chunk bigint", make)


def with_site(df: DataFrame) -> DataFrame:
    return df.select("rec_id", "text", F.xxhash64(site_of(F.col("url"))).alias("site"))


def often_chunks(df: DataFrame, min_docs: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    """(site, chunk) that stand in so many distinct documents of their site, and (site, least) of the sites."""
    sites = df.groupBy("site").agg(F.greatest(F.lit(min_docs), F.ceil(F.round(F.count("*") * F.lit(min_share), 6))).alias("least"))
    n = chunk_counts(df).groupBy("site", "chunk").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    return n.join(sites, "site").where("n >= least").select("site", "chunk"), sites


def repeated_lines(df: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(rec_id, line_no) of every occurrence of a line that stands in at least ``min_docs`` records and in at least
    ``min_share`` of all records of its site.

    All records of a site count, those with null texts too; records whose url has no host form one site. rec_id must be
    unique for the counts to be of records. An empty table gives no rows.
    """
    df = with_site(df)
    often, sites = often_chunks(df, min_docs, min_share)
    from tamarack.plans.stage import written

    # The candidates are used twice, for the count and for the rows.
    near = written(line_keys(df).join(often, ["site", "chunk"], "left_semi").drop("chunk"), "lines")
    per = near.select("site", "line", "rec_id").distinct().groupBy("site", "line").agg(F.count("*").alias("n"))
    lines = per.where(F.col("n") >= min_docs).join(sites, "site").where("n >= least").select("site", "line")
    return near.join(lines, ["site", "line"], "left_semi").select("rec_id", "line_no")


def cut_texts(df: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(rec_id, text, n_cut): each record's text without the chunks repeated excessively in its site, and how many were cut.

    A line of which all chunks go leaves no blank line behind; of other lines the rest stays, a sentence repeated inside longer lines goes
    with the chunks that hold it. Null texts stay null with 0 cuts; rec_id must be unique. Every text is written once, and a record's own cuts meet it by its id.
    """
    d = with_site(df)
    often, _ = often_chunks(d, min_docs, min_share)

    def make(b, kept):
        t = Normal(b)
        if not len(t.s):
            return [[], [], [], [], []]
        site = kept[1].to_numpy(zero_copy_only=False)
        line, starts, ends = t.cuts()
        doc = t.doc[line]
        last = np.concatenate([line[1:] != line[:-1], [True]])
        first = np.concatenate([[True], last[:-1]])
        a = np.where(first, t.line_start[line], t.place[starts])
        z = np.where(last, t.line_end[line] + 1, t.place[np.minimum(ends, len(t.place) - 1)])
        return [kept[0].take(doc), site[doc], _signed(span_hash(t.gear, starts, ends)), a - b.start[doc], z - b.start[doc]]

    spans = mapped(d, "text", ["rec_id", "site"], "rec_id bigint, site bigint, chunk bigint, a int, z int", make)
    spans = spans.join(often, ["site", "chunk"], "left_semi").groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("cuts"))
    j = df.select("rec_id", "text").join(spans, "rec_id", "left")
    # What stands between the cuts, in order; the last piece may end with the line feed before a cut line.
    kept = F.expr(
        "aggregate(cuts, struct('' AS t, 0 AS at), (s, c) -> struct(concat(s.t, substring(text, s.at + 1, greatest(c.a - s.at, 0))) AS t, greatest(s.at, c.z) AS at), "
        "s -> concat(s.t, substring(text, s.at + 1)))"
    )
    return j.select("rec_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.rtrim(kept, F.lit("\n"))).alias("text"), F.coalesce(F.size("cuts"), F.lit(0)).alias("n_cut"))
