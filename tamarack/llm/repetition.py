"""Problem 6: repetition inside one document.

Every run of 3 and of 8 words is an event: its hash, and whether it stands in its record for the first, the second or a
later time. Two multinomials over these hashed runs are fitted to the corpus. The trusted target is the records whose
vocabulary is as rich as that of the richest quarter of the records of like length (different words over all words, which
knows no runs); the raw corpus is all records. A record's log-likelihood ratio between them, divided by its number of events, tells how
far it departs from unrepetitive text. Below zero it is nearer to the raw corpus: the threshold is fixed there and applied to
every record. The exact share of repeated words, from the same pass, then confirms the cases among the records the ratio picks.
A record with two fifths of repeated words has at least one recurring run of eight in twenty places, each worth several
nats against it where the trusted records hardly repeat; where most records of a length do, the ratio can miss some.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.arrays import TextBatch, mapped, mix

GRAMS = (3, 8)
HASHES, TIMES = 16, 3
"""Hash buckets of the runs, and how often a run has stood in the record: first, second, later."""
EVENTS = len(GRAMS) * HASHES * TIMES
RUN = 8


def recurrences(b: TextBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each run of k words, its hash, and how many times the same run began before in its text."""
    at, h = b.ngram_hash(k)
    key = mix(h ^ mix(b.word_doc[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(new)
    times = np.empty(len(at), np.int64)
    times[order] = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate([first, [len(at)]])))
    return at, h, times


def measure(b: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: words, different words, words in a run of eight that began before, and counts of events."""
    n = b.n
    a, z = b.word_range
    size = HASHES * TIMES
    events = np.zeros((n, EVENTS), np.int64)
    covered = np.zeros(n, np.int64)
    for g, k in enumerate(GRAMS):
        at, h, times = recurrences(b, k)
        doc = b.word_doc[at]
        event = (h % np.uint64(HASHES)).astype(np.int64) * TIMES + np.minimum(times, TIMES - 1)
        events[:, g * size : (g + 1) * size] = np.bincount(doc * size + event, minlength=n * size).reshape(n, -1)
        if k == RUN:
            mark = np.zeros(len(b.word_hash) + 1, np.int64)
            np.add.at(mark, at[times > 0], 1)
            np.add.at(mark, at[times > 0] + k, -1)
            covered = np.bincount(b.word_doc[np.cumsum(mark[:-1]) > 0], minlength=n)
    _, _, times = recurrences(b, 1)
    return z - a, np.bincount(b.word_doc[times == 0], minlength=n), covered, events


def repetition_table(df: DataFrame) -> DataFrame:
    """(rec_id, n_words, n_distinct, n_repeated, events) of each record; a null or empty text has zeros."""

    def make(b, kept):
        import pyarrow as pa

        words, distinct, covered, events = measure(b)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.n + 1) * EVENTS, pa.int32()), pa.array(events.ravel(), pa.int32()))
        return [kept[0], words, distinct, covered, lists]

    return mapped(df, "text", ["rec_id"], "rec_id bigint, n_words int, n_distinct int, n_repeated int, events array<int>", make)


def repetition(df: DataFrame) -> DataFrame:
    """(rec_id, n_words, repeated_share, llr, n_repeated): share of words in repeated runs, and the length-normalised ratio.

    Null and empty texts have share 0 and ratio 0.
    """
    from tamarack.plans.stage import written

    t = written(repetition_table(df), "repetition")
    rich = F.col("n_distinct") / F.col("n_words")
    like = F.floor(F.log2("n_words"))
    # One row for each power of two.
    usual = {r["b"]: r["m"] for r in t.where("n_words > 0").groupBy(like.alias("b")).agg(F.percentile_approx(rich, 0.75, 1000).alias("m")).collect()}
    usual = F.create_map(*[F.lit(x) for kv in ({-1: 2.0} | usual).items() for x in kv])
    place = t.where("n_words > 0").select((rich >= usual[like]).alias("trusted"), F.posexplode("events").alias("e", "c")).where("c > 0")
    # One row for each of the EVENTS events comes to the driver, whatever the corpus.
    sums = {
        r["e"]: (r["t"], r["r"])
        for r in place.groupBy("e").agg(F.sum(F.when(F.col("trusted"), F.col("c")).otherwise(0)).alias("t"), F.sum("c").alias("r")).collect()
    }
    weight, size = [], HASHES * TIMES
    for g in range(len(GRAMS)):
        own = range(g * size, (g + 1) * size)
        p, q = (np.array([sums.get(e, (0, 0))[j] + 0.5 for e in own]) for j in (0, 1))
        weight += list(np.log(p / p.sum()) - np.log(q / q.sum()))
    w = F.array(*map(F.lit, map(float, weight)))
    total = F.aggregate("events", F.lit(0), lambda a, x: a + x)
    ratio = F.aggregate(F.zip_with("events", w, lambda c, x: c * x), F.lit(0.0), lambda a, x: a + x)
    return t.select(
        "rec_id", "n_words",
        (F.col("n_repeated") / F.greatest("n_words", F.lit(1))).alias("repeated_share"),
        (ratio / F.greatest(total, F.lit(1))).alias("llr"), "n_repeated",
    )


def repetitive(df: DataFrame) -> DataFrame:
    """(rec_id) of the records that the ratio picks and whose repeated share is two fifths or more."""
    return repetition(df).where("llr < 0 AND n_repeated * 5 >= n_words * 2 AND n_words > 0").select("rec_id")
