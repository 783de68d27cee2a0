"""Problems 1, 3 and 5: what a page consists of, from one pass over its lines.

``page_table`` reads the text once. It labels the lines (problem 3), measures the content lines (problem 5) and counts
how often words occur in them (problem 1); nothing but these figures leaves the pass, so what is shuffled later does not
grow with the length of the texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import furniture, rules
from tamarack.llm.arrays import DIGIT, LETTER, TextBatch, mapped, running
from tamarack.llm.lines import Lines, lookup

#: Figures of a page's content lines, in this order.
STATS = [
    "n_chars", "n_words", "n_lines", "mean_word_len", "symbol_ratio", "digit_ratio", "upper_ratio", "end_punct_share",
    "common_share", "words_per_line", "long_line_share", "ended_share", "marked_share", "distinct_share", "line_common", "link_share",
]
CLASSES = 10
"""Word classes of the divergence: eight rank groups of a language's function words, numbers, and all others."""
TIMES, LIFT = 3, 1000
"""A keyword's least number of occurrences in its page, over its share of prose pages."""
PAGES, KEYNESS = 10, 50
"""Suspect pages with a keyword, and their share over its share of prose pages."""
KEY_SHARE, LINK_SHARE = 0.3, 0.35
"""Share of a line's word characters that keywords, and of all its characters that addresses and tags, must fill."""


def stats(lines: Lines, content: np.ndarray) -> np.ndarray:
    """The figures of STATS, one row for each text of the batch; a text without content lines has zeros."""
    n = lines.b.n
    d = lines.doc[content]
    add = lambda x: np.bincount(d, x[content].astype(float), n)
    chars, words, count = add(lines.chars), add(lines.words), np.bincount(d, minlength=n)
    of = lambda x, y: x / np.maximum(y, 1)
    return np.stack(
        [
            chars, words, count, of(add(lines.word_chars), words), of(add(lines.symbols), chars), of(add(lines.digits), chars),
            of(add(lines.uppers), add(lines.letters)), of(add(lines.ends_sentence), count), of(add(lines.common), words),
            of(words, count), of(add(lines.chars * (lines.words >= 8)), chars), of(add(lines.chars * lines.ends_sentence), chars),
            of(add(lines.chars * lines.marked), chars), of(distinct_words(lines, content), words),
            of(add(lines.chars * lines.common / np.maximum(lines.words, 1)), chars), of(add(np.minimum(lines.link_chars, lines.chars)), chars),
        ],
        1,
    )


def content_words(lines: Lines, content: np.ndarray) -> np.ndarray:
    """Numbers of the words that stand in content lines."""
    ws, we = lines.word_span
    take = np.zeros(len(lines.b.word_hash) + 1, np.int64)
    np.add.at(take, ws[content], 1)
    np.add.at(take, we[content], -1)
    return np.flatnonzero(np.cumsum(take[:-1]) > 0)


def distinct_words(lines: Lines, content: np.ndarray) -> np.ndarray:
    """Different words in the content of each text."""
    at = content_words(lines, content)
    doc, h = lines.b.word_doc[at], lines.b.word_hash[at]
    order = np.lexsort((h, doc))
    d, k = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return np.bincount(d[new], minlength=lines.b.n)


def word_classes(batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its place in the list of function words (-1: none), and the language of each text by them."""
    t = lookup()
    h = batch.word_hash
    at = np.searchsorted(t["common"], h)
    at[at == len(t["common"])] = 0
    at = np.where(t["common"][at] == h, at, -1)
    hit = at >= 0
    votes = np.zeros((batch.n, len(t["langs"])))
    for i in range(len(t["langs"])):
        votes[:, i] = np.bincount(batch.word_doc[hit], t["by_lang"][i][at[hit]], batch.n)
    return at, votes.argmax(1), votes.max(1)


def curves(lines: Lines, content: np.ndarray):
    """Frequency spectrum and word classes of each page's content.

    Of a page: for each frequency that occurs, how many different words have it. Words of equal frequency share their
    middle rank, so the rank-frequency curve follows from the spectrum alone.
    """
    b = lines.b
    n = b.n
    at = content_words(lines, content)
    doc, h = b.word_doc[at], b.word_hash[at]
    order = np.lexsort((h, doc))
    d, k = doc[order], h[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]) if len(d) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    freq = np.diff(np.concatenate([first, [len(d)]]))
    pair, size = np.unique(d[first].astype(np.int64) << 32 | freq, return_counts=True)
    classes, lang, _ = word_classes(b)
    t = lookup()
    rank = np.full((len(t["langs"]), len(t["common"]) + 1), CLASSES - 1)
    for i in range(len(t["langs"])):
        own = np.flatnonzero(t["by_lang"][i])
        rank[i, own] = np.arange(len(own)) % 8
    cls = rank[lang[doc], classes[at]]
    number = (b.flags[b.words[0][at]] & DIGIT) > 0
    cls = np.where(number, CLASSES - 2, cls)
    counts = np.bincount(doc * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES)
    return pair >> 32, pair & 0xFFFFFFFF, size, lang, counts


_WORDS = "words:array<struct<h:int,n:int,k:int>>"
SCHEMA = (
    "rec_id bigint, is_null boolean, " + ", ".join(f"{s} double" for s in STATS)
    + f", lang_guess string, freqs array<int>, sizes array<int>, classes array<int>, furniture array<int>, vocab array<int>, lines array<struct<c:int,link:boolean,w:int,{_WORDS}>>"
)


def _nested(values: np.ndarray, counts: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


def known_words(lines: Lines, content: np.ndarray, prose: np.ndarray):
    """Of prose the different words of its content; of other pages each content line with its words.

    Words of fewer than three letters and those with digits are left out: they name nothing. A word is (hash, characters,
    times in the page's content).
    """
    import pyarrow as pa

    b = lines.b
    ws, we = b.words
    letters, digits = running((b.flags & LETTER) > 0), running((b.flags & DIGIT) > 0)
    wordy = (letters[we] - letters[ws] >= 3) & (digits[we] == digits[ws])
    at = content_words(lines, content)
    at = at[wordy[at]]
    h = (b.word_hash[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    doc = b.word_doc[at]
    order = np.lexsort((h, doc))
    d, k = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    first = np.flatnonzero(new)
    times = np.empty(len(d), np.int64)
    times[order] = np.repeat(np.diff(np.concatenate([first, [len(d)]])), np.diff(np.concatenate([first, [len(d)]])))
    kept = first[prose[d[first]]]
    vocab = _nested(k[kept], np.bincount(d[kept], minlength=b.n))
    row = np.flatnonzero(content & ~prose[lines.doc])
    # Words of those lines: places in ``at``, which lie in the order of the text.
    lo, hi = np.searchsorted(at, lines.word_span[0][row]), np.searchsorted(at, lines.word_span[1][row])
    n = hi - lo
    pick = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    word = pa.StructArray.from_arrays(
        [pa.array(h[pick], pa.int32()), pa.array((we - ws)[at[pick]], pa.int32()), pa.array(times[pick], pa.int32())], ["h", "n", "k"]
    )
    words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), word)
    link = lines.link_chars[row] >= LINK_SHARE * np.maximum(lines.chars[row], 1)
    line = pa.StructArray.from_arrays(
        [pa.array(lines.chars[row], pa.int32()), pa.array(link), pa.array(lines.word_chars[row], pa.int32()), words], ["c", "link", "w", "words"]
    )
    per = np.bincount(lines.doc[row], minlength=b.n)
    return vocab, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), line)


def prosaic(x: np.ndarray) -> np.ndarray:
    """Whether no rule of problem 5 holds; a page without content is prose."""
    learned = rules.load()
    return ~np.any([rules.covers(r, x) for r in learned], 0) | (x[:, 0] == 0) if learned else np.ones(len(x), bool)


def page_table(df: DataFrame, key: str = "rec_id", text: str = "text", want_curves: bool = True, want_lines: bool = False, want_words: bool = False) -> DataFrame:
    """One row for each record: figures of its content, its frequency spectrum, its furniture lines, its words.

    A null text gives zeros, empty arrays and ``is_null``; an empty one the same without it. Repeated keys give repeated
    rows. Columns of ``df`` besides key and text are not read, so their names cannot clash.
    """

    def make(batch, kept):
        lines = Lines(batch)
        lab = furniture.decode(lines)
        content = lab == 0
        n = batch.n
        if want_curves:
            doc, f, size, lang, classes = curves(lines, content)
            per = np.bincount(doc, minlength=n)
        else:
            lang = word_classes(batch)[1]
            f = size = np.zeros(0, np.int32)
            per, classes = np.zeros(n, np.int64), np.zeros((n, 0), np.int32)
        out = lines.no[~content] if want_lines else np.zeros(0, np.int32)
        held = np.bincount(lines.doc[~content], minlength=n) if want_lines else np.zeros(n, np.int64)
        names = np.array(lookup()["langs"], object)
        x = stats(lines, content)
        vocab, rows = known_words(lines, content, prosaic(x)) if want_words else ([[]] * n, [[]] * n)
        return [
            kept[0], batch.null, *x.T, names[lang], _nested(f, per), _nested(size, per),
            _nested(classes.ravel(), np.full(n, classes.shape[1])), _nested(out, held), vocab, rows,
        ]

    return mapped(df, text, [key], SCHEMA, make)


def quality(pages: DataFrame) -> DataFrame:
    """Problem 5: adds ``rule``, the first rule of the learned list that calls the page no prose, or 0."""
    return pages.withColumn("rule", F.when(F.col("is_null") | (F.col("n_chars") == 0), F.lit(0)).otherwise(F.expr(rules.case())))


def rank_curves(pages: DataFrame) -> DataFrame:
    """Problem 1: slope and residual of each page's rank-frequency curve, and its divergence from like prose.

    log frequency over log rank is fitted by weighted least squares in SQL: a window over each page's spectrum gives the
    ranks. Pages are compared with prose of the same language and a like number of words (powers of two): medians and
    quartiles for the fit, the mean share of each word class for the Kullback-Leibler divergence. A page without words
    has null figures. ``pages`` is a written table with ``rule`` and ``pid``.
    """
    base = pages.where("n_words > 0").withColumn("bucket", F.floor(F.log2(F.col("n_words"))).cast("int"))
    base = base.select("pid", "rec_id", "lang_guess", "bucket", "n_words", "rule", "freqs", "sizes", "classes")
    # The window runs inside the row's own spectrum: ranks by a running sum over frequencies in falling order.
    long = base.select("pid", F.explode(F.arrays_zip("freqs", "sizes")).alias("z")).select("pid", F.col("z.freqs").alias("f"), F.col("z.sizes").alias("n"))
    from pyspark.sql import Window as W

    w = W.partitionBy("pid").orderBy(F.desc("f"))
    ranked = long.withColumn("hi", F.sum("n").over(w)).select(
        "pid", F.col("n").cast("double").alias("n"), F.log("f").alias("y"), F.log(F.col("hi") - (F.col("n") - 1) / 2).alias("x")
    )
    fit = ranked.groupBy("pid").agg(
        F.sum("n").alias("s"), F.sum(F.expr("n*x")).alias("sx"), F.sum(F.expr("n*y")).alias("sy"), F.sum(F.expr("n*x*x")).alias("sxx"),
        F.sum(F.expr("n*x*y")).alias("sxy"), F.sum(F.expr("n*y*y")).alias("syy"),
    )
    fit = fit.withColumn("vx", F.expr("s*sxx - sx*sx")).select(
        "pid",
        F.expr("CASE WHEN vx > 1e-9 THEN (s*sxy - sx*sy)/vx ELSE 0D END").alias("slope"),
        F.expr("sqrt(greatest(0D, CASE WHEN vx > 1e-9 THEN (s*syy - sy*sy)/(s*s) - pow(s*sxy - sx*sy, 2)/(vx*s*s) ELSE 0D END))").alias("residual"),
    )
    return base.drop("freqs", "sizes").join(fit, "pid")


def judged_curves(pages: DataFrame) -> DataFrame:
    """``rank_curves`` with divergence, the like pages' figures and ``extreme``.

    Like pages are prose by the rules of problem 5; where a language has none of that length, a page has nothing to agree
    with and counts as extreme.
    """
    c = rank_curves(pages)
    group = ["lang_guess", "bucket"]
    like = c.where("rule = 0").groupBy(*group).agg(
        *(F.percentile_approx(x, F.array(*map(F.lit, (0.25, 0.5, 0.75))), 1000).alias(f"q_{x}") for x in ("slope", "residual")),
        *(F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(CLASSES)),
    )
    total = sum((F.col(f"c{i}") for i in range(1, CLASSES)), F.col("c0"))
    like = like.select(*group, "q_slope", "q_residual", F.array(*((F.col(f"c{i}") + 1.0) / (total + CLASSES) for i in range(CLASSES))).alias("q"))
    # Languages times powers of two: some hundred rows whatever the crawl's size.
    j = c.join(F.broadcast(like), group, "left")
    j = j.withColumn(
        "divergence",
        F.expr("aggregate(sequence(0, 9), 0D, (a, i) -> a + CASE WHEN classes[i] > 0 THEN classes[i]/n_words * ln(classes[i]/n_words/q[i]) ELSE 0D END)"),
    )
    out = lambda x: f"abs({x} - q_{x}[1]) > 2 * greatest(q_{x}[2] - q_{x}[0], 0.02)"
    return j.withColumn("extreme", F.expr(f"q IS NULL OR {out('slope')} OR {out('residual')} OR divergence > 0.12"))


def judged_words(pages: DataFrame, suspects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content lines of the suspect pages, word by word, and what the corpus knows of each word.

    The second table (h, rate, share, e) has for each word of the suspects the share of prose pages with it, in the language
    where it is most at home and in all, and the number of suspect pages with it. Counts are summed in every task before they
    are shuffled.
    """
    prose = pages.where("rule = 0 AND n_words > 0")
    # One row for each of the languages of the word lists.
    n = {r["lang_guess"]: r["count"] for r in prose.groupBy("lang_guess").count().collect()}
    sizes = F.create_map(*[F.lit(x) for kv in ({"-": 0} | n).items() for x in kv])
    known = prose.select("lang_guess", F.explode("vocab").alias("h")).groupBy("lang_guess", "h").agg(F.count("*").alias("c"))
    whole, none = sum(n.values()) + 1, F.lit(0.5 / (sum(n.values()) + 1))
    known = known.groupBy("h").agg(
        F.max((F.col("c") + 0.5) / (sizes[F.col("lang_guess")] + 1)).alias("rate"), ((F.sum("c") + 0.5) / whole).alias("share")
    )
    lines = suspects.select("pid", F.posexplode("lines").alias("ln", "l")).select("pid", "ln", "l.*")
    own = suspects.select(F.explode(F.array_distinct(F.expr("flatten(transform(lines, l -> transform(l.words, w -> w.h)))"))).alias("h"))
    own = own.groupBy("h").agg(F.count("*").alias("e"))
    return lines, own.join(known, "h", "left").select("h", F.coalesce("rate", none).alias("rate"), F.coalesce("share", none).alias("share"), "e")


def stuffed_pages(df: DataFrame) -> DataFrame:
    """Problem 1: (rec_id) of the pages whose curve is extreme and most of whose content is keywords, links or tags.

    The curves choose the suspects among the pages that are no prose. The words of these diverge from prose one by one: a
    word is a keyword if it stands in the page at least TIMES times and LIFT times as often as prose would have it, or if
    it stands in at least PAGES suspect pages and in KEYNESS times as large a share of them as of prose pages. So names and
    figures of tables, which nobody repeats, and the goods of an inventory, which prose knows, are none. The exact check
    asks that over half of the content's characters stand in lines of keywords, addresses or tags. Null and empty texts are
    never cases.
    """
    from tamarack.plans.stage import written

    pages = written(quality(page_table(df, want_words=True)).withColumn("pid", F.monotonically_increasing_id()), "pages")
    extreme = judged_curves(pages).where("extreme AND rule > 0").select("pid")
    # Only the lines of the few pages that are no prose move.
    suspects = written(pages.where("rule > 0").select("pid", "rec_id", "lines").join(extreme, "pid", "left_semi"), "suspects")
    n = suspects.count()
    lines, words = judged_words(pages, suspects)
    lines = lines.select("pid", "ln", "c", "link", "w", F.explode_outer("words").alias("x")).withColumn("h", F.col("x.h"))
    key = F.expr(f"x.k >= {TIMES} AND x.k >= {LIFT}D * rate OR e >= {PAGES} AND (e + 0.5D) / {n + 1}D >= {KEYNESS}D * share")
    per = lines.join(words, "h", "left").groupBy("pid", "ln").agg(
        F.first("c").alias("c"), F.first("link").alias("link"), F.first("w").alias("w"), F.sum(F.when(key, F.col("x.n")).otherwise(0)).alias("k")
    )
    bad = F.col("link") | (F.col("w") > 0) & (F.col("k") >= KEY_SHARE * F.col("w"))
    share = per.groupBy("pid").agg((F.sum(F.when(bad, F.col("c")).otherwise(0)) / F.sum("c")).alias("share"))
    return suspects.select("pid", "rec_id").join(share.where("share > 0.5"), "pid", "left_semi").select("rec_id")


def unprosaic_pages(df: DataFrame) -> DataFrame:
    """Problem 5: (rec_id) of the pages that a rule calls no prose. Null texts are never cases."""
    return quality(page_table(df, want_curves=False)).where("rule > 0").select("rec_id")


def body_cuts(df: DataFrame) -> DataFrame:
    """Problem 3: (rec_id, line_no) of the furniture of the pages that are prose."""
    p = quality(page_table(df, want_curves=False, want_lines=True)).where("rule = 0")
    return p.select("rec_id", F.explode("furniture").alias("line_no"))


def bodies(df: DataFrame) -> DataFrame:
    """Problem 3: (rec_id, body, n_cut): every record's text without its furniture, and the number of lines cut; blank lines stay only
    between lines that do. A null text has a null body."""

    def make(batch, kept):
        lines = Lines(batch)
        cut = np.flatnonzero(furniture.decode(lines) > 0)
        gone = [set() for _ in range(batch.n)]
        for d, k in zip(lines.doc[cut].tolist(), lines.no[cut].tolist()):
            gone[d].add(k)
        body = ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in g).strip("\n") for t, g in zip(batch.texts, gone)]
        return [kept[0], [None if null else x for null, x in zip(batch.null.tolist(), body)], [len(g) for g in gone]]

    return mapped(df, "text", ["rec_id"], "rec_id bigint, body string, n_cut int", make)
