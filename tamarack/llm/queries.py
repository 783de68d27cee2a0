"""Queries of the training-data problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.llm import encoding, forest, language, leakage, mixing, pages, repeated_lines, repetition


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark, d):
    """rec_id of the pages of keywords, links and product tags."""
    return pages.stuffed_pages(table(spark, d, "wet_documents"))


def p1_curves(spark, d):
    """Every page's rank-frequency slope, residual and divergence, and whether they are extreme."""
    from tamarack.plans.stage import written

    p = pages.quality(pages.page_table(table(spark, d, "wet_documents"))).withColumn("pid", F.monotonically_increasing_id())
    return pages.judged_curves(written(p, "pages")).select(
        "rec_id", "lang_guess", "bucket", "slope", "residual", "divergence", "extreme"
    )


def p2_found(spark, d):
    """rec_id_a, rec_id_b: b of a new batch repeats a."""
    return forest.repeats(table(spark, d, "wet_documents"))


def p2_batches(spark, d):
    """The same, batch after batch, each by a forest opened anew from its folder, runs merged in between."""
    return forest.batch_by_batch(table(spark, d, "wet_documents"))


def p3_found(spark, d):
    """rec_id, line_no of furniture lines."""
    return pages.body_cuts(table(spark, d, "wet_documents"))


def p3_bodies(spark, d):
    """Every record's main body, whatever the page, and the number of lines cut."""
    return pages.bodies(table(spark, d, "wet_documents"))


def p5_found(spark, d):
    """rec_id of the pages that are no natural prose."""
    return pages.unprosaic_pages(table(spark, d, "wet_documents"))


def p5_stats(spark, d):
    """Every page's figures and the rule that judged it."""
    return pages.quality(pages.page_table(table(spark, d, "wet_documents"), want_curves=False)).select("rec_id", *pages.STATS, "rule")


def p4_found(spark, d):
    """rec_id, line_no of the lines repeated within a site."""
    return repeated_lines.repeated_lines(table(spark, d, "wet_documents"))


def p4_cleaned(spark, d):
    """Every record's text without the chunks repeated in its site."""
    return repeated_lines.cut_texts(table(spark, d, "wet_documents"))


def p6_found(spark, d):
    """rec_id of the repetitive records."""
    return repetition.repetitive(table(spark, d, "wet_documents"))


def p6_shares(spark, d):
    """Every record's number of words and repeated share."""
    return repetition.repetition(table(spark, d, "wet_documents")).select("rec_id", "n_words", F.round("repeated_share", 6).alias("repeated_share"))


def p6_ratios(spark, d):
    """Every record's length-normalised log-likelihood ratio, and whether it falls below the threshold."""
    return repetition.repetition(table(spark, d, "wet_documents")).select("rec_id", F.round("llr", 6).alias("llr"), (F.col("llr") < 0).alias("picked"))


def p7_found(spark, d):
    """rec_id, label_field, line_no, lang of missing or wrong labels and of foreign lines."""
    return language.wrong_labels(table(spark, d, "wet_documents"), table(spark, d, "doc_meta"), table(spark, d, "lang_codes"))


def p7_languages(spark, d):
    """Every record's main language with its confidence, and the numbers of its foreign lines and mixed-in stretches."""
    return language.languages(table(spark, d, "wet_documents")).select(
        "rec_id", "lang", "confidence", F.size("foreign_lines").alias("n_foreign"), F.size("segments").alias("n_segments")
    )


def p7_segments(spark, d):
    """Stretches of content lines in another language than the record's, by characters."""
    s = language.languages(table(spark, d, "wet_documents")).where("prose").select("rec_id", F.explode("segments").alias("s"))
    return s.select("rec_id", "s.line_no", "s.start", "s.end", "s.lang", F.round("s.confidence", 4).alias("confidence"))


def p8_found(spark, d):
    """doc_id, item_id of leaked test items."""
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_matches(spark, d):
    """Leaked items with the place and length of the longest verbatim match."""
    return leakage.matches(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_clean(spark, d):
    """doc_id of the documents that are left once those with leaked items are removed."""
    return leakage.cleaned(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id")


def p9_found(spark, d):
    """source of the targets that cannot be reached."""
    return mixing.unreachable(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mix(spark, d):
    """Every copy of the chosen documents."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    """Target and actual share of each source."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark, d):
    """doc_id of the documents with wrongly decoded parts."""
    return encoding.repaired(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark, d):
    """Those documents with the text as far as it can be restored."""
    return encoding.repaired(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_curves, p2_found, p2_batches, p3_found, p3_bodies, p4_found, p4_cleaned, p5_found, p5_stats, p6_found, p6_shares, p6_ratios, p7_found, p7_languages, p7_segments, p8_found, p8_matches, p8_clean, p9_found, p9_mix, p9_shares, p10_found, p10_restored)
}

_SITE = r"nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', ''), '')"
_LINES = (
    r"SELECT rec_id, site, i - 1 AS line_no, ls[i] AS raw, rtrim(trim(regexp_replace(regexp_replace(lower(ls[i]), '\d+', '0', 'g'), '[\s\x{a0}]+', ' ', 'g')), '.,:;!?… ') AS line "
    "FROM (SELECT rec_id, site, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT rec_id, " + _SITE + " AS site, string_split(text, chr(10)) AS ls FROM wet_documents WHERE text IS NOT NULL))"
)
_RUNS = (
    r"WITH w AS (SELECT rec_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM (SELECT rec_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM wet_documents WHERE text IS NOT NULL)), "
    "g AS (SELECT rec_id, i, row_number() OVER (PARTITION BY rec_id, array_to_string(ws[i:i+7], ' ') ORDER BY i) AS k FROM w), "
    "c AS (SELECT DISTINCT rec_id, p FROM (SELECT rec_id, unnest(range(i, i + 8)) AS p FROM g WHERE k > 1)), "
    "n AS (SELECT rec_id, count(*) AS c FROM c GROUP BY 1), "
    r"t AS (SELECT rec_id, coalesce(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')), 0) AS n_words FROM wet_documents) "
)
_TOKENS = r"coalesce(len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: length(x) BETWEEN 2 AND 50)), 0)"
_RATES = (
    f"WITH s AS (SELECT doc_id, lower(trim(source, ' ')) AS source, {_TOKENS} AS tokens FROM documents), "
    "o AS (SELECT source, sum(tokens) AS tokens FROM s GROUP BY 1), "
    "m AS (SELECT lower(trim(source, ' ')) AS source, sum(target_weight) AS target_weight, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY 1), "
    "r AS (SELECT m.source, target_weight, max_repeats, coalesce(tokens, 0) AS tokens, (SELECT sum(tokens) FROM s) AS total FROM m LEFT JOIN o USING (source)), "
    "q AS (SELECT *, CASE WHEN tokens > 0 THEN least(target_weight * total / tokens, max_repeats::DOUBLE) ELSE 0 END AS rate FROM r), "
    "d AS (SELECT doc_id, s.source, s.tokens, (floor(rate) + (('0x' || substr(md5('mix-1:' || doc_id), 1, 8))::UBIGINT / 4294967296.0 < rate - floor(rate))::INT)::INT AS copies FROM s JOIN q USING (source)) "
)
_REPEATS = (
    r"WITH t AS (SELECT rec_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM wet_documents WHERE text IS NOT NULL), "
    "s AS (SELECT DISTINCT rec_id, unnest(CASE WHEN len(ws) < 5 THEN [hash(array_to_string(ws, ' '))] ELSE list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i:i+4], ' '))) END) AS h FROM t WHERE len(ws) > 0), "
    "n AS (SELECT rec_id, count(*) AS n FROM s GROUP BY 1), "
    "o AS (SELECT x.rec_id AS a, y.rec_id AS b, count(*) AS c FROM s x JOIN s y USING (h) WHERE x.rec_id < y.rec_id GROUP BY ALL), "
    "p AS (SELECT a, b FROM o JOIN n x ON x.rec_id = a JOIN n y ON y.rec_id = b WHERE c >= 0.8::DOUBLE * greatest(x.n, y.n)) "
    "SELECT a AS rec_id_a, b AS rec_id_b FROM p JOIN wet_documents w ON w.rec_id = b WHERE coalesce(w.batch_id, 0) > 0 AND a NOT IN (SELECT b FROM p)"
)
SQL: dict[str, str] = {
    "p2_found": _REPEATS,
    "p2_batches": _REPEATS,
    "p4_found": "WITH l AS (" + _LINES + r"), k AS (SELECT site, line FROM l WHERE regexp_matches(raw, '\p{L}') GROUP BY 1, 2 "
    "HAVING count(DISTINCT rec_id) >= 5 AND count(DISTINCT rec_id) >= 0.04 * (SELECT count(*) FROM wet_documents w WHERE " + _SITE + " IS NOT DISTINCT FROM l.site)) "
    r"SELECT l.rec_id, l.line_no::INT AS line_no FROM l JOIN k ON l.site IS NOT DISTINCT FROM k.site AND l.line = k.line WHERE regexp_matches(raw, '\p{L}')",
    "p6_found": _RUNS + "SELECT t.rec_id FROM t JOIN n USING (rec_id) WHERE c * 5 >= n_words * 2",
    "p6_shares": _RUNS + "SELECT t.rec_id, n_words::INT AS n_words, round(coalesce(c, 0) / greatest(n_words, 1), 6) AS repeated_share FROM t LEFT JOIN n USING (rec_id)",
    "p9_found": _RATES + "SELECT source FROM q WHERE max_repeats * tokens < target_weight * total",
    "p9_mix": _RATES + "SELECT doc_id, source, tokens, unnest(range(1, copies + 1))::INT AS copy FROM d WHERE copies > 0",
    "p9_shares": _RATES + "SELECT q.source, target_weight, tokens, round(rate, 6) AS rate, coalesce(g, 0)::BIGINT AS mixed_tokens, "
    "round(coalesce(g, 0) / greatest(sum(coalesce(g, 0)) OVER (), 1), 6) AS actual_share FROM q LEFT JOIN (SELECT source, sum(tokens * copies) AS g FROM d GROUP BY 1) USING (source)",
}
