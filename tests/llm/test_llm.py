"""The training-data operators against brute force on small tables, and their edge cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import encoding, forest, furniture, language, leakage, mixing, pages, repeated_lines, repetition, rules
from tamarack.llm.arrays import TextBatch, slices
from tamarack.llm.lines import Lines

PAGE = (
    "Home\nNews\nContact\nHome > Kalo > Birt\nThe harbour office – Kalo Birt\n"
    "Although the museum seemed slow, it found a better estimate and nobody complained. The weather service has been honest since the autumn, and that is why we moved.\n"
    "It is not simple to say that the report explained the opening hours near the river. Most of them would have preferred the morning shift.\n"
    "Most read\nThe old pear tree – Gorv\nKalo Dint: the spare parts\n"
    "All rights reserved. No part of Kalo Post may be reproduced without written permission.\n© 2020 Kalo Post. All rights reserved"
)
SPAM = "Home\nNews\n" + "\n".join(f"[Winter jacket Kal{i}](https://www.x{i}.test/boots?id={i})" for i in range(30)) + "\n© 2020 Kalo Post. All rights reserved"
TABLE = "The report – Kal\n" + "\n".join(f"Wug{i}    {i}.{i}    -    n/a    {i * 7}" for i in range(30))
FOREIGN = PAGE.replace("\nMost read", "\nAunque el museo parecía lento, nadie se quejó de ello y el informe no era todavía muy útil para los vecinos.\nMost read", 1)


def wet(spark, texts, **cols):
    rows = [(i, 1 if i else 0, "http://www.Site.example:80/a", t, "en", "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "rec_id bigint, batch_id int, url string, text string, lang string, t string, k0 string")


def ids(df, col="rec_id"):
    return sorted(r[col] for r in df.collect())


EDGE = [None, "", " \n \r\n", "a", "…", "\n\n\n", "x" * 700_000, "word " * 3000, "emoji 😀 ☕ İ ß", PAGE, PAGE]


def test_batch_matches_python():
    texts = ["Ünï_x 12 a\nb", None, "", "tail\n", "日本 語 x²", "😀a b"]
    b = TextBatch(texts)
    s, e = b.words
    a, z = b.word_range
    for i, t in enumerate(texts):
        assert [b.text[x:y] for x, y in zip(s[a[i] : z[i]], e[a[i] : z[i]])] == re.findall(r"\w+", t or "")
    ls, le, doc, no = b.lines
    assert [(d, n, b.text[x:y]) for x, y, d, n in zip(ls, le, doc, no)] == [(i, n, x) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"))]
    assert TextBatch(["same word"]).word_hash[0] == TextBatch(["x SAME"]).word_hash[1]
    assert list(slices(np.array([5, 100, 1, 1]), 10)) == [(0, 1), (1, 2), (2, 4)]


def test_pages(spark):
    d = wet(spark, [PAGE, SPAM, TABLE, None, ""])
    assert ids(pages.unprosaic_pages(d)) == [1, 2]
    assert ids(pages.stuffed_pages(d)) == [1]
    cut = {(r["rec_id"], r["line_no"]) for r in pages.body_cuts(d).collect()}
    assert {n for i, n in cut if i == 0} == {0, 1, 2, 3, 7, 8, 9, 10, 11} and {i for i, _ in cut} == {0}


@pytest.mark.parametrize(
    "op",
    [
        pages.stuffed_pages, pages.unprosaic_pages, pages.body_cuts, repeated_lines.repeated_lines, repetition.repetitive, forest.repeats,
        lambda d: repetition.repetition(d), lambda d: pages.judged_curves(pages.quality(pages.page_table(d)).withColumn("pid", F.monotonically_increasing_id())), lambda d: language.languages(d),
        lambda d: encoding.repaired(d.withColumnRenamed("rec_id", "doc_id")),
        lambda d: leakage.leaked(d.withColumnRenamed("rec_id", "doc_id"), d.select(F.col("rec_id").alias("item_id"), "text").where("rec_id in (0, 1, 2, 3, 9)")),
    ],
)
def test_edges(spark, op):
    """Nulls in every column, empty, blank, very long and repeated texts, clashing column names, no rows at all."""
    d = wet(spark, EDGE).withColumn("url", F.when(F.col("rec_id") % 2 == 0, F.col("url"))).withColumn("batch_id", F.when(F.col("rec_id") > 1, F.col("batch_id")))
    op(d).collect()
    assert op(d.limit(0)).count() == 0


def test_crf_learns_and_viterbi_is_best():
    texts = ["menu\nlong words of a sentence here.\nfoot", "menu\nmenu\nother long words in a sentence.\nfoot"] * 8
    gold = [[1, 0, 1], [1, 1, 0, 1]] * 8
    w, t = furniture.train(texts, gold, epochs=8)
    lines = Lines(TextBatch(texts[:2]))
    em = furniture.emissions(w, lines)
    got = furniture.viterbi(em, t, lines)
    assert got.tolist() == [1, 0, 1, 1, 1, 0, 1]
    from itertools import product

    rng = np.random.default_rng(0)
    em, t = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    got = furniture.viterbi(em, t, lines)
    for a, z in ((0, 3), (3, 7)):
        score = lambda y, a=a: sum(em[a + i, k] for i, k in enumerate(y)) + sum(t[p, q] for p, q in zip(y, y[1:]))
        assert tuple(got[a:z]) == max(product(range(3), repeat=z - a), key=score)


def test_spam_of_any_words(spark):
    """Keywords no list knows, in a language without a model; goods that prose speaks of are no keywords."""
    prose = [PAGE.replace("weather service", f"small repairs and weather service {i}").replace("the river", f"river number{i}") for i in range(80)]
    foreign = "\n".join(f"{a} {b} {w} Kal{i}" for i, (a, b, w) in enumerate([("prezzo", "basso", "tosaerba"), ("comprare", "subito", "lavatrice"), ("prezzo", "subito", "frigorifero")] * 14))
    goods = "\n".join(f"- {i} kg small repairs Kal{i}" for i in range(40))
    d = wet(spark, [*prose, foreign, goods])
    assert ids(pages.stuffed_pages(d)) == [80] and ids(pages.unprosaic_pages(d)) == [80, 81]


def test_long_notice():
    """A line of any length keeps its word features."""
    _, ids_, weight = Lines(TextBatch(["word " * 200, "word " * 30])).features
    assert len(ids_) > 450 and weight.min() == 30 / 200


def test_stretches(spark):
    line = "The weather service has been honest since the autumn and nobody complained about it, mas o pão não está à mão da irmã e a menina foi para casa com os seus irmãos quando já era noite, and that is why we moved."
    d = wet(spark, [PAGE.replace("It is not simple", line + "\nIt is not simple")])
    r = language.languages(d).first()
    got = [(x["lang"], line[x["start"] : x["end"]]) for x in r["segments"]]
    assert r["lang"] == "en" and len(got) == 1 and got[0][0] == "pt" and "pão não está à mão da irmã e a menina foi para casa" in got[0][1]


def test_other_language(spark):
    d = wet(spark, [PAGE, "\n".join(["καλημέρα σε όλους τους ανθρώπους που διαβάζουν αυτή την εφημερίδα σήμερα το πρωί"] * 5), TABLE, "  ", None])
    got = {r["rec_id"]: r["lang"] for r in language.languages(d).collect()}
    assert got[0] == "en" and got[1] == "und" and set(got) == {0, 1, 2}


def test_rules():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (x[:, 0] < 0.3) | (x[:, 1] > 0.8) & (x[:, 2] > 0.5)
    found = rules.induce(x, y)
    on = np.any([rules.covers(r, x) for r in found], 0)
    assert (on == y).mean() > 0.93 and rules.to_sql(found, ["a", "b", "c"]).startswith("CASE WHEN")
    assert rules.to_sql([], []) == "0"


def test_forest_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(60):
        w = list(rng.choice(vocab, 80))
        texts.append(" ".join(w))
        for _ in range(2):
            v = list(w)
            for j in rng.integers(0, 80, rng.integers(0, 3)):
                v[j] = "new"
            texts.append(", ".join(v).upper())
    texts += ["same small text"] * 3 + [None, ""]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    rows = [(i, 0 if i < 70 else 1 + i // 60, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "rec_id bigint, batch_id int, text string")

    def sh(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    s = [sh(t) for t in texts]
    near = {(a, b) for b in range(len(s)) for a in range(b) if s[a] and len(s[a] & s[b]) >= 0.8 * max(len(s[a]), len(s[b]))}
    later = {b for _, b in near}
    want = {(a, b) for a, b in near if a not in later and rows[b][1] > 0}
    got = {tuple(r) for r in forest.repeats(d).collect()}
    assert got == want
    folder, step = str(tmp_path / "forest"), set()
    for k in sorted({r[1] for r in rows}):
        f = forest.Forest(spark, folder, hot=3, rounds=1)  # opened anew, as by another session
        pairs = {tuple(r) for r in f.add(d.where(F.col("batch_id") == k)).collect()}
        step |= pairs if k else set()
        if k == 2:
            f.merge_runs()
            assert len(forest.Forest(spark, folder).runs) == 1
    assert step == want
    with pytest.raises(ValueError):
        forest.Forest(spark, folder).add(d.where("batch_id = 0"))
    assert {tuple(r) for r in forest.batch_by_batch(d).collect()} == want
    assert forest.depth(0.99) < forest.LEVELS and forest.depth(1.1) == 1 and 1 - (1 - forest.NEAREST ** forest.depth()) ** forest.TREES >= 0.99


def test_forest_two_writers(spark, tmp_path):
    """Of two that start from the same state one fails, and nothing of it counts."""
    d = spark.createDataFrame([(i, 0, f"some words of text number{i} that stand here alone {i}") for i in range(4)], "rec_id bigint, batch_id int, text string")
    a, b = forest.Forest(spark, str(tmp_path / "f")), forest.Forest(spark, str(tmp_path / "f"))
    a.add(d)
    with pytest.raises(FileExistsError):
        b.add(d)
    assert len(forest.Forest(spark, str(tmp_path / "f")).runs) == 1


def test_forest_hot_template(spark):
    """Many texts of one template, too different to repeat each other, share all buckets; copies with a word changed among them."""
    head = [f"head{i}" for i in range(60)]
    texts = [" ".join([*head, *(f"u{i}x{k}" for k in range(25))]) for i in range(40)]
    texts += [t.replace(f"u{i}x7", "other") for i, t in enumerate(texts[:12])]
    d = spark.createDataFrame([(i, int(i >= 20), t) for i, t in enumerate(texts)], "rec_id bigint, batch_id int, text string")
    s = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    near = {(a, b) for b in range(len(s)) for a in range(b) if len(s[a] & s[b]) >= 0.8 * max(len(s[a]), len(s[b]))}
    later = {b for _, b in near}
    want = {(a, b) for a, b in near if a not in later and b >= 20}
    f = forest.Forest(spark, hot=4, rounds=1)
    f.add(d.where("batch_id = 0"))
    assert {tuple(r) for r in f.add(d.where("batch_id = 1")).collect()} == want and len(want) == 12


def test_repeated_lines_against_brute_force(spark):
    rng = np.random.default_rng(5)
    shared = ["Read our Terms, 2024!", "Share", "a much longer line that a site repeats under every one of its articles, again and again"]
    texts = []
    for i in range(60):
        ls = [f"own line {i} " + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 12)) for _ in range(3)]
        ls += [x.replace("2024", str(2000 + i)).upper() if i % 3 else x + " ." for x in shared if rng.random() < 0.3] + ["…", "  "]
        texts.append("\n".join(rng.permutation(ls)))
    texts += [None, ""]
    d = wet(spark, texts)

    def norm(x):
        return re.sub(r"[.,:;!?… ]+$", "", re.sub(r"\s+", " ", re.sub(r"\d+", "0", x.lower())).strip())

    n = Counter()
    for t in texts:
        n.update({norm(x) for x in (t or "").split("\n") if re.search(r"[^\W\d_]", x)})
    least = max(5, 0.04 * len(texts))
    want = {(i, k) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if re.search(r"[^\W\d_]", x) and n[norm(x)] >= least}
    assert {tuple(r) for r in repeated_lines.repeated_lines(d).collect()} == want


def test_cut_texts(spark):
    own = [f"First line of {x * 5} and nothing else.\nShare this!\nLast words {x * 3} of it, quite alone" for x in "abcdefghi"]
    d = wet(spark, [*own, None, "Share this"])
    got = {r["rec_id"]: (r["text"], r["n_cut"]) for r in repeated_lines.cut_texts(d, 5, 0.2).collect()}
    assert got[9] == (None, 0) and got[10][0] == "" and all(got[i][0] == own[i].replace("Share this!\n", "") for i in range(9) if got[i][1] == 1)
    assert got[0][1] == 1 and len(got) == 11


def test_bodies(spark):
    got = {r["rec_id"]: r for r in pages.bodies(wet(spark, [PAGE, None, ""])).collect()}
    assert got[0]["body"].startswith("The harbour office") and got[0]["body"].endswith("the morning shift.") and got[1]["body"] is None and got[2]["n_cut"] == 0


def test_repetition_against_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = []
    for i in range(80):
        base = list(rng.choice([f"v{k}" for k in range(300)], 60))
        texts.append(" ".join(base[: rng.integers(10, 60)] * rng.integers(1, 4) + base[::-1][: rng.integers(0, 60)]))
    texts += [None, "", "one two", "a " * 20]

    def share(t):
        w = re.findall(r"\w+", (t or "").lower())
        seen, cov = set(), set()
        for i in range(len(w) - 7):
            g = tuple(w[i : i + 8])
            if g in seen:
                cov |= set(range(i, i + 8))
            seen.add(g)
        return len(cov), len(w)

    d = wet(spark, texts)
    got = {r["rec_id"]: (r["n_repeated"], r["n_words"]) for r in repetition.repetition(d).collect()}
    assert got == {i: share(t) for i, t in enumerate(texts)}
    assert ids(repetition.repetitive(d)) == [i for i, t in enumerate(texts) if share(t)[1] and share(t)[0] * 5 >= share(t)[1] * 2]


def test_language(spark):
    d = wet(spark, [PAGE, FOREIGN, TABLE, None]).withColumn("lang", F.element_at(F.array(F.lit("eng"), F.lit("de"), F.lit("en"), F.lit("en")), (F.col("rec_id") + 1).cast("int")))
    meta = spark.createDataFrame([(0, 2, 1), (0, 1, 2), (1, None, 1), (2, 0, 1)], "rec_id bigint, lang_id int, loaded_at bigint")
    codes = spark.createDataFrame([(0, "unknown"), (1, "en"), (2, "de")], "lang_id int, lang string")
    got = {tuple(r) for r in language.wrong_labels(d, meta, codes).collect()}
    at = FOREIGN.split("\n").index(next(x for x in FOREIGN.split("\n") if x.startswith("Aunque")))
    assert got == {(1, "lang", -1, "en"), (1, "lang_id", -1, "en"), (1, "line", at, "es")}


def test_network_gradient():
    """Training lowers the loss to near nothing on two made-up languages."""
    rng = np.random.default_rng(0)
    rows = [bytes(rng.choice(list(b"abcde " if i % 2 else b"vwxyz "), 80).astype(np.uint8)) for i in range(60)]
    y = np.array([i % 2 for i in range(60)])
    p = language.train(rows, y, updates=40, batch=32)
    b = np.frombuffer(b"".join(rows), np.uint8)
    x, steps, _ = language.blocks(b, np.arange(60) * 80, np.arange(1, 61) * 80)
    e = p["e"][x[:, : steps[0]].transpose(1, 0, 2)].reshape(steps[0], 60, -1)
    h = np.concatenate([language._states(p, d, e, steps)[0] for d in "fb"], 2)
    assert ((h @ p["w"] + p["o"]).mean(0).argmax(1) == y).mean() > 0.97


def test_leakage(spark):
    w = [f"token{i}" for i in range(40)]
    item = " ".join(w)
    alt = list(w)
    for i in (3, 11, 19, 27, 35):
        alt[i] = "other"
    worse = [x if i % 5 else "bad" for i, x in enumerate(w)]
    texts = [
        "before " + " ".join(w[5:17]).upper() + " after", "x " + " ".join(w[5:16]) + " y", " ".join(alt), " ".join(worse), " ".join(f"**{x}**" if i % 3 else f"<b>{x}</b>" for i, x in enumerate(w[10:30])),
        ", ".join(x[:3] + "-\n" + x[3:] for x in w[8:24]), None, "",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    it = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id bigint, text string")
    assert {tuple(r) for r in leakage.leaked(d, it).collect()} == {(0, 7), (2, 7), (4, 7), (5, 7)}
    m = {r["doc_id"]: r for r in leakage.matches(d, it, most=1).collect()}
    assert texts[0][m[0]["start"] : m[0]["start"] + m[0]["length"]] == " ".join(w[5:17]).upper() and m[0]["words"] == 12 and m[2]["whole"]
    assert texts[4][m[4]["start"] :].startswith("token10</b>") and m[4]["words"] == 20
    assert ids(leakage.cleaned(d, it), "doc_id") == [1, 3, 6, 7]


def test_leakage_short_item_widens_nothing():
    """A short item is found, and a long one is still located by all its leading characters."""
    long_ = " ".join(f"word{i}" for i in range(30))
    items = leakage.Items([1, 2], ["a b c", long_])
    assert {(d, i) for d, i, *_ in items.found_in(["x a b c y", long_ + " end", "a b d"])} == {(0, 1), (1, 2)}
    assert (items.high[0][-1] - items.low[0][-1]) == 0


def test_mixing(spark):
    d = spark.createDataFrame([(i, "tok " * 10 if i % 4 else None, "A " if i % 2 else "b") for i in range(400)] + [(999, "z z", None)], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.3, 2), (" B", 0.7, 1), ("gone", 0.1, 9)], "source string, target_weight double, max_repeats int")
    assert ids(mixing.unreachable(d, t), "source") == ["b", "gone"]
    m = mixing.mixed(d, t).collect()
    assert {r["source"] for r in m} == {"a", "b"} and max(r["copy"] for r in m) <= 2
    assert abs(sum(r["source"] == "a" for r in m) / (0.3 * 300) - 1) < 0.25
    assert mixing.mixed(d.limit(0), t).count() == 0 and mixing.shares(d, t.limit(0)).count() == 0


def test_encoding_roundtrip(spark):
    clean = ["Él café está más lejos que la montaña, señor.", "Die größte Übung für Mädchen heißt Öffnung.", "À l'été, la forêt élève ses prés.", "O pão não está à mão da irmã.", "plain words only"] * 400
    bad = [t.encode("utf-8").decode("cp1252", "replace") for t in clean[:3]] + [clean[0].encode("utf-8").decode("latin-1"), clean[2].encode("cp1252").decode("cp437"), "caf� noir"]
    d = spark.createDataFrame(list(enumerate(clean + bad)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["restored"] for r in encoding.repaired(d).collect()}
    assert set(got) == set(range(len(clean), len(clean) + len(bad)))
    n = len(clean)
    assert got[n + 3] == clean[0] and got[n] == clean[0] and got[n + 5] == "caf� noir"
    assert encoding.segments(np.array([1.0, -2, 3, -1, 2, -9, 4])) == [(0, 1), (2, 5), (6, 7)]
