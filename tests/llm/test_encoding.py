"""Wrong encodings on skewed input and with few garbled characters."""

import random

from tamarack.llm import encoding

WORDS = "le café était fermé depuis une journée entière après la fête du marché où chaque invité avait trouvé son thé très léger et la rivière gelée der große Mädchen über schön".split()


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def prose(n, words=40, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(words)) + f" {i}." for i in range(n)]


def test_copies_do_not_hide_a_garbled_text(spark):
    clean = prose(300)
    one = "La fête du marché était très réussie et l'été a duré peu."
    bad = one.encode().decode("cp1252")
    got = {r["doc_id"]: r["restored"] for r in encoding.repaired(documents(spark, [*clean, *[bad] * 150])).collect()}
    assert got == {300 + i: one for i in range(150)}


def test_frequent_garbled_pairs_are_looked_at(spark):
    clean = prose(300)
    want = {300 + i: t for i, t in enumerate(prose(150, seed=2)) if not t.isascii()}
    bad = [t.encode().decode("cp1252") for t in prose(150, seed=2)]
    got = {r["doc_id"]: r["restored"] for r in encoding.repaired(documents(spark, [*clean, *bad])).collect()}
    assert got == want


def test_one_or_two_garbled_characters_are_enough(spark):
    clean = [f"{t[:80]} – {t[80:]}" for t in prose(600)]
    texts = ["a summary – and the rest", "la très grande table", "un café très grand"]
    bad = [texts[0].encode("cp1252").decode("mac_roman"), texts[0].encode("cp1252").decode("cp850"), texts[1].encode("cp1252").decode("cp1250"), texts[2].encode("cp1252").decode("mac_roman")]
    got = {r["doc_id"]: r["restored"] for r in encoding.repaired(documents(spark, [*clean, *bad])).collect()}
    assert got == {600: texts[0], 601: texts[0], 602: texts[1], 603: texts[2]}


def test_evidence_is_pooled_over_a_text():
    one = {f"cp{i} cp1252": (10.0, "é") for i in (437, 850)}
    other = {"cp850 cp1252": (9.0, "è"), "cp1254 cp1252": (9.0, "è")}
    assert encoding.convincing({("a", "x", "b"): (None, one)}) == {}
    assert encoding.convincing({("a", "x", "b"): (None, one), ("c", "y", "d"): (None, other)}) == {("a", "x", "b"): "é", ("c", "y", "d"): "è"}
