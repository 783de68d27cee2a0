"""Markup of any length around and between the words of a passage."""

import pytest

from tamarack.llm import leakage


@pytest.mark.parametrize("tag", ['<span class="' + "wide " * 60 + '">', '<a href="x"\n   title="over\nlines">', "</b\n>"])
def test_long_and_broken_tags(spark, tag):
    w = [f"token{i}" for i in range(40)]
    d = spark.createDataFrame([(0, "see " + f" {tag}".join(w[5:17]) + " end"), (1, "if a <b then " + "filler " * 40 + " ".join(w[5:17]) + " or a > c"), (2, "no <" + "b" * 300)], "doc_id bigint, text string")
    it = spark.createDataFrame([(7, " ".join(w))], "item_id bigint, text string")
    assert {tuple(r) for r in leakage.leaked(d, it).collect()} == {(0, 7), (1, 7)}
