"""Stored replies: HTML references against the standard library's."""

import html

from tabspark.sources.files import unescape

TEXTS = ["", "plain", "Tom &amp; Jerry", "&#39;x&#x27; &#8217;&#x1F3B8;", "&amp;lt;b&amp;#39;", "&lt;i&gt;&quot;a&quot;&apos;", "&#38;lt; & &&amp;&", "a\n&nbsp;b", "&#0;&#xD800;&#x110000;", "&#9999999;"]


def test_unescape_as_the_standard_library(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    got = dict(rows.select("i", unescape(rows["t"]).alias("t")).collect())
    assert got == {i: html.unescape(t) for i, t in enumerate(TEXTS)} | {len(TEXTS): None}


def test_unknown_references_stay(spark):
    rows = spark.createDataFrame([("&nosuchname; &#xZZ; &#12",)], "t string")
    assert rows.select(unescape(rows["t"])).first()[0] == "&nosuchname; &#xZZ; &#12"
