"""Keys, entities, ranges, listings and joins on odd values, against plain Python."""

from __future__ import annotations

import html
import re

from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.operators import catalog as C
from folioframe.operators import workflow as W
from folioframe.sources import readers


def values(spark, column, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    return [r.x for r in frame.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_all_entities(spark):
    texts = ["&eacute;t&eacute; &times; &#x27;q&#39; &amp;amp; &notanentity; &#128512; &#x1F600;", "&#0; &#xD800; &#x110000; &#150; &#x80;", "no reference & none; here", "", None, "&nbsp;&lt;p&gt;&quot;", "&CounterClockwiseContourIntegral;&NotEqualTilde;", "a&b;c&ltd"]
    want = [None if t is None else re.sub(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]+);", lambda m: html.unescape(m[0]) if not m[0].startswith("&notan") else m[0], t) for t in texts]
    assert values(spark, X.decode_entities, texts) == want


def test_math_keys(spark):
    texts = [r"$\frac{1}{2} \times \left(x\right)$", r"\begin{matrix}a & b\end{matrix}", r"\boxed{ } \boxed{\quad} \approx 3", r"\stackrel{?}{=} \text{cm} \sqrt{9}", r"a &lt; b ![x](y.png)", "", r"\geq\ge\leq\ne\mp\sim"]
    assert values(spark, X.math_key, texts) == ["frac1over2timesx", "ab", "boxedblankboxedblankapprox3", "questionequalscmsqrt9", "a<b", "", "gegelenempsim"]
    assert values(spark, X.formula_semantic_key, [r"\frac{1}{2}\times x^2", r"**b** \sqrt[3]{y} \,z", r"\left(a\right) \neq \begin{array} 1 \end{array}"]) == ["frac(1)/(2)*x^2", "bsqrtroot(3)(y)z", "(a)!=beginarray1endarray"]
    figures = spark.createDataFrame([("captioned_figure", "![a](b)"), ("captioned_figure", "![a](b) x"), ("formula", "x"), ("formula", "{}")], "t string, c string")
    assert [r.x for r in figures.select(X.formula_like(F.col("t"), F.col("c")).alias("x")).collect()] == [False, True, True, False]


def test_ranges_and_urls(spark):
    headers = ["bytes=0-", "bytes=5-9", "bytes=-3", "bytes=-0", "bytes=9-5", "bytes=100-", "bytes=1-2,4-5", "items=1-2", None, "bytes=x-2", "bytes=-500", "Bytes= 2 - 200"]
    got = values(spark, lambda c: W.byte_range(c, F.lit(50).cast("long")), headers)
    assert [None if g is None else (tuple(g)[:2] if g.ok else "416") for g in got] == [(0, 49), (5, 9), (47, 49), None, "416", "416", None, None, None, None, (0, 49), (2, 49)]
    urls = ['{"url": "http://a?Signature=1", "k": ["x?X-Amz-Date=1", "y"]}', "http://b?X-Amz-Date=2", '{"other": "http://a?Signature=1"}', None, "plain"]
    assert values(spark, W.redact_urls, urls) == ['{"url": "<redacted-presigned-url>", "k": ["<redacted-presigned-url>", "y"]}', "<redacted-presigned-url>", urls[2], None, "plain"]


def test_null_rows_stay(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a"), (5, "b")], "i int, t string")
    got = {r.i: r.state for r in C.with_canonical(rows, F.col("t"), "i").collect()}
    assert got == {1: "canonical", 2: "unique", 3: "unique", 4: "duplicate_noncanonical", 5: "unique"}
    listed = spark.createDataFrame([("k1",), ("k2",), ("k2",), (None,)], "key string")
    rows = spark.createDataFrame([(None, "k1"), ("k2", "k1"), ("k3", "k1"), (None, None), (None, None)], "a string, b string")
    assert [r.resolved for r in readers.first_existing(rows, ["a", "b"], listed).orderBy("a", "b").collect()] == [None, None, "k1", "k2", "k1"]
    facets = {(r.field, r.value) for r in C.facets(spark.createDataFrame([("x", "1"), ("y", None), ("", "1")], "a string, b string"), ["a", "b"], 1).collect()}
    assert facets == {("a", "x"), ("b", "1")}


def test_write_back_and_checks(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, 9), (4, None)], "k int, box int")
    found = spark.createDataFrame([(1, 5, "ok"), (2, 6, "ok"), (2, 7, "ok"), (3, 8, "ok"), (4, 1, "weak")], "k int, box int, bucket string")
    assert sorted(map(tuple, W.write_back(rows, found, ["k"], "bucket", ["ok"], ["box"], F.isnull("box")).collect()), key=str) == sorted([(1, 5, "filled"), (2, None, "ambiguous"), (3, 9, "kept"), (4, None, "open")], key=str)
    runs = spark.createDataFrame([("a", 1, 1, True), ("a", 2, 2, False), ("b", 3, 1, False), ("b", 4, 2, True), ("c", 5, 1, False), (None, 6, 1, False)], "m string, id int, at int, published boolean")
    assert {r.m: r.id for r in W.last_unpublished(runs, "m", "at", "id", F.col("published")).collect()} == {"a": 2, "c": 5, None: 6}
