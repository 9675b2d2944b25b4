import time

import pytest
from pyspark.sql import functions as F

import digitscope as ds
from digitscope.functions.markup import TAXON_BOXES, decode_entities


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("text, kind", [
    ("{{Infobox settlement\n|name=x}}", "settlement"), ("{{infobox  Film }}", "film"), ("no box", None),
    ("{{Infobox}} {{Infobox person|a=1}}", "person"), ("{{Taxobox|a}}", None), ("{{Infobox_person|a}}", "_person"),
    ("<!-- {{Infobox planet}} --> {{Infobox book}}", "book"), ("{{a|{{Infobox river|x}}}}", "river"), (None, None),
])
def test_infobox_type(spark, text, kind):
    assert value(spark, ds.infobox_type(F.lit(text).cast("string"))) == kind


@pytest.mark.parametrize("text, kind", [
    ("{{Taxobox\n|a}}", "taxobox"), ("{{ Automatic_taxobox |a}}", "automatic taxobox"), ("{{Speciesbox}}", "speciesbox"), ("{{Taxobox list|a}}", None),
    ("{{My taxobox|a}}", None), ("{{Infobox ship|a}} {{Taxobox|a}}", "ship"), ("{{Infobox}} {{Taxobox|a}}", "taxobox"),
    ("<!-- {{Taxobox|a}} --> {{Infobox book}}", "book"), ("<!-- {{Infobox book}} -->{{taxobox", "taxobox"), (None, None),
])
def test_templates_that_stand_for_an_infobox(spark, text, kind):
    assert value(spark, ds.infobox_type(F.lit(text).cast("string"), TAXON_BOXES)) == kind
    if text and kind and "taxo" in kind:
        assert value(spark, ds.domain_of_text(F.lit(text), TAXON_BOXES)) == "Biology"
        assert value(spark, ds.domain_of_text(F.lit(text))) != "Biology"


def test_strip_wikitext(spark):
    text = (
        "{{Infobox city|area={{convert|121.4|km2}}}}'''Town''' is in [[France]], see [[Paris|the capital]].\n"
        "<!-- 88 -->== History ==\nFounded in 1776.<ref name=\"a9\">page 3</ref>\n"
        "* item [http://x.org/1 label 5] and [http://x.org/2]\n"
        "{| class=\"wikitable\"\n|-\n! Year !! People\n|-\n| 1900 || 342,782\n|}\n&nbsp;&#53;&#x36;&lt;\n\n\n\nEnd\n"
    )
    got = value(spark, ds.strip_markup(F.lit(text), "wikitext"))
    for gone in ("121.4", "88", "a9", "x.org", "wikitable", "{", "[", "'''", "==", "\n\n\n"):
        assert gone not in got, gone
    for kept in ("Town is in France, see the capital.", "History", "Founded in 1776.page 3", "item label 5 and",
                 "1900", "342,782", " 56<", "End"):
        assert kept in got, (kept, got)


def test_deep_templates_and_broken_markup(spark):
    deep = "{{a|{{b|{{c|{{d|1}}}}}}}}x"
    assert value(spark, ds.strip_markup(F.lit(deep), "wikitext")) == "x"
    assert "2" in value(spark, ds.strip_markup(F.lit("{{open 2"), "wikitext"))


def test_strip_html_keeps_neighbours_apart(spark):
    html = "<style>p{margin:7}</style><script>x=8;</script><!-- 9 --><td>1</td><td>2</td>&amp;&quot;&unknown;"
    assert value(spark, ds.strip_markup(F.lit(html), "html")).split() == ["1", "2", '&"&unknown;']


def test_decode_entities(spark):
    text = "a &amp;lt; &#8364; &#x1F600; &#xD800; &nope; &eacute; 100% & more"
    assert value(spark, decode_entities(F.lit(text))) == "a &lt; € 😀 &#xD800; &nope; é 100% & more"


def test_broken_pages_take_linear_time(spark):
    text = "<!-- open <script> <style> <math> x {{ [[ == <nowiki> {{infobox &" * 20000 + " 42 " + "= " * 5000
    started = time.time()
    for dialect in ("html", "wikitext"):
        assert " 42 " in value(spark, ds.strip_markup(F.lit(text), dialect))
    value(spark, ds.infobox_type(F.lit(text)))
    assert time.time() - started < 60
    closed = "a<!-- x <!-- 5 -->b<script>6</SCRIPT >c<!-- 7"
    assert value(spark, ds.strip_markup(F.lit(closed), "html")) == "a b c<!-- 7"


def test_spaces_of_all_kinds_around_the_type(spark):
    assert value(spark, ds.infobox_type(F.lit("{{Infobox\u00a0\u2003ship\u3000\n|x}}"))) == "ship"


def test_deep_templates_and_links(spark):
    cases = {
        "a {{t|" * 30 + "x" + "}}" * 30 + " b": "a  b",
        "{{math|e^{12}}} 5": " 5",
        "x {{open {{closed}} y": "x {{open  y",
        "x }} y {{t}}": "x }} y",
        "{{{{t}}}}z": "z",
        "[[a|b [1] c]] [[File:x|thumb|see [[d|e]]]]": "b [1] c thumb|see e",
        "[[t|" * 12 + "deep" + "]]" * 12: "deep",
        "[[never closed": "[[never closed",
        "R&apos;D &#0000065; &NotEqualTilde; &nothing;": "R'D A \u2242\u0338 &nothing;",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    for r in df.select("text", "want", ds.strip_markup(df.text, "wikitext").alias("got")).collect():
        assert r.got.strip() == r.want.strip(), r.text
