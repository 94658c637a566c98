from __future__ import annotations

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from stratalog.functions import cells, citations, labels, markup, numbers


def values(spark, rows, *exprs):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [tuple(r) if len(exprs) > 1 else r[0] for r in df.select(*exprs).collect()]


@pytest.fixture(autouse=True)
def column(spark):
    """Columns need a running session, so the shared one is made per test."""
    global X
    X = F.col("x")


def test_number_texts(spark):
    texts = ["0", "1.5", "0.3-1.2 kPa", "n/a", "1.5d", "Infinity", " 12 ", None, "-.5e1", "NaN"]
    assert values(spark, texts, numbers.strict_number(X)) == [None, 1.5, None, None, None, None, 12.0, None, -5.0, None]
    assert values(spark, texts, numbers.prefix_number(X)) == [None, 1.5, 0.3, None, 1.5, None, 12.0, None, -5.0, None]
    assert values(spark, ["12", "1.5", "x", " 7 "], numbers.integer_text(X)) == [12, None, None, 7]
    assert values(spark, ["21.5 kg", "101 g", "none"], numbers.mass_kg(X)) == [21.5, 101 * 0.001, None]


def test_cluster_radius_is_clamped(spark):
    got = [r[0] for r in spark.createDataFrame([(0.3,), (0.4,), (2.2,), (4.0,), (9.0,)], "a double").select(
        F.round(numbers.cluster_radius(F.col("a")), 4)).collect()]
    assert got == [0.01, 0.01, 10.005, 20.0, 20.0]


def test_csv_cell(spark):
    texts = ["plain", "a, b", 'say "x"', "two\r\nlines ", None]
    assert values(spark, texts, labels.csv_cell(X)) == ["plain", '"a, b"', '"say ""x"""', "two lines", ""]


def test_rocks_label(spark):
    texts = ['{"Rocks": {"Glass": 20, "Basalt": 60.5, "Nil": 0}}', '{"Other": 1}', "Basalt", None, '{"Rocks": {"Nil": 0}}']
    assert values(spark, texts, labels.rocks_label(X)) == [
        "Basalt 60.5%, Glass 20%", '{"Other": 1}', "Basalt", None, '{"Rocks": {"Nil": 0}}']


def test_labels(spark):
    assert values(spark, ["Apollo 14 soil", "10084", "Chang'e 5", "x change y", None], labels.inferred_mission(X)) == [
        "Apollo 14", "Apollo 11", "Chang'e-5", "Chang'e-5", None]
    assert values(spark, ["nasa jsc", "Cnsa", "none", None], labels.institution_url(X)) == [
        "https://www.nasa.gov", "https://www.cnsa.gov.cn", None, None]
    assert values(spark, ["Mare Highland", "mare", None], labels.type_colour(X)) == ["#94a8be", "#d4915c", "#9b8e82"]
    assert values(spark, ["DEU", "Mars", None], labels.country_display(X)) == ["Germany", "Mars", None]
    assert values(spark, ["7", "999", "1000"], labels.key_text("CH", X.cast("int"))) == ["CH007", "CH999", "CH1000"]
    assert values(spark, ["a"], labels.merged_label(X, F.lit("a"), F.lit(""), F.lit("b"))) == ["a / b"]


def test_citation_texts(spark):
    text = "Miller (2019) A long study. https://a.org/p(1) and 10.1234/ab)."
    assert values(spark, [text], citations.first_url(X), citations.text_without_url(X), citations.doi_link(X)) == [
        ("https://a.org/p(1", "Miller (2019) A long study. ) and 10.1234/ab)", "https://doi.org/10.1234/ab")]
    assert values(spark, ["no link", None], citations.text_without_url(X)) == ["no link", None]
    assert values(spark, ["A very long title, 2019. More", "Short 2019 rest of it."], citations.likely_title(X)) == [
        "A very long title", "Short 2019 rest of it"]
    assert values(spark, ["a b!*'()~é+"], citations.uri_component(X)) == ["a%20b!*'()~%C3%A9%2B"]


def test_document_fields(spark):
    assert values(spark, ["short\nhttps://aaaaaaaaaa.org\n  The real title here \nx", "none"], citations.document_title(X)) == [
        "The real title here", None]
    assert values(spark, ["see 10.1000/abc.., x", " " * 2995 + "10.1000/abc"], citations.document_doi(X)) == ["10.1000/abc", None]
    name = ["Chen et al. - 2025 - An overview - part.pdf.html", "plain.html"]
    assert values(spark, name, citations.file_authors(X), citations.file_year(X), citations.file_work_title(X),
                  citations.file_title(X)) == [("Chen et al.", 2025, "An overview - part", "Chen et al. - 2025 - An overview - part"),
                                               (None, None, None, "plain")]


def test_mineral_cells(spark):
    texts = ['{"F": {"A": 1}}', '{"F": {"A": 1, "B": 2', '{"F": {"A": 1},,', "Basalt", "{broken", None]
    assert values(spark, texts, cells.json_object_text(X)) == [
        '{"F": {"A": 1}}', '{"F": {"A": 1, "B": 2}}', '{"F": {"A": 1}}', None, None, None]


def test_chemical_cells(spark):
    texts = ["SiO2;45.5;stray;Al2O3; 12.3 ;FeO", '{"SiO2": 45.5, "TiO2": null}', "see paper", "A,1,B,2", None, "7;8;9"]
    got = values(spark, texts, cells.chemical_pairs(X))
    assert [[tuple(p) for p in g] if g is not None else None for g in got] == [
        [("SiO2", 45.5), ("Al2O3", 12.3)], [("SiO2", 45.5)], [], [("A", 1.0), ("B", 2.0)], None, [("7", 8.0)]]


def test_planar_distance(spark):
    point = [F.lit(float(v)) for v in (0, 179, 3, -177)]
    assert spark.range(1).select(numbers.planar_distance(*point)).first()[0] == (3 ** 2 + 356 ** 2) ** 0.5


_FRAGMENTS = (
    "<p>", "</p>", "one", "two ", "&amp;", "&lt", "&notit;", "&notin;", "&#65;", "&#x41;", "&#x80;", "&#0;", "&#99999999;", "&#xD800;",
    "&#1;", "&#129;", "&nbsp;", "& ", "&bogus;", "<!-- a > b -->", "<br/>", "<a href=\"x>y\" t='q>r'>", "<a t=it's>",
    "<script>var a='<p>'; </script>", "<STYLE type='a>b'>b{}</style >", "<script src=x/>", "<script async/>", "<!DOCTYPE html>", "<?pi x>",
    "<![CDATA[ a > b ]]>", "\n", " < ", "é😀", "&CounterClockwiseContourIntegral;", "&copy", "<div\nclass=a>", "</ div>", "&#x1F600;",
    "&", "&am", "<", "&#;", "&#x;", "&AElig", "&frac12x;", "&ngE;",
)


def _shown_by_parser(html: str) -> str:
    """Text outside of scripts and styles, from the standard parser's events."""
    events = []
    parser = HTMLParser()
    parser.handle_starttag = lambda tag, _: events.append(("open", tag))
    parser.handle_endtag = lambda tag: events.append(("close", tag))
    parser.handle_data = lambda data: events.append(("text", data))
    parser.feed(html)
    shown, hidden = [], False
    for kind, value in events:
        if kind == "text":
            shown += [] if hidden else [value]
        elif value in ("script", "style"):
            hidden = kind == "open"
    return " ".join(shown)


def test_visible_text_equals_standard_parser(spark):
    draw = random.Random(7)
    pages = ["".join(draw.choices(_FRAGMENTS, k=draw.randint(0, 12))) for _ in range(1500)]
    pages += ["", "x" * 50_000 + "<a " + "b='c' " * 20_000 + ">" + "&amp;" * 5_000, "<!--" + "x" * 50_000, "<script>" + "<p>" * 20_000]
    df = spark.createDataFrame([*enumerate(pages), (-1, None)], "i int, html string")
    got = dict(df.select("i", markup.visible_text(F.col("html"))).collect())
    assert got.pop(-1) == ""
    assert [(p, got[i]) for i, p in enumerate(pages) if got[i] != _shown_by_parser(p)] == []
