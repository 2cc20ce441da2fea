"""Elements of XML documents: what a row has, and that documents are parsed once for all that is read from them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomstone.functions import elements as xml
from loomstone.plans import small

DATA = "/root/testdata/sf0.001"


def test_elements_of_odd_documents(spark):
    docs = [(1, "<a> x <!-- c --> y<?p i?> z<b q='1' u:q='2' xmlns:u='u'/>tail <b>w</b>  e</a>"), (2, "<a><b></a>"), (3, None), (4, ""), (5, "<N:a xmlns:N='n'>x<i>y</i>z<c> u\n</c></N:a>")]
    rows = xml.parsed(spark.createDataFrame(docs, "id long, body string"), "id", "body")
    got = [(r.id, r.at, r.parent, r.path, r.above, r.attributes, r.text, r.tight) for r in rows.orderBy("id", "at").collect()]
    assert got == [
        (1, 0, -1, "/a", [], {}, "x y z tail w e", "x y ztail w e"), (1, 1, 0, "/a/b", [0], {"q": "2"}, "", ""), (1, 2, 0, "/a/b", [0], {}, "w", "w"),
        (5, 0, -1, "/a", [], {}, "x y z u", "xyz u"), (5, 1, 0, "/a/i", [0], {}, "y", "y"), (5, 2, 0, "/a/c", [0], {}, "u", "u"),
    ]


def test_batches_of_elements_keep_documents_whole(spark, monkeypatch):
    monkeypatch.setattr(xml, "BATCH_CHARS", 1)
    rows = xml.parsed(spark.createDataFrame([(i, f"<a><b>{i}</b></a>") for i in range(20)], "id long, body string"), "id", "body")
    assert sorted((r.id, r.at, r.text) for r in rows.collect()) == [(i, at, str(i)) for i in range(20) for at in (0, 1)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["journal_section_paragraphs", "publisher_full_text", "publisher_metadata", "publisher_signals", "publisher_title_abstract", "publisher_ids", "publisher_license_fields", "journal_full_text", "journal_signals"])
def test_queries_read_kept_elements(spark, name):
    plan = getattr(small, name)(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Bucketed: true" in plan


NAMES = "r coredata description title doi article-title originaltext article head abstract abstract-sec body sections section section-title para simple-para table row entry label caption legend table-footnote textbox".split()


def _odd_article(rng, most=60):
    """An article that nests a publisher's elements as it likes."""
    whole, left = [], [most]
    usual = {"r": ["coredata", "article"], "article": ["head", "body", "table", "textbox"], "head": ["abstract", "title"], "abstract": ["abstract-sec", "para"], "abstract-sec": ["section-title", "para", "simple-para"], "body": ["section", "sections"], "sections": ["section"], "section": ["section", "section-title", "para"], "table": ["row", "label", "legend", "table-footnote", "table"], "row": ["entry"], "textbox": ["para", "label", "caption", "textbox"], "coredata": ["description", "title"]}

    def add(name, depth):
        left[0] -= 1
        whole.append(f"<{name}" + (f" doi=' {rng.choice(['', 'a', 'b'])}'" if rng.random() < 0.1 else "") + ">" + rng.choice(["", "", f" t{left[0]} "]))
        for _ in range(rng.randrange(5) if depth else 5):
            if left[0] > 0 and depth < 8:
                add(rng.choice(usual.get(name, NAMES)) if rng.random() < 0.85 else rng.choice(NAMES), depth + 1)
        whole.append(f"</{name}>" + rng.choice(["", f"u{left[0]}"]) * (depth > 0))

    add("r", 0)
    return "".join(whole)


def test_full_text_of_one_pass_is_that_of_its_parts(spark):
    rng = random.Random(5)
    docs = [(i, _odd_article(rng)) for i in range(400)] + [(1000, "<para>x</para>"), (1001, "<a/>"), (1002, "<r><table>" + "".join(f"<row><entry>{i}</entry></row>" for i in range(260)) + "</table></r>")]
    rows = xml.parsed(spark.createDataFrame(docs, "id long, body string"), "id", "body")
    joined = lambda own, at: own.groupBy("id").agg(xml.in_order(F.col("text"), F.col(at), "\n\n").alias(f"{at}s"))
    met = xml.article_ids(rows, "id")
    for part in (xml.abstract_text(rows, "id"), xml.body_text(rows, "id"), joined(xml.table_texts(rows, "id"), "table"), joined(xml.panel_texts(rows, "id"), "panel")):
        met = met.join(part, "id", "left")
    want = {r.id: r.t for r in met.select("id", xml.full_text(F.col("title"), F.lit(None).cast("string"), F.col("doi"), F.col("abstract"), F.col("body"), F.col("tables"), F.col("panels")).alias("t")).collect()}
    got = {r.id: r.full_text for r in xml.publisher_full_text(rows, "id").collect()}
    assert got == want and len(got) == len(docs)
    assert all(sum(head in t for t in got.values()) > 20 for head in ("ABSTRACT", "BODY", "TABLES", "PANELS"))


def test_full_text_has_all_rows_of_its_tables(spark):
    sizes = {1: 249, 2: 250, 3: 251, 4: 1200}
    table = lambda n: "<table><label>T</label>" + "".join(f"<row><entry>{i}</entry><entry/></row>" for i in range(n)) + "<legend>end</legend></table>"
    rows = xml.parsed(spark.createDataFrame([(k, f"<r><article>{table(n)}{table(2)}</article></r>") for k, n in sizes.items()], "id long, body string"), "id", "body")
    text = lambda n: "\n\n".join(["T", "\n".join(f"{i} |  " for i in range(n)), "Legend: end"])
    assert {r.id: r.full_text for r in xml.publisher_full_text(rows, "id").collect()} == {k: f"Title: \n\nTABLES\n{text(n)}\n\n{text(2)}" for k, n in sizes.items()}
    assert {(r.id, r.text) for r in xml.table_texts(rows, "id").collect()} == {(k, text(m)) for k, n in sizes.items() for m in (n, 2)}


def test_metadata_and_signals_of_odd_articles(spark):
    docs = [
        (1, "<r><author-group><author><surname>no</surname></author></author-group><article><head><author-group><author><surname>S</surname><given-name/><given-name>G</given-name><given-name>H</given-name></author><author/><author><x><surname>deep</surname></x></author></author-group><title/><title>T</title></head></article></r>"),
        (2, "<r><coredata><creator/><creator>C</creator><x><creator>D</creator></x><doi>1</doi></coredata><doi>2</doi><article><head><author-group><author><surname>S</surname></author></author-group><abstract><x><para>a</para></x>out<para>b</para></abstract><abstract/><abstract><abstract><para>c</para></abstract></abstract></head><body><section><section-title/><section-title>METHODS</section-title>m<section><section-title>Material</section-title>n</section></section></body></article></r>"),
        (3, "<coredata><title>x</title></coredata>"), (4, "<e/>"),
    ]
    rows = xml.parsed(spark.createDataFrame(docs, "id long, body string"), "id", "body")
    made = {r.id: r for r in xml.publisher_metadata(rows, "id", F.concat(F.col("id").cast("string"), F.lit(".xml"))).collect()}
    assert {i: (r.document_title, r.authors, r.doi) for i, r in made.items()} == {1: ("T", ["G S"], None), 2: ("2", ["C"], "1"), 3: ("x", [], None), 4: ("4", [], None)}
    told = {r.id: (r.title, r.abstract, r.methods) for r in xml.publisher_signals(rows, "id").collect()}
    assert told == {1: ("T", "", ""), 2: ("", "a b | c", "METHODS m Material n"), 3: ("x", "", ""), 4: ("", "", "")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["publisher_full_text", "publisher_metadata", "publisher_signals"])
def test_elements_are_read_once_and_stay_where_they_are(spark, name):
    plan = getattr(small, name)(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
