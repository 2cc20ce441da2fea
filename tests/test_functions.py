from pyspark.sql import functions as F

from loomstone.functions import nested, rules, text, xml


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return df.select(column.alias("out")).first().out


def test_text_cases(spark):
    cases = [
        (text.squeeze(F.lit(" a  b\n")), "a b"),
        (text.doi_found(F.lit(" https://doi.org/10.1000/ABC.1 ")), "10.1000/abc.1"),
        (text.doi_stripped(F.lit("doi: 10.1000/ABC")), "10.1000/abc"),
        (text.title_key(F.lit("HER2-positive: A Study!")), "her2positiveastudy"),
        (text.pmcid_key(F.lit(" pmc123 ")), "123"),
        (text.yes_no(F.lit("yes.")), True),
        (text.yes_no(F.lit("NOPE")), None),
        (text.level_digit(F.lit("Level 13")), 3),
        (text.boolish(F.array(F.lit("0"), F.lit("Full"))), "true"),
        (text.as_sentence(F.lit("- drug x works")), "drug x works."),
        (text.ingredient_name(F.lit("Active ingredient: Foo (bar) 10 mg,")), "Foo"),
        (text.name_variants(F.lit("Foo (Bar)")), ["bar", "foo", "foo bar"]),
        (text.joined(" | ", F.lit("a"), F.lit("None"), F.lit(" "), F.lit("b")), "a | b"),
        (text.truncated(F.lit("abc def"), 4, "..."), "abc..."),
        (text.tagged_blocks(F.lit("x<<<FACTOID>>> a\nb <<<END_FACTOID>>>")), ["a\nb"]),
    ]
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cases)]).first()
    assert [row[k] for k in range(len(cases))] == [want for _, want in cases]


def test_pages_and_headers(spark):
    md = "<!-- PAGE 2 START -->\nx\n<!-- PAGE 2 END -->\n<!-- PAGE 3 START -->y<!-- PAGE 3 END -->"
    assert [(p.page, p.content.strip()) for p in one(spark, text.pages(F.lit(md)))] == [(2, "x"), (3, "y")]
    assert [(p.page, p.content) for p in one(spark, text.pages(F.lit("z")))] == [(1, "z")]
    whole = "TITLE: A: b\nID: 7\n" + "-" * 80 + "\nbody\nmore"
    assert one(spark, text.header_fields(F.lit(whole))) == {"TITLE": "A: b", "ID": "7"}
    assert one(spark, text.header_body(F.lit(whole))) == "body\nmore"


def test_license_rules(spark):
    cases = {
        "Licensed under CC BY-NC 4.0.": "CC_BY_NC_4_0",
        "Creative Commons Attribution License (CC BY)": "CC_BY_4_0",
        "a Creative Commons license": "CREATIVE_COMMONS_UNCLEAR",
        "open access article": "OPEN_ACCESS_UNCLEAR",
        "All rights reserved.": "UNKNOWN",
        "PMC Open Access Subset for the duration of the COVID-19 pandemic, CC BY 4.0": "PMC_OPEN_ACCESS_TEMP",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.l for r in df.select("t", rules.article_license(F.col("t")).alias("l")).collect()} == cases
    mixed = "creativecommons.org/licenses/by-nc/3.0 and cc by-nd"
    assert one(spark, rules.license_family(F.lit(mixed))) == "CC_BY_ND_3_0"  # the version is found whatever the family


def test_nested(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', named_struct('c', 'x', 'd', array(1, 2))) AS m")
    row = df.select(*nested.flatten(df, "m")).first()
    assert row.asDict() == {"a": "1", "b_c": "x", "b_d": "[1,2]"}
    assert one(spark, nested.pick(F.create_map(F.lit("Title"), F.lit(" "), F.lit("NAME"), F.lit("n")), "title", "name")) == "n"
    assert one(spark, nested.first_string(F.array(F.lit(" "), F.lit("z")))) == "z"


def test_xml(spark):
    doc = "<article xmlns='u'><article-meta><article-id pub-id-type='doi'>10.1/x</article-id><title-group><article-title>T</article-title></title-group><contrib><name><surname>S</surname><given-names>G</given-names></name></contrib><pub-date><year>2020</year></pub-date><abstract><p>a</p><p>b</p></abstract></article-meta></article>"
    fields = xml.article_fields(F.lit(doc))
    row = spark.range(1).select(*[c.alias(k) for k, c in fields.items()]).first()
    assert (row.title, row.doi, row.authors, row.year, row.abstract) == ("T", "10.1/x", "S G", 2020, "a b")
