from pyspark.sql import functions as F

from loomstone.functions import harmonise, markdown
from loomstone.plans import drug_labels, licensing, stages

APPS = "at long, application_number string, sponsor_name string, submissions array<struct<submission_status_date:string>>, products array<struct<brand_name:string,marketing_status:string>>, openfda struct<spl_set_id:array<string>,spl_id:array<string>,generic_name:array<string>,brand_name:array<string>,substance_name:array<string>>"
LABELS = "label_id long, set_id string, id string, active_ingredient array<string>, openfda struct<spl_set_id:array<string>,spl_id:array<string>,generic_name:array<string>,brand_name:array<string>,substance_name:array<string>>"


def fda(sets=(), ids=(), generic=()):
    return (list(sets), list(ids), list(generic), [], [])


def test_label_cascade(spark):
    apps = spark.createDataFrame(
        [
            (1, "A1", "s", [("20200101",)], [("b", "Discontinued")], fda(["set1"], ["id1"], ["Drug One"])),
            (2, "A2", "s", [("20190101",)], [("b", "Prescription")], fda(["set1"], ["id2"])),
            (3, "A2", "s", [("20990101",)], [("b", "Prescription")], fda(["set1"], ["id2"])),
            (4, "A4", "t", None, None, fda([], ["id4"])),
        ],
        APPS,
    )
    labels = spark.createDataFrame(
        [
            (1, "x", "y", None, fda(["set1"])),  # the prescription product wins; the repeated record is gone
            (2, "set1", "id4", None, fda(["unknown"])),  # set1 decides, but nested ids fail validation
            (3, None, "id4", None, fda()),
            (4, "zz", "zz", ["Active ingredient: Drug One 5 mg"], fda()),
            (5, None, None, None, None),
        ],
        LABELS,
    )
    unique = drug_labels.unique_applications(apps, "at")
    got = {r.label_id: (r.method, r.candidates, r.app_id) for r in drug_labels.link(labels, unique).collect()}
    assert got == {1: ("matched_by_spl_set_id", 2, 2), 2: ("matched_by_spl_set_id_validation_failed", 2, None), 3: ("matched_by_spl_id", 1, 4), 4: ("unmatched", 0, None), 5: ("unmatched", 0, None)}
    links = drug_labels.link(labels, unique, with_names=True)
    assert {r.label_id: r.method for r in links.collect()}[4] == "matched_by_name_fallback"
    rows = {r.label_id: r for r in drug_labels.merged(labels, unique, links).collect()}
    assert rows[1].metadata.application_number == "A2" and rows[2].metadata is None and rows[2].status == "unmatched"


def test_licensing(spark):
    seen = []

    def model(texts):
        return ["family: cc_by_nc" if "beta" in t else "?" for t in texts]

    rows = spark.createDataFrame([(1, "CC BY 4.0"), (2, "a creative commons beta, creative commons attribution 3.0"), (3, "creative commons"), (4, None)], "id long, license_text string")
    got = {r.id: (r.license_label, r.license_label_source) for r in licensing.analyse(rows, model).collect()}
    assert got == {1: ("CC_BY_4_0", "rule"), 2: ("CC_BY_NC_3_0", "model"), 3: ("CREATIVE_COMMONS_UNCLEAR", "model"), 4: ("NO_LICENSE_TEXT", "rule")}
    assert not seen
    docs = spark.createDataFrame([("a", None), ("b", "x"), (" ", None), ("c", None)], "k string, license_label string")
    labels = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 1), ("c", " ", 1)], "k string, license_label string, at long")
    got = {r.k: (r.license_label, r.status) for r in licensing.copy_to_documents(docs, labels, "k").collect()}
    assert got == {"a": ("new", "updated"), "b": ("x", "unchanged"), " ": (None, "no_key"), "c": (None, "not_found")}
    docs = spark.createDataFrame([("AGO", "t"), ("epmc", "meta"), ("epmc2", "none")], "source string, signals string")
    got = {r.source: (r.level and r.level.level, r.level_status) for r in licensing.label_levels(docs, {"AGO": 1}, lambda ts: ["level 3" if t == "meta" else "?" for t in ts], "signals").collect()}
    assert got == {"AGO": (1, "direct"), "epmc": (3, "model"), "epmc2": (None, "failed")}


def test_harmonise(spark):
    rows = spark.createDataFrame([('{"name_of_medicine":" A  b ","atc_code_human":["x","y"],"status":""}',)], "j string").select(F.parse_json("j").alias("r"))
    row = harmonise.common_record(rows, "r", "medicines").first()
    assert (row.entity_name, row.classification, row.status, row.dataset_key) == ("A b", "x y", "", "medicines")
    years = spark.createDataFrame([("12/03/2019", "x"), (None, "1850"), ("2001", "2020-01-01")], "a string, b string")
    assert years.agg(harmonise.latest_year(years, ["a", "b"], 7).alias("y")).first().y == 2020


def test_markdown(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    md = "```markdown\n**Footer text**: x\nbody ﬁ\n\n\n\nVolume 3 of it\n\\begin{tabular}z\\end{tabular} [blank]\n```"
    assert one(md, markdown.clean_markdown) == "> Page margin/header/footer text: x\nbody fi\n\n[unclear table formatting removed] [unclear]\n\n> Page margin/header/footer text:\n> Volume 3 of it"
    lines = ["a long enough line of plain prose that goes on", "and continues with these other words", "hyphen-", "ated", "", "- item one that is long enough to be a line"]
    want = ["a long enough line of plain prose that goes on and continues with these other words", "hyphenated", "", "- item one that is long enough to be a line"]
    assert one("\n".join(lines), lambda c: markdown.joined_lines(F.split(c, "\n"))) == want
    page = lambda c: markdown.page_markdown(c, F.lit(4))
    assert one("RESULTS OF IT\n\n\nx", page) == "### RESULTS OF IT\n\nx" and one(" ", page) == "[No extractable native text on page 4]"
    assert one("OUR FOLLOW-UP IN 3D\nAbstract of it\nplain", page) == "### Our Follow-Up In 3D\n### Abstract of it\nplain"
    assert one("text\n© 2020 them\nDOI: 10.1/x", page) == "text\n\n> Page margin/header/footer text:\n> © 2020 them\n> DOI: 10.1/x"
    assert one(None, page) is None and one(None, markdown.clean_markdown) is None


def test_labels_match_by_all_names_together(spark):
    products = "array<struct<brand_name:string,marketing_status:string,active_ingredients:array<struct<name:string>>>>"
    kind = APPS.replace("array<struct<brand_name:string,marketing_status:string>>", products)
    apps = spark.createDataFrame(
        [
            (1, "A1", "s", None, [("Alpha", "Discontinued", [("Oxid",)])], fda()),
            (2, "A2", "s", None, [("Beta", "Prescription", None)], fda()),
            (3, "A3", "s", None, None, fda(generic=["Gamma"])),
        ],
        kind,
    )
    labels = spark.createDataFrame([(1, None, None, ["Active ingredient: Oxid 5 mg"], fda(generic=["beta"])), (2, None, None, None, fda(generic=["GAMMA"])), (3, None, None, None, fda(generic=["delta"]))], LABELS)
    got = {r.label_id: (r.method, r.candidates, r.app_id) for r in drug_labels.link(labels, drug_labels.unique_applications(apps, "at"), with_names=True).collect()}
    assert got == {1: ("matched_by_name_fallback_ambiguous", 2, 2), 2: ("matched_by_name_fallback", 1, 3), 3: ("unmatched", 0, None)}


def test_stages(spark, tmp_path):
    made = []

    def first(s, t):
        made.append("first")
        return s.range(3)

    plan = [stages.Stage("first", first, {"some": lambda n, c: n > 0}), stages.Stage("second", lambda s, t: t["first"].where("id > 0"), {"fewer": lambda n, c: n <= c["first"]}), stages.Stage("third", lambda s, t: t["second"], {"never": lambda n, c: False})]
    got = stages.run(spark, plan, str(tmp_path))
    assert [(r.name, r.status, r.rows) for r in got] == [("first", "run", 3), ("second", "run", 2), ("third", "failed", 2)]
    assert [r.status for r in stages.run(spark, plan[:2], str(tmp_path))] == ["skipped", "skipped"] and made == ["first"]
