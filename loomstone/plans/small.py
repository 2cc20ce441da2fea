"""More of the query catalogue: articles in XML, metadata of records, counts, limits and lookups, each with its SQL.

Queries on XML and JSON make a document of each part from a template; SQL makes the answer from the columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import elements as xml
from ..functions import harmonise, metadata, rules, text
from ..operators import audit, dedupe
from ..session import spread, table
from . import drug_labels, embedding_rows
from .catalogue import query

#: What stands for a part's columns in the templates of documents and of their answers.
PLACES = {"@K": "CAST(p_partkey AS VARCHAR)", "@N": "p_name", "@B": "p_brand", "@T": "p_type", "@U": "upper(p_name)", "@Y": "CAST(2000 + p_size AS VARCHAR)"}


def _filled(template: str) -> Column:
    """A template with the columns of a part."""
    out = F.lit(template)
    for place, column in PLACES.items():
        out = F.replace(out, F.lit(place), F.expr(column.replace("VARCHAR", "STRING")))
    return out


def _sql(template: str) -> str:
    """The same in SQL."""
    out = "'" + template.replace("'", "''") + "'"
    for place, column in PLACES.items():
        out = f"replace({out}, '{place}', {column})"
    return out


PUBLISHED = """<full-text-retrieval-response xmlns="http://p/svapi" xmlns:dc="http://dc" xmlns:ce="http://ce" xmlns:xlink="http://x" openaccessArticle="true">
<coredata><dc:title> @N  <i>tit</i>le </dc:title><dc:description>Core @T</dc:description><openaccess>1</openaccess><openaccessUserLicense>http://creativecommons.org/licenses/by/4.0/</openaccessUserLicense></coredata>
<originalText><doc><ce:doi>10.1/@K</ce:doi><title>@N title</title><article><head><ce:abstract><ce:abstract-sec><ce:section-title>Aims</ce:section-title><ce:simple-para>One @B.</ce:simple-para><ce:simple-para>Two.</ce:simple-para></ce:abstract-sec></ce:abstract></head>
<body><ce:sections><ce:section><ce:section-title>First</ce:section-title><ce:para>Alpha <b>@T</b>.</ce:para><ce:section><ce:section-title>Inner @N</ce:section-title><ce:para>Gamma.</ce:para></ce:section><ce:para>Delta.</ce:para></ce:section></ce:sections></body>
<ce:table><ce:label>Table 1</ce:label><ce:caption>Doses of @B</ce:caption><row><entry>@K</entry><entry></entry></row><row><entry></entry><entry></entry></row><row><entry>b</entry><entry>c</entry></row><ce:legend>mg</ce:legend><ce:table-footnote>none</ce:table-footnote></ce:table>
<ce:textbox><ce:label>Box</ce:label><ce:caption>Key @T</ce:caption><ce:para>Boxed.</ce:para></ce:textbox>
<ce:copyright>@B</ce:copyright><license xlink:href="https://creativecommons.org/licenses/by/4.0/">CC BY</license></article></doc></originalText></full-text-retrieval-response>"""
BARE = """<r doi="10.2/@K"><abstract><para>P @N</para><para>p @U</para></abstract><copyright>@T</copyright></r>"""
BROKEN = "<a><b>@K</a>"
JOURNAL = """<article article-type="review-article" xmlns:x="u"><front><journal-title>J @B</journal-title><article-title>@N <i>x</i></article-title><subj-group><subject>@T</subject></subj-group><kwd-group><kwd>k@K</kwd><kwd>k2</kwd></kwd-group>
<abstract><title>Aim</title><p>Find @N.</p></abstract><abstract abstract-type="graphical"><p>No</p></abstract></front><body><p>Lead.</p><sec sec-type="intro"><title>Intro</title><p>One @B.</p><sec><title>Deep</title><p>Two.</p><fig><p>Gone.</p></fig></sec><p>Three.</p></sec><sec><title>Methods used</title><p>Four @K.</p></sec></body></article>"""
NOTE = """<article article-type="@T"><front><article-title>@N</article-title></front><body><p>Lead @B.</p><p>More.</p></body></article>"""


def _articles(spark, sf_dir, even: str, odd: str):
    """An article of each part: a template for even sizes, another for odd ones, a broken text for every tenth size."""
    body = F.when(F.col("p_size") % 10 == 9, _filled(BROKEN)).when(F.col("p_size") % 2 == 0, _filled(even)).otherwise(_filled(odd))
    return xml.parsed(table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey")), "id", body)


_EVEN, _ODD = "FROM part WHERE p_size % 2 = 0", "FROM part WHERE p_size % 2 = 1 AND p_size % 10 <> 9"


@query(f"""SELECT p_partkey AS id, f AS field, CASE f WHEN 'copyright' THEN [p_brand] WHEN 'openaccess' THEN ['1'] WHEN 'openaccessArticle' THEN ['true'] WHEN 'openaccessUserLicense' THEN ['http://creativecommons.org/licenses/by/4.0/'] ELSE ['CC BY', 'https://creativecommons.org/licenses/by/4.0/'] END AS "values"
FROM part, (SELECT unnest(['openaccessArticle', 'openaccess', 'openaccessUserLicense', 'copyright', 'license_text']) AS f) WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'copyright', [p_type] {_ODD}""")
def publisher_license_fields(spark, sf_dir):
    return xml.license_fields(_articles(spark, sf_dir, PUBLISHED, BARE), "id")


@query(f"SELECT p_partkey AS id, '10.1/' || p_partkey AS doi, p_name || ' tit le' AS title {_EVEN} UNION ALL SELECT p_partkey, '10.2/' || p_partkey, '' {_ODD}")
def publisher_ids(spark, sf_dir):
    return xml.article_ids(_articles(spark, sf_dir, PUBLISHED, BARE), "id")


@query(f"SELECT p_partkey AS id, p_name || ' title' AS title, 'Core ' || p_type AS abstract {_EVEN} UNION ALL SELECT p_partkey, '', 'P ' || p_name || ' p ' || upper(p_name) {_ODD}")
def publisher_title_abstract(spark, sf_dir):
    return xml.title_and_abstract(_articles(spark, sf_dir, PUBLISHED, BARE), "id")


@query("SELECT p_partkey AS id, " + _sql("""Title: @N tit le
DOI: 10.1/@K

ABSTRACT
Aims
One @B.
Two.

BODY
First

Alpha @T .

Inner @N

Gamma.

Delta.

TABLES
Table 1: Doses of @B

@K |  
b | c

Legend: mg

Footnotes:
none

PANELS
Box: Key @T

Boxed.""") + f""" AS full_text {_EVEN} UNION ALL SELECT p_partkey, 'Title: ' || chr(10) || 'DOI: 10.2/' || p_partkey {_ODD}""")
def publisher_full_text(spark, sf_dir):
    return xml.publisher_full_text(_articles(spark, sf_dir, PUBLISHED, BARE), "id")


@query(f"SELECT p_partkey AS id, 'P ' || p_name || ' p ' || upper(p_name) || chr(10) || chr(10) || 'P ' || p_name AS text {_ODD}")
def fallback_paragraphs(spark, sf_dir):
    """Elements' texts by name, without those that say the same in another case."""
    return xml.fallback_text(_articles(spark, sf_dir, BROKEN, BARE), "id")


@query("SELECT p_partkey AS id, " + _sql("""@N x

ABSTRACT
Aim Find @N.

No

MAIN TEXT
Intro

One @B.

Two.

Three.

Deep

Two.

Methods used

Four @K.""") + f" AS text {_EVEN} UNION ALL SELECT p_partkey, " + _sql("@N\n\nMAIN TEXT\nLead @B.\n\nMore.") + f" {_ODD}")
def journal_full_text(spark, sf_dir):
    return xml.journal_text(_articles(spark, sf_dir, JOURNAL, NOTE), "id")


CORE = """<r xmlns:d="u"><coredata><d:title>@N</d:title><d:doi>10.1/@K</d:doi><d:publicationName>J @B</d:publicationName><d:aggregationType>Journal</d:aggregationType><d:pubType> fla </d:pubType><number>@K</number><coverDate>@Y-05-06</coverDate><d:creator>@B, A</d:creator><d:creator>@T, C</d:creator><d:description>Core @T.</d:description></coredata>
<scopus-id>s@K</scopus-id><doc><article><head><title>Not this</title><abstract><section-title>Aim</section-title><para>Is @N.</para></abstract><abstract><simple-para>Short.</simple-para></abstract></head><body><section><section-title>Intro</section-title><para>x</para></section><section><section-title>Materials</section-title><para>Used @N and @B.</para></section></body></article></doc></r>"""
HEAD = """<r><document-type>ar</document-type><cover-date-start>1999 or @Y</cover-date-start><doc><article><head><title>Head @N</title><author-group><author><given-name>A</given-name><surname>@T</surname></author><author><surname>B</surname></author></author-group></head></article></doc></r>"""


@query(f"""SELECT p_partkey AS id, 'Elsevier' AS source_family, 'XML' AS source_format, p_partkey || '.xml' AS file_name, p_name AS document_title, 'Journal' AS document_type, 'fla' AS document_subtype, 2000 + p_size AS document_year, CAST(p_partkey AS VARCHAR) AS issue, [p_brand || ', A', p_type || ', C'] AS authors,
'10.1/' || p_partkey AS doi, 'J ' || p_brand AS journal, (2000 + p_size) || '-05-06' AS cover_date, 'Core ' || p_type || '.' AS abstract_from_coredata, 's' || p_partkey AS scopus_id, 27 AS fields {_EVEN}
UNION ALL SELECT p_partkey, 'Elsevier', 'XML', p_partkey || '.xml', 'Head ' || p_name, 'ar', NULL, 1999, NULL, ['A ' || p_type, 'B'], NULL, NULL, NULL, NULL, NULL, 27 {_ODD}""")
def publisher_metadata(spark, sf_dir):
    """Fifteen of the 27 fields; the others are read alike."""
    made = xml.publisher_metadata(_articles(spark, sf_dir, CORE, HEAD), "id", F.concat(F.col("id").cast("string"), F.lit(".xml")))
    shown = ("source_family", "source_format", "file_name", "document_title", "document_type", "document_subtype", "document_year", "issue", "authors", "doi", "journal", "cover_date", "abstract_from_coredata", "scopus_id")
    return made.select("id", *shown, F.lit(len(made.columns) - 1).alias("fields"))


@query(f"""SELECT p_partkey AS id, p_name AS title, 'J ' || p_brand AS journal, 'fla' AS article_type, '' AS document_subtype, 'Core ' || p_type || '. | Aim Is ' || p_name || '. | Short.' AS abstract,
CASE WHEN length(m) > 30 THEN rtrim(left(m, 30)) || '...' ELSE m END AS methods FROM (SELECT *, 'Materials Used ' || p_name || ' and ' || p_brand || '.' AS m {_EVEN}) UNION ALL SELECT p_partkey, 'Head ' || p_name, '', 'ar', '', '', '' {_ODD}""")
def publisher_signals(spark, sf_dir):
    return xml.publisher_signals(_articles(spark, sf_dir, CORE, HEAD), "id", methods_chars=30)


_DOC = '{"metadata":{"source_family":"@T","TITLE":" Title of @N ","document_year":@Y,"doi":null,"file_name":"dir/f@K.xml","tags":["b","@B"],"deep":{"y":1,"x":{"z":"@N","n":null}},"journal":"None"},"factoids":[{"id":1,"factoid_text":" first @N ","section":"S"},{"id":0,"factoid_text":"zero"},{"factoid_text":"no id"},{"id":"b","factoid_text":"  "},"odd",{"id":"c","factoid_text":"last @B","topic":{"b":2,"a":1}}]}'


def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "part")).select(F.concat(F.lit("j"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("file_name"), F.parse_json(_filled(_DOC)).alias("doc"))


@query("""WITH f(fid, txt, tail, own) AS (VALUES ('1', 'first @N', ' | S', 1), ('0', 'zero', '', 0), ('3', 'no id', '', 0), ('c', 'last @B', ' | {"a":1,"b":2}', 1))
SELECT 'f' || p_partkey || '_' || fid AS id, t AS document, p_type || ' | ' || (2000 + p_size) || tail || ' | ' || t AS embedding_text, 'Title of ' || p_name AS title, '["b","' || p_brand || '"]' AS tags, '{"x":{"n":null,"z":"' || p_name || '"},"y":1}' AS deep, 13 + own AS fields
FROM (SELECT *, replace(replace(txt, '@N', p_name), '@B', p_brand) AS t FROM part, f)""")
def literature_rows(spark, sf_dir):
    made = embedding_rows.literature_rows(_documents(spark, sf_dir))
    get = lambda name: F.try_element_at("metadata", F.lit(name))
    return made.select("id", "document", "embedding_text", get("document_title").alias("title"), get("doc_tags").alias("tags"), get("doc_deep").alias("deep"), F.size("metadata").alias("fields"))


@query("""WITH f(fid, txt) AS (VALUES ('1', 'first @N'), ('c', 'last @B'))
SELECT 'f' || p_partkey || '_' || fid AS id, t AS document, p_type || ' | ' || (2000 + p_size) || ' | ' || t AS embedding_text, '["b","' || p_brand || '"]' AS tags, p_name AS deep_x_z, fid AS local_id, 10 AS fields
FROM (SELECT *, replace(replace(txt, '@N', p_name), '@B', p_brand) AS t FROM part, f)""")
def guideline_rows(spark, sf_dir):
    made = embedding_rows.guideline_rows(_documents(spark, sf_dir))
    get = lambda name: F.try_element_at("metadata", F.lit(name)).alias(name)
    return made.select("id", "document", "embedding_text", get("tags"), get("deep_x_z"), get("local_id"), F.size("metadata").alias("fields"))


@query("""SELECT p_partkey || '.json' AS file_name, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS generic_name, CASE WHEN p_size % 2 = 0 THEN [p_brand, p_type] ELSE [p_brand] END AS brand_names, 'one ' || p_name || chr(10) || chr(10) || 'two' AS warnings, 'kid' || chr(10) || chr(10) || 'old ' || p_type AS special_populations,
'S' || p_partkey AS source_label_set_id, p_type AS application_number, (2000 + p_size) || '0102' AS label_date, p_size AS candidates, CASE WHEN p_size % 2 = 0 THEN 'note ' || p_brand ELSE '' END AS bc_notes, 15 AS metadata_fields, 18 AS curated FROM part""")
def seed_records(spark, sf_dir):
    """Ten of the fields of records made from a list's row, an application's metadata and a label."""
    even = F.col("p_size") % 2 == 0
    brand = F.when(even, _filled('["@B"," @B!","@T"]')).otherwise(_filled('"@B"'))
    record = F.concat(_filled('{"metadata":{"application_number":"","effective_time":null,"brand_name":'), brand, _filled('},"label":{"set_id":"S@K","effective_time":"@Y0102","warnings_and_cautions":["one @N"," ","two"],"pediatric_use":" kid ","geriatric_use":["old @T"],"openfda":{"brand_name":["@B"],"application_number":["@T"]}},"metadata_match_candidates":'), F.col("p_size").cast("string"), F.lit("}"))
    csv = F.when(even, F.create_map(F.lit("generic_name"), F.col("p_name"), F.lit("notes"), _filled("note @B"))).otherwise(F.create_map(F.lit("generic_name"), F.lit(" ")))
    rows = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".json")).alias("file_name"), F.parse_json(record).alias("record"), csv.alias("csv"))
    made = drug_labels.seed_records(rows, F.current_date())
    m, c = ([f"{k}.{n}" for n in names] for k, names in (("metadata", ("file_name", "source_label_set_id", "application_number")), ("curated_fields", ("generic_name", "brand_names", "warnings", "special_populations", "label_date", "bc_notes"))))
    sizes = [F.lit(len(made.schema[k].dataType.fieldNames())).alias(n) for k, n in (("metadata", "metadata_fields"), ("curated_fields", "curated"))]
    return made.select(*m, *c, F.col("metadata.metadata_match_candidates").alias("candidates"), *sizes)


@query(f"""SELECT p_partkey AS id, replace(replace(replace(t, '@N', p_name), '@B', p_brand), '@K', CAST(p_partkey AS VARCHAR)) AS text
FROM part, (SELECT unnest(['Find @N.', 'No', 'Lead.', 'Intro One @B.', 'Deep Two.', 'Gone.', 'Intro Three.', 'Methods used Four @K.']) AS t) WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'Lead ' || p_brand || '.' {_ODD} UNION ALL SELECT p_partkey, 'More.' {_ODD}""")
def journal_section_paragraphs(spark, sf_dir):
    return xml.section_paragraphs(_articles(spark, sf_dir, JOURNAL, NOTE), "id").select("id", "text")


@query(f"""SELECT p_partkey AS id, 'review-article' AS article_type, p_name || ' x' AS title, 'J ' || p_brand AS journal, [p_type] AS categories, ['k' || p_partkey, 'k2'] AS keywords, 'AIM Find ' || p_name || '.' AS abstract,
CASE WHEN length('Methods used Four ' || p_partkey || '.') > 20 THEN rtrim(left('Methods used Four ' || p_partkey || '.', 20)) || '...' ELSE 'Methods used Four ' || p_partkey || '.' END AS methods {_EVEN} UNION ALL SELECT p_partkey, p_type, p_name, '', [], [], '', '' {_ODD}""")
def journal_signals(spark, sf_dir):
    return xml.classifier_signals(_articles(spark, sf_dir, JOURNAL, NOTE), "id", methods_chars=20)


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'x' || chr(10) || '  Table 3 doses' || chr(10) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN replace(replace(text, 'ma', chr(64257)), 'en', chr(173)) ELSE text END AS text FROM documents),
l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM t),
m AS (SELECT *, length(text) AS n, length(text) - length(replace(text, chr(64257), '')) AS ligatures, length(text) - length(replace(text, chr(173), '')) AS soft, len(list_filter(lines, lambda x: ends_with(x, '-'))) AS hyphens, CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: length(x) < 35)) / len(lines) ELSE 1.0 END AS short FROM l)
SELECT doc_id, CAST(n AS INTEGER) AS char_count, CAST(len(lines) AS INTEGER) AS line_count, CAST(ligatures AS INTEGER) AS ligatures, CAST(soft AS INTEGER) AS soft_artifacts, CAST(hyphens AS INTEGER) AS hyphen_ends, round(short, 6) AS short_line_ratio, round((ligatures + soft) / greatest(n, 1), 6) AS weird_ratio,
n >= 1000 AND ligatures <= 12 AND hyphens <= 18 AND short <= 0.55 AND NOT contains(lower(text), 'continued') AND NOT regexp_matches(text, '(?im)^\\s*table\\s') AS usable FROM m""")
def text_layer_gate(spark, sf_dir):
    """Whether texts would do as a page's text layer; some have ligatures, soft hyphens or a table put in."""
    docs = table(spark, sf_dir, "documents")
    marred = F.when(F.col("doc_id") % 2 == 0, F.replace(F.replace("text", F.lit("ma"), F.lit("\ufb01")), F.lit("en"), F.lit("\u00ad"))).otherwise(F.col("text"))
    made = docs.select("doc_id", F.concat(F.when(F.col("doc_id") % 17 == 0, "x\n  Table 3 doses\n").otherwise(""), marred).alias("text"))
    q = made.select("doc_id", "text", rules.text_quality(F.col("text")).alias("q")).withColumn("usable", rules.is_usable_text(F.col("text"), F.col("q")))
    rounded = [F.round(f"q.{n}", 6).alias(n) for n in ("short_line_ratio", "weird_ratio")]
    return q.select("doc_id", *[f"q.{n}" for n in ("char_count", "line_count", "ligatures", "soft_artifacts", "hyphen_ends")], *rounded, "usable")


@query("""SELECT page_id, 'A & <b> ' || page_id || ' end' AS shown, '8' || page_id AS scopus, 'https://x/p?after=' || page_id AS following, 'http://s?cursor=' || page_id || '&query=breast+cancer&count=25' AS link, 'file' || page_id AS dataset FROM pages""")
def link_and_text_repair(spark, sf_dir):
    k = F.col("page_id").cast("string")
    made = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return table(spark, sf_dir, "pages").select(
        "page_id", metadata.html_text(made("A&nbsp;&amp; &lt;b&#62; ", k, "&ensp;\n&#xa0;end")).alias("shown"), metadata.scopus_id(made("SCOPUS_ID:8", k, " ")).alias("scopus"),
        metadata.next_link(made('<https://x/>; rel="first", <https://x/p?after=', k, '>; rel="next"')).alias("following"), metadata.repaired_link(made("http://s?cursor=", k, "&count="), "breast cancer", 25).alias("link"),
        metadata.dataset_key(made("/data/File", k, ".JSON")).alias("dataset"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'AGO 2023 x' END AS title, 2000 + p_size AS year, CASE WHEN contains(lower(p_name), 'consensus') THEN 'Consensus Statement' WHEN contains(lower(p_name), 'living') THEN 'Living Guideline Update'
WHEN p_size > 25 THEN 'Guideline' ELSE 'ESMO Breast Cancer Document' END AS type FROM part""")
def guideline_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    year = (F.col("p_size") + 2000).cast("string")
    stem = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("AGO_"), year, F.lit("E_01_"), F.translate("p_name", " ", "_"), F.lit("_REF"))).otherwise(F.concat(F.lit("AGO_"), year, F.lit("E_01_AGO_2023_x")))
    made = p.select("p_partkey", metadata.stem_metadata(stem).alias("m"), metadata.document_type(F.col("p_name"), F.when(F.col("p_size") > 25, "a Guideline.pdf")).alias("type"))
    return made.select("p_partkey", "m.title", "m.year", "type")


@query("""SELECT p_partkey AS id, 'The Living ' || p_name AS title, 'Living Guideline Update' AS type, 2024 AS year, 'eso_' || (2000 + p_size) || '.pdf' AS source, 'ESMO eUp' AS family FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, p_name || ' file ' || (2000 + p_size), 'ESMO Breast Cancer Document', 2000 + p_size, NULL, 'ESMO' FROM part WHERE p_size % 3 = 1
UNION ALL SELECT p_partkey, 'a guideline ' || (2000 + p_size), 'Guideline', 2000 + p_size, 'a-guideline_' || (2000 + p_size) || '.pdf', 'ESMO' FROM part WHERE p_size % 3 = 2""")
def markdown_headers(spark, sf_dir):
    """Titles, types and years of Markdown documents with headers, without any, and with a file named alone."""
    kind = F.col("p_size") % 3
    stem = F.when(kind == 0, F.lit("x2024")).when(kind == 1, _filled("@N_file-@Y")).otherwise(F.lit("z"))
    md = F.when(kind == 0, _filled("Source PDF: `eso_@Y.pdf`\nDocument family: `ESMO eUp`\n\n#  The  Living @N \n# other")).when(kind == 1, F.lit("no header")).otherwise(_filled("Source PDF: `a-guideline_@Y.pdf`\ntext"))
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), metadata.header_metadata(md, stem).alias("m"))
    return made.select("id", "m.*")


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Official ' || p_name WHEN 1 THEN 'NCT' || p_partkey ELSE 'file' || p_partkey END AS title, CASE p_size % 3 WHEN 0 THEN 2000 + p_size WHEN 1 THEN 2001 END AS year FROM part""")
def trial_metadata(spark, sf_dir):
    kind = F.col("p_size") % 3
    full = '{"protocolSection":{"identificationModule":{"officialTitle":"Official @N","nctId":"NCT@K"},"statusModule":{"studyFirstPostDateStruct":{"date":"May 2018"},"lastUpdatePostDateStruct":{"date":"@Y-02-01"}}}}'
    bare = '{"protocolSection":{"identificationModule":{"officialTitle":"","nctId":"NCT@K"},"statusModule":{"completionDateStruct":{"date":" 2001 @Y"}}}}'
    study = F.when(kind == 0, _filled(full)).when(kind == 1, _filled(bare)).otherwise("{}")
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), metadata.trial_metadata(study, _filled("file@K")).alias("m"))
    return made.select("id", "m.*")


@query("""SELECT p_partkey AS record_index, CASE WHEN complete THEN p_partkey || '.json' ELSE 'record_' || p_partkey || '.json' END AS file_name, CASE WHEN complete THEN p_name ELSE '' END AS generic_name, CASE WHEN complete THEN p_brand ELSE '' END AS brand_name,
CASE WHEN complete THEN [p_brand, p_type] ELSE [] END AS brand_names, CASE WHEN complete THEN p_type ELSE '' END AS drug_class, CASE WHEN complete THEN 'A' || p_partkey ELSE '' END AS application_number, CASE WHEN complete THEN CASE WHEN length(w) > 14 THEN rtrim(left(w, 14)) || ' ...[truncated]' ELSE w END ELSE '' END AS warnings,
CASE WHEN complete THEN TRUE END AS reviewed, (CASE WHEN complete THEN p_size ELSE 0 END)::INTEGER AS candidates, 35 AS fields FROM (SELECT *, p_size % 2 = 0 AS complete, 'aaaa ' || p_name || ' bb' AS w FROM part)""")
def seed_summaries(spark, sf_dir):
    full = F.replace(_filled('{"metadata":{"file_name":"@K.json","application_number":" A@K ","metadata_match_candidates":@S,"reviewed":true},"curated_fields":{"generic_name":["","@N"],"brand_names":["@B","@T"],"drug_class":"@T","warnings":"aaaa   @N bb"}}'), F.lit("@S"), F.col("p_size").cast("string"))
    record = F.when(F.col("p_size") % 2 == 0, full).otherwise('{"metadata":null}')
    records = spread(table(spark, sf_dir, "part").select("p_partkey", record.alias("record")))  # made once, before they are read
    made = records.select(metadata.seed_summary(F.col("record"), F.col("p_partkey"), 14).alias("s"))
    fields = len(made.schema["s"].dataType.fieldNames())
    shown = ("record_index", "file_name", "generic_name", "brand_name", "brand_names", "drug_class", "application_number", "warnings", "reviewed")
    return made.select(*[f"s.{n}" for n in shown], F.col("s.metadata_match_candidates").alias("candidates"), F.lit(fields).alias("fields"))


@query("""SELECT p_partkey, 'Generic name: ' || p_name || chr(10) || 'Brand name: ' || p_brand || chr(10) || 'Drug class: ' || p_type || chr(10) || 'FDA BC indication: ' || chr(10) || 'EMA BC indication: ' || chr(10) || 'FDA EMA status: ' || chr(10) || 'Use type: ' || chr(10) || 'BC notes: ' || chr(10)
|| 'Label date: ' || chr(10) || 'Application number: ' || p_partkey || chr(10) || 'Manufacturer name: ' || chr(10) || chr(10) || 'Factoid: size ' || p_size AS shown FROM part""")
def display_texts(spark, sf_dir):
    fields = {"generic_name": F.col("p_name"), "brand_name": F.col("p_brand"), "drug_class": F.col("p_type"), "application_number": F.col("p_partkey").cast("string")}
    return table(spark, sf_dir, "part").select("p_partkey", metadata.display_text(fields, F.concat(F.lit(" size  "), F.col("p_size").cast("string"))).alias("shown"))


@query("SELECT p_type, p_name FROM (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def brand_dedupe(spark, sf_dir):
    return metadata.distinct_names(table(spark, sf_dir, "part"), "p_type", "p_name", "p_partkey", text.name_key(F.col("p_name")))


@query("SELECT old, new, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'labelled' END AS old, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' ELSE 'unclear' END AS new FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY 1, 2")
def reclassification_counts(spark, sf_dir):
    """How many records went from which label to which."""
    met = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").withColumn("hit", F.lit(True)), "doc_id", "left")
    new = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").otherwise("unclear")
    return met.groupBy(F.when(F.col("hit").isNull(), "unlabelled").otherwise("labelled").alias("old"), new.alias("new")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN 0 ELSE n END)::BIGINT AS prompt_tokens, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS completion_tokens, sum(n)::BIGINT AS total_tokens, count(*) AS requests
FROM (SELECT conv_id, role, len(regexp_extract_all(text, '[^ ]+')) AS n FROM conversations) GROUP BY 1""")
def token_usage(spark, sf_dir):
    n = F.regexp_count("text", F.lit("[^ ]+"))
    own = table(spark, sf_dir, "conversations").select("conv_id", (F.col("role") == "assistant").alias("said"), n.alias("n"))
    return own.groupBy("conv_id").agg(F.sum(F.when(F.col("said"), 0).otherwise(F.col("n"))).alias("prompt_tokens"), F.sum(F.when(F.col("said"), F.col("n")).otherwise(0)).alias("completion_tokens"), F.sum("n").alias("total_tokens"), F.count("*").alias("requests"))


@query("""SELECT event_type, n AS done, round(n / seconds, 6) AS per_second, round((total - n) / (n / seconds), 3) AS seconds_left FROM (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS total, epoch(max(max(ts)) OVER ()) - epoch(min(min(ts)) OVER ()) AS seconds FROM events GROUP BY 1)""")
def throughput(spark, sf_dir):
    """Items done per second of the whole run, and the time that the rest would take at that rate."""
    ev = table(spark, sf_dir, "events")
    whole = ev.agg(F.count("*").alias("total"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("seconds"))
    rate = F.col("done") / F.col("seconds")
    out = ev.groupBy("event_type").agg(F.count("*").alias("done")).join(F.broadcast(whole))  # one row
    return out.select("event_type", "done", F.round(rate, 6).alias("per_second"), F.round((F.col("total") - F.col("done")) / rate, 3).alias("seconds_left"))


@query("""WITH f AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents) SELECT source AS file, sum(n)::BIGINT AS factoids, max(n)::BIGINT AS most FROM f JOIN documents USING (doc_id) GROUP BY 1 UNION ALL SELECT 'TOTAL', sum(n)::BIGINT, max(n)::BIGINT FROM f""")
def factoid_counts(spark, sf_dir):
    """Lines per file, and of all."""
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    own = table(spark, sf_dir, "documents").select("source", n.alias("n"))
    sums = [F.sum("n").alias("factoids"), F.max("n").cast("long").alias("most")]
    return own.groupBy(F.col("source").alias("file")).agg(*sums).union(own.agg(*sums).select(F.lit("TOTAL"), "factoids", "most"))


@query("SELECT source, doc_id FROM documents ORDER BY source, doc_id LIMIT 100")
def file_cap(spark, sf_dir):
    """The first files by name."""
    return table(spark, sf_dir, "documents").select("source", "doc_id").orderBy("source", "doc_id").limit(100)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n > 250")
def resume_after(spark, sf_dir):
    """All but the rows that an earlier run has done."""
    return table(spark, sf_dir, "events").select("event_id").orderBy("event_id").offset(250)


@query("""SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:8], lambda x: left(x, 280)) AS sample FROM documents""")
def factoid_sample(spark, sf_dir):
    """The first eight lines of each document, as much of them as a model is shown."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(F.slice(lines, 1, 8), lambda x: F.left(x, F.lit(280))).alias("sample"))


@query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY 1")
def newest_output(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))


@query("""SELECT doc_id, CASE WHEN l.id IS NOT NULL THEN 'labels' WHEN p.id IS NOT NULL THEN 'pages' ELSE 'fallback' END AS found_in FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS id FROM labels) l ON l.id = doc_id LEFT JOIN (SELECT DISTINCT page_id AS id FROM pages) p ON p.id = doc_id""")
def upstream_by_stem(spark, sf_dir):
    """The first folder that has a document's file, by the file's stem."""
    stems = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_factoids")), "_factoids$", "").alias("stem"))
    folder = lambda rank, t, key: table(spark, sf_dir, t).select(F.concat(F.lit("d"), F.col(key).cast("string")).alias("stem"), F.struct(F.lit(rank).alias("rank"), F.lit(t).alias("name")).alias("folder"))
    known = folder(1, "labels", "doc_id").union(folder(2, "pages", "page_id")).groupBy("stem").agg(F.min("folder").alias("folder"))
    return stems.join(known, "stem", "left").select("doc_id", F.coalesce("folder.name", F.lit("fallback")).alias("found_in"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND doc_id <> (SELECT max(doc_id) FROM labels))")
def redo_newest(spark, sf_dir):
    """What isn't finished, and the newest output once more, as it may be cut short."""
    done = table(spark, sf_dir, "labels").select("doc_id")
    newest = done.agg(F.max("doc_id").alias("newest"))
    finished = done.join(F.broadcast(newest), F.col("doc_id") != F.col("newest")).select("doc_id")  # one row
    return audit.missing(table(spark, sf_dir, "documents").select("doc_id"), finished, "doc_id")


WORK = (3, 14, 15, 92, 65, 35, 89, 79, 32, 38)


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (3, 14, 15, 92, 65, 35, 89, 79, 32, 38)")
def work_list(spark, sf_dir):
    """The ten documents of a list that is to be done again."""
    todo = spark.createDataFrame([(k,) for k in WORK], "doc_id long")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(F.broadcast(todo), "doc_id")


@query("SELECT doc_id, l.doc_id IS NOT NULL AND p.page_id IS NOT NULL AS downloaded FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) LEFT JOIN (SELECT DISTINCT page_id FROM pages) p ON p.page_id = documents.doc_id")
def already_downloaded(spark, sf_dir):
    """Whether both files of a record are there."""
    both = table(spark, sf_dir, "labels").select("doc_id").intersect(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))).withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(both, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("downloaded"))


@query("""SELECT b.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN coalesce(text, '') = '' THEN 'empty' ELSE 'no_page_marker' END AS problem FROM (SELECT doc_id FROM labels UNION SELECT 10000000) b LEFT JOIN documents d ON d.doc_id = b.doc_id WHERE d.doc_id IS NULL OR coalesce(text, '') = '' OR NOT contains(text, '. ')""")
def output_validation(spark, sf_dir):
    """Expected outputs that are missing, empty, or without their marker."""
    wanted = table(spark, sf_dir, "labels").select("doc_id").union(spark.createDataFrame([(10_000_000,)], "doc_id long")).distinct()
    got = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("hit"))
    problem = F.when(F.col("hit").isNull(), "missing").when(F.col("text") == "", "empty").when(~F.contains("text", F.lit(". ")), "no_page_marker")
    return wanted.join(got, "doc_id", "left").select("doc_id", problem.alias("problem")).where("problem is not null")


@query("""SELECT o_custkey, CAST(o_custkey AS VARCHAR) || CASE WHEN n > 1 THEN '_' || pos ELSE '' END AS row_id, o_orderkey
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) - 1 AS pos FROM orders)""")
def suffixed_ids(spark, sf_dir):
    """An id that comes again gets its row's place in its file (of a hundred) as suffix."""
    from ..operators.sequence import number_in_group
    from ..sources.tables import suffixed_ids

    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_custkey") % 100).alias("file"), F.col("o_custkey").cast("string").alias("row_id"))
    return suffixed_ids(number_in_group(rows, "file", "o_orderkey", "pos"), "row_id", "pos").select("o_custkey", "row_id", "o_orderkey")


@query("SELECT doc_id, lang, count(*) AS rows FROM (SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'en') GROUP BY 1, 2")
def manifest_append(spark, sf_dir):
    """A manifest to which a second pass has appended: what it saw again stands twice."""
    first = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return first.union(first.where("lang = 'en'")).groupBy("doc_id", "lang").agg(F.count("*").alias("rows"))


@query("SELECT p_type, list_sort(list(DISTINCT p_brand)) AS brands FROM part GROUP BY 1")
def sorted_values(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.sort_array(F.collect_set("p_brand")).alias("brands"))


@query("SELECT p_partkey, 1 AS products, CAST(p_partkey AS VARCHAR) AS product_number, p_brand AS brand_name, p_type AS dosage_form, 'y' AS te_code FROM part")
def product_summaries(spark, sf_dir):
    """Null entries go, and fields that aren't of a product's nine; four of these are shown."""
    made = {"product_number": F.col("p_partkey").cast("string"), "brand_name": F.col("p_brand"), "dosage_form": F.col("p_type")}
    other = [n for n in metadata.PRODUCT_FIELDS if n not in made]
    one = F.struct(F.lit("x").alias("unknown"), *[c.alias(n) for n, c in made.items()], *[F.lit("y").alias(n) for n in other])
    own = table(spark, sf_dir, "part").select("p_partkey", metadata.product_summary(F.array(one, F.when(F.lit(False), one))).alias("p"))
    first = F.element_at("p", 1)
    return own.select("p_partkey", F.size("p").alias("products"), *[first[n].alias(n) for n in ("product_number", "brand_name", "dosage_form", "te_code")])


@query("SELECT lower(trim(p_name)) AS name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def lower_dedupe(spark, sf_dir):
    """The first of names that are the same in lower case."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return dedupe.dedupe_by_key(rows, F.lower(F.trim("p_name")), "p_partkey").select(F.lower(F.trim("p_name")).alias("name"), "p_partkey")


#: A record of each data set (with its summary), and what its columns are: of records, then of contexts.
_RECORDS = (
    ("dhpcs", '{"name_of_medicine":" @N  b ","active_substances":["@T","y"],"dhpc_type":"t@K","category":"","atc_code_human":"L01","referral_name":"","other_related_medicines_nationally_authorised":"o"}', '{"entity_name":"@B &amp; T","referral_name":"ref"}'),
    ("post_authorisation", '{"name_of_medicine":"@N","post_authorisation_opinion_status":"pos","orphan_medicine":"Yes","biosimilar":"No","ema_product_number":@K}', "{}"),
    ("psusas", '{"active_substance":"@T","regulatory_outcome":"kept","category":"Human","related_medicines":"@N"}', '{"category":"from @B"}'),
    ("referrals", '{"referral_name":null,"associated_names_centrally_authorised_medicines":"@N","class":"k","safety_referral":"Yes","reference_number":"EMEA/@K"}', "null"),
    ("shortages", '{"name":"@N","medicine_affected":"@B","supply_shortage_status":"Ongoing","strengths_affected":["5 mg","@K mg"],"availability_of_alternatives":"Yes","reason":"why @T"}', '{"classification":"c"}'),
    ("medicines", '{"name":"","name_of_medicine":"@N","medicine_status":"Authorised","opinion_status":"Positive","last_updated_date":"@Y-01-01"}', '{"name":"Sum @B"}'),
)
_COMMON = ("entity_name", "active_substance", "therapeutic_indication", "therapeutic_area", "status", "holder", "ema_number", "procedure_number", "regulatory_outcome", "classification", "url", "extra_context")
_COMMON_SAID = (
    ("@N b", "@T y", "", "", "t@K", "", "", "", "", "L01", "", "o"), ("@N", "", "", "", "pos", "", "@K", "", "", "", "", "Yes No"), ("@N", "@T", "", "", "kept", "", "", "", "", "Human", "", ""),
    ("@N", "", "", "", "", "", "", "EMEA/@K", "", "k", "", "Yes @N"), ("@N", "", "", "", "", "", "", "", "", "", "", "why @T"), ("@N", "", "", "", "Authorised", "", "", "", "", "", "", ""),
)
_CONTEXT = ("entity_name", "active_substance", "classification", "status", "opinion_status", "ema_number", "procedure_number", "regulatory_outcome", "last_updated_date", "extra_context")
_CONTEXT_SAID = (
    ("@B & T", "@T y", "L01", "t@K", "", "", "", "", "", "ref"), ("@N", "", "", "", "pos", "@K", "", "", "", ""), ("@T", "@T", "from @B", "kept", "", "", "", "kept", "", "@N"),
    ("", "", "", "", "", "", "EMEA/@K", "", "", "@N"), ("@B", "", "c", "Ongoing", "", "", "", "", "", "5 mg @K mg Alternatives available: Yes"), ("Sum @B", "", "", "Authorised", "Positive", "", "", "", "@Y-01-01", ""),
)


def _said(columns: tuple[str, ...], rows: tuple[tuple[str, ...], ...]) -> str:
    """SQL of each part's record, of the data set that its size chooses."""
    own = [f"SELECT p_partkey AS id, '{r[0]}' AS dataset_key, " + ", ".join(f"{_sql(v)} AS {c}" for c, v in zip(columns, row, strict=True)) + f" FROM part WHERE p_size % 6 = {k}" for k, (r, row) in enumerate(zip(_RECORDS, rows, strict=True))]
    return " UNION ALL ".join(own)


def _records(spark, sf_dir, dataset):
    """A record of one data set for each part whose size chooses it."""
    place, (_, record, summary) = next((k, r) for k, r in enumerate(_RECORDS) if r[0] == dataset)
    own = table(spark, sf_dir, "part").where(F.col("p_size") % 6 == place)
    return own.select(F.col("p_partkey").alias("id"), F.parse_json(_filled(record)).alias("r"), F.parse_json(_filled(summary)).alias("s"))


@query(_said(_COMMON, _COMMON_SAID))
def harmonised_records(spark, sf_dir):
    return harmonise.union_of([harmonise.common_record(_records(spark, sf_dir, d), "r", d).drop("r", "s") for d, *_ in _RECORDS])


@query(_said(_CONTEXT, _CONTEXT_SAID))
def context_records(spark, sf_dir):
    """Ten of the columns; the others are filled alike."""
    return harmonise.union_of([harmonise.context_record(_records(spark, sf_dir, d), "s", "r", d).select("id", F.lit(d).alias("dataset_key"), *_CONTEXT) for d, *_ in _RECORDS])


@query("""SELECT p_partkey, 'file_' || p_partkey || CASE WHEN p_size % 2 = 0 THEN i ELSE '' END AS row_id, CASE WHEN p_size % 2 = 0 AND i = '2' THEN p_brand ELSE p_name END AS txt
FROM part, (VALUES ('1'), ('2')) v(i) WHERE p_size % 2 = 0 OR i = '1'""")
def split_blocks(spark, sf_dir):
    """Texts that hold several tagged blocks by mistake become rows, whose ids get the number of the block."""
    tagged = lambda c: F.concat(F.lit("<<<FACTOID>>> "), c, F.lit(" <<<END_FACTOID>>>"))
    whole = F.when(F.col("p_size") % 2 == 0, F.concat(tagged(F.col("p_name")), F.lit("\n"), tagged(F.col("p_brand")))).otherwise(F.col("p_name"))
    own = table(spark, sf_dir, "part").select("p_partkey", text.split_blocks(whole).alias("parts"))
    number = F.when(F.size("parts") > 1, (F.col("pos") + 1).cast("string")).otherwise("")
    return own.select("p_partkey", "parts", F.posexplode("parts").alias("pos", "txt")).select("p_partkey", F.concat(F.lit("file_"), F.col("p_partkey").cast("string"), number).alias("row_id"), "txt")
