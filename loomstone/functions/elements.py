"""XML documents as tables of elements, so that every extraction is a query.

``elements`` parses each document once, in Arrow batches, to a row per element in document order; what is
read from an article (fields, ids, paragraphs with their sections, tables) are filters, joins and
aggregates over these rows. A document that can't be parsed has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import bucketed
from .text import truncated

ELEMENT = "at int, parent int, name string, path string, above array<int>, attributes map<string,string>, text string, tight string"


@lru_cache(4096)
def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1].lower()


class _Rows:
    """Columns of elements, filled document by document in document order."""

    def __init__(self) -> None:
        self.document, self.at, self.parent, self.name, self.path, self.text, self.tight = ([] for _ in range(7))
        self.above, self.above_ends, self.names, self.values, self.attribute_ends, self.size = [], [0], [], [], [0], 0

    def add(self, document: int, root: ElementTree.Element) -> None:
        base = len(self.at)
        pieces, words, begun = [], [], []  # texts, their words, and where each element's begin
        waiting: list[tuple] = [(root, -1, "", ())]
        while waiting:
            node, parent, path, above = waiting.pop()
            if parent == -2:  # an element ends (path: its number), its tail follows
                self._texts(base + path, pieces, words, *begun[path])
            else:
                if isinstance(node.tag, str):  # no comment or instruction
                    at, name = len(self.at) - base, _local(node.tag)
                    path = f"{path}/{name}"
                    self.document.append(document)
                    self.at.append(at)
                    self.parent.append(parent)
                    self.name.append(name)
                    self.path.append(path)
                    self.text.append("")
                    self.tight.append("")
                    self.above += above
                    self.above_ends.append(len(self.above))
                    if node.attrib:
                        attributes = {_local(k): v for k, v in node.attrib.items()}
                        self.names += attributes.keys()
                        self.values += attributes.values()
                    self.attribute_ends.append(len(self.names))
                    begun.append((len(pieces), len(words)))
                    if node.text:
                        pieces.append(node.text)
                        words += node.text.split()
                    waiting.append((node, -2, at, above))
                    if len(node):
                        inside = (*above, at)
                        waiting += [(child, at, path, inside) for child in reversed(node)]
                    continue
            if node.tail and node is not root:
                pieces.append(node.tail)
                words += node.tail.split()

    def _texts(self, place: int, pieces: list[str], words: list[str], piece: int, word: int) -> None:
        text = " ".join(words[word:])
        self.text[place] = text
        self.tight[place] = text if len(pieces) - piece < 2 else " ".join("".join(pieces[piece:]).split())
        self.size += 2 * len(text) + 100

    def batch(self, keys: pa.Array, key: str) -> pa.RecordBatch:
        ints, strings = (lambda v: pa.array(v, pa.int32())), (lambda v: pa.array(v, pa.string()))
        above = pa.ListArray.from_arrays(ints(self.above_ends), ints(self.above))
        attributes = pa.MapArray.from_arrays(ints(self.attribute_ends), strings(self.names), strings(self.values))
        columns = [keys.take(ints(self.document)), ints(self.at), ints(self.parent), strings(self.name), strings(self.path), above, attributes, strings(self.text), strings(self.tight)]
        return pa.RecordBatch.from_arrays(columns, [key, "at", "parent", "name", "path", "above", "attributes", "text", "tight"])


#: Characters of elements after which a batch of them is given on.
BATCH_CHARS = 4_000_000


def elements(df: DataFrame, key: str, xml: str) -> DataFrame:
    """key and ELEMENT for each element of each document; names are local, in lower case, texts collapsed.

    ``text`` has a blank between the texts of inner elements, ``tight`` has none but theirs. Each use of the
    result parses again; ``parsed`` keeps it.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows()
            for k, text in enumerate(batch.column(1).to_pylist()):
                try:
                    if text:
                        rows.add(k, ElementTree.fromstring(text))
                except ElementTree.ParseError:
                    continue
                if rows.size > BATCH_CHARS:
                    yield rows.batch(batch.column(0), key)
                    rows = _Rows()
            if rows.at:
                yield rows.batch(batch.column(0), key)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, xml).mapInArrow(parse, f"{key} {kind}, {ELEMENT}")


def parsed(df: DataFrame, key: str, xml: str | Column) -> DataFrame:
    """The elements as a table bucketed by key, parsed once, however often they are read.

    Rows are dealt out to buckets before their document (a column, or made of columns) is made and parsed,
    so all tasks do so and each writes its own bucket; what groups by key, or joins on it, then moves no rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = df.repartition(n, key).select(key, (F.col(xml) if isinstance(xml, str) else xml).alias("_xml"))
    return bucketed(elements(made, key, "_xml"), n, key, "at", tag="elements")


def in_order(value: Column, at: Column, joint: str) -> Column:
    """The values of a group, in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), value.alias("v")))), lambda x: x["v"]), joint)


def _some(rows: DataFrame) -> DataFrame:
    return rows.where("text <> ''")


def first_text(rows: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """key and, for each field, the text of the first element with any text that fits its condition."""
    return _some(rows).groupBy(key).agg(*[F.min_by(F.when(fits, F.col("text")), F.when(fits, F.col("at"))).alias(name) for name, fits in fields.items()])


def _of_child(fits: Column, value: Column | str) -> Column:
    """A child's value where its parent's row is made (see ``gathered``)."""
    return F.when(~F.col("own") & fits, F.col(value) if isinstance(value, str) else value)


def _child_text(name: str, fits: Column | None = None) -> Column:
    """The text of the first child of that name with any text."""
    fits = (F.col("name") == name) & (F.col("text") != "") & (F.lit(True) if fits is None else fits)
    return F.min_by(_of_child(fits, "text"), _of_child(fits, "at"))


def _child_texts(fits: Column, joint: str, value: Column | str = "text") -> Column:
    """The values of the children that fit, in order, as one text; null without any."""
    value = F.col(value) if isinstance(value, str) else value
    found = F.collect_list(_of_child(fits, F.struct("at", value.alias("v"))))  # one parent's
    return F.nullif(F.array_join(F.transform(F.array_sort(found), lambda x: x["v"]), joint), F.lit(""))


def gathered(rows: DataFrame, key: str, own: Column, fields: dict[str, Column], child: Column, children: dict[str, Column]) -> DataFrame:
    """key, e: an array of the document's elements in order, with ``fields`` of those that fit ``own`` (null for
    others) and ``children``, aggregates over the children that fit ``child``, of each parent.

    One read of the elements and two groupings that move no rows of a table bucketed by key; each element
    counts once for itself and once for its parent, so the work grows with the document, not its square.
    A document without such elements has its root alone.
    """
    at = lambda place, mine: F.struct(F.col(place).alias("node"), F.lit(mine).alias("own"))
    sides = F.array_compact(F.array(F.when(own | (F.col("at") == 0), at("at", True)), F.when(child, at("parent", False))))
    split = rows.select("*", F.explode(sides).alias("side")).select("*", "side.*")
    mine = F.first(F.when(F.col("own"), F.struct(*[c.alias(n) for n, c in fields.items()])), ignorenulls=True)
    nodes = split.groupBy(key, "node").agg(mine.alias("mine"), *[c.alias(n) for n, c in children.items()])
    return nodes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), *[F.col(f"mine.{n}") for n in fields], *children))).alias("e"))  # one document's


def _first_of(fits, value: str = "text") -> Column:
    """A value of the first gathered element that fits."""
    return F.get(F.filter("e", fits), F.lit(0))[value]


def _text_of(name: str, **more: str):
    """Whether a gathered element has that name, and these fields, and any text."""

    def fits(x: Column) -> Column:
        out = (x["name"] == name) & (x["text"] != "")
        for field, value in more.items():
            out &= x[field] == value
        return out

    return fits


# The fields of a publisher's license, the elements and the attributes that fill them.
LICENSE_ELEMENTS = {
    "openaccessarticle": "openaccessArticle",
    "openaccess": "openaccess",
    "openaccesstype": "openaccessType",
    "openaccessuserlicense": "openaccessUserLicense",
    "oa-user-license": "oa-user-license",
    "sa-user-license": "sa-user-license",
    "openarchivearticle": "openArchiveArticle",
    "license": "license_text",
    "license-text": "license_text",
    "copyright": "copyright",
    "copyright-statement": "copyright_statement",
    "copyright-holder": "copyright_holder",
    "self-archiving": "self_archiving",
    "selfarchiving": "self_archiving",
    "sponsortype": "sponsor_type",
    "sponsor-type": "sponsor_type",
}
LICENSE_ATTRIBUTES = {
    "openaccessarticle": "openaccessArticle",
    "openaccess": "openaccessArticle",
    "openaccesstype": "openaccessType",
    "openaccessuserlicense": "openaccessUserLicense",
    "oa-user-license": "oa-user-license",
    "sa-user-license": "sa-user-license",
    "openarchivearticle": "openArchiveArticle",
}
LICENSE_LINKS = ("href", "license_ref", "license-ref")
LICENSE_SITES = ("creativecommons.org/", "elsevier.com/open-access/userlicense")


def _field(names: dict[str, str], name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), name)


def license_fields(rows: DataFrame, key: str) -> DataFrame:
    """key, field, values: the sorted different texts of each license field that a document has."""
    own = rows.select(key, _field(LICENSE_ELEMENTS, F.col("name")).alias("field"), F.col("text").alias("value"))
    spread = rows.select(key, "name", F.explode("attributes").alias("attribute", "raw")).withColumn("value", F.trim(F.regexp_replace("raw", r"\s+", " ")))
    link = F.col("attribute").isin(*LICENSE_LINKS) & F.rlike(F.lower("value"), F.lit("|".join(s.replace(".", r"\.") for s in LICENSE_SITES)))
    of_license = (F.col("name") == "license") & (F.col("attribute") == "href")
    field = F.coalesce(_field(LICENSE_ATTRIBUTES, F.col("attribute")), F.when(link | of_license, F.lit("license_text")))
    every = own.union(spread.select(key, field.alias("field"), "value")).where("field is not null and value <> ''")
    return every.groupBy(key, "field").agg(F.sort_array(F.collect_set("value")).alias("values"))


def article_ids(rows: DataFrame, key: str) -> DataFrame:
    """key, doi (of an element, else of an attribute) and title: the first of each."""
    found = first_text(rows, key, {"doi": F.col("name") == "doi", "title": F.col("name").isin("title", "article-title")})
    own = F.trim(F.try_element_at("attributes", F.lit("doi")))
    attribute = rows.groupBy(key).agg(F.min_by(F.nullif(own, F.lit("")), F.when(own != "", F.col("at"))).alias("_doi"))
    return attribute.join(found, key, "left").select(key, F.coalesce("doi", "_doi", F.lit("")).alias("doi"), F.coalesce("title", F.lit("")).alias("title"))


def title_and_abstract(rows: DataFrame, key: str) -> DataFrame:
    """key, title, abstract of a publisher's record: core data first, then any title or description, then the paragraphs of the first abstract, then all of it."""
    rows = rows.withColumn("text", F.col("tight"))
    core = F.rlike("path", F.lit(r"^/[^/]+/coredata/[^/]+$"))
    name = F.col("name")
    found = first_text(rows, key, {"t0": core & (name == "title"), "t1": name == "title", "a0": core & (name == "description"), "a1": name == "description", "a3": name == "abstract"})
    first = rows.where("name = 'abstract'").groupBy(key).agg(F.min("at").alias("_abstract"))
    paras = _some(rows.where(name.isin("simple-para", "para", "p"))).join(first, key).where(F.array_contains("above", F.col("_abstract"))).groupBy(key).agg(in_order(F.col("text"), F.col("at"), " ").alias("a2"))
    met = rows.select(key).distinct().join(found, key, "left").join(paras, key, "left")
    return met.select(key, F.coalesce("t0", "t1", F.lit("")).alias("title"), F.coalesce("a0", "a1", "a2", "a3", F.lit("")).alias("abstract"))


def _first_child(rows: DataFrame, key: str, name: str, to: str) -> DataFrame:
    """key, parent, ``to``: the text of the first child of that name with any text."""
    return _some(rows.where(F.col("name") == name)).groupBy(key, "parent").agg(F.min_by("text", "at").alias(to))


def body_text(rows: DataFrame, key: str) -> DataFrame:
    """key, body: titles and paragraphs of the sections of an article's body, however deep, a title before its section."""
    inside = F.rlike("path", F.lit(r"/article/body/(?:sections/)?section(?:/section)*/(?:para|section-title)$"))
    own = _some(rows.where(inside))
    titles = own.where("name = 'section-title'").groupBy(key, F.col("parent").alias("at")).agg(F.min_by("text", "at").alias("text"))
    return own.where("name = 'para'").select(key, "at", "text").union(titles.select(key, "at", "text")).groupBy(key).agg(in_order(F.col("text"), F.col("at"), "\n\n").alias("body"))


def abstract_text(rows: DataFrame, key: str) -> DataFrame:
    """key, abstract: blocks of an article head's abstracts, a section's title and paragraphs as lines of one block;
    without any, the description in the core data."""
    at_top = F.rlike("path", F.lit(r"/article/head/abstract/(?:simple-para|para)$"))
    in_section = F.rlike("path", F.lit(r"/article/head/abstract/abstract-sec/(?:simple-para|para|section-title)$"))
    own = _some(rows.where(at_top | in_section)).withColumn("block", F.when(in_section, F.col("parent")).otherwise(F.col("at")))
    title = (F.col("name") == "section-title").cast("int")
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy(key, "block", "name").orderBy("at"))).where("name <> 'section-title' or nth = 1")
    blocks = own.groupBy(key, "block").agg(in_order(F.col("text"), F.struct((-title).alias("t"), "at"), "\n").alias("text"))
    made = blocks.groupBy(key).agg(in_order(F.col("text"), F.col("block"), "\n\n").alias("made"))
    core = first_text(rows, key, {"core": F.rlike("path", F.lit(r"^/[^/]+/coredata/description$"))})
    return made.join(core, key, "full_outer").select(key, F.coalesce("made", "core").alias("abstract")).where("abstract is not null")


def table_texts(rows: DataFrame, key: str) -> DataFrame:
    """key, table (its place), text: label and caption, all rows of cells, legend, footnotes."""
    tables = rows.where("name = 'table'").select(key, F.col("at").alias("table"))
    child = lambda name, to: _first_child(rows, key, name, to).withColumnRenamed("parent", "table")
    cells = rows.where("name = 'entry'").select(key, F.col("parent").alias("row"), "at", F.when(F.col("text") == "", " ").otherwise(F.col("text")).alias("cell"), (F.col("text") != "").alias("full"))
    lines = cells.groupBy(key, "row").agg(in_order(F.col("cell"), F.col("at"), " | ").alias("line"), F.max("full").alias("full")).where("full")
    of_table = rows.where("name = 'row'").select(key, F.col("at").alias("row"), F.explode("above").alias("table")).join(tables, [key, "table"]).join(lines, [key, "row"])
    grid = of_table.groupBy(key, "table").agg(in_order(F.col("line"), F.col("row"), "\n").alias("grid"))
    notes = _some(rows.where("name = 'table-footnote'")).groupBy(key, F.col("parent").alias("table")).agg(in_order(F.col("text"), F.col("at"), "\n").alias("notes"))
    met = tables
    for part in (child("label", "label"), child("caption", "caption"), child("legend", "legend"), grid, notes):
        met = met.join(part, [key, "table"], "left")
    head = F.concat_ws(": ", "label", "caption")
    text = F.concat_ws("\n\n", F.nullif(head, F.lit("")), "grid", F.concat(F.lit("Legend: "), "legend"), F.concat(F.lit("Footnotes:\n"), "notes"))
    return met.select(key, "table", text.alias("text")).where("text <> ''")


def panel_texts(rows: DataFrame, key: str) -> DataFrame:
    """key, panel (its place), text of each text box: label and caption, and the lines of its paragraphs."""
    panels = rows.where("name = 'textbox'").select(key, F.col("at").alias("panel"))
    child = lambda name: _first_child(rows, key, name, name).withColumnRenamed("parent", "panel")
    inside = _some(rows.where("name = 'para'")).select(key, "at", "text", F.explode("above").alias("panel")).join(panels, [key, "panel"])
    paras = inside.groupBy(key, "panel").agg(in_order(F.col("text"), F.col("at"), "\n").alias("paras"))
    met = panels
    for part in (child("label"), child("caption"), paras):
        met = met.join(part, [key, "panel"], "left")
    text = F.concat_ws("\n\n", F.nullif(F.concat_ws(": ", "label", "caption"), F.lit("")), "paras")
    return met.select(key, "panel", text.alias("text")).where("text <> ''")


def fallback_text(rows: DataFrame, key: str, names: tuple[str, ...] = ("title", "abstract", "section-title", "para", "simple-para")) -> DataFrame:
    """key, text: texts of elements of these names, name by name, the first of equal ones (by case-folded text)."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    own = _some(rows.where(F.col("name").isin(*names))).select(key, F.struct(rank.alias("rank"), "at").alias("place"), "text", F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")).alias("folded"))
    first = own.groupBy(key, "folded").agg(F.min("place").alias("place"), F.min_by("text", "place").alias("text"))
    return first.groupBy(key).agg(in_order(F.col("text"), F.col("place"), "\n\n").alias("text"))


def full_text(title: Column, journal: Column, doi: Column, abstract: Column, body: Column, tables: Column, panels: Column) -> Column:
    """The parts of an article under their headings; empty ones are left out."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    part = lambda head, c, joint: F.when(~empty(c), F.concat(F.lit(head + joint), c))
    top = F.concat_ws("\n", F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), part("Journal:", journal, " "), part("DOI:", doi, " "))
    return F.trim(F.concat_ws("\n\n", top, part("ABSTRACT", abstract, "\n"), part("BODY", body, "\n"), part("TABLES", tables, "\n"), part("PANELS", panels, "\n")))


def publisher_full_text(rows: DataFrame, key: str) -> DataFrame:
    """key, full_text of a publisher's article: what ``article_ids``, ``abstract_text``, ``body_text``, ``table_texts``
    and ``panel_texts`` give, from one read of the elements."""
    name, some = F.col("name"), F.col("text") != ""
    path = lambda pattern: F.rlike("path", F.lit(pattern))
    at_top = name.isin("simple-para", "para") & some & path(r"/article/head/abstract/(?:simple-para|para)$")
    in_section = name.isin("simple-para", "para", "section-title") & some & path(r"/article/head/abstract/abstract-sec/(?:simple-para|para|section-title)$")
    in_body = name.isin("para", "section-title") & some & path(r"/article/body/(?:sections/)?section(?:/section)*/(?:para|section-title)$")
    core = (name == "description") & some & path(r"^/[^/]+/coredata/description$")
    marked = rows.select(key, "at", "parent", "name", "above", "text", F.nullif(F.trim(F.try_element_at("attributes", F.lit("doi"))), F.lit("")).alias("doi"), at_top.alias("at_top"), in_section.alias("in_section"), in_body.alias("in_body"), core.alias("core"))
    is_title = name == "section-title"
    wanted = name.isin("doi", "title", "article-title", "table", "row", "textbox", "para") | F.col("doi").isNotNull() | F.col("at_top") | F.col("core")
    fields = {n: F.col(n) for n in ("name", "text", "doi", "core")} | {
        "above": F.when(name.isin("row", "para"), F.col("above")),
        "top": F.when(F.col("at_top"), F.col("text")),
        "para": F.when(F.col("in_body") & ~is_title, F.col("text")),
    }
    children = {n: _child_text(n) for n in ("label", "caption", "legend")} | {
        "notes": _child_texts((name == "table-footnote") & some, "\n"),
        "line": _child_texts(name == "entry", " | ", F.when(some, F.col("text")).otherwise(" ")),
        "full": F.max(_of_child(name == "entry", some)),
        "block_title": _child_text("section-title", F.col("in_section")),
        "block": _child_texts(F.col("in_section") & ~is_title, "\n"),
        "title": _child_text("section-title", F.col("in_body")),
    }
    e = gathered(marked, key, wanted, fields, name.isin("label", "caption", "legend", "table-footnote", "entry", "section-title") | F.col("in_section"), children)
    pick = lambda fits, made: F.transform(F.filter("e", fits), made)
    by_place = lambda made: F.array_join(F.filter(F.transform("e", made), lambda x: x.isNotNull()), "\n\n")
    lines = pick(lambda x: (x["name"] == "row") & x["full"], lambda x: F.struct(x["above"].alias("above"), x["line"].alias("text")))
    paras = pick(_text_of("para"), lambda x: F.struct(x["above"].alias("above"), x["text"].alias("text")))
    parts = e.select(
        key, F.coalesce(_first_of(_text_of("doi")), _first_of(lambda x: x["doi"].isNotNull(), "doi"), F.lit("")).alias("doi"),
        F.coalesce(_first_of(lambda x: x["name"].isin("title", "article-title") & (x["text"] != "")), F.lit("")).alias("title"),
        F.coalesce(F.nullif(by_place(lambda x: F.coalesce(F.nullif(F.concat_ws("\n", x["block_title"], x["block"]), F.lit("")), x["top"])), F.lit("")), _first_of(lambda x: x["core"])).alias("abstract"),
        by_place(lambda x: F.coalesce(x["title"], x["para"])).alias("body"), lines.alias("lines"), paras.alias("paras"),
        F.filter("e", lambda x: x["name"] == "table").alias("tables"), F.filter("e", lambda x: x["name"] == "textbox").alias("panels"),
    )
    inside = lambda of, x: F.transform(F.filter(of, lambda y: F.array_contains(y["above"], x["at"])), lambda y: y["text"])
    head = lambda x: F.nullif(F.concat_ws(": ", x["label"], x["caption"]), F.lit(""))
    joined = lambda *some: F.array_join(F.filter(F.array(*some), lambda x: x != ""), "\n\n")
    table = lambda x: joined(head(x), F.array_join(inside("lines", x), "\n"), F.concat(F.lit("Legend: "), x["legend"]), F.concat(F.lit("Footnotes:\n"), x["notes"]))
    panel = lambda x: F.concat_ws("\n\n", head(x), F.nullif(F.array_join(inside("paras", x), "\n"), F.lit("")))
    listed = lambda of, made: F.array_join(F.filter(F.transform(of, made), lambda x: x != ""), "\n\n")
    return parts.select(key, full_text(F.col("title"), F.lit(None).cast("string"), F.col("doi"), F.col("abstract"), F.col("body"), listed("tables", table), listed("panels", panel)).alias("full_text"))


#: Parts of an article's body that don't count as its text.
NO_TEXT = ("fig", "table-wrap", "ref-list", "alternatives", "supplementary-material")


def journal_text(rows: DataFrame, key: str) -> DataFrame:
    """key, text of a journal article: title, abstracts, and for every section its title and all paragraphs within it (so
    those of nested sections come again); a body without sections gives its paragraphs."""
    clean = _some(rows.where(~F.rlike("path", F.lit("/body/(?:.*/)?(?:" + "|".join(NO_TEXT) + ")(?:/|$)"))))
    body = clean.where(F.rlike("path", F.lit("/body/")))
    sections = body.where("name = 'sec'").select(key, F.col("at").alias("sec"))
    inside = body.where("name in ('p', 'title')").select(key, "at", "name", "text", F.explode("above").alias("sec")).join(sections, [key, "sec"])
    inside = inside.withColumn("nth", F.row_number().over(Window.partitionBy(key, "sec", "name").orderBy("at"))).where("name = 'p' or nth = 1")
    order = F.struct("sec", (F.col("name") == "p").alias("p"), "at")
    with_sections = inside.groupBy(key).agg(in_order(F.col("text"), order, "\n\n").alias("sectioned"))
    plain = body.where("name = 'p'").groupBy(key).agg(in_order(F.col("text"), F.col("at"), "\n\n").alias("plain"))
    title = first_text(rows, key, {"title": F.col("name") == "article-title"})
    abstract = _some(rows.where("name = 'abstract'")).groupBy(key).agg(in_order(F.col("text"), F.col("at"), "\n\n").alias("abstract"))
    met = rows.select(key).distinct()
    for part in (title, abstract, with_sections, plain):
        met = met.join(part, key, "left")
    text = F.concat_ws("\n\n", "title", F.concat(F.lit("ABSTRACT\n"), "abstract"), F.concat(F.lit("MAIN TEXT\n"), F.coalesce("sectioned", "plain")))
    return met.select(key, text.alias("text"))


def section_paragraphs(rows: DataFrame, key: str) -> DataFrame:
    """key, at, text of each paragraph; the nearest section's title stands before it where it differs from that of the
    last paragraph that has one."""
    sections = rows.where("name = 'sec'").select(key, F.col("at").alias("sec"))
    titles = rows.where("name = 'title'").select(key, "at", "text", F.explode("above").alias("sec")).join(sections, [key, "sec"]).groupBy(key, "sec").agg(F.min_by("text", "at").alias("title"))
    paras = _some(rows.where("name = 'p'"))
    near = paras.select(key, "at", F.explode("above").alias("sec")).join(sections, [key, "sec"]).groupBy(key, "at").agg(F.max("sec").alias("sec"))
    met = paras.select(key, "at", "text").join(near, [key, "at"], "left").join(titles, [key, "sec"], "left").withColumn("title", F.nullif("title", F.lit("")))
    last = F.last("title", ignorenulls=True).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    told = F.col("title").isNotNull() & ~F.col("title").eqNullSafe(last)
    return met.select(key, "at", F.when(told, F.concat("title", F.lit(" "), "text")).otherwise(F.col("text")).alias("text"))


def classifier_signals(rows: DataFrame, key: str, *, keywords: int = 12, abstract_chars: int = 4000, methods_chars: int = 1500) -> DataFrame:
    """key, article_type, title, journal, categories, keywords, abstract, methods of a journal article."""
    one = first_text(rows, key, {"title": F.col("name") == "article-title", "journal": F.col("name") == "journal-title", "short": F.col("name") == "abbrev-journal-title"})
    kind = rows.where("name = 'article'").groupBy(key).agg(F.trim(F.min_by(F.try_element_at("attributes", F.lit("article-type")), "at")).alias("article_type"))
    listed = lambda fits, to: _some(rows.where(fits)).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias(to))
    abstracts = rows.where("name = 'abstract'").where(~F.try_element_at("attributes", F.lit("abstract-type")).eqNullSafe("graphical")).select(key, F.col("at").alias("block"))
    parts = _some(rows.where("name in ('title', 'p')")).select(key, "at", F.when(F.col("name") == "title", F.upper("text")).otherwise(F.col("text")).alias("text"), F.explode("above").alias("block")).join(abstracts, [key, "block"])
    blocks = parts.groupBy(key, "block").agg(in_order(F.col("text"), F.col("at"), " ").alias("text")).groupBy(key).agg(truncated(in_order(F.col("text"), F.col("block"), " | "), abstract_chars, "...").alias("abstract"))
    heads = rows.where("name = 'title'").groupBy(key, F.col("parent").alias("at")).agg(F.min_by("text", "at").alias("head"))
    is_method = F.contains(F.lower(F.coalesce(F.try_element_at("attributes", F.lit("sec-type")), F.lit(""))), F.lit("method")) | F.contains(F.lower(F.coalesce("head", F.lit(""))), F.lit("method"))
    methods = rows.where("name = 'sec'").join(heads, [key, "at"], "left").where(is_method).groupBy(key).agg(truncated(F.min_by("text", "at"), methods_chars, "...").alias("methods"))
    met = rows.select(key).distinct()
    for part in (one, kind, listed(F.rlike("path", F.lit("/subj-group/(?:.*/)?subject$")), "categories"), listed(F.col("name") == "kwd", "keywords"), blocks, methods):
        met = met.join(part, key, "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    several = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return met.select(key, text("article_type").alias("article_type"), text("title").alias("title"), text(F.coalesce("journal", "short")).alias("journal"), several("categories").alias("categories"), F.slice(several("keywords"), 1, keywords).alias("keywords"), text("abstract").alias("abstract"), text("methods").alias("methods"))


# Fields of a publisher's article and the children of its core data that fill them; those of any element.
CORE_FIELDS = {
    "doi": "doi", "pii": "pii", "eid": "eid", "journal": "publicationname", "issn": "issn", "volume": "volume", "starting_page": "startingpage", "ending_page": "endingpage", "page_range": "pagerange",
    "cover_date": "coverdate", "cover_display_date": "coverdisplaydate", "publisher": "publisher", "copyright": "copyright", "openaccess": "openaccess", "openaccess_article": "openaccessarticle", "abstract_from_coredata": "description",
}
TREE_FIELDS = {"scopus_id": "scopus-id", "pubmed_id": "pubmed-id"}


def article_year(c: Column) -> Column:
    """The first word of four digits that is a year of the last century or this one."""
    return F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def _place() -> Column:
    """Where an element lies in a publisher's article: in its core data, in the head; or an author of the head."""
    of = lambda under: F.endswith("path", F.concat(F.lit(under), "name"))
    author = (F.col("name") == "author") & F.endswith("path", F.lit("/article/head/author-group/author"))
    return F.when(author, "author").when(of("/coredata/"), "core").when(of("/article/head/"), "head")


def publisher_metadata(rows: DataFrame, key: str, file_name: Column) -> DataFrame:
    """key and the 27 fields of a publisher's article; what it doesn't say is null, and its title then is the file's stem.

    Authors are the creators of the core data, else given and surname of the head's author group, in order.
    """
    name = F.col("name")
    core = lambda n: _first_of(_text_of(n, place="core"))
    any_of = lambda n: _first_of(_text_of(n))
    fields = {to: core(n) for to, n in CORE_FIELDS.items()} | {to: any_of(n) for to, n in TREE_FIELDS.items()}
    fields |= {"_t0": core("title"), "_t1": _first_of(_text_of("title", place="head")), "_i0": core("issueidentifier"), "_i1": core("number"), "_start": any_of("cover-date-start")}
    fields |= {"_d0": any_of("document-type"), "_d1": core("aggregationtype"), "_s0": any_of("document-subtype"), "_s1": core("pubtype")}
    creators = F.transform(F.filter("e", _text_of("creator", place="core")), lambda x: x["text"])
    people = F.filter(F.transform(F.filter("e", lambda x: x["place"] == "author"), lambda x: F.concat_ws(" ", x["given_name"], x["surname"])), lambda n: n != "")
    fields |= {"authors": F.when(F.size(creators) > 0, creators).otherwise(people)}
    marked = rows.select(key, "at", "parent", "name", "text", _place().alias("place"))
    loose = name.isin(*TREE_FIELDS.values(), "cover-date-start", "document-type", "document-subtype")
    e = gathered(marked, key, F.coalesce(F.col("place").isin("core", "author"), F.lit(False)) | loose | (name == "title"), {n: F.col(n) for n in ("name", "text", "place")}, name.isin("given-name", "surname"), {"given_name": _child_text("given-name"), "surname": _child_text("surname")})
    met = e.select(key, *[c.alias(n) for n, c in fields.items()])
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")
    made = {
        "source_family": F.lit("Elsevier"), "source_format": F.lit("XML"), "file_name": file_name, "document_title": F.coalesce("_t0", "_t1", stem), "document_type": F.coalesce("_d0", "_d1", F.lit("article")), "document_subtype": F.coalesce("_s0", "_s1"),
        "document_year": F.coalesce(*[article_year(F.col(c)) for c in ("cover_date", "cover_display_date", "_start")]), "issue": F.coalesce("_i0", "_i1"), "authors": F.coalesce("authors", F.array().cast("array<string>")),
    }
    return met.select(key, *[c.alias(n) for n, c in made.items()], *[F.col(n) for n in [*CORE_FIELDS, *TREE_FIELDS]])


def publisher_signals(rows: DataFrame, key: str, *, abstract_chars: int = 4000, methods_chars: int = 1500) -> DataFrame:
    """key, title, journal, article_type, document_subtype, abstract, methods of a publisher's article."""
    name = F.col("name")
    core = lambda n: _first_of(_text_of(n, place="core"))
    section = (name == "section") & F.rlike("path", F.lit(r"/article/body/(?:.*/)?section$"))
    parts = ("section-title", "simple-para", "para")
    marked = rows.select(key, "at", "parent", "name", "text", "above", _place().alias("place"), section.alias("section"))
    wanted = F.coalesce(F.col("place") == "core", F.lit(False)) | F.col("section") | name.isin("title", "abstract", "document-type", "document-subtype", *parts)
    fields = {n: F.col(n) for n in ("name", "text", "place", "section")} | {"above": F.when(name.isin(*parts), F.col("above"))}
    e = gathered(marked, key, wanted, fields, name == "section-title", {"heading": F.lower(_child_text("section-title"))})
    blocks = F.transform(F.filter("e", lambda x: (x["name"] == "abstract") & (x["place"] == "head")), lambda x: x["at"])
    inside = F.filter("e", lambda x: x["name"].isin(*parts) & (x["text"] != ""))
    told = lambda x: x["section"] & (F.contains(x["heading"], F.lit("method")) | F.contains(x["heading"], F.lit("material")))
    met = e.select(
        key, *[core(n).alias(to) for to, n in {"_t0": "title", "journal": "publicationname", "_k0": "pubtype", "_k1": "aggregationtype", "_core": "description"}.items()], _first_of(_text_of("title", place="head")).alias("_t1"),
        _first_of(_text_of("document-type")).alias("_k2"), _first_of(_text_of("document-subtype")).alias("_s"), _first_of(told).alias("methods"), blocks.alias("blocks"), inside.alias("inside"),
    )
    own = F.transform("blocks", lambda b: F.array_join(F.transform(F.filter("inside", lambda x: F.array_contains(x["above"], b)), lambda x: x["text"]), " "))
    met = met.withColumn("_head", F.nullif(F.array_join(F.filter(own, lambda x: x != ""), " | "), F.lit("")))
    text = lambda *c: F.coalesce(*c, F.lit(""))
    abstract = F.concat_ws(" | ", "_core", "_head")
    return met.select(
        key, text("_t0", "_t1").alias("title"), text("journal").alias("journal"), text("_k0", "_k1", "_k2").alias("article_type"), text("_s").alias("document_subtype"),
        truncated(abstract, abstract_chars, "...").alias("abstract"), truncated(text("methods"), methods_chars, "...").alias("methods"),
    )
