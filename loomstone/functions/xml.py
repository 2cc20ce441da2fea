"""Fields and full text of XML articles, by XPath on local names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _named(name: str) -> str:
    return f"*[local-name()='{name}']"


def text_of(xml: Column, *path: str) -> Column:
    """The trimmed string of the first element under nested local names; null if empty."""
    return F.nullif(F.trim(F.xpath_string(xml, F.lit("(//" + "//".join(map(_named, path)) + ")[1]"))), F.lit(""))


def texts_of(xml: Column, *path: str) -> Column:
    return F.xpath(xml, F.lit("//" + "//".join(map(_named, path)) + "//text()"))


def attribute_of(xml: Column, element: str, attribute: str) -> Column:
    return F.nullif(F.xpath_string(xml, F.lit(f"(//{_named(element)}/@*[local-name()='{attribute}'])[1]")), F.lit(""))


def article_id(xml: Column, kind: str) -> Column:
    return F.nullif(F.trim(F.xpath_string(xml, F.lit(f"(//{_named('article-id')}[@pub-id-type='{kind}'])[1]"))), F.lit(""))


def authors(xml: Column) -> Column:
    """"Surname Given" joined by ', '."""
    names = [F.xpath(xml, F.lit(f"//{_named('contrib')}//{_named('name')}/{_named(n)}/text()")) for n in ("surname", "given-names")]
    return F.array_join(F.zip_with(*names, lambda s, g: F.trim(F.concat_ws(" ", s, g))), ", ")


def article_fields(xml: Column) -> dict[str, Column]:
    """Title, ids, journal, year, authors, abstract and body paragraphs of a journal article."""
    return {
        "title": text_of(xml, "article-title"), "pmcid": article_id(xml, "pmc"), "pmid": article_id(xml, "pmid"), "doi": article_id(xml, "doi"), "journal": text_of(xml, "journal-title"),
        "year": F.xpath_string(xml, F.lit(f"(//{_named('pub-date')}/{_named('year')})[1]")).try_cast("int"), "authors": authors(xml),
        "abstract": F.nullif(F.array_join(texts_of(xml, "abstract", "p"), " "), F.lit("")), "license_text": F.nullif(F.array_join(texts_of(xml, "permissions"), " "), F.lit("")),
        "paragraphs": F.xpath(xml, F.lit(f"//{_named('body')}//{_named('p')}/text()")),
    }
