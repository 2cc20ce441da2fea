"""Readers of the file formats that feed the engine. All give DataFrames with the file's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, xml
from .tables import write_and_read

FACTOID_DOCUMENT = "metadata struct<source_family:string,document_title:string,document_type:string,document_year:int,file_name:string,DOI:string,PMID:string,PMCID:string,TITLE:string,JOURNAL:string,YEAR:string,source:string,license_label:string,license_info:struct<copyright:string,commercial_use:string,personal_use:string>,source_hierarchy:struct<level:int,label:string>>, factoids array<struct<id:int,index:int,source:string,text:string,factoid_text:string>>"
#: Keys under which a JSON file holds its list of records.
LIST_KEYS = ("results", "data", "items", "rows", "records")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("file_name", F.col("_metadata.file_name"))


def parted_documents(spark: SparkSession, path: str, schema: str = FACTOID_DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """A document per file, and the files that aren't of the schema: file_name, value. Files are read once, and written."""
    kind = T._parse_datatype_string(f"{schema}, _bad string")
    read = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(kind).json(path)
    kept = write_and_read(_named(read), "documents")
    return kept.where("_bad is null").drop("_bad"), kept.where("_bad is not null").select("file_name", F.col("_bad").alias("value"))


def json_documents(spark: SparkSession, path: str, schema: str = FACTOID_DOCUMENT) -> DataFrame:
    """A document per file; see ``parted_documents`` for the files that aren't of the schema."""
    return parted_documents(spark, path, schema)[0]


def factoids(documents: DataFrame) -> DataFrame:
    """file_name, pos, idx, text and document fields of each factoid with text, in either shape."""
    each = documents.select("file_name", "metadata", F.posexplode("factoids").alias("pos", "f"))
    body = F.coalesce(text.blank_to_null(F.col("f.text")), text.blank_to_null(F.col("f.factoid_text")))
    m = "metadata."
    return each.select(
        "file_name", "pos", F.coalesce("f.index", "f.id", F.lit(0)).alias("idx"), body.alias("text"), F.coalesce(m + "DOI", "f.source", m + "PMID", F.lit("unknown")).alias("source"),
        F.coalesce(m + "TITLE", m + "document_title").alias("title"), F.coalesce(F.col(m + "YEAR").try_cast("int"), F.col(m + "document_year")).alias("year"), F.col(m + "license_label").alias("license_label"),
    ).where("text is not null")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """record (VARIANT) of each record, whether a file is a list, an object with a list, or an object."""
    whole = _named(spark.read.text(path, wholetext=True)).select("file_name", F.try_parse_json("value").alias("v")).where("v is not null")
    inner = [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in LIST_KEYS]
    rows = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *inner, F.array(F.col("v")))
    return whole.select("file_name", F.posexplode(rows).alias("pos", "record"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _named(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Header row; names and values trimmed, nulls as ''. A byte-order mark is not part of the first name."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.lstrip("﻿").strip()) for c in rows.columns])


def header_texts(spark: SparkSession, path: str) -> DataFrame:
    """fields (map) and body of texts with KEY: value lines, a line of dashes, and a body."""
    whole = _named(spark.read.text(path, wholetext=True))
    return whole.select("file_name", text.header_fields(F.col("value")).alias("fields"), text.header_body(F.col("value")).alias("body"))


def markdown_pages(spark: SparkSession, path: str) -> DataFrame:
    whole = _named(spark.read.text(path, wholetext=True))
    return whole.select("file_name", F.explode(text.pages(F.col("value"))).alias("p")).select("file_name", "p.page", "p.content")


def xml_articles(spark: SparkSession, path: str) -> DataFrame:
    whole = _named(spark.read.text(path, wholetext=True))
    return whole.select("file_name", *[c.alias(k) for k, c in xml.article_fields(F.col("value")).items()])


def file_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def binaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def first_with_files(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first candidate folder that has a file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in candidates:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        store = at.getFileSystem(conf)
        if store.exists(at) and len(store.listStatus(at)):
            return folder
    return None


def download_id(is_open: Column, source: Column, pmcid: Column, record_id: Column) -> Column:
    """The id by which a record's full text is fetched: open articles by PMCID, preprints by PPR id."""
    return F.when(is_open & (F.coalesce(pmcid, F.lit("")) != ""), pmcid).when((source == "PPR") & F.startswith(record_id, F.lit("PPR")), record_id)
