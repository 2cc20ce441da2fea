"""The query catalogue: each engine operator on the closest of the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import audit, dedupe, match, patterns, sequence, vector
from ..session import spread, table
from .expected import LICENSE_SQL as _LICENSE_SQL
from .expected import VERSION_SQL as _VERSION_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SQUEEZE = r"trim(regexp_replace(text, '[\s\x{00a0}\x{0085}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}\x{000b}]+', ' ', 'g'))"
_KEY = f"replace(lower({_SQUEEZE}), 'ß', 'ss')"
_NAME_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, md5({_SQUEEZE}) AS digest, CAST(length({_SQUEEZE}) AS INTEGER) AS chars FROM documents")
def ws_normalize(spark, sf_dir):
    clean = text.squeeze(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("digest"), F.length(clean).alias("chars"))


@query(f"""SELECT 'part' AS kind, p_partkey AS id, {_NAME_KEY.format('p_name')} AS name_key, left(replace({_NAME_KEY.format('p_name')}, ' ', '_'), 12) AS slug FROM part
UNION ALL SELECT 'customer', c_custkey, {_NAME_KEY.format('c_name')}, left(replace({_NAME_KEY.format('c_name')}, ' ', '_'), 12) FROM customer""")
def slug_name(spark, sf_dir):
    side = lambda t, key, name: table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(key).alias("id"), text.name_key(F.col(name)).alias("name_key"), text.slug(F.col(name), 12).alias("slug"))
    return side("part", "p_partkey", "p_name").union(side("customer", "c_custkey", "c_name"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE rtrim(left(text, 120), ' ') || '...' END AS dots,
CASE WHEN length(text) <= 60 THEN text ELSE rtrim(left(text, 60), ' ') || ' ...[truncated]' END AS marked,
CASE WHEN length(text) <= 90 THEN text ELSE left(text, 90) || chr(10) || '[TRUNCATED]' END AS lined FROM documents""")
def truncate_variants(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(t, 120, "...").alias("dots"), text.truncated(t, 60, " ...[truncated]").alias("marked"), text.truncated(t, 90, "\n[TRUNCATED]", strip=False).alias("lined"))


@query("SELECT conv_id, turn, upper(role) AS field, trim(text, ' ' || chr(10) || chr(13) || chr(9)) AS body FROM conversations")
def line_prefix_header(spark, sf_dir):
    whole = F.concat(F.lit("ROLE: "), F.upper("role"), F.lit("\nTURN: "), F.col("turn").cast("string"), F.lit("\n" + "-" * 80 + "\n"), "text")
    made = table(spark, sf_dir, "conversations").select("conv_id", whole.alias("whole"))
    fields = text.header_fields(F.col("whole"))
    return made.select("conv_id", F.try_element_at(fields, F.lit("TURN")).cast("long").alias("turn"), F.try_element_at(fields, F.lit("ROLE")).alias("field"), text.header_body(F.col("whole")).alias("body"))


@query("""SELECT event_id, CASE regexp_extract(upper(s), '\\b(YES|NO)\\b', 1) WHEN 'YES' THEN true WHEN 'NO' THEN false END AS answer
FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'yes, ' || event_type WHEN event_id % 4 = 1 THEN event_type || ' No.' WHEN event_id % 4 = 2 THEN 'nope ' || event_type ELSE 'yesno' END AS s FROM events)""")
def yes_no_parse(spark, sf_dir):
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit("yes, "), "event_type")).when(k == 1, F.concat("event_type", F.lit(" No."))).when(k == 2, F.concat(F.lit("nope "), "event_type")).otherwise("yesno")
    return table(spark, sf_dir, "events").select("event_id", text.yes_no(said).alias("answer"))


@query(f"SELECT doc_id, {_LICENSE_SQL} AS license_label FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def license_rule_a(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.article_license(F.col("text")).alias("license_label"))


@query(f"SELECT {_LICENSE_SQL} AS label, count(*) AS n FROM (SELECT lower(text) AS t FROM documents) GROUP BY 1")
def license_histogram(spark, sf_dir):
    return audit.histogram(table(spark, sf_dir, "documents"), rules.article_license(F.col("text")))


@query(f"SELECT doc_id, 'CC_BY_NC_' || coalesce(replace({_VERSION_SQL}, '.', '_'), 'UNSPECIFIED') AS label FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def license_refine_version(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", rules.refined_license(F.lit("CC_BY_NC_UNSPECIFIED"), F.lit("CREATIVE_COMMONS_UNCLEAR"), F.lit("cc_by_nc"), t).alias("label"))


_RECORDS = (
    (1, "", ("http://creativecommons.org/licenses/by-nc-nd/4.0/",), (), ("1",), (), "CC_BY_NC_ND_4_0"),
    (2, "", (), ("creativecommons.org/licenses/by-nc-nd/4.0/",), ("0",), (), "SELF_ARCHIVING_CC_BY_NC_ND_4_0"),
    (3, "http://www.elsevier.com/open-access/userlicense/1.0/", (), (), ("1",), (), "ELSEVIER_USER_LICENSE"),
    (4, "", (), (), ("true",), (), "OPEN_ACCESS_LICENSE_UNSURE"),
    (5, "All rights reserved.", (), (), (), (), "NO_OPEN_ACCESS"),
    (6, "cc by 4.0", (), (), ("0", "Full"), (), "CC_BY_4_0"),
    (7, "", (), (), ("no",), ("true",), "NO_OPEN_ACCESS"),
    (8, "", (), (), (), ("true",), "OPEN_ACCESS_LICENSE_UNSURE"),
    (9, "an open access article", (), (), (), (), "OPEN_ACCESS_LICENSE_UNSURE"),
)


@query("SELECT p_partkey AS id, CASE p_size % 9 " + " ".join(f"WHEN {r[0] - 1} THEN '{r[6]}'" for r in _RECORDS) + " END AS label FROM part")
def license_rule_b(spark, sf_dir):
    """A publisher's license fields of one of nine kinds, by the part's size, with the part's name in the text."""
    listed = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    kind = F.col("p_size") % len(_RECORDS)
    chosen = lambda make: F.coalesce(*[F.when(kind == r[0] - 1, make(r)) for r in _RECORDS])
    raw = chosen(lambda r: F.concat(F.lit(r[1]), F.lit(" "), "p_name"))
    fields = [chosen(lambda r, k=k: listed(r[k])) for k in (2, 3, 4, 5)]
    names = ("user_texts", "self_archiving", "open_access", "open_archive")
    records = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")).select(F.col("p_partkey").alias("id"), raw.alias("raw"), *[f.alias(n) for f, n in zip(fields, names, strict=True)])
    return rules.publisher_labels(records, "raw", *names).select("id", "label")


@query("""WITH d(level, label) AS (VALUES (1, 'Guidelines'), (2, 'Regulatory documents'), (3, 'Systematic reviews and meta-analyses'), (4, 'Randomized clinical trials'),
(5, 'Observational and registry studies'), (6, 'Trial registry entries'), (7, 'Narrative reviews, commentaries, case reports'))
SELECT doc_id, CAST(k AS INTEGER) AS level, label FROM (SELECT doc_id, CAST(regexp_extract(source, '[0-9]+', 0) AS INTEGER) % 7 + 1 AS k FROM documents) JOIN d ON d.level = k""")
def level_direct(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.regexp_extract("source", "[0-9]+", 0).try_cast("int") % 7 + 1).alias("level"))
    return docs.select("doc_id", rules.level_struct(F.col("level")).alias("h")).select("doc_id", "h.level", "h.label")


@query("SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '[3457]', 0), '') AS INTEGER) AS level FROM pages")
def level_parse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.level_digit(F.col("url")).alias("level"))


@query("""SELECT doc_id, regexp_matches(lower(text), 'references|acknowledge?ments|disclosures?|funding|author contributions|conflicts of interest|manuscript editing support')
OR len(regexp_extract_all(text, '(?m)^\\s*\\d+\\.\\s')) >= 8 AS junk FROM documents""")
def junk_page_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.is_reference_page(F.col("text")).alias("junk"))


@query("""SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(lines) AS BIGINT) AS lines, CAST(len(list_filter(lines, lambda x: length(x) < 40)) AS BIGINT) AS short_lines,
CAST(len(list_filter(lines, lambda x: x LIKE '%-')) AS BIGINT) AS hyphen_ends, contains(text, '|') AS has_table, length(text) >= 200 AND len(list_filter(lines, lambda x: length(x) < 40)) * 2 < len(lines) AS usable
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)""")
def text_quality_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", "\n").alias("l"))
    d = d.select("doc_id", F.length("text").cast("long").alias("chars"), F.size("l").cast("long").alias("lines"), F.size(F.filter("l", lambda x: F.length(x) < 40)).cast("long").alias("short_lines"), F.size(F.filter("l", lambda x: F.endswith(x, F.lit("-")))).cast("long").alias("hyphen_ends"), F.contains("text", F.lit("|")).alias("has_table"))
    return d.withColumn("usable", (F.col("chars") >= 200) & (F.col("short_lines") * 2 < F.col("lines")))


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations) WHERE NOT contains(t, 'ask a health professional before use') AND NOT contains(t, 'children younger than')
AND NOT regexp_matches(t, 'does not list any (boxed warning|contraindications|adverse reactions|drug interactions)')""")
def low_value_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(~rules.is_low_value(F.col("text"))).select("conv_id", "turn")


@query("""SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, list(DISTINCT l_returnflag || l_linestatus) AS kinds FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE o_orderstatus <> '' AND list_has_any(kinds, ['AF', 'RF']) AND NOT list_has_any(kinds, ['NO'])""")
def array_overlap_filter(spark, sf_dir):
    kinds = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("kinds"))  # six at most
    met = table(spark, sf_dir, "orders").where("o_orderstatus <> ''").join(kinds, F.col("l_orderkey") == F.col("o_orderkey"))
    have = lambda *x: F.arrays_overlap("kinds", F.array(*map(F.lit, x)))
    return met.where(have("AF", "RF") & ~have("NO")).select("o_orderkey")


@query("""SELECT page_id, link, min(pos) AS first_pos FROM (SELECT page_id, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS pos FROM
(SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages)) GROUP BY 1, 2""")
def html_title_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "link"))
    return links.groupBy("page_id", "link").agg(F.min("pos").cast("long").alias("first_pos"))


@query("""SELECT page_id, CAST(pos AS INTEGER) AS pos, trim(block) AS block FROM (SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS pos FROM
(SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS b FROM pages)) WHERE trim(block) <> ''""")
def html_blocks_explode(spark, sf_dir):
    blocks = table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.tagged_blocks(F.col("html"), "<p>", "</p>")).alias("pos", "block"))
    return blocks.where("block <> ''")


@query("""SELECT page_id, nullif(regexp_extract(lower(trim(d)), '10\\.\\d{4,9}/\\S+', 0), '') AS doi, lower(regexp_replace(trim(d), '^https://doi\\.org/', '')) AS stripped, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS title_key, CAST(page_id AS VARCHAR) AS pmcid
FROM (SELECT page_id, url, ' https://doi.org/10.' || (1000 + page_id) || '/Ab' || page_id || ' ' AS d FROM pages)""")
def url_key_normalize(spark, sf_dir):
    made = F.concat(F.lit(" https://doi.org/10."), (F.col("page_id") + 1000).cast("string"), F.lit("/Ab"), F.col("page_id").cast("string"), F.lit(" "))
    return table(spark, sf_dir, "pages").select("page_id", text.doi_found(made).alias("doi"), text.doi_stripped(made).alias("stripped"), text.title_key(F.col("url")).alias("title_key"), text.pmcid_key(F.concat(F.lit(" pmc"), F.col("page_id").cast("string"))).alias("pmcid"))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(i * 1500 AS INTEGER) AS chunk_start, substr(text, i * 1500 + 1, 2000) AS chunk
FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 2000 THEN 1 ELSE CAST(ceil((length(text) - 500) / 1500.0) AS BIGINT) END)) AS i FROM documents)""")
def char_chunks(spark, sf_dir):
    return sequence.char_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 2000, 500).drop("text")


_PACK = """WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS ps FROM documents),
r(doc_id, ps, i, own, packs) AS (SELECT doc_id, ps, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM p
UNION ALL SELECT doc_id, ps, i + 1,
 CASE WHEN length(ps[i + 1]) > 1200 THEN CAST([] AS VARCHAR[])
  WHEN len(own) > 0 AND length(array_to_string(own, '  ')) + 2 + length(ps[i + 1]) > 1200
   THEN list_append(own[greatest(1, len(own) - len(list_filter(range(1, len(own) + 1), lambda k: length(array_to_string(own[len(own) - k + 1:len(own)], '  ')) + 2 < 200))):len(own)], ps[i + 1])
  ELSE list_append(own, ps[i + 1]) END,
 CASE WHEN length(ps[i + 1]) > 1200 THEN list_concat(packs, CASE WHEN len(own) > 0 THEN [array_to_string(own, chr(10) || chr(10))] ELSE [] END, list_transform(range(0, length(ps[i + 1]) - 200, 1000), lambda k: substr(ps[i + 1], k + 1, 1200)))
  WHEN len(own) > 0 AND length(array_to_string(own, '  ')) + 2 + length(ps[i + 1]) > 1200 THEN list_append(packs, array_to_string(own, chr(10) || chr(10)))
  ELSE packs END
FROM r WHERE i < len(ps)),
w AS (SELECT doc_id, CASE WHEN len(own) > 0 THEN list_append(packs, array_to_string(own, chr(10) || chr(10))) ELSE packs END AS packs FROM r WHERE i = len(ps))
SELECT doc_id, CAST(generate_subscripts(packs, 1) - 1 AS INTEGER) AS pack_no, unnest(packs) AS pack FROM w"""


@query(_PACK)
def paragraph_pack(spark, sf_dir):
    return sequence.paragraph_packs(table(spark, sf_dir, "documents"), "doc_id", "text", 1200, 200, split="\n")


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user_turn FROM conversations""")
def section_carry(spark, sf_dir):
    return sequence.carry_last(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], "turn", "last_user_turn")


@query("""SELECT conv_id, turn, lag(CASE WHEN contains(text, ',') THEN left(text, 3000) END) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations""")
def prev_context_carry(spark, sf_dir):
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return sequence.carry_previous(convs, F.when(F.contains("text", F.lit(",")), F.left("text", F.lit(3000))), ["conv_id"], "turn", "context").drop("text")


@query("SELECT doc_id, source, lang, n_chars, row_number() OVER (ORDER BY source, doc_id) AS global_id FROM documents")
def global_id(spark, sf_dir):
    return sequence.global_id(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "doc_id"])


@query("""SELECT event_id, user_id, count(*) OVER w AS seen, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_counters(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    out = sequence.running(sequence.running(ev, F.lit(1), ["user_id"], ["ts", "event_id"], "seen"), F.col("value"), ["user_id"], ["ts", "event_id"], "total")
    return out.select("event_id", "user_id", "seen", F.round("total", 4).alias("total"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_KEY}")
def exact_dedupe_keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2(dedupe.text_key(F.col("text")), 256).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(f"SELECT m AS canonical_id, doc_id AS duplicate_id, n AS members FROM (SELECT doc_id, min(doc_id) OVER w AS m, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY {_KEY})) WHERE doc_id > m")
def dedupe_report(spark, sf_dir):
    return dedupe.duplicate_report(table(spark, sf_dir, "documents"), F.sha2(dedupe.text_key(F.col("text")), 256), "doc_id")


@query("""WITH d AS (SELECT doc_id, md5(text) AS h, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS k, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents),
a AS (SELECT * FROM d WHERE NOT known), b AS (SELECT * FROM d WHERE known), h AS (SELECT h, min(doc_id) AS m FROM b GROUP BY 1), t AS (SELECT k, min(doc_id) AS m FROM b WHERE k <> '' GROUP BY 1)
SELECT doc_id, coalesce(h.m, t.m) AS other_id, CASE WHEN h.m IS NOT NULL THEN 'doi' WHEN t.m IS NOT NULL THEN 'title' ELSE 'none' END AS match_type FROM a LEFT JOIN h USING (h) LEFT JOIN t USING (k)""")
def cross_source_match(spark, sf_dir):
    """Documents without labels that say what a labelled one says: the same text, or the same letters and digits.

    Both keys of a text are computed in one read and written; only they are joined.
    """
    from ..sources.tables import write_and_read

    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    key = text.title_key(F.col("text"))
    keys = table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.md5("text")).alias("h"), F.when(key != "", F.unhex(F.md5(key))).alias("k"))
    d = write_and_read(keys.join(known, "doc_id", "left"), "keys")
    side = lambda key: d.where(F.col("known") & F.col(key).isNotNull()).groupBy(key).agg(F.min("doc_id").alias("other_id"))
    out = match.first_of_keys(d.where("known is null"), [("doi", side("h"), "h", "h"), ("title", side("k"), "k", "k")], "other_id")
    return out.select("doc_id", "other_id", "match_type")


@query("""WITH d AS (SELECT doc_id, md5(text) AS h, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS k, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents),
h AS (SELECT h, min(doc_id) AS m FROM d WHERE known GROUP BY 1), t AS (SELECT k, min(doc_id) AS m FROM d WHERE known AND k <> '' GROUP BY 1)
SELECT CASE WHEN h.m IS NOT NULL THEN 'doi' WHEN t.m IS NOT NULL THEN 'title' ELSE 'none' END AS match_type, count(*) AS n FROM d LEFT JOIN h USING (h) LEFT JOIN t USING (k) WHERE NOT known GROUP BY 1""")
def match_breakdown(spark, sf_dir):
    """How often each way of matching found another record."""
    return cross_source_match(spark, sf_dir).groupBy("match_type").agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN (SELECT doc_id, arg_max(quality, toxic * 10 + quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id""")
def enrich_keep_last(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("at", F.col("toxic") * 10 + F.col("quality"))
    return match.lookup(table(spark, sf_dir, "documents").select("doc_id"), labels, "doc_id", "at", first=False).select("doc_id", "quality", "matched")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'no_label' WHEN quality IS NULL THEN 'blank' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def enrich_status(spark, sf_dir):
    met = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").withColumn("hit", F.lit(True)), "doc_id", "left")
    return audit.histogram(met, F.when(F.col("hit").isNull(), "no_label").when(F.col("quality").isNull(), "blank").when(F.col("quality") == 1, "good").otherwise("bad"), "status")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join_incremental(spark, sf_dir):
    return audit.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def semi_update(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").join(known, "vec_id", "left_semi").select("vec_id", (F.col("label") + 100).alias("label"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 4) AS value FROM events GROUP BY 1")
def keyed_upsert(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", "e.event_id", F.round("e.value", 4).alias("value"))


_CASCADE = """WITH k AS (SELECT o_orderkey AS probe_id, 1 AS rule, o_custkey AS key FROM orders UNION ALL SELECT o_orderkey, 2, o_custkey + 1 FROM orders),
b AS (SELECT c_custkey AS key, c_custkey AS build_id, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey + 1, c_custkey, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'),
w AS (SELECT probe_id, rule, key FROM (SELECT k.*, row_number() OVER (PARTITION BY probe_id ORDER BY rule, key) AS n FROM k WHERE key IN (SELECT key FROM b)) WHERE n = 1)
SELECT probe_id, CAST(rule AS INTEGER) AS rule, count(*) AS candidates, arg_max(CASE WHEN c_acctbal > 0 THEN build_id END, (c_acctbal > 0, c_acctbal, -build_id)) AS build_id FROM w JOIN b USING (key) GROUP BY 1, 2"""


@query(_CASCADE)
def match_cascade(spark, sf_dir):
    """Orders against customers with a known segment, by their key, else by the key after it; a customer has both."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    probe = o.select(F.col("o_orderkey").alias("probe_id"), F.lit(1).alias("rule"), F.lit(0).alias("pos"), F.col("o_custkey").alias("key"))
    probe = probe.union(o.select("o_orderkey", F.lit(2), F.lit(0), F.col("o_custkey") + 1))
    build = c.select("c_custkey", F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 1)).alias("key"), "c_acctbal")
    return match.cascade(probe, build.select("key", F.col("c_custkey").alias("build_id"), "c_acctbal"), F.col("c_acctbal") > 0, [F.col("c_acctbal").desc(), F.col("build_id")])


@query("""WITH p AS (SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE p_size > 25), q AS (SELECT p_partkey AS id, p_brand, p_type, p_size FROM part WHERE p_size <= 25),
a AS (SELECT p_brand, p_type, p_size % 25 AS s, min(p_partkey) AS m FROM p GROUP BY 1, 2, 3), b AS (SELECT p_brand, p_type, min(p_partkey) AS m FROM p GROUP BY 1, 2), c AS (SELECT p_brand, min(p_partkey) AS m FROM p GROUP BY 1)
SELECT id, coalesce(a.m, b.m, c.m) AS part_id, CASE WHEN a.m IS NOT NULL THEN 'full' WHEN b.m IS NOT NULL THEN 'pair' WHEN c.m IS NOT NULL THEN 'brand' ELSE 'none' END AS match_type
FROM q LEFT JOIN a ON a.p_brand = q.p_brand AND a.p_type = q.p_type AND a.s = q.p_size % 25 LEFT JOIN b ON b.p_brand = q.p_brand AND b.p_type = q.p_type LEFT JOIN c ON c.p_brand = q.p_brand""")
def composite_lookup(spark, sf_dir):
    keys = {"full": ("p_brand", "p_type", "size"), "pair": ("p_brand", "p_type"), "brand": ("p_brand",)}
    p = table(spark, sf_dir, "part").withColumn("size", F.col("p_size") % 25).select("p_partkey", "p_size", *[F.to_json(F.struct(*cols)).alias(name) for name, cols in keys.items()])
    build = p.where("p_size > 25")
    probe = p.where("p_size <= 25").withColumnRenamed("p_partkey", "id")
    return match.first_of_keys(probe, [(k, build.groupBy(k).agg(F.min("p_partkey").alias("part_id")), k, k) for k in keys], "part_id").select("id", "part_id", "match_type")


@query(f"""WITH v AS (SELECT p_partkey, {_NAME_KEY.format('p_name')} AS k FROM part), w AS (SELECT p_partkey, unnest(string_split(k, ' ')) AS t FROM v)
SELECT v.p_partkey AS left_id, min(w.p_partkey) AS right_id, count(DISTINCT w.p_partkey) AS others FROM v JOIN w ON w.t = string_split(v.k, ' ')[1] GROUP BY 1""")
def name_variant_join(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", text.name_key(F.col("p_name")).alias("k"))
    words = v.select(F.explode(F.array_distinct(F.split("k", " "))).alias("t"), F.col("p_partkey").alias("r")).groupBy("t").agg(F.min("r").alias("right_id"), F.count("*").alias("others"))
    return v.select(F.col("p_partkey").alias("left_id"), F.split_part("k", F.lit(" "), F.lit(1)).alias("t")).join(words, "t").select("left_id", "right_id", "others")


_TOKENS = ((1, "red"), (1, "ste"), (2, "e"), (2, "lu"), (3, "ee"), (3, "green"), (3, "st"))


@query("WITH q(query_id, token) AS (VALUES " + ", ".join(f"({a}, '{b}')" for a, b in _TOKENS) + """), s AS (SELECT query_id, p_partkey AS name_id, count(*) AS score FROM q JOIN part ON contains(lower(p_name), token) GROUP BY 1, 2)
SELECT CAST(query_id AS BIGINT) AS query_id, name_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name_id) AS n FROM s) WHERE n <= 20""")
def theta_candidates_top20(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name_id"), F.lower("p_name").alias("name"))
    return match.substring_candidates(spark.createDataFrame(list(_TOKENS), "query_id long, token string"), names)


@query("""WITH q AS (SELECT p_type AS query_id, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS k FROM part GROUP BY 1), w AS (SELECT DISTINCT query_id, unnest(string_split(k || CASE WHEN k LIKE '%brass%' AND k = 'small plated brass' THEN ' gold alloy' ELSE '' END, ' ')) AS token FROM q),
s AS (SELECT query_id, p_partkey AS name_id, count(*) AS score FROM w JOIN part ON contains(lower(p_name || ' ' || p_brand), token) WHERE token <> '' GROUP BY 1, 2)
SELECT query_id, name_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name_id) AS n FROM s) WHERE n <= 20""")
def type_candidates(spark, sf_dir):
    """The parts whose name and brand hold most of the words of a type, one of which has a synonym."""
    p = table(spark, sf_dir, "part")
    tokens = match.name_tokens(p.select("p_type").distinct(), "p_type", "p_type", {"SMALL PLATED BRASS": ["gold alloy"]})
    return match.substring_candidates(tokens, p.select(F.col("p_partkey").alias("name_id"), F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("name")))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderpriority = '1-URGENT', o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY 1")
def best_of_group(spark, sf_dir):
    rank = F.struct(F.col("o_orderpriority") == "1-URGENT", "o_totalprice", -F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", rank).alias("best"))


@query("""SELECT o_custkey, max(CAST(strftime(o_orderdate, '%Y') AS INTEGER)) AS latest_year, min(TRY_CAST(regexp_extract(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '^(\\d{4})', 1) AS INTEGER)) AS first_year FROM orders GROUP BY 1""")
def year_rules(spark, sf_dir):
    day = F.col("o_orderdate").cast("date").cast("string")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(text.year_in(day)).alias("latest_year"), F.min(text.leading_year(day)).alias("first_year"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS meta_user_id, event_type AS meta_event_kind, CAST(event_id % 3 AS VARCHAR) || ' | ' || CAST(event_id % 5 AS VARCHAR) AS meta_tags FROM events")
def flatten_metadata(spark, sf_dir):
    from ..functions.nested import flatten

    meta = F.struct(F.col("user_id"), F.struct(F.col("event_type").alias("kind")).alias("event"), F.array(F.col("event_id") % 3, F.col("event_id") % 5).alias("tags"))
    ev = table(spark, sf_dir, "events").select("event_id", meta.alias("m"))
    return ev.select("event_id", *flatten(ev, "m", arrays="joined", prefix="meta"))


@query("SELECT doc_id, concat_ws(' | ', nullif(trim(source), ''), nullif(trim(lang), ''), CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || quality END, text) AS embedding_text FROM documents LEFT JOIN labels l USING (doc_id)")
def embedding_text(spark, sf_dir):
    met = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    made = F.concat_ws(" | ", text.blank_to_null(F.col("source")), text.blank_to_null(F.col("lang")), F.concat(F.lit("quality "), F.col("quality").cast("string")), F.col("text"))
    return met.select("doc_id", made.alias("embedding_text"))


_NEAR = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 5) AS similarity FROM e a, e b WHERE {where}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM n)"""


@query(_NEAR.format(where="a.vec_id % 100 = 0") + " SELECT query_id, id, similarity, rank FROM r WHERE rank <= 5")
def knn_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vector.nearest(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), 5)


@query(_NEAR.format(where="TRUE").replace("WITH e", "WITH RECURSIVE e") + """, l AS (SELECT id AS dst, list(query_id) AS ins FROM r WHERE rank <= 6 AND similarity >= 0.35 AND query_id < id GROUP BY 1),
 o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS pos, coalesce(ins, []) AS ins FROM embeddings LEFT JOIN l ON dst = vec_id),
 g(pos, heads) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.pos, CASE WHEN list_has_any(heads, ins) THEN heads ELSE list_append(heads, vec_id) END FROM g JOIN o ON o.pos = g.pos + 1),
 h AS (SELECT heads FROM g ORDER BY pos DESC LIMIT 1)
SELECT vec_id AS id, CASE WHEN list_contains(heads, vec_id) THEN vec_id ELSE list_min(list_intersect(heads, ins)) END AS root FROM o, h""")
def knn_greedy_dedupe(spark, sf_dir):
    """Greedy clusters over lists of the six nearest (itself included) from a similarity of 0.35 on."""
    from ..sources.tables import write_and_read

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = vector.neighbours(e, 6, 0.35).where("query_id < id")
    return dedupe.greedy_canonical(e.select("id"), near.select(F.col("query_id").alias("src"), F.col("id").alias("dst")), write_and_read)


@query(_NEAR.format(where="TRUE") + " SELECT query_id, id, similarity, rank FROM r WHERE rank <= 4 AND similarity >= 0.4")
def similar_neighbours(spark, sf_dir):
    """The three rows nearest to each vector, and itself, as far as they reach a similarity."""
    return vector.neighbours(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 4, 0.4)


_TURNED = "SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding, CASE WHEN vec_id % 7 = 3 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT -1 - vec_id, list_reverse(embedding), 99 FROM embeddings WHERE vec_id % 11 = 5"


def _turned(spark, sf_dir):
    """A collection of the embeddings in which some vectors have been turned round, and to which others were added."""
    from ..sources.collection import Collection
    from ..sources.tables import shared_folder

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    made = Collection(spark, shared_folder(spark)).build(e)
    turned = e.where("id % 7 = 3").select("id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(-1).alias("label"))
    made.upsert(turned.union(e.where("id % 11 = 5").select(-1 - F.col("id"), F.reverse("embedding"), F.lit(99))))
    return Collection(spark, made.path)


@query(_TURNED)
def collection_upsert(spark, sf_dir):
    """What a stored collection holds after an upsert, opened again."""
    return _turned(spark, sf_dir).rows().select(F.col("id").alias("vec_id"), "embedding", "label")


@query(_NEAR.replace("FROM embeddings)", "FROM (" + _TURNED + "))").format(where="a.vec_id % 100 = 0") + " SELECT query_id, id, similarity, rank FROM r WHERE rank <= 5")
def collection_search(spark, sf_dir):
    """An exact search (through all lists) of the stored collection after an upsert."""
    made = _turned(spark, sf_dir)
    queries = made.rows().where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    return made.search(queries, 5, probes=1 << 20)


@query("SELECT count(*) AS queries, TRUE AS reached FROM embeddings WHERE vec_id % 100 = 0")
def collection_recall(spark, sf_dir):
    """Whether the index, looked through as far as it was measured to need, finds 0.9 of the five nearest rows."""
    from ..sources.collection import Collection
    from ..sources.tables import shared_folder

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = e.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    found = Collection(spark, shared_folder(spark)).build(e).search(queries, 5).select("query_id", "id", F.lit(1).alias("hit"))
    met = vector.nearest(queries, e, 5).join(found, ["query_id", "id"], "left")
    return met.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


@query("SELECT vec_id, label FROM embeddings WHERE label % 2 = 0")
def rebuilt_collection(spark, sf_dir):
    """A collection built anew from some of its rows, which then are all it holds; the old files go."""
    made = _turned(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    made.rebuild(e.where("label % 2 = 0"))
    made.vacuum()
    return made.rows().select(F.col("id").alias("vec_id"), "label")


@query(_NEAR.format(where="a.vec_id % 100 = 0") + """ SELECT query_id, string_agg('[Factoid ' || rank || ' | ' || source || '; ' || lang || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
FROM r JOIN documents ON doc_id = id WHERE rank <= 5 GROUP BY 1""")
def rag_context(spark, sf_dir):
    hits = knn_topk(spark, sf_dir).join(table(spark, sf_dir, "documents"), F.col("id") == F.col("doc_id")).withColumnRenamed("text", "document")
    return vector.context_block(hits, "query_id", "rank", "source", "lang")


@query("SELECT conv_id, string_agg(turn || '. ' || role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def prompt_assembly(spark, sf_dir):
    line = F.concat(F.col("turn").cast("string"), F.lit(". "), "role", F.lit(": "), "text")
    own = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", line.alias("t")).alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # the turns of one talk
    return own.select("conv_id", F.array_join(F.transform("ps", lambda p: p["t"]), "\n").alias("prompt"))


@query("""SELECT doc_id, rule FROM (SELECT doc_id, unnest([CASE WHEN coalesce(length(text) >= 100, false) THEN NULL ELSE 'text_length' END, CASE WHEN n_chars = length(text) THEN NULL ELSE 'n_chars' END, CASE WHEN lang IN ('en','de','fr') THEN NULL ELSE 'lang' END]) AS rule FROM documents) WHERE rule IS NOT NULL""")
def schema_audit(spark, sf_dir):
    return audit.violations(table(spark, sf_dir, "documents"), "doc_id", {"text_length": F.length("text") >= 100, "n_chars": F.col("n_chars") == F.length("text"), "lang": F.col("lang").isin("en", "de", "fr")})


@query(f"SELECT source, {_LICENSE_SQL} = 'UNKNOWN' AS unlabelled, count(*) AS n FROM (SELECT source, lower(text) AS t FROM documents) GROUP BY 1, 2")
def license_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", (rules.article_license(F.col("text")) == "UNKNOWN").alias("unlabelled"))
    return docs.groupBy("source", "unlabelled").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'unclear' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS route, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS suffix FROM documents LEFT JOIN labels l USING (doc_id)")
def routing_split(spark, sf_dir):
    met = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    route = F.when(F.col("quality").isNull(), "unclear").when(F.col("quality") == 1, "yes").otherwise("no")
    numbered = sequence.number_in_group(met, "source", "doc_id", "suffix")
    return numbered.select("doc_id", route.alias("route"), F.col("suffix"))


@query("SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FROM documents")
def source_totals(spark, sf_dir):
    return audit.with_total(table(spark, sf_dir, "documents"), "source")


@query(f"""WITH d AS (SELECT doc_id, {_KEY} AS k, {_LICENSE_SQL.replace('(t,', '(lower(text),')} AS license_label FROM documents), f AS (SELECT min(doc_id) AS doc_id, any_value(license_label) AS license_label FROM d GROUP BY k)
SELECT license_label, quality, count(*) AS n FROM f LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def curated_overview(spark, sf_dir):
    """Normalised text, first of each, license label, labels joined, counts."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy(F.sha2(dedupe.text_key(F.col("text")), 256).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    kept = docs.join(first, "doc_id", "left_semi").select("doc_id", rules.article_license(F.col("text")).alias("license_label"))
    return kept.join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("license_label", "quality").agg(F.count("*").alias("n"))


@query("SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def benchmark_overlap(spark, sf_dir):
    """Documents that contain an item word for word: all items are searched in one read of the texts, which stay where they are."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("pattern"))
    hits = patterns.found_in(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), items)
    return hits.join(items, "pattern").select(F.col("id").alias("doc_id"), "item_id")


@query("""SELECT conv_id, turn, CASE WHEN len(string_split(text, chr(10))) >= 5 THEN list_concat(string_split(text, chr(10))[1:5], ['[table truncated]']) ELSE string_split(text, chr(10)) END AS rows FROM conversations""")
def table_row_cap(spark, sf_dir):
    """The first rows of a table, with a mark where their number reaches the cap."""
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.size(lines) >= 5, F.concat(F.slice(lines, 1, 5), F.array(F.lit("[table truncated]")))).otherwise(lines).alias("rows"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 7")
def per_source_limit(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id").withColumn("n", nth).where("n <= 7").drop("n")


@query("SELECT 'good' AS pass, doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1")
def union_of_passes(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.where("quality = 1").select(F.lit("good").alias("pass"), "doc_id").unionByName(labels.where("toxic = 1").select(F.lit("toxic").alias("pass"), "doc_id"))


@query("""WITH d AS (SELECT doc_id, source, length(text) AS n FROM documents) SELECT count(DISTINCT nullif(trim(source), '')) AS processed, greatest(30 - count(DISTINCT nullif(trim(source), '')), 0) AS remaining FROM d""")
def processed_counts(spark, sf_dir):
    return audit.processed_counts(table(spark, sf_dir, "documents"), "source", 30)


@query(f"SELECT count(*) AS before, count(DISTINCT {_KEY}) AS after, round((1 - count(DISTINCT {_KEY}) / count(*)) * 100, 6) AS reduction FROM documents")
def reduction_percentage(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select(F.sha2(dedupe.text_key(F.col("text")), 256).alias("k"))
    out = keys.agg(F.count("*").alias("before"), F.countDistinct("k").alias("after"))
    return out.withColumn("reduction", F.round(dedupe.reduction(F.col("before"), F.col("after")), 6))


@query("""SELECT doc_id, concat_ws('_', regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), lang, doc_id) AS factoid_id, CAST(doc_id % 7 + 1 AS INTEGER) AS level, lang FROM documents""")
def surrogate_ids(spark, sf_dir):
    """Ids of slugs and local ids; a nested field is set, another dropped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.struct(F.lit(0).alias("level"), "lang", F.lit("x").alias("license_label_source")).alias("meta"))
    meta = F.col("meta").dropFields("license_label_source").withField("level", (F.col("doc_id") % 7 + 1).cast("int"))
    return docs.select("doc_id", F.concat_ws("_", F.regexp_replace(F.lower("source"), "[^a-z0-9]+", "_"), "lang", F.col("doc_id").cast("string")).alias("factoid_id"), meta.alias("meta")).select("doc_id", "factoid_id", "meta.*")


@query("""SELECT k, any_value(v) AS v FROM (SELECT user_id AS k, max(event_id) AS v FROM events WHERE event_type = 'error' GROUP BY 1) a GROUP BY 1
UNION ALL SELECT user_id, min(event_id) FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 1""")
def upsert_merge(spark, sf_dir):
    """A table of first events is updated with the last errors."""
    from ..sources.tables import upsert

    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), "event_type")
    errors = ev.where("event_type = 'error'").select("k", "v", F.col("v").alias("at"))
    return upsert(ev.groupBy("k").agg(F.min("v").alias("v")), errors, "k", "at")
