"""Queries over what texts say of themselves, and plain forms of numbers, names and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import evidence as E
from recordloom.operators import textquality
from recordloom.plans.catalogue import query, values
from recordloom.tables import observations, spread, table

_NEEDLES = " ".join(f"WHEN contains(lower(t), '{needle}') THEN '{label}'" for needle, label in E.KINDS)
_TYPES = "CASE p_size % 7 WHEN 0 THEN 'Motion/' || p_type WHEN 1 THEN 'Notice of Intent ' || p_type WHEN 2 THEN p_type || ' Errata' WHEN 3 THEN 'Protective Order ' || p_type WHEN 4 THEN 'Court Action' WHEN 5 THEN NULL ELSE p_type || ' (misc)' END"


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of many spellings, made of the parts' own."""
    p, n = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), F.col("p_size") % 7
    kind = F.when(F.col("p_partkey") % 3 == 0, "decision").otherwise("filing")
    t = (
        F.when(n == 0, F.concat(F.lit("Motion/"), "p_type")).when(n == 1, F.concat(F.lit("Notice of Intent "), "p_type")).when(n == 2, F.concat("p_type", F.lit(" Errata")))
        .when(n == 3, F.concat(F.lit("Protective Order "), "p_type")).when(n == 4, "Court Action").when(n == 6, F.concat("p_type", F.lit(" (misc)")))
    )
    return p.select("p_partkey", kind.alias("kind"), t.alias("t"))


@query(
    f"""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'decision' ELSE 'filing' END AS kind, {_TYPES} AS t FROM part)
    SELECT p_partkey, CASE WHEN kind = 'decision' THEN 'Decision' {_NEEDLES} ELSE split_part(trim(regexp_extract(coalesce(t, 'Filing'), '^([^/(]*)', 1)), ' ', 1) END AS label FROM x"""
)
def kind_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _types(spark, sf_dir).select("p_partkey", E.kind_label(F.col("kind"), F.col("t")).alias("label"))


@query(
    f"""WITH x AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'decision' ELSE 'filing' END AS kind, {_TYPES} AS t FROM part)
    SELECT register, COUNT(*) AS n FROM (SELECT CASE WHEN kind = 'decision' AND lower(t) = 'court action' THEN 'court' WHEN kind = 'filing' AND contains(lower(t), 'protective order') THEN 'protective' END AS register FROM x) GROUP BY register"""
)
def register_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _types(spark, sf_dir).groupBy(E.register_of(F.col("kind"), F.col("t")).alias("register")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH k AS (SELECT o_orderkey AS page, 'FD ' || (10000 + o_custkey) AS own, 'FD ' || (10000 + o_custkey) || (o_orderkey % 10) AS found FROM orders WHERE o_custkey < 90000)
    SELECT page, CASE WHEN page % 3 = 0 THEN found ELSE own END AS key FROM k"""
)
def own_fused_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A footnote's digit stuck to the document's own number; a page in three has another number of its own."""
    o = table(spark, sf_dir, "orders").where("o_custkey < 90000").select(F.col("o_orderkey").alias("page"), F.concat(F.lit("FD "), (F.col("o_custkey") + 10000).cast("string")).alias("own"))
    found, other = F.concat("own", (F.col("page") % 10).cast("string")), F.col("page") % 3 == 0
    return o.select("page", E.own_key(found, F.array(F.when(other, "EP 1").otherwise(F.col("own")))).alias("key"))


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, strftime(o_orderdate, '%B %-d, %Y') AS d, o_orderkey % 4 AS v FROM orders)
    SELECT id, CASE v WHEN 0 THEN d WHEN 1 THEN NULL WHEN 2 THEN d ELSE NULL END AS served FROM o"""
)
def served_beside_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date belongs to the number before it, not to one further on; a sub-number's is taken where the number has none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("FD "), F.col("o_custkey").cast("string")).alias("n"), F.date_format("o_orderdate", "MMMM d, yyyy").alias("d"))
    v = F.col("id") % 4
    line = (
        F.when(v == 0, F.concat(F.lit("See "), "n", F.lit(", slip  op. at 3 (STB served "), "d", F.lit("); see also EP 445 (STB served May 1, 2002).")))
        .when(v == 1, F.concat(F.lit("See "), "n", F.lit(". Compare the title served "), "d", F.lit(" there")))
        .when(v == 2, F.concat(F.lit("In "), "n", F.lit(" and "), "n", F.lit(" (Sub-No. 1) (STB served "), "d", F.lit(")")))
        .otherwise(F.concat("n", F.lit(" (served "), "d", F.lit("), "), "n", F.lit(" (served May 31, 1980)")))
    )
    return o.select("id", E.served_beside(line, F.col("n")).alias("served"))


@query(
    """SELECT conv_id, turn, CAST(1 AS INTEGER) AS line, 'March ' || (1 + turn % 28) || ', 2021' AS decided FROM conversations"""
)
def decided_dates_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose second line states a date; their text says none."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "\n", " ").alias("x"))
    page = F.concat(F.lit("Docket\n  Decided: March "), (1 + F.col("turn") % 28).cast("string"), F.lit(", 2021\n"), "x")
    return E.decided_lines(c.withColumn("text", page), ["conv_id", "turn"], "text").select("conv_id", "turn", "line", "decided")


@query(
    r"""WITH l AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents) GROUP BY word HAVING COUNT(DISTINCT doc_id) >= 20),
    t AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS t FROM conversations),
    c AS (SELECT *, list_filter(t, lambda x: regexp_matches(x, '[A-Za-z]')) AS a FROM t),
    w AS (SELECT *, list_filter(list_transform(a, lambda x: regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), lambda x: regexp_matches(x, '^[A-Za-z]+([''-][A-Za-z]+)*$') AND length(x) >= 2) AS w FROM c),
    p AS (SELECT conv_id, turn, k, unnest(string_split_regex(lower(x), '[''-]')) AS word FROM (SELECT conv_id, turn, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM w)),
    h AS (SELECT conv_id, turn, COUNT(*) AS hits FROM (SELECT conv_id, turn, k FROM p LEFT JOIN l ON p.word = l.word GROUP BY 1, 2, 3 HAVING COUNT(*) = COUNT(l.word)) GROUP BY 1, 2),
    n AS (SELECT conv_id, turn, len(t) AS n_tok, len(a) AS lettered, len(w) AS words, len(list_filter(w, lambda x: x <> upper(x) AND regexp_matches(x, '[a-z][A-Z]') AND NOT regexp_matches(x, '^(Mc|Mac|O''|D''|De|La|Le|Van|Von)[A-Z]'))) AS flips,
      length(regexp_replace(text, '\s+', '', 'g')) AS nonspace, length(regexp_replace(regexp_replace(text, '\s+', '', 'g'), '[A-Za-z0-9.,;:!?''"()\[\]/&$%#@*+=<>_-]', '', 'g')) AS junk FROM w)
    SELECT n.*, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / nullif(words, 0), 6) AS lex, round((lettered - words) / nullif(lettered, 0), 6) AS mangled, round(junk / nullif(nonspace, 0), 6) AS junk_share, round(flips / nullif(words, 0), 6) AS case_share FROM n LEFT JOIN h USING (conv_id, turn)"""
)
def reading_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of a bad reading, against the words that twenty documents hold."""
    lexicon = textquality.lexicon(spread(table(spark, sf_dir, "documents")), "doc_id", "text", 20)
    return E.reading_features(table(spark, sf_dir, "conversations"), "text", lexicon, ["conv_id", "turn"])


@query(
    """WITH d AS (SELECT conv_id, MAX(turn) + 1 AS pages, SUM(CASE WHEN role = 'user' THEN 0 ELSE length(text) END) AS chars, BOOL_AND(role = 'user' OR length(text) < 100) AS image_only FROM conversations GROUP BY conv_id)
    SELECT CASE WHEN image_only THEN 'image_only' ELSE 'text_layer' END AS layer, COUNT(*) AS docs, CAST(SUM(pages) AS BIGINT) AS pages, CAST(SUM(chars) AS BIGINT) AS chars, round(SUM(chars) / SUM(pages), 1) AS chars_per_page, CAST(MAX(pages) AS BIGINT) AS most_pages FROM d GROUP BY 1"""
)
def text_layer_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with and without a text layer: pages, characters, characters a page."""
    c, own = table(spark, sf_dir, "conversations"), F.col("role") != "user"
    docs = c.groupBy("conv_id").agg(
        (F.max("turn") + 1).alias("pages"), F.sum(F.when(own, F.length("text")).otherwise(0)).alias("chars"), F.bool_and(~own | (F.length("text") < 100)).alias("image")
    )
    by = docs.groupBy(F.when(F.col("image"), "image_only").otherwise("text_layer").alias("layer"))
    return by.agg(
        F.count(F.lit(1)).alias("docs"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.round(F.sum("chars") / F.sum("pages"), 1).alias("chars_per_page"), F.max("pages").alias("most_pages")
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS title, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract_string(props, '$.summary') END AS summary FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 5 = 0")
def payload_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a payload, null where it is null, broken or has none; each fifth is broken here."""
    e = observations(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 5 == 0, F.substring("payload", 1, 3)).otherwise(F.col("payload")).alias("p"))
    return e.select("event_id", F.get_json_object("p", "$.k").alias("title"), F.get_json_object("p", "$.summary").alias("summary"))


@query("SELECT event_type AS kind, CAST(epoch(TIMESTAMP '2024-03-01 00:00:00') - floor(epoch(MAX(ts))) AS BIGINT) AS age, epoch(TIMESTAMP '2024-03-01 00:00:00') - floor(epoch(MAX(ts))) > 86400 AS stale FROM events GROUP BY 1")
def freshness_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since each kind was last seen, and whether that is too long ago."""
    now = F.unix_timestamp(F.lit("2024-03-01 00:00:00"))
    age = now - F.unix_timestamp(F.max("ts"))
    return observations(spark, sf_dir).groupBy("kind").agg(age.alias("age"), (age > 86400).alias("stale"))


@query(
    """SELECT c_custkey, CASE WHEN abs(c_acctbal * 731) >= 999500 THEN CASE WHEN round(c_acctbal * 731 / 1e6, 1) >= 100 OR c_acctbal * 731 / 1e6 = floor(c_acctbal * 731 / 1e6) THEN printf('%.0f', c_acctbal * 731 / 1e6) ELSE printf('%.1f', c_acctbal * 731 / 1e6) END || 'M'
      WHEN abs(c_acctbal * 731) >= 999.5 THEN CASE WHEN round(c_acctbal * 731 / 1e3, 1) >= 100 OR c_acctbal * 731 / 1e3 = floor(c_acctbal * 731 / 1e3) THEN printf('%.0f', c_acctbal * 731 / 1e3) ELSE printf('%.1f', c_acctbal * 731 / 1e3) END || 'K' ELSE printf('%.0f', c_acctbal * 731) END AS shown FROM customer"""
)
def compact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", E.compact(F.col("c_acctbal") * 731).alias("shown"))


@query(
    """WITH n AS (SELECT o_orderpriority AS kind, COUNT(*) AS n FROM orders GROUP BY 1), r AS (SELECT kind, n, n / 4 AS raw, power(10.0, floor(log10(n / 4))) AS p FROM n)
    SELECT kind, n, 4 * CASE WHEN p >= raw THEN p WHEN 2 * p >= raw THEN 2 * p WHEN 2.5 * p >= raw THEN 2.5 * p WHEN 5 * p >= raw THEN 5 * p ELSE 10 * p END AS top FROM r"""
)
def axis_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("kind", "n", E.axis_top(F.col("n")).alias("top"))


@query(
    r"""WITH m AS (SELECT page_id, regexp_replace(substr(html, 1, 300), '(?i)\b(html)\b', chr(2) || '\1' || chr(3), 'g') AS t FROM pages)
    SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(2), '<mark>'), chr(3), '</mark>') AS shown FROM m"""
)
def marked_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of a page's source as text, a word marked in it."""
    return table(spark, sf_dir, "pages").select("page_id", E.marked(F.substring("html", 1, 300), "html").alias("shown"))


@query(
    """WITH a AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN lower(replace(s_name, '#', '.')) || '@example.org' WHEN 1 THEN '@example.org' WHEN 2 THEN 'no body@example.org' ELSE 'x@example' END AS e FROM supplier) SELECT s_suppkey, s_suppkey % 4 = 0 AS plausible FROM a"""
)
def plausible_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 4
    address = F.when(n == 0, F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit("@example.org"))).when(n == 1, "@example.org").when(n == 2, "no body@example.org").otherwise("x@example")
    return s.select("s_suppkey", E.plausible_email(address).alias("plausible"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(.*)$', 1), '#.*$', '') ELSE url END AS endpoint,
    regexp_matches(url, '^(?i:https)://[^/?#@ :]+(:[0-9]+)?([/?][^# ]*)?$') AND length(url) <= 2048 AS plausible FROM pages"""
)
def plausible_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", E.normal_url(F.col("url")).alias("endpoint"), E.plausible_url(F.col("url")).alias("plausible"))


@query("SELECT * FROM (VALUES (1, 0.0), (2, 0.0), (3, 0.25), (4, 0.5), (5, 1.0)) t(id, wer)")
def word_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text and a reflowed one have no error; a changed, a lost and another text have."""
    rows = [(1, "one two three four", "one two three four"), (2, "one two three four", "ONE two\nthree  four"), (3, "one two three four", "one two tree four"), (4, "one two three four", "one four"), (5, "one two three four", "a b c d")]
    return values(spark, "id int, truth string, output string", rows).select("id", E.word_errors(F.col("truth"), F.col("output")).alias("wer"))


@query(
    """WITH p AS (SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' d/b/a Trader ' || s_nationkey ELSE '' END AS n FROM supplier)
    SELECT s_suppkey, trim(split_part(n, ' d/b/a ', 1)) AS name, NULLIF(trim(split_part(n, ' d/b/a ', 2)), '') AS trades_as FROM p"""
)
def trading_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" d/b/a Trader "), F.col("s_nationkey").cast("string"))).otherwise(""))
    parts = S.doing_business_as(n)
    return s.select("s_suppkey", parts["legal"].alias("name"), parts["trade"].alias("trades_as"))
