"""Rules that small fixtures check, over whole tables: what they need is made of the tables' own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import citations, coverage, entities, graph, readings, sheets
from recordloom.operators import workflow as W
from recordloom.plans.catalogue import query
from recordloom.sources import files, html
from recordloom.tables import observations, spread, table


def _text(name: str):
    return F.col(name).cast("string")


@query(
    """SELECT o_orderkey AS document, CAST(o_orderkey % 9 AS BIGINT) AS page, 'FD ' || (30000 + o_custkey) AS key FROM orders UNION ALL SELECT o_orderkey, CAST(o_orderkey % 9 AS BIGINT), 'EP ' || (400 + o_orderkey % 90) || ' (' || (1 + o_orderkey % 7) || ')' FROM orders WHERE o_orderstatus = 'F'"""
)
def citations_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Docket numbers on a page for each order, some with a sub-number; one finding a key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    main = F.concat(F.lit("FD "), (F.col("o_custkey") + 30000).cast("string"))
    sub = F.concat(F.lit("; EP "), (400 + F.col("o_orderkey") % 90).cast("string"), F.lit(" (Sub-No. "), (1 + F.col("o_orderkey") % 7).cast("string"), F.lit(")"))
    line = F.concat(F.lit("See "), main, F.when(F.col("o_orderstatus") == "F", sub).otherwise(""), F.lit(", slip op. at 3. Again "), main, F.lit("."))
    pages = o.select(F.col("o_orderkey").alias("document"), (F.col("o_orderkey") % 9).cast("long").alias("page"), line.alias("text"), F.array().cast("array<string>").alias("own"))
    return citations.find_citations(spread(pages)).select("document", F.col("page").cast("long").alias("page"), "key")


_KEYS = "SELECT o_orderkey AS document, 'FD ' || (o_custkey * 10 + o_orderkey % 3) AS key FROM orders"


@query(
    f"""WITH k AS ({_KEYS}), g AS (SELECT 'FD ' || c_custkey AS key, c_custkey AS id FROM customer WHERE c_custkey % 2 = 0)
    SELECT document, k.key, coalesce(a.id, CASE WHEN length(k.key) = 8 THEN b.id END) AS docket_id, CASE WHEN a.id IS NOT NULL THEN 'held' WHEN length(k.key) = 8 AND b.id IS NOT NULL THEN 'repaired' ELSE 'unresolved' END AS rule
    FROM k LEFT JOIN g a ON a.key = k.key LEFT JOIN g b ON b.key = substr(k.key, 1, length(k.key) - 1)"""
)
def keys_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held numbers, five digits that are held without the last, and the rest."""
    o = table(spark, sf_dir, "orders")
    keys = o.select(F.col("o_orderkey").alias("document"), F.concat(F.lit("FD "), (F.col("o_custkey") * 10 + F.col("o_orderkey") % 3).cast("string")).alias("key"))
    registry = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("FD "), _text("c_custkey")).alias("key"), F.col("c_custkey").alias("docket_id"))
    return citations.resolve(keys, registry).select("document", "key", "docket_id", "rule")


@query("SELECT l_suppkey AS docket_id, strftime(l_shipdate, '%Y-%m-%d') AS served, MIN(l_orderkey) AS decision_id FROM lineitem GROUP BY 1, l_shipdate HAVING COUNT(DISTINCT l_orderkey) = 1")
def unambiguous_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("docket_id"), F.col("l_shipdate").alias("served"), F.col("l_orderkey").alias("decision_id"))
    return citations.works(line).withColumn("served", F.date_format("served", "yyyy-MM-dd"))


@query("SELECT 'FD ' || (p_size * 100) AS key, COUNT(*) AS n FROM part GROUP BY 1 HAVING COUNT(*) > 1")
def registry_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.duplicate_keys(table(spark, sf_dir, "part").select(F.concat(F.lit("FD "), (F.col("p_size") * 100).cast("string")).alias("key")))


@query(
    """SELECT s_suppkey AS cell, 1 AS nth, s_name || ', Inc.' AS party, 'party' AS role FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 2, 'Party of ' || n_name, 'party' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0
    UNION ALL SELECT s_suppkey, 1, s_name || ' LLC', 'representative' FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 2, 'City of ' || n_name, 'principal' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 1"""
)
def party_cells_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of names as printed, cut into parties with their roles."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"))
    listed = F.concat("s_name", F.lit(", Inc.; Party of "), "n_name")
    behalf = F.concat("s_name", F.lit(" LLC on behalf of City of "), "n_name")
    cells = s.select(F.col("s_suppkey").alias("cell"), F.when(F.col("s_suppkey") % 2 == 0, listed).otherwise(behalf).alias("printed"))
    cut = entities.cut_cells(cells, "printed").select("cell", F.posexplode("spans").alias("nth", "s"))
    return cut.select("cell", (F.col("nth") + 1).alias("nth"), F.col("s.text").alias("party"), F.col("s.role").alias("role"))


@query(
    """WITH r AS (SELECT s_suppkey AS party, MIN(s_suppkey) OVER (PARTITION BY s_nationkey) AS rep FROM supplier), n AS (SELECT s_suppkey AS party, s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'display' WHEN 1 THEN 'legal' WHEN 2 THEN 'as_filed' ELSE 'alias' END AS kind, s_name AS name FROM supplier)
    SELECT rep, name AS display_name FROM n JOIN r USING (party) QUALIFY ROW_NUMBER() OVER (PARTITION BY rep ORDER BY CASE kind WHEN 'display' THEN 0 WHEN 'legal' THEN 1 WHEN 'as_filed' THEN 2 ELSE 3 END, CASE WHEN kind = 'alias' THEN id ELSE -id END) = 1"""
)
def component_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name a component: display before legal before as filed, the newest of its kind."""
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 4
    kind = F.when(n == 0, "display").when(n == 1, "legal").when(n == 2, "as_filed").otherwise("alias")
    names = s.select(F.col("s_suppkey").alias("party_id"), F.col("s_suppkey").alias("name_id"), kind.alias("kind"), F.col("s_name").alias("name"))
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("b"))
    edges = s.join(first, "s_nationkey").select(F.col("s_suppkey").alias("a"), "b")
    return entities.display_names(names, entities.represented(names.select("party_id"), edges))


@query(
    """SELECT c_custkey AS span, CASE WHEN c_nationkey % 3 = 0 THEN 'linked' WHEN c_nationkey % 3 = 1 THEN 'ambiguous' WHEN c_custkey % 2 = 0 OR EXISTS (SELECT 1 FROM customer d WHERE d.c_nationkey = customer.c_nationkey AND d.c_custkey % 2 = 0) THEN 'minted' ELSE 'left' END AS outcome, CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey END AS rep FROM customer"""
)
def spans_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed names against known ones: borne by one component, by two, or by none."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    spans = c.select(F.col("c_custkey").alias("span"), F.concat(F.lit("Firm No. "), _text("c_nationkey"), F.lit(", Incorporated")).alias("text"), F.when(F.col("c_custkey") % 2 == 0, 1.0).otherwise(0.5).alias("confidence"), "c_nationkey")
    named = n.where("n_nationkey % 3 < 2").select(F.col("n_nationkey").alias("party_id"), F.concat(F.lit("FIRM NO "), _text("n_nationkey"), F.lit(" Inc")).alias("name"))
    twice = named.where("party_id % 3 = 1").withColumn("party_id", F.col("party_id") + 100)
    every = named.unionByName(twice)
    return entities.resolve(spans, every, every.select("party_id", F.col("party_id").alias("rep"))).select("span", "outcome", "rep")


@query("SELECT c_custkey AS capture, c_nationkey AS nth, 'FD_' || c_custkey AS docket, c_name AS title, c_custkey % 10 = 3 AS skipped FROM customer")
def envelope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of captured tables, cell by cell; a row whose anchor names another docket than it prints is skipped."""
    key = F.concat(F.lit("FD_"), _text("c_custkey"))
    printed = F.when(F.col("c_custkey") % 10 == 3, "FD 0").otherwise(F.concat(F.lit("FD&nbsp;"), _text("c_custkey")))
    row = F.concat(F.lit('<tr><td><a data-stb-id="'), key, F.lit('|1">x</a></td><td>'), printed, F.lit("</td><td> <b>"), F.col("c_name"), F.lit("</b></td></tr>"))
    body = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(row.alias("rows"), F.lit(1).alias("total")).alias("data")))
    captured = html.envelope(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("capture"), F.col("c_nationkey").alias("nth"), key.alias("docket"), body.alias("body")), "body")
    cells = html.rows(captured.where("ok").select("capture", "nth", "docket", F.col("rows").alias("fragment")), "fragment")
    return html.parsed(cells, {"title": 2}, 3, (0, 1)).select("capture", "nth", "docket", "title", "skipped")


@query("SELECT conv_id AS document, turn + 1 AS page, trim(text) AS text FROM conversations WHERE NOT contains(text, '=====')")
def pages_of_marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as one text with a mark before each page, and cut into pages again."""
    c = table(spark, sf_dir, "conversations").where("not contains(text, '=====')")
    page = F.concat(F.lit("===== page "), (F.col("turn") + 1).cast("string"), F.lit(" =====\n"), F.trim("text"), F.lit("\n"))
    whole = c.groupBy(F.col("conv_id").alias("document")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: x["p"]), "").alias("text"))
    return files.marked_pages(whole, "document", "text").select("document", "page", F.regexp_replace("text", "\n$", "").alias("text"))


@query(
    """WITH m AS (SELECT o_orderpriority AS a, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders GROUP BY 1, 2), s AS (SELECT a, CAST(UNNEST(generate_series(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT DISTINCT a FROM m))
    SELECT lower(substr(s.a, 3, 3)) AS action, strftime(s.month, '%Y-%m') AS month, day(last_day(s.month)) - coalesce(n, 0) AS missing_days FROM s LEFT JOIN m ON s.a = m.a AND s.month = m.month WHERE day(last_day(s.month)) - coalesce(n, 0) > 0"""
)
def months_not_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of one day each, from the days that orders came: the months of a year that they leave open."""
    o = table(spark, sf_dir, "orders").select(F.lower(F.substring("o_orderpriority", 3, 3)).alias("a"), F.to_date("o_orderdate").alias("d"))
    key = F.format_string("%s:%s[%d..%d]", "a", F.date_format("d", "yyyy-MM"), F.day("d"), F.day("d"))
    asked = coverage.asked_days(o.select(key.alias("slice_key"), F.lit("done").alias("status")).distinct())
    first, last = F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1996-12-01"))
    return coverage.incomplete_months(asked, first, last).select("action", F.date_format("month", "yyyy-MM").alias("month"), "missing_days")


@query(
    """WITH g AS (SELECT s_suppkey AS gap_id, DATE '2024-01-01' + CAST(s_suppkey % 50 AS INTEGER) AS s, CASE WHEN s_suppkey % 10 <> 0 THEN DATE '2024-01-01' + CAST(s_suppkey % 50 + s_suppkey % 15 AS INTEGER) END AS e FROM supplier)
    SELECT gap_id, COUNT(*) AS days FROM (SELECT gap_id, UNNEST(generate_series(s, coalesce(e - 6, DATE '2024-03-01'), INTERVAL 1 DAY)) FROM g WHERE coalesce(e - 6, DATE '2024-03-01') >= s) GROUP BY 1"""
)
def shadowed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many days each gap leaves in doubt."""
    start = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("s_suppkey") % 50).cast("int"))
    end = F.when(F.col("s_suppkey") % 10 != 0, F.date_add(start, (F.col("s_suppkey") % 15).cast("int")))
    gaps = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gap_id"), start.cast("timestamp").alias("started_at"), end.cast("timestamp").alias("ended_at"), F.lit("captures").alias("failure"))
    return coverage.gap_shadows(gaps, F.to_date(F.lit("2024-03-01"))).groupBy("gap_id").agg(F.count(F.lit(1)).alias("days"))


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS slice, CAST(SUM(n) AS BIGINT) AS "rows", CASE WHEN SUM(n) = 0 AND MAX(t) = 0 THEN 'empty' WHEN MAX(t) >= 20 THEN 'capped' WHEN SUM(n) = MAX(t) THEN 'done' ELSE 'partial' END AS verdict FROM (SELECT o_custkey, o_orderkey % 4 AS n, o_custkey % 25 AS t FROM orders) GROUP BY 1"""
)
def walked_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(_text("o_custkey").alias("slice"), (F.col("o_orderkey") % 4).alias("rows"), (F.col("o_custkey") % 25).alias("total"))
    return W.slice_verdict(o, "slice", 20)


@query(
    """WITH o AS (SELECT 'FD_' || c_custkey || CASE WHEN c_nationkey % 2 = 0 THEN '_1' ELSE '' END AS d FROM customer), e AS (SELECT d AS docket, 'observed' AS source FROM o UNION ALL SELECT regexp_extract(d, '^([^_]+_[^_]+)_', 1), 'inferred' FROM o WHERE regexp_matches(d, '^[^_]+_[^_]+_'))
    SELECT docket, MAX(source) AS source FROM e WHERE docket NOT IN (SELECT 'FD_' || c_custkey FROM customer WHERE c_custkey % 5 = 0) GROUP BY 1"""
)
def dockets_minted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    own = F.concat(F.lit("FD_"), _text("c_custkey"))
    seen = c.select(F.concat(own, F.when(F.col("c_nationkey") % 2 == 0, "_1").otherwise("")).alias("docket"))
    return W.minted_parents(seen, c.where("c_custkey % 5 = 0").select(own.alias("docket")))


_SUBS = """d AS (SELECT c_custkey AS docket_id, CASE WHEN c_custkey >= 10 THEN c_custkey // 10 END AS parent_id, CASE WHEN c_nationkey % 4 <> 0 THEN 'Caption ' || (c_nationkey % 3) END AS caption FROM customer WHERE c_custkey > 0)"""


@query(
    f"""WITH {_SUBS} SELECT d.docket_id, CASE WHEN d.parent_id IS NULL OR (d.caption IS NOT NULL AND d.caption IS DISTINCT FROM p.caption) THEN d.docket_id ELSE d.parent_id END AS proceeding_id, CASE WHEN d.parent_id IS NULL OR d.docket_id % 2 = 0 THEN d.docket_id ELSE d.parent_id END AS target
    FROM d LEFT JOIN d p ON d.parent_id = p.docket_id"""
)
def proceedings_and_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which proceeding shows a docket's records, and what a subscription to it follows."""
    c = table(spark, sf_dir, "customer").where("c_custkey > 0")
    d = c.select(F.col("c_custkey").alias("docket_id"), F.when(F.col("c_custkey") >= 10, F.floor(F.col("c_custkey") / 10)).alias("parent_id"), F.when(F.col("c_nationkey") % 4 != 0, F.concat(F.lit("Caption "), (F.col("c_nationkey") % 3).cast("string"))).alias("caption"))
    prefix = F.when(F.col("docket_id") % 2 == 0, "AB").otherwise("FD")
    targets = d.select("docket_id", W.followed(prefix, F.col("docket_id"), F.col("parent_id")).alias("target"))
    return W.proceeding(d).join(targets, "docket_id")


@query(
    """WITH RECURSIVE s AS (SELECT s_suppkey AS origin, s_suppkey AS party, 0 AS steps FROM supplier WHERE s_suppkey % 20 = 0 UNION ALL SELECT origin, party + 7, steps + 1 FROM s WHERE party + 7 <= (SELECT MAX(s_suppkey) FROM supplier))
    SELECT origin, party, steps FROM s WHERE steps > 0"""
)
def successors_walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every twentieth party became, step by step."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("party"))
    edges = s.select(F.col("party").alias("a"), (F.col("party") + 7).alias("b")).join(s, F.col("b") == F.col("party"), "left_semi")
    return graph.successors(edges, s.where("party % 20 = 0"))


@query(
    f"""WITH {_SUBS}, w AS (SELECT o_orderkey AS work_id, o_custkey AS docket_id FROM orders WHERE o_orderstatus = 'P' AND o_custkey > 0)
    SELECT work_id, docket_id FROM w UNION SELECT work_id, d.docket_id FROM w JOIN d ON d.parent_id = w.docket_id UNION SELECT work_id, d.parent_id FROM w JOIN d ON d.docket_id = w.docket_id WHERE d.parent_id IS NOT NULL"""
)
def closures_of_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work's docket, its children and its parent."""
    d = table(spark, sf_dir, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("docket_id"), F.when(F.col("c_custkey") >= 10, F.floor(F.col("c_custkey") / 10)).alias("parent_id"))
    w = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_custkey > 0").select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("docket_id"))
    return graph.family_closure(d, w)


@query(
    """WITH e AS (SELECT event_id AS document, user_id % 5 AS page, event_type AS route, ts FROM events) SELECT document, CAST(page AS BIGINT) AS page, CASE WHEN document % 3 = 0 THEN 'asserted' WHEN document % 3 = 1 THEN 'unchanged' WHEN page < 2 THEN 'stale' ELSE 'superseded' END AS outcome FROM e"""
)
def routes_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming routes against held ones: none held, the same, a newer other, an older other."""
    e = observations(spark, sf_dir).select(F.col("event_id").alias("document"), (F.col("key") % 5).alias("page"), F.col("kind").alias("route"), F.col("ts").alias("routed_at"))
    later = F.when(F.col("page") < 2, F.col("routed_at") + F.expr("interval 1 day")).otherwise(F.col("routed_at") - F.expr("interval 1 day"))
    held = e.where("document % 3 > 0").select("document", "page", F.when(F.col("document") % 3 == 1, F.col("route")).otherwise("other").alias("route"), later.alias("routed_at"))
    return readings.routed_load(held, e)


@query(
    """SELECT o_orderkey AS document, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown_document' WHEN o_orderkey % 5 = 0 THEN 'asserted' WHEN o_orderkey % 3 = 0 THEN 'unchanged' WHEN o_orderkey % 2 = 0 THEN 'human_held' ELSE 'superseded' END AS outcome FROM orders"""
)
def paginations_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document"), (F.col("o_orderkey") % 40 + 1).alias("page_count"))
    live = o.where("document % 5 <> 0").select("document", F.when(F.col("document") % 3 == 0, F.col("page_count")).otherwise(F.col("page_count") + 1).alias("page_count"), (F.col("document") % 2 == 0).alias("human"))
    return readings.paginated(live, o, o.where("document % 7 <> 0"))


@query(
    """SELECT conv_id AS document, turn AS page, 'primary' AS role, CASE WHEN turn % 4 = 0 THEN 'asserted' WHEN turn % 4 = 1 THEN 'unchanged' WHEN turn % 4 = 2 THEN 'superseded' ELSE 'refused' END AS outcome FROM conversations"""
)
def readings_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming readings against held ones: nothing held, the same, another text, the key live in another role."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("page"), F.md5("text").alias("key"), "text")
    new = c.select("document", "page", F.lit("primary").alias("role"), "key", "text", F.lit(0.0).alias("agreement"))
    n = F.col("page") % 4
    held = new.where(n == 1).unionByName(new.where(n == 2).withColumn("text", F.lit("another"))).unionByName(new.where(n == 3).withColumn("role", F.lit("second")))
    return readings.loaded(held, new)


@query(
    f"""WITH {_SUBS}, f AS (SELECT docket_id, coalesce(parent_id, docket_id) AS family FROM d) SELECT o_orderkey AS document, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT 'FD ' || b.docket_id AS k FROM f a JOIN f b ON a.family = b.family WHERE a.docket_id = o_custkey)) AS own FROM orders WHERE o_orderstatus = 'P' AND o_custkey > 0"""
)
def own_sets_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a document's own family."""
    d = table(spark, sf_dir, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("docket_id"), F.when(F.col("c_custkey") >= 10, F.floor(F.col("c_custkey") / 10)).alias("parent_id"), F.concat(F.lit("FD "), _text("c_custkey")).alias("key"))
    carriers = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_custkey > 0").select(F.col("o_orderkey").alias("document"), F.col("o_custkey").alias("docket_id"))
    return readings.own_sets(carriers, d).select("document", F.array_join("own", ",").alias("own"))


@query(
    """SELECT o_orderpriority AS class, round(COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) / NULLIF(COUNT(*), 0), 4) AS recall, round(COUNT(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 1 END) / NULLIF(COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END), 0), 4) AS precision FROM orders GROUP BY 1"""
)
def class_scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("o_orderstatus") == "F"
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("class")).agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(found).alias("found"), F.count_if(found).alias("shown"), F.count_if(found & (F.col("o_totalprice") > 100000)).alias("right")
    )
    return readings.scorecard(counts)


@query(
    """WITH t AS (SELECT conv_id, turn, substr(text, 1, 60) AS a, replace(substr(text, 1, 60), 'e', 'c') AS b FROM conversations) SELECT conv_id, turn, round(CASE WHEN length(a) = 0 THEN 0 ELSE least(1, levenshtein(a, b) / length(a)) END, 6) AS cer, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 0 ELSE levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS share FROM t WHERE regexp_matches(a, '^[ -~]*$')"""
)
def misread_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading that takes every e for a c, against the text."""
    a = F.substring("text", 1, 60)
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", a.alias("a"), F.replace(a, F.lit("e"), F.lit("c")).alias("b")).where(F.col("a").rlike(r"^[ -~]*\z"))
    return t.select("conv_id", "turn", F.round(S.character_error(F.col("a"), F.col("b")), 6).alias("cer"), F.round(S.distance_share(F.col("a"), F.col("b")), 6).alias("share"))


@query(
    """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'railroad' WHEN 1 THEN 'government' WHEN 2 THEN 'labor' WHEN 3 THEN 'association' WHEN 4 THEN 'company' ELSE 'individual' END AS party_type FROM supplier"""
)
def types_of_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.element_at(F.array(*map(F.lit, ["Railway Co", "City Authority", "Union", "Association, Inc.", "Co.", ""])), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", sheets.party_type(F.concat_ws(" ", "s_name", ends)).alias("party_type"))


@query(
    """WITH r AS (SELECT l_orderkey AS page, CASE WHEN l_linenumber = 7 THEN 'table' WHEN l_returnflag = 'R' THEN 'figure' ELSE 'text' END AS kind, CASE WHEN l_orderkey % 50 = 0 THEN 0 ELSE l_quantity END AS area FROM lineitem)
    SELECT page, CASE WHEN SUM(area) = 0 THEN 'blank' WHEN COUNT(CASE WHEN kind = 'table' THEN 1 END) > 0 THEN 'tabular' WHEN SUM(CASE WHEN kind = 'figure' THEN area ELSE 0 END) / SUM(area) >= 0.5 THEN 'graphic' ELSE 'text' END AS route FROM r GROUP BY 1"""
)
def routes_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") == 7, "table").when(F.col("l_returnflag") == "R", "figure").otherwise("text")
    area = F.when(F.col("l_orderkey") % 50 == 0, 0.0).otherwise(F.col("l_quantity").cast("double"))
    return sheets.routed(line.select(F.col("l_orderkey").alias("page"), kind.alias("kind"), area.alias("area")), ["page"])


@query(
    """SELECT label, COUNT(*) AS n FROM (SELECT CASE WHEN event_type = 'click' THEN 'read by a person' WHEN event_type = 'view' THEN 'the document''s own text' WHEN value > 90 THEN 'machine reading, not compared' WHEN value / 100 <= 0.05 THEN 'machine reading, two agree' ELSE 'machine reading, two differ' END AS label FROM events) GROUP BY 1"""
)
def labels_of_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = F.when(F.col("kind") == "click", "human").when(F.col("kind") == "view", "text-layer").otherwise("ocr")
    agreement = F.when(F.col("value") <= 90, F.col("value") / 100)
    return observations(spark, sf_dir).groupBy(sheets.reading_label(channel, agreement).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS served, strftime(o_orderdate, '%Y-%m-%d') AS decided FROM orders")
def dates_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page that names one served date, or two, and says when it was decided on the line below the word."""
    d = F.date_format("o_orderdate", "MMMM d, yyyy")
    second = F.when(F.col("o_orderkey") % 3 == 0, " and served January 1, 1970").otherwise("")
    page = F.concat(F.lit("Notice served "), d, second, F.lit("\n Decided:\n  "), d, F.lit("\n"))
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), sheets.served_date(page).alias("s"), sheets.decided_dates(page).alias("x"))
    return found.select("id", F.date_format("s", "yyyy-MM-dd").alias("served"), F.date_format(F.get("x", F.lit(0)), "yyyy-MM-dd").alias("decided"))


@query(
    """SELECT c_custkey AS q, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 4 = 2 AND c_custkey % 10 <> 0 THEN 'FD_' || c_custkey ELSE 'FD_' || c_custkey || CASE WHEN c_custkey % 4 = 2 THEN '_1' ELSE '' END END AS docket FROM customer"""
)
def typed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as people type them: the docket, or its family where the sub-number is not held, or words too."""
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    own = F.concat(F.lit("FD_"), _text("c_custkey"))
    typed = F.when(n == 0, F.concat(F.lit("Docket No. fd "), _text("c_custkey"))).when(n == 1, F.concat(F.lit("FD-"), _text("c_custkey"))).when(n == 2, F.concat(F.lit("FD "), _text("c_custkey"), F.lit(" (Sub-No. 1)"))).otherwise(F.concat(F.lit("merger of FD "), _text("c_custkey")))
    registry = c.select(own.alias("docket")).unionByName(c.where("c_custkey % 10 = 0").select(F.concat(own, F.lit("_1")).alias("docket")))
    return sheets.looked_up(c.select(F.col("c_custkey").alias("q"), typed.alias("typed")), "typed", registry).select("q", "docket")


@query("SELECT o_custkey AS docket_id, strftime(MAX(CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END), '%Y-%m-%d') AS latest FROM orders WHERE o_orderdate <= DATE '1999-12-31' GROUP BY 1")
def latest_printed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest printed date that parses and isn't in the future; each ninth prints an impossible day."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("docket_id"), "o_orderkey", "o_orderdate")
    cell = F.when(F.col("o_orderkey") % 9 == 0, "2/31/1998").otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    dated = o.where("o_orderdate <= date'1999-12-31'").select("docket_id", S.written_date(cell).alias("d"))
    return dated.groupBy("docket_id").agg(F.date_format(F.max("d"), "yyyy-MM-dd").alias("latest"))
