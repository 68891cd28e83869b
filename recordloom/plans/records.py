"""Queries over records and proceedings, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import counting, folding, ledger
from recordloom.operators.ranges import running_sum
from recordloom.plans.catalogue import query
from recordloom.storage import save
from recordloom.tables import decision_copies, filings, observations, table

_FILINGS = "SELECT o_orderkey AS filing_id, o_orderpriority AS filing_type, CAST(o_orderdate AS DATE) AS filed, c_custkey AS docket_id, c_nationkey AS family_id FROM orders JOIN customer ON o_custkey = c_custkey"
_COPIES = "SELECT l_orderkey AS decision_id, l_suppkey AS docket_id, n_nationkey AS family_id, n_name AS family, n_regionkey AS region_id, l_returnflag AS decision_type, CAST(l_shipdate AS DATE) AS served, l_partkey, l_linenumber, l_extendedprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"


def _iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


@query(
    f"""WITH f AS ({_FILINGS}), n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
    SELECT filing_type, COUNT(DISTINCT filing_id) AS records, COUNT(DISTINCT docket_id) AS proceedings,
      strftime(MIN(filed), '%Y-%m-%d') AS first_date, strftime(MAX(filed), '%Y-%m-%d') AS last_date
    FROM f JOIN n ON family_id = n_nationkey WHERE filed BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY filing_type"""
)
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey")
    f = filings(spark, sf_dir).where(F.col("filed").between("1996-01-01", "1998-12-31"))
    scoped = f.join(F.broadcast(nations), f["family_id"] == nations["n_nationkey"], "left_semi")  # 25 nations in all
    n = counting.count_records(scoped, ["filing_type"], "filing_id", "docket_id", "filed")
    return n.withColumns({"first_date": _iso("first_date"), "last_date": _iso("last_date")})


@query(
    """WITH t AS (SELECT DISTINCT o_orderpriority AS filing_type FROM orders WHERE contains(lower(o_orderpriority), 'high'))
    SELECT filing_type FROM t WHERE lower(filing_type) = 'high' OR NOT EXISTS (SELECT 1 FROM t u WHERE lower(u.filing_type) = 'high')"""
)
def type_match_exact_else_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("filing_type")).distinct()
    return counting.match_types(types, "filing_type", "High")


@query(
    f"""WITH f AS ({_FILINGS}) SELECT docket_id, CAST(SUM(CASE WHEN filing_type = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS n_a,
      CAST(SUM(CASE WHEN filing_type = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS n_b, COUNT(DISTINCT filing_id) AS n
    FROM f GROUP BY docket_id HAVING n_a > 0 AND n_b > 0 AND COUNT(DISTINCT filing_id) > 1"""
)
def pair_both_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.holders_of_both(filings(spark, sf_dir), "docket_id", "filing_type", "filing_id", "1-URGENT", "2-HIGH")


@query(
    f"""WITH f AS ({_FILINGS}), g AS (SELECT docket_id, MAX(filed) AS latest, COUNT(*) AS n FROM f GROUP BY docket_id HAVING COUNT(*) > 1),
    p AS (SELECT * FROM g ORDER BY latest DESC, docket_id DESC LIMIT 25 OFFSET 25),
    r AS (SELECT f.docket_id, f.filing_id, f.filed, ROW_NUMBER() OVER (PARTITION BY f.docket_id ORDER BY filed DESC, filing_id DESC) AS nth FROM f JOIN p USING (docket_id))
    SELECT p.docket_id, strftime(p.latest, '%Y-%m-%d') AS latest, p.n, r.nth, r.filing_id FROM p JOIN r USING (docket_id) WHERE nth <= 6"""
)
def list_proceedings_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = filings(spark, sf_dir)
    groups = f.groupBy("docket_id").agg(F.max("filed").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    page = F.broadcast(groups.orderBy(F.desc("latest"), F.desc("docket_id")).offset(25).limit(25))  # 25 rows
    top = folding.top_in_group(f.join(page, "docket_id"), ["docket_id"], [F.desc("filed"), F.desc("filing_id")], 6)
    return top.select("docket_id", _iso("latest").alias("latest"), "n", "nth", "filing_id")


@query(
    f"""WITH f AS ({_FILINGS}), g AS (SELECT family_id, COUNT(DISTINCT filing_id) AS records, MAX(filed) AS last FROM f GROUP BY family_id)
    SELECT n_nationkey AS family_id, n_name AS family, COALESCE(records, 0) AS records, strftime(last, '%Y-%m-%d') AS last_date FROM nation LEFT JOIN g ON n_nationkey = family_id"""
)
def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = filings(spark, sf_dir).groupBy("family_id").agg(F.countDistinct("filing_id").alias("records"), F.max("filed").alias("last"))
    n = table(spark, sf_dir, "nation")
    return n.join(g, n["n_nationkey"] == g["family_id"], "left").select(
        F.col("n_nationkey").alias("family_id"), F.col("n_name").alias("family"), F.coalesce("records", F.lit(0)).cast("long").alias("records"), _iso("last").alias("last_date")
    )


@query(
    f"""WITH f AS ({_FILINGS}) SELECT n_name AS family, COUNT(DISTINCT filing_id) AS records FROM f JOIN nation ON family_id = n_nationkey
    WHERE year(filed) = 1997 GROUP BY n_name ORDER BY records DESC, family LIMIT 10"""
)
def busiest_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = filings(spark, sf_dir).where(F.col("filed").between("1997-01-01", "1997-12-31"))
    n = f.groupBy("family_id").agg(F.countDistinct("filing_id").alias("records"))
    named = n.join(table(spark, sf_dir, "nation"), F.col("family_id") == F.col("n_nationkey")).select(F.col("n_name").alias("family"), "records")
    return counting.top_groups(named, "records", "family")


@query(
    """SELECT p_brand AS prefix, COUNT(DISTINCT p_partkey) AS parts, COUNT(DISTINCT l_orderkey) AS records, MIN(p_size) AS least, MAX(p_size) AS most
    FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand"""
)
def by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    held = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    return p.join(held, p["p_partkey"] == held["l_partkey"], "left").groupBy(F.col("p_brand").alias("prefix")).agg(
        F.countDistinct("p_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("records"), F.min("p_size").alias("least"), F.max("p_size").alias("most")
    )


@query("SELECT NULLIF(l_returnflag, 'N') AS body, COUNT(DISTINCT l_orderkey) AS records, COUNT(*) AS entries FROM lineitem GROUP BY 1")
def by_body_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey")
    return line.groupBy(F.nullif("l_returnflag", F.lit("N")).alias("body")).agg(F.countDistinct("l_orderkey").alias("records"), F.count(F.lit(1)).alias("entries"))


@query(
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, 1 AS o, 0 AS l FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE), 0, 1 FROM lineitem),
    s AS (SELECT CAST(UNNEST(generate_series(date_trunc('month', MIN(d)), date_trunc('month', MAX(d)), INTERVAL 1 MONTH)) AS DATE) AS month FROM d),
    c AS (SELECT CAST(date_trunc('month', d) AS DATE) AS month, SUM(o) AS o, SUM(l) AS l FROM d GROUP BY 1)
    SELECT strftime(s.month, '%Y-%m') AS month, CAST(COALESCE(o, 0) AS BIGINT) AS filings, CAST(COALESCE(l, 0) AS BIGINT) AS decisions,
      CAST(SUM(COALESCE(o, 0)) OVER (PARTITION BY year(s.month)) AS BIGINT) AS filings_in_year FROM s LEFT JOIN c ON s.month = c.month"""
)
def months_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    line = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    m = counting.dense_months({"filings": (o, "d"), "decisions": (line, "d")})
    years = m.groupBy(F.year("month").alias("y")).agg(F.sum("filings").alias("filings_in_year"))
    return m.join(years, F.year("month") == F.col("y")).select(F.date_format("month", "yyyy-MM").alias("month"), "filings", "decisions", "filings_in_year")


@query(
    """WITH o AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, COUNT(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1),
    l AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS monday, COUNT(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
    SELECT strftime(COALESCE(o.monday, l.monday), '%Y-%m-%d') AS monday, COALESCE(o.n, 0) AS filings, COALESCE(l.n, 0) AS decisions FROM o FULL JOIN l ON o.monday = l.monday"""
)
def weeks_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(S.monday(F.to_date("o_orderdate")).alias("monday")).agg(F.countDistinct("o_orderkey").alias("filings"))
    line = table(spark, sf_dir, "lineitem").groupBy(S.monday(F.to_date("l_shipdate")).alias("monday")).agg(F.countDistinct("l_orderkey").alias("decisions"))
    return o.join(line, "monday", "full").select(
        _iso("monday").alias("monday"), F.coalesce("filings", F.lit(0)).cast("long").alias("filings"), F.coalesce("decisions", F.lit(0)).cast("long").alias("decisions")
    )


@query(
    """WITH c AS (SELECT year(l_shipdate) AS y, COUNT(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT y, n, MIN(n) OVER (ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > (SELECT AVG(n) / 2 FROM c) AS ok FROM c)
    SELECT CAST(y AS INTEGER) AS y, n FROM m WHERE y <= COALESCE((SELECT MIN(y) FROM m WHERE ok), 9999)"""
)
def dense_year_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    half = c.agg((F.avg("n") / 2).alias("h")).first()["h"] or 0  # a row for each year
    return counting.dense_from(c, "y", "n", half)


@query(
    f"""WITH c AS ({_COPIES}), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY decision_id ORDER BY region_id, family_id, docket_id, l_partkey, l_linenumber, served, l_extendedprice) AS k FROM c)
    SELECT decision_id, docket_id, family, decision_type, strftime(served, '%Y-%m-%d') AS served FROM r WHERE k = 1"""
)
def headline_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("region_id", "family_id", "docket_id", "l_partkey", "l_linenumber", "served", "l_extendedprice")]
    near = folding.headline(decision_copies(spark, sf_dir), ["decision_id"], order)
    return near.select("decision_id", "docket_id", "family", "decision_type", _iso("served").alias("served"))


@query(
    f"""WITH c AS ({_COPIES}), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY decision_id ORDER BY region_id, family_id, docket_id, l_partkey, l_linenumber, served, l_extendedprice) AS k FROM c),
    h AS (SELECT decision_id, family FROM r WHERE k = 1)
    SELECT h.decision_id, h.family, COALESCE((SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT family AS f FROM c WHERE c.decision_id = h.decision_id AND c.family <> h.family) x), '') AS also_in FROM h"""
)
def record_fold_also_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("region_id", "family_id", "docket_id", "l_partkey", "l_linenumber", "served", "l_extendedprice")]
    return folding.with_also_in(decision_copies(spark, sf_dir), "decision_id", "family", order).select("decision_id", "family", "also_in")


@query(
    f"""WITH f AS ({_FILINGS}) SELECT docket_id, filing_id, LAG(filing_id) OVER w AS previous, LEAD(filing_id) OVER w AS following FROM f
    WINDOW w AS (PARTITION BY docket_id ORDER BY filed DESC, filing_id DESC)"""
)
def sheet_order_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = folding.neighbours(filings(spark, sf_dir), ["docket_id"], [F.desc("filed"), F.desc("filing_id")], "filing_id")
    return sheet.select("docket_id", "filing_id", "previous", "following")


@query(
    """WITH u AS (SELECT 'filing' AS kind, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT 'decision', l_orderkey, CAST(l_shipdate AS DATE) FROM lineitem)
    SELECT kind, COUNT(DISTINCT id) AS records, COUNT(*) AS entries, strftime(MIN(d), '%Y-%m-%d') AS first_date, strftime(MAX(d), '%Y-%m-%d') AS last_date FROM u
    WHERE d BETWEEN DATE '1997-03-01' AND DATE '1997-05-31' GROUP BY kind"""
)
def activity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.lit("filing").alias("kind"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    line = table(spark, sf_dir, "lineitem").select(F.lit("decision").alias("kind"), F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("d"))
    inside = o.unionByName(line).where(F.col("d").between("1997-03-01", "1997-05-31"))
    return inside.groupBy("kind").agg(
        F.countDistinct("id").alias("records"), F.count(F.lit(1)).alias("entries"), _iso_agg("min"), _iso_agg("max")
    )


def _iso_agg(end: str):
    return F.date_format(getattr(F, end)("d"), "yyyy-MM-dd").alias({"min": "first_date", "max": "last_date"}[end])


@query(
    """SELECT o_orderkey AS filing_id, source, nth FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY o_totalprice DESC, o_orderkey) AS nth
    FROM (SELECT o_orderkey, o_totalprice, o_orderstatus AS source FROM orders)) ORDER BY nth, source LIMIT 20"""
)
def fair_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("filing_id"), "o_totalprice", F.col("o_orderstatus").alias("source"))
    return folding.round_robin(o, "source", [F.desc("o_totalprice"), F.asc("filing_id")], 20).select("filing_id", "source", "nth")


@query(
    """SELECT c_custkey AS docket_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"""
)
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("docket_id")), table(spark, sf_dir, "orders")
    held = o.where("o_orderstatus = 'F'").select("o_custkey")
    pending = o.where("o_orderstatus = 'P'").select("o_custkey")
    return c.join(held, c["docket_id"] == held["o_custkey"], "left_semi").join(pending, c["docket_id"] == pending["o_custkey"], "left_anti")


@query(
    """WITH m AS (SELECT s_suppkey AS sub, s_nationkey AS fam, 50 * s_suppkey AS mark FROM supplier)
    SELECT sub, COUNT(*) AS n FROM m JOIN (SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) r
    ON (c_custkey = sub OR c_nationkey = fam) AND o_orderkey > mark GROUP BY sub"""
)
def subscription_family_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The either-or join, each way by itself: of the family, how many entries come after a mark is the running
    count at the family's end less that at the mark; of the proceeding, those that the family hasn't counted are joined."""
    subs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("sub"), F.col("s_nationkey").alias("fam"), (50 * F.col("s_suppkey")).cast("long").alias("mark"))
    f = filings(spark, sf_dir).select(F.col("filing_id").cast("long").alias("filing_id"), F.col("docket_id").cast("long").alias("docket_id"), F.col("family_id").alias("fam"))
    nothing = F.lit(None).cast("long")
    both = f.select("fam", F.col("filing_id").alias("at"), F.lit(1).alias("one"), nothing.alias("sub")).unionByName(subs.select("fam", F.col("mark").alias("at"), F.lit(0).alias("one"), "sub"))
    # At a mark its own entry comes before it: only what is greater counts.
    upto = save(running_sum(both, [F.col("fam"), F.col("at"), F.desc("one")], F.col("one"), "upto"), "fanout")
    ends = upto.groupBy("fam").agg(F.max("upto").alias("end"))
    of_family = upto.where("sub is not null").join(ends, "fam").select("sub", (F.col("end") - F.col("upto")).alias("n"))
    own = f.join(subs.select("sub", F.col("fam").alias("sub_fam"), "mark"), F.col("docket_id") == F.col("sub")).where("filing_id > mark and fam <> sub_fam")
    of_docket = own.groupBy("sub").agg(F.count(F.lit(1)).alias("n"))
    return of_family.unionByName(of_docket).groupBy("sub").agg(F.sum("n").alias("n")).where("n > 0")


@query("SELECT l_orderkey AS decision_id, COUNT(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1 HAVING COUNT(DISTINCT l_suppkey) > 1")
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.collisions(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("decision_id"), "l_suppkey"), "decision_id", "l_suppkey")


@query(
    """SELECT day, decision_id, docket_id FROM (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, l_suppkey AS docket_id, MIN(l_orderkey) AS decision_id, COUNT(DISTINCT l_orderkey) AS n
    FROM lineitem GROUP BY 1, 2) WHERE n = 1"""
)
def unambiguous_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.operators.citations import works

    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("docket_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("served"), F.col("l_orderkey").alias("decision_id"))
    return works(d).select(F.col("served").alias("day"), "decision_id", "docket_id")


# ---------------------------------------------------------------- the ledger

@query(
    """SELECT user_id AS key, event_id, event_type AS kind, props AS payload FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1"""
)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(observations(spark, sf_dir), "key", "event_id", ["kind", "payload"])


@query(
    """SELECT user_id AS key, event_id, event_type AS kind FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-05 00:00:00') WHERE k = 1"""
)
def point_in_time_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00"))
    return ledger.as_known_at(observations(spark, sf_dir), "key", "event_id", "ts", when, ["kind"])


@query(
    """SELECT event_id, key, kind, before FROM (SELECT event_id, user_id AS key, event_type AS kind, LAG(event_type) OVER w AS before, ROW_NUMBER() OVER w AS k FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE k = 1 OR before IS DISTINCT FROM kind"""
)
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.changes(observations(spark, sf_dir), "key", "event_id", "kind").select("event_id", "key", "kind", "before")


@query(
    """SELECT user_id AS key, event_id, CASE WHEN event_type = 'error' THEN 'backfill' ELSE 'forward' END AS mode, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1"""
)
def first_seen_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ledger.first_seen(observations(spark, sf_dir), "key", "event_id", ["kind", "ts"])
    return first.select("key", "event_id", F.when(F.col("kind") == "error", "backfill").otherwise("forward").alias("mode"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    """WITH a AS (SELECT user_id, MAX(event_id) AS answered FROM events WHERE event_type = 'purchase' GROUP BY 1),
    q AS (SELECT user_id, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'click') WHERE k <= 5)
    SELECT q.user_id AS key, COUNT(*) AS asked, CAST(SUM(CASE WHEN answered IS NULL OR answered < event_id THEN 1 ELSE 0 END) AS BIGINT) AS unanswered FROM q LEFT JOIN a USING (user_id) GROUP BY 1"""
)
def unanswered_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.unanswered(observations(spark, sf_dir), "key", "event_id", F.col("kind") == "click", F.col("kind") == "purchase", 5)


@query(
    """WITH m AS (SELECT user_id, MIN(event_id) + 500 AS mark FROM events GROUP BY 1) SELECT e.event_id, e.user_id AS key, e.event_type AS kind FROM events e JOIN m USING (user_id)
    WHERE event_id > mark AND event_type <> 'error'"""
)
def forward_after_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir)
    marks = e.groupBy("key").agg((F.min("event_id") + 500).alias("mark"))
    return ledger.after_mark(e, marks, "key", "event_id", F.col("kind") != "error").select("event_id", "key", "kind")


@query(
    """WITH l AS (SELECT user_id, arg_max(event_type, ts) AS status, MAX(ts) AS seen FROM (SELECT user_id, event_type, ts FROM events) GROUP BY 1)
    SELECT user_id AS key, status, CAST(CASE WHEN status = 'error' THEN 1 ELSE 7 END AS INTEGER) AS rest_days FROM l
    WHERE status IN ('error', 'signup') AND CAST(seen AS DATE) + CASE WHEN status = 'error' THEN 1 ELSE 7 END > (SELECT CAST(MAX(ts) AS DATE) FROM events)"""
)
def refused_urls_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir).select("key", "ts", F.col("kind").alias("status"))
    today = F.lit(e.agg(F.to_date(F.max("ts"))).first()[0])
    rest = ledger.resting(e, "key", "ts", "status", today, refused=["signup"], short_days=1, long_days=7, failing=["error"])
    return rest.select("key", "status", "rest_days")


@query(
    """SELECT action, COUNT(*) AS n FROM (SELECT CASE WHEN n.user_id IS NULL THEN 'left' WHEN l.user_id IS NULL THEN 'asserted' WHEN n.kind = l.kind THEN 'unchanged' ELSE 'superseded' END AS action
    FROM (SELECT user_id, arg_max(event_type, event_id) AS kind FROM events WHERE ts < TIMESTAMP '2024-01-04 00:00:00' GROUP BY 1) l
    FULL JOIN (SELECT user_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1) n ON l.user_id = n.user_id) GROUP BY action"""
)
def supersession_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir)
    # Two passes: what was asserted up to a moment, and what is now.
    live = ledger.latest(e.where(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-04 00:00:00"))), "key", "event_id", ["kind"]).select("key", "kind")
    new = ledger.latest(e, "key", "event_id", ["kind"]).select("key", "kind")
    return ledger.compare(live, new, ["key"], ["kind"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
