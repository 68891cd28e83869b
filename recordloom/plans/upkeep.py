"""Queries over citations, readings, parties, pins and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import citations, ledger
from recordloom.operators import textquality as T
from recordloom.operators import upkeep as U
from recordloom.plans.catalogue import query, values
from recordloom.tables import decision_copies, filings, observations, table

_ROW = "l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_shipdate"


def _row() -> list:
    return [F.desc("l_extendedprice"), *[F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")]]


@query(
    f"""SELECT l_orderkey AS key, l_returnflag AS method, l_partkey AS target FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, {_ROW}) = 1"""
)
def best_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best method's resolution of each key, after the veto."""
    veto = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    best = U.best_of(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_returnflag"), *_row()], veto)
    return best.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("method"), F.col("l_partkey").alias("target"))


@query(f"SELECT l_orderkey AS key, l_linestatus AS value, l_suppkey AS judge FROM lineitem WHERE l_quantity > 5 QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, {_ROW}) = 1")
def best_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = U.best_of(table(spark, sf_dir, "lineitem").where("l_quantity > 5"), ["l_orderkey"], [F.desc("l_quantity"), *_row()])
    return best.select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("value"), F.col("l_suppkey").alias("judge"))


@query(
    """WITH f AS (SELECT conv_id AS document, role AS channel, CASE WHEN turn % 5 = 4 AND conv_id % 3 = 0 THEN 'no such passage' ELSE substr(text, 1, 12) END AS passage, text FROM conversations WHERE conv_id % 2 = 0 OR role = 'user')
    SELECT document, CASE WHEN COUNT(DISTINCT channel) > 1 THEN 'mixed channels' WHEN COUNT(CASE WHEN NOT contains(text, passage) THEN 1 END) > 0 THEN 'unquoted' END AS refused FROM f GROUP BY 1"""
)
def refused_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("conv_id % 2 = 0 or role = 'user'")
    passage = F.when((F.col("turn") % 5 == 4) & (F.col("conv_id") % 3 == 0), "no such passage").otherwise(F.substring("text", 1, 12))
    return U.refused(c.select(F.col("conv_id").alias("document"), F.col("role").alias("channel"), passage.alias("passage"), F.col("text").alias("page_text")))


_RETRACT = """l AS (SELECT c_nationkey AS document, c_custkey % 10 AS page, 'FD ' || c_custkey AS key, c_custkey AS c FROM customer WHERE c_acctbal < 3000)"""


@query(
    f"""WITH {_RETRACT}, e AS (SELECT document, page, CASE c % 4 WHEN 0 THEN key ELSE key || ' (1)' END AS key, key AS short, c FROM l WHERE c % 4 < 2 UNION ALL SELECT document, page, key || ' (2)', key, c FROM l WHERE c % 8 = 1)
    SELECT document, page, key, (SELECT CASE WHEN COUNT(*) = 1 THEN MIN(e.key) END FROM e WHERE e.short = l.key AND e.document = l.document AND e.page = l.page AND e.key <> e.short) AS successor FROM l WHERE page < 5 AND c % 7 <> 0 AND c % 4 <> 0"""
)
def retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a newer pass over their pages did not find again; one refined key takes the place of its shorter one."""
    c = F.col("c")
    live = table(spark, sf_dir, "customer").where("c_acctbal < 3000").select(F.col("c_nationkey").alias("document"), (F.col("c_custkey") % 10).alias("page"), F.concat(F.lit("FD "), F.col("c_custkey").cast("string")).alias("key"), F.col("c_custkey").alias("c"))
    again = live.where(c % 4 < 2).select("document", "page", F.when(c % 4 == 0, F.col("key")).otherwise(F.concat("key", F.lit(" (1)"))).alias("key"))
    twice = live.where(c % 8 == 1).select("document", "page", F.concat("key", F.lit(" (2)")).alias("key"))
    walked = live.where("page < 5").select("document", "page").distinct()
    kept = live.where(c % 7 == 0).select("document", "page", "key")
    return U.retracted(live.drop("c"), walked, again.union(twice), kept)


@query("SELECT event_id, CASE WHEN event_id < m THEN m END AS points_at FROM (SELECT event_id, MAX(event_id) OVER (PARTITION BY user_id, event_type) AS m FROM events)")
def repointed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.repointed(observations(spark, sf_dir).select("event_id", "key", "kind"), ["key", "kind"], "event_id").select("event_id", "points_at")


@query(
    "WITH e AS (SELECT user_id, event_id, CASE WHEN value > 50 THEN value END AS w, LAG(CASE WHEN value > 50 THEN value END) OVER (PARTITION BY user_id ORDER BY event_id) AS b, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT COUNT(CASE WHEN b IS NULL AND w IS NOT NULL THEN 1 END) AS gained, COUNT(CASE WHEN b IS NOT NULL AND w IS NULL THEN 1 END) AS lost FROM e WHERE k > 1"
)
def works_gained_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir).select("key", "event_id", F.when(F.col("value") > 50, F.col("value")).alias("work"))
    return U.gained_and_lost(e, "key", "event_id", "work")


@query(
    """WITH j AS (SELECT user_id, event_id, 'span' AS judgement, CAST(event_type = 'click' AS VARCHAR) AS v FROM events UNION ALL SELECT user_id, event_id, 'exposure', CAST(value > 50 AS VARCHAR) FROM events UNION ALL SELECT user_id, event_id, 'kind', event_type FROM events),
    c AS (SELECT *, LAG(v) OVER (PARTITION BY user_id, judgement ORDER BY event_id) AS b FROM j) SELECT judgement, COUNT(*) AS judged, COUNT(CASE WHEN v IS DISTINCT FROM b THEN 1 END) AS written FROM c GROUP BY 1"""
)
def judgements_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three judgements of each key, each written only if it differs from the one before."""
    e = observations(spark, sf_dir)
    told = F.array(
        F.struct(F.lit("span").alias("j"), (F.col("kind") == "click").cast("string").alias("v")), F.struct(F.lit("exposure").alias("j"), (F.col("value") > 50).cast("string").alias("v")), F.struct(F.lit("kind").alias("j"), F.col("kind").alias("v"))
    )
    every = e.select("key", "event_id", F.explode(told).alias("t")).select(F.concat_ws("/", "key", "t.j").alias("k"), "event_id", F.col("t.j").alias("judgement"), "t.v")
    written = ledger.changes(every, "k", "event_id", "v").groupBy("judgement").agg(F.count(F.lit(1)).alias("written"))
    return every.groupBy("judgement").agg(F.count(F.lit(1)).alias("judged")).join(written, "judgement")


@query("SELECT l_partkey AS document, l_returnflag AS method, l_linestatus AS channel, COUNT(*) AS runs, strftime(MAX(l_shipdate), '%Y-%m-%d') AS ran, MAX_BY(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS found FROM lineitem GROUP BY 1, 2, 3")
def extraction_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, method and channel: its last run."""
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("document"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("channel"))
    last = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return by.agg(F.count(F.lit(1)).alias("runs"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("ran"), F.max_by("l_quantity", last).alias("found"))


@query("SELECT DISTINCT l_orderkey AS document, l_linenumber AS page FROM lineitem a WHERE l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_returnflag <> 'R')")
def other_channel_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that already carry another channel's live reading."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page"), "l_returnflag")
    return line.where("l_returnflag = 'R'").select("document", "page").distinct().join(line.where("l_returnflag <> 'R'"), ["document", "page"], "left_semi")


@query("SELECT conv_id, turn FROM conversations c WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn AND contains(d.text, substr(c.text, 1, 10)) AND d.turn % 4 <> 3)")
def stale_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows whose words are no longer on a displayed page; every fourth page is displayed no more."""
    c = table(spark, sf_dir, "conversations")
    quotes = c.where("role = 'assistant'").select("conv_id", "turn", F.substring("text", 1, 10).alias("quote"))
    shown = c.where("turn % 4 <> 3").select(F.col("conv_id").alias("d"), F.col("turn").alias("t"), "text")
    return quotes.join(shown, (F.col("conv_id") == F.col("d")) & (F.col("turn") == F.col("t")) & F.contains("text", "quote"), "left_anti").select("conv_id", "turn")


@query(
    """WITH g AS (SELECT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING COUNT(*) >= (SELECT COUNT(*) / 25 FROM lineitem))
    SELECT l_partkey AS work, COUNT(DISTINCT l_orderkey) AS cited_by FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN (SELECT p_brand FROM g) AND l_returnflag <> 'A' GROUP BY 1"""
)
def cited_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who cites a work, of the classes that were measured only."""
    line, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    edges = line.select("l_orderkey", "l_partkey", "l_returnflag").join(p, F.col("l_partkey") == F.col("p_partkey"))
    counts = edges.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    measured = counts.join(F.broadcast(counts.agg((F.sum("n") / 25).alias("least")))).where("n >= least").select("p_brand")  # one row
    shown = edges.where("l_returnflag <> 'A'").join(measured, "p_brand", "left_semi")
    return shown.groupBy(F.col("l_partkey").alias("work")).agg(F.countDistinct("l_orderkey").alias("cited_by"))


@query("SELECT l_orderkey AS document, COUNT(CASE WHEN o_orderkey IS NULL THEN 1 END) AS unstamped, COUNT(CASE WHEN l_shipdate > o_orderdate + INTERVAL 90 DAY THEN 1 END) AS stale FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey GROUP BY 1")
def stamp_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a stamp, and with one that is older than what it vouches for."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate")
    met = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    late = F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 90 days")
    return met.groupBy(F.col("l_orderkey").alias("document")).agg(F.count_if(F.col("o_orderkey").isNull()).alias("unstamped"), F.count_if(late).alias("stale"))


@query(
    """WITH t AS (SELECT l_orderkey AS key, l_returnflag AS method, l_shipdate AS shipped, l_partkey, l_suppkey, l_linenumber, l_extendedprice, CASE WHEN l_discount > 0.07 THEN 'overruled' WHEN l_discount > 0.04 THEN 'questioned' ELSE 'followed' END AS treatment FROM lineitem),
    b AS (SELECT * FROM t QUALIFY ROW_NUMBER() OVER (PARTITION BY key ORDER BY method, shipped DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice) = 1) SELECT key, treatment FROM b WHERE treatment IN ('overruled', 'questioned')"""
)
def negative_treatment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best live treatment of each key, where it is negative."""
    line = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_discount") > 0.07, "overruled").when(F.col("l_discount") > 0.04, "questioned").otherwise("followed")
    order = [F.col("l_returnflag"), F.desc("l_shipdate"), *[F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")]]
    best = U.best_of(line.withColumn("treatment", kind), ["l_orderkey"], order)
    return best.where(F.col("treatment").isin("overruled", "questioned")).select(F.col("l_orderkey").alias("key"), "treatment")


@query("SELECT l_orderkey AS key, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS reviewers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY 1")
def review_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, s = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    named = line.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return named.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("s_name")), ", ").alias("reviewers"))


@query(
    "SELECT o_orderkey AS key, (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'O' AND o_custkey BETWEEN 100 AND 900) AS owed FROM orders WHERE o_orderstatus = 'O' AND o_custkey BETWEEN 100 AND 900 ORDER BY sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 30"
)
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue in the order of its documents' hashes, inside the held range, and how many are owed in all."""
    owed = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_custkey between 100 and 900").select(F.col("o_orderkey").alias("key"))
    first = owed.orderBy(F.sha2(F.col("key").cast("string"), 256), "key").limit(30)
    return first.join(F.broadcast(owed.agg(F.count(F.lit(1)).alias("owed"))))  # one row


@query(
    """WITH a AS (SELECT o_orderkey AS key, CASE o_orderkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'corrected' WHEN 2 THEN 'rejected' ELSE 'escalated' END AS action, o_custkey AS named FROM orders),
    m AS (SELECT l_orderkey AS key, MAX_BY(l_returnflag, (l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice)) AS outcome, MAX_BY(l_suppkey, (l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice)) AS docket FROM lineitem GROUP BY 1)
    SELECT a.key, CASE action WHEN 'accepted' THEN outcome WHEN 'corrected' THEN 'resolved' ELSE 'unresolved' END AS outcome, CASE action WHEN 'accepted' THEN docket WHEN 'corrected' THEN named END AS docket FROM a LEFT JOIN m ON a.key = m.key WHERE action <> 'escalated'"""
)
def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    action = F.when(n == 0, "accepted").when(n == 1, "corrected").when(n == 2, "rejected").otherwise("escalated")
    last = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    machine = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.max_by("l_returnflag", last).alias("outcome"), F.max_by("l_suppkey", last).alias("docket"))
    return U.judged(o.select(F.col("o_orderkey").alias("key"), action.alias("action"), F.col("o_custkey").alias("named")), machine)


@query("SELECT conv_id || '/' || turn || '/' || role || '/' || md5(text) || '/x' AS rendered, CAST(conv_id AS VARCHAR) AS document, CAST(turn AS VARCHAR) AS page, role AS kind, md5(text) || '/x' AS key FROM conversations")
def rendered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key in writing and read back: what follows the third slash is the key, slashes and all."""
    c = table(spark, sf_dir, "conversations")
    written = c.select(F.concat_ws("/", "conv_id", "turn", "role", F.concat(F.md5("text"), F.lit("/x"))).alias("rendered"))
    parts = F.split("rendered", "/", 4)
    return written.select("rendered", *[parts[k].alias(n) for k, n in enumerate(("document", "page", "kind", "key"))])


@query("SELECT l_suppkey AS channel, l_linestatus AS role, MAX(l_orderkey) AS method, COUNT(*) - 1 AS retired FROM lineitem GROUP BY 1, 2")
def producer_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live declaration of a channel and role: repointing retires the one before and appends another."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("channel"), F.col("l_linestatus").alias("role")).agg(F.max("l_orderkey").alias("method"), (F.count(F.lit(1)) - 1).alias("retired"))


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE c.role = 'user' AND EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'assistant' AND d.turn = c.turn + 1) AND NOT EXISTS (SELECT 1 FROM conversations e WHERE e.conv_id = c.conv_id AND e.turn > c.turn AND e.role = 'user')")
def restart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a run goes on: pages with a live reading, after which none of the run is recorded."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    live = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    last = c.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return last.join(live, ["conv_id", "turn"], "left_semi")


@query(
    """WITH d AS (SELECT event_id AS dispatch, user_id AS document, ts AS sent FROM events WHERE event_type = 'view'), r AS (SELECT event_id AS reading, user_id AS document, ts AS "read" FROM events WHERE event_type = 'purchase'),
    n AS (SELECT reading, "read", dispatch FROM r JOIN d USING (document) WHERE sent <= "read" AND "read" <= sent + INTERVAL 6 HOUR QUALIFY ROW_NUMBER() OVER (PARTITION BY reading ORDER BY sent DESC, dispatch DESC) = 1)
    SELECT dispatch, reading FROM n QUALIFY ROW_NUMBER() OVER (PARTITION BY dispatch ORDER BY "read", reading) = 1"""
)
def answered_dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir).select("event_id", F.col("key").alias("document"), "kind", "ts")
    sent = e.where("kind = 'view'").select(F.col("event_id").alias("dispatch"), "document", F.col("ts").alias("sent"))
    read = e.where("kind = 'purchase'").select(F.col("event_id").alias("reading"), "document", F.col("ts").alias("read"))
    return U.answered(read, sent, 6)


@query("SELECT c_nationkey AS family_id, COUNT(*) AS subs, COUNT(o_orderkey) AS own_records FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o_orderkey FROM orders WHERE o_orderdate > DATE '2001-07-01') ON c_custkey = o_orderkey AND c_custkey < 100 GROUP BY 1 HAVING COUNT(*) >= 5 AND COUNT(o_orderkey) = 0")
def series_dockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("family_id"))
    own = table(spark, sf_dir, "orders").where("o_orderdate > date'2001-07-01' and o_custkey < 100").select("o_custkey").distinct()
    n = c.join(own, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("family_id").agg(F.count(F.lit(1)).alias("subs"), F.count("o_custkey").alias("own_records"))
    return U.series(n)


@query("SELECT n_name AS family, l_suppkey AS party, COUNT(DISTINCT l_orderkey) AS records FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def family_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decision_copies(spark, sf_dir)
    return c.groupBy("family", F.col("docket_id").alias("party")).agg(F.countDistinct("decision_id").alias("records"))


@query(
    """WITH r AS (SELECT s_suppkey AS party, MIN(s_suppkey) OVER (PARTITION BY s_nationkey) AS rep FROM supplier), p AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey < (SELECT MAX(s_suppkey) FROM supplier))
    SELECT a, b, CASE WHEN x.rep = y.rep THEN 'one already' WHEN a % 10 = 0 THEN 'parted before' ELSE 'may join' END AS verdict FROM p JOIN r x ON a = x.party JOIN r y ON b = y.party"""
)
def join_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    reps = s.join(s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("rep")), "s_nationkey").select(F.col("s_suppkey").alias("party"), "rep")
    pairs = s.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return U.joinable(pairs, reps, pairs.where("a % 10 = 0"))


@query("SELECT l_orderkey AS cell, COUNT(*) AS spans FROM lineitem WHERE l_linenumber < 3 OR l_tax > 0.07 OR l_discount > 0.09 GROUP BY 1")
def cells_to_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to be cut again, and no others."""
    line = table(spark, sf_dir, "lineitem")
    spans = line.select(F.col("l_orderkey").alias("id"), F.format_string("v%d", F.least("l_linenumber", F.lit(3))).alias("version"), F.lit("cell").alias("cell"), F.when(F.col("l_tax") > 0.07, "other").otherwise("cell").alias("cut_from"), F.when(F.col("l_discount") > 0.09, 0.6).otherwise(1.0).alias("confidence"))
    return U.retried_cells(spans, "v3").groupBy(F.col("id").alias("cell")).agg(F.count(F.lit(1)).alias("spans"))


@query("SELECT DISTINCT unnest(string_split(c, ' and ')) AS name FROM (SELECT n_name || CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' and ' || r_name ELSE ' and ' || r_name || ' and Sons' END AS c FROM nation JOIN region ON n_regionkey = r_regionkey)")
def minted_to_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists are parted round by round until no round names anyone new."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey") % 3
    more = F.when(k == 0, "").when(k == 1, F.concat(F.lit(" and "), "r_name")).otherwise(F.concat(F.lit(" and "), "r_name", F.lit(" and Sons")))
    cells = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_name", more).alias("name"))
    return U.resolved_rounds(cells, cells.limit(0))[0]


@query("SELECT * FROM (SELECT 'line without order' AS fault, COUNT(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order without customer', COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'label without document', COUNT(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de'))")
def reference_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys that lead nowhere."""
    line, o, c, labels, d = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "labels", "documents"))
    found = [("line without order", U.missing_references(line, "l_orderkey", o, "o_orderkey")), ("order without customer", U.missing_references(o, "o_custkey", c, "c_custkey")), ("label without document", U.missing_references(labels, "doc_id", d.where("lang <> 'de'"), "doc_id"))]
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fault"), "n") for name, df in found]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    """SELECT COUNT(CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '%SPECIFIED%' THEN 1 END) AS placeholder_types, COUNT(CASE WHEN NOT regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^\\d{4}-\\d{2}-\\d{2}$') THEN 1 END) AS bad_dates, COUNT(CASE WHEN o_orderkey % 5 <> length(repeat('x', CAST(o_orderkey % 5 AS INTEGER))) THEN 1 END) AS bad_failures, (SELECT COUNT(*) FROM (SELECT l_partkey FROM lineitem GROUP BY l_partkey, l_linestatus HAVING COUNT(DISTINCT l_returnflag) > 1)) AS mixed_pins FROM orders"""
)
def placement_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholder types, dates not in the right shape, failure lists of another length than their count, labels of two methods."""
    o = table(spark, sf_dir, "orders")
    listed = F.array_repeat(F.lit("x"), (F.col("o_orderkey") % 5).cast("int"))
    n = o.agg(
        F.count_if((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").contains("SPECIFIED")).alias("placeholder_types"),
        F.count_if(~F.date_format("o_orderdate", "yyyy-MM-dd").rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("bad_dates"),
        F.count_if(F.size(listed) != F.col("o_orderkey") % 5).alias("bad_failures"),
    )
    pins = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linestatus").agg(F.countDistinct("l_returnflag").alias("m")).where("m > 1")
    return n.join(F.broadcast(pins.agg(F.count(F.lit(1)).alias("mixed_pins"))))  # one row


@query("SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND turn < (SELECT MAX(turn) FROM conversations c WHERE c.conv_id = conversations.conv_id AND c.role = 'user')")
def stranded_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that are still live although their key was retracted by a later pass."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    retracted = c.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("upto"))
    return c.where("role = 'assistant'").join(retracted, "conv_id").where("turn < upto").select("conv_id", "turn")


@query("SELECT norm, MIN(party) AS keeper, COUNT(*) - 1 AS homonyms FROM (SELECT c_custkey AS party, lower(c_mktsegment) || ' ' || c_nationkey AS norm FROM customer) GROUP BY 1")
def name_homonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One live name of a kind: homonyms are joined to the first."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("party"), S.normal_name(F.concat_ws(", ", "c_mktsegment", "c_nationkey")).alias("norm"))
    return c.groupBy("norm").agg(F.min("party").alias("keeper"), (F.count(F.lit(1)) - 1).alias("homonyms"))


@query("SELECT l_orderkey AS filing, string_agg(DISTINCT CAST(n_regionkey AS VARCHAR), ',' ORDER BY CAST(n_regionkey AS VARCHAR)) AS components FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def filing_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decision_copies(spark, sf_dir)
    return c.groupBy(F.col("decision_id").alias("filing")).agg(F.array_join(F.array_sort(F.collect_set(F.col("region_id").cast("string"))), ",").alias("components"))


@query("SELECT * FROM (VALUES ('FD 36873', 'FD 36873', true), ('ab-55-2x', 'AB 55 (2X)', false), ('nothing', NULL, false)) t(raw, key, names_document)")
def cited_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed numbers as keys, and whether their text names a document."""
    rows = [("FD 36873", citations.normal_key("FD 36873"), "See FD 36873, slip op. at 3 (STB served Mar. 1, 2021)"), ("ab-55-2x", "AB 55 (2X)", "Docket AB 55"), ("nothing", citations.normal_key("nothing"), "")]
    return values(spark, "raw string, key string, line string", rows).select("raw", "key", citations.names_a_document(F.col("line")).alias("names_document"))


@query(
    """WITH s AS (SELECT l_suppkey AS stratum, COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS hits, COUNT(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, hits / n AS p FROM s)
    SELECT stratum, round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS high FROM p"""
)
def share_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("stratum")).agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = T.wilson(F.col("hits"), F.col("n"))
    return n.select("stratum", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT o_custkey AS docket_id, MIN(o_orderkey) AS first_id, COUNT(*) AS seen FROM (SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) GROUP BY 1")
def appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's first observation is appended, unless the key is known."""
    f = filings(spark, sf_dir).select("docket_id", "filing_id")
    known = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("docket_id"))
    first = ledger.appended(f, known, ["docket_id"], "filing_id")
    seen = f.groupBy("docket_id").agg(F.count(F.lit(1)).alias("seen"))
    return first.join(seen, "docket_id").select("docket_id", F.col("filing_id").alias("first_id"), "seen")


@query("SELECT event_id, LEAD(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS superseded_by FROM events")
def superseded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.superseded_by(observations(spark, sf_dir).select("event_id", "key", "kind"), ["key", "kind"], "event_id").select("event_id", "superseded_by")
