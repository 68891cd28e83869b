"""Queries over text, search, parties, citations and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import citations, entities, index, search, textquality, validate
from recordloom.plans.catalogue import query, values
from recordloom.sources import files, html
from recordloom.tables import spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def document_index(spark: SparkSession, sf_dir: str) -> index.SearchIndex:
    """The index of documents: their source as a title of weight 8, and their text."""
    return index.opened(table(spark, sf_dir, "documents"), "doc_id", {"source": 8, "text": 1})


@query(
    """SELECT a.conv_id, a.turn FROM conversations a WHERE a.role = 'assistant' AND NOT EXISTS (SELECT 1 FROM conversations u WHERE u.role = 'user' AND u.conv_id = a.conv_id AND u.turn = a.turn + 1)"""
)
def anti_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    human = c.where("role = 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.where("role = 'assistant'").join(human, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


@query(
    "SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'stupid') OR len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: starts_with(x, 'stupid'))) > 0"
)
def token_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The source's only token is no word of the query.
    return index.match(spark, document_index(spark, sf_dir), "stupid")


@query(
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)
    SELECT doc_id FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'from') AND len(list_filter(w, lambda x: starts_with(x, 'ti'))) > 0"""
)
def token_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.match(spark, document_index(spark, sf_dir), "the from ti")


_BM25 = """t AS (SELECT doc_id, source, lang, regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+') AS a, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS b FROM documents),
    p AS (SELECT doc_id, source, lang, len(a) + len(b) AS dl, 8.0 * len(list_filter(a, lambda x: x = 'heed')) + len(list_filter(b, lambda x: x = 'heed')) AS f1, 8.0 * len(list_filter(a, lambda x: x = 'this')) + len(list_filter(b, lambda x: x = 'this')) AS f2 FROM t),
    s AS (SELECT COUNT(*) AS n, AVG(dl) AS avgdl, SUM(CASE WHEN f1 > 0 THEN 1 ELSE 0 END) AS d1, SUM(CASE WHEN f2 > 0 THEN 1 ELSE 0 END) AS d2 FROM p),
    r AS (SELECT doc_id, source, lang, round(ln((n - d1 + 0.5) / (d1 + 0.5) + 1) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln((n - d2 + 0.5) / (d2 + 0.5) + 1) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score
      FROM p, s WHERE f1 > 0 AND f2 > 0)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.ranked(spark, document_index(spark, sf_dir), ["heed", "this"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, score FROM r")
def bm25_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


@query(
    f"""WITH {_BM25}, c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS nth FROM r), k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id) AS place FROM c WHERE nth <= 3)
    SELECT doc_id, source, score, nth, place, (SELECT COUNT(*) FROM k) > 20 AS truncated FROM k WHERE place <= 20"""
)
def top3_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _ranked(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return search.capped(hits, "source", [F.desc("score"), F.asc("doc_id")]).select("doc_id", "source", "score", "nth", "place", "truncated")


@query(
    f"""WITH {_BM25}, m AS (SELECT source AS gid, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS tier, score, doc_id FROM r)
    SELECT gid, tier, score, matches FROM (SELECT gid, tier, MAX(score) AS score, ROW_NUMBER() OVER (PARTITION BY gid ORDER BY tier) AS k FROM m GROUP BY gid, tier) JOIN (SELECT gid, COUNT(*) AS matches FROM m GROUP BY gid) USING (gid) WHERE k = 1"""
)
def placement_filter_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("gid"), F.when(F.col("lang") == "en", 1).otherwise(2).alias("tier"))
    return search.grouped(_ranked(spark, sf_dir), places, "doc_id", "gid", "tier", "score")


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(path, '^/?$') THEN 'front' WHEN regexp_matches(path, '^/en/') THEN 'record' WHEN regexp_matches(path, '^/(fr|de|es)/') THEN 'translation' WHEN regexp_matches(path, '\\.(css|js|png)$') THEN 'asset' ELSE 'other' END AS route FROM p"""
)
def route_class_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("^/?$", "front"), ("^/en/", "record"), ("^/(fr|de|es)/", "translation"), (r"\.(css|js|png)$", "asset")]
    return table(spark, sf_dir, "pages").select("page_id", S.ordered_rules(S.url_path(F.col("url")), rules, "other").alias("route"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=\"[^\"]*\">')) AS anchors, len(regexp_extract_all(html, '<li>')) AS items, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    n = html.links(p, "page_id", "html").groupBy("page_id").agg(F.count(F.lit(1)).alias("anchors"))
    return p.join(n, "page_id", "left").select(
        "page_id", F.coalesce("anchors", F.lit(0)).cast("long").alias("anchors"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")
    )


@query(
    """WITH d AS (SELECT doc_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS t FROM documents), b AS (SELECT item_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS q FROM benchmark)
    SELECT doc_id, item_id FROM d JOIN b ON contains(t, q)"""
)
def quote_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textquality.quoted(_documents(spark, sf_dir), "doc_id", S.flattened(F.col("text")), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "quote"), "item_id", S.flattened(F.col("quote")))


@query(
    """WITH m AS (SELECT lang, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'), '(?:\\+?1[ .-]?)?\\(\\d{3}\\) ?\\d{3}[ .-]\\d{4}', '[phone]', 'g') AS t FROM documents)
    SELECT lang, CAST(SUM(len(regexp_extract_all(t, '\\[email\\]'))) AS BIGINT) AS emails, CAST(SUM(len(regexp_extract_all(t, '\\[phone\\]'))) AS BIGINT) AS phones FROM m GROUP BY lang"""
)
def mask_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _documents(spark, sf_dir).select("lang", S.masked(F.col("text")).alias("t"))
    return m.groupBy("lang").agg(F.sum(F.regexp_count("t", F.lit(r"\[email\]"))).alias("emails"), F.sum(F.regexp_count("t", F.lit(r"\[phone\]"))).alias("phones"))


@query(
    """WITH d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, CAST(len(l) AS BIGINT) AS lines, CAST(len(w) AS BIGINT) AS tokens, round(len(w) / greatest(len(l), 1), 6) AS tokens_per_line,
      round(len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) / greatest(len(w), 1), 6) AS numeric_share, round(len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]'))) / greatest(len(w), 1), 6) AS lettered_share FROM d"""
)
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textquality.features(_documents(spark, sf_dir).select("doc_id", "text"), "text").drop("text", "median_line")


@query(
    """SELECT word, df FROM (SELECT word, COUNT(DISTINCT doc_id) AS df FROM (SELECT doc_id, UNNEST(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents) GROUP BY word) WHERE df >= 20"""
)
def lexicon_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textquality.lexicon(_documents(spark, sf_dir), "doc_id", "text", 20)


@query(
    """WITH f AS (SELECT d.doc_id, l.quality = 1 AS truth, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '[#*$%&|!]'))) * 10 <= len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS guess FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    c AS (SELECT CAST(SUM(CASE WHEN truth AND guess THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(SUM(CASE WHEN NOT truth AND guess THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(SUM(CASE WHEN truth AND NOT guess THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(SUM(CASE WHEN NOT truth AND NOT guess THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM f WHERE truth IS NOT NULL)
    SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c"""
)
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    odd = F.size(F.filter(F.split("text", r"\s+"), lambda w: w.rlike(r"[#*$%&|!]")))
    judged = _documents(spark, sf_dir).select("doc_id", (odd * 10 <= F.size(words)).alias("guess")).join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth")), "doc_id", "left")
    return textquality.confusion(judged, F.col("truth"), F.col("guess"))


@query(
    """WITH r AS (SELECT lang, n_chars, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, COUNT(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, MIN(CASE WHEN k = least(n - 1, CAST(floor(n * 0.1) AS BIGINT)) THEN n_chars END) AS q10, MIN(CASE WHEN k = least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) THEN n_chars END) AS q50, MIN(CASE WHEN k = least(n - 1, CAST(floor(n * 0.9) AS BIGINT)) THEN n_chars END) AS q90 FROM r GROUP BY lang"""
)
def percentiles_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textquality.floor_quantiles(_documents(spark, sf_dir), "lang", "n_chars", [0.1, 0.5, 0.9])


@query(
    """WITH f AS (SELECT l.quality = 1 AS pos, d.n_chars AS score FROM documents d JOIN labels l USING (doc_id))
    SELECT round(SUM(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) / COUNT(*), 6) AS auc FROM f p, f q WHERE p.pos AND NOT q.pos"""
)
def auc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select((F.col("quality") == 1).alias("pos"), F.col("n_chars").alias("score"))
    return textquality.auc(f, "score", "pos")


@query("SELECT * FROM (VALUES (1, 0.0, 0.0), (2, 0.142857, 0.142857), (3, 1.0, 1.0), (4, 0.0, 0.0), (5, 0.0, 1.0)) t(id, cer, distance)")
def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "id int, truth string, output string", [(1, "FD 36873", "FD 36873"), (2, "3687312", "3687313"), (3, "ab", "xyz"), (4, "", ""), (5, "", "abc")])
    return rows.select("id", F.round(S.character_error(F.col("truth"), F.col("output")), 6).alias("cer"), F.round(S.distance_share(F.col("truth"), F.col("output")), 6).alias("distance"))


# ---------------------------------------------------------------- parties

_PARTIES = "party_id long, name string, kind string, name_id long"
_NAMES = [
    (1, "Acme Railroad Company", "as_filed", 10), (2, "ACME RR CO.", "as_filed", 11), (3, "Beta, Inc.", "legal", 12), (3, "Beta", "display", 13), (4, "Gamma and Sons", "as_filed", 14),
    (5, "Gamma & Sons", "as_filed", 15), (6, "Delta LLC", "former", 16), (7, "Delta L.L.C.", "former", 17),
]
_SAME = [(1, 2), (6, 7)]


def _represented(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    names = values(spark, _PARTIES, _NAMES)
    return names, entities.represented(names.select("party_id").distinct(), values(spark, "a long, b long", _SAME))


@query("SELECT * FROM (VALUES (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6)) t(party_id, rep)")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _represented(spark)[1]


@query("SELECT * FROM (VALUES (1, 'ACME RR CO.'), (3, 'Beta'), (4, 'Gamma and Sons'), (5, 'Gamma & Sons'), (6, 'Delta LLC')) t(rep, display_name)")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.display_names(*_represented(spark))


@query("SELECT DISTINCT o_custkey AS node, o_custkey AS root FROM orders UNION ALL SELECT o_orderkey + 100000000, o_custkey FROM orders")
def components_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.operators.components import connected_components

    return connected_components(table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 100000000).alias("a"), F.col("o_custkey").alias("b")))


@query(
    "SELECT * FROM (VALUES (1, 'linked', 1), (2, 'ambiguous', NULL), (3, 'minted', NULL), (4, 'left', NULL), (5, 'minted', NULL), (6, 'linked', 3)) t(span_id, outcome, rep)"
)
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, reps = _represented(spark)
    spans = values(spark, "span_id int, text string, confidence double", [(1, "acme railroad company", 1.0), (2, "Gamma & Sons", 1.0), (3, "Epsilon Inc", 1.0), (4, "Zeta and Eta", 0.6), (5, "Epsilon, Incorporated", 0.6), (6, "Beta Incorporated", 1.0)])
    return entities.resolve(spans, names, reps).select("span_id", "outcome", "rep")


@query(
    """SELECT * FROM (VALUES (1, 0, 7, 'A, Inc.', 'party', 1.0), (1, 12, 17, 'B LLC', 'party', 1.0), (2, 0, 13, 'Smith & Jones', 'representative', 1.0), (2, 27, 34, 'Acme Co', 'principal', 1.0), (3, 0, 14, 'Salt and Pepper', 'party', 0.6)) t(cell_id, s, e, text, role, confidence) WHERE cell_id < 3
    UNION ALL SELECT 3, 0, 15, 'Salt and Pepper', 'party', 0.6"""
)
def cut_party_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = values(spark, "cell_id int, cell string", [(1, "A, Inc. and B LLC"), (2, "Smith & Jones on behalf of Acme Co"), (3, "Salt and Pepper"), (4, None), (5, " ")])
    cut = entities.cut_cells(cells, "cell").select("cell_id", F.explode("spans").alias("x"))
    return cut.select("cell_id", F.col("x.start").alias("s"), F.col("x.end").alias("e"), "x.text", "x.role", "x.confidence")


# ---------------------------------------------------------------- citations

@query(
    """SELECT * FROM (VALUES ('FD_36873', 'FD', 36873, NULL, NULL, 'FD_36873'), ('ab_55_5_x', 'AB', 55, 5, 'X', 'AB_55_5_X'), ('NOR_42000_0', 'NOR', 42000, NULL, NULL, 'NOR_42000'), ('FD36873', NULL, NULL, NULL, NULL, '')) t(raw, prefix, sequence, sub_sequence, suffix, canonical)"""
)
def norm_docket_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "raw string", [("FD_36873",), ("ab_55_5_x",), ("NOR_42000_0",), ("FD36873",)])
    return rows.select("raw", S.docket(F.col("raw")).alias("d")).select("raw", "d.*", S.canonical_docket(F.col("raw")).alias("canonical"))


_PAGES = [
    ("d1", 1, "See NOR 99999, slip op. at 3 (served Aug. 3, 2026).", ["FD 36873"]),
    ("d1", 2, "Docket No. FD 36873\nEP 542 (Sub-No. 32) is cited, and Finance Docket No. 12345.", ["FD 36873"]),
    ("d2", 1, "AB 55 (Sub-No. 5X); AB 55 (2024); fd 100", []),
]


@query(
    """SELECT * FROM (VALUES ('d1', 1, 'NOR 99999', 'citation', 1), ('d1', 2, 'FD 36873', 'caption', 1), ('d1', 2, 'EP 542 (32)', 'citation', 1), ('d1', 2, 'FD 12345', 'citation', 1), ('d2', 1, 'AB 55 (5X)', 'citation', 1), ('d2', 1, 'AB 55', 'citation', 1)) t(document, page, key, kind, occurrences)"""
)
def find_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = values(spark, "document string, page long, text string, own array<string>", _PAGES)
    return citations.find_citations(pages).select("document", "page", "key", "kind", "occurrences")


_REGISTRY = [("FD 36873", 1), ("FD 1234", 2), ("FD 123", 3), ("NOR 42000", 4), ("AB 55 (5X)", 5)]


@query(
    """SELECT * FROM (VALUES ('FD 36873', 1, 'held', FALSE), ('FD 1234', 2, 'held', TRUE), ('FD 12345', 2, 'repaired', FALSE), ('NOR 99999', NULL, 'unresolved', FALSE), ('AB 55 (5X)', 5, 'held', FALSE), ('FD 123', 3, 'held', FALSE)) t(key, docket_id, rule, exposed)"""
)
def resolve_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = values(spark, "key string", [(k,) for k in ("FD 36873", "FD 1234", "FD 12345", "NOR 99999", "AB 55 (5X)", "FD 123")])
    return citations.resolve(keys, values(spark, "key string, docket_id int", _REGISTRY))


@query("SELECT * FROM (VALUES ('d1', 1), ('d2', 7)) t(document, docket_id)")
def citation_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked, vetoed and gated: candidates are filtered before they are ranked."""
    found = values(spark, "document string, page int, key string", [("d1", 1, "A"), ("d1", 2, "B"), ("d1", 3, "C"), ("d1", 4, "D"), ("d2", 1, "E"), ("d2", 2, "F")])
    resolved = values(
        spark, "document string, page int, key string, method string, docket_id int, confidence double, superseded_by int",
        [("d1", 1, "A", "own", 1, 0.97, None), ("d1", 1, "A", "model", 9, 0.99, None), ("d1", 2, "B", "own", 2, 0.5, None), ("d1", 3, "C", "own", 3, 0.97, None), ("d1", 4, "D", "own", 4, 0.97, None), ("d2", 1, "E", "own", 6, 0.97, None), ("d2", 1, "E", "model", 7, 0.98, None), ("d2", 2, "F", "own", 8, 0.97, 77)],
    )
    judged = values(
        spark, "document string, page int, key string, method string, judgement string, value boolean, superseded_by int",
        [("d1", 1, "A", "t", "span", True, None), ("d1", 2, "B", "t", "span", True, None), ("d1", 3, "C", "t", "span", True, None), ("d1", 3, "C", "t", "exposed", True, None), ("d1", 4, "D", "t", "span", True, None), ("d1", 4, "D", "h", "refused", True, None),
         ("d2", 1, "E", "t", "span", True, None), ("d2", 1, "E", "own", "veto", True, None), ("d2", 1, "E", "t", "exposed", True, None), ("d2", 1, "E", "h", "confirmed", True, None), ("d2", 2, "F", "t", "span", True, None)],
    )
    return citations.project(found, resolved, judged, values(spark, "method string, precedence int", [("own", 1), ("model", 2)]), 0.9)


@query("SELECT * FROM (VALUES ('d1', 1, 'FD 20000')) t(document, page, key)")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "document string, page int, key string, rule string", [("d1", 1, "FD 20000", "unresolved"), ("d1", 2, "FD 99999", "unresolved"), ("d2", 1, "FD 30000", "unresolved"), ("d2", 2, "FD 25000", "held")])
    return citations.review_queue(rows, values(spark, "prefix string, lo long, hi long", [("FD", 100, 40000)]), values(spark, "document string, page int, key string", [("d2", 1, "FD 30000")]))


# ---------------------------------------------------------------- sources and integrity

@query(
    """SELECT * FROM (VALUES (0, '311981', 'NRDC & Co', '2026-08-25', FALSE), (1, '311900', 'X', '2026-08-24', TRUE)) t(row_no, filing, filed_for, filed, skipped)"""
)
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = lambda key, docket, who, day: f'<tr><td><a data-stb-id="{key}" href="/x">{docket}</a></td><td> {key.split("|")[1]} </td><td>{who}</td><td>{day}</td></tr>'
    body = cells("FD_36873|311981", "FD 36873", "NRDC &amp; <b>Co</b>", "8/25/2026") + cells("FD_36873|311900", "FD 99", "X", "8/24/2026") + "<tr><th>h</th></tr>"
    import json

    raw = values(spark, "raw string", [(json.dumps({"success": True, "data": {"rows": body, "total": 2}}),), ("<html>",)])
    rows = html.rows(html.envelope(raw, "raw").where("ok").select("rows"), "rows")
    out = html.parsed(rows.drop("rows"), {"filing": 1, "filed_for": 2, "filed": 3}, 4, (0, 0))
    return out.select("row_no", "filing", "filed_for", S.printed_date(F.col("filed")).alias("filed"), "skipped")


@query("SELECT * FROM (VALUES ('a', 1, 'one' || chr(10)), ('a', 2, 'two'), ('b', 1, 'plain')) t(doc, page, text)")
def marked_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "doc string, body string", [("a", "===== page 1 =====\none\n===== page 2 =====\ntwo"), ("b", "plain"), ("c", "x" * 6001)])
    return files.marked_pages(rows, "doc", "body").withColumn("page", F.col("page").cast("int"))


@query(
    """SELECT * FROM (VALUES ('one live row', 1), ('moves together', 1), ('orphan lines', 0), ('human replaced', 1), ('backward', 1), ('impossible date', 1), ('span', 1), ('beyond pages', 1)) t(rule, violations)"""
)
def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(
        spark, "id int, k string, human boolean, superseded_by int, m1 int, m2 int, day string",
        [(1, "a", False, 2, 1, 1, "2024-02-29"), (2, "a", True, 3, None, None, "2023-02-29"), (3, "a", False, None, 1, None, "x"), (4, "a", False, None, 1, 1, None), (5, "b", False, 4, 1, 1, "2024-01-01"), (6, "c", False, 6, 1, 1, "2024-01-01")],
    )
    spans = values(spark, "page int, t string, s int, e int, raw string", [(1, "see FD  1 now", 4, 9, "FD 1"), (9, "see", 0, 9, "see")])
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return validate.report(
        {
            "one live row": validate.one_live(rows, ["k"], F.col("superseded_by").isNull()),
            "moves together": validate.together(rows, ["m1", "m2"]),
            "orphan lines": validate.orphans(line, "l_orderkey", orders, "o_orderkey"),
            "human replaced": validate.human_superseded(rows, "id", "human"),
            "backward": validate.backward(rows, "id"),
            "impossible date": validate.impossible_dates(rows, "day"),
            "span": validate.wrong_spans(spans, "t", "s", "e", "raw"),
            "beyond pages": validate.beyond(spans.withColumn("doc", F.lit(1)), "page", values(spark, "doc int, n int", [(1, 5)]), "doc", "n"),
        }
    )


@query(
    """SELECT section, MIN(o_orderkey) AS first, MAX(o_orderkey) AS last, COUNT(*) AS n FROM (SELECT o_orderkey, CAST(floor((ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) / 4000) + 1 AS BIGINT) AS section FROM orders) GROUP BY section"""
)
def sitemap_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sitemap(table(spark, sf_dir, "orders"), "o_orderkey", 4000)


@query(
    """SELECT p_partkey, CAST(floor(p_partkey / 1000) * 1000 AS BIGINT) AS band, CASE WHEN regexp_matches(upper(substr(p_name, 1, 1)), '^[A-Z]$') THEN upper(substr(p_name, 1, 1)) ELSE '0' END AS letter, CAST(ceil(p_retailprice * 1000 / 65536) * 65536 AS BIGINT) AS grain FROM part"""
)
def registry_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.band(F.col("p_partkey")).alias("band"), S.letter(F.col("p_name")).alias("letter"), S.size_grain(F.col("p_retailprice") * 1000).alias("grain"))


@query(
    """SELECT * FROM (VALUES (1, '2024-02-03', 'acme rr co', 'x', '2026-09-03'), (2, NULL, 'b & c inc', 'a, b', NULL), (3, '2024-13-40', 'd', 'q', '2026-09-03')) t(id, iso, norm, unit, written)"""
)
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "id int, cell string, name string, rep string, said string", [(1, "2/3/2024", "Acme Railroad Company", "x, x, x", "Sept. 3, 2026"), (2, "--", "B and C, Inc.", "a, b", "not a date"), (3, "13/40/2024", "D", "q", "9/3/2026")])
    return rows.select("id", S.printed_date(S.or_null(F.col("cell"))).alias("iso"), S.normal_name(F.col("name")).alias("norm"), S.unrepeated(F.col("rep")).alias("unit"), F.date_format(S.written_date(F.col("said")), "yyyy-MM-dd").alias("written"))
