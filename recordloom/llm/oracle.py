"""SQL that finds the rows of the operators that SQL can express, over the same tables."""

from __future__ import annotations

from recordloom.llm import licenses

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _licences() -> str:
    """Every template tried at every place of every document, which is padded with empty words."""
    templates, pad = licenses._templates(), 64

    def word(start: str, at: int, value: str) -> str:
        return f"p[{start} + {at}] = '{value}'"

    shares = []
    for t in templates:
        phrase = " AND ".join(word("s", at + k, w) for at, ws in t.phrases for k, w in enumerate(ws))
        counted = [k for k, w in enumerate(t.words) if w not in licenses._PLAIN]
        agree = " + ".join(f"CAST({word('s', k, t.words[k])} AS INTEGER)" for k in counted)
        need = min(licenses.MATCHES, len({t.words[k] for k in counted}))
        held = f"list_contains(w, '{t.phrases[0][1][-1]}')"
        shares.append(f"CASE WHEN {held} THEN list_max(list_transform(list_filter(range(1, len(p) - {len(t.words)} + 2), lambda s: {phrase} AND {agree} >= {need}), lambda s: ({agree}) / {len(counted)}.0)) END")
    base = ", ".join(
        "list_filter(range(1, len(p) - 3), lambda s: " + " AND ".join(word("s", k, w) for k, w in enumerate(phrase.split())) + ")" for phrase in licenses.BASE
    )
    names = ", ".join(f"CASE WHEN len(b[{n + 1}]) > 0 THEN '{label}' END" for n, label in enumerate(licenses.BASE.values()))
    more = ", ".join(f"CASE WHEN t[{n + 1}] IS NOT NULL THEN '{t.label}' END" for n, t in enumerate(templates))

    def joined(labels: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list_filter([{labels}], lambda x: x IS NOT NULL))), ',')"

    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, list_concat(list_transform(range({pad}), lambda x: ''), w, list_transform(range({pad}), lambda x: '')) AS p FROM d),
m AS (SELECT doc_id, len(w) AS n_words, [{base}] AS b, [{", ".join(shares)}] AS t FROM p)
SELECT doc_id, n_words, len(flatten(b)) AS n_base, list_min(flatten(b)) - {pad + 1} AS first_word, list_max(flatten(b)) - {pad + 1} AS last_word, {joined(names)} AS base_labels, {joined(names + ", " + more)} AS labels,
    CASE WHEN len(flatten(b)) > 0 THEN 1.0 ELSE coalesce(list_max(t), 0.0) END AS score FROM m"""


QUALITY = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, {_SPACED} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT r, i, COUNT(*) OVER (PARTITION BY r, array_to_string(w[i:i+7], ' ')) AS c FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
c AS (SELECT r, COUNT(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest(generate_series(i, i + 7)) AS k FROM p WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, t, l, w, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN c ON d.r = c.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND n_symbols <= 0.1 * n_words AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 2 * n_dup_lines <= len(l)
    AND len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) <= 0.2 * n_words AND len(regexp_extract_all(t, '\p{{Lu}}')) <= 0.4 * word_chars
    AND len(regexp_extract_all(t, '[!?]{{2,}}')) <= 0.1 * n_words AND len(regexp_extract_all(t, '(?m)(?:\.\.\.|…)$')) <= 0.3 * len(l) AS kept FROM f"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w, ROW_NUMBER() OVER () AS t FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
bw AS (SELECT item_id, t, n, i AS o, array_to_string(w[i:i+n-1], ' ') AS s FROM (SELECT item_id, t, w, least(13, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n AS n, item_id, t, o FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
h AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
g AS (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY doc_id, t, i - o ORDER BY i) AS g FROM m),
x AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS item, MIN(i) AS s, MIN(o) AS o, MAX(i + n) - MIN(i) AS longest FROM g GROUP BY doc_id, item_id, t, i - o, g),
y AS (SELECT * FROM x QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY longest DESC, s, item, o) = 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated, coalesce(longest, 0) AS longest_match, s - 1 AS longest_at, item AS longest_item, o - 1 AS longest_item_at
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN y ON d.doc_id = y.doc_id"""

# No page of the tables states a canonical link or a redirect, so a component is one plain spelling.
URLS = r"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '([?&])(?:(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*(?:&|$))+', '\1', 'g'), '[?&]+$', '') AS bare FROM pages),
u(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
r AS (SELECT page_id, arg_max(u.host || u.path, length(u.host || u.path)) AS rule, arg_max(u.verdict, length(u.host || u.path)) AS own
    FROM p JOIN u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path) GROUP BY page_id),
n AS (SELECT p.page_id, p.host, p.path, rule, own, CASE WHEN p.host <> '' THEN regexp_replace(p.host, '^www\.', '') || regexp_replace(regexp_extract(bare, '://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(bare, '(\?.*)$', 1) END AS node
    FROM p LEFT JOIN r ON p.page_id = r.page_id)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN node IS NOT NULL THEN MIN(own) OVER (PARTITION BY node) END, 'allow') AS verdict FROM n"""

LINES = r"""
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS idx FROM documents),
q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY idx) AS k, SUM(nw) OVER (PARTITION BY doc_id ORDER BY idx) AS c
    FROM (SELECT doc_id, idx, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM a) WHERE nw > 0),
v AS (SELECT x.doc_id, x.k AS s, MIN(y.k) AS e FROM q x JOIN q y ON x.doc_id = y.doc_id AND y.k >= x.k AND y.k < x.k + 20 AND y.c - x.c + x.nw >= 20 GROUP BY 1, 2
    UNION SELECT y.doc_id, MAX(x.k), y.k FROM q x JOIN q y ON x.doc_id = y.doc_id AND y.k >= x.k AND y.k < x.k + 20 AND y.c - x.c + x.nw >= 20 GROUP BY y.doc_id, y.k),
t AS (SELECT v.doc_id, s, e, string_agg(line, chr(10) ORDER BY k) AS txt, MIN(idx) AS i0, MAX(idx) AS i1 FROM v JOIN q ON v.doc_id = q.doc_id AND k BETWEEN s AND e GROUP BY 1, 2, 3),
f AS (SELECT txt, MIN(doc_id * 1000000 + i0) AS f FROM t GROUP BY txt),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i0, i1)) AS idx FROM t JOIN f ON t.txt = f.txt WHERE doc_id * 1000000 + i0 > f),
o AS (SELECT a.doc_id, coalesce(string_agg(CASE WHEN g.idx IS NULL THEN line END, chr(10) ORDER BY a.idx), '') AS text, COUNT(g.idx) AS n_removed_lines FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.idx = g.idx GROUP BY 1)
SELECT doc_id, text, n_removed_lines FROM o"""

SQL = {
    "op1_license_scans": _licences(),
    "op3_quality_rules": QUALITY,
    "op6_benchmark_decontamination": DECONTAMINATION,
    "op9_url_filters": URLS,
    "op10_line_dedup": LINES,
}
