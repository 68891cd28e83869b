"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects by an expression over a document's measures or its text.  On a bounded
sample every rule is timed (the least of some runs, less what reading takes) and it is counted
which rules reject the same documents.  The rule asked first is the one with the most rejections
per second; next comes the one with the most among what that leaves, and so on, and a document that
one rejects is not shown to the next.  The order changes what is spent, never what is kept.

All measures come from the document's own row; nothing is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import once, spaced_words, without
from recordloom.storage import drop, save

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Documents that rules are tried on, about.
SAMPLE_ROWS = 4000
#: Times that each rule is timed, after one run that isn't.
TIMED = 3


class Rule(NamedTuple):
    name: str
    rejects: Callable[[], Column]  # over ``_t`` (the text) and the measures


def _per_word(count: Column) -> Column:
    return count / F.greatest(F.col("n_words"), F.lit(1))


_LETTERLESS = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"
#: Rules in no particular order; thresholds are those of published web-text filters, or wider.
RULES = [
    Rule("symbols", lambda: _per_word(F.col("n_symbols")) > 0.1),
    Rule("word length", lambda: ~_per_word(F.col("word_chars")).between(3, 10)),
    Rule("repeated lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    Rule("words without letters", lambda: _per_word(F.regexp_count("_t", F.lit(_LETTERLESS))) > 0.2),
    Rule("capitals", lambda: F.regexp_count("_t", F.lit(r"\p{Lu}")) > 0.4 * F.col("word_chars")),
    Rule("exclamations", lambda: _per_word(F.regexp_count("_t", F.lit("[!?]{2,}"))) > 0.1),
    Rule("unfinished lines", lambda: F.regexp_count("_t", F.lit(r"(?m)(?:\.\.\.|…)$")) > 0.3 * F.col("n_lines")),
]


def _row(column: str, k: Column) -> Column:
    return F.get(F.col(column), k)


def measures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs``, the text as ``_t`` and its measures.

    ``n_words`` and ``word_chars`` (code points in words); ``n_symbols``; ``n_lines`` (with a word); ``n_dup_lines`` (lines with
    a word that equal an earlier one); ``n_repeat_words`` (words in windows of eight words that
    stand in the text twice or more; windows are compared by 64-bit hash).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*keep, text.alias("_t"), once(spaced_words(text)).alias("_w"))
    window = F.transform(
        F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[_row("_w", i + k) for k in range(WINDOW)])
    )
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        *keep,
        "_t",
        F.size("_w").cast("long").alias("n_words"),
        once(F.when(F.size("_w") >= WINDOW, window)).alias("_h"),
        once(lines).alias("_l"),
    )
    doubled = F.size("_h") > F.size(F.array_distinct("_h"))
    df = df.select(
        *keep,
        "_t",
        "n_words",
        F.length(without(F.col("_t"), " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        (F.octet_length("_t") - F.octet_length(without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        # Windows in the order of their hashes: equal ones are neighbours.
        once(F.when(doubled, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).alias("_s"),
    )
    seen = ["_t", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    twice = F.transform("_s", lambda e, k: F.when((e["h"] == _row("_s", k - 1)["h"]) | (e["h"] == _row("_s", k + 1)["h"]), e["i"]))
    df = df.select(*keep, *seen, once(F.sort_array(F.array_compact(twice))).alias("_p"))
    covered = F.aggregate(
        F.transform("_p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(_row("_p", k + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda n, x: n + x,
    )
    return df.select(*keep, *seen, once(F.coalesce(covered, F.lit(0)).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def cascade(rules: list[Rule], costs: list[float], together: dict[tuple[bool, ...], int]) -> list[Rule]:
    """``rules`` by rejections per cost among what the rules before leave; ``together`` counts documents by which
    rules reject them."""
    left, order = list(range(len(rules))), []
    while left:
        alive = {flags: n for flags, n in together.items() if not any(flags[k] for k in order)}

        def worth(k: int) -> float:
            return (sum(n for flags, n in alive.items() if flags[k]) + 0.5) / costs[k]

        order.append(max(left, key=worth))
        left.remove(order[-1])
    return [rules[k] for k in order]


def rule_order(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` as a cascade, by their cost and selectivity on a sample of ``rows`` documents, about."""
    total = docs.count()
    if not total:
        return list(rules)
    share = min(1.0, rows / total)
    sample = save(measures(docs.select(text_col).sample(share, 17), [], text_col), "quality")
    tried = sample.where(~base_failed())
    flags = tried.groupBy(*[rule.rejects().alias(f"r{k}") for k, rule in enumerate(rules)]).agg(F.count(F.lit(1)).alias("n"))
    together = {tuple(bool(r[f"r{k}"]) for k in range(len(rules))): r["n"] for r in flags.collect()}  # 2 ** rules rows at most
    took = []
    for rule in [Rule("reading", lambda: F.lit(False)), *rules]:
        asked, times = tried.agg(F.count_if(rule.rejects()), F.sum(F.octet_length("_t"))), []
        for _ in range(TIMED + 1):
            began = time.perf_counter()
            asked.collect()
            times.append(time.perf_counter() - began)
        took.append(min(times[1:]))
    drop(sample)
    n = max(1, sum(together.values()))
    return cascade(rules, [max(t - took[0], 1e-4) / n for t in took[1:]], together)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    ``base_failed`` if there are under 20 words, or over 30 % of them are in repeated windows.
    ``kept`` if that isn't so and no rule rejects.  A null text has no words and fails.  Null
    and repeated ids and repeated rows keep their rows; an empty table gives no rows; other
    columns are not read.
    """
    ordered = rule_order(docs, text_col, rules)
    kept = reduce(lambda kept, rule: kept & ~rule.rejects(), ordered, ~base_failed())
    found = measures(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"])
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(*names, base_failed().alias("base_failed"), kept.alias("kept"))
