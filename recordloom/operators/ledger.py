"""An append-only ledger and the states it implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def appended(events: DataFrame, known: DataFrame | None, key: list[str], order: str) -> DataFrame:
    """Observations to append: each key once (its first), and none that is known."""
    first = events.groupBy(*key).agg(F.min_by(F.struct(*events.columns), order).alias("e")).select("e.*")
    return first if known is None else first.join(known.select(*key), key, "left_anti")


def latest(events: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last observation of each key; combined before the shuffle, without a sort."""
    return events.groupBy(key).agg(F.max_by(F.struct(order, *columns), order).alias("e")).select(key, "e.*")


def as_known_at(events: DataFrame, key: str, order: str, at: str, when: Column, columns: list[str]) -> DataFrame:
    """The state that the ledger implied at a moment."""
    return latest(events.where(F.col(at) <= when), key, order, columns)


def changes(events: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Observations that differ from the one before of their key (the first always does)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = events.withColumns({"_before": F.lag(payload).over(w), "_n": F.row_number().over(w)})
    return marked.where((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col(payload))).withColumnRenamed("_before", "before").drop("_n")


def first_seen(events: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    return events.groupBy(key).agg(F.min_by(F.struct(order, *columns), order).alias("e")).select(key, "e.*")


def superseded_by(assertions: DataFrame, key: list[str], row_id: str) -> DataFrame:
    """Each assertion with the one that replaced it; null while it lives."""
    return assertions.withColumn("superseded_by", F.lead(row_id).over(Window.partitionBy(*key).orderBy(row_id)))


def compare(live: DataFrame, incoming: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """What an if-changed writer does for each key: unchanged, superseded, asserted or left."""
    new, old = F.struct(*[F.col(f"n.{v}") for v in values]), F.struct(*[F.col(f"l.{v}") for v in values])
    joined = live.withColumn("_l", F.lit(True)).alias("l").join(incoming.withColumn("_n", F.lit(True)).alias("n"), key, "full")
    action = (
        F.when(F.col("_n").isNull(), "left")
        .when(F.col("_l").isNull(), "asserted")
        .when(new.eqNullSafe(old), "unchanged")
        .otherwise("superseded")
    )
    return joined.select(*key, action.alias("action"))


def collisions(df: DataFrame, record: str, owner: str) -> DataFrame:
    """Records that stand under more than one owner."""
    return df.groupBy(record).agg(F.countDistinct(owner).alias("owners")).where("owners > 1")


def unanswered(events: DataFrame, key: str, order: str, asked: Column, answer: Column, last: int) -> DataFrame:
    """Of each key's last ``last`` questions, how many have no later answer."""
    answers = events.where(answer).groupBy(key).agg(F.max(order).alias("_answered"))
    asks = events.where(asked).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= last)
    joined = asks.join(answers, key, "left")
    return joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(F.col("_answered").isNull() | (F.col("_answered") < F.col(order))).alias("unanswered")
    )


def after_mark(events: DataFrame, marks: DataFrame, key: str, order: str, forward: Column) -> DataFrame:
    """Forward observations past each subscriber's mark; marks are ``(key, mark)``."""
    return events.where(forward).join(marks, key).where(F.col(order) > F.col("mark"))


def resting(attempts: DataFrame, key: str, at: str, status: str, now: Column, refused: list[str], short_days: int, long_days: int, failing: list[str]) -> DataFrame:
    """Keys not to be tried now: the latest attempt governs, and its status says how long to rest."""
    last = latest(attempts, key, at, [status])
    rest = F.when(F.col(status).isin(failing), short_days).when(F.col(status).isin(refused), long_days)
    return last.withColumn("rest_days", rest).where(rest.isNotNull() & (F.date_add(F.to_date(at), rest) > now))
