"""Times in which an item was not seen: gaps between its observation days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanadex.functions import scalars
from tanadex.operators.changes import HISTORY_COLUMNS

GONE, BACK = "sold", "active"


def observation_days(valid: DataFrame) -> DataFrame:
    """(source_uid, dt): each day on which an item was seen, once. An item has no more of them than the calendar."""
    return valid.where(F.col("dt").isNotNull()).select("source_uid", "dt").distinct()


def absences(days_seen: DataFrame, days: list[int], as_of: Column | None = None) -> DataFrame:
    """(days, source_uid, last_seen_dt, gone_dt, back_dt, n_days): every time an item was not seen for more than ``days``.

    All limits are judged in one pass over each item's days. An item counts as gone from the first day that lies more
    than ``days`` behind the last one it was seen on, until it is seen again, or has a null ``back_dt`` on ``as_of``, the
    last day that is wholly known (default: the last day seen of any item). ``n_days`` is the length of the absence.
    """
    until = as_of if as_of is not None else days_seen.agg(F.max("dt")).scalar()
    gaps = (days_seen.withColumn("as_of", until).where(F.col("dt") <= F.col("as_of"))
            .withColumn("back_dt", F.lead("dt").over(W.partitionBy("source_uid").orderBy("dt"))))
    each = gaps.withColumn("days", F.explode(F.array(*[F.lit(n) for n in days])))
    gone = each.withColumn("gone_dt", F.date_add("dt", F.col("days") + 1))
    # A day on which an item is seen again is known, so it may itself be the first day of its absence.
    over = F.coalesce("back_dt", "as_of")
    return gone.where(F.col("gone_dt") <= over).select(
        "days", "source_uid", F.col("dt").alias("last_seen_dt"), "gone_dt", "back_dt",
        F.date_diff(over, F.col("gone_dt")).alias("n_days"))


def absence_events(gone: DataFrame) -> DataFrame:
    """(days, source_uid, last_seen_dt, dt, old_value, new_value): the changes of status that absences stand for."""
    change = F.array(
        F.struct(F.col("gone_dt").alias("dt"), F.lit(BACK).alias("old_value"), F.lit(GONE).alias("new_value")),
        F.struct(F.col("back_dt").alias("dt"), F.lit(GONE).alias("old_value"), F.lit(BACK).alias("new_value")))
    return gone.select("days", "source_uid", "last_seen_dt", F.inline(change)).where(F.col("dt").isNotNull())


def absence_history(events: DataFrame, run_time: Column) -> DataFrame:
    """History rows of such changes, with the columns and event keys of the price history."""
    rows = events.withColumns({
        "change_time": run_time, "change_type": F.lit("status"), "currency": F.lit(None).cast("string"),
        "reason": F.format_string("%s_for_%d_days", F.when(F.col("new_value") == GONE, "not_seen").otherwise("seen_after_more"),
                                  F.col("days")),
        "log_id": F.lit(None).cast("bigint"), "item_version": F.lit(None).cast("bigint"),
        "event_key": scalars.status_event_key("source_uid", "dt", "new_value")})
    return rows.select(*HISTORY_COLUMNS)
