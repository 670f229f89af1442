"""Change capture: the crawl log folded into current items and their history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from tanadex.functions import scalars
from tanadex.model import DEFAULT_CURRENCY, DEFAULT_STATUS, HISTORY_COLUMNS, PRICE_REASON
from tanadex.operators import scale

# Facts of a log row that a change of price takes along.
FACTS = ("crawl_time", "dt", "currency")
FIRST_SEEN = ("brand_name", "model_name", "model_no", "currency", "image_sha256",
              "image_original_key", "image_thumb_300_key", "image_thumb_600_key")


@dataclass(frozen=True)
class Skew:
    """How finely the history of every item is split over tasks."""

    chunk_rows: int = scale.CHUNK_ROWS


def pending_log(log: DataFrame, cursor: int = 0, limit: int | None = None) -> DataFrame:
    """Successful rows past the cursor; with a limit, the oldest ones."""
    rows = log.where((F.col("log_id") > cursor) & (F.col("status") == "success"))
    return rows.orderBy("log_id").limit(limit) if limit else rows


def pending_count(log: DataFrame, cursor: int = 0) -> DataFrame:
    return pending_log(log, cursor).agg(F.count(F.lit(1)).alias("n_pending"))


def _checked_log(log: DataFrame) -> DataFrame:
    """Add the item key, the whole-unit price and the reason a row is unusable."""
    kind = log.schema["price"].dataType.simpleString()
    uid = scalars.source_uid("site", "category", "item_id")
    problem = F.when(uid.isNull(), "blank site, category or item_id")
    if kind in ("double", "float"):
        number = F.col("price")
        broken = F.isnan(number) | (F.abs(number) == float("inf"))
        problem = F.coalesce(problem, F.when(broken, "price is not finite"))
    return (log.withColumn("uid", uid).withColumn("problem", problem)
            .withColumn("amount", F.when(F.col("problem").isNull(),
                                         scalars.normalize_price_typed("price", kind))))


def valid_log(log: DataFrame) -> DataFrame:
    """Rows that can be applied, with ``source_uid`` and ``price`` normalised."""
    kept = _checked_log(log).where(F.col("problem").isNull())
    return (kept.withColumn("source_uid", F.col("uid")).withColumn("price", F.col("amount"))
            .drop("uid", "problem", "amount"))


def rejected_log(log: DataFrame) -> DataFrame:
    bad = _checked_log(log).where(F.col("problem").isNotNull())
    return bad.select("log_id", "site", "category", "item_id", F.col("problem").alias("error"))


def _base_rows(snapshot: DataFrame) -> DataFrame:
    """One row per known item that stands before all its log rows."""
    return snapshot.select(
        "source_uid", F.lit(-1).cast("bigint").alias("log_id"),
        F.col("price").cast("bigint").alias("price"), F.col("version").cast("bigint").alias("base"),
        F.col("last_crawl_time").alias("crawl_time"), F.col("last_seen_dt").alias("dt"), "currency")


def observed_prices(valid: DataFrame, snapshot: DataFrame | None = None,
                    null_price: str = "absorb", skew: Skew = Skew()) -> DataFrame:
    """Each log row with the price before it, whether it changed, and the version after.

    The price of an item is compared in log order. With ``absorb`` a null price ends
    the item's changes for good; with ``skip`` rows without a price are passed over.

    The rows of every item are cut into ranges of log ids. Ranges are compared inside
    their own group; one summary row per range (its first and last price, its changes,
    whether it holds a null) carries the state across, so no item is too large for a task.
    """
    rows = valid.select("source_uid", "log_id", "price",
                        F.lit(None).cast("bigint").alias("base"), *FACTS)
    if snapshot is not None:
        rows = rows.unionByName(_base_rows(snapshot))
    if null_price == "skip":
        rows = rows.where(F.col("price").isNotNull() | (F.col("log_id") < 0))

    chunk = F.floor(F.col("log_id") / F.lit(skew.chunk_rows)).cast("bigint")

    each = W.partitionBy("source_uid", "chunk").orderBy("log_id")
    earlier = each.rowsBetween(W.unboundedPreceding, -1)

    def compared(part: DataFrame) -> DataFrame:
        steps = (part
                 .withColumn("pos", F.row_number().over(each))
                 .withColumn("before", F.lag("price").over(each))
                 .withColumn("stuck", F.coalesce(F.max(F.col("price").isNull()).over(earlier), F.lit(False))))
        if null_price == "skip":
            steps = steps.withColumn("stuck", F.lit(False))
        differs = ~F.col("price").eqNullSafe(F.col("before"))
        if null_price == "skip":
            differs = differs & F.col("before").isNotNull()
        return steps.withColumn("inner", (F.col("pos") > 1) & ~F.col("stuck") & differs)

    main = compared(rows.withColumn("chunk", chunk))
    main = main.withColumn("running", F.sum(F.col("inner").cast("bigint")).over(each))
    main = main.withColumn("base_here", F.max("base").over(each))

    pieces = (main.groupBy("source_uid", "chunk")
              .agg(F.min_by("price", "log_id").alias("first_price"),
                   F.max_by("price", "log_id").alias("last_price"),
                   F.max(F.col("price").isNull()).alias("has_null"),
                   F.max("base").alias("piece_base"),
                   F.sum(F.col("inner").cast("bigint")).alias("n_inner")))
    carried = _carried_state(pieces, null_price)

    joined = main.join(carried, ["source_uid", "chunk"], "left")
    has_carry = F.coalesce("has_carry", F.lit(False))
    carry_stuck = F.coalesce("carry_stuck", F.lit(False))
    at_edge = (F.col("pos") == 1) & has_carry
    edge_differs = ~F.col("price").eqNullSafe(F.col("carry_price"))
    if null_price == "skip":
        edge_differs = edge_differs & F.col("carry_price").isNotNull()
    changed = ~carry_stuck & (F.col("inner") | (at_edge & edge_differs))
    edge_change = F.when(has_carry & ~carry_stuck, F.coalesce("edge_change", F.lit(0))).otherwise(0)
    count = F.when(carry_stuck, F.coalesce("carry_count", F.lit(0))).otherwise(
        F.coalesce("carry_count", F.lit(0)) + edge_change + F.col("running"))
    version = F.greatest(F.coalesce("base_here", "carry_base", F.lit(1)), F.lit(1)) + count
    return (joined.where(F.col("log_id") >= 0)
            .select("source_uid", "log_id", "price",
                    F.when(at_edge, F.col("carry_price")).otherwise(F.col("before")).alias("old_price"),
                    changed.alias("changed"), version.cast("bigint").alias("version"), *FACTS))


def _carried_state(pieces: DataFrame, null_price: str) -> DataFrame:
    """State that each range of a hot item takes over from the ranges before it."""
    in_order = W.partitionBy("source_uid").orderBy("chunk")
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    state = (pieces
             .withColumn("has_carry", F.row_number().over(in_order) > 1)
             .withColumn("carry_price", F.lag("last_price").over(in_order))
             .withColumn("carry_stuck", F.coalesce(F.max("has_null").over(before), F.lit(False)))
             .withColumn("carry_base", F.max("piece_base").over(before)))
    differs = ~F.col("first_price").eqNullSafe(F.col("carry_price"))
    if null_price == "skip":
        state = state.withColumn("carry_stuck", F.lit(False))
        differs = differs & F.col("carry_price").isNotNull()
    edge = F.col("has_carry") & ~F.col("carry_stuck") & differs
    state = (state.withColumn("edge_change", edge.cast("bigint"))
             .withColumn("n_changes", F.when(F.col("carry_stuck"), F.lit(0).cast("bigint"))
                         .otherwise(F.col("n_inner") + F.col("edge_change"))))
    return (state.withColumn("carry_count", F.coalesce(F.sum("n_changes").over(before), F.lit(0)))
            .select("source_uid", "chunk", "has_carry", "carry_price", "carry_stuck",
                    "carry_base", "edge_change", "carry_count"))


def price_changes(valid: DataFrame, snapshot: DataFrame | None = None,
                  null_price: str = "absorb", skew: Skew = Skew()) -> DataFrame:
    observed = observed_prices(valid, snapshot, null_price, skew)
    return (observed.where("changed")
            .select("source_uid", "log_id", "old_price", F.col("price").alias("new_price"),
                    "version", *FACTS))


def price_history(changes: DataFrame) -> DataFrame:
    """History rows of price changes, keyed so that a replay yields the same rows."""
    return changes.select(
        "dt", "source_uid", F.col("crawl_time").alias("change_time"),
        F.lit("price").alias("change_type"),
        F.col("old_price").cast("string").alias("old_value"),
        F.col("new_price").cast("string").alias("new_value"),
        F.coalesce("currency", F.lit(DEFAULT_CURRENCY)).alias("currency"),
        F.lit(PRICE_REASON).alias("reason"), "log_id",
        F.col("version").alias("item_version"),
        scalars.price_event_key("source_uid", "log_id", "new_price").alias("event_key"))


def new_history(events: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Events whose key is not yet stored, one row per key."""
    events = events.dropDuplicates(["event_key"]).select(*HISTORY_COLUMNS)
    if existing is None:
        return events
    return events.join(existing.select("event_key"), "event_key", "left_anti").select(*HISTORY_COLUMNS)


def _by_log(columns, pick):
    return pick(F.struct(*[F.col(c) for c in columns]), F.col("log_id"))


def first_seen(valid: DataFrame) -> DataFrame:
    """What the first log row of an item fixes for good."""
    seen = valid.groupBy("source_uid").agg(
        _by_log(("site", "category", "item_id", *FIRST_SEEN, "price", "dt"), F.min_by).alias("f"),
        F.min("log_id").alias("first_log_id"))
    return seen.select("source_uid", "first_log_id", "f.site", "f.category", "f.item_id",
                       *[F.col(f"f.{c}").alias(c) for c in FIRST_SEEN],
                       F.col("f.price").alias("first_price"), F.col("f.dt").alias("first_seen_dt"))


def last_seen(valid: DataFrame) -> DataFrame:
    """What every later log row overwrites: by log order, so dates may go back."""
    seen = valid.groupBy("source_uid").agg(
        _by_log(("dt", "crawl_time", "product_url"), F.max_by).alias("l"),
        F.max("log_id").alias("last_log_id"))
    return seen.select("source_uid", F.col("l.dt").alias("last_seen_dt"),
                       F.col("l.crawl_time").alias("last_crawl_time"), "last_log_id",
                       F.col("l.product_url").alias("product_url"))


def current_items(valid: DataFrame, snapshot: DataFrame | None = None,
                  null_price: str = "absorb", skew: Skew = Skew(), top_id: int | None = None) -> DataFrame:
    """The item table after applying the log to the last snapshot.

    New items are numbered after ``top_id``, or after the largest id of the snapshot. Wide columns are reduced to one row per item before they are shuffled; only key,
    log id and price take part in the ordered comparison.
    """
    names = ("site", "category", "item_id", *FIRST_SEEN)
    usable = F.col("price").isNotNull() if null_price == "skip" else F.lit(True)
    seen = valid.groupBy("source_uid").agg(
        _by_log((*names, "dt", "crawl_time"), F.min_by).alias("f"),
        _by_log(("dt", "crawl_time", "product_url"), F.max_by).alias("l"),
        F.max("log_id").alias("last_log_id"),
        F.max_by("price", F.when(usable, F.col("log_id"))).alias("last_price"),
        F.max(F.col("price").isNull()).alias("null_seen"))
    changed = (observed_prices(valid, snapshot, null_price, skew).where("changed")
               .groupBy("source_uid").agg(F.max_by("crawl_time", "log_id").alias("changed_at"),
                                          F.max_by("dt", "log_id").alias("changed_dt"),
                                          F.max("version").alias("new_version")))
    merged = (seen.join(changed, "source_uid", "left")
              .join(_new_numbers(valid, snapshot), "source_uid", "left"))
    absorbed = F.col("null_seen") if null_price == "absorb" else F.lit(False)
    fresh_price = F.when(absorbed, F.lit(None)).otherwise(F.col("last_price"))
    if snapshot is None:
        return merged.select(
            (F.col("new_no") + (top_id or 0)).alias("id"), "source_uid", *[F.col(f"f.{c}").alias(c) for c in names],
            fresh_price.cast("bigint").alias("price"), F.col("l.product_url").alias("product_url"),
            F.lit(DEFAULT_STATUS).alias("status"), F.lit(None).cast("bigint").alias("product_id"),
            F.col("f.dt").alias("first_seen_dt"), F.col("l.dt").alias("last_seen_dt"),
            F.lit(None).cast("date").alias("sold_dt"), F.lit(None).cast("string").alias("sold_reason"),
            F.col("l.crawl_time").alias("last_crawl_time"), "last_log_id",
            F.col("changed_at").alias("price_last_changed_at"),
            F.col("changed_dt").alias("price_last_changed_dt"),
            F.coalesce("new_version", F.lit(1)).cast("int").alias("version"),
            F.col("f.crawl_time").alias("created_at"), F.col("l.crawl_time").alias("updated_at"))

    old = snapshot.select(F.col("source_uid"), F.struct(
        *[F.col(c) for c in snapshot.columns]).alias("s"))
    both = merged.join(old, "source_uid", "full_outer")
    known = F.col("s").isNotNull()
    kept = [F.when(known, F.col(f"s.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in names]
    seen_now = F.col("last_log_id").isNotNull()
    old_price = F.col("s.price").cast("bigint")
    next_price = F.when(seen_now, fresh_price).otherwise(old_price)
    if null_price == "skip":
        next_price = F.coalesce(next_price, old_price)
    else:
        next_price = F.when(known & old_price.isNull(), F.lit(None)).otherwise(next_price)
    top = snapshot.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top_id")).scalar() if top_id is None else F.lit(top_id)
    return both.select(
        F.coalesce(F.col("s.id"), F.col("new_no") + top).alias("id"), "source_uid", *kept,
        next_price.cast("bigint").alias("price"),
        F.when(seen_now, F.col("l.product_url")).otherwise(F.col("s.product_url")).alias("product_url"),
        F.coalesce("s.status", F.lit(DEFAULT_STATUS)).alias("status"),
        F.col("s.product_id").alias("product_id"),
        F.coalesce("s.first_seen_dt", "f.dt").alias("first_seen_dt"),
        F.when(seen_now, F.col("l.dt")).otherwise(F.col("s.last_seen_dt")).alias("last_seen_dt"),
        F.col("s.sold_dt").alias("sold_dt"), F.col("s.sold_reason").alias("sold_reason"),
        F.when(seen_now, F.col("l.crawl_time")).otherwise(F.col("s.last_crawl_time")).alias("last_crawl_time"),
        F.coalesce("last_log_id", "s.last_log_id").alias("last_log_id"),
        F.coalesce("changed_at", "s.price_last_changed_at").alias("price_last_changed_at"),
        F.coalesce("changed_dt", "s.price_last_changed_dt").alias("price_last_changed_dt"),
        F.coalesce("new_version", "s.version", F.lit(1)).cast("int").alias("version"),
        F.coalesce("s.created_at", "f.crawl_time").alias("created_at"),
        F.when(seen_now, F.col("l.crawl_time")).otherwise(F.col("s.updated_at")).alias("updated_at"))


def _new_numbers(valid: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    """1, 2, 3 … for items not yet known, in order of their first log row."""
    firsts = valid.groupBy("source_uid").agg(F.min("log_id").alias("first_log_id"))
    if snapshot is not None:
        firsts = firsts.join(snapshot.select("source_uid"), "source_uid", "left_anti")
    return (scale.dense_number(firsts, "first_log_id", name="new_no")
            .select("source_uid", "new_no"))


def not_seen(items: DataFrame, as_of, days: int) -> DataFrame:
    """Active items last seen more than ``days`` before ``as_of``, marked sold on that day."""
    as_of = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    gone = items.where((F.col("status") == "active")
                       & (F.col("last_seen_dt") < F.date_sub(as_of, days)))
    return (gone.withColumn("status", F.lit("sold")).withColumn("sold_dt", as_of)
            .withColumn("sold_reason", F.lit(f"not_seen_for_{days}_days")))


def status_history(sold: DataFrame, run_time, old_status: str = "active") -> DataFrame:
    """History rows of items whose status changed on their ``sold_dt``."""
    return sold.select(
        F.col("sold_dt").alias("dt"), "source_uid", run_time.alias("change_time"),
        F.lit("status").alias("change_type"), F.lit(old_status).alias("old_value"),
        F.col("status").alias("new_value"), F.lit(None).cast("string").alias("currency"),
        F.col("sold_reason").alias("reason"), F.lit(None).cast("bigint").alias("log_id"),
        F.col("version").cast("bigint").alias("item_version"),
        scalars.status_event_key("source_uid", "sold_dt", "status").alias("event_key"))


def sync_stats(pending: DataFrame, changes: DataFrame, written: DataFrame) -> DataFrame:
    """Totals of a run: rows read, applied, rejected, price changes, history rows."""
    read = _checked_log(pending).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("problem").isNull()).alias("success"),
        F.count_if(F.col("problem").isNotNull()).alias("failed"))
    one = F.count(F.lit(1))
    return read.select("*", changes.agg(one).scalar().alias("price_changed"),
                       written.agg(one).scalar().alias("history_written"))


def next_cursor(pending: DataFrame, cursor: int = 0) -> DataFrame:
    """The largest log id read, rejected rows included; unchanged when nothing was read."""
    return pending.agg(F.coalesce(F.max("log_id"), F.lit(cursor).cast("bigint")).alias("cursor"))
