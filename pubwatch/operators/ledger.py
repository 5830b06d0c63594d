"""Delivery ledger as an append-only event table.

Events: delivery_id, event (claimed, sent, released), run_id, status, data_fingerprint, excel_path, message_id, event_seq.
Two appends may carry equal numbers, so events have a total order: number, kind (claimed, released, sent: what was sent
stays sent), run id.  The state of a delivery is its last event; if that is a claim, its holder is the first claim
since the delivery was last free, whatever order the rows come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubwatch.operators.dedupe import keep_first

_HELD = ("run_id", "status", "data_fingerprint", "excel_path", "message_id")
#: Which of several events with one number comes first, in the table and in the stream's state machine.
PRECEDENCE = ("claimed", "sent", "released")
_BY_FINALITY = ("claimed", "released", "sent")


def event_order() -> Column:
    """The total order of a delivery's events as one value."""
    kind = F.array_position(F.array(*[F.lit(e) for e in _BY_FINALITY]), F.col("event"))
    return F.struct(F.col("event_seq").alias("seq"), kind.alias("kind"), F.coalesce("run_id", F.lit("")).alias("writer"))


def ledger_state(events: DataFrame) -> DataFrame:
    """Current row per delivery; released deliveries are gone.

    Both groupings combine before their shuffle, so a delivery may hold any share of the events.  Claims are looked up
    again only where the last event is a claim and another claim may have come before it.
    """
    ordered = events.withColumn("_order", event_order())
    held = F.struct(*_HELD)
    latest = ordered.groupBy("delivery_id").agg(
        F.max_by(F.struct("event", held.alias("held"), "event_seq"), "_order").alias("_s"),
        F.max(F.when(F.col("event") != "claimed", F.col("_order"))).alias("_free"),
        F.count_if(F.col("event") == "claimed").alias("_claims"),
    ).where("_s.event <> 'released'")
    raced = latest.where("_s.event = 'claimed' and _claims > 1").select("delivery_id", "_free")
    claims = ordered.where("event = 'claimed'").join(raced, "delivery_id").where(F.col("_free").isNull() | (F.col("_order") > F.col("_free")))
    holders = claims.groupBy("delivery_id").agg(F.min_by(held, "_order").alias("_holder"))
    current = latest.join(holders, "delivery_id", "left").select("delivery_id", F.col("_s.event").alias("state"), F.coalesce("_holder", "_s.held").alias("_held"), F.col("_s.event_seq").alias("event_seq"))
    return current.select("delivery_id", "state", "_held.*", "event_seq")


def ledger_status(state: DataFrame) -> DataFrame:
    return state.groupBy("state").agg(F.count("*").alias("deliveries"))


def claim(runs: DataFrame, state: DataFrame, next_seq: Column) -> tuple[DataFrame, DataFrame]:
    """(claim events to append, refused runs with the reason).

    A run is refused if its run id was delivered under the old key scheme, or if its delivery id
    is claimed or sent.  Of several runs with one delivery id the first is taken.
    """
    legacy = state.select(F.col("delivery_id").alias("run_id")).withColumn("_legacy", F.lit(True))
    open_ids = state.where("state in ('claimed', 'sent')").select("delivery_id").withColumn("_open", F.lit(True))
    joined = runs.join(legacy, "run_id", "left").join(open_ids, "delivery_id", "left")
    reason = F.when(F.col("_legacy"), F.lit("legacy run_id already sent")).when(F.col("_open"), F.lit("already claimed or sent"))
    decided = joined.withColumn("reason", reason).drop("_legacy", "_open")
    fresh = keep_first(decided.where("reason is null"), [F.col("delivery_id")], [F.col("run_id")])
    events = fresh.select(
        "delivery_id", F.lit("claimed").alias("event"), "run_id", "status", "data_fingerprint", "excel_path",
        F.lit("").alias("message_id"), next_seq.alias("event_seq"),
    )
    return events, decided.where("reason is not null").select("delivery_id", "run_id", "reason")


def complete(requests: DataFrame, state: DataFrame, next_seq: Column) -> tuple[DataFrame, DataFrame]:
    """(sent events, requests for deliveries that are not claimed); ``requests``: delivery_id, message_id."""
    joined = requests.join(state.drop("message_id", "event_seq"), "delivery_id", "left")
    good = F.coalesce(F.col("state") == "claimed", F.lit(False))
    events = joined.where(good).select(
        "delivery_id", F.lit("sent").alias("event"), "run_id", "status", "data_fingerprint", "excel_path", "message_id", next_seq.alias("event_seq")
    )
    return events, joined.where(~good).select("delivery_id", F.lit("not claimed").alias("reason"))


def release(requests: DataFrame, state: DataFrame, next_seq: Column) -> DataFrame:
    """Release events for claimed deliveries; anything else is left as it is."""
    joined = requests.select("delivery_id").distinct().join(state.drop("event_seq"), "delivery_id").where("state = 'claimed'")
    return joined.select(
        "delivery_id", F.lit("released").alias("event"), "run_id", "status", "data_fingerprint", "excel_path",
        F.lit("").alias("message_id"), next_seq.alias("event_seq"),
    )


def recover(requests: DataFrame, state: DataFrame, next_seq: Column, confirmed: bool) -> DataFrame:
    if not confirmed:
        raise ValueError("recovering a claim needs an explicit confirmation")
    return release(requests, state, next_seq)
