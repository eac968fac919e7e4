"""Leases: their state after a stream of requests, liveness gaps, and what their end deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.operators.sliced import even_slices, revision_slice, running_last, seconds_of

EVENTS = "lease_id bigint, op_id bigint, outcome string, keys array<string>"


def remaining_ttl(ttl: Column, last_renewed: Column, now: Column) -> Column:
    """Whole seconds left, never below 0."""
    return F.greatest(ttl - F.floor(now.cast("timestamp").cast("double") - last_renewed.cast("timestamp").cast("double")).cast("long"), F.lit(0))


def distinct_requests(lease_ops: DataFrame) -> DataFrame:
    """Requests without repeated deliveries: of an op_id the first to arrive. Null or zero lease ids are no requests."""
    kept = lease_ops.where(F.col("lease_id").isNotNull() & (F.col("lease_id") != 0))
    return kept.groupBy("op_id").agg(F.min_by(F.struct("ts", "op", "lease_id", "ttl", "key"), "arrived_at").alias("r")).select("op_id", "r.*")


def fold_lease(state: dict | None, op: str, ts: float, ttl: int | None, key: str | None) -> tuple[dict | None, str, list[str]]:
    """One request on one lease: the new state, the outcome, and keys set free.

    State: ttl, renewed (seconds), keys. A lease is expired once floor(now - renewed) >= ttl; it stays until it is
    revoked, so that granting it again fails, as does keeping it alive. Grants need a positive ttl.
    """
    expired = state is not None and (ts - state["renewed"]) // 1 >= state["ttl"]
    if op == "grant":
        if state is not None:
            return state, "exists", []
        if not ttl or ttl <= 0:
            return None, "invalid", []
        return {"ttl": ttl, "renewed": ts, "keys": []}, "granted", []
    if state is None:
        return None, "not found", []
    if op == "keepalive":
        return (state, "expired", []) if expired else ({**state, "renewed": ts}, "renewed", [])
    if op == "attach":
        if key is None or key in state["keys"]:
            return state, "ignored", []
        return {**state, "keys": [*state["keys"], key]}, "attached", []
    if op == "detach":
        return ({**state, "keys": [k for k in state["keys"] if k != key]}, "detached", []) if key in state["keys"] else (state, "ignored", [])
    if op == "revoke":
        return None, "revoked", sorted(state["keys"])
    return state, "ignored", []


def lease_outcomes(requests: DataFrame, slices: int | None = None) -> DataFrame:
    """Outcome of every request of every lease in the order of ts and op_id: lease_id, op_id, outcome, keys set free.

    Each outcome depends on the one before, but after a revoke a lease is gone whatever came before it. So leases are cut behind their
    revokes, found in slices of time, and each piece is folded in one task, request by request as they are read.
    """

    rows = requests.select("lease_id", "op_id", "op", "ts", F.col("ts").cast("timestamp").cast("double").alias("at"), "ttl", "key", seconds_of(F.col("ts")).alias("second"))
    rows = rows.withColumn("slice", even_slices(rows, F.col("second"), slices)(F.col("second"))).drop("second")
    ends = F.when(F.lower(F.trim("op")) == "revoke", F.col("op_id"))
    pieces = running_last(rows, ["lease_id"], "slice", ["ts", "op_id"], ends, "piece", inclusive=False)
    whole = pieces.repartition("lease_id", "piece").sortWithinPartitions("lease_id", "piece", "at", "op_id").select("lease_id", "op_id", "op", "at", "ttl", "key", "piece")

    def over(batches):
        import pandas as pd

        state, of = None, None
        for frame in batches:
            out = []
            for lease_id, op_id, op, at, ttl, name, piece in zip(*(frame[c] for c in ("lease_id", "op_id", "op", "at", "ttl", "key", "piece")), strict=True):
                piece = None if pd.isna(piece) else int(piece)
                if (lease_id, piece) != of:
                    of, state = (lease_id, piece), None
                state, outcome, freed = fold_lease(state, (op or "").strip().lower(), float(at), None if pd.isna(ttl) else int(ttl), name if isinstance(name, str) else None)
                out.append((lease_id, op_id, outcome, freed))
            yield pd.DataFrame(out, columns=["lease_id", "op_id", "outcome", "keys"])

    return whole.mapInPandas(over, EVENTS)


def liveness_gaps(requests: DataFrame, slices: int | None = None) -> DataFrame:
    """Consecutive signs of life of a lease that lie its ttl or more apart: lease_id, from_ts, to_ts, seconds, ttl.

    Signs of life are grants and keepalives; the ttl is that of the last grant before. Leases are cut into slices of time.
    """
    op = F.lower(F.trim("op"))
    signs = requests.where(op.isin("grant", "keepalive")).select("lease_id", "op_id", "ts", F.when(op == "grant", F.col("ttl")).alias("granted"), seconds_of(F.col("ts")).alias("at"))
    signs = signs.withColumn("slice", even_slices(signs, F.col("at"), slices)(F.col("at"))).drop("at")
    order = ["ts", "op_id"]
    timed = running_last(signs, ["lease_id"], "slice", order, F.col("granted"), "lasts", inclusive=False)
    timed = running_last(timed, ["lease_id"], "slice", order, F.col("ts"), "from_ts", inclusive=False)
    seconds = F.floor(F.col("ts").cast("timestamp").cast("double") - F.col("from_ts").cast("timestamp").cast("double")).cast("long")
    return timed.withColumn("seconds", seconds).where((F.col("lasts") > 0) & (F.col("seconds") >= F.col("lasts"))).select("lease_id", "from_ts", F.col("ts").alias("to_ts"), "seconds", F.col("lasts").alias("ttl"))


def standing_leases(leases: DataFrame) -> DataFrame:
    """One row per grant (id, granted_at), from its latest record: granted_ttl, last_renewed, revoked_at, keys."""
    kept = leases.where(F.col("id").isNotNull() & F.col("granted_at").isNotNull())
    return kept.groupBy("id", "granted_at").agg(F.max(F.struct("recorded_at", "revoked_at", "granted_ttl", "last_renewed", F.array_distinct(F.coalesce("keys", F.array())).alias("keys"))).alias("r")).select("id", "granted_at", "r.granted_ttl", "r.last_renewed", "r.revoked_at", "r.keys")


def expired_at(leases: DataFrame, now: Column) -> DataFrame:
    """Standing leases, not revoked, of which nothing is left at ``now``; a null ttl or renewal never expires."""
    left = remaining_ttl(F.col("granted_ttl"), F.col("last_renewed"), now)
    return leases.where(F.col("revoked_at").isNull() & F.col("granted_ttl").isNotNull() & F.col("last_renewed").isNotNull() & (left == 0))


def cascade(expired: DataFrame, live: DataFrame) -> DataFrame:
    """Live keys that the end of their leases deletes: id, key, mod_revision. A key of two leases goes with each."""
    return expired.select("id", F.explode("keys").alias("key")).join(live.select("key", "mod_revision"), "key").select("id", "key", "mod_revision")


def allocated_ids(grants: DataFrame) -> DataFrame:
    """The id each grant asks for or gets, in the order of ``at``: at, lease_id (null for a ttl that is not positive).

    ``grants``: at, lease_id, ttl. Id 0 or null takes the next id, from 1 on; an id that is asked for moves the next one past it. After j ids
    were given, the next is j + the greatest of 1 and (id + 1 - ids given before it) of those asked for: two running results, made
    in slices and carried over by a row per slice.
    """
    valid = grants.where(F.col("ttl") > 0).select("at", F.coalesce("lease_id", F.lit(0)).cast("long").alias("asked"))
    placed = valid.withColumn("slice", revision_slice(valid, "at"))
    auto = (F.col("asked") == 0).cast("long")
    inside = Window.partitionBy("slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    over_slices = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    given = placed.withColumn("given_here", F.coalesce(F.sum(auto).over(inside), F.lit(0)))
    floor_here = F.when(F.col("asked") > 0, F.col("asked") + 1 - F.col("given_here"))
    sums = given.groupBy("slice").agg(F.sum(auto).alias("given"), F.max(floor_here).alias("floor"))
    sums = sums.withColumn("given_before", F.coalesce(F.sum("given").over(over_slices), F.lit(0)))
    carried = sums.select("slice", "given_before", F.max(F.col("floor") - F.col("given_before")).over(over_slices).alias("floor_before"))
    joined = given.withColumn("floor_here", F.max(floor_here).over(inside)).join(F.broadcast(carried), "slice")  # at most MOST_SLICES rows
    before = F.col("given_before") + F.col("given_here")
    least = F.greatest(F.lit(1), F.coalesce("floor_before", F.lit(1)), F.coalesce(F.col("floor_here") - F.col("given_before"), F.lit(1)))
    found = joined.select("at", F.when(F.col("asked") == 0, before + least).otherwise(F.col("asked")).alias("lease_id"))
    return grants.select("at").join(found, "at", "left")


def attachments_left(outcomes: DataFrame, requests: DataFrame) -> DataFrame:
    """(lease_id, key) attached after all requests, by their outcomes: attached, not detached since, and the lease not revoked since."""
    placed = outcomes.select("op_id", "outcome").join(requests.select("op_id", "lease_id", "ts", "key"), "op_id").withColumn("place", F.struct("ts", "op_id"))
    when = lambda outcome: F.max(F.when(F.col("outcome") == outcome, F.col("place")))
    keys = placed.where(F.col("outcome").isin("attached", "detached")).groupBy("lease_id", "key").agg(when("attached").alias("on"), when("detached").alias("off"))
    ends = placed.where("outcome = 'revoked'").groupBy("lease_id").agg(F.max("place").alias("ended"))
    left = keys.join(ends, "lease_id", "left")
    return left.where(F.col("on").isNotNull() & (F.col("off").isNull() | (F.col("on") > F.col("off"))) & (F.col("ended").isNull() | (F.col("on") > F.col("ended")))).select("lease_id", "key")
