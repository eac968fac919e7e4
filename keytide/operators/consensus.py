"""Rules of a replicated log as queries: commit points, votes, divergence, reads, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.operators.versions import numbered


def majority(n: Column) -> Column:
    """The least number of votes that is more than half."""
    return F.floor(n / 2) + 1


def has_quorum(votes: DataFrame, members: DataFrame) -> DataFrame:
    """Per ballot whether its distinct voters are a majority of every configuration: ballot, votes, quorum.

    ``votes``: ballot, node_id; ``members``: config, node_id. Voters outside a configuration do not count in it, and
    a ballot without any vote does not appear. With two configurations (old and new) both must agree.
    """
    sizes = members.groupBy("config").agg(F.count_distinct("node_id").alias("size"))
    each = votes.select("ballot", "node_id").distinct().join(members.select("config", "node_id").distinct(), "node_id").groupBy("ballot", "config").agg(F.count("*").alias("n"))
    configs = sizes.agg(F.count("*").alias("configs"))  # one row
    met = each.join(F.broadcast(sizes), "config").groupBy("ballot").agg(F.count_if(F.col("n") >= majority(F.col("size"))).alias("met")).join(F.broadcast(configs))
    all_votes = votes.groupBy("ballot").agg(F.count_distinct("node_id").alias("votes"))
    return all_votes.join(met, "ballot", "left").select("ballot", "votes", F.coalesce(F.col("met") == F.col("configs"), F.lit(False)).alias("quorum"))


def commit_index(acks: DataFrame, members: DataFrame, log: DataFrame, current_term: int, committed: int) -> DataFrame:
    """The index up to which the log is committed, one row (commit_index).

    A candidate is an acknowledged index above ``committed`` whose entry has the current term and that a majority of each
    configuration has reached; a member without an acknowledgement has reached nothing. None: it stays.
    """
    reached = members.select("config", "node_id").distinct().join(acks.groupBy("node_id").agg(F.max("match_index").alias("match_index")), "node_id", "left").withColumn("match_index", F.coalesce("match_index", F.lit(0)))
    # The majority-th greatest index of each configuration; all candidates up to the least of them qualify.
    per_config = reached.groupBy("config").agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m")).select(F.get("m", majority(F.size("m")).cast("int") - 1).alias("point"))  # members of one cluster
    bound = per_config.agg(F.min("point").alias("bound"))
    candidates = acks.select(F.col("match_index").alias("log_index")).distinct().join(F.broadcast(bound)).where((F.col("log_index") > committed) & (F.col("log_index") <= F.col("bound")))
    found = candidates.join(log.where(F.col("term") == current_term).select("log_index"), "log_index", "left_semi").agg(F.max("log_index").alias("found"))
    return found.select(F.coalesce("found", F.lit(committed)).cast("long").alias("commit_index"))


def up_to_date(last_term: Column, last_index: Column, my_term: Column, my_index: Column) -> Column:
    """Whether a log is at least as new as mine: by last term, then last index."""
    return F.struct(last_term.alias("t"), last_index.alias("i")) >= F.struct(my_term.alias("t"), my_index.alias("i"))


def votes_granted(requests: DataFrame, voters: DataFrame) -> DataFrame:
    """For each request (candidate_id, voter_id, term, last_term, last_index) whether the voter's state
    (voter_id, my_term, voted_for, my_last_term, my_last_index) grants a vote, and a pre-vote.

    A higher term clears voted_for. A pre-vote needs a term above the voter's and changes nothing.
    """
    free = (F.col("term") > F.col("my_term")) | F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate_id"))
    newer = up_to_date(F.col("last_term"), F.col("last_index"), F.col("my_last_term"), F.col("my_last_index"))
    return requests.join(voters, "voter_id").select("candidate_id", "voter_id", ((F.col("term") >= F.col("my_term")) & free & newer).alias("vote"), ((F.col("term") > F.col("my_term")) & newer).alias("pre_vote"))


def first_conflict(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """One row: the first index at which both logs have entries of different terms (null: none), the follower's and the leader's last index."""
    both = leader.select("log_index", F.col("term").alias("theirs")).join(follower.select("log_index", F.col("term").alias("mine")), "log_index", "full_outer")
    return both.agg(
        F.min(F.when(F.col("theirs") != F.col("mine"), F.col("log_index"))).alias("conflict_index"),
        F.max(F.when(F.col("mine").isNotNull(), F.col("log_index"))).alias("follower_last"),
        F.max(F.when(F.col("theirs").isNotNull(), F.col("log_index"))).alias("leader_last"),
    )


def appended(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """The follower's log after the leader's entries: its own before the first conflict, the leader's from there on.

    Without a conflict its own entries stay, those beyond the leader's too.
    """
    at = first_conflict(leader, follower).select("conflict_index")  # one row
    own = follower.select("log_index", "term").join(F.broadcast(at)).where(F.col("conflict_index").isNull() | (F.col("log_index") < F.col("conflict_index"))).select("log_index", "term")
    return own.unionByName(leader.select("log_index", "term").join(own, "log_index", "left_anti"))


def replication_lag(acks: DataFrame, last_index: int, snapshot_index: int) -> DataFrame:
    """Per node: match_index, next_index, entries it lacks, and whether it needs the snapshot (next_index <= snapshot_index)."""
    at = acks.groupBy("node_id").agg(F.max("match_index").alias("match_index"))
    return at.select("node_id", "match_index", (F.col("match_index") + 1).alias("next_index"), (F.lit(last_index) - F.col("match_index")).alias("lag"), (F.col("match_index") + 1 <= snapshot_index).alias("needs_snapshot"))


def after_responses(state: DataFrame, responses: DataFrame) -> DataFrame:
    """Next and match index per node after responses (node_id, at, success, match_index) in order.

    A success sets match to its index and next behind it; each failure after the last success takes next back by one, not below 1.
    """
    last_ok = responses.groupBy("node_id").agg(F.max(F.when(F.col("success"), F.struct("at", "match_index"))).alias("ok"))
    failed = responses.join(last_ok, "node_id").where(~F.col("success") & (F.col("ok").isNull() | (F.col("at") > F.col("ok.at")))).groupBy("node_id").agg(F.count("*").alias("failures"))
    joined = state.join(last_ok, "node_id", "left").join(failed, "node_id", "left")
    base = F.coalesce(F.col("ok.match_index") + 1, F.col("next_index"))
    return joined.select("node_id", F.greatest(base - F.coalesce("failures", F.lit(0)), F.lit(1)).alias("next_index"), F.coalesce("ok.match_index", "match_index").alias("match_index"))


def reads_ready(requests: DataFrame, acks: DataFrame, members: int, applied: int) -> DataFrame:
    """Per read request (request_id, read_index): distinct acknowledgements, whether leadership is confirmed by a majority, and whether
    the read can be served: confirmed and applied up to its index."""
    counts = acks.groupBy("request_id").agg(F.count_distinct("node_id").alias("acks"))
    n = F.coalesce("acks", F.lit(0))
    sure = n >= members // 2 + 1
    return requests.join(counts, "request_id", "left").select("request_id", n.alias("acks"), sure.alias("confirmed"), (sure & (F.col("read_index") <= applied)).alias("ready"))


def transfer_checks(requests: DataFrame, acks: DataFrame, leader_id: int, last_index: int) -> DataFrame:
    """Verdict on each request to hand over leadership (request_id, node_id, target_id, in_progress).

    In this order: NotLeader, AlreadyLeader, InProgress, NotInCluster; else TimeoutNow if the target has the whole log, Waiting if not.
    """
    at = acks.groupBy(F.col("node_id").alias("target_id")).agg(F.max("match_index").alias("match_index"))
    verdict = (
        F.when(F.col("node_id") != leader_id, "NotLeader")
        .when(F.col("target_id") == leader_id, "AlreadyLeader")
        .when(F.col("in_progress"), "InProgress")
        .when(F.col("match_index").isNull(), "NotInCluster")
        .when(F.col("match_index") >= last_index, "TimeoutNow")
        .otherwise("Waiting")
    )
    return requests.join(at, "target_id", "left").select("request_id", verdict.alias("verdict"))


def log_after_snapshot(log: DataFrame, snapshot_index: int) -> DataFrame:
    """Entries that compaction up to a snapshot leaves."""
    return log.where(F.col("log_index") > snapshot_index)


def append_outcomes(requests: DataFrame, log: DataFrame, my_term: int, committed: int) -> DataFrame:
    """A follower's answer to each append request, each from the same state: request_id, term, success, match_index, commit_index, truncated_at.

    ``requests``: request_id, term, prev_index, prev_term, leader_commit, entries (array of struct<log_index, term>); ``log``: log_index, term, the
    follower's. An older term is refused with match_index 0; a log that lacks the entry before, or has it in another term, refuses with its last
    index. Else entries from the first of another term on replace the follower's own; the commit index becomes the least of the
    leader's and the last index, if the leader's is greater.
    """
    own = log.select(F.col("log_index").alias("at"), F.col("term").alias("own_term"))
    last = log.agg(F.coalesce(F.max("log_index"), F.lit(0)).alias("last"))  # one row
    new = requests.select("request_id", F.explode("entries").alias("e")).select("request_id", F.col("e.log_index").alias("at"), "e.term")
    per = new.join(own, "at", "left").groupBy("request_id").agg(F.max("at").alias("upto"), F.min(F.when(F.col("own_term") != F.col("term"), F.col("at"))).alias("conflict"))
    joined = requests.withColumn("at", F.col("prev_index")).join(own, "at", "left").join(per, "request_id", "left").join(F.broadcast(last))
    stale = F.col("term") < my_term
    fits = (F.col("prev_index") == 0) | F.coalesce(F.col("own_term") == F.col("prev_term"), F.lit(False))
    good = ~stale & fits
    end = F.when(F.col("conflict").isNotNull(), F.col("upto")).otherwise(F.greatest("last", F.coalesce("upto", F.lit(0))))
    commit = F.when(good & (F.col("leader_commit") > committed), F.least("leader_commit", end)).otherwise(committed)
    return joined.select("request_id", F.greatest("term", F.lit(my_term)).cast("long").alias("term"), good.alias("success"), F.when(stale, 0).when(good, end).otherwise(F.col("last")).cast("long").alias("match_index"), commit.cast("long").alias("commit_index"), F.when(good, F.col("conflict")).alias("truncated_at"))


def append_requests(peers: DataFrame, log: DataFrame, term: int, committed: int) -> DataFrame:
    """What a leader sends each peer (node_id, next_index): node_id, term, prev_index, prev_term (0: none), first_index and last_index
    of the entries (null: a heartbeat), entries, leader_commit. The log's indexes follow each other."""
    ends = log.agg(F.coalesce(F.max("log_index"), F.lit(0)).alias("last"), F.coalesce(F.min("log_index"), F.lit(1)).alias("first"))  # one row
    terms = log.select(F.col("log_index").alias("prev_index"), F.col("term").alias("prev_term"))
    placed = peers.withColumn("prev_index", F.greatest(F.col("next_index") - 1, F.lit(0))).join(terms, "prev_index", "left").join(F.broadcast(ends))
    first = F.greatest("next_index", "first")
    n = F.greatest(F.col("last") - first + 1, F.lit(0))
    return placed.select("node_id", F.lit(term).cast("long").alias("term"), "prev_index", F.coalesce("prev_term", F.lit(0)).cast("long").alias("prev_term"), F.when(n > 0, first).alias("first_index"), F.when(n > 0, F.col("last")).alias("last_index"), n.cast("long").alias("entries"), F.lit(committed).cast("long").alias("leader_commit"))


def proposals(requests: DataFrame, last_index: int) -> DataFrame:
    """Verdict on each proposal in the order of ``at``: at, verdict (NotLeader, TransferInProgress, accepted), log_index.

    ``requests``: at, role, transferring. Accepted ones take the indexes after ``last_index`` in order; others take none.
    """
    verdict = F.when(F.coalesce(F.col("role") != "leader", F.lit(True)), "NotLeader").when(F.col("transferring"), "TransferInProgress").otherwise("accepted")
    judged = requests.select("at", verdict.alias("verdict"))
    taken = numbered(judged.where("verdict = 'accepted'"), ["at"], "log_index", last_index + 1)
    return taken.select("at", "verdict", "log_index").unionByName(judged.where("verdict <> 'accepted'").withColumn("log_index", F.lit(None).cast("long")))


def stepped_down(states: DataFrame) -> DataFrame:
    """Nodes after they saw a term (node_id, role, term, voted_for, leader_id, seen_term): one above their own makes a node a follower of that term
    without vote, leader, or transfer and change in progress; any other leaves it as it is."""
    newer = F.col("seen_term") > F.col("term")
    return states.select("node_id", F.when(newer, "follower").otherwise(F.col("role")).alias("role"), F.when(newer, F.col("seen_term")).otherwise(F.col("term")).alias("term"), F.when(~newer, F.col("voted_for")).alias("voted_for"), F.when(~newer, F.col("leader_id")).alias("leader_id"), newer.alias("stepped_down"))


def transfer_outcomes(transfers: DataFrame, progress: DataFrame, timeout_ms: int) -> DataFrame:
    """Each hand-over (transfer_id, started_ms, last_index) after what was seen of its target (transfer_id, at_ms, match_index): transfer_id, sent_ms,
    outcome.

    The target is told once, when first seen with the whole log while the transfer lasts (sent_ms). A transfer is given up when seen longer than the
    timeout after its start: TimedOut; else TimeoutNow if the target was told, Waiting if not.
    """
    seen = progress.join(transfers, "transfer_id").withColumn("expired", F.col("at_ms") - F.col("started_ms") > timeout_ms)
    per = seen.groupBy("transfer_id").agg(F.min(F.when(~F.col("expired") & (F.col("match_index") >= F.col("last_index")), F.col("at_ms"))).alias("sent_ms"), F.bool_or("expired").alias("expired"))
    outcome = F.when(F.col("expired"), "TimedOut").when(F.col("sent_ms").isNotNull(), "TimeoutNow").otherwise("Waiting")
    return transfers.select("transfer_id").join(per, "transfer_id", "left").select("transfer_id", "sent_ms", outcome.alias("outcome"))


def snapshot_verdicts(offers: DataFrame) -> DataFrame:
    """A follower's answer to each offered snapshot (offer_id, leader_term, included_index, my_term, snapshot_index, commit_index, applied_index): offer_id, verdict, term,
    commit_index, applied_index.

    An older term: stale. One no newer than its own snapshot: ignored, but the term is taken over. Else installed: what is committed and
    applied is at least the snapshot's.
    """
    stale, old = F.col("leader_term") < F.col("my_term"), F.col("included_index") <= F.col("snapshot_index")
    raised = lambda c: F.when(stale | old, F.col(c)).otherwise(F.greatest(c, "included_index")).alias(c)
    return offers.select("offer_id", F.when(stale, "stale").when(old, "ignored").otherwise("installed").alias("verdict"), F.greatest("leader_term", "my_term").alias("term"), raised("commit_index"), raised("applied_index"))


def drain_targets(nodes: DataFrame, peers: DataFrame) -> DataFrame:
    """Draining nodes (node_id, role): the peer leadership goes to (node_id, at, peer_id: the first in order), null where
    the node does not lead or is alone."""
    first = peers.where(F.col("node_id") != F.col("peer_id")).groupBy("node_id").agg(F.min_by("peer_id", "at").alias("peer_id"))
    return nodes.join(first, "node_id", "left").select("node_id", F.when(F.col("role") == "leader", F.col("peer_id")).alias("transfer_to"))


MEMBERSHIP_STEPS = "cluster_id long, at long, status string, members array<long>, pending array<long>"


def membership_steps(changes: DataFrame, initial: DataFrame) -> DataFrame:
    """Each step of clusters' changes of members, with its status and the members, and those of a pending change, after it.

    ``changes``: cluster_id, at, action (add, remove, finalize, abort), node_id; ``initial``: cluster_id, members (array). add and remove
    begin a joint phase (status joint) unless one lasts (ChangeInProgress), the node is there (NodeAlreadyExists), is not (NodeNotFound) or is the last
    (CannotRemoveLastNode). finalize moves to the pending members (finalized) or has none (nothing); abort drops them. A change depends on all
    before it, so a cluster's changes stream through one task in order; what is held is its members.
    """
    ordered = changes.join(initial, "cluster_id", "left").repartition("cluster_id").sortWithinPartitions("cluster_id", "at")

    def fold(batches):
        import pandas as pd

        cluster, members, pending = None, [], None
        for frame in batches:
            out = []
            for of, at, action, node, first in zip(*(frame[c] for c in ("cluster_id", "at", "action", "node_id", "members")), strict=True):
                if of != cluster:
                    cluster, members, pending = of, sorted(set(first)) if first is not None else [], None
                status = "unknown"
                if action in ("add", "remove"):
                    there = node in members
                    if pending is not None:
                        status = "ChangeInProgress"
                    elif action == "add" and there:
                        status = "NodeAlreadyExists"
                    elif action == "remove" and not there:
                        status = "NodeNotFound"
                    elif action == "remove" and len(members) == 1:
                        status = "CannotRemoveLastNode"
                    else:
                        status = "joint"
                        pending = sorted({*members, node}) if action == "add" else [m for m in members if m != node]
                elif action == "finalize":
                    status = "nothing" if pending is None else "finalized"
                    members, pending = members if pending is None else pending, None
                elif action == "abort":
                    status, pending = "aborted", None
                out.append((of, at, status, members, pending))
            yield pd.DataFrame(out, columns=["cluster_id", "at", "status", "members", "pending"])

    return ordered.select("cluster_id", "at", "action", "node_id", "members").mapInPandas(fold, MEMBERSHIP_STEPS)


def members_after(steps: DataFrame, initial: DataFrame) -> DataFrame:
    """(cluster_id, node_id) of every cluster after its last step."""
    last = steps.groupBy("cluster_id").agg(F.max_by("members", "at").alias("now"))
    return initial.join(last, "cluster_id", "left").select("cluster_id", F.explode(F.coalesce("now", "members")).alias("node_id"))
