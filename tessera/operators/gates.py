"""The gate before a bot's action, leases of repositories, and the merge loop's slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.chains import greedy, nearest
from tessera.streaming.machines import Machine, run_stream, run_table

# Seconds of a lock, hours of a scan, confidence, writes an hour, distance of the network, seconds of a lease
LOCK, STALE, SURE, WRITES, HOUR, APART, TTL = 1800, 48, 0.95, 3, 3600, 0.15, 3600
WRITING = ("pr_create", "commit_push")
SECOND = 1_000_000


class Gate(Machine):
    """Reviews, lock releases and settlements of held actions of one repository, in order.

    Only approved actions that write take the lock and count for the hour.  A bot re-enters its own lock.
    Held actions stay held until they are settled and reject other bots' actions on the same pattern.
    """

    inputs = ("message", "bot", "pattern", "writes", "directive", "unfit", "apart", "settles")
    outputs = T.StructType([T.StructField("verdict", T.StringType())])

    def start(self) -> dict:
        return {"lock": None, "writes": [], "held": {}, "bots": {}}

    def step(self, state: dict, at: int, ident: int, event: dict) -> tuple:
        if event["message"] == "release":
            state["lock"] = None
            return ("released",)
        if event["message"] == "settle":
            held = state["held"].pop(str(event["settles"]), None)
            if held is None:
                return ("unknown",)
            bots = state["bots"][held[0]]
            bots[held[1]] -= 1
            if not bots[held[1]]:
                del bots[held[1]]
            return ("settled",)
        verdict = self._review(state, at, event)
        if verdict.startswith("hold"):
            state["held"][str(ident)] = [event["pattern"], event["bot"]]
            bots = state["bots"].setdefault(event["pattern"], {})
            bots[event["bot"]] = bots.get(event["bot"], 0) + 1
        elif verdict == "approve" and event["writes"]:
            state["lock"] = [event["bot"], at]
            state["writes"] = [t for t in state["writes"] if t > at - HOUR * SECOND] + [at]
        return (verdict,)

    def _review(self, state: dict, at: int, event: dict) -> str:
        lock = state["lock"]
        if event["directive"]:
            return event["directive"]
        if lock and at - lock[1] <= LOCK * SECOND and lock[0] != event["bot"]:
            return "defer"
        if event["unfit"]:
            return event["unfit"]
        if event["writes"] and sum(t > at - HOUR * SECOND for t in state["writes"]) >= WRITES:
            return "hold-rate"
        if any(b != event["bot"] for b in state["bots"].get(event["pattern"], {})):
            return "reject-conflict"
        return "hold-neural" if event["apart"] else "approve"


def _checked(messages: DataFrame, directives: DataFrame) -> DataFrame:
    """Messages with those checks that need no state: directives of the repository, age of the scan, confidence, the network's view."""
    auto = F.col("tier") == "auto_execute"
    allowed = F.element_at("allowed", F.col("bot"))
    directive = F.when(F.array_contains("blocked", F.col("bot")), "reject-directive").when(~F.array_contains(allowed, F.col("action_type")), "hold-directive")
    unfit = F.when(F.col("scan_hours") > STALE, "hold-stale").when(auto & (F.coalesce("confidence", F.lit(0.0)) < SURE), "hold-confidence")
    apart = F.coalesce(auto & (F.abs(F.col("neural") - F.col("confidence")) >= APART), F.lit(False))
    joined = messages.join(directives.withColumnRenamed("repo", "key"), "key", "left")
    return joined.withColumns({"writes": F.col("action_type").isin(*WRITING), "directive": directive, "unfit": unfit, "apart": apart})


def review(messages: DataFrame, directives: DataFrame) -> DataFrame:
    """(key, at, id, verdict) of messages (key, ts, at, id, message, bot, pattern, action_type, tier, confidence, neural, scan_hours, settles).

    ``key`` is the repository; message is review, release or settle.  ``directives`` (repo, blocked, allowed) may lack
    repositories, and a bot without an entry in allowed may do everything.  Works on streams and tables alike.
    """
    checked = _checked(messages, directives)
    return run_stream(checked, Gate()) if messages.isStreaming else run_table(checked, Gate())


def lease_answers(requests: DataFrame, stage, ttl: int = TTL) -> DataFrame:
    """(id, answer, lease) of requests (repo, holder, at in seconds, id unique, refused): what each is told, in order of (at, id).

    A repository has one live lease.  Its holder's requests renew it for ``ttl`` seconds from then, so it ends ``ttl``
    after the last of them that finds it live: the end of the holder's own session of requests less than ``ttl`` apart.
    The next lease is minted by the first request at that end or later.  So minting requests are a greedy chain over
    session ends, and nobody has to walk a repository.  Refused requests neither hold nor renew.
    ``lease`` is the id of the request that minted what decides the answer.
    """
    asked = stage(requests.where("NOT refused").select("repo", "holder", "at", "id"))
    own = ["repo", "holder"]
    last = nearest(asked, asked.select(*own, "at", "id"), own, 16 * ttl, equal=False)
    opens = stage(last.where(F.col("point").isNull() | (F.col("at") - F.col("point.at") >= ttl)).select(*own, "at", "id"))
    sessions = stage(nearest(asked, opens, own, 16 * ttl).select(*own, "at", "id", F.col("point.id").alias("session")))
    ends = sessions.groupBy("session").agg((F.max("at") + ttl).alias("until"))
    events = sessions.join(ends, "session").select("repo", "holder", "at", "id", "until")
    minted = stage(greedy(events, ["repo"], F.col("until"), stage, ttl))
    told = nearest(asked, minted.select("repo", "at", "id", "holder"), ["repo"], 16 * ttl)
    answer = F.when(F.col("point.id") == F.col("id"), "minted").when(F.col("point.holder") == F.col("holder"), "renewed").otherwise("conflict")
    return told.select("id", answer.alias("answer"), F.col("point.id").alias("lease")).unionByName(requests.where("refused").select("id", F.lit("refused").alias("answer"), F.lit(None).cast("long").alias("lease")))


def merge_plan(decided: DataFrame, leases: DataFrame) -> DataFrame:
    """``decided`` (repo, cycle, pr, ts, safety, meta) with gate, reason and entry.

    Of a repository's armed pull requests in one cycle the first that gets the lease keeps the slot.  One that is refused
    (its change is meta) or meets another's lease (repo, cycle, lease_holder) falls back to a flag and leaves the slot free;
    those after the slot is taken are put off.
    """
    place = F.struct("ts", "pr")
    held = leases.groupBy("repo", "cycle").agg(F.min("lease_holder").alias("lease_holder"))
    rows = decided.join(held, ["repo", "cycle"], "left")
    armed = F.col("safety") == "arm_auto"
    free = armed & ~F.col("meta") & F.col("lease_holder").isNull()
    slot = rows.where(free).groupBy("repo", "cycle").agg(F.min(place).alias("slot"))
    rows = rows.join(slot, ["repo", "cycle"], "left")
    gate = F.when(~armed, "no_gate").when(F.col("slot") < place, "deferred").when(F.col("meta"), "blocked").when(F.col("lease_holder").isNotNull(), "deferred").otherwise("armed")
    reason = F.when(~armed, None).when(F.col("slot") < place, "same-repo-this-cycle").when(F.col("meta"), "gate-refused:meta:owner-unauthorized")
    reason = reason.otherwise(F.when(F.col("lease_holder").isNotNull(), F.concat(F.lit("lease-held:"), "lease_holder")))
    rows = rows.withColumns({"gate": gate, "reason": reason})
    return rows.withColumn("entry", F.when(F.col("gate").isin("deferred", "blocked"), "flag").otherwise(F.col("safety"))).drop("slot", "lease_holder")

