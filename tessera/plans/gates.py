"""Registered queries of the gate, of leases and of the merge loop.

Messages stand on events, fifty users to a repository and four times as fast: errors release a lock or settle a held action, all others ask
for a review.  The SQL replays every repository one message after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import gates as T
from tessera.operators.graph import written
from tessera.plans.governance import _DECIDED, BOTS, PATTERNS, STRATEGIES, _decided, _listed, _pick
from tessera.plans.queries import query
from tessera.sources import views as V
from tessera.streaming.machines import timed

_MESSAGES = f"""m AS (SELECT event_id AS id, epoch_us(ts) // 4 AS moment, 'repo-' || (user_id // 50) AS repo, user_id // 50 AS place, CASE WHEN event_type <> 'error' THEN 'review' WHEN event_id % 2 = 0 THEN 'release' ELSE 'settle' END AS message,
  ({_listed(BOTS)})[(k % 3 + 1)::INT] AS bot, ({_listed(PATTERNS)})[(event_id % 7 + 1)::INT] || '-' || (floor(value)::BIGINT % 200) AS pattern, ({_listed(STRATEGIES)})[(event_id % 3 + 1)::INT] AS tier,
  CASE event_type WHEN 'purchase' THEN 'pr_create' WHEN 'click' THEN 'commit_push' WHEN 'view' THEN 'issue_create' ELSE 'advisory' END AS action_type, (event_id * 37 % 100) / 100.0::DOUBLE AS confidence,
  (event_id * 53 % 100) / 100.0::DOUBLE AS neural, CASE WHEN event_id % 5 > 0 THEN event_id * 13 % 60 END AS scan_hours, event_id - k % 40 AS settles FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""


def messages(events: DataFrame) -> DataFrame:
    n, k, kind = F.col("event_id"), F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
    quick = F.timestamp_micros(F.expr("unix_micros(cast(ts AS timestamp)) div 4"))
    e = timed(events.withColumns({"repo": F.concat(F.lit("repo-"), F.expr("user_id div 50")), "ts": quick}), "repo", "ts", "event_id")
    return e.withColumns({
        "message": F.when(kind != "error", "review").when(n % 2 == 0, "release").otherwise("settle"),
        "bot": _pick(BOTS[:3], k), "pattern": F.concat(_pick(PATTERNS, n), F.lit("-"), F.floor("value").cast("long") % 200), "tier": _pick(STRATEGIES, n),
        "action_type": F.when(kind == "purchase", "pr_create").when(kind == "click", "commit_push").when(kind == "view", "issue_create").otherwise("advisory"),
        "confidence": n * 37 % 100 / 100.0, "neural": n * 53 % 100 / 100.0, "scan_hours": F.when(n % 5 > 0, n * 13 % 60), "settles": n - k % 40,
    })


def directives(events: DataFrame) -> DataFrame:
    """What repositories allow: every third blocks a bot, the next restricts one, the last says nothing."""
    place = events.select(F.expr("user_id div 50").alias("place")).distinct()
    blocked = F.when(F.col("place") % 3 == 0, F.array(F.lit(BOTS[2]))).otherwise(F.array().cast("array<string>"))
    allowed = F.when(F.col("place") % 3 == 1, F.create_map(F.lit(BOTS[1]), F.array(F.lit("issue_create"), F.lit("advisory"))))
    return place.where("place % 3 < 2").select(F.concat(F.lit("repo-"), "place").alias("repo"), blocked.alias("blocked"), allowed.alias("allowed"))


_REVIEW = f"""WITH RECURSIVE {_MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY moment, id) AS n, CASE WHEN place % 3 = 0 AND bot = '{BOTS[2]}' THEN 'reject-directive' WHEN place % 3 = 1 AND bot = '{BOTS[1]}' AND action_type IN ('pr_create', 'commit_push') THEN 'hold-directive' END AS directive FROM m),
g AS (SELECT repo, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS verdict, NULL::VARCHAR AS lock_bot, 0::BIGINT AS lock_at, []::BIGINT[] AS writes, []::STRUCT(id BIGINT, pattern VARCHAR, bot VARCHAR)[] AS held FROM r GROUP BY repo
UNION ALL SELECT repo, n, id, verdict,
  CASE WHEN verdict = 'released' THEN NULL WHEN verdict = 'approve' AND action_type IN ('pr_create', 'commit_push') THEN bot ELSE lock_bot END,
  CASE WHEN verdict = 'approve' AND action_type IN ('pr_create', 'commit_push') THEN moment ELSE lock_at END,
  CASE WHEN verdict = 'approve' AND action_type IN ('pr_create', 'commit_push') THEN list_append(recent, moment) ELSE recent END,
  CASE WHEN verdict = 'settled' THEN list_filter(held, lambda h: h.id <> settles) WHEN starts_with(verdict, 'hold') THEN list_append(held, {{'id': id, 'pattern': pattern, 'bot': bot}}) ELSE held END
FROM (SELECT *, CASE WHEN message = 'release' THEN 'released' WHEN message = 'settle' THEN CASE WHEN len(list_filter(held, lambda h: h.id = settles)) > 0 THEN 'settled' ELSE 'unknown' END
  WHEN directive IS NOT NULL THEN directive WHEN lock_bot <> bot AND moment - lock_at <= 1800000000 THEN 'defer' WHEN scan_hours > 48 THEN 'hold-stale' WHEN tier = 'auto_execute' AND confidence < 0.95 THEN 'hold-confidence'
  WHEN action_type IN ('pr_create', 'commit_push') AND len(recent) >= 3 THEN 'hold-rate' WHEN len(list_filter(held, lambda h: h.pattern = pattern AND h.bot <> bot)) > 0 THEN 'reject-conflict'
  WHEN tier = 'auto_execute' AND abs(neural - confidence) >= 0.15 THEN 'hold-neural' ELSE 'approve' END AS verdict
  FROM (SELECT r.*, g.lock_bot, g.lock_at, g.held, list_filter(g.writes, lambda t: t > r.moment - 3600000000) AS recent FROM g JOIN r ON r.repo = g.repo AND r.n = g.n + 1)))"""


def _reviewed(spark, d):
    e = V.table(spark, d, "events")
    return T.review(messages(e), directives(e))


@query("k01_gate_review", f"{_REVIEW} SELECT id AS action_id, verdict FROM g WHERE n > 0")
def k01_gate_review(spark, d):
    """The first check that an action fails, in a state that approvals, releases and settlements change."""
    return _reviewed(spark, d).select(F.col("id").alias("action_id"), "verdict")


@query("k01_gate_stats", f"{_REVIEW} SELECT repo, verdict, count(*) AS n FROM g WHERE n > 0 GROUP BY repo, verdict")
def k01_gate_stats(spark, d):
    """Counts of the gate's decisions by repository."""
    return _reviewed(spark, d).groupBy(F.col("key").alias("repo"), "verdict").agg(F.count("*").alias("n"))


_REQUESTS = "q AS (SELECT event_id AS id, floor(epoch(ts))::BIGINT AS moment, 'repo-' || (user_id // 50) AS repo, 'bot-' || (json_extract_string(props, '$.k')::BIGINT % 4) AS holder, event_id % 31 = 0 AND event_id % 62 > 0 AS refused FROM events)"
_LEASES = f"""WITH RECURSIVE {_REQUESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY moment, id) AS n FROM q),
g AS (SELECT repo, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS answer, NULL::VARCHAR AS owner, 0::BIGINT AS until, NULL::BIGINT AS lease FROM r GROUP BY repo
UNION ALL SELECT repo, n, id, answer, CASE WHEN answer = 'minted' THEN holder ELSE owner END, CASE WHEN answer IN ('minted', 'renewed') THEN moment + 3600 ELSE until END, CASE WHEN answer = 'minted' THEN id ELSE lease END
FROM (SELECT r.*, g.owner, g.until, g.lease, CASE WHEN refused THEN 'refused' WHEN owner IS NOT NULL AND until > moment THEN CASE WHEN owner = holder THEN 'renewed' ELSE 'conflict' END ELSE 'minted' END AS answer FROM g JOIN r ON r.repo = g.repo AND r.n = g.n + 1))"""


def requests(spark, d) -> DataFrame:
    n = F.col("event_id")
    e = V.table(spark, d, "events")
    holder = F.concat(F.lit("bot-"), F.get_json_object("props", "$.k").cast("long") % 4)
    return e.select(n.alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.concat(F.lit("repo-"), F.expr("user_id div 50")).alias("repo"), holder.alias("holder"), ((n % 31 == 0) & (n % 62 > 0)).alias("refused"))


@query("k03_lease_acquire", f"{_LEASES} SELECT id, answer, CASE WHEN answer <> 'refused' THEN lease ELSE -1 END AS lease FROM g WHERE n > 0")
def k03_lease_acquire(spark, d):
    """Answers to lease requests: meta areas without the owner's leave are refused, an own live lease renews, another's conflicts.  The lease is that of the request that minted it, -1 for refusals."""
    return T.lease_answers(requests(spark, d), written).withColumn("lease", F.coalesce("lease", F.lit(-1).cast("long")))


_CYCLE = "strftime(ts, '%Y')"
_PLAN = f"""{_DECIDED}, p AS (SELECT pr, repo, {_CYCLE} AS cycle, ts, safety, pr % 5 = 0 AS meta FROM m), f AS (SELECT repo, {_CYCLE} AS cycle, min('farm-' || (pr % 3)) AS lease_holder FROM m WHERE pr % 997 = 5 GROUP BY 1, 2),
z AS (SELECT *, min(CASE WHEN safety = 'arm_auto' AND NOT meta AND lease_holder IS NULL THEN {{'ts': ts, 'pr': pr}} END) OVER (PARTITION BY repo, cycle) AS slot FROM p LEFT JOIN f USING (repo, cycle)),
y AS (SELECT *, CASE WHEN safety <> 'arm_auto' THEN 'no_gate' WHEN slot < {{'ts': ts, 'pr': pr}} THEN 'deferred' WHEN meta THEN 'blocked' WHEN lease_holder IS NOT NULL THEN 'deferred' ELSE 'armed' END AS gate,
  CASE WHEN safety <> 'arm_auto' THEN NULL WHEN slot < {{'ts': ts, 'pr': pr}} THEN 'same-repo-this-cycle' WHEN meta THEN 'gate-refused:meta:owner-unauthorized' WHEN lease_holder IS NOT NULL THEN 'lease-held:' || lease_holder END AS reason FROM z)"""


def _planned(spark, d):
    p = _decided(spark, d).withColumn("cycle", F.date_format("ts", "yyyy")).withColumn("meta", F.col("pr") % 5 == 0)
    leases = p.where("pr % 997 = 5").select("repo", "cycle", F.concat(F.lit("farm-"), F.col("pr") % 3).alias("lease_holder"))
    return T.merge_plan(p, leases)


@query("k07_merge_plan", f"{_PLAN} SELECT pr, repo, cycle, gate, reason, CASE WHEN gate IN ('deferred', 'blocked') THEN 'flag' ELSE safety END AS entry FROM y")
def k07_merge_plan(spark, d):
    """A repository's slot of a year goes to the first armed pull request that gets the lease; refused ones leave it free."""
    return _planned(spark, d).select("pr", "repo", "cycle", "gate", "reason", "entry")


@query("k07_merge_stats", f"{_PLAN} SELECT cycle, count(*) AS total, count(*) FILTER (gate = 'armed') AS armed, count(*) FILTER (gate = 'deferred') AS deferred, count(*) FILTER (gate = 'blocked') AS blocked, count(*) FILTER (safety = 'review') AS review, count(*) FILTER (safety = 'flag') AS flagged FROM y GROUP BY cycle")
def k07_merge_stats(spark, d):
    """The loop's summary of each cycle."""
    counts = [F.count_if(F.col("gate") == g).alias(g) for g in ("armed", "deferred", "blocked")]
    return _planned(spark, d).groupBy("cycle").agg(F.count("*").alias("total"), *counts, F.count_if(F.col("safety") == "review").alias("review"), F.count_if(F.col("safety") == "flag").alias("flagged"))
