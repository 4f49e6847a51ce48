"""Registered queries of watchers: alert rules, rings, rolling anomalies, de-duplication.

Telemetry stands on events, fifty users to a watcher and sixty times as fast.  Errors are quarantines, clicks alerts of
peers, purchases anomalies, views and most signups snapshots, and every seventh signup is a violation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chains import greedy
from tessera.operators.graph import written
from tessera.plans.queries import query
from tessera.sources import views as V
from tessera.streaming import watch as S

KINDS = ("success_rate_drop", "esn_drift_rising_drift", "esn_drift_falling_drift")


def telemetry(events: DataFrame) -> DataFrame:
    n, k, kind = F.col("event_id"), F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
    ts = F.timestamp_micros(F.expr("unix_micros(cast(ts AS timestamp)) div 60"))
    name = F.when(kind == "error", "quarantine").when(kind == "click", "federated").when(kind == "purchase", "anomaly").when((kind == "signup") & (n % 7 == 0), "violation").otherwise("snapshot")
    e = events.select("*", k.alias("k"), name.alias("name")).withColumn("ts", ts)
    name = F.col("name")
    subject = F.when(name == "quarantine", F.concat(F.lit("id-"), F.col("k") % 5)).when(name == "violation", F.concat(F.lit("rule-"), "k")).when(name == "snapshot", F.concat(F.lit("proc-"), F.col("k") % 4))
    detail = F.when(name == "quarantine", F.when(F.col("k") % 2 == 0, "recipe").otherwise("bot")).when(name == "violation", F.concat(F.lit("mod-"), F.col("k") % 6))
    detail = detail.when(name == "anomaly", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("k") % 3 + 1).cast("int")))
    far = name == "federated"
    return e.select(
        F.concat(F.lit("watch-"), F.expr("user_id div 50")).alias("watcher"), "ts", F.unix_micros("ts").alias("at"), n.alias("id"), "name", subject.alias("subject"), detail.alias("detail"), (n % 2 == 0).alias("concurs"),
        F.when(name == "snapshot", n * 7 % 150).alias("depth"), F.when(name == "snapshot", F.floor("value").cast("long")).alias("dropped"), (F.col("k") % 60 / 100.0).alias("recent"), F.lit(0.75).alias("baseline"), (2 + F.col("k") / 10.0).alias("sigma"),
        F.when(far, F.concat(F.lit("peer-"), F.col("k") % 7)).alias("peer"), F.when(far, "quarantine_triggered").alias("rule"), F.when(far, "high").alias("severity"), F.when(far, F.concat(F.lit("Recipe/bot auto-quarantined: recipe/far-"), "k")).alias("summary"),
    )


_TELEMETRY = """e AS (SELECT event_id AS id, 'watch-' || (user_id // 50) AS watcher, epoch_us(ts) // 60 AS moment, json_extract_string(props, '$.k')::BIGINT AS k, value, event_type AS kind FROM events),
a AS (
  SELECT watcher, moment, id, 'quarantine_triggered' AS rule, 'high' AS severity, 'Recipe/bot auto-quarantined: ' || what || '/id-' || (k % 5) AS summary, NULL::VARCHAR AS peer, 'q' || what || (k % 5) AS once FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 'recipe' ELSE 'bot' END AS what FROM e WHERE kind = 'error')
  UNION ALL SELECT watcher, moment, id, 'soundness_violation', 'critical', 'Soundness gate violation: mod-' || (k % 6) || '/rule-' || k, NULL, NULL FROM e WHERE kind = 'signup' AND id % 7 = 0
  UNION ALL SELECT watcher, moment, id, 'anomaly_detected', CASE WHEN k % 3 = 0 AND id % 2 = 0 THEN 'critical' ELSE 'high' END,
    CASE k % 3 WHEN 0 THEN 'Statistical anomaly: recent rate ' || printf('%.2f', (k % 60) / 100.0::DOUBLE) || ' vs baseline 0.75 (' || printf('%.1f', 2 + k / 10.0::DOUBLE) || 'σ)' || CASE WHEN id % 2 = 0 THEN ' — ESN drift concurs' ELSE '' END
    WHEN 1 THEN 'Neural anomaly: ESN reports rising drift in success-rate forecast' ELSE 'Neural anomaly: ESN reports falling drift in success-rate forecast' END, NULL, 'a' || (k % 3) FROM e WHERE kind = 'purchase'
  UNION ALL SELECT watcher, moment, id, 'queue_depth_high', 'high', 'GenServer queue depth ' || (id * 7 % 150) || ' > 100 for proc-' || (k % 4), NULL, 'd' || (k % 4) FROM e WHERE (kind = 'view' OR kind = 'signup' AND id % 7 > 0) AND id * 7 % 150 > 100
  UNION ALL SELECT watcher, moment, id, 'events_dropped', 'medium', 'Watcher dropped ' || rise || ' telemetry event(s) under back-pressure', NULL, NULL
    FROM (SELECT *, floor(value)::BIGINT - lag(floor(value)::BIGINT, 1, 0) OVER (PARTITION BY watcher ORDER BY moment, id) AS rise FROM e WHERE kind = 'view' OR kind = 'signup' AND id % 7 > 0) WHERE rise > 0
  UNION ALL SELECT watcher, moment, id, 'quarantine_triggered', 'high', 'Recipe/bot auto-quarantined: recipe/far-' || k, 'peer-' || (k % 7), NULL FROM e WHERE kind = 'click'),
w AS (SELECT watcher, once, min({'moment': moment, 'id': id}) AS x FROM a WHERE once IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT w.watcher, w.once, (SELECT min({'moment': a.moment, 'id': a.id}) FROM a WHERE a.watcher = w.watcher AND a.once = w.once AND a.moment >= w.x.moment + 300000000) FROM w WHERE w.x IS NOT NULL),
t AS (SELECT watcher, moment, id, rule, severity, summary, peer FROM a WHERE once IS NULL OR id IN (SELECT x.id FROM w))"""


@query("t06_alerts", f"WITH RECURSIVE {_TELEMETRY} SELECT watcher, moment AS at_us, id, rule, severity, summary, peer FROM t")
def t06_alerts(spark, d):
    """Alerts of all rules, told once in five minutes where a rule says so, and those of peers."""
    return S.alerts(telemetry(V.table(spark, d, "events")), written).withColumnRenamed("at", "at_us")


@query("t07_alert_ring", f"WITH RECURSIVE {_TELEMETRY}, r AS (SELECT *, row_number() OVER (PARTITION BY watcher ORDER BY moment DESC, id DESC, rule) AS place FROM t) SELECT watcher, place, id, rule, coalesce(peer, '') AS federated_from FROM r WHERE place <= 100")
def t07_alert_ring(spark, d):
    """The last hundred alerts of each watcher, with the peer that a federated one came from."""
    told = S.alerts(telemetry(V.table(spark, d, "events")), written)
    return S.ring(told).select("watcher", F.col("place").cast("long").alias("place"), "id", "rule", F.coalesce("peer", F.lit("")).alias("federated_from"))


def watched(events: DataFrame) -> DataFrame:
    """Outcomes of watchers; an error or a signup is no success."""
    ts = F.timestamp_micros(F.expr("unix_micros(cast(ts AS timestamp)) div 60"))
    e = events.withColumn("ts", ts)
    return e.select(F.concat(F.lit("watch-"), F.expr("user_id div 50")).alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), (~F.col("event_type").isin("error", "signup")).alias("good"))


@query("t04_rolling_anomaly", """WITH RECURSIVE o AS (SELECT 'watch-' || (user_id // 50) AS watcher, epoch_us(ts) // 60 AS moment, event_id AS id, (event_type NOT IN ('error', 'signup'))::INT AS good FROM events),
n AS (SELECT *, row_number() OVER w AS n, sum(good) OVER (PARTITION BY watcher ORDER BY moment, id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) / 30.0::DOUBLE AS recent, avg(good) OVER (PARTITION BY watcher ORDER BY moment, id ROWS BETWEEN 199 PRECEDING AND 30 PRECEDING) AS baseline FROM o WINDOW w AS (PARTITION BY watcher ORDER BY moment, id)),
m AS (SELECT watcher, (moment // 60000000 + 1) * 60000000 AS tick, arg_max(recent, n) AS recent, arg_max(baseline, n) AS baseline, max(n) AS n FROM n GROUP BY ALL),
s AS (SELECT watcher, tick, recent, baseline, (baseline - recent) / sqrt(greatest(baseline * (1 - baseline) / (least(n, 200) - 30), 0.0001::DOUBLE)) AS sigma FROM m WHERE n >= 35),
l AS (SELECT * FROM s WHERE sigma > 2),
k(watcher, tick) AS (SELECT watcher, min(tick) FROM l GROUP BY 1 UNION ALL SELECT k.watcher, (SELECT min(l.tick) FROM l WHERE l.watcher = k.watcher AND l.tick >= k.tick + 300000000) FROM k WHERE k.tick IS NOT NULL)
SELECT watcher, tick, round(recent, 6) AS recent_rate, round(baseline, 6) AS baseline_rate, round(sigma, 6) AS sigma FROM k JOIN l USING (watcher, tick)""")
def t04_rolling_anomaly(spark, d):
    """Minutes at which the last 30 of 200 outcomes fell two sigmas below those before, told once in five minutes."""
    found = S.rolling_anomalies(watched(V.table(spark, d, "events")), written)
    return found.select(F.col("key").alias("watcher"), F.col("at").alias("tick"), F.round("recent", 6).alias("recent_rate"), F.round("baseline", 6).alias("baseline_rate"), F.round("sigma", 6).alias("sigma"))


@query("u07_alert_dedup", """WITH RECURSIVE e AS (SELECT event_type, user_id % 40 AS peer, floor(epoch(ts))::BIGINT AS sec FROM events), k(event_type, peer, sec) AS (SELECT event_type, peer, min(sec) FROM e GROUP BY 1, 2 UNION ALL SELECT k.event_type, k.peer, (SELECT min(e.sec) FROM e WHERE e.event_type = k.event_type AND e.peer = k.peer AND e.sec >= k.sec + 300) FROM k WHERE k.sec IS NOT NULL)
SELECT event_type, peer, sec FROM k WHERE sec IS NOT NULL""")
def u07_alert_dedup(spark, d):
    """Alerts that no kept alert of their key precedes by less than 5 minutes, by a chain of pointers."""
    e = V.table(spark, d, "events").select("event_type", (F.col("user_id") % 40).alias("peer"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    return greedy(e, ["event_type", "peer"], F.col("at") + 300, written, 300).select("event_type", "peer", F.col("at").alias("sec"))
