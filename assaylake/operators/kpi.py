"""Conversation measures: sentiment, risk, latency and an overall score, each an aggregation of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the overall score's parts; parts without a value drop out and the rest is renormalized.
WEIGHTS = {"core": 0.20, "quality": 0.25, "sentiment": 0.15, "safety": 0.25, "technical": 0.15}


def speaker_sentiment(turns: DataFrame, cut: float = 0.15) -> DataFrame:
    """Confidence-weighted mean of each speaker; a confidence of 0 weighs 1 but adds nothing."""
    weight = F.when(F.col("confidence") == 0, 1.0).otherwise(F.col("confidence"))
    s = turns.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("turns"), (F.sum(F.col("sentiment") * F.col("confidence")) / F.sum(weight)).alias("x"))
    return s.select("conv_id", "role", "turns", F.round("x", 4).alias("sentiment"), F.when(F.col("x") > cut, "positive").when(F.col("x") < -cut, "negative").otherwise("neutral").alias("label"))


def _grade(levels: tuple[float, float, float, float]) -> Column:
    """high, medium, low, any other severity."""
    s = F.col("severity")
    return F.when(s == "high", levels[0]).when(s == "medium", levels[1]).when(s == "low", levels[2]).otherwise(levels[3])


# Risk of each severity, and what a compliance violation costs.
RISKS = {"pii": (0.9, 0.6, 0.3, 0.5), "unsafe": (0.8, 0.5, 0.2, 0.4), "compliance": (0.95, 0.65, 0.35, 0.5)}
TURN_RISKS = (0.7, 0.4, 0.2, 0.3)
VIOLATIONS = (40.0, 25.0, 15.0, 15.0)


def risk(calls: DataFrame, safety: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, risk, confidence, alerts of every conversation.

    ``safety`` has conv_id, kind (pii, unsafe, compliance), k, hit, severity, confidence; ``turns`` has conv_id, flagged,
    severity, confidence, alert. The risk is the largest factor, where the flagged turns together are one of 0.3 times
    their mean; the confidence is the mean over the factors; both are 0 without any. Alerts are the sorted union.
    """
    hits = safety.filter("hit")
    factor = F.when(F.col("kind") == "pii", _grade(RISKS["pii"])).when(F.col("kind") == "unsafe", _grade(RISKS["unsafe"])).otherwise(_grade(RISKS["compliance"]))
    marks = turns.filter("flagged").groupBy("conv_id").agg((F.avg(_grade(TURN_RISKS)) * 0.3).alias("factor"), F.avg("confidence").alias("confidence"))
    worst = hits.select("conv_id", factor.alias("factor"), "confidence").unionByName(marks).groupBy("conv_id").agg(F.max("factor").alias("risk"), F.avg("confidence").alias("confidence"))
    high = lambda name: F.when(F.col("severity") == "high", F.lit(name))
    named = (
        F.when(F.col("kind") == "pii", F.array(F.lit("pii_leakage"), high("high_risk_pii")))
        .when(F.col("kind") == "unsafe", F.array(F.lit("unsafe_response"), high("high_risk_unsafe_content")))
        .otherwise(F.array(F.concat(F.lit("compliance_violation_"), F.col("k").cast("string")), high("high_risk_compliance")))
    )
    each = hits.select("conv_id", F.explode(F.array_compact(named)).alias("alert")).unionByName(turns.filter("alert is not null").select("conv_id", "alert"))
    alerts = each.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("alert")), ",").alias("alerts"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return calls.select("conv_id").join(worst, "conv_id", "left").join(alerts, "conv_id", "left").select("conv_id", zero("risk"), zero("confidence"), F.coalesce("alerts", F.lit("")).alias("alerts"))


def overall(calls: DataFrame, risks: DataFrame, safety: DataFrame) -> DataFrame:
    """The five parts of each conversation, from 0 to 100, and their weighted mean. A part that a call lacks drops out.

    ``calls`` has one row of measures a conversation; ``has_core`` and so on say which parts it has. The safety part takes
    the risk as it is: without any risk there is no leak or unsafe answer left to take off.
    """
    c, off = F.col, lambda x, n: F.when(x, float(n)).otherwise(0.0)
    broken = safety.filter("hit and kind = 'compliance'").groupBy("conv_id").agg(F.sum(_grade(VIOLATIONS) + off(c("confidence") > 0.8, 10)).alias("loss"))
    alert = lambda name: F.contains(c("alerts"), F.lit(name))
    slow = F.when(c("latency_ms") > 5000, 20.0).when(c("latency_ms") > 3000, 10.0).otherwise(0.0)
    parts = {
        "core": 100 - slow - 5 * c("interruptions") - 3 * c("repetitions") - 2 * c("silences"),
        "quality": 100 - off(~c("intent_match"), 20) - 10 * (1 - c("intent_confidence")) - off(c("hallucination"), 30) - off(c("deviation"), 15) - F.when(c("completed"), 10 * (1 - c("completion_confidence"))).otherwise(25.0),
        "sentiment": 100 - F.when(c("user_mood") == "negative", 30.0).when(c("user_mood") == "neutral", 10.0).otherwise(0.0) - 5 * (1 - c("user_confidence")) - off(c("agent_mood") == "negative", 10) - off(c("frustration"), 15) - off(c("escalation"), 10),
        "safety": 100 - 60 * c("risk") - F.coalesce("loss", F.lit(0.0)) - off(alert("high_risk_pii"), 20) - off(alert("high_risk_unsafe_content"), 20) - off(alert("high_risk_compliance"), 30),
        "technical": F.when(c("mos").isNotNull(), 20 * (c("mos") - 1))
        .when(c("audio").isNotNull(), 100 * c("audio") - off(c("distorted"), 15) - F.when(c("snr") < 10, 20.0).when(c("snr") < 20, 10.0).otherwise(0.0))
        .otherwise(100.0)
        - 5 * c("tool_errors")
        - F.when(c("processing_ms") > 60000, 10.0).when(c("processing_ms") > 30000, 5.0).otherwise(0.0)
        - off(~c("available"), 15),
    }
    j = calls.join(risks.select("conv_id", "risk", "alerts"), "conv_id").join(broken, "conv_id", "left")
    clamped = {k: F.least(F.lit(100.0), F.greatest(F.lit(0.0), v)) for k, v in parts.items()}
    j = j.select("conv_id", *[(v if k == "safety" else F.when(c(f"has_{k}"), v)).alias(k) for k, v in clamped.items()])
    weighed = sum((F.coalesce(c(k), F.lit(0.0)) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    present = sum((F.when(c(k).isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    return j.select("conv_id", *[F.round(k, 6).alias(k) for k in WEIGHTS], F.round(weighed / present, 2).alias("score"))
