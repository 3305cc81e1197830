"""Risk levels, decisions, reasons and the review queue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlens.functions.ordered import exact_quantiles

POLICY_VERSION = "1.0.0"


@dataclass(frozen=True)
class Policy:
    """Score bands; a score equal to a bound belongs to the higher band."""

    medium: float = 0.2
    high: float = 0.5
    critical: float = 0.8

    def _bands(self, score: Column, critical: str, high: str, medium: str, low: str | None) -> Column:
        return (
            F.when(score >= self.critical, critical).when(score >= self.high, high)
            .when(score >= self.medium, medium).otherwise(F.lit(low))
        )

    def decision(self, score: Column) -> Column:
        return self._bands(score, "escalate", "review", "monitor", "allow")

    def priority(self, score: Column) -> Column:
        return self._bands(score, "urgent", "high", "normal", None)


def risk_level(score: Column) -> Column:
    """Display level; its bands are fixed while the policy's may move."""
    return F.when(score >= 0.8, "critical").when(score >= 0.5, "high").when(score >= 0.2, "medium").otherwise("low")


def decide(scored: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Decision and priority of each score; a ``risk_level`` that the rows already carry is kept."""
    score = F.col("prob")
    level = F.col("risk_level") if "risk_level" in scored.columns else risk_level(score)
    return scored.select(
        "user_id", score.alias("risk_score"), level.alias("risk_level"),
        policy.decision(score).alias("decision"), policy.priority(score).alias("review_priority"),
    )


# --- Reasons ------------------------------------------------------------------------
# Reason codes, conditions on the evidence row, and texts.

_GRAPH_REASONS = (
    ("GRAPH_SHARED_DEVICE", "n_devices > 0", "concat('User shares ', n_devices, ' device(s).')"),
    ("GRAPH_SHARED_IP", "n_ips > 0", "concat('User shares ', n_ips, ' IP address(es).')"),
    ("GRAPH_SHARED_ADDRESS", "n_addresses > 0", "concat('User shares ', n_addresses, ' physical address(es).')"),
    ("GRAPH_SHARED_PAYMENT", "n_payments > 0", "concat('User shares ', n_payments, ' payment instrument(s).')"),
    ("GRAPH_CONNECTED_ACCOUNTS", "n_related > 0",
     "concat('User is directly connected to ', n_related, ' other account(s) via shared entities.')"),
    ("GRAPH_MULTI_HOP", "n_paths > 0", "concat('User is part of ', n_paths, ' multi-hop path(s) spanning across the network.')"),
    ("GRAPH_DENSE_COMMUNITY", "community_density > 0.5",
     "concat('User is in a highly dense community (density: ', format_string('%.2f', bround(community_density, 2)), ').')"),
)
_BEHAVIOUR_REASONS = (
    ("BEHAVIORAL_HIGH_ACTIVITY", "transaction_frequency > 2.0", "'User exhibits high transaction frequency.'"),
    ("BEHAVIORAL_HIGH_PROMO", "promo_usage_rate > 0.5", "'User has a high promotion usage rate.'"),
    ("BEHAVIORAL_NEW_ACCOUNT", "account_age_days < 7", "'Account is very new (less than 7 days old).'"),
    ("BEHAVIORAL_NIGHT_ACTIVITY", "night_activity_rate > 0.3", "'Significant night-time transaction activity.'"),
    ("BEHAVIORAL_WEEKEND_ACTIVITY", "weekend_activity_rate > 0.5", "'Predominantly weekend transaction activity.'"),
    ("BEHAVIORAL_HIGH_FAIL_RATE", "failed_transaction_rate > 0.1", "'Elevated failed transaction rate.'"),
)
_MODEL_REASON = (
    "MODEL_HIGH_RISK_FACTOR", "top_direction = 'increases_risk'", "concat('Primary risk factor: ', top_description)",
)
GRAPH_INPUTS = ("n_devices", "n_ips", "n_addresses", "n_payments", "n_related", "n_paths", "community_density")
BEHAVIOUR_INPUTS = (
    "transaction_frequency", "promo_usage_rate", "account_age_days", "night_activity_rate",
    "weekend_activity_rate", "failed_transaction_rate",
)


def reasons(evidence: DataFrame) -> Column:
    """``array<struct<code, description>>`` in a fixed order, from whichever evidence exists.

    Rates are compared as shown to the investigator, rounded to four decimals.
    """
    rules = []
    if set(GRAPH_INPUTS) <= set(evidence.columns):
        rules += _GRAPH_REASONS
    if set(BEHAVIOUR_INPUTS) <= set(evidence.columns):
        for code, condition, text in _BEHAVIOUR_REASONS:
            name, sign, bound = condition.split()
            rules.append((code, f"round({name}, 4) {sign} {bound}", text))
    if {"top_direction", "top_description"} <= set(evidence.columns):
        rules.append(_MODEL_REASON)
    if not rules:
        raise ValueError("no evidence columns to derive reasons from")
    items = [F.expr(f"CASE WHEN {when} THEN named_struct('code', '{code}', 'description', {text}) END") for code, when, text in rules]
    return F.array_compact(F.array(*items))


def assess(decided: DataFrame, evidence: DataFrame, *, model_version: str) -> DataFrame:
    """Decisions with their reasons and the versions that produced them."""
    explained = evidence.select("user_id", reasons(evidence).alias("reasons"))
    return decided.join(explained, "user_id", "left").withColumns(
        {"model_version": F.lit(model_version), "policy_version": F.lit(POLICY_VERSION)}
    )


def score_users(assessments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Assessments of the listed users; unknown ids are skipped."""
    return assessments.join(wanted.select("user_id").distinct(), "user_id", "left_semi")


# --- Queue --------------------------------------------------------------------------

_RANK = "CASE review_priority WHEN 'urgent' THEN 4 WHEN 'high' THEN 3 WHEN 'normal' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def review_queue(assessments: DataFrame) -> DataFrame:
    """Accounts needing a person, most urgent first, then by score; one row per user."""
    waiting = assessments.where(F.col("decision").isin("review", "escalate"))
    return waiting.orderBy(F.expr(_RANK).desc(), F.desc("risk_score"), "user_id")


def top_of_queue(assessments: DataFrame, n: int = 10) -> DataFrame:
    if n <= 0:
        raise ValueError("n must be positive")
    return review_queue(assessments).limit(n)


def queue_size(assessments: DataFrame) -> DataFrame:
    return assessments.agg(F.expr("count_if(decision IN ('review', 'escalate'))").alias("queue_size"))


def risk_distribution(assessments: DataFrame) -> DataFrame:
    """``(kind, value, users)`` counts of levels and decisions."""
    items = F.expr("array(struct('level' AS kind, risk_level AS value), struct('decision' AS kind, decision AS value))")
    return assessments.select(F.explode(items).alias("i")).groupBy("i.kind", "i.value").agg(F.count(F.lit(1)).alias("users"))


def score_statistics(assessments: DataFrame) -> DataFrame:
    tails = exact_quantiles(assessments, [], "risk_score", {"median": 0.5, "p95": 0.95, "p99": 0.99})
    return assessments.agg(
        F.min("risk_score").alias("min"), F.max("risk_score").alias("max"), F.avg("risk_score").alias("mean")
    ).withColumn("_t", tails.select(F.struct("*")).scalar()).select("min", "max", "mean", "_t.*")


def examples(assessments: DataFrame, quota: Sequence[tuple[str, str, int]] = (
    ("high", "risk_score >= 0.5", 5), ("medium", "risk_score >= 0.2 AND risk_score < 0.5", 3), ("low", "risk_score < 0.2", 2),
)) -> DataFrame:
    """The first users, in id order, of each band."""
    parts = [
        assessments.where(condition).orderBy("user_id").limit(n).withColumn("band", F.lit(band)) for band, condition, n in quota
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table

