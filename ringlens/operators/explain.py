"""Statements, counterfactuals, attribution summaries and audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.functions.ordered import exact_quantiles
from ringlens.operators.distribution import long_features
from ringlens.operators.evidence import related_accounts
from ringlens.operators.projection import UserGraph

# --- Behavioural statements -----------------------------------------------------------
# Bounds and texts. Values enter rounded to four decimals, as they are shown; shown digits are rounded half to even.

_PERCENT = "format_string('%.0f%%', bround({x} * 100, 0))"
_STATEMENTS = (
    """CASE WHEN transaction_frequency > 2.0 THEN concat('High transaction frequency (', format_string('%.1f', bround(transaction_frequency, 1)), ' per day).')
       WHEN transaction_frequency > 0.5 THEN concat('Moderate transaction frequency (', format_string('%.1f', bround(transaction_frequency, 1)), ' per day).') END""",
    f"""CASE WHEN promo_usage_rate > 0.5 THEN concat('High promotion usage rate (', {_PERCENT.format(x='promo_usage_rate')}, ' of transactions).')
       WHEN promo_usage_rate > 0.1 THEN concat('Moderate promotion usage rate (', {_PERCENT.format(x='promo_usage_rate')}, ' of transactions).') END""",
    """CASE WHEN average_transaction_amount > 0 THEN
       concat('Average transaction amount: ₹', format_number(bround(average_transaction_amount, 0), 0), '.') END""",
    "CASE WHEN transaction_count > 0 THEN concat('Total transactions: ', cast(transaction_count AS bigint), '.') END",
    """CASE WHEN unique_merchant_count <= 2 AND transaction_count > 5 THEN 'Low merchant diversity relative to transaction count.'
       WHEN unique_merchant_count > 10 THEN concat('High merchant diversity (', cast(unique_merchant_count AS bigint), ' unique merchants).') END""",
    f"CASE WHEN failed_transaction_rate > 0.1 THEN concat('Elevated failed transaction rate (', {_PERCENT.format(x='failed_transaction_rate')}, ').') END",
    f"CASE WHEN night_activity_rate > 0.3 THEN concat('Significant night-time activity (', {_PERCENT.format(x='night_activity_rate')}, ' of transactions).') END",
    f"CASE WHEN weekend_activity_rate > 0.5 THEN concat('Predominantly weekend activity (', {_PERCENT.format(x='weekend_activity_rate')}, ' of transactions).') END",
    """CASE WHEN recent_transaction_count_7d > 10 THEN
       concat('High recent activity (', cast(recent_transaction_count_7d AS bigint), ' transactions in last 7 days).') END""",
    "CASE WHEN account_age_days < 7 THEN concat('Very new account (', format_string('%.0f', bround(account_age_days, 0)), ' days old).') END",
)
_NOTHING = "No notable behavioural patterns detected."


def behavioural_summary(features: DataFrame) -> DataFrame:
    """``(user_id, statements, feature_values)`` from the behavioural features."""
    shown = features.select("user_id", *[F.round(F.round(F.col(c).cast("double"), 10), 4).alias(c) for c in S.BASELINE_FEATURES])
    listed = F.array_compact(F.array(*[F.expr(s) for s in _STATEMENTS]))
    values = F.create_map(*[x for c in S.BASELINE_FEATURES for x in (F.lit(c), F.col(c))])
    return shown.select(
        "user_id", F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(_NOTHING))).alias("statements"),
        values.alias("feature_values"),
    )


# --- Counterfactuals --------------------------------------------------------------------


def training_statistics(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(feature, p25, median, p75)`` of the training rows."""
    return exact_quantiles(long_features(features, names), ["feature"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})


def counterfactual_values(
    features: DataFrame, statistics: DataFrame, names: Sequence[str] = S.COUNTERFACTUAL_FEATURES
) -> DataFrame:
    """``(user_id, feature, original_value, counterfactual_value)``.

    A value above the training median moves to the median, any other to the upper quartile;
    a move below 1e-9 is no counterfactual. ``statistics`` has one row per feature.
    """
    moved = F.expr("CASE WHEN value > median THEN median ELSE p75 END")
    return (
        long_features(features, names, "user_id")
        .join(F.broadcast(statistics), "feature")
        .select("user_id", "feature", F.col("value").alias("original_value"), moved.alias("counterfactual_value"))
        .where("abs(counterfactual_value - original_value) >= 1e-9")
    )


def counterfactuals(
    features: DataFrame, statistics: DataFrame, score: Callable[[DataFrame], DataFrame],
    names: Sequence[str] = S.COUNTERFACTUAL_FEATURES,
) -> DataFrame:
    """Re-score every user with one feature changed at a time.

    ``score`` adds ``prob`` to a feature table. Rows are multiplied by the number of features
    inside the row's own task; the model is applied once to originals and copies alike.
    """
    stats = statistics.where(F.col("feature").isin(*names)).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "p75")))).alias("s")
    )
    items = [F.struct(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("from"), F.lit(None).cast("double").alias("to"))]
    base = features.withColumn("_s", stats.scalar())
    for name in names:
        value, stat = F.col(name).cast("double"), F.col("_s")[name]
        target = F.when(value > stat["median"], stat["median"]).otherwise(stat["p75"])
        items.append(F.when(F.abs(target - value) >= 1e-9, F.struct(F.lit(name).alias("feature"), value.alias("from"), target.alias("to"))))
    copies = base.withColumn("_c", F.explode(F.array_compact(F.array(*items)))).drop("_s")
    for name in names:
        copies = copies.withColumn(name, F.when(F.col("_c.feature") == name, F.col("_c.to")).otherwise(F.col(name).cast("double")))
    scored = score(copies).select("user_id", "_c", "prob")
    original = scored.where("_c.feature IS NULL").select("user_id", F.col("prob").alias("before"))
    return scored.where("_c.feature IS NOT NULL").join(original, "user_id").select(
        "user_id", F.col("_c.feature").alias("feature"), F.round("_c.from", 6).alias("original_value"),
        F.round("_c.to", 6).alias("counterfactual_value"), F.round("before", 6).alias("original_probability"),
        F.round("prob", 6).alias("counterfactual_probability"), F.round(F.col("prob") - F.col("before"), 6).alias("probability_delta"),
    )


def ordered_counterfactuals(rows: DataFrame) -> DataFrame:
    """One row per user with the counterfactuals nested, largest change first (at most one per feature)."""
    item = F.struct((-F.abs("probability_delta")).alias("o"), "feature", "original_value", "counterfactual_value",
                    "original_probability", "counterfactual_probability", "probability_delta")
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("items")).selectExpr(
        "user_id",
        "transform(items, x -> struct(x.feature, x.original_value, x.counterfactual_value, x.original_probability, "
        "x.counterfactual_probability, x.probability_delta)) AS counterfactuals",
    )


# --- Attributions -----------------------------------------------------------------------


def _descriptions() -> Column:
    return F.create_map(*[F.lit(x) for pair in S.FEATURE_DESCRIPTIONS.items() for x in pair])


def attribution_summary(attributions: DataFrame, n: int = 20) -> DataFrame:
    """Features by mean absolute attribution; ``attributions`` is (user_id, feature, value, attribution)."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature").limit(n)


def dependence(attributions: DataFrame, feature: str, n: int = 500) -> DataFrame:
    """Value and attribution of one feature for the ``n`` users first in hash order."""
    return (
        attributions.where(F.col("feature") == feature)
        .orderBy(F.md5("user_id"), "user_id").limit(n).select("user_id", "value", "attribution")
    )


def top_attributions(attributions: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest attributions per user with direction and description."""
    order = Window.partitionBy("user_id").orderBy(F.desc(F.abs("attribution")), "feature")
    top = attributions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select(
        "user_id", "rank", "feature", F.round("value", 6).alias("value"), F.round("attribution", 6).alias("attribution"),
        F.when(F.col("attribution") > 0, "increases_risk").otherwise("decreases_risk").alias("direction"),
        F.coalesce(_descriptions()[F.col("feature")], F.col("feature")).alias("description"),
    )


# --- Target selection and audit -----------------------------------------------------------

# Reason, condition, order, how many.
_TARGETS = (
    ("high_risk", "true", "-prob", 5),
    ("legitimate_high_connectivity", "label = 0 AND prob > 0.1", "-prob", 2),
    ("false_positive", "label = 0 AND prob >= {t}D", "-prob", 2),
    ("false_negative", "label = 1 AND prob < {t}D", "prob", 2),
    ("indirect_multi_hop_case", "prob > 0.1 AND prob < 0.6", "user_id", 1),
)


def select_targets(scored: DataFrame, threshold: float) -> DataFrame:
    """``(user_id, selection_reason, prob)``: a varied handful of users, nobody twice.

    Earlier reasons take their users first. Each reason needs no more candidates than its
    quota plus all users taken before, so only those few rows are compared.
    """
    taken: DataFrame | None = None
    for reason, condition, order, n in _TARGETS:
        rows = scored.where(condition.format(t=threshold))
        if taken is not None:
            rows = rows.join(F.broadcast(taken.select("user_id")), "user_id", "left_anti")
        chosen = rows.orderBy(F.expr(order), "user_id").limit(n).select("user_id", F.lit(reason).alias("selection_reason"), "prob")
        taken = chosen if taken is None else taken.unionByName(chosen)
    return taken


def audit_evidence_edges(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence rows ``(user_id, entity_id)`` that are no edge of the graph."""
    known = edges.selectExpr("src AS user_id", "dst AS entity_id").distinct()
    return evidence.select("user_id", "entity_id").join(known, ["user_id", "entity_id"], "left_anti")


def audit_path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps of reported paths that are no edge of the graph: ``(user_id, a, b)``."""
    steps = paths.select("user_id", F.explode(F.expr(
        "transform(sequence(1, size(nodes) - 1), i -> if(i % 2 = 1, struct(nodes[i - 1] AS a, nodes[i] AS b), struct(nodes[i] AS a, nodes[i - 1] AS b)))"
    )).alias("s")).select("user_id", "s.a", "s.b")
    known = edges.selectExpr("src AS a", "dst AS b").distinct()
    return steps.join(known, ["a", "b"], "left_anti").select("user_id", "a", "b")


def label_fields_in(df: DataFrame) -> list[str]:
    """Label columns anywhere in the (nested) schema of an output."""
    def names(kind) -> list[str]:
        found = []
        for field in getattr(kind, "fields", []):
            found += [field.name, *names(field.dataType)]
        for inner in ("elementType", "valueType"):
            if hasattr(kind, inner):
                found += names(getattr(kind, inner))
        return found

    return sorted(set(names(df.schema)) & set(S.LABEL_FIELDS))


def audit(attributions: DataFrame, evidence: DataFrame, paths: DataFrame, counterfactual_rows: DataFrame,
          scores: DataFrame, edges: DataFrame, records: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(check, errors)`` for the six properties every explanation must have."""
    def errors(check: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("errors")).select(F.lit(check).alias("check"), "errors")

    zero = attributions.groupBy("user_id").agg(F.max(F.abs("attribution")).alias("m")).where("m = 0")
    score = scores.selectExpr("user_id", "prob AS risk_score")
    odd = counterfactual_rows.join(score, "user_id").where(
        "abs(original_probability - risk_score) > 0.01 OR counterfactual_probability < 0 OR counterfactual_probability > 1 "
        "OR abs(probability_delta - (counterfactual_probability - original_probability)) > 0.001"
    )
    leaked = label_fields_in(records)
    parts = [
        errors("features_exist", attributions.where(~F.col("feature").isin(*features))),
        errors("attributions_nontrivial", zero),
        errors("graph_evidence_exists", audit_evidence_edges(evidence, edges)),
        errors("paths_exist", audit_path_edges(paths, edges).select("user_id").distinct()),
        records.sparkSession.createDataFrame([("no_labels_in_output", len(leaked))], "check string, errors bigint"),
        errors("counterfactual_validity", odd),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


# --- "Why this user" ------------------------------------------------------------------------

# Relationship, title, noun, strength.
_LINK_LINES = (
    ("shared_device", "device", "Shared Device", "device", "HIGH"),
    ("shared_payment_instrument", "payment_instrument", "Shared Payment", "payment instrument", "HIGH"),
    ("shared_address", "address", "Shared Address", "address", "MEDIUM"),
    ("shared_ip", "ip", "Shared IP", "IP", "INDIRECT"),
)


def _plural(count: str, noun: str) -> str:
    return f"concat({count}, ' {noun}', if({count} = 1, '', 's'))"


def why_links(entity_rows: DataFrame, related: DataFrame | UserGraph) -> DataFrame:
    """``(user_id, rank, title, strength, detail)``: one line per kind of linking entity.

    ``related`` lists related accounts one by one, or is a user graph; with homes, it counts them without listing any.
    """
    held = entity_rows.groupBy("user_id").agg(
        *[F.expr(f"count_if(node_type = '{node}') AS e_{node}") for _, node, _, _, _ in _LINK_LINES]
    )
    if isinstance(related, UserGraph) and related.homes is not None:
        count = {rel: c for c, rel in S.RELATIONSHIP_LABELS.items()}
        sharing = related.accounts_by_kind().groupBy("user_id").agg(*[F.sum(count[rel]).alias(f"a_{node}") for rel, node, _, _, _ in _LINK_LINES])
    else:
        listed = related_accounts(related) if isinstance(related, UserGraph) else related
        sharing = listed.groupBy("user_id").agg(
            *[F.expr(f"count_if(array_contains(relationship_types, '{rel}')) AS a_{node}") for rel, node, _, _, _ in _LINK_LINES]
        )
    lines = []
    for rank, (_, node, title, noun, strength) in enumerate(_LINK_LINES, start=1):
        things, accounts = _plural(f"e_{node}", noun), _plural(f"a_{node}", "account")
        detail = (
            f"if(a_{node} > 0, concat({accounts}, ' share ', {things}, ' with this subject.'), "
            f"concat({things}, ' linked to this subject; no related account shares them in the loaded evidence.'))"
        )
        lines.append(f"CASE WHEN e_{node} > 0 THEN named_struct('rank', {rank}, 'title', '{title}', 'strength', '{strength}', 'detail', {detail}) END")
    zeros = [f"a_{node}" for _, node, _, _, _ in _LINK_LINES]
    return (
        held.join(sharing, "user_id", "left").na.fill(0, zeros)
        .select("user_id", F.explode(F.expr(f"array_compact(array({', '.join(lines)}))")).alias("line"))
        .select("user_id", "line.*")
    )


def why_statements(summaries: DataFrame) -> DataFrame:
    return summaries.select("user_id", F.posexplode(F.slice("statements", 1, 2)).alias("p", "detail")).selectExpr(
        "user_id", "10 + p AS rank", "'Behavioral Signal' AS title", "'MEDIUM' AS strength", "detail"
    )


def why_factors(top: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("rank")
    positive = top.where("attribution > 0").withColumn("r", F.row_number().over(order)).where("r <= 2")
    return positive.selectExpr(
        "user_id", "20 + r AS rank", "'Model Factor' AS title", "'INDIRECT' AS strength",
        "concat(description, ' (SHAP +', format_string('%.3f', attribution), ').') AS detail",
    )


def why_community(context: DataFrame) -> DataFrame:
    return context.where("community_size > 1").selectExpr(
        "user_id", "30 AS rank", "'Community Context' AS title", "'INDIRECT' AS strength",
        f"concat('Sits in a community of ', {_plural('community_size', 'account')}, ' at density ', format_string('%.3f', community_density), '.') AS detail",
    )
