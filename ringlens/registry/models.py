from __future__ import annotations

from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.operators import attribution as A
from ringlens.operators import centrality as C
from ringlens.operators import data_checks as DC
from ringlens.operators import distribution as DI
from ringlens.operators import evidence as V
from ringlens.operators import explain as X
from ringlens.operators import models as M
from ringlens.operators import projection as P
from ringlens.operators import thresholds as TH
from ringlens.operators import typed_graph as G
from ringlens.plans import experiment, features, investigation, validation
from ringlens.registry.base import REGISTRY, cte
from ringlens.registry.communities import detected
from ringlens.registry.graph import PIVOTS
from ringlens.session import cut_lineage, shared_folder
from ringlens.sources import tables as IO

add = REGISTRY.add

# --- Sources and sinks ------------------------------------------------------------------


def _csv(d):
    folder = shared_folder(d.spark)
    counts = IO.write_tables(d.tables, folder)
    return IO.load_tables(d.spark, folder), counts


_TXN = ("transaction_id", "user_id", "amount", "merchant_id", "payment_instrument_id", "device_id", "ip_id", "address_id",
        "transaction_status", "is_abuse_transaction", "ring_id")
add("src_01_load_transactions",
    lambda d: _csv(d)[0]["transactions"].select(*_TXN, "promo_id", F.unix_seconds("timestamp").alias("seconds")),
    f"SELECT {', '.join(_TXN)}, coalesce(promo_id, '') AS promo_id, epoch(ts)::BIGINT AS seconds FROM txns")
_USER = [c for c in S.TABLES["users"].fieldNames() if c not in ("account_created_at", "group_id", "group_type")]
add("src_01_load_users", lambda d: _csv(d)[0]["users"].select(*_USER, "group_id", "group_type", F.date_format("account_created_at", "yyyy-MM-dd").alias("created")),
    f"SELECT {', '.join(_USER)}, nullif(group_id, '') AS group_id, nullif(group_type, '') AS group_type, strftime(account_created_at, '%Y-%m-%d') AS created FROM users")
add("snk_01_write_tables", lambda d: _csv(d)[1],
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {'txns' if t == 'transactions' else t}" for t in S.TABLES))
add("snk_04_dataset_manifest", lambda d: IO.dataset_manifest(d.tables).withColumn("columns", F.array_join("columns", ",")),
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, '{','.join(S.TABLES[t].fieldNames())}' AS columns FROM {'txns' if t == 'transactions' else t}" for t in S.TABLES))


def _saved_graph(d):
    folder = shared_folder(d.spark)
    edges = G.build_edges(d.transactions)
    IO.save_graph(G.build_nodes(edges, d.transactions), edges, folder)
    return IO.load_graph(d.spark, folder)


add("snk_03_saved_edges", lambda d: _saved_graph(d)[1], "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, edge_type, weight FROM all_edges")
add("src_03_reloaded_nodes", lambda d: _saved_graph(d)[0], "SELECT * FROM all_nodes")

# --- Feature tables ------------------------------------------------------------------------


def _store(d):
    """Feature files, written once like the job that precedes training."""

    def build():
        folder = shared_folder(d.spark)
        shapes = IO.write_features(features.build_split_features(d.tables, betweenness_pivots=250), folder)
        return folder, shapes.collect()

    return d.once("features", build)


def feature_table(d, variant="graph", split=None):
    return IO.load_features(d.spark, _store(d)[0], variant, split)


def _whole_features(d):
    transactions = P.single_view(d.transactions)
    graph = P.project_users(transactions).stored()
    table = features.user_graph_features(transactions, graph, betweenness_sources=C.pivots(graph.nodes, PIVOTS))
    return table.drop("view").withColumn("average_neighbor_degree", F.round("average_neighbor_degree", 8))


_WHOLE = {g: S.FEATURE_GROUPS[g] for g in ("direct", "shared_entity", "neighbor", "two_hop", "centrality")}
add("gf_28_user_graph_features", _whole_features,
    f"""SELECT d.user_id, {', '.join(f'coalesce({c}, 0) AS {c}' for own in _WHOLE.values() for c in own)} FROM direct d
        LEFT JOIN g_features USING (user_id) LEFT JOIN g_degrees USING (user_id) LEFT JOIN g_betweenness USING (user_id)""")
# All features but betweenness and communities, which are checked by themselves.
_CHECKED = tuple(n for n in S.MODEL_FEATURES["graph"] if n not in ("betweenness_centrality", *S.FEATURE_GROUPS["community"]))
# Days are multiples of a second: up to seven decimals, so only eight leave no halves to round.
_DIGITS = {c: 8 if "days" in c else 6 for c in _CHECKED}
cte("feature_table", f"""SELECT user_id, split, is_abuse_account::INT AS label, {', '.join(f'round(coalesce({c}, 0)::DOUBLE, {n}) AS {c}' for c, n in _DIGITS.items())}
  FROM users LEFT JOIN behaviour USING (user_id) LEFT JOIN direct USING (user_id) LEFT JOIN s_features USING (user_id) LEFT JOIN s_degrees USING (user_id)""")


def _rounded(table):
    return table.select("user_id", "split", "label", *[F.round(F.col(c).cast("double"), n).alias(c) for c, n in _DIGITS.items()])


add("gf_29_split_features", lambda d: _rounded(feature_table(d)), "SELECT * FROM feature_table")
add("gf_29_all_features", lambda d: feature_table(d))
add("snk_02_feature_files", lambda d: d.spark.createDataFrame(_store(d)[1], "variant string, split string, rows bigint, columns int"),
    """SELECT variant, split, count(*) AS rows, columns FROM users, (VALUES ('baseline', 25), ('graph', 52)) v(variant, columns) GROUP BY ALL""")
add("src_02_one_split", lambda d: feature_table(d, "baseline", "val").select("user_id", "split", "label", F.col("transaction_count").cast("bigint").alias("transaction_count")),
    """SELECT user_id, split, is_abuse_account::INT AS label, coalesce(transaction_count, 0) AS transaction_count FROM users LEFT JOIN behaviour USING (user_id) WHERE split = 'val'""")
add("snk_05_report", lambda d: d.spark.read.json(IO.write_report(TH.at_threshold(d.scored, 0.5), shared_folder(d.spark), "metrics")).select("fn", "fp", "tn", "tp"),
    """SELECT count(*) FILTER (prob < 0.5 AND label = 1) AS fn, count(*) FILTER (prob >= 0.5 AND label = 0) AS fp,
       count(*) FILTER (prob < 0.5 AND label = 0) AS tn, count(*) FILTER (prob >= 0.5 AND label = 1) AS tp FROM scored""")

# --- Models ----------------------------------------------------------------------------------

BASE, FULL = S.MODEL_FEATURES["baseline"], S.MODEL_FEATURES["graph"]
_GROUP = M.group_features(("direct",))
add("ml_01_group_features", lambda d: _rounded(feature_table(d)).select("user_id", "label", *_GROUP), f"SELECT user_id, label, {', '.join(_GROUP)} FROM feature_table")
add("ml_02_audited_matrix", lambda d: M.audited(feature_table(d, "baseline"), BASE))
add("ml_03_class_weights", lambda d: M.class_weights(feature_table(d, "baseline", "train")).select("n_pos", "n_neg", F.round("scale_pos_weight", 8).alias("scale_pos_weight")),
    """SELECT count(*) FILTER (is_abuse_account) AS n_pos, count(*) FILTER (NOT is_abuse_account) AS n_neg,
       round(n_neg / greatest(n_pos, 1), 8) AS scale_pos_weight FROM users WHERE split = 'train'""")


def _experiment(d):
    """All models of the experiment and the ablation, trained once, and their stored scores."""
    def build():
        trained = experiment.train_all(feature_table(d))
        return trained, cut_lineage(experiment.score_all(list(trained.values()), feature_table(d)))

    return d.once("experiment", build)


def _model(d, name):
    return _experiment(d)[0][name].model


def _scores(d, *names):
    return _experiment(d)[1].where(F.col("model_id").isin(*names))


def _reloaded(d):
    path = shared_folder(d.spark)
    M.save_model(d.spark, _model(d, "C"), path)
    return M.load_model(d.spark, path)


def _reports(d):
    return d.once("reports", lambda: {name: cut_lineage(t) for name, t in experiment.reports(
        _scores(d, *experiment.MAIN), d.users, scenario="city", hidden_groups="GRP_").items()})


_SCORE = ("user_id", "split", "label", "prob")
add("ml_04_logistic_scores", lambda d: _scores(d, "A").select(*_SCORE))
add("ml_05_boosted_scores", lambda d: _scores(d, "B", "C").select("model_id", *_SCORE))
add("ml_06_early_stopping", lambda d: _scores(d, "B_stopped").select(*_SCORE))
add("ml_07_scores_reloaded", lambda d: M.score(_reloaded(d), feature_table(d)).select(*_SCORE))
add("ml_07_reloaded_agrees", lambda d: M.score(_reloaded(d), feature_table(d)).select("user_id", "prob").join(
    _scores(d, "C").select("user_id", F.col("prob").alias("stored")), "user_id").select("user_id", (F.col("prob") == F.col("stored")).alias("same")),
    "SELECT user_id, true AS same FROM users")
_METHODS = ("gain", "weight", "cover")


def _importances(d, grouped=False):
    tables = [M.importance(d.spark, _model(d, "C"), method=m, top_k=len(FULL)) for m in _METHODS]
    return DC.combine([(M.grouped_importance(t) if grouped else t).withColumn("method", F.lit(m)) for t, m in zip(tables, _METHODS)])


add("ml_08_importance", lambda d: _importances(d))
add("ml_08_importance_by_group", lambda d: _importances(d, grouped=True))
add("ml_09_ablation", lambda d: (lambda own: experiment.ablation(_experiment(d)[1], own))([t for n, t in _experiment(d)[0].items() if n in S.ABLATIONS]))
add("ml_10_experiment", lambda d: _reports(d)["metrics"])
for _part in ("costs", "intervals", "rings", "ring_summary", "scenarios", "connected_legit", "false_positives", "false_negatives",
              "false_positives_by_group", "false_negatives_by_ring_type", "fp_rate_by_group", "recall_by_ring_type"):
    add(f"ml_10_{_part}", lambda d, part=_part: _reports(d)[part])


def _agreement(d):
    """Rows by which each report differs from plain SQL over the stored scores and the users."""
    found = _reports(d)
    metrics = found["metrics"].where("split = 'test'").select("model_id", "threshold")
    rows = _scores(d, *experiment.MAIN).where("split = 'test'").join(metrics, "model_id").join(d.users.drop("split"), "user_id")
    rows = cut_lineage(rows.selectExpr("*", "prob >= threshold AS hit", "nullif(ring_id, '') AS ring", "nullif(group_type, '') AS kind"))
    final = rows.where("model_id = 'C'")
    expected = {
        "metrics": (rows.groupBy("model_id").agg(F.expr("count_if(hit AND label = 1) AS tp"), F.expr("count_if(hit AND label = 0) AS fp"),
                                                 F.expr("count_if(NOT hit AND label = 1) AS fn")), found["metrics"].where("split = 'test'")),
        "costs": (rows.groupBy("model_id").agg(F.expr("5000.0D * count_if(hit AND label = 0) + 25000.0D * count_if(NOT hit AND label = 1) AS total_cost")), found["costs"]),
        "rings": (rows.where("is_abuse_account AND ring IS NOT NULL").groupBy("model_id", "ring_id").agg(F.expr("avg(cast(hit AS double)) >= 0.5 AS detected")), found["rings"]),
        "scenarios": (rows.where("is_abuse_account").groupBy("model_id", F.col("city").alias("scenario")).agg(F.expr("count_if(hit) AS detected")), found["scenarios"]),
        "false_positives": (final.where("hit AND label = 0").select("user_id"), found["false_positives"]),
        "false_negatives": (final.where("NOT hit AND label = 1").select("user_id"), found["false_negatives"]),
        "false_positives_by_group": (final.where("hit AND label = 0").groupBy(F.expr("coalesce(kind, 'individual') AS group_type")).agg(
            F.count("*").alias("false_positives")), found["false_positives_by_group"]),
    }
    parts = []
    for name, (want, got) in expected.items():
        counted = want.withColumn("side", F.lit(1)).unionByName(got.select(want.columns).withColumn("side", F.lit(-1)))
        parts.append(counted.groupBy(*want.columns).agg(F.sum("side").alias("n")).where("n <> 0").agg(F.count("*").alias("differences")).select(
            F.lit(name).alias("report"), "differences"))
    return DC.combine(parts)


add("ml_10_agreement", _agreement, " UNION ALL ".join(f"SELECT '{n}' AS report, 0 AS differences" for n in (
    "metrics", "costs", "rings", "scenarios", "false_positives", "false_negatives", "false_positives_by_group")))

# --- Explanations with a real model ------------------------------------------------------------


def _full_model(d):
    return _model(d, "C")


def _attributions(d):
    return d.once("attributions", lambda: cut_lineage(A.attributions(_full_model(d), feature_table(d), FULL)))


def _additivity(d):
    """What a user's attributions and the base lack to the log-odds of the score."""
    model = _full_model(d)
    base = A.base_value(A.leaves(model))
    sums = _attributions(d).groupBy("user_id").agg(F.sum("attribution").alias("total"))
    return sums.join(M.score(model, feature_table(d)).select("user_id", "prob"), "user_id").select(
        "user_id", (F.abs(F.col("total") + base - F.expr("ln(prob / (1 - prob))")) < 1e-4).alias("adds_up"))


add("ex_01_attributions", _attributions)
add("ex_01_additivity", _additivity, "SELECT user_id, true AS adds_up FROM users")
add("ex_02_attribution_summary", lambda d: X.attribution_summary(_attributions(d)))
add("ex_03_dependence", lambda d: X.dependence(_attributions(d), "average_transaction_amount"))
add("ex_04_top_attributions", lambda d: X.top_attributions(_attributions(d)))
add("ex_06_counterfactual_scores", lambda d: (lambda m: X.counterfactuals(
    feature_table(d), X.training_statistics(feature_table(d, split="train"), S.COUNTERFACTUAL_FEATURES), lambda rows: M.score(m, rows)))(_full_model(d)))

_CF = tuple(c for c in S.COUNTERFACTUAL_FEATURES if c in _CHECKED)
cte("cf_long", " UNION ALL ".join(f"SELECT user_id, split, '{c}' AS feature, {c} AS value FROM feature_table" for c in _CF))
cte("cf_stats", """SELECT feature, quantile_cont(value, 0.25) AS p25, median(value) AS median, quantile_cont(value, 0.75) AS p75 FROM cf_long
  WHERE split = 'train' GROUP BY feature""")
add("ex_05_training_statistics", lambda d: X.training_statistics(_rounded(feature_table(d, split="train")), _CF).select(
    "feature", *[F.round(c, 8).alias(c) for c in ("p25", "median", "p75")]),
    "SELECT feature, round(p25, 8) AS p25, round(median, 8) AS median, round(p75, 8) AS p75 FROM cf_stats")
add("ex_06_counterfactual_values",
    lambda d: X.counterfactual_values(_rounded(feature_table(d)), X.training_statistics(_rounded(feature_table(d, split="train")), _CF), _CF).select(
        "user_id", "feature", F.round("original_value", 8).alias("original_value"), F.round("counterfactual_value", 8).alias("counterfactual_value")),
    """SELECT user_id, feature, round(value, 8) AS original_value, round(cf, 8) AS counterfactual_value FROM (
       SELECT user_id, feature, value, CASE WHEN value > median THEN median ELSE p75 END AS cf FROM cf_long JOIN cf_stats USING (feature)) WHERE abs(cf - value) >= 1e-9""")


def _investigated(d):
    def build():
        graph, _, communities = detected(d)
        parts = investigation.investigate(
            feature_table(d), feature_table(d, split="train"), d.transactions, graph, communities, _full_model(d), FULL)
        return {name: cut_lineage(part) for name, part in parts.items()}

    return d.once("investigation", build)


add("inv_10_records", lambda d: _investigated(d)["record"])
add("inv_10_entities", lambda d: _investigated(d)["entities"],
    "SELECT user_id, node_type, row_number() OVER (PARTITION BY user_id, node_type ORDER BY entity_id) AS rank, entity_id FROM ent")
add("inv_10_related", lambda d: _investigated(d)["related"].withColumn("relationship_types", F.array_join("relationship_types", ",")),
    """SELECT user_id, related_id, array_to_string(types, ',') AS relationship_types, shared_entity_count,
       row_number() OVER (PARTITION BY user_id ORDER BY shared_entity_count DESC, related_id) AS rank FROM related""")
add("inv_10_list_counts", lambda d: _investigated(d)["record"].select("user_id", "n_devices", "n_ips", "n_addresses", "n_payments", "n_related"),
    """SELECT user_id, coalesce(n_devices, 0) AS n_devices, coalesce(n_ips, 0) AS n_ips, coalesce(n_addresses, 0) AS n_addresses,
       coalesce(n_payments, 0) AS n_payments, coalesce(n_related, 0) AS n_related FROM users
       LEFT JOIN (SELECT user_id, count(*) FILTER (node_type = 'device') AS n_devices, count(*) FILTER (node_type = 'ip') AS n_ips,
         count(*) FILTER (node_type = 'address') AS n_addresses, count(*) FILTER (node_type = 'payment_instrument') AS n_payments FROM ent GROUP BY user_id) USING (user_id)
       LEFT JOIN (SELECT user_id, count(*) AS n_related FROM related GROUP BY user_id) USING (user_id)""")
add("rsk_04_assessments", lambda d: investigation.assess(_investigated(d)["record"], model_version="boosted-1"))


def _audit(d):
    parts = _investigated(d)
    return X.audit(parts["factors"], parts["held"], parts["paths"], parts["counterfactuals"], parts["scores"], parts["edges"], parts["record"], FULL)


add("ex_08_audit", _audit, " UNION ALL ".join(
    f"""SELECT '{c}' AS "check", 0 AS errors""" for c in (
        "features_exist", "attributions_nontrivial", "graph_evidence_exists", "paths_exist", "no_labels_in_output", "counterfactual_validity")))
add("inv_14_why_factors", lambda d: X.why_factors(X.top_attributions(_attributions(d))))


def _why_this_user(d):
    """All lines of the answer: links, statements, factors, community."""
    graph, _, communities = detected(d)
    features, held = feature_table(d), V.entities(G.user_entity_edges(d.transactions))
    parts = (
        X.why_links(held, V.related_accounts(graph.edges)), X.why_statements(X.behavioural_summary(features)),
        X.why_factors(X.top_attributions(_attributions(d))), X.why_community(V.community_context(communities, graph.edges)),
    )
    return DC.combine([p.select("user_id", "rank", "title", "strength", "detail") for p in parts])


add("inv_14_why_this_user", _why_this_user)

# --- Quality of the feature tables ---------------------------------------------------------------


def _quality(d):
    return DI.feature_quality(_rounded(feature_table(d)), _CHECKED)


cte("quality_long", " UNION ALL ".join(f"SELECT '{c}' AS feature, split, {c} AS value FROM feature_table" for c in _CHECKED))
cte("quality", """SELECT feature, split, 0.0::DOUBLE AS missing_rate, count(DISTINCT value) AS unique_count, min(value) AS min, max(value) AS max,
  avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, any_value(top) / count(*) AS top_share
  FROM quality_long JOIN (SELECT feature, split, max(c) AS top FROM (SELECT feature, split, value, count(*) AS c FROM quality_long GROUP BY ALL) GROUP BY ALL)
  USING (feature, split) GROUP BY feature, split""")
_SHOWN = {"missing_rate": 5, "min": 9, "max": 9, "mean": 5, "median": 9, "std": 5, "top_share": 5}
add("val_32_feature_quality", lambda d: _quality(d).select("feature", "split", "unique_count", *[F.round(c, n).alias(c) for c, n in _SHOWN.items()]),
    "SELECT feature, split, unique_count, " + ", ".join(f"round({c}, {n}) AS {c}" for c, n in _SHOWN.items()) + " FROM quality")
add("val_32_feature_flags", lambda d: DI.feature_flags(_quality(d)),
    """SELECT feature, CASE WHEN unique_count <= 1 THEN 'constant' ELSE 'near_constant' END AS flag FROM quality
       WHERE split = 'train' AND (unique_count <= 1 OR (unique_count <= 2 AND top_share > 0.99))
       UNION ALL SELECT feature, 'distribution_shift' FROM quality a JOIN quality b USING (feature)
       WHERE a.split = 'train' AND b.split = 'test' AND a.std > 1e-9 AND abs(a.mean - b.mean) / a.std > 1""")
add("val_25_feature_tables", lambda d: DI.feature_name_audit(DI.column_names(feature_table(d).drop("split"))).unionByName(
    DI.label_is_binary(feature_table(d))).unionByName(DI.missing_splits(feature_table(d))).groupBy("check").agg(F.count(F.lit(1)).alias("findings")),
    """SELECT 'feature_table_exists' AS "check", count(*) AS findings FROM (SELECT unnest(['train', 'val', 'test']) AS s)
       WHERE s NOT IN (SELECT split FROM users) HAVING count(*) > 0""")
add("val_33_graph_findings", lambda d: validation.validate_graph(d.tables, feature_table(d)).drop("context"))
