"""All checks of a data set in one table, with reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ringlens.operators import behaviour, data_checks, distribution, graph_checks, projection, typed_graph
from ringlens.session import cut_lineage
from ringlens.sources.tables import write_report


def validate_data(tables: Mapping[str, DataFrame], start: str, end: str) -> DataFrame:
    users, transactions = tables["users"], tables["transactions"]
    accounts = behaviour.account_features(users, transactions)
    columns = [c for df in tables.values() for c in df.columns if c not in distribution.S.FORBIDDEN_FEATURES]
    allowed = users.sparkSession.createDataFrame([(c,) for c in sorted(set(columns))], "name string")
    return data_checks.combine([
        data_checks.integrity(tables, start, end), data_checks.labels(users, transactions), data_checks.splits(users),
        distribution.distribution_checks(accounts),
        distribution.leakage_checks(users, transactions, tables["devices"], tables["ips"], accounts, allowed),
    ])


def validate_graph(tables: Mapping[str, DataFrame], features: DataFrame) -> DataFrame:
    users, transactions = tables["users"], tables["transactions"]
    edges = typed_graph.build_edges(transactions)
    nodes = typed_graph.build_nodes(edges, transactions)
    members = users.selectExpr("split AS view", "user_id")
    graph = projection.project_users(projection.split_views(transactions, users), members)
    return data_checks.combine([
        graph_checks.node_existence(nodes, tables), graph_checks.self_loops(edges), graph_checks.edge_provenance(edges, transactions),
        graph_checks.label_independence(tables), distribution.feature_name_audit(distribution.column_names(features.drop("split"))),
        distribution.label_is_binary(features), graph_checks.split_isolation(graph, graph.nodes, users),
        graph_checks.recency_bounds(features, transactions),
    ])


def report(findings: DataFrame, folder: str) -> None:
    """The findings of each module in a folder of its own, the counts per module, and the overall counts, as JSON."""
    findings = cut_lineage(findings)  # checked once, reported three times
    findings.write.mode("overwrite").partitionBy("module").json(f"{folder.rstrip('/')}/findings")
    write_report(data_checks.summarize(findings), folder, "modules")
    write_report(data_checks.overall(findings), folder, "overall")
