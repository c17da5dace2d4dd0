"""The whole catalog of a project: source, history, people and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import clusters as C
from weftgraph.operators import edges as E
from weftgraph.plans.call_graph import build_catalog, build_versions
from weftgraph.session import stored
from weftgraph.sources import snapshots as N
from weftgraph.sources.tables import changed_functions

DEVELOPER_MODES = ("contributors", "pr_authors", "commit_authors")


def history_tables(issues: DataFrame, pulls: DataFrame, pr_files: DataFrame, functions: DataFrame, most_issues: int = 0, most_pulls: int = 100, done: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five tables of issues and pull requests on functions that are known: nodes, their links, which functions pull requests change, and those functions."""
    issue_nodes, pull_nodes = N.issue_nodes(issues, most_issues), stored(N.pull_nodes(pulls, most_pulls, done), "pulls")
    bodies = pulls.select(F.col("number").alias("ID"), "body", F.transform("comments", lambda c: c["body"]).alias("said")).join(pull_nodes.select("ID"), "ID", "left_semi")
    changed = changed_functions(pr_files.join(pull_nodes.select(F.col("ID").alias("number")), "number", "left_semi"))
    return {
        "issue_nodes": issue_nodes, "pr_nodes": pull_nodes.select("ID", "pr_title", "pr_body", "pr_open"), "issue_pr_edges": E.issue_links(bodies, issue_nodes, "body", "said"),
        "pr_function_edges": E.pull_function_edges(changed, functions), "function_nodes": functions,
    }


def cluster_tables(functions: DataFrame, most: int = 50) -> dict[str, DataFrame]:
    """cluster_nodes with the names most alike as their summary, cluster_function_edges and the questions' tables."""
    labelled = stored(C.cluster_names(functions.select("combinedName").distinct(), "combinedName", most), "clusters")
    summary = C.sampled_names(labelled, "label", "combinedName", "combinedName").select((F.col("label") + 1).cast("bigint").alias("ID"), F.col("names").alias("summary"))
    members = functions.join(labelled, "combinedName").select((F.col("label") + 1).cast("bigint").alias("source"), F.col("ID").alias("target")).distinct()
    questions = E.question_nodes(functions.sparkSession)
    return {"cluster_nodes": summary, "cluster_function_edges": members, "question_nodes": questions, "question_cluster_edges": E.question_cluster_edges(questions, summary)}


def build_knowledge_graph(
    files: DataFrame, snapshots: dict[str, DataFrame] | None = None, language: str = "python", graph: str = "AST", clusters: bool = False, developer_mode: str = "contributors",
    most_issues: int = 0, most_pulls: int = 100, versions: int = 300, remove_isolated: bool = False,
) -> dict[str, DataFrame]:
    """The catalog of files (path, content), and of what snapshots there are (issues, pull_requests, pr_files, artifacts, contributors, commits, commit_files).

    What has no snapshot has no tables. developer_mode says which edges developers
    have: none (contributors), through pull requests, or through commits.
    """
    if developer_mode not in DEVELOPER_MODES:
        raise ValueError(f"developer_mode must be one of {DEVELOPER_MODES}")
    given = snapshots or {}
    catalog = build_catalog(files, language, graph, remove_isolated)
    functions = catalog["function_nodes"]
    if {"issues", "pull_requests", "pr_files"} <= given.keys():
        catalog |= history_tables(given["issues"], given["pull_requests"], given["pr_files"], functions, most_issues, most_pulls)
    if "artifacts" in given:
        catalog["artifacts"] = N.artifact_nodes(given["artifacts"])
    if "contributors" in given:
        catalog["developer_nodes"] = N.contributor_nodes(given["contributors"])
        if developer_mode == "pr_authors" and "pr_function_edges" in catalog:
            pulls = given["pull_requests"].select(F.col("number").alias("ID"), "author_login")
            catalog["developer_nodes"], catalog["developer_function_edges"] = E.developer_tables(given["contributors"], pulls, catalog["pr_function_edges"])
        elif developer_mode == "commit_authors" and {"commits", "commit_files"} <= given.keys():
            named = E.commit_author_edges(given["commits"], given["commit_files"], functions.select("file_id", F.col("function_location").alias("path")).distinct(), functions)
            logins = catalog["developer_nodes"].select(F.col("dev_name").alias("source"), F.col("ID").alias("dev"))
            catalog["developer_function_edges"] = named.join(logins, "source").select(F.col("dev").alias("source"), "target", "commit_sha")
    if {"commits", "commit_files"} <= given.keys() and language == "python":
        catalog |= build_versions(given["commits"], N.changed_files(given["commit_files"]), functions, versions)
    if clusters:
        catalog |= cluster_tables(functions)
    return catalog


def ensemble_inputs(edges: DataFrame, semantic: DataFrame, rounds: int = 10) -> DataFrame:
    """(func_id, semantic, community): the semantic label of each function beside its community's, renamed to agree as far as can be."""
    found = C.label_propagation(edges, rounds)
    ranks = found.groupBy("label").count().withColumn("community", F.dense_rank().over(Window.orderBy(F.desc("count"), "label")) - 1)  # a row for each community
    both = semantic.join(found.join(ranks.select("label", F.col("community").cast("bigint")), "label").select(F.col("node").alias("func_id"), "community"), "func_id")
    return C.aligned(both, "semantic", "community")
