"""From source files to the catalog's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.operators import edges as E
from weftgraph.operators.linking import filtered_graph, filtered_subgraph, link_calls, link_with_externals
from weftgraph.operators.versions import latest_versions, version_chain, versions
from weftgraph.session import stored
from weftgraph.sources import tables as T
from weftgraph.sources.files import file_table, language


def build_call_graph(found: DataFrame, lang: str = "python", repo_functions_only: bool = True) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(nodes, edges, bronze tables) of the files (path, content) of a language."""
    bronze = T.bronze(found.where(language(F.col("path")) == lang), lang)
    calls, functions = T.resolved_calls(bronze, lang), bronze["functions"]
    if repo_functions_only:
        return functions, link_calls(calls, functions), bronze
    edges, outside = link_with_externals(calls, functions)
    return functions.unionByName(outside.select(F.col("id").alias("fnc_id"), F.col("name").alias("combinedName")), allowMissingColumns=True), edges, bronze


def build_catalog(found: DataFrame, lang: str = "python", graph: str = "AST", remove_isolated: bool = False) -> dict[str, DataFrame]:
    """Node and edge tables of the source alone: functions, subgraphs, imports, classes, files and configuration."""
    functions, links, bronze = build_call_graph(found, lang)
    nodes, function_edges = filtered_graph(functions, links, "fnc_id", remove_isolated=remove_isolated)
    nodes = stored(nodes.withColumn("class_name", S.class_part(F.col("combinedName"))).withColumn("function_name", S.function_part(F.col("combinedName"))), "functions")
    code = nodes.select(F.col("ID").alias("fnc_id"), "function_code")
    if graph == "AST" and lang == "python":
        inner = stored(T.trees(code), "trees")
        inner_edges = inner.where("parent_id is not null").select("func_id", F.col("parent_id").alias("source"), F.col("node_id").alias("target"))
    else:
        inner, inner_edges = T.flows(code, lang)
    sub_nodes, sub_edges = filtered_subgraph(inner, inner_edges)
    owned = sub_nodes.select(F.col("ID").alias("source"), F.col("func_id").alias("target"))
    imports, import_edges = E.import_tables(bronze["imports"], nodes, keep_null_from=lang == "erlang")
    classes, class_edges, inherits = E.class_tables(bronze["classes"], nodes)
    files = stored(file_table(found), "files")
    of_files = E.file_tables(files)
    placed = files.select("file_id", F.col("fl_id").alias("ID"))
    one = nodes.select("ID", F.array("file_id").alias("file_ids"))
    return {
        "function_nodes": nodes.select("ID", "combinedName", "function_code", "docstring", "function_location", "file_id", "class_name", "function_name"),
        "function_edges": function_edges, "subgraph_nodes": sub_nodes.drop("node_id"), "subgraph_edges": sub_edges,
        "subgraph_function_edges": owned, "function_subgraph_edges": owned.select(F.col("target").alias("source"), F.col("source").alias("target")),
        "import_nodes": imports, "import_function_edges": import_edges, "class_nodes": classes, "class_function_edges": class_edges, "class_class_edges": inherits, **of_files,
        "file_function_edges": E.file_links(placed, one, F.col("file_ids")), "file_class_edges": E.file_links(placed, classes, F.col("file_ids")), "file_import_edges": E.file_links(placed, imports, F.col("import_file_ids")),
    }


def build_versions(commits: DataFrame, commit_files: DataFrame, function_nodes: DataFrame, newest: int = 300) -> dict[str, DataFrame]:
    """functionversion_nodes, functionversion_edges and functionversion_function_edges of the newest commits (commit_files as A, M or D)."""
    recent = commits.orderBy(F.desc("authored_datetime"), F.desc("commit_sha")).limit(newest)
    first = commit_files.where("status <> 'D'").dropDuplicates(["commit_sha", "path"])
    rows = T.history(first.join(recent.select("commit_sha"), "commit_sha", "left_semi")).join(recent, "commit_sha")
    symbol, order = ["file_path", "qualified_name"], ["authored_datetime", "commit_sha", "ordinal"]
    kept = versions(rows, symbol, order, "body_hash").withColumn("symbol_id", S.symbol_id(F.col("file_path"), F.col("qualified_name")))
    known = function_nodes.groupBy(S.symbol_id(F.col("function_location"), F.col("combinedName")).alias("symbol_id")).agg(F.max("ID").alias("function_id"))
    kept = stored(kept.join(known, "symbol_id", "left"), "versions")
    chain = version_chain(kept, ["symbol_id"]).join(kept.select(F.col("ID").alias("target"), "commit_sha", "authored_datetime", "author_name", "author_email", "message", "file_path", "qualified_name"), "target")
    latest = latest_versions(kept, ["symbol_id"]).where("function_id is not null").select(F.col("ID").alias("source"), F.col("function_id").alias("target"))
    return {"functionversion_nodes": kept, "functionversion_edges": chain, "functionversion_function_edges": latest}


def endpoint_types(key: str) -> tuple[str, str]:
    """Node types of an edge table by its name: pr_function_edges -> (pr, function), function_edges -> (function, function)."""
    parts = key.removesuffix("_edges").split("_")
    return parts[0], parts[-1]


def write_catalog(catalog: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table for each key."""
    for key, df in catalog.items():
        df.write.mode("overwrite").parquet(f"{folder}/{key}")


def exported(catalog: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a whole catalog for a property-graph loader; edges without both ends go, parallel ones become one."""
    nodes = edges = None
    for key, df in catalog.items():
        if key.endswith("_nodes"):
            part = E.exported_nodes(df, key.removesuffix("_nodes"))
            nodes = part if nodes is None else nodes.unionByName(part)
        elif key.endswith("_edges"):
            part = E.exported_edges(df, *endpoint_types(key), key.removesuffix("_edges"))
            edges = part if edges is None else edges.unionByName(part)
    for end in ("start_id", "end_id"):
        edges = edges.join(nodes.select(F.col("global_id").alias(end)), end, "left_semi")
    return nodes, edges
