"""Sinks of the catalog: loader files, tensors, pictures."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.operators.linking import existing_edges
from weftgraph.plans.call_graph import endpoint_types, exported

#: Nodes and edges that a picture shows at most; it is put together in the driver.
PICTURE_ROWS = 20_000


def write_loader_files(catalog: dict[str, DataFrame], folder: str) -> None:
    """nodes (global_id, label, props) and edges (start_id, end_id, type) as Parquet, for a property-graph loader that merges by id."""
    nodes, edges = exported(catalog)
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def tensor_tables(catalog: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """x and edge_index tables of a graph with function and expression nodes and four kinds of edges."""
    kinds = {"function_edges": ("function", "function"), "subgraph_edges": ("expression", "expression"), "function_subgraph_edges": ("function", "expression"), "subgraph_function_edges": ("expression", "function")}
    out = {"function_x": catalog["function_nodes"].select("ID", *(c for c in catalog["function_nodes"].columns if c.endswith("embedding"))), "expression_x": catalog["subgraph_nodes"].select("ID", *(c for c in catalog["subgraph_nodes"].columns if c.endswith("embedding")))}
    return out | {f"{a}__{b}__edge_index": catalog[key].select("source", "target") for key, (a, b) in kinds.items()}


def simple_digraph(edges: DataFrame) -> DataFrame:
    """Edges without their parallels."""
    return edges.select("source", "target").distinct()


def picture_tables(catalog: dict[str, DataFrame], with_subgraphs: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nid, label, color) and (s, t, color, label) of what a picture shows: edges need both ends, parallel ones are one, and their label is null where they have none."""
    nodes = edges = None
    for key, df in catalog.items():
        if "subgraph" in key and not with_subgraphs:
            continue
        if key.endswith("_nodes"):
            kind = key.removesuffix("_nodes")
            part = df.select(F.concat(F.lit(kind.upper() + "_"), F.col("ID").cast("string")).alias("nid"), S.node_label(kind, df.columns).alias("label"), S.color(F.lit(kind)).alias("color"))
            nodes = part if nodes is None else nodes.unionByName(part)
        elif key.endswith("_edges"):
            a, b = endpoint_types(key)
            s, t = S.end_columns(df.columns)
            ends = df.select(F.concat(F.lit(a.upper() + "_"), F.col(s).cast("string")).alias("s"), F.concat(F.lit(b.upper() + "_"), F.col(t).cast("string")).alias("t"), S.edge_label(df.columns).alias("label"))
            part = ends.groupBy(F.least("s", "t").alias("source"), F.greatest("s", "t").alias("target")).agg(F.max("label").alias("label")).select("source", "target", S.color(F.lit(key)).alias("color"), "label")
            edges = part if edges is None else edges.unionByName(part)
    return nodes, existing_edges(edges, nodes, "nid").select(F.col("source").alias("s"), F.col("target").alias("t"), "color", "label")


def picture(catalog: dict[str, DataFrame], with_subgraphs: bool = False) -> str:
    """The tables as one page of HTML with the graph as JSON and lists of nodes and edges; too large a graph raises."""
    nodes, edges = (df.limit(PICTURE_ROWS + 1).collect() for df in picture_tables(catalog, with_subgraphs))
    if max(len(nodes), len(edges)) > PICTURE_ROWS:
        raise ValueError(f"more than {PICTURE_ROWS} nodes or edges: choose a part of the catalog")
    data = json.dumps({"nodes": [r.asDict() for r in nodes], "edges": [r.asDict() for r in edges]}).replace("</", "<\\/")
    shown = "".join(f'<li style="color:{r["color"]}">{html.escape(r["label"])}</li>' for r in nodes)
    return f'<!DOCTYPE html><meta charset="utf-8"><title>graph</title><script type="application/json" id="graph">{data}</script><ul>{shown}</ul>'
