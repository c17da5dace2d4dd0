"""Builders of the catalog's node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.operators.ids import dense_ids
from weftgraph.operators.linking import keep_first
from weftgraph.session import spread


def grouped_nodes(rows: DataFrame, keys: list[str], member: str, members: str, drop_null_keys: bool = False) -> DataFrame:
    """A node for each key with its distinct members, numbered from 1 in key order."""
    if drop_null_keys:
        rows = rows.dropna(subset=keys)
    return dense_ids(rows.groupBy(*keys).agg(F.array_sort(F.collect_set(member)).alias(members)), keys, "ID", 1)


def import_tables(imports: DataFrame, functions: DataFrame, keep_null_from: bool = False) -> tuple[DataFrame, DataFrame]:
    """import_nodes, and import_function_edges: every import of a file with every function of that file."""
    nodes = grouped_nodes(imports.select(F.col("name").alias("import_name"), F.col("from").alias("import_from"), F.col("as_name").alias("import_as_name"), "file_id"), ["import_name", "import_from", "import_as_name"], "file_id", "import_file_ids", not keep_null_from)
    edges = nodes.select(F.col("ID").alias("source"), F.explode("import_file_ids").alias("file_id")).join(functions.select("file_id", F.col("ID").alias("target")), "file_id")
    return nodes, edges.select("source", "target")


def class_tables(classes: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """class_nodes (one for each name), class_function_edges and class_class_edges; bases without a class of their name are dropped."""
    grouped = classes.groupBy("name").agg(F.min_by("base_classes", "cls_id").alias("base_classes"), F.array_sort(F.collect_set("file_id")).alias("file_ids"))
    nodes = dense_ids(grouped, ["name"], "ID", 1)
    owned = functions.select(F.col("ID").alias("target"), S.class_part(F.col("combinedName")).alias("name")).where("name is not null")
    members = nodes.select(F.col("ID").alias("source"), "name").join(owned, "name").select("source", "target")
    bases = nodes.select(F.col("ID").alias("source"), F.explode("base_classes").alias("name"))
    inherits = bases.join(nodes.select("name", F.col("ID").alias("target")), "name").select("source", "target", F.lit("inherits_from").alias("relationship"))
    return nodes, members, inherits


def file_tables(files: DataFrame) -> dict[str, DataFrame]:
    """file_nodes, file_edges, config_nodes and file_config_edges of (fl_id, file_id, name, path, is_folder, directory_id, config)."""
    plain = files.where("is_folder or config is null").select(F.col("fl_id").alias("ID"), "file_id", "name", "path", "is_folder")
    config = files.where("not is_folder and config is not null").select(F.col("fl_id").alias("ID"), "file_id", "name", "path", "is_folder", "config")
    folders = files.where("is_folder").select(F.col("file_id").alias("directory_id"), F.col("fl_id").alias("source"))
    inside = files.where("directory_id is not null").join(folders, "directory_id").select("source", F.col("fl_id").alias("target"), (F.col("config").isNotNull() & ~F.col("is_folder")).alias("_c"))
    return {"file_nodes": plain, "file_edges": inside.where("not _c").drop("_c"), "config_nodes": config, "file_config_edges": inside.where("_c").drop("_c")}


def file_links(files: DataFrame, nodes: DataFrame, file_ids: Column) -> DataFrame:
    """(file, node) for each of a node's files."""
    members = nodes.select(F.col("ID").alias("target"), F.explode(file_ids).alias("file_id"))
    return members.join(files.select("file_id", F.col("ID").alias("source")), "file_id").select("source", "target")


def issue_links(pulls: DataFrame, issues: DataFrame, body: str = "pr_body", comments: str | None = None) -> DataFrame:
    """(source issue, target pull request) for #n in body or comments, of issues that exist."""
    texts = F.array_compact(F.array(F.col(body))) if comments is None else F.array_compact(F.concat(F.array(F.col(body)), F.coalesce(F.col(comments), F.array())))
    found = pulls.select(F.col("ID").alias("target"), F.explode(S.issue_references(F.array_join(texts, "\n"))).alias("source"))
    return found.join(issues.select(F.col("ID").alias("source")), "source", "left_semi").select("source", "target")


def pull_function_edges(changed: DataFrame, functions: DataFrame) -> DataFrame:
    """(pull request, function) by path and name."""
    known = functions.select(F.col("function_location").alias("path"), F.col("combinedName").alias("name"), F.col("ID").alias("target"))
    return changed.join(known, ["path", "name"]).select(F.col("number").alias("source"), "target").distinct()


def developer_tables(contributors: DataFrame, pulls: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """developer_nodes (authors that aren't contributors come after them) and developer_function_edges through pull requests."""
    known = contributors.select("login", "email", F.coalesce("name", "login").alias("full"), F.lit(0).alias("_late"))
    authors = pulls.select(F.col("author_login").alias("login")).where("login is not null").distinct().join(known, "login", "left_anti")
    every = known.unionByName(authors.select("login", F.lit(None).cast("string").alias("email"), F.col("login").alias("full"), F.lit(1).alias("_late")))
    nodes = dense_ids(keep_first(every, ["login"], ["_late"]), ["_late", "login"], "ID", 1).select("ID", F.col("login").alias("dev_name"), F.col("email").alias("dev_email"), F.col("full").alias("dev_full"))
    by = pulls.select(F.col("ID").alias("pr"), F.col("author_login").alias("dev_name")).join(nodes.select("dev_name", F.col("ID").alias("dev")), "dev_name")
    dealt = spread(edges.select(F.col("source").alias("pr"), "target"), edges.count(), "pr")
    return nodes, dealt.join(by, "pr").select(F.col("dev").alias("source"), "target", F.col("pr").alias("pr_number")).distinct()


def commit_author_edges(commits: DataFrame, commit_files: DataFrame, files: DataFrame, functions: DataFrame, newest: int = 200) -> DataFrame:
    """(author, function): by the basename of files in the newest commits, so equal basenames all link."""
    recent = commits.orderBy(F.desc("authored_datetime"), F.desc("commit_sha")).limit(newest)
    touched = commit_files.join(recent.select("commit_sha", "author_login"), "commit_sha").select("author_login", "commit_sha", S.basename(F.col("path")).alias("base"))
    named = files.select("file_id", S.basename(F.col("path")).alias("base"))
    return touched.join(named, "base").join(functions.select("file_id", F.col("ID").alias("target")), "file_id").select(F.col("author_login").alias("source"), "target", "commit_sha").distinct()


# The question types by their id, from 0; the second one's space is part of it.
QUESTIONS = ["general", " bug report/issue/PR", "performance", "feature request"]


def question_nodes(spark, kinds: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(list(enumerate(kinds or QUESTIONS)), "ID bigint, type string")


def question_cluster_edges(questions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every question with every cluster: a handful of constants beside each cluster, so the clusters aren't shuffled."""
    kinds = [r[0] for r in questions.select("ID").orderBy("ID").collect()]  # the constants
    return clusters.select(F.explode(F.array(*(F.lit(k).cast("bigint") for k in kinds))).alias("source"), F.col("ID").alias("target"))


def exported_nodes(nodes: DataFrame, label: str, key: str = "ID") -> DataFrame:
    """(global_id, label, props): a node table as a property-graph loader takes it; null properties are left out, values are as such a loader takes them."""
    return nodes.select(S.global_id(F.lit(label), F.col(key)).alias("global_id"), F.lit(label.upper()).alias("label"), F.to_json(F.struct(*(S.sanitized(F.col(f.name), f.dataType).alias(f.name) for f in nodes.schema.fields))).alias("props"))


def exported_edges(edges: DataFrame, source_label: str, target_label: str, kind: str, last: str | None = None) -> DataFrame:
    """(start_id, end_id, type[, last]): parallel edges become one, with the largest of a property."""
    ends = [S.global_id(F.lit(source_label), F.col("source")).alias("start_id"), S.global_id(F.lit(target_label), F.col("target")).alias("end_id"), F.lit(kind.upper()).alias("type")]
    if last is None:
        return edges.select(*ends).distinct()
    return edges.select(*ends, last).groupBy("start_id", "end_id", "type").agg(F.max(last).alias(last))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs, the smaller end first."""
    return edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
