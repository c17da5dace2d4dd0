"""Snapshots of a project's history: issues, pull requests, artifacts, workflows, contributors and commits as tables.

The engine itself uses no network: whoever fetches the data writes it as JSON or
Parquet, and these functions give it the catalog's shape.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.ids import dense_ids
from weftgraph.operators.linking import first_rows, keep_first
from weftgraph.session import ship_package

_COMMENTS = "array<struct<id:bigint,user:string,created_at:timestamp,updated_at:timestamp,body:string>>"
# Fixed shapes of the snapshots.
SCHEMAS = {
    "issues": f"number bigint, title string, body string, state string, labels array<string>, comments {_COMMENTS}, created_at timestamp",
    "pull_requests": f"number bigint, state string, title string, body string, author_login string, created_at timestamp, comments {_COMMENTS}",
    "pr_files": "number bigint, filename string, status string, additions bigint, deletions bigint, base_content string, head_content string",
    "artifacts": "id bigint, name string, size bigint, created_at timestamp, updated_at timestamp",
    "contributors": "login string, email string, name string",
    "commits": "commit_sha string, authored_datetime string, author_name string, author_email string, author_login string, message string",
    "commit_files": "commit_sha string, path string, status string, content string",
}


def read(spark: SparkSession, path: str, name: str, form: str = "json") -> DataFrame:
    """A snapshot as its schema says, from JSON lines or Parquet."""
    return spark.read.schema(SCHEMAS[name]).format(form).load(path)


def issue_nodes(issues: DataFrame, most: int = 0, labels: list[str] | None = None, with_comments: bool = True) -> DataFrame:
    """Open issues before closed ones, the newest first; of those the first `most` (0: all), with all the given labels."""
    for label in labels or []:
        issues = issues.where(F.array_contains("labels", label))
    if most > 0:
        issues = issues.orderBy(F.col("state") != "open", F.desc("created_at"), F.desc("number")).limit(most)
    comments = F.col("comments") if with_comments else F.lit(None).cast(_COMMENTS)
    return issues.select(F.col("number").alias("ID"), F.col("title").alias("issue_title"), F.col("body").alias("issue_body"), F.col("labels").alias("issue_labels"), F.col("state").alias("issue_state"), comments.alias("issue_comments"))


def pull_nodes(pulls: DataFrame, most: int, done: DataFrame | None = None) -> DataFrame:
    """The newest `most` pull requests of each state that aren't done yet, three comments each as JSON at most; none for 0."""
    if done is not None:
        pulls = pulls.join(done.select("number"), "number", "left_anti")
    chosen = first_rows(pulls, ["state"], [F.desc("created_at"), F.desc("number")], most)
    comments = F.transform(F.slice(F.coalesce("comments", F.array().cast(_COMMENTS)), 1, 3), lambda c: F.to_json(c))
    return chosen.select(F.col("number").alias("ID"), F.col("title").alias("pr_title"), F.col("body").alias("pr_body"), (F.col("state") == "open").alias("pr_open"), "author_login", comments.alias("pr_comments"))


def artifact_nodes(artifacts: DataFrame) -> DataFrame:
    return artifacts.select(F.col("id").alias("ID"), F.col("name").alias("artifact_name"), F.col("size").alias("artifact_size"), "created_at", "updated_at")


def contributor_nodes(contributors: DataFrame) -> DataFrame:
    """Contributors numbered by login; a missing full name is the login."""
    return dense_ids(keep_first(contributors, ["login"], ["email"]), ["login"], "ID", 1).select("ID", F.col("login").alias("dev_name"), F.col("email").alias("dev_email"), F.coalesce("name", "login").alias("dev_full"))


def changed_files(commit_files: DataFrame, ending: str = ".py") -> DataFrame:
    """Each commit's changed files of that ending, a path once."""
    return keep_first(commit_files.where(F.col("path").endswith(ending)), ["commit_sha", "path"], ["status"])


def workflow_actions(files: DataFrame) -> DataFrame:
    """(path, triggers, runs_on, uses) of workflow files (path, content): sorted distinct names; odd files give empty lists."""
    ship_package(files.sparkSession)
    chosen = files.where(F.col("path").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$")).select("path", F.col("content").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [workflow(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.list_(pa.string())) for i in range(3))], ["path", "triggers", "runs_on", "uses"])

    return chosen.mapInArrow(run, "path string, triggers array<string>, runs_on array<string>, uses array<string>")


def workflow(text: str) -> tuple[list[str], list[str], list[str]]:
    """Triggers, machines and used actions of one workflow."""
    lines = [re.sub(r"(^|\s)#.*$", "", line).rstrip() for line in text.split("\n")]
    runs = {x.strip("\"' ") for line in lines for x in _listed(re.match(r"\s*runs-on:\s*(.+)$", line))}
    uses = {m[1].strip("\"'") for line in lines if (m := re.match(r"\s*(?:-\s*)?uses:\s*(\S+)", line))}
    triggers: set[str] = set()
    for i, line in enumerate(lines):
        if m := re.match(r"(?:on|'on'|\"on\"|true):\s*(.*)$", line):
            triggers |= {x.strip("\"' ") for x in _listed(re.match(r"(.+)", m[1]))}
            depth = None
            for below in lines[i + 1 :]:
                if below and not below[0].isspace():
                    break
                if inner := re.match(r"(\s+)(?:-\s*)?(\w+):?", below):
                    depth = depth or len(inner[1])
                    if len(inner[1]) == depth:
                        triggers.add(inner[2])
    return sorted(triggers - {""}), sorted(runs - {""}), sorted(uses)


def _listed(m: re.Match | None) -> list[str]:
    return m[1].strip().strip("[]").split(",") if m else []


def comment_json(comment: dict) -> str:
    return json.dumps(comment, default=str)
