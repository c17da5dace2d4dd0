"""Files of a source tree: scan, folders, languages, configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.operators.ids import dense_ids

# File endings of each language, file endings of configuration, and names of configuration files.
EXTENSIONS = {
    "python": [".py", ".pyw", ".pyi"],
    "cpp": [".cpp", ".cc", ".cxx", ".c++", ".C", ".hpp", ".hh", ".hxx", ".h++", ".H", ".h"],
    "erlang": [".erl", ".hrl"],
}
CONFIG_EXTENSIONS = [
    ".md", ".txt", ".rst", ".ini", ".cfg", ".conf", ".toml", ".yaml", ".yml", ".json", ".xml", ".env", ".editorconfig", ".gitignore", ".gitattributes", ".gitmodules",
    ".dockerignore", ".clang-format", ".clang-tidy", ".pylintrc", ".flake8", ".app.src", ".app",
]
CONFIG_NAMES = ["Dockerfile", "Jenkinsfile", "requirements.txt", "Pipfile", "MANIFEST.in", "Makefile", "makefile", "CMakeLists.txt", "CMakeCache.txt", "conanfile.py", "Emakefile"]


def language(path: Column) -> Column:
    """Language by the case-sensitive file ending; null for others."""
    pairs = [F.lit(x) for name, ends in EXTENSIONS.items() for end in ends for x in (end, name)]
    return F.create_map(*pairs)[S.extension(path)]


def is_config(name: Column) -> Column:
    found = name.isin(CONFIG_NAMES) | name.startswith(".env")
    for end in CONFIG_EXTENSIONS:
        found = found | name.endswith(end)
    return found


def scan(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, content) of every file below root, paths relative to it; version-control folders are skipped, .github isn't."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    at = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    relative = F.substring(at, F.lit(len(base) + 1), F.length(at))
    return found.select(relative.alias("path"), "content").where(~F.col("path").rlike(r"(^|/)\.git(/|$)"))


def file_table(found: DataFrame) -> DataFrame:
    """Files and all folders above them: fl_id, file_id (hash of the path), name, path, is_folder, directory_id, config.

    Ids go by path, folders and files alike; the top folder has the empty path.
    """
    files = found.select("path", F.lit(False).alias("is_folder"), F.when(is_config(S.basename(F.col("path"))), F.col("content")).alias("config"))
    parts = F.split("path", "/")
    above = found.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()
    every = files.unionByName(above.select("path", F.lit(True).alias("is_folder"), F.lit(None).cast("binary").alias("config")))
    parent = F.when(F.col("path") != "", F.coalesce(S.parent_path(F.col("path")), F.lit("")))
    named = every.select(F.sha2("path", 256).alias("file_id"), S.basename(F.col("path")).alias("name"), "path", "is_folder", F.sha2(parent, 256).alias("directory_id"), "config")
    return dense_ids(named, ["path", "is_folder"], "fl_id")
