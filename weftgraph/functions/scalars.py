"""Scalar functions of the engine as Spark columns: names, references, paths, hashes, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GLOBAL = "Global"
# The fields that a node's label is taken from, in this order; {kind} is the node's type.
LABEL_FIELDS = [
    "label", "title", "name", "{kind}_label", "{kind}_title", "{kind}_name", "combinedName", "issue_title", "pr_title", "import_name", "code", "path", "file", "ID", "id",
]
# The fields that an edge's label is taken from, and the names that an edge's ends may have, in this order.
EDGE_LABEL_FIELDS = ["label", "title", "name", "pr_number", "pr_title", "issue_title", "change_type"]
SOURCE_NAMES = ["source", "sourrce", "src", "from", "start", "u", "left"]
TARGET_NAMES = ["target", "dst", "to", "end", "v", "right"]


def qualified_name(owner: Column, name: Column) -> Column:
    """Class.name, or the name alone of what stands in no class."""
    return F.when(owner.isNull() | (owner == GLOBAL), name).otherwise(F.concat_ws(".", owner, name))


def module_function(path: Column, name: Column, arity: Column) -> Column:
    """module:name/arity, the module being the file's stem."""
    return F.concat(F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1), F.lit(":"), name, F.lit("/"), arity.cast("string"))


def first_part(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def after_first_part(name: Column) -> Column:
    """What follows the first dot; null without a dot."""
    return F.when(name.contains("."), F.regexp_extract(name, r"(?s)^[^.]*\.(.*)$", 1))


def class_part(name: Column) -> Column:
    return F.when(name.contains("."), F.split(name, r"\.")[0])


def function_part(name: Column) -> Column:
    """The second dotted part, or the name itself."""
    return F.when(name.contains("."), F.split(name, r"\.")[1]).otherwise(name)


def normalized_code(code: Column) -> Column:
    """Code without triple-quoted strings and line comments, white space as one space."""
    plain = F.regexp_replace(F.regexp_replace(code, r'(?s)""".*?"""', ""), r"(?s)'''.*?'''", "")
    plain = F.regexp_replace(plain, r"#[^\n]*", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[ \t\n\f\r\x0B]+", " "), r"^ | $", "")


def body_hash(code: Column) -> Column:
    return F.sha2(normalized_code(code), 256)


def symbol_id(path: Column, name: Column) -> Column:
    return F.concat_ws("::", path, name)


def split_identifier(name: Column) -> Column:
    """Lower-case words of a dotted, snake-case or camel-case name."""
    spaced = F.regexp_replace(name, r"[._]", " ")
    spaced = F.regexp_replace(spaced, r"(?<=[a-z])(?=[A-Z])", " ")
    spaced = F.regexp_replace(spaced, r"(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.lower(F.trim(spaced))


def issue_references(text: Column) -> Column:
    """Distinct numbers written as #n."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"#(\d+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("bigint")))


def project_path(path: Column) -> Column:
    """Forward slashes, without a leading ./repos/ and without the first component."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./repos/", "")
    parts = F.split(plain, "/")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"/+$", ""), "/", -1)


def parent_path(path: Column) -> Column:
    """The folder a path is in; null at the top."""
    plain = F.regexp_replace(path, r"/+$", "")
    return F.when(plain.contains("/"), F.regexp_extract(plain, r"^(.*)/[^/]*$", 1))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def first_line(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), "\n")[0]


def truncated(text: Column, most: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(tail))).otherwise(text)


def global_id(label: Column, local: Column) -> Column:
    return F.concat_ws(":", F.upper(label), local.cast("string"))


def coerced_id(value: Column) -> Column:
    """A number rounded half to even, as text; any other value as it is."""
    number = value.cast("string").try_cast("double")
    return F.coalesce(F.rint(number).cast("bigint").cast("string"), value.cast("string"))


def color(key: Column) -> Column:
    """A stable colour of a key: the first three bytes of its md5, dark channels lifted."""
    def channel(i: int) -> Column:
        raw = F.conv(F.substring(F.md5(key.cast("binary")), 2 * i + 1, 2), 16, 10).cast("int")
        lifted = F.when(raw < 64, F.floor(raw * 0.5 + 64)).otherwise(raw)
        return F.lpad(F.lower(F.hex(lifted.cast("bigint"))), 2, "0")
    return F.concat(F.lit("#"), channel(0), channel(1), channel(2))


def plain_type(name: Column) -> Column:
    """A C++ type without const, pointers and references."""
    return F.trim(F.regexp_replace(name, r"\bconst\b|[*&]", ""))


def clean_type(name: Column) -> Column:
    """A C++ type without const, pointers and references, a smart pointer as what it points to."""
    plain = plain_type(name)
    inner = F.regexp_extract(plain, r"(?:unique_ptr|shared_ptr|weak_ptr)\s*<\s*(.*?)\s*>$", 1)
    return F.when(inner != "", inner).otherwise(plain)


def vector_from_text(text: Column) -> Column:
    """[1 2, 3.5] -> array<double>."""
    commas = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?<=[0-9.])\s+(?=[-0-9.])", ","), r",\s*,", ",")
    return F.from_json(commas, "array<double>")


def filled_vector(text: Column, vector: Column, dimensions: int = 384) -> Column:
    """The vector, or zeros where there is no text."""
    empty = text.isNull() | text.isin("", "NaN", "null")
    return F.when(empty | vector.isNull(), F.array_repeat(F.lit(0.0).cast("float"), dimensions)).otherwise(vector)


def unescaped(text: Column) -> Column:
    """The four entities of a graph label."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def node_label(kind: str, columns: list[str], most: int = 30) -> Column:
    """[KIND] and the first label field that isn't empty, else the first other column, trimmed, on one line and cut with an ellipsis."""
    named = [c.format(kind=kind) for c in LABEL_FIELDS]
    chosen = [c for c in named if c in columns] + [c for c in columns if c not in named and c.lower() != "id"]
    text = F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in chosen), F.lit(""))
    return F.concat(F.lit(f"[{kind.upper()}] "), truncated(F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" ")), most))


def edge_label(columns: list[str], most: int = 40) -> Column:
    """PR#number - title, the title cut at 25 characters, where an edge has both; else the first label field that isn't empty; null without one."""
    if "pr_number" in columns and "pr_title" in columns:
        return F.concat(F.lit("PR#"), F.col("pr_number").cast("string"), F.lit(" - "), truncated(F.coalesce(F.col("pr_title").cast("string"), F.lit("None")), 25))
    fields = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in EDGE_LABEL_FIELDS if c in columns]
    return truncated(F.coalesce(*fields), most) if fields else F.lit(None).cast("string")


def end_columns(columns: list[str]) -> tuple[str, str]:
    """The columns of an edge table that hold its two ends: by usual names in any case, then by names that hold one as a word, then the first two that are no label."""
    lower = {c.lower(): c for c in reversed(columns)}

    def named(words: list[str]) -> str | None:
        whole = [lower[w] for w in words if w in lower]
        return next(iter(whole or [c for c in columns if any(re.search(rf"\b{w}\b", c.lower()) for w in words)]), None)

    ends = named(SOURCE_NAMES), named(TARGET_NAMES)
    if None not in ends:
        return ends
    others = [c for c in columns if c.lower() not in ("label", "title", "name")]
    if len(others) < 2:
        raise ValueError(f"no two end columns among {columns}")
    return others[0], others[1]


def sanitized(column: Column, kind: T.DataType) -> Column:
    """A value as a property-graph loader takes it: dates as ISO text, structures as JSON, lists of plain values as they are, bytes and the rest as text."""
    if isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType)):
        return column
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_time(column)
    if isinstance(kind, T.ArrayType):
        plain = isinstance(kind.elementType, (T.StringType, T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType, T.TimestampType, T.TimestampNTZType, T.DateType))
        return F.transform(column, lambda x: sanitized(x, kind.elementType)) if plain else F.to_json(column)
    if isinstance(kind, (T.MapType, T.StructType, T.VariantType)):
        return F.to_json(column)
    return column.cast("string")


def iso_time(column: Column) -> Column:
    """A timestamp as ISO 8601 text in the session's zone, without an offset; microseconds only where there are any."""
    short, fine = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(fine.endswith(".000000"), short).otherwise(fine)


def bare_function(name: Column) -> Column:
    """The function's own name of module:name/arity."""
    return F.regexp_extract(name, r"^(?:[^:]*:)?(.*?)(?:/\d+)?$", 1)
