"""The relational operators over the driver's tables, each with the SQL that must give the same rows.

The driver's tables hold no source code, so they stand in for the catalog's: an
entity table for nodes, a fact table for calls, versions or edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.operators import clusters as C
from weftgraph.operators import edges as E
from weftgraph.operators import linking as L
from weftgraph.operators import versions as V
from weftgraph.operators.ids import dense_ids
from weftgraph.session import spread, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str) -> Callable:
    """Register a function under its name, with its SQL."""
    def put(function: Callable) -> Callable:
        QUERIES[function.__name__], SQL[function.__name__] = function, sql
        return function
    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN p_name ELSE p_brand || '.' || p_name END AS name FROM part")
def F1_qualified_name(spark, d):
    owner = F.when(c("p_size") < 5, F.lit(S.GLOBAL)).otherwise(c("p_brand"))
    return t(spark, d, "part").select("p_partkey", S.qualified_name(owner, c("p_name")).alias("name"))


@query("SELECT p_partkey, 'm:' || p_name || '/' || p_size AS name FROM part")
def F2_module_function(spark, d):
    return t(spark, d, "part").select("p_partkey", S.module_function(F.lit("a/b/m.erl"), c("p_name"), c("p_size")).alias("name"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace('getHTTPPart_' || p_brand || '.' || p_name, '[._]', ' ', 'g'),
          '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'))) AS words FROM part""")
def F11_identifier_split(spark, d):
    return t(spark, d, "part").select("p_partkey", S.split_identifier(F.concat(F.lit("getHTTPPart_"), "p_brand", F.lit("."), "p_name")).alias("words"))


@query("SELECT DISTINCT c_custkey, CAST(unnest(regexp_extract_all(c_name, '#(\\d+)', 1)) AS BIGINT) AS ref FROM customer")
def F12_issue_refs(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.explode(S.issue_references(c("c_name"))).alias("ref"))


@query("SELECT row_number() OVER (ORDER BY event_type) AS id, event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def E1_import_nodes(spark, d):
    nodes = E.grouped_nodes(t(spark, d, "events"), ["event_type"], "user_id", "users", drop_null_keys=True)
    return nodes.select(c("ID").alias("id"), "event_type", F.size("users").cast("bigint").alias("users"))


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY event_type) AS id, event_type FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL))
          SELECT n.id AS source, c_custkey AS target FROM (SELECT DISTINCT event_type, user_id FROM events) e JOIN n USING (event_type) JOIN customer ON c_custkey = user_id""")
def E1_import_edges(spark, d):
    imports = t(spark, d, "events").select(c("event_type").alias("name"), F.lit("m").alias("from"), F.lit("a").alias("as_name"), c("user_id").alias("file_id"))
    return E.import_tables(imports, t(spark, d, "customer").select(c("c_custkey").alias("file_id"), c("c_custkey").alias("ID")))[1]


_EXTERNAL = "SELECT user_id, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY user_id) AS id FROM (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier))"


def _calls(spark, d):
    return t(spark, d, "events").select(c("event_id").alias("func_id"), c("user_id").alias("combinedName")), t(spark, d, "supplier").select(c("s_suppkey").alias("combinedName"), c("s_suppkey").alias("fnc_id"))


@query("SELECT event_id AS source, s_suppkey AS target FROM events JOIN supplier ON s_suppkey = user_id")
def J1_link_calls(spark, d):
    return L.link_calls(*_calls(spark, d))


@query(f"SELECT id, user_id AS name FROM ({_EXTERNAL})")
def J2_external_nodes(spark, d):
    return L.external_nodes(*_calls(spark, d)).select("id", "name")


@query(f"SELECT event_id AS source, coalesce(s_suppkey, x.id) AS target FROM events e LEFT JOIN supplier ON s_suppkey = user_id LEFT JOIN ({_EXTERNAL}) x ON x.user_id = e.user_id")
def J2_external_edges(spark, d):
    return L.link_with_externals(*_calls(spark, d))[0]


_KEPT = """SELECT *, row_number() OVER (ORDER BY seen, o_custkey, o_orderdate, o_orderkey) - 1 AS id FROM (
  SELECT *, min((o_orderdate, o_orderkey)) OVER (PARTITION BY o_custkey) AS seen FROM (
    SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS DISTINCT FROM o_orderstatus)"""


def _kept(spark, d):
    return V.versions(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus")


@query(f"SELECT id, o_custkey, o_orderkey, o_orderstatus FROM ({_KEPT})")
def W2_version_nodes(spark, d):
    return _kept(spark, d).select(c("ID").alias("id"), "o_custkey", "o_orderkey", "o_orderstatus")


@query(f"SELECT source, target FROM (SELECT lag(id) OVER (PARTITION BY o_custkey ORDER BY id) AS source, id AS target FROM ({_KEPT})) WHERE source IS NOT NULL")
def W3_version_edges(spark, d):
    return V.version_chain(_kept(spark, d), ["o_custkey"])


@query(f"SELECT o_custkey, max(id) AS id FROM ({_KEPT}) GROUP BY o_custkey")
def A5_latest_version(spark, d):
    return V.latest_versions(_kept(spark, d), ["o_custkey"]).select("o_custkey", c("ID").alias("id"))


@query("""WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
          SELECT a.id AS source, b.id AS target FROM orders JOIN n a ON a.c_custkey = o_custkey JOIN n b ON b.c_custkey = o_custkey + 1""")
def M12_filter_reindex(spark, d):
    orders = t(spark, d, "orders")
    edges = orders.select(c("o_custkey").alias("source"), (c("o_custkey") + 1).alias("target"))
    keep = orders.select(c("o_custkey").alias("c_custkey"))
    return L.filtered_graph(t(spark, d, "customer"), edges, "c_custkey", keep)[1]


@query("""WITH e AS (SELECT s_suppkey AS source, s_suppkey + 1 AS target FROM supplier), v AS (SELECT * FROM e WHERE source IN (SELECT c_custkey FROM customer) AND target IN (SELECT c_custkey FROM customer))
          SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS id, c_custkey FROM customer WHERE c_custkey IN (SELECT source FROM v UNION SELECT target FROM v)""")
def M12_isolated(spark, d):
    edges = t(spark, d, "supplier").select(c("s_suppkey").alias("source"), (c("s_suppkey") + 1).alias("target"))
    return L.filtered_graph(t(spark, d, "customer"), edges, "c_custkey", remove_isolated=True)[0].select(c("ID").alias("id"), "c_custkey")


@query("""SELECT event_id, scope FROM (SELECT u.event_id, s.event_id AS scope, row_number() OVER (PARTITION BY u.event_id ORDER BY s.event_id DESC) AS n
          FROM events u JOIN events s ON s.user_id = u.user_id AND s.event_type = 'error' AND u.ts BETWEEN s.ts AND s.ts + INTERVAL 6 HOUR WHERE u.event_type = 'click') WHERE n = 1""")
def J17_scope_interval(spark, d):
    events = t(spark, d, "events")
    uses = events.where("event_type = 'click'").select("user_id", "event_id", "ts")
    scopes = events.where("event_type = 'error'").select("user_id", c("event_id").alias("scope"), c("ts").alias("start"), (c("ts") + F.expr("INTERVAL 6 HOURS")).alias("end"))
    return L.scoped(uses, scopes, ["user_id"], ["event_id"], "ts", "start", "end", "scope").select("event_id", "scope")


@query("""WITH h AS (SELECT l_partkey, year(l_shipdate) % 2 AS odd, sha256(CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR)) AS h FROM lineitem GROUP BY ALL)
          SELECT coalesce(b.l_partkey, n.l_partkey) AS l_partkey FROM (SELECT * FROM h WHERE odd = 0) b FULL JOIN (SELECT * FROM h WHERE odd = 1) n ON b.l_partkey = n.l_partkey WHERE b.h IS DISTINCT FROM n.h""")
def J22_changed(spark, d):
    hashed = t(spark, d, "lineitem").groupBy("l_partkey", (F.year("l_shipdate") % 2).alias("odd")).agg(F.sha2(F.sum("l_quantity").cast("bigint").cast("string"), 256).alias("h"))
    return L.changed(hashed.where("odd = 0"), hashed.where("odd = 1"), "l_partkey", "h")


@query("""WITH n AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part))
          SELECT id AS source, p_partkey AS target FROM part JOIN n ON name = split_part(p_name, ' ', 1)""")
def J9_class_function(spark, d):
    owner = F.substring_index("p_name", " ", 1)
    parts = t(spark, d, "part")
    classes = parts.select(owner.alias("name"), F.array().cast("array<string>").alias("base_classes"), c("p_partkey").alias("cls_id"), F.lit("f").alias("file_id"))
    return E.class_tables(classes, parts.select(c("p_partkey").alias("ID"), S.qualified_name(owner, F.lit("f")).alias("combinedName")))[1]


@query("WITH n AS (SELECT row_number() OVER (ORDER BY event_type) AS id FROM (SELECT DISTINCT event_type FROM events)) SELECT q AS source, id AS target FROM n, (VALUES (0::BIGINT), (1), (2), (3)) v(q)")
def J20_question_cluster(spark, d):
    found = dense_ids(t(spark, d, "events").select("event_type").distinct(), ["event_type"], "ID", 1)
    return E.question_cluster_edges(E.question_nodes(spark), found)


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def A7_crosstab(spark, d):
    return C.crosstab(t(spark, d, "labels"), "quality", "toxic")


@query("""WITH x AS (SELECT quality, toxic, lang, count(*) AS n, '{"quality":' || quality || ',"toxic":' || toxic || ',"lang":"' || lang || '"}' AS k FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic, lang)
          SELECT * FROM (SELECT a.k AS a, b.k AS b, (CAST(a.quality = b.quality AS INT) + CAST(a.toxic = b.toxic AS INT) + CAST(a.lang = b.lang AS INT)) / 3.0::DOUBLE AS weight,
          CASE WHEN a.k = b.k THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n FROM x a JOIN x b ON a.k <= b.k) WHERE weight >= 0.5 AND n > 0""")
def J21_agreement(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return C.agreement(rows, ["quality", "toxic", "lang"])[1]


@query("""WITH k AS (SELECT DISTINCT event_type, md5(event_type) AS h FROM events), r AS (SELECT event_type, [('0x' || substr(h, 2 * i - 1, 2))::INT FOR i IN [1, 2, 3]] AS v FROM k)
          SELECT event_type, '#' || array_to_string([lpad(lower(to_hex(CASE WHEN x < 64 THEN CAST(floor(x * 0.5 + 64) AS INT) ELSE x END)), 2, '0') FOR x IN v], '') AS color FROM r""")
def F19_color(spark, d):
    return t(spark, d, "events").select("event_type").distinct().select("event_type", S.color(c("event_type")).alias("color"))


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\"\"\".*?\"\"\"', '', 'gs'), '''''''.*?''''''', '', 'gs'), '#[^\\n]*', '', 'g'), '[ \\t\\n\\f\\r\\v]+', ' ', 'g'), '^ | $', '', 'g')) AS h FROM documents""")
def F8_norm_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", S.body_hash(c("text")).alias("h"))


@query("SELECT * FROM (SELECT conv_id, turn AS source, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations) WHERE target IS NOT NULL")
def W1_leaf_chain(spark, d):
    return L.leaf_chain(t(spark, d, "conversations"), "conv_id", "turn")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def A6_keep_first(spark, d):
    return L.keep_first(t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 5")
def W9_topn_state(spark, d):
    return L.first_rows(t(spark, d, "orders"), ["o_orderstatus"], [c("o_orderdate").desc(), c("o_orderkey").desc()], 5).select("o_orderstatus", "o_orderkey")


@query("SELECT p_brand, string_agg(p_name, '; ' ORDER BY p_partkey) AS names FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= 50 GROUP BY p_brand")
def A10_sample_concat(spark, d):
    return C.sampled_names(t(spark, d, "part"), "p_brand", "p_name", "p_partkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def F16_json(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT a.l_orderkey AS func_id, a.l_linenumber AS source, b.l_linenumber AS target FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")
def J4_subgraph_edges(spark, d):
    nodes = t(spark, d, "lineitem").select(c("l_orderkey").alias("func_id"), c("l_linenumber").alias("node_id"))
    return L.subgraph_edges(nodes, nodes.select("func_id", c("node_id").alias("source"), (c("node_id") + 1).alias("target")))


@query("""WITH n AS (SELECT DISTINCT l_orderkey AS f, l_linenumber AS n FROM lineitem), e AS (SELECT a.f, a.n AS s, b.n AS t FROM n a JOIN n b ON a.f = b.f AND b.n = a.n + 1),
          u AS (SELECT f, n, row_number() OVER (ORDER BY f, n) - 1 AS id FROM (SELECT f, s AS n FROM e UNION SELECT f, t FROM e))
          SELECT x.id AS source, y.id AS target, e.f AS func_id FROM e JOIN u x ON x.f = e.f AND x.n = e.s JOIN u y ON y.f = e.f AND y.n = e.t""")
def M13_subgraph_reindex(spark, d):
    lines = t(spark, d, "lineitem").select(c("l_orderkey").alias("func_id"), c("l_linenumber").alias("node_id"))
    nodes = stored(spread(lines, lines.count(), "func_id", "node_id").distinct(), "nodes")
    return L.filtered_subgraph(nodes, nodes.select("func_id", c("node_id").alias("source"), (c("node_id") + 1).alias("target")))[1]


_PATHS = "SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages WHERE url IS NOT NULL"


@query(f"""WITH p AS ({_PATHS}), x AS (SELECT string_split(path, '/') AS x FROM p), f AS (SELECT DISTINCT CASE WHEN i = 0 THEN '' ELSE array_to_string(x[1:i], '/') END AS path FROM x, unnest(range(0, len(x))) r(i)),
           n AS (SELECT path, folder, row_number() OVER (ORDER BY path, folder) - 1 AS id FROM (SELECT path, FALSE AS folder FROM p UNION ALL SELECT path, TRUE FROM f))
           SELECT b.id AS source, a.id AS target FROM n a JOIN n b ON b.folder AND a.path <> '' AND b.path = CASE WHEN contains(rtrim(a.path, '/'), '/') THEN regexp_replace(rtrim(a.path, '/'), '/[^/]*$', '') ELSE '' END""")
def J8_file_tree(spark, d):
    from weftgraph.sources.files import file_table

    paths = t(spark, d, "pages").where("url is not null").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")).distinct()
    return E.file_tables(file_table(paths.withColumn("content", F.lit(None).cast("binary"))))["file_edges"]


@query("""WITH b AS (SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') AS base FROM pages)
          SELECT a.base, count(*) AS files, count(*) * count(*) AS links FROM b a WHERE a.base IS NOT NULL GROUP BY a.base""")
def J15_basename(spark, d):
    """Files that a change of a basename reaches: as many links as pairs, told by their number rather than one by one."""
    return t(spark, d, "pages").where("url is not null").groupBy(S.basename(c("url")).alias("base")).agg(F.count("*").alias("files"), (F.count("*") * F.count("*")).alias("links"))


@query("SELECT DISTINCT a.p_name AS name FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name <> b.p_name AND contains(b.p_name, a.p_name)")
def J24_substring(spark, d):
    return L.contained_in_other(t(spark, d, "part").select(c("p_name").alias("name")), "name")


@query("SELECT 'NATION:' || n_nationkey AS global_id FROM nation")
def F18_global_id(spark, d):
    return t(spark, d, "nation").select(S.global_id(F.lit("nation"), c("n_nationkey")).alias("global_id"))


@query("SELECT event_id, CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR) AS v FROM events")
def F18_coerce(spark, d):
    return t(spark, d, "events").select("event_id", S.coerced_id(c("value")).alias("v"))


@query("""WITH k AS (SELECT DISTINCT user_id, event_type FROM events), n AS (SELECT event_type AS name, row_number() OVER (ORDER BY event_type) AS id FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view')),
          b AS (SELECT DISTINCT x.event_type AS child, y.event_type AS base FROM k x JOIN k y ON x.user_id = y.user_id AND y.event_type < x.event_type WHERE y.event_type <> 'error')
          SELECT p.id AS source, q.id AS target, 'inherits_from' AS relationship FROM b JOIN n p ON p.name = b.child JOIN n q ON q.name = b.base""")
def E2_inherits(spark, d):
    kinds = t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    bases = kinds.select(F.explode("kinds").alias("name"), "kinds").select("name", F.filter("kinds", lambda k: (k < c("name")) & (k != "error")).alias("bases"))
    listed = bases.groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("bases")))).alias("base_classes"))
    classes = listed.where("name <> 'view'").select("name", "base_classes", F.lit(0).alias("cls_id"), F.lit("f").alias("file_id"))
    empty = spark.createDataFrame([], "ID bigint, combinedName string")
    return E.class_tables(classes, empty)[2]


@query("SELECT n_nationkey AS source, c_custkey AS target FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 0")
def E4_file_function(spark, d):
    files = t(spark, d, "nation").where("n_regionkey <> 0").select(c("n_nationkey").alias("file_id"), c("n_nationkey").alias("ID"))
    nodes = t(spark, d, "customer").select(c("c_custkey").alias("ID"), F.array("c_nationkey").alias("file_ids"))
    return E.file_links(files, nodes, c("file_ids"))


@query("SELECT DISTINCT s_suppkey AS source, c_custkey AS target FROM (SELECT c_custkey, CAST(unnest(regexp_extract_all(c_name, '#(\\d+)', 1)) AS BIGINT) AS ref FROM customer) JOIN supplier ON s_suppkey = ref")
def E7_issue_pr(spark, d):
    pulls = t(spark, d, "customer").select(c("c_custkey").alias("ID"), c("c_name").alias("pr_body"))
    return E.issue_links(pulls, t(spark, d, "supplier").select(c("s_suppkey").alias("ID")))


@query("""WITH k AS (SELECT DISTINCT c_custkey FROM customer), a AS (SELECT CAST(c_custkey AS VARCHAR) AS login, 0 AS late FROM k UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM k)),
          n AS (SELECT login, row_number() OVER (ORDER BY late, login) AS id FROM a)
          SELECT DISTINCT n.id AS source, l_partkey AS target, o_orderkey AS pr_number FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN n ON login = CAST(o_custkey AS VARCHAR)""")
def E8_author_function(spark, d):
    pulls = t(spark, d, "orders").select(c("o_orderkey").alias("ID"), c("o_custkey").cast("string").alias("author_login"))
    people = t(spark, d, "customer").select(c("c_custkey").cast("string").alias("login"), F.lit("").alias("email"), c("c_name").alias("name"))
    return E.developer_tables(people, pulls, t(spark, d, "lineitem").select(c("l_orderkey").alias("source"), c("l_partkey").alias("target")))[1]


@query("SELECT c_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def J16_keep_last(spark, d):
    last = L.keep_first(t(spark, d, "orders"), ["o_custkey"], [c("o_orderdate").desc(), c("o_orderkey").desc()])
    return t(spark, d, "customer").join(last, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT event_id, coalesce(s_name, 'raw' || user_id) AS name FROM events LEFT JOIN supplier ON s_suppkey = user_id")
def J18_alias_default(spark, d):
    names = t(spark, d, "supplier").select(c("s_suppkey").alias("user_id"), c("s_name").alias("name"))
    return L.with_default(t(spark, d, "events").select("event_id", "user_id"), names, "user_id", "name", F.concat(F.lit("raw"), c("user_id").cast("string"))).select("event_id", "name")


@query("SELECT 'ORDER:' || l_orderkey AS start_id, 'PART:' || l_partkey AS end_id, 'ORDER_PART' AS type, max(l_linenumber) AS line FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 GROUP BY ALL")
def K3_edges_export(spark, d):
    parts = t(spark, d, "part").where("p_size < 10").select(c("p_partkey").alias("l_partkey"))
    edges = t(spark, d, "lineitem").join(parts, "l_partkey", "left_semi").select(c("l_orderkey").alias("source"), c("l_partkey").alias("target"), c("l_linenumber").alias("line"))
    return E.exported_edges(edges, "order", "part", "order_part", "line")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 300")
def L6_newest_n(spark, d):
    return t(spark, d, "orders").orderBy(c("o_orderdate").desc(), c("o_orderkey").desc()).limit(300).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)")
def P9_anti(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "lineitem").where("l_linenumber = 4").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)")
def P9_semi(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "lineitem").where("l_linenumber = 4").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("""WITH x AS (SELECT doc_id, replace(regexp_replace(coalesce(nullif(text, ''), CAST(doc_id AS VARCHAR), ''), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), chr(10), ' ') AS t FROM documents)
          SELECT doc_id, '[DOC] ' || CASE WHEN length(t) > 30 THEN left(t, 30) || '...' ELSE t END AS label FROM x""")
def P13_label(spark, d):
    docs = t(spark, d, "documents").select("doc_id", c("text").alias("title"))
    return docs.select("doc_id", S.node_label("doc", docs.columns).alias("label"))


@query("SELECT doc_id, 'PR#' || doc_id || ' - ' || CASE WHEN text IS NULL THEN 'None' WHEN length(text) > 25 THEN left(text, 25) || '...' ELSE text END AS label FROM documents")
def P14_pull_label(spark, d):
    edges = t(spark, d, "documents").select(c("doc_id").alias("pr_number"), c("text").alias("pr_title"))
    return edges.select(c("pr_number").alias("doc_id"), S.edge_label(edges.columns).alias("label"))


@query("SELECT event_id, CASE WHEN length(x) > 40 THEN left(x, 40) || '...' ELSE x END AS label FROM (SELECT event_id, coalesce(nullif(event_type, 'view'), nullif(props, '')) AS x FROM events)")
def P14_edge_label(spark, d):
    edges = t(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("name"), c("props").alias("change_type"))
    return edges.select("event_id", S.edge_label(edges.columns).alias("label"))


@query("SELECT l_suppkey AS source, l_partkey AS target FROM lineitem")
def P12_end_columns(spark, d):
    edges = t(spark, d, "lineitem").select(c("l_orderkey").alias("label"), c("l_partkey").alias("DST"), c("l_suppkey").alias("the src"))
    source, target = S.end_columns(edges.columns)
    return edges.select(c(source).alias("source"), c(target).alias("target"))


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN '' ELSE strftime({0}, '.%f') END"


@query(f"SELECT event_id, {_ISO.format('ts')} AS at FROM events")
def F21_iso_time(spark, d):
    return t(spark, d, "events").select("event_id", S.iso_time(c("ts")).alias("at"))


@query(f"""SELECT 'ORDER:' || o_orderkey AS global_id, 'ORDER' AS label, '{{"ID":' || o_orderkey || ',"status":"' || o_orderstatus || '","at":"' || {_ISO.format('o_orderdate')} || '"}}' AS props FROM orders""")
def F17_sanitized(spark, d):
    return E.exported_nodes(t(spark, d, "orders").select(c("o_orderkey").alias("ID"), c("o_orderstatus").alias("status"), c("o_orderdate").alias("at")), "order")


@query("SELECT p_brand AS class, p_type AS method, 'ns.' || arg_min(p_name, p_partkey) AS returned FROM part GROUP BY ALL")
def J19_return_type(spark, d):
    from weftgraph.sources.tables import method_types

    functions = t(spark, d, "part").select(c("p_brand").alias("class"), c("p_type").alias("name"), F.concat(F.lit("const ns::"), "p_name", F.lit(" &")).alias("return_type"), c("p_partkey").alias("fnc_id"))
    return method_types(functions).toDF("class", "method", "returned")


@query("SELECT p_partkey, p_name AS name FROM part")
def F2_bare_name(spark, d):
    named = S.module_function(F.lit("a/b/m.erl"), c("p_name"), c("p_size"))
    return t(spark, d, "part").select("p_partkey", S.bare_function(named).alias("name"))


@query("""WITH n AS (SELECT p_partkey AS k, 5 * (row_number() OVER (ORDER BY 'src/p' || p_partkey || '.cpp') - 1) AS id FROM part)
          SELECT id + 2 AS source, id + 1 AS target FROM n, (VALUES (1), (2)) v(twice) UNION ALL SELECT a.id + 2, b.id + 1 FROM n a JOIN n b ON b.k = a.k - 1""")
def F7_chained_calls(spark, d):
    """C++ made from the parts table: a part's run() calls its own next() and, in a chain, that of the part before; the inner call and the chain's first step are two calls."""
    from weftgraph.plans.call_graph import build_call_graph

    k = c("p_partkey")
    code = F.format_string("struct C%d { C%d* next() { return p; } };\nvoid run%d(C%d& o) { o.next()->next(); }\n", k, k - 1, k, k)
    return build_call_graph(t(spark, d, "part").select(F.format_string("src/p%d.cpp", k).alias("path"), code.alias("content")), "cpp")[1]


@query("SELECT doc_id, CASE WHEN length(text) > 25 THEN left(text, 25) || '...' ELSE text END AS title FROM documents")
def F28_truncate(spark, d):
    return t(spark, d, "documents").select("doc_id", S.truncated(c("text"), 25).alias("title"))


@query("SELECT l_suppkey, l_orderkey, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_orderkey) AS r FROM (SELECT l_suppkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1")
def S21_best(spark, d):
    counted = t(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("n"))
    return L.keep_first(counted, ["l_suppkey"], [c("n").desc(), "l_orderkey"])


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS source, greatest(l_partkey, l_suppkey) AS target FROM lineitem")
def M5_undirected(spark, d):
    return E.undirected(t(spark, d, "lineitem").select(c("l_partkey").alias("source"), c("l_suppkey").alias("target")))


@query("SELECT row_number() OVER (ORDER BY k) AS id, k, count(DISTINCT user_id) AS users FROM (SELECT nullif(event_type, 'error') AS k, user_id FROM events) WHERE k IS NOT NULL GROUP BY k")
def A1_null_drop(spark, d):
    rows = t(spark, d, "events").select(F.nullif("event_type", F.lit("error")).alias("k"), "user_id")
    return E.grouped_nodes(rows, ["k"], "user_id", "users", drop_null_keys=True).select(c("ID").alias("id"), "k", F.size("users").cast("bigint").alias("users"))


@query("SELECT row_number() OVER (ORDER BY k NULLS FIRST) AS id, k, count(DISTINCT user_id) AS users FROM (SELECT nullif(event_type, 'error') AS k, user_id FROM events) GROUP BY k")
def A2_null_keep(spark, d):
    rows = t(spark, d, "events").select(F.nullif("event_type", F.lit("error")).alias("k"), "user_id")
    return E.grouped_nodes(rows, ["k"], "user_id", "users").select(c("ID").alias("id"), "k", F.size("users").cast("bigint").alias("users"))


@query("SELECT p_partkey, split_part(n, '.', 1) AS class_name, split_part(n, '.', 2) AS function_name FROM (SELECT p_partkey, replace(p_brand || '.' || p_name, ' ', '.') AS n FROM part)")
def F4_split(spark, d):
    named = t(spark, d, "part").select("p_partkey", F.replace(F.concat("p_brand", F.lit("."), "p_name"), F.lit(" "), F.lit(".")).alias("n"))
    return named.select("p_partkey", S.class_part(c("n")).alias("class_name"), S.function_part(c("n")).alias("function_name"))


@query("SELECT page_id, CASE WHEN contains(url, '/') THEN regexp_replace(url, '^[^/]*/', '') ELSE '' END AS path FROM pages WHERE url IS NOT NULL")
def F13_path(spark, d):
    return t(spark, d, "pages").where("url is not null").select("page_id", S.project_path(F.concat(F.lit("./repos/"), c("url"))).alias("path"))


@query("SELECT page_id, split_part(url, '.', 1) AS first, CASE WHEN contains(url, '.') THEN regexp_replace(url, '^[^.]*[.]', '', 's') END AS rest FROM pages WHERE url IS NOT NULL")
def F3_parts(spark, d):
    return t(spark, d, "pages").where("url is not null").select("page_id", S.first_part(c("url")).alias("first"), S.after_first_part(c("url")).alias("rest"))


@query("SELECT doc_id, split_part(regexp_replace(text, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), chr(10), 1) AS line FROM documents")
def F15_first_line(spark, d):
    return t(spark, d, "documents").select("doc_id", S.first_line(c("text")).alias("line"))


@query("SELECT 'n' || n_nationkey AS id, n_name AS name, n_regionkey AS region, NULL::VARCHAR AS segment FROM nation UNION ALL SELECT 'c' || c_custkey, c_name, NULL, c_mktsegment FROM customer")
def U1_union_widen(spark, d):
    nations = t(spark, d, "nation").select(F.concat(F.lit("n"), c("n_nationkey").cast("string")).alias("id"), c("n_name").alias("name"), c("n_regionkey").alias("region"))
    customers = t(spark, d, "customer").select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("id"), c("c_name").alias("name"), c("c_mktsegment").alias("segment"))
    return nations.unionByName(customers, allowMissingColumns=True)


@query("SELECT row_number() OVER (ORDER BY p_brand, p_type) AS id, p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type")
def W6_group_id(spark, d):
    return dense_ids(t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")), ["p_brand", "p_type"], "id", 1)


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events INTERSECT SELECT c_custkey FROM customer)")
def U4_intersect(spark, d):
    return t(spark, d, "events").select("user_id").distinct().join(t(spark, d, "customer").select(c("c_custkey").alias("user_id")), "user_id", "left_semi")


_ENDS = ["py", "pyi", "PY", "cpp", "C", "c", "h", "erl", "hrl", "txt", "x.py", ""]


@query("""SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'python' WHEN 1 THEN 'python' WHEN 3 THEN 'cpp' WHEN 4 THEN 'cpp' WHEN 6 THEN 'cpp' WHEN 7 THEN 'erlang' WHEN 8 THEN 'erlang' WHEN 10 THEN 'python' END AS lang FROM pages""")
def S4_language(spark, d):
    from weftgraph.sources.files import language

    end = F.element_at(F.array(*(F.lit(e) for e in _ENDS)), (c("page_id") % len(_ENDS) + 1).cast("int"))
    return t(spark, d, "pages").select("page_id", language(F.concat(F.lit("a.b/page"), c("page_id").cast("string"), F.lit("."), end)).alias("lang"))


@query("""WITH n AS (SELECT p_partkey AS k, 3 * (row_number() OVER (ORDER BY 'src/p' || p_partkey || '.py') - 1) + 1 AS id FROM part)
          SELECT a.id AS source, b.id AS target FROM n a JOIN n b ON b.k = a.k - 1""")
def T1_call_graph(spark: SparkSession, d: str) -> DataFrame:
    """Call graph of Python source made from the parts table: each part is a function that calls the one before it."""
    from weftgraph.plans.call_graph import build_call_graph

    parts = t(spark, d, "part").select("p_partkey")
    code = F.concat(F.lit("class P:\n    def f"), c("p_partkey").cast("string"), F.lit("(self):\n        return self.f"), (c("p_partkey") - 1).cast("string"), F.lit("()\n"))
    return build_call_graph(parts.select(F.concat(F.lit("src/p"), c("p_partkey").cast("string"), F.lit(".py")).alias("path"), code.alias("content")))[1]


def M4_label_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Communities of suppliers and parts of the same order lines: labels after three rounds, by definition; they need not have settled."""
    edges = t(spark, d, "lineitem").select(c("l_suppkey").alias("source"), (c("l_partkey") + 10_000_000).alias("target"))
    return C.label_propagation(edges, 3)


QUERIES |= {f.__name__: f for f in (M4_label_propagation,)}
