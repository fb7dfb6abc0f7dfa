"""Queries over the driver's tables that run the operators of object tables, with the SQL they must match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import tables as O

from .catalog import query

GRAPH_SQL = """
edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
),
reach AS (SELECT 'r0' AS node UNION SELECT dst FROM edges JOIN reach ON src = node)
"""
NODES_SQL = """
nodes AS (
  SELECT 'r' || r_regionkey AS node FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 'o' || o_orderkey FROM orders UNION ALL SELECT 'p' || p_partkey FROM part
)
"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


@query("""
SELECT lang, n_chars, md5(text) AS fingerprint, count(*) AS members, sum(n_chars)::BIGINT AS total_size,
       (sum(n_chars) - min(n_chars))::BIGINT AS savings, min(doc_id) AS first_member
FROM documents GROUP BY lang, n_chars, md5(text) HAVING count(*) > 1
""")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.duplicate_groups(read(spark, sf_dir, "documents"), ["lang", "n_chars"], F.md5("text"), "n_chars", "doc_id")


@query("""
SELECT l_partkey, count(*) AS occurrences, count(DISTINCT l_orderkey) AS places FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size >= 25)
GROUP BY l_partkey HAVING count(*) > 1
""")
def dup_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = read(spark, sf_dir, "part").filter("p_size >= 25").select(F.col("p_partkey").alias("l_partkey"))
    return O.reused(read(spark, sf_dir, "lineitem"), ["l_partkey"], "l_orderkey", grouped)


CATEGORIES = ["error", "signup", "large", "other", "absent"]


@query("""
WITH c AS (SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'signup' WHEN value >= 50 THEN 'large' ELSE 'other' END AS category, value FROM events),
     s AS (SELECT category, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS size FROM c GROUP BY category),
     f(position, category) AS (VALUES (0, 'error'), (1, 'signup'), (2, 'large'), (3, 'other'), (4, 'absent'))
SELECT f.position::INTEGER AS position, f.category, coalesce(n, 0)::BIGINT AS n, coalesce(size, 0)::BIGINT AS size FROM f LEFT JOIN s USING (category)
""")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "signup").when(F.col("value") >= 50, "large").otherwise("other")
    return O.category_rollup(read(spark, sf_dir, "events"), category, cents("value"), CATEGORIES)


@query("""
WITH s AS (SELECT event_type, sum(round(value * 100)::BIGINT)::BIGINT AS size FROM events GROUP BY event_type)
SELECT event_type, size, round(size * 1.0 / sum(size) OVER (), 6)::DOUBLE AS share FROM s
""")
def component_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(cents("value")).alias("size"))
    return O.share_of_total(sums, "size").withColumn("share", F.round("share", 6))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pairs(table: str, a: str, ka: str, b: str, kb: str) -> DataFrame:
        return read(spark, sf_dir, table).select(F.concat(F.lit(a), ka).alias("src"), F.concat(F.lit(b), kb).alias("dst"))

    out = pairs("nation", "r", "n_regionkey", "n", "n_nationkey")
    for more in (
        pairs("customer", "n", "c_nationkey", "c", "c_custkey"),
        pairs("customer", "c", "c_custkey", "n", "c_nationkey"),
        pairs("orders", "c", "o_custkey", "o", "o_orderkey"),
        pairs("lineitem", "o", "l_orderkey", "p", "l_partkey"),
    ):
        out = out.unionByName(more)
    return out


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.reachable(_edges(spark, sf_dir), spark.sql("SELECT 'r0' AS node"))


@query(f"WITH RECURSIVE {GRAPH_SQL} SELECT node FROM reach")
def reachable_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reached(spark, sf_dir)


@query(f"""
WITH RECURSIVE {GRAPH_SQL}, {NODES_SQL}
SELECT left(node, 1) AS kind, count(*) AS n FROM nodes WHERE node NOT IN (SELECT node FROM reach) GROUP BY 1
""")
def unreachable_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("region", "r", "r_regionkey"), ("nation", "n", "n_nationkey"), ("customer", "c", "c_custkey"), ("orders", "o", "o_orderkey"), ("part", "p", "p_partkey")]
    nodes = None
    for table, kind, key in parts:
        some = read(spark, sf_dir, table).select(F.concat(F.lit(kind), key).alias("node"))
        nodes = some if nodes is None else nodes.unionByName(some)
    return O.unreachable(nodes, _reached(spark, sf_dir)).groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, count(l_orderkey) > 0 AS embedded, coalesce(sum(p_size), 0)::BIGINT AS size
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey
""")
def font_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    return O.with_parts(read(spark, sf_dir, "orders"), links, parts, "o_orderkey", "p_partkey", F.col("p_size"))


@query("SELECT 'n' || n_nationkey AS node, coalesce(CASE WHEN n_nationkey % 2 = 1 THEN n_name END, r_name) AS name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def inherited_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    own = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.when(F.col("n_nationkey") % 2 == 1, F.col("n_name")).alias("name"))
    top = region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    return O.nearest_value(own.select("node"), own.unionByName(top), "node", "parent", "name")


@query("""
WITH t AS (SELECT page_id, list_transform(regexp_extract_all(html, '<(/?)([a-z0-9]+)'), lambda x: CASE WHEN x LIKE '</%' THEN -1 ELSE 1 END) AS marks FROM pages),
     e AS (SELECT page_id, unnest(marks) AS mark, generate_subscripts(marks, 1) AS k FROM t),
     d AS (SELECT page_id, k, sum(mark) OVER w AS depth FROM e WINDOW w AS (PARTITION BY page_id ORDER BY k)),
     f AS (SELECT page_id, k, depth - least(0, min(depth) OVER (PARTITION BY page_id ORDER BY k)) AS depth FROM d)
SELECT page_id, count(*) AS n_tags, max(depth)::INTEGER AS deepest, arg_max(depth, k)::INTEGER AS last_depth FROM f GROUP BY page_id
""")
def placement_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.regexp_extract_all("html", F.lit("<(/?)([a-z0-9]+)"), F.lit(1))
    rows = read(spark, sf_dir, "pages").select("page_id", marks.alias("marks")).filter(F.size("marks") > 0)
    rows = rows.select("page_id", F.size("marks").cast("long").alias("n_tags"), O.stack_depth(F.col("marks"), "", "/").alias("s"))
    return rows.select("page_id", "n_tags", F.col("s.deepest").alias("deepest"), F.col("s.depth").alias("last_depth"))


@query("""
SELECT event_id, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS x FROM events
""")
def placement_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.running_sum(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], cents("value"), "x").select("event_id", "x")


@query("""
SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ' ') AS ops FROM events
""")
def last_ten_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.last_operators(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.select("event_id", F.array_join("ops", " ").alias("ops"))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN round(value * 100)::BIGINT END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS page FROM events
""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") == "signup", cents("value"))
    return O.carry_forward(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], value, "page").select("event_id", "page")


FIRST_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(FIRST_ORDER)}) = 1
""")
def first_per_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_per_key(read(spark, sf_dir, "lineitem"), ["l_orderkey"], FIRST_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
WITH l AS (SELECT l_partkey, count(*) * 700 AS small FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
SELECT p_partkey FROM part LEFT JOIN l ON p_partkey = l_partkey
WHERE p_size >= 5 AND p_size <= 40 AND round(p_retailprice * 100)::BIGINT / 1024.0 <= 150 AND small / 1024.0 >= 3 AND small IS NOT NULL AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#31', 'Brand#32')
""")
def image_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey").agg((F.count("*") * 700).alias("small"))
    rows = read(spark, sf_dir, "part").join(small, F.col("p_partkey") == F.col("l_partkey"), "left")
    columns = {"width": F.col("p_size"), "height": F.col("p_size"), "pixels": F.col("p_size"), "size": cents("p_retailprice"), "compressed": F.col("small"), "page": F.lit(1), "format": F.col("p_brand")}
    bounds = O.Bounds(min_width=5, max_height=40, max_size_kb=150, min_compressed_kb=3)
    brands = ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#31", "Brand#32"]
    return rows.filter(O.list_filter(columns, bounds, compressed="compressed", formats=brands)).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 100")
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.page_slice(read(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], 50, 3).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE (p_size, p_partkey % 3) IN ((10, 1), (20, 2), (30, 1), (7, 2)) AND p_retailprice BETWEEN 900 AND 1500")
def size_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").withColumn("h", F.col("p_partkey") % 3)
    return rows.filter(O.in_sizes("p_size", "h", [(10, 1), (20, 2), (30, 1), (7, 2), (0, 5), (-1, 2)]) & F.col("p_retailprice").between(900, 1500)).select("p_partkey")


@query("""
WITH x AS (SELECT l_returnflag, round(l_extendedprice * 100)::BIGINT AS a, round(l_extendedprice * (1 + l_tax - 2 * l_discount) * 100)::BIGINT AS b FROM lineitem)
SELECT l_returnflag, sum(a)::BIGINT AS original, sum(b)::BIGINT AS compressed, sum(greatest(a - b, 0))::BIGINT AS savings,
       round(least(sum(greatest(a - b, 0)) * 100.0 / sum(a), 100.0), 6)::DOUBLE AS percent FROM x GROUP BY l_returnflag
""")
def preview_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", cents("l_extendedprice").alias("a"), F.round(F.expr("l_extendedprice * (1 + l_tax - 2 * l_discount)") * 100).cast("long").alias("b"))
    return O.preview_totals(rows, ["l_returnflag"], F.col("a"), F.col("b")).withColumn("percent", F.round("percent", 6))


@query("""
WITH d AS (SELECT doc_id, length(text)::BIGINT AS old_size, list_distinct(string_split(text, chr(10))) AS lines FROM documents),
     s AS (SELECT doc_id, old_size, (list_sum(list_transform(lines, lambda x: length(x))) + len(lines) - 1)::BIGINT AS new_size FROM d)
SELECT doc_id, old_size, new_size, doc_id % 10 = 0 OR new_size < old_size AS replaced, CASE WHEN doc_id % 10 = 0 OR new_size < old_size THEN new_size ELSE old_size END AS final_size FROM s
""")
def replace_if_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("old_size"), F.length(short).cast("long").alias("new_size"))
    replaced = O.replace_if_smaller(F.col("old_size"), F.col("new_size"), F.col("doc_id") % 10 == 0)
    return rows.withColumn("replaced", replaced).withColumn("final_size", F.when(F.col("replaced"), F.col("new_size")).otherwise(F.col("old_size")))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN json_extract_string(json_merge_patch(props, '{"k": null}'), '$.k') ELSE json_extract_string(props, '$.k') END AS k,
       event_type = 'error' AND json_extract_string(props, '$.k') IS NOT NULL AS pruned FROM events
""")
def prune_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    props = F.from_json("props", "map<string,string>")
    kept = F.when(F.col("event_type") == "error", F.map_filter(props, lambda k, v: k != "k")).otherwise(props)
    pruned = (F.col("event_type") == "error") & F.coalesce(F.map_contains_key(props, "k"), F.lit(False))
    return rows.select("event_id", F.try_element_at(kept, F.lit("k")).alias("k"), pruned.alias("pruned"))


SIZES = ["", "12", "1.5K", "3M", "2G", "12B", "abc", "0.4k", " 7 kb ", "1.2.3K", ".5k", "10MB", "-5K"]


@query("""
SELECT * FROM (VALUES ('', 0), ('12', 12), ('1.5K', 1536), ('3M', 3145728), ('2G', 2147483648), ('12B', 12), ('abc', 0), ('0.4k', 410), (' 7 kb ', 7), ('1.2.3K', 0), ('.5k', 512), ('10MB', 10485760), ('-5K', 0)) AS t(size_text, size)
""")
def parse_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(s,) for s in SIZES], "size_text string")
    return rows.select("size_text", T.parse_size(F.col("size_text")).alias("size"))


@query("""
SELECT * FROM (VALUES ('3 0 R', 3, 0), ('3 0', 3, 0), ('obj:3 0 R', 3, 0), ('3 R', NULL, NULL), ('70000 70000 R', NULL, NULL), ('4294967295 65535', 4294967295, 65535), ('4294967296 0', NULL, NULL)) AS t(ref, num, gen)
""")
def object_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(s,) for s in ("3 0 R", "3 0", "obj:3 0 R", "3 R", "70000 70000 R", "4294967295 65535", "4294967296 0")], "ref string")
    number, gen = T.object_id(F.col("ref"))
    return rows.select("ref", number.alias("num"), gen.alias("gen"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 - 1 >= 1 THEN least(p_partkey % 7 - 1, 4) END AS page, 'f' || p_partkey || '_pruned.pdf' AS output FROM part")
def clamped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    path = F.concat(F.lit("f"), "p_partkey", F.when(F.col("p_partkey") % 2 == 0, ".pdf").otherwise(".PDF"))
    return rows.select("p_partkey", T.clamped_page(F.col("p_partkey") % 7 - 1, F.lit(4)).alias("page"), T.output_path(path, "pruned").alias("output"))


@query("""
WITH p AS (SELECT l_partkey, list_sort(list(DISTINCT l_linenumber)) AS pages FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, array_to_string(pages[1:6], ', ') || CASE WHEN len(pages) > 6 THEN ' … (' || len(pages) || ')' ELSE '' END AS pages FROM p
""")
def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.array_sort(F.collect_set("l_linenumber"))
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(pages.alias("p")).select("l_partkey", T.page_list(F.col("p")).alias("pages"))


@query("SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT p_partkey FROM part WHERE p_size > 10")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("key")).distinct()
    return left.join(read(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("key")), "key", "left_anti")


@query("""
SELECT * FROM (VALUES (0, '0 B', '0 B', '0 B'), (1023, '1023 B', '1023 B', '1023 B'), (1024, '1.0 KB', '1.0 KB', '1.0 KB'), (1536, '1.5 KB', '1.5 KB', '1.5 KB'),
  (1048576, '1.0 MB', '1.00 MB', '1.00 MB'), (1073741824, '1.0 GB', '1024.00 MB', '1.00 GB'), (5905580032, '5.5 GB', '5632.00 MB', '5.50 GB')) AS t(n, analysed, written, shown)
""")
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1536, 1048576, 1073741824, 5905580032)], "n long")
    n = F.col("n")
    return rows.select("n", T.size_text(n).alias("analysed"), T.written_size_text(n).alias("written"), T.signed_size_text(n).alias("shown"))


@query("""
SELECT * FROM (VALUES (0, '0秒', '0秒'), (59, '59秒', '59秒'), (60, '1分00秒', '1分0秒'), (61, '1分01秒', '1分1秒'), (3600, '60分00秒', '60分0秒')) AS t(seconds, shown, written)
""")
def duration_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n,) for n in (0, 59, 60, 61, 3600)], "seconds long")
    return rows.select("seconds", T.duration_text(F.col("seconds")).alias("shown"), T.duration_text(F.col("seconds"), padded=False).alias("written"))
