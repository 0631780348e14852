"""Registered queries: each operator on the driver's tables, with SQL for those that SQL can express.

The tables stand in for the domain: customers hold brands and parts (entities
and items), nations and regions group them, part sizes are positions, and a
customer's span of orders is a time with an event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import aggregates as A
from .operators import graph as G
from .operators import relational as R
from .operators import similarity as M
from .operators import stats as T
from .operators import survival as V
from .operators import walk as K
from .plans import documents as D
from .session import cut, scratch_path
from .sources import readers, writers
from .streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The driver's tables and the views that stand in for the domain."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lines(self) -> DataFrame:
        return self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(self.part, F.col("l_partkey") == F.col("p_partkey"))

    def holdings(self) -> DataFrame:
        """entity (customer), item (brand)."""
        return self.lines().select(F.col("o_custkey").alias("entity"), F.col("p_brand").alias("item")).distinct()

    def grouped(self) -> DataFrame:
        """entity, item, grp (nation of the customer)."""
        return self.holdings().join(self.customer.select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").cast("long").alias("grp")), "entity")

    def outcomes(self) -> DataFrame:
        """entity, t (days of orders), e (event), grp."""
        o = self.orders.groupBy(F.col("o_custkey").alias("entity")).agg((F.datediff(F.max(F.to_date("o_orderdate")), F.min(F.to_date("o_orderdate"))) + 1).cast("long").alias("t"), F.when(F.min("o_orderkey") % 3 == 0, 0).otherwise(1).cast("long").alias("e"))
        return o.join(self.customer.select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").cast("long").alias("grp"), "c_acctbal"), "entity")

    def edges(self) -> DataFrame:
        """src, dst, etype, value: an edge for each supplier and part that share a line."""
        return self.lineitem.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.max("l_returnflag").alias("etype"), F.sum(F.round(F.col("l_discount") * 100)).alias("value"))

    def dag(self) -> DataFrame:
        return self.edges().where("src < dst").select("src", "dst", "etype")


H = "h AS (SELECT DISTINCT o_custkey AS entity, p_brand AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
GR = H + ", g AS (SELECT h.entity, item, CAST(c_nationkey AS BIGINT) AS grp FROM h JOIN customer ON c_custkey = entity)"
O = "o AS (SELECT x.*, CAST(c_nationkey AS BIGINT) AS grp, c_acctbal FROM (SELECT o_custkey AS entity, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) + 1 AS BIGINT) AS t, CAST(CASE WHEN min(o_orderkey) % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS e FROM orders GROUP BY o_custkey) x JOIN customer ON c_custkey = entity)"
E = "e AS (SELECT l_suppkey AS src, l_partkey AS dst, max(l_returnflag) AS etype, sum(round(l_discount * 100)) AS value FROM lineitem GROUP BY 1, 2), u AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst)"
DAG = E + ", g AS (SELECT src, dst, etype FROM e WHERE src < dst)"


def tidy(df: DataFrame, rounded: tuple[str, ...] = ()) -> DataFrame:
    """Integers as long, doubles to six places (so that the order of additions does not show), no negative zero; ``rounded`` are so already."""
    kinds = {c: t for c, t in df.dtypes if c not in rounded}
    fix: dict[str, Column] = {c: F.col(c).cast("long") for c, t in kinds.items() if t in ("int", "smallint", "tinyint")}
    fix |= {c: F.round(F.col(c), 6) + F.lit(0.0) for c, t in kinds.items() if t in ("double", "float")}
    return df.select(*(fix.get(c, F.col(c)).alias(c) for c in df.columns))


def six(millionths: Column) -> Column:
    """A group's mean to six places from an exact sum of millionths, so that no order of additions shows."""
    return F.floor(millionths / F.count(F.lit(1)) + 0.5) / 1_000_000


def query(name: str, sql: str | None = None, rounded: tuple[str, ...] = ()) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: tidy(f(Tables(spark, sf_dir)), rounded)
        if sql:
            ORACLE[name] = sql
        return f

    return register


# --- scans, projections, predicates (2.1, 2.3) ----------------------------------


@query("sc6_parquet_scan", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY l_returnflag")
def _(t):
    return t.lineitem.where("l_shipdate < TIMESTAMP '1999-01-01'").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("sc14_edge_scan", f"WITH {E} SELECT src, dst, etype, value FROM e WHERE etype = 'R' AND value > 3")
def _(t):
    return readers.scan_edges(t.edges().withColumn("deprecated", F.lit(None).cast("boolean")), "R", "value > 3").drop("deprecated")


def _place(t: Tables, name: str) -> str:
    return scratch_path(t.spark, name)


def _text(df: DataFrame, line: Column, path: str, **options: str) -> str:
    """``line`` of every row written as text files."""
    df.select(line.alias("value")).write.mode("overwrite").options(**options).text(path)
    return path


_PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@query("sc1_sk1_csv", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def _(t):
    path = _place(t, "csv")
    writers.write_csv(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), path)
    return readers.read_csv(t.spark, path, _PART, ["p_partkey", "p_brand", "p_retailprice"])


@query("sc2_keyed_csv", "SELECT p_partkey AS id, p_name, p_size FROM part")
def _(t):
    path = _place(t, "keyed-csv")
    writers.write_csv(t.part.select(F.col("p_partkey").alias("any name"), "p_name", "p_size"), path)
    return readers.read_keyed_csv(t.spark, path, "`any name` long, p_name string, p_size int", "id")


@query("sc3_sc4_gzip_tsv", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS price FROM part")
def _(t):
    # Sizes are read as doubles; NaN is null.
    path = _place(t, "tsv")
    price = F.when(F.col("p_partkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("price")
    t.part.select("p_partkey", "p_size", price).write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return readers.read_tsv(t.spark, path, "p_partkey long, p_size double, price double")


@query("sc5_links", f"WITH {E} SELECT CAST(src AS VARCHAR) AS protein1, 'p' || dst AS protein2, CAST(value AS BIGINT) AS combined_score FROM e WHERE value >= 5 AND dst % 10 <> 0")
def _(t):
    # Every tenth part's rows hold no number and are skipped.
    score = F.when(F.col("dst") % 10 == 0, "none").otherwise(F.col("value").cast("int").cast("string"))
    path = _text(t.edges(), F.concat_ws(" ", F.col("src").cast("string"), F.concat(F.lit("p"), "dst"), score), _place(t, "links"), compression="gzip")
    return readers.read_links(t.spark, path, 5)


@query("sc7_sk12_shards", "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(1 AS BIGINT) AS shards_of_a_key FROM orders")
def _(t):
    # Files hold consecutive ids, so a range of a hundred ids lies in two files at most, and an id in one.
    path = _place(t, "shards")
    writers.write_ranges(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", path, 8)
    read = readers.read_shards(t.spark, path).withColumn("file", F.input_file_name())
    files = read.groupBy("o_orderkey").agg(F.countDistinct("file").alias("shards_of_a_key"))
    return read.drop("file").join(files, "o_orderkey")


@query("sc8_jsonl", "SELECT event_id, event_type, value FROM events WHERE event_id % 5 <> 0")
def _(t):
    # Every fifth line is broken or blank and is skipped.
    whole = F.to_json(F.struct("event_id", "event_type", "value"))
    line = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 5 == 0, F.substring(whole, 1, 12)).otherwise(whole)
    return readers.read_jsonl(t.spark, _text(t.events, line, _place(t, "jsonl")), "event_id long, event_type string, value double")


@query("sc9_document", "SELECT 'nations' AS section, CAST(n_nationkey AS BIGINT) AS id, n_name AS title FROM nation UNION ALL SELECT 'regions', CAST(r_regionkey AS BIGINT), r_name FROM region")
def _(t):
    # Nations and regions are fixed in number; one JSON document over several lines holds both.
    n = t.nation.agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))).alias("nations"))
    r = t.region.agg(F.collect_list(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title"))).alias("regions"))
    path = _text(n.crossJoin(r), F.to_json(F.struct(F.struct("nations", "regions").alias("dataset")), {"pretty": "true"}), _place(t, "document"))
    return readers.read_document(t.spark, path, "dataset", ["nations", "regions"], "id: long, title: string")


@query("sc11_fasta", "SELECT 'P' || p_partkey AS id, 'P' || p_partkey || ' ' || p_name AS description, repeat('ACGT', CAST(p_size AS INT)) AS sequence FROM part")
def _(t):
    bases = F.repeat(F.lit("AC\nGT"), F.col("p_size"))
    return readers.read_fasta(t.spark, _text(t.part, F.concat(F.lit(">P"), "p_partkey", F.lit(" "), "p_name", F.lit("\n"), bases), _place(t, "fasta")))


@query("sc12_gene_sets", "SELECT DISTINCT p_brand AS \"set\", CAST(p_partkey AS VARCHAR) AS gene FROM part")
def _(t):
    sets = t.part.groupBy("p_brand").agg(F.collect_list(F.col("p_partkey").cast("string")).alias("genes"))
    return readers.read_gmt(t.spark, _text(sets, F.concat_ws("\t", "p_brand", F.lit("parts of a brand"), "genes"), _place(t, "gmt")))


@query("sc13_annotations", "SELECT 'G' || l_partkey AS gene, 'T' || l_suppkey AS term, l_returnflag AS evidence FROM lineitem WHERE l_linenumber % 2 = 0 AND l_quantity <> 50")
def _(t):
    taxon = F.when(F.col("l_linenumber") % 2 == 0, "9606").otherwise("10090")
    negated = F.when(F.col("l_quantity") == 50, "NOT part_of").otherwise("part_of")
    line = F.concat_ws("\t", taxon, F.concat(F.lit("G"), "l_partkey"), F.concat(F.lit("T"), "l_suppkey"), "l_returnflag", negated)
    return readers.read_annotations(t.spark, _text(t.lineitem, line, _place(t, "annotations")), "9606")


@query("sc13_ontology", "SELECT DISTINCT 'T:' || c_custkey AS src, 'N:' || c_nationkey AS dst FROM customer UNION ALL SELECT 'T:' || c_custkey, 'S:' || c_mktsegment FROM customer")
def _(t):
    stanza = F.concat(F.lit("[Term]\nid: T:"), "c_custkey", F.lit("\nname: x\nis_a: N:"), "c_nationkey", F.lit(" ! nation\nis_a: S:"), "c_mktsegment", F.lit("\n"))
    return readers.read_obo(t.spark, _text(t.customer, stanza, _place(t, "obo")))


@query("sk2_sk4_edges", f"WITH {E} SELECT src, dst, etype, value FROM e")
def _(t):
    # Two batches appended to one table that is partitioned by type.
    path = _place(t, "edges")
    writers.append_edges(t.edges().where("src % 2 = 0"), path)
    writers.append_edges(t.edges().where("src % 2 = 1"), path)
    return t.spark.read.parquet(path).select("src", "dst", "etype", "value")


@query("sk8_journal", "SELECT src, dst, CASE WHEN src % 2 = 0 THEN '2024-01-01' ELSE '2024-01-02' END AS day FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)")
def _(t):
    path, pairs = _place(t, "journal"), t.edges().select("src", "dst")
    for k, day in ((0, "2024-01-01"), (1, "2024-01-02")):
        writers.journal(pairs.where(F.col("src") % 2 == k), path, "PPI", "test", "s", f"{day} 10:00:00")
        writers.journal(pairs.where(F.col("src") % 2 == k), path, "OTHER", "test", "s", f"{day} 11:00:00")
    return writers.replay(writers.read_journal(t.spark, path), "src long, dst long", "PPI").select("src", "dst", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


@query("sk9_snapshot", f"WITH {E} SELECT 'edge' AS what, etype AS name, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY etype UNION ALL SELECT 'node', p_brand, count(*) FROM part GROUP BY p_brand")
def _(t):
    return writers.snapshot(t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label")), t.edges(), _place(t, "snapshot"))


@query("sk11_classes", "SELECT CAST(label AS BIGINT) AS class, vec_id FROM embeddings")
def _(t):
    path = _place(t, "classes")
    writers.write_classes(t.embeddings.select(F.col("label").alias("class"), "vec_id"), path)
    return t.spark.read.schema("vec_id long, class int").json(path).select("class", "vec_id")


@query("g30_sk13_edge_lists", f"WITH {E} SELECT 's' || src AS src, 'p' || dst AS dst, etype, value FROM e")
def _(t):
    # Indices are dense from 0 within each write, so they lead back to the edges.
    path = _place(t, "edge-lists")
    nodes = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("supplier").alias("label")).unionByName(t.part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("part").alias("label")))
    edges = t.edges().withColumns({"src": F.concat(F.lit("s"), "src"), "dst": F.concat(F.lit("p"), "dst")})
    writers.write_edge_lists(nodes, edges, path)
    at = t.spark.read.parquet(f"{path}/nodes")
    read = t.spark.read.parquet(f"{path}/edges")
    return read.join(at.select(F.col("index").alias("s"), F.col("id").alias("src")), "s").join(at.select(F.col("index").alias("d"), F.col("id").alias("dst")), "d").select("src", "dst", "etype", "value")


@query("p1_rename", "SELECT p_partkey AS id, p_brand AS brand FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))


@query("p2_membership", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t):
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderstatus")


@query("p3_drop_nulls", "SELECT event_id, k FROM (SELECT event_id, CASE WHEN value > 5 THEN value END AS k FROM events) WHERE k IS NOT NULL")
def _(t):
    return t.events.select("event_id", F.when(F.col("value") > 5, F.col("value")).alias("k")).dropna(subset=["k"])


@query("p4_dictionary_map", "SELECT event_id, CASE event_type WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'buy' END AS channel FROM events")
def _(t):
    return R.map_values(t.events.select("event_id", "event_type"), "event_type", {"click": "act", "purchase": "buy"}, "channel").drop("event_type")


@query("p5_conditional", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice ELSE p_size END AS x FROM part")
def _(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_retailprice")).otherwise(F.col("p_size").cast("double")).alias("x"))


@query("p6_safe_cast", "SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#1', 'x') AS DOUBLE) AS a, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS b FROM part")
def _(t):
    return t.part.select("p_partkey", R.safe_number(F.replace("p_brand", F.lit("Brand#1"), F.lit("x"))).alias("a"), R.safe_number(F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("b"))


@query("p7_ladder", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS class FROM customer")
def _(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", R.ladder([(b < 0, "debt"), (b < 1000, "low"), (b < 5000, "middle")], "high").alias("class"))


@query("p8_tiers", """WITH x AS (SELECT l_orderkey AS entity, p_brand AS gene, p_size AS pos, p_type AS kind FROM lineitem JOIN part ON l_partkey = p_partkey),
 s AS (SELECT gene, pos FROM x WHERE kind <> 'SMALL' AND pos IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT entity) >= 12)
 SELECT gene, CAST(count(CASE WHEN kind <> 'SMALL' THEN 1 END) AS BIGINT) AS t1, CAST(count(CASE WHEN kind <> 'SMALL' AND (kind = 'PROMO' OR s.pos IS NOT NULL) THEN 1 END) AS BIGINT) AS t2,
 CAST(count(CASE WHEN kind <> 'SMALL' AND s.pos IS NOT NULL THEN 1 END) AS BIGINT) AS t3 FROM x LEFT JOIN s USING (gene, pos) GROUP BY gene""")
def _(t):
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("entity"), F.col("p_brand").alias("gene"), F.col("p_size").alias("pos"), F.col("p_type").alias("kind"))
    return R.tiers(x, "kind", ["SMALL"], ["PROMO"], "gene", "pos", "entity", 12).groupBy("gene").agg(*(F.count_if(f"tier{i}").alias(f"t{i}") for i in (1, 2, 3)))


@query("p9_canonical_pairs", "SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, CASE WHEN l_suppkey > l_partkey THEN l_tax ELSE l_discount END AS xa, CASE WHEN l_suppkey > l_partkey THEN l_discount ELSE l_tax END AS xb FROM lineitem")
def _(t):
    return R.canonical_pairs(t.lineitem.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_discount").alias("xa"), F.col("l_tax").alias("xb")), "a", "b", [("xa", "xb")])


@query("p10_recurrence", "SELECT l_partkey, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 35")
def _(t):
    return R.recurrent(t.lineitem, ["l_partkey"], "l_orderkey", 35)


@query("p11_active_edges", f"WITH {E} SELECT src, dst FROM e WHERE NOT (value > 5)")
def _(t):
    return R.active(t.edges().withColumn("deprecated", F.when(F.col("value") > 5, True))).select("src", "dst")


@query("p12_keyword", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ring')")
def _(t):
    return R.keyword_search(t.part, ["p_name", "p_type"], "RING").select("p_partkey")


@query("p13_fuzzy_lookup", "SELECT p_name, p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains('red', lower(p_name)) ORDER BY p_name, p_partkey LIMIT 1")
def _(t):
    return R.fuzzy_lookup(t.part.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey")), "p_name", "Red")


@query("p14_standardise", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS c_acctbal, 0.0::DOUBLE AS k FROM customer")
def _(t):
    return R.standardise(t.customer.select("c_custkey", "c_acctbal", F.lit(3.0).alias("k")), ["c_acctbal", "k"])


@query("p15_one_hot", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS BIGINT) AS is_F, CAST(o_orderstatus = 'O' AS BIGINT) AS is_O FROM orders")
def _(t):
    return R.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"], "is_").drop("o_orderstatus")


@query("p16_flags", "SELECT user_id, CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error, CAST(max(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM events GROUP BY user_id")
def _(t):
    return R.flags(t.events, "user_id", {"error": F.col("event_type") == "error", "large": F.col("value") > 100})


@query("s5_event_flags", "SELECT o_orderkey, CAST(o_orderpriority LIKE '1%' AS BIGINT) AS canonical, CAST(contains(o_orderpriority, '1') AS BIGINT) AS digit FROM orders")
def _(t):
    return t.orders.select("o_orderkey", R.event_flag("o_orderpriority").alias("canonical"), R.event_flag("o_orderpriority", "digit").alias("digit"))


# --- joins (2.4) -------------------------------------------------------------------


@query("j1_left", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["n"])


@query("j2_inner", "SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("j3_chain", """SELECT p_partkey AS id, CAST(coalesce(a.n, 0) AS BIGINT) AS n, CAST(coalesce(b.m, 0) AS BIGINT) AS m FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.l_partkey = p_partkey
 LEFT JOIN (SELECT l_partkey, count(*) AS m FROM lineitem WHERE l_quantity > 45 GROUP BY 1) b ON b.l_partkey = p_partkey""")
def _(t):
    side = lambda w, n: t.lineitem.where(w).groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias(n))
    return R.chain_left(t.part.select(F.col("p_partkey").alias("id")), "id", [side("l_returnflag = 'R'", "n"), side("l_quantity > 45", "m")])


@query("j4_two_sides", f"WITH {E} SELECT src, dst, a.s_nationkey::BIGINT AS nation_a, b.s_nationkey::BIGINT AS nation_b FROM e LEFT JOIN supplier a ON a.s_suppkey = src LEFT JOIN supplier b ON b.s_suppkey = dst")
def _(t):
    return R.join_twice(t.edges().select("src", "dst"), ("src", "dst"), t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation")), "s_suppkey")


@query("j5_key_join", "SELECT c_custkey, c_acctbal, o_totalprice FROM customer JOIN (SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    return t.customer.select("c_custkey", "c_acctbal").join(t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("o_totalprice")), "c_custkey")


@query("j6_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j7_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j8_range_join", """WITH b AS (SELECT p_partkey * 1.0 AS x1, p_partkey * 1.0 + 20 AS x2, p_retailprice AS y1, p_retailprice + 50 AS y2 FROM part WHERE p_size = 7)
 SELECT p_partkey AS id, EXISTS (SELECT 1 FROM b WHERE (p_partkey * 1.0 BETWEEN x1 AND x2 AND p_retailprice BETWEEN y1 AND y2) OR (p_retailprice BETWEEN x1 AND x2 AND p_partkey * 1.0 BETWEEN y1 AND y2)) AS hit FROM part""")
def _(t):
    x = F.col("p_partkey").cast("double")
    boxes = t.part.where("p_size = 7").select(x.alias("x1"), (x + 20).alias("x2"), F.col("p_retailprice").alias("y1"), (F.col("p_retailprice") + 50).alias("y2"))
    return R.in_boxes(t.part.select(F.col("p_partkey").alias("id"), x.alias("x"), F.col("p_retailprice").alias("y")), boxes, bin_size=50.0).select("id", "hit")


@query("j9_tiered_lookup", """WITH a AS (SELECT p_brand, p_size, round(avg(p_retailprice), 6) AS v FROM part GROUP BY 1, 2 HAVING count(*) >= 3), b AS (SELECT p_brand, round(avg(p_retailprice), 6) AS v FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1), c AS (SELECT p_type, round(avg(p_retailprice), 6) AS v FROM part WHERE p_type <> 'SMALL' GROUP BY 1)
 SELECT p_partkey, coalesce(a.v, b.v, c.v, 0.0) AS v, CAST(CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN c.v IS NOT NULL THEN 3 ELSE 0 END AS BIGINT) AS tier
 FROM part p LEFT JOIN a ON a.p_brand = p.p_brand AND a.p_size = p.p_size LEFT JOIN b ON b.p_brand = p.p_brand LEFT JOIN c ON c.p_type = p.p_type""")
def _(t):
    level = lambda df, keys, least=1: df.groupBy(*keys).agg(F.avg("p_retailprice").alias("v"), F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).drop("c")
    p = t.part
    levels = [(level(p, ["p_brand", "p_size"], 3), ["p_brand", "p_size"], "v"), (level(p.where("p_brand <> 'Brand#1'"), ["p_brand"]), ["p_brand"], "v"), (level(p.where("p_type <> 'SMALL'"), ["p_type"]), ["p_type"], "v")]
    return R.tiered_lookup(p.select("p_partkey", "p_brand", "p_size", "p_type"), levels, "v").select("p_partkey", "v", "tier")


@query("j10_pairs", f"WITH {GR} SELECT a.item AS a, b.item AS b, CAST(count(*) AS BIGINT) AS n FROM h a JOIN h b ON a.entity = b.entity AND a.item < b.item GROUP BY 1, 2")
def _(t):
    return R.pairs_within(t.holdings(), ["entity"], "item").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("j11_jaccard_join", f"""WITH {GR}, s AS (SELECT grp, entity, count(*) AS c FROM g GROUP BY 1, 2), p AS (SELECT a.grp, a.entity AS a, b.entity AS b, count(*) AS shared FROM g a JOIN g b ON a.grp = b.grp AND a.item = b.item AND a.entity < b.entity GROUP BY 1, 2, 3)
 SELECT p.grp, p.a, p.b, CAST(shared AS BIGINT) AS shared, round(shared * 1.0 / (x.c + y.c - shared), 6)::DOUBLE AS jaccard FROM p JOIN s x ON x.grp = p.grp AND x.entity = p.a JOIN s y ON y.grp = p.grp AND y.entity = p.b WHERE shared * 10 >= 8 * (x.c + y.c - shared)""")
def _(t):
    return M.jaccard_join(t.grouped(), "entity", "item", 0.8, ["grp"])


@query("j12_feature_join", """WITH f AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS k FROM lineitem), n AS (SELECT k, count(*) AS n FROM f GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30)
 SELECT a.owner AS a, b.owner AS b, CAST(count(*) AS BIGINT) AS shared, round(sum(1.0 / n), 6)::DOUBLE AS specificity FROM f a JOIN f b ON a.k = b.k AND a.owner < b.owner JOIN n ON n.k = a.k GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(t):
    return M.feature_join(t.lineitem.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("k")), "k", "owner", 2, 30)


@query("j13_group_entity", f"WITH {H}, s AS (SELECT entity, substr(sha256(string_agg(item, '|' ORDER BY item)), 1, 16) AS key FROM h GROUP BY 1), n AS (SELECT key, count(*) AS n FROM s GROUP BY 1) SELECT entity, s.key, CAST(n AS BIGINT) AS n FROM s JOIN n USING (key)")
def _(t):
    s = A.set_keys(t.holdings(), "entity", "item").select("entity", "key")
    return s.join(s.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").select("entity", "key", "n")


@query("j14_optional_match", "SELECT p_partkey, round(coalesce(sum(l_extendedprice), 0.0), 2) AS total FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49 GROUP BY p_partkey")
def _(t):
    s = t.lineitem.where("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_extendedprice").alias("s"))
    return t.part.select("p_partkey").join(s, "p_partkey", "left").select("p_partkey", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"))


@query("j15_two_hop", f"WITH {E} SELECT x.src AS hub, CAST(count(*) AS BIGINT) AS paths FROM u x JOIN u y ON x.src = y.src AND x.dst < y.dst GROUP BY 1")
def _(t):
    return G.two_paths(t.edges()).where("paths > 0").select(F.col("id").alias("hub"), "paths")


@query("j16_shared_neighbours", """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R')
 SELECT a.s AS a, b.s AS b, CAST(count(*) AS BIGINT) AS n, least(count(*) / 5.0, 1.0)::DOUBLE AS weight FROM e a JOIN e b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2""")
def _(t):
    e = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    return R.shared_neighbours(e, "s", "p").drop("shared")


@query("j16_conflicts", """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p, l_returnflag AS k FROM lineitem)
 SELECT a.s AS a, b.s AS b, CAST(count(DISTINCT a.p) AS BIGINT) AS n FROM e a JOIN e b ON a.p = b.p AND a.s <> b.s AND a.k = 'R' AND b.k = 'A' GROUP BY 1, 2""")
def _(t):
    e = t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("k"))
    return R.conflicts(e, "s", "p", "k", "R", "A")


@query("j17_interpolate", """SELECT p_partkey, round(CASE WHEN p_size < 20 THEN 100 + (p_size - 5) * 10.0 WHEN p_size < 40 THEN 250 + (p_size - 20) * 5.0 ELSE 350 + (p_size - 40) * 1.0 END, 6)::DOUBLE AS y FROM part""")
def _(t):
    anchors = t.spark.sql("SELECT * FROM VALUES (5.0D, 100.0D), (20.0D, 250.0D), (40.0D, 350.0D), (60.0D, 370.0D) AS a(x, y0)")
    return R.interpolate(t.part.select("p_partkey", "p_size"), "p_size", anchors, "x", "y0", "y").drop("p_size")


@query("j18_new_columns", "SELECT p_partkey, p_brand, p_size::BIGINT AS p_size, n::BIGINT AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_tax > 0.07 GROUP BY 1) ON l_partkey = p_partkey")
def _(t):
    n = t.lineitem.where("l_tax > 0.07").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"), F.lit("x").alias("p_brand"))
    return R.merge_new_columns(t.part.select("p_partkey", "p_brand"), [t.part.select("p_partkey", "p_size", "p_brand"), n], ["p_partkey"])


@query("j19_class_pairs", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def _(t):
    n = t.nation
    return n.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("i")).join(F.broadcast(n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("j"))), F.col("i") < F.col("j")).select("a", "b")


# --- aggregations (2.5) -----------------------------------------------------------------


@query("a1_a2_a9_counts", "SELECT p_brand, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT p_type) AS BIGINT) AS types, round(avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS large FROM part GROUP BY p_brand")
def _(t):
    return t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("types"), F.avg((F.col("p_size") > 25).cast("int")).alias("large"))


@query("a3_a4_sets", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.size(F.collect_list(F.struct("event_id", "value"))).cast("long").alias("n"))


@query("a5_named", "SELECT l_shipmonth, CAST(count(*) AS BIGINT) AS n, round(avg(l_discount), 6) AS mean, max(l_quantity) AS most FROM (SELECT *, strftime(l_shipdate, '%Y-%m') AS l_shipmonth FROM lineitem) GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("mean"), F.max("l_quantity").alias("most"))


@query("a6_two_level", f"WITH {E}, s AS (SELECT src AS id, avg(value) AS m FROM e GROUP BY 1 UNION ALL SELECT dst, avg(value) FROM e GROUP BY 1) SELECT id, round(avg(m), 6) AS m FROM s GROUP BY id")
def _(t):
    e = t.edges()
    side = lambda c: e.groupBy(F.col(c).alias("id")).agg(F.avg("value").alias("m"))
    return side("src").unionByName(side("dst")).groupBy("id").agg(F.avg("m").alias("m"))


@query("a7_top_share", """WITH c AS (SELECT c_nationkey AS g, p_brand, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, p_brand) AS r FROM c)
 SELECT CAST(g AS BIGINT) AS g, round(sum(CASE WHEN r <= 3 THEN c ELSE 0 END) * 1.0 / sum(c), 6)::DOUBLE AS share, max(CASE WHEN r = 1 THEN p_brand END) AS top FROM r GROUP BY g""")
def _(t):
    df = t.lines().join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("g"), "p_brand")
    return A.top_share(df, ["g"], "p_brand")


@query("a8_quantiles", "SELECT l_returnflag, round(median(l_extendedprice), 6) AS med, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75 FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.median("l_extendedprice").alias("med"), F.percentile("l_extendedprice", F.lit(0.75)).alias("q75"))


@query("a10_pivot", "SELECT p_brand, CAST(max(CASE WHEN p_type = 'PROMO' THEN p_size END) AS BIGINT) AS PROMO, CAST(max(CASE WHEN p_type = 'SMALL' THEN p_size END) AS BIGINT) AS SMALL FROM part GROUP BY p_brand")
def _(t):
    return t.part.groupBy("p_brand").pivot("p_type", ["PROMO", "SMALL"]).agg(F.max("p_size"))


@query("a11_unpivot", "SELECT p_partkey, 'p_size' AS k, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def _(t):
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot("p_partkey", ["p_size", "p_retailprice"], "k", "v")


@query("a12_crosstab", "SELECT o_orderstatus, CAST(count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS BIGINT) AS urgent, CAST(count(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) AS BIGINT) AS low FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count().fillna(0).withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("a13_entropy", """WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), s AS (SELECT *, c * 1.0 / sum(c) OVER (PARTITION BY user_id) AS p FROM c)
 SELECT user_id, round(-sum(p * log2(p)) + 0.0, 6)::DOUBLE AS entropy, CAST(count(*) AS BIGINT) AS classes, CAST(sum(c) AS BIGINT) AS n FROM s GROUP BY user_id""")
def _(t):
    return A.entropy(t.events, ["user_id"], "event_type")


@query("a14_stereotypy", f"""WITH {GR}, u AS (SELECT grp, entity, item, 1.0 / sqrt(count(*) OVER (PARTITION BY grp, entity)) AS u FROM g), f AS (SELECT grp, item, sum(u) AS s FROM u GROUP BY 1, 2), q AS (SELECT grp, sum(s * s) AS q FROM f GROUP BY 1), n AS (SELECT grp, count(DISTINCT entity) AS n FROM g GROUP BY 1)
 SELECT grp, CAST(n AS BIGINT) AS n, round((q - n) / (n * (n - 1)), 6)::DOUBLE AS mean_cosine FROM q JOIN n USING (grp) WHERE n > 1""")
def _(t):
    return A.stereotypy(t.grouped(), ["grp"], "entity", "item")


@query("a15_weighted_mean", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS m FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(A.weighted_mean("l_discount", "l_quantity").alias("m"))


@query("a16_pooled_ratio", "WITH x AS (SELECT p_brand, ln(p_retailprice) AS r, 1.0 / p_size AS v FROM part WHERE p_size > 0) SELECT p_brand, round(sum(r / v) / sum(1 / v), 6)::DOUBLE AS log_ratio, round(sqrt(1 / sum(1 / v)), 6)::DOUBLE AS se, CAST(count(*) AS BIGINT) AS k, round(exp(sum(r / v) / sum(1 / v)), 4)::DOUBLE AS ratio FROM x GROUP BY 1")
def _(t):
    x = t.part.where("p_size > 0").select("p_brand", F.log("p_retailprice").alias("r"), (1.0 / F.col("p_size")).alias("v"))
    return A.pooled_ratio(x, ["p_brand"], "r", "v").withColumn("ratio", F.round("ratio", 4))


@query("a17_clipped_mean", f"WITH {O}, l AS (SELECT least(2 * median(t), quantile_cont(t, 0.9)) AS m FROM o) SELECT grp, round(avg(least(t, m)), 6)::DOUBLE AS mean_time, CAST(count(*) AS BIGINT) AS n FROM o, l GROUP BY grp")
def _(t):
    return A.clipped_mean(t.outcomes(), ["grp"], "t")


@query("a18_specificity", "WITH f AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS k FROM lineitem), n AS (SELECT k, count(*) AS n FROM f GROUP BY 1) SELECT a.s AS a, b.s AS b, CAST(count(*) AS BIGINT) AS shared, round(sum(1.0 / n), 6)::DOUBLE AS specificity FROM f a JOIN f b ON a.k = b.k AND a.s < b.s JOIN n ON n.k = a.k GROUP BY 1, 2")
def _(t):
    return A.specificity(t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("k")), "k", "s")


@query("a19_hub_bridge", "SELECT p_brand, CAST(count(DISTINCT p_partkey) AS BIGINT) AS n, CAST(count(DISTINCT p_type) AS BIGINT) AS spread, round(log2(count(DISTINCT p_partkey)) * count(DISTINCT p_type), 6) AS hub, round(count(DISTINCT p_type) / greatest(log2(count(DISTINCT p_partkey)), 0.1), 6) AS bridge FROM part GROUP BY 1")
def _(t):
    return A.hub_scores(t.part, "p_brand", "p_partkey", "p_type")


@query("a20_information", f"WITH {H} SELECT item, CAST(count(DISTINCT entity) AS BIGINT) AS n, round(-ln(count(DISTINCT entity) * 1.0 / (SELECT count(DISTINCT entity) FROM h)) + 0.0, 6)::DOUBLE AS ic FROM h GROUP BY item")
def _(t):
    return A.information_content(t.holdings(), "item", "entity")


@query("a21_edge_matrix", f"WITH {E}, m AS (SELECT a.s_nationkey AS a, b.s_nationkey AS b, etype, count(*) AS n, avg(value - 5) AS mean, sum(CASE WHEN value > 5 THEN value - 5 ELSE 0 END) AS positive FROM e JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst GROUP BY 1, 2, 3) SELECT a::BIGINT AS a, b::BIGINT AS b, etype, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(positive, 6) AS positive, round(n * 1.0 / max(n) OVER (PARTITION BY etype), 6)::DOUBLE AS relative FROM m")
def _(t):
    e = R.join_twice(t.edges().withColumn("value", F.col("value") - 5), ("src", "dst"), t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n")), "s_suppkey").dropna(subset=["n_a", "n_b"])
    return A.edge_matrix(e.select(F.col("n_a").alias("a"), F.col("n_b").alias("b"), "etype", "value"), "a", "b", "etype", "value")


@query("a22_pair_scores", f"WITH {E} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(value * CASE etype WHEN 'R' THEN 2.0 WHEN 'A' THEN -0.5 ELSE 0 END), 6)::DOUBLE AS additive, round(exp(sum(ln(CASE etype WHEN 'N' THEN 1.5 ELSE 1.0 END))), 6)::DOUBLE AS multiplier FROM e GROUP BY 1, 2")
def _(t):
    e = t.edges().select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "etype", "value")
    return A.pair_scores(e, {"R": 2.0, "A": -0.5}, {"N": 1.5})


@query("a23_cooccurrence", f"WITH {GR} SELECT x.grp, x.item AS a, y.item AS b, CAST(count(*) AS BIGINT) AS n FROM g x JOIN g y ON x.grp = y.grp AND x.entity = y.entity AND x.item < y.item GROUP BY 1, 2, 3 HAVING count(*) >= 10")
def _(t):
    return A.cooccurrence(t.grouped(), ["grp"], "entity", "item", 10)


@query("a24_eras", f"WITH {O} SELECT round(t / 365.0 * 2) / 2 AS era, CAST(count(*) AS BIGINT) AS n, round(avg(e), 6) AS rate FROM o GROUP BY 1 HAVING count(*) >= 5")
def _(t):
    return t.outcomes().groupBy(A.half_steps(F.col("t") / 365.0).alias("era")).agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("rate")).where("n >= 5")


@query("a25_equivalence_groups", f"""WITH {H}, {O}, s AS (SELECT entity, substr(sha256(string_agg(item, '|' ORDER BY item)), 1, 16) AS key FROM h GROUP BY 1)
 SELECT coalesce(key, 'WILDTYPE') AS key, CAST(count(*) AS BIGINT) AS n, CAST(sum(e) AS BIGINT) AS events, round(coalesce(median(CASE WHEN t > 0 THEN t END), 0), 6)::DOUBLE AS median_time FROM o LEFT JOIN s USING (entity) GROUP BY 1""")
def _(t):
    return A.equivalence_groups(t.holdings(), "entity", "item", t.outcomes(), "t", "e").drop("items")


@query("a26_signatures", "SELECT p_name, CAST(count(DISTINCT p_partkey) AS BIGINT) AS members, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS categories FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1 AND count(DISTINCT p_type) > 1")
def _(t):
    return A.by_signature(t.part.withColumn("c", F.array("p_type")), "p_name", "p_partkey", "c").withColumn("categories", F.array_join("categories", ","))


@query("a27_quantile_bins", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT o_orderkey, CAST((o_totalprice > a)::INT + (o_totalprice > b)::INT + (o_totalprice > c)::INT AS BIGINT) AS bin FROM orders, q")
def _(t):
    return A.quantile_bins(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 4, "bin").drop("o_totalprice")


@query("a28_calibration", "WITH r AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER () AS n FROM orders) SELECT CAST(least((r - 1) // (n // 10), 9) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS predicted, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS observed FROM r GROUP BY 1")
def _(t):
    df = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    n = df.count()
    ranked = A.global_rank(df, ["o_totalprice", "o_orderkey"], "r")
    return ranked.groupBy(F.least(F.floor((F.col("r") - 1) / max(1, n // 10)), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("predicted"), F.avg("y").alias("observed"))


@query("a29_coverage", "SELECT 'a' AS \"column\", round(avg(CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share FROM events UNION ALL SELECT 'event_id', 1.0::DOUBLE")
def _(t):
    return R.coverage(t.events.select("event_id", F.when(F.col("value") > 5, 1).alias("a")))


@query("a30_tier_hits", f"WITH {H} SELECT CAST(count(DISTINCT CASE WHEN item IN ('Brand#1', 'Brand#2') THEN entity END) AS BIGINT) AS hit, CAST(count(DISTINCT entity) AS BIGINT) AS n FROM h")
def _(t):
    h = t.holdings()
    hit = h.join(F.broadcast(t.spark.sql("SELECT explode(array('Brand#1', 'Brand#2')) AS item")), "item", "left_semi").agg(F.countDistinct("entity").alias("hit"))
    return hit.crossJoin(h.agg(F.countDistinct("entity").alias("n")))


# --- windows, order, sets (2.6, 2.7) ---------------------------------------------------------


@query("w1_top_k", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")


@query("w2_average_rank", "WITH c AS (SELECT p_size, count(*) AS c FROM part GROUP BY 1), r AS (SELECT p_size, sum(c) OVER (ORDER BY p_size) - (c - 1) / 2.0 AS rank FROM c) SELECT p_partkey, round(rank, 6)::DOUBLE AS rank FROM part JOIN r USING (p_size)")
def _(t):
    return A.average_rank(t.part.select("p_partkey", "p_size"), "p_size", "rank").drop("p_size")


@query("w3_first_row", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("w4_risk_set", f"WITH {O}, b AS (SELECT t, sum(exp(c_acctbal / 10000)) AS s FROM o GROUP BY 1) SELECT t, round(ln(sum(s) OVER (ORDER BY t DESC)), 6) AS log_risk FROM b")
def _(t):
    b = t.outcomes().groupBy("t").agg(F.sum(F.exp(F.col("c_acctbal") / 10000)).alias("s"))
    return V.running(b, "t", ["s"]).select("t", F.log("s").alias("log_risk"))


@query("w5_w7_share", "WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS c FROM orders GROUP BY 1, 2) SELECT o_orderpriority, o_orderstatus, round(c * 1.0 / sum(c) OVER (PARTITION BY o_orderpriority), 6)::DOUBLE AS share, round(c * 1.0 / max(c) OVER (), 6)::DOUBLE AS relative FROM c")
def _(t):
    c = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("c"))
    most = F.broadcast(c.agg(F.max("c").alias("m")))
    return c.crossJoin(most).select("o_orderpriority", "o_orderstatus", (F.col("c") / F.sum("c").over(Window.partitionBy("o_orderpriority"))).alias("share"), (F.col("c") / F.col("m")).alias("relative"))


@query("w10_prefix_cap", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5")
def _(t):
    return t.events.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("r <= 5").select("user_id", "event_id")


@query("t1_t2_sort_limit", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey LIMIT 20")
def _(t):
    return t.customer.orderBy(F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1), F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("t4_argmax", "SELECT p_brand, min(p_partkey) AS best FROM part p WHERE p_retailprice = (SELECT max(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand) GROUP BY p_brand")
def _(t):
    return t.part.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("best"))


@query("u1_union", "SELECT s_nationkey::BIGINT AS n, 's' AS k, s_acctbal AS b FROM supplier UNION ALL SELECT c_nationkey, 'c', NULL FROM customer")
def _(t):
    return t.supplier.select(F.col("s_nationkey").alias("n"), F.lit("s").alias("k"), F.col("s_acctbal").alias("b")).unionByName(t.customer.select(F.col("c_nationkey").alias("n"), F.lit("c").alias("k")), allowMissingColumns=True)


@query("u2_u4_set_algebra", f"WITH {H}, a AS (SELECT item FROM h WHERE entity = 1), b AS (SELECT item FROM h WHERE entity = 2) SELECT CAST((SELECT count(*) FROM (SELECT item FROM a INTERSECT SELECT item FROM b)) AS BIGINT) AS \"both\", CAST((SELECT count(*) FROM (SELECT item FROM a UNION SELECT item FROM b)) AS BIGINT) AS either, CAST((SELECT count(*) FROM (SELECT item FROM a EXCEPT SELECT item FROM b)) AS BIGINT) AS only_a, CAST((SELECT count(*) FROM (SELECT item FROM b EXCEPT SELECT item FROM a)) AS BIGINT) AS only_b")
def _(t):
    s = t.holdings().where("entity IN (1, 2)").agg(F.collect_set(F.when(F.col("entity") == 1, F.col("item"))).alias("a"), F.collect_set(F.when(F.col("entity") == 2, F.col("item"))).alias("b"))
    return s.select(F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_except("b", "a")).alias("only_b"))


@query("u5_u6_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return t.part.select("p_brand", "p_type").distinct()


# --- graph (2.8) ---------------------------------------------------------------------------------


def _nodes(t: Tables) -> DataFrame:
    return G.typed_nodes("supplier", t.supplier, "s_suppkey").unionByName(G.typed_nodes("part", t.part, "p_partkey"))


def _supplier_groups(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("grp"))


@query("g1_typed_nodes", "SELECT 'supplier:' || s_suppkey AS id, 'supplier' AS label, s_acctbal AS bal FROM supplier UNION ALL SELECT 'part:' || p_partkey, 'part', NULL FROM part")
def _(t):
    return _nodes(t).select("id", "label", F.col("num_props")["s_acctbal"].alias("bal"))


@query("g2_typed_edges", "SELECT 'SUPPLIES' AS etype, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS total FROM lineitem UNION ALL SELECT 'ORDERS', CAST(count(*) AS BIGINT), CAST(count(*) AS DOUBLE) FROM orders")
def _(t):
    e = G.typed_edges("SUPPLIES", t.lineitem, "l_suppkey", "l_partkey", "l_quantity").unionByName(G.typed_edges("ORDERS", t.orders, "o_custkey", "o_orderkey"))
    return e.groupBy("etype").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("g3_schema", f"WITH {E} SELECT 'node' AS kind, 'supplier' AS name, unnest(['s_nationkey', 's_acctbal']) AS property, CAST((SELECT count(*) FROM supplier) AS BIGINT) AS n UNION ALL SELECT 'node', 'part', unnest(['p_size', 'p_retailprice']), (SELECT count(*) FROM part) UNION ALL SELECT 'edge', etype, 'value', count(*) FROM e GROUP BY etype")
def _(t):
    return G.schema_of(_nodes(t), t.edges())


@query("g4_edge_features", f"WITH {E}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(CASE WHEN etype = 'R' THEN 1.0 ELSE 0.0 END) AS has, max(CASE WHEN etype = 'R' THEN value END) AS v FROM e GROUP BY 1, 2) SELECT a, b, has::DOUBLE AS has, round(coalesce(least(CASE WHEN v > 1 THEN ln(1 + v) / 10 ELSE v END, 1.0), 0.0), 6)::DOUBLE AS v FROM p")
def _(t):
    return G.edge_features(t.edges(), ["R", "A"]).select("a", "b", F.col("features")[0].alias("has"), F.col("features")[1].alias("v"))


@query("g5_degrees", f"WITH {E} SELECT u.src AS id, CAST(count(*) AS BIGINT) AS degree, CAST(count(CASE WHEN a.s_nationkey = b.s_nationkey THEN 1 END) AS BIGINT) AS same, CAST(count(DISTINCT b.s_nationkey) AS BIGINT) AS groups_reached FROM u LEFT JOIN supplier a ON a.s_suppkey = src LEFT JOIN supplier b ON b.s_suppkey = dst GROUP BY 1")
def _(t):
    return G.group_degrees(t.edges(), _supplier_groups(t))


@query("g6_two_paths", f"WITH {E}, d AS (SELECT src AS id, count(*) AS d FROM u GROUP BY 1) SELECT id, CAST(d * (d - 1) / 2 AS BIGINT) AS paths, round(d * (d - 1) * 1.0 / (SELECT max(d * (d - 1)) FROM d), 6)::DOUBLE AS relative FROM d")
def _(t):
    return G.two_paths(t.edges())


@query("g7_shortest_paths", f"WITH RECURSIVE {E}, r(a, b, d) AS (SELECT src, dst, 1 FROM u UNION SELECT r.a, u.dst, d + 1 FROM r JOIN u ON u.src = r.b WHERE d < 3) SELECT a, b, CAST(min(d) AS BIGINT) AS distance FROM r WHERE a < b GROUP BY 1, 2")
def _(t):
    return G.shortest_paths(t.edges(), 3)


@query("g8_k_hop", f"WITH RECURSIVE {E}, r(source, id, d) AS (SELECT DISTINCT src, src, 0 FROM u WHERE src < 5 UNION SELECT r.source, u.dst, d + 1 FROM r JOIN u ON u.src = r.id WHERE d < 2) SELECT source, id, CAST(min(d) AS BIGINT) AS distance FROM r GROUP BY 1, 2")
def _(t):
    e = t.edges()
    return G.bfs(e, G.undirected(e).where("src < 5").select(F.col("src").alias("source")), 2)


@query("g9_communities")
def _(t):
    e = t.edges().join(_supplier_groups(t), F.col("src") == F.col("id")).select("src", "dst", (F.col("grp") % 5).alias("grp"))
    return G.communities(e)


@query("g10_components", f"WITH RECURSIVE {E}, r(id, o) AS (SELECT DISTINCT src, src FROM u UNION SELECT r.id, u.dst FROM r JOIN u ON u.src = r.o) SELECT id, min(o) AS component FROM r GROUP BY id")
def _(t):
    return G.components(t.edges())


@query("g11_topology")
def _(t):
    return G.topology(t.edges().join(_supplier_groups(t), F.col("src") == F.col("id")).select("src", "dst", (F.col("grp") % 5).alias("grp")))


@query("g11_clustering", f"WITH {E}, t AS (SELECT a.src AS id, count(*) / 2 AS n FROM u a JOIN u b ON a.src = b.src AND a.dst <> b.dst JOIN u c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1), d AS (SELECT src AS id, count(*) AS d FROM u GROUP BY 1) SELECT d.id, CAST(d AS BIGINT) AS degree, CAST(coalesce(n, 0) AS BIGINT) AS triangles, round(CASE WHEN d > 1 THEN 2.0 * coalesce(n, 0) / (d * (d - 1)) ELSE 0 END, 6)::DOUBLE AS coefficient FROM d LEFT JOIN t ON t.id = d.id")
def _(t):
    return G.clustering(t.edges())


@query("g12_mixed_triangles", f"WITH {E}, k AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, etype FROM e WHERE src <> dst), t AS (SELECT DISTINCT x.a, x.b, y.b AS c FROM k x JOIN k y ON x.b = y.a JOIN k z ON z.a = x.a AND z.b = y.b), g AS (SELECT t.a, t.b, t.c FROM t JOIN k ON (k.a = t.a AND k.b = t.b) OR (k.a = t.a AND k.b = t.c) OR (k.a = t.b AND k.b = t.c) GROUP BY 1, 2, 3 HAVING count(DISTINCT etype) >= 2), s AS (SELECT a, b FROM g UNION ALL SELECT a, c FROM g UNION ALL SELECT b, c FROM g) SELECT a, b, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2")
def _(t):
    return G.mixed_triangles(t.edges())


@query("g13_diversity", f"WITH {E}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(DISTINCT etype) AS types FROM e GROUP BY 1, 2) SELECT CAST(types AS BIGINT) AS types, CAST(count(*) AS BIGINT) AS pairs FROM p GROUP BY 1")
def _(t):
    return G.diversity(t.edges())


@query("g14_coherence")
def _(t):
    return G.coherence(t.edges().select("src", "dst", F.col("etype").alias("grp")))


@query("g15_link_prediction")
def _(t):
    e = cut(t.edges().select("src", "dst").where("src <> dst"), "pairs")
    held, kept = (e.where(f"pmod(xxhash64(src, dst), 5) {x} 0") for x in ("=", "<>"))
    absent = e.select("src", (F.col("dst") + 1).alias("dst")).distinct().join(e, ["src", "dst"], "left_anti").where("src <> dst")
    return G.link_prediction(kept, held, absent)


@query("g16_confidence", """SELECT p_partkey, floor(1000000 * (0.2 * (p_size % 11) / 10 + 0.15 * p_size / 50 + 0.15 * (p_partkey % 4) / 3 + 0.15 * CASE WHEN p_size % 5 >= 3 THEN 1 ELSE (p_size % 5) / 3.0 END
 + 0.25 * (p_partkey % 9) / 8 + CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 0.1 * (p_partkey % 6) / 5 END) + 0.001) / 1000000 AS confidence FROM part""")
def _(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    df = t.part.select(
        "p_partkey", ((size % 11) / 10).alias("spectral"), (size / 50).alias("bootstrap"), ((key % 4) / 3).alias("triangle"), G.provenance_share(size % 5).alias("provenance"),
        ((key % 9) / 8).alias("link"), F.when(key % 6 != 0, (key % 6) / 5).alias("coherence"),
    )
    return G.composite_confidence(df).select("p_partkey", (F.floor(1_000_000 * F.col("confidence") + 0.001) / 1_000_000).alias("confidence"))


_STEP = "SELECT n.id, 0.15 * coalesce(s.v, 0) + 0.85 * coalesce((SELECT sum(w.w * {0}.v) FROM w JOIN {0} ON {0}.id = w.src WHERE w.dst = n.id), 0) AS v FROM n LEFT JOIN s ON s.id = n.id"


@query("g17_propagation", f"""WITH {E}, w AS (SELECT src, dst, value / sum(value) OVER (PARTITION BY src) AS w FROM e WHERE value > 0), s AS (SELECT s_suppkey AS id, 1.0::DOUBLE AS v FROM supplier WHERE s_suppkey < 10), n AS (SELECT id FROM s UNION SELECT src FROM w UNION SELECT dst FROM w),
 x0 AS (SELECT n.id, coalesce(s.v, 0) AS v FROM n LEFT JOIN s ON s.id = n.id), x1 AS ({_STEP.format('x0')}), x2 AS ({_STEP.format('x1')}) SELECT id, round(v, 6)::DOUBLE AS value FROM x2""")
def _(t):
    start = t.supplier.where("s_suppkey < 10").select(F.col("s_suppkey").alias("id"), F.lit(1.0).alias("value"))
    return G.propagate(t.edges().where("value > 0").select("src", "dst", F.col("value").alias("weight")), start, rounds=2)


@query("g18_g21_closure", f"WITH RECURSIVE {DAG}, r(id, a, d) AS (SELECT src, dst, 1 FROM g UNION SELECT r.id, g.dst, d + 1 FROM r JOIN g ON g.src = r.a WHERE d < 4) SELECT id, a AS ancestor, CAST(min(d) AS BIGINT) AS distance FROM r GROUP BY 1, 2")
def _(t):
    return G.closure(t.dag(), 4)


@query("g19_dependencies", f"WITH RECURSIVE {E}, r(id, d) AS (SELECT 3::BIGINT, 0 UNION SELECT e.dst, d + 1 FROM r JOIN e ON e.src = r.id WHERE d < 3) SELECT DISTINCT src AS node, etype, dst AS target FROM e WHERE src IN (SELECT id FROM r)")
def _(t):
    return G.dependency_edges(t.edges().select("src", "dst", "etype"), 3, 4)


@query("g20_levels", f"WITH RECURSIVE {DAG}, r(id, l) AS (SELECT src, 0 FROM g WHERE src NOT IN (SELECT dst FROM g) UNION SELECT g.dst, l + 1 FROM r JOIN g ON g.src = r.id) SELECT id, CAST(max(l) AS BIGINT) AS level FROM r GROUP BY id")
def _(t):
    return G.levels(t.dag())


@query("g20_proof_chain", f"WITH RECURSIVE {DAG}, m AS (SELECT max(dst) AS x FROM g), up(id) AS (SELECT x FROM m UNION SELECT g.src FROM up JOIN g ON g.dst = up.id), i AS (SELECT src, dst FROM g WHERE src IN (SELECT id FROM up) AND dst IN (SELECT id FROM up)), r(id, l) AS (SELECT id, 0 FROM up WHERE id NOT IN (SELECT dst FROM i) UNION SELECT i.dst, l + 1 FROM r JOIN i ON i.src = r.id) SELECT id, CAST(max(l) AS BIGINT) AS level FROM r GROUP BY id")
def _(t):
    d = t.dag()
    return G.proof_chain(d, d.agg(F.max("dst")).first()[0])


@query("g20_foundations", f"WITH RECURSIVE {DAG}, r(f, id) AS (SELECT DISTINCT src, src FROM g WHERE src NOT IN (SELECT dst FROM g) UNION SELECT r.f, g.dst FROM r JOIN g ON g.src = r.id) SELECT f AS foundation, CAST(count(*) - 1 AS BIGINT) AS n FROM r GROUP BY f")
def _(t):
    return G.shared_foundations(t.dag())


@query("g22_bridges", """WITH d AS (SELECT o_custkey AS p, list_sort(list(DISTINCT o_orderpriority)) AS ds FROM orders GROUP BY 1), u AS (SELECT DISTINCT o_custkey AS p, CAST(o_orderdate AS DATE) AS c FROM orders)
 SELECT a.p AS a, b.p AS b, strftime(a.c, '%Y-%m-%d') AS concept, round(1 - len(list_intersect(x.ds, y.ds)) * 1.0 / len(list_distinct(list_concat(x.ds, y.ds))), 6)::DOUBLE AS gap FROM u a JOIN u b ON a.c = b.c AND a.p < b.p JOIN d x ON x.p = a.p JOIN d y ON y.p = b.p
 WHERE 1 - len(list_intersect(x.ds, y.ds)) * 1.0 / len(list_distinct(list_concat(x.ds, y.ds))) > 0.3""")
def _(t):
    uses = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("concept"), F.col("o_custkey").alias("p"))
    return G.bridges(uses, t.orders.groupBy(F.col("o_custkey").alias("p")).agg(F.collect_set("o_orderpriority").alias("ds")), "concept", "p")


@query("g23_chains")
def _(t):
    cats = t.supplier.select(F.col("s_suppkey").alias("id"), F.array(F.col("s_nationkey").cast("string"), (F.col("s_nationkey") % 5).cast("string"), F.when(F.col("s_acctbal") > 0, "x").otherwise("y")).alias("cats"))
    return G.chains(t.edges(), cats, 2, 3).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "-"))


@query("g24_subgraph", f"WITH {E}, n AS (SELECT 3::BIGINT AS id UNION SELECT dst FROM u WHERE src = 3) SELECT src, dst, etype, value FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def _(t):
    return G.neighbourhood(t.edges(), 3, 1)


@query("g25_stats", f"WITH {E} SELECT 'edge' AS what, etype AS name, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY etype UNION ALL SELECT 'node', 'supplier', count(*) FROM supplier UNION ALL SELECT 'node', 'part', count(*) FROM part")
def _(t):
    return G.graph_stats(_nodes(t), t.edges())


@query("g26_profile", f"WITH {E} SELECT 'out' AS direction, etype, dst AS other, value FROM e WHERE src = 3 UNION ALL SELECT 'in', etype, src, value FROM e WHERE dst = 3")
def _(t):
    return G.profile(3, t.edges())


@query("g28_channel_profile", f"WITH {E}, c AS (SELECT u.src AS id, CAST(s_nationkey % 5 AS BIGINT) AS grp, count(*) AS n FROM u JOIN supplier ON s_suppkey = dst GROUP BY 1, 2), s AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY id) AS share FROM c) SELECT id, grp, round(share, 6)::DOUBLE AS share, round(1 + (log2(5) - sum(-share * log2(share)) OVER (PARTITION BY id)) / log2(5), 6)::DOUBLE AS weight FROM s")
def _(t):
    return G.channel_profile(t.edges(), t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).cast("long").alias("grp")), 5)


@query("g29_hubs", f"WITH {E}, d AS (SELECT u.src AS id, a.s_nationkey::BIGINT AS grp, count(CASE WHEN a.s_nationkey = b.s_nationkey THEN 1 END) AS same FROM u JOIN supplier a ON a.s_suppkey = src LEFT JOIN supplier b ON b.s_suppkey = dst GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY same DESC, id) AS rank FROM d) SELECT grp, id, CAST(same AS BIGINT) AS same, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 3")
def _(t):
    return G.hubs(t.edges(), _supplier_groups(t))


# --- walks and scorers (2.9) ------------------------------------------------------------------------


def _mutations(t: Tables) -> DataFrame:
    return t.lines().select(F.col("o_custkey").alias("entity"), F.col("p_partkey").alias("item"), F.col("p_type").alias("grp"), F.round(F.col("p_retailprice") / 1000 - 1, 6).alias("value"), (F.col("p_size") > 40).alias("hub"), F.when(F.col("p_size") % 3 == 0, "LOF").otherwise("GOF").alias("direction")).distinct()


MUT = "m AS (SELECT DISTINCT o_custkey AS entity, p_partkey AS item, p_type AS grp, p_brand AS brand, round(p_retailprice / 1000 - 1, 6) AS value, p_size FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


@query("k1_entity_walk", f"""WITH {MUT}, c AS (SELECT entity, grp, count(*) AS n FROM m GROUP BY 1, 2), p AS (SELECT entity, sum(n * (n - 1) / 2) AS w, sum(n) AS n FROM c GROUP BY 1)
 SELECT m.entity, CAST(count(*) AS BIGINT) AS n_items, round(sum(value), 6)::DOUBLE AS value_sum, CAST(count(CASE WHEN p_size % 3 <> 0 THEN 1 END) AS BIGINT) AS n_gof, CAST(count(CASE WHEN p_size % 3 = 0 THEN 1 END) AS BIGINT) AS n_lof,
 round(avg(CASE WHEN p_size > 40 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hub_ratio, CAST(count(DISTINCT grp) AS BIGINT) AS n_groups, CAST(max(w) AS BIGINT) AS pairs_within, CAST(max(p.n * (p.n - 1) / 2 - w) AS BIGINT) AS pairs_across,
 CAST(max(CASE WHEN grp = 'PROMO' THEN 1 ELSE 0 END) AS BIGINT) AS "in_PROMO", CAST(max(CASE WHEN grp = 'SMALL' THEN 1 ELSE 0 END) AS BIGINT) AS "in_SMALL" FROM m JOIN p ON p.entity = m.entity GROUP BY m.entity""")
def _(t):
    return K.entity_walk(_mutations(t), "entity", "item", "grp", "value", "hub", "direction", ["PROMO", "SMALL"])


@query("k2_defaults", "SELECT c_custkey AS entity, CAST(coalesce(n, 0) AS BIGINT) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 450000 GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    n = t.orders.where("o_totalprice > 450000").groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return K.with_defaults(t.customer.select(F.col("c_custkey").alias("entity")), n, "entity")


@query("k3_equal_sets", f"WITH {H}, s AS (SELECT entity, substr(sha256(string_agg(item, '|' ORDER BY item)), 1, 16) AS key, count(*) AS n FROM h GROUP BY 1) SELECT entity, key, CAST(n AS BIGINT) AS n FROM s")
def _(t):
    return K.by_equal_sets(t.holdings(), "entity", "item", lambda s: s.groupBy("key").agg(F.count(F.lit(1)).alias("n")))


def _attention(t: Tables) -> DataFrame:
    p = t.part.select("p_brand").distinct()
    a = p.select(F.col("p_brand").alias("src"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("i"))
    b = p.select(F.col("p_brand").alias("dst"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("j"))
    return a.join(F.broadcast(b), (F.col("i") + F.col("j")) % 7 == 0).where("i <> j").select("src", "dst", (F.col("i") / (F.col("i") + 2.0 * F.col("j"))).alias("weight"))


@query("k4_attention", f"""WITH {H}, b AS (SELECT DISTINCT p_brand AS item, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS i FROM part), a AS (SELECT x.item AS src, y.item AS dst, x.i / (x.i + 2.0 * y.i) AS w FROM b x JOIN b y ON (x.i + y.i) % 7 = 0 AND x.i <> y.i),
 f AS (SELECT x.entity, a.* FROM a JOIN h x ON x.item = src JOIN h y ON y.entity = x.entity AND y.item = dst), s AS (SELECT entity, src AS i, w AS o, 0.0 AS r FROM f UNION ALL SELECT entity, dst, 0.0, w FROM f), l AS (SELECT entity, max(q) AS asymmetry FROM (SELECT entity, i, sum(o) / sum(r) AS q FROM s GROUP BY 1, 2 HAVING sum(r) > 0.01) GROUP BY 1),
 n AS (SELECT entity, count(*) AS n, count(CASE WHEN item IN ('Brand#1', 'Brand#2') THEN 1 END) AS d FROM h GROUP BY 1), t AS (SELECT entity, sum(w) AS flow, avg(w) AS mean_flow, sum(CASE WHEN substr(src, 1, 7) <> substr(dst, 1, 7) THEN w ELSE 0 END) AS cross_flow, max(w) AS max_flow, count(*) AS m FROM f GROUP BY 1)
 SELECT n.entity, CAST(n.n AS BIGINT) AS n, round(coalesce(flow, 0), 6)::DOUBLE AS flow, round(coalesce(mean_flow, 0), 6)::DOUBLE AS mean_flow, round(coalesce(cross_flow, 0), 6)::DOUBLE AS cross_flow, round(coalesce(max_flow, 0), 6)::DOUBLE AS max_flow, round(coalesce(asymmetry, 0), 6)::DOUBLE AS asymmetry,
 round(coalesce(m, 0) * 1.0 / greatest(n.n * (n.n - 1), 1), 6)::DOUBLE AS density, round(d * 1.0 / n.n, 6)::DOUBLE AS driver_ratio FROM n LEFT JOIN t ON t.entity = n.entity LEFT JOIN l ON l.entity = n.entity""")
def _(t):
    h = t.holdings().withColumn("grp", F.substring("item", 1, 7))
    return K.attention(h, "entity", "item", "grp", _attention(t), t.spark.sql("SELECT explode(array('Brand#1', 'Brand#2')) AS item"))


@query("k6_affinity", f"""WITH {GR}, s AS (SELECT grp, entity, count(*) AS c FROM g GROUP BY 1, 2), p AS (SELECT a.grp, a.entity AS a, b.entity AS b, count(*) AS n FROM g a JOIN g b ON a.grp = b.grp AND a.item = b.item AND a.entity < b.entity GROUP BY 1, 2, 3),
 j AS (SELECT p.grp, p.a, p.b, n * 1.0 / (x.c + y.c - n) AS j FROM p JOIN s x ON x.grp = p.grp AND x.entity = p.a JOIN s y ON y.grp = p.grp AND y.entity = p.b WHERE n * 10 >= 8 * (x.c + y.c - n)), d AS (SELECT grp, a AS x, b AS y, j FROM j UNION ALL SELECT grp, b, a, j FROM j),
 r AS (SELECT *, row_number() OVER (PARTITION BY grp, x ORDER BY j DESC, y) AS r FROM d) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, grp, round(j, 6)::DOUBLE AS jaccard FROM r WHERE r <= 3""")
def _(t):
    return M.jaccard_best(t.grouped(), "entity", "item", 0.8, 3, ["grp"]).select("a", "b", "grp", "jaccard")


@query("k6_unified")
def _(t):
    g = cut(t.grouped(), "grouped")
    sets = A.set_keys(g, "entity", "item").select("entity", "key").join(g.select("entity", "grp").distinct(), "entity")
    return K.unified_affinity(M.jaccard_best(g, "entity", "item", 0.9, 20, ["grp"]), sets, "entity", "grp")


@query("k7_smoothing", f"WITH {O}, {E}, p AS (SELECT src AS x, dst AS y, value AS s FROM e WHERE src <> dst UNION ALL SELECT dst, src, value FROM e WHERE src <> dst), n AS (SELECT x, sum(s * round(c_acctbal * 100)) / sum(s) AS near FROM p JOIN o ON o.entity = y WHERE s > 0 GROUP BY 1) SELECT entity, floor(CASE WHEN near IS NULL THEN round(c_acctbal * 100) ELSE 0.7::DOUBLE * round(c_acctbal * 100) + 0.3::DOUBLE * near END * 100 + 0.5) / 10000 AS smoothed FROM o LEFT JOIN n ON n.x = entity")
def _(t):
    e = t.edges().where("src <> dst AND value > 0").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("value").alias("jaccard"))
    cents = t.outcomes().select("entity", F.round(F.col("c_acctbal") * 100).alias("cents"))
    return M.smooth(cents, "entity", "cents", e).select("entity", (F.floor(F.col("smoothed") * 100 + 0.5) / 10_000).alias("smoothed"))


@query("k8_graph_score", f"""WITH {H}, b AS (SELECT DISTINCT p_brand AS item, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS i FROM part), a AS (SELECT x.item AS src, y.item AS dst, x.i / (x.i + 2.0 * y.i) AS w FROM b x JOIN b y ON (x.i + y.i) % 7 = 0 AND x.i <> y.i),
 f AS (SELECT x.entity, 2.0 * sum(w) AS p FROM a JOIN h x ON x.item = src JOIN h y ON y.entity = x.entity AND y.item = dst GROUP BY 1), s AS (SELECT entity, sum(i / 10.0) AS s FROM h JOIN b USING (item) GROUP BY 1) SELECT s.entity, round(s + coalesce(p, 0), 6)::DOUBLE AS score FROM s LEFT JOIN f ON f.entity = s.entity""")
def _(t):
    values = t.part.select(F.col("p_brand").alias("item")).distinct().withColumn("value", F.regexp_extract("item", r"(\d+)", 1).cast("int") / 10.0)
    return K.graph_score(t.holdings(), "entity", "item", values, _attention(t).withColumnRenamed("weight", "value").withColumn("etype", F.lit("ATT")), {"ATT": 2.0})


@query("k10_hierarchical", f"""WITH {MUT}, b AS (SELECT entity, grp, brand, sum(value) AS s, sum(value) / (count(*) * count(*)) AS b FROM m GROUP BY 1, 2, 3), c AS (SELECT entity, grp, sum(s) AS s, sum(b) / sqrt(count(*)) AS c, sum(b) AS b FROM b GROUP BY 1, 2)
 SELECT entity, round(sum(s) / count(*) + sum(b) + 0.6 * sum(c) / sqrt(count(*)), 6)::DOUBLE AS score FROM c GROUP BY 1""")
def _(t):
    m = t.lines().select(F.col("o_custkey").alias("entity"), F.col("p_partkey").alias("item"), F.col("p_type").alias("grp"), F.col("p_brand").alias("brand"), F.round(F.col("p_retailprice") / 1000 - 1, 6).alias("value")).distinct()
    return K.hierarchical_score(m, "entity", "item", "brand", "grp", "value")


@query("k11_modes", f"WITH {E} SELECT src, dst, CASE WHEN value = 0 THEN 'independent' WHEN etype = 'R' AND value <= 1 THEN 'redundant' WHEN etype = 'R' THEN 'multiplicative' WHEN value <= 2 THEN 'rescue' ELSE 'independent' END AS mode FROM e")
def _(t):
    return t.edges().select("src", "dst", K.pair_mode(F.when(F.col("value") != 0, F.col("value")), F.col("etype") == "R").alias("mode"))


@query("k12_pair_features", f"WITH {MUT} SELECT a.entity, CAST(count(*) AS BIGINT) AS pairs, floor(sum(abs(CAST(round(a.value * 1000000) AS BIGINT) - CAST(round(b.value * 1000000) AS BIGINT))) / count(*) + 0.5) / 1000000 AS gap FROM m a JOIN m b ON a.entity = b.entity AND a.item < b.item GROUP BY 1")
def _(t):
    m = t.lines().select(F.col("o_custkey").alias("entity"), F.col("p_partkey").alias("item"), F.round(F.col("p_retailprice") / 1000 - 1, 6).alias("value")).distinct()
    return R.pairs_within(m, ["entity"], "item", ["value"]).groupBy("entity").agg(F.count(F.lit(1)).alias("pairs"), six(F.sum(F.abs(F.round(F.col("value_a") * 1_000_000).cast("long") - F.round(F.col("value_b") * 1_000_000).cast("long")))).alias("gap"))


@query("k13_shifts", "WITH x AS (SELECT CAST(s_nationkey AS BIGINT) AS g, p_brand AS i, l_discount AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey), o AS (SELECT i, avg(v) AS m FROM x GROUP BY 1) SELECT g AS grp, x.i AS item, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN count(*) >= 20 THEN avg(v) ELSE max(m) END, 6) AS shift, count(*) < 20 AS fallback FROM x JOIN o ON o.i = x.i GROUP BY 1, 2")
def _(t):
    x = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("s_nationkey").alias("grp"), F.col("p_brand").alias("item"), F.col("l_discount").alias("v"))
    return K.shifts(x, "grp", "item", "v", 20)


@query("k14_modifiers", f"WITH RECURSIVE {E}, r(s, id, d) AS (SELECT DISTINCT src, src, 0 FROM u WHERE src < 8 UNION SELECT r.s, u.dst, d + 1 FROM r JOIN u ON u.src = r.id WHERE d < 2), q AS (SELECT s, id, min(d) AS d FROM r GROUP BY 1, 2) SELECT id, round(exp(sum(CASE d WHEN 1 THEN ln(1.5) ELSE ln(1.25) END)), 4)::DOUBLE AS factor FROM q WHERE d > 0 GROUP BY id")
def _(t):
    e = t.edges()
    return K.modifiers(e, G.undirected(e).where("src < 8").select(F.col("src").alias("id")).distinct()).select("id", F.round("factor", 4).alias("factor"))


@query("k15_imputation", "WITH a AS (SELECT p_brand, exp(avg(p_size) / 100) AS hr FROM part GROUP BY 1), b AS (SELECT p_type, exp(avg(p_size) / 50) AS hr FROM part WHERE p_type <> 'SMALL' GROUP BY 1) SELECT p_partkey, round(exp(0.5 * (2 * ln(a.hr) + coalesce(ln(b.hr), 0)) / (2 + CASE WHEN b.hr IS NULL THEN 0 ELSE 1 END)), 6)::DOUBLE AS hr, round((2 + CASE WHEN b.hr IS NULL THEN 0 ELSE 1 END) / 3.0, 6)::DOUBLE AS confidence FROM part p JOIN a ON a.p_brand = p.p_brand LEFT JOIN b ON b.p_type = p.p_type")
def _(t):
    a = t.part.groupBy("p_brand").agg(F.exp(F.avg("p_size") / 100).alias("hr"))
    b = t.part.where("p_type <> 'SMALL'").groupBy("p_type").agg(F.exp(F.avg("p_size") / 50).alias("hr"))
    return K.impute(t.part.select("p_partkey", "p_brand", "p_type"), [(a, ["p_brand"], "hr", 2.0), (b, ["p_type"], "hr", 1.0)]).select("p_partkey", "hr", "confidence")


@query("k16_biallelic", """WITH x AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'suppressor' WHEN 1 THEN 'oncogene' ELSE 'other' END AS role, p_partkey % 5 - 2 AS cna, p_partkey % 3 AS d, p_partkey % 2 AS ms, p_partkey % 3 + p_partkey % 2 AS n FROM part)
 SELECT p_partkey, CASE WHEN n = 0 AND cna = 0 THEN NULL WHEN role = 'suppressor' AND cna = -2 THEN 'biallelic:homodel' WHEN role = 'suppressor' AND cna = -1 AND d >= 1 THEN 'biallelic:loh+mutation' WHEN role = 'suppressor' AND cna = -1 AND ms >= 1 THEN 'biallelic:loh+missense' WHEN role = 'suppressor' AND d >= 2 THEN 'biallelic:compound_het' WHEN role = 'suppressor' AND cna IN (-1, -2) THEN 'monoallelic:loh_only' WHEN role = 'suppressor' AND n > 0 THEN 'monoallelic:mutation_only'
 WHEN role = 'oncogene' AND cna = 2 AND n > 0 THEN 'biallelic:amp+mutation' WHEN role = 'oncogene' AND cna = 2 THEN 'monoallelic:amp_only' WHEN role = 'oncogene' AND cna = 1 AND n > 0 THEN 'biallelic:gain+mutation' WHEN role = 'oncogene' AND n > 0 THEN 'monoallelic:mutation_only' WHEN cna = -2 THEN 'biallelic:homodel' WHEN cna <= -1 AND d >= 1 THEN 'biallelic:loh+mutation' WHEN cna >= 2 AND n > 0 THEN 'biallelic:amp+mutation' ELSE 'monoallelic:single_hit' END AS status FROM x""")
def _(t):
    k, s = F.col("p_partkey"), F.col("p_size") % 3
    return t.part.select("p_partkey", K.biallelic(F.when(s == 0, "suppressor").when(s == 1, "oncogene").otherwise("other"), (k % 5 - 2).cast("int"), k % 3, k % 2, k % 3 + k % 2).alias("status"))


@query("k17_vector", "SELECT p_partkey, CAST(p_type = 'PROMO' AS BIGINT) + 10 * CAST(p_brand = 'Brand#1' AS BIGINT) AS code, round(least(p_size / 50.0, 1.0), 5)::DOUBLE AS pos FROM part")
def _(t):
    v = K.mutation_vector(t.part.withColumn("vaf", F.lit(None).cast("double")), ["PROMO", "SMALL"], ["Brand#1"], "p_type", "p_brand", "p_size", "vaf", 50.0)
    f = F.col("features")
    return v.select("p_partkey", (f[0] + 10 * f[2]).cast("long").alias("code"), F.round(f[3].cast("double"), 5).alias("pos"))


@query("k18_channel_matrix", """WITH x AS (SELECT o_custkey AS entity, p_type AS channel, p_brand AS item, p_size > 40 AS hub, l_returnflag AS kind, CASE WHEN p_size % 3 = 0 THEN 'LOF' ELSE 'GOF' END AS dir, l_quantity / (l_quantity + 10 * l_linenumber) AS vaf FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
 SELECT entity, channel, 1::BIGINT AS severed, round(ln(1 + count(*)), 6) AS log_n, CAST(count(DISTINCT item) AS BIGINT) AS n_items, CAST(max(hub::INT) AS BIGINT) AS has_hub, CAST(max((NOT hub)::INT) AS BIGINT) AS has_leaf, round(avg((kind = 'R')::INT), 6) AS truncating, round(avg((kind = 'A')::INT), 6) AS missense, round(avg(vaf), 6) AS mean_vaf, round(max(vaf), 6) AS max_vaf, CAST(count(CASE WHEN dir = 'GOF' THEN 1 END) AS BIGINT) AS gof, CAST(count(CASE WHEN dir = 'LOF' THEN 1 END) AS BIGINT) AS lof FROM x GROUP BY 1, 2""")
def _(t):
    x = t.lines().select(F.col("o_custkey").alias("entity"), F.col("p_type").alias("channel"), F.col("p_brand").alias("item"), (F.col("p_size") > 40).alias("hub"), F.col("l_returnflag").alias("kind"), F.when(F.col("p_size") % 3 == 0, "LOF").otherwise("GOF").alias("dir"), F.col("l_quantity").alias("alt"), (F.col("l_linenumber") * 10.0).alias("ref"))
    return K.channel_matrix(x, "entity", "channel", "item", "hub", "kind", "dir", "alt", "ref", ["R"], ["A"])


@query("k19_hotspots", "WITH c AS (SELECT p_brand AS node, p_size AS spot, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 8) SELECT node, spot::BIGINT AS spot, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY node ORDER BY n DESC, spot) AS BIGINT) AS rank FROM c")
def _(t):
    return K.hotspots(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("node"), F.col("p_size").alias("spot"), "l_orderkey"), "node", "spot", "l_orderkey", 8)


@query("k20_held_out", f"""WITH {H}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY md5(entity || ':' || item), item) AS r, count(*) OVER (PARTITION BY entity) AS n FROM h), k AS (SELECT entity, item FROM r WHERE r > 1 OR n = 1), c AS (SELECT a.item AS a, b.item AS b, count(*) AS w FROM k a JOIN k b ON a.entity = b.entity AND a.item <> b.item GROUP BY 1, 2),
 s AS (SELECT r.entity, c.b, sum(w) AS s FROM r JOIN c ON c.a = r.item WHERE r.r > 1 AND r.n > 1 GROUP BY 1, 2), m AS (SELECT r.entity, r.item AS held, coalesce(s.s, 0) AS mine FROM r LEFT JOIN s ON s.entity = r.entity AND s.b = r.item WHERE r.r = 1 AND r.n > 1)
 SELECT m.entity, held, CAST(count(CASE WHEN s.s > mine THEN 1 END) + 1 AS BIGINT) AS rank FROM m LEFT JOIN s ON s.entity = m.entity GROUP BY 1, 2""")
def _(t):
    return K.held_out_ranks(t.holdings(), "entity", "item")


# --- statistics and survival (2.10) ---------------------------------------------------------------------


@query("v1_kaplan_meier", f"WITH {O}, b AS (SELECT grp, t, count(*) AS n, sum(e) AS d FROM o GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY t DESC) AS risk FROM b), s AS (SELECT *, sum(CASE WHEN d < risk THEN ln(1 - d * 1.0 / risk) ELSE 0 END) OVER (PARTITION BY grp ORDER BY t) AS l, max(CASE WHEN d >= risk THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY t) AS z FROM r) SELECT grp, t, CAST(risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(CASE WHEN z = 1 THEN 0 ELSE exp(l) END, 6)::DOUBLE AS survival FROM s WHERE d > 0")
def _(t):
    return V.kaplan_meier(t.outcomes(), "t", "e", ["grp"])


@query("v2_log_rank", f"WITH {O}, b AS (SELECT t, count(*) AS n0, count(CASE WHEN c_acctbal > 4500 THEN 1 END) AS m0, sum(e) AS d, sum(CASE WHEN c_acctbal > 4500 THEN e ELSE 0 END) AS d1 FROM o GROUP BY 1), r AS (SELECT *, sum(n0) OVER (ORDER BY t DESC) * 1.0 AS n, sum(m0) OVER (ORDER BY t DESC) * 1.0 AS m FROM b) SELECT CAST(sum(d1) AS BIGINT) AS observed, round(sum(d * m / n), 6)::DOUBLE AS expected, round(sum(CASE WHEN n > 1 THEN d * m * (n - m) * (n - d) / (n * n * (n - 1)) ELSE 0 END), 6)::DOUBLE AS variance FROM r WHERE d > 0")
def _(t):
    return V.log_rank(t.outcomes().withColumn("x", (F.col("c_acctbal") > 4500).cast("int")), "t", "e", "x").select("observed", "expected", "variance")


@query("v3_cox")
def _(t):
    return V.cox(t.outcomes().withColumn("bal", F.col("c_acctbal") / 10000).withColumn("south", (F.col("grp") % 2).cast("double")), ["bal", "south"], "t", "e", 1e-4)


@query("v4_v5_cox_atlas")
def _(t):
    g = t.grouped().withColumn("grp", F.col("grp") % 5)
    return V.cox_atlas(g, "grp", "entity", ["item"], "t", "e", t.outcomes().withColumn("grp", F.col("grp") % 5))


@query("v6_interactions", f"""WITH {GR}, {O}, s AS (SELECT g.grp, item, count(*) AS n, sum(e) AS d FROM g JOIN o USING (entity) GROUP BY 1, 2), b AS (SELECT x.grp, x.item AS a, y.item AS b, count(*) AS n, sum(e) AS d FROM g x JOIN g y ON x.entity = y.entity AND x.item < y.item JOIN o ON o.entity = x.entity GROUP BY 1, 2, 3 HAVING count(*) >= 20), t AS (SELECT grp, count(*) AS n, sum(e) AS d FROM o GROUP BY 1)
 SELECT b.grp, b.a, b.b, CAST(b.n AS BIGINT) AS n_ab, CAST(b.d AS BIGINT) AS d_ab, round(ln((b.d + 0.5) / (b.n - b.d + 0.5)) - ln((x.d - b.d + 0.5) / (x.n - b.n - x.d + b.d + 0.5)) - ln((y.d - b.d + 0.5) / (y.n - b.n - y.d + b.d + 0.5)) + ln((t.d - x.d - y.d + b.d + 0.5) / (t.n - x.n - y.n + b.n - t.d + x.d + y.d - b.d + 0.5)), 6)::DOUBLE AS interaction
 FROM b JOIN t ON t.grp = b.grp JOIN s x ON x.grp = b.grp AND x.item = b.a JOIN s y ON y.grp = b.grp AND y.item = b.b""")
def _(t):
    return V.interactions(t.grouped(), "grp", "entity", "item", "t", "e", t.outcomes(), 20)


@query("v7_c_index", f"WITH {O} SELECT CAST(count(CASE WHEN a.c_acctbal > b.c_acctbal THEN 1 END) AS BIGINT) AS concordant, CAST(count(CASE WHEN a.c_acctbal = b.c_acctbal THEN 1 END) AS BIGINT) AS tied, CAST(count(*) AS BIGINT) AS comparable, round((count(CASE WHEN a.c_acctbal > b.c_acctbal THEN 1 END) + count(CASE WHEN a.c_acctbal = b.c_acctbal THEN 1 END) / 2.0) / count(*), 6)::DOUBLE AS c_index FROM o a JOIN o b ON a.t < b.t AND a.e = 1")
def _(t):
    return V.c_index(t.outcomes(), "t", "e", "c_acctbal", 8)


@query("v8_concordance", f"WITH {O}, p AS (SELECT a.grp, a.entity AS i, b.entity AS j, CASE WHEN a.c_acctbal > b.c_acctbal THEN 1.0 WHEN a.c_acctbal = b.c_acctbal THEN 0.5 ELSE 0 END AS s FROM o a JOIN o b ON a.grp = b.grp AND a.t < b.t AND a.e = 1), q AS (SELECT grp, i AS entity, s FROM p UNION ALL SELECT grp, j, s FROM p) SELECT grp, entity, CAST(count(*) AS BIGINT) AS pairs, round(avg(s), 6)::DOUBLE AS concordance FROM q GROUP BY 1, 2")
def _(t):
    return V.concordance_by_entity(t.outcomes(), "entity", "grp", "t", "e", "c_acctbal")


@query("v9_time_auc", f"WITH {O}, k AS (SELECT *, CASE WHEN t <= 1500 AND e = 1 THEN 1 ELSE 0 END AS y FROM o WHERE t > 1500 OR e = 1) SELECT 1500.0::DOUBLE AS t, CAST((SELECT count(*) FROM k) AS BIGINT) AS n, round(avg(CASE WHEN a.c_acctbal > b.c_acctbal THEN 1.0 WHEN a.c_acctbal = b.c_acctbal THEN 0.5 ELSE 0 END), 6)::DOUBLE AS auc FROM k a JOIN k b ON a.y = 1 AND b.y = 0")
def _(t):
    return V.auc_at(t.outcomes(), "t", "e", "c_acctbal", [1500.0])


@query("v10_cox_loss", f"WITH {O}, b AS (SELECT t, sum(exp(c_acctbal / 10000)) AS s, sum(e) AS d, sum(e * c_acctbal / 10000) AS l FROM o GROUP BY 1), r AS (SELECT *, sum(s) OVER (ORDER BY t DESC) AS s0 FROM b) SELECT round(-sum(l - d * ln(s0)) / sum(d), 6)::DOUBLE AS loss, CAST(sum(d) AS DOUBLE) AS events FROM r")
def _(t):
    return V.cox_loss(t.outcomes().withColumn("h", F.col("c_acctbal") / 10000), "t", "e", "h")


@query("v11_v12_tables", "WITH t AS (SELECT o_orderpriority AS g, count(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 250000 THEN 1 END) * 1.0 AS a, count(CASE WHEN o_orderstatus = 'F' AND o_totalprice <= 250000 THEN 1 END) * 1.0 AS b, count(CASE WHEN o_orderstatus <> 'F' AND o_totalprice > 250000 THEN 1 END) * 1.0 AS c, count(CASE WHEN o_orderstatus <> 'F' AND o_totalprice <= 250000 THEN 1 END) * 1.0 AS d FROM orders GROUP BY 1) SELECT g, round(ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))), 6)::DOUBLE AS log_odds, round((a + b + c + d) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d)), 6)::DOUBLE AS chi2, round(a * (a + b + c + d) / ((a + b) * (a + c)), 6)::DOUBLE AS enrichment FROM t")
def _(t):
    tables = T.two_by_two(t.orders.withColumnRenamed("o_orderpriority", "g"), ["g"], F.col("o_orderstatus") == "F", F.col("o_totalprice") > 250000)
    return T.table_tests(tables).select("g", "log_odds", "chi2", "enrichment")


@query("v11_exact_tests")
def _(t):
    tables = T.two_by_two(t.orders.withColumnRenamed("o_orderpriority", "g"), ["g"], F.col("o_orderstatus") == "F", F.col("o_totalprice") > 250000)
    less = T.fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d"), "less")
    return T.table_tests(tables).withColumn("p_less", less).select("g", "p_chi2", "p_fisher", "p_less")


@query("v11_independence", "WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS k, count(*) AS o FROM orders GROUP BY 1, 2), s AS (SELECT o * 1.0 * o / (sum(o) OVER (PARTITION BY r) * sum(o) OVER (PARTITION BY k)) AS x, sum(o) OVER () AS n FROM c) SELECT round(max(n) * (sum(x) - 1), 4)::DOUBLE AS chi2, CAST(max(n) AS BIGINT) AS n FROM s")
def _(t):
    return T.chi2_independence(t.orders, "o_orderstatus", "o_orderpriority").select(F.round("chi2", 4).alias("chi2"), "n")


@query("v13_exclusivity", f"WITH {GR}, x AS (SELECT grp, entity, max(CASE WHEN item = 'Brand#1' THEN 1 ELSE 0 END) AS x, max(CASE WHEN item = 'Brand#2' THEN 1 ELSE 0 END) AS y FROM g GROUP BY 1, 2) SELECT grp, CAST(count(*) AS BIGINT) AS n, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b, CAST(sum(x * y) AS BIGINT) AS \"both\", round(CASE WHEN sum(x) * sum(y) > 0 THEN sum(x * y) * count(*) * 1.0 / (sum(x) * sum(y)) END, 6)::DOUBLE AS ratio FROM x GROUP BY grp")
def _(t):
    return T.exclusivity(t.grouped(), "grp", "entity", "item", "Brand#1", "Brand#2")


@query("v14_pearson", "SELECT CAST(count(*) AS BIGINT) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def _(t):
    return T.pearson(t.lineitem, "l_quantity", "l_extendedprice").select("n", "r")


@query("v14_spearman", "WITH a AS (SELECT p_size, sum(count(*)) OVER (ORDER BY p_size) - (count(*) - 1) / 2.0 AS x FROM part GROUP BY 1), b AS (SELECT p_retailprice, sum(count(*)) OVER (ORDER BY p_retailprice) - (count(*) - 1) / 2.0 AS y FROM part GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n, round(corr(x, y), 6)::DOUBLE AS r FROM part JOIN a USING (p_size) JOIN b USING (p_retailprice)")
def _(t):
    return T.spearman(t.part, "p_size", "p_retailprice").select("n", "r")


@query("v14_mann_whitney", "WITH x AS (SELECT c_acctbal AS v, c_mktsegment = 'BUILDING' AS g FROM customer) SELECT CAST((SELECT count(*) FROM x WHERE g) AS BIGINT) AS n1, CAST((SELECT count(*) FROM x WHERE NOT g) AS BIGINT) AS n2, round(sum(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0 END), 4)::DOUBLE AS u, round(avg(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0 END), 6)::DOUBLE AS auc FROM x a JOIN x b ON a.g AND NOT b.g")
def _(t):
    return T.mann_whitney(t.customer, "c_acctbal", F.col("c_mktsegment") == "BUILDING").select("n1", "n2", F.round("u", 4).alias("u"), "auc")


@query("v14_welch", "WITH s AS (SELECT count(CASE WHEN g THEN 1 END) AS n1, count(CASE WHEN NOT g THEN 1 END) AS n0, avg(CASE WHEN g THEN v END) AS m1, avg(CASE WHEN NOT g THEN v END) AS m0, var_samp(CASE WHEN g THEN v END) AS v1, var_samp(CASE WHEN NOT g THEN v END) AS v0 FROM (SELECT c_acctbal AS v, c_mktsegment = 'BUILDING' AS g FROM customer)) SELECT CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t FROM s")
def _(t):
    return T.welch(t.customer, "c_acctbal", F.col("c_mktsegment") == "BUILDING").select("n1", "n0", "t")


@query("v15_logistic")
def _(t):
    return T.logistic(t.orders.withColumn("x", F.col("o_totalprice") / 100000).withColumn("y", (F.col("o_orderstatus") == "F").cast("int")), ["x"], "y")


@query("v16_least_squares", "SELECT 'x' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem UNION ALL SELECT '(intercept)', round(regr_intercept(l_extendedprice, l_quantity), 4) FROM lineitem")
def _(t):
    return T.least_squares(t.lineitem.withColumnRenamed("l_quantity", "x"), ["x"], "l_extendedprice").select("term", F.round("estimate", 4).alias("estimate"))


@query("v17_ridge")
def _(t):
    return T.least_squares(t.part.withColumn("x", F.col("p_size").cast("double")), ["x"], "p_retailprice", ridge=10.0)


@query("v19_folds", "WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS r FROM customer) SELECT c_custkey, CAST((r - 1) % 5 AS BIGINT) AS fold FROM r")
def _(t):
    return T.folds(t.customer, "c_custkey", "c_mktsegment").select("c_custkey", "fold")


@query("v20_rand_index", "WITH c AS (SELECT p_brand AS a, p_type AS b, count(*) AS c FROM part GROUP BY 1, 2), s AS (SELECT sum(c * (c - 1) / 2) AS s, sum(c) AS n FROM c), x AS (SELECT sum(c * (c - 1) / 2) AS x FROM (SELECT sum(c) AS c FROM c GROUP BY a)), y AS (SELECT sum(c * (c - 1) / 2) AS y FROM (SELECT sum(c) AS c FROM c GROUP BY b)) SELECT round((s - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6)::DOUBLE AS ari FROM s, x, y")
def _(t):
    return T.rand_index(t.part, "p_brand", "p_type")


@query("v21_bootstrap")
def _(t):
    return T.bootstrap(t.part.select("p_partkey", "p_size"), F.sum(F.col("w") * F.col("p_size")) / F.sum("w"), 20)


@query("v23_gap_profile", f"WITH {O} SELECT grp, CAST(count(CASE WHEN t < 800 THEN 1 END) AS BIGINT) AS gap, round(avg(CASE WHEN t < 800 THEN e END), 6)::DOUBLE AS gap_rate, round(avg(CASE WHEN t >= 800 THEN e END), 6)::DOUBLE AS other_rate, round(quantile_cont(t, 0.9), 6)::DOUBLE AS q90 FROM o GROUP BY grp")
def _(t):
    short = F.col("t") < 800
    return t.outcomes().groupBy("grp").agg(F.count_if(short).alias("gap"), F.avg(F.when(short, F.col("e"))).alias("gap_rate"), F.avg(F.when(~short, F.col("e"))).alias("other_rate"), F.percentile("t", F.lit(0.9)).alias("q90"))


# --- similarity and discovery (2.11) ---------------------------------------------------------------------


@query("e2_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id", rounded=("cosine",))
def _(t):
    return M.cosine_pairs(t.embeddings, "vec_id", "embedding", ["label"], 5)


_LONG = "x AS (SELECT CAST(c_nationkey AS BIGINT) AS r, p_brand AS c, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _long(t: Tables) -> DataFrame:
    return t.lines().join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("r"), F.col("p_brand").alias("c")).agg(F.sum("l_quantity").alias("v"))


@query("e3_column_correlation", f"WITH {_LONG}, z AS (SELECT r, c, (v - avg(v) OVER (PARTITION BY c)) / stddev_pop(v) OVER (PARTITION BY c) AS z FROM x) SELECT a.c AS a, b.c AS b, CAST(count(*) AS BIGINT) AS n, round(avg(a.z * b.z), 6) AS r FROM z a JOIN z b ON a.r = b.r AND a.c < b.c GROUP BY 1, 2 HAVING count(*) >= 10")
def _(t):
    return M.column_correlation(_long(t), "r", "c", "v", 10)


@query("e4_pearson_edges", f"WITH {_LONG} SELECT a.c AS a, b.c AS b, CAST(count(*) AS BIGINT) AS n, round(corr(a.v, b.v), 6) AS r FROM x a JOIN x b ON a.r = b.r AND a.c < b.c GROUP BY 1, 2 HAVING abs(corr(a.v, b.v)) >= 0.3")
def _(t):
    return M.pearson_edges(_long(t), "r", "c", "v", 0.3, 2.0).drop("p")


@query("e5_lin", f"WITH {H}, f AS (SELECT item, -ln(count(DISTINCT entity) * 1.0 / (SELECT count(DISTINCT entity) FROM h)) AS ic FROM h GROUP BY 1), k AS (SELECT entity, item, ic FROM h JOIN f USING (item)), m AS (SELECT entity, max(ic) AS m FROM k GROUP BY 1) SELECT a.entity AS a, b.entity AS b, round(CASE WHEN max(x.m) + max(y.m) > 0 THEN 2 * max(a.ic) / (max(x.m) + max(y.m)) ELSE 0 END, 6)::DOUBLE AS lin FROM k a JOIN k b ON a.item = b.item AND a.entity < b.entity JOIN m x ON x.entity = a.entity JOIN m y ON y.entity = b.entity GROUP BY 1, 2")
def _(t):
    h = t.holdings()
    return M.lin_similarity(h, "entity", "item", A.information_content(h, "item", "entity"))


@query("e6_analogous", f"WITH {_LONG}, z AS (SELECT r, c, (v - avg(v) OVER (PARTITION BY c)) / stddev_samp(v) OVER (PARTITION BY c) AS z FROM x), s AS (SELECT r, sqrt(sum(z * z)) AS s FROM z GROUP BY 1) SELECT a.r AS a, b.r AS b, round(sum(a.z * b.z / (x.s * y.s)), 6) AS cosine FROM z a JOIN z b ON a.c = b.c AND a.r < b.r JOIN s x ON x.r = a.r AND x.s >= 1.5 JOIN s y ON y.r = b.r AND y.s >= 1.5 GROUP BY 1, 2 HAVING sum(a.z * b.z / (x.s * y.s)) >= 0.2")
def _(t):
    return M.analogous(_long(t), "r", "c", "v", 1.5, 0.2)


_PAIRS = f"{H}, n AS (SELECT item, count(*) AS n FROM h GROUP BY 1), q AS (SELECT a.item AS a, b.item AS b, a.n AS n_a, b.n AS n_b, (SELECT count(DISTINCT entity) FROM h) AS n, (SELECT count(*) FROM h x JOIN h y ON x.entity = y.entity WHERE x.item = a.item AND y.item = b.item) AS bo FROM n a JOIN n b ON a.item < b.item)"


@query("e7_pair_counts", f"WITH {_PAIRS} SELECT a, b, CAST(bo AS BIGINT) AS \"both\", CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, CAST(n AS BIGINT) AS n FROM q")
def _(t):
    return M.pair_counts(t.holdings(), "entity", "item").select("a", "b", "both", "n_a", "n_b", "n")


@query("e7_converges")
def _(t):
    return M.converges(M.pair_counts(t.lineitem.select(F.col("l_orderkey").alias("e"), F.col("l_suppkey").alias("i")), "e", "i"), 0.6, 5.0, 0.05)


@query("e8_enables", f"WITH {_PAIRS} SELECT a AS source, b AS target, floor(1000000 * (bo * 1.0::DOUBLE * n / (n_a * n_b)) + 0.5) / 1000000 AS lift, 1.0::DOUBLE AS asymmetry, CAST(bo AS BIGINT) AS \"both\" FROM q WHERE bo >= 10 AND bo * n * 100 >= 98 * n_a * n_b")
def _(t):
    # Lift is symmetric, so any asymmetry above 1 leaves no pair; the gate stands at 1.
    found = M.enables(M.pair_counts(t.holdings(), "entity", "item"), 0.98, 1.0)
    return found.withColumn("lift", F.floor(1_000_000 * F.col("lift") + 0.5) / 1_000_000)


@query("e8_enables_confidence", f"WITH {_PAIRS} SELECT CASE WHEN n_b >= n_a THEN a ELSE b END AS source, CASE WHEN n_b >= n_a THEN b ELSE a END AS target, round(bo * 1.0 * n / (n_a * n_b), 6)::DOUBLE AS lift, round(greatest(n_a, n_b) * 1.0 / least(n_a, n_b), 6)::DOUBLE AS asymmetry, CAST(bo AS BIGINT) AS \"both\" FROM q WHERE bo >= 10 AND bo * 1.0 * n / (n_a * n_b) >= 0.9 AND round(greatest(n_a, n_b) * 1.0 / least(n_a, n_b), 9) >= 1.02")
def _(t):
    return M.enables(M.pair_counts(t.holdings(), "entity", "item"), 0.9, 1.02, 10, "confidence")


@query("e9_e10_feature_keys", "WITH f AS (SELECT p_partkey AS o, unnest(['brand:' || p_brand || p_type, 'size:' || p_size, 'price:' || CAST(floor(p_retailprice * 10) AS BIGINT) // 40, 'name:' || p_name || (p_size % 4)]) AS k FROM part), n AS (SELECT k, count(DISTINCT o) AS n FROM f GROUP BY 1 HAVING count(DISTINCT o) BETWEEN 2 AND 50) SELECT a.o AS a, b.o AS b, CAST(count(*) AS BIGINT) AS shared, round(sum(1.0 / n), 6)::DOUBLE AS specificity FROM f a JOIN f b ON a.k = b.k AND a.o < b.o JOIN n ON n.k = a.k GROUP BY 1, 2 HAVING count(*) >= 2")
def _(t):
    size = F.col("p_size")
    keys = F.array(
        F.concat(F.lit("brand:"), "p_brand", "p_type"), F.concat(F.lit("size:"), size.cast("string")), F.concat(F.lit("price:"), F.floor(F.floor(F.col("p_retailprice") * 10) / 40).cast("string")),
        F.concat(F.lit("name:"), "p_name", (size % 4).cast("string")),
    )
    return M.feature_join(t.part.select(F.col("p_partkey").alias("o"), F.explode(keys).alias("k")), "k", "o")


@query("e12_e13_transposes", """WITH u AS (SELECT p_name AS sig, list_sort(list_distinct([p_type, p_brand])) AS c, min(p_partkey) AS u FROM part GROUP BY 1, 2), p AS (SELECT a.sig, a.u AS a, b.u AS b, CAST(len(list_filter(a.c, lambda x: NOT list_contains(b.c, x))) + len(list_filter(b.c, lambda x: NOT list_contains(a.c, x))) AS BIGINT) AS gap FROM u a JOIN u b ON a.sig = b.sig AND a.u < b.u),
 r AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY gap DESC, a, b) AS r FROM p WHERE gap >= 2) SELECT sig, a, b, gap FROM r WHERE r = 1""")
def _(t):
    return M.transposes(t.part.withColumn("c", F.array("p_type", "p_brand")).withColumnRenamed("p_name", "sig"), "sig", "p_partkey", F.col("c"))


@query("e11_verified", """WITH u AS (SELECT p_name AS sig, list_sort(list_distinct([p_type, p_brand])) AS c, min(p_partkey) AS u FROM part GROUP BY 1, 2), p AS (SELECT a.sig, a.u AS a, b.u AS b, len(list_filter(a.c, lambda x: NOT list_contains(b.c, x))) + len(list_filter(b.c, lambda x: NOT list_contains(a.c, x))) AS gap FROM u a JOIN u b ON a.sig = b.sig AND a.u < b.u),
 k AS (SELECT p_partkey, ['m' || (p_size % 3), 'n' || (p_size % 4)] AS m, ['r' || (p_partkey % 5), 's' || (p_partkey % 7), 't' || (p_size % 2)] AS r FROM part), s AS (SELECT sig, a, b, CAST(gap AS BIGINT) AS gap, CAST(len(list_intersect(x.m, y.m)) AS BIGINT) AS shared_methods, CAST(len(list_intersect(x.r, y.r)) AS BIGINT) AS shared_refs FROM p JOIN k x ON x.p_partkey = a JOIN k y ON y.p_partkey = b WHERE gap >= 2)
 SELECT *, gap + 2 * shared_methods + shared_refs AS score FROM s""")
def _(t):
    tag = lambda name, c, n: F.concat(F.lit(name), (F.col(c) % n).cast("string"))
    users = t.part.withColumnRenamed("p_name", "sig").withColumns({"c": F.array("p_type", "p_brand"), "m": F.array(tag("m", "p_size", 3), tag("n", "p_size", 4)), "r": F.array(tag("r", "p_partkey", 5), tag("s", "p_partkey", 7), tag("t", "p_size", 2))})
    return M.verified_transposes(M.transposes(users, "sig", "p_partkey", F.col("c"), farthest_only=False), users, "p_partkey", "m", "r")


@query("e14_shards", """WITH p AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, x.l_orderkey AS o FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = 1 AND y.l_linenumber = 2),
 n AS (SELECT CASE WHEN u.s_nationkey > v.s_nationkey THEN v.s_nationkey ELSE u.s_nationkey END::BIGINT AS shard_a, CASE WHEN u.s_nationkey > v.s_nationkey THEN u.s_nationkey ELSE v.s_nationkey END::BIGINT AS shard_b, CASE WHEN u.s_nationkey > v.s_nationkey THEN b ELSE a END AS id_a, CASE WHEN u.s_nationkey > v.s_nationkey THEN a ELSE b END AS id_b, o FROM p JOIN supplier u ON u.s_suppkey = a JOIN supplier v ON v.s_suppkey = b)
 SELECT shard_a, shard_b, id_a, id_b, min(o) AS o FROM n WHERE NOT (shard_a = shard_b AND shard_a < 3) GROUP BY 1, 2, 3, 4""")
def _(t):
    line = lambda k, x: t.lineitem.where(F.col("l_linenumber") == k).select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias(f"id_{x}"))
    pairs = line(1, "a").join(line(2, "b"), "o")
    for x in "ab":
        pairs = pairs.join(t.supplier.select(F.col("s_suppkey").alias(f"id_{x}"), F.col("s_nationkey").cast("long").alias(f"shard_{x}")), f"id_{x}")
    done = t.nation.where("n_nationkey < 3").select(F.col("n_nationkey").cast("long").alias("shard_a"), F.col("n_nationkey").cast("long").alias("shard_b"))
    return R.oriented_shards(pairs, "shard", "id", done)


@query("e16_votes", "WITH s AS (SELECT DISTINCT p_brand AS gene, p_size AS st FROM part), m AS (SELECT DISTINCT p_brand AS gene, CASE WHEN CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS ch FROM part WHERE CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) < 15), k AS (SELECT st, ch FROM s JOIN m USING (gene)), v AS (SELECT gene, ch, count(*) AS votes FROM s JOIN k USING (st) WHERE gene NOT IN (SELECT gene FROM m) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY votes DESC, ch) AS r FROM v) SELECT gene, ch, CAST(votes AS BIGINT) AS votes FROM r WHERE r = 1")
def _(t):
    i = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    sets = t.part.select(F.col("p_brand").alias("gene"), F.col("p_size").alias("st")).distinct()
    known = t.part.where(i < 15).select(F.col("p_brand").alias("gene"), F.when(i % 2 == 0, "even").otherwise("odd").alias("ch")).distinct()
    return M.vote(known, sets, "gene", "st", "ch")


@query("e17_contradictions", "SELECT p_name, CAST(count(DISTINCT p_type) AS BIGINT) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1")
def _(t):
    return M.contradictions(t.part, "p_name", "p_type").select("p_name", "n")


# --- documents, scalars, streams (2.12) --------------------------------------------------------------------


@query("d1_sections", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
 m AS (SELECT doc_id, pos, CASE WHEN regexp_matches(line, '[^ \t\n\x0B\f\r]') THEN pos % 4 END AS kind, regexp_replace(line, '^[ \t\n\x0B\f\r]+', '') AS title FROM l),
 a AS (SELECT *, max(CASE WHEN kind = 0 THEN pos END) OVER w AS p1, max(CASE WHEN kind = 2 THEN pos END) OVER w AS p2, last_value(CASE WHEN kind = 0 THEN title END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN kind = 2 THEN title END IGNORE NULLS) OVER w AS t2
  FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT doc_id, CAST(pos AS BIGINT) AS pos, coalesce(kind IN (0, 2), false) AS is_heading, concat_ws(' > ', t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END) AS path FROM a""")
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marked = lines.withColumn("line", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("# "), "line")).when(F.col("pos") % 4 == 2, F.concat(F.lit("## "), "line")).otherwise(F.col("line")))
    return D.sections(marked, "doc_id", "pos", "line").select("doc_id", "pos", "is_heading", F.array_join("section_path", " > ").alias("path"))


@query("d2_d4_chunks")
def _(t):
    return D.chunk(t.documents, "doc_id", "text")


@query("d3_strip")
def _(t):
    return t.documents.select("doc_id", D.strip_markup(F.col("text")).alias("text"))


@query("d6_unit", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings")
def _(t):
    v = t.embeddings.select("vec_id", "embedding", M.unit(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round(F.sqrt(M.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"), F.round(F.sqrt(M.dot(F.col("u"), F.col("u"))), 5).alias("unit_norm"))


@query("d7_d8_kmeans")
def _(t):
    placed, _ = D.kmeans(t.embeddings, "vec_id", "embedding", 4)
    return placed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).crossJoin(D.silhouette(placed))


_CENTRES = "p AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1)"


@query("d9_memberships", f"WITH {_CENTRES}, s AS (SELECT vec_id, e.label AS own, c.label AS class, list_inner_product(CAST(embedding AS DOUBLE[]), c) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS score FROM embeddings e, c) SELECT vec_id, class::BIGINT AS class, round(score, 5) AS score, own = class AS is_primary FROM s WHERE own = class OR score >= 0.05")
def _(t):
    c = D.centroids(t.embeddings, "embedding", "label")
    return D.memberships(t.embeddings, "vec_id", "embedding", "label", c, 0.05).withColumn("score", F.round("score", 5))


@query("d9_bridge_pairs", f"WITH {_CENTRES}, s AS (SELECT vec_id, c.label AS class FROM embeddings e, c WHERE e.label = c.label OR list_inner_product(CAST(embedding AS DOUBLE[]), c) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) >= 0.05) SELECT CAST(a.class AS BIGINT) AS class_a, CAST(b.class AS BIGINT) AS class_b, CAST(count(*) AS BIGINT) AS weight, CAST(count(*) AS BIGINT) AS keys FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.class < b.class GROUP BY 1, 2")
def _(t):
    c = D.centroids(t.embeddings, "embedding", "label")
    return D.bridge_pairs(D.memberships(t.embeddings, "vec_id", "embedding", "label", c, 0.05), "vec_id").withColumn("keys", F.size("keys"))


@query("d10_labels", "WITH w AS (SELECT lang, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM documents), n AS (SELECT lang, w, count(*) AS n FROM w WHERE length(w) > 3 AND w NOT IN ('that', 'this', 'with', 'from', 'were', 'have', 'their', 'which', 'these', 'those', 'into', 'over', 'under', 'than', 'then', 'there', 'where', 'when', 'what') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM n) SELECT lang, string_agg(w, ' ' ORDER BY r) AS words FROM r WHERE r <= 3 GROUP BY lang")
def _(t):
    return D.class_labels(t.documents, "lang", "text")


def _named(p: str) -> str:
    """Kind and number of named items in SQL."""
    p = p.removeprefix("(?i)")
    return f"array_to_string(list_transform(list_zip(regexp_extract_all(t, '{p}', 1, 'i'), regexp_extract_all(t, '{p}', 2, 'i')), lambda z: z[1] || ' ' || z[2]), '|')"


@query("d11_structure", rf"""WITH d AS (SELECT doc_id, '\textbf{{' || CASE doc_id % 4 WHEN 0 THEN 'Theorem' WHEN 1 THEN 'lemma' WHEN 2 THEN 'Corollary' ELSE 'Definition' END || ' ' || (doc_id % 7) || CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE '' END || '}} \textbf{{Def. 2}} '
  || CASE WHEN doc_id % 2 = 0 THEN '\textbf{{Open Question 3b}} {{[Ab2001, Cd1999b]}} [Ab2001] [Zz9] ' ELSE '\textbf{{ a phrase in bold here }} \textbf{{short}} \(x\) ' END || text AS t FROM documents)
 SELECT doc_id, {", ".join(f"{_named(p)} AS {n}" for n, p in D.STRUCTURE.items())}, array_to_string(list_sort(list_distinct(flatten(list_transform(regexp_extract_all(t, '{D.CITATION}', 1), lambda c: string_split_regex(c, ',\s*'))))), '|') AS citations,
  array_to_string(list_transform(regexp_extract_all(t, '{D.BOLD}', 1), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g'))[1:10], '|') AS bold_claims, regexp_matches(t, '{D.MATH}') AS has_math FROM d""")
def _(t):
    i = F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, ("Theorem", "lemma", "Corollary", "Definition"))), (i % 4).cast("int"))
    head = F.concat(F.lit(r"\textbf{"), kind, F.lit(" "), (i % 7).cast("string"), F.when(i % 3 == 0, "a").otherwise(""), F.lit(r"} \textbf{Def. 2} "))
    more = F.when(i % 2 == 0, r"\textbf{Open Question 3b} {[Ab2001, Cd1999b]} [Ab2001] [Zz9] ").otherwise(r"\textbf{ a phrase in bold here } \textbf{short} \(x\) ")
    x = D.structure(t.documents.select("doc_id", F.concat(head, more, "text").alias("text")), "text", 10)
    named = (F.array_join(F.transform(c, lambda z: F.concat_ws(" ", z["type"], z["number"])), "|").alias(c) for c in D.STRUCTURE)
    return x.select("doc_id", *named, F.array_join(F.array_sort("citations"), "|").alias("citations"), F.array_join("bold_claims", "|").alias("bold_claims"), "has_math")


@query("d12_tfidf", r"""WITH d AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) > 2) AS w FROM benchmark),
 g AS (SELECT item_id, unnest(w) AS phrase FROM d UNION ALL SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d UNION ALL SELECT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM d),
 f AS (SELECT item_id, phrase, count(*) AS tf FROM g GROUP BY 1, 2), c AS (SELECT phrase, count(*) AS df FROM f GROUP BY 1), s AS (SELECT item_id, phrase, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT item_id) FROM benchmark)) / (1 + df)) + 1) AS score FROM f JOIN c USING (phrase)),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, phrase) AS rank FROM s) SELECT item_id, phrase, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10""")
def _(t):
    return D.tfidf(t.benchmark, "item_id", "text")


@query("d14_representatives", f"WITH {_CENTRES}, s AS (SELECT e.label, vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), c) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS score FROM embeddings e JOIN c ON c.label = e.label), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) SELECT label::BIGINT AS label, vec_id, round(score, 5) AS score, CAST(r AS BIGINT) AS rank FROM r WHERE r <= 3")
def _(t):
    return D.representatives(t.embeddings, "vec_id", "embedding", "label", D.centroids(t.embeddings, "embedding", "label")).withColumn("score", F.round("score", 5))


@query("d13_d15_d16_manifest")
def _(t):
    c = D.centroids(t.embeddings, "embedding", "label")
    members = D.memberships(t.embeddings, "vec_id", "embedding", "label", c, 0.05)
    reps = D.representatives(t.embeddings, "vec_id", "embedding", "label", c)
    manifest = D.cross_manifest(c, "label", D.bridge_pairs(members, "vec_id"))
    scores = D.score_pairs(reps, t.embeddings, "vec_id", "embedding", "label")
    collated = D.collate(members, t.embeddings, "vec_id", reps, "label").select(F.col("class").alias("class_a"), F.col("n").alias("n_a"))
    return manifest.join(scores, ["class_a", "class_b"]).join(collated, "class_a")


@query("d17_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return D.pending(t.documents.select("doc_id"), t.labels, "doc_id")


@query("f1_f6_scalars", """SELECT event_id, upper(event_type) AS u, CAST(json_extract(props, '$.k') AS BIGINT) AS k, substr(sha256(event_type), 1, 16) AS h, round(ln(1 + value), 6) AS l, round(1 / (1 + exp(-value / 10)), 6) AS s, greatest(least(value, 10.0), 1.0) AS c, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def _(t):
    v = F.col("value")
    return t.events.select("event_id", F.upper("event_type").alias("u"), F.from_json("props", "k long")["k"].alias("k"), S.short_digest(F.col("event_type")).alias("h"), F.log1p(v).alias("l"), S.sigmoid(v / 10).alias("s"), S.clip(v, 1.0, 10.0).alias("c"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("f2_position", "SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '[A-Z*]?([0-9]+)', 1) AS BIGINT) AS pos FROM part")
def _(t):
    return t.part.select("p_partkey", S.protein_position(F.col("p_brand")).alias("pos"))


_UNIT_PAIRS = [("mins", "Hours"), ("ft", "in"), ("miles", "yard"), ("inch", "cm"), ("km", "meters"), ("quarters", "dollar"), ("weeks", "ms"), ("gross", "dozens"), ("years", "month"), ("hour", "inch"), ("score", "couple"), ("parsec", "m")]


@query("f8_convert", """SELECT p_partkey, floor(1000000 * CAST(CASE p_partkey % 12 WHEN 0 THEN p_size * 60.0 / 3600 WHEN 1 THEN p_size * 12.0 WHEN 2 THEN p_size * 1760.0 WHEN 4 THEN p_size * 1000.0 WHEN 5 THEN p_size * 0.25
 WHEN 6 THEN p_size * 604800000.0 WHEN 7 THEN p_size * 12.0 WHEN 8 THEN p_size * 31536000.0 / 2592000 WHEN 10 THEN p_size * 10.0 END AS DOUBLE) + 0.5) / 1000000 AS converted FROM part""")
def _(t):
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _UNIT_PAIRS))
    df = t.part.select("p_partkey", "p_size", F.get(pairs, (F.col("p_partkey") % 12).cast("int")).alias("u")).select("p_partkey", "p_size", "u.a", "u.b")
    return S.convert(df, "p_size", "a", "b").select("p_partkey", (F.floor(1_000_000 * F.col("converted") + 0.5) / 1_000_000).alias("converted"))


@query("f9_verbs", "SELECT event_type, CASE event_type WHEN 'purchase' THEN 'subtract' WHEN 'signup' THEN 'add' WHEN 'click' THEN 'multiply' END AS operation, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def _(t):
    table = t.spark.sql("SELECT * FROM VALUES ('purchase', 'subtract', 'lemma'), ('purchase', 'add', 'learned'), ('sign', 'add', 'lemma'), ('lick', 'multiply', 'phrase') AS v(entry, operation, kind)")
    return S.resolve_verb(t.events, "event_type", table).groupBy("event_type", "operation").agg(F.count(F.lit(1)).alias("n"))


@query("f10_f11_chain", "SELECT p_partkey, (p_size - 3 - 4) * 2.0::DOUBLE AS x, CAST(((p_size % 7) + 7) % 7 AS DOUBLE) AS r FROM part")
def _(t):
    steps = F.array(*(F.struct(F.lit(o).alias("op"), F.lit(v).alias("value")) for o, v in (("subtract", 3.0), ("subtract", 4.0), ("multiply", 2.0))))
    return t.part.select("p_partkey", S.fold_chain(F.col("p_size"), steps).alias("x"), S.operate(F.col("p_size").cast("double"), F.lit("remainder"), F.lit(7.0)).alias("r"))


@query("f15_templates", """WITH n AS (SELECT p_partkey, i, CAST(CASE i WHEN 1 THEN p_size WHEN 2 THEN 3 ELSE 4 END AS DOUBLE) AS v FROM part, range(1, 4) r(i)), o AS (SELECT unnest(['add', 'subtract', 'multiply', 'divide']) AS op),
 one AS (SELECT x.p_partkey, x.i, y.i AS j, x.v || ' ' || op || ' ' || y.v AS expression, CASE op WHEN 'add' THEN x.v + y.v WHEN 'subtract' THEN x.v - y.v WHEN 'multiply' THEN x.v * y.v ELSE x.v / nullif(y.v, 0) END AS value FROM n x JOIN n y ON x.p_partkey = y.p_partkey AND x.i <> y.i, o),
 two AS (SELECT one.p_partkey, expression || ' ' || op || ' ' || v AS expression, CASE op WHEN 'add' THEN value + v WHEN 'subtract' THEN value - v WHEN 'multiply' THEN value * v ELSE value / nullif(v, 0) END AS value FROM one JOIN n ON n.p_partkey = one.p_partkey AND n.i <> one.i AND n.i <> j, o)
 SELECT DISTINCT p_partkey, expression, round(value, 6) + 0.0 AS value FROM (SELECT p_partkey, expression, value FROM one UNION ALL SELECT * FROM two) WHERE value IS NOT NULL""")
def _(t):
    return S.two_step_templates(t.part.select("p_partkey", F.array(F.col("p_size").cast("double"), F.lit(3.0), F.lit(4.0)).alias("n")), "p_partkey", "n")


@query("ud3_aggregate", "SELECT p_brand, CAST(sum(p_size * p_size) AS DOUBLE) AS squares FROM part GROUP BY p_brand")
def _(t):
    c = L.Callables()
    c.register("sum_of_squares", lambda s: float((s * s).sum()))
    c.for_aggregates(t.spark, "sum_of_squares")
    return t.part.groupBy("p_brand").agg(F.call_function("sum_of_squares", F.col("p_size").cast("double")).alias("squares"))


@query("ud4_table_function", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, CAST(generate_subscripts(string_split(p_name, ' '), 1) - 1 AS BIGINT) AS pos FROM part")
def _(t):
    c = L.Callables()
    c.register("words_of", lambda text: ((i, w) for i, w in enumerate((text or "").split(" "))))
    c.for_tables(t.spark, "words_of", "pos int, word string")
    return t.spark.sql("SELECT p.p_partkey, w.word, w.pos FROM {part} p, LATERAL words_of(p.p_name) w", part=t.part)


_SIGNS = " || ".join(f"regexp_extract_all(lower(text), '{p}')" for p in (
    r"\bfor (?:all|every|each)\b", r"\bthere (?:exists?|is|are)\b", r"\bif and only if\b", r"\bat (?:least|most)\b", r"\bis (?:an?|the)\b", r"\b(?:equals?|implies|contains?|preserves?|divides?|converges?)\b",
))


@query("f16_signature", f"SELECT doc_id, array_to_string(list_sort(list_distinct({_SIGNS})), '+') AS s FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' For all x there exists y' WHEN 1 THEN ' It is a set, at most 3' WHEN 2 THEN ' It equals 2 if and only if x divides y' ELSE '' END AS text FROM documents)")
def _(t):
    more = F.when(F.col("doc_id") % 5 == 0, " For all x there exists y").when(F.col("doc_id") % 5 == 1, " It is a set, at most 3").when(F.col("doc_id") % 5 == 2, " It equals 2 if and only if x divides y").otherwise("")
    return t.documents.select("doc_id", S.signature(F.concat("text", more), S.QUANTIFIERS + S.PREDICATES).alias("s"))


@query("f17_claims", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'confirmed' WHEN s_suppkey % 3 = 1 THEN 'novel' ELSE 'no_data' END AS status FROM supplier")
def _(t):
    text = F.when(F.col("s_suppkey") % 3 == 0, "TP53 inhibits MDM2.").when(F.col("s_suppkey") % 3 == 1, "We see TP53 binds KRAS here").otherwise("ABC1 activates KRAS")
    found = S.claims(t.supplier.select("s_suppkey", text.alias("text")), "text")
    edges = t.spark.sql("SELECT 'MDM2' AS src, 'TP53' AS dst")
    known = t.spark.sql("SELECT explode(array('TP53', 'MDM2', 'KRAS')) AS name")
    return S.claim_status(found, edges, known).select("s_suppkey", "status")


@query("f18_validate", f"WITH {E} SELECT src, dst, 'self_loop' AS problem FROM e WHERE src = dst UNION ALL SELECT src, dst, 'value_range' FROM e WHERE value < 0 OR value > 20 UNION ALL SELECT src, dst, 'unknown_source' FROM e WHERE src NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def _(t):
    e = t.edges()
    rule = lambda df, name: df.select("src", "dst", F.lit(name).alias("problem"))
    known = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("src"))
    return rule(e.where("src = dst"), "self_loop").unionByName(rule(e.where("value < 0 OR value > 20"), "value_range")).unionByName(rule(e.join(known, "src", "left_anti"), "unknown_source"))


@query("c24_by_unit", "SELECT CAST(l_orderkey AS BIGINT) AS p, l_returnflag AS unit, round(sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END), 6) AS hub, round(coalesce(product(CASE WHEN l_linenumber <> 1 THEN l_linenumber END), 1), 6)::DOUBLE AS scale FROM lineitem GROUP BY 1, 2")
def _(t):
    df = t.lineitem.select(F.col("l_orderkey").alias("p"), F.col("l_returnflag").alias("unit"), F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).otherwise(F.col("l_linenumber").cast("double")).alias("v"), F.when(F.col("l_linenumber") == 1, "hub").otherwise("scale").alias("role"))
    return S.by_unit(df, "p", "unit", "v", "role")


@query("st1_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    return streams.windowed(t.events, "ts", "10 minutes", "1 hour", by=("event_type",)).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("st1_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, s")
def _(t):
    return streams.sessions(t.events, "ts", "10 minutes", "2 hours", "user_id").select("user_id", "start", "n")


@query("st3_daily_segments", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def _(t):
    return streams.daily_segments(t.events, "ts", "1 day", "event_type")


@query("sk5_merge", f"WITH {E} SELECT src, dst, etype, CASE WHEN src % 2 = 0 THEN round((value * 2 + 9) / 3, 6) ELSE value END AS value, CAST(CASE WHEN src % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS n_sources FROM e UNION ALL SELECT -1, -1, 'NEW', 9.0, 1")
def _(t):
    now = F.lit("2024-01-01").cast("timestamp")
    current = t.edges().select("src", "dst", "etype", "value", F.lit(2).alias("n_sources"), F.lit("load").alias("source"), now.alias("created_at"), now.alias("updated_at"), F.lit(False).alias("deprecated"))
    batch = t.edges().where("src % 2 = 0").select("src", "dst", "etype", F.lit(9.0).alias("value"))
    batch = batch.unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("src"), F.lit(-1).cast("long").alias("dst"), F.lit("NEW").alias("etype"), F.lit(9.0).alias("value")))
    return writers.merge_edges(current, batch, "test", "2024-02-01").select("src", "dst", "etype", "value", "n_sources")


@query("sk10_compaction", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS rel_type, 's' AS source, CAST(count(*) AS BIGINT) AS n_edges FROM events WHERE ts < TIMESTAMP '2024-01-08' GROUP BY 1, 2")
def _(t):
    entries = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("rel_type"), F.lit("s").alias("source"))
    return writers.compact(entries, "2024-01-15")


# --- composed analyses (2.13) --------------------------------------------------------------------------------


@query("c1_scripting", f"""WITH {MUT}, f AS (SELECT entity, min(item) AS i FROM m GROUP BY 1), k AS (SELECT f.entity, m.grp AS script FROM f JOIN m ON m.entity = f.entity AND m.item = f.i)
 SELECT m.entity, CAST(count(CASE WHEN exp(value) > 1.1 THEN 1 END) AS BIGINT) AS harmful, CAST(count(CASE WHEN exp(value) < 0.9 THEN 1 END) AS BIGINT) AS protective, floor(sum(CAST(round(value * 1000000) AS BIGINT)) / count(*) + 0.5) / 1000000 AS mean_log_hr, floor(count(CASE WHEN grp = script THEN 1 END) * 1000000 / count(*) + 0.5) / 1000000 AS on_script FROM m JOIN k ON k.entity = m.entity GROUP BY 1""")
def _(t):
    m = _mutations(t)
    script = m.groupBy("entity").agg(F.min_by("grp", "item").alias("script"))
    return m.join(script, "entity").groupBy("entity").agg(F.count_if(F.exp("value") > 1.1).alias("harmful"), F.count_if(F.exp("value") < 0.9).alias("protective"), six(F.sum(F.round(F.col("value") * 1_000_000).cast("long"))).alias("mean_log_hr"), six(F.count_if(F.col("grp") == F.col("script")) * 1_000_000).alias("on_script"))


@query("c5_clinical", "SELECT o_custkey, CAST(min(CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate) END) // 86400 AS BIGINT) AS first_f, CAST(coalesce(min(CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate) END), max(epoch(o_orderdate))) // 86400 AS BIGINT) AS time FROM orders GROUP BY 1")
def _(t):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    first = F.min(F.when(F.col("o_orderstatus") == "F", day))
    return t.orders.groupBy("o_custkey").agg(first.alias("first_f"), F.coalesce(first, F.max(day)).alias("time"))


@query("c7_cross_vs_same", f"WITH {MUT}, {O}, k AS (SELECT entity, count(DISTINCT grp) AS channels FROM m GROUP BY 1) SELECT CAST(channels AS BIGINT) AS channels, CAST(count(*) AS BIGINT) AS n, round(avg(e), 6) AS rate FROM k JOIN o USING (entity) GROUP BY 1")
def _(t):
    k = t.lines().groupBy(F.col("o_custkey").alias("entity")).agg(F.countDistinct("p_type").alias("channels"))
    return k.join(t.outcomes(), "entity").groupBy("channels").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("rate"))


@query("c8_remapping", f"WITH {MUT}, k AS (SELECT entity, count(DISTINCT CAST(regexp_extract(brand, '([0-9]+)', 1) AS INT) % 3) AS k3, count(DISTINCT CAST(regexp_extract(brand, '([0-9]+)', 1) AS INT) % 8) AS k8 FROM m GROUP BY 1) SELECT entity, CAST(k3 AS BIGINT) AS k3, CAST(k8 AS BIGINT) AS k8 FROM k")
def _(t):
    i = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return t.lines().groupBy(F.col("o_custkey").alias("entity")).agg(F.countDistinct(i % 3).alias("k3"), F.countDistinct(i % 8).alias("k8"))


@query("c15_directed", f"WITH {H}, n AS (SELECT item, count(*) AS c FROM h GROUP BY 1), p AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM h a JOIN h b ON a.entity = b.entity AND a.item < b.item GROUP BY 1, 2) SELECT CASE WHEN x.c >= y.c THEN a ELSE b END AS \"primary\", CASE WHEN x.c >= y.c THEN b ELSE a END AS secondary, CAST(n AS BIGINT) AS n, round(CASE WHEN x.c >= y.c THEN (x.c - y.c) / 10.0 ELSE (y.c - x.c) / 10.0 END, 6)::DOUBLE AS gap FROM p JOIN n x ON x.item = a JOIN n y ON y.item = b")
def _(t):
    h = t.holdings()
    return K.directed_pairs(h, "entity", "item", h.groupBy("item").agg((F.count(F.lit(1)) / 10.0).alias("value")))


@query("c16_synergy", "WITH x AS (SELECT DISTINCT l_orderkey AS e, l_suppkey AS i FROM lineitem), v AS (SELECT o_orderkey AS e, o_totalprice / 1000 AS v FROM orders), s AS (SELECT i, avg(v) AS m FROM x JOIN v USING (e) GROUP BY 1), g AS (SELECT avg(v) AS g FROM v) SELECT a.i AS a, b.i AS b, CAST(count(*) AS BIGINT) AS n, round(avg(v) - (max(p.m) + max(q.m) - max(g)), 4) AS synergy FROM x a JOIN x b ON a.e = b.e AND a.i < b.i JOIN v ON v.e = a.e JOIN s p ON p.i = a.i JOIN s q ON q.i = b.i, g GROUP BY 1, 2 HAVING count(*) >= 12")
def _(t):
    x = t.lineitem.select(F.col("l_orderkey").alias("e"), F.col("l_suppkey").alias("i")).distinct()
    v = t.orders.select(F.col("o_orderkey").alias("e"), (F.col("o_totalprice") / 1000).alias("v"))
    s = x.join(v, "e").groupBy("i").agg(F.avg("v").alias("m"))
    p = R.pairs_within(x, ["e"], "i").join(v, "e").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m")).where("n >= 12")
    p = p.join(s.select(F.col("i").alias("a"), F.col("m").alias("ma")), "a").join(s.select(F.col("i").alias("b"), F.col("m").alias("mb")), "b").crossJoin(F.broadcast(v.agg(F.avg("v").alias("g"))))
    return p.select("a", "b", "n", F.round(F.col("m") - (F.col("ma") + F.col("mb") - F.col("g")), 4).alias("synergy"))


@query("c21_ladder_summary", "SELECT p_type, CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3 ELSE 9 END::BIGINT AS step, round(median(p_retailprice), 6) AS med, round(quantile_cont(p_retailprice, 0.75), 6) AS q75 FROM part GROUP BY 1")
def _(t):
    k = F.col("p_type")
    return t.part.groupBy("p_type").agg(F.median("p_retailprice").alias("med"), F.percentile("p_retailprice", F.lit(0.75)).alias("q75")).withColumn("step", F.when(k == "SMALL", 1).when(k == "MEDIUM", 2).when(k == "LARGE", 3).otherwise(9))


@query("c25_missing_pairs", f"WITH {GR}, c AS (SELECT grp, item, count(DISTINCT entity) AS n FROM g GROUP BY 1, 2 HAVING count(DISTINCT entity) >= 3) SELECT grp, item, CAST(n AS BIGINT) AS n FROM c WHERE (grp, item) NOT IN (SELECT CAST(n_nationkey AS BIGINT), 'Brand#' || (n_nationkey + 1) FROM nation)")
def _(t):
    known = t.nation.select(F.col("n_nationkey").cast("long").alias("grp"), F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string")).alias("item"))
    return R.recurrent(t.grouped(), ["grp", "item"], "entity", 3).join(known, ["grp", "item"], "left_anti")


from .functions import language as L  # noqa: E402
from .plans import cohort as C  # noqa: E402


@query("f12_expression", "SELECT p_partkey, CAST(p_size + 3 * 4 - 2 AS DOUBLE) AS v, (p_size - 1) / 2.0::DOUBLE AS w FROM part")
def _(t):
    n = F.col("p_size").cast("string")
    return t.part.select("p_partkey", L.expression_value(F.concat(n, F.lit(" plus three times 4 - 2"))).alias("v"), L.expression_value(F.concat(F.lit("("), n, F.lit(" minus one) over 2"))).alias("w"))


@query("f13_solve", "SELECT p_partkey, (p_size + 4) / 2.0::DOUBLE AS x, p_size - (p_size + 4) / 2.0::DOUBLE AS y FROM part")
def _(t):
    n = F.col("p_size").cast("string")
    s = L.solve(F.array(F.concat(F.lit("x + y = "), n), F.lit("x - y = 4")))
    return t.part.select("p_partkey", s["x"].alias("x"), s["y"].alias("y"))


@query("f14_roles", "SELECT s_suppkey, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS value, 'apple' AS unit, 'scale' AS role FROM supplier UNION ALL SELECT s_suppkey, 20.0, 'box', 'hub' FROM supplier")
def _(t):
    text = F.concat(F.lit("She has "), (F.col("s_suppkey") % 7 + 1).cast("string"), F.lit(" apples per bag and 20 box of them"))
    return L.quantity_roles(t.supplier.select("s_suppkey", text.alias("t")), "s_suppkey", "t")


@query("f20_coverage", "SELECT s_suppkey, 3::BIGINT AS stated, 2::BIGINT AS used, round(2 / 3.0, 6)::DOUBLE AS coverage FROM supplier")
def _(t):
    df = t.supplier.select("s_suppkey", F.lit("2 pens, 7 caps and 9.5 m").alias("t"), F.array(F.lit(2.0), F.lit(9.5)).alias("u"))
    return L.parse_coverage(df, "s_suppkey", "t", "u").drop("missing")


@query("d5_hashed_embedding")
def _(t):
    return L.hashed_embedding(t.benchmark, "item_id", "text", 16).select("item_id", *(F.col("embedding")[i].alias(f"x{i}") for i in range(16)))


def _channels(t: Tables) -> DataFrame:
    return t.lines().select(F.col("o_custkey").alias("entity"), F.col("p_partkey").alias("item"), F.col("p_type").alias("channel")).distinct()


@query("c2_status_matrix", """WITH a AS (SELECT o_custkey AS entity, max((p_type = 'PROMO')::INT) AS p, max((p_type = 'SMALL')::INT) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1), b AS (SELECT o_custkey AS entity, max((o_orderstatus = 'F')::INT) AS f FROM orders GROUP BY 1)
 SELECT a.entity, CAST(p AS BIGINT) AS "hit_PROMO", CAST(s AS BIGINT) AS "hit_SMALL", CAST(coalesce(f, 0) AS BIGINT) AS "site_F" FROM a LEFT JOIN b ON a.entity = b.entity""")
def _(t):
    return C.status_matrix(_channels(t), "entity", "channel", ["PROMO", "SMALL"], t.orders.select(F.col("o_custkey").alias("entity"), "o_orderstatus"), "o_orderstatus", ["F"])


_CH = "ch AS (SELECT DISTINCT o_custkey AS entity, p_partkey AS item, p_type AS channel FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


@query("c3_treatment_match", f"""WITH {_CH}, {O}, tr AS (SELECT DISTINCT o_custkey AS entity, o_orderstatus AS arm FROM orders), tg AS (SELECT * FROM (VALUES ('F', 'PROMO'), ('O', 'SMALL')) v(arm, channel)), hit AS (SELECT DISTINCT tr.entity, tr.arm FROM tr JOIN tg ON tg.arm = tr.arm JOIN ch ON ch.entity = tr.entity AND ch.channel = tg.channel)
 SELECT tr.arm, hit.entity IS NOT NULL AS matched, CAST(count(*) AS BIGINT) AS n, CAST(sum(e) AS BIGINT) AS events, round(median(t), 6)::DOUBLE AS median_time FROM tr JOIN o ON o.entity = tr.entity LEFT JOIN hit ON hit.entity = tr.entity AND hit.arm = tr.arm GROUP BY 1, 2""")
def _(t):
    targets = t.spark.sql("SELECT * FROM VALUES ('F', 'PROMO'), ('O', 'SMALL') AS v(arm, channel)")
    return C.treatment_match(_channels(t), t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("arm")), targets, t.outcomes())


@query("c4_treatment_vector", "SELECT p_partkey, CAST(contains(p_name, 'red') AS BIGINT) AS a, CAST(contains(p_name, 'ring') OR contains(p_name, 'red') AS BIGINT) AS b FROM part")
def _(t):
    classes = t.spark.sql("SELECT * FROM VALUES ('red', array(0, 1)), ('ring', array(1)) AS v(name, indices)")
    return C.treatment_vector(t.part, "p_partkey", "p_name", classes, 2).select("p_partkey", F.col("vector")[0].alias("a"), F.col("vector")[1].alias("b"))


@query("c6_depth", f"""WITH {_CH}, {O}, p AS (SELECT entity, count(DISTINCT channel) AS k, count(*) AS n FROM ch GROUP BY 1 HAVING count(DISTINCT channel) = 2), m AS (SELECT median(n) AS m FROM p), x AS (SELECT o.t, o.e, CASE WHEN n > m THEN 1 ELSE 0 END AS d FROM p JOIN o USING (entity), m), b AS (SELECT t, count(*) AS n0, sum(d) AS m0, sum(e) AS d, sum(d * e) AS d1 FROM x GROUP BY 1), r AS (SELECT *, sum(n0) OVER (ORDER BY t DESC) * 1.0 AS n, sum(m0) OVER (ORDER BY t DESC) * 1.0 AS m FROM b)
 SELECT CAST(sum(d1) AS BIGINT) AS observed, round(sum(d * m / n), 6)::DOUBLE AS expected FROM r WHERE d > 0""")
def _(t):
    return C.depth_within(_channels(t), t.outcomes(), 2).select("observed", "expected")


@query("c7_cross_or_same", f"WITH {_CH}, {O}, p AS (SELECT entity, CASE WHEN count(DISTINCT channel) > 1 THEN 'cross' ELSE 'same' END AS kind FROM ch GROUP BY 1 HAVING count(*) > 1) SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(e) AS BIGINT) AS events, round(avg(e), 6) AS rate FROM p JOIN o USING (entity) GROUP BY 1")
def _(t):
    return C.cross_or_same(_channels(t), t.outcomes())


@query("c9_adjusted_cox")
def _(t):
    df = t.outcomes().withColumn("x", F.col("c_acctbal") / 10000).withColumn("r", (F.col("grp") % 3).cast("string"))
    return C.adjusted_cox(df, "x", "r", ["0", "1", "2"])


@query("c10_covariates", "SELECT event_type AS e, min(CASE WHEN user_id % 2 = 0 THEN CAST(value AS VARCHAR) END) IS NOT NULL AS a FROM events GROUP BY 1")
def _(t):
    long = t.events.select(F.col("event_type").alias("e"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("n"), F.col("value").cast("string").alias("v"))
    return C.covariates(long, "e", "n", "v", ["a", "b"]).select("e", F.col("a").isNotNull().alias("a"))


@query("c11_cooccurrence", f"WITH {_CH}, c AS (SELECT DISTINCT entity, channel FROM ch), p AS (SELECT a.channel AS a, b.channel AS b, count(*) AS n FROM c a JOIN c b ON a.entity = b.entity AND a.channel < b.channel GROUP BY 1, 2) SELECT a, b, CAST(n AS BIGINT) AS n, round(1.0 / n, 6)::DOUBLE AS distance FROM p WHERE n >= (SELECT median(n) FROM p)")
def _(t):
    return C.cooccurrence_distance(_channels(t), "channel")


@query("c12_comparison", "WITH x AS (SELECT c_mktsegment = 'BUILDING' AS g, (c_acctbal > 5000)::INT AS rich, (c_nationkey % 2)::INT AS odd FROM customer), l AS (SELECT g, 'rich' AS site, rich AS v FROM x UNION ALL SELECT g, 'odd', odd FROM x), t AS (SELECT site, count(CASE WHEN g AND v = 1 THEN 1 END) AS a, count(CASE WHEN g AND v = 0 THEN 1 END) AS b, count(CASE WHEN NOT g AND v = 1 THEN 1 END) AS c, count(CASE WHEN NOT g AND v = 0 THEN 1 END) AS d FROM l GROUP BY 1) SELECT site, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, round(ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))), 6)::DOUBLE AS log_odds FROM t")
def _(t):
    x = t.customer.select(F.col("c_mktsegment"), (F.col("c_acctbal") > 5000).cast("int").alias("rich"), (F.col("c_nationkey") % 2).cast("int").alias("odd"))
    return C.group_comparison(x, F.col("c_mktsegment") == "BUILDING", "e", ["rich", "odd"]).drop("p_fisher")


@query("c13_terminal_residues", "SELECT CAST(count(*) AS BIGINT) AS n, round(corr(p_size / (50.0 + p_partkey % 10), abs(ln(p_retailprice / 1000))), 6)::DOUBLE AS r FROM part WHERE p_size > 0")
def _(t):
    atlas = t.part.select(F.col("p_partkey").alias("g"), F.col("p_size").alias("pos"), (F.col("p_retailprice") / 1000).alias("hr"))
    lengths = t.part.select(F.col("p_partkey").alias("g"), (50 + F.col("p_partkey") % 10).alias("length"))
    return C.terminal_residues(atlas, lengths, "g", "pos", "hr").select("n", "r")


@query("c14_position_severity", "SELECT p_type AS channel, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'hub' ELSE 'leaf' END AS place, CAST(count(*) AS BIGINT) AS n, round(avg(p_retailprice), 6) AS mean_hr, round(median(p_retailprice), 6) AS median_hr FROM part GROUP BY 1, 2")
def _(t):
    hubs = t.spark.sql("SELECT explode(array('Brand#1', 'Brand#2')) AS id")
    return C.position_severity(t.part.withColumnRenamed("p_type", "channel"), hubs, "p_brand", "channel", "p_retailprice")


@query("c17_decomposition", f"WITH {O}, p AS (SELECT a.c_acctbal AS x, b.c_acctbal AS y, a.grp AS g, b.grp AS h FROM o a JOIN o b ON a.t < b.t AND a.e = 1) SELECT 'balance' AS level, round(avg(CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0 END), 6)::DOUBLE AS c_index FROM p UNION ALL SELECT 'group', round(avg(CASE WHEN g > h THEN 1.0 WHEN g = h THEN 0.5 ELSE 0 END), 6)::DOUBLE FROM p")
def _(t):
    return C.decomposition(t.outcomes(), {"balance": "c_acctbal", "group": "grp"}, "t", "e")


@query("c18_confidence_bins")
def _(t):
    return C.confidence_bins(t.outcomes(), "c_acctbal", 3, "t", "e", "grp")


@query("c19_escalation", f"WITH {_CH}, {O}, c AS (SELECT entity, channel, count(*) AS c FROM ch GROUP BY 1, 2), h AS (SELECT entity, round(-sum(p * log2(p)), 9) AS h FROM (SELECT *, c * 1.0 / sum(c) OVER (PARTITION BY entity) AS p FROM c) GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n, round(corr(h, t), 5)::DOUBLE AS r FROM h JOIN o USING (entity)")
def _(t):
    h = A.entropy(_channels(t), ["entity"], "channel")
    return T.pearson(h.join(t.outcomes(), "entity"), "entropy", "t").select("n", F.round("r", 5).alias("r"))


@query("c20_gap_proposals", f"WITH {GR}, {O}, x AS (SELECT g.grp, item, t < 1200 AS gap FROM g JOIN o USING (entity)), n AS (SELECT grp, item, count(CASE WHEN gap THEN 1 END) AS a, count(CASE WHEN NOT gap THEN 1 END) AS b FROM x GROUP BY 1, 2), t AS (SELECT grp, greatest(count(CASE WHEN gap THEN 1 END), 1) AS g, greatest(count(CASE WHEN NOT gap THEN 1 END), 1) AS o FROM x GROUP BY 1) SELECT n.grp, item, CAST(a AS BIGINT) AS n_gap, round((a + 0.5) / g / ((b + 0.5) / o), 6)::DOUBLE AS ratio FROM n JOIN t ON t.grp = n.grp WHERE a >= 2 AND (a + 0.5) / g / ((b + 0.5) / o) >= 1.3 AND item <> 'Brand#1'")
def _(t):
    cases = t.grouped().join(t.outcomes().select("entity", "t"), "entity")
    known = t.nation.select(F.col("n_nationkey").cast("long").alias("grp"), F.lit("Brand#1").alias("item"))
    return C.gap_proposals(cases, "grp", "item", F.col("t") < 1200, known, 2, 1.3)


@query("c22_class_enrichment", "WITH p AS (SELECT p_type AS k, count(CASE WHEN p_size > 25 THEN 1 END) AS a, count(CASE WHEN p_size <= 25 THEN 1 END) AS b FROM part GROUP BY 1), t AS (SELECT sum(a) AS x, sum(b) AS y FROM p) SELECT k, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(x - a AS BIGINT) AS c, CAST(y - b AS BIGINT) AS d, round(ln((a + 0.5) * (y - b + 0.5) / ((b + 0.5) * (x - a + 0.5))), 6)::DOUBLE AS log_odds FROM p, t")
def _(t):
    return C.class_enrichment(t.part.withColumnRenamed("p_type", "k"), "k", F.col("p_size") > 25).drop("p_fisher")


@query("c23_weighted_fit", "WITH x AS (SELECT p_size * 1.0 AS x, p_retailprice AS y, p_partkey % 3 + 1.0 AS w FROM part), m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM x) SELECT 'x' AS term, round(sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)), 4)::DOUBLE AS estimate FROM x, m")
def _(t):
    df = t.part.select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 3 + 1.0).alias("w"))
    return T.least_squares(df, ["x"], "y", "w").where("term = 'x'").select("term", F.round("estimate", 4).alias("estimate"))


@query("v17_ridge_search")
def _(t):
    df = t.part.select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("x"), "p_retailprice")
    return C.ridge_search(df, ["x"], "p_retailprice", "p_partkey", "p_brand", [0.1, 100.0], 3)


@query("g27_refresh", f"WITH {E}, d AS (SELECT src AS id, count(*) AS degree FROM u GROUP BY 1) SELECT id, CAST(degree AS BIGINT) AS degree, round(degree * 1.0 / (SELECT max(degree) FROM d), 6)::DOUBLE AS relative FROM d")
def _(t):
    jobs = {"edges": ([], t.edges), "degree": (["edges"], G.degrees), "relative": (["degree"], lambda d: d.crossJoin(F.broadcast(d.agg(F.max("degree").alias("m")))).select("id", "degree", (F.col("degree") / F.col("m")).alias("relative")))}
    return C.refresh(jobs)["relative"]
