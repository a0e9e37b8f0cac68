"""Queries on record tables: reads, links, filters, sets, lookups, orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wordloom.functions.text import bits
from wordloom.operators import filters, hooks, idsets, links, lookups, order
from wordloom.operators.filters import BitRule
from wordloom.operators.links import Hop
from wordloom.plans.registry import query, table
from wordloom.sources.kept import shared_folder
from wordloom.sources.records import open_table, point_read


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey = 17")
def point_read_part(spark, sf):
    return point_read(open_table(spark, "native:part", sf), "p_partkey", 17).select("p_partkey", "p_name", "p_size")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey BETWEEN 100 AND 149")
def slice_scan(spark, sf):
    return order.slice_rows(table(spark, sf, "part"), "p_partkey", 100, 50).select("p_partkey", "p_name")


@query("SELECT count(*) AS n FROM lineitem")
def count_rows(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_name, p_partkey, pos FROM (
  SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS pos FROM part) WHERE pos BETWEEN 120 AND 139""")
def page_of_results(spark, sf):
    return order.page(table(spark, sf, "part").select("p_name", "p_partkey"), [F.col("p_name").asc(), F.col("p_partkey").asc()], 127, 20)


@query("SELECT o_orderkey, count(l_orderkey) AS n_links FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def link_count(spark, sf):
    return links.link_count(table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey")


@query("SELECT o_custkey AS id FROM orders WHERE o_totalprice > 200000")
def resolve_fk(spark, sf):
    orders = table(spark, sf, "orders")
    return links.resolve_key(idsets.ids(orders.where("o_totalprice > 200000"), "o_orderkey"), orders, "o_orderkey", "o_custkey")


@query("SELECT DISTINCT l_partkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def resolve_link(spark, sf):
    chosen = idsets.ids(table(spark, sf, "orders").where("o_orderstatus = 'F'"), "o_orderkey")
    return links.resolve_link(chosen, table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query("""SELECT c_nationkey::BIGINT AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)""")
def link_path(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    first = orders.agg(F.min("o_orderpriority").alias("m"))
    start = idsets.ids(orders.join(F.broadcast(first), F.col("o_orderpriority") == F.col("m")), "o_orderkey")
    return links.follow(start, [Hop(orders, "o_orderkey", "o_custkey"), Hop(customer, "c_custkey", "c_nationkey")])


@query("""SELECT id FROM (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 300000 UNION
  SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000))""")
def link_path_merged(spark, sf):
    orders = table(spark, sf, "orders")
    start = idsets.ids(orders.where("o_totalprice > 300000"), "o_orderkey")
    return links.follow(start, [Hop(orders, "o_orderkey", "o_custkey"), Hop(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", many=True, merge=True)])


RULES = [BitRule(False, 1, 1, shift=2, mask=3), BitRule(True, 1, 1, mask=1), BitRule(True, 32, 40)]
RULES_SQL = "CASE WHEN (p_size >> 2) & 3 = 1 THEN false WHEN p_size & 1 = 1 THEN true WHEN p_size BETWEEN 32 AND 40 THEN true ELSE false END"


@query(f"SELECT p_partkey, p_size FROM part WHERE {RULES_SQL}")
def bitfield_rules(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size").where(filters.bit_rules(F.col("p_size"), RULES, default=False))


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {RULES_SQL}")
def bitfield_via_link(spark, sf):
    kept = filters.bit_rules(F.col("p_size"), RULES, default=False)
    return filters.through_link(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part"), "p_partkey", kept).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (3, 5, 7)")
def accept_values(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size").where(filters.accept_values(F.col("p_size"), 3, 5, 7))


@query("SELECT p_partkey, p_size FROM part WHERE NOT p_size BETWEEN 10 AND 45")
def reject_range(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size").where(filters.reject_range(F.col("p_size"), 10, 45))


@query("SELECT p_partkey, (p_size >> 1) & 7 AS b FROM part")
def bit_extract(spark, sf):
    return table(spark, sf, "part").select("p_partkey", bits(F.col("p_size"), 1, 7).alias("b"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 2, 4)")
def type_mask(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").where(filters.type_mask(F.col("l_linenumber"), 0x16))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def in_cursor_semi(spark, sf):
    return filters.in_set(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", idsets.ids(table(spark, sf, "customer").where("c_nationkey = 3"), "c_custkey")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def merge_semi(spark, sf):
    return filters.in_set(table(spark, sf, "customer").select("c_custkey"), "c_custkey", idsets.ids(table(spark, sf, "orders"), "o_custkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def anti_except(spark, sf):
    return filters.not_in_set(table(spark, sf, "customer").select("c_custkey"), "c_custkey", idsets.ids(table(spark, sf, "orders").where("o_totalprice > 100000"), "o_custkey"))


@query("""SELECT event_id, user_id, event_type FROM (
  SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  WHERE r = 1 OR b IS DISTINCT FROM event_type""")
def drop_adjacent_dups(spark, sf):
    return idsets.drop_adjacent(table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["ts", "event_id"], "event_type", ["user_id"]).select("event_id", "user_id", "event_type")


def _sets(spark, sf):
    orders = table(spark, sf, "orders")
    return idsets.ids(orders.where("o_totalprice > 150000"), "o_custkey"), idsets.ids(orders.where("o_orderstatus = 'F'"), "o_custkey"), idsets.ids(table(spark, sf, "customer").where("c_acctbal < 0"), "c_custkey")


A_SQL = "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 150000"
B_SQL = "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'"
C_SQL = "SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0"


@query(f"{A_SQL} UNION {B_SQL}")
def set_or(spark, sf):
    a, b, _ = _sets(spark, sf)
    return idsets.combine("or", a, b)


@query(f"{A_SQL} INTERSECT {B_SQL}")
def set_and(spark, sf):
    a, b, _ = _sets(spark, sf)
    return idsets.combine("and", a, b)


@query(f"{A_SQL} EXCEPT {B_SQL}")
def set_except(spark, sf):
    a, b, _ = _sets(spark, sf)
    return idsets.combine("not", a, b)


@query(f"SELECT id, 0 AS side FROM ({A_SQL}) UNION ALL SELECT id, 1 AS side FROM ({C_SQL})")
def set_append(spark, sf):
    a, _, c = _sets(spark, sf)
    return idsets.combine("append", a, c)


@query(f"{A_SQL} UNION {B_SQL} UNION {C_SQL}")
def kway_or(spark, sf):
    return idsets.any_of(*_sets(spark, sf))


@query(f"SELECT count(DISTINCT id) AS n FROM ({A_SQL})")
def set_bitmap_count(spark, sf):
    return idsets.bitmap_count(idsets.as_bitmap(_sets(spark, sf)[0]))


def _add_bitmaps(operator: str, sql: str) -> None:
    @query(f"SELECT id FROM ({A_SQL} {sql} {B_SQL})", f"bitmap_{operator}")
    def run(spark, sf):
        """Set algebra on bitmaps, and back to ids."""
        a, b, _ = _sets(spark, sf)
        return idsets.from_bitmap(idsets.bitmap_combine(operator, idsets.as_bitmap(a), idsets.as_bitmap(b)))


for _operator, _sql in (("or", "UNION"), ("and", "INTERSECT"), ("not", "EXCEPT")):
    _add_bitmaps(_operator, _sql)


@query("SELECT DISTINCT l_orderkey * 1000 - 5000000 AS id FROM lineitem")
def bitmap_round_trip(spark, sf):
    """Ids below and above zero to bitmaps and back."""
    return idsets.from_bitmap(idsets.as_bitmap(table(spark, sf, "lineitem").select((F.col("l_orderkey") * 1000 - 5_000_000).alias("id"))))


@query("SELECT range AS id FROM range(5, (SELECT count(*) FROM orders))")
def id_range(spark, sf):
    """Every row id of a table from the fifth on."""
    return idsets.id_range(spark, 5, table(spark, sf, "orders").count() - 5)


@query("SELECT c_mktsegment, c_nationkey, min(c_custkey) AS c_custkey FROM customer WHERE c_acctbal < 0 OR c_nationkey < 5 GROUP BY c_mktsegment, c_nationkey")
def merge_records(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    a, b = (customer.where(x).drop("c_acctbal") for x in ("c_acctbal < 0", "c_nationkey < 5"))
    return idsets.merge_records(a, b, ["c_mktsegment", "c_nationkey"], "c_custkey")


_LOOKUP = """WITH k AS (SELECT o_totalprice AS key, min(o_orderkey) AS rid FROM orders GROUP BY 1), t AS (SELECT DISTINCT l_extendedprice AS target FROM lineitem)"""
_TEXT = """WITH k AS (SELECT p_name AS key, min(p_partkey) AS rid FROM part GROUP BY 1), t AS (SELECT DISTINCT lower(n_name) AS target FROM nation UNION SELECT p_name || 'x' FROM part UNION SELECT p_name FROM part)"""
_FOUND = "SELECT target, rid FROM t {join} JOIN k ON target {sign} key"
_TURNED = {"exact": "=", "last_before": ">", "first_after": "<", "exact_or_before": ">=", "exact_or_after": "<="}


def _found_sql(mode: str) -> str:
    return _FOUND.format(join="LEFT" if mode == "exact" else "ASOF LEFT", sign=_TURNED[mode])


def _add_lookups(mode: str) -> None:
    @query(f"{_LOOKUP} {_found_sql(mode)}", f"lookup_{mode}")
    def number(spark, sf):
        """The order with the price next to each line's price."""
        keys = table(spark, sf, "orders").select(F.col("o_totalprice").alias("key"), F.col("o_orderkey").alias("rid"))
        return lookups.lookup_many(keys, "key", "rid", table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("target")), "target", mode)

    @query(f"{_TEXT} {_found_sql(mode)}", f"lookup_text_{mode}")
    def text(spark, sf):
        part = table(spark, sf, "part")
        targets = table(spark, sf, "nation").select(F.lower("n_name").alias("target")).union(part.select(F.explode(F.array("p_name", F.concat("p_name", F.lit("x"))))))
        return lookups.lookup_many(part.select("p_name", F.col("p_partkey").alias("rid")), "p_name", "rid", targets, "target", mode)


for _mode in lookups.MODES:
    _add_lookups(_mode)


#: All order numbers and names, with targets between, below and above the keys.
_ALL = """WITH k AS (SELECT o_orderkey::DOUBLE AS key, min(o_orderkey) AS rid FROM orders GROUP BY 1),
  x AS (SELECT l_orderkey::DOUBLE AS l FROM lineitem UNION SELECT key FROM k), t AS (SELECT l AS target FROM x UNION SELECT l + 0.5 FROM x UNION SELECT l - 0.5 FROM x)"""
_ALL_TEXT = """WITH k AS (SELECT p_name AS key, min(p_partkey) AS rid FROM part GROUP BY 1),
  t AS (SELECT p_name AS target FROM part UNION SELECT p_name || ' ' FROM part UNION SELECT lower(n_name) FROM nation UNION SELECT '!' UNION SELECT '~')"""

def _add_whole_lookups(mode: str) -> None:
    found = _found_sql(mode)

    @query(f"{_ALL} {found}", f"lookup_all_{mode}")
    def number(spark, sf):
        key = F.col("o_orderkey").cast("double")
        keys = table(spark, sf, "orders").select(key.alias("key"), F.col("o_orderkey").alias("rid"))
        x = F.col("l_orderkey").cast("double")
        wanted = table(spark, sf, "lineitem").select("l_orderkey").union(keys.select("rid")).distinct()
        targets = wanted.select(F.explode(F.array(x - 0.5, x, x + 0.5)).alias("target"))
        return lookups.lookup_many(keys, "key", "rid", targets, "target", mode)

    @query(f"{_ALL_TEXT} {found}", f"lookup_all_text_{mode}")
    def text(spark, sf):
        part = table(spark, sf, "part").select("p_name", F.col("p_partkey").alias("rid"))
        targets = part.select(F.explode(F.array("p_name", F.concat("p_name", F.lit(" ")))).alias("target"))
        targets = targets.union(table(spark, sf, "nation").select(F.lower("n_name"))).union(spark.createDataFrame([("!",), ("~",)], "target string"))
        return lookups.lookup_many(part, "p_name", "rid", targets, "target", mode)


for _mode in lookups.MODES:
    _add_whole_lookups(_mode)


@query("""SELECT 'exact' AS mode, o_orderkey AS rid FROM orders WHERE o_orderkey = 1000 UNION ALL
  SELECT 'last_before', max(o_orderkey) FROM orders WHERE o_orderkey < 1000 UNION ALL SELECT 'first_after', min(o_orderkey) FROM orders WHERE o_orderkey > 1000 UNION ALL
  SELECT 'exact_or_before', max(o_orderkey) FROM orders WHERE o_orderkey <= 1000 UNION ALL SELECT 'exact_or_after', min(o_orderkey) FROM orders WHERE o_orderkey >= 1000""")
def lookup_one(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("rid"))
    found = [lookups.lookup(orders, "key", "rid", 1000, m).select(F.lit(m).alias("mode"), "rid") for m in lookups.MODES]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("SELECT p_partkey, p_size, p_name, row_number() OVER (ORDER BY p_size DESC, p_name ASC, p_partkey) - 1 AS pos FROM part")
def sort_chain_desc(spark, sf):
    keys = order.chain(("p_size", True), ("p_name", False), reverse=True, rid="p_partkey")
    return order.numbered(table(spark, sf, "part").select("p_partkey", "p_size", "p_name"), keys)


_LINES = "SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem"


def _line_pages(spark, sf):
    keys = [F.col("l_extendedprice").desc(), *(F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))]
    return order.paged(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), keys)


@query(f"SELECT * FROM ({_LINES}) WHERE pos BETWEEN (SELECT count(*) // 2 FROM lineitem) AND (SELECT count(*) // 2 + 49 FROM lineitem)")
def page_in_the_middle(spark, sf):
    """A late page of all lines: only the ranges that hold it are sorted."""
    held = _line_pages(spark, sf)
    return order.page_at(held, held.total // 2, 50).select("l_orderkey", "l_linenumber", "l_extendedprice", "pos")


@query("""SELECT l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, lag(l_quantity) OVER w AS a, lag(l_quantity, 2) OVER w AS b, lead(l_quantity) OVER w AS c FROM lineitem WINDOW w AS (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey))
  WHERE l_quantity > a AND l_quantity > c AND (b IS NULL OR b <= a)""")
def filter_by_neighbours(spark, sf):
    """Lines that stand out from those shipped before and after them."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    keys = [F.col(c).asc() for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    near = order.with_neighbours(rows, keys, ["l_quantity"], before=2, after=1)
    a, b, c, own = (F.col(f"l_quantity{k}") for k in ("_m1", "_m2", "_p1", ""))
    return near.where((own > a) & (own > c) & (b.isNull() | (b <= a))).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("""SELECT o_orderkey, c_name, row_number() OVER (ORDER BY c_name DESC, o_orderkey) - 1 AS pos FROM orders JOIN customer ON o_custkey = c_custkey""")
def sort_via_link(spark, sf):
    """All orders by the name of their customer."""
    linked = order.through_link(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf, "customer"), "c_custkey", "c_name", "c_name")
    return order.numbered(linked, order.chain(("c_name", False), rid="o_orderkey")).select("o_orderkey", "c_name", "pos")


@query("SELECT c_custkey, n_name, row_number() OVER (ORDER BY n_name DESC NULLS LAST, c_custkey) - 1 AS pos FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def sort_via_link_all(spark, sf):
    linked = order.through_link(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(spark, sf, "nation"), "n_nationkey", "n_name", "n_name")
    return order.numbered(linked, order.chain(("n_name", False), rid="c_custkey")).select("c_custkey", "n_name", "pos")


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 3 = 0 AND regexp_matches(p_name, 'a.*a')")
def hook_filter(spark, sf):
    """Records that a caller's function keeps."""

    def check(batch):
        import pyarrow.compute as pc

        sizes = pc.cast(batch.column("p_size"), "int64")
        whole = pc.equal(pc.subtract(sizes, pc.multiply(pc.divide(sizes, 3), 3)), 0)
        return pc.and_(whole, pc.match_substring_regex(batch.column("p_name"), "a.*a"))

    return hooks.keep_records(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), check).select("p_partkey", "p_name")


@query("""WITH a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS r FROM customer WHERE c_acctbal < 5000),
  b AS (SELECT id, row_number() OVER (ORDER BY n, id) - 1 AS r FROM (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1))
  SELECT coalesce(a.id, b.id) AS id, coalesce(least(a.r, b.r), a.r, b.r) AS best, (a.id IS NOT NULL)::INTEGER + (b.id IS NOT NULL)::INTEGER AS held FROM a FULL JOIN b ON a.id = b.id""")
def hook_merge(spark, sf):
    """Two ranked sets, merged by a caller's function of ranks and matches."""

    def compute(batch):
        import pyarrow.compute as pc

        best = pc.min_element_wise(batch.column("rank0"), batch.column("rank1"))
        return [best, pc.add(*(pc.cast(batch.column(f"match{k}"), "int32") for k in (0, 1)))]

    a = table(spark, sf, "customer").where("c_acctbal < 5000").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("by"))
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("by"))
    return hooks.merge_with([a, b], "by", compute, "best long, held int")


@query("SELECT page_id, octet_length(encode(html)) AS n_bytes, md5(translate(html, 'abcdefghijklmnopqrstuvwxyz', 'bcdefghijklmnopqrstuvwxyza')) AS digest FROM pages")
def hook_blobs(spark, sf):
    """Byte strings put through a caller's function."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    turned = bytes.maketrans(letters.encode(), (letters[1:] + letters[0]).encode())
    blobs = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("data"))
    out = hooks.change_blobs(blobs, "data", lambda data: data.translate(turned))
    return out.select("page_id", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"))


@query("SELECT r_name AS section, n_name AS key, n_nationkey AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def settings_read(spark, sf):
    """Nations written as sections of pairs, a file for each region, and read
    back by the data source."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    pair = F.concat(F.lit("  "), "n_name", F.lit(" = "), "n_nationkey", F.lit("  // note"))
    text = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.collect_list(pair), "\n").alias("body"))
    path = f"{shared_folder(spark)}/settings-{uuid.uuid4().hex}"
    text.select(F.concat(F.lit("[ "), "r_name", F.lit(" ]\nno pair\n"), "body").alias("value"), "r_name").write.partitionBy("r_name").text(path)
    found = open_table(spark, f"settings:{path}")
    return found.select("section", "key", F.col("value").cast("int").alias("value"))
