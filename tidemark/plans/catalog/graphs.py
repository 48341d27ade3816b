"""Supply-graph and role queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import geo as GE
from tidemark.operators import graph as G
from tidemark.operators import reads as Q
from tidemark.oracles.views import check
from tidemark.plans import fixtures as V
from tidemark.plans import store
from tidemark.plans.catalog.common import big
from tidemark.plans.registry import query


def _brand_starts(spark, sf_dir):
    return V.segments(spark, sf_dir).select(F.concat(F.lit("B:"), F.col("segment")).alias("start"))


def _reach_sql(src: str, dst: str) -> str:
    return f"""SELECT start, node, CAST(MIN(depth) AS BIGINT) AS depth FROM r WHERE depth > 0 AND node <> start GROUP BY ALL""", f"""
        SELECT 'B:' || segment AS start, 'B:' || segment AS node, 0 AS depth FROM segdim
        UNION SELECT r.start, e.{dst}, r.depth + 1 FROM r JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.{src} = r.node WHERE r.depth < 3"""


def _reach_check(src: str, dst: str) -> str:
    final, step = _reach_sql(src, dst)
    base = check("", "edges", "segdim").rstrip()
    return f"{base},\nr(start, node, depth) AS ({step})\n{final}"


@query("g1_reach_downstream", _reach_check("src", "dst"))
def reach_downstream(spark, sf_dir):
    df = G.reach(store.graph_edges(spark, sf_dir), _brand_starts(spark, sf_dir), "downstream", 3)
    return df.select("start", "node", big("depth"))


@query("g1_reach_upstream", _reach_check("dst", "src"))
def reach_upstream(spark, sf_dir):
    df = G.reach(store.graph_edges(spark, sf_dir), _brand_starts(spark, sf_dir), "upstream", 3)
    return df.select("start", "node", big("depth"))


_COUNTS = (
    check("", "edges").rstrip()
    + """,
      r(node, target) AS (SELECT src, dst FROM edges WHERE dst LIKE 'R:%' UNION SELECT e.src, r.target FROM r JOIN edges e ON e.dst = r.node)
      SELECT node, CAST(COUNT(DISTINCT target) AS BIGINT) AS n FROM r WHERE node <> target GROUP BY ALL"""
)


@query("g2_reach_counts", _COUNTS)
def reach_counts(spark, sf_dir):
    edges = store.graph_edges(spark, sf_dir)
    targets = edges.filter(F.col("dst").startswith("R:")).select(F.col("dst").alias("node")).distinct()
    return G.reach_counts(edges, targets)


_MIXED = """SELECT src, dst, commodity, CASE WHEN dst LIKE 'R:%' THEN 'dependsOnCommodity' ELSE role_kind END AS role_kind,
                   CASE WHEN dst LIKE 'R:%' THEN 'land' ELSE commodity END AS com FROM edges WHERE src <> 'N:NATION_7'"""


@query(
    "g3_typed_edges",
    check(
        f"""WITH e AS ({_MIXED}), known AS (SELECT 'S:' || s_suppkey AS id FROM supplier UNION SELECT 'B:' || p_brand FROM part WHERE p_brand <> 'Brand#3' UNION SELECT 'N:' || n_name FROM nation UNION SELECT 'R:' || r_name FROM region),
                 k AS (SELECT * FROM e WHERE src IN (SELECT id FROM known) AND dst IN (SELECT id FROM known))
            SELECT DISTINCT src, 'supplies' AS kind, dst FROM k WHERE role_kind IN ('supplies', 'suppliesCommodity')
            UNION ALL SELECT DISTINCT src, role_kind, com FROM k WHERE role_kind IN ('suppliesCommodity', 'dependsOnCommodity') AND com IS NOT NULL""",
        "edges",
    ).replace(")\nWITH e AS", "),\ne AS"),
)
def typed_edges(spark, sf_dir):
    to_region = F.col("dst").startswith("R:")
    edges = (
        store.graph_edges(spark, sf_dir)
        .filter(F.col("src") != "N:NATION_7")
        .withColumn("role_kind", F.when(to_region, "dependsOnCommodity").otherwise(F.col("role_kind")))
        .withColumn("commodity", F.when(to_region, "land").otherwise(F.col("commodity")))
    )
    ids = V.graph_nodes(spark, sf_dir).filter(F.col("id") != "B:Brand#3")
    return G.typed_edges(ids, edges)


@query(
    "g4_company_graph",
    check(
        """WITH f AS (SELECT ticker, arg_min(exchange, row_no) AS x, arg_min(name, row_no) AS nm FROM universe GROUP BY 1),
                u AS (SELECT universe.*, CASE WHEN seg_no % 4 = 0 THEN NULL ELSE profile END AS cls FROM universe JOIN segdim USING (segment))
           SELECT ticker AS subject, 'hasExchange' AS predicate, x AS object FROM f UNION SELECT ticker, 'hasName', nm FROM f
           UNION SELECT ticker, 'playsRole', ticker || '_' || coalesce(cls, segment) FROM u
           UNION SELECT ticker || '_' || coalesce(cls, segment), 'type', coalesce(cls, 'Role') FROM u
           UNION SELECT ticker || '_' || coalesce(cls, segment), 'operatesIn', region FROM u""",
        "universe",
        "segdim",
    ).replace(")\nWITH f AS", "),\nf AS"),
)
def company_graph(spark, sf_dir):
    uni = store.universe(spark, sf_dir).drop("region")
    roles = V.segments(spark, sf_dir).filter(F.col("seg_no") % 4 != 0).select("segment", F.col("profile").alias("role_class"))
    regions = V.supplier_geo(spark, sf_dir).select(F.col("nation").alias("exchange"), "region").distinct()
    return G.company_graph(uni, roles, regions)


@query(
    "g5_induced_subgraph",
    check("SELECT DISTINCT src, dst FROM edges WHERE (src LIKE 'B:%' OR src LIKE 'N:%') AND (dst LIKE 'B:%' OR dst LIKE 'N:%')", "edges"),
)
def induced_subgraph(spark, sf_dir):
    return G.induced_subgraph(V.graph_nodes(spark, sf_dir), store.graph_edges(spark, sf_dir), ["BrandSector", "NationSector"])


@query(
    "g5_search_nodes",
    check(
        """SELECT id, sector FROM nodes WHERE lower(id) LIKE '%01%' OR lower(label) LIKE '%01%' OR lower(sector) LIKE '%01%'
             OR len(list_filter(companies, lambda c: lower(c) LIKE '%01%')) > 0""",
        "nodes",
    ),
)
def search_nodes(spark, sf_dir):
    return G.search_nodes(V.graph_nodes(spark, sf_dir), " 01 ").select("id", "sector")


@query("u4_distinct_edges", check("SELECT DISTINCT src, dst, coalesce(commodity, '') AS commodity FROM edges", "edges"))
def distinct_edges(spark, sf_dir):
    edges = store.graph_edges(spark, sf_dir).select("src", "dst", "commodity")
    return G.distinct_edges(edges.unionByName(edges))


def _roles(spark, sf_dir):
    return store.universe(spark, sf_dir).join(V.segments(spark, sf_dir), "segment").select(
        F.col("ticker").alias("company"), F.col("profile").alias("class"), F.concat_ws("_", "ticker", "profile").alias("role"), "region", "segment", "name"
    )


@query(
    "j16_role_mates",
    check(
        """SELECT DISTINCT o.ticker AS company FROM (SELECT ticker, profile FROM universe JOIN segdim USING (segment)) o
           JOIN (SELECT ticker, profile FROM universe JOIN segdim USING (segment) WHERE ticker = '3') m USING (profile) WHERE o.ticker <> '3'""",
        "universe",
        "segdim",
    ),
)
def role_mates(spark, sf_dir):
    return G.role_mates(_roles(spark, sf_dir), "3")


@query(
    "a25_regions_per_role",
    check(
        "SELECT profile AS role, CAST(COUNT(DISTINCT region) AS BIGINT) AS n FROM universe JOIN segdim USING (segment) GROUP BY ALL", "universe", "segdim"
    ),
)
def regions_per_role(spark, sf_dir):
    roles = _roles(spark, sf_dir).select(F.col("class").alias("role"), "region")
    return GE.regions_per_role(roles).select("role", big("n"))


@query(
    "a26_missing_attribute",
    check("SELECT ticker FROM universe GROUP BY ticker HAVING COUNT(*) FILTER (subsegment <> 'sub1') = 0", "universe"),
)
def missing_attribute(spark, sf_dir):
    blank = F.when(F.col("subsegment") == "sub1", " ").otherwise(F.col("subsegment"))
    return Q.missing_attribute(store.universe(spark, sf_dir).withColumn("subsegment", blank), "ticker", "subsegment")


@query(
    "a26_missing_summary",
    check("SELECT CAST(COUNT(DISTINCT ticker) AS BIGINT) AS n, CAST(COUNT(DISTINCT ticker) FILTER (subsegment = 'sub1') AS BIGINT) AS n_missing FROM universe", "universe"),
)
def missing_summary(spark, sf_dir):
    blank = F.when(F.col("subsegment") == "sub1", None).otherwise(F.col("subsegment"))
    return Q.missing_summary(store.universe(spark, sf_dir).withColumn("subsegment", blank), "ticker", "subsegment")
