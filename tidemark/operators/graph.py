"""Supply-graph reach, closure counts, edge typing and subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import row_numbers
from tidemark.session import cut_lineage


def distinct_edges(edges: DataFrame) -> DataFrame:
    """U4: one row per (src, dst, commodity); no commodity equals an empty one."""
    return edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(
        "src", "dst", F.coalesce("commodity", F.lit("")).alias("commodity")
    ).distinct()


WIDTH = 64


def _numbered(names: DataFrame, name: str) -> DataFrame:
    """(name, word, bit): distinct names, each a bit of a word of 64."""
    numbered = cut_lineage(row_numbers(names.select(name).filter(F.col(name).isNotNull()).distinct(), [], [F.col(name).asc()], "no"))
    place = F.col("no") - 1
    return numbered.select(name, F.floor(place / WIDTH).alias("word"), (place % WIDTH).cast("int").alias("at")).withColumn("bit", F.expr("shiftleft(1L, at)"))


def _advance(frontier: DataFrame, hops: DataFrame, visited: DataFrame | None) -> DataFrame:
    """(node, word, bits): who reaches a node one hop on for the first time. Bits of a node are merged before and after the shuffle."""
    moved = frontier.join(hops, "node").groupBy(F.col("next").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
    if visited is not None:
        known = visited.groupBy("node", "word").agg(F.bit_or("bits").alias("known"))
        moved = moved.join(known, ["node", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0))))).drop("known")
    return cut_lineage(moved.filter(F.col("bits") != 0))


def reach(edges: DataFrame, start: DataFrame, direction: str, max_depth: int) -> DataFrame:
    """G1: (start, node, depth) for nodes within ``max_depth`` hops, least depth, cycle safe.

    ``start`` is (start); all starts advance together, 64 of them as the bits of one number per node: a round joins the
    frontier to the edges, ors the bits per node and takes off those that have been there. Pairs of a start and a node
    are written out once, at the end. The frontier is stored every round, so plans do not grow with depth.
    """
    src, dst = ("src", "dst") if direction == "downstream" else ("dst", "src")
    hops = cut_lineage(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct())
    numbers = _numbered(start, "start")
    frontier = numbers.select(F.col("start").alias("node"), "word", F.col("bit").alias("bits"))
    visited, levels = frontier, []
    for depth in range(1, max_depth + 1):
        frontier = _advance(frontier, hops, visited)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    if not levels:
        return numbers.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).filter(F.lit(False))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    bits = F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.getbit("bits", i) == 1)
    pairs = found.select("node", "depth", "word", F.explode(bits).alias("at"))
    return pairs.join(numbers.select("start", "word", "at"), ["word", "at"]).select("start", "node", "depth")


def reach_counts(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Per node, how many other target nodes it supplies directly or through others.

    Walks backwards from the targets only, 64 of them as the bits of one number per node, and counts bits: no pair of a
    node and a target is ever a row. Rounds end when no bit is new, however long the chains are.
    """
    back = cut_lineage(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct())
    numbers = _numbered(targets, "node")
    frontier = numbers.select("node", "word", F.col("bit").alias("bits"))
    visited = None
    while True:
        frontier = _advance(frontier, back, visited)
        if frontier.isEmpty():
            break
        visited = frontier if visited is None else visited.unionByName(frontier)
    if visited is None:
        return numbers.select("node", F.lit(0).cast("long").alias("n")).filter(F.lit(False))
    # a node on a cycle reaches itself, which does not count
    own = numbers.select("node", "word", F.col("bit").alias("own"))
    counted = visited.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")).join(own, ["node", "word"], "left")
    others = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("own", F.lit(0)))))
    return counted.groupBy("node").agg(F.sum(others).alias("n")).filter(F.col("n") > 0)


def typed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, kind, dst) statements; edges with an unknown endpoint are dropped."""
    known = nodes.select("id").distinct()
    kept = edges.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(
        known.select(F.col("id").alias("dst")), "dst", "left_semi"
    )
    kind = F.coalesce(F.nullif("role_kind", F.lit("")), F.lit("supplies"))
    commodity = F.nullif("commodity", F.lit(""))
    ships = F.when(kind.isin("supplies", "suppliesCommodity"), F.struct(F.lit("supplies").alias("kind"), F.col("dst")))
    carries = F.when(
        kind.isin("suppliesCommodity", "dependsOnCommodity") & commodity.isNotNull(),
        F.struct(kind.alias("kind"), commodity.alias("dst")),
    )
    return (
        kept.select("src", F.explode(F.array_compact(F.array(ships, carries))).alias("s"))
        .select("src", "s.kind", "s.dst")
        .distinct()
    )


def company_graph(universe: DataFrame, role_map: DataFrame, region_map: DataFrame) -> DataFrame:
    """(subject, predicate, object) statements from the universe.

    Company attributes come from a ticker's first row; every row adds a role with its
    exposure and region. ``role_map`` is (segment, role_class), ``region_map``
    (exchange, region).
    """
    role_id = F.concat_ws("_", "ticker", F.coalesce("role_class", "segment"))
    rows = (
        universe.join(role_map, "segment", "left")
        .join(region_map, "exchange", "left")
        .withColumn("role", role_id)
    )
    first = (
        universe.groupBy("ticker")
        .agg(F.min_by(F.struct("exchange", "name", "mcap"), "row_no").alias("r"))
        .select("ticker", "r.*")
    )

    def statements(df: DataFrame, subject: str, pairs: list[tuple[str, str]]) -> DataFrame:
        items = F.array(
            *[F.struct(F.lit(p).alias("predicate"), F.col(c).cast("string").alias("object")) for p, c in pairs]
        )
        return (
            df.select(F.col(subject).alias("subject"), F.explode(items).alias("s"))
            .select("subject", "s.predicate", "s.object")
            .filter(F.col("object").isNotNull())
        )

    companies = statements(first, "ticker", [("hasExchange", "exchange"), ("hasName", "name")])
    plays = statements(rows, "ticker", [("playsRole", "role")])
    roles = statements(
        rows.withColumn("role_class", F.coalesce("role_class", F.lit("Role"))),
        "role",
        [("type", "role_class"), ("operatesIn", "region")],
    )
    return companies.unionByName(plays).unionByName(roles).distinct()


def induced_subgraph(nodes: DataFrame, edges: DataFrame, sectors: list[str]) -> DataFrame:
    """Distinct (src, dst) edges whose ends both lie in the chosen sectors."""
    chosen = nodes.filter(F.col("sector").isin(*sectors)) if sectors else nodes
    ids = chosen.select("id").distinct()
    return (
        edges.select("src", "dst")
        .distinct()
        .join(ids.select(F.col("id").alias("src")), "src", "left_semi")
        .join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    )


def search_nodes(nodes: DataFrame, q: str) -> DataFrame:
    """Nodes whose id, label, sector or any company contains the query."""
    needle = q.strip().lower()
    if not needle:
        return nodes
    has = lambda c: F.lower(c).contains(needle)
    return nodes.filter(
        has(F.col("id"))
        | has(F.coalesce("label", F.lit("")))
        | has(F.col("sector"))
        | F.exists(F.coalesce("companies", F.array().cast("array<string>")), has)
    )


def role_mates(roles: DataFrame, company: str) -> DataFrame:
    """Companies that play a role class the given company plays.

    The company's classes are a semi-join filter, so no pairs inside a class are formed.
    """
    mine = roles.filter(F.col("company") == company).select("class").distinct()
    return roles.join(mine, "class", "left_semi").filter(F.col("company") != company).select("company").distinct()
