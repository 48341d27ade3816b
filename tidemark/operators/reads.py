"""Read-side queries over scores, signals, universe and nodes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import HORIZONS
from tidemark.operators.ranks import row_numbers
from tidemark.session import cut_lineage, lanes


def filter_by(df: DataFrame, **eq: object) -> DataFrame:
    """equality filters; None leaves a column alone, a list means membership."""
    for name, value in eq.items():
        if isinstance(value, (list, tuple)):
            df = df.filter(F.col(name).isin(*value))
        elif value is not None:
            df = df.filter(F.col(name) == value)
    return df


def latest_signals(signals: DataFrame, n: int = 50, by: str = "segment") -> DataFrame:
    """Newest n signals of every segment; the rank filter is applied before the shuffle too."""
    order = Window.partitionBy(by).orderBy(F.col("observed_at").desc(), "signal_name", "source_id", F.col("ingested_at").desc())
    return signals.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)


def history_series(
    history: DataFrame, segments: list[str], horizon: str, now: dt.date, months: int = 6
) -> DataFrame:
    """T4: per requested segment its points in time order, in request order."""
    since = now - dt.timedelta(days=30 * months)
    position = F.array_position(F.array(*[F.lit(s) for s in segments]), F.col("segment"))
    point = F.struct("as_of", "b", "b_prime", "regime")
    kept = history.filter(
        F.col("segment").isin(*segments) & (F.col("horizon") == horizon) & (F.col("as_of") >= F.lit(since))
    )
    return (
        kept.groupBy("segment")
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
        .withColumn("position", position)
        .orderBy("position")
    )


def home_lists(scores: DataFrame) -> DataFrame:
    """the three front-page lists in one scan."""
    tag = (
        F.when((F.col("regime") == "EMERGING") & F.col("b").isNotNull(), "proactive_long")
        .when(F.col("regime").isin("RESOLVING", "RESOLVING_FROM_LOW"), "short")
        .when((F.col("regime") == "STABLE") & (F.col("b_prime") > 0), "watch")
    )
    return scores.withColumn("list", tag).filter(F.col("list").isNotNull())


def quadrant(scores: DataFrame) -> DataFrame:
    """T5: regime cell of each segment and its rank by score inside the cell."""
    cell = (
        F.when(F.col("b").isNull(), "bot-mid")
        .when((F.col("regime") == "EMERGING") & (F.col("b") >= 60), "top-left")
        .when(F.col("regime") == "EMERGING", "bot-left")
        .when(F.col("regime").isin("PEAKING", "PEAKED"), "top-mid")
        .when(F.col("regime") == "RESOLVING", "top-right")
        .when(F.col("regime") == "RESOLVING_FROM_LOW", "bot-right")
        .otherwise("bot-mid")
    )
    return row_numbers(scores.withColumn("cell", cell), ["as_of", "cell"], [F.coalesce("b", F.lit(0.0)).desc(), F.col("segment").asc()])


def scoreboard(scores: DataFrame, by: list[str] = ["segment"]) -> DataFrame:  # noqa: B006
    """One row per segment with a column per horizon."""
    wide = scores.groupBy(*by).pivot("horizon", list(HORIZONS)).agg(F.max("b"))
    complete = scores.groupBy(*by).agg(F.min("completeness").alias("completeness"))
    return wide.join(complete, by)


def tickers_by_exposure(universe: DataFrame, segment: str) -> DataFrame:
    """Most exposed first."""
    return universe.filter(F.col("segment") == segment).orderBy(F.col("exposure").desc(), "ticker")


def tickers_with_regime(universe: DataFrame, scores: DataFrame) -> DataFrame:
    """Universe rows with the near-horizon regime of their segment."""
    near = scores.filter(F.col("horizon") == "near").select("segment", "regime", "confidence")
    return universe.filter(F.length("segment") > 0).join(near, "segment", "left")


def search_tickers(
    tickers: DataFrame,
    q: str = "",
    sector: str = "all",
    segment: str | None = None,
    side: str | None = None,
    regime: str | None = None,
    sort: str = "ticker",
    descending: bool = False,
) -> DataFrame:
    """text and attribute filters over ticker rows with title and sector."""
    needle = q.strip().lower()
    if needle:
        hits = [F.lower(c).contains(needle) for c in ("ticker", "name", "title")]
        tickers = tickers.filter(hits[0] | hits[1] | hits[2])
    if sector != "all":
        tickers = tickers.filter(F.regexp_replace("sector", "Sector$", "") == sector)
    if segment:
        tickers = tickers.filter(F.col("segment") == segment)
    if side == "long":
        tickers = tickers.filter(F.coalesce(F.col("regime") != "RESOLVING", F.lit(True)))
    elif side == "short":
        tickers = tickers.filter(F.col("regime") == "RESOLVING")
    if regime:
        tickers = tickers.filter(F.col("regime") == regime)
    order = F.col(sort).desc() if descending else F.col(sort).asc()
    return tickers.orderBy(order, "ticker", "segment")


def with_meta(df: DataFrame, meta: DataFrame, fallback_title: str = "segment") -> DataFrame:
    """Display name, sector and brief of a segment, with defaults."""
    from tidemark.functions.labels import title_of

    return (
        df.join(meta, "segment", "left")
        .withColumn("title", F.coalesce("title", title_of(F.col(fallback_title))))
        .withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
        .withColumn("brief", F.coalesce("brief", F.lit("")))
    )


def map_nodes(nodes: DataFrame, scores: DataFrame, node_map: DataFrame) -> DataFrame:
    """Graph nodes with the near score of the segment they stand for."""
    near = scores.filter(F.col("horizon") == "near").select("segment", "regime", F.col("b").alias("score"), "b_prime")
    return (
        nodes.join(node_map, "id", "left")
        .withColumn("segment", F.coalesce("segment", "id"))
        .join(near, "segment", "left")
    )


def primary_segment(universe: DataFrame) -> DataFrame:
    """A ticker's first universe row names its segment."""
    return (
        universe.groupBy("ticker")
        .agg(F.min_by(F.struct("segment", "subsegment"), "row_no").alias("r"))
        .select("ticker", "r.segment", "r.subsegment")
    )


def attach_primary_segment(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Tickers outside the universe are ``unclassified``."""
    return df.join(primary_segment(universe), "ticker", "left").withColumn(
        "segment", F.coalesce("segment", F.lit("unclassified"))
    )


def in_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows whose ticker is in the universe."""
    return df.join(universe.select("ticker").distinct(), "ticker", "left_semi")


#: Tickers of one set of segments that share a copy of the set's list.
SLICE = 128
#: Companies of one block, and lists that one copy of all blocks should serve at least.
BLOCK, SERVED = 16384, 32


def _company_sets(members: DataFrame) -> DataFrame:
    """(ticker, _set, set_id, slice): tickers with one set of segments are dealt over slices of about ``SLICE``."""
    sets = members.groupBy("ticker").agg(F.array_sort(F.collect_set("segment")).alias("_set"))
    known = sets.withColumn("set_id", F.sha2(F.to_json(F.struct("_set")), 256))
    sizes = known.groupBy("set_id").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices"))
    dealt = known.join(sizes, "set_id")
    return dealt.withColumn("slice", F.pmod(F.xxhash64("ticker"), F.col("slices"))).drop("slices")


def _company_blocks(held: DataFrame) -> DataFrame:
    """(block, names, kinds, sets) of (name, within): all names in order, and for each which of the block's ``sets`` of segments is its own."""
    numbered = row_numbers(held, [], [F.col("name").asc_nulls_last()], "no").withColumn("block", F.floor((F.col("no") - 1) / BLOCK))
    kinds = numbered.withColumn("kind", F.dense_rank().over(Window.partitionBy("block").orderBy("within")) - 1)
    rows = kinds.groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("no", "name", "kind"))).alias("rows"),
        F.array_sort(F.collect_set(F.struct("kind", "within"))).alias("sets"),
    )
    return rows.select("block", F.col("rows.name").alias("names"), F.col("rows.kind").alias("kinds"), F.col("sets.within").alias("sets"))


def _names_in(block: Column, held: Column) -> Column:
    """The block's names that are in any of the segments ``held``; overlaps are found once per set of the block."""
    hits = F.transform(block["sets"], lambda within: F.arrays_overlap(within, held))
    # the array of one binds the overlaps, which would else be found again for every name
    return F.get(F.transform(F.array(hits), lambda hit: F.filter(block["names"], lambda _, i: F.get(hit, F.get(block["kinds"], i)))), F.lit(0))


def _attach_companies(df: DataFrame, sets: DataFrame, nodes: DataFrame, how: str, joined: str | None) -> DataFrame:
    """``df`` (_set, set_id, slice, ...) with ``companies``, found once per set and slice and as the last step.

    A list may be as long as there are companies, so no step holds more than a few at once: lists are read off the
    companies in order, one list at a time, never grouped, exploded or shuffled per ticker, and sorts of lists spill.
    All companies go once to each of a bounded number of lanes, which deal the lists among them.
    """
    named = nodes.filter(F.col("segment").isNotNull()).select("segment", F.explode("companies").alias("name"))
    held = cut_lineage(named.groupBy("name").agg(F.array_sort(F.collect_set("segment")).alias("within")))
    asked = sets.select("set_id", "slice", "_set").distinct()
    listed = held.select(F.explode("within").alias("segment")).distinct()
    some = asked.select("set_id", F.explode("_set").alias("segment")).join(listed, "segment", "left_semi").select("set_id").distinct()
    wanted = cut_lineage(asked.join(some, "set_id", "left_semi"))
    n = max(1, min(lanes(df.sparkSession), -(-wanted.count() // SERVED)))
    copies = _company_blocks(held).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("lane"), F.struct("block", "names", "kinds", "sets").alias("b"))
    # a fixed number of partitions, or small ones are merged and the companies of many lanes meet in a task
    laid = copies.repartition(n, "lane").groupBy("lane").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    names = F.flatten(F.transform("blocks", lambda b: _names_in(b, F.col("_set"))))
    lists = (
        wanted.withColumn("lane", F.pmod(F.xxhash64("set_id", "slice"), F.lit(n)).cast("int"))
        .join(laid.hint("merge"), "lane")
        .select("set_id", "slice", (names if joined is None else F.array_join(names, joined)).alias("companies"))
    )
    # a broadcast of the tickers would leave all slices of a set in the task that listed it
    return df.drop("_set").join(lists.hint("merge"), ["set_id", "slice"], how).drop("set_id", "slice")


def distinct_companies(members: DataFrame, nodes: DataFrame, joined: str | None = None) -> DataFrame:
    """(ticker, companies): the sorted distinct companies over all segments of a ticker; tickers with none are left out.

    Tickers share few sets of segments. Each distinct set gets an id and its companies are merged once; a ticker carries
    only the id, so rows shuffled grow with tickers plus sets, not with tickers times companies. ``joined`` gives the
    list as one string with that separator, formed once per set.
    """
    sets = cut_lineage(_company_sets(members))
    return _attach_companies(sets, sets, nodes, "inner", joined).select("ticker", "companies")


def ticker_detail(
    universe: DataFrame, scores: DataFrame, notes: DataFrame, nodes: DataFrame, eta: DataFrame, joined: str | None = None
) -> DataFrame:
    """One row per ticker with its segments, companies, note count and resolution band.

    Per-ticker lists are as long as its segments; companies are merged once per set of segments and come last, so no
    other join carries them. ``joined`` is that of ``distinct_companies``.
    """
    from tidemark.operators.selection import primary_eta

    near = scores.filter(F.col("horizon") == "near").select("segment", "regime", "b", "b_prime")
    first_rows = universe.groupBy("ticker", "segment").agg(
        F.min_by(F.struct("subsegment", "exposure", "name", "exchange", "row_no"), "row_no").alias("r")
    )
    segments = (
        first_rows.select("ticker", "segment", "r.*")
        .join(near, "segment", "left")
        .groupBy("ticker")
        .agg(
            F.array_sort(F.collect_list(F.struct("row_no", "segment", "exposure", "regime", "b", "b_prime"))).alias(
                "segments"
            ),
            F.min_by("name", "row_no").alias("name"),
            F.min_by("exchange", "row_no").alias("exchange"),
        )
    )
    sets = cut_lineage(_company_sets(first_rows))
    detail = (
        segments.join(sets, "ticker", "left")
        .join(note_counts(notes, "ticker").withColumnRenamed("n", "n_notes"), "ticker", "left")
        .join(primary_eta(universe, eta).select("ticker", "eta", "confidence"), "ticker", "left")
        .withColumn("n_notes", F.coalesce("n_notes", F.lit(0)))
    )
    return _attach_companies(detail, sets, nodes, "left", joined)


def low_live_dates(scores: DataFrame, min_share: float = 0.20) -> DataFrame:
    """Dates on which too few segments have a live score."""
    live = F.avg((F.col("regime") != "NO_DATA").cast("double"))
    return scores.groupBy("t").agg(live.alias("live_share")).filter(F.col("live_share") < min_share)


def health(scores: DataFrame, signals: DataFrame) -> DataFrame:
    """Last score time and signal count."""
    last = scores.agg(F.max("as_of").alias("last_score_at"))
    count = signals.agg(F.count(F.lit(1)).alias("n_signals"))
    return last.join(F.broadcast(count), F.lit(True))


def note_counts(notes: DataFrame, by: str) -> DataFrame:
    """Notes per ticker or segment."""
    return notes.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def missing_attribute(df: DataFrame, key: str, col: str) -> DataFrame:
    """Entities with no value for a required attribute."""
    return df.groupBy(key).agg(F.count_if(F.length(F.trim(F.col(col))) > 0).alias("_have")).filter("_have = 0").select(key)


def missing_summary(df: DataFrame, key: str, col: str) -> DataFrame:
    """How many entities were checked and how many lack the attribute."""
    have = df.groupBy(key).agg(F.count_if(F.length(F.trim(F.col(col))) > 0).alias("_have"))
    return have.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_have") == 0).alias("n_missing"))


def resolution_eta(additions: DataFrame, as_of: str = "as_of") -> DataFrame:
    """Band of a segment's planned additions.

    ``<12mo`` if at least 80 % arrive within a year, else by the median wait.
    """
    months = F.months_between("observed_at", as_of)
    wait = additions.withColumn("_m", months).filter(F.col("_m") >= 0)
    soon = F.avg((F.col("_m") <= 12).cast("double"))
    median = F.percentile("_m", F.lit(0.5))
    return wait.groupBy("segment", as_of).agg(
        F.when(soon >= 0.8, "<12mo").when(median <= 24, "12-24mo").otherwise(">24mo").alias("band"),
        F.count(F.lit(1)).alias("n"),
    )
