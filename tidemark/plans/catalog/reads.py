"""Read-path and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import audit as A
from tidemark.operators import reads as Q
from tidemark.operators import temporal as T
from tidemark.oracles.views import check
from tidemark.plans import fixtures as V
from tidemark.plans import store
from tidemark.plans.catalog.common import big, r6
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources.tables import write_report

_NOW = "mode = 'fixed' AND as_of = DATE '2001-12-01'"


@query(
    "f4_filter_by",
    check("SELECT segment, horizon, as_of, round(b, 6) + 0.0 AS b FROM hist WHERE mode = 'rolling' AND horizon IN ('near', 'long') AND regime = 'EMERGING'", "hist"),
)
def filter_by(spark, sf_dir):
    df = Q.filter_by(store.score_history(spark, sf_dir), mode="rolling", horizon=["near", "long"], regime="EMERGING", segment=None)
    return df.select("segment", "horizon", "as_of", r6("b"))


@query(
    "f13_home_lists",
    check(
        f"""SELECT segment, horizon, CASE regime WHEN 'EMERGING' THEN 'proactive_long' WHEN 'STABLE' THEN 'watch' ELSE 'short' END AS list FROM hist
            WHERE {_NOW} AND (regime IN ('EMERGING', 'RESOLVING', 'RESOLVING_FROM_LOW') OR (regime = 'STABLE' AND b_prime > 0))""",
        "hist",
    ),
)
def home_lists(spark, sf_dir):
    return Q.home_lists(store.scores_on(spark, sf_dir)).select("segment", "horizon", "list")


@query(
    "t3_latest_signals",
    check(
        """SELECT segment, signal_name, source_id, observed_at FROM signals
           QUALIFY row_number() OVER (PARTITION BY segment ORDER BY observed_at DESC, signal_name, source_id, ingested_at DESC) <= 50""",
        "signals",
    ),
)
def latest_signals(spark, sf_dir):
    return Q.latest_signals(store.signals(spark, sf_dir), 50).select("segment", "signal_name", "source_id", "observed_at")


@query(
    "t4_history_series",
    check(
        """SELECT segment, CAST(list_position(['Brand#7', 'Brand#3', 'Brand#21'], segment) AS BIGINT) AS position,
                  string_agg(strftime(as_of, '%Y-%m-%d') || '=' || regime, ',' ORDER BY as_of) AS points
           FROM hist WHERE mode = 'fixed' AND horizon = 'med' AND segment IN ('Brand#7', 'Brand#3', 'Brand#21') AND as_of >= DATE '2001-12-01' - 360 GROUP BY ALL""",
        "hist",
    ),
)
def history_series(spark, sf_dir):
    history = store.score_history(spark, sf_dir).filter("mode = 'fixed'")
    df = Q.history_series(history, ["Brand#7", "Brand#3", "Brand#21"], "med", V.GRID_END, months=12)
    shown = F.transform("points", lambda p: F.concat_ws("=", p["as_of"].cast("string"), p["regime"]))
    return df.select("segment", big("position"), F.array_join(shown, ",").alias("points"))


@query(
    "t5_quadrant",
    check(
        """SELECT as_of, segment, cell, CAST(row_number() OVER (PARTITION BY as_of, cell ORDER BY coalesce(b, 0) DESC, segment) AS BIGINT) AS rank FROM (
             SELECT *, CASE WHEN b IS NULL THEN 'bot-mid' WHEN regime = 'EMERGING' THEN CASE WHEN b >= 60 THEN 'top-left' ELSE 'bot-left' END
                            WHEN regime IN ('PEAKING', 'PEAKED') THEN 'top-mid' WHEN regime = 'RESOLVING' THEN 'top-right'
                            WHEN regime = 'RESOLVING_FROM_LOW' THEN 'bot-right' ELSE 'bot-mid' END AS cell FROM near)""",
        "near",
    ),
)
def quadrant(spark, sf_dir):
    near = store.score_history(spark, sf_dir).filter("mode = 'fixed' AND horizon = 'near'")
    return Q.quadrant(near).select("as_of", "segment", "cell", big("rank"))


@query(
    "t6_tickers_by_exposure",
    check("SELECT ticker, exposure FROM universe WHERE segment = 'Brand#5'", "universe"),
)
def tickers_by_exposure(spark, sf_dir):
    return Q.tickers_by_exposure(store.universe(spark, sf_dir), "Brand#5").select("ticker", "exposure")


@query(
    "t7_scoreboard",
    check(
        """SELECT segment, as_of, round(MAX(b) FILTER (horizon = 'near'), 6) + 0.0 AS near, round(MAX(b) FILTER (horizon = 'med'), 6) + 0.0 AS med,
                  round(MAX(b) FILTER (horizon = 'long'), 6) + 0.0 AS long, round(MIN(completeness), 6) + 0.0 AS completeness FROM hist WHERE mode = 'fixed' GROUP BY ALL""",
        "hist",
    ),
)
def scoreboard(spark, sf_dir):
    history = store.score_history(spark, sf_dir).filter("mode = 'fixed'")
    return Q.scoreboard(history, ["segment", "as_of"]).select("segment", "as_of", *[r6(c) for c in ("near", "med", "long", "completeness")])


@query(
    "j9_tickers_with_regime",
    check(f"SELECT u.ticker, u.segment, h.regime, h.confidence FROM universe u LEFT JOIN (SELECT * FROM hist WHERE horizon = 'near' AND {_NOW}) h USING (segment)", "universe", "hist"),
)
def tickers_with_regime(spark, sf_dir):
    return Q.tickers_with_regime(store.universe(spark, sf_dir), store.scores_on(spark, sf_dir)).select("ticker", "segment", "regime", "confidence")


def _eta(spark, sf_dir):
    return V.segments(spark, sf_dir).withColumn("e", labels.static_eta(F.col("profile"))).select("segment", "e.eta", "e.confidence")


def _node_companies(spark, sf_dir):
    nodes = V.graph_nodes(spark, sf_dir, store.universe(spark, sf_dir)).filter(F.col("id").startswith("B:"))
    return nodes.select(F.substring_index("id", "B:", -1).alias("segment"), "companies")


_ETAS = """CASE profile WHEN 'advanced_node_fabs' THEN '>24mo' WHEN 'data_center_shell' THEN '>24mo' WHEN 'power_generation_oem' THEN '>24mo' WHEN 'transformers_tnd' THEN '>24mo'
           WHEN 'systems_rack_scale' THEN '<12mo' ELSE '12-24mo' END"""


@query(
    "j10_ticker_detail",
    check(
        f"""SELECT s.ticker, s.name, s.segments, s.regimes, c.companies, CAST(coalesce(k.n, 0) AS BIGINT) AS n_notes, e.eta FROM
             (SELECT u.ticker, arg_min(name, row_no) AS name, string_agg(u.segment, ',' ORDER BY row_no) AS segments, string_agg(h.regime, ',' ORDER BY row_no) AS regimes
              FROM universe u LEFT JOIN (SELECT * FROM hist WHERE horizon = 'near' AND {_NOW}) h USING (segment) GROUP BY u.ticker) s
             LEFT JOIN (SELECT ticker, string_agg(x, ',' ORDER BY x) AS companies FROM (SELECT DISTINCT u.ticker, o.name AS x FROM universe u JOIN universe o ON o.segment = u.segment AND o.exposure >= 0.9) GROUP BY 1) c USING (ticker)
             LEFT JOIN (SELECT ticker, COUNT(*) AS n FROM notes GROUP BY 1) k USING (ticker)
             LEFT JOIN (SELECT ticker, arg_max(eta, (exposure, -row_no)) AS eta FROM (SELECT *, {_ETAS} AS eta FROM universe JOIN segdim USING (segment)) GROUP BY 1) e USING (ticker)""",
        "universe", "hist", "notes", "segdim",
    ),
)
def ticker_detail(spark, sf_dir):
    df = Q.ticker_detail(
        store.universe(spark, sf_dir), store.scores_on(spark, sf_dir), V.notes(spark, sf_dir), _node_companies(spark, sf_dir), _eta(spark, sf_dir), joined=","
    )
    return df.select(
        "ticker", "name",
        F.array_join(F.transform("segments", lambda s: s["segment"]), ",").alias("segments"),
        F.array_join(F.transform("segments", lambda s: s["regime"]), ",").alias("regimes"),
        "companies", big("n_notes"), "eta",
    )


@query(
    "u5_distinct_companies",
    check(
        """SELECT ticker, string_agg(x, ',' ORDER BY x) AS companies FROM (SELECT DISTINCT u.ticker, o.name AS x FROM universe u JOIN universe o ON o.segment = u.segment AND o.exposure >= 0.9) GROUP BY 1""",
        "universe",
    ),
)
def distinct_companies(spark, sf_dir):
    found = Q.distinct_companies(store.universe(spark, sf_dir), _node_companies(spark, sf_dir), joined=",")
    return found.select("ticker", "companies")


@query(
    "j11_map_nodes",
    check(
        f"""SELECT n.id, n.sector, h.regime, round(h.b, 6) + 0.0 AS score FROM nodes n
            LEFT JOIN (SELECT * FROM hist WHERE horizon = 'near' AND {_NOW}) h ON n.id = 'B:' || h.segment""",
        "nodes",
        "hist",
    ),
)
def map_nodes(spark, sf_dir):
    node_map = V.segments(spark, sf_dir).select(F.concat(F.lit("B:"), F.col("segment")).alias("id"), "segment")
    return Q.map_nodes(V.graph_nodes(spark, sf_dir), store.scores_on(spark, sf_dir), node_map).select("id", "sector", "regime", r6("score"))


def _meta(spark, sf_dir):
    """Curated names for two thirds of the segments."""
    seg = V.segments(spark, sf_dir).filter(F.col("seg_no") % 3 != 0)
    return seg.select(
        "segment", F.concat(F.lit("The "), F.col("profile")).alias("title"),
        F.when(F.col("seg_no") % 2 == 0, "PowerSector").otherwise("ComputeSector").alias("sector"), F.lit("brief").alias("brief"),
    )


_META = """SELECT segment, CASE WHEN seg_no % 3 <> 0 THEN 'The ' || profile ELSE 'Brand ' || seg_no END AS title,
                  CASE WHEN seg_no % 3 = 0 THEN 'Unknown' WHEN seg_no % 2 = 0 THEN 'PowerSector' ELSE 'ComputeSector' END AS sector,
                  CASE WHEN seg_no % 3 = 0 THEN '' ELSE 'brief' END AS brief FROM segdim"""


@query("x18_segment_meta", check(f"SELECT segment, title, sector, brief FROM ({_META})", "segdim"))
def segment_meta(spark, sf_dir):
    return Q.with_meta(V.segments(spark, sf_dir).select("segment"), _meta(spark, sf_dir)).select("segment", "title", "sector", "brief")


@query(
    "f12_search_tickers",
    check(
        f"""SELECT u.ticker, u.segment, h.regime FROM universe u JOIN ({_META}) m USING (segment) LEFT JOIN (SELECT * FROM hist WHERE horizon = 'near' AND {_NOW}) h USING (segment)
            WHERE (lower(u.ticker) LIKE '%the%' OR lower(u.name) LIKE '%the%' OR lower(m.title) LIKE '%the%') AND m.sector = 'PowerSector' AND coalesce(h.regime <> 'RESOLVING', true)""",
        "universe", "segdim", "hist",
    ),
)
def search_tickers(spark, sf_dir):
    rows = Q.tickers_with_regime(store.universe(spark, sf_dir), store.scores_on(spark, sf_dir)).drop("subsegment")
    return Q.search_tickers(Q.with_meta(rows, _meta(spark, sf_dir)), q="The ", sector="Power", side="long", sort="exposure", descending=True).select("ticker", "segment", "regime")


@query("x20_static_eta", check(f"SELECT segment, {_ETAS} AS eta FROM segdim", "segdim"))
def static_eta(spark, sf_dir):
    return _eta(spark, sf_dir).select("segment", "eta")


@query(
    "x21_resolution_eta",
    check(
        """SELECT segment, as_of, CASE WHEN AVG(CAST(m <= 12 AS INTEGER)) >= 0.8 THEN '<12mo' WHEN median(m) <= 24 THEN '12-24mo' ELSE '>24mo' END AS band, CAST(COUNT(*) AS BIGINT) AS n
           FROM (SELECT segment, as_of, date_diff('month', as_of, observed_at) AS m FROM deduped WHERE signal_name = 'planned_capacity_mw' AND observed_at >= as_of) GROUP BY ALL""",
        "deduped",
    ),
)
def resolution_eta(spark, sf_dir):
    rows = T.dedupe_intervals(T.with_visibility(store.signals(spark, sf_dir).filter(F.col("signal_name") == "planned_capacity_mw")))
    return Q.resolution_eta(T.explode_as_of(rows, V.GRID_START, V.GRID_END)).select("segment", "as_of", "band", big("n"))


@query("a20_health", check("SELECT (SELECT MAX(as_of) FROM hist) AS last_score_at, CAST(COUNT(*) AS BIGINT) AS n_signals FROM signals", "hist", "signals"))
def health(spark, sf_dir):
    return Q.health(store.score_history(spark, sf_dir), store.signals(spark, sf_dir))


@query(
    "a21_note_counts",
    check("SELECT 'ticker' AS by, ticker AS key, CAST(COUNT(*) AS BIGINT) AS n FROM notes GROUP BY ALL UNION ALL SELECT 'segment', segment, CAST(COUNT(*) AS BIGINT) FROM notes GROUP BY ALL", "notes"),
)
def note_counts(spark, sf_dir):
    notes = V.notes(spark, sf_dir)
    side = lambda by: Q.note_counts(notes, by).select(F.lit(by).alias("by"), F.col(by).alias("key"), "n")
    return side("ticker").unionByName(side("segment"))


def _diverged(spark, sf_dir):
    return A.divergences(store.subscores(spark, sf_dir), ["segment", "as_of"])


_DIV = """SELECT segment, as_of, sub_score, value, seed_value FROM subs WHERE mode = 'fixed'
          AND sub_score IN ('lead_time_growth', 'geo_concentration', 'demand_signal') AND abs(value - seed_value) > 0.2::DOUBLE"""


@query(
    "x14_divergences",
    check(f"SELECT segment, as_of, string_agg(sub_score, ',' ORDER BY sub_score) AS names, CAST(COUNT(*) AS BIGINT) AS n, round(MAX(value - seed_value), 6) + 0.0 AS widest FROM ({_DIV}) GROUP BY ALL", "subs"),
)
def divergences(spark, sf_dir):
    d = _diverged(spark, sf_dir)
    return d.select(
        "segment", "as_of", F.array_join(F.transform("divergences", lambda e: e["sub_score"]), ",").alias("names"),
        big(F.size("divergences"), "n"), r6(F.array_max(F.transform("divergences", lambda e: e["gap"])), "widest"),
    )


@query(
    "f11_flag_interesting",
    check(
        f"""SELECT h.segment, h.horizon, d.segment IS NOT NULL OR abs(h.b_prime) > 5 OR p.segment IS NULL OR coalesce(abs(h.b - p.b) > 5, false) AS interesting
            FROM (SELECT * FROM hist WHERE {_NOW}) h
            LEFT JOIN (SELECT segment, horizon, arg_max(b, as_of) AS b FROM hist WHERE mode = 'fixed' AND as_of < DATE '2001-12-01' GROUP BY ALL) p ON p.segment = h.segment AND p.horizon = h.horizon
            LEFT JOIN (SELECT DISTINCT segment FROM ({_DIV}) WHERE as_of = DATE '2001-12-01') d ON d.segment = h.segment""",
        "hist",
        "subs",
    ),
)
def flag_interesting(spark, sf_dir):
    history = store.score_history(spark, sf_dir).filter("mode = 'fixed'")
    today = history.filter(F.col("as_of") == F.lit(V.GRID_END))
    diverged = _diverged(spark, sf_dir).filter(F.col("as_of") == F.lit(V.GRID_END))
    return A.flag_interesting(today, T.previous_score(history, V.GRID_END), diverged).select("segment", "horizon", "interesting")


@query(
    "s28_divergence_report",
    check(f"SELECT segment || ':' || strftime(as_of, '%Y-%m-%d') AS key, CAST(COUNT(*) AS BIGINT) AS n FROM ({_DIV}) GROUP BY ALL", "subs"),
)
def divergence_report(spark, sf_dir):
    """Written as JSON and read back with an explicit schema."""
    path = scratch_path(spark, "report")
    rows = A.divergence_report(_diverged(spark, sf_dir).withColumn("horizon", F.col("as_of").cast("string")))
    write_report({"divergences": rows}, path)
    back = spark.read.schema("key string, payload string").json(f"{path}/divergences")
    entries = F.from_json("payload", "array<struct<sub_score: string, seed: double, dynamic: double, gap: double>>")
    return back.select("key", big(F.size(entries), "n"))


@query(
    "a24_run_counts",
    check(
        """SELECT CASE WHEN abs(b_prime) > 50 THEN 'rejected' WHEN abs(b_prime) > 5 THEN 'llm' WHEN b < 10 THEN 'error' ELSE 'machine' END AS generated_by, CAST(COUNT(*) AS BIGINT) AS n
           FROM hist WHERE mode = 'fixed' GROUP BY ALL""",
        "hist",
    ),
)
def run_counts(spark, sf_dir):
    how = F.when(F.abs("b_prime") > 50, "rejected").when(F.abs("b_prime") > 5, "llm").when(F.col("b") < 10, "error").otherwise("machine")
    snapshots = store.score_history(spark, sf_dir).filter("mode = 'fixed'").select(how.alias("generated_by"))
    return A.run_counts(snapshots)


_CLAIMS = r"""t AS (SELECT doc_id, 'Brand#' || (doc_id % 25 + 1) AS segment, regexp_replace(text, '(^|[^\p{L}\p{N}_])[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?', '\1 ', 'g') AS x FROM documents),
    r AS (SELECT doc_id, segment, pos, rtrim(tok, '%') AS body, tok LIKE '%\%' ESCAPE '\' AS pct FROM (
            SELECT doc_id, segment, unnest(regexp_extract_all(x, '((?:(?:^|[^\p{L}\p{M}\p{N}_.])-)?[\p{L}\p{M}\p{N}_.]+%?)', 1)) AS tok,
                   generate_subscripts(regexp_extract_all(x, '((?:(?:^|[^\p{L}\p{M}\p{N}_.])-)?[\p{L}\p{M}\p{N}_.]+%?)', 1), 1) AS pos FROM t)),
    n AS (SELECT doc_id, segment, pct, CAST(regexp_extract(regexp_replace(body, '^[^-0-9]+', ''), '^(-?[0-9]+(\.[0-9]+)?)', 1) AS DOUBLE) AS v
          FROM r WHERE regexp_full_match(body, '(?s)(.?-)?[0-9]+(\.[0-9]+)?(\.(\..*)?)?'))"""
_SHOWN = "SELECT * FROM signals WHERE observed_at <= DATE '2001-12-01' QUALIFY row_number() OVER (PARTITION BY segment ORDER BY observed_at DESC, signal_name, source_id, ingested_at DESC) <= 50"
_KNOWN = f"""known AS (
    SELECT segment, b AS k FROM hist WHERE {_NOW} AND horizon = 'near' UNION SELECT segment, b_prime FROM hist WHERE {_NOW} AND horizon = 'near'
    UNION SELECT segment, arg_max(b, as_of) FROM hist WHERE mode = 'fixed' AND horizon = 'near' AND as_of < DATE '2001-12-01' GROUP BY segment
    UNION SELECT segment, value FROM subs WHERE {_NOW} UNION SELECT segment, seed_value FROM seed
    UNION SELECT segment, unnest([seed_value, value, value - seed_value]) FROM ({_DIV}) WHERE as_of = DATE '2001-12-01'
    UNION SELECT segment, unnest([value_num, CAST(year(observed_at) AS DOUBLE), CAST(month(observed_at) AS DOUBLE)]) FROM ({_SHOWN})),
    lists AS (SELECT segment, list(k) AS ks FROM known WHERE k IS NOT NULL GROUP BY segment)"""


@query(
    "x16_grounding_set",
    check(
        f"""SELECT * FROM (WITH {_CLAIMS}, {_KNOWN}, g AS (SELECT n.*, [v] || CASE WHEN pct THEN [v / 100] ELSE [] END AS c, coalesce(ks, []) AS ks FROM n LEFT JOIN lists USING (segment))
            SELECT doc_id, segment, min(v) AS low, max(v) AS high, CAST(COUNT(*) AS BIGINT) AS n FROM g
            WHERE NOT coalesce(list_bool_or(flatten(list_transform(c, lambda a: list_transform(ks, lambda b: abs(a - b) <= greatest(0.05, 0.02 * abs(b)))))), false)
            GROUP BY doc_id, segment)""",
        "hist", "subs", "seed", "signals",
    ),
)
def grounding_set(spark, sf_dir):
    """Numbers of each document that nothing known of its segment backs; the set is built from the stored tables."""
    history = store.score_history(spark, sf_dir).filter("mode = 'fixed' AND horizon = 'near'")
    now = F.col("as_of") == F.lit(V.GRID_END)
    subs = store.subscores(spark, sf_dir).filter(now)
    shown = Q.latest_signals(store.signals(spark, sf_dir).filter(F.col("observed_at") <= F.lit(V.GRID_END)), 50)
    known = A.grounding_values(
        history.filter(now), T.previous_score(history, V.GRID_END), subs, V.seed(spark, sf_dir), A.divergences(subs, ["segment"]), shown
    )
    segment = F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string"))
    docs = V.table(spark, sf_dir, "documents").select("doc_id", segment.alias("segment"), "text")
    loose = A.ungrounded_claims(docs, known.filter("horizon = 'near'").drop("horizon"), ["doc_id"], ["segment"])
    return loose.groupBy("doc_id", "segment").agg(F.min("claim").alias("low"), F.max("claim").alias("high"), big(F.count(F.lit(1)), "n"))
