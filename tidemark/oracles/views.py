"""Check SQL for the domain views and the scoring chain, written independently of the plans.

Each view states the rule directly (join every row to every as-of date, rank, pick), which
is fine at test size and shares no logic with the interval form the plans use.
"""

from __future__ import annotations

from tidemark.constants import BANDS, PROFILES, SOURCE_PRIORITY, WEIGHTS

_profiles = ", ".join(f"'{p}'" for p in PROFILES)
_bands = ", ".join(f"('{s}', '{k}', {lo}::DOUBLE, {hi}::DOUBLE)" for s, k, lo, hi in BANDS)
_weights = ", ".join(f"('{h}', '{s}', {w}::DOUBLE)" for h, ws in WEIGHTS.items() for s, w in ws.items())
_priority = ", ".join(
    f"('{s}', '{p}', '{k}', {i})"
    for s, ps in SOURCE_PRIORITY.items()
    for p, ks in ps.items()
    for i, k in enumerate(ks)
)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "segdim": (
        (),
        f"""SELECT segment, no AS seg_no, [{_profiles}][no % 10 + 1] AS profile
            FROM (SELECT DISTINCT p_brand AS segment, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS no
                  FROM part)""",
    ),
    "cube": (
        (),
        """SELECT p_brand AS segment, r_name AS region, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
                  SUM(CAST(l_quantity AS DECIMAL(18,2))) AS units, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue,
                  SUM(CAST(l_discount AS DECIMAL(18,2))) AS disc, COUNT(*) AS n_lines,
                  COUNT(*) FILTER (l_quantity >= 46) AS big, COUNT(*) FILTER (l_returnflag = 'R') AS ret,
                  COUNT(*) FILTER (l_linestatus = 'O') AS opened
           FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
                JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
           GROUP BY ALL""",
    ),
    "monthly": (
        ("cube",),
        """SELECT segment, month, CAST(SUM(units) AS DOUBLE) AS units, CAST(SUM(revenue) AS DOUBLE) AS revenue,
                  CAST(SUM(disc) AS DOUBLE) AS disc, CAST(SUM(n_lines) AS DOUBLE) AS n_lines,
                  CAST(SUM(big) AS DOUBLE) AS big, CAST(SUM(ret) AS DOUBLE) AS ret, CAST(SUM(opened) AS DOUBLE) AS opened
           FROM cube GROUP BY ALL""",
    ),
    "emitted": (
        ("cube", "monthly"),
        """SELECT segment, '' AS geography, month AS base, s.n AS signal_name, s.v AS value_num, s.lag AS lag, s.src AS source,
                  0 AS shift, true AS may_be_silent
           FROM (SELECT *, unnest([
               {'n': 'industrial_production', 'v': units, 'lag': 1, 'src': 'macro'},
               {'n': 'capacity_utilization', 'v': units / n_lines * CAST(3.2 AS DOUBLE), 'lag': 1, 'src': 'macro'},
               {'n': 'ppi_transformers', 'v': revenue / units / 10, 'lag': 1, 'src': 'macro'},
               {'n': 'ppi_semis', 'v': revenue / units, 'lag': 1, 'src': 'macro'},
               {'n': 'book_to_bill_ratio', 'v': disc / n_lines * 22, 'lag': 1, 'src': 'ratio_page'},
               {'n': 'trade_volume', 'v': revenue, 'lag': 2, 'src': 'trade'},
               {'n': 'lead_time_mentions', 'v': big, 'lag': 0, 'src': 'filings'},
               {'n': 'shortage_mentions', 'v': ret, 'lag': 0, 'src': 'filings'},
               {'n': 'capacity_expansion_mentions', 'v': opened, 'lag': 0, 'src': 'filings'},
               {'n': 'capacity_mw', 'v': units * 3, 'lag': 3, 'src': 'capacity'},
               {'n': 'hyperscaler_capex', 'v': revenue / 1000000, 'lag': 2, 'src': 'ledger'}]) AS s FROM monthly)
           UNION ALL
           SELECT segment, '', month, 'planned_capacity_mw', units / 4, 1, 'eia_860m', 12, false FROM monthly
           UNION ALL
           SELECT segment, '', month, 'planned_capacity_mw', units / 4 * CAST(1.1 AS DOUBLE), 3, 'eia_860m', 12, false FROM monthly
           UNION ALL
           SELECT segment, region, month, 'iso_peak_load_mw', CAST(units AS DOUBLE), 1, 'grid', 0, false FROM cube
           UNION ALL
           SELECT segment, region, CAST(date_trunc('year', month) AS DATE), 'iso_capacity_mw', CAST(SUM(units) AS DOUBLE) / 8, 3, 'grid', 0, false
           FROM cube GROUP BY 1, 2, 3""",
    ),
    "signals": (
        ("emitted", "segdim"),
        """SELECT e.segment, signal_name, value_num, geography, source,
                  signal_name || ':' || e.segment || ':' || geography || ':' || strftime(base, '%Y-%m') AS source_id,
                  CAST(base + to_months(shift) AS DATE) AS observed_at,
                  CASE WHEN NOT (may_be_silent AND (year(base) * 12 + month(base) + seg_no) % 7 = 0)
                       THEN CAST(base + to_months(lag) AS TIMESTAMP) END AS released_at,
                  CAST(base + to_months(lag) AS TIMESTAMP) + to_days(seg_no % 5) AS ingested_at
           FROM emitted e JOIN segdim USING (segment)""",
    ),
    "universe": (
        ("sold",),
        """SELECT * FROM (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, n_name AS exchange, s_name AS name, segment,
                  'sub' || (s_suppkey % 3) AS subsegment, floor(revenue * 10000 / MAX(revenue) OVER (PARTITION BY s_suppkey)) / 10000 AS exposure,
                  CAST(abs(CAST(s_acctbal AS DECIMAL(18,2))) * 1000000 AS DOUBLE) AS mcap, r_name AS region,
                  s_suppkey * 100 + CAST(regexp_extract(segment, '([0-9]+)$', 1) AS INTEGER) AS row_no
           FROM sold JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey)
           WHERE exposure >= 0.35::DOUBLE""",
    ),
    "sold": (
        (),
        """SELECT l_suppkey, p_brand AS segment, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    ),
    "prices": (
        (),
        """SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
                  floor(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) * 10000
                        / CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)) / 10000 AS close
           FROM lineitem GROUP BY ALL""",
    ),
    "ledger": (
        (),
        """SELECT c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS ticker,
                  year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS v
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    ),
    "purchases": (
        (),
        """SELECT props ->> '$.k' AS ticker, user_id AS insider, CAST(ts AS DATE) AS day,
                  lpad(CAST(event_id AS VARCHAR), 12, '0') AS accession
           FROM events WHERE event_type = 'purchase'""",
    ),
    "edges": (
        (),
        """SELECT DISTINCT 'S:' || l_suppkey AS src, 'B:' || p_brand AS dst, p_type AS commodity, 'suppliesCommodity' AS role_kind
           FROM lineitem JOIN part ON l_partkey = p_partkey
           UNION ALL
           SELECT DISTINCT 'B:' || p_brand, 'N:' || n_name, NULL, 'supplies'
           FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
                JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           UNION ALL
           SELECT 'N:' || n_name, 'R:' || r_name, NULL, 'supplies' FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "notes": (
        (),
        """SELECT CAST(conv_id % 97 AS VARCHAR) AS ticker, 'Brand#' || (conv_id % 25 + 1) AS segment,
                  CASE WHEN turn % 2 = 0 THEN 'long' ELSE 'short' END AS side
           FROM conversations WHERE role = 'user'""",
    ),
    "grid": (
        (),
        "SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS as_of",
    ),
    "seed": (
        ("segdim",),
        """SELECT segment, 'lead_time_growth' AS sub_score, (seg_no * 37) % 100 / 100.0::DOUBLE AS seed_value FROM segdim
           UNION ALL SELECT segment, 'geo_concentration', 0.2::DOUBLE + (seg_no % 5) / 10.0::DOUBLE FROM segdim
           UNION ALL SELECT segment, 'regulatory_friction', (seg_no * 53) % 100 / 100.0::DOUBLE FROM segdim
           UNION ALL SELECT segment, 'demand_signal', (seg_no * 71) % 100 / 100.0::DOUBLE FROM segdim""",
    ),
    "visible": (
        ("signals", "grid"),
        """SELECT a.as_of, s.* FROM signals s JOIN grid a
             ON coalesce(s.released_at, s.ingested_at) <= a.as_of AND s.observed_at >= a.as_of - 1825
            AND s.observed_at <= a.as_of + CASE WHEN s.signal_name = 'planned_capacity_mw' THEN 1095 ELSE 0 END""",
    ),
    "deduped": (
        ("visible",),
        """SELECT * FROM visible QUALIFY source <> 'eia_860m'
             OR row_number() OVER (PARTITION BY as_of, segment, signal_name, source_id ORDER BY ingested_at DESC) = 1""",
    ),
    "yoy": (
        ("deduped",),
        """SELECT as_of, segment, signal_name, CASE WHEN base > 0 THEN (v - base) / base END AS raw
           FROM (SELECT *, lag(v, 12) OVER w AS base, row_number() OVER (PARTITION BY as_of, segment, signal_name ORDER BY p DESC) AS rn
                 FROM (SELECT as_of, segment, signal_name, observed_at AS p, SUM(value_num) AS v FROM deduped
                       WHERE signal_name IN ('industrial_production', 'ppi_semis', 'trade_volume') GROUP BY ALL)
                 WINDOW w AS (PARTITION BY as_of, segment, signal_name ORDER BY p))
           WHERE rn = 1""",
    ),
    "newest": (
        ("deduped",),
        """SELECT as_of, segment, signal_name, geography, max(observed_at) AS seen_at, arg_max(value_num, observed_at) AS v, COUNT(*) AS n
           FROM deduped GROUP BY ALL""",
    ),
    "zscores": (
        ("deduped",),
        """SELECT as_of, segment, grp, CASE WHEN hi = lo THEN sign(last - lo) ELSE (last - mean) / std END AS raw
           FROM (SELECT as_of, segment, grp, COUNT(*) AS n, MAX(v) FILTER (rn = 1) AS last, AVG(v) FILTER (rn > 1) AS mean,
                        stddev_pop(v) FILTER (rn > 1) AS std, MIN(v) FILTER (rn > 1) AS lo, MAX(v) FILTER (rn > 1) AS hi
                 FROM (SELECT *, row_number() OVER (PARTITION BY as_of, segment, grp ORDER BY m DESC) AS rn
                       FROM (SELECT as_of, segment, CASE WHEN signal_name = 'lead_time_mentions' THEN 'lead' ELSE 'capacity' END AS grp,
                                    date_trunc('month', observed_at) AS m, SUM(value_num) AS v
                             FROM deduped WHERE signal_name LIKE '%_mentions' GROUP BY ALL))
                 WHERE rn <= 12 GROUP BY ALL)
           WHERE n >= 6""",
    ),
    "ttm": (
        ("deduped",),
        """SELECT as_of, segment, (cur - prior) / prior AS raw
           FROM (SELECT as_of, segment, COUNT(*) AS n, SUM(v) FILTER (rn <= 4) AS cur, SUM(v) FILTER (rn BETWEEN 2 AND 5) AS prior
                 FROM (SELECT *, row_number() OVER (PARTITION BY as_of, segment ORDER BY q DESC) AS rn
                       FROM (SELECT as_of, segment, date_trunc('quarter', observed_at) AS q, SUM(value_num) AS v
                             FROM deduped WHERE signal_name = 'hyperscaler_capex' GROUP BY ALL))
                 GROUP BY ALL)
           WHERE n >= 5 AND prior > 0""",
    ),
    "gridratio": (
        ("newest",),
        """SELECT p.as_of, p.segment, AVG(least(p.v / c.v, 1)) AS raw
           FROM newest p JOIN newest c ON p.as_of = c.as_of AND p.segment = c.segment AND p.geography = c.geography
           WHERE p.signal_name = 'iso_peak_load_mw' AND c.signal_name = 'iso_capacity_mw' AND c.v > 0
             AND abs(date_diff('day', p.seen_at, c.seen_at)) <= 400
           GROUP BY ALL""",
    ),
    "power": (
        ("deduped",),
        """SELECT as_of, segment, SUM(value_num) FILTER (signal_name = 'planned_capacity_mw')
                  / MAX(value_num) FILTER (signal_name = 'capacity_mw') AS raw
           FROM deduped WHERE signal_name IN ('planned_capacity_mw', 'capacity_mw') GROUP BY ALL
           HAVING MAX(value_num) FILTER (signal_name = 'capacity_mw') > 0""",
    ),
    "cand": (
        ("yoy", "newest", "zscores", "ttm", "gridratio", "power"),
        """SELECT as_of, segment, 'capacity_tightness' AS sub_score, 'iso_capacity_ratio' AS source_key, raw FROM gridratio
           UNION ALL SELECT as_of, segment, 'capacity_tightness', 'power_ratio', raw FROM power
           UNION ALL SELECT as_of, segment, 'capacity_tightness', 'comtrade_volume', raw FROM yoy WHERE signal_name = 'trade_volume'
           UNION ALL SELECT as_of, segment, 'capacity_tightness', 'manufacturing_utilization', v FROM newest WHERE signal_name = 'capacity_utilization'
           UNION ALL SELECT as_of, segment, 'capacity_tightness', 'edgar_keyword', raw FROM zscores WHERE grp = 'capacity'
           UNION ALL SELECT as_of, segment, 'lead_time_growth', 'transformers_ppi', v FROM newest WHERE signal_name = 'ppi_transformers' AND n >= 2
           UNION ALL SELECT as_of, segment, 'lead_time_growth', 'semi_book_to_bill', v FROM newest WHERE signal_name = 'book_to_bill_ratio'
           UNION ALL SELECT as_of, segment, 'lead_time_growth', 'semi_ppi', raw FROM yoy WHERE signal_name = 'ppi_semis'
           UNION ALL SELECT as_of, segment, 'lead_time_growth', 'edgar_keyword', raw FROM zscores WHERE grp = 'lead'
           UNION ALL SELECT as_of, segment, 'demand_signal', 'hyperscaler_capex', raw FROM ttm
           UNION ALL SELECT as_of, segment, 'demand_signal', 'manufacturing_indpro', raw FROM yoy WHERE signal_name = 'industrial_production'""",
    ),
    "priority": ((), f"SELECT * FROM (VALUES {_priority}) v(sub_score, profile, source_key, priority)"),
    "hhi": (
        ("universe",),
        """SELECT segment, SUM(w * w) / power(SUM(w), 2) AS hhi
           FROM (SELECT segment, region, SUM(exposure * mcap) AS w FROM universe WHERE exposure > 0 AND mcap > 0
                 GROUP BY segment, region QUALIFY SUM(exposure * mcap) / SUM(SUM(exposure * mcap)) OVER (PARTITION BY segment) >= 0.05) GROUP BY ALL""",
    ),
    "live": (
        ("cand", "priority", "segdim", "hhi", "grid"),
        """SELECT as_of, segment, sub_score, source_key, raw FROM cand JOIN segdim USING (segment) JOIN priority USING (sub_score, profile, source_key)
           WHERE raw IS NOT NULL QUALIFY row_number() OVER (PARTITION BY as_of, segment, sub_score ORDER BY priority) = 1
           UNION ALL SELECT as_of, segment, 'geo_concentration', 'hhi', hhi FROM hhi, grid""",
    ),
    "rawsub": (
        ("live", "seed", "segdim", "grid"),
        """SELECT as_of, segment, sub_score, seed_value,
                  CASE WHEN use_live THEN raw ELSE seed_value END AS raw,
                  CASE WHEN use_live THEN source_key WHEN seed_value IS NOT NULL THEN 'seed' ELSE 'imputed' END AS source_key
           FROM (SELECT a.as_of, d.segment, n.sub_score, s.seed_value, l.raw, l.source_key,
                        l.raw IS NOT NULL AND NOT (n.sub_score = 'geo_concentration' AND abs(l.raw - s.seed_value) > CAST(0.3 AS DOUBLE)) AS use_live
                 FROM segdim d CROSS JOIN grid a
                 CROSS JOIN (VALUES ('lead_time_growth'), ('capacity_tightness'), ('geo_concentration'), ('regulatory_friction'), ('demand_signal')) n(sub_score)
                 LEFT JOIN live l ON l.as_of = a.as_of AND l.segment = d.segment AND l.sub_score = n.sub_score
                 LEFT JOIN seed s ON s.segment = d.segment AND s.sub_score = n.sub_score)""",
    ),
    "bands": ((), f"SELECT * FROM (VALUES {_bands}) v(sub_score, source_key, lo, hi)"),
    "weights": ((), f"SELECT * FROM (VALUES {_weights}) v(horizon, sub_score, w)"),
    "banded": (
        ("rawsub", "bands"),
        """SELECT r.*, coalesce(b.lo, d.lo, 0) AS band_lo, coalesce(b.hi, d.hi, 1) AS band_hi
           FROM rawsub r LEFT JOIN bands b USING (sub_score, source_key)
                LEFT JOIN bands d ON d.sub_score = r.sub_score AND d.source_key = 'seed'""",
    ),
    "rolled": (
        ("banded",),
        """SELECT *, CASE WHEN n >= 2 AND h[CAST(floor(n * CAST(0.05 AS DOUBLE)) AS INTEGER) + 1] <> h[CAST(floor(n * CAST(0.95 AS DOUBLE)) AS INTEGER) + 1]
                          THEN h[CAST(floor(n * CAST(0.05 AS DOUBLE)) AS INTEGER) + 1] END AS lo_v,
                  CASE WHEN n >= 2 AND h[CAST(floor(n * CAST(0.05 AS DOUBLE)) AS INTEGER) + 1] <> h[CAST(floor(n * CAST(0.95 AS DOUBLE)) AS INTEGER) + 1]
                          THEN h[CAST(floor(n * CAST(0.95 AS DOUBLE)) AS INTEGER) + 1] END AS hi_v
           FROM (SELECT *, list_sort(coalesce(hs, [])) AS h, len(coalesce(hs, [])) AS n, coalesce(date_diff('day', f, t), 0) AS span_days
                 FROM (SELECT *, list(raw) FILTER (raw IS NOT NULL) OVER w AS hs, min(as_of) FILTER (raw IS NOT NULL) OVER w AS f,
                              max(as_of) FILTER (raw IS NOT NULL) OVER w AS t
                       FROM banded
                       WINDOW w AS (PARTITION BY segment, sub_score, source_key ORDER BY as_of
                                    RANGE BETWEEN INTERVAL 1825 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)))""",
    ),
    "subs": (
        ("banded", "rolled"),
        """SELECT *, CASE WHEN source_key = 'seed' AND raw IS NOT NULL THEN 'seed' WHEN raw IS NULL THEN 'imputed' ELSE 'extractor' END AS source,
                  raw IS NULL AS imputed,
                  CASE WHEN raw IS NULL THEN 0.5 WHEN source_key = 'seed' THEN raw WHEN hi = lo THEN 0.5 WHEN raw <= lo THEN 0.0
                       WHEN raw >= hi THEN 1.0 ELSE (raw - lo) / (hi - lo) END AS value
           FROM (SELECT 'fixed' AS mode, as_of, segment, sub_score, source_key, raw, seed_value, band_lo AS lo, band_hi AS hi, 'fixed' AS mode_used, 0 AS span_days FROM banded
                 UNION ALL
                 SELECT 'rolling', as_of, segment, sub_score, source_key, raw, seed_value, CASE WHEN use_it THEN lo_v ELSE band_lo END,
                        CASE WHEN use_it THEN hi_v ELSE band_hi END,
                        CASE WHEN source_key = 'seed' OR raw IS NULL THEN 'fixed' WHEN use_it THEN 'rolling' ELSE 'fallback_to_fixed' END, span_days
                 FROM (SELECT *, span_days >= 365 AND n >= 2 AND lo_v IS NOT NULL AS use_it FROM rolled))""",
    ),
    "scored": (
        ("subs", "weights"),
        """SELECT segment, as_of, mode, horizon, 100 * SUM(w * value) AS b,
                  1 - SUM(CASE WHEN imputed THEN w ELSE 0 END) AS completeness,
                  SUM(CASE WHEN source = 'seed' THEN w ELSE 0 END) AS seed_share
           FROM subs JOIN weights USING (sub_score) GROUP BY ALL""",
    ),
    "hist": (
        ("scored",),
        """SELECT *, CASE WHEN date_diff('day', first_at, as_of) < 90 THEN 'low' WHEN date_diff('day', first_at, as_of) < 180 THEN 'medium' ELSE 'high' END AS confidence,
                  CASE WHEN completeness < 0.4 OR b IS NULL OR b_prime IS NULL THEN 'NO_DATA'
                       WHEN b >= 70 AND b_prime >= 20 THEN 'PEAKING' WHEN b >= 70 AND b_prime >= 0 THEN 'PEAKED' WHEN b >= 70 THEN 'RESOLVING'
                       WHEN b >= 0 AND b_prime >= 30 THEN 'EMERGING' WHEN b >= 30 AND b_prime <= -15 THEN 'RESOLVING'
                       WHEN b >= 30 THEN 'STABLE' WHEN b >= 0 AND b_prime <= -15 THEN 'RESOLVING_FROM_LOW' ELSE 'STABLE' END AS regime
           FROM (SELECT *, CASE WHEN base IS NULL THEN 0 WHEN base < 5 THEN 100 ELSE greatest(-100, least(100, 100 * (b - base) / base)) END AS b_prime
                 FROM (SELECT *, median(b) OVER (PARTITION BY segment, horizon, mode ORDER BY as_of
                                                 RANGE BETWEEN INTERVAL 180 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS base,
                              min(as_of) OVER (PARTITION BY segment, horizon, mode) AS first_at FROM scored))""",
    ),
    "evald": (
        (),
        "SELECT CAST(unnest(generate_series(DATE '1998-01-15', DATE '2000-12-31', INTERVAL 30 DAYS)) AS DATE) AS t",
    ),
    "near": (("hist",), "SELECT * FROM hist WHERE horizon = 'near' AND mode = 'fixed'"),
    "sc": (
        ("near", "evald", "universe"),
        """SELECT p.segment, p.t, h.b, h.b_prime, h.regime
           FROM (SELECT DISTINCT segment, t FROM universe, evald) p ASOF JOIN near h ON p.segment = h.segment AND p.t >= h.as_of""",
    ),
    "fwd": (
        ("prices", "evald"),
        """SELECT a.ticker, a.t, CASE WHEN a.close > 0 AND a.date <> z.date THEN (z.close - a.close) / a.close END AS ret
           FROM (SELECT p.ticker, p.t, x.date, x.close FROM (SELECT DISTINCT ticker, t FROM prices, evald) p
                 ASOF JOIN prices x ON p.ticker = x.ticker AND p.t >= x.date) a
           JOIN (SELECT p.ticker, p.t, x.date, x.close FROM (SELECT DISTINCT ticker, t, CAST(t + 90 AS DATE) AS u FROM prices, evald) p
                 ASOF JOIN prices x ON p.ticker = x.ticker AND p.u >= x.date) z USING (ticker, t)""",
    ),
    "points": (
        ("sc", "fwd", "universe"),
        """SELECT u.ticker, u.segment, s.t, s.b, f.ret, s.regime
           FROM (SELECT DISTINCT ticker, segment FROM universe) u JOIN sc s USING (segment) JOIN fwd f ON f.ticker = u.ticker AND f.t = s.t
           WHERE f.ret IS NOT NULL""",
    ),
    "picked": (
        ("sc",),
        """SELECT t, side, segment, rank, b FROM (
             SELECT *, first(k) OVER (PARTITION BY t, side ORDER BY rank) AS top FROM (
               SELECT t, side, segment, b, k, row_number() OVER (PARTITION BY t, side ORDER BY k DESC, k2 DESC, segment) AS rank FROM (
                 SELECT t, 'long' AS side, segment, b, b AS k, b_prime AS k2 FROM sc WHERE b >= 50 AND regime NOT IN ('RESOLVING', 'RESOLVING_FROM_LOW', 'NO_DATA')
                 UNION ALL SELECT t, 'short', segment, b, b * abs(b_prime), b FROM sc WHERE b >= 50 AND regime = 'RESOLVING'
                 UNION ALL SELECT t, 'watchlist', segment, b, b, 0 FROM sc WHERE b >= 50 AND regime IN ('EMERGING', 'PEAKED'))))
           WHERE rank <= 2 AND (side = 'watchlist' OR k >= top - 10)""",
    ),
    "members": (
        ("universe", "prices"),
        """SELECT ticker, segment, MAX(exposure) AS exposure, arg_max(mcap, exposure) AS mcap,
                  (SELECT MIN(date) FROM prices p WHERE p.ticker = u.ticker) AS first_bar
           FROM universe u WHERE exposure >= 0.5 AND mcap >= 2000000000 AND ticker <> '' AND name <> '' GROUP BY ALL""",
    ),
    "entries": (
        ("picked", "members"),
        """SELECT t, side, segment, ticker, exposure, mcap, contribution, 1.0::DOUBLE / COUNT(*) OVER (PARTITION BY t, side) AS weight,
                  1.0::DOUBLE / n_seg / COUNT(*) OVER (PARTITION BY t, side, segment) AS neutral
           FROM (SELECT *, (SELECT COUNT(DISTINCT segment) FROM kept k2 WHERE k2.t = kept.t AND k2.side = kept.side) AS n_seg FROM kept)""",
    ),
    "kept": (
        ("picked", "members"),
        """SELECT * FROM (
             SELECT p.t, p.side, p.segment, p.rank, m.ticker, m.exposure, m.mcap, m.exposure * p.b AS contribution
             FROM picked p JOIN members m USING (segment) WHERE m.first_bar <= p.t
             QUALIFY row_number() OVER (PARTITION BY t, side, segment ORDER BY contribution DESC, ticker) <= 5)
           QUALIFY row_number() OVER (PARTITION BY t, side, ticker ORDER BY contribution DESC, rank) = 1""",
    ),
    "metrics": (
        ("entries", "fwd"),
        """SELECT t, side, SUM(weight * ret) / SUM(weight) FILTER (ret IS NOT NULL) AS gross,
                  SUM(weight * ret) / SUM(weight) FILTER (ret IS NOT NULL) - 0.001::DOUBLE * COUNT(*) AS net,
                  CASE WHEN COUNT(ret) >= 2 THEN stddev_samp(ret) * sqrt(252.0::DOUBLE / 90) END AS vol,
                  COUNT(*) FILTER (ret > 0) / nullif(COUNT(ret), 0) AS hit_rate, COUNT(ret) / COUNT(*) AS coverage, COUNT(*) AS n_held
           FROM entries LEFT JOIN fwd USING (ticker, t) GROUP BY ALL""",
    ),
    "ranked": (
        ("points",),
        """SELECT *, rank() OVER (PARTITION BY grp, t ORDER BY b) + (COUNT(*) OVER (PARTITION BY grp, t, b) - 1) / 2.0 AS rx,
                  rank() OVER (PARTITION BY grp, t ORDER BY ret) + (COUNT(*) OVER (PARTITION BY grp, t, ret) - 1) / 2.0 AS ry
           FROM (SELECT segment AS grp, t, b, ret FROM points UNION ALL SELECT 'ALL', t, b, ret FROM points)""",
    ),
    "ics": (
        ("ranked",),
        """SELECT grp, t, CASE WHEN COUNT(*) >= 4 AND COUNT(DISTINCT b) > 1 AND COUNT(DISTINCT ret) > 1
                               THEN corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) END AS ic, COUNT(*) AS n
           FROM ranked GROUP BY ALL""",
    ),
    "nodes": (
        ("universe",),
        """SELECT 'S:' || s_suppkey AS id, s_name AS label, 'SupplierSector' AS sector, [s_name] AS companies FROM supplier
           UNION ALL SELECT 'B:' || segment, segment, 'BrandSector', list_sort(coalesce(list(DISTINCT name) FILTER (exposure >= 0.9), [])) FROM universe GROUP BY segment
           UNION ALL SELECT 'N:' || n_name, n_name, 'NationSector', [] FROM nation
           UNION ALL SELECT 'R:' || r_name, r_name, 'RegionSector', [] FROM region""",
    ),
}
# "kept" must precede "entries", which counts over it.
VIEWS["entries"] = (("kept",), VIEWS["entries"][1])


def _order(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _order(VIEWS[name][0], seen)
            seen.append(name)
    return seen


def check(body: str, *names: str) -> str:
    """A full statement: the views a body needs, then the body."""
    views = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in _order(names, []))
    return f"WITH RECURSIVE {views}\n{body}" if views else body


def check_on(day: str, body: str, *names: str) -> str:
    """``check`` with one more as-of date, later ones left out: what a run on that day must find."""
    grid = f"SELECT as_of FROM ({VIEWS['grid'][1]}) WHERE as_of < DATE '{day}' UNION ALL SELECT DATE '{day}'"
    views = ",\n".join(f"{n} AS MATERIALIZED ({grid if n == 'grid' else VIEWS[n][1]})" for n in _order(names, []))
    return f"WITH RECURSIVE {views}\n{body}"


def check_daily(start: str, end: str, body: str, *names: str) -> str:
    """``check`` with every day of [start, end] in place of the month starts from ``start`` on."""
    days = f"SELECT CAST(unnest(generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS DATE) AS as_of"
    grid = f"SELECT as_of FROM ({VIEWS['grid'][1]}) WHERE as_of < DATE '{start}' UNION ALL {days}"
    views = ",\n".join(f"{n} AS MATERIALIZED ({grid if n == 'grid' else VIEWS[n][1]})" for n in _order(names, []))
    return f"WITH RECURSIVE {views}\n{body}"
