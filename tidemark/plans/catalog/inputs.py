"""Source, sink, text and coercion queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.constants import EXCHANGE_CURRENCY, REGION_SEGMENTS, REGION_STATES
from tidemark.functions import claims, coerce, labels
from tidemark.operators import clusters as K
from tidemark.operators import reads as Q
from tidemark.oracles.views import check
from tidemark.plans import fixtures as V
from tidemark.plans import store
from tidemark.plans.catalog.common import big, r6
from tidemark.plans.registry import query
from tidemark.session import literal_frame, scratch_path
from tidemark.sources import filings as FL
from tidemark.sources import grid as GR
from tidemark.sources import pages as PG
from tidemark.sources import prices as PR
from tidemark.sources import series as SE
from tidemark.sources import tables as TB
from tidemark.sources import universe as UN

START, END = dt.date(1997, 1, 1), dt.date(1999, 12, 31)
_SIG = "SELECT segment, signal_name, geography, observed_at, value_num FROM ({}) s"


def _sig(df):
    return df.select("segment", "signal_name", "geography", "observed_at", r6("value_num"))


def _landed(spark, sf_dir):
    """Series rows as a feed lands them: text values, some censored or missing, text periods."""
    m = V.monthly(spark, sf_dir)
    no = V.seg_no(F.col("segment"))
    text = (
        F.when(F.month("month") == 3, "NA").when(F.month("month") == 5, "--").when(F.month("month") == 7, "<0.001")
        .otherwise(F.concat(F.lit(" "), F.col("units").cast("bigint").cast("string")))
    )
    period = (
        F.when(F.month("month") == 12, F.year("month").cast("string"))
        .when(no % 2 == 0, F.date_format("month", "yyyy-MM"))
        .otherwise(F.date_format("month", "yyyy-MM-dd"))
    )
    return m.select(
        F.concat(F.lit("S."), F.col("segment")).alias("series_id"),
        period.alias("period"),
        text.alias("value"),
        F.col("n_lines").cast("bigint").cast("string").alias("sales"),
        F.col("big").cast("bigint").cast("string").alias("generation"),
    )


def _spec(spark, sf_dir):
    no = F.col("seg_no")
    return V.segments(spark, sf_dir).select(
        F.concat(F.lit("S."), F.col("segment")).alias("series_id"),
        "segment",
        F.lit(None).cast("string").alias("subsegment"),
        F.when(no % 3 == 1, "retail_sales").when(no % 3 == 2, "net_gen").otherwise("level").alias("signal_name"),
        F.lit("unit").alias("unit"),
        F.lit("US").alias("geography"),
        F.when(no % 3 == 1, "sales").when(no % 3 == 2, "generation").otherwise("value").alias("value_column"),
    )


@query(
    "s1_s9_normalize_series",
    check(
        """SELECT segment, signal_name, 'US' AS geography, d AS observed_at, CAST(v AS DOUBLE) AS value_num FROM (
             SELECT segment, CASE seg_no % 3 WHEN 1 THEN 'retail_sales' WHEN 2 THEN 'net_gen' ELSE 'level' END AS signal_name,
                    CASE WHEN month(month) = 12 THEN make_date(year(month), 12, 31) ELSE month END AS d,
                    CASE seg_no % 3 WHEN 1 THEN n_lines WHEN 2 THEN big ELSE CASE WHEN month(month) IN (3, 5, 7) THEN NULL ELSE units END END AS v
             FROM monthly JOIN segdim USING (segment)) WHERE v IS NOT NULL AND d BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""",
        "monthly",
        "segdim",
    ),
)
def normalize_series(spark, sf_dir):
    return _sig(SE.normalize_series(_landed(spark, sf_dir), _spec(spark, sf_dir), START, END))


@query(
    "s2_fan_out_series",
    check(
        """SELECT t AS segment, 'macro_level' AS signal_name, observed_at, value_text, CAST(TRY_CAST(value_text AS DOUBLE) AS DOUBLE) AS value_num FROM (
             SELECT segment AS series, month AS observed_at, unnest([segment, segment || '/peer']) AS t,
                    CASE WHEN month(month) = 2 THEN '.' WHEN month(month) = 4 THEN 'n/a' ELSE CAST(CAST(units AS BIGINT) AS VARCHAR) END AS value_text FROM monthly)
           WHERE value_text <> '.'""",
        "monthly",
    ),
)
def fan_out_series(spark, sf_dir):
    value = (
        F.when(F.month("month") == 2, ".").when(F.month("month") == 4, "n/a").otherwise(F.col("units").cast("bigint").cast("string"))
    )
    obs = V.monthly(spark, sf_dir).select(F.col("segment").alias("series_id"), F.col("month").alias("date"), value.alias("value"))
    spec = V.segments(spark, sf_dir).select(
        F.col("segment").alias("series_id"), F.lit("macro_level").alias("signal_name"), F.lit("index").alias("unit"),
        F.array("segment", F.concat("segment", F.lit("/peer"))).alias("segments"),
    )
    df = SE.fan_out_series(obs, spec)
    return df.select("segment", "signal_name", "observed_at", "value_text", r6("value_num"))


@query(
    "s3_trade_signals",
    check(
        """SELECT CASE WHEN c IN (1, 2) THEN 'hbm_memory' WHEN c = 3 THEN 'advanced_packaging' ELSE 'transformers_tnd' END AS segment, 'trade_volume' AS signal_name,
                  'US' AS geography, d AS observed_at, CAST(v AS DOUBLE) AS value_num FROM (
             SELECT n_regionkey AS c, CASE WHEN month(o_orderdate) = 1 THEN make_date(year(o_orderdate), 1, 1) ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS d,
                    SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS v
             FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0 AND month(o_orderdate) <> 6 GROUP BY ALL)""",
    ),
)
def trade_signals(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("m")).agg(
        F.sum(V.money("o_totalprice")).alias("v")
    )
    customer = V.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = V.table(spark, sf_dir, "nation")
    obs = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_regionkey", "m")
        .agg(F.sum("v").alias("v"))
        .select(
            F.concat(F.lit("85"), F.col("n_regionkey").cast("string")).alias("code"),
            F.when(F.month("m") == 1, F.year("m").cast("string"))
            .when(F.month("m") == 6, "bad period")
            .when(F.col("n_regionkey") == 3, F.date_format("m", "yyyy-MM-dd"))
            .otherwise(F.date_format("m", "yyyy-MM"))
            .alias("period"),
            F.col("v").cast("string").alias("trade_value"),
        )
    )
    codes = nation.select("n_regionkey").distinct().filter("n_regionkey <> 0")
    segment = (
        F.when(F.col("n_regionkey").isin(1, 2), "hbm_memory").when(F.col("n_regionkey") == 3, "advanced_packaging").otherwise("transformers_tnd")
    )
    code_map = codes.select(F.concat(F.lit("85"), F.col("n_regionkey").cast("string")).alias("code"), segment.alias("segment"))
    return _sig(SE.trade_signals(obs, code_map))


def _daily(spark, sf_dir):
    """Daily grid rows: one demand and one generation row per (supplier nation, day)."""
    geo = V.supplier_geo(spark, sf_dir).select("s_suppkey", "nation")
    days = (
        V.table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("day"))
        .agg(F.sum(V.money("l_quantity")).alias("q"))
        .join(geo, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("nation", "day")
        .agg(F.sum("q").alias("q"))
    )
    kinds = F.array(
        F.struct(F.when(F.dayofmonth("day") % 2 == 0, "D").otherwise("Demand").alias("type"), F.col("q").cast("string").alias("value")),
        F.struct(
            F.when(F.dayofmonth("day") % 2 == 0, "NG").otherwise("Net generation").alias("type"),
            F.when(F.dayofmonth("day") == 9, "--").otherwise(F.col("q").cast("string")).alias("value"),
        ),
    )
    return days.select(
        F.col("nation").alias("respondent-id"), F.date_format("day", "yyyy-MM-dd").alias("period"), F.explode(kinds).alias("k")
    ).select("respondent-id", "period", "k.type", "k.value")


_PEAKS = """SELECT n_name AS region, CAST(date_trunc('month', day) AS DATE) AS month, CAST(MAX(q) AS DOUBLE) AS peak,
                   CAST(SUM(q) FILTER (day(day) <> 9) AS DOUBLE) AS total
            FROM (SELECT n_name, CAST(l_shipdate AS DATE) AS day, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS q
                  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) GROUP BY ALL"""


def _peaks(spark, sf_dir):
    daily = GR.coalesced_fields(_daily(spark, sf_dir))
    return GR.monthly_peak_total(daily).withColumnRenamed("respondent", "region")


@query("s4_monthly_peak_total", _PEAKS)
def monthly_peak_total(spark, sf_dir):
    return _peaks(spark, sf_dir).select("region", "month", r6("peak"), r6("total"))


# Test regions: the published region names cycle over the nations of the test tables.
_REGION_NAMES = list(REGION_STATES)
_SQL_REGIONS = "[" + ", ".join(f"'{r}'" for r in _REGION_NAMES) + "]"
_SQL_SEGMENTS = "(VALUES " + ", ".join(f"('{r}', '{s}')" for r, ss in REGION_SEGMENTS.items() for s in ss) + ") b(grid, segment)"
_ALLOWED = ["ERCO", "CISO", "PJM", "NYIS"]


def _grid_name(col: str):
    names = F.array(*[F.lit(r) for r in _REGION_NAMES])
    return F.element_at(names, F.regexp_extract(col, r"(\d+)$", 1).cast("int") % len(_REGION_NAMES) + 1)


@query(
    "s5_fan_out_by_bridge",
    f"""SELECT grid AS region, segment, CAST(COUNT(*) AS BIGINT) AS n, MAX(peak) AS peak
        FROM (SELECT *, {_SQL_REGIONS}[CAST(regexp_extract(region, '([0-9]+)$', 1) AS INTEGER) % 7 + 1] AS grid FROM ({_PEAKS})) JOIN {_SQL_SEGMENTS} USING (grid)
        WHERE grid IN ('ERCO', 'CISO', 'PJM', 'NYIS') GROUP BY ALL""",
)
def fan_out_by_bridge(spark, sf_dir):
    bridge = literal_frame(spark, [(r, s) for r, ss in REGION_SEGMENTS.items() for s in ss], "region string, segment string")
    agg = _peaks(spark, sf_dir).withColumn("region", _grid_name("region"))
    fanned = GR.fan_out_by_bridge(agg, bridge, "region", _ALLOWED)
    return fanned.groupBy("region", "segment").agg(F.count(F.lit(1)).alias("n"), F.max("peak").alias("peak"))


_STATES = sorted({s for states in REGION_STATES.values() for s in states})
_SQL_STATES = "[" + ", ".join(f"'{s}'" for s in _STATES) + "]"
_SQL_BRIDGE = "(VALUES " + ", ".join(f"('{r}', '{s}')" for r, ss in REGION_STATES.items() for s in ss) + ") b(region, state)"
_SQL_TOTALS = f"""SELECT {_SQL_STATES}[s_suppkey % {len(_STATES)} + 1] AS state, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS total
                  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""


def _state_totals(spark, sf_dir):
    states = F.array(*[F.lit(s) for s in _STATES])
    state = F.element_at(states, (F.col("l_suppkey") % len(_STATES)).cast("int") + 1)
    return V.table(spark, sf_dir, "lineitem").groupBy(state.alias("state")).agg(F.sum(V.money("l_quantity")).alias("total"))


def _bridge(spark):
    return literal_frame(spark, [(r, s) for r, ss in REGION_STATES.items() for s in ss], "region string, state string")


@query(
    "s6_rollup_by_bridge",
    f"SELECT region, CAST(SUM(total) AS DOUBLE) AS total FROM ({_SQL_TOTALS}) JOIN {_SQL_BRIDGE} USING (state) GROUP BY ALL HAVING SUM(total) > 0",
)
def rollup_by_bridge(spark, sf_dir):
    return GR.rollup_by_bridge(_state_totals(spark, sf_dir), _bridge(spark)).select("region", r6("total"))


@query(
    "s7_totals_with_grand",
    f"""SELECT 'US-' || state AS geography, CAST(total AS DOUBLE) AS total FROM ({_SQL_TOTALS})
        UNION ALL SELECT 'US', CAST(SUM(total) AS DOUBLE) FROM ({_SQL_TOTALS})""",
)
def totals_with_grand(spark, sf_dir):
    return GR.totals_with_grand(_state_totals(spark, sf_dir), "state", "total").select("geography", r6("total"))


@query(
    "u3_states_of_regions",
    f"SELECT state, CAST(MAX(total) AS DOUBLE) AS total FROM ({_SQL_TOTALS}) JOIN {_SQL_BRIDGE} USING (state) WHERE region IN ('MISO', 'SWPP', 'ERCO') GROUP BY ALL",
)
def states_of_regions(spark, sf_dir):
    states = GR.states_of(_bridge(spark), ["MISO", "SWPP", "ERCO"])
    return _state_totals(spark, sf_dir).join(states, "state").select("state", r6("total"))


@query(
    "s8_planned_rows",
    """SELECT 'planned_capacity_mw' AS signal_name, 'US-' || st AS geography, CAST(o_totalprice AS DOUBLE) AS value_num,
              make_date(y, CASE WHEN m BETWEEN 1 AND 12 THEN m ELSE 4 END, 1) AS observed_at,
              'planned:' || o_custkey || ':' || o_orderkey || ':G1' AS source_id, 'planned:' || pm || ':' || es AS subsegment
       FROM (SELECT *, 'N' || (o_custkey % 20) AS st, year(o_orderdate) AS y, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE month(o_orderdate) + o_orderkey % 3 END AS m,
                    CASE WHEN o_orderkey % 4 = 0 THEN 'UNK' ELSE 'GT' END AS pm, o_orderstatus AS es FROM orders)
       WHERE o_orderkey % 11 <> 0""",
)
def planned_rows(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("entity_id"),
        key.cast("string").alias("plant_id"),
        F.lit("G1").alias("generator_id"),
        F.concat(F.lit("N"), (F.col("o_custkey") % 20).cast("string")).alias("state"),
        F.when(key % 11 == 0, " ").otherwise(F.col("o_totalprice").cast("string")).alias("capacity"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.when(key % 5 == 0, "").otherwise((F.month("o_orderdate") + key % 3).cast("string")).alias("month"),
        F.when(key % 4 == 0, "").otherwise("GT").alias("prime_mover"),
        F.col("o_orderstatus").alias("energy_source"),
        F.col("o_orderpriority").alias("status"),
    )
    path = scratch_path(spark, "inventory_csv")
    title = rows.limit(1).select(*[F.lit("Entity ID" if c == "entity_id" else c).alias(c) for c in rows.columns])
    title.unionByName(rows).write.csv(path)
    df = SE.planned_rows(SE.read_planned(spark, path), 2001, 4)
    return df.select("signal_name", "geography", "value_num", "observed_at", "source_id", "subsegment")


@query(
    "s10_unpivot_units",
    """SELECT n_name AS key, signal_name, unit, round(CASE WHEN unit = 'lb/MWh' THEN v ELSE v * 0.453592::DOUBLE END, 6) + 0.0 AS value
       FROM (SELECT n_name, CAST(AVG(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
            (VALUES ('co2_rate_lb_per_mwh', 'lb/MWh'), ('co2_rate_g_per_kwh', 'gCO2/kWh')) u(signal_name, unit)""",
)
def unpivot_units(spark, sf_dir):
    geo = V.supplier_geo(spark, sf_dir)
    rates = geo.groupBy(F.col("nation").alias("key")).agg(
        (F.sum(V.money("s_acctbal")).cast("double") / F.count(F.lit(1))).alias("rate")
    )
    return GR.unpivot_units(rates, "key", "rate").select("key", "signal_name", "unit", r6("value"))


@query(
    "s11_broadcast_country",
    """SELECT n_name AS key, (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3 OR s_name LIKE '%05' ORDER BY s_suppkey LIMIT 1) AS score FROM nation""",
)
def broadcast_country(spark, sf_dir):
    country = V.table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_nationkey") == 3, "USA").otherwise("ZZZ").alias("iso_a3"),
        F.when(F.col("s_name").endswith("05"), "The United States").otherwise(F.col("s_name")).alias("name"),
        F.col("s_acctbal").alias("water_stress"),
        "s_suppkey",
    )
    keys = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"))
    return GR.broadcast_country(country, keys, ["s_suppkey"]).select("key", "score")


PHRASES = ("the", "an en", "tion")
_SQL_PHRASES = "(VALUES ('the'), ('an en'), ('tion')) p(phrase)"


@query(
    "s12_phrase_counts",
    f"""SELECT doc_id, phrase, replace(phrase, ' ', '_') || '_mentions' AS signal_name,
               CAST(len(string_split(lower(text), phrase)) - 1 AS BIGINT) AS n FROM documents, {_SQL_PHRASES}""",
)
def phrase_counts(spark, sf_dir):
    df = FL.phrase_counts(V.table(spark, sf_dir, "documents"), PHRASES)
    return df.select("doc_id", "phrase", "signal_name", big("n"))


@query(
    "s13_extract_sections",
    r"""WITH f AS (SELECT doc_id, ['10-K', '10-Q', '8-K', '20-F', 'S-1'][doc_id % 5 + 1] AS form, text,
                          substring(text, 1, CAST(length(text) // 2 AS INTEGER)) AS h, substring(text, CAST(length(text) // 2 AS INTEGER) + 1) AS tl FROM documents),
             g AS (SELECT *, CASE WHEN doc_id % 7 = 6 THEN text WHEN form = '10-Q' THEN 'Intro. Item 1A. ' || h || ' ITEM 2 - ' || tl || ' Item 3. Rest.'
                                  ELSE 'Intro. Item 1A: ' || h || ' Item 1B. None. Item 7. ' || tl || ' item 7A. Risk. Item 8. Data.' END AS body FROM f),
             s AS (SELECT *, CASE WHEN form = '8-K' OR doc_id % 7 = 6 THEN body WHEN form = '10-Q' THEN h || '  ' || tl || ' '
                                  WHEN form IN ('10-K', '20-F') THEN h || '  ' || tl || ' ' ELSE h || '  ' END AS sec FROM g)
        SELECT doc_id, form, form = '8-K' OR doc_id % 7 = 6 AS is_full_text, CAST(length(sec) AS BIGINT) AS n_chars, md5(sec) AS digest FROM s""",
)
def extract_sections(spark, sf_dir):
    df = FL.extract_sections(V.filings(spark, sf_dir))
    return df.select("doc_id", "form", "is_full_text", big(F.length("section_text"), "n_chars"), F.md5("section_text").alias("digest"))


@query(
    "s14_strip_html",
    r"""SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest FROM (
          SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(
                   regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--(.|\n)*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
                                                 '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[!/]?[A-Za-z][^>]*>', ' ', 'g'),
                   '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""",
)
def strip_html(spark, sf_dir):
    df = FL.strip_html(V.table(spark, sf_dir, "pages").select("page_id", "html"))
    return df.select("page_id", big(F.length("text"), "n_chars"), F.md5("text").alias("digest"))


@query(
    "s15_accepted_filings",
    """SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS VARCHAR) AS entity, form, 'a' || doc_id AS accession, filed FROM (
         SELECT *, ['10-K', '10-Q', '8-K', '20-F', 'S-1'][doc_id % 5 + 1] AS form, DATE '2000-01-01' + CAST(doc_id % 365 AS INTEGER) AS filed FROM documents)
       WHERE form <> 'S-1' AND filed BETWEEN DATE '2000-03-01' AND DATE '2000-09-30' AND doc_id % 9 <> 0""",
)
def accepted_filings(spark, sf_dir):
    docs = V.filings(spark, sf_dir)
    filed = F.when(F.col("doc_id") % 9 == 0, "soon").otherwise(F.col("filed").cast("string"))
    # One index row per entity and form keeps each parallel array short.
    index = (
        docs.select(F.col("ticker").alias("entity"), "form", "doc_id", filed.alias("filed"))
        .groupBy("entity", "form", (F.col("doc_id") / 500).cast("int").alias("page"))
        .agg(F.collect_list(F.struct("doc_id", "filed")).alias("r"))
        .select(
            "entity",
            F.transform("r", lambda r: F.col("form")).alias("form"),
            F.transform("r", lambda r: F.concat(F.lit("a"), r["doc_id"].cast("string"))).alias("accessionNumber"),
            F.transform("r", lambda r: r["filed"]).alias("filingDate"),
        )
    )
    return FL.accepted_filings(index, dt.date(2000, 3, 1), dt.date(2000, 9, 30)).select("entity", "form", "accession", "filed")


def _forms(spark, sf_dir):
    """Purchase and sign-up events as ownership forms in both layouts; every ninth has no transaction."""
    ev = V.table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "signup"))
    user, day = F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")
    code = F.when(F.col("event_type") == "purchase", "P").otherwise("S")
    old = F.concat(
        F.lit("<doc><reportingPerson><reportingPersonId><rptOwnerCik>"), user,
        F.lit("</rptOwnerCik></reportingPersonId></reportingPerson><nonDerivativeTransaction><transactionCode>"), code,
        F.lit("</transactionCode><transactionDate>"), day, F.lit("</transactionDate></nonDerivativeTransaction></doc>"),
    )
    new = F.concat(
        F.lit("<doc><reportingOwner><reportingOwnerId><rptOwnerCik>"), user,
        F.lit("</rptOwnerCik></reportingOwnerId></reportingOwner><nonDerivativeTable>"
              "<nonDerivativeTransaction><transactionCoding><transactionCode> </transactionCode></transactionCoding></nonDerivativeTransaction>"
              "<nonDerivativeTransaction><transactionDate>\n  <value>"), day,
        F.lit("</value>\n</transactionDate><transactionCoding><transactionCode>"), code,
        F.lit("</transactionCode></transactionCoding></nonDerivativeTransaction>"
              "<nonDerivativeTransaction><transactionDate><value>1990-01-01</value></transactionDate>"
              "<transactionCoding><transactionCode>X</transactionCode></transactionCoding></nonDerivativeTransaction></nonDerivativeTable></doc>"),
    )
    xml = F.when(F.col("event_id") % 9 == 0, "<doc><derivativeTransaction/></doc>").when(F.col("event_id") % 2 == 0, new).otherwise(old)
    return ev.select(
        F.get_json_object("props", "$.k").alias("ticker"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("accession"), xml.alias("xml")
    )


@query(
    "s16_parse_insider_forms",
    """SELECT props ->> '$.k' AS ticker, lpad(CAST(event_id AS VARCHAR), 12, '0') AS accession, CAST(user_id AS VARCHAR) AS insider,
              CASE event_type WHEN 'purchase' THEN 'P' ELSE 'S' END AS code, CAST(ts AS DATE) AS tx_date
       FROM events WHERE event_type IN ('purchase', 'signup') AND event_id % 9 <> 0""",
)
def parse_insider_forms(spark, sf_dir):
    return FL.parse_insider_forms(_forms(spark, sf_dir)).select("ticker", "accession", "insider", "code", "tx_date")


@query(
    "s16_all_transactions",
    """SELECT code, CAST(COUNT(*) AS BIGINT) AS n, min(d) AS first_at, max(d) AS last_at FROM (
         SELECT CASE event_type WHEN 'purchase' THEN 'P' ELSE 'S' END AS code, CAST(ts AS DATE) AS d FROM events WHERE event_type IN ('purchase', 'signup') AND event_id % 9 <> 0
         UNION ALL SELECT 'X', DATE '1990-01-01' FROM events WHERE event_type IN ('purchase', 'signup') AND event_id % 9 <> 0 AND event_id % 2 = 0) GROUP BY ALL""",
)
def all_transactions(spark, sf_dir):
    return FL.all_transactions(_forms(spark, sf_dir)).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.min("tx_date").alias("first_at"), F.max("tx_date").alias("last_at")
    )


def _ratio_pages(spark, sf_dir):
    """One page per segment: a navigation table, then the monthly ratio table."""
    m = V.monthly(spark, sf_dir)
    ratio = (F.floor(F.col("disc") * 2200 / F.col("n_lines")) / 100).cast("decimal(8,2)").cast("string")
    stamp = F.when(F.month("month") % 2 == 0, F.date_format("month", "MMM yyyy")).otherwise(F.date_format("month", "yyyy-MM"))
    row = F.concat(F.lit("<tr><td> <b>"), stamp, F.lit("</b></td>\n<td class='r'>"), ratio, F.lit("</td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", row.alias("row")))), lambda r: r["row"]), "")
    head = F.when(V.seg_no(F.col("segment")) % 2 == 0, "<th>Month</th><th>Book-to-Bill</th>").otherwise("<th>Month</th><th>Level</th>")
    return m.groupBy("segment").agg(body.alias("body")).select(
        F.col("segment").alias("page_id"),
        F.concat(
            F.lit("<html><table><tr><td>2001-01</td><td>about 1.11</td></tr></table><TABLE id='x'><tr>"), head,
            F.lit("</tr>"), F.col("body"), F.lit("</TABLE></html>"),
        ).alias("html"),
    )


@query(
    "s17_html_ratio_rows",
    check(
        """SELECT segment AS page_id, period, ratio FROM (
             SELECT m.segment, strftime(month, '%Y-%m') AS period, floor(disc * 2200 / n_lines) / 100 AS ratio FROM monthly m
             UNION ALL SELECT segment, '2001-01', 1.11 FROM segdim WHERE seg_no % 2 = 1) WHERE ratio BETWEEN 0.5 AND 2.0""",
        "monthly",
        "segdim",
    ),
)
def html_ratio_rows(spark, sf_dir):
    return PG.html_ratio_rows(_ratio_pages(spark, sf_dir)).select("page_id", "period", "ratio")


def _payloads(spark, sf_dir):
    """Daily-adjusted price payloads, one per ticker and year."""
    p = store.prices(spark, sf_dir)
    fields = F.create_map(
        F.lit("4. close"), F.lit("0"),
        F.lit("5. adjusted close"), F.when(F.dayofmonth("date") == 13, "n/a").otherwise(F.col("close").cast("string")),
    )
    series = F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string").alias("k"), fields.alias("v"))))
    return p.groupBy("ticker", F.year("date").alias("y")).agg(series.alias("s")).select(
        "ticker", F.to_json(F.struct(F.col("s").alias("Time Series (Daily)"))).alias("payload")
    )


@query(
    "s18_parse_price_json",
    check("SELECT ticker, date, close FROM prices WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND day(date) <> 13", "prices"),
)
def parse_price_json(spark, sf_dir):
    return PR.parse_price_json(_payloads(spark, sf_dir), START, END)


@query(
    "s19_bars_from_wide",
    check("SELECT ticker, date, close FROM prices WHERE day(date) <> 7", "prices"),
)
def bars_from_wide(spark, sf_dir):
    wide = store.prices(spark, sf_dir).select(
        "ticker", F.col("date").alias("Date"), (F.col("close") * 2).alias("Close"),
        F.when(F.dayofmonth("date") != 7, F.col("close")).alias("Adj Close"),
    )
    return PR.bars_from_wide(wide)


@query(
    "s20_read_prices",
    check("SELECT ticker, date, close FROM prices WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND day(date) NOT IN (11, 12)", "prices"),
)
def read_prices(spark, sf_dir):
    path = scratch_path(spark, "prices_csv")
    close = F.when(F.dayofmonth("date") == 11, "").when(F.dayofmonth("date") == 12, "halted").otherwise(F.col("close").cast("string"))
    rows = store.prices(spark, sf_dir).select(F.concat("ticker", F.lit(" ")).alias("ticker"), F.col("date").cast("string").alias("date"), close.alias("close"))
    rows.write.option("header", "true").csv(path)
    return PR.read_prices(spark, path, START, END)


@query(
    "s21_read_universe",
    check(
        """SELECT ticker, segment, round(exposure, 6) + 0.0 AS exposure, CASE WHEN row_no % 5 = 0 THEN 0 ELSE mcap END AS mcap FROM universe WHERE row_no % 17 <> 0""",
        "universe",
    ),
)
def read_universe(spark, sf_dir):
    path = scratch_path(spark, "universe_csv")
    no = F.col("row_no")
    rows = store.universe(spark, sf_dir).select(
        F.concat(F.lit(" "), F.col("ticker")).alias("ticker"), "exchange", "name", "segment", "subsegment",
        F.when(no % 17 == 0, "n/a").otherwise((F.col("exposure") * 100).cast("decimal(20,8)").cast("string")).alias("exposure_pct"),
        F.when(no % 5 == 0, "").otherwise(F.col("mcap").cast("decimal(20,2)").cast("string")).alias("mcap_usd"), "row_no",
    )
    rows.write.option("header", "true").csv(path)
    return UN.read_universe(spark, path).select("ticker", "segment", r6("exposure"), "mcap")


@query(
    "f10_drop_placeholders",
    check("SELECT ticker, segment, sub AS subsegment FROM (SELECT *, CASE row_no % 6 WHEN 0 THEN 'REMOVE later' WHEN 1 THEN 'placeholder' ELSE subsegment END AS sub FROM universe) WHERE row_no % 6 > 1 AND row_no % 10 <> 4", "universe"),
)
def drop_placeholders(spark, sf_dir):
    no = F.col("row_no")
    sub = F.when(no % 6 == 0, "REMOVE later").when(no % 6 == 1, "placeholder").otherwise(F.col("subsegment"))
    rows = store.universe(spark, sf_dir).withColumn("subsegment", sub).withColumn("exposure", F.when(no % 10 == 4, 0.0).otherwise(F.col("exposure")))
    return UN.drop_placeholders(rows).select("ticker", "segment", "subsegment")


@query(
    "s22_merge_prices",
    check("SELECT ticker, date, CASE WHEN date >= DATE '1999-01-01' THEN floor(close * 2) ELSE close END AS close FROM prices", "prices"),
)
def merge_prices(spark, sf_dir):
    bars = store.prices(spark, sf_dir)
    fresh = bars.filter(F.col("date") >= F.lit(dt.date(1999, 1, 1))).withColumn("close", F.floor(F.col("close") * 2).cast("double"))
    return PR.merge_prices(bars.filter(F.col("date") < F.lit(dt.date(2000, 1, 1))), fresh)


@query(
    "s23_append_signals",
    check("SELECT signal_name, DATE '2001-01-01' AS ingested_on, CAST(2 * COUNT(*) AS BIGINT) AS n FROM signals GROUP BY ALL", "signals"),
)
def append_signals(spark, sf_dir):
    path = scratch_path(spark, "signal_table")
    for _ in range(2):
        TB.append_signals(store.signals(spark, sf_dir), path, dt.datetime(2001, 1, 1))
    return spark.read.parquet(path).groupBy("signal_name", F.col("ingested_at").cast("date").alias("ingested_on")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s24_publish_scores",
    check(
        """SELECT 'scores' AS tab, mode, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT as_of) AS BIGINT) AS n_dates
           FROM (SELECT mode, as_of + 2 AS as_of FROM hist WHERE as_of = DATE '2001-12-01') GROUP BY mode
           UNION ALL SELECT 'score_history', mode, CAST(COUNT(*) AS BIGINT), CAST(COUNT(DISTINCT as_of) AS BIGINT)
           FROM (SELECT mode, as_of + d AS as_of FROM hist, (SELECT unnest([0, 1, 2]) AS d) WHERE d = 0 OR as_of = DATE '2001-12-01') GROUP BY mode
           UNION ALL SELECT 'sub_score_history', mode, CAST(COUNT(*) AS BIGINT), CAST(COUNT(DISTINCT as_of) AS BIGINT)
           FROM (SELECT mode, as_of + d AS as_of FROM subs, (SELECT unnest([0, 1, 2]) AS d) WHERE mode = 'fixed' AND (d = 0 OR as_of = DATE '2001-12-01')) GROUP BY mode""",
        "hist",
        "subs",
    ),
)
def publish_scores(spark, sf_dir):
    """One mode at a time, then two more days of the last month, then one of them again: all dates and modes once."""
    root = scratch_path(spark, "published")
    history, subs = store.score_history(spark, sf_dir), store.subscores(spark, sf_dir)
    for mode in ("fixed", "rolling"):
        TB.publish_scores(history.filter(F.col("mode") == mode), subs.filter(F.col("mode") == mode), root)
    last = F.col("as_of") == F.lit(V.GRID_END)
    for days in (1, 2, 1):
        later = lambda df: df.filter(last).withColumn("as_of", F.date_add("as_of", days))  # noqa: B023, E731
        TB.publish_scores(later(history), later(subs), root)
    tables = {"scores": TB.read_scores(spark, root), **{t: TB.read_history(spark, root, t) for t in ("score_history", "sub_score_history")}}
    parts = [df.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("as_of").alias("n_dates")).withColumn("tab", F.lit(tab)) for tab, df in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("tab", "mode", "n", "n_dates")


@query(
    "s26_upsert_snapshots",
    check(
        """SELECT segment, horizon, as_of, CASE WHEN as_of >= DATE '2001-06-01' THEN 'machine' ELSE 'error' END AS generated_by FROM hist WHERE mode = 'fixed' AND as_of >= DATE '2001-01-01'""",
        "hist",
    ),
)
def upsert_snapshots(spark, sf_dir):
    history = store.score_history(spark, sf_dir).filter((F.col("mode") == "fixed") & (F.col("as_of") >= F.lit(dt.date(2001, 1, 1))))
    keys = ["segment", "horizon", "as_of"]
    old = history.filter(F.col("as_of") < F.lit(dt.date(2001, 9, 1))).select(*keys, F.lit("error").alias("generated_by"))
    new = history.filter(F.col("as_of") >= F.lit(dt.date(2001, 6, 1))).select(*keys, F.lit("machine").alias("generated_by"))
    return TB.upsert(old, new, keys)


@query(
    "s27_read_ledger",
    check(
        """SELECT s AS segment, ticker, quarter, CAST(v AS DOUBLE) AS value
           FROM (SELECT *, unnest([segment] || list_transform(range(1, 7), lambda k: 'alias ' || k || ' of ' || segment)) AS s FROM ledger)""",
        "ledger",
    ),
)
def read_ledger(spark, sf_dir):
    """Ledger documents, one per segment: its entries, a comment, and a chain of six aliases."""
    entry = F.struct("ticker", "quarter", F.col("v").cast("double").alias("ai_capex_usd_b"))
    per = V.ledger(spark, sf_dir).groupBy("segment").agg(F.to_json(F.struct(F.collect_list(entry).alias("entries"))).alias("body"))
    quoted = lambda *c: F.concat(F.lit('"'), *c, F.lit('"'))
    name = lambda k: F.concat(F.lit(f"alias {k} of " if k else ""), F.col("segment"))
    aliases = [x for k in range(1, 7) for x in (F.lit(", "), quoted(name(k)), F.lit(': {"entries_ref": '), quoted(name(k - 1)), F.lit("}"))]
    doc = F.concat(F.lit('{"_comment": "hand kept", '), quoted(F.col("segment")), F.lit(": "), F.col("body"), *aliases, F.lit("}"))
    return UN.read_ledger(per.select(doc.alias("value")))


@query(
    "w4_cluster_events",
    check(
        """SELECT ticker, day, CAST(n AS BIGINT) AS n FROM (
             SELECT d.ticker, d.day, (SELECT COUNT(DISTINCT insider) FROM purchases p WHERE p.ticker = d.ticker AND p.day BETWEEN d.day - 4 AND d.day) AS n,
                    (SELECT COUNT(DISTINCT insider) FROM purchases p WHERE p.ticker = d.ticker AND p.day BETWEEN d.day - 5 AND d.day - 1) AS before
             FROM (SELECT DISTINCT ticker, day FROM purchases) d) WHERE n >= 3 AND before < 3""",
        "purchases",
    ),
)
def cluster_events(spark, sf_dir):
    return K.cluster_events(K.keep_latest_amendment(V.purchases(spark, sf_dir)), days=5, k=3)


@query(
    "w5_keep_latest_amendment",
    check("SELECT ticker, insider, day, max(accession) AS accession FROM purchases GROUP BY ALL", "purchases"),
)
def keep_latest_amendment(spark, sf_dir):
    return K.keep_latest_amendment(V.purchases(spark, sf_dir))


@query(
    "j12_in_universe",
    check("SELECT ticker, insider, day, accession FROM purchases WHERE ticker IN (SELECT ticker FROM universe)", "purchases", "universe"),
)
def in_universe(spark, sf_dir):
    return Q.in_universe(V.purchases(spark, sf_dir), store.universe(spark, sf_dir))


@query(
    "j18_primary_segment",
    check(
        """SELECT p.accession, p.ticker, coalesce(u.segment, 'unclassified') AS segment, u.subsegment FROM purchases p
           LEFT JOIN (SELECT ticker, arg_min(segment, row_no) AS segment, arg_min(subsegment, row_no) AS subsegment FROM universe WHERE CAST(ticker AS BIGINT) % 3 <> 0 GROUP BY ticker) u USING (ticker)""",
        "purchases",
        "universe",
    ),
)
def primary_segment(spark, sf_dir):
    uni = store.universe(spark, sf_dir).filter(F.col("ticker").cast("bigint") % 3 != 0)
    return Q.attach_primary_segment(V.purchases(spark, sf_dir), uni).select("accession", "ticker", "segment", "subsegment")


@query(
    "x8_dirty_number",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2, 3) THEN NULL ELSE l_quantity END AS value FROM lineitem""",
)
def dirty_number(spark, sf_dir):
    no = F.col("l_linenumber")
    text = F.when(no == 1, " na").when(no == 2, "--").when(no == 3, "<0.5").otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("string")))
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", coerce.dirty_number(text).alias("value"))


@query(
    "x9_money",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders""",
)
def money(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", coerce.money(text).alias("value"))


@query(
    "x10_period_date",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN make_date(year(o_orderdate), 12, 31) WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS year_end,
              CASE o_orderkey % 3 WHEN 0 THEN make_date(year(o_orderdate), 1, 1) WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS year_start
       FROM orders""",
)
def period_date(spark, sf_dir):
    kind = F.col("o_orderkey") % 3
    text = F.when(kind == 0, F.date_format("o_orderdate", "yyyy")).when(kind == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = V.table(spark, sf_dir, "orders").withColumn("p", text)
    return df.select("o_orderkey", coerce.period_date(F.col("p"), "end").alias("year_end"), coerce.period_date(F.col("p"), "start").alias("year_start"))


_EXCHANGES = list(EXCHANGE_CURRENCY) + ["UNKNOWN"]
_SQL_EXCHANGES = "[" + ", ".join(f"'{e}'" for e in _EXCHANGES) + "]"
_SQL_CASE = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXCHANGE_CURRENCY.items()) + " ELSE 'USD' END"


@query(
    "x17_currency_and_cap",
    f"""SELECT s_suppkey, {_SQL_CASE} AS currency, CASE WHEN m > 0 THEN m >= 2e9 END AS large_or_mid
        FROM (SELECT s_suppkey, {_SQL_EXCHANGES}[s_suppkey % {len(_EXCHANGES)} + 1] AS x, s_acctbal * 1e6 AS m FROM supplier)""",
)
def currency_and_cap(spark, sf_dir):
    names = F.array(*[F.lit(e.lower()) for e in _EXCHANGES])
    exchange = F.element_at(names, (F.col("s_suppkey") % len(_EXCHANGES)).cast("int") + 1)
    return V.table(spark, sf_dir, "supplier").select(
        "s_suppkey", labels.currency_of(exchange).alias("currency"), labels.large_or_mid(F.col("s_acctbal") * 1e6).alias("large_or_mid")
    )


@query(
    "x16_ungrounded_claims",
    r"""WITH t AS (SELECT doc_id, n_chars, regexp_replace(text, '(^|[^\p{L}\p{N}_])[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?', '\1 ', 'g') AS x FROM documents),
             r AS (SELECT doc_id, n_chars, pos, rtrim(tok, '%') AS body, tok LIKE '%\%' ESCAPE '\' AS pct FROM (
                     SELECT doc_id, n_chars, unnest(regexp_extract_all(x, '((?:(?:^|[^\p{L}\p{M}\p{N}_.])-)?[\p{L}\p{M}\p{N}_.]+%?)', 1)) AS tok,
                            generate_subscripts(regexp_extract_all(x, '((?:(?:^|[^\p{L}\p{M}\p{N}_.])-)?[\p{L}\p{M}\p{N}_.]+%?)', 1), 1) AS pos FROM t)),
             n AS (SELECT doc_id, n_chars, pos, pct, CAST(regexp_extract(regexp_replace(body, '^[^-0-9]+', ''), '^(-?[0-9]+(\.[0-9]+)?)', 1) AS DOUBLE) AS v
                   FROM r WHERE regexp_full_match(body, '(?s)(.?-)?[0-9]+(\.[0-9]+)?(\.(\..*)?)?')),
             g AS (SELECT *, [v] || CASE WHEN pct THEN [v / 100] ELSE [] END AS c, [CAST(n_chars AS DOUBLE), 2.0, 4.0, 555.0] AS k FROM n)
        SELECT doc_id, min(v) AS low, max(v) AS high, CAST(COUNT(*) AS BIGINT) AS n FROM g
        WHERE NOT list_bool_or(flatten(list_transform(c, lambda a: list_transform(k, lambda b: abs(a - b) <= greatest(0.05, 0.02 * abs(b))))))
        GROUP BY doc_id""",
)
def ungrounded_claims(spark, sf_dir):
    """Numbers in each document that match none of its known values."""
    docs = V.table(spark, sf_dir, "documents")
    known = F.array(F.col("n_chars").cast("double"), F.lit(2.0), F.lit(4.0), F.lit(555.0))
    loose = docs.select("doc_id", claims.ungrounded_numbers(F.col("text"), known).alias("u")).filter(F.size("u") > 0)
    return loose.select("doc_id", F.array_min("u").alias("low"), F.array_max("u").alias("high"), big(F.size("u"), "n"))
