"""Parsers, coercions, text, files and table sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import claims, coerce, labels
from tidemark.session import scratch_path
from tidemark.sources import filings as FL
from tidemark.sources import grid as GR
from tidemark.sources import pages as PG
from tidemark.sources import prices as PR
from tidemark.sources import series as SE
from tidemark.sources import tables as TB
from tidemark.sources import universe as UN

D = dt.date


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r.v for r in df.select("i", expr(F.col("c")).alias("v")).orderBy("i").collect()]


def test_dirty_numbers(spark):
    texts = ["12.5", " 7 ", "NA", "na", "--", "NULL", "", "<0.001", "1d", "nan", "1e3", None, "-.5"]
    assert values(spark, texts, coerce.dirty_number) == [12.5, 7.0, None, None, None, None, None, None, None, None, 1000.0, None, -0.5]


def test_money(spark):
    assert values(spark, ["$1,234.50", "12", " ", "n/a", None], coerce.money) == [1234.5, 12.0, None, None, None]


def test_periods(spark):
    texts = ["2024", "2024-03", "2024-03-15", "2024-13", "x", None]
    assert values(spark, texts, lambda c: coerce.period_date(c, "end")) == [D(2024, 12, 31), D(2024, 3, 1), D(2024, 3, 15), None, None, None]
    assert values(spark, texts[:1], lambda c: coerce.period_date(c, "start")) == [D(2024, 1, 1)]
    assert values(spark, ["Mar 2024", "september  2023", "2024/7", "Maybe", "12"], coerce.month_name_period) == ["2024-03", "2023-09", "2024-07", None, None]


def test_currency_and_eta(spark):
    assert values(spark, ["nyse", "TSE", "LSE", "??", None], labels.currency_of) == ["USD", "JPY", "GBP", "USD", "USD"]
    got = values(spark, ["transformers_tnd", "unknown"], labels.static_eta)
    assert (got[0].eta, got[0].confidence) == (">24mo", "high") and got[1] is None


@pytest.mark.parametrize(
    "text,loose",
    [
        ("B is 64.8, cited as 65.", []),
        ("Share 50% of it", []),
        ("Up 37.5% since 2026-06-15", [37.5]),
        ("co2 A35SNO 034020.KS 1.5x", []),
        ("a drop of -12 and 99", [-12.0, 99.0]),
        ("range 555-7713", [555.0, 7713.0]),
    ],
)
def test_claims(spark, text, loose):
    df = spark.createDataFrame([(text,)], "c string")
    known = F.array(F.lit(64.8), F.lit(0.5))
    assert df.select(claims.ungrounded_numbers(F.col("c"), known).alias("u")).collect()[0].u == loose


def section(spark, form, text):
    r = FL.extract_sections(spark.createDataFrame([(form, text)], "form string, text string")).collect()[0]
    return r.section_text, r.is_full_text


def test_sections_by_form(spark):
    body = "Start Item 1A. Risk one. Item 1B. none Item 2. Props here Item 3. x Item 7. Talk Item 7A. Market Item 8. Data"
    assert section(spark, "10-K", body) == ("Risk one.  Talk ", False)
    assert section(spark, "10-Q", body)[0].split() == ["Risk", "one.", "Props", "here"]
    assert section(spark, "8-K", body) == (body, True)
    assert section(spark, "10-K", "nothing marked") == ("nothing marked", True)
    assert section(spark, "10-K", "ITEM 1A: all risk to the end")[0].split() == ["all", "risk", "to", "the", "end"]
    whole = "Item 1A. " + "risk " * 60000 + "Item 7. " + "talk " * 60000
    assert len(section(spark, "10-K", whole)[0].split()) == 120000


def test_phrase_counts_keep_zeroes_and_literals(spark):
    docs = spark.createDataFrame([(1, "Lead time and LEAD TIME. leadtime aaaa"), (2, "")], "doc_id int, text string")
    got = {(r.doc_id, r.phrase): (r.n, r.signal_name) for r in FL.phrase_counts(docs, ("lead time", "aa", "a.a")).collect()}
    assert got[(1, "lead time")] == (2, "lead_time_mentions") and got[(1, "aa")][0] == 2
    assert got[(1, "a.a")][0] == 0 and got[(2, "aa")][0] == 0 and len(got) == 6


def test_strip_html(spark):
    html = "<html><!-- c > --><style>p{}</style><script>var t='</p>';</script><p>A&amp;B<br>\n c&nbsp;&lt;d</p></html>"
    df = spark.createDataFrame([(html,)], "html string")
    assert FL.strip_html(df).collect()[0].text == "A&B c <d"


def test_filing_index_pairs_arrays(spark):
    df = spark.createDataFrame(
        [("e", ["10-K", "4", "8-K", "10-Q"], ["a1", "a2", "a3", "a4"], ["2024-02-01", "2024-02-01", "bad", "2025-01-01"]), ("f", ["8-K", "8-K"], ["b1"], ["2024-03-01"]), ("g", [], [], [])],
        "entity string, form array<string>, accessionNumber array<string>, filingDate array<string>",
    )
    got = FL.accepted_filings(df, D(2024, 1, 1), D(2024, 12, 31)).collect()
    assert sorted((r.entity, r.accession) for r in got) == [("e", "a1"), ("f", "b1")]


def test_insider_forms_in_both_layouts(spark):
    old = "<d><reportingPerson><reportingPersonId><rptOwnerCik>8</rptOwnerCik></reportingPersonId></reportingPerson><nonDerivativeTransaction><transactionCode>P</transactionCode><transactionDate>2024-01-03</transactionDate></nonDerivativeTransaction></d>"
    new = "<d><reportingOwner><reportingOwnerId><rptOwnerCik>7</rptOwnerCik></reportingOwnerId></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><transactionDate>\n <value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding></nonDerivativeTransaction></nonDerivativeTable></d>"
    anonymous = "<d><nonDerivativeTransaction><transactionCode>P</transactionCode></nonDerivativeTransaction><nonDerivativeTransaction><transactionCode>M</transactionCode><transactionDate>2024-02-01</transactionDate></nonDerivativeTransaction></d>"
    docs = spark.createDataFrame([("A", old), ("B", new), ("C", anonymous), ("D", "<d><derivativeTransaction/></d>"), ("E", "<d><nonDerivativeHolding/></d>")], "ticker string, xml string")
    got = {r.ticker: (r.insider, r.code, r.tx_date) for r in FL.parse_insider_forms(docs).collect()}
    assert got == {"A": ("8", "P", D(2024, 1, 3)), "B": ("7", "S", D(2024, 1, 2)), "C": ("unknown", "M", D(2024, 2, 1))}


def test_ratio_tables_prefer_headed_and_fall_back(spark):
    headed = "<table><tr><td>2024-01</td><td>1.05</td></tr></table><table><tr><th>Month</th><th>Book-to-Bill</th></tr><tr><td>Mar 2024</td><td><b>1.12</b></td></tr><tr><td>2024-04</td><td>3.50</td></tr></table>"
    plain = "<table><tr><td>2024/5</td><td>x</td><td>0.95</td></tr><tr><td>only 1.10</td></tr></table>"
    pages = spark.createDataFrame([("h", headed), ("p", plain), ("none", "<p>2024-01 1.2</p>")], "page_id string, html string")
    got = sorted((r.page_id, r.period, r.ratio) for r in PG.html_ratio_rows(pages).collect())
    assert got == [("h", "2024-03", 1.12), ("p", "2024-05", 0.95)]


def test_grid_peaks_and_rollups(spark):
    daily = spark.createDataFrame(
        [("R", "D", "2024-01-01", "10"), ("R", "Demand", "2024-01-02", "30"), ("R", "NG", "2024-01-01", "5"), ("R", "NG", "2024-01-09", "7"), ("R", "D", "2024-01-03", "NA"), ("R", "X", "2024-01-03", "9"), (None, "D", "2024-01-03", "9")],
        "respondent string, type string, period string, value string",
    )
    got = [(r.respondent, r.month, r.peak, r.total) for r in GR.monthly_peak_total(daily.filter("respondent IS NOT NULL")).collect()]
    assert got == [("R", D(2024, 1, 1), 30.0, 12.0)]
    totals = spark.createDataFrame([("TX", 5.0), ("KS", 2.0), ("CA", 0.0)], "state string, total double")
    bridge = spark.createDataFrame([("A", "TX"), ("A", "KS"), ("B", "TX"), ("C", "CA"), ("D", "ZZ")], "region string, state string")
    assert {r.region: r.total for r in GR.rollup_by_bridge(totals, bridge).collect()} == {"A": 7.0, "B": 5.0}
    assert {r.geography: r.total for r in GR.totals_with_grand(totals, "state", "total").collect()} == {"US-TX": 5.0, "US-KS": 2.0, "US-CA": 0.0, "US": 7.0}


def test_planned_rows_month_fallback_and_drops(spark):
    names = "entity_id plant_id generator_id state capacity year month prime_mover energy_source status".split()
    rows = [
        ("1", "2", "G", "TX", "10.5", "2026", "", "GT", "NG", "P"),
        ("1", "2", "H", "TX", "10.5", "2026", "13", "", "", ""),
        ("1", "2", "I", "TX", "10.5", "2026", "7", "GT", "NG", "P"),
        ("1", "2", "J", "", "10.5", "2026", "7", "GT", "NG", "P"),
        ("1", "2", "K", "TX", "x", "2026", "7", "GT", "NG", "P"),
        ("1", "2", "L", "TX", "1", " ", "7", "GT", "NG", "P"),
    ]
    got = SE.planned_rows(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), 2025, 4).collect()
    assert [(r.source_id[-1], r.observed_at, r.subsegment) for r in got] == [("G", D(2026, 4, 1), "planned:GT:NG"), ("H", D(2026, 4, 1), "planned:UNK"), ("I", D(2026, 7, 1), "planned:GT:NG")]
    assert got[0].released_at == dt.datetime(2025, 4, 1)


def test_landed_rows_that_do_not_fit_are_set_aside(spark):
    path = scratch_path(spark, "landed")
    spark.createDataFrame([('{"a": 1, "b": "x"}',), ("{broken",)], "value string").write.text(path)
    from pyspark.sql import types as T

    good, bad = SE.read_landed(spark, path, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())]))
    good, bad = good.cache(), bad.cache()
    assert [(r.a, r.b) for r in good.collect()] == [(1, "x")]


def test_price_merge_rounds_and_overwrites(spark):
    schema = "ticker string, date date, close double"
    old = spark.createDataFrame([("A", D(2024, 1, 1), 1.0), ("A", D(2024, 1, 2), 2.0)], schema)
    new = spark.createDataFrame([("A", D(2024, 1, 2), 2.123456), ("B", D(2024, 1, 1), 9.0)], schema)
    got = sorted((r.ticker, r.date.day, r.close) for r in PR.merge_prices(old, new).collect())
    assert got == [("A", 1, 1.0), ("A", 2, 2.1235), ("B", 1, 9.0)]
    path = scratch_path(spark, "prices")
    PR.write_prices(PR.merge_prices(old, new), path)
    assert spark.read.parquet(path).filter("year = 2024").count() == 3


def test_universe_requires_columns(spark):
    path = scratch_path(spark, "uni")
    spark.createDataFrame([("A",)], "ticker string").write.option("header", "true").csv(path)
    with pytest.raises(ValueError, match="lacks columns"):
        UN.read_universe(spark, path)


def test_ledger_aliases_and_comments(spark):
    doc = '{"_comment": "x", "a": {"entries": [{"ticker": "T", "quarter": "2024-Q1", "ai_capex_usd_b": 1.5}]}, "b": {"entries_ref": "a"}, "c": {"entries_ref": "b"}, "d": {"entries_ref": "zz"}}'
    got = UN.read_ledger(spark.createDataFrame([(doc,)], "value string")).collect()
    assert sorted((r.segment, r.ticker, r.quarter, r.value) for r in got) == [(s, "T", "2024-Q1", 1.5) for s in "abc"]


def test_ledger_alias_chains_and_rings(spark):
    entries = '"x0": {"entries": [{"ticker": "T", "quarter": "2024-Q1", "ai_capex_usd_b": 1.5}]}'
    chain = ", ".join(f'"x{i}": {{"entries_ref": "x{i - 1}"}}' for i in range(1, 12))
    got = UN.read_ledger(spark.createDataFrame([("{" + entries + ", " + chain + "}",)], "value string")).collect()
    assert {r.segment for r in got} == {f"x{i}" for i in range(12)} and len(got) == 12
    ring = '{"a": {"entries_ref": "b"}, "b": {"entries_ref": "c"}, "c": {"entries_ref": "a"}}'
    with pytest.raises(ValueError, match="ring"):
        UN.read_ledger(spark.createDataFrame([(ring,)], "value string"))


def history(spark, days):
    return spark.createDataFrame([("s", "near", "fixed", d, float(i)) for i, d in enumerate(days)], "segment string, horizon string, mode string, as_of date, b double")


def test_publish_twice_leaves_no_duplicates(spark):
    root = scratch_path(spark, "pub")
    days = [D(2024, m, 1) for m in range(1, 5)]
    TB.publish_scores(history(spark, days), history(spark, days), root)
    TB.publish_scores(history(spark, days[-1:]).withColumn("b", F.lit(99.0)), history(spark, days[-1:]), root)
    rows = TB.read_history(spark, root).collect()
    assert len(rows) == 4 and {r.b for r in rows if r.as_of == days[-1]} == {99.0}
    assert [(r.as_of, r.b) for r in TB.read_scores(spark, root).collect()] == [(days[-1], 99.0)]


def test_daily_publishing_keeps_the_month_and_the_other_mode(spark):
    root = scratch_path(spark, "daily")
    for d in (1, 2, 3, 2):
        TB.publish_scores(history(spark, [D(2024, 5, d)]), history(spark, [D(2024, 5, d)]), root)
    other = history(spark, [D(2024, 5, 2)]).withColumn("mode", F.lit("rolling"))
    TB.publish_scores(other, other, root)
    rows = TB.read_history(spark, root).select("mode", "as_of").collect()
    assert sorted((r.mode, r.as_of.day) for r in rows) == [("fixed", 1), ("fixed", 2), ("fixed", 3), ("rolling", 2)]
    assert sorted((r.mode, r.as_of.day) for r in TB.read_scores(spark, root).collect()) == [("fixed", 3), ("rolling", 2)]
    assert len(TB.children(spark, f"{root}/scores")) == 2


def published(spark, root):
    return [sorted(map(tuple, df.select("segment", "mode", "as_of", "b").collect())) for df in (TB.read_history(spark, root), TB.read_history(spark, root, "sub_score_history"), TB.read_scores(spark, root))]


@pytest.mark.parametrize("step", range(4))
def test_a_run_that_dies_between_writes_leaves_the_former_state(spark, step, monkeypatch):
    """Writes are: history, sub-scores, snapshot, commit file. Whichever fails, readers see the state before, and the next run all of its own."""
    root = scratch_path(spark, "dies")
    days = [D(2024, 4, 3), D(2024, 5, 1)]
    TB.publish_scores(history(spark, days), history(spark, days), root)
    before, calls = published(spark, root), []

    def broken(real):
        def write(*args):
            calls.append(1)
            if len(calls) > step:
                raise OSError("lost")
            return real(*args)

        return write

    more = history(spark, [D(2024, 5, 2)]).withColumn("b", F.lit(7.0))
    with monkeypatch.context() as m:
        m.setattr(TB, "_write", broken(TB._write))
        m.setattr(TB, "_commit", broken(TB._commit))
        with pytest.raises(OSError):
            TB.publish_scores(more, more, root)
    assert published(spark, root) == before
    TB.publish_scores(more, more, root)
    assert published(spark, root)[0] == sorted([*before[0], ("s", "fixed", D(2024, 5, 2), 7.0)])
    assert published(spark, root)[2] == [("s", "fixed", D(2024, 5, 2), 7.0)]
    assert len(TB.children(spark, f"{root}/scores")) == 2


def test_a_first_run_that_dies_blocks_nothing(spark, monkeypatch):
    root, one = scratch_path(spark, "first"), history(spark, [D(2024, 5, 2)])
    with monkeypatch.context() as m:
        m.setattr(TB, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            TB.publish_scores(one, one, root)
    TB.publish_scores(one, one, root)
    assert published(spark, root)[2] == [("s", "fixed", D(2024, 5, 2), 0.0)] and len(TB.children(spark, f"{root}/scores")) == 1


def test_retention_is_part_of_the_commit(spark):
    root = scratch_path(spark, "retained")
    days = [D(2024, 1, 10), D(2024, 2, 5), D(2024, 2, 20), D(2024, 3, 1)]
    TB.publish_scores(history(spark, days), history(spark, days), root)
    today = history(spark, [D(2024, 3, 15)])
    TB.publish_scores(today, today, root, retain_days=30, now=D(2024, 3, 15))
    assert sorted(r.as_of for r in TB.read_history(spark, root).collect()) == [D(2024, 2, 20), D(2024, 3, 1), D(2024, 3, 15)]
    assert sorted(TB.read_commit(spark, root)["score_history"]) == ["2024-02-01", "2024-03-01"]
    plan = TB.read_history(spark, root).filter(F.col("computed_month") == F.lit(D(2024, 3, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(computed_month" in plan or "PartitionFilters: [computed_month" in plan


def test_expired_months_and_days_are_deleted(spark):
    path = scratch_path(spark, "expired")
    days = [D(2024, 1, 10), D(2024, 2, 5), D(2024, 2, 20), D(2024, 3, 1)]
    TB.overwrite_months(history(spark, days), path, "as_of")
    TB.delete_expired(spark, path, D(2024, 3, 15), days=30)
    assert sorted(r.as_of for r in spark.read.parquet(path).collect()) == days[2:]
    assert TB.children(spark, path) == ["computed_month=2024-02-01", "computed_month=2024-03-01"]
    assert "PartitionFilters: [isnotnull(computed_month" in TB.prune(spark.read.parquet(path), D(2024, 3, 15), 30)._jdf.queryExecution().executedPlan().toString()


def test_run_ledger_keeps_the_latest_run_of_a_source(spark):
    fields = "source string, last_ingested_at timestamp, status string, rows_written long, detail string"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    ledger = spark.createDataFrame([("a", at(1), "OK", 3, ""), ("b", at(1), "OK", 1, "")], fields)
    runs = spark.createDataFrame([("a", at(2), "FAILED", 0, "x"), ("a", at(3), "OK", 7, "y"), ("c", at(2), "OK", 2, "")], fields)
    got = {r.source: (r.status, r.rows_written, r.detail) for r in TB.record_run(ledger, runs).collect()}
    assert got == {"a": ("OK", 7, "y"), "b": ("OK", 1, ""), "c": ("OK", 2, "")}


def test_append_keeps_revisions_and_prune(spark):
    path = scratch_path(spark, "sig")
    sig = SE.as_signals(spark.range(2), segment="s", signal_name="n", value_num=F.col("id").cast("double"), source="x", observed_at=F.lit(D(2024, 1, 5)))
    for _ in range(2):
        TB.append_signals(sig, path, dt.datetime(2024, 2, 1))
    assert spark.read.parquet(path).count() == 4
    assert TB.prune(history(spark, [D(2020, 1, 1), D(2024, 1, 1)]), D(2024, 6, 1), 1000).count() == 1


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {r.k: r.v for r in TB.upsert(old, new, ["k"]).collect()} == {"a": 1, "b": 3, "c": 4}
