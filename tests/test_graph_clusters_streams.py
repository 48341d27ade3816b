"""Graph reach, cluster detection, audit, reads and streaming."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import audit as A
from tidemark.operators import clusters as K
from tidemark.operators import graph as G
from tidemark.operators import reads as Q
from tidemark.session import scratch_path
from tidemark.streaming import clusters, intake

D = dt.date
EDGES = "src string, dst string, commodity string, role_kind string"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, None, None) for a, b in pairs], EDGES)


def brute_reach(pairs, start, depth):
    best, front = {start: 0}, [start]
    for d in range(1, depth + 1):
        front = [b for a, b in pairs if a in front and b not in best]
        best.update({b: d for b in front})
    return {k: v for k, v in best.items() if v}


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_reach_with_cycles_matches_brute_force(spark, depth):
    rng = random.Random(8)
    pairs = [(f"n{rng.randrange(15)}", f"n{rng.randrange(15)}") for _ in range(25)] + [("n0", "n1"), ("n1", "n0")]
    starts = spark.createDataFrame([("n0",), ("n3",)], "start string")
    got = {}
    for r in G.reach(edges(spark, pairs), starts, "downstream", depth).collect():
        got.setdefault(r.start, {})[r.node] = r.depth
    assert got.get("n0", {}) == brute_reach(pairs, "n0", depth)
    up = {r.node: r.depth for r in G.reach(edges(spark, pairs), starts.limit(1), "upstream", depth).collect()}
    assert up == brute_reach([(b, a) for a, b in pairs], "n0", depth)


def test_reach_counts_in_a_cycle(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "t1"), ("x", "t2"), ("t1", "t2")]
    targets = spark.createDataFrame([("t1",), ("t2",)], "node string")
    got = {r.node: r.n for r in G.reach_counts(edges(spark, pairs), targets).collect()}
    assert got == {"a": 2, "b": 2, "c": 2, "x": 1, "t1": 1}


def test_reach_counts_follow_long_chains(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(45)]
    got = {r.node: r.n for r in G.reach_counts(edges(spark, pairs), spark.createDataFrame([("n45",)], "node string")).collect()}
    assert got == {f"n{i}": 1 for i in range(45)}


def test_typed_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = [("a", "b", None, None), ("b", "a", "copper", "suppliesCommodity"), ("a", "b", "gas", "dependsOnCommodity"), ("a", "b", None, "dependsOnCommodity"), ("a", "zz", None, "supplies")]
    got = {(r.src, r.kind, r.dst) for r in G.typed_edges(nodes, spark.createDataFrame(rows, EDGES)).collect()}
    assert got == {("a", "supplies", "b"), ("b", "supplies", "a"), ("b", "suppliesCommodity", "copper"), ("a", "dependsOnCommodity", "gas")}


def test_role_mates(spark):
    roles = spark.createDataFrame([("N", "gpu"), ("A", "gpu"), ("B", "gpu"), ("B", "net"), ("C", "net")], "company string, class string")
    assert {r.company for r in G.role_mates(roles, "N").collect()} == {"A", "B"}


def buys(spark, rows):
    return spark.createDataFrame([(t, i, d, f"{n:06d}") for n, (t, i, d) in enumerate(rows)], "ticker string, insider string, day date, accession string")


def brute_clusters(rows, days, k):
    out = set()
    for t in {r[0] for r in rows}:
        mine = [(i, d) for tt, i, d in rows if tt == t]
        for day in {d for _, d in mine}:
            count = lambda end: len({i for i, d in mine if end - dt.timedelta(days=days - 1) <= d <= end})
            if count(day) >= k > count(day - dt.timedelta(days=1)):
                out.add((t, day, count(day)))
    return out


@pytest.mark.parametrize("days,k", [(30, 3), (5, 2), (1, 2)])
def test_clusters_match_brute_force_with_a_hot_ticker(spark, days, k):
    rng = random.Random(days)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b"]), f"i{rng.randrange(6)}", D(2024, 1, 1) + dt.timedelta(days=rng.randrange(160))) for _ in range(150)]
    got = {(r.ticker, r.day, r.n) for r in K.cluster_events(buys(spark, rows), days, k).collect()}
    assert got == brute_clusters(rows, days, k) and got


def test_cluster_refires_after_dropping_below(spark):
    first = [("T", i, D(2024, 1, d)) for i, d in (("a", 1), ("b", 2), ("c", 3), ("d", 4))]
    again = [("T", i, D(2024, 6, d)) for i, d in (("a", 1), ("b", 2), ("c", 3))]
    got = sorted(r.day for r in K.cluster_events(buys(spark, first + again)).collect())
    assert got == [D(2024, 1, 3), D(2024, 6, 3)]


def test_amendments_keep_highest_accession(spark):
    df = buys(spark, [("T", "a", D(2024, 1, 1))] * 3)
    assert [r.accession for r in K.keep_latest_amendment(df).collect()] == ["000002"]


def test_divergences_and_interesting(spark):
    sub = spark.createDataFrame(
        [("s", "lead_time_growth", 0.9, 0.5), ("s", "demand_signal", 0.6, 0.5), ("s", "capacity_tightness", 1.0, 0.1), ("t", "geo_concentration", 0.5, 0.4)],
        "segment string, sub_score string, value double, seed_value double",
    )
    diverged = A.divergences(sub, ["segment"])
    assert [(r.segment, [e.sub_score for e in r.divergences]) for r in diverged.collect()] == [("s", ["lead_time_growth"])]
    score = lambda rows: spark.createDataFrame(rows, "segment string, horizon string, b double, b_prime double")
    now = score([("s", "near", 50.0, 0.0), ("t", "near", 50.0, 0.0), ("u", "near", 50.0, 6.0), ("v", "near", 50.0, 0.0), ("w", "near", 56.0, 0.0)])
    prev = score([(x, "near", 50.0, 0.0) for x in "stuw"])
    got = {r.segment: r.interesting for r in A.flag_interesting(now, prev, diverged).collect()}
    assert got == {"s": True, "t": False, "u": True, "v": True, "w": True}


def test_history_series_in_request_order(spark):
    df = spark.createDataFrame([("a", "near", D(2024, m, 1), float(m), 0.0, "STABLE") for m in (3, 1, 2)] + [("b", "near", D(2024, 2, 1), 9.0, 0.0, "STABLE")], "segment string, horizon string, as_of date, b double, b_prime double, regime string")
    got = [(r.segment, [p.b for p in r.points]) for r in Q.history_series(df, ["b", "a"], "near", D(2024, 4, 1)).collect()]
    assert got == [("b", [9.0]), ("a", [1.0, 2.0, 3.0])]


def test_resolution_bands(spark):
    rows = [("soon", 6)] * 8 + [("soon", 30)] * 2 + [("mid", 18)] * 3 + [("late", 30)] * 3
    df = spark.createDataFrame([(s, D(2024 + (m // 12), m % 12 + 1, 1), D(2024, 1, 1)) for s, m in rows], "segment string, observed_at date, as_of date")
    assert {r.segment: r.band for r in Q.resolution_eta(df).collect()} == {"soon": "<12mo", "mid": "12-24mo", "late": ">24mo"}


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def replay(spark, batches, schema, judge, name):
    """Land and process one batch after another; rows by kind."""
    src, out = scratch_path(spark, f"{name}_in"), scratch_path(spark, f"{name}_out")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for batch in batches:
        land(spark, src, batch, schema)
        stream = judge(intake.read_files(spark, src, spark.read.parquet(src).schema))
        intake.append_to(stream, out, f"{out}_c").awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return {kind: intake.appended(spark, out, stream.schema, kind).collect() for kind in ("alert", "kept", "late")}


SIGNAL = "source string, source_id string, segment string, signal_name string, observed_at date, released_at timestamp, ingested_at timestamp, value_num double"
HOUR = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
BEAT = (None, None, None, None, None, None, HOUR(10_000), None)


def signal(hour, value, source_id="1", released=None):
    return ("f", source_id, "s", "n", D(2024, 1, 1), released, HOUR(hour), value)


def splits(rows, rng, n=3):
    cut = sorted(rng.sample(range(1, len(rows)), min(n - 1, len(rows) - 1)))
    return [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])]


def values_kept(rows):
    """Brute force: values in intake order, each that differs from the one before."""
    out = {}
    for r in sorted(rows, key=lambda r: (r[6], r[7] is not None, r[7] or 0.0)):
        mine = out.setdefault(r[1], [])
        if not mine or mine[-1] != r[7]:
            mine.append(r[7])
    return out


@pytest.mark.parametrize("seed", [1])
def test_stream_intake_keeps_every_change_of_a_value_in_any_order(spark, seed):
    rng = random.Random(seed)
    rows = [signal(h, v) for h, v in ((1, 1.0), (2, 2.0), (3, 1.0), (3, 1.0), (4, 1.0))]
    rows += [signal(rng.randrange(40), rng.choice([None, 1.0, 2.0]), str(k % 3 + 2)) for k in range(40)]
    rng.shuffle(rows)
    judge = lambda s: intake.drop_repeats(s, delay="100 hours")
    got = replay(spark, [*splits(rows, rng), [BEAT]], SIGNAL, judge, "intake")
    kept = {}
    for r in sorted(got["kept"], key=lambda r: (r.ingested_at, r.value_num is not None, r.value_num or 0.0)):
        kept.setdefault(r.source_id, []).append(r.value_num)
    assert kept == values_kept(rows) and kept["1"] == [1.0, 2.0, 1.0] and not got["late"]


def test_stream_intake_keeps_publications_once_and_counts_late_rows(spark):
    """With publication times 1, 2, 1 are three publications, whatever order they land in; exact repeats go."""
    first = [signal(3, 1.0, released=HOUR(3)), signal(1, 1.0, released=HOUR(1))]
    then = [signal(2, 2.0, released=HOUR(2)), signal(2, 2.0, released=HOUR(2)), signal(4, 1.0, released=HOUR(1))]
    late = [signal(5, 9.0, "2"), signal(5, 9.0, "2", HOUR(5)), signal(31, 5.0)]
    judge = lambda s: intake.drop_repeats(s, delay="10 hours")
    got = replay(spark, [first, then, [signal(40, 7.0, "3")], late, [BEAT]], SIGNAL, judge, "published")
    assert sorted((r.source_id, r.value_num, r.released_at) for r in got["kept"] if r.released_at) == [("1", 1.0, HOUR(1)), ("1", 1.0, HOUR(3)), ("1", 2.0, HOUR(2))]
    assert sorted((r.source_id, r.value_num) for r in got["kept"] if not r.released_at) == [("1", 5.0), ("3", 7.0)]
    assert [(r.source_id, r.value_num) for r in got["late"]] == [("2", 9.0), ("2", 9.0)]


BUY = "ticker string, insider long, ts timestamp"
AT = lambda t, i, day: (t, i, dt.datetime(2024, 1, 1, 9) + dt.timedelta(days=day))


@pytest.mark.parametrize("seed", [1])
def test_stream_clusters_equal_the_batch_operator_in_any_order(spark, seed):
    rng = random.Random(seed)
    rows = [AT(rng.choice(["hot", "hot", "hot", "a"]), rng.randrange(8), rng.randrange(60)) for _ in range(90)]
    rows += [AT("x", 1, 10), AT("x", 2, 12), AT("x", 3, 11)]
    rng.shuffle(rows)
    judge = lambda s: clusters.stream_clusters(s, days=5, k=3, late_days=70)
    got = replay(spark, [*splits(rows, rng), [(None, None, AT("", 0, 300)[2])]], BUY, judge, "buys")
    want = brute_clusters([(t, i, d.date()) for t, i, d in rows], 5, 3)
    assert {(r.ticker, r.day, r.n) for r in got["alert"]} == want and want and len(got["alert"]) == len(want) and not got["late"]


def test_stream_clusters_settle_in_time_order_and_reject_late_rows(spark):
    """An alert of a settled day stands; a row of a settled day goes to the reject table; one inside the watermark counts."""
    batches = [[AT("T", 1, 1), AT("T", 2, 3)], [AT("T", 3, 2)], [AT("U", 1, 20)], [AT("T", 4, 4), AT("U", 2, 19)], [AT("U", 3, 21)], [(None, None, AT("", 0, 99)[2])]]
    got = replay(spark, batches, BUY, lambda s: clusters.stream_clusters(s, days=30, k=3), "settled")
    assert sorted((r.ticker, r.day, r.n) for r in got["alert"]) == [("T", D(2024, 1, 4), 3), ("U", D(2024, 1, 22), 3)]
    assert [(r.ticker, r.insider, r["at"].date()) for r in got["late"]] == [("T", "4", D(2024, 1, 5))]


def test_covers_and_counts_are_forgotten():
    assert clusters.settle([5, 8, 40], None, 45, 5) == ([(5, 1, True), (8, 0, True), (13, -1, False), (40, 1, True), (45, -1, False)], [], None)
    assert clusters.settle([5, 10], None, 5, 5) == ([(5, 1, True)], [10], 5)
    assert clusters.settle([10], 5, 10, 5) == ([(10, 0, True)], [], 10)
    assert clusters.alerts_of([(3, 1, True), (1, 1, True), (3, 1, True), (6, -1, False), (6, 1, True)], 0, 3) == ([(3, 3)], 3)


def test_claims_meet_only_near_values_and_lose_none(spark):
    """Random values of every size and sign against comparing each claim with each known value."""
    from pyspark.sql import functions as F

    from tidemark.functions.claims import tolerance_bucket

    rng = random.Random(9)
    number = lambda: round(rng.choice([1, -1]) * rng.choice([rng.uniform(0, 3), rng.uniform(0, 100), 10 ** rng.uniform(0, 7)]), 2)
    known = [(rng.choice("ab"), number()) for _ in range(120)] + [("a", 2.5), ("b", 0.0), ("a", -0.05)]
    near = [k + rng.choice([1, -1]) * rng.uniform(0.9, 1.1) * max(0.05, 0.02 * abs(k)) for _, k in known]
    texts = [(i, rng.choice("abc"), f"x {v:.4f} and {number()} {number()}%") for i, v in enumerate(near + [number() for _ in range(80)])]
    got = A.ungrounded_claims(spark.createDataFrame(texts, "i int, s string, text string"), spark.createDataFrame(known, "s string, value double"), ["i"], ["s"])
    want = set()
    for i, s, text in texts:
        for at, token in enumerate(text.replace("x ", "").replace("and ", "").split()):
            v = float(token.rstrip("%"))
            if not any(abs(c - k) <= max(0.05, 0.02 * abs(k)) for c in [v] + [v / 100.0] * token.endswith("%") for t, k in known if t == s):
                want.add((i, s, at, v))
    assert {(r.i, r.s, r["at"], r.claim) for r in got.collect()} == want and want
    pairs = spark.createDataFrame([(k, k + e * max(0.05, 0.02 * abs(k))) for _, k in known for e in (-1.0, 1.0, 0.5)], "k double, v double")
    assert pairs.filter(F.abs(tolerance_bucket(F.col("k")) - tolerance_bucket(F.col("v"))) > 1).count() == 0


def test_grounding_values_of_a_segment(spark):
    day = D(2024, 3, 1)
    scores = spark.createDataFrame([("s", "near", 50.5, 1.5), ("s", "long", 60.5, None)], "segment string, horizon string, b double, b_prime double")
    prev = spark.createDataFrame([("s", "near", 49.0)], "segment string, horizon string, b double")
    subs = spark.createDataFrame([("s", "demand_signal", 0.9, 0.25)], "segment string, sub_score string, value double, seed_value double")
    seed = subs.select("segment", "sub_score", "seed_value")
    signals = spark.createDataFrame([("s", 7.0, day), ("other", 8.0, day)], "segment string, value_num double, observed_at date")
    got = A.grounding_values(scores, prev, subs, seed, A.divergences(subs, ["segment"]), signals).collect()
    shared = {0.9, 0.25, 0.65, 7.0, 2024.0, 3.0}
    assert {round(r.value, 6) for r in got if r.horizon == "near"} == shared | {50.5, 1.5, 49.0}
    assert {round(r.value, 6) for r in got if r.horizon == "long"} == shared | {60.5}
    assert len(got) == 16


def test_companies_are_merged_once_per_set_of_segments(spark):
    members = spark.createDataFrame([("A", "x"), ("A", "y"), ("A", "x"), ("B", "y"), ("B", "x"), ("C", "z"), ("D", None), ("E", "y")], "ticker string, segment string")
    nodes = spark.createDataFrame([("x", ["n2", "n1"]), ("x", ["n3"]), ("y", ["n1"]), ("z", [])], "segment string, companies array<string>")
    got = {r.ticker: r.companies for r in Q.distinct_companies(members, nodes).collect()}
    assert got == {"A": ["n1", "n2", "n3"], "B": ["n1", "n2", "n3"], "E": ["n1"]}


def test_tickers_of_one_set_are_written_by_many_tasks(spark):
    """Before, all tickers of the commonest set met in one task, and their lists were joined per ticker."""
    members = spark.range(2000).select(F.concat(F.lit("T"), "id").alias("ticker"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("segment"))
    nodes = spark.createDataFrame([("x", ["n2", "n1"]), ("y", ["n3", "n1"])], "segment string, companies array<string>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Q.distinct_companies(members, nodes, joined=",").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = Counter(r.task for r in got)
    assert len(got) == 2000 and {r.companies for r in got} == {"n1,n2,n3"} and len(sizes) > 2 and max(sizes.values()) < 1200


class CountedHandle:
    """A state store of one key that counts the calls it gets."""

    def __init__(self):
        self.calls, self.kept, self.timers = 0, None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.kept is not None

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, value):
        self.calls += 1
        self.kept = value

    def clear(self):
        self.calls += 1
        self.kept = None

    def listTimers(self):
        self.calls += 1
        return list(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Mark:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = lambda: at


def test_state_calls_do_not_grow_with_keys():
    """Before, every identity and every (ticker, insider) read and wrote its own state from Python."""
    names = ["source_id", "value_num", "_at", "_published"]
    row = Row(*names, "_key")
    keeper, store = intake.LastKept(names, 1000), CountedHandle()
    keeper.init(store)
    assert not list(keeper.handleInputRows((1,), [row(str(i % 500), float(i // 1000), 10 + i // 500, None, str(i % 500)) for i in range(1500)], Mark(0)))
    out = list(keeper.handleExpiredTimer((1,), Mark(100), None))
    assert len(out) == 1000 and Counter(r.value_num for r in out) == {0.0: 500, 1.0: 500} and store.calls < 20
    assert not list(keeper.handleExpiredTimer((1,), Mark(5000), None)) and store.kept is None and not store.timers
    covers, store = clusters.Covers(5), CountedHandle()
    covers.init(store)
    buy = Row("ticker", "insider", "_at")
    day = clusters.DAY_MS
    assert not list(covers.handleInputRows((1,), [buy("t", str(i), 3 * day + i) for i in range(500)], Mark(0)))
    assert sorted(covers.handleExpiredTimer((1,), Mark(20 * day), None)) == [("t", None, None, 3, 500, True), ("t", None, None, 8, -500, False)]
    assert store.calls < 20 and store.kept is None


def test_edges_are_made_distinct_by_brand_and_type(spark):
    """Before, nearly all lines were held in a distinct over (supplier, part)."""
    from tidemark.plans import fixtures as V

    plan = V.graph_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    held = [line for line in plan.splitlines() if "Aggregate" in line and "l_suppkey" in line]
    assert held and all("p_brand" in line and "l_partkey" not in line for line in held)
