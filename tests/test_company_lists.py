"""Lists of companies: every name once and in order, and no more than a few lists in memory at a time."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reads as Q

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# 2,000 tickers of one set, in slices of 4, with lists of 1.5 MB: 500 copies of the list are 0.7 GB, the heap has 0.5.
SMALL_HEAP = """
import sys
from pyspark.sql import functions as F
from tidemark.operators import reads as Q
from tidemark.session import local_session

Q.SLICE = 4
spark = local_session("2", app="small_heap", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "512m", "spark.checkpoint.dir": sys.argv[1]})
members = spark.range(2000).select(F.concat(F.lit("T"), "id").alias("ticker"), F.lit("x").alias("segment"))
name = F.format_string("Company %012d of a longer name, to make lists that are long with fewer names %08d", "id", "id")
nodes = spark.range(16000).select((F.col("id") % 40).alias("part"), name.alias("name")).groupBy("part").agg(F.collect_list("name").alias("companies")).select(F.lit("x").alias("segment"), "companies")
"""
COMPANIES = """
found = Q.distinct_companies(members, nodes, joined=",")
"""
DETAIL = """
universe = members.selectExpr("ticker", "segment", "'sub' AS subsegment", "0.5D AS exposure", "ticker AS name", "'NYSE' AS exchange", "1L AS row_no")
scores = spark.createDataFrame([("x", "near", "STABLE", 50.0, 1.0)], "segment string, horizon string, regime string, b double, b_prime double")
notes = spark.createDataFrame([("T7",), ("T7",), ("T8",)], "ticker string")
eta = spark.createDataFrame([("x", "<12mo", "high")], "segment string, eta string, confidence string")
found = Q.ticker_detail(universe, scores, notes, nodes, eta, joined=",")
"""
COUNTED = """
n, least, most = found.agg(F.count("companies"), F.min(F.octet_length("companies")), F.max(F.octet_length("companies"))).first()
assert n == 2000 and least == most == 16000 * 93 - 1, (n, least, most)
"""


def run_with_small_heap(tmp_path, found: str) -> None:
    args = "--driver-memory 512m --driver-java-options -XX:+ExitOnOutOfMemoryError pyspark-shell"
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": args}
    code = SMALL_HEAP + found + COUNTED
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, (done.stdout + done.stderr)[-2000:]


def test_lists_of_the_commonest_set_are_not_held_at_once(tmp_path):
    """Before, the copies of a set's list for its slices were exploded in one task and kept until the last was made."""
    run_with_small_heap(tmp_path, COMPANIES)


def test_detail_of_the_commonest_set_is_not_held_at_once(tmp_path):
    run_with_small_heap(tmp_path, DETAIL)


def test_detail_keeps_tickers_without_companies(spark):
    members = [("a", "x", 1), ("a", "y", 2), ("b", "z", 3), ("c", None, 4)]
    universe = spark.createDataFrame([(t, s, "sub", 0.5, t.upper(), "NYSE", n) for t, s, n in members], "ticker string, segment string, subsegment string, exposure double, name string, exchange string, row_no long")
    scores = spark.createDataFrame([("x", "near", "STABLE", 50.0, 1.0)], "segment string, horizon string, regime string, b double, b_prime double")
    nodes = spark.createDataFrame([("x", ["n2", "n1"]), ("y", ["n1", "n3"]), ("z", [])], "segment string, companies array<string>")
    eta = spark.createDataFrame([("x", "<12mo", "high")], "segment string, eta string, confidence string")
    found = Q.ticker_detail(universe, scores, spark.createDataFrame([("a",)], "ticker string"), nodes, eta, joined=",").collect()
    assert {r.ticker: (r.companies, r.n_notes) for r in found} == {"a": ("n1,n2,n3", 1), "b": (None, 0), "c": (None, 0)}


@pytest.mark.parametrize("joined", [None, ","])
def test_lists_equal_a_plain_union(spark, monkeypatch, joined):
    """Many blocks, lanes and slices; segments without companies, tickers without segments, names in several segments."""
    monkeypatch.setattr(Q, "BLOCK", 7)
    monkeypatch.setattr(Q, "SERVED", 2)
    monkeypatch.setattr(Q, "SLICE", 3)
    rng = random.Random(5)
    segments = [f"s{i}" for i in range(9)]
    held = {s: [f"n{rng.randrange(80):02d}é" for _ in range(rng.randrange(12))] for s in segments[:-1]} | {"s8": []}
    rows = [(f"t{i}", s) for i in range(60) for s in rng.sample(segments, rng.randrange(1, 4))] + [("t60", None), ("t61", "s8"), ("t62", "gone")]
    nodes = spark.createDataFrame([(s, names) for s, names in held.items()] + [(None, ["n99"])], "segment string, companies array<string>")
    members = spark.createDataFrame(rows, "ticker string, segment string")
    want: dict[str, set[str]] = {}
    for ticker, segment in rows:
        want.setdefault(ticker, set()).update(held.get(segment, []))
    got = {r.ticker: r.companies for r in Q.distinct_companies(members, nodes, joined=joined).collect()}
    expected = {t: sorted(names, key=lambda n: n.encode()) for t, names in want.items() if names}
    assert got == (expected if joined is None else {t: joined.join(names) for t, names in expected.items()})
