"""Personal data, secrets, decontamination, quality, mixing and token files against brute force."""

import hashlib
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import rows_of, sorted_rows

from tidemark.llm import decontaminate, mixing, private_data, quality, secrets, token_files
from tidemark.llm.common import raw

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def private(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


TANGLED = ["a@b.com%x@y.z", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "+1 (555) 010-1234+49 30 12345678", "4111-1111-1111-1111 4111111111111112", "é +1 2", "x@y.z@q.r.s", "call (555) 010-1234 now", "1" * 30_000, "a." * 5_000 + "@b." + "c." * 3_000 + "d"]


@pytest.mark.parametrize("which", ["documents", "awkward", "tangled"])
def test_private_base_spans(which, request, spark):
    docs = spark.createDataFrame(list(enumerate(TANGLED)), "doc_id long, text string") if which == "tangled" else request.getfixturevalue(which)
    want = []
    for i, t in rows_of(docs):
        found = private(t or "")
        want.append((i, *(sum(x[0] == k for x in found) for k in private_data.KINDS), hashlib.sha256(",".join("%s:%d:%d" % x for x in found).encode()).hexdigest()))
    got = private_data.find_private(docs)
    assert sorted_rows(got.drop("spans")) == sorted(want, key=repr)
    texts = {i: t or "" for i, t in rows_of(docs)}
    for r in got.collect():
        listed = [s.split(":") for s in r["spans"].split(",") if s]
        assert {"%s:%d:%d" % x for x in private(texts[r["doc_id"]])} <= {":".join(x) for x in listed} or r["doc_id"] is None
        order = [(private_data.KINDS.index(k), int(s)) for k, s, _ in listed]
        assert order == sorted(order)


def test_private_plan_has_no_python(documents):
    plan = private_data.find_private(documents)._jdf.queryExecution().executedPlan().toString()
    plan += private_data.candidates(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_reliabilities_are_learned():
    good, bad, mixed = (1, 1, 1, 1, 1), (-1, -1, -1, -1, -1), (1, 1, -1, 1, 1)
    patterns = [(0, good, 60), (0, bad, 40), (0, mixed, 30)]
    trust, posterior = private_data.estimate(patterns)
    assert posterior[0, good] > 0.95 > 0.05 > posterior[0, bad] and posterior[0, mixed] > 0.9
    assert trust[0][1][1, 0][1] > trust[0][1][1, 2][1]
    weights = private_data.train(patterns, posterior)
    score = lambda v: sum(a * b for a, b in zip(weights, [*private_data.features(0, list(v)), 1.0], strict=True))
    assert score(good) > 0 > score(bad)


ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24])


def test_secrets_in_tangled_texts():
    rng = np.random.default_rng(1)
    parts = ["password", "token", "TOKEN", "Secret", "api_key", "apikey", ":", "=", " ", "'", '"', "AKIA", "ABCD1234EFGH", "abcdef0123", "é", "\n", "xyz", "deadbeef", "-", "passwd", "sec", "\x00"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 300))) for _ in range(300)] + ["", "AKIA" * 3000, "f" * 9000]
    found = secrets.scan_texts(*raw(pa.array(texts)), secrets.Scanner())
    assert [[x for x in sorted(f) if x[1] < 3] for f in found] == [secret(t) for t in texts]


@pytest.mark.parametrize("which", ["documents", "awkward", "empty"])
def test_secret_rows(which, request):
    docs = request.getfixturevalue(which)
    want = []
    for i, t in rows_of(docs):
        found = secret(t or "")
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found)
        want.append((i, *(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted_rows(secrets.scan_secrets(docs).drop("spans")) == sorted(want, key=repr)


def test_automaton_is_minimal_and_right():
    from tidemark.llm.automata import compile_rules

    a = compile_rules([("(ab|cb)*d?", False)], search=False)
    table = a.table()
    for text in ("", "d", "ab", "abcbd", "abd", "ad", "dd", "abab", "cbc"):
        state = 0
        for b in text.encode():
            state = table[state][b]
        assert bool(a.accepts[state]) == bool(re.fullmatch("(ab|cb)*d?", text))
    assert len(a.accepts) == 4


def test_decontamination_matches_sql(documents, benchmark, duck):
    got = decontaminate.op9_query(documents, benchmark)
    cursor = duck.execute(decontaminate.OP9_SQL)
    assert got.columns == [d[0] for d in cursor.description]
    assert sorted_rows(got) == sorted(cursor.fetchall(), key=repr)


def test_decontamination_in_blocks_and_awkward_rows(spark, awkward, empty, benchmark, monkeypatch):
    items = spark.createDataFrame([(1, "one"), (1, "Two WORDS"), (None, "passage3 passage4"), (4, None), (5, ""), (6, "é 中 mixed"), (7, " ".join(f"passage{i}" for i in range(20)))], "item_id long, text string")
    whole = sorted_rows(decontaminate.op9_query(awkward, items))
    by_id = {r[0]: r for r in whole}
    assert by_id[5][1:4] == (1, 1, 1) and by_id[6][1:4] == (2, 2, 1) and by_id[3][1:4] == (0, 0, 0)
    assert by_id[1][3] == 3 and by_id[1][2] == 21 and by_id[1][4] == hashlib.sha256(b",1,7").hexdigest()
    kept = sorted_rows(decontaminate.remove_contaminated(awkward, items).select("doc_id", "text"))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    assert sorted_rows(decontaminate.op9_query(awkward, items)) == whole
    clean = decontaminate.remove_contaminated(awkward, items)
    assert clean.columns == awkward.columns and sorted_rows(clean.select("doc_id", "text")) == kept
    assert len(kept) == sum(not r[5] for r in whole)
    assert decontaminate.op9_query(empty, items).count() == 0
    assert decontaminate.op9_query(awkward, items.limit(0)).filter("contaminated").count() == 0


def test_longest_match_is_reported(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"b{i}" for i in range(25)) + " y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(40)))], "item_id long, text string")
    found = decontaminate.op9_query(docs, items).first()
    assert (found["longest"], found["longest_at"], found["longest_item"], found["longest_item_at"]) == (25, 1, "1", 0)
    other = decontaminate.op9_query(spark.createDataFrame([(1, "nothing of it"), (2, None)], docs.schema), items).collect()
    assert {(r["longest"], r["longest_at"], r["longest_item"], r["longest_item_at"]) for r in other} == {(0, None, None, None)}


def located(texts, items):
    tests = decontaminate.test_suffixes(items)
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    return decontaminate._located(batch, [i for i, _ in items], tests, decontaminate.Hasher(), True)


def test_decontamination_of_small_alphabets():
    rng = np.random.default_rng(3)
    texts = ["", *(" ".join(rng.choice(["a", "b"], rng.integers(0, 90), p=[0.9, 0.1])) for _ in range(150))]
    items = [(f"i{k % 17}", " ".join(rng.choice(["a", "b"], rng.integers(0, 45), p=[0.9, 0.1]))) for k in range(20)] + [("i1", "a a b"), ("same", texts[7]), ("", "b b")]
    for (n, spans, named, longest), text in zip(located(texts, sorted(items)), texts, strict=True):
        w, hit, want, most = text.split(), set(), set(), []
        for name, t in sorted(items):
            v = t.split()
            for i in range(len(w)):
                for j in range(max(len(v) - min(len(v), 13) + 1, 0) if v else 0):
                    k = 0
                    while i + k < len(w) and j + k < len(v) and w[i + k] == v[j + k]:
                        k += 1
                    if k >= min(len(v), 13):
                        hit.update(range(i, i + k))
                        want.add(name)
                        most.append((-k, i, name, t, j))
        size, place, name, _, at = min(most, default=(0, None, None, None, None))
        assert (n, {x for s, e in spans for x in range(s, e)}, set(named), longest) == (len(w), hit, want, (-size, place, name, at))


def test_decontamination_of_repeats_forms_no_pairs():
    tracemalloc.start()
    (n, spans, named, longest), = located(["a " * 200_000], [("x", "a " * 50), ("y", "a " * 40)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, spans, named, longest) == (200_000, [(0, 200_000)], ["x", "y"], (50, 0, "x", 0))
    assert peak < 100 << 20


def test_decontamination_holds_one_block_at_a_time(awkward, benchmark, monkeypatch):
    items = benchmark.selectExpr("item_id", "text").limit(3)
    whole = sorted_rows(decontaminate.judge(awkward, items))
    suffixes, store, done = decontaminate.test_suffixes, decontaminate.stored, []
    monkeypatch.setattr(decontaminate, "test_suffixes", lambda *a: done.append("collected") or suffixes(*a))
    monkeypatch.setattr(decontaminate, "stored", lambda *a: (store(*a), done.append("stored"))[0])
    monkeypatch.setattr(decontaminate, "_blocks", lambda b: [b.filter(b.item_id == r["item_id"]).withColumn("item_id", b.item_id.cast("string")) for r in b.collect()])
    assert sorted_rows(decontaminate.judge(awkward, items)) == whole
    assert done == ["collected", "stored"] * 3
    done.clear()
    decontaminate.remove_contaminated(awkward, items).count()
    assert done == ["collected", "stored"] * 3


def test_quality_gradients_and_held_out_accuracy(spark):
    rng = np.random.default_rng(0)
    x, count, y = rng.normal(size=(9, quality.FEATURES)), np.array([2, 1, 6]), np.array([1.0, 0, 1])
    w = {k: rng.normal(size=s) for k, s in {"W": (quality.FEATURES, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "a": (3,), "c": (4,), "d": (1,)}.items()}
    g = quality.gradients(w, x, count, y)

    def loss():
        p = quality.forward(w, x, count)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k in w:
        at = (0,) * w[k].ndim
        old = w[k][at]
        w[k][at] = old + 1e-5
        up = loss()
        w[k][at] = old - 1e-5
        slope = (up - loss()) / 2e-5
        w[k][at] = old
        assert abs(slope - g[k][at]) < 1e-6
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.op6_query(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.98


def test_quality_scores_equal_a_walk_over_passages(spark, documents, labels):
    """Gated attention written out for one document at a time."""
    model = quality.fit(documents, labels)
    w, checked = model.weights, 0
    scores = {r["doc_id"]: r["score"] for r in quality.scored(documents, model).collect()}
    for i, text in rows_of(documents)[:60]:
        flat, offs = raw(pa.array([text or ""]))
        x, count = quality.encode(flat, offs, quality.Hasher())
        assert list(count) == [max(1, -(-len((text or "").encode().split()) // quality.PASSAGE))]
        hidden, weight = [], []
        for row in (x - model.mean) / model.scale:
            h = np.tanh([sum(row[f] * w["W"][f, k] for f in range(len(row))) + w["b"][k] for k in range(len(w["b"]))])
            gate = 1 / (1 + np.exp(-(h @ w["U"])))
            hidden.append(h)
            weight.append(np.exp(sum(np.tanh(h @ w["V"]) * gate * w["a"])))
        pooled = sum(a * h for a, h in zip(weight, hidden, strict=True)) / sum(weight)
        assert abs(scores[i] - 1 / (1 + np.exp(-(pooled @ w["c"] + w["d"][0])))) < 1e-4
        checked += 1
    assert checked == 60


def test_quality_of_awkward_rows(awkward, empty, labels):
    rows = quality.op6_query(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.op6_query(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(awkward, labels).columns == awkward.columns and quality.op6_query(empty, labels).count() == 0


def test_mixing_matches_sql(documents, duck):
    cursor = duck.execute(mixing.OP4_SQL)
    assert sorted_rows(mixing.op4_query(documents)) == sorted(cursor.fetchall(), key=repr)


def test_mixing_awkward_rows(awkward, empty):
    rows = mixing.op4_query(awkward).collect()
    assert len(rows) == awkward.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    sizes = {(r["source_size"], r["target"]) for r in rows}
    assert abs(sum(t for _, t in sizes) - sum(s for s, _ in sizes)) < 1e-6 * sum(s for s, _ in sizes)
    mixed = mixing.mix_sources(awkward)
    assert mixed.columns == awkward.columns
    got = {}
    for i, t in rows_of(mixed):
        got[i, t] = got.get((i, t), 0) + 1
    want = {}
    for r, (i, t) in zip(sorted(mixing.rates(awkward).collect(), key=lambda r: (str(r["doc_id"]), r["size"])), sorted(rows_of(awkward), key=lambda r: (str(r[0]), len((r[1] or "").split()))), strict=True):
        assert r["doc_id"] == i
        if r["copies"]:
            want[i, t] = want.get((i, t), 0) + r["copies"]
    assert got == want
    assert mixing.op4_query(empty).count() == 0 and mixing.mix_sources(empty).count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 49408, 5000), rng.integers(0, 3, 700), rng.integers(0, 1 << 62, 5), np.zeros(300, np.int64), rng.integers(0, 1 << 31, 77)]).astype(np.uint64)
    ids = np.append(ids, np.full(3, (1 << 64) - 1, np.uint64))
    counts = np.array([1, 0, 119, 120, 121, 2000, 1, 0])
    counts = np.append(counts, len(ids) - counts.sum())
    assert (token_files.decode(*token_files.encode(ids, counts)[:3], counts) == ids).all()
    assert len(token_files.encode(np.full(600, 1, np.uint64), np.array([600]))[0]) == 10


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_token_files(which, request):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(((r["id"], r["th"], r["doc_id"], r["text"] or "") for r in token_files.keyed(docs).collect()), key=lambda r: r[:2])
    start, want = 0, []
    for _, _, i, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted_rows(token_files.op10_query(docs)) == sorted(want, key=repr)


def test_token_files_of_marks_behind_other_characters(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    ends = ["“hello”", "‘a’", "20°", "5€", "brand™", "l’eau»", "👍", "👍🏽", "wait…", "नमस्ते", "क़", "\u0958", "İ", "e\u0301", "Straße", "naïve", "слово", "語", "한", "\u1112\u1161\u11ab", "ΟΔΟΣ", "x²", "٣", "y\u00a0", "ﬁ", "\u037e", "\u212b", "\ufb1d", "\U00010400", "\U0001d7d8", "—", "a\u200d", "don't", "<|endoftext|>"]
    texts = [f"{e}{m}{z}" for e in ends for m in [*".,;:!?%$#&*", "...", "?!"] for z in ("", " then", "\n", "\u3000x", "\u0301")]
    texts += ["é", ".", "”.", "", "é.", "”"]
    texts.append(" ".join(texts))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = token_files.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    ids, counts = tokens(*token_files.loosened(*raw(pa.array(texts)), tokens.apart))
    got = [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
    assert [t for t, g in zip(texts, got, strict=True) if g != [*tokenizer.encode(t, add_special_tokens=False).ids, 1]] == []
    rows = token_files.op10_query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in rows} == {i: zlib.crc32(np.array(g, "<u4").tobytes()) for i, g in enumerate(got)}


def test_token_files_of_nothing_and_their_ids(spark, documents, empty, tmp_path):
    assert token_files.op10_query(empty).count() == 0
    token_files.write_ids(documents.limit(5), f"file://{tmp_path}/ids")
    for r in token_files.read_ids(spark, f"file://{tmp_path}/ids", ids=True).collect():
        assert len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == token_files.END_ID


def test_mixing_of_documents_without_ids_comes_near_the_target(spark):
    rows = [(None, f"{i} " + "word " * (i % 40), "nameless") for i in range(10_000)] + [(i, "other " * 30, "b") for i in range(2_000)]
    found = mixing.op4_query(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source_size").agg({"taken": "sum", "target": "max"}).collect()
    assert len(found) == 2
    for r in found:
        assert abs(r["sum(taken)"] - r["max(target)"]) < 0.05 * r["max(target)"]


def test_private_data_of_a_text_with_very_many_matches(spark):
    """A megabyte of addresses: 125,000 base spans and as many places for looser ones, in seconds and each at its place."""
    import time

    n = 125_000
    docs = spark.createDataFrame([(1, "1.1.1.1 " * n), (2, "x 9.9.9.9 +49 30 1234567 " * 700)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in private_data.find_private(docs).collect()}
    assert time.perf_counter() - began < 60
    assert got[1]["n_ip"] == n and got[1]["base_sha256"] == hashlib.sha256(",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(n)).encode()).hexdigest()
    want = private("x 9.9.9.9 +49 30 1234567 " * 700)
    assert got[2]["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % x for x in want).encode()).hexdigest()
    spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in got[2]["spans"].split(","))]
    extra = [x for x in spans if x not in set(want)]
    assert set(want) <= set(spans) and not any(s < f and b < e for _, s, e in extra for _, b, f in want)
