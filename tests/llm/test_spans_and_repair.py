"""Fill-in-the-middle, toxic spans and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest_llm import rows_of, sorted_rows

from tidemark.llm import conversations, fill_middle, toxicity

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def cut_and_join(doc_id, text):
    text = text or ""
    tok = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    hexed = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (len(tok) + 1), h[1] % (len(tok) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(tok), "plain", None, None, sha(text), sha(text))
    p, m, s = "".join(tok[:lo]), "".join(tok[lo:hi]), "".join(tok[hi:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(tok), form, len(p), len(m), sha(out), sha(text))


AWKWARD = ["", None, "<P> marked", "a" * 300, "é中\U0001f600" * 50, "ab1 " * 100, "x<", "S>", "<P", ">" * 90, "<" * 90, " \x00\n", "<S" * 40, "q" * 200 + "é" + "r" * 200]


@pytest.mark.parametrize("which", ["documents", "awkward", "tangled"])
@pytest.mark.parametrize("frame_bytes", [64 << 10, 5])
def test_fill_middle(which, frame_bytes, request, spark):
    docs = request.getfixturevalue(which) if which != "tangled" else spark.createDataFrame(list(enumerate(AWKWARD * 4)), "doc_id long, text string")
    if which != "tangled" and frame_bytes == 5:
        docs = docs.filter("length(text) < 3000 OR text IS NULL")
    got = fill_middle.digests(fill_middle.fill_middle(docs, frame_bytes=frame_bytes))
    assert sorted_rows(got) == sorted((cut_and_join(i, t) for i, t in rows_of(docs)), key=repr)


def test_fill_middle_output_is_a_zstandard_stream_of_whole_and_cut_frames(spark):
    text = " ".join(f"word{i}" for i in range(4000))
    docs = spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string")
    framed = fill_middle.write_frames(docs, fill_middle.draws(), frame_bytes=1000).collect()
    for r in fill_middle.transform(spark.createDataFrame(framed)).collect():
        whole = b"".join(map(fill_middle.read_frame, r.output))
        kept = set(map(bytes, framed[0].frames))
        assert len(whole) == len(text) + 9 * (r.form != "plain")
        assert sum(bytes(f) in kept for f in r.output) >= len(kept) - 4


def test_fill_middle_of_nothing(empty):
    assert fill_middle.op11_query(empty).count() == 0


def brute_repair(rows):
    """Least cost and ASCII-least audit by search over all edit strings, by growing cost."""
    n, best = len(rows), {}
    heap = {(0, "", 0, 0, ()): None}
    state = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    due = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    while heap:
        cost, audit, i, q, out = min(heap)
        del heap[min(heap)]
        if (i, q) in best:
            continue
        best[i, q] = True
        if i == n and q in (0, 3):
            return cost, audit, "\n".join(out)
        z, role = due[q]
        heap[cost + 2, audit + "I", i, z, (*out, f"{role}:")] = None
        if i < n:
            r, t, gone, cut = rows[i]
            heap[cost + 3, audit + "D", i + 1, q, out] = None
            if not gone:
                if r[:1] in state[q]:
                    heap[cost + cut, audit + "K", i + 1, state[q][r[:1]], (*out, f"{r}:{t}")] = None
                heap[cost + 2 + cut, audit + "R", i + 1, z, (*out, f"{role}:{t}")] = None
    raise AssertionError


def brute_conversation(conv, rows):
    """rows: (turn, role, text) of one conversation as they are in the table."""
    text = lambda x: " " if x is None else str(x)
    damaged = []
    for turn, role, t in rows:
        role, t = text(role), text(t)
        k = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        t = "" if k == 1 else re.sub("[.!?]", "", t) if k == 2 else t
        role = "user" if k == 4 else role
        damaged += [(turn, role, t)] * (0 if k == 0 else 2 if k == 3 else 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, judged, blank, dup, trunc = set(), [], 0, 0, 0
    for _, role, t in damaged:
        core = t.rstrip(" \t\n\v\f\r")
        b, d = not core, bool(core) and (role, t) in seen
        c = bool(core) and not d and core[-1] not in ".!?"
        seen.add((role, t))
        blank, dup, trunc = blank + b, dup + d, trunc + c
        judged.append((role, t, b or d, int(c)))
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(damaged)]
    turns = [t for t, _, _ in damaged if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, out = brute_repair(judged)
    return (conv, gaps, blank, dup, trunc, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha(out))


def messy(n_conv, n_rows, seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "Why?", "", " \n", None, "Wait! ", "long text " * 9]
    return [
        (rng.choice([None, *range(n_conv)]), rng.choice([None, *range(9)]), rng.choices(roles, [5, 5, 1, 1, 1, 1])[0], rng.choice(texts), "extra", rng.random() < 0.5)
        for _ in range(n_rows)
    ]


CONV = "conv_id long, turn long, role string, text string, gone_ string, blank boolean"


@pytest.mark.parametrize("block", [4096, 3])
def test_conversations_match_a_search(spark, block, monkeypatch):
    """Blocks of three rows make every conversation a long one, chained over parts and blocks."""
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
    rows = messy(20, 260, block)
    groups = {}
    for c, turn, role, text, *_ in rows:
        groups.setdefault(c, []).append((turn, role, text))
    got = sorted_rows(conversations.op13_query(spark.createDataFrame(rows, CONV)))
    assert got == sorted((brute_conversation(c, r) for c, r in groups.items()), key=repr)


def test_one_hot_conversation_over_many_tasks(spark):
    """A conversation of 6,000 rows lies in all tasks; the result equals that of one task."""
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice([f"row {i}.", f"row {i}", "same."])) for i in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = conversations.repair(conversations.damage(df)).collect()
    assert len({p.part for p in pieces}) >= 5
    whole = conversations.op13_query(df).collect()
    part = conversations.Part(7)
    seen, last = set(), None
    for r in sorted(conversations.damage(df).filter("NOT gone").collect(), key=lambda r: (r.turn, r.role, r.text)):
        core = r.text.rstrip(conversations.SPACE)
        part.add(r.turn, r.role, r.text, not core, bool(core) and core[-1] not in ".!?", hashlib.md5(f"{r.role}:{r.text}".encode()).digest(), (r.role, r.text) in seen and last != (r.role, r.text))
        seen.add((r.role, r.text))
        last = (r.role, r.text)
    one = part.solved()
    assert len(whole) == 1
    assert (whole[0].cost, whole[0].audit, whole[0].illegal, whole[0].duplicate) == (one["cost"], one["audit"], one["illegal"], one["duplicate"])
    assert whole[0].repaired_sha256 == sha("\n".join(f"{r}:{t}" for r, t in zip(one["roles"], one["texts"], strict=True)))


def test_conversations_match_sql_and_nothing(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    found = con.execute(conversations.OP13_SQL)
    names = [c[0] for c in found.description]
    want = sorted((tuple(r) for r in found.fetchall()), key=repr)
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = conversations.op13_query(table)
    assert sorted_rows(got.select(*names)) == want
    assert conversations.op13_query(spark.createDataFrame([], table.schema)).count() == 0


def test_checkpoints_are_few():
    symbols = bytes(random.Random(1).choices(range(9), k=10_000))
    kept, step, _ = conversations.backward(symbols, conversations.LAST)
    assert len(kept) <= 10_000 // step + 2 <= 102


def brute_marginals(emission, start, move):
    """Sums over all taggings."""
    n = len(emission)
    total, toxic = 0.0, np.zeros(n)
    for tags in itertools.product((0, 1), repeat=n):
        s = start * tags[0] + sum(e * t for e, t in zip(emission, tags, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(tags))
        total += np.exp(s)
        toxic += np.exp(s) * np.array(tags)
    return toxic / total, np.log(total)


def test_marginals_equal_sums_over_all_taggings():
    rng = np.random.default_rng(0)
    start, move = -0.4, rng.normal(size=(2, 2))
    first = np.array([0, 3, 3, 10, 11])
    e = rng.normal(size=11) * 2
    want = np.concatenate([brute_marginals(e[a:b], start, move)[0] for a, b in zip(first[:-1], first[1:], strict=True) if b > a])
    assert np.allclose(toxicity.marginals(e, first, start, move), want)


def test_marginals_of_long_texts_do_not_depend_on_their_neighbours():
    rng = np.random.default_rng(1)
    lengths = [1000, 0, 1, 63, 64, 65, 400]
    first = np.concatenate([[0], np.cumsum(lengths)])
    e, move = rng.normal(size=first[-1]) * 5, np.array([[1.0, -2.0], [-1.0, 2.0]])
    alone = [toxicity.marginals(e[a:b], np.array([0, b - a]), 0.3, move) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert np.allclose(toxicity.marginals(e, first, 0.3, move), np.concatenate(alone))
    f = np.zeros((1000, 2))
    f[0] = [0, 0.3 + e[0]]
    for i in range(1, 1000):
        f[i] = [np.logaddexp(f[i - 1, 0] + move[0, 0], f[i - 1, 1] + move[1, 0]), np.logaddexp(f[i - 1, 0] + move[0, 1], f[i - 1, 1] + move[1, 1]) + e[i]]
    assert np.isclose(alone[0][-1], 1 / (1 + np.exp(f[-1, 0] - f[-1, 1])))


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(2)
    length = np.array([6, 1, 4])
    mask = np.arange(6) < length[:, None]
    e, y = rng.normal(size=mask.shape) * mask, (rng.random(mask.shape) < 0.4) & mask
    y = y.astype(int)
    start, move = 0.2, rng.normal(size=(2, 2))
    value, at_e, at_s, at_m = toxicity.likelihood(e, mask, y, start, move)
    brute = sum(
        start * y[r, 0] + (e[r, :n] * y[r, :n]).sum() + sum(move[y[r, i - 1], y[r, i]] for i in range(1, n)) - brute_marginals(e[r, :n], start, move)[1] for r, n in enumerate(length)
    )
    assert np.isclose(value, brute)
    h = 1e-5
    for r, i in ((0, 0), (0, 3), (1, 0), (2, 3)):
        more = e.copy()
        more[r, i] += h
        assert np.isclose((toxicity.likelihood(more, mask, y, start, move)[0] - value) / h, at_e[r, i], atol=1e-3)
    assert np.isclose((toxicity.likelihood(e, mask, y, start + h, move)[0] - value) / h, at_s, atol=1e-3)
    for p, q in itertools.product((0, 1), repeat=2):
        more = move.copy()
        more[p, q] += h
        assert np.isclose((toxicity.likelihood(e, mask, y, start, more)[0] - value) / h, at_m[p, q], atol=1e-3)


def test_toxic_documents_are_found_in_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op12_query(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    clean = [r.predicted for r in rows if not r.toxic]
    english = [r.predicted for r in rows if r.toxic and r.lang == "en"]
    assert np.mean(clean) < 0.02 and np.mean(english) > 0.8
    # what is tagged are the few words that make documents toxic, not their surroundings
    tagged = [r.text[int(a) : int(b)].lower() for r in rows if r.toxic and r.lang == "en" for a, b in (s.split(":") for s in r.spans.split(",") if s)]
    most = [w for w, _ in sorted(((w, tagged.count(w)) for w in set(tagged)), key=lambda x: -x[1])][:10]
    assert {"idiot", "trash", "scum", "moron"} <= set(most)


def test_toxicity_takes_awkward_rows(awkward, empty, spark):
    labels = spark.createDataFrame([(1, None, 1), (1, None, 0), (2, None, 0), (5, None, 1), (9, None, 0), (None, None, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    got = sorted_rows(toxicity.op12_query(awkward, labels))
    assert len(got) == awkward.count() and all(0 <= r[2] <= 1 for r in got)
    same = [r for r in got if r[0] == 2]
    assert same[0] == same[1]
    assert toxicity.op12_query(empty, labels).count() == 0
    unlabelled = toxicity.op12_query(awkward, labels.filter("false")).collect()
    assert {r.score for r in unlabelled} == {0.5} and {r.spans for r in unlabelled} == {""}
