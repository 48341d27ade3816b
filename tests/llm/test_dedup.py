"""SimHash, MinHash, suffix trees and suffix arrays against brute force."""

import hashlib
import tempfile
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest_llm import rows_of, sorted_rows

from tidemark.llm import minhash, repeats, simhash, suffix_arrays, suffix_trees
from tidemark.llm.common import Hasher


def simhash_of(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def components_of(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_simhash_components(which, request):
    docs = request.getfixturevalue(which)
    rows = rows_of(docs)
    prints = [simhash_of(t) for _, t in rows]
    roots = components_of(prints)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted([(i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots, strict=True)], key=repr)
    assert sorted_rows(simhash.op1_query(docs)) == want


def test_trie_links_near_prints_even_when_roots_are_split(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    prints = {int(s) for s in seeds}
    for s in seeds[:20]:
        for _ in range(30):
            bits = rng.choice(64, rng.integers(1, 5), replace=False)
            prints.add(int(s) ^ sum(1 << int(b) for b in bits))
    prints |= {int(rng.integers(0, 1 << 40)) for _ in range(300)}
    unsigned = sorted(p & ((1 << 64) - 1) for p in prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in unsigned]
    want = components_of(unsigned)
    for wide in (simhash.WIDE_ROOT, 20):
        links = [tuple(r) for r in simhash.links(spark.createDataFrame(signed, "fp long"), wide).collect()]
        at = {p[0]: i for i, p in enumerate(signed)}
        parent = list(range(len(signed)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in links:
            assert ((u ^ v) & ((1 << 64) - 1)).bit_count() <= 64
            a, b = find(at[u]), find(at[v])
            parent[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(signed))] == want


def test_keep_one_keeps_one_row_of_each_group(awkward, empty):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    prints = [simhash_of(r["text"]) for r in kept.collect()]
    assert len(prints) == len(set(components_of([simhash_of(t) for _, t in rows_of(awkward)])))
    assert len(set(components_of(prints))) == len(prints)
    assert simhash.keep_one(empty).count() == 0 and simhash.op1_query(empty).count() == 0


def words5(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_minhash_rows(which, request):
    docs = request.getfixturevalue(which)
    got = minhash.op3_query(docs).collect()
    keyed = [(r["id"], r["th"], r["doc_id"], r["text"] or "") for r in minhash.keyed(docs).collect()]
    keyed.sort(key=lambda r: r[:2])
    want = Counter()
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    close, beside, text_of = {}, {}, {}
    for k, (_, _, i, t) in enumerate(keyed):
        after = keyed[(k + 1) % len(keyed)][3]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        row = (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        want[row] += 1
        text_of[row] = t
        close.setdefault(row, []).append(jaccard(words5(t), words5(edited)))
        beside.setdefault(row, []).append(jaccard(words5(t), words5(after)))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {}
    for r in got:
        row = (r["doc_id"], r["n_chars"], r["edited_sha256"])
        prints.setdefault(text_of[row], set()).add(r["fingerprint"])
        assert min(abs(r["near_edited"] - j) for j in close[row]) < 0.2 and min(abs(r["near_next"] - j) for j in beside[row]) < 0.2
        assert 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == 4 * minhash.SLOTS
    # equal texts have one fingerprint, and texts that differ in a tenth of their shingles do not share one
    assert all(len(v) == 1 for v in prints.values())
    by_print = {}
    for t, v in prints.items():
        by_print.setdefault(next(iter(v)), []).append(words5(t))
    assert all(jaccard(a, b) >= 0.9 for group in by_print.values() for a, b in zip(group, group[1:], strict=False))


def test_minhash_pairs_are_all_similar_pairs(documents, empty):
    texts = {t or "" for _, t in rows_of(documents)}
    sets = {t: words5(t) for t in texts}
    listed = sorted(texts)
    want = sum(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and bool(sets[a] | sets[b]) for i, a in enumerate(listed) for b in listed[:i])
    assert minhash.near_pairs(documents).count() == want
    assert minhash.op3_query(empty).count() == 0


def test_suffix_trees_match_sql(spark, documents):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(suffix_trees.OP2_SQL).fetchall(), key=repr)
    assert sorted_rows(suffix_trees.remove_repeats(documents)) == want


def removed_words(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    ids = [(1 << 63) - 1 if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(ids, split, strict=True):
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for (doc, _), i, w in zip(rows, ids, split, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed_bytes(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    ids = [(1 << 63) - 1 if i is None else i for i, _ in rows]
    seen, first = Counter(), {}
    for i, t in zip(ids, texts, strict=True):
        for s in range(len(t) - window + 1):
            k = t[s : s + window]
            seen[k] += 1
            first[k] = min(first.get(k, i), i)
    out = []
    for (doc, _), i, t in zip(rows, ids, texts, strict=True):
        gone, later = np.zeros(len(t) + 1, np.int64), np.zeros(len(t) + 1, np.int64)
        for s in range(len(t) - window + 1):
            for edge, told in ((gone, seen[t[s : s + window]] > 1), (later, first[t[s : s + window]] < i)):
                if told:
                    edge[s] += 1
                    edge[s + window] -= 1
        mask = np.cumsum(gone)[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(t, np.uint8)[~mask].tobytes()).hexdigest()
        out.append((doc, len(t), int(mask.sum()), spans, int((np.cumsum(later)[: len(t)] > 0).sum()), kept))
    return sorted(out, key=repr)


def test_planted_passages_are_removed_and_clean_documents_left_alone(spark):
    """Passages of 400 bytes and more in many documents: all their bytes go, the first holder is known, nothing else goes."""
    rng = np.random.default_rng(8)
    draw = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 10))) for _ in range(n))
    passages = [draw(70)[:n].strip().ljust(n, "x") for n in (400, 401, 430, 455)]
    rows, planted = [], {}
    for i in range(120):
        p = passages[i % 5] if i % 5 < 4 else None
        rows.append((i, f"{draw(40)}<{p}>{draw(40)}" if p else draw(150)))
        planted[i] = len(p) + 2 if p else 0
    want = removed_bytes(rows, 400)
    # some neighbours of a passage are equal by chance, never many
    assert all(planted[i] <= n_removed <= planted[i] + 8 * (planted[i] > 0) for i, _, n_removed, *_ in want)
    assert {(n_later > 0) for i, *_, n_later, _ in want if planted[i] and i >= 5} == {True} and all(r[4] == 0 for r in want if r[0] < 5)
    for common in (repeats.COMMON, 2):
        assert sorted_rows(suffix_arrays.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), common=common)) == want


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    """Bytes, not words, are the contract's measure: 399 of them stay, 400 go, from both holders; its columns come first."""
    words = [f"{chr(97 + i % 26)}{i:02}{'xyz'[: 2 + i % 2]}" for i in range(66)]
    passages = [" ".join(words)[:n] for n in (399, 400)]
    assert all(len(p) == n and len(p.split()) > 50 for p, n in zip(passages, (399, 400), strict=True))
    rows = [(4 * k + i, f"{a}{p}{z}") for k, p in enumerate(passages) for i, (a, z) in enumerate((("(", ")"), ("[", "]")))]
    rows = [(i, t if i < 4 else t.upper()) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_arrays.op8_query(docs)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_later"]
    assert {r.doc_id: (r.n_removed, r.n_later) for r in found.collect()} == {0: (0, 0), 1: (0, 0), 4: (400, 0), 5: (400, 400)}
    assert {r.doc_id: r.n_removed > 0 for r in suffix_trees.remove_repeats(spark.createDataFrame([(i, f"{t[0]} {t[1:-1]} {t[-1]}") for i, t in rows], docs.schema)).collect()} == {0: False, 1: True, 4: False, 5: True}


def later_bytes(rows, window):
    """Per row, the bytes in a string of ``window`` bytes that a smaller document holds too."""
    return sorted([(doc, n, later) for doc, n, _, _, later, _ in removed_bytes(rows, window)], key=repr)


def with_passages(docs, passage=suffix_arrays.PASSAGE, **how):
    found = suffix_arrays.remove_repeats(docs, passage=passage, **how).collect()
    return sorted([tuple(r)[:-1] for r in found], key=repr), sorted([(r.doc_id, r.n_bytes, r.n_passage) for r in found], key=repr)


def test_passages_of_over_50_words_under_400_bytes_are_shown_and_stay(spark):
    """The registered query: passages of 51 to 66 words in many documents are in ``n_passage``, only 400 bytes are removed."""
    from tidemark.llm import queries

    rng = np.random.default_rng(3)
    draw = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(4, 8))) for _ in range(n))
    passages = [draw(n) for n in (51, 52, 54, 66)]
    assert [len(p.encode()) < 400 for p in passages] == [True, True, True, False]
    rows = [(i, f"{draw(60)} {passages[i % 5]} {draw(60)}" if i % 5 < 4 else draw(170)) for i in range(60)]
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    found = queries.QUERIES["op8_suffix_array_dedup"](spark, path)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_later", "n_passage"]
    found = found.collect()
    assert {(r.doc_id % 5 < 4 and r.doc_id >= 5) == (r.n_passage > 0) for r in found} == {True}
    assert all(r.n_passage >= len(passages[r.doc_id % 5]) for r in found if r.n_passage)
    assert {r.doc_id % 5 for r in found if r.n_removed} == {3}
    assert sorted([(r.doc_id, r.n_bytes, r.n_passage) for r in found], key=repr) == later_bytes(rows, suffix_arrays.PASSAGE)


@pytest.mark.parametrize("passage", [60, 240, 399, 400])
@pytest.mark.parametrize("common", [repeats.COMMON, 2])
def test_passages_leave_removal_as_it_is(documents, awkward, passage, common):
    """Removal by fragments that reach beyond their windows equals the brute force, and so do the shorter strings."""
    for docs in (documents, awkward.filter("doc_id IS NULL OR doc_id NOT IN (9, 10)")):
        rows = rows_of(docs)
        assert with_passages(docs, passage, common=common) == (removed_bytes(rows, 400), later_bytes(rows, passage))


def test_passages_in_rows_cut_in_pieces(awkward, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    rows = rows_of(awkward)
    assert with_passages(awkward) == (removed_bytes(rows, 400), later_bytes(rows, suffix_arrays.PASSAGE))


@pytest.mark.parametrize("common", [repeats.COMMON, 2])
def test_repeats_in_awkward_rows(awkward, common):
    """Also with nearly every repeated anchor set back as too common."""
    small = awkward.filter("doc_id IS NULL OR doc_id NOT IN (9, 10)")
    rows = rows_of(small)
    assert sorted_rows(suffix_trees.remove_repeats(small, common=common)) == removed_words(rows, 50)
    assert sorted_rows(suffix_arrays.remove_repeats(small, common=common)) == removed_bytes(rows, 400)


def test_repeats_in_long_rows_are_cut_in_pieces(awkward, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 5_000)
    rows = rows_of(awkward)
    assert sorted_rows(suffix_trees.remove_repeats(awkward)) == removed_words(rows, 50)


def test_suffix_arrays_match_brute_force(documents, empty):
    assert sorted_rows(suffix_arrays.remove_repeats(documents)) == removed_bytes(rows_of(documents), 400)
    assert suffix_arrays.remove_repeats(empty).count() == 0 and suffix_trees.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_cover_ranks_sort_suffixes(letters):
    rng = np.random.default_rng(letters)
    text = rng.integers(97, 97 + letters, 3000).astype(np.uint8)
    text[1500:2200] = text[100:800]
    starts = np.arange(len(text) - 399)
    order = suffix_arrays.sorted_suffixes(text, starts, 400)
    keys = [text[s : s + 400].tobytes() for s in order]
    assert keys == sorted(keys)
    count = Counter(keys)
    assert suffix_arrays.repeats_in(text, starts, 400).tolist() == [count[text[s : s + 400].tobytes()] > 1 for s in starts]


def test_difference_cover_meets_every_pair():
    cover, period = suffix_arrays.difference_cover()
    assert (suffix_arrays.shifts(cover, period) >= 0).all()


def test_subtree_finds_equal_windows():
    values = Hasher().grams(np.arange(200, dtype=np.uint64) % 70, 1)
    starts = np.arange(0, 140)
    alive, node = suffix_trees.subtree(values, starts, np.zeros(len(starts), np.int64))
    assert set(alive.tolist()) == {s for s in starts.tolist() if s < 70 or s >= 70} and len(set(node.tolist())) == 70


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_words_that_a_polynomial_hash_takes_for_equal(spark):
    """Two words of 1,024 letters, one the complement of the other, and words that differ in one far byte."""
    from tidemark.llm import decontaminate, token_files
    from tidemark.llm.common import Hasher, raw

    one, two = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    column = pa.array([one, two, "x" * 5000, "x" * 4999 + "y", "x" * 70 + "ab" + "x" * 70, "x" * 70 + "ba" + "x" * 70])
    flat, offs = raw(column)
    assert len(set(Hasher().spans(flat, offs[:-1], offs[1:]).tolist())) == len(column)
    rest = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"{rest} {one} {rest}"), (2, f"{rest} {two} {rest}")], "doc_id long, text string")
    assert {r.n_removed for r in suffix_trees.remove_repeats(docs).collect()} == {0}
    items = spark.createDataFrame([("i", f"{' '.join(rest.split()[:6])} {one} {' '.join(rest.split()[:6])}")], "item_id string, text string")
    found = {r.doc_id: r.n_hit for r in decontaminate.op9_query(spark.createDataFrame([(1, items.first().text), (2, items.first().text.replace(one, two))], "doc_id long, text string"), items).collect()}
    assert found == {1: 13, 2: 0}
    ids = {r.doc_id: r.ids_crc32 for r in token_files.op10_query(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")).collect()}
    assert ids[1] != ids[2]
