"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the base patterns' matches (those that fail their check too) and looser forms. Five
labelers vote on each (+1, 0, -1): the pattern's own check, gazetteers, words before it, its edges
and its length. Counts of vote patterns - a table bounded by the number of patterns, not by the
data - go to an expectation-maximisation that estimates how far each labeler is to be trusted per
kind; its posteriors train a logistic span classifier on the span's own features. Base spans always
stay; others are added where the classifier says so and no base span overlaps.

Positions come from what lies between the matches (``split``) and the matches themselves. Patterns
that repeat are possessive and start where a run starts, or where the last match ended, so long
runs cost linear time and no deep stack; the matches are those of the plain patterns.

Rows: a null text is empty; positions are code points, end exclusive; repeated rows get equal
results; without candidates nothing is trained; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: Kind, pattern, and what a text must hold for it to be tried. The first four are the base forms.
FORMS = (
    (0, rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    (1, r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]"),
    (2, r"[0-9](?:[\x20-]?[0-9])++", "[0-9]"),
    (3, r"\+[0-9][\x20().0-9-]+[0-9]", "[+]"),
    (0, rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[(\[]at[)\]]"),
    (3, r"(?<![\w+.])(?<![0-9][\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w])(?![.-][0-9])", "[0-9]"),
)
BASE_FORMS = 4
#: Gazetteers and context words.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "uk", "us", "eu", "ch", "at", "it", "nl")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91")
CUES = (r"(?i)mail|contact|write|kontakt|correo", r"(?i)\bip\b|host|server|addr", r"(?i)card|visa|credit|karte|carte|tarjeta", r"(?i)tel|phone|call|fax|mobil|ruf")
FALSE_CUES = r"(?i)version|isbn|release|section|figure|build"
LENGTHS = ((6, 64), (7, 15), (13, 23), (8, 22))
LABELERS = ("pattern", "gazetteer", "context", "edges", "length")
FEATURES = ("email", "ip", "card", "phone", "checked", "listed", "edges", "usual", "cued")
LEFT = 24
ROUNDS, STEPS, RATE = 40, 400, 0.5
#: An added span needs this probability.
SURE = 0.9


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def passes(kind: int, match: Column) -> Column:
    """The check of a base form."""
    if kind == 1:
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda x: F.when(F.length(part(x)) <= 3, F.concat(F.lit("0"), part(x)).cast("int") <= 255).otherwise(False))
    if kind == 2:
        d = _digits(match)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == 3:
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _votes(kind: int, form: int, match: Column, before: Column, after: Column, ok: Column) -> Column:
    vote = lambda good, bad=None: F.when(good, 1).when(bad if bad is not None else ~good, -1).otherwise(0)
    d = _digits(match)
    if kind == 0:
        listed = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS)
    elif kind == 1:
        listed = ~F.regexp_extract(match, "^0*([0-9]*)", 1).isin("", "10", "127", "255")
    elif kind == 2:
        listed = d.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65)")
    else:
        listed = F.lit(form < BASE_FORMS) & d.rlike(f"^({'|'.join(CALLING)})")
    low, high = LENGTHS[kind]
    edges = ~before.rlike(r"[\w.@+-]$") & ~after.rlike(r"^[\w@+]")
    return F.array(
        vote(ok) if form < BASE_FORMS else F.lit(0),
        vote(listed),
        vote(before.rlike(CUES[kind]), before.rlike(FALSE_CUES)),
        vote(edges),
        vote(F.length(match).between(low, high)),
    )


def _candidate(form: int, kind: int):
    """A match and its start to a candidate."""

    def one(x: Column, s: Column) -> Column:
        match, before = x["m"], F.right(x["p"], F.lit(LEFT))
        ok = passes(kind, match)
        return F.struct(
            F.lit(kind).alias("kind"), s.alias("s"), (s + F.length(match)).alias("e"),
            (ok if form < BASE_FORMS else F.lit(False)).alias("base"), F.lit(form >= BASE_FORMS).alias("loose"),
            _votes(kind, form, match, before, x["a"], ok).alias("votes"),
        )

    return one


#: Matches whose running positions are gathered in one array; one number is carried from one such run to the next.
RUN = 256


def _starts(z: Column) -> Column:
    """Start of every match of ``z`` (text before it, match). Appending copies an array, so arrays stay short: work grows with matches."""
    step = lambda x: F.length(x["p"]) + F.length(x["m"])
    none = F.array().cast("array<int>")

    def walked(part: Column, begin: Column) -> Column:
        walk = lambda acc, x: F.struct((acc["end"] + step(x)).alias("end"), F.array_append(acc["at"], acc["end"] + F.length(x["p"])).alias("at"))
        return F.aggregate(part, F.struct(begin.alias("end"), none.alias("at")), walk, lambda acc: acc["at"])

    runs = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / RUN).cast("int"))
    part = lambda j: F.slice(z, j * RUN + 1, F.lit(RUN))
    sizes = F.transform(runs, lambda j: F.aggregate(part(j), F.lit(0), lambda total, x: total + step(x)))
    begins = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    long = F.flatten(F.transform(F.arrays_zip(runs.alias("j"), F.slice(begins, F.lit(1), F.size(runs)).alias("b")), lambda r: walked(part(r["j"]), r["b"])))
    return F.when(F.size(z) <= RUN, walked(z, F.lit(0))).otherwise(long)


def _overlaps(x: Column, spans: Column) -> Column:
    """Whether ``x`` overlaps one of ``spans``, disjoint and in order: the last one that starts before its end decides."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_ = acc["lo"] < acc["hi"]
        before = open_ & (F.get(spans, mid)["s"] < x["e"])
        return F.struct(F.when(before, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~before, mid).otherwise(acc["hi"]).alias("hi"))

    begin = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(32)), begin, halve, lambda acc: acc["lo"] - 1)
    few = F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    return F.when(F.size(spans) <= 16, few).otherwise(F.coalesce(F.when(last >= 0, F.get(spans, last)["e"] > x["s"]), F.lit(False)))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``found``: every candidate's kind, place, votes and whether it is a base span."""
    text = F.coalesce("text", F.lit(""))
    matched, between = {}, {}
    for i, (_, pattern, needs) in enumerate(FORMS):
        there = text.rlike(needs)
        matched[f"m{i}"] = F.when(there, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))
        between[f"p{i}"] = F.when(there, F.split(text, pattern, -1)).otherwise(F.array(F.lit("")))
    cut = docs.select("doc_id", *(c.alias(n) for n, c in {**matched, **between}.items()))
    zipped = {}
    for i in range(len(FORMS)):
        m, p = F.col(f"m{i}"), F.col(f"p{i}")
        # what stands before each match, the match, and what stands after it
        zipped[f"z{i}"] = F.arrays_zip(F.slice(p, 1, F.size(m)).alias("p"), m.alias("m"), F.transform(F.slice(p, 2, F.size(m)), lambda x: F.substring(x, 1, 1)).alias("a"))
    zipped = cut.select("doc_id", *(c.alias(n) for n, c in zipped.items()))
    found = []
    for i, (kind, _, _) in enumerate(FORMS):
        at = _starts(F.col(f"z{i}"))

        found.append(F.when(F.size(f"z{i}") > 0, F.zip_with(f"z{i}", at, _candidate(i, kind))).otherwise(F.array().cast("array<struct<kind:int,s:int,e:int,base:boolean,loose:boolean,votes:array<int>>>")))
    return zipped.select("doc_id", F.concat(*found).alias("found"))


def features(kind: int, votes: list[int]) -> list[float]:
    """What the span classifier sees: the kind, and for the span's own traits whether they hold."""
    return [float(kind == k) for k in range(len(KINDS))] + [float(votes[0] > 0), float(votes[1] > 0), float(votes[3] > 0), float(votes[4] > 0), float(votes[2])]


def estimate(patterns: list[tuple[int, tuple[int, ...], int]]) -> tuple[dict, dict]:
    """EM over counted vote patterns. Per kind: the share of true spans with each labeler's vote
    distributions, and the posterior of every pattern."""
    trust, posterior = {}, {}
    for kind in range(len(KINDS)):
        own = [(v, n) for k, v, n in patterns if k == kind]
        if not own:
            continue
        q = {v: min(0.95, max(0.05, 0.5 + sum(v) / (2 * len(v)))) for v, _ in own}
        for _ in range(ROUNDS):
            prior = (1 + sum(q[v] * n for v, n in own)) / (2 + sum(n for _, n in own))
            table = {}
            for z in (1, 0):
                for j in range(len(LABELERS)):
                    # smoothing leans on each labeler being right more often than not
                    weight = {x: 4.0 if (x > 0) == (z == 1) and x else 1.0 for x in (-1, 0, 1)}
                    for v, n in own:
                        weight[v[j]] += n * (q[v] if z else 1 - q[v])
                    total = sum(weight.values())
                    table[z, j] = {x: w / total for x, w in weight.items()}
            for v, _ in own:
                yes = math.log(prior) + sum(math.log(table[1, j][x]) for j, x in enumerate(v))
                no = math.log(1 - prior) + sum(math.log(table[0, j][x]) for j, x in enumerate(v))
                q[v] = 1 / (1 + math.exp(min(50.0, max(-50.0, no - yes))))
        trust[kind] = (prior, table)
        posterior.update({(kind, v): q[v] for v, _ in own})
    return trust, posterior


def train(patterns: list[tuple[int, tuple[int, ...], int]], posterior: dict) -> list[float]:
    """Logistic weights on the features (the last is the bias), fitted to the posteriors."""
    rows = [([*features(k, v), 1.0], posterior[k, v], n) for k, v, n in patterns]
    total = sum(n for *_, n in rows)
    w = [0.0] * (len(FEATURES) + 1)
    for _ in range(STEPS if rows else 0):
        step = [1e-3 * a for a in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for j, b in enumerate(x):
                step[j] += n / total * (p - y) * b
        w = [a - RATE * s for a, s in zip(w, step, strict=True)]
    return w


def _probability(x: Column, w: list[float]) -> Column:
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    v = x["votes"]
    seen = [one(x["kind"] == k) for k in range(len(KINDS))] + [one(v[i] > 0) for i in (0, 1, 3, 4)] + [v[2].cast("double"), F.lit(1.0)]
    total = F.lit(0.0)
    for a, c in zip(w, seen, strict=True):
        total = total + F.lit(a) * c
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _listed(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def _of_kind(kind: int):
    return lambda x: x["kind"] == kind


def find_private(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row."""
    found = stored(candidates(docs), "candidates")
    counted = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes").agg(F.count("*").alias("n"))
    patterns = sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counted.collect())
    weights = train(patterns, estimate(patterns)[1])
    base = F.array_sort(F.transform(F.filter("found", lambda x: x["base"]), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    marked = found.select("doc_id", base.alias("base"), F.filter("found", lambda x: x["loose"] & (_probability(x, weights) >= SURE)).alias("more"))
    # base spans of one kind are disjoint
    marked = marked.select("*", *(F.filter("base", _of_kind(k)).alias(f"base_{k}") for k in range(len(KINDS))))
    taken = lambda x: reduce(or_, (_overlaps(x, F.col(f"base_{k}")) for k in range(len(KINDS))))
    free = F.filter("more", lambda x: ~taken(x))
    added = marked.select("doc_id", "base", F.when(F.size("more") > 0, F.transform(free, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))).otherwise(F.slice("base", 1, 0)).alias("more"))
    counts = [_count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return added.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "more"))).alias("spans"))
