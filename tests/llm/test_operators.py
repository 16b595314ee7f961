"""Each operator against a brute-force version on small fixtures: nulls, empty and long texts, ties, repeats, empty
tables and extra columns."""

import collections
import gc
import hashlib
import os
import random
import re
import threading
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from inkfield.llm import common, components, exact, html_cut, jaccard, mixing, packing, quality, queries, repeats, sharding, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(3, 120)) for _ in range(30)]
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(base)]
    rows += [(100 + k, base[0], "de", None) for k in range(12)]  # copies in another source
    for k in range(20):  # near copies
        w = base[1 + k % 3].split(" ")
        for _ in range(1 + k % 4):
            w[rng.randrange(len(w))] = "changed"
        rows.append((200 + k, " ".join(w), "fr", "s1"))
    rows += [(300, None, "en", "s0"), (301, "", None, "s0"), (302, " \n\t", "en", "s2"), (303, "one", "en", "s2"), (304, "a b c d", "en", "s2"), (305, "A  b\nc d", "en", "s2")]
    rows += [(7, base[7], "en", "s1"), (7, base[7], "en", "s1"), (None, base[5], "en", "s0"), (306, "x" * 30_000, "en", "s0"), (307, base[0].replace(" ", "\n") + " ", "en", "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # extra columns whose names operators use inside
    rows = [(*r, "extra", 1, 2) for r in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string, token int, sid int").repartition(3)


EMPTY = "doc_id long, text string, lang string, source string"


def test_exact_groups(docs, corpus):
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = sorted(
        ((i, min(g)[3], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, _, _, i in g), key=str
    )
    got = exact.exact_groups(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_keeps_one_row_of_each_class(docs):
    got = exact.exact_dedup(docs)
    assert got.columns == docs.columns
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in got.collect()]
    assert len(norm) == len(set(norm)) == exact.exact_groups(docs).filter("kept").count()


def test_exact_stronger_identifiers_when_names_collide(docs, monkeypatch):
    want = sorted(map(str, exact.exact_groups(docs).drop("text_sha256").collect()))
    from pyspark.sql import functions as F

    weak = lambda c: F.unhex(F.substring(F.md5(c), 1, 2))
    monkeypatch.setattr(exact, "IDENTIFIERS", (weak, *exact.IDENTIFIERS[1:]))
    assert not exact.conflicts(docs, weak).isEmpty()
    assert sorted(map(str, exact.exact_groups(docs).drop("text_sha256").collect())) == want


def jaccard_truth(rows):
    sets = {}
    for k, (_, t, *_) in enumerate(rows):
        w = WORD.findall((t or "").translate(UPPER))
        sets[k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k in sets:
        ids = [rows[j][0] for j in sets if find(j) == find(k) and rows[j][0] is not None]
        least[k] = min(ids) if ids and sets[k] else rows[k][0]
    return sorted(((rows[k][0], len(sets[k]), least[k]) for k in sets), key=str)


def test_jaccard_components(docs, corpus):
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=str) == jaccard_truth(corpus)


@pytest.mark.parametrize("few", [0, 4])
def test_jaccard_hot_tokens_and_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)  # 0: rounds of leaders first
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "LEADERS", 2)
    rng = random.Random(9)
    passage = prose(rng, 40).split(" ")
    rows = []
    for k in range(60):  # chains of near copies, and texts that share only a passage
        w = list(passage)
        if k % 3 == 0:
            w += prose(rng, rng.randint(0, 60)).split(" ")
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"w{rng.randrange(6)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str) == jaccard_truth(rows)


def test_jaccard_families_leave_out_sets_with_much_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 3)
    compared, real = [], jaccard.block_links
    monkeypatch.setattr(jaccard, "block_links", lambda members, *a: compared.extend(members.collect()) or real(members, *a))
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [(k, f"{passage} {prose(rng, 100)}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str) == jaccard_truth(rows)
    assert not compared


def test_jaccard_rarest_rows(spark):
    rng = random.Random(5)
    sets = {k: sorted(rng.sample(range(30), rng.randint(1, 12))) for k in range(80)}
    sets |= {k + 100: sorted({*s[1:], 99} if k % 2 else {*s, 99}) for k, s in list(sets.items())[:40]}
    df = spark.createDataFrame([(k, np.array(s, np.uint64).tobytes()) for k, s in sets.items()], "sid long, tokens binary")
    got = {k: set() for k in sets}
    for r in jaccard.rarest_rows(df, 80).collect():
        got[r.sid].add(r.token)
    assert all(got[k] <= set(s) and len(got[k]) <= len(s) - jaccard.need(len(s)) + 1 for k, s in sets.items())
    linked = [(a, b) for a in sets for b in sets if a < b and 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))]
    assert linked and all(got[a] & got[b] for a, b in linked)


def test_one_of_each(docs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    named = jaccard.jaccard_components(docs).collect()
    rows = collections.Counter(r.doc_id for r in kept.collect())
    assert set(rows) == {r.component_id for r in named} and set(rows.values()) == {1}


def test_one_of_each_of_rows_under_one_name(spark):
    rng = random.Random(14)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(7, a), (7, a), (7, b), (3, b + " tail"), (None, c), (None, c), (None, c + " tail"), (9, None), (9, ""), (None, ""), (None, "")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # the texts under 7 are in two groups; a group without names keeps one row; every name with an empty text stays once
    assert collections.Counter((r.doc_id, (r.text or "")[:60]) for r in kept) in (
        {(7, a[:60]): 1, (3, b[:60]): 1, (None, c[:60]): 1, (9, ""): 1, (None, ""): 1},
    )


CLASHING = "row int, id int, __id int, sha int, __sha int, n int, __n int, key int, at int, word int, mask int, __at int, __word int, keep_id int, __keep int, tid int, u int, v int, pid int, size int, kept int, `a.b` int"


def test_columns_with_any_name_pass_through(spark, corpus):
    names = len(CLASHING.split(","))
    df = spark.createDataFrame([(i, t, s, *range(k, k + names)) for k, (i, t, _, s) in enumerate(corpus)], f"doc_id long, text string, source string, {CLASHING}")
    for run in (exact.exact_dedup, jaccard.one_of_each, mixing.mixed_rows):
        got = run(df)
        assert got.columns == df.columns
        for r in got.collect():
            first = r[3]
            assert corpus[first][0] == r.doc_id and corpus[first][1] == r.text and list(r[3:]) == list(range(first, first + names))


def test_names_may_be_texts(spark, corpus):
    df = spark.createDataFrame([(None if i is None else f"d{i:04}", t, s, g) for i, t, g, s in corpus], "doc_id string, text string, source string, lang string")
    labels = spark.createDataFrame([(f"d{k:04}", k % 2, k % 2) for k in range(20)], "doc_id string, quality int, toxic int")
    want = sorted(((None if i is None else f"d{i:04}", n, None if c is None else f"d{c:04}") for i, n, c in jaccard_truth(corpus)), key=str)
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str) == want
    for run in (exact.exact_groups, repeats.remove_repeats, mixing.mix_documents, sharding.shard_documents):
        assert run(df).count() == len(corpus)
    assert packing.pack_documents(df).select("doc_id").distinct().count() == len({i for i, *_ in corpus})
    held = {r.doc_id: r.held_out for r in toxicity.score_documents(df, labels).collect()}
    assert all(h == (i is None or zlib.crc32(i.encode()) % 3 == 1) for i, h in held.items())
    assert quality.rules(df, labels).count() == len(corpus)


@pytest.mark.parametrize("local", [0, 200_000])
def test_components(spark, local, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = random.Random(2)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 140)] + [(None, 3), (5, 5), (200, 201), (200, 201)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}


def repeats_truth(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    count = collections.Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for (i, *_), b in zip(rows, texts):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("members", [2048, 4])
def test_repeats(spark, corpus, members, monkeypatch):
    monkeypatch.setattr(repeats, "MEMBERS", members)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long = text(330)
    rows = [(k, text(rng.randint(0, 120)) + long[rng.choice([0, 0, 7]) : rng.choice([330, 330, 300])] + text(rng.randint(0, 120))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "a" * 900), (103, "ab" * 300), (104, rows[3][1]), (104, rows[3][1]), (None, rows[5][1][:250]), (106, "é" * 250)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, repeats.remove_repeats(df).collect()), key=str) == repeats_truth(rows, 200)


def test_base_counts():
    rng = random.Random(3)
    texts = ["\n".join(prose(rng, rng.randint(0, 6)) + rng.choice(["", " #", "$%"]) for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "", "\n\n", "a\na\n a\na", "x y z x y z", "x y z x y", "a a a a"]
    got = quality.base_counts(pa.array(texts))
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        cov = {j + d for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for d in range(3)}
        assert [int(got[n][k]) for n in quality.COUNTS] == [len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), dup, len(cov)], t


def test_quality_learns_and_keeps_clean_documents(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(240):
        good = k % 3 > 0
        t = prose(rng, 80)
        rows.append((k, t if good else t.replace(" ", "!! ").upper(), 0))
        if k % 2:
            labels.append((k, int(good)))
    rows += [(900, None, 0), (901, "few words", 0), (902, "a b c " * 40, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in quality.rules(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all(got[k].kept == (k % 3 > 0) for k in range(240))
    assert not any(got[k].kept for k in (900, 901, 902)) and all(got[k].base_failed for k in (900, 901, 902))
    kept = quality.kept_documents(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [k for k in range(240) if k % 3]


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        w = prose(rng, 40).split(" ")
        bad = k % 5 == 0
        if bad:
            w[rng.randrange(40)] = rng.choice(["Nasty!", "vile", "VILE,", "nasty"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "vile")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    for k in range(600):
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
    held = [k for k in range(600) if got[k].held_out]
    assert np.mean([got[k].predicted == (k % 5 == 0) for k in held]) > 0.97
    assert got[1000].score == got[1001].score < 0.7 and 0 <= got[1000].score <= 1


def test_learned_operators_without_labels(spark):
    df = spark.createDataFrame([(1, "a b " * 30)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(df, none).first().score == 0.0
    assert quality.rules(df, none).count() == 1


def test_mixing(docs, corpus):
    got = mixing.mix_documents(docs, docs.columns).select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "times").collect()
    assert len(got) == len(corpus)
    by = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        x = by[r.source]
        x[0] += r.size
        x[1] += r.taken
        x[2] = r.target
        x[3] = max(x[3], r.size)
        assert r.source_size >= r.size and r.taken == r.times * r.size <= 3 * r.size
    want = filled({s: x[0] for s, x in by.items()}, dict(zip(sorted(by, key=lambda s: (s is None, s or "")), [5, 2, 1, 5])))
    for s, (size, taken, target, largest) in by.items():
        assert abs(target - want[s]) < 1e-6
        left = round(target) - taken
        assert left >= 0
        # no document that could be taken once more fits in what is left
        times = [(r.times, r.size) for r in got if r.source == s and r.size]
        assert all(n > min(n for n, _ in times) or z > left or n == 3 for n, z in times)
    again = mixing.mix_documents(docs, docs.columns).select("row.doc_id", "row.text", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix_documents(docs, docs.columns).select("row.doc_id", "row.text", "taken").collect())


def test_mixed_rows_repeat_documents(docs):
    often = {(r.doc_id, r.text): r.times for r in mixing.mix_documents(docs, docs.columns).select("row.doc_id", "row.text", "times").collect() if r.doc_id != 7}
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    count = collections.Counter((r.doc_id, r.text) for r in rows.collect())
    assert all(count[k] == v for k, v in often.items())


def filled(sizes, weights, repeat=3):
    """Targets one source at a time: the lowest cap is met first."""
    out, total, rest = {}, float(sum(sizes.values())), dict(sizes)
    while rest:
        w = sum(weights[s] for s in rest)
        s = min(rest, key=lambda s: repeat * rest[s] / weights[s])
        if total * weights[s] / w <= repeat * rest[s]:
            return out | {s: total * weights[s] / w for s in rest}
        out[s] = float(repeat * rest.pop(s))
        total -= out[s]
    return out


def test_targets_of_many_sources(spark):
    rng = random.Random(31)
    sizes = {f"s{k:04}": rng.choice([0, 1, 5, 50, 4000, 100000]) for k in range(300)}
    weights = {s: float([5, 2, 1][k % 3]) for k, s in enumerate(sorted(sizes))}
    df = spark.createDataFrame([(s, z, weights[s]) for s, z in sizes.items()], "source string, source_size long, weight double")
    want = filled(sizes, weights)
    got = {r.source: r.target for r in mixing.water_fill(df).collect()}
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def cheapest(supply, members, quota, repeat=3):
    """Cost and amount of the min-cost max-flow, by shortest paths of one unit each."""
    edges = []
    for p, w in supply.items():
        edges += [["S", p, w, k * (k + 1) // 2] for k in range(repeat)] + [[p, s, 10**9, 0] for s in members[p]]
    edges += [[s, "T", q, 0] for s, q in quota.items()]
    edges = [e for e in edges] + [[b, a, 0, -c] for a, b, _, c in edges]
    half, cost, flow = len(edges) // 2, 0, 0
    while True:
        dist, via = {"S": 0}, {}
        for _ in range(len(supply) + len(quota) + 2):
            for k, (a, b, cap, c) in enumerate(edges):
                if cap and a in dist and dist[a] + c < dist.get(b, 1e18):
                    dist[b], via[b] = dist[a] + c, k
        if "T" not in dist:
            return cost, flow
        v = "T"
        while v != "S":
            k = via[v]
            edges[k][2] -= 1
            edges[(k + half) % (2 * half)][2] += 1
            v = edges[k][0]
        cost, flow = cost + dist["T"], flow + 1


def test_flow_is_the_cheapest():
    rng = random.Random(32)
    for _ in range(60):
        quota = {("s", k): rng.randint(0, 12) for k in range(rng.randint(1, 4))}
        members = {("p", k): rng.sample(sorted(quota), rng.randint(1, len(quota))) for k in range(rng.randint(1, 4))}
        supply = {p: rng.randint(0, 6) for p in members}
        got = mixing.route(supply, members, quota)
        cost = lambda x, w: sum(k * (k + 1) // 2 * max(0, min(w, x - k * w)) for k in range(3))
        assert all(0 <= x <= 3 * supply[p] for p, x in got.items())
        assert (sum(cost(x, supply[p]) for p, x in got.items()), sum(got.values())) == cheapest(supply, members, quota)
    # b's quota can be met without repetition only if the shared documents go to b
    members = {"pa": ["a"], "pab": ["a", "b"], "pb": ["b"]}
    assert mixing.route({"pa": 100, "pab": 100, "pb": 10}, members, {"a": 100, "b": 110}) == {"pa": 100, "pab": 100, "pb": 10}


def test_mixing_of_a_thousand_overlapping_sources(spark):
    from pyspark.sql import functions as F

    rng = random.Random(33)
    rows = [(k, [f"s{rng.randrange(1000)}" for _ in range(rng.choice([1, 1, 2, 3]))], rng.randint(1, 60)) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, sources array<string>, words long").repartition(3)
    got = mixing.mix(df, F.col("sources"), F.col("words"), (5, 2, 1)).select("row.doc_id", "pattern", "size", "times", "taken").collect()
    assert len(got) == 6000 and all(0 <= r.times <= 3 for r in got)
    # a pattern's documents differ by one pass at most, and what is taken in all is what the flow can bring
    by = collections.defaultdict(list)
    for r in got:
        by[tuple(r.pattern)].append(r)
    assert all(max(r.times for r in x) - min(r.times for r in x) <= 1 for x in by.values())
    sizes = collections.Counter()
    for p, x in by.items():
        for s in p:
            sizes[s] += sum(r.size for r in x)
    target = filled(sizes, {s: float([5, 2, 1][k % 3]) for k, s in enumerate(sorted(sizes))})
    flow = mixing.route({("p", p): sum(r.size for r in x) for p, x in by.items()}, {("p", p): [("s", s) for s in p] for p in by}, {("s", s): round(t) for s, t in target.items()})
    # there are many cheapest flows; all bring the same amount, and whole documents leave less than one of each pattern
    left = sum(flow.values()) - sum(r.taken for r in got)
    assert 0 <= left <= sum(min((r.size for r in x if r.times < 3), default=0) for x in by.values())


def test_mixing_takes_equal_rows_one_by_one(spark):
    rows = [(None, "a b c d e f g h i j", "s0") for _ in range(500)] + [(k, "w " * 40, "s1") for k in range(50)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    by = collections.Counter()
    for r in got:
        by[r.pattern[0], r.target] += r.taken
    assert all(0 <= round(t) - n < (10 if s == "s0" else 40) for (s, t), n in by.items())


def test_sharding(docs, corpus):
    got = sharding.shard_documents(docs).collect()
    size = collections.Counter()
    rows = collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        rows[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in rows.values())
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus), key=str)
    assert {r.law for r in got} == {"bytes"} and set(size) <= set(range(8))


def test_sharding_balances_and_keeps_equal_texts_together(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.randint(20, 60)), rng.choice(["en", "de"]), f"s{rng.randrange(5)}") for k in range(800)]
    rows += [(1000 + k, rows[k // 2][1], "fr", "s9") for k in range(60)]
    rows += [(2000 + k, "copy " * 40, "en", "s0") for k in range(400)]
    got = sharding.shard_documents(spark.createDataFrame(rows, EMPTY)).collect()
    size, shards = collections.Counter(), collections.defaultdict(set)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        size[r.shard] += r.size
        shards[text[r.doc_id]].add(r.shard)
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(size.values()) < 1.03 * mean and min(size.values()) > 0.97 * mean
    assert all(len(s) == 1 for t, s in shards.items() if not t.startswith("copy"))


def pages_fixture():
    head = lambda link: f'<html><head><!-- <link rel=canonical href="http://bad.net/"> --><link href="{link}" rel="canonical"></head><body><p>x</p></body></html>'
    return [
        (1, "http://x.net/a", "<p>x</p>"), (2, "http://a.com/1", head("http://x.net/a")), (3, "http://a.com/2", head("http://a.com/1#top")), (4, "HTTP://B.com", "<p></p>"),
        (5, "https://b.com/#f", '<meta http-equiv="refresh" content="0; url=/next">'), (6, "http://b.com/next", head("http://www.example.com/de/x")),
        (7, "http://c.org/fr/1", head("http://x.net/a")), (8, "http://d.com/", "<p>free</p>"), (9, None, "<p>"), (10, "no scheme", None), (11, "http://x.net", "<p>"), (12, "http://e.com/?q=1", head("c.org")),
        (13, "http://www.example.net/en/z", head("http://y.net/")), (14, "http://f.com/z", head("http://y.net/")), (1, "http://x.net/a", "<p>x</p>"), (15, "http://x.net/", ""),
    ]


def test_urls(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(pages_fixture(), "page_id long, url string, html string")).collect()}
    assert got[1] == ("x.net", "/a", "net/", "block") and got[4][:2] == ("b.com", "") and got[9] == ("", "", None, "allow") and got[10] == ("", "", None, "allow")
    assert got[6][3] == "block"  # its canonical address is blocked
    assert got[5][3] == "block" and got[4][3] == "block"  # a refresh, then one more spelling of the address
    assert got[7] == ("c.org", "/fr/1", "org/fr/", "allow")  # allowed itself
    assert got[2][3] == got[3][3] == "allow"  # a blocked and an allowed alias: the explicit allow wins
    assert got[8][3] == "allow" and got[11] == ("x.net", "", None, "block")  # no path: no rule, but x.net/ is the same address
    assert got[13][2:] == ("example.net/en/", "allow") and got[14][3] == "allow"


def test_html_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header><a href=/>Site</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>A &amp;  B</h1><p>First <b>bold</b>\n text&nbsp;here, with a <a href=x>link</a>.<p>Second<br>line. &lt;tag&gt;</p><aside>Read also: this.</aside>
    <ul><li>item one, short<li>item two</ul><form><input value=1> Subscribe <button>Go</button></form></article>
    <section id="comments"><h2>Comments</h2><p>Nice article, I liked it a lot, thanks for writing.</p></section><footer>&copy; us</footer></body></html>"""
    text, n, kept, _ = html_cut.content(page, html_cut.DEFAULT_SHAPE)
    assert text == "A & B\nFirst bold text here, with a link.\nSecond line. <tag>\nitem one, short\nitem two" and kept < n
    assert html_cut.content(None, html_cut.DEFAULT_SHAPE)[0] == html_cut.content("", html_cut.DEFAULT_SHAPE)[0] == ""
    assert html_cut.content("<p>" * 3000 + "x" + '<a title="' + "y" * 5000, html_cut.DEFAULT_SHAPE)[1] >= 1


def labelling_cost(odds, ties, lab):
    return sum(abs(o) for o, x in zip(odds, lab) if (o > 0) != x) + sum(w for a, b, w in ties if lab[a] != lab[b])


def test_min_cut_is_the_cheapest_labelling():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randint(1, 9)
        odds = [rng.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2, 3]) * rng.random() for _ in range(n)]
        odds += rng.choice([[], [html_cut.SEED], [html_cut.SEED, -html_cut.SEED]])
        n = len(odds)
        ties = [(rng.randrange(n), rng.randrange(n), rng.random() * 2) for _ in range(rng.randint(0, 2 * n))]
        ties = [t for t in ties if t[0] != t[1]]
        best = min(labelling_cost(odds, ties, [bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(labelling_cost(odds, ties, html_cut.min_cut(odds, ties)) - best) < 1e-6


def test_html_pages_have_the_cheapest_labelling():
    rng = random.Random(13)
    turned = 0

    def element(depth):
        tag = rng.choice(["div", "div", "ul", "section", "nav", "article", "div class=content", "div class=ad", "p", "p", "p"])
        inner = prose(rng, rng.choice([1, 3, 30])) + rng.choice(["", ".", ", so."]) if depth == 0 or tag == "p" else "".join(element(depth - 1) for _ in range(rng.randint(1, 3)))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    for _ in range(200):
        page = "<body>" + "".join(element(2) for _ in range(2)) + "</body>"
        blocks = html_cut.blocks_of(page)
        odds, ties = html_cut.network(blocks, html_cut.DEFAULT_SHAPE)
        if len(odds) > 12 or not blocks:
            continue
        fixed = [o > 0 if abs(o) >= html_cut.SEED else None for o in odds]
        free = [k for k, x in enumerate(fixed) if x is None]

        def labels(m):
            lab = list(fixed)
            for k, i in enumerate(free):
                lab[i] = bool(m >> k & 1)
            return lab

        best = min(labelling_cost(odds, ties, labels(m)) for m in range(1 << len(free)))
        lab = html_cut.min_cut(odds, ties)
        assert abs(labelling_cost(odds, ties, lab) - best) < 1e-6
        text, n, kept, against = html_cut.content(page, html_cut.DEFAULT_SHAPE)
        assert text == "\n".join(b.text for b, on in zip(blocks, lab) if on) and n == len(blocks)
        turned += against
    assert turned > 50


def test_html_is_parsed_in_linear_time():
    import time

    for page in ("<div>" * 100_000 + "</b>" * 100_000 + "x", "<a " * 200_000, "<b>" * 200_000 + "x", "<p><i>" * 100_000, '<a title="' * 100_000, "<li>x" * 50_000, "<table><tr><td>" * 60_000 + "x"):
        began = time.process_time()
        html_cut.content(page, html_cut.DEFAULT_SHAPE)
        assert time.process_time() - began < 4, page[:20]


def test_html_operator(spark):
    rows = [(k, f"http://h/{k}", f"<nav><a href=x>menu</a></nav><article><p>Text {k} of a page, long enough.</p></article><footer>foot</footer>", 1) for k in range(20)] + [(None, None, None, 1), (3, "u", "", 1)]
    got = html_cut.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 22
    assert all(r.text == f"Text {r.page_id} of a page, long enough." and r.n_chars == len(r.text) for r in got if r.text)
    assert sum(not r.text for r in got) == 2


def test_packing_is_a_partition_of_every_document(docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs).collect()
    ids = collections.defaultdict(list)
    for i, x, *_ in corpus:
        ids[i].append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, texts in ids.items():
        tokens = texts[0]
        assert sum(r.length for r in pieces[i]) == len(tokens) * len(texts)
        assert all(r.doc_tokens == len(tokens) and r.ids_crc32 == zlib.crc32(tokens[r.start : r.start + r.length].tobytes()) for r in pieces[i])
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[0][0] == 0 and s[-1][0] + s[-1][1] <= 1024


def test_shape_reads_whole_blocks():
    import types

    b = types.SimpleNamespace(text="word " * 400 + "1234 " * 400 + "©", linked=0, size=4001)
    got = html_cut.shape(b, 0, 1)
    assert got[5] == min(1.0, 5 * 1600 / 4001) and got[-1]


def test_tokenizer_pieces_equal_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, (ids, _) = Tokenizer.from_file(path), packing.tokenizer(path)
    for x in ["a  b", "a   b", " x", "x ", "\n\n y", "a\n\n  b", "a\tb", "<|endoftext|> a", "a\0 b", "don't we'll 12 3,4!! ✓ é", " ", "   ", "é  w", ""]:
        assert np.frombuffer(ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_tokenizer_keeps_runs_of_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, (ids, _) = Tokenizer.from_file(path), packing.tokenizer(path)
    assert np.frombuffer(ids("a \u00a0 \u00a0 b"), "<u4").tolist() == [64, 11504, 275]
    rng = random.Random(9)
    runs = [s for s in (t.decode([k]) for k in range(t.get_vocab_size())) if s.isspace()]  # all tokens of white space
    assert any("\u00a0 " in s for s in runs)
    texts = [a + s + b for s in runs for a in ("", "x", "é", "\0") for b in ("", "y", "✓", "\0")]
    texts += ["".join(rng.choice([*" \u00a0\n\t\0\u3000\u2009\x1c\x85", "a", "é", "1", "!", "'s"]) for _ in range(rng.randint(1, 40))) for _ in range(50_000)]
    for x in texts * 2:  # a second time from the pieces kept
        assert np.frombuffer(ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_packing_cuts_documents_beyond_a_block_at_the_programs_price(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "BLOCK", 500)
    rng = random.Random(3)
    text = " ".join(prose(rng, rng.randint(3, 60)) + "." for _ in range(150))
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids_of, ends = packing.tokenizer(path)
    ids = np.append(np.frombuffer(ids_of(text), "<u4"), 0)
    price = np.full(len(ids) + 1, -1)
    price[np.flatnonzero(ends[ids]) + 1] = packing.SENTENCE_CUT
    price[[0, -1]] = 0
    at = np.flatnonzero(price >= 0)
    got = packing.pack(spark.createDataFrame([("a", text, 1)], "doc_id string, text string, length int"), path, 128).orderBy("start").collect()
    assert len(ids) > 4000 and [r.start + r.length for r in got] == packing.best_cuts(at, price[at], 128)
    assert {r.doc_id for r in got} == {"a"} and {r.doc_tokens for r in got} == {len(ids)}


def test_best_cuts_are_optimal():
    rng = random.Random(12)
    for _ in range(60):
        total, length = rng.randint(1, 90), 16
        at = sorted({0, total, *(rng.randrange(total) for _ in range(rng.randint(0, 20)))})
        price = np.array([rng.choice([0, 1]) for _ in at])
        price[0] = price[-1] = 0
        got = packing.best_cuts(np.array(at), price, length)
        pad = lambda n: 0 if n & (n - 1) == 0 else length - n
        allowed = dict(zip(at, price.tolist()))

        def cost(ends):
            c, last = 0, 0
            for e in ends:
                assert 0 < e - last <= length
                c += pad(e - last) + allowed.get(e, packing.HARD_CUT)
                last = e
            return c

        assert got[-1] == total
        # brute force over allowed cuts alone can not be cheaper, where it exists
        dp = {0: 0}
        for e in at[1:]:
            options = [dp[s] + pad(e - s) + allowed[e] for s in dp if e - s <= length]
            if options:
                dp[e] = min(options)
        if total in dp:
            assert cost(got) <= dp[total]


@pytest.mark.parametrize("run", [exact.exact_groups, exact.exact_dedup, jaccard.jaccard_components, repeats.remove_repeats, mixing.mix_documents, mixing.mixed_rows, sharding.shard_documents, packing.pack_documents])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], EMPTY)).count() == 0


def test_empty_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(none).count() == 0 and html_cut.extract(none).count() == 0


def test_pipeline_decisions(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    base = [prose(rng, 90) for _ in range(40)]
    rows = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(base)]
    rows += [(100 + k, base[k] + " ", "en", "s0", 1) for k in range(5)]  # equal but for white space
    rows += [(200 + k, base[k] + " tail", "en", "s0", 1) for k in range(5)] + [(300, "junk", "en", "s1", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(10)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after.append(stage(spark, after[-1], str(tmp_path)))
        assert after[-1].columns == docs.columns
    ids = [sorted({r.doc_id for r in d.select("doc_id").collect()}) for d in after]
    assert 300 not in ids[1] and len(ids[1]) == 50
    assert set(ids[2]) == (set(ids[1]) - {0, 1, 2, 3, 4}) and len(ids[3]) == 40
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(ids[4])


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(DATA):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got, want = queries.QUERIES[name](spark, DATA).toArrow(), duck.sql(queries.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert sorted(str(sorted(r.items())) for r in got.to_pylist()) == sorted(str(sorted(r.items())) for r in want.to_pylist())


@pytest.mark.parametrize(
    "html, linked",
    [
        ('<HTML><HEAD><LINK REL="canonical" HREF="http://x.net/a"></HEAD><body>', True), ('<link rel=canonical href="http://x.net/a"><p>text', True), ('<body><link rel=canonical href="http://x.net/a">', False),
        ('<p>text<link rel=canonical href="http://x.net/a">', False), ('<script>var a = "<p>";</script><title>a <b> b</title><link rel=canonical href="http://x.net/a">', True),
        ('<!-- </head> --><link rel=canonical href="http://x.net/a">', True), ('<!-- <link rel=canonical href="http://x.net/a"> -->', False), ('<title><link rel=canonical href="http://x.net/a"></title>', False), (None, False),
    ],
)
def test_links_of_a_head(spark, html, linked):
    got = urls.judge(spark.createDataFrame([(1, "http://a.com/", html, 0, 0)], "page_id long, url string, html string, node int, own int"))
    assert got.first().verdict == ("block" if linked else "allow")


def test_repeat_groups_have_all_occurrences(spark):
    rng = random.Random(41)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = text(230), text(260)
    rows = [(k, text(rng.randint(5, 40)) + x + text(rng.randint(5, 40))) for k, x in enumerate([a, a, a, b, b, a + b[:1], text(300)])] + [(50, "copy " * 60), (51, "copy " * 60)]
    got = repeats.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    raw = {i: t.encode() for i, t in rows}
    by = collections.defaultdict(set)
    for r in got:
        by[r.group, r.n_bytes].add((r.doc_id, r.start))
    for (name, n), places in by.items():
        strings = {raw[i][s : s + n] for i, s in places}
        assert len(strings) == 1 and hashlib.sha256(next(iter(strings))).hexdigest()[:32] == name and n >= 200
        s = next(iter(strings))
        if not s.startswith(b"copy") and b"copy copy" not in s:
            assert places == {(i, k) for i, t in raw.items() for k in range(len(t) - n + 1) if t[k : k + n] == s}
    ids = [{i for i, _ in places} for places in by.values()]
    assert {0, 1, 2, 5} in ids and {3, 4} in ids and {50, 51} in ids


def plain_grams(text):
    """The buckets of the quality classifier, one gram at a time: a list for each of its four groups."""
    from inkfield.llm.common import mix, prefix_hash, span_hash
    from inkfield.llm.ngrams import MULTIPLIER, gram

    def word(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        return span_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))

    def chars(s, salt):
        h = np.array([salt * 0x9E3779B97F4A7C15 % (1 << 64)], np.uint64)
        for c in s:
            h = (h ^ np.uint64(int.from_bytes(c.encode(), "little"))) * MULTIPLIER
            h ^= h >> np.uint64(29)
        return mix(h)

    w = [word(x) for x in WORD.findall(text or "")]
    t = text or ""
    groups = [[gram([x], 1) for x in w], [gram([x, y], 2) for x, y in zip(w, w[1:])], [chars(t[k : k + 2], 3) for k in range(len(t) - 1)], [chars(t[k : k + 4], 4) for k in range(len(t) - 3)]]
    return [[int(h[0] >> np.uint64(64 - quality.BITS)) for h in g] for g in groups]


def test_quality_scores_equal_brute_force():
    rng = random.Random(51)
    texts = [prose(rng, rng.randint(0, 40)) + rng.choice(["", " 中文", " \U0001f600 x", "\n"]) for _ in range(40)] + ["", None, "a", "é"]
    weights = np.random.default_rng(1).normal(size=1 << quality.BITS)
    got = quality.score(pa.array(texts), weights)
    row, bucket, value = quality.features(pa.array(texts))
    for k, t in enumerate(texts):
        groups = [g for g in plain_grams(t) if g]
        assert abs(got[k] - sum(np.mean([weights[b] for b in g]) for g in groups)) < 1e-9
        share = collections.Counter()
        for g in groups:
            for b in g:
                share[b] += 1 / len(g)
        found = collections.Counter()
        for b, v in zip(bucket[row == k].tolist(), value[row == k].tolist()):
            found[b] += v
        assert found.keys() == share.keys() and all(abs(found[b] - share[b]) < 1e-9 for b in share)
    j = quality.judged(pa.array(texts), (weights, 2.0, 0.1))
    assert np.allclose(j["quality"], 1 / (1 + np.exp(-np.clip(2.0 * got + 0.1, -30, 30))))
    assert (j["kept"] == (~j["base_failed"] & (j["quality"] >= quality.THRESHOLD))).all()


def test_toxicity_features_equal_brute_force():
    from inkfield.llm.common import prefix_hash, span_hash
    from inkfield.llm.ngrams import gram

    rng = random.Random(52)
    texts = [prose(rng, rng.randint(0, 30)).title() + rng.choice(["", "!", " x-Y'z", " longer-words and LONGESTwords"]) for _ in range(30)] + ["", None]

    def word(w):
        raw = np.frombuffer(w, np.uint8)
        return span_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))

    row, bucket = toxicity.presence(pa.array(texts))
    for k, t in enumerate(texts):
        raw = (t or "").translate(UPPER).encode()
        words = re.findall(rb"[a-z0-9'\x80-\xff]+", raw)
        h, want = [word(w) for w in words], set()
        for s, places in enumerate(toxicity.SHAPES):
            want |= {int(gram([h[i + p] for p in places], 11 + s)[0] >> np.uint64(64 - toxicity.BITS)) for i in range(len(h) - places[-1])}
        for n in toxicity.STEMS:
            want |= {int(gram([word(w[:n])], 31 + n)[0] >> np.uint64(64 - toxicity.BITS)) for w in words if len(w) > n}
        assert set(bucket[row == k].tolist()) == want


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(61)
    texts = [prose(rng, 70) for _ in range(12)]
    rows = [(k, t, "en", "s0", 1, "x", k) for k, t in enumerate(texts)] + [(None, texts[0], None, None, None, None, 50), (None, None, None, None, None, None, 51), (20, "", "", "", 0, "", 52), (3, texts[3], "en", "s0", 1, "x", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `row` string, sid int"
    for name, part in (("odd", rows), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path / "odd"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "sid"]
    assert sorted(r.text for r in docs.collect()) == sorted(texts)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()} <= set(range(12))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("run", [lambda d, x: quality.rules(d, x), lambda d, x: quality.kept_documents(d, x), lambda d, x: toxicity.score_documents(d, x)])
def test_learned_operators_on_empty_tables(spark, run):
    assert run(spark.createDataFrame([], EMPTY), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(71)
    long = prose(rng, 60_000)
    rows = [(1, long), (2, long + " end"), (3, "short " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3}
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.remove_repeats(df).collect()}
    assert got[1] == (len(long.encode()), len(long.encode())) and got[2][1] == len(long.encode()) and got[3][1] == 0
    page = "<article>" + "".join(f"<p>{long[k : k + 900]}.</p>" for k in range(0, len(long), 900)) + "</article>"
    assert html_cut.content(page, html_cut.DEFAULT_SHAPE)[1] == -(-len(long) // 900)


def test_driver_gives_memory_back(spark, tmp_path, monkeypatch):
    """A driver of a cluster whose heap has grown gives it back while a scratch table is written, and after it."""
    monkeypatch.setattr(common, "_local", lambda spark: False)
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(common, "HEAP_SHARE", 0.4)
    monkeypatch.setattr(common, "LOOK_S", 0.5)
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()

    def fill():
        while runtime.totalMemory() < 0.5 * runtime.maxMemory():
            held = [spark.sparkContext._jvm.java.util.BitSet(1 << 29) for _ in range(int(runtime.maxMemory() * 0.5) >> 26)]
            del held
        gc.collect()
        time.sleep(1)  # the JVM learns of it

    seen = []

    def slow(rows):
        time.sleep(6)
        yield from rows

    fill()
    looks = threading.Thread(target=lambda: (time.sleep(4), seen.append(runtime.totalMemory())))
    looks.start()
    out = common.materialise(spark.range(3).coalesce(1).mapInArrow(slow, "id long"), "slow")
    looks.join()
    assert seen[0] < 0.4 * runtime.maxMemory()
    fill()
    out = common.materialise(out, "quick")
    assert runtime.totalMemory() < 0.4 * runtime.maxMemory()
    assert sorted(r.id for r in out.collect()) == [0, 1, 2]
