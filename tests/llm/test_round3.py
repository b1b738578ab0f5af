"""Nearest vectors, conversation trie and source audit against SQL or plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.llm import nearest, prefix_trie, registry, source_audit
from docweft.llm.runs import along
from tests.oracle import compare, connect


# Source audit
def plain_audit(rows, least):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lang or "", s or "") for t, lang, s in rows]
    df, n, out = Counter(), Counter(), set()
    for words, lang, s in docs:
        df.update((lang, w) for w in set(words))
        n.update((lang, s, w) for w in words)
    groups = {(lang, s) for _, lang, s in docs}
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), k in df.items() if x == lang and k >= least]
        own = sorted((s for x, s in groups if x == lang), key=str.encode)
        total = {s: sum(n[lang, s, w] for w in kept) for s in own}
        p = {(s, w): 1 + 10**9 * (n[lang, s, w] + 5) // (total[s] + 5 * len(kept)) for s in own for w in kept}
        q = {w: 1 + 10**9 * (sum(n[lang, s, w] for s in own) + 5) // (sum(total.values()) + 5 * len(kept)) for w in kept}
        for s in own:
            pairs = sorted(((-sum(abs(p[s, w] - p[o, w]) for w in kept), o.encode()) for o in own if o != s))
            told = sorted((q[w] - p[s, w], w.encode()) for w in kept if n[lang, s, w] and p[s, w] > q[w])[:50]
            for part, found in (("pair", pairs), ("term", told)):
                out |= {(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)}
    return out


def audited(frame, **more):
    got = source_audit.audit(frame, **more).collect()
    assert len({tuple(r) for r in got}) == len(got)
    return {tuple(r) for r in got}


def test_audit_equals_plain(spark):
    rng = np.random.default_rng(5)
    words = ["Über", "über", "a", "B", "b", "日本", "x1y", "İ", "ÀB", "end."] + [f"w{i}" for i in range(3)] + ["zeta", "eta"]
    rows = [(" ".join(rng.choice(words, int(rng.integers(0, 30)))), str(rng.choice(["en", "fr", "xx"], p=[0.6, 0.3, 0.1])), str(rng.choice(["s", "t", "ü", "hot"], p=[0.2, 0.1, 0.1, 0.6]))) for _ in range(300)]
    rows += [(None, None, None), ("", "en", "silent"), ("a b " * 20000, "en", "t"), ("\x00\x7f@[`{ Az\U0001f600z", None, "s"), ("a b", "en", None), *[("Twice twice", "en", "hot")] * 40]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, source string, term string")
    for least in (1, 30):
        assert audited(frame, least_docs=least) == plain_audit(rows, least)


def test_audit_of_little(spark):
    schema = "text string, lang string, source string"
    assert audited(spark.createDataFrame([], schema)) == set()
    assert audited(spark.createDataFrame([("a", "en", "x"), ("b", "en", "y"), ("c", None, None)], schema)) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    shared = source_audit.share(F.lit(10**15), F.lit(10**16), F.lit(10**6))
    assert spark.range(1).select(shared.alias("p")).first().p == 1 + 10**9 * (10**15 + 5) // (10**16 + 5 * 10**6)


# Conversation trie
def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * words
    ends = {k: hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(k)).encode()).hexdigest() for k, m in members.items()}
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], ends[k]) for k, m in members.items()), whole


TURNS = "conv_id long, turn long, role string, text string"


def tried(frame):
    return sorted((tuple(r) for r in prefix_trie.trie(frame).collect()), key=lambda r: r[:2])


def test_trie_equals_plain(spark):
    rng = np.random.default_rng(11)
    says = ["", "hello you", "a b c", None, "x\ty"]
    rows = [(int(c), int(t), str(rng.choice(["user", "assistant"])), says[int(rng.choice(5, p=[0.1, 0.6, 0.1, 0.1, 0.1]))]) for c in rng.permutation(130) if c % 7 for t in range(int(rng.integers(0, 9)))]
    rows += [(5, None, None, None), (5, None, "user", "z"), (5, 3, "user", "z"), (5, 3, "user", "z"), (None, 1, "user", "lost"), (-23, 0, "user", "hello you"), (-20, 0, "user", "a"), (10**15, 1, "a", "ü   日本")]
    rows += [(k, t, "user", "chain" if t < k - 600 else f"{k}") for k in range(601, 640) for t in range(k - 600 + 3)]  # each hangs on the one before
    rows += [(777, t, "user", "long talk") for t in range(220)] + [(778, t, "user", "long talk") for t in range(150)] + [(779, 0, "user", "word " * 20000)]
    rows += [(c, t, "user", "same first" if t == 0 else "same next") for c in range(2000, 2300) for t in range(2)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", depth string")
    want, whole = plain_trie(rows)
    assert tried(frame) == want
    rows_, sizes = prefix_trie.rebuilt(prefix_trie.turns(frame))
    assert {r.conv: r["size"] for r in sizes.collect()} == {c: len(v) for c, v in whole.items()} and [] in whole.values()
    prefix = prefix_trie.prefixes(rows_)
    nodes = prefix_trie.minima(prefix)
    first = {}
    for r in nodes.collect():
        first[r.owner] = min(r.depth, first.get(r.owner, r.depth))
    assert {r.conv: r["first"] for r in prefix_trie.first_owned(sizes, prefix, nodes).collect()} == {c: first.get(c, len(v) + 1) for c, v in whole.items()}


def test_trie_of_little(spark):
    assert tried(spark.createDataFrame([], TURNS)) == []
    for rows in ([(None, 1, "a", "b")], [(21, 1, None, None)], [(1, 1, "a", "b"), (1, 1, "a", "b")]):
        assert tried(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)[0]


def test_runs_cross_many_tasks(spark):
    rows = [(1, i, i * i - 7) for i in range(3000)] + [(k, i, 3) for k in (0, 2, 5) for i in range(2)]
    frame = spark.createDataFrame(rows, "key long, i long, v long").repartition(9)
    for kind, add in (("sum", lambda a, b: a + b), ("xor", lambda a, b: a ^ b)):
        got = {(r.key, r.i): r.total for r in along(frame, "key", [F.desc("i")], {"total": F.col("v")}, kind).collect()}
        want, at = {}, {}
        for key, i, v in sorted(rows, key=lambda r: (r[0], -r[1])):
            at[key] = add(at.get(key, 0), v)
            want[key, i] = at[key]
        assert got == want


# Nearest vectors
def plain_nearest(rows, k, asked):
    good = [(i, v, np.array(x, dtype=float)) for i, (v, x) in enumerate(rows) if x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    out = []
    for i, v, x in good:
        if v is not None and asked(v):
            found = []
            for j, w, y in good:
                if i != j and len(x) == len(y):
                    a, b = nearest.scaled(np.array([x])), nearest.scaled(np.array([y]))
                    found.append((-float(np.clip((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()), -1, 1)), w is None, w))
            out += [(v, rank + 1, w, -s) for rank, (s, _, w) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_equals_plain(spark, monkeypatch, kind):
    rng = np.random.default_rng(2)
    make = lambda n: rng.normal(size=n).astype(np.float32).tolist()
    hot, other = make(16), make(16)
    rows = [(i, hot if i % 3 == 0 else make(16)) for i in range(400)] + [(i, [c + 1e-4 * float(rng.normal()) for c in other]) for i in range(400, 480)]
    rows += [(500, None), (501, []), (510, [0.0] * 16), (520, [None, *make(15)]), (530, [float("nan"), *make(15)]), (540, [float("inf"), *make(15)])]
    rows += [(550, make(3)), (551, make(3)), (560, make(2)), (570, [2 * c for c in hot]), (None, hot), (None, make(16)), (30, other), (30, other), (580, [1e30 * c for c in make(16)]), (590, [1e-30 * c for c in make(16)]), (-10, make(16))]
    rows = [(v, x if x is None or kind == "double" else [None if c is None else float(np.float32(c)) for c in x]) for v, x in rows]
    frame = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, score string").repartition(5)
    for block, held in ((4 << 20, 1 << 20), (256, 40)):
        monkeypatch.setattr(nearest, "QUERY_BYTES", block)
        monkeypatch.setattr(nearest, "HELD", held)
        got = nearest.nearest(frame, F.col("vec_id") % 10 == 0, 5)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_nearest(rows, 5, lambda v: v % 10 == 0)


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(3000)]
    codes = nearest.coded(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    found = nearest.survivors(codes, 5)
    at = {r.row: np.array(r.vector, dtype=float) / np.linalg.norm(r.vector) for r in codes.select("row", "vector").collect()}
    pairs = found.collect()
    assert pairs and all(r.low <= at[r.q] @ at[r.c] <= r.high for r in pairs)
    assert nearest.pruned(found, 5).count() < 60 * 30


def test_nearest_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (50, [-1.0])], [(1, [1.0]), (2, [1.0])], [(0, None)]):
        got = nearest.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_nearest(rows, 5, lambda v: v % 50 == 0)


@pytest.mark.parametrize("name", [n for n in ("op11_nearest", "op12_prefix_trie", "op13_source_audit") if n in registry.ORACLES])
def test_sql_of_new_queries(spark, name):
    assert compare(registry.QUERIES[name](spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), registry.ORACLES[name])
