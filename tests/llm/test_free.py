"""Language identification, suffix dedup, fingerprints, personal data, packing, Jaccard join, pipeline: against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docweft.llm import fingerprints, induced_sort, language_id, ngram_join, packing, pii, suffix_dedup
from docweft.llm.components import components
from docweft.session import table
from tests.llm.test_native import CLEAN, DOCS, ODD


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Language identification
def test_language_accuracy_on_held_out(spark):
    rows = language_id.op2(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert held and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_folded_tables_equal_the_network():
    net = language_id.ByteNet(["a", "b", "c"])
    windows = np.random.default_rng(0).integers(0, 256, (5, language_id.WINDOW))
    chance, *_ = net._forward(windows)
    assert np.allclose(np.exp(language_id.log_chances(net.folded(), windows)), chance, atol=1e-4)


def plain_chances(net, window):
    """One window, position by position and filter by filter."""
    w, pooled = net.weights, []
    for width, count in language_id.FILTERS.items():
        for f in range(count):
            responses = [sum(float(w["embed"][window[at + k]] @ w[f"filter{width}"][k * language_id.EMBED : (k + 1) * language_id.EMBED, f]) for k in range(width)) for at in range(len(window) - width + 1)]
            pooled.append(max(0.0, max(responses) + float(w[f"shift{width}"][f])))
    logits = np.array(pooled) @ w["out"] + w["bias"]
    return np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()


def test_network_is_a_plain_convolution():
    net = language_id.ByteNet(["a", "b", "c"])
    windows = np.random.default_rng(1).integers(0, 256, (3, 40))
    chance, *_ = net._forward(windows)
    assert np.allclose(chance, [plain_chances(net, w) for w in windows], atol=1e-5)


def test_gradients_equal_differences():
    net = language_id.ByteNet(["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (6, 30)), rng.integers(0, 3, 6)
    loss = lambda: -np.log(net._forward(x)[0][np.arange(6), y]).mean()
    for key, grad in net.gradients(x, y).items():
        largest = np.argsort(np.abs(grad), axis=None)[-3:]
        for at in (np.unravel_index(i, grad.shape) for i in [*largest, *rng.integers(0, grad.size, 3)]):
            before, step = net.weights[key][at], 1e-6
            net.weights[key][at] = before + step
            up = loss()
            net.weights[key][at] = before - step
            down = loss()
            net.weights[key][at] = before
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-6 + 1e-3 * abs(grad[at]), (key, at)


def test_language_odd_rows(spark, odd, none):
    got = language_id.predict(odd, language_id.ByteNet(["en", "fr"])).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"} and language_id.train(none) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


# Suffix dedup
def test_induced_sort_and_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(120):
        t = rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(1, 60))).astype(np.uint8)
        t = np.concatenate([t, [0], t[: len(t) // 2 + 1], [0]]).astype(np.uint8)
        data = t.tobytes()
        want = sorted(range(len(data)), key=lambda i: data[i:])
        order = induced_sort.suffix_order(t)
        assert order.tolist() == want
        common = induced_sort.prefixes(t, order)
        for a, b in zip(want, want[1:], strict=False):
            n = 0
            while a + n < len(data) and b + n < len(data) and data[a + n] == data[b + n] and data[a + n]:
                n += 1
            assert common[b] == n


def test_induced_sort_in_scratch_files(monkeypatch):
    t = np.append(np.random.default_rng(2).integers(1, 4, 4000), 0).astype(np.uint8)
    want = induced_sort.suffix_order(t).tolist()
    monkeypatch.setattr(induced_sort, "MEMORY_TEXT", 0)
    monkeypatch.setattr(induced_sort.BucketQueue.__init__, "__defaults__", (256,))
    assert induced_sort.suffix_order(t).tolist() == want


def brute_dedup(texts, width=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        cover = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                cover[i : i + width] = b"\x01" * width
        spans = len(re.findall(rb"\x01+", bytes(cover)))
        out.append((len(d), sum(cover), spans, hashlib.sha256(bytes(c for c, v in zip(d, cover, strict=True) if not v)).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark, none):
    rng = np.random.default_rng(3)
    make = lambda n: "".join(rng.choice(list("abcdé fgh\n"), n))
    shared, base = make(650), make(900)
    near = [base[:k] + "#" + base[k + 1 :] for k in (100, 430, 460, 500, 890)]
    texts = [make(300) + shared + make(20), make(9) + shared, shared[:399], shared[100:], base, *near, "x" * 1200, "ab" * 450, None, "", base, make(2000)]
    df = spark.createDataFrame([(i if i != 3 else None, t, "z") for i, t in enumerate(texts)] + [(4, base, "z")], "doc_id long, text string, spots string")
    got = sorted(tuple(r)[1:5] for r in suffix_dedup.dedup(df).collect())
    assert got == sorted(brute_dedup([*texts, base]))
    assert suffix_dedup.dedup(none).count() == 0


def test_suffix_dedup_of_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", 1)
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("abcdefgh \n"), 1100))
    texts = [base[:k] + "#" * (1 + k % 3) + base[k:] for k in range(3, 1100, 41)] + ["ab" * 500, "x" * 450 + base[:500]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r)[1:5] for r in suffix_dedup.dedup(df).collect()) == sorted(brute_dedup(texts))


def brute_passages(docs, words=51):
    held = {}
    for d in set(docs):
        w = (d[1] or "").encode().split()
        for i in range(len(w) - words + 1):
            held.setdefault(tuple(w[i : i + words]), set()).add(d)
    out = []
    for d in docs:
        w = (d[1] or "").encode().split()
        out.append((d[0], len({i + k for i in range(len(w) - words + 1) if len(held[tuple(w[i : i + words])]) > 1 for k in range(words)})))
    return sorted(out, key=repr)


def test_passages_equal_brute_force(spark, none):
    rng = np.random.default_rng(6)
    make = lambda n: " ".join(rng.choice([f"w{i}" for i in range(400)], n))
    shared, base = make(51), make(300)
    near = [" ".join([*base.split()[:k], f"x{k % 5}", *base.split()[k:]]) for k in (0, 49, 51, 52, 100, 101, 290)]
    texts = [make(90) + "\n" + shared + "\t" + make(7), shared, shared.rsplit(" ", 1)[0], base, *near, "twice " * 200, "ab " * 60, "ab " * 60 + make(400), None, "", "one", make(20_000), shared + " " + make(60)]
    docs = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(0, texts[0]), (1, base)]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, n_passage_words string")
    assert sorted(((r.doc_id, r.n_passage_words) for r in suffix_dedup.dedup(df).collect()), key=repr) == brute_passages(docs)
    assert suffix_dedup.passages(none).count() == 0


# Fingerprints
def test_fingerprints(spark, sf, odd, none):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs, group_rows=17).collect()}
    assert len(got) == len(rows)
    for one, two in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(one.text) // 2
        assert got[one.doc_id].edited_sha256 == hashlib.sha256((one.text[: len(one.text) - half] + two.text[:half]).encode()).hexdigest()
    assert len({(r.text, got[r.doc_id].fingerprint) for r in rows}) == len({r.text for r in rows})
    assert np.mean([r.near_edited for r in got.values()]) > 0.25 > np.mean([r.near_next for r in got.values()])
    assert fingerprints.fingerprints(odd).count() == len(ODD) and fingerprints.fingerprints(none).count() == 0
    alone = fingerprints.fingerprints(odd.where("doc_id = 7")).first()
    assert alone.near_next == 1.0


def plain_sketch(text):
    """Closed syncmers by comparing every inner substring's hash, in plain Python over the same hash of substrings."""
    k, s = fingerprints.K, fingerprints.S
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    whole = lambda a, b: int(fingerprints.rolling(points[a:b], b - a)[0])
    found = {}
    for i in range(len(points) - k + 1):
        inner = [whole(i + j, i + j + s) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(int(fingerprints.syncmers(points[i : i + k])[0][0]), i)
    if not found and len(points):
        found = {whole(0, len(points)): 0}
    return found


def test_fingerprints_equal_plain_python(spark):
    rng = np.random.default_rng(8)
    make = lambda n: "".join(rng.choice(list("abcdé 日\n"), n))
    base = make(500)
    texts = {5: base, 2: base[:250] + make(250), 9: None, 11: "", 12: "short", 20: make(70), 21: make(100), 30: base + make(40)}
    df = spark.createDataFrame([(*x, "z") for x in texts.items()], "doc_id long, text string, k string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(df, group_rows=2).collect()}
    ids = sorted(texts)
    for one, two in zip(ids, ids[1:] + ids[:1], strict=True):
        a, b = texts[one] or "", texts[two] or ""
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        sa, sb, se = map(plain_sketch, (a, b, e))
        like = lambda x, y: len(x.keys() & y.keys()) / len(x.keys() | y.keys()) if x or y else 1.0
        assert got[one].fingerprint == ",".join(f"{h >> 16:012x}@{p:x}" for h, p in sorted(sa.items(), key=lambda x: x[1]))
        assert (got[one].near_edited, got[one].near_next) == pytest.approx((like(sa, se), like(sa, sb)))


def test_fingerprints_of_rows_that_repeat_and_have_no_id(spark):
    rows = [(None, f"text {i % 3} " * 30) for i in range(9)] + [(7, CLEAN)] * 11 + [(7, CLEAN + " x"), (8, "last " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.fingerprints(df, group_rows=4).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t)) for i, t in rows)
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 7) >= 10 and sum(r.near_next == 1.0 for r in got if r.doc_id is None) == 6


def test_closed_syncmers_depend_on_the_kmer_alone():
    points = np.random.default_rng(1).integers(97, 123, 3000).astype(np.uint32)
    value, at = fingerprints.syncmers(points)
    for v, p in list(zip(value, at, strict=True))[:50]:
        alone, _ = fingerprints.syncmers(points[p : p + fingerprints.K])
        assert alone.tolist() == [v]
    assert np.diff(at).max() <= fingerprints.K - fingerprints.S + 1


# Personal data
def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub(r"\D", "", m.group())
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15])


def test_pii_base_equals_the_patterns(spark, sf):
    extra = ["a@b@c.d x@y.z@w.v..", "me.@x-y.co.uk,a@b.c@d.e", "@@a@b.c.", "1.2.3.4.5.6 300.1.1.1 0001.02.3.255 1.2.3", "+1 (988) 555-2485 4111 1111 1111 1111 4111-1111-1111-1112", ""]
    for text in extra + [r.text for r in table(spark, sf, "documents").collect()]:
        assert pii.base_spans(text) == plain_base(text)


EXAM = [  # text, the spans to add to the base
    ("write to anna.berg (at) nordmail (dot) net today", "email:9:42"), ("contact: john[at]mail[dot]org", "email:9:29"), ("we met at noon dot nobody came", ""),
    ("host 10[.]0[.]12[.]7 is down", "ip:5:20"), ("version 10 . 400 . 3 . 2 shipped", ""), ("card: 4111.1111.1111.1111 expires", "card:6:25"),
    ("order 4111.1111.1111.1112 shipped", ""), ("phone: (030) 555-1234 thanks", "phone:7:21"), ("page 10-20-30 of section 12.14.16", ""), ("a@b.co or 1234 5678 9012 3456", "email:0:6"),
]


def test_pii_candidates_and_rows(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = pii.train(docs)
    x, y = pii.labelled_candidates(800, seed=77)
    chosen = model.accepts(x)
    assert y[chosen].mean() > 0.95 and chosen[y == 1].mean() > 0.85
    cx, cy = pii.contextual_candidates(pii.matches_in_context([r.text for r in docs.where("doc_id % 3 = 0").collect()]), seed=99)
    chosen = model.accepts(cx)
    assert len(cy) > 50 and cy[chosen].mean() > 0.9 and chosen[cy == 1].mean() > 0.6
    spans = lambda t: pii.joined(pii.all_spans(t, model)[1])
    assert [(t, spans(t)) for t, _ in EXAM] == EXAM and spans(CLEAN) == ""
    rows = pii.find(odd, model=model).collect()
    assert len(rows) == len(ODD) and all(r.spans == "" for r in rows) and pii.find(none).count() == 0
    long = "x " * 20_000 + "mail[at]host[dot]org " + "y " * 100
    twice = spark.createDataFrame([(1, long, 1), (1, long, 1), (None, None, 2)], "doc_id long, text string, spans int")
    assert sorted(r.spans for r in pii.find(twice, model=model).collect()) == ["", *["email:40000:40020"] * 2]


# Packing
def check_packing(rows, docs, sequence=packing.SEQUENCE):
    from tokenizers import Tokenizer

    path, _ = packing.vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        want.update((doc_id, at, len(ids[at : at + sequence]), zlib.crc32(ids[at : at + sequence].tobytes()), len(ids)) for at in range(0, len(ids), sequence))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence
    return by


def test_packing_covers_every_id_once(spark, sf, odd, none):
    docs = table(spark, sf, "documents")
    by = check_packing(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    used = [sum(n for _, n in p) for p in by.values()]
    assert sum(packing.SEQUENCE - u for u in used) < 0.05 * sum(used)
    special = spark.createDataFrame([(1, "<|endoftext|> 's  \n\n x"), (2, None), (3, "日本" * 3000)], "doc_id long, text string")
    check_packing(packing.pack(special).collect(), [tuple(r) for r in special.collect()])
    check_packing(packing.pack(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(none).count() == 0


def test_packed_ids_equal_the_plain_call(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json")[0])
    texts = ["see <|endoftext|> here", "<|endoftext|><|endoftext|>\n\nb  <|endoftext|>  's\t", "<|endoftext|", "x <|endoftext|> 日本" * 900, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        want.update((i, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)) for at in range(0, len(ids), 2048))
    for out in (packing.op8(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out.collect()) == want


def test_column_generation_beats_its_bound():
    rng = np.random.default_rng(1)
    demand = np.bincount(np.clip(rng.lognormal(3.3, 1.0, 20_000).astype(int), 1, 128), minlength=129)[1:]
    patterns = packing.rounded(demand, 128)
    assert (sum(t * p for p, t in patterns) == demand).all() and all((p * np.arange(1, 129)).sum() <= 128 for p, _ in patterns)
    assert sum(t for _, t in patterns) <= 1.01 * (demand * np.arange(1, 129)).sum() / 128 + 1
    assert packing.rounded(np.zeros(8, dtype=int), 8) == []


# Jaccard join
def brute_classes(docs):
    sets = []
    for _, text in docs:
        w = (text or "").encode().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links, label = [0] * len(docs), list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    low = {x: min(docs[i][0] for i in range(len(docs)) if label[i] == x) for x in set(label)}
    return sorted((docs[i][0], low[label[i]], links[i]) for i in range(len(docs)))


def near_texts(n, words=60, seed=5):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 999, words)]
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.integers(0, words, i % 4):
            w[k] = f"e{i}"
        out.append(" ".join(w))
    return out


def test_join_equals_brute_force(spark, none, monkeypatch):
    texts = near_texts(40) + near_texts(3, seed=6) + [CLEAN, CLEAN, "a b", "a b", "a b c", None, "", " "]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, rep string")
    want = brute_classes(docs)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()) == want
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 6)  # one group over many blocks
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()) == want
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in want})
    assert ngram_join.near_duplicates(none).count() == 0


def test_join_odd_rows(spark, odd):
    rows = ngram_join.near_duplicates(odd).collect()
    near = {(r.doc_id, r.n_links) for r in rows if r.doc_id in (1, None)}
    assert len(rows) == len(ODD) and near == {(1, 4), (None, 3)}  # doc 1: its copy, the text without an id, the texts 6 and 7
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one(odd).collect()) == ["1", "2", "3", "4", "5", "8"]
    texts = near_texts(6, seed=9)
    twice = spark.createDataFrame([(1, texts[0], "a"), (1, texts[5], "b"), (1, CLEAN, "c"), (1, CLEAN, "b"), (2, CLEAN, "a"), (None, "x y z", "a"), (None, "x y z", "a"), (None, "x y", "a")], "doc_id long, text string, _key string")
    got = ngram_join.near_duplicates(twice).collect()
    assert sorted(r.n_links for r in got) == [0, 1, 1, 1, 1, 2, 2, 2] and len({r.class_id for r in got}) == 4
    kept = ngram_join.keep_one(twice)
    assert kept.columns == twice.columns and len(kept.collect()) == 4 and {r._key for r in kept.collect() if r.doc_id == 1} <= {"a", "b", "c"}


def test_long_texts_and_chains_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    words = [f"w{i}" for i in range(220)]
    chain = [" ".join(words[4 * i : 4 * i + 60]) for i in range(40)]  # each is near the next one only
    long = " ".join(f"v{i % 9973}" for i in range(20_000))
    docs = list(enumerate([*chain, long, long + " end"]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()) == brute_classes(docs)


def test_depth_is_shortened_until_both_recalls_are_met():
    d = ngram_join.matched_depth({}, 0.8)
    assert ngram_join.chance(0.8, d) >= ngram_join.RECALL > ngram_join.chance(0.8, d + 1)
    assert ngram_join.matched_depth({8: 90, 4: 10}, 0.8) == 4 and ngram_join.matched_depth({8: 99_999, 2: 1}, 0.8) == d


def test_signing_finds_the_neighbours_of_the_sample(spark):
    texts = near_texts(30)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sample = ngram_join.sampled(df)
    run = ngram_join._signer(ngram_join.TREES, ngram_join.DEEPEST, sample, 4, 5)
    signed = ngram_join._keyed(df, "text").mapInArrow(run, "doc_id bigint, tk bigint, sid binary, n bigint, labels binary, near array<int>").collect()
    links = {i: n for i, _, n in brute_classes([(i, t) for i, t in enumerate(dict.fromkeys(texts))])}
    assert sum(links.values()) == sum(len(r.near) for r in {r.sid: r for r in signed}.values()) and all(d >= 1 for r in signed for d in r.near)


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(12)] + [(40, 30), (41, 30), (50, 50)], "u long, v long")
    assert sorted(map(tuple, components(edges).collect())) == [(i, 0) for i in range(1, 13)] + [(40, 30), (41, 30)]


# Pipeline
def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    before = docs.count()
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.durable(stage(spark, docs, sf))
        kept.append((name, docs.count()))
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            labels = table(spark, sf, "labels").join(docs.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
            assert labels.where("quality = 0 AND kept = 1").count() == 0
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(n == 0 for *_, n in brute_classes(rows))
        if name == "secrets":
            assert not any(re.search(r"AKIA[0-9A-Z]{16}|(?i:password=)[0-9a-f]{18}|(?i:token) = \"[0-9a-f]{40}", r.text) for r in docs.collect())
        if name == "mix":
            mixed = [(r.doc_id, r.text) for r in docs.collect()]
            assert max(Counter(i for i, _ in mixed).values()) <= 2
    check_packing(docs.collect(), mixed)
    assert kept[0][1] < before and kept[1][1] <= kept[0][1] == kept[0][1] and kept[2][1] == kept[1][1]
