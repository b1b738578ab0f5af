"""Systems under common controls against a plain twin that takes one question and system at a time."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docweft.operators import controls as C

MARKS = {5: (8192, 320), 10: (12288, 640), 15: (16384, 1024)}


def _pool(*streams, depth, digits=None):
    score = {}
    for stream, weight in streams:
        for rank, chunk in enumerate(stream, 1):
            score[chunk] = score.get(chunk, 0) + weight / (60 + rank)
    return sorted(score, key=lambda x: (-(score[x] if digits is None else round(score[x], digits)), x))[:depth]


def _graph(primary, graph, depth):
    p, g = ({x: i for i, x in enumerate(s, 1)} for s in (primary, graph))
    score = {x: (0.5 / (60 + p[x]) if x in p else 0) + (0.5 / (60 + g[x]) if x in g else 0) for x in [*p, *g]}
    return sorted(score, key=lambda x: (-score[x], min(p.get(x, 1000), g.get(x, 1000)), x))[:depth]


def _topics(seeds, chunks, most):
    by_id = {x["chunk_id"]: x for x in chunks}
    out, used, groups = [], 0, set()
    for seed in seeds:
        own = by_id.get(seed)
        if own is None:
            out += [seed] * (seed not in out)
            continue
        doc = sorted((x for x in chunks if x["document_id"] == own["document_id"]), key=lambda x: x["chunk_index"])
        at = own["chunk_index"]
        others = [x["chunk_index"] for x in doc if x["topic"] != own["topic"]]
        low = at - 2 if own["topic"] is None else max((i for i in others if i < at), default=-1)
        high = at + 2 if own["topic"] is None else min((i for i in others if i > at), default=1 << 31)
        if (own["document_id"], low) in groups:
            out += [seed] * (seed not in out)
            continue
        groups.add((own["document_id"], low))
        total = 0
        for x in (x for x in doc if low < x["chunk_index"] < high):
            total += x["bytes"]
            if (total > most and x["chunk_id"] != seed) or x["chunk_id"] in out or (used + x["bytes"] > most and x["chunk_id"] not in seeds):
                continue
            out.append(x["chunk_id"])
            used += x["bytes"]
    return out


def _parents(seeds, chunks, target):
    wanted, bad = set(), False
    starts, lacking = {}, {x["document_id"] for x in chunks if not x["tokens"] or x["tokens"] <= 0}
    for doc in {x["document_id"] for x in chunks}:
        total = 0
        for x in sorted((x for x in chunks if x["document_id"] == doc), key=lambda x: x["chunk_index"]):
            starts[x["chunk_id"]] = (doc, total // target)
            total += x["tokens"] or 0
    for seed in seeds:
        if seed in starts:
            wanted.add(starts[seed])
            bad |= starts[seed][0] in lacking
    if seeds and (bad or not wanted):
        return None
    return [x["chunk_id"] for x in sorted(chunks, key=lambda x: (x["document_id"], x["chunk_index"])) if starts[x["chunk_id"]] in wanted]


def _fit(values, texts, room):
    out, whole_at = [], {}
    size = lambda label: math.ceil(len(json.dumps(label, ensure_ascii=False).encode()) / 2)
    for chunk in values:
        document, text = texts.get(chunk, (None, None))
        original = content = (text or "").strip()
        label = {"source": len(out) + 1, "document": document or "", "page": None, "text": content}
        same = whole_at.get(original)
        if same:
            del label["text"]
            label["sameTextAsSource"] = same
        if size(label) > room:
            if same:
                continue
            content = ""
            for part in re.split(r"(?<=[.!?])\s+", original):
                if not re.search(r"[.!?]$", part):
                    continue
                if size(label | {"text": (content + " " + part).strip()}) > room:
                    break
                content = (content + " " + part).strip()
            label["text"] = content
        if len(content) < 40:
            continue
        room -= size(label)
        if same is None and content == original:
            whole_at.setdefault(original, label["source"])
        out.append((chunk, content == original, same))
        if room < 80:
            break
    return out


def _twin(question, streams, chunks, texts, score, held, topic_bytes):
    cap, answer = MARKS[question["marks"]]
    cap = min(cap, held.context_ceiling)
    fixed = math.ceil((C.INSTRUCTIONS + len(question["question"].encode())) / 2) + 32
    answer = min(answer, max(0, cap - 512 - fixed - 200))
    dense, lexical, structure, graph = (s[: held.candidate_depth] for s in streams)
    for system, flags in C.SYSTEMS.items():
        values = _pool((dense, 1), (lexical, 1), depth=held.candidate_depth) if "hybrid" in flags else dense
        if "structure" in flags:
            values = _pool((values, 0.7), (structure, 0.3), depth=held.candidate_depth, digits=8)
        if "graph" in flags:
            if question["graph_state"] != "available":
                yield system, "complete_graph_snapshot_required", []
                continue
            if "structure" not in flags or question["route"] != "semantic":
                values = _graph(values, graph, held.candidate_depth)
        if any(score.get(x) is None for x in values):
            yield system, "common_reranker_not_ready", []
            continue
        values = sorted(values, key=lambda x: -score[x])[: held.seeds]
        if "topic" in flags:
            values = _topics(values, chunks, topic_bytes)
        elif "parent" in flags:
            values = _parents(values, chunks, held.parent_target_tokens)
        if values is None:
            yield system, "fixed_parent_token_metadata_missing", []
        elif answer < 64 or fixed + 100 > cap - answer - 512:
            yield system, "question_leaves_no_room", []
        else:
            yield system, None, _fit(values, texts, cap - answer - 512 - fixed)


@pytest.mark.parametrize("topic_bytes", [128_000, 9_000])
def test_equals_the_plain_twin(spark, monkeypatch, topic_bytes):
    monkeypatch.setattr(C.topics, "__defaults__", (topic_bytes,))
    rng, held = random.Random(4), C.Controls(candidate_depth=12, seeds=5)
    words = ['pump "x"', "valve", "tank\\a", "motor", "süß", "rotor"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(6, 30))) + rng.choice([".", "!", "?", ". And"])
    texts, chunks = {}, []
    for doc in range(6):
        for i in range(20):
            chunk, kind = doc * 100 + i, rng.random()
            text = None if kind < 0.05 else "short." if kind < 0.1 else texts[rng.choice(list(texts))][1] if kind < 0.3 and texts else " ".join((s := sentence())[0].upper() + s[1:] for _ in range(rng.choice([2, 10, 60])))
            texts[chunk] = (f"d{doc}", text)
            tokens = 0 if doc == 5 and i == 7 else rng.randint(1, 700)
            chunks.append({"chunk_id": chunk, "document_id": doc, "chunk_index": i, "topic": rng.choice([None, "a", "a", "b"]), "tokens": tokens, "bytes": len((text or "").encode())})
    ids = [x["chunk_id"] for x in chunks] + [9001, 9002]
    questions = [{"question_id": q, "question": "why? " * (1 if q != 11 else 7000), "marks": rng.choice([5, 10, 15]), "route": rng.choice(["semantic", "graph", "both", None]), "graph_state": rng.choice(["available", "available", None])} for q in range(24)]
    streams = {q["question_id"]: [rng.sample(ids, rng.choice([0, 3, 15])) for _ in range(4)] for q in questions}
    score = {(q, x): round(rng.random(), 6) for q in streams for x in ids}
    for x in ids[::9]:
        score[3, x] = None
    frames = [spark.createDataFrame([(q, x, r) for q, s in streams.items() for r, x in enumerate(s[n], 1)], "question_id long, chunk_id long, rank long") for n in range(4)]
    asked = spark.createDataFrame([tuple(q.values()) for q in questions] + [(90, " ", 5, None, None), (91, "why?", 7, None, None)], "question_id long, question string, marks int, route string, graph_state string")
    told = spark.createDataFrame([tuple(x.values()) for x in chunks], "chunk_id long, document_id long, chunk_index long, topic string, tokens long, bytes long")
    said = spark.createDataFrame([(x, d, None, t) for x, (d, t) in texts.items()], "chunk_id long, document string, page long, content string")
    scores = spark.createDataFrame([(*k, v) for k, v in score.items()], "question_id long, chunk_id long, score double")
    got = C.compare(asked, *frames, told, said, lambda pairs: pairs.join(scores, ["question_id", "chunk_id"]), held).collect()
    want = {}
    for q in questions:
        own = {x: v for (i, x), v in score.items() if i == q["question_id"]}
        want |= {(system, q["question_id"]): (reason, rows) for system, reason, rows in _twin(q, streams[q["question_id"]], chunks, texts, own, held, topic_bytes)}
    found = {}
    for r in sorted(got, key=lambda r: r.place or 0):
        assert (r.status == C.BLOCKED) == (r.reason is not None)
        found.setdefault((r.system, r.question_id), (r.reason, []))[1].extend([(r.chunk_id, r.whole, r.same_as)] if r.place else [])
    assert found == want
    reasons = {reason for reason, _ in want.values()}
    assert reasons >= {None, "complete_graph_snapshot_required", "common_reranker_not_ready", "fixed_parent_token_metadata_missing", "question_leaves_no_room"}
    assert any(not whole for _, rows in want.values() for _, whole, _ in rows) and any(same for _, rows in want.values() for _, _, same in rows)
    assert len({(r.system, r.configuration) for r in got}) == 21


def test_query_names_every_system(spark, sf):
    """Two counts of rows are no comparison: every question meets seven systems, each with its own sources."""
    from docweft.plans import registry

    df = registry.queries()["structured_query_controls"](spark, sf)
    per = {r.system: r.n for r in df.groupBy("system").agg(F.count_distinct("question_id").alias("n")).collect()}
    assert set(per) == set(C.SYSTEMS) and len(set(per.values())) == 1


def test_controls_out_of_range_are_refused():
    for wrong in ({"seeds": 0}, {"seeds": 21}, {"candidate_depth": 33}, {"candidate_depth": 4}, {"context_ceiling": 100}, {"graph_hops": 4}):
        with pytest.raises(ValueError):
            C.Controls(**wrong)
