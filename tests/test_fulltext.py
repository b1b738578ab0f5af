"""Full-text search against a plain reading of its definition."""

import re

import numpy as np
import pytest

from docweft.functions import vocabulary as V
from docweft.operators import fulltext


def stem(w):
    for suffix in V.SUFFIXES:
        if w.endswith(suffix) and len(w) - len(suffix) >= 4:
            return w[: len(w) - len(suffix)]
    return w


def tokens(text):
    return [(i, stem(w)) for i, w in enumerate(re.findall("[a-z0-9]+", (text or "").lower())) if w not in V.QUERY_STOPWORDS]


def plain_units(question):
    alts, units = [[]], []
    for part in re.findall(r'-?"[^"]*"|[^\s"]+', (question or "").lower()):
        if part == "or":
            alts.append([])
        elif tokens(part):
            alts[-1].append(len(units))
            units.append((part.startswith("-"), tokens(part)))
    return alts, units


def plain_score(question, text):
    """None without a match; else the density, by scanning forward to an end and back to the latest start."""
    alts, units = plain_units(question)
    words = dict(tokens(text))
    spots = [[p for p, w in words.items() if w == u[1][0][1] and all(words.get(p + k - u[1][0][0]) == x for k, x in u[1])] for u in units]
    span = [u[1][-1][0] - u[1][0][0] for u in units]
    wanted = [[u for u in alt if not units[u][0]] for alt in alts]
    if not any(w and all(spots[u] for u in w) and not any(spots[u] for u in alt if units[u][0]) for w, alt in zip(wanted, alts, strict=True)):
        return None
    inside = lambda a, b: any(w and all(any(a <= p and p + span[u] <= b for p in spots[u]) for u in w) for w in wanted)
    named = sorted({p + k - units[u][1][0][0] for u in range(len(units)) if not units[u][0] for p in spots[u] for k, _ in units[u][1]})
    total, begin = 0.0, 0
    while begin < len(named):
        end = next((e for e in named[begin:] if inside(named[begin], e)), None)
        if end is None:
            break
        start = max(p for p in named if p <= end and inside(p, end))
        total += 0.1 / (1 + end - start - (named.index(end) - named.index(start)))
        begin = named.index(start) + 1
    return round(total, 6)


QUESTIONS = [
    "red fox", '"red fox"', "red -fox", '"red fox" or blue', "fox or -red blue", "-fox", "", None, "the of", '"fox the red"', "red red fox", "fr-27 pump", 'pump -"red fox"', "green or blue or fox", "absentword fox", "absentword or fox",
    "RUNNING foxes", '"red fox" "blue pump"', "red or red", '"', "or", "- -- fox", '"red  FOX" -green',
]


def test_search_equals_plain(spark):
    rng = np.random.default_rng(1)
    words = ["red", "fox", "the", "blue", "pump", "fr", "27", "of", "green", "running", "runs"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 25)))) for _ in range(150)] + [None, "", "red " * 3000 + "fox", "Red-fox FR-27 pump."] + ["red fox"] * 30
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id long, question string")
    asked = fulltext.units(questions)
    want = {}
    for q, question in enumerate(QUESTIONS):
        scored = sorted((-s, i) for i, s in ((i, plain_score(question, t)) for i, t in enumerate(texts)) if s is not None)
        want |= {(q, i): (-s, rank + 1) for rank, (s, i) in enumerate(scored[:25])}
    for index in (fulltext.positions(chunks), fulltext.positions(chunks, asked)):
        got = {(r.question_id, r.chunk_id): (r.score, r["rank"]) for r in fulltext.search(questions, index, 25).collect()}
        assert got.keys() == want.keys()
        assert all(got[key][0] == pytest.approx(want[key][0], abs=2e-6) for key in want)
    assert {q for q, _ in want} >= {0, 1, 2, 3, 9, 11, 12, 13} and not {q for q, _ in want} & {5, 6, 7, 8, 14, 19, 20}


def test_only_rarest_words_meet_the_index(spark):
    chunks = spark.createDataFrame([(i, "common " * 3 + ("rare" if i == 7 else "x")) for i in range(200)], "chunk_id long, content string")
    asked = fulltext.units(spark.createDataFrame([(1, "common rare")], "question_id long, question string"))
    index = fulltext.positions(chunks)
    assert [r.chunk_id for r in fulltext.candidates(asked, index).collect()] == [7]
    assert fulltext.search(None, index, 5, asked).first().score == 0.1
