"""Quality rules as a short-circuit cascade ordered by measured rejection per cost.

Every rule is a Boolean expression that is true for a document to reject. A bounded sample gives each rule's cost (wall
time of evaluating it alone) and its rejection rate; rules then run in descending rejection per second, each seeing only
what the ones before it let through, because ``AND`` stops at the first false operand. The order never changes the
verdict, only its price. A rule's cost is the least of ``READINGS`` timings.

Defined cases: null text has no words and is rejected; an empty text likewise; null ids and repeated rows are judged like
any other row; an empty table gives an empty result; extra columns, whatever their names, pass through ``keep`` untouched.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.registry import query
from docweft.llm.words import SPACES, count_chars, words
from docweft.session import table

#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_SYMBOLS_PER_100_WORDS = 30
MAX_CAPITALS_PERCENT = 40
MAX_DUP_LINES_PERCENT = 50
MAX_STUTTER_PERCENT = 30
WORD_LENGTH = (2.0, 20.0)
#: Rows of the sample that orders the cascade.
SAMPLE_ROWS = 1024
READINGS = 2


@dataclass(frozen=True)
class Rule:
    """``reject`` may use the columns that ``features`` of the same depth provides (``deep`` needs word windows)."""

    name: str
    reject: Column
    deep: bool = False


def _n(name: str, value: Column) -> Column:
    return value.cast("long").alias(name)


def shallow(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the features that need one pass over the characters: ``_words _n_words _word_chars ...``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    with_words = docs.withColumn("_words", words(F.col(text)))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return with_words.withColumn("_lines", lines).withColumns(
        {
            "_n_words": F.size("_words").cast("long"),
            "_word_chars": (F.length(whole) - count_chars(F.col(text), SPACES)).cast("long"),
            "_n_symbols": count_chars(F.col(text), SYMBOLS),
            "_n_capitals": count_chars(F.col(text), CAPITALS),
            "_n_stutter": F.size(F.filter("_words", lambda w, i: w.eqNullSafe(F.get(F.col("_words"), i - 1)))).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )


def deep(featured: DataFrame) -> DataFrame:
    """Adds ``_n_repeat_words``: words inside 8-word windows that occur twice or more in the same text.

    One row's windows never leave the row: they are hashed to longs in order, and only a row whose hashes are not all
    distinct pays for sorting them with their positions.
    """
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    some = F.col("_n_words") > WINDOW
    windows = F.when(
        some,
        F.transform(
            F.sequence(F.lit(0), F.size("_h") - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    repeated = F.size(F.array_distinct("_win")) < F.size("_win")
    placed = F.when(repeated, F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    twin = F.filter(
        "_placed",
        lambda x, j: F.coalesce(F.get(F.col("_placed"), j - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(F.col("_placed"), j + 1)["h"] == x["h"], F.lit(False)),
    )
    starts = F.sort_array(F.transform("_twin", lambda x: x["i"]))
    covered = F.aggregate(
        F.transform("_starts", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_starts"), j + 1) - x, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return (
        featured.withColumn("_h", hashes)
        .withColumn("_win", windows)
        .withColumn("_placed", placed)
        .withColumn("_twin", twin)
        .withColumn("_starts", starts)
        .withColumn("_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    )


def rules() -> list[Rule]:
    """The production rules, in no particular order."""
    c = F.col
    return [
        Rule("too_short", c("_n_words") < MIN_WORDS),
        Rule("repeats", 100 * c("_n_repeat_words") > MAX_REPEAT_PERCENT * c("_n_words"), deep=True),
        Rule("symbols", 100 * c("_n_symbols") > MAX_SYMBOLS_PER_100_WORDS * c("_n_words")),
        Rule("capitals", 100 * c("_n_capitals") > MAX_CAPITALS_PERCENT * c("_word_chars")),
        Rule("stutter", 100 * c("_n_stutter") > MAX_STUTTER_PERCENT * c("_n_words")),
        Rule("dup_lines", (c("_n_dup_lines") > 2) & (100 * c("_n_dup_lines") > MAX_DUP_LINES_PERCENT * c("_n_lines"))),
        Rule("word_length", (c("_word_chars") < WORD_LENGTH[0] * c("_n_words")) | (c("_word_chars") > WORD_LENGTH[1] * c("_n_words"))),
    ]


def order_rules(docs: DataFrame, chosen: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules with their cost in seconds and rejection rate on the sample, best rejection per cost first.

    The sample has at most ``sample_rows`` rows, drawn with a fixed seed. A rule's cost includes the features it needs,
    so a rule over word windows is charged for them.
    """
    total = docs.count()
    if not total:
        return [(r, 0.0, 0.0) for r in chosen]
    sample = docs.select(text).sample(False, min(1.0, 1.5 * sample_rows / total), 7).limit(sample_rows).persist()
    try:
        rows = max(1, sample.count())

        def timed(frame: DataFrame, reject: Column) -> tuple[float, float]:
            began = time.perf_counter()
            hits = frame.agg(F.count_if(F.coalesce(reject, F.lit(True)))).first()[0]
            return time.perf_counter() - began, hits / rows

        timed(sample, F.lit(False))
        idle, _ = timed(sample, F.lit(False))
        measured = []
        for rule in chosen:
            frame = shallow(sample, text)
            readings = [timed(deep(frame) if rule.deep else frame, rule.reject) for _ in range(READINGS)]
            measured.append((rule, max(min(took for took, _ in readings) - idle, 1e-3), readings[0][1]))
    finally:
        sample.unpersist()
    return sorted(measured, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def keep(docs: DataFrame, text: str = "text", chosen: list[Rule] | None = None) -> DataFrame:
    """The documents that pass every rule, with their own columns only.

    Rules over cheap features are one ``AND`` chain in measured order; the word windows are built only for the rows that
    chain lets through, unless the sample says that they reject more per second.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    out, has_deep, passed = shallow(held, "_text"), False, []
    for rule, _, _ in order_rules(docs, chosen or rules(), text):
        if rule.deep and not has_deep:
            out, has_deep, passed = deep(_gate(out, passed)), True, []
        passed.append(rule)
    return _gate(out, passed).select("_row.*")


def _gate(frame: DataFrame, chosen: list[Rule]) -> DataFrame:
    """Rows that no rule of ``chosen`` rejects, tested in order up to the first hit.

    An exploded array of no or one element drops the rest: the optimiser would push a plain filter below the features,
    copying their expressions into it and evaluating them again inside each other's lambdas.
    """
    if not chosen:
        return frame
    chain = None
    for rule in chosen:
        hit = F.coalesce(rule.reject, F.lit(True))
        chain = F.when(hit, F.lit(False)) if chain is None else chain.when(hit, F.lit(False))
    return frame.withColumn("_pass", F.explode(F.when(chain.otherwise(F.lit(True)), F.array(F.lit(1))))).drop("_pass")


def verdicts(docs: DataFrame, text: str = "text", chosen: list[Rule] | None = None) -> DataFrame:
    """All columns of ``docs`` plus the features (``_``-prefixed), ``_base_failed``, ``_kept`` and ``_rejected_by``.

    The cascade is one CASE chain in measured order: its first true branch ends the evaluation of a row.
    """
    ordered = order_rules(docs, chosen or rules(), text)
    chain = None
    for rule, _, _ in ordered:
        hit = F.coalesce(rule.reject, F.lit(True))
        chain = F.when(hit, rule.name) if chain is None else chain.when(hit, rule.name)
    base = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words"))
    return deep(shallow(docs, text)).withColumn("_base_failed", base).withColumn("_rejected_by", chain).withColumn("_kept", F.col("_rejected_by").isNull() & ~F.col("_base_failed"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
f AS (SELECT r, doc_id, ws, len(ws) AS n, len(list_filter(ws, lambda x, i: i > 1 AND x = ws[i - 1])) AS st, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS wc,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS sy, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS cap,
  len(ls) AS nl, len(ls) - len(list_distinct(ls)) AS dl FROM w),
win AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, n - 6)) AS i FROM f WHERE n >= 8)),
tw AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM win) WHERE k > 1),
cov AS (SELECT r, sum(least(8, coalesce(nx - i, 8))) AS rep FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM tw) GROUP BY r),
a AS (SELECT f.*, coalesce(rep, 0) AS rep FROM f LEFT JOIN cov USING (r))
SELECT doc_id, n::BIGINT AS n_words, wc::BIGINT AS word_chars, sy::BIGINT AS n_symbols, dl::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words,
  (n < 20 OR 100 * rep > 30 * n) AS base_failed,
  NOT (n < 20 OR 100 * rep > 30 * n OR 100 * sy > 30 * n OR 100 * cap > 40 * wc OR (dl > 2 AND 100 * dl > 50 * nl) OR 100 * st > 30 * n OR wc < 2.0 * n OR wc > 20.0 * n) AS kept
FROM a
"""


@query("op1_quality_rules", ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document (native DataFrame functions only)."""
    out = verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        _n("n_words", F.col("_n_words")),
        _n("word_chars", F.col("_word_chars")),
        _n("n_symbols", F.col("_n_symbols")),
        _n("n_dup_lines", F.col("_n_dup_lines")),
        _n("n_repeat_words", F.col("_n_repeat_words")),
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
    )
