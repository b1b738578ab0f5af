"""Source divergence audit: how far each source's use of terms lies from every other source of its language, exactly.

A term is a maximal run of ASCII letters and non-ASCII characters, ``A-Z`` lower-cased and nothing else. A language keeps the
terms that lie in at least ``LEAST_DOCS`` of its documents. A (language, source) group with ``N`` kept words gives a kept term of
``count`` occurrences ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``; the divergence of two sources sums ``abs(p - q)``.

1. Documents are split once. All words and each document's distinct words are exploded as two runs of the same row, so that one
   aggregation with map-side combine gives occurrences and document counts; a hot source or word shrinks before the shuffle.
2. One window per (language, term), of at most one row per source, finds kept terms and their totals.
3. Per pair of sources a *joint count histogram* is tallied: how many terms have (count in a, count in b). Only terms that both
   have meet in a join; cells with a zero are implied by inclusion and exclusion: terms with count ``c`` in ``a`` less those that
   met, and all kept terms less those of either source. A pair costs its distinct count combinations, not its vocabulary.
4. ``f`` is evaluated once per combination and multiplied; shares use 38-digit decimals, so nothing is rounded or overflows.

Defined cases: null text, language and source are empty strings; a group without terms takes part with zero counts; a language
that keeps no term gives value 0 for each pair and no terms; repeated rows count as documents of their own; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.llm.registry import query
from docweft.session import durable, release, table

#: Documents that a kept term needs, the added count, the scale of shares, ranks of terms.
LEAST_DOCS = 30
ADDED = 5
SCALE = 1_000_000_000
MOST_TERMS = 50

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs between terms, once A-Z are lower-cased.
BETWEEN = "[\\x00-\\x60\\x7B-\\x7F]+"


def terms(text: Column) -> Column:
    """The terms of ``text`` in order, with empty strings at the ends where it does not begin or end with one."""
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(whole) == F.char_length(whole)
    return F.split(F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER)), BETWEEN)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``; every group also has the empty term."""
    named = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    split = docs.select(named(lang).alias("lang"), named(source).alias("source"), terms(F.col(f"`{text}`")).alias("_t"))
    runs = split.select("lang", "source", F.posexplode(F.array(F.concat(F.array(F.lit("")), "_t"), F.array_distinct("_t"))).alias("_once", "_t"))
    each = runs.select("lang", "source", "_once", F.explode("_t").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("_once") == 0).alias("n"), F.count_if(F.col("_once") == 1).alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept))`` as long; null where nothing is kept."""
    wide = lambda c: c.cast("decimal(19,0)")
    below = F.nullif(wide(total) + wide(kept) * ADDED, F.lit(0).cast("decimal(19,0)"))
    whole = (F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + ADDED)).cast("decimal(38,0)")
    return (F.call_function("div", whole, below.cast("decimal(38,0)")) + 1).cast("long")


def kept_cells(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n, total, leads`` of kept terms that occur in the group; one row per term ``leads``."""
    over = Window.partitionBy("lang", "term")
    seen = counts.where("term <> ''").select("lang", "source", "term", "n", F.sum("docs").over(over).alias("_docs"), F.sum("n").over(over).alias("total"), (F.min("source").over(over) == F.col("source")).cast("long").alias("leads"))
    return seen.where(F.col("_docs") >= least_docs).drop("_docs")


def sizes(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """``lang, source, words, terms, v, lang_words`` of every group: its kept words and terms, its language's terms and words."""
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("terms"))
    whole = cells.groupBy("lang").agg(F.sum("leads").alias("v"), F.sum("n").alias("lang_words"))
    groups = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    return groups.na.fill(0, ["words", "terms", "v", "lang_words"])


def joint_histograms(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """``lang, a, b, ca, cb, m``: for each pair, the number ``m > 0`` of kept terms with these two counts, zeros included."""
    left = cells.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("ca"))
    right = cells.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("cb"))
    met = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "ca", "cb").agg(F.count(F.lit(1)).alias("m"))
    combos = "stack(4, ca, cb, m, ca, 0L, -m, 0L, cb, -m, 0L, 0L, m) AS (ca, cb, m)"
    alone = cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    of_a = pairs.select("lang", "a", "b").join(alone.select("lang", F.col("source").alias("a"), F.col("n").alias("ca"), "m"), ["lang", "a"]).select("lang", "a", "b", "ca", F.lit(0).cast("long").alias("cb"), "m")
    of_b = pairs.select("lang", "a", "b").join(alone.select("lang", F.col("source").alias("b"), F.col("n").alias("cb"), "m"), ["lang", "b"]).select("lang", "a", "b", F.lit(0).cast("long").alias("ca"), "cb", "m")
    neither = pairs.select("lang", "a", "b", F.lit(0).cast("long").alias("ca"), F.lit(0).cast("long").alias("cb"), (F.col("v") - F.col("terms_a") - F.col("terms_b")).alias("m"))
    every = met.selectExpr("lang", "a", "b", combos).unionByName(of_a).unionByName(of_b).unionByName(neither)
    return every.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m <> 0")


def pair_divergence(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each ordered pair of sources of a language."""
    side = lambda s: groups.select("lang", F.col("source").alias(s), F.col("words").alias(f"words_{s}"), F.col("terms").alias(f"terms_{s}"), *(["v"] if s == "a" else []))
    pairs = side("a").join(side("b"), "lang").where("a < b")
    tallied = joint_histograms(cells, pairs).join(pairs, ["lang", "a", "b"])
    f = F.abs(share(F.col("ca"), F.col("words_a"), F.col("v")) - share(F.col("cb"), F.col("words_b"), F.col("v")))
    summed = tallied.groupBy("lang", "a", "b").agg(F.sum(f * F.col("m")).alias("value"))
    values = pairs.select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
    return values.selectExpr("lang", "stack(2, a, b, b, a) AS (source, item)", "value")


def term_divergence(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each kept term that a group uses more than its language does."""
    met = cells.join(groups, ["lang", "source"])
    more = met.select("lang", "source", F.col("term").alias("item"), (share(F.col("n"), F.col("words"), F.col("v")) - share(F.col("total"), F.col("lang_words"), F.col("v"))).alias("value"))
    return more.where("value > 0")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs (``pair``) and each group's ``most_terms`` telling terms (``term``)."""
    counts = durable(term_counts(docs, text, lang, source))
    cells = durable(kept_cells(counts, least_docs))
    groups = durable(sizes(counts, cells))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda frame, part: frame.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    out = durable(ranked(pair_divergence(cells, groups), "pair").unionByName(ranked(term_divergence(cells, groups), "term").where(F.col("rank") <= most_terms)))
    release(counts, cells, groups)
    return out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM w) GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
  1 + (1000000000 * (sum(n) OVER (PARTITION BY lang, term) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM c JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u) WHERE part = 'pair' OR rank <= 50
"""


@query("op13_source_audit", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of sources, and telling terms, over all documents (native DataFrame functions only)."""
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))
