"""Relations between claims and evidence sentences: support, contradiction, or neither, as plans over columns.

A claim and each sentence are segmented once into *features*: stems, values, units, negation, compared subjects, causes, roles.
Claims then meet sentences of their own answer's evidence by an equi-join on keys that every non-neutral relation shares: a stem, a
value, a compared adjective, a role, or, for claims of sameness, a sentence with two values. A pair is judged by one expression
over both feature sets, and pairs are folded per block and per claim. Nothing runs row by row outside the JVM.

Contradictions come first: another value or unit for the same subject, a reversed role, negation on one side of nearly equal
sentences, a comparison of another subject, a value of another attribute than the question asks. A cause or an absolute claim
needs evidence of the same force. Support needs the claim's head and either its values or most of its words. A claim that no
sentence decides is split at ``and`` and ``but``; its parts are judged as claims of their own.

``similar``, a column over ``claim`` and ``sentence``, may stand in for a model of paraphrase; without it none is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions import vocabulary as V
from docweft.operators.retrieve import small
from docweft.session import durable

SUPPORTED, CONTRADICTED, INSUFFICIENT = "SUPPORTED", "CONTRADICTED", "INSUFFICIENT_EVIDENCE"
#: Shares of a claim's words in a sentence for support, sameness of subject, contradiction and negation; of a question's for bare values; paraphrase.
LEXICAL, SUBJECT, CONTRADICTION, CONTRAST, ENTITY, PARAPHRASE_WORDS, PARAPHRASE = 0.60, 0.60, 0.75, 0.75, 0.50, 0.25, 0.80
WORD = "[a-z0-9][a-z0-9%/_-]*"
ROLE_PAIR = r"([A-Z]{2,6})\s*:\s*([A-Z]\w+(?:\s+[A-Z]\w+)*)"
CLAIM_ROLE = r"\b([A-Z]\w+(?:\s+[A-Z]\w+)*)\s+is\s+(?:the\s+)?([A-Z]{2,6})\b"
MONEY, PERCENT = r"\$\s*([\d,]+(?:\.\d+)?)", r"([\d.]+)\s*(?:percent|%)"
CHANGE, CHANGE_CUE = r"([\d.]+)\s*(?:percent|%)\s+from\s+([\d.]+)\s*(?:percent|%)", r"\b(?:increase|growth|grew|decrease|decline|rise|fall)\b"


def normalised(c: Column) -> Column:
    """Lower case, single spaces, number words as digits."""
    plain = T.normalize(F.coalesce(c, F.lit("")))
    digits = F.create_map(*[F.lit(x) for pair in V.NUMBER_WORDS.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(plain, r"\b"), lambda w: F.coalesce(F.try_element_at(digits, w), w)), "")
    return F.when(plain.rlike(r"\b(?:" + "|".join(V.NUMBER_WORDS) + r")\b"), spelled).otherwise(plain)


def words(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(WORD), F.lit(0))


def content(c: Column) -> Column:
    """Distinct stems of the content words of any text."""
    return F.array_distinct(T.stems(T.without(words(normalised(c)), V.CONTENT_STOPWORDS)))


def _has_any(norm: Column, phrases: list[str]) -> Column:
    return norm.rlike("(?<![a-z])(?:" + "|".join(phrases) + ")(?![a-z])")


def _compared(norm: Column) -> Column:
    """``array<struct<subject, how>>``: the two content words before each comparative."""

    def before(how: str) -> Column:
        parts = F.split(norm, how)
        ahead = lambda k: T.without(words(F.array_join(F.slice(parts, 1, k), how)), [*V.CONTENT_STOPWORDS, *V.CLAIM_NEGATIONS, *V.CLAIM_INTENSIFIERS])
        last_two = lambda k: F.struct(F.array_distinct(_tail(ahead(k), 2)).alias("subject"), F.lit(how).alias("how"))
        return F.when(norm.contains(how), F.transform(F.sequence(F.lit(1), F.size(parts) - 1), last_two))

    none = F.array().cast("array<struct<subject:array<string>,how:string>>")
    return F.filter(F.flatten(F.array(*[F.coalesce(before(how), none) for how in V.CLAIM_COMPARATIVES])), lambda x: F.size(x["subject"]) > 0)


def _tail(array: Column, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


def _figures(norm: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(norm, F.lit(T.NUMBER), F.lit(0)))


def features(frame: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds the features of ``text`` as columns that begin with ``prefix``."""
    p = lambda n: F.col(prefix + n)
    add = lambda f, **more: f.withColumns({prefix + n: e for n, e in more.items()})
    out = add(frame, norm=normalised(F.col(text)), own=normalised(T.strip_citations(F.col(text))))
    out = add(out, words=words(p("norm")), tokens=T.without(words(p("own")), V.CONTENT_STOPWORDS), figures=_figures(p("norm")))
    units = F.filter(F.array(*map(F.lit, V.CLAIM_UNITS)), lambda u: F.regexp_like(p("norm"), F.concat(F.lit("(?<![a-z])"), u, F.lit("(?![a-z])"))))
    out = add(out, units=F.when(_has_any(p("norm"), V.CLAIM_UNITS), units).otherwise(F.array().cast("array<string>")))
    plain = T.without(p("words"), [*V.CLAIM_NEGATIONS, *V.CONTENT_STOPWORDS])
    salient = F.filter(p("tokens"), lambda t: ~t.rlike("^[0-9]+$") & ~F.array_contains(p("units"), t) & ~t.isin(V.CLAIM_QUANTIFIERS))
    return add(
        out, stems=F.array_distinct(T.stems(T.without(p("words"), V.CONTENT_STOPWORDS))), token_stems=T.stems(p("tokens")), salient=T.stems(salient), plain=T.stems(plain),
        negated=F.arrays_overlap(p("words"), F.array(*map(F.lit, V.CLAIM_NEGATIONS))), compared=_compared(p("norm")), causal=_has_any(p("norm"), V.CLAIM_CAUSES),
        universal=_has_any(p("norm"), V.CLAIM_UNIVERSALS), same=F.col(text).rlike(r"(?i)\bsame\b"), tabular=F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("|"), F.lit(""))) >= 2,
        roles=F.regexp_extract_all(F.col(text), F.lit(ROLE_PAIR), F.lit(1)), names=F.transform(F.regexp_extract_all(F.col(text), F.lit(ROLE_PAIR), F.lit(2)), T.normalize),
        role=F.regexp_extract(F.col(text), CLAIM_ROLE, 2), person=T.normalize(F.regexp_extract(F.col(text), CLAIM_ROLE, 1)),
    )


def keys(prefix: str, sentence: bool) -> Column:
    """What a pair must share: stems, values, comparatives, roles, or sameness against two values."""
    p = lambda n: F.col(prefix + n)
    tag = lambda mark, a: F.transform(a, lambda x: F.concat(F.lit(mark), x))
    same = F.size(p("figures")) >= 2 if sentence else p("same")
    roles = p("roles") if sentence else F.array(p("role"))
    stems = p("stems") if sentence else F.array_union(p("token_stems"), p("plain"))
    return F.array_distinct(F.concat(stems, tag("#", p("figures")), tag(">", F.transform(p("compared"), lambda x: x["how"])), tag(":", roles), F.when(same, F.array(F.lit("="))).otherwise(F.array().cast("array<string>"))))


def _share(own: Column, there: Column) -> Column:
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.filter(own, lambda s: F.array_contains(there, s))) / F.size(own))


def _within(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def _other_subject(a: Column, b: Column) -> Column:
    both_differ = (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)
    return ~F.arrays_overlap(a, b) | both_differ


def _is_unit(token: Column) -> Column:
    return token.isin(V.SHORT_UNITS) | token.contains("/") | token.contains("%") | token.rlike("^[0-9]*[a-z]{1,3}$")


def value_only() -> Column:
    """Whether the claim states a value and nothing of its own."""
    return F.forall(F.filter(F.col("c_tokens"), lambda t: ~t.rlike("^[0-9]+$") & ~F.array_contains(F.col("c_units"), t) & ~t.isin(V.CLAIM_QUANTIFIERS)), _is_unit)


def _doubles(texts: Column) -> Column:
    return F.filter(F.transform(texts, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def prose_binding() -> Column:
    """Whether the sentence states another value for what the question asks: the amount before ``or``, a percentage and its change."""
    said, claimed, asks = F.col("sentence"), F.array_distinct(_doubles(F.col("c_figures"))), F.col("asked_stems")
    among = lambda ws: F.arrays_overlap(asks, F.array(*map(F.lit, ws)))
    amounts = F.transform(F.split(said, r"(?i)\bor\b"), lambda s: _doubles(F.regexp_extract_all(s, F.lit(MONEY), F.lit(1))))
    after = lambda k: F.get(F.flatten(F.slice(amounts, k + 1, 1 << 20)), F.lit(0))
    derived = F.exists(F.sequence(F.lit(1), F.greatest(F.size(amounts) - 1, F.lit(1))), lambda k: F.coalesce((F.array_max(F.flatten(F.slice(amounts, 1, k))) > after(k)) & (claimed == F.array(after(k))), F.lit(False)))
    money = among(V.BINDING_MONEY) & ~among(["share", "eps", "per"]) & (F.size(amounts) > 1) & derived
    shares = F.regexp_extract_all(said, F.lit(PERCENT), F.lit(1))
    there = _doubles(shares)
    first, base = F.regexp_extract(said, CHANGE, 1).try_cast("double"), F.regexp_extract(said, CHANGE, 2).try_cast("double")
    before_cue = _doubles(F.regexp_extract_all(F.get(F.split(said, CHANGE_CUE, 2), F.lit(0)), F.lit(PERCENT), F.lit(1)))
    changed = F.coalesce((claimed == F.array(first)) & (first != base), F.lit(False))
    cued = said.rlike(CHANGE_CUE) & (F.size(before_cue) > 0) & (claimed != _tail(before_cue, 1))
    percent = among(V.BINDING_PERCENT) & ~among(V.BINDING_CHANGE) & (F.size(there) >= 2) & _within(claimed, there) & (changed | cued)
    return F.coalesce(F.col("value_only") & F.col("asked_stems").isNotNull() & (F.size(claimed) > 0) & (money | percent), F.lit(False))


def relation(similar: Column | None = None) -> Column:
    """``supports``, ``contradicts`` or ``neutral`` of the claim (``c_``) and the sentence (``s_``) of a row."""
    c, s = lambda n: F.col("c_" + n), lambda n: F.col("s_" + n)
    has_values = F.size(c("figures")) > 0
    salient, overlap = _share(c("salient"), s("stems")), _share(c("token_stems"), s("stems"))
    values_fit, units_fit = _within(c("figures"), s("figures")), _within(c("units"), s("units"))
    other_value = has_values & (salient >= CONTRADICTION) & ~(values_fit & units_fit)
    held = F.get(F.filter(F.arrays_zip(s("roles"), s("names")), lambda x: x["s_roles"] == c("role")), F.lit(0))["s_names"]
    other_role = (c("role") != "") & F.coalesce(~c("person").contains(held) & ~held.contains(c("person")), F.lit(False))
    denied = (c("negated") != s("negated")) & ~has_values & ~s("tabular") & (_share(c("plain"), s("plain")) >= CONTRAST)
    other_compared = F.exists(c("compared"), lambda a: F.exists(s("compared"), lambda b: (a["how"] == b["how"]) & _other_subject(a["subject"], b["subject"])))
    head = (F.size(c("salient")) == 0) | F.coalesce(F.array_contains(s("stems"), F.get(c("salient"), F.lit(0))), F.lit(False))
    asked = F.col("asked_stems")
    entity = F.when(F.coalesce(F.size(asked), F.lit(0)) <= 0, F.size(c("units")) > 0).otherwise(F.size(F.array_intersect(asked, s("stems"))) / F.size(asked) >= ENTITY)
    paraphrase = F.lit(False) if similar is None else head & ~has_values & (overlap >= PARAPHRASE_WORDS) & (similar >= PARAPHRASE)
    by_value = has_values & values_fit & units_fit & (((salient >= SUBJECT) & head) | ((F.size(c("salient")) == 0) & entity))
    return (
        F.when(other_value | other_role | (c("same") & (F.size(s("figures")) >= 2)) | denied | other_compared, "contradicts")
        .when((c("causal") & ~s("causal")) | (c("universal") & ~s("universal")), "neutral")
        .when(prose_binding(), "contradicts")
        .when(paraphrase | by_value | ((overlap >= LEXICAL) & head & values_fit & units_fit), "supports")
        .otherwise("neutral")
    )


def bound_to_tables(bound: DataFrame) -> DataFrame:
    """Adds ``binding``: ``contradicts``, ``misbound`` or null, a bare value against the column of the block's table that the question asks for."""
    cells = lambda line: F.transform(F.split(line, r"\|"), lambda x: F.trim(x))
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: x.contains("|"))
    out = bound.withColumn("_lines", F.when(F.col("value_only") & F.col("asked_stems").isNotNull() & F.col("content").contains("|"), lines))
    out = out.withColumn("_header", F.when(F.size("_lines") >= 2, cells(F.get("_lines", F.lit(0))))).withColumn("_terms", F.array_except("asked_stems", F.array(*map(F.lit, V.BINDING_GENERIC))))
    out = out.withColumn("_rows", F.filter(F.transform(F.slice("_lines", 2, 1 << 20), cells), lambda r: F.size(r) == F.size("_header"))).withColumn("_stems", F.transform("_header", content))
    out = out.withColumn("_scores", F.transform("_stems", lambda x: F.size(F.array_intersect(x, F.col("_terms"))))).withColumn("_row_scores", F.transform("_rows", lambda r: F.size(F.array_intersect(content(F.array_join(r, " ")), F.col("_terms")))))
    out = out.withColumn("_valued", F.filter(F.transform("_stems", lambda x, i: F.when(F.arrays_overlap(x, F.array(*map(F.lit, V.BINDING_VALUE_COLUMNS))), i)), lambda i: i.isNotNull())).withColumn("_top", F.array_max("_scores")).withColumn("_row_top", F.array_max("_row_scores"))
    by_words = F.when((F.col("_top") > 0) & (F.size(F.filter("_scores", lambda x: x == F.col("_top"))) == 1), F.array_position("_scores", F.col("_top")).cast("int") - 1)
    value_asked = F.arrays_overlap(F.col("asked_stems"), F.array(*map(F.lit, V.BINDING_VALUE_CUES)))
    out = out.withColumn("_column", F.when(value_asked & (F.size("_valued") == 1), F.get("_valued", F.lit(0))).otherwise(by_words))
    out = out.withColumn("_relevant", F.when(F.col("_row_top") > 0, F.filter("_rows", lambda r, i: F.get("_row_scores", i) == F.col("_row_top"))).when(F.size("_rows") == 1, F.col("_rows")))
    bare = F.regexp_replace("c_own", r"^[ .]+|[ .]+$", "")
    inside = lambda cell: F.when(F.size("c_figures") > 0, _within(F.col("c_figures"), _figures(normalised(cell)))).otherwise((bare != "") & normalised(cell).contains(bare))

    def judged(r: Column) -> Column:
        numbers = _figures(normalised(F.get(r, F.col("_column"))))
        against = (F.size("c_figures") > 0) & (F.size(numbers) > 0) & ~F.arrays_overlap(numbers, F.col("c_figures"))
        return F.when(inside(F.get(r, F.col("_column"))), "aligned").when(F.exists(r, inside), F.when(against, "contradicts").otherwise("misbound"))

    out = out.withColumn("_found", F.when((F.size("_terms") > 0) & F.col("_column").isNotNull(), F.transform("_relevant", judged)))
    holds = lambda what: F.coalesce(F.array_contains("_found", what), F.lit(False))
    decided = F.when(holds("aligned"), None).when(holds("contradicts"), "contradicts").when(holds("misbound"), "misbound")
    return out.withColumn("binding", decided).select(*bound.columns, "binding")


def sentences(blocks: DataFrame) -> DataFrame:
    """The different sentences of ``blocks(answer_id, block, content)`` with their features, written."""
    said = blocks.select("answer_id", "block", F.explode(T.sentences(F.col("content"))).alias("sentence")).distinct()
    return durable(features(said, "sentence", "s_").withColumn("_sid", F.struct("block", "sentence")))


def _judged(claims: DataFrame, blocks: DataFrame, similar: Column | None, said: DataFrame) -> DataFrame:
    """``claim_id, part, supporting, contradicting, misbound, best, unknown`` of claims and parts, each on its own."""
    told = claims.withColumn("claim", F.trim(T.strip_citations(F.coalesce(F.col("claim"), F.lit("")))))
    told = features(told, "claim", "c_").withColumn("asked_stems", F.when(F.trim(F.coalesce("question", F.lit(""))) != "", content(F.col("question"))))
    told = durable(told.withColumn("value_only", value_only()))  # both feature sets meet several times: computed once each
    few = small(told)  # few claims go to every task, so that no features are shuffled
    bound = bound_to_tables(few.where("claim <> ''").join(blocks, "answer_id"))
    named = F.filter(F.slice(F.regexp_extract_all("claim", F.lit(r"[A-Za-z][\w-]*"), F.lit(0)), 2, 1 << 20), lambda w: w.rlike("^[A-Z]") & (w != "I"))
    seen = bound.select("claim_id", "part", "block", "binding", F.transform(F.array_distinct(named), F.lower).alias("_names"), F.lower("content").alias("_text"))
    seen = seen.withColumn("_found", F.filter("_names", lambda w: F.col("_text").contains(w)))
    per_block = seen.select("claim_id", "part", "block", "binding", "_names", "_found")
    if few is not told:
        asked = F.broadcast(told.where("claim <> ''").withColumn("_ck", keys("c_", False)))
        met = said.withColumn("_sk", keys("s_", True)).join(asked, "answer_id").where(F.arrays_overlap("_ck", "_sk"))
    else:
        left = told.where("claim <> ''").select("claim_id", "part", "answer_id", F.explode(keys("c_", False)).alias("_key"))
        right = said.select("answer_id", "_sid", F.explode(keys("s_", True)).alias("_key"))
        pairs = left.join(right, ["answer_id", "_key"]).select("claim_id", "part", "answer_id", "_sid").distinct()
        met = pairs.join(told, ["claim_id", "part", "answer_id"]).join(said, ["answer_id", "_sid"])
    ruled = met.select("claim_id", "part", F.col("block"), relation(similar).alias("_r"), F.round(_share(F.col("c_token_stems"), F.col("s_stems")), 4).alias("_o"))
    folded = ruled.groupBy("claim_id", "part", "block").agg(F.bool_or(F.col("_r") == "supports").alias("_yes"), F.bool_or(F.col("_r") == "contradicts").alias("_no"), F.max("_o").alias("_best"))
    merged = per_block.join(folded, ["claim_id", "part", "block"], "left")
    free = F.col("binding").isNull()
    yes, no = free & F.coalesce("_yes", F.lit(False)), (F.col("binding") == "contradicts") | (free & F.coalesce("_no", F.lit(False)))
    return merged.groupBy("claim_id", "part").agg(
        F.sort_array(F.collect_set(F.when(yes, F.col("block")))).alias("supporting"), F.sort_array(F.collect_set(F.when(no, F.col("block")))).alias("contradicting"), F.coalesce(F.bool_or(F.col("binding") == "misbound"), F.lit(False)).alias("misbound"),
        F.max(F.when(free, F.coalesce("_best", F.lit(0.0)))).alias("best"), (F.size(F.first("_names")) > F.size(F.array_distinct(F.flatten(F.collect_list("_found"))))).alias("unknown"),
    )


def verify_claims(claims: DataFrame, blocks: DataFrame, similar: Column | None = None, said: DataFrame | None = None) -> DataFrame:
    """``claim_id, label, supporting, contradicting, citation_ok, misbound, best`` of ``claims(claim_id, answer_id, claim, question, stated)``
    against ``blocks(answer_id, block, content)``, the evidence of each answer; ``said`` are its ``sentences``, if known."""
    whole = claims.select("claim_id", "answer_id", "claim", "question", F.lit(0).alias("part"))
    parts = F.filter(F.transform(F.split(F.trim(T.strip_citations(F.coalesce(F.col("claim"), F.lit("")))), r"\s+(?:and|but)\s+"), lambda x: F.trim(x)), lambda x: x != "")
    split = claims.where(F.size(parts) > 1).select("claim_id", "answer_id", "question", F.posexplode(F.filter(parts, lambda x: F.size(T.content_tokens(x)) >= 2)).alias("_k", "claim"))
    every = whole.unionByName(split.select("claim_id", "answer_id", "claim", "question", (F.col("_k") + 1).alias("part")))
    for_claims = claims.join(blocks.select("answer_id").distinct(), "answer_id", "left_semi")
    label = (
        F.when(F.size("contradicting") > 0, CONTRADICTED).when(F.size("supporting") > 0, F.when(F.col("unknown"), INSUFFICIENT).otherwise(SUPPORTED)).otherwise(INSUFFICIENT)
    )
    judged = _judged(every.join(for_claims.select("claim_id"), "claim_id", "left_semi"), blocks, similar, sentences(blocks) if said is None else said).withColumn("label", label)
    own = judged.where("part = 0")
    of_parts = judged.where("part > 0").groupBy("claim_id").agg(
        F.bool_and(F.col("label") == SUPPORTED).alias("_all"), F.bool_or(F.col("label") == CONTRADICTED).alias("_any"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("supporting")))).alias("_supporting"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("contradicting")))).alias("_contradicting"), F.max("best").alias("_best"),
    )
    met = claims.select("claim_id", F.coalesce("stated", F.array().cast("array<int>")).alias("stated")).join(own, "claim_id", "left").join(of_parts, "claim_id", "left")
    kind = dict(own.dtypes)["supporting"]
    none = F.array().cast(kind)
    undecided = (F.size("supporting") == 0) & (F.size("contradicting") == 0)
    by_parts = F.coalesce(undecided & (F.col("_all") | F.col("_any")), F.lit(False))
    supporting = F.when(by_parts, F.col("_supporting")).otherwise(F.coalesce("supporting", none))
    cited = (F.size("stated") == 0) | F.arrays_overlap(F.col("stated").cast(kind), supporting)
    return met.select(
        "claim_id", F.when(by_parts, F.when(F.col("_all"), SUPPORTED).otherwise(CONTRADICTED)).otherwise(F.coalesce("label", F.lit(INSUFFICIENT))).alias("label"), supporting.alias("supporting"),
        F.when(by_parts, F.col("_contradicting")).otherwise(F.coalesce("contradicting", none)).alias("contradicting"), F.when(by_parts & ~F.col("_all"), F.lit(True)).otherwise(F.coalesce(cited, F.lit(False))).alias("citation_ok"),
        F.coalesce("misbound", F.lit(False)).alias("misbound"), F.when(by_parts & F.col("_all"), F.col("_best")).otherwise(F.coalesce("best", F.lit(0.0))).alias("best"),
    )
