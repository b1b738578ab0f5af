"""Scalar text functions as native column expressions. Tokenisers differ on purpose and are not unified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.functions import vocabulary as V

CONTENT_TOKEN = r"[a-z0-9][a-z0-9.%/-]*"
NUMBER = r"\d+(?:[.,]\d+)*"


def words_of(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def without(tokens: Column, stop: list[str]) -> Column:
    """Tokens outside ``stop``, order and repeats kept."""
    return F.filter(tokens, lambda t: ~t.isin(stop))


def normalize(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def alnum_tokens(c: Column) -> Column:
    return words_of(c, "[a-z0-9]+")


def content_tokens(c: Column) -> Column:
    return without(words_of(c, CONTENT_TOKEN), V.CONTENT_STOPWORDS)


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)))


def stem(t: Column) -> Column:
    """The first suffix that fits and leaves four letters is cut."""
    out = None
    for suffix in V.SUFFIXES:
        hit = t.endswith(suffix) & (F.length(t) - len(suffix) >= 4)
        cut = t.substr(F.lit(1), F.length(t) - len(suffix))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(t)


def stems(tokens: Column) -> Column:
    return F.transform(tokens, stem)


def question_terms(c: Column, most: int = 8) -> Column:
    kept = F.filter(alnum_tokens(c), lambda t: (F.length(t) >= 3) & ~t.isin(V.TERM_STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def query_terms(c: Column) -> Column:
    return F.array_distinct(without(alnum_tokens(c), V.QUERY_STOPWORDS))


def overlap(terms: Column, c: Column) -> Column:
    """Share of ``terms`` present in the text as tokens; 0 without terms."""
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.array_intersect(terms, alnum_tokens(c))) / F.size(terms))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def _gram(tokens: Column, n: int):
    return lambda i: F.array_join(F.slice(tokens, i, n), " ")


def phrases(c: Column, longest: int = 6, most: int = 96) -> Column:
    """Shingles of 1 to ``longest`` words, longest first, then by text; single words need three letters and no stop word."""
    tokens = alnum_tokens(c)
    parts = []
    for n in range(longest, 0, -1):
        grams = F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), _gram(tokens, n))).otherwise(
            F.array().cast("array<string>")
        )
        if n == 1:
            grams = F.filter(grams, lambda t: (F.length(t) >= 3) & ~t.isin(V.ENTITY_STOPWORDS))
        parts.append(F.array_sort(F.array_distinct(grams)))
    return F.slice(F.flatten(F.array(*parts)), 1, most)


def token_estimate(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(c) / 4))).cast("long")


def byte_token_estimate(c: Column) -> Column:
    return F.ceil(F.octet_length(c) / 2).cast("long")


def usable_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")).cast("long")


def norm_path(c: Column) -> Column:
    """``A > B`` text to trimmed, non-blank headings."""
    return F.filter(F.transform(F.split(c, ">"), lambda h: F.trim(h)), lambda h: h != "")


def parent_heading(path: Column) -> Column:
    return F.when(F.size(path) >= 2, F.element_at(path, -2))


def heading_leaf(path: Column) -> Column:
    return F.when(F.size(path) >= 1, F.lower(F.element_at(path, -1)))


def heading_prefix(path: Column, content: Column, is_heading: Column) -> Column:
    return F.when(is_heading | (F.size(path) == 0), content).otherwise(F.concat(F.array_join(path, " > "), F.lit("\n\n"), content))


def segments(c: Column) -> Column:
    """Pieces that end at sentence punctuation before white space, or at a newline; together they are the text."""
    marked = F.regexp_replace(F.regexp_replace(c, r"([.!?])(\s)", "$1\u0001$2"), "\n", "\n\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


#: White space behind sentence punctuation that ends no sentence: initials, abbreviations, and a word with a period before a small letter or digit.
SENTENCE_END = (
    r"(?<=[.!?])(?<!(?<![\p{L}\p{N}])[A-Z]\.)(?<!(?<![A-Za-z.])(?i:" + "|".join(a.replace(".", r"\.") for a in V.ABBREVIATIONS) + r")\.)(?:(?<![A-Za-z]\.)|(?!\s+[\p{Ll}\p{Nd}]))\s+"
)


def sentences(c: Column) -> Column:
    """Sentences, trimmed: wrapped lines are joined, a line break ends one, abbreviations do not."""
    joined = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\\n+(?=[a-z0-9(])", " "), "\\s*\\n\\s*", "\u0001")
    return F.filter(F.transform(F.split(F.regexp_replace(joined, SENTENCE_END, "\u0001"), "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def citations(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int")))


def strip_citations(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\[\d{1,2}\]", ""))


def with_citation(c: Column, n: Column) -> Column:
    """``[n]`` before the final punctuation."""
    text, mark = F.trim(c), F.concat(F.lit(" ["), n, F.lit("]"))
    body = text.substr(F.lit(1), F.length(text) - 1)
    return F.when(text.rlike(r"[.!?]\z"), F.concat(F.rtrim(body), mark, F.right(text, F.lit(1)))).otherwise(F.concat(text, mark))


def relation_text(c: Column) -> Column:
    return F.array_join(words_of(c, r"[a-z0-9_]+"), " ")


def _any(c: Column, cues: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(cue) for cue in cues])


def question_type(c: Column) -> Column:
    text = F.concat(F.lit(" "), F.lower(F.trim(c)), F.lit(" "))
    out = None
    for name, cues in V.QUESTION_CUES:
        out = F.when(_any(text, cues), name) if out is None else out.when(_any(text, cues), name)
    return out.otherwise("explanation")


def intent(c: Column) -> tuple[Column, Column]:
    """Intent and its confidence by the first rule that fires."""
    text = normalize(c)
    first = F.element_at(F.split(text, " "), 1)
    rules = [
        (text == "", "unsupported_request", 1.0),
        (_any(text, V.MEDIA_CUES), "media_verification", 0.85),
        (_any(text, V.SUMMARY_CUES), "document_summary", 0.9),
        (_any(text, V.SEARCH_CUES), "document_search", 0.8),
        (_any(text, V.PHRASE_CUES), "document_question", 0.9),
        (first.isin(V.FIRST_WORDS), "document_question", 0.85),
        (text.contains("?"), "document_question", 0.75),
    ]
    name = score = None
    for hit, what, sure in rules:
        name = F.when(hit, what) if name is None else name.when(hit, what)
        score = F.when(hit, sure) if score is None else score.when(hit, sure)
    return name.otherwise("document_question"), score.otherwise(0.5)


def is_followup(c: Column) -> Column:
    text = F.lower(F.trim(c))
    cue = reduce(lambda a, b: a | b, [text.startswith(x) for x in V.FOLLOWUP_CUES])
    return (text != "") & (cue | (F.size(F.split(text, r"\s+")) <= V.FOLLOWUP_WORDS))


def resolve_followup(question: Column, previous: Column) -> Column:
    clean = F.trim(question)
    use = previous.isNotNull() & (previous != "") & is_followup(clean) & (F.lower(previous) != F.lower(clean))
    return F.when(use, F.rtrim(F.left(F.concat(previous, F.lit(" "), clean), F.lit(V.QUERY_CHARS)))).otherwise(clean)


def is_spatial(c: Column) -> Column:
    return c.rlike(V.SPATIAL)


def command_of(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, V.COMMANDS, 1))


def requested_position(c: Column) -> Column:
    """Position that an ordinal names (last is -1); null without exactly one ordinal."""
    pattern = r"(?i)\b(" + "|".join(V.ORDINALS) + r")\b"
    found = F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(1))
    value = None
    for word, n in V.ORDINALS.items():
        hit = F.element_at(found, 1) == word
        value = F.when(hit, n) if value is None else value.when(hit, n)
    return F.when(F.size(found) == 1, value)


def support_ratio(claim: Column, evidence: Column) -> Column:
    """Share of the claim's content words in the evidence; bare numbers also match the evidence's numbers."""
    text = strip_citations(claim)
    own = content_tokens(text)
    bare = F.size(own) == 0
    claimed = F.when(bare, words_of(text, CONTENT_TOKEN)).otherwise(own)
    there = F.when(bare, words_of(evidence, CONTENT_TOKEN)).otherwise(content_tokens(evidence))
    known = numbers(evidence)
    core = lambda t: F.regexp_replace(t, r"[.;,:!?]+$", "")
    hit = F.filter(claimed, lambda t: F.array_contains(there, t) | (core(t).rlike(r"^\d+(?:[.,]\d+)*$") & F.array_contains(known, core(t))))
    return F.when((F.size(claimed) == 0) | (F.size(there) == 0), 0.0).otherwise(F.size(hit) / F.size(claimed))


def numbers_supported(claim: Column, evidence: Column) -> Column:
    return F.size(F.array_except(numbers(strip_citations(claim)), numbers(evidence))) == 0


def question_coverage(question: Column, evidence: Column) -> Column:
    terms = without(content_tokens(question), V.QUESTION_WORDS)
    present = F.filter(stems(terms), lambda t: F.array_contains(stems(content_tokens(evidence)), t))
    return F.when(F.size(terms) == 0, 1.0).otherwise(F.size(present) / F.size(terms))


def missing_terms(question: Column, evidence: Column) -> Column:
    terms = without(without(without(content_tokens(question), V.QUESTION_WORDS), V.GENERIC_TERMS), V.STRUCTURAL_TERMS)
    present = stems(content_tokens(evidence))
    return F.filter(F.transform(terms, lambda t: F.regexp_replace(t, r"^fy(\d{4})$", "$1")), lambda t: ~F.array_contains(present, stem(t)))


def answerable(question: Column, evidence: Column) -> Column:
    quantity = question.rlike(V.QUANTITY) & evidence.rlike(NUMBER)
    return (F.size(missing_terms(question, evidence)) <= 1) | quantity


def sanitize_filename(c: Column) -> Column:
    """Last path part; unsafe characters become one underscore, outer dots and spaces go; at most 200 characters."""
    base = F.regexp_extract(c, r"([^/]*)/*$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r'[\x00-\x1f\x7f<>:"\\|?*]', "_"), "_+", "_")
    clean = F.regexp_replace(clean, r"^[. ]+|[. ]+$", "")
    kept = F.concat(F.left(F.regexp_replace(clean, r"\.[^.]*$", ""), F.lit(190)), F.regexp_extract(clean, r"(\.[^.]*)$", 1))
    return F.when(clean == "", "unnamed").when(F.length(clean) > 200, kept).otherwise(clean)


def csv_safe(c: Column) -> Column:
    return F.when(c.rlike(r"^[=+@\-]"), F.concat(F.lit("'"), c)).otherwise(c)
