"""Scalar functions and predicates, each over a whole relation with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions import vocabulary as V
from docweft.plans.base import frame, with_ctes
from docweft.plans.registry import query


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_tokens(column: str, pattern: str = "[a-z0-9]+") -> str:
    return f"regexp_extract_all(lower({column}), '{pattern}')"


def sql_without(tokens: str, stop) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains({sql_list(stop)}, t))"


CONTENT = lambda c: sql_without(sql_tokens(c, "[a-z0-9][a-z0-9.%/-]*"), V.CONTENT_STOPWORDS)
NUMBERS = lambda c: f"regexp_extract_all({c}, '\\d+(?:[.,]\\d+)*')"
STRIP = lambda c: f"trim(regexp_replace({c}, '\\s*\\[\\d{{1,2}}\\]', '', 'g'))"


def sql_stem(t: str) -> str:
    return "CASE " + " ".join(f"WHEN suffix({t}, '{s}') AND length({t}) >= {len(s) + 4} THEN left({t}, length({t}) - {len(s)})" for s in V.SUFFIXES) + f" ELSE {t} END"


def sql_any(c: str, cues) -> str:
    return "(" + " OR ".join(f"contains({c}, '{x}')" for x in cues) + ")"


def distinct_in_order(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t, i: list_position({tokens}, t) = i)"


def scalar(name: str, base: str, key: str, column, sql: str):
    """Register ``key, value`` over ``base``."""

    def run(spark, sf):
        return frame(base, spark, sf).select(key, column().alias("value"))

    query(name, with_ctes((base,), f"SELECT {key}, {sql} AS value FROM {base}"))(run)


c = F.col
join = lambda a, sep=" ": F.array_join(a.cast("array<string>"), sep)
sqljoin = lambda a, sep=" ": f"array_to_string({a}, '{sep}')"

LINE, QUESTION = ("lines", "chunk_id"), ("questions", "question_id")
scalar("normalize_text", *LINE, lambda: T.normalize(c("content")), "trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))")
scalar("tokenise_alnum", *LINE, lambda: join(T.alnum_tokens(c("content"))), sqljoin(sql_tokens("content")))
scalar("content_tokens", *LINE, lambda: join(T.content_tokens(c("content"))), sqljoin(CONTENT("content")))
scalar("numbers_of", *LINE, lambda: join(F.array_sort(T.numbers(c("content")))), sqljoin(f"list_sort(list_distinct({NUMBERS('content')}))"))
scalar("light_stem", *LINE, lambda: join(T.stems(T.content_tokens(c("content")))), sqljoin(f"list_transform({CONTENT('content')}, lambda t: {sql_stem('t')})"))
TERMS = f"list_filter({sql_tokens('question')}, lambda t: length(t) >= 3 AND NOT list_contains({sql_list(V.TERM_STOPWORDS)}, t))"
scalar("terms_from_question", *QUESTION, lambda: join(T.question_terms(c("question"))), sqljoin(f"({distinct_in_order(TERMS)})[1:8]"))
QTERMS = distinct_in_order(sql_without(sql_tokens("question"), V.QUERY_STOPWORDS))
scalar("query_terms", *QUESTION, lambda: join(T.query_terms(c("question"))), sqljoin(QTERMS))
scalar(
    "overlap_score", *QUESTION, lambda: F.round(T.overlap(T.query_terms(c("question")), c("evidence")), 6),
    f"CASE WHEN len({QTERMS}) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect({QTERMS}, {sql_tokens('evidence')}))::DOUBLE / len({QTERMS}), 6) END",
)
QT, ET = f"list_distinct({sql_tokens('question')})", f"list_distinct({sql_tokens('evidence')})"
scalar(
    "jaccard", *QUESTION, lambda: F.round(T.jaccard(F.array_distinct(T.alnum_tokens(c("question"))), F.array_distinct(T.alnum_tokens(c("evidence")))), 6),
    f"round(len(list_intersect({QT}, {ET}))::DOUBLE / len(list_distinct(list_concat({QT}, {ET}))), 6)",
)
GRAMS = "list_concat(" + ", ".join(
    f"list_sort(list_distinct(" + (f"list_filter(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')), lambda t: length(t) >= 3 AND NOT list_contains({sql_list(V.ENTITY_STOPWORDS)}, t))" if n == 1 else f"list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))") + "))"
    for n in range(6, 0, -1)
) + ")"
query("kg_query_phrases", with_ctes(("questions",), f"SELECT question_id, array_to_string(({GRAMS})[1:96], '|') AS value FROM (SELECT question_id, {sql_tokens('question')} AS w FROM questions)"))(
    lambda spark, sf: frame("questions", spark, sf).select("question_id", F.array_join(T.phrases(c("question")), "|").alias("value"))
)
scalar("token_estimate", *LINE, lambda: T.token_estimate(c("content")), "CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, ceil(length(content) / 4.0))::BIGINT END")
scalar("byte_token_estimate", *LINE, lambda: T.byte_token_estimate(c("content")), "ceil(strlen(content) / 2.0)::BIGINT")
scalar("usable_chars", *LINE, lambda: T.usable_chars(c("content")), "length(regexp_replace(content, '[^\\p{L}\\p{N}]', '', 'g'))::BIGINT")
scalar("content_hash", *LINE, lambda: F.sha2("content", 256), "sha256(content)")
PATH = "list_filter(list_transform(string_split(heading, '>'), lambda h: trim(h)), lambda h: h <> '')"
scalar("norm_path", "paths", "doc_id", lambda: join(T.norm_path(c("heading")), "|"), sqljoin(PATH, "|"))
scalar("parent_heading", "paths", "doc_id", lambda: T.parent_heading(T.norm_path(c("heading"))), f"CASE WHEN len({PATH}) >= 2 THEN ({PATH})[-2] END")
scalar("heading_leaf", "paths", "doc_id", lambda: T.heading_leaf(T.norm_path(c("heading"))), f"CASE WHEN len({PATH}) >= 1 THEN lower(({PATH})[-1]) END")
scalar("heading_prefix", "paths", "doc_id", lambda: T.heading_prefix(T.norm_path(c("heading")), c("content"), c("is_heading")), f"CASE WHEN is_heading OR len({PATH}) = 0 THEN content ELSE array_to_string({PATH}, ' > ') || chr(10) || chr(10) || content END")
scalar("coerce_json_path", "paths", "doc_id", lambda: join(F.from_json(F.to_json(T.norm_path(c("heading"))), "array<string>"), "|"), sqljoin(PATH, "|"))
SEGMENTS = "list_filter(string_split(regexp_replace(content, '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: s <> '')"
scalar("segment_spans", *LINE, lambda: join(T.segments(c("content")), "|"), sqljoin(SEGMENTS, "|"))
scalar("split_sentences", *LINE, lambda: F.size(F.filter(T.segments(c("content")), lambda s: F.trim(s) != "")).cast("long"), f"len(list_filter({SEGMENTS}, lambda s: trim(s) <> ''))")
CITED = "evidence || ' [' || question_id || '] and [7] [7][12].'"
cited = lambda: F.concat(c("evidence"), F.lit(" ["), c("question_id").cast("string"), F.lit("] and [7] [7][12]."))
IDS = f"list_transform(regexp_extract_all({CITED}, '\\[(\\d{{1,2}})\\]', 1), lambda x: x::INT)"
scalar("extract_citations", *QUESTION, lambda: join(T.citations(cited())), sqljoin(distinct_in_order(IDS)))
scalar("strip_citations", *QUESTION, lambda: T.strip_citations(cited()), STRIP(CITED))
scalar("with_citation", *LINE, lambda: T.with_citation(c("content"), c("chunk_index").cast("string")), "CASE WHEN regexp_matches(trim(content), '[.!?]$') THEN rtrim(left(trim(content), length(trim(content)) - 1)) || ' [' || chunk_index || ']' || right(trim(content), 1) ELSE trim(content) || ' [' || chunk_index || ']' END")
scalar("normalise_relation_text", *LINE, lambda: T.relation_text(c("content")), sqljoin(sql_tokens("content", "[a-z0-9_]+")))
TYPE = "CASE " + " ".join(f"WHEN {sql_any(chr(39) + ' ' + chr(39) + ' || lower(trim(question)) || ' + chr(39) + ' ' + chr(39), cues)} THEN '{n}'" for n, cues in V.QUESTION_CUES) + " ELSE 'explanation' END"
scalar("classify_question", *QUESTION, lambda: T.question_type(c("question")), TYPE)
NORM = "trim(regexp_replace(lower(question), '\\s+', ' ', 'g'))"
RULES = [(f"{NORM} = ''", "unsupported_request", 1.0), (sql_any(NORM, V.MEDIA_CUES), "media_verification", 0.85), (sql_any(NORM, V.SUMMARY_CUES), "document_summary", 0.9), (sql_any(NORM, V.SEARCH_CUES), "document_search", 0.8), (sql_any(NORM, V.PHRASE_CUES), "document_question", 0.9), (f"list_contains({sql_list(V.FIRST_WORDS)}, string_split({NORM}, ' ')[1])", "document_question", 0.85), (f"contains({NORM}, '?')", "document_question", 0.75)]
query("classify_intent", with_ctes(("questions",), "SELECT question_id, CASE " + " ".join(f"WHEN {r} THEN '{n}'" for r, n, _ in RULES) + " ELSE 'document_question' END AS intent, (CASE " + " ".join(f"WHEN {r} THEN {s}" for r, _, s in RULES) + " ELSE 0.5 END)::DOUBLE AS confidence FROM questions"))(
    lambda spark, sf: frame("questions", spark, sf).select("question_id", T.intent(c("question"))[0].alias("intent"), T.intent(c("question"))[1].alias("confidence"))
)
FOLLOW = f"(trim(question) <> '' AND ((" + " OR ".join(f"starts_with(lower(trim(question)), '{x}')" for x in V.FOLLOWUP_CUES) + ") OR len(string_split_regex(lower(trim(question)), '\\s+')) <= 6))"
scalar("is_followup", *QUESTION, lambda: T.is_followup(c("question")), FOLLOW)
scalar("resolve_followup", *QUESTION, lambda: T.resolve_followup(c("question"), c("evidence")), f"CASE WHEN {FOLLOW} AND lower(evidence) <> lower(trim(question)) THEN rtrim(left(evidence || ' ' || trim(question), 600)) ELSE trim(question) END")
scalar("is_spatial_query", *QUESTION, lambda: T.is_spatial(c("question")), f"regexp_matches(question, '{V.SPATIAL}')")
scalar("student_question_plan", *QUESTION, lambda: T.command_of(c("question")), f"lower(regexp_extract(question, '{V.COMMANDS}', 1))")
ORD = f"regexp_extract_all(lower(question), '\\b({'|'.join(V.ORDINALS)})\\b', 1)"
scalar("requested_position", *QUESTION, lambda: T.requested_position(c("question")), f"CASE WHEN len({ORD}) = 1 THEN CASE ({ORD})[1] " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in V.ORDINALS.items()) + " END END")
CLAIM = "question || ' [3]'"
claim = lambda: F.concat(c("question"), F.lit(" [3]"))
CT = CONTENT(STRIP(CLAIM))
CORE = "regexp_replace(t, '[.;,:!?]+$', '')"
HIT = f"list_filter({CT}, lambda t: list_contains({CONTENT('evidence')}, t) OR (regexp_full_match({CORE}, '\\d+(?:[.,]\\d+)*') AND list_contains({NUMBERS('evidence')}, {CORE})))"
scalar("support_ratio", *QUESTION, lambda: F.round(T.support_ratio(claim(), c("evidence")), 6), f"CASE WHEN len({CT}) = 0 THEN 0.0::DOUBLE ELSE round(len({HIT})::DOUBLE / len({CT}), 6) END")
scalar("numbers_supported", *LINE, lambda: T.numbers_supported(c("content"), F.concat(c("section"), F.lit(" 10 2024"))), f"len(list_filter({NUMBERS(STRIP('content'))}, lambda n: NOT list_contains({NUMBERS(chr(39) + '10 2024' + chr(39))}, n))) = 0")
QC = sql_without(CONTENT("question"), V.QUESTION_WORDS)
STEMS = f"list_transform({CONTENT('evidence')}, lambda t: {sql_stem('t')})"
scalar("question_coverage", *QUESTION, lambda: F.round(T.question_coverage(c("question"), c("evidence")), 6), f"CASE WHEN len({QC}) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(list_transform({QC}, lambda t: {sql_stem('t')}), lambda s: list_contains({STEMS}, s)))::DOUBLE / len({QC}), 6) END")
DIST = sql_without(QC, V.GENERIC_TERMS + V.STRUCTURAL_TERMS)
MISSING = f"list_filter(list_transform({DIST}, lambda t: regexp_replace(t, '^fy(\\d{{4}})$', '\\1')), lambda t: NOT list_contains({STEMS}, {sql_stem('t')}))"
query("answerability", with_ctes(("questions",), f"SELECT question_id, len({MISSING})::BIGINT AS missing, (len({MISSING}) <= 1 OR (regexp_matches(question, '{V.QUANTITY}') AND regexp_matches(evidence, '\\d'))) AS allowed FROM questions"))(
    lambda spark, sf: frame("questions", spark, sf).select("question_id", F.size(T.missing_terms(c("question"), c("evidence"))).cast("long").alias("missing"), T.answerable(c("question"), c("evidence")).alias("allowed"))
)
NAMES = "'dir/' || heading || '<' || doc_id || '>..txt. '"
names = lambda: F.concat(F.lit("dir/"), c("heading"), F.lit("<"), c("doc_id").cast("string"), F.lit(">..txt. "))
CLEAN = f"regexp_replace(regexp_replace(regexp_replace(regexp_extract({NAMES}, '([^/]*)/*$', 1), '[\\x00-\\x1f\\x7f<>:\"\\\\|?*]', '_', 'g'), '_+', '_', 'g'), '^[. ]+|[. ]+$', '', 'g')"
scalar("sanitize_filename", "paths", "doc_id", lambda: T.sanitize_filename(names()), f"CASE WHEN {CLEAN} = '' THEN 'unnamed' ELSE {CLEAN} END")
scalar("csv_safe_sink", *LINE, lambda: T.csv_safe(F.concat(F.when(c("chunk_index") % 3 == 0, "=").otherwise(""), c("content"))), "CASE WHEN regexp_matches((CASE WHEN chunk_index % 3 = 0 THEN '=' ELSE '' END) || content, '^[=+@\\-]') THEN '''' || (CASE WHEN chunk_index % 3 = 0 THEN '=' ELSE '' END) || content ELSE content END")
scalar("serialize_row", "paths", "doc_id", lambda: F.concat_ws(" | ", c("doc_id").cast("string"), c("heading"), c("content")), "concat_ws(' | ', doc_id::VARCHAR, heading, content)")
SIZE = "(6 + score % 12)"
scalar("pdf_heading_level", "results", "rid", lambda: F.when(6 + c("score") % 12 >= 14, 1).when(6 + c("score") % 12 >= 12, 2).when((6 + c("score") % 12 >= 10.5) & c("correct"), 3), f"CASE WHEN {SIZE} >= 14 THEN 1 WHEN {SIZE} >= 12 THEN 2 WHEN {SIZE} >= 10.5 AND correct THEN 3 END")
scalar("structural_score", "results", "rid", lambda: F.when(c("score") % 4 <= 0, 1.0).otherwise(F.round(c("confidence") / (1 + c("score") % 4), 6)), "CASE WHEN score % 4 <= 0 THEN 1.0::DOUBLE ELSE round(confidence / (1 + score % 4), 6) END")
scalar("source_status", "results", "rid", lambda: F.when(c("confidence") * 10 >= 0.5, "VERIFIED").when(c("confidence") * 10 >= 0.3, "MARGINAL").otherwise("UNRESOLVED"), "CASE WHEN confidence * 10 >= 0.5 THEN 'VERIFIED' WHEN confidence * 10 >= 0.3 THEN 'MARGINAL' ELSE 'UNRESOLVED' END")
scalar("outcome_from_rag", "results", "rid", lambda: F.when(c("category") == "R", "UNAVAILABLE").when(c("category") == "A", "INSUFFICIENT_EVIDENCE").when((c("confidence") * 10 >= 0.3) & (c("score") / 50 >= 0.5), "SUCCESS").otherwise("PARTIAL"), "CASE WHEN category = 'R' THEN 'UNAVAILABLE' WHEN category = 'A' THEN 'INSUFFICIENT_EVIDENCE' WHEN confidence * 10 >= 0.3 AND score / 50 >= 0.5 THEN 'SUCCESS' ELSE 'PARTIAL' END")
scalar("rag_insufficient", "results", "rid", lambda: (c("score") / 50 < 0.15) | ~c("correct") & (c("confidence") * 10 < 0.3) & (c("score") / 50 < 0.5), "score / 50 < 0.15 OR (NOT correct AND confidence * 10 < 0.3 AND score / 50 < 0.5)")
scalar("evidence_gate", "results", "rid", lambda: F.when(c("category") == "R", F.when(c("arm") == "O", "UNAVAILABLE").otherwise("FAILED")).when(c("score") < 5, "INSUFFICIENT_EVIDENCE").when(c("confidence") <= 0, "INSUFFICIENT_EVIDENCE").when(c("answerable") & (c("confidence") * 10 >= 0.3) & (c("score") / 50 >= 0.5), "SUCCESS").otherwise("PARTIAL"), "CASE WHEN category = 'R' THEN CASE WHEN arm = 'O' THEN 'UNAVAILABLE' ELSE 'FAILED' END WHEN score < 5 OR confidence <= 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN answerable AND confidence * 10 >= 0.3 AND score / 50 >= 0.5 THEN 'SUCCESS' ELSE 'PARTIAL' END")
FAIL = [("NOT answerable AND NOT correct AND category = 'A'", "CORRECT_ABSTAIN"), ("NOT answerable AND correct", "SPURIOUS"), ("NOT answerable", "UNKNOWN"), ("score < 10", "RET_MISS"), ("confidence > 0 AND score >= 50 * 0.95 AND NOT correct", "CTX_TRUNC"), ("confidence > 0 AND arm = 'F' AND NOT correct", "EVID_OMIT"), ("correct AND category = 'A'", "QA_CONF"), ("correct", "CORRECT"), ("category = 'A' AND confidence = 0", "QA_EXTRACT"), ("category = 'A'", "QA_CONF"), ("confidence = 0", "RET_MISS")]
for _name, _list, _rest in (("classify_failure", FAIL, "QA_EXTRACT"), ("classify_outcome", [("NOT answerable AND correct", "unsupported_answer"), ("NOT answerable", "correct_abstention"), ("score < 5", "abstained"), ("correct", "correct")], "incorrect")):
    _case = "CASE " + " ".join(f"WHEN {w} THEN '{v}'" for w, v in _list) + f" ELSE '{_rest}' END"
    scalar(_name, "results", "rid", lambda _case=_case: F.expr(_case), _case)
scalar("find_span", "answers", "example_id", lambda: F.when(F.locate("t", c("predicted")) > 0, F.locate("t", c("predicted")) - 1).otherwise(F.locate("t", F.lower("predicted")) - 1).cast("long"), "CASE WHEN strpos(predicted, 't') > 0 THEN strpos(predicted, 't') - 1 ELSE strpos(lower(predicted), 't') - 1 END")
clamp = lambda x: F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 6)
query("normalized_bbox", with_ctes(("regions",), "SELECT region_id, " + ", ".join(f"round(least(greatest({k}, 0.0), 1.0), 6)::DOUBLE AS {k}" for k in ("x0", "y0", "x1", "y1")) + " FROM regions"))(
    lambda spark, sf: frame("regions", spark, sf).select("region_id", *[clamp(c(k)).alias(k) for k in ("x0", "y0", "x1", "y1")])
)
TYPES = {"definition": "Define, then qualify.", "comparison": "Contrast point by point.", "derivation": "Show each step.", "process": "Give ordered steps.", "enumeration": "List the items.", "explanation": "Explain with evidence."}
scalar("answer_plan", *QUESTION, lambda: F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[T.question_type(c("question"))], "CASE " + TYPE + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " END")
GAPS = "'EVIDENCE_GAPS: ' || (question_id % 5) || ', ' || (question_id % 7)"
scalar("evidence_gaps", *QUESTION, lambda: join(F.array_distinct(F.regexp_extract_all(F.concat(F.lit("EVIDENCE_GAPS: "), (c("question_id") % 5).cast("string"), F.lit(", "), (c("question_id") % 7).cast("string")), F.lit(r"(\d+)"), F.lit(1)))), sqljoin(distinct_in_order(f"regexp_extract_all({GAPS}, '(\\d+)', 1)")))
scalar("chunk_version_resolve", *LINE, lambda: F.when(c("section") == "en", "structure_v2").when(c("section") == "fr", "structure_v1").otherwise("legacy"), "CASE section WHEN 'en' THEN 'structure_v2' WHEN 'fr' THEN 'structure_v1' ELSE 'legacy' END")
scalar("table_gate", *LINE, lambda: F.when(F.size(F.split(c("content"), r"\|")) >= 3, F.size(F.filter(T.query_terms(c("section")), lambda t: F.lower(F.element_at(F.split(c("content"), r"\|"), 1)).contains(t))) >= 1).otherwise(False), f"CASE WHEN len(string_split(content, '|')) >= 3 THEN len(list_filter({distinct_in_order(sql_without(sql_tokens('section'), V.QUERY_STOPWORDS))}, lambda t: contains(lower(string_split(content, '|')[1]), t))) >= 1 ELSE false END")
CELLS = "list_transform(string_split(content, '|'), lambda x: trim(x))"
query("parse_table_lines", with_ctes(("lines",), f"SELECT chunk_id, len({CELLS})::BIGINT AS width, array_to_string({CELLS}, '~') AS cells FROM lines WHERE len(string_split(content, '|')) >= 3"))(
    lambda spark, sf: frame("lines", spark, sf).withColumn("a", F.transform(F.split("content", r"\|"), lambda x: F.trim(x))).where(F.size("a") >= 3).select("chunk_id", F.size("a").cast("long").alias("width"), F.array_join("a", "~").alias("cells"))
)
query("keypoint_coverage", with_ctes(("questions",), f"SELECT question_id, round(list_avg(list_transform({QTERMS}, lambda t: contains(lower(evidence), t)::INT))::DOUBLE, 6) AS value FROM questions"))(
    lambda spark, sf: frame("questions", spark, sf).withColumn("t", T.query_terms(c("question"))).select("question_id", F.round(F.when(F.size("t") > 0, F.size(F.filter("t", lambda t: F.lower("evidence").contains(t))) / F.size("t")), 6).alias("value"))
)
scalar("factual_grounded", "answers", "example_id", lambda: F.lower("predicted").contains(F.lower("gold")), "contains(lower(predicted), lower(gold))")
scalar("compose_answer", "answers", "example_id", lambda: F.concat(F.trim("predicted"), F.when(F.trim("predicted").rlike("[.!?]\\z"), "").otherwise("."), F.when(c("example_id") % 3 == 2, "\n\n- ").otherwise(" "), c("gold")), "trim(predicted) || CASE WHEN regexp_matches(trim(predicted), '[.!?]$') THEN '' ELSE '.' END || CASE WHEN example_id % 3 = 2 THEN chr(10) || chr(10) || '- ' ELSE ' ' END || gold")
scalar("not_null_filter", "chunks", "chunk_id", lambda: c("topic").isNotNull(), "topic IS NOT NULL")
scalar("exact_match", "answers", "example_id", lambda: T.normalize(c("predicted")) == T.normalize(c("gold")), "trim(regexp_replace(lower(predicted), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(gold), '\\s+', ' ', 'g'))")
P, G = f"list_distinct({sql_tokens('predicted')})", f"list_distinct({sql_tokens('gold')})"
token_f1 = lambda a, b: F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(F.size(F.array_intersect(a, b)) == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))
scalar("token_f1_set", "answers", "example_id", lambda: F.round(token_f1(F.array_distinct(T.alnum_tokens(c("predicted"))), F.array_distinct(T.alnum_tokens(c("gold")))), 6), f"CASE WHEN len({P}) = 0 AND len({G}) = 0 THEN 1.0::DOUBLE ELSE round(2.0 * len(list_intersect({P}, {G})) / (len({P}) + len({G})), 6) END")
for _group in (("exact_match_harness", lambda: (F.regexp_replace(T.normalize(c("predicted")), r"\.+$", "") == F.regexp_replace(T.normalize(c("gold")), r"\.+$", "")) & (T.normalize(c("gold")) != ""), "regexp_replace(trim(regexp_replace(lower(predicted), '\\s+', ' ', 'g')), '\\.+$', '') = regexp_replace(trim(regexp_replace(lower(gold), '\\s+', ' ', 'g')), '\\.+$', '') AND trim(gold) <> ''"),):
    scalar(_group[0], "answers", "example_id", _group[1], _group[2])
