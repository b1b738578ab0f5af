"""Secret scan: wide candidate patterns, then a random forest that removes false positives.

A candidate is a run of token characters with a digit, or any value right after ``=`` or ``:``. Further passes propose what
lies inside such a value: its parts after ``= : ? & @``, whole values after a cue word, and known prefixes with or without a
digit. Candidates overlap; each is scored with the text around it, whatever other candidates lie there. Findings may
overlap too, and ``redact`` masks what they cover together. The forest sees its length,
its character transitions (class changes, vowel-consonant alternation, distinct characters), how much of it dictionary
parts cover, how path-like it is, and the words beside it. It is trained on labelled findings that ``labelled_findings``
makes from documented formats: real secret shapes against cards, time stamps, digests, identifiers, slugs and placeholders.

Everything runs as DataFrame expressions and the JVM's own forest; texts never leave their row until a candidate is found.

Defined cases: null and empty texts have no candidates; repeated rows give repeated findings (``redact`` treats equal rows
alike); an empty table gives an empty result; null ids stay null; extra columns are kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.llm.registry import query
from docweft.llm.words import running_sums
from docweft.session import durable, table

#: Candidate shapes, words that speak for or against a secret, dictionary parts.
RUN = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}={0,2}"
VALUE = "(?<=[=:]|[=:] |[=:][\"']|[=:] [\"'])[^\\s\"'<>|,;]{6,}"
CANDIDATE = f"{VALUE}|{RUN}"
#: Passes that may overlap the first and one another: parts of a value, cued values, known prefixes. No hit is under LEAST characters.
PART = "(?<=[=:?&@])[^\\s\"'<>|,;=:?&@]{6,}(?:={1,2}(?![^\\s\"'<>|,;&@]))?"
CUED = "(?<=(?i:password|passwd|pass|pwd|secret|token|key|credential|auth)[=:]|(?i:bearer) )[^\\s\"'<>|,;&]{6,}"
KNOWN = "(?<![A-Za-z0-9])(?:AKIA|ASIA|gh[pousr]_|sk-|pk_live|sk_live|xox[abpr]-|eyJ|AIza|glpat-|npm_)[A-Za-z0-9+/_.-]{8,}={0,2}"
PASSES = [CANDIDATE, PART, CUED, KNOWN]
LEAST = 6
FOR = "(?i)(pass(word|wd)?|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer)[a-z_-]*[\"']?\\s*[:=]?\\s*[\"']?$"
AGAINST = "(?i)(sha[0-9-]*|md5|commit|revision|checksum|digest|hash|etag|uuid|guid|version|isbn|card|order|page|figure|phone|tel|id)[\"']?\\s*[:=]?\\s*[\"']?$"
PREFIXES = "^(AKIA|ASIA|gh[pousr]_|sk-|pk_live|sk_live|xox[abpr]-|eyJ|AIza|glpat-|npm_)"
PLACEHOLDER = "(?i)(example|changeme|your|placeholder|dummy|sample|redacted|xxxx|test|todo|\\*\\*\\*|\\$\\{|\\{\\{)"
DICTIONARY = "(the|and|ing|ion|ent|ver|pass|word|user|name|file|path|data|test|page|chapter|section|part|item|note|code|lib|src|doc|log|tmp|home|index|image|table|value|number|version|beta|alpha|release|update)"
FEATURES = ["length", "digits", "uppers", "lowers", "changes", "alternation", "distinct", "covered", "slashes", "joints", "prefix", "placeholder", "hexlike", "repeats", "for", "against", "assigned", "quoted", "nested", "userinfo"]
THRESHOLD = 0.5
TREES = 24
DEPTH = 7
#: Labelled findings that the forest is fitted on.
LABELLED_ROWS = 6000
MASK = "[SECRET]"
CONTEXT = 48


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.greatest(F.length(c), F.lit(1))


def features(frame: DataFrame) -> DataFrame:
    """Adds the forest's columns to ``hit, before, after``."""
    hit, before, after = F.col("hit"), F.col("before"), F.col("after")
    low = F.lower(hit)
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return frame.withColumns(
        {
            "length": F.least(F.length(hit), F.lit(200)).cast("double"),
            "digits": _share(hit, "[0-9]"),
            "uppers": _share(hit, "[A-Z]"),
            "lowers": _share(hit, "[a-z]"),
            "changes": _share(hit, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])"),
            "alternation": _share(low, "[aeiou](?=[bcdfghjklmnpqrstvwxyz])"),
            "distinct": F.size(F.array_distinct(F.split(hit, ""))) / F.greatest(F.least(F.length(hit), F.lit(36)), F.lit(1)),
            "covered": (F.length(hit) - F.length(F.regexp_replace(low, DICTIONARY, ""))) / F.greatest(F.length(hit), F.lit(1)),
            "slashes": _share(hit, "[/.]"),
            "joints": _share(hit, "[_-]"),
            "prefix": yes(hit.rlike(PREFIXES)),
            "placeholder": yes(hit.rlike(PLACEHOLDER)),
            "hexlike": yes(hit.rlike("(?i)^[0-9a-f]+$") & hit.rlike("(?i)[a-f]")),
            "repeats": _share(hit, "(.)(?=\\1)"),
            "for": yes(before.rlike(FOR)),
            "against": yes(before.rlike(AGAINST)),
            "assigned": yes(before.rlike("[:=]\\s*[\"']?$")),
            "quoted": yes(after.rlike("^[\"']")),
            "nested": yes(hit.rlike("[=:?&@].{6}")),
            "userinfo": yes(before.rlike("://[^\\s/:@]*:$") & after.startswith("@")),
        }
    )


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """``hit, before, after, label`` in equal parts of every format, from hashes of row numbers alone."""
    shapes = [
        ("concat('AKIA', upper(substr(b36, 1, 16)))", "w", 1),
        ("concat('AKIA', upper(substr(b36, 1, 16)))", "'aws_access_key_id = '", 1),
        ("substr(hx, 1, 40)", "if(flip, 'token = \"', 'TOKEN = \"')", 1),
        ("if(flip, upper(substr(hx, 1, 40)), substr(hx, 1, 32))", "'api_key: '", 1),
        ("substr(hx, 1, 12 + k)", "if(flip, 'password=', 'PASSWORD=')", 1),
        ("upper(substr(hx, 1, 12 + k))", "'PASSWORD='", 1),
        ("concat('ghp_', substr(b64, 1, 36))", "w", 1),
        ("substr(b64, 1, 40)", "'secret_key: '", 1),
        ("concat('sk-', substr(b64, 1, 40))", "'key='", 1),
        ("concat('eyJ', substr(b64, 1, 40))", "'Authorization: Bearer '", 1),
        ("substr(b64, 1, 24 + k)", "w", 1),
        ("cast(4000000000000000 + pmod(h, 1000000000000000) as string)", "w", 0),
        ("cast(100000000000 + pmod(h, 899999999999) as string)", "if(flip, w, 'order: ')", 0),
        ("cast(100000 + pmod(h, 89999999) as string)", "'id: '", 0),
        ("concat('/usr/lib/', word, '/', word, '3/', word)", "w", 0),
        ("concat(word, '-', word, '-', 2000 + pmod(h, 25))", "if(flip, w, 'page: ')", 0),
        ("concat(word, word, 1 + pmod(h, 99), word)", "w", 0),
        ("substr(hx, 1, 40)", "if(flip, 'commit ', 'sha1: ')", 0),
        ("substr(concat(hx, hx), 1, 64)", "if(flip, 'sha256: ', 'checksum=')", 0),
        ("concat(substr(hx, 1, 8), '-', substr(hx, 9, 4), '-', substr(hx, 13, 4), '-', substr(hx, 17, 4), '-', substr(hx, 21, 12))", "if(flip, 'uuid: ', 'id=')", 0),
        ("element_at(array('changeme123', 'your_password_here', 'xxxxxxxxxxxx', '************', '${PASSWORD}', 'example-token-1'), cast(1 + pmod(h, 6) as int))", "'password='", 0),
        ("concat(2000 + pmod(h, 25), '-05-06T12:30:', 10 + pmod(h, 49))", "if(flip, w, 'date: ')", 0),
        ("repeat(substr(word, 1, 2), 9)", "w", 0),
        ("concat(word, word)", "concat(word, ': ')", 0),
        ("concat('//', word, '.com/', word, '/', word)", "'http:'", 0),
        ("concat('v', pmod(h, 9), '_', pmod(h, 7), '_', word, '-beta', pmod(h, 5))", "'version='", 0),
        # A URL or a connection string and the secret inside it.
        ("substr(hx, 1, 16 + k)", "concat('https://api.', word, '.com/v1?', if(flip, 'api_key=', 'id=7&token='))", 1),
        ("concat('//api.', word, '.com/v1?', if(flip, 'api_key=', 'id=7&token='), substr(hx, 1, 16 + k))", "'https:'", 0),
        ("concat(initcap(word), pmod(h, 97), substr(b64, 1, 4))", "concat(if(flip, 'postgres://admin:', 'mysql://'), if(flip, '', concat(word, ':')))", 1),
        ("concat('//', if(flip, 'admin', word), ':', initcap(word), pmod(h, 97), substr(b64, 1, 4), '@db.host/x')", "if(flip, 'postgres:', 'mysql:')", 0),
        ("concat(word, pmod(h, 97), substr(hx, 1, 3))", "'config: password='", 1),
        ("concat('password=', word, pmod(h, 97), substr(hx, 1, 3))", "'config: '", 0),
        ("concat(substr(b64, 1, 5), if(flip, '@', ':'), substr(hx, 1, 8))", "'password='", 1),
        ("concat(word, '.com/', word)", "concat('https://', word, ':', word, '@')", 0),
        ("concat('//', word)", "if(flip, 'postgres:', 'https:')", 0),
        ("translate(concat('ghp_', substr(b64, 1, 36)), '0123456789', 'abcdefghij')", "w", 1),
        ("translate(concat('eyJ', substr(b64, 1, 36)), '0123456789', 'abcdefghij')", "'Authorization: Bearer '", 1),
        ("if(flip, 'Bearer', 'Basic')", "'Authorization: '", 0),
    ]
    base = spark.range(rows, numPartitions=1).selectExpr("id", "xxhash64(id, 11) AS h", "sha2(cast(id AS string), 256) AS hx", "pmod(id, 3) = 0 AS flip", "cast(pmod(xxhash64(id, 3), 24) AS int) AS k")
    parts = "array('re','ver','tion','ung','que','os','ment','ing','th','la','der','schaft','ar','con','lich','ado','eau','ent','ble','her')"
    pick = lambda n: f"element_at({parts}, cast(1 + pmod(xxhash64(id, {n}), 20) AS int))"
    base = base.selectExpr("*", f"concat({pick(21)}, {pick(22)}, {pick(23)}) AS word", f"concat({pick(24)}, {pick(25)}, ' ') AS w", "regexp_replace(base64(unhex(concat(hx, hx))), '[=/+]', 'q') AS b64", "translate(lower(base64(unhex(hx))), '+/=', '789') AS b36")
    hit = "CASE pmod(id, %d) %s END" % (len(shapes), " ".join(f"WHEN {i} THEN {s[0]}" for i, s in enumerate(shapes)))
    before = "CASE pmod(id, %d) %s END" % (len(shapes), " ".join(f"WHEN {i} THEN {s[1]}" for i, s in enumerate(shapes)))
    label = "CASE pmod(id, %d) %s END" % (len(shapes), " ".join(f"WHEN {i} THEN {s[2]}.0D" for i, s in enumerate(shapes)))
    inside = next(i for i, x in enumerate(shapes) if "mysql://" in x[1])
    after = f"CASE WHEN pmod(id, {len(shapes)}) = {inside} THEN '@db.host/x' WHEN pmod(id, 2) = 0 THEN '\"' ELSE ' ' END"
    return base.selectExpr(f"{hit} AS hit", f"{before} AS before", f"{after} AS after", f"{label} AS label")


def train(spark: SparkSession, labelled: DataFrame | None = None) -> RandomForestClassificationModel:
    """Forest over ``FEATURES`` from ``hit, before, after, label``."""
    rows = features(labelled if labelled is not None else labelled_findings(spark))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_v").transform(rows).select("_v", "label")
    forest = RandomForestClassifier(featuresCol="_v", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=17, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred")
    return forest.fit(vectors)


def _placed(text: Column, pattern: str) -> Column:
    """``start, hit, before, after`` of every match of one pass, in order; the text around a match holds its neighbours."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Lambdas over one-element arrays bind the matches and the gaps between them once. Hits have LEAST characters or more,
    # so that so many neighbours always fill the context.
    most = -(-CONTEXT // LEAST)

    def each(both):
        h, g = both["h"], both["g"]
        ends = F.zip_with(running_sums(F.transform(h, lambda x, i: F.length(F.get(g, i)) + F.length(x))), h, lambda a, x: a - F.length(x))
        joined = F.zip_with(g, h, lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
        return F.transform(
            F.array(F.struct(ends.alias("s"), joined.alias("z"))),
            lambda w: F.transform(
                w["s"],
                lambda s, i: F.struct(
                    s.cast("long").alias("start"),
                    F.get(h, i).alias("hit"),
                    F.right(F.concat(F.array_join(F.slice(w["z"], F.greatest(i - most, F.lit(0)) + 1, F.least(i, F.lit(most))), ""), F.get(g, i)), F.lit(CONTEXT)).alias("before"),
                    F.left(F.array_join(F.slice(w["z"], i + 2, F.lit(most + 1)), ""), F.lit(CONTEXT)).alias("after"),
                ),
            ),
        )[0]

    found = F.transform(F.array(F.struct(hits.alias("h"), F.split(text, pattern, -1).alias("g"))), each)[0]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:bigint,hit:string,before:string,after:string>>"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per candidate: the columns of ``docs`` but the text, ``start`` (from 0), ``hit, before, after``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    every = docs.select(*rest, F.sort_array(F.concat(*[_placed(F.col(text), p) for p in PASSES])).alias("_c"))
    # Passes that meet in one candidate place it equally: it is the neighbour of its like.
    once = F.filter("_c", lambda c, i: (i == 0) | (F.get(F.col("_c"), i - 1)["start"] != c["start"]) | (F.get(F.col("_c"), i - 1)["hit"] != c["hit"]))
    return every.withColumn("_c", F.explode(once)).select(*rest, "_c.*")


def scan(docs: DataFrame, text: str = "text", model: RandomForestClassificationModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Findings: the columns of ``docs`` but the text, ``start, hit, before, after, score``."""
    rest = [c for c in docs.columns if c != text]
    model = model or train(docs.sparkSession)
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(text).alias("_text"))
    rows = features(candidates(renamed, "_text"))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="_v").transform(rows)).withColumn("score", vector_to_array("_p")[1])
    return scored.where(F.col("score") >= threshold).select(*[F.col("_row").getField(c).alias(c) for c in rest], "start", "hit", "before", "after", "score")


def redact(docs: DataFrame, text: str = "text", model: RandomForestClassificationModel | None = None) -> DataFrame:
    """The rows of ``docs`` with every finding replaced by ``MASK`` and ``n_chars``, where there is one, counted anew."""
    own = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    held = docs.select(row, F.col("doc_id").alias("_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_whole"))
    found = scan(held.select("_id", "_key", "_whole"), "_whole", model).select("_id", "_key", "start", (F.col("start") + F.length("hit")).alias("end")).distinct()
    # Findings that overlap give one span. A window holds the findings of one text, equal texts reduced to one.
    order = Window.partitionBy("_id", "_key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") < F.col("_reach"), 0).otherwise(1)).over(order)
    merged = found.withColumn("_reach", reach).withColumn("_island", island).groupBy("_id", "_key", "_island").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    spans = durable(merged.groupBy(F.col("_id").alias("_of"), F.col("_key").alias("_text_key")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_spans")))
    joined = held.join(spans, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_text_key")), "left")
    ended = lambda i: F.coalesce(F.get(F.col("_spans"), i)["hi"], F.lit(0)).cast("int")
    parts = F.transform("_spans", lambda x, i: F.col("_whole").substr(ended(i - 1) + 1, x["lo"].cast("int") - ended(i - 1)))
    tail = F.col("_whole").substr(ended(F.size("_spans") - 1) + 1, F.length("_whole"))
    cut = F.concat(F.array_join(parts, MASK), F.lit(MASK), tail)
    out = joined.withColumn("_new", F.when(F.col("_spans").isNull(), F.col("_whole")).otherwise(cut))
    new = {text: F.col("_new")} | ({"n_chars": F.length("_new").cast("long")} if "n_chars" in own else {})
    return out.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in own])


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in the documents by place, digest and score (native DataFrame functions only)."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "start", F.length("hit").cast("long").alias("length"), F.sha2("hit", 256).alias("secret_sha256"), F.round("score", 6).alias("score"))
