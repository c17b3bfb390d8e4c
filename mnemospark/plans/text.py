"""Queries of the text functions and of lexical and vector ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import text as X
from mnemospark.operators import ranking as R
from mnemospark.operators.views import first_arrivals
from mnemospark.plans import sqltext as S
from mnemospark.runtime import checkpointed, stored, table

#: A literal multilingual request, for the queries with one cue.
CUE = "compare the shared archive with Dienstag sessions 快照 and historial"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.tokenize("text").alias("terms"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every document whose id is divisible by 100 asks for its own terms."""
    return _docs(spark, d).where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")


def asked_and_documents(spark: SparkSession, d: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The query set and all documents with their terms, extracted once: matches and statistics read them several times.
    columns: others of the documents to keep."""
    docs = stored(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", *columns, X.tokenize("text").alias("terms")))
    return docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "terms"), docs


def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


def stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "memory_records").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(X.WORD_RUN), F.lit(0))).alias("word")).distinct()
    return words.select("word", X.stem(F.col("word")).alias("stem"))


def cjk_bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    grams = table(spark, d, "history_messages").dropDuplicates(["id"]).select(F.explode(X.cjk_bigrams("text")).alias("bigram"))
    return grams.groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


def split_cue_parts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(X.split_cue("text")).alias("pos", "part"))
    return lines.select("doc_id", F.col("pos").alias("part_no"), "part")


def corrections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_records").where(X.is_correction("text")).select("id").distinct()


def topic_terms(spark: SparkSession, d: str) -> DataFrame:
    r = first_arrivals(table(spark, d, "memory_records"))
    t = X.topic_terms(X.tokenize("text"))
    return r.where("text IS NOT NULL").select("id", F.size(t).alias("n_topics"), F.array_join(F.array_sort(t), " ").alias("topics"))


def fnv_hashes(spark: SparkSession, d: str) -> DataFrame:
    terms = _docs(spark, d).select(F.explode("terms").alias("term")).distinct()
    return terms.select("term", X.fnv1a("term").alias("hash"))


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Hashed-term vectors of 512 dimensions, sparse: bucket and L2-normalised value."""
    return R.hashed_vectors(_docs(spark, d)).select("doc_id", "bucket", F.round("value", 6).alias("value"))


def tool_digests(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "history_messages").where(F.col("text").startswith("{")).select("id", F.col("text").alias("args")).distinct()
    return h.select("id", X.tool_digest("args", 12).alias("digest")).where("digest IS NOT NULL")


def clipped_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to 60 characters; a cut text is a summary, a whole one verbatim."""
    r = first_arrivals(table(spark, d, "memory_records")).where("text IS NOT NULL")
    return r.select("id", X.clip("text", 60).alias("text"), F.when(F.length("text") > 60, "summary").otherwise("verbatim").alias("fidelity"), X.short("text", 40).alias("title"))


def scope_parts(spark: SparkSession, d: str) -> DataFrame:
    r = first_arrivals(table(spark, d, "memory_records"))
    kind = X.scope_kind("scope")
    value = F.when(kind != "user", F.expr("substring(scope, locate(':', scope) + 1)"))
    return r.groupBy(kind.alias("kind"), value.alias("value"), X.scope_key(kind, value).alias("scope")).agg(F.count(F.lit(1)).alias("records"), F.min(X.iso_day("created_at")).alias("first_day"), F.max(X.iso_day("created_at")).alias("last_day"))


def source_paths(spark: SparkSession, d: str) -> DataFrame:
    """Distinct file paths named in each record's text, longest first."""
    r = first_arrivals(table(spark, d, "memory_records")).where("text IS NOT NULL")
    paths = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*\.(?:yml|toml|json|py|ts|md)"), F.lit(0)))
    ordered = F.transform(F.array_sort(F.transform(paths, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda x: x["p"])
    return r.where(F.size(paths) > 0).select("id", F.array_join(ordered, " ").alias("paths"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.range(1).select(F.lit(1).alias("query_id"), X.tokenize(F.lit(CUE)).alias("terms"))
    best = R.top(R.bm25(asked, checkpointed(_docs(spark, d)), best=10), ["query_id"], 10, "doc_id")
    return best.select("doc_id", F.round("score", 6).alias("score"), "rk", F.round(1 / (60 + F.col("rk")), 9).alias("rank_score"))


def bm25_multiquery(spark: SparkSession, d: str) -> DataFrame:
    best = R.top(R.bm25(*asked_and_documents(spark, d), best=10), ["query_id"], 10, "doc_id")
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rk")


def bm25_by_scope(spark: SparkSession, d: str) -> DataFrame:
    """Statistics within each scope: every hundredth record asks the records of its scope."""
    r = first_arrivals(table(spark, d, "memory_records")).where("terms IS NOT NULL").select("scope", "id", "ord", "terms")
    asked = r.where("ord % 100 = 0").select("scope", F.col("id").alias("query_id"), "terms")
    best = R.top(R.bm25(asked, r.withColumnRenamed("id", "doc_id"), ["scope"], 5), ["scope", "query_id"], 5, "doc_id")
    return best.select("scope", "query_id", "doc_id", F.round("score", 6).alias("score"), "rk")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return R.cosine_neighbours(asked, v, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rk"))


def normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    from mnemospark.functions.numeric import cosine, norm, normalized

    v = _vectors(spark, d).withColumn("u", normalized(F.col("v")))
    return v.select("vec_id", F.round(norm(F.col("v")), 6).alias("norm"), F.round(norm(F.col("u")), 6).alias("unit"), F.round(cosine(F.col("v"), F.reverse("v")), 6).alias("mirror"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and recency rankings of all matches fused per query, best ten."""
    best = R.fused_with_recency(*asked_and_documents(spark, d, "created_at"), "created_at", 0.25, 10)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rk")


_PARTS = "1. compare the agenda with the archive\n2. open the calibrated monitor and wait\n- short"


def interleave_parts(spark: SparkSession, d: str) -> DataFrame:
    """A multi-part cue: the whole cue's list and each part's are merged seat by seat, best 20."""
    parts = spark.range(1).select(F.posexplode(F.concat(F.array(F.lit(_PARTS)), X.split_cue(F.lit(_PARTS)))).alias("list_no", "part"))
    asked = parts.select(F.col("list_no").alias("query_id"), X.tokenize("part").alias("terms"))
    lists = R.top(R.bm25(asked, checkpointed(_docs(spark, d)), best=20), ["query_id"], 20, "doc_id").select(F.lit(1).alias("cue"), F.col("query_id").alias("list_no"), "doc_id", "rk")
    return R.interleave(lists, ["cue"], "doc_id").where("rk <= 20").select("doc_id", "rk")


def diversify_topk(spark: SparkSession, d: str) -> DataFrame:
    """All matches of each query by rank, of which the first 8 that don't restate one another are kept."""
    asked, docs = asked_and_documents(spark, d)
    return R.diverse_matches(asked, docs, 8, 0.3)


def queries() -> dict:
    fs = [tokenize_documents, stem_vocabulary, cjk_bigram_counts, split_cue_parts, corrections, topic_terms, fnv_hashes, hash_embedding, tool_digests, clipped_texts, scope_parts, source_paths, bm25_topk, bm25_multiquery, bm25_by_scope, cosine_topk, normalized_vectors, rrf_fusion, interleave_parts, diversify_topk]
    return {f.__name__: f for f in fs}


_DOCS = f"docs AS MATERIALIZED (SELECT doc_id, created_at, {S.tokenize('text')} AS terms FROM documents WHERE text IS NOT NULL)"


def bm25_sql(asked: str, docs: str, by: str = "") -> str:
    """CTEs that end in sc(by, query_id, doc_id, score); asked and docs: relations with terms."""
    b = f"{by}, " if by else ""
    using = f"({b}term)"
    return f"""tf_ AS (SELECT {b}doc_id, dl, term, count(*) AS tf FROM (SELECT {b}doc_id, len(terms) AS dl, unnest(terms) AS term FROM {docs}) GROUP BY ALL),
df_ AS (SELECT {b}term, count(*) AS df FROM tf_ GROUP BY ALL),
qf_ AS (SELECT {b}query_id, term, count(*) AS qf FROM (SELECT {b}query_id, unnest(terms) AS term FROM {asked}) GROUP BY ALL),
st_ AS (SELECT {b}count(*) AS n, avg(len(terms)) AS avgdl FROM {docs} {f'GROUP BY {by}' if by else ''}),
sc AS (SELECT {b}query_id, doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qf_ JOIN tf_ USING {using} JOIN df_ USING {using} {f'JOIN st_ USING ({by})' if by else ', st_'} GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    asked = "asked AS (SELECT doc_id AS query_id, terms FROM docs WHERE doc_id % 100 = 0)"
    multi = f"WITH {_DOCS}, {asked}, {bm25_sql('asked', 'docs')}, rk_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rk FROM sc)"
    records = S.first_arrivals("memory_records")
    cue = "\\d+[.)]|[-*•]"
    units = "flatten(list_transform(list_transform(string_split(term, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda p: CASE WHEN p < 65536 THEN [p] ELSE [((p - 65536) >> 10) + 55296, ((p - 65536) & 1023) + 56320] END))"
    fnv = f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {units}), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
    parts = "SELECT trim(regexp_replace(x, '^\\s*(?:" + cue + ")\\s*', '')) AS part, doc_id, no FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS x, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) AS no FROM documents) WHERE regexp_matches(x, '^\\s*(?:" + cue + ")\\s*')"
    digest = "coalesce(" + ", ".join(f"nullif(trim(json_extract_string(text, '$.{k}')), '')" for k in X.DIGEST_KEYS) + ")"
    value = "CASE WHEN split_part(scope, ':', 1) <> 'user' THEN substr(scope, instr(scope, ':') + 1) END"
    literal = lambda s: "'" + s.replace("'", "''") + "'"
    whole = [_PARTS, "compare the agenda with the archive", "open the calibrated monitor and wait"]
    asked_parts = "asked AS (" + " UNION ALL ".join(f"SELECT {i} AS query_id, {S.tokenize(literal(p).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39)))} AS terms" for i, p in enumerate(whole)) + ")"
    return {
        "tokenize_documents": f"WITH {_DOCS} SELECT doc_id, len(terms) AS n_terms, array_to_string(terms, '|') AS terms FROM docs",
        "stem_vocabulary": f"SELECT DISTINCT word, {S.stem('word')} AS stem FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM memory_records)",
        "cjk_bigram_counts": f"SELECT bigram, count(*) AS n FROM (SELECT unnest({S.bigrams('text')}) AS bigram FROM (SELECT id, any_value(text) AS text FROM history_messages GROUP BY id)) GROUP BY 1",
        "split_cue_parts": f"WITH p AS ({parts}), ok AS (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS part_no, count(*) OVER (PARTITION BY doc_id) AS n FROM p WHERE len({S.tokenize('part')}) >= 3) SELECT doc_id, part_no, part FROM ok WHERE n > 1",
        "corrections": f"SELECT DISTINCT id FROM memory_records WHERE {S.correction('text')}",
        "topic_terms": f"SELECT id, len(t) AS n_topics, array_to_string(list_sort(t), ' ') AS topics FROM (SELECT id, {S.topic(S.tokenize('text'))} AS t FROM {records} WHERE text IS NOT NULL)",
        "fnv_hashes": f"WITH {_DOCS}, t AS (SELECT DISTINCT unnest(terms) AS term FROM docs) SELECT term, {fnv} AS hash FROM t",
        "hash_embedding": f"""WITH {_DOCS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY ALL),
h AS (SELECT doc_id, tf, {fnv} AS h FROM tf), cells AS (SELECT doc_id, h % 512 AS bucket, sum(CASE WHEN (h >> 31) = 1 THEN -1.0 ELSE 1.0 END * (1 + ln(tf))) AS x FROM h GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM cells GROUP BY 1) SELECT doc_id, bucket, round(x / norm, 6) AS value FROM cells JOIN n USING (doc_id) WHERE abs(x) > 1e-9""",
        "tool_digests": f"SELECT id, CASE WHEN length(l) > 12 THEN left(l, 12) || '…' ELSE l END AS digest FROM (SELECT DISTINCT id, split_part({digest}, chr(10), 1) AS l FROM history_messages WHERE text LIKE '{{%' AND json_valid(text)) WHERE l IS NOT NULL",
        "clipped_texts": f"SELECT id, left(text, 60) AS text, CASE WHEN length(text) > 60 THEN 'summary' ELSE 'verbatim' END AS fidelity, CASE WHEN length(f) > 40 THEN left(f, 37) || '...' ELSE f END AS title FROM (SELECT id, text, trim(regexp_replace(text, '{X.BLANK}+', ' ', 'g')) AS f FROM {records} WHERE text IS NOT NULL)",
        "scope_parts": f"SELECT split_part(scope, ':', 1) AS kind, {value} AS value, scope, count(*) AS records, strftime(min(epoch_ms(created_at)), '%Y-%m-%d') AS first_day, strftime(max(epoch_ms(created_at)), '%Y-%m-%d') AS last_day FROM {records} GROUP BY ALL",
        "source_paths": f"SELECT id, (SELECT string_agg(p, ' ' ORDER BY -length(p), p) FROM (SELECT unnest(ps) AS p)) AS paths FROM (SELECT id, list_distinct(regexp_extract_all(text, '[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*\\.(?:yml|toml|json|py|ts|md)')) AS ps FROM {records} WHERE text IS NOT NULL) WHERE len(ps) > 0",
        "bm25_topk": f"WITH {_DOCS}, asked AS (SELECT 1 AS query_id, {S.tokenize(literal(CUE))} AS terms), {bm25_sql('asked', 'docs')} SELECT doc_id, round(score, 6) AS score, rk, round(1.0 / (60 + rk), 9) AS rank_score FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rk FROM sc) WHERE rk <= 10",
        "bm25_multiquery": f"{multi} SELECT query_id, doc_id, round(score, 6) AS score, rk FROM rk_ WHERE rk <= 10",
        "bm25_by_scope": f"WITH r AS MATERIALIZED (SELECT scope, id AS doc_id, ord, terms FROM {records} WHERE terms IS NOT NULL), asked AS (SELECT scope, doc_id AS query_id, terms FROM r WHERE ord % 100 = 0), {bm25_sql('asked', 'r', 'scope')} SELECT scope, query_id, doc_id, round(score, 6) AS score, rk FROM (SELECT *, row_number() OVER (PARTITION BY scope, query_id ORDER BY round(score, 9) DESC, doc_id) AS rk FROM sc) WHERE rk <= 5",
        "cosine_topk": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.v, v.v), 9) AS s FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) SELECT query_id, vec_id, round(s, 6) AS score, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rk FROM s WHERE s > 0) WHERE rk <= 10",
        "normalized_vectors": "SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, CAST(1 AS DOUBLE) AS unit, round(list_cosine_similarity(v, list_reverse(v)), 6) AS mirror FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
        "rrf_fusion": f"""{multi}, lex AS (SELECT query_id, doc_id, rk FROM rk_),
rec AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC NULLS LAST, doc_id) AS rk FROM lex JOIN docs USING (doc_id)),
f AS (SELECT query_id, doc_id, 1.0 / (60 + lex.rk) + 0.25 / (60 + rec.rk) AS score, lex.rk AS first_rk FROM lex JOIN rec USING (query_id, doc_id))
SELECT query_id, doc_id, round(score, 6) AS score, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_rk) AS rk FROM f) WHERE rk <= 10""",
        "interleave_parts": f"WITH {_DOCS}, {asked_parts}, {bm25_sql('asked', 'docs')}, l AS (SELECT query_id AS no, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS seat FROM sc), k AS (SELECT doc_id, min(seat * 10 + no) AS s FROM l WHERE seat <= 20 GROUP BY 1) SELECT doc_id, rk FROM (SELECT doc_id, row_number() OVER (ORDER BY s) AS rk FROM k) WHERE rk <= 20",
        "diversify_topk": "WITH RECURSIVE " + multi.removeprefix("WITH ") + f""", c AS MATERIALIZED (SELECT query_id, doc_id, rk, list_distinct(docs.terms) AS t FROM rk_ JOIN docs USING (doc_id)),
walk AS (SELECT query_id, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept, CAST([] AS VARCHAR[][]) AS kept_terms FROM (SELECT DISTINCT query_id FROM c)
  UNION ALL SELECT query_id, rk, CASE WHEN ok THEN list_append(kept, doc_id) ELSE kept END, CASE WHEN ok THEN list_append(kept_terms, t) ELSE kept_terms END
  FROM (SELECT w.query_id, c.rk, c.doc_id, c.t, kept, kept_terms, len(kept) < 8 AND len(list_filter(kept_terms, lambda k: {S.jaccard('k', 'c.t')} >= 0.3)) = 0 AS ok FROM walk w JOIN c ON c.query_id = w.query_id AND c.rk = w.rk + 1 WHERE len(kept) < 8)),
last AS (SELECT query_id, arg_max(kept, rk) AS kept FROM walk GROUP BY 1), p AS (SELECT query_id, unnest(kept) AS doc_id, generate_subscripts(kept, 1) AS pick FROM last)
SELECT p.query_id, p.doc_id, c.rk, p.pick FROM p JOIN c ON c.query_id = p.query_id AND c.doc_id = p.doc_id""",
    }
