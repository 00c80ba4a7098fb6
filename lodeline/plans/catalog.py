"""Registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import calc, embed, keys, splitter, text
from lodeline.operators import context, dense, fusion, guard, index, lexical, memory, search
from lodeline.plans.relational import ORACLE as RELATIONAL_ORACLE
from lodeline.plans.relational import QUERIES as RELATIONAL
from lodeline.plans.stored import word_index
from lodeline.sources import generate
from lodeline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def tokens_sql(col: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cjk = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+"
    plain = f"lower(replace(replace(translate({col}, {quoted(text.WIDE)}, {quoted(text.PLAIN)}), '℃', '°c'), 'ß', 'ss'))"
    return (
        f"flatten(list_transform(regexp_extract_all({plain}, {quoted(text.TOKEN)}), lambda m: CASE WHEN regexp_full_match(m, '{cjk}') "
        "THEN list_concat(string_split(m, ''), list_transform(range(1, length(m)), lambda i: substr(m, i, 2))) ELSE [m] END))"
    )


# Documents of the word index, and every hundredth of them as a query.
DOCS = f"d AS (SELECT DISTINCT namespace, chunk_id, text, subject, source FROM lexical_documents), w AS (SELECT *, {tokens_sql('text')} AS words, coalesce(len({tokens_sql('text')}), 0) AS length FROM d)"
ASKED = "q AS (SELECT DISTINCT document_id AS query_id, namespace, subject, text AS query FROM lexical_documents WHERE document_id % 100 = 0 AND text IS NOT NULL)"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lexical_documents").select("namespace", "chunk_id", "text", "subject", "source").distinct()


def _asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lexical_documents").filter("document_id % 100 = 0 AND text IS NOT NULL").select(F.col("document_id").alias("query_id"), "namespace", "subject", F.col("text").alias("query")).distinct()


@query(f"WITH {DOCS} SELECT namespace, chunk_id, length AS n_tokens, CAST(len(list_distinct(coalesce(words, []))) AS BIGINT) AS n_terms FROM w")
def tokenize_stats(s, d):
    words = text.tokens(F.col("text"))
    return _docs(s, d).withColumn("words", F.coalesce(words, F.array().cast("array<string>"))).select(
        "namespace", "chunk_id", F.size("words").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("words")).cast("bigint").alias("n_terms")
    )


@query(f"WITH {DOCS}, p AS (SELECT namespace, chunk_id, unnest(words) AS term FROM w) SELECT namespace, chunk_id, term, count(*) AS tf FROM p GROUP BY ALL")
def posting_build(s, d):
    return lexical.postings(_docs(s, d))


@query(f"WITH {DOCS}, p AS (SELECT DISTINCT namespace, chunk_id, unnest(words) AS term FROM w) SELECT namespace, term, count(*) AS df FROM p GROUP BY ALL")
def term_df(s, d):
    return word_index(s, d).terms.groupBy("namespace", "term").agg(F.sum("df").alias("df"))


@query(f"WITH {DOCS} SELECT namespace, subject, count(*) AS n_docs, round(avg(length), 6) AS avg_length FROM w GROUP BY ALL")
def corpus_stats(s, d):
    return word_index(s, d).sizes.select("namespace", "subject", "n_docs", F.round(F.col("tokens") / F.col("n_docs"), 6).alias("avg_length"))


def _bm25_sql(scope: str, k: int) -> str:
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in scope.split(", "))
    return f"""bt AS (SELECT query_id, {scope}, unnest(list_distinct({tokens_sql('query')})) AS term FROM q),
bp AS (SELECT namespace, {'subject, ' if 'subject' in scope else ''}chunk_id, term, count(*) AS tf FROM (SELECT namespace, subject, chunk_id, unnest(words) AS term FROM w) GROUP BY ALL),
bd AS (SELECT {scope}, term, count(*) AS df FROM bp GROUP BY ALL), bs AS (SELECT {scope}, count(*) AS n, avg(length) AS a FROM w GROUP BY ALL),
b0 AS (SELECT bt.query_id, bp.namespace, bp.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * w.length / CASE WHEN a > 0 THEN a ELSE 1 END))), 6) AS bm25
  FROM bt JOIN bp ON bt.term = bp.term AND {on('bt', 'bp')} JOIN bd ON bd.term = bp.term AND {on('bd', 'bp')} JOIN bs ON {on('bs', 'bp')} JOIN w ON w.namespace = bp.namespace AND w.chunk_id = bp.chunk_id GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM b0 WHERE bm25 > 0) WHERE rank <= {k})"""


@query(f"WITH {DOCS}, {ASKED}, {_bm25_sql('namespace', 80)} FROM b")
def bm25_topk(s, d):
    return lexical.bm25(_asked(s, d), word_index(s, d), 80)


@query(f"WITH {DOCS}, {ASKED}, {_bm25_sql('namespace, subject', 20)} FROM b")
def bm25_subject_topk(s, d):
    return lexical.bm25(_asked(s, d), word_index(s, d), 20, by_subject=True)


USABLE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"
COSINE = "CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0 THEN list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) ELSE 0 END"


@query(f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE {USABLE}),
c AS (SELECT a.id AS query_id, b.id AS id, round({COSINE.format(a='a.e', b='b.e')}, 6) AS cosine FROM v a JOIN v b ON a.id % 100 = 0 AND len(a.e) = len(b.e))
SELECT query_id, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM c) WHERE rank <= 80""")
def dense_topk(s, d):
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dense.dense_top_k(rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec")), rows, 80)


@query(f"""WITH r AS (SELECT DISTINCT collection_name, chunk_id, embedding, embedding_dimension, embedding_norm FROM education_vector_chunks),
i AS (SELECT collection_name, chunk_id, CASE WHEN embedding IS NULL OR len(embedding) = 0 THEN 'empty' WHEN NOT ({USABLE}) THEN 'not_finite' WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 'zero'
WHEN embedding_dimension <> len(embedding) THEN 'dimension' WHEN abs(embedding_norm - sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) > 1e-4 THEN 'norm' END AS issue FROM r)
SELECT DISTINCT * FROM i WHERE issue IS NOT NULL""")
def vector_issues(s, d):
    return dense.vector_issues(table(s, d, "education_vector_chunks"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return dense.one_vector(table(s, d, "education_vector_chunks"))


def _asked_both(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lexical_documents").filter("document_id % 100 = 0 AND text IS NOT NULL").select(F.col("document_id").alias("query_id"), "namespace", "chunk_id", F.col("text").alias("query")).distinct()
    return rows.join(dense.vectors_of(rows, table(s, d, "education_vector_chunks")), "chunk_id").select("query_id", "namespace", "query", "collection_name", F.col("embedding").alias("query_vec"))


BOTH = f"""v AS (SELECT collection_name, chunk_id, min(embedding)::DOUBLE[] AS e FROM education_vector_chunks WHERE {USABLE} GROUP BY ALL),
q AS (SELECT DISTINCT l.document_id AS query_id, l.namespace, l.text AS query, x.collection_name, x.e FROM lexical_documents l JOIN (SELECT chunk_id, min(collection_name) AS collection_name, arg_min(e, collection_name) AS e FROM v GROUP BY ALL) x USING (chunk_id)
  WHERE l.document_id % 100 = 0 AND l.text IS NOT NULL),
n0 AS (SELECT q.query_id, v.chunk_id, round({COSINE.format(a='q.e', b='v.e')}, 6) AS cosine FROM q JOIN v ON q.collection_name = v.collection_name AND len(q.e) = len(v.e)),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM n0) WHERE rank <= 80)"""
FUSED = """f0 AS (SELECT query_id, chunk_id, round(sum(p), 6) AS rrf_score, min(r) AS first_route FROM (SELECT query_id, chunk_id, 0.75 / (5 + rank) AS p, 0 AS r FROM n UNION ALL SELECT query_id, chunk_id, 0.25 / (5 + rank), 1 FROM b) GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM f0) WHERE rank <= 20)"""


def _routes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return search.routes(_asked_both(s, d), word_index(s, d), _vectors(s, d), 80)


@query(f"WITH {BOTH} SELECT query_id, chunk_id, cosine, rank FROM n")
def dense_scoped_topk(s, d):
    return _routes(s, d)[0]


@query(f"WITH {DOCS}, {BOTH}, {_bm25_sql('namespace', 80)}, {FUSED} SELECT query_id, chunk_id, rrf_score, CAST(first_route AS INTEGER) AS first_route, rank FROM f")
def rrf_fuse(s, d):
    a, b = _routes(s, d)
    return fusion.reciprocal_ranks([a.select("query_id", "chunk_id", "rank"), b.select("query_id", "chunk_id", "rank")], [0.75, 0.25], 20)


# BM25 of each query within the 40 nearest chunks it has.
WITHIN = f"""o AS (SELECT chunk_id, arg_min({{'text': text}}, namespace) AS r FROM d GROUP BY ALL),
ca AS (SELECT n.query_id, q.query, n.chunk_id, n.cosine, o.r.text AS text FROM n JOIN q USING (query_id) LEFT JOIN o USING (chunk_id) WHERE n.rank <= 40),
ct AS (SELECT query_id, chunk_id, {tokens_sql('text')} AS words, coalesce(len({tokens_sql('text')}), 0) AS length FROM ca), cs AS (SELECT query_id, count(*) AS n, avg(length) AS a FROM ct GROUP BY ALL),
cq AS (SELECT query_id, unnest(list_distinct({tokens_sql('query')})) AS term FROM (SELECT DISTINCT query_id, query FROM ca)), cp AS (SELECT query_id, chunk_id, length, term, count(*) AS tf FROM (SELECT query_id, chunk_id, length, unnest(words) AS term FROM ct) GROUP BY ALL),
ch AS (SELECT cp.* FROM cp JOIN cq ON cp.query_id = cq.query_id AND cp.term = cq.term), cd AS (SELECT query_id, term, count(*) AS df FROM ch GROUP BY ALL),
cb AS (SELECT ch.query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / CASE WHEN a > 0 THEN a ELSE 1 END))), 6) AS bm25 FROM ch JOIN cd ON ch.query_id = cd.query_id AND ch.term = cd.term JOIN cs ON cs.query_id = ch.query_id GROUP BY ALL),
cc AS (SELECT ca.query_id, ca.chunk_id, ca.cosine, coalesce(cb.bm25, 0) AS bm25 FROM ca LEFT JOIN cb ON ca.query_id = cb.query_id AND ca.chunk_id = cb.chunk_id)"""


def _candidates(s: SparkSession, d: str) -> DataFrame:
    """The nearest chunks of each query with their texts and their BM25 among themselves."""
    asked, index = _asked_both(s, d), word_index(s, d)
    rows = _vectors(s, d).select("collection_name", F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))
    near = dense.dense_top_k(asked, rows, fusion.candidate_size(10), scope="collection_name").select("query_id", F.col("id").alias("chunk_id"), "cosine")
    return lexical.bm25_candidates(search.bodies(near.join(asked.select("query_id", "query"), "query_id"), index.texts).drop("subject", "source"))


@query(f"WITH {DOCS}, {BOTH}, {WITHIN} SELECT query_id, chunk_id, bm25 FROM cc")
def bm25_candidates(s, d):
    return _candidates(s, d).select("query_id", "chunk_id", "bm25")


@query(f"""WITH {DOCS}, {BOTH}, {WITHIN},
g AS (SELECT *, round(0.75 * (least(1, greatest(-1, cosine)) + 1) / 2 + 0.25 * CASE WHEN max(bm25) OVER (PARTITION BY query_id) > 0 THEN bm25 / max(bm25) OVER (PARTITION BY query_id) ELSE 0 END, 6) AS combined FROM cc)
SELECT query_id, chunk_id, cosine, bm25, combined, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, bm25 DESC, cosine DESC, chunk_id) AS rank FROM g) WHERE rank <= 10""")
def hybrid_linear(s, d):
    return fusion.linear(_candidates(s, d).select("query_id", "chunk_id", "cosine", "bm25"), 10)


@query(f"""WITH {DOCS}, {BOTH}, {_bm25_sql('namespace', 80)}, {FUSED}, o AS (SELECT chunk_id, arg_min({{'subject': subject, 'source': source, 'text': text}}, namespace) AS r FROM d GROUP BY ALL)
SELECT query_id, rank, chunk_id, rrf_score, r.subject AS subject, r.source AS source, r.text AS text FROM f LEFT JOIN o USING (chunk_id) WHERE rank <= 5""")
def search_topk(s, d):
    return search.search(_asked_both(s, d), word_index(s, d), _vectors(s, d))


@query(f"""WITH {DOCS}, {BOTH}, {_bm25_sql('namespace', 80)}, {FUSED}, o AS (SELECT chunk_id, arg_min({{'subject': subject, 'source': source, 'text': text}}, namespace) AS r FROM d GROUP BY ALL)
SELECT query_id, string_agg('【资料' || rank || '｜' || coalesce(r.subject, '综合') || '｜' || coalesce(r.source, '未知来源') || '】' || chr(10) || trim(coalesce(r.text, '')), chr(10) || chr(10) ORDER BY rank) AS context FROM f LEFT JOIN o USING (chunk_id) WHERE rank <= 5 GROUP BY query_id""")
def search_rendered(s, d):
    return search.render(search_topk(s, d))


@query("""WITH c AS (SELECT l.thread_id AS query_id, chunk_id, l.rank FROM (SELECT subject AS thread_id, chunk_id, row_number() OVER (PARTITION BY subject ORDER BY chunk_id) AS rank FROM (SELECT DISTINCT subject, chunk_id FROM lexical_documents WHERE subject IS NOT NULL)) l WHERE l.rank <= 20),
s AS (SELECT *, (rank * 7 % 20) / 20.0 AS score, count(*) OVER (PARTITION BY query_id) AS many FROM c), k AS (SELECT * FROM s WHERE many <= 5 OR rank % 4 <> 0)
SELECT query_id, chunk_id, final_rank, CASE WHEN many > 5 THEN round(score, 6) END AS rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN many > 5 THEN -score ELSE 0 END, rank) AS final_rank FROM k) WHERE final_rank <= 5""")
def rerank_parse(s, d):
    rows = table(s, d, "lexical_documents").filter("subject IS NOT NULL").select(F.col("subject").alias("query_id"), "chunk_id").distinct()
    cands = lexical.top_k(rows, ["query_id"], [F.asc("chunk_id")], 20)
    item = F.when(F.col("rank") % 4 == 0, F.concat(F.lit('{"index": '), F.col("rank") + 500, F.lit(', "relevance_score": 1}'))).otherwise(
        F.concat(F.lit('{"index": '), F.col("rank") - 1, F.lit(', "relevance_score": '), (F.col("rank") * 7 % 20 / 20.0).cast("string"), F.lit("}"))
    )
    answers = cands.groupBy("query_id").agg(F.concat(F.lit('{"output": {"results": ['), F.array_join(F.collect_list(item), ", "), F.lit("]}}")).alias("answer"))
    return fusion.rerank(cands, answers, 5)


# Two versions of the index: the chunks of the vector table, and those of the word index.
def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = table(s, d, "education_vector_chunks").select("source", "file_hash", "chunk_id")
    new = table(s, d, "lexical_documents").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "chunk_id")
    marked = new.join(old.groupBy("chunk_id").agg(F.min("file_hash").alias("file_hash")), "chunk_id", "left").select("source", F.coalesce("file_hash", "h").alias("file_hash"), "chunk_id")
    return index.manifest(old), index.manifest(marked)


VERSIONS = """ov AS (SELECT source, min(file_hash) AS sha256, list_sort(list_distinct(list(chunk_id))) AS ids FROM education_vector_chunks WHERE source IS NOT NULL GROUP BY ALL),
nl AS (SELECT l.source, coalesce(x.file_hash, sha256(coalesce(l.text, ''))) AS file_hash, l.chunk_id FROM lexical_documents l LEFT JOIN (SELECT chunk_id, min(file_hash) AS file_hash FROM education_vector_chunks GROUP BY ALL) x USING (chunk_id)),
nv AS (SELECT source, min(file_hash) AS sha256, list_sort(list_distinct(list(chunk_id))) AS ids FROM nl WHERE source IS NOT NULL GROUP BY ALL),
df AS (SELECT coalesce(o.source, n.source) AS source, CASE WHEN o.sha256 IS NULL THEN 'added' WHEN n.sha256 IS NULL THEN 'removed' WHEN o.sha256 = n.sha256 THEN 'unchanged' ELSE 'updated' END AS change FROM ov o FULL JOIN nv n ON o.source = n.source)"""


@query(f"WITH {VERSIONS} FROM df")
def manifest_diff(s, d):
    return index.manifest_diff(*_versions(s, d))


@query(f"WITH {VERSIONS} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged, (SELECT CAST(sum(len(ids)) AS BIGINT) FROM nv) AS chunks FROM df")
def manifest_report(s, d):
    old, new = _versions(s, d)
    return index.diff_report(index.manifest_diff(old, new), new)


@query(f"""WITH {VERSIONS} SELECT coalesce(o.source, n.source) AS source, CAST(coalesce(len(o.ids), 0) AS BIGINT) AS listed, CAST(coalesce(len(n.ids), 0) AS BIGINT) AS actual,
CASE WHEN o.ids IS NULL THEN 'orphan' WHEN n.ids IS NULL THEN 'missing' ELSE 'inconsistent' END AS state FROM ov o FULL JOIN nv n ON o.source = n.source WHERE o.ids IS NULL OR n.ids IS NULL OR o.ids <> n.ids""")
def ledger_reconcile(s, d):
    docs = table(s, d, "lexical_documents").filter("source IS NOT NULL").select("source", "chunk_id")
    return index.ledger_report(_versions(s, d)[0], docs)


@query("""SELECT chunk_id, 'missing' AS side FROM (SELECT DISTINCT chunk_id FROM education_vector_chunks) WHERE chunk_id NOT IN (SELECT chunk_id FROM lexical_documents)
UNION ALL SELECT chunk_id, 'extra' FROM (SELECT DISTINCT chunk_id FROM lexical_documents) WHERE chunk_id NOT IN (SELECT chunk_id FROM education_vector_chunks)""")
def id_reconcile(s, d):
    return index.id_differences(table(s, d, "education_vector_chunks"), table(s, d, "lexical_documents"))


@query("""WITH b AS (SELECT DISTINCT collection_name, chunk_id, coalesce(document, '') AS body FROM education_vector_chunks),
c AS (SELECT n.collection_name, l.chunk_id, max(l.text) AS body FROM lexical_documents l JOIN (SELECT chunk_id, min(collection_name) AS collection_name FROM education_vector_chunks GROUP BY ALL) n USING (chunk_id) WHERE l.text IS NOT NULL GROUP BY ALL)
SELECT collection_name, chunk_id, body FROM b WHERE (collection_name, chunk_id) NOT IN (SELECT (collection_name, chunk_id) FROM c) UNION ALL SELECT collection_name, chunk_id, body FROM c""")
def upsert_chunks(s, d):
    old = table(s, d, "education_vector_chunks").select("collection_name", "chunk_id", F.coalesce("document", F.lit("")).alias("body")).distinct()
    where = table(s, d, "education_vector_chunks").groupBy("chunk_id").agg(F.min("collection_name").alias("collection_name"))
    new = table(s, d, "lexical_documents").filter("text IS NOT NULL").join(where, "chunk_id").select("collection_name", "chunk_id", F.col("text").alias("body"))
    return memory.upsert(old, new, ["collection_name", "chunk_id"], F.col("body"))


@query("""SELECT id, 'topic:' || left(sha256(subject || '|' || q), 24) AS topic_key, 'difficulty:' || left(sha256('difficulty|' || subject || '|' || q), 24) AS difficulty_key, 'preference:agent:' || left(sha256('agent|preference|' || subject || '|' || q), 24) AS agent_key,
sha256(student_id || ':' || memory_key || ':' || id) AS chunk_key FROM (SELECT DISTINCT id, student_id, memory_key, subject, trim(regexp_replace(lower(content), '[\\s\\p{Z}]+', ' ', 'g')) AS q FROM education_long_term_memories)""")
def memory_keys(s, d):
    rows = table(s, d, "education_long_term_memories").select("id", "student_id", "memory_key", "subject", "content").distinct()
    return rows.select(
        "id", keys.topic_key(F.col("subject"), F.col("content")).alias("topic_key"), keys.difficulty_key(F.col("subject"), F.col("content")).alias("difficulty_key"),
        keys.agent_key(F.lit("preference"), F.col("subject"), F.col("content")).alias("agent_key"), keys.chunk_id(F.col("student_id"), F.col("memory_key"), F.col("id")).alias("chunk_key"),
    )


@query("""WITH h AS (SELECT DISTINCT collection_name, chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || collection_name || ':' || chunk_id)) AS h FROM education_vector_chunks)
SELECT collection_name, chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INT % 4) + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h""")
def point_ids(s, d):
    return table(s, d, "education_vector_chunks").select("collection_name", "chunk_id").distinct().select("collection_name", "chunk_id", keys.name_uuid(F.concat_ws(":", F.lit("chunk"), "collection_name", "chunk_id")).alias("point_id"))


@query()
def chunk_documents(s, d):
    return splitter.chunk_documents(table(s, d, "documents"), ["doc_id"], "text")


# Conversations, turns and memories.
MEM = "me AS (SELECT DISTINCT * FROM education_long_term_memories)"


def _messages(s: SparkSession, d: str) -> DataFrame:
    """Messages of both speakers, each id once, with the speaker."""
    role = F.lower(F.btrim("role"))
    speaker = F.when(role.isin("user", "pupil", "student", "human", "学生"), "user").when(role.isin("assistant", "ai", "bot", "tutor", "model", "助教"), "assistant")
    return table(s, d, "education_messages").withColumn("speaker", speaker).filter("speaker IS NOT NULL").select("thread_id", "id", "speaker", "student_id", "content", "created_at").distinct()


MSG = """ms AS (SELECT DISTINCT thread_id, id, student_id, content, created_at, CASE WHEN lower(trim(role)) IN ('user', 'pupil', 'student', 'human', '学生') THEN 'user' ELSE 'assistant' END AS speaker FROM education_messages
WHERE lower(trim(role)) IN ('user', 'pupil', 'student', 'human', '学生', 'assistant', 'ai', 'bot', 'tutor', 'model', '助教'))"""


@query("SELECT turn_id, thread_id, student_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY created_at NULLS LAST, thread_id, student_id) AS n FROM education_committed_turns) WHERE n = 1")
def first_commits(s, d):
    return memory.first_commits(table(s, d, "education_committed_turns")).select("turn_id", "thread_id", "student_id", "created_at")


# Turns of which some name another student than their thread's.
def _claimed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "education_committed_turns").withColumn("student_id", F.when(F.right("turn_id", F.lit(1)) == "7", "stu_other").otherwise(F.col("student_id")))


@query("SELECT t.turn_id, t.thread_id, t.student_id, c.owner FROM (SELECT * REPLACE (CASE WHEN right(turn_id, 1) = '7' THEN 'stu_other' ELSE student_id END AS student_id) FROM education_committed_turns) t JOIN (SELECT thread_id, min(student_id) AS owner FROM education_conversations GROUP BY ALL) c USING (thread_id) WHERE t.student_id <> c.owner")
def owner_conflicts(s, d):
    return memory.owner_conflicts(_claimed(s, d), table(s, d, "education_conversations"))


@query("""WITH a AS (SELECT thread_id, student_id, title, subject, grade, created_at, updated_at AS moment, 0 AS new FROM education_conversations
UNION ALL SELECT t.thread_id, t.student_id, NULL, '综合', NULL, t.created_at, t.created_at, 1 FROM education_committed_turns t),
b AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY new, moment, title, subject) AS f, row_number() OVER (PARTITION BY thread_id ORDER BY new DESC, moment DESC, title DESC, subject DESC) AS l,
  row_number() OVER (PARTITION BY thread_id ORDER BY grade IS NULL, new DESC, moment DESC, title DESC, subject DESC) AS g FROM a)
SELECT thread_id, max(student_id) FILTER (f = 1) AS student_id, max(title) FILTER (f = 1) AS title, max(subject) FILTER (l = 1) AS subject, max(grade) FILTER (g = 1) AS grade, min(created_at) AS created_at, max(moment) AS updated_at FROM b GROUP BY thread_id""")
def conversation_upsert(s, d):
    turns = table(s, d, "education_committed_turns").select("thread_id", "student_id", F.lit(None).cast("string").alias("title"), F.lit("综合").alias("subject"), F.lit(None).cast("int").alias("grade"), "created_at")
    return memory.upsert_conversations(table(s, d, "education_conversations"), turns)


@query("SELECT thread_id, student_id, title, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY updated_at DESC NULLS LAST, thread_id) AS n FROM (SELECT DISTINCT thread_id, student_id, title, updated_at FROM education_conversations)) WHERE n <= 30")
def recent_conversations(s, d):
    rows = table(s, d, "education_conversations").select("thread_id", "student_id", "title", "updated_at").distinct()
    return memory.newest(rows, ["student_id"], [F.col("updated_at").desc_nulls_last(), F.col("thread_id")], 30)


@query("""SELECT (SELECT count(DISTINCT thread_id) FROM education_conversations) AS conversations, (SELECT count(DISTINCT id) FROM education_messages) AS messages, (SELECT count(*) FROM (SELECT DISTINCT * FROM education_long_term_memories)) AS memories""")
def store_stats(s, d):
    a = table(s, d, "education_conversations").agg(F.count_distinct("thread_id").alias("conversations"))
    b = table(s, d, "education_messages").agg(F.count_distinct("id").alias("messages"))
    return a.crossJoin(b).crossJoin(table(s, d, "education_long_term_memories").distinct().agg(F.count(F.lit(1)).alias("memories")))  # one row each


@query(f"""WITH {MEM} SELECT id, student_id, memory_key FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY updated_at DESC NULLS LAST, id DESC) AS n FROM me WHERE memory_type = 'learning_topic') WHERE n <= 2
UNION ALL SELECT id, student_id, memory_key FROM me WHERE memory_type IS DISTINCT FROM 'learning_topic'""")
def memory_prune(s, d):
    return memory.prune_topics(table(s, d, "education_long_term_memories").distinct(), 2).select("id", "student_id", "memory_key")


@query(f"""WITH {MEM}, qs AS (SELECT thread_id AS query_id, min(student_id) AS student_id, min(subject) AS asked, min(title) AS question FROM education_conversations GROUP BY ALL),
v AS (SELECT query_id, id, asked, question, memory_type, subject, content, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC NULLS LAST, id DESC) - 1 AS recency FROM qs JOIN me USING (student_id)
  WHERE subject = asked OR subject = '综合' OR memory_type IN ('profile', 'preference')),
t AS (SELECT *, lower(regexp_replace(question, '[\\s\\p{{Z}}]+', '', 'g')) AS a, lower(regexp_replace(content, '[\\s\\p{{Z}}]+', '', 'g')) AS c FROM v WHERE recency < 200),
u AS (SELECT *, CASE WHEN length(a) >= 2 THEN list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) WHEN length(a) = 1 THEN [a] ELSE [] END AS x,
  CASE WHEN length(c) >= 2 THEN list_distinct(list_transform(range(1, length(c)), lambda i: substr(c, i, 2))) WHEN length(c) = 1 THEN [c] ELSE [] END AS y FROM t),
r AS (SELECT query_id, id, recency, round(CASE memory_type WHEN 'profile' THEN 12 WHEN 'preference' THEN 10 WHEN 'learning_difficulty' THEN 5 WHEN 'learning_topic' THEN 1 ELSE 0 END + CASE WHEN subject = asked THEN 2.0 ELSE 0 END
  + 8.0 * len(list_intersect(x, y)) / greatest(len(x), 1) + greatest(0.0, 1 - recency * 0.01), 6) AS score FROM u)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recency) AS rank FROM r) WHERE rank <= 5""")
def memory_rank(s, d):
    asked = table(s, d, "education_conversations").groupBy(F.col("thread_id").alias("query_id")).agg(F.min("student_id").alias("student_id"), F.min("subject").alias("subject"), F.min("title").alias("question"))
    return memory.rank_memories(asked, table(s, d, "education_long_term_memories").distinct())


# What is left of the four tables, as their keys.
def _left(tables: dict[str, DataFrame]) -> DataFrame:
    keys = {"conversations": "thread_id", "messages": "id", "turns": "turn_id", "memories": "id"}
    return reduce(DataFrame.unionByName, [tables[t].select(F.lit(t).alias("table_name"), F.col(k).cast("string").alias("key"), "student_id") for t, k in keys.items()])


def _four(s: SparkSession, d: str) -> list[DataFrame]:
    return [table(s, d, f"education_{t}") for t in ("conversations", "messages", "committed_turns")] + [table(s, d, "education_long_term_memories").distinct()]


_LEFT_SQL = f"""SELECT 'conversations' AS table_name, thread_id AS key, student_id FROM education_conversations WHERE {{a}} UNION ALL SELECT 'messages', id::VARCHAR, student_id FROM education_messages WHERE {{b}}
UNION ALL SELECT 'turns', turn_id, student_id FROM education_committed_turns WHERE {{c}} UNION ALL SELECT 'memories', id::VARCHAR, student_id FROM me WHERE {{m}}"""


@query(f"WITH {MEM}, g AS (SELECT DISTINCT thread_id FROM education_conversations WHERE grade IS NULL) " + _LEFT_SQL.format(
    a="thread_id NOT IN (FROM g)", b="thread_id NOT IN (FROM g)", c="thread_id NOT IN (FROM g)", m="NOT (coalesce(source_thread_id IN (FROM g), false) AND coalesce(memory_type IN ('learning_topic', 'learning_difficulty'), false))"))
def memory_forget(s, d):
    gone = table(s, d, "education_conversations").filter("grade IS NULL").select("thread_id")
    return _left(memory.forget_threads(gone, *_four(s, d)))


@query(f"WITH {MEM}, g AS (SELECT DISTINCT student_id FROM education_conversations WHERE grade = 3), h AS (SELECT DISTINCT thread_id FROM education_conversations WHERE student_id IN (FROM g)) " + _LEFT_SQL.format(
    a="student_id NOT IN (FROM g)", b="thread_id NOT IN (FROM h)", c="thread_id NOT IN (FROM h) AND student_id NOT IN (FROM g)", m="student_id NOT IN (FROM g)"))
def student_forget(s, d):
    gone = table(s, d, "education_conversations").filter("grade = 3").select("student_id")
    return _left(memory.forget_students(gone, *_four(s, d)))


@query(f"""WITH {MSG}, c AS (SELECT thread_id, min(subject) AS subject FROM education_conversations GROUP BY ALL),
r AS (SELECT m.id, c.subject, m.content AS q FROM ms m JOIN c USING (thread_id) WHERE speaker = 'user' AND content IS NOT NULL AND c.subject IS NOT NULL)
SELECT id, 'learning_difficulty' AS memory_type, subject AS memory_subject, 0.75 AS confidence FROM r WHERE regexp_matches(q, '{text.DIFFICULTY}')
UNION ALL SELECT id, 'learning_topic', subject, 0.8 FROM r
""" + "".join(f"UNION ALL SELECT id, 'preference', '综合', 0.9 FROM r WHERE regexp_matches(q, '{'|'.join(w)}')\n" for _, w, _ in text.PREFERENCES))
def memory_extract(s, d):
    subjects = table(s, d, "education_conversations").groupBy("thread_id").agg(F.min("subject").alias("subject")).filter("subject IS NOT NULL")
    asked = _messages(s, d).filter("speaker = 'user' AND content IS NOT NULL").join(subjects, "thread_id").select("student_id", F.col("id").cast("string").alias("thread_id"), "subject", F.col("content").alias("question"))
    return memory.extract_memories(asked).select(F.col("thread_id").cast("bigint").alias("id"), "memory_type", "memory_subject", F.col("confidence"))


@query(f"WITH {MSG} SELECT thread_id, id, n AS back FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY id DESC) AS n FROM ms) WHERE n <= 12")
def recent_messages(s, d):
    return context.newest_first(_messages(s, d), 12).select("thread_id", "id", "back")


@query(f"""WITH {MSG}, a AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY id DESC) AS back, regexp_replace(coalesce(content, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS said FROM ms),
l AS (SELECT thread_id, id, back, (CASE WHEN speaker = 'assistant' THEN '小助手：' ELSE '学生：' END) || said AS line FROM a WHERE back <= 12 AND said <> ''),
u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY thread_id ORDER BY back) - 1 AS used, row_number() OVER (PARTITION BY thread_id ORDER BY back) AS n FROM l)
SELECT thread_id, id, CASE WHEN used > 120 THEN regexp_replace(left(line, 119), '[\\s\\p{{Z}}]+$', '') || '…' ELSE line END AS line FROM u WHERE used <= 120 OR n = 1""")
def char_budget(s, d):
    return context.within_budget(_messages(s, d), 12, 120)


@query(f"""WITH {MSG}, z AS (SELECT thread_id, count(*) AS n, sum(length(coalesce(content, ''))) AS chars FROM ms GROUP BY ALL)
SELECT thread_id, id, NOT ((z.n >= 24 OR z.chars > 8000) AND z.n > 11) OR back <= 11 AS retained FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY id DESC) AS back FROM ms) JOIN z USING (thread_id)""")
def compaction(s, d):
    return context.compaction(_messages(s, d))


@query(r"SELECT DISTINCT id, regexp_replace(content, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[邮箱已隐藏]', 'g') AS hidden FROM education_messages")
def redact_email(s, d):
    pattern, mark = text.STORED_RULES[1]
    return table(s, d, "education_messages").select("id", F.regexp_replace("content", pattern, mark).alias("hidden")).distinct()


_HIDE = lambda c, pattern, mark: f"regexp_replace({c}, '(^|[^0-9]){pattern}([^0-9]|$)', '\\1{mark}\\2', 'g')"  # noqa: E731 - without lookaround: each rule twice, for neighbours that share a character


@query("SELECT DISTINCT id, " + _HIDE(_HIDE("regexp_replace(" + _HIDE(_HIDE("content", "1[3-9][0-9]{9}", "[手机号已隐藏]"), "1[3-9][0-9]{9}", "[手机号已隐藏]") + r", '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[邮箱已隐藏]', 'g')", "[0-9]{17}[0-9Xx]", "[证件号已隐藏]"), "[0-9]{17}[0-9Xx]", "[证件号已隐藏]") + " AS hidden FROM education_messages")
def redact_stored(s, d):
    return table(s, d, "education_messages").select("id", text.hide_stored(F.col("content")).alias("hidden")).distinct()


@query()
def redact_outgoing(s, d):
    return table(s, d, "education_messages").select("id", text.hide_outgoing(F.col("content")).alias("hidden")).distinct()


@query("SELECT DISTINCT id FROM education_messages WHERE regexp_matches(lower(content), '" + "|".join(text.TIME_MARKERS) + "')")
def time_sensitive(s, d):
    return table(s, d, "education_messages").filter(text.is_time_sensitive(F.col("content"))).select("id").distinct()


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(text, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(t) <= 50 THEN t ELSE regexp_replace(left(t, 49), '[\s\p{Z}]+$', '') || '…' END AS head, CASE WHEN length(t) <= 50 THEN t ELSE '…' || regexp_replace(right(t, 49), '^[\s\p{Z}]+', '') END AS tail FROM c""")
def truncate_texts(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", text.keep_start(F.col("text"), 50).alias("head"), text.keep_end(F.col("text"), 50).alias("tail"))


# Events as a log of tool calls; all tools but one have a limit.
LIMITS = {"click": 6, "purchase": 6, "signup": 6, "error": 6}


@query("SELECT event_id, user_id, event_type, n AS call_no, n <= 6 OR event_type NOT IN ('click', 'purchase', 'signup', 'error') AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)")
def tool_quota(s, d):
    calls = table(s, d, "events").withColumn("day", F.to_date("ts"))
    return guard.within_quota(calls, ["user_id", "day"], "event_type", ["ts", "event_id"], LIMITS).select("event_id", "user_id", "event_type", "call_no", "allowed")


@query(f"""WITH {MSG}, a AS (SELECT id, content AS answer FROM ms WHERE speaker = 'assistant' AND length(content) > 0)
SELECT id, CAST(i AS INTEGER) AS pos, substr(answer, i * 8 + 1, 8) AS chunk FROM (SELECT *, unnest(range(0, CAST(ceil(length(answer) / 8.0) AS BIGINT))) AS i FROM a)""")
def answer_chunks(s, d):
    return guard.answer_chunks(_messages(s, d).filter("speaker = 'assistant'").select("id", F.col("content").alias("answer")))


@query(f"""WITH {MSG}, a AS (SELECT id, content AS answer FROM ms WHERE speaker = 'assistant' AND length(content) > 0), e AS (SELECT id, CAST(ceil(length(answer) / 8.0) AS BIGINT) AS n, answer FROM a)
SELECT id, CAST(i AS INTEGER) AS pos, CASE WHEN i < n THEN 'answer_delta' ELSE 'done' END AS event, CASE WHEN i < n THEN substr(answer, i * 8 + 1, 8) END AS text, CASE WHEN i = n THEN 'true' END AS completed FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM e)""")
def event_stream_roundtrip(s, d):
    events = guard.event_text(answer_chunks(s, d))
    streams = events.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "event"))), lambda x: x["event"]), "").alias("stream"))
    return guard.parse_events(streams).select("id", "pos", "event", F.get_json_object("data", "$.text").alias("text"), F.get_json_object("data", "$.completed").alias("completed"))


SUM = r"(?:^|[^0-9.])([0-9]{1,9} [×÷+−-] [0-9]{1,9})(?:[^0-9.]|$)"


@query(f"""WITH e AS (SELECT DISTINCT id, unnest(regexp_extract_all(content, '{SUM}', 1)) AS expression FROM education_messages),
t AS (SELECT *, string_split(expression, ' ')[1]::BIGINT AS a, string_split(expression, ' ')[2] AS sign, string_split(expression, ' ')[3]::BIGINT AS b FROM e)
SELECT id, expression, CASE WHEN sign = '÷' AND b = 0 OR sign = '×' AND a * b > 1000000000000 THEN NULL WHEN sign = '×' THEN (a * b)::VARCHAR WHEN sign = '+' THEN (a + b)::VARCHAR WHEN sign = '÷' THEN CASE WHEN a % b = 0 THEN (a // b)::VARCHAR ELSE format('{{:.12g}}', a::DOUBLE / b) END ELSE (a - b)::VARCHAR END AS value FROM t""")
def safe_calc(s, d):
    shown = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(SUM), F.lit(1))))
    rows = table(s, d, "education_messages").select("id", shown.alias("expression")).distinct()
    return rows.withColumn("r", calc.safe_calc("expression")).select("id", "expression", "r.value")


@query()
def hash_embedding(s, d):
    return _docs(s, d).select("namespace", "chunk_id", embed.hash_embedding(F.col("text"), 256).alias("embedding"))


@query("""WITH r AS (SELECT CAST(i % 750 AS INT) AS n, CAST((i // 750) % 3 AS INT) AS track, CAST((i // 2250) % 6 + 1 AS INT) AS grade, i // 13500 AS s FROM range(40500) t(i)),
v AS (SELECT *, n + 11 * grade AS a, n % 97 + grade + 2 AS b FROM r),
x AS (SELECT *, CASE s WHEN 0 THEN printf('%d年级练习%d：', grade, n + 1) || CASE track WHEN 0 THEN printf('%d + %d = %d', a, b, a + b) WHEN 1 THEN printf('%d × %d = %d', a, b, a * b)
    ELSE printf('%d : %d = ', a, b) || CASE WHEN a % b = 0 THEN CAST(a // b AS VARCHAR) ELSE (a // gcd(a, b)) || '/' || (b // gcd(a, b)) END END
  WHEN 1 THEN printf('第%d册第%d组第%d题：把第%d段读两遍，再用自己的话说一说。', grade, track + 1, n + 1, b)
  ELSE printf('Track %d, grade %d, no. %d: a walk begins at %02d:%02d and takes %d minutes.', track, grade, n, (n // 60) % 24, n % 60, b) END AS text FROM v)
SELECT ['数学', '语文', '英语'][CAST(s AS INT) + 1] AS subject, grade, track, n, sha256(text) AS digest FROM x""")
def corpus_generate(s, d):
    return generate.corpus(s).select("subject", "grade", "track", "n", "digest")


@query("SELECT s AS subject, 18 AS files, 13500 AS records, 0 AS duplicates FROM (VALUES ('数学'), ('语文'), ('英语')) t(s)")
def corpus_report(s, d):
    return generate.corpus_report(generate.corpus(s))


@query("SELECT CAST(row_number() OVER (ORDER BY p) - 1 AS BIGINT) AS pos, CAST(p AS BIGINT) AS prime FROM (SELECT n AS p FROM range(11, 8000) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 90) u(m) WHERE m < n AND n % m = 0) ORDER BY n LIMIT 750)")
def first_primes(s, d):
    return generate.primes(s, 750)


from lodeline.plans import service  # noqa: E402, F401 - registers more queries

QUERIES.update(RELATIONAL)
ORACLE.update(RELATIONAL_ORACLE)
