"""Registered queries of the search service around its index and memory: scopes, fallbacks, upkeep, recording of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import text
from lodeline.operators import context, dense, fusion, guard, index, lexical, memory, search
from lodeline.plans.catalog import BOTH, COSINE, DOCS, FUSED, LIMITS, MEM, MSG, USABLE, _bm25_sql, _claimed, _messages, _routes, query
from lodeline.plans.stored import word_index
from lodeline.sources.tables import table

# Search within subjects: both routes of a query keep to the subject of its document.
SCOPED = f"""v AS (SELECT collection_name, chunk_id, min(subject) AS subject, min(embedding)::DOUBLE[] AS e FROM education_vector_chunks WHERE {USABLE} GROUP BY ALL),
q AS (SELECT DISTINCT l.document_id AS query_id, l.namespace, l.subject, l.text AS query, x.collection_name, x.e FROM lexical_documents l JOIN (SELECT chunk_id, min(collection_name) AS collection_name, arg_min(e, collection_name) AS e FROM v GROUP BY ALL) x USING (chunk_id)
  WHERE l.document_id % 100 = 0 AND l.text IS NOT NULL AND coalesce(l.subject, '') NOT IN ('', '综合')),
n0 AS (SELECT q.query_id, v.chunk_id, round({COSINE.format(a='q.e', b='v.e')}, 6) AS cosine FROM q JOIN v ON q.collection_name = v.collection_name AND q.subject = v.subject AND len(q.e) = len(v.e)),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM n0) WHERE rank <= 80)"""


@query(f"WITH {DOCS}, {SCOPED}, {_bm25_sql('namespace, subject', 80)}, {FUSED} SELECT query_id, chunk_id, rrf_score, rank FROM f WHERE rank <= 5")
def search_scoped(s, d):
    chunks = table(s, d, "education_vector_chunks")
    rows = table(s, d, "lexical_documents").filter("document_id % 100 = 0 AND text IS NOT NULL AND coalesce(subject, '') NOT IN ('', '综合')")
    rows = rows.select(F.col("document_id").alias("query_id"), "namespace", "subject", "chunk_id", F.col("text").alias("query")).distinct()
    asked = rows.join(dense.vectors_of(rows, chunks), "chunk_id").select("query_id", "namespace", "subject", "query", "collection_name", F.col("embedding").alias("query_vec"))
    vectors = dense.one_vector(chunks, "subject")
    return search.search(asked, word_index(s, d), vectors).select("query_id", "chunk_id", "rrf_score", "rank")


@query(f"""WITH {BOTH} SELECT query_id, chunk_id, round(0.75 / (5 + rank), 6) AS rrf_score, rank FROM n WHERE rank <= 20""")
def rrf_weight_zero(s, d):
    near, words = _routes(s, d)
    return fusion.reciprocal_ranks([near.select("query_id", "chunk_id", "rank"), words.select("query_id", "chunk_id", "rank")], [0.75, 0.0], 20).select("query_id", "chunk_id", "rrf_score", "rank")


@query(f"""WITH {BOTH}, k AS (SELECT query_id, chunk_id, min(rank) AS place FROM (SELECT query_id, chunk_id, rank FROM n WHERE rank <= 40 UNION ALL SELECT query_id, chunk_id, 81 - rank FROM n WHERE rank <= 40) GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, chunk_id) AS close FROM k) SELECT query_id, chunk_id, round(1.0 / (5 + close), 6) AS rrf_score FROM c WHERE close <= 20""")
def rrf_dedup(s, d):
    near = _routes(s, d)[0].filter("rank <= 40").select("query_id", "chunk_id", "rank")
    twice = near.unionByName(near.withColumn("rank", 81 - F.col("rank")))
    return fusion.reciprocal_ranks([twice], [1.0], 20).select("query_id", "chunk_id", "rrf_score")


def _cands(s: SparkSession, d: str) -> DataFrame:
    """Twenty documents of each subject, with their texts."""
    rows = table(s, d, "lexical_documents").filter("subject IS NOT NULL").groupBy(F.col("subject").alias("query_id"), "chunk_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return lexical.top_k(rows, ["query_id"], [F.asc("chunk_id")], 20).withColumn("query", F.col("query_id"))


CANDS = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank, count(*) OVER (PARTITION BY query_id) AS everything FROM (SELECT subject AS query_id, chunk_id, min(coalesce(text, '')) AS text FROM lexical_documents WHERE subject IS NOT NULL GROUP BY ALL)) WHERE rank <= 20)"


@query(f"WITH {CANDS} SELECT query_id, chunk_id, rank AS final_rank, CAST(NULL AS DOUBLE) AS rerank_score FROM c WHERE rank <= 5")
def rerank_fallback(s, d):
    cands = _cands(s, d)
    broken = F.when(F.length("query_id") % 2 == 0, '{"output": {"results": [{"index": "x"}]}}').otherwise("service unavailable")
    return fusion.rerank(cands.select("query_id", "chunk_id", "rank"), cands.select("query_id", broken.alias("answer")).distinct(), 5)


def by_length(_: list[str], passages: list[str]) -> list[float]:
    return [float(len(p)) for p in passages]


@query(f"""WITH {CANDS}, m AS (SELECT *, count(*) OVER (PARTITION BY query_id) > 5 AS judged FROM c)
SELECT query_id, chunk_id, final_rank, CASE WHEN judged THEN length(text)::DOUBLE END AS rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN judged THEN -length(text) ELSE 0 END, rank) AS final_rank FROM m) WHERE final_rank <= 5""")
def rerank_scored(s, d):
    return fusion.score_candidates(_cands(s, d), 5, by_length)


# Upkeep of the index.
ROWS = "SELECT DISTINCT collection_name, chunk_id, source FROM education_vector_chunks"


def _rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "education_vector_chunks").select("collection_name", "chunk_id", "source").distinct()


@query(f"{ROWS} WHERE chunk_id NOT IN (SELECT chunk_id FROM lexical_documents WHERE subject = '数学')")
def delete_ids(s, d):
    return index.delete_ids(_rows(s, d), table(s, d, "lexical_documents").filter("subject = '数学'").select("chunk_id"))


@query(f"{ROWS} WHERE source IS DISTINCT FROM (SELECT max(source) FROM education_vector_chunks)")
def delete_source(s, d):
    last = table(s, d, "education_vector_chunks").agg(F.max("source")).first()[0]
    return index.delete_source(_rows(s, d), last)


@query(f"{ROWS} WHERE collection_name IS DISTINCT FROM (SELECT min(collection_name) FROM education_vector_chunks)")
def reset_collection(s, d):
    first = table(s, d, "education_vector_chunks").agg(F.min("collection_name")).first()[0]
    return index.reset(_rows(s, d), "collection_name", first)


@query("SELECT source, chunk_id, row_number() OVER (PARTITION BY source ORDER BY chunk_id) - 1 AS pos FROM (SELECT DISTINCT source, chunk_id FROM lexical_documents WHERE source IS NOT NULL)")
def chunk_ids(s, d):
    return index.ids_of_sources(table(s, d, "lexical_documents"))


@query(f"""WITH {DOCS}, p AS (SELECT DISTINCT namespace, subject, chunk_id, unnest(words) AS term FROM w)
SELECT namespace, count(DISTINCT chunk_id) AS chunks, count(DISTINCT source) AS files, coalesce((SELECT count(*) FROM p WHERE p.namespace = w.namespace), 0) AS postings FROM w GROUP BY namespace""")
def index_status(s, d):
    held = word_index(s, d)
    return index.index_status(held.documents, held.postings)


@query("SELECT collection_name, count(DISTINCT chunk_id) AS chunks FROM education_vector_chunks GROUP BY ALL")
def collection_counts(s, d):
    return _rows(s, d).groupBy("collection_name").agg(F.count_distinct("chunk_id").alias("chunks"))


_OLD = "o AS (SELECT source, min(file_hash) AS sha256, count(DISTINCT chunk_id) AS n FROM education_vector_chunks WHERE source IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_OLD}, l AS (SELECT source, 'now' AS sha256, count(DISTINCT chunk_id) AS n FROM lexical_documents WHERE source IS NOT NULL AND subject = '语文' GROUP BY ALL)
SELECT * FROM l UNION ALL SELECT * FROM o WHERE source NOT IN (SELECT source FROM l) AND source IN (SELECT source FROM lexical_documents WHERE source IS NOT NULL)""")
def checkpoint_merge(s, d):
    docs = table(s, d, "lexical_documents")
    done = index.manifest(docs.filter("subject = '语文'").select("source", F.lit("now").alias("file_hash"), "chunk_id"))
    return index.checkpoint_merge(index.manifest(table(s, d, "education_vector_chunks").select("source", "file_hash", "chunk_id")), done, docs).select("source", "sha256", "n")


@query("""WITH a AS (SELECT source, chunk_id FROM education_vector_chunks WHERE source IS NOT NULL), b AS (SELECT source, chunk_id FROM lexical_documents WHERE source IS NOT NULL),
bad AS (SELECT source FROM (SELECT source, list_sort(list_distinct(list(chunk_id))) AS x FROM a GROUP BY ALL) x LEFT JOIN (SELECT source, list_sort(list_distinct(list(chunk_id))) AS y FROM b GROUP BY ALL) y USING (source) WHERE x IS DISTINCT FROM y)
SELECT DISTINCT source, chunk_id FROM a WHERE source IN (FROM bad)""")
def lexical_repair(s, d):
    chunks = table(s, d, "education_vector_chunks").select("source", "file_hash", "chunk_id")
    report = index.ledger_report(index.manifest(chunks), table(s, d, "lexical_documents").select("source", "chunk_id"))
    return index.repair_rows(report, chunks.filter("source IS NOT NULL").select("source", "chunk_id").distinct())


@query("""WITH a AS (SELECT source, chunk_id FROM education_vector_chunks WHERE source IS NOT NULL), b AS (SELECT source, chunk_id FROM lexical_documents WHERE source IS NOT NULL)
SELECT source, CASE WHEN y IS NULL THEN 'missing' ELSE 'inconsistent' END AS state FROM (SELECT source, list_sort(list_distinct(list(chunk_id))) AS x FROM a GROUP BY ALL) x LEFT JOIN (SELECT source, list_sort(list_distinct(list(chunk_id))) AS y FROM b GROUP BY ALL) y USING (source) WHERE x IS DISTINCT FROM y""")
def keyword_sync(s, d):
    now = index.manifest(table(s, d, "education_vector_chunks").select("source", "file_hash", "chunk_id"))
    return index.keyword_sync_plan(now, now, table(s, d, "lexical_documents").select("source", "chunk_id"))


@query("""WITH a AS (SELECT DISTINCT collection_name, chunk_id, embedding FROM education_vector_chunks), b AS (SELECT * FROM a WHERE collection_name <> (SELECT min(collection_name) FROM a)), c AS (SELECT chunk_id, count(*) AS n FROM a GROUP BY ALL)
SELECT collection_name, chunk_id, 'missing' AS side FROM a WHERE collection_name = (SELECT min(collection_name) FROM a)""")
def copy_differences(s, d):
    rows = table(s, d, "education_vector_chunks").select("collection_name", "chunk_id", "embedding").distinct()
    first = rows.agg(F.min("collection_name")).first()[0]
    return index.copy_differences(rows, rows.filter(F.col("collection_name") != first), ["collection_name", "chunk_id"], rows.columns)


@query(f"""WITH v AS (SELECT collection_name, chunk_id, min(embedding) AS embedding FROM education_vector_chunks WHERE {USABLE} GROUP BY ALL),
g AS (SELECT collection_name, chunk_id, list_transform(embedding, lambda x: (-x)::FLOAT) AS embedding FROM v WHERE chunk_id IN (SELECT chunk_id FROM lexical_documents WHERE subject = '科学'))
SELECT collection_name, chunk_id, embedding FROM g UNION ALL SELECT * FROM v WHERE (collection_name, chunk_id) NOT IN (SELECT (collection_name, chunk_id) FROM g)""")
def upsert_vectors(s, d):
    held = table(s, d, "education_vector_chunks").filter(dense.is_finite(F.col("embedding"))).groupBy("collection_name", "chunk_id").agg(F.min("embedding").alias("embedding"))
    some = held.join(table(s, d, "lexical_documents").filter("subject = '科学'").select("chunk_id").distinct(), "chunk_id", "left_semi")
    given = some.select("collection_name", "chunk_id", F.transform("embedding", lambda x: -x).alias("embedding"), text.metadata_json(F.struct("chunk_id")).alias("metadata_json"))
    return index.upsert_vectors(held, given)


# Filters, projections and texts.
@query("SELECT DISTINCT namespace, chunk_id FROM lexical_documents WHERE coalesce(CASE WHEN json_valid(metadata_json) THEN json_extract_string(metadata_json, '$.subject') = '数学' AND json_extract_string(metadata_json, '$.chunk_index') = '3' END, false)")
def metadata_filter(s, d):
    return table(s, d, "lexical_documents").filter(dense.matches(F.col("metadata_json"), {"subject": "数学", "chunk_index": 3})).select("namespace", "chunk_id").distinct()


@query("""SELECT DISTINCT namespace, chunk_id, CASE WHEN json_valid(metadata_json) THEN json_extract_string(metadata_json, '$.source') END AS source, CASE WHEN json_valid(metadata_json) THEN json_extract_string(metadata_json, '$.chunk_index')::INT END AS chunk_index FROM lexical_documents""")
def json_salvage(s, d):
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "metadata_json", F.lit("\n```"))
    return table(s, d, "lexical_documents").withColumn("m", text.salvaged(fenced, "source string, chunk_index int")).select("namespace", "chunk_id", "m.source", "m.chunk_index").distinct()


@query("SELECT DISTINCT document_id, CASE WHEN trim(subject) IN ('数学', '语文', '英语', '科学') THEN trim(subject) ELSE '综合' END AS subject FROM lexical_documents")
def subject_normalised(s, d):
    return table(s, d, "lexical_documents").select("document_id", text.subject_or_general(F.col("subject"), ["数学", "语文", "英语", "科学"]).alias("subject")).distinct()


@query(r"""WITH t AS (SELECT DISTINCT id, trim(regexp_replace(content, '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) AS t FROM education_messages WHERE content IS NOT NULL) SELECT id, CASE WHEN length(t) <= 30 THEN t ELSE left(t, 30) || '…' END AS title FROM t""")
def message_titles(s, d):
    return table(s, d, "education_messages").filter("content IS NOT NULL").select("id", text.one_line(F.col("content"), 30, "…").alias("title")).distinct()


DOMAINS = ["https://Example.org/start", "example.com.", "example.org"]
_URL = "CASE document_id % 6 WHEN 0 THEN 'https://docs.example.org/' WHEN 1 THEN 'http://EXAMPLE.com./' WHEN 2 THEN 'https://example.org.evil.net/' WHEN 3 THEN 'ftp://example.org/' WHEN 4 THEN 'https://notexample.org/' ELSE 'HTTPS://user@example.org:8443/' END || document_id"


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Addresses such as a search could give, made from the documents' numbers; the subject stands for the question."""
    return table(s, d, "lexical_documents").filter("subject IS NOT NULL").select(F.col("subject").alias("query_id"), F.col("document_id").alias("pos"), F.expr(_URL).alias("url")).distinct()


@query(f"SELECT DISTINCT document_id AS pos, {_URL} AS url FROM lexical_documents WHERE subject IS NOT NULL AND document_id % 6 IN (0, 1, 5)")
def trusted_urls(s, d):
    return _pages(s, d).filter(guard.is_trusted(F.col("url"), DOMAINS)).select("pos", "url").distinct()


@query(f"SELECT query_id, pos, url, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM (SELECT DISTINCT subject AS query_id, document_id AS pos, {_URL} AS url FROM lexical_documents WHERE subject IS NOT NULL AND document_id % 6 IN (0, 1, 5))) WHERE rank <= 5")
def web_results(s, d):
    return guard.trusted_results(_pages(s, d), DOMAINS)


@query("""WITH q AS (SELECT DISTINCT id AS query_id, content, id % 2 = 0 AS attempted FROM education_messages), r AS (SELECT DISTINCT id AS query_id FROM education_messages WHERE id % 3 = 0)
SELECT query_id, CASE WHEN NOT attempted AND NOT coalesce(regexp_matches(lower(content), '""" + "|".join(text.TIME_MARKERS) + """'), false) THEN 'local' WHEN query_id IN (FROM r) THEN 'web' ELSE 'none' END AS action FROM q""")
def web_decision(s, d):
    rows = table(s, d, "education_messages").select(F.col("id").alias("query_id"), "content", (F.col("id") % 2 == 0).alias("local_attempted")).distinct()
    found = table(s, d, "education_messages").filter("id % 3 = 0").select(F.col("id").alias("query_id"))
    return guard.web_decision(rows, found, F.coalesce(text.is_time_sensitive(F.col("content")), F.lit(False)))


@query("""WITH n AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS calls FROM events GROUP BY ALL)
SELECT *, CASE WHEN event_type = 'view' THEN calls ELSE least(calls, 6) END AS allowed, CASE WHEN event_type = 'view' THEN 0 ELSE greatest(calls - 6, 0) END AS refused FROM n""")
def quota_report(s, d):
    return guard.quota_report(table(s, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type", LIMITS)


# Conversations and memories.
@query(f"WITH {MSG} SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY id) AS pos, id, speaker, content FROM ms")
def history(s, d):
    return memory.history(_messages(s, d))


@query(rf"WITH {MSG}, a AS (SELECT *, regexp_replace(content, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS answer FROM ms WHERE speaker = 'assistant') SELECT thread_id, arg_max(answer, id) AS answer FROM a WHERE answer <> '' GROUP BY thread_id")
def last_answers(s, d):
    return context.last_answer(_messages(s, d))


@query(f"WITH {MEM} SELECT id, student_id, memory_key FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY updated_at DESC NULLS LAST, id DESC) AS n FROM me) WHERE n <= 50")
def recent_memories(s, d):
    return memory.recent_memories(table(s, d, "education_long_term_memories").distinct()).select("id", "student_id", "memory_key")


@query(rf"""WITH {MSG}, f AS (SELECT thread_id, regexp_replace(arg_min(content, id), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS a, regexp_replace(arg_max(content, id), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS b FROM ms WHERE content IS NOT NULL GROUP BY ALL),
p AS (SELECT thread_id, CASE WHEN a NOT IN ('', '无') THEN '此前：' || CASE WHEN length(a) <= 28 THEN a ELSE regexp_replace(left(a, 27), '[\s\p{{Z}}]+$', '') || '…' END END AS x, CASE WHEN b NOT IN ('', '无') THEN '新增：' || CASE WHEN length(b) <= 60 THEN b ELSE '…' || regexp_replace(right(b, 59), '^[\s\p{{Z}}]+', '') END END AS y FROM f)
SELECT thread_id, coalesce(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x || chr(10) || y ELSE coalesce(x, y) END, '无') AS summary FROM p""")
def fallback_summary(s, d):
    rows = _messages(s, d).filter("content IS NOT NULL").groupBy("thread_id").agg(F.min_by("content", "id").alias("a"), F.max_by("content", "id").alias("b"))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return rows.select("thread_id", context.plain_summary(strip("a"), strip("b"), 100).alias("summary"))


# A batch of turns: those of the log, with questions that hold contact data, some of them of threads that another student owns, some committed before.
QUESTION, ANSWER = "我不懂这个题目，打13812345678找我，或写到 a.b@example.org", "先举个例子。"


def _turns(s: SparkSession, d: str) -> DataFrame:
    talks = table(s, d, "education_conversations").groupBy("thread_id").agg(F.min("subject").alias("subject"), F.min("grade").alias("grade"))
    return _claimed(s, d).join(talks, "thread_id", "left").select(
        "turn_id", "thread_id", "student_id", F.lit("新会话").alias("title"), F.coalesce("subject", F.lit("综合")).alias("subject"), "grade", F.lit(QUESTION).alias("question"), F.lit(ANSWER).alias("answer"), "created_at",
        F.when(F.right("turn_id", F.lit(1)) == "3", 0).alias("proposed"),
    )


def _recorded(s: SparkSession, d: str) -> dict[str, DataFrame]:
    before = table(s, d, "education_committed_turns").filter("right(turn_id, 1) = '1'")
    none = s.createDataFrame([], "turn_id string, pos int, memory_type string, subject string, content string, confidence string")
    messages = table(s, d, "education_messages").filter("right(thread_id, 1) = 'a'")
    return memory.record_turns(_turns(s, d), table(s, d, "education_conversations"), messages, before, table(s, d, "education_long_term_memories").distinct(), none)


TURNS = f"""c AS (SELECT thread_id, min(student_id) AS owner, min(subject) AS subject, min(grade) AS grade FROM education_conversations GROUP BY ALL),
t0 AS (SELECT turn_id, t.thread_id, CASE WHEN right(turn_id, 1) = '7' THEN 'stu_other' ELSE student_id END AS student_id, coalesce(c.subject, '综合') AS subject, c.grade, c.owner, created_at FROM education_committed_turns t LEFT JOIN c USING (thread_id)),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY created_at NULLS LAST, thread_id, student_id) AS k FROM t0 WHERE owner IS NULL OR owner = student_id) WHERE k = 1 AND right(turn_id, 1) <> '1')"""
HIDDEN = "我不懂这个题目，打[手机号已隐藏]找我，或写到 [邮箱已隐藏]"


@query(f"WITH {TURNS} SELECT turn_id, thread_id, student_id, created_at FROM t UNION ALL SELECT turn_id, thread_id, student_id, created_at FROM education_committed_turns WHERE right(turn_id, 1) = '1'")
def record_turns(s, d):
    return _recorded(s, d)["turns"]


@query(f"WITH {TURNS} SELECT thread_id, 'user' AS role, '{HIDDEN}' AS content, created_at FROM t UNION ALL SELECT thread_id, 'assistant', '{ANSWER}', created_at FROM t UNION ALL SELECT thread_id, role, content, created_at FROM education_messages WHERE right(thread_id, 1) = 'a'")
def record_turn_messages(s, d):
    return _recorded(s, d)["messages"]


@query(f"""WITH {TURNS}, k AS (SELECT thread_id, min(title) AS x FROM education_conversations GROUP BY ALL),
u AS (SELECT thread_id, created_at, updated_at AS moment FROM education_conversations UNION ALL SELECT thread_id, created_at, created_at FROM t) SELECT thread_id, min(created_at) AS created_at, max(moment) AS updated_at FROM u GROUP BY thread_id""")
def record_turn_conversations(s, d):
    return _recorded(s, d)["conversations"].select("thread_id", "created_at", "updated_at")




@query(f"""WITH {TURNS}, {MEM},
n AS (SELECT student_id, 'topic:' || left(sha256(subject || '|{HIDDEN}'), 24) AS memory_key, '学生曾询问：{HIDDEN}' AS content, 0.8 AS confidence, created_at FROM t
UNION ALL SELECT student_id, 'difficulty:' || left(sha256('difficulty|' || subject || '|{HIDDEN}'), 24), '学生曾表示这个问题较难：{HIDDEN}', 0.75, created_at FROM t WHERE right(turn_id, 1) <> '3'
UNION ALL SELECT student_id, 'profile:grade', '学生当前按小学' || grade || '年级难度学习。', 1.0, created_at FROM t WHERE right(turn_id, 1) = '3' AND grade IS NOT NULL),
b AS (SELECT student_id, memory_key, confidence, created_at, updated_at, 0 AS new FROM me UNION ALL SELECT student_id, memory_key, confidence, created_at, created_at, 1 FROM n)
SELECT student_id, memory_key, min(created_at) AS created_at, coalesce(max(updated_at) FILTER (new = 1), max(updated_at)) AS updated_at FROM b GROUP BY ALL""")
def record_turn_memories(s, d):
    return _recorded(s, d)["memories"].select("student_id", "memory_key", "created_at", "updated_at")


@query("SELECT turn_id, thread_id, student_id, owner FROM (SELECT t.turn_id, t.thread_id, CASE WHEN right(turn_id, 1) = '7' THEN 'stu_other' ELSE student_id END AS student_id, c.owner FROM education_committed_turns t JOIN (SELECT thread_id, min(student_id) AS owner FROM education_conversations GROUP BY ALL) c USING (thread_id)) WHERE student_id <> owner")
def record_turn_refused(s, d):
    return _recorded(s, d)["refused"]


@query(f"""WITH {MEM}, ch AS (SELECT student_id, memory_key, max(updated_at) + INTERVAL 1 DAY AS moment FROM me WHERE memory_type = 'learning_difficulty' GROUP BY ALL),
b AS (SELECT student_id, memory_key, confidence, created_at, updated_at, 0 AS new FROM me UNION ALL SELECT student_id, memory_key, 0.5, moment, moment, 1 FROM ch)
SELECT student_id, memory_key, min(created_at) AS created_at, coalesce(max(updated_at) FILTER (new = 1), max(updated_at)) AS updated_at, bool_or(new = 1) AS changed FROM b GROUP BY ALL""")
def memory_upsert(s, d):
    held = table(s, d, "education_long_term_memories").distinct()
    at = F.max("updated_at") + F.expr("INTERVAL 1 DAY")
    changes = held.filter("memory_type = 'learning_difficulty'").groupBy("student_id", "memory_key").agg(F.min("memory_type").alias("memory_type"), F.min("subject").alias("subject"), at.alias("updated_at"))
    changes = changes.select("student_id", "memory_key", "memory_type", "subject", F.lit("changed").alias("content"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("source_thread_id"), F.col("updated_at").alias("created_at"), "updated_at")
    return memory.upsert_memories(held, changes).select("student_id", "memory_key", "created_at", "updated_at", F.coalesce(F.col("content") == "changed", F.lit(False)).alias("changed"))


@query(rf"""WITH {MEM}, c AS (SELECT source_thread_id AS turn_id, id AS pos, memory_type, subject, content, least(1.0, greatest(0.0, confidence)) AS sure, row_number() OVER (PARTITION BY source_thread_id ORDER BY id) AS n FROM me WHERE source_thread_id IS NOT NULL)
SELECT turn_id, pos, memory_type, sure AS confidence FROM c WHERE n <= 5 AND memory_type IN ('preference', 'learning_topic', 'learning_difficulty') AND length(trim(regexp_replace(content, '[\s\p{{Z}}]+', ' ', 'g'))) > 0 AND sure >= 0.6""")
def candidate_screen(s, d):
    rows = table(s, d, "education_long_term_memories").distinct().filter("source_thread_id IS NOT NULL")
    cands = rows.select(F.col("source_thread_id").alias("turn_id"), F.col("id").alias("pos"), F.col("subject").alias("turn_subject"), F.col("content").alias("question"), "memory_type", "subject", "content", "confidence")
    return memory.screen_candidates(cands).select("turn_id", "pos", "memory_type", "confidence")


