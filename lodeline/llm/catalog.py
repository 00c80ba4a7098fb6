"""Queries of this subpackage and, where SQL can express them, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import dialogue, mixing, neighbours, packing, pairs, pii, sentences, splitting
from lodeline.llm.common import declared, is_blank
from lodeline.sources.tables import parallelism, table

Query = Callable[[SparkSession, str], DataFrame]


def _limits(spark: SparkSession, d: str) -> dict[str, tuple[int, int]]:
    """split_limits holds one declared row for each table."""
    return {name: (most, shared) for name, most, shared in declared(table(spark, d, "split_limits"), "table_name", "max_chars", "overlap_chars")}


SPLIT = {"education_vector_chunks": ("collection_name", "document"), "lexical_documents": ("namespace", "text")}


def _p1(spark: SparkSession, d: str, op: Callable[..., DataFrame]) -> DataFrame:
    out = None
    limits = _limits(spark, d)
    for name, (scope, text) in SPLIT.items():
        most, overlap = limits[name]
        part = op(table(spark, d, name), text, [scope, "chunk_id"], most, overlap).withColumnRenamed(scope, "scope").withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d, splitting.cut_kinds).select("table_name", "scope", "chunk_id", "cut_kind")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = _p1(spark, d, lambda df, text, keys, *a: splitting.split_oversized(df.select(*keys, text).distinct(), text, keys, *a))
    return rows.select("table_name", "scope", "chunk_id", "piece_no", "start_pos", "end_pos", "shared_chars", "cut_kind", "piece")


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every text put together again from its pieces, against the text itself; `within` says that no piece is longer than allowed."""
    limits = _limits(spark, d)

    def op(df: DataFrame, text: str, keys: list[str], most: int, overlap: int) -> DataFrame:
        rows = df.select(*keys, text, F.sha2(text, 256).alias("of")).distinct()
        return splitting.rebuilt(splitting.split_oversized(rows, text, [*keys, "of"], most, overlap), [*keys, "of"])

    longest = F.coalesce(*[F.when(F.col("table_name") == name, most) for name, (most, _) in limits.items()])
    return _p1(spark, d, op).select("table_name", "scope", "chunk_id", "chars", "sha256", (F.col("longest") <= longest).alias("within"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "education_messages")
    return dialogue.thread_defects(dialogue.linked(messages), messages, table(spark, d, "education_conversations"))


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.conversations_of(table(spark, d, "education_messages"), table(spark, d, "education_conversations")).select(
        "thread_id", "created_at", "id", "speaker", "content", "parent_id", "root_id"
    )


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "education_vector_chunks")
    return neighbours.nearest_vectors(chunks, "collection_name", "chunk_id", "embedding").withColumnRenamed("scope", "collection_name")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "education_vector_chunks")
    near = neighbours.nearest_vectors(chunks, "collection_name", "chunk_id", "embedding", min_cosine=0.9)
    pair = [F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")]
    return near.select(F.col("scope").alias("collection_name"), *pair).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "education_messages").select("id", "content").repartition(parallelism(spark))
    return pii.find_pii(rows, "content", ["id"]).select("id", "pii_type", "pii_text").distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "education_messages").select("id", "content").repartition(parallelism(spark))
    return pii.redact(rows, "content").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    links = dialogue.linked(table(spark, d, "education_messages")).filter("speaker = 'assistant' AND prev_speaker = 'pupil'")
    links = links.filter(~is_blank(F.col("prev_content")))  # a blank message is no question
    return pairs.pair_defects(links.select(F.col("id").alias("reply_id"), "prev_content", "content"), "prev_content", "content", ["reply_id"])


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = table(spark, d, "container_sizes")
    docs = table(spark, d, "documents").select("doc_id", packing.token_size(F.col("text")).alias("size"))
    return packing.pack(docs, "doc_id", F.col("size"), sizes), sizes


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0].filter("parts > 1").select("capacity_id", "doc_id").distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0]


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(*_packed(spark, d))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """The packing held against what SQL can say of it: nothing is lost, no container is overfull."""
    return packing.overfull(*_packed(spark, d))


def _mix(spark: SparkSession, d: str, op: Callable[..., DataFrame]) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", packing.token_size(F.col("text")).alias("size"), mixing.quality_weight(F.col("text")).alias("weight"))
    return op(docs, table(spark, d, "mix_plans"), table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, mixing.unreached)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, mixing.mix)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, mixing.mix_report)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"), partitions=parallelism(spark))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p1_rebuilt, p2_found, p2_conversations, p3_found, p3_neighbours, p4_found, p4_redacted, p5_found, p6_found, p6_containers, p6_fill, p6_checked, p7_found, p7_mix, p7_report, p8_found)
}

_P1 = """SELECT DISTINCT '{name}' AS table_name, {scope} AS scope, chunk_id,
CASE WHEN regexp_matches({text}, '[^\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{P}}\\p{{Z}}]{{{most}}}') THEN 'hard' ELSE 'soft' END AS cut_kind
FROM {name}, (SELECT max_chars FROM split_limits WHERE table_name = '{name}') WHERE length({text}) > max_chars"""

_DIALOGUE = r"""
m AS (SELECT DISTINCT id, thread_id, content, created_at,
  CASE WHEN lower(regexp_replace(role, '\s', '', 'g')) IN ('user','pupil','student','human','学生') THEN 'pupil'
       WHEN lower(regexp_replace(role, '\s', '', 'g')) IN ('assistant','ai','bot','tutor','model','助教') THEN 'assistant' END AS speaker
  FROM education_messages),
dm AS (SELECT *, content IS NULL OR regexp_full_match(content, '[\s\p{Z}\p{Cc}\x{AD}\x{34F}\x{61C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}]*') AS blank FROM m WHERE speaker IS NOT NULL),
o AS (SELECT *, lag(speaker) OVER w AS prev_speaker, lag(content) OVER w AS prev_content, lead(speaker) OVER w AS next_speaker, lead(blank) OVER w AS next_blank
  FROM dm WHERE created_at IS NOT NULL WINDOW w AS (PARTITION BY thread_id ORDER BY created_at, id))"""

ORACLE: dict[str, str] = {
    "p1_found": _P1.format(name="education_vector_chunks", scope="collection_name", text="document", most=501) + " UNION ALL " + _P1.format(name="lexical_documents", scope="namespace", text="text", most=601),
    "p1_rebuilt": " UNION ALL ".join(
        f"SELECT DISTINCT '{name}' AS table_name, {scope} AS scope, chunk_id, length({text}) AS chars, sha256({text}) AS sha256, true AS within FROM {name} WHERE {text} IS NOT NULL" for name, (scope, text) in SPLIT.items()
    ),
    "p2_found": "WITH " + _DIALOGUE + """,
t AS (SELECT thread_id FROM education_conversations UNION SELECT thread_id FROM education_messages),
e AS (SELECT thread_id FROM t WHERE thread_id NOT IN (SELECT thread_id FROM dm WHERE NOT blank))
SELECT thread_id, 'empty' AS defect FROM e
UNION SELECT thread_id, 'broken' FROM t WHERE thread_id NOT IN (FROM e) AND (thread_id NOT IN (SELECT thread_id FROM education_conversations)
  OR thread_id IN (SELECT thread_id FROM dm WHERE created_at IS NULL) OR thread_id IN (SELECT thread_id FROM o WHERE speaker = 'assistant' AND prev_speaker IS DISTINCT FROM 'pupil'))
UNION SELECT thread_id, 'no_reply' FROM o WHERE thread_id NOT IN (FROM e) AND speaker = 'pupil' AND NOT coalesce(next_speaker = 'assistant' AND NOT next_blank, false)""",
    "p3_found": """WITH v AS (SELECT DISTINCT collection_name, chunk_id, embedding::DOUBLE[] AS e FROM education_vector_chunks
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.collection_name, a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.collection_name = b.collection_name AND a.chunk_id <> b.chunk_id),
t AS (SELECT *, row_number() OVER (PARTITION BY collection_name, a ORDER BY round(c, 12) DESC, b) AS n FROM s)
SELECT DISTINCT collection_name, least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM t WHERE n <= 5 AND c >= 0.9""",
    "p6_found": "SELECT capacity_id, doc_id FROM documents, container_sizes WHERE strlen(text) > capacity_tokens",
    "p6_checked": """SELECT capacity_id, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS tokens, CAST(sum(greatest(1, ceil(coalesce(strlen(text), 0) / capacity_tokens))) AS BIGINT) AS parts,
0 AS excess, count(DISTINCT doc_id) AS docs, 0 AS torn FROM (SELECT DISTINCT * FROM container_sizes), documents GROUP BY capacity_id""",
    "p7_found": """WITH t AS (SELECT source, sum(strlen(text))::HUGEINT AS tokens FROM documents WHERE source IS NOT NULL GROUP BY source),
l AS (SELECT g.mix_id, g.source, g.target_bp, g.max_repeats, p.size_pct, coalesce(t.tokens, 0) AS tokens FROM mix_targets g JOIN mix_plans p USING (mix_id) LEFT JOIN t USING (source)),
w AS (SELECT *, sum(tokens) OVER (PARTITION BY mix_id) AS whole FROM l)
SELECT mix_id, source FROM w WHERE max_repeats * tokens * 1000000 < target_bp * size_pct * whole""",
}
