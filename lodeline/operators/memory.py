"""Conversation and memory store as snapshot tables: upserts, idempotent turns, pruning, ranking, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodeline.functions.keys import agent_key, difficulty_key, topic_key
from lodeline.functions.text import DIFFICULTY, PREFERENCES, bigram_set, hide_stored, one_line
from lodeline.operators.search import GENERAL

#: What stored memories of topics and difficulties begin with, and that of the grade.
ASKED, FOUND_HARD = "学生曾询问：", "学生曾表示这个问题较难："
GRADE_START, GRADE_END = "学生当前按小学", "年级难度学习。"
#: Rank of the kinds of memory.
KIND_SCORE = {"profile": 12.0, "preference": 10.0, "learning_difficulty": 5.0, "learning_topic": 1.0}


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def upsert(snapshot: DataFrame, changes: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """A new snapshot: of each key the last change by `order`, else the row there was. `changes` may have columns in any order."""
    last = newest(changes, keys, [order.desc()])
    return snapshot.join(last.select(*keys).distinct(), keys, "left_anti").unionByName(last.select(*snapshot.columns))


def upsert_conversations(snapshot: DataFrame, turns: DataFrame) -> DataFrame:
    """Conversations after turns (thread_id, student_id, title, subject, grade, created_at): the title is the first there ever was, the subject the last, the grade the last known, updated_at the last time."""
    both = snapshot.select("thread_id", "student_id", "title", "subject", "grade", F.col("created_at"), F.col("updated_at").alias("at"), F.lit(0).alias("new")).unionByName(
        turns.select("thread_id", "student_id", "title", "subject", "grade", "created_at", F.col("created_at").alias("at"), F.lit(1).alias("new"))
    )
    when = F.struct("new", "at", "title", "subject")
    return both.groupBy("thread_id").agg(
        F.min_by("student_id", when).alias("student_id"), F.min_by("title", when).alias("title"), F.max_by("subject", when).alias("subject"),
        F.max_by("grade", F.when(F.col("grade").isNotNull(), when)).alias("grade"), F.min("created_at").alias("created_at"), F.max("at").alias("updated_at"),
    )


def upsert_memories(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """Memories (student_id, memory_key, memory_type, subject, content, confidence, source_thread_id, created_at, updated_at) after changes of the same columns: of each student's key the last change by updated_at, with the first created_at there was."""
    cols = ["student_id", "memory_key", "memory_type", "subject", "content", "confidence", "source_thread_id", "created_at", "updated_at"]
    both = snapshot.select(*cols, F.lit(0).alias("new")).unionByName(changes.select(*cols, F.lit(1).alias("new")))
    order = F.struct("new", "updated_at", *cols[2:7])
    last = both.groupBy("student_id", "memory_key").agg(F.max_by(F.struct("memory_type", "subject", "content", "confidence", "source_thread_id", "updated_at"), order).alias("m"), F.min("created_at").alias("created_at"))
    return last.select("student_id", "memory_key", "m.memory_type", "m.subject", "m.content", "m.confidence", "m.source_thread_id", "created_at", "m.updated_at")


def history(messages: DataFrame) -> DataFrame:
    """(thread_id, pos, id, speaker, content): the messages of each thread in the order of their ids, numbered from 1."""
    return messages.select("thread_id", F.row_number().over(W.partitionBy("thread_id").orderBy("id")).cast("bigint").alias("pos"), "id", "speaker", "content")


def recent_memories(memories: DataFrame, n: int = 50) -> DataFrame:
    """The newest n memories of each student."""
    return newest(memories, ["student_id"], [F.col("updated_at").desc_nulls_last(), F.col("id").desc()], n)


def first_commits(turns: DataFrame) -> DataFrame:
    """Each turn_id once, at its first time: later deliveries change nothing."""
    return newest(turns, ["turn_id"], [F.col("created_at").asc_nulls_last(), F.col("thread_id"), F.col("student_id")])


def owner_conflicts(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Turns that name a thread of another student; unknown threads pass."""
    owner = conversations.groupBy("thread_id").agg(F.min("student_id").alias("owner"))
    return turns.join(owner, "thread_id").filter("student_id <> owner").select("turn_id", "thread_id", "student_id", "owner")


def turn_messages(turns: DataFrame) -> DataFrame:
    """Two stored messages for each turn (turn_id, thread_id, question, answer, created_at), with contact data hidden and the order as a column."""
    said = F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), hide_stored(F.col("question")).alias("content")),
        F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), hide_stored(F.col("answer")).alias("content")),
    ))
    return turns.select("turn_id", "thread_id", "created_at", said.alias("m")).select("turn_id", "thread_id", "created_at", "m.part", "m.role", "m.content")


def extract_memories(questions: DataFrame) -> DataFrame:
    """Memories of questions (student_id, thread_id, subject, question): kind, key, subject, content and confidence for topics, stated preferences and difficulties."""
    short = one_line(hide_stored(F.col("question")), 180, "…")
    kind = "memory_type string, memory_key string, memory_subject string, content string, confidence double"
    fields = [f.split()[0] for f in kind.split(", ")]

    def row(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, fields, strict=True)])

    found = [row(F.lit("learning_topic"), topic_key(F.col("subject"), short), F.col("subject"), F.concat(F.lit(ASKED), short), F.lit(0.8))]
    for key, words, statement in PREFERENCES:
        found.append(F.when(F.col("question").rlike("|".join(words)), row(F.lit("preference"), F.lit(key), F.lit(GENERAL), F.lit(statement), F.lit(0.9))))
    found.append(F.when(F.col("question").rlike(DIFFICULTY), row(F.lit("learning_difficulty"), difficulty_key(F.col("subject"), short), F.col("subject"), F.concat(F.lit(FOUND_HARD), short), F.lit(0.75))))
    return questions.select("student_id", "thread_id", F.explode(F.array_compact(F.array(*found))).alias("m")).select("student_id", "thread_id", "m.*")


def core_memories(turns: DataFrame) -> DataFrame:
    """Memories any turn (turn_id, subject, grade, question) leaves: the topic, and the grade where it is known."""
    short = one_line(hide_stored(F.col("question")), 180, "…")
    row = lambda kind, key, subject, content, sure: F.struct(F.lit(kind).alias("memory_type"), key.alias("memory_key"), subject.alias("memory_subject"), content.alias("content"), F.lit(sure).alias("confidence"))
    grade = F.when(F.col("grade").isNotNull(), row("profile", F.lit("profile:grade"), F.lit(GENERAL), F.concat(F.lit(GRADE_START), F.col("grade").cast("string"), F.lit(GRADE_END)), 1.0))
    topic = row("learning_topic", topic_key(F.col("subject"), short), F.col("subject"), F.concat(F.lit(ASKED), short), 0.8)
    return turns.select("turn_id", F.explode(F.array_compact(F.array(grade, topic))).alias("m")).select("turn_id", "m.*")


def turn_memories(turns: DataFrame, candidates: DataFrame) -> DataFrame:
    """Memories of turns (turn_id, student_id, thread_id, subject, grade, question, proposed): with `proposed` null they are read off the question, else, even if nothing was proposed, they are the core ones and the candidates that pass."""
    open_, given = turns.filter("proposed IS NULL"), turns.filter("proposed IS NOT NULL")
    read = extract_memories(open_.select(F.col("turn_id").alias("student_id"), "thread_id", "subject", "question")).select(F.col("student_id").alias("turn_id"), "memory_type", "memory_key", "memory_subject", "content", "confidence")
    wanted = candidates.join(given.select("turn_id", F.col("subject").alias("turn_subject"), "question"), "turn_id")
    passed = screen_candidates(wanted).select("turn_id", "memory_type", "memory_key", F.col("subject").alias("memory_subject"), "content", "confidence")
    return read.unionByName(core_memories(given)).unionByName(passed)


def record_turns(turns: DataFrame, conversations: DataFrame, messages: DataFrame, committed: DataFrame, memories: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """The four tables after a batch of turns (turn_id, thread_id, student_id, title, subject, grade, question, answer, created_at, proposed), and `refused`.

    A turn of a thread that another student owns is refused; one whose turn_id was committed before, or comes again in the batch, changes nothing. Questions and answers are stored with contact data hidden, two messages
    a turn. Conversations keep their first title, memories their first created_at. All tables are planned from the same accepted turns, to be written as one commit.
    """
    refused = owner_conflicts(turns, conversations)
    fresh = first_commits(turns.join(refused.select("turn_id", "thread_id", "student_id"), ["turn_id", "thread_id", "student_id"], "left_anti")).join(committed.select("turn_id").distinct(), "turn_id", "left_anti")
    new = turn_memories(fresh, candidates).join(fresh.select("turn_id", "student_id", "thread_id", "created_at"), "turn_id").select(
        "student_id", "memory_key", "memory_type", F.col("memory_subject").alias("subject"), "content", "confidence", F.col("thread_id").alias("source_thread_id"), "created_at", F.col("created_at").alias("updated_at")
    )
    said = turn_messages(fresh)
    return {
        "refused": refused, "conversations": upsert_conversations(conversations, fresh), "turns": committed.select("turn_id", "thread_id", "student_id", "created_at").unionByName(fresh.select("turn_id", "thread_id", "student_id", "created_at")),
        "messages": messages.select("thread_id", "role", "content", "created_at").unionByName(said.select("thread_id", "role", "content", "created_at")), "memories": upsert_memories(memories, new),
    }


def screen_candidates(candidates: DataFrame, at_most: int = 5, least: float = 0.6) -> DataFrame:
    """Proposed memories that may be kept: the first five by pos for each turn_id, of a known kind, with content and a clamped confidence of at least 0.6; free profiles are dropped.

    `candidates`: turn_id, pos, turn_subject, question, memory_type, subject, content, confidence (text or number).
    """
    first = newest(candidates, ["turn_id"], [F.col("pos").asc()], at_most)
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.expr("try_cast(confidence AS double)")))
    own = F.col("turn_subject")
    topic, hard = F.col("memory_type") == "learning_topic", F.col("memory_type") == "learning_difficulty"
    short = one_line(hide_stored(F.col("question")), 180, "…")
    subject = F.when(topic | hard, own).when(F.coalesce("subject", F.lit(GENERAL)).isin(GENERAL) | (F.col("subject") == own), F.coalesce("subject", F.lit(GENERAL))).otherwise(own)
    content = one_line(hide_stored(F.col("content")), 180, "…")
    return (
        first.withColumn("kept_subject", subject).withColumn("said", content).withColumn("sure", sure)
        .filter(F.col("memory_type").isin("preference", "learning_topic", "learning_difficulty") & (F.length("said") > 0) & (F.col("sure") >= least))
        .select(
            "turn_id", "pos", "memory_type",
            F.when(topic, topic_key(own, short)).when(hard, difficulty_key(own, short)).otherwise(agent_key(F.col("memory_type"), F.col("kept_subject"), F.col("said"))).alias("memory_key"),
            F.col("kept_subject").alias("subject"),
            F.when(topic, F.concat(F.lit(ASKED), short)).when(hard, F.concat(F.lit(FOUND_HARD), short)).otherwise(F.col("said")).alias("content"),
            F.col("sure").alias("confidence"),
        )
    )


def prune_topics(memories: DataFrame, keep: int = 200) -> DataFrame:
    """Memories without the topics beyond the newest `keep` of each student (by updated_at, then id)."""
    topics = newest(memories.filter("memory_type = 'learning_topic'"), ["student_id"], [F.col("updated_at").desc_nulls_last(), F.col("id").desc()], keep)
    return memories.filter("memory_type IS NULL OR memory_type <> 'learning_topic'").unionByName(topics)


def rank_memories(queries: DataFrame, memories: DataFrame, k: int = 5, recent: int = 200) -> DataFrame:
    """The k most relevant memories for each query (query_id, student_id, subject, question).

    Visible are memories of the same subject, of none in particular, profiles and preferences; of these the newest 200 are scored by kind, subject, shared
    bigrams and recency. Ties go to the newer one. Result: query_id, id, score (6 decimals), rank.
    """
    # memories any query of a student and subject can see, the newest `recent` only, before they meet the queries
    everywhere = (F.col("subject") == GENERAL) | F.coalesce(F.col("memory_type").isin("profile", "preference"), F.lit(False))
    asked_subjects = queries.select("student_id", F.col("subject").alias("asked")).distinct()
    held = memories.select("id", "student_id", "memory_type", "subject", "content", "updated_at")
    order_by = [F.col("updated_at").desc_nulls_last(), F.col("id").desc()]
    own = newest(held.filter(~F.coalesce(everywhere, F.lit(False))), ["student_id", "subject"], order_by, recent)
    shared = newest(held.filter(everywhere), ["student_id"], order_by, recent)
    visible = asked_subjects.join(own, "student_id").filter(F.col("subject") == F.col("asked")).unionByName(asked_subjects.join(shared, "student_id"))
    by = W.partitionBy("student_id", "asked").orderBy(*order_by)
    visible = visible.withColumn("recency", F.row_number().over(by) - 1).filter(F.col("recency") < recent)
    seen = queries.select("query_id", "student_id", F.col("subject").alias("asked"), "question").join(visible, ["student_id", "asked"])
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in KIND_SCORE.items() for x in p])[F.col("memory_type")], F.lit(0.0))
    asked = bigram_set(F.col("question"))
    overlap = F.size(F.array_intersect(asked, bigram_set(F.col("content")))) / F.greatest(F.size(asked), F.lit(1))
    score = kind + F.when(F.col("subject") == F.col("asked"), 2.0).otherwise(0.0) + 8.0 * F.coalesce(overlap, F.lit(0.0)) + F.greatest(F.lit(0.0), 1.0 - F.col("recency") * 0.01)
    scored = seen.withColumn("score", F.round(score, 6))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("recency"))
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def forget_conversation(thread_id: str, student_id: str, conversations: DataFrame, messages: DataFrame, turns: DataFrame, memories: DataFrame) -> dict[str, DataFrame]:
    """`forget_threads` of one thread; raises ValueError unless the student owns it."""
    if conversations.filter((F.col("thread_id") == thread_id) & (F.col("student_id") == student_id)).isEmpty():
        raise ValueError("no such conversation of this student")
    return forget_threads(conversations.filter(F.col("thread_id") == thread_id).select("thread_id"), conversations, messages, turns, memories)


def forget_students(students: DataFrame, conversations: DataFrame, messages: DataFrame, turns: DataFrame, memories: DataFrame) -> dict[str, DataFrame]:
    """The four tables without all that the given students own, and `threads`, the ids of their conversations."""
    gone = students.select("student_id").distinct()
    threads = conversations.join(gone, "student_id", "left_semi").select("thread_id").distinct()
    return {
        "threads": threads, "conversations": conversations.join(gone, "student_id", "left_anti"), "messages": messages.join(threads, "thread_id", "left_anti"),
        "turns": turns.join(threads, "thread_id", "left_anti").join(gone, "student_id", "left_anti"), "memories": memories.join(gone, "student_id", "left_anti"),
    }


def forget_threads(threads: DataFrame, conversations: DataFrame, messages: DataFrame, turns: DataFrame, memories: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the given threads; topics and difficulties learned from them go too, preferences stay."""
    gone = threads.select("thread_id").distinct()
    linked = gone.withColumnRenamed("thread_id", "source_thread_id").withColumn("memory_type", F.explode(F.array(F.lit("learning_topic"), F.lit("learning_difficulty"))))
    return {
        "conversations": conversations.join(gone, "thread_id", "left_anti"), "messages": messages.join(gone, "thread_id", "left_anti"),
        "turns": turns.join(gone, "thread_id", "left_anti"), "memories": memories.join(linked, ["source_thread_id", "memory_type"], "left_anti"),
    }
