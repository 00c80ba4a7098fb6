"""Problem 2: rebuilding conversations from message rows.

Method: reply links. For every message the candidate parents are the messages
of the other speaker before it; each is scored by time, mention and lexical
overlap and the likeliest becomes the parent. Links form trees: a pupil's
message that follows up nothing is a root, and a tree is all that hangs on it.

Rows are sorted once by thread and order and read as a stream, so no step holds
a thread. A thread of many rows is cut into slots of time that are read by
different tasks; each slot begins with the few messages before it that its own
may reply to.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lodeline.llm.common import is_blank, small
from lodeline.sources.tables import ensure_checkpoint_dir

PUPIL = ["user", "pupil", "student", "human", "learner", "child", "学生", "學生", "用户", "用戶", "孩子", "小朋友"]
ASSISTANT = ["assistant", "ai", "bot", "tutor", "model", "chatbot", "gpt", "助教", "助手", "机器人", "機器人", "小助手"]
#: Weights of the link score: a mention, full lexical overlap (ENOUGH shared terms), no time between, and each message of the other speaker passed over. Chosen on talks of three threads merged into one.
MENTION, LEXICAL, NEAR, STEP, ENOUGH = 5.0, 5.0, 1.0, 0.5, 8
#: Candidates kept of each speaker. The nearest one scores at least 0 and one passed over so often at most 0, so that none further off can be the likeliest.
REACH = math.ceil((MENTION + LEXICAL + NEAR) / STEP)
#: Mention and overlap that make a pupil's message a follow-up.
FOLLOW = 3.5
#: Rows of a thread from which it is cut into slots, and rows aimed at for a slot.
SLOT_ROWS = 20_000
CJK = "\u3040-\u30ff\u3400-\u9fff"
WORDS = re.compile(rf"[^\W_{CJK}]{{3,}}|[{CJK}]+")
NAMES = re.compile(r"[@#＠]([\w\-]+)")


def speaker_of(role: Column) -> Column:
    """pupil or assistant, whatever the spelling of role; null for notices of neither, unknown and null roles."""
    name = F.lower(F.regexp_replace(role, r"[\s\p{Z}\p{Cf}]+", ""))
    return F.when(name.isin(PUPIL), "pupil").when(name.isin(ASSISTANT), "assistant")


def terms(text: str | None) -> frozenset[str]:
    """Words of three letters and more, and every pair of neighbouring CJK characters."""
    out: set[str] = set()
    for w in WORDS.findall((text or "").lower()):
        out.update(w[i : i + 2] for i in range(len(w) - 1)) if "\u3040" <= w[0] <= "\u9fff" else out.add(w)
    return frozenset(out)


def _micros(at: Column) -> Column:
    """Microseconds on the wall clock, whatever the session's time zone."""
    whole = F.unix_date(F.to_date(at)).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def dialogue_messages(messages: DataFrame) -> DataFrame:
    """Messages of pupil and assistant, each id once, with speaker, blank and microseconds.

    Copies of an id are reduced to the smallest of them by columns in order, whatever their spelling of role. Rows without thread_id are no part of a thread and are left out;
    rows without id are told apart by their other columns.
    """
    rows = messages.select("thread_id", "id", speaker_of(F.col("role")).alias("speaker"), "student_id", "content", "created_at").filter("speaker IS NOT NULL AND thread_id IS NOT NULL")
    key = F.coalesce(F.col("id"), F.xxhash64("thread_id", "speaker", "content", "created_at"))
    one = rows.groupBy(F.col("id").isNull().alias("_n"), key.alias("_k")).agg(F.min(F.struct(*rows.columns)).alias("m")).select("m.*")
    return one.withColumn("blank", is_blank(F.col("content"))).withColumn("us", _micros(F.col("created_at")))


class _Said:
    """A message as a candidate parent."""

    __slots__ = ("id", "names", "root", "student", "text", "us", "_terms")

    def __init__(self, id_: int | None, us: int, student: str | None, text: str | None) -> None:
        self.id, self.us, self.student, self.text, self._terms, self.root = id_, us, student, text, None, id_
        self.names = set(NAMES.findall(text)) if text and ("@" in text or "#" in text or "＠" in text) else ()

    @property
    def terms(self) -> frozenset[str]:
        if self._terms is None:
            self._terms = terms(self.text)
        return self._terms


def likeliest(said: _Said, candidates: deque[_Said]) -> tuple[_Said | None, float, float]:
    """The candidate with the highest score, ties to the nearest, with its score and how much of it is mention and overlap. Overlap is worked out only where it could decide."""
    best, top, proof = None, -math.inf, 0.0
    for passed, c in enumerate(reversed(candidates)):
        sure = MENTION if said.names and (c.student in said.names or str(c.id) in said.names) else 0.0
        rest = sure + NEAR * math.exp(-min(700.0, max(0, said.us - c.us) / 6e8)) - STEP * passed
        if rest + LEXICAL <= top:
            continue
        lexical = LEXICAL * min(1.0, math.log1p(len(said.terms & c.terms)) / math.log1p(ENOUGH))
        if rest + lexical > top:
            best, top, proof = c, rest + lexical, sure + lexical
    return best, top, proof


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None]]:
    held = None
    for b in batches:
        if len(b):
            if held is not None:
                yield held, b
            held = b
    if held is not None:
        yield held, None


KEPT = ("thread_id", "slot", "id", "speaker", "student_id", "content", "created_at", "blank")
FOUND = ("prev_id {id}", "prev_speaker string", "prev_content string", "next_speaker string", "next_blank boolean", "parent_id {id}", "parent_is_prev boolean", "link_score double", "root_id {id}", "root_here boolean")


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a stream of rows sorted by thread, slot, kind (0: said before the slot, 1: its own, 2: the next behind it), created_at and id."""
    key, prev = None, None
    seen: dict[str, deque[_Said]] = {}
    for b, then in _ahead(batches):
        thread, slot, kind, ids, who, student, text, us, blank = (b[c].to_pylist() for c in ("thread_id", "slot", "kind", "id", "speaker", "student_id", "content", "us", "blank"))
        behind = [*zip(thread[1:], slot[1:], who[1:], blank[1:], strict=True), (then["thread_id"][0].as_py(), then["slot"][0].as_py(), then["speaker"][0].as_py(), then["blank"][0].as_py()) if then is not None else (None,) * 4]
        rows = []
        for i, k in enumerate(kind):
            if (thread[i], slot[i]) != key:
                key, prev = (thread[i], slot[i]), None
                seen = {"pupil": deque(maxlen=REACH), "assistant": deque(maxlen=REACH)}
                here: set[int | None] = set()
            if us[i] is None:
                rows.append((None, None, None, None, None, None, False, None, ids[i], True))
                continue
            said = _Said(ids[i], us[i], student[i], text[i])
            if k == 1:
                best, score, proof = likeliest(said, seen["assistant" if who[i] == "pupil" else "pupil"])
                if best is not None and (who[i] == "assistant" or proof >= FOLLOW):
                    said.root = best.root
                    link = best.id, prev is not None and best is prev[0], score
                else:
                    link = None, False, None
                    here.add(ids[i])
                t, s, next_who, next_blank = behind[i]
                after = (next_who, next_blank) if (t, s) == key else (None, None)
                rows.append((*((prev[0].id, prev[1], prev[0].text) if prev else (None, None, None)), *after, *link, said.root, said.root in here))
            if k < 2:
                seen[who[i]].append(said)
                prev = said, who[i]
        mine = b.filter(pa.array([k == 1 for k in kind]))
        types = {"{id}": b.schema.field("id").type, "string": b.schema.field("content").type, "boolean": pa.bool_(), "double": pa.float64()}
        columns = zip(*rows, strict=True) if rows else [()] * len(FOUND)
        arrays = [pa.array(col, types[f.split()[1]]) for col, f in zip(columns, FOUND, strict=True)]
        yield pa.RecordBatch.from_arrays([*(mine[c] for c in KEPT), *arrays], names=[*KEPT, *(f.split()[0] for f in FOUND)])


def _slotted(rows: DataFrame, messages: DataFrame, slot_rows: int) -> tuple[DataFrame, bool]:
    """Rows with slot and kind, and whether any thread is cut. What a slot needs from outside is added to it as rows of kind 0 and 2."""
    big = messages.filter("thread_id IS NOT NULL AND created_at IS NOT NULL").groupBy("thread_id").agg(F.count(F.lit(1)).alias("many"), F.min("created_at").alias("lo"), F.max("created_at").alias("hi")).filter(F.col("many") > slot_rows)
    big, some = small(big.select("thread_id", "many", _micros(F.col("lo")).alias("lo"), _micros(F.col("hi")).alias("hi")))
    if not some:
        return rows.withColumn("slot", F.lit(0).cast("long")).withColumn("kind", F.lit(1)), False
    width = F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo") + 1) * (slot_rows / 4.0) / F.col("many"))
    placed = rows.join(big, "thread_id", "left").withColumn("slot", F.coalesce(F.floor((F.col("us") - F.col("lo")) / width), F.lit(0)).cast("long"))
    hot = placed.filter("many IS NOT NULL AND us IS NOT NULL").drop("many", "lo", "hi")
    placed = placed.drop("many", "lo", "hi").withColumn("kind", F.lit(1))
    slots = hot.select("thread_id", "slot").distinct().withColumn("pos", F.row_number().over(W.partitionBy("thread_id").orderBy("slot")))
    at = F.struct("us", "id")
    ends = hot.withColumn("back", F.row_number().over(W.partitionBy("thread_id", "slot", "speaker").orderBy(F.desc("us"), F.desc("id")))).filter(F.col("back") <= REACH).drop("back").join(slots, ["thread_id", "slot"])
    until = F.coalesce(F.lead("pos", REACH).over(W.partitionBy("thread_id", "speaker").orderBy("us", "id")), F.max("pos").over(W.partitionBy("thread_id")))
    before = ends.withColumn("until", until).filter("until > pos").withColumn("pos", F.explode(F.sequence(F.col("pos") + 1, F.col("until")))).drop("slot", "until").join(slots, ["thread_id", "pos"]).withColumn("kind", F.lit(0))
    first = hot.groupBy("thread_id", "slot").agg(F.min_by(F.struct(*rows.columns), at).alias("m")).join(slots, ["thread_id", "slot"]).select("m.*", (F.col("pos") - 1).alias("pos"))
    after = first.join(slots, ["thread_id", "pos"]).withColumn("kind", F.lit(2))
    cols = placed.columns
    return placed.unionByName(before.select(*cols)).unionByName(after.select(*cols)), True


def _rooted(links: DataFrame) -> DataFrame:
    """Roots of trees that began in an earlier slot: the few messages that slots refer to are followed back by pointer jumping, in as many rounds as the logarithm of the slots a tree spans."""
    ensure_checkpoint_dir(links.sparkSession)
    links = links.checkpoint()
    open_ = links.filter("NOT root_here").select("thread_id", F.col("root_id").alias("id")).distinct()
    hops = links.join(open_, ["thread_id", "id"], "left_semi").select("thread_id", "id", F.col("root_id").alias("up"), F.col("root_here").alias("done")).checkpoint()
    while not hops.filter("NOT done").isEmpty():
        over = hops.select("thread_id", F.col("id").alias("up"), F.col("up").alias("next"), F.col("done").alias("known"))
        hops = hops.join(over, ["thread_id", "up"], "left").select("thread_id", "id", F.when(F.col("done"), F.col("up")).otherwise(F.col("next")).alias("up"), (F.col("done") | F.col("known")).alias("done")).checkpoint()
    roots = hops.select("thread_id", F.col("id").alias("root_id"), F.col("up").alias("first_id"))
    return links.join(roots, ["thread_id", "root_id"], "left").withColumn("root_id", F.when(F.col("root_here"), F.col("root_id")).otherwise(F.col("first_id"))).select(*links.columns)


def linked(messages: DataFrame, slot_rows: int = SLOT_ROWS, roots: bool = False) -> DataFrame:
    """One row for each dialogue message with its place and its reply link.

    Columns: thread_id, slot, id, speaker, student_id, content, created_at, blank, prev_id, prev_speaker, prev_content, next_speaker, next_blank, parent_id, parent_is_prev, link_score, root_id, root_here. Order is
    created_at, then id; a message without created_at has no neighbours and no parent. The score of a candidate is 5 for a mention (@ or # with its student_id or id) + five times the lexical overlap (logarithm of
    shared terms, full at 8) + exp(-seconds / 600) - 0.5 for each message of the other speaker between; ties go to the nearest. An assistant message takes the likeliest pupil's message as its parent, a pupil's message
    the likeliest assistant message if mention and overlap reach FOLLOW; without a parent it is a root. root_id is the root of the tree; where a thread is cut into slots and root_here is false
    it is the message of an earlier slot that the tree goes on from, unless `roots` is asked for, which follows it to its root and uses checkpoint(). Threads of more than slot_rows rows are cut into slots.
    """
    rows = dialogue_messages(messages)
    slotted, cut = _slotted(rows, messages, slot_rows)
    kinds = rows.schema
    schema = T.StructType([T.StructField("thread_id", kinds["thread_id"].dataType), T.StructField("slot", T.LongType()), *(kinds[c] for c in KEPT[2:])] + T._parse_datatype_string(", ".join(FOUND).format(id=kinds["id"].dataType.simpleString())).fields)
    links = slotted.repartition("thread_id", "slot").sortWithinPartitions("thread_id", "slot", "kind", "created_at", "id").mapInArrow(_follow, schema)
    return _rooted(links) if cut and roots else links


def thread_defects(links: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """thread_id, defect: one row for each thread and defect (`empty` alone, else `broken`, `no_reply`).

    `links` is the result of `linked`. An assistant message is in place if its link leads to the message directly before it; where the likeliest parent is another, the place decides: whether the message before is a
    pupil's. A pupil's message is answered if a non-blank assistant message comes directly behind it. Threads are those of either table, null thread_id excepted.
    """
    adrift = (F.col("speaker") == "assistant") & ~(F.col("parent_is_prev") | F.coalesce(F.col("prev_speaker") == "pupil", F.lit(False)))
    silent = (F.col("speaker") == "pupil") & F.col("created_at").isNotNull() & ~F.coalesce((F.col("next_speaker") == "assistant") & ~F.col("next_blank"), F.lit(False))
    verdict = links.groupBy("thread_id").agg(
        F.bool_or(~F.col("blank")).alias("said"), F.bool_or(F.col("created_at").isNull() | adrift).alias("broken"), F.bool_or(silent).alias("no_reply"),
    )
    known = conversations.select("thread_id", F.lit(True).alias("known"), F.lit(False).alias("used"))
    used = messages.select("thread_id", F.lit(False).alias("known"), F.lit(True).alias("used"))
    threads = known.unionByName(used).filter("thread_id IS NOT NULL").groupBy("thread_id").agg(F.bool_or("known").alias("known"))
    rows = threads.join(verdict, "thread_id", "left").select(
        "thread_id",
        F.when(~F.coalesce("said", F.lit(False)), F.array(F.lit("empty"))).otherwise(
            F.array_compact(F.array(F.when(F.col("broken") | ~F.col("known"), F.lit("broken")), F.when(F.col("no_reply"), F.lit("no_reply"))))
        ).alias("defects"),
    )
    return rows.select("thread_id", F.explode("defects").alias("defect"))


def conversations_of(messages: DataFrame, conversations: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """The messages of whole threads in order: thread_id, created_at, id, speaker, content, parent_id, root_id; threads with any defect are left out.

    (created_at, id) is the order; it is given as columns, and not numbered, as a thread may be of any length. root_id names the tree, a pupil's question with its replies and follow-ups. Blank assistant
    messages make a thread `no_reply`, so none is left.
    """
    links = linked(messages, slot_rows, roots=True)
    return links.join(thread_defects(links, messages, conversations).select("thread_id").distinct(), "thread_id", "left_anti").select(
        "thread_id", "created_at", "id", "speaker", "content", "parent_id", "root_id"
    )
