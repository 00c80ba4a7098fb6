import math
import random
from collections import deque

from pyspark.sql import functions as F

from lodeline.llm import dialogue

SCHEMA = "id long, thread_id string, student_id string, role string, content string, created_at timestamp_ntz"


def messages(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(i, t, s, r, c, None if at is None else datetime(2026, 1, 1 + at // 1440, at // 60 % 24, at % 60)) for i, t, s, r, c, at in rows], SCHEMA)


def conversations(spark, *threads):
    return spark.createDataFrame([(t,) for t in threads], "thread_id string")


def defects(m, c):
    return sorted(map(tuple, dialogue.thread_defects(dialogue.linked(m), m, c).collect()))


def test_kinds_of_defect(spark):
    rows = [
        (1, "ok", "s", " User ", "q", 0), (2, "ok", "s", "tool", "notice", 1), (3, "ok", "s", "BOT", "a", 100), (3, "ok", "s", "bot", "a", 100),
        (4, "blank", "s", "user", " 　​", 0), (5, "blank", "s", "assistant", None, 1),
        (6, "late", "s", "user", "q", None), (7, "late", "s", "assistant", "a", 5),
        (8, "mute", "s", "user", "q", 0), (9, "mute", "s", "assistant", " ", 0), (10, "mute", "s", "user", "q2", 1), (11, "mute", "s", "ai", "a", 1),
        (12, "unknown", "s", "user", "q", 0), (13, "unknown", "s", "model", "a", 0),
        (14, "twice", "s", "user", "q", 0), (15, "twice", "s", "assistant", "a", 0), (16, "twice", "s", "assistant", "b", 70),
        (17, None, "s", "user", "q", 0), (18, "odd", "s", "visitor", "q", 0),
    ]
    got = defects(messages(spark, rows), conversations(spark, "ok", "blank", "late", "mute", "twice", "bare", "bare", None))
    assert got == [("bare", "empty"), ("blank", "empty"), ("late", "broken"), ("mute", "no_reply"), ("odd", "empty"), ("twice", "broken"), ("unknown", "broken")]


def test_empty_tables(spark):
    m = messages(spark, [])
    assert defects(m, conversations(spark)) == [] and defects(m, conversations(spark, "t")) == [("t", "empty")]
    assert dialogue.conversations_of(m, conversations(spark, "t")).count() == 0


def test_neighbours_across_hours_like_brute_force(spark):
    pick = random.Random(4)
    rows = [(i, pick.choice("ab"), "s", pick.choice(["user", "assistant"]), pick.choice(["x", "", "y"]), pick.randrange(2000)) for i in range(400)]
    got = {r.id: (r.prev_id, r.prev_content, r.next_speaker, r.next_blank) for r in dialogue.linked(messages(spark, rows)).collect()}
    for t in "ab":
        order = sorted((r for r in rows if r[1] == t), key=lambda r: (r[5], r[0]))
        for k, r in enumerate(order):
            before, after = order[k - 1] if k else None, order[k + 1] if k + 1 < len(order) else None
            name = {"user": "pupil", "assistant": "assistant"}
            assert got[r[0]] == (before and before[0], before and before[4], after and name[after[3]], None if after is None else after[4] == "")


def test_links_choose_by_words_and_mention(spark):
    rows = [
        (1, "t", "anna", "user", "why does the puddle vanish", 0), (2, "t", "ben", "user", "how long is a river", 0),
        (3, "t", "x", "assistant", "the puddle turns to vapour, puddle water vanish", 1), (4, "t", "x", "assistant", "@ben look at the blue map", 2),
        (5, "t", "x", "assistant", "@anna it dries", 90), (6, "t", "ben", "user", "where is the river on the blue map I look at", 400), (7, "t", "x", "assistant", "the blue one", 401),
    ]
    got = {r.id: (r.parent_id, r.root_id) for r in dialogue.linked(messages(spark, rows)).collect()}
    assert got == {1: (None, 1), 2: (None, 2), 3: (1, 1), 4: (2, 2), 5: (1, 1), 6: (4, 2), 7: (6, 2)}


def test_nearest_candidates_are_all_that_can_win():
    pick = random.Random(6)
    for _ in range(400):
        said = dialogue._Said(99, 10**9, "me", pick.choice(["@s3 red", "red blue green", "#7 blue", ""]))
        past = [dialogue._Said(i, 10**9 - pick.randrange(10**9), f"s{pick.randrange(6)}", pick.choice(["red blue", "green", "blue green red", ""])) for i in range(50)]

        def score(k):
            c = past[k]
            value = 5.0 * bool(said.names and (c.student in said.names or str(c.id) in said.names)) + 5.0 * min(1.0, math.log1p(len(said.terms & c.terms)) / math.log1p(8))
            return value + math.exp(-(said.us - c.us) / 6e8) - 0.5 * (49 - k)

        best = max(range(50), key=lambda k: (score(k), k))
        got, top, _ = dialogue.likeliest(said, deque(past, maxlen=dialogue.REACH))
        assert got is past[best] and abs(top - score(best)) < 1e-9


def test_slots_change_nothing(spark):
    pick = random.Random(8)
    words = ["red", "blue", "green", "puddle", "river", "map", "why", "because"]
    rows = [(i, pick.choice("ab") if i % 3 else "hot", f"s{pick.randrange(3)}", pick.choice(["user", "user", "assistant"]), " ".join(pick.choices(words, k=4)), pick.randrange(9000) if i % 50 else None) for i in range(900)]
    m = messages(spark, rows)
    columns = ["thread_id", "id", "prev_id", "prev_content", "next_speaker", "next_blank", "parent_id", "parent_is_prev", "root_id"]
    whole, cut = dialogue.linked(m, roots=True).select(columns), dialogue.linked(m, slot_rows=60, roots=True)
    assert cut.select("thread_id", "slot").distinct().count() > 20
    assert whole.exceptAll(cut.select(columns)).count() == 0 and whole.count() == cut.count() == 900


def test_interleaved_talks_are_told_apart(spark):
    """Talks of three pupils, each alternating in its own thread, merged into one: how many replies find their own question."""
    import duckdb

    talks = duckdb.sql("""WITH m AS (SELECT DISTINCT ON (id) * FROM '/root/testdata/sf0.01/education_messages.parquet' WHERE created_at IS NOT NULL AND content IS NOT NULL AND trim(role) IN ('user', 'assistant') ORDER BY id),
o AS (SELECT id, content, trim(role) AS role, lag(trim(role)) OVER w AS before, lag(id) OVER w AS parent, lag(content) OVER w AS asked FROM m WINDOW w AS (PARTITION BY thread_id ORDER BY created_at, id))
SELECT parent, asked, id, content FROM o WHERE role = 'assistant' AND before = 'user' AND length(trim(asked)) > 4 AND length(content) > 12 AND content <> asked ORDER BY hash(id) LIMIT 900""").fetchall()
    pick, rows, truth = random.Random(2), [], {}
    for n in range(0, 900, 3):
        three = talks[n : n + 3]
        order = pick.sample(three, 3)
        for k, (parent, asked, _, _) in enumerate(three):
            rows.append((parent, f"t{n}", f"s{k}", "user", asked, 2 * k))
        for k, (parent, _, reply, text) in enumerate(order):
            rows.append((reply, f"t{n}", "x", "assistant", text, 6 + 2 * k))
            truth[reply] = parent
    got = {r.id: r.parent_id for r in dialogue.linked(messages(spark, rows)).filter("speaker = 'assistant'").collect()}
    right, nearest = sum(got[k] == v for k, v in truth.items()) / len(truth), sum(talks[n + 2][0] == truth[r] for n in range(0, 900, 3) for r in [t[2] for t in talks[n : n + 3]]) / len(truth)
    print("links right", right, "by the nearest question alone", nearest)
    assert right > 0.8 and nearest < 0.4


def test_hot_thread_is_spread(spark):
    m = spark.range(20_000).select(F.col("id"), F.lit("hot").alias("thread_id"), F.lit("s").alias("student_id"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("x y z").alias("content"), (F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 60)).cast("timestamp_ntz").alias("created_at"))
    assert defects(m, conversations(spark, "hot")) == []
    assert dialogue.conversations_of(m, conversations(spark, "hot"), slot_rows=1_000).count() == 20_000
