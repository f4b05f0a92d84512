import random
from datetime import datetime, timedelta

import pytest

from codeloom.llm import messages as chat, pairs

MESSAGES = "id long, thread_db_id long, role string, content string, created_at timestamp"
T0 = datetime(2025, 1, 1)


def build(spark, threads, rows):
    """Rows as (thread, role, content[, minute]); ids and times in order unless given."""
    out = [(i, r[0], r[1], r[2], None if len(r) > 3 and r[3] is None else T0 + timedelta(minutes=r[3] if len(r) > 3 else i)) for i, r in enumerate(rows)]
    clash = [(t, "u", "x", "y", 1) for t in threads]
    return spark.createDataFrame(clash, "id long, user_id string, thread_db_id string, reason string, rows int"), spark.createDataFrame(out, MESSAGES).selectExpr("*", "'z' as part", "1 as speaker", "2 as rows")


def faults(spark, threads, rows):
    return {r.thread_db_id: r.reason for r in chat.conversations(*build(spark, threads, rows))[1].collect()}


def test_each_fault_and_its_precedence(spark):
    rows = [
        (1, "user", "q"), (1, "assistant", "a"),
        (2, "user", " ​"), (2, None, ""),
        (3, "?", "q"), (3, "user", "q"),
        (4, "assistant", "a"), (4, "user", "q"),
        (5, "system", "s"), (5, " Human ", "q"), (5, "tool", "t"), (5, "BOT", "a"), (5, "user", "q2"),
        (6, "user", "q"), (6, "user", "q"), (6, "ai", "a"),
        (7, "user", "q", None), (7, "assistant", "a"),
        (8, "user", "q"), (8, "assistant", "﻿"),
        (9, "system", "only"), (None, "user", "q"), (77, "user", "q"),
    ]
    assert faults(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], rows) == {2: "empty", 3: "broken", 4: "broken", 5: "no_reply", 6: "no_reply", 7: "broken", 8: "no_reply", 10: "empty"}


def test_repeated_rows_count_once_and_ties_go_by_id(spark):
    rows = [(1, "user", "q", 0), (1, "user", "q", 0), (1, "assistant", "a", 0), (1, "assistant", "a", 0)]
    sound, bad = chat.conversations(*build(spark, [1], rows))
    assert bad.count() == 0
    got = [(r.position, r.id, r.speaker, r.reply_to) for r in sound.orderBy("position").collect()]
    assert got == [(0, 0, "user", None), (1, 2, "assistant", 0)]


def test_order_and_links_do_not_depend_on_partitions(spark):
    rows = []
    for k in range(400):
        rows += [(1, "user", f"What is item_{k} for?"), (1, "tool", "{}"), (1, "assistant", f"item_{k} is stored.")] if k % 7 else [(1, "user", "again?"), (1, "assistant", "yes")]
    threads, messages = build(spark, [1], rows)
    got = {}
    for n in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sound, bad = chat.conversations(threads, messages)
        got[n] = sorted(tuple(r) for r in sound.collect())
        assert bad.count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got[1] == got[9] and [r[1] for r in got[1]] == list(range(len(rows)))
    links = {r[2]: (r[3], r[6], r[8]) for r in got[1]}
    assert all(root is None or root <= i for i, (_, _, root) in links.items()) and all(s != "assistant" or p is not None for s, p, _ in links.values())


def test_interleaved_questions_are_told_apart_by_scores(spark, monkeypatch):
    rows = [
        (1, "user", "Which table does order_sync write?", 0), (1, "user", "How often does mail_relay retry?", 1), (1, "assistant", "order_sync writes the table order_log.", 2),
        (1, "tool", "{}", 3), (1, "assistant", "mail_relay does retry three times.", 4), (2, "user", "Why does cart_job fail?", 0), (2, "assistant", "A lock.", 1), (2, "user", "And the queue_job?", 2), (2, "assistant", "cart_job waits for the lock.", 3),
    ]
    threads, messages = build(spark, [1, 2], rows)
    told = chat.merged(messages).where(~chat.F.col("blank"))
    links = chat.reply_links(chat.in_order(told.drop("blank")))
    assert {r.id: (r.reply_to, r.root_id, r.turn_id) for r in links.where("speaker = 'assistant'").collect()} == {2: (0, 0, 1), 4: (1, 1, 1), 6: (5, 5, 5), 8: (5, 5, 7)}
    by_tree = {r.thread_db_id: r.reason for r in chat.thread_faults(threads, told, links, confirm=False).collect()}
    confirmed = {r.thread_db_id: r.reason for r in chat.thread_faults(threads, told, links).collect()}
    assert by_tree == {1: "no_reply", 2: "no_reply"} and confirmed == {1: "no_reply"}


def test_a_parent_may_lie_any_number_of_rows_and_questions_back(spark):
    rows = [(1, "user", "Which night job rebuilds order_sync?", 0), (1, "assistant", "Wait.", 1)]
    for k in range(20):
        rows += [(1, "user", f"What is item_{k} for?", 2 + 2 * k), (1, "assistant", f"item_{k} is stored.", 3 + 2 * k)]
    rows += [(1, "user", "Anything else?", 50), (1, "assistant", "order_sync: a night job rebuilds", 51)]
    threads, messages = build(spark, [1], rows)
    told = chat.merged(messages).where(~chat.F.col("blank"))
    for size in (chat.BLOCK_ROWS, 5):
        links = chat.reply_links(chat.in_order(told.drop("blank")), size)
        assert {r.id: (r.reply_to, r.root_id, r.turn_id) for r in links.where("id > 41").collect()} == {42: (None, 42, 42), 43: (0, 0, 42)}
        assert {r.thread_db_id: r.reason for r in chat.thread_faults(threads, told, links, confirm=False).collect()} == {1: "no_reply"}
        assert chat.thread_faults(threads, told, links).count() == 0


@pytest.mark.parametrize("size, parts", [(chat.BLOCK_ROWS, 1), (16, 1), (70, 5)])
def test_links_are_the_best_of_all_earlier_rows(spark, size, parts):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(12)] + [f"name_{k}" for k in range(40)]
    rows = [(1 + (i > 240), draw.choice(["user", "assistant", "assistant", "tool", "system"]), " ".join(draw.choices(words, k=draw.randint(1, 6))) + f" {i}", 5 * (i // 3)) for i in range(260)]
    messages = build(spark, [1, 2], rows)[1]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.id: (r.position, r.reply_to, r.link_score, r.root_id, r.turn_id) for r in chat.reply_links(chat.in_order(chat.merged(messages).drop("blank")), size).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    wanted, earlier, opening = {}, {1: [], 2: []}, {}
    for i, (thread, speaker, content, minute) in enumerate(rows):
        message = chat.Message(i, i, speaker, minute * 60_000_000, content)
        asks, fit = speaker == "user", [m for m in earlier[thread] if m.speaker != "system" and not (speaker == "user" and m.speaker == "tool")]
        scored = [(chat.link_score(message, m) + (chat.TURN_BONUS if not asks and m.id == opening.get(thread) else 0.0), -m.n, m) for m in fit if speaker != "system"]
        score, _, parent = max(scored, key=lambda s: s[:2], default=(None, None, None))
        if asks:
            opening[thread] = i
        elif parent is not None:
            message.root = parent.root
        if parent is None or (asks and score < chat.FOLLOW_UP):
            score = parent = None
        wanted[i] = (len(earlier[thread]), parent and parent.id, score and round(score, 6), message.root, opening.get(thread))
        earlier[thread].append(message)
    assert got == wanted


def test_empty_tables(spark):
    threads, messages = build(spark, [1], [(1, "user", "q")])
    sound, bad = chat.conversations(threads.limit(0), messages)
    assert sound.count() == bad.count() == 0
    assert [tuple(r) for r in chat.conversations(threads, messages.limit(0))[1].collect()] == [(1, "empty")]
    assert pairs.defects(pairs.answer_pairs(threads, messages.limit(0))).count() == 0


def test_pairs_take_the_first_answer_of_a_turn(spark):
    rows = [(1, "user", "q1"), (1, "system", "s"), (1, "assistant", ""), (1, "assistant", "a2"), (1, "user", "q2"), (1, "user", "q3"), (1, "assistant", "a3"), (2, "assistant", "x"), (2, "user", "q")]
    threads, messages = build(spark, [1, 2], rows)
    got = {r.response_id: (r.question, r.answer) for r in pairs.answer_pairs(threads, messages).collect()}
    assert got == {2: ("q1", ""), 6: ("q3", "a3")}


@pytest.mark.parametrize("text", [None, "", " \n\t", " ​﻿", "...", "**", "<br/>", "[]", '""', "```\n```", "N/A", "(no content)", "None", "keine", "无", "—"])
def test_empty_answers(text):
    assert pairs.is_empty(text)


@pytest.mark.parametrize("text", ["42", "No.", "Yes", "`a.b`", "v1.2", "t_order", "-1"])
def test_bare_values_are_no_empty_answers(text):
    assert not pairs.is_empty(text) and not pairs.hangs(text)


def test_copies():
    q = "Hi, What is cart_no for?"
    for a in (q, f'"{q}"', "what is cart_no for", f"{q}\n{q}", f"You asked: {q}", "> What is cart_no for?", f"Q: {q}"):
        assert pairs.is_copy(q, a), a
    for a in (f"You asked: {q}\nIt holds the number.", "cart_no", "No.", ""):
        assert not pairs.is_copy(q, a), a


def test_refusals():
    for a in ("I'm sorry, but I can't help with that. Please ask your administrator.", "Das liegt außerhalb dessen, was ich beantworten darf.", "抱歉，我无法回答这个问题。您还有其他问题吗？", "Let's talk about something else.", "My guidelines prevent me from discussing this.", "I am afraid that topic is off limits for me.", "恕我不便回答。"):
        assert pairs.is_refusal(a), a
    for a in ("Sorry to say it, but no. Manual changes are not permitted because x overwrites them.", "I can't say more than the index shows, but this much is clear. a.b", "It was unable to reach port 80. The pool declined the connection.", "抱歉，不可以。手工修改会被 x 拒绝并覆盖。", "Leider nein. Solche Änderungen werden abgelehnt."):
        assert not pairs.is_refusal(a), a


def test_languages():
    assert pairs.is_foreign("Which class writes t_x?", "Seule la classe A écrit dans t_x. Les autres ne font que lire.")
    assert pairs.is_foreign("哪个类会写入 t_x 表？", "The night job holds the lock while it runs.")
    assert not pairs.is_foreign("Which class writes t_x? Please answer in Chinese.", "只有 A 会写入这张表。")
    assert not pairs.is_foreign("Which port does it use?", "8080") and not pairs.is_foreign("Which tables?", "t_a, t_b")


def test_extension_counts_cross_partitions(spark):
    texts = ["a", "ab", "abc", "abd", "b", "ba", *[f"ab{i:03}" for i in range(40)]]
    frame = spark.createDataFrame([(t, 1, 1) for t in texts], "text string, ends long, inner long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    got = {r.text: r.longer for r in pairs.extension_counts(frame).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {t: 2 * sum(o != t and o.startswith(t) for o in texts) for t in texts}


def test_cut_off_answers_are_told_from_all_answers(spark):
    whole = "The night job holds the lock while it rebuilds t_{0}. Readers are not affected."
    bare = "It marks row_{0} as booked (see b_{0})"
    rows = [(i, "Why?", whole.format(i)) for i in range(40)] + [(100 + i, "Why?", bare.format(i)) for i in range(40)]
    rows += [(200, "Why?", whole.format(7)[:40]), (201, "Why?", "It marks row_7 as booked, but only if"), (202, "Why?", "Like this:\n```yaml\na: 1"), (203, "Why?", "t_a, t_b"), (204, None, None)]
    got = {r.response_id: r.defect for r in pairs.defects(spark.createDataFrame(rows, "response_id long, question string, answer string")).collect()}
    assert got == {200: "truncated", 201: "truncated", 202: "truncated", 204: "empty"}
