"""Fixity audit and quotation linking on small cases with known answers."""

from crossover.llm.fixity import audit, build_tree
from crossover.llm.quotes import link_conversations, quoted_mail
from tests.conftest import rows

PAGES = "page_id long, url string, html string, k string, hash string"


def pages(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], PAGES)


def test_audit(spark):
    left = [(i, f"http://a/{i}", "x" * (i % 7)) for i in range(-300, 700)] + [(None, None, None), (5000, "u", None), (6000, "u", "t"), (6000, "u", "t")]
    right = [r for r in left if r[0] not in (17, 400)]
    right = [(i, u, "other") if i == 3 else (i, u, "") if i == 5000 else r for r in right for i, u, _ in [r]] + [(900, "new", "page"), (6000, "u", "t")]
    a, b = build_tree(pages(spark, left)), build_tree(pages(spark, right))
    assert rows(audit(a, b).select("page_id", "kind")) == sorted([(3, "corrupt"), (17, "missing"), (400, "missing"), (900, "extra"), (5000, "corrupt"), (6000, "count")], key=str)
    assert audit(a, build_tree(pages(spark, left[::-1]))).count() == 0
    nothing = build_tree(pages(spark, []))
    assert audit(nothing, build_tree(pages(spark, []))).count() == 0
    assert {r.kind for r in audit(build_tree(pages(spark, left[:3])), nothing).collect()} == {"missing"}


def test_quotes(spark):
    messages = [
        (1, "Shall we meet on Monday?\nThe room is free."),
        (2, "> Shall we  meet on MONDAY?\n> The room is free.\nYes, at nine."),
        (3, ">> Shall we meet on Monday?\n>> The room is free.\n> Yes, at nine.\nToo early for me."),
        (4, "> The room is free.\nIs it really?"),
        (5, "> nobody ever wrote this line\nHello."),
        (6, "> > The room is free.\n> Is it really?\nI asked."),
        (7, "Shall we meet on Monday?\nThe room is free."),
        (8, "> I come later in time\nEarly."),
        (9, "I come later in time"),
        (10, None),
        (11, ""),
        (12, ">\n> \n"),
        (None, "lost"),
        (4, "> The room is free.\nIs it really?"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in messages], "id long, text string, run string")
    got = {r.id: (r.conversation, r.parent, r.depth, r.text) for r in link_conversations(df).collect()}
    assert got == {
        1: (1, None, 0, messages[0][1]), 2: (1, 1, 1, "Yes, at nine."), 3: (1, 2, 2, "Too early for me."), 4: (1, 1, 1, "Is it really?"),
        5: (5, None, 0, "Hello."), 6: (1, 4, 2, "I asked."), 7: (7, None, 0, messages[0][1]), 8: (8, None, 0, "Early."), 9: (9, None, 0, "I come later in time"),
        10: (10, None, 0, ""), 11: (11, None, 0, ""), 12: (12, None, 0, ""),
    }
    assert link_conversations(df.where("false")).count() == 0


def test_quotes_by_thread(spark):
    df = spark.createDataFrame([(1, "a question to all of you", "x"), (2, "a question to all of you", "y"), (3, "> a question to all of you\nan answer", "y")], "id long, text string, box string")
    assert {r.id: r.parent for r in link_conversations(df).collect()}[3] == 1
    assert {r.id: r.parent for r in link_conversations(df, thread_column="box").collect()}[3] == 2


def test_quotes_long_chain(spark):
    df = spark.createDataFrame([(i, (f"> message number {i - 1} of the chain\n" if i else "") + f"message number {i} of the chain") for i in range(40)], "id long, text string")
    assert {r.id: (r.conversation, r.depth) for r in link_conversations(df).collect()} == {i: (0, i) for i in range(40)}


def test_mail_ids_never_collide(spark):
    """Turns above 999, repeated turns with other texts and NULL keys: every message stays, and is linked in its own conversation."""
    long = [(1, t, f"turn {t} of the long conversation") for t in range(997, 1004)]
    other = [(2, t, f"turn {t} of another conversation") for t in range(4)]
    twice = [(3, 0, "one text of a repeated turn"), (3, 0, "one text of a repeated turn"), (3, 0, "two texts of a repeated turn"), (3, 1, "what follows them both")]
    lost = [(None, 0, "a turn of no conversation"), (1, None, "a message without a turn"), (None, None, "neither of both"), (None, None, "neither of both")]
    got = link_conversations(quoted_mail(spark.createDataFrame(long + other + twice + lost, "conv_id long, turn long, text string"))).collect()
    text = {r.id: r.text for r in got}
    assert len(text) == len(got) and sorted(text.values()) == sorted(t for _, _, t in long + other + twice[1:] + lost)
    parent = {r.text: text.get(r.parent) for r in got}
    for rows in (long, other):
        assert parent[rows[0][2]] is None and all(parent[b[2]] == a[2] for a, b in zip(rows, rows[1:]))
    assert parent["what follows them both"] == "one text of a repeated turn"
    assert all(parent[t] is None for _, _, t in lost + twice[:3])


def test_mail_ids_of_short_conversations(spark):
    """NULL keys alone do not change the ids of the others."""
    got = quoted_mail(spark.createDataFrame([(7, 0, "a"), (7, 1, "b"), (None, 1, "c")], "conv_id long, turn long, text string"))
    assert {(r.id, r.text) for r in got.collect()} == {(7000, "a"), (7001, "> a\nb"), (7002, "c")}
    assert quoted_mail(spark.createDataFrame([], "conv_id long, turn long, text string")).count() == 0
