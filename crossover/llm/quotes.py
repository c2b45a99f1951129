"""Quotation linking: who answers whom, read from quoted text alone; DataFrame functions only.

A line's quote level is its number of leading ``>`` marks; consecutive lines of one level are a passage. Passages and single lines are
normalised (lower case, white space runs as one space, trimmed) and hashed. Own passages (level 0), whole own bodies and own lines of at
least ``LINE_CHARS`` characters say where a text was first sent: of equal texts the smallest message id is the original, so a text
that a third of all messages share is one row after a combine before the shuffle. Quoted passages are joined to originals with
a smaller id than the quoting message, by the whole passage or else by the original most of its lines point to (ties: smallest id).
The parent of a message is the latest original on its lowest linked level. Roots and depths follow by doubling pointers, each round
a table. The result holds messages without quotes; sorted by (conversation, depth, id) each answer follows what it answers.

Defined cases: a NULL or empty text has no passages, quotes nothing and is a root; blank passages match nothing; rows without an id
are left out, as nothing can point to them; rows that repeat an id count as one message, with the smallest text (NULL last); other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossover.llm.common import written

LOWER_LETTERS, UPPER_LETTERS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LINE_CHARS = 12
MARKS = r"^((?:[ \t]*>)+) ?"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0b]+", " "))


def _key(thread: Column | None, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("\x1f", *([thread.cast("string")] if thread is not None else []), normal(text)), 256))


def passages(messages: DataFrame) -> DataFrame:
    """(id, thread, run, level, body, lines): each run of lines with one quote level, marks removed."""
    lines = messages.select("id", "thread", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    parsed = lines.select("id", "thread", "pos", F.char_length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace("line", MARKS, "").alias("line"))
    order = Window.partitionBy("id").orderBy("pos")
    turned = F.coalesce((F.lag("level").over(order) != F.col("level")).cast("int"), F.lit(1))
    runs = parsed.withColumn("turned", turned).withColumn("run", F.sum("turned").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.array_sort(F.collect_list(F.struct("pos", "line"))).getField("line")
    return runs.groupBy("id", "run").agg(F.first("thread").alias("thread"), F.first("level").alias("level"), kept.alias("lines")).withColumn("body", F.array_join("lines", "\n"))


def own_bodies(parts: DataFrame) -> DataFrame:
    """(id, thread, passages, body): each message without its quotes."""
    own = parts.where("level = 0").groupBy("id").agg(F.first("thread").alias("thread"), F.array_sort(F.collect_list(F.struct("run", "body"))).alias("runs"))
    return own.select("id", "thread", F.size("runs").alias("passages"), F.array_join(F.col("runs.body"), "\n").alias("body"))


def originals(parts: DataFrame, by_thread: bool = False) -> DataFrame:
    """(key, original): the first message that has a text as its body, a passage or a line of its own."""
    thread = F.col("thread") if by_thread else None
    own = parts.where("level = 0")
    lines = own.select("id", "thread", F.size("lines").alias("alone"), F.explode("lines").alias("body")).where(F.char_length(normal(F.col("body"))) >= LINE_CHARS)
    several = own_bodies(parts).where("passages > 1").select("id", "thread", "body")
    every = own.select("id", "thread", "body").union(several).union(lines.where(F.col("alone") > 1).select("id", "thread", "body"))
    return every.where(normal(F.col("body")) != "").select(_key(thread, F.col("body")).alias("key"), "id").groupBy("key").agg(F.min("id").alias("original"))


def quote_links(parts: DataFrame, by_thread: bool = False) -> DataFrame:
    """(id, run, level, original) of every quoted passage with an original."""
    thread = F.col("thread") if by_thread else None
    passage, first = ["id", "run", "level"], written(originals(parts, by_thread), "originals")  # asked twice
    quoted = parts.where((F.col("level") > 0) & (normal(F.col("body")) != ""))
    whole = quoted.select(*passage, _key(thread, F.col("body")).alias("key")).join(first, "key").where("original < id").select(*passage, "original")
    # Lines are asked only where the passage as a whole is nobody's.
    rest = quoted.select(*passage, "thread", "lines").join(whole.select("id", "run"), ["id", "run"], "left_anti")
    lines = rest.select(*passage, "thread", F.explode("lines").alias("body")).where(F.char_length(normal(F.col("body"))) >= LINE_CHARS)
    votes = lines.select(*passage, _key(thread, F.col("body")).alias("key")).join(first, "key").where("original < id")
    counted = votes.groupBy(*passage, "original").agg(F.count("*").alias("n"))
    return whole.union(counted.groupBy(*passage).agg(F.max_by("original", F.struct("n", -F.col("original"))).alias("original")))


def parents(links: DataFrame) -> DataFrame:
    """(id, parent): the latest original on the lowest linked level."""
    return links.groupBy("id").agg(F.max_by("original", F.struct(-F.col("level"), "original")).alias("parent"))


def roots(ids: DataFrame, parent: DataFrame) -> DataFrame:
    """(id, parent, conversation, depth). A parent has a smaller id, so there are no circles; rounds double the reach."""
    start = ids.join(parent, "id", "left")
    now = written(start.select("id", "parent", F.coalesce("parent", "id").alias("up"), F.col("parent").isNotNull().cast("int").alias("hops")), "roots")
    while True:
        up = now.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("hops").alias("more"))
        after = written(now.join(up, "up").select("id", "parent", F.col("far").alias("up"), (F.col("hops") + F.col("more")).alias("hops")), "roots")
        if after.agg(F.sum("hops")).first()[0] == now.agg(F.sum("hops")).first()[0]:
            return after.select("id", "parent", F.col("up").alias("conversation"), F.col("hops").alias("depth"))
        now = after


def link_conversations(messages: DataFrame, id_column: str = "id", text_column: str = "text", thread_column: str | None = None) -> DataFrame:
    """Per message: id, conversation (its root), parent, depth, n_links, text without quotes; sorted into answer order.

    With ``thread_column`` (a subject, a mailbox) only texts of one thread are linked.
    """
    thread = F.col(thread_column).cast("string") if thread_column else F.lit(None).cast("string")
    rows = messages.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), thread.alias("thread"))
    once = rows.groupBy("id").agg(F.min("text").alias("text"), F.min("thread").alias("thread"))
    parts = written(passages(once), "passages")
    links = written(quote_links(parts, thread_column is not None), "quotes")
    counts = links.groupBy("id").agg(F.count("*").alias("n_links"))
    tree = roots(parts.select("id").distinct(), parents(links))
    out = tree.join(own_bodies(parts).select("id", "body"), "id", "left").join(counts, "id", "left")
    return out.select("id", "conversation", "parent", "depth", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.trim(F.coalesce("body", F.lit(""))).alias("text")).orderBy("conversation", "depth", "id")


def _positions(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, their position 0, 1, … in ``order``: rows are counted per range, and the counts summed up."""
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row for each partition
    return ranged.join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start")


def quoted_mail(conversations: DataFrame) -> DataFrame:
    """``conversations`` as mail: each turn quotes the one before it, and that one's own quote one level deeper.

    Message id is conv_id * 1000 + turn as long as that tells all messages apart in their order (turns of 0 to 999, one text for each).
    Else it is the position by conv_id, turn and a hash of the text, so that no two messages share an id.
    By (conv_id + turn) % 3 the quote is whole, with a-z in upper case and doubled spaces, or the first line only.

    Defined cases: rows that repeat a turn with the same text are one message; with other texts each is a message, and the next turn quotes
    the smallest of them (NULL last); each row with a NULL conv_id or turn is a message that quotes nothing, and its id follows all others.
    """
    c = conversations.select("conv_id", "turn", "text")
    lost = c.where("conv_id is null or turn is null")
    c = c.where("conv_id is not null and turn is not null")
    hashed = F.xxhash64("text")
    turns = written(c.groupBy("conv_id", "turn").agg(F.min("text").alias("text"), (F.min(hashed) < F.max(hashed)).alias("several")), "turns")  # asked four times
    low, high, first_turn, last_turn, several = turns.agg(F.min("conv_id"), F.max("conv_id"), F.min("turn"), F.max("turn"), F.max("several")).first()
    if low is None:
        low, high, first_turn, last_turn = 0, 0, 0, 0
    if not several and first_turn >= 0 and last_turn < 1000 and max(-low, high) < (1 << 63) // 1000 - 1:
        numbered = turns.select("conv_id", "turn", "text", (F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("id"))
    else:
        numbered = _positions(c.distinct().withColumn("h", hashed), "conv_id", "turn", "h").select("conv_id", "turn", "text", F.col("at").alias("id"))
    if not lost.isEmpty():
        free = (numbered.agg(F.max("id")).first()[0] or 0) + 1
        numbered = numbered.union(_positions(lost.withColumn("h", hashed), "conv_id", "turn", "h").select("conv_id", "turn", "text", F.col("at") + free))
    before = [turns.select("conv_id", (F.col("turn") + i).alias("turn"), F.coalesce("text", F.lit("")).alias(f"q{i}")) for i in (1, 2)]
    joined = numbered.join(before[0], ["conv_id", "turn"], "left").join(before[1], ["conv_id", "turn"], "left")
    kind = (F.col("conv_id") + F.col("turn")) % 3
    first = F.when(kind == 0, F.col("q1")).when(kind == 1, F.regexp_replace(F.translate("q1", LOWER_LETTERS, UPPER_LETTERS), " ", "  ")).otherwise(F.split("q1", "\n")[0])
    mark = lambda text, marks: F.concat(F.lit(marks), F.regexp_replace(text, "\n", f"\n{marks}"))
    mail = F.concat_ws("\n", mark(F.col("q2"), ">> "), mark(first, "> "), F.coalesce("text", F.lit("")))
    return joined.select("id", mail.alias("text"))
