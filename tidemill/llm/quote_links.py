"""Quotation linking in conversations.

A line's quote level is the number of ">" at its start (spaces between them do not
count). Consecutive lines of one level are a passage; an attribution line ("... wrote:")
right before a deeper quote belongs to it. Passages are normalised (markers off, all white space
collapsed, line ends too, A-Z lower-cased), so a quote that was wrapped anew is still the
same. A quoted passage is hashed and joined to the unquoted passages of its conversation's
messages, texts are compared after the join, and the earliest earlier message is its original; earliest
turns are pre-aggregated, so a passage that many messages hold joins as one row. Only a passage that is
nobody's whole passage, a partial quote, goes by its lines of ``min_chars`` characters or more: the
original is the message that holds most of their characters.

A message replies to the original of its least nested linked passage (the longest, then the latest, on
ties). Replies form trees, as an original is earlier than its quotes. A tour of each tree, in at a message
and out of it again, is a list; thread, depth and ``reply_pos``, the place in the thread from 0, depth first and replies
by turn, are sums over what stands before in it. Lists are ranked by pointer doubling over written tables, a few numbers a
message. Order by (conv_id, thread_turn, reply_pos) is the reply order of conversations; ``own_text`` has no quotes.

Nulls: rows with a null conv_id or turn link to nothing (reply_pos null); a null or empty text has no
passage and an empty own text. A message without a linked quote starts a thread. Messages that repeat
(conv_id, turn) are one message to others: passages count from all of them, and each row gets
their common reply. Very long texts are parsed whole, one at a time. Columns of messages that have the
names of results are replaced. Empty tables give no rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import positions
from .common import LOWER, UPPER, Scratch, fresh

MARKER, ATTRIBUTION = re.compile(r"(?:[ \t]*>)+"), re.compile(r"(?i)\b(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*$")
BLANK, SPACE, TO_LOWER = " \t\r\n", re.compile(r"[ \t\r\n]+"), str.maketrans(UPPER, LOWER)
PARSED = "own_text string, passages array<struct<level:int,norm:string,lines:array<string>>>"


def normal(text: str) -> str:
    return SPACE.sub(" ", text).strip(" ").translate(TO_LOWER)


def parse(text: str | None) -> tuple[str, list[dict]]:
    """The text without quotes, and its passages that are not blank, in order."""
    own, groups, rows = [], [], []
    for line in (text or "").split("\n"):
        m = MARKER.match(line)
        rows.append((m.group().count(">"), line[m.end() :]) if m else (0, line))
    for i, (level, body) in enumerate(rows):
        if i + 1 < len(rows) and rows[i + 1][0] > level and ATTRIBUTION.search(body):
            continue
        if level == 0:
            own.append(body)
        if not groups or groups[-1][0] != level:
            groups.append((level, []))
        groups[-1][1].append(body)
    passages = [{"level": level, "norm": normal("\n".join(g)), "lines": [x for x in map(normal, g) if x]} for level, g in groups]
    return "\n".join(own).strip(BLANK), [p for p in passages if p["norm"]]


def parsed(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t) for t in texts], columns=["own_text", "passages"])


def passage_links(units: DataFrame, s: Scratch, min_chars: int) -> DataFrame:
    """(c, t, pos, level, origin, weight): the earlier message that each quoted passage comes from."""
    quotes = s.save(units.where("level > 0"))

    def firsts(texts: DataFrame, asked: DataFrame) -> DataFrame:
        """The earliest turn of each text that is asked for; (c, x) and its hash h."""
        return texts.groupBy("c", "h", "x").agg(F.min("t").alias("origin")).join(asked.select("c", "h").distinct(), ["c", "h"], "left_semi").withColumnRenamed("x", "y")

    whole = units.where("level = 0").select("c", "t", "h", F.col("norm").alias("x"))
    found = quotes.join(firsts(whole, quotes), ["c", "h"]).where("norm = y and origin < t").select("c", "t", "pos", "h", "level", "origin", F.length("norm").cast("long").alias("weight"))
    found = s.save(found)
    lines = lambda df: df.select("c", "t", "pos", F.col("h").alias("p"), "level", F.explode("lines").alias("x")).where(F.length("x") >= min_chars).withColumn("h", F.xxhash64("x"))
    partial = s.save(lines(quotes.join(found, ["c", "t", "pos", "h"], "left_anti")))
    votes = partial.join(firsts(lines(units.where("level = 0")), partial), ["c", "h"]).where("x = y and origin < t").groupBy("c", "t", "pos", "p", "level", "origin").agg(F.sum(F.length("x")).alias("weight"))
    best = votes.groupBy("c", "t", "pos", "p", "level").agg(F.max(F.struct("weight", "origin")).alias("b"))
    return s.save(found.union(best.select("c", "t", "pos", "p", "level", "b.origin", "b.weight")))


def reply_order(reply: DataFrame, s: Scratch) -> DataFrame:
    """(c, t, top, depth, pos) of all messages that reply (c, t, parent) or are replied to.

    Each entry of the list is joined by at most one other in each round, and leaves the rounds once it has reached the start of its list.
    """
    kids = s.save(positions(reply.select("c", "t", "parent"), ["t"], ["c", "parent"], "i"))
    before = kids.select("c", "parent", F.col("t").alias("elder"), (F.col("i") + 1).alias("i"))
    last = kids.groupBy("c", "parent").agg(F.max("t").alias("last")).withColumnRenamed("parent", "t")
    tops = kids.select("c", F.col("parent").alias("t")).distinct().join(kids, ["c", "t"], "left_anti")

    def entry(rows: DataFrame, out: bool, at: Column, at_out: Column, done: bool = False) -> DataFrame:
        weight = [F.lit(0), F.lit(0)] if done else [F.when(at_out, 0).otherwise(1), F.when(at_out, -1).otherwise(1)]
        return rows.select("c", "t", F.lit(out).alias("out"), at.alias("at"), at_out.alias("at_out"), *[w.cast("long").alias(x) for w, x in zip(weight, ("pos", "depth"), strict=True)], F.lit(done).alias("done"))

    ins = entry(kids.join(before, ["c", "parent", "i"], "left"), False, F.coalesce("elder", "parent"), F.col("elder").isNotNull())
    outs = entry(kids.select("c", "t").join(last, ["c", "t"], "left"), True, F.coalesce("last", "t"), F.col("last").isNotNull())
    state = s.save(ins.union(outs).union(entry(tops, False, F.col("t"), F.lit(False), True)))
    while not (going := state.where("not done")).isEmpty():
        then = state.select("c", F.col("t").alias("at"), F.col("out").alias("at_out"), *[F.col(x).alias(f"{x}2") for x in ("at", "at_out", "pos", "depth", "done")])
        moved = going.join(then, ["c", "at", "at_out"]).select("c", "t", "out", F.col("at2").alias("at"), F.col("at_out2").alias("at_out"), (F.col("pos") + F.col("pos2")).alias("pos"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("done2").alias("done"))
        after = s.save(moved.union(state.where("done")))
        s.drop(state)
        state = after
    return state.where("not out").select("c", "t", F.col("at").alias("top"), "depth", "pos")


def quote_links(messages: DataFrame, min_chars: int = 12) -> DataFrame:
    """All rows and columns of messages with own_text, n_quoted and n_linked (passages), max_level, parent_turn, thread_turn, depth and reply_pos."""
    s = Scratch(messages.sparkSession)
    p, *inner = fresh("p", "c", "t", "parent", "n_linked", "top", "depth", "pos")
    c, t, parent, n_linked, top, depth, pos = inner
    base = s.save(messages.withColumn(p, F.pandas_udf(parsed, PARSED)(F.col("text"))))
    units = base.where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("t"), F.posexplode(F.col(p)["passages"]).alias("pos", "u")).select("c", "t", "pos", "u.*")
    units = s.save(units.withColumn("h", F.xxhash64("norm")).distinct())
    links = passage_links(units, s, min_chars)
    reply = links.groupBy("c", "t").agg(F.max(F.struct(-F.col("level"), F.col("weight"), F.col("origin"))).alias("best"), F.count("*").alias("n_linked"))
    reply = s.save(reply.select("c", "t", F.col("best.origin").alias("parent"), "n_linked"))
    found = reply_order(reply, s).join(reply, ["c", "t"], "left").select(*[F.col(x).alias(name) for x, name in zip(("c", "t", "parent", "n_linked", "top", "depth", "pos"), inner, strict=True)])
    out = base.join(found, (F.col("conv_id") == F.col(c)) & (F.col("turn") == F.col(t)), "left")
    levels = F.filter(F.col(p)["passages"]["level"], lambda x: x > 0)
    made = {
        "own_text": F.col(p)["own_text"], "n_quoted": F.size(levels).cast("long"), "max_level": F.coalesce(F.array_max(levels), F.lit(0)).cast("long"), "n_linked": F.coalesce(n_linked, F.lit(0)).cast("long"),
        "parent_turn": F.col(parent), "thread_turn": F.coalesce(top, F.col("turn").cast("long")), "depth": F.coalesce(depth, F.lit(0)).cast("long"),
        "reply_pos": F.coalesce(pos, F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.lit(0).cast("long"))),
    }
    return out.select(*[F.col(f"`{x}`") for x in messages.columns if x not in made], *[v.alias(k) for k, v in made.items()])


def mailbox(conversations: DataFrame) -> DataFrame:
    """The messages of conversations as mails: four in five replies quote one of the three turns before, with an attribution line and what that one quoted.

    A hash of conv_id and turn decides which; half of the quotes are wrapped anew.
    """
    mark = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), 1, 8), 16, 10).cast("bigint")
    one = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"), F.min("role").alias("role")).withColumn("mark", mark)
    asked = one.where("turn > 0 and mark % 5 != 0").select("conv_id", "turn", F.expr("greatest(0, turn - 1 - mark % 3)").alias("p"), "mark")
    parent = one.where(F.length(F.translate("text", BLANK, "")) > 0).select("conv_id", F.col("turn").alias("p"), F.col("text").alias("p_text"), F.col("role").alias("p_role"))
    reply = asked.join(parent, ["conv_id", "p"])
    before = reply.select("conv_id", F.col("turn").alias("p"), F.col("p_text").alias("g_text"), F.col("p_role").alias("g_role"))
    both = reply.join(before, ["conv_id", "p"], "left").drop("p")
    shape = lambda text: F.when(F.col("mark") % 2 == 0, F.regexp_replace(text, "[ \n]+", " ")).otherwise(F.col(text))
    quote = lambda text, marks: F.concat(F.lit(marks), F.regexp_replace(shape(text), "\n", f"\n{marks}"))
    wrote = lambda role: F.concat(F.coalesce(F.col(role), F.lit("someone")), F.lit(" wrote:\n"))
    nested = F.when(F.col("g_text").isNotNull(), F.concat(F.lit("\n> "), wrote("g_role"), quote("g_text", "> > "))).otherwise("")
    c, t, end = fresh("c", "t", "tail")
    tail = both.select(F.col("conv_id").alias(c), F.col("turn").alias(t), F.concat(F.lit("\n\nIn an earlier mail "), wrote("p_role"), quote("p_text", "> "), nested).alias(end))
    out = conversations.join(tail, (F.col("conv_id") == F.col(c)) & (F.col("turn") == F.col(t)), "left")
    return out.withColumn("text", F.when(F.col(end).isNotNull(), F.concat(F.coalesce("text", F.lit("")), end)).otherwise(F.col("text"))).drop(c, t, end)
