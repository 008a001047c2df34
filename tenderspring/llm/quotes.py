"""Quotation linking: messages without their quotes, each tied to the message that it answers.

Lines of a message have a quote level (their leading '>' marks). Runs of lines of one level are passages;
their lines and sentences, normalised and hashed, are looked up among the messages' own words. The message
that holds most of the outermost passages is what a message replies to. Replies hang under the message that
began the exchange, and a conversation is read thread by thread, replies after what they answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: Lines before a quote that tell who wrote it, in the languages of the corpus.
_SAID = r"(?i)^[ \t]*(?:(?:on|le|el|am)\b.{0,200}\b(?:wrote|a [ée]crit|escribi[óo]|schrieb)\b.{0,80}:|-{2,}[ \t]*(?:original message|urspr[üu]ngliche nachricht|message d'origine|mensaje original)[ \t]*-{2,})[ \t]*$"
#: Turns of a conversation that are ranked together.
_BLOCK = 1024


def _level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, _MARKS, 1), " \t", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " "))


def parsed(text: Column) -> Column:
    """A struct of body (the lines without quotes and attributions, outer white space trimmed), levels (the
    deepest quote level) and passages (array of level, text: runs of quoted lines of one level)."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("words"), x.rlike(_SAID).alias("said")))

    def parts(all_lines: Column) -> Column:
        quoted = F.exists(all_lines, lambda x: x["level"] > 0)
        own = F.filter(all_lines, lambda x, i: (x["level"] == 0) & ~(x["said"] & quoted))
        changes = F.filter(
            F.transform(all_lines, lambda x, i: F.struct(i.alias("i"), x["level"].alias("level"), (x["level"] != F.coalesce(F.get(all_lines, i - 1)["level"], F.lit(-1))).alias("new"))),
            lambda x: x["new"],
        )

        def cut(at: Column) -> Column:
            def run(c: Column, k: Column) -> Column:
                size = F.coalesce(F.get(at, k + 1)["i"], F.size(all_lines)) - c["i"]
                return F.struct(c["level"].alias("level"), F.array_join(F.transform(F.slice(all_lines, c["i"] + 1, size), lambda x: x["words"]), "\n").alias("text"))

            return F.filter(F.transform(at, run), lambda x: x["level"] > 0)

        passages = F.get(F.transform(F.array(changes), cut), F.lit(0))
        return F.struct(
            F.regexp_replace(F.array_join(F.transform(own, lambda x: x["words"]), "\n"), r"^\s+|\s+$", "").alias("body"),
            F.coalesce(F.array_max(F.transform(all_lines, lambda x: x["level"])), F.lit(0)).alias("levels"),
            passages.alias("passages"),
        )

    return F.get(F.transform(F.array(lines), parts), F.lit(0))


def units(text: Column) -> Column:
    """Hashes of what a quote may have copied whole: the lines and the sentences of a text, normalised, and how
    long each is. Sentences run over line ends, so that wrapped quotes are found."""
    lines = F.split(text, r"\n")
    sentences = F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?])\s")
    normal = F.filter(F.transform(F.array_union(lines, sentences), _normal), lambda x: x != "")
    return F.transform(F.array_distinct(normal), lambda x: F.struct(F.xxhash64(x, F.length(x)).alias("hash"), F.length(x).alias("size")))


def linked(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conversation, turn, role, body, n_copies, quote_levels, n_passages, quoted_conversation, quoted_turn,
    reply_to (turn), thread (turn), reply_depth, reply_rank for each distinct message.

    A passage's origin is the earliest earlier turn of the same conversation that has the line or sentence
    in its own words, else the first message (by conversation and turn) of another conversation that has
    it. Only links within a conversation make replies. A message that quotes nothing begins a thread.
    reply_rank orders a conversation from 0: by thread, and in a thread by turn, so that a reply comes after
    what it answers.

    Rows equal in all four columns are one message, n_copies counts them. Null text: no words. Null
    conversations are one conversation; a null turn comes first and has no reply. Several messages with one
    turn: what one of them replies to, all do. Messages of any length are parsed whole, in memory of a few times
    their size. Empty table: no rows. Extra columns aren't read.
    """
    given = messages.select(F.col(conversation).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    once = given.groupBy("conv", "turn", "role", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.count("*").alias("n_copies"))
    rows = settle(once.select("conv", "turn", "role", "digest", "n_copies", parsed(F.col("text")).alias("p")), "messages")
    own = rows.select("conv", "turn", F.explode(units(F.col("p.body"))).alias("u")).select("conv", "turn", "u.hash")
    in_conversation = own.groupBy("conv", "hash").agg(F.min("turn").alias("first_turn"))
    # The first messages of two conversations: one of them isn't the asking one. Slices of a hash give theirs before they meet.
    sliced = Window.partitionBy("hash", F.pmod(F.xxhash64("conv"), F.lit(64))).orderBy(F.col("conv").asc_nulls_first())
    few = in_conversation.withColumn("_n", F.row_number().over(sliced)).where("_n <= 2")
    anywhere = few.groupBy("hash").agg(F.slice(F.sort_array(F.collect_list(F.struct("conv", F.col("first_turn").alias("turn")))), 1, 2).alias("firsts"))
    # Every passage is looked up; what each message copies from where is summed before any message is gathered.
    asked = rows.where("size(p.passages) > 0").select("conv", "turn", "digest", F.explode("p.passages").alias("q")).select("conv", "turn", "digest", "q.level", F.explode(units(F.col("q.text"))).alias("u")).select("conv", "turn", "digest", "level", "u.hash", "u.size")
    near = asked.join(in_conversation.withColumnsRenamed({"conv": "c", "hash": "h"}), (F.col("hash") == F.col("h")) & F.col("conv").eqNullSafe(F.col("c")), "left").drop("c", "h")
    both = near.join(anywhere, "hash", "left")
    here = F.col("first_turn") < F.col("turn")
    there = F.get(F.filter("firsts", lambda x: ~x["conv"].eqNullSafe(F.col("conv"))), F.lit(0))
    origin = F.when(here, F.struct(F.col("conv").alias("conv"), F.col("first_turn").alias("turn"))).otherwise(there)
    votes = both.select("conv", "turn", "digest", "level", "size", here.alias("here"), origin.alias("origin")).where("origin is not null")
    votes = votes.groupBy("conv", "turn", "digest", "here", "origin").agg(F.sum(F.when(F.col("level") == 1, F.col("size")).otherwise(0)).alias("outer"), F.sum("size").alias("size"))
    # Most of the outermost words wins, then a message of the same conversation, then the latest.
    best = votes.groupBy("conv", "turn", "digest").agg(F.max(F.struct("outer", F.coalesce("here", F.lit(False)).alias("here"), "size", "origin")).alias("best"))
    links = settle(best.select("conv", "turn", "digest", "best.origin", "best.here"), "quotes")
    nodes = _threads(links.where("here").groupBy("conv", "turn").agg(F.max("origin.turn").alias("to")))
    keys = lambda x, y, names: [x[n].eqNullSafe(y[n]) for n in names]
    a = rows.alias("a")
    joined = a.join(links, keys(rows, links, ("conv", "turn", "digest")), "left").select(*(rows[c] for c in rows.columns), "origin")
    full = joined.join(nodes.withColumnsRenamed({"conv": "c", "turn": "t"}), F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    full = full.withColumns({"thread": F.coalesce("root", "turn"), "reply_depth": F.coalesce("depth", F.lit(0)).cast("long")})
    return _ranked(full).select(
        F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), F.col("p.body").alias("body"), "n_copies", F.col("p.levels").alias("quote_levels"), F.size("p.passages").alias("n_passages"),
        F.col("origin.conv").alias("quoted_conversation"), F.col("origin.turn").alias("quoted_turn"), F.col("to").alias("reply_to"), "thread", "reply_depth", "reply_rank",
    )


def conversations(rows: DataFrame, conversation: str = "conv_id", most: int = _BLOCK) -> DataFrame:
    """conversation, part, messages: what linked() gives as reply-ordered conversations without quotes. messages
    is an array of (turn, role, body, reply_to) in reply order; a conversation of more than `most` messages is
    told in parts of so many, numbered from 0, so that none is gathered whole. Messages that repeat are one."""
    part = F.floor(F.col("reply_rank") / most).alias("part")
    said = F.struct("reply_rank", "turn", "role", "body", "reply_to")
    gathered = rows.groupBy(conversation, part).agg(F.sort_array(F.collect_list(said)).alias("all"))
    return gathered.select(conversation, "part", F.transform("all", lambda x: F.struct(*(x[n].alias(n) for n in ("turn", "role", "body", "reply_to")))).alias("messages"))


def _threads(links: DataFrame) -> DataFrame:
    """(conv, turn, to, root, depth) of links(conv, turn, to), to < turn: each round doubles how far a turn sees."""
    now = settle(links.select("conv", "turn", "to", F.col("to").alias("root"), F.lit(1).alias("depth")), "links")
    while True:
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("next"), F.col("depth").alias("more"))
        seen = now.join(up, F.col("conv").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t")), "left")
        after = settle(seen.select("conv", "turn", "to", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "links")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with reply_rank, their place in the conversation by (thread, turn): counted within blocks of turns
    and over the blocks, so that a very long conversation isn't gathered."""
    blocked = rows.withColumns({"_b": F.floor(F.coalesce("thread", F.lit(-1)) / _BLOCK), "_c": F.floor(F.coalesce("turn", F.lit(-1)) / _BLOCK)})
    # Threads of one block may interleave with each other's turns: a block of threads is ranked by thread and turn.
    keys = ["conv", "_b", "thread", "_c"]
    sizes = blocked.groupBy(*keys).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv", "_b").orderBy(F.col("thread").asc_nulls_first(), "_c")) - F.col("n"))
    blocks = before.groupBy("conv", "_b").agg(F.sum("n").alias("m")).withColumn("block_before", F.sum("m").over(Window.partitionBy("conv").orderBy("_b")) - F.col("m")).drop("m")
    at = before.join(blocks.withColumnsRenamed({"conv": "c", "_b": "b"}), F.col("conv").eqNullSafe(F.col("c")) & (F.col("_b") == F.col("b"))).select("conv", "_b", "thread", "_c", (F.col("before") + F.col("block_before")).alias("before"))
    at = at.toDF("c1", "b1", "t1", "c2", "before")
    within = blocked.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "role", "digest")) - 1)
    out = within.join(at, F.col("conv").eqNullSafe(F.col("c1")) & (F.col("_b") == F.col("b1")) & F.col("thread").eqNullSafe(F.col("t1")) & (F.col("_c") == F.col("c2")))
    return out.withColumn("reply_rank", (F.col("_r") + F.col("before")).cast("long"))
