import random
import re
from collections import Counter, defaultdict

from tenderspring.llm import quotes

MESSAGES = [
    (1, 0, "user", "Hello there. How are you?\nI have a question about boats."),
    (1, 1, "assistant", "On Monday, Ann wrote:\n> I have a question\n> about boats.\nAsk away."),
    (1, 2, "user", "Unrelated start of another thread."),
    (1, 3, "user", "> Ask away.\n>> I have a question\n>> about boats.\nDo they float?"),
    (1, 4, "assistant", "> unrelated  START of another thread.\nYes."),
    (2, 0, "user", "> Do they float?\nForwarded"),
    (2, 1, "user", None),
    (2, 1, "user", None),
    (None, None, None, "> x"),
    (3, 0, "user", ""),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_links_and_order(spark):
    rows = {(r.conv_id, r.turn): r for r in quotes.linked(spark.createDataFrame(MESSAGES, SCHEMA)).collect()}
    assert rows[1, 1].body == "Ask away." and rows[1, 1].reply_to == 0 and rows[1, 1].quote_levels == 1
    assert (rows[1, 3].reply_to, rows[1, 3].thread, rows[1, 3].reply_depth, rows[1, 3].n_passages) == (1, 0, 2, 2)
    assert rows[1, 4].reply_to == 2 and rows[1, 4].body == "Yes."
    assert [rows[1, t].reply_rank for t in (0, 1, 3, 2, 4)] == [0, 1, 2, 3, 4]
    assert (rows[2, 0].quoted_conversation, rows[2, 0].quoted_turn, rows[2, 0].reply_to) == (1, 3, None)
    assert rows[2, 1].n_copies == 2 and rows[2, 1].body == ""
    assert rows[None, None].quoted_turn is None and rows[3, 0].body == ""


def test_unquoted_text_stays_whole(spark):
    rows = quotes.linked(spark.createDataFrame([(5, 0, "a", "one > two\n three wrote:"), (5, 1, "b", "plain")], SCHEMA)).orderBy("turn").collect()
    assert [r.body for r in rows] == ["one > two\n three wrote:", "plain"] and [r.reply_rank for r in rows] == [0, 1]


def test_a_common_line_links_to_its_first_message(spark):
    many = [(9, k, "u", "Thanks a lot.") for k in range(50)] + [(9, 50, "u", "> Thanks a lot.\nWelcome")]
    last = quotes.linked(spark.createDataFrame(many, SCHEMA)).where("turn = 50").first()
    assert last.reply_to == 0


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quotes.linked(empty).count() == 0
    extra = spark.createDataFrame([(1, 0, "u", "hi", "x", 3)], SCHEMA + ", body string, thread int")
    assert quotes.linked(extra).first().body == "hi"


def test_a_quote_of_what_comes_later_here_links_to_another_conversation(spark):
    rows = [(1, 0, "u", "> Same words.\nFirst"), (1, 1, "u", "Same words."), (2, 4, "u", "Same words."), (2, 6, "u", "Same words."), (3, 0, "u", "Same words."), (4, 0, "u", "> Same words.\nLast")]
    got = {(r.conv_id, r.turn): (r.quoted_conversation, r.quoted_turn, r.reply_to) for r in quotes.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 0] == (2, 4, None) and got[4, 0] == (1, 1, None)


MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")


def normal(x):
    return re.sub(r"\s+", " ", x.lower()).strip(" ")


def pieces(text):
    """The normalised lines and sentences of a text."""
    found = text.split("\n") + re.split(r"(?<=[.!?])\s", re.sub(r"\s+", " ", text))
    return {n for n in map(normal, found) if n}


def read(text):
    """(body, deepest level, [(level, passage)]) by plain loops; attributions are lines that end in "wrote:"."""
    levels, own, passages = [], [], []
    for line in (text or "").split("\n"):
        m = MARK.match(line)
        level = m[1].count(">") if m else 0
        bare = line[m.end() :] if m else line
        levels.append(level)
        if level and passages and levels[-2:] == [level, level]:
            passages[-1][1].append(bare)
        elif level:
            passages.append((level, [bare]))
        else:
            own.append(bare)
    if max(levels) > 0:
        own = [x for x in own if not re.match(r"on .* wrote:$", x.strip(), re.I)]
    return re.sub(r"^\s+|\s+$", "", "\n".join(own)), max(levels), [(level, "\n".join(x)) for level, x in passages]


def brute(messages):
    """linked() by plain loops for conversations with one message a turn: (conv, turn) -> its row."""
    parsed = {(c, t): read(text) for c, t, _, text in messages}
    held = defaultdict(set)
    for (c, t), (body, _, _) in parsed.items():
        for u in pieces(body):
            held[u].add((c, t))
    out = {}
    for (c, t), (body, level, passages) in sorted(parsed.items()):
        votes = defaultdict(Counter)
        for depth, passage in passages:
            for u in pieces(passage):
                here = sorted(x for x in held[u] if x[0] == c)
                there = sorted(x for x in held[u] if x[0] != c)
                if here and here[0][1] < t:
                    origin = (True, here[0])
                elif there:
                    origin = (False, there[0])
                else:
                    continue
                votes[origin]["size"] += len(u)
                votes[origin]["outer"] += len(u) * (depth == 1)
        best = max(((v["outer"], here, v["size"], at) for (here, at), v in votes.items()), default=None)
        to = best[3][1] if best and best[1] else None
        before = out.get((c, to), {}) if to is not None else {}
        out[c, t] = {"body": body, "quote_levels": level, "n_passages": len(passages), "quoted": best[3] if best else None, "reply_to": to, "thread": before.get("thread", t), "reply_depth": before["reply_depth"] + 1 if before else 0}
    for c in {k[0] for k in out}:
        for rank, k in enumerate(sorted((k for k in out if k[0] == c), key=lambda k: (out[k]["thread"], k[1]))):
            out[k]["reply_rank"] = rank
    return out


def made(r, n_conversations=60):
    """Conversations whose messages quote earlier ones, here or elsewhere, whole or in part, wrapped anew, in up
    to three levels, with attributions; with lines that many messages share."""
    words = [f"{a}{b}" for a in "ba co du fe gi ho".split() for b in "ran sel tin mor".split()]
    sentence = lambda: " ".join(r.choice(words) for _ in range(r.randint(3, 14))).capitalize() + r.choice(".?!")
    common, said, out = ["Thanks a lot.", "Best regards,", "See you soon!"], [], []
    for c in range(n_conversations):
        here = []
        for t in range(r.randint(1, 12)):
            own = [" ".join(sentence() for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 3))] + ([r.choice(common)] if r.random() < 0.4 else [])
            lines = []
            if (here or said) and r.random() < 0.7:
                source = r.choice(here) if here and r.random() < 0.8 else r.choice(said or here)
                part = source.split("\n")
                if r.random() < 0.3:
                    part = part[: r.randint(1, len(part))]
                if r.random() < 0.4:  # wrapped anew: sentences run over the lines
                    flat = " ".join(part)
                    part = re.findall(r".{1,40}(?:\s|$)", flat)
                if r.random() < 0.3:
                    lines.append("On Monday, somebody wrote:")
                lines += [(">" if x.startswith(">") else "> ") + x.rstrip() for x in part]
            text = "\n".join(lines + own if r.random() < 0.8 else own + lines)
            here.append(text)
            out.append((c, t, r.choice(["user", "assistant"]), text))
        said += here
    return out


def test_generated_conversations_against_brute_force(spark):
    messages = made(random.Random(11))
    want = brute(messages)
    assert sum(x["quoted"] is not None for x in want.values()) > 100 and max(x["quote_levels"] for x in want.values()) >= 3
    assert sum(x["reply_to"] is None and x["quoted"] is not None for x in want.values()) > 5
    rows = quotes.linked(spark.createDataFrame(messages, SCHEMA)).collect()
    got = {(r.conv_id, r.turn): {"body": r.body, "quote_levels": r.quote_levels, "n_passages": r.n_passages, "quoted": None if r.quoted_turn is None else (r.quoted_conversation, r.quoted_turn), "reply_to": r.reply_to, "thread": r.thread, "reply_depth": r.reply_depth, "reply_rank": r.reply_rank} for r in rows}
    assert len(rows) == len(messages) and got == want


def test_conversations_come_whole_in_reply_order(spark):
    rows = quotes.linked(spark.createDataFrame(MESSAGES, SCHEMA))
    got = {(r.conv_id, r.part): [(m.turn, m.body) for m in r.messages] for r in quotes.conversations(rows, most=4).collect()}
    assert [t for t, _ in got[1, 0]] == [0, 1, 3, 2] and got[1, 1] == [(4, "Yes.")] and got[2, 0] == [(0, "Forwarded"), (1, "")]


def test_a_very_long_message_is_read_whole(spark):
    long = "\n".join(f"> line {k} of it" for k in range(30_000)) + "\nmine"
    rows = {r.turn: r for r in quotes.linked(spark.createDataFrame([(1, 0, "u", "line 29999 of it"), (1, 1, "u", long)], SCHEMA)).collect()}
    assert rows[1].body == "mine" and rows[1].reply_to == 0 and rows[1].n_passages == 1
