"""Reply trees to conversations, with DataFrame functions only.

Messages name the message that they reply to. Root-to-leaf paths are found by self-joins that double: after round k every
message knows its ancestor 2**k steps up, and what lies between as a count, a sum of scores and a top; so a thread of
n replies takes log2(n) rounds of joins over two numbers a row. Each root's leaves are ranked by the mean score of their
paths. Only chosen leaves are spelt out: pairs (leaf, ancestor) double by the same steps. Texts are written once, already
marked and escaped, and meet the pairs in one join; one shuffle by leaf then lays a path's turns end to end.

The template is OPEN role MIDDLE text CLOSE for each turn. Within roles and texts a backslash is doubled, and every control
string, also those of other templates, gets one after its first character; a backslash before any character takes that
back, so turns() reads the exact roles and texts again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.shared import drop, written

OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that a tokenizer may take for marks; none is left whole inside a role or text.
CONTROL = [OPEN, MIDDLE, CLOSE, "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|eot_id|>", "<bos>", "<eos>"]
SPLIT = "(" + "|".join(re.escape(x[0]) + "(?=" + re.escape(x[1:]) + ")" for x in CONTROL) + ")"


def escaped(text: Column) -> Column:
    """The text with no control string whole; null is empty. Marks are told by looking ahead, so none is hidden by one before it."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), SPLIT, "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of plain conversations: each row replies to the one before it by turn (ties by role, then text)."""
    return rows.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(0.0).alias("score"))


def replies(rows: DataFrame, tree: str = "conv_id", node: str = "id", parent: str = "parent", role: str = "role", text: str = "text", score: str = "score") -> DataFrame:
    """Messages of reply trees: parent names the node of the same tree that a message replies to."""
    return rows.select(F.col(tree).alias("tree"), F.col(node).alias("id"), F.col(parent).alias("parent"), F.col(role).alias("role"), F.col(text).alias("text"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))


def _written_messages(messages: DataFrame) -> DataFrame:
    """Each message with a number of its own, fixed by being written, and its turn as it will stand in the output."""
    role, said = escaped(F.col("role")), escaped(F.col("text"))
    piece = F.concat(F.lit(OPEN), role, F.lit(MIDDLE), said, F.lit(CLOSE))
    names = [c for c in messages.columns if c != "text"]
    rows = messages.select(F.monotonically_increasing_id().alias("uid"), *names, F.xxhash64("role", "text").alias("tie"), (F.char_length(role) + len(OPEN) + len(MIDDLE)).alias("head"), piece.alias("piece"))
    return written(rows.withColumn("size", F.char_length("piece").cast("long")), "messages")


def _pointers(said: DataFrame) -> DataFrame:
    """(uid, up, score): the message that each replies to, null for a root."""
    if "turn" in said.columns:
        by = Window.partitionBy("tree").orderBy("turn", "role", "tie", "uid")
        return said.select("uid", F.lag("uid").over(by).alias("up"), "score")
    named = said.where("id is not null").groupBy("tree", "id").agg(F.min_by("uid", F.struct("tie", "uid")).alias("up"))
    named = named.select(F.col("tree").alias("of"), F.col("id").alias("at"), "up")
    same = F.col("tree").eqNullSafe(F.col("of")) & (F.col("parent") == F.col("at"))
    return said.join(named, same, "left").select("uid", "up", "score")


def paths(pointers: DataFrame, best: int | None) -> DataFrame:
    """(leaf, uid, place, rank, total): every message of each chosen root-to-leaf path, place counted from the leaf, and
    the path's rank among its root's by mean score (ties: the leaf of the lesser number)."""
    begun = written(pointers, "pointers")
    many = begun.count()
    now = begun.select("uid", "up", F.lit(1).cast("long").alias("n"), F.col("score").alias("total"), F.col("uid").alias("top"))
    steps, made = [], [begun]
    for k in range(max(1, many.bit_length() + 1)):
        now = written(now, "ends")
        made.append(now)
        on = written(now.where("up is not null").select("uid", "up"), "steps")
        made.append(on)
        if on.isEmpty():
            break
        steps.append(on)
        above = now.select(F.col("uid").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("total").alias("total2"), F.col("top").alias("top2"))
        more = now.where("up is not null").join(above, "up").select("uid", F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), (F.col("total") + F.col("total2")).alias("total"), F.col("top2").alias("top"))
        now = now.where("up is null").unionByName(more)
    whole = now.where("up is null")  # what never ends hangs on a cycle
    leaves = whole.join(begun.where("up is not null").select(F.col("up").alias("uid")).distinct(), "uid", "left_anti")
    mean = F.col("total") / F.col("n")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("top").orderBy(F.desc(mean), "uid")))
    chosen = ranked if best is None else ranked.where(F.col("rank") <= best)
    pairs = chosen.select(F.col("uid").alias("leaf"), "uid", F.lit(0).cast("long").alias("place"), "rank", mean.alias("mean"))
    for k, on in enumerate(steps):
        further = pairs.join(on, "uid").select("leaf", F.col("up").alias("uid"), (F.col("place") + (1 << k)).alias("place"), "rank", "mean")
        pairs = written(pairs.unionByName(further), "pairs")
        made.append(pairs)
    out = pairs if steps else written(pairs, "pairs")
    drop(*(x for x in made if x is not out))
    return out


def formatted(messages: DataFrame, best: int | None = None, loss: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen root-to-leaf path of linear() or replies(): tree, leaf, rank, mean (score), formatted, turns: an
    array of (start, end, from, to, loss) in code points of formatted, end exclusive: where a turn and its text stand, and
    whether the loss counts it.

    `best`: how many paths of each root, all if None. A null text or role is empty. A reply to no message of its tree is
    a root. Of messages that repeat a node the one of least hash is replied to, each being a message of its own; a null
    node can't be replied to; a null tree is a tree like others. Messages on or under a cycle have no path from a root and
    aren't returned. Rows without turn order come first. Other columns are ignored; an empty table gives no rows.
    """
    said = _written_messages(messages)
    chosen = paths(_pointers(said), best)
    turn = said.select("uid", "tree", "role", "head", "piece", "size")
    rows = chosen.join(turn, "uid").withColumn("place", -F.col("place"))
    end = F.sum("size").over(Window.partitionBy("leaf").orderBy("place"))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    spot = F.struct("place", "piece", F.struct("start", "end", (F.col("start") + F.col("head")).alias("from"), (F.col("end") - len(CLOSE)).alias("to"), F.coalesce(F.col("role").isin(*loss), F.lit(False)).alias("loss")).alias("at"))
    whole = rows.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.first("mean").alias("mean"), F.array_sort(F.collect_list(spot)).alias("x"))
    return whole.select("tree", "leaf", "rank", "mean", F.array_join("x.piece", "").alias("formatted"), F.col("x.at").alias("turns"))


def turns(text: Column) -> Column:
    """(role, text) of every turn of a formatted conversation, read back."""
    pieces = F.filter(F.split(text, re.escape(CLOSE), -1), lambda p: p != "")
    halves = F.transform(pieces, lambda p: F.split(F.substring(p, len(OPEN) + 1, 2147483647), re.escape(MIDDLE), -1))
    return F.transform(halves, lambda h: F.struct(unescaped(F.get(h, F.lit(0))).alias("role"), unescaped(F.get(h, F.lit(1))).alias("text")))


def under_loss(text: Column, spots: Column) -> Column:
    """The texts that the mask covers, in order, unescaped."""
    pieces = F.split(text, f"(?<={re.escape(CLOSE)})", -1)
    both = F.zip_with(F.slice(pieces, 1, F.size(spots)), spots, lambda p, s: F.when(s.loss, unescaped(F.substr(p, (s["from"] - s.start + 1).cast("int"), (s.to - s["from"]).cast("int")))))
    return F.filter(both, lambda x: x.isNotNull())
