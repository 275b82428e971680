"""Operator 6: chat formatting from reply trees.

Turns are nodes of reply trees. Self-joins that double their reach each time give every node its distance from the root
and the mean score along its path; leaves are ranked within their conversation and the best ``branches`` are kept; a
second run over the same joins lists the turns of the chosen paths, which become one conversation each. A tree of
depth d takes log2(d) joins, so a conversation of hundreds of turns is no trouble.

Template: ``### role: text</turn>`` and a newline per turn. In roles and texts a backslash stands before each backslash,
``#`` and ``<`` (in roles also before ``:``), so no control string can occur inside; a backslash makes the next character
plain again. The loss mask covers the texts of assistant turns, not their marks.

Null text or role: empty. Turns without a conversation's id form one conversation of that id. A turn without a node is left
out; of several rows of one node the least (by parent, role, text, score) counts. A reply to a missing turn is a root.
Turns on a cycle reach no root and are left out. Ties between branches go to the longer path, then to the smaller leaf. A
table without turns gives no conversation. A conversation is one row at last, so it is one task's work to write it out.

Paths are found over nodes without their texts. Texts are shuffled to the places of their turns afterwards, once where a
whole conversation is one path (:func:`conversations_in_order`), else first by node and then, those on a path, by path.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.durable import discard, written

SPECIAL = re.compile(r"[\\#<]")
SPECIAL_ROLE = re.compile(r"[\\#<:]")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
END = "</turn>\n"
LEARNED = "assistant"


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) turns, and the spans of code points under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"### {SPECIAL_ROLE.sub(r'\\\g<0>', role)}: "
        body = SPECIAL.sub(r"\\\g<0>", text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def plain(text: str) -> str:
    """The text before it was escaped."""
    return ESCAPED.sub(r"\1", text)


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        found = TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append((plain(found[1]), plain(found[2])))
        at = found.end()
    return turns


def linear(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Reply trees of plain conversations: each turn replies to the one before; ties by role and text."""
    order = Window.partitionBy(conv_col).orderBy(turn_col, "role", "text")
    rows = conversations.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col(conv_col).alias("conv"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(trees: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, leaf, rank, node, above) of the best root-to-leaf paths of trees (conv, node, parent, score), a row per node.

    ``above``: turns between the node and the leaf; the leaf has 0.
    """
    nodes = trees.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("known"))
    nodes = nodes.join(known, ["conv", "parent"], "left")
    step = written(nodes.select("conv", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "jumps")
    parents = step.where("up is not null").select("conv", F.col("up").alias("node")).distinct()
    leaves = step.select("conv", "node").join(parents, ["conv", "node"], "left_anti")
    rooted, below = step.where("up is null"), step.where("up is not null")  # only those below a root take part in a round
    steps, jumps, still = [step], [], below.count()
    while still:
        jumps.append(below.select("conv", "node", "up"))
        above = rooted.unionAll(below).select("conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        far = below.join(above, ["conv", "up"])
        step = written(far.select("conv", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth")), "jumps")
        steps.append(step)
        rooted, below, before = rooted.unionAll(step.where("up is null")), step.where("up is not null"), still
        still = below.count()
        if still == before and 1 << len(jumps) > still:
            break  # what is left runs in circles
    ranked = leaves.join(rooted, ["conv", "node"])
    order = Window.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    paths = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches).select("conv", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("above"))
    paths = shorter = written(paths, "paths")
    for k in reversed(range(len(jumps))):
        paths = paths.unionAll(paths.join(jumps[k], ["conv", "node"]).select("conv", "leaf", "rank", F.col("up").alias("node"), F.col("above") + F.lit(1 << k)))
        longer = written(paths, "paths")
        discard(shorter)
        paths = shorter = longer
    discard(*steps)
    return paths


def conversations_of(trees: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, leaf, rank, formatted, loss_spans): one formatted conversation per chosen path of trees (conv, node,
    parent, role, text, score)."""
    trees = trees.where("node is not null").select(_known("conv"), "node", "parent", "role", "score", "text")
    rows = trees.groupBy("conv", "node").agg(F.min(F.struct("parent", "role", "score")).alias("row"))
    paths = best_paths(written(rows.select("conv", "node", "row.parent", "row.score"), "nodes"), branches)
    paths = paths.select("conv", F.col("node").alias("key"), "leaf", "rank", (-F.col("above")).alias("place"))
    return _formatted_paths(paths, trees.select("conv", F.col("node").alias("key"), F.struct("parent", "role", "score", "text").alias("turn")))


def conversations_in_order(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, leaf, rank, formatted, loss_spans) of plain conversations, as of the trees of :func:`linear`.

    Turns are numbered by their keys (turn, role, hash of the text); those that agree in turn and role share a place and
    are put in order of their texts when these arrive."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(_known(conv_col), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(text).alias("h")).alias("key"), F.struct(role.alias("role"), text.alias("text")).alias("turn"))
    within = Window.partitionBy("conv")
    number, place = F.row_number().over(within.orderBy("key")).cast("long"), F.rank().over(within.orderBy("key.turn", "key.role"))
    nodes = rows.select("conv", "key", number.alias("node"), (number - place).alias("back"))
    nodes = written(nodes.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)}), "nodes")
    paths = best_paths(nodes.select("conv", "node", "parent", "score")).join(nodes.select("conv", "node", "key", "back"), ["conv", "node"])
    paths = paths.select("conv", "key", "leaf", "rank", (-F.col("above") - F.col("back")).alias("place"))
    return _formatted_paths(paths, rows.select("conv", "key", "turn"), together=True)


def _known(conv_col: str) -> Column:
    return F.struct(F.col(conv_col).alias("id")).alias("conv")  # equal to itself where the id is null


def _formatted_paths(paths: DataFrame, texts: DataFrame, together: bool = False) -> DataFrame:
    """The conversations of paths (conv, key, leaf, rank, place) with texts (conv, key, turn); of several turns of one key
    the least counts. ``together``: all turns of a conversation are on one path, so texts go to its task at once."""
    at = F.struct("leaf", "rank", "place")
    places = paths.select("conv", "key", at.alias("at"), F.lit(None).cast(texts.schema["turn"].dataType).alias("turn"))
    rows = places.unionByName(texts.withColumn("at", F.lit(None).cast(places.schema["at"].dataType)))
    turns = (rows.repartition("conv") if together else rows).groupBy("conv", "key").agg(F.collect_list("at").alias("at"), F.min("turn").alias("turn"))
    turn = F.struct("at.place", F.coalesce("turn.role", F.lit("")).alias("role"), F.coalesce("turn.text", F.lit("")).alias("text"))
    turns = turns.select("conv", F.explode("at").alias("at"), "turn").select("conv", "at.leaf", "at.rank", turn.alias("turn"))
    turns = turns.groupBy("conv", "leaf", "rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    turns = turns.select("conv.id", "leaf", "rank", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    kind = turns.schema["id"].dataType.simpleString()
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    span_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def run(batches):
        for batch in batches:
            made = [formatted(list(zip(r.as_py(), t.as_py(), strict=True))) for r, t in zip(batch.column(3), batch.column(4), strict=True)]
            spans = [[{"s": s, "e": e} for s, e in x] for _, x in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([t for t, _ in made], pa.string()), pa.array(spans, span_type)], ["conv", "leaf", "rank", "formatted", "loss_spans"])

    return turns.mapInArrow(run, f"conv {kind}, leaf {kinds['leaf']}, rank int, formatted string, loss_spans array<struct<s:long,e:long>>")


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of what formatted conversations (conv, formatted, loss_spans) hold, taken from the output alone."""
    schema = f"conv {conversations.schema['conv'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parsed(text)
                learned = "".join(plain(text[x["s"] : x["e"]]) for x in spans)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), _hex(whole), len(learned), _hex(learned), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return conversations.select("conv", "formatted", "loss_spans").mapInArrow(run, schema)


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
