"""Chat formatting over a prefix tree of conversations.

Conversations that begin with the same turns share the nodes of these turns. The tree is laid out
depth first in one token stream (a token is a code point of the formatted text): shared turns are
emitted once, every node knows the position ids of its tokens (its distance from the root, as if the
conversation stood alone) and the stream intervals of its ancestors, which are all it may attend to.

Depth-first order is the order of (first conversation through a node, depth), with conversations
sorted by their paths; both orders are numbered in range partitions. Where turns meet their nodes, those of a node with more than
HOT conversations are salted, a part of HOT each, and the node is repeated for each part: a first turn that a third of
all conversations share makes no large task. There are at most (turns / HOT) such nodes, and only they are broadcast.

Template: system <<SYS>>...<</SYS>>, user [INST]...[/INST], assistant <s>...</s>, any other role
<<ROLE>>role<<TEXT>>...<</ROLE>>. Inside texts and roles a backslash goes before each backslash, < and
[, so no text can hold a control string, and reading back undoes it.

Semantics: null text and null role are empty; turns sort by turn, role, text, null turns first, so repeated rows are
turns of their own; a row without a conv_id is a conversation of its own; texts are formatted whole, whatever their length; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, global_order, map_batches

HOT = 50_000
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_BODY = r"([^\\<\[]*(?:\\.[^\\<\[]*)*)"
_TURN = re.compile(rf"(<<SYS>>|\[INST\]|<s>|<<ROLE>>{_BODY}<<TEXT>>){_BODY}(?:<</SYS>>|\[/INST\]|</s>|<</ROLE>>)", re.DOTALL)
_ROLE = {a: role for role, (a, _) in MARKS.items()}


def escape(text: str) -> str:
    return re.sub(r"([\\<\[])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the interval of its text that bears loss (empty unless the assistant's)."""
    a, b = MARKS.get(role) or (f"<<ROLE>>{escape(role)}<<TEXT>>", "<</ROLE>>")
    body = escape(text)
    return a + body + b, len(a), len(a) + (len(body) if role == "assistant" else 0)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((_ROLE.get(m[1]) or unescape(m[2] or ""), unescape(m[3])))
        at = m.end()
    return out


def _render_all(batch: pa.RecordBatch) -> pa.RecordBatch:
    turns = []
    for conv in batch.column(1).to_pylist():
        key, at, out = b"", 0, []
        for t in conv:
            role, text = t["role"] or "", t["text"] or ""
            seg, a, b = render(role, text)
            key = hashlib.blake2b(key + seg.encode(), digest_size=16).digest()
            out.append({"key": key.hex(), "seg": seg, "position": at, "loss_from": a, "loss_to": b})
            at += len(seg)
        turns.append(out)
    kind = pa.list_(pa.struct([("key", pa.string()), ("seg", pa.string()), ("position", pa.int64()), ("loss_from", pa.int64()), ("loss_to", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, kind)], names=["conv_id", "turns"])


def build_tree(conversations: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths). nodes: node, tree_start, depth, start, n_tokens, position (of its first token), text,
    loss_from, loss_to (within the node), attends (stream intervals of its ancestors, root first).
    paths: conv_no, conv_id, spans (the stream intervals that make up the conversation, in order)."""
    scratch = scratch or Scratch(conversations.sparkSession, "chat")
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    convs = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), alone, F.struct("turn", "role", "text").alias("t")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("t")).drop("alone")
    schema = "conv_id long, turns array<struct<key:string,seg:string,position:bigint,loss_from:bigint,loss_to:bigint>>"
    rendered = map_batches(convs, _render_all, schema).withColumn("path", F.transform("turns", lambda t: t["key"]))
    ordered = scratch.save(global_order(rendered, ["path", "conv_id"], scratch).select(F.col("rank").alias("conv_no"), "conv_id", "turns"))
    turns = ordered.select("conv_no", F.posexplode("turns").alias("depth", "t")).select("conv_no", "depth", F.col("t.key").alias("node"), "t")
    first = scratch.save(turns.groupBy("node").agg(F.min("conv_no").alias("first"), F.ceil(F.count("*") / HOT).cast("int").alias("parts")))
    hot = scratch.save(first.where("parts > 1").select("node", "parts"))
    part = F.pmod("conv_no", F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    turns = turns.join(F.broadcast(hot), "node", "left").select("conv_no", "depth", "node", "t", part)  # at most turns / HOT rows
    parted = first.select("node", "first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = turns.join(parted, ["node", "part"]).where("conv_no = first").select("node", "conv_no", "depth", F.length("t.seg").cast("long").alias("n_tokens"), "t.position", "t.loss_from", "t.loss_to", F.col("t.seg").alias("text"))
    nodes = scratch.save(global_order(own, ["conv_no", "depth"], scratch, weight="n_tokens").drop("rank").withColumnRenamed("before", "start"))
    places = nodes.join(first.select("node", "parts"), "node").select("node", "start", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    spans = turns.select("conv_no", "depth", "node", "part").join(places, ["node", "part"])
    span = F.struct("depth", F.col("start").alias("from"), (F.col("start") + F.col("n_tokens")).alias("to"))
    paths = scratch.save(spans.groupBy("conv_no").agg(F.sort_array(F.collect_list(span)).alias("spans")).join(ordered.select("conv_no", "conv_id"), "conv_no"))
    around = nodes.join(paths.select("conv_no", "spans"), "conv_no")
    pairs = F.transform("spans", lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to")))
    tree = around.select(
        "node", F.get("spans", F.lit(0))["from"].alias("tree_start"), "depth", "start", "n_tokens", "position", "text", "loss_from", "loss_to",
        F.slice(pairs, F.lit(1), F.col("depth")).alias("attends"),
    )
    return scratch.save(tree), paths


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the stream alone."""
    spans = paths.select("conv_no", "conv_id", F.explode("spans").alias("s")).select("conv_no", "conv_id", F.col("s.depth").alias("depth"), F.col("s.from").alias("start"))
    hot = spans.groupBy("start").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1")
    spans = spans.join(F.broadcast(hot), "start", "left").withColumn("part", F.pmod("conv_no", F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")  # at most turns / HOT rows
    emitted = nodes.join(F.broadcast(hot), "start", "left").select("start", "text", "loss_from", "loss_to", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    parts = spans.join(emitted, ["start", "part"])
    whole = parts.groupBy("conv_no", "conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "text", "loss_from", "loss_to"))).alias("p"))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for p in batch.column(1).to_pylist():
            turns = parse("".join(x["text"] for x in p))
            loss = [unescape(x["text"][x["loss_from"] : x["loss_to"]]) for x in p]
            told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            out.append((len(turns), told, sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), sum(len(x["text"]) for x in p)))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_batches(whole.select("conv_id", "p"), digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
