"""Chat formatting into a prefix tree that holds shared turns once.

Conversations that begin with the same turns share the nodes of those turns. The packed output is
the tree in depth-first order: every node is one formatted turn with its place in the packed
sequence, the position id of its first token (tokens of its ancestors) and the intervals of the
packed sequence that it attends to besides itself: its ancestors. The token unit is the code point.

Depth-first order is a sort: with one digest per turn, conversations sorted by their digest path are
in pre-order, and a conversation adds exactly the turns behind its longest common prefix with the
conversation before it. So the paths (16 bytes a turn) are range-partitioned and sorted, and each
task walks its range. What a range needs from those before it is the stack at its start; stacks are
chained on the driver from one summary row per partition, never per conversation. A first turn that
a third of all conversations share is one node, and its conversations lie in many ranges.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts a backslash follows every ``<`` and
``[``, so no control string can occur in them; removing it restores the text.

Defined results: NULL role or text is empty; turns are ordered by (turn, role, text), NULL first,
and equal rows are separate turns; rows with NULL ``conv_id`` form one conversation with a NULL id;
an empty table gives an empty result; other columns are ignored. One conversation is the largest
unit of work, as one text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procsig.llm.registry import register
from procsig.session import cut_lineage
from procsig.sources.tables import table

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
_NODES = "array<struct<idx:int,start:bigint,n:bigint,position:bigint,ancestors:array<struct<start:bigint,end:bigint>>>>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<"))


def escape_role(c: Column) -> Column:
    """Roles also lose their line breaks: ``[`` never stands before ``n`` in an escaped text."""
    return F.replace(escape(c), F.lit("\n"), F.lit("[n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("[n"), F.lit("\n")))


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, idx`` (from 0), ``role, segment, n_tokens, digest, loss_start, loss_chars``."""
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    idx = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    body = escape(F.col("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    t = t.select("conv_id", idx.alias("idx"), "role", F.concat(head, body, F.lit(END)).alias("segment"),
                 F.when(F.col("role") == LOSS_ROLE, F.char_length(head)).alias("loss_start"),
                 F.when(F.col("role") == LOSS_ROLE, F.char_length(body)).alias("loss_chars"))
    return t.select("*", F.char_length("segment").cast("long").alias("n_tokens"), F.md5(F.col("segment").cast("binary")).alias("digest"))


def _common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Walk:
    """Pre-order walk over sorted paths: the stack holds (digest, start, length) of the current path."""

    def __init__(self, stack: list[tuple[str, int, int]], at: int):
        self.stack, self.at = list(stack), at

    def step(self, digests: list[str], lengths: list[int]) -> int:
        shared = _common([s[0] for s in self.stack], digests)
        del self.stack[shared:]
        for d, n in zip(digests[shared:], lengths[shared:]):
            self.stack.append((d, self.at, n))
            self.at += n
        return shared


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition: its first path and its last stack, as if nothing came before."""
    walk, first, pid = _Walk([], 0), None, None
    for b in batches:
        for p, ds, ns in zip(*(b.column(c).to_pylist() for c in ("pid", "digests", "lengths"))):
            if first is None:
                first, pid = (ds, ns), p
            walk.step(ds, ns)
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([pid], pa.int32()), pa.array([walk.at], pa.int64()), pa.array([first[0]], pa.list_(pa.string())),
             pa.array([first[1]], pa.list_(pa.int64())), pa.array([[s[0] for s in walk.stack]], pa.list_(pa.string())),
             pa.array([[s[1] for s in walk.stack]], pa.list_(pa.int64())), pa.array([[s[2] for s in walk.stack]], pa.list_(pa.int64()))],
            names=["pid", "total", "first_digests", "first_lengths", "digests", "starts", "lengths"])


def chain_summaries(rows: list) -> dict[int, tuple[list, int]]:
    """Per partition, the stack and the packed length before it."""
    carry: list[tuple[str, int, int]] = []
    at, out = 0, {}
    for r in sorted(rows, key=lambda r: r["pid"]):
        out[r["pid"]] = (carry, at)
        shared = _common([s[0] for s in carry], r["first_digests"])
        known = sum(r["first_lengths"][:shared])  # tokens of the first path that lie in earlier partitions
        stack = []
        for depth, (d, s, n) in enumerate(zip(r["digests"], r["starts"], r["lengths"])):
            stack.append(carry[depth] if s < known else (d, at + s - known, n))
        carry, at = stack, at + r["total"] - known
    return out


def _layout(before: dict[int, tuple[list, int]]):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for b in it:
            ids, starts, nodes = [], [], []
            for p, conv, ds, ns in zip(*(b.column(c).to_pylist() for c in ("pid", "conv_id", "digests", "lengths"))):
                if walk is None:
                    walk = _Walk(*before[p])
                shared = walk.step(ds, ns)
                spans: list[dict] = []
                own, position = [], 0
                for i, (_, s, n) in enumerate(walk.stack):
                    if i >= shared:
                        own.append({"idx": i, "start": s, "n": n, "position": position, "ancestors": [dict(x) for x in spans]})
                    if spans and spans[-1]["end"] == s:
                        spans[-1]["end"] = s + n
                    else:
                        spans.append({"start": s, "end": s + n})
                    position += n
                ids.append(conv), starts.append([s for _, s, _ in walk.stack]), nodes.append(own)
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            node = pa.struct([("idx", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("position", pa.int64()),
                              ("ancestors", pa.list_(span))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.list_(pa.int64())),
                                              pa.array(nodes, pa.list_(node))], names=["conv_id", "starts", "nodes"])
    return batches


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conversations(conv_id, turn, role, text)`` -> (nodes, references).

    nodes: ``start, n_tokens, position, depth, role, segment, loss_start, loss_chars, ancestors``;
    loss offsets are code points inside the segment (NULL outside the loss role). references:
    ``conv_id, idx, start``: which node holds a conversation's turn.
    """
    conv = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    turns = cut_lineage(formatted_turns(conv))
    paths = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "n_tokens"))).alias("p"))
    paths = paths.select("conv_id", F.col("p.digest").alias("digests"), F.col("p.n_tokens").alias("lengths"),
                         F.array_join("p.digest", "").alias("path"))
    ranged = cut_lineage(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
                         .select("conv_id", "digests", "lengths", F.spark_partition_id().alias("pid")))
    summary = ranged.mapInArrow(_summaries, "pid int, total bigint, first_digests array<string>, first_lengths array<bigint>, "
                                            "digests array<string>, starts array<bigint>, lengths array<bigint>").collect()
    layout = cut_lineage(ranged.mapInArrow(_layout(chain_summaries(summary)),
                                           f"conv_id bigint, starts array<bigint>, nodes {_NODES}"))
    own = layout.select(F.col("conv_id").alias("owner"), F.explode("nodes").alias("node"))
    nodes = (turns.join(own, turns["conv_id"].eqNullSafe(own["owner"]) & (turns["idx"] == own["node.idx"]))
             .select("node.start", "n_tokens", "node.position", F.col("idx").alias("depth"), "role", "segment", "loss_start",
                     "loss_chars", "node.ancestors"))
    refs = layout.select("conv_id", F.posexplode("starts").alias("idx", "start"))
    return nodes, refs


def read_back(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Conversations from the packed output: ``conv_id`` and ``turns`` (role, text, segment, loss text).

    Shared nodes are probed by many conversations; the reference side of that join is the skewed
    one and Spark splits it.
    """
    head = F.expr(f"substring(segment, {len(START) + 1}, char_length(segment) - {len(START) + len(END)})")
    parts = nodes.select("start", "n_tokens", "segment", "loss_start", "loss_chars", head.alias("inner"))
    role_part = F.substring_index("inner", "\n", 1)
    parts = parts.select("start", "n_tokens", unescape_role(role_part).alias("role"),
                         unescape(F.expr("substring(inner, char_length(substring_index(inner, '\\n', 1)) + 2)")).alias("text"),
                         unescape(F.expr("substring(segment, loss_start + 1, loss_chars)")).alias("loss"))
    return (refs.join(parts, "start").groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("idx", "role", "text", "loss", "n_tokens"))).alias("turns")))


_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM range(2) r(i))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = '{LOSS_ROLE}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       sum({len(START) + len(END) + 1} + length(replace(replace(replace(role, '<', '<\\'), '[', '[\\'), chr(10), '[n'))
           + length(replace(replace(text, '<', '<\\'), '[', '[\\')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


@register("op1_chat_prefix_tree", _SQL)
def op1_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id bigint, turn bigint, role string, text string")
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(*prefix_tree(conv))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"].isNotNull()), lambda t: t["loss"]), "")
    return (back.withColumn("loss_text", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
        .alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["n_tokens"]).alias("formatted_chars")))
