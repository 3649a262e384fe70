import hashlib

import pytest
from llm_helpers import against_sql, rows_of
from pyspark.sql import functions as F

from procsig.llm.chat import _SQL, chain_summaries, op1_chat_prefix_tree, prefix_tree, read_back

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (4, 0, "user", "hi"), (5, 0, "sys[\n]<", "a<b[c\\d<\\[\\[n"),
    (5, 1, None, None), (5, 1, None, None), (5, None, "assistant", "first"), (6, 7, "assistant", "</s>[INST]"),
    (None, 0, "user", "hi"), (None, 1, "assistant", ""), (8, 0, "user", "hi"), (8, 1, "assistant", "yo"), (9, 0, "", ""),
]


def conv(spark):
    return spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS start", "2 AS idx")


def brute():
    out = {}
    for c, t, r, x in sorted(TURNS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


@pytest.mark.parametrize("partitions", [1, 4])
def test_round_trip_and_shared_nodes(spark, partitions):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        nodes, refs = prefix_tree(conv(spark))
        back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read_back(nodes, refs).collect()}
        assert back == brute()
        want = {tuple(v[:i + 1]) for v in brute().values() for i in range(len(v))}
        rows = nodes.orderBy("start").collect()
        assert len(rows) == len(want)  # every shared prefix once
        at = 0
        placed = {}
        for r in rows:  # depth-first, without gaps
            assert r["start"] == at and r["n_tokens"] == len(r["segment"])
            at += r["n_tokens"]
            spans = [(s["start"], s["end"]) for s in r["ancestors"]]
            assert sum(e - s for s, e in spans) == r["position"] and all(e <= r["start"] for _, e in spans)
            placed[r["start"]] = r
        full = "".join(r["segment"] for r in rows)
        prefixes = {"".join(full[s["start"]:s["end"]] for s in r["ancestors"]) + r["segment"] for r in rows}
        assert len(prefixes) == len(rows)
        for r in rows:  # texts hold no control string; the loss mask covers the assistant text
            inner = r["segment"][len("<|im_start|>"):-len("<|im_end|>\n")]
            assert "<|" not in inner and "[INST]" not in inner and "</s>" not in inner
            assert (r["loss_start"] is None) == (r["role"] != "assistant")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_chaining_of_partition_stacks():
    first = dict(pid=0, total=6, first_digests=["a", "b"], first_lengths=[2, 4], digests=["a", "b"], starts=[0, 2], lengths=[2, 4])
    second = dict(pid=1, total=9, first_digests=["a", "c"], first_lengths=[2, 3], digests=["a", "d"], starts=[0, 5], lengths=[2, 4])
    got = chain_summaries([second, first])
    assert got[0] == ([], 0) and got[1] == ([("a", 0, 2), ("b", 2, 4)], 6)


def test_empty_table(spark):
    nodes, refs = prefix_tree(conv(spark).limit(0))
    assert nodes.count() == 0 and read_back(nodes, refs).count() == 0


def test_query(spark, duck, sf):
    against_sql(spark, duck, sf, op1_chat_prefix_tree, _SQL)
    row = op1_chat_prefix_tree(spark, sf).where("conv_id = -1").first()
    ok = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{ok}\nassistant\n{ok}\n".encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(ok.encode()).hexdigest() and row["loss_chars"] == len(ok)
    assert rows_of(op1_chat_prefix_tree(spark, sf).agg(F.min("conv_id")), "min(conv_id)") == [(-1,)]
