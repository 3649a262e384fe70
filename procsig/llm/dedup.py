"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union-find groups.

A document's set is its distinct five-word shingles. Two sets link at a Jaccard similarity of 0.75
or more. The steps, none of which holds an unbounded group or emits all pairs of one:

1. ``signatures``: one Python pass over the texts gives each row its set size, a 128-bit
   fingerprint of the set, 51 band keys of 5 slots each (a pair at 0.75 shares no band with
   probability 1e-6, a pair at 0.8 with 1e-9) and a 512-bit sketch;
2. equal sets collapse to one node (an aggregate with map-side combine);
3. ``bucket_links``: band rows are range-partitioned by (key, node), so that a hot key is spread;
   keys with one node go. Nodes of a key whose sketches could belong to a linked pair (seven
   standard deviations of slack) are joined into *provisional* groups; keys that span tasks or
   hold more than ``MAX_RUN`` nodes join all their nodes. Provisional groups are supersets of the
   true ones and serve to place sets that may link in the same task;
4. ``verified_links``: the full sets of provisional groups meet in blocks of bounded size. Every
   pair in a block is decided by its exact intersection unless its two sides are linked already;
   groups of several blocks share pivots;
5. where sides of a group of several blocks are still apart, a prefix-filtered join finds the pairs of
   different blocks that may link: shingles are ordered by rarity in the group, a pair must share one of the
   rarest seventh of the smaller set and of the rarest quarter of the larger (``spanning_candidates``); a family of
   texts that share a form but are no duplicates shares its common shingles, not its rare ones, and gives no
   pairs. Candidates are verified on full sets;
6. union-find over verified links; the component is the smallest ``doc_id`` reachable.

Defined results: NULL, empty and blank texts have no shingles and link with nothing; a NULL
``doc_id`` takes part, and is the component's id only if the component has no other; repeated rows
are copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procsig.llm.components import components
from procsig.llm.registry import register
from procsig.llm.runs import groups
from procsig.llm.superminhash import band_keys, sketch, superminhash
from procsig.llm.text import packed
from procsig.llm.wordhash import shingle_sets, text_chunks
from procsig.session import cut_lineage
from procsig.sources.tables import table

BANDS, ROWS = 51, 5
NUM, DEN = 3, 4                      # link where DEN * |A & B| >= NUM * |A | B|
#: Sketch cells that may differ at similarity 0.75: mean 48 of 256, plus seven standard deviations.
MAX_DIFFERENT = 92
MAX_RUN, BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS, KEY_BUCKETS = 2048, 512, 1 << 21, 16, 1 << 20
_SIG = "doc_id bigint, text_key bigint, n_shingles bigint, fp binary, bands array<bigint>, sketch array<bigint>"


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(ids, keys, sets):
        sig = superminhash(sets)
        bands, sk = band_keys(sig, BANDS, ROWS), sketch(sig)
        as_lists = lambda m: pa.ListArray.from_arrays(
            pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1)))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), as_lists(bands), as_lists(sk)],
            names=["doc_id", "text_key", "n_shingles", "fp", "bands", "sketch"])

    for b in batches:
        ids, keys, texts = (b.column(i).to_pylist() for i in range(3))
        for lo, hi in text_chunks(texts):
            yield out(ids[lo:hi], keys[lo:hi], shingle_sets(texts[lo:hi]))


def signatures(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per document row: set size, fingerprint, bands, sketch."""
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        _signature_batches, _SIG)


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp) rows -> (key, fp, head, spans) of keys that hold more than one node.

    The first and last key of a task may go on in a neighbouring task: their rows are marked.
    """
    held: pa.Table | None = None
    first = True

    def rows(t: pa.Table, last: bool):
        nonlocal first
        key = t.column("key").to_numpy()
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(key)]
        size = np.repeat(ends - starts, ends - starts)
        spans = np.zeros(len(key), dtype=bool)
        if first:
            spans[:ends[0]] = True
        if last:
            spans[starts[-1]:] = True
        first = False
        keep = np.flatnonzero((size > 1) | spans)
        head = np.repeat(starts, ends - starts)[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(key[keep]), t.column("fp").take(pa.array(keep)).combine_chunks(),
             t.column("fp").take(pa.array(head)).combine_chunks(), pa.array(spans[keep] | (size[keep] > MAX_RUN))],
            names=["key", "fp", "head", "spans"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        key = held.column("key").to_numpy()
        at = int(np.searchsorted(key, key[-1]))
        if at:  # the last key may go on in the next batch
            done, held = held.slice(0, at), held.slice(at)
            yield rows(done, False)
        elif held.num_rows > 8 * MAX_RUN:  # a hot key: hand out what there is, marked as spanning
            done, held = held.slice(0, held.num_rows - 1), held.slice(held.num_rows - 1)
            first = True
            yield rows(done, True)
            first = True
    if held is not None and held.num_rows:
        yield rows(held, True)


def _run_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one key, with sketches -> links of nodes whose sketches allow similarity 0.75."""
    for t in groups(batches, ["key"]):
        fp = t.column("fp").to_pylist()
        sk = np.array(t.column("sketch").to_pylist(), dtype=np.int64).view(np.uint64)
        a, b = [], []
        left = np.arange(1, len(fp))
        todo = [0]
        while todo or len(left):
            if not todo:
                todo, left = [int(left[0])], left[1:]
            at = todo.pop()
            x = sk[left] ^ sk[at]
            different = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
            near = different <= MAX_DIFFERENT
            for i in left[near]:
                a.append(fp[at]), b.append(fp[i])
                todo.append(int(i))
            left = left[~near]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def bucket_links(nodes: DataFrame, bands: DataFrame) -> DataFrame:
    """``nodes(fp, sketch)``, ``bands(fp, bands)`` -> links ``(a, b)`` whose components hold every true link."""
    rows = (bands.select(F.explode("bands").alias("key"), "fp").repartitionByRange("key", "fp")
            .sortWithinPartitions("key", "fp").mapInArrow(_bucket_rows, "key bigint, fp binary, head binary, spans boolean"))
    rows = cut_lineage(rows)
    wide = rows.where("spans")
    heads = wide.select("key", "head").distinct()
    least = heads.groupBy("key").agg(F.min("head").alias("least"))
    across = heads.join(least, "key").select(F.col("head").alias("a"), F.col("least").alias("b"))
    small = (rows.where("NOT spans").select("key", "fp").join(nodes.select("fp", "sketch"), "fp")
             .repartition("key").sortWithinPartitions("key").mapInArrow(_run_links, "a binary, b binary"))
    return wide.select(F.col("head").alias("a"), F.col("fp").alias("b")).unionByName(across).unionByName(small).where("a <> b")


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for lo, hi in text_chunks(texts):
            part = b.slice(lo, hi - lo)
            sets = [s.tobytes() for s in shingle_sets(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([part.column("comp"), part.column("fp"), part.column("blocks"),
                                              pa.array(sets, pa.binary())], names=["comp", "fp", "blocks", "grams"])


def _exact_links(fps: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """Links that connect all linked sets; a pair is skipped only if its sides are linked already."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    links, apart = [], len(sets)
    for i in range(len(sets)):
        if apart == 1:
            break
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = hi - lo
        at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        linked = np.flatnonzero(DEN * both >= NUM * (sizes + sizes[i] - both))
        for j in linked:
            ri, rj = find(i), find(int(j))
            if ri != rj:
                root[rj] = ri
                apart -= 1
                links.append((fps[i], fps[int(j)]))
    return links


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in groups(batches, ["comp", "block"]):
        sets = dict(zip(t.column("fp").to_pylist(), t.column("grams").to_pylist()))
        links = _exact_links(list(sets), [np.frombuffer(s, dtype=np.uint64) for s in sets.values()]) if len(sets) > 1 else []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.binary()),
                                              pa.array([x[1] for x in links], pa.binary())], names=["a", "b"])


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full sets of ``wanted(fp, rep, comp, blocks)``, read again from one row of each.

    The wanted keys are first reduced to at most ``KEY_BUCKETS`` distinct remainders, a broadcast of
    bounded size that keeps most other texts out of the shuffle.
    """
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    w = wanted.select("comp", "fp", "blocks", F.col("rep.text_key").alias("key_of"), F.col("rep.doc_id").alias("id_of"))
    buckets = w.select(F.pmod("key_of", F.lit(KEY_BUCKETS)).alias("bucket")).distinct()
    text = text.join(F.broadcast(buckets), F.pmod("text_key", F.lit(KEY_BUCKETS)) == F.col("bucket"), "left_semi")
    hit = text.join(w, (F.col("text_key") == F.col("key_of")) & F.col("doc_id").eqNullSafe(F.col("id_of")))
    return (hit.select("comp", "fp", "blocks", "text")
            .mapInArrow(_set_batches, "comp binary, fp binary, blocks array<int>, grams binary"))


def verified_links(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Exact links inside the blocks of ``placed(fp, rep, comp, n_blocks, block, size)``."""
    pivot = (F.col("n_blocks") > 1) & (F.pmod(F.xxhash64("fp", F.lit(1)), F.col("size")) < PIVOTS)
    wanted = placed.select("fp", "rep", "comp", F.when(pivot, F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int")))
                           .otherwise(F.array(F.col("block").cast("int"))).alias("blocks"))
    return (_sets_of(docs, wanted).select("comp", "fp", "grams", F.explode("blocks").alias("block"))
            .repartition("comp", "block").sortWithinPartitions("comp", "block").mapInArrow(_block_links, "a binary, b binary"))


def _pair_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column("ga"), b.column("gb")):
            s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(DEN * both >= NUM * (len(s) + len(t) - both))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, grams in enumerate(b.column("grams")):
            g = np.frombuffer(grams.as_buffer(), dtype=np.int64)
            for lo in range(0, len(g), 50_000):
                part = g[lo:lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("fp")[i].as_py()] * len(part), pa.binary()), pa.array([b.column("comp")[i].as_py()] * len(part), pa.binary()),
                     pa.array(np.full(len(part), len(g))), pa.array(part)], names=["fp", "comp", "size", "gram"])


def spanning_candidates(sets: DataFrame, place: DataFrame) -> DataFrame:
    """``sets(fp, comp, grams)``, ``place(fp, label, block)`` -> pairs ``(a, b)`` of different blocks and labels of one
    ``comp`` that may link.

    AllPairs / PPJoin: with the pair ordered by set size, a linked pair shares a shingle among the first
    size - ceil(6/7 size) + 1 of the smaller set and the first size - ceil(3/4 size) + 1 of the larger, in the order of
    rarity; sizes and the two places bound what can still be shared. Shingles of one set take places but
    no join. Of the labels that hold a shingle the most common one meets only the others.
    """
    rows = sets.select("fp", "comp", "grams").mapInArrow(_gram_rows, "fp binary, comp binary, size bigint, gram bigint")
    shared = rows.groupBy("comp", "gram").agg(F.count("*").alias("df")).where("df > 1")
    known = rows.join(shared, ["comp", "gram"])
    by_rarity = Window.partitionBy("fp").orderBy("df", "gram")
    placed = (known.withColumn("place", F.row_number().over(by_rarity)).withColumn("several", F.count("*").over(Window.partitionBy("fp")))
              .withColumn("place", F.col("place") + F.col("size") - F.col("several"))
              .where("place <= size - (3 * size + 3) div 4 + 1")
              .select("comp", "gram", "fp", "size", "place", F.expr("place <= size - (6 * size + 6) div 7 + 1").alias("small")))
    rows = placed.join(place.select("fp", "label", "block"), "fp")
    per = rows.groupBy("comp", "gram", "label").count()
    main = (per.groupBy("comp", "gram").agg(F.max(F.struct("count", "label")).alias("m"), F.count("*").alias("labels"))
            .where("labels > 1").select("comp", "gram", F.col("m.label").alias("main")))
    rows = cut_lineage(rows.join(main, ["comp", "gram"]))

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        cond = ((F.col("x.comp") == F.col("y.comp")) & (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") != F.col("y.label"))
                & (F.col("x.block") != F.col("y.block"))
                & ((F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.fp") < F.col("y.fp"))))
                & (DEN * F.col("x.size") >= NUM * F.col("y.size"))
                & ((NUM + DEN) * (1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")))
                   >= NUM * (F.col("x.size") + F.col("y.size"))))
        return x.join(y, cond).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    small, other = rows.where("small"), rows.where("label <> main")
    return meet(small.where("label <> main"), rows).unionByName(meet(small.where("label = main"), other)).distinct()


def block_spanning_links(docs: DataFrame, placed: DataFrame, links: DataFrame) -> DataFrame:
    """Links between blocks of one provisional group whose sides are not connected yet."""
    label = components(links).withColumnRenamed("root", "label")
    wide = (placed.where("n_blocks > 1").join(label.select(F.col("node").alias("fp"), "label"), "fp", "left")
            .withColumn("label", F.coalesce("label", "fp")))
    apart = wide.groupBy("comp").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("comp")
    wide = cut_lineage(wide.join(apart, "comp").select("fp", "rep", "comp", "block", "label"))
    sets = cut_lineage(_sets_of(docs, wide.select("fp", "rep", "comp", F.array().cast("array<int>").alias("blocks")))
                       .groupBy("fp").agg(F.first("comp").alias("comp"), F.first("grams").alias("grams")))
    pairs = cut_lineage(spanning_candidates(sets, wide))
    full = (pairs.join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("ga")), "a")
            .join(sets.select(F.col("fp").alias("b"), F.col("grams").alias("gb")), "b"))
    return full.select("a", "b", "ga", "gb").mapInArrow(_pair_links, "a binary, b binary")


def near_duplicates(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, text_key, n_shingles, component_id, root, kept`` per row.

    ``root`` tells components apart (NULL without shingles); ``component_id`` need not, where ids are NULL or repeated.
    """
    sig = cut_lineage(signatures(docs))
    shingled = sig.where("n_shingles > 0")
    nodes = cut_lineage(shingled.groupBy("fp").agg(
        F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("least"),
        F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    bands = shingled.groupBy("fp").agg(F.first("bands").alias("bands"))
    comp = components(bucket_links(nodes, bands)).select(F.col("node").alias("fp"), F.col("root").alias("comp"))
    member = nodes.select("fp", "rep", "n_shingles").join(comp, "fp")
    sizes = member.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("total"))
    blocks = F.ceil(F.greatest(F.col("size") / block_docs, F.col("total") / BLOCK_SHINGLES)).cast("long")
    placed = cut_lineage(member.join(sizes.withColumn("n_blocks", blocks), "comp").select(
        "fp", "rep", "comp", "size", "n_blocks", F.pmod(F.xxhash64("fp"), F.col("n_blocks")).alias("block")))
    links = cut_lineage(verified_links(docs, placed))
    if not placed.where("n_blocks > 1").isEmpty():
        links = cut_lineage(links.unionByName(block_spanning_links(docs, placed, links)))
    root = components(links)
    rooted = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of = rooted.join(ids, "root").select(F.col("fp").alias("fp_of"), "component", "root")
    out = sig.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("fp")).alias("fp"))
    out = out.join(of, F.col("fp") == F.col("fp_of"), "left").select(
        "doc_id", "text_key", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "root")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns), one of each group; textless rows all stay."""
    found = cut_lineage(near_duplicates(docs.select("doc_id", "text")))
    rows = packed(docs)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    left = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left_anti")
    kept = found.where("kept AND n_shingles > 0")
    again = kept.groupBy("root").count().where("count > 1").select("root")
    if again.isEmpty():
        return left.select("row_of.*")
    # Several rows of one component hold its smallest id (or it has none): one of them stays.
    keys = (kept.join(again, "root").select(F.col("doc_id").alias("again_id"), F.col("text_key").alias("again_key"), "root").distinct())
    marked = left.join(keys, F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("text_key") == F.col("again_key")), "left")
    one = marked.where("root IS NOT NULL").dropDuplicates(["root"])
    return marked.where("root IS NULL").select("row_of").unionByName(one.select("row_of")).select("row_of.*")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS fp FROM g GROUP BY doc_id),
rep AS (SELECT fp, min(doc_id) AS r, any_value(n) AS n FROM sets GROUP BY fp),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN rep x ON x.r = a.doc_id JOIN rep y ON y.r = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT r AS a, r AS b FROM rep UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT a AS r, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id,
       d.doc_id = coalesce(c, d.doc_id) AS kept
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN rep USING (fp) LEFT JOIN comp USING (r)"""


@register("op2_near_duplicates", SQL)
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
