"""Operator 2: near-duplicates by SimHash, found with deletion-variant signatures.

Two fingerprints that differ in at most k bits, cut into (k + 1) // 2 + (k + 1) % 2 segments or fewer, agree
in some segment up to one bit. Each segment is indexed as it is and, once for every bit, without that bit;
an equality join on these variants finds every pair, which is then verified on all bits inside the join.
A variant without bit i joins rows where the bit is 0 only with rows where it is 1, so a pair meets once a
segment and not once a wildcard. Work is done on distinct fingerprints; documents with the same one are
linked through their class.

Buckets over ``hot`` fingerprints are not paired: their rows get further keys from the variants of the
bits outside the segment, which again must agree up to one bit in one of two halves. So a crowded bucket
falls apart into buckets of pairs that are alike in most bits, and no link is lost.

A null, empty or wordless text has fingerprint zero and is linked like any other; texts of any length are read
whole. Rows with a null doc_id get a fingerprint but no component. Repeated rows give repeated rows; repeated
doc_ids share a component only if their texts are linked. Further columns, whatever their names, are ignored, and
an empty table gives an empty one. No ties arise: a component is named by its smallest doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm import kernels
from rowtide.llm.arrow import column_of, only, slices, texts_of
from rowtide.llm.components import components
from rowtide.llm.storage import discard, free_name, materialize


def fingerprints(df: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a signed long."""
    def run(batches):
        only()
        for batch in batches:
            fp = kernels.simhash(texts_of(batch, text), words)[:, 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([column_of(batch, doc_id), pa.array(fp)], names=["doc_id", "fp"])

    return df.select(F.col(doc_id).cast("long").alias(doc_id), text).mapInArrow(run, "doc_id long, fp long")


def variants(bits: str, lowest: int, width: int, tag: str) -> str:
    """SQL for the array of (key, side) of a segment: side 2 for the whole segment, else the missing bit's value."""
    mask = ((1 << width) - 1) << lowest
    signed = mask - (1 << 64) if mask >> 63 else mask
    whole = f"array(struct(xxhash64({tag}, -1, {bits} & {signed}L) as key, 2 as side))"
    missing = f"transform(sequence({lowest}, {lowest + width - 1}), i -> struct(xxhash64({tag}, i, {bits} & {signed}L & ~shiftleft(1L, i)) as key, cast(shiftrightunsigned({bits}, i) & 1 as int) as side))"
    return f"concat({whole}, {missing})"


def links(distinct: DataFrame, distance: int, hot: int = 200) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints fp that differ in at most ``distance`` bits."""
    segments = next(m for m in range(1, 65) if distance // m <= 1)
    bounds = [64 * i // segments for i in range(segments + 1)]
    keys = [variants("fp", lo, hi - lo, str(i)) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))]
    # a few megabytes of fingerprints become a hundred times as much: they are dealt out first
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = distinct.select("fp", F.explode(F.expr(f"flatten(array({', '.join(f'transform({k}, v -> struct(v.key as key, v.side as side, {i} as segment))' for i, k in enumerate(keys))}))")).alias("v")).select("fp", "v.key", "v.side", "v.segment")
    pairs = _pairs(rows, distance)
    if segments == 2:  # with more segments, buckets of over two bits less have no smaller parts of use
        crowded = materialize(rows.groupBy("key").count().where(F.col("count") > hot).select("key"), "crowded")
        if not crowded.isEmpty():
            pairs = _pairs(rows.join(crowded, "key", "left_anti"), distance).union(_pairs(_deeper(rows.join(crowded, "key")), distance))
    return pairs.distinct()


def _deeper(rows: DataFrame) -> DataFrame:
    """Rows of crowded buckets, dealt out once more by the half outside the bucket's segment.

    A pair differs there in three bits at most, so in one of its two quarters in at most one.
    """
    inner = [f"when segment = {s} then concat({variants('fp', lo, 16, f'key, {lo}')}, {variants('fp', lo + 16, 16, f'key, {lo + 16}')})" for s, lo in ((0, 32), (1, 0))]
    return rows.select("fp", F.explode(F.expr(f"case {' '.join(inner)} end")).alias("v")).select("fp", "v.key", "v.side")


def _pairs(rows: DataFrame, distance: int) -> DataFrame:
    # Spark takes exploded rows for as large as what they came from, and would broadcast a hundred times that
    a = rows.where("side in (0, 2)").select("key", F.col("fp").alias("a"), F.col("side").alias("s")).hint("merge")
    b = rows.where("side in (1, 2)").select("key", F.col("fp").alias("b"), F.col("side").alias("t"))
    meet = (a["key"] == b["key"]) & F.expr(f"((s = 0 and t = 1) or (s = 2 and t = 2 and a < b)) and bit_count(a ^ b) <= {distance}")
    return a.join(b, meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(df: DataFrame, words: int = 5, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id reachable over links of at most ``distance`` bits."""
    prints = materialize(fingerprints(df, words, doc_id, text), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    reached = components(links(classes.select("fp"), distance))
    named = classes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    table = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(table, "fp").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex64(column) -> F.Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# -- near-duplicates by similarity ---------------------------------------------------------------------------

BANDS, ROWS, SKETCH = 16, 6, 512
#: The order of shingles is learned from about so many texts; so many of the commonest come last in it.
SAMPLE, COMMON = 20_000, 200_000
_SKETCHES = [f"s{i}" for i in range(SKETCH // 64)]


def _common_shingles(df: DataFrame, words: int, text: str) -> np.ndarray:
    """Shingles that several sampled texts have, the rarest first. What is sampled affects the work, not the result."""

    def run(batches):
        only()
        for batch in (part for whole in batches for part in slices(whole, text, 1 << 20)):
            sets = kernels.shingle_sets(texts_of(batch, text), words)
            if len(flat := np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])):
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["shingle"])

    share = max(1, df.count() // SAMPLE)
    drawn = df.where(F.pmod(F.xxhash64(text), F.lit(share)) == 0).select(text)
    counted = drawn.mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(COMMON)
    return np.array([r[0] for r in counted.select("shingle").collect()], dtype=np.int64).view(np.uint64)[::-1]


def _prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a set's first shingles in the order that a set this similar has one of its own first ones among
    them. ``common`` is sorted; ``rank`` has the place of each in the order, after all others."""
    place = np.zeros(len(own), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        place = np.where(common[at] == own, rank[at], 0)
    return own[np.lexsort((own, place))[: len(own) - int(np.ceil(similarity * len(own) - 1e-6)) + 1]]


def _signatures(df: DataFrame, words: int, similarity: float, doc_id: str, text: str) -> DataFrame:
    """doc_id, mark (hash of the text), fp, sig (hash of the shingle set), n (its size), bands (hashes of groups of
    minimum hashes), prefix and s0, s1 ... (whether an even or odd number of shingles falls on each bit)."""
    names = ["doc_id", "mark", "fp", "sig", "n", "bands", "prefix", *_SKETCHES]
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(_common_shingles(rows, words, "text"))

    def bands_of(mins):
        part = mins.reshape(len(mins), BANDS, ROWS).astype(np.uint64)
        total = np.zeros((len(mins), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            total = kernels.mix64(total ^ part[:, :, r] + np.uint64(r + 1 << 32))
        return total ^ np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(kernels.BASE)

    def run(batches):
        only()
        order = np.argsort(shared.value)
        common, rank = shared.value[order], order + 1
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 20)):
            texts = texts_of(batch, "text")
            fp = kernels.simhash(texts, words)[:, 0].view(np.int64)
            sets = kernels.shingle_sets(texts, words)
            odd = np.array([np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1 for s in sets], dtype=np.uint8).reshape(-1, SKETCH)
            bits = np.packbits(odd, axis=1).view(np.int64)
            n = pa.array([len(s) for s in sets], type=pa.int64())
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), column_of(batch, "mark"), pa.array(fp), pa.array(_signed(sets)), n, _arrays(list(bands_of(kernels.minhashes(sets, BANDS * ROWS)))), _arrays([_prefix(s, common, rank, similarity) for s in sets]), *[pa.array(bits[:, i].copy()) for i in range(len(_SKETCHES))]], names=names)

    return rows.mapInArrow(run, "doc_id long, mark long, fp long, sig long, n long, bands array<long>, prefix array<long>, " + ", ".join(f"{s} long" for s in _SKETCHES))


def _signed(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each shingle set."""
    return np.array([kernels.mix64(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)


def _arrays(rows: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, dtype=np.uint64)]).view(np.int64)))


def _differ(similarity: float) -> str:
    """SQL that drops only pairs that cannot be similar: shingles of both sets cancel out in the sketches, so these
    differ in no more bits than the sets do in shingles, at most (1 - s) / (1 + s) of their sizes together."""
    return f"{' + '.join(f'bit_count(a{s} ^ b{s})' for s in _SKETCHES)} <= (an + bn) * {(1 - similarity) / (1 + similarity)!r}D + 1e-6D"


def _side(rows: DataFrame, side: str, *more) -> DataFrame:
    return rows.select(*more, F.col("node").alias(side), F.col("n").alias(f"{side}n"), *[F.col(s).alias(f"{side}{s}") for s in _SKETCHES])


def _leader_pairs(hits: DataFrame, seeds: int = 2) -> DataFrame:
    """Each node with the leaders of its bands, a random member each: a few pairs a node, whatever a band holds."""
    pairs = None
    for seed in range(seeds):
        least = hits.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key", F.lit(seed)).alias("h"), "node"))["node"].alias("leader"))
        one = hits.join(least, "key").where("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        pairs = one if pairs is None else pairs.union(one)
    return pairs.distinct()


def _other_pairs(nodes: DataFrame, similarity: float, hot: int) -> DataFrame:
    """All pairs of nodes of different groups that can be similar: they share a shingle of their prefixes, and have
    enough shingles from there on. Of shingles that the same nodes share, only the first in the order counts, as it
    leaves the most; a pair that shares one of the first 32 of them is not met again at a later one. Rows of a shingle
    with over ``hot`` nodes are dealt out, each pair to one place."""
    keyed = nodes.select("node", "grp", F.posexplode("prefix").alias("pos", "key"))
    shared = keyed.groupBy("key").agg(F.min("grp").alias("g"), F.max("grp").alias("h")).where("g != h").select("key")
    rows = materialize(keyed.hint("merge").join(shared, "key"), "prefixes")  # exploded rows, as in _pairs
    lists = rows.groupBy("key").agg(F.count("*").alias("count"), F.bit_xor(F.xxhash64("node")).alias("list"), F.min(F.struct("node", "pos")).alias("head"))
    one = lists.groupBy("list", "count", "head.node").agg(F.min(F.struct("head.pos", "key"))["key"].alias("key"))
    one = one.select("key", F.ceil(F.col("count") / hot).cast("int").alias("chunks"))
    own = rows.join(one, "key").groupBy("node").agg(F.first("grp").alias("grp"), F.array_sort(F.collect_list(F.struct("pos", "key", "chunks"))).alias("own"))
    own = own.join(nodes.select("node", "n", *_SKETCHES), "node").withColumn("v", F.explode("own"))
    before = F.expr("transform(filter(slice(own, 1, 32), o -> o.pos < v.pos), o -> o.key)").alias("before")
    rows = materialize(own.select("node", "grp", "n", *_SKETCHES, "v.pos", "v.key", "v.chunks", before), "postings")
    a = _side(rows, "a", "key", F.col("grp").alias("x"), F.col("pos").alias("i"), F.col("before").alias("p"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    b = _side(rows, "b", "key", F.col("grp").alias("y"), F.col("pos").alias("j"), F.col("before").alias("q"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    enough = f"least(an - i, bn - j) >= (an + bn) * {similarity / (1 + similarity)!r}D - 1e-6D"
    meet = (a["key"] == b["key"]) & (a["chunk"] == b["chunk"]) & F.expr(f"a < b and x != y and {enough} and {_differ(similarity)} and not arrays_overlap(p, q)")
    return a.hint("merge").join(b, meet).select("a", "b")


def similar_groups(df: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 2, hot: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component_id of every row: groups linked by shingle sets of at least this Jaccard similarity.

    Texts with equal shingle sets are one node. Every candidate is verified on its shingle sets.

    There are two rounds. The first only saves work: nodes whose fingerprints differ in at most ``distance`` bits
    meet (deletion variants), and each node meets random leaders of its bands of minimum hashes; that joins most of
    a large group of copies by a few pairs a node. The second is complete: of nodes of different groups all meet
    that share a shingle of their prefixes (the rarest fifth or so), as any two sets of this similarity do. So no
    link between groups is lost, whatever ``hot``, and the pairs inside a group are never listed.

    Texts without words form one group; texts of any length are read whole. Rows without doc_id link nothing and
    have no component. Different texts with one doc_id are judged apart.
    """
    return _groups(df, words, similarity, distance, hot, doc_id, text).select("doc_id", "component_id")


def _groups(df: DataFrame, words: int, similarity: float, distance: int, hot: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, mark (hash of the text), component (a number of the group) and component_id of every row."""
    prints = materialize(_signatures(df, words, similarity, doc_id, text), "signatures")
    best = prints.groupBy(F.col("sig").alias("node")).agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("prefix").alias("prefix"), *[F.first(c).alias(c) for c in _SKETCHES])
    nodes = materialize(best.where("rep is not null"), "nodes")
    members = materialize(prints.select("doc_id", "mark", "sig"), "members")
    discard(prints)
    by_fp = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    close = links(by_fp.select("fp"), distance)
    close = close.join(by_fp.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = nodes.join(by_fp, "fp").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    printed = materialize(close.union(same), "printed", small=True)

    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1")
    hits = materialize(keyed.hint("merge").join(shared, "key"), "hits")
    texts = df.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))
    reps = materialize(nodes.select("node", "rep"), "reps")

    def run(batches):
        only()
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 20)):
            sets = kernels.shingle_sets(texts_of(batch, "text"), words)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(sets)), _arrays(sets)], names=["node", "shingles"])

    def verified(pairs, name):
        """The pairs that are similar; only texts of their nodes are read again."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        own = texts.join(reps.join(wanted, "node").select("rep").distinct(), "rep", "left_semi")
        sets = materialize(own.select("text").mapInArrow(run, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return materialize(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"), name, small=True)

    led = _leader_pairs(hits).join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b").where(_differ(similarity)).select("a", "b")
    led = materialize(led.union(printed).distinct(), "led", small=True)
    first = components(verified(led, "first"))
    grouped = materialize(nodes.join(first, "node", "left").select("node", F.coalesce("component", "node").alias("grp"), "n", "prefix", *_SKETCHES), "grouped")
    discard(nodes)
    others = materialize(_other_pairs(grouped, similarity, hot).distinct(), "others", small=True)
    reached = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(verified(others, "more")))
    named = reps.join(reached, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    table = named.join(least, "component").select(F.col("node").alias("sig"), "component", "component_id")
    one = F.col("doc_id").isNotNull()
    return members.join(table, "sig", "left").select("doc_id", "mark", F.when(one, F.col("component")).alias("component"), F.when(one, F.col("component_id")).alias("component_id"))


def deduplicate(df: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 2, hot: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of ``similar_groups``, with all columns of df: that with the group's smallest doc_id,
    of different texts with that doc_id the one with the smallest xxhash64. Rows without doc_id stay.
    """
    groups = materialize(_groups(df, words, similarity, distance, hot, doc_id, text), "groups").where("doc_id is not null")
    heads = groups.where("doc_id = component_id").groupBy("doc_id", "component").agg(F.min("mark").alias("least"), F.count("*").alias("n"))
    several = materialize(heads.where("n > 1"), "several", small=True)
    unwanted = groups.join(several, ["doc_id", "component"]).where("mark != least").select("doc_id", "mark")
    unwanted = groups.where("doc_id != component_id").select("doc_id", "mark").union(unwanted).distinct()
    mark = free_name(df, "mark")
    marked = df.withColumn(mark, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    unwanted = unwanted.select(F.col("doc_id").alias(doc_id), F.col("mark").alias(mark))
    kept = marked.join(unwanted, [doc_id, mark], "left_anti")
    if not several.isEmpty():
        kept = kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, mark]).union(kept.where(F.col(doc_id).isNull()))
    return kept.select(*df.columns)
