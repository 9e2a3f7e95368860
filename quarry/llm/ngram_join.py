"""N-gram Jaccard join by prefix trees.

A document's set holds the 64-bit hashes of its distinct k-word shingles (with fewer words, of the whole sequence), in
one global order: rare shingles first, by a fixed-size sketch of shingle counts over all documents, then by hash. Two
sets with a similarity of t percent share a shingle among the first |x| - ceil(t |x| / 100) + 1 of each.

1. Equal sets become one representative (their smallest doc_id) by a pre-aggregated grouping.
2. Prefix shingles of representatives that two or more in a band of sizes share are live there. Prefixes are longer by
   m - 1, so that linked sets share m of them, and sets with too few live shingles in a band drop out of it. The smallest
   representative with a live shingle in a band names a block, and all that share the shingle are its members. Any two
   sets that can link meet in a block. Postings are dealt over buckets as packed arrays, of which a task holds one.
3. Large blocks are dealt out over chunks of CHUNK members or CHUNK_SHINGLES shingles, each with the block's first set. A task stores a chunk's
   sets in a trie (runs of equal ranks share a node) and walks it for each set with the overlap so far, pruning
   subtrees by the bounds on remaining lengths and leaves already connected.
4. Members of a many-chunk block that are not connected to its first set are walked through the block's other chunks,
   so no link is lost; connected members need no further pairs.
5. Components come from rounds of pre-aggregated minimum labels over links, each written to the shared folder.

Null texts, texts without words: an empty set, linked with nothing, its own component. Repeated rows have one doc_id
and one component; a doc_id stands for one text. A null doc_id is no one's representative unless alone. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, map_text, roll, slices

#: Cells of the count sketch, and of them in a row of the partial counts.
CELLS, CELLS_A_ROW = 1 << 22, 1 << 10
#: Text that is cut into words at once, beyond one text; and bytes up to which words are hashed all at once.
PIECE_BYTES, WORD_BYTES = 1 << 18, 64
#: Lower-case A-Z, and a space for each of the six ASCII white-space characters.
PLAIN = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The first i of eight bytes, by i.
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: A set with this share of all rows is hot; at most 1/HOT_SHARE sets are, so their list may be broadcast.
HOT_SHARE = 0.001
#: Members of a block that one task's trie holds, and shingles of theirs (on average, beyond one set).
CHUNK, CHUNK_SHINGLES = 256, 1 << 20
#: Ids (8 bytes each) that may be broadcast.
BROADCAST_IDS = 1_000_000
#: Shingles of whole sets for each bucket of postings, and postings that are dealt over the buckets at once.
BUCKET_SHINGLES, DEALT_POSTINGS = 1 << 21, 1 << 19
#: Columns of postings, as bytes of a bucket's rows.
POSTING = {"node": "<i8", "n": "<i4", "gram": "<i8", "band": "<i2"}
#: Ranks in one node of a trie.
RUN = 48


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """64-bit hashes of the words of all texts, and where each text's words begin and the last one's end."""
    # Words are read eight bytes at a time, so the last one has eight more behind it.
    data = b" ".join([b"", *texts, b" " * 8]).translate(PLAIN)
    inside = np.frombuffer(data, np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))

    def mixed(h: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        h = (h ^ (eight[at] & FIRST_BYTES[np.minimum(left, 8)])) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(32))

    hashes = mixed(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), starts, sizes)
    more = np.flatnonzero(sizes > 8)
    for at in range(8, WORD_BYTES, 8):
        hashes[more] = mixed(hashes[more], starts[more] + at, sizes[more] - at)
        more = more[sizes[more] > at + 8]
    for i in more.tolist():
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins).tolist()


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The set of each text, in ascending order."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE_BYTES)) + 1).tolist(), len(texts)]
    for first, last in zip(cuts, cuts[1:], strict=False):
        words, at = hashed_words(texts[first:last])
        rolled = roll(words, k)
        for a, b in zip(at, at[1:], strict=False):
            own = np.sort(rolled[a : b - k + 1] if b - a >= k else roll(words[a:b], max(1, b - a)))
            yield own[np.append(True, own[1:] != own[:-1])] if len(own) > 1 else own


def cells(hashes: np.ndarray) -> np.ndarray:
    """Each hash's cell, by its leading bits: cells of a set in ascending order ascend."""
    return (hashes >> np.uint64(65 - CELLS.bit_length())).view(np.int64)


def narrow(counts: np.ndarray) -> bytes:
    """A row of counts in the fewest bytes that hold the largest."""
    return counts.astype(np.min_scalar_type(int(counts.max())).newbyteorder("<")).tobytes()


def wide(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, f"<u{len(counts) // CELLS_A_ROW}").astype(np.int64)


def count_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Shingle counts over all documents, by cell. Partial counts of each task are added in two levels."""

    def rows(numbers: list[int], counts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([narrow(x) for x in counts], pa.binary())], names=["row", "counts"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            for own in shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], k):
                np.add.at(total, cells(own), 1)
        parts = total.reshape(-1, CELLS_A_ROW)
        some = np.flatnonzero(parts.any(axis=1)).tolist()
        yield rows(some, [parts[i] for i in some])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, counts in zip(batch.column("row").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[row] = sums.get(row, 0) + wide(counts)
        yield rows(list(sums), list(sums.values()))

    schema = "row bigint, counts binary"
    parts = docs.select("text").mapInArrow(partial, schema)
    some = parts.repartition(F.col("row"), F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(add, schema)
    sketch = np.zeros((CELLS // CELLS_A_ROW, CELLS_A_ROW), np.int64)
    for r in some.repartition("row").mapInArrow(add, schema).collect():  # CELLS counters at most
        sketch[r.row] += wide(r.counts)
    return np.minimum(sketch, 2**32 - 1).astype(np.uint32).ravel()


def rarest(own: np.ndarray, sketch: np.ndarray, keep: int) -> np.ndarray:
    """The first `keep` of a set in the global order, in ascending order."""
    if keep >= len(own):
        return own
    counts = sketch[cells(own)]
    most = np.partition(counts, keep - 1)[keep - 1]
    chosen = counts < most
    chosen[np.flatnonzero(counts == most)[: keep - int(chosen.sum())]] = True
    return own[chosen]


def needed(total: int, percent: int) -> int:
    """Smallest overlap of two sets with `total` members together that reaches the similarity."""
    return -(-percent * total // (100 + percent))


class Trie:
    """Sets of ranks, in order; each node holds a run of at most RUN ranks that all sets below it share."""

    def __init__(self, sets: list[np.ndarray], universe: int):
        self.sets, self.marks = sets, np.zeros(universe, bool)
        order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.root = self.grow(order, 0)

    def grow(self, ids: list[int], depth: int) -> list[tuple]:
        """Children below a depth: (run, ids below, children, fewest and most ranks of a set below)."""
        children = []
        for _, same in groupby((i for i in ids if len(self.sets[i]) > depth), key=lambda i: self.sets[i][depth]):
            below = list(same)
            first = self.sets[below[0]]
            shared = min(RUN, min(len(self.sets[i]) for i in below) - depth)
            for i in below[1:]:
                differ = np.flatnonzero(self.sets[i][depth : depth + shared] != first[depth : depth + shared])
                shared = int(differ[0]) if len(differ) else shared
            sizes = [len(self.sets[i]) for i in below]
            children.append((first[depth : depth + shared], below, depth + shared, min(sizes), max(sizes), []))
        return children

    def links(self, own: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Sets of the trie that reach the similarity with `own`. skip(ids): the ids that need no answer are left out."""
        marks, n = self.marks, len(own)
        marks[own] = True
        stack = [(child, 0) for child in self.root]
        while stack:
            (run, ids, depth, least, most, children), overlap = stack.pop()
            overlap += int(np.count_nonzero(marks[run]))
            rest = min(n - int(own.searchsorted(run[-1], "right")), most - depth)
            if overlap + rest < needed(n + max(least, 0), percent) or (100 * n < percent * least) or (100 * most < percent * n):
                continue
            left = skip(ids)
            if not left:
                continue
            for i in left:
                if len(self.sets[i]) == depth and overlap >= needed(n + depth, percent):
                    yield i
            if most > depth:
                if not children:
                    children.extend(self.grow(ids, depth))
                stack.extend((child, overlap) for child in children)
        marks[own] = False


def chunk_links(keys: list[int], sets: list[np.ndarray], probes: list[bool], known: list[int], sketch: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets of a chunk; with probes, only those of probing sets. known: components so far."""
    universe, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.empty(len(universe), np.int64)
    place[np.argsort(sketch[cells(universe)], kind="stable")] = np.arange(len(universe))
    local = [np.sort(x) for x in np.split(place[ranks], np.cumsum([len(s) for s in sets])[:-1])]
    trie = Trie(local, len(universe))
    parent = list(range(len(keys)))
    first: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, c in enumerate(known):
        parent[find(i)] = find(first.setdefault(c, i))
    found = []
    # Without probes all ask, each for those before it.
    some = any(probes)
    for i in [i for i, p in enumerate(probes) if p or not some]:
        for j in trie.links(local[i], percent, lambda ids, i=i: [x for x in ids if (some or x < i) and find(x) != find(i)]):
            a, b = find(i), find(j)
            if a != b:
                parent[b] = a
                found.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
    return found


def components(links: DataFrame, ws: Workspace, tag: str) -> DataFrame:
    """node, label (the smallest node reachable) for every node of a link. Links (a, b) of bigint."""
    edges = ws.save(links.select("a", "b").distinct(), f"{tag}-edges0")
    labels, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ws.save(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("low")).withColumnRenamed("a", "node"), f"{tag}-low{k}")
        if labels is None:
            labels = low.withColumnRenamed("low", "label")
        else:
            moved = low.withColumnRenamed("node", "label")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("low", "label").alias("label"))
        labels = ws.save(labels, f"{tag}-labels{k}")
        a, b = (low.select(F.col("node").alias(x), F.col("low").alias(f"low_{x}")) for x in "ab")
        edges = edges.join(a, "a").join(b, "b").select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b")).filter("a < b").distinct()
        k += 1
        edges = ws.save(edges, f"{tag}-edges{k}")
        ws.drop(f"{tag}-edges{k - 1}", f"{tag}-low{k - 2}", f"{tag}-labels{k - 2}")
        if edges.isEmpty():
            return labels


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def link_sets(members: DataFrame, docs: DataFrame, k: int, percent: int, sketch) -> DataFrame:
    """Links (a, b) of members (block, chunk, node, probe, known), walked chunk by chunk."""
    # Texts move twice: by id, where one of repeated rows stays and members join, and by chunk. The ids wanted are
    # broadcast only after a check of their number; beyond it they meet the texts in the first of these shuffles.
    wanted = members.select("node").distinct()
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").alias("node"), "text")
    texts = texts.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").dropDuplicates(["node"])
    rows = dealt(members.join(texts, "node").select("block", "chunk", "node", "probe", "known", "text"), "block", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in slices(batches):
                columns = [batch.column(c).to_pylist() for c in ("block", "chunk", "node", "probe", "known")]
                yield from zip(*columns, batch.column("text").cast(pa.binary()).to_pylist(), strict=True)

        for _, group in groupby(each(), key=lambda r: r[:2]):
            _, _, keys, probes, known, texts = map(list, zip(*group, strict=True))
            sets = list(shingle_sets(texts, k))
            if links := chunk_links(keys, sets, probes, known, sketch.value, percent):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def shared(n, percent: int):
    """Shingles that two sets of n or more have in common in their prefixes, beyond which prefixes are lengthened."""
    return np.maximum(1, -(-(100 - percent) * n // 200))


def parcels(rows: dict[str, np.ndarray], key: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """Postings dealt over buckets by a key: bucket, and each column of its rows as bytes."""
    for at in range(0, len(rows[key]), DEALT_POSTINGS):
        part = {c: v[at : at + DEALT_POSTINGS] for c, v in rows.items()}
        hashes = part[key].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        bucket = (hashes * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        columns = [pa.array([x.tobytes() for x in np.split(part[c].astype(t)[order], first[1:])], pa.binary()) for c, t in POSTING.items()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *columns], names=["bucket", *POSTING])


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The postings of each bucket, whose rows stand together."""
    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("bucket", *POSTING)), strict=True))
    for _, group in groupby(rows, key=lambda r: r[0]):
        _, *columns = zip(*group, strict=True)
        yield {c: np.frombuffer(b"".join(x), t) for (c, t), x in zip(POSTING.items(), columns, strict=True)}


def together(rows: dict[str, np.ndarray], *keys: str, then: tuple[str, ...] = ()) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows sorted by keys (and then by others); for each row, where its keys' group begins and how many rows it has."""
    order = np.lexsort([rows[c] for c in reversed((*keys, *then))])
    rows = chosen(rows, order)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in keys:
        new[1:] |= rows[c][1:] != rows[c][:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    return rows, np.repeat(first, count), np.repeat(count, count)


def chosen(rows: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[which] for c, v in rows.items()}


def blocks(reps: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """block, node, n (its size): all sets that can link meet in a block. reps: node, n_shingles, prefix.

    Postings (set, shingle of its prefix) are dealt over buckets by shingle, as bytes. Sets that share one are dealt by
    bands of size, each set to its own and the next, in which any two of fitting sizes meet. Sets that link have
    shared(n) prefix shingles in common, n being the smaller size. So a set with fewer live shingles in a band than that
    for the smallest partner allowed links with none there; the others are grouped by shingle and band again.
    """
    buckets = max(1, (reps.agg(F.sum("n_shingles")).first()[0] or 0) // BUCKET_SHINGLES)
    width = max(float(np.log(100 / percent)), 1e-3) * 1.001
    schema = "bucket bigint, " + ", ".join(f"{c} binary" for c in POSTING)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column("prefix")
            node, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n_shingles"))
            sizes = prefixes.value_lengths().to_numpy(zero_copy_only=False)
            gram, n = prefixes.flatten().to_numpy(zero_copy_only=False), np.repeat(n, sizes)
            yield from parcels({"node": np.repeat(node, sizes), "n": n, "gram": gram, "band": np.zeros(len(n))}, "gram", buckets)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in opened(batches):
            rows, _, m = together(rows, "gram")
            rows = chosen(rows, m > 1)
            own = (np.log(rows["n"]) // width).astype(np.int16)
            both = {c: np.concatenate([v, v]) for c, v in rows.items()} | {"band": np.concatenate([own, own + 1])}
            both, _, m = together(both, "gram", "band")
            yield from parcels(chosen(both, m > 1), "node", buckets)

    def able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in opened(batches):
            rows, _, live = together(rows, "node", "band")
            partner = -(-percent * rows["n"].astype(np.int64) // 100)
            yield from parcels(chosen(rows, live >= shared(partner, percent)), "gram", buckets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in opened(batches):
            rows, first, m = together(rows, "gram", "band", then=("node",))
            pairs = chosen({"block": rows["node"][first], "node": rows["node"], "n": rows["n"]}, m > 1)
            pairs, first, _ = together(pairs, "block", "node")
            pairs = chosen(pairs, first == np.arange(len(first)))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[c], t) for c, t in (("block", pa.int64()), ("node", pa.int64()), ("n", pa.int32()))], names=["block", "node", "n"])

    def dealt_out(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    postings = reps.select("node", "n_shingles", "prefix").mapInArrow(post, schema)
    banded = dealt_out(dealt_out(postings).mapInArrow(band, schema)).mapInArrow(able, schema)
    found = dealt_out(banded).mapInArrow(meet, "block bigint, node bigint, n int")
    return ws.save(found.groupBy("block", "node").agg(F.max("n").alias("n")), "met")


def join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "ngram-join")
    sketch = spark.sparkContext.broadcast(count_sketch(docs, k))

    def describe(texts: list[bytes]) -> dict:
        sizes, names, prefixes = [], [], []
        for own in shingle_sets(texts, k):
            n = len(own)
            sizes.append(n)
            names.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
            keep = min(n, n - -(-percent * n // 100) + int(shared(n, percent))) if n else 0
            prefixes.append(rarest(own, sketch.value, keep).view(np.int64))
        return {"n_shingles": pa.array(sizes, pa.int64()), "name": pa.array(names, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64()))}

    base = ws.save(map_text(docs, describe, "n_shingles bigint, name binary, prefix array<bigint>", as_bytes=True), "base")
    some = base.filter("name is not null and doc_id is not null")
    # The smallest doc_id of each set, with its prefix: one shuffle, after a partial aggregation.
    least = F.min(F.struct("doc_id", "n_shingles", "prefix")).alias("r")
    reps = ws.save(some.groupBy("name").agg(least, F.count(F.lit(1)).alias("copies")).select("name", "copies", F.col("r.doc_id").alias("node"), "r.n_shingles", "r.prefix"), "reps")
    # Prefixes are dropped as soon as no later step reads them.
    base = ws.save(base.select("doc_id", "n_shingles", "name"), "sets")
    ws.drop("base")
    firsts = ws.save(reps.select("name", "node", "copies"), "firsts")
    met = blocks(reps, percent, ws)
    ws.drop("reps")
    sizes = ws.save(met.groupBy("block").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("n") / CHUNK_SHINGLES)).alias("chunks")), "sizes")
    dealt_out = met.join(sizes, "block").select("block", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), "node")
    many = sizes.filter("chunks > 1")
    lead = many.select("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.col("block").alias("node"))
    members = ws.save(dealt_out.unionByName(lead).distinct(), "members")
    ws.drop("met")
    plain = members.withColumn("probe", F.lit(False)).withColumn("known", F.col("node"))
    links = ws.save(link_sets(plain, docs, k, percent, sketch), "links")
    labels = components(links, ws, "first")
    # Members of large blocks that are apart from the block's first set meet the block's other chunks.
    large = members.join(many.select("block"), "block", "left_semi")
    labelled = large.join(labels, "node", "left").withColumn("known", F.coalesce("label", "node")).drop("label")
    leaders = many.select(F.col("block").alias("node")).join(labels, "node", "left").select(F.col("node").alias("block"), F.coalesce("label", "node").alias("main"))
    labelled = ws.save(labelled.join(leaders, "block"), "labelled")
    apart = labelled.filter("known != main")
    if not apart.isEmpty():
        asking = apart.join(many, "block").select("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), "node", F.lit(True).alias("probe"), "known").distinct()
        held = labelled.join(apart.select("block").distinct(), "block", "left_semi").select("block", "chunk", "node", F.lit(False).alias("probe"), "known")
        both = asking.unionByName(held).groupBy("block", "chunk", "node").agg(F.max("probe").alias("probe"), F.max("known").alias("known"))
        more = ws.save(link_sets(both, docs, k, percent, sketch), "more")
        labels = components(links.unionByName(more), ws, "second")
    named = ws.save(firsts.join(labels, "node", "left").select("name", F.coalesce("label", "node").alias("component_id"), "copies"), "named")
    ws.drop("firsts", "sizes", "members", "links", "labelled", "more")
    # Hot sets meet their component by broadcast, rows without words or id none, and the others in a shuffle.
    hot = F.col("copies") >= max(2, HOT_SHARE * base.count())
    plain = F.col("name").isNull() | F.col("doc_id").isNull()
    own = base.filter(~plain)
    often = own.join(F.broadcast(named.filter(hot)), "name")
    rare = own.join(F.broadcast(named.filter(hot).select("name")), "name", "left_anti").join(named.filter(~hot), "name")
    shown = ["doc_id", "n_shingles", "component_id"]
    return base.filter(plain).withColumn("component_id", F.col("doc_id")).select(*shown).unionByName(often.select(*shown)).unionByName(rare.select(*shown))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest doc_id of each component, with all columns; documents without words stay."""
    ws = Workspace(docs.sparkSession, "ngram-kept")
    found = join(docs.select("doc_id", "text"), k, percent).filter("doc_id is not null")
    # Ids that go, or that several rows have. Rows of all others stay where they stand, so only these meet by id.
    rows = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    other = ws.save(rows.filter("rows > 1 or not stays").select(F.col("doc_id").alias("__other"), "stays"), "other")
    n, again = other.agg(F.count(F.lit(1)), F.count_if("stays")).first()

    def met(ids: DataFrame, how: str) -> DataFrame:
        ids = ids.select("__other")
        return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col("doc_id") == F.col("__other"), how)

    plain = met(other, "left_anti")
    return plain.unionByName(met(other.filter("stays"), "left_semi").dropDuplicates(["doc_id"])) if again else plain
