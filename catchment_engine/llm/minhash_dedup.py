"""Near-duplicate groups by circulant MinHash, banding and exact verification.

Two permutations of 32-bit integers make a signature: the first scatters a set's
elements, the second, shifted circularly by k, gives coordinate k. Documents with the
same set are one node. Nodes that share a band's coordinates are candidates; a link is
confirmed on the full sets. Within a bucket every node is compared with the bucket's
smallest node first; where a bucket's nodes are then still in different components, those
outside the largest are compared with the others in blocks. Pairs of copies are never
written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import sliced, stage, unstage
from .components import connected_components
from .hashing import grouped, mix64, shingle_sets

#: Bands and coordinates of each: a pair of similarity 0.8 shares no band with
#: probability (1 - 0.8 ** ROWS) ** BANDS, about 3e-6, one of 0.9 with 4e-13.
BANDS, ROWS = 32, 5
#: Link if 100 * intersection >= PERCENT * union, on shingles of WORDS words.
PERCENT, WORDS = 80, 2
#: Bits of the filter that tells which documents' sets are needed: of fixed size, 8 MB.
FILTER_BITS = 1 << 26
#: Bytes of text hashed at once.
GROUP = 1 << 20
#: Set elements and nodes in a block, about.
BLOCK_SHINGLES, BLOCK_NODES = 16_384, 128
#: Blocks of either side that meet under one join key.
TILE = 8
#: Nodes without a document id are numbered from here.
NO_ID = 1 << 62


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash signatures of non-empty sets, (sets, coordinates)."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), coordinates), np.uint32)
    begin = 0
    while begin < len(sets):  # blocks that stay in a cache
        end, held = begin, 0
        while end < len(sets) and (held == 0 or held + sizes[end] <= 1 << 15):
            held += sizes[end]
            end += 1
        x = (mix64(np.concatenate(sets[begin:end])) >> np.uint64(32)).astype(np.uint32)  # the first permutation
        at = np.cumsum(sizes[begin:end]) - sizes[begin:end]
        t, u = np.empty_like(x), np.empty_like(x)
        for k in range(coordinates):
            np.subtract(x, np.uint32(k), out=t)  # the shift
            for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):  # the second permutation
                np.right_shift(t, np.uint32(shift), out=u)
                np.bitwise_xor(t, u, out=t)
                np.multiply(t, np.uint32(factor), out=t)
            out[begin:end, k] = np.minimum.reduceat(t, at)
        begin = end
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A key of each band's coordinates, band number included, (sets, bands)."""
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def _sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, key, bands) per document, with the columns of docs after doc_id and text;
    bands only where a task first sees a set."""
    more = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in sliced(batches):
            n, keys, new, where = [], [], [], []
            for texts in grouped(b.column(1).cast(pa.binary()).to_pylist(), GROUP):
                sets = shingle_sets([t.lower() if t else None for t in texts], words)
                for s in sets:
                    n.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if len(s) and keys[-1] not in seen:
                        seen.add(keys[-1])
                        new.append(s)
                        where.append(len(n) - 1)
                if len(seen) > 500_000:
                    seen.clear()
            at = np.zeros(len(n), np.int64)
            made = band_keys(signatures(new, bands * rows), bands).ravel() if new else np.zeros(0, np.int64)
            at[where] = bands
            offsets = np.concatenate(([0], np.cumsum(at))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), column, *b.columns[2:]], ["doc_id", "n", "key", "bands", *more])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, bands array<long>" + "".join(f", {c} long" for c in more))


def _positions(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(77)) & np.uint64(bits - 1)).astype(np.int64)


def _filter(nodes: DataFrame, bits: int) -> np.ndarray:
    """A filter of bits that every one of the nodes' documents passes, as words of 64 bits,
    of which there are bits / 64 at most, combined on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _positions(b.column(0).to_numpy(zero_copy_only=False), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], ["word", "mask"])

    words = nodes.select("node").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    got = words.toPandas()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["mask"].to_numpy()
    return out


def _sets_of(docs: DataFrame, passing: np.ndarray, words: int) -> DataFrame:
    """(key, elements) of the documents that pass a filter by their id; elements are the
    set's sorted hashes as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(passing.tobytes())
    bits = 64 * len(passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.int64)
        seen: set[bytes] = set()
        for b in sliced(batches):
            ids = b.column(0)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            at = _positions(number, bits)
            wanted = (bitmap[at >> 6] >> (at & 63) & 1).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)
            texts = b.column(1).filter(pa.array(wanted)).cast(pa.binary()).to_pylist()
            for part in grouped(texts, GROUP):
                keys, elements = [], []
                for s in shingle_sets([t.lower() if t else None for t in part], words):
                    if len(s):
                        data = s.tobytes()
                        key = hashlib.blake2b(data, digest_size=16).digest()
                        if key not in seen:
                            seen.add(key)
                            keys.append(key)
                            elements.append(data)
                if len(seen) > 500_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(elements, pa.binary())], ["key", "elements"])

    return docs.mapInArrow(run, "key binary, elements binary")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # two runs: a merge
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. sets: (node, elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
    second = first.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    return second.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _labelled(df: DataFrame, labels: DataFrame | None, column: str, to: str) -> DataFrame:
    if labels is None:
        return df.withColumn(to, F.col(column))
    labels = labels.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    return df.join(labels, F.col(column) == F.col("__n"), "left").withColumn(to, F.coalesce("__c", column)).drop("__n", "__c")


def _residual(members: DataFrame, banded: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of a bucket that its star hasn't compared.

    A block holds about BLOCK_SHINGLES set elements; TILE blocks of either side make a tile,
    and pairs of tiles are the join's keys, so that a hot bucket's work is dealt out and
    neither a bucket nor its pairs of nodes are gathered or written out. Nodes that share
    several buckets are compared in the one with the smallest key.
    """
    of = stage(_labelled(members.select("band", "rep", "node", "n"), labels, "node", "c"), "minhash-open")
    parts = of.groupBy("band", "c").agg(F.count(F.lit(1)).alias("k"))
    open_bands = parts.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("m"), F.max_by("c", F.struct("k", -F.col("c"))).alias("main")).where("parts > 1 AND m > 2")
    left = of.join(open_bands.select("band", "main"), "band").withColumn("query", F.col("c") != F.col("main"))
    left = stage(left, "minhash-unsettled")
    blocks = lambda column: F.ceil(F.greatest(F.sum(F.when(column, F.col("n")).otherwise(0)) / BLOCK_SHINGLES, F.count_if(column) / BLOCK_NODES)).cast("long")
    counts = left.groupBy("band").agg(blocks(F.lit(True)).alias("t_blocks"), blocks(F.col("query")).alias("q_blocks"))
    details = stage(left.select("node").distinct().join(banded.select("node", "bands"), "node").join(sets, "node"), "minhash-details")
    full = stage(left.join(counts, "band").join(details, "node"), "minhash-compared")
    member = F.struct("node", "c", "rep", "elements", "bands")

    def side(df: DataFrame, own: str, other: str, name: str, own_tile: str, other_tile: str) -> DataFrame:
        """One row per block of this side and tile of the other."""
        blocks_ = df.withColumn("block", F.pmod(F.xxhash64("node"), F.col(own))).groupBy("band", "block", other).agg(F.collect_list(member).alias(name))
        tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(other) - 1) / TILE)))
        return blocks_.select("band", F.floor(F.col("block") / TILE).alias(own_tile), tiles.alias(other_tile), name)

    q_side = side(full.where("query"), "q_blocks", "t_blocks", "q", "q_tile", "t_tile")
    pairs = q_side.join(side(full, "t_blocks", "q_blocks", "t", "t_tile", "q_tile"), ["band", "q_tile", "t_tile"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 8):
            found = [_compare_blocks(b.column(0)[k].as_py(), b.column(1)[k].values, b.column(2)[k].values, percent) for k in range(b.num_rows)]
            a, z = (np.concatenate([f[i] for f in found]) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, z)), pa.array(np.maximum(a, z))], ["a", "b"])

    found = stage(pairs.select("band", "q", "t").mapInArrow(run, "a long, b long").distinct(), "minhash-links")
    unstage(of, left, details, full)
    return found


def _compare_blocks(band: int, q: pa.StructArray, t: pa.StructArray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs of two blocks' nodes, of those in different components, of which none
    is the bucket's first, and that share no bucket of a smaller key."""
    column = lambda x, name: x.field(name).to_numpy(zero_copy_only=False)
    qn, tn = column(q, "node"), column(t, "node")
    qb, tb = (x.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) for x in (q, t))
    rep = column(q, "rep")[0]
    earlier = ((qb[:, None, :] == tb[None, :, :]) & (qb < band)[:, None, :]).any(2)
    due = (column(q, "c")[:, None] != column(t, "c")[None, :]) & ~earlier & (qn != rep)[:, None] & (tn != rep)[None, :]
    rows, cols = np.flatnonzero(due.any(1)), np.flatnonzero(due.any(0))
    if not len(rows):
        return qn[:0], tn[:0]
    qs, ts = ([np.frombuffer(x, np.uint64) for x in s.field("elements").take(pa.array(i)).to_pylist()] for s, i in ((q, rows), (t, cols)))
    q_size, t_size = np.array([len(x) for x in qs]), np.array([len(x) for x in ts])
    # Common elements of all pairs at once: a product of the two incidence matrices.
    values, at = np.unique(np.concatenate(qs + ts), return_inverse=True)
    owner = np.repeat(np.arange(len(qs) + len(ts)), np.concatenate((q_size, t_size)))
    has = np.zeros((len(qs) + len(ts), len(values)), np.float32)
    has[owner, at] = 1
    common = np.rint(has[: len(qs)] @ has[len(qs) :].T).astype(np.int64)
    similar = due[np.ix_(rows, cols)] & (100 * common >= percent * (q_size[:, None] + t_size[None, :] - common))
    i, j = np.nonzero(similar)
    return qn[rows[i]], tn[cols[j]]


def _number(docs: DataFrame, id_col: str) -> Column:
    """The id as a long; other than whole numbers below NO_ID it fails."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{id_col} has to be a whole number, not {kind.simpleString()}")
    x = F.col(id_col).cast("long")
    return F.when(x >= NO_ID, F.raise_error(F.lit(f"{id_col} is beyond 2 ** 62")).cast("long")).otherwise(x)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs.

    ids are whole numbers below 2 ** 62; others fail. Texts are lower-cased in A-Z; a set holds the distinct
    shingles of words, of a shorter text its words as one; null texts and those without
    words have no set, are linked with nothing and kept. Repeated rows are copies; rows of
    one id with several texts are one document that has the links of each. Rows without
    an id are linked as others; their component is the smallest id reachable or null, and
    they are kept if that is null. Equality of sets is by 128-bit digests, of shingles by
    64-bit hashes.
    """
    rows_in = docs.select(_number(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _components(rows_in, words, percent, bands, rows, by_id=True)
    component = F.coalesce(F.when(F.col("c") < NO_ID, F.col("c")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def row_groups(docs: DataFrame, keys: list[str], id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, group, and keys, columns of whole numbers) per row of docs: rows
    are linked as in near_duplicates, but by their texts alone, whatever their ids. The
    numbers of groups have no meaning; rows without a set have none."""
    rows_in = docs.select(_number(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keys)
    out = _components(rows_in, words, percent, bands, rows, by_id=False)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("group"), *keys)


def _components(rows_in: DataFrame, words: int, percent: int, bands: int, rows: int, by_id: bool) -> DataFrame:
    """(doc_id, n, c, and the columns of rows_in after doc_id and text) per row, c the
    component of its set. Sets are numbered by their smallest id, or, if not by_id, each
    by a number of its own."""
    carried = rows_in.columns[2:]
    sketch = stage(_sketch(rows_in, words, bands, rows), "minhash-sketch")
    no_id = F.lit(NO_ID) + F.pmod(F.xxhash64("key"), F.lit(1 << 61))
    nodes = sketch.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    node = F.coalesce("first", no_id) if by_id else F.monotonically_increasing_id()
    nodes = stage(nodes.select("key", node.alias("node"), "n", "first"), "minhash-nodes")

    banded = stage(sketch.where(F.size("bands") > 0).select("key", "bands").dropDuplicates(["key"]).join(nodes, "key").select("node", "n", "bands"), "minhash-bands")
    buckets = banded.select("node", "n", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("rep")).where("m > 1")
    members = stage(buckets.join(shared.select("band", "rep"), "band"), "minhash-members")
    sizes = nodes.select(F.col("node").alias("__rep"), F.col("n").alias("rep_n"))
    stars = members.where("node <> rep").groupBy("rep", "node").agg(F.count(F.lit(1)).alias("shared"), F.min("n").alias("n"))
    stars = stars.join(sizes, F.col("rep") == F.col("__rep")).where(100 * F.least("n", "rep_n") >= percent * F.greatest("n", "rep_n"))
    stars = stage(stars.select(F.col("rep").alias("a"), F.col("node").alias("b"), "shared"), "minhash-stars")

    in_play = members.select("node").distinct()
    if not by_id:  # documents are told by their ids; all without one pass
        in_play = nodes.join(in_play, "node", "left_semi").where("first IS NOT NULL").select(F.col("first").alias("node"))
    passing = _filter(in_play, FILTER_BITS)
    sets = _sets_of(rows_in, passing, words).dropDuplicates(["key"]).join(nodes.select("key", "node"), "key").select("node", "elements")
    sets = stage(sets, "minhash-sets")

    # Each node's likeliest partner first; the others only where that left a gap.
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    first = stage(_verify(best.select("a", "b"), sets, percent), "minhash-links")
    labels = stage(connected_components(first), "minhash-labels")
    done = stars.select("a", "b")
    open_pairs = _labelled(_labelled(done, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb").select("a", "b")
    more = stage(_verify(open_pairs.join(best.select("a", "b"), ["a", "b"], "left_anti"), sets, percent), "minhash-links")
    if more.head(1):
        labels = stage(connected_components(first.unionByName(more)), "minhash-labels")

    # Buckets whose nodes are in different components yet: their nodes outside the largest
    # component are a query set, compared with all the bucket's nodes in blocks.
    last = _residual(members, banded, sets, labels, percent)
    if last.head(1):
        labels = stage(connected_components(first.unionByName(more).unionByName(last)), "minhash-labels")
    unstage(banded, members, stars, sets, first, more, last)

    return _labelled(sketch.select("doc_id", "n", "key", *carried).join(nodes.select("key", "node"), "key", "left"), labels, "node", "c")
