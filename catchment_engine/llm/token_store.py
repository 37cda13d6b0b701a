"""Token-id output as a content-addressed store.

Rolling hashes cut each document's id stream into chunks at places that depend
on content alone. A store is a folder of three Parquet tables:

* ``chunks``: (digest, n, data) with each distinct chunk once; data is a zstd frame
  of ids as little-endian unsigned 16-bit integers (32-bit if the vocabulary needs
  it), and the digest is that of these ids' bytes.
* ``recipes``: (shard, idx, doc_id, n_tokens, shard_start, root, digests) in
  ascending doc_id order, null first: shard by shard, idx within a shard.
* ``manifest``: (shard, docs, tokens, start, root): the Merkle root over a
  shard's documents and the ids before it.

Reading verifies each chunk against its digest, each document against its root
and each shard against the manifest; a difference fails the read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, new_path, sliced
from .hashing import prefix_hash, ragged, window_hash, word_places

DIGEST_BYTES = 16
#: Ids in a chunk: least, on average beyond that, most.
CHUNK_MIN, CHUNK_MEAN, CHUNK_MAX = 128, 1024, 8192
#: Ids that the rolling hash sees.
ROLL = 16
#: Words that a worker remembers.
CACHE_WORDS = 800_000
#: Bytes of text encoded at once.
GROUP = 1 << 20
#: Digests that a task remembers, so as to send each chunk once.
SEEN = 200_000
#: Children of a node in a shard's Merkle tree.
FANOUT = 256


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST_BYTES).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node moves up as it is; no leaves: the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        paired = [digest(b"\x01" + leaves[i] + leaves[i + 1]) for i in range(0, len(leaves) - 1, 2)]
        leaves = paired + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0]


@lru_cache(maxsize=4)
def _gear(size: int) -> np.ndarray:
    x = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def cuts(ids: np.ndarray, vocabulary: int) -> list[int]:
    """Ends of the chunks of an id stream."""
    n = len(ids)
    if n <= CHUNK_MIN:
        return [n] if n else []
    g = _gear(vocabulary)[ids]
    h = g.copy()
    for j in range(1, min(ROLL, n)):
        h[j:] += g[:-j] << np.uint64(j)
    out, last = [], 0
    for at in (np.flatnonzero((h >> np.uint64(20)) % np.uint64(CHUNK_MEAN) == 0) + 1).tolist():
        while at - last > CHUNK_MAX:
            last += CHUNK_MAX
            out.append(last)
        if at - last >= CHUNK_MIN:
            last = at
            out.append(last)
    while n - last > CHUNK_MAX:
        last += CHUNK_MAX
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _byte_letters() -> dict[int, str]:
    """How byte-level models write bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Bytes of the words that the short way takes: Latin-1 letters in UTF-8 (no lead byte but
#: C3, so not the two signs among them), perhaps with one mark at the end.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))]] = True
_MARKS = b".,;:!?"
_MARK = np.zeros(256, bool)
_MARK[list(_MARKS)] = True
#: The short way is taken only by tokenizers that give the same ids for these both ways.
_PROBES = ["a", "The", "word", "Été", "ÑANDÚ", "straße", "naïveté", "ÀÉÎÕÜ", "reconstruction", "x"]


class _WordEncoder:
    """Ids of texts, by way of a memory of white-space words by their 64-bit hashes.

    Right for tokenizers that drop white space and never join what it parts. Most new
    words are letters that normalising and splitting leave alone but for their case; they
    go straight to the library's model, the others through all of it. The memory is an open
    hash table from hashes to numbers, and arrays of each number's ids.
    """

    def __init__(self, path: str, dtype: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.model._resize_cache(0)  # words come once
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = [(chr(b), c) for b, c in _byte_letters().items() if chr(b) != c and b >= 0x80]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()
        words = [w.encode() for w in _PROBES]
        ids, lengths = self.pieces(b" ".join(words), len(words))
        whole, n = self.whole(words)
        self.short = lengths is not None and np.array_equal(ids, whole) and np.array_equal(lengths, n)
        self.mark_ids, self.mark_n = self.whole([bytes([m]) for m in _MARKS])
        self.mark_at = np.cumsum(self.mark_n) - self.mark_n

    def forget(self) -> None:
        slots = 1 << (2 * CACHE_WORDS).bit_length()
        self.keys, self.numbers, self.have = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), 0
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        self.start, self.length = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's number, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        out, due, slot = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), hashes & mask
        while len(due):
            key = self.keys[slot]
            hit = key == hashes[due]
            out[due[hit]] = self.numbers[slot[hit]]
            more = ~hit & (key != 0)
            due, slot = due[more], (slot[more] + np.uint64(1)) & mask
        return out

    def pieces(self, words: bytes, n: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids of n words of letters with spaces between, and how many each has (None if
        words' ends can't be told)."""
        text = words.decode().lower()
        if not text.isascii():
            text = text.encode().decode("latin-1")
            for a, b in self.letters:
                text = text.replace(a, b)
        ids = np.asarray(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        stops = np.flatnonzero(self.last[ids]) + 1
        return ids, np.diff(stops, prepend=0) if len(stops) == n and (not n or stops[-1] == len(ids)) else None

    def whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = [np.zeros(0, self.dtype)], []
        for i in range(0, len(words), 256):
            for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[i : i + 256]], add_special_tokens=False):
                ids.append(np.asarray(e.ids, self.dtype))
                n.append(len(ids[-1]))
        return np.concatenate(ids), np.array(n, np.int64)

    def learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[begin:end], and how many each has."""
        mark = _MARK[data[end - 1]]
        stop = end - mark
        flaws = np.concatenate(([0], np.cumsum(~_LETTER[data])))
        short = (stop > begin) & (flaws[stop] == flaws[begin]) & self.short
        out, n = [np.zeros(0, self.dtype)], np.zeros(len(begin), np.int64)
        order = []
        at = np.flatnonzero(short)
        for k in range(0, len(at), 8192):
            w = at[k : k + 8192]
            size = stop[w] - begin[w] + 1
            letters = data[ragged(begin[w], size)].copy()
            letters[np.cumsum(size) - 1] = 0x20
            ids, many = self.pieces(letters[:-1].tobytes(), len(w))
            if many is None:
                short[w] = False
                continue
            marks = np.searchsorted(_SORTED_MARKS, data[end[w] - 1]) % len(_MARKS)
            marks = _MARK_ORDER[marks]
            more = np.where(mark[w], self.mark_n[marks], 0)
            total = many + more
            both = np.zeros(int(total.sum()), self.dtype)
            first = np.cumsum(total) - total
            both[ragged(first, many)] = ids
            both[ragged(first + many, more)] = self.mark_ids[ragged(self.mark_at[marks], more)]
            out.append(both)
            n[w] = total
            order.append(w)
        at = np.flatnonzero(~short)
        ids, many = self.whole([data[i:j].tobytes() for i, j in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
        out.append(ids)
        n[at] = many
        order.append(at)
        # Back in the words' order.
        made, order = np.concatenate(out), np.concatenate(order)
        place = np.empty(len(begin), np.int64)
        place[order] = np.cumsum(n[order]) - n[order]
        return made[ragged(place, n)], n

    def remember(self, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Gives different, unknown hashes the next numbers."""
        have, more = self.have, len(hashes)
        while have + more > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[have : have + more] = self.used + np.cumsum(n) - n
        self.length[have : have + more] = n
        self.used, self.have = self.used + len(ids), have + more
        mask = np.uint64(len(self.keys) - 1)
        due, slot = np.arange(more), hashes & mask
        while len(due):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[due[free]]  # of several for one slot one stays
            own = self.keys[slot] == hashes[due]
            self.numbers[slot[own]] = have + due[own]
            due, slot = due[~own], (slot[~own] + np.uint64(1)) & mask

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; texts of a few megabytes at a time are a good measure."""
        data, begin, end, at = word_places(texts)
        hashes, first, inverse = np.unique(window_hash(prefix_hash(data), begin, end) | np.uint64(1), return_index=True, return_inverse=True)
        if self.have + len(hashes) > CACHE_WORDS:
            self.forget()
        if len(hashes) > CACHE_WORDS:  # one text of more words than are remembered
            ids, n = self.learn(data, begin, end)
            stops = np.concatenate(([0], np.cumsum(n)))[at]
            return [ids[i:j] for i, j in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
        numbers = self.find(hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            ids, n = self.learn(data, begin[first[new]], end[first[new]])
            numbers[new] = self.have + np.arange(len(new))
            self.remember(hashes[new], ids, n)
        word = numbers[inverse]
        n = self.length[word].astype(np.int64)
        ids = self.pool[ragged(self.start[word], n)]
        stops = np.concatenate(([0], np.cumsum(n)))[at]
        return [ids[i:j] for i, j in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


#: _MARKS in the order of their bytes, for a look-up by place.
_SORTED_MARKS = np.array(sorted(_MARKS), np.uint8)
_MARK_ORDER = np.array([_MARKS.index(m) for m in sorted(_MARKS)])


def _groups(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


@lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> _WordEncoder:
    return _WordEncoder(path, dtype)


def _encode(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds in one pass: recipes (digests set) and chunks (data set),
    the latter once per task as far as it remembers."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, seen, pack = _encoder(tokenizer, dtype), set(), zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False).compress
        end = np.asarray([end_id], dtype)
        width = int(dtype[-1])
        for b in sliced(batches, 1024):
            if len(seen) > SEEN:
                seen.clear()
            n_tokens, roots, digests, c_digest, c_n, c_data = [], [], [], [], [], []
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for ids in (np.append(x, end) for group in _groups(texts, GROUP) for x in encoder.encode(group)):
                data = ids.tobytes()
                own, begin = [], 0
                for stop in cuts(ids, vocabulary):
                    part = data[begin * width : stop * width]
                    d = digest(part)
                    own.append(d)
                    if d not in seen:
                        seen.add(d)
                        c_digest.append(d)
                        c_n.append(stop - begin)
                        c_data.append(pack(part))
                    begin = stop
                n_tokens.append(len(ids))
                roots.append(merkle_root(own))
                digests.append(own)
            k, m = len(roots), len(c_digest)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column(0), pa.nulls(m, b.column(0).type)]),
                    pa.array(n_tokens + c_n, pa.int64()),
                    pa.array(roots + c_digest, pa.binary()),
                    pa.array(digests + [None] * m, pa.list_(pa.binary())),
                    pa.array([None] * k + c_data, pa.binary()),
                ],
                ["doc_id", "n", "digest", "digests", "data"],
            )

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {id_type}, n long, digest binary, digests array<binary>, data binary")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds shard, idx and shard_start to sorted recipes."""
    shard, idx, start = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), shard, np.int32)), pa.array(np.arange(idx, idx + len(n))), b.column(0), b.column(1), pa.array(start + np.cumsum(n) - n), b.column(2), b.column(3)],
            ["shard", "idx", "doc_id", "n_tokens", "shard_start", "root", "digests"],
        )
        idx, start = idx + len(n), start + int(n.sum())


def shard_roots(recipes: DataFrame, most: int) -> DataFrame:
    """(shard, root): a tree of FANOUT children over the documents' roots, level by
    level, so that no group is larger than FANOUT. most: documents in the largest shard."""
    level = recipes.select("shard", "idx", "root")
    while True:
        level = (
            level.groupBy("shard", F.floor(F.col("idx") / FANOUT).alias("up"))
            .agg(F.array_sort(F.collect_list(F.struct("idx", "root"))).alias("kids"))
            .select("shard", F.col("up").alias("idx"), F.unhex(F.sha2(F.concat_ws("", F.transform("kids", lambda x: F.hex(x["root"]))), 256)).alias("root"))
        )
        most = -(-most // FANOUT)
        if most <= 1:
            return level.select("shard", F.col("root").alias("shard_root"))


def write_store(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encodes every whole text (null: empty), appends end_id and writes a store to path.

    Repeated rows are stored as documents of their own with the same chunks; ties
    on doc_id are in the order of their roots; an empty table gives empty tables.
    Payload is shuffled once, after each task has dropped its own repeats.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = new_path(spark, "token-scratch")
    encoded = _encode(docs, tokenizer, vocabulary, end_id, id_col, text_col)
    encoded.withColumn("kind", F.when(F.col("data").isNull(), "recipe").otherwise("chunk")).write.partitionBy("kind").option("compression", "zstd").parquet(scratch)
    schema = encoded.schema

    def part(kind: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{scratch}/kind={kind}")
        except Exception as e:  # no rows of this kind
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    chunks = part("chunk").select("digest", F.col("n").cast("int").alias("n"), "data")
    chunks.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = part("recipe").select("doc_id", "n", "digest", "digests").repartitionByRange(shards, "doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    id_type = schema["doc_id"].dataType.simpleString()
    recipes.mapInArrow(_number, f"shard int, idx long, doc_id {id_type}, n_tokens long, shard_start long, root binary, digests array<binary>").write.parquet(f"{path}/recipes")
    drop_path(spark, scratch)
    manifest(spark.read.parquet(f"{path}/recipes")).coalesce(1).write.parquet(f"{path}/manifest")


def manifest(recipes: DataFrame) -> DataFrame:
    totals = recipes.groupBy("shard").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    most = totals.agg(F.max("docs")).first()[0] or 0
    # One row per shard: a window over all of them is small whatever the corpus.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.join(shard_roots(recipes, most), "shard").select("shard", "docs", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"), F.col("shard_root").alias("root"))


def read_documents(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document rebuilt from its recipe, ids as
    a binary of 32-bit little-endian integers, and verified."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "data")
    shards = spark.read.parquet(f"{path}/manifest")
    again = manifest(recipes).select("shard", F.struct("docs", "tokens", "start", "root").alias("found"))
    odd = shards.join(again, "shard", "full").where(~F.struct("docs", "tokens", "start", "root").eqNullSafe(F.col("found")))
    if odd.head(1):
        raise ValueError(f"the manifest of {path} doesn't match its recipes")
    parts = recipes.select("shard", "idx", F.posexplode("digests").alias("seq", "digest"))
    parts = parts.join(chunks, "digest", "left").select("shard", "idx", "seq", "data", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("shard_start"), F.lit(None).cast("binary").alias("root"), F.lit(None).cast(recipes.schema["doc_id"].dataType).alias("doc_id"))
    heads = recipes.select("shard", "idx", F.lit(-1).alias("seq"), F.lit(None).cast("binary").alias("data"), "n_tokens", "shard_start", "root", "doc_id")
    # A document's head and its parts meet, sorted, in one stream; a document is the largest unit held.
    stream = heads.unionByName(parts).repartition("shard", "idx").sortWithinPartitions("shard", "idx", "seq")
    id_type = recipes.schema["doc_id"].dataType.simpleString()

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        head, held = None, []
        _encoder.cache_clear()  # a worker that has encoded needs its words no more

        def finish():
            data = b"".join(held)
            ids = np.frombuffer(data, dtype).astype("<u4")
            if merkle_root([digest(x) for x in held]) != head["root"] or len(ids) != head["n_tokens"]:
                raise ValueError(f"document {head['doc_id']} doesn't match its root")
            return head["doc_id"], head["shard"], head["shard_start"], len(ids), ids.tobytes()

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "shard", "shard_start", "n_tokens", "ids"])

        types = None
        for b in sliced(batches):
            types = types or [b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            rows, size = [], 0
            for r in b.to_pylist():
                if r["seq"] == -1:
                    if head:
                        rows.append(finish())
                        size += len(rows[-1][-1])
                        if size > 16 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    head, held = r, []
                else:
                    if r["data"] is None:
                        raise ValueError(f"a chunk of document {head['doc_id']} is missing")
                    held.append(unpack(r["data"]))
            if rows:
                yield batch(rows)
        if head:
            yield batch([finish()])

    made = stream.mapInArrow(rebuild, f"doc_id {id_type}, shard int, shard_start long, n_tokens long, ids binary")
    return made.join(shards.select("shard", "start"), "shard").select("doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids")
