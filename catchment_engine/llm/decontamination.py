"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments, each a run of documents of one partition: the sorted
hashes of their terms, the counts of these and all positions, in order of term and
position (a document-sharded index: postings never cross a shuffle). It holds every term
of every document, is made in one pass over the texts and stored; benchmarks of any size
are searched on it, a block at a time. A test window is looked up from its rarest term: the
term's positions, adjusted by its offset in the window, are intersected with those of the
other terms, the rarest first. Terms are told by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_bytes, drop_path, new_path, sliced, stage
from .hashing import grouped, ragged, word_hashes

#: Words of a test window.
WINDOW = 10
#: Words of documents in a segment, beyond the last document in it.
SEGMENT_WORDS = 1 << 22
#: Free positions between documents of a segment: no window or stretch crosses them.
GAP = 64
#: Characters of benchmark text in a block (or one item): what is sent to executors at once.
BLOCK_CHARS = 2 << 20
#: Bytes of texts whose words are hashed at once.
_TEXTS = 1 << 20


class Tests:
    """Windows of benchmark items, over the hashes of their terms."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        hashes, at = word_hashes([alnum_bytes((text or "").encode()) for _, text in items])
        self.terms, number = np.unique(hashes, return_inverse=True)
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for k, (item, _) in enumerate(items):
            ids = number[at[k] : at[k + 1]].tolist()
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners[tuple(ids[i : i + window])].add(item)
        self.windows = list(owners)
        self.owners = [sorted(x for x in owners[w] if x is not None) for w in self.windows]
        self.flat = np.array([t for w in self.windows for t in w], np.int64)
        self.starts = np.cumsum([0, *map(len, self.windows)])[:-1]


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Writes the index of docs to path and returns it: segment, doc_ids and n_words of its
    documents, terms (64-bit), counts and postings (32-bit, each the difference to the one
    before) as little-endian binaries. Null and empty texts have no postings."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, parts, size, kind, k = [], [], [], 0, None, TaskContext.get().partitionId() << 32

        def segment() -> pa.RecordBatch:
            n = np.array(counts, np.int64)
            first = np.cumsum(n + GAP) - n - GAP
            code = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            at = np.repeat(first, n) + np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
            order = np.argsort(code, kind="stable")
            terms, df = np.unique(code[order], return_counts=True)
            postings = np.diff(at[order], prepend=0).astype("<i4")
            return pa.RecordBatch.from_arrays(
                [pa.array([k]), pa.array([ids], pa.list_(kind)), pa.array([n], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (terms.astype("<u8"), df.astype("<i4"), postings))],
                ["segment", "doc_ids", "n_words", "terms", "counts", "postings"],
            )

        for b in sliced(batches):
            kind = b.column(0).type
            docs_ = b.column(0).to_pylist()
            done = 0
            for texts in grouped([alnum_bytes(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()], _TEXTS):
                hashes, at = word_hashes(texts)
                for i in range(len(texts)):
                    ids.append(docs_[done + i])
                    counts.append(int(at[i + 1] - at[i]))
                    parts.append(hashes[at[i] : at[i + 1]])
                    size += counts[-1] + GAP
                    if size >= segment_words:
                        yield segment()
                        ids, counts, parts, size, k = [], [], [], 0, k + 1
                done += len(texts)
        if ids:
            yield segment()

    made = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"segment long, doc_ids array<{id_type}>, n_words array<long>, terms binary, counts binary, postings binary")
    return stage(made, "contamination-index", path, compression="zstd")


def _held(sorted_at: np.ndarray, x: np.ndarray) -> np.ndarray:
    i = np.searchsorted(sorted_at, x)
    i[i == len(sorted_at)] = 0
    return sorted_at[i] == x


def _within(sorted_at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a place lies in each low..high."""
    i = np.searchsorted(sorted_at, low)
    ok = i < len(sorted_at)
    ok[ok] = sorted_at[i[ok]] <= high[ok]
    return ok


def _stretches(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """First places of stretches of slop words that hold a place of each list, the shortest
    list first."""
    near, reach = lists[0], slop - 1
    for x in lists[1:]:
        near = near[_within(x, near - reach, near + reach)]
        if not len(near):
            return near
    out = []
    for x in lists:
        low, high = np.searchsorted(x, near - reach), np.searchsorted(x, near, side="right")
        first = np.unique(x[ragged(low, high - low)])  # those up to reach before such a place
        for y in lists:
            first = first[_within(y, first, first + reach)]
        out.append(first)
    return np.concatenate(out)


def search_segment(tests: Tests, terms: np.ndarray, counts: np.ndarray, postings: np.ndarray, slop: int | None):
    """Yields (window, phrase starts, starts of stretches of slop words with all its terms)."""
    if not len(tests.flat) or not len(terms):
        return
    at = np.minimum(np.searchsorted(terms, tests.terms), len(terms) - 1)
    df = np.where(terms[at] == tests.terms, counts[at], 0)
    begin = (np.cumsum(counts) - counts)[at]
    none = np.zeros(0, np.int64)
    for w in np.flatnonzero(np.minimum.reduceat(df[tests.flat], tests.starts) > 0).tolist():
        window = tests.windows[w]
        lists = {t: postings[begin[t] : begin[t] + df[t]] for t in window}
        order = sorted(range(len(window)), key=lambda o: df[window[o]])
        starts = lists[window[order[0]]] - order[0]
        for o in order[1:]:
            if not len(starts):
                break
            starts = starts[_held(lists[window[o]], starts + o)]
        near = none if slop is None else _stretches(sorted(lists.values(), key=len), slop)
        if len(starts) or len(near):
            yield w, starts, near


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HITS = "segment long, k long, spans array<struct<start:long,end:long>>, items array<string>, near_items array<string>"
_HIT_NAMES = ["segment", "k", "spans", "items", "near_items"]


def _search(index: DataFrame, shared: Broadcast, slop: int | None) -> DataFrame:
    """A row for each document of a segment (its k-th) that one block's windows hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for b in batches:
            for s in range(b.num_rows):
                n = b.column(1)[s].values.to_numpy()
                first = np.cumsum(n + GAP) - n - GAP
                terms, counts = np.frombuffer(b.column(2)[s].as_py(), "<u8"), np.frombuffer(b.column(3)[s].as_py(), "<i4").astype(np.int64)
                # Differences start anew with each term in value, not in the running sum.
                postings = np.cumsum(np.frombuffer(b.column(4)[s].as_py(), "<i4"), dtype=np.int64)
                edge: dict[int, list] = defaultdict(list)
                items, near_items = defaultdict(set), defaultdict(set)
                for w, starts, near in search_segment(tests, terms, counts, postings, slop):
                    size = len(tests.windows[w])
                    for p, d in zip(starts.tolist(), (np.searchsorted(first, starts, side="right") - 1).tolist(), strict=True):
                        edge[d].append((p - int(first[d]), p - int(first[d]) + size))
                        items[d].update(tests.owners[w])
                    for d in np.unique(np.searchsorted(first, near, side="right") - 1).tolist():
                        near_items[d].update(tests.owners[w])
                found = sorted(edge.keys() | near_items.keys())
                columns = [_merged(edge[d]) for d in found], [sorted(items[d]) for d in found], [sorted(near_items[d]) for d in found]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[s].as_py()] * len(found), pa.int64()), pa.array(found, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (_SPANS, pa.list_(pa.string()), pa.list_(pa.string())), strict=True))], _HIT_NAMES)

    return index.select("segment", "n_words", "terms", "counts", "postings").mapInArrow(run, _HITS)


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


def _merge(hits: DataFrame) -> DataFrame:
    """One row per document that blocks hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [_merged([(s["start"], s["end"]) for x in row for s in x]) for row in b.column(2).to_pylist()]
            names = [[sorted({i for x in row for i in x}) for row in b.column(c).to_pylist()] for c in (3, 4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, _SPANS), *(pa.array(x, pa.list_(pa.string())) for x in names)], _HIT_NAMES)

    lists = [F.collect_list(c).alias(c) for c in _HIT_NAMES[2:]]
    return hits.groupBy("segment", "k").agg(*lists).mapInArrow(run, _HITS)


def _blocks(benchmark: DataFrame, window: int, block_chars: int) -> Iterator[Tests]:
    """The benchmark in blocks of at most block_chars characters or one item, read as a stream."""
    part, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        size = len(r["text"] or "")
        if part and held + size > block_chars:
            yield Tests(part, window)
            part, held = [], 0
        part.append((r["item_id"], r["text"]))
        held += size
    if part:
        yield Tests(part, window)


def search_index(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = 2 * WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document of an index: doc_id, n_words, spans of words inside exact phrase matches
    (word places, merged), items with such, and near_items, of which some window has all
    its terms within a stretch of slop words (None: not looked for).

    Each block of the benchmark is broadcast and searched on the whole stored index; what
    blocks find is merged for the documents that they hit. Items without words are never
    found; an item without id counts for spans alone. An empty benchmark finds nothing.
    """
    if window > GAP or (slop or 0) > GAP:
        raise ValueError(f"window and slop are at most {GAP} words")
    spark: SparkSession = index.sparkSession
    paths = []
    for tests in _blocks(benchmark, window, block_chars):
        shared = spark.sparkContext.broadcast(tests)
        paths.append(new_path(spark, "contamination-hits"))
        stage(_search(index, shared, slop), "contamination-hits", paths[-1])
        shared.destroy()
    hits = spark.read.schema(_HITS).parquet(*paths) if paths else spark.createDataFrame([], _HITS)
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("k", "x"))
    merged = _merge(hits).withColumnsRenamed({"segment": "__segment", "k": "__k"})
    out = rows.join(merged, (F.col("segment") == F.col("__segment")) & (F.col("k") == F.col("__k")), "left")
    lists = [F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in _HIT_NAMES[2:]]
    out = stage(out.select(F.col("x.doc_ids").alias("doc_id"), F.col("x.n_words").alias("n_words"), *lists), "contamination")
    for p in paths:
        drop_path(spark, p)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = 2 * WINDOW, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """search_index on an index of docs that is made for it and deleted again. A row per row
    of docs: null and empty texts have no words, null and repeated ids are like others. An
    empty table of documents gives no rows."""
    path = new_path(docs.sparkSession, "contamination-index")
    out = search_index(build_index(docs, path, id_col, text_col), benchmark, window, slop, block_chars)
    drop_path(docs.sparkSession, path)
    return out


def contamination_report(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )
