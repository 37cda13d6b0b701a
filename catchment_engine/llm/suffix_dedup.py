"""Removal of byte strings that occur elsewhere, decided by difference-cover suffix sorting.

1. Each window of SIZE bytes has a canonical anchor, the place of the smallest hash among
   its grams of GRAM bytes: equal windows have equal anchor grams at equal offsets. The
   windows of one anchor are neighbours and make a context.
2. Contexts are reduced, without loss, by counts over all documents: contexts of equal
   bytes are one (their windows are repeated at once), and a gram with one distinct
   context has nothing to be compared with.
3. The remaining contexts meet by gram, in groups of about GROUP contexts. Windows whose
   hash is unique in a group are set aside, and the others' suffixes are sorted by the
   difference-cover algorithm modulo 3: sorted triples at two thirds of the places give
   names, recursion on the names their order, and the remaining third is merged in.
   Neighbouring prefixes of SIZE bytes are compared byte by byte.
4. Groups of one gram are merged by the 128-bit hashes of their distinct windows: one row
   for a window that is repeated within its group, one for each that isn't. A gram in one
   group has nothing to merge.

The same is done for passages, strings of PASSAGE words of one text that also stand in
another: letters are then the words' 64-bit hashes. A gram's lowest bit tells the kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stage, unstage
from .hashing import grouped, mix64, prefix_hash, ragged, run_hash, window_hash, word_hashes

SIZE, GRAM = 400, 160
#: Words of a passage, and of the grams that anchor it.
PASSAGE, PASSAGE_GRAM = 51, 12
#: Distinct contexts of a gram in a group, about 4 MB of them; bytes of whole groups sorted at once.
GROUP, BLOCK = 8000, 1 << 19
BYTES, WORDS = 0, 1
#: Bits of the filters that tell which texts are needed: of fixed size, 8 MB.
FILTER_BITS = 1 << 26


# --- difference-cover suffix sorting ------------------------------------------------


def _pack(parts: list[np.ndarray]) -> np.ndarray:
    """One integer for each row of equally long columns, in the rows' order."""
    key = parts[0]
    for p in parts[1:]:
        width = int(p.max()) + 1 if len(p) else 1
        if len(key) and (int(key.max()) + 1) * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + p
    return key


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """Rank of each suffix of s, whole numbers from 1; the end counts as smallest."""
    n = len(s)
    if n < 3:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(n)
        return out
    t = np.concatenate((s.astype(np.int64), np.zeros(3, np.int64)))
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate((one, two))
    key = _pack([t[sample], t[sample + 1], t[sample + 2]])  # sampled triples
    names, inverse = np.unique(key, return_inverse=True)
    order = inverse if len(names) == len(sample) else suffix_ranks(inverse + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = order + 1
    # The rest by first letter and the sampled rank behind it; then both are merged by
    # counting, with keys of one letter against places 1 and of two against places 2.
    one = one[one < n]
    a = _pack([np.concatenate((t[zero], t[one])), rank[np.concatenate((zero, one)) + 1]])
    both = np.concatenate((zero, two))
    b = _pack([t[both], t[both + 1], rank[both + 2]])
    a0, a1, b0, b2 = a[: len(zero)], a[len(zero) :], b[: len(zero)], b[len(zero) :]
    a0s, b0s = np.sort(a0), np.sort(b0)
    out = np.empty(n, np.int64)
    out[zero] = np.searchsorted(a0s, a0) + np.searchsorted(np.sort(a1), a0) + np.searchsorted(np.sort(b2), b0)
    among = np.empty(len(one) + len(two), np.int64)
    among[np.argsort(rank[np.concatenate((one, two))])] = np.arange(len(among))
    out[one] = among[: len(one)] + np.searchsorted(a0s, a1)
    out[two] = among[len(one) :] + np.searchsorted(b0s, b2)
    return out


def repeated_starts(data: np.ndarray, starts: np.ndarray, size: int, owner: np.ndarray | None = None) -> np.ndarray:
    """Which starts have a window data[start:start + size] that another of them has too, of
    another owner if these are given.

    data: letters from 1, pieces apart by 0. Only starts are compared with each other."""
    rank = np.argsort(suffix_ranks(data)[starts])
    order = starts[rank]
    windows = np.lib.stride_tricks.sliding_window_view(data, size)
    same = np.zeros(len(order) + 1, bool)
    for i in range(0, len(order) - 1, 8192):
        p = order[i : i + 8193]
        same[i + 1 : i + len(p)] = (windows[p[1:]] == windows[p[:-1]]).all(1)
    out = np.zeros(len(starts), bool)
    if owner is None:
        out[rank] = same[:-1] | same[1:]
    elif len(order):
        first = np.flatnonzero(~same[:-1])
        mixed = np.minimum.reduceat(owner[rank], first) != np.maximum.reduceat(owner[rank], first)
        out[rank] = mixed[np.cumsum(~same[:-1]) - 1]
    return out


# --- contexts -----------------------------------------------------------------------


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each window of x, by running values within blocks of the width."""
    n = len(x)
    fill = np.iinfo(x.dtype).max if op is np.minimum else 0
    y = np.concatenate((x, np.full(-n % width, fill, x.dtype))).reshape(-1, width)
    ahead = op.accumulate(y, axis=1).ravel()
    back = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - width + 1], ahead[width - 1 : n])


def contexts(prefix: np.ndarray, lengths: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, gram hash) of each context of texts that stand one after another, of size
    letters each at least, from the whole's prefix_hash: its windows start in first..last."""
    full = run_hash(prefix, gram)
    short = (full >> np.uint64(32)).astype(np.uint32)
    width = size - gram + 1
    least = _slide(short, width, np.minimum)
    edge = np.zeros(width - 1, np.uint32)
    kept = short == _slide(np.concatenate((edge, least, edge)), width, np.maximum)
    places = np.flatnonzero(kept)
    # Each window's anchor is its first place with the smallest hash. Windows across texts
    # have anchors too, which no window within one is given.
    n = lengths - size + 1
    windows = ragged(np.cumsum(lengths) - lengths, n) if len(lengths) > 1 else np.arange(len(least))
    anchor = (np.cumsum(kept, dtype=np.int32) - kept)[windows]
    least = least[windows]
    hashes = short[places]
    wrong = np.flatnonzero(hashes[anchor] != least)
    while len(wrong):
        anchor[wrong] += 1
        wrong = wrong[hashes[anchor[wrong]] != least[wrong]]
    fresh = np.flatnonzero(np.diff(anchor, prepend=np.int32(-1)))
    return windows[fresh], windows[np.concatenate((fresh[1:] - 1, [len(windows) - 1]))], full[places[anchor[fresh]]]


def text_key(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _second(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Another hash of the same windows, from the sums of scattered pairs of letters."""
    wide = data.dtype == np.uint64
    pairs = mix64(data[:-1] * np.uint64(3)) ^ data[1:] if wide else data[:-1].astype(np.uint64) << np.uint64(8) | data[1:]
    scattered = mix64(pairs + np.uint64(1))
    sums, plain = np.zeros(len(data), np.uint64), np.zeros(len(data), np.uint64)
    np.cumsum(scattered * (np.arange(len(pairs), dtype=np.uint64) + np.uint64(1)), out=sums[1:])
    np.cumsum(scattered, out=plain[1:])
    # Weights count from the window's begin.
    return mix64((sums[end - 1] - sums[begin]) - begin.astype(np.uint64) * (plain[end - 1] - plain[begin]))


def _contexts_of(texts: list[np.ndarray], size: int, gram: int, kind: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of contexts of each text, given as its letters, none if it is too short; and
    first, last, g, c1, c2 of all of them in the texts' order."""
    lengths = np.array([len(x) for x in texts], np.int64)
    n, found = np.zeros(len(texts), np.int64), [[np.zeros(0, np.int64)] for _ in range(5)]
    long = np.flatnonzero(lengths >= size)
    for some in grouped([texts[i] for i in long.tolist()], _LETTERS):
        some_long, long = long[: len(some)], long[len(some) :]
        letters = some[0] if len(some) == 1 else np.concatenate(some)
        prefix, lens = prefix_hash(letters), lengths[some_long]
        first, last, g = contexts(prefix, lens, size, gram)
        ends, begin = last + size, np.cumsum(lens) - lens
        text = np.searchsorted(begin, first, "right") - 1
        n[some_long] = np.bincount(text, minlength=len(some))
        g = g & ~np.uint64(1) | np.uint64(kind)
        made = (first - begin[text], last - begin[text], *(x.view(np.int64) for x in (g, window_hash(prefix, first, ends), _second(prefix, first, ends, letters))))
        for column, x in zip(found, made, strict=True):
            column.append(x)
    return n, [np.concatenate(x) for x in found]


#: Bytes of texts whose words are hashed at once; letters of texts whose contexts are found at
#: once, so that arrays of them stay in a processor's cache.
_TEXTS, _LETTERS = 1 << 20, 1 << 16


def _profile(docs: DataFrame, shape: tuple[int, int, int, int]) -> DataFrame:
    """Per document: its bytes and words, the key and digest of its text; and, where a task
    first sees a text, its contexts of both kinds. shape: size and gram of either kind."""
    size, gram, passage, passage_gram = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in sliced(batches):
            n, n_words, keys, digests = [], [], [], []
            columns: list[list] = [[], [], [], [], []]
            sizes = []
            for texts in grouped([x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()], _TEXTS):
                hashes, at = word_hashes(texts)
                here = [text_key(text) for text in texts]
                new = []
                for k, key in enumerate(here):
                    if key not in seen:
                        seen.add(key)
                        new.append(k)
                n.extend(map(len, texts))
                n_words.append(np.diff(at))
                keys.extend(here)
                digests.extend(hashlib.sha256(text).digest() for text in texts)
                (n_bytes, by_bytes), (n_passages, by_words) = (
                    _contexts_of([np.frombuffer(texts[k], np.uint8) for k in new], size, gram, BYTES),
                    _contexts_of([hashes[at[k] : at[k + 1]] for k in new], passage, passage_gram, WORDS),
                )
                # A text's contexts of either kind stand together.
                owner = np.concatenate((np.repeat(np.arange(len(new)), n_bytes), np.repeat(np.arange(len(new)), n_passages)))
                order = np.argsort(owner, kind="stable")
                for column, x, y in zip(columns, by_bytes, by_words, strict=True):
                    column.append(np.concatenate((x, y))[order])
                counts = np.zeros(len(texts), np.int64)
                counts[new] = n_bytes + n_passages
                sizes.append(counts)
            if len(seen) > 500_000:
                seen.clear()
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c) if c else np.zeros(0, np.int64))) for c in columns]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.concatenate(n_words), pa.int64()), pa.array(keys, pa.binary()), pa.array(digests, pa.binary()), *lists], ["doc_id", "n", "n_words", "t", "sha", "first", "last", "g", "c1", "c2"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, n long, n_words long, t binary, sha binary, first array<long>, last array<long>, g array<long>, c1 array<long>, c2 array<long>")


def _place(keys: list[bytes], bits: int) -> np.ndarray:
    first = np.frombuffer(b"".join(k[:6] + b"\0\0" for k in keys), "<u8")
    return (first & np.uint64(bits - 1)).astype(np.int64)


def _filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A filter of bits that every text key passes, as words of 64 bits, combined on the
    executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _place(b.column(0).to_pylist(), bits)
            mask = np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(mask)], ["word", "mask"])

    got = keys.select("t").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64)
    return out


def _texts(docs: DataFrame, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(t, text) of the texts with one of the keys, and of few others; one row per text."""
    words = docs.sparkSession.sparkContext.broadcast(_filter(keys, bits).tobytes())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(words.value, np.int64)
        seen: set[bytes] = set()
        for b in sliced(batches):
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            keys_ = [text_key(x) for x in texts]
            at = _place(keys_, bits)
            new = []
            for i in np.flatnonzero(bitmap[at >> 6] >> (at & 63) & 1).tolist():
                if keys_[i] not in seen:
                    seen.add(keys_[i])
                    new.append(i)
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([keys_[i] for i in new], pa.binary()), pa.array([texts[i] for i in new], pa.binary())], ["t", "text"])

    return docs.mapInArrow(keep, "t binary, text binary").join(keys, "t").dropDuplicates(["t"])


def _cut(texts: DataFrame, size: int, passage: int) -> DataFrame:
    """Rows of the contexts to compare: (kind, g, part, parts, t, at, n, data), data the
    context's letters as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for t, text, lives in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                hashes = None
                for x in lives:
                    first, last, kind = x["first"], x["last"], x["g"] & 1
                    if kind == BYTES:
                        data = text[first : last + size]
                    else:
                        hashes = word_hashes([text])[0] if hashes is None else hashes
                        data = hashes[first : last + passage].tobytes()
                    rows.append((kind, x["g"], x["part"], x["parts"], t, first, last - first + 1, data))
                    held += len(data)
                if held > 8 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    names = ["kind", "g", "part", "parts", "t", "at", "n", "data"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(8)], names)

    return texts.select("t", "text", "lives").mapInArrow(run, "kind int, g long, part long, parts long, t binary, at long, n long, data binary")


_SETTLED = pa.schema([("t", pa.binary()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])


def _compare(rows: list[tuple], size: int) -> pa.RecordBatch:
    """What whole groups' contexts (kind, g, part, parts, t, at, n, data) of one kind tell:
    (t, kind, start, end, null, null) of runs of window starts that are repeated in their
    group; and, of grams in several groups, (t, kind, start, end, h1, h2) of each other
    window, with null start and end of each distinct repeated one."""
    kind = rows[0][0]
    buffer = np.frombuffer(b"".join(r[7] for r in rows), np.uint64 if kind == WORDS else np.uint8)
    lengths, n = np.array([len(r[7]) for r in rows]) // buffer.itemsize, np.array([r[6] for r in rows])
    begin = np.cumsum(lengths) - lengths
    every = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(np.arange(len(rows)), n)
    prefix = prefix_hash(buffer)
    hashes = window_hash(prefix, every, every + size)
    group = np.cumsum([i > 0 and r[1:3] != rows[i - 1][1:3] for i, r in enumerate(rows)])
    mark = np.zeros(len(every), bool)
    # The group is part of the key, so that a group's result is its own.
    _, inverse, counts = np.unique(hashes ^ mix64(group.astype(np.uint64) + np.uint64(1))[row], return_inverse=True, return_counts=True)
    due = np.flatnonzero(counts[inverse] > 1)
    if len(due):
        # Only letters of windows that may be repeated are sorted, pieces apart by 0.
        edge = np.zeros(len(buffer) + 1, np.int32)
        np.add.at(edge, every[due], 1)
        np.add.at(edge, every[due] + size, -1)
        used = np.cumsum(edge)[:-1] > 0
        owner = np.repeat(np.arange(len(rows)), lengths)
        piece = np.flatnonzero(used)
        gap = np.concatenate(([True], (np.diff(piece) > 1) | (np.diff(owner[piece]) != 0)))
        place = np.arange(len(piece)) + np.cumsum(gap)  # each piece has a 0 before it
        letters = np.zeros(place[-1] + 2, np.int64)
        small = buffer[piece].astype(np.int64) if kind == BYTES else np.unique(buffer[piece], return_inverse=True)[1]
        letters[place] = small + 1
        to = np.zeros(len(buffer), np.int64)
        to[piece] = place
        number: dict[bytes, int] = {}
        text = np.array([number.setdefault(r[4], len(number)) for r in rows])
        mark[due] = repeated_starts(letters, to[every[due]], size, text[row[due]] if kind == WORDS else None)
    out = []
    same = np.flatnonzero(mark)
    if len(same):
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(every[same]) > 1) | (np.diff(row[same]) != 0), [True])))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            r = rows[row[same[i]]]
            at = r[5] - int(begin[row[same[i]]])
            out.append((r[4], kind, at + int(every[same[i]]), at + int(every[same[j - 1]]) + 1, None, None))
    found = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(_SETTLED.types)], schema=_SETTLED)
    several = np.array([r[3] > 1 for r in rows])[row]
    if not several.any():
        return found
    first = np.zeros(len(every), bool)  # one of each distinct repeated window of a group
    first[same[np.unique(inverse[same], return_index=True)[1]]] = True
    at = np.flatnonzero(several & (~mark | first))
    start = np.array([r[5] for r in rows])[row[at]] + every[at] - begin[row[at]]
    texts = pa.array([r[4] for r in rows], pa.binary()).take(pa.array(row[at]))
    hashed = [hashes[at].view(np.int64), _second(prefix, every[at], every[at] + size, buffer).view(np.int64)]
    windows = [texts, np.full(len(at), kind, np.int32), pa.array(start, mask=mark[at]), pa.array(start + 1, mask=mark[at]), *hashed]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y if isinstance(y, pa.Array) else pa.array(y)]) for x, y in zip(found.columns, windows, strict=True)], schema=_SETTLED)


def _settle(cut: DataFrame, size: int, passage: int) -> DataFrame:
    """(t, kind, start, end): runs of window starts repeated elsewhere, of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        width = {BYTES: size, WORDS: passage}

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if rows and rows[-1][:3] + rows[-1][4:6] == r[:3] + r[4:6]:
                    continue
                if rows and (rows[-1][0] != r[0] or held > BLOCK and rows[-1][1:3] != r[1:3]):
                    yield _compare(rows, width[rows[0][0]])
                    rows, held = [], 0
                rows.append(r)
                held += len(r[7])
        if rows:
            yield _compare(rows, width[rows[0][0]])

    near = cut.repartition("g", "part").sortWithinPartitions("kind", "g", "part", "t", "at")
    settled = stage(near.mapInArrow(run, "t binary, kind int, start long, end long, h1 long, h2 long"), "repeats-settled")
    owner = F.when(F.col("kind") == BYTES, F.xxhash64("t", "start")).otherwise(F.xxhash64("t"))
    loose = settled.where("h1 IS NOT NULL").withColumn("owner", owner)
    again = loose.groupBy("kind", "h1", "h2").agg(F.max(F.col("start").isNull()).alias("known"), F.min("owner").alias("a"), F.max("owner").alias("b")).where("known OR a <> b").select("kind", "h1", "h2")
    apart = loose.where("start IS NOT NULL").join(again, ["kind", "h1", "h2"]).select("t", "kind", "start", "end")
    return settled.where("h1 IS NULL").select("t", "kind", "start", "end").unionByName(apart)


def _keep(texts: DataFrame, size: int) -> DataFrame:
    """(t, n_removed, n_spans, kept) from (t, text, runs of repeated window starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, text, runs in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                kept, removed, spans, at = hashlib.sha256(), 0, 0, -1
                stop = 0
                for start, end in sorted((r["start"], r["end"] + size - 1) for r in runs):
                    if start > at:
                        spans += 1
                        kept.update(text[stop:start])
                        removed += end - start
                        at = stop = end
                    elif end > at:
                        removed += end - at
                        at = stop = end
                kept.update(text[stop:])
                out.append((t, removed, spans, kept.digest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["t", "n_removed", "n_spans", "kept"])

    return texts.select("t", "text", "runs").mapInArrow(run, "t binary, n_removed long, n_spans long, kept binary")


def repeated_runs(docs: DataFrame, profile: DataFrame, size: int = SIZE, passage: int = PASSAGE, group: int = GROUP) -> DataFrame:
    """(t, kind, start, end) for texts t: runs of places, end exclusive, at which windows
    start that also start anywhere else (bytes) or in another text (words), apart from
    other copies of the whole text."""
    rows = profile.where(F.size("first") > 0).select("t", F.explode(F.arrays_zip("first", "last", "g", "c1", "c2")).alias("x")).select("t", "x.*")
    kind = F.col("g").bitwiseAND(F.lit(1).cast("long"))
    rows = rows.withColumn("place", F.when(kind == BYTES, F.xxhash64("t", "first")).otherwise(F.xxhash64("t")))
    by_content = rows.groupBy("g", "c1", "c2").agg(F.min("place").alias("owner"), F.max("place").alias("other"))
    by_content = stage(by_content.select("g", "c1", "c2", "owner", (F.col("owner") != F.col("other")).alias("dup")), "repeats-contents")
    by_gram = by_content.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = by_content.join(by_gram, "g", "left").where("dup OR m > 1")
    shared = stage(shared, "repeats-shared")
    flagged = rows.join(shared, ["g", "c1", "c2"]).select("t", "first", "last", "g", "dup", F.coalesce((F.col("m") > 1) & (F.col("place") == F.col("owner")), F.lit(False)).alias("live"), F.ceil(F.coalesce("m", F.lit(1)) / group).alias("parts"))
    flagged = stage(flagged, "repeats-flagged")
    sure = flagged.where("dup").select("t", kind.cast("int").alias("kind"), F.col("first").alias("start"), (F.col("last") + 1).alias("end"))
    part = F.pmod(F.xxhash64("t", "first"), F.col("parts"))
    lives = flagged.where("live").groupBy("t").agg(F.collect_set(F.struct("first", "last", "g", part.alias("part"), "parts")).alias("lives"))
    lives = stage(lives, "repeats-lives")
    cut = stage(_cut(_texts(docs, lives.select("t")).join(lives, "t"), size, passage), "repeats-contexts")
    runs = stage(sure.unionByName(_settle(cut, size, passage)).distinct(), "repeats-runs")
    unstage(by_content, shared, flagged, lives, cut)
    return runs


def _covered(runs: DataFrame, size: int) -> DataFrame:
    """(t, covered, spans): places that windows of size cover from the runs of their starts,
    and how many stretches they make. A window over a text's runs, in order."""
    before = Window.partitionBy("t").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("end") + F.lit(size - 1)
    at = runs.select("t", "start", stop.alias("stop"), F.max(stop).over(before).alias("past"))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("past", "start")))
    return at.groupBy("t").agg(F.sum(fresh).alias("covered"), F.count_if(F.col("past").isNull() | (F.col("start") > F.col("past"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_words, n_passage_words,
    n_passages) per row of docs: the bytes covered by a string of size bytes that also
    starts elsewhere are removed, in the same document or another; strings never cross
    documents. n_passage_words: words covered by strings of passage words that also stand
    in another document, n_passages the stretches they make; these are only counted.

    Null texts are empty. Repeated rows are documents with equal texts, so each loses
    what size bytes cover. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = stage(_profile(rows, (size, gram, passage, passage_gram)), "repeats-profile")
    copies = profile.groupBy("t").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    runs = repeated_runs(rows, profile, size, passage, group)
    alone = stage(runs.join(copies, "t", "left_anti"), "repeats-alone")  # a text with copies goes whole
    own = stage(alone.where(F.col("kind") == BYTES).groupBy("t").agg(F.collect_list(F.struct("start", "end")).alias("runs")), "repeats-by-text")
    kept = stage(_keep(_texts(rows, own.select("t")).join(own, "t"), size), "repeats-kept")
    told = stage(_covered(alone.where(F.col("kind") == WORDS), passage), "repeats-passages")
    unstage(runs, alone, own)
    out = profile.select("doc_id", "n", "n_words", "t", "sha").join(kept, "t", "left").join(told, "t", "left").join(copies, "t", "left")
    whole, whole_words = ((F.col("copies") > 1) & (F.col(c) >= least) for c, least in (("n", size), ("n_words", passage)))
    return out.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "sha")))).alias("kept_sha256"),
        "n_words",
        F.when(whole_words, F.col("n_words")).otherwise(F.coalesce("covered", F.lit(0))).cast("long").alias("n_passage_words"),
        F.when(whole_words, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_passages"),
    )
