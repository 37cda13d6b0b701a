"""Language identification with a byte convolutional network.

Bytes are embedded; filters of several widths run over fixed-length windows of a
text; each filter's maximum goes through a softmax. The network is trained in numpy
on a bounded sample of labelled windows, and every window of a text has a say in its
label. As an embedded byte is one of 256 vectors, a filter of width k is a sum of k
table look-ups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Bytes of a window.
LENGTH = 128
#: Widths of the filters, filters of each, and dimensions of the embedding.
WIDTHS, FILTERS, DIMENSIONS = (2, 3, 4), 8, 8
#: Bounds of the training sample: documents of a language and of all, but one of each language
#: at least; characters of each.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_BYTES = 600, 50_000, 1024
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Windows in one forward pass.
FORWARD = 512


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # (256, D); byte 0 pads
    filters: list[np.ndarray]  # per width: (k, D, F)
    bias: np.ndarray  # (W * F)
    out: np.ndarray  # (W * F, C)
    out_bias: np.ndarray  # (C)

    def tables(self) -> list[list[np.ndarray]]:
        """Per width and place in the filter: what each byte adds, (256, F)."""
        return [[np.ascontiguousarray(self.embedding @ w[j]) for j in range(len(w))] for w in self.filters]


def start(languages: list[str], seed: int = 7) -> Network:
    r = np.random.default_rng(seed)
    d, f = DIMENSIONS, FILTERS
    return Network(
        languages,
        r.normal(0, 0.5, (256, d)).astype(np.float32),
        [r.normal(0, (2 / (k * d)) ** 0.5, (k, d, f)).astype(np.float32) for k in WIDTHS],
        np.zeros(len(WIDTHS) * f, np.float32),
        r.normal(0, 0.3, (len(WIDTHS) * f, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )


def windows(data: bytes, length: int = LENGTH) -> np.ndarray:
    """Consecutive windows of a whole text, (n, length), the last padded with 0."""
    n = max(1, -(-len(data) // length))
    return np.frombuffer(data.ljust(n * length, b"\0"), np.uint8).reshape(n, length)


def features(net: Network, x: np.ndarray, tables=None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Max-pooled activations (n, W * F) and the places of the maxima."""
    pooled, places = [], []
    for table in tables or net.tables():
        k = len(table)
        n = x.shape[1] - k + 1
        act = table[0][x[:, :n]]
        for j in range(1, k):
            act += table[j][x[:, j : j + n]]
        at = act.argmax(1)
        places.append(at)
        pooled.append(np.take_along_axis(act, at[:, None, :], 1)[:, 0])
    return np.maximum(np.concatenate(pooled, 1) + net.bias, 0), places


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(samples: list[tuple[bytes, str]], seed: int = 7) -> Network:
    """A network fitted by Adam on windows of the samples; the languages are the
    labels that occur, in order. Needs a sample at least."""
    languages = sorted({lang for _, lang in samples})
    net = start(languages, seed)
    index = {x: i for i, x in enumerate(languages)}
    x = np.concatenate([windows(t) for t, _ in samples])
    y = np.concatenate([np.full(len(windows(t)), index[lang]) for t, lang in samples])
    share = np.bincount(y, minlength=len(languages)) / len(y)
    weight = (1 / (len(languages) * share))[y].astype(np.float32)
    params = [net.embedding, *net.filters, net.bias, net.out, net.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    order = np.random.default_rng(seed + 1)
    for _ in range(EPOCHS):
        mixed = order.permutation(len(x))
        for b in range(0, len(x), BATCH):
            rows = mixed[b : b + BATCH]
            step += 1
            for q, grad in enumerate(gradients(net, x[rows], y[rows], weight[rows])):
                m[q] += 0.1 * (grad - m[q])
                v[q] += 0.001 * (grad * grad - v[q])
                params[q] -= RATE * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)
    return net


def loss(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Weighted mean cross-entropy of windows."""
    p = softmax(features(net, x)[0] @ net.out + net.out_bias)
    return float(-(weight * np.log(p[np.arange(len(x)), y])).sum() / len(x))


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """The loss's derivatives by embedding, filters, bias, out and out_bias."""
    h, places = features(net, x)
    p = softmax(h @ net.out + net.out_bias)
    p[np.arange(len(x)), y] -= 1
    p *= weight[:, None] / len(x)
    dh = (p @ net.out.T) * (h > 0)
    d_embedding, d_filters, done = np.zeros_like(net.embedding), [], 0
    for w, at in zip(net.filters, places, strict=True):
        g = dh[:, done : done + w.shape[2]]
        done += w.shape[2]
        dw = np.zeros_like(w)
        for j in range(len(w)):
            byte = np.take_along_axis(x, at + j, 1)  # (n, F)
            dw[j] = np.einsum("nf,nfd->df", g, net.embedding[byte])
            np.add.at(d_embedding, byte.ravel(), (g[:, :, None] * w[j].T[None]).reshape(-1, w.shape[1]))
        d_filters.append(dw)
    return [d_embedding, *d_filters, dh.sum(0), h.T @ p, p.sum(0)]


def predict(net: Network, texts: list[bytes], tables=None) -> tuple[list[int], list[float]]:
    """Label and score of each text: log-probabilities are summed over all its windows,
    each by its share of bytes, and the mean's softmax is the score."""
    tables = tables or net.tables()
    x = np.concatenate([windows(t) for t in texts])
    n = np.array([max(1, -(-len(t) // LENGTH)) for t in texts])
    logits = np.concatenate([features(net, x[i : i + FORWARD], tables)[0] @ net.out + net.out_bias for i in range(0, len(x), FORWARD)])
    logp = np.log(softmax(logits.astype(np.float64)) + 1e-12)
    weight = np.full(len(x), LENGTH, np.float64)
    weight[np.cumsum(n) - 1] = [max(1, len(t) - (k - 1) * LENGTH) for t, k in zip(texts, n.tolist(), strict=True)]
    begin = np.cumsum(n) - n
    mean = np.add.reduceat(logp * weight[:, None], begin) / np.add.reduceat(weight, begin)[:, None]
    p = softmax(mean)
    best = p.argmax(1)
    return best.tolist(), p[np.arange(len(p)), best].tolist()


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text is 2 modulo 4; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_DOCS, most: int = SAMPLE_ALL) -> list[tuple[bytes, str]]:
    """About per_language documents of each language, fewer each if there are more than
    most / per_language languages, but one at least: of those with a label and a letter that
    aren't held out, by a hash of id and text (equal rows count once), each with SAMPLE_BYTES
    characters at a hashed place. Every label that such a document has is learned."""
    text = F.col(text_col).cast("string")
    h = F.xxhash64(F.col(id_col).cast("string"), text, F.lit("sample"))
    known = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"), h.alias("h"))
    place = F.pmod("h", F.lit(1 << 20))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(place, "h")).alias("least")).collect()  # a row per language
    if not counts:
        return []
    share = min(per_language, most / len(counts))
    rates = docs.sparkSession.createDataFrame([(r["lang"], share / r["n"] * (1 << 20), r["least"]["h"]) for r in counts], "l string, rate double, least long")
    chosen = known.join(F.broadcast(rates), F.col("lang") == F.col("l")).where((place < F.col("rate")) | (F.col("h") == F.col("least")))
    at = F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.length("text") - SAMPLE_BYTES)) + 1
    cut = chosen.select("lang", "h", F.substring("text", at.cast("int"), F.lit(SAMPLE_BYTES)).alias("text")).distinct()
    rows = cut.orderBy("h", "lang", "text").limit(2 * most + len(counts)).collect()  # twice what is due: never met
    return [(r["text"].encode(), r["lang"]) for r in rows]


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs: `und` with score 0 for
    texts that are null or have no letter, and for all without a network (no labels).

    Only text is an input of a prediction. Whole texts are read in windows; repeated
    rows give repeated rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for b in sliced(batches):
            texts, letters = b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()
            label, score = ["und"] * len(texts), [0.0] * len(texts)
            rows = [i for i, ok in enumerate(letters) if ok and net]
            while rows:
                part, size = [], 0
                while rows and size < 1 << 20:
                    part.append(rows.pop())
                    size += len(texts[part[-1]])
                for i, k, s in zip(part, *predict(net, [texts[i] for i in part], tables), strict=True):
                    label[i], score[i] = net.languages[k], s
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(label), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def crc_held_out(doc_id: int) -> bool:
    """The same rule as held_out, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
