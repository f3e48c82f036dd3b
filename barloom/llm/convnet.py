"""A quality classifier: a convolutional network over bytes, in numpy.

Filters of WIDTH bytes run over the whole text. Their outputs, cut at zero, are max-pooled over
chunks of 256 bytes of which each shares 64 bytes with the next; a document is the mean and the
maximum of its chunks, combined by a logistic output into one probability.

Filters are weights by place and byte, so a filter is a sum of table look-ups. To score, the
tables of two neighbouring places are joined into one over pairs of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, join_small, release
from .tokens import blocks

WIDTH = 4
STEP = 64  #: bytes of a block; a chunk is CHUNK blocks, and starts CHUNK - 1 blocks after the one before
CHUNK = 4
#: Chunks of a long text that are scored at once.
CHUNKS_A_PIECE = 1 << 11


@dataclass
class Net:
    table: np.ndarray  #: WIDTH x 256 x filters
    bias: np.ndarray
    by_mean: np.ndarray
    by_max: np.ndarray
    offset: float


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each between at least WIDTH - 1 zeros and filled to whole blocks, and the block at which each starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n_blocks = blocks_of(sizes)
    start = np.concatenate([[0], np.cumsum(n_blocks)])
    data = np.zeros(start[-1] * STEP + WIDTH, np.uint8)
    for t, at in zip(texts, start[:-1] * STEP + WIDTH - 1):
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return data, start


def blocks_of(sizes: np.ndarray) -> np.ndarray:
    return -(-(sizes + 2 * (WIDTH - 1)) // STEP)


def chunks_of(start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block of each chunk, and the first chunk of each text."""
    n_blocks = np.diff(start)
    n = np.maximum(1, -(-(n_blocks - 1) // (CHUNK - 1)))
    first = np.concatenate([[0], np.cumsum(n)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], n)
    begin = np.repeat(start[:-1], n) + k * (CHUNK - 1)
    return begin, np.minimum(begin + CHUNK, np.repeat(start[1:], n)), first


def outputs(net: Net, data: np.ndarray, n_bytes: int) -> Iterator[np.ndarray]:
    """Each filter's output at each byte."""
    pair = (data[:-1].astype(np.int32) << 8) | data[1:]
    for f in range(net.table.shape[2]):
        two = [(net.table[k, :, f][:, None] + net.table[k + 1, :, f][None, :]).ravel() for k in range(0, WIDTH, 2)]
        out = two[0][pair[:n_bytes]]
        for j in range(1, WIDTH // 2):
            out += two[j][pair[2 * j : 2 * j + n_bytes]]
        yield out + net.bias[f]


def pooled(net: Net, texts: list[bytes], places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Max-pooled outputs by chunk and filter, the first chunk of each text, the laid out bytes and, if asked for, where each maximum is."""
    data, start = layout(texts)
    begin, end, first = chunks_of(start)
    cuts = np.stack([begin, end], 1).ravel()
    top, where = [], []
    for out in outputs(net, data, start[-1] * STEP):
        by_block = out.reshape(-1, STEP)
        high = np.append(by_block.max(1), np.float32(-np.inf))
        top.append(np.maximum.reduceat(high, cuts)[::2])
        if places:
            inside = np.minimum(begin[:, None] + np.arange(CHUNK), end[:, None] - 1)
            block = inside[np.arange(len(begin)), high[inside].argmax(1)]
            where.append(block * STEP + by_block.argmax(1)[block])
    return np.stack(top, 1), first, data, np.stack(where, 1) if places else None


def combine(net: Net, chunk: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability, mean and maximum by text."""
    on = np.maximum(chunk, 0)
    mean = np.add.reduceat(on, first[:-1], axis=0) / np.diff(first)[:, None]
    most = np.maximum.reduceat(on, first[:-1], axis=0)
    z = mean @ net.by_mean + most @ net.by_max + net.offset
    return 1 / (1 + np.exp(-np.clip(z, -40, 40))), mean, most


def long_pooled(net: Net, text: bytes) -> np.ndarray:
    """Max-pooled outputs by chunk and filter of one text, laid out and read CHUNKS_A_PIECE chunks at a time."""
    n_blocks = int(blocks_of(np.array([len(text)]))[0])
    n_chunks, out = max(1, -(-(n_blocks - 1) // (CHUNK - 1))), []
    for k in range(0, n_chunks, CHUNKS_A_PIECE):
        low = k * (CHUNK - 1)
        high = min(n_blocks, (k + CHUNKS_A_PIECE) * (CHUNK - 1) + 1)
        data = np.zeros((high - low) * STEP + WIDTH, np.uint8)
        begin = low * STEP - (WIDTH - 1)  # of the piece, in the text
        piece = np.frombuffer(text[max(0, begin) : begin + len(data)], np.uint8)
        data[max(0, -begin) : max(0, -begin) + len(piece)] = piece
        first, last, _ = chunks_of(np.array([0, high - low]))
        top = []
        for values in outputs(net, data, (high - low) * STEP):
            by_block = np.append(values.reshape(-1, STEP).max(1), np.float32(-np.inf))
            top.append(np.maximum.reduceat(by_block, np.stack([first, last], 1).ravel())[::2])
        out.append(np.stack(top, 1))
    return np.concatenate(out)


def score_texts(net: Net, texts: list[bytes]) -> np.ndarray:
    if len(texts) == 1 and len(texts[0]) > CHUNKS_A_PIECE * (CHUNK - 1) * STEP:
        chunk = long_pooled(net, texts[0])
        return combine(net, chunk, np.array([0, len(chunk)]))[0]
    chunk, first, _, _ = pooled(net, texts)
    return combine(net, chunk, first)[0]


def train(texts: list[bytes], labels: np.ndarray, filters: int = 16, epochs: int = 24, batch: int = 64, rate: float = 0.02, seed: int = 0) -> Net:
    """Adam on the log loss, gradients going through the places of the maxima."""
    rng = np.random.default_rng(seed)
    net = Net(
        rng.normal(0, 0.3, (WIDTH, 256, filters)).astype(np.float32), np.zeros(filters, np.float32),
        rng.normal(0, 0.1, filters).astype(np.float32), rng.normal(0, 0.1, filters).astype(np.float32), 0.0,
    )
    share = labels.mean() if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        net.by_mean[:], net.by_max[:], net.offset = 0, 0, 0.0 if not len(labels) else (4.0 if share else -4.0)
        return net
    net.offset = float(np.log(share / (1 - share)))
    names = ["table", "bias", "by_mean", "by_max", "offset"]
    m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            chunk, first, data, where = pooled(net, [texts[i] for i in own], True)
            p, mean, most = combine(net, chunk, first)
            g = ((p - labels[own]) / len(own)).astype(np.float32)
            n = np.diff(first)
            text_of = np.repeat(np.arange(len(own)), n)
            on = np.maximum(chunk, 0)
            g_chunk = (g / n)[text_of][:, None] * net.by_mean + np.where(on == most[text_of], g[text_of][:, None] * net.by_max, 0)
            g_chunk = np.where(chunk > 0, g_chunk, 0)
            g_table = np.zeros(net.table.shape)
            for k in range(WIDTH):
                for f in range(filters):
                    g_table[k, :, f] = np.bincount(data[where[:, f] + k], g_chunk[:, f], 256)
            grads = {"table": g_table + 1e-5 * net.table, "bias": g_chunk.sum(0), "by_mean": g @ mean + 1e-4 * net.by_mean, "by_max": g @ most + 1e-4 * net.by_max, "offset": g.sum()}
            t += 1
            now = rate * (1 - epoch / epochs)
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                step = now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, (getattr(net, k) - step).astype(np.float32) if k != "offset" else float(net.offset - step))
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 1 << 26, seed: str = "cnn", **training: object) -> Net:
    """A net from about `sample` rows of labels (doc_id, label 0 or 1), as many of either label as there are up to half of it.

    Rows are chosen by a hash of doc_id before their texts are looked up in docs (doc_id, text), so
    the labels sent to where the texts are number about `sample`. Training reads whole texts; rows
    are taken in the order of the hash while their texts together have sample_bytes or less, longer
    ones than a sixteenth of that being passed over. These bounds hold for training alone. As either label is drawn at its own rate, the output's offset
    is moved to the share that label 1 has among all labels. Rows with a null doc_id, text or label
    are left out, the highest label of a doc_id counts, and without any label the net answers 0.5.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return train([], np.zeros(0))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, min(1.0, sample / 2 / sizes.get(1, 1))).otherwise(min(1.0, sample / 2 / sizes.get(0, 1)))
    chosen = cut(rows.where(u < share).withColumn("u", u))
    found = cut(join_small(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), chosen, ["doc_id"], "inner"))
    fits = F.octet_length("text") <= sample_bytes // 16
    told = sorted((r["u"], str(r["doc_id"]), r["n"]) for r in found.where(fits).select("u", "doc_id", F.octet_length("text").alias("n")).collect())
    held = np.cumsum([n for *_, n in told])
    most = told[int(np.searchsorted(held, sample_bytes, side="right")) - 1][0] if len(told) else -1.0
    got = found.where(fits & (F.col("u") <= most)).toPandas().sort_values(["u", "doc_id", "text"])
    release(chosen, found)
    y = got["label"].to_numpy(np.float64)
    net = train([t.encode("utf-8", "surrogatepass") for t in got["text"]], y, **training)
    if len(y) and 0 < y.mean() < 1:
        net.offset += float(np.log(sizes[1] / sizes[0]) - np.log(y.mean() / (1 - y.mean())))
    return net


def classify(docs: DataFrame, net: Net) -> DataFrame:
    """docs with score, the probability of label 1.

    Needs text; other columns stay. A null text scores as an empty one, which is one chunk of zeros.
    Texts are read whole, in blocks of bounded size.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    keep = [f for f in docs.schema.fields if f.name != "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = np.zeros(len(batch))
            for first, part in blocks(batch["text"].tolist(), 1 << 18):
                score[first : first + len(part)] = score_texts(sent.value, part)
            out = batch[[f.name for f in keep]].copy()
            out["score"] = score
            yield out

    return docs.select(*[f.name for f in keep]).mapInPandas(run, schema)
