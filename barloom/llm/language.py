"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts up to three bytes long. A byte that was seen after a
context has the probability n / (N + U) there, N being the bytes seen after the context and U the
different ones; one that wasn't costs the escape U / (N + U) and is looked up after the context
less its first byte, down to no context and then to 1/256. The counts are frozen before any text
is scored, so the probability of a byte after a context is one number, and a text's code length
under a language is an exact sum over its bytes.

The trees of a few languages share their nodes. They are tables of transitions, walked for all
bytes of a batch at once. Languages are taken FAMILY at a time, so that with many of them no table
has a column for each language and a row for each gram that any of them has.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, release
from .tokens import blocks

ORDER = 4  #: bytes of the longest context, and the byte it predicts
UNKNOWN = "und"
#: Languages whose trees share their nodes.
FAMILY = 4
#: Bytes of a text that are coded at once; longer texts are walked in pieces, whose code lengths add up.
PIECE = 1 << 18
#: Entries up to which transitions are a table by context and byte; more are looked up in a sorted list.
DENSE = 1 << 23


def crc_of_id(modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def _grams(texts: list[bytes]) -> np.ndarray:
    """Each byte with the three before it; a text starts after three spaces."""
    data = np.frombuffer(b"   " + b"   ".join(texts), np.uint8).astype(np.uint32)
    grams = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + 3) - lengths - 3
    keep = np.zeros(len(grams) + 1, np.int32)
    np.add.at(keep, starts, 1)
    np.add.at(keep, starts + lengths, -1)
    return grams[np.cumsum(keep)[:-1] > 0]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            for _, texts in blocks(rows["text"].tolist()):
                gram, n = np.unique(_grams(texts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n.astype(np.int64)})


@dataclass
class ContextTrees:
    """What is sent to executors: counts of grams by language. Tables are built where they are used."""

    langs: list[str]
    gram: np.ndarray
    counts: np.ndarray  #: by gram and language
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def tables(self) -> "Tables":
        if self.key not in _BUILT:
            _BUILT.clear()
            _BUILT[self.key] = Tables(self)
        return _BUILT[self.key]


@dataclass
class Languages:
    """The trees of all languages, a family after the other."""

    parts: list[ContextTrees]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def langs(self) -> list[str]:
        return [x for p in self.parts for x in p.langs]

    def tables(self) -> "Families":
        if self.key not in _BUILT:
            _BUILT.clear()  # a worker that is used again holds the tables of one model
            _BUILT[self.key] = Families([Tables(p) for p in self.parts])
        return _BUILT[self.key]


@dataclass
class Families:
    tables: list["Tables"]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        return np.hstack([t.code_lengths(texts) for t in self.tables])


_BUILT: dict[str, "Tables | Families"] = {}


class Tables:
    def __init__(self, model: ContextTrees) -> None:
        grams, counts = model.gram.astype(np.int64), model.counts.astype(np.float64)
        n_langs = len(model.langs)
        spread = lambda k: grams & ((1 << 8 * k) - 1)  # noqa: E731  the last k bytes
        nodes, held = {}, {}
        for k in range(1, ORDER + 1):
            ends = spread(k)
            heads = [(grams >> 8 * (ORDER - j)) & ((1 << 8 * k) - 1) for j in range(k, ORDER)]  # also what stands before other bytes
            nodes[k] = np.unique(np.concatenate([ends, *heads]))
            at = np.searchsorted(nodes[k], ends)
            held[k] = np.stack([np.bincount(at, counts[:, j], len(nodes[k])) for j in range(n_langs)], 1) if n_langs else np.zeros((len(nodes[k]), 0))
        self.code = np.zeros(256, np.int64)
        self.code[nodes[1]] = np.arange(1, len(nodes[1]) + 1)
        letters = len(nodes[1]) + 1
        # escape[k][i], cost[k][i]: bits by language; node 0 is one that never was seen
        root_n, root_u = held[1].sum(0), (held[1] > 0).sum(0)
        p = np.vstack([np.zeros(n_langs), held[1]])
        bits = lambda a, b: -np.log2(np.maximum(a, 1e-300) / np.maximum(b, 1e-300))
        lowest = bits(np.maximum(root_u, 1), root_n + np.maximum(root_u, 1)) + 8.0
        cost = {1: np.where(p > 0, bits(p, root_n + root_u), lowest)}
        self.escape, self.step = {}, {}
        for k in range(2, ORDER + 1):
            context = np.searchsorted(nodes[k - 1], nodes[k] >> 8)
            last = self.code[nodes[k] & 255]
            n = np.stack([np.bincount(context, held[k][:, j], len(nodes[k - 1])) for j in range(n_langs)], 1) if n_langs else np.zeros((len(nodes[k - 1]), 0))
            u = np.stack([np.bincount(context, held[k][:, j] > 0, len(nodes[k - 1])) for j in range(n_langs)], 1) if n_langs else n
            self.escape[k - 1] = np.vstack([np.zeros(n_langs), np.where(n > 0, bits(u, n + u), 0.0)])
            shorter = cost[k - 1][np.searchsorted(nodes[k - 1], nodes[k] & ((1 << 8 * (k - 1)) - 1)) + 1]
            own = np.where(held[k] > 0, bits(held[k], (n + u)[context]), self.escape[k - 1][context + 1] + shorter)
            cost[k] = np.vstack([np.zeros(n_langs), own])
            places, size = (context + 1) * letters + last, (len(nodes[k - 1]) + 1) * letters
            if size <= DENSE:
                step = np.zeros(size, np.int32)
                step[places] = np.arange(1, len(nodes[k]) + 1)
                self.step[k] = step
            else:
                order = np.argsort(places)
                self.step[k] = places[order], order.astype(np.int64) + 1
        self.letters = letters
        self.cost = {k: np.ascontiguousarray(v.T.astype(np.float32)) for k, v in cost.items()}
        self.escape = {k: np.ascontiguousarray(v.T.astype(np.float32)) for k, v in self.escape.items()}

    def follow(self, k: int, places: np.ndarray) -> np.ndarray:
        step = self.step[k]
        if not isinstance(step, tuple):
            return step[places]
        at = np.minimum(np.searchsorted(step[0], places), len(step[0]) - 1)
        return np.where(step[0][at] == places, step[1][at], 0)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language. Long texts are coded in pieces, each after the bytes before it."""
        lead = ORDER - 1
        pieces = [(i, b" " * lead + t[:PIECE] if not at else t[at - lead : at + PIECE]) for i, t in enumerate(texts) for at in range(0, max(1, len(t)), PIECE)]
        if len(pieces) == len(texts):
            return self.piece_lengths([p for _, p in pieces])
        out = np.zeros((len(texts), len(self.cost[1])))
        for i, p in pieces:
            out[i] += self.piece_lengths([p])[0]
        return out

    def piece_lengths(self, pieces: list[bytes]) -> np.ndarray:
        """Bits of each piece but for its first ORDER - 1 bytes, which are only context."""
        n_langs, texts = len(self.cost[1]), pieces
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) - (ORDER - 1)
        starts = ends - lengths
        code = self.code[data]
        node = {1: code}
        for k in range(2, ORDER + 1):
            node[k] = np.zeros(len(code), np.int64)
            node[k][1:] = self.follow(k, node[k - 1][:-1] * self.letters + code[1:])
        inside = np.zeros(len(code) + 1, np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + lengths, -1)
        inside = np.cumsum(inside)[:-1] > 0
        unseen = np.flatnonzero((node[ORDER] == 0) & inside)
        out = np.zeros((len(texts), n_langs))
        for j in range(n_langs):
            bits = np.where(inside, self.cost[ORDER][j][node[ORDER]], np.float32(0))
            at, extra = unseen, np.zeros(len(unseen), np.float32)
            for k in range(ORDER - 1, 0, -1):
                extra = extra + self.escape[k][j][node[k][at - 1]]
                found = node[k][at] > 0 if k > 1 else np.ones(len(at), bool)
                bits[at[found]] = extra[found] + self.cost[k][j][node[k][at[found]]]
                at, extra = at[~found], extra[~found]
            total = np.concatenate([[0.0], np.cumsum(bits, dtype=np.float64)])
            out[:, j] = total[starts + lengths] - total[starts]
        return out


def fit(labelled: DataFrame, sample_docs: int = 2000, seed: str = "ppm") -> Languages:
    """Trees from about `sample_docs` whole documents a language, chosen by a hash of doc_id.

    labelled: doc_id, text, lang; rows with a null among text and lang are left out. Every language
    is learned, and every run of four bytes of its sample counts: the model grows with languages
    and the sample, not with the table. An empty table gives a model without languages.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return Languages([])
    share = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, sample_docs / r["count"])) for r in sizes], "lang string, share double")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(share), "lang").where(u < F.col("share")).select("lang", "text")  # a row a language
    grams = sample.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = cut(grams)
    langs, parts = sorted(r["lang"] for r in sizes), []
    for i in range(0, len(langs), FAMILY):
        own = langs[i : i + FAMILY]
        found = grams.where(F.col("lang").isin(own)).toPandas()
        gram, at = np.unique(found["gram"].to_numpy(np.int64), return_inverse=True)
        counts = np.zeros((len(gram), len(own)))
        np.add.at(counts, (at, np.searchsorted(np.array(own, object), found["lang"].to_numpy(object))), found["n"].to_numpy(float))
        parts.append(ContextTrees(own, gram, counts))
    release(grams)
    return Languages(parts)


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """docs with lang_pred, score and bits_per_byte.

    Needs text; other columns stay. lang_pred is the language with the shortest code (the first by
    name of equals), or `und`, with score 0, if the text is null or has no letter or the model no
    language. score is the posterior probability of that language, all being equally likely
    before. bits_per_byte is its code length (null with `und`). Texts are coded whole.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "bits_per_byte")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", lang_pred string, score double, bits_per_byte double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = sent.value
        tables = trees.tables() if trees.langs else None
        names = np.array([*trees.langs, UNKNOWN], object)
        for batch in batches:
            texts = batch["text"].tolist()
            best, score, rate = np.full(len(texts), len(trees.langs)), np.zeros(len(texts)), np.full(len(texts), np.nan)
            for first, part in blocks(texts, 1 << 18) if tables else ():
                bits = tables.code_lengths(part)
                own = slice(first, first + len(part))
                some = np.fromiter((any(map(str.isalpha, t)) if isinstance(t, str) else False for t in texts[own]), bool, len(part))
                k = bits.argmin(1)
                p = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                best[own] = np.where(some, k, len(trees.langs))
                score[own] = np.where(some, p, 0.0)
                rate[own] = np.where(some, bits.min(1) / np.maximum(1, [len(b) for b in part]), np.nan)
            out = batch[[f.name for f in keep]].copy()
            out["lang_pred"], out["score"] = names[best], score
            out["bits_per_byte"] = pd.Series(rate, index=out.index).astype(object).where(~np.isnan(rate), None)
            yield out

    return docs.select(*[f.name for f in keep]).mapInPandas(run, schema)
