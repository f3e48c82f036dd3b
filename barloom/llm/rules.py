"""Quality rules under weak supervision.

Every rule votes for a document (+1), against it (-1), or abstains (0). No rule decides alone:
expectation-maximisation estimates, for good documents and for each kind of bad ones apart, how
often each rule votes against one when it votes at all, and how frequent each kind is. A document
is kept if the posterior probability that it is good is a half or more.

Votes only enter through how many documents share each pattern of them, and there are at most 3
to the power of the number of rules patterns, whatever the input's size. So all documents count,
and the driver fits a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, join_small
from .tokens import blocks, find_words, mix64, window_hashes

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: Counts of a text, all of type long.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_shouts", "n_stutters", "top_word"]


@dataclass(frozen=True)
class Rule:
    """Votes against a document from `bad` on and for it up to `good`; abstains between, and below least_words."""

    name: str
    value: Column
    good: float
    bad: float
    least_words: int = 0

    def vote(self) -> Column:
        told = F.when(self.value >= self.bad, -1).when(self.value <= self.good, 1).otherwise(0)
        return F.when(self.value.isNull() | (F.col("n_words") < self.least_words), 0).otherwise(told)


def default_rules() -> list[Rule]:
    per = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return [
        Rule("symbols a word", per("n_symbols", "n_words"), 0.05, 0.2),
        Rule("capitals among letters", F.try_divide(F.col("n_upper").cast("double"), F.col("n_upper") + F.col("n_lower")), 0.2, 0.6),
        Rule("exclamation marks a word", per("n_shouts", "n_words"), 0.05, 0.3),
        Rule("words in repeated windows", per("n_repeat_words", "n_words"), 0.02, 0.3, 20),
        Rule("words equal to the one before", per("n_stutters", "n_words"), 0.02, 0.2),
        Rule("share of the commonest word", per("top_word", "n_words"), 0.12, 0.35, 40),
        Rule("lines seen before", per("n_dup_lines", "n_lines"), 0.05, 0.4, 20),
        Rule("characters a word", per("word_chars", "n_words"), 9.0, 15.0),
        Rule("digits a character", per("n_digits", "word_chars"), 0.1, 0.4),
    ]


def _per_text(words: np.ndarray, text_of: np.ndarray, n_texts: int) -> np.ndarray:
    """The most times that one word occurs in each text."""
    out = np.zeros(n_texts, np.int64)
    if len(words):
        order = np.lexsort((words, text_of))
        w, t = words[order], text_of[order]
        new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (t[1:] != t[:-1])]))
        np.maximum.at(out, t[new], np.diff(np.append(new, len(w))))
    return out


def count_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS of each text. Windows are compared by 64-bit hashes."""
    found = find_words(texts)
    n_texts, n_words = len(texts), np.diff(found.first)
    text_of = np.repeat(np.arange(n_texts), n_words)
    by_byte = lambda mask: np.add.reduceat(mask.astype(np.int64), found.text_start[:-1])
    by_word = lambda mask: np.bincount(text_of, mask, n_texts).astype(np.int64)
    data = found.data
    # characters in words: bytes that start one, less white space
    starts = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starts)])
    repeated = np.zeros(len(found.hash) + 1, np.int32)
    windows = window_hashes(found.hash, WINDOW)
    whole = np.flatnonzero(text_of[: len(windows)] == text_of[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    if len(whole):
        key = mix64(windows[whole] ^ mix64(text_of[whole].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = whole[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + WINDOW, -1)
    n_lines, n_dup = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
    stutter = np.concatenate([[False], (found.hash[1:] == found.hash[:-1]) & (text_of[1:] == text_of[:-1])]) if len(text_of) else np.zeros(0, bool)
    return {
        "n_words": n_words.astype(np.int64), "word_chars": by_word(chars[found.end] - chars[found.start]), "n_symbols": by_byte(_SYMBOL[data]),
        "n_dup_lines": n_dup, "n_repeat_words": by_word(np.cumsum(repeated)[:-1] > 0), "n_lines": n_lines,
        "n_upper": by_byte((data >= 65) & (data <= 90)), "n_lower": by_byte((data >= 97) & (data <= 122)), "n_digits": by_byte((data >= 48) & (data <= 57)),
        "n_shouts": by_byte(data == 33), "n_stutters": by_word(stutter), "top_word": _per_text(found.hash, text_of, n_texts),
    }


def measure(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and COUNTS of each document's whole text; a null text counts as an empty one."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"{c} long" for c in COUNTS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [count_texts(part) for _, part in blocks(batch["text"].tolist())]
            out = batch[keys].copy()
            for c in COUNTS:
                out[c] = np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64)
            yield out

    bound_batches(docs.sparkSession)
    return docs.select(*keys, "text").mapInPandas(run, schema)


def posterior(votes: np.ndarray, n: np.ndarray, rounds: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pattern the probability of a good document; each class's rates of votes against, by rule; each class's share.

    There is one class of good documents, and for each rule one of documents that are bad in its
    way: bad documents differ, and with one class for all of them a text that only one rule
    objects to would look better the more rules there are. Rules are independent within a class,
    and abstaining is independent of it. Beta priors say that a rule seldom objects to good
    documents and mostly to its own kind of bad ones, which also keeps the classes in place. Rounds
    go on until no probability moves by 1e-9; if that takes more than `rounds`, it is an error.
    """
    n_rules = votes.shape[1]
    against, heard = (votes < 0).astype(float), (votes != 0).astype(float)
    clean = ~against.any(1)
    of = np.zeros((len(votes), n_rules + 1))
    of[:, 0] = np.where(clean, 0.99, 0.3)
    of[:, 1:] = (1 - of[:, :1]) * np.where(clean[:, None], 1 / n_rules, against / np.maximum(1, against.sum(1))[:, None])
    prior_hits = np.vstack([np.full(n_rules, 1.0), 8 * np.eye(n_rules) + 1])
    prior_all = np.vstack([np.full(n_rules, 200.0), 10 * np.eye(n_rules) + 10 * (1 - np.eye(n_rules))])
    rate, share = prior_hits / prior_all, np.full(n_rules + 1, 1 / (n_rules + 1))
    for _ in range(rounds):
        weight = of * n[:, None]
        rate = (weight.T @ against + prior_hits) / (weight.T @ heard + prior_all)
        share = (weight.sum(0) + np.where(np.arange(n_rules + 1) == 0, 9.0 * n_rules, 1.0)) / (n.sum() + 10.0 * n_rules)
        log = np.log(share) + against @ np.log(rate).T + (heard - against) @ np.log1p(-rate).T
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved, of = np.abs(new - of).max(initial=0), new
        if moved < 1e-9:
            return of[:, 0], rate, share
    raise RuntimeError(f"the posterior still moves after {rounds} rounds")


def judge(measured: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """measured with `quality`, the posterior probability of a good document.

    Texts without words get votes of no rule or few, so about the share of good documents.
    """
    rules = default_rules() if rules is None else rules
    pattern = F.lit(0)
    for r in rules:
        pattern = pattern * 3 + (r.vote() + 1)
    voted = measured.withColumn("pattern", pattern.cast("long"))
    counts = voted.groupBy("pattern").count().orderBy("pattern").collect()
    codes = np.array([r["pattern"] for r in counts], np.int64)
    votes = np.stack([(codes // 3 ** (len(rules) - 1 - i)) % 3 - 1 for i in range(len(rules))], 1) if len(codes) else np.zeros((0, len(rules)))
    good = posterior(votes, np.array([r["count"] for r in counts], float))[0] if len(codes) else []
    rated = measured.sparkSession.createDataFrame([(int(c), float(g)) for c, g in zip(codes, good)], "pattern long, quality double")
    return join_small(voted, rated, ["pattern"]).drop("pattern")


def assess(docs: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """keys, COUNTS and quality of each document. Needs keys and text; repeated rows give a row each."""
    return judge(cut(measure(docs, keys)))
