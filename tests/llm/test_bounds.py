"""Bounds of training samples and rounds, the benchmark's blocks, and extraction rules of pages."""

import random

import numpy as np
import pytest

from barloom.llm import convnet, decontaminate, html_text, rules

LONG = "This is a long paragraph of the article, with commas, and some more words that go on; it says a lot. "


def test_a_very_long_labelled_text_is_passed_over(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["ka", "lo", "mi"]) for _ in range(40)) for _ in range(60)]
    docs = [(i, t if i % 2 else t.replace(" ", "*** ")) for i, t in enumerate(good)] + [(i, "x" * 50_000) for i in range(100, 160)]
    labels = [(i, i % 2) for i, _ in docs]
    d, y = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(labels, "doc_id int, label int")
    net = convnet.fit(d, y, sample_bytes=1 << 19, epochs=12)
    score = convnet.score_texts(net, [t.encode() for _, t in docs[:60]])
    assert np.mean((score > 0.5) == np.array([i % 2 == 1 for i in range(60)])) > 0.9


def plain_em(votes, n, rounds):
    """The same model document pattern by pattern, in plain loops."""
    k = len(votes[0])
    classes = range(k + 1)
    prior = lambda c, r: (1.0, 200.0) if c == 0 else (9.0, 10.0) if c - 1 == r else (1.0, 10.0)
    clean = [all(v >= 0 for v in row) for row in votes]
    of = []
    for row, ok in zip(votes, clean):
        first = 0.99 if ok else 0.3
        bad = sum(v < 0 for v in row)
        of.append([first] + [(1 - first) * (1 / k if ok else (row[r] < 0) / bad) for r in range(k)])
    for _ in range(rounds):
        total = sum(n)
        share = [(sum(w[c] * m for w, m in zip(of, n)) + (9.0 * k if c == 0 else 1.0)) / (total + 10.0 * k) for c in classes]
        rate = [[(sum(w[c] * m for w, m, row in zip(of, n, votes) if row[r] < 0) + prior(c, r)[0]) / (sum(w[c] * m for w, m, row in zip(of, n, votes) if row[r] != 0) + prior(c, r)[1]) for r in range(k)] for c in classes]
        new = []
        for row in votes:
            like = [share[c] * np.prod([rate[c][r] if v < 0 else 1 - rate[c][r] if v > 0 else 1.0 for r, v in enumerate(row)]) for c in classes]
            new.append([x / sum(like) for x in like])
        moved = max(abs(a - b) for x, y in zip(of, new) for a, b in zip(x, y))
        of = new
        if moved < 1e-9:
            break
    return [w[0] for w in of]


@pytest.mark.parametrize("seed", range(4))
def test_posterior_is_that_of_plain_loops(seed):
    rng = np.random.default_rng(seed)
    votes = np.unique(rng.integers(-1, 2, (12, 3)), axis=0)
    n = rng.integers(1, 400, len(votes)).astype(float)
    n[(votes >= 0).all(1)] *= 20
    good, rate, share = rules.posterior(votes, n)
    assert good == pytest.approx(plain_em(votes.tolist(), n.tolist(), 50_000), abs=1e-5)
    assert share.sum() == pytest.approx(1.0) and ((rate > 0) & (rate < 1)).all()


def test_an_unfinished_posterior_is_an_error():
    with pytest.raises(RuntimeError, match="still moves"):
        rules.posterior(np.array([[1, 1], [-1, 1], [-1, -1]]), np.array([900.0, 40.0, 30.0]), rounds=1)


def test_one_block_of_the_benchmark_is_held_at_a_time(spark, monkeypatch):
    rng = random.Random(7)
    bench = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(12))) for i in range(60)]
    docs = spark.createDataFrame([(i, "some words before " + t + " and after") for i, t in bench], "doc_id int, text string")
    alive, most = [0], [0]
    make = type(spark.sparkContext).broadcast

    def broadcast(self, value):
        sent = make(self, value)
        alive[0] += 1
        most[0] = max(most[0], alive[0])
        end = sent.destroy

        def destroy(*a):
            alive[0] -= 1
            return end(*a)

        sent.destroy = destroy
        return sent

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    got = decontaminate.contaminated(docs, spark.createDataFrame(bench, "item_id int, text string"), block_bytes=64)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} >= {(i, i) for i, _ in bench}
    assert (most[0], alive[0]) == (1, 0)


def test_an_unnamed_advert_beside_the_article_is_left_out():
    page = f'<body><div class="x3"><p>Buy now! Great offer.</p></div><div class="y1">{"".join(f"<p>{LONG * 2}</p>" for _ in range(5))}</div><div class="x3"><p>Call us today.</p></div></body>'
    assert html_text.main_text(page) == " ".join([(LONG * 2).strip()] * 5)


def test_links_and_hyphenated_names_of_the_article_stay():
    page = f'<body><nav><ul><li><a>Home</a></li></ul></nav><article><h1>T</h1><p>{LONG}</p><p>See <a href="x">The full report on rivers</a>.</p><ul><li><a>First source</a></li><li><a>Second</a></li></ul><div class="privacy-research"><p>{LONG}</p></div><p class="search-algorithms">{LONG}</p><div class="cookie-banner">We use cookies</div><div id="comment-list"><p>{LONG}</p></div></article></body>'
    want = f"T {LONG}See The full report on rivers. First source Second {LONG}{LONG}".strip()
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("value,other", [("site-header", True), ("main_nav", True), ("ad-slot-3", True), ("post-comments", True), ("sidebar", True), ("header-image-credits", False), ("search-algorithms", False), ("privacy-research", False), ("article", False), ("shared-values", False), ("ad", True), ("add", False)])
def test_names(value, other):
    assert html_text.names_other(value) == other


def test_ratios_decide_where_nothing_is_named():
    """A row of links and small print beside the article, with classes that say nothing."""
    page = "<body>" + '<div class="q1"><a>One</a> <a>Two</a> <a>Three</a></div>' + f'<div class="q2">{"".join(f"<p>{LONG}</p>" for _ in range(4))}</div>' + '<div class="q3"><p>All rights.</p><p>Mail us.</p></div></body>'
    assert html_text.main_text(page) == " ".join([LONG.strip()] * 4)
    assert html_text.content_paths(np.array([0, 1, 1, 2]), np.array([5.0, 100, 100, 10]), np.array([0.0, 4, 4, 1]), 1.5).tolist() == [False, True, True, False]
