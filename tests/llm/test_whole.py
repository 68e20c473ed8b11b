"""Links, leaks and scores that a shortcut lost once."""

import itertools
import random

import numpy as np
import pytest

from brindle.llm import decontam, neardup, toxicity

from .helpers import DOCS
from .test_operators import brute_components, tokens


def test_nested_texts_are_linked(spark):
    r = random.Random(12)
    docs = []
    for k in range(25):  # the shortest has the smallest id, and links with neither of the others directly or only with the middle one
        words = [f"w{r.randrange(10**6)}" for _ in range(404)]
        docs += [(3 * k + i, " ".join(words[: 4 + 4 * share])) for i, share in enumerate((74, 76, 100))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_components(df).collect()}
    want = brute_components(docs)
    assert all(want[3 * k + i][1] == 3 * k for k in range(25) for i in range(3))
    assert got == want


def test_texts_beside_unlike_firsts_are_linked(spark):
    r = random.Random(13)
    docs = []
    for k in range(10):  # twelve short beginnings with the smallest ids share buckets with the pair that links
        words = [f"w{r.randrange(10**6)}" for _ in range(404)]
        docs += [(20 * k + i, " ".join(words[: 4 + 4 * share])) for i, share in enumerate((*range(40, 52), 78, 100))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_components(df).collect()} == brute_components(docs)


def test_copies_of_a_short_text_score_alike():
    toxic = [b"vile", b"vile vile", b"vile words here", b"you vile"]
    clean = [b"calm", b"calm sea", b"a calm day", b"day b"]
    y = np.array([1] * len(toxic) * 20 + [0] * len(clean) * 20)
    model = toxicity.train(toxic * 20 + clean * 20, y, updates=60)
    for text in (b"vile", b"vile vile", b"x", b"vile x"):
        alone = model.scores([text])[0]
        assert model.scores([text] * 50) == pytest.approx(np.full(50, alone), abs=1e-5)
    assert model.scores([b"vile"] * 3).min() > toxicity.THRESHOLD
    assert model.scores([b"you vile", b"vile words here"])[1] == pytest.approx(model.scores([b"vile words here"])[0], abs=1e-5)
    assert model.scores([b"calm", b"", b"calm"])[2] == pytest.approx(model.scores([b"calm"])[0], abs=1e-5)
    assert model.scores([b"day b", b"vile"])[0] == pytest.approx(model.scores([b"day b"])[0], abs=1e-5)


def holds(doc, item):
    """By all segments of all alignments: is there one with enough equal words, three quarters of it at least?"""
    a, b = tokens(doc), tokens(item)
    need = max(5, min(12, -(-3 * len(b) // 4)))
    for shift in range(-len(b) + 1, len(a)):
        same = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
        places = [k for k, x in enumerate(same) if x]
        if any(j - i + 1 >= need and 4 * (j - i + 1) >= 3 * (places[j] - places[i] + 1) for i in range(len(places)) for j in range(i, len(places))):
            return True
    return False


def test_short_items_with_two_substitutions(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(12, 19)]
    docs, of = [], []
    for n, text in items:
        for pair in itertools.combinations(range(n), 2):
            words = text.split()
            for k in pair:
                words[k] = "changed"
            docs.append((len(docs), " ".join(["before", *words, "after"])))
            of.append(n)
    for places in ((2, 5, 8, 11), (1, 4, 7, 10, 13)):  # too many
        words = items[3][1].split()
        for k in places:
            words[k] = "changed"
        docs.append((len(docs), " ".join(words)))
    words = [f"i18w{k}" for k in range(18)]
    docs.append((len(docs), " ".join(words[:8])))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, n) for d, t in docs for n, u in items if holds(t, u)}
    rows = decontam.find_leaks(df, b).collect()
    assert {(d, n) for d, n in enumerate(of)} == want
    assert {(x.doc_id, x.item_id) for x in rows} == want
    assert all(x.share >= 0.75 and x.n_matched >= min(12, -(-3 * x.item_id // 4)) for x in rows)


def test_part_of_a_wide_segment(spark):
    """The best segment by +1 and -2 is the whole, under three quarters equal; a part of it is enough."""
    item = [f"w{k}" for k in range(73)]
    doc = [w if k < 12 or k == 72 or (k - 12) % 3 else "x" for k, w in enumerate(item)]
    df = spark.createDataFrame([(1, " ".join(doc), None, None, None)], DOCS)
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert holds(" ".join(doc), " ".join(item)) and sum(a == b for a, b in zip(doc, item, strict=True)) / 73 < 0.75
    assert [(x.n_matched, x.share, x.first_word) for x in decontam.find_leaks(df, b).collect()] == [(36, 0.75, 0)]
