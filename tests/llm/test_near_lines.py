"""Near lines against edit similarity alone."""

from __future__ import annotations

import random

from readloom.llm import lines
from tests.llm.test_texts import GOOD, edit


def edited(rng, line, n):
    """``n`` letters changed or inserted at random places."""
    out = list(line)
    for _ in range(n):
        at = rng.choice([i for i, c in enumerate(out) if c != " "])
        out[at : at + rng.randrange(2)] = rng.choice("aeiost")
    return "".join(out)


def made(rng, least, most):
    line = ""
    while len(line) < least or line.count(" ") < 4:
        line = " ".join(rng.choice(GOOD) + rng.choice(["", "xy", "zv", "wq", "k"]) for _ in range(rng.randrange(5, most // 5)))[:most].strip()
    return line


def removed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in lines.dedup_lines(docs).where("n_removed > 0").collect()}


def brute(texts):
    """Lines linked, over any others, with an earlier one."""
    label = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if abs(len(texts[i]) - len(texts[j])) <= 9 and edit(texts[i], texts[j]) <= max(len(texts[i]), len(texts[j])) // 10]
    for _ in range(6):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return {i for i, x in enumerate(label) if x != i}


def test_short_lines_exactly_by_edit_similarity(spark):
    rng = random.Random(11)
    base = [made(rng, 12, 39) for _ in range(40)]
    texts = base + [edited(rng, b, rng.randint(1, max(1, len(b) // 10))) for b in base]
    texts = [t for t in texts if len(t) < lines.SHORT]
    want = brute(texts)
    assert len(want) >= 25
    assert removed(spark, texts) == want


def test_longer_lines_by_edit_similarity(spark):
    rng = random.Random(12)
    base = [made(rng, 40, 95) for _ in range(30)]
    texts = base + [edited(rng, b, rng.randint(1, len(b) // 10)) for b in base]
    want, got = brute(texts), removed(spark, texts)
    assert len(want) >= 30 and got <= want
    assert len(got) >= 0.9 * len(want)


def test_one_changed_word_in_lines_of_all_lengths(spark):
    rng = random.Random(13)
    base = [made(rng, n, 2 * n + 40) for n in range(40, 640, 15)]
    texts = base + [edited(rng, b, 1) for b in base]
    assert removed(spark, texts) == set(range(len(base), len(texts)))


def test_lines_of_few_words(spark):
    texts = ["really really good", "really really goood", "wonderfulness", "wonderfullness", "short one", "short won", "two extraordinarilylongwordshere inoneline", "two extraordinarilylongwordshere inonelines"]
    assert removed(spark, texts) == {1, 3, 7}
