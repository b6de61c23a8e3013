"""Quality, languages, lines, decontamination and page text on small fixtures."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from readloom.llm import decontam, html, langid, lines, quality
from readloom.llm.components import components

GOOD = "the cat and the dog went to the house in the morning and it was good for all of them to be there with us ".split()


def prose(rng, n):
    return " ".join(rng.choice(GOOD) + (rng.choice("abcdefgh") if rng.random() < 0.3 else "") for _ in range(n))


def corpus(n=240):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        text, kind = prose(rng, rng.randrange(30, 90)), i % 6
        if kind == 0:
            text = re.sub(r"\s", "!! ", text.upper())
        elif kind == 1:
            text = " | ".join(text.split()) + " |"
        elif kind == 2:
            text = text + " you utter zogwort and " + prose(rng, 20)
        rows.append((i, text, f"k{i}", "x"))
        labels.append((i, 0 if kind < 2 else 1, int(kind == 2)))
    return rows, labels


def test_quality_rejects_junk_and_toxic_texts(spark):
    rows, labels = corpus()
    rows += [(1000, None, "null", "x"), (1001, "", "empty", "x"), (1002, "word " * 30000, "long", "x"), (None, rows[3][1], "no id", "x"), (3, rows[3][1], "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weak_name string, _x string").repartition(4)
    lab = spark.createDataFrame(labels + [(None, None, None), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, lab).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "weak_name", "_x", "weak_label", "quality_score"}
    by = {r.weak_name: r for r in got}
    assert by["null"].text is None and by["empty"].text == ""
    assert all(0 <= r.quality_score <= 1 and 0 <= r.weak_label <= 1 for r in got)
    assert by["no id"].quality_score == by["k3"].quality_score == by["again"].quality_score
    right = [(by[f"k{i}"].quality_score >= 0.5) == (q == 1 and t == 0) for i, q, t in labels]
    assert np.mean(right) >= 0.98
    kept = quality.accepted(docs, lab)
    assert kept.columns == docs.columns
    empty = quality.quality_scores(docs.limit(0), lab.limit(0))
    assert empty.count() == 0


def test_estimate_finds_the_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20000) < 0.7
    votes = np.full((20000, len(quality.RULES)), quality.ABSTAIN)
    share = [0.9, 0.8, 0.7, 0.95]
    for k, s in enumerate(share):
        hit = rng.random(20000) < s
        votes[:, k] = np.where(good, np.where(rng.random(20000) < 0.98, quality.GOOD, quality.BAD), np.where(hit, quality.BAD, quality.GOOD))
    pattern, n = np.unique(votes @ 3 ** np.arange(len(quality.RULES)), return_counts=True)
    p, prior = quality.estimate(pattern, n)
    assert abs(prior[1] - 0.7) < 0.03
    assert np.allclose(p[0, :4, quality.BAD], share, atol=0.03)


def test_languages_of_spans(spark):
    rng = random.Random(4)
    words = {"aa": ["kata", "toka", "maka", "kita"], "bb": ["blunz", "strunk", "wurbst", "flansch"], "cc": ["слово", "много", "весна"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k, "s") for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(500, None, "aa", "s"), (501, "123 ... !", "bb", "s"), (None, rows[0][1], "aa", "s"), (502, rows[1][1], None, "s"), (503, "kata " * 20000, "aa", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    got = {(r.doc_id, r.lang_pred): r for r in langid.predict_languages(docs).collect()}
    import zlib

    for i, text, lang, _ in rows:
        want = "und" if not text or text[0] == "1" else lang or "bb"
        r = got[i, want]
        assert r.score == (0.0 if want == "und" else 1.0)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
    model = langid.train(docs)
    mixed = "Kata toka maka kita kata, toka. " + "Blunz strunk wurbst flansch strunk blunz! " + "слово много весна"
    spans = langid.label_languages(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first().spans
    assert [(s.lang, mixed[s.start : s.stop][:4]) for s in spans] == [("aa", "Kata"), ("bb", "Blun"), ("cc", "слов")]
    assert langid.predict_languages(docs.limit(0)).count() == 0
    assert langid.train(docs.where("lang is null")) is None


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row[0], old = i, row[0]
        for j, y in enumerate(b, 1):
            row[j], old = min(row[j] + 1, row[j - 1] + 1, old + (x != y)), row[j]
    return row[-1]


def brute_lines(rows):
    """Same rule over all pairs of lines; SimHashes as the operator makes them."""
    table = pa.RecordBatch.from_pydict({"uid": list(range(len(rows))), "doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows])})
    found = [r for b in lines._lines(iter([table])) for r in b.to_pylist()]
    found.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["uid"], r["line"]))
    text = [" ".join(re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), (rows[r["uid"]][1] or "").split("\n")[r["line"]]))) for r in found]
    close = []
    for i in range(len(found)):
        for j in range(i):
            allowed = int(max(len(text[i]), len(text[j])) * 0.1 + 1e-9)
            near = None not in (found[i]["sim"], found[j]["sim"]) and bin((found[i]["sim"] ^ found[j]["sim"]) & (1 << 64) - 1).count("1") <= lines.DISTANCE
            # so many edits as the lengths differ by are needed at least
            if text[i] == text[j] or near and abs(len(text[i]) - len(text[j])) <= allowed and edit(text[i], text[j]) <= allowed:
                close.append((i, j))
    label, before = list(range(len(found))), None
    while label != before:
        before = list(label)
        for i, j in close:
            label[i] = label[j] = min(label[i], label[j])
    keep = {(found[i]["uid"], found[i]["line"]) for i in range(len(found)) if label[i] == i}
    listed = {(r["uid"], r["line"]) for r in found}
    out = []
    for uid, (doc_id, t) in enumerate(rows):
        if t is None:
            out.append((doc_id, None))
            continue
        out.append((doc_id, "\n".join(x for k, x in enumerate(t.split("\n")) if (uid, k) in keep or (uid, k) not in listed)))
    return out


def test_lines_like_all_pairs(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice(GOOD) + rng.choice("xyzvwq") for _ in range(rng.randrange(30, 60))) for _ in range(12)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randrange(4)):
            w = rng.choice(base).split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] += "s"
            own.append(" ".join(w) if rng.random() < 0.7 else " ".join(w).upper() + "!")
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n --- \n"), (103, "A.\na\nB"), (104, "b!"), (105, "é è\né è"), (106, "long " * 20000)]
    docs = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, kept string").repartition(5)
    got = lines.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "kept", "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert got == sorted(brute_lines(rows), key=str)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_lines_of_repeated_and_null_ids(spark):
    rows = [(1, "same line here"), (1, "same line here"), (None, "same line here\nown words"), (2, "same line here\nmore of it")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=str) == sorted(
        [(1, "", 1, 1), (1, "", 1, 1), (None, "same line here\nown words", 2, 0), (2, "more of it", 2, 1)], key=str
    )


def items(rng, n=60):
    return [(i, ". ".join(" ".join(rng.choice(GOOD) + rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(5, 14))) for _ in range(3)) + ".") for i in range(n)]


def plain_matches(text, bench):
    """Every window of every text against every item, no index."""
    ix = decontam.Index(bench)
    word, _ = decontam.hashed_words(pa.array([text or ""], pa.large_string()))
    out = set()
    for first in range(0, max(len(word), 1), ix.half):
        held = word[first : first + 2 * ix.half]
        for k, item in enumerate(ix.ids):
            terms, weight = ix.items[k]
            if weight[np.isin(ix.vocabulary[terms], held)].sum() < decontam.LEAST * ix.full[k] - 1e-9:
                continue
            shares = [np.isin(x, decontam.triples(held)).mean() for x in (ix.question[k], ix.answer[k])]
            if min(shares) >= decontam.OVERLAP:
                out.add(item)
    return out


@pytest.mark.parametrize("shard", [20_000, 7])
def test_decontamination_like_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(decontam, "SHARD", shard)
    rng = random.Random(8)
    bench = items(rng)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randrange(5, 400)).split()
        if i % 3 == 0:
            w = rng.choice(bench)[1].split()
            for _ in range(i // 6):
                w[rng.randrange(len(w))] = "other"
            at = rng.randrange(len(text))
            text[at:at] = w
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, ""), (None, bench[0][1]), (102, bench[1][1].upper()), (102, "again"), (103, "long " * 20000 + bench[2][1])]
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, matches int").repartition(4)
    full = spark.createDataFrame(bench + [(900, None), (901, ""), (902, "two words")], "item_id long, text string")
    got = decontam.benchmark_matches(docs, full).collect()
    parts = [[b for b in bench]] if shard > 100 else None
    if parts:
        assert sorted(((r.doc_id, r.text, sorted(m.item_id for m in r.matches)) for r in got), key=str) == sorted(
            ((a, b, sorted(plain_matches(b, bench))) for a, b in rows), key=str
        )
    for r in got:
        held = {i for i, t in bench if r.text and t.lower() in r.text.lower()}
        assert held <= {m.item_id for m in r.matches}
    assert {r.doc_id for r in decontam.clean(docs, full).collect()} >= {100, 101}
    assert decontam.clean(docs, full.limit(0)).count() == len(rows)
    assert decontam.benchmark_matches(docs.limit(0), full).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav></header>
<div class="cookie-notice">We use cookies on this site. <button>Fine</button></div>
<main><article><h1>Head &amp; line</h1><p>First   paragraph with a <a href="x">link</a> in<b>side</b> &eacute;&#233;&#xe9;.
<p>Second one, no end tag<br>new line<div class="ad">Buy now</div><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article></main>
<aside>Related things</aside><div id="comments"><p>reader: this is a long comment that goes on and on and on</p></div>
<form><input value=x><label>Search</label></form><footer>&copy; someone</footer></body></html>"""


def test_page_text():
    assert html.main_text(PAGE) == "Head & line First paragraph with a link inside ééé. Second one, no end tag new line one two a b"
    plain = "<div id=top><a href=1>A</a> <a href=2>B</a></div><div id=content><h2>Title</h2><p>Some long text, with enough words to count.</p><p>And more of it, again with words.</p></div><div class=footer>foot</div>"
    assert html.main_text(plain) == "Title Some long text, with enough words to count. And more of it, again with words."
    for page in ("", " ", "no tags &lt;here&gt;", "<p>", "</p></div>", "<a href='", "<!-- open", "<script>never closed", "<p>a < b</p>"):
        html.main_text(page)
    assert html.main_text("no tags &lt;here&gt;") == "no tags <here>"
    assert html.main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"


def test_pages_query(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t"), (2, "v", "", "t"), (3, "w", "<p>" + "long " * 50000 + "</p>", "t")]
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got if r.page_id != 1] == [(None, None, 0), (2, "v", 0), (3, "w", 249999)]
    assert all(r.n_chars == len(r.text) for r in got)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (301, 300)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, parts.values())) == [list(range(61)), list(range(100, 160)), [300, 301]]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
