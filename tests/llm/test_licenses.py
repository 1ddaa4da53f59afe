from __future__ import annotations

import math
import re
from collections import Counter

from clonarium.llm.licenses import AGREE, ANCHORS, BASE, LICENCES, STRETCH, scan
from tests.llm.fixtures import SCHEMA, corpus, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall(lower(text or ""))


def places(w, phrase):
    p = phrase.split()
    return [i for i in range(len(w)) if w[i : i + len(p)] == p]


def brute(text):
    w = cut(text)
    hits = [(i, label) for p, label in BASE for i in places(w, p)]
    return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def brute_labels(texts):
    """Labels and score of each text: every stretch is laid against every offset of the text."""
    docs = [cut(t) for t in texts]
    df = Counter(x for w in docs for x in set(w))
    weight = lambda x: math.log((1 + len(docs)) / (1 + df[x])) + 1e-3
    parts = []
    for _, text, _ in LICENCES:
        w = cut(text)
        n = math.ceil(len(w) / STRETCH)
        own = []
        for j in range(n):
            s = w[len(w) * j // n : len(w) * (j + 1) // n]
            rare = sorted(set(s), key=lambda x: (-weight(x), x))[:ANCHORS]
            own.append([(p, x) for p, x in enumerate(s) if x in rare])
        parts.append(own)
    out = []
    for w in docs:
        found, best = {label for p, label in BASE if places(w, p)}, 0.0
        for (label, _, keys), own in zip(LICENCES, parts, strict=True):
            got = 0.0
            for s in own:
                sums = [sum(weight(x) for p, x in s if 0 <= o + p < len(w) and w[o + p] == x) for o in range(-len(w), len(w)) if sum(0 <= o + p < len(w) and w[o + p] == x for p, x in s) >= max(min(AGREE, len(s)), math.ceil(len(s) / 2))]
                got += max(sums, default=0.0)
            if got and all(places(w, k) for k in keys):
                found.add(label)
                best = max(best, min(1.0, got / sum(weight(x) for s in own for _, x in s)))
        out.append((",".join(sorted(found)), best))
    return out


def test_base_equals_brute_force(spark):
    rows = corpus() + [(1, "CC BY cc-by CC, by! General Public License", "x"), (2, "cc  by" * 3, "x"), (3, "İcc by K all RIGHTS reserved\x00cc\x7fby", "x"), (4, "the license " * 3000 + "mit license", "x")]
    got = scan(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "row")).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(str((d, *brute(t))) for d, t, *_ in rows)
    for r in got:
        assert 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_labels_and_score_equal_brute_force(spark):
    filler = "lorem ipsum dolor sit amet the license of this software is provided " * 2
    texts = [f"{filler} {text} {filler}" for _, text, _ in LICENCES]
    texts += [t.replace("software", "program", 1) for t in texts]  # edits
    texts += [" ".join(cut(t)[::-1]) for t in texts[:6]] + [filler, "", None, "version license the public general 3 gnu", "the mit license", "Kind of permission"]
    texts += [text[: len(text) // 2] for _, text, _ in LICENCES] + [LICENCES[i][1] + " " + LICENCES[-i][1] for i in range(1, 8)]
    got = {r.doc_id: (r.labels, r.score) for r in scan(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i, (labels, score) in enumerate(brute_labels(texts)):
        assert got[i][0] == labels, (texts[i], got[i][0], labels)
        assert abs(got[i][1] - score) < 1e-9


def test_licences_are_found_in_prose_and_nothing_else(spark):
    filler = "lorem ipsum dolor sit amet " * 20
    rows = [(i, f"{filler}\n// {text.upper()}.\n{filler}", "x") for i, (_, text, _) in enumerate(LICENCES)] + [(100, filler, "x"), (101, "version license the public general 3 gnu", "x")]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (label, *_) in enumerate(LICENCES):
        assert label in got[i].labels.split(","), label
        assert got[i].score > 0.99
    assert got[100].labels == "" and got[100].score == 0
    assert got[101].labels == ""


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_several_licences_in_one_text_are_all_found(spark):
    texts = {label: text for label, text, _ in reversed(LICENCES)}
    long_mit = next(t for label, t, _ in LICENCES if label == "mit" and "hereby" in t)
    four = ["mit", "apache-2.0", "gpl-3.0", "cc-by-nc-4.0"]
    sets = [["mit", "gpl-3.0"], ["apache-2.0", "mit", "cc-by-nc-4.0"], four, list(texts)]
    rows = [(i, "\n".join(texts[x] for x in labels), "x") for i, labels in enumerate(sets)]
    rows += [(10 + i, f"{long_mit}\n{texts[x]}", "x") for i, x in enumerate(four[1:])]
    rows += [(20, f"{texts['mit']} any person obtaining charge for creative commons universal domain public dedication", "x")]
    # Common words elsewhere make the MIT line's words the least rare ones.
    rows += [(1000 + i, texts["mit"], "x") for i in range(60)]
    got = {r.doc_id: set(r.labels.split(",")) for r in scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, labels in enumerate(sets):
        assert set(labels) <= got[i], set(labels) - got[i]
    for i, x in enumerate(four[1:]):
        assert {"mit", x} <= got[10 + i], x
    assert "mit" in got[20]
