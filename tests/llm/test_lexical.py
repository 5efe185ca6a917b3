import math
import re

import pytest

from saffron.llm import lexical
from tests.llm.rows import ODD, docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans(lexical.UPPER, lexical.SMALL)


def brute(rows, items, k=10):
    texts = [(r[0], TERM.findall((r[1] or "").translate(SMALL))) for r in rows]
    n_docs, total = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    asked, df, out = {}, {}, []
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(SMALL)))
    for _, terms in texts:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    for item, words in asked.items():
        found = []
        for doc_id, terms in texts:
            score, m = 0, 10 + 90 * len(terms) * n_docs // max(1, total)
            for w in words:
                if tf := terms.count(w):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def check(spark, rows, items, df=None, k=10):
    asked = spark.createDataFrame(items, "item_id long, text string")
    have = [tuple(r) for r in lexical.search(docs(spark, rows) if df is None else df, asked, k).collect()]
    assert sorted(map(str, have)) == sorted(map(str, brute(rows, items, k)))
    return have


ITEMS = [(1, "The CAT, the dog!"), (2, "köln Grüße nothere"), (3, ""), (4, None), (None, "word long 1234"), (5, "cat"), (5, "dog mat"), (6, "\U0001f600"), (7, "nowhere")]


def test_odd_rows_items_and_extra_columns(spark):
    check(spark, ODD, ITEMS)
    check(spark, ODD, ITEMS, docs(spark, clash=True).repartition(3))
    check(spark, [(None, "cat"), (None, "cat"), (3, "cat"), (4, "hat")], ITEMS)
    assert lexical.search(docs(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []
    assert lexical.search(docs(spark), spark.createDataFrame([], "item_id long, text string")).collect() == []


@pytest.mark.parametrize("window", [8, 64])
def test_windows_ties_and_blocks_of_items(spark, monkeypatch, window):
    monkeypatch.setattr(lexical, "WINDOW", window)
    rows = [(i * 7 % 211, " ".join(f"w{(i * j) % 23}" for j in range(1 + i % 17)) + (" tie" if i % 3 == 0 else "")) for i in range(400)]
    items = [(i, f"w{i} w{i + 1} W{i % 5} tie") for i in range(23)]
    whole = check(spark, rows, items, docs(spark, rows).repartition(3), k=4)
    monkeypatch.setattr(lexical, "TERMS", 20)  # several blocks of items
    assert sorted(map(str, check(spark, rows, items, docs(spark, rows).repartition(5), k=4))) == sorted(map(str, whole))


def test_terms_are_confirmed_by_their_bytes(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(lexical, "span_hashes", lambda data, first, end: np.zeros(len(first), np.uint64))  # all words collide
    words = lexical.Vocabulary(["abc"])
    _, terms, rows, tfs = lexical._postings(pa.array(["abd abc ab abcd abc", None, "xbc"]), words)
    assert (terms.tolist(), rows.tolist(), tfs.tolist()) == ([0], [0], [2])
