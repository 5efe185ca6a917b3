import random
import re

import pytest

from saffron.llm import neardup
from tests.llm.rows import ODD, docs


def brute(rows, words, percent):
    """{place of the row: (n_shingles, component_id)} by comparing all pairs."""
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    names = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            names[root(i)] = min(names.get(root(i), row[0]), row[0])
    return sorted(((r[0], len(s), names.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def have(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_odd_rows(spark, words, percent):
    rows = [r for r in ODD if len(r[1] or "") < 1000]
    assert have(neardup.near_duplicates(docs(spark, rows, clash=True), words, percent)) == brute(rows, words, percent)
    assert neardup.near_duplicates(docs(spark, []), words, percent).count() == 0


def test_chains_and_edited_copies_equal_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(2):
        text = [rng.choice(vocabulary) for _ in range(90)]
        for _ in range(7):  # each a small edit of the one before, so the ends of a chain are far apart
            rows.append((n, " ".join(text)))
            n += 1
            text[rng.randrange(90)] = rng.choice(vocabulary)
    hub = [rng.choice(vocabulary) for _ in range(90)]
    for _ in range(12):  # edits of one hub, most of which are only linked through it
        copy = list(hub)
        for _ in range(2):
            copy[rng.randrange(90)] = f"own{n}"
        rows.append((n, " ".join(copy)))
        n += 1
    rng.shuffle(rows)
    assert have(neardup.near_duplicates(docs(spark, rows), 3, 85)) == brute(rows, 3, 85)


def test_first_of_each_keeps_columns(spark):
    df = docs(spark, [(1, "a b c d e f g"), (2, "A B C d e f g"), (3, None), (None, "a b c d e f g")], clash=True)
    out = neardup.first_of_each(df)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "None"]


def test_first_of_each_decides_by_row(spark):
    a, b = "a b c d e f g", "one two three four five six seven"
    rows = [(1, a), (2, a.upper()), (2, b), (3, b), (5, "q r s t u v w"), (5, "q r s t u v w"), (None, "k l m n o p"), (None, "k l m n o p"), (8, None), (8, None)]
    out = sorted(((r["doc_id"], r["text"]) for r in neardup.first_of_each(docs(spark, rows, clash=True)).collect()), key=str)
    assert out == sorted([(1, a), (2, b), (5, "q r s t u v w"), (None, "k l m n o p"), (8, None), (8, None)], key=str)


def test_a_large_group_and_long_texts_equal_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    rows = []
    for n in range(160):  # one group of edits, few words being put in, so that edits are shared; many miss the threshold
        copy = list(base)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(80)] = f"new{rng.randrange(3)}"
        rows.append((n, " ".join(copy)))
    long = [rng.choice(vocabulary) + str(i % 97) for i in range(40_000)]
    rows += [(500, " ".join(long)), (501, " ".join(long[:2000] + ["x"] + long[2001:])), (502, " ".join(long[:20_000]))]
    assert have(neardup.near_duplicates(docs(spark, rows), 3, 85)) == brute(rows, 3, 85)
    assert have(neardup.near_duplicates(docs(spark, rows), 5, 80)) == brute(rows, 5, 80)
