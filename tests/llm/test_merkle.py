import random
from hashlib import sha256

from pyspark.sql import functions as F

from saffron.llm import merkle
from tests.llm.rows import ODD, docs


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), the long way round."""
    import zlib

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: levels([x[2] for x in sorted(langs[n], key=lambda x: x[:3])]) for n in names}
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(langs[name], key=lambda x: x[:3])):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[1] if r[1] is None or not hit else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            folded, proof = leaf_of(r[0], text, *r[2:]), []
            for tree, at in ((trees[name], i), (top, place)):
                for nodes in tree[:-1]:
                    run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
                    left, right = run[: at % 8], run[at % 8 + 1 :]
                    proof += left + right
                    folded, at = h(*left, folded, *right), at // 8
            out.append((r[0], leaf, trees[name][-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0]))
    return out


def check(spark, rows, df=None):
    have = [tuple(r) for r in merkle.manifest(docs(spark, rows) if df is None else df).collect()]
    assert sorted(map(str, have)) == sorted(map(str, brute([(*r, *(None,) * (5 - len(r))) for r in rows])))


def test_odd_rows_and_extra_columns(spark):
    check(spark, ODD)
    check(spark, ODD, docs(spark, clash=True).repartition(5))
    check(spark, [(1, "Alone", "en", None, 5)])
    assert merkle.manifest(docs(spark, [])).collect() == []


def test_sizes_around_runs_with_many_languages(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for lang, count in ((None, 1), ("aa", 7), ("b", 8), ("é", 9), ("z", 63), ("Z", 64), ("ab", 65), *[(f"l{i}", 2) for i in range(70)]):
        for _ in range(count):
            n += 1
            rows.append((n * 37 % 1009, f"Text {n} É" if n % 5 else None, lang, None if n % 3 else "web", n))
    rng.shuffle(rows)
    check(spark, rows, docs(spark, rows).repartition(6))


def test_one_repeated_row_is_a_third_of_all_and_spreads(spark):
    rows = [(7, "The same", "en", "web", 8)] * 700 + [(i, f"Doc {i}", "en" if i % 9 else "de", "web", 5) for i in range(1300)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = docs(spark, rows).repartition(8)
        check(spark, rows, df)
        parts = merkle.ranked(df).groupBy("part").count().agg(F.max("count")).first()[0]
        assert parts < 200  # the equal rows are split
        assert merkle.root(df) == brute([(*r,) for r in rows])[0][3]  # RDD.treeReduce comes to the same root
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_forests_merge_in_any_order_and_keep_little():
    rng = random.Random(1)
    leaves = [(0, 1000, 1, 0, i, h(str(i))) for i in range(1000)]
    whole = merkle.Forest()
    for x in leaves:
        whole.add(*x)
    want = list(whole.nodes())
    assert len(want) == 1 and want[0][0] == merkle.TOP
    for _ in range(5):
        rng.shuffle(leaves)
        parts = [merkle.Forest() for _ in range(7)]
        for i, x in enumerate(leaves):
            parts[i % 7].add(*x)
        left, right = parts[0], parts[6]
        for p in parts[1:3]:
            left.merge(p)
        for p in (parts[4], parts[3], parts[5]):
            right.merge(p)
        assert list(left.merge(right).nodes()) == want
    piece = merkle.Forest()
    for i in range(123, 877):
        piece.add(0, 1000, 1, 0, i, h(str(i)))
    assert len(list(piece.nodes())) <= 2 * 7 * 4
