"""N-gram Jaccard join, components and substring dedup against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from helixframe.llm import components, hot, jaccard, substrings
from tests_llm_brute import repeats_of


def brute(rows, k=5, t=80):
    sets = []
    for _, x in rows:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both * 100 >= t * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, groups, size, edits):
    rnd, rows = random.Random(seed), []
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    for g in range(groups):
        base = [word() for _ in range(rnd.randrange(30, 90))]
        for _ in range(rnd.randrange(1, size)):
            w = list(base)
            for _ in range(rnd.randrange(edits)):
                w[rnd.randrange(len(w))] = word()
            rows.append(" ".join(w if rnd.random() < 0.9 else w[: len(w) // 2]))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("small,block,args", [(16, 256, (1, 12, 8, 4)), (2, 4, (2, 4, 40, 4))])
def test_jaccard_brute(spark, docs, monkeypatch, small, block, args):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(*args)
    got = jaccard.jaccard_components(docs(rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_hot_keys_are_dealt_out(spark, docs, monkeypatch):
    rows = [(i, k, i % 7) for i, k in enumerate([1] * 300 + [2] * 40 + list(range(3, 60)))]
    df = spark.createDataFrame(rows, "id int, k int, v int")
    side = df.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 5").withColumn("x", F.col("k") * 2)
    want = sorted((i, k, v, 2 * k) for i, k, v in rows if k != 5)
    for least, most in ((1000, 100_000), (10, 20), (1, 1000)):
        monkeypatch.setattr(hot, "LEAST", least)
        monkeypatch.setattr(hot, "MOST", most)
        got = hot.join_hot(df, side, "k", "n", len(rows), "id")
        assert sorted((r["id"], r["k"], r["v"], r["x"]) for r in got.collect()) == want
        got = hot.join_hot(df, side, ["k"], "n", len(rows), "id", "left")
        assert sorted((r["id"], r["x"]) for r in got.collect() if r["k"] != 5) == [(i, x) for i, _, _, x in want] and got.count() == len(rows)
    # the same through the whole operator, with copies and near copies beyond any threshold
    monkeypatch.setattr(hot, "LEAST", 2)
    monkeypatch.setattr(hot, "MOST", 10)
    monkeypatch.setattr(jaccard, "SHARE", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    base, rnd = [f"w{i}" for i in range(60)], random.Random(1)
    rows = [(i, " ".join(base)) for i in range(30)]
    for i in range(30, 90):
        w = list(base)
        w[rnd.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"y{i}z{j}" for j in range(20))) for i in range(20)] + [(200, None), (201, " ")]
    assert sorted(map(tuple, jaccard.jaccard_components(docs(rows)).collect())) == brute(rows)


def test_leaves_end_the_search(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "DEPTH", 0)
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = corpus(3, 4, 25, 4)
    assert sorted(map(tuple, jaccard.jaccard_components(docs(rows)).collect())) == brute(rows)


def test_jaccard_edges(odd, empty):
    got = collections.Counter(map(tuple, jaccard.jaccard_components(odd).collect()))
    assert got[(1, 0, 1)] == got[(2, 0, 2)] == got[(3, 0, 3)] == 1 and got[(4, 1, 4)] == 2 and got[(6, 1, 6)] == 1
    assert got[(None, 1, None)] == 1 and got[(None, 0, None)] == 1
    assert jaccard.jaccard_components(empty).count() == 0


def test_keep_one(docs, odd):
    df = docs([(5, "a b c d e f"), (3, "A B c d e f"), (9, "x y"), (1, None)])
    kept = jaccard.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 9] and kept.columns == df.columns
    assert jaccard.keep_one(odd).count() == 10


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()))
    assert {x: root(x) for x in up if root(x) != x} == {x: r for x, r in got.items() if x != r}


def test_spans_brute(docs):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdeé", k=5))
    passages = [" ".join(word() + rnd.choice(["", "", "", ".", ","]) for _ in range(60)) for _ in range(4)]
    rows = []
    for d in range(40):
        own = [" ".join(word() for _ in range(rnd.randrange(5, 30))) for _ in range(4)]
        if rnd.random() < 0.6:
            p = rnd.choice(passages)
            own[1] += rnd.choice([" ", "\n", "  "]) + (p.upper() if p.isascii() and rnd.random() < 0.3 else p) + " "
        rows.append((d, rnd.choice(["\n", " "]).join(own)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + "\n" + rows[3][1])]
    got = sorted((r["doc_id"], r["start"], r["end"], r["n_words"]) for r in substrings.repeated_spans(docs(rows), 20).collect())
    want = sorted(repeats_of(rows, 20))
    assert got == want and len(want) > 10
    cleaned = {r["doc_id"]: r for r in substrings.remove_repeats(docs(rows), 20).collect()}
    cut = collections.defaultdict(list)
    for d, s, e, _ in want:
        cut[d].append((s, e))
    for d, x in rows:
        for s, e in sorted(cut[d], reverse=True):
            x = x[:s] + x[e:]
        assert cleaned[d]["text"] == x and cleaned[d]["n_chars"] == len(x)


def test_passages_of_few_words_are_found(docs):
    rnd = random.Random(7)
    rows = []
    for i in range(40):  # a passage of one to three words of its own, over and over, inside other words of one line
        few = [f"p{i}x{j}" for j in range(1 + i % 3)]
        passage = rnd.choices(few, k=200)
        for d in (i, 1000 + i):
            rows.append((d, " ".join([f"a{d}"] + passage + [f"z{d}"])))
    got = collections.Counter()
    for r in substrings.repeated_spans(docs(rows), 20).collect():
        got[r["doc_id"]] += r["n_words"]
    assert all(got[1000 + i] >= 165 for i in range(40))


def test_spans_edges(odd, empty):
    assert substrings.repeated_spans(empty).count() == 0
    out = substrings.remove_repeats(odd)
    assert out.count() == 10 and out.columns == odd.columns
    assert out.filter(F.col("text").isNull()).count() == 2
