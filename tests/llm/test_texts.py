"""Quality rules, language ID, LM scores, licences."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import language, licenses, lm, quality
from helixframe.llm.queries import SQL, vocabulary


def base_brute(x):
    x = x or ""
    ws = [w for w in re.split("[\x20\x09-\x0d]+", x) if w]
    win = collections.Counter(zip(ws, ws[1:], ws[2:]))
    rep = {i + k for i in range(len(ws) - 2) if win[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [l for l in x.split("\n") if re.search("[^\x20\x09-\x0d]", l)]
    n = len(ws)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(rep), n < 50 or 100 * len(rep) > 50 * n


def texts(seed=1, n=60):
    rnd, out = random.Random(seed), []
    for i in range(n):
        w = ["".join(rnd.choices("abcdeéß", k=rnd.randrange(1, 9))) for _ in range(rnd.randrange(0, 120))]
        kind = i % 6
        if kind == 1:
            w = [x + rnd.choice("#%&") for x in w]
        elif kind == 2:
            w = [x.upper() + "!!" for x in w]
        elif kind == 3:
            w = [x for x in w for _ in range(4)]
        out.append((i, rnd.choice([" ", "  ", "\n", " \t"]).join(w) + ("\nsame line here" * 3 if kind == 4 else "")))
    return out


def test_quality_base(docs):
    rows = texts()
    got = {r["doc_id"]: r for r in quality.assess(docs(rows)).collect()}
    for d, x in rows:
        assert tuple(got[d][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base_brute(x)
        assert not (got[d]["base_failed"] and got[d]["kept"])


def test_cascade_is_the_conjunction(docs):
    rows = texts(2)
    b = quality.Batch(pa.array([x for _, x in rows], pa.large_string()))
    want = ~np.any([r.rejects(b) for r in quality.BASE + quality.RULES], axis=0)
    for order in (quality.BASE + quality.RULES, (quality.BASE + quality.RULES)[::-1]):
        assert (quality.cascade(b, order, np.ones(len(rows), bool)) == want).all()
    df = docs(rows)
    assert sorted(r["doc_id"] for r in quality.keep_good(df).collect()) == [d for (d, _), k in zip(rows, want) if k]
    assert sorted(r["doc_id"] for r in quality.assess(df).filter("kept").collect()) == [d for (d, _), k in zip(rows, want) if k]


def test_rules_are_ordered_by_worth(monkeypatch):
    slow = lambda f, t: lambda b: (time.sleep(t), f(b))[1]
    for name, t in (("n_symbols", 0.02), ("n_exclaim", 0.002), ("n_upper", 0.05)):
        monkeypatch.setitem(quality.FEATURES, name, slow(quality.FEATURES[name], t))
    col = lambda n, x: [" ".join([x] * 60)] * n
    order = lambda rows, **k: [r.name for r in quality.order_rules(quality.Batch(pa.array(rows, pa.large_string())), quality.RULES, **k)]
    # as many rejections, a tenth of the cost; what both reject goes to the cheap one
    got = order(col(20, "ab!!") + col(20, "##ab") + col(10, "##!!ab") + col(5, "AB") + col(50, "word"))
    assert got[:3] == ["exclaim", "symbols", "capitals"] and sorted(got) == sorted(r.name for r in quality.RULES)
    # the other way about where exclaim only rejects what symbols rejects too
    assert order(col(40, "##!!ab") + col(400, "##ab") + col(50, "word"))[0] == "symbols"
    assert order([]) == order(["x"], alive=np.array([False])) == [r.name for r in quality.RULES]


def test_quality_edges(odd, empty):
    assert quality.assess(odd).filter("kept").count() == 0 and quality.assess(odd).count() == 10
    assert quality.assess(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns


def forward(word, model, k):
    index = {p: i for i, p in enumerate(model.pieces)}
    w = "▁" + word
    a = [1.0] + [0.0] * len(w)
    for e in range(1, len(w) + 1):
        for s in range(e):
            i = index.get(w[s:e], len(model.pieces) if e - s == 1 else None)
            if i is not None:
                a[e] += a[s] * model.probs[i, k]
    return math.log(a[-1])


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(3)
    make = lambda parts: " ".join("".join(rnd.choices(parts, k=3)) for _ in range(300))
    return language.train({"aa": [make(["the", "ing", "er"])], "bb": [make(["ung", "sch", "ein", "ß"])]}, language.load_pieces(vocabulary("piece_bpe_32k.model")))


def test_forward_sums_all_segmentations(model):
    words = ["theing", "schung", "x", "éé", "日本", "qwertyuiop" * 7, "a" * 300, "ß"]
    got = language.Lattice(model.pieces).log_scores(words, model.probs)
    for w, row in zip(words, got):
        for k in range(2):
            assert row[k] == pytest.approx(forward(w, model, k), rel=1e-9)


def test_language_predicts(docs, model):
    rows = [(1, "Theing ering thether"), (2, "Schung einsch ungß"), (3, None), (4, "12 !? \n"), (5, "½ ² ①"), (6, "Ⅷ 12 ³ \u0301"), (None, "therinG")]
    df = docs(rows)
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, None)] == ["aa", "bb", "und", "und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sorted(str(r["doc_id"]) for r in language.keep_known(df, model).collect()) == ["1", "2", "None"]


def test_words_are_letters_with_their_marks():
    assert language.words_of("हिन्दी É1x² e\u0301t ½\u0301 a_b 日本") == ["हिन्दी", "é", "x", "e\u0301t", "a", "b", "日本"]


def test_language_ties_and_empty(docs, empty, model):
    same = language.Model(["b", "c"], model.pieces, np.repeat(model.probs[:, :1], 2, 1))
    r = language.predict(docs([(1, "theing"), (1, "theing")]), same).collect()
    assert [(x["lang_pred"], x["score"]) for x in r] == [("b", 0.5)] * 2  # the first by name
    assert language.keep_known(empty, model).count() == 0 and language.keep_known(empty, model).columns == empty.columns


def test_training_is_that_of_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba"]
    words = {"ab": 3, "aab": 2, "ba": 1, "x": 1}
    got = language.train({"l": [" ".join(w for w, c in words.items() for _ in range(c))]}, pieces, rounds=2)

    def paths(w):
        if not w:
            return [()]
        return [(p, *r) for n in range(1, len(w) + 1) for p in [w[:n] if w[:n] in pieces else "?" if n == 1 else None] if p for r in paths(w[n:])]

    kinds = [*pieces, "?"]
    p = dict.fromkeys(kinds, 1 / len(kinds))
    for _ in range(2):
        found = dict.fromkeys(kinds, 0.01)
        for w, c in words.items():
            own = [(x, math.prod(p[i] for i in x)) for x in paths("▁" + w)]
            z = sum(v for _, v in own)
            for x, v in own:
                for i in x:
                    found[i] += c * v / z
        p = {k: v / sum(found.values()) for k, v in found.items()}
    assert got.probs[:-1, 0] == pytest.approx([p[k] for k in pieces])
    # the posterior under equal priors
    two = language.Model(["k", "l"], pieces, np.stack([np.full(len(kinds), 0.1), got.probs[:, 0]], 1))
    scorer = language._Scorer(two)
    total, _ = scorer.totals(["ab x"])
    each = [sum(math.log(sum(math.prod(two.probs[kinds.index(i), k] for i in x) for x in paths("▁" + w))) for w in ("ab", "x")) for k in range(2)]
    assert total[0] == pytest.approx(each)


def test_language_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    m = language.fit(docs.filter(rest != 2), language.load_pieces(vocabulary("piece_bpe_32k.model")), 100)
    r = language.predict(docs, m).join(docs.select("doc_id", "lang").filter(rest == 2), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r >= 0.97


def test_language_edges(odd, empty, model):
    assert language.predict(odd, model).count() == 10 and language.predict(empty, model).count() == 0
    nothing = language.fit(empty, model.pieces)
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}


def test_lm_base(docs):
    rows = [(i, x) for i, x in texts(5, 80)] + [(500, None), (501, "")]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r["doc_id"]: r for r in lm.score(docs(rows).repartition(3), held).collect()}
    tokens = {d: (x or "").encode().lower().split() + [None] for d, x in rows}
    train = collections.Counter(t for d, ts in tokens.items() if zlib.crc32(str(d).encode()) % 10 for t in ts)
    n, v = sum(train.values()), len(train)
    for d, ts in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(d).encode()) % 10 == 0, len(ts), sum(train[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
        assert r["score"] < 0


def test_filter_has_no_false_negatives():
    rnd = np.random.default_rng(1)
    keys, counts = rnd.integers(0, 1 << 40, 5000, dtype=np.uint64), rnd.integers(2, 100_000, 5000)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    f = lm.Filter(4, 40, 1, 17)
    data = np.zeros((16, (1 << 17) // 8), np.uint8)
    for b in range(16):
        own = (keys >> np.uint64(36)) == b
        data[b] = f.fill(keys[own], counts[own])
    f.data = data.reshape(-1)
    got = f.counts(keys)
    level = np.searchsorted(lm.LEVELS, counts, "right") - 1
    assert (got >= lm.ESTIMATES[level]).all() and (got == lm.ESTIMATES[level]).mean() > 0.95
    assert (f.counts(rnd.integers(0, 1 << 40, 5000, dtype=np.uint64)) > 0).mean() < 0.1


def test_filter_size_follows_its_entries():
    counts = np.full(20_000_000, 2)  # 8 bits an entry are more than 2^27
    f = lm._plan_filter(counts, 3)
    assert lm.LEVELS[f.first] <= 2 and 1 << f.slice_bits >= lm.ENTRY_BITS * len(counts)


def test_lm_keeps_all_ngrams_at_any_size(docs, monkeypatch):
    held = F.col("doc_id") % 10 == 0
    rows = docs(texts(5, 60)).repartition(3)
    want = {r["doc_id"]: r["score"] for r in lm.score(rows, held).collect()}
    monkeypatch.setattr(lm, "MAX_BITS", 1 << 10, raising=False)  # as an input that large would do, if there were a greatest size
    got = {r["doc_id"]: r["score"] for r in lm.score(rows, held).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_lm_knows_ngrams_that_occur_once(docs):
    rnd = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rnd.integers(0, 500, 30))) for i in range(120)]
    twice = [(1000 + i, x) for i, x in rows[:60]]  # so that longer n-grams get weight
    copies = [(2000 + i, x) for i, x in rows[60:]]
    mixed = [(3000 + i, " ".join(rnd.permutation(x.split()))) for i, x in rows[60:]]
    got = {r["doc_id"]: r["score"] for r in lm.score(docs(rows + twice + copies + mixed), F.col("doc_id") >= 2000).collect()}
    assert all(got[2000 + i] > got[3000 + i] + 20 for i in range(60, 120))


def test_lm_fit_takes_all_blocks(docs):
    rnd = np.random.default_rng(4)
    plain = [" ".join(f"w{x}" for x in rnd.integers(0, 300, 40)) for _ in range(300)]
    alike = [" ".join(f"w{(x + j) % 300}" for j in range(40)) for x in rnd.integers(0, 300, 300)]
    # a block for each of 60 partitions, with the texts of one kind first, then of the other
    got = [
        {r["doc_id"]: r["score"] for r in lm.score(docs(rows).repartitionByRange(60, "doc_id"), F.lit(False)).collect()}
        for rows in ([(i, x) for i, x in enumerate(plain + alike)], [(i, x) for i, x in enumerate(alike + plain)])
    ]
    assert [got[0][i] for i in range(600)] == pytest.approx([got[1][(i + 300) % 600] for i in range(600)], rel=1e-9)


def test_lm_score_by_dictionaries(monkeypatch):
    """Blocks, slices and answers against plain counts; filters with room enough to be exact."""
    monkeypatch.setattr(lm, "ENTRY_BITS", 512)
    monkeypatch.setattr(lm, "FLUSH", 300)
    monkeypatch.setattr(lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 3)}))}))
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choices(["a", "B", "c", "d", "e"] + [f"w{j}" for j in range(30)], k=rnd.randrange(0, 25))), i % 5 == 0) for i in range(120)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "held": [r[2] for r in rows], "text": [r[1] for r in rows]})
    blocks = [b.to_pandas() for b in lm._encode(batch.slice(i, 30) for i in range(0, 120, 30))]
    assert len(blocks) > 2
    counted = pd.concat(b.to_pandas() for b in lm._counts((pa.RecordBatch.from_pandas(x, preserve_index=False) for x in blocks), 4))
    merged = pd.concat(lm._merge(g) for _, g in counted.groupby(["order", "bucket"]))
    totals = merged[merged["block"] == -1]
    model = lm.Model(int(totals["total"].sum()), int(totals["kinds"].sum()))
    model.mix2, model.mix3 = np.linspace(0.2, 0.6, 64), np.linspace(0.3, 0.7, 64)
    got = {}
    for x in blocks:
        seen = lm._answered(x, merged[(merged["block"] == x["block"].iloc[0])], model).iloc[0]
        s = lm.Seen(seen)
        got |= dict(zip(seen["ids"], np.add.reduceat(model.log10(s.counts), s.at)))
    tokens = {d: [*x.lower().split(), "</s>"] for d, x, _ in rows}
    n = collections.Counter()
    for d, _, held in rows:
        if not held:
            t = ["<s>", "<s>", *tokens[d]]
            n.update((w,) for w in tokens[d])
            n.update(zip(t[1:], t[2:]))
            n.update(zip(t, t[1:], t[2:]))
            n[("<s>",)] += 1  # the context of a first word
            n[("<s>", "<s>")] += 1
    assert (model.tokens, model.kinds) == (sum(c for k, c in n.items() if len(k) == 1 and k != ("<s>",)), sum(len(k) == 1 for k in n) - 1)
    said = lambda *k: int(lm.ESTIMATES[np.searchsorted(lm.LEVELS, n[k], "right") - 1]) if n[k] else 0
    for d, ts in tokens.items():
        t, total = ["<s>", "<s>", *ts], 0.0
        for u, v, w in zip(t, t[1:], t[2:]):
            p = (said(w) + 0.1) / (model.tokens + 0.1 * (model.kinds + 1))
            y = model.mix2[int(math.log2(said(v) + 1))] if said(v) else 0
            x = model.mix3[int(math.log2(said(u, v) + 1))] if said(u, v) else 0
            r2, r3 = min(said(v, w) / max(said(v), said(v, w), 1), 1), min(said(u, v, w) / max(said(u, v), said(u, v, w), 1), 1)
            total += math.log10(x * r3 + (1 - x) * (y * r2 + (1 - y) * p))
        assert got[d] == pytest.approx(total, rel=1e-9)


def test_lm_scores_do_not_depend_on_partitions(docs):
    df, held = docs(texts(5, 120)), F.col("doc_id") % 10 == 0
    got = [{r["doc_id"]: r["score"] for r in lm.score(df.repartition(n), held).collect()} for n in (1, 4, 40)]
    assert got[0] == pytest.approx(got[1], rel=1e-9) and got[0] == pytest.approx(got[2], rel=1e-9)


def test_lm_fit_is_that_of_the_tokens():
    rnd = np.random.default_rng(5)
    r, low, kind = rnd.random(20_000) * (rnd.random(20_000) < 0.6), rnd.random(20_000) ** 4 + 1e-9, rnd.integers(0, 5, 20_000)
    got = lm._fit(*np.unique(lm._steps(r, low, kind), return_counts=True))
    for k in range(5):
        a, b, m = r[kind == k], low[kind == k], 0.5
        for _ in range(20):
            m = (m * a / (m * a + (1 - m) * b)).mean()
        assert got[k] == pytest.approx(m, abs=1e-4)


def test_lm_beats_its_base(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    r = lm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_lm_edges(odd, empty):
    got = lm.score(odd, F.lit(None).cast("boolean")).collect()
    assert len(got) == 10 and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm.score(empty, F.lit(False)).count() == 0


def licences_brute(x, templates, per_cent=80):
    """Matches by all runs of units that a unit more would change, by sets of word pairs: (license, dice, start, end, words)."""
    find = lambda t: [(m[0].encode().lower().decode(), m.start(), m.end()) for m in re.finditer("[A-Za-z0-9\x80-\U0010ffff]+", t)]
    words = find(x)
    sets = [{(a[0], b[0]) for a, b in zip(w, w[1:])} for w in (find(t.text) for t in templates)]
    known = set().union(*sets)
    pairs = [(a[0], b[0]) for a, b in zip(words, words[1:])]
    cuts = {len(words)}
    for i in range(1, len(words)):
        if re.search(r"\n|[.!?][\x20\x09-\x0d]", x[words[i - 1][2] : words[i][1]]):
            cuts.add(i)
    i = 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j] in known:
            j += 1
        if j - i >= licenses.STRETCH - 1:
            cuts |= {i, j + 1}
        i = max(j, i + 1)
    cuts = sorted(cuts | {0})
    units = list(zip(cuts, cuts[1:]))
    # a unit of a run: one with a known pair that begins in it (at a run's end: or that ends in it)
    of = lambda a, b: set(pairs[a : b - 1])
    starts = [any(p in known for p in pairs[a:b]) for a, b in units]
    found = []
    for i, (a, _) in enumerate(units):
        for j in range(i, len(units)):
            b = units[j][1]
            own = of(a, b)
            if not starts[i] or not (starts[j] or units[j][0] and pairs[units[j][0] - 1] in known):
                continue
            if i and starts[i - 1] and of(units[i - 1][0], b) == own or j + 1 < len(units) and starts[j + 1] and of(a, units[j + 1][1]) == own:
                continue
            for k, t in enumerate(sets):
                if own and 200 * len(own & t) >= per_cent * (len(own) + len(t)):
                    found.append((2 * len(own & t) / (len(own) + len(t)), a, b, k))
    out = []
    for m in sorted(found, key=lambda m: (-m[0], m[1] - m[2], m[1], m[3])):
        if all(m[2] <= o[1] or m[1] >= o[2] for o in out):
            out.append(m)
    return sorted((templates[k].license, d, words[a][1], words[b - 1][2], b - a) for d, a, b, k in out)


def test_licences(docs):
    rnd = random.Random(2)
    prose = lambda n: " ".join("".join(rnd.choices("abcdef", k=4)) for _ in range(n))
    rows = []
    for i, t in enumerate(licenses.TEMPLATES):
        w = t.text.split(" ")
        for _ in range(len(w) // 25):
            w[rnd.randrange(len(w))] = "zz"
        rows.append((i, f"{prose(20)}.\n{' '.join(w)}\n{prose(15)}"))
    rows += [(100, prose(50)), (101, "the software is provided"), (102, "MIT License"), (103, "All photos é on this site are licensed under CC BY 4.0, says \u00c9va.")]
    short = [t.text for t in licenses.TEMPLATES if len(t.text) < 200]
    for i in range(60):  # notices with words lost, changed or repeated, side by side and inside sentences
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            w = rnd.choice(short).split(" ")
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = rnd.choice(["zz", "", "the", "License."])
            parts += rnd.choices([prose(rnd.randrange(1, 6)), " ".join(w), " ".join(w)], k=2)
        rows.append((200 + i, rnd.choice([" ", "\n", ". "]).join(parts)))
    got = collections.defaultdict(list)
    for r in licenses.scan(docs(rows)).collect():
        got[r["doc_id"]].append((r["license"], r["dice"], r["start"], r["end"], r["n_words"]))
    for d, x in rows:
        assert sorted(got[d]) == licences_brute(x, licenses.TEMPLATES)
    assert all(any(r[0] == t.license for r in got[i]) for i, t in enumerate(licenses.TEMPLATES) if "zz" not in rows[i][1])
    assert [r[0] for r in got[103]] == ["CC-BY-4.0"]


def test_licence_ties_and_long_texts(docs):
    same = (licenses.Template("A", "one two three four five six"), licenses.Template("B", "one two three four five six"))
    r = licenses.scan(docs([(1, "one two three four five six")]), same).collect()
    assert [(x["license"], x["dice"]) for x in r] == [("A", 1.0)]  # the earlier template
    began = time.perf_counter()
    assert licenses.scan(docs([(1, " ".join([licenses.TEMPLATES[0].text] * 1000))])).count() == 1000
    assert time.perf_counter() - began < 20


def test_licence_edges(odd, empty):
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


def test_oracles_are_of_queries():
    from helixframe.llm.queries import QUERIES

    assert set(SQL) <= set(QUERIES) and len(QUERIES) == 10
