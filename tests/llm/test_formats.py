"""WARC, packing, top-k and sampled segmentations."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import packing, sampling, topk, warc
from helixframe.llm.queries import QUERIES, vocabulary


# --- WARC


@pytest.fixture
def pages(spark):
    big = "<p>" + "x" * 200
    return spark.createDataFrame([(5, "http://a", big), (2, "http://b", big), (9, None, big), (3, "u\r\nv%0D", "é" * 99), (4, "http://c", "small"), (6, "http://d", "small"), (7, "http://e", None), (8, "http://f", ""), (2, "http://b", big), (None, "http://g", big)], "page_id long, url string, html string").withColumn("digest", F.lit("x"))


def test_warc_round_trip(pages):
    index = warc.write_archives(pages)
    rows = warc.read_records(index).collect()
    want = collections.Counter()
    for r in pages.collect():
        raw = (r["html"] or "").encode()
        revisit = len(raw) >= 100 and r["html"].startswith("<p>") and r["page_id"] != 2
        want[(r["page_id"], r["url"], "revisit" if revisit else "response", 2 if revisit else None, len(raw), hashlib.sha256(raw).hexdigest(), None if revisit else raw)] += 1
    got = collections.Counter((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in rows)
    assert got == want
    one = warc.read_records(index.filter("page_id = 3"), payload=False).collect()
    assert len(one) == 1 and "payload" not in one[0].asDict()


def test_warc_empty(pages):
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_ranges():
    got = warc.coalesce_ranges([(0, 10), (10, 5), (100, 1), (300, 50)], gap=85, most=200)
    assert got == [(0, 101, [0, 1, 2]), (300, 50, [3])]
    assert warc.coalesce_ranges([(0, 150), (150, 100)], most=200) == [(0, 150, [0]), (150, 100, [1])]


def test_a_changed_payload_is_found():
    raw = warc.record(1, "u", b"abc", hashlib.sha256(b"abd").hexdigest(), None, False, "d", 1)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw)


# --- packing


def naive_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            r = min(fit)
            rooms.remove(r)
        else:
            r = capacity
        rooms.append(r - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([1, 2, 3, 7, rnd.randrange(1, 101), 100, 50, 51, 49]) for _ in range(rnd.randrange(1, 400))]
    counts = collections.Counter(lengths)
    slots = sorted(packing.plan(counts, 100))
    taken, used = collections.Counter(), collections.defaultdict(list)
    for n, c in counts.items():
        own = [s for s in slots if s[0] == n]
        for rank in range(c):
            _, first, per, seq, off = [s for s in own if s[1] <= rank][-1]
            k = rank - first
            used[seq + k // per].append((off + k % per * n, n))
            taken[n] += 1
    assert taken == counts
    for parts in used.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 100
    assert len(used) == naive_best_fit(lengths, 100)


def test_pack_tokens(docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(1, "Hello, world. it's <|endoftext|> <|ENDOFTEXT|>"), (2, None), (3, ""), (4, "x y " * 3000), (5, "İ Σας 1.2,, é \t日本"), (6, "q" * 5000), (7, "a.b.c. d,"), (7, "a.b.c. d,"), (None, " ")]
    out = packing.pack(docs(rows).repartition(3), path, 256).collect()
    want = collections.Counter()
    for d, x in rows:
        ids = tok.encode(x or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 256)):
            want[(d, p, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 256
    assert len(by) == naive_best_fit([r["length"] for r in out], 256)


def test_pack_edges(odd, empty):
    path = vocabulary("word_bpe_49k.json")
    assert packing.pack(empty, path).count() == 0
    assert packing.pack(odd, path).filter("piece = 0").count() == 10


# --- top-k


def test_top_k_brute(spark, monkeypatch):
    for name, n in (("LEAF", 4), ("QUERY_BLOCK", 4), ("DATA_BLOCK", 8), ("TOGETHER", 2)):
        monkeypatch.setattr(topk, name, n)
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.25, 0.26, rnd.random()]) for _ in range(6)], "x") for i in range(150)]
    rows += [(200 + i, rows[3][1], "x") for i in range(30)]
    rows += [(300, None, "x"), (301, [None] * 6, "x"), (302, [float("nan")] * 6, "x"), (303, [float("inf")] * 6, "x"), (None, rows[0][1], "x"), (304, [1.0, 2.0], "x"), (7, rows[7][1], "x"), (305, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")
    got = topk.top_k(df.filter("vec_id % 20 = 0 or vec_id = 304"), df, 5).collect()
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for i, v in ints:
        if i % 20 == 0 or i == 304:
            s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ints if j != i and len(w) == len(v))[:5]
            want |= {(i, k, j, -n) for k, (n, j) in enumerate(s, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_cells_are_pruned_by_covering_radii():
    rnd = np.random.default_rng(2)
    centres = np.round(rnd.normal(size=(40, 16)) * 200)
    data = [c + np.round(rnd.normal(size=(100, 16)) * 5) for c in centres]
    counts, radius = np.full(40, 100), np.array([np.sqrt(((x - c) ** 2).sum(1)).max() for x, c in zip(data, centres)])
    every, visited = np.concatenate(data), 0
    for c, x in enumerate(data):
        q = x[:10]
        first = topk.first_cells(q, centres, counts, 20)
        least = np.sort(q @ np.concatenate([data[i] for i in first]).T)[:, -20]
        rest = topk.other_cells(q, centres, radius, counts, least, 20)
        assert not set(first) & set(rest)
        seen = np.concatenate([data[i] for i in [*first, *rest]])
        assert (np.sort(q @ seen.T)[:, -20:] == np.sort(q @ every.T)[:, -20:]).all()
        visited += len(first) + len(rest)
    assert visited < 40 * 40 / 5


def test_cover_tree_covers_and_separates():
    x = np.random.default_rng(3).normal(size=(2000, 3))
    t = topk.CoverTree(x)
    assert sorted(np.concatenate([own for own, kids in zip(t.own, t.children) if not kids])) == list(range(2000))
    for node, kids in enumerate(t.children):
        if kids:
            c, cover = x[[t.centre[i] for i in kids]], max(t.radius[i] for i in kids)
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))[np.triu_indices(len(kids), 1)]
            assert apart.min() >= cover and cover <= t.radius[node] and sorted(np.concatenate([t.own[i] for i in kids])) == sorted(t.own[node])


def test_top_k_large_values_and_empty(spark):
    rows = [(0, [1e12, 3.0]), (1, [1e12, 1.0]), (2, [-1e12, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df.filter("vec_id = 0"), df, 2).collect()))
    assert [(r[1], r[2]) for r in got] == [(1, 1), (2, 2)] and got[0][3] == (1 << 63) - 1
    assert topk.top_k(df.limit(0), df).count() == topk.top_k(df, df.limit(0)).count() == 0


# --- sampled segmentations


@pytest.fixture(scope="module")
def v():
    return sampling.Vocabulary(vocabulary("piece_bpe_32k.model"), 1.0)


def all_paths(text, v):
    s = "▁" + text.replace(" ", "▁")
    paths = [[] for _ in range(len(s) + 1)]
    paths[0] = [((), 1.0)]
    for e in range(1, len(s) + 1):
        for b in range(e):
            piece = s[b:e]
            if piece in v.pieces:
                paths[e] += [((*p, v.pieces[piece]), w * v.weight[v.pieces[piece]]) for p, w in paths[b]]
    total = sum(w for _, w in paths[-1])
    return {p: w / total for p, w in paths[-1]}


@pytest.mark.parametrize("text", ["the", "to be", "in.to", "a, b"])
def test_all_segmentations_are_found_with_their_probabilities(v, text):
    want = all_paths(text, v)
    got = sampling.segment([text], [1], v, len(want) + 5)[0]
    assert {tuple(p[0].tolist()) for p in got} == set(want) and len(got) == len(want)
    for ids, log_p, inclusion in got:
        assert math.exp(log_p) == pytest.approx(want[tuple(ids.tolist())]) and inclusion == 1


def test_draws_follow_the_probabilities(v):
    n, want = 6000, all_paths("the", v)
    got = sampling.segment(["the"] * n, [i * 977 for i in range(n)], v, 2)
    first = collections.Counter(tuple(r[0][0].tolist()) for r in got)
    both = collections.Counter((tuple(r[0][0].tolist()), tuple(r[1][0].tolist())) for r in got)
    for p, w in want.items():
        assert abs(first[p] / n - w) < 4 * math.sqrt(w * (1 - w) / n) + 1e-3
    for (a, b), c in both.items():
        w = want[a] * want[b] / (1 - want[a])
        assert a != b and abs(c / n - w) < 4 * math.sqrt(w * (1 - w) / n) + 2e-3
    # inclusion scores make the sum over a sample an unbiased one
    assert np.mean([sum(math.exp(x[1]) / x[2] for x in r) for r in got]) == pytest.approx(1, abs=0.02)


def test_decoding_gives_texts_back(docs, odd):
    rows = [(1, "Hello  world\n x\t😀"), (2, "a▁b ▁"), (3, " lead and trail "), (4, None), (5, ""), (6, "x" * 5000), (7, "\x00\x7f ")]
    path = vocabulary("piece_bpe_32k.model")
    out = sampling.sample_segmentations(docs(rows), path, 3)
    assert out.filter("not decoded").count() == 0
    texts = {r["doc_id"]: r["text"] for r in sampling.decode(out, path).filter("sample = 1").collect()}
    assert texts == {d: x or "" for d, x in rows}
    keys = [(r["doc_id"], tuple(r["ids"])) for r in out.collect()]
    assert len(keys) == len(set(keys))
    again = sampling.sample_segmentations(docs(rows[::-1]).repartition(3), path, 3)
    assert sorted((r["doc_id"], r["sample"], r["ids_crc32"]) for r in again.collect() if r["doc_id"]) == sorted((r["doc_id"], r["sample"], r["ids_crc32"]) for r in out.collect() if r["doc_id"])
    assert sampling.sample_segmentations(odd, path, 2, with_ids=False).filter("sample = 1").count() == 10


def test_sampling_query_returns_the_ids(spark):
    at = "/root/testdata/sf0.001"
    out = QUERIES["op10_sentencepiece_sampling"](spark, at)
    rows = out.collect()
    assert rows and all(r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    want = collections.Counter((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect())
    texts = sampling.decode(out, vocabulary("piece_bpe_32k.model")).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in texts if r["sample"] == 1) == want
    assert all((r["doc_id"], r["text"]) in want for r in texts)


def test_words_share_lattices_from_batch_to_batch(v, monkeypatch):
    made = []
    make = sampling.Lattices._make
    monkeypatch.setattr(sampling.Lattices, "_make", lambda self, units, v: (made.extend(units), make(self, units, v))[1])
    batches = [["the cat, the  dog", None, "a▁b \x00"], ["the dog the cat", ""], ["x" * 300 + " cat"], ["the cat, the  dog", "dog dog"]]

    def run(room):
        monkeypatch.setattr(sampling, "_KEPT_PLACES", room)
        v.lattices.clear()
        made.clear()
        return [[[(p[0].tolist(), p[1], p[2]) for p in own] for own in sampling.segment(b, list(range(len(b))), v, 3)] for b in batches]

    want = run(1 << 20)
    assert len(made) == len(set(made)) and "▁cat" in made  # none is made again
    for room in (0, 12, 40, 330):  # what is kept has no influence
        assert run(room) == want
        assert v.lattices.rows <= room


def test_units_of_texts_as_slices_of_a_batch(v):
    rng = random.Random(4)
    one = re.compile("▁*[^▁\n\t.,]*[A-Za-zÀ-ÖØ-öø-ÿ](?=[.,])|▁*[^▁\n\t]+|▁+|[\n\t]")
    for _ in range(500):
        texts = [None if rng.random() < 0.15 else "".join(rng.choice(["aé", " ", "  ", "\n", "\t", ".", ",", "▁", "\x00", "😀"]) for _ in range(rng.randint(0, 9))) for _ in range(8)]
        start = rng.randint(0, 8)
        words, found, ends = sampling._words(pa.array(texts).slice(start).cast(pa.large_string()))
        flat, count = sampling._units(found)
        first, begin = np.cumsum(count) - count, 0
        for t, end in zip(texts[start:], ends.tolist()):
            got = [u for w in words[begin:end] for u in flat[first[w] : first[w] + count[w]]]
            assert got == (one.findall("▁" + t.replace("▁", "\udfff").replace(" ", "▁")) if t else [])
            begin = end


def test_sampling_empty(empty):
    path = vocabulary("piece_bpe_32k.model")
    assert sampling.decode(sampling.sample_segmentations(empty, path), path).count() == 0
    assert sampling.sample_segmentations(empty, vocabulary("piece_bpe_32k.model")).count() == 0
