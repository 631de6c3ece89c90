"""The pipeline against the same stages one after another in plain Python."""

import collections
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import quality
from helixframe.llm.queries import vocabulary
from tests_llm_brute import components_of, cut_repeats_of


def test_stages_take_odd_rows_and_empty_tables(spark, docs, odd, empty, data):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    more = docs([(d, x, "en") for d, x in ((20, good), (21, good), (22, good), (22, good), (None, good + " end"), (23, " ".join(good.split()[::-1])))])
    for df, last in ((odd.unionByName(more), {20, None, 23}), (odd, set()), (empty, set())):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, data).cache()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns and out.dtypes == df.dtypes
                assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in df.select("doc_id").collect()}
            else:
                assert {r["doc_id"] for r in out.collect()} == last
            df = out


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    df, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, data).cache()
        seen.append((name, df))
    assert [n for n, _ in seen] == ["language_id", "quality_rules", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    for _, d in seen[:-1]:
        assert d.columns == docs.columns
    kept = [r.asDict() for r in seen[0][1].collect()]
    assert {r["doc_id"] for r in kept} == {d for d, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}
    b = quality.Batch(pa.array([r["text"] for r in kept], pa.large_string()))
    bad = np.any([r.rejects(b) for r in quality.BASE + quality.RULES], axis=0)
    kept = [r for r, x in zip(kept, bad) if not x]
    assert {r["doc_id"] for r in seen[1][1].collect()} == {r["doc_id"] for r in kept}
    least = components_of([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r in kept if least[r["doc_id"]] == r["doc_id"]]
    assert {r["doc_id"] for r in seen[2][1].collect()} == {r["doc_id"] for r in kept}
    texts = cut_repeats_of([(r["doc_id"], r["text"]) for r in kept], 20)
    assert {r["doc_id"]: r["text"] for r in seen[3][1].collect()} == texts
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = collections.Counter()
    for d, x in texts.items():
        ids = tok.encode(x, add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            want[(d, p, zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in seen[4][1].collect()) == want
    whole = corpus_pipeline.run(spark, data)
    assert collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole.collect()) == want
    assert whole.agg(F.countDistinct("sequence_id")).first()[0] > 0
