"""The pipeline's stages against brute force on the smallest tables."""

from collections import Counter, defaultdict

import numpy as np


def test_stages(spark, sf_dir):
    import corpus_pipeline as cp

    from .test_operators import near_brute, words

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    clean = stages["toxicity"](spark, docs, sf_dir).cache()
    assert clean.columns == docs.columns and clean.count() <= docs.count()
    exact = stages["exact dedup"](spark, clean, sf_dir).cache()
    groups = defaultdict(list)
    for r in clean.collect():
        groups[b"".join(words(r.text))].append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in exact.collect()} == {min(g)[1] for g in groups.values()}
    near = stages["near dedup"](spark, exact, sf_dir).cache()
    want = near_brute([(r.doc_id, r.text) for r in exact.collect()], 5)
    assert {r.doc_id for r in near.collect()} == {d for d, (_, c) in want.items() if d == c}
    mixed = stages["mixing"](spark, near, sf_dir).cache()
    assert mixed.columns == docs.columns
    pieces = stages["packing"](spark, mixed, sf_dir).collect()
    assert sum(p.length for p in pieces if p.start == 0 or True) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(r.doc_id for r in mixed.collect())
    assert all(np.frombuffer(p.ids, "<u4").size == p.length for p in pieces)


def test_run(spark, sf_dir):
    import corpus_pipeline as cp

    assert cp.run(spark, sf_dir).count() > 0
