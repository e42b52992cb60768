"""Merkle manifest, ranked search and n-gram join against brute force, their SQL, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from .test_operators import BASE, ODD, SCHEMA, frame, lower

TABLES = ("documents", "benchmark", "pages", "labels")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same_as_sql(spark, duck, sf_dir, name):
    from feldspar.llm import queries

    got, want = queries.QUERIES[name](spark, sf_dir), duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle_brute(rows):
    """Whole trees in memory; rows are (doc_id, source, lang, n_chars, text)."""

    def digest(values):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    by = defaultdict(list)
    for r in rows:
        tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 and r[4] is not None
        by[r[1]].append((r[0], digest(r), digest((*r[:4], r[4].replace("\n", ""))) if tampered else digest(r)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in by[s]])
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (doc, leaf, other) in enumerate(by[s]):
            proof, folded = [], other
            for tree, at in ((trees[s], i), (top, k)):
                for level in tree[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    proof += [x for j, x in enumerate(run) if j != at % 3]
                    folded = H(*[folded if j == at % 3 else x for j, x in enumerate(run)])
                    at //= 3
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], H(*proof), folded, folded == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("height", [1, 6])
def test_merkle_manifest(spark, docs, height):
    from feldspar.llm.merkle import merkle_manifest

    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = Counter(tuple(r) for r in merkle_manifest(docs.repartition(5), height=height).collect())
    assert got == merkle_brute(rows) and {v for *_, v in got} == {True, False}


def test_merkle_cases(spark):
    from feldspar.llm.merkle import merkle_manifest

    odd = [(i, None if i % 7 == 0 else ["a", "é", "", "z\n", "n"][i % 5], None if i % 3 else "en", None if i % 4 == 0 else i, t) for i, t in enumerate(ODD)]
    odd += [(None, "a", "en", 1, "x\ny"), (None, "a", "en", 1, "x\ny"), (3, "a", None, 2, "l\n"), (3, "a", None, 2, "l\n"), *[(i, "hot", "en", i, f"line\n{i}") for i in range(100)]]
    table = spark.createDataFrame(odd, "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumn("key", F.lit(1)).withColumn("digest", F.lit("x"))
    for height in (1, 2, 6):
        assert Counter(tuple(r) for r in merkle_manifest(table, height=height).collect()) == merkle_brute(odd)
    one = table.limit(1)
    assert Counter(tuple(r) for r in merkle_manifest(one).collect()) == merkle_brute([tuple(r)[:5] for r in one.collect()])
    assert merkle_manifest(table.limit(0)).count() == 0


def test_merkle_sql(spark, duck, sf_dir):
    same_as_sql(spark, duck, sf_dir, "op13_merkle_manifest")


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def search_brute(docs, items, k=50):
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    total, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms_of(t))
    out = Counter()
    for item, terms in asked.items():
        scores = []
        for d, b in bags:
            n = sum(b.values())
            m = 50 + (50 * n * total) // length if length else 0
            scores.append((-sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in terms if b[t]), d is not None, d or 0))
        for rank, (minus, known, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1):
            out[item, rank, d if known else None, -minus] += 1
    return out


@pytest.mark.parametrize(("k", "pairs", "postings"), [(50, 1 << 20, 1 << 20), (3, 200, 500), (1, 1 << 20, 2000)])
def test_ranked_search(spark, docs, sf_dir, k, pairs, postings):
    from feldspar.llm.ranked_search import ranked_search

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(12)
    want = search_brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k)
    got = ranked_search(docs.repartition(3), items, k, pairs, postings)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_search_cases(spark):
    from feldspar.llm.ranked_search import ranked_search

    table = [*enumerate(ODD), (None, "a b c"), (None, "zz zz"), (5, BASE), *[(100 + i, "tie w1 " + "pad " * (i % 3)) for i in range(70)]]
    items = [(1, "a B,c!"), (2, None), (3, ""), (4, "...?"), (None, "w1 w2 W1 日本"), (6, "tie"), (6, "w3"), (7, "unseen words"), (2**60 + 1, "naïve CAFÉ")]
    docs = frame(spark, [t for _, t in table], [i for i, _ in table]).withColumn("term", F.lit(1)).withColumn("score", F.lit(2))
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit(0))
    for k in (50, 2):
        assert Counter(tuple(r) for r in ranked_search(docs, asked, k, postings=100).collect()) == search_brute(table, items, k)
    assert ranked_search(docs.limit(0), asked).count() == ranked_search(docs, asked.limit(0)).count() == ranked_search(docs.where("doc_id = 2"), asked).count() == 0


def test_accumulators_are_limited():
    """Once the remaining terms can't reach the kth partial score, documents without an accumulator get none."""
    import numpy as np

    from feldspar.llm.ranked_search import Block

    n = np.full(1000, 10)
    terms, tf, doc = np.r_[np.zeros(60, int), np.ones(1000, int)], np.ones(1060, int), np.r_[np.arange(60), np.arange(1000)]
    block = Block(list(range(1000)), n, terms, tf, doc, (1000, 10_000), 2)
    made = []
    plain = block.kth
    block.kth = lambda score, live, k: made.append(int(live.sum())) or plain(score, live, k)
    found, score = block.best(np.array([0, 1]), np.array([5000, 10]), 50, 0)
    assert found.tolist() == list(range(50)) and made == [60] and set(score.tolist()) == {5010 * int(block.part[0])}


def test_search_sql(spark, duck, sf_dir):
    same_as_sql(spark, duck, sf_dir, "op11_ranked_search")


def edited(seed, n, families, size):
    """Families of texts with a few words changed, around every similarity near the threshold."""
    import random

    r = random.Random(seed)
    out = []
    for f in range(families):
        own = [f"f{f}w{i}" for i in range(r.randint(4, n))]
        for _ in range(size):
            copy = list(own)
            for _ in range(r.randint(0, max(1, len(own) // 30))):
                at = r.randrange(len(copy))
                copy[at : at + r.randint(0, 1)] = [f"x{r.random()}"]
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("percent", "block_rows"), [(85, 384), (85, 4), (60, 384), (97, 384)])
def test_ngram_join(spark, docs, percent, block_rows):
    from feldspar.llm.ngram_join import ngram_join

    from .test_operators import near_brute

    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate([*ODD, *edited(percent, 400, 12, 9)])]
    table = frame(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("k", F.lit(1)).withColumn("rep", F.lit(2))
    want = near_brute(rows, 4, percent)
    got = ngram_join(table, 4, percent, block_rows=block_rows).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert ngram_join(frame(spark, [])).count() == 0
    twice = ngram_join(frame(spark, ["a b c d e", "a b c d e", "q", None], [3, 3, None, None])).collect()
    assert Counter((r.doc_id, r.component_id) for r in twice) == Counter([(3, 3), (3, 3), (None, None), (None, None)])


def test_parity_bounds():
    """Distances never exceed the symmetric difference, and any linked pair shares a key."""
    import numpy as np

    from feldspar.llm import ngram_join as nj

    r = np.random.default_rng(5)
    for trial in range(400):
        n, percent = int(r.integers(1, 600)), int(r.choice([60, 85, 90, 97]))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        gone, new = (int(r.integers(0, max(2, n * (100 - percent) // 90))) for _ in range(2))
        b = np.unique(np.concatenate((a[gone:], r.integers(0, 2**63, new, dtype=np.int64).astype(np.uint64))))
        if not len(b):
            continue
        both, different = len(np.intersect1d(a, b)), len(np.setxor1d(a, b))
        x, y = nj.folded_sketch(a, percent), nj.folded_sketch(b, percent)
        w = min(len(x), len(y))
        assert np.bitwise_count(nj.narrow(x, w) ^ nj.narrow(y, w)).sum() <= different
        if different and 100 * both >= percent * len(np.union1d(a, b)):
            assert different <= nj.differing(len(a) + len(b), percent)
            assert len(np.intersect1d(nj.join_keys(a, percent), nj.join_keys(b, percent)))


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_minhash_near_dedup", "op12_ngram_join"])
def test_other_sql(spark, duck, sf_dir, name):
    same_as_sql(spark, duck, sf_dir, name)
