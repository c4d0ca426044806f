"""Token counts against the library, and clusters against loops in whole numbers and SQL."""

import hashlib
import json
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparrowgrid.llm import centroids, tokencount

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source():
    with open(tokencount.vocabulary_path(), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(source):
    return Tokenizer.from_str(source)


def test_every_document_as_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in tokencount.token_counts(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        n = len(library.encode(d.text or "", add_special_tokens=False))
        assert got[d.doc_id].asDict() == {"doc_id": d.doc_id, "n_bytes": len((d.text or "").encode()), "n_tokens": n, "over_limit": n > 512}


PARTS = st.lists(st.sampled_from(["a", "B", ".", ", ", "?", "×", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "1", "!", "'s", "'ll", "'", "<|endoftext|>", "<|end", "　", "日本", "-", "\r\n", "🙂"]), max_size=25).map("".join)


@pytest.fixture(scope="module")
def counters(source):
    return [tokencount.Counter(source, part_bytes=part, batch_bytes=64, most=8) for part in (5, 1 << 20)]


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(PARTS, st.text(st.characters(exclude_categories=["Cs"]), max_size=40)))
def test_cuts_change_no_count(counters, library, text):
    want = len(library.encode(text, add_special_tokens=False))
    for counter in counters:
        assert counter.counts([text, text]) == [want, want]


def test_a_file_without_safe_boundaries_is_encoded_whole(source, library):
    spec = json.loads(source)
    assert tokencount.splits(spec)
    for change in ({"lstrip": True}, {"content": "a b"}, {"content": "a.b"}):
        assert not tokencount.splits(spec | {"added_tokens": [spec["added_tokens"][0] | change]})
    other = json.dumps(spec | {"normalizer": {"type": "Lowercase"}})
    texts = ["Some WORDS here", "", "more. words", "x " * 3000]
    assert tokencount.Counter(other, part_bytes=4).counts(texts) == [len(e) for e in Tokenizer.from_str(other).encode_batch(texts, add_special_tokens=False)]


def test_odd_rows_have_counts(spark, library):
    texts = [None, "", "   ", "<|endoftext|>", "a<|endoftext|> b", "x" * 70_000, "word and, word. " * 90_000, "\x00\x01", "日本語 text", "again", "again"]
    rows = [(None if i == 3 else i, t, 1, 1, True, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, n_tokens int, over_limit boolean, ids string")
    got = sorted(tuple(r) for r in tokencount.count_tokens(docs, tokencount.vocabulary_path()).fillna(-1).collect())
    size = [(len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for t in texts]
    assert got == sorted((-1 if i == 3 else i, b, n, n > 512) for i, (b, n) in enumerate(size))
    assert tokencount.count_tokens(docs.limit(0), tokencount.vocabulary_path()).count() == 0


# clusters


def by_loop(rows, k=8, rounds=10, seed=3, dim=64):
    """Whole numbers, one vector at a time."""
    kept = [(i, [int(np.floor(1024.0 * float(v))) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and np.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centers)):
            members = [x for (_, x), o in zip(kept, own) if o == j]
            if members:
                centers[j] = [sum(v) // len(members) for v in zip(*members)]
    found = [(i, *nearest(x)) for i, x in kept]
    top = 2**63 - 1
    inertia = [sum(d for _, d, c in found if c == j) for j in range(len(centers))]
    return [(i, c, min(d, top), min(inertia[c], top), min(sum(inertia), top), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, d, c in found]


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_clusters_match_sql_and_the_loop(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = plain(centroids.centroid_clusters(spark, SF))
    assert got == sorted(con.execute(centroids.ORACLE).fetchall(), key=repr)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got == sorted(by_loop(rows), key=repr)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e30])
def test_clusters_of_odd_rows_and_large_numbers(spark, scale):
    """At 1e5 sums of products pass 2^53, at 1e30 every distance passes a long."""
    rng = random.Random(5)
    rows = [(i, [scale * rng.uniform(-3, 3) for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1])] * 3 + [(None, [scale] * 4), (100, None), (101, [1.0] * 3), (102, [1.0, None, 1.0, 1.0]), (103, [1.0, float("nan"), 1.0, 1.0]), (104, [1.0, float("inf"), 0.0, 0.0]), (105, []), (3, [scale * 2] * 4)]
    vectors = spark.createDataFrame([(i, x, 1, "clash") for i, x in rows], "vec_id long, embedding array<double>, cluster int, x string").repartition(3)
    assert plain(centroids.cluster(vectors, k=5, dim=4, block=16)) == sorted(by_loop(rows, k=5, dim=4), key=repr)
    assert centroids.cluster(vectors.limit(0)).count() == 0
    assert plain(centroids.cluster(vectors.where("vec_id < 3"), k=5, dim=4)) == sorted(by_loop(rows[:3], k=5, dim=4), key=repr)


def test_ties_go_to_the_smaller_number_and_empty_centers_stay(spark):
    vectors = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(12)], "vec_id long, embedding array<double>")
    got = centroids.cluster(vectors, k=3, dim=2).collect()
    assert len(got) == 12 and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}


def test_products_of_a_block_are_whole_numbers_or_measured_apart():
    rng = np.random.default_rng(2)
    x = np.floor(rng.uniform(-1e4, 1e4, (50, 6)))
    centers = [[int(v) for v in row] for row in np.floor(rng.uniform(-1e4, 1e4, (4, 6)))]
    at, far = centroids.nearest(x, centers)
    shifted = centroids.nearest(x + 2.0**40, [[v + 2**40 for v in c] for c in centers])
    assert at.tolist() == shifted[0].tolist() and far.tolist() == shifted[1].tolist() and shifted[1].dtype == object
    assert centroids.summed(x, at, far, 4)[0].tolist() == [[int(v) for v in x[at == j].sum(axis=0)] if (at == j).any() else [0] * 6 for j in range(4)]
    assert pa.array(far, pa.int64()).to_pylist() == far.tolist()
