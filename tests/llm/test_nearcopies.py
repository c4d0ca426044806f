"""The pipeline's near copies against a brute-force Jaccard similarity."""

import random

import corpus_pipeline
from sparrowgrid.llm import nearcopies

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(least.values())


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_edited_copies_are_dropped_as_by_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for n in (30, 60, 120, 300, 900):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts += [" ".join(base), " ".join(base).upper()] + [edited(rng, base, k) for k in (1, 1, 2, 3, n // 60, n // 40, n // 20)]
    texts += ["a b c", "A  b c", "a b d", "one two three four five", "one two three four six"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_kept(rows)
    got = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert len(want) < len(rows) and sorted(r.doc_id for r in got.collect()) == want


def test_members_not_like_the_head_meet_the_others(spark):
    """Chains of edits in one bucket: its ends are not similar, its neighbours are."""
    rng = random.Random(4)
    words, rows = [f"w{i}" for i in range(100)], []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[(37 * i) % 100] = f"x{rng.randrange(10**6)}"
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in nearcopies.keep_first(docs).collect()) == brute_kept(rows) == [0]


def test_sets_are_the_same_by_either_join(spark):
    docs = spark.createDataFrame([(i, f"some text of words number {i % 7} " + "and more " * (i % 3)) for i in range(60)], SCHEMA)
    marked = nearcopies.marks(docs).select("fp").distinct()
    sent, met = (sorted(map(tuple, nearcopies.shingle_sets(docs, marked, most).collect())) for most in (1000, 1))
    assert sent == met and len(sent) == 21
