"""Spelling variants against all pairs and plain loops."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparrowgrid.llm import spelling

SF = "/root/testdata/sf0.001"
LOW = {c: c + 32 for c in range(65, 91)}


def one_apart(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def by_loops(rows):
    """word -> (form, root, n, n_near, form_n); near words are found by their letters with one left out, then compared."""
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    n = {w: c for w, c in total.items() if len(w) >= 6 and c >= 5}
    close = {}
    for w in n:
        for k in range(len(w)):
            close.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
            close.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    near = {w: set() for w in n}
    for key, members in close.items():
        for a in members | ({key} & n.keys() if isinstance(key, str) else set()):
            near[a] |= {b for b in members | ({key} & n.keys() if isinstance(key, str) else set()) if one_apart(a, b)}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def table(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r.word: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("letters", ["ab", "aé", "abcdefgh"])
def test_tries_meet_what_all_pairs_meet(letters):
    rng = random.Random(letters)
    for _ in range(60):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 80))})
        trie = spelling.Trie.unpacked(spelling.Trie(words, list(range(len(words)))).packed())
        for w in words + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))]:
            assert sorted(words[k] for k in trie.near(w)) == [x for x in words if one_apart(w, x)]


def test_long_chains_take_one_node():
    words = sorted(["x" * 50_000, "x" * 50_001, "x" * 49_999 + "y", "z" * 6])
    trie = spelling.Trie(words, [1] * 4)
    assert len(trie.first) < 12
    assert {words[k][-1] + str(len(words[k])) for k in trie.near("x" * 50_000)} == {"x50001", "y50000"}


def test_parts_cut_no_run():
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice(["a", "B", "é", "Ã", "×", " ", "日", "1", "🙂", "ā", "-"]) for _ in range(rng.randint(0, 30)))
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        for most in (1, 5, 1000):
            got = [w.decode() for p in spelling.parts(raw, most) for w in spelling.runs(p).tobytes().split()]
            assert got == [w.translate(LOW) for w in re.findall("[A-Za-z\u00C0-\u00FF]+", text)]


def test_query_matches_loops_on_whole_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = table(spelling.spelling_variants(spark, SF))
    assert got == by_loops(rows) and len(got) > 100


@pytest.mark.parametrize("settings", [{}, {"shard_words": 3, "group_bytes": 1, "held": 2, "part_bytes": 7}, {"shard_bytes": 10, "group_bytes": 4000}])
def test_odd_rows_chains_and_ties(spark, settings):
    said = {"wonderful": 700, "wonderfull": 130, "wonderfulls": 25, "wonderfullls": 5, "separate": 40, "seperate": 8, "separete": 9, "colour": 30, "color": 90, "colours": 30, "coloure": 30, "naïvety": 50, "naivety": 10, "ÀÉÎõüß": 6, "ÀÉÎõüÿ": 6, "×÷×÷×÷": 7, "x" * 9_000: 5, "x" * 9_001: 26, "fivefive": 4, "LOWERED": 6, "lowered": 6}
    texts = [" ".join([w] * k) for w, k in said.items() for k in [said[w]]] + [None, "", "123 !?", "日本語のtext", "short short2 words", "repeated repeated repeated", "repeated repeated repeated", "mixed-up,under_scored;MIXED.mixeD5mixed mixed"]
    rows = [(i if i % 4 else None, t, 1, "clash", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, word string, form string").repartition(5)
    got = table(spelling.variants(docs, spelling.Settings(**settings)))
    assert got == by_loops([r[:2] for r in rows])
    assert got["wonderfulls"][1] == "wonderful" and got["colours"][:2] == (None, "colours") and "repeated" in got
    assert spelling.variants(docs.limit(0), spelling.Settings(**settings)).count() == 0
    assert spelling.variants(docs.where("text is null or length(text) < 9")).count() == 0
