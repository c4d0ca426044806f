"""Toxicity, language, fingerprints, leaks, tokens, shards: edge cases, and brute force where there is one."""

import collections
import dataclasses
import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sparrowgrid.llm import bpe, decontam, kdshard, langid, simhash, textops, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, node int, component_id string, __id int, bin int, row string"
ODD = [None, "", "   ", "\n\t", "a", "!!! 123", "ÀÉ ñ", "x" * 30_000, "word " * 6_000, "\x00\x01", "日本語 text"]


def rows(texts, first=0):
    return [(first + i, t, "en", "s", 1, 7, 7, "clash", 7, 7, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    data = rows(ODD) + rows(["same text here now"] * 3, 100) + [(None, "null id text", None, None, None, None, None, None, None, None, None)] + rows(["repeated row of words"]) * 2
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def english(rng, n):
    return " ".join(rng.choice("the of and to in is that for with on are this be from by an".split()) + rng.choice(["", "er", "ing", "ed"]) for _ in range(n))


# toxicity


@pytest.fixture(scope="module")
def toxic_model():
    rng = random.Random(1)
    texts, y = [], []
    for i in range(400):
        words = english(rng, rng.randint(5, 80)).split()
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "idiots", "stupid", "moron"])
        texts.append(" ".join(words))
        y.append(int(bad))
    return toxicity.train(texts, np.array(y), toxicity.Settings(buckets=1 << 14, epochs=12))


@pytest.mark.parametrize("bias", [-3.0, 0.0, 3.0])
@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_texts_without_words_are_not_toxic(spark, toxic_model, bias, share):
    """Whatever the sign of the softmax's bias, and in the pipeline's stage too."""
    model = toxicity.Model(toxic_model.scalars, bias, toxic_model.settings, share)
    empty = spark.createDataFrame(rows([None, "", "   ", "?!", "\n\t", "--- ..."]), SCHEMA)
    got = toxicity.score_documents(empty, model).collect()
    assert {r.predicted for r in got} == {0} and {r.score for r in got} == {min(share, toxicity.WORDLESS)}
    assert toxicity.keep_clean(empty, model).count() == 6


def test_toxicity_finds_insults_misspellings_and_long_texts(toxic_model):
    rng = random.Random(2)
    clean = [english(rng, 60) for _ in range(40)]
    bad = [c + " idiot" for c in clean] + [english(rng, 3000) + " stupid " + english(rng, 3000), "an idioot and", "moronn is that"]
    assert (toxicity.scores(pa.array(bad), toxic_model) >= 0.5).mean() > 0.95
    assert (toxicity.scores(pa.array(clean), toxic_model) < 0.5).mean() > 0.95


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7])
def test_toxicity_score_is_that_of_the_best_window(toxic_model, size):
    """Against a plain loop over words, members and windows of any size, each half a window on."""
    toxic_model = toxicity.Model(toxic_model.scalars, toxic_model.bias, dataclasses.replace(toxic_model.settings, window=size))
    text = "The moron IS in, the of and-to Éa"
    padded, starts = textops.padded(*textops.buffers(pa.array([text])), 0, 1)
    begins, ends = textops.word_spans(padded)
    member = collections.defaultdict(list)
    for w, b in toxicity._members(padded, begins, ends, toxic_model.settings.buckets):
        for i, k in zip(w, b):
            member[int(i)].append(float(toxic_model.scalars[k]))
    value = [np.mean(member[i]) for i in range(len(begins))]
    step = max(1, size // 2)
    begin = [0]
    while begin[-1] + size < len(value):
        begin.append(begin[-1] + step)
    windows = [value[k : k + size] for k in begin]
    want = max(np.mean(w) for w in windows) + toxic_model.bias
    assert toxicity.scores(pa.array([text]), toxic_model)[0] == pytest.approx(1 / (1 + np.exp(-want)), rel=1e-5)


def test_toxicity_edges(spark, odd, none, toxic_model):
    got = toxicity.score_documents(odd, toxic_model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got if r.doc_id is not None}
    assert toxicity.score_documents(none, toxic_model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = toxicity.fit(odd, labels)
    assert toxicity.keep_clean(odd, empty).collect() == odd.collect()
    one = spark.createDataFrame([(1, 1, 1), (None, 0, 1), (2, 1, None), (3, None, 1)], labels.schema)
    assert toxicity.fit(odd, one).bias > 0


def test_word_hash_does_not_depend_on_the_text_around():
    reference = None
    for text in ("moron", "a moron", "xx moron yy", "é" * 9 + " moron"):
        padded, _ = textops.padded(*textops.buffers(pa.array([text])), 0, 1)
        begins, ends = textops.word_spans(padded)
        words = [bytes(padded[a:b]) for a, b in zip(begins, ends)]
        h = dict(zip(words, textops.word_hashes(padded, begins, ends).tolist()))
        reference = reference or h[b"moron"]
        assert h[b"moron"] == reference


# language


@pytest.fixture(scope="module")
def language_model():
    rng = random.Random(3)
    vocab = {"en": "the of and to in is that", "de": "der die und ist nicht ein für", "fr": "le la les est une dans qué", "es": "el los una es ño para está"}
    texts = [(" ".join(rng.choice(v.split()) for _ in range(rng.randint(3, 60))), k) for k, v in vocab.items() for _ in range(60)]
    return langid.train([t for t, _ in texts], [k for _, k in texts]), vocab


def test_languages_are_told_apart(language_model):
    model, vocab = language_model
    rng = random.Random(4)
    texts = [(" ".join(rng.choice(v.split()) for _ in range(20)), k) for k, v in vocab.items() for _ in range(25)]
    names, score, unsure = langid.predict(pa.array([t for t, _ in texts]), model)
    assert np.mean([n == k for n, (_, k) in zip(names, texts)]) > 0.97 and ((score >= 0) & (score <= 1)).all()


def test_decoding_matches_a_plain_loop(language_model):
    model, vocab = language_model
    rng = random.Random(14)
    texts = [" ".join(rng.choice(v.split()) for _ in range(rng.randint(1, 30))) for v in vocab.values() for _ in range(10)] + ["zz qq", "x"]
    names, score, unsure = langid.predict(pa.array(texts), model)
    s = model.settings
    for text, name, p, u in zip(texts, names, score, unsure):
        raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)
        margin = model.bias.copy()
        for grams, _ in langid._buckets(raw, s):
            for g in grams[: len(raw) - 1].tolist():
                margin += model.weights[g] / (len(s.sizes) * (len(raw) - 1))
        loss = [sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margin, word)) / model.trust.sum() for word in model.code]
        rating = [math.exp(-4 * (x - min(loss))) for x in loss]
        rating = sorted((r / sum(rating) for r in rating), reverse=True)
        assert name == model.languages[loss.index(min(loss))] and p == pytest.approx(rating[0], abs=1e-3) and (u == (rating[0] - rating[1] < s.margin) or abs(rating[0] - rating[1] - s.margin) < 1e-3)


def test_the_decoder_rejects_what_is_no_language(language_model):
    model, vocab = language_model
    rng = random.Random(15)
    good = [" ".join(rng.choice(v.split()) for _ in range(40)) for v in vocab.values() for _ in range(10)]
    assert langid.identified(pa.array(good), model).all()
    assert not langid.identified(pa.array(["12 34", ""]), model).any()
    word = model.code[0] * np.array([-1.0, *[1.0] * (model.code.shape[1] - 1)])
    far = langid.Model(model.languages, np.stack([model.code[0], word]), np.zeros_like(model.weights), np.where(model.code[0] == word, -9.0, 9.0) * model.code[0], model.trust, model.settings)
    assert not langid.identified(pa.array(["good text"]), far).any()


@pytest.mark.parametrize("n", [2, 3, 4, 7, 9, 20])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and len({tuple(c) for c in code}) == n
    assert (np.abs(code.sum(axis=0)) < n).all()
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= (1 if n == 2 else code.shape[1] * 0.25)


def test_language_edges(spark, odd, none, language_model):
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd, language_model[0]).collect()}
    und = {d for d, lang, _ in got if lang == "und"}
    assert und == {0, 1, 2, 3, 5, 9} == {i for i, t in enumerate(ODD) if not re.search(r"[^\W\d_]", t or "")}
    kept = langid.keep_identified(odd, language_model[0])
    assert kept.columns == odd.columns and kept.count() == sum(bool(re.search(r"[^\W\d_]", r.text or "")) for r in odd.collect())
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(odd.where("lang is null"))).collect()} == {"und"}
    assert langid.fit(odd).languages == ["en"]


# fingerprints


def brute_fingerprint(s):
    s = (s or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(q.encode(), 42) for q in sh]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_classes(fps):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_match_brute_force():
    texts = ODD + ["a b\tc\x1cd E\x85f", "One two THREE four " * 400]
    assert simhash.fingerprints(pa.array(texts).fill_null("")).tolist() == [brute_fingerprint(t) for t in texts]


def around(rng, n, spread):
    """Fingerprints in a ball, so that buckets are crowded."""
    centre = rng.getrandbits(64)
    return [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, spread))) for _ in range(n)]


@pytest.mark.parametrize("hot", [8192, 3])
def test_links_and_components_match_brute_force(spark, hot):
    rng = random.Random(5)
    fps = sorted({*around(rng, 120, 5), *around(rng, 40, 2), *(rng.getrandbits(64) for _ in range(200)), 0, 1, 2**64 - 1})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    marked = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(marked, hot).collect()}
    root = brute_classes(fps)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(i, least.get(r, i))
    assert got == {f: least[r] for f, r in zip(signed, root)}


def test_simhash_edges(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and all(len(r.fingerprint) == 16 for r in got)
    zero = {r.component_id for r in got if r.fingerprint == "0" * 16}
    assert len(zero) == 1
    assert {r.component_id for r in got if r.doc_id in (100, 101, 102)} == {100}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[100] == 1 and 101 not in ids and ids[0] == 1 and ids[None] == 1
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_keep_first_keeps_one_of_each_class(spark):
    rng = random.Random(6)
    base = [english(rng, 60) + f" tail{i}" for i in range(12)]
    data = rows([b for b in base for _ in range(3)])
    rng.shuffle(data)
    kept = simhash.keep_first(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(c for c in {r.component_id for r in simhash.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()})


# leaks


def benchmark(spark, n=12, seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 200 if i == 3 else 40))) + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(n)]
    return items, spark.createDataFrame([*items, items[0], (99, None), (98, ""), (None, "null id item text")], "item_id long, text string")


@pytest.mark.parametrize("shard_bytes", [2 << 20, 600])
def test_leaks_are_found_wherever_they_stand(spark, shard_bytes):
    items, table = benchmark(spark)
    rng = random.Random(8)
    docs, want = [], set()
    for i, (item, text) in enumerate(items):
        docs.append((i, english(rng, rng.choice([0, 3, 63, 64, 65, 500])) + " " + text.upper().replace(".", " !") + " " + english(rng, 100)))
        want.add((i, item))
        docs.append((100 + i, english(rng, 200) + " " + text[: len(text) // 3]))
        docs.append((200 + i, english(rng, 300)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    settings = decontam.Settings(shard_bytes=shard_bytes)
    got = decontam.find_leaks(frame, table, settings).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {r.doc_id for r in decontam.drop_leaks(frame, table, settings).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_wand_finds_what_scoring_all_items_finds(spark):
    items, _ = benchmark(spark, 60, 9)
    hashed = [decontam.hashed_words(t) for _, t in items]
    df = collections.Counter(x for h in hashed for x in set(h.tolist()))
    for ix in decontam.build(items, df, len(items), np.mean([len(h) for h in hashed]), decontam.Settings(threshold=0.3)):
        rng = random.Random(10)
        vocab = [w for h in hashed for w in h.tolist()]
        for _ in range(60):
            part = hashed[rng.randrange(len(hashed))]
            own = np.array(part[: rng.randint(1, len(part))].tolist() + [rng.choice(vocab) for _ in range(20)], dtype=np.uint64)
            terms = np.unique(ix.lookup(own))
            terms = terms[terms >= 0]
            sums = collections.Counter()
            for t in terms.tolist():
                for e in range(ix.start[t], ix.start[t + 1]):
                    sums[int(ix.item[e])] += float(ix.impact[e])
            want = {i for i, s in sums.items() if s >= 0.3 - 1e-9}
            assert {i for i, _ in decontam.wand(terms, ix, set(range(len(ix.items))))} == want


def test_common_subsequence():
    assert decontam.common([1, 2, 3, 4], [9, 1, 3, 9, 4]) == 3
    assert decontam.common([1, 1, 1], [1, 2, 1]) == 2 and decontam.common([1], []) == 0


def test_items_without_id_and_without_blanks(spark):
    items = [(None, "an item that has no id of its own at all, but words. And an answer too."), (5, "これは試験の問題の文章です。答えはここにあります。")]
    docs = [(1, "before " * 80 + items[0][1] + " after"), (2, "長い文の中に" + items[1][1] + "とあった"), (3, "別の文章である")]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, None), (2, 5)}


def test_words_end_at_punctuation_of_any_kind():
    for text, words in (("a\u2014b c\u00a0d", ["a", "b", "c", "d"]), ("ab 日本x é", ["ab", "日", "本", "x", "é"]), ("日", ["日"]), ("", [])):
        raw, _ = textops.padded(*textops.buffers(pa.array([text])), 0, 1)
        assert [bytes(raw[a:b]).decode() for a, b in zip(*textops.token_spans(raw))] == words


def test_one_scan_serves_several_shards(spark):
    _, table = benchmark(spark)
    assert len(list(decontam.shards(table, decontam.Settings(shard_bytes=600)))) > 3
    assert len(list(decontam.scans(table, decontam.Settings(shard_bytes=600)))) == 1
    assert len(list(decontam.scans(table, decontam.Settings(shard_bytes=600, scan_bytes=1200)))) > 1


def test_leak_edges(spark, odd, none):
    _, table = benchmark(spark)
    assert decontam.find_leaks(odd, table).count() == 0
    assert decontam.drop_leaks(odd, table).collect() == odd.collect()
    assert decontam.find_leaks(none, table).count() == 0
    assert decontam.find_leaks(odd, table.limit(0)).count() == 0 and decontam.drop_leaks(odd, table.where("text is null")).count() == odd.count()


# tokens


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(bpe.vocabulary_path())


def test_tokens_match_the_library(spark, odd, vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    rng = random.Random(11)
    chars = "abcdeéΣσ ñß\n\t\x1c\x85 <|>endofttx's.,!12½é́mmm"
    texts = [x or "" for x in ODD] + ["Σας ΣΑΣ", "İstanbul ẞ", "don't WE'LL", "<|endoftext|>a<|startoftext|> <|ENDoftext|>", "aaaaaaa aaaa mmmmmmmm", "😀😀👍🏽", "à́ b̧"]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text, (n, ids, decoded) in zip(texts, bpe.Encoder(vocabulary, cache=50).encode(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))) and decoded == t.decode(want, skip_special_tokens=False) == bpe.decode(want, vocabulary)
    got = {r.doc_id: r for r in bpe.encode_documents(odd.where("doc_id < 50"), bpe.vocabulary_path()).collect()}
    for i, text in enumerate(ODD[1:], 1):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_merges_apply_in_rank_order():
    """A vocabulary made by hand: overlaps from the left, and a merge that a later one builds on."""
    chars = bpe.byte_characters()
    vocab = {c: i for i, c in enumerate(chars)} | {c + "</w>": 256 + i for i, c in enumerate(chars)}
    merges = [["a", "a"], ["aa", "a"], ["b", "a</w>"], ["aa", "ba</w>"]]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    v = bpe.Vocabulary.parse({"model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": "</w>"}, "added_tokens": []})
    spell = lambda w: [v.tokens[i] for i in bpe.merge_pieces([w.encode()], v)[0]]
    assert spell("aaaaab") == ["aa", "aaa", "b</w>"] and spell("aaba") == ["aaba</w>"] and spell("aaaba") == ["aaa", "ba</w>"]


def test_token_edges(spark, odd, none):
    got = bpe.encode_documents(odd, bpe.vocabulary_path())
    assert got.count() == odd.count() and bpe.encode_documents(none, bpe.vocabulary_path()).count() == 0
    empty = sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.where("doc_id in (1, 2, 3)").collect()} == {(0, empty, empty)}
    ids = bpe.token_ids(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), bpe.vocabulary_path()).first()
    assert ids.decoded == "hello</w> world</w>" and len(ids.ids) == 2


# shards


def check_shards(docs, got, shards=40):
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((d[0] is None, d[0] or 0, len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want


def test_shards_are_even_and_keep_equal_texts(spark):
    rng = random.Random(12)
    docs = [(i, english(rng, rng.choice([1, 5, 50, 400]))) for i in range(1500)] + [(5000 + i, "a common text") for i in range(700)]
    got = kdshard.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 8, part_rows=100).collect()
    check_shards(docs, got, 8)
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) / (sum(size.values()) / 8) < 1.05 and min(size.values()) / (sum(size.values()) / 8) > 0.95


def sorted_tree(rows, shards, first=0):
    """The tree by sorting: (size, chars, crc, id) rows; the widest dimension is cut where the left has its share of the bytes."""
    if shards == 1:
        return {r[3]: first for r in rows}
    spread = {d: max(1, max(r[d] for r in sorted_tree.all) - min(r[d] for r in sorted_tree.all)) for d in range(3)}
    widest = max(range(3), key=lambda d: (max(r[d] for r in rows) - min(r[d] for r in rows)) / spread[d])
    order = sorted(rows, key=lambda r: (r[widest], *(r[d] for d in range(3) if d != widest), r[3]))
    half, total = shards // 2, sum(r[0] for r in rows)
    want, ends = total * half / shards, []
    for r in order:
        ends.append((ends[-1] if ends else 0) + r[0])
    k = next(i for i, e in enumerate(ends) if e >= want)
    n = k + 1 if abs(ends[k] - want) <= abs(ends[k] - order[k][0] - want) else k
    return sorted_tree(order[:n], half, first) | sorted_tree(order[n:], shards - half, first + half)


def test_forty_shards_match_a_tree_made_by_sorting(spark):
    rng = random.Random(13)
    docs = [(i, english(rng, rng.randint(1, 300)) + "é" * rng.randint(0, 40)) for i in range(1200)]
    sorted_tree.all = [(len(t.encode()) + 16, len(t), zlib.crc32(t.encode()), i) for i, t in docs]
    meta = kdshard.metadata(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("ident", kdshard._ident()).withColumn("row", F.monotonically_increasing_id())
    root, _ = kdshard.build(meta, 40, tolerance=0)
    got = {r.doc_id: r.shard for r in meta.withColumn("shard", kdshard._place(root, lambda n: n.first)).collect()}
    assert got == sorted_tree(sorted_tree.all, 40)


def test_repeated_rows_and_null_ids_are_parted(spark):
    docs = [(7, "a text that repeats")] * 1500 + [(None, f"null id {i % 3}") for i in range(200)] + [(i, f"other {i}") for i in range(300)]
    got = kdshard.shard_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    check_shards(docs, got)
    assert len(size) == 40 and max(size.values()) - min(size.values()) < 160


def test_the_tree_splits_at_weighted_medians(spark):
    """Against sorting: a power of two of shards over rows of one size is cut along medians."""
    docs = [(i, f"{i:05d}") for i in range(256)]
    meta = kdshard.metadata(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("ident", kdshard._ident()).withColumn("row", F.monotonically_increasing_id())
    root, n = kdshard.build(meta, 2, tolerance=0)
    crc = sorted(zlib.crc32(t.encode()) for _, t in docs)
    (name, cut), *_ = root.cut
    assert n == 256 and name == "crc" and sum(c <= cut for c in crc) == 128


def test_shard_edges(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    check_shards(docs, kdshard.shard_documents(odd).collect())
    assert kdshard.shard_documents(none).count() == 0
    same = spark.createDataFrame([(1, "x")] * 50, "doc_id long, text string")
    check_shards([(1, "x")] * 50, kdshard.shard_documents(same).collect())
    lone = spark.createDataFrame([(i, "x") for i in range(400)], "doc_id long, text string")
    got = kdshard.shard_documents(lone).collect()
    assert collections.Counter(collections.Counter(r.shard for r in got).values()) == {10: 40}
