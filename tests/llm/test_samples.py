"""Learning samples with one text longer than their bound."""

import io
import os
import pickle
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyspark
import pytest
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import functions as F

from sparrowgrid.llm import bpe, centroids, decontam, langid, simhash, spelling, textops, tokencount, toxicity, warc

WORDS = {0: "the and of with from this", 1: "le la les avec pour dans"}


def sample(spark, most):
    """40 short rows of two classes and, first in hash order, one row of more than ``most`` bytes."""
    ids = [r[0] for r in spark.range(200).where(F.crc32(F.col("id").cast("string")) % 15 != 0).where(F.crc32(F.col("id").cast("string")) % 5 != 0).where(F.crc32(F.col("id").cast("string")) % 3 != 0).orderBy(F.xxhash64("id")).limit(41).collect()]
    rng, rows = random.Random(1), []
    for k, i in enumerate(ids):
        n = 30 if k else most
        rows.append((i, " ".join(rng.choice(WORDS[k % 2].split()) for _ in range(n)), "en fr".split()[k % 2], k % 2))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


@pytest.mark.parametrize("most", [20_000])
def test_one_long_text_costs_only_its_own_place(spark, most):
    rows = sample(spark, most)
    m = langid.fit(rows, langid.Settings(max_bytes=most))
    assert m.languages == ["en", "fr"]
    got = langid.identify(rows, m).select("doc_id", "lang_pred").join(rows, "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in got)
    t = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), toxicity.Settings(max_bytes=most))
    assert t.scalars.any()


@pytest.mark.parametrize("long", ["first", "middle", "class"])
def test_no_class_is_lost_to_long_texts(spark, long):
    """The first row in hash order, one in the middle, or every text of a class is longer than the bound."""
    most = 20_000
    rows = sample(spark, 30).collect()
    over = {rows[0].doc_id} if long == "first" else {rows[20].doc_id} if long == "middle" else {r.doc_id for r in rows if r.toxic == 1}
    data = spark.createDataFrame([(r.doc_id, (r.text + " ") * (most // len(r.text) + 2) if r.doc_id in over else r.text, r.lang, r.toxic) for r in rows], "doc_id long, text string, lang string, toxic int")
    m = langid.fit(data, langid.Settings(max_bytes=most))
    assert m.languages == ["en", "fr"]
    got = langid.identify(data, m).select("doc_id", "lang_pred").join(data, "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in got)
    t = toxicity.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic"), toxicity.Settings(max_bytes=most))
    scored = toxicity.score_documents(data, t).join(data.select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in scored) > 0.9 * len(scored)


def test_training_matches_a_plain_loop():
    """One epoch over whole texts, against gradients summed text by text and member by member."""
    s = toxicity.Settings(buckets=1 << 8, dim=3, epochs=1)
    texts, y = ["bad word", "good word here", "bad bad", "fine", "so good"], np.array([1, 0, 1, 0, 0])
    got = toxicity.train(texts, y, s)
    order = np.random.default_rng(s.seed).permutation(len(texts))
    rng = np.random.default_rng(s.seed)
    table, soft, bias = rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32), rng.normal(0, 0.5, (s.dim, 2)), np.zeros(2)
    share = 0.5 / np.array([3.0, 2.0]) * np.array([1.0, s.toxic_weight])
    rare = s.rare * share.min() / (s.window * 12)
    d_table, d_soft, d_bias = np.zeros(table.shape), np.zeros(2 * s.dim).reshape(s.dim, 2), np.zeros(2)
    direction = soft[:, 1] - soft[:, 0]
    for k in order:
        padded, _ = textops.padded(*textops.buffers(pa.array([texts[k]])), 0, 1)
        begins, ends = textops.word_spans(padded)
        bag = [[] for _ in begins]
        for word, bucket in toxicity._members(padded, begins, ends, s.buckets):
            for w, b in zip(word, bucket):
                bag[w].append(b)
        mean = np.mean([np.mean([table[b] for b in own], axis=0) for own in bag], axis=0)
        g = (1 / (1 + np.exp(-mean @ direction)) - y[k]) * share[y[k]]
        for own in bag:
            for b in own:
                d_table[b] += g / len(bag) / len(own) * direction
        d_soft += np.outer(mean, [-g, g])
        d_bias += [-g, g]
    hit = d_table.any(axis=1)
    table[hit] -= (s.rate * d_table / np.sqrt(rare * rare + d_table**2)).astype(np.float32)[hit]
    soft -= s.rate * d_soft / np.sqrt(1e-10 + d_soft**2)
    bias -= s.rate * d_bias / np.sqrt(1e-10 + d_bias**2)
    assert got.scalars == pytest.approx(table @ (soft[:, 1] - soft[:, 0]), abs=1e-3) and got.bias == pytest.approx(bias[1] - bias[0], abs=1e-4)


ALONE = """
import io, sys, pickle
import pyarrow as pa
from pyspark.serializers import CPickleSerializer
work, sent, batch = (open(p, "rb").read() for p in sys.argv[1:4])
import pyspark.core.broadcast as b
values = pickle.loads(sent)
for k, v in values.items():
    own = b.Broadcast.__new__(b.Broadcast)
    own._value, own._jbroadcast, own._sc, own._python_broadcast, own._path = v, None, None, None, None
    b._broadcastRegistry[k] = own
f = CPickleSerializer().loads(work)
f = f[0] if isinstance(f, tuple) else f
rows = sum(x.num_rows for x in f(iter(pa.ipc.open_stream(batch))))
assert not any(m.split(".")[0] == "sparrowgrid" and getattr(v, "__file__", None) for m, v in sys.modules.items())
print("ROWS", rows)
"""


def test_workers_need_no_copy_of_the_package(spark, tmp_path, monkeypatch):
    """Each operator's task function and what is broadcast to it, opened by a plain Python whose path lacks the package."""
    taken = []
    kind = type(spark.range(0))
    whole = kind.mapInArrow

    def watched(self, func, schema, *more, **named):
        taken.append((self.limit(5), func))
        return whole(self, func, schema, *more, **named)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    rows = [(i, ("the and of " if i % 2 else "le la les ") * 9 + ("stupid" if i % 5 == 2 else "good"), "en" if i % 2 else "fr", int(i % 5 == 2)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    langid.identify(docs, langid.fit(docs))
    toxicity.score_documents(docs, toxicity.fit(docs, docs))
    decontam.find_leaks(docs, spark.createDataFrame([(1, "the and of the and of the and of the and of")], "item_id long, text string"))
    bpe.encode_documents(docs, bpe.vocabulary_path())
    simhash.near_duplicates(docs)
    tokencount.count_tokens(docs, tokencount.vocabulary_path())
    spelling.variants(docs)
    centroids.cluster(vectors, k=2, rounds=1, dim=2)
    warc.derivatives(spark.createDataFrame([(1, "http://a", "<p>x")], "page_id long, url string, html string"))
    assert len(taken) >= 10
    (tmp_path / "alone.py").write_text(ALONE)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(Path(pyspark.__file__).parent.parent)}
    for k, (some, func) in enumerate(taken):
        sent = spark.sparkContext._pickled_broadcast_vars
        sent.clear()
        work = CloudPickleSerializer().dumps(func)
        values = {b._jbroadcast.id(): b.value for b in sent}
        sent.clear()
        rows, sink = some.toArrow(), io.BytesIO()
        with pa.ipc.new_stream(sink, rows.schema) as w:
            w.write_table(rows)
        for name, data in (("work", work), ("sent", pickle.dumps(values)), ("batch", sink.getvalue())):
            (tmp_path / f"{name}{k}").write_bytes(data)
    for k in range(len(taken)):
        done = subprocess.run([sys.executable, "alone.py", f"work{k}", f"sent{k}", f"batch{k}"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=100)
        assert done.stdout.startswith("ROWS"), (k, done.stderr[-3000:])
