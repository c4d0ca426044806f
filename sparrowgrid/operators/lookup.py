"""Ranked word lookup: a learned store and a dictionary on one scale.

``queries`` have qid (unique) and q; ``store`` has seq, en, bn; ``dictionary`` has
no, word, meaning. The stores are bounded (thousands of words); queries are not.
The store side is sent to every task only after its size was checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tf
from .simjoin import most_similar

STORE_ROWS, STORE_BYTES, SCAN_ROWS = 200_000, 32 << 20, 2_000


def bounded(store: DataFrame, rows: int = STORE_ROWS, size: int = STORE_BYTES) -> DataFrame:
    """The store marked for broadcast if it has at most ``rows`` rows and ``size`` bytes of text, else as it is."""
    return F.broadcast(store) if is_bounded(store, rows, size) else store


def is_bounded(store: DataFrame, rows: int = STORE_ROWS, size: int = STORE_BYTES) -> bool:
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in store.dtypes if kind == "string"]
    total = sum(texts, F.lit(16 * len(store.columns)))
    n, held = store.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(total.cast("long")), F.lit(0))).first()
    return n <= rows and held <= size


def scored_words(queries: DataFrame, words: DataFrame) -> DataFrame:
    """``queries`` (ql) and ``words`` (en), both distinct -> (ql, en, score) of all pairs that score above zero.

    Bounded words are scanned by each query in its task. More of them are met by keys:
    a word in the query's beginning, the query anywhere in the word, or at most two
    edits between them; every way to score has one of these.
    """
    pairs = queries.join(F.broadcast(words), F.lit(True)) if is_bounded(words, SCAN_ROWS) else meetings(queries, words)
    return pairs.withColumn("score", tf.learned_score(F.col("ql"), F.col("en"))).where("score > 0")


def scan_learned(queries: DataFrame, store: DataFrame) -> DataFrame:
    """Every query with every learned row that scores above zero; the score is computed once for each pair of words."""
    q = queries.select("qid", tf.ascii_lower(F.col("q")).alias("ql"))
    rated = scored_words(q.select("ql").distinct(), store.select("en").distinct())
    return q.join(rated, "ql").join(bounded(store.select("seq", "en", "bn")), "en").select("qid", "seq", "en", "bn", "score")


def meetings(queries: DataFrame, words: DataFrame) -> DataFrame:
    """``queries`` (ql) and ``words`` (en), both distinct -> pairs of which one begins with or holds the other, or that are two edits apart at most.

    Work grows with the letters of both sides, not with their pairs or squares: a
    query's beginnings are taken at the lengths that words have; a query inside a
    word is met by its rarest run of three letters (or by itself, if shorter); edits
    are looked for between words short enough to score by them.
    """
    lengths = sorted(r[0] for r in words.select(F.length("en").alias("n")).distinct().collect() if r[0] is not None)  # few: n lengths take n * n / 2 letters
    if not lengths:
        return queries.select("ql", F.lit("").alias("en")).limit(0)
    at = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("ql"))
    heads = queries.select("ql", F.explode(F.transform(at, lambda n: F.substring("ql", F.lit(1), n))).alias("en")).join(words, "en").select("ql", "en")
    empty = words.join(F.broadcast(queries.where("ql = ''").limit(1)), F.lit(True)).select("ql", "en")  # one row at most

    able = queries.where((F.length("ql") > 0) & (F.length("ql") <= lengths[-1]))
    held = words.select("en", F.explode(F.array_distinct(F.flatten(F.array(*(tf.letter_runs("en", n) for n in (1, 2, 3)))))).alias("gram"))
    often = held.where("length(gram) = 3").groupBy("gram").agg(F.count("*").alias("df"))
    asked = able.where("length(ql) >= 3").select("ql", F.explode(F.array_distinct(tf.letter_runs("ql", 3))).alias("gram"))
    rarest = asked.join(often, "gram").groupBy("ql").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    inside = rarest.unionByName(able.where("length(ql) < 3").select("ql", F.col("ql").alias("gram"))).join(held, "gram").where(F.contains("en", "ql")).select("ql", "en")

    short = lambda df, c, name: df.where(F.octet_length(c) <= tf.MAX_EDIT_BYTES).select(F.col(c).alias(name))
    near = close_words(short(queries, "ql", "a"), short(words, "en", "b")).select(F.col("a").alias("ql"), F.col("b").alias("en"))
    return heads.union(empty).union(inside).union(near).distinct()


def top_learned(queries: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """The k best learned rows of each query; equal scores keep the store's order, so no word needs more than its first k rows."""
    own = Window.partitionBy("en").orderBy("seq")
    store = store.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= k).drop("__n")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "seq")
    return scan_learned(queries, store).withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def tokens(s: Column) -> Column:
    return F.filter(F.split(tf.ascii_lower(s), "[^0-9a-z]+"), lambda t: t != "")


def fts_bm25(queries: DataFrame, dictionary: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, no, bm25) of dictionary words that share a token with the query; larger is better.

    A reconstruction: the full-text half is known by name only.
    """
    docs = dictionary.select("no", F.explode(tokens(F.col("word"))).alias("t"))
    tf_ = docs.groupBy("no", "t").agg(F.count("*").alias("tf"))
    length = docs.groupBy("no").agg(F.count("*").alias("dl"))
    df = tf_.groupBy("t").agg(F.count("*").alias("df"))
    whole = dictionary.agg(F.count("*").alias("n")).crossJoin(length.agg((F.sum("dl") / F.count("*")).alias("avgdl")))  # one row
    q = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("q")))).alias("t"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return q.join(tf_, "t").join(df, "t").join(length, "no").join(F.broadcast(whole), F.lit(True)).groupBy("qid", "no").agg(F.sum(part).alias("bm25"))


def fuzzy_scan(queries: DataFrame, dictionary: DataFrame, floor: float = 0.5, most: int | None = 50) -> DataFrame:
    """(qid, no, fuzzy): dictionary words at least ``floor`` similar, the best ``most`` for each query, or all of them.

    A similarity join (see ``simjoin``): no dictionary is too large for it.
    """
    asked = queries.select("qid", tf.ascii_lower(F.col("q")).alias("q"))
    words = dictionary.select("no", tf.ascii_lower(F.col("word")).alias("word"))
    return most_similar(asked, words, floor, most).select("qid", "no", F.col("similarity").alias("fuzzy"))


def hybrid(queries: DataFrame, dictionary: DataFrame, floor: float = 0.5, most: int = 50, weight: float = 0.5) -> DataFrame:
    """Full-text and fuzzy candidates merged by row: qid, no, word, meaning, bm25, fuzzy, combined, from_fts5.

    ``combined`` is 1 for the exact word, else a mean of the similarity and of
    bm25 / (1 + bm25). A reconstruction with parameters: the sources give only that
    an exact word has 1.00, that fuzzy-only rows have bm25 0.0, and the order.
    """
    both = fts_bm25(queries, dictionary).join(fuzzy_scan(queries, dictionary, floor, most), ["qid", "no"], "full_outer")
    q = queries.select("qid", tf.ascii_lower(F.col("q")).alias("ql"))
    rows = both.join(bounded(dictionary.select("no", "word", "meaning")), "no").join(q, "qid")
    similar = F.coalesce("fuzzy", tf.similarity(F.col("ql"), tf.ascii_lower(F.col("word"))))
    score = F.coalesce("bm25", F.lit(0.0))
    exact = F.col("ql") == tf.ascii_lower(F.col("word"))
    return rows.select(
        "qid", "no", "word", "meaning", F.round(score, 6).alias("bm25"), F.round(similar, 6).alias("fuzzy"),
        F.round(F.when(exact, 1.0).otherwise((1 - weight) * similar + weight * score / (1 + score)), 6).alias("combined"), F.col("bm25").isNotNull().alias("from_fts5"),
    )


def ranked_hybrid(queries: DataFrame, dictionary: DataFrame, **how: float) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("combined"), "no")
    return hybrid(queries, dictionary, **how).withColumn("rk", F.row_number().over(order))


def api_search(queries: DataFrame, store: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Six learned rows, then ten dictionary rows; neither merged nor freed of duplicates, learned scores unclipped."""
    a = top_learned(queries, store, 6).select("qid", F.col("rk").alias("pos"), "en", "bn", F.lit("learned").alias("src"), (F.col("score") / 1000).alias("score"))
    n = a.groupBy("qid").agg(F.count("*").alias("before"))
    d = ranked_hybrid(queries, dictionary).where("rk <= 10").join(n, "qid", "left")
    d = d.select("qid", (F.coalesce("before", F.lit(0)) + F.col("rk")).cast("int").alias("pos"), F.col("word").alias("en"), F.col("meaning").alias("bn"), _source().alias("src"), F.col("combined").alias("score"))
    return a.unionByName(d)


def _source() -> Column:
    return F.when(F.col("from_fts5"), "db/fts5").otherwise("db/fuzzy")


def merged(queries: DataFrame, store: DataFrame, dictionary: DataFrame, k: int) -> DataFrame:
    """The k best of both stores, one row for each word: the first offered stays, learned words are offered first.

    Learned scores are cut at 1. Exact as an ordered fold: a word whose offer was
    pushed out by better ones may be offered again.
    """
    a = top_learned(queries, store, k).select("qid", F.struct(F.lit(0).alias("side"), F.col("rk").alias("at"), "en", "bn", F.lit("learned").alias("src"), F.least(F.lit(1.0), F.col("score") / 1000).alias("s")).alias("o"))
    d = ranked_hybrid(queries, dictionary).select("qid", F.struct(F.lit(1).alias("side"), F.col("rk").alias("at"), F.col("word").alias("en"), F.col("meaning").alias("bn"), _source().alias("src"), F.col("combined").alias("s")).alias("o"))
    offers = a.unionByName(d).groupBy("qid").agg(F.sort_array(F.collect_list("o")).alias("offers"))  # bounded: k and the candidate limit
    kind = "array<struct<en:string,bn:string,src:string,s:double>>"
    empty = F.array().cast(kind)

    def offer(kept: Column, o: Column) -> Column:
        new = F.struct(o["en"].alias("en"), o["bn"].alias("bn"), o["src"].alias("src"), o["s"].alias("s"))
        known = F.exists(kept, lambda r: tf.ascii_lower(r["en"]) == tf.ascii_lower(o["en"]))
        full = (F.size(kept) >= k) & (o["s"] <= F.element_at(kept, -1)["s"])
        room = F.slice(kept, 1, k - 1)
        better, worse = F.filter(room, lambda r: r["s"] >= o["s"]), F.filter(room, lambda r: r["s"] < o["s"])
        return F.when(known, kept).when((F.size(kept) > 0) & full, kept).otherwise(F.concat(better, F.array(new), worse))

    best = offers.select("qid", F.posexplode(F.aggregate("offers", empty, offer)).alias("pos", "r"))
    return best.select("qid", (F.col("pos") + 1).alias("rk"), "r.en", "r.bn", "r.src", F.col("r.s").alias("score"))


def lookup_word(queries: DataFrame, store: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The one best answer: an exact learned word at once, else the better of both stores, learned on a tie.

    Queries are trimmed first; those under two bytes, or without an answer, come
    back as they are with source "none". Only queries without an exact learned
    word are searched in the dictionary.
    """
    q = queries.select("qid", tf.trim_word(F.col("q")).alias("q"))
    able = q.where(F.octet_length("q") >= 2)
    learned = top_learned(able, store, 1).select("qid", F.col("en").alias("l_en"), F.col("bn").alias("l_bn"), F.col("score").alias("l_score"))
    rest = able.join(learned.where("l_score >= 1000").select("qid"), "qid", "left_anti")
    best = ranked_hybrid(rest, dictionary).where("rk = 1").select("qid", "word", "meaning", "combined", _source().alias("d_src"))
    both = q.join(learned, "qid", "left").join(best, "qid", "left")
    l_score, d_score = F.when(F.col("l_score").isNull(), -1.0).otherwise(F.least(F.lit(1.0), F.col("l_score") / 1000)), F.coalesce("combined", F.lit(-1.0))
    none, by_learned = (l_score < 0) & (d_score < 0), l_score >= d_score

    def pick(a: str, b: str, otherwise: Column) -> Column:
        return F.when(none, otherwise).when(by_learned, F.col(a)).otherwise(F.col(b))

    return both.select(
        "qid", pick("l_en", "word", F.col("q")).alias("en"), pick("l_bn", "meaning", F.lit("")).alias("bn"),
        F.when(none, "none").when(by_learned, "learned").otherwise(F.col("d_src")).alias("src"),
    )


def segments(length: Column) -> list[tuple[Column, Column]]:
    """Begin and size of the three parts of a word; lengths differ by one at most."""
    a = F.floor(length / 3)
    b = F.floor((length + 1) / 3)
    return [(F.lit(1), a), (a + 1, b), (a + b + 1, length - a - b)]


def close_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of words at most two edits apart, without comparing all pairs.

    ``left`` has a, ``right`` b, both distinct. Of three parts of b one at least is
    in a unchanged, at a place that the other parts' edits allow: 19 keys for each a
    and three for each b meet in an equi-join; the distance is computed for these
    pairs only. Words under three letters meet by length.
    """
    la, lb = F.length("a"), F.length("b")
    allowed = [(d, i, s) for d in range(-2, 3) for i in range(3) for s in range(-i, i + 1) if abs(s - d) <= 2 - i]
    keys_a = []
    for d, i, shift in allowed:
        own = la - d
        at, size = segments(own)[i]
        ok = (own >= 3) & (at + shift >= 1) & (at + shift + size - 1 <= la)
        keys_a.append(F.when(ok, F.concat_ws("|", own.cast("string"), F.lit(str(i)), F.col("a").substr((at + shift).cast("int"), size.cast("int")))))
    keys_a += [F.when(F.abs(la - n) <= 2, F.lit(f"short{n}")) for n in range(3)]
    keys_b = [F.when(lb >= 3, F.concat_ws("|", lb.cast("string"), F.lit(str(i)), F.col("b").substr(at.cast("int"), size.cast("int")))) for i, (at, size) in enumerate(segments(lb))]
    keys_b.append(F.when(lb < 3, F.concat(F.lit("short"), lb.cast("string"))))
    a = left.select("a", F.explode(F.array_distinct(F.array_compact(F.array(*keys_a)))).alias("key"))
    b = right.select("b", F.explode(F.array_distinct(F.array_compact(F.array(*keys_b)))).alias("key"))
    met = a.join(b, "key").select("a", "b").distinct()  # pairs that meet in several keys are measured once
    return met.select("a", "b", F.levenshtein("a", "b", 2).alias("distance")).where("distance >= 0")
