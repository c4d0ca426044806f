"""Queries over words: scores, lookups, merges and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tf
from ..operators import ingest, lookup
from ..streaming.stateful import place
from . import tables as t

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_SCORE = """CASE WHEN ql = en THEN 1000 WHEN starts_with(en, ql) THEN 700 - (strlen(en) - strlen(ql)) WHEN starts_with(ql, en) THEN 600 - (strlen(ql) - strlen(en))
 WHEN ql <> '' AND contains(en, ql) THEN 400 WHEN strlen(ql) <= 24 AND strlen(en) <= 24 AND levenshtein(ql, en) <= 2 THEN 300 - 50 * levenshtein(ql, en) ELSE 0 END"""
_WITH = f"WITH q AS ({t.QUERIES_SQL}), d AS ({t.DICTIONARY_SQL}), l AS ({t.LEARNED_SQL}), fl AS ({t.FEW_LEARNED_SQL})"


@query("score_table", f"{_WITH} SELECT qid, word AS en, CAST({_SCORE} AS INTEGER) AS score FROM (SELECT qid, lower(q) AS ql, word, lower(word) AS en FROM q, d) WHERE score > 0")
def score_table(spark: SparkSession, sf: str) -> DataFrame:
    d = t.dictionary(spark, sf).select(F.col("no").alias("seq"), F.col("word").alias("en"), F.lit("").alias("bn"))
    pairs = t.queries(spark, sf).join(lookup.bounded(d), F.lit(True))
    return pairs.select("qid", "en", tf.match_score(tf.ascii_lower(F.col("q")), tf.ascii_lower(F.col("en"))).cast("int").alias("score")).where("score > 0")


def _top(store: str, k: int) -> str:
    return f"""SELECT qid, seq, en, bn, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rk FROM (
      SELECT qid, seq, en, bn, raw + 25 AS score FROM (SELECT qid, seq, en, bn, {_SCORE} AS raw FROM (SELECT qid, lower({{q}}) AS ql FROM q) , {store}) WHERE raw > 0)) WHERE rk <= {k}"""


@query("learned_topk", f"{_WITH} SELECT qid, CAST(rk AS INTEGER) AS rk, en, bn, CAST(score AS INTEGER) AS score FROM ({_top('l', 6).format(q='q')})")
def learned_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.top_learned(t.queries(spark, sf), t.learned(spark, sf), 6).select("qid", "rk", "en", "bn", F.col("score").cast("int").alias("score"))


@query("learned_top8", f"{_WITH} SELECT qid, CAST(rk AS INTEGER) AS rk, en, bn, CAST(score AS INTEGER) AS score FROM ({_top('fl', 8).format(q='q')})")
def learned_top8(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.top_learned(t.queries(spark, sf), t.few_learned(spark, sf), 8).select("qid", "rk", "en", "bn", F.col("score").cast("int").alias("score"))


@query("learned_exact_lookup", f"""{_WITH} SELECT word, no, EXISTS (SELECT 1 FROM fl WHERE fl.en = lower(word)) AS is_learned,
  (SELECT arg_min(bn, seq) FROM fl WHERE fl.en = lower(word)) AS first_gloss FROM d""")
def learned_exact_lookup(spark: SparkSession, sf: str) -> DataFrame:
    first = t.few_learned(spark, sf).groupBy("en").agg(F.min_by("bn", "seq").alias("first_gloss"))
    d = t.dictionary(spark, sf)
    return d.join(first, tf.ascii_lower(d["word"]) == first["en"], "left").select("word", "no", F.col("en").isNotNull().alias("is_learned"), "first_gloss")


@query("trim_words", "SELECT conv_id, turn, i, regexp_replace(w, '^[^0-9A-Za-z]+|[^0-9A-Za-z]+$', '', 'g') AS word FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations WHERE text IS NOT NULL)")
def trim_words(spark: SparkSession, sf: str) -> DataFrame:
    words = t.table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    return words.select("conv_id", "turn", F.col("i").cast("long").alias("i"), tf.trim_word(F.col("w")).alias("word"))


@query("lev_distance", "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM n a, n b WHERE a.p_name < b.p_name")
def lev_distance(spark: SparkSession, sf: str) -> DataFrame:
    n = t.table(spark, sf, "part").select("p_name").distinct()
    a, b = n.select(F.col("p_name").alias("a")), n.select(F.col("p_name").alias("b"))
    return a.join(lookup.bounded(b), F.col("a") < F.col("b")).select("a", "b", tf.byte_levenshtein(F.col("a"), F.col("b")).cast("int").alias("distance"))


_TOKENS = "list_filter(regexp_split_to_array(lower({x}), '[^0-9a-z]+'), lambda y: y <> '')"
_FTS = f"""dt AS (SELECT no, unnest({_TOKENS.format(x='word')}) AS t FROM d), tfs AS (SELECT no, t, count(*) AS tf FROM dt GROUP BY no, t),
 dls AS (SELECT no, count(*) AS dl FROM dt GROUP BY no), dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t),
 qt AS (SELECT DISTINCT qid, unnest({_TOKENS.format(x='q')}) AS t FROM q),
 fts AS (SELECT qid, no, sum(ln(((SELECT count(*) FROM d) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dls)))) AS bm25
   FROM qt JOIN tfs USING (t) JOIN dfs USING (t) JOIN dls USING (no) GROUP BY qid, no)"""
_SIMILAR = "CASE WHEN greatest(strlen(ql), strlen(word)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(ql, lower(word)) / greatest(strlen(ql), strlen(word)) END"
_FUZZY = f"""fz AS (SELECT qid, no, fuzzy FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fuzzy DESC, no) AS n FROM (
   SELECT qid, no, {_SIMILAR} AS fuzzy FROM (SELECT qid, lower(q) AS ql FROM q), d) WHERE fuzzy >= 0.5) WHERE n <= 50)"""
_HYBRID = f"""hy AS (SELECT qid, no, word, meaning, round(coalesce(bm25, 0.0), 6) AS bm25, round(sim, 6) AS fuzzy,
   round(CASE WHEN ql = lower(word) THEN 1.0 ELSE 0.5 * sim + 0.5 * coalesce(bm25, 0.0) / (1 + coalesce(bm25, 0.0)) END, 6) AS combined, bm25 IS NOT NULL AS from_fts5
 FROM (SELECT *, coalesce(fuzzy, {_SIMILAR}) AS sim FROM (SELECT qid, no, bm25, fuzzy FROM fts FULL JOIN fz USING (qid, no)) JOIN d USING (no) JOIN (SELECT qid, lower(q) AS ql FROM q) USING (qid))),
 rh AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY combined DESC, no) AS rk FROM hy)"""
_SEARCH = f"{_WITH}, {_FTS}, {_FUZZY}, {_HYBRID}"


@query("fts_bm25", f"{_WITH}, {_FTS} SELECT qid, no, round(bm25, 6) AS bm25 FROM fts")
def fts_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.fts_bm25(t.queries(spark, sf), t.dictionary(spark, sf)).select("qid", "no", F.round("bm25", 6).alias("bm25"))


@query("fuzzy_scan", f"{_WITH}, {_FUZZY} SELECT qid, no, round(fuzzy, 6) AS fuzzy FROM fz")
def fuzzy_scan(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.fuzzy_scan(t.queries(spark, sf), t.dictionary(spark, sf)).select("qid", "no", F.round("fuzzy", 6).alias("fuzzy"))


_VOCABULARY = "SELECT w AS word FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY w HAVING count(*) >= 20"


@query("fuzzy_vocabulary", f"""WITH q AS ({t.QUERIES_SQL}), d AS ({_VOCABULARY}), f AS (SELECT qid, word, 1.0 - levenshtein(ql, word) / greatest(strlen(ql), strlen(word)) AS fuzzy FROM (SELECT qid, lower(q) AS ql FROM q), d
  WHERE 2 * least(strlen(ql), strlen(word)) >= greatest(strlen(ql), strlen(word))) SELECT qid, word, round(fuzzy, 6) AS fuzzy FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fuzzy DESC, word) AS n FROM f WHERE fuzzy >= 0.5) WHERE n <= 50""")
def fuzzy_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The words of all conversations against the vocabulary of ``documents`` (words of at least 20 texts), which grows with them.

    Both are made once and written: the search counts them, then reads them several times.
    """
    n = words_of(t.table(spark, sf, "documents")).where("n >= 20").select("word", F.col("word").alias("no"))
    return lookup.fuzzy_scan(_kept(t.queries(spark, sf)), _kept(n)).select("qid", F.col("no").alias("word"), F.round("fuzzy", 6).alias("fuzzy"))


def words_of(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) -> word, n: in how many documents it is. Pairs of document and word are shuffled only where an id repeats."""
    said = documents.select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("words"))
    repeated = documents.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("id"))
    each = said.select(F.explode("words").alias("word"))
    if not repeated.isEmpty():
        of_repeated = F.col("doc_id").eqNullSafe(F.col("id"))
        each = said.join(repeated, of_repeated, "left_anti").select(F.explode("words").alias("word"))
        each = each.union(said.join(repeated, of_repeated, "left_semi").select("doc_id", F.explode("words").alias("word")).distinct().select("word"))
    return each.groupBy("word").agg(F.count("*").alias("n"))


def _kept(rows: DataFrame) -> DataFrame:
    path = place(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


@query("hybrid_full_outer", f"{_SEARCH} SELECT qid, no, word, meaning, bm25, fuzzy, combined, from_fts5, CAST(rk AS INTEGER) AS rk FROM rh")
def hybrid_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.ranked_hybrid(t.queries(spark, sf), t.dictionary(spark, sf))


@query("api_search_union", f"""{_SEARCH}, a AS ({_top('fl', 6).format(q='q')}), n AS (SELECT qid, count(*) AS n FROM a GROUP BY qid)
 SELECT qid, CAST(rk AS INTEGER) AS pos, en, bn, 'learned' AS src, score / 1000 AS score FROM a UNION ALL
 SELECT qid, CAST(coalesce(n, 0) + rk AS INTEGER), word, meaning, CASE WHEN from_fts5 THEN 'db/fts5' ELSE 'db/fuzzy' END, combined FROM rh LEFT JOIN n USING (qid) WHERE rk <= 10""")
def api_search_union(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.api_search(t.queries(spark, sf), t.few_learned(spark, sf), t.dictionary(spark, sf))


_TRIMMED = "q AS (SELECT qid, regexp_replace(q, '^[^0-9A-Za-z]+|[^0-9A-Za-z]+$', '', 'g') AS q FROM (" + t.QUERIES_SQL + "))"
_LOOKUP = f"WITH {_TRIMMED}, d AS ({t.DICTIONARY_SQL}), l AS ({t.LEARNED_SQL}), fl AS ({t.FEW_LEARNED_SQL}), {_FTS}, {_FUZZY}, {_HYBRID}"


@query("lookup_word_best", f"""{_LOOKUP}, a AS ({_top('fl', 1).format(q='q')}), b AS (SELECT * FROM rh WHERE rk = 1),
 j AS (SELECT q.qid, q.q, a.en, a.bn, CASE WHEN strlen(q.q) >= 2 AND a.score IS NOT NULL THEN least(1.0, a.score / 1000) ELSE -1.0 END AS ls, b.word, b.meaning, b.from_fts5,
   CASE WHEN strlen(q.q) >= 2 THEN coalesce(b.combined, -1.0) ELSE -1.0 END AS ds FROM q LEFT JOIN a USING (qid) LEFT JOIN b USING (qid))
 SELECT qid, CASE WHEN ls < 0 AND ds < 0 THEN q WHEN ls >= ds THEN en ELSE word END AS en, CASE WHEN ls < 0 AND ds < 0 THEN '' WHEN ls >= ds THEN bn ELSE meaning END AS bn,
  CASE WHEN ls < 0 AND ds < 0 THEN 'none' WHEN ls >= ds THEN 'learned' WHEN from_fts5 THEN 'db/fts5' ELSE 'db/fuzzy' END AS src FROM j""")
def lookup_word_best(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.lookup_word(t.queries(spark, sf), t.few_learned(spark, sf), t.dictionary(spark, sf))


def _merged_sql(head: str, k: int, able: str) -> str:
    return f"""{head.replace("WITH ", "WITH RECURSIVE ", 1)}, offers AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY side, rk) AS n FROM (
   SELECT qid, 0 AS side, rk, en, bn, 'learned' AS src, least(1.0, score / 1000) AS s FROM ({_top('fl', k).format(q='q')}) UNION ALL
   SELECT qid, 1, rk, word, meaning, CASE WHEN from_fts5 THEN 'db/fts5' ELSE 'db/fuzzy' END, combined FROM rh) WHERE qid IN (SELECT qid FROM q WHERE strlen(q) >= {able})),
 f AS (SELECT DISTINCT qid, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(en VARCHAR, bn VARCHAR, src VARCHAR, s DOUBLE)[]) AS kept FROM offers
  UNION ALL SELECT f.qid, o.n, CASE WHEN len(list_filter(kept, lambda r: lower(r.en) = lower(o.en))) > 0 THEN kept WHEN len(kept) >= {k} AND o.s <= kept[-1].s THEN kept
   ELSE list_concat(list_concat(list_filter(kept[1:{k - 1}], lambda r: r.s >= o.s), [{{'en': o.en, 'bn': o.bn, 'src': o.src, 's': o.s}}]), list_filter(kept[1:{k - 1}], lambda r: r.s < o.s)) END
  FROM f JOIN offers o ON o.qid = f.qid AND o.n = f.n + 1),
 e AS (SELECT qid, unnest(kept) AS r, generate_subscripts(kept, 1) AS rk FROM (SELECT qid, arg_max(kept, n) AS kept FROM f GROUP BY qid))
 SELECT qid, CAST(rk AS INTEGER) AS rk, r.en AS en, r.bn AS bn, r.src AS src, r.s AS score FROM e"""


@query("search_top10", _merged_sql(_SEARCH, 10, 1))
def search_top10(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.merged(t.queries(spark, sf).where("q <> ''"), t.few_learned(spark, sf), t.dictionary(spark, sf), 10)


@query("candidates_top4", _merged_sql(_LOOKUP, 4, 2))
def candidates_top4(spark: SparkSession, sf: str) -> DataFrame:
    q = t.queries(spark, sf).select("qid", tf.trim_word(F.col("q")).alias("q")).where(F.octet_length("q") >= 2)
    return lookup.merged(q, t.few_learned(spark, sf), t.dictionary(spark, sf), 4)


_DOC_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower({x}), '[a-z]+')) AS {n} FROM {f}"


@query("fuzzy_join", f"""WITH a AS ({_DOC_WORDS.format(x='text', n='a', f='conversations')}), b AS ({_DOC_WORDS.format(x='p_name', n='b', f='part')})
 SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS distance FROM a, b WHERE levenshtein(a, b) <= 2""")
def fuzzy_join(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda name, col: t.table(spark, sf, name).select(F.explode(F.regexp_extract_all(F.lower(col), F.lit("[a-z]+"), 0)).alias("w")).distinct()
    return lookup.close_words(words("conversations", "text").withColumnRenamed("w", "a"), words("part", "p_name").withColumnRenamed("w", "b"))


_LINES = f"lines AS ({t.IMPORT_SQL}), clean AS (SELECT ord, regexp_replace(regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g'), '^' || chr(65279), '') AS line FROM lines WHERE regexp_replace(line, '[ \\t-\\r]+', '', 'g') <> '')"
# One step of the reader for each character: fields so far, the field being read, and whether quotes are open or a character is skipped.
_SPLIT = f"""WITH RECURSIVE {_LINES}, st AS (
 SELECT ord, line, contains(line, chr(9)) AS tsv, 1 AS i, CAST([] AS VARCHAR[]) AS f, '' AS cur, false AS quoted FROM clean
 UNION ALL SELECT ord, line, tsv, CASE WHEN c = '"' AND NOT tsv AND quoted AND line[i + 1] = '"' THEN i + 2 ELSE i + 1 END,
  CASE WHEN NOT quoted AND c = sep THEN list_append(f, cur) ELSE f END,
  CASE WHEN c = '"' AND NOT tsv THEN CASE WHEN quoted AND line[i + 1] = '"' THEN cur || '"' ELSE cur END WHEN NOT quoted AND c = sep THEN '' ELSE cur || c END,
  CASE WHEN c = '"' AND NOT tsv AND NOT (quoted AND line[i + 1] = '"') THEN NOT quoted ELSE quoted END
 FROM (SELECT *, line[i] AS c, CASE WHEN tsv THEN chr(9) ELSE ',' END AS sep FROM st WHERE i <= length(line) AND len(f) < 3)),
fields AS (SELECT ord, list_transform(list_append(f, cur), lambda x: regexp_replace(x, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g')) AS f FROM st WHERE i > length(line) OR len(f) = 3)"""


@query("csv_split_fields", f"{_SPLIT} SELECT ord, CAST(len(f) AS INTEGER) AS n, f[1] AS f1, f[2] AS f2, f[3] AS f3, f[4] AS f4 FROM fields")
def csv_split_fields(spark: SparkSession, sf: str) -> DataFrame:
    lines = t.import_lines(spark, sf).select("ord", tf.trim_space(F.col("line")).alias("line")).where("line <> ''")
    f = lines.select("ord", tf.split_fields(tf.strip_bom(F.col("line"))).alias("f"))
    return f.select("ord", F.size("f").alias("n"), *[F.try_element_at("f", F.lit(k)).alias(f"f{k}") for k in range(1, 5)])


_PAIRS = f"""{_SPLIT}, pairs AS (SELECT ord, CASE WHEN len(f) >= 3 AND regexp_full_match(f[1], '[0-9]+') THEN f[2] WHEN len(f) >= 2 THEN f[1] ELSE '' END AS en,
  CASE WHEN len(f) >= 3 AND regexp_full_match(f[1], '[0-9]+') THEN f[3] WHEN len(f) >= 2 THEN f[2] ELSE '' END AS bn FROM fields),
 rws AS (SELECT * FROM pairs WHERE NOT (ord = (SELECT min(ord) FROM clean) AND lower(en) IN ('word', 'english', 'en', 'id', 'headword')))"""
_VALID = "regexp_full_match(en, '[A-Za-z'' -]{1,32}')"


@query("headword_valid", f"{_PAIRS} SELECT ord, en, {_VALID} AS valid FROM rws")
def headword_valid(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parse(t.import_lines(spark, sf)).select("ord", "en", tf.valid_headword(F.col("en")).alias("valid"))


@query("bengali_filter", f"{_PAIRS} SELECT ord, bn FROM rws WHERE regexp_matches(bn, '[ঀ-৿]')")
def bengali_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parse(t.import_lines(spark, sf)).where(tf.has_bengali(F.col("bn"))).select("ord", "bn")


CAPACITY = 900
_ROUTE = f"""{_PAIRS}, d AS ({t.DICTIONARY_SQL}), fl AS ({t.FEW_LEARNED_SQL}), m AS (SELECT *, CASE WHEN {_VALID} AND regexp_matches(bn, '[ঀ-৿]') THEN lower(en) END AS w FROM rws),
 k AS (SELECT *, w IN (SELECT en FROM fl) AS isl, w IN (SELECT lower(word) FROM d) AS isd FROM m),
 nw AS (SELECT w, min(ord) AS fo, row_number() OVER (ORDER BY min(ord)) AS nth FROM k WHERE w IS NOT NULL AND NOT isl AND NOT isd GROUP BY w),
 routed AS (SELECT ord, en, bn, CASE WHEN w IS NULL THEN 'rejected' WHEN isl THEN 'already_learned' WHEN isd THEN 'in_dictionary'
  WHEN nth > {CAPACITY} - (SELECT count(*) FROM fl) THEN 'no_room' WHEN ord = fo THEN 'added' ELSE 'already_learned' END AS outcome FROM k LEFT JOIN nw USING (w))"""


@query("import_route", f"{_ROUTE} SELECT ord, en, bn, outcome FROM routed")
def import_route(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.route(ingest.parse(t.import_lines(spark, sf)), t.few_learned(spark, sf), t.dictionary(spark, sf), CAPACITY)


@query("import_outcome_counts", f"""{_ROUTE} SELECT count(*) AS received, count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'in_dictionary') AS in_dictionary,
 count(*) FILTER (outcome = 'already_learned') AS already_learned, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'no_room') AS no_room FROM routed""")
def import_outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.outcome_counts(import_route(spark, sf))


@query("json_escapes", r"""SELECT doc_id, replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') AS plain,
 '"' || replace(replace(regexp_replace(text, '[\x00-\x1f]', '', 'g'), chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' AS strict FROM documents""")
def json_escapes(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "documents").select("doc_id", tf.json_escape_plain(F.col("text")).alias("plain"), tf.json_escape_strict(F.col("text")).alias("strict"))


# The cut is followed by what ends inside it: the longest beginning of whole characters that fits.
@query("byte_truncation", """SELECT doc_id, left(text, CAST(coalesce(list_max(list_filter(range(0, 72), lambda k: strlen(left(text, k)) <= 71)), 0) AS BIGINT)) AS kept FROM documents""")
def byte_truncation(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as copied into a fixed buffer (72 bytes with the closing zero)."""
    return t.table(spark, sf, "documents").select("doc_id", tf.truncate_bytes(F.col("text"), 72).alias("kept"))
