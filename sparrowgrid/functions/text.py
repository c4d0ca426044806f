"""Scalar string rules, as column expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEARNED_BONUS, MAX_EDIT_BYTES = 25, 24
#: First fields that mark a header line.
HEADER_WORDS = ("word", "english", "en", "id", "headword")


def ascii_lower(s: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(s, UPPER, LOWER)


def trim_space(s: Column) -> Column:
    """Trims the six ASCII blanks of C's isspace."""
    return F.regexp_replace(s, r"^[ \t-\r]+|[ \t-\r]+$", "")


def trim_word(s: Column) -> Column:
    """Trims what is no ASCII letter or digit at both ends."""
    return F.regexp_replace(s, "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")


def byte_string(s: Column) -> Column:
    """A string with one character for each UTF-8 byte."""
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def letter_runs(s: Column | str, n: int) -> Column:
    """All runs of n letters, in order. Letters are split once and laid beside each other, so time is in proportion to the text."""
    letters = F.filter(F.split(s, ""), lambda x: x != "")
    out = letters
    for k in range(1, n):
        out = F.zip_with(out, F.slice(letters, F.lit(k + 1), F.length(s)), lambda a, b: F.concat(a, b))
    return F.array_compact(out)


def byte_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over bytes; 99 if a side has more than 24 bytes."""
    long = (F.octet_length(a) > MAX_EDIT_BYTES) | (F.octet_length(b) > MAX_EDIT_BYTES)
    return F.when(long, F.lit(99)).otherwise(F.levenshtein(byte_string(a), byte_string(b)))


def match_score(q: Column, en: Column) -> Column:
    """Rank of a stored word for a lower-cased query: exact, prefix, extension, substring, edit distance up to 2, else 0."""
    nq, ne = F.octet_length(q), F.octet_length(en)
    close = F.levenshtein(byte_string(q), byte_string(en), 2)  # -1 beyond 2
    short = (nq <= MAX_EDIT_BYTES) & (ne <= MAX_EDIT_BYTES)
    return (
        F.when(q == en, F.lit(1000))
        .when(F.startswith(en, q), F.lit(700) - (ne - nq))
        .when(F.startswith(q, en), F.lit(600) - (nq - ne))
        .when((q != "") & F.contains(en, q), F.lit(400))
        .when(short & (close >= 0), F.lit(300) - close * 50)
        .otherwise(F.lit(0))
    )


def learned_score(q: Column, en: Column) -> Column:
    """Match score with the bonus for learned words, which only candidates get."""
    s = match_score(q, en)
    return F.when(s > 0, s + LEARNED_BONUS).otherwise(F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, over bytes; 1 for two empty strings. (A reconstruction: the formula is not published.)"""
    most = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(byte_string(a), byte_string(b)) / most)


def valid_headword(s: Column) -> Column:
    """1 to 32 bytes of ASCII letters, apostrophes, blanks and hyphens."""
    return F.coalesce(s, F.lit("")).rlike("^[A-Za-z' -]{1,32}$")


def has_bengali(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike("[ঀ-৿]")


def all_digits(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike("^[0-9]+$")


def strip_bom(s: Column) -> Column:
    return F.regexp_replace(s, "^﻿", "")


def leading_int(s: Column) -> Column:
    """The integer that a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(s, r"^[ \t-\r]*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def truncate_bytes(s: Column, capacity: int) -> Column:
    """As a copy into a buffer of ``capacity`` bytes with a closing zero; a character cut in half is dropped."""
    cut = F.decode(F.substring(F.encode(s, "UTF-8"), 1, capacity - 1), "ISO-8859-1")
    whole = F.regexp_replace(cut, "(?:[À-ß]|[à-ï][\u0080-¿]?|[ð-÷][\u0080-¿]{0,2})$", "")
    return F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8")


def json_escape_plain(s: Column) -> Column:
    """Escapes quotes, backslashes and line feeds only."""
    s = F.regexp_replace(s, r"([\\\"])", r"\\$1")
    return F.regexp_replace(s, "\n", r"\\n")


def json_escape_strict(s: Column) -> Column:
    """Drops control characters, escapes quotes and backslashes, and adds quotes around."""
    s = F.regexp_replace(F.regexp_replace(s, "[\u0000-\u001f]", ""), r"([\\\"])", r"\\$1")
    return F.concat(F.lit('"'), s, F.lit('"'))


def split_fields(line: Column, most: int = 4) -> Column:
    """Fields of a TSV or CSV line, each trimmed.

    A tab anywhere makes the line TSV, where quotes are literal. In CSV a quote
    toggles anywhere, and a doubled one inside quotes is one quote. Reading stops
    after separator ``most`` - 1, so the last possible field is always empty.
    """
    tsv = F.contains(line, F.lit("\t"))
    sep = F.when(tsv, F.lit("\t")).otherwise(F.lit(","))
    chars = F.when(F.length(line) > 0, F.split(line, "")).otherwise(F.array().cast("array<string>"))
    pairs = F.transform(chars, lambda c, i: F.struct(c.alias("c"), F.coalesce(F.try_element_at(chars, i + 2), F.lit("")).alias("next")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(False).alias("quoted"), F.lit(False).alias("skip"))

    def state(out: Column, cur: Column, quoted: Column, skip: Column) -> Column:
        return F.struct(out.alias("out"), cur.alias("cur"), quoted.alias("quoted"), skip.alias("skip"))

    def step(s: Column, p: Column) -> Column:
        out, cur, quoted = s["out"], s["cur"], s["quoted"]
        quote = ~tsv & (p["c"] == '"')
        return (
            F.when(F.size(out) >= most - 1, s)
            .when(s["skip"], state(out, cur, quoted, F.lit(False)))
            .when(quote & quoted & (p["next"] == '"'), state(out, F.concat(cur, F.lit('"')), quoted, F.lit(True)))
            .when(quote, state(out, cur, ~quoted, F.lit(False)))
            .when(~quoted & (p["c"] == sep), state(F.array_append(out, cur), F.lit(""), quoted, F.lit(False)))
            .otherwise(state(out, F.concat(cur, p["c"]), quoted, F.lit(False)))
        )

    folded = F.aggregate(pairs, start, step, lambda s: F.array_append(s["out"], s["cur"]))
    cut = lambda pattern: F.split(line, pattern, most)
    last = F.slice(cut("\t"), 1, most - 1), F.slice(cut(","), 1, most - 1)
    short = [F.when(F.size(cut(p)) == most, F.concat(own, F.array(F.lit("")))).otherwise(cut(p)) for p, own in zip(("\t", ","), last, strict=True)]
    # Only lines with quotes need the fold; the rest are cut at their separators.
    fields = F.when(tsv, short[0]).when(~F.contains(line, F.lit('"')), short[1]).otherwise(folded)
    return F.transform(fields, trim_space)


def import_pair(fields: Column) -> tuple[Column, Column]:
    """Word and gloss: the first column is skipped if there are three and it is a number."""
    n = F.size(fields)
    get = lambda k: F.try_element_at(fields, F.lit(k))
    numbered = (n >= 3) & all_digits(get(1))
    return F.when(numbered, get(2)).when(n >= 2, get(1)).otherwise(""), F.when(numbered, get(3)).when(n >= 2, get(2)).otherwise("")


def fnv1a(values: Column) -> Column:
    """32-bit FNV-1a of an array of integers, each taken as one byte."""
    return F.aggregate(values, F.lit(2166136261).cast("long"), lambda h, v: (h.bitwiseXOR(v.cast("long").bitwiseAND(F.lit(255))) * 16777619).bitwiseAND(F.lit(4294967295)))


#: Akshara: a conjunct chain of consonants with its signs, or an independent vowel with its marks, or any one character.
AKSHARA = (
    "[ক-নপ-রলশ-হৎড়ঢ়য়ৰৱ]়?"
    "(?:্[ক-নপ-রলশ-হড়ঢ়য়ৰৱ]়?)*্?[া-ৌৗৢৣ]*[ঁ-ঃ]*"
    "|[অ-ঔৠৡ][ঁ-ঃা-ৌ]*|(?s)."
)


def aksharas(s: Column) -> Column:
    """The text cut into orthographic syllables; what is not Bengali is cut by character."""
    return F.regexp_extract_all(s, F.lit(AKSHARA), 0)


def code_points(raw: Column) -> Column:
    """UTF-8 bytes as an array of code points; of malformed ones each maximal part is U+FFFD."""
    return F.transform(F.regexp_extract_all(F.make_valid_utf8(raw.cast("string")), F.lit("(?s)."), 0), F.ascii)


def run_width(advances: Column) -> Column:
    return F.aggregate(advances, F.lit(0).cast("long"), lambda a, x: a + x)


def clip_prefix(advances: Column, budget: Column, ellipsis: int = 0) -> Column:
    """How many leading glyphs fit the budget; with fewer than all, room for the ellipsis is kept."""
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.size(advances), F.lit(1))), lambda k: run_width(F.slice(advances, 1, k)))
    fit = lambda room: F.size(F.filter(sums, lambda x: x <= room))
    return F.when(F.size(advances) == 0, 0).when(run_width(advances) <= budget, F.size(advances)).otherwise(fit(budget - ellipsis))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def rgb565(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(F.shiftright(r, 3), 11).bitwiseOR(F.shiftleft(F.shiftright(g, 2), 5)).bitwiseOR(F.shiftright(b, 3))


def clamp(v: Column, low: Column | int, high: Column | int) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(v, low), high)


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b)


def round_div(a: Column, b: Column) -> Column:
    """Nearest whole quotient of non-negative numbers, halves up."""
    return F.floor((a + F.floor(b / 2)) / b)


def blend565(under: Column, over: Column, cover: Column) -> Column:
    """Two RGB565 colours mixed by a coverage of 0..15."""
    a = cover * 17
    part = lambda c, shift, most: F.shiftright(c, shift).bitwiseAND(F.lit(most))
    mix = lambda shift, most: F.floor((part(over, shift, most) * a + part(under, shift, most) * (F.lit(255) - a)) / 255).cast("int")
    return F.shiftleft(mix(11, 31), 11).bitwiseOR(F.shiftleft(mix(5, 63), 5)).bitwiseOR(mix(0, 31))
