"""Text functions on columns. Expressions use ASCII classes, so that every SQL engine reads them alike."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import DEFAULTS

WS = r"[ \t\r\n]+"


def squeeze(text: Column) -> Column:
    """White space runs to one space, and none at the ends."""
    return F.trim(F.regexp_replace(text, WS, " "))


def comparison_key(text: Column) -> Column:
    """Key under which answers are compared: squeezed, without punctuation at both ends, lower case; null is empty."""
    return F.lower(F.btrim(squeeze(F.coalesce(text, F.lit(""))), F.lit(".?!,;:")))


def slug(text: Column, limit: int = 40) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.substring(F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled")), 1, limit)


#: White space of page text, and glyphs that become plain characters.
PAGE_WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{2028}\x{2029}]"
GLYPHS = {
    "\u201c": '"', "\u201d": '"', "\u2018": "'", "\u2019": "'", "\u2013": "-", "\u2014": "-", "\u2022": "-", "\u25cf": "-",
    "\u2713": "-", "\u2714": "-", "\u00a0": " ", "\ufb01": "fi", "\ufb02": "fl",
}


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Unicode normalisation, which Spark lacks, over Arrow batches (Arrow's own leaves combining marks apart)."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def clean_page(text: Column) -> Column:
    """Page cleaning after Unicode normalisation: glyphs, lone page numbers, words broken over lines, bullets, line ends
    and white space, in this order."""
    single = {k: v for k, v in GLYPHS.items() if len(v) == 1}
    t = F.translate(text, "".join(single), "".join(single.values()))
    for glyph in GLYPHS.keys() - single.keys():
        t = F.replace(t, F.lit(glyph), F.lit(GLYPHS[glyph]))
    s = PAGE_WS
    t = F.regexp_replace(t, rf"(?dm)^{s}*\p{{Nd}}{{1,4}}{s}*$", "")
    t = F.regexp_replace(t, rf"([A-Za-z])-{s}*\n{s}*([a-z])", "$1$2")
    t = F.regexp_replace(t, rf"([a-zA-Z]){s}*\n{s}*-{s}*([a-zA-Z]+)", "$1$2")  # the last letter of the word before is enough
    t = F.regexp_replace(t, r"(?:^|\n)[ \t]*[-*][ \t]+", " ")
    return F.trim(F.regexp_replace(t, f"{s}+", " "))


def clean_lines(text: Column) -> Column:
    """Older cleaner: trimmed lines without page numbers, joined by a space."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^[- \t]*[0-9]{1,4}[- \t]*$"))
    return F.regexp_replace(F.array_join(kept, " "), "[ \t]{2,}", " ")


def alphanumerics(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def is_substantive(text: Column, least: int = DEFAULTS.min_chunk_chars) -> Column:
    return alphanumerics(text) >= least


def leaders(text: Column) -> Column:
    """Runs of three or more dots that lead to a page number."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?:\.[ \t\r\n]*){3,}"), F.lit(0)))


def is_contents(text: Column, least: int) -> Column:
    return leaders(text) >= least


def is_toc(text: Column) -> Column:
    """Three lines or more, of which 3 in 10 have spaced leaders or 7 in 10 are short and end in a number."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    led = F.size(F.filter(lines, lambda x: x.rlike(r"\. ?\. ?\.")))
    ended = F.size(F.filter(lines, lambda x: (F.length(x) < 90) & x.rlike(r"[ \t][0-9]{1,4}[ \t]*$")))
    n = F.size(lines)
    return (n >= 3) & ((led * 10 >= n * 3) | (ended * 10 >= n * 7))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def answer_letter(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(text), r"\b([ABCD])\b", 1), F.lit(""))


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10)


def bucket_of(word: Column, buckets: int = DEFAULTS.sparse_buckets) -> Column:
    """md5 of the word as a 128-bit number, modulo the buckets, by four 32-bit limbs."""
    digest, rest = F.md5(word), F.lit(0).cast("bigint")
    for k in range(4):
        limb = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")
        rest = (rest * F.lit(2**32) + limb) % buckets
    return rest


def token_f1(said: Column, gold: Column) -> Column:
    """F1 of two token bags: 1 if both are empty, 0 if one is. One pass over each bag: a token's nth occurrence gets n
    behind it, so that the common part of the bags is that of two sets."""
    common = F.size(F.array_intersect(occurrences(said), occurrences(gold)))
    score = F.when(common == 0, 0.0).otherwise(2.0 * common / (F.size(said) + F.size(gold)))
    return F.when((F.size(said) == 0) & (F.size(gold) == 0), 1.0).otherwise(score)


def occurrences(tokens: Column) -> Column:
    """Sorted tokens (without spaces), the nth of equal ones with n behind it; each run of equal ones is found as a whole."""
    runs = F.regexp_extract_all(F.concat(F.array_join(F.array_sort(tokens), " "), F.lit(" ")), F.lit(r"(\S+ )\1*"), F.lit(0))
    return F.flatten(F.transform(runs, lambda run: F.transform(F.split(F.rtrim(run), " "), lambda w, i: F.concat(w, F.lit(" "), i.cast("string")))))


def rule_label(name: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose pattern the name matches."""
    chain = None
    for pattern, label in rules:
        hit = F.lower(name).rlike(pattern)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return F.lit(default) if chain is None else chain.otherwise(default)


def parse_reply(text: Column, schema: str) -> Column:
    """Tolerant JSON: the text, without its code fence, or its widest part in brackets."""
    bare = F.regexp_replace(F.trim(text), r"^```[a-z]*[ \t\r\n]*|[ \t\r\n]*```$", "")
    inner = F.regexp_extract(bare, r"(?s)[\[{].*[\]}]", 0)
    return F.coalesce(F.when(bare.rlike(r"^[\[{]"), F.from_json(bare, schema)), F.from_json(inner, schema))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def parse_object(text: Column, schema: str) -> Column:
    """Tolerant JSON of an object; null for lists, other values and what can't be read."""

    def read(bare: Column) -> Column:
        inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
        whole = F.when(F.try_parse_json(bare).isNotNull(), F.when(bare.startswith("{"), bare).otherwise(""))
        part = bound(inner, lambda x: F.when(F.try_parse_json(x).isNotNull(), x))
        return F.from_json(F.nullif(F.coalesce(whole, part), F.lit("")), schema)

    bare = F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return bound(F.regexp_replace(bare, r"^```[A-Za-z]*[ \t\r\n]*|[ \t\r\n]*```$", ""), read)


def clamp_score(value: Column, low: int = 1, high: int = 100) -> Column:
    """Whole score between the bounds, cut toward zero; what isn't a number is the lowest."""
    number = F.coalesce(F.nanvl(value.try_cast("double"), F.lit(float(low))), F.lit(float(low)))
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), number)).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-60.0)), F.lit(60.0))))
