"""Small text, identity and time functions: names, prompts, exam layouts, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import DEFAULTS

#: Fixed values.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
ALIASES = {"mcqs": "mcq", "quiz": "mcq", "practice": "practice_qsn", "key_points": "keypoints", "key points": "keypoints"}
TASKS = ["mcq", "practice_qsn", "keypoints", "summary"]
KINDS = ["chat", "mcq", "practice_qsn", "keypoints", "summary"]
EXCERPT_MARK = "---SOURCE EXCERPT---"


def email_key(text: Column) -> Column:
    return F.lower(F.trim(text))


def safe_filename(name: Column, most: int = 120) -> Column:
    """A name that may stand in a header: other characters than letters, digits, dot, dash, underscore and space are _."""
    return F.substring(F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"[^A-Za-z0-9._ -]", "_")), F.lit("")), F.lit("document.pdf")), 1, most)


def task_name(text: Column) -> Column:
    """A task by its name or an alias; null for others."""
    key = F.lower(F.trim(text))
    named = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    name = F.coalesce(named[key], key)
    return F.when(name.isin(TASKS), name)


def progress_text(text: Column) -> Column:
    """Progress without its leading mark in brackets and without the number of the attempt."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\[[*!+=]\][ \t]*", ""), r"[ \t]*\(attempt [0-9]+/[0-9]+\)", "")
    return F.trim(bare)


def prefixed(prefix: Column, text: Column) -> Column:
    """An instruction and a text with exactly one space between; no prefix, no space."""
    return F.when(F.trim(F.coalesce(prefix, F.lit(""))) == "", text).otherwise(F.concat(F.rtrim(prefix), F.lit(" "), F.ltrim(text)))


def capped(text: Column, most: int, mark: str = "") -> Column:
    """At most `most` characters, and the mark where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def excerpt(text: Column, section: Column, inherited: Column) -> Column:
    """The excerpt of a drafting prompt: where it belongs, the mark, and the text within its limit."""
    where = F.when(F.coalesce(section, F.lit("")) == "", "The excerpt states no section number.").when(inherited, F.concat(F.lit("The excerpt continues section "), section, F.lit("."))).otherwise(F.concat(F.lit("The excerpt is section "), section, F.lit(".")))
    return F.concat_ws("\n", where, F.lit(EXCERPT_MARK), capped(text, DEFAULTS.source_chars, "\n[excerpt cut]"))


def source_of(prompt: Column) -> Column:
    """What stands behind the last excerpt mark, trimmed; all of it where there is none."""
    cut = F.regexp_replace(F.substring_index(prompt, EXCERPT_MARK, -1), r"^\s+|\s+$", "")
    return F.when(prompt.contains(EXCERPT_MARK), cut).otherwise(prompt)


def exam_layout(items: Column) -> Column:
    """Numbered questions with options A to D and the answer. items: question, options, answer."""
    option = lambda o, i: F.concat(F.substring(F.lit("ABCD"), i + 1, F.lit(1)), F.lit(") "), o)
    one = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x.question, F.lit("\n"), F.array_join(F.transform(x.options, option), "\n"), F.lit("\nAnswer: "), x.answer)
    return F.array_join(F.transform(items, one), "\n\n")


def numbered_points(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n")


def questions_and_answers(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), x.question, F.lit("\nA: "), x.answer)), "\n\n")


def context_block(pages: Column) -> Column:
    """`Page n: text` blocks. pages: page, text, in order."""
    return F.array_join(F.transform(pages, lambda p: F.concat(F.lit("Page "), p.page.cast("string"), F.lit(": "), p.text)), "\n\n")


def revision_block(critique: Column, previous: Column) -> Column:
    """What a second attempt is told; empty without a critique."""
    told = F.concat(F.lit("Your previous attempt was rejected.\nProblem: "), critique)
    again = F.when(F.coalesce(previous, F.lit("")) != "", F.concat(F.lit("\nPrevious attempt:\n"), F.substring(previous, 1, 2000))).otherwise("")
    return F.when(F.coalesce(critique, F.lit("")) == "", "").otherwise(F.concat(told, again))


def kinds_of(kinds: Column) -> Column:
    """Known kinds, once each, in their fixed order."""
    return F.array_intersect(F.array(*map(F.lit, KINDS)), F.coalesce(kinds, F.array().cast("array<string>")))


def kinds_sentence(kinds: Column) -> Column:
    return F.array_join(kinds, " and ")


def message_role(role: Column) -> Column:
    """Roles of a chat backend: human and unknown are user, ai is assistant, system stays."""
    return F.when(role.isin("ai", "assistant"), "assistant").when(role == "system", "system").otherwise("user")


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Name-based UUID: SHA-1 of namespace and name, with the version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(part(17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def point_id(doc: Column, page: Column, index: Column) -> Column:
    """Stable id of a chunk; missing parts of the key are 0."""
    own = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    return uuid5(F.concat_ws(":", doc.cast("string"), own(page), own(index)))


def object_id(text: Column) -> Column:
    """24 hexadecimal digits, else null."""
    return F.when(text.rlike("^[0-9a-fA-F]{24}$"), text)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds to two places, halves away from the start; from whole microseconds, so that no binary fraction decides."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor((micros + 5000) / 10000) / 100


def power_of_two_at_least(n: Column, low: int = 256, high: int = 4096) -> Column:
    """The next power of two within the bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(1))))).cast("int")))


def unwrapped(reply: Column, key: str) -> Column:
    """Items (arrays of strings) of an envelope {key: [...]}, or of a bare list, else none."""
    data = F.try_parse_json(reply)
    inside = F.try_variant_get(data, f"$.{key}", "array<string>")
    return F.coalesce(inside, F.try_variant_get(data, "$", "array<string>"), F.array().cast("array<string>"))


def points_of(reply: Column) -> Column:
    """Key points of a reply: a JSON list of strings, else its lines without bullets and numbers."""
    own = F.transform(F.split(reply, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[ \t]*(?:[-*\x{2022}]|[0-9]+[.)])?[ \t]*", "")))
    return F.coalesce(F.try_variant_get(F.try_parse_json(reply), "$", "array<string>"), F.filter(own, lambda x: x != ""))
