"""Citations of legal provisions: what an answer cites, what an excerpt supports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import DEFAULTS

#: Fixed values. A citation in an answer counts only behind the label of a provision. An excerpt supports a number behind
#: such a label, at the start of a line before a full stop, before a full stop and an opening bracket, or with letters.
CITED = r"\b(?:section|sections|sec\.|s\.|article|articles|art\.|chapter|part|rule|order)[\t-\r ]+([0-9]{1,3}[a-z]{0,2})"
SUPPORTED = (
    CITED,
    r"(?:^|\n)[\t-\r ]*([0-9]{1,3}[a-z]{0,2})[\t-\r ]*\.",
    r"([0-9]{1,3}[a-z]{0,2})[\t-\r ]*\.[\t-\r ]*\([0-9a-z]",
    r"\b([0-9]{1,3}[a-z]{1,2})\b",
)


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(1))


def cited(answer: Column) -> Column:
    """Numbers that an answer cites, distinct and sorted."""
    return F.array_sort(F.array_distinct(found(answer, CITED)))


def supported(excerpt: Column) -> Column:
    """Numbers that an excerpt supports, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.concat(*[found(excerpt, p) for p in SUPPORTED])))


def unsupported(answer_cites: Column, excerpt_supports: Column, allow: Column | None = None) -> Column:
    """Cited numbers without support, sorted; `allow` is the section that the excerpt continues."""
    own = F.array().cast("array<string>") if allow is None else F.array_compact(F.array(F.lower(F.nullif(allow, F.lit("")))))
    return F.array_sort(F.array_except(answer_cites, F.array_union(excerpt_supports, own)))


def reject_reason(answer: Column, missing: Column, least: int = DEFAULTS.min_answer_chars) -> Column:
    """Why a pair is rejected; null if it isn't."""
    short = F.length(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^[\t-\r ]+|[\t-\r ]+$", "")) < least
    return F.when(short, "answer too short").when(F.size(missing) > 0, F.concat(F.lit("cites "), F.array_join(missing, ","), F.lit(" not in excerpt")))
