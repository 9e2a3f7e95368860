"""Checks of generated items, verdicts on them, and what happens next. All are columns; reasons are arrays of faults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions import text as tx

VERDICT = "score string, reasoning string, regeneration_instruction string"
#: Fixed values.
META_OPTION = r"(?i)\b(all|none|both)\s+of\s+the\s+(above|these|following)\b"
BARE_VERB = r"(?i)^(remove|rewrite|add|replace|revise|correct|fix)?[\s.\x{2026}]*$"
NO_VERDICT = "failed to return a verdict"
NO_INSTRUCTION = "Regenerate the content; the evaluator returned no usable instruction."
UNREADABLE = "Regenerate the content; the evaluator returned an unreadable verdict."
RUBRICS = {"mcq": "mcq", "practice_qsn": "practice_qsn", "keypoints": "keypoints", "summary": "summary"}


def stripped(text: Column) -> Column:
    """Without white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$", "")


def faults(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def mcq_faults(question: Column, options: Column, answer: Column) -> Column:
    """Faults of an item; without exactly four options only these and an empty question are told."""
    keys = F.transform(F.coalesce(options, F.array().cast("array<string>")), tx.comparison_key)
    n = F.size(keys)
    empty = F.when(stripped(question) == "", "empty question")
    rest = faults(
        empty,
        F.when(F.exists(keys, lambda k: k == ""), "blank option"),
        F.when(F.size(F.array_distinct(keys)) < n, "duplicate options"),
        F.when(~F.array_contains(keys, tx.comparison_key(answer)), "answer not an option"),
        F.when(F.exists(options, lambda o: F.coalesce(o.rlike(META_OPTION), F.lit(False))), "option about the others"),
    )
    return F.when(n != 4, faults(empty, F.concat(n.cast("string"), F.lit(" options")))).otherwise(rest)


def practice_faults(items: Column) -> Column:
    """Faults of short-answer questions (question, answer)."""
    def one(x: Column) -> Column:
        q, a = stripped(x.question), stripped(x.answer)
        name = F.concat(F.lit("question "), F.substring(q, 1, 40))
        told = F.when(a == "", F.concat(name, F.lit(" has an empty answer"))).when(tx.comparison_key(a) == tx.comparison_key(q), F.concat(name, F.lit(" is restated by its answer")))
        return faults(F.when(q == "", "empty question"), told)

    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.array(F.lit("no questions"))).otherwise(F.flatten(F.transform(items, one)))


def keypoint_faults(points: Column, least: int = 2) -> Column:
    own = F.transform(points, stripped)
    keys = F.transform(own, tx.comparison_key)
    told = faults(
        F.when(F.size(own) < least, F.concat(F.lit("only "), F.size(own).cast("string"), F.lit(" key point(s)"))),
        F.when(F.exists(own, lambda p: p == ""), "empty key point"), F.when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate key points"),
    )
    return F.when(F.coalesce(F.size(points), F.lit(0)) <= 0, F.array(F.lit("no key points"))).otherwise(told)


def summary_faults(text: Column, least: int = 80) -> Column:
    n = F.length(stripped(text))
    return faults(F.when(n == 0, "empty summary").when(n < least, F.concat(F.lit("only "), n.cast("string"), F.lit(" characters"))))


#: Structural checks by task: of a struct content with items (question, answer), points and text.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "practice_qsn": lambda content: practice_faults(content["items"]),
    "keypoints": lambda content: keypoint_faults(content["points"]),
    "summary": lambda content: summary_faults(content["text"]),
}


def task_faults(task: Column, content: Column) -> Column:
    """Faults by the task's check; an unknown task has none."""
    chain = None
    for name, check in CHECKS.items():
        chain = F.when(task == name, check(content)) if chain is None else chain.when(task == name, check(content))
    return chain.otherwise(F.array().cast("array<string>"))


def usable_instruction(instruction: Column, reasoning: Column) -> Column:
    """An instruction that names a fault, else the reasoning as one, else a fixed sentence."""
    own, why = stripped(instruction), stripped(reasoning)
    fallback = F.when(why != "", F.concat(F.lit("Fix exactly this problem and change nothing else: "), why)).otherwise(NO_INSTRUCTION)
    return F.when((F.length(own) >= 20) & ~own.rlike(BARE_VERB), own).otherwise(fallback)


def parse_verdict(reply: Column) -> Column:
    """struct(score, reasoning, regeneration_instruction) of a judge's reply; whatever isn't an object scores 1."""

    def read(data: Column) -> Column:
        return tx.bound(stripped(data["reasoning"]), lambda why: F.struct(tx.clamp_score(data["score"]).alias("score"), why.alias("reasoning"), usable_instruction(data["regeneration_instruction"], why).alias("regeneration_instruction")))

    unread = F.struct(F.lit(1).alias("score"), F.concat(F.lit("Could not parse evaluator output: "), F.substring(stripped(reply), 1, 200)).alias("reasoning"), F.lit(UNREADABLE).alias("regeneration_instruction"))
    return tx.bound(tx.parse_object(reply, VERDICT), lambda data: F.when(data.isNull(), unread).otherwise(read(data)))


def verdict(task: Column, score: Column, passed: Column, reasoning: Column, instruction: Column, threshold: Column, gated: Column) -> Column:
    return F.struct(task.alias("task"), score.cast("int").alias("score"), passed.alias("passed"), reasoning.alias("reasoning"), instruction.alias("regeneration_instruction"), threshold.cast("int").alias("threshold"), gated.alias("gated"))


def failed_verdict(task: Column, threshold: Column, reasoning: Column, instruction: Column) -> Column:
    return verdict(task, F.lit(1), F.lit(False), reasoning, instruction, threshold, F.lit(False))


def gated_verdict(task: Column, threshold: Column, reasoning: Column) -> Column:
    """Passed without a score, which statistics over scores then leave out."""
    return verdict(task, F.lit(None), F.lit(True), reasoning, F.lit(""), threshold, F.lit(True))


def is_gated(mode: Column, reply: Column, modes: tuple[str, ...] = DEFAULTS.gated_modes) -> Column:
    """Whether the judge is skipped: the mode is one of the gated ones and the reply isn't blank."""
    return F.coalesce(F.lower(mode).isin(*modes), F.lit(False)) & (stripped(reply) != "")


def judged(task: Column, mode: Column, reply: Column, answer: Column, threshold: Column) -> Column:
    """Verdict on a reply: gated, failed for an empty reply, else what the judge's answer says."""

    def scored(parsed: Column) -> Column:
        passed = parsed["score"] >= threshold
        return verdict(task, parsed["score"], passed, parsed["reasoning"], F.when(passed, "").otherwise(parsed["regeneration_instruction"]), threshold, F.lit(False))

    skipped = gated_verdict(task, threshold, F.concat(F.lit("Not scored: answered from general knowledge (mode="), F.lower(mode), F.lit(")")))
    empty = failed_verdict(task, threshold, F.lit("empty reply"), F.lit("Write a reply."))
    return F.when(is_gated(mode, reply), skipped).when(stripped(reply) == "", empty).otherwise(tx.bound(parse_verdict(answer), scored))


def stage(unparsed: Column, reasons: Column, evaluate: Column) -> Column:
    """Which gate decides an attempt: parse, validator, skipped or judge."""
    return F.when(unparsed, "parse").when(F.size(reasons) > 0, "validator").when(~evaluate, "skipped").otherwise("judge")


def chat_route(passed: Column, attempt: Column, score: Column, threshold: Column, critique: Column, most: int = DEFAULTS.max_attempts, margin: int = DEFAULTS.hopeless_margin) -> Column:
    """`persist` when passed, out of budget, without a usable critique or far below the threshold; else `generate`."""
    critique = F.coalesce(critique, F.lit(""))
    hopeless = F.coalesce(score, F.lit(0)) < F.coalesce(threshold, F.lit(DEFAULTS.judge_threshold)) - margin
    return F.when(F.coalesce(passed, F.lit(False)) | (attempt >= most) | (critique == "") | critique.contains(NO_VERDICT) | hopeless, "persist").otherwise("generate")


def resource_route(passed: Column, attempt: Column, most: int = DEFAULTS.max_attempts) -> Column:
    return F.when(F.coalesce(passed, F.lit(False)) | (attempt >= most), "persist").otherwise("generate")


def rubric(task: Column, grounded: Column) -> Column:
    """Name of the rubric that a task is judged by."""
    named = F.create_map(*[F.lit(x) for pair in RUBRICS.items() for x in pair])
    return F.when(task == "chat_msg", F.when(grounded, "chat_grounded").otherwise("chat_general")).otherwise(F.coalesce(named[task], F.lit("generic")))
