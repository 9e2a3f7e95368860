"""What each kind of study resource is: how it is asked for, taken out of a reply, checked and shown."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import render as rd
from quarry.functions import verdicts as vd

ITEM = "array<struct<question:string,options:array<string>,answer:string>>"


@dataclass(frozen=True)
class Task:
    """A contract: every function is of columns, so a task runs over a table of replies as one projection."""

    name: str
    ask: Callable[[Column, Column], Column]  # source and count to prompt
    unwrap: Callable[[Column], Column]  # reply to content; never null
    faults: Callable[[Column], Column]  # content to an array of strings
    render: Callable[[Column], Column]  # content to text
    count_label: str = "items"


def questions(reply: Column) -> Column:
    """Items of an envelope {"questions": [...]} or of a bare list; anything else is none."""
    data = F.try_parse_json(reply)
    return F.coalesce(F.try_variant_get(data, "$.questions", ITEM), F.try_variant_get(data, "$", ITEM), F.array().cast(ITEM))


def asked_for(what: str) -> Callable[[Column, Column], Column]:
    return lambda source, count: F.concat(F.lit(f"Write {what}, "), count.cast("string"), F.lit(" of them, from this text alone.\n\n"), rd.capped(source, 6000, "\n[excerpt cut]"))


def item_faults(items: Column) -> Column:
    told = F.transform(items, lambda x, i: F.transform(vd.mcq_faults(x.question, x.options, x.answer), lambda f: F.concat((i + 1).cast("string"), F.lit(": "), f)))
    return F.when(F.size(items) == 0, F.array(F.lit("no questions"))).otherwise(F.flatten(told))


TASKS = {
    t.name: t
    for t in (
        Task("mcq", asked_for("multiple-choice questions"), questions, item_faults, rd.exam_layout, "questions"),
        Task("practice_qsn", asked_for("short-answer questions"), questions, vd.practice_faults, rd.questions_and_answers, "questions"),
        Task("keypoints", asked_for("key points"), lambda reply: F.coalesce(rd.unwrapped(reply, "points"), rd.points_of(reply)), vd.keypoint_faults, rd.numbered_points, "points"),
        Task("summary", asked_for("sentences that sum up"), lambda reply: F.trim(F.coalesce(reply, F.lit(""))), vd.summary_faults, lambda text: text, "sentences"),
    )
}


def handled(replies: DataFrame, task: str, keep: tuple[str, ...]) -> DataFrame:
    """keep columns, text and faults of replies (a column `reply`) to one task. An unknown task is an error."""
    if (own := TASKS.get(task)) is None:
        raise ValueError(f"unknown task {task}; known are {', '.join(sorted(TASKS))}")
    made = replies.select(*keep, own.unwrap(F.col("reply")).alias("__content"))
    return made.select(*keep, own.render(F.col("__content")).alias("text"), own.faults(F.col("__content")).alias("faults"))
