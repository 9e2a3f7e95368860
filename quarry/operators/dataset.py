"""Training pairs, leakage-safe splits, item checks, metrics and gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions import citations as ct
from quarry.functions import text as tx
from quarry.operators import logs

SPLITS = ["train", "val", "test"]
#: Classes of units (a subject and a size) that may be broadcast.
BROADCAST_CLASSES = 500_000


#: What template pairs ask and answer, by type, with %subject%, %heading% and %snippet% to be filled in.
TEMPLATES = {
    "qa": ("[%subject%] Based on %heading%, what does the provision establish?", "According to the source text (%heading%): %snippet%"),
    "summary": ("Summarise the following legal text for a law student.", "Subject area: %subject%. Heading: %heading%. Key content: %snippet%"),
    "mcq": (
        "[%subject%] Which statement best reflects %heading%?\nA. The provision is unrelated to %subject%.\nB. The provision addresses the matter described in the source excerpt.\n"
        "C. The provision abolishes all prior law without exception.\nD. The provision applies only outside Sri Lanka.",
        "Correct answer: B. Justification grounded in source (%heading%): %snippet%",
    ),
}


def draft_pairs(chunks: DataFrame, types: list[str], per_chunk: int, snippet: int = DEFAULTS.snippet_chars) -> DataFrame:
    """pair_id, chunk_id, pair_type, n, instruction, output: `per_chunk` template pairs of each chunk over the types in turn.
    chunks: chunk_id, subject_area, section_heading, chapter, text. Types without a template use the last one."""
    each = chunks.select("*", F.explode(F.sequence(F.lit(0), F.lit(per_chunk - 1))).alias("n"))
    kind = F.get(F.array(*map(F.lit, types)), F.pmod("n", F.lit(len(types))))
    empty = F.lit("")
    named = each.withColumns({
        "pair_type": kind, "__heading": F.coalesce(F.nullif("section_heading", empty), F.nullif("chapter", empty), F.lit("the excerpt")),
        "__snippet": F.concat(F.replace(F.substring("text", 1, snippet), F.lit("\n"), F.lit(" ")), F.when(F.length("text") > snippet, "...").otherwise("")),
    })

    def filled(part: int) -> Column:
        chain = F.lit(TEMPLATES["mcq"][part])
        for name in ("qa", "summary"):
            chain = F.when(F.col("pair_type") == name, TEMPLATES[name][part]).otherwise(chain)
        for mark, value in (("%subject%", "subject_area"), ("%heading%", "__heading"), ("%snippet%", "__snippet")):
            chain = F.replace(chain, F.lit(mark), F.col(value))
        return chain

    chunk, n = F.col("chunk_id").cast("string"), F.col("n").cast("string")
    pair_id = F.concat_ws("-", chunk, "pair_type", n, tx.stable_id(chunk, F.col("pair_type"), n))
    return named.select(pair_id.alias("pair_id"), "chunk_id", "pair_type", "n", filled(0).alias("instruction"), filled(1).alias("output"))


def check_pairs(pairs: DataFrame, excerpts: DataFrame, key: str) -> DataFrame:
    """pairs (key, output, section_id) with unsupported (sorted numbers, joined) and reason (null: accepted).

    Texts stay where they are: only the numbers that each excerpt (key, text) supports are moved to its pairs.
    """
    held = excerpts.select(key, ct.supported(F.col("text")).alias("held"))
    own = pairs.withColumn("cites", ct.cited(F.col("output"))).withColumn("short", ct.reject_reason(F.col("output"), F.array()).isNotNull())
    rest = [c for c in pairs.columns if c not in (key, "output", "section_id")]
    joined = own.select(key, *rest, "section_id", "cites", "short").join(held, key, "left")
    missing = ct.unsupported(F.col("cites"), F.coalesce("held", F.array().cast("array<string>")), F.col("section_id"))
    reason = F.when(F.col("short"), "answer too short").when(F.size("missing") > 0, F.concat(F.lit("cites "), F.array_join("missing", ","), F.lit(" not in excerpt")))
    return joined.withColumn("missing", missing).select(key, *rest, F.array_join("missing", ",").alias("unsupported"), reason.alias("reason"))


def to_sft(turns: DataFrame) -> DataFrame:
    """conv_id, messages: array of (role, content) in turn order; the list is partly collected before the shuffle."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m.role.alias("role"), m.text.alias("content"))).alias("messages"))


def appended(left: Column, right: Column) -> Column:
    """Both lists as one; a missing list is empty. Works on columns of arrays of one type."""
    return F.concat(F.coalesce(left, F.slice(right, 1, 0), F.array().cast("array<bigint>")), F.coalesce(right, F.slice(left, 1, 0), F.array().cast("array<bigint>")))


def unit_key(doc: Column, chapter: Column, part: Column) -> Column:
    """doc::label of the chapter, else the part, else `_nogroup`; an empty label is none."""
    empty = F.lit("")
    return F.concat_ws("::", doc, F.coalesce(F.nullif(chapter, empty), F.nullif(part, empty), F.lit("_nogroup")))


def parted(rows: DataFrame, chosen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is chosen, and the rest; every row is in one of them (null keys in the rest)."""
    return rows.join(chosen.select(key), key, "left_semi"), rows.join(chosen.select(key), key, "left_anti")


def strict_holdout(pairs: DataFrame, least_docs: int = DEFAULTS.holdout_min_docs, least_units: int = DEFAULTS.holdout_min_units) -> DataFrame:
    """subject, doc_id, n: of each subject with enough documents the one with fewest pairs, if enough units remain without it.
    pairs: subject, doc, unit."""
    docs = pairs.groupBy("subject", "doc").agg(F.count(F.lit(1)).alias("n"))
    enough = docs.groupBy("subject").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("n", "doc")).alias("pick")).filter(F.col("docs") >= least_docs)
    picks = enough.select("subject", F.col("pick.doc").alias("doc"), F.col("pick.n").alias("n"))
    left = pairs.join(picks.select("subject", "doc"), ["subject", "doc"], "left_anti").groupBy("subject").agg(F.count_distinct("unit").alias("units_left"))
    return picks.join(left, "subject", "left").select("subject", "doc", "n", F.coalesce("units_left", F.lit(0)).alias("units_left"), (F.coalesce("units_left", F.lit(0)) >= least_units).alias("held"))


def crosstab(rows: DataFrame, subject: str = "subject", split: str = "split", doc: str = "doc") -> DataFrame:
    """subject, pairs and documents of each split (0 where none), and missing_in."""
    aggs = []
    for s in SPLITS:
        aggs += [F.count(F.when(F.col(split) == s, 1)).alias(f"pairs_{s}"), F.count_distinct(F.when(F.col(split) == s, F.col(doc))).alias(f"docs_{s}")]
    missing = F.concat_ws("|", *[F.when(F.col(f"pairs_{s}") == 0, s) for s in SPLITS])
    return rows.groupBy(subject).agg(*aggs).withColumn("missing_in", missing)


def leaks(rows: DataFrame, unit: str, split: str = "split") -> DataFrame:
    """Units in more than one split; must be empty."""
    return rows.groupBy(unit).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def after(quota: list[float], held: list[int], n: int, handed: np.ndarray) -> np.ndarray:
    """How many of the first `handed` units of size n each split gets, when every unit goes to the split furthest below its
    quota (the first of equal ones) and splits hold `held` before.

    The first so many units are those above some level among the falling rows quota - held - j n of all splits. A level
    that lies two sizes higher gives all but a few of them at once; those few are handed out one by one.
    """
    below = np.array([q - h for q, h in zip(quota, held, strict=True)])
    if not n:  # units without rows change nothing: all go to one split
        return (np.arange(len(quota)) == below.argmax()) * np.asarray(handed)[:, None]
    falling = np.sort(below)[::-1]
    level = falling[0] - handed * float(n)
    for m in range(2, len(quota) + 1):
        level = np.where(level < falling[m - 1], (falling[:m].sum() - handed * float(n)) / m, level)
    got = np.maximum(np.ceil((below[None, :] - level[:, None]) / n) - 2, 0).astype(np.int64)
    while len(short := np.flatnonzero(got.sum(axis=1) < handed)):
        got[short, choice(quota, held, n, got[short])] += 1
    return got


def choice(quota: list[float], held: list[int], n: int, got: np.ndarray) -> np.ndarray:
    """The split that the next unit goes to, after each split got so many units of size n."""
    return (np.array(quota)[None, :] - (np.array(held)[None, :] + got * n)).argmax(axis=1)


def class_plan(sizes: list[tuple[int, int]], ratios: tuple[float, ...]) -> tuple[list[float], list[list[int]], list[tuple[int, int, int]]]:
    """Of classes (size of unit, units), the largest size first: the quotas, what each split holds before each class, and
    moves (class, place in it, split): where there are as many units as splits, a split without any gets the smallest unit of
    the split that is furthest above its quota and has more than one, one after another."""
    quota = [sum(n * c for n, c in sizes) * r for r in ratios]
    held, counts, before, got = [0] * len(ratios), [0] * len(ratios), [], []
    for n, c in sizes:
        before.append(held.copy())
        own = after(quota, held, n, np.array([c]))[0].tolist()
        got.append(own)
        held = [h + k * n for h, k in zip(held, own, strict=True)]
        counts = [x + k for x, k in zip(counts, own, strict=True)]
    moves: list[tuple[int, int, int]] = []
    for empty in range(len(ratios)):
        if counts[empty] or sum(c for _, c in sizes) < len(ratios):
            continue
        givers = [i for i in range(len(ratios)) if counts[i] > 1]
        if not givers:
            continue
        giver = max(givers, key=lambda i: (held[i] - quota[i], -i))
        of = max(k for k, own in enumerate(got) if own[giver])
        # The place of the giver's first unit in that class that it still has.
        gone = sum(1 for k, place, _ in moves if k == of and choice(quota, before[of], sizes[of][0], after(quota, before[of], sizes[of][0], np.array([place])))[0] == giver)
        low, high = 0, sizes[of][1] - 1
        while low < high:
            mid = (low + high) // 2
            if after(quota, before[of], sizes[of][0], np.array([mid + 1]))[0][giver] > gone:
                high = mid
            else:
                low = mid + 1
        moves.append((of, low, empty))
        got[of][giver] -= 1
        for split, sign in ((giver, -1), (empty, 1)):
            held[split] += sign * sizes[of][0]
            counts[split] += sign
    return quota, before, moves


def stratified_assign(units: DataFrame, ratios: tuple[float, ...] = (0.70, 0.15, 0.15)) -> DataFrame:
    """subject, unit, split: each subject's units, largest first (ties by a hash), go to the split furthest under its quota.
    units: subject, unit (once), n.

    Units of one size are a class with a count. A subject's classes, no more than there are sizes, are followed in order;
    what each split holds before a class tells in closed form where the unit at any place of it goes. Places come from a
    numbering by range, so that no task holds all units of a subject.
    """
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must add up to 1")
    kinds = {c: units.schema[c].dataType.simpleString() for c in ("subject", "unit")}
    placed = logs.numbered(units.select("subject", "unit", F.col("n").cast("bigint").alias("n"), (-F.col("n")).cast("bigint").alias("__n"), F.xxhash64("unit").alias("__tie")), "subject", "__n", "__tie", "unit")
    classes = placed.groupBy("subject", "n").agg(F.count(F.lit(1)).alias("c"), F.min("number").alias("first"))

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n", ascending=False)
        quota, before, moves = class_plan(list(zip(frame.n.tolist(), frame.c.tolist(), strict=True)), ratios)
        rows = [(s, n, first, quota, held, [p for k, p, _ in moves if k == i], [x for k, _, x in moves if k == i]) for i, (s, n, first, held) in enumerate(zip(frame.subject, frame.n, frame["first"], before, strict=True))]
        return pd.DataFrame(rows, columns=["subject", "n", "first", "quota", "held", "moved", "to"])

    plans = classes.groupBy("subject").applyInPandas(plan, f"subject {kinds['subject']}, n bigint, first bigint, quota array<double>, held array<bigint>, moved array<bigint>, to array<bigint>")
    plans = plans.withColumnsRenamed({"subject": "__subject", "n": "__size"})
    plans = F.broadcast(plans) if classes.count() <= BROADCAST_CLASSES else plans

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frame = b.select(["number", "n", "first", "quota", "held", "moved", "to"]).to_pandas()
            out = np.empty(len(frame), object)
            for (first, n), own in frame.groupby(["first", "n"]):
                head = own.iloc[0]
                quota, held, places = list(head.quota), list(head.held), (own.number - first).to_numpy()
                got = choice(quota, held, int(n), after(quota, held, int(n), places))
                for place, split in zip(head.moved, head.to, strict=True):
                    got[places == place] = split
                out[own.index] = [SPLITS[i] for i in got]
            yield pa.RecordBatch.from_arrays([b.column("subject"), b.column("unit"), pa.array(out.tolist(), pa.string())], names=["subject", "unit", "split"])

    met = placed.join(plans, F.col("subject").eqNullSafe(F.col("__subject")) & (F.col("n") == F.col("__size")))
    return met.mapInArrow(give, f"subject {kinds['subject']}, unit {kinds['unit']}, split string")


def document_split(docs: DataFrame, ratios: tuple[float, ...] = (0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """doc, subject, split: whole documents, by a seeded hash. test and then val take their share (at least one document
    where there are three), one of each subject first, the rest go to train. docs: doc, subject, each document once."""
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must add up to 1")
    n = docs.count()
    take = {s: max(1, round(n * r)) if n >= 3 else int(n >= 2 and s == "test") for s, r in (("val", ratios[1]), ("test", ratios[2]))}
    if n >= 2 and sum(take.values()) >= n:
        take = {"val": int(n >= 3), "test": 1}
    order = lambda c: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(c).cast("string")))
    left, parts = docs.select("doc", "subject"), []
    for split in ("test", "val"):
        first = left.groupBy("subject").agg(F.min(F.struct(order("doc").alias("h"), "doc"))["doc"].alias("first"))
        ranked = left.join(first, "subject").select("doc", "subject", (F.col("doc") != F.col("first")).alias("later"), F.when(F.col("doc") == F.col("first"), order("subject")).otherwise(order("doc")).alias("h"))
        placed = logs.numbered(ranked, "later", "h", "doc")
        parts.append(placed.filter(F.col("number") <= take[split]).select("doc", "subject", F.lit(split).alias("split")))
        left = placed.filter(F.col("number") > take[split]).select("doc", "subject")
    return parts[0].unionByName(parts[1]).unionByName(left.withColumn("split", F.lit("train")))


def answer_slot(options: Column, answer: Column) -> Column:
    """Place of the answer among the options, from 1; 0 if none."""
    return F.array_position(F.transform(options, tx.comparison_key), tx.comparison_key(answer))


def answer_is_longest(options: Column, answer: Column) -> Column:
    """Whether the first longest option is the answer."""
    longest = F.array_max(F.transform(options, lambda o, i: F.struct(F.length(o).alias("n"), (-i).alias("i"), o.alias("o"))))
    return tx.comparison_key(longest.o) == tx.comparison_key(answer)


def set_bias(items: DataFrame) -> DataFrame:
    """set_id, n, one_slot, always_longest, duplicate_stems. items: set_id, stem, options, answer."""
    own = items.select("set_id", tx.comparison_key(F.col("stem")).alias("stem"), answer_slot(F.col("options"), F.col("answer")).alias("slot"), answer_is_longest(F.col("options"), F.col("answer")).alias("longest"))
    some = F.when(F.col("slot") > 0, F.col("slot"))
    g = own.groupBy("set_id").agg(F.count(some).alias("n"), F.count_distinct(some).alias("slots"), F.bool_and("longest").alias("all_longest"), F.count(F.lit(1)).alias("items"), F.count_distinct("stem").alias("stems"))
    return g.select("set_id", "n", ((F.col("n") >= 4) & (F.col("slots") == 1)).alias("one_slot"), ((F.col("n") >= 4) & F.col("all_longest")).alias("always_longest"), (F.col("stems") < F.col("items")).alias("duplicate_stems"))


def metrics(rows: DataFrame) -> DataFrame:
    """group, n, accuracy, hallucination_rate, groundedness. rows: group, correct, hallucinated."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.round(rate("correct"), 4).alias("accuracy"), F.round(rate("hallucinated"), 4).alias("hallucination_rate"), F.round(1 - rate("hallucinated"), 4).alias("groundedness"))


def gate(measured: DataFrame, fallback: DataFrame, s=DEFAULTS) -> DataFrame:
    """measured (group, n, accuracy, groundedness, hallucination_rate, latency_p95) with violations (joined by ;) and promote.

    fallback has one row of fallback_accuracy and fallback_groundedness: the candidate must be as accurate, or as
    grounded and hardly less accurate.
    """
    c = F.col
    as_good = (c("accuracy") >= c("fallback_accuracy")) | ((c("groundedness") >= c("fallback_groundedness")) & (c("accuracy") >= c("fallback_accuracy") - s.fallback_slack))
    faults = F.array_compact(F.array(
        F.when(c("accuracy") < s.accuracy_floor, "accuracy"),
        F.when(c("groundedness") < s.groundedness_floor, "groundedness"),
        F.when(c("hallucination_rate") > s.hallucination_ceiling, "hallucination_rate"),
        F.when(c("latency_p95") > s.latency_ceiling_ms, "latency_p95_ms"),
        F.when(~as_good, "fallback comparison"),
    ))
    both = measured.crossJoin(F.broadcast(fallback.limit(1)))  # one row
    return both.withColumn("violations", F.array_join(faults, ";")).withColumn("promote", F.col("violations") == "").select(*measured.columns, "violations", "promote")


def exact_unique(docs: DataFrame) -> DataFrame:
    """sha256, doc_id (the first), copies."""
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def ranked_pages(hits: DataFrame, query: str, page: str, k: int) -> DataFrame:
    """query, page, best: distinct pages by their best hit, the first k."""
    best = hits.groupBy(query, page).agg(F.min("rank").alias("best"))
    return best.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy("best", page))).filter(F.col("place") <= k)
