"""Plans for reading a whole document in a bounded number of calls, and pooling what comes back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.config import DEFAULTS
from quarry.functions import text as tx
from quarry.operators import packing
from quarry.sources.sinks import shared_folder

#: Items that a call is asked for at most, and at least, by task.
MOST_PER_CALL, LEAST_PER_CALL = {"mcq": 8, "practice_qsn": 10, "keypoints": 16}, {"keypoints": 2}
OTHER_PER_CALL = 8


def per_call(task: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in MOST_PER_CALL.items() for x in pair])
    return F.coalesce(named[task], F.lit(OTHER_PER_CALL))


def prose(pages: DataFrame, least: int = DEFAULTS.min_page_chars) -> DataFrame:
    """Pages with enough text, trimmed."""
    own = F.regexp_replace("text", r"^\s+|\s+$", "")
    return pages.withColumn("text", own).filter(F.length("text") >= least)


def relevant(hits: DataFrame, query: str, page: str, limit: int = DEFAULTS.source_chars) -> DataFrame:
    """query, page: by relevance, pages that fit the budget; one that doesn't is skipped, the first always stays.

    hits: query, page, rank, n (characters): a query's few ranked pages are folded in order.
    """
    ranked = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(page).alias("page"), F.col("n").cast("int").alias("n")))).alias("rs"))
    page_type = hits.schema[page].dataType.simpleString()
    zero = F.struct(F.lit(0).alias("total"), F.array().cast(f"array<{page_type}>").alias("kept"))
    skip = lambda a, r: (a.total > 0) & (a.total + r.n > limit)
    add = lambda a, r: F.when(skip(a, r), a).otherwise(F.struct((a.total + r.n + 2).alias("total"), F.concat(a.kept, F.array(r.page)).alias("kept")))
    return ranked.select(query, F.explode(F.array_sort(F.aggregate("rs", zero, add, lambda a: a.kept))).alias(page))


def rate_plan(sizes: DataFrame, per_page: int) -> DataFrame:
    """Adds pages_per_group, groups, asks (of a full group) and requested, at a rate for each page. sizes: task, pages."""
    floor = F.coalesce(F.create_map(*[F.lit(x) for pair in LEAST_PER_CALL.items() for x in pair])[F.col("task")], F.lit(1))
    together = F.greatest(F.lit(1), F.floor(per_call(F.col("task")) / per_page))
    return sizes.select("*", together.alias("pages_per_group"), F.ceil(F.col("pages") / together).alias("groups"), F.greatest(floor, per_page * F.least(together, F.col("pages"))).alias("asks"), (per_page * F.col("pages")).alias("requested"))


def count_plan(sizes: DataFrame, count: int, budget: int = DEFAULTS.source_chars) -> DataFrame:
    """Adds calls and group_chars for a total of `count` items. sizes: task, chars (with two for each page)."""
    calls = F.greatest(F.lit(1), F.ceil(F.lit(count) / per_call(F.col("task"))))
    return sizes.select("*", calls.alias("calls"), F.least(F.lit(budget), F.greatest(F.lit(DEFAULTS.min_group_chars), F.ceil(F.col("chars") / calls))).alias("group_chars"))


def shares(made: Column, count: int, per_call: int) -> Column:
    """What each group in turn is asked for, when group i gives `made[i]` items: the rest in equal parts, within a call."""
    n = F.size(made)
    zero = F.struct(F.lit(0).alias("have"), F.array().cast("array<int>").alias("asks"))

    def add(a: Column, m: Column) -> Column:
        rest = count - a.have
        ask = F.greatest(F.lit(1), F.least(F.lit(per_call), F.ceil(rest / (n - F.size(a.asks))).cast("int")))
        return F.when(rest <= 0, a).otherwise(F.struct((a.have + F.least(m, ask)).alias("have"), F.concat(a.asks, F.array(ask)).alias("asks")))

    return F.aggregate(made, zero, add, lambda a: a.asks)


def pooled(items: DataFrame, key: str, group: str, order: str, stem: Column, most: int) -> DataFrame:
    """key, place, stem: items of all groups in order, without blank and repeated stems, numbered, `most` at most.

    The first of equal stems is found by a pre-aggregated minimum.
    """
    own = items.select(key, F.struct(group, order).alias("at"), tx.comparison_key(stem).alias("stem")).filter("stem != ''")
    first = own.groupBy(key, "stem").agg(F.min("at").alias("at"))
    return first.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("at"))).filter(F.col("place") <= most).select(key, "place", "stem")


def sentence_budget(pages: Column, low: int = 5, high: int = 30) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), pages))


def fold_sentences(chars: Column) -> Column:
    """Sentences that a text of so many characters is folded to: half as many as it holds, within 2 and 30."""
    return F.greatest(F.lit(2), F.least(F.lit(30), F.floor(F.floor(chars / 120) / 2)))


def folds(summaries: DataFrame, key: str, chars: str, budget: int) -> DataFrame:
    """key, rounds, chars: rounds of folding until a document's summaries fit `budget`, or no longer shrink, by sizes alone
    (`fold` does the folding).

    A round replaces every `budget` characters by fold_sentences() sentences of 120 characters; the loop over rounds is an
    expression of each row. What a round leaves beyond the budget is at most half of what was beyond it, so that 64 rounds
    are enough for any size that a bigint holds.
    """
    after = lambda n: F.ceil(n / budget) * fold_sentences(F.lit(budget)) * 120
    zero = F.struct(F.lit(0).alias("rounds"), F.col("n").alias("n"))
    step = lambda a, _: F.when((a.n <= budget) | (after(a.n) >= a.n), a).otherwise(F.struct((a.rounds + 1).alias("rounds"), after(a.n).cast("bigint").alias("n")))
    sums = summaries.groupBy(key).agg(F.sum(chars).cast("bigint").alias("n"))
    return sums.withColumn("f", F.aggregate(F.sequence(F.lit(1), F.lit(64)), zero, step)).select(key, F.col("f.rounds").alias("rounds"), F.col("f.n").alias("chars"))


def joined(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, text: the texts of one run (a budget of characters, or one long text) in the order of `place`, a blank line between."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda r: r.text), "\n\n").alias("text"), F.sum(F.length("text")).alias("chars"))


def fold(notes: DataFrame, generate: Callable[[DataFrame], DataFrame], budget: int = DEFAULTS.source_chars) -> DataFrame:
    """key, rounds, notes, text: each document's notes, folded until they fit one prompt, cut at `budget`.

    notes: key (a string), place (none twice in a document), text. A generation packs every document's notes into runs that
    fit the budget, by their sizes, so that a generation's texts are stored and shuffled once. It hands runs
    (key, run, text, sentences) to `generate`, which gives key, run, text, and takes what isn't blank as the next notes.
    A document is done when its notes are one run, or as many runs as notes (no progress); the loop ends when all are.
    Each generation is written, so that a lost executor or a costly generator costs no more than the generation at hand.
    Documents without notes don't occur. A null text is blank and falls out before the first generation, and so do rows
    without key or place.
    """
    spark, root, n = notes.sparkSession, shared_folder(notes.sparkSession, "fold"), 0

    def save(rows: DataFrame) -> DataFrame:
        """The notes of generation n with their sizes, without those that hold nothing but space."""
        own = rows.filter(F.ltrim("text", F.lit(" \t\n\x0b\f\r")) != "").select("key", "place", F.length("text").cast("bigint").alias("n"), "text")
        own.write.parquet(f"{root}/notes-{n}")
        return spark.read.schema("key string, place bigint, n bigint, text string").parquet(f"{root}/notes-{n}")

    left = save(notes.select(F.col("key").cast("string").alias("key"), F.col("place").cast("bigint").alias("place"), "text").filter("key is not null and place is not null"))
    done = []
    while True:
        packed = packing.Strung(left, budget, f"{root}/packed-{n}")
        sizes = packed.sizes()
        more = (F.col("runs") > 1) & (F.col("runs") < F.col("notes"))
        told = sizes.agg(F.count_if(more).alias("over"), F.count_if(~more).alias("ended")).first()
        if told.ended or not (done or told.over):
            # A document that makes no progress may hold more than a budget: what the cut leaves ends in its second note.
            ended = sizes.filter(~more)
            first = joined(packed.texts(ended, 2).withColumnRenamed("run", "place"), "key").drop("chars")
            done.append(first.join(ended, "key").select("key", F.lit(n).alias("rounds"), "notes", F.substring("text", 1, budget).alias("text")))
        if not told.over:
            break
        asked = packed.texts(sizes.filter(more)).withColumn("sentences", fold_sentences(F.col("chars"))).drop("chars")
        n += 1
        left = save(generate(asked).select(F.col("key").cast("string").alias("key"), F.col("run").cast("bigint").alias("place"), "text"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def grouped(pages: DataFrame, task: str, count: int | None, per_page: int | None, budget: int = DEFAULTS.source_chars) -> tuple[DataFrame, int]:
    """key, group (from 0), groups, text, pages: the prompts of each document, and how many a document has at most in count
    mode (0 at a rate). pages: key, place, text (prose)."""
    most = MOST_PER_CALL.get(task, OTHER_PER_CALL)
    if per_page:
        runs, calls = packing.assigned(pages, "key", "place", budget, max(1, most // per_page)), 0
    else:
        calls = max(1, -(-count // most))
        total = pages.groupBy("key").agg(F.sum(F.length("text") + packing.GAP).alias("total"))
        limit = F.least(F.lit(budget), F.greatest(F.lit(DEFAULTS.min_group_chars), F.ceil(F.col("total") / calls)))
        runs = packing.assigned(pages.join(total.select("key", limit.alias("room")), "key"), "key", "place", "room")
    whole = pages.join(runs, ["key", "place"])
    made = joined(whole, "key", "run").join(whole.groupBy("key", "run").agg(F.count(F.lit(1)).alias("pages")), ["key", "run"]).drop("chars")
    n = made.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    made = made.join(n, "key")
    if calls:  # of more groups than calls, evenly spaced ones
        step = F.col("n") / calls
        chosen = F.filter(F.sequence(F.lit(0), F.lit(calls - 1)), lambda i: F.floor(i * step) == F.col("run"))
        made = made.withColumn("group", F.when(F.col("n") <= calls, F.col("run")).otherwise(F.get(chosen, 0))).filter("group is not null")
        made = made.withColumn("groups", F.least(F.col("n"), F.lit(calls)))
    else:
        made = made.withColumnsRenamed({"run": "group", "n": "groups"})
    return made.select("key", F.col("group").cast("bigint").alias("group"), F.col("groups").cast("bigint").alias("groups"), F.substring("text", 1, budget).alias("text"), "pages"), calls


def pooled_items(pages: DataFrame, task: str, generate: Callable[[DataFrame], DataFrame], count: int | None = None, per_page: int | None = None, budget: int = DEFAULTS.source_chars) -> tuple[DataFrame, DataFrame]:
    """Items from across whole documents, and how each document went.

    pages: key (a string), place, text: prose. Exactly one of `count` (a total, sampled over the document) and `per_page` (a
    rate, all pages read) is given. `generate` takes requests (key, group, text, ask) and gives key, group, place, text,
    accepted: the items of each group in order, a group without items as one row whose text is null. Items whose
    comparison key is blank or came before are dropped.

    At a rate all groups are asked at once. For a total, group after group of all documents is a generation: what is still
    missing is shared out over the groups that are left, so a group that came back short is made up for; there are no
    more generations than a total of `count` buys calls. Returns items (key, place from 1, text) and documents (key,
    requested, generated, groups, asked, accepted); `accepted` says whether every group that was asked was.
    """
    if (count is None) == (per_page is None) or (per_page if count is None else count) < 1:
        raise ValueError("give exactly one of count and per_page, at least 1")
    spark, root = pages.sparkSession, shared_folder(pages.sparkSession, "pool")

    def save(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    most, floor = MOST_PER_CALL.get(task, OTHER_PER_CALL), LEAST_PER_CALL.get(task, 1)
    pages = pages.select(F.col("key").cast("string").alias("key"), F.col("place").cast("bigint").alias("place"), "text")
    groups, calls = grouped(pages, task, count, per_page, budget)
    groups = save(groups, "groups")
    stem = tx.comparison_key(F.col("text"))

    def fresh(made: DataFrame) -> DataFrame:
        own = made.select("key", "group", F.col("place").cast("bigint").alias("place"), "text", stem.alias("stem")).filter("stem <> ''")
        first = own.groupBy("key", "stem").agg(F.min(F.struct("group", "place", "text")).alias("r"))
        return first.select("key", "stem", "r.group", "r.place", "r.text")

    if per_page:
        made = save(generate(groups.select("key", "group", "text", F.greatest(F.lit(floor), per_page * F.col("pages")).alias("ask"))), "made")
        items, verdicts = save(fresh(made), "items"), made.groupBy("key", "group").agg(F.bool_and("accepted").alias("accepted"))
    else:
        items = spark.createDataFrame([], "key string, stem string, group bigint, place bigint, text string")
        verdicts = spark.createDataFrame([], "key string, group bigint, accepted boolean")
        for i in range(calls):
            have = items.groupBy("key").agg(F.count(F.lit(1)).alias("have"))
            rest = count - F.coalesce("have", F.lit(0))
            ask = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(rest / (F.col("groups") - i))))
            asked = groups.filter(F.col("group") == i).join(have, "key", "left").filter(rest > 0).select("key", "group", "text", ask.cast("int").alias("ask"))
            made = save(generate(asked), f"made-{i}")
            items = save(items.unionByName(fresh(made).join(items.select("key", "stem"), ["key", "stem"], "left_anti").select(*items.columns)), f"items-{i}")
            verdicts = verdicts.unionByName(made.groupBy("key", "group").agg(F.bool_and("accepted").alias("accepted")))
    order = W.partitionBy("key").orderBy("group", "place")
    kept = items.withColumn("n", F.row_number().over(order)).filter(F.lit(True) if count is None else F.col("n") <= count)
    told = verdicts.groupBy("key").agg(F.count(F.lit(1)).alias("asked"), F.bool_and(F.coalesce("accepted", F.lit(False))).alias("accepted"))
    made = kept.groupBy("key").agg(F.count(F.lit(1)).alias("generated"))
    size = groups.groupBy("key").agg(F.max("groups").alias("groups"), F.sum("pages").alias("pages"))
    requested = F.lit(count).cast("bigint") if count else per_page * F.col("pages")
    documents = size.join(told, "key", "left").join(made, "key", "left").select("key", requested.alias("requested"), F.coalesce("generated", F.lit(0)).alias("generated"), "groups", F.coalesce("asked", F.lit(0)).alias("asked"), F.coalesce("accepted", F.lit(False)).alias("accepted"))
    return kept.select("key", F.col("n").alias("place"), "text"), documents


def gated(items: DataFrame, documents: DataFrame, faults: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """documents with passed, and accepted only where every group and the pooled set were: the check that sees across
    groups. faults: from items to key, n (faults found; keys without faults may be missing)."""
    found = faults(items).select("key", F.col("n").alias("__n"))
    passed = F.coalesce("__n", F.lit(0)) == 0
    return documents.join(found, "key", "left").select(*[c for c in documents.columns if c != "accepted"], passed.alias("passed"), (F.col("accepted") & passed).alias("accepted"))
