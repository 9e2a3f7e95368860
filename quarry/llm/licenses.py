"""License scans by diagonal voting.

All rolling word 2-gram hashes of the documents are Spark-joined to the positions of the same grams in templates. A
match at document word d and template word t votes for the diagonal d - t. Votes are aggregated by document, template
and diagonal, neighbouring diagonals whose places meet are merged (words inserted or left out), and spans are verified:
each vote holds equal words, not only equal hashes; a span's coverage counts the distinct template grams that it meets,
however often each occurs, and must hold the grams that tell the licence from others (version, conditions, verb); and a
span may not be longer than STRETCH times its template. A phrase is a template that
must be met whole on one diagonal: its places are the base result. Notices are longer templates that add labels of
their own.

Each text is split once: a row without any gram of a template travels on by one marker, so that no second scan has to
find it. Null text is empty. A document without words has n_words 0, no places, empty labels and score 0; an empty table
gives an empty table. Overlapping places of one phrase all count; very long texts are scanned whole. Rows are told apart
by where they are stored, so repeated rows and ids repeat; other columns, whatever their names, are left alone. Only
DataFrame functions run; the template table is a constant of this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, located, lower_ascii

#: Fixed values of the base contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Well-known public notices: public identifier, words, and the word pairs that a span must hold, since they tell the
#: licence from others of like wording (its version, its conditions, the verb that grants it).
NOTICES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software", "redistribute it", "gnu general", "general public", "public license"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["licensed under", "general public", "license version", "version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["licensed under", "general public", "license version", "version 3"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["licensed under", "apache license", "license version", "version 2", "2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "license version", "version 2", "2 0"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted", "free of", "of charge", "any person", "associated documentation"]),
    ("mit", "released under the mit license", ["released under", "mit license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and", "binary forms", "without modification", "are permitted"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["licensed under", "cc by", "by 4", "4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["licensed under", "cc by", "by nc", "nc 4", "4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons", "commons attribution", "attribution 4", "4 0"]),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons", "attribution sharealike", "sharealike 4", "4 0"]),
]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a notice's distinct grams that a span must hold, words by which neighbouring diagonals may differ, and the
#: greatest length of a span against its template. A template has 62 grams at most.
COVERAGE, DRIFT, STRETCH = 0.7, 3, 2


def words(text: Column) -> Column:
    split = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(split, lambda w: w != "")


def listed() -> list[tuple[str, str, bool, list[int]]]:
    """Label, words, whether it is a phrase, and the places of the grams that must be met, of every template."""
    out = [(label, text, True, []) for text, label in PHRASES.items()]
    for label, text, must in NOTICES:
        parts = text.split()
        pairs = [" ".join(parts[i : i + 2]) for i in range(len(parts) - 1)]
        out.append((label, text, False, sorted(pairs.index(m) for m in must)))
    return out


def templates(spark: SparkSession) -> DataFrame:
    """Every gram of every template with its place, and the marker (template -1) that keeps rows without a gram."""
    rows = [(-1, "", False, 0, 0, 0, 0, "", "")]
    for k, (label, text, phrase, must) in enumerate(listed()):
        parts, needed = text.split(), sum(1 << at for at in must)
        rows += [(k, label, phrase, len(parts), needed, at, 1 << at, parts[at], parts[at + 1]) for at in range(len(parts) - 1)]
    frame = spark.createDataFrame(rows, "template int, label string, phrase boolean, size int, needed bigint, at int, bit bigint, w1 string, w2 string")
    return frame.withColumn("gram", F.xxhash64("w1", "w2"))


def votes(docs: DataFrame) -> DataFrame:
    """For each row, template and diagonal: the template grams met as bits, the number of votes, first and last place
    (word positions, inclusive). docs: doc_id, text and __locator. The marker's group holds the row's n_words."""
    parts = docs.select("doc_id", "__locator", words(F.col("text")).alias("words"))
    gram = lambda d1, d2, pos: F.struct(pos.alias("pos"), F.xxhash64(d1, d2).alias("gram"), d1.alias("d1"), d2.alias("d2"))
    marker = F.array(gram(F.lit(""), F.lit(""), F.size("words")))
    pairs = F.transform("words", lambda w, i: gram(w, F.get("words", i + 1), i))
    grams = parts.select("doc_id", "__locator", F.explode(F.concat(marker, pairs)).alias("g")).select("doc_id", "__locator", "g.*")
    met = grams.join(F.broadcast(templates(docs.sparkSession)), "gram").filter("d1 = w1 and d2 = w2")
    keys = ["doc_id", "__locator", "template", "label", "phrase", "size", "needed"]
    return met.groupBy(*keys, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.bit_or("bit").alias("grams"), F.min("pos").alias("first_word"), (F.max("pos") + 1).alias("last_word"))


def spans(cast: DataFrame) -> DataFrame:
    """One row for each verified span: doc_id, __locator, label, phrase, first_word, last_word (inclusive), coverage.
    cast: `votes`, whose markers stay as rows with a null label and first_word = n_words."""
    shown = ["doc_id", "__locator", "label", "phrase", "first_word", "last_word", "coverage"]
    marks = cast.filter("template < 0").withColumns({"label": F.lit(None).cast("string"), "coverage": F.lit(0.0)})
    whole = cast.filter("phrase and bit_count(grams) = size - 1").withColumn("coverage", F.lit(1.0))
    order = W.partitionBy("__locator", "template").orderBy("first_word", "diagonal")
    near = (F.col("first_word") - F.lag("last_word").over(order) <= DRIFT) & (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= DRIFT)
    run = F.sum(F.when(near, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    keys = ["doc_id", "__locator", "template", "label", "phrase", "size", "needed"]
    merged = cast.filter("template >= 0 and not phrase").withColumn("run", run).groupBy(*keys, "run").agg(F.bit_or("grams").alias("grams"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))
    noted = merged.withColumn("coverage", F.bit_count("grams") / (F.col("size") - 1))
    noted = noted.filter((F.col("coverage") >= COVERAGE) & (F.col("grams").bitwiseAND(F.col("needed")) == F.col("needed")) & (F.col("last_word") - F.col("first_word") < STRETCH * F.col("size")))
    return marks.select(*shown).unionByName(whole.select(*shown)).unionByName(noted.select(*shown))


def report(docs: DataFrame) -> DataFrame:
    ws = Workspace(docs.sparkSession, "licenses")
    # The votes are few; written once, they aren't counted anew for each kind of template.
    found = spans(ws.save(votes(located(docs.select("doc_id", "text"), ws)), "votes"))
    label, place = F.col("label"), F.when(F.col("phrase"), F.col("first_word").cast("bigint"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("__locator").agg(
        F.first("doc_id").alias("doc_id"), F.max(F.when(label.isNull(), F.col("first_word").cast("bigint"))).alias("n_words"), F.count(place).alias("n_base"),
        F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        joined(F.when(F.col("phrase"), label)).alias("base_labels"), joined(label).alias("labels"), F.max("coverage").alias("score"),
    ).drop("__locator")
