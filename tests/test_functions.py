import pytest
from pyspark.sql import functions as F

from quarry.functions import citations as ct
from quarry.functions import render as rd
from quarry.functions import text as tx
from quarry.functions import verdicts as vd
from quarry.operators import chunks, dataset, logs, packing, planning, splitters
from quarry.sources import sinks
from quarry.sources.readers import text_of


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("raw", "key"), [("  The Cabinet. ", "the cabinet"), (None, ""), ("A   B", "a b"), ("?!x;", "x")])
def test_comparison_key(spark, raw, key):
    assert one(spark, raw, tx.comparison_key) == key


@pytest.mark.parametrize(("text", "least", "is_it"), [("a ..... 1\nb ..... 2\nc ..... 3", 3, True), ("Section 108. The court may...", 3, False)])
def test_contents(spark, text, least, is_it):
    assert one(spark, text, lambda t: tx.is_contents(t, least)) is is_it


def test_substantive_needs_letters(spark):
    assert one(spark, "." * 90, lambda t: tx.is_substantive(t, 8)) is False
    assert one(spark, "a" * 80, tx.is_substantive) is True
    assert one(spark, "a" * 79, tx.is_substantive) is False


def test_broken_words_are_joined(spark):
    assert one(spark, "off-\nshore\n 12 \nx", tx.clean_page) == "offshore x"


def test_toc_boundaries(spark):
    assert one(spark, "\n".join(["x" * 85 + " 12"] * 7 + ["plain text"] * 3), tx.is_toc) is True
    assert one(spark, "\n".join(["x" * 85 + " 12"] * 6 + ["plain text"] * 4), tx.is_toc) is False


@pytest.mark.parametrize(("a", "b", "f1"), [("", "", 1.0), ("x", "", 0.0), ("a a b", "a b b", 2 / 3)])
def test_token_f1(spark, a, b, f1):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(tx.token_f1(tx.tokens(F.col("a")), tx.tokens(F.col("b"))).alias("x")).first().x
    assert got == pytest.approx(f1)


def test_feature_bucket(spark):
    assert one(spark, "cabinet", tx.bucket_of) == 721415


def test_tolerant_reply(spark):
    for text in ('{"k": 3}', '```json\n{"k": 3}\n```', 'Sure: {"k": 3} ok'):
        assert one(spark, text, lambda t: tx.parse_reply(t, "k bigint")["k"]) == 3


def test_html_lines():
    assert text_of("<p>a&amp;b</p><script>x</script><br>c<br/>d") == "a&b\nc\nd"


def test_item_faults(spark):
    rows = [(["a", "b", "c"], "a"), (["a", "", "c", "d"], "a"), (["a", "A.", "c", "d"], "a"), (["a", "b", "c", "d"], "e"), (["a", "b", "c", "All of the above"], "a"), (["a", "b", "c", "both of the  following"], "a"), (["a", "b", "c", "d"], "d"), (None, "a")]
    made = spark.createDataFrame(rows, "o array<string>, a string").select(vd.mcq_faults(F.lit("q"), F.col("o"), F.col("a")).alias("f"))
    assert [len(r.f) for r in made.collect()] == [1, 1, 1, 1, 1, 1, 0, 1]
    assert one(spark, "", lambda t: vd.mcq_faults(t, F.array(), t)) == ["empty question", "0 options"]


@pytest.mark.parametrize(("raw", "score"), [("87.5", 87), ("-3", 1), ("1e2", 100), ("x", 1), (None, 1), ("120", 100), ("85", 85), ("NaN", 1)])
def test_scores_are_clamped(spark, raw, score):
    assert one(spark, raw, tx.clamp_score) == score


@pytest.mark.parametrize(("text", "points"), [(["only"], ["only 1 key point(s)"]), (["a b", "A  b."], ["duplicate key points"]), (["a", ""], ["empty key point"]), ([], ["no key points"]), (["a", "b"], [])])
def test_keypoint_faults(spark, text, points):
    assert spark.createDataFrame([(text,)], "p array<string>").select(vd.keypoint_faults(F.col("p")).alias("x")).first().x == points


def test_other_faults(spark):
    assert one(spark, "short", vd.summary_faults) == ["only 5 characters"] and one(spark, " ", vd.summary_faults) == ["empty summary"] and one(spark, "x" * 80, vd.summary_faults) == []
    items = spark.createDataFrame([([("What is it?", "what is it"), ("Q", " "), ("", "a")],)], "i array<struct<question:string,answer:string>>")
    assert items.select(vd.practice_faults(F.col("i")).alias("x")).first().x == ["question What is it? is restated by its answer", "question Q has an empty answer", "empty question"]


@pytest.mark.parametrize(("reply", "score", "instruction"), [
    ('{"score": 85, "reasoning": "fine", "regeneration_instruction": "Name the court that decides."}', 85, "Name the court that decides."),
    ('```json\n{"score": "40.9", "reasoning": "No court.", "regeneration_instruction": "Rewrite..."}\n```', 40, "Fix exactly this problem and change nothing else: No court."),
    ("[85]", 1, vd.UNREADABLE), ("I would give 85", 1, vd.UNREADABLE), ('so: {"score": 0} ok', 1, vd.NO_INSTRUCTION), ("", 1, vd.UNREADABLE), (None, 1, vd.UNREADABLE),
])
def test_verdicts_fail_closed(spark, reply, score, instruction):
    got = one(spark, reply, vd.parse_verdict)
    assert (got.score, got.regeneration_instruction) == (score, instruction)


@pytest.mark.parametrize(("passed", "score", "attempt", "critique", "chat"), [
    (True, 80, 1, "c", "persist"), (False, 60, 2, "c", "persist"), (False, 60, 1, "", "persist"), (False, 60, 1, "The judge failed to return a verdict.", "persist"),
    (False, 40, 1, "c", "persist"), (False, 45, 1, "c", "generate"), (False, 55, 1, "c", "generate"), (None, None, 1, "c", "persist"),
])
def test_routes(spark, passed, score, attempt, critique, chat):
    row = spark.createDataFrame([(passed, score, attempt, critique)], "p boolean, s int, a int, c string")
    got = row.select(vd.chat_route(F.col("p"), F.col("a"), F.col("s"), F.lit(70), F.col("c")).alias("x"), vd.resource_route(F.col("p"), F.col("a")).alias("y")).first()
    assert got.x == chat and got.y == ("persist" if passed or attempt >= 2 else "generate")


def test_gated_turns(spark):
    rows = spark.createDataFrame([("General", "r"), ("general", " "), ("pdf", "r"), (None, "r")], "m string, r string")
    assert [r.x for r in rows.select(vd.is_gated(F.col("m"), F.col("r")).alias("x")).collect()] == [True, False, False, False]


def test_promotion_needs_all(spark):
    rows = [(0.86, 0.9, 0.1, 100.0), (0.86, 0.8, 0.1, 100.0), (0.9, 0.9, 0.1, 9000.0), (0.6, 0.9, 0.2, 1.0), (0.95, 0.86, 0.1, 1.0)]
    made = spark.createDataFrame([(str(i), 1, *r) for i, r in enumerate(rows)], "group string, n int, accuracy double, groundedness double, hallucination_rate double, latency_p95 double")
    fallback = spark.createDataFrame([(0.9, 0.87)], "fallback_accuracy double, fallback_groundedness double")
    assert {r.group: r.violations for r in dataset.gate(made, fallback).collect()} == {"0": "", "1": "groundedness;fallback comparison", "2": "latency_p95_ms", "3": "accuracy;hallucination_rate;fallback comparison", "4": ""}


def test_citations(spark):
    held = lambda t: one(spark, t, ct.supported)
    assert held("under Section 12 and art. 7B") == ["12", "7b"] and held("paid 500. The 12 of May, 3.5") == []
    assert held("\n147. The officer") == ["147"] and held("Enforcement of 5. (1) Subject") == ["5"] and held("see 153A.") == ["153a"]
    assert one(spark, "casino 5, no. 4, sections 12A and Article 9", ct.cited) == ["12a", "9"]


def test_unicode_is_normalised(spark):
    got = one(spark, "e\u0301 \ufb01n\u00a0\u2460 \u201cx\u201d\n  12  \n\u2022 item\nword\n- more", lambda t: tx.clean_page(tx.nfkc(t)))
    assert got == 'é fin 1 "x" item wordmore'


def test_recursive_split():
    text = "One two three. Four five six; seven eight. " * 40
    for size, overlap in ((100, 20), (30, 10), (7, 3)):
        made = splitters.recursive_split(text, size, overlap)
        assert all(0 < len(c) <= size for c in made) and all(c in text for c in made)
        assert set("".join(made)) >= set(text.replace(" ", ""))
    assert splitters.recursive_split("abc", 900, 150) == ["abc"] and splitters.recursive_split("", 900, 150) == []
    assert splitters.recursive_split("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]


def test_section_chunks():
    unit = lambda text, s=None: {"section_id": s, "text": text}
    made = splitters.section_chunks([unit("a" * 100, "1"), unit("b" * 50), unit("\n".join(["c" * 40] * 5), "2"), unit("d" * 79)], most=160, merge_below=80)
    assert [(c["section_id"], len(c["text"])) for c in made] == [("1", 151), ("2", 122), ("2", 81), (None, 79)]
    assert "".join(c["text"] for c in made).replace("\n", "") == "a" * 100 + "b" * 50 + "c" * 200 + "d" * 79


def test_structure_of_lines(spark):
    text = "intro\nCHAPTER I Of courts\nPART 2\n5. First\nbody\nCHAPTER II\nloose\n6A. Second"
    rows = chunks.structure(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")).orderBy("unit").collect()
    assert [(r.section_id, r.chapter, r.part, r.text) for r in rows] == [
        (None, None, None, "intro"), ("5", "CHAPTER I Of courts", "PART 2", "5. First\nbody"), (None, "CHAPTER II", None, "loose"), ("6A", "CHAPTER II", None, "6A. Second")]


def test_names_and_ids(spark):
    import uuid

    assert one(spark, "doc:1:2", rd.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "doc:1:2"))
    ids = [uuid.uuid5(uuid.NAMESPACE_DNS, f"é{i}") for i in range(40)]
    made = spark.createDataFrame([(i, f"é{i}") for i in range(40)], "i int, t string").select("i", rd.uuid5(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r.u for r in made] == list(map(str, ids))
    assert one(spark, "x" * 23, rd.object_id) is None and one(spark, "aF" * 12, rd.object_id) == "aF" * 12
    assert one(spark, "- a\n2) b\n\n", rd.points_of) == ["a", "b"] and one(spark, '["a", "b"]', rd.points_of) == ["a", "b"]


@pytest.mark.parametrize("most", [None, 4])
def test_packing_is_greedy_in_parts(spark, most):
    import random

    draw, rows = random.Random(1), []
    for g in ("a", "b", "c"):
        rows += [(g, i, "x" * draw.choice([0, 1, 50, 99, 140, 400])) for i in range({"a": 300, "b": 1, "c": 40}[g])]
    want = {}
    for g in ("a", "b", "c"):
        run, size, count = 0, 0, 0
        for _, _, t in sorted(r for r in rows if r[0] == g):
            if count and (size + len(t) > 300 or most and count >= most):
                run, size, count = run + 1, 0, 0
            size, count = size + len(t) + 2, count + 1
            n, c = want.get((g, run), (0, 0))
            want[g, run] = (n + 1, c + len(t))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        made = packing.pack(spark.createDataFrame(rows, "g string, i bigint, text string"), "g", "i", 300, most).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r.g, r.run): (r.rows, r.chars) for r in made} == want


def test_ranks_of_skewed_values(spark):
    rows = [("a", 1e9), *[("a", float(i % 7)) for i in range(500)], ("b", 3.0), ("b", None)]
    n = F.col("n")
    made = {r.g: r for r in logs.at_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"low": F.lit(0), "mid": F.floor(n / 2), "top": n - 1}).collect()}
    own = sorted(v for g, v in rows if g == "a")
    assert (made["a"].n, made["a"].low, made["a"].mid, made["a"].top) == (501, own[0], own[250], own[500]) and (made["b"].n, made["b"].mid) == (1, 3.0)


def test_shares_and_folds(spark):
    row = spark.createDataFrame([([8, 0, 3, 9],)], "m array<int>")
    assert row.select(planning.shares(F.col("m"), 20, 8).alias("x")).first().x == [5, 5, 8, 8]
    hits = spark.createDataFrame([(1, 10, 1, 7000), (1, 11, 2, 100), (1, 3, 3, 50), (2, 5, 1, 4000), (2, 6, 2, 3000), (2, 4, 3, 1000)], "q int, page int, rank int, n int")
    assert {(r.q, r.page) for r in planning.relevant(hits, "q", "page").collect()} == {(1, 10), (2, 5), (2, 4)}


def test_files_are_kept_apart(spark):
    path = sinks.shared_folder(spark, "test")
    rows = spark.createDataFrame([(1, "é", None), (2, "b", 3)], "i int, s string, n int")
    sinks.json_lines(rows, path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ['{"i":1,"s":"é","n":null}', '{"i":2,"s":"b","n":3}']


def test_stratified_units_stay_whole(spark):
    units = spark.createDataFrame([("s", f"u{i}", i + 1) for i in range(9)], "subject string, unit string, n bigint")
    made = dataset.stratified_assign(units).collect()
    assert len(made) == 9 and {r.split for r in made} == {"train", "val", "test"}


def test_sliding_windows_end_once(spark):
    rows = spark.createDataFrame([(1, ""), (2, "x" * 1000), (3, "x" * 1001), (4, None)], "doc_id int, text string")
    assert sorted((r.doc_id, r.chunk_index) for r in chunks.sliding(rows).collect()) == [(2, 0), (3, 0), (3, 1)]


def test_task_contract(spark):
    from quarry.functions import tasks

    replies = spark.createDataFrame([(1, '["One point.", "Two points."]'), (2, "- first\n- first"), (3, None), (4, '{"points": ["a"]}')], "id int, reply string")
    made = {r.id: (r.text, r.faults) for r in tasks.handled(replies, "keypoints", ("id",)).collect()}
    assert made[1] == ("1. One point.\n2. Two points.", []) and made[3][1] == ["no key points"] and made[4] == ("1. a", ["only 1 key point(s)"])
    question = '{"questions": [{"question": "Q?", "options": ["a", "b", "c", "d"], "answer": "b"}, {"question": "R?", "options": ["a", "b"], "answer": "z"}]}'
    rows = spark.createDataFrame([(1, question), (2, "no json"), (3, "[]")], "id int, reply string")
    made = {r.id: (r.text, r.faults) for r in tasks.handled(rows, "mcq", ("id",)).collect()}
    assert made[1][0].startswith("1. Q?\nA) a\nB) b") and made[1][1] == ["2: 2 options"] and made[2] == ("", ["no questions"]) == made[3]
    said = {r.id: r.faults for r in tasks.handled(spark.createDataFrame([(1, " too short "), (2, "x" * 90)], "id int, reply string"), "summary", ("id",)).collect()}
    assert said == {1: ["only 9 characters"], 2: []}
    with pytest.raises(ValueError, match="unknown task"):
        tasks.handled(rows, "poem", ("id",))
    from pyspark.sql import functions as F

    ask = tasks.TASKS["summary"].ask(F.lit("y" * 7000), F.lit(3))
    assert spark.range(1).select(ask.alias("a")).first().a.startswith("Write sentences that sum up, 3 of them") and "[excerpt cut]" in spark.range(1).select(ask.alias("a")).first().a


def test_files_are_skipped_by_whole_names(spark, tmp_path):
    from quarry.sources import readers

    root = tmp_path / "drafts"  # the word stands above the folder too
    for name in ("a.pdf", "drafts/b.pdf", "sub/drafts.pdf", "sub/drafts2.pdf", "notes.txt", "sub/c.HTML"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    found = {r.path.split("/drafts/", 1)[1] for r in readers.files(spark, str(root), skip=("drafts",)).select("path").collect()}
    assert found == {"a.pdf", "sub/drafts2.pdf", "sub/c.HTML"}
    assert readers.files(spark, str(root)).count() == 5


def test_document_states(spark):
    from quarry.operators import library

    rows = [(1, 1, 1, "Processing", None, None, None, None), (1, 2, 2, None, None, 9, 30, "m1"), (1, 3, 3, "Failed", "e" * 1500, None, None, None), (2, 1, 4, "Failed", "bad", None, None, None), (2, 2, 5, None, None, 1, 2, "m2"), (3, 1, 6, "Processing", None, None, None, None)]
    made = {r.doc: r for r in library.document_states(spark.createDataFrame(rows, "doc int, ts int, event_id int, status string, error string, n_pages int, n_chunks int, embedding_model string")).collect()}
    assert (made[1].status, len(made[1].error), made[1].n_pages, made[1].embedding_model, made[1].ingested_at) == ("Failed", 1000, 9, "m1", 2)
    assert (made[2].status, made[2].error, made[2].n_chunks) == ("Ready", None, 2) and (made[3].status, made[3].n_pages) == ("Processing", None)


def test_tables_of_part_files_are_one_entry(spark, tmp_path):
    from quarry.plans import output
    from quarry.sources import readers

    for name in ("documents.parquet/part-0.parquet", "documents.parquet/part-1.parquet", "embeddings.parquet", "events.parquet/part-0.parquet", "pages/embeddings.parquet", "labels.parquet/part-0.parquet"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in output.listed_files(spark, str(tmp_path)).collect()] == ["documents.parquet", "embeddings.parquet"]
    assert readers.files(spark, str(tmp_path), suffixes=r"documents\.parquet$").count() == 2


def test_texts_are_chunked_in_parts_of_bounded_bytes(spark):
    import pyarrow as pa

    from quarry.operators import splitters

    texts = ["x" * n for n in (3 << 20, 2 << 20, 9 << 20, 1, 0)] + [None] + ["y" * 10] * 700
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(splitters.slices(batch))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or (p.num_rows <= 256 and sum(len(t or "") for t in p.column("text").to_pylist()) <= 4 << 20) for p in parts)
