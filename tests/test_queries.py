"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quarry.operators import chunks, retrieval, splitters
from quarry.plans import catalog, structure
from quarry.plans.catalog import QUERIES, SQL

DATA = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    show = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    made = QUERIES[name](spark, DATA)
    columns = sorted(made.columns)
    rows = [tuple(r[c] for c in columns) for r in made.collect()]
    if name not in SQL:
        assert rows and len({tuple(map(str, r)) for r in rows}) == len(rows)  # a brute-force test says more
        return
    said = duck.sql(SQL[name])
    assert sorted(said.columns) == columns
    assert plain(rows) == plain(said.select(*[f'"{c}"' for c in columns]).fetchall())


#: Pages and what is left of them, written out by hand.
CLEANED = [
    ("", ""), ("   \n \t ", ""), ("plain words", "plain words"), ("two   words\n\nand\tmore ", "two words and more"),
    ("The \u201cCabinet\u201d shall\noff-\nshore the fund.\n12\n", 'The "Cabinet" shall offshore the fund.'), ("it\u2019s \u2018so\u2019", "it's 'so'"), ("a\u2013b\u2014c", "a-b-c"),
    ("\ufb01nd the \ufb02ow", "find the flow"), ("\uff21\uff22 \u2460", "AB 1"), ("one\n  17  \ntwo", "one two"), ("one\n12345\ntwo", "one 12345 two"), ("page 12\nnext", "page 12 next"),
    ("regu-\nlation", "regulation"), ("Regu-  \n  lation", "Regulation"), ("X-\nRay", "X- Ray"), ("co\n-operate", "cooperate"), ("list\n- first\n* second", "listfirst second"), ("list:\n- first\n* second", "list: first second"), ("\u2022 first.\n\u25cf second", "first. second"),
    ("\u2713 done.\n\u2714 also", "done. also"), ("a - b", "a - b"), ("no\u00a0break", "no break"), ("\u0663\u0664\nnext", "next"), ("end\n7", "end"), ("5\n6\n7", ""), ("a\u2028b\u0085c\x1cd", "a b c d"),
]


def test_pages_are_cleaned(spark):
    from quarry.functions import text as tx

    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEANED)], "i int, text string").withColumn("text", tx.nfkc("text"))
    made = {r.i: r.t for r in rows.select("i", tx.clean_page(tx.F.col("text")).alias("t")).collect()}
    assert [made[i] for i in range(len(CLEANED))] == [want for _, want in CLEANED]


def slow_split(text, size, overlap, separators):
    """The splitter by its description, one character range after another.

    A text is cut before each place of the first separator that occurs in it. Neighbouring pieces below `size` are put together
    while they fit; a chunk that is full begins the next one with as many of its last pieces as fit the overlap and leave room.
    Other pieces are split by the separators after that one.
    """
    chosen = [i for i, s in enumerate(separators) if s in text]
    at = chosen[0] if chosen else len(separators) - 1
    mark, places, i = separators[at], {0, len(text)}, 0
    while i < len(text):
        if not mark:
            places.add(i)
            i += 1
        elif text.startswith(mark, i):
            places.add(i)
            i += len(mark)
        else:
            i += 1
    ranges = list(zip(sorted(places), sorted(places)[1:], strict=False))
    chunks, window = [], []

    def tell():
        if window and (whole := text[window[0][0] : window[-1][1]].strip()):
            chunks.append(whole)

    for low, high in ranges:
        if high - low >= size:
            tell()
            window = []
            chunks += slow_split(text[low:high], size, overlap, separators[at + 1 :]) if separators[at + 1 :] else [text[low:high]]
            continue
        if window and high - window[0][0] > size:
            tell()
            while window and (low - window[0][0] > overlap or high - window[0][0] > size):
                window.pop(0)
        window.append((low, high))
    tell()
    return chunks


#: Where chunks may be cut.
MARKS = [". ", "; ", ": ", "? ", "! ", ") ", ", ", " ", ""]


def test_splitter_by_its_description():
    import random

    draw = random.Random(1)
    letters = ["a", "bb", "ccc", " ", "  ", ". ", "; ", ", ", ") ", "! ", "x" * 7, "\n", "é", ":", ": ", "? "]
    for _ in range(3000):
        text, size = "".join(draw.choice(letters) for _ in range(draw.randrange(60))), draw.choice([2, 3, 7, 12, 30, 100])
        overlap = draw.randrange(size)
        assert splitters.recursive_split(text, size, overlap) == slow_split(text, size, overlap, MARKS)
    assert splitters.recursive_split("One two. Three four. Five six.", 12, 0) == ["One two", ". Three four", ". Five six."]
    assert splitters.recursive_split("alpha beta gamma delta", 11, 6) == ["alpha beta", "beta gamma", "delta"]
    assert splitters.recursive_split("x" * 25, 10, 4) == ["x" * 10, "x" * 10, "x" * 10, "x" * 7] and splitters.recursive_split(" ", 9, 1) == []


def substantive(chunk):
    return sum(c.isascii() and c.isalnum() for c in chunk) >= 80


def test_recursive_chunks_by_hand(spark, duck):
    import hashlib

    from quarry.functions import text as tx
    from quarry.plans.registry import docs

    made = {}
    for r in QUERIES["recursive_chunks"](spark, DATA).collect():
        made.setdefault(r.doc_id, []).append((r.chunk_index, r.chunk_md5, r.chars))
    pages = docs(spark, DATA).select("doc_id", tx.nfkc("text").alias("text")).select("doc_id", tx.clean_page(tx.F.col("text")).alias("text"))
    for doc_id, text in map(tuple, pages.collect()):
        want = []
        for chunk in slow_split(text, 900, 150, MARKS):
            if substantive(chunk):
                want.append((len(want), hashlib.md5(chunk.encode()).hexdigest(), len(chunk)))
        assert sorted(made.get(doc_id, [])) == want


def test_section_chunks_by_hand(spark):
    units = {}
    for r in chunks.structure(structure.paged(spark, DATA)).orderBy("doc_id", "unit").collect():
        units.setdefault(r.doc_id, []).append(r.asDict())
    got = {}
    for r in splitters.unit_chunks(structure.paged(spark, DATA)).orderBy("doc_id", "at").collect():
        got.setdefault(r.doc_id, []).append((r.section_id, r.text))
    for doc_id, own in units.items():
        want = []
        for u in own:
            pieces = [[]]
            for line in u["text"].split("\n"):
                if pieces[-1] and len("\n".join([*pieces[-1], line])) > 3500 and len(u["text"]) > 3500:
                    pieces.append([])
                pieces[-1].append(line)
            for piece in map("\n".join, pieces):
                if want and len(piece) < 80 and len(want[-1][1]) + 1 + len(piece) <= 3500:
                    want[-1] = (want[-1][0], want[-1][1] + "\n" + piece)
                else:
                    want.append((u["section_id"], piece))
        assert got[doc_id] == want


def test_point_ids_are_those_of_the_standard_library(spark):
    import uuid

    for r in QUERIES["point_ids"](spark, DATA).collect():
        assert r.point_id == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{r.doc_id}:1:{r.doc_id % 10 if r.doc_id % 2 == 0 else 0}"))


#: Pages and their text, written out by hand.
HTML = [
    ("<p>One</p><p>Two</p>", "One\nTwo"), ("<div>a<br/>b</div>c", "a\nb\nc"), ("a<br>b", "ab"), ("<h1>Title</h1><script>var x = '<p>no</p>';</script><p>body</p>", "Title\nbody"), ("<style>p { color: red }</style>text", "text"),
    ("<ul><li>one</li><li>two &amp; three</li></ul>", "one\ntwo & three"), ("x &lt;b&gt; &#233; &nbsp;y", "x <b> é \xa0y"), ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "ab\nc"), ("<p>a</p>\n\n\n<p>b</p>", "a\n\nb"), ("<b>bo</b>ld <!-- not this -->", "bold"),
    ("", ""), (None, ""), ("<p>open", "open"), ("<SCRIPT>x</SCRIPT>y", "y"), ("</div></div></div>z", "z"),
]


def test_html_text_by_hand(spark, duck):
    from quarry.sources.readers import html_text

    made = {r.page_id: r.text for r in html_text(spark.createDataFrame(list(enumerate(h for h, _ in HTML)), "page_id bigint, html string")).collect()}
    assert [made[i] for i in range(len(HTML))] == [t for _, t in HTML]
    pages = dict(duck.sql("SELECT page_id, html FROM pages").fetchall())
    got = {r.page_id: r.text for r in QUERIES["html_text"](spark, DATA).collect()}
    assert got.keys() == pages.keys() and not any("<script" in t or "<style" in t or "\n\n\n" in t for t in got.values())


def test_reports_of_chunks_by_hand(spark):
    want = {}
    for r in QUERIES["section_chunks"](spark, DATA).collect():
        n, inherited, chars = want.get(r.doc_id, (0, 0, 0))
        want[r.doc_id] = (n + 1, inherited + r.inherited, chars + r.chars)
    assert {r.doc_id: (r.n, r.inherited, r.chars) for r in QUERIES["unit_chunk_report"](spark, DATA).collect()} == want
    got = {}
    for r in QUERIES["page_html_chunks"](spark, DATA).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    for r in QUERIES["html_text"](spark, DATA).collect():
        assert got.get(r.page_id, 0) == sum(map(substantive, slow_split(r.text, 900, 150, MARKS)))


def test_index_finds_most_exact_neighbours(spark):
    data = "/root/testdata/sf0.1"
    exact = {(r.query_id, r.vec_id) for r in retrieval.cosine_top_k(*catalog.vectors(spark, data), k=10).collect()}
    made = QUERIES["ann_topk"](spark, data).collect()
    found = {(r.query_id, r.vec_id) for r in made}
    assert len(exact) == len(made) == len(found) and len(found & exact) >= 0.9 * len(exact)


def test_entry_works_without_the_llm_folders(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
