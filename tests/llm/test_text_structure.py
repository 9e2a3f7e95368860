"""Periodic runs, SentencePiece encoding and tokenizer alignment against brute force and the public libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import alignment, pieces, queries, runs

SCHEMA = "doc_id bigint, text string, start bigint, pairs string, ids int, links int"


def make(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", 2, None) for i, t in texts], SCHEMA)


def all_runs(x):
    found = {}
    for q in range(1, len(x) // 4 + 1):
        at = 0
        while at + q < len(x):
            stop = at
            while stop + q < len(x) and x[stop] == x[stop + q]:
                stop += 1
            if stop - at + q >= max(6, 4 * q) and stop > at:
                found.setdefault((at, stop - at + q), q)
            at = max(stop, at + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def wordy(draw):
    kind = draw.randrange(5)
    if kind == 0:
        return [draw.randrange(2) for _ in range(draw.randrange(60))]
    if kind == 1:
        return [0] * draw.randrange(50)
    if kind == 2:
        return [w for _ in range(15) for w in [draw.randrange(3) for _ in range(draw.randrange(1, 5))] * draw.randrange(1, 8)]
    if kind == 3:
        period = [draw.randrange(9) for _ in range(draw.randrange(1, 15))]
        return [*range(20, 29), *period * 6, *period[:3], *range(30, 39)]
    return [w for _ in range(6) for w in [draw.randrange(50), *[0] * draw.randrange(3, 20)]]


def test_runs_are_all_runs():
    draw = random.Random(1)
    for _ in range(150):
        texts = [np.array(wordy(draw), np.int64) for _ in range(draw.randrange(1, 6))]
        assert runs.find(texts) == [all_runs(t.tolist()) for t in texts]


def test_run_of_known_text(spark):
    row = runs.runs(make(spark, [(1, "x a b a b a b a b y")])).first()
    assert [tuple(r) for r in row.runs] == [(1, 8, 2)] and row.collapsed == "x a b y" and row.n_words == 10


@pytest.mark.parametrize("words", [["a"] * 60_000, ["a", "b", "c"] * 20_000, [w for k in range(120) for w in [f"w{k}", *["a"] * 120]]])
def test_long_texts_of_runs(words):
    found = runs.find(runs.split([" ".join(words).encode()])[1])[0]
    assert found == ([(0, 60_000, len(set(words)))] if len(set(words)) < 4 else [(121 * k + 1, 120, 1) for k in range(120)])


def test_runs_report(spark):
    draw = random.Random(2)
    texts = [(i, " ".join(f"w{w}" for w in wordy(draw))) for i in range(120)]
    texts += [(200 + i, "\t".join(f"v{draw.randrange(10**6)}" for _ in range(90))) for i in range(60)]
    texts += [(300, None), (301, ""), (302, " \n\x0b\x0c\r"), (303, "one"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "b b b b b b b")]
    made = Counter(tuple(r) for r in runs.report(runs.planted(make(spark, texts))).collect())
    want = Counter()
    planted = 0
    for i, t in texts:
        w = (t or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            planted += 1
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = all_runs(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        gone = {j for s, n, q in found for j in range(s + q, s + n)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[i, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(kept).hexdigest()] += 1
    assert planted > 5 and made == want
    assert runs.report(make(spark, [])).collect() == []


LETTERS = [" ", "  ", "\n", "\t", " ", "a", "the", "ing", "don't", "é", "日", "本", "🎉", "ü", "▁", "\0", "0", "12", "<|endoftext|>", "<s>", "<0x41>", "<unk>", "क्ष", "\x1c", "\x85", "x" * 60, "́", "한국", "Ω", ".", ",", "�"]


def strings(seed, n, longest=14):
    draw = random.Random(seed)
    for k in range(n):
        if k % 4:
            yield "".join(draw.choice(LETTERS) for _ in range(draw.randrange(longest)))
        else:
            yield "".join(chr(draw.choice([draw.randrange(1, 0xD800), draw.randrange(0xE000, 0x110000), draw.randrange(32, 127), 32])) for _ in range(draw.randrange(longest)))


@pytest.fixture(scope="module")
def files():
    P = pytest.importorskip("public_tokenizers")
    pytest.importorskip("sentencepiece"), pytest.importorskip("tokenizers")
    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def test_pieces_are_the_librarys(spark, files):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=files[1])
    texts = [None, "", "x" * 20_000, "the " * 20_000, "日本" * 5000, *strings(3, 1500)]
    made = {r.doc_id: r for r in pieces.encode(make(spark, list(enumerate(texts))), files[1]).collect()}
    told = {r.doc_id: r for r in pieces.encode(make(spark, list(enumerate(texts))), files[1], digests=True).collect()}
    assert len(made) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", return_type=int)
        spans = [(p.begin, p.end) for p in library.encode(t or "", return_type="proto").pieces]
        assert made[i].ids == ids and made[i].decoded == library.decode(ids) and made[i].n_tokens == len(ids)
        assert list(zip(made[i].begins, made[i].ends, strict=True)) == spans
        assert told[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert told[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and told[i].n_tokens == len(ids)


def test_decoding_of_any_ids(files):
    import sentencepiece

    library, own, draw = sentencepiece.SentencePieceProcessor(model_file=files[1]), pieces.model(files[1]), random.Random(4)
    for _ in range(2000):
        ids = [draw.choice([draw.randrange(32_000), draw.randrange(262)]) for _ in range(draw.randrange(12))]
        assert own.decode(ids) == library.decode(ids)


def test_a_worker_that_forgets_words(files, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    own = pieces.Model(open(files[1], "rb").read())
    assert [own.encode(t)[0].tolist() for t in ("a b c d e f", "a b c d e f")] == [pieces.model(files[1]).encode("a b c d e f")[0].tolist()] * 2


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("removed", [True, False])
def test_compiled_character_maps(rule, prefix, removed):
    library = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as proto

    rules = library.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=removed)
    keys = pieces.CharacterMap(proto.ModelProto.FromString(rules.serialized_model_proto()).normalizer_spec.precompiled_charsmap)
    draw = random.Random(3)
    letters = [" ", "  ", "a", "the", "é", "日", "ﬁ", "Ａ", "①", "　", "\t", "\n", "é", "ガ", "ｶﾞ", "²", " ", "…", "​", "x", "▁", "ﷺ", "한", "\x01"]
    for _ in range(400):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(9)))
        normal, offsets = rules.normalize(text, with_offsets=True)
        own, align = pieces.normalise(text, keys, prefix, removed)
        heads = [i for i, b in enumerate(own) if b & 0xC0 != 0x80] + [len(own)]
        assert own.decode() == normal and [len(text.encode()[: align[i]].decode()) for i in heads] == list(offsets)


def aligned(text, a, b):
    """Tokens of both with their bytes, by definition."""
    if not text:
        return [], [], []
    alphabet = alignment.byte_alphabet()
    first, second = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, return_type=int)
    a_raw = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in first]
    b_raw = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in second]
    if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
        return [], [], []
    a_ends, b_ends = np.cumsum([len(r) for r in a_raw]).tolist(), np.cumsum([len(r) for r in b_raw]).tolist()
    groups, i, j = [], 0, 0
    for cut in sorted({*a_ends} & {*b_ends}):
        x, y = a_ends.index(cut) + 1, b_ends.index(cut) + 1
        groups.append((first[i:x], second[j:y]))
        i, j = x, y
    return first, second, groups


@pytest.mark.parametrize("hot", [10**6, 400, 20])
def test_alignment(spark, files, hot, monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    monkeypatch.setattr(alignment, "SUMMED", 1000)
    a, b = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    a.encode_special_tokens = True
    texts = [None, "", "x" * 3000, "the old the new " * 50, "a▁b", "日本" * 300, *strings(7, 400), *strings(7, 40)]
    parts = [aligned(t, a, b) for t in texts]
    links = Counter((p[-1], q[-1]) for _, _, groups in parts for p, q in groups)
    most = {}
    for (_, q), n in links.items():
        most[q] = max(n, most.get(q, 0))
    made = {r.doc_id: r for r in alignment.align(make(spark, list(enumerate(texts))), *files, digests=True, hot=hot).collect()}
    assert len(made) == len(texts)
    for i, (first, second, groups) in enumerate(parts):
        pairs = [(p[-1], q[-1]) for p, q in groups]
        told = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        want = (len(first), len(second), len(groups), len(groups), sum(links[p] == most[p[1]] for p in pairs), sum(links[p] for p in pairs), hashlib.sha256(told.encode()).hexdigest() if groups else "")
        r = made[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want, texts[i]


def test_alignment_of_no_rows(spark, files):
    assert alignment.align(make(spark, []), *files).collect() == []
    only = alignment.align(make(spark, [(1, None), (1, "")]), *files).collect()
    assert [(r.n_a, r.n_links, r.n_best, r.count_sum, r.groups) for r in only] == [(0, 0, 0, 0, "")] * 2


def test_new_queries_are_registered():
    assert {"op11_periodic_runs", "op12_sentencepiece", "op13_alignment"} <= set(queries.QUERIES)
