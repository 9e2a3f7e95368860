"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans: the base patterns, looser forms of addresses and numbers, and long
mixed strings (keys). Base spans (pattern and validity rule) always stay. The other candidates are scored by boosted
trees over format and context features, and one of a kind is added where its calibrated threshold is reached and it
overlaps no span already taken (best score first, then leftmost).

The trees learn from weak labels on the candidates of all documents, whole: a first pass tells them, equal ones are
counted, and each level of a tree takes one pass over the counted rows, of which only the sums of a histogram leave the
tasks. Positive are base spans, looser spellings made of them (without country code, with other separators, with words for @ and dot, dots in brackets) and candidates that meet
their kind's rule behind a key word of the kind. Negative are candidates that fail the rule, stand behind a word for
other numbers, or have a form common in prose (unkeyed names of code, `word at domain`, rows of years, numbers of sections), and such forms made of the
documents' own text. Other candidates have no label. Neither rules nor key words are features, so that the form has to
decide. Each kind's threshold is the lowest score with a precision of PRECISION on candidates of the fourth of texts left out,
base spans not counted; without such a score the kind adds nothing.

Null text is empty. Offsets count code points, end exclusive; very long texts are searched whole. Rows are independent:
repeated rows repeat. An empty table gives an empty table. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, map_text, slices
from quarry.llm.samples import sigmoid

KINDS = ["email", "ip", "card", "phone", "secret"]
PRECISION = 0.99
STEPS = np.linspace(0.5, 0.99, 50)
#: Features, those that are shares, and the grid on which all lie; cuts of a feature; what gradients are counted in.
WIDTH, SHARES, TOP, CUTS, UNIT = 25, [3, 4, 5, 19, 20, 21, 22, 23], 1000, 15, 1 << 24
#: Fixed values of the base contract. A look-behind keeps long digit runs linear and changes no match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE_PHONE = re.compile(r"(?<![0-9.+-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{3,5}(?![0-9.-])")
#: Cards in groups with dots, slashes, underscores, wide or broken spaces between them, and addresses whose dots are
#: bracketed, spelt out or spaced.
CARD_GAP = r"(?:[./_]|\x20?-\x20?|\x20?[\n\t\x20])"
LOOSE_CARD = re.compile(rf"(?<![0-9A-Za-z./_-])[0-9]{{4}}(?:(?:{CARD_GAP}[0-9]{{4}}){{2}}{CARD_GAP}[0-9]{{2,7}}|{CARD_GAP}[0-9]{{6}}{CARD_GAP}[0-9]{{4,5}})(?![0-9])")
IP_GAP = r"(?:\x20?[\[({<]\x20?(?:\.|dot)\x20?[\])}>]\x20?|\x20dot\x20|\x20\.\x20?|\.\x20)"
LOOSE_IP = re.compile(rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:{IP_GAP}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z]|\.[0-9])", re.I)
SECRET = re.compile(r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]{20})(?=[A-Za-z_]*[0-9])[A-Za-z0-9_]+")
#: Key words of each kind before a candidate, and words before numbers that are none of them.
KEY_WORDS = {
    "email": re.compile(r"\b(e-?mail|mail|contact|write to|address)\b\W{0,6}$", re.I),
    "ip": re.compile(r"\b(ip|host|server|address)\b\W{0,6}$", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|credit)\b\W{0,6}$", re.I),
    "phone": re.compile(r"\b(tel|telephone|phone|mobile|call|fax|ring|dial|whatsapp)\b\W{0,6}$", re.I),
}
OTHER_NUMBER = re.compile(r"\b(order|invoice|isbn|issn|ref|serial|version|part|page|date|article|batch|lot|case|sku|id|no|nr)\b\W{0,6}$", re.I)
AT = re.compile(r"\x20?[\[({<]\x20?at\x20?[\])}>]\x20?|\x20at\x20|\x20@\x20|\uff20", re.I)
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63})+", re.I)
KEYED = re.compile(r"(token|secret|password|passwd|api_?key)[\x20\"']*[=:][\x20\"']*$", re.I)
#: Characters of context on each side.
NEAR = 16
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the run of name characters before it (from the end of the last match on) and a domain behind it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in NAME_CHARS:
            start -= 1
        free_at = at + 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            found.append((start, domain.end()))
            free = free_at = domain.end()
        at = text.find("@", free_at)
    return found


def loose_emails(text: str) -> list[tuple[int, int]]:
    """Addresses whose @ or dots are spelt out or spaced."""
    found = []
    for at in AT.finditer(text):
        start = at.start()
        while start > max(0, at.start() - 64) and text[start - 1] in NAME_CHARS:
            start -= 1
        if start < at.start() and (domain := LOOSE_DOMAIN.match(text, at.end())):
            found.append((start, domain.end()))
    return found


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, piece: str) -> bool:
    if kind == "secret":
        return True
    if kind == "email":
        last = re.split("[^A-Za-z0-9]+", piece)[-1]
        return len(last) > 1 and last.isalpha()
    if kind == "ip":
        piece = ".".join(re.findall("[0-9]+", piece))
        return all(len(own) <= 3 and int(own or 0) <= 255 for own in (p.lstrip("0") for p in piece.split(".")))
    digits = digits_of(piece)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and other proposals."""
    base = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    other = [("email", a, b) for a, b in loose_emails(text)]
    if re.search("[0-9]", text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            for m in pattern.finditer(text):
                long_enough = kind != "card" or m.end() - m.start() >= 12
                if long_enough:
                    (base if valid(kind, m.group()) else other).append((kind, m.start(), m.end()))
        other += [("phone", m.start(), m.end()) for m in LOOSE_PHONE.finditer(text)]
        other += [(kind, m.start(), m.end()) for kind, pattern in (("card", LOOSE_CARD), ("ip", LOOSE_IP)) for m in pattern.finditer(text) if valid(kind, m.group())]
        other += [("secret", m.start(), m.end()) for m in SECRET.finditer(text)]
    return base, other


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of a candidate, and its context: the characters next to it and what the NEAR characters around it are."""
    piece = text[start:end]
    digits = digits_of(piece)
    n = end - start
    parts = re.split(r"[^0-9A-Za-z]+", piece)
    sizes = [len(p) for p in parts if p] or [0]
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    share = lambda near, kind: sum(map(kind, near)) / NEAR
    return [
        float(KINDS.index(kind)), float(n), float(len(digits)), len(digits) / n, float(sum(c.isupper() for c in piece)) / n, len(set(piece)) / min(n, 40),
        float(len(sizes)), float(max(sizes)), float(min(sizes)), float(sizes[0]), float(sizes[-1]), float(text[max(0, start - 1) : start].isalnum()),
        float(text[end : end + 1].isalnum()), float(any(c in "([{<" for c in piece)), float(piece.count(" ")), float(piece.count("_")),
        float(sum(p.lower() in ("at", "dot") for p in parts)), float(piece.count(".")), float(set(piece.lower()) <= set("0123456789abcdef")),
        float(sum(a.isdigit() != b.isdigit() for a, b in zip(piece, piece[1:], strict=False))) / n,
        (kind == "card") * digits.count("0") / max(1, len(digits)), (kind == "card") * sum(p[:2] in ("19", "20") for p in parts) / len(sizes),
        share(before, str.isdigit), share(after, str.isdigit), float(before.rstrip().endswith((":", "="))),
    ]


def label(text: str, kind: str, start: int, end: int) -> float | None:
    """Weak label of a candidate that isn't a base span, by what no feature shows; null without evidence."""
    piece, before = text[start:end], text[max(0, start - 24) : start]
    if kind == "secret":
        return float(bool(KEYED.search(before)))
    if not valid(kind, piece) or (kind != "email" and OTHER_NUMBER.search(before)):
        return 0.0
    if KEY_WORDS[kind].search(before):
        return 1.0
    return 0.0 if kind == "email" and re.search(r"\x20at\x20", piece, re.I) and "dot" not in piece.lower() else None


def variants(kind: str, piece: str) -> list[tuple[str, float]]:
    """Looser spellings of a base span, and forms of the same characters that are no personal data, with their labels."""
    if kind == "email":
        out, (name, _, domain) = [], piece.rpartition("@")
        plain = re.split("[^A-Za-z]", name)[0] or "x", re.sub("[0-9]", "", domain)
        for who, where in ((name, domain), plain):  # names with and without digits, so that these don't decide
            spelt = [f"{who} (at) {where}", f"{who} [at] {where.replace('.', ' [dot] ')}", f"{who} at {where.replace('.', ' dot ')}", f"{who} @ {where}", f"{who}\uff20{where}"]
            out += [(x, 1.0) for x in spelt] + [(f"{who} at {where}", 0.0)] * 2
        return out
    if kind == "phone":
        digits, (_, *local) = digits_of(piece), re.findall("[0-9]+", piece)
        spelt = [c.join(local) for c in "-. "] + ([f"({local[0]}) {'-'.join(local[1:])}"] if len(local) > 1 else [])
        dates = [c.join((digits[-8:-6], digits[-6:-4], digits[-4:])) for c in "-. "] + [c.join((digits[-9:-6], digits[-6:-3], digits[-3:])) for c in "-. "]
        return [(x, 1.0) for x in spelt if LOOSE_PHONE.fullmatch(x) and valid("phone", x)] + [(x, 0.0) for x in dates if LOOSE_PHONE.fullmatch(x)]
    if kind == "card":
        digits = digits_of(piece)
        parts = [digits[:4], digits[4:10], digits[10:]] if len(digits) == 15 else [digits[i : i + 4] for i in range(0, 12, 4)] + [digits[12:]]
        # Rows of years and of round numbers have the same shape.
        years = [("19" if int(d[-1]) % 2 else "20") + d[:2] for d in (parts + parts)[:4]]
        rounds = [d[0] + "000" for d in (parts + parts)[:4]]
        made = [(c.join(parts), 1.0) for c in (".", "/", "_", "\n", "  ", " - ")] + [(c.join(x), 0.0) for x in (years, rounds) for c in (".", "/", "\n", "  ", " - ")]
        return [(x, y) for x, y in made if LOOSE_CARD.fullmatch(x)]
    if kind == "ip":
        own = re.findall("[0-9]+", piece)
        counts = [str(int(o[-1]) % 9 + 1) for o in own]  # numbers of sections and items
        spelt = lambda parts: [c.join(parts) for c in ("[.]", "(.)", " [dot] ", "(dot)", " dot ", " . ", ". ")]
        some = [(x, float(max(map(len, own)) > 1)) for x in spelt(own)]
        return [(x, y) for x, y in some + [(c.join(counts), 0.0) for c in (". ", " . ")] if LOOSE_IP.fullmatch(x)]
    return []


def code_names(text: str, start: int) -> list[str]:
    """Names as in code, made of the words before a secret."""
    words = re.findall("[A-Za-z]+", text[max(0, start - 200) : start])
    named = [x for k in (4, 5, 7) for own in [words[-k:]] for x in ("_".join([*own, "v2"]), "".join(w.title() for w in own) + "2", "_".join(own).upper() + "_01")]
    return [x for x in dict.fromkeys(named) if SECRET.fullmatch(x)]


def grid(rows: list[list[float]]) -> np.ndarray:
    """Features as whole numbers: shares in thousandths, counts up to TOP."""
    x = np.array(rows, np.float64).reshape(len(rows), -1)
    x[:, SHARES] *= TOP
    return np.minimum(np.rint(x), TOP).astype("<i2")


def quantiles(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct cuts of a feature, from all its values in order and how often each occurs."""
    below = np.cumsum(counts)
    return np.unique(values[np.searchsorted(below, np.linspace(0, 1, CUTS + 2)[1:-1] * below[-1])])


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(own, x[:, j]) for j, own in enumerate(cuts)], axis=1).astype(np.uint8)


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, over quantile cuts.

    A tree grows level by level from sums of gradients by node, feature and bin, wherever the rows lie: `histograms` gives
    them for a level. Gradients are summed as whole numbers, so that no order of rows changes a tree. Node i has the
    children 2i and 2i + 1; feature -1 marks a leaf.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, **how):
        cuts = [quantiles(*np.unique(x[:, j], return_counts=True)) for j in range(x.shape[1])]
        bins, n = binned(x, cuts), np.ones(len(y), np.int64)
        self.learn(cuts, float(y.mean()), lambda level: self.histograms(bins, y, n, level), **how)

    def learn(self, cuts: list[np.ndarray], mean: float, histograms, trees: int = 40, depth: int = 3, rate: float = 0.3) -> None:
        self.cuts, self.depth, self.rate = cuts, depth, rate
        self.start = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
        self.feature, self.cut, self.value = np.zeros((0, 2 << depth), np.int64), np.zeros((0, 2 << depth), np.int64), np.zeros((0, 2 << depth))
        for _ in range(trees):
            self.feature = np.vstack([self.feature, np.full(2 << depth, -1)])
            self.cut, self.value = np.vstack([self.cut, np.zeros(2 << depth, np.int64)]), np.vstack([self.value, np.zeros(2 << depth)])
            for level in range(depth):
                if level and not (self.feature[-1, 1 << level - 1 : 1 << level] >= 0).any():
                    break
                self.split(histograms(level), level)

    def split(self, sums: np.ndarray, level: int) -> None:
        """Splits the nodes of a level where that is worth it. sums: g, h and n by node, feature and bin."""
        worth = lambda a, b: a * a / (b + 1.0)
        for i in range(1 << level):
            node, (g, h) = (1 << level) + i, sums[:2, i].astype(np.float64) / UNIT
            if node > 1 and self.feature[-1, node // 2] < 0:
                continue
            all_g, all_h = g[0].sum(), h[0].sum()
            self.value[-1, node] = -all_g / (all_h + 1.0)
            if sums[2, i, 0].sum() < 10:
                continue
            left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
            gain = worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h) - worth(all_g, all_h)
            j, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if gain[j, cut] > 1e-4:
                self.feature[-1, node], self.cut[-1, node] = j, cut
                for child, own_g, own_h in ((2 * node, left_g[j, cut], left_h[j, cut]), (2 * node + 1, all_g - left_g[j, cut], all_h - left_h[j, cut])):
                    self.value[-1, child] = -own_g / (own_h + 1.0)

    def nodes(self, bins: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """The node in which each row ends, by tree."""
        node, row = np.ones((len(bins), len(trees)), np.int64), np.arange(len(bins))[:, None]
        for _ in range(self.depth):
            feature = self.feature[trees, node]
            node = np.where(feature >= 0, 2 * node + (bins[row, np.maximum(feature, 0)] > self.cut[trees, node]), node)
        return node

    def scores(self, bins: np.ndarray, trees: int) -> np.ndarray:
        own = np.arange(trees)
        return sigmoid(self.start + self.rate * self.value[own, self.nodes(bins, own)].sum(axis=1))

    def histograms(self, bins: np.ndarray, y: np.ndarray, n: np.ndarray, level: int) -> np.ndarray:
        """Sums of gradients, curvatures and rows of the newest tree's level, by node, feature and bin."""
        p = self.scores(bins, len(self.feature) - 1)
        node = self.nodes(bins, np.array([len(self.feature) - 1]))[:, 0] - (1 << level)
        here = (node >= 0) & (node < 1 << level)
        slots = ((node[here, None] * bins.shape[1] + np.arange(bins.shape[1])) * (CUTS + 1) + bins[here]).ravel()
        shape = (1 << level, bins.shape[1], CUTS + 1)
        made = [np.bincount(slots, np.repeat((np.rint(v * UNIT) * n)[here], bins.shape[1]), np.prod(shape)) for v in (p - y, p * (1 - p) + 1e-6, 1 / UNIT)]
        return np.rint(np.array(made)).astype(np.int64).reshape(3, *shape)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.scores(binned(x, self.cuts), len(self.feature))


class Spans:
    """Spans of one list, in which overlaps are looked up by place."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.reach = [a for a, _ in spans], list(itertools.accumulate((b for _, b in spans), max))

    def meet(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


def examples(text: str) -> Iterator[tuple[bool, float, list[float]]]:
    """Whether a base span, label and features of a text's candidates, and of forms made of them."""
    base, other = candidates(text)
    for kind, a, b in base:
        yield True, 1.0, features(text, kind, a, b)
        before, after = text[max(0, a - NEAR) : a], text[b : b + NEAR]
        for v, y in variants(kind, text[a:b]):
            yield False, y, features(before + v + after, kind, len(before), len(before) + len(v))
    taken = {kind: Spans([(a, b) for k, a, b in base if k != kind or kind == "phone"]) for kind in KINDS} if other else {}
    for kind, a, b in other:
        if taken[kind].meet(a, b) or (y := label(text, kind, a, b)) is None:
            continue  # part of a base span, or without evidence
        yield False, y, features(text, kind, a, b)
        if kind == "secret" and y:
            before, after = text[max(0, a - NEAR) : a], text[b : b + NEAR]
            for v in code_names(text, a):  # in prose, and where the secret stands
                for x in (before, "such as it is "):
                    yield False, 0.0, features(x + v + after, kind, len(x), len(x) + len(v))


class Model:
    """Trees and thresholds, fitted on a few texts here, on a table by `learned`."""

    def __init__(self, texts: list[str]):
        rows = [(i % 4 == 0, *e) for i, text in enumerate(texts) for e in examples(text)]
        self.thresholds, self.trees = {}, None
        left, is_base, y = (np.array([r[c] for r in rows]) for c in range(3)) if rows else [np.zeros(0, bool)] * 3
        if not left.any() or len(set(y[~left].tolist())) < 2:
            return
        x = grid([r[3] for r in rows])
        self.trees, own = Boosted(x[~left], y[~left]), left & ~is_base
        self.settle(self.steps(x[own], self.trees.predict(x[own]), y[own], np.ones(own.sum(), np.int64)))

    @staticmethod
    def steps(x: np.ndarray, score: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Rows by kind, thresholds reached and label."""
        slots = (x[:, 0].astype(np.int64) * (len(STEPS) + 1) + np.searchsorted(STEPS, score, "right")) * 2 + (y > 0)
        return np.rint(np.bincount(slots, n, len(KINDS) * (len(STEPS) + 1) * 2)).astype(np.int64)

    def settle(self, steps: np.ndarray) -> None:
        reached = steps.reshape(len(KINDS), len(STEPS) + 1, 2)[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
        for kind, own in zip(KINDS, reached, strict=True):
            for t, (wrong, right) in zip(STEPS, own.tolist(), strict=True):
                if wrong + right >= 5 and right / (wrong + right) >= PRECISION:
                    self.thresholds[kind] = float(t)
                    break

    @classmethod
    def learned(cls, texts: DataFrame) -> Model:
        """Fitted on all candidates of all texts. Equal rows are counted, the rest stays where it is; sums by cell of a
        histogram come to the driver."""
        model, ws = cls([]), Workspace(texts.sparkSession, "pii")

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = ((left, y, x) for left, text in zip(*(batch.column(c).to_pylist() for c in ("left", "text")), strict=True) for is_base, y, x in examples(text) if not (left and is_base))
                while some := list(itertools.islice(rows, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some]), pa.array([r[1] > 0 for r in some]), pa.array([r.tobytes() for r in grid([r[2] for r in some])])], names=["left", "y", "x"])

        left = (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("left")  # copies stay together
        rows = texts.filter("text is not null").select("text", left).mapInArrow(told, "left boolean, y boolean, x binary")
        rows = ws.save(rows.groupBy("left", "y", "x").agg(F.count(F.lit(1)).alias("n")), "examples")
        labels = {(r.left, r.y): r.n for r in rows.groupBy("left", "y").agg(F.sum("n").alias("n")).collect()}
        wrong, right = labels.get((False, False), 0), labels.get((False, True), 0)
        if not wrong or not right or not any(left for left, _ in labels):
            ws.drop("examples")
            return model
        values = summed(rows.filter("not left"), lambda x, y, n: np.rint(np.bincount((np.arange(x.shape[1]) * (TOP + 1) + x).ravel(), np.repeat(n, x.shape[1]), x.shape[1] * (TOP + 1))).astype(np.int64), "<i2")
        values = values.reshape(-1, TOP + 1)
        cuts = [quantiles(np.flatnonzero(own), own[own > 0]) for own in values]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = binned(matrix(batch.column("x"), "<i2"), cuts)
                yield pa.RecordBatch.from_arrays([batch.column("left"), batch.column("y"), pa.array([b.tobytes() for b in bins], pa.binary()), batch.column("n")], names=["left", "y", "x", "n"])

        rows = rows.mapInArrow(cut, "left boolean, y boolean, x binary, n bigint").groupBy("left", "y", "x").agg(F.sum("n").alias("n"))
        rows = ws.save(rows, "binned")
        trees = Boosted.__new__(Boosted)

        def gathered(level: int) -> np.ndarray:
            own = summed(rows.filter("not left"), lambda bins, y, n: trees.histograms(bins, y, n, level).ravel(), "u1", (3 << level) * len(cuts) * (CUTS + 1))
            return own.reshape(3, 1 << level, len(cuts), CUTS + 1)

        trees.learn(cuts, right / (wrong + right), gathered)
        model.trees = trees
        held = ws.spark.read.schema("left boolean, y boolean, x binary, n bigint").parquet(f"{ws.path}/examples").filter("left")
        model.settle(summed(held, lambda x, y, n: cls.steps(x, trees.predict(x), y, n), "<i2", len(KINDS) * (len(STEPS) + 1) * 2))
        ws.drop("examples", "binned")
        return model

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans and added spans."""
        base, other = candidates(text)
        # Numbers that fail the rule of cards or addresses are there to learn from, never to be added.
        other = [(k, a, b) for k, a, b in other if k in self.thresholds and (k not in ("ip", "card") or valid(k, text[a:b]))]
        if not other or self.trees is None:
            return base, []
        score = self.trees.predict(grid([features(text, *c) for c in other]))
        taken, added, more = Spans([(a, b) for _, a, b in base]), [], []  # more: added spans in order, apart from one another
        for p, (kind, a, b) in sorted(zip(score.tolist(), other, strict=True), key=lambda c: (-c[0], c[1][1])):
            k = bisect.bisect_left(more, (b,))
            if p >= self.thresholds[kind] and not taken.meet(a, b) and (not k or more[k - 1][1] <= a):
                more.insert(k, (a, b))
                added.append((kind, a, b))
        return base, added


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    own = column.to_pylist()
    return np.frombuffer(b"".join(own), kind).reshape(len(own), -1)


def summed(rows: DataFrame, cells: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], kind: str, size: int = WIDTH * (TOP + 1)) -> np.ndarray:
    """Sums over all rows (x, y, n) of an array of `size` whole numbers that `cells` makes of a batch: one array of each task
    comes to the driver (24 to 200 KB), no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += cells(matrix(batch.column("x"), kind), batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64), batch.column("n").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    made = rows.select("x", "y", "n").mapInArrow(run, "v binary").collect()
    return sum((np.frombuffer(r.v, np.int64) for r in made), np.zeros(size, np.int64))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end), by start, then kind as listed."""
    model = docs.sparkSession.sparkContext.broadcast(Model.learned(docs.select("text")))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(texts: list[str]) -> dict:
        found = [model.value.spans(t) for t in texts]
        rows = lambda spans: [{"kind": k, "start": a, "end": b} for a, _, b, k in sorted((a, KINDS.index(k), b, k) for k, a, b in spans)]
        return {"base": pa.array([rows(b) for b, _ in found], kind), "added": pa.array([rows(a) for _, a in found], kind)}

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_text(docs, run, f"base {span}, added {span}")


def report(docs: DataFrame) -> DataFrame:
    number = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s.kind)
    ordered = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s.start.alias("start"), place(s).alias("place"), s.end.alias("end"), s.kind.alias("kind")))), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    total = (F.size("base") + F.size("added")).cast("bigint").alias("n_spans")
    return find(docs).select("doc_id", *[number(k) for k in KINDS[:4]], total, F.sha2(shown("base"), 256).alias("base_sha256"), shown(ordered).alias("spans"))
