"""Toxicity by a convolutional text classifier.

Words are hashed to embeddings (words too rare to learn, by their stems); filters of widths 1 to 3 run over them, each filter's greatest response in the whole
text is kept (max pooling), and a logistic layer scores them. The net is trained in numpy on at most `most` labelled
documents of each label. Thresholds are calibrated by language on labelled rows left out of training, where the
language is guessed from function words of the text itself; a score of 0.5 is at its language's threshold. labels,
lang, source and doc_id are never inputs of a score.

Empty and null texts get the score of no words at all. Texts of any length are taken whole. Rows are independent.
Without labelled rows every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD_BYTES, hash_words, map_text
from quarry.llm.samples import fold, labelled_texts, sigmoid

CELLS, SIZE, FILTERS, WIDTHS = 1 << 17, 12, 8, (1, 2, 3)
SEEN, SEEN_WORD, STEM = 4, 25, 6
#: Function words by which the language group of a text is guessed (fixed values).
FUNCTION_WORDS = {
    "en": "the and of to in that is was for with",
    "de": "der die und das von mit ist den zu nicht",
    "fr": "le la les des et une dans qui pour est",
    "es": "el los las del que y una con para se",
}
GROUPS = [*FUNCTION_WORDS, "other"]
GROUP_OF = [{w.encode() for w in words.split()} for words in FUNCTION_WORDS.values()]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def group(words: list[bytes]) -> int:
    counts = [sum(map(own.__contains__, words)) for own in GROUP_OF]
    return int(np.argmax(counts)) if max(counts) else len(GROUPS) - 1


def cells(words: list[bytes]) -> np.ndarray:
    """Two rows: the cells of the words, and of their stems (the first STEM bytes). Cell 0 is padding."""
    both = hash_words(words), hash_words([b"^" + w[:STEM] for w in words])
    return (np.array(both) % np.uint64(CELLS - 1)).astype(np.int64) + 1


class Net:
    def __init__(self, rows: list[tuple[np.ndarray, int]], epochs: int = 12, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.p = {"e": draw.normal(0, 0.1, (CELLS, SIZE)), "b": np.zeros((len(WIDTHS), FILTERS)), "o": draw.normal(0, 0.3, len(WIDTHS) * FILTERS), "c": np.zeros(1)}
        self.p |= {f"w{k}": draw.normal(0, 0.3, (k, SIZE, FILTERS)) for k in WIDTHS}
        self.p["e"][0] = 0
        self.sums = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}
        weight = {y: len(rows) / (2 * max(1, sum(r[1] == y for r in rows))) for y in (0, 1)}
        for _ in range(epochs if rows else 0):
            for batch in np.array_split(draw.permutation(len(rows)), max(1, len(rows) // 64)):
                self.step([rows[i][0] for i in batch], np.array([rows[i][1] for i in batch]), weight)
        self.tables = {k: [self.p["e"] @ self.p[f"w{k}"][j] for j in range(k)] for k in WIDTHS}

    def pooled(self, ids: np.ndarray, starts: np.ndarray, tables: dict | None) -> tuple[np.ndarray, np.ndarray]:
        """Greatest responses of texts laid end to end, and where they are."""
        best, at = [], []
        own = np.arange(len(ids) - max(WIDTHS) + 1)
        for n, k in enumerate(WIDTHS):
            part = [tables[k][j][ids[own + j]] if tables else self.p["e"][ids[own + j]] @ self.p[f"w{k}"][j] for j in range(k)]
            r = sum(part) + self.p["b"][n]
            top = np.maximum.reduceat(r, starts, axis=0)
            best.append(top)
            if not tables:
                lengths = np.diff(np.append(starts, len(own)))
                at.append(np.maximum.reduceat(np.where(r == np.repeat(top, lengths, axis=0), own[:, None], -1), starts, axis=0))
        return np.concatenate(best, axis=1), np.concatenate(at, axis=1) if at else np.empty(0)

    def lay(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Texts end to end, with padding before and behind each so that no filter meets two of them; and where the
        filters' places of each begin, which is in the padding before it."""
        pad = np.zeros(max(WIDTHS), np.int64)
        ids = np.concatenate([pad[1:], *[x for t in texts for x in (t, pad)]])
        return ids, np.cumsum([0] + [len(t) + len(pad) for t in texts[:-1]])

    def step(self, texts: list[np.ndarray], y: np.ndarray, weight: dict, rate: float = 0.05) -> None:
        ids, starts = self.lay(texts)
        top, at = self.pooled(ids, starts, None)
        h = np.maximum(top, 0)
        error = (sigmoid(h @ self.p["o"] + self.p["c"]) - y) * np.where(y == 1, weight[1], weight[0]) / len(y)
        g = {"o": h.T @ error + 1e-4 * self.p["o"], "c": np.array([error.sum()])}
        back = error[:, None] * self.p["o"] * (top > 0)
        g["b"] = back.sum(axis=0).reshape(len(WIDTHS), FILTERS)
        touched, deltas = [], []
        for n, k in enumerate(WIDTHS):
            w, gw = self.p[f"w{k}"], np.zeros_like(self.p[f"w{k}"])
            b, a = back[:, n * FILTERS : (n + 1) * FILTERS], at[:, n * FILTERS : (n + 1) * FILTERS]
            for j in range(k):
                cell = ids[a + j]
                gw[j] = np.einsum("if,ifs->sf", b, self.p["e"][cell])
                touched.append(cell.ravel())
                deltas.append((b[:, :, None] * w[j].T[None]).reshape(-1, SIZE))
            g[f"w{k}"] = gw
        cell, place = np.unique(np.concatenate(touched), return_inverse=True)
        ge = np.zeros((len(cell), SIZE))
        np.add.at(ge, place, np.concatenate(deltas))
        ge[cell == 0] = 0
        self.sums["e"][cell] += ge * ge
        self.p["e"][cell] -= rate * ge / np.sqrt(self.sums["e"][cell])
        for k, v in g.items():
            self.sums[k] += v * v
            self.p[k] -= rate * v / np.sqrt(self.sums[k])

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        ids, starts = self.lay(texts)
        top, _ = self.pooled(ids, starts, self.tables)
        return sigmoid(np.maximum(top, 0) @ self.p["o"] + self.p["c"])


class Model:
    def __init__(self, rows: list[tuple[int, int, str]]):
        told = [(words_of(t.encode()), y) for _, y, t in rows]
        cut = [(cells(w), y) for w, y in told]
        self.known = bool(rows)
        # Cells that fewer than SEEN documents of the training part hold are padding: rare words can't be learned by heart.
        train = [x for i, x in enumerate(cut) if i % 5]
        seen = sum((np.bincount(np.unique(x), minlength=CELLS) for x, _ in train), np.zeros(CELLS, np.int64))
        self.cell, self.often = np.where(seen >= SEEN, np.arange(CELLS), 0), seen >= SEEN_WORD
        cut = [(self.known_cells(x), y) for x, y in cut]
        self.net = Net([x for i, x in enumerate(cut) if i % 5])
        left = [i for i in range(len(cut)) if i % 5 == 0]
        raw = np.concatenate([self.net.scores([cut[i][0]]) for i in left]) if left else np.empty(0)
        y, groups = np.array([cut[i][1] for i in left]), np.array([group(told[i][0]) for i in left])
        whole = self.threshold(raw, y)
        self.thresholds = np.array([self.threshold(raw[groups == g], y[groups == g], whole) for g in range(len(GROUPS))])

    def known_cells(self, both: np.ndarray) -> np.ndarray:
        """The word's cell where SEEN_WORD documents hold it, else its stem's where SEEN do, else padding."""
        return np.where(self.often[both[0]], both[0], self.cell[both[1]])

    @staticmethod
    def threshold(raw: np.ndarray, y: np.ndarray, whole: float = 0.5) -> float:
        """Midway in the widest range of thresholds with the fewest errors; with few rows of a label, the one over all rows."""
        if min((y == 1).sum(), (y == 0).sum()) < 5:
            return whole
        grid = np.linspace(0.02, 0.98, 97)
        wrong = np.array([((raw >= t) != (y == 1)).sum() for t in grid])
        return float(np.median(grid[wrong == wrong.min()]))

    def predict(self, texts: list[bytes]) -> np.ndarray:
        if not self.known:
            return np.zeros(len(texts))
        out = []
        for at in range(0, len(texts), 64):
            words = [words_of(t) for t in texts[at : at + 64]]
            raw, t = self.net.scores([self.known_cells(cells(w)) for w in words]), self.thresholds[[group(w) for w in words]]
            out.append(np.where(raw >= t, 0.5 + 0.5 * (raw - t) / (1 - t), 0.5 * raw / t))
        return np.clip(np.concatenate(out), 0, 1) if out else np.empty(0)


def score(docs: DataFrame, labelled: DataFrame, most: int = 3000) -> DataFrame:
    """doc_id, score. labelled: doc_id and toxic of the rows to learn from."""
    model = docs.sparkSession.sparkContext.broadcast(Model(labelled_texts(docs, labelled, "toxic", most)))
    return map_text(docs, lambda texts: {"score": pa.array(model.value.predict(texts), pa.float64())}, "score double", as_bytes=True)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    learned = labels.filter(fold(F.col("doc_id"), 5) != 0)
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return score(docs, learned).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
