"""Language identification by error-correcting output codes.

Every learned language has a codeword; for each of its bits a binary classifier over hashed byte n-grams (1 to 3) of
the text is fitted. Decoding sums, for each language, the logistic loss of every bit's margin against the codeword,
weighted by the bit's accuracy on rows left out of fitting, and takes the least; `ambiguous` flags a small lead over
the next. lang, source and doc_id are never inputs of a prediction.

A null text or one without a letter is `und` with score 0. Ties go to the language first in order. Without learned
rows all texts are `und`. Rows are independent. Fitting takes at most `most` documents of each language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_text
from quarry.llm.samples import fold, labelled_texts, logistic

CELLS = 4096
AMBIGUOUS = 0.2


def features(text: bytes) -> np.ndarray:
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    counts = np.bincount(b, minlength=CELLS).astype(np.float64)
    if len(b) > 1:
        two = (b[:-1] << np.uint32(8)) | b[1:]
        counts += np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=CELLS)
        if len(b) > 2:
            three = (two[:-1] << np.uint32(8)) | b[2:]
            counts += np.bincount((three * np.uint32(2246822519)) >> np.uint32(20), minlength=CELLS)
    root = np.sqrt(counts)
    return (root / (np.linalg.norm(root) or 1)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n rows of +-1. Up to six languages: all splits; more: random dense code, the best of some draws by distance."""
    if n <= 6:
        bits = [[1 if k == 0 or not split >> (k - 1) & 1 else -1 for k in range(n)] for split in range(1, 2 ** max(n - 1, 1))]
        return np.array(bits).T.reshape(n, -1)
    draw, width = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    return max((np.where(draw.random((n, width)) < 0.5, -1, 1) for _ in range(50)), key=lambda c: min((c[i] != c[j]).sum() for i in range(n) for j in range(i)))


class Model:
    def __init__(self, rows: list[tuple[int, str, str]]):
        self.languages = sorted({x[1] for x in rows})
        if not rows:
            return
        x = np.array([features(t.encode()) for _, _, t in rows])
        y = np.array([self.languages.index(lang) for _, lang, _ in rows])
        self.code = codewords(len(self.languages))
        bits = (self.code[y] + 1) / 2
        left = np.arange(len(x)) % 5 == 0
        self.weights = logistic(x[~left] * 8, bits[~left]) if (~left).any() else logistic(x * 8, bits)
        right = ((self.margins(x[left]) > 0) == (bits[left] > 0.5)).mean(axis=0)
        self.trust = np.clip(right, 0.5, 0.999) - 0.49

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x * 8 @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[str]) -> tuple[list, list, list]:
        out = [("und", 0.0, True)] * len(texts)
        some = [i for i, t in enumerate(texts) if self.languages and any(map(str.isalpha, t))]
        for at in range(0, len(some), 256):
            ids = some[at : at + 256]
            f = np.clip(self.margins(np.array([features(texts[i].encode()) for i in ids])), -12, 12)
            loss = (np.log1p(np.exp(-f[:, None, :] * self.code[None])) * self.trust).sum(axis=2)
            share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
            share /= share.sum(axis=1, keepdims=True)
            for i, row in zip(ids, share, strict=True):
                best = int(row.argmax())
                second = np.partition(row, -2)[-2] if len(row) > 1 else 0.0
                out[i] = (self.languages[best], float(row[best]), bool(row[best] - second < AMBIGUOUS))
        return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])


def identify(docs: DataFrame, learn_from: DataFrame, most: int = 600) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous. learn_from: doc_id and lang of the rows to learn from."""
    model = docs.sparkSession.sparkContext.broadcast(Model(labelled_texts(docs.filter("text is not null"), learn_from, "lang", most)))

    def run(texts: list[str]) -> dict:
        lang, score, ambiguous = model.value.predict(texts)
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "ambiguous": pa.array(ambiguous, pa.bool_())}

    return map_text(docs, run, "lang_pred string, score double, ambiguous boolean")


def report(docs: DataFrame) -> DataFrame:
    learned = docs.filter(fold(F.col("doc_id"), 4) != 2).filter("text is not null")
    return identify(docs, learned).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


