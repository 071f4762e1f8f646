"""Language identification by a byte convolutional network.

Texts are cut whole into windows of ``WINDOW`` bytes. Filters of widths 2, 3 and 4 over
one-hot bytes, ReLU, max pooling over the window and a softmax layer are trained here, in
numpy with Adam, on windows of a bounded sample: at most ``per_language`` documents of each
language (those with the smallest hash of their id) and ``windows_per_doc`` windows spread
over each. For scoring, pairs of bytes are looked up in tables summed beforehand from the
filters, so a position costs two row look-ups. A document's class scores are the softmax of
its windows' mean logits.

``calibrate`` learns from all held-out rows with a language how low a score may be: below it, an
identification is wrong rather than right. ``keep_identified`` drops the texts below.

Defined results: texts that are null or have no letter are ``und`` with score 0; so is every
text when nothing could be learned. Null ids pass through and are neither learned from nor
held out. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import bytesvec as bv

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Scores from which the least one to keep is chosen, and the held-out rows that this takes at least.
EDGES, LEAST = np.arange(1001) / 1000, 50
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def fold_of(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 3


def held_out(doc_id: str | Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 1, F.lit(False))


class ByteCNN:
    """Multi-width byte convolutions, max pooling, softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.w = {k: rng.normal(0, 0.3, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS}
        self.b = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        n = FILTERS * len(WIDTHS)
        self.v = rng.normal(0, 0.3, (n, len(classes))).astype(np.float32)
        self.c = np.zeros(len(classes), np.float32)
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 11) -> ByteCNN:
        rng = np.random.default_rng(seed)
        params = [self.v, self.c] + [a for k in WIDTHS for a in (self.w[k], self.b[k])]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t, steps = 0, max(1, epochs * -(-len(x) // batch))
        rows = np.arange(FILTERS)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
                n = len(xb)
                pooled, places = [], []
                for k in WIDTHS:
                    a = sum(self.w[k][o][xb[:, o : WINDOW - k + 1 + o]] for o in range(k)) + self.b[k]
                    p = a.argmax(1)
                    places.append(p)
                    pooled.append(np.take_along_axis(a, p[:, None, :], 1)[:, 0])
                raw = np.concatenate(pooled, 1)
                h = np.maximum(raw, 0)
                z = h @ self.v + self.c
                z -= z.max(1, keepdims=True)
                q = np.exp(z)
                q /= q.sum(1, keepdims=True)
                q[np.arange(n), yb] -= 1
                q /= n
                grads = [h.T @ q + 1e-4 * self.v, q.sum(0)]
                dh = (q @ self.v.T) * (raw > 0)
                for j, k in enumerate(WIDTHS):
                    d = dh[:, j * FILTERS : (j + 1) * FILTERS]
                    g = np.zeros_like(self.w[k])
                    for o in range(k):
                        np.add.at(g[o], (np.take_along_axis(xb, places[j] + o, 1), np.broadcast_to(rows, d.shape)), d)
                    grads += [g, d.sum(0)]
                t += 1
                lr = rate * (1 - 0.9 * t / steps)
                for p, g, u, r in zip(params, grads, m, s):
                    u += 0.1 * (g - u)
                    r += 0.001 * (g * g - r)
                    p -= lr * (u / (1 - 0.9**t)) / (np.sqrt(r / (1 - 0.999**t)) + 1e-8)
        self._tables = None
        return self

    def tables(self) -> list[np.ndarray]:
        """Sums of the filters' weights for each pair of bytes, and the third byte's of width 3."""
        if self._tables is None:
            w2, w3, w4 = (self.w[k] for k in WIDTHS)
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS).astype(np.float32)
            self._tables = [pair(w2[0], w2[1]) + self.b[2], pair(w3[0], w3[1]) + self.b[3], w3[2].copy(), pair(w4[0], w4[1]) + self.b[4], pair(w4[2], w4[3])]
        return self._tables

    def logits(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        """Class logits of windows, an array of bytes with WINDOW columns."""
        t2, t3, third, t4, t4b = self.tables()
        f = FILTERS
        h = np.empty((len(x), 3 * f), np.float32)
        for i in range(0, len(x), block):
            # positions lead, so that pooling runs over whole contiguous planes
            y = np.ascontiguousarray(x[i : i + block].T)
            g = (y[:-1].astype(np.intp) << 8) | y[1:]
            out = h[i : i + block]
            out[:, :f] = np.take(t2, g, axis=0).max(0)
            a = np.take(t3, g[:-1], axis=0)
            a += np.take(third, y[2:], axis=0)
            out[:, f : 2 * f] = a.max(0)
            a = np.take(t4, g[:-2], axis=0)
            a += np.take(t4b, g[2:], axis=0)
            out[:, 2 * f :] = a.max(0)
        return np.maximum(h, 0) @ self.v + self.c


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of these texts, zero-padded at a text's end, and each one's text number."""
    sizes = np.diff(offsets)
    each = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), each)
    ordinal = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    at = (offsets[doc] + ordinal * WINDOW)[:, None] + np.arange(WINDOW)
    inside = at < offsets[doc + 1][:, None]
    x = data[np.minimum(at, max(0, len(data) - 1))] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(inside, x, np.uint8(0)), doc


def spread_windows(text: str, count: int, rng: np.random.Generator) -> list[bytes]:
    """Windows from all over a text, a third of them cut short so that short texts are learned too."""
    raw = text.encode("utf-8", "replace")
    out = []
    for _ in range(count):
        size = WINDOW if rng.random() < 0.67 else int(rng.integers(12, WINDOW))
        at = int(rng.integers(0, max(1, len(raw) - size + 1)))
        out.append(raw[at : at + size].ljust(WINDOW, b"\0"))
    return out


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", per_language: int = 300, windows_per_doc: int = 8) -> ByteCNN | None:
    """A network learned from rows that aren't held out; None if there are none with a language."""
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang")).where((fold_of("doc_id") != 1) & F.col("lang").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("doc_id", "lang")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, label, t in zip(b["doc_id"], b["lang"], b["text"]):
                if t and any(ch.isalpha() for ch in t):
                    rng = np.random.default_rng([int(d) & 0xFFFFFFFF if isinstance(d, (int, np.integer)) else len(str(d)), len(t)])
                    rows += [(label, w) for w in spread_windows(t, windows_per_doc, rng)]
            yield pd.DataFrame(rows, columns=["lang", "w"])

    # ``chosen`` has at most per_language rows a language, so it is broadcast
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    got = texts.mapInPandas(bv.lean(cut), "lang string, w binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["lang", "w"], kind="stable")
    classes = sorted(got["lang"].unique())
    y = got["lang"].map({c: i for i, c in enumerate(classes)}).to_numpy(np.int64)
    x = np.frombuffer(b"".join(got["w"]), np.uint8).reshape(len(y), WINDOW)
    return ByteCNN(classes).train(x, y)


def _predict(column: pa.Array, model: ByteCNN | None) -> tuple[list[str], np.ndarray]:
    n = len(column)
    names, scores = ["und"] * n, np.zeros(n)
    if model is None or not n:
        return names, scores
    data, offsets = bv.column_bytes(column)
    for i, j in bv.slices(offsets, 1 << 16):
        offs = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        total, count = np.zeros((j - i, len(model.classes))), np.zeros(j - i)
        # a very long text comes alone and is worked through in pieces
        for k in range(0, len(part), 1 << 18) if j == i + 1 else [0]:
            x, doc = windows(part[k : k + (1 << 18)], np.array([0, min(1 << 18, len(part) - k)])) if j == i + 1 else windows(part, offs)
            if len(x):
                z = model.logits(x)
                total += np.stack([np.bincount(doc, z[:, c], j - i) for c in range(z.shape[1])], 1)
                count += np.bincount(doc, minlength=j - i)
        total /= np.maximum(count, 1)[:, None]
        total -= total.max(1, keepdims=True)
        q = np.exp(total)
        q /= q.sum(1, keepdims=True)
        ascii_letter = np.concatenate(([0], np.cumsum(_LETTER[part])))
        has = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
        for d in np.flatnonzero(~has & (offs[1:] > offs[:-1])):
            has[d] = any(ch.isalpha() for ch in part[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace"))
        best = q.argmax(1)
        for d in np.flatnonzero(has):
            names[i + d] = model.classes[best[d]]
            scores[i + d] = q[d, best[d]]
    return names, scores


def predict(docs: DataFrame, model: ByteCNN | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predict(batch.column(2), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(bv.lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def calibrate(docs: DataFrame, model: ByteCNN | None, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> float:
    """The least score to keep: of ``EDGES`` the one with the fewest held-out rows kept with a wrong language or dropped with the right one.

    Of equal ones the smallest. All held-out rows with a language and a letter count, repeated
    ones each time; a language that wasn't learned is always wrong. The score is 0, so that none
    is too low, without a model, with fewer than ``LEAST`` such rows, and where the network is
    right on no more than half of them, so that it is no judge.
    """
    if model is None:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predict(batch.column(1), model)
            found = np.array(names, object)
            right = found == np.array(batch.column(0).to_pylist(), object)
            k = np.searchsorted(EDGES, scores, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(right, pa.bool_())], names=["k", "right"]).filter(pa.array(found != "und", pa.bool_()))

    rows = docs.where(held_out(doc_id) & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    right, wrong = np.zeros(len(EDGES), np.int64), np.zeros(len(EDGES), np.int64)
    for r in rows.mapInArrow(bv.lean(run), "k int, right boolean").groupBy("k", "right").count().collect():
        (right if r["right"] else wrong)[r["k"]] += r["count"]
    if right.sum() + wrong.sum() < LEAST or right.sum() <= wrong.sum():
        return 0.0
    # rows below an edge are dropped, the others kept
    errors = np.cumsum(right) - right + np.cumsum(wrong[::-1])[::-1]
    return float(EDGES[errors.argmin()])


def keep_identified(docs: DataFrame, model: ByteCNN | None, text: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose language is identified with ``min_score``, as ``calibrate`` finds it.

    Without a model, or where no score is too low, the rows whose text has a letter; these aren't scored.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or min_score <= 0:
                yield batch.filter(pa.array([any(ch.isalpha() for ch in t or "") for t in batch.column(at).cast(pa.string()).to_pylist()], pa.bool_()))
                continue
            names, scores = _predict(batch.column(at), model)
            keep = (np.array(names, object) != "und") & (scores >= min_score)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(bv.lean(run), docs.schema)
