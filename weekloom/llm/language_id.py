"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of UTF-8 bytes in both directions and labels every
position; a document's probabilities are the mean over all its positions. It is
trained in numpy by backpropagation through time on a bounded sample: of every
language the documents whose hashed ids are smallest in each of ``buckets`` hash
buckets, ``windows`` pieces of each. Texts are cut into windows, so their length
does not matter and no byte is left out.

Defined results
  * null text, or text without a letter: ``und`` with score 0.
  * no labelled document to learn from: every document is ``und``.
  * rows with a null id are predicted like others and count as held out; they
    and rows with a null language or text are not learned from.
  * ties between languages go to the first in alphabetical order; repeated rows
    get equal predictions; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import bounded_arrow, groups_of

UND = "und"
WINDOW = 64
HIDDEN = 10
BUCKETS = 256
WINDOWS = 4
LANES = 1024  # windows that step together

LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text is divisible by five, or there is no id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, buckets: int, windows: int) -> list[tuple[str, list[str]]]:
    """(language, pieces of text): at most ``buckets`` documents of each language, ``windows`` pieces of each."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        ~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("id"))
    chosen = rows.groupBy("lang", F.pmod("h", F.lit(buckets)).alias("b")).agg(F.min("h").alias("h")).select("lang", "h")
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    pieces = F.array(*[F.substring("text", (F.pmod(F.xxhash64("h", F.lit(i)), room) + 1).cast("int"), F.lit(WINDOW)) for i in range(windows)])
    picked = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(pieces).alias("pieces"))
    return [(r.lang, r.pieces) for r in sorted(picked.collect(), key=lambda r: (r.lang, r.h))]


def _sigmoid(a: np.ndarray) -> np.ndarray:
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1
    return np.reciprocal(a, out=a)


class Direction:
    """One gated recurrent layer; arrays are (units, lanes)."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.p = {
            "x": (rng.standard_normal((3 * hidden, 256)) * 0.3).astype(np.float32),
            "u": (rng.standard_normal((3 * hidden, hidden)) / hidden**0.5).astype(np.float32),
            "b": np.zeros((3 * hidden, 1), np.float32),
            "c": np.zeros((hidden, 1), np.float32),
        }
        self.hidden = hidden

    def run(self, data: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (steps, hidden, lanes) of byte windows (steps, lanes)."""
        n = self.hidden
        x, u, b, c = self.p["x"] + self.p["b"], self.p["u"], self.p["b"], self.p["c"]
        out = np.empty((len(data), n, data.shape[1]), np.float32)
        h = np.zeros((n, data.shape[1]), np.float32)
        tape = []
        for t, step in enumerate(data):
            a = np.take(x, step, axis=1)
            uh = u @ h
            a[: 2 * n] += uh[: 2 * n]
            gates = _sigmoid(a[: 2 * n])
            z, r = gates[:n], gates[n:]
            m = uh[2 * n:]
            m += c
            cand = np.tanh(a[2 * n:] + r * m)
            new = cand + z * (h - cand)
            if keep:
                tape.append((step, h, z, r, m, cand))
            h = new
            out[t] = h
        return out, tape

    def back(self, tape: list, dout: np.ndarray) -> dict[str, np.ndarray]:
        n, u = self.hidden, self.p["u"]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh = np.zeros_like(dout[0])
        da = np.empty((3 * n, dout.shape[2]), np.float32)
        for t in range(len(tape) - 1, -1, -1):
            step, h, z, r, m, cand = tape[t]
            dh = dh + dout[t]
            dcand = dh * (1 - z) * (1 - cand * cand)
            da[:n] = dh * (h - cand) * z * (1 - z)
            da[n: 2 * n] = dcand * m * r * (1 - r)
            da[2 * n:] = dcand
            for k in range(3 * n):
                grads["x"][k] += np.bincount(step, da[k], 256)
            grads["b"][:, 0] += da.sum(1)
            dm = dcand * r
            grads["c"][:, 0] += dm.sum(1)
            inner = np.concatenate([da[: 2 * n], dm])
            grads["u"] += inner @ h.T
            dh = dh * z + u.T @ inner
        return grads


class ByteLanguages:
    """Bidirectional network and its classes."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.ahead, self.behind = Direction(rng, hidden), Direction(rng, hidden)
        self.out = {"w": (rng.standard_normal((len(classes), 2 * hidden)) * 0.1).astype(np.float32), "d": np.zeros((len(classes), 1), np.float32)}

    def positions(self, data: np.ndarray, keep: bool = False):
        """Probabilities (steps, classes, lanes) of every position."""
        f, tf = self.ahead.run(data, keep)
        g, tg = self.behind.run(data[::-1], keep)
        both = np.concatenate([f, g[::-1]], axis=1)
        s = np.matmul(self.out["w"], both) + self.out["d"]
        s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=1, keepdims=True)
        return s, both, tf, tg

    def gradients(self, data: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """Loss and gradients of the weighted mean cross-entropy over positions."""
        p, both, tf, tg = self.positions(data, True)
        total = max(float(weight.sum()), 1.0)
        lanes = np.arange(data.shape[1])
        loss = -float((np.log(p[:, label, lanes] + 1e-9) * weight).sum()) / total
        d = p
        d[:, label, lanes] -= 1
        d *= (weight / total)[:, None, :]
        n = self.ahead.hidden
        dboth = np.matmul(self.out["w"].T, d)
        grads = {"w": np.einsum("tcl,thl->ch", d, both, optimize=True), "d": d.sum((0, 2))[:, None]}
        return loss, [(self.out, grads), (self.ahead.p, self.ahead.back(tf, dboth[:, :n])),
                      (self.behind.p, self.behind.back(tg, dboth[::-1, n:]))]

    def fit(self, data: np.ndarray, label: np.ndarray, epochs: int = 8, lanes: int = 256, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam over shuffled windows (windows, steps); zero bytes are padding and carry no loss."""
        rng = np.random.default_rng(seed)
        state: dict[int, list] = {}
        losses, step = [], 0
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for lo in range(0, len(order), lanes):
                pick = order[lo: lo + lanes]
                batch = np.ascontiguousarray(data[pick].T)
                loss, groups = self.gradients(batch, label[pick], (batch > 0).astype(np.float32))
                step += 1
                for params, grads in groups:
                    for k, g in grads.items():
                        m, v = state.setdefault(id(params[k]), [np.zeros_like(g), np.zeros_like(g)])
                        m += 0.1 * (g - m)
                        v += 0.01 * (g * g - v)
                        params[k] -= (rate / (1 + step / 60)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
                losses.append(loss)
        return losses

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(documents, classes): mean over all byte positions; empty texts get zeros."""
        sizes = np.array([len(t) for t in texts])
        rows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), rows)
        flat = np.zeros(int(rows.sum()) * WINDOW, np.uint8)
        at = 0
        for t, r in zip(texts, rows.tolist()):
            flat[at: at + len(t)] = np.frombuffer(t, np.uint8)
            at += r * WINDOW
        windows = flat.reshape(-1, WINDOW)
        total = np.zeros((len(texts), len(self.classes)))
        for lo in range(0, len(windows), LANES):
            data = np.ascontiguousarray(windows[lo: lo + LANES].T)
            p = self.positions(data)[0]
            p *= (data > 0)[:, None, :]
            np.add.at(total, owner[lo: lo + LANES], p.sum(0).T)
        return total / np.maximum(total.sum(1, keepdims=True), 1e-12)


def as_windows(pieces: list[str]) -> np.ndarray:
    out = np.zeros((len(pieces), WINDOW), np.uint8)
    for i, p in enumerate(pieces):
        b = p.encode()[:WINDOW]
        out[i, : len(b)] = np.frombuffer(b, np.uint8)
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          buckets: int = BUCKETS, windows: int = WINDOWS, hidden: int = HIDDEN) -> ByteLanguages:
    """Fit on at most ``buckets`` x ``windows`` windows of each language."""
    sample = [(lang, p) for lang, pieces in training_windows(docs, id_col, text_col, lang_col, buckets, windows) for p in pieces if LETTER.search(p)]
    classes = sorted({lang for lang, _ in sample})
    model = ByteLanguages(classes, hidden)
    if len(classes) > 1:
        number = {c: i for i, c in enumerate(classes)}
        model.fit(as_windows([p for _, p in sample]), np.array([number[lang] for lang, _ in sample]))
    return model


def _predictions(model: ByteLanguages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in groups_of([len(t) for t in texts], 4 << 20):
                part = texts[lo:hi]
                known = [bool(model.classes) and LETTER.search(t) is not None for t in part]
                p = model.document_probabilities([t.encode() if k else b"" for t, k in zip(part, known)]) if model.classes else np.zeros((hi - lo, 1))
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays([
                    b.column("id")[lo:hi], b.column("held_out")[lo:hi],
                    pa.array([model.classes[i] if k else UND for i, k in zip(best.tolist(), known)], pa.string()),
                    pa.array([float(min(1.0, row[i])) if k else 0.0 for row, i, k in zip(p, best.tolist(), known)], pa.float64()),
                ], names=["id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: ByteLanguages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, from the text alone."""
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_predictions(model), f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def _labelled(model: ByteLanguages, least: float):
    predicted = _predictions(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            asked = pa.RecordBatch.from_arrays(
                [pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.bool_()), b.column("text")], names=["id", "held_out", "text"])
            out = pa.Table.from_batches(list(predicted([asked])))
            lang, score = out["lang_pred"].combine_chunks(), np.asarray(out["score"])
            keep = pa.array(np.asarray(pc.not_equal(lang, UND)) & (score >= least))
            yield b.set_column(b.schema.get_field_index("lang"), "lang", lang).filter(keep)

    return run


def labelled(docs: DataFrame, model: ByteLanguages, least: float) -> DataFrame:
    """Rows of ``docs`` (with text and lang) in a known language at a score of ``least`` or more; lang is the predicted one."""
    bounded_arrow(docs.sparkSession)
    return docs.mapInArrow(_labelled(model, least), docs.schema)
