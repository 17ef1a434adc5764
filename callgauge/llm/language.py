"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a window of bytes forwards and backwards with a small gated state each way, labels every byte, and a
document's probabilities are the mean over all bytes of all its windows. It is trained by backpropagation through time
on a bounded, documented sample of labelled rows; prediction covers every byte of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgauge.llm.common import fresh

HIDDEN = 8
WINDOW = 128
BATCH = 2048
# The training sample: about this many rows of each language, one excerpt of this many characters from each.
ROWS_PER_LANGUAGE = 600
EXCERPT_CHARS = 400
TRAIN_STEPS = 260
TRAIN_BATCH = 96
RATE = 0.02
UNKNOWN = "und"
MIN_SCORE = 0.4
# A byte that stands for the space after a text, to fill its last window.
PAD = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """One gated layer each way and a linear output. ``weights``: input tables (257 x 3 hidden), recurrent matrices, output."""

    def __init__(self, languages: list[str], weights: dict[str, np.ndarray]):
        self.languages, self.weights = languages, weights

    @classmethod
    def start(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        shapes = {"x_f": (257, 3 * hidden), "x_b": (257, 3 * hidden), "u_f": (hidden, 3 * hidden), "u_b": (hidden, 3 * hidden), "out": (2 * hidden, len(languages)), "bias": (len(languages),)}
        return cls(languages, {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in shapes.items()})

    def _run(self, steps: np.ndarray, way: str, keep: bool):
        """States after each step of (time, batch) bytes; with ``keep`` also what the backward pass needs."""
        table, u = self.weights[f"x_{way}"], self.weights[f"u_{way}"]
        hidden = u.shape[0]
        time, batch = steps.shape
        states = np.zeros((time + 1, batch, hidden), dtype=table.dtype)
        kept = []
        order = range(time) if way == "f" else range(time - 1, -1, -1)
        h = states[time]
        for t in order:
            x = table[steps[t]]
            g = h @ u
            zr = _sigmoid(x[:, : 2 * hidden] + g[:, : 2 * hidden])
            z, r = zr[:, :hidden], zr[:, hidden:]
            pre = g[:, 2 * hidden :]
            c = np.tanh(x[:, 2 * hidden :] + r * pre)
            new = c + z * (h - c)
            if keep:
                kept.append((t, h, z, r, pre, c))
            states[t] = h = new
        return states[:time], kept

    def probabilities(self, steps: np.ndarray) -> np.ndarray:
        """(time, batch, language) probabilities of every position of windows given as (time, batch) bytes."""
        forth, _ = self._run(steps, "f", False)
        back, _ = self._run(steps, "b", False)
        logits = np.concatenate([forth, back], axis=2) @ self.weights["out"] + self.weights["bias"]
        np.exp(logits - logits.max(axis=2, keepdims=True), out=logits)
        return logits / logits.sum(axis=2, keepdims=True)

    def loss_and_gradients(self, steps: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        hidden = self.weights["u_f"].shape[0]
        time, batch = steps.shape
        forth, kept_f = self._run(steps, "f", True)
        back, kept_b = self._run(steps, "b", True)
        both = np.concatenate([forth, back], axis=2)
        logits = both @ self.weights["out"] + self.weights["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        rows = np.arange(batch)
        loss = float(-np.log(p[:, rows, labels] + 1e-30).mean())
        p[:, rows, labels] -= 1
        p /= time * batch
        grads = {"out": np.einsum("tbh,tbl->hl", both, p), "bias": p.sum(axis=(0, 1))}
        d_both = p @ self.weights["out"].T
        for way, kept, d_states in (("f", kept_f, d_both[:, :, :hidden]), ("b", kept_b, d_both[:, :, hidden:])):
            u = self.weights[f"u_{way}"]
            d_table, d_u = np.zeros_like(self.weights[f"x_{way}"]), np.zeros_like(u)
            d_next = np.zeros((batch, hidden), dtype=u.dtype)
            for t, h, z, r, pre, c in reversed(kept):
                d = d_states[t] + d_next
                d_c = d * (1 - z) * (1 - c * c)
                d_z = d * (h - c) * z * (1 - z)
                d_r = d_c * pre * r * (1 - r)
                np.add.at(d_table, steps[t], np.concatenate([d_z, d_r, d_c], axis=1))
                d_g = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_u += h.T @ d_g
                d_next = d * z + d_g @ u.T
            grads[f"x_{way}"], grads[f"u_{way}"] = d_table, d_u
        return loss, grads

    def fit(self, texts: list[bytes], labels: list[int], steps: int = TRAIN_STEPS, seed: int = 7) -> float:
        """Train by Adam on random windows of 64 bytes, languages drawn evenly; returns the last loss."""
        rng = np.random.default_rng(seed)
        by_language = [[t for t, k in zip(texts, labels, strict=True) if k == i] for i in range(len(self.languages))]
        usable = [i for i, own in enumerate(by_language) if own]
        mean = {k: np.zeros_like(w) for k, w in self.weights.items()}
        square = {k: np.zeros_like(w) for k, w in self.weights.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            drawn = rng.choice(usable, TRAIN_BATCH)
            window = np.full((64, TRAIN_BATCH), PAD, dtype=np.int64)
            for b, language in enumerate(drawn):
                text = by_language[language][rng.integers(len(by_language[language]))]
                start = rng.integers(max(1, len(text) - 63))
                piece = np.frombuffer(text[start : start + 64], dtype=np.uint8)
                window[: len(piece), b] = piece
            loss, grads = self.loss_and_gradients(window, drawn)
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.weights[k] = (self.weights[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def documents(self, texts: list[str]) -> np.ndarray:
        """Pooled probabilities (document, language) over every byte of each text; empty texts get zeros."""
        encoded = [t.encode() for t in texts]
        lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        counts = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(len(encoded)), counts)
        filled = np.full((len(owner), WINDOW), PAD, dtype=np.int16)
        row = 0
        for text, n, count in zip(encoded, lengths.tolist(), counts.tolist(), strict=True):
            if n:
                filled[row : row + count].reshape(-1)[:n] = np.frombuffer(text, dtype=np.uint8)
                row += count
        pooled = np.zeros((len(encoded), len(self.languages)))
        for at in range(0, len(owner), BATCH):
            part = filled[at : at + BATCH]
            p = self.probabilities(np.ascontiguousarray(part.T))
            p *= (part.T != PAD)[:, :, None]
            np.add.at(pooled, owner[at : at + BATCH], p.sum(axis=0))
        return pooled / np.maximum(lengths, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Network | None:
    """Learn from text and lang of rows of ``docs`` that are not held out and have both; None if there are no such rows.

    The sample has at most ``rows_per_language`` different rows of each language, those of the smallest hashes of id and text,
    and gives one excerpt a row. Texts without a letter teach nothing and do not count.
    """
    lettered = F.col("text").rlike(r"\p{L}")
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & lettered & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id", "text", F.lit("language"))
    counts = {r.lang: max(r.n, 1) for r in usable.groupBy("lang").agg(F.approx_count_distinct(order).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    # A draw of about twice the rows goes on, so that little is sorted.
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, 2 * rows_per_language / counts[k]))]), F.col("lang"))
    draw = F.pmod(order, F.lit(1_000_003)) / 1_000_003
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.length("text") - EXCERPT_CHARS, F.lit(0)) + 1).cast("int") + 1
    excerpt = F.substring("text", start, F.lit(EXCERPT_CHARS)).alias("excerpt")
    drawn = usable.filter(draw < share).select("lang", "doc_id", order.alias("place"), excerpt).distinct()
    first = Window.partitionBy("lang").orderBy("place", "excerpt")
    sample = drawn.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= rows_per_language)
    rows = sorted(sample.select("lang", "doc_id", "excerpt").collect(), key=lambda r: (r.lang, r.doc_id, r.excerpt))
    network = Network.start(languages)
    network.fit([r.excerpt.encode() for r in rows], [languages.index(r.lang) for r in rows])
    return network


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``. A text that is null or has no letter, or any text without a network, gets
    ``und`` and 0. Ties go to the first language by name; repeated rows get equal results; other columns pass through."""
    inner = fresh(docs, "_read")

    @F.pandas_udf("lang string, score double")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            made = []
            values = part.fillna("").tolist()
            at = 0
            while at < len(values):  # portions of bounded size
                end, chars = at, 0
                while end < len(values) and (end == at or chars + len(values[end]) <= 1_000_000):
                    chars += len(values[end])
                    end += 1
                made.append(network.documents(values[at:end]))
                at = end
            pooled = np.concatenate(made) if made else np.zeros((0, len(network.languages)))
            best = pooled.argmax(axis=1)
            yield pd.DataFrame({"lang": [network.languages[i] for i in best], "score": np.clip(pooled.max(axis=1), 0, 1)})

    docs = docs.drop("lang_pred", "score")
    if network is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rated = docs.withColumn(inner, read(F.col(text)))
    return (
        rated.withColumn("lang_pred", F.when(known, F.col(inner)["lang"]).otherwise(UNKNOWN))
        .withColumn("score", F.when(known, F.col(inner)["score"]).otherwise(0.0))
        .drop(inner)
    )


def report(docs: DataFrame) -> DataFrame:
    rows = predict(docs.select("doc_id", "text"), train(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows whose language is known with at least ``min_score``; the columns stay as they are."""
    pred = fresh(docs, "_pred")
    rated = predict(docs.select("*"), train(docs)) if not {"lang_pred", "score"} & {c.lower() for c in docs.columns} else None
    if rated is None:  # keep the caller's columns of these names apart
        kept = docs.withColumnsRenamed({c: f"{pred}{c}" for c in docs.columns if c.lower() in ("lang_pred", "score")})
        rated = predict(kept, train(docs))
        good = rated.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).drop("lang_pred", "score")
        return good.withColumnsRenamed({f"{pred}{c}": c for c in docs.columns}).select(*docs.columns)
    return rated.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(*docs.columns)
