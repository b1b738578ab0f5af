"""Language identification by a byte convolutional network, trained and applied in numpy.

The network: bytes are embedded; filters of several widths slide over a window of fixed length; their responses are
max-pooled over the window, rectified and sent through a softmax. Texts are cut into windows that cover them whole, the
last one padded with zeros; a text's language is the one with the largest mean log-probability over its windows, weighted
by the bytes of each, and its score is that softmax.

Training reads only ``text`` and ``lang`` of a bounded, documented sample (``TRAIN_ROWS`` rows in hash order, ``TRAIN_WINDOWS``
windows each) and runs minibatch Adam on the driver in seconds. A convolution over embedded bytes is one matrix product of
the window's byte contexts with the filters; at prediction, embedding and filter are folded into one table per filter
position, so that a byte costs one row gather per position.

Defined cases: null text, or one without a letter, is ``und`` with score 0; rows without ``lang`` or ``doc_id`` are never
learned from; no learnable row makes every text ``und``; an empty table gives an empty result; repeated rows get equal
predictions; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.registry import query
from docweft.llm.shingles import slices
from docweft.session import table

WINDOW = 256
EMBED = 8
#: Filters of each width.
FILTERS = {2: 12, 3: 12, 4: 12}
TRAIN_ROWS = 1600
TRAIN_WINDOWS = 3
ROUNDS = 30
BATCH = 64
RATE = 0.01
UNKNOWN = "und"


class ByteNet:
    """Embedding, multi-width filters with max pooling, softmax."""

    def __init__(self, labels: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.weights: dict[str, np.ndarray] = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for width, count in FILTERS.items():
            self.weights[f"filter{width}"] = rng.normal(0, 1 / np.sqrt(width * EMBED), (width * EMBED, count)).astype(np.float32)
            self.weights[f"shift{width}"] = np.zeros(count, dtype=np.float32)
        self.weights["out"] = rng.normal(0, 0.1, (sum(FILTERS.values()), len(labels))).astype(np.float32)
        self.weights["bias"] = np.zeros(len(labels), dtype=np.float32)

    def _forward(self, windows: np.ndarray):
        w = self.weights
        n, length = windows.shape
        embedded = w["embed"][windows]
        pooled, where, contexts = [], {}, {}
        for width in FILTERS:
            steps = length - width + 1
            context = np.concatenate([embedded[:, k : k + steps] for k in range(width)], axis=2)
            response = context.reshape(n * steps, -1) @ w[f"filter{width}"]
            response = response.reshape(n, steps, -1)
            where[width] = response.argmax(axis=1)
            contexts[width] = context
            pooled.append(np.take_along_axis(response, where[width][:, None], 1)[:, 0] + w[f"shift{width}"])
        hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
        logits = hidden @ w["out"] + w["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        chance = np.exp(logits)
        return chance / chance.sum(axis=1, keepdims=True), hidden, where, contexts

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy; the max pool sends each gradient to the one context that won."""
        chance, hidden, where, contexts = self._forward(x)
        delta = chance
        delta[np.arange(len(y)), y] -= 1
        delta /= len(y)
        grads = {"out": hidden.T @ delta, "bias": delta.sum(axis=0), "embed": np.zeros_like(self.weights["embed"])}
        back = (delta @ self.weights["out"].T) * (hidden > 0)
        left = 0
        for width, count in FILTERS.items():
            g = back[:, left : left + count]
            left += count
            won = np.take_along_axis(contexts[width], where[width][:, :, None], 1)
            grads[f"filter{width}"] = np.einsum("nf,nfd->df", g, won)
            grads[f"shift{width}"] = g.sum(axis=0)
            to_context = g[:, :, None] * self.weights[f"filter{width}"].T[None]
            for k in range(width):
                byte = np.take_along_axis(x, where[width] + k, 1)
                np.add.at(grads["embed"], byte, to_context[:, :, k * EMBED : (k + 1) * EMBED])
        return grads

    def fit(self, windows: np.ndarray, target: np.ndarray, rounds: int = ROUNDS, seed: int = 4) -> "ByteNet":
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH]
                step += 1
                for key, g in self.gradients(windows[batch], target[batch]).items():
                    first[key] = 0.9 * first[key] + 0.1 * g
                    second[key] = 0.999 * second[key] + 0.001 * g * g
                    scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.weights[key] = (self.weights[key] - scale * first[key] / (np.sqrt(second[key]) + 1e-8)).astype(np.float32)
        return self

    def folded(self) -> dict[str, np.ndarray]:
        """Per filter position, the response of every byte: embedding times filter."""
        w = self.weights
        out = {f"table{width}": np.stack([w["embed"] @ w[f"filter{width}"][k * EMBED : (k + 1) * EMBED] for k in range(width)]) for width in FILTERS}
        return out | {f"shift{width}": w[f"shift{width}"] for width in FILTERS} | {"out": w["out"], "bias": w["bias"]}


def log_chances(folded: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """Log-probabilities of every window, equal to the network's own forward pass."""
    n, length = windows.shape
    pooled = []
    for width in FILTERS:
        steps = length - width + 1
        filters = folded[f"table{width}"]
        response = filters[0][windows[:, :steps]]
        for k in range(1, width):
            response += filters[k][windows[:, k : k + steps]]
        pooled.append(response.max(axis=1) + folded[f"shift{width}"])
    logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ folded["out"] + folded["bias"]
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def windows_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows over whole texts, the text of each, and the bytes in each. A text without bytes has none."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([-(-len(e) // WINDOW) for e in encoded], dtype=np.int64)
    flat = np.frombuffer(b"".join(e + bytes(-len(e) % WINDOW) for e in encoded), dtype=np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    used = np.full(len(flat), WINDOW, dtype=np.int64)
    ends = np.cumsum(counts) - 1
    for i, e in enumerate(encoded):
        if counts[i]:
            used[ends[i]] = len(e) - WINDOW * (counts[i] - 1)
    return flat, owner, used


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that training may see: a language, and a checksum of the id that leaves another remainder than 2."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> ByteNet | None:
    """The network fitted on at most ``rows`` rows of ``doc_id, text, lang`` in hash order; None if there are none."""
    ids = learnable(docs).select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "lang").limit(rows)
    picked = {r["doc_id"] for r in ids.collect()}
    if not picked:
        return None
    cut = 4 * WINDOW * (TRAIN_WINDOWS + 1)  # training windows come from the front; prediction reads whole texts
    chosen = learnable(docs).where(F.col("doc_id").isin(sorted(picked))).select("doc_id", F.substring("text", 1, cut).alias("text"), "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang", F.xxhash64("text")).limit(2 * rows).collect()
    chosen.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    labels = sorted({r["lang"] for r in chosen})
    flat, owner, used = windows_of([r["text"] for r in chosen])
    turn = np.arange(len(owner)) - np.searchsorted(owner, owner)
    good = (used >= 32) & (turn < TRAIN_WINDOWS)
    if not good.any():
        good = used > 0
    if not good.any():
        return None
    code = {label: i for i, label in enumerate(labels)}
    target = np.array([code[r["lang"]] for r in chosen])[owner]
    windows = flat[good].astype(np.int64)
    if len(labels) == 1:
        return ByteNet(labels)
    return ByteNet(labels).fit(windows, target[good])


def _predictor(folded: dict[str, np.ndarray], labels: list[str]):
    """Arrow map: ``doc_id, held_out, text`` (null where there is no letter) to ``doc_id, held_out, lang_pred, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for begin, end in slices(texts, 1 << 20):
                flat, owner, used = windows_of(texts[begin:end])
                total = np.zeros((end - begin, len(labels)))
                weight = np.zeros(end - begin)
                for at in range(0, len(flat), 512):
                    part = slice(at, at + 512)
                    np.add.at(total, owner[part], log_chances(folded, flat[part]) * used[part][:, None])
                    np.add.at(weight, owner[part], used[part])
                some = weight > 0
                mean = total / np.maximum(weight, 1)[:, None]
                chance = np.exp(mean - mean.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                best = chance.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        batch.column(1).slice(begin, end - begin),
                        pa.array([labels[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], pa.string()),
                        pa.array(np.where(some, chance[np.arange(len(best)), best], 0.0)),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return run


def predict(docs: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    if net is None:
        return docs.select("doc_id", held, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    read = docs.select("doc_id", held, F.when(F.col(text).rlike("\\p{L}"), F.col(text)).alias("text"))
    return read.mapInArrow(_predictor(net.folded(), net.labels), "doc_id bigint, held_out boolean, lang_pred string, score double")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
