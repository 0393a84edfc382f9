"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.common import _SPACE, arrow_bytes, chunks, mix, release, text_or_empty, tidy, word_hashes

#: Byte classes of the passage encoder: each ASCII punctuation mark alone, then groups.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.zeros(256, dtype=np.int64)
for _i, _b in enumerate(_MARKS):
    _CLASS[_b] = 5 + _i
_CLASS[list(range(97, 123))] = 1
_CLASS[list(range(65, 91))] = 2
_CLASS[list(range(48, 58))] = 3
_CLASS[list(range(128, 256))] = 4
_CLASSES = 5 + len(_MARKS)
_WORDS = 64  # hashed word buckets
FEATURES = _CLASSES + _WORDS + 8


def passages(column: pa.Array, width: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """A feature row per passage of ``width`` words (a text without words has one empty passage), and the texts' offsets.

    Features: shares of byte classes, hashed shares of words, word length and its
    spread, new lines, distinct words, words equal to the one before or two before,
    words in capitals, and passage length.
    """
    body, text_at = arrow_bytes(column)
    words, at = word_hashes(column)
    space = _SPACE[body]
    edge = np.zeros(len(body) + 1, dtype=bool)
    edge[text_at] = True
    inside = ~space
    start = np.flatnonzero(inside & (np.concatenate(([True], space[:-1])) | edge[:-1])[: len(body)])
    end = np.flatnonzero(inside & (np.concatenate((space[1:], [True])) | edge[1:])[: len(body)]) + 1
    n = np.diff(at)
    count = np.maximum(1, -(-n // width))
    offsets = np.concatenate(([0], np.cumsum(count)))
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - at[text]
    owner = offsets[text] + place // width
    total = int(offsets[-1])
    out = np.zeros((total, FEATURES), dtype=np.float32)
    if not len(words):
        return out, offsets
    size = np.bincount(owner, minlength=total).astype(np.float64)
    some = np.maximum(size, 1)
    length = (end - start).astype(np.float64)
    chars = np.repeat(owner, end - start)
    byte_at = np.flatnonzero(inside)
    classes = np.bincount(chars * _CLASSES + _CLASS[body[byte_at]], minlength=total * _CLASSES).reshape(total, _CLASSES)
    mass = np.maximum(1, classes.sum(axis=1))
    out[:, :_CLASSES] = np.minimum(4.0, np.sqrt(classes / mass[:, None]) * 4)
    bucket = (mix(words) % np.uint64(_WORDS)).astype(np.int64)
    bag = np.bincount(owner * _WORDS + bucket, minlength=total * _WORDS).reshape(total, _WORDS)
    out[:, _CLASSES : _CLASSES + _WORDS] = np.sqrt(bag / some[:, None])
    mean = np.bincount(owner, weights=length, minlength=total) / some
    square = np.bincount(owner, weights=length * length, minlength=total) / some
    rest = out[:, _CLASSES + _WORDS :]
    rest[:, 0] = np.minimum(mean / 10, 5)
    rest[:, 1] = np.minimum(np.sqrt(np.maximum(0, square - mean * mean)) / 10, 5)
    order = np.lexsort((words, owner))
    new = np.concatenate(([True], (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])))
    rest[:, 2] = np.bincount(owner[order], weights=new, minlength=total) / some
    for k in (1, 2):
        same = np.zeros(len(words), dtype=bool)
        same[k:] = (words[k:] == words[:-k]) & (owner[k:] == owner[:-k])
        rest[:, 2 + k] = np.bincount(owner, weights=same, minlength=total) / some
    first, last = body[start], body[end - 1]
    second = body[np.minimum(start + 1, end - 1)]
    capital = lambda x: (x >= 65) & (x <= 90)
    rest[:, 5] = np.bincount(owner, weights=capital(first) & capital(second) & (length > 1), minlength=total) / some
    rest[:, 6] = np.log1p(size) / 4
    rest[:, 7] = np.bincount(owner, weights=_CLASS[last] >= 5, minlength=total) / some
    return out, offsets


class GatedAttention:
    """h = tanh(Wx); weight of a passage = softmax of w.(tanh(Vh) * sigmoid(Uh)); score = sigmoid(c.z + d) of the weighted z."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {"W": init(FEATURES, hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate, 1)[:, 0] * 0.1, "c": init(hidden, 1)[:, 0], "d": np.zeros(1)}

    def forward(self, x: np.ndarray, at: np.ndarray):
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        size = np.diff(at)
        bag = np.repeat(np.arange(len(size)), size)
        e = np.exp(e - np.maximum.reduceat(e, at[:-1])[bag])
        a = e / np.add.reduceat(e, at[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))
        return x, h, t, g, a, bag, z, score

    def fit(self, x: np.ndarray, at: np.ndarray, label: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 9) -> GatedAttention:
        """Adam on the log loss of document labels."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.05
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(label))
            speed = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for lo in range(0, len(order), batch):
                docs = order[lo : lo + batch]
                size = at[docs + 1] - at[docs]
                cut = np.concatenate(([0], np.cumsum(size)))
                rows = np.repeat(at[docs] - cut[:-1], size) + np.arange(cut[-1])
                grad = self._gradient(x[rows], cut, label[docs])
                step += 1
                for k, g in grad.items():
                    g = g + (decay * self.p[k] if k in "WVUc" else 0)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, at: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, t, g, a, bag, z, score = self.forward(x, at)
        d_logit = (score - label) / len(label)
        d_z = d_logit[:, None] * p["c"]
        d_a = (d_z[bag] * h).sum(axis=1)
        d_h = a[:, None] * d_z[bag]
        d_e = a * (d_a - np.add.reduceat(a * d_a, at[:-1])[bag])
        d_tg = d_e[:, None] * p["w"]
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_h += d_t @ p["V"].T + d_g @ p["U"].T
        d_x = d_h * (1 - h * h)
        return {"W": x.T @ d_x, "b": d_x.sum(axis=0), "V": h.T @ d_t, "U": h.T @ d_g, "w": (t * g).T @ d_e, "c": z.T @ d_logit, "d": np.array([d_logit.sum()])}

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.forward(x.astype(np.float64), at)[-1]


def train(docs: DataFrame, labels: DataFrame, usable, max_docs: int = 6000, max_chars: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", width: int = 48) -> GatedAttention:
    """Fit on labelled rows for which ``usable`` holds, those of least hashed id: at most ``max_docs`` rows with ``max_chars`` characters in all.

    Each text is used whole; its encoding, which comes to the driver, takes less
    than a byte a character. Rows without a label or id are not used; of repeated
    labels the larger counts; rows that repeat an id are learned from each for
    itself. A null or empty text is one empty passage. Without any label every
    score is 0.5. Columns other than id and text are not read.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & usable(F.col("id")))
    sample = ids.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(sample), "id")  # max_docs rows at most

    total, kept = 0, []
    for r in rows.groupBy("id").agg(F.sum(F.length("text")).alias("n")).orderBy(F.xxhash64("id"), "id").collect():  # max_docs rows at most
        total += r["n"]
        if total > max_chars and kept:
            break
        kept.append((r["id"],))
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "id long")), "id", "left_semi")

    def encoded(batches):
        for b in chunks(batches):
            x, at = passages(b.column("text"), width)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], ["id", "label", "x"])

    got = rows.select("id", "label", "text").mapInArrow(encoded, "id long, label int, x binary").toPandas().sort_values(["id", "x"])
    model = GatedAttention()
    if not len(got):
        model.p["c"][:] = 0
        return model
    x = [np.frombuffer(r, np.float32).reshape(-1, FEATURES) for r in got.x]
    at = np.concatenate(([0], np.cumsum([len(r) for r in x])))
    label = got.label.to_numpy(np.float64)
    whole = np.concatenate(x).astype(np.float64)
    del got, x
    model.fit(whole, at, label)
    del whole
    release()
    return model


def score(df: DataFrame, model: GatedAttention, id_col: str = "doc_id", text_col: str = "text", width: int = 48) -> DataFrame:
    """(doc_id, score) of every row, from its whole text alone; a null text counts as empty, repeated rows and ids are scored each for itself, a very long text has many passages."""

    def scored(batches):
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(*passages(b.column("text"), width)))], ["doc_id", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(tidy(scored), "doc_id long, score double")


def accepted(df: DataFrame, model: GatedAttention, threshold: float = 0.5, text_col: str = "text", width: int = 48) -> DataFrame:
    """The rows whose score reaches ``threshold``, with all their columns."""

    def kept(batches):
        for b in chunks(batches, text_col):
            text = pc.fill_null(b.column(text_col), "")
            yield b.filter(pa.array(model.score(*passages(text, width)) >= threshold))

    return df.mapInArrow(tidy(kept), df.schema)
