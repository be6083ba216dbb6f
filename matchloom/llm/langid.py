"""Language ID: a byte convolutional network, trained in numpy on labelled text and applied to fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import free_memory, hash60, key_text, table

#: Bytes of a window, filter widths, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Bounds of the training sample: rows of each label, and rows in all while there are fewer labels than that.
SAMPLE_ROWS, SAMPLE_ALL = 1_500, 30_000
EPOCHS, LEAST_BATCHES, RATE, SEED = 6, 600, 0.05, 7
#: Windows of a text start this far apart, so that every run of the widest filter lies within one.
STEP = WINDOW - max(WIDTHS) + 1
BATCH_WINDOWS = 32
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    labels: list[str]
    conv: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    dense: np.ndarray  # (len(WIDTHS) * FILTERS, labels)
    bias: np.ndarray


def windows(text: bytes) -> np.ndarray:
    """All bytes of the text as rows of WINDOW bytes, the last filled up with zeros."""
    n = max(1, -(-max(0, len(text) - (WINDOW - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def train(texts: list[bytes], labels: list[str]) -> Model:
    """Cross-entropy by mini-batches with Adagrad; gradients pass only through the pooled positions."""
    rng = np.random.default_rng(SEED)
    names = sorted(set(labels))
    x = np.stack([windows(t)[0] for t in texts]).astype(np.int64)
    y = np.array([names.index(v) for v in labels])
    conv = [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS]
    dense, bias = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(names))), np.zeros(len(names))
    square = [np.full_like(p, 1e-6) for p in (*conv, dense, bias)]
    for _ in range(max(EPOCHS, -(-LEAST_BATCHES * BATCH_WINDOWS // len(x)))):  # small samples are seen more often
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH_WINDOWS):
            rows = x[order[at : at + BATCH_WINDOWS]]
            pooled, where = [], []
            for w, c in zip(WIDTHS, conv):
                z = sum(c[j][rows[:, j : WINDOW - w + 1 + j]] for j in range(w))
                where.append(z.argmax(1))
                pooled.append(z.max(1))
            h = np.tanh(np.concatenate(pooled, 1))
            z = h @ dense + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[order[at : at + BATCH_WINDOWS]]] -= 1
            p /= len(rows)
            back = (p @ dense.T) * (1 - h * h)
            grads = [np.zeros_like(c) for c in conv]
            for k, (w, g) in enumerate(zip(WIDTHS, grads)):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(rows, where[k] + j, 1), np.arange(FILTERS)[None, :]), part)
            for p_, g, s in zip((*conv, dense, bias), (*grads, h.T @ p, p.sum(0)), square):
                s += g * g
                p_ -= RATE * g / np.sqrt(s)
    return Model(names, [c.astype(np.float32) for c in conv], dense.astype(np.float32), bias.astype(np.float32))


def pool(z: np.ndarray) -> np.ndarray:
    """The maximum over axis 1, by halves that may overlap."""
    while (n := z.shape[1]) > 1:
        m = (n + 1) // 2
        z = np.maximum(z[:, :m], z[:, n - m :])
    return z[:, 0]


class Tagger:
    """The model with its filters added up for every pair of bytes."""

    def __init__(self, model: Model):
        self.model = model
        if not model.labels:
            return
        a, b = np.divmod(np.arange(65536), 256)
        two, three, four = model.conv
        self.pairs = np.concatenate([two[0][a] + two[1][b], three[0][a] + three[1][b], four[0][a] + four[1][b], four[2][a] + four[3][b]], 1)
        self.third = np.ascontiguousarray(three[2])

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """A row of label probabilities for each window."""
        out = np.empty((len(rows), len(self.model.labels)), np.float32)
        f = FILTERS
        for at in range(0, len(rows), BATCH_WINDOWS):
            x = rows[at : at + BATCH_WINDOWS].astype(np.intp)
            pair = self.pairs.take(x[:, :-1] * 256 + x[:, 1:], axis=0)
            third = self.third.take(x[:, 2:], axis=0)
            pooled = [pool(pair[:, :, :f]), pool(pair[:, :-1, f : 2 * f] + third), pool(pair[:, :-2, 2 * f : 3 * f] + pair[:, 2:, 3 * f :])]
            z = np.tanh(np.concatenate(pooled, 1)) @ self.model.dense + self.model.bias
            p = np.exp(z - z.max(1, keepdims=True))
            out[at : at + BATCH_WINDOWS] = p / p.sum(1, keepdims=True)
        return out

    def tag(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Label and score of each text: the mean over its windows, weighted by their bytes."""
        said, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not todo or not self.model.labels:
            return said, score
        cut = [windows(texts[i].encode()) for i in todo]
        p = self.probabilities(np.concatenate(cut))
        starts = np.cumsum([0, *map(len, cut)])[:-1]
        size = np.full(len(p), WINDOW, np.float64)
        for i, at, c in zip(todo, starts, cut):  # the last window is filled up with zeros
            size[at + len(c) - 1] = min(WINDOW, len(texts[i].encode()) - (len(c) - 1) * STEP)
        mean = np.add.reduceat(p * size[:, None], starts, 0) / np.add.reduceat(size, starts)[:, None]
        for i, row in zip(todo, mean):
            k = int(row.argmax())
            said[i], score[i] = self.model.labels[k], float(min(1.0, row[k]))
        return said, score


def learn(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model:
    """A model from a bounded sample of the rows with a label and a letter.

    The sample has at most SAMPLE_ROWS rows of each label, and SAMPLE_ALL in all, shared among all labels with one row each at
    least; picked by a hash of the id, and of each text one window's worth of characters from a
    place that the hash picks. No label is left out; the driver holds the list of labels. No label gives an empty model.
    """
    fit = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in fit.groupBy(lang_col).count().collect()}
    if not counts:
        return Model([], [], np.zeros(0), np.zeros(0))
    most = max(1, min(SAMPLE_ROWS, SAMPLE_ALL // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (1.2 * most + 20) / n))])
    h = hash60(key_text(id_col), F.lit("langid"))
    n = F.length(text_col)
    at = F.pmod(h, F.greatest(F.lit(1), n - WINDOW)) + 1
    rows = (
        fit.where(h < share[F.col(lang_col)] * F.lit(2.0**60))
        .select(h.alias("h"), F.col(text_col).substr(at.cast("int"), F.lit(WINDOW)).alias("t"), F.col(lang_col).alias("l"))
        .orderBy("h", "l", "t").limit((2 * most + 40) * len(counts)).collect()
    )
    taken: dict[str, int] = {}
    texts, labels = [], []
    for r in rows:
        taken[r.l] = taken.get(r.l, 0) + 1
        if taken[r.l] <= most:
            texts.append(r.t.encode()[:WINDOW])
            labels.append(r.l)
    return train(texts, labels)


def identify(df: DataFrame, id_col: str, text_col: str, model: Model, keep: list[str] = ()) -> DataFrame:
    """One row for each row: id, lang_pred, score, and the columns in `keep`.

    Every byte of a text is in a window. `und` with score 0 where the text is null, empty or without a letter, or where
    the model has learned no label. Ids may repeat or be null.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(astuple(model))  # plain arrays, as workers may lack this package: a few hundred KB, fixed by the bounds above
    names = [id_col, *keep]
    inner = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(text_col).alias("t"))
    schema = inner.drop("t").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Model(*sent.value))
        for batch in batches:
            said: list[str] = []
            score: list[float] = []
            for at in range(0, batch.num_rows, 64):
                a, b = tagger.tag(batch.column(len(names)).slice(at, 64).to_pylist())
                said += a
                score += b
            columns = [*batch.columns[: len(names)], pa.array(said, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: len(names)], "lang_pred", "score"])
        free_memory()

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "lang_pred", "score")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out("doc_id")), "doc_id", "text", "lang")
    out = identify(docs, "doc_id", "text", model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
