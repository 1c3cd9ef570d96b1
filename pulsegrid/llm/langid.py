"""Language identification with a byte-level convolutional network, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_batches, fresh

#: Bytes in a window, widths of the filters, and filters of each width.
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Labelled documents of a language, and windows of these documents, that are learned from; and steps of training.
DOCS_PER_LANGUAGE = 500
WINDOWS_PER_LANGUAGE = 6_000
STEPS = 400
#: Windows classified at once.
AT_ONCE = 8_192
#: A prediction below this score is rejected; with four languages chance gives 0.25.
REJECT_BELOW = 0.4


@dataclass
class Model:
    languages: list[str]
    filters: list[np.ndarray]  # for each width (width, 256, FILTERS)
    bias: np.ndarray
    weights: np.ndarray  # (features, languages)
    offset: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a pair of bytes adds to all filters, a third byte to those of width 3, a second pair to those of width 4."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(1 << 16, -1)
        f2, f3, f4 = self.filters
        first = np.concatenate([pair(f2[0], f2[1]), pair(f3[0], f3[1]), pair(f4[0], f4[1])], axis=1)
        return first.astype(np.float32), f3[2].astype(np.float32), pair(f4[2], f4[3]).astype(np.float32)

    def predict(self, windows: np.ndarray, tables=None) -> np.ndarray:
        """Probabilities of each window (n, WINDOW) of bytes."""
        first, third, second = tables or self.tables()
        f = FILTERS
        out = np.zeros((len(windows), 3 * f), np.float32)
        for at in range(0, len(windows), 32):
            x = windows[at : at + 32]
            codes = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
            g = first[codes]
            h = out[at : at + 32]
            h[:, :f] = g[:, :, :f].max(axis=1)
            h[:, f : 2 * f] = (g[:, :-1, f : 2 * f] + third[x[:, 2:]]).max(axis=1)
            h[:, 2 * f :] = (g[:, :-2, 2 * f :] + second[codes[:, 2:]]).max(axis=1)
        z = np.maximum(out + self.bias, 0) @ self.weights + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All fixed-length windows of lower-cased texts in UTF-8, the text of each, and its bytes without padding."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) for r in raw])
    many = -(-size // WINDOW)
    data = b"".join(r + bytes(-len(r) % WINDOW) for r in raw)
    of = np.repeat(np.arange(len(texts)), many)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), of, np.minimum(WINDOW, size[of] - nth * WINDOW)


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 5) -> Model | None:
    """Fits the network on all windows of whole texts."""
    x, of, size = windows_of(texts)
    return fit(x, size, [labels[i] for i in of], steps, seed)


def fit(x: np.ndarray, size: np.ndarray, labels: list[str], steps: int = STEPS, seed: int = 5) -> Model | None:
    """Fits the network by Adam on windows (n, WINDOW) with ``size`` bytes of text and a label each; None where there is nothing to learn from."""
    languages = sorted(set(labels))
    x, y = x[size >= 4], np.searchsorted(languages, labels)[size >= 4] if languages else np.zeros(0, np.int64)
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    k, f = len(languages), FILTERS
    params = [rng.normal(0, 0.3, (w, 256, f)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(3 * f, np.float32), rng.normal(0, 0.2, (3 * f, k)).astype(np.float32), np.zeros(k, np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_label = [np.flatnonzero(y == c) for c in range(k)]
    by_label = [a for a in by_label if len(a)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(a, max(8, 192 // k)) for a in by_label])
        b, t = x[pick].copy(), y[pick]
        short = rng.integers(6, WINDOW + 1, len(b))
        short[rng.random(len(b)) < 0.6] = WINDOW
        b[np.arange(WINDOW) >= short[:, None]] = 0  # short texts are padded like this
        rows, tops, args = np.arange(len(b)), [], []
        for w, e in zip(WIDTHS, params, strict=False):
            n = WINDOW - w + 1
            conv = sum(e[j][b[:, j : j + n]] for j in range(w))
            args.append(conv.argmax(axis=1))
            tops.append(np.take_along_axis(conv, args[-1][:, None, :], axis=1)[:, 0])
        pre = np.concatenate(tops, axis=1) + params[3]
        act = np.maximum(pre, 0)
        z = act @ params[4] + params[5]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = p
        d[rows, t] -= 1
        d /= len(b)
        back = (d @ params[4].T) * (pre > 0)
        grads = []
        for i, w in enumerate(WIDTHS):
            g = np.zeros((w, 256, f), np.float32)
            mine = back[:, i * f : (i + 1) * f]
            for j in range(w):
                np.add.at(g[j], (b[rows[:, None], args[i] + j], np.arange(f)[None, :]), mine)
            grads.append(g)
        grads += [back.sum(axis=0), act.T @ d + 1e-4 * params[4], d.sum(axis=0)]
        rate = 0.02 * (1 - 0.9 * step / steps)
        for i, g in enumerate(grads):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)
    return Model(languages, params[:3], params[3], params[4], params[5])


def fold(doc_id):
    return F.crc32(doc_id.cast("string")) % 3


def learn(docs: DataFrame) -> Model | None:
    """Learns from text and lang of documents whose fold is not 1.

    At most DOCS_PER_LANGUAGE documents of each language, the first by a hash of the id, are
    cut into windows, from their first byte to their last; of these at most
    WINDOWS_PER_LANGUAGE, again by a hash, come to the driver.  A first pass counts the
    documents of each language, so that of a frequent one only a share that the bound needs is
    read and ordered.  Of each language the driver gets one count and these windows.
    """
    known = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 1)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language, as in the network's last layer
    if not counts:
        return None
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    shares = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 4.0 * DOCS_PER_LANGUAGE / n))])
    some = known.where((spread <= shares[F.col("lang")]) & F.col("text").rlike(r"\p{L}"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    some = some.withColumn("nth", order).where(F.col("nth") <= DOCS_PER_LANGUAGE)

    def cut(batches):
        for b in batches:
            x, of, size = windows_of(b.column("text").to_pylist())
            lang, nth = (b.column(c).take(pa.array(of)) for c in ("lang", "nth"))
            yield pa.RecordBatch.from_arrays([lang, nth, pa.array(np.arange(len(of))), pa.array(size), pa.array([w.tobytes() for w in x], pa.binary())], ["lang", "nth", "at", "size", "bytes"])

    windows = some.mapInArrow(cut, "lang string, nth int, at long, size long, bytes binary").where("size >= 4")
    windows = windows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("nth", "at"), "nth", "at", "bytes")))
    rows = windows.where(F.col("rank") <= WINDOWS_PER_LANGUAGE).orderBy("lang", "rank").select("lang", "size", "bytes").collect()
    x = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8).reshape(-1, WINDOW)
    return fit(x, np.array([r["size"] for r in rows], np.int64), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of docs with the language and its score, for the whole text of each row.

    All windows of a text are classified; their probabilities are averaged by bytes.  Null
    texts and texts without a letter are ``und`` with score 0, and so is everything where
    nothing could be learned.
    """
    arrow_batches(docs.sparkSession)
    schema = StructType([*(docs.schema[c] for c in keep), StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches):
        tables = model.tables() if model else None
        for b in batches:
            pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            at = np.flatnonzero(np.asarray(b.column(1).cast(pa.int8()))) if model else []
            if len(at):
                x, of, size = windows_of(b.column(0).take(pa.array(at)).to_pylist())
                mean = np.zeros((len(at), len(model.languages)))
                for i in range(0, len(x), AT_ONCE):
                    p, o, n = model.predict(x[i : i + AT_ONCE], tables), of[i : i + AT_ONCE], size[i : i + AT_ONCE]
                    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                    mean[o[first]] += np.add.reduceat(p * n[:, None].astype(np.float64), first, axis=0)
                mean /= np.bincount(of, size, len(at))[:, None]
                best = mean.argmax(axis=1)
                for i, k in zip(at, best, strict=True):
                    pred[i] = model.languages[k]
                score[at] = np.clip(mean[np.arange(len(at)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(pred, pa.string()), pa.array(score)], schema.names)

    text, letters = fresh(keep, "text", "letters")
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("text").alias(text), has_letter.alias(letters), *keep).mapInArrow(run, schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...) whose language is known: neither ``und`` nor scored below REJECT_BELOW.

    Null and empty texts and texts without a letter are ``und`` and go; repeated rows are judged
    alike; texts of any length are read whole.  Other columns, whatever their names, stay as
    they are.  Where nothing could be learned, for want of labels, all rows stay; an empty
    table stays empty.
    """
    model = learn(docs)
    if model is None:
        return docs
    names = tuple(fresh(docs.columns, "lang_pred", "score"))
    told = identify(docs, model, tuple(docs.columns), names)
    return told.where((F.col(names[0]) != "und") & (F.col(names[1]) >= REJECT_BELOW)).select(*docs.columns)


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of documents (doc_id, text, lang), one row per input row.

    The network learns from the folds that are not held out.  A null doc_id is in no fold: it
    is not learned from and not held out.  Repeated rows get the same result each; null texts are
    ``und``; texts of any length are read whole; an empty table gives an empty result.
    """
    out = identify(docs.select(F.col("doc_id").cast("long"), "text"), learn(docs))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
