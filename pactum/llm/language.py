"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Bytes (A-Z in lower case) have learned embeddings; filters of several widths run over a fixed-length
window, each is max-pooled over the window, and a softmax layer gives the languages' probabilities.  A text
is cut into windows from its first byte to its last; its probabilities are the windows' mean, weighted by
their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactum.llm.frames import held_out_remainder, text_chunks
from pactum.llm.words import LOWER

WINDOW, EMBEDDING, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
#: The bounded sample that the network is fitted on: texts of each language, windows of each text.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 400, 4
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Windows that are scored at once.
SCORED = 512
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 by EMBEDDING
    filters: np.ndarray  # widest width * EMBEDDING by all filters; rows beyond a filter's own width are 0
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """Windows by places by embedded bytes of the widest filter; beyond the window's end there are zeros."""
        x = np.zeros((len(windows), WINDOW + WIDTHS[-1] - 1, EMBEDDING), np.float32)
        x[:, :WINDOW] = self.embedding[windows]
        n, _, e = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, WINDOW, WIDTHS[-1] * e), (s[0], s[1], s[2]))

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        places = self.patches(windows).reshape(-1, len(self.filters)) @ self.filters
        return np.maximum(places.reshape(len(windows), WINDOW, -1).max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(windows) @ self.weights + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes in each): every byte of every text is in one window."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[text] + nth * WINDOW
    used = np.minimum(WINDOW, offsets[text + 1] - start)
    at = np.minimum(start[:, None] + np.arange(WINDOW), max(len(data) - 1, 0))
    windows = np.where(np.arange(WINDOW) < used[:, None], LOWER[data][at] if len(data) else 0, 0)
    return windows.astype(np.uint8), text, used


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on the cross entropy of windows; each language counts alike."""
    rng = np.random.default_rng(seed)
    widest, total = WIDTHS[-1], FILTERS * len(WIDTHS)
    mask = np.zeros((widest, EMBEDDING, total), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    mask = mask.reshape(-1, total)
    net = Network(
        languages, rng.normal(0, 1, (256, EMBEDDING)).astype(np.float32),
        (rng.normal(0, 0.2, mask.shape) * mask).astype(np.float32), np.zeros(total, np.float32),
        rng.normal(0, 0.1, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    net.embedding[0] = 0  # what pads a window
    names = ("embedding", "filters", "bias", "weights", "offset")
    moments = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in names}
    step, counts = 0, np.bincount(labels, minlength=len(languages))
    weight = (len(labels) / (len(languages) * np.maximum(counts, 1))).astype(np.float32)
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            x, y = windows[some], labels[some]
            n = len(x)
            patches = net.patches(x)
            places = (patches.reshape(-1, len(net.filters)) @ net.filters).reshape(n, WINDOW, -1)
            best = places.argmax(axis=1)
            high = np.take_along_axis(places, best[:, None], axis=1)[:, 0] + net.bias
            p = softmax(np.maximum(high, 0) @ net.weights + net.offset)
            p[np.arange(n), y] -= 1
            p *= weight[y][:, None] / n
            g = {"weights": np.maximum(high, 0).T @ p, "offset": p.sum(axis=0)}
            back = (p @ net.weights.T) * (high > 0)
            g["bias"] = back.sum(axis=0)
            chosen = patches[np.arange(n)[:, None], best]  # windows by filters by patch
            g["filters"] = np.einsum("nfp,nf->pf", chosen, back) * mask
            into = (back[:, :, None] * net.filters.T[None]).reshape(n, total, widest, EMBEDDING)
            g["embedding"] = np.zeros_like(net.embedding)
            for o in range(widest):
                at = best + o
                inside = at < WINDOW
                byte = np.take_along_axis(x, np.minimum(at, WINDOW - 1), axis=1)
                np.add.at(g["embedding"], byte[inside], into[:, :, o][inside])
            g["embedding"][0] = 0
            step += 1
            for name in names:
                m, v = moments[name]
                m += 0.1 * (g[name] - m)
                v += 0.001 * (g[name] ** 2 - v)
                getattr(net, name)[...] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(labelled: DataFrame, texts: int = SAMPLE_TEXTS, seed: int = 7) -> Network | None:
    """A network from the columns text and lang: at most `texts` texts of each language, chosen by their
    hash, and SAMPLE_WINDOWS windows of each, spread over the text.  None if no row has text and label."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").where(F.length("text") > 0)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    # only the spread-out windows leave the executors
    sample = rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= texts).select(
        "lang", F.encode("text", "UTF-8").alias("b")).select(
        "lang", F.explode(F.transform(
            F.sequence(F.lit(0), F.least(F.lit(SAMPLE_WINDOWS), F.ceil(F.length("b") / WINDOW)).cast("int") - 1),
            lambda k: F.substring("b", (F.floor(k * F.length("b") / SAMPLE_WINDOWS)).cast("int") + 1, F.lit(WINDOW)))).alias("w"))
    found = sample.orderBy("lang", "w").collect()
    if not found:
        return None
    languages = sorted({r.lang for r in found})
    data = np.frombuffer(b"".join(bytes(r.w) for r in found), np.uint8)
    windows, _, _ = cut(data, np.cumsum([0, *(len(r.w) for r in found)]))
    return train(windows, np.array([languages.index(r.lang) for r in found]), languages, seed)


def judge(batch: pa.RecordBatch, net: Network | None) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each row of text and has_letter."""
    letters = np.asarray(batch.column("has_letter").fill_null(False))
    names, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
    for first, last, data, offsets in text_chunks(batch) if net else ():
        windows, text, used = cut(data, offsets)
        sums = np.zeros((last - first, len(net.languages)))
        for k in range(0, len(windows), SCORED):
            some = slice(k, k + SCORED)
            np.add.at(sums, text[some], net.probabilities(windows[some]) * used[some, None])
        sums /= np.maximum(np.diff(offsets), 1)[:, None]
        sure = letters[first:last]
        names[first:last][sure] = np.array(net.languages, object)[sums.argmax(axis=1)][sure]
        scores[first:last][sure] = np.minimum(sums.max(axis=1), 1)[sure]
    return names, scores


def _has_letter():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def _learned(docs: DataFrame, texts: int) -> Network | None:
    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"), held_out_remainder().alias("fold"))
    return fit(rows.where("fold <> 0"), texts)


def identified(docs: DataFrame, least: float = 0.4, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """The rows of `docs`, with all columns, that have a language with a score of `least` or more.  Rows
    without a letter are rejected; so are all, where nothing could be learned."""
    sent = docs.sparkSession.sparkContext.broadcast(_learned(docs, texts))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = pa.RecordBatch.from_arrays([batch.column("text"), batch.column(batch.num_columns - 1)], ["text", "has_letter"])
            names, scores = judge(asked, sent.value)
            yield batch.filter(pa.array((names != UNKNOWN) & (scores >= least))).select(range(batch.num_columns - 1))

    return docs.select("*", _has_letter().alias("__has_letter")).mapInArrow(kept, docs.schema)


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """The rows of `docs` (id, text as string, has_letter) as id, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = judge(batch, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Learns from text and lang of rows that aren't held out (crc32 of the id as text, modulo 5, is not 0)
    and have both.  lang_pred is `und` with score 0 where text is null or has no letter, or where nothing
    could be learned; score is the predicted language's probability.  Equal texts get equal results; null
    ids are kept; other columns are left out; no rows give no rows.
    """
    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _has_letter().alias("has_letter"))
    return predict(asked, _learned(docs, texts)).select("doc_id", (held_out_remainder() == 0).alias("held_out"), "lang_pred", "score")
