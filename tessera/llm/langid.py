"""Language identification with a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths slide over windows of fixed length; each filter's largest response over
the window goes through a rectifier into a softmax. A text's windows overlap by the widest filter less one, so every byte
string a filter can see is seen; their probabilities are averaged by length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, byte_lists, documents

WINDOW, LOT = 256, 96  # bytes in a window; windows computed at once
DIMENSIONS, FILTERS, WIDTHS = 8, 8, (2, 3, 4)
NEARLY = re.compile(r"[^\W\d_]")  # letters, and signs such as a half or a square
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in NEARLY.finditer(text))


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x DIMENSIONS
    filters: np.ndarray  # (widest * DIMENSIONS) x all filters; rows beyond a filter's width are zero
    bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray


def pieces(windows: np.ndarray, embedding: np.ndarray) -> np.ndarray:
    """All runs of the widest filter's length, embedded: windows x places x (width * dimensions)."""
    n, length = windows.shape
    embedded = embedding[windows].reshape(n, -1)
    widest = max(WIDTHS) * DIMENSIONS
    s0, s1 = embedded.strides
    return np.lib.stride_tricks.as_strided(embedded, (n, length - max(WIDTHS) + 1, widest), (s0, s1 * DIMENSIONS, s1))


def responses(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled responses before the rectifier, and all of them."""
    p = pieces(windows, net.embedding)
    all_ = (np.ascontiguousarray(p).reshape(-1, p.shape[2]) @ net.filters).reshape(p.shape[0], p.shape[1], -1)
    return all_.max(axis=1) + net.bias, all_


def probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    out = np.empty((len(windows), len(net.languages)), np.float32)
    for at in range(0, len(windows), LOT):
        pooled, _ = responses(net, windows[at : at + LOT])
        z = np.maximum(pooled, 0) @ net.output + net.output_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out[at : at + LOT] = z / z.sum(axis=1, keepdims=True)
    return out


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, zero-padded; the text each belongs to, and its bytes."""
    step = WINDOW - max(WIDTHS) + 1
    parts, owner, size = [], [], []
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - max(WIDTHS) + 1), step):
            part = t[at : at + WINDOW]
            parts.append(part.ljust(WINDOW, b"\0"))
            owner.append(k)
            size.append(max(1, len(part)))
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW), np.array(owner), np.array(size, np.float32)


def train(texts: list[bytes], labels: list[str], seed: int = 1, epochs: int = 8, lot: int = 64, rate: float = 0.004) -> Network:
    """Fits the network with Adam on the windows of the texts; same texts and seed, same network."""
    languages = sorted(set(labels))
    windows, owner, _ = cut_windows(texts)
    y = np.array([languages.index(x) for x in labels])[owner]
    rng = np.random.default_rng(seed)
    widest, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(widest * DIMENSIONS) < w * DIMENSIONS)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1).astype(np.float32)
    f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = Network(languages, f32(256, DIMENSIONS, scale=0.5), f32(widest * DIMENSIONS, n_filters, scale=0.3) * mask, np.zeros(n_filters, np.float32), f32(n_filters, len(languages), scale=0.3), np.zeros(len(languages), np.float32))
    names = ("embedding", "filters", "bias", "output", "output_bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), lot):
            rows = order[at : at + lot]
            x, n = windows[rows], len(rows)
            pooled, all_ = responses(net, x)
            place = all_.argmax(axis=1)  # n x filters
            hidden = np.maximum(pooled, 0)
            z = hidden @ net.output + net.output_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[rows]] -= 1
            p /= n
            back = (p @ net.output.T) * (pooled > 0)
            seen = x[np.arange(n)[:, None, None], place[:, :, None] + np.arange(widest)]  # n x filters x widest bytes
            embedded = net.embedding[seen].reshape(n, n_filters, -1)
            into = (back[:, :, None] * net.filters.T[None]).reshape(-1, DIMENSIONS)
            grad_e = np.zeros_like(net.embedding)
            np.add.at(grad_e, seen.ravel(), into)
            grads = {"embedding": grad_e, "filters": np.einsum("nf,nfk->kf", back, embedded) * mask, "bias": back.sum(axis=0), "output": hidden.T @ p, "output_bias": p.sum(axis=0)}
            step += 1
            for k in names:
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.001 * (grads[k] ** 2 - second[k])
                getattr(net, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, sampled: int = 4_000, piece: int = 300) -> Network | None:
    """A network from about ``sampled`` labelled documents that are not held out, chosen by a hash of doc_id, a piece of each; None if there is none.

    The bound keeps training on the driver the same size whatever the corpus; prediction covers everything.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    grain = 2**53
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(grain))  # with the text: null doc_ids differ in it
    share = sampled / max(1, usable.count())
    start = F.pmod(F.xxhash64("text", F.lit(5)), F.greatest(F.length("text") - piece, F.lit(1))) + 1
    rows = usable.where(mark < int(min(1.0, share) * grain)).select(F.substring("text", start.cast("int"), F.lit(piece)).alias("t"), "lang").collect()
    rows = sorted((r.t.encode(), r.lang) for r in rows if has_letter(r.t))
    return train([t for t, _ in rows], [lang for _, lang in rows]) if rows else None


def predict(net: Network | None, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    good = [k for k, t in enumerate(texts) if net is not None and has_letter(t.decode())]
    for at in range(0, len(good), 200):
        part = good[at : at + 200]
        windows, owner, size = cut_windows([texts[k] for k in part])
        total = np.zeros((len(part), len(net.languages)))
        np.add.at(total, owner, probabilities(net, windows) * size[:, None])
        total /= total.sum(axis=1, keepdims=True)
        for k, row in zip(part, total, strict=True):
            pred[k], score[k] = net.languages[int(row.argmax())], float(row.max())
    return pred, score


def predicting(net: Network | None):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            yield batch(schema, b.column("doc_id"), b.column("held_out"), *predict(net, byte_lists(b.column("text"))))

    return run


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row.

    Text that is null or has no letter is "und" with score 0, and so is everything if nothing could be learned.
    Rows that repeat a document are predicted alike; a null doc_id is not held out. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(predicting(net), "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs without those whose language the network can't tell ("und": null or empty text, no letter).

    All other rows stay as they are, repeated ones too, and so do all columns, whatever their names; nothing is shuffled.
    Whole rows pass through Python as Arrow batches, taken some rows at a time.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                known = [x != UNKNOWN for x in predict(net, byte_lists(part.column("text")))[0]]
                yield part.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs))
