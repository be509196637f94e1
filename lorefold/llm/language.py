"""Missing or wrong document language labels.

Method: a byte convolutional network. Texts are cut into batched fixed-length windows of UTF-8 bytes;
bytes are embedded, filters of several widths run over each window, max pooling over the window
gives one feature per filter, and a softmax layer gives the language. The network is trained in
numpy on labelled text by Adam, in two passes. The first reads at most `max_samples` labelled texts.
The second adds at most `max_rows` rows of the corpus whose item carries a label that the first
network confirms on the whole row; sentences it takes for another language are left out. That
teaches it the words that samples lack. These bounds are the only ones: every byte of every
document is classified.

Units are the sentences and lines of a text. Each is laid out from its first byte on, as in training,
and cut into overlapping windows; features are pooled over short blocks first, so each filter runs
once per byte however much windows overlap. The languages of a text's units are its most probable
sequence with a cost for each change, so that a short unit of small margin follows its neighbours.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefold.operators.latest import holding_rows
from lorefold.session import shared_folder

LANGUAGES = ("de", "en", "es", "fr", "pt", "zh")
BLOCK, BLOCKS = 16, 4  # a window is BLOCKS blocks of BLOCK bytes, one starts at every block
WIDTHS, FILTERS, DIM = (2, 3, 4), 24, 8
MAX_SAMPLES, MAX_ROWS = 20_000, 12_000
STEPS, SEEDS = 1200, (7, 8)
MIN_RUN, MIN_RUN_WIDE = 40, 20

# Codes and names of the languages, in lower case.
NAMES = {
    "en": "en eng english englisch anglais inglés ingles inglês 英语 英文",
    "de": "de deu ger german deutsch allemand alemán aleman alemão alemao 德语 德文",
    "fr": "fr fra fre french französisch franzoesisch français francais francés frances francês 法语 法文",
    "es": "es spa spanish spanisch espagnol español espanol castellano espanhol 西班牙语 西班牙文",
    "pt": "pt por portuguese portugiesisch portugais portugués portugues português 葡萄牙语 葡萄牙文",
    "zh": "zh zho chi cmn chinese chinesisch chinois chino chinês chines 中文 汉语 华语",
}
_BY_NAME = {name: code for code, names in NAMES.items() for name in names.split()}


def label_language(label: str | None) -> str | None:
    """The language a free-form label names: a code of two or three letters, with or without a
    region, or a name. None for null, empty, und and anything else."""
    if not label:
        return None
    base = re.split(r"[-_ (,;]", label.strip().lower(), maxsplit=1)[0]
    return _BY_NAME.get(base)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = 48

_BLANK = re.compile(rb"\xe3\x80\x80|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xaf]|\xef\xbb\xbf|\xc2[\xa0\xad]")
_NAME = re.compile(rb"(?<=[a-z,;0-9] )[A-Z](?:[A-Za-z0-9'-]|\xc3[\x80-\xbf])*")


def without_names(raw: bytes) -> bytes:
    """The text with odd and invisible spaces and capitalised words inside sentences blanked, its length
    kept. Names may be made of any language's words; German nouns go too, its small words stay."""
    if not raw.isascii():
        raw = _BLANK.sub(lambda m: b" " * len(m.group()), raw)
    return _NAME.sub(lambda m: b"\0" * len(m.group()), raw)


def fold_case(data: np.ndarray) -> np.ndarray:
    """Bytes with the capital letters of ASCII and Latin-1, as UTF-8 spells them, made small and all digits
    made 0."""
    out = _LOWER[data]
    marked = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[marked] += 32
    return out


@dataclass
class Network:
    """Weights of one network, or of several side by side whose logits are averaged. kernel: all filters as
    one matrix over the widest span, zero beyond a narrower filter's own."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def average(cls, nets: list[Network]) -> Network:
        """Networks side by side: each filter sees its own network's embedding only."""
        widest, dims, filters = max(WIDTHS), [n.embed.shape[1] for n in nets], [n.kernel.shape[1] for n in nets]
        kernel = np.zeros((widest, sum(dims), sum(filters)), np.float32)
        for i, n in enumerate(nets):
            d, f = sum(dims[:i]), sum(filters[:i])
            kernel[:, d : d + dims[i], f : f + filters[i]] = n.kernel.reshape(widest, dims[i], -1)
        share = np.float32(1 / len(nets))
        return cls(np.hstack([n.embed for n in nets]), kernel.reshape(-1, sum(filters)), np.concatenate([n.bias for n in nets]), np.vstack([n.out for n in nets]) * share, sum(n.out_bias for n in nets) * share)

    def features(self, data: np.ndarray, batch: int = 8192) -> np.ndarray:
        """Pooled filter outputs of each block of BLOCK bytes; data is padded to whole blocks."""
        widest, dim = max(WIDTHS), self.embed.shape[1]
        n = len(data) // BLOCK
        padded = np.concatenate([data, np.zeros(widest, np.uint8)])
        pooled = np.empty((n, self.kernel.shape[1]), np.float32)
        for at in range(0, n * BLOCK, batch):
            size = min(batch, n * BLOCK - at)
            e = self.embed[padded[at : at + size + widest - 1]]
            view = np.lib.stride_tricks.as_strided(e, (size, widest * dim), (e.strides[0], e.strides[1]))
            h = np.ascontiguousarray(view) @ self.kernel
            pooled[at // BLOCK : (at + size) // BLOCK] = h.reshape(size // BLOCK, BLOCK, -1).max(axis=1)
        return np.maximum(pooled + self.bias, 0)

    def log_softmax(self, windows: np.ndarray) -> np.ndarray:
        """Log probabilities of the languages from pooled features, one row per window."""
        z = windows @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def save(self) -> bytes:
        """The weights as bytes."""
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        """The network that save() wrote."""
        return cls(**np.load(io.BytesIO(data)))


def _training_windows(pools: list[list[bytes]], rng: np.random.Generator, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows cut from the pools' texts and their classes, which are drawn alike: half of them begin with
    a text, as in use, the others anywhere in two texts joined; a third are cut short; words of
    other languages stand in some, so that names, which may be made of any language's words, do not
    decide."""
    size, present = BLOCK * BLOCKS, [i for i, p in enumerate(pools) if p]
    x = np.zeros((count, size + max(WIDTHS) - 1), np.uint8)
    y = np.array(present)[rng.integers(len(present), size=count)]
    dice = rng.random((count, 7))
    for i in range(count):
        pool, u = pools[y[i]], dice[i]
        text = pool[int(u[0] * len(pool))]
        if u[1] < 0.5:
            text += b" " + pool[int(u[2] * len(pool))]
            text = text[int(u[1] * 2 * max(1, len(text) - size)) :]
        piece = text[:size]
        if u[3] < 0.35:
            piece = piece[: 12 + int(u[3] / 0.35 * (size - 12))]
        if u[4] < 0.35:
            other = pools[present[int(u[4] / 0.35 * len(present))]]
            words = other[int(u[5] * len(other))].split()
            first = int(u[6] * len(words))
            name = b" ".join(words[first : first + 1 + int(u[5] * 997) % 3])[:24]
            spot = int(u[6] * 991) % (len(piece) + 1)
            spot = piece.rfind(b" ", 0, spot) + 1 if LANGUAGES[y[i]] != "zh" else spot - spot % 3
            piece = (piece[:spot] + name + b" " + piece[spot:])[:size]
        lead = 0 if u[1] < 0.5 else max(WIDTHS) - 1  # a text begins behind zeros, as in unit_scores
        x[i, lead : lead + len(piece)] = np.frombuffer(piece, np.uint8)
    return fold_case(x.ravel()).reshape(x.shape), y


def _fold(texts: list[str]) -> list[bytes]:
    return [without_names(t.encode("utf-8", "replace")) for t in texts if t]


def train(texts: list[str], labels: list[str], steps: int = STEPS, batch: int = 64, rate: float = 0.004, seed: int = SEEDS[0], begin: Network | None = None) -> Network:
    """Fit the network, from `begin` on if it is given, on windows cut at random from the labelled texts.
    Filters are left out at random while training, so that no few of them decide."""
    rng = np.random.default_rng(seed)
    size, classes = BLOCK * BLOCKS, len(LANGUAGES)
    pools = [_fold([t for t, label in zip(texts, labels) if label == language]) for language in LANGUAGES]
    widest, k_out = max(WIDTHS), len(WIDTHS) * FILTERS
    spread = {"embed": 0.3, "out": 0.1, "bias": 0.0, "out_bias": 0.0} | {f"f{i}": 0.25 for i in range(len(WIDTHS))}
    shapes = {"embed": (256, DIM), "out": (k_out, classes), "bias": (k_out,), "out_bias": (classes,)} | {f"f{i}": (w * DIM, FILTERS) for i, w in enumerate(WIDTHS)}
    p = {k: rng.normal(0, spread[k], shape) for k, shape in shapes.items()}
    if begin is not None:
        p = {"embed": begin.embed, "out": begin.out, "bias": begin.bias, "out_bias": begin.out_bias}
        p |= {f"f{i}": begin.kernel[: w * DIM, i * FILTERS : (i + 1) * FILTERS] for i, w in enumerate(WIDTHS)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    rows, places = np.arange(batch)[:, None], np.arange(DIM)
    stock = min(steps * batch, 65_536)
    mean: dict[str, np.ndarray] = {}
    for step in range(1, steps + 1):
        at = (step - 1) * batch % stock
        if at == 0:
            xs, ys = _training_windows(pools, rng, stock)
        x, y = xs[at : at + batch], ys[at : at + batch]
        e = p["embed"][x]
        grads, feats, args, spans = {}, [], [], []
        for i, w in enumerate(WIDTHS):
            span = np.lib.stride_tricks.sliding_window_view(e, (w, DIM), axis=(1, 2))[:, :size, 0].reshape(batch, size, w * DIM)
            h = span @ p[f"f{i}"]
            a = h.argmax(axis=1)
            feats.append(np.take_along_axis(h, a[:, None], 1)[:, 0])
            args.append(a)
            spans.append(span)
        pre = np.concatenate(feats, 1) + p["bias"]
        kept = ((rng.random(pre.shape, np.float32) < 0.8) / np.float32(0.8)) * (pre > 0)
        f = pre * kept
        z = f @ p["out"] + p["out_bias"]
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(1, keepdims=True)
        q[np.arange(batch), y] -= 1
        q /= batch
        grads["out"], grads["out_bias"] = f.T @ q, q.sum(0)
        g = (q @ p["out"].T) * kept
        grads["bias"] = g.sum(0)
        spots, pushes = [], []
        for i, w in enumerate(WIDTHS):
            gi = g[:, i * FILTERS : (i + 1) * FILTERS]
            grads[f"f{i}"] = np.einsum("bfk,bf->kf", spans[i][rows, args[i]], gi)
            back = np.einsum("bf,kf->bfk", gi, p[f"f{i}"]).reshape(batch, FILTERS, w, DIM)
            spots.append((x[rows[:, :, None], args[i][:, :, None] + np.arange(w)].astype(np.int64)[..., None] * DIM + places).ravel())
            pushes.append(back.ravel())
        grads["embed"] = np.bincount(np.concatenate(spots), np.concatenate(pushes), 256 * DIM).reshape(256, DIM)
        lr = rate * min(1.0, step / 50) * (0.1 if step > 0.8 * steps else 1.0)
        for k, gk in grads.items():
            gk = gk + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * gk
            v[k] = 0.99 * v[k] + 0.01 * gk * gk
            p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        if step > 0.8 * steps:  # the weights kept are the mean over the last steps
            for k, w in p.items():
                mean[k] = mean.get(k, 0) + w
    p = {k: (x / (steps - int(0.8 * steps))).astype(np.float32) for k, x in mean.items()}
    kernel = np.zeros((widest * DIM, k_out), np.float32)
    for i, w in enumerate(WIDTHS):
        kernel[: w * DIM, i * FILTERS : (i + 1) * FILTERS] = p[f"f{i}"]
    return Network(p["embed"], kernel, p["bias"], p["out"], p["out_bias"])


def train_several(texts: list[str], labels: list[str], seeds: tuple[int, ...], begin: list[Network] | None = None, **settings: float) -> list[Network]:
    """One network for each seed, trained at the same time."""
    with ThreadPoolExecutor(len(seeds)) as pool:
        return list(pool.map(lambda s, b: train(texts, labels, seed=s, begin=b, **settings), seeds, begin or [None] * len(seeds)))


def confirmed_units(net: Network, texts: list[str], labels: list[str]) -> tuple[list[str], list[str]]:
    """Sentences of the texts whose label the network confirms, and their labels. A text counts if most of
    its characters are in the language of its label; a sentence that the network firmly gives to another language is
    left out."""
    out: list[str] = []
    langs: list[str] = []
    for text, label, (units, scores) in zip(texts, labels, unit_scores(net, texts)):
        sizes = np.array([hi - lo for lo, hi in units])
        k = LANGUAGES.index(label)
        if not len(units) or sizes[scores.argmax(axis=1) == k].sum() * 2 < sizes.sum():
            continue
        for (lo, hi), s in zip(units, scores):
            if hi - lo >= 8 and (s.argmax() == k or s.max() < FIRM):
                out.append(text[lo:hi])
                langs.append(label)
    return out, langs


def _kept_networks(spark: SparkSession, name: str, make: Callable[[], list[Network]]) -> list[Network]:
    """The networks of that name out of the shared folder, made and written there if they are not."""
    path = f"{shared_folder(spark).rstrip('/')}/networks-{name}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        rows = [(i, bytearray(n.save())) for i, n in enumerate(make())]
        spark.createDataFrame(rows, "place int, weights binary").coalesce(1).write.mode("overwrite").parquet(path)
    return [Network.load(bytes(r.weights)) for r in spark.read.parquet(path).orderBy("place").collect()]


def fit(samples: DataFrame, sections: DataFrame | None = None, items: DataFrame | None = None, text: str = "text", lang: str = "lang", max_samples: int = MAX_SAMPLES, max_rows: int = MAX_ROWS, steps: int = STEPS, seeds: tuple[int, ...] = SEEDS) -> Network:
    """The average of one network for each seed, trained on at most max_samples labelled rows, those with
    the smallest fingerprints, and then, if sections and items are given, on at most max_rows of the
    sections as well. Networks are kept in the shared folder under the fingerprint of what they were
    trained on, so the same data train once."""
    rows = samples.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null").orderBy(F.xxhash64("t"), "t", "l").limit(max_samples).collect()
    texts, labels = [r.t for r in rows], [label_language(r.l) or "" for r in rows]
    spark = samples.sparkSession
    mark = lambda *parts: xxhash.xxh64_hexdigest(repr((WIDTHS, FILTERS, DIM, BLOCK, BLOCKS, FIRM, steps, seeds, parts)).encode("utf-8", "replace"))
    nets = _kept_networks(spark, mark(texts, labels), lambda: train_several(texts, labels, seeds, steps=steps))
    if sections is None or items is None:
        return Network.average(nets)
    order = F.xxhash64("doc_id", "section_index", "content")
    some = _least(_prose(sections), order, max_rows).orderBy(order, "doc_id", "section_index", "content").limit(max_rows)
    more = item_labels(items).where("label is not null").join(F.broadcast(some), "doc_id").orderBy(order, "doc_id", "section_index", "content").select("content", "label").collect()
    own, own_labels = [r.content for r in more], [r.label for r in more]
    return Network.average(_kept_networks(spark, mark(texts, labels, own, own_labels), lambda: train_again(nets, texts, labels, own, own_labels, seeds, steps)))


def _least(rows: DataFrame, order: Column, most: int) -> DataFrame:
    """The rows whose fingerprint is so small that about four times `most` of them remain, so that no task sorts what
    grows with the table; all rows if they are few."""
    share = 4 * most / max(1, rows.count())
    return rows.where(order < F.lit(int(-(2**63) + share * 2**64))) if share < 1 else rows


def train_again(nets: list[Network], texts: list[str], labels: list[str], own: list[str], own_labels: list[str], seeds: tuple[int, ...] = SEEDS, steps: int = STEPS) -> list[Network]:
    """The networks trained further with the confirmed sentences of `own`; the labelled samples make up about a third of
    what is drawn of each language."""
    units, languages = confirmed_units(Network.average(nets), own, own_labels)
    share = {k: max(1, languages.count(k) // max(1, 2 * labels.count(k))) for k in LANGUAGES}
    both = [(t, k) for t, k in zip(texts, labels) for _ in range(share.get(k, 1))] + list(zip(units, languages))
    return train_several([t for t, _ in both], [k for _, k in both], tuple(s + 1000 for s in seeds), nets, steps=steps, rate=0.002)


# A change of language between units costs as much as this difference in log probability, one within a
# unit, where windows overlap, more. FIRM: the log probability from which a unit counts as decided.
TURN, SWITCH, FIRM = 1.0, 4.0, float(np.log(0.9))
_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|(?<=[。！？])\s*|\n+")


def _path(scores: np.ndarray, cost: float) -> np.ndarray:
    """Most probable sequence of classes with the given cost for each change. If every row prefers the
    same class, that constant path is the optimum and nothing is left to search."""
    top = scores.argmax(axis=1)
    if (top == top[0]).all():
        return top.astype(np.int8)
    n, k = scores.shape
    best, back = scores[0].copy(), np.zeros((n, k), np.int8)
    own = np.arange(k)
    for i in range(1, n):
        top = int(best.argmax())
        jump = best[top] - cost
        stay = best >= jump
        back[i] = np.where(stay, own, top)
        best = np.where(stay, best, jump) + scores[i]
    out = np.empty(n, np.int8)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _units(text: str) -> list[tuple[int, int]]:
    """Sentences and lines of the text, with the blanks behind them; they tile it."""
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    cuts = [0, *(e for e in ends if 0 < e < len(text)), len(text)]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]


def unit_scores(net: Network, texts: list[str]) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
    """For each text its units and their log probabilities of the languages, the mean over a unit's
    windows. Each unit stands behind as many zeros as a filter reaches beyond its first byte, so that no
    filter sees two units. A unit whose windows disagree is cut where its best path changes; units
    without letters say nothing (zeros)."""
    margin, window = max(WIDTHS) - 1, BLOCK * BLOCKS
    spans: list[tuple[int, int, int]] = []  # text, from, to
    pieces: list[bytes] = []
    for i, text in enumerate(texts):
        raw = without_names(text.encode("utf-8", "replace"))
        wide, byte = len(raw) != len(text), 0
        for lo, hi in _units(text):
            size = len(text[lo:hi].encode("utf-8", "replace")) if wide else hi - lo
            spans.append((i, lo, hi))
            pieces.append(raw[byte : byte + size])
            byte += size
    if not spans:
        return [([], np.zeros((0, len(LANGUAGES)), np.float32)) for _ in texts]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    blocks = -(-(sizes + margin) // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    data = fold_case(np.frombuffer(b"".join(bytes(margin) + p + bytes(b * BLOCK - margin - len(p)) for p, b in zip(pieces, blocks.tolist())), np.uint8))
    lettered = np.add.reduceat(data >= 97, first[:-1] * BLOCK) > 0
    windows = net.features(data)
    owner = np.repeat(np.arange(len(spans)), blocks)
    pooled = windows.copy()
    for j in range(1, BLOCKS):  # windows must not reach into the next unit
        np.maximum(windows[:-j], pooled[j:], out=windows[:-j], where=(owner[:-j] == owner[j:])[:, None])
    counts = np.maximum(1, blocks - BLOCKS + 1)
    chosen = np.arange(len(windows)) - first[owner] < counts[owner]
    scores = net.log_softmax(windows[chosen])
    starts = np.concatenate([[0], np.cumsum(counts)])
    means = np.add.reduceat(scores, starts[:-1]) / counts[:, None]
    top = scores.argmax(axis=1)
    split = np.minimum.reduceat(top, starts[:-1]) != np.maximum.reduceat(top, starts[:-1])
    means[~lettered] = 0
    out: list[tuple[list[tuple[int, int]], list[np.ndarray]]] = [([], []) for _ in texts]
    for u, (i, lo, hi) in enumerate(spans):
        units, rows = out[i]
        if not split[u] or sizes[u] < 2 * window:
            units.append((lo, hi))
            rows.append(means[u])
            continue
        inner = scores[starts[u] : starts[u + 1]]
        labels = _path(inner, SWITCH)
        turns = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
        raw = texts[i][lo:hi].encode("utf-8", "replace")
        at = lo
        for t0, t1 in zip(turns, turns[1:]):
            stop = hi if t1 == len(labels) else min(max(lo + len(raw[: t1 * BLOCK + window // 2].decode("utf-8", "ignore")), at), hi)
            units.append((at, stop))
            rows.append(inner[t0:t1].mean(axis=0))
            at = stop
    return [(units, np.array(rows).reshape(len(rows), len(LANGUAGES))) for units, rows in out]


def segment_batch(net: Network, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """Segments (from, to, language, confidence) of each text, in characters, tiling the text. The
    confidence is the mean probability of the segment's language over its units, weighted by length."""
    out = []
    for units, scores in unit_scores(net, texts):
        found: list[tuple[int, int, str, float]] = []
        if units:
            labels = _path(scores, TURN)
            turns = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
            for t0, t1 in zip(turns, turns[1:]):
                k = int(labels[t0])
                weights = np.array([hi - lo for lo, hi in units[t0:t1]], float)
                found.append((units[t0][0], units[t1 - 1][1], LANGUAGES[k], float((np.exp(scores[t0:t1, k]) * weights).sum() / max(1.0, weights.sum()))))
        out.append([s for s in found if s[1] > s[0]])
    return out


def _prose(sections: DataFrame, types: tuple[str, ...] = ("paragraph", "blockquote")) -> DataFrame:
    return sections.where(F.col("type").isin(*types) & F.col("content").isNotNull() & (F.col("content") != "") & F.col("doc_id").isNotNull()).select("doc_id", "section_index", "content")


def section_segments(sections: DataFrame, net: Network, types: tuple[str, ...] = ("paragraph", "blockquote")) -> DataFrame:
    """(doc_id, section_index, start, end, language, confidence) of the sections' contents.

    Null and empty contents have none; repeated rows give repeated segments; whole texts are read. A
    text of other languages or of no words gets the nearest of the six, with a low confidence."""
    shared = sections.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            docs, places, texts = b["doc_id"].tolist(), b["section_index"].tolist(), b["content"].tolist()
            for lo in range(0, len(texts), 512):
                out = [(d, p, *s) for d, p, segs in zip(docs[lo : lo + 512], places[lo : lo + 512], segment_batch(shared.value, texts[lo : lo + 512])) for s in segs]
                yield pd.DataFrame(out, columns=["doc_id", "section_index", "start", "end", "language", "confidence"])

    return _prose(sections, types).mapInPandas(run, "doc_id string, section_index int, start int, end int, language string, confidence double")


def item_labels(items: DataFrame) -> DataFrame:
    """(doc_id, label): the language that the holding row of the document's item names."""
    held = holding_rows(items, ["item_id"], "updated_at", ["active_doc_id", "language"]).where("active_doc_id is not null")
    names = F.create_map(*[F.lit(x) for pair in sorted(_BY_NAME.items()) for x in pair])
    base = F.element_at(F.split(F.lower(F.trim("language")), "[-_ (,;]"), 1)
    return held.select(F.col("active_doc_id").alias("doc_id"), F.element_at(names, base).alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))


def mislabelled_sections(sections: DataFrame, items: DataFrame, net: Network) -> DataFrame:
    """(doc_id, section_index, language): a language in which a run of the section is written and
    which the item does not name. Labels that name none make every run a case."""
    segments = section_segments(sections, net)
    wide = F.when(F.col("language") == "zh", MIN_RUN_WIDE).otherwise(MIN_RUN)
    runs = segments.where(F.col("end") - F.col("start") >= wide).select("doc_id", "section_index", "language").distinct()
    return runs.join(item_labels(items), "doc_id", "left").where("label is null or label <> language").select("doc_id", "section_index", "language")


def document_languages(sections: DataFrame, net: Network) -> DataFrame:
    """(doc_id, language, confidence, share): the language with most characters, its mean confidence
    weighted by length, and its share of the document's characters; ties go to the first code."""
    s = section_segments(sections, net).withColumn("n", F.col("end") - F.col("start"))
    by = s.groupBy("doc_id", "language").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("confidence"))
    best = by.groupBy("doc_id").agg(F.min_by(F.struct("language", "confidence", "n"), F.struct(-F.col("n"), F.col("language"))).alias("b"), F.sum("n").alias("all"))
    return best.select("doc_id", "b.language", "b.confidence", (F.col("b.n") / F.col("all")).alias("share"))
