"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of words. A word's input is the sum of a word vector
and the mean of its character n-gram vectors, both from hashed tables. Two recurrent
passes, one from each end, give a state for each word; attention pools them. The highest of
all windows, calibrated, is the score of the text. The network is fitted on a bounded
sample of labelled documents; Spark draws the sample, scores all windows of its documents
between the rounds of training, and scores all texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.langid import fold
from wayfold.llm.shared import give_back, keep, shared_folder, short_batches, small, tidied

WINDOW, STRIDE = 48, 36
#: Words of more characters are cut into pieces.
WORD = re.compile(r"\w{1,24}")
WORDS, GRAMS, SIZES = 1 << 13, 1 << 13, (3, 4)
WIDTH, STATE = 16, 12
#: Most labelled documents of class 0 and of class 1 that training may use, of each text one.
SAMPLE = (2000, 1000)
#: Windows of a document that training begins with, and the highest of all its windows that
#: each later round adds.
PIECES, HIGHEST = 6, 3
#: Most distinct words whose inputs a scoring task keeps (9 MB), and windows scored at once.
CACHE, GROUP = 1 << 15, 256
BATCH = 256
#: Tasks that score the sample between the rounds.
TASKS = 24


def split(text: str | None) -> list[str]:
    """All words in lower case."""
    return WORD.findall((text or "").lower())


def window_count(words: int) -> int:
    return max(1, -(-(words - (WINDOW - STRIDE)) // STRIDE))


def windows(words: list[str], chosen: list[int] | None = None) -> list[list[str]]:
    """All overlapping windows, or the ``chosen`` ones; a text without words has one, empty."""
    chosen = range(window_count(len(words))) if chosen is None else chosen
    return [words[k * STRIDE : k * STRIDE + WINDOW] for k in chosen]


def _table() -> np.ndarray:
    """CRC-32 of each byte, by its rule."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _table()


def table_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the table by CRC-32: each word's own, those of its character n-grams in one array,
    and their number for each word. The n-grams of all words are hashed together."""
    marked = [f"^{w}$".encode() for w in words]
    own = np.array([zlib.crc32(m) % WORDS for m in marked], np.int32)
    size = np.array([len(m) for m in marked], np.int64)
    whole = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    owner, left = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size) - np.arange(len(whole))
    rows, owners = [], []
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        c = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for k in range(n):
            c = _CRC[(c ^ whole[at + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
        rows.append(WORDS + (~c % np.uint32(GRAMS)).astype(np.int32))
        owners.append(owner[at])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    return own, rows[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words)).astype(np.int32)


def features(word: str) -> list[int]:
    """Rows of the table of one word: its own, then those of its n-grams."""
    own, rows, _ = table_rows([word])
    return [int(own[0]), *rows.tolist()]


class Network:
    """Parameters, forward and backward passes over batches of windows (``ids`` of words,
    -1 beyond a window's end; ``inputs`` of each word)."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale=1.0: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"table": normal(WORDS + GRAMS, WIDTH, scale=0.1)}
        for side in "fb":
            self.p["w" + side] = normal(WIDTH, 3 * STATE, scale=WIDTH**-0.5)
            self.p["u" + side] = normal(STATE, 3 * STATE, scale=STATE**-0.5)
            self.p["c" + side] = np.zeros(3 * STATE, np.float32)
        self.p |= {"a": normal(2 * STATE, scale=0.1), "v": normal(2 * STATE, scale=0.3), "b": np.zeros(1, np.float32)}
        self.calibration = (1.0, 0.0)

    def vectors(self, own: np.ndarray, flat: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Word inputs: a word's own row of the table plus the mean of its n-grams' rows
        (``flat``, ``many`` for each word)."""
        starts = np.cumsum(many) - many
        return self.p["table"][own] + np.add.reduceat(self.p["table"][flat], starts, axis=0) / many[:, None]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions; the last row stands for padding."""
        both = np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], axis=1)
        return np.concatenate([both, np.zeros((1, both.shape[1]), np.float32)])

    def _pass(self, gates: np.ndarray, live: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States of one direction; ``gates`` (windows, words, 3 states)."""
        u, n, many = self.p["u" + side], STATE, gates.shape[1]
        h, out = np.zeros((len(gates), n), np.float32), np.zeros((*gates.shape[:2], n), np.float32)
        for t in range(many) if side == "f" else range(many - 1, -1, -1):
            g, hu = gates[:, t], h @ u
            zr = 1 / (1 + np.exp(-(g[:, : 2 * n] + hu[:, : 2 * n])))
            z, r = zr[:, :n], zr[:, n:]
            new = np.tanh(g[:, 2 * n :] + r * hu[:, 2 * n :])
            if keep is not None:
                keep.append((t, h, z, r, new, hu[:, 2 * n :]))
            h = h + live[:, t, None] * z * (new - h)
            out[:, t] = h
        return out

    def forward(self, projected: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        live, gates, n = (ids >= 0).astype(np.float32), projected[ids], 3 * STATE
        kept = {s: [] if keep is not None else None for s in "fb"}
        h = np.concatenate([self._pass(gates[..., :n], live, "f", kept["f"]), self._pass(gates[..., n:], live, "b", kept["b"])], axis=2)
        e = h @ self.p["a"] + np.where(live > 0, 0, -1e9).astype(np.float32)
        weight = np.exp(e - e.max(axis=1, keepdims=True)) * live
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("wt,wts->ws", weight, h)
        if keep is not None:
            keep |= {"h": h, "weight": weight, "pooled": pooled, "live": live, **kept}
        return pooled @ self.p["v"] + self.p["b"]

    def logits(self, projected: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """``forward`` for scoring: both directions advance together."""
        n, many = STATE, ids.shape[1]
        gates = projected[ids.T]
        gates = np.stack([gates[..., : 3 * n], gates[::-1, :, 3 * n :]], axis=1)  # step, direction, window, gate
        live = (ids.T >= 0).astype(np.float32)
        moves = np.stack([live, live[::-1]], axis=1)[..., None]
        u, h = np.stack([self.p["uf"], self.p["ub"]]), np.zeros((2, len(ids), n), np.float32)
        out = np.empty((many, 2, len(ids), n), np.float32)
        for t in range(many):
            g, hu = gates[t], h @ u
            zr = 1 / (1 + np.exp(-(g[..., : 2 * n] + hu[..., : 2 * n])))
            new = np.tanh(g[..., 2 * n :] + zr[..., n:] * hu[..., 2 * n :])
            h = h + moves[t] * zr[..., :n] * (new - h)
            out[t] = h
        h = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        e = h @ self.p["a"] + np.where(live > 0, 0, -1e9).astype(np.float32)
        weight = np.exp(e - e.max(axis=0)) * live
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        return np.einsum("tw,tws->ws", weight, h) @ self.p["v"] + self.p["b"]

    def gradients(self, keep: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the parameters, and of the gate inputs, for ``slope`` of each logit."""
        h, weight, grad, n = keep["h"], keep["weight"], {}, STATE
        grad["v"], grad["b"] = keep["pooled"].T @ slope, slope.sum(keepdims=True)
        dpooled = slope[:, None] * self.p["v"]
        dweight = h @ dpooled[:, :, None]
        de = weight * (dweight[..., 0] - (weight * dweight[..., 0]).sum(axis=1, keepdims=True))
        grad["a"] = np.einsum("wt,wts->s", de, h)
        dh = weight[..., None] * dpooled[:, None] + de[..., None] * self.p["a"]
        dgates = np.zeros((*h.shape[:2], 6 * n), np.float32)
        for k, side in enumerate("fb"):
            u, du, back = self.p["u" + side], np.zeros((n, 3 * n), np.float32), np.zeros((len(h), n), np.float32)
            for t, before, z, r, new, hn in reversed(keep[side]):
                total, live = dh[:, t, k * n : (k + 1) * n] + back, keep["live"][:, t, None]
                dnew = total * live * z * (1 - new * new)
                dz = total * live * (new - before) * z * (1 - z)
                dr = dnew * hn * r * (1 - r)
                inner = np.concatenate([dz, dr, dnew * r], axis=1)
                dgates[:, t, 3 * n * k : 3 * n * (k + 1)] = np.concatenate([dz, dr, dnew], axis=1)
                du += before.T @ inner
                back = total * (1 - live * z) + inner @ u.T
            grad["u" + side] = du
        return grad, dgates


def scatter(rows: np.ndarray, values: np.ndarray, many: int) -> np.ndarray:
    """Sums of ``values`` by row."""
    width = values.shape[1]
    flat = (rows[:, None] * width + np.arange(width)).ravel()
    return np.bincount(flat, weights=values.ravel(), minlength=many * width).reshape(many, width).astype(np.float32)


class Trainer:
    """Adam on windows, which it keeps by their words; ``add`` gives their numbers."""

    def __init__(self, seed: int = 7) -> None:
        self.random, self.net, self.step = np.random.default_rng(seed), Network(seed), 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.net.p.items()}
        self.number: dict[str, int] = {}
        self.own, self.flat, self.many = table_rows([])
        self.ids = np.zeros((0, WINDOW), np.int32)

    def add(self, pieces: list[str]) -> np.ndarray:
        known = len(self.number)
        ids = np.full((len(pieces), WINDOW), -1, np.int32)
        for k, words in enumerate(map(str.split, pieces)):
            ids[k, : len(words)] = [self.number.setdefault(w, len(self.number)) for w in words]
        new = list(self.number)[known:]
        for at in range(0, len(new), 4096):
            more = table_rows(new[at : at + 4096])
            self.own, self.flat, self.many = (np.concatenate(x) for x in zip((self.own, self.flat, self.many), more, strict=True))
        self.starts = np.cumsum(self.many, dtype=np.int64) - self.many
        self.ids = np.concatenate([self.ids, ids])
        return np.arange(len(self.ids) - len(ids), len(self.ids))

    def inputs(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the table of the words ``used``, as ``Network.vectors`` takes them."""
        many = self.many[used].astype(np.int64)
        return self.own[used], self.flat[np.repeat(self.starts[used] - (np.cumsum(many) - many), many) + np.arange(many.sum())], many

    def batch(self, chosen: np.ndarray, labels: np.ndarray, rate: float) -> None:
        ids = self.ids[chosen]
        used, local = np.unique(ids[ids >= 0], return_inverse=True)
        if not len(used):
            return
        ids[ids >= 0] = local
        own, flat, many = self.inputs(used)
        x, kept = self.net.vectors(own, flat, many), {}
        logits = self.net.forward(self.net.project(x), ids, kept)
        slope = ((1 / (1 + np.exp(-logits)) - labels) / len(chosen)).astype(np.float32)
        grad, dgates = self.net.gradients(kept, slope)
        dprojected, n = scatter(ids[ids >= 0], dgates[ids >= 0], len(used)), 3 * STATE
        dx = dprojected[:, :n] @ self.net.p["wf"].T + dprojected[:, n:] @ self.net.p["wb"].T
        for k, side in enumerate("fb"):
            half = dprojected[:, k * n : (k + 1) * n]
            grad["w" + side], grad["c" + side] = x.T @ half, half.sum(axis=0)
        shared = np.repeat(dx / many[:, None], many, axis=0)
        grad["table"] = scatter(np.concatenate([own, flat]), np.concatenate([dx, shared]), WORDS + GRAMS)
        self.step += 1
        for k, g in grad.items():
            m, s = self.moments[k]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            self.net.p[k] -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.999**self.step)) + 1e-8)

    def epoch(self, chosen: np.ndarray, labels: np.ndarray, rate: float) -> None:
        order = self.random.permutation(len(chosen))
        size = max(16, min(BATCH, len(chosen) // 16))
        for at in range(0, len(order), size):
            part = order[at : at + size]
            self.batch(chosen[part], labels[part], rate)

    def logits(self, chosen: np.ndarray) -> np.ndarray:
        """Of windows by their numbers."""
        out = np.zeros(len(chosen))
        for at in range(0, len(chosen), GROUP):
            ids = self.ids[chosen[at : at + GROUP]]
            used, local = np.unique(ids[ids >= 0], return_inverse=True)
            used = used if len(used) else np.zeros(1, np.int64)
            if len(self.number):
                ids[ids >= 0] = local
                out[at : at + GROUP] = self.net.logits(self.net.project(self.net.vectors(*self.inputs(used))), ids)
        return out


def calibrated(logits: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Platt scaling: slope and offset."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    z, w = np.stack([np.clip(logits, -15, 15), np.ones(len(y))], axis=1), np.array([1.0, 0.0])
    ones, zeros = y.sum(), len(y) - y.sum()
    y = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))  # keeps the slope finite
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (y - p) - 0.1 * (w - [1, 0]))
        w = w + move / max(1.0, 2 * float(np.abs(move).max()))
    return max(float(w[0]), 0.05), float(w[1])


def sampled(labelled: DataFrame, folder: str) -> DataFrame:
    """``h``, ``toxic`` and ``text`` of at most ``SAMPLE`` documents of each class of
    ``doc_id``, ``text``, ``toxic``.

    Of rows with one text one counts, toxic if one of them is, so copies weigh no more than
    others; texts are taken in order of their hash ``h``. Only hashes and ids are ranked.
    """
    rows = labelled.withColumn("h", F.xxhash64("text"))
    each = rows.groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("_id"))
    most = [each.where(F.col("toxic") == k).orderBy("h").limit(n) for k, n in enumerate(SAMPLE)]
    chosen = F.broadcast(keep(most[0].union(most[1]), folder, "chosen"))
    of = rows.select("doc_id", "text", "h").join(chosen.withColumnRenamed("_id", "doc_id"), ["doc_id", "h"])
    return keep(of.select("h", "toxic", "text").dropDuplicates(["h"]).repartition(TASKS, "h"), folder, "sample")


def _pieces(sample: DataFrame, net: Network | None, most: int) -> list:
    """``h``, ``toxic``, the highest logit and ``most`` windows of each document of the
    sample: the highest of all its windows, or without a network some spread over it."""
    model = sample.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(model.value) if model.value is not None else None
        for batch in tidied(batches):
            tops, pieces = [], []
            for text in batch.column(2):
                words = split(text.as_py())
                if scorer is None:
                    logits, chosen = np.zeros(1), np.unique(np.linspace(0, window_count(len(words)) - 1, most).astype(int))
                else:
                    logits = scorer.logits([words])[0]
                    chosen = np.argsort(-logits, kind="stable")[:most]
                tops.append(float(logits.max()))
                pieces.append([" ".join(w) for w in windows(words, chosen.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tops, pa.float64()), pa.array(pieces, pa.list_(pa.string()))], ["h", "toxic", "top", "pieces"])

    return sorted(sample.select("h", "toxic", "text").mapInArrow(run, "h long, toxic int, top double, pieces array<string>").collect(), key=lambda r: r["h"])


def fit(labelled: DataFrame, rounds: tuple = ((3, 0.015), (4, 0.015), (3, 0.003))) -> Network:
    """Network from ``doc_id``, ``text``, ``toxic`` (0 or 1).

    The documents of ``sampled`` take part. First some windows of each take its label;
    then, as few windows of a document show it, only its highest one does, chosen among
    those that training knows. Before each of the ``rounds`` (epochs, rate) Spark scores
    all windows of the sample and the highest of each document join them. Documents that
    training left out calibrate, by the highest of all their windows. Without rows of both
    classes the network stays as it begins, with a score of one half or less.
    """
    sample = sampled(labelled, shared_folder(labelled.sparkSession))
    trainer, rows = Trainer(), _pieces(sample, None, PIECES)
    labels = np.array([float(r["toxic"]) for r in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        trainer.net.calibration = (0.0, -1.0)
        return trainer.net
    held = np.array([r["h"] % 20 < 3 for r in rows])
    number = trainer.add([p for r in rows for p in r["pieces"]])
    owner = np.repeat(np.arange(len(rows)), [len(r["pieces"]) for r in rows])
    for _ in range(2):
        free = ~held[owner]
        trainer.epoch(number[free], labels[owner[free]], 0.015)
    for epochs, rate in rounds:
        more = _pieces(sample, trainer.net, HIGHEST)
        own, of = trainer.add([p for r in more for p in r["pieces"]]), np.repeat(np.arange(len(more)), [len(r["pieces"]) for r in more])
        number, owner = np.concatenate([number, own]), np.concatenate([owner, of])
        clean = np.flatnonzero((labels[owner] == 0) & ~held[owner])
        for _ in range(epochs):
            order = np.lexsort((-trainer.logits(own), of))
            top = order[np.unique(of[order], return_index=True)[1]]
            top = top[~held[of[top]]]
            rest = trainer.random.permutation(clean)[: len(top) // 2]
            trainer.epoch(np.concatenate([own[top], number[rest]]), labels[np.concatenate([of[top], owner[rest]])], rate)
    tops = np.array([r["top"] for r in _pieces(sample, trainer.net, 1)])
    trainer.net.calibration = calibrated(tops[held], labels[held].astype(np.float64))
    return trainer.net


class Scorer:
    """Logits of all windows of texts. Keeps the gate inputs of at most ``CACHE`` words in
    one table, whose last row stands for padding."""

    def __init__(self, net: Network) -> None:
        self.net, self.number, self.fresh = net, {}, []
        self.table = np.zeros((CACHE + 1, 6 * STATE), np.float32)
        self.waiting: list[np.ndarray] = []
        self.done: list[np.ndarray] = []

    def _flush(self) -> None:
        """Scores the waiting windows, short ones together."""
        known = len(self.number) - len(self.fresh)
        for at in range(0, len(self.fresh), 4096):
            made = self.net.project(self.net.vectors(*table_rows(self.fresh[at : at + 4096])))[:-1]
            self.table[known + at : known + at + len(made)] = made
        self.fresh = []
        if self.waiting:
            ids = np.concatenate(self.waiting)
            self.waiting, lengths, found = [], (ids >= 0).sum(axis=1), np.zeros(len(ids))
            order = np.argsort(lengths, kind="stable")
            for at in range(0, len(order), GROUP):
                part = order[at : at + GROUP]
                found[part] = self.net.logits(self.table, ids[part][:, : max(1, lengths[part[-1]])])
            self.done.append(found)

    def logits(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Of the windows of each text, given as words."""
        counts, held = [window_count(len(words)) for words in texts], 0
        for words, count in zip(texts, counts, strict=True):
            for first in range(0, count, GROUP):
                many = min(GROUP, count - first)
                part = words[first * STRIDE : (first + many - 1) * STRIDE + WINDOW]
                if len(self.number) + len(part) > CACHE:
                    new = set(part).difference(self.number)
                    if len(self.number) + len(new) > CACHE:
                        self._flush()
                        self.number, held = {}, 0
                for w in part:
                    if w not in self.number:
                        self.number[w] = len(self.number)
                        self.fresh.append(w)
                padded = np.full((many - 1) * STRIDE + WINDOW, -1)
                padded[: len(part)] = [self.number[w] for w in part]
                self.waiting.append(padded[np.arange(many)[:, None] * STRIDE + np.arange(WINDOW)])
                held += many
                if held >= 4 * GROUP:
                    self._flush()
                    held = 0
        self._flush()
        found = np.concatenate([np.zeros(0), *self.done])
        self.done = []
        return np.split(found, np.cumsum(counts)[:-1]) if texts else []

    def scores(self, texts: list[str | None]) -> np.ndarray:
        best = np.array([x.max() for x in self.logits([split(t) for t in texts])])
        a, b = self.net.calibration
        return 1 / (1 + np.exp(-np.clip(a * np.clip(best, -15, 15) + b, -30, 30)))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Every row of ``docs`` as the struct ``doc``, with ``score`` of its whole ``text`` and
    ``predicted``. Only texts go to Python, and only scores come back."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def rated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model.value)
        for texts in tidied(batches):
            yield pa.array(np.concatenate([np.zeros(0), *(scorer.scores(texts.slice(at, 128).to_pylist()) for at in range(0, len(texts), 128))]))

    made = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    made = made.withColumn("score", rated(F.col("doc.text").cast("string")))
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def learn(docs: DataFrame, labels: DataFrame, usable: Column) -> Network:
    """Network fitted on the documents where ``usable`` (of ``doc_id``) holds.

    ``labels`` has ``doc_id``, ``toxic``; a document with several is toxic if one says so.
    Null ids, labels and texts teach nothing.
    """
    marked = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    rows = docs.where(usable & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(small(marked), F.col("doc_id") == F.col("_id"))
    net = fit(rows.select("doc_id", "text", F.when(F.col("_toxic") > 0, 1).otherwise(0).alias("toxic")))
    give_back()  # what training took on the driver
    return net


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row's whole text.

    Documents of crc32(doc_id as text) mod 5 = 0 are held out of learning. A null or empty
    text has one empty window and the score that goes with it. Repeated rows are returned
    each, other columns are ignored, and an empty table gives an empty result.
    """
    out = fold("doc_id", 5) == 0
    with short_batches(docs.sparkSession):
        made = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text"), learn(docs, labels, ~out))
        return keep(made.select("doc.doc_id", "doc.held_out", "score", "predicted"), shared_folder(docs.sparkSession), "scores")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` predicts 0, with all their columns."""
    with short_batches(docs.sparkSession):
        made = score(docs, learn(docs, labels, fold("doc_id", 5) != 0))
        return keep(made.where("predicted = 0").select("doc.*"), shared_folder(docs.sparkSession), "clean")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
