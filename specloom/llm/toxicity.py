"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Inputs are words (a vocabulary learned from the training texts, with the log
odds of each word as one component) and characters (hashed trigrams, averaged),
so unseen words still have a vector. Both directions run over windows of WINDOW
words that overlap by half; attention pools a window's states into one logit,
and a text scores as its worst window does. Training is plain numpy: in each
epoch all windows of the sample are scored, and the worst windows of each text
and one drawn window are learned from (a text's label holds for its worst one).

The sample is bounded: at most SAMPLE_DOCS labelled texts per class, of at most
SAMPLE_CHARS characters, the first by a hash of the id. Scoring covers every
window of every whole text, in batches of bounded size.

Defined results: a null or empty text is scored as one empty window; without
labelled rows of both classes every score is 0; an id with several labels is
toxic if one says so; repeated rows are scored alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, named, release, utf8

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIMS, CHAR_DIMS, CHAR_BUCKETS, ATTENTION = 8, 7, 6, 4096, 8
SAMPLE_DOCS, SAMPLE_CHARS = 1200, 20_000
MIN_DOCS, MAX_WORDS = 4, 20_000
EPOCHS, BATCH, RATE, SEED = 7, 128, 0.01, 5
#: Windows that run side by side when scoring; words that a worker remembers.
LANES, KNOWN_WORDS = 2048, 100_000
_STRIP = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def normal(word: bytes) -> bytes:
    return word.strip(_STRIP)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, each in ``<`` and ``>``, and where each word's begin."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    h = (data[:-2] * 961 + data[1:-1] * 31 + data[2:]) * 2654435761 >> 8
    inside = np.ones(len(data), bool)
    inside[ends - 1] = inside[ends - 2] = False
    counts = np.maximum(sizes - 2, 0)
    return (h & (CHAR_BUCKETS - 1))[inside[:-2]], counts


class Network:
    """Parameters, forward pass, gradients. Weights of both directions are stacked."""

    def __init__(self, vocabulary: dict[bytes, int], odds: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        small = lambda *n: rng.normal(0, 0.15, n).astype(np.float32)
        self.vocabulary = vocabulary
        dims = 1 + WORD_DIMS + CHAR_DIMS
        words = small(len(vocabulary) + 1, 1 + WORD_DIMS)
        words[:, 0] = odds
        self.p = {
            "word": words,
            "char": small(CHAR_BUCKETS, CHAR_DIMS),
            "wx": small(2, dims, 3 * HIDDEN),
            "bx": np.zeros((2, 3 * HIDDEN), np.float32),
            "u": small(2, HIDDEN, 3 * HIDDEN),
            "a": small(2 * HIDDEN, ATTENTION),
            "v": small(ATTENTION),
            "o": small(2 * HIDDEN),
            "c": np.full(1, -1.0, np.float32),
        }

    def vectors(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The input vector of each word, its vocabulary row and its trigrams."""
        row = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        grams, counts = trigrams(words)
        owner = np.repeat(np.arange(len(words)), counts)
        chars = np.stack([np.bincount(owner, weights=self.p["char"][grams, k], minlength=len(words)) for k in range(CHAR_DIMS)], axis=1)
        chars = chars / np.maximum(counts, 1)[:, None]
        return np.concatenate([self.p["word"][row], chars.astype(self.p["word"].dtype)], axis=1), row, grams, counts

    def run(self, inputs: np.ndarray):
        """States (2, T, B, H) and what gradients need; ``inputs`` is (2, T, B, 3H),
        each direction's input sums in its own order, zero beyond a window's end."""
        _, steps, lanes, _ = inputs.shape
        h = np.zeros((2, lanes, HIDDEN), inputs.dtype)
        states = np.empty((2, steps, lanes, HIDDEN), inputs.dtype)
        saved = []
        k = HIDDEN
        for t in range(steps):
            g, hu = inputs[:, t], h @ self.p["u"]
            zr = _sigmoid(g[..., : 2 * k] + hu[..., : 2 * k])
            z, r = zr[..., :k], zr[..., k:]
            n = np.tanh(g[..., 2 * k :] + r * hu[..., 2 * k :])
            saved.append((h, z, r, n, hu[..., 2 * k :]))
            h = n + z * (h - n)
            states[:, t] = h
        return states, saved

    def pool(self, states: np.ndarray, mask: np.ndarray):
        """Attention over the steps: ``mask`` (T, B) is 0 for words and -1e9 elsewhere."""
        both = np.concatenate([states[0], states[1, ::-1]], axis=2)
        q = np.tanh(both @ self.p["a"])
        e = q @ self.p["v"] + mask
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        context = np.einsum("tb,tbk->bk", w, both)
        return context @ self.p["o"] + self.p["c"][0], (both, q, w, context)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input sums of both directions, (n, 2, 3H)."""
        return np.stack([x @ self.p["wx"][d] + self.p["bx"][d] for d in (0, 1)], axis=1)

    def step(self, words: list[bytes], at: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of windows ``at`` (B, T) of indices into ``words``."""
        p, k = self.p, HIDDEN
        lanes, steps = at.shape
        x, row, grams, counts = self.vectors(words)
        mask = np.where(np.arange(steps)[:, None] < lengths[None, :], 0, -1e9).astype(np.float32)
        order = np.stack([at.T, at.T[::-1]])
        live = np.stack([mask == 0, (mask == 0)[::-1]])[..., None].astype(np.float32)
        g = self.project(x)
        inputs = np.stack([g[order[0], 0], g[order[1], 1]]) * live
        states, saved = self.run(inputs)
        logit, (both, q, w, context) = self.pool(states, mask)
        prob = _sigmoid(logit)
        target = 0.8 * y + 0.2 * prob
        loss = float(-np.mean(target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7)))
        grad = {n: np.zeros_like(v) for n, v in p.items()}
        d = ((prob - target) / lanes).astype(np.float32)
        grad["c"][0], grad["o"] = d.sum(), context.T @ d
        dc = d[:, None] * p["o"]
        dw = np.einsum("bk,tbk->tb", dc, both)
        de = w * (dw - (w * dw).sum(axis=0))
        grad["v"] = np.einsum("tb,tba->a", de, q)
        dq = de[..., None] * p["v"] * (1 - q * q)
        grad["a"] = np.einsum("tbk,tba->ka", both, dq)
        db = w[..., None] * dc + dq @ p["a"].T
        dstates = np.stack([db[..., :k], db[::-1, :, k:]])
        dh = np.zeros((2, lanes, k), np.float32)
        dg = np.zeros_like(inputs)
        for t in range(steps - 1, -1, -1):
            h, z, r, n, hn = saved[t]
            dh = dh + dstates[:, t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            part = np.concatenate([dz, dr, dn], axis=2)
            dg[:, t] = part
            back = np.concatenate([dz, dr, dn * r], axis=2)
            grad["u"] += np.einsum("dbh,dbg->dhg", h, back)
            dh = dh * z + back @ p["u"].transpose(0, 2, 1)
        dg *= live
        dx = np.zeros_like(x)
        for i in (0, 1):
            flat, index = dg[i].reshape(-1, 3 * k), order[i].ravel()
            grad["wx"][i], grad["bx"][i] = x[index].T @ flat, flat.sum(axis=0)
            np.add.at(dx, index, flat @ p["wx"][i].T)
        np.add.at(grad["word"], row, dx[:, : 1 + WORD_DIMS])
        dchar = np.repeat(dx[:, 1 + WORD_DIMS :] / np.maximum(counts, 1)[:, None], counts, axis=0)
        np.add.at(grad["char"], grams, dchar)
        return loss, grad


def windows(n: int) -> list[int]:
    """Where the windows of n words start; they overlap and reach the end."""
    return list(range(0, max(1, n - (WINDOW - STRIDE)), STRIDE))


class Scorer:
    """Scores whole texts with a network; input sums of known words are kept."""

    def __init__(self, network: Network, known: int = KNOWN_WORDS):
        self.net, self.limit = network, known
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sums = np.zeros((2, 1, 3 * HIDDEN), np.float32)

    def _learn(self, new: list[bytes]) -> None:
        x = self.net.vectors([normal(w) for w in new])[0]
        base = len(self.known) + 1
        self.known.update(zip(new, range(base, base + len(new))))
        need = base + len(new)
        if need > self.sums.shape[1]:
            grown = np.zeros((2, max(need, 2 * self.sums.shape[1]), 3 * HIDDEN), np.float32)
            grown[:, : self.sums.shape[1]] = self.sums
            self.sums = grown
        self.sums[:, base:need] = self.net.project(x).transpose(1, 0, 2)

    def ids(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        found = list(map(self.known.get, words))
        if None in found:
            self._learn(list({w for w, k in zip(words, found) if k is None}))
            found = list(map(self.known.get, words))
        return np.array(found, np.int32)

    def logits(self, texts: list[bytes]) -> list[np.ndarray]:
        """The logits of all windows of each text."""
        if len(self.known) > self.limit:
            self._reset()
        ids = [self.ids(t) for t in texts]
        sizes = np.array([len(x) for x in ids], np.int64)
        counts = np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1
        words = np.concatenate([*ids, np.zeros(WINDOW, np.int32)])
        doc = np.repeat(np.arange(len(texts)), counts)
        ends = np.cumsum(sizes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = (ends - sizes)[doc] + nth * STRIDE
        out = np.empty(len(doc), np.float32)
        for k in range(0, len(doc), LANES):
            place = starts[k : k + LANES, None] + np.arange(WINDOW)
            at = np.where(place < ends[doc[k : k + LANES], None], words[np.minimum(place, len(words) - 1)], 0)
            out[k : k + LANES] = self._run(np.ascontiguousarray(at.T))
        return np.split(out, np.cumsum(counts)[:-1])

    def _run(self, at: np.ndarray) -> np.ndarray:
        """Logits of windows of word numbers (T, B); 0 is beyond the end.

        The same as the network's ``run`` and ``pool``, gathering each step's inputs as it comes.
        """
        p, k, (steps, lanes) = self.net.p, HIDDEN, at.shape
        both = np.empty((steps, lanes, 2 * k), np.float32)
        for d in (0, 1):
            u, sums, h = p["u"][d], self.sums[d], np.zeros((lanes, k), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g, hu = sums.take(at[t], axis=0), h @ u
                zr = g[:, : 2 * k] + hu[:, : 2 * k]
                zr *= -1
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                n = zr[:, k:] * hu[:, 2 * k :]
                n += g[:, 2 * k :]
                np.tanh(n, out=n)
                h = h - n
                h *= zr[:, :k]
                h += n
                both[t, :, d * k : d * k + k] = h
        q = (both.reshape(-1, 2 * k) @ p["a"]).reshape(steps, lanes, -1)
        np.tanh(q, out=q)
        e = q @ p["v"] + np.where(at > 0, 0, -1e9).astype(np.float32)
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        context = (both * e[..., None]).sum(axis=0)
        return context @ p["o"] + p["c"][0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.round(np.array([_sigmoid(x.max()) for x in self.logits(texts)], np.float64), 6)


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network for whole texts and their labels (1: toxic)."""
    rng = np.random.default_rng(seed)
    split = [[normal(w) for w in t.lower().split()] for t in texts]
    y = np.array(labels, np.float32)
    seen = (Counter(), Counter())
    for words, label in zip(split, labels):
        seen[int(label)].update(set(words))
    total = seen[0] + seen[1]
    common = sorted((w for w, n in total.items() if n >= MIN_DOCS), key=lambda w: (-total[w], w))[:MAX_WORDS]
    positives = max(1.0, float(y.sum()))
    negatives = max(1.0, len(y) - positives)
    odds = [0.0] + [np.log((seen[1][w] + 0.5) / (positives + 1)) - np.log((seen[0][w] + 0.5) / (negatives + 1)) for w in common]
    trust = [0.0] + [total[w] / (total[w] + 8.0) for w in common]
    network = Network({w: k + 1 for k, w in enumerate(common)}, np.clip(np.array(odds) * np.array(trust), -3, 3), seed)
    first = {n: np.zeros_like(v) for n, v in network.p.items()}
    second = {n: np.zeros_like(v) for n, v in network.p.items()}
    rounds = 0
    for _ in range(epochs):
        scores = Scorer(network, known=1 << 62).logits(texts)
        chosen = []
        for k, values in enumerate(scores):
            starts = windows(len(split[k]))
            worst = np.argsort(-values, kind="stable")[: 1 if y[k] else 2]
            picks = {int(w) for w in worst} | (set() if y[k] else {int(rng.integers(len(starts)))})
            chosen += [(k, starts[w]) for w in sorted(picks)]
        rng.shuffle(chosen)
        for b in range(0, len(chosen), BATCH):
            part = chosen[b : b + BATCH]
            index: dict[bytes, int] = {b"": 0}
            at = np.zeros((len(part), WINDOW), np.int64)
            lengths = np.zeros(len(part), np.int64)
            for i, (k, s) in enumerate(part):
                words = split[k][s : s + WINDOW]
                lengths[i] = len(words)
                at[i, : len(words)] = [index.setdefault(w, len(index)) for w in words]
            _, grad = network.step(list(index), at, lengths, y[[k for k, _ in part]])
            rounds += 1
            for n, v in network.p.items():
                g = np.clip(grad[n], -1, 1) + 1e-5 * v
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.01 * (g * g - second[n])
                v -= RATE * (first[n] / (1 - 0.9**rounds)) / (np.sqrt(second[n] / (1 - 0.99**rounds)) + 1e-6)
    return network


def sample(df: DataFrame, labels: DataFrame, learn: Column, doc_id: str, text: str, docs: int, chars: int) -> list:
    """At most ``docs`` labelled texts of each class, of at most ``chars`` characters."""
    known = labels.where(learn & F.col("y").isNotNull()).groupBy("doc_id").agg(F.max(F.col("y").cast("int")).alias("y"))
    short = df.where(F.length(text) <= chars).select(F.col(named(doc_id)).alias("doc_id")).join(known, "doc_id").distinct()
    chosen = [short.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs) for c in (0, 1)]
    picked = chosen[0].union(chosen[1]).collect()
    spark = df.sparkSession
    if len({r.y for r in picked}) < 2:
        return []
    ids = spark.createDataFrame(picked, "doc_id long, y int" if not picked else short.select("doc_id", "y").schema)
    rows = df.where(F.length(text) <= chars).select(F.col(named(doc_id)).alias("doc_id"), utf8(text).alias("t")).join(F.broadcast(ids), "doc_id")
    return sorted((str(r.doc_id), bytes(r.t), r.y) for r in rows.dropDuplicates(["doc_id"]).collect())


def fit(df: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Network | None:
    """A network fitted to a bounded sample of ``labels(doc_id, y)`` where ``learn``."""
    rows = sample(df, labels, learn, doc_id, text, docs, chars)
    return train([t for _, t, _ in rows], [y for _, _, y in rows]) if rows else None


def score(df: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): one row for each row."""
    if network is None:
        return df.select(F.col(named(doc_id)).alias("doc_id"), F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.score(part.column(1).to_pylist()))], names=["doc_id", "score"])
        del own
        release()

    kind = df.select(F.col(named(doc_id))).schema[0].dataType.simpleString()
    return df.select(F.col(named(doc_id)).alias("doc_id"), utf8(text).alias("t")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(df: DataFrame, network: Network | None, text: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of ``df``, whole and unshuffled, that score below ``cut``."""
    if network is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(network)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [(x or "").encode("utf-8", "replace") for x in part.column(at).to_pylist()]
                yield part.filter(pa.array(own.score(texts) < cut))
        del own
        release()

    return df.mapInArrow(run, df.schema)


def learnable(modulus: int = 5, held: int = 0) -> Column:
    return F.coalesce(crc_bucket("doc_id", modulus) != held, F.lit(True))


def classify(df: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return score(df, fit(df, labels, learn, doc_id, text), doc_id, text)
