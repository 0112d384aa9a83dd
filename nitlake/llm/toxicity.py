"""Toxicity: a bidirectional gated recurrent network with attention pooling, in NumPy.

Each word comes with word inputs and character inputs. Word inputs: the log odds of the word in
toxic against other labelled texts, and an embedding that is learnt, both by hashed word. Character
inputs: the largest and the mean log odds of the word's runs of five bytes, its length, and the
shares of capitals, digits and signs. Two gated recurrent layers read a window forwards and
backwards, attention weighs their states, and a logistic unit scores the window.

All overlapping windows of a text are scored; the text's score is that of its worst window. The
log odds come from all labelled training texts by Spark; the network is fitted on a bounded sample
of them, in one task, where a text sees the log odds that the other half of the texts gives.
Tasks then share the weights, which have a fixed size.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, shared_dir, stored
from .filters import key_filter, passes
from .words import SPACE, Block, Rolling, blocks, column, mixed

#: Words of a window, and from one window to the next: what has at most half as many words lies in one whole.
WINDOW, STRIDE = 32, 16
HIDDEN, EMBEDDED = 8, 4
WORD_BITS, CHAR_BITS = 18, 18
#: The network is fitted on at most about this many labelled texts, half of them toxic if there are enough.
TRAINED_ON = 4_000
#: A longer text teaches by about this many bytes around its worst window by the words' log odds.
EXCERPT = 20_000
ROUNDS, RATE, SEED = 5, 0.01, 17
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGITS = np.isin(np.arange(256), np.arange(48, 58))
_SIGNS = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
FEATURES = 8


class Words:
    """Hashed words and character runs of a block, without case and outer signs."""

    def __init__(self, block: Block):
        self.starts, self.ends, self.text = block.words()
        data = _LOWER[block.data]
        inner = np.flatnonzero(~_SIGNS[data] & ~SPACE[data])
        a, b = np.searchsorted(inner, self.starts), np.searchsorted(inner, self.ends)
        some = b > a
        last = max(len(inner) - 1, 0)
        core = np.where(some, inner[np.minimum(a, last)], self.starts) if len(inner) else self.starts
        stop = np.where(some, inner[np.minimum(np.maximum(b - 1, 0), last)] + 1, self.ends) if len(inner) else self.ends
        self.word = (Rolling(data).spans(core, stop) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        # Five bytes from the one before, so that beginnings are told from middles, and every word has some.
        pad = np.concatenate([[32], data, [32, 32, 32]]).astype(np.uint64)
        gram = pad[:-4]
        for i in range(1, 5):
            gram = gram << np.uint64(8) | pad[i : len(pad) - 4 + i]
        self.gram = (mixed(gram) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
        self.raw = block.data


def inputs(words: Words, odds: np.ndarray) -> np.ndarray:
    """FEATURES numbers for every word; the embedding is looked up by the network."""
    if not len(words.starts):
        return np.zeros((0, FEATURES), np.float32)
    size = (words.ends - words.starts).astype(np.float32)
    share = lambda mask: _within(mask.astype(np.float32), words) / size
    word_odds, odds = odds[: 1 << WORD_BITS], odds[1 << WORD_BITS :][words.gram]
    bounds = np.stack([words.starts, words.ends], 1).ravel()
    most = np.maximum.reduceat(np.append(odds, np.float32(0)), bounds)[::2]
    return np.stack(
        [word_odds[words.word], most, _within(odds, words) / size, np.minimum(size, 20) / 10,
         share(_UPPER[words.raw]), share(_DIGITS[words.raw]), share(_SIGNS[words.raw]), np.ones(len(size), np.float32)], 1
    ).astype(np.float32)


def _within(values: np.ndarray, words: Words) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (sums[words.ends] - sums[words.starts]).astype(np.float32)


def windows(text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of all windows of WINDOW words every STRIDE words; the last one ends
    with its text, and a text of fewer words is one window."""
    count = np.bincount(text, minlength=texts)
    first = np.cumsum(count) - count
    more = np.maximum(0, -(-(count - WINDOW) // STRIDE))
    of = np.repeat(np.arange(texts)[count > 0], (more + 1)[count > 0])
    begin_of = np.concatenate([[0], np.cumsum((more + 1)[count > 0])])[:-1]
    step = np.arange(len(of)) - np.repeat(begin_of, (more + 1)[count > 0])
    start = first[of] + np.minimum(step * STRIDE, np.maximum(count[of] - WINDOW, 0))
    return start, np.minimum(count[of], WINDOW), of


class Network:
    """Weights, the forward pass over a batch of windows, and its gradients."""

    NAMES = ("embedding", "wf", "uf", "bf", "wb", "ub", "bb", "attend", "key", "out", "bias")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        rng, ins = np.random.default_rng(seed), FEATURES + EMBEDDED
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        w = {"embedding": draw(1 << WORD_BITS, EMBEDDED, by=0.02)}
        for way in "fb":
            w |= {f"w{way}": draw(ins, 3 * HIDDEN, by=ins**-0.5), f"u{way}": draw(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5),
                  f"b{way}": np.zeros(3 * HIDDEN, np.float32)}
        w |= {"attend": draw(2 * HIDDEN, HIDDEN, by=(2 * HIDDEN) ** -0.5), "key": draw(HIDDEN, by=HIDDEN**-0.5),
              "out": draw(2 * HIDDEN, by=(2 * HIDDEN) ** -0.5), "bias": np.zeros(1, np.float32)}
        return cls(w)

    def _layer(self, x: np.ndarray, mask: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """States (time, batch, HIDDEN); past a window's end the state stays as it is."""
        w, u, b = (self.w[f"{k}{way}"] for k in "wub")
        steps, rows, _ = x.shape
        fed = x @ w + b
        state, states, kept, h = np.zeros((rows, HIDDEN), np.float32), np.empty((steps, rows, HIDDEN), np.float32), [], HIDDEN
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            back = state @ u[:, : 2 * h]
            gates = _sigmoid(fed[t, :, : 2 * h] + back)
            reset, update = gates[:, :h], gates[:, h:]
            drawn = (reset * state) @ u[:, 2 * h :]
            new = np.tanh(fed[t, :, 2 * h :] + drawn)
            keep = 1 - (1 - update) * mask[t, :, None]
            kept.append((t, state, reset, update, new))
            state = keep * state + (1 - keep) * new
            states[t] = state
        return states, kept

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of windows from inputs (time, batch, FEATURES + EMBEDDED) and a mask of words."""
        forth, kept_f = self._layer(x, mask, "f")
        back, kept_b = self._layer(x, mask, "b")
        both = np.concatenate([forth, back], 2)
        hidden = np.tanh(both @ self.w["attend"])
        energy = np.where(mask > 0, hidden @ self.w["key"], -1e9)
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * both).sum(0)
        return pooled @ self.w["out"] + self.w["bias"][0], (x, mask, kept_f, kept_b, both, hidden, weight, pooled)

    def gradients(self, slope: np.ndarray, kept: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights, and of the inputs, for the logits' slopes."""
        x, mask, kept_f, kept_b, both, hidden, weight, pooled = kept
        g = {"out": pooled.T @ slope, "bias": np.array([slope.sum()], np.float32)}
        d_pooled = slope[:, None] * self.w["out"]
        d_both = weight[:, :, None] * d_pooled
        d_weight = (both * d_pooled).sum(2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(0))
        g["key"] = np.einsum("tbh,tb->h", hidden, d_energy)
        d_hidden = d_energy[:, :, None] * self.w["key"] * (1 - hidden**2)
        g["attend"] = np.einsum("tbi,tbh->ih", both, d_hidden)
        d_both = d_both + d_hidden @ self.w["attend"].T
        d_x = np.zeros_like(x)
        for way, steps, part in (("f", kept_f, slice(0, HIDDEN)), ("b", kept_b, slice(HIDDEN, None))):
            w, u = self.w[f"w{way}"], self.w[f"u{way}"]
            g[f"w{way}"], g[f"u{way}"], g[f"b{way}"] = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], np.float32)
            carry = np.zeros_like(d_both[0, :, part])
            for t, state, reset, update, new in reversed(steps):
                d_state = carry + d_both[t, :, part]
                on = mask[t, :, None]
                keep = 1 - (1 - update) * on
                d_new = d_state * (1 - keep) * (1 - new**2)
                d_update = d_state * (state - new) * on * update * (1 - update)
                d_past = d_new @ u[:, 2 * HIDDEN :].T
                d_reset = d_past * state * reset * (1 - reset)
                d_gates = np.concatenate([d_reset, d_update], 1)
                d_fed = np.concatenate([d_gates, d_new], 1)
                g[f"u{way}"][:, : 2 * HIDDEN] += state.T @ d_gates
                g[f"u{way}"][:, 2 * HIDDEN :] += (reset * state).T @ d_new
                g[f"w{way}"] += x[t].T @ d_fed
                g[f"b{way}"] += d_fed.sum(0)
                d_x[t] += d_fed @ w.T
                carry = d_state * keep + d_past * reset + d_gates @ u[:, : 2 * HIDDEN].T
        return g, d_x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def gathered(features: np.ndarray, word: np.ndarray, embedding: np.ndarray, start: np.ndarray, size: np.ndarray):
    """(inputs, mask, word) of windows, time first."""
    at = start + np.arange(WINDOW)[:, None]
    mask = np.arange(WINDOW)[:, None] < size
    at = np.where(mask, at, 0)
    return np.concatenate([features[at], embedding[word[at]]], 2) * mask[:, :, None], mask.astype(np.float32), word[at]


def scored_windows(network: Network, words: Words, features: np.ndarray, texts: int, rows: int = 2048):
    """(logit, first word, words, text) of all windows of a block."""
    start, size, of = windows(words.text, texts)
    out = np.empty(len(start), np.float32)
    for a in range(0, len(start), rows):
        x, mask, _ = gathered(features, words.word, network.w["embedding"], start[a : a + rows], size[a : a + rows])
        out[a : a + rows] = network.forward(x, mask)[0]
    return out, start, size, of


def fitted(texts: list[bytes], label: np.ndarray, fold: np.ndarray, odds: list[np.ndarray]) -> Network:
    """A network from texts sorted by fold. Each round, every text teaches by its worst window as scored now, and a text that is not
    toxic by the next worst and by one more, drawn from all its windows. Steps by Adam."""
    network, rng = Network.fresh(), np.random.default_rng(SEED)
    held = []
    for part in (0, 1):
        mine = np.flatnonzero(fold == part)
        data = np.frombuffer(b"".join(texts[i] for i in mine), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in mine])]).astype(np.int64)
        for block in blocks(data, offsets):
            words = Words(block)
            held.append((words, inputs(words, odds[1 + part]), block.texts, label[mine][block.rows]))
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(label)
    weight = np.split(weight, np.cumsum([h[2] for h in held])[:-1])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.w.items()}
    step = 0
    for turn in range(ROUNDS):
        for (words, features, n, toxic), own in zip(held, weight, strict=True):
            start, size, of = windows(words.text, n)
            if not len(start):
                continue
            if turn:
                rank = scored_windows(network, words, features, n)[0]
            else:  # before anything is learnt: by the words' log odds
                sums = np.concatenate([[0], np.cumsum(np.maximum(features[:, 0], 0))])
                rank = sums[start + size] - sums[start]
            order = np.lexsort((-rank, of))
            opens = np.concatenate([[True], of[order][1:] != of[order][:-1]])
            worst, next_worst = order[opens], order[1:][opens[:-1] & ~opens[1:]]
            other = rng.permutation(len(of))
            other = other[np.unique(of[other], return_index=True)[1]]
            pick = rng.permutation(np.concatenate([worst, *(some[toxic[of[some]] == 0] for some in (next_worst, other))]))
            for a in range(0, len(pick), 64):
                rows = pick[a : a + 64]
                x, mask, word = gathered(features, words.word, network.w["embedding"], start[rows], size[rows])
                logit, kept = network.forward(x, mask)
                slope = ((_sigmoid(logit) - toxic[of[rows]]) * own[of[rows]] / len(rows)).astype(np.float32)
                found, d_x = network.gradients(slope, kept)
                step += 1
                for name, grad in found.items():
                    m, v = moments[name]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad**2 - v)
                    network.w[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
                np.add.at(network.w["embedding"], word, -RATE * (d_x[:, :, FEATURES:] * mask[:, :, None]))
    return network


def held_out(id: str) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each hashed word and character run, by label."""
    for batch in batches:
        kind = batch.column("label").to_numpy() + 2 * batch.column("fold").to_numpy()
        sums = np.zeros((4, (1 << WORD_BITS) + (1 << CHAR_BITS)), np.int64)
        for block in blocks(*column(batch, "_text")):
            words = Words(block)
            owner = np.repeat(words.text, words.ends - words.starts)
            at = np.flatnonzero(~SPACE[block.data])
            for bucket, text in ((words.word, words.text), (words.gram[at] + (1 << WORD_BITS), owner)):
                pair = np.unique(text << 20 | bucket)  # buckets take fewer than 20 bits
                np.add.at(sums, (kind[block.rows][pair >> 20], pair & ((1 << 20) - 1)), 1)
        kind, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int32)), pa.array(bucket), pa.array(sums[kind, bucket])], names=["kind", "bucket", "n"]
        )


def log_odds(labelled: DataFrame, strength: float = 4.0) -> list[np.ndarray]:
    """Log odds of hashed words and character runs in toxic texts, drawn to zero where they are rare:
    of all labelled rows, and of those outside fold 0 and outside fold 1. The driver gets one row
    per bucket, of a fixed number of buckets."""
    size = (1 << WORD_BITS) + (1 << CHAR_BITS)
    seen = labelled.mapInArrow(_seen, "kind int, bucket bigint, n bigint")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).cast("float")
    found = seen.groupBy(F.col("bucket").cast("int").alias("bucket")).agg(*[of(kind).alias(f"n{kind}") for kind in range(4)]).toPandas()
    totals = np.zeros(4, np.float32)
    for row in labelled.groupBy("label", "fold").count().collect():
        totals[row["label"] + 2 * row["fold"]] = row["count"]
    counts = np.zeros((4, size), np.float32)
    for kind in range(4):
        counts[kind, found["bucket"].to_numpy(np.int32)] = found[f"n{kind}"].to_numpy(np.float32)
    del found
    out = []
    for some in (counts[:2] + counts[2:], totals[:2] + totals[2:]), (counts[2:], totals[2:]), (counts[:2], totals[:2]):
        part = some[1] + 1.0
        share = part / part.sum()
        odds = np.log((some[0][1] + strength * share[1]) / (some[0][0] + strength * share[0]) * part[0] / part[1])
        out.append(odds.astype(np.float32))
    return out


def excerpt(text: bytes, odds: np.ndarray) -> bytes:
    """The words within EXCERPT bytes around the window of the largest log odds; a shorter text is whole."""
    if len(text) <= EXCERPT:
        return text
    data = np.frombuffer(text, np.uint8)
    words = Words(Block(data, np.array([0, len(data)]), slice(0, 1)))
    if not len(words.starts):
        return b""
    start, size, _ = windows(words.text, 1)
    sums = np.concatenate([[0], np.cumsum(np.maximum(odds[words.word], 0))])
    best = int(np.argmax(sums[start + size] - sums[start]))
    first, last = int(words.starts[start[best]]), int(words.ends[start[best] + size[best] - 1])
    room = max(EXCERPT - (last - first), 0) // 2
    inside = np.flatnonzero((words.starts >= first - room) & (words.ends <= last + room))
    # A window of words that are themselves too long is cut where the bytes end.
    return text[words.starts[inside[0]] : words.ends[inside[-1]]][:EXCERPT]


def _excerpts(odds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("fold").to_pylist()
            texts = [excerpt(t.encode(), odds.value[1 + fold]) for t, fold in zip(batch.column("_text").to_pylist(), folds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("_order", "label", "fold")], pa.array(texts, pa.binary())], names=["_order", "label", "fold", "_text"])

    return run


def _fit_one(odds):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fold", "_order", "_text"])
        texts = [bytes(t) for t in frame["_text"]]
        network = fitted(texts, frame["label"].to_numpy(), frame["fold"].to_numpy(), odds.value)
        held = io.BytesIO()
        np.savez(held, **network.w)
        return pd.DataFrame({"weights": [held.getvalue()]})

    return run


def _may_have(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = passes(known.value, batch.column("_key").to_numpy().view(np.uint64))
            yield batch.filter(pa.array(keep)).select(["_id", "_text"])

    return run


class Scorer:
    """The network's weights and the log odds, and texts' scores by them."""

    def __init__(self, network: Network, odds: np.ndarray):
        self.network, self.odds = network, odds

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
        """From labelled rows that are not held out. A text with labels of both kinds is toxic; rows
        without a label teach nothing; without labelled rows the network stays as drawn."""
        spark = docs.sparkSession
        marks = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("label")).where("label is not null")
        marks = stored(marks.where(~held_out("_id")).groupBy("_id").agg(F.max("label").alias("label")), "marks")
        rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
        # Only texts that may have a label are shuffled to meet it, and once.
        keys = marks.select(F.xxhash64("_id").alias("key"))
        known = key_filter(keys, "key", keys.count())
        kind = rows.schema["_id"].dataType.simpleString()
        some = rows.withColumn("_key", F.xxhash64("_id")).mapInArrow(_may_have(known), f"_id {kind}, _text string")
        fold = F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(2)).cast("int")
        train = stored(some.join(marks.hint("merge"), "_id").withColumn("fold", fold), "labelled")
        odds = log_odds(train.select("label", "fold", "_text"))
        # A bounded sample by hash, toxic texts and others alike; very long texts teach by an excerpt.
        order = F.xxhash64(F.lit("sample"), "_id")
        sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
        share = lambda kind: min(1.0, TRAINED_ON / 2 / max(1, sizes.get(kind, 0)))
        lucky = F.pmod(order, F.lit(1 << 20)) < F.when(F.col("label") == 1, int(share(1) * (1 << 20))).otherwise(int(share(0) * (1 << 20)))
        sent = spark.sparkContext.broadcast(odds)
        sample = train.where(lucky).select(order.alias("_order"), "label", "fold", "_text")
        sample = sample.mapInArrow(_excerpts(sent), "_order bigint, label int, fold int, _text binary")
        made = sample.groupBy(F.lit(1).alias("_all")).applyInPandas(_fit_one(sent), "weights binary").collect()
        discard(marks, train)
        if not made:
            return cls(Network.fresh(), odds[0])
        held = np.load(io.BytesIO(bytes(made[0]["weights"])))
        return cls(Network({k: held[k] for k in held.files}), odds[0])

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each text: its worst window's. A text without words has the score 0."""
        out = []
        for block in blocks(data, offsets):
            words = Words(block)
            logit, _, _, of = scored_windows(self.network, words, inputs(words, self.odds), block.texts)
            worst = np.full(block.texts, -np.inf)
            np.maximum.at(worst, of, logit)
            out.append(1 / (1 + np.exp(-np.maximum(worst, -700.0))) * (worst > -np.inf))
        return np.concatenate(out) if out else np.zeros(0)


def _scored(scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scorer.value.texts(*column(batch, "_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found)], names=["_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", least: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) of every row, from its text alone.

    Null and empty texts score 0. Repeated rows score alike. Other columns are ignored.
    """
    shared_dir(docs.sparkSession)
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer.fit(docs, labels, id, text, label))
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    found = rows.mapInArrow(_scored(scorer), f"_id {rows.schema['_id'].dataType.simpleString()}, score double")
    return found.select(
        F.col("_id").alias(id), F.coalesce(held_out("_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
