"""Toxicity by a convolutional classifier over hashed word embeddings, trained in numpy, thresholds by language.

A word's embedding is the sum of two out of ``BUCKETS``, hashed from the word and from its first letters. Filters of several widths run over the whole text, each keeps its largest
response, and a logistic layer weighs them. Training starts embeddings at how much more often a bucket occurs in toxic
texts. A text's language is guessed from its own common words; the threshold of each language is chosen on a part of
the training rows that training did not see, and scores are shifted so that a score of 0.5 is the threshold.

Training reads every labelled row that is not held out. Up to ``TRAIN_ROWS`` rows and ``TRAIN_WORDS`` words it happens on the
driver. More are trained on where they are: counts are sums over all rows, replicas of the model learn from their share of the
rows and are averaged after every round, and thresholds come from running sums over all logits. Texts are shuffled once, to their labels.
Scoring is a map over whole texts on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicerank.llm.common import KEEP, Work, held, map_texts, slices, texts
from choicerank.operators.groups import running
from choicerank.settings import checkpointed

BUCKETS = 1 << 17
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Bounds of what is trained on the driver.
TRAIN_ROWS = 8_000
TRAIN_WORDS = 8_000_000
EPOCHS = 6
#: Replicas of the model that learn side by side, at most, and rows of a round that are worth one.
REPLICAS, REPLICA_ROWS = 32, 2_000

# Common words that tell four languages apart.
COMMON = {
    "en": "the of and to in is that it for was on are with this",
    "de": "der die und das den von zu mit ist auf ein eine nicht sich",
    "fr": "le les des et est une du que qui dans pour sur pas au",
    "es": "el los las y en que por con para una del se lo su",
}
LANGUAGES = [*COMMON, "other"]

#: Letters of a word's beginning that have an embedding of their own; the last bucket stands for shorter words.
PREFIX = 4

_WORD = re.compile(r"[^\W_]+")


def word_ids(text: str) -> np.ndarray:
    """Two buckets for each of a text's words, in order: of the word and of its beginning."""
    import xxhash

    known: dict[str, tuple[int, int]] = held("toxicity").setdefault("words", {})
    if len(known) > KEEP:
        known.clear()
    out = []
    for word in _WORD.findall(text.lower()):
        codes = known.get(word)
        if codes is None:
            start = xxhash.xxh3_64_intdigest("^" + word[:PREFIX]) if len(word) > PREFIX else -1
            codes = known[word] = (xxhash.xxh3_64_intdigest(word) % (BUCKETS - 1),
                                    start % (BUCKETS - 1) if start >= 0 else BUCKETS - 1)
        out.append(codes)
    return np.array(out, np.int32).reshape(-1, 2)


def _language_table() -> np.ndarray:
    table = np.zeros((BUCKETS, len(COMMON)), np.float32)
    for k, words in enumerate(COMMON.values()):
        for word in words.split():
            table[word_ids(word)[0, 0], k] += 1
    return table / np.maximum(table.sum(axis=1, keepdims=True), 1)


@dataclass
class Model:
    embedding: np.ndarray  # buckets x size
    filters: list[np.ndarray]  # by width: width x size x filters
    bias: list[np.ndarray]
    weights: np.ndarray
    offset: float
    thresholds: np.ndarray  # in logits, by language

    def __post_init__(self):
        self._tables = None
        self._languages = _language_table()

    def language(self, ids: np.ndarray) -> int:
        """Place in ``LANGUAGES``."""
        votes = self._languages[ids[:, 0]].sum(axis=0) if len(ids) else np.zeros(len(COMMON))
        return int(votes.argmax()) if votes.max() > 0 else len(COMMON)

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter and where it is; a text shorter than a filter is padded by nothing."""
        if self._tables is None:
            self._tables = [[self.embedding @ w for w in layer] for layer in self.filters]
        best, at = [], []
        for tables, bias, width in zip(self._tables, self.bias, WIDTHS):
            n = len(ids) - width + 1
            if n < 1:
                best.append(np.zeros(FILTERS, np.float32))
                at.append(np.full(FILTERS, -1))
                continue
            total = tables[0][ids[:n, 0]] + tables[0][ids[:n, 1]]
            for k in range(1, width):
                total += tables[k][ids[k:k + n, 0]]
                total += tables[k][ids[k:k + n, 1]]
            where = total.argmax(axis=0)
            at.append(where)
            best.append(np.maximum(total[where, np.arange(FILTERS)] + bias, 0))
        return np.concatenate(best), np.concatenate(at)

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids)[0] @ self.weights + self.offset)

    def score(self, text: str) -> float:
        ids = word_ids(text)
        return float(1 / (1 + np.exp(-np.clip(self.logit(ids) - self.thresholds[self.language(ids)], -30, 30))))


class _Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, value: np.ndarray, slope: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (slope - self.m)
        self.v += 0.01 * (slope * slope - self.v)
        value -= self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.99 ** self.t)) + 1e-8)


class _Steps:
    """The optimizers of everything but the embeddings, which take plain steps."""

    def __init__(self, model: Model):
        self.filters, self.bias = [_Adam(f.shape, 0.01) for f in model.filters], [_Adam(b.shape, 0.01) for b in model.bias]
        self.weights, self.offset = _Adam(model.weights.shape, 0.02), _Adam((1,), 0.02)


def _initial(counts: np.ndarray, totals: np.ndarray, prior: float, random: np.random.Generator) -> Model:
    """The model training starts with; ``counts`` has the texts of either label with a bucket."""
    # A bucket's first coordinate: log odds, drawn to zero where it was seen in few texts.
    odds = np.log(counts[1] / totals[1]) - np.log(counts[0] / totals[0])
    odds *= 1 - 3 / (3 + counts.sum(axis=0) - 1)
    embedding = random.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
    embedding[:, 0] = odds / 2
    filters = [random.normal(0, 0.2, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for layer in filters:
        layer[:, 0, :] = np.abs(layer[:, 0, :]) + 0.5 / len(layer)
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    weights = np.full(FILTERS * len(WIDTHS), 0.05, np.float32)
    return Model(embedding, filters, bias, weights, prior, np.zeros(len(LANGUAGES)))


def _prior(share: float) -> float:
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    return float(np.log(share / (1 - share)))


def _learn(model: Model, steps: _Steps, offset: np.ndarray, rows: list[np.ndarray], labels: np.ndarray) -> None:
    """One step on a batch."""
    model._tables = None
    embedding, filters, bias, weights = model.embedding, model.filters, model.bias, model.weights
    d_filters, d_bias = [np.zeros_like(f) for f in filters], [np.zeros_like(b) for b in bias]
    d_weights, d_offset = np.zeros_like(weights), np.zeros(1, np.float32)
    d_embedding: dict[int, np.ndarray] = {}
    for ids, label in zip(rows, labels):
        values, at = model.pooled(ids)
        slope = 1 / (1 + np.exp(-(values @ weights + offset[0]))) - label
        d_weights += slope * values
        d_offset += slope
        back = np.where(values > 0, slope * weights, 0)
        for k, width in enumerate(WIDTHS):
            mine, where = back[k * FILTERS:(k + 1) * FILTERS], at[k * FILTERS:(k + 1) * FILTERS]
            d_bias[k] += mine
            for f in np.flatnonzero(mine):
                for j in range(width):
                    change = mine[f] * filters[k][j, :, f]
                    for bucket in ids[where[f] + j].tolist():
                        d_filters[k][j, :, f] += mine[f] * embedding[bucket]
                        if bucket in d_embedding:
                            d_embedding[bucket] += change
                        else:
                            d_embedding[bucket] = change.copy()
    n = len(rows)
    for k in range(len(WIDTHS)):
        steps.filters[k].step(filters[k], d_filters[k] / n)
        steps.bias[k].step(bias[k], d_bias[k] / n)
    steps.weights.step(weights, d_weights / n + 1e-4 * weights)
    steps.offset.step(offset, d_offset / n)
    for bucket, slope in d_embedding.items():
        embedding[bucket] -= 0.5 * slope / n
    model.offset = float(offset[0])


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Fit to word ids and labels 0 or 1. Without both labels the model gives every text the share of label 1."""
    random = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    prior = _prior(labels.mean() if len(labels) else 0.0)
    fitted = np.array([i % 4 != 0 for i in range(len(rows))], bool)
    counts = np.full((2, BUCKETS), 0.5)
    totals = np.ones(2)
    for ids, label in zip((r for r, f in zip(rows, fitted) if f), labels[fitted]):
        counts[int(label), np.unique(ids)] += 1
        totals[int(label)] += 1
    model = _initial(counts, totals, prior, random)
    if labels.min(initial=1) == labels.max(initial=0):
        model.weights[:] = 0
        return model
    steps, offset = _Steps(model), np.array([prior], np.float32)
    order = np.flatnonzero(fitted)
    for _ in range(epochs):
        random.shuffle(order)
        for begin in range(0, len(order), 64):
            batch = order[begin:begin + 64]
            _learn(model, steps, offset, [rows[i] for i in batch], labels[batch])
    model._tables = None
    held = [i for i in range(len(rows)) if not fitted[i]]
    _calibrate(model, [rows[i] for i in held], labels[held])
    model._tables = None  # rebuilt where it is used
    return model


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    for batch in batches:
        for ids, y in zip(batch.column("ids"), batch.column("y").to_pylist()):
            yield np.frombuffer(ids.as_py(), np.int32).reshape(-1, 2), y


def _small_parts(model: Model) -> np.ndarray:
    """Everything but the embeddings, as rows as long as an embedding."""
    flat = np.concatenate([*(f.ravel() for f in model.filters), *model.bias, model.weights, [model.offset]])
    return np.r_[flat, np.zeros(-len(flat) % SIZE)].reshape(-1, SIZE)


def _with_small_parts(model: Model, values: np.ndarray) -> None:
    flat, begin = values.ravel(), 0
    for part in (*model.filters, *model.bias, model.weights):
        part[...] = flat[begin:begin + part.size].reshape(part.shape)
        begin += part.size
    model.offset = float(flat[begin])


def _replica(start: Model, examples: Iterator[tuple[np.ndarray, int]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows learned from, and the changes of embeddings and of the other parts. A step handles the embeddings of its batch only."""
    model = Model(start.embedding.copy(), [f.copy() for f in start.filters], [b.copy() for b in start.bias],
                  start.weights.copy(), start.offset, start.thresholds)
    steps, offset, n = _Steps(model), np.array([start.offset], np.float32), 0
    while batch := list(islice(examples, 64)):
        own, place = np.unique(np.concatenate([ids.ravel() for ids, _ in batch]), return_inverse=True)
        ends = np.cumsum([ids.size for ids, _ in batch])[:-1]
        local = copy(model)
        local.embedding = model.embedding[own]
        _learn(local, steps, offset, [p.reshape(-1, 2) for p in np.split(place, ends)], np.array([y for _, y in batch], np.float32))
        model.embedding[own] = local.embedding
        model.offset = local.offset
        n += len(batch)
    return n, model.embedding - start.embedding, _small_parts(model) - _small_parts(start)


def train_spread(rows: DataFrame, epochs: int = EPOCHS, seed: int = 5, full: int = TRAIN_ROWS) -> Model:
    """``train`` on a stored table of ``k``, ``ids``, ``y`` of any size: three quarters are learned from, by a hash of the key, the
    others set the thresholds.

    Each of ``epochs`` rounds learns from all of the first, or, beyond ``full`` rows, from a part of them, so that every row is
    learned from at least once. What reaches the driver has the size of the model.
    """
    spark = rows.sparkSession
    place = F.xxhash64(F.col("k").cast("string"), F.lit(seed))
    fitted, calibration = rows.where(F.pmod(place, F.lit(4)) != 0), rows.where(F.pmod(place, F.lit(4)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS + 1), np.int64)  # the last one counts texts
        for ids, y in _examples(batches):
            seen[y, np.unique(ids)] += 1
            seen[y, BUCKETS] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(s[at]) for s in seen)], ["slot", "n0", "n1"])

    found = fitted.select("ids", "y").mapInArrow(count, "slot long, n0 long, n1 long").groupBy("slot").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    seen = np.zeros((2, BUCKETS + 1))
    for y in (0, 1):
        seen[y, found["slot"].to_numpy()] = found[f"n{y}"].to_numpy()
    n, positive = rows.agg(F.count("y"), F.sum("y")).first()
    n_fitted = int(seen[:, BUCKETS].sum())
    model = _initial(seen[:, :BUCKETS] + 0.5, seen[:, BUCKETS] + 1, _prior((positive or 0) / max(n, 1)),
                     np.random.default_rng(seed))
    if not positive or positive == n:
        model.weights[:] = 0
        return model
    parts = min(epochs, max(1, -(-n_fitted // full)))
    replicas = min(REPLICAS, max(1, n_fitted // parts // REPLICA_ROWS))
    values = [f"v{i}" for i in range(SIZE)]
    for step in range(epochs):
        shared = spark.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            n, embeddings, small = _replica(shared.value, _examples(batches))
            if n:
                at = np.flatnonzero(embeddings.any(axis=1))
                slots = np.r_[at, BUCKETS + np.arange(len(small))]
                changes = np.r_[embeddings[at], small].astype(np.float64) * n
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.full(len(slots), n)),
                                                  *(pa.array(c) for c in changes.T.copy())], ["slot", "n", *values])

        own = fitted.where(F.pmod(F.shiftright(place, 8), F.lit(parts)) == step % parts).select("ids", "y")
        found = own.coalesce(replicas).mapInArrow(learn, f"slot long, n long, {', '.join(f'{v} double' for v in values)}").groupBy(
            "slot").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in values]).toArrow()
        shared.destroy()
        # A bucket's change is the mean of the replicas that met it.
        slots = found["slot"].to_numpy()
        changes = np.stack([found[v].to_numpy() for v in values], axis=1) / found["n"].to_numpy()[:, None]
        inside, small = slots < BUCKETS, _small_parts(model)
        model.embedding[slots[inside]] += changes[inside].astype(np.float32)
        small[slots[~inside] - BUCKETS] += changes[~inside]
        _with_small_parts(model, small)
    _calibrate_spread(model, calibration)
    return model


def _calibrate(model: Model, rows: list[np.ndarray], labels: np.ndarray) -> None:
    """For each language the threshold with the best F1; languages with few toxic rows take the overall one."""
    logits = np.array([model.logit(r) for r in rows])
    languages = np.array([model.language(r) for r in rows])

    def best(which: np.ndarray) -> float | None:
        if labels[which].sum() < 10:
            return None
        order = np.argsort(-logits[which], kind="stable")
        hits = np.cumsum(labels[which][order])
        values = logits[which][order]
        last = np.r_[values[1:] != values[:-1], True]
        f1 = np.where(last, 2 * hits / (np.arange(1, len(hits) + 1) + hits[-1]), 0)
        k = int(f1.argmax())
        below = values[k + 1] if k + 1 < len(values) else values[k] - 1
        return float((values[k] + below) / 2)

    overall = best(np.ones(len(rows), bool)) if len(rows) else None
    for k in range(len(LANGUAGES)):
        own = best(languages == k) if len(rows) else None
        model.thresholds[k] = own if own is not None else overall if overall is not None else 0.0


def _calibrate_spread(model: Model, rows: DataFrame) -> None:
    """``_calibrate`` on a table: F1 at every logit from running sums, which hold whatever the number of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(shared.value.language(ids), shared.value.logit(ids), y) for ids, y in _examples([batch])]
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int32()))],
                                             ["kind", "logit", "y"])

    overall = len(LANGUAGES)
    both = F.array(F.col("kind"), F.lit(overall))
    points = checkpointed(rows.select("ids", "y").mapInArrow(respond, "kind int, logit double, y int")
                          .select(F.explode(both).alias("kind"), "logit", "y")
                          .groupBy("kind", "logit").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")))
    order = [-F.col("logit")]
    sums = running(running(points, "kind", order, "upto", weight=F.col("n")), "kind", order, "found", weight=F.col("hits"), total="all")
    f1 = 2 * F.col("found") / (F.col("upto") + F.col("all"))
    best = {r.kind: r.at for r in sums.where(F.col("all") >= 10).groupBy("kind").agg(
        F.max_by("logit", F.struct(f1, F.col("logit"))).alias("at")).collect()}
    if best:
        at = F.element_at(F.create_map(*[F.lit(v) for item in best.items() for v in item]), F.col("kind"))
        below = {r.kind: r.below for r in points.where(F.col("logit") < at).groupBy("kind").agg(
            F.max("logit").alias("below")).collect()}
        cuts = {kind: (v + below.get(kind, v - 1)) / 2 for kind, v in best.items()}
        model.thresholds[:] = [cuts.get(kind, cuts.get(overall, 0.0)) for kind in range(len(LANGUAGES))]
    shared.destroy()


def held_out(key: F.Column) -> F.Column:
    """Rows whose crc32 of the key as text is divisible by five: never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = TRAIN_ROWS, words: int = TRAIN_WORDS) -> Model:
    """Train on all labelled rows that are not held out; on the driver up to ``rows`` of them with ``words`` words, else spread.

    Labels other than 0 and 1, null keys and keys without a document teach nothing; a key with several labels or texts
    counts as often.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & F.col("k").isNotNull() & ~held_out(F.col("k")))
    joined = texts(docs.where(F.col(key).isNotNull() & ~held_out(F.col(key))), key, text).withColumnRenamed(key, "k").join(
        known.hint("merge"), "k").select("k", "text", "y")  # labels grow with the documents: never through the driver

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            ids = [word_ids(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(ids, pa.binary()), part.column("y")],
                                             ["k", "ids", "y"])

    work = Work(docs.sparkSession)
    found = work.store(joined.mapInArrow(make, f"k {dict(joined.dtypes)['k']}, ids binary, y int"), "words")
    n, size = found.agg(F.count("y"), F.sum(F.octet_length("ids"))).first()
    if n > rows or size and size > words * 8:  # two numbers of four bytes a word
        model = train_spread(found, full=rows)
    else:
        ordered = found.orderBy(F.xxhash64(F.col("k").cast("string")), "k", "y", "ids").toLocalIterator()
        sample = [(np.frombuffer(row.ids, np.int32).reshape(-1, 2), row.y) for row in ordered]
        model = train([ids for ids, _ in sample], np.array([y for _, y in sample]))
    work.release("words")
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) of whole texts; a null text is empty and has a score.

    Rows with equal keys are scored each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: BUCKETS embeddings

    def make() -> Callable[[list[str]], dict[str, list]]:
        return lambda batch: {"score": [shared.value.score(t) for t in batch]}

    scored = map_texts(texts(docs, key, text), make, "score double", key)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def clean(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not rejected, all columns in their order. A null text is scored as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            filled = pa.RecordBatch.from_arrays([pa.compute.fill_null(batch.column(at), "")], ["text"])
            for part in slices(filled):
                keep = [shared.value.score(t) < 0.5 for t in part.column(0).to_pylist()]
                yield batch.slice(begin, len(part)).filter(pa.array(keep, pa.bool_()))
                begin += len(part)

    return docs.mapInArrow(run, docs.schema)
