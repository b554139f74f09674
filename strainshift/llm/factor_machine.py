"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), so all
pairs of features interact at a cost linear in the features a text has. Features are the
square-rooted shares of hashed words and statistics of the whole text's structure. Labels,
language, source and ids are no inputs.

The model is fitted on at most TRAIN_ROWS labelled texts (rows, not labels), those of the
smallest hashed id, whose features (not texts) come to the driver; its size is fixed. Scoring is one pass over
the texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strainshift.llm.wordhash import WordHasher, batches_of
from strainshift.session import materialise

#: The documented bound of the sample that the model is fitted on.
TRAIN_ROWS = 6000
WORD_SLOTS = 1 << 13
RANK = 8
STATS = ("log_bytes", "log_words", "upper", "digit", "space", "newline", "comma_stop", "bang", "pipe", "symbol", "non_ascii",
         "word_length", "long_words", "distinct", "top_word", "repeat_next", "distinct_pairs", "log_line", "line_repeat")
SLOTS = WORD_SLOTS + len(STATS)


def _class(text: str) -> np.ndarray:
    table = np.zeros(256)
    table[[ord(c) for c in text]] = 1
    return table


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = np.stack([
    _class(_LETTERS.upper()), _class("0123456789"), _class(" \t"), _class("\n"), _class(",."), _class("!?"), _class("|"),
    _class("#$%&*+/<=>@[]^_`{}~\\"), np.r_[np.zeros(128), np.ones(128)]], 1)


def features(hasher: WordHasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: number of entries per text, slots, values; whole texts."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.float64)
    per_byte = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ CLASSES for t in texts])
    words, lengths, counts = hasher.words(texts)
    owner = np.repeat(np.arange(n), counts)
    many = np.maximum(counts, 1)

    def distinct(owners, keys):
        order = np.lexsort((keys, owners))
        o, k = owners[order], keys[order]
        new = np.r_[True, (o[1:] != o[:-1]) | (k[1:] != k[:-1])] if len(o) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        return o[at], k[at], np.diff(np.r_[at, len(o)])

    who, word, times = distinct(owner, words)
    top = np.zeros(n)
    np.maximum.at(top, who, times)
    same_owner = owner[1:] == owner[:-1]
    repeat_next = np.bincount(owner[1:][same_owner & (words[1:] == words[:-1])], minlength=n)
    pair_who, _, _ = distinct(owner[1:][same_owner], (words[1:] * np.uint64(31) + words[:-1])[same_owner])
    lines = [t.split(b"\n") for t in texts]
    n_lines = np.array([len(x) for x in lines])
    line_repeat = np.array([1 - len(set(x)) / len(x) for x in lines])
    size = np.maximum(sizes, 1)
    stats = np.column_stack([
        np.log1p(sizes) / 10, np.log1p(counts) / 10, *(per_byte / size[:, None]).T,
        np.bincount(owner, lengths, n) / many / 10, np.bincount(owner[lengths > 20], minlength=n) / many,
        np.bincount(who, minlength=n) / many, top / many, repeat_next / many,
        np.bincount(pair_who, minlength=n) / many, np.log1p(sizes / n_lines) / 10, line_repeat])
    # Hashed words: counts that share a slot add up.
    who2, slot, _ = distinct(who, word % np.uint64(WORD_SLOTS))
    place = np.searchsorted(who2.astype(np.uint64) * np.uint64(WORD_SLOTS) + slot, who.astype(np.uint64) * np.uint64(WORD_SLOTS) + word % np.uint64(WORD_SLOTS))
    share = np.sqrt(np.bincount(place, times, len(who2)) / many[who2])
    entries = np.bincount(who2, minlength=n) + len(STATS)
    ends = np.cumsum(entries)
    slots, values = np.zeros(int(ends[-1]) if n else 0, np.int64), np.zeros(int(ends[-1]) if n else 0, np.float32)
    stat_at = (ends - len(STATS))[:, None] + np.arange(len(STATS))
    slots[stat_at], values[stat_at] = WORD_SLOTS + np.arange(len(STATS)), stats
    rest = np.ones(len(slots), bool)
    rest[stat_at.ravel()] = False
    slots[rest], values[rest] = slot, share
    return entries, slots, values


@dataclass
class Model:
    bias: float
    weight: np.ndarray  # SLOTS
    factor: np.ndarray  # SLOTS x RANK
    mean: np.ndarray    # of the statistics
    scale: np.ndarray

    def prepared(self, slots, values):
        values = values.astype(np.float64)
        stat = slots >= WORD_SLOTS
        k = slots[stat] - WORD_SLOTS
        values[stat] = np.clip((values[stat] - self.mean[k]) / self.scale[k], -4, 4)
        return values

    def margin(self, entries, slots, values):
        """The machine's sum for each row, by the sum-of-squares identity."""
        starts = np.cumsum(entries) - entries
        vx = self.factor[slots] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * (sums ** 2 - np.add.reduceat(vx ** 2, starts, axis=0)).sum(1)
        return self.bias + np.add.reduceat(self.weight[slots] * values, starts) + pairs, sums

    def score(self, entries, slots, values):
        z, _ = self.margin(entries, slots, self.prepared(slots, values))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(entries, slots, values, label, epochs: int = 30, batch: int = 200, rate: float = 0.05, decay: float = 1e-4,
        seed: int = 7) -> Model:
    """AdaGrad on the logistic loss; rows in a fixed shuffled order."""
    rng = np.random.default_rng(seed)
    n = len(entries)
    if n == 0:
        return Model(0.0, np.zeros(SLOTS), np.zeros((SLOTS, RANK)), np.zeros(len(STATS)), np.ones(len(STATS)))
    table = np.zeros((n, len(STATS)))
    row = np.repeat(np.arange(n), entries)
    stat = slots >= WORD_SLOTS
    table[row[stat], slots[stat] - WORD_SLOTS] = values[stat]
    share = np.clip(label.mean(), 0.01, 0.99)
    model = Model(float(np.log(share / (1 - share))), np.zeros(SLOTS), rng.normal(0, 0.01, (SLOTS, RANK)), table.mean(0), table.std(0) + 1e-6)
    values = model.prepared(slots, values)
    starts = np.cumsum(entries) - entries
    g_bias, g_weight, g_factor = 1.0, np.full(SLOTS, 1e-3), np.full((SLOTS, RANK), 1e-3)
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            rows = np.sort(order[k:k + batch])
            at = np.concatenate([np.arange(starts[r], starts[r] + entries[r]) for r in rows])
            s, x, e = slots[at], values[at], entries[rows]
            z, sums = model.margin(e, s, x)
            error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - label[rows]) / len(rows)
            err, v = np.repeat(error, e) * x, model.factor[s]
            grad_v = err[:, None] * (np.repeat(sums, e, axis=0) - v * x[:, None])
            used, inverse = np.unique(s, return_inverse=True)
            gw = np.bincount(inverse, err, len(used)) + decay * model.weight[used]
            gv = np.stack([np.bincount(inverse, grad_v[:, f], len(used)) for f in range(RANK)], 1) + decay * model.factor[used]
            g_bias += error.sum() ** 2
            g_weight[used] += gw ** 2
            g_factor[used] += gv ** 2
            model.bias -= rate * error.sum() / np.sqrt(g_bias)
            model.weight[used] -= rate * gw / np.sqrt(g_weight[used])
            model.factor[used] -= rate * gv / np.sqrt(g_factor[used])
    return model


def held_out(doc):
    """True where crc32 of the id's text leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _as_bytes(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality",
          most: int = TRAIN_ROWS) -> Model:
    """Fit on the `most` labelled texts of the smallest hashed id that are not held out.

    Rows with a null id or a label other than 0 and 1 are not used; an id that has several
    labels counts with each, one that has several texts with each of these, and equal rows
    count once. All of them together are at most `most`. Without usable rows every score is 0.5.
    """
    known = labels.select(F.col(doc).alias("doc"), F.col(label).cast("int").alias("y")).where("doc IS NOT NULL AND y IN (0, 1)")
    known = known.where(~held_out(F.col("doc"))).orderBy(F.xxhash64("doc"), "doc", "y").limit(most)
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("of"))
    # labels are at most `most`, but each may have any number of rows: those are told apart by a hash before any text moves
    keys = texts.join(F.broadcast(known), "doc").select("doc", "y", "of").distinct()
    keys = materialise(keys.orderBy(F.xxhash64("doc"), "doc", "y", "of").limit(most))
    sample = texts.join(F.broadcast(keys), ["doc", "of"]).groupBy("doc", "y", "of").agg(F.first("text").alias("text"))

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            texts = _as_bytes(batch.column("text"))
            for a, b in batches_of([len(t) for t in texts]):
                entries, slots, values = features(hasher, texts[a:b])
                cut = np.cumsum(entries)[:-1]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc").slice(a, b - a).cast(pa.string()), batch.column("y").slice(a, b - a),
                    pa.array([x.astype("<i4").tobytes() for x in np.split(slots, cut)], pa.binary()),
                    pa.array([x.astype("<f4").tobytes() for x in np.split(values, cut)], pa.binary())], ["doc", "y", "slots", "vals"])

    rows = sample.select("doc", "y", "text").mapInArrow(run, "doc string, y int, slots binary, vals binary").collect()
    rows.sort(key=lambda r: (r["doc"], r["y"], r["slots"], r["vals"]))
    slots = [np.frombuffer(r["slots"], "<i4") for r in rows]
    values = [np.frombuffer(r["vals"], "<f4") for r in rows]
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return fit(np.array([len(s) for s in slots], np.int64), join(slots, np.int64), join(values, np.float32),
               np.array([r["y"] for r in rows], np.float64))


def score_documents(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """The rows with their score; null text counts as empty. A column of that name is replaced."""
    docs = docs.drop(column)
    at, schema = docs.columns.index(text), StructType([*docs.schema.fields, StructField(column, DoubleType())])
    names = [*docs.columns, column]

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            texts, scores = _as_bytes(batch.column(at)), []
            for a, b in batches_of([len(t) for t in texts]):
                scores.append(model.score(*features(hasher, texts[a:b])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names)

    return docs.mapInArrow(run, schema)
