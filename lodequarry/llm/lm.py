"""A log-bilinear language model over words, trained in numpy by noise-contrastive estimation, that scores whole texts.

Words are ASCII-lower-cased runs between white space; an end follows each text. The model predicts classes: the end, the most frequent words, and
buckets of all other words by their spelling; within a bucket, a word has the share (c + 1) / (sum of its words' c + number of its words + 1), where the 1 left over is for
unseen words. The probability of a class after two classes a and b is softmax(Q (A r_a + B r_b) + bias).

Training runs on all training texts: tasks take steps from the same parameters over their own part, and the parameters are averaged by the words read; a first
round over an eighth of the texts sets the direction, a second covers all. Averages are summed by Spark, parameter by parameter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequarry.llm import shared

BUCKETS = 64
END = 0


@dataclass(frozen=True)
class Shape:
    """Parameters of the model. known bounds the words whose counts every task holds; all other counts are joined."""

    words: int = 960
    known: int = 1 << 17
    width: int = 16
    noise: int = 32
    batch: int = 4096
    rate: float = 0.15
    seed: int = 5

    @property
    def classes(self) -> int:
        return 1 + self.words + BUCKETS


@dataclass
class Words:
    """The most frequent words, by sorted hash: count and class; the totals of buckets; and what the base needs."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    bucket_log: np.ndarray
    tokens: int
    distinct: int
    ends: int
    first_bucket: int
    unigram: np.ndarray = field(default_factory=lambda: np.empty(0))


def read(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow array of texts: hash and bucket of each word, and the words of each text."""
    buf, edge = shared.flat_texts(texts)
    low = buf.copy()
    capital = (buf >= 65) & (buf <= 90)
    low[capital] += 32
    starts, ends = shared.word_spans(low)
    h = shared.word_hashes(low, starts, ends)
    wide = np.concatenate(([0], np.cumsum(low >= 128)))
    bucket = (low[ends - 1].astype(np.int64) * 7 + (wide[ends] > wide[starts]) * 29 + np.minimum(ends - starts, 12) // 4) % BUCKETS
    return h.view(np.int64), bucket, np.diff(np.searchsorted(starts, edge))


def _counter(batches):
    import pyarrow as pa

    for whole in batches:
        for batch in shared.slices(whole):
            h, bucket, n = read(batch.column(0))
            order = np.argsort(h)
            h, bucket = h[order], bucket[order]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
            c = np.diff(np.append(at, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(bucket[at].astype(np.int32)), pa.array(c)], ["h", "bucket", "c"])


def most_frequent(counts: DataFrame, most: int, least: int):
    """The most frequent words as an Arrow table (h, bucket, c), the most frequent first: at most `most`, the words of a cell of counts all or none, but `least` in any case.

    A count's place is found by a histogram of at most 64 cells an octave, so only the words told leave the tasks, not `most` of each."""
    cell = F.floor(F.log2("c") * 64)
    room, cut = most, None
    for r in sorted(counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["cell"]):
        if r["n"] > room:
            break
        room, cut = room - r["n"], r["cell"]
    if cut is None or most - room < least:
        return counts.orderBy(F.desc("c"), "h").limit(least).toArrow()
    return counts.where(cell >= cut).toArrow().sort_by([("c", "descending"), ("h", "ascending")])


def gather(training: DataFrame, shape: Shape) -> tuple[DataFrame, Words]:
    """Counts of all words of the training texts (h, bucket, c), and what tasks are told of them. The driver gets shape.known rows at most and a row per bucket, as Arrow."""
    counts = training.select("text").mapInArrow(_counter, "h long, bucket int, c long").groupBy("h").agg(F.first("bucket").alias("bucket"), F.sum("c").alias("c"))
    counts = shared.staged(counts, "word-counts")
    ends = training.count()
    top = most_frequent(counts, shape.known, shape.words)
    per_bucket = {r["bucket"]: (r["n"], r["v"]) for r in counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    h, bucket, c = (top.column(k).to_numpy().astype(np.int64) for k in ("h", "bucket", "c"))
    own = min(shape.words, len(h))
    first = 1 + shape.words
    classes = first + bucket
    classes[:own] = 1 + np.arange(own)
    n_b, v_b = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, (n, v) in per_bucket.items():
        n_b[b], v_b[b] = n, v
    for k in range(own):
        n_b[bucket[k]] -= c[k]
        v_b[bucket[k]] -= 1
    total = int(sum(n for n, _ in per_bucket.values()))
    unigram = np.ones(shape.classes) * 0.5
    unigram[END] += ends
    unigram[1 : 1 + own] += c[:own]
    unigram[first:] += n_b
    order = np.argsort(h)
    words = Words(h[order], c[order], classes[order], np.log(n_b + v_b + 1), total + ends, sum(v for _, v in per_bucket.values()) + (ends > 0), ends, first, unigram / unigram.sum())
    return counts, words


def look_up(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash stands among the frequent words, and whether it does."""
    if not len(words.hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(words.hashes, h), len(words.hashes) - 1)
    return at, words.hashes[at] == h


def classify(words: Words, h: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each word, where it stands among the frequent words, and whether it does."""
    sorted_h = np.argsort(h)  # neighbours in the table are found near one another
    at, there = np.empty(len(h), np.int64), np.empty(len(h), bool)
    at[sorted_h], there[sorted_h] = look_up(words, h[sorted_h])
    return np.where(there, words.classes[at] if len(words.classes) else 0, words.first_bucket + bucket), at, there


def with_ends(classes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets with an end after each text, and the two classes before each; before a text stand ends."""
    stop = np.cumsum(n + 1) - 1
    out = np.full(len(classes) + len(n), END, np.int64)
    inner = np.ones(len(out), bool)
    inner[stop] = False
    out[inner] = classes
    one, two = np.full(len(out), END, np.int64), np.full(len(out), END, np.int64)
    one[1:], two[2:] = out[:-1], out[:-2]
    first = stop - n
    two[first] = END
    two[np.minimum(first + 1, stop)] = END
    return out, one, two


class Model:
    """The parameters as one flat vector with named views."""

    def __init__(self, shape: Shape, words: Words, flat: np.ndarray | None = None) -> None:
        k, d = shape.classes, shape.width
        self.shape = shape
        if flat is None:
            rng = np.random.default_rng(shape.seed)
            flat = np.concatenate([rng.normal(0, 0.1, 2 * k * d), np.eye(d).ravel(), 0.5 * np.eye(d).ravel(), np.log(words.unigram)])
        self.flat = flat.astype(np.float32)
        parts = np.split(self.flat, np.cumsum([k * d, k * d, d * d, d * d]))
        self.context, self.target = parts[0].reshape(k, d), parts[1].reshape(k, d)
        self.a, self.b, self.bias = parts[2].reshape(d, d), parts[3].reshape(d, d), parts[4]

    def hidden(self) -> tuple[np.ndarray, np.ndarray]:
        """What each class adds to the prediction as the last word and as the one before."""
        return self.context @ self.a, self.context @ self.b

    def normalisers(self) -> np.ndarray:
        """By the last class and the one before, the logarithm of the sum over all classes: batched matrix products, once for all pairs."""
        one, two = self.hidden()
        out = np.empty((len(one), len(one)), np.float32)
        for k in range(len(one)):
            s = (one[k] + two) @ self.target.T + self.bias
            top = s.max(1, keepdims=True)
            out[k] = (top[:, 0] + np.log(np.exp(s - top).sum(1))).astype(np.float32)
        return out


def train(model: Model, unigram: np.ndarray, batches) -> int:
    """One pass of AdaGrad over batches of (target, last class, class before), in place; returns the tokens read.

    Noise-contrastive estimation: the words of a batch are told from noise words drawn for the batch by their unigram share."""
    shape = model.shape
    k, d = shape.classes, shape.width
    rng = np.random.default_rng(shape.seed + 1)
    log_noise = (np.log(unigram) + math.log(shape.noise)).astype(np.float32)
    cdf = np.cumsum(unigram)
    square = np.full(len(model.flat), 1e-2, np.float32)
    seen = 0
    column = np.arange(d)
    for target, one, two in batches:
        n = len(target)
        if not n:
            continue
        seen += n
        noise = np.minimum(np.searchsorted(cdf, rng.random(shape.noise)), k - 1)
        r1, r2 = model.context[one], model.context[two]
        q = r1 @ model.a + r2 @ model.b
        t = model.target[target]
        s = np.einsum("ij,ij->i", q, t) + model.bias[target] - log_noise[target]
        z = q @ model.target[noise].T + (model.bias[noise] - log_noise[noise])
        g = 1.0 / (1.0 + np.exp(-np.clip(s, -30, 30))) - 1.0  # of the words
        e = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))  # of the noise
        scale = np.float32(1.0 / n)
        g, e = (g * scale).astype(np.float32), (e * scale).astype(np.float32)
        dq = g[:, None] * t + e @ model.target[noise]
        d1, d2 = dq @ model.a.T, dq @ model.b.T
        add = lambda ids, rows: np.bincount((ids[:, None] * d + column).ravel(), rows.ravel(), minlength=k * d)
        d_target = add(target, g[:, None] * q) + add(noise, e.T @ q)
        d_bias = np.bincount(target, g, minlength=k) + np.bincount(noise, e.sum(0), minlength=k)
        grad = np.concatenate([add(one, d1) + add(two, d2), d_target, (r1.T @ dq).ravel(), (r2.T @ dq).ravel(), d_bias]).astype(np.float32)
        grad *= np.float32(shape.classes / 16)
        square += grad * grad
        model.flat -= np.float32(shape.rate) * grad / np.sqrt(square)
    return seen


def _trainer(shape: Shape, told, start: np.ndarray | None):
    import pyarrow as pa

    def cut(batches, words):
        held: list[list[np.ndarray]] = [[], [], []]
        n = 0
        for whole in batches:
            for batch in shared.slices(whole):
                h, bucket, count = read(batch.column(0))
                got = with_ends(classify(words, h, bucket)[0], count)
                for k in range(3):
                    held[k].append(got[k])
                n += len(got[0])
                if n >= shape.batch:
                    flat = [np.concatenate(x) for x in held]
                    whole_batches = n // shape.batch * shape.batch
                    for at in range(0, whole_batches, shape.batch):
                        yield tuple(x[at : at + shape.batch] for x in flat)
                    held = [[x[whole_batches:]] for x in flat]
                    n -= whole_batches
        if n:
            yield tuple(np.concatenate(x) for x in held)

    def run(batches):
        words = told.value
        model = Model(shape, words, start)
        n = train(model, words.unigram, cut(batches, words))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(model.flat), dtype=np.int32)), pa.array(model.flat.astype(np.float64) * n), pa.array(np.full(len(model.flat), n, np.int64))], ["k", "x", "n"])

    return run


def fitted(training: DataFrame, words: Words, shape: Shape, told) -> np.ndarray:
    """The averaged parameters after both rounds."""
    flat = Model(shape, words).flat
    eighth = training.where(F.pmod(F.xxhash64(F.lit(shape.seed), "text"), F.lit(8)) == 0)
    for part in (eighth, training):
        got = part.select("text").mapInArrow(_trainer(shape, told, flat), "k int, x double, n long").groupBy("k").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
        if len(got):
            flat = np.zeros(len(flat), np.float32)
            flat[got.column("k").to_numpy()] = got.column("x").to_numpy()
    return flat


def _scorer(told, shape: Shape, fitted_):
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        words: Words = told.value
        flat, z = fitted_.value
        model = Model(shape, words, flat)
        one_, two_ = model.hidden()
        part, row = TaskContext.get().partitionId(), 0
        base_total = math.log10(words.tokens + words.distinct + 1)
        for whole in batches:
            for batch in shared.slices(whole, 4 << 20):
                h, bucket, n = read(batch.column(batch.schema.get_field_index("text")))
                cls, at, there = classify(words, h, bucket)
                target, one, two = with_ends(cls, n)
                log_p = np.empty(len(target), np.float64)
                for k in range(0, len(target), 1 << 16):
                    t, a, b = target[k : k + (1 << 16)], one[k : k + (1 << 16)], two[k : k + (1 << 16)]
                    log_p[k : k + len(t)] = np.einsum("ij,ij->i", one_[a] + two_[b], model.target[t]) + model.bias[t] - z[a, b]
                edge = np.concatenate(([0], np.cumsum(n + 1)))
                total = lambda x, e: np.diff(np.concatenate(([0.0], np.cumsum(x)))[e])
                inner = np.concatenate(([0], np.cumsum(n)))
                c1 = np.where(there, words.counts[at] if len(words.counts) else 0, 0) + 1.0
                log_c = np.log10(c1)
                in_bucket = cls >= words.first_bucket
                share = np.where(in_bucket, np.where(there, log_c, 0.0) - words.bucket_log[np.maximum(cls - words.first_bucket, 0)] / math.log(10), 0.0)
                score = total(log_p, edge) / math.log(10) + total(share, inner)
                end = math.log10(words.ends + 1)
                base = total(np.where(there, log_c, 0.0), inner) + end - (n + 1) * base_total
                known = np.diff(np.concatenate(([0], np.cumsum(there)))[inner]) + (words.ends > 0)
                rare = h[~there]
                of = np.concatenate(([0], np.cumsum(~there)))[inner].astype(np.int32)
                keep = [k for k, c in enumerate(batch.schema.names) if c != "text"]
                rows = np.arange(row, row + len(n)) + (part << 40)
                row += len(n)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in keep), pa.array(rows), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(of), pa.array(rare))],
                    [*(batch.schema.names[k] for k in keep), "lq_row", "n_tokens", "lq_known", "lq_base", "lq_score", "lq_rare"],
                )

    return run


def score(docs: DataFrame, held_out, shape: Shape = Shape(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability by the model).

    Learns from the rows where held_out (a column of booleans; null: false) is false. base_score sums log10((c + 1) / (N + V + 1)) over the tokens. Counts of
    the most frequent words go to all tasks, a bounded table; the counts of all others are joined word by word. A null or empty text is its end alone. Rows
    are scored each on its own, whatever their id. With no training rows all words are unknown. An empty table gives no rows."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_column), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_column).alias("text"))
    training = plain.where("not held_out")
    counts, words = gather(training, shape)
    told = spark.sparkContext.broadcast(words)
    flat = fitted(training, words, shape, told)
    model = Model(shape, words, flat)
    kept = spark.sparkContext.broadcast((flat, model.normalisers()))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, held_out boolean, lq_row long, n_tokens long, lq_known long, lq_base double, lq_score double, lq_rare array<long>"
    scored = shared.staged(plain.mapInArrow(_scorer(told, shape, kept), schema), "scores")
    rare = scored.select("lq_row", F.explode("lq_rare").alias("h")).groupBy("lq_row", "h").agg(F.count("*").alias("tf"))
    met = rare.join(counts.select("h", "c"), "h").groupBy("lq_row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more"), F.sum("tf").alias("many"))
    out = scored.drop("lq_rare").join(met, "lq_row", "left")
    more, many = F.coalesce("more", F.lit(0.0)), F.coalesce("many", F.lit(0))
    return out.select(
        id_column, "held_out", "n_tokens", (F.col("lq_known") + many).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"), (F.col("lq_base") + more).alias("base_score"), (F.col("lq_score") + more).alias("score")
    )
