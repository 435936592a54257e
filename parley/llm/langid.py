"""Language identification: averaged hashed subword embeddings, linear softmax.

A word is its letters between two marks; its subwords are the byte n-grams of
2 to 5.  Each n-gram hashes to a row of an embedding table; a text is the mean of
its subwords' rows, and a linear softmax turns that into languages.  Table and
softmax are trained together by stochastic gradient descent in numpy, on word
windows of a bounded sample of labelled rows.  On rows of the sample that the
training did not see, a temperature is fitted and a rejection threshold set.

Once trained, table and softmax of few labels fold into one row of logits per
bucket; a task sums rows per distinct word of a slice, then per document, over
whole texts.

Defined results: a null text, or one without any letter, is ``und`` with score
0; labels that are null do not train; without any labelled row every document is
``und``; ties go to the label that sorts first; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.store import documents, fold
from parley.llm.textcols import append_columns, concat_ranges, mix64, raw, split_words, sums

#: Labelled rows that training may gather: the documented bound of the sample.
SAMPLE_ROWS = 4000
BUCKETS = 1 << 16
DIM = 16
SIZES = (2, 3, 4, 5)
SEED = 7
#: The least number of gradient steps.
STEPS = 600
#: Bytes of distinct words whose subwords are summed at once.
RUN_BYTES = 1 << 17


def subword_sums(vocab: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of table rows over each word's subwords, number of subwords), for a bounded run of words at a time."""
    data, offs = raw(vocab)
    parts, lo = [], 0
    while lo < len(vocab):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + RUN_BYTES, "right")) - 1)
        parts.append(_subword_sums(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], table))
        lo = hi
    if not parts:
        return np.zeros((0, table.shape[1])), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _subword_sums(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(offs)
    # Each word between 0x02 and 0x03.
    begin = offs[:-1] + 2 * np.arange(len(n))
    text = np.full(len(data) + 2 * len(n), 2, np.uint64)
    text[concat_ranges(begin + 1, n)] = data
    text[begin + n + 1] = 3
    end = np.repeat(begin + n + 2, n + 2)
    bounds = np.append(begin, len(text))
    total = np.zeros((len(n), table.shape[1]))
    count = np.zeros(len(n), np.int64)
    h = np.zeros(len(text), np.uint64)
    at = np.arange(len(text))
    with np.errstate(over="ignore"):
        for size in range(1, max(SIZES) + 1):
            m = len(text) - size + 1
            if m <= 0:
                break
            h = (h[:m] + text[size - 1 :] + np.uint64(1)) * np.uint64(0x100000001B3)
            if size not in SIZES:
                continue
            ok = at[:m] + size <= end[:m]
            row = (mix64(h) % np.uint64(len(table))).astype(np.int64)
            value = np.zeros((len(text), table.shape[1]))
            value[:m][ok] = table[row[ok]]
            total += sums(value, bounds)
            full = np.zeros(len(text), np.int64)
            full[:m] = ok
            count += sums(full, bounds)
    return total, count


def subword_lists(vocab: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, offsets per word), for training."""
    rows = []
    for w in vocab.to_pylist():
        text = b"\x02" + w + b"\x03"
        hs = []
        for size in SIZES:
            for i in range(len(text) - size + 1):
                h = 0
                for b in text[i : i + size]:
                    h = (h + b + 1) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
                hs.append(h)
        rows.append(hs)
    offs = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    flat = np.array([h for r in rows for h in r], np.uint64)
    return (mix64(flat) % np.uint64(buckets)).astype(np.int64), offs


@dataclass
class LanguageModel:
    """``rows`` per bucket and ``out`` per label; with few labels they are folded into one row of logits per bucket."""

    labels: list[str]
    rows: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the label or -1, its probability, whether it is rejected)."""
        data, offs = raw(column)
        lettered = has_letter(data, offs)
        n = len(offs) - 1
        if not self.labels:
            return np.full(n, -1), np.zeros(n), np.ones(n, bool)
        w = split_words(data, offs)
        total, count = subword_sums(w.vocab, self.rows)
        z = sums(total[w.codes], w.doc) / np.maximum(sums(count[w.codes], w.doc), 1)[:, None] @ self.out.T + self.bias
        p = softmax(z / self.temperature)
        best = np.where(lettered, p.argmax(1), -1)
        score = np.where(lettered, p.max(1), 0.0)
        return best, np.clip(score, 0, 1), score < self.reject_below


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether a text has an alphabetic character of any script."""
    plain = ((data | 32) >= 97) & ((data | 32) <= 122)
    found = sums(plain.astype(np.int64), offs) > 0
    text = None
    for i in np.flatnonzero(~found & (sums((data >= 128).astype(np.int64), offs) > 0)):
        text = data.tobytes() if text is None else text
        found[i] = any(map(str.isalpha, text[offs[i] : offs[i + 1]].decode("utf-8", "replace")))
    return found


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 3.0, batch: int = 64) -> LanguageModel:
    """Train on word windows of the texts; every fifth text is kept for calibration."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 1)), np.ones((1, 1)), np.zeros(1), 1.0, 1.0)
    rng = np.random.default_rng(SEED)
    w = split_words(*raw(pa.array(texts, pa.large_string())))
    y = np.searchsorted(names, labels)
    spans = []
    for i in range(len(texts)):
        lo, hi = int(w.doc[i]), int(w.doc[i + 1])
        for size in (4, 12, 40):
            if hi > lo:
                s = int(rng.integers(lo, max(lo + 1, hi - size + 1)))
                spans.append((i, s, min(hi, s + size)))
    used = np.unique(np.concatenate([w.codes[s:e] for _, s, e in spans])) if spans else np.zeros(0, np.int64)
    place = np.zeros(len(w.vocab), np.int64)
    place[used] = np.arange(len(used))
    bucket, off = subword_lists(w.vocab.take(pa.array(used)), BUCKETS)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((len(names), DIM)), np.zeros(len(names))
    fit = [s for s in spans if s[0] % 5]
    held = [s for s in spans if s[0] % 5 == 0] or spans
    fit = fit or spans

    def rows(part: list) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a batch of spans and the span each belongs to."""
        words = np.concatenate([place[w.codes[s:e]] for _, s, e in part])
        of = np.repeat(np.arange(len(part)), [e - s for _, s, e in part])
        many = off[words + 1] - off[words]
        return bucket[concat_ranges(off[words], many)], np.repeat(of, many)

    def forward(part: list) -> tuple:
        b, of = rows(part)
        many = np.bincount(of, minlength=len(part))[:, None]
        mean = sums(table[b], np.concatenate(([0], np.cumsum(many[:, 0])))) / np.maximum(many, 1)
        return b, of, many, mean, mean @ out.T + bias

    each = max(1, -(-len(fit) // batch))
    epochs = max(epochs, -(-STEPS // each))  # a small sample is gone over more often
    steps, total = 0, epochs * each
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(fit)), each):
            own = [fit[i] for i in part]
            b, of, many, mean, z = forward(own)
            g = softmax(z)
            g[np.arange(len(own)), y[[s[0] for s in own]]] -= 1
            lr = rate * (1 - steps / total)
            steps += 1
            grad = (g @ out) / np.maximum(many, 1)
            out -= lr / len(own) * g.T @ mean
            bias -= lr / len(own) * g.sum(0)
            np.subtract.at(table, b, lr * grad[of])
    z = np.concatenate([forward(held[i : i + 512])[4] for i in range(0, len(held), 512)])
    truth = y[[s[0] for s in held]]
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    heat = float(grid[int(np.argmin(loss))])
    p = softmax(z / heat)
    # The smallest probability above which 99 in 100 of the held rows are right.
    order = np.argsort(-p.max(1))
    right = np.cumsum((p.argmax(1) == truth)[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= 0.99)
    cut = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    if len(names) < DIM:
        table, out = table @ out.T, np.eye(len(names))
    return LanguageModel(names, table, out, bias, heat, cut)


def sample_rows(labelled: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """At most about ``most`` rows, as evenly over the labels as they allow, by a hash of the key.

    The labels' counts stay a table and are joined, so any number of labels will do.
    """
    counts = labelled.groupBy(label).agg(F.count("*").alias("__n"))
    share = counts.crossJoin(counts.agg(F.count("*").alias("__labels"))).select(F.col(label).alias("__label"), (F.lit(float(most)) / (F.col("__labels") * F.col("__n"))).alias("__share"))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1 << 30)) < F.col("__share") * (1 << 30)
    return labelled.join(share, F.col(label) == F.col("__label")).where(drawn).select(labelled.columns)


def train_language_model(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", most: int = SAMPLE_ROWS) -> LanguageModel:
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, text, label)
    got = sample_rows(rows, key, label, most).orderBy(key, text).select(text, label).toArrow()
    return train(got.column(0).to_pylist(), got.column(1).to_pylist())


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """``docs`` with <prefix>pred, <prefix>score and <prefix>rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        best, score, rejected = sent.value.predict(part.column(text))
        names = np.array([*sent.value.labels, "und"], object)
        return [pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    return append_columns(docs, text, compute, [T.StructField(f"{prefix}pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}rejected", T.BooleanType())])


def held_out(key: str, parts: int) -> Column:
    return F.coalesce(fold(F.col(key), parts) == 0, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_language_model(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 5).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


QUERIES = {"op1_langid": op1_langid}
ORACLE_SQL: dict[str, str] = {}
