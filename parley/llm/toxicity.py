"""Toxic spans by a linear-chain conditional random field.

Words are tagged clean or toxic.  The labels at hand are of documents, so token
labels are derived first: a word counts as toxic in a document labelled toxic if
its odds between toxic and other documents of the sample are high and sure, or
those of a beginning that it shares with other words; of copies of a text one counts.
The field has weights for a word, its beginnings (``STEMS``) and its last five bytes,
and four transition weights; it is trained on word windows by its exact gradient, from
forward-backward marginals.  In a task the same recursions run over whole texts,
all documents of a slice side by side.

Marginals aggregate to a document score: the expected number of toxic words, the
largest marginal and their density go through a logistic fitted on the sample.
Words whose marginal is a half or more give the offending character offsets.

Defined results: null and empty texts have no words and get the score of a text
without toxic words; a null label does not train, a key with both labels counts
as toxic; a very long word is one word; without labels of both kinds
every score is the share of label 1 (0 without labels); repeated rows are scored
alike; other columns are ignored.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.langid import held_out, sample_rows
from parley.llm.store import documents, fold
from parley.llm.textcols import NON_ALNUM, Words, append_columns, concat_ranges, hash_ranges, mix64, raw, release, split_words, sums

#: Labelled rows that training may gather: the documented bound of the sample.
SAMPLE_ROWS = 4000
#: Word windows of the sample that the field is trained on: its other documented bound.
TRAIN_WINDOWS = 20_000
BUCKETS = 1 << 19
#: Lengths in bytes of the beginnings of words that are features of their own.
STEMS = (4, 5, 6, 7, 8)
SEED = 11
WINDOW = 12
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _stems(data: np.ndarray, offs: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the first ``length`` bytes of words; of shorter words, of all."""
    short = np.minimum(np.diff(offs), length)
    return hash_ranges(data[concat_ranges(offs[:-1], short)], np.concatenate(([0], np.cumsum(short))))


def word_features(vocab: pa.Array) -> np.ndarray:
    """Buckets of the word, of its beginnings and of its last five bytes."""
    data, offs = raw(vocab)
    short = np.minimum(np.diff(offs), 5)
    tail = hash_ranges(data[concat_ranges(offs[1:] - short, short)], np.concatenate(([0], np.cumsum(short))))
    size = np.uint64(BUCKETS // (3 + len(STEMS)))
    parts = [hash_ranges(data, offs) % (2 * size), tail % size + 2 * size]
    parts += [_stems(data, offs, n) % size + np.uint64(3 + i) * size for i, n in enumerate(STEMS)]
    return np.stack(parts, 1).astype(np.int64)


def marginals(emission: np.ndarray, doc: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at each word, by forward-backward in odds.

    ``doc`` bounds the chains; all of them advance together, longest first.
    """
    count = np.diff(doc)
    order = np.argsort(-count, kind="stable")
    base = doc[:-1][order]
    steps = int(count.max(initial=0))
    live = len(count) - np.searchsorted(np.sort(count), np.arange(steps + 1), "right")
    e = np.exp(np.clip(emission, -30, 30))
    (a00, a01), (a10, a11) = np.exp(np.clip(trans, -20, 20))
    forward = np.empty(len(e))
    r = np.zeros(len(count))
    for t in range(steps):
        k = live[t]
        at = base[:k] + t
        r[:k] = e[at] if t == 0 else e[at] * (a01 + a11 * r[:k]) / (a00 + a10 * r[:k])
        forward[at] = r[:k]
    b = np.ones(len(count))
    out = np.empty(len(e))
    for t in range(steps - 1, -1, -1):
        k = live[t + 1]
        x = e[base[:k] + t + 1] * b[:k]
        b[:k] = (a10 + a11 * x) / (a00 + a01 * x)
        k = live[t]
        at = base[:k] + t
        odds = forward[at] * b[:k]
        out[at] = odds / (1 + odds)
    return out


def _grid_fb(e: np.ndarray, live: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and summed pair marginals for windows of equal width (dead cells at the end)."""
    n, width = e.shape
    x = np.exp(np.clip(e, -30, 30))
    a = np.exp(trans)
    f = np.zeros((n, width, 2))
    f[:, 0] = np.stack([np.ones(n), x[:, 0]], 1)
    f[:, 0] /= f[:, 0].sum(1, keepdims=True)
    for t in range(1, width):
        f[:, t] = f[:, t - 1] @ a
        f[:, t, 1] *= x[:, t]
        f[:, t] /= f[:, t].sum(1, keepdims=True)
    b = np.ones((n, 2))
    m = np.zeros((n, width))
    pairs = np.zeros((2, 2))
    for t in range(width - 1, -1, -1):
        p = f[:, t] * b
        m[:, t] = p[:, 1] / p.sum(1)
        if t == 0:
            break
        nxt = b * np.stack([np.ones(n), x[:, t]], 1)
        joint = f[:, t - 1][:, :, None] * a[None] * nxt[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        on = live[:, t]
        pairs += joint[on].sum(0)
        new = nxt @ a.T
        new /= new.sum(1, keepdims=True)
        b = np.where(on[:, None], new, 1.0)
    return m * live, pairs


@dataclass
class ToxicityModel:
    weights: np.ndarray
    trans: np.ndarray
    logistic: np.ndarray

    def tag(self, w: Words) -> np.ndarray:
        e = self.weights[-1] + self.weights[word_features(w.vocab)].sum(1) if len(w.vocab) else np.zeros(0)
        return marginals(e[w.codes], w.doc, self.trans)

    def score(self, m: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return _sigmoid(_document_features(m, doc) @ self.logistic)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _document_features(m: np.ndarray, doc: np.ndarray) -> np.ndarray:
    many = sums(-np.log1p(-np.minimum(m, 1 - 1e-9)), doc)
    most = np.zeros(len(doc) - 1)
    full = np.flatnonzero(np.diff(doc) > 0)
    if len(full):
        most[full] = np.maximum.reduceat(m, doc[:-1][full])
    return np.stack([np.ones(len(most)), np.log1p(many), most, np.minimum(1, 20 * many / (np.diff(doc) + 20))], 1)


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _evidence(a: np.ndarray, b: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Log-likelihood ratio of shares a / pos and b / neg against one common share."""
    share = (a + b) / (pos + neg)
    term = lambda x, of: x * np.log(np.where(x > 0, x, 1) / np.where(x > 0, of, 1))
    return 2 * (term(a, pos * share) + term(pos - a, pos * (1 - share)) + term(b, neg * share) + term(neg - b, neg * (1 - share)))


def toxic_words(w: Words, toxic: np.ndarray) -> np.ndarray:
    """Of each distinct word, whether it, or a beginning that it shares with other words, marks toxic documents.

    Whole words come first, then ever shorter beginnings of the words that are no marks yet.
    """
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    # Copies of a text repeat a word between the same neighbours: only the first place of each kind of document counts.
    code = w.codes.astype(np.uint64) + np.uint64(1)
    inner = doc[1:] == doc[:-1]
    before, after = np.zeros_like(code), np.zeros_like(code)
    before[1:][inner], after[:-1][inner] = code[:-1][inner], code[1:][inner]
    place = mix64(mix64(mix64(before) ^ code) ^ after) ^ (toxic[doc] == 1)
    del before, after, inner, code
    first = np.unique(place, return_index=True)[1]
    pairs = np.unique(doc[first] * max(1, len(w.vocab)) + w.codes[first])
    of, word = np.divmod(pairs, max(1, len(w.vocab)))
    pos, neg = int((toxic == 1).sum()), int((toxic == 0).sum())
    data, offs = raw(w.vocab)
    marks = np.zeros(len(w.vocab), bool)
    for keys in [np.arange(len(w.vocab)), *(np.unique(_stems(data, offs, n), return_inverse=True)[1] for n in sorted(STEMS, reverse=True))]:
        kinds = int(keys.max(initial=-1)) + 1
        of, word = of[~marks[word]], word[~marks[word]]
        at, key = np.divmod(np.unique(of * max(1, kinds) + keys[word]), max(1, kinds))
        a = np.bincount(key[toxic[at] == 1], minlength=kinds)
        b = np.bincount(key[toxic[at] == 0], minlength=kinds)
        # Four times the odds, and more than chance brings among so many keys.
        # A key of a few texts is no mark of toxicity: it must recur in a fiftieth of them.
        odds = np.log((a + 0.5) / (pos - a + 0.5)) - np.log((b + 0.5) / (neg - b + 0.5))
        good = (a >= max(2, 0.02 * pos)) & (odds > np.log(4)) & (_evidence(a, b, pos, neg) > 2 * np.log(max(2, kinds)))
        marks |= good[keys]
    return marks


def train(texts: list[str], toxic: list[int], rounds: int = 60, windows: int = TRAIN_WINDOWS) -> ToxicityModel:
    """Train on word windows: around the marks first, then elsewhere, ``windows`` of them at most."""
    y = np.array(toxic, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        flat = np.array([40.0 if share else -40.0, 0, 0, 0])
        return ToxicityModel(np.zeros(BUCKETS + 1), np.zeros((2, 2)), flat)
    rng = np.random.default_rng(SEED)
    w = split_words(*raw(pa.array(texts, pa.large_string())), NON_ALNUM)
    doc = np.repeat(np.arange(len(y)), w.counts)
    marks = toxic_words(w, y)[w.codes]
    tag = marks & (y[doc] == 1)
    hits = np.flatnonzero(marks)
    centre = np.concatenate((hits, rng.integers(0, max(1, len(doc)), 3 * len(y)))) if len(doc) else np.zeros(0, np.int64)
    centre = centre[rng.permutation(len(centre))[:windows]]
    start = np.maximum(centre - WINDOW, w.doc[doc[centre]]) if len(centre) else centre
    stop = np.minimum(centre + WINDOW + 1, w.doc[doc[centre] + 1]) if len(centre) else centre
    width = 2 * WINDOW + 1
    at = start[:, None] + np.arange(width)
    live = at < stop[:, None]
    at = np.where(live, at, 0)
    feats = word_features(w.vocab)
    weights, trans = np.zeros(BUCKETS + 1), np.zeros((2, 2))
    weights[-1] = -2.0
    if len(centre):
        code = w.codes[at]
        truth = tag[at] & live
        pair_true = np.zeros((2, 2))
        both = live[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                pair_true[i, j] = ((truth[:, :-1] == i) & (truth[:, 1:] == j) & both).sum()
        g2, t2 = np.full(BUCKETS + 1, 1e-6), np.full((2, 2), 1e-6)
        total = live.sum()
        for _ in range(rounds):
            e = (weights[-1] + weights[feats].sum(1))[code]
            m, pairs = _grid_fb(e, live, trans)
            diff = np.bincount(code.ravel(), ((m - truth) * live).ravel(), len(feats))
            grad = np.bincount(feats.ravel(), np.repeat(diff, feats.shape[1]), BUCKETS + 1)
            grad[-1] = diff.sum()
            grad = grad / total + 1e-7 * weights
            tgrad = (pairs - pair_true) / total + 1e-6 * trans
            g2 += grad**2
            t2 += tgrad**2
            weights -= 0.4 * grad / np.sqrt(g2)
            trans -= 0.1 * tgrad / np.sqrt(t2)
    model = ToxicityModel(weights, trans, np.zeros(4))
    model.logistic = _fit_logistic(_document_features(model.tag(w), w.doc), y)
    return model


def train_toxicity_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE_ROWS) -> ToxicityModel:
    """Train on at most about ``most`` labelled documents, evenly over the labels, taken by a hash of the key.

    A key with both labels counts as toxic; of texts that repeat a key the smallest trains.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    rows = sample_rows(rows, key, "y", most)
    # At most about ``most`` keys: a bound that makes the broadcast safe.
    got = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(rows), key).groupBy(key).agg(F.min(text).alias(text), F.max("y").alias("y")).orderBy(key).select(text, "y").toArrow()
    model = train(got.column(0).to_pylist(), got.column(1).to_pylist())
    del got
    gc.collect()
    release()  # the driver goes on to other work, and what training held would stay with it
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", prefix: str = "toxic_", least: float = 0.5) -> DataFrame:
    """``docs`` with <prefix>score and <prefix>spans: character ranges of toxic words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        data, offs = raw(part.column(text))
        w = split_words(data, offs, NON_ALNUM)
        m = sent.value.tag(w)
        bad = np.flatnonzero(m >= least)
        chars = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        of = np.searchsorted(w.doc, bad, "right") - 1
        zero = chars[offs[of]]
        spans = pa.StructArray.from_arrays([pa.array(chars[w.starts[bad]] - zero, pa.int64()), pa.array(chars[w.starts[bad] + w.lengths[bad]] - zero, pa.int64())], names=["start", "end"])
        many = np.bincount(of, minlength=part.num_rows) if len(of) else np.zeros(part.num_rows, np.int64)
        return [pa.array(sent.value.score(m, w.doc), pa.float64()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), spans)]

    return append_columns(docs, text, compute, [T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}spans", _SPAN)])


def trained_for(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """The model of the contract: labels outside the held-out fifth."""
    learn = fold(F.col("doc_id"), 5) != 0
    return train_toxicity_model(docs.where(learn), spark.read.parquet(f"{sf_dir}/labels.parquet").where(learn))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs.select("doc_id", "text"), trained_for(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id", 5).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
