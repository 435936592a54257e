"""Paired statistics: effect size, signed-rank test, sign-flip test, bootstrap, step-down adjustment.

Rank sums are DataFrame work and hold at any size.  The seeded tests draw from a
Mersenne Twister in scenario order and sum exactly, as the conformance vectors
ask; ``resampling`` spreads the draws of a group of any size over tasks, and the
functions of lists here are the same on one machine.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.ranking import average_ranks
from parley.operators.resampling import BLOCKS, HELD, N_RESAMPLES, SEED, SLICE, resampled, value_slices


def signed_rank_sums(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """n, tie correction, and the rank sums of positive and negative differences; zeros left out."""
    nonzero = pairs.where("diff <> 0").withColumn("size", F.abs("diff"))
    ranks = average_ranks(nonzero, groups, "size")
    signs = nonzero.groupBy(*groups, "size").agg(F.count_if(F.col("diff") > 0).alias("up"), F.count_if(F.col("diff") < 0).alias("down"))
    joined = ranks.join(signs, [*groups, "size"])
    sums = joined.groupBy(*groups).agg(F.sum("ties").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("r_plus"), F.sum(F.col("rank") * F.col("down")).alias("r_minus"), F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("tie_term"))
    every = pairs.groupBy(*groups).agg(F.count("*").alias("n_pairs"))
    return every.join(sums, groups, "left").fillna(0, ["n", "r_plus", "r_minus", "tie_term"])


def rank_biserial(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """(R+ - R-) / (R+ + R-); 0 if every difference is 0."""
    s = signed_rank_sums(pairs, groups)
    return s.select(*groups, "n_pairs", "n", F.when(F.col("n") == 0, 0.0).otherwise((F.col("r_plus") - F.col("r_minus")) / (F.col("r_plus") + F.col("r_minus"))).alias("rank_biserial"))


def wilcoxon_z(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """Normal score of the signed-rank statistic with tie correction, without continuity correction."""
    s = signed_rank_sums(pairs, groups)
    n = F.col("n")
    var = (n * (n + 1) * (2 * n + 1) - F.col("tie_term") / 2.0) / 24.0
    w = F.least("r_plus", "r_minus")
    return s.select(*groups, "n", w.alias("w"), F.when(n == 0, 0.0).otherwise((w - n * (n + 1) / 4.0) / F.sqrt(var)).alias("z"))


def wilcoxon_two_sided(diffs: list[float], method: str = "auto") -> float:
    """Exact up to 50 differences without ties and zeros; else the tie-corrected normal form. All zero: 1."""
    d = [x for x in diffs if x != 0]
    if not d:
        return 1.0
    size = sorted(abs(x) for x in d)
    rank, ties, i = {}, 0, 0
    while i < len(size):
        j = i
        while j < len(size) and size[j] == size[i]:
            j += 1
        rank[size[i]] = (i + 1 + j) / 2
        ties += (j - i) ** 3 - (j - i)
        i = j
    n = len(d)
    plus = sum(rank[abs(x)] for x in d if x > 0)
    w = min(plus, n * (n + 1) / 2 - plus)
    if method == "exact" or method == "auto" and n <= 50 and n == len(diffs) and not ties:
        ways = [1]
        for r in range(1, n + 1):
            new = ways + [0] * r
            for k, c in enumerate(ways):
                new[k + r] += c
            ways = new
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    z = (w - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def _signed_rank_p(n_pairs: pd.Series, n: pd.Series, w: pd.Series, tie_term: pd.Series) -> pd.Series:
    """Two-sided p from a group's sums: a row per group."""

    def one(total: int, k: int, least: float, ties: float) -> float:
        if k == 0:
            return 1.0
        if k <= 50 and k == total and ties == 0:
            ways = [1]
            for r in range(1, k + 1):
                grown = ways + [0] * r
                for at, c in enumerate(ways):
                    grown[at + r] += c
                ways = grown
            return min(1.0, 2 * sum(ways[: int(least) + 1]) / 2**k)
        z = (least - k * (k + 1) / 4) / math.sqrt((k * (k + 1) * (2 * k + 1) - ties / 2) / 24)
        return math.erfc(abs(z) / math.sqrt(2))

    return pd.Series([one(int(a), int(b), float(c), float(d)) for a, b, c, d in zip(n_pairs, n, w, tie_term, strict=True)], dtype="float64")


def _integers(values: list[float]) -> tuple[list[int], int]:
    """Exact integers over one power-of-two denominator."""
    parts = [Fraction(v) for v in values]
    den = max((p.denominator for p in parts), default=1)
    return [int(p * den) for p in parts], den


#: Draws held at once.
DRAWS = 1 << 21
#: Bits of a limb: sums of up to 2^33 limbs fit 64 bits.
LIMB = 30


def _draws(below: int, n: int, n_resamples: int, seed: int) -> Iterator[np.ndarray]:
    """Rows of ``n`` draws, a bounded number at a time: what ``random.Random(seed)`` gives in ``choice`` and ``randrange``.

    Each takes the top bits of a Mersenne Twister word, again while they are not below.
    """
    _, state, _ = random.Random(seed).getstate()
    words = np.random.RandomState()
    words.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    held = np.zeros(0, np.uint32)
    while n_resamples:
        rows = min(n_resamples, max(1, DRAWS // n))
        parts, have = [held], len(held)
        while have < rows * n:
            got = np.frombuffer(words.bytes(4 * (rows * n - have + 64)), "<u4") >> (32 - below.bit_length())
            parts.append(got[got < below])
            have += len(parts[-1])
        flat = np.concatenate(parts)
        yield flat[: rows * n].reshape(rows, n)
        held = flat[rows * n :]
        n_resamples -= rows


def _limbs(ints: list[int]) -> list[np.ndarray]:
    """Signed limbs, lowest first, whose int64 sums are exact."""
    top = max((abs(x).bit_length() for x in ints), default=0)
    return [np.array([(abs(x) >> k & (1 << LIMB) - 1) * (1 if x >= 0 else -1) for x in ints], np.int64) for k in range(0, max(1, top), LIMB)]


def _totals(sums: list[np.ndarray]) -> list[int]:
    return [sum(x << LIMB * k for k, x in enumerate(row)) for row in zip(*(s.tolist() for s in sums), strict=True)]


def permutation_two_sided(diffs: list[float], n_resamples: int = N_RESAMPLES, seed: int = SEED) -> float:
    """(extreme + 1) / (B + 1) for the size of the mean under sign flips; sums are exact."""
    ints, den = _integers(diffs)
    n, limbs = len(ints), _limbs(ints)
    seen = abs(sum(ints)) / (n * den)
    hits = 0
    for draws in _draws(2, n, n_resamples, seed):
        signs = 1 - 2 * draws.astype(np.int64)
        hits += sum(abs(t) / (n * den) >= seen for t in _totals([signs @ x for x in limbs]))
    return (hits + 1) / (n_resamples + 1)


def percentile(ordered: list[float], percent: float) -> float:
    """Linear between order statistics."""
    at = percent / 100 * (len(ordered) - 1)
    lo = math.floor(at)
    hi = min(lo + 1, len(ordered) - 1)
    return ordered[lo] * (1 - (at - lo)) + ordered[hi] * (at - lo)


def bootstrap_interval(values: list[float], n_resamples: int = N_RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """Percentile interval of the mean, 2.5 to 97.5."""
    ints, den = _integers(values)
    n, limbs = len(ints), _limbs(ints)
    means = sorted(t / (n * den) for draws in _draws(n, n, n_resamples, seed) for t in _totals([x[draws].sum(axis=1) for x in limbs]))
    return percentile(means, 2.5), percentile(means, 97.5)


def per_group(pairs: DataFrame, groups: list[str], out: dict[str, str], f: Callable[[list[float]], tuple], value: str = "diff") -> DataFrame:
    """``f`` over each group's values in scenario order."""
    kinds = {n: k.dataType.simpleString() for n, k in zip(pairs.schema.names, pairs.schema.fields, strict=True)}
    schema = ", ".join([f"{g} {kinds[g]}" for g in groups] + ["n long"] + [f"{k} {v}" for k, v in out.items()])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values("scenario_id")[value].tolist()
        return pd.DataFrame([[*key, len(values), *f(values)]], columns=[*groups, "n", *out])

    return pairs.select(*groups, "scenario_id", value).groupBy(*groups).applyInPandas(run, schema)


def wilcoxon_p(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """Signed-rank p from rank sums, which are DataFrame work at any size; only the last step, a row per group, is Python."""
    sums = signed_rank_sums(pairs, groups)
    return sums.select(*groups, F.col("n_pairs").alias("n"), _signed_rank_p("n_pairs", "n", F.least("r_plus", "r_minus").cast("double"), F.col("tie_term").cast("double")).alias("wilcoxon_p"))


def permutation_p(pairs: DataFrame, groups: list[str], n_resamples: int = N_RESAMPLES, seed: int = SEED) -> DataFrame:
    return resampled(pairs, groups, means=False, n_resamples=n_resamples, seed=seed)


def bootstrap_mean_ci(pairs: DataFrame, groups: list[str], n_resamples: int = N_RESAMPLES, seed: int = SEED) -> DataFrame:
    return resampled(pairs, groups, signs=False, n_resamples=n_resamples, seed=seed)


#: Numbers whose digests are held at once.
PLACES = 1 << 16


def _counter_sums(b: range, seed: int, held: list[tuple]) -> list[list[float | None]]:
    """For each resample of ``b`` the sums over values held, (n, first place, values, which are known): a digest is taken once for all."""
    sums: list[list[float | None]] = [[None] * len(held) for _ in b]
    top = max(n for n, *_ in held)
    for at in range(0, top, PLACES):
        places = [b"%d" % i for i in range(at, min(at + PLACES, top))]
        for k, resample in enumerate(b):
            prefix = b"%d:%d:" % (seed, resample)
            drawn = np.frombuffer(b"".join([hashlib.md5(prefix + i).digest() for i in places]), ">u4")[::4].astype(np.int64)
            for e, (n, low, values, known) in enumerate(held):
                own = drawn[: max(0, n - at)] % n
                if len(values) < n:
                    own = own[(own >= low) & (own < low + len(values))] - low
                own = own[known[own]]
                if len(own):
                    sums[k][e] = (sums[k][e] or 0.0) + float(values[own].sum())
    return sums


def bootstrap_counter(pairs: DataFrame, groups: list[str], n_resamples: int, seed: int = SEED, size: int = SLICE, hold: int = HELD) -> DataFrame:
    """Percentile interval with counter-based draws: draw i of resample b is md5(seed, b, i) modulo n.

    At most ``BLOCKS`` blocks of resamples meet the values, of which a task holds at most ``hold``; draws are not rows.
    """
    tasks, block = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_resamples // BLOCKS)
    slices, sizes = value_slices(pairs.select(*groups, "scenario_id", F.col("diff").cast("double").alias("diff")), groups, "diff", "scenario_id", size)
    every = F.explode(F.sequence(F.lit(0), F.lit((n_resamples - 1) // block)))
    met = slices.join(sizes, groups).withColumn("__block", every).repartition(tasks, "__block").sortWithinPartitions("__block", *groups, "__slice")
    shape = T.StructType([met.schema[g] for g in groups]).add("n", "long").add("__b", "long").add("__sum", "double")

    def summed(at: int, held: list) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches([row for row, *_ in held])
        whole = [(n, low, np.concatenate(values), np.concatenate(known)) for _, n, low, values, known in held]
        held.clear()
        b = range(at * block, min((at + 1) * block, n_resamples))
        for resample, sums in zip(b, _counter_sums(b, seed, whole), strict=True):
            made = own.append_column("__b", pa.array([resample] * len(own), pa.int64())).append_column("__sum", pa.array(sums, pa.float64()))
            yield from made.combine_chunks().to_batches()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, held, length = None, None, [], 0
        for rows in batches:
            columns = [rows.column(c).to_pylist() for c in ("__block", "__slice", "n", *groups)]
            for r, (at, slice_, n, *name) in enumerate(zip(*columns, strict=True)):
                if held and (at != now or length >= hold):
                    yield from summed(now, held)
                    length = 0
                if not held or name != before:
                    now, before = at, name
                    held.append((rows.slice(r, 1).select([*groups, "n"]), n, slice_ * size, [], []))
                cells = rows.column("__cells")[r].values
                held[-1][-2].append(cells.fill_null(0.0).to_numpy(zero_copy_only=False))
                held[-1][-1].append(cells.is_valid().to_numpy(zero_copy_only=False))
                length += len(cells)
        if held:
            yield from summed(now, held)

    means = met.mapInArrow(draw, shape).groupBy(*groups, "__b").agg((F.sum("__sum") / F.first("n")).alias("mean"))
    return means.groupBy(*groups).agg(F.percentile("mean", F.lit(0.025)).alias("ci_low"), F.percentile("mean", F.lit(0.975)).alias("ci_high"))


def holm(df: DataFrame, p: str, family: list[str], order: list[str]) -> DataFrame:
    """Step-down adjusted p in families: p * (m - i), at most 1, never falling; ties keep ``order``."""
    w = Window.partitionBy(*family).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(*family))
    raw = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1))
    return df.withColumn("__raw", raw).withColumn(f"{p}_holm", F.max("__raw").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__raw")
