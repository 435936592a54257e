"""Seeded sign flips and bootstrap means over tasks, bit for bit what one loop with one generator gives.

The generator's words are one stream; a draw takes the next word whose top bits
are below the bound.  Blocks of the stream are rows, at most ``BLOCKS`` for a bound,
so that values are sent a bounded number of times however many there are: a first
pass counts each block's accepted words, the sums of the counts before it say which
draws a block holds, and a second pass lets each block meet the groups' values.
Sums are exact, so they may be added in any order.  A task reads its block in pieces
and holds at most ``HELD`` values, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import twister
from parley.operators.ranking import numbered

N_RESAMPLES = 10_000
SEED = 42
#: Least words of a block, most blocks of a bound, values of a row and values that a task holds at once.
BLOCK = 1 << 22
BLOCKS = 64
SLICE = 1 << 15
HELD = 1 << 21
#: Words of a piece: so few that sums of limbs over a piece stay exact in doubles.
PIECES = 1 << 20, 1 << 22
#: Bits of a limb: sums of up to 2^32 limbs fit 64 bits.
LIMB = 30
#: The resample that is the values themselves.
SEEN = -1


def _pieces(seed: int, start: int, size: int, below: int, modulus: int) -> Iterator[np.ndarray]:
    """The draws below the bound among the words from ``start`` on, a piece of the words at a time."""
    generator = twister.generator(seed, start, modulus)
    piece = min(max(PIECES[0], 2 * below), PIECES[1])
    for at in range(0, size, piece):
        top = np.frombuffer(generator.bytes(4 * min(piece, size - at)), "<u4") >> (32 - below.bit_length())
        yield top[top < below]


def limbs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, three limbs) of doubles: a value is the sum of its limbs times 2^(30 * (place + 0, 1, 2))."""
    if not np.isfinite(values).all():
        raise ValueError("a value that is not finite can't be resampled")
    share, exponent = np.frexp(values)
    whole = np.ldexp(share, 53).astype(np.int64)
    place, shift = np.divmod(exponent.astype(np.int64) - 53, LIMB)
    size, mask = np.abs(whole), (1 << LIMB) - 1
    low, high = (size & mask) << shift, (size >> LIMB) << shift
    parts = np.stack([low & mask, (low >> LIMB) + (high & mask), high >> LIMB])
    return place, np.sign(whole) * parts


def _layers(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each place that occurs: every value's limb there."""
    place, parts = limbs(values)
    found: dict[int, np.ndarray] = {}
    for at in np.unique(place[values != 0]).tolist():
        for k in range(3):
            layer = found.setdefault(at + k, np.zeros(len(values), np.int64))
            layer += np.where(place == at, parts[k], 0)
    return sorted(found.items()) or [(0, np.zeros(len(values), np.int64))]


def _add(sums: np.ndarray, kind: str, picks: np.ndarray, at: int, first: int, n: int, low: int, layers: np.ndarray) -> None:
    """Add to (resamples from that of draw ``first`` on, layers) the draws from ``at`` on that fall on the values from place ``low`` on."""
    width = layers.shape[1]
    for r in range(at // n, -(-(at + len(picks)) // n)):
        start, end = max(at, r * n), min(at + len(picks), (r + 1) * n)
        own = picks[start - at : end - at]
        if kind == "signs":
            i, j = max(start - r * n, low), min(end - r * n, low + width)
            if i >= j:
                continue
            part = layers[:, i - low : j - low] @ (1.0 - 2.0 * own[i - start + r * n : j - start + r * n])
        else:
            if width < n:
                own = own[(own >= low) & (own < low + width)] - np.uint32(low)
            part = layers @ np.bincount(own, minlength=width).astype(np.float64)
        sums[r - first // n] += part.astype(np.int64)


def _exact(places: Sequence[int], parts: list[int], n: int) -> float:
    """The correctly rounded mean from exact parts."""
    low = min(places)
    total = sum(v << LIMB * (p - low) for p, v in zip(places, parts, strict=True))
    return (total << LIMB * low) / n if low >= 0 else total / (n << -LIMB * low)


@F.pandas_udf(T.DoubleType())
def _mean(known: pd.Series, places: pd.Series, parts: pd.Series, n: pd.Series) -> pd.Series:
    """The mean of a resample, from its parts where no cell held all of it."""
    rows = zip(known.tolist(), places, parts, n.tolist(), strict=True)
    return pd.Series([_exact(a.tolist(), b.tolist(), int(k)) if len(a) else m for m, a, b, k in rows], dtype="float64")


def _blocks(bounds: DataFrame, size: int, most: int) -> DataFrame:
    """Bounds with the blocks that hold their draws and the words of a block: the expected number of words and twelve deviations more."""
    share = F.col("__below") / F.pow(F.lit(2.0), F.length(F.bin("__below")))
    expected = F.col("__draws") / share
    enough = expected + 12 * F.sqrt(expected) + 64
    words = F.greatest(F.lit(size), F.ceil(enough / most)).cast("long")
    return bounds.withColumn("__words", words).withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor(enough / F.col("__words")).cast("long"))))


def value_slices(rows: DataFrame, groups: list[str], value: str, order: str, size: int) -> tuple[DataFrame, DataFrame]:
    """((groups, __slice, __cells), (groups, n)): the values in order, at most ``size`` in a row, and how many there are."""
    placed = numbered(rows, [order], "__i", groups).withColumn("__i", F.col("__i") - 1)
    cell = F.struct(F.col("__i").alias("i"), F.col(value).alias("v"))
    slices = placed.groupBy(*groups, F.floor(F.col("__i") / size).alias("__slice")).agg(F.array_sort(F.collect_list(cell)).alias("__cells"))
    return slices.withColumn("__cells", F.col("__cells.v")), placed.groupBy(*groups).agg(F.count("*").alias("n"))


def resampled_means(pairs: DataFrame, groups: list[str], kinds: tuple[str, ...], n_resamples: int, seed: int, value: str, order: str, block: int, size: int, blocks: int = BLOCKS, hold: int = HELD) -> DataFrame:
    """(groups, __kind, __resample, n, mean): the mean of each resample, and of the values as resample -1.

    Kind ``signs`` flips the sign of each value, ``means`` draws with replacement.
    """
    modulus = twister.characteristic()
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small rows that ask for much work are not put together
    there = pairs.where(F.col(value).isNotNull()).select(*groups, order, F.col(value).cast("double").alias("__value"))
    slices, sizes = value_slices(there, groups, "__value", order, size)
    kind = F.explode(F.array(*map(F.lit, kinds)))
    wanted = sizes.withColumn("__kind", kind).withColumn("__below", F.when(F.col("__kind") == "signs", F.lit(2)).otherwise(F.col("n")).cast("long"))
    wanted = wanted.withColumn("__draws", F.col("n") * n_resamples)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            asked = zip(rows["__below"], rows["__block"], rows["__words"], strict=True)
            rows["__accepted"] = [sum(map(len, _pieces(seed, b * words, words, below, modulus))) for below, b, words in asked]
            yield rows

    bounds = wanted.groupBy("__below").agg(F.max("__draws").alias("__draws"))
    asked = _blocks(bounds, block, blocks).select("__below", "__block", "__words").repartition(tasks, "__below", "__block")
    counted = asked.mapInPandas(count, "__below long, __block long, __words long, __accepted long")
    before = Window.partitionBy("__below").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for a block of words
    every = F.sum("__accepted").over(Window.partitionBy("__below"))
    first = counted.withColumn("__first", F.coalesce(F.sum("__accepted").over(before), F.lit(0))).withColumn("__every", every)
    enough = F.when(F.col("__every") >= F.col("__draws"), F.col("__first") < F.col("__draws")).otherwise(F.raise_error(F.lit("the blocks of the stream hold too few draws")))
    met = wanted.join(first, "__below").where(enough).withColumn("__last", F.least(F.col("__draws"), F.col("__first") + F.col("__accepted"))).drop("__draws", "__every", "__accepted")
    names, stream = [*groups, "__kind"], ["__below", "__block", "__words", "__first"]
    met = met.join(slices, groups).repartition(tasks, "__below", "__block").sortWithinPartitions("__below", "__block", *names, "__slice")
    shape = T.StructType([met.schema[g] for g in names]).add("__resample", "long").add("__whole", "double").add("__place", "long").add("__part", "long")

    def drawn(below: int, b: int, words: int, first: int, held: list) -> Iterator[pa.RecordBatch]:
        """What a block gives for the values held: (a row of names, kind, n, last draw, first place, cells); the stream is read once."""
        alike: dict[tuple, list] = {}
        for own, what, n, last, low, parts in held:
            cells = np.concatenate(parts)
            alike.setdefault((what, n, last, low, len(cells)), []).append((own, _layers(cells)))
        held.clear()
        for key, them in alike.items():
            layers = np.stack([layer for _, found in them for _, layer in found]).astype(np.float64)
            them.append((layers, np.zeros((-(-key[2] // key[1]) - first // key[1], len(layers)), np.int64)))
        at = first
        for picks in _pieces(seed, b * words, words, below, modulus):
            for (what, n, last, low, _), (*_, (layers, sums)) in alike.items():
                if at < last:
                    _add(sums, what, picks[: last - at], at, first, n, low, layers)
            at += len(picks)
        for (_, n, last, _, width), (*them, (_, sums)) in alike.items():
            resamples = first // n + np.arange(len(sums))
            whole = (resamples * n >= first) & ((resamples + 1) * n <= last) & (width == n)
            for own, found in them:
                mine, sums = sums[:, : len(found)], sums[:, len(found) :]

                def out(of: np.ndarray, means: list[float] | None, place: int | None, part: np.ndarray | None, own: pa.RecordBatch = own) -> pa.RecordBatch:
                    k = len(of)
                    named = [own.column(c).take(pa.array(np.zeros(k, np.int64))) for c in names]
                    places = pa.nulls(k, pa.int64()) if place is None else pa.array(np.full(k, place, np.int64))
                    made = [pa.nulls(k, pa.float64()) if means is None else pa.array(means, pa.float64()), places, pa.nulls(k, pa.int64()) if part is None else pa.array(part, pa.int64())]
                    return pa.record_batch([*named, pa.array(of, pa.int64()), *made], names=shape.names)

                if whole.any():
                    yield out(resamples[whole], [_exact([p for p, _ in found], part, n) for part in mine[whole].tolist()], None, None)
                for i, (place, layer) in enumerate(found):
                    if not whole.all():
                        yield out(resamples[~whole], None, place, mine[~whole, i])
                    if b == 0:
                        yield out(np.array([SEEN]), None, place, layer.sum(keepdims=True))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, length = None, [], 0
        for rows in batches:
            columns = [rows.column(c).to_pylist() for c in (*stream, *names, "n", "__last", "__slice")]
            for r, row in enumerate(zip(*columns, strict=True)):
                at, name, (n, last, slice_) = row[: len(stream)], row[len(stream) : -3], row[-3:]
                if held and (at != now or length >= hold):
                    yield from drawn(*now, held)
                    length, before = 0, None
                if not held or name != before:
                    now, before = at, name
                    held.append((rows.slice(r, 1).select(names), name[-1], n, last, slice_ * size, []))
                held[-1][-1].append(np.array(rows.column("__cells")[r].values, np.float64))
                length += len(held[-1][-1][-1])
        if held:
            yield from drawn(*now, held)

    one = [*names, "__resample"]
    parts = met.mapInArrow(draw, shape).repartition(tasks, *one).groupBy(*one, "__place").agg(F.max("__whole").alias("__whole"), F.sum("__part").alias("__part"))
    whole = parts.groupBy(*one).agg(F.max("__whole").alias("__whole"), F.collect_list("__place").alias("__places"), F.collect_list("__part").alias("__parts"))  # a row for a limb
    return whole.join(sizes, groups).select(*one, "n", _mean("__whole", "__places", "__parts", "n").alias("mean"))


def resampled(pairs: DataFrame, groups: list[str], signs: bool = True, means: bool = True, n_resamples: int = N_RESAMPLES, seed: int = SEED, value: str = "diff", order: str = "scenario_id", block: int = BLOCK, size: int = SLICE, blocks: int = BLOCKS, hold: int = HELD) -> DataFrame:
    """(groups, n, permutation_p, ci_low, ci_high): sign-flip p of the size of the mean, and percentile interval of the mean.

    Values are taken in the order of ``order``, which tells a group's rows apart; null values take no part, groups
    may not be null, a value that is not finite is an error, an empty table gives no row.
    """
    kinds = tuple(k for k, asked in (("signs", signs), ("means", means)) if asked)
    got = resampled_means(pairs, groups, kinds, n_resamples, seed, value, order, block, size, blocks, hold)
    flips, drawn = F.col("__kind") == "signs", (F.col("__kind") == "means") & (F.col("__resample") != SEEN)
    seen = F.max(F.when(F.col("__resample") == SEEN, F.abs("mean")))
    sides = F.array_sort(F.collect_list(F.when(flips & (F.col("__resample") != SEEN), F.abs("mean"))))  # a value for a resample
    ordered = F.array_sort(F.collect_list(F.when(drawn, F.col("mean"))))
    table = got.groupBy(*groups).agg(F.first("n").alias("n"), seen.alias("__seen"), sides.alias("__sides"), ordered.alias("__means"))

    def at(percent: float) -> Column:
        rank = percent / 100 * (n_resamples - 1)
        low, share = int(rank), rank - int(rank)
        return F.element_at("__means", low + 1) * (1 - share) + F.element_at("__means", min(low + 1, n_resamples - 1) + 1) * share

    out = [*groups, "n"]
    if signs:
        extreme = F.size(F.filter("__sides", lambda m: m >= F.col("__seen")))
        out.append(((extreme + 1) / F.lit(n_resamples + 1)).alias("permutation_p"))
    if means:
        out += [at(2.5).alias("ci_low"), at(97.5).alias("ci_high")]
    return table.select(*out)
