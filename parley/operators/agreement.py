"""Agreement between two raters, from one contingency table per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percent_agreement(df: DataFrame, left: str, right: str, groups: list[str]) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg((F.col(left) == F.col(right)).cast("double")).alias("agreement"), F.count("*").alias("n"))


def _contingency(df: DataFrame, left: str, right: str, groups: list[str]) -> DataFrame:
    return df.groupBy(*groups, F.col(left).alias("a"), F.col(right).alias("b")).agg(F.count("*").alias("n"))


def cohen_kappa(df: DataFrame, left: str, right: str, groups: list[str]) -> DataFrame:
    """Unweighted kappa; expected agreement of 1 gives 1 or 0 by what was observed."""
    cells = _contingency(df, left, right, groups)
    total = cells.groupBy(*groups).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(*groups, F.col("a").alias("label")).agg(F.sum("n").alias("x"))
    cols = cells.groupBy(*groups, F.col("b").alias("label")).agg(F.sum("n").alias("y"))
    by_chance = rows.join(cols, [*groups, "label"]).groupBy(*groups).agg(F.sum(F.col("x") * F.col("y")).alias("chance"))
    po = F.col("same") / F.col("total")
    pe = F.coalesce("chance", F.lit(0)) / (F.col("total") * F.col("total"))
    return total.join(by_chance, groups, "left").select(*groups, F.col("total").alias("n"), F.when(pe == 1, (po == 1).cast("double")).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def weighted_kappa(df: DataFrame, left: str, right: str, groups: list[str], order: list) -> DataFrame:
    """Quadratic weights over the places of the labels in ``order``; an unknown label is an error."""
    places = F.array(*map(F.lit, order))
    place = lambda c: F.when(F.array_contains(places, F.col(c)), F.array_position(places, F.col(c)) - 1).otherwise(F.raise_error(F.lit("unknown label")))
    marked = df.select(*groups, place(left).alias("i"), place(right).alias("j"))
    scale = float((len(order) - 1) ** 2)
    # Sums of i, j, squares and products give both the observed and the expected disagreement.
    s = marked.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("i") - F.col("j"), F.lit(2))).alias("d"), F.sum("i").alias("si"), F.sum("j").alias("sj"), F.sum(F.col("i") * F.col("i")).alias("sii"), F.sum(F.col("j") * F.col("j")).alias("sjj"))
    observed = F.col("d") / (F.col("n") * scale)
    expected = (F.col("sii") / F.col("n") + F.col("sjj") / F.col("n") - 2.0 * F.col("si") / F.col("n") * F.col("sj") / F.col("n")) / scale
    return s.select(*groups, "n", F.when(F.abs(expected) < 1e-15, (observed == 0).cast("double")).otherwise(1.0 - observed / expected).alias("weighted_kappa"))


def set_agreement(df: DataFrame, human: str, judge: str, groups: list[str]) -> DataFrame:
    """Share of equal sets, and precision, recall and F1 over all members (human is gold)."""
    h, j = F.array_distinct(human), F.array_distinct(judge)
    sums = df.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.sum(F.size(F.array_intersect(h, j))).alias("tp"),
        F.sum(F.size(F.array_except(j, h))).alias("fp"),
        F.sum(F.size(F.array_except(h, j))).alias("fn"),
        F.avg((F.array_sort(h) == F.array_sort(j)).cast("double")).alias("exact"),
    )
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return sums.select(*groups, "n", "tp", "fp", "fn", "exact", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def changed_cases(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, field, original, changed) of the fields that differ between two label tables."""
    a = left.select(*key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    b = right.select(*key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("original"), F.col(f"b_{f}").alias("changed")) for f in fields])
    return a.join(b, key).select(*key, F.inline(rows)).where(~F.col("original").eqNullSafe(F.col("changed")))


def compare_labels(original: DataFrame, other: DataFrame, gold: DataFrame, key: list[str], label: str) -> DataFrame:
    """Counts of labels that a second labeller corrected, left wrong, or got newly wrong."""
    rows = original.select(*key, F.col(label).alias("o")).join(other.select(*key, F.col(label).alias("x")), key).join(gold.select(*key, F.col(label).alias("g")), key)
    kind = F.when((F.col("o") != F.col("g")) & (F.col("x") == F.col("g")), "corrected").when((F.col("o") != F.col("g")) & (F.col("x") != F.col("g")), "remaining").when((F.col("o") == F.col("g")) & (F.col("x") != F.col("g")), "new").otherwise("right")
    return rows.groupBy(kind.alias("change")).agg(F.count("*").alias("n"))


def first_labels(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key that comes first."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__r = 1").drop("__r")


def long_labels(rows: DataFrame, key: list[str], fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, field, a, b) of pairs of label columns, as text."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for f, (a, b) in fields.items()])
    return rows.select(*key, F.inline(parts))


def contingency_cube(labels: DataFrame, groups: list[str]) -> DataFrame:
    """Counts of each pair of labels and of either label alone, by field: one scan of the labels by grouping sets.

    ``level`` is 0 for a pair, 1 for a first label, 2 for a second one.
    """
    by = [*groups, "field"]
    cube = labels.groupingSets([[*by, "a", "b"], [*by, "a"], [*by, "b"]], *by, "a", "b").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return cube.withColumn("level", F.col("level").bitwiseAND(F.lit(3)))


def instrument_report(labels: DataFrame, groups: list[str], orders: dict[str, list[str]], excluded: tuple[str, ...] = ()) -> DataFrame:
    """Agreement of two instruments on every field: n, share of equal labels, kappa, weighted kappa and bias.

    ``labels`` is (groups, field, a, b); a row with a null or an excluded label is left out and counted.
    Fields in ``orders`` have places: their kappa with quadratic weights is given, and the mean of b's place
    less a's.  A field without a pair has n of 0 and nulls; a label that an order lacks is an error.
    """
    by = [*groups, "field"]
    shut = F.col("a").isNull() | F.col("b").isNull() | F.col("a").isin(*excluded) | F.col("b").isin(*excluded) if excluded else F.col("a").isNull() | F.col("b").isNull()
    marked = labels.select(*by, F.when(~shut, F.col("a")).alias("a"), F.when(~shut, F.col("b")).alias("b"))
    # Left-out rows are pairs of nulls: cells of the cube as well.
    cube = contingency_cube(marked, groups)
    counted = (F.col("level") == 0) & F.col("a").isNotNull()
    place = lambda c: F.coalesce(*[F.when(F.col("field") == f, F.when(F.array_contains(F.array(*map(F.lit, o)), F.col(c)), F.array_position(F.array(*map(F.lit, o)), F.col(c)) - 1).otherwise(F.raise_error(F.lit("unknown label")))) for f, o in orders.items()], F.lit(None).cast("long"))
    scale = F.coalesce(*[F.when(F.col("field") == f, float(max(1, len(o) - 1) ** 2)) for f, o in orders.items()], F.lit(None).cast("double"))
    x, y, n = F.when(counted, place("a")), F.when(counted, place("b")), F.col("n")
    pairs = cube.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(counted, n)), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when((F.col("level") == 0) & F.col("a").isNull(), n)), F.lit(0)).alias("n_excluded"),
        F.sum(F.when(counted & (F.col("a") == F.col("b")), n)).alias("same"),
        F.sum(n * (x - y) * (x - y)).alias("d"), F.sum(n * x).alias("si"), F.sum(n * y).alias("sj"), F.sum(n * x * x).alias("sii"), F.sum(n * y * y).alias("sjj"),
    )
    margins = cube.where("level <> 0").withColumn("label", F.coalesce("a", "b")).where("label IS NOT NULL").groupBy(*by, "label")
    chance = margins.agg((F.sum(F.when(F.col("level") == 1, n).otherwise(0)) * F.sum(F.when(F.col("level") == 2, n).otherwise(0))).alias("c")).groupBy(*by).agg(F.sum("c").alias("chance"))
    total = F.col("n").cast("double")
    po, pe = F.coalesce("same", F.lit(0)) / total, F.coalesce("chance", F.lit(0)) / (total * total)
    observed = F.col("d") / (total * scale)
    expected = (F.col("sii") / total + F.col("sjj") / total - 2.0 * F.col("si") / total * F.col("sj") / total) / scale
    some = lambda c: F.when(F.col("n") > 0, c)
    return pairs.join(chance, by, "left").select(
        *by, "n", "n_excluded", some(po).alias("agreement"), some(F.when(pe == 1, (po == 1).cast("double")).otherwise((po - pe) / (1 - pe))).alias("kappa"),
        some(F.when(F.abs(expected) < 1e-15, (observed == 0).cast("double")).otherwise(1.0 - observed / expected)).alias("weighted_kappa"), some((F.col("sj") - F.col("si")) / total).alias("bias"),
    )


def unmatched_keys(human: DataFrame, judge: DataFrame, key: list[str]) -> DataFrame:
    """Keys that a human scored and the judge did not."""
    return human.select(*key).distinct().join(judge.select(*key), key, "left_anti")


def labeller_report(turns: DataFrame, key: list[str], order: list[str], label: str, gold: str, valid) -> DataFrame:
    """One row: turn accuracy, and how many dialogues have a valid path by gold, by label, by both alike, by gold alone.

    ``valid(turns, column)`` gives ``valid_flow_path`` for each key; an empty gold label is an error.
    """
    whole = turns.withColumn(gold, F.when(F.col(gold).isNotNull() & (F.col(gold) != ""), F.col(gold)).otherwise(F.raise_error(F.lit("a gold label is missing"))))
    counts = whole.agg(F.count("*").alias("n_turns"), F.count_if(F.col(label) == F.col(gold)).alias("n_correct"))
    a = valid(whole, gold).select(*key, F.col("valid_flow_path").alias("g"))
    b = valid(whole, label).select(*key, F.col("valid_flow_path").alias("l"))
    paths = a.join(b, key).agg(F.count("*").alias("n_dialogues"), F.count_if("g").alias("n_gold_valid"), F.count_if("l").alias("n_labelled_valid"), F.count_if(F.col("g") == F.col("l")).alias("n_agree"), F.count_if(F.col("g") & ~F.col("l")).alias("n_gold_only"))
    return counts.crossJoin(paths).withColumn("turn_accuracy", F.col("n_correct") / F.col("n_turns")).withColumn("path_agreement", F.col("n_agree") / F.col("n_dialogues"))
