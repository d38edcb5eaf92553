"""Group-disjoint splits, out-of-fold rows, split checks and summaries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesift.operators.manifests import manifest_hash
from sitesift.operators.ordering import ranked_positions, seeded_hash
from sitesift.operators.skew import skewed_lookup
from sitesift.operators.validate import never_null

SPLITS = ["train", "validation", "test"]
DEAL_ORDER = [2, 3, 4, 1, 0]  # large groups go to the training folds first


def assign_group_folds(frame: DataFrame, group: str = "group", seed: int = 42) -> DataFrame:
    """(group, fold): whole groups dealt to five folds, balanced by label and group size.

    A stratum is (majority label, size class). Groups are ranked inside a stratum by a seeded hash
    and dealt in turn; the turn carries on from one stratum to the next, largest sizes first.
    """
    groups = frame.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("label").cast("long")).alias("_pos")
    ).select(
        group,
        (F.col("_pos") * 2 > F.col("_n")).cast("int").alias("_major"),
        F.floor(F.log2(F.col("_n").cast("double"))).cast("int").alias("_size"),
        seeded_hash(seed, F.col(group)).alias("_h"),
    )
    ranked = ranked_positions(groups, "_h", group, ["_major", "_size"])
    # A few dozen strata: two labels times the binary order of group sizes.
    strata = groups.groupBy("_major", "_size").agg(F.count(F.lit(1)).alias("_groups"))
    order = Window.partitionBy(F.lit(0)).orderBy("_major", F.col("_size").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = strata.select(
        "_major", "_size", F.coalesce(F.sum("_groups").over(order), F.lit(0)).alias("_offset")
    )
    turn = F.pmod(F.col("rank") - 1 + F.col("_offset"), F.lit(5)).cast("int")
    return ranked.join(F.broadcast(offsets), ["_major", "_size"]).select(
        group, F.get(F.array(*[F.lit(f) for f in DEAL_ORDER]), turn).alias("fold")
    )


def fold_split(fold: Column) -> Column:
    return F.when(fold == 0, "test").when(fold == 1, "validation").otherwise("train")


def grouped_split(frame: DataFrame, group: str = "group", seed: int = 42) -> DataFrame:
    """Adds ``fold`` and ``split``; a group never spans two splits. A row without a group fails."""
    frame = frame.withColumn(group, never_null(group))
    folds = assign_group_folds(frame, group, seed)
    return skewed_lookup(frame, folds, group).withColumn("split", fold_split(F.col("fold")))


def official_split(frame: DataFrame) -> DataFrame:
    """Use the given split column; any other value fails the job."""
    bad = frame.where(F.col("split").isNull() | ~F.col("split").isin(SPLITS))
    names = bad.select(F.coalesce("split", F.lit("<NA>")).alias("split")).distinct()
    unknown = [r["split"] for r in names.orderBy("split").limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown split values: {unknown}")
    return frame


def oof_folds(frame: DataFrame, id_column: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """Stratified row folds: rank by seeded hash within the label, modulo the fold count."""
    hashed = frame.withColumn("_h", seeded_hash(seed, F.col(id_column)))
    ranked = ranked_positions(hashed, "_h", id_column, ["label"])
    return ranked.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int")).drop("_h", "rank")


def split_summary(frame: DataFrame, group: str = "group") -> DataFrame:
    """Rows, class counts, distinct groups and id manifest per split."""
    pairs = frame.groupBy("split", group).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 0).alias("benign"),
        F.count_if(F.col("label") == 1).alias("phishing"),
    )
    counts = pairs.groupBy("split").agg(
        F.sum("rows").alias("rows"), F.sum("benign").alias("benign"),
        F.sum("phishing").alias("phishing"), F.count(F.lit(1)).alias("groups"),
    )
    return counts.join(manifest_hash(frame, "sample_id", ["split"]), "split")


def split_overlap(frame: DataFrame, group: str = "group") -> DataFrame:
    """(kind, pair, shared, disjoint): ids and groups found in two splits."""
    parts = []
    for kind, column in (("sample_id", "sample_id"), ("group", group)):
        flags = frame.groupBy(column).agg(
            *[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS]
        )
        sums = flags.agg(
            *[
                F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}")
                for a, b in combinations(SPLITS, 2)
            ]
        )
        parts.append(
            sums.unpivot([], sums.columns, "pair", "shared").select(
                F.lit(kind).alias("kind"), "pair", "shared", (F.col("shared") == 0).alias("disjoint")
            )
        )
    return parts[0].unionByName(parts[1])


def check_split(frame: DataFrame, group: str = "group") -> None:
    """Raises unless every split holds both classes and no id or group is shared."""
    classes = {
        r["split"]: r["n"]
        for r in frame.groupBy("split").agg(F.countDistinct("label").alias("n")).collect()
    }
    for name in SPLITS:
        if classes.get(name) != 2:
            raise ValueError(f"{name} split does not contain both classes")
    shared = split_overlap(frame, group).where(~F.col("disjoint")).collect()
    if shared:
        raise ValueError("overlap: " + ", ".join(f"{r['kind']} {r['pair']}" for r in shared))
