"""Features of environment states, prepared for matching and clustering: one vector space for the field, one for the signals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..session import stored
from .models import principal_components


def prepared(features: DataFrame, keys: Sequence[str], field: str, cells: Sequence[str], most: int = 20, parts: int = 4, weight: float = 4.0) -> DataFrame:
    """(keys, meg, lte): the field list filled, smoothed over five, standardised and reduced; each cell's list in three parts, smoothed over three.

    A cell's list holds ``parts`` values before the state, in it and after it;
    those in it weigh ``weight`` times and come first, as the columns of all
    states share one space. Lists have one length; the reduction has ``most``
    components, or as many as there are rows or values.
    """

    @F.pandas_udf("array<double>")
    def meg_of(lists: pd.Series) -> pd.Series:
        return pd.Series([K.row_standard(x) for x in lists])

    @F.pandas_udf("array<double>")
    def smooth(lists: pd.Series) -> pd.Series:
        return pd.Series([K.centred_mean(K.filled(x), 3) for x in lists])

    slices = [smooth(F.concat(*[F.slice(c, at * parts + 1, parts) for c in cells])) for at in (1, 0, 2)]
    lte = F.concat(F.transform(slices[0], lambda x: x * weight), *slices[1:])
    rows = stored(features.select(F.struct(*keys).alias("key"), meg_of(field).alias("v"), lte.alias("lte")), "state-features")
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not shape["n"]:
        return rows.select("key.*", F.col("v").alias("meg"), "lte")
    reduced = principal_components(rows, "key", "v", min(most, shape["n"], shape["d"]))
    return rows.join(reduced, "key").select("key.*", F.col("components").alias("meg"), "lte")


def grouped_components(df: DataFrame, key: str, label: str, vector: str, most: int, block: int = 10_000) -> DataFrame:
    """(key, label, n, components): principal components fitted to the rows of each label by themselves; n is how many they are.

    The rows of a label are dealt into blocks, which leave sums and products of
    columns; axes come from these, oriented by their largest loading. At most
    ``most`` components, or as many as there are rows or columns.
    """
    kind = dict(df.dtypes)[label]
    rows = df.select(key, label, vector).where(F.col(label).isNotNull())
    blocks = rows.groupBy(label).agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks"))
    dealt = rows.join(blocks, label).withColumn("__block", F.pmod(F.xxhash64(key), F.col("__blocks")))

    def sums(t: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(t[vector].to_numpy()).astype(float)
        return pd.DataFrame({label: t[label].iloc[:1], "n": [len(x)], "s": [x.sum(0)], "p": [(x.T @ x).ravel()]})

    def axes(t: pd.DataFrame) -> pd.DataFrame:
        n, s = int(t["n"].sum()), np.sum(t["s"].tolist(), 0)
        p = np.sum(t["p"].tolist(), 0).reshape(len(s), len(s)) - np.outer(s, s) / n
        _, v = np.linalg.eigh((p + p.T) / 2)
        v = v[:, ::-1][:, : min(most, n, len(s))]
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
        return pd.DataFrame({label: t[label].iloc[:1], "n": [n], "mean": [s / n], "axes": [v.ravel()]})

    parts = dealt.groupBy(label, "__block").applyInPandas(sums, f"{label} {kind}, n long, s array<double>, p array<double>")
    fitted = parts.groupBy(label).applyInPandas(axes, f"{label} {kind}, n long, mean array<double>, axes array<double>")

    @F.pandas_udf("array<double>")
    def project(x: pd.Series, mean: pd.Series, axes: pd.Series) -> pd.Series:
        return pd.Series([(np.asarray(a) - m) @ np.reshape(v, (len(m), -1)) for a, m, v in zip(x, mean, axes, strict=True)])

    return rows.join(stored(fitted, "axes"), label).select(key, label, "n", project(vector, "mean", "axes").alias("components"))


def first_places(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Straight distance of ``components`` over as many places as the smaller of two groups has rows (``n``)."""
    out = np.empty((len(left), len(right)))
    width = lambda rows: np.minimum(rows["n"].to_numpy(), [len(x) for x in rows["components"]])
    a, b = width(left), width(right)
    for p in np.unique(a):
        for q in np.unique(b):
            k = min(p, q)
            i, j = np.flatnonzero(a == p), np.flatnonzero(b == q)
            cut = lambda rows, at, k=k: np.array([x[:k] for x in rows["components"].to_numpy()[at]], float)
            out[np.ix_(i, j)] = K.straight(cut(left, i), cut(right, j))
    return out


def grouped_kmeans(df: DataFrame, keys: Sequence[str], value: str, k: int = 8, rounds: int = 25) -> DataFrame:
    """Adds ``state`` and ``centre``: k-means of one number, by itself in each group of ``keys``.

    Centres begin evenly between a group's ends and move to the means of what
    is nearest (the lower one on ties) until none moves or ``rounds`` are over; a centre without values
    stays. A round sums by group and state, so a large group is summed where its
    rows are. Null stays without a state.
    """
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.round(F.col("__a") + (F.col("__b") - F.col("__a")) * (i + 0.5) / k, 9))
    centres = stored(ends.select(*keys, spread.alias("__centres")), "centres")
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")

    def nearest(v: Column, c: Column) -> Column:
        gaps = F.transform(c, lambda x: F.abs(v - x))
        return F.array_position(gaps, F.array_min(gaps)).cast("int") - 1

    for _ in range(rounds):
        told = rows.join(centres, keys).withColumn("__s", nearest(F.col("__v"), F.col("__centres"))).groupBy(*keys, "__s").agg(F.round(F.avg("__v"), 9).alias("__m"))
        means = told.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__s", "__m"))).alias("__means"))
        moved = centres.join(means, keys, "left").withColumn("__new", F.transform("__centres", lambda x, i: F.coalesce(F.try_element_at("__means", i), x)))
        moved = stored(moved.select(*keys, F.col("__new").alias("__centres"), (F.col("__new") != F.col("__centres")).alias("__moved")), "centres")
        centres = moved.drop("__moved")
        if moved.where("__moved").isEmpty():
            break
    v = F.col(value).cast("double")
    out = df.join(centres, keys, "left").withColumn("state", F.when(v.isNotNull(), nearest(v, F.col("__centres"))))
    return out.withColumn("centre", F.get("__centres", "state")).drop("__centres")
