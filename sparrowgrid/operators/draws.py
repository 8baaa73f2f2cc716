"""Seeded correlated draws: normal scores of many sites at many times whose correlations are given by pairs of sites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import kernel


def normal(seed: int, *keys: str | Column) -> Column:
    """A standard normal number for each value of the keys, the same in every run and on every partition: two hashes to
    uniform numbers, and those to a normal one by the formula of Box and Muller."""
    uniform = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), *keys), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * np.pi * uniform(2))


def factor(pairs: DataFrame) -> DataFrame:
    """Correlations (a, b, r, one row a pair of different sites) -> a, i, row: the sites in order, each with its row of a
    triangular factor of the matrix. Pairs without a row are uncorrelated. Where the correlations contradict one another
    (no such matrix exists), negative eigenvalues are set to 0 and the diagonal is brought back to 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sites = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {s: i for i, s in enumerate(sites)}
        m = np.eye(len(sites))
        i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
        m[i, j] = m[j, i] = pdf["r"].to_numpy(float)
        np.fill_diagonal(m, 1.0)
        try:
            low = np.linalg.cholesky(m)
        except np.linalg.LinAlgError:
            values, v = np.linalg.eigh(m)
            half = v * np.sqrt(np.maximum(values, 0))
            half /= np.linalg.norm(half, axis=1)[:, None]
            low = np.linalg.qr(half.T, mode="r").T
        return pd.DataFrame({"a": sites, "i": np.arange(len(sites)), "row": list(low)})

    return kernel(pairs.select("a", "b", "r"), run, "a long, i long, row array<double>")


def correlated(pairs: DataFrame, times: DataFrame, time: str, seed: int = 0) -> DataFrame:
    """time, site, z: standard normal numbers, independent between times, correlated as `pairs` says within one.

    Each row of `times` (distinct values) gets its independent numbers from hashes of the time and the site; blocks of rows
    are multiplied with the factor, whose size is that of the pairs and not of the series."""
    rows = sorted(factor(pairs).collect(), key=lambda r: r["i"])  # a row a site
    sites = [r["a"] for r in rows]
    low = np.array([r["row"] for r in rows], float).reshape(len(rows), len(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                b = whole.slice(k, step)
                n = b.column("n").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(sites))
                z = n @ low.T
                at = pa.array(np.repeat(np.arange(b.num_rows), len(sites)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(sites * b.num_rows, pa.int64()), pa.array(z.ravel())], [time, "site", "z"])

    step = max(1, 200_000 // max(1, len(sites)))
    kind = times.schema[time].dataType.simpleString()
    every = F.array(*[F.lit(s).cast("long") for s in sites]).cast("array<long>")
    d = times.select(time).distinct().withColumn("__sites", every)
    d = d.select(time, F.transform("__sites", lambda s: normal(seed, F.col(time), s)).alias("n"))
    return d.mapInArrow(run, f"`{time}` {kind}, site long, z double")
