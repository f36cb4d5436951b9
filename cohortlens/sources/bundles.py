"""Saved models: a versioned bundle of fitted K-means, mixtures, PCA and result tables.

Every part is a Parquet folder; the manifest, a one-row JSON file, is written
*last*. It names the format version, each part's kind and schema and row count, and the measures
of each model. A bundle without a manifest (a writer that died), of another
version, or with a part that is missing or has another row count, is refused.
A bundle is never written over: its folder must be new.

Loaded models label new rows as the fitted ones did.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import kmeans as km
from cohortlens.operators import mixture as mx
from cohortlens.schema import ID
from cohortlens.session import _file_system

VERSION = 1
MANIFEST = "manifest.json"


class BundleError(ValueError):
    """The bundle is half written, damaged or of another version."""


@dataclass
class KMeansModel:
    cols: list[str]
    centres: np.ndarray

    def label(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        return km.assign(df, self.cols, self.centres, out)


@dataclass
class MixtureModel:
    cols: list[str]
    fit: mx.Fit

    def label(self, df: DataFrame, key: str = ID) -> DataFrame:
        return mx.classify(df, self.cols, self.fit, key)


@dataclass
class PCAModel:
    """Moments and rotation of a principal-component fit."""

    cols: list[str]
    means: np.ndarray
    sds: np.ndarray
    eigenvalues: np.ndarray
    rotation: np.ndarray

    @classmethod
    def of(cls, fit) -> PCAModel:
        return cls(list(fit.cols), np.array([fit.moments[c][0] for c in fit.cols]), np.array([fit.moments[c][1] for c in fit.cols]),
                   fit.eigenvalues, fit.rotation)

    def score_columns(self, n_components: int | None = None) -> list[Column]:
        z = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.cols, self.means, self.sds)]
        out = []
        for k in range(n_components or len(self.cols)):
            terms = [x * F.lit(float(v)) for x, v in zip(z, self.rotation[:, k])]
            out.append(sum(terms[1:], terms[0]).alias(f"PC{k + 1}"))
        return out

    def scores(self, df: DataFrame, keep: Sequence[str] = (ID,), n_components: int | None = None) -> DataFrame:
        return df.select(*keep, *self.score_columns(n_components))


@dataclass
class Bundle:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    models: dict[str, object] = field(default_factory=dict)


def _model_table(spark: SparkSession, model) -> tuple[str, DataFrame, dict]:
    """(kind, its numbers as a table of a row per cluster or measure, what the manifest says)."""
    if isinstance(model, KMeansModel):
        rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.centres)]
        return "kmeans", spark.createDataFrame(rows, "i int, centre array<double>"), {"cols": model.cols}
    if isinstance(model, MixtureModel):
        f = model.fit
        if f.failed or f.sigma is None:
            raise BundleError(f"{f.model} with G={f.g} did not fit; there is nothing to save")
        rows = [(i, float(f.pi[i]), [float(v) for v in f.mu[i]], [float(v) for v in f.sigma[i].ravel()]) for i in range(f.g)]
        said = {"cols": model.cols, "model": f.model, "g": f.g, "loglik": f.loglik, "n": f.n, "iterations": f.iterations,
                "converged": f.converged}
        return "mixture", spark.createDataFrame(rows, "i int, weight double, mean array<double>, covariance array<double>"), said
    if isinstance(model, PCAModel):
        rows = [(i, float(model.means[i]), float(model.sds[i]), float(model.eigenvalues[i]), [float(v) for v in model.rotation[i]])
                for i in range(len(model.cols))]
        return "pca", spark.createDataFrame(rows, "i int, mean double, sd double, eigenvalue double, loadings array<double>"), {
            "cols": model.cols}
    raise TypeError(f"no bundle form for {type(model).__name__}")


def _model_of(said: dict, table: DataFrame):
    rows = table.orderBy("i").collect()                  # a row per cluster or measure
    if said["kind"] == "kmeans":
        return KMeansModel(said["cols"], np.array([r["centre"] for r in rows]))
    if said["kind"] == "mixture":
        d = len(said["cols"])
        return MixtureModel(said["cols"], mx.Fit(
            said["model"], said["g"], pi=np.array([r["weight"] for r in rows]), mu=np.array([r["mean"] for r in rows]),
            sigma=np.array([r["covariance"] for r in rows]).reshape(-1, d, d), loglik=said["loglik"], n=said["n"],
            iterations=said["iterations"], converged=said["converged"]))
    return PCAModel(said["cols"], *(np.array([r[c] for r in rows]) for c in ("mean", "sd", "eigenvalue", "loadings")))


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame] | None = None, models: dict[str, object] | None = None) -> str:
    """Write a bundle to the new folder ``path``; the manifest comes last."""
    place, fs = _file_system(spark, path)
    if fs.exists(place):
        raise BundleError(f"{path} exists: a bundle is never written over")
    parts: dict[str, dict] = {}
    for name, df in (tables or {}).items():
        parts[name] = {"kind": "table"}
        df.write.parquet(f"{path}/{name}")
    for name, model in (models or {}).items():
        if name in parts:
            raise BundleError(f"two parts named {name}")
        kind, table, said = _model_table(spark, model)
        parts[name] = {"kind": kind} | said
        table.coalesce(1).write.parquet(f"{path}/{name}")
    for name, said in parts.items():
        back = spark.read.parquet(f"{path}/{name}")
        said |= {"rows": back.count(), "schema": back.schema.simpleString()}
    spark.createDataFrame([(json.dumps({"version": VERSION, "parts": parts}),)], "value string").coalesce(1).write.text(
        f"{path}/{MANIFEST}")
    return path


def manifest(spark: SparkSession, path: str) -> dict:
    place, fs = _file_system(spark, f"{path}/{MANIFEST}/_SUCCESS")
    if not fs.exists(place):
        raise BundleError(f"{path} has no finished manifest")
    said = json.loads(spark.read.text(f"{path}/{MANIFEST}").first()[0])
    if said.get("version") != VERSION:
        raise BundleError(f"{path} is of version {said.get('version')}, not {VERSION}")
    return said


def load(spark: SparkSession, path: str) -> Bundle:
    """The tables and models of a whole bundle."""
    out = Bundle()
    for name, said in manifest(spark, path)["parts"].items():
        place, fs = _file_system(spark, f"{path}/{name}")
        if not fs.exists(place):
            raise BundleError(f"{path} lacks {name}")
        df = spark.read.parquet(f"{path}/{name}")
        if df.schema.simpleString() != said["schema"] or df.count() != said["rows"]:
            raise BundleError(f"{name} of {path} is not what the manifest names")
        if said["kind"] == "table":
            out.tables[name] = df
        else:
            out.models[name] = _model_of(said, df)
    return out
