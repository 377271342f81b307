"""Feature vectors of many objects: a spec names its features, ``transform`` fills them.

A source is a dict of tables that carry an object id: ``bars`` (``id, birth, death, mult``) and ``measure`` (``id, i, j,
w``). Results are long (``id, feature, value``, zeros left out); ``wide`` has one column for each name and one row for
each object. Grids and counts are parameters of a spec, so a row meets a bounded number of features.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import kernel
from . import bars as B

Source = dict[str, DataFrame]


def _grid(name: str, values: tuple[float, ...]) -> Column:
    """Explodes a parameter grid as ``name`` (position from 1) and its value."""
    return F.explode(F.array(*(F.struct(F.lit(k).alias("at"), F.lit(float(v)).alias("v")) for k, v in enumerate(values, 1)))).alias(name)


def _bars(source: Source) -> DataFrame:
    return source["bars"].withColumnRenamed("id", "slice")


def _long(df: DataFrame, name: Column, value: Column, id_: str = "id") -> DataFrame:
    return df.select(F.col(id_).alias("id"), name.alias("feature"), value.cast("double").alias("value"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


class Spec:
    """What a feature vector holds. ``names`` are in order; ``axes`` say what they range over."""

    def names(self) -> list[str]:
        raise NotImplementedError

    def axes(self) -> dict:
        return {k: v for k, v in asdict(self).items() if isinstance(v, (list, tuple))}

    def rows(self, source: Source) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class Landscape(Spec):
    ts: tuple[float, ...]
    kmax: int = 3

    def names(self):
        return [f"landscape__k{k}_t{t}" for k in range(1, self.kmax + 1) for t in range(1, len(self.ts) + 1)]

    def rows(self, source):
        found = B.landscape(_bars(source), self.ts, self.kmax)
        at = F.array_position(F.array(*(F.lit(float(t)) for t in self.ts)), F.col("t"))
        return _long(found, _text("landscape__k", F.col("k"), "_t", at), F.col("value"), "slice")


@dataclass(frozen=True)
class PersistenceImage(Spec):
    xs: tuple[float, ...]
    ys: tuple[float, ...]
    sigma: float = 1.0
    p: float = 1.0

    def names(self):
        return [f"persistence_image__x{x}_y{y}" for x in range(1, len(self.xs) + 1) for y in range(1, len(self.ys) + 1)]

    def rows(self, source):
        found = B.image(_bars(source), self.xs, self.ys, self.sigma, self.p)
        at = lambda g, c: F.array_position(F.array(*(F.lit(float(v)) for v in g)), F.col(c))
        return _long(found, _text("persistence_image__x", at(self.xs, "x"), "_y", at(self.ys, "y")), F.col("value"), "slice")


@dataclass(frozen=True)
class BarcodeTopK(Spec):
    k: int = 3

    def names(self):
        return [f"barcode__bar{k}__{c}" for k in range(1, self.k + 1) for c in ("birth", "persistence")]

    def rows(self, source):
        found = B.top_k(_bars(source), self.k).unpivot(["slice", "rank"], ["birth", "persistence"], "c", "value")
        return _long(found, _text("barcode__bar", F.col("rank"), "__", F.col("c")), F.col("value"), "slice")


@dataclass(frozen=True)
class BarcodeSummary(Spec):
    fields: tuple[str, ...] = ("n_bars", "total", "longest", "mean", "l2")

    def names(self):
        return [f"barcode__{f}" for f in self.fields]

    def rows(self, source):
        s = B.summary(_bars(source)).withColumn("n_bars", F.col("n_bars").cast("double"))
        return _long(s.unpivot("slice", list(self.fields), "f", "value"), _text("barcode__", F.col("f")), F.col("value"), "slice")


@dataclass(frozen=True)
class EulerSurface(Spec):
    xs: tuple[float, ...]
    ys: tuple[float, ...]

    def names(self):
        return [f"euler__x{x}_y{y}" for x in range(1, len(self.xs) + 1) for y in range(1, len(self.ys) + 1)]

    def rows(self, source):
        rows = source["measure"].select("*", _grid("x", self.xs)).filter(F.col("i") <= F.col("x.v")).select("*", _grid("y", self.ys)).filter(F.col("j") <= F.col("y.v"))
        sums = rows.groupBy("id", F.col("x.at").alias("x"), F.col("y.at").alias("y")).agg(F.sum("w").alias("s")).filter("s <> 0")
        return _long(sums, _text("euler__x", F.col("x"), "_y", F.col("y")), F.col("s"))


@dataclass(frozen=True)
class RankGrid(Spec):
    ts: tuple[float, ...]

    def names(self):
        return [f"rank__p{p}_q{q}" for p in range(1, len(self.ts) + 1) for q in range(p, len(self.ts) + 1)]

    def rows(self, source):
        rows = source["bars"].select("*", _grid("p", self.ts)).filter(F.col("birth") <= F.col("p.v")).select("*", _grid("q", self.ts)).filter((F.col("p.at") <= F.col("q.at")) & (F.col("q.v") < F.col("death")))
        sums = rows.groupBy("id", F.col("p.at").alias("p"), F.col("q.at").alias("q")).agg(F.sum("mult").alias("s"))
        return _long(sums, _text("rank__p", F.col("p"), "_q", F.col("q")), F.col("s"))


@dataclass(frozen=True)
class RestrictedHilbert(Spec):
    ts: tuple[float, ...]

    def names(self):
        return [f"hilbert__t{t}" for t in range(1, len(self.ts) + 1)]

    def rows(self, source):
        rows = source["bars"].select("*", _grid("t", self.ts)).filter((F.col("birth") <= F.col("t.v")) & (F.col("t.v") < F.col("death")))
        return _long(rows.groupBy("id", F.col("t.at").alias("t")).agg(F.sum("mult").alias("s")), _text("hilbert__t", F.col("t")), F.col("s"))


def _ranked(df: DataFrame, by: list, k: int) -> DataFrame:
    """The first ``k`` rows of each id, numbered. A top-k report."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*by))).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class PointSignedMeasure(Spec):
    k: int = 3
    prefix: str = "point_signed_measure"

    def names(self):
        return [f"{self.prefix}__term{t}__{c}" for t in range(1, self.k + 1) for c in ("i", "j", "w")]

    def rows(self, source):
        terms = source["measure"].groupBy("id", "i", "j").agg(F.sum("w").alias("w")).filter("w <> 0")
        top = _ranked(terms, [F.abs("w").desc(), "i", "j"], self.k)
        long = top.select("id", "rank", *(F.col(c).cast("double").alias(c) for c in ("i", "j", "w"))).unpivot(["id", "rank"], ["i", "j", "w"], "c", "value")
        return _long(long, _text(f"{self.prefix}__term", F.col("rank"), "__", F.col("c")), F.col("value"))


@dataclass(frozen=True)
class EulerSignedMeasure(PointSignedMeasure):
    prefix: str = "euler_signed_measure"


@dataclass(frozen=True)
class RectangleTopK(Spec):
    """The heaviest rectangles of a module of intervals: its bars [birth, death - 1] with their counts."""

    k: int = 3

    def names(self):
        return [f"rectangle__term{t}__{c}" for t in range(1, self.k + 1) for c in ("lo", "hi", "w")]

    def rows(self, source):
        terms = source["bars"].groupBy("id", F.col("birth").alias("lo"), (F.col("death") - 1).alias("hi")).agg(F.sum("mult").alias("w"))
        top = _ranked(terms, [F.abs("w").desc(), "lo", "hi"], self.k)
        long = top.select("id", "rank", *(F.col(c).cast("double").alias(c) for c in ("lo", "hi", "w"))).unpivot(["id", "rank"], ["lo", "hi", "w"], "c", "value")
        return _long(long, _text("rectangle__term", F.col("rank"), "__", F.col("c")), F.col("value"))


@dataclass(frozen=True)
class SignedBarcodeImage(Spec):
    xs: tuple[float, ...]
    ys: tuple[float, ...]
    sigma: float = 1.0

    def names(self):
        return [f"signed_barcode_image__x{x}_y{y}" for x in range(1, len(self.xs) + 1) for y in range(1, len(self.ys) + 1)]

    def rows(self, source):
        once = source["measure"].groupBy("id", "i", "j").agg(F.sum("w").alias("w")).filter("w <> 0")
        rows = once.select("*", _grid("x", self.xs)).select("*", _grid("y", self.ys))
        dx, dy = F.col("i") - F.col("x.v"), F.col("j") - F.col("y.v")
        sums = rows.groupBy("id", F.col("x.at").alias("x"), F.col("y.at").alias("y")).agg(F.sum(F.col("w") * kernel(F.sqrt(dx * dx + dy * dy), "gaussian", self.sigma)).alias("s"))
        return _long(sums, _text("signed_barcode_image__x", F.col("x"), "_y", F.col("y")), F.col("s"))


@dataclass(frozen=True)
class MPLandscape(Spec):
    """Weighted mean of landscapes over the slices of each object. Source: ``slices`` (``id, slice, weight, birth, death, mult``)."""

    ts: tuple[float, ...]
    kmax: int = 3

    def names(self):
        return [f"mp_landscape__k{k}_t{t}" for k in range(1, self.kmax + 1) for t in range(1, len(self.ts) + 1)]

    def rows(self, source):
        rows = source["slices"].withColumn("key", F.struct("id", "slice"))
        weights = rows.select("key", "id", "weight").distinct()
        land = B.landscape(rows.select(F.col("key").alias("slice"), "birth", "death", "mult"), self.ts, self.kmax)
        total = weights.groupBy("id").agg(F.sum("weight").alias("all"))
        at = F.array_position(F.array(*(F.lit(float(t)) for t in self.ts)), F.col("t"))
        sums = land.join(weights.withColumnRenamed("key", "slice"), "slice").groupBy("id", "k", at.alias("t")).agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
        return _long(sums.join(total, "id"), _text("mp_landscape__k", F.col("k"), "_t", F.col("t")), F.col("s") / F.col("all"))


@dataclass(frozen=True)
class DistanceBank(Spec):
    """Distances to reference diagrams. Source: ``references`` (``name, birth, death, mult``), a small table."""

    references: tuple[str, ...]
    kind: str = "bottleneck"

    def names(self):
        return [f"{self.kind}__{r}" for r in self.references]

    def rows(self, source):
        out = None
        ids = source["bars"].select("id").distinct()
        for name in self.references:
            one = source["references"].filter(F.col("name") == name).select("birth", "death", "mult")
            every = ids.withColumnRenamed("id", "slice").join(F.broadcast(one) if one.count() <= 100_000 else one)
            d = B.slice_distances(_bars(source), every, self.kind)
            rows = _long(d, F.lit(f"{self.kind}__{name}"), F.col("distance"), "slice")
            out = rows if out is None else out.unionByName(rows)
        return out


@dataclass(frozen=True)
class Composite(Spec):
    """Several specs side by side; their names must differ."""

    parts: tuple[Spec, ...] = field(default_factory=tuple)

    def names(self):
        found = [n for p in self.parts for n in p.names()]
        if len(set(found)) != len(found):
            raise ValueError("two parts have a feature of the same name")
        return found

    def axes(self):
        return {f"{i}_{type(p).__name__}": p.axes() for i, p in enumerate(self.parts)}

    def rows(self, source):
        out = self.parts[0].rows(source)
        for p in self.parts[1:]:
            out = out.unionByName(p.rows(source))
        return out


def transform(spec: Spec, source: Source) -> DataFrame:
    """``id, feature, value``."""
    return spec.rows(source)


def wide(spec: Spec, long: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``id`` and a column for each name, zeros filled in; ``ids`` adds objects that have no feature at all."""
    names = spec.names()
    out = long.groupBy("id").pivot("feature", names).agg(F.first("value"))
    if ids is not None:
        out = ids.select("id").distinct().join(out, "id", "left")
    return out.fillna(0.0, names)


def featurize(spec: Spec, source: Source, ids: DataFrame | None = None) -> DataFrame:
    return wide(spec, transform(spec, source), ids)


def run_experiment(path: str, specs: dict[str, Spec], source: Source) -> None:
    """Writes every spec's long features and a table of what was run."""
    spark = next(iter(source.values())).sparkSession
    for name, spec in specs.items():
        transform(spec, source).write.mode("overwrite").parquet(f"{path}/features/experiment={name}")
    rows = [(name, type(spec).__name__, len(spec.names()), json.dumps(spec.axes(), default=str)) for name, spec in specs.items()]
    spark.createDataFrame(rows, "experiment string, spec string, n_features int, axes string").write.mode("overwrite").parquet(f"{path}/manifest")


def load_experiment(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(``experiment, spec, n_features, axes``; ``experiment, id, feature, value``)."""
    return spark.read.parquet(f"{path}/manifest"), spark.read.parquet(f"{path}/features")
