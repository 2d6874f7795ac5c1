"""Trees of several depths from one fit.

A tree learner goes down level by level, and how a node is split does not depend on how far
the tree goes on below it. So the model of a smaller ``maxDepth`` is the upper part of a
deeper one, its nodes there turned into leaves, and a grid over depths needs one fit for all
of them."""

from __future__ import annotations

import threading
from collections import defaultdict, deque
from collections.abc import Sequence
from concurrent.futures import Future
from math import ceil

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.session import discard, forget, fresh_path, stored

BIN_BYTES = 32  # four numbers for every bin of a node's feature
_ONE_SAVE = threading.Lock()  # the driver holds the rows of one saved model at a time


def _numbered(depths: Sequence[int]):
    """For one tree's nodes, in the order in which they are numbered, a part before what is
    below it: the nodes kept for each depth and their new numbers and children."""

    def number(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("id")
        left, right = nodes["leftChild"].to_numpy(), nodes["rightChild"].to_numpy()
        level, at, below = np.zeros(len(nodes), "int32"), np.array([0]), 0
        while len(at):
            level[at], below = below, below + 1
            inner = at[left[at] >= 0]
            at = np.concatenate([left[inner], right[inner]])
        parts = []
        for depth in depths:
            kept = level <= depth
            place = (np.cumsum(kept) - 1).astype("int32")
            inner = (level < depth) & (left >= 0)
            part = pd.DataFrame({
                "treeID": nodes["treeID"].to_numpy(), "id": nodes["id"].to_numpy(), "depth": depth, "place": place,
                "left": np.where(inner, place[left], -1), "right": np.where(inner, place[right], -1)})
            parts.append(part[kept])
        return pd.concat(parts)

    return number


def upper_parts(model: Model, df: DataFrame, depths: Sequence[int]) -> dict[int, Model]:
    """The fitted tree or forest cut off at each of ``depths``; the saved model's table of
    nodes is cut and read back. ``df`` gives the session."""
    if not depths:
        return {}
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "model")
    with _ONE_SAVE:
        model.write().session(spark).overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    is_forest = "nodeData" in saved.columns
    if not is_forest:
        saved = saved.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    links = saved.select("treeID", *[f"nodeData.{c}" for c in ("id", "leftChild", "rightChild")])
    numbers = links.groupBy("treeID").applyInPandas(
        _numbered(depths), "treeID int, id int, depth int, place int, left int, right int")
    new = {"id": "place", "leftChild": "left", "rightChild": "right"}
    node = F.struct(*[F.col(new.get(c, f"nodeData.{c}")).alias(c) for c in saved.schema["nodeData"].dataType.names])
    nodes = saved.withColumn("id", F.col("nodeData.id")).join(numbers, ["treeID", "id"])
    kept = stored(nodes.select("treeID", "depth", node.alias("nodeData")), "nodes")
    found = {}
    for depth in depths:
        part = kept.where(F.col("depth") == depth).select(*(("treeID", "nodeData") if is_forest else ("nodeData.*",)))
        part.coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
        cut = type(model).read().session(spark).load(path)
        found[depth] = cut.copy({cut.getParam("maxDepth"): depth})
    forget(kept)
    discard(spark, path)
    return found


class _Models:
    """(index, model) of every parameter map, for several threads: first the deepest of each
    group, which is fitted, then those that are parts of it."""

    def __init__(self, groups: Sequence[Sequence[int]], fit):
        self.lock, self.fit = threading.Lock(), fit
        self.found = {i: Future() for group in groups for i in group}
        self.left = deque([(g[0], g) for g in groups] + [(i, None) for g in groups for i in g[1:]])

    def __iter__(self):
        return self

    def __next__(self) -> tuple[int, Model]:
        with self.lock:
            if not self.left:
                raise StopIteration
            index, group = self.left.popleft()
        if group:
            try:
                models = self.fit(group)
            except BaseException as error:  # those that wait for a part get it as well
                for i in group:
                    self.found[i].set_exception(error)
            else:
                for i in group:
                    self.found[i].set_result(models[i])
        model = self.found[index].result()
        del self.found[index]
        return index, model


class DepthsInOneFit:
    """For a tree learner: parameter maps that differ in nothing but ``maxDepth`` are fitted
    once, at the largest of their depths."""

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]) -> _Models:  # Spark's names
        depth = [m.get(self.maxDepth, self.getMaxDepth()) for m in paramMaps]
        alike = defaultdict(list)
        for i, m in enumerate(paramMaps):
            others = sorted((p.name, v) for p, v in m.items() if p.name != "maxDepth")
            nested = self.copy(m)._same_above(dataset, depth[i])
            alike[str(others)].append((i, nested))
        groups = []
        for members in alike.values():
            deepest = max((i for i, _ in members), key=lambda i: depth[i])
            groups.append([deepest, *(i for i, nested in members if nested and i != deepest)])
            groups += [[i] for i, nested in members if not nested and i != deepest]

        def fit(group: Sequence[int]) -> dict[int, Model]:
            model, top = self.fit(dataset, paramMaps[group[0]]), depth[group[0]]
            parts = upper_parts(model, dataset, sorted({depth[i] for i in group} - {top}))
            return {i: parts.get(depth[i], model) for i in group}

        return _Models(groups[::-1], fit)  # grids mostly rise, so what takes longest begins

    def _same_above(self, dataset: DataFrame, depth: int) -> bool:
        """Whether a deeper fit has the same nodes down to ``depth``. A forest draws the features
        of each node in the order in which nodes come up. That is level by level, in any depth,
        as long as the bins of a level fit the learner's memory for one pass."""
        trees = self.getNumTrees() if self.hasParam("numTrees") else 1
        strategy = self.getFeatureSubsetStrategy() if trees > 1 else "all"
        if strategy == "all":
            return True
        field = dataset.schema[self.getFeaturesCol()]
        attributes = field.metadata.get("ml_attr", {})
        size, flags = attributes.get("num_attrs"), len(attributes.get("attrs", {}).get("binary", ()))
        if not size:
            return False
        drawn = ceil(size / 3) if strategy in ("auto", "onethird") else size
        wide = min(drawn, size - flags)
        bins = wide * self.getMaxBins() + (drawn - wide) * 2
        return trees * 2 ** (depth - 1) * bins * BIN_BYTES <= self.getMaxMemoryInMB() * 2**20


class TreeRegressor(DepthsInOneFit, DecisionTreeRegressor):
    pass


class ForestRegressor(DepthsInOneFit, RandomForestRegressor):
    pass
