"""Feature vectors: assembling, category encoding, slot names, selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    ChiSqSelector, OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions.columns import not_nan
from roadlens.models.vocabulary import ENCODED, INDEX, Vocabulary, fit_vocabulary
from roadlens.operators.projection import impute_median

MAX_CATEGORIES = 100_000  # names that the driver takes


def assembler(
    columns: Sequence[str], output: str = "features", invalid: str = "error"
) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid=invalid)


def assemble_features(df: DataFrame, columns: Sequence[str], output: str = "features"):
    """Vector column; a null in any input fails the job."""
    return assembler(columns, output).transform(df)


def assemble_features_keep(df: DataFrame, columns: Sequence[str], output: str = "features"):
    """Vector column that keeps rows with missing inputs: the vector holds the column's
    median there, as tree learners accept no NaN. The inputs themselves stay as they are."""
    numeric = {"float", "double", "int", "bigint", "smallint"}
    filled = [n for n, t in df.dtypes if t in numeric and n in set(columns)]
    kept = df.withColumn("_inputs", F.struct(*df.columns))
    known = kept.withColumns({c: not_nan(F.col(c).cast("double")) for c in filled})
    inputs = impute_median(known, filled)
    vectors = assembler(columns, output, "keep").transform(inputs)
    return vectors.select("_inputs.*", output)


def indexer(columns: Sequence[str]) -> StringIndexer:
    """Most frequent category first, equals in text order; unseen and null last. All
    columns are counted in one job."""
    return StringIndexer(
        inputCols=list(columns), outputCols=[c + INDEX for c in columns],
        handleInvalid="keep", stringOrderType="frequencyDesc",
    )


def encoder(columns: Sequence[str]) -> OneHotEncoder:
    return OneHotEncoder(
        inputCols=[c + INDEX for c in columns], outputCols=[c + ENCODED for c in columns]
    )


def string_index(df: DataFrame, column: str) -> DataFrame:
    return indexer([column]).fit(df).transform(df)


def one_hot(df: DataFrame, column: str) -> DataFrame:
    return encoder([column]).fit(df).transform(df)


def large_vocabularies(df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES) -> list[str]:
    """The columns with clearly more than ``limit`` categories, by bounded sketches in one pass."""
    counts = df.agg(*[F.approx_count_distinct(F.col(c).cast("string")).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] > 1.2 * limit]


def fit_encoding(
    df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES
) -> PipelineModel | Encoding:
    """Index and one-hot stages of any vocabulary.

    Columns of up to about ``limit`` categories are indexed by Spark ML, with the names of
    the slots in the metadata. Of larger ones the names stay in a table: the indexes are the
    same, but slots are known by number."""
    large = large_vocabularies(df, columns, limit)
    small = [c for c in columns if c not in large]
    stages = Pipeline(stages=[indexer(small), encoder(small)]).fit(df) if small else None
    return Encoding(stages, fit_vocabulary(df, large), tuple(columns)) if large else stages


@dataclass(frozen=True)
class Encoding:
    """Encoded columns, of which some have their names in a table."""

    small: PipelineModel | None
    large: Vocabulary
    columns: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.small.transform(df) if self.small is not None else df
        out = self.large.one_hot(self.large.index(out))
        return out.select(*df.columns, *[c + INDEX for c in self.columns], *[c + ENCODED for c in self.columns])


def slot_names(df: DataFrame, column: str = "features") -> list[str]:
    """Name of every vector slot, from the column's metadata. A slot without an
    attribute is called ``<column>_<position>``."""
    attributes = df.schema[column].metadata.get("ml_attr", {})
    groups = attributes.get("attrs", {})
    found = {a["idx"]: a.get("name") for group in groups.values() for a in group}
    size = attributes.get("num_attrs", len(found))
    return [found.get(i) or f"{column}_{i}" for i in range(size)]


def slot_ranges(df: DataFrame, inputs: Sequence[str]) -> dict[str, range]:
    """Slots of each input column of an assembled vector: one for a number, as many as its
    metadata says for a vector."""
    found, at = {}, 0
    for name in inputs:
        size = 1
        if df.schema[name].dataType.typeName() == "vectorudt":
            attributes = df.schema[name].metadata.get("ml_attr", {})
            groups = attributes.get("attrs", {}).values()
            size = attributes.get("num_attrs", sum(len(g) for g in groups))
            if not size:
                raise ValueError(f"the vector {name} does not say how many slots it has")
        found[name] = range(at, at + size)
        at += size
    return found


def vector_slice(
    df: DataFrame, groups: Sequence[str], inputs: Sequence[str], source: str, output: str
) -> DataFrame:
    """The slots of some input columns as a vector of their own; ``inputs`` are the columns
    that ``source`` was assembled from, in order."""
    ranges = slot_ranges(df, inputs)
    places = [i for g in groups for i in ranges[g]]
    return VectorSlicer(inputCol=source, outputCol=output, indices=places).transform(df)


def chi_square_select(
    df: DataFrame, source: str, label: str, top: int, output: str = "selected"
):
    """Fit a chi-square selector against a categorical label; returns the model and the
    names of the chosen slots."""
    model = ChiSqSelector(
        numTopFeatures=top, featuresCol=source, outputCol=output, labelCol=label
    ).fit(df)
    names = slot_names(df, source)
    return model, [names[i] for i in sorted(model.selectedFeatures)]
