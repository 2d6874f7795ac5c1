"""Classification report from labelled predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions.columns import safe_ratio


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn and the scores that follow from them, in one aggregate. A score
    whose denominator is zero is null."""
    yes, said = F.col(actual) == 1, F.col(predicted) == 1
    cells = df.agg(
        F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"),
        F.count_if(yes & ~said).alias("fn"), F.count_if(~yes & ~said).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns({
        "precision": safe_ratio(tp, tp + fp),
        "recall": safe_ratio(tp, tp + fn),
        "f1": safe_ratio(tp * 2, tp * 2 + fp + fn),
        "accuracy": safe_ratio(tp + tn, tp + fp + fn + tn),
    })
