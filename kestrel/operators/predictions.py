"""One prediction per id (J5), for every operator that joins predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_predictions(pred: DataFrame, id_col: str = "review_id", order_col: str | None = None) -> DataFrame:
    """The last prediction of every id, all columns kept.

    ``order_col`` says which is last (a row number, a round); a table has no order of its own, so without it
    the most confident one counts, then the greatest label.
    """
    last = [F.col(order_col)] if order_col else []
    key = F.struct(*last, "confidence", "predicted_label")
    row = F.max_by(F.struct(*[c for c in pred.columns if c != id_col]), key)
    return pred.groupBy(id_col).agg(row.alias("_p")).select(id_col, "_p.*")
