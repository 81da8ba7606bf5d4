"""Prediction expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kuchikomi.domain import LABELS


def predicted_class(logits: Column) -> Column:
    """Index of the largest class logit, the first on ties; entries beyond the classes are ignored."""
    classes = F.slice(logits, 1, len(LABELS))
    return (F.array_position(classes, F.array_max(classes)) - 1).cast("int")
