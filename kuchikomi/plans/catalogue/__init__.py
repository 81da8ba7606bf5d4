"""Named queries over the test tables: every operator with, where SQL can say it, its SQL twin."""

from kuchikomi.plans.catalogue import audits, collection, corpus, evaluation, splits, text, trends
from kuchikomi.plans.catalogue.registry import QUERIES

__all__ = ["QUERIES", "audits", "collection", "corpus", "evaluation", "splits", "text", "trends"]
