"""Words and chunks of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: str) -> Column:
    return F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")


def word_count(text: str) -> Column:
    """Null text: 0."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("int")


def chunks(text: str, size: int) -> Column:
    """The words in runs of at most ``size``, each joined by single spaces; no words: no chunks."""

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(size)))
        return F.transform(starts, lambda a: F.array_join(F.slice(w, a, F.lit(size)), " "))

    # the words are bound to a variable, as an expression would be worked out again for each chunk
    bound = F.element_at(F.transform(F.array(words(text)), cut), 1)
    return F.coalesce(bound, F.array().cast("array<string>"))
