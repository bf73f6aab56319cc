"""Which of many short names occur inside which of many texts, without comparing all pairs.

Texts are exploded to their substrings of just the lengths that names have, and joined with
the names by equality. A prefix match is the case where the substring stands at the start.
The substrings are many times the texts, which a plan made from the texts' size cannot know:
the side to broadcast is named here. It is the names, or none where they are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 200_000      # names up to which they are broadcast


def containment(names: DataFrame, texts: DataFrame, name_col: str = "name", text_col: str = "text") -> DataFrame:
    """Columns of ``texts`` and of ``names`` for every text that contains the name, with ``prefix``:
    whether it starts with it. Every text is matched with a name once, however often it occurs.
    NULLs match nothing; the empty name is contained in every text."""
    names = names.filter(F.col(name_col).isNotNull())
    per = names.groupBy(F.length(name_col)).agg(F.count(F.lit(1))).collect()      # a row per length
    lengths, many = sorted(r[0] for r in per), sum(r[1] for r in per) > SMALL
    t, n = F.col(text_col), F.length(text_col)
    grams = F.flatten(F.transform(F.array(*[F.lit(k) for k in lengths]).cast("array<int>"), lambda k: F.when(
        n >= k, F.transform(F.sequence(F.lit(1), F.when(k == 0, F.lit(1)).otherwise(n - k + 1)), lambda i: F.substring(t, i, k)))
        .otherwise(F.array().cast("array<string>"))))
    each = texts.filter(t.isNotNull()).withColumn("_gram", F.explode(F.array_distinct(grams)))
    return (each.join(names.hint("merge") if many else F.broadcast(names), F.col("_gram") == F.col(name_col))
            .withColumn("prefix", t.startswith(F.col(name_col))).drop("_gram"))
