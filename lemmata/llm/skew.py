"""A join whose hot keys are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm.storage import fresh

#: A key is hot if it has more than one of so many rows (so there are fewer hot keys than that); keys over which a hot one is spread.
HOT, SALTS = 4096, 64


def hot_join(rows: DataFrame, answers: DataFrame, key: str, count: str, by: str) -> DataFrame:
    """rows joined to the one answer per key, where ``count`` holds the key's number of rows; rows of hot keys are dealt out by a hash of ``by``.

    The hot keys are fewer than ``HOT``, as their counts add up to at most the total, so they are broadcast.
    """
    salt, is_hot = fresh(rows.join(answers, key), "salt", "hot")
    total = answers.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(answers.filter(F.col(count) * HOT > total).select(key, F.lit(True).alias(is_hot)))
    spread = rows.join(hot, key, "left").withColumn(salt, F.when(F.col(is_hot), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop(is_hot)
    salts = F.when(F.col(count) * HOT > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return spread.join(answers.withColumn(salt, F.explode(salts)), [key, salt]).drop(salt)
