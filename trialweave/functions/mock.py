"""A pretended model and judge: every answer follows from hashes of the request, on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip
from .values import unit_hash

# How wrong numbers differ, what wrong texts are, how a right answer is worded.
OFFSETS = (1, -1, 2, -2, 10, -10)
OTHERS = ("none of the above", "unknown", "not enough information", "42")
WORDED = ("The answer is ", ".")


def _pick(values, salt: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.least(F.floor(salt * len(values)), F.lit(len(values) - 1)).cast("int"))


def wrong_answer(expected: Column, salt: Column) -> Column:
    """A believable wrong answer: a number that is off, a text cut short by a word, or another text."""
    text = strip(expected)
    shifted = text.try_cast("double") + _pick(OFFSETS, salt)
    number = F.when((shifted == F.floor(shifted)) & ~F.contains(text, F.lit(".")), shifted.cast("bigint").cast("string")).otherwise(shifted.cast("string"))
    words = F.split(text, r"(?U)\s+")
    short = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " ")
    return F.when(text == "", "unknown").when(shifted.isNotNull(), number).when((F.size(words) > 2) & (salt < 0.5), short).otherwise(_pick(OTHERS, salt))


def answers(requests: DataFrame, ability: float | Column = 0.6, spread: float = 0.7, verbosity: float = 0.0, error_rate: float = 0.0, seed: int = 0) -> DataFrame:
    """requests (prompt, model, sample_index, role, expected) with ``correct``, ``response_text`` (null where the call fails) and ``failed``.

    An answer is right where a draw falls below ability, less for prompts that hash to more difficulty. Without an
    expected answer the end of the prompt comes back.
    """
    drawn = lambda what: unit_hash(what, F.col("prompt"), F.col("model"), F.col("sample_index"), str(seed), F.col("role"))
    chance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ability if isinstance(ability, Column) else F.lit(ability)) + F.lit(spread) * (F.lit(0.5) - unit_hash("difficulty", F.col("prompt")))))
    known = F.coalesce("expected", F.lit(""))
    failed = drawn("error") < error_rate if error_rate > 0 else F.lit(False)
    rows = requests.withColumns({"failed": failed, "correct": drawn("draw") < chance})
    right = F.when(drawn("verbose") < verbosity, F.concat(F.lit(WORDED[0]), known, F.lit(WORDED[1]))).otherwise(known)
    echo = F.concat(F.lit("[mock:"), F.col("model"), F.lit("] "), F.right(strip(F.col("prompt")), F.lit(120)))
    said = F.when(known == "", echo).when(F.col("correct"), right).otherwise(wrong_answer(known, drawn("wrong")))
    return rows.withColumn("response_text", F.when(~F.col("failed"), said))


def judge_score(criterion: Column, subject: Column, sample: Column, scale: int = 4, noise: float = 0.25, severity: float = 0.0, seed: int = 0) -> Column:
    """A pretended judge's score of a text by a criterion; a share ``noise`` of them moves with the sample."""
    steady, moving = unit_hash("judge", criterion, subject, str(seed)), unit_hash("judge", criterion, subject, sample)
    value = F.when(unit_hash("wobble", criterion, subject) < noise, moving).otherwise(steady)
    return F.least(F.lit(scale), F.greatest(F.lit(0), F.bround(value * scale + F.lit(0.5 - severity), 0).cast("int")))
