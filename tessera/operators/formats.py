"""Dataset types of preference and instruction tuning, and the conversions between them.

Columns are text, or message arrays array<struct<role, content>>; both forms pass through every conversion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Columns by which a type is told, the more particular first.
TYPES = [
    ("stepwise", {"prompt", "completions", "labels"}),
    ("unpaired_preference", {"prompt", "completion", "label"}),
    ("preference", {"prompt", "chosen", "rejected"}),
    ("implicit_preference", {"chosen", "rejected"}),
    ("prompt_completion", {"prompt", "completion"}),
    ("tokenized", {"input_ids"}),
    ("language_modeling", {"messages"}),
    ("language_modeling", {"text"}),
    ("prompt_only", {"prompt"}),
]
#: The type that each kind of trainer takes.
TRAINERS = {
    "bco": "unpaired_preference",
    "cpo": "preference",
    "dpo": "preference",
    "gkd": "prompt_completion",
    "grpo": "prompt_only",
    "iterative_sft": "unpaired_preference",
    "kto": "unpaired_preference",
    "nash_md": "prompt_only",
    "online_dpo": "prompt_only",
    "orpo": "preference",
    "ppo": "tokenized",
    "prm": "stepwise",
    "reward": "implicit_preference",
    "sft": "language_modeling",
    "xpo": "prompt_only",
}


def detect_type(columns: list[str]) -> str | None:
    return next((name for name, wanted in TYPES if wanted <= set(columns)), None)


def _is_list(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, ArrayType)


def _joined(df: DataFrame, a: str, b: str) -> Column:
    return F.concat(a, b)


def _text_name(df: DataFrame, column: str) -> str:
    return "messages" if _is_list(df, column) else "text"


def prompt_completion_to_lm(df: DataFrame) -> DataFrame:
    return df.withColumn(_text_name(df, "prompt"), _joined(df, "prompt", "completion")).drop("prompt", "completion")


def prompt_completion_to_prompt_only(df: DataFrame) -> DataFrame:
    return df.drop("completion")


def common_prefix(a: Column, b: Column, is_list: bool) -> Column:
    """How many characters or messages both begin with."""
    n = F.least(F.size(a), F.size(b)) if is_list else F.least(F.length(a), F.length(b))
    if is_list:
        pairs = F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1))
        first = F.array_position(F.transform(pairs, lambda d: F.coalesce(d, F.lit(1))), F.lit(1))
        return F.when(first > 0, first - 1).otherwise(n).cast("int")
    # halves of what is left: an unequal prefix stays unequal when it grows
    state = F.struct(F.lit(0).alias("low"), n.alias("high"))

    def step(s: Column, _: Column) -> Column:
        mid = F.ceil((s["low"] + s["high"]) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(F.greatest(s["low"], mid - 1)).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), state, step)["low"]


def implicit_to_preference(df: DataFrame) -> DataFrame:
    """The longest common beginning of both answers is the prompt."""
    is_list = _is_list(df, "chosen")
    marked = df.withColumn("__n", common_prefix(F.col("chosen"), F.col("rejected"), is_list))
    if is_list:
        head = F.slice("chosen", F.lit(1), F.col("__n"))
        tail = lambda c: F.slice(c, F.col("__n") + 1, F.greatest(F.size(c), F.lit(1)))
    else:
        head = F.substring("chosen", F.lit(1), F.col("__n"))
        tail = lambda c: F.substring(c, F.col("__n") + 1, F.length(c))
    return marked.withColumns({"prompt": head, "chosen": tail("chosen"), "rejected": tail("rejected")}).drop("__n")


def implicit_to_lm(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("chosen", _text_name(df, "chosen")).drop("rejected")


def implicit_to_prompt_completion(df: DataFrame) -> DataFrame:
    return preference_to_prompt_completion(implicit_to_preference(df))


def implicit_to_prompt_only(df: DataFrame) -> DataFrame:
    return implicit_to_preference(df).drop("chosen", "rejected")


def implicit_to_unpaired(df: DataFrame) -> DataFrame:
    return preference_to_unpaired(implicit_to_preference(df))


def preference_to_implicit(df: DataFrame) -> DataFrame:
    return df.withColumns({"chosen": _joined(df, "prompt", "chosen"), "rejected": _joined(df, "prompt", "rejected")}).drop("prompt")


def preference_to_lm(df: DataFrame) -> DataFrame:
    return df.withColumn(_text_name(df, "prompt"), _joined(df, "prompt", "chosen")).drop("prompt", "chosen", "rejected")


def preference_to_prompt_completion(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("chosen", "completion").drop("rejected")


def preference_to_prompt_only(df: DataFrame) -> DataFrame:
    return df.drop("chosen", "rejected")


def preference_to_unpaired(df: DataFrame) -> DataFrame:
    """Two rows of each: the chosen answer labelled true, the rejected one false."""
    both = F.array(F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")), F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")))
    rest = [c for c in df.columns if c not in ("chosen", "rejected")]
    return df.select(*rest, F.explode(both).alias("__u")).select(*rest, "__u.completion", "__u.label")


def unpaired_to_lm(df: DataFrame) -> DataFrame:
    return prompt_completion_to_lm(df.where("label").drop("label"))


def unpaired_to_prompt_completion(df: DataFrame) -> DataFrame:
    return df.where("label").drop("label")


def unpaired_to_prompt_only(df: DataFrame) -> DataFrame:
    return df.drop("completion", "label")


def _all_right() -> Column:
    """No step is wrong; true without steps."""
    return F.forall("labels", lambda x: x)


def stepwise_to_lm(df: DataFrame) -> DataFrame:
    return df.where(_all_right()).withColumn("text", F.concat("prompt", F.array_join("completions", ""))).drop("prompt", "completions", "labels")


def stepwise_to_prompt_completion(df: DataFrame) -> DataFrame:
    return df.where(_all_right()).withColumn("completion", F.array_join("completions", "")).drop("completions", "labels")


def stepwise_to_prompt_only(df: DataFrame) -> DataFrame:
    return df.drop("completions", "labels")


def stepwise_to_unpaired(df: DataFrame) -> DataFrame:
    """One row each; labelled true if every step is right."""
    return df.withColumns({"completion": F.array_join("completions", ""), "label": _all_right()}).drop("completions", "labels")


CONVERSIONS = {f.__name__: f for f in (prompt_completion_to_lm, prompt_completion_to_prompt_only, implicit_to_lm, implicit_to_prompt_completion, implicit_to_prompt_only, implicit_to_preference, implicit_to_unpaired, preference_to_lm, preference_to_prompt_completion, preference_to_prompt_only, preference_to_implicit, preference_to_unpaired, unpaired_to_lm, unpaired_to_prompt_completion, unpaired_to_prompt_only, stepwise_to_lm, stepwise_to_prompt_completion, stepwise_to_prompt_only, stepwise_to_unpaired)}
