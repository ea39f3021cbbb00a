"""Row algebra on token-id arrays: truncation, end ids, label masks, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def first_n(ids: Column, n: int | None) -> Column:
    return ids if n is None else F.slice(ids, 1, n)


def last_n(ids: Column, n: int | None) -> Column:
    return ids if n is None else F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), F.lit(n))


def with_end(ids: Column, end: int) -> Column:
    return F.concat(ids, F.array(F.lit(end)))


def with_start(ids: Column, start: int) -> Column:
    """The start id comes first, unless it does already."""
    return F.when(F.get(ids, F.lit(0)) == start, ids).otherwise(F.concat(F.array(F.lit(start)), ids))


def sft(df: DataFrame, ids: str, most: int, start: int | None = None) -> DataFrame:
    """Adds input_ids unless the table has it: start id once, cut at the end."""
    if "input_ids" in df.columns or "labels" in df.columns:
        return df
    c = F.col(ids) if start is None else with_start(F.col(ids), start)
    return df.withColumn("input_ids", first_n(c, most))


def dpo(df: DataFrame, end: int, prompt_most: int | None = None, completion_most: int | None = None, start: int | None = None, special: bool = False) -> DataFrame:
    """prompt, chosen and rejected ids -> *_input_ids: end ids come before the cut; prompts keep their last ids, answers their first."""
    prompt = F.col("prompt")
    if special:
        prompt = with_end(prompt if start is None else F.concat(F.array(F.lit(start)), prompt), end)
    out = {"prompt_input_ids": last_n(prompt, prompt_most)}
    for side in ("chosen", "rejected"):
        out[f"{side}_input_ids"] = first_n(with_end(F.col(side), end), completion_most)
    return df.withColumns(out)


def stepwise(df: DataFrame, separator: list[int], start: int | None = None, prompt_most: int | None = None, completion_most: int | None = None, most: int | None = None, last_only: bool = False) -> DataFrame:
    """prompt ids, completions (arrays of ids) and labels -> input_ids and labels: a step's label stands on its last id."""
    sep = F.array(*[F.lit(s) for s in separator])
    steps = F.transform("completions", lambda c: F.concat(c, sep))
    given = F.transform("labels", lambda x: x.cast("int"))
    if last_only:
        given = F.transform(given, lambda x, i: F.when(i == F.size("labels") - 1, x).otherwise(IGNORED))
    masks = F.zip_with(steps, given, lambda s, y: F.concat(F.array_repeat(F.lit(IGNORED), F.size(s) - 1), F.array(y)))
    prompt = F.col("prompt") if start is None else F.concat(F.array(F.lit(start)), F.col("prompt"))
    prompt = last_n(prompt, prompt_most)
    ids, labels = first_n(F.flatten(steps), completion_most), first_n(F.flatten(masks), completion_most)
    whole, marked = F.concat(prompt, ids), F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), labels)
    return df.select(*[c for c in df.columns if c not in ("prompt", "completions", "labels")], first_n(whole, most).alias("input_ids"), first_n(marked, most).alias("labels"))


def preference_chain(df: DataFrame, tokenise, template: str = "pipes", end: int = 0, prompt_most: int | None = None, completion_most: int | None = None, start: int | None = None) -> DataFrame:
    """Implicit preferences (chosen, rejected texts) as token ids, by the three maps of odds-ratio and contrastive trainers.

    The common beginning becomes the prompt; the prompt gets the template's turn of a user and the opening of the
    answer, the answers its close; then all are tokenised by `tokenise`, a function of a Column, ended and cut.
    """
    from .chat import TEMPLATES
    from .formats import implicit_to_preference

    t = TEMPLATES[template]
    head, tail = t["open"].replace("{role}", t["roles"]["user"]), t["close"]
    asked = F.concat(F.lit(head), F.col("prompt"), F.lit(tail + t["between"] + t["generate"]))
    texts = {"prompt": asked} | {side: F.concat(F.col(side), F.lit(tail)) for side in ("chosen", "rejected")}
    return dpo(implicit_to_preference(df).withColumns({k: tokenise(c) for k, c in texts.items()}), end, prompt_most, completion_most, start)


def fits(df: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """Pairs of which neither side is longer."""
    return df.where((F.size(a) <= most) & (F.size(b) <= most))


def packed(df: DataFrame, group: str, order: str, ids: str, length: int) -> DataFrame:
    """A group's ids one after the other, cut into pieces of a length: group, piece, input_ids. Groups bound what one task holds."""
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ids).alias("i")))), lambda s: s["i"]))
    whole = df.groupBy(group).agg(joined.alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all"), F.lit(1)), F.lit(length))
    return whole.where(F.size("all") > 0).select(group, F.posexplode(F.transform(starts, lambda s: F.slice("all", s, F.lit(length)))).alias("piece", "input_ids"))


def label_mask(prompt: Column, completion: Column) -> Column:
    """Labels of a prompt and its completion: the prompt is ignored."""
    return F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), completion)


def char_ids(c: Column) -> Column:
    """A stand-in for a tokeniser: lengths of words."""
    return F.transform(F.filter(F.split(c, "\\s+"), lambda w: w != ""), lambda w: F.length(w))
