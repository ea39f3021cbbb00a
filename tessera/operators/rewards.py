"""Statistics of reward-based training on rows: advantages, baselines, margins, completion metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import sigmoid_loss


def total_reward(rewards: list[str], weights: list[float]) -> Column:
    """Weighted sum; null and NaN count nothing, so a row without any reward has 0."""
    total = F.lit(0.0)
    for name, w in zip(rewards, weights, strict=True):
        total = total + F.coalesce(F.nanvl(F.col(name), F.lit(None).cast("double")) * w, F.lit(0.0))
    return total


def group_advantage(df: DataFrame, group: str, reward: str = "reward", scale: bool = True, epsilon: float = 1e-4) -> DataFrame:
    """Adds advantage: reward less its group's mean, over the group's sample deviation plus epsilon; 0 in a group of one."""
    w = Window.partitionBy(group)
    centred = F.col(reward) - F.avg(reward).over(w)
    out = centred / (F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0)) + epsilon) if scale else centred
    return df.withColumn("advantage", out)


def leave_one_out(df: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """Adds baseline, the mean of the group's other rewards (null in a group of one), and advantage."""
    w = Window.partitionBy(group)
    others = F.count(F.lit(1)).over(w) - 1
    base = F.when(others > 0, (F.sum(reward).over(w) - F.col(reward)) / F.greatest(others, F.lit(1)))
    return df.withColumn("baseline", base).withColumn("advantage", F.col(reward) - F.col("baseline"))


def generalised_advantage(rewards: Column, values: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Advantages of a sequence: delta_t + gamma * lambda * A_(t+1), from the end."""
    n = F.size(rewards)
    order = F.reverse(F.sequence(F.lit(0), n - 1))

    def step(acc: Column, t: Column) -> Column:
        following = F.coalesce(F.get(values, t + 1), F.lit(0.0))
        now = F.get(rewards, t) + gamma * following - F.get(values, t) + gamma * lam * acc["last"]
        return F.struct(now.alias("last"), F.concat(F.array(now), acc["out"]).alias("out"))

    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))
    return F.when(n > 0, F.aggregate(order, start, step)["out"]).otherwise(F.array().cast("array<double>"))


def shaped(kl: Column, score: Column, beta: float) -> Column:
    """-beta times the divergence of each token; the score is added on the last."""
    n = F.size(kl)
    # nothing is added to the others: a sum with zero would turn the zero of a negative sign
    return F.transform(kl, lambda k, i: F.when(i == n - 1, -beta * k + score).otherwise(-beta * k))


def whitened(df: DataFrame, column: str, mask: str | None = None, shift_mean: bool = True) -> DataFrame:
    """Adds whitened: the column over the deviation of unmasked rows, its mean taken out or kept."""
    held = F.when(F.col(mask), F.col(column)) if mask else F.col(column)
    stats = df.agg(F.avg(held).alias("__mean"), F.var_pop(held).alias("__var"))
    out = (F.col(column) - F.col("__mean")) / F.sqrt(F.col("__var") + 1e-8)
    return df.crossJoin(F.broadcast(stats)).withColumn("whitened", out if shift_mean else out + F.col("__mean")).drop("__mean", "__var")


def margins(df: DataFrame, chosen: str, rejected: str, group: str | None = None) -> DataFrame:
    """Mean chosen, rejected, margin, and share of chosen over rejected."""
    c, r = F.col(chosen), F.col(rejected)
    return (df.groupBy(group) if group else df.groupBy()).agg(F.avg(c).alias("mean_chosen"), F.avg(r).alias("mean_rejected"), F.avg(c - r).alias("mean_margin"), F.avg((c > r).cast("double")).alias("accuracy"))


def completion_metrics(df: DataFrame, length: str, terminated: str, reward: str, group: str) -> DataFrame:
    """One row: lengths of all and of ended completions (0 without any), clipped share, reward mean and deviation, share of groups without spread."""
    n, ended = F.col(length), F.col(terminated)
    own = F.when(ended, n)
    spread = df.groupBy(group).agg(F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("s")).agg(F.avg((F.col("s") == 0).cast("double")).alias("frac_zero_std"))
    row = df.agg(
        F.avg(n).alias("mean_length"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
        F.avg((~ended).cast("double")).alias("clipped_ratio"),
        F.coalesce(F.avg(own), F.lit(0.0)).alias("mean_terminated_length"),
        F.coalesce(F.min(own), F.lit(0)).alias("min_terminated_length"),
        F.coalesce(F.max(own), F.lit(0)).alias("max_terminated_length"),
        F.avg(reward).alias("reward_mean"),
        F.stddev_samp(reward).alias("reward_std"),
    )
    return row.crossJoin(spread)


def mismatched(df: DataFrame, batch: str, order: str, completion: str = "completion") -> DataFrame:
    """Adds kl_completion: the completion of the row before it in the batch, the first row's from the last."""
    w = Window.partitionBy(batch).orderBy(order)
    last = F.last(completion).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("kl_completion", F.coalesce(F.lag(completion).over(w), last))


def label_balance(df: DataFrame, label: str = "label", desirable: float = 1.0, undesirable: float = 1.0) -> DataFrame:
    """One row: counts of both labels (at least 1), and the bounds between which each weight balances the other."""
    yes, no = F.greatest(F.count_if(label), F.lit(1)), F.greatest(F.count_if(~F.col(label)), F.lit(1))
    return df.agg(
        yes.alias("n_desirable"),
        no.alias("n_undesirable"),
        F.round(no * undesirable / yes, 2).alias("desirable_low"),
        F.round(no * undesirable / yes * 1.33, 2).alias("desirable_high"),
        F.round(yes * desirable / no / 1.33, 2).alias("undesirable_low"),
        F.round(yes * desirable / no, 2).alias("undesirable_high"),
    )


def sorted_loss(df: DataFrame, batch: str, order: str, left: str, right: str, beta: float = 0.1, smoothing: float = 0.0) -> DataFrame:
    """(batch, rank, loss): the smoothed sigmoid loss of two columns that are each sorted within a batch.

    left and right are log ratios of chosen and rejected answers (paired transport), or of the policy and the reference.
    """
    def ranked(c: str, name: str) -> DataFrame:
        by = Window.partitionBy(batch).orderBy(c, order)
        return df.select(F.col(batch).alias(f"{name}_batch"), F.row_number().over(by).alias(f"{name}_rank"), F.col(c).alias(name))

    a, b = ranked(left, "a"), ranked(right, "b")
    pairs = a.join(b, a.a_batch.eqNullSafe(b.b_batch) & (a.a_rank == b.b_rank))
    return pairs.select(F.col("a_batch").alias(batch), F.col("a_rank").alias("rank"), sigmoid_loss(F.col("a") - F.col("b"), beta, smoothing).alias("loss"))
