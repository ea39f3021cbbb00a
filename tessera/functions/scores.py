"""Similarity and answer scores as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import number_set

#: Words and signs of mathematical answers.
KEYWORDS = ["đúng", "sai", "kết quả", "bằng", "=", "+", "-", "*", "/", "×", "÷", "π"]
SHORT_KEYWORDS = ["đúng", "sai", "kết quả", "bằng", "=", "+", "-", "*", "/"]
WEIGHTS = {"keyword_matching": 0.3, "number_matching": 0.4, "length_similarity": 0.2, "exact_match": 0.1}


def rounded(c: Column, places: int) -> Column:
    """A double with so many places, half up; what becomes zero keeps its sign, which `round` drops."""
    r = F.round(c, places)
    return F.when(r == 0, c * F.lit(0.0)).otherwise(r)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def keyword_match(answer: Column, expected: Column, keywords: list[str] = KEYWORDS) -> Column:
    """Share of the keywords that both texts contain."""
    a, e = F.lower(answer), F.lower(expected)
    hits = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(a, k) & F.contains(e, k))
    return F.size(hits) / F.lit(len(keywords))


def number_match(answer: Column, expected: Column) -> Column:
    """Share of the expected numbers that the answer has; 0 if none are expected."""
    e = number_set(expected)
    return F.when(F.size(e) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(e, number_set(answer))) / F.greatest(F.size(e), F.lit(1)))


def length_similarity(answer: Column, expected: Column) -> Column:
    a, e = F.length(answer), F.length(expected)
    return F.when(e == 0, F.lit(0.0)).otherwise(1.0 - F.abs(a - e) / F.greatest(a, e, F.lit(1)))


def exact_match(answer: Column, expected: Column) -> Column:
    return (F.trim(F.lower(answer)) == F.trim(F.lower(expected))).cast("double")


#: Metric name -> Column builder of (answer, expected); further ones can be registered.
METRICS = {"keyword_matching": keyword_match, "number_matching": number_match, "length_similarity": length_similarity, "exact_match": exact_match}


def weighted(metrics: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    unknown = set(weights) - set(metrics)
    if unknown:
        raise KeyError(f"weights for metrics that are not computed: {sorted(unknown)}")
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + metrics[name] * weight
    return total


def log_sigmoid(x: Column) -> Column:
    """ln(1 / (1 + exp(-x))), finite for every finite x."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.exp(log_sigmoid(x))


def sigmoid_loss(margin: Column, beta: float = 0.1, smoothing: float = 0.0) -> Column:
    """Preference loss of a log-ratio margin, with label smoothing."""
    return -(log_sigmoid(beta * margin) * (1 - smoothing)) - log_sigmoid(-beta * margin) * smoothing


def hinge_loss(margin: Column, beta: float = 0.1) -> Column:
    return F.greatest(F.lit(0.0), 1 - beta * margin)


def ipo_loss(margin: Column, beta: float = 0.1) -> Column:
    return F.pow(margin - 1 / (2 * beta), 2)


def robust_loss(margin: Column, beta: float = 0.1, smoothing: float = 0.1) -> Column:
    """Unbiased under labels that are flipped with probability `smoothing`."""
    return (log_sigmoid(-beta * margin) * smoothing - log_sigmoid(beta * margin) * (1 - smoothing)) / (1 - 2 * smoothing)


def exact_pair_loss(margin: Column, beta: float = 0.1, smoothing: float = 1e-3) -> Column:
    """Reverse divergence of the pair's preference from smoothed labels."""
    up, down = log_sigmoid(beta * margin), log_sigmoid(-beta * margin)
    return F.exp(up) * (up - math.log(1 - smoothing)) + F.exp(down) * (down - math.log(smoothing))


def blended_loss(margin: Column, beta: float = 0.1, tau: float = 0.05) -> Column:
    """Logistic and exponential loss, blended by the size of the margin."""
    x = beta * margin
    share = sigmoid(x / tau)
    return F.exp(-x) * share - log_sigmoid(x) * (1 - share)


def binary_pair_loss(chosen: Column, rejected: Column, beta: float = 0.1, delta: Column | float = 0.0) -> Column:
    """Each log ratio against the mean reward `delta`."""
    return -log_sigmoid(beta * chosen - delta) - log_sigmoid(delta - beta * rejected)


def squared_pair_loss(chosen: Column, rejected: Column, beta: float = 0.1) -> Column:
    """Self-play with hard probabilities: log ratios are drawn to plus and minus 1 / (2 beta)."""
    return F.pow(chosen - 0.5 / beta, 2) + F.pow(rejected + 0.5 / beta, 2)


def contrastive_pair_loss(chosen: Column, rejected: Column, beta: float = 0.1) -> Column:
    return -log_sigmoid(beta * chosen) - 0.5 * log_sigmoid(-beta * chosen) - 0.5 * log_sigmoid(-beta * rejected)


def anchored_zero_loss(chosen: Column, rejected: Column, beta: float = 0.1) -> Column:
    """Chosen answers become likelier, rejected ones less likely."""
    return 1 - sigmoid(beta * chosen) + sigmoid(beta * rejected)


def anchored_down_loss(chosen: Column, rejected: Column, beta: float = 0.1) -> Column:
    """Both become less likely, rejected ones more so."""
    return sigmoid(beta * chosen) + 1 - sigmoid(beta * (chosen - rejected))


#: Losses of a margin (chosen less rejected log ratio), and of both log ratios, by their usual names.
MARGIN_LOSSES = {"sigmoid": sigmoid_loss, "robust": robust_loss, "exo_pair": exact_pair_loss, "hinge": hinge_loss, "ipo": ipo_loss, "discopop": blended_loss}
PAIR_LOSSES = {"bco_pair": binary_pair_loss, "sppo_hard": squared_pair_loss, "nca_pair": contrastive_pair_loss, "apo_zero": anchored_zero_loss, "apo_down": anchored_down_loss}


def preference_loss(kind: str, chosen: Column, rejected: Column, **options) -> Column:
    """A loss of log ratios (policy less reference) by name; those that sort a batch are `rewards.sorted_loss`."""
    if kind in MARGIN_LOSSES:
        return MARGIN_LOSSES[kind](chosen - rejected, **options)
    return PAIR_LOSSES[kind](chosen, rejected, **options)


def density_weight(probability: Column, low: float, high: float) -> Column:
    """p / (1 - p), clamped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), probability / (1 - probability + 1e-8)))
