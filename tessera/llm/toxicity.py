"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of two lexicons (a seed list with the words that the labelled sample shows to
be toxic, and word beginnings that it shows), how close its hits stand to second-person words, capitals, punctuation, and rates of obfuscation (lexicon words
found only after digits and signs are read as letters, or spelled out letter by letter). Trees are fitted on the driver
to a sample of at most `sample` labelled rows, chosen by a hash of the id; the calibration uses scores of rows that the
trees did not see (cross-fitting). Scoring is one pass over the documents.

Defined results: null text counts as empty, and an empty text gets the calibrated score of its all-zero features; rows
that repeat get equal scores; labels that are null, or whose ids are not in the documents, are left out; several labels
of an id count by their largest; with fewer than ten usable labels, or labels all alike, all scores are their mean (0.5
without any); an empty table gives no rows; further columns travel along, whatever their names. In the sample,
texts longer than a tenth of its character bound come last, so a few of them cannot use it up; every text is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, calibrated, fit_isotonic, fit_trees
from .common import map_arrow, table, text_or_empty

SAMPLE = 6_000
SAMPLE_CHARACTERS = 12_000_000
THRESHOLD = 0.3
FOLDS = 3
NEAR = 5
#: Lengths of word beginnings.
STEM = (4, 5, 6, 7)
#: Insults that count as toxic whatever the sample shows.
SEEDS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown imbecile bastard bitch asshole shit fuck fucking crap jerk".split())
SECOND_PERSON = frozenset("you your yours yourself u ur youre du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][\s.*_-]){3,}[^\W\d_](?![^\W_])")
MIXED = re.compile(r"[^\W\d_][\d@$!*|]+[^\W\d_]")
WORDS = re.compile(r"[^\W_]+")
ODD = re.compile(r"\S*[\d@$!|*]\S*")
ODD_BYTES = np.array([chr(c) in "0123456789@$!|*" for c in range(256)])
PUNCTUATION = np.array([chr(c) in "!?#$%&*@^~|" for c in range(256)])
CAPITALS = np.array([65 <= c <= 90 for c in range(256)])
LETTERS = np.array([chr(c).isalpha() and c < 128 or c >= 0xC3 for c in range(256)])
FEATURES = ("hits", "density", "stems", "stem_density", "kinds", "seed_density", "near_you", "near_share", "you_density", "capitals", "loud", "punctuation", "mixed", "masked_hits", "spelled_hits", "length")


class Lexicon(dict):
    """Word -> 2 if it is in the lexicon, 1 if only its beginning is, else 0; words are kept as they come, up to a bound."""

    MOST = 300_000

    def __init__(self, words: frozenset[str], stems: frozenset[str]):
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        kind = 2 if word in self.words else int(any(word[:k] in self.stems for k in STEM if len(word) > k))
        self[word] = kind
        return kind

    def __reduce__(self):
        return Lexicon, (self.words, self.stems)


def plain_words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def features(text: str, lexicon: Lexicon) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    words = plain_words(text)
    n = max(1, len(words))
    kinds = list(map(lexicon.__getitem__, words))
    at = [i for i, k in enumerate(kinds) if k == 2]
    stems = kinds.count(1)
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if at and you:
        spots = np.array(you)
        k = np.searchsorted(spots, at)
        left = np.abs(np.array(at) - spots[np.maximum(k - 1, 0)])
        right = np.abs(spots[np.minimum(k, len(spots) - 1)] - np.array(at))
        near = int((np.minimum(left, right) <= NEAR).sum())
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    letters, size = max(1, int(raw[LETTERS].sum())), max(1, len(text))
    odd = ODD.findall(text) if raw[ODD_BYTES].any() else []
    masked = sum(1 for w in odd if any(c.isdigit() or c in "@$!|*" for c in w[:-1]) for p in WORDS.findall(w.lower().rstrip("!?.,;:").translate(LEET)) if lexicon[p] == 2) - sum(1 for w in odd for p in plain_words(w) if lexicon[p] == 2)
    letterwise = sum(map((1).__eq__, map(len, words))) >= 4
    spelled = letterwise and sum(lexicon["".join(WORDS.findall(m[0])).lower()] == 2 for m in SPELLED.finditer(text))
    hit = [words[i] for i in at]
    return [
        float(np.log1p(len(at))),
        len(at) / n,
        float(np.log1p(stems)),
        stems / n,
        float(len(set(hit))),
        sum(w in SEEDS for w in hit) / n,
        float(near),
        near / max(1, len(at)),
        len(you) / n,
        float(raw[CAPITALS].sum() / letters),
        float((raw[ord("!")] + raw[ord("?")]) / size),
        float(raw[PUNCTUATION].sum() / size),
        (len(MIXED.findall(text)) if odd else 0) / n,
        float(max(0, masked)),
        float(spelled),
        float(np.log1p(len(text))),
    ]


def learned_lexicon(texts: list[str], toxic: np.ndarray, evidence: float = 12.0) -> Lexicon:
    """Seeds, and the words and word beginnings whose texts are toxic so much oftener that chance won't do.

    evidence: texts with the word, times the divergence (in nats) of their toxic share from that of all texts.
    """
    bad, every = Counter(), Counter()
    for text, y in zip(texts, toxic, strict=True):
        own = set(plain_words(text))
        keys = own | {(w[:k],) for w in own for k in STEM if len(w) > k}
        every.update(keys)
        if y:
            bad.update(keys)
    base = min(max(float(toxic.mean()), 1e-3), 0.5)

    def tells(key) -> bool:
        c, n = bad[key], every[key]
        share = c / n
        if share < 0.6 or n > 0.3 * len(texts):
            return False
        rest = (n - c) * np.log((1 - share) / (1 - base)) if n > c else 0.0
        return c * np.log(share / base) + rest >= evidence

    told = [k for k in bad if tells(k)]
    return Lexicon(SEEDS | {k for k in told if isinstance(k, str)}, frozenset(k[0] for k in told if not isinstance(k, str)))


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees, at: np.ndarray, rate: np.ndarray):
        self.lexicon, self.trees, self.at, self.rate = lexicon, trees, at, rate

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return calibrated(self.trees.raw(np.array([features(t, self.lexicon) for t in texts])), self.at, self.rate)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """The lexicon of a fold comes from the other folds, so calibration sees what new texts will show."""
    toxic = np.asarray(toxic, float)
    if len(texts) < 10 or toxic.min() == toxic.max():
        mean = float(toxic.mean()) if len(texts) else 0.5
        return Model(Lexicon(SEEDS, frozenset()), Trees(1, 0.0), np.array([0.0]), np.array([mean]))
    fold = np.arange(len(texts)) % FOLDS
    raw = np.zeros(len(texts))
    for k in range(FOLDS):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        words = learned_lexicon([texts[i] for i in train], toxic[train])
        trees = fit_trees(np.array([features(texts[i], words) for i in train]), toxic[train])
        raw[test] = trees.raw(np.array([features(texts[i], words) for i in test]))
    words = learned_lexicon(texts, toxic)
    trees = fit_trees(np.array([features(t, words) for t in texts]), toxic)
    return Model(words, trees, *fit_isotonic(raw, toxic))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, characters: int = SAMPLE_CHARACTERS) -> Model:
    """Fits on labelled rows whose crc32(doc_id as text) mod 4 is not 2: at most `sample`, and about `characters` of text.

    Rows come in the order of a hash of the id; both bounds keep the driver's memory fixed.
    """
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(*order).limit(sample)
    # an id that repeats counts by its least text
    sized = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    lengths = sized.groupBy("doc_id").agg(F.min(F.length("text")).alias("n")).orderBy(*order).collect()
    ids, total = [], 0
    # whole texts up to the bound; those that would take a tenth of it alone come last
    for r in sorted(lengths, key=lambda r: 10 * r.n > characters):
        if total < characters:
            ids.append((r.doc_id,))
            total += r.n
    picked = docs.sparkSession.createDataFrame(ids, "doc_id long")
    rows = sized.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.length("text"), "text")).alias("t"), F.max("toxic").alias("toxic"))
    rows = rows.select("doc_id", "t.text", "toxic").orderBy(*order).collect()
    return fit([r.text for r in rows], np.array([r.toxic for r in rows], float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score; a column of that name in docs goes on as given_score (with as many underscores behind as it takes)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    given = "given_score"
    while given in docs.columns:
        given += "_"
    fields = [(given if f.name == "score" else f.name, f.dataType.simpleString()) for f in docs.schema]

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.score(texts), pa.float64())], [*(n for n, _ in fields), "score"])

    return map_arrow(docs, batch, ", ".join([*(f"`{n}` {kind}" for n, kind in fields), "score double"]))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = held.value.score([t or "" for t in b.column("text").to_pylist()]) < threshold
        yield b.filter(pa.array(keep))

    return map_arrow(docs, batch, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    # only what the result needs leaves Python: the text stays there
    held = spark.sparkContext.broadcast(model)

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held.value.score([t or "" for t in b.column("text").to_pylist()]), pa.float64())], ["doc_id", "score"])

    out = map_arrow(docs, batch, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
