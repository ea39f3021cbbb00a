"""Language models from counts: interpolated Kneser-Ney n-grams, and language profiles of character n-grams.

Both learn by group-bys and score by joins, and both take `by`, a column of the training table and of the scored one: a
model is learned for each of its values and judges the rows that have the same one (folds, sources, days).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shared import WorkFolder
from .cleaning import held, once
from .near_vectors import settings


def _names(order: int) -> list[str]:
    return [f"g{k}" for k in range(1, order + 1)]


def word_ngrams(df: DataFrame, keep: list[str], column: str, order: int) -> DataFrame:
    """keep, g1 .. g<order>: a row for each lower-cased word with the words before it; places before the first word hold empty text."""
    padded = F.concat(F.array_repeat(F.lit(""), order - 1), T.words(F.lower(column)))
    t = once(df.select(*keep, padded.alias("__t")), "__t", F.col("__t")).where(F.size("__t") >= order)
    gram = lambda i: F.struct(*(F.get("__t", i + k).alias(f"g{k + 1}") for k in range(order)))
    return t.select(*keep, F.inline(F.transform(F.sequence(F.lit(0), F.size("__t") - order), gram)))


@dataclass
class KneserNey:
    """Tables of a model, lowest order first: counts (by, g1 .. gk, c) and contexts (by, g1 .. gk-1, total, types).

    c is the count of an n-gram of the highest order; below, it is the number of different words that stand before it.
    """

    by: str | None
    counts: list[DataFrame]
    contexts: list[DataFrame]


def kneser_ney(df: DataFrame, column: str = "text", order: int = 3, by: str | None = None) -> KneserNey:
    """Counts and contexts of all texts. Each order's table is grouped from the one above, never from the texts again.

    Every n-gram of order k + 1 is one row of its table, so rows grouped by the last k words are the words that precede
    them: no count of distinct values is needed, and counts are added up before they are shuffled.
    """
    return _counted(word_ngrams(df, [by] if by else [], column, order), order, by, held)


def _counted(grams: DataFrame, order: int, by: str | None, held) -> KneserNey:
    """A model of the n-grams given; held: keeps a table that is used several times."""
    keep = [by] if by else []
    table = held(grams.groupBy(*keep, *_names(order)).agg(F.count(F.lit(1)).alias("c")))
    counts, contexts = [table], []
    for k in range(order, 0, -1):
        contexts.append(table.groupBy(*keep, *_names(k - 1)).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types")))
        if k > 1:
            shorter = [F.col(f"g{j}").alias(f"g{j - 1}") for j in range(2, k + 1)]
            table = held(table.select(*keep, *shorter).groupBy(*keep, *_names(k - 1)).agg(F.count(F.lit(1)).alias("c")))
            counts.append(table)
    return KneserNey(by, counts[::-1], contexts[::-1])


def probabilities(model: KneserNey, asked: DataFrame, order: int, discount: float = 0.75) -> DataFrame:
    """by, g1 .. g<order>, p for each of the distinct n-grams asked for.

    p = max(c - d, 0) / total + d * types / total * p of the n-gram without its first word; a context that was never seen
    leaves it to the shorter one. Below single words stands the uniform share of the words seen and one more, unknown word.
    Lower orders are asked for distinct n-grams only, so at most a vocabulary of rows meets in any one word.
    """
    keep, names = [model.by] if model.by else [], _names(order)
    counts, contexts = model.counts[order - 1], model.contexts[order - 1]
    own = F.coalesce(F.greatest(F.col("c") - discount, F.lit(0.0)), F.lit(0.0)) / F.col("total")
    left = discount * F.col("types") / F.col("total")
    found = asked.join(counts, [*keep, *names], "left")
    if order == 1:
        # one row for each value of by, or one row alone
        found = found.join(F.broadcast(contexts), keep, "left") if keep else found.crossJoin(F.broadcast(contexts))
        lower = 1 / (F.coalesce("types", F.lit(0)) + 1)
    else:
        shorter = [F.col(f"g{j}").alias(f"g{j - 1}") for j in range(2, order + 1)]
        below = probabilities(model, asked.select(*keep, *shorter).distinct(), order - 1, discount)
        below = below.select(*keep, *(F.col(f"g{j - 1}").alias(f"g{j}") for j in range(2, order + 1)), F.col("p").alias("lower"))
        found = found.join(contexts, [*keep, *names[:-1]], "left").join(below, [*keep, *names[1:]])
        lower = F.col("lower")
    return found.select(*keep, *names, F.coalesce(own + left * lower, lower).alias("p"))


def kneser_ney_perplexity(model: KneserNey, df: DataFrame, key: str, column: str = "text", discount: float = 0.75) -> DataFrame:
    """(key, n_words, perplexity): exp of the mean negative log probability of each text's words; null for a text without words.

    The texts of a key are judged together; a null key is a key; an empty model gives every word the same probability.
    """
    order, keep = len(model.counts), [model.by] if model.by else []
    names = _names(order)
    texts = df.select(F.col(key).alias("__key"), *keep, F.col(column).alias("__text"))
    grams = held(word_ngrams(texts, ["__key", *keep], "__text", order).groupBy("__key", *keep, *names).agg(F.count(F.lit(1)).alias("n")))
    p = probabilities(model, grams.select(*keep, *names).distinct(), order, discount)
    judged = grams.join(p, [*keep, *names]).groupBy("__key").agg(F.sum("n").alias("n_words"), F.exp(-F.sum(F.col("n") * F.log("p")) / F.sum("n")).alias("perplexity"))
    silent = texts.select("__key").distinct().withColumns({"n_words": F.lit(0).cast("long"), "perplexity": F.lit(None).cast("double")})
    return judged.union(silent).groupBy(F.col("__key").alias(key)).agg(F.max("n_words").alias("n_words"), F.max("perplexity").alias("perplexity"))


#: Parts in which held-out texts are judged, at most, and bytes of training texts for each.
SLICES, SLICE = 8, 16 << 20


def held_out_perplexity(train: DataFrame, df: DataFrame, key: str, column: str = "text", order: int = 3, by: str | None = None, discount: float = 0.75, slices: int | None = None) -> DataFrame:
    """kneser_ney_perplexity of df under a model of train, a slice of the vocabulary after the other, so that one slice's n-grams at a time lie on disk.

    Slices are those of an n-gram's last word. All orders that a probability is made of end in the same word, so a slice has all of its
    counts; totals and types of contexts add up over slices, and are learned in a round of their own. Texts are read twice for each slice.
    """
    spark, keep, names = df.sparkSession, [by] if by else [], _names(order)
    texts = df.select(F.col(key).alias("__key"), *keep, F.col(column).alias("__text"))
    slices = slices or min(SLICES, 1 + (train.agg(F.sum(F.octet_length(column))).first()[0] or 0) // SLICE)
    sliced = lambda d, k: d.where(F.pmod(F.xxhash64(names[-1]), F.lit(slices)) == k)

    def kept(folder: str):
        def stored(d: DataFrame, name: list = [0]) -> DataFrame:  # noqa: B006
            name[0] += 1
            d.write.parquet(f"{folder}/{name[0]}")
            return spark.read.schema(d.schema).parquet(f"{folder}/{name[0]}")

        return stored

    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"), WorkFolder(spark) as folder:
        stored = kept(f"{folder}/all")
        for k in range(slices):
            with WorkFolder(spark) as own:
                part = _counted(sliced(word_ngrams(train, keep, column, order), k), order, by, kept(own))
                for n, table in enumerate(part.contexts):
                    table.write.mode("append").parquet(f"{folder}/contexts{n}")
        added = lambda n, t: t.groupBy(*keep, *_names(n)).agg(F.sum("total").alias("total"), F.sum("types").alias("types"))
        contexts = [stored(added(n, spark.read.schema(t.schema).parquet(f"{folder}/contexts{n}"))) for n, t in enumerate(part.contexts)]
        for k in range(slices):
            with WorkFolder(spark) as own:
                part = _counted(sliced(word_ngrams(train, keep, column, order), k), order, by, kept(own))
                # kept apart from the model's tables
                grams = kept(f"{own}/asked")(sliced(word_ngrams(texts, ["__key", *keep], "__text", order), k).groupBy("__key", *keep, *names).agg(F.count(F.lit(1)).alias("n")))
                p = probabilities(KneserNey(by, part.counts, contexts), grams.select(*keep, *names).distinct(), order, discount)
                sums = grams.join(p, [*keep, *names]).groupBy("__key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("p")).alias("log_p"))
                sums.write.mode("append").parquet(f"{folder}/sums")
        silent = texts.select("__key").distinct().withColumns({"n": F.lit(0).cast("long"), "log_p": F.lit(0.0)})
        both = spark.read.schema(sums.schema).parquet(f"{folder}/sums").union(silent).groupBy(F.col("__key").alias(key)).agg(F.sum("n").alias("n_words"), F.sum("log_p").alias("__log_p"))
        return held(both.select(key, "n_words", F.when(F.col("n_words") > 0, F.exp(-F.col("__log_p") / F.col("n_words"))).alias("perplexity")))


#: Scripts that name a language by themselves, and the script of profiles.
SCRIPTS = {"el": "Greek", "he": "Hebrew", "ar": "Arabic", "hi": "Devanagari", "th": "Thai", "ko": "Hangul", "ru": "Cyrillic"}
KANA, HAN = "\\p{IsHiragana}\\p{IsKatakana}", "\\p{IsHan}"


def script_language(c: Column | str) -> Column:
    """The language that a text's script names, if most of its letters are not Latin: kana is ja even beside Han, Han alone zh.

    'unknown' without letters, or if most of the letters that are not Latin are of other scripts; null if n-grams have to tell.
    """
    letters = F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "[^\\p{L}]+", "")

    def told(both: Column) -> Column:
        count = lambda kind: F.length(F.regexp_replace(both["other"], f"[^{kind}]+", ""))
        east = count(KANA + HAN)
        named = [F.when(2 * count(f"\\p{{Is{script}}}") > F.length(both["other"]), name) for name, script in SCRIPTS.items()]
        named.append(F.when(2 * east > F.length(both["other"]), F.when(count(KANA) > 0, "ja").otherwise("zh")))
        strange = F.when(2 * F.length(both["other"]) > both["n"], F.coalesce(*named, F.lit("unknown")))
        return F.when(both["n"] == 0, "unknown").otherwise(strange)

    # the letters stand in an array of one, so that they are found once
    parts = F.transform(F.array(letters), lambda x: F.struct(F.length(x).alias("n"), F.regexp_replace(x, "\\p{IsLatin}+", "").alias("other")))
    return F.transform(parts, told)[0]


@dataclass
class Profiles:
    """languages, and weights (by, gram, w0 .. wk): 1000 times the log probability of a gram in each of them, as whole numbers."""

    by: str | None
    languages: list[str]
    weights: DataFrame
    longest: int


def _letter_words(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower(column), F.lit("\\p{L}+"), F.lit(0))
    return df.select(*keep, F.explode(found).alias("word")).groupBy(*keep, "word").agg(F.count(F.lit(1)).alias("n"))


def _grams_of(words: DataFrame, keep: list[str], longest: int) -> DataFrame:
    """A row for each 1 to `longest` characters of a word between blanks."""


    def windows(c: Column, k: int) -> Column:
        n = F.length(c) + 1 - k
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    blank = F.concat(F.lit(" "), "word", F.lit(" "))
    return words.select(*keep, F.explode(F.concat(windows(F.col("word"), 1), *(windows(blank, k) for k in range(2, longest + 1)))).alias("gram"))


def language_profiles(labelled: DataFrame, label: str = "lang", column: str = "text", by: str | None = None, longest: int = 3) -> Profiles:
    """Profiles of the languages that a table's rows are labelled with, from all of its texts, by add-one counts of n-grams.

    Texts become counted words first, and grams are made of different words only. The names of the languages come to the
    driver: some hundreds at most. Rows without a label teach nothing.
    """
    keep = [by] if by else []
    labelled = labelled.where(F.col(label).isNotNull())
    languages = sorted(r[0] for r in labelled.select(F.col(label).cast("string")).distinct().collect())
    words = _letter_words(labelled.select(*keep, F.col(label).cast("string").alias("__lang"), F.col(column).alias("__text")), [*keep, "__lang"], "__text")
    one = lambda k: F.sum(F.when(F.col("__lang") == languages[k], F.col("n")).otherwise(0)).alias(f"c{k}")
    counts = words.groupBy(*keep, "word").agg(*map(one, range(len(languages)))) if languages else words.select(*keep, "word")
    cs = [f"c{k}" for k in range(len(languages))]
    counts = held(_grams_of(counts, [*keep, *cs], longest).groupBy(*keep, "gram").agg(F.count(F.lit(1)).alias("__words"), *(F.sum(c).alias(c) for c in cs)))
    totals = counts.groupBy(*keep).agg(F.count(F.lit(1)).alias("__v"), *(F.sum(c).alias(f"t{c}") for c in cs))
    joined = counts.join(F.broadcast(totals), keep) if keep else counts.crossJoin(F.broadcast(totals))
    weight = lambda k: F.round(1000 * F.log((F.col(f"c{k}") + 1) / (F.col(f"tc{k}") + F.col("__v")))).cast("long").alias(f"w{k}")
    return Profiles(by, languages, joined.select(*keep, "gram", *map(weight, range(len(languages)))), longest)


def detected_languages(profiles: Profiles, df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, language): by script where that tells, else the profile under which all of a text's grams together are likeliest.

    Grams of no profile do not count; 'unknown' where none is left, or no letters are. Ties go to the first name. Words are scored once,
    whatever the number of texts that have them; a text then adds up its words. Keys must be unique.
    """
    keep, ws = [profiles.by] if profiles.by else [], [f"w{k}" for k in range(len(profiles.languages))]
    texts = df.select(F.col(key).alias("__key"), *keep, F.col(column).alias("__text"))
    scripts = texts.select("__key", script_language("__text").alias("__script"))
    if not ws:
        return scripts.select(F.col("__key").alias(key), F.coalesce("__script", F.lit("unknown")).alias("language"))
    words = held(_letter_words(texts, ["__key", *keep], "__text"))
    grams = _grams_of(words.select(*keep, "word").distinct(), [*keep, "word"], profiles.longest)
    scored = grams.join(profiles.weights, [*keep, "gram"]).groupBy(*keep, "word").agg(*(F.sum(w).alias(w) for w in ws))
    sums = words.join(scored, [*keep, "word"]).groupBy(F.col("__key").alias("__k")).agg(*(F.sum(F.col("n") * F.col(w)).alias(w) for w in ws))
    best = F.array_max(F.array(*(F.struct(F.col(w).alias("w"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (w, name) in enumerate(zip(ws, profiles.languages, strict=True)))))
    told = sums.select("__k", best["name"].alias("__best"))
    return scripts.join(told, F.col("__key").eqNullSafe(F.col("__k")), "left").select(F.col("__key").alias(key), F.coalesce("__script", "__best", F.lit("unknown")).alias("language"))
