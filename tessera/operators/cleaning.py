"""Filters, exact and near-duplicate removal, validation reports."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .near_vectors import earliest_near, settings


def held(df: DataFrame) -> DataFrame:
    """A table that is used several times: in the checkpoint folder where there is one, else kept twice, so that a lost executor takes no row along."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist(StorageLevel.MEMORY_AND_DISK_2)


def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with a column that is computed once a row, whatever is asked of it later.

    Filters are not pushed through a generator, so the expression is not copied into each of them.
    """
    rest = [x for x in df.columns if x != name]
    return df.select(*rest, F.explode(F.array(c)).alias(name)).select(*(df.columns if name in df.columns else [*rest, name]))


def length_between(df: DataFrame, low: int, high: int, column: str = "text", inclusive: bool = True) -> DataFrame:
    """Rows whose text has low to high characters; one comparison, so the length is asked for once."""
    off = F.abs(2 * F.length(column) - (low + high))
    return df.where(off <= high - low if inclusive else off < high - low)


def non_blank(df: DataFrame, column: str) -> DataFrame:
    """Null and white-space values go."""
    return df.where(T.collapse_spaces(column) != "")


def or_default(c: Column, default: str) -> Column:
    """Null and empty become the default."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def compose_answer(solution: Column, result: Column, placeholder: str = "") -> Column:
    """Both if they differ, else the one there is, else the placeholder."""
    s, r = F.nullif(F.trim(solution), F.lit("")), F.nullif(F.trim(result), F.lit(""))
    return F.when(s.isNotNull() & r.isNotNull() & (s != r), F.concat(s, F.lit("\n"), r)).otherwise(F.coalesce(s, r, F.lit(placeholder)))


def first_field(df: DataFrame, names: list[str]) -> str | None:
    """The first of the names that the table has."""
    return next((n for n in names if n in df.columns), None)


def paragraphs(df: DataFrame, key: str, column: str = "text", least: int = 20, most: int = 10) -> DataFrame:
    """The first `most` paragraphs of at least `least` characters of each text: key, pos, paragraph."""
    parts = F.transform(F.split(column, "\\n\\s*\\n"), lambda p: F.trim(p))
    kept = F.slice(F.filter(parts, lambda p: F.length(p) >= least), 1, most)
    return df.select(key, F.posexplode(kept).alias("pos", "paragraph"))


def exact_dedup(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """The first row by order_by of each text, white space collapsed; null texts are one text."""
    w = Window.partitionBy("__h").orderBy(order_by)
    return df.withColumn("__h", T.text_hash(column)).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__h", "__r")


def dedup_statistics(df: DataFrame, column: str, file_column: str) -> DataFrame:
    """One row: source_files, total, unique_rows, duplicates_removed, file_list."""
    kept = F.count_distinct(F.coalesce(T.text_hash(column), F.lit("")))
    total = F.count(F.lit(1))
    return df.agg(F.count_distinct(file_column).alias("source_files"), total.alias("total"), kept.alias("unique_rows"), (total - kept).alias("duplicates_removed"), F.array_sort(F.collect_set(file_column)).alias("file_list"))


def tfidf(df: DataFrame, key: str, column: str = "text", stop: list[str] | None = None, copies: str | None = None) -> DataFrame:
    """(key, term, weight): raw counts times ln((1 + n) / (1 + df)) + 1, rows of unit length.

    copies: a column that says for how many equal texts a row stands.
    """
    tokens = T.terms(column)
    if stop:
        tokens = T.remove_stop_words(tokens, stop)
    times = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    counts = df.select(key, times.alias("copies"), F.explode(tokens).alias("term")).groupBy(key, "copies", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = df.agg(F.coalesce(F.sum(times), F.lit(0)).alias("n"))
    frequency = counts.groupBy("term").agg(F.sum("copies").alias("df"))
    raw = counts.join(frequency, "term").crossJoin(F.broadcast(n)).select(key, "term", "df", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "df", (F.col("w") / norm).alias("weight"))


def similar_vectors(weights: DataFrame, key: str, threshold: float = 0.9) -> DataFrame:
    """(a, b, similarity), a < b: unit vectors (key, term, df, weight) whose cosine is over the threshold, strictly.

    Candidates come from prefixes: with terms ordered from rare to common, two unit vectors whose cosine exceeds t share
    a term among those before the squared weights left fall to t * t. Only prefix terms are joined, so common terms make
    no pairs. A pair goes on if what it shares in classes of frequency (powers of two) that both prefixes hold whole,
    and the most that the other classes' weights can add, pass the threshold; those left are scored over all terms.
    Vectors should be distinct: copies would pair with each other and with all that is near them.
    """
    square = F.col("weight") * F.col("weight")
    after = Window.partitionBy(key).orderBy(F.col("df").desc(), F.col("term").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.floor(F.log2("df")).cast("int").alias("level")
    # ranks come with the shuffle that made the vectors; what follows reads the table
    ranked = held(weights.select(key, "term", "weight", "df", level, F.sum(square).over(after).alias("left")))
    inside = F.col("left") >= threshold * threshold - 1e-9
    # of each text: the first class that its prefix does not hold whole, and the squared weight of each class
    own = ranked.groupBy(key, "level").agg(F.sum(square).alias("mass"), F.min(inside.cast("int")).alias("whole"))
    texts = own.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("whole") == 0, F.col("level"))), F.lit(64)).alias("cut"), F.map_from_entries(F.collect_list(F.struct("level", "mass"))).alias("mass"))
    prefix = held(ranked.where(inside).where("df > 1").select(key, "term", "level", "weight"))
    left = prefix.select(F.col(key).alias("a"), "term", "level", F.col("weight").alias("wa"))
    right = prefix.select(F.col(key).alias("b"), "term", F.col("weight").alias("wb"))
    shared = left.join(right, "term").where("a < b").groupBy("a", "b", "level").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    shared = held(shared.groupBy("a", "b").agg(F.collect_list(F.struct("level", "dot")).alias("dots")))
    texts = held(texts.join(shared.select(F.explode(F.array("a", "b")).alias("k")).distinct(), F.col(key) == F.col("k"), "left_semi"))
    side = lambda k: texts.select(F.col(key).alias(k), F.col("cut").alias(f"cut_{k}"), F.col("mass").alias(f"mass_{k}"))
    rest = lambda k: f"aggregate(filter(map_entries(mass_{k}), e -> e.key >= least(cut_a, cut_b)), 0D, (s, e) -> s + e.value)"
    most = F.expr(f"aggregate(filter(dots, d -> d.level < least(cut_a, cut_b)), 0D, (s, d) -> s + d.dot) + sqrt({rest('a')} * {rest('b')})")
    pairs = shared.join(side("a"), "a").join(side("b"), "b").where(most > threshold - 1e-9).select("a", "b")
    # only the vectors of pairs that are left are joined with them
    pairs = held(pairs)
    named = pairs.select(F.explode(F.array("a", "b")).alias("__k")).distinct()
    ranked = ranked.select(key, "term", "weight").join(named, F.col(key) == F.col("__k"), "left_semi")
    wa = ranked.select(F.col(key).alias("a"), "term", F.col("weight").alias("wa"))
    wb = ranked.select(F.col(key).alias("b"), "term", F.col("weight").alias("wb"))
    scored = pairs.join(wa, "a").join(wb, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    return scored.where(F.col("similarity") > threshold)


def near_pairs(df: DataFrame, key: str, column: str = "text", threshold: float = 0.9, stop: list[str] | None = None) -> DataFrame:
    """(a, b, similarity), a < b: texts whose TF-IDF cosine is over the threshold; every pair, those of copies too."""
    return similar_vectors(tfidf(df, key, column, stop), key, threshold)


def near_dedup(df: DataFrame, key: str, column: str = "text", threshold: float = 0.9, stop: list[str] | None = None) -> DataFrame:
    """Rows without an earlier near copy, by key; a row goes even if its earlier copy went itself. Texts without terms stay.

    Texts with the same terms are one class with one vector, so a group of copies is compared once. A row goes if its
    class, or one near it, has a member of a smaller key.
    """
    return df.join(_later(df, key, column, threshold, stop), F.col(key) == F.col("__key"), "left_anti")


def _later(df: DataFrame, key: str, column: str, threshold: float, stop: list[str] | None) -> DataFrame:
    """__key of the rows that near_dedup drops; df is computed twice."""
    tokens = T.terms(column)
    if stop:
        tokens = T.remove_stop_words(tokens, stop)
    bag = F.array_join(F.array_sort(tokens), " ")
    bags = once(df.select(F.col(key).alias("__key"), F.coalesce(bag, F.lit("")).alias("__bag")), "__bag", F.col("__bag"))
    # terms have no blanks
    size = F.length("__bag") - F.length(F.replace("__bag", F.lit(" "))) + 1
    bags = bags.withColumn("__class", F.when(F.col("__bag") != "", F.unhex(F.sha2("__bag", 256))))
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        named = held(bags.select("__key", "__class", size.alias("size")))
        groups = named.where("__class is not null").groupBy("__class").agg(F.min("__key").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"))
        # ids are in the order of the first keys
        classes = held(groups.orderBy(F.asc_nulls_last("first")).withColumn("id", F.monotonically_increasing_id()))
    total, count = classes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    # bags are wide, and read once: they go straight on into the blocks
    wide = bags.where("__class is not null").groupBy("__class").agg(F.min("__bag").alias("bag"))
    met = earliest_near(wide.join(classes, "__class"), total, count, named.count(), threshold, held)
    firsts = classes.select("id", "__class", "first")
    near = met.join(firsts.select(F.col("id").alias("near"), F.col("first").alias("near_first")), "near").select(F.col("id").alias("c"), "near_first")
    earliest = firsts.join(near, F.col("id") == F.col("c"), "left").select(F.col("__class").alias("k"), F.least("first", F.coalesce("near_first", "first")).alias("earliest"))
    return named.join(held(earliest), F.col("__class") == F.col("k")).where(F.col("__key") > F.col("earliest")).select("__key")


def clean(df: DataFrame, key: str, column: str = "text", low: int = 10, high: int = 1000, threshold: float = 0.9, stop: list[str] | None = None, vector_stop: list[str] | None = None, raw: bool = True) -> DataFrame:
    """The cleaning pipeline: preprocess, drop stop words, filter by length, drop near copies. raw_<column> keeps the input.

    stop: words that leave the texts; vector_stop: words that do not count where texts are compared. Both are the English list unless given.
    raw: if not, only the key and the cleaned text come out, and texts are cleaned once instead of twice.
    """
    # words are split at any white space, so none needs to be collapsed before
    tokens = T.remove_stop_words(T.words(T.remove_punctuation(F.lower(column))), stop if stop is not None else T.english_stop_words())
    ready = length_between(once(df.withColumn(f"raw_{column}", F.col(column)), column, F.array_join(tokens, " ")), low, high, column)
    narrow = held(ready.select(key, column))
    later = _later(narrow, key, column, threshold, vector_stop if vector_stop is not None else T.english_stop_words())
    return (ready if raw else narrow).join(later, F.col(key) == F.col("__key"), "left_anti")


def validation_report(df: DataFrame, column: str = "text", short: int = 10) -> DataFrame:
    """One row of counts; nulls count as rows only."""
    t = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.length(t)).alias("mean_length"),
        F.count_distinct(t).alias("n_unique"),
        F.count_if(F.length(t) < short).alias("n_short"),
        F.count_if(T.has_special(t)).alias("n_special"),
        F.count_if(T.has_digits(t)).alias("n_digits"),
        F.count_if(T.is_upper(t)).alias("n_upper"),
    )


def long_form(df: DataFrame, names: list[str], label: str = "metric", value: str = "value") -> DataFrame:
    """Columns of a report as rows."""
    return df.unpivot([], [F.col(n).cast("double").alias(n) for n in names], label, value)


#: Suffixes by which the quality report takes words for content words, and verb endings.
CONTENT = "(?:ing|ed|tion|ness|ment|able|ful|ous|ive|al|ly|s)$"
VERB = "(?:ing|ed|ize|ise|ate|ify|en)$|^(?:is|are|was|were|be|been|has|have|had|do|does|did|can|could|will|would|shall|should|may|might|must)$"


def quality_report(df: DataFrame, key: str, column: str = "text", vocabulary: list[str] | None = None) -> DataFrame:
    """Per text: words, sentences, mean words a sentence (2 places, 0 without any), unknown words, content words, incomplete sentences.

    Word classes are told by suffix and a list of auxiliaries, in place of a tagger; vocabulary: known words.
    """
    sentences = F.filter(F.split(column, "(?<=[.!?])\\s+"), lambda s: F.trim(s) != "")
    w = T.words(T.remove_punctuation(F.lower(column)))
    alpha = F.filter(w, lambda x: F.rlike(x, F.lit("^\\p{L}+$")))
    known = list(vocabulary or [])
    incomplete = F.filter(sentences, lambda s: (F.size(T.words(s)) < 3) | ~F.exists(T.words(T.remove_punctuation(F.lower(s))), lambda x: F.rlike(x, F.lit(VERB))))
    n, m = F.size(w), F.size(sentences)
    return df.select(
        key,
        n.alias("n_words"),
        m.alias("n_sentences"),
        F.when(m > 0, F.round(n / F.greatest(m, F.lit(1)), 2)).otherwise(0.0).alias("words_per_sentence"),
        F.size(F.filter(alpha, lambda x: ~x.isin(known)) if known else alpha).alias("n_unknown"),
        F.size(F.filter(alpha, lambda x: F.rlike(x, F.lit(CONTENT)))).alias("n_content"),
        F.size(incomplete).alias("n_incomplete"),
    )


def perplexity(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """exp of the mean negative log probability of a text's terms under the table's own add-one unigram counts."""
    tokens = df.select(key, F.explode(T.words(F.lower(column))).alias("term"))
    per = tokens.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy("term").agg(F.sum("n").alias("c"))
    total = counts.agg(F.sum("c").alias("all_words"), F.count(F.lit(1)).alias("vocabulary"))
    p = (F.col("c") + 1) / (F.col("all_words") + F.col("vocabulary"))
    return per.join(counts, "term").crossJoin(F.broadcast(total)).groupBy(key).agg(F.exp(-F.sum(F.col("n") * F.log(p)) / F.sum("n")).alias("perplexity"))


#: Frequent words of the languages that are told apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are as with be this by".split(),
    "fr": "le la les des et un une du est que qui dans pour pas sur avec ce".split(),
    "de": "der die das und ist nicht ein eine zu den von mit für auf im des dem".split(),
    "es": "el los las y un una es que de en por para con no se del al".split(),
}


def _is_one_of(own: list[str]):
    return lambda x: x.isin(own)


def language(c: Column) -> Column:
    """The language whose frequent words the text has most of; 'unknown' without any. Ties go to the first name."""

    def best(w: Column) -> Column:
        scores = [F.struct(F.size(F.filter(w, _is_one_of(own))).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, own) in enumerate(sorted(FUNCTION_WORDS.items()))]
        most = F.array_max(F.array(*scores))
        return F.when(most["n"] > 0, most["name"]).otherwise("unknown")

    # the words stand in an array of one, so that they are found once and counted for every language
    return F.transform(F.array(T.words(T.remove_punctuation(F.lower(c)))), best)[0]


def overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Texts, white space collapsed, that both tables hold; none if splits are disjoint."""
    h = T.text_hash(column).alias("h")
    return left.select(h).intersect(right.select(h))


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Bag union by name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
