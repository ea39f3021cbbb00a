"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame and SQL functions only.

Base spans come from one regular expression for each kind and a check of what it matched. They, and long hexadecimal keys, are
the seeds: the two words left of a seed make a lexical pattern. Every token that looks like an identifier (letters,
digits and signs with a digit or @ among them) is an instance of the pattern left of it. Patterns and instances form a
graph that is scored in rounds: a pattern is as sure as the share of its different instances that are trusted, an
instance is trusted as far as any of its patterns is sure. Patterns that end sure enough, with enough different
instances, add the identifiers behind them as spans of kind "context", unless a base span overlaps them.

Positions are code points. A regular expression gives its matches and, by a split, the gaps between them; their running
lengths, added up in blocks, are the positions, and what stands left of a match is in the gaps and matches before it. Tokens and
base spans are compared in the order of their places. So a text's cost grows with its length, whatever it holds. The expressions below match what their plain forms match: possessive forms and look-behinds
only stop a search from trying starts and lengths that cannot matter, so long runs cost linear time and no stack.

Defined results: null text counts as empty; empty text has no spans and the hash of the empty string; rows that repeat
get equal results; null ids stay null; an empty table gives no rows; further columns, whatever their names, travel along.
A token of fewer than six characters is no identifier, and one without two words in the 2,000 characters before it has no pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
FOUND = "context"
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; a match starts where its run of characters or the last match's end is
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ ; its matches are the longest chains of digits, of which only those of 16 digits and more matter
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the search to be worth while.
GATES = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
SIGN = "A-Za-z._%+/=:-"
IDENTIFIER = rf"(?<![0-9@{SIGN}])(?=[{SIGN}]*+[0-9@])[0-9@{SIGN}]{{6,}}+"
KEY = "^[0-9a-f]{32,}$"
#: Characters left of an instance in which its pattern is looked for first, and then.
REACH = (60, 2000)
#: Numbers that are run through at a time; beyond all places in a text.
RUN = 64
FAR = 2_147_483_647
#: Characters of the parts that a text is cut into where spans are replaced.
PART = 4096
ROUNDS = 3
SURE = 0.6
SUPPORT = 3
SPANS = "array<struct<start:int,end:int,value:string,pattern:string>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL for body, in which name stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, join: str = "{0} + {1}", deep: int = 2) -> str:
    """SQL for the running sums (or what join makes of two) of an array with numbers from 0 on, one at least.

    Arrays cannot be appended to in place, so a block of few numbers is run through at a time, then its blocks' totals.
    """
    step, names = join.format("acc.at", "x"), [f"{n}{deep}" for n in ("part", "run", "to", "i", "z")]
    part, run, to, i, z = names
    plain = lambda v: f"aggregate({v}, named_struct('at', 0, 'out', cast(array() AS array<int>)), (acc, x) -> named_struct('at', {step}, 'out', concat(acc.out, array({step}))), acc -> acc.out)"
    if not deep:
        return plain(values)
    blocks = f"transform(sequence(0, (size({values}) - 1) div {RUN}), {part} -> {plain(f'slice({values}, {part} * {RUN} + 1, {RUN})')})"
    totals = _running(f"transform({run}, {z} -> {z}[size({z}) - 1])", join, deep - 1)
    moved = f"flatten(transform({run}, ({z}, {i}) -> if({i} = 0, {z}, transform({z}, y -> {join.format(f'{to}[{i} - 1]', 'y')}))))"
    # the totals are an array of their own before they are run through
    return _let(blocks, run, _let(totals if deep == 1 else _let(f"transform({run}, {z} -> {z}[size({z}) - 1])", f"sums{deep}", _running(f"sums{deep}", join, deep - 1)), to, moved))


def located(text: str, pattern: str) -> str:
    """SQL for the spans of all matches: start, end (code points), value, and the pattern left of it.

    That is the last two words before it, digits made 0, in the characters next to it, or in more where these hold no two words.
    """
    p = "r'" + pattern.replace("'", "\\'") + "'"

    def left(reach: int, pieces: str) -> str:
        # every match has five characters, so few matches reach far enough
        back = reach // 5 + 1
        before = f"lower(right(concat(array_join(slice({pieces}, greatest(i - {back}, 0) + 1, least(i, {back})), ''), right(gaps[i], {reach})), {reach}))"
        return rf"regexp_replace(regexp_extract({before}, r'(?<!\S)(\S++\s++\S+?)[\s\x22(\[<\x27]*+$', 1), '[0-9]', '0')"

    near, far = REACH
    # without white space there are no two words, however far one looks
    apart = rf"(gaps[i] rlike r'\s' OR blank[greatest(i - 1, 0)] > i - {far // 5 + 1})"
    words = _let(left(near, "close"), "found", f"if(found = '' AND ends[i] - length(v) > {near} AND {apart}, {left(far, 'wide')}, found)")
    spans = f"transform(hits, (v, i) -> named_struct('start', ends[i] - length(v), 'end', ends[i], 'value', v, 'pattern', {words}))"
    blank = _let(r"transform(wide, (x, i) -> if(x rlike r'\s', i + 1, 0))", "spaced", _running("spaced", "greatest({0}, {1})"))
    spans = _let(blank, "blank", spans)
    for reach, name in ((near, "close"), (far, "wide")):
        spans = _let(f"transform(hits, (v, i) -> concat(right(gaps[i], {reach}), right(v, {reach})))", name, spans)
    ends = _let("transform(hits, (v, i) -> length(gaps[i]) + length(v))", "sizes", _running("sizes"))
    spans = _let(f"split({text}, {p}, -1)", "gaps", _let(ends, "ends", spans))
    return _let(f"regexp_extract_all({text}, {p}, 0)", "hits", f"if(size(hits) = 0, cast(array() AS {SPANS}), {spans})")


def free(tokens: str, others: str) -> str:
    """SQL for the tokens that overlap none of the other spans: both run through once, in the order of their places."""
    item = lambda x, kind: f"named_struct('start', {x}.start, 'end', {x}.end, 'kind', {kind}, 'value', {x}.value, 'pattern', {x}.pattern)"
    every = f"array_sort(concat(transform({others}, o -> {item('o', 0)}), transform({tokens}, t -> {item('t', 1)})))"
    most, least = "greatest({0}, {1})", "reverse({0})"
    ends = _let("transform(items, o -> if(o.kind = 0, o.end, 0))", "lasts", _running("lasts", most))
    starts = _let(least.format(f"transform(items, o -> if(o.kind = 0, {FAR} - o.start, 0))"), "firsts", least.format(_running("firsts", most)))
    kept = f"transform(filter(transform(items, (o, i) -> if(o.kind = 1 AND ends[i] <= o.start AND {FAR} - starts[i] >= o.end, o, NULL)), o -> o IS NOT NULL), o -> named_struct('start', o.start, 'end', o.end, 'value', o.value, 'pattern', o.pattern))"
    return f"if(size({others}) = 0 OR size({tokens}) = 0, {tokens}, {_let(every, 'items', _let(ends, 'ends', _let(starts, 'starts', kept)))})"


def _good(kind: str) -> str:
    """SQL for the check of a match x.value."""
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    if kind == "ip":
        return "forall(split(x.value, '[.]'), p -> p rlike '^0*+(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$' OR p rlike '^0++$')"
    if kind == "phone":
        return f"length({digits}) BETWEEN 8 AND 15"
    if kind == "card":
        luhn = f"""aggregate(transform(split(reverse({digits}), ''), (c, i) -> if(c = '', 0, if(i % 2 = 1, 2 * cast(c AS int) - if(cast(c AS int) > 4, 9, 0), cast(c AS int)))), 0, (a, c) -> a + c) % 10 = 0"""
        return f"length({digits}) BETWEEN 16 AND 19 AND {luhn}"
    return "true"


def base_spans(text: str = "z_text") -> dict[str, Column]:
    """For each kind the array of its spans in column `text`."""
    out = {}
    for kind in KINDS:
        found = f"filter({located(text, PATTERNS[kind])}, x -> {_good(kind)})"
        out[kind] = F.expr(f"CASE WHEN {text} rlike r'{GATES[kind]}' THEN {found} ELSE cast(array() AS {SPANS}) END")
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), each kind's spans (start, end) and seen: instances with their patterns."""
    rows = docs.select("doc_id", text_or_empty().alias("z_text")).withColumn("h", F.xxhash64("z_text"))
    rows = rows.withColumns({f"z_{k}": c for k, c in base_spans().items()})
    rows = rows.withColumn("z_base", F.concat(*[F.col(f"z_{k}") for k in KINDS]))
    rows = rows.withColumn("z_token", F.expr(f"CASE WHEN z_text rlike '[0-9@]' THEN {located('z_text', IDENTIFIER)} ELSE cast(array() AS {SPANS}) END"))
    rows = rows.withColumn("z_free", F.expr(free("z_token", "z_base")))

    def instance(x: str, trusted: str, added: str) -> str:
        return f"named_struct('start', {x}.start, 'end', {x}.end, 'pattern', {x}.pattern, 'instance', xxhash64({x}.value), 'trusted', {trusted}, 'free', {added})"

    seen = f"filter(concat(transform(z_base, b -> {instance('b', 'true', 'false')}), transform(z_free, t -> {instance('t', f't.value rlike \'{KEY}\'', 'true')})), s -> s.pattern <> '')"
    spans = [F.transform(f"z_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS]
    return rows.select("doc_id", "h", *spans, F.expr(seen).alias("seen"))


def sure_patterns(instances: DataFrame, rounds: int = ROUNDS, sure: float = SURE, support: int = SUPPORT) -> DataFrame:
    """instances: pattern, instance, trusted. Patterns that the scored graph makes sure: pattern, sureness."""
    edges = instances.groupBy("pattern", "instance").agg(F.max(F.col("trusted").cast("double")).alias("seed"))
    # what is joined is written out first: a join of two tables can be dealt anew where one value has most rows
    edges = cut(edges)
    wide = cut(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support))
    graph = cut(edges.join(wide, "pattern"))
    trust = cut(graph.groupBy("instance").agg(F.max("seed").alias("trust")))
    scored = None
    for k in range(rounds):
        scored = graph.join(trust, "instance").groupBy("pattern", "n").agg((F.sum("trust") / (F.col("n") + 1)).alias("sureness"), F.sum(F.when(F.col("trust") >= 0.5, 1).otherwise(0)).alias("trusted"))
        scored = cut(scored.select("pattern", F.when(F.col("trusted") >= support, F.col("sureness")).otherwise(0.0).alias("sureness")))
        if k < rounds - 1:
            # an instance is mistrusted only if all its patterns are unsure
            doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least(F.col("sureness"), F.lit(0.999)))))
            trust = cut(graph.join(scored, "pattern").groupBy("instance").agg(F.greatest(F.max("seed"), F.lit(1.0) - doubt).alias("trust")))
    return scored.where(F.col("sureness") >= sure).select("pattern", "sureness")


def added_spans(found: DataFrame, **options) -> DataFrame:
    """found: from `measured`. Per text with any: doc_id, h and added, the spans of identifiers behind sure patterns."""
    seen = found.select("doc_id", "h", F.explode("seen").alias("s")).select("doc_id", "h", "s.*")
    sure = sure_patterns(seen.select("pattern", "instance", "trusted"), **options)
    new = seen.where("free").join(sure, "pattern").select("doc_id", "h", F.struct("start", "end").alias("span"))
    return new.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("span")).alias("added"))


def with_spans(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, the spans (start, end) of each kind, and added."""
    found = cut(measured(docs))
    added = added_spans(found, **options).withColumnsRenamed({"doc_id": "a_id", "h": "a_h"})
    joined = found.join(added, found.doc_id.eqNullSafe(added.a_id) & (found.h == added.a_h), "left")
    return joined.select("doc_id", "h", *KINDS, F.coalesce("added", F.expr("cast(array() AS array<struct<start:int,end:int>>)")).alias(FOUND))


def _listed(kinds: tuple[str, ...]) -> Column:
    parts = [F.expr(f"transform({k}, s -> concat('{k}:', s.start, ':', s.end))") for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of personal data replaced by its kind in angle brackets; columns stay as they are."""
    found = with_spans(docs, **options).where(F.size(F.concat(*KINDS, FOUND)) > 0)
    tagged = F.concat(*[F.expr(f"transform({k}, s -> named_struct('start', s.start, 'end', s.end, 'tag', '<{k.upper()}>'))") for k in (*KINDS, FOUND)])
    # spans that overlap are one, under the first one's tag
    opens, closes = "i = 0 OR s.start >= most[i - 1]", "i = size(z_spans) - 1 OR z_spans[i + 1].start >= most[i]"
    firsts = f"filter(transform(z_spans, (s, i) -> if({opens}, s, NULL)), s -> s IS NOT NULL)"
    lasts = f"filter(transform(z_spans, (s, i) -> if({closes}, most[i], NULL)), e -> e IS NOT NULL)"
    joined = f"zip_with({firsts}, {lasts}, (s, e) -> named_struct('start', s.start, 'end', e, 'tag', s.tag))"
    merged = F.expr(_let("transform(z_spans, s -> s.end)", "ends", _let(_running("ends", "greatest({0}, {1})"), "most", joined)))
    spans = found.withColumn("z_spans", F.array_sort(tagged)).withColumn("z_cuts", merged).select(F.col("doc_id").alias("z_id"), F.col("h").alias("z_h"), "z_cuts").dropDuplicates(["z_id", "z_h"])
    # the row travels as one struct, so its names cannot clash with ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("r_id"), F.xxhash64(text_or_empty()).alias("r_h"))
    joined = rows.join(spans, F.col("r_id").eqNullSafe(F.col("z_id")) & (F.col("r_h") == F.col("z_h")), "left")
    # a piece is looked for in the parts of the text that hold it
    piece = f"substring(array_join(slice(parts, at div {PART} + 1, (upto - 1) div {PART} - at div {PART} + 1), ''), at % {PART} + 1, upto - at)"
    before = _let("if(i = 0, 0, z_cuts[i - 1].end)", "at", _let("s.start", "upto", f"if(upto > at, {piece}, '')"))
    rest = _let("z_cuts[size(z_cuts) - 1].end", "at", _let("length(row.text)", "upto", f"if(upto > at, {piece}, '')"))
    pieces = F.expr(_let(f"regexp_extract_all(row.text, r'(?s).{{1,{PART}}}', 0)", "parts", f"concat(array_join(transform(z_cuts, (s, i) -> concat({before}, s.tag)), ''), {rest})"))
    text = F.when(F.col("z_cuts").isNull(), F.col("row.text")).otherwise(pieces)
    joined = joined.withColumn("z_new", text)

    def column(c: str) -> Column:
        if c == "text":
            return F.col("z_new").alias(c)
        if c == "n_chars":
            return F.when(F.col("z_cuts").isNull(), F.col("row.n_chars")).otherwise(F.length("z_new")).cast(docs.schema[c].dataType).alias(c)
        return F.col("row")[c].alias(c)

    return joined.select(*[column(c) for c in docs.columns])


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(KINDS), 256).alias("base_sha256"), _listed((*KINDS, FOUND)).alias("spans"))
