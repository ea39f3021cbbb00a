"""Registered queries of learned models, of VARIANT columns and of the address index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import variants
from ..operators import language_models as M
from ..operators import web
from ..operators.cleaning import held
from ..sources import address_index
from .queries import query, t, word_list
from .shared import WorkFolder


def folded(spark, sf_dir):
    """Documents in two folds by a hash of their id: what a fold's texts say is learned from the other's."""
    fold = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1), 16, 10).cast("int") % 2
    return t(spark, sf_dir, "documents").withColumn("fold", fold)


FOLDED = "f AS (SELECT *, (strpos('0123456789abcdef', md5(doc_id::VARCHAR)[1]) + 1) % 2 AS fold FROM documents)"


@query(f"""WITH {FOLDED},
    w AS (SELECT doc_id, fold, {word_list("lower(text)")} AS ws FROM f),
    z AS (SELECT doc_id, fold, ['', ''] || ws AS ps, unnest(range(len(ws))) AS i FROM w),
    g AS (SELECT doc_id, fold, ps[i + 1] AS g1, ps[i + 2] AS g2, ps[i + 3] AS g3 FROM z),
    c3 AS (SELECT 1 - fold AS fold, g1, g2, g3, count(*) AS c FROM g GROUP BY ALL),
    c2 AS (SELECT fold, g2, g3, count(*) AS c FROM c3 GROUP BY ALL),
    c1 AS (SELECT fold, g3, count(*) AS c FROM c2 GROUP BY ALL),
    t3 AS (SELECT fold, g1, g2, sum(c) AS total, count(*) AS types FROM c3 GROUP BY ALL),
    t2 AS (SELECT fold, g2, sum(c) AS total, count(*) AS types FROM c2 GROUP BY ALL),
    t1 AS (SELECT fold, sum(c) AS total, count(*) AS types FROM c1 GROUP BY ALL),
    l1 AS (SELECT g.*, greatest(coalesce(c, 0) - 0.75::DOUBLE, 0) / total + 0.75::DOUBLE * types / total / (types + 1) AS p1 FROM g JOIN t1 USING (fold) LEFT JOIN c1 USING (fold, g3)),
    l2 AS (SELECT l1.*, coalesce(greatest(coalesce(c, 0) - 0.75::DOUBLE, 0) / total + 0.75::DOUBLE * types / total * p1, p1) AS p2 FROM l1 LEFT JOIN t2 USING (fold, g2) LEFT JOIN c2 USING (fold, g2, g3)),
    l3 AS (SELECT l2.*, coalesce(greatest(coalesce(c, 0) - 0.75::DOUBLE, 0) / total + 0.75::DOUBLE * types / total * p2, p2) AS p3 FROM l2 LEFT JOIN t3 USING (fold, g1, g2) LEFT JOIN c3 USING (fold, g1, g2, g3)),
    s AS (SELECT doc_id, count(*) AS n_words, round(-avg(ln(p3)), 6) AS log_perplexity FROM l3 GROUP BY doc_id)
    SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, log_perplexity FROM documents LEFT JOIN s USING (doc_id)""")
def held_out_perplexity(spark, sf_dir):
    """Every document under the trigram model of the other fold's documents."""
    docs = folded(spark, sf_dir)
    judged = M.held_out_perplexity(docs.withColumn("fold", 1 - F.col("fold")), docs, "doc_id", by="fold")
    return judged.select("doc_id", "n_words", F.round(F.log("perplexity"), 6).alias("log_perplexity"))


def _scripts_sql() -> str:
    count = lambda kind: f"length(regexp_replace(other, '[^{kind}]+', '', 'g'))"
    east = "\\p{Hiragana}\\p{Katakana}\\p{Han}"
    named = " ".join(f"WHEN 2 * {count(f'{chr(92)}p{{{script}}}')} > length(other) THEN '{name}'" for name, script in M.SCRIPTS.items())
    named += f" WHEN 2 * {count(east)} > length(other) THEN CASE WHEN {count(east[:-7])} > 0 THEN 'ja' ELSE 'zh' END"
    return f"CASE WHEN length(letters) = 0 THEN 'unknown' WHEN 2 * length(other) > length(letters) THEN CASE {named} ELSE 'unknown' END END"


GRAMS_SQL = """SELECT DISTINCT fold, word, k, i, substring(CASE WHEN k = 1 THEN word ELSE ' ' || word || ' ' END, i::INTEGER, k::INTEGER) AS gram
      FROM (SELECT fold, word, k, unnest(range(1, length(word) + CASE WHEN k = 1 THEN 1 ELSE 4 - k END)) AS i FROM (SELECT DISTINCT fold, word FROM v), (VALUES (1), (2), (3)) ks(k))"""


@query(f"""WITH {FOLDED},
    d AS (SELECT doc_id, fold, lang, regexp_replace(coalesce(text, ''), '[^\\p{{L}}]+', '', 'g') AS letters, regexp_replace(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]+', '', 'g'), '\\p{{Latin}}+', '', 'g') AS other FROM f),
    u AS (SELECT doc_id, fold, lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM f),
    v AS (SELECT DISTINCT fold, word FROM u), x AS ({GRAMS_SQL}),
    m AS (SELECT 1 - fold AS fold, lang, gram, count(*) AS c FROM u JOIN x USING (fold, word) GROUP BY ALL),
    vs AS (SELECT fold, count(DISTINCT gram) AS v FROM m GROUP BY fold), ns AS (SELECT fold, l.lang, coalesce(sum(c), 0) AS total FROM vs CROSS JOIN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l LEFT JOIN m USING (fold, lang) GROUP BY ALL),
    gs AS (SELECT DISTINCT fold, gram FROM m),
    wt AS (SELECT gs.fold, ns.lang, gs.gram, round(1000 * ln((coalesce(c, 0) + 1) / (total + v)::DOUBLE))::BIGINT AS w FROM gs JOIN ns USING (fold) JOIN vs USING (fold) LEFT JOIN m ON m.fold = gs.fold AND m.lang = ns.lang AND m.gram = gs.gram),
    ws AS (SELECT fold, word, lang, sum(w) AS w FROM x JOIN wt USING (fold, gram) GROUP BY ALL),
    b AS (SELECT u.doc_id, ws.lang, sum(ws.w) AS w FROM u JOIN ws ON ws.fold = u.fold AND ws.word = u.word GROUP BY ALL),
    o AS (SELECT doc_id, lang FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, lang) = 1)
    SELECT d.doc_id, coalesce({_scripts_sql()}, o.lang, 'unknown') AS language FROM d LEFT JOIN o USING (doc_id)""")
def profiled_languages(spark, sf_dir):
    """Every document's language by the profiles of the other fold's documents."""
    docs = folded(spark, sf_dir)
    profiles = M.language_profiles(docs.withColumn("fold", 1 - F.col("fold")), by="fold")
    return M.detected_languages(profiles, docs, "doc_id")


def tool_texts(spark, sf_dir):
    """Every part as a tool that a model can call, in one of five shapes by its number, one of them broken."""
    p, k = t(spark, sf_dir, "part"), F.col("p_partkey") % 5
    size = F.named_struct(F.lit("type"), F.lit("integer"), F.lit("maximum"), "p_size")
    brand = F.named_struct(F.lit("type"), F.lit("string"), F.lit("const"), "p_brand")
    free = F.named_struct(F.lit("description"), F.col("p_name"))
    schema = lambda properties, required: F.named_struct(F.lit("type"), F.lit("object"), F.lit("properties"), properties, F.lit("required"), required)
    full = schema(F.named_struct(F.lit("size"), size, F.lit("brand"), brand), F.array(F.lit("size")))
    tool = lambda name, where, s: F.named_struct(F.lit("name"), name, F.lit("description"), "p_name", F.lit(where), s)
    name = F.concat(F.lit("part_"), F.col("p_partkey").cast("string"))
    wrapped = F.to_json(F.array(F.named_struct(F.lit("type"), F.lit("function"), F.lit("function"), tool(name, "parameters", full))))
    two = F.to_json(F.array(tool(name, "parameters", schema(F.named_struct(F.lit("note"), free), F.array().cast("array<string>"))), tool(F.concat(name, F.lit("b")), "parameters", schema(F.named_struct(F.lit("note"), free), F.array(F.lit("note"))))))
    single = F.to_json(tool(name, "input_schema", full))
    bare = F.to_json(F.array(F.named_struct(F.lit("name"), name)))
    text = F.when(k == 0, wrapped).when(k == 1, two).when(k == 2, F.concat(F.lit("```json\n"), single, F.lit("\n```"))).when(k == 3, bare).otherwise(F.substring(wrapped, 1, 40))
    return p.select("p_partkey", text.alias("tools"))


@query("""WITH p AS (SELECT p_partkey, 'part_' || p_partkey AS name, p_partkey % 5 AS k FROM part)
    SELECT p_partkey, 0 AS pos, name, 'size' AS parameter, 'integer' AS type, true AS required FROM p WHERE k IN (0, 2)
    UNION ALL SELECT p_partkey, 0, name, 'brand', 'string', false FROM p WHERE k IN (0, 2)
    UNION ALL SELECT p_partkey, 0, name, 'note', 'any', false FROM p WHERE k = 1 UNION ALL SELECT p_partkey, 1, name || 'b', 'note', 'any', true FROM p WHERE k = 1""")
def tool_schema_parameters(spark, sf_dir):
    return variants.tool_parameters(tool_texts(spark, sf_dir), "p_partkey")


@query("""SELECT p_partkey, 0 AS pos, 'part_' || p_partkey AS name, CASE WHEN p_partkey % 5 <> 3 THEN p_name END AS description FROM part WHERE p_partkey % 5 < 4
    UNION ALL SELECT p_partkey, 1, 'part_' || p_partkey || 'b', p_name FROM part WHERE p_partkey % 5 = 1""")
def tools_of_rows(spark, sf_dir):
    return variants.tools(tool_texts(spark, sf_dir), "p_partkey").drop("schema")


ANSWER_SQL = """CASE event_id % 5 WHEN 0 THEN '{"accuracy": {"analysis": "' || event_type || '", "score": ' || json_extract_string(props, '$.k') || '}, "style": {"score": "' || (user_id % 7) || '"}}'
      WHEN 1 THEN '{"accuracy": ' || json_extract_string(props, '$.k') || ', "style": ' || (user_id % 7) || ', "more": [' || value || ']}' WHEN 2 THEN '{"accuracy": {"score": ' || json_extract_string(props, '$.k') || '}}'
      WHEN 3 THEN '{"accuracy": {"score": "' || event_type || '"}, "style": {"score": 1}}' ELSE '{"accuracy": {"score": ' END"""


@query(f"""WITH a AS (SELECT event_id, {ANSWER_SQL} AS answer FROM events), v AS (SELECT event_id, CASE WHEN json_valid(answer) THEN answer END AS j FROM a),
    s AS (SELECT event_id, try_cast(coalesce(json_extract_string(j, '$.accuracy.score'), CASE WHEN json_type(j, '$.accuracy') <> 'OBJECT' THEN json_extract_string(j, '$.accuracy') END) AS INTEGER) AS accuracy,
      try_cast(coalesce(json_extract_string(j, '$.style.score'), CASE WHEN json_type(j, '$.style') <> 'OBJECT' THEN json_extract_string(j, '$.style') END) AS INTEGER) AS style FROM v)
    SELECT event_id, CASE WHEN style IS NOT NULL THEN accuracy END AS accuracy, CASE WHEN accuracy IS NOT NULL THEN style END AS style FROM s""")
def judge_answers(spark, sf_dir):
    """Answers of five shapes made of every event's properties, some in fenced blocks."""
    answers = t(spark, sf_dir, "events").withColumn("answer", F.expr(ANSWER_SPARK))
    return variants.judge_scores(answers).select("event_id", "accuracy", "style")


ANSWER_SPARK = """CASE event_id % 5 WHEN 0 THEN concat('```json\\n{"accuracy": {"analysis": "', event_type, '", "score": ', get_json_object(props, '$.k'), '}, "style": {"score": "', user_id % 7, '"}}\\n```')
      WHEN 1 THEN concat('{"accuracy": ', get_json_object(props, '$.k'), ', "style": ', user_id % 7, ', "more": [', value, ']}') WHEN 2 THEN concat('{"accuracy": {"score": ', get_json_object(props, '$.k'), '}}')
      WHEN 3 THEN concat('{"accuracy": {"score": "', event_type, '"}, "style": {"score": 1}}') ELSE '{"accuracy": {"score": ' END"""


@query("""SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, 0::BIGINT AS n_without, 'OBJECT<k: BIGINT>' AS schema, 0::BIGINT AS broken FROM events GROUP BY event_type""")
def shredded_properties(spark, sf_dir):
    """Every event's properties as typed columns, and the schema that all of a type's properties fit in."""
    e = t(spark, sf_dir, "events")
    typed = variants.shredded(e, "props", {"k": ("$.k", "bigint"), "absent": ("$.no.such[0]", "string")})
    sums = typed.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("absent").alias("n_without"))
    return variants.merged_schema(e, "props", "event_type").join(sums, "event_type").select("event_type", "n", "k", "n_without", "schema", "broken")


KEY_SQL = r"""array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www[0-9]*[.]', ''), '.')), ',') || ')' || regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1)"""
PLACES_SQL = f"""k AS (SELECT min(url) AS url, {KEY_SQL} AS key FROM pages GROUP BY ALL)"""


@query(f"""WITH {PLACES_SQL} SELECT 'example.org' AS seed, key, url FROM k WHERE key LIKE 'org,example)%' OR key LIKE 'org,example,%'
    UNION ALL SELECT 'example.com/en', key, url FROM k WHERE regexp_matches(key, '^com,example[,)]') AND regexp_matches(key, '^[^)]*[)]/en/') AND url LIKE '%page=%'""")
def index_seeds(spark, sf_dir):
    """All pages' addresses written as an index; two domains read from it by ranges, one in a folder and by a glob."""
    with WorkFolder(spark) as folder:
        address_index.write_index(t(spark, sf_dir, "pages"), f"{folder}/index")
        org = address_index.seeds(spark, f"{folder}/index", "example.org").select(F.lit("example.org").alias("seed"), "key", "url")
        com = address_index.seeds(spark, f"{folder}/index", "www.example.com", "/en/", "*page=*").select(F.lit("example.com/en").alias("seed"), "key", "url")
        return held(org.union(com))


@query(f"""WITH {PLACES_SQL}, d AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www[0-9]*[.]', '') AS domain FROM pages)
    SELECT domain, count(*) AS n, md5(string_agg(url, ' ' ORDER BY key)) AS urls FROM k JOIN d ON key LIKE array_to_string(list_reverse(string_split(domain, '.')), ',') || ')%' OR key LIKE array_to_string(list_reverse(string_split(domain, '.')), ',') || ',%' GROUP BY domain""")
def addresses_below_hosts(spark, sf_dir):
    """For the host of every page, the addresses on it and on the hosts below it."""
    pages = t(spark, sf_dir, "pages")
    hosts = pages.select(F.regexp_replace(web.host(F.col("url")), "^www[0-9]*[.]", "").alias("domain"))
    index = pages.select(address_index.address_key("url").alias("key"), "url").groupBy("key").agg(F.min("url").alias("url"))
    found = address_index.seeds_of(index, hosts)
    urls = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "url"))), lambda x: x["url"]), " ")
    return found.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.md5(urls).alias("urls"))
