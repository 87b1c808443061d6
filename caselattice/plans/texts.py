"""Queries over texts: tokens, overlaps, hashes and templating."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselattice.functions import scalar as S
from caselattice.operators import lexical as L
from caselattice.operators import runs as R
from caselattice.plans.registry import query
from caselattice.sources import views as X


@query("scl02_tokens", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_tokens, length(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS n_normalized FROM documents")
def scl02(spark, sf):
    t = F.col("text")
    return X.read(spark, sf, "documents").select("doc_id", F.size(S.tokens(t)).cast("long").alias("n_tokens"), F.char_length(S.normalized(t)).cast("long").alias("n_normalized"))


@query("scl04_word_counts", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')) AS n_words FROM documents")
def scl04(spark, sf):
    return X.read(spark, sf, "documents").select("doc_id", S.word_count(F.col("text")).cast("long").alias("n_words"))


@query("agg31_lexical_overlap", """WITH a AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM conversations), p AS (SELECT x.conv_id, x.turn, CASE WHEN len(x.t) = 0 OR len(y.t) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x.t, y.t))::DOUBLE / least(len(x.t), len(y.t)) END AS o FROM a x JOIN a y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)
SELECT conv_id, count(*) AS n, round(avg(o), 6) AS mean_overlap, count(*) FILTER (o >= 0.8) AS n_high FROM p GROUP BY conv_id""")
def agg31(spark, sf):
    """Overlap coefficients of each turn with the next (AGG-31, SCL-05, SET-05, JON-08)."""
    said = X.read(spark, sf, "conversations").select("conv_id", "turn", S.tokens(F.col("text")).alias("t"))
    then = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    pairs = said.join(then, ["conv_id", "turn"]).withColumn("o", S.overlap(F.col("t"), F.col("u")))
    return pairs.groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.avg("o"), 6).alias("mean_overlap"), F.count_if(F.col("o") >= 0.8).alias("n_high"))


@query("agg31c_lexical_pairs", """WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS u FROM benchmark),
p AS (SELECT doc_id, item_id, len(list_intersect(t, u))::DOUBLE / least(len(t), len(u)) AS o FROM d, b WHERE len(t) > 0 AND len(u) > 0)
SELECT doc_id, item_id, round(o, 6) AS overlap FROM p WHERE o >= 0.8""")
def agg31c(spark, sf):
    """All pairs of documents and items of which one holds most tokens of the other (AGG-31, JON-08, SCL-05)."""
    texts = X.read(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), S.tokens(F.col("text")).alias("tokens"))
    items = X.read(spark, sf, "benchmark").select("item_id", S.tokens(F.col("text")).alias("tokens"))
    return L.overlapping(texts, items, 0.8).select(F.col("text_id").alias("doc_id"), "item_id", F.round("overlap", 6).alias("overlap"))


@query("scl08_content_hashes", r"SELECT h, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))) AS h FROM documents) GROUP BY h HAVING count(*) > 1")
def scl08(spark, sf):
    """Groups of texts that are one after normalisation (SCL-08, AGG-40, RND-11)."""
    hashed = X.read(spark, sf, "documents").select("doc_id", S.content_hash(F.col("text")).alias("h"))
    return hashed.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("agg40_distinct_counts", "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids, count(*) - count(DISTINCT sha256(lower(text))) AS n_repeated FROM documents")
def agg40(spark, sf):
    hashed = X.read(spark, sf, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("h"))
    return hashed.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids"), (F.count("*") - F.countDistinct("h")).alias("n_repeated"))


# Whole words by any language's letters; a word goes from its first letter, digit or underscore over these, ' and -.
_MENTION_SQL = ", ".join(f"regexp_matches(text, '(?:^|[^\\p{{L}}\\p{{N}}_]){x}(?:$|[^\\p{{L}}\\p{{N}}_])') AS {x.lower()}" for x in "ABCD")
MENTIONS_SQL = r"SELECT doc_id, lang, chr((65 + doc_id % 5)::INT) AS answer, len(regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_''-]*')) AS n_words, " + _MENTION_SQL + " FROM documents"


def _mentions(spark, sf):
    """Every document as a reasoning, whose answer its id gives; E stands for an answer that is none."""
    d = X.read(spark, sf, "documents").withColumn("answer", F.char(65 + F.col("doc_id") % 5))
    return d.select("doc_id", "lang", S.reasoning_diagnostics(F.col("text"), F.col("answer")).alias("d"))


@query("scl06_label_mentions", f"WITH m AS ({MENTIONS_SQL}) SELECT doc_id, n_words, a AND b AND c AND d AS mentions_all, CASE answer WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d WHEN 'E' THEN false END AS mentions_selected FROM m")
def scl06(spark, sf):
    """Words, whether all four labels and whether the selected one are mentioned as whole words (SCL-06)."""
    return _mentions(spark, sf).select("doc_id", F.col("d.n_words"), F.col("d.mentions_all"), F.col("d.mentions_selected"))


@query("agg15_diagnostics", f"WITH m AS ({MENTIONS_SQL}) SELECT lang, round(sum(n_words)::DOUBLE / count(n_words), 6) AS mean_words, count(*) FILTER (a AND b AND c AND d) AS n_all, round(count(*) FILTER (CASE answer WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE false END)::DOUBLE / count(*), 6) AS selected_rate FROM m GROUP BY lang")
def agg15(spark, sf):
    """Means of the diagnostics of reasonings by language, which stands for a model here (AGG-15, SCL-06)."""
    d = F.col("d")
    return _mentions(spark, sf).groupBy("lang").agg(
        F.round(F.try_divide(F.sum(d["n_words"]).cast("double"), F.count(d["n_words"])), 6).alias("mean_words"),
        F.count_if(d["mentions_all"]).alias("n_all"),
        F.round(S.rate_or_zero(d["mentions_selected"]), 6).alias("selected_rate"),
    )


@query("scl01_cjk_counts", """WITH rows AS (SELECT doc_id, text AS question, 'abc 漢字' AS options FROM documents UNION ALL SELECT -1 - doc_id, CASE doc_id % 3 WHEN 0 THEN '㐀漢a字' WHEN 1 THEN 'アab한' ELSE left(text, 5) || '鿿䶿中' END, NULL FROM documents)
SELECT doc_id, (coalesce(length(regexp_replace(question, '[^㐀-䶿一-鿿]', '', 'g')), 0) + coalesce(length(regexp_replace(options, '[^㐀-䶿一-鿿]', '', 'g')), 0))::BIGINT AS n FROM rows""")
def scl01(spark, sf):
    """Chinese characters over the fields of a row: all documents beside a title, and as many rows of literal text (SCL-01)."""
    d = X.read(spark, sf, "documents").select("doc_id", "text")
    made = F.when(F.col("doc_id") % 3 == 0, "㐀漢a字").when(F.col("doc_id") % 3 == 1, "アab한").otherwise(F.concat(F.left("text", F.lit(5)), F.lit("鿿䶿中")))
    rows = d.select("doc_id", F.col("text").alias("question"), F.lit("abc 漢字").alias("options")).unionByName(d.select((-1 - F.col("doc_id")).alias("doc_id"), made.alias("question"), F.lit(None).cast("string").alias("options")))
    count = lambda c: F.coalesce(S.cjk_count(F.col(c)), F.lit(0))
    return rows.select("doc_id", (count("question") + count("options")).cast("long").alias("n"))


@query("scl12_rendered_turns", "SELECT conv_id, string_agg(role || ': ' || text, ' | ' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def scl12(spark, sf):
    """Rows joined into one text by template (SCL-12, SCL-14)."""
    part = F.format_string("%s: %s", F.col("role"), F.col("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", part.alias("s"))))
    return X.read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["s"]), " | ").alias("rendered"))


@query("scl15_derived_ids", "SELECT DISTINCT replace(source, 'src', 'origin_') AS renamed, regexp_replace(source, '[0-9]+$', '') AS stem FROM documents")
def scl15(spark, sf):
    return X.read(spark, sf, "documents").select(F.replace("source", F.lit("src"), F.lit("origin_")).alias("renamed"), F.regexp_replace("source", "[0-9]+$", "").alias("stem")).distinct()


@query("flt20_paired_equality", "SELECT a.doc_id, a.lang = b.lang AS same_lang, a.n_chars IS NOT DISTINCT FROM b.n_chars AS same_length FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0")
def flt20(spark, sf):
    """Formal fields of paired rows, null-safe (FLT-20)."""
    d = X.read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    pair = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("lang_b"), F.col("n_chars").alias("n_b"))
    return d.filter("doc_id % 2 = 0").join(pair, "doc_id").select("doc_id", (F.col("lang") == F.col("lang_b")).alias("same_lang"), F.col("n_chars").eqNullSafe(F.col("n_b")).alias("same_length"))


@query("scl14_shown_answers", """SELECT conv_id, turn, 'Agent ' || role || ' said: ' || CASE WHEN trim(coalesce(text, ''), E' \\t\\n\\r') = '' THEN 'UNPARSED' ELSE trim(text, E' \\t\\n\\r') END AS shown FROM conversations""")
def scl14(spark, sf):
    """Prompt lines with a fixed word where there is nothing to show (SCL-14)."""
    return X.read(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("Agent "), "role", F.lit(" said: "), S.shown(F.col("text"), "UNPARSED")).alias("shown"))


@query("rnd11_unused_texts", r"WITH h AS (SELECT doc_id, sha256(lower(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))) AS h FROM documents), used AS (SELECT DISTINCT h FROM h WHERE doc_id % 5 = 0) SELECT min(doc_id) AS doc_id FROM h WHERE doc_id % 5 <> 0 AND h NOT IN (SELECT h FROM used) GROUP BY h")
def rnd11(spark, sf):
    """New texts whose hash no used text has, one of each (RND-11): ids that 5 divides stand for the texts used before."""
    hashed = X.read(spark, sf, "documents").select("doc_id", S.content_hash(F.coalesce("text", F.lit(""))).alias("h"))
    used = hashed.filter("doc_id % 5 = 0").select("h").distinct()
    return hashed.filter("doc_id % 5 != 0").join(used, "h", "left_anti").groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("agg37_source_quality_interval", """WITH l AS (SELECT d.source AS cluster, count(*) FILTER (quality = 1) AS top, count(*) AS bottom FROM labels JOIN documents d USING (doc_id) GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS pos, count(*) OVER () AS size FROM l),
w AS (SELECT r, ('0x' || substr(md5('17|all|' || r || '|' || d), 1, 8))::UBIGINT % size AS pos FROM (SELECT DISTINCT size FROM p), (SELECT unnest(range(5000)) AS r), (SELECT unnest(range((SELECT count(*) FROM p))) AS d)),
s AS (SELECT r, sum(top)::DOUBLE / nullif(sum(bottom), 0) AS rate FROM w JOIN p ON p.pos = w.pos GROUP BY r)
SELECT round(list_sort(list(rate))[floor(0.025 * (count(*) - 1))::INT + 1], 6) AS lower, round(list_sort(list(rate))[floor(0.975 * (count(*) - 1))::INT + 1], 6) AS upper FROM s""")
def agg37(spark, sf):
    """Percentile interval of the rate of good labels over 5,000 resamples of sources (AGG-37). The windows are over sources."""
    joined = X.read(spark, sf, "labels").join(X.read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    clusters = joined.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("top"), F.count("*").alias("bottom")).withColumn("scope", F.lit("all"))
    whole = W.partitionBy("scope")
    placed = clusters.withColumns({"pos": F.row_number().over(whole.orderBy("source")) - 1, "size": F.count("*").over(whole)})
    return R.cluster_bootstrap(placed, "scope", "top", "bottom", 5000).select("lower", "upper")
