"""Registered queries: each takes (spark, sf_dir); SQL holds its DuckDB twin under the same name where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.constants import EXTRACTION_STOPWORDS, KEYWORD_STOPWORDS
from shelfgraph.functions import scalars as S
from shelfgraph.operators import analysis, community, graph, similarity, tables, text
from shelfgraph.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# ---- keywords and text -------------------------------------------------------------------------------------

_KEYWORDS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM w),
c AS (SELECT doc_id, token, count(*) AS n, min(pos) AS first FROM t
  WHERE length(token) > 2 AND token NOT IN {_in(KEYWORD_STOPWORDS)} AND NOT regexp_matches(token, '^\p{{Nd}}+$') GROUP BY ALL)
SELECT doc_id AS id, rank, token AS keyword, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first)::INT AS rank FROM c) WHERE rank <= 10"""


@query("keyword_top10", _KEYWORDS)
def keyword_top10(spark, d):
    return text.top_keywords(table(spark, d, "documents"))


_TFIDF = rf"""
w AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2 AND x NOT IN {_in(EXTRACTION_STOPWORDS)}) AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term),
kept AS (SELECT term, df, n FROM df, (SELECT count(*) AS n FROM w) WHERE df >= 2 AND df <= 0.95 * n ORDER BY total DESC, term LIMIT 25000),
raw AS (SELECT id, term, tf, df, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS raw FROM tf JOIN kept USING (term)),
tfidf AS (SELECT id, term, tf, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)"""


@query("tfidf_weights", f"WITH {_TFIDF} SELECT id, term, tf, df, round(weight, 6) AS weight FROM tfidf")
def tfidf_weights(spark, d):
    return text.tfidf(table(spark, d, "documents")).withColumn("weight", F.round("weight", 6))


_TOP = ", top AS (SELECT id, rank, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term)::INT AS rank FROM tfidf) WHERE rank <= 10)"


def _top_terms(spark, d):
    weights = text.tfidf(table(spark, d, "documents"), best=10).withColumn("weight", F.round("weight", 9))
    return text.top_terms(weights)


@query("tfidf_top_terms", f"WITH {_TFIDF}{_TOP} SELECT id, rank, term, round(round(weight, 9), 6) AS weight FROM top")
def tfidf_top_terms(spark, d):
    return _top_terms(spark, d).withColumn("weight", F.round("weight", 6))


_RAKE = rf"""
rw AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+') AS ws FROM documents),
rt AS (SELECT id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM rw),
rp AS (SELECT id, pos, word, sum(CASE WHEN word IN {_in(EXTRACTION_STOPWORDS)} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS phrase, word IN {_in(EXTRACTION_STOPWORDS)} AS stop FROM rt),
ph AS (SELECT id, phrase, min(pos) AS pos, string_agg(word, ' ' ORDER BY pos) AS text, count(DISTINCT word) AS degree FROM rp WHERE NOT stop GROUP BY ALL),
fr AS (SELECT id, word, count(*) AS freq FROM rp WHERE NOT stop GROUP BY ALL),
dg AS (SELECT id, word, sum(degree) AS degree FROM (SELECT DISTINCT id, phrase, word FROM rp WHERE NOT stop) JOIN ph USING (id, phrase) GROUP BY id, word),
rs AS (SELECT p.id, p.phrase, sum(degree / freq) AS score FROM rp p JOIN fr USING (id, word) JOIN dg USING (id, word) WHERE NOT stop GROUP BY ALL),
rake AS (SELECT id, text AS phrase, score, pos, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, pos)::INT AS rank FROM rs JOIN ph USING (id, phrase))"""


@query("rake_phrases", f"WITH {_RAKE} SELECT id, rank, phrase, round(score, 6) AS score FROM rake WHERE rank <= 10")
def rake_phrases(spark, d):
    return text.rake(table(spark, d, "documents")).withColumn("score", F.round("score", 6))


@query("hybrid_keywords", rf"""WITH {_TFIDF}{_TOP}, {_RAKE},
both_ AS (SELECT id, 0 AS source, rank, term AS keyword FROM top UNION ALL SELECT id, 1, rank, phrase FROM rake WHERE rank <= 10),
firsts AS (SELECT *, row_number() OVER (PARTITION BY id, regexp_replace(lower(keyword), '[^\p{{L}}\p{{N}}_]', '', 'g') ORDER BY source, rank) AS f FROM both_)
SELECT id, r AS rank, keyword FROM (SELECT id, keyword, row_number() OVER (PARTITION BY id ORDER BY source, rank)::INT AS r FROM firsts WHERE f = 1) WHERE r <= 10""")
def hybrid_keywords(spark, d):
    return text.hybrid_keywords(table(spark, d, "documents"))


# RE2 knows word boundaries of ASCII alone, so letters and digits of other scripts become underscores first
_MENTIONS = r"""
m AS (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(regexp_replace(text, '[^\x00-\x7F\P{L}]', '_', 'g'), '[^\x00-\x7F\P{N}]', '_', 'g'), '\b([A-Z][a-z]+(?:[\t-\r\x1c-\x20\x{85}\p{Z}]+[A-Z][a-z]+){0,3})\b', 1), lambda x: length(x) >= 3) AS ms FROM documents)"""


@query("mention_citations", f"""
WITH {_MENTIONS}, idx AS (SELECT DISTINCT lower(trim(ms[1])) AS key, doc_id AS target_id FROM m WHERE len(ms) > 0),
e AS (SELECT doc_id, unnest(ms) AS mention, unnest(range(len(ms))) AS pos FROM m)
SELECT doc_id AS source_id, target_id, arg_min(mention, pos) AS mention FROM e JOIN idx ON lower(trim(mention)) = key WHERE doc_id <> target_id GROUP BY ALL""")
def mention_citations(spark, d):
    docs = table(spark, d, "documents")
    index = docs.select(F.get(text.mentions(F.col("text")), 0).alias("name"), F.lit("work").alias("target_type"), F.col("doc_id").alias("target_id")).where("name IS NOT NULL")
    sources = docs.select(F.lit("work").alias("source_type"), F.col("doc_id").alias("source_id"), "text")
    return text.citations(sources, index).select("source_id", "target_id", "mention")


@query("mentions", f"WITH {_MENTIONS} SELECT doc_id, len(ms)::INT AS n, array_to_string(ms, '|') AS mentions FROM m")
def mentions(spark, d):
    found = table(spark, d, "documents").select("doc_id", text.mentions(F.col("text")).alias("ms"))
    return found.select("doc_id", F.size("ms").alias("n"), F.array_join("ms", "|").alias("mentions"))


# ---- filters, samples, joins -------------------------------------------------------------------------------


@query("english_filter", "SELECT doc_id, lang FROM documents WHERE starts_with(lower(trim(lang)), 'en') OR trim(lang) = '1'")
def english_filter(spark, d):
    return table(spark, d, "documents").where(S.is_english("lang")).select("doc_id", "lang")


@query("language_enforce", """
WITH works AS (SELECT doc_id AS work_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE NULL END AS language, doc_id + CASE WHEN doc_id % 5 = 0 THEN 100000000 ELSE 0 END AS best_id FROM documents),
ed AS (SELECT doc_id AS book_id, doc_id AS work_id, lang AS language FROM documents UNION ALL SELECT -doc_id - 1, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'eng' ELSE 'fre' END FROM documents),
any_ AS (SELECT work_id, bool_or(starts_with(lower(language), 'en')) AS any_en FROM ed GROUP BY work_id)
SELECT w.work_id, w.language FROM works w LEFT JOIN ed b ON b.book_id = w.best_id LEFT JOIN any_ a ON a.work_id = w.work_id
WHERE CASE WHEN coalesce(w.language, '') <> '' THEN starts_with(w.language, 'en') WHEN b.book_id IS NOT NULL THEN starts_with(b.language, 'en') ELSE coalesce(any_en, false) END""")
def language_enforce(spark, d):
    docs = table(spark, d, "documents")
    works = docs.select(F.col("doc_id").alias("work_id"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("language"), (F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 100000000).otherwise(0)).alias("best_id"))
    one = docs.select(F.col("doc_id").alias("book_id"), F.col("doc_id").alias("work_id"), F.col("lang").alias("language"))
    two = docs.select((-F.col("doc_id") - 1).alias("book_id"), F.col("doc_id").alias("work_id"), F.when(F.col("doc_id") % 2 == 0, "eng").otherwise("fre").alias("language"))
    return tables.enforce_english(works, one.unionByName(two)).select("work_id", "language")


@query("required_fields_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IS NOT NULL AND trim(o_orderstatus) <> '' AND trim(o_orderpriority) <> '' AND o_orderdate IS NOT NULL")
def required_fields_filter(spark, d):
    return tables.filled(table(spark, d, "orders"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate").select("o_orderkey", "o_orderpriority")


@query("sample_hash", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 200")
def sample_hash(spark, d):
    return tables.sample(table(spark, d, "orders"), "o_orderkey", 200, 42).select("o_orderkey")


@query("semi_chain", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50))""")
def semi_chain(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, d, "orders").join(big, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("anti_existing", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_existing(spark, d):
    known = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(known, "c_custkey", "left_anti").select("c_custkey")


@query("best_edition_fallback", """
WITH best AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 4),
firsts AS (SELECT l_orderkey, arg_min(l_partkey, struct_pack(l := l_linenumber, p := l_partkey)) AS p FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(min(b.l_partkey), min(f.p)) AS partkey FROM orders LEFT JOIN best b ON b.l_orderkey = o_orderkey LEFT JOIN firsts f ON f.l_orderkey = o_orderkey GROUP BY o_orderkey HAVING min(f.p) IS NOT NULL""")
def best_edition_fallback(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    each = lines.groupBy("o_orderkey").agg(F.min(F.when(F.col("l_linenumber") == 4, F.col("l_partkey"))).alias("best"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first"))
    return table(spark, d, "orders").select("o_orderkey").join(each, "o_orderkey").select("o_orderkey", F.coalesce("best", "first").alias("partkey"))


@query("nested_tags_union", "SELECT p_brand, string_agg(DISTINCT tag, ';' ORDER BY tag) AS tags, count(DISTINCT tag) AS n FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY p_brand")
def nested_tags_union(spark, d):
    each = table(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("tag")).distinct()
    return each.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("tag")), ";").alias("tags"), F.count("*").alias("n"))


@query("tag_counter", "SELECT tag, count(*) AS occurrences FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part UNION ALL SELECT lower(p_brand) FROM part) GROUP BY tag")
def tag_counter(spark, d):
    part = table(spark, d, "part")
    return part.select(F.explode(F.split("p_name", " ")).alias("tag")).unionByName(part.select(F.lower("p_brand").alias("tag"))).groupBy("tag").agg(F.count("*").alias("occurrences"))


@query("tag_types", "SELECT tag, string_agg(DISTINCT kind, ';' ORDER BY kind) AS tag_type FROM (SELECT unnest(string_split(p_name, ' ')) AS tag, 'shelf' AS kind FROM part UNION ALL SELECT unnest(string_split(lower(p_type), ' ')), 'keyword' FROM part) GROUP BY tag")
def tag_types(spark, d):
    part = table(spark, d, "part")
    both = part.select(F.explode(F.split("p_name", " ")).alias("tag"), F.lit("shelf").alias("kind")).unionByName(part.select(F.explode(F.split(F.lower("p_type"), " ")).alias("tag"), F.lit("keyword").alias("kind")))
    return both.groupBy("tag").agg(F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("tag_type"))


@query("distinct_years", "SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders WHERE o_orderdate IS NOT NULL")
def distinct_years(spark, d):
    return table(spark, d, "orders").where("o_orderdate IS NOT NULL").select(F.year("o_orderdate").alias("year")).distinct()


# ---- scalars -----------------------------------------------------------------------------------------------


@query("match_key", r"SELECT page_id, trim(regexp_replace(lower(url), '[^\p{L}\p{N}]+', ' ', 'g')) AS key, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS ascii_key FROM pages")
def match_key(spark, d):
    return table(spark, d, "pages").select("page_id", S.match_key("url").alias("key"), S.match_key("url", True).alias("ascii_key"))


@query("string_id_clean", "SELECT p_partkey, trim(p_partkey::VARCHAR) AS id, CASE WHEN lower(trim(p_name)) IN ('', '[]', '{}', '()', 'nan', 'none', 'null') THEN NULL ELSE trim(p_name) END AS name FROM part")
def string_id_clean(spark, d):
    return table(spark, d, "part").select("p_partkey", S.string_id("p_partkey").alias("id"), S.clean("p_name").alias("name"))


@query("title_variants", r"""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([t, trim(regexp_replace(t, '\s+', ' ', 'g')), trim(string_split(t, ':')[1]), trim(string_split(t, '(')[1]), trim(regexp_replace(regexp_replace(t, '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))], lambda x: x <> ''))), '|') AS variants
FROM (SELECT p_partkey, p_name || ': ' || p_type || ' (' || p_brand || ')' AS t FROM part)""")
def title_variants(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(": "), "p_type", F.lit(" ("), "p_brand", F.lit(")")).alias("t"))
    return t.select("p_partkey", F.array_join(S.title_variants("t"), "|").alias("variants"))


@query("array_sanitize", r"""
SELECT doc_id, array_to_string(list_filter(ws, lambda w: true), ' ') AS tags FROM (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(string_split(text, ' '), lambda w: lower(trim(w))),
  lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^\p{Nd}+$') AND w NOT IN ('the', 'and') AND NOT contains(w, 'tion')))) AS ws FROM documents)""")
def array_sanitize(spark, d):
    tags = S.clean_strings(F.split("text", " "), exclude=("the", "and"), drop_numeric=True, min_length=3, parts=("tion",))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(tags), " ").alias("tags"))


@query("split_multi", "SELECT n_nationkey, len(list_filter(list_transform(string_split(n_name || '; ;' || n_name, ';'), lambda x: trim(x)), lambda x: x <> ''))::INT AS n FROM nation")
def split_multi(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.size(S.split_multi(F.concat("n_name", F.lit("; ;"), "n_name"))).alias("n"))


@query("shortened_text", r"""
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE (CASE WHEN regexp_extract(t[1:300], '^(.*)\s', 1) <> '' THEN regexp_extract(t[1:300], '^(.*)\s', 1) ELSE t[1:300] END) || '…' END AS preview
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def shortened_text(spark, d):
    return table(spark, d, "documents").select("doc_id", S.shortened("text").alias("preview"))


@query("try_int", r"""
SELECT event_id, CASE WHEN regexp_matches(x, '^[+-]?\d+$') THEN try_cast(x AS INT) END AS strict, try_cast(try_cast(x AS DOUBLE) AS BIGINT)::INT AS year, try_cast(x AS DOUBLE) AS number
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_id::VARCHAR || '.0' WHEN 2 THEN 'x' || event_id ELSE '' END AS x FROM events)""")
def try_int(spark, d):
    e = F.col("event_id").cast("string")
    x = F.when(F.col("event_id") % 4 == 0, e).when(F.col("event_id") % 4 == 1, F.concat(e, F.lit(".0"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("x"), e)).otherwise("")
    return table(spark, d, "events").select("event_id", x.alias("x")).select("event_id", S.safe_int("x").alias("strict"), S.to_year("x").alias("year"), S.to_number("x").alias("number"))


@query("statement_time", r"""
SELECT o_orderkey, CASE WHEN m1 = '' THEN NULL WHEN m2 <> '' THEN m1 || '-' || m2 || '-' || m3 ELSE m1 END AS date_text, CASE WHEN m1 <> '' THEN m1::INT END AS year
FROM (SELECT o_orderkey, regexp_extract(x, p, 1) AS m1, regexp_extract(x, p, 2) AS m2, regexp_extract(x, p, 3) AS m3 FROM (SELECT o_orderkey, '^\+?(\d{4})(?:-(\d{2})-(\d{2}))?' AS p,
  CASE o_orderkey % 3 WHEN 0 THEN '+' || strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') WHEN 1 THEN strftime(o_orderdate, '%Y') ELSE '-0044-03-15' END AS x FROM orders))""".replace("regexp_extract(x, p, ", r"regexp_extract(x, '^\+?(\d{4})(?:-(\d{2})-(\d{2}))?', "))
def statement_time(spark, d):
    k = F.col("o_orderkey") % 3
    x = F.when(k == 0, F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd'T00:00:00Z'"))).when(k == 1, F.date_format("o_orderdate", "yyyy")).otherwise("-0044-03-15")
    t = table(spark, d, "orders").select("o_orderkey", S.statement_time(x).alias("t"))
    return t.select("o_orderkey", F.col("t.text").alias("date_text"), F.col("t.year").alias("year"))


@query("ymd_to_date", "SELECT o_orderkey, try_strptime(printf('%04d-%02d-%02d', 1990 + o_orderkey % 30, 1 + o_orderkey % 13, 1 + o_orderkey % 31), '%Y-%m-%d')::DATE::VARCHAR AS day FROM orders")
def ymd_to_date(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", S.ymd_date((1990 + k % 30).cast("int"), (1 + k % 13).cast("int"), (1 + k % 31).cast("int")).cast("string").alias("day"))


@query("durations", "SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS span FROM (SELECT event_id, (event_id * 37 % 90000)::BIGINT AS s FROM events)")
def durations(spark, d):
    return table(spark, d, "events").select("event_id", S.duration(F.col("event_id") * 37 % 90000).alias("span"))


@query("unique_ignoring_case", """
WITH t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda x: trim(x)) AS ws FROM documents)),
u AS (SELECT doc_id, arg_min(w, pos) AS w, min(pos) AS pos FROM t WHERE w <> '' GROUP BY doc_id, lower(w))
SELECT d.doc_id, count(w) AS n, coalesce(string_agg(w, ' ' ORDER BY pos), '') AS words FROM documents d LEFT JOIN u ON u.doc_id = d.doc_id GROUP BY d.doc_id""")
def unique_ignoring_case(spark, d):
    docs = table(spark, d, "documents").select("doc_id", S.unique_ignoring_case(F.split(F.coalesce("text", F.lit("")), " ")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("words"))


# ---- dedupes, merges, maps ---------------------------------------------------------------------------------


@query("publisher_dedupe", """
WITH s AS (SELECT s_suppkey AS pos, 'publisher_' || s_suppkey AS publisher_id, CASE WHEN s_suppkey % 2 = 0 THEN upper(k) ELSE k || '!' END AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END AS country
  FROM (SELECT *, 'house ' || (s_suppkey % 20) AS k FROM supplier))
SELECT trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key, arg_min(name, pos) AS name, min(publisher_id) AS publisher_id, arg_min(country, pos) FILTER (country IS NOT NULL) AS country FROM s GROUP BY 1""")
def publisher_dedupe(spark, d):
    k = F.concat(F.lit("house "), F.col("s_suppkey") % 20)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("publisher_"), "s_suppkey").alias("publisher_id"), F.when(F.col("s_suppkey") % 2 == 0, F.upper(k)).otherwise(F.concat(k, F.lit("!"))).alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("country"))
    return tables.group_by_key(s, "name", "publisher_id", "pos", firsts=["country"])


@query("tag_dedupe_sum", """
WITH t AS (SELECT p_partkey AS pos, 'tag_' || p_partkey AS tag_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE replace(p_name, ' ', '-') END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'shelf' ELSE 'keyword' END AS tag_type, p_size::BIGINT AS occurrences FROM part)
SELECT trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key, arg_min(name, pos) AS name, min(tag_id) AS tag_id, sum(occurrences)::BIGINT AS occurrences, string_agg(DISTINCT tag_type, ';' ORDER BY tag_type) AS tag_type FROM t GROUP BY 1""")
def tag_dedupe_sum(spark, d):
    p = F.col("p_partkey")
    t = table(spark, d, "part").select(p.alias("pos"), F.concat(F.lit("tag_"), p).alias("tag_id"), F.when(p % 2 == 0, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"), F.when(p % 3 == 0, "shelf").otherwise("keyword").alias("tag_type"), F.col("p_size").cast("long").alias("occurrences"))
    return tables.group_by_key(t, "name", "tag_id", "pos", sums=["occurrences"], unions=["tag_type"])


@query("merge_keep_last", """
SELECT c_custkey, c_name, c_acctbal FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 1)""")
def merge_keep_last(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    inc = base.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") + 1))
    return tables.keep_last(base, inc, ["c_custkey"])


@query("upsert_nodes", """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT 100000000, 'new', NULL""")
def upsert_nodes(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    inc = base.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") + 1)).withColumn("c_name", F.lit(None).cast("string"))
    new = spark.createDataFrame([(100000000, "new", None), (None, "x", None)], "c_custkey long, c_name string, c_acctbal double")
    return tables.upsert(base, inc.unionByName(new), "c_custkey")


_NODES = "(SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)"


@query("merge_rels_counts", f"""
SELECT 'ORDERED_BY' AS relationship, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS attempted,
  (SELECT count(*) FROM (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN {_NODES} AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0))) AS created""")
def merge_rels_counts(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("start"))
    feed = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("end")).join(orders, "l_orderkey").select("start", "end")
    starts = table(spark, d, "customer").where("c_custkey % 4 <> 0").select("c_custkey")
    ends = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey")
    return tables.relationship_counts("ORDERED_BY", feed, tables.merge_relationships(feed, starts, ends))


_RATIO = r"""
n AS (SELECT DISTINCT p_name AS s FROM part), t AS (SELECT s, list_sort(string_split(lower(s), ' ')) AS w FROM n),
c AS (SELECT s, w, list_distinct(list_filter(string_split(array_to_string(w, ' '), ''), lambda x: x <> '')) AS ch FROM t),
ratio AS (SELECT a.s AS source, b.s AS candidate, CASE WHEN a.w = b.w THEN 100.0 ELSE round(50.0 * (len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) + len(list_intersect(a.ch, b.ch)) / len(list_distinct(list_concat(a.ch, b.ch)))), 2) END AS similarity
  FROM c a JOIN c b ON a.s < b.s {on})"""


@query("fuzzy_ratio_blocked", f"WITH {_RATIO.replace('{on}', 'AND lower(a.s[1:1]) = lower(b.s[1:1])')} SELECT source, candidate, similarity FROM ratio WHERE similarity >= 50")
def fuzzy_ratio_blocked(spark, d):
    return tables.similar_names(table(spark, d, "part"), "p_name", 50)


_UNBLOCKED = _RATIO.replace("{on}", "AND len(list_intersect(a.w, b.w)) > 0")


@query("fuzzy_token_pairs", f"WITH {_UNBLOCKED} SELECT source, candidate, similarity FROM ratio WHERE similarity >= 50")
def fuzzy_token_pairs(spark, d):
    return tables.similar_names(table(spark, d, "part"), "p_name", 50, blocked=False)


@query("union_find_canonical", f"""WITH RECURSIVE {_UNBLOCKED}, e AS (SELECT source AS a, candidate AS b FROM ratio WHERE similarity >= 55 UNION SELECT candidate, source FROM ratio WHERE similarity >= 55),
r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
best AS (SELECT a AS source, arg_min(b, struct_pack(l := length(b), n := b)) AS canonical FROM r GROUP BY a)
SELECT source, canonical FROM best WHERE source <> canonical""")
def union_find_canonical(spark, d):
    pairs = tables.similar_names(table(spark, d, "part"), "p_name", 55, blocked=False)
    names = pairs.select(F.explode(F.array("source", "candidate")).alias("name")).distinct()
    return tables.canonical_names(pairs).join(names.withColumnRenamed("name", "source"), "source", "left_semi")


#: Chains of five steps; chains that end in a cycle of two and in a cycle of three.
_MAP = """m AS (SELECT n_nationkey::VARCHAR AS source, (n_nationkey - 5)::VARCHAR AS canonical FROM nation WHERE n_nationkey >= 5
  UNION ALL SELECT unnest(['a', 'b', 'c', 'x', 'y', 'p', 'q', 'r']), unnest(['b', 'c', 'a', 'b', 'x', 'q', 'p', 'q'])),
walk AS (SELECT source, canonical AS at, [source, canonical] AS seen FROM m UNION ALL SELECT w.source, m.canonical, list_append(seen, m.canonical) FROM walk w JOIN m ON m.source = w.at WHERE NOT list_contains(seen, m.canonical)),
ends AS (SELECT source, arg_max(w, len(w.seen)) AS w FROM walk w GROUP BY source),
closed AS (SELECT e.source, coalesce(m.canonical, e.w.at) AS canonical FROM ends e LEFT JOIN m ON m.source = e.w.at)"""


@query("map_closure", f"WITH RECURSIVE {_MAP} SELECT source, canonical FROM closed WHERE source <> canonical")
def map_closure(spark, d):
    chains = table(spark, d, "nation").where("n_nationkey >= 5").select(F.col("n_nationkey").cast("string").alias("source"), (F.col("n_nationkey") - 5).cast("string").alias("canonical"))
    cycles = spark.createDataFrame(list(zip("abcxypqr", "bcabxqpq", strict=True)), "source string, canonical string")
    return tables.map_closure(chains.unionByName(cycles))


@query("apply_merge_map", "SELECT s_suppkey, CASE WHEN s_nationkey >= 5 THEN (s_nationkey % 5)::VARCHAR ELSE s_nationkey::VARCHAR END AS nation FROM supplier")
def apply_merge_map(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"))
    return tables.apply_map(s, "nation", map_closure(spark, d))


# ---- similarity and graph ----------------------------------------------------------------------------------

_PAIRS = """
v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
p AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.e, b.e) / (a.n * b.n) AS score FROM u a JOIN u b ON a.id <> b.id),
ranked AS (SELECT src, dst, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM p WHERE score >= {t}) WHERE rank <= {k}),
edges AS (SELECT least(src, dst) AS source, greatest(src, dst) AS target, max(score) AS score FROM ranked GROUP BY ALL)"""


def _pairs(t: float, k: int) -> str:
    return _PAIRS.replace("{t}", str(t)).replace("{k}", str(k))


def _ranked(spark, d, k: int, t: float) -> DataFrame:
    return similarity.neighbours(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), k, t)


def _edges(spark, d, k: int = 10, t: float = 0.3) -> DataFrame:
    return similarity.edges(_ranked(spark, d, k, t))


def _kept_edges(spark, d, k: int = 10, t: float = 0.3) -> DataFrame:
    """_edges for operators that read them more than once: neighbours are found once."""
    return written(_edges(spark, d, k, t), "edges")


def _nodes(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))


@query("knn_edges", f"WITH {_pairs(0.3, 10)} SELECT source, target, round(score, 6) AS score FROM edges")
def knn_edges(spark, d):
    return _edges(spark, d).withColumn("score", F.round("score", 6))


@query("knn_edges_strict", f"WITH {_pairs(0.35, 10)} SELECT source, target, round(score, 6) AS score FROM edges")
def knn_edges_strict(spark, d):
    return _edges(spark, d, 10, 0.35).withColumn("score", F.round("score", 6))


@query("hybrid_edges", f"""WITH {_TFIDF}, v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
sp AS (SELECT a.id AS src, b.id AS dst, sum(a.weight * b.weight) AS s FROM tfidf a JOIN tfidf b ON a.term = b.term AND a.id <> b.id GROUP BY ALL),
p AS (SELECT a.id AS src, b.id AS dst, 0.9 * list_dot_product(a.e, b.e) / (a.n * b.n) + 0.1 * coalesce(s, 0) AS score FROM u a JOIN u b ON a.id <> b.id LEFT JOIN sp ON sp.src = a.id AND sp.dst = b.id),
ranked AS (SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM p WHERE score >= 0.3) WHERE rank <= 10)
SELECT least(src, dst) AS source, greatest(src, dst) AS target, round(max(score), 6) AS score FROM ranked GROUP BY ALL""")
def hybrid_edges(spark, d):
    weights = text.tfidf_lists(table(spark, d, "documents")).select("id", "terms", "weights")
    vectors = similarity.with_terms(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), weights)
    return similarity.edges(similarity.neighbours(vectors, 10, 0.3, 0.1)).withColumn("score", F.round("score", 6))


@query("param_sweep", f"""WITH {_pairs(0.2, 20)}, g AS (SELECT unnest([0.25, 0.3, 0.35]) AS threshold), h AS (SELECT unnest([5, 10, 20]) AS top_k)
SELECT threshold::DOUBLE AS threshold, top_k::INT AS top_k, count(*) AS edges, count(DISTINCT src) AS sources FROM ranked, g, h WHERE src < dst AND score >= threshold AND rank <= top_k GROUP BY ALL""")
def param_sweep(spark, d):
    cells = similarity.sweep(_ranked(spark, d, 20, 0.2), [0.25, 0.3, 0.35], [5, 10, 20])
    return cells.groupBy("threshold", "top_k").agg(F.count("*").alias("edges"), F.countDistinct("source").alias("sources"))


_REACH = """, both_ AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
reach AS (SELECT id AS a, id AS b FROM u UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a), comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""


@query("components", f"WITH RECURSIVE {_pairs(0.35, 10)}{_REACH} SELECT id, component FROM comp")
def components(spark, d):
    return graph.components(_nodes(spark, d), _edges(spark, d, 10, 0.35))


@query("graph_metrics", f"""WITH RECURSIVE {_pairs(0.35, 10)}{_REACH}, s AS (SELECT component, count(*) AS size FROM comp GROUP BY component),
n AS (SELECT (SELECT count(*) FROM u) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT a) FROM both_) AS works_with_edges, (SELECT count(*) FROM s) AS components, (SELECT max(size) FROM s) AS largest_component)
SELECT *, nodes - works_with_edges AS isolated, 2.0 * edges / nodes AS average_degree, 2.0 * edges / (nodes * (nodes - 1)) AS density, largest_component / nodes AS giant_ratio FROM n""")
def graph_metrics(spark, d):
    return graph.metrics(_nodes(spark, d), _kept_edges(spark, d, 10, 0.35))


_DEGREE = ", deg AS (SELECT id, count(*) AS degree, sum(score) AS w FROM (SELECT source AS id, score FROM edges UNION ALL SELECT target, score FROM edges) GROUP BY id)"


@query("degree_top20", f"WITH {_pairs(0.3, 10)}{_DEGREE} SELECT id, degree, round(w, 6) AS weighted_degree FROM deg ORDER BY degree DESC, id LIMIT 20")
def degree_top20(spark, d):
    return graph.degrees(_edges(spark, d)).orderBy(F.desc("degree"), "id").limit(20).withColumn("weighted_degree", F.round("weighted_degree", 6))


@query("score_stats", f"WITH {_pairs(0.3, 10)} SELECT count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(min(score), 6) AS min, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75, round(max(score), 6) AS max FROM edges")
def score_stats(spark, d):
    s = analysis.describe(_edges(spark, d), "score")
    return s.select("n", *[F.round(c, 6).alias(c) for c in s.columns if c != "n"])


@query("edge_overlap", f"""WITH {_pairs(0.3, 10)}, b AS (SELECT source, target FROM edges WHERE score >= 0.33 UNION SELECT source + 1000000, target + 1000000 FROM edges WHERE score >= 0.36)
SELECT (SELECT count(*) FROM (SELECT source, target FROM edges EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT source, target FROM edges)) AS only_b,
  (SELECT count(*) FROM (SELECT source, target FROM edges INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT source, target FROM edges UNION SELECT * FROM b)) AS total""")
def edge_overlap(spark, d):
    a = _kept_edges(spark, d)
    moved = a.where("score >= 0.36").select((F.col("source") + 1000000).alias("source"), (F.col("target") + 1000000).alias("target"))
    return analysis.edge_overlap(a, a.where("score >= 0.33").select("source", "target").unionByName(moved))


@query("avg_clustering", f"""WITH {_pairs(0.3, 10)}{_DEGREE}, o AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges),
t AS (SELECT x.a AS id, count(*) / 2 AS t FROM o x JOIN o y ON x.b = y.a JOIN o z ON y.b = z.a AND z.b = x.a GROUP BY x.a)
SELECT count(*) AS nodes, sum(coalesce(t, 0))::BIGINT AS corners, round(avg(CASE WHEN coalesce(degree, 0) < 2 THEN 0.0 ELSE 2.0 * coalesce(t, 0) / (degree * (degree - 1)) END), 6) AS clustering FROM u LEFT JOIN deg USING (id) LEFT JOIN t USING (id)""")
def avg_clustering(spark, d):
    c = graph.clustering(_nodes(spark, d), _kept_edges(spark, d))
    return c.agg(F.count("*").alias("nodes"), F.sum("triangles").alias("corners"), F.round(F.avg("clustering"), 6).alias("clustering"))


@query("numeric_assortativity", f"WITH {_pairs(0.3, 10)}, b AS (SELECT source AS s, target AS t FROM edges UNION ALL SELECT target, source FROM edges) SELECT round(corr(x.label, y.label), 6) AS assortativity FROM b JOIN embeddings x ON x.vec_id = s JOIN embeddings y ON y.vec_id = t")
def numeric_assortativity(spark, d):
    values = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("value"))
    return graph.numeric_assortativity(_kept_edges(spark, d), values).select(F.round("assortativity", 6).alias("assortativity"))


_MIX = f"""WITH {_pairs(0.3, 10)}, e AS (SELECT x.label AS x, y.label AS y FROM edges JOIN embeddings x ON x.vec_id = source JOIN embeddings y ON y.vec_id = target),
k AS (SELECT v, count(*)::DOUBLE AS n FROM (SELECT x AS v FROM e UNION ALL SELECT y FROM e) GROUP BY v), s AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS s FROM k), q AS (SELECT avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) AS q FROM e)"""


@query("attr_assortativity", f"{_MIX} SELECT round((q - s) / (1 - s), 6) AS assortativity FROM q, s")
def attr_assortativity(spark, d):
    values = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("value"))
    return graph.attribute_assortativity(_kept_edges(spark, d), values).select(F.round("assortativity", 6).alias("assortativity"))


@query("modularity_of_labels", f"{_MIX} SELECT round(q - s, 6) AS modularity FROM q, s")
def modularity_of_labels(spark, d):
    assigned = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"))
    return graph.modularity(_kept_edges(spark, d), assigned).select(F.round("modularity", 6).alias("modularity"))


@query("betweenness")
def betweenness(spark, d):
    return graph.betweenness(_nodes(spark, d), _kept_edges(spark, d)).withColumn("betweenness", F.round("betweenness", 9))


@query("leiden_communities")
def leiden_communities(spark, d):
    return community.communities(_kept_edges(spark, d), (0.5, 1.0, 2.0))


# ---- cluster analysis --------------------------------------------------------------------------------------


def _members(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster_id")).join(table(spark, d, "documents"), "doc_id")


_MEMBERS = "members AS (SELECT vec_id AS doc_id, label AS cluster_id, text, lang, source, n_chars FROM embeddings JOIN documents ON vec_id = doc_id)"


@query("cluster_size_stats", f"WITH {_MEMBERS}, c AS (SELECT cluster_id, count(*) AS n FROM members GROUP BY 1) SELECT count(*) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, max(n) AS max FROM c")
def cluster_size_stats(spark, d):
    s = analysis.describe(_members(spark, d).groupBy("cluster_id").agg(F.count("*").alias("size")), "size", (0.5, 0.9))
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


_TERMS = ", terms AS (SELECT cluster_id, doc_id, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 4))) AS term FROM members), tc AS (SELECT cluster_id, term, count(*) AS n FROM terms GROUP BY ALL)"


def _with_terms(spark, d) -> DataFrame:
    return _members(spark, d).select("cluster_id", F.col("doc_id").alias("id"), F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 4)).alias("terms"))


@query("top_signal", f"WITH {_MEMBERS}{_TERMS}, s AS (SELECT cluster_id, count(*) AS size FROM members GROUP BY 1), t AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, term) AS r FROM tc) SELECT cluster_id, size, term, n, n / size AS share FROM s JOIN t USING (cluster_id) WHERE r = 1 AND size >= 5")
def top_signal(spark, d):
    return analysis.top_signal(_with_terms(spark, d))


@query("term_purity", f"WITH {_MEMBERS}{_TERMS} SELECT cluster_id, max(n) / sum(n) AS purity FROM tc GROUP BY 1")
def term_purity(spark, d):
    return analysis.term_purity(_with_terms(spark, d))


@query("quality_summary", f"WITH {_MEMBERS}{_TERMS}, s AS (SELECT cluster_id, count(*) AS size FROM members GROUP BY 1), t AS (SELECT cluster_id, max(n) AS n FROM tc GROUP BY 1), x AS (SELECT size, n / size AS share FROM s JOIN t USING (cluster_id) WHERE size >= 5) SELECT count_if(share >= 0.45)::BIGINT AS clusters, sum(CASE WHEN share >= 0.45 THEN size ELSE 0 END)::BIGINT AS works, sum(CASE WHEN share >= 0.45 THEN size ELSE 0 END) / sum(size) AS works_share FROM x")
def quality_summary(spark, d):
    return analysis.quality_summary(analysis.top_signal(_with_terms(spark, d)), 0.45)


@query("top_terms", f"WITH {_MEMBERS}{_TERMS}, t AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, term) AS r FROM tc) SELECT cluster_id, string_agg(term || ' (' || n || ')', ', ' ORDER BY r) AS terms FROM t WHERE r <= 6 GROUP BY 1")
def top_terms(spark, d):
    return analysis.top_terms(_with_terms(spark, d))


_MODE = ", vc AS (SELECT cluster_id, lang, count(*) AS n FROM members WHERE lang IS NOT NULL GROUP BY ALL), pur AS (SELECT cluster_id, arg_min(lang, struct_pack(n := -n, l := lang)) AS dominant, max(n) / sum(n) AS purity, count(*) AS distinct_values FROM vc GROUP BY 1)"


@query("language_purity", f"WITH {_MEMBERS}{_MODE} SELECT * FROM pur")
def language_purity(spark, d):
    return analysis.value_purity(_members(spark, d), "lang")


@query("purity_share", f"WITH {_MEMBERS}{_MODE} SELECT avg(CASE WHEN coalesce(purity, 0) >= 0.4 THEN 1.0 ELSE 0.0 END)::DOUBLE AS share FROM pur")
def purity_share(spark, d):
    return analysis.share_at_least(analysis.value_purity(_members(spark, d), "lang"), "purity", 0.4)


@query("value_shares", "SELECT lang AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 3) AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def value_shares(spark, d):
    return analysis.value_shares(table(spark, d, "documents"), "lang")


@query("year_stats", "SELECT o_orderpriority, avg(y) AS mean, stddev_samp(y) AS std, count(y) AS n, quantile_cont(y, 0.25) AS p25, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.75) AS p75 FROM (SELECT o_orderpriority, year(o_orderdate)::DOUBLE AS y FROM orders) WHERE y BETWEEN 1800 AND 2025 GROUP BY 1")
def year_stats(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", F.year("o_orderdate").cast("double").alias("y")).where("y BETWEEN 1800 AND 2025")
    p = [F.percentile("y", F.lit(q)).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return o.groupBy("o_orderpriority").agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.count("y").alias("n"), *p)


@query("pivot_grid", "SELECT o_orderstatus, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent, avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def pivot_grid(spark, d):
    p = table(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).avg("o_totalprice")
    return p.select("o_orderstatus", F.col("`1-URGENT`").alias("urgent"), F.col("`5-LOW`").alias("low"))


@query("histogram20", "WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(19, floor((o_totalprice - lo) / (hi - lo) * 20))::INT AS bin, count(*) AS n FROM orders, b GROUP BY 1")
def histogram20(spark, d):
    return analysis.histogram(table(spark, d, "orders"), "o_totalprice")


@query("ols_runtime", """
WITH x AS (SELECT l_orderkey, count(*)::DOUBLE AS x, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1), f AS (SELECT greatest(0.0, regr_slope(y, x)) AS b, avg(x) AS mx, avg(y) AS my FROM x), g AS (SELECT b AS slope, greatest(0.0, my - b * mx) AS intercept FROM f)
SELECT round(first(slope), 4) AS slope, round(first(intercept), 4) AS intercept, round(sqrt(avg(power(y - intercept - slope * x, 2))), 4) AS rmse FROM x, g""")
def ols_runtime(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("x"), F.sum("l_extendedprice").alias("y"))
    return analysis.linear_fit(x, "x", "y").select(*[F.round(c, 4).alias(c) for c in ("slope", "intercept", "rmse")])


@query("cluster_profile", f"""WITH {_MEMBERS}, t AS (SELECT DISTINCT cluster_id, source AS t FROM members), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY t) AS r FROM t)
SELECT m.cluster_id, m.size, string_agg(t, chr(10) ORDER BY r) AS titles FROM (SELECT cluster_id, count(*) AS size FROM members GROUP BY 1) m JOIN r ON r.cluster_id = m.cluster_id AND r.r <= 5 GROUP BY 1, 2""")
def cluster_profile(spark, d):
    return analysis.cluster_profile(_members(spark, d), "source")


@query("coverage_success", f"""WITH {_pairs(0.3, 10)}, c AS (SELECT (SELECT count(*) FROM u) / (SELECT count(*) FROM documents) AS e, (SELECT count(DISTINCT id) FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges)) / (SELECT count(*) FROM u) AS g)
SELECT 'embedding_coverage' AS metric, e AS value, 0.9::DOUBLE AS threshold, e >= 0.9 AS met FROM c UNION ALL SELECT 'graph_coverage', g, 0.3, g >= 0.3 FROM c""")
def coverage_success(spark, d):
    c = analysis.coverage(_nodes(spark, d), table(spark, d, "documents"), _edges(spark, d))
    return analysis.success(c, {"embedding_coverage": 0.9, "graph_coverage": 0.3})


@query("fuzzy_edit_ratio")
def fuzzy_edit_ratio(spark, d):
    from shelfgraph.functions.fuzzy import edit_pairs

    return edit_pairs(table(spark, d, "part"), "p_name", 30).withColumns({c: F.round(c, 4) for c in ("sort_ratio", "set_ratio")})
