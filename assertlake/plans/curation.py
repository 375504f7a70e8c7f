"""Queries of curation: keys, deduplication, contamination, merges, splits and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assertlake.functions import keys, predicates
from assertlake.operators import curate, splits
from assertlake.plans.tables import ASSERTIONS, SQL_SPACE, assertions, lines, sql_digest, sql_lines, sql_squeezed, sql_strip, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


BODY = sql_digest(sql_squeezed("text"))


@query(f"""
WITH d AS (SELECT *, {BODY} AS h FROM documents),
b AS (SELECT DISTINCT {BODY} AS h FROM benchmark),
l AS (SELECT DISTINCT id FROM {sql_lines("documents", "doc_id")} WHERE line IN (SELECT line FROM {sql_lines("benchmark", "item_id")})),
k AS (SELECT d.* FROM d WHERE h NOT IN (SELECT h FROM b) AND doc_id NOT IN (SELECT id FROM l) QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1)
SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM k GROUP BY lang
""")
def clean_pool_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents -> body keys -> anti joins with the benchmark (whole bodies, lines) -> the first of each body -> counts by language."""
    docs = table(spark, sf_dir, "documents").withColumn("h", keys.body_hash("text"))
    bench = table(spark, sf_dir, "benchmark").select(keys.body_hash("text").alias("h"))
    leaked = curate.within(lines(spark, sf_dir, "documents", "doc_id"), lines(spark, sf_dir, "benchmark", "item_id"), ["line"]).select(F.col("id").alias("doc_id"))
    pool = docs.select("doc_id", "lang", "n_chars", "h").join(leaked.distinct(), "doc_id", "left_anti")
    first = curate.keep_first(curate.without(pool, bench, ["h"]), "h", "doc_id")
    return first.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""
SELECT doc_id, {BODY} AS body_hash, {sql_digest("lower(" + sql_squeezed("text") + ")")} AS body_hash_ci,
  CASE WHEN regexp_replace(coalesce(text, ''), '{SQL_SPACE}+', '', 'g') = '' THEN '' ELSE substr(md5(lower(regexp_replace(coalesce(text, ''), '{SQL_SPACE}+', '', 'g'))), 1, 16) END AS canon_hash,
  {sql_digest(sql_strip("source") + " || '|||' || " + sql_strip("text"))} AS sample_hash, {sql_digest("coalesce(text, '')")} AS raw_hash,
  {sql_digest(f"regexp_replace(coalesce(text, ''), '{SQL_SPACE}+', ' ', 'g')")} AS partial_hash, {sql_digest("coalesce(text, '') || '|||' || coalesce(source, '')")} AS cache_key,
  {sql_digest(sql_squeezed("text") + " || '|||' || " + sql_squeezed("source"))} AS cache_key_normalised
FROM documents
""")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.identities(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "text", "source").drop("text", "source")


_BARE = r"regexp_replace(regexp_replace(coalesce(sva, ''), '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g')"


@query(f"""SELECT id, CASE WHEN {sql_squeezed(_BARE)} = '' THEN '' ELSE {sql_digest(sql_squeezed(_BARE))} END AS audit_hash,
{sql_digest("'{\"nl\": \"\", \"rtl\": \"\", \"sva\": \"' || sva || '\"}'")} AS row_hash FROM {ASSERTIONS}""")
def audit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assertions(spark, sf_dir).withColumn("none", F.lit(""))
    return a.select("id", keys.audit_hash("sva").alias("audit_hash"), keys.row_hash([], "none", "none", "sva").alias("row_hash"))


@query(f"SELECT doc_id, source, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY {BODY} ORDER BY doc_id) = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", keys.body_hash("text").alias("h"))
    return curate.keep_first(d, "h", "doc_id").drop("h")


@query(f"SELECT doc_id, source, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY {BODY} ORDER BY doc_id DESC) = 1")
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", keys.body_hash("text").alias("h"))
    return curate.keep_last(d, "h", "doc_id").drop("h")


@query(f"""
WITH d AS (SELECT doc_id, source, lang, {BODY} AS h, CASE WHEN length({sql_strip("lang")}) >= 10 THEN 4 ELSE 0 END + CASE WHEN n_chars >= 500 THEN 2 WHEN n_chars > 0 THEN 1 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END AS score FROM documents LEFT JOIN labels USING (doc_id))
SELECT min(doc_id) AS doc_id, string_agg(source, '+' ORDER BY doc_id) AS source, arg_max(lang, struct_pack(s := score, o := -doc_id)) AS lang, max(score) AS score FROM d GROUP BY h
""")
def dedup_keep_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    score = F.when(F.length(keys.strip("lang")) >= 10, 4).otherwise(0) + F.when(F.col("n_chars") >= 500, 2).when(F.col("n_chars") > 0, 1).otherwise(0) + F.when(F.col("quality").isNotNull(), 1).otherwise(0)
    rows = d.select("doc_id", "source", "lang", keys.body_hash("text").alias("h"), score.alias("score"), F.col("doc_id").alias("ord"))
    return curate.keep_richest(rows, "h", F.col("score"), "ord", "doc_id", "source").select("doc_id", "source", "lang", "score")


@query("""
WITH d AS (SELECT *, coalesce(quality, 0) AS q FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, arg_max(doc_id, struct_pack(q := q, n := n_chars, o := -doc_id)) AS doc_id, arg_max(n_chars, struct_pack(q := q, n := n_chars, o := -doc_id)) AS n_chars FROM d GROUP BY source
""")
def dedup_best_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("source", "doc_id", "n_chars", F.coalesce("quality", F.lit(0)).alias("q"))
    return curate.best_by(d, "source", [F.col("q"), F.col("n_chars")], "doc_id").select("source", "doc_id", "n_chars")


@query(f"""
WITH r AS (SELECT id AS ord, sva, customer, 'f' || (id % 3) AS source, CASE WHEN id % 4 = 0 THEN 'Create a SVA assertion that checks: ' || id WHEN id % 4 = 1 THEN '' ELSE 'that ' || id END AS nl, repeat('x', (id % 7)::INT) AS rtl_context, (id % 6)::INT AS expected_tcl FROM {ASSERTIONS}),
k AS (SELECT *, customer % 50 AS k FROM r),
e AS (SELECT k, arg_min(nl, ord) AS nl, arg_min(source, ord) AS src FROM k WHERE nl <> '' AND NOT starts_with(nl, 'Create a SVA assertion that checks:') GROUP BY k),
a AS (SELECT k, arg_min(nl, ord) AS nl, arg_min(source, ord) AS src FROM k WHERE nl <> '' GROUP BY k),
t AS (SELECT k, arg_min(expected_tcl, ord) AS tcl, min(ord) AS o FROM k WHERE expected_tcl <> 0 GROUP BY k),
x AS (SELECT k, arg_max(rtl_context, struct_pack(n := length(rtl_context), o := -ord)) AS rtl, arg_max(source, struct_pack(n := length(rtl_context), o := -ord)) AS src FROM k WHERE rtl_context <> '' GROUP BY k),
c AS (SELECT k, count(*) FILTER (ord > o AND expected_tcl <> 0 AND expected_tcl <> tcl) AS n, string_agg(source, ',' ORDER BY ord) AS p FROM k LEFT JOIN t USING (k) GROUP BY k)
SELECT k, coalesce(e.nl, a.nl, '') AS nl, e.nl IS NOT NULL AS nl_engineer, coalesce(e.src, a.src) AS nl_source, coalesce(x.rtl, '') AS rtl_context, x.src AS rtl_source, coalesce(t.tcl, 0) AS expected_tcl, c.p AS provenance, c.n AS n_conflicts
FROM c LEFT JOIN e USING (k) LEFT JOIN a USING (k) LEFT JOIN t USING (k) LEFT JOIN x USING (k)
""")
def merge_fieldwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    nl = F.when(i % 4 == 0, F.concat(F.lit("Create a SVA assertion that checks: "), i.cast("string"))).when(i % 4 == 1, "").otherwise(F.concat(F.lit("that "), i.cast("string")))
    rows = assertions(spark, sf_dir).select(
        i.alias("ord"), (F.col("customer") % 50).alias("k"), F.concat(F.lit("f"), (i % 3).cast("string")).alias("source"), nl.alias("nl"),
        F.repeat(F.lit("x"), (i % 7).cast("int")).alias("rtl_context"), (i % 6).cast("int").alias("expected_tcl"),
    )
    return curate.merge_fieldwise(rows, "k", "ord").withColumn("provenance", F.array_join("provenance", ","))


@query(f"""SELECT count(DISTINCT id) AS docs, count(*) AS lines FROM {sql_lines("documents", "doc_id")} WHERE line NOT IN (SELECT line FROM {sql_lines("benchmark", "item_id")})""")
def contamination_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = curate.without(lines(spark, sf_dir, "documents", "doc_id"), lines(spark, sf_dir, "benchmark", "item_id"), ["line"])
    return rest.agg(F.countDistinct("id").alias("docs"), F.count(F.lit(1)).alias("lines"))


@query(f"""SELECT id, line FROM {sql_lines("documents", "doc_id")} WHERE line IN (SELECT line FROM {sql_lines("benchmark", "item_id")})""")
def contamination_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.within(lines(spark, sf_dir, "documents", "doc_id"), lines(spark, sf_dir, "benchmark", "item_id"), ["line"]).select("id", "line")


@query(f"""
WITH l AS (SELECT {sql_digest("line")} AS line, lower(substr(line, 1, 12)) AS head FROM {sql_lines("documents", "doc_id")}), r AS (SELECT {sql_digest("line")} AS line, lower(substr(line, 1, 12)) AS head FROM {sql_lines("benchmark", "item_id")})
SELECT 'line' AS kind, (SELECT count(DISTINCT line) FROM l) AS n_left, (SELECT count(DISTINCT line) FROM r) AS n_right, (SELECT count(*) FROM (SELECT line FROM l INTERSECT SELECT line FROM r)) AS n_both, (SELECT count(*) FROM (SELECT line FROM l INTERSECT SELECT line FROM r)) = 0 AS clean
UNION ALL SELECT 'head', (SELECT count(DISTINCT head) FROM l), (SELECT count(DISTINCT head) FROM r), (SELECT count(*) FROM (SELECT head FROM l INTERSECT SELECT head FROM r)), (SELECT count(*) FROM (SELECT head FROM l INTERSECT SELECT head FROM r)) = 0
""")
def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda name, id_: lines(spark, sf_dir, name, id_).select(keys.digest(F.col("line")).alias("line"), F.lower(F.substring("line", 1, 12)).alias("head"))
    return curate.overlap(own("documents", "doc_id"), own("benchmark", "item_id"), ["line", "head"]).withColumn("clean", F.col("n_both") == 0)


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def survive_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.within(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])


@query("""
WITH r AS (SELECT doc_id AS id, 'new ' || doc_id AS nl_new, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status FROM labels WHERE quality = 1), q AS (SELECT doc_id AS id FROM labels)
SELECT d.doc_id AS id, CASE WHEN r.status = 'ok' THEN r.nl_new ELSE d.lang END AS nl, CASE WHEN r.status = 'ok' THEN 'regenerated' WHEN r.status IS NOT NULL THEN 'regen_failed' WHEN q.id IS NOT NULL THEN 'regen_missing' ELSE 'original' END AS nl_origin
FROM documents d LEFT JOIN r ON r.id = d.doc_id LEFT JOIN q ON q.id = d.doc_id
""")
def regen_merge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    regen = labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("nl_new"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("ok").alias("status"))
    return curate.regen_merge(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("nl")), regen, labels.select(F.col("doc_id").alias("id")))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'L' ELSE lang END AS lang, CASE WHEN l.doc_id IS NOT NULL THEN l.toxic ELSE n_chars END AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "labels").select("doc_id", F.lit("L").alias("lang"), F.col("toxic").cast("long").alias("n_chars"))
    return curate.upsert(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), new, "doc_id")


@query("""
SELECT doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'q1' END, CASE WHEN b.item_id IS NOT NULL THEN 'b' || b.item_id END) AS value, CASE WHEN l.quality = 1 THEN 'label' WHEN b.item_id IS NOT NULL THEN 'bench' END AS by
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id
""")
def cascade_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("q1").alias("v"))
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("v"))
    return curate.first_hit(table(spark, sf_dir, "documents").select("doc_id"), [("label", labels, ["doc_id"], "v"), ("bench", bench, ["doc_id"], "v")])


@query(r"""
WITH p AS (SELECT page_id AS id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages),
k AS (SELECT DISTINCT regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS tail FROM pages WHERE page_id % 2 = 0 UNION SELECT DISTINCT regexp_extract(url, '/([^/?#]*)(?:[?#]|$)', 1) FROM pages WHERE page_id % 3 = 0),
s AS (SELECT id, path, array_to_string(string_split(path, '/')[i:], '/') AS tail FROM (SELECT id, path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM p))
SELECT p.id, p.path, m.match FROM p LEFT JOIN (SELECT id, arg_max(tail, length(tail)) AS match FROM s WHERE tail IN (SELECT tail FROM k) GROUP BY id) m USING (id)
""")
def longest_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    known = pages.where("page_id % 2 = 0").select(F.regexp_extract("url", r"://[^/]*/([^?#]*)", 1).alias("tail")).union(pages.where("page_id % 3 = 0").select(F.regexp_extract("url", r"/([^/?#]*)(?:[?#]|$)", 1)))
    return curate.longest_suffix(pages.select(F.col("page_id").alias("id"), F.regexp_extract("url", r"://([^?#]*)", 1).alias("path")), "path", known, "tail")


@query("""
WITH p AS (SELECT s_nationkey AS k, count(*) AS n, min(s_suppkey % 3) AS lo, max(s_suppkey % 3) AS hi FROM supplier GROUP BY 1)
SELECT c_custkey AS id, c_nationkey AS k, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'unique' WHEN lo = hi THEN 'same' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 OR lo = hi THEN lo END AS v FROM customer LEFT JOIN p ON p.k = c_nationkey
""")
def parent_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 3).alias("v"))
    return curate.traced(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k")), parents, "k", "v")


@query("""SELECT n_regionkey AS region, arg_max(n_name, struct_pack(h := h, s := -length(n_name), n := n_name)) AS name, max(h) AS hits
FROM (SELECT *, contains(lower(n_name), 'an')::INT + contains(lower(n_name), 'i')::INT AS h FROM nation) GROUP BY 1""")
def most_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.array(F.lit("an"), F.lit("i")).alias("hints"))
    return curate.most_hints(c, "region", "name", "hints")


@query(f"SELECT doc_id, CASE WHEN (('0x' || {BODY})::UBIGINT % 1000)::INT < 300 THEN 'sft' ELSE 'grpo' END AS split FROM documents")
def split_hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.bucket_split(table(spark, sf_dir, "documents").select("doc_id", "text"), keys.body_hash("text"), 0.3).drop("text")


_SEED = "substr(sha256('7|' || doc_id), 1, 16)"


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_SEED}, doc_id) - 1 < floor((SELECT count(*) FROM documents) * 0.25) THEN 'head' ELSE 'tail' END AS split FROM documents")
def split_seeded_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.fraction_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.25, 7)


@query(f"SELECT doc_id, lang FROM documents ORDER BY {_SEED}, doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100, 7)


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_SEED}, doc_id) AS k FROM documents) WHERE k <= CASE lang WHEN 'en' THEN 30 WHEN 'de' THEN 20 WHEN 'fr' THEN 10 ELSE 0 END")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": 30, "de": 20, "fr": 10}, "doc_id", 7)


@query(f"""
WITH d AS (SELECT doc_id, (doc_id % 5 + 1)::INT AS stage FROM documents), s AS (SELECT stage, greatest(1, floor(count(*) * 0.1)) AS q FROM d GROUP BY stage)
SELECT doc_id, stage, 'current' AS origin FROM d WHERE stage = 3
UNION ALL SELECT doc_id, stage, 'replay' FROM (SELECT d.*, row_number() OVER (PARTITION BY stage ORDER BY {_SEED}, doc_id) AS k FROM d WHERE stage < 3) JOIN s USING (stage) WHERE k <= q
""")
def replay_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.replay_mix(table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5 + 1).cast("int").alias("stage")), "stage", 3, 0.1, "doc_id", 7)


@query("SELECT CASE WHEN coalesce(length(lang), 0) NOT BETWEEN 2 AND 2 THEN 'bad_sva_len' WHEN length(text) < 500 THEN 'short_rtl' ELSE 'kept' END AS drop_reason, count(*) AS n FROM documents GROUP BY 1")
def drop_reason_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(predicates.length_gate("lang", "text", 2, 2), F.lit("kept"))
    return table(spark, sf_dir, "documents").groupBy(reason.alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 3")
def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.top(table(spark, sf_dir, "events"), "event_type", "event_id", 3)


@query("SELECT * FROM (SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 20 ORDER BY p_retailprice DESC, p_partkey LIMIT 25) ORDER BY p_size DESC, p_partkey")
def capped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.candidates(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_retailprice", "p_size", "p_partkey", 20, 25)


@query("SELECT c_custkey AS a, c_name, s_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) LEFT JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) USING (i)")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), "c_name")
    right = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return curate.by_position(left, right, ["a"], ["s_suppkey"]).select("a", "c_name", "s_name")


@query("""SELECT source, string_agg(lang, ',' ORDER BY o) AS refs, count(*) - 1 AS n_extra FROM (
SELECT source, lang, min(o) AS o FROM (SELECT source, min(lang) OVER (PARTITION BY source) AS lang, -1 AS o FROM documents UNION ALL SELECT source, lang, doc_id FROM documents) GROUP BY source, lang) GROUP BY source""")
def multiref_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.lit(0).alias("rank"), "doc_id", "lang")
    # one row for each different text is all that the collection needs
    rows = rows.groupBy("source", "rank", "lang").agg(F.min("doc_id").alias("doc_id"))
    out = curate.collected(rows, "source", "rank", "doc_id", "lang", F.lower("lang"), "lang")
    return out.select("source", F.array_join("refs", ",").alias("refs"), "n_extra")


@query("SELECT 'all' AS op, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) UNION ALL SELECT 'distinct', count(*) FROM (SELECT text FROM documents UNION SELECT text FROM benchmark) UNION ALL SELECT 'intersect', count(*) FROM (SELECT lang FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT lang FROM documents WHERE doc_id % 2 = 1) UNION ALL SELECT 'except', count(*) FROM (SELECT source FROM documents EXCEPT SELECT source FROM documents WHERE n_chars > 500)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    size = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    both = d.select("text").unionByName(b.select("text"))
    out = size("all", both).union(size("distinct", both.distinct()))
    out = out.union(size("intersect", d.where("doc_id % 2 = 0").select("lang").intersect(d.where("doc_id % 2 = 1").select("lang"))))
    return out.union(size("except", d.select("source").subtract(d.where("n_chars > 500").select("source"))))


@query("SELECT repo_id AS id FROM (SELECT s_suppkey AS repo_id FROM supplier) WHERE repo_id NOT IN (SELECT c_nationkey FROM customer UNION SELECT n_nationkey FROM nation UNION SELECT r_regionkey FROM region)")
def waves_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("id")).union(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"))).union(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long")))
    return curate.without(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), done, ["id"])


@query(f"SELECT source AS file, count(DISTINCT {BODY}) AS n_keys, count(DISTINCT {BODY}) FILTER ({BODY} IN (SELECT {BODY} FROM documents WHERE lang = 'en')) AS n_covered, bool_and({BODY} IN (SELECT {BODY} FROM documents WHERE lang = 'en')) AS redundant FROM documents GROUP BY source")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assertlake.operators.evaluate import coverage

    d = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), "lang", keys.body_hash("text").alias("h"))
    return coverage(d, "file", "h", d.where("lang = 'en'"))
