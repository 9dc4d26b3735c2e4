"""The engine's own queries by name, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .functions import text as T
from .operators import classify as K
from .operators import dedupe as D
from .operators import layout as L
from .operators import metadata as M
from .operators import report as R
from .plans.cut import cut, scratch
from .plans.pipeline import analyse
from .plans.ranks import nth_in_group
from .sources import files as S
from .sources.sinks import append_state, flat, put_files
from .sources.tables import table
from .streaming.incremental import arrivals

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, Callable[[], str]] = {}


def query(sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql if callable(sql) else lambda: sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in _SQL.items()}


def _docs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Documents, repeated deliveries once."""
    d = table(spark, folder, "extracted_doc").drop("run_at")
    return (d.select(*columns) if columns else d).distinct()


_D = "d AS (SELECT DISTINCT * EXCLUDE (run_at) FROM extracted_doc)"
_R = "r AS (SELECT DISTINCT * EXCLUDE (run_at) FROM dedup_record)"
_NORM = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"


def _records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    d = table(spark, folder, "dedup_record").drop("run_at")
    return (d.select(*columns) if columns else d).distinct()


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- text


@query(f"WITH {_D} SELECT idx, {_NORM} AS text_norm, sha256({_NORM}) AS text_hash FROM d")
def normalise_text_hash(spark: SparkSession, folder: str) -> DataFrame:
    d = T.normalised(_docs(spark, folder, "idx", "text"), "text")
    return d.select("idx", "text_norm", T.text_hash(F.col("text_norm")).alias("text_hash"))


@query(f"WITH {_D} SELECT idx, lower(regexp_replace(regexp_replace(regexp_replace(file_name, '(.)\\.[^.]*$', '\\1'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-.]+', ' ', 'g')) AS words FROM d")
def filename_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder, "idx", "file_name").select("idx", T.file_words(F.col("file_name")).alias("words"))


_END = "least(CASE WHEN len(string_split(low, chr(10))) >= 3 THEN length(array_to_string(string_split(low, chr(10))[1:3], chr(10))) ELSE length(low) END, 100)"


@query(f"WITH {_D}, x AS (SELECT idx, coalesce(text, '') AS low FROM d) SELECT idx, {_END} AS heading_end FROM x")
def heading_zone(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder, "idx", "text").select("idx", T.heading_end(F.coalesce("text", F.lit(""))).cast("long").alias("heading_end"))


@cache
def _hits_sql() -> str:
    """Hits of each document: of the text, and of the file name as eligible ones."""
    p = _lit(T.alternation(K._TYPE_OF).removeprefix("(?U)"))
    types = ", ".join(f"({_lit(k)}, {_lit(t)})" for k, t in K._TYPE_OF.items())
    return f"""WITH {_D}, kinds(kw, cat) AS (VALUES {types}),
t AS (SELECT idx, lower(coalesce(text, '')) AS low, lower(regexp_replace(regexp_replace(regexp_replace(file_name, '(.)\\.[^.]*$', '\\1'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-.]+', ' ', 'g')) AS nm FROM d),
s AS (SELECT idx, 0 AS part, low AS x, {_END} AS e FROM t UNION ALL SELECT idx, 1, nm, 1000000 FROM t),
m AS (SELECT idx, part, e, regexp_extract_all(x, {p}) AS m, string_split_regex(x, {p}) AS g FROM s),
u AS (SELECT idx, part, e, m, g, unnest(range(1, len(m) + 1)) AS i FROM m),
h AS (SELECT idx, part, i, m[i] AS kw, CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS start, e FROM u),
hits AS (SELECT h.*, cat, start < e AS elig FROM h JOIN kinds USING (kw))"""


@query(lambda: _hits_sql() + " SELECT idx, start, kw, cat AS doc_type FROM hits WHERE part = 0")
def keyword_hits_offsets(spark: SparkSession, folder: str) -> DataFrame:
    h = F.explode(K.keyword_hits(F.lower(F.coalesce("text", F.lit("")))))
    return _docs(spark, folder, "idx", "text").select("idx", h.alias("h")).select("idx", F.col("h.start").cast("long").alias("start"), F.col("h.kw").alias("kw"), F.col("h.cat").alias("doc_type"))


_BODY = ", ".join(_lit(k) for k in C.BODY_TYPES)
_SCORES = f""", counted AS (SELECT * FROM hits WHERE elig OR cat IN ({_BODY})),
per AS (SELECT idx, cat, kw, least(3, count(*)) AS n, bool_or(start < 1500) AS early FROM counted GROUP BY ALL),
scores AS (SELECT idx, cat, CAST(sum(n) + CASE WHEN bool_or(early) THEN 3.0 ELSE 0 END AS DOUBLE) AS score FROM per GROUP BY ALL)"""


@query(lambda: _hits_sql() + _SCORES + " SELECT idx, cat AS doc_type, score FROM scores")
def category_scores(spark: SparkSession, folder: str) -> DataFrame:
    return K.category_scores(_docs(spark, folder, "idx", "text", "file_name"), "idx", "text", "file_name")


def _headed_sql() -> str:
    prio = "[" + ", ".join(_lit(k) for k in C.PRIORITY) + "]"
    return (
        _hits_sql() + _SCORES + f""", head AS (SELECT idx, list(DISTINCT cat) FILTER (cat <> 'Contracts') AS spec, bool_or(cat = 'Contracts') AS ca FROM hits WHERE elig GROUP BY idx),
k AS (SELECT head.idx, spec, CASE WHEN coalesce(len(spec), 0) = 1 THEN spec[1] WHEN coalesce(len(spec), 0) = 0 THEN 'Contracts' END AS one FROM head),
best AS (SELECT k.idx, arg_max(s.cat, s.score * 1000 - list_position({prio}, s.cat)) AS cat FROM k JOIN scores s ON s.idx = k.idx AND list_contains(k.spec, s.cat) WHERE one IS NULL GROUP BY k.idx),
w AS (SELECT k.idx, coalesce(one, best.cat) AS cat, one IS NOT NULL AS sure FROM k LEFT JOIN best USING (idx))
SELECT w.idx, w.cat AS doc_type, score + CASE WHEN sure THEN 100 ELSE 0 END AS score, CASE WHEN sure OR score >= 6 THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, NOT sure AND score < 2 AS needs_review
FROM w JOIN scores s ON s.idx = w.idx AND s.cat = w.cat"""
    )


@query(_headed_sql)
def classify_headed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a type in the heading or the file name."""
    return K.classify(_docs(spark, folder, "idx", "text", "file_name"), headed_only=True).select("idx", "doc_type", "score", "confidence", "needs_review")


@query()
def classify_docs(spark: SparkSession, folder: str) -> DataFrame:
    return K.classify(_docs(spark, folder, "idx", "text", "file_name")).select("idx", "doc_type", "score", "confidence", "needs_review", F.array_join("matched_terms", ", ").alias("matched_terms"))


@query()
def fuzzy_heading(spark: SparkSession, folder: str) -> DataFrame:
    d = cut(K.classify(_docs(spark, folder, "idx", "text", "file_name")).drop("text"), "types").where(F.try_element_at("matched_terms", F.lit(1)).startswith("fuzzy:"))
    return d.select("idx", "doc_type", "score", F.try_element_at("matched_terms", F.lit(1)).alias("term"))


@query(f"SELECT idx, doc_type, CASE WHEN doc_type IN ({', '.join(_lit(k) for k in C.EXCLUDED_TYPES)}) THEN 'excluded' ELSE 'retained' END AS status FROM (SELECT DISTINCT idx, doc_type FROM classification_result)")
def initial_status(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "classification_result", "idx", "doc_type").distinct().withColumn("status", K.initial_status(F.col("doc_type")))


@query(f"WITH {_D} SELECT idx, round_even(size_bytes / 1024.0, 1) AS size_kb, coalesce(length(text), 0) AS text_len, coalesce(error, '') AS extract_error FROM d")
def size_kb(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder, "idx", "size_bytes", "text", "error").select("idx", K.size_kb(F.col("size_bytes")).alias("size_kb"), F.length(F.coalesce("text", F.lit(""))).alias("text_len"), F.coalesce("error", F.lit("")).alias("extract_error"))


# ---- metadata

_CLEAN = "regexp_replace(regexp_replace({}, '\\s+', ' ', 'g'), '^[ ,.\\-\\t\\n]+|[ ,.\\-\\t\\n]+$', '', 'g')"


def _re2(p: str) -> str:
    flags, rest = p[2 : p.index(")")], p[p.index(")") + 1 :]
    return _lit(("(?i)" if "i" in flags else "") + rest)


def _entity_sql() -> str:
    lab, bet, ent = _re2(M.LABEL), _re2(M.BETWEEN), _re2(M.ENTITY)
    c = _CLEAN.format
    return f"""WITH {_D}, t AS (SELECT idx, coalesce(text, '') AS x FROM d),
p AS (SELECT idx, x, {c(f"regexp_extract(x, {bet}, 1)")} AS a, {c(f"regexp_extract(x, {bet}, 2)")} AS b FROM t)
SELECT idx, substring(CASE WHEN regexp_matches(x, {lab}) THEN {c(f"regexp_extract(x, {lab}, 1)")}
WHEN regexp_matches(x, {bet}) THEN CASE WHEN regexp_matches(a, {ent}) THEN a WHEN regexp_matches(b, {ent}) THEN b ELSE a END
WHEN regexp_matches(x, {ent}) THEN {c(f"regexp_extract(x, {ent}, 1)")} ELSE '' END, 1, 80) AS entity_name FROM p"""


@query(_entity_sql)
def entity_from_label(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder, "idx", "text").select("idx", M.entity_name(F.coalesce("text", F.lit(""))).alias("entity_name"))


def _date_words_sql() -> str:
    lab, date = _re2(M.DATE_LABEL), _re2(M.DATE)
    return f"""WITH {_D}, t AS (SELECT idx, coalesce(text, '') AS x FROM d), l AS (SELECT idx, x, CASE WHEN regexp_matches(x, {lab}) THEN regexp_extract(x, {lab}, 1) END AS y FROM t)
SELECT idx, CASE WHEN y IS NOT NULL THEN CASE WHEN regexp_matches(y, {date}) THEN regexp_extract(y, {date}, 1) ELSE y END WHEN regexp_matches(x, {date}) THEN regexp_extract(x, {date}, 1) END AS date_words FROM l"""


@query(_date_words_sql)
def date_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder, "idx", "text").select("idx", M.date_words(F.coalesce("text", F.lit(""))).alias("date_words"))


def _contract_date_sql() -> str:
    """The usual forms; and of what the lenient parser makes of others, a lone number
    that may be a day, with a month or without."""
    months = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
    return f"""WITH pd AS ({_plain_date_sql()}), dw AS ({_date_words_sql()}), y AS (SELECT d.idx, date_words AS w, plain_date AS p, regexp_extract_all(date_words, '\\d+') AS nums, greatest(1, coalesce(list_position({months}, regexp_extract(date_words, '{"|".join(months)}')), 1)) AS m FROM dw d LEFT JOIN pd USING (idx))
SELECT idx, CASE WHEN w IS NULL THEN '' WHEN p IS NOT NULL THEN p WHEN len(nums) = 1 AND TRY_CAST(nums[1] AS INT) BETWEEN 1 AND 31 THEN '2000-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(nums[1], 2, '0') ELSE substring({_CLEAN.format("w")}, 1, 20) END AS contract_date FROM y"""


@query(_contract_date_sql)
def contract_date(spark: SparkSession, folder: str) -> DataFrame:
    return M.contract_date(_docs(spark, folder, "idx", "text")).select("idx", "contract_date")


def _plain_date_sql() -> str:
    w = "regexp_replace(regexp_replace(regexp_replace(trim(date_words), '(?i)^(\\d{1,2})(?:st|nd|rd|th)\\b', '\\1'), '\\s+', ' ', 'g'), ',', '', 'g')"
    forms = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(w, {_lit(shape)}) THEN try_strptime(w, {_lit(fmt)}) END" for shape, fmt in (
        (r"^\d{4}-\d{2}-\d{2}$", "%Y-%m-%d"), (r"^\d{1,2} [A-Za-z]{3,9} \d{4}$", "%d %B %Y"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "%d %b %Y"), (r"^[A-Za-z]{3,9} \d{1,2} \d{4}$", "%B %d %Y"), (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "%b %d %Y"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "%m/%d/%Y"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "%d/%m/%Y"))) + ")"
    return f"WITH q AS ({_date_words_sql()}), z AS (SELECT idx, {w} AS w FROM q WHERE date_words IS NOT NULL) SELECT idx, strftime({forms}, '%Y-%m-%d') AS plain_date FROM z"


@query(_plain_date_sql)
def plain_dates(spark: SparkSession, folder: str) -> DataFrame:
    d = _docs(spark, folder, "idx", "text").select("idx", M.date_words(F.coalesce("text", F.lit(""))).alias("w")).where("w is not null")
    return d.select("idx", F.date_format(M.plain_date(F.col("w")), "yyyy-MM-dd").alias("plain_date"))


_CL = _CLEAN.format
_LINES = "list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda x: " + _CL("x") + ")"


@query(f"WITH {_D}, l AS (SELECT idx, text, list_filter({_LINES}, lambda x: length(x) >= 15) AS l FROM d) SELECT idx, substring(CASE WHEN len(l) > 0 THEN l[1] ELSE {_CL("coalesce(text, '')")} END, 1, 160) AS description FROM l")
def description_line(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder, "idx", "text").select("idx", M.description(F.coalesce("text", F.lit(""))).alias("description"))


def _first_sql(words) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(text), {_lit(w.lower())}) THEN {_lit(v)}" for w, v in words) + " ELSE '' END"


@query(lambda: f"WITH {_D} SELECT idx, {_first_sql([(w, w) for w in C.MARKETS])} AS market, {_first_sql([(w, w) for w in C.SECTORS])} AS sector, {_first_sql([(w, w) for w in C.TEAMS])} AS servicing_team FROM d")
def market_sector_team(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, folder, "idx", "text").select("idx", M.first_of(t, C.MARKETS).alias("market"), M.first_of(t, C.SECTORS).alias("sector"), M.first_of(t, C.TEAMS).alias("servicing_team"))


@query(lambda: f"WITH {_D} SELECT idx, {_first_sql(C.CURRENCIES.items())} AS currency FROM d")
def currency_code(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder, "idx", "text").select("idx", M.currency(F.col("text")).alias("currency"))


# ---- duplicates


def _exact_sql(key: str, rule: str = "true") -> str:
    return f"""WITH {_R}, k AS (SELECT *, count(*) OVER w AS n, first_value(idx) OVER (w ORDER BY idx) AS anchor_idx, first_value(file_name) OVER (w ORDER BY idx) AS anchor FROM r WHERE {key} <> '' AND {rule} WINDOW w AS (PARTITION BY {key}))
SELECT idx, anchor_idx, dense_rank() OVER (ORDER BY anchor_idx) AS gid, anchor, idx <> anchor_idx AS duplicate FROM k WHERE n > 1"""


def _exact(spark: SparkSession, folder: str, key: str, rule: str = "true") -> DataFrame:
    r = _records(spark, folder, "idx", "file_name", key, "text_len").where(rule).withColumn("status", F.lit("retained"))
    g = D.exact_groups(r, key).withColumnRenamed(key, "_k")
    return r.join(g, F.col(key) == F.col("_k")).select("idx", "anchor_idx", "gid", F.col("anchor_name").alias("anchor"), (F.col("idx") != F.col("anchor_idx")).alias("duplicate"))


@query(_exact_sql("text_sha256", "text_len > 0"))
def exact_text_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Only a record with a text can have the same text as another."""
    return _exact(spark, folder, "text_sha256", "text_len > 0")


@query(_exact_sql("file_sha256"))
def exact_file_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Records without a text, such as empty files, count here."""
    return _exact(spark, folder, "file_sha256")


@query(f"WITH {_R}, g AS (SELECT text_sha256, count(*) AS members, min(idx) AS anchor_idx FROM r WHERE text_sha256 <> '' AND text_len > 0 GROUP BY 1 HAVING count(*) > 1) SELECT members, count(*) AS n, sum(members) AS records FROM g GROUP BY 1")
def exact_dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    r = _records(spark, folder, "idx", "file_name", "text_sha256", "text_len").where("text_len > 0").withColumn("status", F.lit("retained"))
    return D.exact_groups(r, "text_sha256").groupBy("members").agg(F.count("*").alias("n"), F.sum("members").alias("records"))


def _near_docs(spark: SparkSession, folder: str) -> DataFrame:
    """One record of each normalised text of a type, as the exact tiers leave them."""
    r = _records(spark, folder, "idx", "doc_type", "text_norm").where("doc_type is not null and length(text_norm) >= 80")
    return r.groupBy("doc_type", "text_norm").agg(F.min("idx").alias("idx"))


_ND = f"{_R}, nd AS (SELECT doc_type, text_norm, min(idx) AS idx FROM r WHERE doc_type IS NOT NULL AND length(text_norm) >= 80 GROUP BY ALL)"
_TFIDF = f"""WITH {_ND}, w AS (SELECT idx, doc_type, ' ' || unnest(list_filter(string_split(text_norm, ' '), lambda x: x <> '')) || ' ' AS w FROM nd),
g AS (SELECT idx, doc_type, unnest(list_concat(
 list_transform(range(1, greatest(2, length(w) - 1)), lambda p: substring(w, p, 3)),
 CASE WHEN length(w) >= 4 THEN list_transform(range(1, length(w) - 2), lambda p: substring(w, p, 4)) ELSE [] END,
 CASE WHEN length(w) >= 5 THEN list_transform(range(1, length(w) - 3), lambda p: substring(w, p, 5)) ELSE [] END)) AS g FROM w),
tf AS (SELECT idx, doc_type, g, count(*) AS tf FROM g GROUP BY ALL),
n AS (SELECT doc_type, count(*) AS n FROM nd GROUP BY ALL), df AS (SELECT doc_type, g, count(*) AS df FROM tf GROUP BY ALL),
v AS (SELECT idx, doc_type, g, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN n USING (doc_type) JOIN df USING (doc_type, g)),
u AS (SELECT idx, doc_type, g, w / sqrt(sum(w * w) OVER (PARTITION BY idx)) AS w FROM v)"""


@query(_TFIDF + " SELECT idx, doc_type, count(*) AS grams, round(sum(w), 6) AS total, round(max(w), 6) AS heaviest FROM u GROUP BY ALL")
def char_ngram_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    v = D.vector_sums(_near_docs(spark, folder), "idx", "doc_type", "text_norm")
    return v.select("idx", F.col("block").alias("doc_type"), "grams", F.round("total", 6).alias("total"), F.round("heaviest", 6).alias("heaviest"))


def _cosine_sql(least: float) -> str:
    return _TFIDF + f" SELECT a.idx AS idx_a, b.idx AS idx_b, round(sum(a.w * b.w), 4) AS similarity FROM u a JOIN u b ON a.doc_type = b.doc_type AND a.g = b.g AND a.idx < b.idx GROUP BY 1, 2 HAVING sum(a.w * b.w) >= {least}"


def _cosine(spark: SparkSession, folder: str, least: float) -> DataFrame:
    return D.cosine_pairs(_near_docs(spark, folder), "idx", "doc_type", "text_norm", least).withColumn("similarity", F.round("similarity", 4))


@query(_cosine_sql(0.9))
def near_dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """At the threshold of records read natively."""
    return _cosine(spark, folder, 0.9)


@query(_cosine_sql(0.8))
def near_dup_pairs_ocr(spark: SparkSession, folder: str) -> DataFrame:
    """At the threshold of records of which one is read by OCR."""
    return _cosine(spark, folder, 0.8)


def _jaccard_sql(least: float) -> str:
    return f"""WITH {_ND}, w AS (SELECT DISTINCT idx, doc_type, unnest(string_split(text_norm, ' ')) AS w FROM nd), x AS (SELECT * FROM w WHERE w <> ''), n AS (SELECT idx, count(*) AS n FROM x GROUP BY 1),
c AS (SELECT a.idx AS idx_a, b.idx AS idx_b, count(*) AS c FROM x a JOIN x b ON a.doc_type = b.doc_type AND a.w = b.w AND a.idx < b.idx GROUP BY ALL)
SELECT idx_a, idx_b, round(c / (p.n + q.n - c), 6) AS similarity FROM c JOIN n p ON p.idx = idx_a JOIN n q ON q.idx = idx_b WHERE c / (p.n + q.n - c) >= {least}"""


def _jaccard(spark: SparkSession, folder: str, least: float) -> DataFrame:
    return D.jaccard_pairs(_near_docs(spark, folder), "idx", "doc_type", "text_norm", least).withColumn("similarity", F.round("similarity", 6))


@query(_jaccard_sql(0.9))
def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _jaccard(spark, folder, 0.9)


@query(_jaccard_sql(0.8))
def jaccard_pairs_ocr(spark: SparkSession, folder: str) -> DataFrame:
    return _jaccard(spark, folder, 0.8)


def _tiers(spark: SparkSession, folder: str, cfg: C.Dedupe) -> DataFrame:
    own = ("idx", "file_name", "doc_type", "text_norm", "file_sha256", "text_sha256", "entity_name", "contract_date", "extraction_method", "text_len")
    r = _records(spark, folder, *own).withColumn("status", K.initial_status(F.coalesce("doc_type", F.lit(""))))
    return D.deduplicate(cut(r, "records"), cfg, last=True).select("idx", "status", "is_duplicate", "duplicate_of", "dup_group_id", "dup_method", "similarity", "cluster_id")


@query()
def near_dup_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """The three tiers over all records, each starting afresh."""
    return _tiers(spark, folder, C.Dedupe())


def _strict_sql() -> str:
    """The tiers one after the other; the last one by a recursion, record by record."""
    gone = ", ".join(_lit(k) for k in C.EXCLUDED_TYPES)
    grams = _TFIDF[_TFIDF.index("w AS (SELECT idx") :].replace("doc_type", "blk")
    return f"""WITH RECURSIVE r AS (SELECT DISTINCT idx, file_name, doc_type, text_norm, file_sha256, text_sha256, entity_name, contract_date, extraction_method, text_len FROM dedup_record),
r0 AS (SELECT *, CASE WHEN coalesce(doc_type, '') IN ({gone}) THEN 'excluded' ELSE 'retained' END AS st0 FROM r),
k1 AS (SELECT file_sha256, min(idx) AS a1, row_number() OVER (ORDER BY min(idx)) AS g1 FROM r0 WHERE st0 = 'retained' AND file_sha256 <> '' GROUP BY 1 HAVING count(*) > 1),
r1 AS (SELECT r0.*, a1, g1, CASE WHEN idx <> a1 THEN 'removed' ELSE st0 END AS st1 FROM r0 LEFT JOIN k1 ON st0 = 'retained' AND r0.file_sha256 = k1.file_sha256),
k2 AS (SELECT text_sha256, min(idx) AS a2, row_number() OVER (ORDER BY min(idx)) + (SELECT coalesce(max(g1), 0) FROM k1) AS g2 FROM r1 WHERE st1 = 'retained' AND text_len > 0 AND text_sha256 <> '' GROUP BY 1 HAVING count(*) > 1),
r2 AS (SELECT r1.*, a2, g2, CASE WHEN idx <> a2 THEN 'removed' ELSE st1 END AS st2 FROM r1 LEFT JOIN k2 ON st1 = 'retained' AND text_len > 0 AND r1.text_sha256 = k2.text_sha256),
last AS (SELECT greatest((SELECT coalesce(max(g1), 0) FROM k1), (SELECT coalesce(max(g2), 0) FROM k2)) AS g),
nd AS (SELECT idx, coalesce(doc_type, '') AS blk, text_norm FROM r2 WHERE st2 = 'retained' AND length(text_norm) >= 80),
{grams},
c AS (SELECT a.idx AS ia, b.idx AS ib, round(sum(a.w * b.w), 12) AS s FROM u a JOIN u b ON a.blk = b.blk AND a.g = b.g AND a.idx < b.idx GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 12) >= 0.8),
e AS (SELECT idx, coalesce(extraction_method = 'ocr', false) AS ocr, lower(trim(coalesce(entity_name, ''), ' ')) AS ent, trim(coalesce(contract_date, ''), ' ') AS dat FROM r2),
p AS MATERIALIZED (SELECT ia, ib, s, s >= CASE WHEN x.ocr OR y.ocr THEN 0.8 ELSE 0.9 END AND (x.ent = '' OR y.ent = '' OR x.ent = y.ent) AND (x.ocr OR y.ocr OR x.dat = '' OR y.dat = '' OR x.dat = y.dat) AS ok FROM c JOIN e x ON x.idx = ia JOIN e y ON y.idx = ib),
seq AS MATERIALIZED (SELECT ib, row_number() OVER (ORDER BY ib) AS n FROM (SELECT DISTINCT ib FROM p)),
step(n, merged, ib, ia, s) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INT[]), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS DOUBLE)
 UNION ALL SELECT n + 1, CASE WHEN best.ok THEN list_append(merged, ib) ELSE merged END, ib, CASE WHEN best.ok THEN -best.na END, best.s
 FROM (SELECT t.n, t.merged, q.ib, max(struct_pack(s := p.s, na := -p.ia, ok := p.ok)) AS best FROM step t JOIN seq q ON q.n = t.n + 1 LEFT JOIN p ON p.ib = q.ib AND NOT list_contains(t.merged, p.ia) GROUP BY t.n, t.merged, q.ib)),
m AS (SELECT ib AS idx, ia, s, row_number() OVER (ORDER BY first, ib) AS n FROM step JOIN nd ON nd.idx = ib JOIN (SELECT blk, min(idx) AS first FROM nd GROUP BY 1) USING (blk) WHERE ia IS NOT NULL),
cl AS (SELECT idx, least(idx, coalesce(a1, idx), coalesce(a2, idx)) AS cluster FROM r2)
SELECT r2.idx, CASE WHEN m.idx IS NOT NULL THEN 'removed' ELSE r2.st2 END AS status, r2.st2 = 'removed' OR m.idx IS NOT NULL AS is_duplicate,
coalesce(an.file_name, CASE WHEN r2.idx <> r2.a2 THEN f2.file_name WHEN r2.idx <> r2.a1 THEN f1.file_name END, '') AS duplicate_of,
CAST(CASE WHEN m.idx IS NOT NULL THEN coalesce(an.g1, an.g2, last.g + m.n) WHEN r2.idx <> r2.a2 THEN r2.g2 ELSE coalesce(r2.g1, r2.g2) END AS INT) AS dup_group_id,
CASE WHEN m.idx IS NOT NULL THEN 'near_dup_tfidf' WHEN r2.idx <> r2.a2 THEN 'exact_text' WHEN r2.idx <> r2.a1 THEN 'exact_file' ELSE '' END AS dup_method,
CASE WHEN m.idx IS NOT NULL THEN round_even(m.s, 4) WHEN r2.st2 = 'removed' THEN 1.0 END AS similarity,
CAST(coalesce(ac.cluster, cl.cluster) AS BIGINT) AS cluster_id
FROM r2 CROSS JOIN last JOIN cl ON cl.idx = r2.idx LEFT JOIN m ON m.idx = r2.idx LEFT JOIN r2 an ON an.idx = m.ia LEFT JOIN cl ac ON ac.idx = m.ia LEFT JOIN r2 f1 ON f1.idx = r2.a1 LEFT JOIN r2 f2 ON f2.idx = r2.a2"""


@query(_strict_sql)
def near_dup_strict(spark: SparkSession, folder: str) -> DataFrame:
    """The three tiers, entities compared letter for letter in records read by OCR,
    too, as SQL can."""
    return _tiers(spark, folder, C.Dedupe(entity_similarity=1.0))


# ---- state of earlier runs

_CUTOFF = "2023-01-01"


def _state_sql(kind: str) -> str:
    return f"WITH {_D}, s AS (SELECT DISTINCT path, size_bytes, mtime FROM extracted_doc WHERE run_at < TIMESTAMP '{_CUTOFF}') SELECT idx, path FROM d {kind} JOIN s USING (path, size_bytes, mtime)"


def _state(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extracted_doc", "path", "size_bytes", "mtime", "run_at").where(F.col("run_at") < F.lit(_CUTOFF).cast("timestamp_ntz"))


@query(_state_sql("SEMI"))
def incremental_hits(spark: SparkSession, folder: str) -> DataFrame:
    return S.unchanged(_state(spark, folder), _docs(spark, folder, "idx", "path", "size_bytes", "mtime")).select("idx", "path")


@query(_state_sql("ANTI"))
def incremental_misses(spark: SparkSession, folder: str) -> DataFrame:
    return S.changed(_docs(spark, folder, "idx", "path", "size_bytes", "mtime"), _state(spark, folder)).select("idx", "path")


_FIELDS = ("entity_name", "contract_date", "description", "market", "sector", "servicing_team", "currency")


@query(f"SELECT idx, run_at, {', '.join(_FIELDS)} FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY run_at DESC, {', '.join(f'{c} DESC NULLS LAST' for c in _FIELDS)}) AS n FROM doc_metadata) WHERE n = 1")
def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """What the last writer of each record left, in all columns."""
    return S.latest(table(spark, folder, "doc_metadata").select("idx", "run_at", *_FIELDS), "idx")


@query(f"WITH {_D} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS idx FROM d")
def path_order(spark: SparkSession, folder: str) -> DataFrame:
    return S.numbered(_docs(spark, folder, "path")).select("path", "idx")


@query(f"""WITH {_D}, c AS (SELECT idx, CASE WHEN extraction_method = 'native_fitz' THEN coalesce(text, '') ELSE '' END AS n,
CASE WHEN extraction_method = 'pdfplumber' THEN coalesce(text, '') ELSE '' END AS s, CASE WHEN extraction_method = 'ocr' THEN coalesce(text, '') ELSE '' END AS o FROM d),
z AS (SELECT *, length(regexp_replace(n, '^\\s+|\\s+$', '', 'g')) AS ln, length(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) AS ls, length(regexp_replace(o, '^\\s+|\\s+$', '', 'g')) AS lo FROM c),
y AS (SELECT *, ln < 120 AND ls > ln AS two, CASE WHEN ln < 120 AND ls > ln THEN ls ELSE ln END AS l2 FROM z)
SELECT idx, CASE WHEN l2 < 120 AND lo > l2 THEN o WHEN two THEN s ELSE n END AS text, CASE WHEN l2 < 120 AND lo > l2 THEN 'ocr' WHEN two THEN 'pdfplumber' ELSE 'native_fitz' END AS extraction_method, l2 < 120 AS is_scanned FROM y""")
def extraction_ladder(spark: SparkSession, folder: str) -> DataFrame:
    d = _docs(spark, folder, "idx", "text", "extraction_method")
    of = lambda m: F.when(F.col("extraction_method") == m, F.col("text"))
    r = S.ladder(of("native_fitz"), of("pdfplumber"), of("ocr"))
    return d.select("idx", r.alias("r")).select("idx", "r.*")


@query(f"""WITH {_D}, n AS (SELECT idx, text, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n FROM d WHERE text IS NOT NULL)
SELECT idx, idx || '.pdf' AS file_name, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS file_sha256, text, 'native_fitz' AS extraction_method, n < 120 AS is_scanned, sha256({_NORM}) AS text_sha256 FROM n""")
def ingest_files(spark: SparkSession, folder: str) -> DataFrame:
    """All texts as files of a folder, which are found, read and hashed."""
    at = scratch(spark, "files")
    d = _docs(spark, folder, "idx", "text").where("text is not null").select(F.col("idx").alias("name"), "text")
    put_files(d.select(F.concat(F.col("name").cast("string"), F.lit(".pdf")).alias("name"), "text"), at)
    found = S.scan(spark, at)
    read = S.extract(S.with_empty(found, S.listing(found)), [("native_fitz", lambda data, source: (data.decode(), 1))])
    return read.select(F.regexp_extract("file_name", r"^(\d+)", 1).cast("int").alias("idx"), "file_name", "size_bytes", "file_sha256", "text", "extraction_method", "is_scanned", "text_sha256")


@query(f"SELECT idx, run_at, {', '.join(_FIELDS)} FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY run_at DESC, {', '.join(f'{c} DESC NULLS LAST' for c in _FIELDS)}) AS n FROM doc_metadata) WHERE n = 1")
def state_as_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The state of all runs as lines of JSON with broken ones among them, read again."""
    at = scratch(spark, "state") + ".jsonl"
    rows = table(spark, folder, "doc_metadata").select("idx", "run_at", *_FIELDS)
    append_state(rows, at)
    spark.createDataFrame([("{broken",), ("",), ("[1, 2",)], "value string").coalesce(1).write.mode("append").text(at)
    return S.latest(S.read_state(spark, at, rows._jdf.schema().toDDL()), "idx")


# ---- layout and report


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    r = _records(spark, folder, "idx", "file_name", "doc_type", "status", "is_duplicate", "duplicate_of", "entity_name", "contract_date", "extraction_method")
    c = table(spark, folder, "classification_result", "idx", "confidence", "needs_review").distinct().groupBy("idx").agg(F.max("confidence").alias("confidence"), F.max("needs_review").alias("needs_review"))
    d = _docs(spark, folder, "idx", "page_count", "is_scanned").groupBy("idx").agg(F.max("page_count").alias("page_count"), F.max("is_scanned").alias("is_scanned"))
    return r.join(c, "idx", "left").join(d, "idx", "left")


_ROWS = f"""{_R}, c AS (SELECT idx, max(confidence) AS confidence, max(needs_review) AS needs_review FROM classification_result GROUP BY idx), e AS (SELECT idx, max(page_count) AS page_count, max(is_scanned) AS is_scanned FROM extracted_doc GROUP BY idx),
t AS (SELECT r.idx, r.file_name, r.doc_type, r.status, r.is_duplicate, r.duplicate_of, r.entity_name, r.contract_date, r.extraction_method, c.confidence, c.needs_review, e.page_count, e.is_scanned FROM r LEFT JOIN c USING (idx) LEFT JOIN e USING (idx))"""
_OTHERS, _GONE = ", ".join(_lit(k) for k in C.OTHER_TYPES), ", ".join(_lit(k) for k in C.EXCLUDED_TYPES)
_NAME = "CASE WHEN {n} = 1 THEN file_name ELSE regexp_replace(file_name, '(.)\\.[^.]+$', '\\1') || '__' || idx || regexp_extract(file_name, '.(\\.[^.]+)$', 1) END"


@query(f"""WITH {_ROWS}, k AS (SELECT *, coalesce(doc_type, 'Unclassified') AS kind, status = 'excluded' AS gone, is_duplicate AND status <> 'excluded' AS dup FROM t),
f AS (SELECT *, CASE WHEN gone THEN '01_classified/_DO_NOT_RETAIN/' || kind WHEN NOT dup THEN '01_classified/' || CASE WHEN kind IN ({_OTHERS}) THEN 'Others' WHEN kind IN ({_GONE}) THEN '_DO_NOT_RETAIN' ELSE kind END || CASE WHEN confidence = 'LOW' OR kind = 'Unclassified' THEN '/_REVIEW' ELSE '' END END AS dir FROM k),
q AS (SELECT *, row_number() OVER (PARTITION BY dir, file_name ORDER BY idx) AS n, sum(CASE WHEN NOT gone AND NOT dup THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY idx) AS m FROM f)
SELECT idx, CASE WHEN dir IS NULL THEN '(not copied — duplicate)' ELSE dir || '/' || {_NAME.format(n="n")} END AS target_folder,
CASE WHEN gone THEN '(not copied — DO NOT RETAIN)' WHEN dup THEN '(not copied — duplicate)' ELSE 'Consolidated/' || {_NAME.format(n="m")} END AS consolidated_path FROM q""")
def layout_plan(spark: SparkSession, folder: str) -> DataFrame:
    return L.layout_plan(_rows(spark, folder)).select("idx", "target_folder", "consolidated_path")


@query(f"WITH {_R}, s AS (SELECT idx, doc_type || regexp_extract(file_name, '.(\\.[^.]+)$', 1) AS file_name FROM r WHERE doc_type IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY idx) AS n FROM s) SELECT idx, {_NAME.format(n='n')} AS name FROM n")
def unique_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names that many files share, one for each type and suffix."""
    r = _records(spark, folder, "idx", "file_name", "doc_type").where("doc_type is not null")
    r = r.select("idx", F.concat("doc_type", F.regexp_extract("file_name", r"(?<=.)(\.[^.]+)$", 1)).alias("file_name"))
    return nth_in_group(r, ["file_name"], ["idx"], "n").select("idx", L.unique_name(F.col("file_name"), F.col("idx"), F.col("n") + 1).alias("name"))


@query(f"WITH {_ROWS} SELECT count(*) AS total, count(*) FILTER (status = 'retained') AS retained, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'excluded') AS excluded_do_not_retain, count(*) FILTER (needs_review) AS needs_review, count(*) FILTER (is_scanned) AS scanned, count(*) FILTER (extraction_method = 'ocr') AS ocr_read, count(*) FILTER (extraction_method = 'failed') AS failed_extraction FROM t")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return R.run_summary(_rows(spark, folder))


@query(f"WITH {_ROWS} SELECT {', '.join(R.TRACKER)} FROM t")
def tracker_rows(spark: SparkSession, folder: str) -> DataFrame:
    return R.tracker_rows(_rows(spark, folder))


@query("SELECT idx, doc_type, score, array_to_string(matched_terms, ', ') AS matched_terms FROM (SELECT DISTINCT idx, doc_type, score, matched_terms FROM classification_result)")
def csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    return flat(table(spark, folder, "classification_result", "idx", "doc_type", "score", "matched_terms").distinct())


# ---- whole runs


@query()
def corpus_report(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read, classified, described, deduplicated and laid out, by type and status."""
    rows = analyse(_docs(spark, folder))
    return rows.groupBy("doc_type", "status").agg(F.count("*").alias("documents"), F.count_if("needs_review").alias("needs_review"), F.count_if(F.col("dup_method") != "").alias("duplicates"), F.count_distinct("entity_name").alias("entities"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each hour and type, counted by a stream that reads the table to its end."""
    at = scratch(spark, "stream")
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream takes a folder or, as a pattern, a single file
    stream = spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")
    counted = arrivals(stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "1 hour", "1 day", "event_type")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/result")

    counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/result").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
