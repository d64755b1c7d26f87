"""The operators as queries over the standard tables, and SQL that gives the same rows.

Cells are ``documents`` by source (a session), vectors are ``embeddings`` by label, queries are ``benchmark``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BUFFER, RETRIEVAL
from ..functions import text as T
from ..functions.stopwords import STOP_WORDS
from ..operators import cells as C
from ..operators import evaluate as E
from ..operators import retrieval as R
from ..operators import segment as S
from ..sources.store import Table, scratch
from ..sources.tables import conversation_frames, conversation_turns, event_turns, save, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

QUESTION = "What did we agree on"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _stops() -> str:
    return "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


# SQL parts

_RENDERED = "SELECT conv_id, turn, role, text, '[' || role || ']: ' || text AS line FROM conversations"
_CAPITAL = "'[' || upper(left(role, 1)) || lower(substr(role, 2)) || ']: ' || text"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CLEAN = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'))"


def _words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> '')"


_RUNS = """runs AS (SELECT doc_id, lower(k) AS keyword, pos FROM (SELECT doc_id, unnest(l) AS k, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\\x{4e00}-\\x{9fa5}a-zA-Z0-9]+') AS l FROM documents)) WHERE length(k) >= 2),
kw AS (SELECT * FROM (SELECT doc_id, keyword, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank FROM runs GROUP BY doc_id, keyword) WHERE rank <= 8)"""
_CELLS = f"""{_RUNS},
kws AS (SELECT doc_id, list(keyword ORDER BY rank) AS keywords FROM kw GROUP BY doc_id),
cells AS (SELECT d.source AS session_id, d.doc_id AS cell_id, d.text AS raw_text, coalesce(k.keywords, []) AS keywords, coalesce(k.keywords[1:5], []) AS entities,
  row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS cell_seq FROM documents d LEFT JOIN kws k USING (doc_id))"""


def _bm25(cells: str, terms: str, own: bool, tag: str) -> str:
    """CTEs that end in ``score_<tag>`` over a relation of cells and one of (query_id, terms[, session_id])."""
    on = "AND q.session_id = x.session_id" if own else ""
    return f"""tok_{tag} AS (SELECT session_id, cell_id, cell_seq, len(l) AS dl, unnest(l) AS token FROM (SELECT session_id, cell_id, cell_seq, list_concat(list_transform(keywords, lambda x: {_CLEAN.format('x')}), list_transform({_words('raw_text')}, lambda x: {_CLEAN.format('x')})) AS l FROM {cells})),
len_{tag} AS (SELECT session_id, cell_id, len(list_concat(keywords, {_words('raw_text')})) AS dl FROM {cells}),
st_{tag} AS (SELECT session_id, count(*) AS n_docs, CASE WHEN avg(dl) > 0 THEN avg(dl) ELSE 1.0 END AS avgdl FROM len_{tag} GROUP BY session_id),
tf_{tag} AS (SELECT session_id, cell_id, cell_seq, dl, token, count(*) AS tf FROM tok_{tag} GROUP BY ALL),
df_{tag} AS (SELECT session_id, token, count(*) AS df FROM tf_{tag} WHERE token <> '' GROUP BY ALL),
q_{tag} AS (SELECT * EXCLUDE (terms), unnest(terms) AS token FROM {terms}),
w_{tag} AS (SELECT x.session_id, x.cell_id, x.cell_seq, x.token, ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w FROM tf_{tag} x JOIN df_{tag} USING (session_id, token) JOIN st_{tag} USING (session_id)),
b_{tag} AS (SELECT x.session_id, q.query_id, x.cell_id, x.cell_seq, sum(w) AS bm25 FROM w_{tag} x JOIN q_{tag} q ON q.token = x.token {on} GROUP BY ALL),
e_{tag} AS (SELECT DISTINCT session_id, cell_id, cell_seq, {_CLEAN.format('e')} AS token FROM (SELECT session_id, cell_id, cell_seq, unnest(entities) AS e FROM {cells})),
n_{tag} AS (SELECT x.session_id, q.query_id, x.cell_id, x.cell_seq, least(0.3, 0.15 * count(*)) AS bonus FROM e_{tag} x JOIN q_{tag} q ON q.token = x.token {on} WHERE x.token <> '' GROUP BY ALL),
score_{tag} AS (SELECT session_id, query_id, cell_id, cell_seq, coalesce(bm25, 0) AS bm25, coalesce(bonus, 0) AS bonus, round(coalesce(bm25, 0) + coalesce(bonus, 0), 6) AS score FROM b_{tag} FULL JOIN n_{tag} USING (session_id, query_id, cell_id, cell_seq) WHERE round(coalesce(bm25, 0) + coalesce(bonus, 0), 6) > 0)"""


_TERMS = f"terms AS (SELECT item_id AS query_id, list_distinct(list_filter(list_transform({_words('text')}, lambda x: {_CLEAN.format('x')}), lambda t: t <> '' AND NOT list_contains({_stops()}, t))) AS terms FROM benchmark)"
_OLDEST = "oldest AS (SELECT * FROM cells WHERE cell_seq <= 100)"
_KEYWORD = f"""{_CELLS}, {_OLDEST}, {_TERMS}, {_bm25('oldest', 'terms', False, 'k')},
keyword AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, query_id ORDER BY score DESC, cell_seq) AS rank FROM score_k) WHERE rank <= 50)"""
_SESSIONS = "(SELECT DISTINCT source AS session_id FROM documents)"
_NEAR = """asked AS (SELECT vec_id AS query_id, label, embedding FROM embeddings WHERE vec_id % 20 = 0),
dist AS (SELECT q.label AS session_id, q.query_id, v.vec_id AS cell_id, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance FROM asked q JOIN embeddings v USING (label)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, query_id ORDER BY distance, cell_id) AS rank FROM dist) WHERE rank <= 50),
vec AS (SELECT *, round(exp(-distance), 6) AS score FROM near WHERE round(exp(-distance), 6) >= 0.3)"""
# Cells that also have a vector: the vector of a document has its number; queries use the vector of theirs.
_VROUTE = """vdist AS (SELECT d.source AS session_id, b.item_id AS query_id, d.doc_id AS cell_id, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN documents d JOIN embeddings v ON v.vec_id = d.doc_id),
vnear AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, query_id ORDER BY distance, cell_id) AS rank FROM vdist) WHERE rank <= 50),
vroute AS (SELECT session_id, query_id, cell_id, rank, round(exp(-distance), 6) AS score FROM vnear WHERE round(exp(-distance), 6) >= 0.3)"""
_FUSED = f"""{_KEYWORD}, {_VROUTE},
fused AS (SELECT session_id, query_id, cell_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(score) AS best FROM (SELECT session_id, query_id, cell_id, rank, score FROM keyword UNION ALL SELECT * FROM vroute) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY session_id, query_id ORDER BY rrf DESC, best DESC, cell_id) AS place FROM fused)"""
_SELECTED = f"""{_FUSED},
sizes AS (SELECT session_id, count(*) AS n FROM cells GROUP BY ALL),
lim AS (SELECT session_id, greatest(2, least(5, n // 10)) AS low, greatest(greatest(2, least(5, n // 10)) + 1, least(8, n // 3)) AS high FROM sizes),
activated AS (SELECT session_id, query_id, cell_id, place FROM (SELECT p.*, l.low, l.high, sum((rrf >= 0.015)::INT) OVER (PARTITION BY p.session_id, query_id) AS k FROM placed p JOIN lim l USING (session_id)) WHERE place <= CASE WHEN k < low THEN low ELSE least(k, high) END)"""
_EXPANDED = f"""{_SELECTED},
asked2 AS (SELECT session_id, query_id, list_distinct(list_filter(list_transform({_words("string_agg(DISTINCT e, ' ')")}, lambda x: {_CLEAN.format('x')}), lambda t: t <> '' AND NOT list_contains({_stops()}, t))) AS terms FROM (SELECT a.session_id, a.query_id, unnest(c.entities) AS e FROM activated a JOIN cells c USING (session_id, cell_id)) GROUP BY session_id, query_id),
{_bm25('cells', 'asked2', True, 'x')},
more AS (SELECT session_id, query_id, cell_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id, query_id ORDER BY score DESC, cell_seq) AS rank FROM score_x) WHERE rank <= 3 AND (session_id, query_id, cell_id) NOT IN (SELECT (session_id, query_id, cell_id) FROM activated)),
chosen AS (SELECT session_id, query_id, cell_id, place AS activation FROM activated UNION ALL SELECT session_id, query_id, cell_id, rank + 1000 FROM more)"""


# Frames


def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("cell_id"), F.col("text").alias("raw_text"))
    rows = C.with_fallbacks(docs, "raw_text", ["session_id", "cell_id"])
    return rows.withColumn("cell_seq", F.row_number().over(Window.partitionBy("session_id").orderBy("cell_id")).cast("long"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def document_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of documents, and of every query (each goes to every session)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("cell_id"))
    vectors = docs.join(v, F.col("cell_id") == F.col("vec_id")).drop("vec_id")
    return vectors, benchmark_queries(spark, sf_dir).join(v, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")


def vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = document_vectors(spark, sf_dir)
    return R.vector_route(asked, vectors)


def fused(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    vectors, asked = document_vectors(spark, sf_dir)
    return R.hybrid(benchmark_queries(spark, sf_dir), cells, vectors, asked)


def activated(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    sizes = cells.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_cells"))
    return R.select(fused(spark, sf_dir, cells), sizes)


def conversation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cells(S.fold(conversation_turns(spark, sf_dir), detector=S.split_all))


# Rendering and estimates


@query("turn_render", f"SELECT conv_id AS session_id, turn AS turn_idx, length(line) AS n, md5(line) AS digest FROM ({_RENDERED})")
def turn_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = T.render(F.col("role"), F.col("content"))
    return conversation_turns(spark, sf_dir).select("session_id", "turn_idx", F.length(line).alias("n"), F.md5(line).alias("digest"))


@query("baseline_prompt", f"SELECT conv_id AS session_id, length(p) AS n, md5(p) AS digest FROM (SELECT conv_id, string_agg({_CAPITAL}, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || '[User]: {QUESTION}' AS p FROM conversations GROUP BY conv_id)")
def baseline_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.full_prompt(F.col("parts"), F.lit(QUESTION))
    return E.history(conversation_turns(spark, sf_dir)).select("session_id", F.length(p).alias("n"), F.md5(p).alias("digest"))


@query("sliding_prompt", f"SELECT conv_id AS session_id, length(p) AS n, md5(p) AS digest FROM (SELECT conv_id, string_agg({_CAPITAL}, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || '[User]: {QUESTION}' AS p FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3 GROUP BY conv_id)")
def sliding_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.sliding_prompt(F.col("parts"), F.lit(QUESTION), 3)
    return E.history(conversation_turns(spark, sf_dir)).select("session_id", F.length(p).alias("n"), F.md5(p).alias("digest"))


@query("token_estimates", "SELECT conv_id AS session_id, sum(length(text))::BIGINT AS chars, sum(length(text) // 4)::BIGINT AS chars_div_4 FROM conversations GROUP BY conv_id")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_turns(spark, sf_dir).groupBy("session_id").agg(F.sum(T.chars(F.col("content"))).alias("chars"), F.sum(T.chars_div_4(F.col("content"))).alias("chars_div_4"))


@query("rewrite_trigger", """SELECT item_id AS query_id, length(text) < 10 OR regexp_matches(lower(text), '这|那|刚才|之前|它|他|她|this|that|it|he|she|they|them|these|those') AS rewrite FROM
(SELECT item_id, CASE item_id % 5 WHEN 0 THEN '刚才说的东西在哪里可以找到呢' WHEN 1 THEN 'sum up our joyous road' WHEN 2 THEN '之前说好的计划到底怎样了啊呀' ELSE text END AS text FROM benchmark)""")
def rewrite_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("query_id") % 5 == 0, "刚才说的东西在哪里可以找到呢").when(F.col("query_id") % 5 == 1, "sum up our joyous road").when(F.col("query_id") % 5 == 2, "之前说好的计划到底怎样了啊呀").otherwise(F.col("query"))
    return benchmark_queries(spark, sf_dir).withColumn("query", text).select("query_id", T.needs_rewrite(F.col("query"), T.chars(F.col("query")), RETRIEVAL.rewrite_below).alias("rewrite"))


# Segmentation


@query("gap_flags", "SELECT user_id, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, false) AS gap FROM events")
def gap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("moment", S.moment_of(e, "ts"))
    before = F.lag("moment").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", "event_id", S.is_gap(before, F.col("moment"), BUFFER.gap_minutes).alias("gap"))


_FOLD = """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(text) AS n, role, turn, text FROM conversations),
f AS (SELECT conv_id, k, n AS total, CASE WHEN n >= 2048 THEN 'hard' WHEN n // 512 >= 1 THEN 'soft' END AS reason, 1 AS seg FROM t WHERE k = 1
  UNION ALL SELECT t.conv_id, t.k, x.total, CASE WHEN x.total >= 2048 THEN 'hard' WHEN x.total // 512 >= 1 THEN 'soft' END, f.seg + (f.reason IS NOT NULL)::INT
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1, LATERAL (SELECT CASE WHEN f.reason IS NULL THEN f.total ELSE 0 END + t.n AS total) x)"""
_CONV_CELLS = _FOLD + """, ended AS (SELECT conv_id, seg, max(reason) AS reason FROM f GROUP BY ALL HAVING max(reason) IS NOT NULL),
segs AS (SELECT e.conv_id AS session_id, e.seg AS cell_seq, e.reason, count(*) AS n_turns, min(t.turn) AS first_turn, string_agg('[' || t.role || ']: ' || t.text, chr(10) ORDER BY t.turn) AS raw_text FROM ended e JOIN f ON f.conv_id = e.conv_id AND f.seg = e.seg JOIN t ON t.conv_id = f.conv_id AND t.k = f.k GROUP BY ALL)"""


@query("segment_cells", _CONV_CELLS + " SELECT session_id, cell_seq, printf('C_%03d', cell_seq) AS cell_id, reason, CASE WHEN reason = 'hard' THEN 'fragmented' ELSE 'fact' END AS cell_type, n_turns, first_turn, length(raw_text) AS token_count, md5(raw_text) AS digest, CASE WHEN cell_seq > 1 THEN printf('C_%03d', cell_seq - 1) END AS linked_prev FROM segs")
def segment_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_cells(spark, sf_dir).select("session_id", "cell_seq", "cell_id", "reason", "cell_type", "n_turns", "first_turn", "token_count", F.md5("raw_text").alias("digest"), "linked_prev")


@query("segment_hot_zone", _FOLD + ", last AS (SELECT conv_id, max(seg) AS seg FROM f GROUP BY conv_id) SELECT f.conv_id AS session_id, count(*) FILTER (WHERE open) AS n_turns FROM (SELECT f.conv_id, f.seg, max(reason) OVER (PARTITION BY f.conv_id, f.seg) IS NULL AS open FROM f) f JOIN last l ON l.conv_id = f.conv_id AND l.seg = f.seg GROUP BY f.conv_id")
def segment_hot_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hot_zone(S.fold(conversation_turns(spark, sf_dir), detector=S.split_all)).select("session_id", F.size("hot_zone").cast("long").alias("n_turns"))


@query("hard_limit_cells", """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(text) AS n FROM conversations),
f AS (SELECT conv_id, k, n AS total, 1 AS seg FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.k, CASE WHEN f.total >= 2048 THEN 0 ELSE f.total END + t.n, f.seg + (f.total >= 2048)::INT FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)
SELECT conv_id AS session_id, seg AS cell_seq, count(*) AS n_turns FROM f GROUP BY ALL HAVING max(total) >= 2048""")
def hard_limit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cells(S.fold(conversation_turns(spark, sf_dir))).select("session_id", "cell_seq", "n_turns")


@query("gap_cells", """WITH RECURSIVE t AS (SELECT user_id, ts, length(event_type) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, k, ts, n AS total, false AS cut, 1 AS m, 1 AS seg FROM t WHERE k = 1
  UNION ALL SELECT t.user_id, t.k, t.ts, CASE WHEN f.cut OR f.total >= 2048 THEN 0 ELSE f.total END + t.n, NOT (f.cut OR f.total >= 2048) AND t.ts - f.ts > INTERVAL 30 MINUTE, 1, f.seg + (f.cut OR f.total >= 2048)::INT FROM f JOIN t ON t.user_id = f.user_id AND t.k = f.k + 1)
SELECT user_id AS session_id, seg AS cell_seq, count(*) AS n_turns, CASE WHEN bool_or(cut) THEN 'gap' ELSE 'hard' END AS reason FROM f GROUP BY ALL HAVING bool_or(cut) OR max(total) >= 2048""")
def gap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cells(S.fold(event_turns(spark, sf_dir))).select("session_id", "cell_seq", "n_turns", "reason")


@query("split_segments", """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, n, list_sort(list_distinct(list_filter([1 + conv_id % 3, 3, n, 0, 90], lambda x: x > 0 AND x <= n))) AS cuts FROM c),
s AS (SELECT conv_id, unnest(cuts) AS stop, unnest(list_concat([0], cuts[:-2])) AS start FROM p)
SELECT conv_id AS session_id, stop, stop - start AS n_turns FROM s""")
def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count(F.lit(1)).alias("n"))
    reply = F.concat(F.lit('Sure: {"split_indices": ['), (1 + F.col("session_id") % 3).cast("string"), F.lit(", 3, "), F.col("n").cast("string"), F.lit(", 0, 90,]} done"))
    p = c.select("session_id", T.split_indices(reply, F.col("n")).alias("cuts"))
    rows = p.select("session_id", "cuts", F.posexplode("cuts").alias("k", "stop"))
    return rows.select("session_id", F.col("stop").cast("long").alias("stop"), (F.col("stop") - F.when(F.col("k") > 0, F.try_element_at("cuts", F.greatest(F.col("k"), F.lit(1)))).otherwise(0)).cast("long").alias("n_turns"))


# Extraction and links


@query("fallback_summary", f"SELECT doc_id, left(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')[1:3], ' '), 200) AS summary FROM documents")
def fallback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.fallback_summary(F.col("text")).alias("summary"))


@query("fallback_keywords", f"WITH {_RUNS} SELECT doc_id, rank, keyword, n FROM kw")
def fallback_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_keywords(table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", "rank", "keyword", "n")


@query("entity_links", f"WITH {_CELLS} SELECT session_id, cell_id, unnest(entities) AS entity FROM cells")
def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.entity_links(document_cells(spark, sf_dir))


@query("find_by_entity", f"WITH {_CELLS} SELECT session_id, cell_id FROM cells WHERE list_contains(entities, 'the')")
def find_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.find_by_entity(document_cells(spark, sf_dir), "the").select("session_id", "cell_id")


@query("entity_cooccurrence", f"WITH {_CELLS}, l AS (SELECT cell_id, unnest(entities) AS entity FROM cells) SELECT x.entity AS a, y.entity AS b, count(*) AS n FROM l x JOIN l y ON x.cell_id = y.cell_id AND x.entity < y.entity GROUP BY ALL")
def entity_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cooccurring(C.entity_links(document_cells(spark, sf_dir)))


# Storage


@query("latest_cells", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.upserted(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("session_delete", "SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE vec_id % 97 = 5)")
def session_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return C.deleted(e, e.filter("vec_id % 97 = 5"), ["label"])


@query("session_scan_limit", "SELECT session_id, cell_id FROM (SELECT source AS session_id, doc_id AS cell_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 100")
def session_scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("cell_id"), F.col("doc_id").alias("cell_seq"))
    return C.session_scan(d, RETRIEVAL.keyword_scan).select("session_id", "cell_id")


@query("hydrate_cells", "SELECT d.doc_id AS cell_id, length(coalesce(b.text, '')) AS n FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def hydrate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit(0).alias("session_id"), F.col("doc_id").alias("cell_id"))
    t = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("session_id"), F.col("item_id").alias("cell_id"), F.col("text").alias("raw_text"))
    return C.hydrated(d, t).select("cell_id", F.length("raw_text").alias("n"))


_META = _CONV_CELLS + """, lines AS (SELECT session_id, cell_seq, left(array_to_string(list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: """ + _STRIP.format("x") + """), lambda x: x <> '')[1:3], ' '), 200) AS summary FROM segs),
m AS (SELECT session_id, cell_seq AS version, count(*) OVER w AS n_linked, string_agg(summary, ' ') OVER w AS raw_text, max(cell_seq) OVER (PARTITION BY session_id) = cell_seq AS live FROM lines WINDOW w AS (PARTITION BY session_id ORDER BY cell_seq))"""


def _metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.meta_versions(C.with_fallbacks(conversation_cells(spark, sf_dir), "raw_text", ["session_id", "cell_id"]))


@query("meta_versions", _META + " SELECT session_id, version, printf('M_%03d', version) AS meta_id, CASE WHEN live THEN 'active' ELSE 'archived' END AS status, n_linked, md5(raw_text) AS digest FROM m")
def meta_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metas(spark, sf_dir).select("session_id", "version", "meta_id", "status", F.size("linked_cells").cast("long").alias("n_linked"), F.md5("raw_text").alias("digest"))


@query("meta_active", _META + " SELECT session_id, version, length(raw_text) AS n FROM m WHERE live")
def meta_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.active_meta(_metas(spark, sf_dir)).select("session_id", "version", F.length("raw_text").alias("n"))


# Keyword retrieval


@query("clean_tokens", f"SELECT doc_id, count(*) AS n, count(DISTINCT token) AS n_distinct, sum(length(token))::BIGINT AS n_chars FROM (SELECT doc_id, {_CLEAN.format('w')} AS token FROM (SELECT doc_id, unnest({_words('text')}) AS w FROM documents)) WHERE token <> '' GROUP BY doc_id")
def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("w")).select("doc_id", T.clean(F.col("w")).alias("token")).filter("token <> ''")
    return tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("n_distinct"), F.sum(F.length("token")).alias("n_chars"))


@query("query_terms", f"WITH {_TERMS} SELECT query_id, unnest(terms) AS term FROM terms")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.terms_of(benchmark_queries(spark, sf_dir)).select("query_id", F.explode("terms").alias("term"))


_ALL_CELLS = f"""{_CELLS}, {_TERMS}, asked AS (SELECT * FROM terms WHERE query_id % 20 = 0), {_bm25('cells', 'asked', False, 'a')}"""


@query("bm25_stats", f"WITH {_ALL_CELLS} SELECT session_id, n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df_a d WHERE d.session_id = st_a.session_id) AS n_terms FROM st_a")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = document_cells(spark, sf_dir)
    n = R.postings(cells).filter("token <> ''").groupBy("session_id").agg(F.countDistinct("token").alias("n_terms"))
    return R.corpus_stats(cells).join(n, "session_id").select("session_id", "n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms")


@query("bm25_scores", f"WITH {_ALL_CELLS} SELECT session_id, query_id, cell_id, round(bm25, 6) AS bm25, round(bonus, 6) AS bonus, score FROM score_a")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = benchmark_queries(spark, sf_dir).filter("query_id % 20 = 0")
    return R.bm25(asked, document_cells(spark, sf_dir)).select("session_id", "query_id", "cell_id", F.round("bm25", 6).alias("bm25"), F.round("bonus", 6).alias("bonus"), "score")


@query("keyword_topk", f"WITH {_KEYWORD} SELECT session_id, query_id, cell_id, rank, score FROM keyword")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_route(benchmark_queries(spark, sf_dir), document_cells(spark, sf_dir)).select("session_id", "query_id", "cell_id", "rank", "score")


@query("exact_keyword_scan", f"""WITH {_CELLS}, {_TERMS}, q AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM terms),
d AS (SELECT session_id, cell_id, cell_seq, {_CLEAN.format("left(array_to_string(list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '')[1:3], ' '), 200)")} AS s, list_transform(keywords, lambda x: {_CLEAN.format("x")}) AS k FROM cells),
h AS (SELECT session_id, query_id, cell_id, cell_seq, round(count(*) / n, 6) AS score FROM d, q WHERE contains(s, term) OR len(list_filter(k, lambda x: contains(x, term))) > 0 GROUP BY session_id, query_id, cell_id, cell_seq, n)
SELECT session_id, query_id, cell_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id, query_id ORDER BY score DESC, cell_seq) AS rank FROM h) WHERE rank <= 30""")
def exact_keyword_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exact_scan(benchmark_queries(spark, sf_dir), document_cells(spark, sf_dir)).select("session_id", "query_id", "cell_id", "score", "rank")


# Vectors, fusion, selection


def _vector_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("session_id"), F.col("vec_id").alias("cell_id"), "embedding")
    return v.filter("cell_id % 20 = 0").withColumnRenamed("cell_id", "query_id"), v


@query("knn_l2", f"WITH {_NEAR} SELECT session_id, query_id, cell_id, rank, distance FROM near")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.knn(*_vector_queries(spark, sf_dir), RETRIEVAL.top_k).select("session_id", "query_id", "cell_id", "rank", "distance")


@query("vector_route", f"WITH {_NEAR} SELECT session_id, query_id, cell_id, rank, score FROM vec")
def vector_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_route(*_vector_queries(spark, sf_dir)).select("session_id", "query_id", "cell_id", "rank", "score")


@query("rrf_fuse", f"WITH {_FUSED} SELECT session_id, query_id, cell_id, rrf, best, place FROM placed")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir, document_cells(spark, sf_dir)).select("session_id", "query_id", "cell_id", "rrf", "best", "place")


@query("rrf_search", f"WITH {_FUSED} SELECT session_id, query_id, cell_id, place FROM placed WHERE place <= 5")
def rrf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir, document_cells(spark, sf_dir)).filter("place <= 5").select("session_id", "query_id", "cell_id", "place")


@query("select_bounds", f"WITH {_SELECTED} SELECT session_id, query_id, cell_id, place FROM activated")
def select_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activated(spark, sf_dir, document_cells(spark, sf_dir)).select("session_id", "query_id", "cell_id", "place")


@query("entity_expand", f"WITH {_EXPANDED} SELECT session_id, query_id, cell_id, score, rank FROM more")
def entity_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = document_cells(spark, sf_dir)
    return R.expand(activated(spark, sf_dir, cells), cells).select("session_id", "query_id", "cell_id", "score", "rank")


def _retrieved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = document_cells(spark, sf_dir)
    chosen = activated(spark, sf_dir, cells).select("session_id", "query_id", "cell_id", F.col("place").alias("activation"))
    more = R.expand(chosen, cells).select("session_id", "query_id", "cell_id", (F.col("rank") + 1000).alias("activation"))
    return chosen.unionByName(more), cells.withColumn("timestamp_start", F.lit(None).cast("string"))


@query("retrieve_context", f"WITH {_EXPANDED} SELECT session_id, query_id, cell_id, activation, row_number() OVER (PARTITION BY session_id, query_id ORDER BY activation) AS position FROM chosen")
def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordered(*_retrieved(spark, sf_dir)).select("session_id", "query_id", "cell_id", "activation", "position")


@query("prompt_assembly", f"""WITH {_EXPANDED}, p AS (SELECT ch.session_id, ch.query_id, string_agg(c.raw_text, chr(10) || chr(10) ORDER BY activation) AS p, count(*) AS n_cells FROM chosen ch JOIN cells c USING (session_id, cell_id) GROUP BY ALL)
SELECT p.session_id, p.query_id, n_cells, length(p || chr(10) || chr(10) || b.text) AS n, md5(p || chr(10) || chr(10) || b.text) AS digest FROM p JOIN benchmark b ON b.item_id = p.query_id""")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.ordered(*_retrieved(spark, sf_dir)).groupBy("session_id", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "raw_text"))), lambda x: x["raw_text"]).alias("texts"))
    rows = rows.join(benchmark_queries(spark, sf_dir), "query_id")
    p = R.prompt(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.transform("texts", lambda t: R.stamped(F.lit(None).cast("string"), F.lit(None).cast("string"), t)), F.col("query"))
    return rows.select("session_id", "query_id", F.size("texts").cast("long").alias("n_cells"), F.length(p).alias("n"), F.md5(p).alias("digest"))


# Evaluation


@query("token_saving", f"""WITH h AS (SELECT conv_id, sum(length({_CAPITAL}) + 2) + length('[User]: {QUESTION}') AS base FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, sum(length({_CAPITAL}) + 2) + length('[User]: {QUESTION}') AS slide FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 2 GROUP BY conv_id)
SELECT conv_id AS session_id, base::BIGINT AS base, slide::BIGINT AS slide, round((base - slide)::DOUBLE / base, 6) AS saving FROM h JOIN s USING (conv_id)""")
def token_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.history(conversation_turns(spark, sf_dir)).select("session_id", T.chars(E.full_prompt(F.col("parts"), F.lit(QUESTION))).alias("base"), T.chars(E.sliding_prompt(F.col("parts"), F.lit(QUESTION), 2)).alias("slide"))
    return rows.withColumn("saving", F.round(E.saving(F.col("base"), F.col("slide")), 6))


@query("token_breakdown", _META + """, c AS (SELECT session_id, sum(length(raw_text))::BIGINT AS cell_tokens FROM segs GROUP BY session_id), mm AS (SELECT session_id, length(raw_text) AS meta_tokens FROM m WHERE live)
SELECT session_id, meta_tokens, cell_tokens, round(meta_tokens::DOUBLE / (meta_tokens + cell_tokens), 6) AS meta_share FROM c JOIN mm USING (session_id)""")
def token_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = conversation_cells(spark, sf_dir).groupBy("session_id").agg(F.collect_list("raw_text").alias("cell_texts"))
    meta = C.active_meta(_metas(spark, sf_dir)).select("session_id", F.col("raw_text").alias("meta"))
    rows = E.breakdown(texts.join(meta, "session_id").withColumn("hot_zone", F.lit(None).cast("array<string>")))
    return rows.select("session_id", "meta_tokens", "cell_tokens", F.round(F.col("meta_tokens") / (F.col("meta_tokens") + F.col("cell_tokens") + F.col("hot_tokens")), 6).alias("meta_share"))


@query("metric_aggregate", """SELECT event_type, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.5), 6) AS median_value, list_sort(list(value))[least(floor(0.95::DOUBLE * count(*)), count(*) - 1)::BIGINT + 1] AS p95_index, round(quantile_cont(value, 0.95), 6) AS p95_interpolated, count(*) AS n FROM events GROUP BY event_type""")
def metric_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.aggregated(table(spark, sf_dir, "events").select("event_type", "value"), "value", ["event_type"])
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_value", "median_value", "p95_interpolated")})


@query("judge_scores_mean", "SELECT d.source, avg(l.toxic)::DOUBLE AS mean_judge, count(l.toxic) AS n_judged, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def judge_scores_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.groupBy("source").agg(F.avg("toxic").alias("mean_judge"), F.count("toxic").alias("n_judged"), F.count(F.lit(1)).alias("n"))


@query("judge_parse", r"SELECT event_id, coalesce(least(1.0, greatest(0.0, try_cast(regexp_extract('score: ' || (value / 10)::VARCHAR || ' of 1', '([\d.]+)', 1) AS DOUBLE))), 0.0) AS score FROM events")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("score: "), (F.col("value") / 10).cast("string"), F.lit(" of 1"))
    return table(spark, sf_dir, "events").select("event_id", T.judge_score(reply).alias("score"))


@query("lenient_json", """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE (json_extract(props, '$.k'))::BIGINT END AS k FROM events""")
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    noisy = (
        F.when(F.col("event_id") % 5 == 0, p).when(F.col("event_id") % 5 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("here: "), p, F.lit(" end"))).when(F.col("event_id") % 5 == 3, F.concat(F.lit("text "), F.regexp_replace(p, r"\}$", ",}"), F.lit(" more"))).otherwise(F.concat(F.lit("{"), p))
    )
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(T.lenient_json(noisy), "$.k", "bigint").alias("k"))


@query("session_dates", "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN TIMESTAMP '2023-05-01' WHEN event_id % 6 = 0 THEN date_trunc('minute', ts) WHEN event_id % 6 = 4 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END AS ts FROM events")
def session_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 6
    forms = ["h:mm a 'on' d MMMM, yyyy", "d MMMM yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"]
    text = F.lit("someday")
    for i, f in enumerate(forms):
        text = F.when(k == i, F.date_format(ts, f)).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", T.lenient_date(text).cast("timestamp_ntz").alias("ts"))


# Files, stored tables, streams


@query("conversation_file", """WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text, CASE WHEN turn < 2 THEN 1 WHEN turn < 4 THEN 2 ELSE 10 END AS n FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, n ORDER BY turn) - 1 AS pos FROM t)
SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_idx, CASE WHEN turn % 5 = 2 THEN 'Ann' ELSE role END AS role, md5(text) AS digest,
strftime(CASE n WHEN 1 THEN TIMESTAMP '2023-05-07' WHEN 10 THEN TIMESTAMP '2023-05-08 13:56:00' ELSE TIMESTAMP '2023-05-01' END + to_minutes(pos), '%Y-%m-%dT%H:%M:%SZ') AS ts_raw FROM p WHERE text <> ''""")
def conversation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("n", F.when(F.col("turn") < 2, 1).when(F.col("turn") < 4, 2).otherwise(10))
    speaker = F.when(F.col("turn") % 5 == 2, F.lit(None)).otherwise(F.concat(F.lit(" "), "role", F.lit(" ")))
    line = F.struct("turn", speaker.alias("speaker"), F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text")).alias("text"))
    lists = c.groupBy("conv_id", "n").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    part = F.concat(F.lit('"session_'), F.col("n"), F.lit('": '), F.to_json("lines"))
    text = F.concat(F.lit('{"speaker_a": "Ann", "session_1_date_time": "7 May 2023", "session_10_date_time": "1:56 pm on 8 May, 2023", '), F.array_join(F.collect_list(part), ", "), F.lit("}"))
    raw = lists.groupBy("conv_id").agg(text.alias("j")).select(F.col("conv_id").cast("string").alias("sample_id"), F.from_json("j", "map<string, variant>").alias("conversation"), F.array().cast("array<struct<question: string, answer: string>>").alias("qa"))
    return conversation_frames(raw)[0].select("session_id", "turn_idx", "role", F.md5("content").alias("digest"), "ts_raw")


@query("conversation_questions", "SELECT conv_id::VARCHAR AS session_id, 0 AS question_id, text AS question FROM conversations WHERE turn = 0 AND text <> '' UNION ALL SELECT conv_id::VARCHAR, 2, 'why' FROM conversations WHERE turn = 0")
def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("turn = 0")
    qa = F.array(*[F.struct(q.alias("question"), F.lit("a").alias("answer")) for q in (F.col("text"), F.lit(""), F.lit("why"))])
    raw = c.select(F.col("conv_id").cast("string").alias("sample_id"), F.from_json(F.lit("{}"), "map<string, variant>").alias("conversation"), qa.alias("qa"))
    return conversation_frames(raw)[1].select("session_id", F.col("question_id").cast("int").alias("question_id"), "question")


@query("cell_lookup", "SELECT source AS session_id, doc_id AS cell_id, length(text) AS n FROM documents WHERE doc_id % 20 = 0")
def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("cell_id"), F.length("text").alias("n"))
    return C.cell_by_id(d, d.filter("cell_id % 20 = 0"))


@query("stored_lists", f"WITH {_CELLS} SELECT cell_id, CASE WHEN cell_id % 7 = 0 THEN 0 ELSE len(keywords) END AS n, CASE WHEN cell_id % 7 = 0 THEN '' ELSE array_to_string(entities, '|') END AS entities FROM cells")
def stored_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = C.encoded(document_cells(spark, sf_dir))
    broken = F.when(F.col("cell_id") % 14 == 0, F.lit(None).cast("string")).when(F.col("cell_id") % 7 == 0, "[oops")
    stored = stored.withColumns({c: F.coalesce(F.when(F.col("cell_id") % 7 == 0, F.coalesce(broken, F.lit(""))), F.col(c)) for c in ("keywords", "entities")})
    rows = C.decoded(stored)
    return rows.select("cell_id", F.size("keywords").cast("long").alias("n"), F.array_join("entities", "|").alias("entities"))


def _texts(spark: SparkSession, sf_dir: str) -> tuple[Table, DataFrame]:
    t = Table(spark, scratch(spark, "texts"), "texts", "session_id string, cell_id long, raw_text string", ["session_id", "cell_id"])
    return t, table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("cell_id"), F.substr("text", F.lit(1), F.lit(50)).alias("raw_text"))


@query("engine_upsert", "SELECT source AS session_id, doc_id AS cell_id, CASE WHEN doc_id % 6 = 0 THEN 'twice' WHEN doc_id % 3 = 0 THEN 'new ' || substr(text, 1, 50) ELSE substr(text, 1, 50) END AS raw_text FROM documents")
def engine_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, rows = _texts(spark, sf_dir)
    t.put(rows)
    t.put(rows.filter("cell_id % 3 = 0").withColumn("raw_text", F.concat(F.lit("new "), "raw_text")))
    t.put(rows.filter("cell_id % 6 = 0").withColumn("raw_text", F.lit("twice")))
    return t.read()


@query("engine_delete_readd", "SELECT source AS session_id, doc_id AS cell_id, CASE WHEN source = 'src1' THEN 'again' ELSE substr(text, 1, 50) END AS raw_text FROM documents WHERE (source <> 'src1' AND doc_id % 4 <> 0) OR (source = 'src1' AND doc_id % 5 = 0)")
def engine_delete_readd(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, rows = _texts(spark, sf_dir)
    t.put(rows)
    t.delete(rows.filter("cell_id % 4 = 0").select("session_id", "cell_id"))
    t.delete(rows.filter("session_id = 'src1'").select("session_id"))
    t.put(rows.filter("session_id = 'src1' AND cell_id % 5 = 0").withColumn("raw_text", F.lit("again")))
    return t.read()


@query("vector_store", "SELECT label::VARCHAR AS session_id, vec_id AS cell_id, CASE WHEN vec_id % 3 = 0 THEN 64 ELSE 1 END AS d FROM embeddings WHERE vec_id % 5 <> 0")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(spark, scratch(spark, "vectors"), "vectors", "session_id string, cell_id long, embedding array<float>", ["session_id", "cell_id"])
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("session_id"), F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    t.put(e.withColumn("embedding", F.slice("embedding", 1, 1)))
    t.put(e.filter("cell_id % 3 = 0"))
    t.delete(e.filter("cell_id % 5 = 0").select("session_id", "cell_id"))
    return t.read().select("session_id", "cell_id", F.size("embedding").alias("d"))


@query("meta_delete", _META + " SELECT session_id, version FROM m WHERE session_id % 3 <> 0")
def meta_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metas(spark, sf_dir).select("session_id", "version")
    return C.deleted(m, m.filter("session_id % 3 = 0"), ["session_id"])


@query("cache_merge", "SELECT doc_id AS cell_id, coalesce(b.text, d.text) AS raw_text FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id UNION ALL SELECT item_id, text FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents)")
def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cell_id"), F.col("text").alias("raw_text"))
    return C.merged(store, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cell_id"), F.col("text").alias("raw_text")), ["cell_id"])


@query("result_dump", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def result_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.aggregated(table(spark, sf_dir, "events").select("event_type", "value"), "value", ["event_type"]).select("event_type", "n", F.round("mean_value", 6).alias("mean_value"))
    path = scratch(spark, "dump")
    save(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


@query("stream_cells", ORACLE["segment_cells"])
def stream_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's cells of the conversations table, all there is taken at once."""
    from ..streaming.ingest import ingest

    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    # A pattern, since a stream takes a single file only by one; where the table is a folder, it stands for its files.
    c = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]")
    turns = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_idx"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("ts_raw"))
    path = scratch(spark, "stream")
    cells = ingest(turns, detector=lambda buffer: [len(buffer)])
    out = cells.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(cells.schema).parquet(f"{path}/out").select("session_id", "cell_seq", "cell_id", "reason", "cell_type", "n_turns", "first_turn", "token_count", F.md5("raw_text").alias("digest"), "linked_prev")


# More of the fold


def _half(turns):
    """A detector: the first buffered turn, then the others."""
    return F.array(F.lit(1), F.size(turns)).cast("array<int>")


_INNER = _FOLD + """, ended AS (SELECT conv_id, seg, max(reason) AS reason FROM f GROUP BY ALL HAVING max(reason) IS NOT NULL),
parts AS (SELECT f.conv_id, f.seg, t.turn, t.role, t.text, e.reason = 'soft' AND row_number() OVER (PARTITION BY f.conv_id, f.seg ORDER BY t.turn) > 1 AS later FROM f JOIN ended e ON e.conv_id = f.conv_id AND e.seg = f.seg JOIN t ON t.conv_id = f.conv_id AND t.k = f.k),
inner_cells AS (SELECT conv_id AS session_id, seg AS flush_id, row_number() OVER (PARTITION BY conv_id ORDER BY seg, later) AS cell_seq, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn, string_agg('[' || role || ']: ' || text, chr(10) ORDER BY turn) AS raw_text FROM parts GROUP BY conv_id, seg, later)"""


@query("segment_inner_cuts", _INNER + " SELECT session_id, flush_id, cell_seq, n_turns, first_turn, last_turn, md5(raw_text) AS digest FROM inner_cells")
def segment_inner_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cells(S.fold(conversation_turns(spark, sf_dir), detector=_half)).select("session_id", "flush_id", "cell_seq", "n_turns", "first_turn", "last_turn", F.md5("raw_text").alias("digest"))


@query("meta_flushes", _INNER + """, r AS (SELECT session_id, flush_id, cell_seq, lower(k) AS keyword, pos FROM (SELECT session_id, flush_id, cell_seq, unnest(l) AS k, generate_subscripts(l, 1) AS pos FROM (SELECT *, regexp_extract_all(raw_text, '[\\x{4e00}-\\x{9fa5}a-zA-Z0-9]+') AS l FROM inner_cells)) WHERE length(k) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, cell_seq ORDER BY n DESC, first_pos) AS rank FROM (SELECT session_id, flush_id, cell_seq, keyword, count(*) AS n, min(pos) AS first_pos FROM r GROUP BY ALL)),
d AS (SELECT session_id, flush_id, keyword, min(struct_pack(s := cell_seq, r := rank)) AS place, min(CASE WHEN rank <= 5 THEN struct_pack(s := cell_seq, r := rank) END) AS e_place FROM k WHERE rank <= 8 GROUP BY ALL),
w AS (SELECT session_id, flush_id, list(keyword ORDER BY place)[1:8] AS keywords, list(keyword ORDER BY e_place) FILTER (WHERE e_place IS NOT NULL)[1:5] AS entities FROM d GROUP BY ALL)
SELECT c.session_id, row_number() OVER (PARTITION BY c.session_id ORDER BY c.flush_id) AS version, sum(c.n) OVER (PARTITION BY c.session_id ORDER BY c.flush_id)::BIGINT AS n_linked, array_to_string(w.keywords, '|') AS keywords, array_to_string(w.entities, '|') AS entities
FROM (SELECT session_id, flush_id, count(*) AS n FROM inner_cells GROUP BY ALL) c JOIN w USING (session_id, flush_id)""")
def meta_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = C.with_fallbacks(S.cells(S.fold(conversation_turns(spark, sf_dir), detector=_half)), "raw_text", ["session_id", "cell_id"])
    return C.digests_of(cells).select("session_id", "version", F.size("linked_cells").cast("long").alias("n_linked"), F.array_join("keywords", "|").alias("keywords"), F.array_join("entities", "|").alias("entities"))


_GAPS = ORACLE["gap_cells"].split("SELECT user_id AS session_id")[0]


@query("segment_bounds", _GAPS + "SELECT f.user_id AS session_id, f.seg AS cell_seq, min_by(f.ts, f.k) AS timestamp_start, max_by(f.ts, f.k) AS timestamp_end FROM f GROUP BY ALL HAVING bool_or(cut) OR max(total) >= 2048")
def segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cells(S.fold(event_turns(spark, sf_dir))).select("session_id", "cell_seq", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("timestamp_start", "timestamp_end")])


@query("meta_bounds", _GAPS + """, s AS (SELECT f.user_id, f.seg, min_by(f.ts, f.k) AS a, max_by(f.ts, f.k) AS b FROM f GROUP BY ALL HAVING bool_or(cut) OR max(total) >= 2048)
SELECT user_id AS session_id, seg AS version, CASE WHEN seg = 1 THEN a END AS timestamp_start, b AS timestamp_end FROM s""")
def meta_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = C.with_fallbacks(S.cells(S.fold(event_turns(spark, sf_dir))), "raw_text", ["session_id", "cell_id"])
    return C.meta_versions(cells).select("session_id", "version", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("timestamp_start", "timestamp_end")])


@query("gap_mixed_stamps", """WITH RECURSIVE e AS (SELECT user_id, event_id, date_trunc('second', ts) AS ts, (event_id // 3) % 6 AS form, CASE WHEN event_id % 4 = 0 THEN 0 ELSE length(event_type) END AS n FROM events),
t AS (SELECT user_id, CASE WHEN form < 4 THEN ts WHEN form = 4 THEN date_trunc('day', ts) END AS ts, form IN (1, 2) AS zoned, n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e),
f AS (SELECT user_id, k, ts, zoned, n AS total, false AS cut, 1 AS seg FROM t WHERE k = 1
  UNION ALL SELECT t.user_id, t.k, t.ts, t.zoned, CASE WHEN f.cut OR f.total >= 2048 THEN 0 ELSE f.total END + t.n, coalesce(NOT (f.cut OR f.total >= 2048) AND t.zoned = f.zoned AND t.ts - f.ts > INTERVAL 30 MINUTE, false), f.seg + (f.cut OR f.total >= 2048)::INT FROM f JOIN t ON t.user_id = f.user_id AND t.k = f.k + 1)
SELECT user_id AS session_id, seg AS cell_seq, count(*) AS n_turns FROM f GROUP BY ALL HAVING bool_or(cut) OR max(total) >= 2048""")
def gap_mixed_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as ISO texts of several kinds, with and without zones, and junk; some contents are null."""
    e = event_turns(spark, sf_dir)
    ts, form = F.col("ts_raw").cast("timestamp_ntz"), F.floor(F.col("turn_idx") / 3) % 6

    def text(shift: str, pattern: str):
        return F.date_format(ts + F.expr(shift), pattern)

    no, plain = "INTERVAL 0 HOUR", "yyyy-MM-dd'T'HH:mm:ss"
    raw = (
        F.when(form == 0, text(no, plain)).when(form == 1, F.concat(text(no, plain), F.lit("Z"))).when(form == 2, F.concat(text("INTERVAL 8 HOUR", plain + ".SSS"), F.lit("+08:00")))
        .when(form == 3, text(no, "yyyyMMdd'T'HHmmss")).when(form == 4, text(no, "yyyy-MM-dd")).otherwise(F.lit("soon"))
    )
    raw = F.when(form == 2, F.regexp_replace(raw, r"\.\d+", "")).otherwise(raw)
    turns = e.withColumns({"content": F.when(F.col("turn_idx") % 4 != 0, F.col("content")), "ts_raw": raw})
    return S.cells(S.fold(turns)).select("session_id", "cell_seq", "n_turns")


@query("hot_zone_lines", _FOLD + """, last AS (SELECT conv_id, max(seg) AS seg FROM f GROUP BY conv_id),
o AS (SELECT f.conv_id, f.seg, f.k, max(f.reason) OVER (PARTITION BY f.conv_id, f.seg) IS NULL AS open FROM f)
SELECT o.conv_id AS session_id, md5(coalesce(string_agg('[' || t.role || ']: ' || t.text, chr(10) ORDER BY t.k) FILTER (WHERE o.open), '')) AS digest FROM o JOIN last l ON l.conv_id = o.conv_id AND l.seg = o.seg JOIN t ON t.conv_id = o.conv_id AND t.k = o.k GROUP BY o.conv_id""")
def hot_zone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hot_zone(S.fold(conversation_turns(spark, sf_dir), detector=S.split_all)).select("session_id", F.md5(F.array_join("hot_zone", "\n")).alias("digest"))


@query("resumed_ids", _CONV_CELLS + " SELECT session_id, printf('C_%03d', cell_seq + CASE WHEN session_id % 2 = 0 THEN 7 ELSE 0 END) AS cell_id, cell_seq + CASE WHEN session_id % 2 = 0 THEN 7 ELSE 0 END AS cell_seq FROM segs")
def resumed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir)
    known = turns.select("session_id").distinct().filter("session_id % 2 = 0").withColumn("cell_id", F.explode(F.array(F.lit("C_002"), F.lit("C_007"), F.lit("other"))))
    return S.cells(S.fold(turns, detector=S.split_all), known=known).select("session_id", "cell_id", "cell_seq")


@query("boundary_lines", "SELECT conv_id AS session_id, md5(string_agg(k || '. [' || CASE WHEN turn % 3 = 0 THEN 'user' ELSE role END || ']: ' || text, chr(10) ORDER BY turn)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id")
def boundary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("turn_idx") % 3 == 0, "narrator").otherwise(F.col("role"))
    turns = conversation_turns(spark, sf_dir).withColumn("role", role)
    listed = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "role", "content"))).alias("t"))
    return listed.select("session_id", F.md5(S.boundary_lines(F.col("t"))).alias("digest"))


@query("extraction_replies", f"""WITH {_CELLS} SELECT cell_id, CASE cell_id % 4 WHEN 0 THEN 'task' ELSE 'fact' END AS cell_type, CASE cell_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence,
CASE WHEN cell_id % 4 = 0 THEN 'S' || cell_id ELSE left(array_to_string(list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')[1:3], ' '), 200) END AS summary,
CASE WHEN cell_id % 4 IN (0, 2) THEN 'a|b' ELSE array_to_string(keywords, '|') END AS keywords FROM cells""")
def extraction_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("cell_id") % 4
    reply = F.when(k == 0, F.concat(F.lit('```json\n{"summary": "S'), F.col("cell_id"), F.lit('", "keywords": ["a", "b"], "cell_type": "task", "confidence": 0.9}\n```'))).when(k == 1, "no idea").when(k == 2, '{"summary": "", "keywords": ["a", "b"], "cell_type": "poem", "confidence": "high"}').otherwise("{}")
    rows = C.from_replies(document_cells(spark, sf_dir).withColumn("reply", reply), "reply")
    return rows.select("cell_id", "cell_type", "confidence", "summary", F.array_join("keywords", "|").alias("keywords"))


# The whole retrieval


@query("hybrid_retrieve", f"""WITH {_EXPANDED}, stamps AS (SELECT *, CASE WHEN cell_id % 3 > 0 THEN '2024-01-' || lpad((cell_id % 28 + 1)::VARCHAR, 2, '0') END AS a, CASE WHEN cell_id % 2 > 0 THEN '2024-02' END AS b FROM cells),
x AS (SELECT ch.session_id, ch.query_id, row_number() OVER (PARTITION BY ch.session_id, ch.query_id ORDER BY a NULLS LAST, activation, cell_seq) AS position, CASE WHEN a IS NULL AND b IS NULL THEN '' ELSE '[' || coalesce(a, 'unknown') || ' - ' || coalesce(b, 'unknown') || ']' || chr(10) END || raw_text AS text FROM chosen ch JOIN stamps s USING (session_id, cell_id)),
p AS (SELECT session_id, query_id, count(*) AS n_cells, string_agg(text, chr(10) || chr(10) ORDER BY position) AS texts FROM x GROUP BY ALL)
SELECT session_id, query_id, n_cells, md5(CASE WHEN session_id <> 'src1' THEN 'digest of ' || session_id || chr(10) || chr(10) ELSE '' END || 'open 1' || chr(10) || chr(10) || 'open 2' || chr(10) || chr(10) || texts || chr(10) || chr(10) || text) AS digest FROM p JOIN benchmark ON item_id = query_id""")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both routes, selection, expansion, order of time, digest and open turns in one plan."""
    k = F.col("cell_id")
    stamps = {"timestamp_start": F.when(k % 3 > 0, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))), "timestamp_end": F.when(k % 2 > 0, "2024-02")}
    cells = document_cells(spark, sf_dir).withColumns(stamps).withColumns({"cell_type": F.lit("fact"), "token_count": F.length("raw_text")})
    vectors, asked = document_vectors(spark, sf_dir)
    queries = benchmark_queries(spark, sf_dir)
    found = R.retrieve(queries, cells, vectors, asked)
    sessions = cells.select("session_id").distinct()
    zone = sessions.withColumn("hot_zone", F.array(F.lit("open 1"), F.lit("open 2")))
    meta = sessions.filter("session_id <> 'src1'").withColumn("raw_text", F.concat(F.lit("digest of "), "session_id"))
    pairs = found.select("session_id", "query_id").distinct().join(queries, "query_id")
    return R.contexts(found, cells, pairs, zone, meta).select("session_id", "query_id", F.size("cell_texts").cast("long").alias("n_cells"), F.md5("prompt").alias("digest"))


@query("wide_retrieve", f"""WITH {_KEYWORD}, wide AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, query_id ORDER BY score DESC, cell_seq) AS place FROM score_k) WHERE place <= 100)
SELECT session_id, query_id, count(*) AS n FROM wide GROUP BY ALL""")
def wide_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A least score that no first cell of one route reaches: every query takes the wide top."""
    from dataclasses import replace

    rows = R.hybrid(benchmark_queries(spark, sf_dir), document_cells(spark, sf_dir), config=replace(RETRIEVAL, min_score=0.5))
    return rows.groupBy("session_id", "query_id").agg(F.count(F.lit(1)).alias("n"))


# Totals

_TOTALS = """SELECT count(*) AS total_qas, coalesce(round(avg(value), 6), 0) AS avg_session_mem_latency_ms, coalesce(round(quantile_cont(value, 0.5), 6), 0) AS median_session_mem_latency_ms,
coalesce(list_sort(list(value))[least(floor(0.95::DOUBLE * count(*)), count(*) - 1)::BIGINT + 1], 0) AS p95_session_mem_latency_ms, coalesce(round(avg(event_id), 6), 0)::DOUBLE AS avg_session_mem_tokens, round(avg(CASE WHEN event_id % 3 > 0 THEN value / 100 END), 6) AS avg_session_mem_judge_score FROM events"""


def _totals(spark: SparkSession, sf_dir: str, keep: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(keep)
    rows = e.select(F.col("value").alias("session_mem_latency_ms"), F.col("event_id").alias("session_mem_tokens"), F.when(F.col("event_id") % 3 > 0, F.col("value") / 100).alias("session_mem_judge_score"))
    return E.totals(rows).select("total_qas", *[F.round(c, 6).alias(c) for c in ("avg_session_mem_latency_ms", "median_session_mem_latency_ms", "avg_session_mem_tokens", "avg_session_mem_judge_score")], "p95_session_mem_latency_ms")


@query("evaluation_totals", _TOTALS)
def evaluation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir, "true")


@query("evaluation_totals_empty", _TOTALS + " WHERE false")
def evaluation_totals_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir, "false")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns to cells to BM25 to the five best cells of every query."""
    cells = C.with_fallbacks(conversation_cells(spark, sf_dir), "raw_text", ["session_id", "cell_id"])
    last = conversation_turns(spark, sf_dir).filter("role = 'user'").groupBy("session_id").agg(F.max_by("content", "turn_idx").alias("query")).withColumn("query_id", F.lit(0))
    return R.keyword_route(last, cells, top_k=5).select("session_id", "cell_id", "rank", "score")
