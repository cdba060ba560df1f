"""Registered queries of the retrieval engine over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .functions import vectors as v
from .functions.distance import weighted_distance
from .operators import features, fuzzy, layout, quantiles, retrieval, spans, weighted
from .plans.durable import shared_dir
from .schemas import EVENTS
from .streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Parameters of the registered queries.
FOCAL, PREVIOUS, BRIDGES, NEAREST = 0, 1, [2, 3, 5, 7, 11, 13], 20
WORDS = "the of and in"
TERMS = ["bolt", "anvil"]
TYPED = ["blue bolt", "blu bolt", "larg anvil", "smal gear", "red widgte", "old", "hot g"]


def register(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def typed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q,) for q in TYPED], "query string")


def typed_sql() -> str:
    return "(SELECT unnest([" + ", ".join(f"'{q}'" for q in TYPED) + "]) AS query)"


E = "(SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings)"
COS = "list_cosine_similarity"


def _survivors_sql(raw: str) -> str:
    return f"""(WITH raw AS {raw}, st AS (SELECT min(raw) AS lo, max(raw) AS hi FROM raw),
      ns AS (SELECT id, CASE WHEN hi - lo > 1e-6 THEN (raw - lo) / (hi - lo) ELSE 0.5 END AS ns FROM raw, st)
      SELECT id, round(ns, 4) AS score FROM ns WHERE round(ns, 4) >= (SELECT quantile_cont(ns, 0.7) FROM ns))"""


def _raw_sql(focal: int, rows: str) -> str:
    return f"(SELECT a.id, {COS}(a.e, b.e) AS raw FROM {rows} a, (SELECT e FROM {E} WHERE id = {focal}) b)"


def one(rows: DataFrame, i: int) -> DataFrame:
    return rows.where(F.col("vec_id") == i)


_KNN = f"""(SELECT id, score, role FROM (SELECT a.id, round({COS}(a.e, b.e), 4) AS score, 'neighbor' AS role FROM {E} a, (SELECT e FROM {E} WHERE id = {FOCAL}) b
   WHERE a.id <> {FOCAL} ORDER BY score DESC, id LIMIT {NEAREST}) UNION ALL SELECT id, 1.0, 'focal' FROM {E} WHERE id = {FOCAL})"""


@register(f"SELECT id, score, role FROM {_KNN}")
def knn_topn(spark, d):
    return retrieval.neighbours(read(spark, d, "embeddings"), FOCAL, NEAREST, "vec_id")


@register(f"SELECT * FROM {_survivors_sql(_raw_sql(FOCAL, E))}")
def semantic_filter_p70(spark, d):
    rows = read(spark, d, "embeddings")
    return retrieval.semantic_filter(rows, one(rows, FOCAL), "vec_id")


@register(
    f"""WITH a1 AS {_survivors_sql(_raw_sql(0, E))}, a2 AS {_survivors_sql(_raw_sql(1, f"(SELECT * FROM {E} WHERE id IN (SELECT id FROM a1))"))}
    SELECT * FROM {_survivors_sql(_raw_sql(2, f"(SELECT * FROM {E} WHERE id IN (SELECT id FROM a2))"))}"""
)
def progressive_filter_chain(spark, d):
    rows = read(spark, d, "embeddings")
    return retrieval.progressive_filter(rows, [one(rows, i) for i in (0, 1, 2)], "vec_id")


@register(
    f"""WITH s AS (SELECT doc_id AS id, round(0.1 + 0.8 * len(list_intersect(list_distinct(string_split_regex(lower(coalesce(text, '')), '\\s+')), string_split('{WORDS}', ' '))) / 4.0, 4) AS score FROM documents)
    SELECT id, score FROM s WHERE score >= (SELECT median(score) FROM s)"""
)
def lexical_overlap_filter(spark, d):
    return retrieval.lexical_filter(read(spark, d, "documents"), WORDS, "doc_id", "text")


_BRIDGE = ", ".join(map(str, BRIDGES))


@register(
    f"""WITH k AS (SELECT id, score, CASE WHEN id = {PREVIOUS} THEN 'previous' ELSE role END AS role FROM {_KNN}),
    p AS (SELECT * FROM k UNION ALL SELECT id, 0.0, 'previous' FROM {E} WHERE id = {PREVIOUS} AND id NOT IN (SELECT id FROM k)),
    b AS (SELECT a.id, 0.0 AS score, 'bridge' AS role FROM {E} a, (SELECT e FROM {E} WHERE id = {FOCAL}) f
          WHERE a.id IN ({_BRIDGE}) AND a.id NOT IN (SELECT id FROM p) ORDER BY {COS}(a.e, f.e) DESC, a.id LIMIT 5)
    SELECT * FROM p UNION ALL SELECT * FROM b"""
)
def neighborhood_roles(spark, d):
    return retrieval.neighbourhood(read(spark, d, "embeddings"), FOCAL, NEAREST, PREVIOUS, BRIDGES, 5, "vec_id")


@register(f"SELECT id, score, role FROM {_KNN} WHERE id = {FOCAL} OR id IN (SELECT id FROM {_survivors_sql(_raw_sql(PREVIOUS, E))})")
def similar_within_chips(spark, d):
    rows = read(spark, d, "embeddings")
    alive = retrieval.semantic_filter(rows, one(rows, PREVIOUS), "vec_id").select("id")
    near = retrieval.neighbours(rows, FOCAL, NEAREST, "vec_id")
    return near.where(F.col("id") != FOCAL).join(alive, "id", "left_semi").unionByName(near.where(F.col("id") == FOCAL))


@register(f"""WITH s AS (SELECT x.id, x.e FROM {E} x JOIN {_KNN} k USING (id)) SELECT a.id AS a, b.id AS b, round(1 - greatest(-1, least(1, {COS}(a.e, b.e))), 6) AS distance FROM s a JOIN s b ON a.id < b.id""")
def pairwise_cosine_distance(spark, d):
    """All distances within one neighbourhood, whose size is the parameter."""
    rows = read(spark, d, "embeddings")
    s = rows.join(F.broadcast(retrieval.neighbours(rows, FOCAL, NEAREST, "vec_id").select(F.col("id").alias("vec_id"))), "vec_id").select(F.col("vec_id").alias("id"), "embedding")
    a, b = s.alias("a"), s.alias("b")
    return a.join(F.broadcast(b), F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(v.cosine_distance(F.col("a.embedding"), F.col("b.embedding")), 6).alias("distance"))


_IDS = [7, 3, 7, 99_999_999, 1, 5]


@register(f"SELECT CAST(pos - 1 AS INTEGER) AS pos, CAST(doc_id AS BIGINT) AS doc_id, source FROM (SELECT unnest({_IDS}) AS doc_id, generate_subscripts({_IDS}, 1) AS pos) i JOIN documents USING (doc_id)")
def ordered_id_lookup(spark, d):
    return retrieval.ordered_lookup(read(spark, d, "documents"), _IDS, "doc_id").select("pos", "doc_id", "source")


def _points(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


@register(
    f"""WITH p AS (SELECT id, e[1] AS x, e[2] AS y, label FROM {E}), f AS (SELECT x AS fx, y AS fy FROM p WHERE id = {FOCAL}),
    c AS (SELECT id, x - fx AS x, y - fy AS y FROM p, f), s AS (SELECT quantile_cont(sqrt(x * x + y * y), 0.75) AS s FROM c WHERE id <> {FOCAL}),
    z AS (SELECT id, x / s AS x, y / s AS y FROM c, s), o AS (SELECT id, e[3] AS px, e[4] AS py FROM {E} WHERE label = 0),
    t AS (SELECT atan2(sum(x * py - y * px), sum(x * px + y * py)) AS t FROM z JOIN o USING (id) WHERE id <> {FOCAL}),
    m AS (SELECT id, x * cos(t) - y * sin(t) AS x, x * sin(t) + y * cos(t) AS y FROM z, t)
    SELECT m.id, round(CASE WHEN px IS NOT NULL AND m.id <> {FOCAL} THEN px ELSE x END, 6) + 0.0 AS x, round(CASE WHEN px IS NOT NULL AND m.id <> {FOCAL} THEN py ELSE y END, 6) + 0.0 AS y FROM m LEFT JOIN o USING (id)"""
)
def procrustes_snap(spark, d):
    rows = read(spark, d, "embeddings")
    old = rows.where("label = 0").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(2)).cast("double").alias("px"), F.get("embedding", F.lit(3)).cast("double").alias("py"))
    out = layout.rotate_and_snap(layout.centre_and_scale(_points(spark, d), FOCAL), old, FOCAL)
    return out.select("id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@register(
    f"""WITH p AS (SELECT id, e[1] AS x, e[2] AS y FROM {E}), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
    k AS (SELECT *, least(680.0 / (x1 - x0), 480.0 / (y1 - y0)) AS k FROM b)
    SELECT id, round(400 + (x - (x0 + x1) / 2) * k, 4) AS sx, round(300 + (y - (y0 + y1) / 2) * k, 4) AS sy FROM p, k"""
)
def viewport_fit(spark, d):
    return layout.fit_viewport(_points(spark, d), 800.0, 600.0).select("id", F.round("sx", 4).alias("sx"), F.round("sy", 4).alias("sy"))


@register(
    f"""WITH p AS (SELECT id, e[1] AS x, e[2] AS y FROM {E}), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, greatest(ceil(sqrt(count(*))) + 6, 14) AS g FROM p)
    SELECT id, CAST(floor((x - x0) / (x1 - x0) * (g - 4) + 2.5) AS INTEGER) AS gx, CAST(floor((y - y0) / (y1 - y0) * (g - 4) + 2.5) AS INTEGER) AS gy, CAST(g AS INTEGER) AS g FROM p, b"""
)
def grid_snap_normalise(spark, d):
    return layout.grid_cells(_points(spark, d))


@register()
def neighbourhood_layout(spark, d):
    """Metric scaling of one neighbourhood, centred on its focal row."""
    rows = read(spark, d, "embeddings")
    near = rows.join(F.broadcast(retrieval.neighbours(rows, FOCAL, NEAREST, "vec_id").select(F.col("id").alias("vec_id"))), "vec_id").withColumn("set", F.lit("focal"))
    return layout.centre_and_scale(layout.project(near, "set", "vec_id", "embedding").select("id", "x", "y"), FOCAL)


@register("SELECT trim(p_brand) AS name, count(*) AS song_count, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS genres FROM part GROUP BY 1")
def artist_dimension(spark, d):
    return features.artists(read(spark, d, "part"), "p_brand", "p_type")


@register("SELECT phrase, arg_min(p_name, p_partkey) AS display, count(*) AS freq FROM (SELECT lower(trim(p_name)) AS phrase, * FROM part) GROUP BY phrase")
def first_wins_dedupe(spark, d):
    return fuzzy.dictionary(read(spark, d, "part"), "p_name", "p_partkey")


_TOKENS = "(SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS word FROM documents)"


def _tokens(spark, d):
    return read(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))).alias("word"))


@register(
    f"""WITH c AS (SELECT word, replace(strip_accents(lower(word)), '·', '') AS folded, count(*) AS freq FROM {_TOKENS} WHERE len(word) >= 2 GROUP BY word)
    SELECT folded, word AS canonical, freq FROM (SELECT *, row_number() OVER (PARTITION BY folded ORDER BY freq DESC, word) AS rn FROM c) WHERE rn = 1"""
)
def canonical_argmax(spark, d):
    """The most frequent form of each folded word, the smaller of equals."""
    c = _tokens(spark, d).where(F.length("word") >= 2).groupBy("word").agg(F.count("*").alias("freq")).withColumn("folded", tx.for_match(F.col("word")))
    best = c.groupBy("folded").agg(F.min(F.struct((-F.col("freq")).alias("n"), "word")).alias("b"))
    return best.select("folded", F.col("b.word").alias("canonical"), (-F.col("b.n")).alias("freq"))


@register(f"SELECT word, freq FROM (SELECT lower(word) AS word, count(*) AS freq FROM {_TOKENS} GROUP BY 1) WHERE len(word) >= 2 AND regexp_matches(word, '\\pL') AND freq >= 2")
def token_frequency_lexicon(spark, d):
    c = _tokens(spark, d).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("freq"))
    return c.where((F.length("word") >= 2) & F.col("word").rlike(r"\p{L}") & (F.col("freq") >= 2))


@register("""SELECT DISTINCT substr(w, i::BIGINT, 2) AS bigram, w AS word FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part))""")
def bigram_index(spark, d):
    w = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return w.select(F.explode(tx.bigrams(F.col("word"))).alias("bigram"), "word").distinct()


@register("SELECT doc_id, md5(replace(strip_accents(lower(text)), '·', '')) AS folded FROM documents")
def fold_accents(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.for_match(F.col("text"))).alias("folded"))


_ES = "[" + ", ".join(f"'{w}'" for w in tx.FUNCTION_WORDS) + "]"


@register(
    f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, list_filter(regexp_extract_all(
    regexp_replace(text, '([ldsmtnLDSMTN])''', '\\1 ', 'g'), '[a-zA-ZàèéíòóúïüçÀÈÉÍÒÓÚÏÜÇ]+(?:·[a-zA-ZàèéíòóúïüçÀÈÉÍÒÓÚÏÜÇ]+)*'), lambda w: len(w) >= 2 OR list_contains({_ES}, w)) AS t FROM documents)"""
)
def tokenize_contractions(spark, d):
    t = tx.tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


@register()
def normalize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("normalised"))


_ANY = " OR ".join(f"contains(replace(strip_accents(lower({{0}})), '·', ''), '{t}')" for t in [*TERMS, "tion"])


@register(f"SELECT doc_id AS id FROM documents WHERE {_ANY.format('text')} UNION ALL SELECT p_partkey FROM part WHERE {_ANY.format('p_name')}")
def substring_any_match(spark, d):
    terms = [*TERMS, "tion"]
    docs = read(spark, d, "documents").where(tx.matches_any(F.col("text"), terms)).select(F.col("doc_id").alias("id"))
    return docs.union(read(spark, d, "part").where(tx.matches_any(F.col("p_name"), terms)).select("p_partkey"))


_HAS = " OR ".join(f"contains(lower({{0}}), '{t}')" for t in [*TERMS, "#1"])


@register(
    f"""SELECT * FROM (SELECT 'artist' AS category, p_brand AS name FROM part WHERE {_HAS.format('p_brand')} GROUP BY p_brand ORDER BY p_brand LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'song', p_name || ' ' || p_partkey FROM part WHERE {_HAS.format('p_name')} ORDER BY p_partkey LIMIT 8)
    UNION ALL SELECT * FROM (SELECT 'news', CAST(doc_id AS VARCHAR) FROM documents WHERE {_HAS.format('text')} ORDER BY doc_id LIMIT 5)"""
)
def instant_search_categories(spark, d):
    """Capped hits by category: five artists, eight songs, five news, as the search box shows them."""
    terms = [*TERMS, "#1"]
    part = read(spark, d, "part")
    a = part.where(tx.matches_any(F.col("p_brand"), terms)).groupBy("p_brand").count().orderBy("p_brand").limit(5).select(F.lit("artist").alias("category"), F.col("p_brand").alias("name"))
    s = part.where(tx.matches_any(F.col("p_name"), terms)).orderBy("p_partkey").limit(8).select(F.lit("song").alias("category"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))
    n = read(spark, d, "documents").where(tx.matches_any(F.col("text"), terms)).orderBy("doc_id").limit(5).select(F.lit("news").alias("category"), F.col("doc_id").cast("string").alias("name"))
    return a.unionByName(s).unionByName(n)


_BUDGET = "least(CASE WHEN len(query) <= 3 THEN 0 WHEN len(query) <= 5 THEN 1 WHEN len(query) <= 9 THEN 2 WHEN len(query) <= 13 THEN 3 ELSE 4 END, 4)"
_DICT = "(SELECT lower(trim(p_name)) AS phrase, count(*) AS freq FROM part GROUP BY 1)"


@register(
    f"""WITH m AS (SELECT query, phrase, CAST(damerau_levenshtein(query, phrase) AS INTEGER) AS distance, freq FROM {typed_sql()} q, {_DICT} d WHERE damerau_levenshtein(query, phrase) <= {_BUDGET})
    SELECT query, phrase, distance, freq FROM m QUALIFY distance = min(distance) OVER (PARTITION BY query)"""
)
def levenshtein_phrase_match(spark, d):
    return fuzzy.phrase_match(typed(spark), fuzzy.dictionary(read(spark, d, "part"), "p_name", "p_partkey"))


@register(
    f"""SELECT query, phrase, CAST(levenshtein(query, substr(phrase, 1, len(query))) AS INTEGER) AS distance FROM {typed_sql()} q, {_DICT} d
    WHERE len(phrase) > len(query) AND levenshtein(query, substr(phrase, 1, len(query))) <= {_BUDGET}"""
)
def prefix_completion(spark, d):
    return fuzzy.completions(typed(spark), fuzzy.dictionary(read(spark, d, "part"), "p_name", "p_partkey"))


@register(
    f"""WITH w AS (SELECT query, string_split(query, ' ') AS w FROM {typed_sql()}), s AS (SELECT query, unnest(generate_series(1, len(w) - 1)) AS pos, w FROM w),
    c AS (SELECT query, pos, array_to_string(w[1:pos], ' ') AS l, array_to_string(w[pos+1:], ' ') AS r FROM s),
    v AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part)
    SELECT query, CAST(pos AS INTEGER) AS pos, CAST(min(levenshtein(l, a) + levenshtein(r, b)) AS INTEGER) AS distance FROM c, v WHERE levenshtein(l, a) <= 2 AND levenshtein(r, b) <= 2 GROUP BY ALL"""
)
def split_match(spark, d):
    """Cuts of a query whose halves are close to a first and a second word: least total distance."""
    first, second = (read(spark, d, "part").select(F.get(F.split("p_name", " "), F.lit(i)).alias("phrase")).distinct() for i in (0, 1))
    s = fuzzy.splits(typed(spark))
    found = []
    for side, words in (("left", first), ("right", second)):
        p = fuzzy.pairs_by_length(s.select(side).distinct(), words, 2, side).withColumn("dist", F.levenshtein(side, "phrase", 2)).where("dist >= 0")
        found.append(p.groupBy(side).agg(F.min("dist").alias(f"{side}_d")))
    return s.join(found[0], "left").join(found[1], "right").select("query", "pos", (F.col("left_d") + F.col("right_d")).cast("int").alias("distance"))


@register("SELECT n_name AS artist, s_name AS title, CAST(row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS INTEGER) AS seq FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def artist_expansion(spark, d):
    j = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select(F.col("n_name").alias("artist"), F.col("s_name").alias("title"), F.row_number().over(Window.partitionBy("n_name").orderBy("s_suppkey")).alias("seq"))


@register(
    """WITH q AS (SELECT p_partkey AS id, string_split(p_type || ' ' || p_name, ' ') AS w FROM part), s AS (SELECT id, w, unnest(generate_series(1, len(w))) AS i FROM q),
    t AS (SELECT id, i, unnest(generate_series(i, len(w))) AS j, w FROM s), h AS (SELECT id, i, j, array_to_string(w[i:j], ' ') AS span FROM t)
    SELECT id, arg_min(span, i * 1000 + j) AS entity FROM h WHERE span IN (SELECT DISTINCT p_name FROM part) GROUP BY id"""
)
def span_entity_detection(spark, d):
    part = read(spark, d, "part")
    q = part.select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("query"))
    hits = spans.spans(q, "query", "query", part, "p_name").groupBy("query").agg(F.min_by("span", F.struct("i", "j")).alias("entity"))
    return q.join(hits, "query").select(F.col("p_partkey").alias("id"), "entity")


@register(
    """WITH e AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:n], ' ') AS e FROM benchmark, (SELECT unnest([1, 2, 3]) AS n)),
    w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS span FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n))
    SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(i + n - 1 AS INTEGER) AS j, span FROM s WHERE span IN (SELECT e FROM e)"""
)
def dictionary_spans(spark, d):
    """Every place in all documents where one of the benchmark's first words, pairs or triples of words stands."""
    words = F.split("text", " ")
    entries = read(spark, d, "benchmark").select(F.explode(F.array(*(F.array_join(F.slice(words, 1, n), " ") for n in (1, 2, 3)))).alias("e"))
    docs = read(spark, d, "documents").select("doc_id", "text")
    return spans.spans(docs, "doc_id", "text", entries, "e")


@register(
    """WITH c AS (SELECT p_brand AS query, p_name AS text, p_partkey AS seq, p_size % 12 * 10000.0 - p_partkey % 5 * 100.0 + ln(1 + p_retailprice) AS score FROM part),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query, text ORDER BY score DESC, seq) = 1),
    g AS (SELECT * FROM b QUALIFY score >= max(score) OVER (PARTITION BY query) - 25000)
    SELECT query, text, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, seq) AS INTEGER) AS rank FROM g QUALIFY rank <= 4"""
)
def candidate_rank_dedupe(spark, d):
    c = read(spark, d, "part").select(F.col("p_brand").alias("query"), F.col("p_name").alias("text"), F.col("p_partkey").alias("seq"), tx.candidate_score(F.col("p_size") % 12, F.col("p_partkey") % 5, F.col("p_retailprice")).alias("score"))
    return fuzzy.suggestions(fuzzy.best_per_text(c, ["query", "text"])).select("query", "text", F.round("score", 4).alias("score"), "rank")


@register(
    """WITH c AS (SELECT p_brand AS query, unnest(string_split(p_name, ' ')) AS word, p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand) AS weight FROM part)
    SELECT query, word, round(max(weight), 3) AS weight FROM c GROUP BY ALL HAVING round(max(weight), 3) >= 0.3"""
)
def word_bag_weights(spark, d):
    part = read(spark, d, "part")
    top = part.groupBy("p_brand").agg(F.max("p_retailprice").alias("top"))
    c = part.join(top, "p_brand").select(F.col("p_brand").alias("query"), F.explode(F.split("p_name", " ")).alias("word"), (F.col("p_retailprice") / F.col("top")).alias("weight"))
    return c.groupBy("query", "word").agg(F.round(F.max("weight"), 3).alias("weight")).where("weight >= 0.3")


@register()
def weighted_edit_distance(spark, d):
    pairs = fuzzy.pairs_by_length(typed(spark), read(spark, d, "part").select(F.col("p_name").alias("phrase")).distinct(), 4)
    return pairs.select("query", "phrase", F.round(weighted_distance("query", "phrase"), 6).alias("distance"))


@register()
def word_bag_parse(spark, d):
    titles = fuzzy.dictionary(read(spark, d, "part"), "p_name", "p_partkey").select("phrase", "freq")
    lexicon = read(spark, d, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("freq"))
    return fuzzy.word_bag(typed(spark), titles, lexicon)


@register(
    """SELECT page_id, coalesce(regexp_matches(url, '(?i)example\\.(com|net)') AND regexp_matches(url, '/[a-z]{2}/'), false) AS is_song, coalesce(regexp_matches(url, '(?i)blog|#top'), false) AS excluded,
    coalesce(regexp_matches(url, '(?i)example\\.(com|net)') AND regexp_matches(url, '/[a-z]{2}/'), false) AND NOT coalesce(regexp_matches(url, '(?i)blog|#top'), false) AS kept FROM pages"""
)
def page_classifier(spark, d):
    song = F.coalesce(F.col("url").rlike(r"(?iu)example\.(com|net)") & F.col("url").rlike(r"/[a-z]{2}/"), F.lit(False))
    out = F.coalesce(F.col("url").rlike(r"(?iu)blog|#top"), F.lit(False))
    return read(spark, d, "pages").select("page_id", song.alias("is_song"), out.alias("excluded"), (song & ~out).alias("kept"))


@register("SELECT event_type, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, count(*) AS n FROM events GROUP BY 1")
def session_means_medians(spark, d):
    events = read(spark, d, "events")
    half = quantiles.grouped_quantiles(events, ["event_type"], "value", [0.5]).select("event_type", F.round("value", 6).alias("median_value"))
    means = events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n"))
    return means.join(half, F.equal_null(means["event_type"], half["event_type"]), "left").select(means["event_type"], "mean_value", "median_value", "n")


@register(" UNION ALL ".join(f"SELECT l_returnflag, CAST(l_linenumber AS INTEGER) AS day, {p}::DOUBLE AS p, round(quantile_cont(l_extendedprice, {p}), 4) AS value FROM lineitem GROUP BY 1, 2" for p in (0.0, 0.1, 0.5, 0.99, 1.0)))
def grouped_percentiles(spark, d):
    """Exact percentiles of groups, without a task that holds a group."""
    items = read(spark, d, "lineitem").withColumn("day", F.col("l_linenumber").cast("int"))
    return quantiles.grouped_quantiles(items, ["l_returnflag", "day"], "l_extendedprice", [0.0, 0.1, 0.5, 0.99, 1.0], 1000).withColumn("value", F.round("value", 4))


@register("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_mean FROM lineitem GROUP BY 1")
def weighted_mean(spark, d):
    return weighted.weighted_mean(read(spark, d, "lineitem"), "l_discount", "l_quantity", "l_returnflag").select("l_returnflag", F.round("weighted_mean", 6).alias("weighted_mean"))


_CUM = "(SELECT x, w, sum(w) OVER (ORDER BY x) AS cum, sum(w) OVER () AS total FROM (SELECT l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 AND l_extendedprice IS NOT NULL GROUP BY 1))"


@register(f"SELECT p / 100.0 AS p, round(min(x), 6) AS value FROM {_CUM} c, (SELECT unnest(generate_series(0, 100, 10)) AS p) WHERE cum >= p / 100.0 * total - 1e-9 * total GROUP BY p")
def weighted_deciles(spark, d):
    out = weighted.percentiles(read(spark, d, "lineitem"), "l_extendedprice", "l_quantity", [i / 10 for i in range(11)])
    return out.select("p", F.round("value", 6).alias("value"))


@register("SELECT t AS at_most, round(sum(CASE WHEN l_discount <= t THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS share FROM lineitem, (SELECT unnest([0.02::DOUBLE, 0.05::DOUBLE]) AS t) GROUP BY t")
def conditional_share(spark, d):
    return weighted.shares_below(read(spark, d, "lineitem"), "l_discount", "l_quantity", [0.02, 0.05]).select("at_most", F.round("share", 6).alias("share"))


@register(
    """WITH h AS (SELECT least(floor((l_quantity - 1.0) / 7.0), 6)::INTEGER AS bin, sum(l_extendedprice) AS w FROM lineitem WHERE l_extendedprice > 0 AND l_quantity >= 1 AND l_quantity <= 50 GROUP BY 1)
    SELECT bin, round(w / (sum(w) OVER () * 7.0), 6) AS density FROM h"""
)
def weighted_histogram(spark, d):
    return weighted.histogram(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 1.0, 7.0, 7).select("bin", F.round("density", 6).alias("density"))


@register(f"SELECT x, round(cum / total, 6) AS share FROM {_CUM}")
def weighted_cdf(spark, d):
    return weighted.cumulative(read(spark, d, "lineitem"), "l_extendedprice", "l_quantity").select("x", F.round(F.col("cum") / F.col("total"), 6).alias("share"))


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top20(spark, d):
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@register("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) > 0 AND trim(event_type) <> ''")
def coerce_and_drop(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return read(spark, d, "events").select("event_id", k.alias("k"), "event_type").where((F.col("k") > 0) & (F.trim("event_type") != "")).select("event_id", "k")


_PACK = "'Artista: ' || source || ' | Cançó: ' || lang || ' | Lletra: ' || text"


@register(
    f"""SELECT doc_id, nullif(regexp_extract(p, 'Artista:\\s*(.*?)\\s*\\|\\s*Cançó:\\s*(.*?)\\s*\\|\\s*Lletra:\\s*(.*)', 1), '') AS artista, md5(regexp_extract(p, 'Artista:\\s*(.*?)\\s*\\|\\s*Cançó:\\s*(.*?)\\s*\\|\\s*Lletra:\\s*(.*)', 3)) AS lletra
    FROM (SELECT doc_id, {_PACK} AS p FROM documents)"""
)
def regex_extract_fields(spark, d):
    pattern = r"(?d)Artista:\s*(.*?)\s*\|\s*Cançó:\s*(.*?)\s*\|\s*Lletra:\s*(.*)"
    p = F.concat(F.lit("Artista: "), "source", F.lit(" | Cançó: "), "lang", F.lit(" | Lletra: "), "text")
    return read(spark, d, "documents").select("doc_id", F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")).alias("artista"), F.md5(F.regexp_extract(p, pattern, 3)).alias("lletra"))


_VID = "'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) || '&t=1'"


@register(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN substr(md5(url), 1, 11) END AS youtube_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) ELSE trim(url) END AS source FROM pages")
def url_id_normalize(spark, d):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), F.substring(F.md5("url"), 1, 11), F.lit("&t=1"))).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", tx.video_id(u).alias("youtube_id"), tx.canonical_url(u).alias("source"))


@register(
    """WITH m AS (SELECT p_brand, substr(p_type, 1, 1) || '---' || p_name AS label, sum(p_retailprice) AS s FROM part GROUP BY ALL), g AS (SELECT p_brand, split_part(label, '---', 1) AS parent, sum(s) AS total FROM m GROUP BY ALL)
    SELECT p_brand, parent, round(total, 4) AS total FROM g QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round(total, 4) DESC, parent) = 1"""
)
def parent_label_rollup(spark, d):
    label = F.concat(F.substring("p_type", 1, 1), F.lit("---"), "p_name")
    m = read(spark, d, "part").groupBy("p_brand", label.alias("label")).agg(F.sum("p_retailprice").alias("s")).groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("label", "s"))).alias("m"))
    p = m.select("p_brand", F.transform_values(features.parents(F.col("m")), lambda k, x: F.round(x, 4)).alias("p"))
    return p.select("p_brand", features.arg_max(F.col("p")).alias("parent")).join(p, "p_brand").select("p_brand", "parent", F.col("p")[F.col("parent")].alias("total"))


@register("SELECT user_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{t}'), 0.0), 4) AS \"Event_{t}\"" for t in ("view", "click", "purchase")) + " FROM events GROUP BY user_id")
def map_flatten(spark, d):
    m = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("s")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "s"))).alias("m"))
    return m.select("user_id", *features.flatten(F.col("m"), ["view", "click", "purchase"], "Event"))


@register()
def map_topk_json(spark, d):
    m = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("s")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "s"))).alias("m"))
    return m.select("user_id", features.top_json(F.col("m"), 5).alias("top"))


@register(
    """SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 0.45 * CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.35 END + 0.35 * greatest(0, least(1, l_extendedprice / 4000.0)) + 0.2 * greatest(0, least(1, (l_quantity - 50 + 45.0) / 45.0)))), 9) AS valence,
    round(greatest(0, least(1, 0.4 * l_discount + 0.3 * l_tax + 0.2 * l_discount + 0.1 * l_tax)), 6) AS danceability FROM lineitem"""
)
def valence_danceability(spark, d):
    c = F.col
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(v.valence(c("l_returnflag") == "A", c("l_extendedprice"), c("l_quantity") - 50), 9).alias("valence"), F.round(v.danceability(c("l_discount"), c("l_tax"), c("l_discount"), c("l_tax")), 6).alias("danceability"))


@register(f"SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM {E}) GROUP BY ALL")
def chunk_mean_pool(spark, d):
    return retrieval.chunk_means(read(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("mean").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


@register(f"SELECT id, CAST(i AS INTEGER) AS patch, round(list_sum(e[i * 8 + 1 : i * 8 + 16]), 6) AS total FROM {E}, (SELECT unnest(generate_series(0, 6)) AS i)")
def sliding_patches(spark, d):
    w = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(features.windows(v.doubles(F.col("embedding")), 16, 8)).alias("patch", "w"))
    return w.select("id", "patch", F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def unprocessed_anti_join(spark, d):
    return jobs.unprocessed(read(spark, d, "customer").select("c_custkey", "c_name"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@register("SELECT event_id, event_type, value FROM events")
def resumable_stream(spark, d):
    """The events as a file stream that is run twice; the second run adds nothing."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):
        jobs.ingest(spark, f"{d}/events.parq*et", f"{base}/out", f"{base}/state")
    return spark.read.schema(EVENTS).parquet(f"{base}/out").select("event_id", "event_type", "value")


from . import catalogue_shapes  # noqa: E402, F401  (registers its queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
