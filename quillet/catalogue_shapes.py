"""Registered queries of result shapes, parsing, session statistics, audio expressions and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import COS, TYPED, E, read, register, typed
from .functions import text as tx
from .functions import vectors as v
from .operators import audio, etl, features, fuzzy, instant, layout, parser, presentation, retrieval, trigrams
from .streaming import jobs

#: Songs for the shapes of results: parts stand in for them.
_SONGS = "(SELECT p_partkey AS id, p_name || ' ' || p_partkey AS title, p_brand AS artist, p_type AS album, (['pop', 'rock', 'jazz', NULL])[p_partkey % 4 + 1] AS genre, p_size AS year, substr(p_name, 1, 20) AS lyrics_snippet FROM part)"


def songs(spark, d):
    genre = F.get(F.array(F.lit("pop"), F.lit("rock"), F.lit("jazz"), F.lit(None)), (F.col("p_partkey") % 4).cast("int"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), genre.alias("genre"), F.col("p_size").alias("year"), F.substring("p_name", 1, 20).alias("lyrics_snippet"))


@register(f"SELECT id, title, artist, album, genre, year, lyrics_snippet, 0.0::DOUBLE AS score FROM {_SONGS}")
def result_records(spark, d):
    return presentation.results(songs(spark, d))


@register(f"SELECT id, title, artist, album, genre, year, lyrics_snippet, '' AS full_lyrics, NULL::VARCHAR AS url, NULL::VARCHAR AS duration, NULL::VARCHAR AS language FROM {_SONGS} WHERE id = 7")
def detail_record(spark, d):
    return presentation.details(songs(spark, d).where("id = 7"))


@register(f"SELECT id, title, artist, lyrics_snippet, genre FROM {_SONGS}")
def instant_records(spark, d):
    return presentation.instant_hits(songs(spark, d))


@register(f"SELECT id, title, 0.5::DOUBLE AS score FROM {_SONGS}")
def blank_query_scores(spark, d):
    return presentation.constant_score(songs(spark, d)).select("id", "title", "score")


@register(f"SELECT s.id, round(e[1], 4) AS x, round(e[2], 4) AS y, title, artist, genre, 'neighbor' AS role FROM {_SONGS} s JOIN {E} p ON s.id = p.id")
def projected_points(spark, d):
    at = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return presentation.points(songs(spark, d), at)


@register(f"SELECT id, coalesce(MAP {{'pop': '#FF6B6B', 'rock': '#00BFA5'}}[genre], '#888') AS colour FROM {_SONGS}")
def genre_colours(spark, d):
    return songs(spark, d).select("id", presentation.colour(F.col("genre")).alias("colour"))


_SCORED = "(SELECT c_custkey AS id, coalesce(score, 0.0) AS score FROM customer LEFT JOIN (SELECT o_custkey AS id, round(max(o_totalprice) / 1e6, 6) AS score FROM orders GROUP BY 1) o ON o.id = c_custkey)"


def _scored(spark, d):
    best = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.max("o_totalprice") / 1e6, 6).alias("score"))
    return presentation.with_scores(read(spark, d, "customer").select(F.col("c_custkey").alias("id")), best)


@register(f"SELECT id, score FROM {_SCORED}")
def default_score_join(spark, d):
    return _scored(spark, d)


@register(
    f"""SELECT id, round(score / b, 9) AS norm, CAST(round(score / b * 100) AS INTEGER) AS percent,
    round(CASE WHEN b > 0.6 THEN greatest(3.0, score / b * 40) ELSE 3 + (id * 2654435761 % 4294967296) / 4294967296.0 * 6 END, 6) AS height
    FROM {_SCORED}, (SELECT greatest(max(score), 0.01) AS b FROM {_SCORED})"""
)
def relative_scores(spark, d):
    return presentation.relative_scores(_scored(spark, d)).select("id", F.round("norm", 9).alias("norm"), "percent", F.round("height", 6).alias("height"))


@register("SELECT s_nationkey AS artist, list(s_name ORDER BY s_suppkey) AS t, array_to_string(list(s_name ORDER BY s_suppkey), '|') AS titles FROM supplier GROUP BY 1".replace("list(s_name ORDER BY s_suppkey) AS t, ", ""))
def titles_by_artist(spark, d):
    return presentation.ordered_titles(read(spark, d, "supplier"), "s_nationkey", "s_name", "s_suppkey").select(F.col("s_nationkey").alias("artist"), F.array_join("titles", "|").alias("titles"))


@register(
    f"""WITH s AS (SELECT q.id AS query_id, r.id, {COS}(q.e, r.e) AS s FROM {E} q, {E} r)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id DESC) AS INTEGER) AS rank, id, round(s, 6) AS score FROM s QUALIFY rank <= 3"""
)
def multi_query_topk(spark, d):
    rows = read(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return retrieval.top_k(rows, rows.select(F.col("id").alias("query_id"), "embedding"), 3).withColumn("score", F.round("score", 6))


@register("SELECT CAST(floor(n / 3) AS BIGINT) AS n, CASE WHEN n <= 5 THEN 'Explora les ' || n || ' cançons per tu' END AS message FROM (SELECT n_nationkey AS n FROM nation)")
def survivor_message(spark, d):
    n = F.col("n_nationkey")
    return read(spark, d, "nation").select(F.floor(n / 3).alias("n"), presentation.message(n).alias("message"))


_TOTALS = "(SELECT user_id, event_type, sum(value) AS s FROM events GROUP BY ALL)"


@register("SELECT c_custkey, map_entries(MAP([c_name, c_mktsegment], [c_acctbal, 1.0]))[1].value AS first FROM customer")
def zipped_map(spark, d):
    c = read(spark, d, "customer")
    return c.select("c_custkey", F.map_values(presentation.labelled(F.array("c_name", "c_mktsegment", F.lit("z")), F.array("c_acctbal", F.lit(1.0))))[0].alias("first"))


@register("SELECT p_partkey, regexp_replace(p_name, '(?i)(anvil|bolt)', '<mark>\\1</mark>', 'g') AS marked FROM part".replace("(?i)(anvil|bolt)", "(?i)(anvil|bolt|old)"))
def highlighted(spark, d):
    return read(spark, d, "part").select("p_partkey", tx.highlight(F.col("p_name"), ["bolt", "anvil", "old"]).alias("marked"))


@register(
    """SELECT doc_id, md5(trim('passage: ' || coalesce(source, '') || ' by ' || coalesce(lang, '') || '. Genre: ' || coalesce(lang, '') || '. ' || coalesce(text, ''))) AS short,
    md5('passage: Títol: ' || coalesce(source, '') || chr(10) || 'Artista: ' || coalesce(lang, '') || chr(10) || 'Àlbum: ' || coalesce(lang, '') || chr(10) || 'Lletra:' || chr(10) || coalesce(text, '')) AS long,
    md5('query: ' || source) AS named, CASE WHEN length(text) > 150 THEN md5(replace(substr(text, 1, 150), chr(10), ' ') || '…') ELSE md5(replace(text, chr(10), ' ')) END AS snippet FROM documents"""
)
def passages(spark, d):
    s, g, t = F.col("source"), F.col("lang"), F.col("text")
    return read(spark, d, "documents").select("doc_id", F.md5(tx.passage(s, g, g, t)).alias("short"), F.md5(presentation.song_passage(s, g, g, t)).alias("long"), F.md5(presentation.prefixed(s, "title")).alias("named"), F.md5(tx.snippet(t)).alias("snippet"))


@register(f"SELECT id, e[1] AS c_1, e[2] AS c_2, e[3] AS c_3, (id * 2654435761 % 4294967296) / 4294967296.0 AS hash FROM {E}")
def numbered_columns(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *features.numbered(v.doubles(F.col("embedding")), 3, "c"), v.id_hash(F.col("vec_id")).alias("hash"))


@register(f"SELECT id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(e, lambda x: x * x)) / greatest(list_sum(list_transform(e, lambda x: x * x)), 1e-300), 6) AS unit FROM {E}")
def unit_vectors(spark, d):
    e = F.col("embedding")
    unit = v.normalised(e)
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(v.norm(e), 6).alias("norm"), F.round(v.dot(unit, unit), 6).alias("unit"))


@register(
    f"""SELECT id, round(sqrt(list_avg(list_transform(e, lambda x: x * x))), 6) AS rms, round(len(list_filter(generate_series(2, len(e)), lambda i: (e[i] < 0) <> (e[i - 1] < 0))) / len(e), 6) AS crossings,
    round(coalesce(list_avg(list_filter(e, lambda x: x > 0.1)), 0), 6) AS mean, round(coalesce(list_stddev_pop(list_filter(e, lambda x: x > 0.1)), 0), 6) AS std, round(list_sum([e[31], e[62]]), 6) AS sampled FROM {E}"""
)
def signal_statistics(spark, d):
    e = v.doubles(F.col("embedding"))
    mean, std = audio.mean_and_std(F.col("sure"))
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), e.alias("e"), audio.sure_pitches(e, e, 0.1).alias("sure"))
    return rows.select("id", F.round(audio.rms(F.col("e")), 6).alias("rms"), F.round(audio.crossing_rate(F.col("e")), 6).alias("crossings"), F.round(mean, 6).alias("mean"), F.round(std, 6).alias("std"), F.round(F.aggregate(audio.every_frame(F.col("e")), F.lit(0.0), lambda s, x: s + x), 6).alias("sampled"))


@register("SELECT user_id, round(CASE WHEN sum(value) > 0 THEN count(*) / sum(value) ELSE 0.0 END, 9) AS rate, greatest(count(*) - 1, 0)::DOUBLE AS extra FROM events GROUP BY 1")
def event_rates(spark, d):
    e = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return e.select("user_id", F.round(audio.rate(F.col("n"), F.col("s")), 9).alias("rate"), etl.extra_views(F.col("n").cast("double")).alias("extra"))


@register()
def audio_descriptors(spark, d):
    """Kernels over signals made of the vectors, tiled to two and a half seconds."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("youtube_id"), F.flatten(F.array_repeat(v.doubles(F.col("embedding")), 625)).alias("samples"))
    return audio.base_features(rows)


_REPORT = """(SELECT CASE page_id % 4 WHEN 0 THEN 'Nom ' || page_id || ', de l''àlbum "Disc" (Grup) - Lloc' WHEN 1 THEN 'Agenda de l’àlbum (x) - LLOC' WHEN 2 THEN 'Inici' ELSE NULL END AS title,
  (page_id % 17)::DOUBLE AS sessions, 1 + page_id % 5 / 10.0 AS views, 10.0 * (page_id % 7) AS duration FROM pages)"""
_PAGE = "coalesce(regexp_matches(title, '(?i)de l[''’]àlbum') AND regexp_matches(title, '\\(.+\\)') AND regexp_matches(title, '(?i)-\\s*Lloc$'), false) AND NOT coalesce(regexp_matches(title, '(?i)agenda|inici'), false)"


def _report(spark, d):
    i = F.col("page_id")
    title = F.when(i % 4 == 0, F.concat(F.lit("Nom "), i.cast("string"), F.lit(', de l\'àlbum "Disc" (Grup) - Lloc'))).when(i % 4 == 1, F.lit("Agenda de l’àlbum (x) - LLOC")).when(i % 4 == 2, F.lit("Inici"))
    return read(spark, d, "pages").select(title.alias("title"), (i % 17).cast("double").alias(etl.METRICS[0]), (1 + i % 5 / 10).alias(etl.METRICS[1]), (10.0 * (i % 7)).alias(etl.METRICS[2]))


@register(
    f"""SELECT count(*) AS rows, count(*) FILTER ({_PAGE}) AS songs, round(avg(CASE WHEN {_PAGE} THEN 100.0 ELSE 0 END), 6) AS percent, round(avg(sessions) FILTER ({_PAGE}), 6) AS mean_sessions, median(sessions) FILTER ({_PAGE}) AS median_sessions,
    round(avg(views) FILTER ({_PAGE}), 6) AS mean_views, round(median(duration) FILTER ({_PAGE}), 6) AS median_duration FROM {_REPORT}"""
)
def page_report(spark, d):
    s, w, t = etl.METRICS
    out = etl.page_statistics(_report(spark, d), "Lloc")
    return out.select("rows", "songs", F.round("percent", 6).alias("percent"), F.round(f"mean {s}", 6).alias("mean_sessions"), F.col(f"median {s}").alias("median_sessions"), F.round(f"mean {w}", 6).alias("mean_views"), F.round(f"median {t}", 6).alias("median_duration"))


@register(f"SELECT title, sessions FROM {_REPORT} WHERE {_PAGE} ORDER BY sessions DESC, title LIMIT 20")
def top_song_pages(spark, d):
    return etl.top_pages(_report(spark, d), "Lloc").select("title", F.col(etl.METRICS[0]).alias("sessions"))


@register(f"SELECT title FROM {_REPORT} WHERE NOT ({_PAGE}) ORDER BY title NULLS FIRST LIMIT 15")
def excluded_pages(spark, d):
    return etl.examples(_report(spark, d), "Lloc", False)


@register("SELECT count(*) AS rows_before, sum(l_quantity) AS sum_before, count(*) FILTER (l_quantity >= 5) AS rows_after, sum(l_quantity) FILTER (l_quantity >= 5) AS sum_after FROM lineitem")
def minimum_support(spark, d):
    return etl.supported(read(spark, d, "lineitem"), "l_quantity")[1]


_PACKED = "'Artista: ' || source || ' | Cançó: ' || lang || ' | Lletra: ' || text"


@register(f"SELECT doc_id, md5(source) AS artista, lang AS canco, md5(string_split(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))[1]) AS lletra FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
def packed_extraction(spark, d):
    p = F.concat(F.lit("Artista: "), "source", F.lit(" | Cançó: "), "lang", F.lit(" | Lletra: "), "text")
    rows = read(spark, d, "documents").where("text is not null and source is not null and lang is not null")
    return etl.extract_packed(rows.withColumn("p", p), "p").select("doc_id", F.md5("artista").alias("artista"), F.col("canco"), F.md5("lletra").alias("lletra"))


#: Words of a chunk of a document: fewer than the encoder reads.
CHUNK = 200


@register()
def song_embeddings(spark, d):
    """The embedding job over documents: every CHUNK words are a chunk; missing fields have zeros."""
    words = F.split(F.regexp_replace("text", r"['\[\]\\\"\s]+", " "), " ")
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / CHUNK)), lambda i: F.array_join(F.slice(words, (i * CHUNK + 1).cast("int"), CHUNK), " "))
    lines = F.concat(F.lit("['"), F.array_join(cuts, "', '"), F.lit("']"))
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("song_id"), lines.alias("lyrics_chunks"), F.lit(None).cast("string").alias("noised_chunks"), F.col("source").alias("title"), F.lit(None).cast("string").alias("noised_title"), F.col("lang").alias("author"), F.lit(None).cast("string").alias("noised_author"))
    return etl.embed_songs(rows).select("song_id", *(F.round(v.norm(F.col(c)), 6).alias(c) for c in ("song_emb", "noised_song_emb", "title_emb", "author_emb")))


_POINTS = f"(SELECT id, e[1] AS x, e[2] AS y FROM {E})"


def _points(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


@register(f"SELECT greatest(max(abs(x)), max(abs(y)), 10.0) * 2.5 AS distance FROM {_POINTS}")
def camera_distance(spark, d):
    return presentation.camera_distance(_points(spark, d))


@register(f"SELECT id, round(sqrt((x - 0.1) ** 2 + (y - 0.2) ** 2), 6) AS distance FROM {_POINTS} WHERE sqrt((x - 0.1) ** 2 + (y - 0.2) ** 2) < 20 ORDER BY sqrt((x - 0.1) ** 2 + (y - 0.2) ** 2), id LIMIT 1")
def nearest_point(spark, d):
    p = _points(spark, d).select("id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    return presentation.nearest_point(p, 0.1, 0.2).select("id", F.round("distance", 6).alias("distance"))


@register(f"SELECT label, round(m, 6) + 0.0 AS first, round(n, 6) + 0.0 AS last FROM (SELECT label, sum(CASE WHEN id % 3 <> 0 THEN e[1] ELSE 0 END) / greatest(sum(CASE WHEN id % 3 <> 0 THEN 1 ELSE 0 END), 1e-9) AS m, sum(CASE WHEN id % 3 <> 0 THEN e[64] ELSE 0 END) / greatest(sum(CASE WHEN id % 3 <> 0 THEN 1 ELSE 0 END), 1e-9) AS n FROM {E} GROUP BY 1)")
def masked_mean_pool(spark, d):
    """Mean vectors of a label over the rows that a mask keeps, as tokens are pooled."""
    rows = read(spark, d, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    mean = retrieval.chunk_means(rows, "label", "embedding", "mask")
    return mean.select("label", (F.round(F.get("mean", F.lit(0)), 6) + 0.0).alias("first"), (F.round(F.get("mean", F.lit(63)), 6) + 0.0).alias("last"))


@register(f"SELECT id, id IN (SELECT id FROM {E} WHERE label = 1) AS active FROM {_POINTS}")
def point_layers(spark, d):
    on = read(spark, d, "embeddings").where("label = 1").select(F.col("vec_id").alias("id"))
    return presentation.layers(_points(spark, d), on).select("id", "active")


@register()
def grid_without_collisions(spark, d):
    return layout.snap_to_grid(_points(spark, d))


@register()
def catalogue_layout(spark, d):
    """Places of all vectors in the scaled layout of the whole table; its distances are tested in
    tests/test_statistics.py."""
    return layout.whole_layout(read(spark, d, "embeddings"), "vec_id", "embedding", "mds", landmarks=200)


@register(f"SELECT id, title, artist FROM {_SONGS} ORDER BY title, id LIMIT 20")
def second_page(spark, d):
    return presentation.page(songs(spark, d), 20, "title", "id").select("id", "title", "artist")


@register("SELECT p_name AS title, p_brand AS artist FROM part UNION ALL SELECT source, '' FROM documents")
def catalogue_and_news(spark, d):
    own = read(spark, d, "part").select(F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    return own.unionByName(read(spark, d, "documents").select(F.col("source").alias("title"), F.lit("").alias("artist")))


@register("SELECT DISTINCT p_brand AS artist FROM part ORDER BY CASE WHEN p_brand = 'Brand#12' THEN 0 ELSE 1 END, p_brand LIMIT 5")
def matched_artist_first(spark, d):
    return presentation.front(read(spark, d, "part").select(F.col("p_brand").alias("artist")).distinct(), "artist", "Brand#12", 5)


@register("SELECT w.word, coalesce(n, 0) AS freq FROM (SELECT unnest(['bolt', 'anvil', 'zzz']) AS word) w LEFT JOIN (SELECT unnest(string_split(p_name, ' ')) AS word, count(*) AS n FROM part GROUP BY 1) c USING (word)")
def dictionary_frequency(spark, d):
    c = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return spark.createDataFrame([("bolt",), ("anvil",), ("zzz",)], "word string").join(c, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("freq"))


@register("SELECT DISTINCT trim(p_brand) AS name FROM part")
def distinct_artists(spark, d):
    return features.artists(read(spark, d, "part"), "p_brand", "p_type").select("name")


@register(
    """SELECT time_bucket(INTERVAL '1 day', ts) AS start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def tumbling_windows(spark, d):
    return _rounded(jobs.windowed(_events(spark, d), "1 day"))


@register(
    """WITH e AS (SELECT *, unnest([0, 1]) AS k FROM events), w AS (SELECT time_bucket(INTERVAL '12 hours', ts) - k * INTERVAL '12 hours' AS start, * FROM e)
    SELECT start, start + INTERVAL '24 hours' AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL"""
)
def sliding_windows(spark, d):
    return _rounded(jobs.windowed(_events(spark, d), "24 hours", "12 hours"))


@register(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '6 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"""
)
def session_windows(spark, d):
    return _rounded(jobs.sessions(_events(spark, d), "6 hours"))


def _events(spark, d):
    return read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _rounded(df):
    return df.withColumn("total", F.round("total", 4)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def _catalogue(spark, d):
    """Distinct pairs of a type (as artist) and a name (as title); words of names with their counts as lexicon."""
    part = read(spark, d, "part")
    pairs = part.groupBy(F.col("p_type").alias("artist"), F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("seq"))
    words = part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    return parser.catalogue(pairs, words)


@register()
def parse_queries(spark, d):
    """Whole parses: tested against worked-out results in tests/test_engine.py."""
    out = parser.parse(typed(spark), _catalogue(spark, d))
    return out.select("query", "corrected", F.array_join("suggestions", "|").alias("suggestions"), "matched_artist", "matched_title", "tier", "distance", "score", "confident", F.to_json("words").alias("words"))


@register()
def phrase_entities(spark, d):
    q = spark.createDataFrame([(f"{t} blue bolt",) for t in TYPED], "text string")
    return parser.entities(q, _catalogue(spark, d))


#: What the search box looks in: documents, and names of parts.
def _searched(spark, d):
    docs = read(spark, d, "documents").select(F.lit("news").alias("category"), F.col("doc_id").alias("id"), "text")
    return docs.unionByName(read(spark, d, "part").select(F.lit("song").alias("category"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text")))


def _terms(spark, d):
    """Different words of types and names of parts, with pieces and prefixes of them."""
    words = read(spark, d, "part").select(F.explode(F.split(F.concat_ws(" ", "p_type", "p_name"), " ")).alias("w")).distinct()
    return words.select(F.explode(F.array(F.col("w"), F.substring("w", 1, 2), F.substring("w", 2, 4))).alias("term")).distinct()


_FOLD = "replace(strip_accents(lower({0})), '·', '')"
_TERMS = "(SELECT DISTINCT unnest([w, substr(w, 1, 2), substr(w, 2, 4)]) AS term FROM (SELECT DISTINCT unnest(string_split(p_type || ' ' || p_name, ' ')) AS w FROM part))"
_SEARCHED = "(SELECT 'news' AS category, doc_id AS id, text FROM documents UNION ALL SELECT 'song', p_partkey, p_name FROM part)"


@register(f"SELECT term, category, id FROM {_TERMS} t JOIN (SELECT category, id, {_FOLD.format('text')} AS f FROM {_SEARCHED}) s ON contains(f, {_FOLD.format('term')}) WHERE term <> ''")
def substring_search(spark, d):
    """Many terms over all texts at once, by the trigram index."""
    return trigrams.search(_terms(spark, d), trigrams.index(_searched(spark, d), ["category", "id"], "text"))


@register(
    f"""WITH h AS (SELECT term, category, id FROM {_TERMS} t JOIN (SELECT category, id, {_FOLD.format('text')} AS f FROM {_SEARCHED}) s ON contains(f, {_FOLD.format('term')}) WHERE term <> ''),
    r AS (SELECT term, category, id, CAST(row_number() OVER (PARTITION BY term, category ORDER BY id) AS INTEGER) AS rank FROM h)
    SELECT term, category, rank, id FROM r WHERE rank <= CASE WHEN category = 'song' THEN 8 ELSE 5 END"""
)
def instant_hits_batch(spark, d):
    """What the search box lists for each of many terms: eight songs, five news."""
    hits = substring_search(spark, d)
    rank = F.row_number().over(Window.partitionBy("term", "category").orderBy("id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("category") == "song", 8).otherwise(5)).select("term", "category", "rank", "id")


def _instant(spark, d):
    news = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("snippet"))
    part = read(spark, d, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    own = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("artist"), F.col("p_brand").alias("genre"), F.col("p_type").alias("lyrics_snippet"))
    return own, news, words


@register()
def instant_search(spark, d):
    """Instant searches from end to end, many at once: hits by category, as rows; equal to single searches in
    tests/test_engine.py."""
    own, news, words = _instant(spark, d)
    return instant.search(typed(spark), instant.searched(own, news, instant.dictionaries(own, news, words)))


_FIELDS = "(SELECT 'artist' AS category, trim(p_type) AS key, p_type AS text FROM part UNION ALL SELECT 'song', CAST(p_partkey AS VARCHAR), p_name FROM part UNION ALL SELECT 'song', CAST(p_partkey AS VARCHAR), p_type FROM part UNION ALL SELECT 'news', CAST(doc_id AS VARCHAR), source FROM documents UNION ALL SELECT 'news', CAST(doc_id AS VARCHAR), text FROM documents)"


@register(
    f"""WITH q AS (SELECT p_name AS query, min(p_type) AS artist FROM part GROUP BY 1),
    t AS (SELECT DISTINCT query, artist, unnest(list_concat([lower(query), lower(artist)], list_filter(string_split(lower(query), ' '), lambda w: len(w) >= 4))) AS term FROM q),
    m AS (SELECT DISTINCT term, category, key FROM (SELECT DISTINCT term FROM t) JOIN (SELECT category, key, {_FOLD.format('text')} AS f FROM {_FIELDS}) s ON contains(f, term)),
    h AS (SELECT DISTINCT query, artist, category, key FROM t JOIN m USING (term)),
    r AS (SELECT query, category, key, CAST(row_number() OVER (PARTITION BY query, category ORDER BY CASE WHEN category = 'artist' AND key = artist THEN 0 ELSE 1 END, CASE WHEN category = 'artist' THEN 0 ELSE TRY_CAST(key AS BIGINT) END, key) AS INTEGER) AS rank FROM h)
    SELECT query, category, rank, key FROM r WHERE rank <= CASE category WHEN 'song' THEN 8 ELSE 5 END"""
)
def instant_hits(spark, d):
    """The category hits of given parses: every name, with the first type that has it as matched artist."""
    own, news, _ = _instant(spark, d)
    parsed = read(spark, d, "part").groupBy(F.col("p_name").alias("query")).agg(F.min("p_type").alias("matched_artist"))
    parsed = parsed.select("query", F.col("query").alias("corrected"), "matched_artist", F.lit(None).cast("string").alias("matched_title"))
    return instant.hits(parsed, instant.searched(own, news))
