"""Shapes in which results are handed out: records, scores, colours, paging, points on a screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as v

#: Colours of genres, and of any other (fixed values).
GENRE_COLOURS = {"pop": "#FF6B6B", "rock": "#00BFA5", "folk": "#4FC3F7", "electronica": "#AB47BC", "hip-hop": "#FFB74D", "rumba": "#FF8A65"}
OTHER_COLOUR = "#888"
#: Fields of a result, of a detail, and of an instant-search hit.
RESULT = ["id", "title", "artist", "album", "genre", "year", "lyrics_snippet"]
DETAIL = [*RESULT, "full_lyrics", "url", "duration", "language"]
INSTANT = ["id", "title", "artist", "lyrics_snippet", "genre"]
#: Up to so many survivors a message is shown.
FEW = 5


def _fields(songs: DataFrame, names: list[str]) -> list[Column]:
    return [F.col(n) if n in songs.columns else F.lit(None).cast("string").alias(n) for n in names]


def results(songs: DataFrame) -> DataFrame:
    """Seven fields and the score, 0 where there is none."""
    score = F.coalesce(F.col("score"), F.lit(0.0)) if "score" in songs.columns else F.lit(0.0)
    return songs.select(*_fields(songs, RESULT), score.alias("score"))


def details(songs: DataFrame) -> DataFrame:
    """Eleven fields; missing lyrics are empty."""
    d = songs.select(*_fields(songs, DETAIL))
    return d.withColumn("full_lyrics", F.coalesce("full_lyrics", F.lit("")))


def instant_hits(songs: DataFrame) -> DataFrame:
    return songs.select(*_fields(songs, INSTANT))


def constant_score(songs: DataFrame, score: float = 0.5) -> DataFrame:
    """All rows with one score: what a blank query, or a query without a vector, gives."""
    return songs.withColumn("score", F.lit(score))


def points(songs: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Metadata with coordinates(id, x, y[, z]) to 4 places; the role is "neighbor" unless it is given."""
    axes = [c for c in ("x", "y", "z") if c in coordinates.columns]
    role = F.coalesce(F.col("role"), F.lit("neighbor")) if "role" in songs.columns else F.lit("neighbor")
    own = songs.select("id", "title", "artist", "genre", role.alias("role"))
    return own.join(coordinates.select("id", *(F.round(c, 4).alias(c) for c in axes)), "id").select("id", *axes, "title", "artist", "genre", "role")


def song_passage(title: Column, artist: Column, album: Column, lyrics: Column) -> Column:
    """A passage of four labelled lines, as whole songs are encoded."""
    e = [F.coalesce(c, F.lit("")) for c in (title, artist, album, lyrics)]
    return F.concat(F.lit("passage: Títol: "), e[0], F.lit("\nArtista: "), e[1], F.lit("\nÀlbum: "), e[2], F.lit("\nLletra:\n"), e[3])


def prefixed(x: Column, role: str) -> Column:
    """``passage: `` before lyrics, ``query: `` before titles and authors; null stays null."""
    return F.when(x.isNotNull(), F.concat(F.lit("passage: " if role == "lyrics" else "query: "), x))


def colour(genre: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in GENRE_COLOURS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, genre), F.lit(OTHER_COLOUR))


def page(rows: DataFrame, shown: int = 10, *order: str | Column) -> DataFrame:
    """The first ``shown`` rows; more are asked for in steps of ten."""
    return rows.orderBy(*order).limit(shown)


def with_scores(rows: DataFrame, scores: DataFrame, default: float = 0.0) -> DataFrame:
    """Rows with the score of scores(id, score), or the default."""
    return rows.join(scores.select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(default)))


def relative_scores(rows: DataFrame) -> DataFrame:
    """Adds norm (score against the best, which counts 0.01 at least), percent and height of a building: by
    score once a search has been made, else by a number from the id."""
    best = rows.agg(F.greatest(F.max("score"), F.lit(0.01)).alias("quillet_best"))
    d = rows.crossJoin(F.broadcast(best)).withColumn("norm", F.col("score") / F.col("quillet_best"))
    height = F.when(F.col("quillet_best") > 0.6, F.greatest(F.lit(3.0), F.col("norm") * 40)).otherwise(3 + v.id_hash(F.col("id")) * 6)
    return d.withColumn("percent", F.round(F.col("norm") * 100).cast("int")).withColumn("height", height).drop("quillet_best")


def camera_distance(points: DataFrame) -> DataFrame:
    """One row: two and a half times the largest coordinate, which counts 10 at least."""
    axes = [F.max(F.abs(c)) for c in ("x", "y", "z") if c in points.columns]
    return points.agg((F.greatest(*axes, F.lit(10.0)) * 2.5).alias("distance"))


def nearest_point(points: DataFrame, x: float, y: float, zoom: float = 1.0) -> DataFrame:
    """The point nearest to the cursor, if it is within 20 pixels times the zoom; ties to the smaller id."""
    d = points.withColumn("distance", F.hypot(F.col("sx") - x, F.col("sy") - y))
    return d.where(F.col("distance") < 20 * zoom).orderBy("distance", "id").limit(1)


def layers(points: DataFrame, active: DataFrame) -> DataFrame:
    """Points with ``active``: those of active(id) are drawn over the others."""
    on = active.select("id", F.lit(True).alias("active")).distinct()
    return points.join(on, "id", "left").withColumn("active", F.coalesce("active", F.lit(False)))


def message(n: Column) -> Column:
    """What is said to few survivors; else null."""
    return F.when(n <= FEW, F.format_string("Explora les %d cançons per tu", n))


def shown_suggestions(suggestions: Column, n: int = 2) -> Column:
    return F.slice(suggestions, 1, n)


def highlight_terms(query: Column, corrected: Column) -> Column:
    """What is marked in hits: query and correction whole, and their words of three letters or more."""
    q, c = F.trim(query), F.coalesce(corrected, F.lit(""))
    words = F.filter(F.concat(F.split(q, r"\s+"), F.split(c, r"\s+")), lambda w: F.length(w) >= 3)
    return F.filter(F.array_distinct(F.concat(F.array(q, c), words)), lambda w: F.length(w) >= 2)


def search_terms(query: Column, corrected: Column, artist: Column, title: Column) -> Column:
    """Folded terms of an instant search: the query, its correction with words of four letters or more, and
    the artist and title that were matched."""
    q, c = tx.for_match(F.trim(query)), tx.for_match(F.coalesce(corrected, query))
    words = F.filter(F.split(c, r"\s+"), lambda w: F.length(w) >= 4)
    more = F.filter(F.array(q, c, tx.for_match(artist), tx.for_match(title)), lambda w: w.isNotNull() & (w != ""))
    return F.array_distinct(F.concat(more, words))


def labelled(labels: Column, values: Column) -> Column:
    """A map from two arrays, as long as the shorter one."""
    n = F.least(F.size(labels), F.size(values))
    return F.map_from_arrays(F.slice(labels, F.lit(1), n), F.slice(values, F.lit(1), n))


def ordered_titles(songs: DataFrame, artist: str, title: str, seq: str) -> DataFrame:
    """(artist, titles): titles of each artist in order of ``seq``. Meant for artists of some thousands of songs."""
    return songs.groupBy(artist).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(title).alias("t")))), lambda x: x["t"]).alias("titles"))


def front(rows: DataFrame, name_col: str, first: str | None, cap: int) -> DataFrame:
    """The first ``cap`` rows by name, a matched one before all."""
    key = F.when(F.col(name_col) == F.lit(first), 0).otherwise(1) if first is not None else F.lit(1)
    return rows.orderBy(key, name_col).limit(cap)


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Adds a rank from 1 on, over all rows: meant for a limited result."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
