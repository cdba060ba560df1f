"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, brown, embdedup, impact, langid, linededup, packing, phrases, quality, simhash, spelling, toxicity
from ._common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles linked within 3 of 64 bits; null and empty texts have fingerprint 0."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, tau=3, wide=None)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts and of what they decode to, as digests; null text counts as empty, rows may repeat."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found for every fiftieth id; unusable vectors take no part."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of whole texts; null texts and texts without a letter are ``und``."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document are boilerplate of its source, and what is left."""
    out = linededup.clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_dropped", F.md5("text").alias("text_md5"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of whole texts; empty and null ones are scored too, repeated rows alike."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; null text is empty, repeated rows are documents of their own."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of whole texts with the nearest examples; empty and null ones are scored too."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 within a label and their components; unusable vectors link with nothing."""
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of whole texts; null text counts as empty, whose one token is its end."""
    return brown.score(table(spark, sf_dir, "documents"))


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products for every twentieth id; unusable vectors take no part."""
    return impact.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of 2 to 4 words over whole texts; null text counts as empty."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words of whole texts; null text has none, rows may repeat."""
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_bpe, op3_ann, op4_language_id, op5_line_dedup, op6_quality, op7_packing, op8_toxicity, op9_embedding_dedup, op10_lm_scoring, op11_exact_search, op12_collocations, op13_spelling_variants, pipeline)
    return {f.__name__: f for f in own}


OP5_SQL = f"""
WITH page AS (SELECT DISTINCT coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
total AS (SELECT host, count(*) AS pages FROM page GROUP BY host),
line AS (SELECT DISTINCT host, t, trim(unnest(string_split(t, chr(10)))) AS line FROM page),
bad AS (SELECT host, line FROM (SELECT host, line, count(*) AS n FROM line WHERE line <> '' GROUP BY host, line)
        JOIN total USING (host) WHERE n >= {linededup.MIN_PAGES} AND n > {linededup.RATIO} * pages),
listed AS (SELECT host, list(line) AS lines FROM bad GROUP BY host),
kept AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS own,
         list_filter(string_split(d.text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(coalesce(b.lines, []), trim(x))) AS rest
         FROM documents d LEFT JOIN listed b ON coalesce(d.source, '') = b.host)
SELECT doc_id,
  CAST(CASE WHEN len(list_filter(rest, lambda x: trim(x) <> '')) > 0 THEN len(own) - len(rest) ELSE 0 END AS BIGINT) AS n_dropped,
  md5(CASE WHEN len(list_filter(rest, lambda x: trim(x) <> '')) > 0 THEN array_to_string(rest, chr(10)) ELSE text END) AS text_md5
FROM kept"""

#: Cosine links over all pairs of a label, and their components.
OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
       WHERE e IS NOT NULL AND label IS NOT NULL AND NOT list_contains(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)), true)),
good AS (SELECT * FROM ok WHERE n > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
         WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
cnt AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN cnt USING (vec_id)"""


#: Integer inner products of every twentieth id with all others.
OP11_SQL = """
WITH dim AS (SELECT len(embedding) AS d FROM embeddings WHERE len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS e FROM embeddings
      WHERE len(embedding) = (SELECT d FROM dim) AND NOT list_contains(list_transform(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

#: Phrases as lists of words of whole pieces, counted, cut and compared with longer ones.
OP12_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
words AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY 1),
gram AS (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, g, count(*) AS f FROM gram GROUP BY 1, 2 HAVING count(*) >= 30),
cut AS (SELECT lang, g, f AS a, unnest(generate_series(1, len(g) - 1)) AS k FROM f WHERE len(g) >= 2),
scored AS (SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
           FROM cut c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:len(c.g)]),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
part AS (SELECT lang, g[i:i + k - 1] AS g, f FROM (SELECT lang, g, f, k, unnest(generate_series(1, len(g) - k + 1)) AS i FROM f, (SELECT unnest([2, 3]) AS k) WHERE len(g) > k)),
more AS (SELECT lang, g, max(f) AS m FROM part GROUP BY 1, 2),
kept AS (SELECT low.lang, array_to_string(low.g, ' ') AS phrase, a, l, r, score FROM low LEFT JOIN more ON more.lang = low.lang AND more.g = low.g
         WHERE m IS NULL OR 100 * m::HUGEINT < 80 * a::HUGEINT),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query: the others are tested against brute force."""
    return {"op5_line_dedup": OP5_SQL, "op9_embedding_dedup": OP9_SQL, "op11_exact_search": OP11_SQL, "op12_collocations": OP12_SQL}
