"""Exact search, collocations and spelling variants against brute force, and their edge cases."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm import impact, phrases, queries, spelling
from quillet.llm._common import numbered

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- exact search -----------------------------------------------------------------------------------------


def best(vectors, asked, k, scale=64.0):
    code = {i: np.floor(np.asarray(x, float) * scale).astype(np.int64) for i, x in vectors.items()}
    out = []
    for q in asked:
        scores = sorted((-int(code[q] @ code[c]), c) for c in code if c != q)[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    return sorted(out, key=repr)


def test_op11_brute_force(spark, data):
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    got = queries.op11_exact_search(spark, data)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]
    assert rows(got) == best(table, [i for i in table if i % 20 == 0], 20)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    assert sorted(con.sql(queries.OP11_SQL).fetchall(), key=repr) == rows(got)


@pytest.mark.parametrize("kind", ["dense", "sparse", "few values", "outlier", "wide"])
def test_index_stops_only_on_proof(kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 24)) * 8
    if kind == "sparse":
        x *= rng.random(x.shape) < 0.1
    if kind == "few values":
        x = rng.integers(-1, 2, x.shape)
    if kind == "outlier":
        x[3, 4], x[7] = 1e6, 0
    if kind == "wide":
        x *= 2.0**24
    x = np.clip(np.floor(x), -impact.widest(24), impact.widest(24)).astype(np.int32)
    ids = rng.permutation(5000)[:900].astype(np.int64)
    index = impact.Index(ids, x)
    asked = np.concatenate([np.arange(0, 900, 9), [5]])
    outside = np.array([9999], np.int64)
    qi, q = np.concatenate([ids[asked], outside]), np.concatenate([x[asked], x[:1]])
    query, row, score, added = index.top(qi, q, 7)
    got = {}
    for a, b, s in zip(query.tolist(), index.ids[row].tolist(), score.tolist(), strict=True):
        got.setdefault(a, []).append((-s, b))
    whole = x.astype(np.int64)
    for a in range(len(qi)):
        s = whole @ q[a].astype(np.int64)
        assert got[a] == sorted((-int(v), int(i)) for v, i in zip(s, ids, strict=True) if i != qi[a])[:7]
    assert added <= len(index.cut)
    if kind == "dense":  # few rows can still be among the best before all impacts are added
        assert added < len(index.cut)


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 2.0]), (40, [-1.0, 0.5]), (40, [-1.0, 0.5]), (9, [3e38, -3e38])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1)).withColumn("code", F.lit("x"))
    got = rows(impact.search(df, F.col("vec_id") % 20 == 0, k=3))
    most = impact.widest(2)
    plain = {i: x for i, x in data if i in (0, 20, 1, 2, 40)} | {9: [most / 64, -most / 64]}
    assert got == best(plain, [0, 20, 40], 3)
    assert rows(impact.search(df.limit(0), F.col("vec_id") % 20 == 0)) == []
    assert rows(impact.search(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0)) == []
    assert rows(impact.search(df.where("vec_id in (0, 20)"), F.col("vec_id") % 20 == 0)) == [(0, 1, 20, 0), (20, 1, 0, 0)]


# --- collocations -----------------------------------------------------------------------------------------


def collocated(docs, least, best=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {g: c for g, c in f.items() if c >= least}
    longer = collections.Counter()
    for (lang, g), c in f.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                longer[lang, g[i : i + k]] = max(longer[lang, g[i : i + k]], c)
    out = collections.defaultdict(list)
    for (lang, g), a in f.items():
        if len(g) > 1 and 100 * longer[lang, g] < 80 * a:
            score, _, left, right = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            out[lang].append((-score, -a, " ".join(g).encode(), left, right))
    got = []
    for lang, found in out.items():
        got += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:best])]
    return sorted(got, key=repr)


@pytest.mark.parametrize("least", [30, 3])
def test_op12_brute_force(spark, data, least):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = collocated([(r["text"], r["lang"]) for r in docs.collect()], least)
    got = phrases.collocations(docs, least=least)
    assert rows(got) == want and len(want) >= 50
    if least == 30:
        got = queries.op12_collocations(spark, data)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{data}/documents.parquet'")
        assert sorted(con.sql(queries.OP12_SQL).fetchall(), key=repr) == want


def test_phrases_in_many_slices_and_ranges(spark, data, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 30_000)
    monkeypatch.setattr(phrases, "RANGE", 200_000)
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    assert rows(phrases.collocations(docs, least=4)) == collocated([(r["text"], r["lang"]) for r in docs.collect()], 4)


def test_phrases_odd_rows(spark):
    data = [(1, None, "en"), (2, "", "en"), (3, "A b\tC  d. a B c d", "en"), (4, "a b c d", None), (5, "\x00a b, \x00a b! b b b b b", "de"), (6, "a b c d " * 3000, "fr"), (7, "x" * 300_000, "fr"), (8, ".,;:!?\n\r", "en"), (9, "Ünï Ünï x Ünï ünï", "de"), (3, "A b\tC  d. a B c d", "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("f", F.lit(1)).withColumn("w0", F.lit("x")).withColumn("slice", F.lit(2))
    assert rows(phrases.collocations(df, least=2)) == collocated([(t, g) for _, t, g in data], 2)
    assert rows(phrases.collocations(df.limit(0))) == [] and rows(phrases.collocations(df.where("doc_id = 1"))) == []


def test_radix_sort_of_wide_ids():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**32, (4, 5000), dtype=np.uint32)
    x[:, 2500:] = x[:, :2500]
    keys, n = phrases.run_lengths(x)
    assert (n == 2).all() and keys.T.tolist() == sorted(x[:, :2500].T.tolist())
    assert (np.sort(phrases.as_keys(x)) == phrases.as_keys(x[:, phrases.radix_order(x)])).all()


# --- spelling variants -------------------------------------------------------------------------------------


def variants(docs, length=7, count=2):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= count}
    near = collections.defaultdict(set)
    groups = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            groups[i, w[:i], w[i + 1 :]].add(w)
            less = w[:i] + w[i + 1 :]
            if less in n:
                near[w].add(less)
                near[less].add(w)
    for g in groups.values():
        for w in g:
            near[w] |= g - {w}
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_op13_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = queries.op13_spelling_variants(spark, data)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert [t for _, t in got.dtypes] == ["string", "string", "string", "bigint", "bigint", "bigint"]
    assert rows(got) == want
    assert sum(r[1] is not None for r in want) > 5 and sum(r[4] > 0 for r in want) > 50


def test_variants_odd_rows(spark):
    word = "abcdefgh" * 6
    chain = ["roottext"] * 3000 + ["rootText"] + ["roottxt"] * 250 + ["rootttxt"] * 22 + ["rootttxtx"] * 2
    long = "".join(chr(97 + i * i % 26) for i in range(5000))
    texts = [" ".join(chain), None, "", "short ab", f"{word} {word} {word[:-1]} {word[:-1]} {word[:20]}x{word[21:]} {word[:20]}x{word[21:]}", "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa aaaaaaaaa aaaaaaaaa", " ".join([long, long[:-1], long[1:], long[:2000] + "é" + long[2001:]] * 2), " ".join(["q" * 40, "q" * 39, "q" * 41, "q" * 20 + "z" + "q" * 19] * 3), "ÉCOLIÈRE école×÷abc École×÷abc ÉCOLIÈRE ÉCOLIÈRE"]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "nullids nullids nullidz nullidz"), (3, "short ab")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("no", F.lit("x")).withColumn("key", F.lit(1)).withColumn("word", F.lit("w"))
    want = variants(data)
    assert rows(spelling.variants(df)) == want
    assert {r[2] for r in want if r[0].startswith("roott")} == {"roottext"}
    assert rows(spelling.variants(df.limit(0))) == [] and rows(spelling.variants(df.where("doc_id = 1"))) == []


def test_roots_of_long_chains(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 19)], "no long, form long")
    assert all(r["root"] == 0 for r in spelling.roots(links, 18).collect())


def test_numbers_of_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("a").alias("y"))
    got = numbered(df.repartition(7), F.desc("x")).collect()
    assert sorted((r["no"], r["x"]) for r in got) == [(i, 999 - i) for i in range(1000)]
    assert numbered(df.limit(0), "x").collect() == []
