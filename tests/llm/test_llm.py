"""The training-data operators against brute force, and their edge cases."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillet.llm import ann, bpe, brown, embdedup, langid, linededup, packing, quality, queries, simhash, toxicity
from quillet.llm._common import components

ODD = [
    (1, "a b c d e f g h", "en", "x", 1), (2, "a b c d e f g h", "en", "x", 2), (2, "a b c d e f g h", "en", "x", 2), (3, None, None, None, None),
    (4, "", "en", "", 0), (5, " \n\t ", "fr", "x", 0), (6, "Ünïcode ½ ² Σίσυφος 日本語 it's <|endoftext|> \x1c x", "de", "y", 9), (7, "word " * 30000, "en", "y", 9), (None, "no id here", "en", "x", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, a long text, and extra columns whose names clash with internal ones."""
    return spark.createDataFrame(ODD, SCHEMA).withColumn("fp", F.lit("x")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def fingerprint(text, k):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op1_brute_force(spark, data, docs):
    fp = {i: fingerprint(t, 3) for i, t in docs.items()}
    want = groups(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    got = {r["doc_id"]: r for r in queries.op1_simhash(spark, data).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fp.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want


@pytest.mark.parametrize("tau", [3, 8, 12])
def test_pigeonhole_loses_no_pair(spark, tau):
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    rows = set(base.tolist())
    for b in base.tolist():
        for _ in range(5):
            x = b
            for bit in rng.choice(63, rng.integers(0, tau + 3), replace=False):
                x ^= 1 << int(bit)
            rows.add(x)
    rows = sorted(rows)
    want = groups(rows, [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if (a ^ b).bit_count() <= tau])
    got = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(r,) for r in rows], "fp long"), tau)).collect()}
    assert {r: got.get(r, r) for r in rows} == want


def test_pigeonhole_splits_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "SIZING", 1)
    rows = sorted({1 << a | 1 << b for a in range(16) for b in range(16)})
    got = components(simhash.links(spark.createDataFrame([(r,) for r in rows], "fp long"), 3)).collect()
    assert {r["root"] for r in got} == {rows[0]} and len(got) == len(rows) - 1


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_near_duplicates_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[7] == 7


def test_near_duplicates_of_changed_words(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    near = [w if i % 90 else "changed" for i, w in enumerate(base)]
    other = [f"v{x}" for x in rng.integers(0, 5000, 400)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_component_ids_reach_over_links(spark):
    """Chains of fingerprints at distance 3 or less, the smallest id anywhere in the chain."""
    rng = np.random.default_rng(8)
    texts = []
    for g in range(12):
        words = [f"g{g}w{x}" for x in rng.integers(0, 500, 300)]
        for _ in range(6):
            texts.append(" ".join(words))
            words[int(rng.integers(0, 300))] = "other"
    ids = rng.permutation(len(texts)).tolist()
    fp = {i: fingerprint(t, 3) for i, t in zip(ids, texts)}
    want = groups(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert len(set(want.values())) < len({f for f in fp.values()})
    got = simhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), shingle=3, tau=3, wide=None).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_op2_round_trip(spark, data, docs, odd):
    t = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    for got, source in ((queries.op2_bpe(spark, data), docs), (bpe.digests(odd, queries.tokenizer("byte_bpe_50k.json")), {i: x for i, x, *_ in ODD})):
        rows = got.collect()
        for r in rows:
            e = t.encode(source[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["n_tokens"] == len(e) and r["ids_sha256"] == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()


def test_op3_recall_and_odd_vectors(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    u = np.stack(rows["embedding"]).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    at, hit, n = {v: i for i, v in enumerate(rows["vec_id"])}, 0, 0
    for q, g in queries.op3_ann(spark, data).toPandas().groupby("query_id"):
        s = u @ u[at[q]]
        s[at[q]] = -2
        hit += len(set(g["vec_id"]) & set(rows["vec_id"].to_numpy()[np.argsort(-s)[:5]]))
        n += 5
        assert np.allclose(g.sort_values("rank")["score"], s[[at[v] for v in g.sort_values("rank")["vec_id"]]])
    assert hit / n >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 0.0]), (9, [1e200, 1e200]), (10, [3e-320, 0.0])], "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1))
    got = ann.search(few, few.where("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 10, 6, 9] and got[1]["score"] == 1.0 and got[2]["score"] == got[3]["score"]
    assert ann.search(few.where("vec_id < 0"), few).count() == 0 and ann.search(few, few.where("vec_id < 0")).count() == 0


def test_op3_ties_and_repeated_ids(spark):
    """Many copies of few vectors, one id many times: five different ids, the smallest of equal ones."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((4, 8))
    rows = [(i, base[i % 4].tolist()) for i in range(600)] + [(7, base[3].tolist())] * 80 + [(600, base[0].tolist()), (600, (-base[0]).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id in (0, 3, 7, 600)").distinct()).orderBy("query_id", "rank").collect()
    found = {q: [r["vec_id"] for r in got if r["query_id"] == q] for q in (0, 3, 7, 600)}
    assert found == {0: [4, 8, 12, 16, 20], 3: [7, 11, 15, 19, 23], 7: [3, 11, 15, 19, 23], 600: [0, 4, 8, 12, 16]}


def test_op3_visits_few_leaves_of_clustered_vectors(spark):
    """50,000 vectors in 500 clusters: recall against brute force with a few hundredths of the rows compared."""
    rng = np.random.default_rng(1)
    u = rng.standard_normal((500, 64))[rng.integers(0, 500, 50_000)] + 0.35 * rng.standard_normal((50_000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    forest = ann.Forest(u[::3], len(u))
    most = forest.budget(u[::3], 5, ann.RECALL)
    assert forest.depth == 8 and most * len(u) / (1 << forest.depth) <= 0.06 * len(u)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(u)), "embedding": list(u)})).select(F.col("vec_id").cast("long"), "embedding")
    got = ann.search(df, df.where("vec_id % 250 = 0")).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -2
        hit += len(set(g["vec_id"]) & set(np.argsort(-s)[:5].tolist()))
    assert hit / 1000 >= 0.9 and len(got) == 1000


def test_op4_held_out_accuracy(spark, data, odd):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).join(docs, "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() >= 0.9
    rows = {r["doc_id"]: r for r in langid.identify(odd, langid.fit(docs)).collect()}
    assert rows[3]["lang_pred"] == rows[4]["lang_pred"] == rows[5]["lang_pred"] == "und" and rows[7]["lang_pred"] != "und"
    assert langid.identify(odd, langid.fit(docs.where("false"))).where("lang_pred <> 'und'").count() == 0


def test_op4_scores_by_brute_force(spark):
    """Known words by log frequency, unseen ones by their longest known n-grams, in slices of long runs."""
    counts = [("de", "haus", 30), ("de", "baum", 20), ("de", "der", 90), ("en", "house", 25), ("en", "tree", 22), ("en", "the", 95), ("en", "der", 1), ("fr", "maison", 9), ("fr", "arbre", 8)]
    m = langid.Model(counts)
    langs = ["de", "en", "fr"]

    def table(k):
        t = collections.defaultdict(lambda: collections.Counter())
        for lang, w, c in counts:
            source = w if k <= 1 else f"<{w}>"
            for g in [w] if k == 0 else [source[i : i + k] for i in range(len(source) - k + 1)]:
                t[g][lang] += c
        total = {x: sum(v[x] for v in t.values()) for x in langs}
        return {g: [math.log((v[x] + 0.5) / (total[x] + 1)) for x in langs] for g, v in t.items() if k == 0 or sum(v.values()) >= 3}

    tables = [table(k) for k in range(6)]

    def plain(text):
        s = np.zeros(3)
        for w in text.split():
            if w in tables[0]:
                s += tables[0][w]
                continue
            for at in range(0, len(w), 32):
                for k in range(5, 0, -1):
                    source = w if k == 1 else f"<{w}>"
                    last = len(source) - k + 1
                    known = [tables[k][source[i : i + k]] for i in range(at, min(last, at + 32) if at + 32 < len(w) else last) if source[i : i + k] in tables[k]]
                    if known:
                        part = min(32, len(w) - at)
                        s += 0.5 * max(part / 10, part / len(w)) * np.mean(known, axis=0)
                        break
        p = np.exp(s - s.max())
        return langs[int(np.argmax(s))], p.max() / p.sum()

    score = langid.Scorer(m)
    for text in ("der baum", "the tree house", "hausbaum", "arbres maisons", "treehouses", "x", "haus" * 40 + "house" * 10, "maison" * 9 + " the"):
        lang, p = plain(text)
        got = score(text)
        assert got[0] == lang and math.isclose(got[1], p, rel_tol=1e-4)


def test_op6_scores_by_brute_force(spark, data, docs):
    """Sizes by a fresh compressor for each block, features and the logistic function written out."""
    import zstandard

    model = quality.fit(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries.op6_quality(spark, data).collect()}

    def size(text, d):
        more = {"dict_data": zstandard.ZstdCompressionDict(d)} if d else {}
        return sum(len(zstandard.ZstdCompressor(level=1, write_content_size=False, write_dict_id=False, **more).compress(text[i : i + 4096])) for i in range(0, len(text), 4096))

    for i, t in list(docs.items())[::4]:
        raw = (t or "").encode()
        g, b = (size(raw, d) for d in model.dicts)
        d, ratio, n = (b - g) / (b + g + 100), (g + b + 100) / (2 * len(raw) + 200), math.log1p(len(raw))
        x = [d, d * n, (b - g) / math.sqrt(b + g + 100), ratio, math.log(ratio), ratio * n, n] if raw else [0.0] * 7
        c = model.calibrated
        z = c.w[0] + sum((v - m) / s * w for v, m, s, w in zip(x, c.mean, c.std, c.w[1:]))
        assert math.isclose(got[i], 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)


def test_op5_and_op9_against_sql(spark, data):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, data).toPandas(), con.sql(sql).df()
        cols = sorted(want.columns)
        assert sorted(map(str, got[cols].to_numpy().tolist())) == sorted(map(str, want[cols].to_numpy().tolist()))


def test_line_dedup_edges(spark, odd):
    rows = [(i, f"header\nbody {i}\n\nfooter ", "h", None) for i in range(8)] + [(20, "header", "h", None), (21, None, "h", None), (22, "header\nx", None, None), (23, "header\nbody 1\n\nfooter ", "h", None)]
    got = {r["doc_id"]: r for r in linededup.clean(spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")).collect()}
    assert got[3]["text"] == "body 3\n" and got[3]["n_dropped"] == 2
    assert got[20]["text"] == "header" and got[21]["text"] is None and got[22]["text"] == "header\nx"
    assert linededup.clean(odd).count() == len(ODD) and linededup.clean(odd.where("false")).count() == 0


def test_op6_op8_held_out(spark, data, odd):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    for module in (quality, toxicity):
        model = module.fit(docs, labels)
        got = module.score(odd, model).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
        module.fit(docs, labels.where("false"))
    big, some = "/root/testdata/sf0.01", []
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        g = module.score(docs, module.fit(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
        some.append((g["predicted"] == g[label]).mean())
    assert min(some) >= 0.9


def test_block_max_search_is_exact(monkeypatch):
    """Lists kept as matrix rows and lists in blocks, examples left out, queries of other terms."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random((700, 60)) < np.r_[[0.4] * 6, [0.03] * 54], rng.random((700, 60)), 0)
    example, term = np.nonzero(x)
    for heavy in (12, 1, 10**6):
        monkeypatch.setattr(toxicity, "HEAVY", heavy)
        index = toxicity.BlockMaxIndex(example, term, x[example, term], 700, 60)
        queries = [(np.flatnonzero(v), v[v > 0]) for v in x[:90]]
        for i, (ids, sims) in enumerate(index.search(queries, 7, list(range(90)))):
            s = x @ x[i]
            s[i] = 0
            assert np.allclose(sims, np.sort(s)[::-1][: len(sims)]) and np.allclose(s[ids], sims) and len(sims) == min(7, (s > 0).sum())


def test_op8_neighbours_by_brute_force(spark, data, docs):
    """Evidence of whole texts against cosines computed plainly over the full vocabulary."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{data}/documents.parquet"), labels)
    got = {r["doc_id"]: r for r in queries.op8_toxicity(spark, data).collect()}
    cut = lambda t: toxicity.WORD.findall((t or "").lower())
    known = {i: cut(docs[i]) for i in model.example_ids.tolist()}
    df = collections.Counter(w for words in known.values() for w in set(words))
    toxic = {i for i, y in zip(model.example_ids.tolist(), model.y) if y}
    n, share, weight = len(known), len(toxic) / len(known), {}
    for w, c in df.items():
        if c >= 3:
            a = sum(w in set(known[i]) for i in toxic)
            chi2 = (a - c * share) ** 2 / (c * share * (1 - share) * max(1 - c / n, 1 / n))
            weight[w] = (math.log((n + 1) / (c + 1)) + 1) * (1 + chi2 / 10.83)

    def unit(words):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in collections.Counter(words).items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = {i: unit(words) for i, words in known.items()}
    assert set(weight) == set(model.index)
    with_some = 0
    for i, t in docs.items():
        v = unit(cut(t))
        want = sorted((sum(x * e.get(w, 0.0) for w, x in v.items()) for e in examples.values()), reverse=True)[: toxicity.NEIGHBOURS]
        found = [e["cosine"] for e in got[i]["evidence"]]
        with_some += len(found) > 0
        assert np.allclose(found, [x for x in want if x > 0]) and {e["doc_id"] for e in got[i]["evidence"]} <= set(examples)
    assert with_some >= 0.9 * sum(bool(cut(t)) for t in docs.values())


def test_op7_pieces(spark, data, docs, odd):
    path = queries.tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for frame, source in ((spark.read.parquet(f"{data}/documents.parquet"), docs), (odd.dropDuplicates(["doc_id"]), {i: x for i, x, *_ in ODD})):
        got = packing.pack(frame, path).toPandas()
        for _, g in got.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096
        whole = collections.defaultdict(list)
        for r in got.sort_values("start").itertuples():
            whole[None if np.isnan(r.doc_id) else int(r.doc_id)].append(r)
        assert set(whole) == set(source)
        for i, own in whole.items():
            ids, at = [*t.encode(source[i] or "", add_special_tokens=False).ids, 2], 0
            for r in own:
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
    assert packing.pack(odd.where("false"), path).count() == 0


def test_op9_visitors_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "CELL", 10)
    monkeypatch.setattr(embdedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 6))
    x = np.concatenate([x, x[:40] + 0.08 * rng.standard_normal((40, 6)), np.repeat(x[:1], 40, axis=0)])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    pairs = [(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if u[i] @ u[j] >= 0.98]
    want, links = groups(range(len(u)), pairs), collections.Counter(k for p in pairs for k in p)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, x[0].tolist(), None), (901, None, 1), (902, [0.0] * 6, 1)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embdedup.near_duplicates(df).collect()}
    assert len(got) == len(x) + 3 and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902))
    assert {i: got[i]["component_id"] for i in want} == want and all(got[i]["n_links"] == links[i] for i in want)


def test_op9_repeated_ids_and_odd_vectors(spark):
    x = [1.0, 0.0]
    rows = [(1, x, 1), (1, x, 1), (2, [2.0, 0.0], 1), (3, [1e200, 0.0], 1), (4, [1.0], 1), (5, x, 2), (6, [0.0, 1.0], 1), (6, [0.01, 1.0], 1), (6, x, 3), (7, x, 3), (8, [1e-3, 1.0], 1), (None, x, 1), (9, [float("inf"), 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(0)).withColumn("unit", F.lit(0))
    got = collections.defaultdict(set)
    for r in embdedup.near_duplicates(df).collect():
        got[r["vec_id"]].add((r["n_links"], r["component_id"], r["kept"]))
    assert all(len(v) == 1 for v in got.values())
    assert {i: next(iter(v))[:2] for i, v in got.items()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (3, 6), 7: (1, 6), 8: (2, 6), None: (0, None), 9: (0, 9)}
    assert embdedup.near_duplicates(df.where("false")).count() == 0


def test_op10_base_and_likelihood(spark, data, docs, odd):
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = collections.Counter(w for i, t in docs.items() if zlib.crc32(str(i).encode()) % 10 for w in words(t))
    n, v = sum(c.values()), len(c)
    got = queries.op10_lm_scoring(spark, data).toPandas().set_index("doc_id")
    for i, t in docs.items():
        base = sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
        r = got.loc[i]
        assert r["n_tokens"] == len(words(t)) and r["n_known"] == sum(w in c for w in words(t)) and r["train_tokens"] == n
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-6)
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()
    assert brown.score(odd).count() == len(ODD) and brown.score(odd.where("false")).count() == 0


def test_op10_null_ids_are_not_learned_from(spark):
    rows = [(i, f"a b c w{i % 7}") for i in range(60)]
    more = rows + [(None, "a b only once")] * 3 + [(None, None)]
    plain, got = (brown.score(spark.createDataFrame(r, "doc_id long, text string")).toPandas() for r in (rows, more))
    nulls = got[got["doc_id"].isna()].sort_values("n_tokens")
    own = got[got["doc_id"].notna()].sort_values("doc_id").reset_index(drop=True)
    plain = plain.sort_values("doc_id").reset_index(drop=True)
    assert (own[["held_out", "n_tokens", "n_known", "train_tokens"]] == plain[["held_out", "n_tokens", "n_known", "train_tokens"]]).all(axis=None)
    assert np.allclose(own[["base_score", "score"]], plain[["base_score", "score"]], rtol=1e-12)
    n = sum(5 for i, _ in rows if zlib.crc32(str(i).encode()) % 10)
    assert set(got["train_tokens"]) == {n} and not nulls["held_out"].any()
    assert list(zip(nulls["n_tokens"], nulls["n_known"])) == [(1, 1)] + [(5, 3)] * 3


def test_exchange_never_loses_likelihood():
    rng = np.random.default_rng(3)
    n = rng.poisson(1.0, (20, 20)).astype(float)
    n[:8, 8:16] += 6

    def gain(cls):
        c = np.zeros((cls.max() + 1,) * 2)
        np.add.at(c, (np.repeat(cls, 20), np.tile(cls, 20)), n.ravel())
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(c) - f(c.sum(0)) - f(c.sum(1))

    assert gain(brown.exchange(n, 18, 4)) >= gain(brown.exchange(n, 18, 4, 0)) - 1e-9


def test_op10_score_by_brute_force(spark, data, docs, monkeypatch):
    """Classes of all head words, transitions, emissions and the tail, counted plainly; each word that isn't
    exchanged is in the class of the best gain."""
    monkeypatch.setattr(brown, "HEAD", 800)
    monkeypatch.setattr(brown, "EXCHANGED", 6)
    frame = spark.read.parquet(f"{data}/documents.parquet")
    m, _, _ = brown.fit(frame)
    words = {i: (t or "").encode().lower().split() for i, t in docs.items()}
    train = [w for i, w in words.items() if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(x for w in train for x in w)
    at, k = {w: i for i, w in enumerate(m.head)}, m.end - 1
    assert len(m.cls) == len(m.head) + 1 and 100 < len(m.head) <= 800 and all(0 <= c < k for c in m.cls[:-1])
    assert all(count[w] >= count[v] for w, v in zip(m.head, m.head[1:])) and k == max(1, round(len(m.head) ** 0.4))
    codes = lambda w: [m.end, *(m.cls[at[x]] if x in at else k for x in w), m.end]
    c = np.zeros((k + 2, k + 2))
    for w in train:
        own = codes(w)
        for x, y in zip(own, own[1:]):
            c[x, y] += 1
    prior = (c.sum(axis=0) + 1) / (c.sum() + k + 2)
    step = np.log10((c + brown.ALPHA * prior) / (c.sum(axis=1, keepdims=True) + brown.ALPHA))
    in_class = collections.Counter()
    for w, i in at.items():
        in_class[m.cls[i]] += count[w]
    tail = {w: n for w, n in count.items() if w not in at}
    def emitted(x):
        if x in at:
            return count[x] / in_class[m.cls[at[x]]]
        return (tail[x] - brown.DISCOUNT if x in tail else brown.DISCOUNT * len(tail) + 1) / (sum(tail.values()) + 1)

    got = {r["doc_id"]: r["score"] for r in brown.score(frame).collect()}
    for i, w in words.items():
        own = codes(w)
        want = sum(step[x, y] for x, y in zip(own, own[1:])) + sum(math.log10(emitted(x)) for x in w)
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-6)


def test_gain_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    k, size = 5, 8
    c = rng.poisson(3.0, (size, size)).astype(float)
    right, left, own = (rng.poisson(0.7, size).astype(float) for _ in range(3))
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    whole = lambda x: f(x) - f(x.sum(0)) - f(x.sum(1))
    got = brown._gain(c, brown._f(c), k, right, left, own[0], c.sum(1)[:k], c.sum(0)[:k])

    def joined(b):
        x = c.copy()
        x[b] += right
        x[:, b] += left
        x[b, b] += own[0]
        return whole(x)

    assert np.allclose(got - got[0], [joined(b) - joined(0) for b in range(k)])


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.count() <= before
        assert stage(spark, docs.where("false"), data).count() == 0, name
    assert corpus_pipeline.run(spark, data).select("doc_id").distinct().count() > 0.3 * before


def test_pipeline_stages_on_odd_rows(spark, data, odd):
    """Nulls, empties, repeats, a long text and clashing names: rows stay rows, and repeated ones are treated alike."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, data)
        rows = out.collect()
        if name == "packing":
            assert sorted({r["doc_id"] for r in rows}, key=str) == sorted({r[0] for r in ODD}, key=str)
            continue
        assert out.columns == odd.columns and len(rows) <= len(ODD), name
        kept = collections.Counter(r["doc_id"] for r in rows)
        assert kept[2] in (0, 2) or name == "simhash" and kept[2] == 0
        if name == "simhash":
            assert kept == {1: 1, 3: 1, 6: 1, 7: 1, None: 1}
    chars = {r["doc_id"]: r for r in corpus_pipeline.stage_line_dedup(spark, spark.createDataFrame([(i, f"header\nbody {i}", "en", "h", 99) for i in range(9)], SCHEMA), data).collect()}
    assert chars[4]["text"] == "body 4" and chars[4]["n_chars"] == 6


def test_empty_tables(spark, data, odd):
    none = odd.where("false")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert bpe.digests(none, queries.tokenizer("byte_bpe_50k.json")).count() == 0 and simhash.near_duplicates(none).count() == 0
    assert langid.identify(none, langid.fit(none)).count() == 0
    for module in (quality, toxicity):
        assert module.score(none, module.fit(none, labels)).count() == 0 and module.keep(none, module.fit(none, labels)).count() == 0
