"""Cases in which an operator once did less than the whole job."""

import numpy as np
import pytest

from quillet.llm import langid, linededup, simhash
from quillet.llm._common import components


def test_line_dedup_finds_lines_on_a_few_hundredths_of_a_host(spark):
    rows = [(i, f"own line {i}\nsite footer" if i % 25 == 0 else f"own line {i}", "host") for i in range(200)]
    rows += [(200 + i, f"other {i}\nshared twice" if i < 2 else f"other {i}", "small") for i in range(20)]
    got = {r["doc_id"]: r for r in linededup.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["n_dropped"] == (i < 200 and i % 25 == 0) for i in range(220))
    assert got[25]["text"] == "own line 25" and got[200]["text"] == "other 0\nshared twice"


def test_near_duplicates_are_decided_by_exact_similarity(spark):
    rng = np.random.default_rng(3)
    rows = []
    for pair in range(24):
        words = [f"w{x}" for x in rng.integers(0, 50000, 400)]
        new = 37 if pair < 12 else 45  # similarity 0.812 and 0.780 of five-word shingles
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join([f"v{pair}x{i}" for i in range(new)] + words[new:]))]
    # A chain: 100 and 102 are apart, 101 is near both; 103 is near neither of them but shares much with 100.
    a = [f"c{x}" for x in rng.integers(0, 50000, 400)]
    b = [f"d{i}" for i in range(30)] + a[30:]
    c = b[:370] + [f"e{i}" for i in range(30)]
    rows += [(100, " ".join(a)), (101, " ".join(b)), (102, " ".join(c)), (103, " ".join(a[:200] + [f"f{i}" for i in range(46)] + a[246:]))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    want = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    want[i] = min(want[i], want[j])
    assert got == want


def test_groups_with_failing_candidates_lose_no_link(spark):
    """Clusters of texts that are near one another, but mostly not similar enough: what is similar is linked."""
    rng = np.random.default_rng(9)
    rows = []
    for cluster in range(8):
        base = [f"c{cluster}w{x}" for x in rng.integers(0, 50000, 160)]
        for member in range(14):
            words = list(base)
            at = int(rng.integers(0, 120))
            n = int(rng.integers(2, 10))
            words[at : at + n] = [f"m{member}x{cluster}y{i}" for i in range(n)]
            rows.append((cluster * 100 + member, " ".join(words)))
    rows += [(5000 + i, t) for i, (_, t) in enumerate(rows[::5])]  # copies
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    want = {i: i for i in sets}
    for _ in range(20):
        for i in sets:
            for j in sets:
                if want[i] != want[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want and 8 < len(set(want.values())) < len(rows)


def test_components_never_gives_unsettled_labels(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(e, max_rounds=1)


def test_language_of_runs_without_blanks(spark):
    rng = np.random.default_rng(1)
    letters = {"ja": "あいうえおかきくけこさしすせそ", "th": "กขคงจฉชซญดตถทนบ"}
    run = lambda lang, n: "".join(rng.choice(list(letters[lang]), n))
    rows = [(i, run(lang, 300), lang) for i in range(80) for lang in letters]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    scorer = langid.Scorer(m)
    assert m.langs == ["ja", "th"] and not m.words and m.grams[2]
    assert scorer(run("th", 250) + run("ja", 600))[0] == "ja" and scorer(run("ja", 250) + run("th", 600))[0] == "th"
    # One long run outweighs two short ones.
    assert scorer(run("ja", 300) + " " + run("th", 5) + " " + run("th", 5))[0] == "ja"


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(2)
    vocab = {f"l{i:03d}": ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(30)] for i in range(250)}
    rows = [(250 * k + i, " ".join(rng.choice(v, 40)), lang) for k in range(6) for i, (lang, v) in enumerate(vocab.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(docs, documents=700)  # under three of each
    assert len(m.langs) >= 249 and m.langs == sorted(m.langs)
    got = langid.identify(docs, m).join(docs, "doc_id").where("lang_pred = lang").count()
    assert got >= 0.97 * len(rows)
    # Tables too large to be laid out give the same.
    some = [r[1] for r in rows[:40]] + ["abcdefg unseenword"]
    laid_out = [langid.Scorer(m)(t) for t in some]
    for table in (m.words, *m.grams):
        table.rows = None
    assert [(a, round(x, 5)) for a, x in laid_out] == [(a, round(x, 5)) for a, x in map(langid.Scorer(m), some)]
    long = spark.createDataFrame([(1, "x " * 80_000, "xx"), (4, "y " * 80_000, "yy"), (5, "z z", "yy")], "doc_id long, text string, lang string")
    assert set(langid.fit(long, documents=2).langs) <= {"xx", "yy"}


def test_components_of_edges_in_many_parts(spark, monkeypatch):
    from quillet.llm import _common

    monkeypatch.setattr(_common, "EDGES", 5)
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(4)
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)]
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    want = {x: x for p in pairs for x in p}
    for _ in range(70):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {x: low for x, low in want.items() if low != x}  # roots don't appear
