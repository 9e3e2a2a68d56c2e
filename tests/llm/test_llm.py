"""Operators for training data against brute force, exact round trips and held-out labels."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("segscan.llm.queries")

from segscan.llm import containers, leaks, levels, queries, runs  # noqa: E402
from segscan.llm.words import words  # noqa: E402


def _cost(v, w):
    return (w[:, None] * (v - np.average(v, axis=0, weights=w)) ** 2).sum()


@pytest.mark.parametrize("penalty", [0.2, 1.5, 4.0])
def test_segmentation_is_optimal(penalty):
    rng = np.random.default_rng(1)
    for _ in range(15):
        block = np.repeat(np.arange(5), rng.integers(1, 12, 5))
        v, w = rng.integers(0, 4, (len(block), 2)).astype(float), rng.integers(1, 4, len(block)).astype(float)
        starts = runs.segment(v, w, block, penalty)
        for b in range(5):
            vv, ww, cuts = v[block == b], w[block == b], np.flatnonzero(starts[block == b]).tolist()
            best = [-penalty]
            for j in range(1, len(vv) + 1):
                best.append(min(best[i] + penalty + _cost(vv[i:j], ww[i:j]) for i in range(j)))
            got = sum(penalty + _cost(vv[i:j], ww[i:j]) for i, j in zip(cuts, [*cuts[1:], len(vv)])) - penalty
            assert cuts[0] == 0 and abs(got - best[-1]) < 1e-6


def _events(spark):
    rows = [("f", 1.0 * i, i + 0.5, t, l) for i, (t, l) in enumerate([(2, 1), (2, 1), (3, 1), (3, 1), (3, 1), (None, 1), (3, 1), (float("nan"), 1), (2, 1)])]
    rows += [("f", 0.0, 0.5, 2, 1), (None, 1.0, 2.0, 2, 1), ("f", None, 2.0, 2, 1), ("g", 5.0, 6.0, 1, 1)]
    return spark.createDataFrame([(a, b, c, None if d is None else float(d), float(e), "x") for a, b, c, d, e in rows], "id string, s double, e double, t double, l double, run_start string")


@pytest.mark.parametrize("hot", [0, 3, 200_000])
def test_runs_with_nulls_and_repeats(spark, hot):
    got = runs.collapse_runs(_events(spark), ["id"], "s", "e", ["t", "l"], 0.2, hot_events=hot).orderBy("id", "run_start").collect()
    assert [(r.id, r.run_start, r.run_end, r.n_events, r.missing) for r in got] == [
        ("f", 0.0, 1.5, 2, False), ("f", 2.0, 4.5, 3, False), ("f", 5.0, 5.5, 1, True), ("f", 6.0, 6.5, 1, False), ("f", 7.0, 7.5, 1, True), ("f", 8.0, 8.5, 1, False), ("g", 5.0, 6.0, 1, False),
    ]


def test_runs_of_nothing(spark):
    assert runs.collapse_runs(_events(spark).limit(0), ["id"], "s", "e", ["t", "l"], 0.2).count() == 0


def test_a_long_run_stays_whole(spark):
    rows = spark.range(150_000).selectExpr("'a' AS id", "double(id) AS s", "id + 0.5D AS e", "2.0D AS t", "1.0D AS l")
    got = runs.collapse_runs(rows, ["id"], "s", "e", ["t", "l"], 0.2).collect()
    assert [(r.run_start, r.run_end, r.n_events, r.mean_t) for r in got] == [(0.0, 149_999.5, 150_000, 2.0)]


def test_a_long_run_of_a_hot_entity_stays_whole(spark):
    rows = spark.range(300_000).selectExpr("'a' AS id", "double(id) AS s", "id + 0.5D AS e", "2.0D AS t", "1.0D AS l")
    for hot in (1000, 10_000_000):
        got = runs.collapse_runs(rows.repartition(4), ["id"], "s", "e", ["t", "l"], 0.2, hot_events=hot).collect()
        assert [(r.run_start, r.run_end, r.n_events, r.mean_t) for r in got] == [(0.0, 299_999.5, 300_000, 2.0)]


@pytest.mark.parametrize("penalty", [0.2, 1.5, 4.0])
def test_ranges_change_nothing(spark, penalty):
    """Entities that are cut into ranges against the same ones whole: with many certain boundaries, few and none."""
    rng = np.random.default_rng(21)
    rows = []
    for name, stay, step in (("a", 0.9, 1), ("b", 0.6, 1), ("c", 0.9, 4), ("d", 0.995, 1)):
        v = np.cumsum(rng.integers(-step, step + 1, (30_000, 2)) * (rng.random((30_000, 1)) > stay), axis=0).clip(0, 6).astype(float)
        v[rng.random(30_000) < (0.0005 if name != "b" else 0)] = np.nan
        rows.append(np.column_stack((np.full(30_000, ord(name)), np.arange(30_000), v)))
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(np.vstack(rows), columns=["k", "s", "t", "l"])).selectExpr("char(int(k)) AS id", "s", "s + 0.5D AS e", "t", "l").repartition(6)
    df = df.unionByName(df.filter("s % 1000 = 0"))  # delivered twice
    key = lambda got: sorted((r.id, r.run_start, r.run_end, r.n_events, r.missing) for r in got)
    whole, cut = (key(runs.collapse_runs(df, ["id"], "s", "e", ["t", "l"], penalty, hot_events=hot, most_tokens=200).collect()) for hot in (10_000_000, 1000))
    assert cut == whole and len(cut) > 400


def test_a_late_second_delivery_is_no_boundary(spark):
    rows = spark.range(5000).selectExpr("'a' AS id", "double(id) AS s", "id + 0.5D AS e", "2.0D AS t", "1.0D AS l", "0 AS n")
    again = rows.filter("s = 4998").selectExpr("id", "s", "e", "9.0D AS t", "l", "1 AS n")
    got = runs.collapse_runs(rows.union(again), ["id"], "s", "e", ["t", "l"], 0.2, ["n"]).collect()
    assert [(r.run_start, r.run_end, r.n_events) for r in got] == [(0.0, 4999.5, 5000)]


@pytest.mark.parametrize("penalty", [0.2, 1.5, 4.0])
def test_no_cut_but_the_optimal_ones(spark, penalty):
    rng = np.random.default_rng(8)
    v = np.cumsum(rng.integers(-1, 2, (600, 2)) * (rng.random((600, 1)) < 0.4), axis=0).astype(float)
    df = spark.createDataFrame([("a", float(i), i + 0.5, *map(float, x)) for i, x in enumerate(v)], "id string, s double, e double, t double, l double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(r.run_start for r in runs.collapse_runs(df, ["id"], "s", "e", ["t", "l"], penalty, most_tokens=1).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    token = np.concatenate(([True], (v[1:] != v[:-1]).any(axis=1)))
    first = np.flatnonzero(token)
    weight = np.diff(np.concatenate((first, [len(v)]))).astype(float)
    assert got == first[runs.segment(v[first], weight, np.zeros(len(first), int), penalty)].tolist()


def test_containers_lose_and_split_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 5000)], "doc_id long, text string"))
    got = containers.fill_containers(docs, capacity=512, block_containers=20).toPandas()
    fill = got.groupby("container_id").n_tokens.sum()
    assert fill.max() <= 512
    assert fill.sum() / 512 / len(fill) > 0.9
    enc = containers.encoding(containers.VOCABULARY)
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in docs.collect() if r.text}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == want
    pieces = got.groupby("doc_id").piece.count()
    assert all(pieces[d] == -(-n // 512) for d, n in want.items())
    assert containers.fill_containers(docs.limit(0)).count() == 0


def test_local_search_saves_containers():
    rng = random.Random(3)
    sizes = np.array([rng.randint(200, 900) for _ in range(300)])
    start = np.array(containers.first_filling(sizes.tolist(), 2048))
    after = containers.improve(sizes, start, 2048)
    assert np.bincount(after, weights=sizes).max() <= 2048
    assert math.ceil(sizes.sum() / 2048) <= after.max() + 1 < start.max() + 1


def test_words():
    assert words("<b>Élan</b>&nbsp;vi­tal\n(p. 2)\n> l’Arbre, no. 12") == ["elan", "vital", "l", "arbre", "no", "12"]
    assert words(None) == words("") == []


def test_tiles_do_not_overlap():
    p, t = np.array([1, 2, 3, 4, 5, 6, 1]), np.array([4, 5, 6, 0, 1, 2, 3, 1, 1])
    got = leaks.tile(p, t)
    assert sorted(x[2] for x in got) == [1, 3, 3]


def test_long_tags_are_no_words(spark):
    words_of = [f"word{i}" for i in range(30)]
    tag = '<a href="' + "x" * 900 + ' y" title=z>'
    assert words(f" {tag} ".join(words_of)) == words_of
    assert words("a <b and " + "c " * 300 + "> d")[:3] == ["a", "b", "and"]  # no tag: too long for one without an attribute
    assert words("<a =" * 50_000) == ["a"] * 50_000
    items = spark.createDataFrame([(1, " ".join(words_of))], "item_id long, passage string")
    docs = spark.createDataFrame([(7, f" {tag} ".join(words_of))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.found_by) for r in leaks.find_leaks(docs, items).collect()] == [(7, 1, "run")]
    from segscan.llm.words import letter_words

    assert docs.select(F.size(letter_words(F.col("text")))).first()[0] == 30


def test_tiles_decide(spark):
    p = [f"w{i}" for i in range(40)]
    rng = random.Random(6)
    thirds = [w for k in range(0, 40, 5) for w in (*p[k : k + 4], f"x{k}")]  # four of five words, in order
    moved = [w for k in (30, 20, 10, 0) for w in p[k : k + 10]]  # parts in another order
    scattered = rng.sample(p, 40)  # all words, in no order
    comb = [w for x in p[:29] for w in (x, "y")]  # 29 of 40 words in order, but each by itself: no tile
    docs = [(1, p), (2, thirds), (3, moved), (4, scattered), (5, comb), (6, p[:27])]
    got = leaks.find_leaks(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(0, " ".join(p))], "item_id long, passage string"))
    assert {(r.doc_id, r.found_by, r.tile_share) for r in got.collect()} == {(1, "run", 1.0), (2, "tiles", 0.8), (3, "moved", 1.0), (5, "words", 0.0), (6, "run", 0.675)}


def test_many_items_are_one_pass(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "eval_items"))
    many = items.crossJoin(spark.range(6)).selectExpr("item_id * 10 + id AS item_id", "passage")  # beyond 1,000
    one, blocks = leaks.find_leaks(docs, many), leaks.find_leaks(docs, many, block_chars=100_000)
    rows = [sorted((r.doc_id, r.item_id, r.found_by) for r in x.collect()) for x in (one, blocks)]
    assert rows[0] == rows[1] and len(rows[0]) > 0
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas")
    assert (count(one), count(blocks) > 1) == (1, True)


def test_pieces_and_parts_change_nothing(spark, small, monkeypatch):
    import pandas as pd

    docs, items = (pd.read_parquet(f"{small}/{t}.parquet") for t in ("documents", "eval_items"))
    ids, passages = items.item_id.tolist(), items.passage.tolist()
    # Long texts, in which the passages stand anywhere, also across the ends of pieces.
    texts = [" ".join(filter(None, docs.text.sample(60, random_state=i).tolist() + random.Random(i).sample(passages, 5))) for i in range(6)] + [None, ""]
    whole = sorted(leaks.Items(ids, passages).search(texts))
    assert len(whole) >= 30
    monkeypatch.setattr(leaks, "MOST_MET", 500)
    monkeypatch.setattr(leaks, "PIECE_WORDS", 700)
    monkeypatch.setattr(leaks, "MOST_CELLS", 0)
    cut = sorted(h for i in range(0, len(ids), 50) for h in leaks.Items(ids[i : i + 50], passages[i : i + 50]).search(texts))
    is_leak = lambda hits: [h[:2] for h in hits if h[3] != "moved"]
    assert is_leak(cut) == is_leak(whole)


def test_leaks_are_those_of_brute_force(spark, small):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(20, 50)))) for i in range(12)]
    docs = []
    for d in range(150):
        w = items[d % 12][1].split()
        w = [x for x in w if rng.random() > rng.choice([0.05, 0.25, 0.4])]
        for _ in range(rng.randint(0, 15)):
            w.insert(rng.randint(0, len(w)), rng.choice(vocabulary))
        docs.append((d, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)) + w + rng.choices(vocabulary, k=5))))
    docs += [(900, None), (901, ""), (902, items[0][1].upper()), (902, items[0][1])]
    items += [(900, None), (901, "")]
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")), spark.createDataFrame(items, "item_id long, passage string").withColumn("text", F.lit("x")))
    found = {(r.doc_id, r.item_id) for r in got.filter("is_leak").collect()}

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    want = set()
    for d, t in docs:
        w = words(t)
        for i, p in items:
            q = words(p)
            if not q or not w:
                continue
            span, need = int(1.5 * len(q)), -(-7 * len(q) // 10)
            in_row = any(w[a : a + 16] == q[b : b + 16] for a in range(len(w) - 15) for b in range(len(q) - 15))
            if in_row or any(len(set(w[b : b + span]) & set(q)) and lcs(q, w[b : b + span]) >= need for b in range(max(1, len(w) - span + 1))):
                want.add((d, i))
    assert found == want and len(want) > 20


def test_levels_hold_out(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/level_labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    got = levels.reading_level(docs, labels.filter(half == 0)).filter("level IS NOT NULL")
    pairs = labels.filter(half == 1).groupBy("doc_id").agg(F.avg("level_no").alias("hand")).join(got, "doc_id").collect()
    assert len(pairs) > 150
    assert sum((r.hand >= 4) == (r.level >= 4) for r in pairs) / len(pairs) > 0.9


def test_levels_beyond_the_broadcast(spark, small, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "level_labels"))
    levels_of = lambda: {r.doc_id: (r.level, r.n_known) for r in levels.reading_level(docs, labels).collect()}
    whole = levels_of()
    monkeypatch.setattr(levels, "BROADCAST_WORDS", 0)
    assert levels_of() == whole and len(whole) == docs.count()


def test_levels_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "cat sat"), (3, "cat sat")], "doc_id long, text string").withColumn("word", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, rater string, level_no int, rated_at timestamp")
    assert {(r.doc_id, r.level) for r in levels.reading_level(docs, none).collect()} == {(1, None), (2, None), (3, None)}
    some = spark.createDataFrame([(3, "a", 1, datetime(2024, 1, 1)), (99, "a", 9, None), (None, "a", 2, None)], none.schema)
    assert levels.reading_level(docs, some).count() == 3


def test_every_query_runs(spark, small):
    for name, q in queries.QUERIES.items():
        assert q(spark, small).count() >= 0, name


def test_word_hashes_are_those_of_words():
    from segscan.llm.words import word_hashes, words

    rng = random.Random(9)
    marks = ["<b>", "</p>", "&amp;", "&lt;i&gt;", "&#233;", "&amp", "<", ">", "\n(p. 3)\n", "(p. 4)", "\x01", "\u00ad", "\u200b", "\u0301", "\ufb01", "Stra\u00dfe", "STRASSE", "\u00c9t\u00e9", "e\u0301", "\u0130", "\u03a3\u03c2", "_x_", "12", "\u00bd", "\u4e2d\u6587", "\U0001f600", " ", " ", "-", "word", "Word"]
    texts = [None, "", " ", "<", "a", *["".join(rng.choice(marks) for _ in range(rng.randint(1, 30))) for _ in range(500)], "a<b", "c>d", "(p. 1)"]
    hashes, n = word_hashes(texts)
    each = [words(t) for t in texts]
    assert n.tolist() == [len(w) for w in each]
    by_word: dict[str, int] = {}
    for w, h in zip([w for ws in each for w in ws], hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert word_hashes([])[1].tolist() == [] and word_hashes([None])[1].tolist() == [0]
