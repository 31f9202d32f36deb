import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleettrack.llm import ngram_join
from fleettrack.llm.common import made_since, mark
from fleettrack.llm.components import components
from fleettrack.llm.metric_join import range_join
from fleettrack.llm.shingles import shingle_sets


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    u = Union()
    for a, b in edges:
        u.link(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == {x: u.find(x) for e in edges if e[0] != e[1] for x in e}


def plain_sets(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def plain_components(rows):
    """doc_id -> (set size, component); every pair that shares a shingle is looked at."""
    sets = {d: plain_sets(t) for d, t in rows if d is not None}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    shared, u = Counter(), Union()
    for ds in holders.values():
        shared.update((a, b) for k, b in enumerate(ds) for a in ds[:k])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            u.link(a, b)
    return {d: (len(s), u.find(d)) for d, s in sets.items()}


def near_copies(seed, families=8):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(families):
        base = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        for k in range(rnd.choice([1, 2, 5, 40])):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(text) // 25))):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append(" ".join(text).upper() if k % 5 == 0 else " ".join(text))
    rows += [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 7))) for _ in range(30)]
    rows += [None, "", "one two", "One\ttwo", "a b c d e", "a b c d e f", "é À b c d", "É à b c d"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("family", [512, 12])
def test_jaccard_components(spark, monkeypatch, family):
    monkeypatch.setattr(ngram_join, "FAMILY", family)
    rows = near_copies(family)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows) and len(got) == len(rows)


def test_words_that_share_a_polynomial_hash_are_told_apart(spark):
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    a, b, c = shingle_sets([one, two, one.upper()])
    assert a.tolist() != b.tolist() and a.tolist() == c.tolist()
    rows = [(1, one), (2, two), (3, one), (4, f"{one} b c d e"), (5, f"{two} b c d e"), (6, "x" * 100_000 + "y"), (7, "x" * 100_000 + "z")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows)


def test_shared_sets_notice_another_order(spark):
    """The texts are read twice; if the second reading has another order, that is an error and no wrong link."""
    df = spark.createDataFrame([(k, f"some words of text {k} {k % 3}") for k in range(400)], "doc_id long, text string").coalesce(1)

    def other_words(parts):
        for pdf in parts:
            yield pdf.assign(text=[f"{t} {random.SystemRandom().random()}" for t in pdf["text"]])

    shuffled = df.mapInPandas(other_words, df.schema)
    with pytest.raises(Exception, match="another order"):
        ngram_join.shared_sets(shuffled, 5, 80).count()


def test_jaccard_odd_rows(odd, odd_rows):
    got = ngram_join.jaccard_components(odd).collect()
    assert len(got) == len(odd_rows)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert ngram_join.jaccard_components(odd.limit(0)).count() == 0


def test_jaccard_of_empty_partitions_and_texts_without_words(spark, tmp_path):
    """Pieces of a file that no row group begins in have no rows; a partition's texts may have no words; a block may be full at its last row."""
    rows = near_copies(2)
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "one"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        docs = spark.read.parquet(str(tmp_path / "one"))
        held = docs.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
        assert 0 in held and sum(held) == len(rows)
        got = ngram_join.jaccard_components(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows) and len(got) == len(rows)
    for none in ([(1, ""), (2, None), (3, " \n")], [(4, None)]):
        got = ngram_join.jaccard_components(spark.createDataFrame(none, "doc_id long, text string").coalesce(1)).collect()
        assert sorted(map(tuple, got)) == [(d, 0, d) for d, _ in none]
    full = spark.createDataFrame([(5, "a b c d e f"), (6, "A b c d e f")], "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, ngram_join.shared_sets(full, 5, 80, most=1).select("doc_id", "n").collect())) == [(5, 2), (6, 2)]


def test_packed_numbers_shrink_and_come_back():
    rng = np.random.default_rng(1)
    rising = np.sort(rng.integers(0, 1 << 47, 3000, np.uint64))
    runs = np.concatenate([np.sort(rng.choice(1_500_000, 400, replace=False)) for _ in range(200)]).astype(np.uint64)
    for numbers, width, most in ((rising, 6, 5.2), (runs, 4, 2.2), (np.array([2**32 - 1, 0, 5, 5, 2**32 - 1], np.uint64), 4, None), (rising[:1], 6, None), (rising[:0], 6, None)):
        raw = ngram_join._packed(numbers, width)
        assert ngram_join._unpacked(raw, width).tolist() == numbers.tolist() and len(raw) == width * len(numbers)
        if most:
            assert len(pa.compress(raw, codec="lz4", asbytes=True)) < most * len(numbers)


def test_jaccard_leaves_no_tokens_in_the_shared_folder(spark):
    number = mark()
    got = ngram_join.jaccard_components(spark.createDataFrame(near_copies(5), "doc_id long, text string"))
    left = [p for p in made_since(number) if "tokens" in spark.read.parquet(p).columns]
    assert not left and got.count() == len(near_copies(5))


def test_trie_finds_what_pairs_find():
    rnd = random.Random(6)
    for _ in range(30):
        sets = [sorted(rnd.sample(range(40), rnd.randint(1, 30))) for _ in range(25)]
        sets += [sorted({*s} ^ {rnd.randrange(40)}) for s in sets if rnd.random() < 0.6]
        sets = [s for s in sets if s]
        trie = ngram_join.Trie(sets, [len(s) for s in sets])
        for me, s in enumerate(trie.sets):
            found = set(trie.links(s, len(s), np.arange(len(sets)), me, 80))
            assert found == {k for k, t in enumerate(trie.sets) if k != me and 100 * len({*s} & {*t}) >= 80 * len({*s} | {*t})}


def test_shingle_hashes_tell_sets_apart():
    texts = [t for _, t in near_copies(3)]
    got = shingle_sets([t or "" for t in texts])
    assert [len(g) for g in got] == [len(plain_sets(t)) for t in texts]
    a, b = texts.index("one two"), texts.index("One\ttwo")
    assert got[a].tolist() == got[b].tolist()


def test_metric_join(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base + rng.normal(scale=s, size=base.shape) for s in (0, 0, 0.05, 0.1, 0.2)]).astype(np.float32)
    label = [None if k % 17 == 0 else k % 2 for k in range(len(x))]
    rows = [(k, v.tolist(), c) for k, (v, c) in enumerate(zip(x, label, strict=True))]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, [None] + [1.0] * 7, 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x64 = x.astype(float)
    cos = x64 @ x64.T / np.linalg.norm(x64, axis=1)[:, None] / np.linalg.norm(x64, axis=1)[None]
    u, n = Union(), Counter()
    for a in range(len(x)):
        for b in range(len(x)):
            if a != b and label[a] is not None and label[a] == label[b] and cos[a, b] >= 0.98:
                n[a] += 1
                u.link(a, b)
    n[905], n[906] = 1, 1
    u.link(905, 906)
    for per_cell in (4, 512):
        got = range_join(df, per_cell=per_cell).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {r[0]: (n[r[0]], u.find(r[0]), u.find(r[0]) == r[0]) for r in rows}
    assert range_join(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op3_line_dedup", "op8_ngram_jaccard", "op9_metric_join"])
def test_against_sql(spark, name):
    import glob
    import os

    import duckdb

    from fleettrack.llm.entries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = QUERIES[name](spark, sf)
    want = c.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
