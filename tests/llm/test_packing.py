import random
import re
import zlib

import numpy as np
import pytest

from fleettrack.llm import packing, pretokens
from fleettrack.llm.packing import Plan, pack_documents, weights_of
from fleettrack.llm.token_counts import token_counts


def test_pretokens_are_the_library_s(paths, tokenizer):
    rnd = random.Random(2)
    signs = [*"ab'sdtmrevlL  \n\t1٣²!?é— 　漢🙂", "<|endoftext|>"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    table = pretokens.PieceTable(paths["json"], most=2000)
    for a in range(0, len(texts), 500):
        ids, sizes = pretokens.ids_of(texts[a : a + 500], table)
        ends = np.cumsum(sizes)
        got = [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)]
        assert got == [x.ids for x in tokenizer.encode_batch(texts[a : a + 500], add_special_tokens=False)]


def test_pieces_go_straight_to_the_library_s_model(paths, tokenizer, monkeypatch):
    """Ids of texts as before, with no more than the marks handed over as texts of their own; every piece was one before."""
    from tokenizers.pre_tokenizers import ByteLevel

    wide = ["".join(map(chr, range(a, a + 64))) for a in [*range(0, 0x3000, 64), 0xFFC0, 0x1F600, 0x10FFC0]]
    texts = ["", *wide, "half \ud800\udfff pairs\udc80", "a<|endoftext|>b <|endoftext|>", " \n\t ", "erbeheiter ciónñadomente " * 50, "x" * 5000]
    table, handed = pretokens.PieceTable(paths["json"]), []
    monkeypatch.setattr(table, "encode", lambda t, encode=table.encode, **k: handed.extend(t) or encode(t, **k))
    ids, sizes = pretokens.ids_of(texts, table)
    got = np.split(ids, np.cumsum(sizes)[:-1])
    assert [x.tolist() for x in got] == [x.ids for x in tokenizer.encode_batch([t.encode("utf-8", "replace").decode() for t in texts], add_special_tokens=False)]
    assert set(handed) <= {"", "<|endoftext|>"} and len(table.place) > 500
    letters = pretokens.letters_of([t.encode("utf-32-le") for t in wide])
    assert letters == ["".join(x for x, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(t)) for t in wide]
    monkeypatch.setattr(table, "merge", None)
    pieces = [t.encode("utf-32-le", "surrogatepass") for t in (" haul", "a\ud800", "é", "net")]
    assert table.ids(pieces) == pretokens.PieceTable(paths["json"]).ids(pieces)


@pytest.mark.parametrize("window", [16, 64])
def test_round_trip(spark, odd, odd_rows, paths, tokenizer, window):
    out = pack_documents(odd, paths["json"], window=window, group_windows=8).toPandas()
    want = sorted(([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in odd_rows), key=len)
    assert out.groupby("doc_id", dropna=False)["length"].sum().sum() == sum(map(len, want))
    once = [r for r in odd_rows if r[0] is not None and sum(x[0] == r[0] for x in odd_rows) == 1]
    for doc, text, *_ in once:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        mine = out[out["doc_id"] == doc].sort_values("start")
        assert mine["start"].tolist() == (mine["length"].cumsum() - mine["length"]).tolist() and mine["length"].sum() == len(ids) == mine["doc_tokens"].iloc[0]
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= window


def test_windows_follow_the_mixture():
    totals = [70_003, 20_011, 9_000, 3]
    plan = Plan(totals, totals, 64, 128)
    taken = np.zeros(4, np.int64)
    for g in range(plan.groups):
        schedule = plan.schedule(g)
        sizes = np.diff(schedule.cum, axis=1)
        assert (sizes >= 0).all() and (sizes.sum(0)[:-1] == 64).all() and sizes.shape[1] < plan.stride
        taken += schedule.cum[:, -1]
        share = np.array(totals) / sum(totals) * 64
        assert (np.abs(sizes[:3, :-2] - share[:3, None]) <= 2).all()
        assert np.abs(schedule.owed[:, :-2]).max() <= 3
    assert taken.tolist() == totals


def test_windows_follow_targets_until_a_queue_is_empty():
    totals = {"=a": 50_000, "=b": 50_000, "=c": 8_000, "": 8_000}
    weights = weights_of(totals, {"a": 0.5, "b": 0.25, None: 0.05})
    assert np.allclose(np.array(weights) / sum(weights), [0.05, 0.5, 0.25, 0.2], atol=1e-6)
    plan = Plan([totals[q] for q in sorted(totals)], weights, 200, 32)
    sizes = np.concatenate([np.diff(plan.schedule(g).cum, axis=1)[:, :-1] for g in range(plan.groups)], axis=1)
    share = np.array(weights) / sum(weights) * 200
    early = sizes[:, : 40_000 // 200 - plan.groups]  # "=c" is the first to be empty, after 40,000 tokens of all queues
    assert (np.abs(early - share[:, None]) <= 2).all() and (np.abs(early.cumsum(1) - share[:, None] * np.arange(1, early.shape[1] + 1)) <= 4 + plan.groups).all()
    late = sizes[:, 45_000 // 200 : 85_000 // 200]  # the others share what "=c" leaves; "=a" is empty after 88,000
    assert (np.abs(late - (share * [1, 1, 1, 0] / 0.8)[:, None]) <= 3).all()
    assert sum(plan.schedule(g).cum[:, -1] for g in range(plan.groups)).tolist() == [totals[q] for q in sorted(totals)]
    with pytest.raises(ValueError):
        weights_of(totals, {"a": 0})


def test_more_sources_than_queues(spark, paths, tokenizer):
    rnd = random.Random(9)
    rows = [(k, " ".join(rnd.choice(["one", "two", "three"]) for _ in range(rnd.randint(1, 40))), f"s{rnd.choice([0, 0, 0, rnd.randrange(40)])}") for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = pack_documents(df, paths["json"], window=512, group_windows=8, max_queues=3, targets={"s7": 0.2}).toPandas()
    assert out["queue"].nunique() == 4 and "=s7" in set(out["queue"])
    sizes = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t, _ in rows}
    assert out.groupby("doc_id")["length"].sum().to_dict() == sizes
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 512
    source = {d: s for d, _, s in rows}
    mine = out[out["queue"] == out[out["doc_id"].map(source) == "s0"]["queue"].iloc[0]].sort_values(["sequence_id", "offset"])
    total, hot = mine["length"].cumsum(), mine["length"].where(mine["doc_id"].map(source) == "s0", 0).cumsum()
    share, others = hot.iloc[-1] / total.iloc[-1], mine["doc_id"].map(source).nunique() - 1
    assert others > 5 and (np.abs(hot - share * total) <= (1 + others / 2) * max(sizes.values())).all()  # each source is a document off at most, to either side


def test_each_schedule_is_made_once(monkeypatch):
    """However far the queues have got where the rows lie: here each of 30 has got as far as its number says, and a worker keeps two schedules."""
    made = []
    monkeypatch.setattr(packing, "Schedule", lambda *a, make=packing.Schedule: made.append(0) or make(*a))
    plan = Plan([60_000] * 30, [60_000] * 30, 256, 64)
    plan.most = 2
    queues, places = list(range(30)) * 10, np.array([1900 * q + 100 * k for k in range(10) for q in range(30)])
    cut = [list(plan.pieces(queues[i], int(places[i]), 100)) for i in plan.order(queues, places).tolist()]
    assert all(sum(size for _, size, *_ in x) == 100 for x in cut)
    assert plan.groups > 100 and len(made) <= plan.groups


def test_stored_ids_are_not_shuffled(spark, odd, paths, monkeypatch):
    """Where a block's tokens start goes to the ids, not the ids to it; with too many starts for that, the rows are the same."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    try:
        found = []
        for few, kind in ((16 << 20, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr("fleettrack.llm.packing.FEW_STARTS", few, raising=False)
            out = pack_documents(odd.repartition(5, "text"), paths["json"], window=64, group_windows=4)
            joins = set(re.findall(r"\w+Join\b", out._jdf.queryExecution().executedPlan().toString()))
            assert joins == {kind}
            found.append(out.toPandas().fillna(-1).sort_values(["doc_id", "sequence_id", "offset"]).values.tolist())
        assert found[0] == found[1] and found[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_pieces_that_share_a_hash_are_told_apart(spark, paths, tokenizer, n):
    """Polynomial hashes modulo 2^64 are equal for a Thue-Morse word and its complement."""
    one = thue_morse(n)
    two = one.translate(str.maketrans("ab", "ba"))
    codes = pretokens.codes_of([one, two])
    assert len(set(pretokens.hashes_of(codes, pretokens.starts_of(codes)).tolist())) == 2  # two words and their two ends: the hashes do collide
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in (one, two)]
    for texts in ([one, two], [two, one], [one], [two]):
        table = pretokens.PieceTable(paths["json"])
        ids, sizes = pretokens.ids_of(texts, table)
        assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == want[texts[0] == two]
        assert ids.tolist() == sum((want[t == two] for t in texts), [])
    df = spark.createDataFrame([(1, one), (2, two), (3, f"{one} {two} {one}")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, paths["json"]).collect()} == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) for k, t in ((1, one), (2, two), (3, f"{one} {two} {one}"))}


def test_token_counts(odd, odd_rows, paths, tokenizer):
    got = token_counts(odd, paths["json"]).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in odd_rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_tables(odd, paths):
    empty = odd.limit(0)
    assert pack_documents(empty, paths["json"]).count() == 0
    assert token_counts(empty, paths["json"]).count() == 0
