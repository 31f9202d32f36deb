import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleettrack.llm import decontamination, language_id, line_dedup, pseudo_likelihood, toxicity, transcripts
from fleettrack.llm.entries import QUERIES

SF = "/root/testdata/sf0.01"


# ---- toxicity


def toxic_rows():
    rnd = random.Random(0)
    clean = [f"word{k}" for k in range(80)]
    rows = []
    for k in range(400):
        text = [rnd.choice(clean) for _ in range(30)]
        bad = k % 4 == 0
        if bad:
            for _ in range(rnd.randint(1, 4)):
                text.insert(rnd.randrange(30), rnd.choice(["vilestem", "fouling"]) + rnd.choice(["", "a", "ix", "ous"]))
        rows.append((k, " ".join(text), int(bad)))
    return rows


def test_toxicity_learns_and_orders(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:300]] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) >= 2
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    right = [(got[d]["p_toxic"] >= 0.5) == bool(t) for d, _, t in rows[300:]]
    assert np.mean(right) > 0.97
    few = toxicity.score(spark.createDataFrame([(1, "vilestem " + "word1 " * 20), (2, "vilestem foulinga vilestemix foulingous " + "word1 " * 20), (3, None), (4, "")], "doc_id long, text string"), model).collect()
    assert few[0]["severity"] < few[1]["severity"] and few[2]["severity"] == few[3]["severity"]
    kept = toxicity.keep_harmless(docs.withColumn("p", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "p"] and abs(kept.count() - 300) < 10


def test_gradient_of_the_ordinal_model():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(6, rng.integers(1, 5), replace=False)) for _ in range(400)]
    score = np.array([sum((k - 2) * 1.5 for k in r) for r in rows]) + rng.logistic(size=400)
    grade = (score[:, None] > np.array([0.0, 2.0])).sum(1)
    model = toxicity.fit(rows, grade, l2=0)
    assert [model.weights[k] for k in sorted(model.weights)] == sorted(model.weights.values()) and np.all(np.diff(model.thresholds) > 0)


def test_fit_reaches_the_best_likelihood_there_is():
    """Against all models of one feature on a grid."""
    rng = np.random.default_rng(3)
    has = rng.random(300) < 0.5
    grade = (np.where(has, 1.4, -0.2) + rng.logistic(size=300) > np.array([[0.3], [1.9]])).sum(0)
    rows = [np.array([7], np.uint32) if h else np.empty(0, np.uint32) for h in has]
    weight = np.where(np.arange(300) % 5 == 0, 0.5, 1.0)
    of_class = np.array([1 / weight[grade == g].sum() for g in range(3)])

    def loss(w, t1, t2):
        p = 1 / (1 + np.exp(-(w * has[:, None] - np.array([t1, t2]))))
        cum = np.concatenate([np.ones((300, 1)), p, np.zeros((300, 1))], 1)
        return -(weight * of_class[grade] * np.log(cum[np.arange(300), grade] - cum[np.arange(300), grade + 1])).sum()

    model = toxicity.fit(rows, grade, np.array([7]), weight, l2=0)
    grid = min(loss(w, t, t + g) for w in np.arange(0, 3, 0.1) for t in np.arange(-1, 2, 0.1) for g in np.arange(0.1, 3, 0.1))
    assert loss(model.weights[7], *model.thresholds) <= grid + 1e-3


def test_copies_weigh_less_and_none_goes():
    assert toxicity.copy_weights(np.array([5, 5, 5, 5, 6, -1, -1, -1, 7, 7])).tolist() == [0.5] * 4 + [1, 1, 1, 1, 1, 1]


def test_grades():
    assert toxicity.grades(np.array([0, 1, 1, 1, 0]), np.array([9, 1, 5, 9, 0]), 3).tolist() == [0, 1, 2, 3, 0]
    assert toxicity.grades(np.array([0, 3, 1, 5]), np.zeros(4), 3).tolist() == [0, 2, 1, 3]  # labels that are grades


def test_features_speak_for_and_against():
    rows = [np.array([1] if k % 10 == 0 else [2], np.uint32) for k in range(500)]
    model = toxicity.fit(rows, np.array([int(k % 10 == 0) for k in range(500)]))
    assert model.weights[1] > 0 > model.weights[2]


def test_toxicity_with_clashing_columns_and_repeated_ids(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(3, "word1 word2")] * 40 + [(None, "vilestem")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1)], "doc_id long, toxic int")
    plain = toxicity.train(docs, labels)
    names = ("toxic", "id", "_id", "half", "key", "features", "severity", "feature")
    clash = docs.withColumns({c: F.lit("x") for c in names})
    model = toxicity.train(clash, labels.withColumns({c: F.lit(9) for c in ("text", "half")}))
    assert model == plain
    kept = toxicity.keep_harmless(clash, model)
    assert kept.columns == clash.columns and {tuple(r)[2:] for r in kept.collect()} == {("x",) * len(names)}
    assert toxicity.score(clash, model).count() == docs.count()


def test_toxicity_without_labels(odd, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(odd, toxicity.train(odd, labels))
    assert out.count() == odd.count() and out.agg(F.max("severity")).first()[0] == 0
    assert toxicity.score(odd.limit(0), toxicity.Ordinal()).count() == 0


# ---- line dedup


def plain_dedup(rows, sites=5, chars=10):
    seen = {}
    for _, text, source in rows:
        for line in (text or "").split("\n") if text is not None else []:
            seen.setdefault(line.strip(" "), set()).add(source)
    bad = {k for k, s in seen.items() if len(k) >= chars and len(s - {None}) >= sites}
    out = []
    for d, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if x.strip(" ") not in bad]
        ok = len(kept) < len(lines) and "\n".join(kept).strip(" \t\n\x0b\f\r") != ""
        out.append((d, len(lines), len(lines) - len(kept), len(lines) - len(kept) if ok else 0, "\n".join(kept) if ok else text))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rnd = random.Random(2)
    common = [f"this line of a page is shared by {k} sites and more" for k in (4, 5, 6, 9)] + ["ten signs.", "ten sign."]
    rows = []
    for k in range(300):
        lines = [f"own words number {k} {j} " + "x" * rnd.randint(0, 60) for j in range(rnd.randint(1, 6))]
        if rnd.random() < 0.6:
            c = rnd.randrange(6)
            rows.append((k, "\n".join([*lines, common[c]]), f"s{rnd.randrange((4, 5, 6, 9, 9, 9)[c])}"))
        else:
            rows.append((k, "\n".join(lines), f"s{k % 9}"))
    rows += [(400 + k, f"{common[3]}\n{common[2]}", f"s{k}") for k in range(9)]  # copies: left whole, and marked
    rows += [(500, None, "s1"), (501, "", None), (None, common[3] + "\n" + "own text of this one " * 9, None), (7, "again " * 30 + "\n" + common[3], "s1"), (502, "\n\n", "s1"), (None, None, "s1")]
    rows += [(503, f"a\n{common[3]}\n{common[2]}\n{common[3]}", "s2"), (504, f" \x0b\n{common[3]}\n\t", "s2")]  # mostly boilerplate; nothing but blanks beside it
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("site", "h", "doc", "line", "a", "b", "salt")})
    out = line_dedup.drop_boilerplate(df)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_boilerplate"], r["n_removed"], r["text"]) for r in out.collect()), key=str) == plain_dedup(rows)
    assert out.where("n_removed > 0").count() > 20 and out.columns == [*df.columns, "n_lines", "n_boilerplate", "n_removed"]
    assert {r["n_boilerplate"] for r in out.where("doc_id BETWEEN 400 AND 408").collect()} == {2}
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_line_dedup_keeps_own_columns(spark):
    rows = [(k, f"own {k}\nthis line of a page is shared by many", f"s{k}", 99, "x") for k in range(6)]
    out = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, n_removed string"))
    assert out.columns == ["doc_id", "text", "source", "n_lines", "n_removed", "n_lines_", "n_boilerplate", "n_removed_"]
    assert {tuple(r)[3:] for r in out.collect()} == {(99, "x", 2, 1, 1)} and {r["text"] for r in out.collect()} == {f"own {k}" for k in range(6)}


def test_line_dedup_leaves_no_boilerplate_beside_own_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    out = line_dedup.drop_boilerplate(docs).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_boilerplate"], r["n_removed"], r["text"]) for r in out), key=str) == plain_dedup(rows)
    assert sum(r["n_removed"] > 0 for r in out) > 20


# ---- transcripts


def talk(n, seed=5):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        roles = (["system"] if c % 4 == 0 else []) + ["user", "assistant"] * rnd.randint(1, 4)
        rows += [(c, t, role, "\n".join(rnd.choice(["", f"some words {rnd.random()} "]) * rnd.randint(1, 4) for _ in range(1 if role == "user" else 3))) for t, role in enumerate(roles)]
    return rows


TALK = "conv_id long, turn long, role string, text string"


def test_transcripts(spark):
    rows = talk(160)
    lines = transcripts.transcripts_of(spark.createDataFrame(rows, TALK), transcripts.spoken_text())
    got = transcripts.recover(lines, transcripts.learn(lines.where("conv < 40"))).where("conv >= 40").collect()
    rows = [r for r in rows if r[0] >= 40]
    truth = {(c, t): role for c, t, role, _ in rows}
    right = sum(truth.get((r["conv"], r["first_turn"])) == r["role"] for r in got)
    assert right / len(rows) > 0.93 and abs(len(got) - len(rows)) < 0.07 * len(rows)
    one = next(r for r in got if r["role"] == "user")
    assert one["rendered"].startswith("<|user|>\n") and one["rendered"].endswith("<|end|>\n") and not one["text"].startswith(("User", "Human", "["))


def test_transcript_query_scores_held_out_conversations(spark):
    out = QUERIES["op4_transcripts"](spark, SF)
    truth = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", F.col("role").alias("true_role"))
    right = out.where("held_out").join(truth, ["conv_id", "turn"]).agg(F.avg((F.col("role") == F.col("true_role")).cast("double"))).first()[0]
    assert right > 0.95 and out.where("held_out").count() > 0


def test_viterbi_finds_the_best_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(4)
    s = transcripts.STATES
    model = transcripts.Model(*(x / x.sum(-1, keepdims=True) for x in (rng.random(s), rng.random((s, s)), rng.random((transcripts.KINDS, s, 4)))))
    size = np.array([4, 1, 3, 5, 2])
    seen = rng.integers(0, 2, (15, transcripts.KINDS))
    before, last = np.array([-1, -1, 3, 0, -1]), np.array([-1, 2, -1, 4, -1])
    got = model.viterbi(seen, size, before, last)
    score, ends = model.scores(seen), np.cumsum(size)
    for k in range(5):
        own = score[ends[k] - size[k] : ends[k]]

        def value(path):
            first = model.start[path[0]] if before[k] < 0 else model.move[before[k], path[0]]
            return first + sum(model.move[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(own[t, p] for t, p in enumerate(path))

        paths = [p for p in product(range(s), repeat=int(size[k])) if last[k] < 0 or p[-1] == last[k]]
        assert tuple(got[ends[k] - size[k] : ends[k]]) == max(paths, key=value)


def test_blocks_decode_as_one(spark):
    """Turns that go on over a block's end, and blank lines there."""
    rnd = random.Random(6)
    rows = [(c, t, ["user", "assistant"][t % 2], "\n".join(rnd.choice(["", "words", "more words?", "x" * 70]) for _ in range(rnd.randint(1, 4)))) for c in (1, 2) for t in range(50)]
    df = spark.createDataFrame(rows, TALK)
    whole = transcripts.transcripts_of(df, F.when(F.col("turn") % 5 == 0, transcripts.spoken_text()).otherwise(F.col("text")))
    model = transcripts.learn(whole)
    key = lambda r: (r["conv"], r["turn_no"])
    want = sorted((tuple(r) for r in transcripts.recover(whole, model).collect()), key=lambda r: r[:2])
    assert len(want) < 90  # turns go on
    for size in (1, 7):
        cut = transcripts.transcripts_of(df, F.when(F.col("turn") % 5 == 0, transcripts.spoken_text()).otherwise(F.col("text")), block=size)
        got = sorted(transcripts.recover(cut, model).collect(), key=key)
        assert [tuple(r) for r in got] == want


def test_turns_that_repeat_are_cut_but_not_mixed(spark):
    rows = [(1, 0, "user", f"User: a{k}\nb{k}") for k in range(40)] + [(1, None, "user", f"User: c{k}\nd{k}") for k in range(30)] + [(2, 1, "user", "User: a1\na2"), (2, 1, "user", "User: b1\nb2")]
    df = spark.createDataFrame(rows, TALK)
    cut = transcripts.transcripts_of(df, F.col("text"), block=3)
    assert cut.where("conv = 1").select("block", "sub").distinct().count() > 10
    s = transcripts.STATES
    model = transcripts.learn(transcripts.transcripts_of(spark.createDataFrame([(9, t, "user", f"User: a\nb\n{t}") for t in range(30)], TALK), F.col("text")))
    got = transcripts.recover(cut, model).collect()
    assert sorted((r["conv"], r["text"]) for r in got) == sorted((c, t.removeprefix("User: ")) for c, _, _, t in rows) and len(model.start) == s


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "hi"), (None, 0, "user", "hi"), (None, None, None, None), (3, 1, "robot", "x"), (3, 1, "user", ""), (3, 1, "user", ""), (4, 0, "user", "w " * 20000)]
    df = spark.createDataFrame(rows, TALK).withColumns({c: F.lit(1) for c in ("line", "block", "sub", "h", "first", "part")})
    lines = transcripts.transcripts_of(df, transcripts.spoken_text())
    out = transcripts.recover(lines, transcripts.learn(lines))
    assert out.agg(F.sum("n_lines")).first()[0] == 7 and out.where("conv IS NULL").count() == 3
    assert {r["turn_no"] for r in out.where("conv IS NULL").collect()} == {0}
    assert transcripts.recover(lines.limit(0), transcripts.Model()).count() == 0
    assert transcripts.recover(lines, transcripts.learn(lines.limit(0))).where("role <> 'user'").count() == 0


# ---- language


def test_language(spark):
    out = QUERIES["op5_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = out.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97 and out.where("score < 0 or score > 1").count() == 0


def test_language_odd_rows(odd, odd_rows):
    profiles = language_id.learn(odd)
    got = language_id.predict(odd, profiles, language_id.held_out_rows()).collect()
    assert len(got) == len(odd_rows)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (60, 61, 63)} == {"und"} and {r["lang_pred"] for r in got} <= {"und", "en", "fr"}
    assert {r["lang_pred"] for r in language_id.predict(odd, {}, language_id.held_out_rows()).collect()} == {"und"}
    assert language_id.learn(odd.limit(0)) == {}


def test_bundle_is_the_sum_of_its_grams():
    grams = language_id.Grams()
    got, has = language_id.bundles(["Ab, é", "12"], grams)
    text, vec = " ab é ", np.zeros(language_id.DIM)
    for k in range(len(text) - 2):
        a, b, c = (grams.letter(ord(x)).astype(int) for x in text[k : k + 3])
        vec += np.roll(a, 2) * np.roll(b, 1) * c
    assert has.tolist() == [True, False] and np.allclose(got[0], vec)


# ---- decontamination


def least_edits(pattern, text):
    """Sellers' algorithm: least edits of the pattern in any part of the text."""
    row = [0] * (len(text) + 1)
    for k, p in enumerate(pattern):
        new = [k + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_each_place():
    rnd = random.Random(9)
    item = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(15))
    index = decontamination.Index([(7, item)], 8, 0.1, 50)
    m = len(item)
    for n in (1, 2, 40):  # places that stand side by side
        assert index.leaks(" ".join([item] * n)) == [(7, k * (m + 1), k * (m + 1) + m, 0) for k in range(n)]
    worn = item[:30] + "#" + item[31:]
    assert index.leaks(f"{worn} {item} xx {worn}") == [(7, 0, m, 1), (7, m + 1, 2 * m + 1, 0), (7, 2 * m + 5, 3 * m + 5, 1)]
    assert [e for *_, e in index.leaks(item[3:])] == [3] and [e for *_, e in index.leaks("y" + item[:-2])] == [2]  # at the ends of a text


def test_leaks_against_all_alignments():
    rnd = random.Random(8)
    letters = "abcdef "
    items = [(k, "".join(rnd.choice(letters) for _ in range(rnd.randint(55, 90))).strip() + "z") for k in range(6)]
    index = decontamination.Index(items, 8, 0.1, 50)
    for _ in range(60):
        k, item = rnd.choice(items)
        text = list(decontamination.normal(item))
        for _ in range(rnd.randint(0, 10)):
            p = rnd.randrange(len(text))
            text[p : p + 1] = rnd.choice([[], [rnd.choice(letters)], [text[p], rnd.choice(letters)]])
        noise = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80)))
        whole = decontamination.normal(noise() + "".join(text) + noise())
        got = {i: e for i, _, _, e in index.leaks(whole)}
        want = {i: e for (i, t), n in zip(items, index.edits.tolist(), strict=True) if (e := least_edits(decontamination.normal(t), whole)) <= n}
        assert got == want


def test_leaks_odd_rows(odd, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "long and wide " * 6), (3, "long and wide " * 6)], "item_id long, text string")
    got = decontamination.leaks(odd, items).collect()
    assert {r["doc_id"] for r in got} == {62} and all(r["edits"] == 0 for r in got)
    blocks = decontamination.leaks(odd, items, block_chars=10)
    assert {r["doc_id"] for r in blocks.collect()} == {62}
    assert decontamination.without_leaks(odd, items).count() == odd.count() - 1
    assert decontamination.leaks(odd, items.limit(0)).count() == 0 and decontamination.leaks(odd.limit(0), items).count() == 0


def test_short_items_match_as_whole_words(spark):
    items = spark.createDataFrame([(1, "What is 2+2?"), (2, "cat"), (3, " \t"), (4, "the  Cat"), (5, "x" * 49)], "item_id long, text string")
    docs = spark.createDataFrame([(10, "so: WHAT is\n2+2? yes"), (11, "concatenate cats the cats"), (12, "see the cat, cat"), (13, "y" + "x" * 49), (14, "x" * 49), (15, None), (16, "what is 2+2")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["start"], r["end"], r["edits"]) for r in decontamination.leaks(docs, items).collect())
    assert got == [(10, 1, 4, 16, 0), (12, 2, 8, 11, 0), (12, 2, 13, 16, 0), (12, 4, 4, 11, 0), (14, 5, 0, 49, 0)]
    assert sorted(r["doc_id"] for r in decontamination.without_leaks(docs, items).collect()) == [11, 13, 15, 16]


# ---- pseudo-likelihood


def test_pseudo_likelihood_prefers_the_language_it_saw(spark):
    rnd = random.Random(3)
    rows = [(k, " ".join("abcde"[(j + k) % 5] for j in range(60))) for k in range(150)]
    shuffled = [(1000 + k, " ".join(rnd.sample(t.split(), 60))) for k, (_, t) in enumerate(rows[:20])]
    df = spark.createDataFrame([*rows, *shuffled, (2000, None), (2001, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pseudo_likelihood.pseudo_likelihood(df, rounds=2).collect()}
    assert np.mean([out[k]["mean_log_prob"] for k in range(20)]) > np.mean([out[1000 + k]["mean_log_prob"] for k in range(20)]) + 0.3
    assert out[2000]["n_words"] == 0 and out[2001]["log_prob"] == 0 and out[2000]["mean_log_prob"] is None


def test_conditional_probabilities_add_up():
    vocab = pseudo_likelihood.Vocabulary([(w, 10) for w in "abcdef"], 5)
    net = pseudo_likelihood.Network(vocab)
    total = 0.0
    for w in range(vocab.size):
        ids = np.array([0, 0, 34, 35, w, 36, 37, 0, 0])
        total += np.exp(net.log_probs(ids, np.array([4])))[0]
    assert total == pytest.approx(1, abs=1e-4)


def test_pseudo_likelihood_empty(odd, odd_rows):
    assert pseudo_likelihood.pseudo_likelihood(odd.limit(0)).count() == 0
    got = pseudo_likelihood.pseudo_likelihood(odd).collect()
    assert sorted(r["n_words"] for r in got) == sorted(len(re.findall(r"\w+|[^\w\s]", (r[1] or "").lower())) for r in odd_rows)


def test_every_word_is_a_target_once():
    lens = np.array([11, 1, 0, 2, 40])
    _, at, owner = pseudo_likelihood.windows(np.ones(54, np.int64), lens)
    assert np.bincount(owner, minlength=5).tolist() == lens.tolist()
    for rounds in (1, 2, 3):
        got = np.concatenate([pseudo_likelihood.targets(at, owner, k, rounds) for k in range(rounds)])
        assert sorted(got.tolist()) == at.tolist() and len(at) == 54


def plain_log_prob(net, ids, at):
    """log P of one word by its definition, in double precision."""
    x = sum(net.tables[k][ids[at + s]].astype(float) for k, s in enumerate(pseudo_likelihood.SHIFTS))
    h, y = np.tanh(x), ids[at]
    z = net.classes.astype(float) @ h + net.class_bias
    kind = net.vocab.kind[y]
    out = z[kind] - z.max() - np.log(np.exp(z - z.max()).sum())
    a, b = net.vocab.edges[kind], net.vocab.edges[kind + 1]
    z = net.words[a:b].astype(float) @ h + net.word_bias[a:b]
    return out + z[y - a] - z.max() - np.log(np.exp(z - z.max()).sum())


def small_network(scale=0.3):
    vocab = pseudo_likelihood.Vocabulary([(f"w{k}", 40 - k) for k in range(30)], 50)
    net = pseudo_likelihood.Network(vocab)
    net.flat[:] = np.random.default_rng(5).standard_normal(len(net.flat)) * scale
    ids, at, _ = pseudo_likelihood.windows(np.random.default_rng(6).integers(1, vocab.size, 60), np.array([20, 39, 1]))
    return net, ids, at


@pytest.mark.parametrize("scale", [0.3, 8.0])
def test_log_probs_are_those_of_the_definition(scale):
    net, ids, at = small_network(scale)
    np.clip(net.flat, -8, 8, out=net.flat)
    got = net.log_probs(ids, at)
    assert np.isfinite(got).all() and np.allclose(got, [plain_log_prob(net, ids, k) for k in at.tolist()], rtol=1e-4, atol=1e-4)


def test_gradients_are_those_of_the_definition():
    net, ids, at = small_network()
    at = at[::3]
    loss = lambda: -np.mean([plain_log_prob(net, ids, k) for k in at.tolist()])
    for (row, _), (which, grad) in zip(net.rows, net.gradients(ids, at), strict=True):
        full = np.zeros(row.shape)
        full[which] = grad
        for k in np.random.default_rng(7).choice(row.size, 12):
            i, j = divmod(int(k), row.shape[1])
            kept, ends = row[i, j], []
            for step in (2e-3, -2e-3):
                row[i, j] = kept + step
                ends.append(loss())
            row[i, j] = kept
            assert full[i, j] == pytest.approx((ends[0] - ends[1]) / 4e-3, abs=2e-4)
    before = loss()
    for _ in range(30):
        net.step(ids, at, 0.1)
    assert loss() < before - 0.5


def test_scores_are_sums_over_words_and_counts(spark):
    """The whole query against plain counts and the definition of every word's probability."""
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["tide", "wind", "net", "haul", f"rare{rnd.randrange(30)}"]) for _ in range(rnd.randint(0, 25))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = pseudo_likelihood.stored(pseudo_likelihood.pieces_of(df), "test-pieces")
    totals = pseudo_likelihood.stored(pseudo_likelihood.word_totals(pieces, 3), "test-totals")
    vocab, place = pseudo_likelihood.vocabulary(totals, 3)
    count = Counter(w for t in texts for w in t.split())
    top = sorted(count, key=lambda w: (-count[w], w))[:3]
    assert list(vocab.place) == top
    net = pseudo_likelihood.train(pieces, vocab)
    of = Counter()
    for w, n in count.items():
        of[pseudo_likelihood.place_of_word(w) % pseudo_likelihood.OTHERS] += n * (w not in top)
    got = {r["doc_id"]: r for r in pseudo_likelihood.score(pieces, totals, net, place).collect()}
    for d, t in enumerate(texts):
        words = t.split()
        ids = np.array([0, 0, *vocab.ids(words), 0, 0])
        want = sum(plain_log_prob(net, ids, k + 2) + (0 if w in top else np.log(count[w] / of[pseudo_likelihood.place_of_word(w) % pseudo_likelihood.OTHERS])) for k, w in enumerate(words))
        assert got[d]["n_words"] == len(words) and got[d]["log_prob"] == pytest.approx(want, abs=2e-3)


def test_scores_do_not_depend_on_how_the_input_is_cut(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "SHARD_CHARS", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 150")
    one, many = ({r["doc_id"]: r["log_prob"] for r in pseudo_likelihood.pseudo_likelihood(d, words=200).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one.keys() == many.keys() and all(abs(one[d] - many[d]) < 1e-2 for d in one)


def test_pieces_hold_every_text(spark, odd, odd_rows):
    rows = pseudo_likelihood.pieces_of(odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 50).collect()
    got = []
    for r in rows:
        words, local = pseudo_likelihood.words_of(r["words"]), pseudo_likelihood.from_planes(r["ids"])
        ends = np.cumsum(np.frombuffer(r["lens"], "<u4").astype(int))
        for d, known, a, b in zip(np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["known"], np.uint8), [0, *ends], ends, strict=False):
            got.append((int(d) if known else None, [words[k] for k in local[a:b]]))
    want = [(r[0], re.findall(r"\w+|[^\w\s]", (r[1] or "").lower())) for r in odd_rows]
    assert sorted(got, key=str) == sorted(want, key=str) and len(rows) > 3


def test_rare_words_are_told_apart(spark):
    place = {}
    for k in range(2000):  # two rare words of one place
        w = f"rare{k}"
        place.setdefault(zlib.crc32(w.encode()) % pseudo_likelihood.OTHERS, []).append(w)
    often, once, third = place[3][:3]
    rows = [(k, "the cat " * 8 + often) for k in range(6)] + [(10, "the cat " * 8 + once), (11, "the cat " * 8 + third), (11, "the cat " * 8 + third), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pseudo_likelihood.pseudo_likelihood(df, words=2).collect()
    logs = {r["doc_id"]: r["log_prob"] for r in got}
    assert len(got) == len(rows) and logs[None] == 0
    assert logs[0] - logs[10] == pytest.approx(np.log(6), abs=1e-3) and logs[11] - logs[10] == pytest.approx(np.log(2), abs=1e-3)


def test_words_in_are_those_of_the_pattern():
    signs = "".join(map(chr, range(0x2190, 0x2190 + pseudo_likelihood.MOST_SIGNS + 1)))
    odd = ["", "\n", "a\nb", "Don't, don't!", "x_1-y\x00z", "\x1c\x1d\x1e\x1f\x85\xa0|\u2028\u3000.\u200b", "e\u0301 \u0130\u03a3\u03a3", "\ud800 a\udfffb", "\U0001f642\U0001f642a", "\u6f22\u5b57\u3002"]
    everything = ["".join(map(chr, range(a, a + 200))) for a in range(0, 0x3000, 200)]
    for texts in (odd, [*odd, signs], everything, [*odd, "a, b. " * 300_000, *odd], []):
        assert list(pseudo_likelihood.words_in(texts)) == [re.findall(r"\w+|[^\w\s]", t.lower()) for t in texts]


def test_words_of_a_piece_are_hashed_once(spark, monkeypatch):
    """Rounds and scores take the hashes that the pieces hold; each hashed all words anew before."""
    df = spark.createDataFrame([(k, f"tide wind\u00fc net haul rare{k}") for k in range(50)], "doc_id long, text string")
    rows = pseudo_likelihood.pieces_of(df).collect()
    vocab = pseudo_likelihood.Vocabulary([("tide", 50), ("net", 50)], 150)
    for r in rows:
        words, places = pseudo_likelihood.words_of(r["words"]), np.frombuffer(r["places"], "<u4")
        assert places.tolist() == [zlib.crc32(w.encode()) for w in words]
        want = vocab.ids(words)
        with monkeypatch.context() as m:
            m.setattr(pseudo_likelihood, "place_of_word", None)
            assert vocab.ids(words, places).tolist() == want.tolist()
    assert sum(len(np.frombuffer(r["lens"], "<u4")) for r in rows) == 50
