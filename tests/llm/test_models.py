"""Quality and language: rules on small texts, and accuracy on held-out documents."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from diurna.llm import langid, quality
from diurna.llm.textcore import flat

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([3, 1, 4])
    emit, trans = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    good, moves = quality.chain(emit, trans, lines)
    at, expected, pairs = 0, [], np.zeros((2, 2))
    for n in lines:
        e = emit[at : at + n]
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(2**n)]
        weight = np.array([np.exp(sum(e[i, s] for i, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths])
        weight /= weight.sum()
        expected += [sum(w for w, p in zip(weight, paths, strict=True) if p[i]) for i in range(n)]
        for w, p in zip(weight, paths, strict=True):
            for a, b in zip(p, p[1:], strict=False):
                pairs[a, b] += w
        at += n
    assert np.allclose(good, expected) and np.allclose(moves, pairs)


def test_line_features():
    own, lengths, lines = quality.line_features(*flat(pa.array(["ab ab ab\nX|", "", None, "é"])))
    assert lines.tolist() == [2, 1, 1, 1] and lengths.tolist() == [8, 2, 1, 1, 1] and own.shape == (5, quality.OWN)
    assert np.isclose(own[0, 7], 2 / 3) and own[2, 13] == 1 and np.isfinite(own).all()


def test_quality_on_held_out(spark, odd, nothing):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    out = quality.op2_quality(spark, SF)
    rows = out.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.97
    scored = quality.score(odd, model, keep=True)
    assert scored.columns.count("score") == 1 and scored.count() == odd.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(nothing, model).count() == 0
    assert quality.train(odd, labels.limit(0)) is None and quality.score(odd.select("doc_id", "text"), None).first().score == 0.5
    lines = quality.line_labels(docs.where("doc_id = 0"), model).collect()
    assert [r.line for r in sorted(lines)] == list(range(len(lines)))
    again = labels.unionByName(labels).withColumn("text", F.lit("clash"))
    assert quality.train(docs, again) is not None


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    scores, places, counts = rng.normal(size=(6, 3)) * 3, rng.integers(0, 6, 9), np.array([4, 0, 5])
    got = langid.viterbi(scores, places, counts, 1.5)
    at = 0
    for n in counts:
        s = scores[places[at : at + n]]
        best = max((sum(s[i, p // 3**i % 3] for i in range(n)) - 1.5 * sum(p // 3**i % 3 != p // 3 ** (i + 1) % 3 for i in range(n - 1)), p) for p in range(3**n))
        mine = got[at : at + n]
        total = sum(s[i, x] for i, x in enumerate(mine)) - 1.5 * sum(a != b for a, b in zip(mine, mine[1:], strict=False))
        assert n == 0 or np.isclose(total, best[0])
        at += n


def test_language_on_held_out(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.op5_language(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(odd, model).where("doc_id is not null").collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and langid.predict(nothing, model).count() == 0
    assert langid.train(docs.limit(0)) is None and {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_mixed_text_has_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    en, de = (docs.where((F.col("lang") == lang) & (F.col("n_chars") > 500)).orderBy("doc_id").first().text[:400] for lang in ("en", "de"))
    mixed = spark.createDataFrame([(1, f"{en} {de}")], "doc_id long, text string")
    found = [r.lang for r in langid.spans(mixed, model).orderBy("first_word").collect() if r.words > 10]
    assert found[0] == "en" and found[-1] == "de"


def test_scripts_narrow_candidates(spark):
    rows = [(i, "привет мир это текст", "ru") for i in range(40)] + [(i, "hello world this is text", "en") for i in range(40, 80)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = langid.predict(spark.createDataFrame([(1, "совсем другое"), (2, "quite different")], "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in out.collect()} == {1: "ru", 2: "en"}


def test_marks_are_no_language_and_all_languages_are_learned(spark, monkeypatch):
    rows = [(i, f"{'abcdefghijklmnopqrstuvwxyz'[i % 26] * 5} {'abcdefghijklmnopqrstuvwxyz'[i % 26] * 3} word", f"l{i % 26:02d}") for i in range(26 * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for cells in (langid.CELLS, 26 << langid.LEAST_BITS):  # the second leaves each language the smallest tables
        monkeypatch.setattr(langid, "CELLS", cells)
        model = langid.train(docs)
        assert len(model.names) == 26 and len(model.logs) == 1 << langid.bits_for(26)
        got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
        assert all(got[i] == lang for i, _, lang in rows)
    odd = spark.createDataFrame([(1, "\u0301\u0300 \u0308"), (2, "12 \u0301 34"), (3, "a\u0301")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.predict(odd, model).orderBy("doc_id").collect()] == [True, True, False]


def test_sample_is_that_of_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_DOCS", 5)
    seen = []
    monkeypatch.setattr(langid, "small", lambda df, n: seen.append(df) or F.broadcast(df))
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("lang"))
    langid.train(docs)
    taught = docs.where(~quality.held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id")).collect()
    for lang in "ab":
        expected = sorted((r.h, r.doc_id) for r in taught if r.lang == lang)[:5]
        assert sorted(r.doc_id for r in seen[-1].where(F.col("lang") == lang).collect()) == sorted(d for _, d in expected)


def test_line_labels_are_latent_and_the_sample_is_bounded(spark, monkeypatch):
    rng = np.random.default_rng(3)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(12)) + "."
    bad = lambda: " ".join("$#%*" for _ in range(12))
    texts = [("\n".join(good() for _ in range(8)), 1) for _ in range(60)] + [("\n".join([good(), *(bad() for _ in range(9)), good()]), 0) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(texts)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: seen.append(a) or fit(*a))
    model = quality.train(docs.unionByName(docs), labels)
    lines = {(r.doc_id, r.line): r.good for r in quality.line_labels(docs, model).collect()}
    inner, outer = [lines[i, 4] for i in range(60, 120)], [lines[i, 0] for i in range(60, 120)]
    assert np.mean(inner) < 0.05 and np.mean(outer) > np.mean(inner) and min(lines[i, 4] for i in range(60)) > 0.7
    assert len(seen[0][2]) == docs.where(~quality.held_out(F.col("doc_id"))).count()  # repeated rows count once
    monkeypatch.setattr(quality, "TRAIN_LINES", 200)
    quality.train(docs, labels)
    assert 0 < seen[1][2].sum() <= 200


def test_gradient_is_that_of_one_objective():
    """Posteriors of a chain that already agrees with the labels leave nothing to learn."""
    rng = np.random.default_rng(2)
    lines, label = np.array([3, 1, 4]), np.array([1, 0, 1])
    emit, trans = rng.normal(size=(8, 2)) + 9 * np.repeat(np.stack([1 - label, label], 1), lines, axis=0), rng.normal(size=(2, 2))
    weight = np.repeat(rng.random(3), lines)
    y, seen = quality.taught(emit, trans, lines, np.ones(8), label, weight)
    good, moves = quality.chain(emit, trans, lines, weight)
    assert np.allclose(y, good) and np.allclose(seen, moves)
    y, _ = quality.taught(emit, trans, lines, np.ones(8), 1 - label, weight)
    share = np.add.reduceat(y, [0, 3, 4]) / lines
    assert np.allclose(np.where(label == 0, share, 1 - share), quality.TAUGHT, atol=0.03)
