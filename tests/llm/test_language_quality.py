import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from structsim.llm import language_id as L
from structsim.llm import quality as Q

PARTS = {"aa": "an the of ing er on th", "bb": "le que é ai ou eau è", "cc": "der ung ch ö sch ß ei"}


def texts(n):
    rng = random.Random(4)
    for k in range(n):
        lang = list(PARTS)[k % 3]
        parts = PARTS[lang].split()
        yield k, " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.choice([3, 30, 300]))), lang


def test_held_out_accuracy_and_odd_rows(table, odd_rows):
    rows = list(texts(300))
    got = L.identify_languages(table([*rows, *((d and -d, t) for d, t in odd_rows)]), per_language=60).collect()
    assert len(got) == 311
    by = {r["doc_id"]: r for r in got}
    out = [d for d, *_ in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(by[d]["held_out"] == (d in out) for d, *_ in rows)
    assert np.mean([by[d]["lang_pred"] == lang for d, _, lang in rows if d in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {by[d]["lang_pred"] for d in (-1, -2, -3)} == {"und"} and by[-5]["lang_pred"] != "und"


def test_without_labels_all_is_undetermined(table, odd_rows):
    got = L.identify_languages(table(odd_rows)).collect()
    assert len(got) == len(odd_rows) and {r["lang_pred"] for r in got} == {"und"}
    assert L.identify_languages(table([])).count() == 0


def test_identified_documents_stay_whole(table, odd_rows):
    docs = table([*texts(120), *((d and -d, t) for d, t in odd_rows)])
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(range(120)) <= set(ids) and not {-1, -2, -3} & set(ids)


def test_chances_equal_a_plain_convolution():
    rng = np.random.default_rng(1)
    net = L.train(rng.integers(0, 256, (20, L.WINDOW)).astype(np.uint8), rng.integers(0, 2, 20), ["x", "y"], steps=3)
    window = rng.integers(0, 256, L.WINDOW).astype(np.uint8)
    hidden = []
    for f in range(net.filters.shape[1]):
        width = L.WIDTHS[f // L.FILTERS]
        kernel = net.filters[:, f].reshape(-1, L.EMBEDDING)
        assert (kernel[width:] == 0).all()
        hidden.append(max(0, net.bias[f] + max(sum(net.embedding[window[at + k]] @ kernel[k] for k in range(width)) for at in range(L.WINDOW - max(L.WIDTHS) + 1))))
    want = L.softmax((np.array(hidden) @ net.out + net.out_bias)[None])
    assert np.allclose(net.chances(window[None]), want, atol=1e-4)


def sound(k):
    return " ".join("".join(random.Random(k * 997 + j).choices(["an", "the", "of", "ing", "er"], k=random.Random(j * k + 1).randint(1, 3))) + (". " if j % 9 == 8 else "") for j in range(80))


def test_quality_finds_kinds_of_junk(table, odd_rows):
    good = [(k, sound(k)) for k in range(1, 201)]  # 0 repeats itself
    bad = [(1000 + k, (sound(k + 1).upper() + "!").replace(" ", "!! ")) for k in range(20)] + [(1100 + k, sound(k + 1).replace(" ", "$$$ %%% ")) for k in range(20)] + [(1200 + k, "over and over again " * 40) for k in range(5)]
    got = {r["doc_id"]: r for r in Q.score_quality(table([*good, *bad, *((d and -d, t) for d, t in odd_rows)])).collect()}
    assert all(got[d]["keep"] for d, _ in good)
    assert sum(not got[d]["keep"] for d, _ in bad) >= 43
    assert all(not got[d]["keep"] and got[d]["score"] == 0 for d in (-1, -2, -3))
    assert Q.score_quality(table([])).count() == 0


def test_estimation_recovers_accuracies():
    """Votes drawn from known chances: the classes and the bad labellers' hit rates come back."""
    rng = np.random.default_rng(0)
    hit = np.array([0.8, 0.6, 0.4, 0.5])
    bad = rng.random(40_000) < 0.15
    v = np.where(bad[:, None] & (rng.random((40_000, 4)) < hit), -1, np.where(rng.random((40_000, 4)) < 0.5, 1, 0))
    patterns, counts = np.unique(Q.pattern(v), return_counts=True)
    good, chance = Q.estimate(patterns, counts, 4)
    assert np.abs(chance[0, :, 0] - hit).max() < 0.1
    label = dict(zip(patterns.tolist(), good, strict=True))
    seen_bad = (v == -1).any(axis=1)
    assert np.mean([label[p] < 0.5 for p in Q.pattern(v[seen_bad]).tolist()]) > 0.99


def test_shapes_equal_plain_counts():
    docs = ["One two two. THREE!! | x", "", "a b a b a b", "é"]
    raw = [d.encode() for d in docs]
    s, _, _ = Q.shape(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    assert s.n_words.tolist() == [6, 0, 6, 1]
    assert np.allclose(s.distinct, [1.0, 0, 1 / 3, 1])
    assert np.allclose(s.distinct_pairs, [1, 0, 2 / 5, 0]) and np.allclose(s.shouts, [2 / 6, 0, 0, 0]) and np.allclose(s.bars, [1 / 6, 0, 0, 0])


def test_samples_do_not_follow_repeated_ids(spark, prose, monkeypatch):
    """Null, zero and repeated ids and a flood of equal rows neither fill the sample nor empty it."""
    from structsim.llm import language_id, quality

    sizes = []
    monkeypatch.setattr(quality, "train", lambda buckets, *rest: sizes.append(len(buckets)))
    texts = [" ".join(prose(30, k)) for k in range(1500)]
    for rows in ([(None, t) for t in texts], [(0, t) for t in texts], [(77, t) for t in texts], [*((k, t) for k, t in enumerate(texts)), *[(None, texts[0])] * 700]):
        quality.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sample=200)
    assert all(50 <= n <= 200 for n in sizes) and len(sizes) == 4
    taken = []
    monkeypatch.setattr(language_id, "train", lambda x, y, languages: taken.append(len(y)))
    for doc in (1, 2, 3, 4, 5, 6):
        language_id.fit(spark.createDataFrame([(doc, t, "xx") for t in texts], "doc_id long, text string, lang string"), per_language=20, per_text=1)
    assert taken and all(10 <= n <= 20 for n in taken)


def test_floods_of_one_row_empty_no_sample(spark, prose):
    """One row many times, alone or beside others, good or bad, with an id or without."""
    schema = "doc_id long, text string"
    good, bad = " ".join(prose(60, 5)), "over and over again " * 40
    flood = lambda text, doc: spark.range(100_000).select(F.lit(doc).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    assert Q.score_quality(flood(good, 7)).where("keep").count() == 100_000
    others = [(k, " ".join(prose(60, k + 10))) for k in range(200)] + [(1000 + k, sound(k + 1).upper()) for k in range(30)]
    beside = spark.createDataFrame(others, schema)
    for text, doc in ((bad, 7), (good, None)):
        got = Q.score_quality(beside.unionByName(flood(text, doc)))
        assert got.where("doc_id < 1000 and doc_id <> 7 and keep").count() >= 195


def test_a_flooded_language_takes_none_of_another(spark):
    rows = [(k, t, lang) for k, t, lang in texts(400) if lang != "cc"]
    flood = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(rows[0][1]).alias("text"), F.lit("aa").alias("lang"))
    one = [(5, "\u044f \u0436 \u044e " * 30, "zz")]
    docs = spark.createDataFrame(rows + one, "doc_id long, text string, lang string").unionByName(flood)
    got = L.identify_languages(docs, per_language=50).where("doc_id <> 1").collect()
    right = {d: lang for d, _, lang in rows}
    assert len(got) == docs.where("doc_id <> 1").count()
    assert np.mean([r["lang_pred"] == right[r["doc_id"]] for r in got if r["doc_id"] in right and r["doc_id"] != 5]) > 0.97
