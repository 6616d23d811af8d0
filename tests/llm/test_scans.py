"""Licence scans, toxicity and language identification: brute force and held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pytest

from sluice.llm import language_id, license_scan, toxicity


def test_licences_against_a_word_scan(docs, spark):
    from pyspark.sql import functions as F

    extra = spark.createDataFrame([(50_000, "MIT License mit license"), (50_001, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"), (50_002, "the general public  License, and an Apache\nlicense")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    got = license_scan.scan(rows).withColumn("text", F.lit(None)).collect()
    plain = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got}
    want = set()
    for r in rows.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        hits = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        want.add((r.doc_id, len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))))
    assert plain == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[50_001].labels == "bsd" and by_id[50_001].score == 1.0 and by_id[50_002].labels == "apache,gpl"
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert license_scan.scan(rows.where("false")).collect() == []


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(50):
        texts = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        automaton = license_scan.SuffixAutomaton(texts)
        query = [rng.randrange(3) for _ in range(20)]
        for i, (state, length) in enumerate(automaton.statistics(query)):
            best = max((n for n in range(i + 2) if any(query[i + 1 - n : i + 1] == t[j : j + n] for t in texts for j in range(len(t) - n + 1))), default=0)
            assert length == best
            found = query[i + 1 - length : i + 1]
            ends = {(k, j + length - 1) for k, t in enumerate(texts) for j in range(len(t) - length + 1) if t[j : j + length] == found}
            if length:
                assert ends == {(k, p) for k, places in automaton.ends[state].items() for p in places}


def test_a_changed_template_is_still_covered():
    scanner = license_scan.Scanner()
    text = license_scan.TEMPLATES[1][1].replace("free of charge", "without any charge")
    labels = scanner.scan(text.encode())[5]
    assert labels == "mit" and scanner.scan(b"permission of the software")[5] == ""


def brute_segments(w):
    """Maximal segments by their recursive definition: the best one, then those left and right of it."""
    def find(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = sum(w[i:j])
                if s > 1e-12 and (best is None or s > best[0] + 1e-12):
                    best = (s, i, j)
        return [] if best is None else find(a, best[1]) + [(best[1], best[2] - 1, best[0])] + find(best[2], b)

    return find(0, len(w))


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(6)
    for _ in range(200):
        w = rng.normal(-0.3, 1, rng.integers(0, 14))
        got, want = toxicity.maximal_segments(w), brute_segments(w.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity_on_held_out_rows(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    assert np.mean(np.array(toxic) >= 0.5) > 0.7 and np.mean(np.array(clean) >= 0.5) < 0.03
    assert np.mean([a > b for a in toxic for b in clean[:200]]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, none).collect()
    assert len(rows) == docs.count() and all(r.predicted == 0 and 0 <= r.score < 0.01 for r in rows)
    one = spark.createDataFrame([(r.doc_id, 0) for r in docs.select("doc_id").collect()] + [(None, 1), (10_001, None)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity.score(docs, one).collect())
    assert toxicity.score(empty, one).collect() == []


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.02
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)


def test_language_of_odd_texts(docs, empty):
    rows = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for i in (10_001, 10_002, 10_003, 10_008):
        text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}[i]
        assert (rows[i].lang_pred == "und") == (not text or not any(map(str.isalpha, text)))
    assert language_id.identify(empty).collect() == []
    from pyspark.sql import functions as F

    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


@pytest.mark.parametrize("text", ["", "x", "é" * 5, "12 34"])
def test_short_texts_have_vectors(text):
    assert language_id.trigram_counts(text).shape == (language_id.BUCKETS,)


def test_every_language_is_learned(spark):
    rng = random.Random(8)

    def text(k):
        letters = [chr(97 + (7 * k + 5 * i * (k // 26 + 1)) % 26) for i in range(5)]
        return " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(40))

    rows = [(text(k), f"l{k:02d}") for k in range(70) for _ in range(3)]
    few = [text(71) for _ in range(5)]
    rows += [(t, "copies") for t in few for _ in range(4000)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == sorted({lang for _, lang in rows})
    assert {model.predict([t])[0][0] for t in few} == {"copies"}


def test_a_language_gives_its_sample(spark, monkeypatch):
    seen = []
    clusters = language_id._clusters
    monkeypatch.setattr(language_id, "_clusters", lambda x, k: seen.append(len(x)) or clusters(x, k))
    rows = [(f"some text number {chr(97 + i % 26)}{chr(97 + i // 26)} here", "aa") for i in range(300)] + [(f"other {chr(97 + i)}", "bb") for i in range(9)] * 200
    language_id.train(spark.createDataFrame(rows, "text string, lang string"), sample=40)
    assert seen == [40, 9]


def test_log_odds_use_every_label(spark, monkeypatch):
    rng, seen = random.Random(14), []
    cast = toxicity.text_model
    monkeypatch.setattr(toxicity, "text_model", lambda model: seen.append(model) or cast(model))
    usual = [f"w{i}" for i in range(400)]
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in range(3000)}
    toxic = {k: [i for i in fold if fold[i] == k][:8] for k in (1, 2)}  # each word stands in rows of one fold alone
    word = {i: f" zzq{k}" for k, ids in toxic.items() for i in ids}
    rows = [(i, " ".join(rng.sample(usual, 30)) + word.get(i, ""), int(i in word)) for i in fold]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    toxicity.score(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    assert seen[0].word(b"zzq1") > 0 and seen[0].word(b"zzq2") > 0 and {b"zzq1", b"zzq2"} <= seen[0].weights.keys()


def test_the_scale_is_that_of_all_distinct_clean_texts(spark):
    model = toxicity.Model({b"bad": (3.0, 20.0), b"good": (-2.0, 20.0)})
    long = "bad " * 6_000 + "good " * 9_000
    rows = ["good bad good word", long] + ["good good good bad"] * 700
    toxicity._set_scales([model], spark.createDataFrame([(t.encode(),) for t in rows], "text binary"))
    words = [w for t in set(rows) for w in t.split()]
    assert abs(np.mean([np.exp(model.scale * model.word(w.encode())) for w in words]) - 1) < 1e-3
    assert toxicity._scale({}) == 1.0


def test_licences_take_linear_time():
    scanner = license_scan.Scanner()
    assert scanner.scan(b"All rights reserved. " * 100_000)[5] == "all-rights-reserved"


def test_whole_licences_have_their_own_label():
    scanner = license_scan.Scanner()
    for label, text in license_scan.TEMPLATES:
        found = scanner.scan(f"// file header\n{text}\nint main".encode())
        assert label in found[5].split(",") and set(found[5].split(",")) <= {label, *found[4].split(",")}, label


def brute_chains(scanner, words):
    """Labels by the definition: every set of maximal matches, in order along a template, that covers enough."""
    labels = set()
    for label, text in license_scan.TEMPLATES:
        template = license_scan.words_of(text.encode())
        table = [[0] * (len(template) + 1) for _ in range(len(words) + 1)]  # longest common run that ends here
        for i, w in enumerate(words):
            for j, x in enumerate(template):
                if w == x:
                    table[i + 1][j + 1] = table[i][j] + 1
        if max(max(row) for row in table) >= license_scan.COVER * len(template):
            labels.add(label)
    return labels


def test_labels_of_whole_matches_against_brute_force():
    rng, scanner = random.Random(23), license_scan.Scanner()
    for label, text in license_scan.TEMPLATES[:13]:
        noise = [f"n{rng.randrange(50)}" for _ in range(40)]
        whole = " ".join([*noise[:20], text, *noise[20:]])
        got = set(scanner.scan(whole.encode())[5].split(","))
        assert label in got and got <= brute_chains(scanner, license_scan.words_of(whole.encode()))
    assert scanner.scan(b"some words of nothing at all")[5] == ""


def test_toxicity_against_a_sequential_model(spark):
    """Log-odds, segments and scores again, without Spark and one row at a time."""
    rng = random.Random(19)
    usual = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*rng.sample(usual, 20), *(["zzbad"] if i % 6 == 0 else [])]), int(i % 6 == 0)) for i in range(900)]
    df = spark.createDataFrame([(t.encode(), y) for _, t, y in rows], "text binary, toxic int")
    model = toxicity.fit(df)
    counts, n = {}, [sum(y == k for *_, y in rows) for k in (0, 1)]
    for _, t, y in rows:
        for f in {f for w in set(t.encode().split()) for f in toxicity.features(w)}:
            counts.setdefault(f, [0, 0])[y] += 1
    for f, (clean, toxic) in counts.items():
        prior = toxicity.PRIOR * (clean + toxic) / sum(n)
        odds = [np.log(c + prior + 0.01) - np.log(max(k + toxicity.PRIOR - c - prior, 0.5)) for c, k in ((clean, n[0]), (toxic, n[1]))]
        ratio = 2 * sum(c * np.log(c / ((clean + toxic) * k / sum(n))) for c, k in ((clean, n[0]), (toxic, n[1])) if c)
        if clean + toxic >= toxicity.LEAST_TEXTS and ratio >= toxicity.LEAST_RATIO:
            assert model.weights[f] == pytest.approx((odds[1] - odds[0], ratio))
        else:
            assert f not in model.weights
    for _, t, _ in rows[:20]:
        weights, seen = [], {}
        for w in t.encode().split():
            known = [model.weights[f] for f in toxicity.features(w) if f in model.weights]
            odds = max(-toxicity.CLIP, min(toxicity.CLIP, max(known, key=lambda x: x[1])[0])) if known else 0.0
            value = odds - toxicity.DRIFT
            if value > 0:
                value = odds * 0.5 ** seen.get(w, 0) - toxicity.DRIFT
                seen[w] = seen.get(w, 0) + 1
            weights.append(value)
        scores = [model.scale * s for *_, s in brute_segments(weights)]
        want = np.log(sum(np.exp(s) for s in scores) or 1.0) - np.log(len(weights))
        assert model.evidence(*model.segments(t.encode())) == pytest.approx(want)


def test_copies_do_not_fill_the_calibration(spark, monkeypatch):
    seen = []
    fitted = toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y: seen.append(len(x)) or fitted(x, y))
    rows = [("same text each time", 0)] * 5000 + [(f"text w{i}", i % 2) for i in range(400)]
    toxicity.fit(spark.createDataFrame([(t.encode(), y) for t, y in rows], "text binary, toxic int"))
    assert 60 <= seen[0] <= 140


def test_nearest_centroid_against_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs.select("text", "lang"))
    for r in docs.limit(60).collect():
        v = np.sqrt(language_id.trigram_counts(r.text)) * model.idf
        cos = [float(v @ c / (np.linalg.norm(v) * np.linalg.norm(c))) for c in model.centroids]
        lang, score, rejected = (x[0] for x in model.predict([r.text]))
        assert lang == model.languages[model.owner[int(np.argmax(cos))]] and score == pytest.approx(max(cos), abs=1e-4)
        assert rejected == (max(cos) < language_id.REJECT * min(1.0, (len(r.text) / 400) ** 0.5) * model.usual[int(np.argmax(cos))])
