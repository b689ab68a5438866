"""What is learned comes from every row, not from the first ones by hash."""

import numpy as np

from assayframe.llm import langid, secrets


def test_the_secret_scan_fits_on_every_value(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghjkmnpqrstuvwxyz23456789"), n))
    texts = [f"password = {word(14)}7 and then {word(9)} id9{word(16)} end" for _ in range(150)]
    scanned = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    seen, parts = [], secrets._parts
    monkeypatch.setattr(secrets, "_parts", lambda *a: seen.append(parts(*a)) or seen[0])
    net = secrets.Net(part=60, epochs=4)
    model = secrets.fit(scanned, net)
    rows = [secrets._unpacked(r) for r in seen[0].toPandas().itertuples()]
    bodies = {(c["hit"], c["view"][secrets.LEFT : secrets.LEFT + secrets.BODY]) for r in scanned.collect() for c in r.cands if c["hit"] is not None}
    assert len(rows) > 1 and sum(len(y) for _, y, _ in rows) == len(bodies) >= 300
    score = np.concatenate([model.probability(x[held & (y == 1)]) for x, y, held in rows])
    assert abs(np.sort(score)[int(0.01 * len(score))] - model.threshold) < 1e-9


def test_parts_train_as_one_network(spark):
    """The average over parts depends neither on the order of the parts nor on how many a task holds."""
    rng = np.random.default_rng(5)
    texts = [f"token: {''.join(rng.choice(list('abcdef0123456789'), 20))} near x1{''.join(rng.choice(list('ghkmnp4567'), 15))}" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = secrets.Net(part=30, epochs=2)
    one, two = [secrets.fit(secrets.scan(docs.repartition(n)), net) for n in (1, 5)]
    assert np.array_equal(one.weights(), two.weights()) and one.threshold == two.threshold < np.inf


def test_profiles_count_every_document(spark, monkeypatch):
    monkeypatch.setattr(langid, "COUNT_TEXTS", 3)
    rows = [(i, "aa bb", "xx") for i in range(4_500)] + [(9_000 + i, "qz" * (i % 3 + 1), "yy") for i in range(7)]
    got = {(r.lang, r.code): r.place for r in langid.profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for lang in ("xx", "yy"):
        codes = langid.ranked(np.concatenate([langid.ngrams(t) for _, t, n in rows if n == lang]), langid.N_RANKS)
        assert {c: p for (n, c), p in got.items() if n == lang} == {c: p for p, c in enumerate(codes.tolist())}


def test_one_text_in_many_thousands_counts(spark):
    rows = [(i, "aa", "xx") for i in range(6_000)] + [(7_000 + i, chr(0x3B1 + i), "xx") for i in range(20)]
    codes = {r.code for r in langid.profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {0x3B1 + i + 1 for i in range(20)} <= codes


def test_limits_score_every_document(spark, monkeypatch):
    scored, predict = [], langid.predict
    monkeypatch.setattr(langid, "predict", lambda docs, *a, **k: scored.append(docs) or predict(docs, *a, **k))
    docs = spark.createDataFrame([(i, f"abc{'de' * (i % 5)}", "xx") for i in range(2_500)], "doc_id long, text string, lang string")
    least = langid.limits(docs, langid.profiles(docs)).collect()
    assert scored[0].count() == 2_500 and len(least) == langid.POWERS
