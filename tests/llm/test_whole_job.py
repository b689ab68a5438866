"""Where an operator or a stage once did less than the whole job."""

from collections import defaultdict

import numpy as np
import oracle

import corpus_pipeline
from assayframe.llm import html, mixing


def test_mixture_puts_out_the_words_of_its_targets(spark):
    rng = np.random.default_rng(11)
    lengths = {"a": 30, "b": 400, "c": 400, "d": 30}
    rows = [(i, "w " * int(n), s, i) for s, many in lengths.items() for i, n in enumerate(rng.geometric(1 / 350, many), 1000 * ord(s))]
    rows += [(None, "w " * 300, "c", 1), (None, "w " * 300, "c", 2), (7, "", "b", 3), (8, None, "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    target = {r.source_size: r.target for r in mixing.mixed(docs).collect()}
    size, out, copies = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        size[r[2]] += len((r[1] or "").split())
    for r in corpus_pipeline.mixture(spark, docs, "").collect():
        out[r.source] += len(r.text.split())
        copies[r.doc_id, r.extra] += 1
    for s in size:
        # a source of few documents meets its target up to one of them
        near = 0.01 * target[size[s]] if lengths[s] > 100 else max(len((r[1] or "").split()) for r in rows if r[2] == s)
        assert abs(out[s] - target[size[s]]) <= near, (s, out[s], target[size[s]])
    assert max(copies.values()) <= 2
    assert abs(copies[None, 1] - copies[None, 2]) <= 1


def test_rounding_is_even_and_favours_no_length():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.geometric(1 / 800, 300))[::-1]
    for ratio in (0.1, 0.2, 0.3, 0.4, 0.6, 1.0, 1.4, 1.9):
        taken = np.minimum(2 * sizes, (sizes * ratio + rng.integers(-60, 60, len(sizes))).astype(int).clip(0))
        runs = [mixing.rounded(sizes, taken, start) for start in (np.arange(40) + 0.5) / 40]
        for copies in runs:
            assert ((copies == taken // sizes) | (copies == -(-taken // sizes))).all()
            assert abs((copies * sizes).sum() - taken.sum()) <= 0.01 * sizes.sum()
        mean = np.mean(runs, 0)
        assert abs((mean * sizes)[:30].sum() / taken[:30].sum() - 1) < 0.15


POLISH = """wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem
i powinni postępować wobec innych w duchu braterstwa każdy człowiek posiada wszystkie prawa i wolności bez względu na jakiekolwiek różnice"""


def test_language_stage_rejects_junk_and_other_languages(spark):
    rng = np.random.default_rng(4)
    letters = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(n)) for n in (20, 60, 300)]
    hexes = [" ".join(bytes(rng.integers(0, 256, 16).tolist()).hex() for _ in range(n)) for n in (8, 60, 300)]
    rows = [" ".join(rng.choice(["qwerty", "asdfgh", "zxcvbn", "qwertyuiop", "yxcvb", "poiuz"], n)) for n in (60, 300)]
    junk = [(-1 - i, t, None, "s", 0) for i, t in enumerate([*letters, *hexes, *rows, POLISH, POLISH * 9, "", "123 456"])]
    docs = spark.read.parquet(f"{oracle.ROOT}/sf0.01/documents.parquet")
    short = docs.where("doc_id % 10 = 0").selectExpr("doc_id + 1000000 AS doc_id", "substring_index(text, ' ', 3) AS text", "lang", "source", "n_chars")
    clean = docs.union(short)
    kept = corpus_pipeline.language(spark, clean.union(spark.createDataFrame(junk, docs.schema)), "")
    assert [r.text[:40] for r in kept.where("doc_id < 0").collect()] == []
    assert [r.text[:40] for r in docs.join(kept, "doc_id", "left_anti").collect()] == []
    assert short.join(kept, "doc_id", "left_semi").count() >= 0.98 * short.count()


def test_html_near_copies_keep_their_article(spark):
    rng = np.random.default_rng(8)
    said = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    page = "<body><div class=top>Welcome to the site</div><article{mark}>{text}<div class=inner>Share this</div></article></body>"
    told = [said(40) for _ in range(4)]
    copy = "".join(f"<p>{t}</p>" for t in told)
    want, rows = {}, []
    for i in range(30):
        if i < 6:  # near copies under a mark of their own, among other pages
            host, mark, text = "blog.example", " id=post-7", f"<p>Views: {i}</p>" + copy
            want[i] = "\n\n".join([f"Views: {i}", *told, "Share this"])
        elif i < 16:
            host, mark, own = "blog.example", f" id=post-{i + 10}", said(60)
            text, want[i] = f"<p>{own}</p>", f"{own}\n\nShare this"
        elif i < 22:  # nothing but near copies
            host, mark, text = "copies.example", "", f"<p>Printed on day {i}</p>" + copy
            want[i] = "\n\n".join([f"Printed on day {i}", *told, "Share this"])
        else:  # articles that differ: what they share is the template
            host, mark, own = "other.example", "", said(60)
            text, want[i] = f"<p>{own}</p>", own
        rows.append((i, f"http://{host}/{i}", page.format(mark=mark, text=text)))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_components_write_no_round_that_changes_nothing(spark, monkeypatch):
    import random

    from assayframe.llm import neardup

    written = []
    plain = neardup.settle
    monkeypatch.setattr(neardup, "settle", lambda df, label: written.append(label) or plain(df, label))
    stars = spark.createDataFrame([(5, 1), (1, 7), (5, 1), (9, 8), (3, 3)], "a long, b long")
    assert sorted(tuple(r) for r in neardup.components(stars).collect()) == [(5, 1), (7, 1), (9, 8)]
    assert len(written) == 1  # links that are stars need no round
    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 130)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for x, y in pairs:
            label[x] = label[y] = min(label[x], label[y])
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: m for n, m in label.items() if n != m}
