"""The training-data operators against brute force, and on nulls, ties, repeated rows, empty tables and odd columns."""

import contextlib
import gzip
import hashlib
import os
import re
import string
import threading
import time
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidewright.llm import common, decontaminate, exact_dedup, graph, html_extract, jaccard_join, kernels, packing, quality, sharding, substring_dedup, url_filter, warc
from tidewright.llm.common import key_filter, may_contain, settled, spread_join, stage, without

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORDS = [f"w{i}" for i in range(400)]


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None, "digest", None) for i, t in enumerate(texts)], DOCS)


def local(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    pick = [rel.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[i] for i in pick)) for r in rel.fetchall())


# Shared parts


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    rows = spark.range(0, 3000).crossJoin(F.broadcast(key_filter(keys, "k", 8))).select("id", may_contain(F.col("bits"), F.col("id"), 8).alias("m")).collect()
    assert all(r["m"] for r in rows if r["id"] % 3 == 0) and sum(r["m"] for r in rows if r["id"] % 3) < 200
    none = spark.range(10).crossJoin(key_filter(keys.filter("false"), "k", 8)).filter(may_contain(F.col("bits"), F.col("id"), 8))
    assert none.count() == 0


def test_scoring_takes_little_memory_beside_the_texts():
    import tracemalloc

    texts = pa.array([" ".join(f"w{(i * 7919 + j * 31) % 5003}" for j in range(500)) for i in range(2000)])  # over 5 MB
    model = quality.Ordinal(20, np.ones(1 << 20, dtype=np.float32), np.array([0.0, 1.0]))
    tracemalloc.start()
    score = model.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6, peak
    assert np.array_equal(score[::500], np.concatenate([model.score(texts[i : i + 1]) for i in range(0, 2000, 500)]))  # whatever runs it lies in


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 101), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == got[105] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_joins_of_hot_keys(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    keys = stage(rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("m"), F.max("id").alias("top")).filter("k <> 8"), "keys")
    want = {how: sorted(map(str, rows.join(keys, "k", how).select("k", "id", "top").collect())) for how in ("inner", "left")}
    for how, share in product(("inner", "left"), (1, 4, 100, 4096)):
        assert sorted(map(str, spread_join(rows, keys, "k", "m", 2000, how, share).select("k", "id", "top").collect())) == want[how]


def test_rows_without_lost_keys(spark):
    docs = spark.range(500).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("bits"))
    lost = spark.range(0, 500, 2).withColumnRenamed("id", "gone")
    left = without(docs, lost, docs["doc_id"], "gone")
    assert left.columns == docs.columns and Counter(r["doc_id"] for r in left.collect()) == Counter(i if i % 7 else None for i in range(500) if i % 2 or i % 7 == 0)


def test_words_and_shingles_by_hand():
    texts = ["A b  c\td e f", None, "", "x y", "é È É a", "a b c d e f a b c d e"]
    for first, data, offsets in kernels.parts(pa.array(texts), most=10):
        h, t, s, e = kernels.words(data, offsets, kernels.WHITE)
        for i in range(len(offsets) - 1):
            want = re.findall(r"[^\x20\x09-\x0D]+", (texts[first + i] or "").translate(LOW))
            own = np.flatnonzero(t == i)
            assert [bytes(data[a:b]).decode().translate(LOW) for a, b in zip(s[own], e[own], strict=True)] == want
            at, g = kernels.shingles(h, t, len(offsets) - 1, 5)
            n = len({tuple(want[j : j + 5]) for j in range(max(1, len(want) - 4))}) if want else 0
            assert (at == i).sum() == n
    one = [h for _, d, o in kernels.parts(pa.array(["Word word WORD"])) for h in kernels.words(d, o, kernels.MARKS)[0].tolist()]
    assert len(set(one)) == 1


# 1


def test_html(spark):
    page = """<!DOCTYPE html><body class="has-sidebar"><header><p>Site</p></header><nav><ul><li><a href=/a>Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this site to make it better for all of you every day.</p></div>
    <article><h1>Caf&eacute; &#x26; more</h1><p>First   <b>para</b>graph with <a href="x>y">a link</a>.<p>Second<br>line&nbsp;here.<script>var a="</p>";</script>
    <aside class=ad>Buy now</aside><p>One.</p></article><section id="comments"><p>I think this is a long reader comment about the article above.</p></section>
    <form><p>Write to us</p><textarea>x</textarea></form><footer>&copy; us</footer><!-- <p>no</p> -->"""
    assert html_extract.main_text(page) == "Café & more\n\nFirst paragraph with a link.\n\nSecond line here.\n\nOne."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") == ""
    assert html_extract.main_text("<article><p>a<p title='x") == "a"  # a tag cut off by the end
    assert html_extract.main_text('<article><p>a<p title="x>b') == "a\n\nb"  # a quote that never ends
    assert html_extract.main_text("<article><p>1 < 2 & 3</p></article>") == "1 < 2 & 3"
    long = "<article>" + "<p>w w w.</p>" * 20_000 + '<a "' * 2000
    assert len(html_extract.main_text(long)) == 20_000 * 8 - 2
    df = spark.createDataFrame([(1, None, page, 1), (1, "u", None, 2)], "page_id long, url string, html string, text int")
    got = df.select("page_id", html_extract.extract(F.col("html")).alias("t")).collect()
    assert got[0]["t"].startswith("Café") and got[1]["t"] == ""


@pytest.mark.parametrize("size", [10, 1900, 5000, 200_000])
def test_html_long_attributes(size):
    """What a container is may be said behind a long attribute."""
    data = f'data-x="{"{a:1}" * (size // 5)}"'
    advert = "<p>We sell many good things here every day, and you may buy all of them from us now.</p>"
    for says in ('class="advert"', 'id="sidebar"', 'role="complementary"', "hidden", 'aria-hidden="true"'):
        page = f"<article><p>This is the first line of the article.</p><div {data} {says}>{advert}</div><p>This is its last line.</p></article>"
        assert html_extract.main_text(page) == "This is the first line of the article.\n\nThis is its last line."
    main, boiler, hint = (html_extract.FEATURES.index(x) for x in ("in_main", "in_boiler", "hint"))
    assert html_extract.blocks(f'<div {data} class="article-body"><p>x</p></div>')[0][1][main] == 1.0
    inside = html_extract.blocks(f"<div {data} data-y='{{&quot;hidden&quot;: 1, hidden class=ad}}'><p>x</p></div>")
    assert inside[0][1][boiler] == inside[0][1][hint] == 0.0  # what a value says of others is no attribute


def test_html_without_marks():
    """Pages whose markup says nothing, and class words that mean nothing."""
    say = "The committee met on Tuesday to discuss the plan for the new bridge over the river, which has been late for three years by now."
    more = [f"{say} {x}" for x in ("First of all.", "Then again.", "Last of all.")]
    text = html_extract.main_text
    assert text(f"<html><body><p>{say}</p></body></html>") == say
    assert text(f"<body><h1>New bridge planned</h1><p>{say}</p></body>") == f"New bridge planned\n\n{say}"
    assert text("<body><h1>New bridge planned</h1>" + "".join(f"<p>{x}</p>" for x in more) + "</body>") == "\n\n".join(["New bridge planned", *more])
    price, results = "The share price rose by three percent on Monday after the news.", "The results show that this is the case in most of the samples that we took."
    inside = f'<body><article><h1>Title</h1><p>{say}</p><div class="share-price"><p>{price}</p></div><section id="discussion"><p>{results}</p></section></article></body>'
    assert text(inside) == "\n\n".join(["Title", say, price, results])
    boxes = f"<body><div><p>{more[0]}</p><p>{more[1]}</p></div><div><p>I do not agree with this.</p></div><div>Copyright 2020 Example</div></body>"
    assert text(boxes) == f"{more[0]}\n\n{more[1]}"
    menu = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(5))
    assert text(f"<body><div><ul>{menu}</ul></div><div><h1>Bridge</h1><p>{say}</p><p>Short one.</p><p>{more[0]}</p></div><div>Copyright 2020 Example</div></body>") == "\n\n".join(["Bridge", say, "Short one.", more[0]])
    assert text(f'<article><p>{say}</p><section class="comments"><p>{more[1]}</p></section></article>') == say


def test_html_tree_splits_on_words_and_links():
    """The first levels look at words and links of a block and its neighbours; own word counts decide some branch."""
    names: list[list[str]] = []

    def walk(tree, level=0):
        if isinstance(tree, tuple):
            names.extend([] for _ in range(level + 1 - len(names)))
            names[level].append(html_extract.FEATURES[tree[0]])
            walk(tree[2], level + 1)
            walk(tree[3], level + 1)

    walk(html_extract.trained())
    first = {x for level in names[:3] for x in level}
    assert first <= set(html_extract.FEATURES[:6]) and "words" in first and "hint" not in first
    print("\n".join(f"level {i}: {Counter(x)}" for i, x in enumerate(names)))


def test_html_tags_are_not_kept_for_ever():
    for i in range(20_000):
        html_extract.blocks(f'<p class="c{i}"><a href="/{i}" class="x">a</a></p>')
    assert html_extract._short_kind.cache_info().currsize <= 4096


def test_html_tree_holds_out():
    tree = html_extract.trained()
    right = total = 0
    for page, labels in html_extract.labelled_pages(60, seed=99):
        for text, f in html_extract.blocks(page):
            if text in labels:
                right += html_extract.classify(tree, f) == bool(labels[text])
                total += 1
    assert right / total > 0.95


def test_html_of_the_tables():
    tree = html_extract.trained()
    for _, _, page in local("pages"):
        body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        blocks = (" ".join(html_extract._html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert html_extract.main_text(page, tree) == "\n\n".join(x for x in blocks if x)


# 2


def test_shards(spark):
    texts = ["x" * n for n in (0, 5, 10, 40, 7, 9, 30, 3)] * 4 + [None]
    got = sharding.sharded(documents(spark, texts), 50).collect()
    assert len(got) == len(texts)
    held = defaultdict(int)
    for r in got:
        held[r["shard"]] += r["n_bytes"]
    assert all(v <= 50 for v in held.values()) and all(r["shard_bytes"] == held[r["shard"]] for r in got)
    names = sorted(held)
    assert not any(b.startswith(a) for a in names for b in names if a != b)
    hot = sharding.sharded(spark.createDataFrame([("k", "x" * 10)] * 20 + [(None, "y" * 99), (None, "z")], "doc_id string, text string"), 50, step=30).collect()
    held = Counter()
    for r in hot:
        held[r["shard"]] += r["n_bytes"]
    assert len(hot) == 22 and sorted(v for v in held.values() if v > 50) == [99]
    assert sharding.sharded(documents(spark, []), 50).count() == 0


def test_written_shards(spark, tmp_path):
    docs = documents(spark, ["x" * 30] * 12)
    sharding.write_shards(docs, str(tmp_path / "s"), 100)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 12 and all(r["count"] <= 3 for r in back.groupBy("shard").count().collect())


# 3


def test_exact_with_colliding_digests(spark):
    texts = ["a", "b", "a", None, "", "b", "c", "a " * 5000]
    docs = documents(spark, texts)
    weak = lambda t: F.unhex(F.lpad(F.hex(F.pmod(F.length(t), F.lit(2)).cast("long")), 2, "0"))
    for digest in (exact_dedup.sha256, weak):
        for keep, best in (("largest", max), ("smallest", min)):
            got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs, keep=keep, digest=digest).collect()}
            same = defaultdict(list)
            for i, t in enumerate(texts):
                same[t or ""].append(i)
            assert got == {i: (best(g), len(g), i == best(g)) for g in same.values() for i in g}


def test_exact_nulls_repeats_and_levels(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, "z"), (1, "q"), (0, "q"), (2, "q")], "doc_id long, text string")
    got = sorted((str(r["id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect())
    assert got == sorted([("None", "1", 3, False), ("1", "1", 3, True), ("1", "1", 3, True), ("None", "None", 1, True), ("1", "2", 3, False), ("0", "2", 3, False), ("2", "2", 3, True)])
    left = sorted((str(r["doc_id"]), r["text"]) for r in exact_dedup.drop_exact_duplicates(docs).collect())
    assert left == [("1", "a"), ("2", "q"), ("None", "z")]
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0
    index = exact_dedup.DigestIndex(spark, "smallest", fanout=2)
    for first in (5, 3, 9, 1):
        hits = index.flush(spark.createDataFrame([(bytearray(b"x"), first), (bytearray([first]), first)], "digest binary, id long"))
        assert hits.count() == (first != 5)  # looked up in the runs before
    assert len(index.levels[0]) == 0 and len(index.levels) == 3
    assert index.merged().filter(F.col("digest") == F.lit(b"x")).first()["id"] == 1


# 4


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    own, plain = packing.encoder(path), Tokenizer.from_file(path)
    odd = ["a  b", "  x", " x", "x ", "a \n b", "a\n\n b  \n c", "\n", "", None, "a\t b", "é  ñ  x", "don't 'll  <|endoftext|> z", "x" * 300 + "  y", "a\x1c b", "a\u00a0 b", "z\u2003 \u2003y"]
    odd += ["hi <|endoftext|> there", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext |> c", "a   b", "x\n y", "\n\n y", "Ġa Ġb", "a\u0120 b", "s 's 'S it's", "1 22 333 é1"]
    texts = odd + [r[1] for r in local("documents")] + ["word " * 50_000, "x" * 30_000]
    assert own.fast is not None
    for t in texts:
        assert own.encode(t).tolist() == plain.encode(t or "", add_special_tokens=False).ids
    other = packing.Encoder(packing.tokenizer_path("word_bpe_49k.json"))  # of another kind: the file's own encoder
    assert other.fast is None and other.encode("Two words").tolist() == other.whole.encode("Two words", add_special_tokens=False).ids


def test_configurations_cover_and_fit():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 101, 3000), np.full(500, 100), np.full(300, 51), np.clip(rng.lognormal(3, 1, 5000).astype(int), 1, 100)):
        histogram = dict(Counter(sizes.tolist()))
        mass, bound = packing.solve(histogram, 100)
        used = packing.rounded(histogram, mass, 100)
        held = Counter()
        for config, n in used.items():
            assert sum(config) <= 100
            for x in config:
                held[x] += n
        assert held == Counter(histogram)
        # 51s can't share a sequence: no bound by volume reaches their number, one by prices does
        assert bound <= sum(used.values()) + 1e-6 and sum(used.values()) <= 1.05 * max(bound, 300 if set(histogram) == {51} else 0) + 1
        assert sum(used.values()) <= 1.01 * sum(packing.best_fit(histogram, 100).values())
    assert packing.rounded({}, packing.solve({})[0]) == Counter()


def test_packed_pieces(spark):
    texts = [None, "", "word " * 3000, "a b c", "a b c"] + ["tok " * n for n in range(1, 200, 7)]
    docs = documents(spark, texts).unionByName(spark.createDataFrame([(None, "a b c", None, None, None)], DOCS))
    got = packing.pack(docs, per_salt=3).collect()
    own = packing.encoder(packing.tokenizer_path()).whole
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)} | {None: [*own.encode("a b c").ids, 0]}
    seats = defaultdict(list)
    for r in got:
        part = ids[r["id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["crc"]
        seats[r["sequence"]].append((r["offset"], r["length"]))
    assert Counter(r["id"] for r in got) == Counter({i: -(-len(x) // 2048) for i, x in ids.items()})
    for s in seats.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(documents(spark, [])).count() == 0


# 5


def test_classifier_held_out(spark):
    rng = np.random.default_rng(3)
    bad, junk, texts, grades = ["foul", "vile"], ["%%%", "###"], [], []
    for i in range(600):
        ws = [f"u{j}" for j in rng.integers(0, 20_000, 60)]
        g = i % 3
        if g == 0:
            ws.insert(int(rng.integers(0, 60)), bad[i % 2])
        if g == 1:
            ws = [w + junk[i % 2] for w in ws]
        texts.append(" ".join(ws))
        grades.append(g)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 0 if g == 1 else 1, int(g == 0)) for i, g in enumerate(grades) if i < 450] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, quality.graded(labels))
    tails = model.tails(model.score(pa.array(texts[450:])))
    assert (tails[:, 1] <= tails[:, 0]).all() and list(model.thresholds) == sorted(model.thresholds)
    kept, truth = tails[:, 1] >= 0.5, np.array(grades[450:]) == 2
    assert (kept == truth).mean() > 0.95
    left = quality.keep_good(docs.withColumn("__score", F.lit(1)), labels)
    assert left.columns == [*docs.columns, "__score"] and abs(left.count() - 200) < 30
    assert quality.keep_good(docs, labels.filter("false")).count() == 600
    assert quality.keep_good(documents(spark, []), labels).count() == 0
    assert quality.keep_good(documents(spark, [None, "", "x " * 50_000]), labels.filter("false")).count() == 3


def test_cumulative_link_against_brute_force():
    """Probabilities and slopes against differences of the log likelihood; scores against sums over hashed words; ties."""
    theta = np.array([-np.inf, -1.0, 0.7, np.inf])
    sig = lambda x: 1 / (1 + np.exp(-x))

    def like(s, y, t):
        return (1.0 if y == 0 else sig(s - t[y])) - (0.0 if y == 2 else sig(s - t[y + 1]))

    for s in (-3.0, -1.0, 0.0, 0.4, 2.5):
        assert sum(like(s, y, theta) for y in range(3)) == pytest.approx(1)
        for y in range(3):
            p, low, high = quality.grade_slopes(s, y, theta)
            assert p == pytest.approx(like(s, y, theta))
            h = 1e-6
            assert low - high == pytest.approx((np.log(like(s + h, y, theta)) - np.log(like(s - h, y, theta))) / (2 * h), abs=1e-5)
            for k, slope in ((y, -low), (y + 1, high)):  # by the thresholds
                if 0 < k < 3:
                    up, down = theta.copy(), theta.copy()
                    up[k], down[k] = up[k] + h, down[k] - h
                    assert slope == pytest.approx((np.log(like(s, y, up)) - np.log(like(s, y, down))) / (2 * h), abs=1e-5)
    rng = np.random.default_rng(0)
    model = quality.Ordinal(10, rng.standard_normal(1 << 10).astype(np.float32), theta[1:-1])
    texts = [None, "", "a b a", "a b a", "x " * 5000, "é | # $", "Word word"]
    got = model.score(pa.array(texts))
    for first, row, feature in quality.features(pa.array(texts), 10):
        for i in range(len(texts)):
            assert got[first + i] == pytest.approx(sum(float(model.weights[f]) for f in set(feature[row == i].tolist())), abs=1e-5)
    assert got[0] == got[1] and got[2] == got[3]
    tails = model.tails(got)
    assert np.allclose(tails, 1 / (1 + np.exp(theta[1:-1][None, :] - got[:, None]))) and (tails[:, 0] >= tails[:, 1]).all()


def test_classifier_of_odd_labels(spark):
    docs = spark.createDataFrame([(1, "good text here", "x"), (1, "other text", "y"), (2, None, "z"), (3, "", "w"), (None, "t", "v")], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1), (9, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["id"]: r["grade"] for r in quality.graded(labels).collect()} == {1: 1, 9: 2, 3: 2}  # the lowest of several
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 5
    assert quality.keep_good(docs, labels.filter("false")).count() == 5


# 6


def brute_components(texts, k=5, threshold=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_copies(seed, groups=6, copies=9, edits=4):
    rng = np.random.default_rng(seed)
    texts = [None, "", "  ", "One two", "one TWO", "one two three", "solo"]
    for _ in range(groups):
        base = [WORDS[j] for j in rng.integers(0, 400, int(rng.integers(20, 120)))]
        for c in range(copies):
            own = base.copy()
            for _ in range(int(rng.integers(0, edits)) if c else 0):
                own[int(rng.integers(0, len(own)))] = f"new{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_against_brute_force(spark, seed):
    texts = near_copies(seed, edits=2 + 2 * seed)
    n, root = brute_components(texts)
    got = {r["id"]: (r["n"], r["component"]) for r in jaccard_join.jaccard_components(documents(spark, texts), per_fragment=(4_000_000, 500, 70)[seed - 1]).collect()}
    assert got == {i: (n[i], root[i]) for i in range(len(texts))}


def test_jaccard_identifiers(spark):
    same = "a b c d e f g h"
    docs = spark.createDataFrame([(None, same), (4, same), (9, same), (9, "other words than those before it here"), (7, "other words than those before it here"), (1, None)], "doc_id long, text string")
    got = sorted((str(r["id"]), str(r["component"])) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == sorted([("None", "None"), ("4", "4"), ("9", "4"), ("9", "4"), ("7", "4"), ("1", "1")])
    assert jaccard_join.jaccard_components(documents(spark, [])).count() == 0
    left = jaccard_join.one_of_each(documents(spark, [same, same + " x", "q", None]), threshold=60)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2, 3]


# 7


def brute_hits(text, items, window=10):
    cut = lambda t: re.findall(decontaminate.WORD, (t or "").translate(LOW))
    w, hit, found = cut(text), set(), set()
    for i, t in items:
        iw = cut(t)
        m = min(window, len(iw))
        spans = {tuple(iw[j : j + m]) for j in range(len(iw) - m + 1)} if iw else set()
        for j in range(len(w) - m + 1):
            if m and tuple(w[j : j + m]) in spans:
                hit |= set(range(j, j + m))
                found.add(i)
    return len(w), len(hit), sorted(map(str, found))


def test_winnowing_against_brute_force(spark):
    rng = np.random.default_rng(4)
    say = lambda k, top=400: " ".join(WORDS[j] for j in rng.integers(0, top, k))
    items = [(i, say(int(rng.integers(10, 40)))) for i in range(12)] + [(20, "w1 w2 w3"), (21, "W7"), (22, ""), (23, None), (24, "w1 w2 w3"), (25, say(9)), (2, say(15))]
    texts = [None, "", "W7!", "x W1, w2-w3 y"]
    for i in range(40):
        item = (items[i % 12][1] or "").split()
        lo = int(rng.integers(0, max(1, len(item) - 9)))
        texts.append(f"{say(int(rng.integers(0, 80)), 30)} {' '.join(item[lo : lo + int(rng.integers(8, 13))])}. {say(int(rng.integers(0, 60)), 30)}")
    got = {r["id"]: (r["n_words"], r["n_hit"], sorted(r["item_ids"])) for r in decontaminate.contamination(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    assert sum(1 for v in got.values() if v[1]) > 20
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents(spark, texts), empty).filter("n_hit > 0").count() == 0
    docs = documents(spark, [texts[5], texts[5], "clean", None]).unionByName(spark.createDataFrame([(None, "W7", None, None, None)], DOCS))
    bench = spark.createDataFrame([*items, (None, "w399 w398")], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in decontaminate.drop_contaminated(docs, bench).collect()) == ["2", "3"]


# 8


def test_chain_and_align():
    assert substring_dedup.chain([0, 10, 20, 30, 500], [100, 110, 119, 400, 131], [8] * 5, 4, 0.1)[0] == [(0, 100, 8), (10, 110, 8), (20, 119, 8)]
    assert substring_dedup.chain([0, 7, 9], [0, 9, 40], [9, 10, 2], 4, 0.1)[0] == [(0, 0, 9), (9, 11, 8)]  # an overlap is cut off
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10**9, 12)
    equal, of_x, of_y = substring_dedup.side_by_side(x, np.concatenate([x[:5], x[8:]]))  # three words left out
    assert equal.sum() == 9 and of_x.sum() == 12 and of_y.sum() == 9 and not (equal & ~(of_x & of_y)).any()
    assert substring_dedup.side_by_side(x, np.array([7]))[0].sum() == 0
    e = np.ones(200, bool)
    e[[60, 61, 62, 63, *range(100, 140)]] = False
    assert sorted(substring_dedup.stretches(e, 50, 0.8)) == [(0, 100), (140, 200)]
    assert substring_dedup.stretches(np.arange(50) % 5 > 0, 50, 0.8) == [(0, 50)] and substring_dedup.stretches(np.arange(50) % 4 > 0, 50, 0.8) == []
    tree = substring_dedup.Fenwick(4)
    tree.raise_(2, 5.0, 9)
    assert tree.before(2)[1] == -1 and tree.before(3) == (5.0, 9)


def test_passages_against_brute_force(spark):
    rng = np.random.default_rng(6)
    say = lambda k: [f"u{j}" for j in rng.integers(0, 10**6, k)]
    shared = [say(60), say(90), say(55)]
    fuzzy = shared[1].copy()
    fuzzy[45] = "changed"
    texts = [say(80) + shared[0] + say(30), shared[0] + say(50), say(20) + shared[1], say(10) + fuzzy + say(10), say(100), say(40) + shared[2] + say(5), say(200) + shared[2], say(9) + shared[2] + say(40), say(10) + shared[0][:25] + say(60)]
    docs = documents(spark, [" ".join(t) for t in texts] + [None, ""])
    got = substring_dedup.repeated_passages(docs, per_fragment=20).collect()
    assert {i for r in got for i in (r["id"], r["other_id"])} == {0, 1, 2, 3, 5, 6, 7}
    spans = {(r["id"], r["other_id"]): (r["start"], r["end"], r["other_start"], r["other_end"]) for r in got}
    assert spans[1, 0] == (0, 60, 80, 140) and spans[3, 2] == (10, 100, 20, 110) and spans[6, 5] == (200, 255, 40, 95)
    assert substring_dedup.repeated_passages(documents(spark, [])).count() == 0


def test_passages_of_common_parts(spark):
    """Documents that share `least` words in a row are connected, also where others hold every part of them."""
    rng = np.random.default_rng(8)
    say = lambda k: [f"u{j}" for j in rng.integers(0, 10**9, k)]
    texts = {}
    for n in range(0, 600, 20):
        x, y, z = say(30), say(30), say(30)
        texts |= {n: say(9) + y, n + 1: x + say(7), n + 2: say(20) + x + y + say(20), n + 3: say(5) + x + y + say(3), n + 9: say(2) + x + say(40), n + 10: y + say(11)}
        if n >= 300:
            texts |= {n + 4: say(3) + x, n + 5: y + say(1), n + 6: x + z + x + y, n + 7: z + say(90) + x, n + 8: y + x + z, n + 11: z + x + say(2), n + 12: z + y + x + say(80) + z}
    docs = spark.createDataFrame([(i, " ".join(t), None, None, None) for i, t in texts.items()], DOCS)
    owners = defaultdict(set)
    for i, t in texts.items():
        for j in range(len(t) - 49):
            owners[tuple(t[j : j + 50])].add(i)
    edges = {frozenset((min(s), i)) for s in owners.values() for i in s if i != min(s)}
    got = substring_dedup.repeated_passages(docs, per_fragment=1000).collect()
    assert edges <= {frozenset((r["id"], r["other_id"])) for r in got}
    rows = {(r["id"], r["other_id"], r["start"], r["end"], r["other_start"], r["other_end"], r["n_same"]) for r in got}
    assert all((n + 3, n + 2, 5, 65, 20, 80, 60) in rows for n in range(0, 600, 20))


def test_passages_beyond_their_seeds(spark):
    """A clean run of 17 words within a passage that otherwise changes every seventh, and one with words left out."""
    rng = np.random.default_rng(5)
    say = lambda k: [f"u{j}" for j in rng.integers(0, 10**9, k)]
    texts = []
    for n in range(20):
        x = say(60)
        y = [v if 21 <= i < 38 or i % 7 else f"changed{n}" for i, v in enumerate(x)]
        texts += [say(30) + x + say(30), say(50) + y + say(20)]
    x = say(54)
    texts += [say(30) + x + say(30), say(9) + x[:19] + x[20:39] + x[40:] + say(30)]
    got = {(r["id"], r["other_id"]) for r in substring_dedup.repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()}
    assert got == {(i + 1, i) for i in range(0, 42, 2)}


def test_passages_whose_seeds_others_hold(spark):
    """Ten runs of four equal words in fifty, each of which an earlier document holds; and one run of ten among runs of three."""
    rng = np.random.default_rng(6)
    say = lambda k: [f"u{j}" for j in rng.integers(0, 10**9, k)]
    texts, want = [], set()
    for _ in range(5):
        x = say(50)
        y = [v if i % 5 != 2 else say(1)[0] for i, v in enumerate(x)]
        texts += [say(8) + say(2) + x[j + 3 : j + 7] + say(8) for j in range(0, 45, 5)]
        texts += [say(30) + x + say(30), say(7) + y + say(40)]
        want.add((len(texts) - 1, len(texts) - 2))
        x = say(50)
        y = [say(1)[0] if i < 40 and i % 4 == 3 else v for i, v in enumerate(x)]
        texts += [say(30) + x + say(30), say(7) + y + say(40)]
        want.add((len(texts) - 1, len(texts) - 2))
    got = {(r["id"], r["other_id"]) for r in substring_dedup.repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()}
    assert got == want


def test_fuzzy_passages_against_brute_force(spark):
    """Passages of 80 to 95 % equal words, changed evenly or anywhere; brute force counts equal words on every diagonal."""
    rng = np.random.default_rng(11)
    say = lambda k: rng.integers(0, 10**9, k)
    texts = []
    for length in (50, 60, 100):
        for share in (0.8, 0.85, 0.875, 0.9, 0.95):
            for even in (True, False):
                n = round(length * (1 - share))
                at = (np.arange(n) * length // n + length // n // 2) if even else rng.permutation(np.arange(1, length - 1))[:n]
                x = say(length)
                y = x.copy()
                y[at] = say(n)
                texts += [np.concatenate([say(30), x, say(20)]), np.concatenate([say(10), y, say(40)])]

    def brute(x, y, least=50, same=0.8):
        for d in range(-len(x) + least, len(y) - least + 1):
            lo, hi = max(0, -d), min(len(x), len(y) - d)
            sums = np.concatenate([[0], np.cumsum((x[lo:hi] == y[lo + d : hi + d]) - same)])
            if len(sums) > least and (sums[least:] - np.minimum.accumulate(sums)[: len(sums) - least]).max() > -1e-9:
                return True
        return False

    want = {(i + 1, i) for i in range(0, len(texts), 2) if brute(texts[i + 1], texts[i])}
    assert len(want) == len(texts) // 2
    got = substring_dedup.repeated_passages(documents(spark, [" ".join(f"u{v}" for v in t) for t in texts]))
    assert {(r["id"], r["other_id"]) for r in got.collect()} == want


def test_passages_of_the_tables(spark):
    """Every document that shares fifty words in a row with another is reported, and none without fifteen (fuzzy ones have a few)."""
    docs = {i: re.findall(decontaminate.WORD, (t or "").translate(LOW)) for i, t, *_ in local("documents")}
    owners = {n: defaultdict(set) for n in (15, 50)}
    for n, of in owners.items():
        for i, w in docs.items():
            for j in range(len(w) - n + 1):
                of[" ".join(w[j : j + n])].add(i)
    sharing = {n: {i for s in of.values() if len(s) > 1 for i in s} for n, of in owners.items()}
    rows = entry.queries()["op8_substring_dedup"](spark, DATA).collect()
    got = {r["doc_id"] for r in rows}
    assert sharing[50] <= got
    assert got <= sharing[15]
    # documents with fifty equal words in a row are in one component, and the words are in a region
    component = {r["doc_id"]: r["component_id"] for r in rows}
    regions = defaultdict(list)
    for r in rows:
        assert 0 <= r["start_word"] <= r["end_word"] - 50 and r["n_links"] > 0 and r["component_id"] <= r["doc_id"]
        regions[r["doc_id"]].append((r["start_word"], r["end_word"]))
    assert all(b[0] > a[1] for v in regions.values() for a, b in zip(sorted(v), sorted(v)[1:]))
    for i, w in docs.items():
        for j in range(len(w) - 49):
            with_it = owners[50][" ".join(w[j : j + 50])]
            if len(with_it) > 1:
                assert {component[x] for x in with_it} == {component[i]}
                assert any(a <= j and j + 50 <= b for a, b in regions[i])


def test_passages_recall_against_brute_force(spark, capsys):
    """Groups of documents with a passage changed at random, among common phrases and documents that hold its parts."""
    rng = np.random.default_rng(21)
    say = lambda k: rng.integers(10**6, 10**9, k)
    phrases = [rng.integers(0, 10**6, 14) for _ in range(5)]
    texts = []
    for _ in range(25):
        x = say(int(rng.integers(50, 200)))
        texts.append(np.concatenate([say(9), x[: len(x) // 2], say(5)]))  # parts of it lead many of its seeds
        texts.append(np.concatenate([say(3), x[len(x) // 2 :], say(30), phrases[int(rng.integers(5))]]))
        for share in rng.uniform(0.0, 0.18, 4):
            y = x.copy()
            at = rng.random(len(y)) < share / 2  # two copies differ by both their changes
            y[at] = say(int(at.sum()))
            texts.append(np.concatenate([say(int(rng.integers(0, 60))), y, phrases[int(rng.integers(5))], say(int(rng.integers(0, 60)))]))
    texts += [np.concatenate([say(40), phrases[i % 5], say(40)]) for i in range(40)]

    def brute(x, y, least=50, same=0.8):
        for d in range(-len(x) + least, len(y) - least + 1):
            lo, hi = max(0, -d), min(len(x), len(y) - d)
            equal = x[lo:hi] == y[lo + d : hi + d]
            if equal.sum() < same * least:
                continue
            sums = np.concatenate([[0], np.cumsum(equal - same)])
            if (sums[least:] - np.minimum.accumulate(sums)[: len(sums) - least]).max() > -1e-9:
                return True
        return False

    want = {(i, j) for i in range(len(texts)) for j in range(i) if brute(texts[i], texts[j])}
    docs = documents(spark, [" ".join(f"u{v}" for v in t) for t in texts])
    rows = substring_dedup.repeated_passages(docs, per_fragment=2000).collect()
    for r in rows:  # what is reported holds
        x, y = texts[r["id"]][r["start"] : r["end"]], texts[r["other_id"]][r["other_start"] : r["other_end"]]
        assert len(x) >= 50 and r["n_same"] >= 0.8 * max(len(x), len(y)) - 1e-9
        if len(x) == len(y):
            assert (x == y).sum() == r["n_same"]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in rows:
        root[find(r["id"])] = find(r["other_id"])
    joined = sum(find(i) == find(j) for i, j in want) / len(want)
    with capsys.disabled():
        print(f"pairs {len(want)}, connected {joined:.3f}", end=" ")
    assert joined >= 0.9
    regions = substring_dedup.repeated_regions(docs, per_fragment=2000).collect()
    component = {r["id"]: r["component"] for r in regions}
    assert all((component[r["id"]] == component[r["other_id"]]) for r in rows) and set(component) == {x for r in rows for x in (r["id"], r["other_id"])}


def test_rows_out_of_a_shuffle_are_written_first(spark):
    rng = np.random.default_rng(9)
    say = lambda k: " ".join(f"u{j}" for j in rng.integers(0, 10**9, k))
    x = say(80)
    docs = documents(spark, [f"{say(i)} {x}" for i in range(12)] + [say(50) for _ in range(40)])
    dealt = docs.repartition(5, "text")
    assert settled(docs, "a") is docs and settled(dealt, "a") is not dealt
    assert {r["id"] for r in substring_dedup.repeated_regions(dealt).collect()} == set(range(12))
    assert {r["component"] for r in substring_dedup.repeated_regions(dealt).collect()} == {0}
    want = {(r["id"], r["component"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert {(r["id"], r["component"]) for r in jaccard_join.jaccard_components(dealt).collect()} == want


def test_passages_of_odd_rows(spark):
    """Repeated and null identifiers, nulls, a very long text, ties, and columns whose names clash."""
    rng = np.random.default_rng(3)
    say = lambda k: " ".join(f"u{j}" for j in rng.integers(0, 10**9, k))
    x, y, long = say(60), say(70), say(30_000)
    rows = [(1, x), (1, y), (1, x), (2, f"{say(5)} {y}"), (3, f"{x} {say(4)}"), (None, x), (4, None), (5, ""), (6, long), (7, f"{say(3)} {long}"), (8, "w " * 40_000), (9, "w " * 500), (10, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("frag", "src", "cut", "b", "a", "words", "id"):
        docs = docs.withColumn(c, F.lit("x"))
    got = {(r["id"], r["other_id"]) for r in substring_dedup.repeated_passages(docs).collect()}
    assert {frozenset(p) for p in got} == {frozenset(p) for p in ((1, 2), (1, 3), (6, 7), (8, 9))}
    regions = {(r["id"], r["region"]): (r["start"], r["end"], r["component"]) for r in substring_dedup.repeated_regions(docs).collect()}
    assert regions[7, 0] == (3, 30_003, 6) and regions[2, 0] == (5, 75, 1) and regions[3, 0] == (0, 60, 1)
    assert substring_dedup.repeated_regions(docs.filter("false")).count() == 0


# 9


def test_archives(spark):
    big, small = "é" * 600, "x" * 999
    pages = spark.createDataFrame([(1, "http://a b/\n", big), (5, None, big), (3, "u", big), (7, "v", small), (8, "v", small), (9, "e", None), (None, "n", big), (5, "again", big)], "page_id long, url string, html string")
    index = warc.write_warc(pages)
    assert index.count() == 8
    got = sorted((str(r["id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in warc.read_warc(index, "file:///").collect())
    assert got == sorted([("1", 1200, "revisit", "5"), ("3", 1200, "revisit", "5"), ("5", 1200, "response", "None"), ("5", 1200, "response", "None"), ("7", 999, "response", "None"), ("8", 999, "response", "None"), ("9", 0, "response", "None"), ("None", 1200, "response", "None")])
    one = warc.read_warc(index.filter("id = 7"), "file:///").collect()
    assert len(one) == 1 and bytes(one[0]["payload"]).decode() == small and one[0]["payload_digest"] == hashlib.sha1(small.encode()).hexdigest()
    r = index.filter("id = 1").first()
    raw = open(r["archive"], "rb").read()[r["offset"] : r["offset"] + r["length"]]
    assert b"WARC-Target-URI: http://a%20b/%0A\r\n" in gzip.decompress(raw)
    assert warc.write_warc(pages.filter("false")).count() == 0
    assert warc.runs([(0, 10), (10, 5), (100, 5), (300, 5)], 85, 1000) == [(0, 3), (3, 4)] and warc.runs([], 1, 1) == []
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, None, b"abc", None)[0].replace(b"abc", b"abd"))


# 10


def test_rules_and_reputation(spark):
    urls = ["http://Example.ORG/es/1", "https://sub.example.org/en/12?x", "http://badexample.org/es/", "http://x.com/fr/1", "http://y.com/de/", "http://org", "ftp://a.net#q://z", None, "no url", "http://h.net/a", "http://k.net/a"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    bad = spark.createDataFrame([("h.net", 1)] * 40 + [("k.net", 0)] * 40 + [("h.net", None)], "host string, bad int")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, bad).collect()}
    assert got[0] == ("example.org", "/es/1", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
    assert got[2][2:] == ("org/", "allow") and got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == ("org", "", None, "allow") and got[6] == ("a.net", "", None, "allow") and got[7] == got[8] == ("", "", None, "allow")
    assert got[9][3] == "block" and got[10][3] == "allow"
    none = url_filter.judge(pages, bad.filter("false")).filter("rule is null").select("verdict").distinct().collect()
    assert [r[0] for r in none] == ["allow"]
    assert url_filter.judge(pages.filter("false"), bad).count() == 0


def test_shrinkage_is_between(spark):
    outcomes = spark.createDataFrame([("a.x.com", 1)] * 2 + [("b.x.com", 0)] * 30 + [("c.y.com", 0)] * 30, "host string, bad int")
    hosts = spark.createDataFrame([("a.x.com",), ("b.x.com",), ("new.x.com",), ("new.org",)], "host string")
    mean = {r["host"]: r["a"] / (r["a"] + r["b"]) for r in url_filter.reputation(hosts, outcomes).collect()}
    assert mean["b.x.com"] < mean["new.x.com"] < mean["a.x.com"] < 1
    assert 0 < mean["new.org"] < 0.2
    assert {h: spark.range(1).select(url_filter.domain_of(F.lit(h))).first()[0] for h in ("a.b.co.uk", "a.b.com", "com")} == {"a.b.co.uk": "b.co.uk", "a.b.com": "b.com", "com": "com"}


# Pipeline


def test_pipeline_by_stages(spark):
    docs = stage(spark.read.parquet(f"{DATA}/documents.parquet"), "all")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(i, t) for i, t in local("benchmark")]
    for name, step in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        after = stage(step(spark, docs, DATA), name)
        if name == "pack":
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == before
            break
        assert after.columns == docs.columns
        left = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "exact_dedup":
            assert left == {i for i in before if i == max(j for j in before if texts[j] == texts[i])}
        if name == "near_dedup":
            order = sorted(before)
            _, root = brute_components([texts[i] for i in order])
            assert left == {order[i] for i, r in enumerate(root) if i == r}
        if name == "decontaminate":
            assert left == {i for i in before if not brute_hits(texts[i], items)[1]}
        docs = after


def test_pipeline_of_nothing_and_odd_rows(spark):
    none = documents(spark, [])
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "w " * 3000, None, "s", None), (3, None, None, None, None)], DOCS)
    for docs in (none, odd):
        for name, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs.withColumn("digest", F.lit(1)).drop("digest"), DATA), name)
    assert docs.columns[0] == "doc_id"


# Odd rows


@pytest.mark.parametrize("name", ["shards", "exact", "pack", "jaccard", "leaks", "warc"])
def test_clashing_columns_nulls_and_long_texts(spark, name):
    """Columns named as the operators name theirs, null and repeated identifiers, empty and very long texts."""
    long = "word and other words of it " * 20_000
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (2, ""), (3, long), (4, long), (4, long), (None, "a b c d e f g"), (5, " ")], "doc_id long, text string")
    for c in ("id", "digest", "name", "key", "keep_id", "frag", "src", "cut", "cls", "n", "gram", "length", "salt", "sequence", "words", "hashes", "m", "bits", "__bits", "hit", "url", "html", "target", "shard", "rows", "component"):
        docs = docs.withColumn(c, F.lit("x"))
    bench = spark.createDataFrame([(7, "b c d", "x"), (None, None, "x")], "item_id long, text string, words string")
    if name == "shards":
        assert sharding.sharded(docs, 1000).count() == 8
    elif name == "exact":
        got = exact_dedup.exact_duplicates(docs)
        assert got.count() == 8 and {r["group_size"] for r in got.filter("id = 4").collect()} == {3}
        left = exact_dedup.drop_exact_duplicates(docs)
        assert left.columns == docs.columns and left.count() == 4
    elif name == "pack":
        got = packing.pack(docs).collect()
        assert Counter(r["id"] for r in got if r["length"] == 1) == Counter([2, 2]) and sum(r["length"] for r in got if r["id"] == 3) > 100_000
    elif name == "jaccard":
        got = {(r["id"], r["n"], r["component"]) for r in jaccard_join.jaccard_components(docs).collect()}
        assert (4, 6, 3) in got and (2, 0, 2) in got and (None, 3, None) in got
        left = jaccard_join.one_of_each(docs)
        assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.select("doc_id").collect()) == ["1", "2", "2", "3", "5", "None"]
    elif name == "leaks":
        got = decontaminate.contamination(docs, bench)
        assert got.count() == 8 and got.filter("n_hit > 0").count() == 2
        left = decontaminate.drop_contaminated(docs, bench)
        assert left.columns == docs.columns and left.count() == 6
    else:
        pages = docs.withColumn("page_id", F.col("doc_id")).withColumn("html", F.col("text"))
        index = warc.write_warc(pages)
        back = warc.read_warc(index, "file:///").collect()
        assert len(back) == 8 and Counter(r["record_type"] for r in back) == Counter({"response": 7, "revisit": 1})


def test_few_edges_are_joined_by_one_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 4000, (3000, 2))] + [(5000 + i, 5001 + i) for i in range(500)] + [(9000, 9000), (None, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    made: list[str] = []
    monkeypatch.setattr(graph, "stage", lambda df, name: made.append(name) or common.stage(df, name))
    got = {r["id"]: r["component"] for r in graph.components(df).collect()}
    assert len(made) <= 5  # every further round is planned by the driver
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    monkeypatch.setattr(graph, "LAST_EDGES", 40)
    assert {r["id"]: r["component"] for r in graph.components(df).collect()} == got


def test_chains_without_a_passage_ask_for_no_words(spark, monkeypatch):
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    some = word(24)  # a chain, but no passage of fifty words
    texts = [" ".join(word(60) + some + word(60)) for _ in range(6)]
    asked = []
    kept = lambda df, name: (lambda out: (asked.append(out) if name == "asked" else None, out)[1])(common.stage(df, name))
    monkeypatch.setattr(substring_dedup, "stage", kept)
    assert substring_dedup.repeated_passages(documents(spark, texts)).count() == 0
    assert asked[-1].count() == 0


def test_bytes_drop_no_chain_with_a_passage():
    rng = np.random.default_rng(7)
    rows, want = [], []
    for _ in range(400):
        pb, pa_, n = (int(x) for x in (rng.integers(0, 90), rng.integers(0, 90), rng.integers(4, 49)))
        x = rng.integers(0, 2**32, pb + n + int(rng.integers(0, 90)), dtype=np.uint64)
        y = rng.integers(0, 2**32, pa_ + n + int(rng.integers(0, 90)), dtype=np.uint64)
        left, right = min(pb, pa_), min(len(x) - pb, len(y) - pa_)
        y[pa_ - left : pa_ + right] = np.where(rng.random(left + right) < rng.choice([0.1, 0.75, 0.8, 0.85]), x[pb - left : pb + right], y[pa_ - left : pa_ + right])
        y[pa_ : pa_ + n] = x[pb : pb + n]
        left, right = min(left, 64), min(right, n + 64)
        equal = x[pb - left : pb + right] == y[pa_ - left : pa_ + right]
        want.append(bool(substring_dedup.stretches(equal, 50, 0.8)))
        code = lambda z, p, n=n: (z >> np.uint64(24)).astype("u1")[max(p - 64, 0) : p + n + 64].tobytes()
        rows.append({"pb": [pb], "pa": [pa_], "n": [n], "cb": code(x, pb), "ca": code(y, pa_)})
    got = substring_dedup.may_pass(pa.RecordBatch.from_pylist(rows), 50, 0.8, 64)
    assert all(g for g, w in zip(got, want, strict=True) if w) and 0 < sum(want) < 300
    assert sum(got) <= sum(want) + 20


def test_staging_leaves_no_shuffle_files(spark):
    files = lambda: sum("shuffle_" in str(f) for f in seq_files(spark))

    def seq_files(spark):
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return [found.apply(i) for i in range(found.size())]

    old, before = spark.conf.get(common._CLEANUP, None), files()
    kept = common.stage(spark.range(10_000).groupBy(F.pmod("id", F.lit(100)).alias("x")).count(), "few")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and kept.count() == 100 and spark.conf.get(common._CLEANUP, None) == old


def test_seeds_on_disk_are_those_of_one_turn(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    some = word(80)
    texts = [" ".join(word(3000) + (some if i in (3, 60, 99) else [])) for i in range(120)]
    n_words = sum(len(t.split()) for t in texts)
    docs = common.stage(documents(spark, texts), "texts")
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    done, seen = threading.Event(), []

    def sizes():
        for top in dirs:
            for where, _, names in os.walk(top):
                for name in names:
                    with contextlib.suppress(FileNotFoundError):
                        yield os.path.getsize(f"{where}/{name}") if name.startswith("shuffle_") else 0

    def watch():
        while not done.is_set():
            seen.append(sum(sizes()))
            time.sleep(0.02)

    floor, watcher = sum(sizes()), threading.Thread(target=watch)
    watcher.start()
    try:
        got = substring_dedup.repeated_passages(docs, per_fragment=20_000).collect()
    finally:
        done.set()
        watcher.join()
    assert {frozenset((r["id"], r["other_id"])) for r in got} == {frozenset(x) for x in ((3, 60), (3, 99), (60, 99))} and {(r["start"], r["end"]) for r in got} == {(3000, 3080)}
    assert n_words < max(seen) - floor < 3.5 * n_words  # a seed has four bytes and its place, so all have more than four a word


def test_turns_give_the_same_passages(spark):
    rng = np.random.default_rng(9)
    some = [[f"w{x}" for x in rng.integers(0, 10**6, 70)] for _ in range(5)]
    texts = [" ".join([f"w{x}" for x in rng.integers(0, 300, 100)] + some[i % 5] + [f"w{x}" for x in rng.integers(0, 300, 60)]) for i in range(40)]
    docs = documents(spark, texts)
    one, two, five = (sorted(map(tuple, substring_dedup.repeated_passages(docs, per_fragment=400, turns=n).collect())) for n in (1, 2, 5))
    assert len(one) >= 35 and one == two == five


def test_word_hashes_are_sums_over_a_word_alone():
    texts = pa.array(["", "Some  words,\tsome", None, " ", "\u00e9t\u00e9 x" * 60_000, "q" * 300_000 + " Some"])
    base, wrap, seen = int(kernels._BASE), (1 << 64) - 1, {}
    for _, data, offsets in kernels.parts(texts):
        for h, text, a, b in zip(*kernels.words(data, offsets, kernels.WHITE), strict=True):
            word = bytes(data[a:b]).lower()
            assert offsets[text] <= a < b <= offsets[text + 1] and not set(word) & set(b" \t")
            if seen.setdefault(word, h) is h:
                total, power = 0, base
                for x in word:
                    total, power = total + int(kernels._VALUE[x]) * power & wrap, power * base & wrap
                assert kernels.mix(np.array([total + len(word) * base & wrap], np.uint64))[0] == h
            assert seen[word] == h
    assert {b"some", b"words,", b"q" * 300_000} <= set(seen)


def test_nested_scratch_lists_are_told_apart(spark):
    with common.scratch() as outer:
        with common.scratch():
            first = common.fresh_path(spark, "x")
        second = common.fresh_path(spark, "y")
    assert outer == [first, second]
