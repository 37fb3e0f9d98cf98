"""The operators with SQL against DuckDB, the others on small truths; nulls, repeats, empty tables and clashing columns."""

import duckdb
import pytest
from brute import DOCS
from pyspark.sql import functions as F

import corpus_pipeline
from poseframe.llm import chat, decontamination, html_text, mixing, pii, quality, queries, suffix_dedup, toxicity, url_filter

TABLES = ("documents", "benchmark", "conversations", "pages", "labels", "embeddings")


def rows_of(rows, cols):
    plain = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[i]) for i in range(len(cols))) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert rows_of(got.select(*cols).collect(), cols) == rows_of(want.fetchall(), cols)


ODD = [(1, "Ab ab  x\n\nAb ab  x\n", "en", "s", 3), (1, "Ab ab  x\n\nAb ab  x\n", "en", "s", 3), (2, None, None, None, None), (None, "", "en", None, 0), (3, "#" * 30000, "en", "t", 1), (4, " \t\n", "", "t", 3)]


def odd(spark, rows=ODD):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(None).cast("string") for c in ("id", "key", "size", "words", "n", "h", "part", "failed", "first", "gone")})


def test_mixing_of_odd_rows(spark):
    got = mixing.mixed(odd(spark)).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 0, 1, 6, 6]
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mixed(odd(spark, [])).count() == 0
    assert [mixing.range_digits(n) for n in (0, 8 * 10**7, 10**9, 10**11)] == [3, 3, 4, 6]


def test_quality_of_odd_rows(spark):
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_symbols"], r["n_dup_lines"]) for r in quality.judged(odd(spark)).collect())
    assert got == [(0, 0, 0, 0), (1, 6, 0, 1), (1, 6, 0, 1), (2, 0, 0, 0), (3, 1, 30000, 0), (4, 0, 0, 0)]
    assert quality.judged(odd(spark, [])).count() == 0
    lost = {r["rule"]: r for r in quality.ablation(quality.ledger(odd(spark)), "v1").collect()}
    assert lost["few_words"]["rejected"] == 6 and lost["many_symbols"]["rejected"] == 1
    book = quality.ledger(odd(spark)).collect()
    for i, (name, _) in enumerate(quality.RULES):
        bit = 1 << i
        assert (lost[name]["alone"], lost[name]["kept_without"]) == (sum(r["failed"] == bit for r in book), sum(r["failed"] & ~bit == 0 for r in book))


def test_repeated_words_are_those_in_windows_found_twice(spark):
    text = "a b c d e f a b c d e f"
    r = quality.judged(spark.createDataFrame([(1, text, "", "", 1), (2, "x " * 12, "", "", 1), (3, "a b c d e", "", "", 1)], DOCS)).orderBy("doc_id").collect()
    assert [x["n_repeat_words"] for x in r] == [12, 12, 0]


def test_chat_keeps_the_longest_snapshot(spark):
    say = lambda c, n: [(c, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n)]
    rows = say(1, 2) + say(2, 4) + say(3, 4) + [(4, 0, "user", "other"), (4, 0, "user", "other"), (None, 1, None, None)]
    got = {r["conv_id"]: r for r in chat.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("x"))).collect()}
    assert set(got) == {2, 4, None}
    assert got[2]["n_turns"] == 4 and got[2]["n_logged"] == 2
    assert got[4]["text"] == "<|im_start|>user\nother<|im_end|>"
    assert chat.rendered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


ITEM = "A train leaves Berlin at 9 hours and travels 120 km before it stops near Potsdam, how many km are left of 300 km in all?"


def test_decontamination_finds_other_values_and_checks_slots(spark):
    bench = spark.createDataFrame([(7, ITEM), (None, ITEM), (8, None)], "item_id long, text string")
    again = ITEM.replace("Berlin", "Madrid").replace("120", "85").replace("300", "410")
    docs = [(1, f"Here is one. {ITEM} Good luck."), (2, again), (3, "Nothing of that kind stands here at all."), (4, None), (5, ""), (None, ITEM)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS).withColumns({"h": F.lit(1), "item_id": F.lit("x"), "at": F.lit(2)})
    got = {(r["doc_id"], r["changed"]) for r in decontamination.leaks(docs, bench).where("item_id = 7").collect()}
    assert got == {(1, False), (2, True), (None, False)}
    left = decontamination.contaminated_removed(docs, bench)
    assert {r["doc_id"] for r in left.collect()} == {3, 4, 5} and left.columns == docs.columns
    assert decontamination.leaks(docs.where("false"), bench).count() == 0
    assert decontamination.leaks(docs, bench.where("false")).count() == 0


def test_toxicity_is_right_on_labels_it_did_not_see(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels.select("doc_id", "toxic"), "doc_id")
    cells = {(r["toxic"], r["predicted"]): r["count"] for r in got.where("held_out").groupBy("toxic", "predicted").count().collect()}
    hit, missed, wrong, right = (cells.get(k, 0) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))
    assert hit / max(1, hit + missed) > 0.8 and wrong / max(1, wrong + right) < 0.02, cells


def test_decontamination_of_short_items_names_and_edited_copies(spark):
    import random

    names = "Anna Berg Carl Dorn Erik Falk Greta Holm 7 9 Ida Jung Kurt Lund"
    twice = ITEM + " From Berlin the train goes on."
    bench = spark.createDataFrame([(1, "What is the capital city of Peru?"), (2, "Yes"), (3, names), (4, twice)], "item_id long, text string")
    edited = twice.replace("From Berlin", "From Munich")
    rng = random.Random(1)
    noise = " ".join(f"word{rng.randint(0, 10**6)}" for _ in range(150_000))
    rows = [(1, "So, what is the capital city of peru? Lima."), (2, "yes"), (3, "Yes it is so"), (4, f"Here: {names.lower()}."), (5, edited), (6, noise + " " + ITEM)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}
    assert got == {(1, 1), (2, 2), (4, 3), (5, 4), (6, 4)}


def test_decontamination_finds_questions_asked_again_with_other_values(spark, sf):
    import random
    import re

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng = random.Random(3)

    def again(text):  # every number and name gets one other value
        new = {}
        fresh = lambda m: new.setdefault(m[0], str(rng.randint(1000, 9999)) if m[0][0].isdigit() else f"Zq{len(new)}x")
        return re.sub(r"(?<![^\W_])(?:[0-9][^\W_]*|[A-Z][^\W_]*)", fresh, text)

    docs = spark.createDataFrame([(i, f"Some words before. {again(t)} And some after.", "en", "s", 0) for i, t in items], DOCS)
    found = {(r["doc_id"], r["item_id"]): r["changed"] for r in decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum(found.get((i, i), False) for i, _ in items) >= 0.9 * len(items)


def test_nearest_examples_equal_a_full_cosine():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 60)) if x < 500) + (" bad stuff" if i % 3 == 0 else "") for i in range(500)]
    toxic = np.array([float(i % 3 == 0) for i in range(500)])
    row, term, tf = toxicity.terms(pa.array(texts))
    index = toxicity.index_of(np.arange(500), toxic, row, term, tf, {1: 170, 0: 330})
    assert (index.column >= 0).any() and (index.column < 0).any() and len(index.heavy) > 2 * toxicity.BLOCK
    queries = texts[:40] + ["", "nothing known here", "bad w1 w1 new", "w1"]
    row, term, tf = toxicity.terms(pa.array(queries))
    got = index.nearest(row, term, tf, len(queries))
    value = dict(zip(index.terms.tolist(), index.value.tolist(), strict=True))

    def vector(text):
        _, t, n = toxicity.terms(pa.array([text]))
        v = {k: (1 + np.log(c)) * value.get(k, index.unknown) for k, c in zip(t.tolist(), n, strict=True)}
        length = np.sqrt(sum(x * x for x in v.values())) or 1.0
        return {k: x / length for k, x in v.items()}

    examples = [vector(texts[i]) for i in index.ids]
    for q, (top, cos) in zip(queries, got, strict=True):
        v = vector(q)
        every = np.array([sum(x * e.get(k, 0.0) for k, x in v.items()) for e in examples])
        want = np.sort(every)[::-1][: toxicity.NEIGHBOURS]
        want = np.minimum(want[want > 1e-9], 1)
        assert len(cos) == len(want) and np.allclose(cos, want, atol=1e-5) and np.allclose(every[top], cos, atol=1e-5), q


def test_toxicity_of_a_very_long_text_is_that_of_its_words(spark):
    rows = [(i, ("vile rude words " if i % 2 else "kind calm words ") * (i + 1), "en", "s", 0) for i in range(40)] + [(90, "vile rude words " * 200_000, "en", "s", 0)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert got[90] == 1 and all(got[i] == i % 2 for i in range(40))


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(odd(spark), labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity_scores(odd(spark, []), labels).count() == 0
    assert all(r["score"] == 0 for r in toxicity.toxicity_scores(odd(spark), labels.where("false")).collect())


def test_other_text_operators_take_odd_rows(spark):
    assert pii.find_pii(odd(spark)).count() == 6 and pii.find_pii(odd(spark, [])).count() == 0
    assert pii.pii_redacted(odd(spark)).columns == odd(spark).columns
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.long_repeats_removed(odd(spark)).collect()}
    assert got[3] == 30000 and got[1] == 0


def test_urls_by_rule_and_by_template(spark):
    rows = [(1, "https://Shop.COM/en/x?q=1"), (2, "http://example.com/en/77"), (3, "http://a.example.net/de/8"), (4, "ftp://x.net/de"), (5, None), (6, "no scheme"), (7, "http://notcom/en/"), (7, "http://org/es/#f")]
    rows += [(100 + i, f"http://h.org/es/{i}") for i in range(12)]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(3))).where("page_id < 100").fillna("-").collect())
    assert got == [
        (1, "shop.com", "/en/x", "com/en/", "block"), (2, "example.com", "/en/77", "example.com/en/7", "allow"), (3, "a.example.net", "/de/8", "example.net/de/8", "block"), (4, "x.net", "/de", "-", "allow"),
        (5, "", "", "-", "allow"), (6, "", "", "-", "allow"), (7, "notcom", "/en/", "-", "allow"), (7, "org", "/es/", "org/es/", "block"),
    ]
    # labels of pages below one template reject its other pages
    pages = spark.createDataFrame([(i, f"http://h.example/spam/{i}") for i in range(30)] + [(100 + i, f"http://h.example/ok/{i}") for i in range(30)], "page_id long, url string")
    labels = spark.createDataFrame([(i, True) for i in range(20)] + [(100 + i, False) for i in range(20)], "page_id long, bad boolean")
    said = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(pages, labels).collect()}
    assert {said[i] for i in range(20, 30)} == {"block"} and {said[i] for i in range(120, 130)} == {"allow"}


def test_rules_say_what_the_contract_says(spark):
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://a.net/de/1", "http://example.net/de/8", "http://example.net/de/7", "http://a.org/es/1"]
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect())
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]
    assert got == [(i, *r) for i, r in enumerate(rules)]


def test_urls_without_a_rule_are_judged_by_their_tree(spark):
    urls = [f"http://a.com/en/{i}" for i in range(20)] + ["http://a.com/fr/1", "http://a.com/fr/x/y", "http://b.com/fr/1"]
    urls += [f"http://c.org/es/{i}" for i in range(9)] + ["http://c.org/fr/1"]
    got = {r["path"] if r["host"] == "a.com" else r["host"] + r["path"]: r for r in url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got["/fr/1"]["rule"] is None and [got[p]["verdict"] for p in ("/fr/1", "/fr/x/y", "b.com/fr/1", "c.org/fr/1")] == ["block", "block", "allow", "allow"]


def test_variable_segments_are_found_at_every_depth(spark):
    name = lambda i: "".join(chr(97 + int(d)) for d in str(1000 + i))
    urls = [f"http://u.example/user/{name(i)}/{kind}" for kind in ("spam", "post") for i in range(60)] + ["http://u.example/user/zoe/spam", "http://u.example/user/zoe/post"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 60) for i in [*range(30), *range(60, 90)]], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in url_filter.url_verdicts(pages, labels).collect()}
    assert (got[120]["verdict"], got[121]["verdict"]) == ("block", "allow") and got[120]["template"] == "u.example/user/*/spam"


def test_main_text_of_pages(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one\n  two<p>three <b>four</b></article><div class='comments'>no</div><script>x</script></body></html>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), (4, "x", "<p>a<br>b</p>&lt;c")] + [(10 + i, "http://s/p", f"<div class=x>same on all</div><p>body {i}</p>") for i in range(10)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert got[1] == "A & B\n\none two\n\nthree four" and got[2] == got[3] == "" and got[4] == "a b\n\n<c"
    assert got[13] == "body 3"
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_classes_and_teaser_articles_leave_the_text(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, "http://a/1", f"<body class='no-sidebar'><div class='content-widget'><p>{text}</p></div><div class='comments'>no</div></body>"),
        (2, "http://b/1", f"<body><div><p>{text}</p></div><article class=card>teaser one</article><article class=card>teaser two</article></body>"),
        (3, "http://c/1", f"<body><article><p>{text}</p></article><div>outside</div></body>"),
        (4, "http://d/1", f"<body><article class='share-enabled'><p>{text}</p><div id=comments>no</div></article><p>outside</p></body>"),
    ]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[3] == got[4] == text and got[2].startswith(text)


def test_pipeline_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "mixing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and 0 < got.count() < docs.count()


def test_html_markup_of_every_day(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, "http://a/1", f"<body class='page no-sidebar'><article><p>{text}</p></article></body>"),
        (2, "http://b/1", f"<main class='content has-comments'><p>{text}</p></main>"),
        (3, "http://c/1", f"<article class='post comment-open'><p>{text}</p></article>"),
        (4, "http://d/1", f"<article><div class='article-header'><h1>Title</h1></div><p>{text}</p></article>"),
        (5, "http://e/1", f"<article><p>{text} <span class='search-hit'>found</span> <a class='share-link'>here</a> too</p></article>"),
        (6, "http://f/1", '<article><p title="abc>hello</p><p>there</p></article>'),
        (7, "http://g/1", "<div>" * 3000 + "</b></i>" * 3000 + "deep" + f" <p>{text} " * 3000),
        (7, "http://g/1", "twice"),
    ]
    got = [(r["page_id"], r["text"]) for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    by = dict(got)
    assert by[1] == by[2] == by[3] == text and by[4] == f"Title\n\n{text}" and by[5] == f"{text} found here too"
    assert by[6] == "hello\n\nthere" and len(got) == 8 and (7, "twice") in got
    assert max(len(t) for i, t in got if i == 7) > 3000 * len(text)


def test_pii_of_contexts_on_both_sides_secrets_and_names_that_clash(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 8)) + "a1b2c3d4"
    rows = [(i, f"{word()} {word()} +1 555 01{i:02d} 22{i:02d} is my number {word()}") for i in range(40)]
    rows += [(100 + i, f"{word()} (555) 77{i % 10}-1{i:03d} is my number {word()}") for i in range(20)]  # unseen by the rules
    rows += [(200 + i, f'{word()} {word()} token = "{key(40)}" {word()}') for i in range(20)] + [(300 + i, f'{word()} token = "{key(20)}" {word()}') for i in range(10)]
    rows += [(400 + i, f"{word()} {word()} {key(40)} {word()}") for i in range(10)] + [(500 + i, f"{word()} {rng.randint(10**9, 10**10)} {word()}") for i in range(10)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumns({c: F.lit("x") for c in ("_key", "_d", "_k", "key", "more", "spans")})
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    found = sum("phone:" in got[100 + i]["spans"] for i in range(20)) + sum("secret:" in got[b + i]["spans"] for b, n in ((200, 20), (300, 10)) for i in range(n))
    assert found >= 0.9 * 50 and all(got[b + i]["n_spans"] == 0 for b in (400, 500) for i in range(10))
    clean = {r["doc_id"]: r["text"] for r in pii.pii_redacted(df).collect()}
    assert "<SECRET>" in clean[305] and "<PHONE>" in clean[105] and clean[500] == rows[-10][1] and len(clean) == len(rows)


def test_pii_of_a_very_long_text_is_linear():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.time()
        spans, met = pii.mentions("call 555-123-4567 1.2.3.4 " * n)
        took.append(time.time() - began)
        assert len(spans) == n and len(met) > n
    assert took[1] < 10 * took[0]


def test_urls_of_an_empty_table(spark):
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0
