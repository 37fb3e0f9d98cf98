import random

import pytest
from brute import DOCS, base_spans, components, kept_bytes
from pyspark.sql import functions as F

from poseframe.llm import jaccard_join, pii, suffix_dedup


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DOCS)


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + rng.choice("rstuvw") + str(rng.randint(0, 30)) for _ in range(n)]


def near_texts(seed, n=60):
    """Copies, near copies on both sides of the threshold, shared passages, short and empty texts."""
    rng, out = random.Random(seed), []
    passage = " ".join(words(rng, 45))
    for base in range(n // 6):
        w = words(rng, rng.choice([3, 6, 12, 20, 30, 60, 200, 500]))
        out.append(" ".join(w))
        out.append(" ".join(w).upper() + "\n")
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 25))):
                v[rng.randrange(len(v))] = rng.choice(words(rng, 1))
            out.append("\t".join(v))
        out.append(" ".join(words(rng, rng.choice([5, 40, 120]))) + " " + passage)
    out += ["", None, "  \n", "one", "One ", "one two", passage, passage + " x"]
    rng.shuffle(out)
    return list(enumerate(out, 10))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_equal_brute_force(spark, seed):
    rows = near_texts(seed)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs_of(spark, rows)).collect()}
    assert got == components(rows)


def test_jaccard_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_pairs_that_share_many_signatures_meet_once(spark):
    """40 sets in 2,000 signatures of up to 20: a pair is looked at once, however many signatures it shares."""
    rng = random.Random(5)
    rows = [(s, c, c // 8) for s in range(2000) for c in rng.sample(range(40), rng.randint(2, 20))]
    of: dict[int, list[int]] = {}
    for s, c, _ in rows:
        of.setdefault(s, []).append(c)
    want = {(a, b) for cs in of.values() for a in cs for b in cs if a < b and a // 8 != b // 8}
    table = spark.createDataFrame([(s, c, None, comp) for s, c, comp in rows], "sig long, cls long, place long, comp long")
    sets = spark.createDataFrame([(c, 1000, *[0] * len(jaccard_join.PARITY)) for c in range(40)], "cls long, n long, " + ", ".join(f"{p} long" for p in jaccard_join.PARITY))
    links, seen = jaccard_join._Links(sets), []
    links.compare = lambda pairs: seen.extend((r["a"], r["b"]) for r in pairs.collect())
    links.across(table)
    assert sorted(seen) == sorted(want)
    first = [(r["a"], r["b"]) for r in jaccard_join.pairs_in_lists(table, 0).collect()]
    assert len(first) == len(set(first)) and {tuple(sorted(p)) for p in first} <= want
    at_centers = {s: {c for a, c in first if a in of[s] and c in of[s]} for s in of}
    comp_of = {c: c // 8 for c in range(40)}
    for s, cs in of.items():  # some set of each open signature is compared with all that are apart from it
        if len({comp_of[c] for c in cs}) > 1:
            assert any(all((a, c) in first for a in cs if comp_of[a] != comp_of[c]) for c in at_centers[s])


def test_lists_of_a_family_shrink_to_a_cover_of_their_pairs(spark, monkeypatch):
    """30 families of 20 sets in 100 signatures each, of up to 15: few lists hold all pairs, also where little is remembered."""
    rng = random.Random(6)
    lists = [(f * 100 + s, sorted(rng.sample(range(f * 20, f * 20 + 20), rng.randint(2, 15)))) for f in range(30) for s in range(100)]
    rows = [(s, c, False) for s, cs in lists for c in cs] + [(9999, c, False) for c in range(2000, 2000 + jaccard_join.CROWD + 1)]
    pairs_of = lambda found: {(a, b) for _, cs in found for a in cs for b in cs if a < b}
    for at_once in (jaccard_join.PAIRS_AT_ONCE, 100):
        monkeypatch.setattr(jaccard_join, "PAIRS_AT_ONCE", at_once)
        few = jaccard_join._lists_of_few(spark.createDataFrame(rows, "sig long, cls long, dense boolean").select("sig", "cls"))
        got = [(r["sig"], r["cls"]) for r in jaccard_join.cover_of_lists(few).collect()]
        assert pairs_of(got) == pairs_of(lists)
        if at_once > 100:
            assert 4 * sum(len(cs) for _, cs in got) < sum(len(cs) for _, cs in lists)


def test_signatures_meet_whenever_sets_are_similar(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    none = np.zeros(0, np.uint64)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        u = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        gone = int(rng.integers(0, n // 7 + 1))
        more = rng.integers(0, 2**64, int(rng.integers(0, n // 7 + 1)), dtype=np.uint64)
        v = np.unique(np.concatenate([rng.permutation(u)[gone:], more]))
        both = len(np.intersect1d(u, v))
        if both and 100 * both >= 75 * (len(u) + len(v) - both):
            heavy = np.sort(rng.permutation(u)[: rng.integers(0, len(u) + 1)])
            for h in (none, heavy):  # 0 marks both as dense
                whose, sigs = jaccard_join.signatures([u, none, v], h)
                assert len(np.intersect1d(sigs[whose == 0], sigs[whose == 2])) and 1 not in whose


def test_signatures_enumerate_subsets_of_two_levels():
    import numpy as np

    rng = np.random.default_rng(5)
    u = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    groups, parts, apart = jaccard_join._scheme(int(np.searchsorted(jaccard_join.TOPS, len(u))))
    assert groups > 1 and 0 < apart < parts
    alone = jaccard_join.signatures([u], np.zeros(0, np.uint64))[1]
    other = jaccard_join.signatures([np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))], np.zeros(0, np.uint64))[1]
    assert len(alone) > 3 * (2 * len(u) // 7 // (apart + 1)) and not len(np.intersect1d(alone, other))


def test_near_duplicates_removed_keeps_one(spark):
    rows = near_texts(5)
    want = components(rows)
    kept = {r["doc_id"] for r in jaccard_join.near_duplicates_removed(docs_of(spark, rows)).collect()}
    assert kept == set(want.values())


def test_near_duplicates_removed_judges_rows(spark):
    a, b = "a b c d e f g h", "q r s t u v w x y"
    rows = [(1, a), (2, a), (2, b), (3, b + " z z1 z2"), (None, a), (None, "lone text of its own here"), (None, None), (None, None), (4, "twice the same row stands here"), (4, "twice the same row stands here"), (5, " ")]
    df = docs_of(spark, rows).withColumns({c: F.lit("x") for c in ("id", "key", "comp", "g_id", "g_key", "n")})
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in jaccard_join.near_duplicates_removed(df).collect()))
    assert got == sorted([(1, a), (2, b), (3, b + " z z1 z2"), (0, "lone text of its own here"), (0, ""), (0, ""), (4, "twice the same row stands here"), (5, " ")])


def test_near_duplicates_of_a_very_long_text(spark):
    rng = random.Random(11)
    w = words(rng, 120_000)
    v = list(w)
    for i in range(0, len(v), 100):
        v[i] = "other"
    rows = [(7, " ".join(w)), (3, " ".join(v)), (5, " ".join(w[:50_000]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs_of(spark, rows)).collect()}
    assert got == {3: 3, 7: 3, 5: 5}


def test_empty_null_repeated_and_extra_columns(spark):
    assert jaccard_join.jaccard_components(docs_of(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "x")]
    df = docs_of(spark, rows).withColumn("id", F.lit("clash")).withColumn("cls", F.lit(1)).withColumn("sig", F.lit(None).cast("string"))
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard_join.jaccard_components(df).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1), (2, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_long_repeats_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(words(rng, n)) for n in (90, 110, 200, 400)]
    rows = []
    for i in range(40):
        parts = [" ".join(words(rng, rng.randint(0, 80))), rng.choice(pool)[rng.randint(0, 60) :], " ".join(words(rng, rng.randint(0, 90)))]
        rows.append((i, rng.choice(["", "ä", "ab" * 500]).join(parts)))
    rows += [(100, None), (101, ""), (102, "z" * 900), (103, rows[0][1]), (103, rows[0][1]), (104, "y" * 399), (105, "ü" * 300)]
    got = suffix_dedup.long_repeats_removed(docs_of(spark, rows)).collect()
    want = sorted((i, *k) for (i, _), k in zip(rows, kept_bytes([t for _, t in rows]), strict=True))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_long_repeats_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = suffix_dedup.long_repeats_removed(docs).collect()
    want = sorted((i, *k) for (i, _), k in zip(rows, kept_bytes([t for _, t in rows]), strict=True))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_long_repeats_cross_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = random.Random(9)
    a = " ".join(words(rng, 500))
    rows = [(1, a), (2, a[301:1800] + "!" + a[200:900]), (3, " ".join(words(rng, 300)))]
    got = suffix_dedup.long_repeats_removed(docs_of(spark, rows)).collect()
    want = sorted((i, *k) for (i, _), k in zip(rows, kept_bytes([t for _, t in rows]), strict=True))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_long_repeats_empty_table(spark):
    assert suffix_dedup.long_repeats_removed(docs_of(spark, [])).count() == 0


TRICKY = [
    "mail a.b+c@x.com, d@e f@g.h.i@j.k @q.r x@@y.z u@v.w.", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3 0001.2.3.4 1.2.3.4.", "4111 1111 1111 1111 and 4111-1111-1111-1112 12345678901234567890",
    "+1 (988) 555-2485 +12 +1-2 +12345678 ++1 2345678 +1 23456789012345678", "", None, "é😀 a@b.cd 1.1.1.1", "9" * 6000 + "." + "1.1.1", "a" * 5000 + "@" + "b." * 3000 + "c", "+1" + " " * 5000 + "2345678",
]


def test_base_spans_equal_the_patterns():
    for t in TRICKY:
        if t and len(t) < 5000:
            assert sorted(pii.base_spans(t)) == sorted(base_spans(t)), t
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("12345 .@+-()ab ") for _ in range(rng.randint(0, 60)))
        assert sorted(pii.base_spans(t)) == sorted(base_spans(t)), t


def test_pii_query_columns(spark):
    import hashlib

    rows = [*enumerate(TRICKY), (3, TRICKY[3]), (None, TRICKY[0])]
    got = {(r["doc_id"], r["spans"]): r for r in pii.find_pii(docs_of(spark, rows)).collect()}
    for i, t in rows:
        want = pii.spans_text(pii.base_spans(t or ""))
        r = got[i, want]
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_ip"] == want.count("ip:") and r["n_email"] == want.count("email:")


def test_pii_patterns_find_unseen_identifiers(spark):
    rng = random.Random(7)
    rows = [(i, f"{' '.join(words(rng, 5))} contact mail: user{i}@host{i}.org {' '.join(words(rng, 5))} my phone: +1 555 0{i:02d} 12{i:02d}") for i in range(20)]
    rows += [(50, "my phone: (555) 123-9999 and so on"), (51, "contact mail: jane [at] site [dot] org ok"), (52, "order no. 555 123 9999 99")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs_of(spark, rows)).collect()}
    assert got[50] == "phone:10:24"
    assert got[51].startswith("email:14:")
    assert got[52] == ""
    cleaned = {r["doc_id"]: r["text"] for r in pii.pii_redacted(docs_of(spark, rows)).collect()}
    assert cleaned[50] == "my phone: <PHONE> and so on" and cleaned[52] == rows[-1][1]
    assert "user3@" not in cleaned[3] and "<EMAIL>" in cleaned[3]


def test_thousands_of_equal_rows_share_their_runs(spark):
    """Each run of a text counts once however many rows repeat it, so work grows with the rows and not with their square."""
    import time

    rng = random.Random(17)
    text = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(600))
    alone = " ".join("".join(rng.choices("klmnopqrst", k=6)) for _ in range(300))
    rows = [(1, text, "en", "s", 1)] * 3000 + [(2, text[:2000] + alone, "en", "s", 1), (3, alone + "x", "en", "s", 1)]
    began = time.time()
    got = suffix_dedup.long_repeats_removed(spark.createDataFrame(rows, DOCS)).collect()
    assert time.time() - began < 120
    want = kept_bytes([text, text[:2000] + alone, alone + "x", text])
    assert len(got) == 3002 and {tuple(r)[1:] for r in got if r["doc_id"] == 1} == {want[0]}
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] != 1} == {2: want[1], 3: want[2]}
