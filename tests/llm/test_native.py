"""Decontamination, URL filters, surrogates and licences against brute force and by hand."""

import random
import re
from collections import Counter
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from diurna.llm import decontam, licences, urls

SF = "/root/testdata/sf0.01"


def in_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.search("Python|Pandas|Arrow", plan)


def bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def brute(docs, items):
    split = lambda t: re.findall(decontam.WORD, (t or "").lower())
    out = {}
    for d, t in docs:
        w = split(t)
        for i, q in items:
            q = split(q)
            if not q:
                continue
            for k in range(max(1, len(w) - len(q) + 1)):
                a, b = bag(w[k : k + len(q)]), bag(q)
                both = sum((a & b).values())
                s = both / max(1, sum(a.values()) + sum(b.values()) - both)
                if s >= 0.8 and s > out.get((d, i), (0,))[0]:
                    out[d, i] = (s, k)
    return out


def test_contamination(spark, odd, nothing):
    words = [f"w{i}" for i in range(60)]
    near = words[:30] + ["changed"] + words[31:]
    docs = [(1, "before " + " ".join(words).upper() + ". after"), (2, " ".join(near)), (3, " ".join(words[:20])), (4, "short item here, yes"), (5, None), (6, ""), (7, "w1 " * 500), (8, " ".join(words[30:] + words[:30])), (9, "two of these"), (10, "one")]
    items = [(1, " ".join(words)), (2, "Short item here"), (3, ""), (4, None), (5, "w1 " * 30), (6, "one"), (7, " ".join(words))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.matches(d, i)
    assert not in_python(found)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in found.collect()}
    assert got == {k: (round(s, 9), at) for k, (s, at) in brute(docs, items).items()}
    assert sorted(r.doc_id for r in decontam.clean(d, i).collect()) == [x for x, _ in docs if x not in {k[0] for k in got}]
    assert decontam.clean(odd, i.limit(0)).count() == odd.count() and decontam.matches(nothing, i).count() == 0
    assert decontam.clean(odd, i).columns == odd.columns


def test_blocks_meet_within_the_radius(spark):
    rng = random.Random(1)
    pairs = []
    for distance in range(decontam.RADIUS + 1):
        for _ in range(30):
            a = rng.getrandbits(64)
            pairs.append((a, a ^ sum(1 << i for i in rng.sample(range(64), distance))))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long").repartition(4)
    met = F.arrays_overlap(decontam.looked_up(F.lit(7), F.col("a")), decontam.entered(F.lit(7), F.col("b")))
    assert df.where(~met).count() == 0
    assert df.where(F.arrays_overlap(decontam.looked_up(F.lit(8), F.col("a")), decontam.entered(F.lit(7), F.col("b")))).count() == 0  # of another size
    far = [(signed(rng.getrandbits(64)), signed(rng.getrandbits(64))) for _ in range(600)]
    assert spark.createDataFrame(far, "a long, b long").where(met).count() < 200


def test_items_equal_in_id_and_unknown_documents(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(None, " ".join(words)), (1, " ".join(words)), (1, " ".join(words)), (1, "x " + " ".join(words[:29]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (1, "quite another item of eight words it is"), (None, " ".join(words))], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, round(r.similarity, 3)) for r in decontam.matches(docs, items).collect()), key=str)
    assert got == sorted([(d, i, x) for i in (1, None) for d, x in ((None, 1.0), (1, 1.0), (1, round(25 / 27, 3)))], key=str)


def test_reordered_passages_inside_longer_texts(spark):
    words = [f"w{i}" for i in range(60)]
    around = lambda w: " ".join([f"a{i}" for i in range(25)] + w + [f"z{i}" for i in range(25)])
    docs = [(1, around(words[30:] + words[:30])), (2, around(words[20:] + words[:20])), (3, around(words[20:40] + words[:20])), (4, around(words[7:] + words[:7]) * 2), (5, around(words[15:30] + words[:15] + words[45:] + words[30:45]))]
    docs += [(None, docs[0][1]), (6, " ".join(words[10:] + words[:5])), (7, around(words[:31] + ["x"] + words[31:]))]
    items = [(1, " ".join(words)), (2, " ".join(words[:40])), (3, " ".join(words[:9] * 4))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in decontam.matches(d, i).collect()}
    assert got == {k: (round(s, 9), at) for k, (s, at) in expected.items()} and {(1, 1), (2, 1), (3, 2)} <= set(got)


def test_decontamination_of_the_tables(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE n_chars < 3000").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    shared = {g for _, q in items for g in bag(re.findall(decontam.WORD, q.lower()))}
    docs = [(d, t) for d, t in docs if shared & set(bag(re.findall(decontam.WORD, t.lower())))]
    got = {(r.doc_id, r.item_id) for r in decontam.op4_decontaminate(spark, SF).collect()}
    assert got >= set(brute(docs, items)) and {d for d, _ in got} & {d for d, _ in docs} == {d for d, _ in brute(docs, items)}


def licence_rows(texts):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for d, t in texts:
        w = re.findall(licences.WORD, (t or "").translate(up))
        places = [(k, label) for p, label in licences.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        out.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    return sorted(out, key=str)


def test_licence_phrases(spark, odd, nothing):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    texts += [(100, "MIT License mit-license; Mit LICENSE"), (101, "cc by cc by cc-by"), (102, "GNU General Public\nLicense and Apache  License"), (103, "mit licenseé mitlicense mit x license"), (104, "mit license"), (104, "mit license"), (105, "MIT Licenſe cc bY CC By")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = licences.summary(licences.scan(docs))
    assert not in_python(out)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out.collect()), key=str) == licence_rows(texts)
    assert licences.summary(licences.scan(odd)).count() == odd.count() and licences.summary(licences.scan(nothing)).count() == 0


def test_licence_passages(spark):
    text = licences.PASSAGES[5][0]
    words = text.split()
    put_in = " ".join(words[:9] + ["very"] + words[9:])
    half = " ".join(words[:10])
    docs = spark.createDataFrame([(1, text), (2, f"x {put_in} y"), (3, half), (4, "licensed under the gnu general public license version 2")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels) for r in licences.summary(licences.scan(docs)).collect()}
    assert got == {1: ("mit", ""), 2: ("mit", ""), 3: ("", ""), 4: ("gpl,gpl-2.0", "gpl")}


def test_url_filters(spark):
    day = lambda d: datetime(2024, 1, d)
    entries = spark.createDataFrame(
        [("a", "example.com", "block", day(2)), ("a", "example.com", "remove", day(4)), ("b", "good.example.com", "allow", day(1)), ("a", "good.example.com", "block", day(3)), ("a", None, "block", day(1)), ("a", "x.org", "block", None)],
        "list string, pattern string, action string, listed_at timestamp",
    )
    rows = [(1, "https://EXAMPLE.com:80/x", day(1)), (2, "http://u@www.example.com/", day(2)), (3, "http://example.com.", day(4)), (4, "http://good.example.com", day(2)), (5, "http://good.example.com", day(3)), (6, None, day(2)), (7, "nothing", day(2)), (8, "http://notexample.com", day(2)), (9, "http://example.com", None), (2, "http://u@www.example.com/", day(2))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, fetched_at timestamp, pattern string")
    out = urls.decide(pages, entries)
    assert not in_python(out)
    got = sorted((r.page_id, r.action, r.pattern) for r in out.collect())
    assert got == [(1, "none", None), (2, "block", "example.com"), (2, "block", "example.com"), (3, "none", None), (4, "allow", "good.example.com"), (5, "block", "good.example.com"), (6, "none", None), (7, "none", None), (8, "none", None), (9, "none", None)]
    assert urls.decide(pages.limit(0), entries).count() == 0 and urls.decide(pages, entries.limit(0)).where("action <> 'none'").count() == 0


@pytest.mark.parametrize("rows", [200_000, 0])
def test_url_ties_deep_hosts_and_addresses(spark, monkeypatch, rows):
    monkeypatch.setattr(urls, "BROADCAST_ROWS", rows)  # with 0 the intervals are shuffled
    day = datetime(2024, 1, 1)
    entries = [("spam2", "x.org", "block"), ("spam", "x.org", "block"), ("a", "x.org", "allow"), ("z", "b.c.d.e.f.g.h.i.org", "block"), ("ip", "2001:db8::1", "block"), ("ip", "1", "block"), (None, "y.org", "allow")]
    entries = spark.createDataFrame([(a, b, c, day) for a, b, c in entries], "list string, pattern string, action string, listed_at timestamp")
    names = ["http://x.org", "http://a.b.c.d.e.f.g.h.i.org/", "http://[2001:db8::1]:80/x", "http://u@v@[2001:DB8::1]", "http://y.org", "http://" + "a." * 300 + "x.org", "http://[::1]"]
    got = urls.decide(spark.createDataFrame([(i, u, day) for i, u in enumerate(names)], "page_id long, url string, fetched_at timestamp"), entries).orderBy("page_id").collect()
    assert [(r.list, r.action) for r in got] == [("spam", "block"), ("z", "block"), ("ip", "block"), ("ip", "block"), (None, "allow"), ("spam", "block"), (None, "none")]
    assert got[2].host == "2001:db8::1"


def test_url_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    expected = sorted(map(str, con.execute(f"SELECT page_id, host, fetched_at, list, pattern, action, since FROM ({urls.ORACLE})").fetchall()))
    assert sorted(str(tuple(r)) for r in urls.op6_url_filter(spark, SF).select("page_id", "host", "fetched_at", "list", "pattern", "action", "since").collect()) == expected
