"""Language identification, quality and URL filters."""

import math
import random
import re
import zlib

import numpy as np
import regex

from cadenza.llm import language, quality, url_filter
from cadenza.llm.shared import bucket

WORDS = {"en": "the and of with that this from have there which".split(), "de": "der die und nicht mit sich auch eine über für".split(), "fr": "le la et les des que dans une être très".split()}


def documents(n=240):
    rng = random.Random(1)
    return [(k, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 40))), lang, "src", "x") for k in range(n) for lang in [rng.choice(sorted(WORDS))]]


SCHEMA = "doc_id long, text string, lang string, source string, score string"


def test_language_on_held_out_rows(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"]: r for r in language.identified(docs, bins=1 << 12).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert len(held) > 20 and sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.98 * len(held)
    assert got.keys() == {r[0] for r in rows} and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_does_not_see_other_columns(spark):
    rows = documents(60)
    a = language.identified(spark.createDataFrame(rows, SCHEMA), bins=1 << 12)
    fold = {r["doc_id"]: r["h"] for r in spark.createDataFrame(rows, SCHEMA).select("doc_id", (bucket("doc_id", 4) == 2).alias("h")).collect()}
    changed = [(d, t, "zz" if fold[d] else lang, "other", s) for d, t, lang, _, s in rows]
    b = language.identified(spark.createDataFrame(changed, SCHEMA), bins=1 << 12)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


def test_language_edges(spark):
    rows = documents(60) + [(900, None, "en", None, None), (901, "", "en", None, None), (902, "123 456 !?", None, None, None), (903, "the and " * 60_000, None, None, None), (None, "the and of", None, None, None), (904, "der und", "de", None, None), (904, "der und", "de", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identified(docs, bins=1 << 12).collect()]
    assert len(got) == len(rows) and {(900, "und", 0.0), (901, "und", 0.0), (902, "und", 0.0)} <= set(got)
    assert dict((d, p) for d, p, _ in got)[903] == "en"
    assert {p for _, p, _ in ((r["doc_id"], r["lang_pred"], 0) for r in language.identified(docs.withColumn("lang", docs["source"].substr(1, 0)).where("source is null")).collect())} == {"und"}
    assert language.identified(docs.limit(0)).count() == 0
    kept = language.recognised(docs, bins=1 << 12)
    assert kept.dtypes == docs.dtypes and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {900, 901, 902}


def naive_grams(text, bins):
    """The bins of a text's n-grams, character by character: orders 1 to 3 that begin at one of its characters or at the two spaces before it."""
    shift = 32 - bins.bit_length() + 1
    padded = [ord(c) for c in f"  {text}   "]
    for at in range(len(text) + 2):
        run = 0
        for order, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
            run = (run * 0x01000193 & 0xFFFFFFFF) ^ (padded[at + order] * m & 0xFFFFFFFF)
            yield ((run ^ run >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> shift


def test_language_against_naive_counts_and_scores(spark):
    bins, rows = 1 << 10, documents(120) + [(500, "\u0301", "en", None, None), (501, "e\u0301 1 THE", "en", None, None), (502, "x", None, None, None)] + [(600 + k, "the and of", "en", "s", "x") for k in range(60)]
    clean = lambda t: regex.sub(r"[^\pL\pM]+", " ", t.lower()).strip(" ") if regex.search(r"\pL", t.lower()) else ""
    counts, many = {}, {}
    for doc, text, lang, *_ in rows:
        if lang and clean(text) and zlib.crc32(str(doc).encode()) % 4 != 2:
            many[lang] = many.get(lang, 0) + 1
            own = counts.setdefault(lang, [0] * bins)
            for g in naive_grams(clean(text), bins):
                own[g] += 1
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = language.trained(docs.where(bucket("doc_id", 4) != 2), bins)
    assert model.languages == sorted(many) and np.allclose(model.prior, [math.log(many[k] / sum(many.values())) for k in sorted(many)])
    for k, lang in enumerate(sorted(many)):
        total = sum(counts[lang])
        want = np.log((np.array(counts[lang]) + 0.5) / (total + 0.5 * bins))
        assert np.abs(model.matrix[k] - want).max() < 1e-5
    got = {r["doc_id"]: r for r in language.identified(docs, bins=bins).collect()}
    assert (got[500]["lang_pred"], got[500]["score"]) == ("und", 0.0)
    for doc, text, *_ in rows:
        if clean(text):
            logs = [model.prior[k] + sum(float(model.matrix[k][g]) for g in naive_grams(clean(text), bins)) for k in range(len(model.languages))]
            top = max(logs)
            sure = 1 / sum(math.exp(x - top) for x in logs)
            assert abs(got[doc]["score"] - sure) < 1e-4 and (got[doc]["lang_pred"] == model.languages[logs.index(top)] or sure < 0.6)


def test_recognised_rejects_what_no_language_explains(spark):
    rows = [(d, t, lang, s, x) for d, t, lang, s, x in documents(200)]
    odd = [(900, "".join(chr(0x4E00 + 37 * k % 20000) for k in range(300)), None, None, None), (901, "\u0301", "en", None, None), (902, "the", None, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], SCHEMA + ", `text 2` int, __raw int").repartition(3)
    kept = language.recognised(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} | {902}


def quality_rows(n=300):
    rng = random.Random(2)
    rows = []
    for k in range(n):
        good = rng.random() < 0.6
        text = " ".join(rng.choices([f"w{j}" for j in range(400)], k=60)) if good else " ".join([rng.choice(["buy", "###", "click"])] * 20 + rng.choices([f"w{j}" for j in range(400)], k=15))
        rows.append((k, text, len(text), int(good)))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = quality_rows()
    docs, labels = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, n_chars long"), spark.createDataFrame([(r[0], r[3], 0) for r in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classified(docs, labels).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert len(held) > 50 and sum(got[r[0]]["predicted"] == r[3] for r in held) >= 0.95 * len(held)
    assert all((r["predicted"] == 1) == (r["score"] >= 0.5) for r in got.values())


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", 0), (None, "x y", 3), (3, "word " * 100_000, 500_000), (3, "a", 1)], "doc_id long, text string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.classified(docs, none).collect()] == [0.5] * 5
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (3, 0), (77, 1)], "doc_id long, quality int")
    assert quality.classified(docs, odd).count() == 5 and quality.classified(docs.drop("n_chars"), odd).count() == 5 and quality.classified(docs.limit(0), odd).count() == 0


def test_quality_learns_from_one_row_of_a_repeated_document(spark, monkeypatch):
    rows = [(1, "word " * 20, 100, 7)] * 3000 + [(2, "other " * 20, 120, 7), (3, "word other", 10, 7)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, label int").repartition(6), spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.Machine, "fit", lambda self, rows, **_: seen.append(len(rows)))
    quality.trained(docs, labels, quality.F.lit(True))
    assert seen == [4]


def test_sum_of_squares():
    import numpy as np

    m = quality.Machine(bins=16, rank=3)
    m.linear[:] = np.random.default_rng(1).normal(size=len(m.linear))
    idx, val, stats = np.array([1, 5, 9, 2]), np.array([0.5, 0.2, 0.1, 1.0]), np.random.default_rng(2).normal(size=(3, len(quality.STATISTICS)))
    got = m.raw(np.array([0, 3, 3, 4]), idx, val, stats)
    for row, own in enumerate((slice(0, 3), slice(3, 3), slice(3, 4))):
        x = np.zeros(len(m.linear))
        x[idx[own]] = val[own]
        x[m.bins :] = m.scaled(stats)[row]
        pairs = sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in range(len(x)) for j in range(i))
        assert abs(got[row] - (m.bias + m.linear @ x + pairs)) < 1e-9


URLS = [None, "", "abc", "HTTP://Www.Example.NET/en/x?y#z", "http://a.org/fr/", "http://org/fr/x", "http://net/", "http://net", "http://x.example.com/de/a://b/c", "ftp://EXAMPLE.com/de/?#", "x" * 5000 + "://é.net/" + "a/" * 2000, "://net/", "http://fooexample.com/de/", "http://h.net?/en/"]


def expected(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda r: len(r[0]), default=(None, None)))


def test_urls(spark):
    rng = random.Random(4)
    urls = URLS + [f"http://{rng.choice(['a', 'b', 'www'])}.{rng.choice(['example.net', 'example.com', 'x.org', 'net', 'shop.com'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(1, 99)}" for _ in range(200)]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judged(pages).collect()}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        host, path, rule, verdict = expected(url)
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("block", "allow") and verdict in (None, r["verdict"])
    assert url_filter.judged(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judged(pages.where("page_id < 3")).collect()} == {"allow"}
