import hashlib
import re

from pyspark.sql import functions as F

from cadenza.llm import pii

TEXTS = [
    "a@b.c_d@e.f", "a@b@c.d x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "5500000000000004",
    "+1 (988) 555-2485. +12 +123456789012345678 call (212) 555-1234 x", "😀 é a.b@c.de 😀 10.0.0.1", None, "", "joe (at) foo (dot) com", " tel: 212-555-1234", "@.+", "x" * 200_000, "1" * 200_000, "+1 " * 30_000, "a@b.cc" + "\n" * 3 + "+49 (0) 30-123456",
]
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_base_spans(spark):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, found string, base int")
    got = {r["doc_id"]: r for r in pii.digested(docs).collect()}
    assert len(got) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        if len(text or "") > 100_000:
            continue  # the reference patterns take quadratic time there
        want = base(text or "")
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert set(want) <= set(got[k]["spans"].split(","))
        assert [got[k][f"n_{kind}"] for kind in pii.KINDS] == [sum(s.startswith(kind) for s in want) for kind in pii.KINDS]
    assert "email:0:22" in got[9]["spans"] and "phone:6:18" in got[10]["spans"]  # what the method adds
    assert got[12]["spans"] == got[13]["spans"] == ""
    assert pii.digested(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, TEXTS[0], 11, "k"), (2, TEXTS[6], None, "k"), (3, None, 5, "k"), (4, "clean text 12", 13, "k")], "doc_id long, text string, n_chars int, kind string")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redacted(docs).collect()}
    assert got == {1: ("<email><email>", 14), 2: ("😀 é <email> 😀 <ip>", 18), 3: (None, None), 4: ("clean text 12", 13)}
    assert pii.redacted(docs).dtypes == docs.dtypes


def test_redaction_hands_on_columns_that_clash(spark):
    long = "x " * 100_000 + "a.b@c.de" + " y" * 100_000
    data = [(1, TEXTS[0]), (1, TEXTS[0]), (None, TEXTS[6]), (4, ""), (5, None), (6, long)]
    names = ["found", "row", "covered", "__text", "__own", "__p0", "__base", "__wide", "odd.name", "start"]
    docs = spark.createDataFrame([(d, *range(len(names)), t) for d, t in data], f"doc_id long, {', '.join(f'`{n}` int' for n in names)}, text string")
    got = pii.redacted(docs)
    assert got.dtypes == docs.dtypes
    rows = got.collect()
    assert all([*r][1:-1] == list(range(len(names))) for r in rows)
    assert sorted((r["doc_id"] or 0, r["text"] or "-") for r in rows) == sorted([(1, "<email><email>"), (1, "<email><email>"), (0, "😀 é <email> 😀 <ip>"), (4, "-"), (5, "-"), (6, long.replace("a.b@c.de", "<email>"))])
    assert pii.redacted(docs.limit(0)).count() == 0 and pii.digested(docs).count() == len(data)


def test_numbers_inside_a_failed_card(spark):
    texts = [*(t for t in TEXTS if len(t or "") < 1000), "212-555-1234 312-555-9876", "212-555-1234 2024", "tel 4111 1111 1111 1111 and +1 988 555 2485"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = [r["spans"] for r in pii.digested(docs).orderBy("doc_id").collect()][-3:]
    assert got == ["phone:0:12,phone:13:25", "phone:0:12", "card:4:23,phone:28:43"]
    assert [r["text"] for r in pii.redacted(docs).orderBy("doc_id").collect()][-3:] == ["<phone> <phone>", "<phone> 2024", "tel <card> and <phone>"]


def test_overlaps_are_resolved_after_the_decision(spark):
    spans = [(0, 20, False, "a"), (0, 12, False, "b"), (13, 20, True, "c"), (15, 25, False, "d"), (30, 40, False, "no"), (32, 38, False, "e")]
    found = [(s, pii.KINDS.index("phone"), e, "phone", b, p) for s, e, b, p in spans]
    rows = spark.createDataFrame([(found,), ([],)], "found array<struct<start:int,rank:int,end:int,kind:string,base:boolean,pattern:string>>")
    got = [[x["pattern"] for x in r[0]] for r in rows.select(pii._taken(F.col("found"), [f"phone:{p}" for p in "abcde"])).collect()]
    assert sorted(got) == [[], ["a", "c", "d", "e"]]


def test_learning():
    counts = [("phone", "yy-ymbp", 100), ("phone", "nn-nsaq", 200), ("phone", "nyyymbp", 20), ("email", "yy-ylaq", 50)]
    known = pii.reliabilities(counts)
    assert known["phone"][1][0]["y"][1] > known["phone"][1][0]["y"][0]
    assert set(pii.accepted(counts)) == {"phone:yy-ymbp", "phone:nyyymbp", "email:yy-ylaq"} and pii.accepted([]) == []
