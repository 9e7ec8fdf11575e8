"""Base spans against Python's own matching, and what the classifier adds."""

import hashlib
import re

from tapelab.llm import pii

SF = "/root/testdata/sf0.001"
# fixed values: the base patterns as given
PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        n = [int(c) for c in reversed(d)]
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(n)) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def expected(text):
    out = []
    for i, (kind, p) in enumerate(PLAIN):
        out += [(m.start(), i, m.end(), kind) for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


ODD = [None, "", "a@b", "a@b.c@d.e", "a@b.c_x@y.z", "x@y..z q@w.e.", "é@ü.de mail ñ.a@b-c.org", "1.2.3.4.5.6.7.8", "999.1.1.1 001.02.3.255",
       "00000000000000000000001.2.3.4", "4785380592391139 and 4785 3805-9239 1139, 4785380592391138", "+1 (415) 555-0100 x +49 30 1234567890123",
       "+1+2", "+12 3.4", "call (415) 555-0100 now", "mail: joe (at) example (dot) com", "9" * 6000, "1 " * 4000, "1." * 3000, "a" * 20000 + "@",
       "𝔘𝔫𝔦 a@b.cd 𝔵", "+" * 500 + "1234567890", "12-34-56-78-90-12-34", "a@b.c" * 300]


def check(spark, rows, docs):
    got = sorted(pii.digest(docs).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(rows)
    for r, (i, text) in zip(got, sorted(rows)):
        want = expected(text)
        assert r["doc_id"] == i
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want, r["spans"])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS]
        assert set(want) <= set(r["spans"].split(",") if r["spans"] else [])
    return got


def test_odd_texts(spark):
    rows = list(enumerate(ODD))
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS kind", "1 AS n"))


def test_cards_without_two_adjacent_digits(spark):
    number = "4111111111111111"
    texts = ["card " + " ".join(number), "card " + "-".join(number), "4" + " 1-1" * 7 + " 1", "1 2", "1  2"]
    got = check(spark, list(enumerate(texts)), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r["n_card"] for r in got] == [1, 1, 1, 0, 0]


def test_given_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()], docs)


def test_empty(spark):
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_reliable_labelers_get_more_weight(spark):
    rows = [(0, 1, 1, 1, 1, 80), (0, 0, 0, -1, 1, 80), (0, 1, 1, -1, 0, 20), (0, 0, 0, -1, 0, 20), (3, -1, 1, 1, 1, 10)]
    kinds, votes = pii.estimate(spark.createDataFrame(rows, "kind int, rule int, gazetteer int, context int, edges int, n long"))
    assert votes["rule", 1] > votes["edges", 1] and votes["rule", 0] < votes["edges", 0] and votes["context", 1] > 0


def test_time_grows_with_the_number_of_matches(spark):
    """Tables of numbers and of addresses, 200 kB each; four times the time of a quarter, not sixteen times."""
    import time

    numbers = " | ".join(str(i % 97) for i in range(40_000))
    mails = " ".join(f"u{i}@x{i % 9}.org" for i in range(14_000))
    took = {}
    for name, text in (("warm", "1 a@b.cd 2"), ("numbers", numbers), ("mails", mails)):
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        check(spark, [(1, text)], docs)
        took[name] = time.time() - start
    assert max(took.values()) < 20 + 3 * took["warm"], took


def test_added_spans_are_personal_data(spark):
    """Precision and recall of the added spans against planted ones."""
    texts, planted = [], {}
    for i in range(400):
        if i % 4 == 0:
            texts.append(f"e-mail: name{i} (at) example (dot) com thanks")
            planted[i] = f"email:8:{8 + len(f'name{i} (at) example (dot) com')}"
        elif i % 4 == 1:
            texts.append(f"phone (41{i % 7}) 555-0{100 + i} please")
            planted[i] = "phone:6:20"
        elif i % 4 == 2:
            texts.append(f"write to a{i}@b.org or phone +1 415 555 0{100 + i}")
        else:
            texts.append(f"order 12345678901{i} of item 17, section 3.1.4.1592")
    rows = list(enumerate(texts))
    got = {r["doc_id"]: set(r["spans"].split(",")) - set(expected(texts[r["doc_id"]])) - {""} for r in check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))}
    hits = sum(p in got[i] for i, p in planted.items())
    assert hits >= 0.9 * len(planted) and hits >= 0.9 * sum(map(len, got.values()))
