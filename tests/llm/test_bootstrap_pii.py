import hashlib
import random
import re

import pytest

from intervalis.llm import bootstrap_pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return spans


CARDS = ["4337166598464399", "4041 8949 7460 8795", "4944-3394-9042-9605"]
FIXED = ["", None, "a@b", "a@b.c", "a@@b.c x.y@z.w.", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.255", "0000000001.2.3.4", "1.2.3.4-5", "+1 (988) 555-2485.", "+12 34", "++1 23 45 678", "é+1 555 123 4567é", "x@y.z" * 50, *CARDS, "4337166598464399 1", " 4337166598464398", "-.@-.-", "%@1.2.3.4", "\U0001f600 bob@x.org"]


def test_base_spans_equal_the_rules():
    rnd = random.Random(2)
    texts = FIXED + ["".join(rnd.choice("12.@a-+ (é)%") for _ in range(40)) for _ in range(5000)] + [" ".join(rnd.choice([*CARDS, "1.2.3.4", "b@c.d", "+1 23 456 789", "x", "7"]) for _ in range(9)) for _ in range(500)]
    for text in texts:
        assert P.joined([(k, s, e) for k, v in P.base_spans(text or "").items() for s, e in v]) == P.joined(brute(text)), text


def test_query_rows(spark):
    rows = [(i, t) for i, t in enumerate(FIXED)] + [(None, "mail bob@x.org"), (3, "a@b.c"), (3, "a@b.c"), (99, "w " * 50_000 + "bob@x.org")]
    found = P.find_pii(spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, kind string").repartition(2)).collect()
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in found)
    want = []
    for i, t in rows:
        b = brute(t)
        j = P.joined(b)
        want.append((str(i), *(sum(x[0] == k for x in b) for k in P.KINDS), hashlib.sha256(j.encode()).hexdigest(), j))
    assert got == sorted(want)


def test_confident_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"word word please write to user{i}@mail.example.com for details word") for i in range(8)]
    rows += [(20 + i, f"her phone number is +1 555 010 {2000 + i} since may") for i in range(8)]
    rows += [(40, "word please write to user[at]mail99 for details word"), (41, "please write to page 12345 of it"), (42, "see chapter 2021 for details word"), (43, "phone number is 555-0100-77 since may")]
    rows += [(50 + i, f"order item no{i}x7 was sent") for i in range(5)]
    found = {r.doc_id: r for r in P.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for i, kind, word in ((40, "email", "user[at]mail99"), (43, "phone", "555-0100-77")):
        s = text[i].index(word)
        assert f"{kind}:{s}:{s + len(word)}" in found[i].spans.split(",") and found[i].n_added == 1
    assert all(found[i].n_added == 0 for i in found if i not in (40, 43))


def test_empty_table(spark):
    assert P.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
