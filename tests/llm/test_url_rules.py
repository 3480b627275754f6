import itertools
import random
import re

from intervalis.llm import url_rules as U
from intervalis.llm.queries import URL_RULES

EDGES = [None, "", "no scheme", "://", "http://", "HTTP://Sub.Example.COM", "http://a.com/x?y=1#z", "x://net/es/1", "x://a.net/fr/?q", "x://anet/fr/", "http://www.example.com/en/1", "http://m.www.example.com/en/", "http://example.com/en", "http://h.com?x://y/z", "http://h\n.com/a\nb", "http://É.com/É", "http://com/", "http://com", "http://user@a.com:80/p"]


def parts(url):
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    if not m:
        return "", "", ""
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2], m[3] or ""


def tokens(url):
    host, path, query = parts(url)
    fix = lambda p, x: p + re.sub(r"[ \t\n\x0b\f\r]", "_", re.sub("[0-9]+", "0", x))
    return {fix("host:", x) for x in host.split(".") if x} | {fix("path:", x) for x in path.split("/") if x} | {fix("arg:", x.split("=")[0]) for x in query.split("&") if x.split("=")[0]}


def brute_rules(labelled, support, confidence, lift):
    n, sets = len(labelled), [(tokens(u), v) for u, v in labelled]
    out = {}
    universe = sorted(set().union(*(s for s, _ in sets)))
    for size in range(1, 6):
        for combo in itertools.combinations(universe, size):
            covered = [v for s, v in sets if s.issuperset(combo)]
            for verdict in ("allow", "block"):
                both = covered.count(verdict)
                if both >= support * n and both / len(covered) >= confidence and both / len(covered) / (sum(v == verdict for _, v in sets) / n) >= lift:
                    out[combo, verdict] = (both / len(covered), both / n)
    return {k: v for k, v in out.items() if not any(k2[1] == k[1] and set(k2[0]) < set(k[0]) and v2[0] >= v[0] for k2, v2 in out.items())}


def corpus(seed):
    rnd = random.Random(seed)
    urls = [f"https://{rnd.choice(['a', 'b', 'c'])}.site.{rnd.choice(['com', 'org'])}/{rnd.choice(['news', 'casino', 'shop'])}/{rnd.randrange(100)}" + rnd.choice(["", "?ref=1", "?utm=2&ref=3"]) for _ in range(150)]
    return urls, [(u, ("block" if ("casino" in u) != (rnd.random() < 0.05) or "b.site.org" in u else "allow")) for u in urls[:100]]


def test_verdicts_equal_brute_force(spark):
    urls, labelled = corpus(4)
    rows = list(enumerate(urls + EDGES)) + [(None, urls[0]), (0, urls[0])]
    limits = {"min_support": 0.05, "min_count": 1, "min_confidence": 0.8, "min_lift": 1.05}
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in rows], "page_id long, url string, rule string, tokens string").repartition(3)
    labels = spark.createDataFrame([*labelled, (urls[3], None)], "url string, verdict string")
    rules = brute_rules(labelled, 0.05, 0.8, 1.05)
    assert len(rules) > 1
    want = []
    for i, url in rows:
        host, path, _ = parts(url)
        fixed = max(((len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        fits = [(c, s, len(k), v) for (k, v), (c, s) in rules.items() if tokens(url).issuperset(k)]
        method = max(fits)[3] if fits else "allow"
        want.append((str(i), host, path, fixed[1] if fixed else None, fixed[2] if fixed else method))
    found = [(str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, labels, URL_RULES, **limits).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_no_labels_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "url string, verdict string")
    assert [(r.rule, r.verdict) for r in U.judge_urls(pages, none, URL_RULES).collect()] == [("com/", "allow")]
    assert U.judge_urls(pages.filter("page_id < 0"), none).count() == 0


def test_a_template_of_many_constant_tokens_is_one_item(spark):
    deep = "/".join(f"x{chr(97 + k)}" for k in range(26))
    labelled = [(f"http://trap.net/{deep}/{k}", "block") for k in range(30)] + [(f"http://a.org/{k % 3}/p{'abc'[k % 3]}", "allow") for k in range(60)]
    pages = [(0, f"http://trap.net/{deep}/99"), (1, "http://else.edu/xc"), (2, "http://a.org/pa"), (3, "http://z.edu/"), (4, "http://q.edu/" + "/".join(f"{k}y" for k in range(20_000)))]
    labels, rows = spark.createDataFrame(labelled, "url string, verdict string"), spark.createDataFrame(pages, "page_id long, url string")
    rules = U.mine_rules(labels.select(U.url_tokens(*U.url_parts(U.F.col("url")).values()).alias("tokens"), "verdict"), U.token_classes(labels.select(U.url_tokens(*U.url_parts(U.F.col("url")).values()).alias("tokens"))), min_count=5)
    assert 0 < rules.count() < 20
    assert {r.page_id: r.verdict for r in U.judge_urls(rows, labels, min_count=5).collect()} == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow"}
