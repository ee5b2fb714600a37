import random

import pytest

from facetry.llm.ordered import running
from facetry.llm.urls import judge_urls

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
PAGES = "page_id bigint, url string, html string, host int, path int, key string, rule string, level int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    return host.translate(LOWER), path


def judged(url, rules, default="allow"):
    host, path = parts(url)
    fits = [
        (len(h) + len(p), len(h), v == "block", h, p, v)
        for h, p, v in rules
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if not fits:
        return host, path, None, default
    _, _, _, h, p, v = max(fits)
    return host, path, h + p, v


def pages_of(spark, urls, ids=None):
    ids = list(range(len(urls))) if ids is None else ids
    return spark.createDataFrame([(i, u, "<p>", 1, 2, "k", "r", 3) for i, u in zip(ids, urls, strict=True)], PAGES)


def check(spark, urls, rules, ids=None, default="allow"):
    known = spark.createDataFrame(rules, "host string, path string, verdict string")
    ids = list(range(len(urls))) if ids is None else ids
    got = judge_urls(pages_of(spark, urls, ids).repartition(3), known, default).collect()
    cleaned = [((h or "").translate(LOWER), p or "", v) for h, p, v in rules]
    expected = [(i, *judged(u, cleaned, default)) for i, u in zip(ids, urls, strict=True)]
    found = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_random_rules_as_brute_force(spark):
    r = random.Random(11)
    labels, steps = ["a", "b", "net", "x-y", "", "é", "A"], ["a", "ab", "b", "é", "", "c%20"]

    def host():
        return ".".join(r.choice(labels) for _ in range(r.randint(1, 4)))

    def path():
        return "".join("/" + r.choice(steps) for _ in range(r.randint(0, 4)))

    urls = [f"{r.choice(['http', 'x'])}://{host()}{path()}{r.choice(['', '?q=/a', '#/b', '?'])}" for _ in range(400)]
    rules = [(host(), path(), r.choice(["allow", "block"])) for _ in range(60)]
    check(spark, urls, rules)


def test_odd_urls_and_rules(spark):
    urls = [
        None,
        "",
        "no scheme/a",
        "://",
        "http://",
        "HTTP://WWW.Example.NET/En/a",
        "http://example.net",
        "http://notexample.net/a",
        "http://example.net:80/a",
        "http://user@example.net/a",
        "http://a.b.c.example.net/a/b/c?x#y",
        "http://a\n.net/p\n/q",
        "http://x/" + "a/" * 20_000,
        "http://" + "s." * 5_000 + "example.net/a",
        "http://one://two/three",
        "http://É.net/É",
    ]
    rules = [
        ("EXAMPLE.net", "/", "block"),
        ("example.net", "/a", "allow"),
        ("net", "/aaaaaaaaa", "block"),
        ("c.example.net", "/a/b", "block"),
        ("b.c.example.net", "/a/", "allow"),  # one character less of path, one more of host
        ("b.c.example.net", "/a/", "block"),
        ("x", "/" + "a/" * 10_000, "block"),
        ("x", "/a", "allow"),
        ("bad/host", "/", "block"),
        ("net", "/?", "block"),
        (None, "/three", "block"),
        ("two", None, "block"),
        ("é.net", "", "block"),
    ]
    check(spark, urls, rules)
    check(spark, urls, [], default="block")
    check(spark, [], rules)


def test_ties_of_length_and_repeated_rows(spark):
    # The same length in all: the rule with the longer host wins.
    check(spark, ["http://ab.cd/efg/h", "http://ab.cd/efg"], [("cd", "/efg", "block"), ("ab.cd", "/", "allow")])
    check(spark, ["http://h/a"] * 50 + ["http://h/b"] * 2, [("h", "/a", "block")], ids=[None] * 10 + [7] * 42)


def test_nested_rules_over_many_ranges(spark):
    # Far more active rules than ranges, so that every range begins inside many of them.
    depth = 40
    hosts = [".".join(f"l{j}" for j in range(k, -1, -1)) for k in range(depth)]
    rules = [(h, "/", "block" if i % 2 else "allow") for i, h in enumerate(hosts)]
    rules += [("l0", "/" + "p" * k, "block" if k % 2 else "allow") for k in range(1, 120)]
    check(spark, [f"http://z.{h}/{'p' * (7 * i % 130)}" for i, h in enumerate(hosts)], rules)


@pytest.mark.parametrize("kind", ["sum", "xor", "max"])
def test_running_totals_as_brute_force(spark, kind):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.6 else f"g{r.randint(0, 5)}", i, r.randint(-99, 99)) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, place int, v bigint").repartition(3)
    got = {(x["g"], x["place"]): x["total"] for x in running(frame, ["g"], ["place"], {"total": (kind, "v")}).collect()}
    add = {"sum": lambda a, b: a + b, "xor": lambda a, b: a ^ b, "max": max}[kind]
    so_far, expected = {}, {}
    for g, place, v in sorted(rows):
        so_far[g] = add(so_far[g], v) if g in so_far else v
        expected[g, place] = so_far[g]
    assert got == expected
