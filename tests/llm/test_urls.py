from llm_helpers import rows_of
from pyspark.sql import functions as F

from procsig.llm.urls import RULES, match_rules, mine_rules, op10_url_filters, url_filter
from procsig.sources.tables import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut].translate(LOWER), rest[cut:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [h + p for h, p, _ in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


URLS = [None, "", "no scheme", "http://", "http://com", "http://COM/", "https://a.example.com/en/x?y#z", "https://www.example.com/en/",
        "ftp://x.www.example.com/en/1", "http://notexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://a.net?/es/",
        "http://a.net#/fr/", "http://a://b.net/es/", "http://É.net/fr/x", "http://a.net/de/x\n/y", "http://a.b.net//es/"]


def test_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i % 9 if i % 4 else None, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    pages = pages.withColumn("tokens", F.lit("clash"))
    got = rows_of(url_filter(pages, spark.createDataFrame([], "page_id bigint, bad boolean")), "page_id", "host", "path", "rule", "verdict")
    verdicts = {h + p: v for h, p, v in RULES}
    want = []
    for i, u in enumerate(URLS):
        h, p, r = brute(u)
        want.append((i % 9 if i % 4 else None, h, p, r, verdicts.get(r, "allow")))
    assert got == sorted(want, key=repr)


def test_mined_rules_block(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"http://{'ads' if bad else 'news'}{i % 3}.example.org/{'win' if bad else 'read'}/{i}"))
        if i < 300:
            labels.append((i, bad))
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = url_filter(pages, spark.createDataFrame(labels, "page_id bigint, bad boolean"), min_support=0.02)
    assert rows_of(got.where("verdict = 'block'"), "page_id") == sorted([(i,) for i in range(0, 400, 4)], key=repr)
    assert url_filter(pages.limit(0), spark.createDataFrame(labels, "page_id bigint, bad boolean")).count() == 0


def test_inverted_index_against_brute_force(spark):
    sets = [["a", "b", "c"], ["a"], ["b", "c", "d"], [], ["d", "e"]]
    rules = [(["a", "b"], 0.7), (["d"], 0.8), (["b", "c"], 0.9), (["z"], 1.0), (["a", "e"], 0.6)]
    got = match_rules(spark.createDataFrame([(s,) for s in sets], "tokens array<string>"),
                      spark.createDataFrame(rules, "antecedent array<string>, confidence double"))
    want = []
    for s in sets:
        c = [x for r, x in rules if set(r) <= set(s)]
        if c:
            want.append((s, max(c)))
    assert rows_of(got, "tokens", "confidence") == sorted(want, key=repr)


def test_query_judges_every_page(spark, sf):
    assert op10_url_filters(spark, sf).count() == table(spark, sf, "pages").count()


def test_domain_of_many_subdomains_is_mined(spark):
    domain = lambda i: ("bad.example", "good.example", "bad.com", "fine.com")[i % 4]
    pages = [(i, f"http://{domain(i)}/{i}" if i < 4 else f"http://s{i}.{domain(i)}/{i}") for i in range(1000)]
    labels = [(i, domain(i).startswith("bad")) for i in range(800)]
    got = url_filter(spark.createDataFrame(pages, "page_id bigint, url string"),
                     spark.createDataFrame(labels, "page_id bigint, bad boolean"), rules=())
    assert rows_of(got.where("verdict = 'block'"), "page_id") == sorted([(i,) for i in range(1000) if domain(i).startswith("bad")], key=repr)


def test_repeated_long_urls_end_and_are_mined(spark):
    """Copies of a URL of 40 path words: as one item, not as 2^40 combinations."""
    long = "http://ads.example/" + "/".join(f"w{i}" for i in range(40))
    other = "http://ads.example/" + "/".join(f"w{i}" for i in range(0, 60, 2))
    rows = [(i, long if i < 10 else other if i < 20 else f"http://site{i % 40}.example/a{i % 7}/{i}") for i in range(220)]
    labels = [(i, i < 20) for i in range(200)]
    got = url_filter(spark.createDataFrame(rows + [(500, long), (501, "http://x.example/w1")], "page_id bigint, url string"),
                     spark.createDataFrame(labels, "page_id bigint, bad boolean"), rules=())
    assert rows_of(got.where("verdict = 'block'"), "page_id") == sorted([(i,) for i in [*range(20), 500, 501]], key=repr)


def test_rules_against_all_subsets(spark):
    """FP-growth's rules over items, with support, confidence and lift, against counting every token combination."""
    import itertools
    import random
    r = random.Random(8)
    pages = [(sorted(r.sample("abcdefg", r.randrange(1, 5))), r.random() < 0.2) for _ in range(300)]
    pages = [(t, bad or ("a" in t and "b" in t and r.random() < 0.9) or "g" in t and r.random() < 0.6) for t, bad in pages]
    pages = [(t + ["twin"] if "a" in t else t, bad) for t, bad in pages]
    rules, items = mine_rules(spark.createDataFrame(pages, "tokens array<string>, bad boolean"), 0.02, 0.6, 5, 1.5)
    of = {x["token"]: x["item"] for x in items.collect()}
    assert of["twin"] == of["a"] == "a"
    base, z = sum(b for _, b in pages) / len(pages), 3.0
    want = {}
    for k in range(1, 6):
        for c in itertools.combinations("abcdefg", k):
            hit = [b for t, b in pages if set(c) <= set(t)]
            if sum(hit) < max(5, 0.02 * len(pages)):
                continue
            p, n = sum(hit) / len(hit), len(hit)
            low = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
            if p >= 0.6 and p >= 1.5 * base and low > base:
                want[c] = p
    want = {c: p for c, p in want.items() if not any(want.get(x, 0) >= p for x in itertools.combinations(c, len(c) - 1))}
    got = {tuple(x["antecedent"]): x["confidence"] for x in rules.collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want) and want


def test_few_labels_make_no_rules(spark):
    """Bad pages of their own each: one page is no support, whatever the share."""
    rows = [(i, f"http://host{i}.example/p{i}") for i in range(100)]
    labels = [(i, i % 4 == 0) for i in range(98)]
    got = url_filter(spark.createDataFrame(rows, "page_id bigint, url string"),
                     spark.createDataFrame(labels, "page_id bigint, bad boolean"), rules=())
    assert got.where("verdict = 'block'").count() == 0
