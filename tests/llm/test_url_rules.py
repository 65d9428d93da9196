import random
import re
from collections import Counter
from itertools import combinations

from envseries.llm import catalog, url_rules

PAGES = "page_id long, url string"


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [r for r in url_rules.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
            and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def brute_tokens(url):
    if url is None or "://" not in url:
        return frozenset()
    host, path = brute_parts(url)
    out = {"s:" + url.split("://")[0].lower()}
    for kind, text in (("h:", host.rpartition(".")[0]), ("p:", path.lower())):
        out |= {kind + w for w in re.findall(r"[a-z#]+", re.sub("[0-9]+", "#", text))}
    query = re.match(r"[^#]*?\?([^#]*)", url)
    out |= {"q:" + k.split("=")[0] for k in query.group(1).split("&")} if query else set()
    return frozenset(out | ({"f:"} if "#" in url else set()))


def brute_verdicts(urls):
    """Every subset of tokens of the labelled URLs is tried as a rule; nothing is merged, pruned or indexed."""
    rules = [brute_rule(*brute_parts(u)) for u in urls]
    labelled = [(brute_tokens(u), url_rules.RULES[r]) for u, r in zip(urls, rules) if r]
    whole, with_label, prior = Counter(), Counter(), Counter(y for _, y in labelled)
    for tokens, y in labelled:
        for k in range(1, len(tokens) + 1):
            for some in combinations(sorted(tokens), k):
                whole[some] += 1
                with_label[some, y] += 1
    n = len(labelled)
    kept = {}
    for (some, y), both in with_label.items():
        sure = both / whole[some]
        if (both >= url_rules.MIN_ROWS and both >= url_rules.MIN_SUPPORT * n and sure >= url_rules.MIN_CONFIDENCE
                and both * n > whole[some] * prior[y]):
            kept[some, y] = (sure, both, y)
    out = []
    for u, r in zip(urls, rules):
        tokens = brute_tokens(u)
        best = max((v for (some, _), v in kept.items() if tokens.issuperset(some)), default=None) if not r else None
        out.append((*brute_parts(u), r, url_rules.RULES[r] if r else best[2] if best else "allow",
                    best[0] if best else None))
    return out


def got(df):
    return [tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict", "confidence").orderBy("page_id").collect()]


def test_given_pages_equal_brute_force(spark):
    path = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{path}/pages.parquet").select("page_id", "url").orderBy("page_id").collect()
    want = [(p.page_id, *v) for p, v in zip(pages, brute_verdicts([p.url for p in pages]))]
    assert got(catalog.op11_url_association_rules(spark, path)) == want
    assert {v[4] for v in want if v[3] is None} == {"allow", "block"}


def test_random_urls_equal_brute_force(spark):
    """Twins (tokens that always go together among the labelled), hot URLs, ties, tokens seen only outside labels."""
    draw = random.Random(7)
    urls = []
    for _ in range(400):
        site = draw.choice(["spam-farm", "news", "shop", "a.news"])
        host = f"{site}.{draw.choice(['example.net', 'example.com', 'example.org', 'other.net', 'x.io'])}"
        lang = draw.choice(["/en/", "/de/", "/fr/", "/buy/now/", "/"])
        tail = draw.choice(["", "12.html", "?ref=1&pill=2", "#top", "?pill=9"])
        urls.append(f"{draw.choice(['http', 'https'])}://{host}{lang}{tail}")
    urls += ["http://farm.example.com/en/1", "http://spam.example.com/fr/", "https://x.io/now/", "https://x.io/?ref=3"] * 3
    urls += ["https://hot.example.net/en/7"] * 2500
    want = [(i, *v) for i, v in enumerate(brute_verdicts(urls))]
    df = spark.createDataFrame(list(enumerate(urls)), PAGES)
    assert got(url_rules.judged(df)) == want
    assert len({v[5] for v in want}) > 5


def test_hosts_paths_and_awkward_rows(spark):
    urls = [None, "", "no scheme/en/", "http://net", "http://net/", "HTTP://A.Example.NET/EN/x?y#z", "https://example.net/en/",
            "http://notexample.com/de/", "http://x.example.com/de/1", "http://x.org/fr/", "http://org/fr", "://net/x",
            "a://b://net/", "http://example.net?/en/", "http://u@h.net:80/p", "http://é.ORG/fr/é", "x" * 50_000 + "://net/" + "y/" * 20_000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://x.net/"), (1000, "http://x.net/"), (1000, "http://x.net/")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'a' AS tokens", "1 AS n", "'b' AS rule", "2 AS label", "'h' AS host")
    out = url_rules.judged(df)
    found = {(r.page_id, r.host, r.path, r.rule) for r in out.collect()}
    assert found == {(i, *brute_parts(u), brute_rule(*brute_parts(u))) for i, u in rows}
    assert out.count() == len(rows)
    assert out.filter("rule IS NULL AND verdict <> 'allow'").count() == 0  # too few labelled rows for any mined rule


def test_empty_tables_and_given_labels(spark):
    none = spark.createDataFrame([], PAGES)
    assert url_rules.judged(none).count() == 0
    pages = spark.createDataFrame([(1, "http://a.b/x"), (2, "http://a.b/y"), (3, None)], PAGES)
    assert {r.verdict for r in url_rules.judged(pages, rules={}).collect()} == {"allow"}
    labels = spark.createDataFrame([("http://c.d/x", "block")] * 6 + [("http://c.d/y", "allow")] * 6
                                   + [(None, "block"), ("http://c.d/x", None)], "url string, label string")
    out = {r.page_id: (r.verdict, r.evidence) for r in url_rules.judged(pages, {}, labels).collect()}
    assert out == {1: ("block", "p:x"), 2: ("allow", "p:y"), 3: ("allow", None)}
