"""Many rules for one host: nested paths, repeated rules, hosts within hosts, against brute force."""

import random

from loglattice.llm import url_filter

PAGES, RULES = "page_id long, url string", "host string, path string, verdict string"


def expected(url, rules):
    host, _, path = url.removeprefix("http://").partition("/")
    path = "/" + path
    fitting = [(len(h + p), len(h), [-ord(c) for c in v], h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fitting)[3:] if fitting else (None, "allow")


def judged(spark, urls, rules):
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), PAGES), spark.createDataFrame(rules, RULES)).collect()
    assert len(got) == len(urls)
    return {r.page_id: (r.rule, r.verdict) for r in got}


def test_nested_paths(spark):
    rng = random.Random(5)
    part = lambda n: "".join(rng.choices(["a", "b", "/", "é", "\U0001f600"], k=rng.randrange(n)))
    hosts = ["a.com", "b.a.com", "c.b.a.com", "com", "aa.com", "net"]
    rules = [(rng.choice(hosts), rng.choice(["", "/"]) + part(6), rng.choice(["allow", "block"])) for _ in range(400)]
    urls = [f"http://{rng.choice(['', 'x.', 'c.b.'])}{rng.choice(hosts)}/{part(12)}" for _ in range(1500)]
    assert judged(spark, urls, rules) == {i: expected(u, rules) for i, u in enumerate(urls)}


def test_many_rules_for_one_host(spark):
    paths = [f"/{i:05}/" for i in range(20_000)] + [f"/{i:05}/deep/" for i in range(0, 20_000, 2)]
    rules = [("hot.com", p, "block" if i % 3 else "allow") for i, p in enumerate(paths)]
    of_rule = {p: v for _, p, v in rules}
    urls = [f"http://www.hot.com/{i % 20_100:05}/deep/{i}" for i in range(30_000)]
    found = judged(spark, urls, rules)
    for i in range(len(urls)):
        short = f"/{i % 20_100:05}/"
        path = next((p for p in (short + "deep/", short) if p in of_rule), None)
        assert found[i] == (("hot.com" + path, of_rule[path]) if path else (None, "allow"))


def test_longest_asks_few_rules():
    """A page costs the rules nested around its path, not the host's."""
    nested = url_filter.Nested("com.hot.")
    for i in range(100_000):
        nested.add(f"/{i:06}", f"hot.com/{i:06}", "block")
    assert set(nested.outer) == {-1}
    assert nested.longest("/050000/x") == ("hot.com/050000", "block")
    assert nested.longest("/1") is None
