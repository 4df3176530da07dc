from __future__ import annotations

import random

from tessera.llm.op3_urlfilter import RULES, op3_urlfilter
from tessera.llm.urlfilter import judge


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def rule_of(host, path):
    best = None
    for _, rule in RULES:
        own, tail = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best)):
            best = rule
    return best


def test_rules_against_brute_force(spark):
    rng = random.Random(4)
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}{rng.choice(['://', ':/', '://'])}{rng.choice(['', 'www.', 'WWW.', 'a-b.', 'xwww.'])}{rng.choice(['example', 'Example', 'foo', ''])}{rng.choice(['.', ''])}{rng.choice(['com', 'net', 'NET', 'org', ''])}{rng.choice(['', '/', '/en/', '/es/x', '/fr', '/en'])}{rng.choice(['', '?q=/en/', '#/es/', '://b'])}" for _ in range(800)] + [None, "", "http://ÄÖ.COM/"]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, label int")
    got = judge(df, RULES, rounds=2).collect()
    verdict = {r: v for v, r in RULES}
    assert len(got) == len(urls)
    for r in got:
        host, path = parts(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule_of(host, path)), urls[r.page_id]
        assert r.verdict == verdict.get(r.rule, r.verdict) and r.verdict in ("allow", "block")


def test_trees_learn_what_rules_say(spark):
    rows = [(i, f"https://site{i}.net/{'es' if i % 2 else 'en'}/page") for i in range(200)] + [(i, f"http://pills-{i}-{i}-buy-now.org/a/b/c?x=1&y=2&z=3") for i in range(200, 400)] + [(i, f"http://pills-{i}-{i}-buy-now.info/a/b/c?x=1&y=2&z=3") for i in range(400, 420)] + [(i, f"https://plain{i}.info/") for i in range(420, 440)]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string"), [("block", "org/"), ("allow", "net/")]).collect()}
    assert all(got[i].verdict == "block" and got[i].rule is None for i in range(400, 420)) and all(got[i].verdict == "allow" for i in range(420, 440))


def test_suffixes_count_beyond_the_rows_that_train(spark):
    """Only the suffix tells, and most suffixes are not among the training rows; joined by broadcast and by salt."""
    rng = random.Random(2)
    rules = [("block" if k % 2 else "allow", f"{chr(97 + k)}x.zz/in") for k in range(24)]
    urls = [f"http://{chr(97 + k)}x.zz/in/{rng.randrange(10**6):06}" for k in range(24) for _ in range(80)]
    asked = [f"http://{chr(97 + k)}x.zz/at/{rng.randrange(10**6):06}" for k in range(24)]
    df = spark.createDataFrame(list(enumerate(asked + urls)), "page_id long, url string")
    got = [sorted((r.page_id, r.verdict) for r in judge(df, rules, train_rows=30, rounds=2, broadcast_rows=b).where("rule IS NULL").collect()) for b in (1000, 1)]
    assert got[0] == got[1] == [(k, "block" if k % 2 else "allow") for k in range(24)]


def test_edges(spark, sample):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge(empty, RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    assert sorted((str(r.page_id), r.verdict) for r in judge(one, RULES).collect()) == [("1", "allow"), ("1", "allow"), ("None", "allow")]
    assert {r.verdict for r in judge(one, []).collect()} == {"allow"}
    assert op3_urlfilter(spark, sample).count() == 50
