import itertools
import random
import re
from collections import Counter

import pytest

from plinth.llm.queries import URL_RULES
from plinth.llm.urls import ListRule, MiningSettings, judge


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def by_list(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name)) if fits else None


def token_set(url):
    host, path = parse(url)
    if not host:
        return frozenset()
    labels = host.split(".")
    out = {"scheme=" + url.split("://", 1)[0].lower()} | {"host=" + ".".join(labels[-n:]) for n in range(1, len(labels) + 1)}
    found = re.match(r"[^?#]*\?([^#]*)", url.split("://", 1)[1])
    parts = [x for x in re.split("[&;]", found[1] if found else "") if x]
    out |= {"name=" + x.split("=", 1)[0] for x in parts} | {"query=" + x for x in parts if "=" in x}
    return frozenset(out | {f"path{i}={s}" for i, s in enumerate([s for s in path.split("/") if s])})


def brute_rules(rows, settings):
    """Rules by counting every combination of tokens that are frequent alone."""
    n, at = len(rows), {}
    for i, (items, _) in enumerate(rows):
        for t in items:
            at.setdefault(t, set()).add(i)
    often = {t for t in at if len(at[t]) >= settings.support * n}
    count = Counter()
    for items, verdict in rows:
        own = sorted(items & often)
        for size in range(1, len(own) + 1):
            for c in itertools.combinations(own, size):
                count[c, None] += 1
                count[c, verdict] += 1
    share = Counter(v for _, v in rows)
    good = {}
    for (c, v), k in count.items():
        if v and k >= settings.support * n and k / count[c, None] >= settings.confidence and k / count[c, None] > share[v] / n:
            good[frozenset(c), v] = (k / count[c, None], k / n)
    kept = [(c, v, conf, sup) for (c, v), (conf, sup) in good.items() if not any(good.get((c - {t}, v), (-1,))[0] >= conf for t in c)]
    return sorted(kept, key=lambda x: (-x[2], -x[3], sorted(x[0]), x[1]))


def cases():
    rng = random.Random(3)
    urls = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.com/en/71", "x://É.com/en/?q", "http://com/en/", "http://notcom/en/", "http://a.com/EN/", "http://example.net/de/8#f", "http://h/a://b", "http://com\n/en/"]
    for _ in range(1500):
        host = rng.choice(["a", "b.c", "w"]) + rng.choice([".example", ""]) + rng.choice([".com", ".net", ".org", ".dev"])
        urls.append(f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.choice(['7', '8', '9'])}{rng.randrange(9)}{rng.choice(['', '?x=/en/', '#t', '?a;b=1&a=2#?c=3', '/b/c/d/e/f'])}")
    return urls


def test_against_brute_force(spark):
    settings = MiningSettings(support=0.01)
    urls = cases()
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[20], "y"), (3, urls[20], "y"), (3, urls[20], "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = Counter(tuple(r)[:6] for r in judge(df, URL_RULES, settings=settings).collect())
    covered = [(token_set(u), by_list(*parse(u)).verdict) for _, u, _ in rows if by_list(*parse(u))]
    rules = brute_rules(covered, settings)
    assert len(rules) > 3
    want = Counter()
    for i, u, _ in rows:
        host, path = parse(u)
        rule = by_list(host, path)
        mined = next((v for left, v, *_ in rules if left <= token_set(u)), None)
        want[i, host, path, rule and rule.name, rule.verdict if rule else mined or "allow", "list" if rule else "mined" if mined else "default"] += 1
    assert got == want


@pytest.mark.parametrize("form", ["http://h{i}.{top}/a/b/c/d/{sign}/x", "http://h{i}.{top}/a?p={sign}&z={i}"])
def test_tokens_far_behind_are_mined(spark, form):
    rows = [(i, form.format(i=i, sign=("bad", "good")[i % 2], top="xx" if i < 60 else "yy")) for i in range(100)]
    own = [ListRule(("block", "allow")[i % 2], f"h{i}.xx", "") for i in range(60)]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, "page_id long, url string"), own, settings=MiningSettings(support=0.05)).collect()}
    assert got == {i: ("block", "allow")[i % 2] for i in range(100)}


def test_tokens_of_a_class_stand_alone(spark):
    # host, path and query of the blocked rows are in the same labelled rows; a URL may have only one of them.
    rows = [(i, f"http://www.bad.com/promo/{i}?ad=1" if i < 40 else f"http://www.good.com/item/{i}") for i in range(80)]
    rows += [(100, "http://other.io/promo/z"), (101, "http://other.io/q/z?ad=1"), (102, "http://other.io/promo/z?ad=1"), (103, "http://other.io/q/z"), (104, "http://other.io/item/z?ad=2")]
    own = [ListRule("block", "bad.com", "/promo/"), ListRule("allow", "good.com", "")]
    got = {r.page_id: (r.verdict, r.decided_by) for r in judge(spark.createDataFrame(rows, "page_id long, url string"), own, settings=MiningSettings(support=0.05)).collect()}
    assert {k: v for k, v in got.items() if k >= 100} == {100: ("block", "mined"), 101: ("block", "mined"), 102: ("block", "mined"), 103: ("allow", "default"), 104: ("block", "mined")}  # name=ad comes before path0=item


def test_long_urls_do_not_multiply_rules(spark):
    rows = [(i, f"http://h.{'xx' if i < 50 else 'yy'}/" + "/".join(map(str, range(40))) + f"?bad={i % 2}") for i in range(100)]
    own = [ListRule("block", "xx", "/0/")]
    got = judge(spark.createDataFrame(rows, "page_id long, url string"), own, settings=MiningSettings(support=0.05)).collect()
    assert len(got) == 100


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "http://a/b")]])
def test_nothing_listed(spark, rows):
    got = judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")] * len(rows)
