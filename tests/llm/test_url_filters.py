"""URL filters against a plain version, over urls and links with every hard case."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terradelta.llm import url_filters

SCHEMA = "page_id long, url string, html string, host string, verdict int, mass string"
RULES = url_filters.RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_for(host, path, rules=RULES):
    best = None
    for verdict, rule in rules:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best or (None, None)


def brute(rows, rounds=20, most=30):
    seen = [(r[0], *parts(r[1]), r[2]) for r in rows]
    fits = [rule_for(h, p) for _, h, p, _ in seen]
    pages, trusted, blocked, edges = Counter(), Counter(), Counter(), set()
    for (_, host, _, html), (verdict, _) in zip(seen, fits, strict=True):
        if host:
            pages[host] += 1
            trusted[host] += verdict == "allow"
            blocked[host] += verdict == "block"
            for to in re.findall(r"""(?:href|src)[ \t\r\n]*=[ \t\r\n]*["']?(?:https?:)?//([^/?#"'<> \t\r\n]+)""", html or "", re.I):
                to = "".join(c.lower() if c.isascii() else c for c in to)
                if to != host:
                    edges.add((host, to))
    for host in set(pages) | {b for _, b in edges}:
        x = host.split(".")
        if re.search(r"[a-z][^.]*$", host):
            for n in range(len(x) - 2):
                low, high = ".".join(x[n:]), ".".join(x[n + 1 :])
                edges |= {(low, high), (high, low)}

    def walk(seeds, edges):
        degree = Counter(a for a, _ in edges)
        base = {h: n * 150_000 for h, n in seeds.items() if n}
        mass = base
        for _ in range(rounds):
            new = defaultdict(int, base)
            for a, b in edges:
                new[b] += mass.get(a, 0) // 100 * 85 // degree[a]
            mass = {h: m for h, m in new.items() if m}
        return mass

    trust, distrust = walk(trusted, edges), walk(blocked, {(b, a) for a, b in edges})
    out = Counter()
    for (page_id, host, path, _), (verdict, rule) in zip(seen, fits, strict=True):
        t, d = (trust.get(host, 0), distrust.get(host, 0)) if host else (0, 0)
        bad = host and (d - t) * 100 > pages[host] * 150_000 * most
        out[(page_id, host, path, rule, verdict or ("block" if bad else "allow"), t, d)] += 1
    return out


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(3)
    hosts = [f"{sub}{name}.example.{top}" for sub in ("", "www.", "m.") for name in ("aa", "bb", "cc", "dd") for top in ("com", "net", "org")]
    hosts += ["www.example.com", "example.com", "net", "badnet", "10.0.0.1", "h:8080", "user@Host.ORG"]
    out = []
    for n in range(400):
        host = "aa.example.net" if n % 3 == 0 else rng.choice(hosts)
        url = f"https://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{n}{rng.choice(['', '?a=/b', '#top', '?u=http://x.net/es/'])}"
        links = " ".join(rng.choice(['<a href="https://{}/x">', "<img SRC='//{}'>", "<a href = http://{}?q>", '<a href="/{}">', "http://{}"]).format(rng.choice(hosts)) for _ in range(rng.randrange(4)))
        out.append((n, url, links, "x", 1, "m"))
    odd = [None, "", "no scheme", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/1", "a://b://c/d", "http://x.com", "http://x.com?/en/", "https://É.Example.net/fr/ü#x", "https://notnet/es/", "https://net/es/1", "https://.net/es/"]
    out += [(1000 + n, u, None if n % 2 else "<a href='//aa.example.com'>", None, None, None) for n, u in enumerate(odd)]
    return [*out, out[0], out[0], (None, "https://aa.example.org/en/1", "<a href=//bad.example.net/>", None, None, None), (None, None, None, None, None, None), (7, "https://long.example.net/es/" + "x" * 300_000, '<a href="https://aa.example.org/">' * 3000, None, None, None)]


def test_judge(spark, pages):
    df = spark.createDataFrame(pages, SCHEMA).repartition(3)
    assert Counter(map(tuple, url_filters.judge(df).collect())) == brute(pages)
    few = url_filters.judge(df, rounds=3, most_percent=5).collect()
    assert Counter(map(tuple, few)) == brute(pages, 3, 5)
    assert {r.verdict for r in few if r.rule is None} == {"allow", "block"}


def test_nothing_and_bounds(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert url_filters.judge(nothing).count() == 0
    one = spark.createDataFrame([(1, "https://a.net/es/", None, None, None, None)], SCHEMA)
    assert [tuple(r)[3:5] for r in url_filters.judge(one, rules=()).collect()] == [(None, "allow")]
    with pytest.raises(ValueError):
        url_filters.rule_of(F.lit("h"), F.lit("/"), [("allow", "h/")] * 1001)


def test_links_carry_trust_forwards_and_distrust_backwards(spark):
    edges = spark.createDataFrame([("good", "next"), ("next", "last"), ("fan", "bad"), ("far", "fan"), ("bad", "victim"), ("good", "good")], "src string, dst string")
    seeds = spark.createDataFrame([("good", 10, 0), ("bad", 0, 10)], "host string, trusted long, blocked long")
    got = {r.host: (r.trust, r.distrust) for r in url_filters.propagate(edges, seeds, rounds=10).collect()}
    assert set(got) == {"good", "next", "last", "bad", "fan", "far"}
    assert got["good"][0] > got["next"][0] > got["last"][0] > 0 and got["bad"][1] > got["fan"][1] > got["far"][1] > 0
    assert not any(got[h][1] for h in ("good", "next", "last")) and not any(got[h][0] for h in ("bad", "fan", "far"))


def test_native(spark, pages):
    plan = url_filters.judge(spark.createDataFrame(pages, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
