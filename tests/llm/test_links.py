"""The verdicts on urls against ranks computed in plain Python."""

import collections
import random
import re

import pytest

from pointline.llm import links

SCHEMA = "page_id long, url string, html string"
DAMPING, FLOOR = 0.85, 1e-4


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in links.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain(pages):
    """page_id: (verdict, trust, distrust), by rounds over dictionaries until nothing grows."""
    split = {i: re.match(r"([^/?#]*)((?:/[^?#]*)?)", url.split("://", 1)[1]).groups() for i, url, _ in pages}
    node = {i: host.lower().split("@")[-1].split(":")[0].rstrip(".") for i, (host, _) in split.items()}
    targets = collections.defaultdict(set)
    for i, _, html in pages:
        for host in re.findall(r"<a href='http://([^/]*)/'>", html):
            if host != node[i]:
                targets[node[i]].add(host)
    hosts = set(node.values()) | set(targets) | {t for ts in targets.values() for t in ts}
    blocked = {h for h in hosts if h == "net" or h.endswith(".net")}
    trusted = {node[i] for i, (host, path) in split.items() if plain_rule(host.lower(), path)[1] == "allow"} - blocked
    found = []
    for seeds, back in ((trusted, False), (blocked, True)):
        growth = {h: 0.15 for h in seeds}
        score = collections.Counter(growth)
        for _ in range(200):
            flow = collections.Counter()
            for source, ts in targets.items():
                for t in ts:
                    a, b = (t, source) if back else (source, t)
                    flow[b] += DAMPING * growth.get(a, 0) / len(ts)
            growth = flow
            score.update(flow)
        found.append(score)
    out = {}
    for i, (host, path) in split.items():
        trust, distrust = (f[node[i]] for f in found)
        method = "block" if distrust > trust + FLOOR else "allow"
        out[i] = (plain_rule(host.lower(), path)[1] or method, trust, distrust)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks(spark, seed):
    """Random graphs with cycles, hosts of many pages, dead ends, hosts known from links alone."""
    dice = random.Random(seed)
    names = [f"h{k}.{dice.choice(['org', 'com', 'net', 'info'])}" for k in range(60)] + ["example.net", "www.example.com"]
    pages = []
    for i in range(150):
        to = dice.sample(names, dice.randint(0, 5))
        path = dice.choice(["", "/", "/fr/a", "/en/b", "/de/c?x=/fr/"])
        pages.append((i, f"https://{dice.choice(names[:45])}{path}", "".join(f"<a href='http://{t}/'>" for t in to)))
    wanted = plain(pages)
    got = {r.page_id: r for r in links.judged(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert set(got) == set(wanted)
    for i, (verdict, trust, distrust) in wanted.items():
        assert abs(got[i].trust - trust) < 1e-4 and abs(got[i].distrust - distrust) < 1e-4
        if abs(distrust - trust - FLOOR) > 1e-4 or trust == distrust == 0:
            assert got[i].verdict == verdict, i
    assert {v[0] for v in wanted.values()} == {"allow", "block"} and max(v[1] for v in wanted.values()) > 0


def test_what_is_a_link(spark):
    """Attributes of other names and comments are no links; user, port, final dot and case don't make another host."""
    pages = [(1, "http://a.org/", "<p data-href='//bad.net/'>"), (2, "http://b.org/", "<!-- <a href='//bad.net/'>\n--> x <!-- -->"),
             (3, "http://c.org/", "<a\nHREF = \"http://BAD.net:80/x\">"), (4, "http://d.org/", "<a href=//me@bad.net.>"), (5, "http://bad.net:8080/", ""),
             (6, "http://e.org/", "<a href='//e.org:1/'>"), (7, "http://f.org/", "<!-- open <a href='//bad.net/'>"), (8, "http://g.org/", None)]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in links.judged(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert [got[i][2] for i in range(1, 9)] == ["allow", "allow", "block", "block", "block", "allow", "block", "allow"]
    assert got[5][:2] == ("bad.net:8080", None)
