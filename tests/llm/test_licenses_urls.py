import re

import numpy as np

from tidemark.llm import licenses, urls
from tidemark.llm.queries import URL_RULES


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))


def test_base_places_equal_brute_force(docs, empty):
    for r in licenses.scan(docs).select("text", "licenses.*").collect():
        w = words(r.text)
        want = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert sorted((p["at"], p.label) for p in r.places) == want
        assert r.n_words == len(w)
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(docs).columns == [*docs.columns, "licenses"]


def test_templates_are_found_where_they_stand(spark):
    rows = [(k, "lead in words " * k + t.text.upper() + " and more") for k, t in enumerate(licenses.TEMPLATES)]
    rows += [(90, "permission to walk the dog"), (91, "apache helicopters in version 2 of the film"), (92, "MIT press; a license to drive")]
    found = {r.doc_id: r.licenses.found for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in enumerate(licenses.TEMPLATES):
        assert (t.label, 3 * k, 1.0) in [(f.label, f["at"], f.score) for f in found[k]]
    assert found[90] == found[91] == found[92] == []


def test_notices_are_found_that_begin_or_end_outside_the_text(spark):
    cut = "free software you can redistribute it and or modify it under the terms of the gnu general public license"
    rows = [(1, cut), (2, "this program is free software; you can redistribute it under the terms of the GNU"), (3, "GNU General Public License")]
    found = {r.doc_id: r.licenses.found for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(f.label, f["at"]) for f in found[1]] == [("gpl", -3)] and 0.8 < found[1][0].score < 1
    assert found[2] == []  # a mandatory phrase is cut off
    assert found[3] == []


def test_index_holds_rare_words_of_every_template():
    idx = licenses.index()
    for k, _ in enumerate(idx.templates):
        assert any(k == t for _, _, at in idx.postings for t, _ in at)
    assert [i for _, i, _ in idx.postings] == sorted((i for _, i, _ in idx.postings), reverse=True)


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_hosts_paths_and_rules(spark):
    given = [None, "", "no scheme/net", "https://A.NET/x?y#z", "http://net", "http://net/", "http://b.example.net/en/1", "http://example.net/EN/", "HTTP://x.example.com/de/2?q", "http://org/fr/", "http://xorg/fr/", "http://É.org/fr/x\ny", "a://b.org?x=://c.net/", "http://o.org/fr"]
    df = spark.createDataFrame([(k, u, None, "h") for k, u in enumerate(given)], "page_id long, url string, html string, host string")
    for r in urls.judge(df, URL_RULES).collect():
        host, path = split(given[r.page_id])
        fits = [x for x in URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best.name), given[r.page_id]
        assert r.verdict == (best.verdict if best else "allow")


def test_ranks_equal_power_iteration(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("b", "d", 3.0), ("e", "a", 1.0)]
    hosts = sorted({h for e in edges for h in e[:2]})
    place = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for s, d, w in edges:
        m[place[d], place[s]] += w / sum(x[2] for x in edges if x[0] == s)
    start = np.array([h in "ae" for h in hosts]) / 2
    rank = start
    for _ in range(20):
        rank = 0.85 * m @ rank
        rank = rank + (1 - rank.sum()) * start
    found = urls.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a",), ("e",)], "host string"))
    for r in found.collect():
        assert abs(r["rank"] - rank[place[r.host]]) < 1e-12


def test_hubs_are_ranked_as_others(spark, monkeypatch):
    monkeypatch.setattr(urls, "HOT", 10)
    monkeypatch.setattr("tidemark.llm.shared.HOT", 10)
    edges = [("hub", f"h{k}", 1.0) for k in range(40)] + [(f"h{k}", "hub", 2.0) for k in range(0, 40, 3)] + [("h1", "h2", 1.0)]
    seeds = spark.createDataFrame([("h1",), ("hub",)], "host string")
    rank = {r.host: r["rank"] for r in urls.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), seeds).collect()}
    hosts = sorted({x for e in edges for x in e[:2]})
    m = np.array([[sum(w for s, d, w in edges if (s, d) == (a, b)) for a in hosts] for b in hosts])
    m = m / np.maximum(m.sum(axis=0), 1e-9)
    start = np.array([h in ("h1", "hub") for h in hosts]) / 2
    want = start
    for _ in range(20):
        want = 0.85 * m @ want
        want = want + (1 - want.sum()) * start
    assert all(abs(rank.get(h, 0) - want[k]) < 1e-9 for k, h in enumerate(hosts))


def test_linkers_of_blocked_hosts_are_blocked(spark):
    link = '<a href="{}">x</a>'.format
    pages = [
        (1, "http://bad.net/a", None),
        (2, "http://farm.com/a", link("http://bad.net/a") * 3),
        (3, "http://good.org/fr/a", link("http://friend.com/")),
        (4, "http://friend.com/a", link("http://good.org/fr/a")),
        (5, "http://alone.com/a", "<a href='/local'>x</a>"),
        (5, "http://alone.com/a", "<a href='/local'>x</a>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    verdicts = {r.host: r.verdict for r in urls.judge(df, URL_RULES).collect()}
    assert verdicts == {"bad.net": "block", "farm.com": "block", "good.org": "allow", "friend.com": "allow", "alone.com": "allow"}
    assert urls.judge(df.limit(0), URL_RULES).count() == 0
