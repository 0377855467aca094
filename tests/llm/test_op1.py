import random

import pytest
from common import SF, table
from common_sql import rows_of, sorted_rows

from talus.llm import op1_url_filters as op1
from talus.llm import registry, sql

RULES = registry.URL_RULES


def test_query_equals_sql(spark):
    want = rows_of(sql.OP1_URL_FILTERS, SF)
    assert sorted_rows(registry.op1_url_filters(spark, SF), list(want[0])) == want


def rule_of(host, path, rules=RULES):
    fits = [(h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0] + r[1])) if fits else None


@pytest.mark.parametrize("compiled", [op1.COMPILED, 0])
def test_aliases_equal_union_find(spark, compiled):
    rng = random.Random(4)
    hosts = ["a.com", "b.example.com", "www.example.com", "c.net", "d.org", "E.org", "f.org", "net"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{k}" for k in range(120)]
    edges = [(rng.choice(urls), rng.choice(urls)) for _ in range(70)] + [(urls[0], u) for u in urls[100:110]] + [(None, urls[1]), (urls[2], urls[2])]
    root = {u: u for u in urls}

    def find(u):
        return u if root[u] == u else find(root[u])

    for a, b in edges:
        if a:
            root[find(a)] = find(b)
    parts = lambda u: (u.split("/")[2].lower(), "/" + u.split("/", 3)[3])
    own = {u: rule_of(*parts(u)) for u in urls}
    bad = {find(u) for u in urls if own[u] and own[u][2] == "block"}
    want = {u: own[u][2] if own[u] else "block" if find(u) in bad else "allow" for u in urls}
    frame = table(spark, edges, "a string, b string").select(op1.alias_key(op1.F.col("a")).alias("src"), op1.alias_key(op1.F.col("b")).alias("dst"))
    rows = op1.judge(table(spark, [(u, "x") for u in urls + [urls[0]]], "url string, verdict string"), RULES, frame, compiled).collect()
    assert len(rows) == len(urls) + 1
    assert {r.url: r.verdict for r in rows} == want
    assert {r.url: r.rule for r in rows} == {u: own[u] and own[u][0] + own[u][1] for u in urls}
    assert any(r.from_alias for r in rows)


def test_links_in_html(spark):
    page = "http://A.org/x/y.html?q=1#top"
    html = [
        '<LINK href="https://b.net/es/1#f" rel=canonical>',
        "<meta http-equiv='refresh' content='0; url=/moved'>",
        '<link rel="canonical" href="z.html"><link rel="stylesheet" href="//c.org/s.css">',
        '<link rel="canonical" href="//d.org">',
        None,
        "",
        "no links, but canonical",
    ]
    pages = table(spark, [(page, h) for h in html], "url string, html string")
    got = sorted((r.src, r.dst) for r in op1.page_edges(pages).collect())
    assert got == sorted(("a.org/x/y.html?q=1", d) for d in ["b.net/es/1", "a.org/moved", "a.org/x/z.html", "d.org/"])


def test_null_and_odd_urls_and_empty_tables(spark):
    none = table(spark, [], "src string, dst string")
    urls = [None, "", "no scheme", "http://", "http://COM", "http://com/", "x://É.net/fr/?a://b", "http://a.net?/es/", "http://net/es/" + "z" * 30000]
    rows = {r.url: (r.host, r.path, r.rule, r.verdict) for r in op1.judge(table(spark, [(u,) for u in urls], "url string"), RULES, none).collect()}
    assert rows[None] == rows[""] == rows["no scheme"] == rows["http://"] == ("", "", None, "allow")
    assert rows["http://COM"] == ("com", "", None, "allow")
    assert rows["http://com/"] == ("com", "/", "com/", "allow")
    assert rows["x://É.net/fr/?a://b"] == ("É.net", "/fr/", "net/fr/", "block")
    assert rows["http://a.net?/es/"] == ("a.net", "", None, "allow")
    assert rows[urls[-1]][2:] == ("net/es/", "block")
    assert op1.judge(table(spark, [], "url string"), RULES, none).count() == 0


def test_redirects_decide_in_the_query_with_edges(spark):
    from talus.llm.tables import read

    want = rows_of(sql.URL_ALIASES, SF)
    got = registry.url_aliases(spark, SF)
    assert sorted_rows(got, list(want[0])) == want
    rows = got.collect()
    assert any(r.from_alias for r in rows)
    # without edges these pages would be allowed, and an allow rule stands against blocked aliases
    plain = {r.page_id: r.verdict for r in op1.judge(read(spark, SF, "pages"), RULES, table(spark, [], "src string, dst string")).collect()}
    assert all(plain[r.page_id] == "allow" for r in rows if r.from_alias)
    blocked = {r.path for r in rows if r.from_alias}
    assert any(r.verdict == "allow" and r.rule == "com/" for r in rows if r.path.startswith(("/es/", "/fr/"))) and blocked
