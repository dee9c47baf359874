"""URL filters against SQL, and against all rules on all URLs."""

import random
import re

import duckdb
import pytest

from sedimenta.llm import queries, urls

URLS = ["http://a.com/x", "https://WWW.example.com/en/1?x=/", "http://m.example.com/en/", "http://b.net/es/", "http://b.net/esx", "http://b.net/fr/2#t", "http://casino-win.org/", "http://casinos.org/", "nothing", None, "", "://", "http://a.com", "http://spam-x.net/es/3", "x://y://z.com/", "http://xcom/", "http://a.free-money.org/", "http://freemoney.org/", "http://free.money/", "http://a.org/wp-login.php", "http://a.org/x/wp_login.php?q", "http://a.org/awp-login.php", "http://a.org/wp-login.phpx", "http://a.org/ad/redirect/1", "http://a.org/bad/redirect", "http://a.org/doorway", "http://a.org/doorways", "http://a.org/xmlrpc.php#x", "http://A.SPAM.org", "http://a.org/spam", "http://a.org/" + "x/" * 50_000 + "doorway", "http://" + "spam" * 10_000 + ".org/"]


@pytest.mark.parametrize("inline", [256, 0])
def test_judge_gives_what_sql_gives(spark, inline):
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(URLS)] + [(0, URLS[0], None, None, None), (None, URLS[0], None, None, None)], "page_id long, url string, host string, path string, rule string")
    c = duckdb.connect()
    c.execute("create table pages(page_id bigint, url varchar)")
    c.executemany("insert into pages values (?, ?)", [list(x) for x in enumerate(URLS)])
    want = {r[0]: r[1:] for r in c.sql("select page_id, host, path, rule, verdict from (" + queries.ORACLES["op4_url_filters"] + ")").fetchall()}
    got = urls.judge(pages, queries.CONTRACT_RULES + urls.DEFAULT_RULES, inline=inline).collect()
    assert len(got) == len(URLS) + 2 and all(tuple(r)[1:] == want[r["page_id"] or 0] for r in got)
    assert {r["verdict"] for r in got} == {"allow", "block"}
    assert urls.judge(pages.limit(0), queries.CONTRACT_RULES, inline=inline).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, (), inline=inline).collect()} == {"allow"}


def random_rules(rnd, words):
    rules = [urls.words_rule(*rnd.sample(words, rnd.randrange(2, 4))) for _ in range(9)] + [urls.path_rule(*rnd.sample(words, rnd.randrange(2, 4))) for _ in range(9)]
    rules += [urls.prefix_rule(".".join(rnd.sample(words, rnd.randrange(1, 3))), rnd.choice([f"/{rnd.choice(words)}/", f"/{rnd.choice(words)}"]), rnd.choice(["allow", "block"])) for _ in range(40)]
    return tuple({r.name or r.pattern: r for r in rules}.values()) + (urls.Rule(r"b+c"), urls.Rule("(?:aa|bb)[-/]cc"))


@pytest.mark.parametrize("inline", [1000, 0])
def test_the_index_loses_no_rule(spark, inline):
    rnd = random.Random(41)
    words = ["aa", "bb", "cc", "dd", "ee9", "f", "7"]
    rules = random_rules(rnd, words)
    hosts = ["".join(rnd.choice([w, w.upper()]) + rnd.choice(".-_.") for w in rnd.choices(words, k=rnd.randrange(1, 4))) + "aa" for _ in range(300)]
    rows = [(i, f"http://{h}/" + "".join(w + rnd.choice("/-._") for w in rnd.choices(words, k=rnd.randrange(0, 5)))) for i, h in enumerate(hosts)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, inline=inline).collect()}
    blocked = 0
    for i, url in rows:
        rest = url[7:]
        host, path = rest[: rest.index("/")].lower(), rest[rest.index("/") :]
        fits = [r for r in rules if re.search(r.pattern, host + path)]
        named = [r for r in fits if r.name is not None]
        best = max(named, key=lambda r: len(r.name), default=None)
        ties = {r.verdict for r in named if len(r.name) == len(best.name)} if best else {"block" if fits else "allow"}
        assert got[i]["verdict"] in ties and (got[i]["rule"] is None) == (best is None)
        assert best is None or len(got[i]["rule"]) == len(best.name)
        blocked += got[i]["verdict"] == "block"
    assert 20 < blocked < 280


def test_tokens_are_read_off_the_expression():
    assert urls.whole_tokens(r"^(?:[^/]*\.)?www\.example\.com/en/") == ("www", "example", "com", "en")
    assert urls.whole_tokens("/ab[-_]cd(?:[^A-Za-z0-9]|$)") == ("ab", "cd")
    for loose in ("abc", "/abc", "/abc.", "/ab?c/", "/(?:ab|cd)/", "(?:/ab/)?", "/ab[a-z]/", "[^x]ab/", "/ab*/"):
        assert urls.whole_tokens(loose) == (), loose
    assert all(r.tokens for r in queries.CONTRACT_RULES + urls.DEFAULT_RULES)


def test_each_rule_is_under_its_rarest_token(spark):
    rows = spark.createDataFrame([(["a", "b"],)] * 3 + [(["b", "c"],)] * 2, "tokens array<string>")
    rules = (urls.words_rule("a", "b"), urls.words_rule("b", "c"), urls.words_rule("b"), urls.words_rule("a", "zz"), urls.Rule("x"))
    assert urls.rarest(rows, rules) == {0: "a", 1: "c", 2: "b", 3: "zz"}
