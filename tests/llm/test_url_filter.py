import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np

from corpusloom.llm import url_filter as U
from corpusloom.llm.queries import RULES


def plain(url):
    """Host, path and rule of a url by hand."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
    path = m[2]
    fit = [(v, r) for v, r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    best = max(fit, key=lambda x: len(x[1]), default=(None, None))
    return host, path, best[1], best[0]


def test_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://A.ExAmple.com/en/1?q#f", "http://www.example.com/en/", "http://example.com", "x://net/es/1", "https://a.net/fr/?x", "https://notnet/fr/", "http://ÄB.com?x/en/", "a://b://c.com/x", "http://a.com/EN/#", "http://example.com/en", "http://xexample.com/en/2", "://com/"]
    pages = spark.createDataFrame([(i, u, "<title>cheap word</title>", "x") for i, u in enumerate(urls)] + [(0, None, None, "x")], "page_id long, url string, html string, rule string")
    got = U.judge_urls(pages, RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, verdict = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] > 0 else "allow"))
        assert (r["score"] is None) == (rule is not None)
    assert U.judge_urls(pages.where("page_id > 99"), RULES).collect() == []


def lexicon(counts, total=1000):
    lex = U.Lexicon(np.zeros(U.ROWS * U.WORD_BUCKETS, np.int64), total, tuple(sorted({len(w) for w in counts if len(w) > 1}, reverse=True)))
    for w, n in counts.items():
        lex.counts[U.word_buckets(w)] += n
    return lex


def test_split_matches_all_splits():
    lex = lexicon({"ab": 50, "abc": 11, "bc": 90, "cheap": 370, "pills": 370, "a": 900})
    words = {w: math.log(n / 1000) - 0.1 for w, n in (("ab", 50), ("abc", 11), ("bc", 90), ("cheap", 370), ("pills", 370))}
    for name in ("abc", "aabcab", "cheappills", "xab", "abxx", "xyz", "", "cab"):
        best = -math.inf
        for cut in itertools.product([0, 1], repeat=max(0, len(name) - 1)):
            parts, w = [], name[:1]
            for c, ch in zip(cut, name[1:], strict=True):
                if c:
                    parts.append(w)
                    w = ""
                w += ch
            parts += [w] if w else []
            if all(x in words or len(x) == 1 for x in parts):
                best = max(best, sum(words.get(x, lex.unknown) for x in parts))
        got = lex.split(name)
        assert "".join(got) == name
        score = sum(words[x] if x in words else lex.unknown * len(x) for x in got)
        assert math.isclose(score, best) or (not name and score == 0)
    assert lex.split("cheappills") == ("cheap", "pills") and lex.split("xyz") == ("xyz",)


def test_words_are_those_of_the_visible_text(spark):
    page = "<html><TITLE>Größe A of</TITLE><script>var hidden='<b>'</script><style>p{}</style><p class=secret>of two&amp;more 12ab</p>" + "z" * 70
    assert U.page_words(page) == ["größe", "of", "of", "two", "more", "ab", "z" * 70]
    lex = U.fit_lexicon(spark.createDataFrame([(page,), (page,), (None,), ("",)], "html string").repartition(3))
    assert lex.total == 14 and lex.lengths == (70, 5, 4, 3, 2) and [min(lex.counts[U.word_buckets(w)]) for w in ("of", "größe", "hidden", "secret")] == [4, 2, 0, 0]


HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>")


def test_visible_text_is_that_of_the_plain_pattern():
    random.seed(5)
    parts = ["<script", "<STYLE>", "</script>", "</script", "</Style  >", "<b>", "<", ">", " ", "a", "word", "<scripts>", "\n", "<style/", "</"]
    for _ in range(4000):
        page = "".join(random.choices(parts, k=random.randint(0, 14)))
        assert U.visible_text(page) == HIDDEN.sub(" ", page), page


def test_open_tags_and_long_words_take_linear_time():
    for page in ("<script>" * 130_000, "<" * 1_000_000, "<style>a" * 120_000 + ">", "</script" * 120_000):
        began = time.time()
        U.page_words(page)
        assert time.time() - began < 3
    long = "x" * 200 + "y"
    lex = lexicon({long: 5, "ab": 9})
    assert lex.split("ab" + long + "ab") == ("ab", long, "ab")


def test_many_rules_longest_wins():
    rules = [("block", f"h{i}.org/") for i in range(5000)] + [("allow", "org/a/"), ("block", "www.h7.org/a/b/"), ("allow", "h7.org/a/b/")]
    table = U.rule_table(rules)
    for host, path in (("h7.org", "/a/b/c"), ("x.www.h7.org", "/a/b/"), ("h8.org", "/a/"), ("h8.org", "/b"), ("eh8.org", "/a/"), ("", "/"), ("org", "/a/"), ("h9.org.", "/")):
        fit = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        best = max(fit, default=(0, None, None))
        assert U.find_rule(table, host, path) == (best[1], best[2])


def test_bayes_matches_brute_force(spark):
    words = ["news", "town", "shop", "farm", "spam"]
    urls = [(f"http://{a}{b}.{tld}/{p}/{c}", f"<p>{a} {b} {c}</p>") for a in words for b in words for tld, p in (("com", "en"), ("net", "es"), ("org", "fr"), ("net", "fr")) for c in words[:2]]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(urls)], "page_id long, url string, html string").repartition(4)
    lex = U.fit_lexicon(pages)
    seen, docs = {"block": Counter(), "allow": Counter()}, Counter()
    for u, _ in urls:
        host, path, _, verdict = plain(u)
        if verdict:
            docs[verdict] += 1
            seen[verdict].update(U.tokens(lex, host, path))
    known = set(seen["block"]) | set(seen["allow"])
    total = {v: sum(seen[v][t] + 0.5 for t in known) for v in seen}
    odds = {t: math.log((seen["block"][t] + 0.5) / total["block"]) - math.log((seen["allow"][t] + 0.5) / total["allow"]) for t in known}
    prior = math.log((docs["block"] + 1) / (docs["allow"] + 1))
    undecided = 0
    for r in U.judge_urls(pages, RULES).collect():
        host, path, rule, _ = plain(urls[r["page_id"]][0])
        if rule is None:
            undecided += 1
            assert math.isclose(r["score"], prior + sum(odds.get(t, 0.0) for t in U.tokens(lex, host, path)), abs_tol=1e-5)
    assert undecided == 50


def test_seeds_block(spark):
    pages = spark.createDataFrame([(1, "http://cheap-pills.org/en/1", "<title>the news of the town: cheap pills</title>"), (2, "http://thenews.org/town", "<title>the news of the town</title>"), (3, "http://thenews.com/town", "<title>town news</title>"), (4, "http://townnews.com/the", None)] + [(5 + i, "http://town.com/news/of", None) for i in range(100)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(pages, RULES, seeds={"cheap": 100, "pills": 100}).collect()}
    assert {k: got[k] for k in range(1, 5)} == {1: "block", 2: "allow", 3: "allow", 4: "allow"}
