import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pulse.llm import charlm, urls
from pulse.llm.queries import URL_RULES

PAGES = [(1, "http://A.Example.NET/en/x?q", "h"), (2, "https://example.net/en/", "h"), (3, "https://example.com/de/1#t", "h"),
         (4, "https://m.example.com/en/1", "h"), (5, "HTTP://x.org/fr/", "h"), (6, "no scheme", "h"), (7, None, "h"), (8, "", "h"),
         (9, "http://a.net", "h"), (10, "http://a.net?x/", "h"), (11, "ftp://notexample.net/en/", "h"), (12, "http://ÄB.org/fr/y", "h"),
         (13, "x://y://z.net/", "h"), (14, "https://m.example.com/en/1", "h"), (14, "https://m.example.com/en/1", "h")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_host_path_and_rules(llm):
    df = llm.createDataFrame(PAGES, "page_id long, url string, host string").repartition(2)
    got = urls.judge(df, URL_RULES).collect()
    assert len(got) == len(PAGES)
    for r in got:
        host, path, rule, verdict = brute(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
        if r["url"] is None:
            assert r["verdict"] == "allow" and r["score"] is None


def plain_ratios(samples, windows, order):
    n, ctx, kinds = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, cls in samples:
        t = f"\x02{text}\x03"
        for i in range(1, len(t)):
            for k in range(1, order + 2):
                if i - k + 1 >= 0:
                    g = t[i - k + 1:i + 1]
                    kinds[cls][g[:-1]] += not n[cls][g]
                    n[cls][g] += 1
                    ctx[cls][g[:-1]] += 1
    out = {}
    for w in windows:
        p = {}
        for c in (0, 1):
            p[c] = 1 / charlm.ALPHABET
            for k in range(1, min(len(w), order + 1) + 1):
                g = w[-k:]
                if (n[0][g] or n[1][g]) and ctx[c][g[:-1]]:
                    p[c] = (n[c][g] + kinds[c][g[:-1]] * p[c]) / (ctx[c][g[:-1]] + kinds[c][g[:-1]])
        out[w] = math.log(p[1]) - math.log(p[0])
    return out


def test_log_ratios_equal_plain_witten_bell(llm):
    samples = [("abcab", 1), ("abd", 1), ("xbx", 0), ("bb", 0), ("äb", 0)]
    df = llm.createDataFrame([(t, c, 1) for t, c in samples] + [("zab", None, 1)], "text string, cls int, times int")
    got = {r["win"]: r["ratio"] for r in charlm.log_ratios(charlm.window_counts(df, 2), 2).collect()}
    want = plain_ratios(samples, got, 2)
    assert got and all(abs(got[w] - want[w]) < 1e-9 for w in got)


def test_language_model_separates_styles(llm):
    good = [(i, f"http://site{i}.example.net/en/article-{i}-reading-news", "") for i in range(120)]
    bad = [(1000 + i, f"http://x{i}.net/casino-win-{i}-xxx-bonus", "") for i in range(120)]
    asked = [(2000 + i, f"http://some.place/article-{i * 7}-reading-news", "") for i in range(20)]
    asked += [(3000 + i, f"http://some.place/casino-win-{i * 7}-xxx-bonus", "") for i in range(20)]
    df = llm.createDataFrame(good + bad + asked, "page_id long, url string, html string")
    got = {r["row"]["page_id"]: r["verdict"] for r in urls.judge(df, URL_RULES).collect()}
    assert sum(got[2000 + i] == "allow" for i in range(20)) >= 19
    assert sum(got[3000 + i] == "block" for i in range(20)) >= 19


def test_one_class_or_no_rows(llm):
    df = llm.createDataFrame(PAGES[3:5], "page_id long, url string, html string")
    assert all(r["verdict"] == "allow" for r in urls.judge(df, URL_RULES).collect())
    assert urls.judge(df.where(F.lit(False)), URL_RULES).count() == 0
