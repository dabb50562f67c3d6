from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from fleetlens.llm import urls


def parts(url):
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


def rule_of(host, path):
    fits = []
    for action, rule in urls.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


class Model:
    def __init__(self, texts):
        self.next = defaultdict(Counter)
        for text, n in texts:
            padded = "\x02" * urls.ORDER + text + "\x03"
            for i in range(urls.ORDER, len(padded)):
                for k in range(urls.ORDER + 1):
                    self.next[padded[i - k : i]][padded[i]] += n

    def p(self, ctx, c):
        shorter = self.p(ctx[1:], c) if ctx else 1 / urls.UNIFORM
        seen = self.next.get(ctx)
        return (seen[c] + len(seen) * shorter) / (sum(seen.values()) + len(seen)) if seen else shorter


def brute(pages):
    split = [(page, *parts(url)) for page, url in pages]
    counts = Counter(h + p for _, h, p in split)
    verdicts = {h + p: rule_of(h, p)[1] for _, h, p in split}
    held = {s for s in counts if hashlib.md5(s.encode()).hexdigest()[0] < urls.HELD_BACK}
    model = {a: Model([(s, n) for s, n in counts.items() if verdicts[s] == a and s not in held]) for a in ("allow", "block")}

    def score(s):
        padded, total = "\x02" * urls.ORDER + s + "\x03", 0
        for i in range(urls.ORDER, len(padded)):
            ctx, c = padded[i - urls.ORDER : i], padded[i]
            total += round((math.log(model["allow"].p(ctx, c)) - math.log(model["block"].p(ctx, c))) * urls.UNIT)
        return total / (urls.UNIT * (len(s) + 1))

    scores = {s: score(s) for s in counts}
    steps = defaultdict(lambda: [0, 0])
    for s in held:
        if verdicts[s]:
            steps[math.floor(scores[s] * urls.STEPS)][verdicts[s] == "block"] += counts[s]
    cut = urls.best_cut([(k, *v) for k, v in steps.items()])
    out = []
    for page, h, p in split:
        rule, verdict = rule_of(h, p)
        out.append((page, h, p, rule, verdict or ("allow" if scores[h + p] >= cut else "block")))
    return sorted(out, key=str)


@pytest.fixture
def pages():
    out = []
    for i in range(60):
        tld, lang = ("net", "com", "org")[i % 3], ("en", "de", "fr", "es")[i % 4]
        out.append((i, f"https://S{i % 7}.Example.{tld}/{lang}/{i * 37}.html?q=1#x"))
    out += [(100 + i, "http://hot.example.net/en/1") for i in range(40)]
    return [
        *out, (200, None), (201, ""), (202, "no scheme.net/"), (203, "a://net"), (204, "a://net/x://org/fr/"), (205, "A://ÄB.NET/É/?"), (205, "A://ÄB.NET/É/?"),
        (None, "http://example.org/fr/#"), (206, "x://myexample.net/en/"), (207, "http://long.example.com/fr/" + "é" * 5000), (208, "http://org?/fr/"), (209, "a://b\nc/d\ne"),
    ]


def test_like_brute_force(spark, pages, monkeypatch):
    df = spark.createDataFrame([(*p, "<p>", "x") for p in pages], "page_id long, url string, html string, host string").repartition(3)
    for limit in (10**6, 0):
        monkeypatch.setattr(urls, "BROADCAST_GRAMS", limit)
        got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()), key=str)
        assert got == brute(pages)


def test_only_urls_are_read_and_no_python(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string")
    plan = urls.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_cut():
    assert urls.best_cut([]) == 0.0 and urls.best_cut([(5, 3, 0)]) == 0.0
    assert urls.best_cut([(-2, 0, 3), (1, 4, 0)]) == 1 / urls.STEPS
    assert urls.best_cut([(-2, 3, 0), (1, 0, 4)]) == -2 / urls.STEPS


def test_empty_and_unlabelled(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    got = urls.judge(spark.createDataFrame([(1, "a://b/c"), (2, None)], "page_id long, url string")).collect()
    assert [r.verdict for r in got] == ["allow"] * 2
