import re

import pytest

from locusframe.llm import url_filter as U


def brute(glob: str, text: str) -> bool:
    out = ""
    for piece in re.findall(r"\*\*+|\*|\?|[^*?]+", glob):
        out += ".*" if piece[0] == "*" and len(piece) > 1 else "[^/]*" if piece == "*" else "[^/]" if piece == "?" else re.escape(piece)
    return re.fullmatch(out, text, re.S) is not None


def test_automaton_is_the_regular_expression(rng):
    globs = ["*a*", "**b/", "a?c**", "ab*ba", "**", "", "?" * 3, "x" * 70 + "*y", *U.BLOCK_GLOBS]
    globs += ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/cx") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", "x" * 70 + "abcy", "x" * 75]
    automaton = U.GlobAutomaton(globs)
    assert automaton.words > 1
    got = automaton.run([t.encode() for t in texts])
    for t, row in zip(texts, got):
        assert list(row) == [brute(g, t) for g in globs], t


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://WWW.Example.COM/en/7x?q#f", "www.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        ("https://a.example.net/de/81", "a.example.net", "/de/81", "example.net/de/8", "block"),
        ("https://net/de/", "net", "/de/", "net/de/", "allow"),
        ("https://xnet/de/", "xnet", "/de/", None, "allow"),
        ("ftp://x.org/es/1#a://b", "x.org", "/es/1", "org/es/", "block"),
        ("http://spam-farm.org/fr/", "spam-farm.org", "/fr/", None, "block"),
        ("http://a.fr/b.com/en/1", "a.fr", "/b.com/en/1", None, "allow"),
        ("http://host?x=/en/", "host", "", None, "allow"),
        ("no scheme", "", "", None, "block"),
        ("", "", "", None, "block"),
        (None, "", "", None, "block"),
        ("http://É.com/en/" + "x" * 5000, "É.com", "/en/" + "x" * 5000, "com/en/", "block"),
    ],
)
def test_cases(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x", "clash"), (1, url, "x", "clash")], "page_id long, url string, rule string, host string")
    rows = U.judge_urls(pages).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [(host, path, rule, verdict)] * 2


def test_empty_table(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
