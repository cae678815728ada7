import numpy as np
from locusframe.llm import html_extract as H

from conftest_llm import prose

HEAD = '<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>";</script></head><body><!-- c --><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
TAIL = '<form><p>Name</p></form><aside>side</aside><footer>&copy; x</footer></body></html>'


def test_main_text():
    page = HEAD + "<div class='ad'>Buy</div><article><h1>Title &amp;c</h1><p><b>One\n  two.<br><p>Three &lt;b&gt; &eacute;&nbsp;x &am</p><div class=\"comments\"><p>reader</p></div><ul><li>i</li><li>j</li></ul></article>" + TAIL
    assert H.main_text(page) == "Title &c\nOne two.\nThree <b> é x &am\ni\nj"
    assert H.main_text(page[: page.index("<ul><li>i")]) == "Title &c\nOne two.\nThree <b> é x &am"
    assert H.main_text("") == "" and H.main_text("<p>a<p>b") == "a\nb" and H.main_text("a < b & c") == "a < b & c"
    assert H.main_text("<main><p title='a>b'>x</p></main></main></p>") == "x"


def test_templates_and_extraction(spark, rng):
    def page(k, host, article=True):
        body = "".join(f"<p>{prose(rng, 12)}</p>" for _ in range(1 + k % 4))
        main = f"<article><h1>{prose(rng, 3)}</h1>{body}</article>" if article else f"<div class='x{k % 2}'><div>{body}</div></div>"
        return f"https://{host}/p{k}", f"<html><body><nav><a>Home</a></nav><div class='top'>Welcome to {host}</div>{main}<div>All about us</div><footer>f</footer></body></html>", body

    pages = [page(k, "a.org") for k in range(40)] + [page(k, "b.org", False) for k in range(30)] + [page(0, "lonely.org")]
    rows = [(k, u, h, "clash", 7) for k, (u, h, _) in enumerate(pages)] + [(900, None, None, "", 1), (901, "https://a.org/x", "", "", 1), (0, *pages[0][:2], "clash", 7), (902, "nohost", "<article>alone</article>", "", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    templates = {r.host: r for r in H.deduce_templates(table).collect()}
    assert templates["a.org"].pages == 42 and max(len(c["keys"]) for c in templates["a.org"].second) > 8
    got = H.extract(table).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    import re

    for k, (_, h, body) in enumerate(pages):
        paragraphs = "\n".join(re.findall("<p>(.*?)</p>", body))
        title = re.search("<h1>(.*?)</h1>", h)
        assert by_id[k].text == (title[1] + "\n" if title else "") + paragraphs, k
        assert by_id[k].n_chars == len(by_id[k].text)
    assert by_id[900].text == "" and by_id[901].text == "" and by_id[902].text == "alone"
    assert H.extract(table.limit(0)).count() == 0


def test_classes_must_be_ordered_and_nested():
    t = H.Classes({1: (0, 0), 2: (0, 1), 3: (1, 0), 4: (1, 1), 5: (2, 0), 6: (2, 1)}, (10, 6, 3), (2, 2, 2))

    def tree(keys):
        inner, gaps, valid = H.nest(keys, t, least_tokens=2)
        return [(gaps[g].of, gaps[gaps[g].parent].of if g else None) for g in inner], valid

    # 3 4 lie in the gap of 1 2, and 5 6 in that of 3 4
    assert tree([1, 9, 3, 5, 8, 6, 4, 2]) == ([(-1, None), (0, -1), (0, -1), (1, 0), (2, 1), (1, 0), (0, -1), (-1, None)], {0, 1, 2})
    assert tree([1, 3, 2, 4])[1] == {0}  # across a fence
    assert tree([1, 3, 5, 4, 6, 2])[1] == {0, 1}  # across the inner fence
    assert tree([3, 4, 1, 2, 3, 4, 3, 4])[1] == {0, 1}  # each time in one gap
    assert tree([2, 1])[1] == set()
    # one token in two gaps of the first classes is two
    apart = H.told_apart([9, 1, 9, 2, 9], H.Classes(t.tokens, t.support, (2, 2, 2)))
    assert len(set(apart.tolist())) == 3  # classes of two tokens are too small to count
    wide = H.Classes({1: (0, 0), 7: (0, 1), 2: (0, 2)}, (10,), (3,))
    apart = H.told_apart([9, 1, 9, 7, 9, 2, 9], wide).tolist()
    assert apart[0] == apart[6] and len(set(apart)) == 6


def test_stray_quotes_and_authors_own_names():
    assert H.main_text("<article><p title=it's>Hello</p><p>don't worry</p></article>") == "Hello\ndon't worry"
    assert H.main_text("<article><p title='a > b' x=\"'>\">Hello</p><p a='>open</p></article>") == "Hello\nopen"


def _layout(rng, k, article, others, open_="<div>", close="</div>"):
    """A page with several like containers around a text, which is long or very short."""
    words = rng.choice((1, 3, 40, 90))
    lines = [prose(rng, words) for _ in range(1 + k % 4)]
    menu = "".join(f"<li><a href='/{k}'>{prose(rng, 1)}</a></li>" for _ in range(3 + k % 3))
    body = f"<{article}><h1>Title {k}</h1>" + "".join(f"<p>{x}</p>" for x in lines) + f"</{article.split()[0]}>"
    page = f"<html><head><title>t {k}</title></head><body><div><ul>{menu}</ul></div><{others[0]}>{prose(rng, 8)}</{others[0].split()[0]}>{body}<{others[1]}>&copy; {prose(rng, 6)}</{others[1].split()[0]}></body></html>"
    return page, "\n".join([f"Title {k}", *lines])


def test_templates_without_telling_names(spark, rng):
    """No article, like tags everywhere, and names that mislead: only the places in the template tell."""
    layouts = {"plain.org": ("div", ("div", "div")), "misled.org": ("div class='sidebar comments'", ("div class='x1'", "div class='article-body'")), "sections.org": ("section", ("section", "section"))}
    rows, expected = [], {}
    for host, (article, others) in layouts.items():
        for k in range(25):
            page, text = _layout(rng, k, article, others)
            expected[len(rows)] = text
            rows.append((len(rows), f"https://{host}/{k}", page))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(table).collect()}
    assert got == expected
    # without the template, the same pages give other texts
    assert all(H.main_text(page) != expected[k] for k, _, page in rows)


def test_renamed_article_gives_the_same_text(spark, rng):
    """The tables' kind of page with its article tag renamed to a div."""
    rows, expected = [], {}
    for k in range(12):
        lines = [prose(rng, 1 + 7 * (k % 5)) for _ in range(1 + k % 3)]
        expected[k] = "\n".join([f"T {k}", *lines])
        rows.append((k, f"https://a.org/{k}", HEAD.replace("Home", prose(rng, 1)) + f"<div class='ad'>{prose(rng, 9)}</div><div><h1>T {k}</h1><p><b>" + "<p>".join(lines) + "</p></div>" + TAIL.replace("&copy; x", f"&copy; {prose(rng, 5)}")))
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected


def test_reader_comments_with_more_text_than_the_article(spark, rng):
    rows, expected = [], {}
    for k in range(15):
        text = prose(rng, 25)
        expected[k] = text
        comments = "".join(f"<div class='comment'><p>{prose(rng, 12)}</p></div>" for _ in range(k % 7))
        rows.append((k, f"https://c.org/{k}", f"<html><body><nav>{prose(rng, 2)}</nav><div><div><p>{text}</p></div><div class='comments'><h3>Comments</h3>{comments}</div></div><footer>{prose(rng, 4)}</footer></body></html>"))
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected


def test_sums_against_counting(rng):
    """The packed sums of a batch are those of plain loops."""
    pages = [(np.array([rng.choice((3, 5, 7, 9)) for _ in range(rng.randint(0, 9))], np.uint64), None) for _ in range(20)]
    pages = [(k, np.arange(len(k), dtype=np.int32)) for k, _ in pages]
    hosts, bodies, copies = [rng.choice("ab") for _ in pages], list(range(20)), [rng.randint(1, 3) for _ in pages]
    want = {}
    for (keys, own), host, n in zip(pages, hosts, copies):
        whole = keys.tolist()
        for key in set(whole):
            at = [k for k, x in enumerate(whole) if x == key]
            s = want.setdefault((host, key), [0] * 5)
            for j, v in enumerate((1, len(at), (at[0] << 20) // len(whole), sum(int(own[:k].sum()) for k in at), sum(int(own[k]) for k in at))):
                s[j] += v
        s = want.setdefault((host, 0), [0] * 5)
        s[0] += 1
        s[1] += n
    got = H._sums(hosts, bodies, copies, pages).to_pylist()
    assert {(r["host"], r["key"]): [r[c] for c in ("bodies", "times", "place", "before", "own")] for r in got} == want


def test_copies_on_a_host_keep_their_text(spark, rng):
    body = "".join(f"<p>{prose(rng, 12)}</p>" for _ in range(4))
    page = f"<html><body><nav><a>Home</a></nav><article><h1>Title</h1>{body}</article><div>All about us</div><footer>f</footer></body></html>"
    loose = page.replace("</h1>", "</h1><div>Loose words</div>")
    rows = [(k, f"https://copies.org/{k}", page) for k in range(30)] + [(100 + k, f"https://loose.org/{k}", loose) for k in range(30)]
    # one article, each time with another last line
    rows += [(200 + k, f"https://near.org/{k}", page.replace("</article>", f"<p>Copy {k}</p></article>")) for k in range(30)]
    # a notice in no paragraph, on all pages of unlike articles
    rows += [(300 + k, f"https://notice.org/{k}", f"<html><body><nav><a>Home</a></nav><article><div>Buy now</div><p>{prose(rng, 20)}</p></article><footer>f</footer></body></html>") for k in range(30)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "Title\n" + body.replace("</p><p>", "\n").replace("<p>", "").replace("</p>", "")
    for k in range(30):
        assert got[k] == text
        assert got[100 + k] == text.replace("Title\n", "Title\nLoose words\n")
        assert got[200 + k] == f"{text}\nCopy {k}"
        assert got[300 + k] and "Buy now" not in got[300 + k]


def test_copies_without_an_article_keep_their_text(spark, rng):
    def page(body):
        return f"<html><body><nav><a>Home</a></nav><div class='top'>Welcome</div><div class='x'><div>{body}</div></div><div>All about us</div><footer>f</footer></body></html>"

    rows, expected = [], {}
    for host, pages, copies, last in (("few.org", 10, 3, False), ("near.org", 10, 3, True), ("hot.org", 60, 20, True)):
        shared = [prose(rng, 12) for _ in range(4)]
        for k in range(pages):
            lines = [*shared, *([f"Copy {k}"] if last else [])] if k < copies else [prose(rng, 12) for _ in range(3)]
            expected[len(rows)] = "\n".join(lines)
            rows.append((len(rows), f"https://{host}/{k}", page("".join(f"<p>{x}</p>" for x in lines))))
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected
