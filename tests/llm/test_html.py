import html
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.html_text import Node, Slot, extract_texts, fold, main_texts, match, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">%s</a></ul></nav><div class="cookie-notice">We use</div><div id="sidebar">side</div>
<main><article><header><h1>Title %s</h1></header><p>One &amp; <b>two</b>
three<br>four %s<p>Five &lt;6&gt; %s<!-- c --><div class="share-buttons">Share</div><ul><li>i%s<li>j%s</ul><p>Read more on this site</p><aside>x</aside></article>
<section class="comments"><p>bad comment</p></section></main><form><input value=1>f</form><footer>&copy; f"""


def test_page():
    want = "Title {0}\n\nOne & two three four {0}\n\nFive <6> {0}\n\ni{0}\n\nj{0}"
    pages = [PAGE % (f"menu{i}", i, i, i, i, i) for i in range(6)]
    assert main_texts(pages) == [want.format(i) for i in range(6)]  # the line on all pages is template
    assert main_texts(pages[:1]) == [want.format(0) + "\n\nRead more on this site"]
    assert main_texts([pages[0]] * 9) == [want.format(0) + "\n\nRead more on this site"] * 9  # copies make no template


def brute_match(a, b):
    if a.symbol != b.symbol:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, c in enumerate(a.children):
        for j, d in enumerate(b.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_match(c, d))
    return best[-1][-1] + 1


def _slot(tag, kids):
    s = Slot(Node(tag))
    s.children = kids
    return s


trees = st.recursive(st.just(()).map(lambda _: _slot("#", [])), lambda c: st.builds(_slot, st.sampled_from(["p", "div"]), st.lists(c, max_size=4)), max_leaves=12)


@settings(max_examples=100, deadline=None)
@given(trees, trees)
def test_matching_is_largest_and_keeps_order(a, b):
    a, b = _slot("r", [a]), _slot("r", [b])
    size, pairs = match(a, b)
    assert size == brute_match(a, b)
    assert len({id(x) for x, _ in pairs}) == len(pairs) == size == len({id(y) for _, y in pairs})


@settings(max_examples=200, deadline=None)
@given(st.text("<>/pdivspan \"'=&;a!-b", max_size=60))
def test_any_markup_is_put_up_with(source):
    parse(source)
    assert len(main_texts([source, source + "x"])) == 2


def test_long_and_deep_markup_in_little_time():
    began = time.process_time()
    for source in ("<div>" * 10_000 + "x", '<a "' * 80_000, '<a "' * 20_000 + ">", "<" * 50_000, "".join(f"<p>a{i}</p><ul><li>b{i}</ul>" for i in range(3000)), "<p>" * 20_000 + "</div>" * 20_000, "<table><tr><td>" * 3000 + "x"):
        assert len(main_texts([source, source + "y"])) == 2
    assert time.process_time() - began < 20
    assert main_texts(["<div>" * 10_000 + "x"]) == ["x"]
    assert main_texts(['<p>one <a "two</p>'])[0].startswith("one")


def test_siblings_are_folded():
    top = fold(parse("<div><p>a</p><ul><li>b<li>c</ul><p>d</p></div>"))
    div = top.children[0]
    assert [c.symbol for c in div.children] == ["p", "ul"] and [n.text for n in div.children[0].children[0].nodes] == ["a", "d"]


def pages_of(make, n=8):
    words = "river stone cloud window garden letter mountain silver morning copper".split()
    text = lambda i, k: " ".join(words[(i * 7 + k * 3 + j * (i + 1)) % 10] + str(i) for j in range(30))
    return [make(i, text) for i in range(n)], text


def test_slots_decide_where_names_mislead():
    pages, text = pages_of(lambda i, t: f'<body><div class="top">Site name</div><div id="main" class="post menu-item-story"><h1>{t(i, 9)}</h1><p>{t(i, 1)}</p><p>{t(i, 2)}</p></div><div class="box">Read {t(i, 5)[:40]}</div></body>')
    assert main_texts(pages) == ["\n\n".join(text(i, k) for k in (9, 1, 2)) for i in range(8)]
    pages, text = pages_of(lambda i, t: f"<main><article><p>short {i}</p></article><div><p>{t(i, 1)}</p><p>{t(i, 2)}</p></div></main>")
    assert all(text(i, 1) in x and text(i, 2) in x for i, x in enumerate(main_texts(pages)))
    pages, text = pages_of(lambda i, t: f"<body><h1>{t(i, 3)}</h1><div><p>{t(i, 1)}</p><p>{t(i, 2)} <span class='ad'>{t(i, 4)}</span> end{i}</p></div><div class='comments'><p>{t(i, 6) * 9}</p></div></body>")
    assert main_texts(pages) == [f"{text(i, 3)}\n\n{text(i, 1)}\n\n{text(i, 2)} end{i}" for i in range(8)]


def test_constant_texts_go_at_any_place():
    pages, text = pages_of(lambda i, t: "<article>" + "".join(f"<p>{t(i, k)}</p>" + "<p>Subscribe to read on</p>" * (k == i % 3) for k in range(4)) + "</article>", 6)
    assert main_texts(pages) == ["\n\n".join(text(i, k) for k in range(4)) for i in range(6)]
    assert main_texts(pages[:2]) == ["\n\n".join(text(i, k) for k in range(4)) for i in range(2)]


def test_copies_make_no_template():
    one = "<article>" + "".join(f"<p>paragraph {k} of it</p>" for k in range(9)) + "</article>"
    assert [x.count("paragraph") for x in main_texts([one, one.replace("8 of it", "8 of this")])] == [9, 9]


def test_without_the_wrapper_most_pages_change(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id < 48").collect()]
    assert sum(a != b for a, b in zip(main_texts(pages), main_texts(pages, use_wrapper=False), strict=True)) > len(pages) / 2


def test_copied_rows_and_blocks(spark, monkeypatch):
    from tidemark.llm import html_text

    pages, text = pages_of(lambda i, t: f"<nav><a href=x>{t(i, 7)}</a></nav><article><p>{t(i, 1)}</p></article>", 60)
    rows = [(k, f"http://h{k % 2}.example/{k}", pages[k % 60 if k < 90 else 0]) for k in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: text(k % 60 if k < 90 else 0, 1) for k in range(150)}
    for block in (48, 8):
        monkeypatch.setattr(html_text, "BLOCK", block)
        monkeypatch.setattr(html_text, "SENT_HOSTS", 0 if block == 8 else 100)
        found = extract_texts(df).collect()
        assert len(found) == 150 and {r.page_id: r.text for r in found} == want


def test_table_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")

    def truth(s):
        a = s[s.index("<article>") + 9 :]
        a = a[: a.index("</article>")] if "</article>" in a else a[: a.index("<footer")]
        parts = (" ".join(html.unescape(re.sub("<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:h1|p)>", a))
        return "\n\n".join(x for x in parts if x)

    want = {r.page_id: truth(r.html) for r in pages.collect()}
    found = extract_texts(pages).collect()
    assert {r.page_id: r.text for r in found} == want and all(r.n_chars == len(r.text) for r in found)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://a/", ""), (None, "http://a/", "<p>x"), (3, "http://a/", "<p>x"), (3, "http://a/", "<p>x"), (4, None, "plain & simple"), (5, "http://b/", "<p>" + "long " * 20_000)]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, block int")
    found = sorted((str(r.page_id), str(r.url), r.text[:20], r.n_chars) for r in extract_texts(df).collect())
    assert found == sorted([("1", "None", "", 0), ("2", "http://a/", "", 0), ("None", "http://a/", "x", 1), ("3", "http://a/", "x", 1), ("3", "http://a/", "x", 1), ("4", "None", "plain & simple", 14), ("5", "http://b/", "long long long long ", 99_999)])
    assert extract_texts(df.limit(0)).count() == 0
