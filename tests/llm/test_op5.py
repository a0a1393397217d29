import html
import random
import re

import pytest

from modelsieve.llm import op5_wrapper as op
from tests.conftest import SF


def plain_article(page):
    """The article element of the tables' pages by simple means."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
    return " ".join(t for t in texts if t)


def test_whole_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op.op5_wrapper_induction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == plain_article(pages[r["page_id"]]), r["page_id"]
        assert r["n_chars"] == len(r["text"])


def site(k, extra=""):
    """A site without article elements: what varies is content, what stays is template."""
    return (f"<html><head><title>t{k}</title></head><body class='has-sidebar'><div class=top>Welcome to us</div><nav><a>Menu {k}</a></nav>"
            f"<div id=post><h2>Title {k}</h2><p>First &amp; {k}<p>Second <b>bold{k}</b>er\n text</p>{extra}<div class='x'>Read more on us</div></div>"
            f"<aside>Side {k}</aside><div class='user comments'>Nice {k}</div><form>Name {k}</form><footer>Foot {k}</footer><script>var a='<p>{k}'</script></body></html>")


def want(k):
    return f"Title {k} First & {k} Second bold{k}er text"


def test_template_is_learned_from_the_pages_of_a_host(spark):
    rows = [(k, f"http://h.example/{k}", site(k)) for k in range(8)] + [(100 + k, "http://h.example/0", site(0)) for k in range(30)]
    rows += [(200, "http://lone.example/", "<div class=ad>buy</div><p>Only &eacute; page</p>"), (201, None, None), (202, "http://h.example/e", ""),
             (None, "http://h.example/7", site(7)), (203, "http://h.example/x", site(9, "<ul><li>one<li>two</ul>"))]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, slot int")
    got = {r["page_id"]: r["text"] for r in op.main_text(table).collect()}
    assert all(got[k] == want(k) for k in range(8)) and all(got[100 + k] == want(0) for k in range(30))
    assert got[200] == "Only é page" and got[201] == "" and got[202] == "" and got[None] == want(7)
    assert got[203] == want(9) + " one two"
    assert op.main_text(table.limit(0)).count() == 0


def test_copies_of_one_page_stay_whole(spark):
    table = spark.createDataFrame([(k, "http://c.example/", site(1)) for k in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in op.main_text(table).collect()} == {"Welcome to us Title 1 First & 1 Second bold1er text Read more on us"}


def test_tree_matching_keeps_order_and_maximises_matches():
    assert op.align("html(a,b(c,d),e)", "html(b(d),a,e)") == (0, 2, 4, -1, 5)
    assert op.align("html(a)", "html(a)") == (0, 1) and op.align("x", "y") == (-1,)


def test_broken_and_hostile_markup():
    text = lambda page: op.extract(page, None, -1, [])
    assert text("<article><p>a<b>b<p>c<div>d</article>e") == "ab c d"
    assert text("<p>1 < 2 &amp; 3 &am</p><!-- x <p>no</p> --><style>no</style>") == "1 < 2 & 3 &am"
    assert text("<article><header><h1>T</h1></header><p>x</p><footer>no</footer></article><footer>no</footer>") == "T x"
    assert text("<p>a<span class='ad'>no</span>b</p></div></p><p>c") == "ab c"
    assert text("<script>never closed <p>x") == "" and text("<a href='unclosed>x</a> y") is not None
    assert text("<div>" * 50_000 + "deep" + "<p x='" * 20_000) is not None
    assert text("<p>" + "word " * 400_000) == " ".join(["word"] * 400_000)
    deep, wide = op.parse("<div>" * 5_000 + "deep" + "</div>" * 9), op.parse("<p>a</p><div>b</div>" * 3_000)
    assert op.shape(deep).count("div") == 5_000 and op.number_slots(deep) == 5_001
    mapped = op.align(op.shape(wide), op.shape(op.parse("<div>b</div><p>a</p>" * 3_000)))
    assert len(mapped) == 6_001 and sum(x >= 0 for x in mapped) == 6_000


def test_depth_and_names_lose_no_text():
    text = lambda page: op.extract(page, None, -1, [])
    assert text("<div><article>" + "<div>" * 300 + "in" + "</div>" * 300 + "<p>after</p></article></div>") == "in after"
    assert text('<div class="site-content no-sidebar"><p>Main text</p></div>') == "Main text"
    assert text('<article><div class="post share-enabled"><p>Main text</p></div></article>') == "Main text"
    kept = '<section class="related-work"><p>a</p></section><div class="notice-of-change"><p>b</p></div>'
    assert text(f"<article><p>x</p>{kept}</article>") == "x a b"
    assert text('<div class="sidebar"><main><h1>T</h1><p>x</p></main></div>') == "T x"
    assert text('<div class="modal"><p>all there is</p></div>') == "all there is"
    gone = "".join(f'<div class="{c}"><p>no</p></div>' for c in ("related-posts", "sidebar left", "comment-list", "main-nav", "cookie_banner share-buttons", "ad"))
    assert text(f"<article><p>x</p></article>{gone}") == "x" and text(f"<p>x</p>{gone}") == "x"


def random_tree(rng, depth=0):
    kids = [random_tree(rng, depth + 1) for _ in range(rng.choice([0, 1, 2, 3]))] if depth < 3 else []
    return rng.choice("abc"), kids


def largest(x, y):
    """Size of the largest top-down mapping that keeps the order of siblings, by trying all."""
    if x[0] != y[0]:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        both = largest(xs[0], ys[0])
        return max(best(xs[1:], ys), best(xs, ys[1:]), both + best(xs[1:], ys[1:]) if both else 0)

    return 1 + best(x[1], y[1])


def written(node):
    return node[0] + (f"({','.join(map(written, node[1]))})" if node[1] else "")


@pytest.mark.parametrize("table", [op.TABLE, 1])
def test_matching_equals_brute_force(table, monkeypatch):
    monkeypatch.setattr(op, "TABLE", table)
    rng, aligner = random.Random(7), op.Aligner()
    for _ in range(300):
        x, y = ("r", [random_tree(rng) for _ in range(rng.randrange(4))]), ("r", [random_tree(rng) for _ in range(rng.randrange(4))])
        (la, ca), (lb, cb) = op.tree(written(x)), op.tree(written(y))
        mapped = aligner.align(written(x), written(y))
        assert sum(m >= 0 for m in mapped) == largest(x, y)
        above = {c: p for p, cs in enumerate(ca) for c in cs}
        for slot, cs in enumerate(cb):
            images = [mapped[c] for c in cs if mapped[c] >= 0]
            assert images == sorted(set(images)) and all(above[m] == mapped[slot] for m in images)
            assert mapped[slot] < 0 or la[mapped[slot]] == lb[slot]


@pytest.mark.parametrize("pages", [100, 4_000])
def test_same_page_gives_same_text_on_hosts_of_any_size(spark, pages):
    """Headings of 60 kinds are data however many pages share one; a slot that is constant on nearly all pages is template."""
    page = "concat('<div class=a>Our site</div><div class=h>Kind ', {k} % 60, '</div><div class=t>Text of ', {k}, '</div><div class=z>', if({k} % 20 = 3, 'Sale', 'Imprint'), '</div>')"
    rows = spark.range(pages).selectExpr("id AS page_id", "concat('http://h.example/', id) AS url", page.format(k="id") + " AS html")
    got = {r["page_id"]: r["text"] for r in op.main_text(rows).filter("page_id in (3, 7, 99)").collect()}
    assert got == {k: f"Kind {k % 60} Text of {k}" for k in (3, 7, 99)}
