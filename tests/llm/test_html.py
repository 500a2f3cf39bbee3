"""Template deduction: pages whose names say nothing, marked pages, repeated rows, broken and very long markup."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from coderill.llm.html_templates import extract, main_text

WORDS = [f"{a}{b}{c}" for a in "bdklm" for b in "aeiou" for c in "nrst"]


def pages_of(names, n=12, seed=4):
    """Pages of two hosts and their articles, under names for menu, advert, article, side and footer."""
    rng = np.random.default_rng(seed)
    some = lambda k: " ".join(rng.choice(WORDS, size=k))
    rows, want = [], {}
    for i in range(n):
        title, parts = some(6), [some(int(k)) for k in rng.integers(8, 60, size=rng.integers(2, 7))]
        menu = "".join(f'<li><a href="/{k}">{some(1)}</a></li>' for k in range(5))
        body = "".join(f"<p>{x}" if k % 2 else f"<p><b>{x}</b></p>" for k, x in enumerate(parts))
        tagged = {k: f"<{v}>" for k, v in names.items()} | {f"/{k}": f"</{v.split()[0]}>" for k, v in names.items()}
        page = "<html><head><title>{t}</title></head><body>{menu}<ul>{m}</ul>{/menu}{ad}{a}{/ad}{article}<h1>{t}</h1>{b}{/article}{side}{s}{/side}{footer}&copy; {f}{/footer}</body></html>"
        for k, v in (tagged | {"t": title, "m": menu, "a": some(9), "b": body, "s": some(6), "f": some(5)}).items():
            page = page.replace("{" + k + "}", v)
        rows.append((i, f"https://{'ab'[i % 2]}.example/{i}", page))
        want[i] = "\n".join([title, *parts])
    return rows, want


def texts(spark, rows, times=1):
    frame = spark.createDataFrame(rows * times, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "text": F.lit(1), "region": F.lit(2)})
    out = extract(frame)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = out.collect()
    assert len(found) == times * len(rows) and all(r.n_chars == len(r.text) for r in found)
    return {r.page_id: r.text for r in found}


@pytest.mark.parametrize(
    "names",
    [
        {"menu": "nav", "ad": 'div class="ad"', "article": "article", "side": "aside", "footer": "footer"},
        {"menu": 'div class="q1"', "ad": 'div class="q2"', "article": 'div class="q3"', "side": 'div class="q4"', "footer": 'div class="q5"'},
        {"menu": "x-one", "ad": "div", "article": "section class=z", "side": 'div id="k"', "footer": "div role=w"},
    ],
)
def test_names_do_not_matter(spark, names):
    rows, want = pages_of(names)
    assert texts(spark, rows) == want
    assert texts(spark, rows, times=2) == want  # each row twice changes nothing


def test_unchanging_parts_are_furniture(spark):
    rng = np.random.default_rng(2)
    page = "<body><div class=q><h1>{}</h1><p>{}</p><div class=r>Read more of this site every day</div><p>{}</p></div></body>"
    some = lambda k: " ".join(rng.choice(WORDS, size=k))
    parts = {k: (some(4), some(40), some(30)) for k in range(8)}
    assert texts(spark, [(k, "http://h.example", page.format(*p)) for k, p in parts.items()]) == {k: "\n".join(p) for k, p in parts.items()}
    same = "<body><div class=q><h1>One</h1><p>two words</p></div></body>"  # copies of one page keep their text
    assert set(texts(spark, [(k, "http://h.example", same) for k in range(8)]).values()) == {"One\ntwo words"}


def test_repeated_rows_do_not_make_a_template(spark):
    """Two pages with a bar that says the same are too few for a template of their own, however often each stands."""
    page = "<body><div class=q><p>SAME bar text</p></div><div class=r><h1>{0} title</h1><p>{0} words of this page</p></div></body>"
    rows = [(k, f"http://h.example/{k}", page.format(w)) for k, w in enumerate(["first", "second"])]
    once = texts(spark, rows)
    assert all(texts(spark, rows, times=n) == once for n in (2, 5))
    again = [(k + 10, url, html) for k, url, html in rows]  # under other ids
    assert texts(spark, rows + again) == once | {k + 10: t for k, t in once.items()}


def test_marked_pages():
    assert main_text("<a title='x > y' href='q'>link</a>") == "link"
    assert main_text("<p class=ad>buy now<p>the text of it") == "the text of it"
    assert main_text("<body><header>site</header><p>text<br>more</p><footer>f</footer>") == "text\nmore"
    assert main_text("<article><header><h1>T</h1></header><p>text</p></article>") == "T\ntext"
    assert main_text("<p>a <span class=ad>buy</span> b &lt;c&gt; <!-- no --> d<script>if (a < b) '</p>'</script> e") == "a b <c> d e"
    assert main_text("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table><noscript>no</noscript><select><option>n</select>") == "one\ntwo\nx\ny"
    assert main_text("<div>open <b>tags <i>stay</div> text") == "open tags stay\ntext"
    assert main_text("text < 3 and </ p> <1 more") == "text < 3 and <1 more"
    assert main_text("<p>lost<a href='") == "lost" and main_text(None) == main_text("") == main_text("<p>") == ""


@pytest.mark.parametrize("piece", ["<a ", "<script ", "<div class=ad>", "<!-- ", "<p><b>", "\"'=<", '<a x="', "<li>", "</div>", "<table><tr><td>", "x ", "&amp;"])
def test_long_pages_take_linear_time(piece):
    began = time.time()
    main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 20


def test_empty_tables_and_null_rows(spark):
    assert texts(spark, []) == {}
    rows = [(1, None, None), (2, "http://h.example", ""), (None, None, "<p>x"), (4, "http://h.example", " "), (5, "http://h.example", "<p></p>")]
    assert texts(spark, rows) == {1: "", 2: "", None: "x", 4: "", 5: ""}
