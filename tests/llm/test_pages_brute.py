"""Main text: the scan against all stretches, markup that does not end, pages written by hand in other layouts, and time."""

import random
import time

import pytest

from tessera.llm import html_extract

WEIGHTS = html_extract.default_weights()


def test_the_region_is_the_best_of_all_stretches():
    rng = random.Random(3)
    for _ in range(200):
        parts = [rng.choice(["<p>", "</p>", "<div class=menu>", "</div>", "<article>", "</article>", "<b>", "words go here ", "x ", "<ul><li>", "</ul>"]) for _ in range(rng.randint(1, 25))]
        page = html_extract.Page("".join(parts), WEIGHTS)
        n = len(page.scores)
        best = max([(sum(page.scores[a:z]), -a, -z) for a in range(n) for z in range(a + 1, n + 1)], default=(0.0, 0, 0))
        first, last = page.region()
        if best[0] <= 1e-12:
            assert last < first
            continue
        got = [k for k, b in enumerate(page.of) if b in (first, last)]
        inside = [b for b in page.of[-best[1] : -best[2]] if b >= 0]
        assert page.of[got[0]] == first and {first, last} <= set(range(len(page.blocks)))
        total = max(sum(page.scores[a:z]) for a in range(got[0] + 1) for z in range(got[-1] + 1, n + 1))
        assert abs(total - best[0]) < 1e-9 or inside == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><div id=page><div class=navbar><a href=/>Home</a> <a href=/b>Blog</a></div><div class='entry-content'><p>One wet<wbr>land, with <em>long</em> grass.</p><p>Rain&#39;s &lt;here&gt; &eacute;t&eacute;.</p></div><div class=sidebar><p>More to read</p></div></div></body>", "One wetland, with long grass.\nRain's <here> été."),
        ("<html><body><header><p>The Daily Thing</p></header><main><h1>On sums</h1><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is known to all readers.</p><p>It has an <img src=x alt=y>image in it.</p></main><footer>Legal words</footer></body></html>", "On sums\nThe sum a+b is known to all readers.\nIt has an image in it."),
        ("<table><tr><td class=menu><a href=1>A</a><a href=2>B</a></td><td><article><p>Cells hold the whole of this story.</p><blockquote>So it was said,<br>and written.</blockquote></article></td></tr></table>", "Cells hold the whole of this story.\nSo it was said, and written."),
        ("<article><p>Text with an &amp; sign, <object data=x>a fallback</object> and <b>bo</b>ld words.</p><form><p>Sign up now</p><select><option>a</option></select></form><section class=comments><p>First!</p></section></article>", "Text with an & sign, a fallback and bold words."),
        ("<article><p>Never closed, with &am<b>p; parted", "Never closed, with &amp; parted"),
    ],
)
def test_pages_of_other_layouts(page, text):
    assert html_extract.main_text(page, WEIGHTS) == text


@pytest.mark.parametrize("page", ["<a " * 350_000, "x > " + "<a " * 350_000, "<div>w " * 50_000, "<div>" * 50_000 + "w</span></p>" * 50_000, "<button>x " * 100_000, "<ul>" * 20_000 + "<li>x" * 50_000, "<article>x " * 50_000, "<!-- " * 200_000, "<a b='" * 200_000 + ">"], ids=range(9))
def test_long_pages_take_linear_time(page):
    began = time.process_time()
    html_extract.main_text(page, WEIGHTS)
    assert time.process_time() - began < 2


def test_what_stands_beside_the_main_element_is_not_main():
    weights = html_extract.default_weights()
    comments = "<section class=responses><div><b>Ann</b><p>I do not agree with any of this at all, sorry to say</p></div></section>"
    page = f"<body><div class=zq><p>Notes of the day</p></div><main><h1>T</h1><p>some words of the article stand here now</p></main>{comments}</body>"
    assert html_extract.main_text(page, weights) == "T\nsome words of the article stand here now"
    plain = page.replace("<main>", "<div>").replace("</main>", "</div>")
    assert "some words of the article stand here now" in html_extract.main_text(plain, weights)


def test_closing_tags_that_never_end_cost_linear_time():
    weights = html_extract.default_weights()
    for tag in ("script", "style", "title", "textarea"):
        began = time.perf_counter()
        assert html_extract.main_text(f"<p>kept</p><{tag}>" + f"</{tag} " * (10_000_000 // (len(tag) + 3)), weights).startswith("kept")
        assert time.perf_counter() - began < 10
