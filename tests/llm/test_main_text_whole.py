"""Main text keeps the whole article: paths, wrappers, forms, headers and inline elements."""

import pytest

from jobtrail.llm import html_extract


def extracted(spark, pages):
    df = spark.createDataFrame([(k, f"http://{h}/{k}", p) for k, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(html_extract.main_text(df).collect(), key=lambda r: r.page_id)]


def alone(page, path=""):
    return html_extract.Scan(page).text(path)


LONG = "<p>" + "long text " * 60 + "</p>"
TEXT = ("long text " * 60).strip()
SHELL = "<body><nav><p>menu</p></nav>%s<footer><p>foot</p></footer></body>"


def test_title_and_lead_outside_the_inner_container_stay(spark):
    page = SHELL % f"<article><h1>T</h1><p>lead</p><div class=body>{LONG}</div></article>"
    quoted = SHELL % f"<article><p>He said</p><blockquote>{LONG}</blockquote></article>"
    got = extracted(spark, [("a", page)] * 3 + [("b", quoted)])
    assert got == [f"T\n\nlead\n\n{TEXT}"] * 3 + [f"He said\n\n{TEXT}"]


def test_minority_template_is_not_cut_to_a_box_of_the_winning_path(spark):
    most = SHELL % f"<div class=story>{LONG}</div><div>label</div>"
    few = SHELL % f"<div class=story><p>box</p></div><div class=other><h2>Two</h2>{LONG}</div>"
    got = extracted(spark, [("a", most)] * 18 + [("a", few)])
    assert got[:18] == [TEXT] * 18 and got[18] == f"box\n\nTwo\n\n{TEXT}"


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "content-with-sidebar", "single no-sidebar", "post comments-open", "widget-area content", "search-result", "search", "sidebar"])
def test_wrappers_named_after_noise_keep_the_page(wrapper):
    assert alone(SHELL % f'<div class="{wrapper}"><h1>T</h1>{LONG}<div class="sidebar"><p>side</p></div></div>') == f"T\n\n{TEXT}"


def test_form_around_the_page_and_headers_of_articles():
    assert alone(SHELL % f"<form><h1>T</h1>{LONG}<div class='comments'>{LONG}</div></form>") == f"T\n\n{TEXT}"
    assert alone(SHELL % f"<header><p>site</p></header><article><header><h1>T</h1></header>{LONG}</article>") == f"T\n\n{TEXT}"
    assert alone(SHELL % f"<div class=post><div class=article-header><h1>T</h1></div>{LONG}</div>") == f"T\n\n{TEXT}"


@pytest.mark.parametrize("noise", ["comments", "post-comments", "cookie-notice", "site-header", "share-buttons", "ad-slot", "main-nav"])
def test_noise_by_whole_names(noise):
    assert alone(SHELL % f"<div><h1>T</h1>{LONG}<div id={noise}>{LONG}</div></div>") == f"T\n\n{TEXT}"


def test_long_comments_under_a_short_article():
    assert alone(SHELL % f"<div class=post><p>Short.</p><div class=comments>{LONG * 5}</div></div>") == "Short."


def test_inline_noise_is_dropped_within_its_paragraph():
    page = "<p>One <button>Buy</button><select><option>x<option>y</select><span class='ad'>now <span>and</span> then</span>two.</p><p>Three</p>"
    assert alone(page) == "One two.\n\nThree"
    assert alone(f"<span class=widget>{LONG}</span>") == TEXT


def test_malformed_pages_take_linear_time():
    import time

    for bad in ('<a "', "<a ='x ", '<p class="', "<!", "<b>", "<div>", "<div class=nav>", "</i><b>", "<b></p>", "<p>x</section>", '<a b=">'):
        began = time.process_time()
        for page in (bad * (400_000 // len(bad)), "<article><p>kept</p></article>" + bad * (200_000 // len(bad))):
            scan = html_extract.Scan(page)
            text = scan.text("")
        assert "kept" in text and time.process_time() - began < 20, bad


def articles(n):
    return [f"<p>{f'real words of article {k} ' * 40}</p>" for k in range(n)]


def words(html):
    return html[3:-4].strip()


def test_host_consensus_drops_what_other_pages_have_too(spark):
    deals = "<div class='deals'><p>" + "cheap things here " * 20 + "</p></div>"
    many = articles(40)
    pages = [("one", f"<body><div class='story'>{b}</div>{deals if k in (7, 30) else ''}</body>") for k, b in enumerate(many)]
    pages += [("two", f"<body><div class='t{'a' if k % 2 else 'b'}'>{b}</div></body>") for k, b in enumerate(many[:10])]
    assert extracted(spark, pages) == [words(b) for b in many] + [words(b) for b in many[:10]]
    assert "cheap" in alone(pages[7][1])  # the page by itself


def test_a_container_that_one_page_alone_has_stays(spark):
    """Also if that page is there twice, its text stands twice within it, or another host has it."""
    many, more = articles(40), "<div class='more'><p>" + "its own words " * 20 + "</p><p>" + "its own words " * 20 + "</p></div>"
    pages = [("one", f"<body><div class='content'>{b}</div>{more if k == 7 else ''}</body>") for k, b in enumerate(many)]
    pages += [pages[7], ("two", pages[7][1])]
    out, own = extracted(spark, pages), ("its own words " * 20).strip()
    whole = f"{words(many[7])}\n\n{own}\n\n{own}"
    assert [out[7], *out[40:]] == [whole] * 3
    assert out[:7] + out[8:40] == [words(b) for k, b in enumerate(many) if k != 7]


def test_split_pages_equal_a_plain_count(spark):
    """Random pages of three hosts against a count of blocks by pages on the driver."""
    import random

    rng, pages = random.Random(5), []
    for k, b in enumerate(articles(150)):
        extra = "".join(f"<div class='x{rng.choice('ab')}'><p>{'extra ' * 20}{rng.randrange(6)}</p></div>" for _ in range(rng.choice((0,) * 20 + (1, 2))))
        pages.append((f"h{k % 3}", f"<body><div class='story'>{b}</div>{extra}</body>"))
    splits = [html_extract.Scan(p).split("/body/div.story") for _, p in pages]
    seen = {}
    for (host, _), split in zip(pages, splits):
        for block, place in split:
            if place:
                seen.setdefault((host, place, block), set()).add(tuple(t for t, q in split if not q))
    want = ["\n\n".join(t for t, q in split if not q or len(seen[host, q, t]) == 1) for (host, _), split in zip(pages, splits)]
    assert any(q for split in splits for _, q in split)
    assert extracted(spark, pages) == want


def test_names_weigh_within_a_sentence_and_headings():
    assert alone(SHELL % f"<div><h1 class='page-header'>T</h1>{LONG}</div>") == f"T\n\n{TEXT}"
    assert alone(SHELL % f"<div><h1><span class='title-header'>T</span></h1>{LONG}</div>") == f"T\n\n{TEXT}"
    assert alone(SHELL % f"<div>{LONG}<p>The <b id=share>share</b> and <span class=side>side</span>.</p></div>") == f"{TEXT}\n\nThe share and side."
    assert alone(SHELL % f"<div>{LONG}<p>Read <a class=share href=x>Tell</a>on.</p><p><span class=share>Share</span></p></div>") == f"{TEXT}\n\nRead on."


@pytest.mark.parametrize("noise", ["class='commentlist'", "id=disqus_thread", "class='comments-area'"])
def test_names_of_readers_lists(noise):
    assert alone(SHELL % f"<div>{LONG}<ol {noise}><li>{'I agree. ' * 90}</li></ol></div>") == TEXT
