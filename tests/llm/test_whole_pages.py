"""Text of pages without an article element that thresholds used to lose."""

from pulseframe.llm import html_text

SENTENCE = "The quick brown fox is in the house and it was not there when we came to see what was in it, and so on for a while. "
LONG = (SENTENCE * 2).strip()


def test_last_short_paragraph_before_a_footer_stays():
    assert html_text.main_text(f"<nav>Menu</nav><p>First.<p>{LONG}<p>Short end.</p><footer>(c)</footer>") == f"First.\n{LONG}\nShort end."
    assert html_text.main_text(f"<p>{LONG}<p>Short end.") == f"{LONG}\nShort end."


def test_pages_without_a_good_block_keep_the_undecided():
    middle = SENTENCE.strip()
    assert html_text.main_text(f"<nav><a href=x>Home</a></nav><h1>Head</h1><p>{middle}<p>{middle}<footer>(c)</footer>") == f"Head\n{middle}\n{middle}"
    assert html_text.main_text("<div class=menu>Home</div><p>Only this.") == "Only this."


def test_few_stop_words_do_not_make_a_block_bad():
    code = "x = compute(alpha, beta); y = transform(gamma, delta); print(x, y); assert x != y; raise ValueError(x)"
    assert html_text.main_text(f"<p>{LONG}<pre>{code}</pre><p>{LONG}") == f"{LONG}\n{code}\n{LONG}"


def test_marks_name_the_element_itself():
    assert html_text.main_text(f'<div class="content has-sidebar"><article><h1>T</h1><p>{LONG}</article></div>') == f"T\n{LONG}"
    assert html_text.main_text(f'<div class="page-with-sidebar"><p>{LONG}</div>') == LONG
    assert html_text.main_text(f'<article><h1 class="entry-header">Head</h1><p>{LONG}</article>') == f"Head\n{LONG}"
    page = f'<article><p>{LONG}<p class="advert">Buy now</p><ul><li class="share">Tweet<li>item</ul><p class="ad">x<div>y</div></article>'
    assert html_text.main_text(page) == f"{LONG}\nitem\ny"
    assert html_text.main_text(f"<div class='sidebar-left'><p>{LONG}</div><main class='no-menu'><p>{LONG} 2</main>") == f"{LONG} 2"
    assert html_text.main_text(f"<div class='site menu'><main><p>{LONG}</main></div><article class='comment'><p>{LONG} 3</article>") == LONG


def test_the_two_passes_decide_inside_an_article():
    links = "<ul>" + "".join(f"<li><a href='{i}'>Another page of ours number {i}</a>" for i in range(4)) + "</ul>"
    kept = html_text.blocks_of(f"<article><p>{LONG}<p>Short one.{links}<p>{LONG}</article><p>beside it</p>")
    labels = [html_text.alone(*b, True) for b in kept]
    assert labels == ["good", "short", *["bad"] * 4, "good", "short"]
    assert html_text.main_text(f"<article><p>{LONG}<p>Short one.{links}<p>{LONG}</article><p>beside it</p>") == f"{LONG}\n{LONG}"
    assert html_text.main_text(f"<article><p>{LONG}<p>Short one.<p>{LONG}</article><p>{SENTENCE}</p>") == f"{LONG}\nShort one.\n{LONG}"
    assert html_text.main_text("<nav>Menu</nav><article><p>Only this.</article>") == "Only this."


# A page cut by hand: what stays (True) and what goes.
BY_HAND = [
    ("<header><h1>Site name</h1></header>", False), ("<nav class=top><a href=/>Home</a> <a href=/n>News</a></nav>", False), ("<div role=search>Find</div>", False),
    ("<h1>A title</h1>", True), ("<p>By someone</p>", True), (f"<p>{LONG}</p>", True), ("<blockquote>It was so.</blockquote>", True), (f"<p>{SENTENCE}</p>", True),
    ("<div class='promo box'>Buy this now</div>", False), (f"<p>{LONG}</p>", True), ("<table><tr><td>1</td></tr></table>", True), ("<p>The end &amp; more.</p>", True),
    ("<div id=comments><p>First!</p><div class=reply>" + LONG + "</div></div>", False), ("<p hidden>secret</p>", False), ("<form>Mail <input> <button>Send</button></form>", False),
    ("<aside>" + LONG + "</aside>", False), ("<footer>&copy; us</footer>", False),
]


def test_a_page_cut_by_hand():
    text = html_text.main_text("<body>" + "".join(h for h, _ in BY_HAND))
    plain = {h: html_text.blocks_of(h)[0][0] for h, stays in BY_HAND if stays}
    assert text.split("\n") == list(plain[h] for h, stays in BY_HAND if stays)
    in_article = "<body>" + "".join(h for h, _ in BY_HAND[:3]) + "<article>" + "".join(h for h, _ in BY_HAND[3:-1]) + "</article>" + BY_HAND[-1][0]
    assert html_text.main_text(in_article) == text
