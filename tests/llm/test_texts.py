"""HTML extraction and edit-aware counts."""

import random
from html.parser import HTMLParser

from cairn.llm import html_text, token_counts
from cairn.llm.queries import tokenizer

PROSE = "The river and the house are in the garden that was there for the people of the town, and it is by the road."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x:1}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now, the best of all.</div>
<article><h1>A short &amp; plain title</h1><p>{PROSE}<p><b>Tiny.</b><br>  Next\n line.<p>{PROSE} &eacute;&#233;
<div class="comments"><p>{PROSE}</p></div></article><aside>{PROSE}</aside><form>Your mail</form><footer>&copy; us</footer></body>"""


def test_article():
    assert html_text.main_text(PAGE) == f"A short & plain title\n{PROSE}\nTiny. Next line.\n{PROSE} éé"


def test_without_article():
    page = f"<body><div id=menu><a href=x>One</a> <a href=y>Two</a></div><div><h2>Heading</h2><p>{PROSE}</p><p>{PROSE}</p><p>End.</p></div><p><a href=z>{PROSE}</a></p></body>"
    assert html_text.main_text(page) == f"Heading\n{PROSE}\n{PROSE}\nEnd."


def test_odd_markup(spark):
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<script>x")
    assert html_text.main_text("plain words") == "plain words"
    assert html_text.main_text(f"<article><p title='a>b' hidden>no</p><p>{PROSE}<!-- c <p> --></article>") == PROSE
    long = "<article>" + f"<p>{PROSE}</p>" * 5000
    assert html_text.main_text(long).count("\n") == 4999
    assert html_text.main_text('<p class="' + "x" * 100_000) is not None
    rows = [(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract_main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.n_chars for r in out.collect())[0] == 0 and html_text.extract_main_text(df.limit(0)).count() == 0


BODY = "\n".join([PROSE] * 4)
PARAGRAPHS = "".join(f"<p>{PROSE}</p>" for _ in range(4))


def test_names_do_not_lose_the_main_text():
    menu, note = "<div class=menu><a href=a>One</a> <a href=b>Two</a></div>", f"<div class='comments-area'><p>{PROSE}</p></div>"
    for page in (
        f'<div class="layout with-sidebar">{menu}<article>{PARAGRAPHS}</article></div>',
        f'<article class="post has-comments">{PARAGRAPHS}{note}</article>',
        f'<div id="page" class="no-sidebar">{menu}<div>{PARAGRAPHS}</div>{note}</div>',
        f'<div class="page-header-fixed">{menu}<div>{PARAGRAPHS}</div>{note}</div>',
        f'<div class="sidebar-layout">{menu}<main>{PARAGRAPHS}</main></div><div><p>{PROSE}</p></div>{note}',
    ):
        assert html_text.main_text(f"<body>{page}</body>") == BODY, page
    assert html_text.main_text(f"<body><div>{PARAGRAPHS}</div><div class=sidebar><article><p>{PROSE}</p></article></div>{note * 20}</body>") == BODY
    assert html_text.main_text(f"<body><div class=menu><a href=a>{PROSE}</a></div></body>") == ""


def test_furniture_is_never_read_for_want_of_other_text():
    short, filler = "The river and the house are in the garden that was there for the people of the town.", f"<p>{PROSE}</p>" * 4
    for name in ("sidebar", "comment-list", "cookie-banner", "newsletter", "related-posts"):
        assert html_text.main_text(f"<body><div id=content><p>{short}</p></div><div class={name}>{filler}</div></body>") == short
        assert html_text.main_text(f"<body><div id=content><p>Soon.</p></div><div class={name}>{filler}</div></body>") in ("Soon.", "")
        assert html_text.main_text(f"<body><div class={name}>{filler}</div></body>") == ""


def test_unclosed_furniture_ends_where_an_article_begins():
    for tag in ("nav", "aside", "header", "menu", "form"):
        assert html_text.main_text(f"<body><{tag}><a href=a>Home</a><article>{PARAGRAPHS}</article></body>") == BODY, tag
        assert html_text.main_text(f"<body><{tag}><ul><li>Home<main>{PARAGRAPHS}</main><{tag}>More</{tag}></body>") == BODY, tag
    closed = f"<body><aside><article><p>{PROSE}</p></article></aside><article>{PARAGRAPHS}</article></body>"
    assert html_text.main_text(closed) == BODY


def test_a_card_is_not_the_main_text():
    card = "<article><h3>Card</h3><p>Short teaser.</p></article>"
    assert BODY in html_text.main_text(f"<body><div id=content>{PARAGRAPHS}</div>{card}</body>")
    long_card = f"<article><p>{PROSE}</p></article>"
    assert html_text.main_text(f"<body><div id=content>{PARAGRAPHS}{PARAGRAPHS}</div>{long_card}</body>").startswith(f"{BODY}\n{BODY}")


def test_a_page_of_another_language():
    text = "Joki virtaa kaupungin halki ja talot seisovat sen rannalla, missä ihmiset kulkevat joka aamu töihin ja koulun pihalla lapset leikkivät. " * 2
    page = f"<body><nav><a href=a>Koti</a></nav><div><h1>Otsikko</h1><p>{text}</p><p>{text}</p></div><footer>{text}</footer></body>"
    assert html_text.main_text(page) == f"Otsikko\n{text.strip()}\n{text.strip()}"


def test_attributes_go_by_name():
    other = "In the morning the men of the village went down to the shore with the nets that had been mended, and they did not come back."
    for element in ('<p title="a hidden gem">', '<p data-id="share">', '<section id="side-effects">', '<section id="search">', '<div class="elementor-widget">', '<div data-hidden=x>'):
        assert html_text.main_text(f"<body><article>{PARAGRAPHS}{element}{other}</article></body>") == f"{BODY}\n{other}", element
    for element in ('<p hidden="">', '<p aria-hidden=true>', '<p style="display : none">', '<section class="x post-comments">', '<section role=navigation>'):
        assert html_text.main_text(f"<body><article>{PARAGRAPHS}{element}{other}</article></body>") == BODY, element
    assert html_text.main_text(f"<body><article><a href=x>Read on</a></article><div>{PARAGRAPHS}</div></body>").endswith(BODY)
    assert html_text.main_text(f"<body><div class=search>Find it</div><div>{PARAGRAPHS}</div></body>") == BODY


def test_density_decides_where_no_place_does():
    """Without article, main or names, stop words, length and links decide, and
    short blocks follow their neighbours."""
    codes = " ".join(f"QX{k}-ZT" for k in range(60))
    page = f"<body><div><p>{codes}</p><p>Top list</p></div><div><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><div><p>{codes}</p><p>End list</p></div></body>"
    assert html_text.main_text(page) == f"{PROSE}\nShort.\n{PROSE}"


class Articles(HTMLParser):
    """Blocks inside `article` of a given page, without asides and comments."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.parts = [], [], []

    def cut(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCK_TAGS:
            self.cut()
        elif tag == "br":
            self.handle_data(" ")
        if tag in ("article", "aside", "nav", "form", "div", "section", "footer", "script", "style", "header"):
            self.stack.append((tag, tag in ("aside", "nav", "form", "footer", "script", "style") or dict(attrs).get("class") in ("ad", "comments", "cookie", "sidebar", "share", "newsletter", "related")))

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK_TAGS:
            self.cut()
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(off for _, off in self.stack):
            self.parts.append(data)


def test_given_pages_against_a_plain_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_main_text(rows).collect()}
    for r in rows.collect():
        plain = Articles()
        plain.feed(r.html or "")
        plain.cut()
        assert got[r.page_id] == "\n".join(plain.blocks), r.page_id


def random_text(rng, n):
    return "".join(rng.choice(["the", "a ", "  ", "\n", "x9", "'s", "é", "!!", " word", "\t", "12", "中", "，", "½", "_", "e\u0301", "\u2019"]) for _ in range(n))


def test_edits_against_full_count():
    count, rng = token_counts.counter(*tokenizer()), random.Random(5)
    for _ in range(250):
        text = random_text(rng, rng.choice([0, 1, 5, 300, 900]))
        edits, at = [], 0
        for _ in range(rng.randint(1, 4)):
            at += rng.randint(0, 400)
            if at > len(text):
                break
            cut = min(rng.choice([0, 0, 1, 7, 300]), len(text) - at)
            edits.append((at, cut, rng.choice(["", " ", "x", "\n\n", "new words 12", "'s"])))
            at += cut + 1
        tree = token_counts.Tree.of(text, count)
        assert tree.tokens[1] == count(text) and sum(token_counts.leaves(text)) == len(text)
        new, again = token_counts.edit(text, tree, edits, count)
        want, done = [], 0
        for p, cut, put in edits:
            want += [text[done:p], put]
            done = p + cut
        assert new == "".join(want) + text[done:]
        assert tree.tokens[1] == count(new) and tree.chars[1] == len(new) and again <= len(new)


def test_leaves_are_pre_tokens_and_stay_small():
    """Text without blanks; an insertion far larger than the text."""
    count, rng = token_counts.counter(*tokenizer()), random.Random(3)
    chinese = "".join(rng.choice("的一是不了人我在有他这中大来上国") if k % 23 else rng.choice("，。！") for k in range(300_000))
    tree = token_counts.Tree.of(chinese, count)
    new, again = token_counts.edit(chinese, tree, [(150_000, 1, "好")], count)
    assert again < 2000 and tree.tokens[1] == count(new)
    tree = token_counts.Tree.of("short text", count)
    large, again = token_counts.edit("short text", tree, [(5, 0, "many more words, and marks; " * 15_000)], count)
    assert again == len(large) and tree.tokens[1] == count(large) and (tree.chars[tree.width :].max() < 2000) and tree.width <= 4096
    for at in (1, 9, 200_000, len(large) - 3):
        large, again = token_counts.edit(large, tree, [(at, 1, "x")], count)
        assert again < 2000 and tree.tokens[1] == count(large) and tree.chars[1] == len(large)
    gone, again = token_counts.edit(large, tree, [(3, len(large) - 6, "")], count)
    assert gone == large[:3] + large[-3:] and tree.tokens[1] == count(gone) and again == len(gone)
    one = "x" * 5000  # a pre-token is never cut
    tree = token_counts.Tree.of(one, count)
    assert tree.width == 1 and tree.tokens[1] == count(one)


def test_counts_on_spark(spark):
    far = "words of a text " * 4000
    rows = [(1, far + "me@example.org " + far, None), (1, far, None), (None, None, None), (2, "", [(5, 3, "put in")]), (3, "abc", [(1, 1, None)])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}")
    own = token_counts.count_edited(df, *tokenizer()).collect()
    count = token_counts.counter(*tokenizer())
    by = {r.n_chars_edited: r for r in own}
    assert by[6].n_tokens == 0 and by[6].n_tokens_edited == count("put in") and by[2].n_tokens_edited == count("ac") and by[0].n_tokens == 0
    out = token_counts.count_edited(token_counts.find_redactions(df.drop("edits")), *tokenizer())
    r = [x for x in out.collect() if x.chars_encoded_again][0]
    assert r.n_tokens == count(rows[0][1]) and r.n_tokens_edited == count(far + "[removed] " + far)
    assert r.chars_encoded_again < 2000 and r.tree_tokens[1] == r.n_tokens_edited
    assert token_counts.count_edited(df.limit(0), *tokenizer()).count() == 0


def test_kept_trees_follow_many_edits(spark):
    count, rng = token_counts.counter(*tokenizer()), random.Random(8)
    texts = {i: random_text(rng, 3000) for i in range(8)} | {8: "", 9: "one line"}
    kept = spark.createDataFrame([(i, t, None) for i, t in texts.items()], f"doc_id long, text string, edits {token_counts.EDITS}")
    kept = {r.doc_id: (r.tree_chars, r.tree_tokens) for r in token_counts.count_edited(kept, *tokenizer()).collect()}
    for turn in range(3):
        edits = {i: [(rng.randint(-5, 3100), rng.randint(-3, 90), rng.choice(["", "new", " the\n"])) for _ in range(3)] for i in texts}
        rows = [(i, t, edits[i], *kept[i], "clash") for i, t in texts.items()]
        df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}, tree_chars array<long>, tree_tokens array<long>, text_edited string")
        out = token_counts.count_edited(df, *tokenizer(), tree_cols=("tree_chars", "tree_tokens"), with_text=True).collect()
        for r in out:
            want, done, old = [], 0, texts[r.doc_id]
            for at, cut, put in token_counts.in_order([{"at": a, "cut": c, "put": p} for a, c, p in edits[r.doc_id]], len(old)):
                want += [old[done:at], put]
                done = at + cut
            assert r.text_edited == "".join(want) + old[done:]
            assert r.n_tokens == count(old) and r.n_tokens_edited == count(r.text_edited)
        texts = {r.doc_id: r.text_edited for r in out}
        kept = {r.doc_id: (r.tree_chars, r.tree_tokens) for r in out}
    assert token_counts.in_order([{"at": 4, "cut": 9, "put": "b"}, {"at": 2, "cut": 4, "put": "a"}, None, {"at": -1, "cut": -1, "put": None}], 8) == [(0, 0, ""), (2, 4, "a"), (6, 2, "b")]
