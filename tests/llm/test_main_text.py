import random
import time

from metaveil.llm import main_text


def test_examples_give_their_articles():
    for page in main_text.EXAMPLES:
        inside = page[page.index(main_text.BEGIN) : page.index(main_text.END)]
        assert main_text.extract(page) == main_text.extract(inside)


def test_odd_pages():
    assert main_text.extract(None) == main_text.extract("") == main_text.extract("<p> </p>") == ""
    assert main_text.extract("plain &amp; simple   text") == "plain & simple text"
    page = "<body><nav><a>Menu</a></nav><article><h1>T&eacute;st</h1><p>one <b>two</b><br>three<p>x.<div class='ad'>buy</div><p>four five six</article><footer>f</footer>"
    assert main_text.extract(page) == "Tést\none two three\nx.\nfour five six"
    assert main_text.extract("<p>" + "word " * 50_000).count("word") == 50_000


def test_best_region():
    assert main_text.best_region([-1, 2, -1, 3, -5, 1]) == (1, 4)
    assert main_text.best_region([-1.0]) == (0, 0)


def brute_region(scores):
    best, found = 0.0, (0, 0)
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            if sum(scores[a:b]) > best or sum(scores[a:b]) == best and best > 0 and found[0] == a:
                best, found = sum(scores[a:b]), (a, b)
    return found


def test_best_region_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.randrange(-4, 5) for _ in range(rng.randrange(0, 14))]
        a, b = main_text.best_region(scores)
        c, d = brute_region(scores)
        assert sum(scores[a:b]) == sum(scores[c:d])


def test_the_scan_decides(monkeypatch):
    pages = [*main_text.EXAMPLES, "<div><a href='/'>Home</a></div><h1>T</h1><p>A text that goes on for a while.</p><div><a href='/n'>Next</a></div>"]
    right = [main_text.extract(p) for p in pages]
    monkeypatch.setattr(main_text, "best_region", lambda scores: (0, len(scores)))
    assert sum(main_text.extract(p) != r for p, r in zip(pages, right)) >= len(pages) // 2


def test_weights_tell_words_apart():
    w = main_text.weights()
    plain = [w.word + b + w.link[False] + w.mark[""] for k, b in w.block.items() if k in ("p", "div", "li", "h1", "h2", "td", "pre", "blockquote")]
    assert min(plain) > 0 and w.word + w.link[False] + w.mark[""] > 0
    assert max(w.block.values()) + w.word + w.link[False] + max(w.mark["name"], w.mark["class"]) < 1
    assert max(w.tag.values()) <= 0


def test_marks_of_wrappers_are_void():
    for name in ("with-sidebar", "has-nav layout", "no-comments", "sidebar-right page", "post header", "content notice"):
        page = f"<body><nav><a href=/>x</a></nav><div class='{name}'><h1>Title</h1><p>{'word ' * 30}</p></div><footer>foot</footer>"
        assert main_text.extract(page).startswith("Title\nword") and "foot" not in main_text.extract(page)
    assert main_text.extract("<article><div class='post-header'><h1>Title</h1></div><p>some text here</p></article>") == "Title\nsome text here"
    assert main_text.extract(f"<nav><a href=/>x</a><h1>Title</h1><p>{'word ' * 30}</p>").startswith("Title\nword")
    assert main_text.extract(f"<article><h1>T</h1><p>{'a ' * 30}</p><div class='ad'>{'buy ' * 9}</div><p>{'b ' * 30}</p></article>").count("buy") == 0


def test_broken_pages_take_linear_time():
    for part in ("<a ", "<b>", "</i>", "<a '>\"", "<script>", "<!-- ", "<div class=ad>x", "<p>a</b>", "&amp;<"):
        began = time.time()
        main_text.extract(part * (400_000 // len(part)))
        assert time.time() - began < 10


def test_empty_table_and_repeated_rows(spark):
    schema = "page_id long, url string, html string, text int, n_chars int, kind int"
    assert main_text.main_text(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", 1, 2, 3)] * 3, schema)
    assert [tuple(r) for r in main_text.main_text(rows).collect()] == [(1, "u", "a", 1)] * 3


def test_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a b c</p>", 9), (None, None, None, 9)], "page_id long, url string, html string, text int")
    assert sorted(main_text.main_text(rows).collect(), key=str) == [(1, "u", "a b c", 5), (None, None, "", 0)]


LINKS = "".join(f"<li><a href='/{k}'>Source number {k}</a></li>" for k in range(12))
BODY = "".join(f"<p>{w} words of the text that goes on for a while and says {w} again.</p>" for w in ("first", "second", "third"))
WRITTEN = "".join(f"<p>I think so too, reader {k}, and I write a lot about it, more than the text itself has.</p>" for k in range(9))


def test_an_article_keeps_its_title_and_its_links():
    first = main_text.extract(f"<nav><a href=/>x</a></nav><article><h1>The title</h1><ul>{LINKS}</ul>{BODY}</article><footer>foot</footer>")
    last = main_text.extract(f"<body><div><a href=/>Home</a></div><main><h1>The title</h1>{BODY}<h2>Sources</h2><ol>{LINKS}</ol></main><footer>foot</footer>")
    for text in (first, last):
        assert text.startswith("The title\n") and all(f"Source number {k}" in text for k in range(12)) and "third again." in text and "foot" not in text and "Home" not in text


def test_what_readers_write_goes():
    for heading in ("Comments", "12 Comments", "Reader comments (3)", "Kommentare", "3 Commentaires:", "Comentarios", "Replies"):
        for page in ("<article><h1>The title</h1>{0}</article><section id='c'><h3>{1}</h3>{2}</section>", "<div><h1>The title</h1>{0}</div><div><h2>{1}</h2>{2}</div>", "<main><h1>The title</h1>{0}<section><h4>{1}</h4>{2}</section></main>"):
            assert main_text.extract(page.format(BODY, heading, WRITTEN)) == main_text.extract(f"<h1>The title</h1>{BODY}"), (heading, page)
    assert "reader" not in main_text.extract(f"<article><h1>The title</h1>{BODY}</article><section>{WRITTEN}</section>")  # outside of what has the title
    kept = main_text.extract(f"<article><h1>The title</h1>{BODY}<h2>Comments on the plan</h2><p>These are part of it.</p></article>")
    assert kept.endswith("Comments on the plan\nThese are part of it.")
