from barline.llm.extraction import extract_text, main_text

WORDS = "A paragraph of the article with enough words in it to look like running prose, number "
ARTICLE = "".join(f"<p>{WORDS}{i}. And <a href='/x'>a link</a> &amp; more.</p>\n" for i in range(5))
EXPECTED = "\n".join(f"{WORDS}{i}. And a link & more." for i in range(5))
NAV = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Menu {i}</a></li>" for i in range(9)) + "</ul></nav>"
REST = (
    "<aside>Side words that nobody wants here, quite a lot of them.</aside><div class='cookie-notice'>We use cookies on this site.</div>"
    "<div class='ad'>Buy this thing now, it is a very good thing.</div><form><label>Name</label><input><p>Sign up today.</p></form>"
    "<section id='comments'><div class='comment'><p>I think this is wrong, said a reader at length.</p></div></section>"
    "<footer><p>Copyright of somebody, all rights reserved.</p></footer><script>var t='</p>';</script><style>p{}</style>"
)


def test_the_article_alone_is_left():
    for wrap in ("<article>{}</article>", "<div class='content'>{}</div>", "<div><div class='with-sidebar'>{}</div></div>", "{}"):
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body><header><h2>Site</h2></header>{NAV}{wrap.format('<h1>Title</h1>' + ARTICLE)}{REST}</body></html>"
        assert main_text(page) == "Title\n" + EXPECTED, wrap


def test_two_parts_of_one_article():
    page = f"<body>{NAV}<main><h1>Title</h1><div>{ARTICLE}</div><div class='ad'>Buy now.</div><div>{ARTICLE}</div></main>{REST}</body>"
    assert main_text(page) == f"Title\n{EXPECTED}\n{EXPECTED}"


def test_short_article_beside_a_longer_advert():
    assert main_text("<div class='ad'>A long advert with many more words than the article has.</div><article><h1>Hi.</h1><p><b>Hi.<br></article>") == "Hi.\nHi."


def test_references_space_cuts_and_nesting():
    assert main_text("<p>a&nbsp;&lt;b&gt;\n\t c<b>d</b>e &eacute;&#233; &copy</p>") == "a <b> cde éé ©"
    assert main_text("<p>first <!-- no > not this --> part<p>second</div></i> part<p>third &am") == "first part\nsecond part\nthird &am"
    assert main_text("<p>text</p><p class='x") == "text" and main_text("<p>text<script>var a = '<p>no';") == "text"
    assert main_text("<div>" * 30_000 + "deep words" + "</div>" * 5) == "deep words"
    assert main_text("<p>" + "long words " * 100_000) == ("long words " * 100_000).strip()
    assert main_text("<ul><li>one thing<li>another</ul>") == "one thing\nanother"


def test_rows_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<nav>x</nav>", "t"), (None, "u", "plain words", "t"), (3, "u", "<nav>x</nav>", "t")], "page_id bigint, url string, html string, text string")
    got = extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "u", "", 0), (2, None, "", 0), (3, "u", "", 0), (3, "u", "", 0), (None, "u", "plain words", 11)], key=str)
    assert extract_text(df.limit(0)).collect() == []


def test_words_like_hidden_hide_nothing_and_a_page_may_be_one_form():
    for marks in ("class='overflow-hidden'", "style='overflow:hidden'", "aria-hidden='false'", "title='hidden gems'", "data-x='display:none'"):
        for page in (f"<body {marks}>{NAV}<h1>Title</h1>{ARTICLE}</body>", f"<body>{NAV}<div {marks}><h1>Title</h1>{ARTICLE}</div></body>"):
            assert main_text(page) == "Title\n" + EXPECTED, page[:60]
    for page in (f"<body><form action='/'>{NAV}<div><h1>Title</h1>{ARTICLE}</div></form></body>", f"<body hidden>{NAV}<div><h1>Title</h1>{ARTICLE}</div></body>", f"<body style='color:red;display:none'>{NAV}<div><h1>Title</h1>{ARTICLE}</div></body>"):
        assert main_text(page) == "Title\n" + EXPECTED, page[:60]


def test_hidden_elements_are_left_out():
    for marks in ("hidden", "HIDDEN=''", "aria-hidden=true", "aria-hidden = 'true'", "style='color:red; display : none'"):
        assert main_text(f"<body>{NAV}<div><h1>Title</h1>{ARTICLE}</div><div {marks}>{ARTICLE}</div></body>") == "Title\n" + EXPECTED, marks


def test_captions_stay_and_many_open_headers_are_quick():
    import time

    body = "".join(f"<p>Sentence {i} of the article, long enough to count as text.</p>" for i in range(6))
    page = f"<html><body><nav><a href='/'>Home</a></nav><article>{body}<figure><figcaption>A view of the harbour.</figcaption></figure></article></body></html>"
    assert "A view of the harbour." in main_text(page).split("\n")
    start = time.perf_counter()
    main_text("<body>" + "<header>" * 20000 + body)
    main_text("<p " * 20000)
    assert time.perf_counter() - start < 10
