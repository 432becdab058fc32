"""Main text of pages, against pages written by hand."""

import pytest

from larder.llm import extract

PROSE = [
    "The harbour was quiet in the morning, and the boats that had come in with the tide lay still under a thin layer of mist which would not lift before noon.",
    "It is not known who built the wall on the north side of the town, but the stones are the same as those of the old church and its tower.",
    "When the rain came they went into the house and waited for it to end, as there was nothing else to do with the rest of the day.",
]
TITLE = "A quiet morning"
WHOLE = "\n".join([TITLE, *PROSE])
BODY = f"<h1>{TITLE}</h1>" + "".join(f"<p>{p}</p>" for p in PROSE)
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li><li><a href="/c">Sport</a></li></ul>'
TALK = "I was there in the spring and it is all true, the mist does not lift and the boats are still there in the evening as well."

PAGES = {
    "plain": (f"<html><body>{BODY}</body></html>", WHOLE),
    "unmarked menu": (f"<body>{MENU}<div>{BODY}</div><div>{MENU}</div></body>", WHOLE),
    "marked parts": (
        f"<body><header><h2>The Daily Paper</h2><p>{PROSE[1]}</p></header><nav>{MENU}</nav><article>{BODY}</article><aside><p>{PROSE[2]}</p></aside><footer><p>{PROSE[0]}</p></footer></body>", WHOLE,
    ),
    "names": (
        f'<body><div id="header"><p>{PROSE[0]}</p></div><div class="page-content">{BODY}</div><div class="side-bar"><p>{PROSE[1]}</p></div><div id="cookieNotice"><p>{PROSE[2]}</p></div>'
        f'<div class="comments"><p>{TALK}</p></div><div class="ad-slot"><p>{PROSE[1]}</p></div></body>', WHOLE,
    ),
    "advert in the article": (f'<article><h1>{TITLE}</h1><p>{PROSE[0]}</p><div class="ad">Buy the best of all boats now and pay for it in the spring of the next year.</div><p>{PROSE[1]}</p><p>{PROSE[2]}</p></article>', WHOLE),
    "comments by their title": (f"<main>{BODY}<h2>3 Comments</h2><p>{TALK}</p><p>{TALK}</p></main>", WHOLE),
    "comments as articles": (f'<main><article>{BODY}</article><section id="comments"><article class="comment"><p>{TALK}</p></article></section></main>', WHOLE),
    "form": (f'<body>{BODY}<form><p>{PROSE[0]}</p><input name="q"><textarea>{PROSE[1]}</textarea></form></body>', WHOLE),
    "page in a form": (f'<body><form id="main_form"><label>Search</label><article>{BODY}</article></form></body>', WHOLE),
    "raw text": (f'<head><title>x</title><style>p{{a:"</p>"}}</style></head><body><script>var t="</p><p>{PROSE[0]}</p>";</script>{BODY}<noscript><p>{PROSE[1]}</p></noscript><!-- <p>{PROSE[1]}</p> --></body>', WHOLE),
    "hidden": (f'<body>{BODY}<div hidden><p>{PROSE[0]}</p></div><div style="display: none"><p>{PROSE[1]}</p></div><div aria-hidden="true"><p>{PROSE[2]}</p></div></body>', WHOLE),
    "names that say what is beside": (f'<body class="has-sidebar no-ads"><div class="content-with-sidebar">{BODY}</div></body>', WHOLE),
    "short lines inherit": (f"<body>{MENU}<p>{PROSE[0]}</p><p>Be.</p><p>{PROSE[1]}</p></body>", "\n".join([PROSE[0], "Be.", PROSE[1]])),
    "inline markup": ("<article><p>The <b>old</b> wa<i>ll</i> of\n\t the&nbsp;town &amp; its &#8216;tower&#x2019; &lt;b&gt; caf&eacute; 1 < 2 &copy 3<br>and the rest of it is not known to us.</p></article>",
                      "The old wall of the town & its ‘tower’ <b> café 1 < 2 © 3 and the rest of it is not known to us."),
    "two breaks": (f"<article>{PROSE[0]}<br><br>{PROSE[1]}<br>{PROSE[2]}</article>", f"{PROSE[0]}\n{PROSE[1]} {PROSE[2]}"),
    "unclosed": (f"<article><h1>{TITLE}<p>{PROSE[0]}<p><b>{PROSE[1]}<p>{PROSE[2]}", WHOLE),
    "cut inside a tag": (f'<article>{BODY}<p class="x', WHOLE),
    "unclosed comment": (f"<article>{BODY}</article><!-- {PROSE[0]}", WHOLE),
    "quotes": (f"""<article title='a > b' data-x="<p>{PROSE[0]}</p>">{BODY}</article>""", WHOLE),
    "odd quotes": (f'<article><p title="x>{PROSE[0]}</p></article>', PROSE[0]),
    "upper case": (f"<BODY><NAV>{MENU}</NAV><ARTICLE>{BODY.upper().replace(TITLE.upper(), TITLE)}</ARTICLE></BODY>", "\n".join([TITLE, *[p.upper() for p in PROSE]])),
    "one word": ("<body><nav>x</nav><article><p>Be.</p></article><footer>&copy; y</footer></body>", "Be."),
    "another language": ("<body><p>" + "Утром в гавани было тихо, и лодки стояли под туманом, который не рассеялся до полудня. " * 3 + "</p></body>", ("Утром в гавани было тихо, и лодки стояли под туманом, который не рассеялся до полудня. " * 3).strip()),
    "nothing": ("<html><body><nav>" + MENU + "</nav></body></html>", ""),
    "only links": (f"<body>{MENU * 20}</body>", ""),
    "no tags": (PROSE[0], PROSE[0]),
    "empty": ("", ""),
    "null": (None, ""),
    "dropped wins over empty": ('<body><div class="ad">x</div><article></article></body>', ""),
    "empty article beside prose": (f"<body><article></article><div>{BODY}</div></body>", WHOLE),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    assert extract.main_text(html)[0] == want


def test_long_and_deep_pages():
    many = "".join(f"<p>{PROSE[i % 3]}</p>" for i in range(20_000))
    assert extract.main_text(f"<body>{many}</body>")[0].count("\n") == 19_999
    assert extract.main_text("<div>" * 20_000 + PROSE[0] + "</span></div>" * 20_000)[0] == PROSE[0]
    assert extract.main_text("<" * 50_000 + "a")[0] == ""


def test_query(spark):
    rows = [(i, f"http://x/{i}", html, "clash", "clash") for i, (html, _) in enumerate(PAGES.values())]
    rows += [rows[0], (None, None, PAGES["plain"][0], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _main string, _row string")
    want = {i: text for i, (_, text) in enumerate(PAGES.values())} | {None: WHOLE}
    got = extract.query(pages).collect()
    assert len(got) == len(rows)
    assert all((r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])) for r in got)
    assert extract.extract(pages).columns == ["page_id", "url", "html", "_row", "_main"]
    assert extract.query(pages.limit(0)).collect() == []
