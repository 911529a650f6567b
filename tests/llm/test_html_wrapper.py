import pytest

from marketframe.llm import html_wrapper as H


def page(k, body, extra="", tail="</body></html>"):
    return (f'<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style><script>var x="</p>";</script></head><body>'
            f'<nav><ul><li><a href="/a">A{k}</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> -->'
            f'<div class="ad">Buy {k}</div>{extra}<article><h1>Head {k}</h1>{body}</article>'
            f'<div id="comments"><p>reader {k}</p></div><footer>&copy; foot</footer>{tail}')


PAGES = [
    (1, "http://x.test/1", page(1, "<p>One &amp; two<p><b>Three<br>four</b></p>"), "Head 1\n\nOne & two\n\nThree four"),
    (2, "http://x.test/2", page(2, "<p>Only</p>", '<div class="cookie-notice">ok</div>'), "Head 2\n\nOnly"),
    (3, "http://X.test/3", page(3, "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", tail=""),
     "Head 3\n\na\n\nb\n\nc\n\nd"),
    (4, "http://x.test/4", page(4, "<form><p>sign up</p></form><p> sp \n\t ace&nbsp;d </p>"), "Head 4\n\nsp ace d"),
    (5, "http://y.test/1", "<body><div class=menu><a href=/>home</a></div><div class=post><p>Long main text here</p>"
     "<p>and more of it</p></div><div class=sidebar>side</div>", "Long main text here\n\nand more of it"),
    (6, None, None, ""), (7, "", "", ""), (8, "nonsense", "plain text", "plain text"),
    (9, "http://z.test/", "<nav>only menu</nav><script>x</script>", ""),
    (10, "http://w.test/", "<article><p>cut off in a <b", "cut off in a"),
    (2, "http://x.test/2", page(2, "<p>Only</p>"), "Head 2\n\nOnly"),
    (11, "http://long.test/", "<article>" + "<p>word</p>" * 20000 + "</article>", "\n\n".join(["word"] * 20000)),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h, _ in PAGES],
                                  "page_id long, url string, html string, host string, region string")
    out = H.extract(pages)
    got = sorted((r["page_id"], r["text"], r["n_chars"], r["host"], r["region"]) for r in out.collect())
    assert got == sorted((i, t, len(t), "x", "y") for i, _, _, t in PAGES)
    assert H.extract(pages.limit(0)).count() == 0


MAIN = "<article><h1>Head</h1><p>The main text of this page</p></article>"
READ = "Head\n\nThe main text of this page"
DIVS = "<div class=post><p>The main text of this page</p></div>"


@pytest.mark.parametrize("html, text", [
    (f'<body><svg class="i"/>{MAIN}', READ), (f"<button>Menu{MAIN}", READ),
    (f"<button-group>{MAIN}</button-group>", READ), (f"<object data=x>{MAIN}<p>after", READ),
    (f"<button>a{MAIN}<button>b</button>", READ), (f"<select><option>x{MAIN}", READ),
    (f"<svg><svg><text>no</text></svg><text>no</text></svg>{MAIN}", READ),
    (f"<noscript><p>no</p></noscript><video>{MAIN}</video>", READ),
    (f'<div class="has-sidebar">{MAIN}</div>', READ), (f'<div class="layout sidebar">{MAIN}</div>', READ),
    (f"<form action=/>{MAIN}<div class=sidebar>side</div></form>", READ),
    (f'<form><div>{DIVS}<div class="sidebar">side</div></div></form>', "The main text of this page"),
    (f'<div class="page header">{DIVS}<nav>no</nav></div>', "The main text of this page"),
    (f'<div class="no-header">{DIVS}</div>', "The main text of this page"),
    (f"{MAIN}<script>var a = '", READ), (f"{MAIN}<textarea>open <p>no</p>", READ),
    # still left out
    (f"{MAIN}<div class=comments><article><p>{'a reader says more ' * 9}</p></article></div>", READ),
    (f"{DIVS}<div id=comments><div><p>{'a reader says more ' * 9}</p></div></div>", "The main text of this page"),
    (f"{MAIN}<div class=related><article><p>{'other text ' * 20}</p></article></div>", READ),
    ('<div class="cookie-notice"><p>ok</p></div>', ""), (f"<article>{DIVS}<button>Buy</button><svg><g/></svg></article>",
                                                         "The main text of this page"),
])
def test_open_elements_and_outer_names(html, text):
    b = H.Blocks(html)
    assert b.text(H.best_region(b.regions())) == text


def test_wrappers_generalise(spark):
    pages = spark.createDataFrame([("x", h) for i, u, h, _ in PAGES if u and u.lower().startswith("http://x.")],
                                  "host string, html string")
    (w,) = H.wrappers(pages).collect()
    text = w["wrapper"].replace("\n", " ")
    assert "(<li # /li)+" in text and "(<p # /p)+" in text and "(<div.cookie-notice # /div.cookie-notice)?" in text
    assert w["region"].endswith("article")


def test_fold_and_align():
    unit = ["<p", "#", "/p"]
    assert H.fold(unit * 3) == ["(<p # /p)+"]
    assert H.align(unit, ["(<p # /p)+"]) == ["(<p # /p)+"]
    assert H.align(["<a", "/a"], ["<a", "<b", "/b", "/a"]) == ["<a", "(<b /b)?", "/a"]


def test_wrapper_reads_pages_without_article(spark):
    """All slots are read, a lead in a container of its own too; texts that most
    pages of the host share are template, whatever their containers are called."""
    def plain(k, more=""):
        return (f"<body><div class=x1><p>Welcome to our site</p><p>Established long ago</p></div><div class=lead><p>Lead {k}</p></div>"
                f"<div class=body><p>Body {k} of the text</p><p>and its end {k}</p>{more}</div>"
                f"<div class=links><p><a href=/a>See also {k}</a></p></div><div class=x2>All rights kept by us</div>")
    rows = [(k, "http://one.test/", plain(k, "<p>Only here</p>" if k == 3 else "")) for k in range(1, 8)]
    rows += [(100, "http://two.test/", plain(100)), (8, "http://one.test/", "<article><p>With article</p></article>")]
    rows += [(200 + j, "http://copies.test/", plain(j // 6)) for j in range(7)]  # a page six times, another once
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for k in range(1, 8):
        want = [f"Lead {k}", f"Body {k} of the text", f"and its end {k}"] + ["Only here"] * (k == 3)
        assert got[k] == "\n\n".join(want)
    assert got[8] == "With article"
    assert got[100].startswith("Welcome to our site\n\nEstablished") and "Lead 100" in got[100]  # one page shows no template
    assert "Body 0 of the text" in got[200] and "Body 1 of the text" in got[206]
    (w,) = [r for r in H.wrappers(pages.selectExpr("'h' AS host", "html").where("html LIKE '%Lead%'")).collect()]
    assert len(w["constants"]) == 3 and "#" in w["wrapper"]


def test_outlines_are_merged_in_a_tree(spark, monkeypatch):
    """The host's wrapper accepts all outlines, in groups of any size."""
    pages = spark.createDataFrame([("h", f"<article>{'<p>a</p>' if k % 2 else ''}<h2>b</h2>{'<ul><li>c</ul>' * (k % 5)}"
                                    f"<div class=k{'abcdefghij'[k % 10]}>d</div></article>") for k in range(40)],
                                  "host string, html string")
    for fan in (3, 64):
        monkeypatch.setattr(H, "FAN", fan)
        (w,) = H.wrappers(pages).collect()
        assert w["region"] == "article" and "<h2\n#\n/h2" in w["wrapper"]
        for c in "abcdefghij":
            assert f"<div.k{c}" in w["wrapper"]
