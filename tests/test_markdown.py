"""Markdown blocks, tiny blocks, size bounds, links."""

from spindrel.operators import markdown as M


def blocks(text, **options):
    return [(s["type"], s["text"]) for s in M.segments(text, **options)]


def test_every_kind_of_block():
    text = "# Top\n\nOne *two*\nthree.\n\n1. a\n2. b **c**\n   - inner\n\n> said\n> twice\n\n| x | y |\n|---|:-:|\n| 1 | a\\|b |\n\n```js\nlet a = 1;\n\nlet b;\n```\n\n<div>\nraw\n</div>\n\n---\n\n    indented\n\nSetext\n======\nend"
    assert blocks(text) == [
        ("heading", "# Top"), ("paragraph", "One *two*\nthree."), ("list", "1. a\n2. b **c** inner"), ("quote", "> said\n> twice"), ("table", "x | y\n--- | ---\n1 | a|b"),
        ("code", "```\nlet a = 1;\nlet b;\n```"), ("html", "<div>\nraw\n</div>"), ("code", "```\nindented\n```"), ("heading", "# Setext"), ("paragraph", "end"),
    ]


def test_header_paths_and_depths():
    parts = M.segments("## A\n\n# B\n\n### C\n\n##### Deep\n\nx\n\n######\n\n#\n\n")
    assert [p["header_path"] for p in parts] == [["## A"], ["# B"], ["# B", "### C"], ["# B", "### C", "**Deep**\n"], ["# B", "### C", "**Deep**\n"], ["# B", "### C", "**Deep**\n", "** **"], ["# "]]
    assert parts[3]["text"] == "**Deep**"


def test_inline_markup():
    assert M.inline("see [the *page*](http://a/b_(c)) ![alt](x.png)`a_b_c`") == "see the *page* `a_b_c`"
    assert M.inline("__bold__ and _em_ and snake_case_name") == "**bold** and *em* and snake_case_name"
    assert M.inline(r"\_not em\_ \[no\](link) \`tick\`") == "_not em_ [no](link) `tick`"
    assert M.inline("<https://x.example/y>") == "https://x.example/y"


def test_empty_headings_recover_the_next_paragraph():
    assert blocks("#\n\nLost title\n\nbody", recover=True) == [("heading", "# Lost title"), ("paragraph", "body")]
    assert blocks("#####\nLost\n\n- item", recover=True) == [("heading", "**Lost**"), ("list", "- item")]
    assert blocks("#\n\n- item", recover=True) == [("heading", "# "), ("list", "- item")]
    assert blocks("#\n\nLost title") == [("heading", "# "), ("paragraph", "Lost title")]


def part(kind, text, path=("# A",)):
    return {"type": kind, "text": text, "header_path": list(path)}


def test_tiny_blocks_join_the_one_before():
    parts = [part("heading", "# A"), part("paragraph", "x" * 40), part("paragraph", "tiny"), part("list", "- t"), part("paragraph", "b", ("# B",)), part("paragraph", "  ")]
    assert [p["text"] for p in M.merge_tiny(parts, 30)] == ["# A", "x" * 40 + "\ntiny\n- t", "b"]


def chunks(*rows):
    return [{"text": t, "header_path": list(p)} for t, p in rows]


def test_size_bounds():
    of = lambda rows, least=10, most=100: [c["text"] for c in M.bound_sizes(chunks(*rows), least, most)]
    assert of([("x" * 250, ["a"])]) == ["x" * 100, "x" * 100, "x" * 50]
    assert of([("# h", ["a"]), ("y" * 20, ["b"])]) == ["# h\n\n" + "y" * 20]  # a heading goes forward, whatever the path
    assert of([("y" * 20, ["a"]), ("short", ["a"])]) == ["y" * 20 + "\n\nshort"]
    assert of([("short", ["a"]), ("y" * 20, ["a"])]) == ["short\n\n" + "y" * 20]
    assert of([("short", ["a"]), ("y" * 20, ["b"])]) == ["short", "y" * 20]
    assert of([("x" * 150, ["a"]), ("# last", ["a"])]) == ["x" * 100, "x" * 50 + "\n\n# last"]


def test_headings_only_chunks():
    text = "intro words that stand alone\n\n# One\n\n" + "a" * 40 + "\n\n## Two\n\n" + "b" * 40
    assert [c["text"] for c in M.split_markdown(text, 10, 2000, True)] == ["intro words that stand alone", "# One\n\n" + "a" * 40, "## Two\n\n" + "b" * 40]
    assert M.split_markdown("") == [] and M.split_markdown(" \n\n ") == []


def test_long_and_odd_markdown_is_read(spark):
    odd = [(1, None), (2, ""), (3, "#" * 5000), (4, "- a\n" * 5000), (5, "> " * 2000 + "deep"), (6, "| a |\n" * 3000), (None, "```\nopen")]
    got = M.markdown_segments(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {3, 4, 5, 6, None} and [r.text for r in got if r.doc_id is None] == ["```\nopen\n```"]


def test_articles_take_pictures_and_first_titles(spark):
    text = "[![Image 3: A cover](http://s/1.png)](http://s/a) [](http://s/a) [First](http://s/b) [Second](http://s/b) ![no](http://s/x.png) [Skip this](http://s/c)"
    rows = M.articles(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["Skip"]).collect()
    assert sorted((r.url, r.title, r.image) for r in rows) == [("http://s/a", "A cover", "http://s/1.png"), ("http://s/b", "First", "http://s/1.png")]
