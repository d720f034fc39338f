"""A region of main text that holds an article from its first block."""

from orrery.llm.html import Weights, main_text


def test_costly_tags_do_not_cut_an_article_open():
    page = "<body><div>menu one two</div><article><h1>five word title here now</h1><div><p>{}</p></div></article></body>".format(
        " ".join(f"w{i}" for i in range(60))
    )
    text = main_text(page, Weights(tags={"div": 5.6, "li": 6.0, "a": 6.0, "h1": 0.0, "p": 0.0}))
    assert text.startswith("five word title here now") and text.endswith("w59") and "menu" not in text
    page = "<article><h1>one</h1><ul><li>{}</li></ul></article>".format(" ".join(f"w{i}" for i in range(30)))
    assert main_text(page, Weights(tags={"ul": 6.0, "li": 6.0})).startswith("one")
