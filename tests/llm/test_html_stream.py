"""The array's tokens."""

from gradeflow.llm import html_text as H


def test_every_block_is_a_token():
    blocks = H.blocks_of("<nav>Home</nav><article><h1>Title</h1><p>One passage of the author's own words.</p><p><a href=x>Share</a></p></article>")
    assert H.ARTICLE in {b.region for b in blocks}
    tokens = H.stream_of(blocks)
    assert [t[0] for t in tokens] == list(range(len(blocks))) and [t[1] for t in tokens] == [b.words for b in blocks]


def test_shared_passages_of_an_article_stay():
    page = "<article><p>One passage that several pages share.</p><ul><li><a href=x>Read our newsletter every week</a></ul></article>"
    assert H.text_of(page, covered=[0, 1]) == "One passage that several pages share."
