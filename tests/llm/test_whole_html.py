"""Articles with links among their paragraphs."""

from pathloom.llm import html_text

LINK = "<p><a href=x>Read the full story</a></p>"


def test_a_link_does_not_take_the_article():
    short = "This is a paragraph of the article and it has the words that are in a text of its kind, but it ends before the rule takes it."
    page = lambda texts: f"<body><div>Home and more</div><article><h1>Heading</h1>{texts}</article></body>"
    assert html_text.main_text(page(f"<p>{short}</p>{LINK}<p>{short}</p>")) == f"Heading\n\n{short}\n\n{short}"
    polish = "Wczoraj wieczorem mieszkańcy miasta zebrali się przed ratuszem, aby wysłuchać przemówienia burmistrza. " * 3
    assert html_text.main_text(page(f"<p>{polish}</p>{LINK}")) == f"Heading\n\n{polish.strip()}"
    long = "This is the text of a page and it is as long as it has to be for the rule. " * 4
    assert html_text.main_text(page(f"<p>{long}</p><p>{short}</p><p>{short}</p>{LINK}")).count(short) == 2
