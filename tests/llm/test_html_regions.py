"""Block rules hold in every region; article elements and class names are evidence only."""

from fleetfacts.llm import html_text

PROSE = "This is the story of a town that was built on a hill and of the people who have lived in it for a very long time, "
LONG = PROSE + "and it is told by one of them with all that she had seen of the place."
LINKED = "It was <a href=/x>first told in the paper of the town</a> and"


def test_body_in_divs_next_to_article_cards():
    cards = "".join(f"<article><a href=/{i}>Card {i}</a></article>" for i in range(3))
    assert html_text.main_text(f"<body><div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div>{cards}</body>") == f"{LONG}\nShort one.\n{LONG}"


def test_linked_paragraph_between_prose_of_an_article_stays():
    want = f"{LONG}\nIt was first told in the paper of the town and\n{LONG}"
    assert html_text.main_text(f"<article><p>{LONG}</p><p>{LINKED}</p><p>{LONG}</p></article>") == want


def test_link_list_inside_an_article_is_dropped():
    links = " ".join(f"<a href=/{i}>Headline number {i} today</a>" for i in range(8))
    assert html_text.main_text(f"<article><p>{LONG}</p><div>{links}</div></article>") == LONG


def test_wrapper_names_are_whole_tokens_and_do_not_hide_an_article():
    for name in ("layout has-sidebar", "sidebar", "search", "no-comments"):
        assert html_text.main_text(f"<div class='{name}'><article><p>{LONG}</p></article></div>") == LONG
    page = f"<article><p>{LONG}</p></article><div class='comment-list'><article><p>{LONG}</p></article></div><div id=sidebar><p>{LONG}</p></div>"
    assert html_text.main_text(page) == LONG
