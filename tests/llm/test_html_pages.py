"""Main texts of random pages whose article is known, and pages on which names misled an earlier version."""

import random

import pytest

from docloom.llm import html_text

WORDS = "river stone house walks over green hill with some late light under old trees and the small boats drift slowly home".split()
#: Names that hold parts of boilerplate names, yet name topics.
TOPICS = ["navy-history", "advertising-law", "sponsored-research", "modal-verbs", "cookie-recipes", "menu-planning-tips", "comment-culture", "headers-explained", "adsorption", "newsletter-design-history"]


def paragraph(r, least=60):
    out = []
    while len(" ".join(out)) < least:
        out += [*(r.choice(WORDS) for _ in range(r.randint(6, 14)))]
        out[-1] += r.choice([",", ",", "."])
    return " ".join(out).capitalize() + "."


def shell(r):
    """Boilerplate before and after the article."""
    link = lambda: f"<a href='/{r.random()}'>{r.choice(WORDS)} {r.choice(WORDS)}</a>"
    links = lambda: "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 9)))
    before = [f"<nav><ul>{links()}</ul></nav>", f"<div class='site-header'>{link()}</div>", f"<div id='top-banner'><p>{paragraph(r)}</p></div>", f"<div class='cookie-notice'><p>{paragraph(r)}</p></div>", f"<ul class='breadcrumbs'>{links()}</ul>"]
    after = [f"<div class='sidebar'><p>{paragraph(r)}</p>{links()}</div>", f"<aside><p>{paragraph(r)}</p></aside>", f"<div class='comments'><p>{paragraph(r)}</p><p>{paragraph(r)}</p></div>", f"<footer><p>{paragraph(r)}</p></footer>", "<form><input name='q'><button>Go now</button> Subscribe to our letter</form>", f"<div class='advert'>{paragraph(r)}</div>", f"<script>{paragraph(r)}</script>"]
    return "".join(x for x in before if r.random() < 0.7), "".join(x for x in after if r.random() < 0.7)


def page(seed):
    r = random.Random(seed)
    blocks, inner = [], ""
    for _ in range(r.randint(4, 9)):
        if r.random() < 0.3:
            text = f"{r.choice(WORDS).capitalize()} and {r.choice(WORDS)} {len(blocks)}"
            inner += f"<h2 class='{r.choice(['section-header', 'header', 'title', r.choice(TOPICS)])}'>{text}</h2>"
            blocks.append(text)
        text = paragraph(r, 120)
        marked = text.replace("river", "<em>river</em>").replace(" hill", "\n  hill")
        kind = r.random()
        name = f" {r.choice(['class', 'id'])}='{r.choice(TOPICS)}'" if r.random() < 0.5 else ""
        inner += f"<p{name}>{marked}</p>" if kind < 0.7 else f"<div{name}><p>{marked}</p></div>" if kind < 0.85 else f"<section{name}><p>{marked}</p></section>"
        blocks.append(text)
    before, after = shell(r)
    body = f"{before}<article>{inner}</article>{after}"
    if r.random() < 0.3:
        body = f"<form id='aspnetForm' action='/'>{body}</form>"
    return f"<html><head><title>x y z</title></head><body>{body}</body></html>", blocks


@pytest.mark.parametrize("seed", range(0, 300, 50))
def test_random_pages_give_their_article(seed):
    for k in range(seed, seed + 50):
        html, blocks = page(k)
        assert html_text.extract_blocks(html) == blocks, f"page {k}"


A = "One long sentence of the article, with commas, and so on. " * 3
P, T = f"<p>{A}</p>", A.strip()


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<article><h2 class='section-header'>Head</h2>{P}<h2 class='header'>Two</h2>{P}</article>", ["Head", T, "Two", T]),
        (f"<article>{P}<section id='navy-history'>{P}</section><div id='advertising-law'>{P}</div><div class='sponsored-research'>{P}</div></article>", [T] * 4),
        (f"<article>{P}<p class='modal-verbs'>Verbs</p></article>", [T, "Verbs"]),
        (f"<body><form>{P}{P}<div class='footer'>foot</div></form></body>", [T, T]),
        (f"<body><article>{P}</article><form>Your name <input> Leave a reply, please, here and now</form></body>", [T]),
        (f"<body><div><section>{P}{P}{P}</section><div>{P}{P}</div></div></body>", [T] * 5),
        (f"<body><div><section>{P}{P}{P}</section><div><a href='x'>{A}</a>{P}</div></div></body>", [T] * 3),
        (f"<body><div class='ads'>{P}</div><div class='main-nav'>{P}</div><div class='modal'>{P}</div><div>{P}{P}</div></body>", [T, T]),
    ],
)
def test_names_and_forms(html, want):
    assert html_text.extract_blocks(html) == want


def test_tables_without_pages_and_clashing_names(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, id string, text string, n_chars int")
    assert html_text.main_texts(df).collect() == []
    df = spark.createDataFrame([(1, "u", P * 30_000, "a", "b", 3)] * 2, df.schema)
    assert [(r.page_id, r.n_chars) for r in html_text.main_texts(df).collect()] == [(1, 30_000 * (len(T) + 2) - 2)] * 2
