"""The labeller against a plain LSTM, on layouts it was not fitted on, and on long pages."""

from __future__ import annotations

import resource
import subprocess
import sys

import numpy as np
import pytest

from labmesh.llm import block_training, html_blocks
from labmesh.llm.html_blocks import STRETCH, blocks, features, label_pages, load_weights, main_texts

BLOCKS = [
    "On the rivers of the north",
    "The river rises in the hills and runs for many miles before it meets the sea.",
    "In spring it floods the fields, and people who live there move their cattle to higher ground.",
    "A ferry crossed it until the bridge was built; the ferryman's house still stands on the bank.",
    "Today the valley is known for its orchards, which the old mills once supplied with water.",
]
BODY = f"<h1>{BLOCKS[0]}</h1>" + "".join(f"<p>{b}</p>" for b in BLOCKS[1:])


def plain(page, weights):
    """Step by step, one block after the other, from the full features."""
    x = features(page).astype(np.float64)

    def run(rows, w, u):
        n = u.shape[0]
        h, c, out = np.zeros(n), np.zeros(n), []
        for row in rows:
            z = row @ w + h @ u
            i, f, o = (1 / (1 + np.exp(-z[k * n : (k + 1) * n])) for k in range(3))
            c = f * c + i * np.tanh(z[3 * n :])
            h = o * np.tanh(c)
            out.append(h)
        return out

    forth = run(x, weights["wf"], weights["uf"])
    back = run(x[::-1], weights["wb"], weights["ub"])[::-1]
    return [1 / (1 + np.exp(-(np.concatenate(s) @ weights["v"] + weights["b"][0]))) for s in zip(forth, back)]


def test_labels_equal_a_plain_lstm():
    weights = load_weights()
    grammar = block_training.Grammar(21)
    pages = [blocks(block_training.unmarked(grammar.page()[0])) for _ in range(12)]
    pages += [[], blocks(f"<article>{BODY * 260}</article>"), blocks(f"<div>{BODY}</div>")]
    assert max(map(len, pages)) > 2 * STRETCH
    for page, found in zip(pages, label_pages(pages, weights)):
        assert np.allclose(found, plain(page, weights), atol=2e-3)


@pytest.mark.parametrize(
    "opening, closing",
    [
        ("<div><div><div>", "</div></div></div>"),
        ("<div>", "</div>"),
        ('<div id="content"><div class="mw-parser-output">', "</div></div>"),
        ('<div class="post-body">', "</div>"),
        ('<div class="post hentry"><div class="post-body entry-content">', "</div></div>"),
        ('<div class="qzx-17">', "</div>"),
        ('<section id="thing"><div class="inner">', "</div></section>"),
        ("", ""),
    ],
)
def test_usual_layouts(opening, closing):
    weights = load_weights()
    menu = '<ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li><li><a href="/c">Contact</a></li></ul>'
    footer = '<div class="footer">Copyright 2024. All rights reserved.</div>'
    for before, after in (("", ""), (f"<nav>{menu}</nav>", footer), (f'<div class="menu">{menu}</div>', footer)):
        page = f"<html><body>{before}{opening}{BODY}{closing}{after}</body></html>"
        assert main_texts([page], weights)[0].split("\n") == BLOCKS


def test_table_layout():
    page = (
        "<html><body><table><tr><td><a href=/>Home</a> <a href=/a>About</a></td>"
        f"<td>{BODY}</td></tr><tr><td>Contact: webmaster</td></tr></table></body></html>"
    )
    assert main_texts([page], load_weights())[0].split("\n") == BLOCKS


def test_share_box_inside_a_story():
    story = BODY.replace("</h1>", '</h1><div class="share">Share this on Facebook Twitter</div>')
    for opening, closing in (("<article>", "</article>"), ('<div class="story">', "</div>")):
        page = f"<html><body><nav><a href=/>Home</a></nav>{opening}{story}{closing}<footer>Contact us</footer></body></html>"
        assert main_texts([page], load_weights())[0].split("\n") == BLOCKS


def test_whole_layouts_that_were_held_out():
    weights = load_weights()
    found = {layout: block_training.accuracy(weights, 60, 7, layout) for layout in block_training.UNSEEN}
    assert min(found.values()) > 0.9 and np.mean(list(found.values())) > 0.95, found


def test_a_long_page_holds_little_more_than_its_text():
    """100,000 blocks in a process of its own: far below what dense inputs would take."""
    code = (
        "import resource\n"
        "from labmesh.llm.html_blocks import load_weights, main_texts\n"
        "weights = load_weights()\n"
        "main_texts(['<article><p>a few words</p></article>'], weights)\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "page = '<article>' + '<p>a few words</p>' * 100_000 + '</article>'\n"
        "text = main_texts([page], weights)[0]\n"
        "print(len(text.split('\\n')), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    count, grown = map(int, done.stdout.split())
    assert count == 100_000 and grown < 150_000, grown
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss > 0
