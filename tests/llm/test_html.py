import random
import time

import numpy as np
import pytest
from cases import SMALL

from leaksieve.llm import html_blocks as hb
from leaksieve.llm.common import read


@pytest.fixture(scope="module")
def labeller(spark):
    return hb.fit_labeller(read(spark, SMALL, "pages"))


def text_of(labeller, page):
    return "\n\n".join(b.text for b, score in hb.labelled([page], labeller)[0] if score >= 0.5)


def test_blocks_of_broken_markup():
    page = "<!-- x --><p>a &lt;b&gt;<p>b<br>c<ul><li>d<li>e</ul>1 < 2 &amp; 3<script>var s='</p>';</script><div hidden>f<b>g</div> h &nbsp;&eacute;<style>p{}"
    assert [b.text for b in hb.blocks_of(page)] == ["a <b>", "b c", "d", "e", "1 < 2 & 3", "fg", "h é"]
    assert hb.blocks_of("<!-- open") == hb.blocks_of("<script>x") == hb.blocks_of("<p></p>") == []
    assert [b.linked for b in hb.blocks_of("<p><a href='x'>link</a></p><p>not</p>")] == [4, 0]


@pytest.mark.parametrize("piece", ["<p a='", "<p a=\"'", "<p ", "<p", "</p", "<!x", "<?", "<", "<div>x", "<b>x</i>", "<script>", "<!--", "<a b=>x"])
@pytest.mark.parametrize("tail", ["", "'>"])
def test_malformed_pages_take_time_in_proportion(piece, tail):
    """Two megabytes of tags that never end, or never close."""
    started = time.process_time()
    hb.blocks_of(piece * (2_000_000 // len(piece)) + tail)
    assert time.process_time() - started < 15


def test_tags_that_never_end_are_text():
    assert [b.text for b in hb.blocks_of("<p>a < b <i c='d>e</p>f<p>g")] == ["a < b <i c='d>e", "f", "g"]
    assert [b.text for b in hb.blocks_of("<p>a<!x<p>b <c")] == ["ab <c"]
    assert [b.text for b in hb.blocks_of("a <p x='<p>b")] == ["a <p x='", "b"]
    deep = "<div>x" * 2000 + "</div>" * 2000 + "<p>end</p>"
    blocks = hb.blocks_of(deep)
    assert len(blocks) == 2001 and max(len(b.path) for b in blocks) == hb.MAX_DEPTH and blocks[-1].text == "end"


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = hb.BlockLabeller()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, mask = rng.standard_normal((4, 3, hb.INPUT)), np.array([[1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    target, weight = (rng.random((4, 3)) > 0.5).astype(float), mask.astype(float)

    def loss():
        p = np.clip(net.scores(x, mask), 1e-9, 1 - 1e-9)
        return -float((weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() / weight.sum())

    slopes = net.gradients(x, mask, target, weight)
    for name in net.weights:
        place = tuple(rng.integers(n) for n in net.weights[name].shape)
        kept = net.weights[name][place]
        net.weights[name][place] = kept + 1e-3
        up = loss()
        net.weights[name][place] = kept - 1e-3
        down = loss()
        net.weights[name][place] = kept
        assert abs((up - down) / 2e-3 - slopes[name][place]) < 2e-3, name


def test_pages_give_their_article(spark, labeller):
    for row in read(spark, SMALL, "pages").collect():
        blocks = hb.blocks_of(row["html"])
        want = "\n\n".join(b.text for b in blocks if any("article" in names for names in b.path))
        assert text_of(labeller, row["html"]) == want


def test_pages_laid_out_in_other_ways(spark, labeller):
    rng = random.Random(77)
    wrong = total = 0
    for row in read(spark, "/root/testdata/sf0.01", "pages").limit(120).collect():
        marked = hb.relaid(hb.blocks_of(row["html"])[:60], rng)
        if marked:
            x, mask = hb.padded([hb.vectors([b for b, _ in marked])])
            scores = labeller.scores(x, mask)[:, 0]
            total += len(marked)
            wrong += sum((s >= 0.5) != (label == 1) for s, (_, label) in zip(scores, marked, strict=True))
    assert total > 1000
    assert wrong < 0.05 * total


def test_every_row_returns(spark):
    long = "<article>" + "<p>word and more words here.</p>" * 3000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav><a>x</a></nav>"), (3, "u", "plain"), (3, "u", "plain"), (4, "u", long)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = hb.extract_main_text(frame).collect()
    assert [f for f in got[0].asDict()] == ["page_id", "url", "text", "n_chars"]
    assert len(got) == len(rows)
    assert all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
    assert {r["n_chars"] for r in got if r["page_id"] in (1, 2)} == {0}
    assert hb.extract_main_text(frame.limit(0)).collect() == []


def test_without_lessons_stated_purpose_decides(spark):
    untaught = hb.fit_labeller(spark.createDataFrame([("plain",), (None,)], "html string"))
    assert text_of(untaught, "<nav><p>menu</p></nav><main><p>kept</p></main><footer>end</footer>") == "kept"
