import numpy as np

from rolefit.llm import html_text as T


def test_self_closed_tags_and_math():
    page = '<body><svg class="i" viewBox="0 0 1 1"/><article><p>One <math/>two</p><p>Let <math><mi>x</mi></math> be<svg a="/>"><text>no</text></svg> it</p></article><svg\n/><p>End</p></body>'
    assert [b.text for b in T.blocks(page)] == ["One two", "Let x be it", "End"]


def test_teaching_pages_are_whole():
    page = "<body>" + "".join(f"<p>line {k}</p>" for k in range(200)) + "<div class='comments'><p>late</p></div></body>"
    (own, labels), (mixed, _) = T.teaching_pages([page])
    assert len(own) == len(labels) == 201 and len(mixed) >= 201 and labels[-1] == 0


def test_parts_of_a_step_have_the_gradient_of_the_whole():
    r = np.random.default_rng(1)
    pages = [(r.normal(size=(n, T.INPUT)).astype(np.float32), r.integers(2, size=n)) for n in (3, 40, 7, 5)]

    def gradient(runs):
        total, sums = sum(len(p[0]) for p in pages), 0
        for part in runs:
            x, mask = T.padded([p[0] for p in part])
            y = np.zeros(mask.shape)
            for k, (_, labels) in enumerate(part):
                y[k, : len(labels)] = labels
            sums = sums + np.concatenate([g.ravel() for _, g in sorted(T.Labeller()._gradients(x, mask, y, total).items())])
        return sums

    runs = T._parts(pages, 40)
    assert len(runs) == 2 and sum(map(len, runs)) == 4
    assert np.allclose(gradient(runs), gradient([pages]), atol=1e-6)


def test_a_table_of_long_pages_is_not_read_by_random_weights(spark):
    body = "".join(f"<p>Sentence number {k} of the long article tells more about it than the last.</p>" for k in range(40))
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{body}</article><div class='comments'><p>Nice</p></div><footer>Imprint</footer></body></html>"
    got = T.main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), fit_chars=100).first()
    assert got.text.split("\n") == [b.text for b in T.blocks(page) if T.teaching_label(b)]
