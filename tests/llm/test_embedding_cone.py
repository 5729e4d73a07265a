import numpy as np

from rolefit.llm.embedding_dedup import embedding_links


def test_a_tight_group_is_compared_whole(spark):
    r = np.random.default_rng(2)
    centre = r.normal(size=16)
    rows = [(k, (centre + 0.2 * r.normal(size=16)).astype(np.float32).tolist()) for k in range(100)]
    two = [(900, [1.0, 0.0, 0.0]), (901, [1.0, 0.01, 0.0])]
    got = {x.vec_id: x for x in embedding_links(spark.createDataFrame(rows + two, "vec_id long, embedding array<float>"), block_rows=16).collect()}
    m = np.array([v for _, v in rows]).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert (m @ m[0]).min() > 0.8
    near = (m @ m.T >= 0.95) & ~np.eye(len(m), dtype=bool)
    assert 0 < near.sum() < 9900 and [got[k].n_links for k in range(100)] == near.sum(axis=1).tolist()
    assert (got[900].n_links, got[901].n_links, got[901].component_id, got[901].kept) == (1, 1, 900, False)
