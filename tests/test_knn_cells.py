import numpy as np

from recspark.operators import knn


def test_a_cell_keeps_the_best_of_all_its_tiles(monkeypatch):
    monkeypatch.setattr(knn, "TILE_ITEMS", 16)
    monkeypatch.setattr(knn, "TILE_QUERIES", 8)
    monkeypatch.setattr(knn, "PAIRS", 50)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 6))
    m[40:120] = m[3]  # more copies than any query wants
    m[200:210] = 0.0
    m[250] = m[3] * (1 + 1e-7)
    q = np.concatenate([rng.normal(size=(20, 6)), m[3:4], np.zeros((1, 6))])
    q, m = knn._unit(q), knn._unit(m)
    wanted = np.array([1 + n % 40 for n in range(len(q))])
    row, col, score = knn.best_pairs(q, m, wanted)
    for i, k in enumerate(wanted):
        exact = np.round((m * q[i]).sum(axis=1), 12)
        want = np.lexsort((np.arange(len(m)), -exact))[:k]
        assert col[row == i].tolist() == want.tolist()
        assert np.allclose(score[row == i], exact[want], atol=1e-12)


def test_copies_beyond_the_wanted_ones_leave():
    m = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, -0.0], [0.0, 1.0], [1.0, 0.0]])
    assert knn._lowest_of_copies(m, 2).tolist() == [0, 1, 2, 4]
