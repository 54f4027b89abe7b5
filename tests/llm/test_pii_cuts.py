import numpy as np

from tessera.llm import pii


def test_cuts_reach_the_whole_range():
    x = np.stack([np.arange(1_000.0), np.zeros(1_000)], axis=1)
    y = ((x[:, 0] >= 340) & (x[:, 0] < 380)).astype(float)
    model = pii.fit_boosted(x, y, ("lead3", "luhn"))
    assert ((model.margin(x) > 0) == (y > 0)).all()


def test_fitted_trees_cut_high_prefixes():
    def cuts(tree):
        return [tree[:2], *cuts(tree[2]), *cuts(tree[3])] if isinstance(tree, tuple) else []

    at = pii.NUMBER_FEATURES.index("lead3")
    found = {cut for tree in pii.models()["card"].trees for i, cut in cuts(tree) if i == at}
    assert any(290 <= cut < 400 for cut in found)
