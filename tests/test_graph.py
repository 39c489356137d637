"""PageRank by products with bags and with kept whole numbers against the dense form, and groups that batches cut."""

import numpy as np
import pyarrow as pa
import pytest

from penstock.operators import graph as G


def some_bags(seed, n):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 30, n)
    words = np.where(rng.random(sizes.sum()) < 0.5, rng.zipf(1.3, sizes.sum()) % 50, rng.integers(50, 5000, sizes.sum()))
    return G.bags_of(words, sizes)


@pytest.mark.parametrize("n", [1, 2, 7, 700])
def test_all_forms_give_the_same_ranks(n):
    bags = some_bags(n, n)
    sim = G.cosines(bags)
    assert np.allclose(G.sparse_pagerank(bags), G.pagerank(sim), rtol=1e-9, atol=0)
    for least in (0.1, 0.3):
        assert np.allclose(G.threshold_pagerank(bags, least, 64), G.pagerank(np.where(sim >= least, sim, 0.0)), rtol=1e-9, atol=0)


def test_a_cosine_at_the_threshold_counts():
    """Ten words each, one shared: exactly 0.1, which products of rounded square roots may miss."""
    bags = G.bags_of(np.array([*range(10), *range(9, 19)]), np.array([10, 10]))
    assert G.cosines(bags)[0, 1] == 0.1


def test_a_word_thrice_in_a_sentence_of_many_words():
    words = np.array([0] * 300 + [1] + [0] * 300 + [2] + [3])
    bags = G.bags_of(words, np.array([301, 301, 1]))
    assert np.allclose(G.threshold_pagerank(bags, 0.1), G.pagerank(G.cosines(bags)))


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_groups_are_whole(size):
    keys = [1, 1, 1, 2, 3, 3, None, None, 4]
    batches = [pa.record_batch([pa.array(keys[i : i + size], pa.int64()), pa.array(range(i, min(i + size, 9)))], ["k", "v"]) for i in range(0, 9, size)]
    groups, order = [], []
    for table in G.whole_groups(iter(batches), "k"):
        bounds = G.group_bounds(table["k"].to_pandas().to_numpy())
        order += table["v"].to_pylist()
        groups += [table["k"].to_pylist()[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    assert order == list(range(9)) and groups == [[1, 1, 1], [2], [3, 3], [None, None], [4]]
