import numpy as np
import pytest

from sievelake.llm import induced


def brute(text):
    t = list(map(int, text))
    return sorted(range(len(t)), key=lambda i: t[i:])


def shared(text, a, b, bound):
    n = 0
    while n < bound and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(120))
def test_order_and_common_prefixes_equal_brute_force(tmp_path, seed):
    rng = np.random.default_rng(seed)
    n, sigma = int(rng.integers(0, 400)), int(rng.choice([1, 2, 3, 10, 200]))
    text = rng.integers(0, sigma, n)
    if seed % 3 == 0 and n > 20:
        text = np.r_[text, text[5:], text[: n // 2]]
    if seed % 7 == 0:
        text = np.r_[text, np.full(150, sigma - 1), text]
    scratch, bound = induced.Scratch(str(tmp_path), "s"), int(rng.choice([1, 5, 50, 300]))
    parts = list(induced.suffix_blocks(text, scratch, bound=bound, block_items=int(rng.choice([1, 7, 50, 1000])), held_items=int(rng.choice([5, 100])), in_memory=int(rng.choice([4, 40]))))[::-1]
    scratch.close()
    assert not any(tmp_path.iterdir())
    if not len(text):
        assert not parts
        return
    order, common = (np.concatenate(c).tolist() for c in zip(*parts))
    assert order == brute(text)
    assert common == [0, *(shared(text, a, b, bound) for a, b in zip(order, order[1:]))]


def test_common_runs():
    text = np.array([5, 1, 2, 3, 9, 1, 2, 3, 8, 1, 2, 0])
    order = np.array(brute(text))
    common = np.array([0, *(shared(text, a, b, 9) for a, b in zip(order, order[1:]))])
    group = dict(zip(order.tolist(), induced.common_runs(common, len(text) - order, 3).tolist()))
    assert group[1] == group[5] != group[9] and group[10] == -1


def test_queues_are_written_at_production_parameters(tmp_path, monkeypatch):
    runs, write = [], induced.Scratch.write
    monkeypatch.setattr(induced.Scratch, "write", lambda self, rows: runs.append(rows.nbytes) or write(self, rows))
    text = np.random.default_rng(1).zipf(1.3, 1_000_000) % 50_000
    text[700_000:] = text[:300_000]
    scratch = induced.Scratch(str(tmp_path), "s")
    parts = list(induced.suffix_blocks(text, scratch))[::-1]
    assert len(runs) > 8 and max(runs) < 40 << 20 and not any((tmp_path / "s").iterdir())
    scratch.close()
    order, common = (np.concatenate(c) for c in zip(*parts))
    assert np.array_equal(np.sort(order), np.arange(len(text)))
    # neighbours are in order, and their common prefixes are exact up to the bound
    x, y, here = order[:-1], order[1:], common[1:]
    for k in range(int(here.max())):
        deep = here > k
        assert np.array_equal(text[x[deep] + k], text[y[deep] + k])
    open_ = here < 50
    a, b = (np.r_[text, np.full(51, -1)][z[open_] + here[open_]] for z in (x, y))
    assert (a < b).all()
