import random

import numpy as np

import tessera.llm.induced as induced


def test_suffix_order(monkeypatch):
    rng = random.Random(1)
    for block in (3, 1 << 18):
        monkeypatch.setattr(induced, "BLOCK", block)
        for case in range(250):
            n = rng.randint(0, 60)
            kind = case % 4
            if kind == 0:
                t = [rng.randrange(3) for _ in range(n)]
            elif kind == 1:
                t = [1] * n
            elif kind == 2:
                t = ([0, 1, 2] * n)[:n]
            else:
                p = [rng.randrange(5) for _ in range(rng.randint(1, 9))]
                t = (p * n)[:n] + [rng.randrange(5)]
            rank = induced.suffix_classes(np.array(t, np.int32), memory=rng.choice([8, 1 << 20]))
            order = sorted(range(len(t)), key=lambda i: t[i:])
            assert rank[order].tolist() == list(range(len(t))), t


def test_repeated_windows():
    rng = random.Random(2)
    for _ in range(60):
        t = np.array([rng.randrange(2) for _ in range(rng.randint(1, 80))], np.int32)
        length = rng.randint(1, 6)
        valid = np.arange(len(t)) + length <= len(t)
        valid &= np.array([rng.random() < 0.8 for _ in t])
        text = t.tolist()
        windows = {i: tuple(text[i : i + length]) for i in np.flatnonzero(valid)}
        want = [i in windows and sum(w == windows[i] for w in windows.values()) > 1 for i in range(len(t))]
        assert induced.repeated_windows(t, valid, length).tolist() == want
