import random

import numpy as np
import pytest

from leafmill.llm import _induced as I


def naive(text):
    b = bytes(text)
    order = sorted(range(len(b)), key=lambda i: b[i:])
    common = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k] or x[k] == 0), min(len(x), len(y)))
    return order, [0] + [min(255, common(b[i:], b[j:])) for i, j in zip(order, order[1:])]


def texts():
    r = random.Random(5)
    yield b"\0"
    yield b"a\0"
    yield b"\0\0\0"
    yield b"mississippi\0"
    yield b"a" * 400 + b"\0"
    yield b"ab" * 200 + b"\0"
    yield b"ba" * 200 + b"\0"
    yield b"abcab\0abcab\0abcabc\0"
    for k in range(40):
        n = r.randint(2, 300)
        yield bytes(r.choice(b"abc\0"[: r.randint(1, 4)]) for _ in range(n)) + b"\0"
    w = [bytes(r.choice(b"abcde ") for _ in range(r.randint(2, 300))) for _ in range(5)]
    for k in range(10):
        yield b"\0".join(r.choice(w) for _ in range(8)) + b"\0"


@pytest.mark.parametrize("limit", [3, 50, 100_000])
def test_suffix_order_and_common_prefixes(limit):
    for text in texts():
        pos, lcp = [], []
        I.Sorter(np.frombuffer(text + bytes(8), np.uint8), limit).run(lambda p, x: (pos.extend(p.tolist()), lcp.extend(x.tolist())))
        order, common = naive(text)
        assert pos[::-1] == order, text
        assert lcp[0] == 0 and lcp[1:][::-1] == common[1:], text


@pytest.mark.parametrize("limit", [3, 50, 100_000])
def test_order_to_a_depth(limit):
    """Suffixes that agree so far stand together, and common prefixes are right up to the depth."""
    for text in texts():
        for depth in (1, 2, 7, 40):
            pos, lcp = [], []
            I.Sorter(np.frombuffer(text + bytes(8), np.uint8), limit, depth).run(lambda p, x: (pos.extend(p.tolist()), lcp.extend(x.tolist())))
            assert sorted(pos) == list(range(len(text)))
            for a, b, n in zip(pos, pos[1:], lcp[1:]):
                x, y = text[a : a + depth], text[b : b + depth]
                common = next((k for k in range(min(len(x), len(y))) if x[k] != y[k] or x[k] == 0), min(len(x), len(y)))
                assert min(n, depth) == min(common, depth), (text, a, b)
            cut = [text[p : p + depth].split(b"\0")[0] for p in pos]
            whole = [c for c in cut if len(c) == depth]
            assert len([1 for a, b in zip(whole, whole[1:]) if a != b]) == len(set(whole)) - bool(whole)


def test_orders_of_names():
    r = random.Random(1)
    for n in (1, 2, 3, 17, 200):
        names = np.array([r.randint(0, max(1, n // 4)) for _ in range(n)], np.int64)
        want = sorted(range(n), key=lambda i: names[i:].tolist())
        assert I.order_in_memory(names).tolist() == want
        assert I.order_external(names, 5).tolist() == want


def test_heap_spills():
    r = random.Random(2)
    items = [(r.randint(0, 50), k, -k) for k in range(3000)]
    h, out = I.Heap(100), []
    for k, x in enumerate(items):
        h.push(x)
        if k % 3 == 2:
            out.append(h.pop())
    assert h.spilled
    rest = [h.pop() for _ in range(2000)]
    assert rest == sorted(rest) and sorted(out + rest) == sorted(items)
    h.close()


def test_memory_is_bounded():
    """A text of 75 times as many tuples as memory may hold: one array of them would be above the peak."""
    import tracemalloc

    r = np.random.default_rng(3)
    n, limit = 300_000, 4_000
    text = np.append(r.choice(np.frombuffer(b"abcd", np.uint8), n), np.uint8(0))
    text[200_000:250_000] = text[:50_000]
    padded = I.blank(n + 9, np.uint8, 0)
    padded[: n + 1] = text
    seen = I.Shelf(np.int64, 0)
    tracemalloc.start()
    I.Sorter(padded, limit).run(lambda pos, lcp: seen.append(pos))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 10 * limit and peak < n * I.TUPLE.itemsize / 2, peak
    order = np.array(seen.array())[::-1]
    want = I.order_in_memory(text.astype(np.int64))
    assert np.array_equal(order, want)
