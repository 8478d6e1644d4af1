"""Pages of a batch are turned to strings of Python one by one."""

import gc

import pyarrow as pa

from quillspark.sources import pages


class Page(str):
    alive = most = 0

    def __new__(cls, x):
        Page.alive += 1
        Page.most = max(Page.most, Page.alive)
        return super().__new__(cls, x)

    def __del__(self):
        Page.alive -= 1


class Batch(list):
    """Arrow values that count the strings made of them."""

    class Value:
        def __init__(self, n):
            self.n = n

        def as_py(self):
            return Page(f"<title>t{self.n}</title><p>{'word ' * 20}{self.n}</p>")


def test_a_batch_holds_few_pages_as_strings():
    gc.collect()
    out = pages.page_text.func(Batch(Batch.Value(n) for n in range(300)))
    assert isinstance(out, pa.Array) and len(out) == 300 and out[7].as_py()["title"] == "t7"
    assert Page.most < 10
