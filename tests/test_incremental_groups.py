"""State of many documents is read and stored together."""

import pandas as pd

from scriptorium.streaming import incremental


class Store:
    """State of one group that counts its calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def get(self):
        self.calls += 1
        return iter(list(self.rows))

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + list(rows)

    def clear(self):
        self.calls, self.rows = self.calls + 1, []

    keys = get


class Handle:
    def __init__(self):
        self.states = {}

    def of(self, name, *schemas):
        return self.states.setdefault(name, Store())

    getListState = getMapState = of


def test_calls_of_the_state_store_do_not_grow_with_documents():
    handle, got = Handle(), []
    for begin in (1, 3):  # two deliveries of two paragraphs each
        fold = incremental.Fold(10)
        fold.init(handle)
        frame = pd.DataFrame([(f"={i}", n, "x" * 4, 4) for i in range(500) for n in (begin, begin + 1)], columns=["doc", "para_no", "text", "paras"])
        got += [tuple(r) for f in fold.handleInputRows((0,), iter([frame[:700], frame[700:]]), None) for r in f.itertuples(index=False)]
    assert sum(s.calls for s in handle.states.values()) <= 8
    assert not handle.states["open"].rows and len(handle.states["ended"].rows) == 500
    line = "x" * 4
    assert sorted(got) == sorted(s for i in range(500) for s in ((f"={i}", 1, 1, 2, 2, 8, f"{line}\n{line}", False), (f"={i}", 2, 3, 4, 2, 8, f"{line}\n{line}", True)))
