from types import SimpleNamespace

from lagwise.streaming import slots


class Handle:
    """State and timers of one key in memory; counts the round trips."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def test_round_trips_do_not_grow_with_the_slots_of_a_group():
    handle, watch = Handle(), slots._Watch(1000)
    watch.init(handle)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    rows = [SimpleNamespace(slot=f"s{k}", at_ms=10, closes_ms=100, done_ms=50 + k if k % 2 else None) for k in range(500)]
    list(watch.handleInputRows(("p", "d", 0), iter(rows), clock))
    assert handle.timers == {100, 1100}
    fire = lambda at: list(watch.handleExpiredTimer(("p", "d", 0), clock, SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    out = fire(100)
    assert {(r.slot, r.state) for r in out} == {(f"s{k}", "done" if k % 2 and k < 50 else "missed") for k in range(500)} and len(out) == 500
    assert fire(1100) == [] and handle.value is None
    assert handle.calls <= 8
