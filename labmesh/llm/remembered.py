"""A table of what words encode to, bounded by its bytes."""

from __future__ import annotations

from collections.abc import Callable

# What Python adds to an entry, about.
ENTRY = 200
# Longer words are not kept.
LONGEST = 64


def _weight(words: dict[str, bytes]) -> int:
    return sum(map(len, words)) + sum(map(len, words.values())) + ENTRY * len(words)


class Remembered:
    """Two tables: the older is dropped when the younger is full, after what is still in
    use has moved to it."""

    def __init__(self, limit: int, compute: Callable[[list[str]], list[bytes]]):
        self.limit, self.compute = limit // 2, compute
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def look_up(self, words: list[str]) -> list[bytes]:
        """What words encode to, of which many are known or equal."""
        found = list(map(self.young.get, words))
        open_ = [k for k, known in enumerate(found) if known is None]
        if not open_:
            return found
        missing = {words[k] for k in open_}
        moved = {w: self.old[w] for w in missing if w in self.old}
        new = list(missing.difference(moved))
        computed = dict(zip(new, self.compute(new)))
        table = self.young
        for more in (moved, computed):
            table.update(more)
            self.held += _weight(more)
        for k in open_:
            found[k] = table[words[k]]
        long = {w: computed[w] for w in new if len(w) > LONGEST}
        if long or self.held > self.limit:
            kept = {w: value for w, value in table.items() if w not in long}
            if self.held > self.limit:
                self.old, self.young, self.held = kept, {}, 0
            else:
                self.young = kept
                self.held -= _weight(long)
        return found
