"""A cuckoo filter over 16-byte keys: inserts, deletions and lookups of many keys at once.

A key's fingerprint lies in one of two buckets of four slots; the second bucket
follows from the first and the fingerprint, so an entry can move without its
key.  A key must be inserted before it is deleted, and as often.  What finds no
place after ``KICKS`` moves is kept whole in a list beside the slots, so a lookup
never misses a key that was inserted.
"""

from __future__ import annotations

import numpy as np

KEY_BYTES = 16
SLOTS, KICKS, FULL = 4, 200, 0.85
_MIX = np.uint32(0x5BD1E995)


def places(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints and both buckets of keys, given as rows of 16 bytes; ``buckets`` is a power of two.

    The first four bytes are left to the choice of a shard.
    """
    words = np.ascontiguousarray(keys).view("<u4")
    mark = np.maximum(words[:, 1], np.uint32(1))
    mask = np.uint32(buckets - 1)
    first = words[:, 2] & mask
    return mark, first, first ^ _other(mark, mask)


def _other(mark, mask):
    with np.errstate(over="ignore"):
        mixed = mark * _MIX
    return (mixed ^ (mixed >> np.uint32(15))) & mask


class CuckooFilter:
    def __init__(self, slots: np.ndarray, spill: set[bytes], held: int):
        self.slots, self.spill, self.held = slots, spill, held

    @classmethod
    def for_keys(cls, count: int) -> CuckooFilter:
        """Empty, with room for ``count`` keys."""
        buckets = 1
        while buckets * SLOTS * FULL < count:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint32), set(), 0)

    @classmethod
    def read(cls, slots: bytes, spill: list[bytes], held: int) -> CuckooFilter:
        return cls(np.frombuffer(slots, np.uint32).reshape(-1, SLOTS).copy(), set(spill), held)

    def room_for(self, more: int) -> bool:
        return self.held + more <= self.slots.size * FULL

    def insert(self, keys: np.ndarray) -> None:
        mark, first, second = places(keys, len(self.slots))
        self.held += len(keys)
        left = np.arange(len(keys))
        for bucket in (first, second):
            own = bucket[left]
            order = np.argsort(own, kind="stable")
            own = own[order]
            turn = np.arange(len(own)) - np.searchsorted(own, own)
            taken = self.slots[own] != 0
            fits = turn < SLOTS - taken.sum(axis=1)
            free = np.argsort(taken, axis=1, kind="stable")  # free slots first
            rows = left[order]
            self.slots[own[fits], free[fits, turn[fits]]] = mark[rows[fits]]
            left = rows[~fits]
        mask = np.uint32(len(self.slots) - 1)
        random = np.random.default_rng(len(keys))
        for row in left.tolist():
            if not self._kick(mark[row], int(first[row]), mask, random):
                self.spill.add(keys[row].tobytes())

    def _kick(self, mark: np.uint32, bucket: int, mask: np.uint32, random: np.random.Generator) -> bool:
        path = []
        for _move in range(KICKS):
            bucket ^= int(_other(mark, mask))
            empty = np.flatnonzero(self.slots[bucket] == 0)
            if len(empty):
                self.slots[bucket, empty[0]] = mark
                return True
            slot = int(random.integers(SLOTS))
            path.append((bucket, slot))
            mark, self.slots[bucket, slot] = self.slots[bucket, slot], mark
        for bucket, slot in reversed(path):  # undo: the entry that is left over must be the one that came
            mark, self.slots[bucket, slot] = self.slots[bucket, slot], mark
        return False

    def delete(self, keys: np.ndarray) -> None:
        mark, first, second = places(keys, len(self.slots))
        for row in range(len(keys)):
            key = keys[row].tobytes()
            if key in self.spill:
                self.spill.remove(key)
            else:
                for bucket in (first[row], second[row]):
                    at = np.flatnonzero(self.slots[bucket] == mark[row])
                    if len(at):
                        self.slots[bucket, at[0]] = 0
                        break
                else:
                    raise KeyError("a key was deleted that is not held")
            self.held -= 1

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = places(keys, len(self.slots))
        found = ((self.slots[first] == mark[:, None]) | (self.slots[second] == mark[:, None])).any(axis=1)
        if self.spill:
            found |= np.fromiter((key.tobytes() in self.spill for key in keys), bool, len(keys))
        return found
