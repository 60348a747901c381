"""Best-fit decreasing with a segment tree over free room, piece by piece or on counts."""

from __future__ import annotations

from collections import Counter


class RoomTree:
    """Segment tree over room sizes; finds the least room that still fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def least_from(self, size: int) -> int:
        """The least room of at least ``size`` that some sequence has, or -1."""
        count, i = self.count, size + self.leaves
        if count[i]:
            return size
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes into ``lengths`` by sequence; ties go by index."""
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    tree, open_by_room, packed = RoomTree(capacity), [[] for _ in range(capacity + 1)], []
    for k in order:
        size = lengths[k]
        room = tree.least_from(size)
        if room < 0:
            room, at = capacity, len(packed)
            packed.append([])
        else:
            at = open_by_room[room].pop()
            tree.add(room, -1)
        packed[at].append(k)
        if room > size:
            open_by_room[room - size].append(at)
            tree.add(room - size, 1)
    return packed


def best_fit_counts(left: Counter, capacity: int) -> Counter:
    """Best-fit decreasing of so many pieces of each size: the patterns (sizes, falling) with their numbers.

    The same rooms as piece by piece, but like sequences go together: a sequence that got a
    piece is the next piece's best fit for as long as one fits. The work grows with the number of
    different sizes, not of pieces.
    """
    tree = RoomTree(capacity)
    by_room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]

    def put(pattern: tuple[int, ...], room: int, n: int) -> None:
        if n:
            by_room[room].append((pattern, n))
            tree.add(room, n)

    for size in sorted((s for s, n in left.items() if n > 0), reverse=True):
        n = left[size]
        while n:
            room = tree.least_from(size)
            if room < 0:
                room, pattern, there = capacity, (), n
            else:
                pattern, there = by_room[room].pop()
                tree.add(room, -there)
            each = room // size
            full = min(there, n // each)
            put(pattern + (size,) * each, room - each * size, full)
            n, there = n - full * each, there - full
            if n and there:  # one sequence more takes the rest, fewer than it could
                put(pattern + (size,) * n, room - n * size, 1)
                n, there = 0, there - 1
            if pattern:
                put(pattern, room, there)
    out: Counter = Counter()
    for groups in by_room:
        for pattern, n in groups:
            out[pattern] += n
    return out
