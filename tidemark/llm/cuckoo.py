"""A cuckoo filter in numpy: a set of 64-bit hashes that answers "perhaps" or "no", and from which members can be taken out again.

A hash has a 16-bit mark and two buckets of four slots, the second being the first XOR a hash of the mark, so either follows from
the other. Many are put in at once: all that fit into a free slot of a bucket go in, the rest push out a mark that stands
there and go on with what they pushed out.
"""

from __future__ import annotations

import numpy as np

from . import common

#: Slots of a bucket, rounds of pushing out, and the share of slots that a new filter fills at most.
SLOTS, ROUNDS, LOAD = 4, 500, 0.8


def ranked(key: np.ndarray) -> np.ndarray:
    """For each entry how many equal ones stand before it."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
    return rank


class Cuckoo:
    """Of hashes that differ; `members` are in it."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots  # (buckets, SLOTS), 0 is free

    @classmethod
    def sized(cls, members: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, members) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def loaded(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    def saved(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    @property
    def members(self) -> int:
        return int(np.count_nonzero(self.slots))

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (hashes >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (common.mix(hashes) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (common.mix(mark.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """False: not a member. True: a member, or with a chance of about 8 in 65 536 not."""
        mark, a = self._place(hashes)
        b = self._other(mark, a)
        return (self.slots[a] == mark[:, None]).any(1) | (self.slots[b] == mark[:, None]).any(1)

    def _settle(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put each mark into a free slot of its bucket while there are any; which found one."""
        free = self.slots[bucket] == 0
        rank = ranked(bucket)
        fits = rank < free.sum(1)
        slot = (np.cumsum(free, axis=1) == (rank + 1)[:, None]).argmax(1)  # the free slot of that rank
        self.slots[bucket[fits], slot[fits]] = mark[fits]
        return fits

    def add(self, hashes: np.ndarray) -> bool:
        """Put hashes in that are not members. False: too full, and then the filter is of no more use and must be made anew."""
        mark, bucket = self._place(hashes)
        rng = np.random.default_rng(len(hashes))
        for _ in range(ROUNDS):
            for _ in range(2):  # the one bucket, then the other
                left = ~self._settle(mark, bucket)
                mark, bucket = mark[left], self._other(mark[left], bucket[left])
                if not len(mark):
                    return True
            _, one = np.unique(bucket, return_index=True)  # one for each bucket pushes out a mark
            slot = rng.integers(SLOTS, size=len(one))
            out = self.slots[bucket[one], slot]
            self.slots[bucket[one], slot] = mark[one]
            mark[one], bucket[one] = out, self._other(out, bucket[one])
        return False

    def remove(self, hashes: np.ndarray) -> int:
        """Take members out; gives how many were found. What is not a member must not be given: it could take out another."""
        mark, bucket = self._place(hashes)
        found = 0
        for _ in range(2):
            here = self.slots[bucket] == mark[:, None]
            rank = ranked(bucket << 16 | mark)
            fits = rank < here.sum(1)
            slot = (np.cumsum(here, axis=1) == (rank + 1)[:, None]).argmax(1)
            self.slots[bucket[fits], slot[fits]] = 0
            found += int(fits.sum())
            mark, bucket = mark[~fits], self._other(mark[~fits], bucket[~fits])
        return found
