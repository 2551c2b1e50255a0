"""A growing cuckoo filter over 16-byte keys (used inside tasks, one per shard)."""

from __future__ import annotations

import struct

import numpy as np

from talkframe.llm.words import mix

_WAYS = 4


def halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


class Layer:
    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.mask = np.uint64(buckets - 1)
        self.slots = np.zeros((buckets, _WAYS), np.uint16) if slots is None else slots

    def places(self, h):
        fp = (h[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        first = h[:, 0] & self.mask
        return fp, first, self.other(first, fp)

    def other(self, bucket, fp):
        return bucket ^ (mix(fp) & self.mask)

    def contains(self, h) -> np.ndarray:
        fp, a, b = self.places(h)
        return (self.slots[a] == fp[:, None]).any(1) | (self.slots[b] == fp[:, None]).any(1)

    def delete(self, h) -> np.ndarray:
        """Take one copy of each key's fingerprint out; which were there."""
        gone = np.zeros(len(h), bool)
        fp, a, b = self.places(h)
        for i in range(len(h)):
            for bucket in (a[i], b[i]):
                at = np.flatnonzero(self.slots[bucket] == fp[i])
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    gone[i] = True
                    break
        return gone

    def insert(self, h, rounds: int = 400) -> bool:
        """All keys at once: free slots first, then evictions; False leaves the layer as it was."""
        before = self.slots.copy()
        fp, bucket, _ = self.places(h)
        draw = np.random.default_rng(len(h))
        for turn in range(rounds):
            if not len(fp):
                return True
            order = np.argsort(bucket, kind="stable")
            fp, bucket = fp[order], bucket[order]
            head = np.searchsorted(bucket, bucket, side="left")
            rank = np.arange(len(bucket)) - head
            full = self.slots[bucket] != 0
            free = _WAYS - full.sum(1)
            put = rank < free
            at = np.argsort(full[put], axis=1, kind="stable")[np.arange(put.sum()), rank[put]]
            self.slots[bucket[put], at] = fp[put]
            fp, bucket, rank, free = fp[~put], bucket[~put], rank[~put], free[~put]
            if turn:  # the first in line at a full bucket takes a slot over
                lead = np.flatnonzero(rank == free)
                slot = draw.integers(0, _WAYS, len(lead))
                out = self.slots[bucket[lead], slot].copy()
                self.slots[bucket[lead], slot] = fp[lead]
                fp[lead] = out
            bucket = self.other(bucket, fp)
        self.slots = before
        return False


class Cuckoo:
    """Layers of doubling size: a layer that is full stays, a larger one follows.

    ``insert`` tells the layer that took the keys, and ``delete`` wants it back:
    layers differ in size, so an equal fingerprint in another layer may be
    another key's.  Within one layer equal fingerprints of a bucket pair are
    interchangeable, so a deletion there never loses a key that stays.
    """

    def __init__(self, layers: list[Layer] | None = None):
        self.layers = layers or []

    def insert(self, h: np.ndarray) -> int:
        """The number of the layer that holds the keys now."""
        if not len(h):
            return max(0, len(self.layers) - 1)
        if self.layers and self.layers[-1].insert(h):
            return len(self.layers) - 1
        size = 1 << max(3, int(np.ceil(np.log2(max(1, len(h)) / (0.8 * _WAYS)))))
        if self.layers:
            size = max(size, 2 * len(self.layers[-1].slots))
        layer = Layer(size)
        while not layer.insert(h):
            size *= 2
            layer = Layer(size)
        self.layers.append(layer)
        return len(self.layers) - 1

    def contains(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), bool)
        for layer in self.layers:
            found |= layer.contains(h)
        return found

    def delete(self, h: np.ndarray, layer: int) -> None:
        """Take keys out that ``insert`` put into ``layer``."""
        if len(h) and not self.layers[layer].delete(h).all():
            raise ValueError("a key to be deleted is not in its layer")

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<{1 + len(self.layers)}q", len(self.layers), *[len(x.slots) for x in self.layers])
        return head + b"".join(x.slots.tobytes() for x in self.layers)

    @classmethod
    def from_bytes(cls, blob: bytes) -> Cuckoo:
        n = struct.unpack_from("<q", blob)[0]
        sizes, at, layers = struct.unpack_from(f"<{n}q", blob, 8), 8 * (n + 1), []
        for size in sizes:
            raw = np.frombuffer(blob, np.uint16, size * _WAYS, at).reshape(size, _WAYS).copy()
            layers.append(Layer(size, raw))
            at += raw.nbytes
        return cls(layers)
