"""Words of texts, known by their bytes, and hashes of them."""

from __future__ import annotations

from hashlib import blake2b

#: An odd multiplier for hashes of sequences modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
#: Keys the digests of words, so that they are no other library's.
PERSON = b"millrace words"


class Table(dict):
    """What `make` gives for a key, which is compared whole: looked up by table[key], made where it is missing.
    When it holds `most` entries they become the old ones, of which those asked for again come back; keys
    longer than `wide` aren't kept."""

    def __init__(self, make, most: int, wide: int = 64):
        self.make, self.most, self.wide, self.old = make, most, wide, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.wide:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def digest(word: bytes, size: int = 8) -> bytes:
    """A keyed cryptographic digest: no two words are known to have the same one, whatever they are made of."""
    return blake2b(word, digest_size=size, person=PERSON).digest()


#: Digests of the words seen last.
_digests = Table(digest, 1 << 18)


def word_hashes(raw: bytes):
    """64-bit hashes of the words of UTF-8 bytes: runs of [^\\x20\\x09-\\x0D]."""
    import numpy as np

    return np.frombuffer(b"".join(map(_digests.__getitem__, raw.split())), np.uint64)


def mix(x):
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
