"""Language-model scoring by a hierarchical Pitman-Yor process."""

from __future__ import annotations

import math
from functools import cached_property, lru_cache, reduce
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from millrace.llm.common import Scratch, column, lean, partitions, release, table, unpacked

#: The hash of a text's end as a token; as a context, it is that of a text's first token.
END = np.uint64(0)
#: Tokens that a worker gathers before it passes their counts on.
FLUSH = 900_000
#: Customers of a dish up to which its tables are drawn from their conditional distribution; beyond, customers sit
#: in blocks of an eighth of those before them.
SINGLY = 64
#: A word's restaurant is known by its last byte, of which there are CLASSES, and BITS of its hash.
BITS, CLASSES = 56, 256
#: Parts of the model for each shuffle partition: their hashes collide less, and a part is smaller.
PARTS = 3
#: Entries of restaurants that are summed in one place, about.
ENTRIES = 2_000_000
#: Words in one piece of the model.
PIECE = 100_000
#: Tokens in one piece of scoring work, about.
SHARD = 700_000
#: Seeds the hashes of words.
SEED = 0x6D696C6C72616365
#: The levels' strengths: root, last byte, word before.
THETA = (1.0, 1.0, 1.0)
#: The numbers that are summed over the model: customers and tables of each last byte's restaurant, eight more of the
#: seating, all tokens, and the words' restaurants that each piece has entries of.
SUMS = 2 * CLASSES + 10
TOKEN = np.dtype([("hash", "<u8"), ("context", "<u8")])


def room(h):
    """The restaurant of what follows a word (hash): a number for each, the last byte first."""
    return h << np.uint64(BITS) | h >> np.uint64(64 - BITS)


def word_of(context):
    """The word (hash) whose restaurant it is."""
    return context << np.uint64(64 - BITS) | context >> np.uint64(BITS)


def _known(words) -> np.ndarray:
    """Words' hashes (BITS of XXH3, then the last byte), and the restaurants of what follows them: each word has its
    own. 0 is a text's end, and the restaurant of a text's first token."""
    out = np.empty(len(words), TOKEN)
    last = np.frombuffer(b"".join(words), np.uint8)[np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - 1]
    out["hash"] = h = np.fromiter(map(xxh3_64_intdigest, words, repeat(SEED)), np.uint64, len(words)) & ~np.uint64(CLASSES - 1) | last
    out["context"] = room(h)
    return out


def _token(word: bytes) -> bytes:
    return _known([word]).tobytes()


class Tokens:
    """Texts as words (A-Z lower-cased; runs of [^\\x20\\x09-\\x0D]) and an end each."""

    def __init__(self):
        self.words, self.ends, self.n = [], np.zeros(1, np.int64), 0

    def add(self, texts) -> None:
        """The texts of an Arrow array; null ones are empty."""
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
        words = split.flatten()
        some = pc.binary_length(words).to_numpy() > 0  # a blank text is split into one empty word
        before = np.append(0, np.cumsum(some))
        lengths = np.diff(before[split.offsets.to_numpy()])
        self.words.append(words if some.all() else words.filter(some))
        self.ends = np.append(self.ends, self.n + np.cumsum(lengths + 1))
        self.n = int(self.ends[-1])

    def pairs(self, where: bool = True):
        """(distinct words' hashes; each pair's word and word before, as places among them; counts; index of each
        token's pair): distinct pairs, by word and restaurant of the word before. The index is null if `where` is
        false, which takes less time and memory."""
        import pyarrow as pa

        coded = pa.concat_arrays([pa.array([], pa.large_string()), *[x.cast(pa.large_string()) for x in self.words]]).dictionary_encode()
        known = _known(coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False))
        number, word = np.zeros(self.n, np.uint32), np.ones(self.n, bool)
        word[self.ends[1:] - 1] = False
        number[word] = coded.indices.to_numpy() + 1
        h = np.append(END, known["hash"])
        by, by_room = np.argsort(h), np.argsort(room(h))
        rank, room_rank = np.empty((2, len(h)), np.uint64)
        rank[by] = room_rank[by_room] = np.arange(len(h), dtype=np.uint64)
        key = rank[number] << np.uint64(32)
        key[1:] |= room_rank[number[:-1]]  # what follows an end follows nothing, as the first token does
        del number, word, coded
        if where:
            order = np.argsort(key)
            key = key[order]
        else:
            key.sort()
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        count, one = np.diff(np.append(first, len(key))), key[first]
        place = None
        if where:
            place = np.empty(len(order), np.int32)
            place[order] = np.cumsum(new) - 1
        return h[by], (one >> np.uint64(32)).astype(np.int64), rank[by_room].astype(np.int64)[one & np.uint64(2**32 - 1)], count, place


def narrow(v) -> bytes:
    """Whole numbers from 0, most of them small: a byte each, and the large ones beside them with their places."""
    large = np.flatnonzero(v >= 255)
    return np.uint32(len(large)).tobytes() + large.astype("<u4").tobytes() + np.asarray(v)[large].astype("<u8").tobytes() + np.minimum(v, 255).astype(np.uint8).tobytes()


def wide(raw: bytes):
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    v = np.frombuffer(raw, np.uint8, offset=4 + 12 * n).astype(np.int64)
    v[np.frombuffer(raw, "<u4", n, 4)] = np.frombuffer(raw, "<u8", n, 4 + 4 * n)
    return v


def packed_logs(p) -> bytes:
    """Logs to base 10 of probabilities in six bytes each: twelve digits after the point, down to 10^-127."""
    steps = np.rint(np.log10(p) * -(2.0**41)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked_logs(raw: bytes):
    steps = np.zeros((len(raw) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return steps.view("<u8")[:, 0].astype(np.float64) * -(2.0**-41)


def parts_of(h, parts: int):
    """Where each word's part begins among sorted hashes: parts are ranges of the hash."""
    return np.searchsorted((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def sliced(texts):
    """An Arrow array of texts in slices of some megabytes, or of one longer text."""
    import pyarrow.compute as pc

    at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) >> 21
    cut = [0, *np.flatnonzero(at[1:] != at[:-1]) + 1, len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def by_part(words, w, u, parts: int):
    """Of pairs as Tokens gives them, for each part: (part, its words, their numbers of pairs, the restaurants, the
    slice of the pairs)."""
    c, cut = room(words)[u], parts_of(words, parts)
    ends = np.searchsorted(w, cut)
    for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        a, b = ends[p], ends[p + 1]
        yield p, words[cut[p] : cut[p + 1]].tobytes(), narrow(np.bincount(w[a:b] - cut[p], minlength=cut[p + 1] - cut[p])), c[a:b].tobytes(), slice(a, b)


def _count(texts: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        def flush(t):
            words, w, u, n, _ = t.pairs(where=False)
            rows = [(*x, narrow(n[at])) for *x, at in by_part(words, w, u, parts)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], (pa.int32(), *[pa.binary()] * 4)[k]) for k in range(5)], names=["part", "w", "k", "c", "n"])

        t = Tokens()
        for b in batches:
            for texts in sliced(b.column("text")):
                t.add(texts)
                if t.n > FLUSH:
                    yield flush(t)
                    t = Tokens()
        if t.n:
            yield flush(t)
        del t
        release()

    lean(texts.sparkSession)
    return texts.mapInArrow(run, "part int, w binary, k binary, c binary, n binary")


def _merge(counted: DataFrame, parts: int) -> DataFrame:
    """One row for each piece of a part: its words (sorted hashes), where each word's pairs begin, the words before
    that have a restaurant there (sorted hashes), each pair's place among them, the counts, and the first seating: one
    table for each pair."""
    def run(frame):
        import pandas as pd

        words, w = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in frame["w"]]), return_inverse=True)
        w = np.repeat(w, np.concatenate([wide(x) for x in frame["k"]]))
        rooms, at = np.unique(word_of(np.concatenate([np.frombuffer(x, np.uint64) for x in frame["c"]])), return_inverse=True)
        n = np.concatenate([wide(x) for x in frame["n"]])
        key = pair_key(w, rooms, at)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        w, at, n = w[order][first], at[order][first], np.add.reduceat(n[order], first)
        rows, ends = [], np.searchsorted(w, np.arange(len(words) + 1))
        for piece, lo in enumerate(range(0, len(words), PIECE)):
            hi = min(lo + PIECE, len(words))
            a, b = ends[lo], ends[hi]
            here, near = np.unique(at[a:b], return_inverse=True)
            rows.append((int(frame["part"].iloc[0]), piece, *Piece(words[lo:hi], ends[lo:hi] - a, rooms[here], near, n[a:b]).packed(), []))
        return pd.DataFrame(rows, columns=MODEL_NAMES)

    return counted.repartition(partitions(counted.sparkSession), "part").groupBy("part").applyInPandas(run, MODEL)


MODEL = "part int, piece int, words binary, start binary, rooms binary, at binary, counts binary, seats binary, sums binary, kept array<binary>"
MODEL_NAMES = [x.split()[0] for x in MODEL.split(", ")]


def pair_key(word, rooms, at):
    """A number for each pair, in the order of a piece: by word (its place), last byte of the word before, and place
    of that."""
    return word.astype(np.uint64) << np.uint64(40) | (rooms[at] & np.uint64(CLASSES - 1)) << np.uint64(32) | at.astype(np.uint64)


@lru_cache(maxsize=16)
def _ways(discount: float):
    """Logs of the generalised Stirling numbers: in how many ways, weighted by the discount, c customers sit at t
    tables, for c (row) and t (column) up to SINGLY."""
    out = np.full((SINGLY + 1, SINGLY + 2), -np.inf)
    out[1, 1] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(1, SINGLY):
            t = np.arange(SINGLY + 2)
            stay = out[c] + np.log(np.maximum(c - t * discount, 0.0))
            out[c + 1, 1:] = np.logaddexp(stay[1:], out[c, :-1])
    return out[:, : SINGLY + 1]


def reseat(customers, weight, discount: float, rng, gain=0.0):
    """Tables of each dish, drawn anew given all others: all its customers leave, and the number of their tables
    has a probability in proportion to the ways of sitting at so many, times `weight` for the first, weight + gain
    for the second and so on: the chance that a customer opens one. With more than SINGLY customers, those beyond
    come in blocks: the next one opens a table with probability weight / (weight + seated - discount * tables)."""
    tables = np.minimum(customers, 1).astype(np.int64)
    gain = np.broadcast_to(np.asarray(gain, np.float64), weight.shape)
    some = np.flatnonzero((customers > 1) & (customers <= SINGLY))
    some = some[np.argsort(customers[some].astype(np.uint8), kind="stable")]
    ends = np.searchsorted(customers[some], np.arange(2, SINGLY + 2))
    for c in (np.flatnonzero(ends[1:] > ends[:-1]) + 2).tolist():
        at = some[ends[c - 2] : ends[c - 1]]
        for part in np.array_split(at, max(1, len(at) * c // 2_000_000)):
            opened = np.log(weight[part, None] + gain[part, None] * np.arange(c)[None, :])
            logs = np.cumsum(opened, axis=1) + _ways(discount)[c, 1 : c + 1][None, :]
            up = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            tables[part] = 1 + (up < rng.random(len(part))[:, None] * up[:, -1:]).sum(axis=1)
    many = np.flatnonzero(customers > SINGLY)
    many = many[np.argsort(-customers[many], kind="stable")]
    total, w, t, seated = customers[many], weight[many], np.ones(len(many)), 1
    while len(total) and seated < total[0]:
        step = 1 if seated < SINGLY else max(1, seated // 8)
        here = int(np.searchsorted(-total, -seated, side="left"))  # those with more customers than are seated
        p = w[:here] / (w[:here] + seated - discount * t[:here])
        t[:here] += rng.random(here) < p if step == 1 else rng.binomial(np.minimum(step, total[:here] - seated), p)
        seated += step
    tables[many] = t.astype(np.int64)
    return tables


def rooms_of(row: dict):
    """The restaurants (their words) that a piece has entries of, and each pair's place among them."""
    rooms = np.frombuffer(row["rooms"], np.uint64)
    return rooms, np.frombuffer(row["at"], np.uint16 if len(rooms) <= 1 << 16 else np.uint32)


class Piece:
    """The restaurants' entries for some words. A word stands in the root, in a restaurant for each last
    byte of the words before it, and in one for each of those words; a table of one is a customer of its
    parent, so all of a word's seating is in one place."""

    def __init__(self, words, start, rooms, at, counts, seats=None):
        self.words, self.start, self.rooms, self.at, self.counts = words, start.astype(np.int64), rooms, at.astype(np.int64), counts.astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), np.diff(np.append(self.start, len(at))))
        upper = (rooms & np.uint64(CLASSES - 1)).astype(np.int64)[self.at]
        self.start1 = np.flatnonzero(np.concatenate([[True], (self.word[1:] != self.word[:-1]) | (upper[1:] != upper[:-1])])) if len(upper) else np.zeros(0, np.int64)
        self.row1 = np.repeat(np.arange(len(self.start1)), np.diff(np.append(self.start1, len(at))))
        self.upper, self.word1 = upper[self.start1], self.word[self.start1]
        self.start0 = np.searchsorted(self.word1, np.arange(len(words)))
        self.seats = seats if seats is not None else tuple(np.ones(n, np.int64) for n in (len(at), len(self.start1), len(words)))

    @classmethod
    def of(cls, row: dict, seats: bytes | None = None):
        out = cls(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["start"], np.uint32), *rooms_of(row), wide(row["counts"]))
        out.seats = out.seated(seats or row["seats"])
        return out

    def seated(self, seats: bytes) -> tuple:
        raw, a, b = wide(seats), len(self.at), len(self.at) + len(self.start1)
        return raw[:a], raw[a:b], raw[b:]

    @property
    def classes(self):
        """Each pair's restaurant."""
        return room(self.rooms)[self.at]

    def packed(self) -> tuple:
        """Words, starts, restaurants, places, counts, seats, and the sums (see SUMS)."""
        return self.words.tobytes(), self.start.astype(np.uint32).tobytes(), self.rooms.tobytes(), self.at.astype(np.uint16 if len(self.rooms) <= 1 << 16 else np.uint32).tobytes(), narrow(self.counts), *self.packed_seats()

    def packed_seats(self) -> tuple:
        t2, t1, t0 = self.seats
        c1, c0 = self.customers()
        few = [t0.sum(), len(self.words)]
        for n in (c0, c1, self.counts):
            few += [(n == 1).sum(), (n == 2).sum()]
        sums = np.concatenate([np.bincount(self.upper, v, CLASSES).astype(np.int64) for v in (c1, t1)] + [np.array([*few, self.counts.sum(), len(self.rooms)], np.int64)])
        return narrow(np.concatenate(self.seats)), sums.tobytes()

    def customers(self):
        """Of the last-byte restaurants and of the root: the tables below."""
        return np.add.reduceat(self.seats[0], self.start1), np.add.reduceat(self.seats[1], self.start0)

    def parents(self, s: dict):
        """The root's probability of each word, and the last-byte restaurants' of theirs."""
        c1, c0 = self.customers()
        (d0, d1, _), (th0, th1, _) = s["d"], THETA
        p0 = (c0 - d0 * self.seats[2] + (th0 + d0 * s["T0"]) * s["base"]) / (th0 + s["C0"])
        p1 = (c1 - d1 * self.seats[1] + (th1 + d1 * s["T1"][self.upper]) * p0[self.word1]) / (th1 + s["C1"][self.upper])
        return p0, p1

    def sweep(self, s: dict, rng) -> None:
        """Each dish of each restaurant is seated anew, given the totals of the last sweep without the dish's own:
        its customers and tables, and its tables as customers of the parent. First the tokens, then the tables
        below as customers of each next restaurant. T2 has the tables of each restaurant of `rooms`."""
        (d0, d1, d2), (th0, th1, th2) = s["d"], THETA
        p0, _ = self.parents(s)
        old2, old1, old0 = self.seats
        c1, c0 = self.customers()
        # The parent's probability of the dish without the customers that its own tables are there.
        rest, up = c1[self.row1] - old2, self.upper[self.row1]
        own = np.where(rest > 0, np.maximum(rest - d1 * np.minimum(old1[self.row1], rest), 0.0), 0.0)
        p1 = (own + (th1 + d1 * s["T1"][up]) * p0[self.word1][self.row1]) / (th1 + s["C1"][up] - old2)
        t2 = reseat(self.counts, (th2 + d2 * (s["T2"][self.at] - old2)) * p1, d2, rng, d2 * p1)
        rest = c0[self.word1] - old1
        own = np.where(rest > 0, np.maximum(rest - d0 * np.minimum(old0[self.word1], rest), 0.0), 0.0)
        p = (own + (th0 + d0 * s["T0"]) * s["base"]) / (th0 + s["C0"] - old1)
        t1 = reseat(np.add.reduceat(t2, self.start1), (th1 + d1 * (s["T1"][self.upper] - old1)) * p, d1, rng, d1 * p)
        t0 = reseat(np.add.reduceat(t1, self.start0), (th0 + d0 * (s["T0"] - old0)) * s["base"], d0, rng, d0 * s["base"])
        self.seats = (t2, t1, t0)

    @cached_property
    def keys(self) -> tuple:
        """The entries of both other levels, in their order: by word and last byte, and by pair."""
        return self.word1 << 8 | self.upper, pair_key(self.word, self.rooms, self.at)

    def find(self, words, w, c, first):
        """Places in this piece of `words`; of the pairs' entries (w, place among `words`; c, restaurant); and of the
        entries in the last bytes' restaurants, for the pairs `first`. It is the place after the last for what is not
        here."""

        def place(have, x, ok=True):
            k = np.minimum(np.searchsorted(have, x), len(have) - 1)
            return np.where(ok & (have[k] == x), k, len(have))

        ones, pairs = self.keys
        word, at = place(self.words, words), place(self.rooms, word_of(c))
        row = word[w]
        here, up = row < len(self.words), (c >> np.uint64(BITS)).astype(np.int64)
        one = place(ones, row[first] << 8 | up[first], here[first])
        return word, one, place(pairs, (row << 40 | up << 32 | at).astype(np.uint64), here & (at < len(self.rooms)))

    def predict(self, h, c, s: dict):
        """The probability of each word (hash) after each restaurant's word."""
        c, (c1, c0) = np.asarray(c).astype(np.uint64), self.customers()
        every = np.arange(len(h))
        word, one, pair = self.find(h, every, c, every)
        at = lambda v, k: np.append(v, 0)[k]
        p0 = root(s, at(c0, word), at(self.seats[2], word))
        p1 = last_byte(s, (c >> np.uint64(BITS)).astype(np.int64), at(c1, one), at(self.seats[1], one), p0)
        return word_before(s, at(self.counts, pair), at(self.seats[0], pair), s["C2"][c], s["T2"][c], p1)


def root(s: dict, customers, tables):
    """The root's probability of words with so many customers and tables there."""
    return (customers - s["d"][0] * tables + (THETA[0] + s["d"][0] * s["T0"]) * s["base"]) / (THETA[0] + s["C0"])


def last_byte(s: dict, up, customers, tables, parent):
    """The probability in the restaurants `up` of last bytes, given the root's."""
    return (customers - s["d"][1] * tables + (THETA[1] + s["d"][1] * s["T1"][up]) * parent) / (THETA[1] + s["C1"][up])


def word_before(s: dict, customers, tables, all_customers, all_tables, parent):
    """The probability in restaurants of words before, with so many customers and tables in all, given the last
    byte's."""
    return (customers - s["d"][2] * tables + (THETA[2] + s["d"][2] * all_tables) * parent) / (THETA[2] + all_customers)


def _totals(model: DataFrame, discounts=None) -> dict:
    """Sums over all pieces: tables and customers of the last bytes' restaurants and of the root, and from the first
    seating the discounts n1 / (n1 + 2 n2) of the levels. A task sums its pieces; one number of each kind reaches the
    driver."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros(SUMS, np.int64)
        for b in batches:
            for raw in b.column("sums").to_pylist():
                total += np.frombuffer(raw, np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "v"])

    s = np.zeros(SUMS)
    for r in model.select("sums").mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():
        s[r["k"]] = r["v"]
    c1, t1, few = np.split(s, [CLASSES, 2 * CLASSES])
    if discounts is None:
        discounts = tuple(min(0.95, max(0.1, a / (a + 2 * b))) if a + b else 0.5 for a, b in few[2:8].reshape(3, 2))
    return {"T1": t1, "C1": c1, "C0": t1.sum(), "T0": few[0], "base": 1.0 / (few[1] + 1), "N": few[8], "V": few[1], "d": discounts, "entries": int(few[9])}


def _summed(model: DataFrame, parts: int, entries: int, kept: bool = False) -> DataFrame:
    """The tables of the words' restaurants, each summed over all pieces. A piece sends its own sums to where the
    restaurant's word stands (`to`, a range of the hash); back come those of the whole model, in the order of the
    piece's restaurants: (part, piece, to, sums). If `kept`, they stay there instead: (part, rooms, sums) of each
    part's words, with the customers and the tables of each kept sample;
    a part may have two rows."""
    ranges = min(parts, max(1, math.ceil(entries / ENTRIES)))
    sent = "to int, part int, piece int, rooms binary, sums array<binary>"

    def send(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                rooms, at = rooms_of(row)
                own = [row["counts"], *(row["kept"] or [row["seats"]])] if kept else [row["seats"]]
                sums = [np.bincount(at, wide(x)[: len(at)], len(rooms)).astype(np.int64) for x in own]
                cut = parts_of(rooms, ranges)
                rows = [(r, row["part"], row["piece"], rooms[x:y].tobytes(), [narrow(v[x:y]) for v in sums]) for r, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["to", "part", "piece", "rooms", "sums"])
        release()

    def add(rows):
        import pyarrow as pa

        given = [np.frombuffer(x, np.uint64) for x in rows.column("rooms").to_pylist()]
        ends = np.cumsum([len(x) for x in given])
        rooms, at = np.unique(np.concatenate(given), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([wide(x) for x in v])).astype(np.int64) for v in zip(*rows.column("sums").to_pylist(), strict=True)]
        if kept:
            cut = parts_of(rooms, parts)
            here = [(p, x, y) for p, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
            return pa.Table.from_arrays([pa.array([p for p, _, _ in here], pa.int32()), pa.array([rooms[x:y].tobytes() for _, x, y in here], pa.binary()), pa.array([[narrow(v[x:y]) for v in sums] for _, x, y in here], pa.list_(pa.binary()))], names=["part", "rooms", "sums"])
        back = [narrow(x) for x in np.split(sums[0][at], ends[:-1])]
        return pa.Table.from_arrays([rows.column("part"), rows.column("piece"), rows.column("to"), pa.array(back, pa.binary())], names=["part", "piece", "to", "sums"])

    own = model.select("part", "piece", "rooms", "at", "seats", *(["counts", "kept"] if kept else [])).mapInArrow(send, sent)
    return own.groupBy("to").applyInArrow(add, "part int, rooms binary, sums array<binary>" if kept else "part int, piece int, to int, sums binary")


class Rooms:
    """Sums of the words' restaurants, which stay in their table: those asked for are looked up there."""

    def __init__(self, rooms: DataFrame, parts: int, k: int):
        self.rooms, self.parts, self.k = rooms, parts, k

    def __getitem__(self, c):
        h = word_of(np.asarray(c).astype(np.uint64))
        out = np.zeros(h.shape)
        among = np.unique((h >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).tolist()
        for r in self.rooms.where(F.col("part").isin(among)).select("rooms", F.col("sums")[self.k].alias("v")).toLocalIterator():
            rooms, v = np.frombuffer(r["rooms"], np.uint64), wide(r["v"])
            k = np.minimum(np.searchsorted(rooms, h), len(rooms) - 1)
            out = np.where(rooms[k] == h, v[k], out)
        return out

    def sum(self) -> int:
        return sum(int(wide(r["v"]).sum()) for r in self.rooms.select(F.col("sums")[self.k].alias("v")).toLocalIterator())


def train(texts: DataFrame, work: Scratch, sweeps: int = 4, keep: int = 2, seed: int = 1):
    """(model table, totals of each kept sample, parts): see score_texts. The totals of the words' restaurants stay
    in the table `rooms` of the scratch folder."""
    parts = PARTS * partitions(texts.sparkSession)
    model = work.write(_merge(_count(texts, parts), parts), "model-0")
    totals = _totals(model)
    first, samples = totals, []

    def swept(k: int, s: dict):
        def run(key, rows, sums):
            import pyarrow as pa

            release(cycles=False)
            row = rows.to_pylist()[0]
            piece = Piece.of(row)
            total = np.concatenate([wide(x) for x in sums.sort_by("to").column("sums").to_pylist()])
            piece.sweep(s | {"T2": total}, np.random.default_rng([seed, k, row["part"], row["piece"]]))
            row["seats"], row["sums"] = piece.packed_seats()
            row["kept"] = [*row["kept"], row["seats"]] if k > sweeps - keep else []
            return pa.Table.from_pylist([row], schema=rows.schema)

        return run

    for k in range(1, sweeps + 1):
        sums = _summed(model, parts, first["entries"]).groupBy("part", "piece")
        model = work.write(model.groupBy("part", "piece").cogroup(sums).applyInArrow(swept(k, totals), MODEL), f"model-{k}")
        work.drop(f"model-{k - 1}")
        totals = _totals(model, first["d"])
        if k > sweeps - keep:
            samples.append(totals)
    rooms = work.write(_summed(model, parts, first["entries"], kept=True), "rooms")
    samples = [s | {"C2": Rooms(rooms, parts, 0), "T2": Rooms(rooms, parts, 1 + k)} for k, s in enumerate(samples or [first])]
    return model, samples, parts


def score_texts(docs: DataFrame, training: DataFrame, sweeps: int = 4, keep: int = 2, seed: int = 1, passes: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row of `docs`, by a hierarchical
    Pitman-Yor model of the texts of `training`; other columns of `docs` pass through.

    Tokens are words (A-Z lower-cased, split at blanks) and an end. The restaurants of a token are that of
    the whole word before it, of which each word has its own, that of that word's last byte, which all words with that
    byte share as parent, and the root, whose base is uniform over the vocabulary and one unknown. Seating is
    sampled in `sweeps` Gibbs sweeps, in which each dish's customers leave and sit down again given the
    others' totals; predictive probabilities are averaged over the last `keep`, and `score` is the sum of
    their log10. base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))) instead, c a token's count.

    A task counts the pairs of its texts and passes them on by ranges of the word's hash, so a word's entries in all
    restaurants are in one place. A restaurant's total of tables is summed where its own word stands, and sent back
    to the pieces that have entries of it before each sweep; only totals of the last bytes' restaurants meet on the
    driver. To score, texts are dealt into shards by a hash of the row; a shard asks each part of the model for the
    customers and tables of its distinct words and pairs once. The shards are scored in `passes`, each written before
    the next begins, so that what travels for one is gone before the next.

    Null texts count as empty: the end only. Repeated rows are tokens, and rows of the result, of their
    own; null ids are kept. If nothing is there to learn from, every token is unknown. Words are known by
    64 bits of a seeded hash of their bytes. Columns of `docs` may have any names; those named like a result are replaced.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "lm")
    model, samples, parts = train(training.select(column(text_col).alias("text")), work, sweeps, keep, seed)
    # The words' restaurants stay in their table; a shard asks for the totals of its own.
    plain = [{k: v for k, v in s.items() if k not in ("C2", "T2")} for s in samples]
    last, n_samples = plain[-1], len(plain)
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    letters = docs.agg(F.sum(F.length(column(text_col)))).first()[0] or 0
    shards = max(1, math.ceil(letters / 6 / SHARD))
    shard = F.pmod(F.xxhash64(column(id_col), column(text_col)), F.lit(shards)).cast("int")
    rest = docs.drop(column(text_col))
    given = [c for c in rest.columns if c not in made]
    dealt = docs.select(shard.alias("_shard"), column(text_col).alias("_text"), F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(rest.columns)]).alias("row"))
    base = math.log10(0.1 / (last["N"] + 0.1 * (last["V"] + 1)))
    sums = spark.sparkContext.broadcast(plain)
    shapes = 1 + 3 * n_samples, 2 * n_samples, 1 + n_samples

    def gather(texts):
        t = Tokens()
        for x in texts.chunks:
            t.add(x)
        return t

    def ask(key, rows):
        import pyarrow as pa

        release(cycles=False)
        words, w, u, _, _ = gather(rows.column("_text")).pairs(where=False)
        asked = [(p, key[0].as_py(), *x) for p, *x, _ in by_part(words, w, u, parts)]
        kinds = {"part": pa.int32(), "shard": pa.int32(), "w": pa.binary(), "k": pa.binary(), "c": pa.binary()}
        return pa.Table.from_arrays([pa.array([r[i] for r in asked], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    def answer(key, held, asked):
        """For each word asked for its tokens (the customers of its restaurant, too), its customers and tables in the
        root and the tables of its restaurant; for each word and last byte, and for each pair, customers and tables;
        customers of pairs are tokens, all else is by sample."""
        import pyarrow as pa

        release(cycles=False)
        got = []
        for w, k, c in zip(*(asked.column(x).to_pylist() for x in ("w", "k", "c")), strict=True):
            words, k, c = np.frombuffer(w, np.uint64), wide(k), np.frombuffer(c, np.uint64)
            w = np.repeat(np.arange(len(words)), k)
            first = np.flatnonzero(starts(w, c >> np.uint64(BITS)))
            got.append((words, w, c, first, [np.zeros(x, np.int64) for x in zip(shapes, (len(words), len(first), len(c)), strict=True)]))
        for row in (held.slice(i, 1).to_pylist()[0] for i in range(held.num_rows) if got):
            if row["piece"] < 0:
                rooms = np.frombuffer(row["rooms"], np.uint64)
                for words, _, _, _, out in got:
                    k = np.minimum(np.searchsorted(rooms, words), len(rooms) - 1)
                    for i, x in enumerate(row["kept"][1:]):
                        out[0][1 + 2 * n_samples + i] += np.where(rooms[k] == words, wide(x)[k], 0)
                continue
            piece, of_word, of_one, of_pair = Piece.of(row, row["kept"][0]), [], [], []
            of_word.append(np.add.reduceat(piece.counts, piece.start))
            of_pair.append(piece.counts)
            for x in row["kept"]:
                piece.seats = piece.seated(x)
                c1, c0 = piece.customers()
                of_word += [c0, piece.seats[2]]
                of_one += [c1, piece.seats[1]]
                of_pair.append(piece.seats[0])
            tables = [[np.append(v, 0) for v in x] for x in (of_word, of_one, of_pair)]
            for words, w, c, first, out in got:
                a, b = np.searchsorted(words, piece.words[0]), np.searchsorted(words, piece.words[-1], side="right")
                x, y = np.searchsorted(w, (a, b))
                g, h = np.searchsorted(first, (x, y))
                if x == y:
                    continue
                places = piece.find(words[a:b], w[x:y] - a, c[x:y], first[g:h] - x)
                for here, at, k, v in zip(out, (slice(a, b), slice(g, h), slice(x, y)), places, tables, strict=True):
                    for i, numbers in enumerate(v):
                        here[i, at] += numbers[k]
        back = [narrow(np.concatenate([x.ravel() for x in out])) for *_, out in got]
        return pa.Table.from_arrays([asked.column("shard"), asked.column("part"), pa.array(back, pa.binary())], names=["shard", "part", "numbers"])

    def score(rows, answers):
        import pyarrow as pa

        release(cycles=False)
        t = gather(rows.column("_text"))
        words, w, u, _, at = t.pairs()
        up = (words[u] & np.uint64(CLASSES - 1)).astype(np.int64)
        first = np.flatnonzero(starts(w, up))
        cut = parts_of(words, parts)
        pairs = np.searchsorted(w, cut)
        cuts = cut, np.searchsorted(first, pairs), pairs
        of_word, of_one, of_pair = got = [np.zeros(x, np.int64) for x in zip(shapes, (len(words), len(first), len(w)), strict=True)]
        for part, raw in zip(answers.column("part").to_pylist(), answers.column("numbers").to_pylist(), strict=True):
            v, lo = wide(raw), 0
            for numbers, ends in zip(got, cuts, strict=True):
                a, b = ends[part], ends[part + 1]
                numbers[:, a:b] = v[lo : lo + len(numbers) * (b - a)].reshape(len(numbers), b - a)
                lo += len(numbers) * (b - a)
        one, p = np.cumsum(starts(w, up)) - 1, 0.0
        for i, s in enumerate(sums.value):
            p0 = root(s, *of_word[1 + 2 * i : 3 + 2 * i])
            p1 = last_byte(s, up[first], *of_one[2 * i : 2 * i + 2], p0[w[first]])
            p = p + word_before(s, of_pair[0], of_pair[1 + i], of_word[0][u], of_word[1 + 2 * n_samples + i][u], p1[one])
        p = np.log10(p / n_samples)
        c = of_word[0]
        low = np.log10((c + 0.1) / (last["N"] + 0.1 * (last["V"] + 1))) if last["N"] else np.full(len(c), base)
        ends = t.ends[:-1]
        total = lambda v: pa.array(np.add.reduceat(v[at], ends))
        new = [pa.array(np.diff(t.ends)), total((c > 0).astype(np.int64)[w]), pa.array(np.full(rows.num_rows, int(last["N"]))), total(low[w]), total(p)]
        return pa.Table.from_arrays([rows.column("row"), *new], names=["row", *made])

    out = T.StructType([dealt.schema["row"], *[T.StructField(c, T.LongType() if k < 3 else T.DoubleType()) for k, c in enumerate(made)]])
    kept = F.when(F.size("kept") == 0, F.array("seats")).otherwise(F.col("kept"))
    none = F.lit(None).cast("binary")
    sent = model.select("part", "piece", "words", "start", "rooms", "at", "counts", kept.alias("kept"))
    sent = sent.union(spark.read.parquet(work.path("rooms")).select("part", F.lit(-1), none, none, "rooms", none, none, "sums"))
    scored, passes = [], min(passes, shards)
    for k in range(passes):
        # Both uses of these rows have the same columns, so that they are shuffled once.
        here = dealt.where(F.col("_shard") % passes == k)
        requests = here.groupBy("_shard").applyInArrow(ask, "part int, shard int, w binary, k binary, c binary")
        answers = sent.groupBy("part").cogroup(requests.groupBy("part")).applyInArrow(answer, "shard int, part int, numbers binary")
        scored.append(work.write(here.groupBy("_shard").cogroup(answers.groupBy("shard")).applyInArrow(score, out), f"scored-{k}"))
    work.keep(*[f"scored-{k}" for k in range(passes)])
    return reduce(DataFrame.union, scored).select(*unpacked(rest, given), *made)


def starts(*keys):
    """Where runs of equal keys begin, as a mask."""
    return np.concatenate([np.ones(min(1, len(keys[0])), bool), np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def _absent(samples: list[dict], c):
    """The probability of a word that no training text holds, after each restaurant's word."""
    up = np.asarray(c).astype(np.uint64) >> np.uint64(BITS)
    return sum(word_before(s, 0, 0, s["C2"][c], s["T2"][c], last_byte(s, up.astype(np.int64), 0, 0, root(s, 0, 0))) for s in samples) / len(samples)


def op5_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return score_texts(docs.withColumn("held_out", held), docs.where(~held)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
SQL: dict = {}
