"""Pairs of records that share most of their word shingles, across splits and within a collection.

Both operators read each text in a few streaming passes and move only hashes:

1. *profile*: every record's set of distinct shingle hashes is reduced to a class hash (records with equal
   sets are one class) and its size; the same pass folds all hashes into a count sketch sized from their number.
2. *candidates*, across splits: evaluation sets are dealt into groups of shingles, chosen by rarity, whose index goes to
   the tasks in shares of bounded size; a training set that holds enough groups whole is a candidate, which is counted where it is read.
   Within a collection: each class sends hashes, chosen by rarity, into inverted lists, which are cut into buckets; what tasks
   send for one bucket travels packed.  A list that is expected to be hot is split into shares.  Classes that meet often
   enough in the lists, which are joined in numpy, a bucket at a time, are candidates.
3. *verify*: the sets of the candidates alone are read again and compared exactly.

Exact copies never meet in lists: one class stands for all of them, and pairs of records come
from the classes' members at the very end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.shingles import HASH_BITS, list_shingle_sets, mix
from treeloom.llm.sketches import Counter, bits_of_column, blocks_of, count_at, count_bits, count_level, filter_bits, may_contain, merge_counts
from treeloom.operators.components import components
from treeloom.session import BROADCAST_ROWS, drop_table, write_table

WORDS = 3
_ROWS_AT_ONCE = 1024
#: Rows from which the number of shingles is estimated that the count sketch is sized for; results don't depend on it.
SIZING_ROWS = 2000
_CHARACTERS = 6  # of a word and the blank behind it, about
#: Classes that a task remembers so as to send a copy once; beyond, copies are dropped where lists are joined.
_REMEMBERED = 1 << 20


def code(c: Column) -> Column:
    """The low 32 bits of a class; a shared code only adds candidates."""
    return c.bitwiseAND(F.lit(0xFFFFFFFF))


@dataclass(frozen=True)
class Overlap:
    """Parameters of both operators; shares are numerator / denominator, so that limits are exact.

    No parameter loses a pair: ``agree`` and ``agree_near`` (1 gives the plain prefix filter) trade keys for candidates,
    ``groups_at_once`` bounds what one task looks up, ``keys_at_once`` and ``hot`` what one joins.
    """

    words: int = WORDS
    containment: tuple[int, int] = (4, 5)
    jaccard: tuple[int, int] = (3, 5)
    #: Containment: groups of an evaluation set that a training set must hold whole.
    agree: int = 6
    #: Jaccard: rare shingles two sets must share in the lists.
    agree_near: int = 6
    #: Containment: groups in one share of the index, about; 14 to 20 bytes each in every task.
    groups_at_once: int = 1 << 22
    #: Keys that one task joins at once, about.
    keys_at_once: int = 400_000
    #: Entries of a list beyond which it is split into shares of that size.
    hot: int = 1 << 14


class Sets:
    """Shingle sets of one slice of a batch."""

    def __init__(self, batch: pa.RecordBatch, words: int):
        self.ids = batch.column(0).to_numpy(zero_copy_only=False)
        self.offsets, self.values = list_shingle_sets(batch.column(1), words)
        self.sizes = np.diff(self.offsets)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        mixed = mix(self.values + np.uint64(0x632BE59BD9B4E019))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)))
        self.classes = mix(sums[self.offsets[1:]] - sums[self.offsets[:-1]] + self.sizes.astype(np.uint64)).view(np.int64)

    def take(self, rows: np.ndarray) -> None:
        """Keep only the given rows (a mask)."""
        kept = rows[self.owner]
        self.values, self.ids, self.classes, self.sizes = self.values[kept], self.ids[rows], self.classes[rows], self.sizes[rows]
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def ranked(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values ordered within each set from rare to common (ties by hash), and their places from 0."""
        order = np.argsort((self.owner.astype(np.uint64) << np.uint64(8)) | level.astype(np.uint64), kind="stable")
        return self.values[order], np.arange(len(order)) - self.offsets[self.owner]


def _slices(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[Sets]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
            yield Sets(batch.slice(at, _ROWS_AT_ONCE), words)


class _Seen:
    """Keeps the first row of each class in a task: copies are combined before anything is sent."""

    def __init__(self) -> None:
        self.classes = np.empty(0, np.int64)

    def keep(self, sets: Sets) -> Sets:
        """Only the rows with shingles whose class is new."""
        first = np.zeros(len(sets.classes), bool)
        first[np.unique(sets.classes, return_index=True)[1]] = True
        sets.take(first & (sets.sizes > 0) & ~np.isin(sets.classes, self.classes))
        held = self.classes if len(self.classes) < _REMEMBERED else np.empty(0, np.int64)
        self.classes = np.concatenate((held, sets.classes))
        return sets


def _texts(df: DataFrame, key: str, texts: Column | str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), (F.col(texts) if isinstance(texts, str) else texts).alias("texts"))


class Profile:
    """Classes and sizes of all records, and the count sketch of all shingles: one pass over the texts."""

    SCHEMA = "id bigint, class bigint, n int, block int, data binary"

    def __init__(self, texts: DataFrame, o: Overlap):
        bits = count_bits(self._expected(texts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = Counter(bits)
            for s in _slices(batches, o.words):
                counter.add(s.values)
                empty = pa.nulls(len(s.ids), pa.int32()), pa.nulls(len(s.ids), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(s.ids), pa.array(s.classes), pa.array(s.sizes.astype(np.int32)), *empty], ["id", "class", "n", "block", "data"])
            numbers, datas = blocks_of(counter.cells)
            none = pa.nulls(len(numbers), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(numbers), pa.int32()), pa.array(numbers, pa.int32()), pa.array(datas, pa.binary())], ["id", "class", "n", "block", "data"])

        self.table, self.path = write_table(texts.mapInArrow(run, self.SCHEMA), "profile")
        self.counts = merge_counts(self.table.filter("block is not null").select("block", "data"), bits)
        #: (class, id): every record with at least one shingle, once.
        self.members = self.table.filter("block is null and n > 0").select("class", "id", "n").distinct()
        #: Number of shingles of all records, repeated ones included.
        self.total = self.table.filter("block is null").agg(F.sum("n")).first()[0] or 0

    @staticmethod
    def _expected(texts: DataFrame) -> int:
        """About how many shingles there are: rows times the mean of the first ones, of whose texts only the lengths are collected."""
        length = F.aggregate(F.coalesce("texts", F.array().cast("array<string>")), F.lit(0), lambda n, t: n + F.coalesce(F.length(t), F.lit(0)))
        first = texts.select(length.alias("n")).limit(SIZING_ROWS).toArrow()["n"].to_numpy()
        return int(texts.select("id").count() * first.mean()) // _CHARACTERS if len(first) else 0


def _broadcast(df: DataFrame, value: object):  # noqa: ANN202
    return df.sparkSession.sparkContext.broadcast(value)


def _verified(texts: DataFrame, profile: Profile, pairs: DataFrame, o: Overlap, agree: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The pairs (a, b) of classes whose sets pass ``agree(shared, size a, size b)``, by reading the candidates' texts once more."""
    pairs, _ = write_table(pairs, "candidates")
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    chosen, _ = write_table(profile.members.join(wanted, "class").groupBy("class").agg(F.min("id").alias("id")).select("id"), "chosen")
    number, known = chosen.count(), None
    bits = filter_bits(number)
    if number <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(chosen), "id", "left_semi")
    elif bits is None:
        texts = texts.join(chosen, "id", "left_semi")
    else:
        known = _broadcast(texts, bits_of_column(chosen, "id", bits))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            if known is not None:
                batch = batch.filter(pa.array(may_contain(known.value, mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))))
            for s in _slices([batch], o.words):
                seen.keep(s)
                yield pa.RecordBatch.from_arrays([pa.array(s.classes), pa.array([_packed(v) for v in np.split(s.values, s.offsets[1:-1])] if len(s.sizes) else [], pa.binary())], ["class", "hashes"])

    sets = texts.mapInArrow(read, "class bigint, hashes binary").dropDuplicates(["class"])
    sets, _ = write_table(sets.join(wanted, "class", "left_semi"), "sets")
    left = sets.select(F.col("class").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("hashes").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                xs, xn = _flat(batch.column(2))
                ys, yn = _flat(batch.column(3))
                yield batch.select([0, 1]).filter(pa.array(agree(shared_counts(xs, xn, ys, yn), xn, yn)))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


_HASH_BYTES = HASH_BITS // 8


def _packed(values: np.ndarray) -> bytes:
    """The used low bytes of each hash (little-endian)."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]).tobytes()


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column of packed ones, and the number of each row."""
    parts = [np.frombuffer(v.as_buffer(), np.uint8) for v in column]
    flat = np.concatenate(parts).reshape(-1, _HASH_BYTES) if parts else np.empty((0, _HASH_BYTES), np.uint8)
    wide = np.zeros((len(flat), 8), np.uint8)
    wide[:, :_HASH_BYTES] = flat
    return wide.view(np.uint64).ravel(), np.array([len(p) // _HASH_BYTES for p in parts], np.int64)


def shared_counts(xs: np.ndarray, xn: np.ndarray, ys: np.ndarray, yn: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets."""
    row = np.concatenate((np.repeat(np.arange(len(xn)), xn), np.repeat(np.arange(len(yn)), yn))).astype(np.uint64)
    key = np.sort((row << np.uint64(HASH_BITS)) | np.concatenate((xs, ys)))
    twice = key[1:][key[1:] == key[:-1]] >> np.uint64(HASH_BITS)
    return np.bincount(twice.astype(np.int64), minlength=len(xn))


# -- packed lists ------------------------------------------------------------------------------------------------------


class _Buckets:
    """Keys of one task, gathered and then packed by bucket: 24 bits of hash, code, size and place each, the middle two once for each class in a bucket.

    A bucket holds as many keys at any size of the table, so that a few in a hundred share their 24 bits with another: meetings by chance, which only add candidates.
    """

    ROWS = 1 << 20

    def __init__(self, buckets: int):
        self.buckets, self.held, self.number = np.uint64(buckets), [], 0

    def add(self, values: np.ndarray, place: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Keys of one class must come one after another."""
        self.held.append((values, place, classes, sizes))
        self.number += len(values)
        if self.number >= self.ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.number:
            return
        values, place, classes, sizes = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.number = [], 0
        bucket = ((values >> np.uint64(HASH_BITS - 32)) * self.buckets) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        bucket, values, place, classes, sizes = bucket[order], values[order], place[order], classes[order], sizes[order]
        new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (classes[1:] != classes[:-1])))
        begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        datas = []
        for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(bucket)).tolist()):
            first = lo + np.flatnonzero(new[lo:hi])
            head = np.array([len(first), hi - lo], np.uint64).tobytes()
            datas.append(head + _planes(classes[first].view(np.uint64)) + _planes(sizes[first]) + _planes(np.diff(np.append(first, hi))) + _planes(values[lo:hi], 3) + _planes(place[lo:hi]))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int64)), pa.array(datas, pa.binary())], ["bucket", "data"])


def _planes(values: np.ndarray, width: int = 4) -> bytes:
    """The low bytes of each number, plane by plane, so that empty planes compress away."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: np.ndarray, width: int = 4) -> np.ndarray:
    wide = np.zeros((len(data) // width, 4), np.uint8)
    wide[:, :width] = data.reshape(width, -1).T
    return wide.view(np.uint32).ravel().astype(np.int64)


def _unpacked(datas: list[pa.Buffer]) -> tuple[np.ndarray, ...]:
    """(key, code, size, place) of each key; repeated ones, which copies send from several tasks, once."""
    parts = []
    for data in datas:
        flat = np.frombuffer(data, np.uint8)
        rows, keys = (int(x) for x in flat[:16].view(np.uint64))
        at, own = 16, []
        for n, width in ((rows, 4), (rows, 4), (rows, 4), (keys, 3), (keys, 4)):
            own.append(_from_planes(flat[at : at + width * n], width))
            at += width * n
        names, sizes, number, values, place = own
        parts.append((values, np.repeat(names, number), np.repeat(sizes, number), place))
    key, name, n, place = (np.concatenate(x) for x in zip(*parts)) if parts else [np.empty(0, np.int64)] * 4
    order = np.lexsort((place, name, n, key))
    key, name, n, place = key[order], name[order], n[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (n[1:] != n[:-1]) | (place[1:] != place[:-1])
    return key[new], name[new], n[new], place[new]


#: Bits of a packed place that tell the side of a split list, and its values: any, left, right.
_SIDE = 30


def _shares(level: np.ndarray, hot: int) -> np.ndarray:
    """Into how many shares each key's list is split."""
    return np.maximum(1, np.ceil(count_at(level) / hot)).astype(np.int64)


def _share_key(values: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The key of one share of a list."""
    return mix(values ^ mix(share.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - HASH_BITS)


def _repeat(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, turn): every index as often as told, counted from 0."""
    at = np.repeat(np.arange(len(number)), number)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)


_PAIRS_AT_ONCE = 1 << 20


class _Pairs:
    """Pairs of codes, counted; ``least`` is the smallest number of meetings that makes a pair a candidate."""

    def __init__(self) -> None:
        self.held, self.out, self.number = [], [], 0

    def add(self, x: np.ndarray, y: np.ndarray, least: np.ndarray) -> None:
        if len(x):
            self.held.append(((x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64), least))
            self.number += len(x)
        if self.number > _PAIRS_AT_ONCE:
            self._fold()

    def _fold(self) -> None:
        if not self.held:
            return
        pairs, least = (np.concatenate(x) for x in zip(*self.held))
        order = np.argsort(pairs, kind="stable")
        pairs, least = pairs[order], least[order]
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        self.out.append((pairs[first].view(np.int64), np.diff(np.append(first, len(pairs))).astype(np.int32), np.minimum.reduceat(least, first).astype(np.int32)))
        self.held, self.number = [], 0

    def table(self) -> pa.Table:
        self._fold()
        pairs, number, least = (np.concatenate(x) for x in zip(*self.out)) if self.out else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32))
        return pa.table({"pair": pairs, "c": number, "agree": least})


_PAIR_SCHEMA = "pair bigint, c int, agree int"


def _ranges(number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, turn) as :func:`_repeat`, some ``_PAIRS_AT_ONCE`` at a time; a longer range is cut."""
    ends, at, done, total = np.cumsum(number), 0, 0, int(number.sum())
    while done < total:
        to = min(total, done + _PAIRS_AT_ONCE)
        flat = np.arange(done, to)
        index = np.searchsorted(ends, flat, "right")
        yield index, flat - (ends[index] - number[index])
        done = to


def _candidates(met: DataFrame, profile: Profile) -> DataFrame:
    """(p, q): all classes of the codes of pairs that meet often enough."""
    met = met.groupBy("pair").agg(F.sum("c").alias("c"), F.min("agree").alias("agree")).filter("c >= agree")
    met = met.select(F.shiftrightunsigned("pair", 32).alias("x"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("y"))
    names = profile.members.select("class", code(F.col("class")).alias("code")).distinct()
    return met.join(names.select(F.col("class").alias("p"), F.col("code").alias("x")), "x").join(names.select(F.col("class").alias("q"), F.col("code").alias("y")), "y").select("p", "q")


# -- across splits ---------------------------------------------------------------------------------------------------


_LOW = np.uint64(0xFFFFFFFF)
#: log2 of the bits that stand for the shingles of a training set where the members of groups are looked up.
_FIELD = 13
_IN_FIELD = np.uint32((1 << _FIELD) - 1)
#: An entry of the index: number of the evaluation set, the leader's low bits, two members' places in the field.
_LEAD_AT, _LEAD_BITS = 2 * _FIELD, 12
_SET_AT = _LEAD_AT + _LEAD_BITS
_IN_LEAD = np.uint64((1 << _LEAD_BITS) - 1)
#: Training sets, and meetings of theirs, that are counted at once; a single set has at most one with each group.
_SETS_AT_ONCE = 256
_MEETINGS_AT_ONCE = 1 << 20


def _group_numbers(sizes: np.ndarray, o: Overlap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles that must be shared, groups, groups that must be held whole) of evaluation sets of such sizes."""
    need = -(-o.containment[0] * sizes // o.containment[1])
    whole = np.minimum(o.agree, need)
    return need, sizes - need + whole, whole


def _groups(s: Sets, level: np.ndarray, o: Overlap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leader, two other members, set) of each group: the rarest shingles lead, and the next ones are dealt out, the rarest to the most common leader.

    A leader is the low 32 bits of a hash, a member its place in a field; a leader stands in for a member that isn't there.
    """
    groups = _group_numbers(s.sizes, o)[1]
    values, place = s.ranked(level)
    low = (values & _LOW).astype(np.uint32)
    at = np.flatnonzero(place < groups[s.owner])
    owner = s.owner[at]
    number, members = groups[owner], []
    for turn in (2, 3):
        rank = turn * number - 1 - place[at]
        members.append(low[np.where(rank < s.sizes[owner], s.offsets[owner] + rank, at)] & _IN_FIELD)
    return low[at], members[0] | (members[1] << np.uint32(_FIELD)), owner


def _index(table: pa.Table, o: Overlap) -> pa.Table:
    """(share, part, data): the groups of one share's sets, ordered by leader, and where the leaders of each slot begin.  A set that several tasks sent counts once."""
    names, sizes, leads, members = (np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(c).combine_chunks()]) for c, kind in (("names", np.int64), ("sizes", np.int64), ("leads", np.uint32), ("members", np.uint32)))
    first = np.zeros(len(names), bool)
    first[np.unique(names, return_index=True)[1]] = True
    if not first.all():
        kept = np.repeat(first, _group_numbers(sizes, o)[1])
        names, sizes, leads, members = names[first], sizes[first], leads[kept], members[kept]
    need, groups, whole = _group_numbers(sizes, o)
    bits = min(28, max(1, round(np.log2(len(leads))) + 1))
    slots = np.zeros((1 << bits) + 1, np.int32)
    np.add.at(slots[1:], leads >> np.uint32(32 - bits), 1)
    np.cumsum(slots, out=slots)
    entries = np.repeat(np.arange(len(names), dtype=np.uint64) << np.uint64(_SET_AT), groups)
    entries |= members
    entries |= (leads & _IN_LEAD) << np.uint64(_LEAD_AT)
    entries = entries[np.argsort(leads, kind="stable")]
    del leads, members
    parts = {"slots": slots, "entries": entries, "names": names, "need": need, "whole": whole}
    ends = np.cumsum([0, *(x.nbytes for x in parts.values())]).astype(np.int32)
    data = pa.py_buffer(np.concatenate([x.view(np.uint8) for x in parts.values()]))
    return pa.table({"share": pa.array([table.column("share")[0].as_py()] * len(parts), pa.int32()), "part": list(parts), "data": pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends), data])})


_INDEX_TYPES = {"slots": np.int32, "entries": np.uint64, "names": np.int64, "need": np.int64, "whole": np.int64}


def _holding(index: dict[str, np.ndarray], low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of an evaluation set, training set) where the latter seems to hold enough groups whole; it may not, but no other does."""
    slots, entries, need, whole = (index[k] for k in ("slots", "entries", "need", "whole"))
    slot = low >> np.uint32(33 - len(slots).bit_length())
    first = slots[slot]
    number = slots[1:][slot] - first
    sizes = np.diff(offsets)
    begin = np.repeat(np.arange(len(sizes)) << _FIELD, sizes)
    met = np.concatenate(([0], np.cumsum(number, dtype=np.int64)))[offsets]
    found, row = [], 0
    while row < len(sizes):
        to = min(len(sizes), row + _SETS_AT_ONCE, max(row + 1, int(np.searchsorted(met, met[row] + _MEETINGS_AT_ONCE, "right")) - 1))
        lo, hi = offsets[row], offsets[to]
        field = np.zeros((to - row) << _FIELD, bool)
        own = begin[lo:hi] - (row << _FIELD)
        field[own | (low[lo:hi] & _IN_FIELD)] = True
        at = np.flatnonzero(number[lo:hi])
        n = number[lo:hi][at]
        i = np.repeat(at, n)
        entry = entries[np.repeat(first[lo:hi][at] - (np.cumsum(n) - n), n) + np.arange(len(i))]
        ok = np.flatnonzero((entry & (_IN_LEAD << np.uint64(_LEAD_AT))) == ((low[lo:hi] & _IN_LEAD) << np.uint64(_LEAD_AT))[i])
        entry, place = entry[ok].view(np.int64), own[i[ok]]
        for turn in (0, _FIELD):
            ok = np.flatnonzero(field[place | ((entry >> turn) & int(_IN_FIELD))])
            entry, place = entry[ok], place[ok]
        key, count = np.unique(((entry.view(np.uint64) >> np.uint64(_SET_AT)) << np.uint64(32)) | ((place >> _FIELD) + row).view(np.uint64), return_counts=True)
        a, b = (key >> np.uint64(32)).astype(np.int64), (key & _LOW).astype(np.int64)
        ok = (count >= whole[a]) & (sizes[b] >= need[a])
        found.append((a[ok], b[ok]))
        row = to
    a, b = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 2
    return a, b


def contained_classes(evaluation: DataFrame, training: DataFrame, everything: DataFrame, profile: Profile, o: Overlap) -> DataFrame:
    """(a, b): classes of evaluation and training sets such that at least ``o.containment`` of a's shingles are b's.

    A set of n shingles of which ``need`` must be shared is dealt into n - need + g groups, each led by one of its rarest: a
    training set that holds ``need`` of them misses n - need at most, so at least g groups are whole in it, whatever they are; those with fewer
    than ``need`` don't count.  No case is lost: rarity only decides which shingles lead.
    An index of the groups goes to the tasks, in shares of bounded size, small sets first, and training sets that are large enough for a share look up all their hashes in it.
    As a training set is whole there, its groups are counted in place: neither its hashes nor the pairs that meet are shuffled, only pairs with g groups are written.
    With several shares, training sets are written once, 4 bytes a shingle, and read for each share.
    """
    counts = _broadcast(everything, profile.counts)
    num, den = o.containment
    classes = profile.members.join(evaluation.select("id"), "id", "left_semi").select("class", "n").distinct()
    told = classes.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").toArrow()  # sizes that differ: less than the root of twice the shingles
    sizes, number = (told[c].to_numpy().astype(np.int64) for c in ("n", "c"))
    weight = number * _group_numbers(sizes, o)[1]
    before = np.cumsum(weight) - weight
    shares = max(1, -(-int(weight.sum()) // o.groups_at_once))
    per = -(-int(weight.sum()) // shares)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for s in _slices(batches, o.words):
            seen.keep(s)
            leads, members, owner = _groups(s, count_level(counts.value, s.values), o)
            size = np.searchsorted(sizes, s.sizes)
            part = (mix(s.classes.view(np.uint64)) >> np.uint64(32)).astype(np.float64) / 2**32
            share = np.minimum(shares - 1, (before[size] + part * weight[size]) // per).astype(np.int32)
            for k in np.unique(share):
                sets, own = share == k, share[owner] == k
                datas = [s.classes[sets], s.sizes[sets].astype(np.int64), leads[own], members[own]]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in datas)], ["share", "names", "sizes", "leads", "members"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for s in _slices(batches, o.words):
            seen.keep(s)
            data = pa.py_buffer((s.values & _LOW).astype(np.uint32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(s.sizes), [None, pa.py_buffer((s.offsets * 4).astype(np.int32).tobytes()), data])
            yield pa.RecordBatch.from_arrays([pa.array(s.classes), packed, pa.array(s.sizes.astype(np.int32))], ["class", "hashes", "n"])

    def look_up(index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, _ROWS_AT_ONCE):
                    batch = whole.slice(at, _ROWS_AT_ONCE)
                    column = batch.column(1)
                    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
                    low = np.frombuffer(column.buffers()[2], np.uint32, int(ends[-1] - ends[0]) // 4, int(ends[0]))
                    a, b = _holding(index.value, low, (ends - ends[0]) // 4)
                    yield pa.RecordBatch.from_arrays([pa.array(index.value["names"][a]), batch.column(0).take(pa.array(b))], ["a", "b"])

        return run

    sent = evaluation.mapInArrow(send, "share int, names binary, sizes binary, leads binary, members binary")
    index, index_path = write_table(sent.groupBy("share").applyInArrow(lambda table: _index(table, o), "share int, part string, data binary"), "groups")
    sets, sets_path = training.mapInArrow(hashes, "class bigint, hashes binary, n int"), None
    if shares > 1:
        sets, sets_path = write_table(sets, "training")

    def met_in(share: int) -> list[str]:
        parts = index.filter(F.col("share") == share).select("part", "data").toArrow()
        parts = {p: np.frombuffer(d.as_buffer(), _INDEX_TYPES[p]) for p, d in zip(parts["part"].to_pylist(), parts["data"])}
        if not parts:
            return []
        least, told = int(parts["need"].min()), _broadcast(everything, parts)
        del parts  # the driver holds it once more, as blocks
        path = write_table(sets.filter(F.col("n") >= least).mapInArrow(look_up(told), "a bigint, b bigint"), "met")[1]
        told.destroy()
        return [path]

    paths = [path for k in range(shares) for path in met_in(k)]
    for path in (index_path, sets_path):
        if path:
            drop_table(everything.sparkSession, path)
    reader = everything.sparkSession.read.schema("a bigint, b bigint")
    met = reader.parquet(*paths) if paths else everything.sparkSession.createDataFrame([], "a bigint, b bigint")
    return _verified(everything, profile, met.distinct(), o, lambda shared, x, y: shared * den >= num * x)


def cross_split(df: DataFrame, key: str, texts: Column | str, split: Column, same: Column | None = None, o: Overlap = Overlap(), training: str = "train", evaluation: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """(record_id_a, record_id_b), a < b: an evaluation and a training record of which the former's shingles are
    contained in the latter's, or whose ``same`` keys are equal and not null.

    Rows whose split is neither, or null, take no part; rows with a null key are left out; null texts have no
    shingles and a record without shingles is only found by ``same``.  A record given several times counts once.
    """
    base = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), (F.col(texts) if isinstance(texts, str) else texts).alias("texts"), split.alias("split"), (same if same is not None else F.lit(None).cast("string")).alias("same"))
    base = base.filter(F.col("split").isin(training, *evaluation))
    role = base.select("id", (F.col("split") == training).alias("trains"), "same").distinct()
    everything = base.select("id", "texts")
    profile = Profile(everything, o)
    pairs = contained_classes(base.filter(F.col("split") != training).select("id", "texts"), base.filter(F.col("split") == training).select("id", "texts"), everything, profile, o)
    member = profile.members.join(role.select("id", "trains").distinct(), "id").select("class", "id", "trains")
    by_text = (
        pairs.join(member.filter("not trains").select(F.col("class").alias("a"), F.col("id").alias("e")), "a")
        .join(member.filter("trains").select(F.col("class").alias("b"), F.col("id").alias("t")), "b")
        .select("e", "t")
    )
    named = role.filter("same is not null")
    by_key = named.filter("not trains").select("same", F.col("id").alias("e")).join(named.filter("trains").select("same", F.col("id").alias("t")), "same").select("e", "t")
    return by_text.union(by_key).filter("e <> t").select(F.least("e", "t").alias("record_id_a"), F.greatest("e", "t").alias("record_id_b")).distinct()


# -- near duplicates -------------------------------------------------------------------------------------------------


def near_classes(texts: DataFrame, profile: Profile, o: Overlap) -> DataFrame:
    """(a, b), a < b: different classes whose sets have a Jaccard similarity of at least ``o.jaccard``.

    One hash orders every set, rare shingles first, and its bottom-k sketch is retained.  As a set of n shingles shares at
    least ``need`` = n * ``o.jaccard`` with any such partner, k = n - need + g makes partners meet at least g times in the inverted lists of retained values,
    whatever is rare.  The union of two sketches bounds their similarity: at the k-th common value at most k - 1 are behind and no
    more can follow than either set has left.  A meeting that leaves too few for the limit does not count, and pairs with fewer than g
    that do are no candidates; this is the sketches' estimate of the similarity, taken as a bound, so that it loses no case.
    Candidates are compared by whole sets.  A hot list of m shares becomes m * (m + 1) / 2 lists, one for each two shares.
    """
    counts = _broadcast(texts, profile.counts)
    num, den = o.jaccard
    buckets = max(1, profile.total * (den - num) // den // o.keys_at_once)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, out = _Seen(), _Buckets(buckets)
        for s in _slices(batches, o.words):
            seen.keep(s)
            need = -(-num * s.sizes // den)
            values, place = s.ranked(count_level(counts.value, s.values))
            keep = place < (s.sizes - need + np.minimum(o.agree_near, need))[s.owner]
            values, place, owner = values[keep], place[keep], s.owner[keep]
            shares = _shares(count_level(counts.value, values), o.hot)
            at, other = _repeat(shares)
            values, place, owner, split = values[at], place[at], owner[at], shares[at] > 1
            own = (mix(s.classes.view(np.uint64))[owner] % shares[at].astype(np.uint64)).astype(np.int64)
            values[split] = _share_key(values[split], ((np.minimum(own, other) << 24) | np.maximum(own, other))[split])
            side = np.where(own == other, 0, np.where(own < other, 1, 2))
            yield from out.add(values, place | (side << _SIDE), s.classes[owner], s.sizes[owner])
        yield from out.flush()

    def meet(table: pa.Table) -> pa.Table:
        return _meetings([v.as_buffer() for v in table.column("data").combine_chunks()], o)

    met = _candidates(texts.mapInArrow(send, "bucket bigint, data binary").groupBy("bucket").applyInArrow(meet, _PAIR_SCHEMA), profile)
    met = met.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    return _verified(texts, profile, met, o, lambda shared, p, q: shared * (den + num) >= num * (p + q))


def _meetings(datas: list[pa.Buffer], o: Overlap) -> pa.Table:
    """(pair of codes, meetings that count, meetings needed) of the classes in one bucket's lists."""
    num, den = o.jaccard
    key, name, n, place = _unpacked(datas)
    side, place = place >> _SIDE, place & ((1 << _SIDE) - 1)
    agree = np.minimum(o.agree_near, -(-num * n // den))
    # partners follow in the list, which is sorted by size: none larger than the limit, or than this meeting's place, allows
    most = np.minimum(n * den // num, (agree - 1 + n - place) * (den + num) // num - n)
    at = (key << 31) | n
    number = np.maximum(0, np.searchsorted(at, (key << 31) | most, "right") - np.arange(len(key)) - 1)
    pairs = _Pairs()
    for i, turn in _ranges(number):
        j = i + 1 + turn
        least = np.minimum(agree[i], agree[j])
        ok = (least - 1 + np.minimum(n[i] - place[i], n[j] - place[j])) * (den + num) >= num * (n[i] + n[j])
        ok &= (side[i] == 0) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        pairs.add(np.minimum(name[i], name[j]), np.maximum(name[i], name[j]), least[ok])
    return pairs.table()


def near_duplicates(df: DataFrame, key: str, texts: Column | str, o: Overlap = Overlap()) -> tuple[Profile, DataFrame]:
    """The profile of ``df`` and the pairs of similar classes."""
    base = _texts(df, key, texts)
    profile = Profile(base, o)
    return profile, near_classes(base, profile, o)


def near_pairs(df: DataFrame, key: str, texts: Column | str, o: Overlap = Overlap()) -> DataFrame:
    """(record_id_a, record_id_b), a < b: all pairs of records with similar sets, copies included.

    Records without shingles and rows with a null key take no part; a record given several times counts once.
    """
    profile, pairs = near_duplicates(df, key, texts, o)
    member = profile.members.select("class", "id").distinct()
    crossed = pairs.join(member.select(F.col("class").alias("a"), F.col("id").alias("x")), "a").join(member.select(F.col("class").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    copies = member.select("class", F.col("id").alias("x")).join(member.select("class", F.col("id").alias("y")), "class").filter("x < y").select("x", "y")
    return crossed.union(copies).filter("x <> y").select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b")).distinct()


def near_groups(df: DataFrame, key: str, texts: Column | str, o: Overlap = Overlap()) -> DataFrame:
    """One row per record with shingles: record_id, group_id (smallest record of its group), class_id (smallest record with
    the same set), n_copies (records of its class) and n_links (other classes that are similar to its own)."""
    profile, pairs = near_duplicates(df, key, texts, o)
    pairs, _ = write_table(pairs, "pairs")
    member = profile.members.select("class", "id").distinct()
    classes = member.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
    degree = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).groupBy("class").agg(F.count("*").alias("n_links"))
    group = components(pairs).select(F.col("node").alias("class"), "component")
    told = classes.join(degree, "class", "left").join(group, "class", "left").withColumn("component", F.coalesce("component", "class"))
    first = told.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return member.join(told.join(first, "component"), "class").select(F.col("id").alias("record_id"), "group_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
