"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti, Kaushik, VLDB 2006).

A document's features are the 64-bit hashes of its distinct shingles of five words. Two sets of sizes s and t with a
Jaccard similarity of 3/4 or more differ in at most k = (s + t) // 7 features. Sizes fall into bands that grow by a third;
a set takes part in its own band, and in the next ones if its partners reach into them. Each band cuts the feature domain
into groups and each group into parts (the two levels of PartEnum): the k differences leave some group with few of them,
so that one of the subsets of its parts that leave out as few is the same in both sets. A signature is the content of one
subset of one group; a set enumerates the subsets of as many groups as it takes for one to be unspoiled. Bands of few
differences have one group with more parts.

Features in very many documents (shared passages) make signatures that say little. Leaving features out can only lower
the difference of two sets, so those that are frequent within a part of the input are left out. Sets with too few groups
left, and sets that meet many unlike ones in a signature, are dense: they are joined among themselves by a prefix filter,
whose features are ordered by how many dense sets have them, the rarest first.

Documents with the same signature are candidates. Inside a signature only pairs across components are compared: first each
set with a few centers, other ones in each signature, then what is left once those are merged, so that a group of copies
never becomes all of its pairs. The full sets decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poseframe.llm.common import bucketed, components, drop_stored, mix64, pieces, release_shuffles, shingle_sets, stored

WIDTH = 5
#: Sets in one signature above which they are dense.
CROWD = 64
#: Up to so many differences one group of parts does; beyond, groups of PARTS of which APART may differ, and one of SPARE to spare.
ONE_GROUP, PARTS, APART, SPARE = 6, 3, 1, 8
#: Features in a signature at least.
LEAST = 1
#: A feature is frequent if this share of the documents of an Arrow batch, and HEAVY_LEAST of them, have it.
HEAVY_SHARE, HEAVY_LEAST = 0.001, 8
#: Frequent features that are left out at most: a bound for what goes to every task; leaving out fewer is as exact.
HEAVY_MOST = 200_000
SKETCH_BITS = (6, 20)
#: Words of 64 bits in which a set leaves the parity of its features' number by place: what two sets' bits differ in, their features do.
PARITY = [f"p{i}" for i in range(8)]
#: Centers that a set is compared with in each turn of merging; what is still apart then is compared in full.
TURNS = (1, 8)
#: Pairs of sets that a task looks at before it keeps each once.
PAIRS_AT_ONCE = 1 << 20
#: Bands by the largest set in them, up to sets of about 10**9 features.
TOPS = [1, 2, 3, 4, 5, 6, 8]
while TOPS[-1] < 2 * 10**9:
    TOPS.append(TOPS[-1] * 4 // 3)
NO_ID = -(2**63)
#: In the first feature that two similar sets share, by an order of all features, each still has enough of them to come.
FIRST_MET = "7 * (1 + least(n_a - place_a, n_b - place_b)) >= 3 * (n_a + n_b)"


def _scheme(band: int) -> tuple[int, int, int]:
    """(groups, parts of a group, parts that may differ) of a band: the two levels of PartEnum.

    k differences spoil at most k // (apart + 1) of the groups, by more than `apart` differences; one group more is needed.
    """
    k = 2 * TOPS[band] // 7
    if k <= ONE_GROUP:
        return 1, k + 2 if k else 1, k
    need = k // (APART + 1) + 1
    return need + need // SPARE, PARTS, APART


def signatures(sets: list[np.ndarray], heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of some sets of sorted distinct features: (set, signature) by set; a signature 0 marks a dense set."""
    size = np.array([len(u) for u in sets], np.int64)
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), size)
    if len(heavy):
        light = heavy[np.minimum(np.searchsorted(heavy, every), len(heavy) - 1)] != every
        every, owner = every[light], owner[light]
    mixed, most = mix64(every), size * 4 // 3
    own, last = np.searchsorted(TOPS, size), np.searchsorted(TOPS, most)
    whose, found = [], []
    for step in range(int((last - own).max(initial=-1)) + 1):
        band = own + step
        here = (size > 0) & (band <= last)
        for scheme in sorted({_scheme(x)[1:] for x in np.unique(band[here])}):
            of = np.flatnonzero(here & np.array([b < len(TOPS) and _scheme(b)[1:] == scheme for b in band]))
            allowed = (size[of] + np.minimum(most[of], np.array(TOPS)[band[of]])) // 7
            at, sig = _enumerated(of, band[of], allowed, every, mixed, owner, len(sets), *scheme)
            whose.append(at)
            found.append(sig)
    whose, found = np.concatenate([*whose, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.uint64)])
    order = np.argsort(whose, kind="stable")
    return whose[order], found[order]


def _enumerated(of: np.ndarray, band: np.ndarray, allowed: np.ndarray, every: np.ndarray, mixed: np.ndarray, owner: np.ndarray, n: int, parts: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of the sets `of`, one band each, by all choices of parts that leave out `apart` of each group.

    A group is good if each choice holds a feature. A set emits its groups up to the one with which enough of them are good;
    of two sets, that which stops first has an unspoiled good group, and the other one has come as far.
    """
    groups = np.array([_scheme(b)[0] for b in band], np.int64)
    base = np.cumsum(groups) - groups
    place = np.full(n, -1)
    place[of] = np.arange(len(of))
    mine = place[owner] >= 0
    at, v, m = place[owner[mine]], every[mine], mixed[mine]
    part = ((v >> np.uint64(32)) * (groups * parts).astype(np.uint64)[at]) >> np.uint64(32)
    cell = base[at] * parts + part.astype(np.int64)
    total = int(groups.sum())
    count = np.bincount(cell, minlength=total * parts).reshape(total, parts)
    sums = np.zeros(total * parts, np.uint64)
    if len(cell):
        heads = np.r_[0, np.flatnonzero(np.diff(cell)) + 1]
        sums[cell[heads]] = np.add.reduceat(m, heads)
    sums = sums.reshape(total, parts)
    row = np.repeat(np.arange(len(of)), groups)
    choices = [list(c) for c in combinations(range(parts), parts - apart)]
    held = np.stack([count[:, c].sum(axis=1) for c in choices])
    good = (held >= LEAST).all(axis=0)
    need = allowed // (apart + 1) + 1
    before = np.cumsum(good) - good
    before = before - before[base][row]
    emits = before < need[row]
    salt = (band[row].astype(np.uint64) << np.uint64(40)) + (np.arange(total) - base[row]).astype(np.uint64)
    whose, found = [], []
    for i, c in enumerate(choices):
        use = emits & (held[i] >= LEAST)
        whose.append(of[row[use]])
        found.append(mix64(sums[use][:, c].sum(axis=1) ^ mix64(salt[use] * np.uint64(64) + np.uint64(i))))
    goods = np.bincount(row, good, len(of))
    dense = of[goods < need]
    return np.concatenate([*whose, dense]), np.concatenate([*found, np.zeros(len(dense), np.uint64)])


def class_of(u: np.ndarray) -> int | None:
    """A 63-bit name for a set, the same for equal sets; none for the empty set."""
    return int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "big") >> 1 if len(u) else None


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _count_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, names, every = [], [], []
        for part in pieces(iter([b]), 1):
            for u in shingle_sets(part.column(1), WIDTH):
                sizes.append(len(u))
                names.append(class_of(u))
                every.append(u)
        least = max(HEAVY_LEAST, HEAVY_SHARE * len(sizes))
        heavy = np.zeros(0, np.uint64)
        if every:
            seen = np.concatenate(every)
            every.clear()
            seen.sort()
            step = int(np.ceil(least)) - 1
            heavy = np.unique(seen[step:][seen[step:] == seen[: len(seen) - step]])
        lists = [heavy] + [heavy[:0]] * (len(sizes) - 1) if sizes else []
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), _lists(lists)], ["id", "key", "n", "cls", "heavy"])


def _emit(heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of one task emit once
        for b in pieces(batches, 1):
            names, sets = [], []
            for u in shingle_sets(b.column(1), WIDTH):
                name = class_of(u)
                if name is not None and name not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(name)
                    names.append(name)
                    sets.append(u)
            whose, sigs = signatures(sets, heavy)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[whose]), pa.array(sigs.view(np.int64))], ["cls", "s"])

    return run


def _sketch(u: np.ndarray) -> bytes:
    """How many features lie in each of some ranges of the domain, 255 at most; a power of two of them, for 2 to 4 features each."""
    bits = min(max(len(u).bit_length() - 2, SKETCH_BITS[0]), SKETCH_BITS[1])
    return np.minimum(np.bincount((u >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _parity(u: np.ndarray) -> np.ndarray:
    bits = np.bincount((u & np.uint64(64 * len(PARITY) - 1)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 1):
        names, sketches, sets, parity = [], [], [], []
        for u in shingle_sets(b.column(1), WIDTH):
            names.append(class_of(u))
            sketches.append(_sketch(u))
            parity.append(_parity(u))
            sets.append(u)
        bits = np.array(parity, np.int64).reshape(-1, len(PARITY)).T
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(names, pa.int64()), pa.array(map(len, sets), pa.int64()), *map(pa.array, bits), pa.array(sketches, pa.binary()), _lists(sets)], ["want", "cls", "n", *PARITY, "sketch", "features"]
        )


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of one length as rows of `width` ranges; a range of the shorter kind is a run of ranges of the longer one."""
    x = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), width, -1)
    return np.minimum(x.sum(axis=2, dtype=np.int32), 255)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose counts by range differ by no more than similar sets may."""
    for b in batches:
        n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
        keep = 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
        x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
        kinds: dict[tuple[int, int], list[int]] = {}
        for i in np.flatnonzero(keep):
            kinds.setdefault((len(x[i]), len(y[i])), []).append(i)
        for both, rows in kinds.items():
            step = max(1, (1 << 21) // max(both))
            for lo in range(0, len(rows), step):
                at = rows[lo : lo + step]
                apart = np.abs(_folded([x[i] for i in at], min(both)) - _folded([y[i] for i in at], min(both))).sum(axis=1)
                keep[at] = apart <= (n[at] + m[at]) // 7
        yield b.select([0, 1]).filter(pa.array(keep))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of classes whose similarity is 3/4 or more; stored.

    The counts by range are compared first: a sum of differences above the allowed one rules a pair out for certain, and
    they are much shorter than the sets.
    """
    one = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible, "a long, b long")
    near = stored(near, "join-near")
    a = sets.select(F.col("cls").alias("a"), F.col("features").alias("fa"))
    b = sets.select(F.col("cls").alias("b"), F.col("features").alias("fb"))
    both = F.size(F.array_intersect("fa", "fb"))
    out = stored(near.join(a, "a").join(b, "b").where(both * 175 >= (F.size("fa") + F.size("fb")) * 75).select("a", "b"), "join-edges")
    drop_stored(near)
    release_shuffles(pairs.sparkSession)
    return out


def _with_comp(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return rows.withColumn("comp", F.col("cls"))
    return rows.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def _open(rows: DataFrame) -> DataFrame:
    """Rows (sig, cls, comp) of signatures whose documents aren't all in one component."""
    still = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("sig")
    return rows.join(still, "sig", "left_semi")


def _pairs_of_lists(turn: int | None):
    """Pairs (a, b) of different components in lists (sig, cls, comp): all, or with a turn each set and its list's center."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.list_value_length(b.column(1)).to_numpy()
            cls, comp = pc.list_flatten(b.column(1)).to_numpy(), pc.list_flatten(b.column(2)).to_numpy()
            names, which = np.unique(cls, return_inverse=True)
            start = np.cumsum(size) - size
            seed = b.column(0).to_numpy().view(np.uint64) + np.uint64(turn or 0)
            luck = mix64(cls.view(np.uint64) ^ mix64(np.repeat(seed, size)))
            found, held = [], 0
            for k in np.unique(size[size > 1]):
                one, two = np.triu_indices(k, 1) if turn is None else (np.arange(k), None)
                every, step = start[size == k], max(1, PAIRS_AT_ONCE // len(one))
                for lo in range(0, len(every), step):
                    at = every[lo : lo + step, None]
                    x = at + one
                    y = at + two if turn is None else np.broadcast_to(at + luck[x].argmin(axis=1)[:, None], x.shape)
                    x, y = x[comp[x] != comp[y]], y[comp[x] != comp[y]]
                    if turn is None:
                        x, y = np.where(which[x] < which[y], x, y), np.where(which[x] < which[y], y, x)
                    found.append(np.unique(which[x] * len(names) + which[y]))
                    held += len(found[-1])
                    if held > PAIRS_AT_ONCE:
                        yield _named(found, names)
                        found, held = [], 0
            yield _named(found, names)

    return run


def _named(found: list[np.ndarray], names: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
    return pa.RecordBatch.from_arrays([pa.array(names[both // max(len(names), 1)]), pa.array(names[both % max(len(names), 1)])], ["a", "b"])


def pairs_in_lists(rows: DataFrame, turn: int | None = None) -> DataFrame:
    """Distinct pairs (a, b) of different components in signatures of rows (sig, cls, comp) of few sets each; stored.

    All pairs with a < b, or with a turn only those of a set a and the center b that its signature has in this turn. Lists of
    the same sets lie next to each other, so that tasks return a pair a few times and not for each signature.
    """
    lists = rows.groupBy("sig").agg(F.collect_list(F.struct("cls", "comp")).alias("sets"))
    lists = stored(lists.select("sig", F.array_min("sets.cls").alias("low"), F.col("sets.cls").alias("cls"), F.col("sets.comp").alias("comp")), "join-lists")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = lists.repartitionByRange(parts, "low", "sig").sortWithinPartitions("low").select("sig", "cls", "comp")
    out = stored(near.mapInArrow(_pairs_of_lists(turn), "a long, b long").distinct(), "join-met")
    drop_stored(lists)
    return out


class _Links:
    """Links found so far between classes, the pairs that were compared, and the components."""

    def __init__(self, sets: DataFrame):
        self.sets, self.comp, self.edges, self.tested = sets, None, [], []

    def compare(self, pairs: DataFrame) -> bool:
        """Compare pairs (a, b) that weren't compared yet, and merge those that link; whether any did."""
        new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for t in self.tested:
            new = new.join(t, ["a", "b"], "left_anti")
        new = stored(new, "join-pairs")
        self.tested.append(new)
        found = _linked(new, self.sets)
        if found.isEmpty():
            drop_stored(found)
            return False
        self.edges.append(found)
        every = self.edges[0]
        for e in self.edges[1:]:
            every = every.union(e)
        if self.comp is not None:
            drop_stored(self.comp)
        self.comp = components(every)
        return True

    def opened(self, rows: DataFrame) -> DataFrame:
        """Rows (sig, cls, more) with comp, of signatures whose sets aren't all in one component; stored."""
        return stored(_open(_with_comp(rows, self.comp)), "join-open")

    def stars(self, rows: DataFrame) -> DataFrame:
        """Merge sets of the signatures of rows (sig, cls, place) by comparing each with some centers; opened() of what is left.

        A signature has a center of its own by hash, so a set that meets many others is compared with different ones.
        """
        left = self.opened(rows)
        for turn, most in enumerate(TURNS):
            luck = F.xxhash64(F.lit(turn), "sig", "cls")
            placed = left.where("place is not null")
            centers = placed.groupBy("sig").agg(F.min_by(F.struct("cls", "comp"), luck).alias("c")).select("sig", F.col("c.cls").alias("b"), F.col("c.comp").alias("c_comp"))
            listed = pairs_in_lists(left.where("place is null"), turn)
            met = listed.union(placed.join(centers, "sig").where("comp != c_comp").select(F.col("cls").alias("a"), "b")).distinct()
            ranked = met.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64(F.lit(turn), "a", "b"), "b")))
            if self.compare(ranked.where(F.col("k") <= most).select("a", "b")):
                now = self.opened(left.drop("comp"))
                drop_stored(left)
                left = now
            drop_stored(listed)
        return left

    def across(self, rows: DataFrame) -> None:
        """Compare pairs of different components in the signatures of rows (sig, cls, comp, place): all that can be similar.

        Sizes and parities rule most unlike pairs out where they meet, and features their places in the common order. A
        signature without places has CROWD sets at most; its pairs are taken from lists, so that sizes and parities are looked
        up for a pair and not for each of the many signatures that long texts share.
        """
        known = self.sets.select("cls", "n", *PARITY)
        sides = [known.withColumnsRenamed({"cls": x, **{c: f"{c}_{x}" for c in known.columns[1:]}}) for x in "ab"]
        apart = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITY[1:]), F.bit_count(F.col(f"{PARITY[0]}_a").bitwiseXOR(F.col(f"{PARITY[0]}_b"))))
        alike = F.expr("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)") & (apart * 7 <= F.col("n_a") + F.col("n_b"))
        listed = pairs_in_lists(rows.where("place is null"))
        met = listed.join(sides[0], "a").join(sides[1], "b").where(alike).select("a", "b")
        placed = rows.where("place is not null").join(known, "cls")
        left, right = (placed.withColumnsRenamed({"cls": x, **{c: f"{c}_{x}" for c in placed.columns if c not in ("sig", "cls")}}) for x in "ab")
        first = left.join(right, "sig").where("a < b and comp_a != comp_b").where(alike).where(FIRST_MET)
        self.compare(met.union(first.select("a", "b")))
        drop_stored(listed)

    def drop(self) -> None:
        drop_stored(*self.edges, *self.tested)


def rare_first(dense: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (sig, cls, place): for each dense class the features in which it must meet a similar one; stored.

    Of s features, s - ceil(3 s / 4) + 1 in an order that all sets share hold one of any partner's.
    """
    feats = sets.join(dense, "cls", "left_semi").select("cls", "n", F.explode("features").alias("sig"))
    seen = feats.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    # features of one set alone come first in the order: only their number matters
    shared = feats.join(seen, "sig").withColumn("after", F.row_number().over(Window.partitionBy("cls").orderBy("df", "sig")))
    shared = shared.withColumn("place", F.col("after") + F.col("n") - F.count("*").over(Window.partitionBy("cls")))
    return stored(shared.where("place <= n - ceil(3 * n / 4) + 1").select("sig", "cls", "place"), "join-rare")


def _covering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lists (sig, cls), the longest first, those that hold some pair that none before them in the batch does."""
    for b in batches:
        size, cls = pc.list_value_length(b.column(1)).to_numpy(), pc.list_flatten(b.column(1)).to_numpy()
        names, which = np.unique(cls, return_inverse=True)
        start, order = np.cumsum(size) - size, np.argsort(-size, kind="stable")
        ends = np.cumsum((size * (size - 1) // 2)[order], dtype=np.int64)
        keep, seen, lo = np.zeros(len(size), bool), np.zeros(0, np.int64), 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
            pairs, whose = [], []
            for k in np.unique(size[order[lo:hi]])[::-1]:
                at = order[lo:hi][size[order[lo:hi]] == k]
                one, two = np.triu_indices(k, 1)
                pairs.append((which[start[at, None] + one] * len(names) + which[start[at, None] + two]).ravel())
                whose.append(np.repeat(at, len(one)))
            found, first = np.unique(np.concatenate(pairs), return_index=True)
            keep[np.concatenate(whose)[first[~np.isin(found, seen, assume_unique=True)]]] = True
            # forgetting only keeps more lists
            seen, lo = np.union1d(seen, found) if len(seen) <= 4 * PAIRS_AT_ONCE else found, hi
        yield b.filter(pa.array(keep))


def cover_of_lists(lists: DataFrame) -> DataFrame:
    """Some of lists (sig, cls), cls sorted, that hold every pair that all of them hold; stored.

    Long near copies share thousands of signatures, each by other ones of them. Lists with the same smallest set lie next to
    each other, then those with the same largest one, and lists whose pairs others hold too are left out.
    """
    for end in (1, -1):
        near = lists.withColumn("end", F.element_at("cls", end)).repartitionByRange("end", "sig").sortWithinPartitions("end")
        left = stored(near.select("sig", "cls").mapInArrow(_covering, "sig long, cls array<long>"), "join-cover")
        drop_stored(lists)
        lists = left
    return lists


def _lists_of_few(rows: DataFrame) -> DataFrame:
    """Rows (sig, cls) as lists, without signatures of over CROWD sets; lists of the same sets once, by the smallest signature; stored."""
    nth = F.row_number().over(Window.partitionBy("sig").orderBy("cls"))
    lists = rows.withColumn("nth", nth).where(F.col("nth") <= CROWD + 1).groupBy("sig").agg(F.sort_array(F.collect_list("cls")).alias("cls"))
    return stored(lists.where(F.size("cls") <= CROWD).groupBy("cls").agg(F.min("sig").alias("sig")).select("sig", "cls"), "join-once")


def link_classes(shared: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Components (node, comp) of the classes in shared (sig, cls, dense); None if nothing links."""
    links = _Links(sets)
    real = shared.where("not dense").select("sig", "cls")
    crowded = stored(real.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("sig"), "join-crowded")
    dense = stored(shared.where("dense").select("cls").union(real.join(crowded, "sig", "left_semi").select("cls")).distinct(), "join-dense")
    rare = rare_first(dense, sets)
    cover = cover_of_lists(_lists_of_few(real))
    rows = cover.select("sig", F.explode("cls").alias("cls"), F.lit(None).cast("long").alias("place")).union(rare.select("sig", "cls", F.col("place").cast("long")))
    left = links.stars(rows)
    links.across(left)
    drop_stored(cover, crowded, dense, rare, left)
    links.drop()
    return links.comp


def _classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, key, n, cls, comp), one for each document: NO_ID for a null id, a hash of the text, the set's size, class and component."""
    spark = docs.sparkSession
    src = docs.select(_id_of(F.col(doc_id)).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    counted = stored(src.mapInArrow(_count_sets, "id long, key long, n long, cls long, heavy array<long>"), "join-docs")
    heavy = counted.select(F.explode("heavy").alias("h")).groupBy("h").count().orderBy(F.desc("count"), "h").limit(HEAVY_MOST).select("h").toArrow()
    heavy = np.sort(heavy.column(0).to_numpy().astype(np.int64).view(np.uint64))
    names = counted.select("id", "key", "n", "cls")

    src = src.select("id", "text")
    sigs = src.mapInArrow(_emit(heavy), "cls long, s long")
    # a mark of a dense set is a row of its own
    sigs = sigs.select("cls", (F.col("s") == 0).alias("dense"), F.when(F.col("s") == 0, F.xxhash64("cls")).otherwise(F.col("s")).alias("sig"))
    w = Window.partitionBy("sig").orderBy("cls")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = sigs.select("sig", "cls", "dense", F.lag("cls").over(w).alias("prev"), F.first("cls").over(every).alias("least"), F.last("cls").over(every).alias("most"))
    shared = seen.where("(dense or least != most) and (prev is null or prev != cls)").select("sig", "cls", "dense")
    shared = stored(shared, "join-shared")
    release_shuffles(spark)

    wanted = names.join(shared.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id"))
    texts = src.join(wanted, "id").select(F.col("cls").alias("want"), "text").repartition("want")
    parity = ", ".join(f"{p} long" for p in PARITY)
    sets = texts.mapInArrow(_full_sets, f"want long, cls long, n long, {parity}, sketch binary, features array<long>").where("want = cls").drop("want")
    sets = bucketed(sets.dropDuplicates(["cls"]) if _repeats(names) else sets, "cls", "join_sets")
    release_shuffles(spark)

    comp = link_classes(shared, sets)
    drop_stored(shared, sets)
    return _with_comp(names, comp)


def _id_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (equal sets share it), component_id.

    Words are split at white space with A-Z lower-cased. Fewer than five words count as one shingle; a null or blank
    text has none, no class and no link, and is its own component. Documents whose sets have a similarity of 3/4 or more
    are linked; component_id is the smallest doc_id that links reach. Rows that repeat a doc_id are rows of their own; a
    null doc_id stays null and never names a component unless all of its documents lack one. Other columns are ignored,
    and an empty table gives an empty result.
    """
    named = _classes(docs, doc_id, text)
    least = named.where("cls is not null").groupBy("comp").agg(F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("component_id"))
    own: Column = F.when(F.col("id") != NO_ID, F.col("id"))
    return named.join(least, "comp", "left").select(
        own.alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("cls").alias("class_id"),
        F.when(F.col("cls").isNull(), own).otherwise(F.col("component_id")).alias("component_id"),
    )


def _repeats(names: DataFrame) -> bool:
    """Whether some doc_id stands for more than one row."""
    return not names.groupBy("id").count().where("count > 1").isEmpty()


def near_duplicates_removed(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id (null last), then by a hash of the text.

    Rows are told apart by doc_id and text, so two texts under one doc_id are judged one by one; of rows that repeat both,
    one stays. Documents without words stay, repeated ones too.
    """
    found = stored(_classes(docs).where("cls is not null").select("id", "key", "comp"), "join-found")
    order = F.struct((F.col("id") == NO_ID).alias("none"), "id", "key")
    best = found.groupBy("comp").agg(F.min(order).alias("best"))
    goes = found.join(best, "comp").where("id != best.id or key != best.key").select(F.col("id").alias("g_id"), F.col("key").alias("g_key")).distinct()
    twice = stored(found.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("g_id"), F.col("key").alias("g_key")), "join-twice")
    at = lambda rows: (_id_of(docs["doc_id"]) == rows["g_id"]) & (F.xxhash64(docs["text"]) == rows["g_key"])
    kept = docs.join(goes, at(goes), "left_anti")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, at(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, at(twice), "left_anti").unionByName(once)
