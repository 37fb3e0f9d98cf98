"""A trie of all conversations' turn prefixes, built family by family.

Conversations of one base id (a family) are rebuilt and made into a small trie by one task; only the families' nodes are
shuffled and merged. A node is named by the sum of 128-bit hashes of (place, turn) over its turns: sums of stretches add up, so a
conversation may be cut into stretches and no task holds a long one. Sums over subtrees need no walk over the merged trie: each
node belongs to its smallest member, so every family sums what its own members hold in its own small trie, and the
families' sums add up.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poseframe.llm.common import drop_stored, mix64, stored

#: Turns of a stretch: a task holds this many turns of each of a family's conversations at once.
STRETCH = 2048
FAMILY = 100
#: Most turns that a conversation may take over from its base.
MOST = 5
NODE = ["depth", "a", "b"]
_PACKS = "conv_id long, part int, seq int, n long, digests binary, points binary"
_SLICES = "family long, block long, conv_id long, place long, total long, digests binary, points binary, a long, b long"
_TRIES = "family long, block long, local int, parent int, depth long, a long, b long, n long, conv_id long, n_ends long, points long, ends string"
_ENDS = "depth long, a long, b long, ends_sha256 string"


def base_of(c: Column) -> Column:
    return c - c % FAMILY


def taken_over(c: Column) -> Column:
    """How many turns of the base replace a conversation's own first ones."""
    return F.crc32(c.cast("string").cast("binary")) % (MOST + 1)


def _packs(stretch: int):
    """Rows sorted by conversation become one row for each `stretch` turns of a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, conv, n, held = TaskContext.get().partitionId(), 0, None, 0, []
        out: list[tuple] = []

        def close():
            nonlocal seq, n, held
            if n:
                out.append((conv, part, seq, n, b"".join(d for d, _ in held), b"".join(p for _, p in held)))
                seq, n, held = seq + 1, 0, []

        for b in batches:
            ids = b.column(0).to_numpy()
            digests = b.column(1).cast(pa.binary(16))
            raw = memoryview(digests.buffers()[1])[16 * digests.offset :]
            points = b.column(2).to_numpy()
            cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                if ids[lo] != conv:
                    close()
                    conv = int(ids[lo])
                while lo < hi:
                    end = min(hi, lo + stretch - n)
                    held.append((bytes(raw[16 * lo : 16 * end]), points[lo:end].astype("<i8").tobytes()))
                    n, lo = n + end - lo, end
                    if n == stretch:
                        close()
            yield _batch(out, _PACKS)
            out = []
        close()
        yield _batch(out, _PACKS)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.strip().split() for f in schema.split(",")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def packed(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Own turns in order, up to `stretch` in a row: digests and code points, and `first`, the place of the row's first turn.

    Rows are dealt by ranges of their order, equal ones apart, so a conversation of any length is spread over tasks. Texts
    stay where they are: 16 bytes of a turn's SHA-256 stand for it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(name, 1, 32)).alias("digest"), F.length(text).cast("long").alias("points"), F.monotonically_increasing_id().alias("at")
    )
    rows = rows.repartitionByRange("conv_id", "turn", "digest", "at").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
    packs = stored(rows.select("conv_id", "digest", "points").mapInArrow(_packs(stretch), _PACKS), "trie-packs")
    one = Window.partitionBy("conv_id")
    along = one.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    slim = packs.select("conv_id", "part", "seq", "n").withColumns({"before": F.sum("n").over(along), "total": F.sum("n").over(one), "k": F.count("*").over(one)})
    split = slim.where("k > 1").select("conv_id", "part", "seq", "before", "total")
    out = packs.join(split, ["conv_id", "part", "seq"], "left")
    out = out.withColumns({"first": F.coalesce("before", F.lit(0)) + 1, "total": F.coalesce("total", "n")}).drop("before")
    out.stored_at = packs.stored_at
    return out


def _lanes(digests: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the hash of each turn at its place."""
    with np.errstate(over="ignore"):
        at = places * np.uint64(0x9E3779B97F4A7C15)
        return mix64(digests[:, 0] + at), mix64(digests[:, 1] ^ mix64(at + np.uint64(1)))


def _signed(x: np.uint64) -> int:
    return int(np.uint64(x).astype(np.int64))


def _rebuild(stretch: int):
    """Packs with their base's first turns (hd, hp) become slices of rebuilt conversations that don't cross a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                h = r["h"]
                head_d, head_p = r["hd"] or b"", r["hp"] or b""
                k = min(h, len(head_p) // 8)
                skip = max(0, min(r["n"], h + 1 - r["first"]))
                digests, points = r["digests"][16 * skip :], r["points"][8 * skip :]
                place = r["first"] + skip - h + k
                if r["first"] == 1:
                    digests, points, place = head_d[: 16 * k] + digests, head_p[: 8 * k] + points, 1
                total = k + max(0, r["total"] - h)
                n, lo = len(points) // 8, 0
                while lo < n or (r["first"] == 1 and total == lo == 0):
                    block = (place + lo - 1) // stretch
                    hi = min(n, (block + 1) * stretch - place + 1)
                    d = digests[16 * lo : 16 * hi]
                    x, y = _lanes(np.frombuffer(d, "<u8").reshape(-1, 2), np.arange(place + lo, place + hi, dtype=np.uint64))
                    out.append((r["family"], block, r["conv_id"], place + lo, total, d, points[8 * lo : 8 * hi], _signed(x.sum(dtype=np.uint64)), _signed(y.sum(dtype=np.uint64))))
                    lo = max(hi, lo + 1)
            yield _batch(out, _SLICES)

    return run


def _halves(c: str) -> dict[str, Column]:
    """Sums of 64-bit values modulo 2**64, as sums of their halves, which don't overflow."""
    return {f"{c}_hi": F.shiftright(c, 32), f"{c}_lo": F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))}


def slices(packs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The rebuilt conversations in slices, with the hash of all turns before each (as halves)."""
    five = packs.where((F.col("conv_id") % FAMILY == 0) & (F.col("first") <= MOST))
    left = (MOST + 1 - F.col("first")).cast("int")
    part = F.struct("first", F.substring(F.col("digests"), F.lit(1), 16 * left).alias("d"), F.substring(F.col("points"), F.lit(1), 8 * left).alias("p"))
    heads = five.groupBy(F.col("conv_id").alias("family")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined_up = lambda f: F.expr(f"aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.{f}))")
    heads = heads.select("family", joined_up("d").alias("hd"), joined_up("p").alias("hp"))
    own = packs.select(base_of(F.col("conv_id")).alias("family"), "conv_id", taken_over(F.col("conv_id")).alias("h"), "first", "total", "n", "digests", "points")
    rows = stored(own.join(heads, "family", "left").mapInArrow(_rebuild(stretch), _SLICES), "trie-slices")
    one = Window.partitionBy("conv_id")
    along = one.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    slim = rows.select("conv_id", "place", "a", "b").withColumns({**_halves("a"), **_halves("b"), "k": F.count("*").over(one)}).where("k > 1")
    sums = {c: F.sum(c).over(along) for c in ("a_hi", "a_lo", "b_hi", "b_lo")}
    starts = slim.select("conv_id", "place", *[c.alias(n) for n, c in sums.items()])
    out = rows.drop("a", "b").join(starts, ["conv_id", "place"], "left").fillna(0, list(sums))
    out.stored_at = rows.stored_at
    return out


def _family_trie(stretch: int):
    """The nodes of one family in one stretch, parents before children; with block > 0 also the nodes they hang from (n = 0)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        family, block = int(pdf["family"].iloc[0]), int(pdf["block"].iloc[0])
        pdf = pdf.sort_values(["conv_id", "place"])
        # all turns of the group at once; a conversation's row for the node it starts from comes before its own
        digests = np.frombuffer(b"".join(pdf["digests"]), "<u8").reshape(-1, 2)
        turns = np.frombuffer(b"".join(pdf["points"]), "<i8")
        size = pdf["points"].map(len).to_numpy() // 8
        ids, places, totals = (pdf[c].to_numpy() for c in ("conv_id", "place", "total"))
        heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        sizes = np.add.reduceat(size, heads)
        whose = np.repeat(np.arange(len(heads)), sizes + 1)
        starts = np.cumsum(sizes + 1) - sizes - 1
        nth = np.arange(len(whose)) - starts[whose]
        conv, depth = ids[heads][whose], places[heads][whose] - 1 + nth
        own = nth > 0
        points = np.zeros(len(whose), np.int64)
        points[own] = turns
        lanes = []
        for c, values in zip("ab", _lanes(digests, depth[own].astype(np.uint64)), strict=True):
            steps = np.zeros(len(whose), np.uint64)
            steps[own] = values
            sums = np.cumsum(steps, dtype=np.uint64)
            first = (pdf[f"{c}_hi"].to_numpy()[heads].astype(np.uint64) << np.uint64(32)) + pdf[f"{c}_lo"].to_numpy()[heads].astype(np.uint64)
            lanes.append((sums - sums[starts][whose] + first[whose]).view(np.int64))
        a, b = lanes
        end = depth == totals[heads][whose]
        above = np.r_[-1, np.arange(len(conv) - 1)]
        hung = depth == block * stretch
        order = np.lexsort((conv, b, a, depth))
        d, p, q = depth[order], a[order], b[order]
        new = np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        first = order[at]
        counts = np.diff(np.r_[at, len(order)])
        context = hung[first] & (block > 0)
        parent = np.where(hung[first], -1, node[above[first]])
        ends: dict[int, list[str]] = defaultdict(list)
        for i in order[end[order] & ~(hung[order] & (block > 0))]:
            ends[int(node[i])].append(str(conv[i]))
        k = range(len(first))
        return pd.DataFrame({
            "family": family, "block": block, "local": np.arange(len(first)), "parent": parent, "depth": depth[first], "a": a[first], "b": b[first], "n": np.where(context, 0, counts),
            "conv_id": conv[first], "n_ends": [len(ends.get(i, ())) for i in k], "points": points[first], "ends": [",".join(ends[i]) if i in ends else None for i in k],
        })

    return run


def family_tries(parts: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Per family and stretch its small trie; stored."""
    return stored(parts.groupBy("family", "block").applyInPandas(_family_trie(stretch), _TRIES), "trie-families")


def merged(tries: DataFrame) -> DataFrame:
    """Per node of the whole trie: n_convs, conv_id and n_ends, over the families that hold it; stored."""
    return stored(tries.where("n > 0").groupBy(*NODE).agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_ends").alias("n_ends")), "trie-nodes")


def _up(pdf: pd.DataFrame, further: dict | None = None) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A family's own share of each node's saved tokens, leaves and children; and the node of the stretch's start above each."""
    pdf = pdf.sort_values("local")
    mine = pdf["mine"].to_numpy(bool) & (pdf["n"].to_numpy() > 0)
    saved = np.where(mine, (pdf["n_convs"].to_numpy() - 1) * pdf["points"].to_numpy(), 0)
    leaves = (mine & (pdf["n_ends"].to_numpy() == pdf["n_convs"].to_numpy())).astype(np.int64)
    parent, depth = pdf["parent"].to_numpy(), pdf["depth"].to_numpy()
    if further:
        for i, key in enumerate(zip(pdf["a"], pdf["b"], depth, pdf["n"], strict=True)):
            if key[3] and key[:3] in further:
                s, f = further[key[:3]]
                saved[i] += s
                leaves[i] += f
    children = np.bincount(parent[mine & (parent >= 0)], minlength=len(pdf))
    cuts = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True])
    for lo, hi in zip(cuts[-2::-1], cuts[:0:-1], strict=True):  # one depth after another, the deepest first
        if parent[lo] >= 0:
            np.add.at(saved, parent[lo:hi], saved[lo:hi])
            np.add.at(leaves, parent[lo:hi], leaves[lo:hi])
    top = np.arange(len(pdf))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if parent[lo] >= 0:
            top[lo:hi] = top[parent[lo:hi]]
    return pdf, saved, leaves, children, top


_LINKS = "family long, block long, a long, b long, depth long, ua long, ub long, saved long, leaves long"


def _links(stretch: int):
    """What later stretches need of one: the sums below its starting nodes, and from which of them its last nodes hang."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, saved, leaves, _, top = _up(pdf)
        block = int(pdf["block"].iloc[0])
        depth, a, b = pdf["depth"].to_numpy(), pdf["a"].to_numpy(), pdf["b"].to_numpy()
        start, last = depth == block * stretch, depth == (block + 1) * stretch
        parts = []
        for rows, under in ((start, False), (last, True)):
            i = np.flatnonzero(rows)
            parts.append(pd.DataFrame({"a": a[i], "b": b[i], "depth": depth[i], "ua": a[top[i]], "ub": b[top[i]], "saved": 0 if under else saved[i].astype(np.int64), "leaves": -1 if under else leaves[i]}))
        return pd.concat(parts).assign(family=pdf["family"].iloc[0], block=block)[[f.split()[0] for f in _LINKS.split(", ")]]

    return run


def _chained(pdf: pd.DataFrame) -> pd.DataFrame:
    """The whole sums below each node at a border of stretches, from the last stretch back."""
    total: dict[tuple, list[int]] = {}
    out = []
    for block, rows in sorted(pdf.groupby("block"), key=lambda x: -x[0]):
        here = {(r.a, r.b): [r.saved, r.leaves] for r in rows.itertuples() if r.leaves >= 0}
        for r in rows.itertuples():
            if r.leaves < 0 and (r.a, r.b) in total:
                for k in range(2):
                    here[(r.ua, r.ub)][k] += total[(r.a, r.b)][k]
        total = here
        depth = {(r.a, r.b): r.depth for r in rows.itertuples() if r.leaves >= 0}
        out += [(pdf["family"].iloc[0], block - 1, a, b, depth[(a, b)], *s) for (a, b), s in here.items() if block > 0]
    return pd.DataFrame(out, columns=["family", "block", "a", "b", "depth", "saved", "leaves"])


def _shares(pdf: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
    if not len(pdf):
        return pd.DataFrame(columns=_SHARES.replace(" long", "").split(", "))
    further = {(r.a, r.b, r.depth): (r.saved, r.leaves) for r in later.itertuples()}
    pdf, saved, leaves, children, _ = _up(pdf, further)
    own = pdf["mine"].to_numpy(bool) & (pdf["n"].to_numpy() > 0)
    own_id = pdf["g_conv_id"].to_numpy()
    parent = pdf["parent"].to_numpy()
    held = pdf["n"].to_numpy() > 0
    up = pd.array(np.where(parent >= 0, own_id[parent], 0), "Int64")
    up[parent < 0] = pd.NA
    conv = pd.array(own_id, "Int64")
    conv[~own], up[~own] = pd.NA, pd.NA
    return pd.DataFrame({
        "depth": pdf["depth"].to_numpy(), "a": pdf["a"].to_numpy(), "b": pdf["b"].to_numpy(), "conv_id": conv, "parent_conv_id": up, "n_convs": np.where(own, pdf["n_convs"].to_numpy(), 0),
        "n_children": children, "n_leaves": np.where(held, leaves, 0), "saved_tokens": np.where(held, saved, 0),
    })


_SHARES = "depth long, a long, b long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node, over its families' lists as they come in order; only its state is held."""
    node, state = None, None
    for b in batches:
        out = []
        for depth, x, y, ends in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if (depth, x, y) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, x, y), hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield _batch(out, _ENDS)
    yield _batch([(*node, state.hexdigest())] if node is not None else [], _ENDS)


def prefix_trie(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns stand by turn, null first; ones of the same turn by the SHA-256 of their role and text, so equal rows count as often as
    they come. A null role or text is empty. Rows without a conv_id belong to no conversation. The base of a negative id is nearer
    to 0. Other columns are ignored. An empty table has no node, not even the root. Tasks hold a stretch of a family's
    conversations at most; what is held for a family as a whole is a row for each stretch.
    """
    packs = packed(conversations, stretch)
    parts = slices(packs, stretch)
    tries = family_tries(parts, stretch)
    nodes = merged(tries)
    known = tries.drop("conv_id", "n_ends", "ends").join(nodes.withColumnRenamed("conv_id", "g_conv_id"), NODE)
    known = stored(known.withColumn("mine", base_of(F.col("g_conv_id")) == F.col("family")), "trie-known")
    long = known.where("block > 0").select("family").distinct()
    links = known.join(long, "family", "left_semi").groupBy("family", "block").applyInPandas(_links(stretch), _LINKS)
    later = links.groupBy("family").applyInPandas(_chained, "family long, block long, a long, b long, depth long, saved long, leaves long")
    later = stored(later, "trie-later")
    shares = known.groupBy("family", "block").cogroup(later.groupBy("family", "block")).applyInPandas(_shares, _SHARES)
    sums = shares.groupBy(*NODE).agg(F.max("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    ends = tries.where("ends is not null").select(*NODE, "family", "ends").repartition(*NODE).sortWithinPartitions(*NODE, "family").select(*NODE, "ends").mapInArrow(_ends, _ENDS)
    none = hashlib.sha256(b"").hexdigest()
    out = sums.join(ends, NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    out = stored(out, "trie")
    drop_stored(packs, parts, tries, nodes, known, later)
    return out


#: CRC-32 bit by bit: a byte is mixed in, then eight bits are shifted out (0xEDB88320 is the public polynomial).
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(conv_id::VARCHAR, '')])),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END), 4294967295::BIGINT)"""
SQL = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', role, text))) AS i FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i, own) AS d, role, text FROM (
        SELECT h.conv_id, o.i, 0 AS own, role, text FROM h JOIN o ON o.conv_id = h.base AND o.i <= h.h
        UNION ALL SELECT h.conv_id, o.i, 1, role, text FROM h JOIN o ON o.conv_id = h.conv_id AND o.i > h.h)),
p AS (SELECT conv_id, d, length(text) AS len, string_agg(sha256(concat(length(role), ':', role, text)), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM h),
e AS (SELECT conv_id, d, len, md5(k) AS k, md5(CASE WHEN d > 0 THEN left(k, length(k) - 64) END) AS up, d = max(d) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(len) AS saved, count(*) FILTER (last) = count(*) AS leaf,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM e GROUP BY k, d),
s AS (SELECT e.k, sum(x.saved) AS saved, count(*) FILTER (x.leaf) AS leaves FROM e JOIN n v ON v.k = e.k JOIN (SELECT conv_id, d, saved, leaf FROM n) x ON x.conv_id = e.conv_id AND x.d >= e.d
      GROUP BY e.k),
c AS (SELECT up, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n LEFT JOIN n m ON m.k = n.up LEFT JOIN c ON c.up = n.k JOIN s ON s.k = n.k
"""
