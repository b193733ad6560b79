"""Sharding by k-d tree partitioning (operator 4).

A document is a point of metadata. A node of the tree is split along its
widest dimension at the weighted median of the order (dimension, hash of the
text, hash of the id). A cut that would pass through a group of equal texts
moves to an end of the group if that is near (SNAP); a group too heavy for that
is split. Medians are found by distributed histograms: a pass sums
bytes by (node, one of WIDTH intervals) for every node of a level at once,
then narrows the interval that holds the median, until it is light enough or
holds so few rows that their keys settle the cut. The driver holds the splits
and, per open node, WIDTH sums or FETCH keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WIDTH = 1024
#: A cut may miss the median by this share of a shard.
SLACK = 0.0005
#: A cut moves by up to this share of a shard to an end of a group of equal texts.
SNAP = 0.02
FETCH = 2000
#: Rows ordered in one task when slots are numbered.
SLOT_ROWS = 100_000
KEYS = ("h", "k")  # after the dimension: text hash, id hash


@dataclass
class Node:
    shards: int
    first: int
    bound: list[int] | None = None  # exclusive, a prefix of (dimension, h, k)
    # of the search
    dim: str = ""
    prefix: list[int] = field(default_factory=list)
    lo: int = 0
    hi: int = 0
    before: float = 0.0
    goal: float = 0.0

    @property
    def step(self) -> int:
        return (self.hi - self.lo) // WIDTH + 1


def _per_leaf(values: list) -> Column:
    """A figure of the row's node; rows whose leaf is negative are settled."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.greatest(F.col("leaf"), F.lit(0)) + 1)


def kd_tree(points: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """points(*dims, h, k, size), longs, h and k not negative, with the shard
    of every row. Each level writes the rows' node again, 8 bytes a key."""
    open_ = [Node(shards, 0)] if shards > 1 else []
    points = points.withColumns({"leaf": F.lit(0 if open_ else -1), "shard": F.lit(0)})
    spread: dict[str, float] = {}
    while open_:
        bounds = [f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max)]
        seen = {r["leaf"]: r for r in points.where("leaf >= 0").groupBy("leaf").agg(F.sum("size").alias("bytes"), *bounds).collect()}
        shard = sum(r["bytes"] for r in seen.values()) / sum(n.shards for n in open_)
        for i, n in enumerate(open_):
            r = seen.get(i)
            span = {d: (r[f"{d}_max"] - r[f"{d}_min"]) if r else 0 for d in dims}
            spread = spread or {d: max(1, span[d]) for d in dims}
            n.dim = max(dims, key=lambda d: (span[d] / spread[d], -dims.index(d)))
            n.lo, n.hi = (r[f"{n.dim}_min"], r[f"{n.dim}_max"]) if r else (0, 0)
            n.goal = (r["bytes"] if r else 0) * (n.shards // 2) / n.shards
        dim = F.element_at(F.array(*dims), _per_leaf([dims.index(n.dim) + 1 for n in open_]).cast("int"))
        keyed = points.withColumn("dim", dim)
        while any(n.bound is None for n in open_):
            _narrow(keyed.where("leaf >= 0"), open_, SLACK * shard, SNAP * shard)
        b0, b1, b2 = (_per_leaf([[*n.bound, 0, 0][j] for n in open_]) for j in range(3))
        left = (F.col("dim") < b0) | ((F.col("dim") == b0) & ((F.col("h") < b1) | ((F.col("h") == b1) & (F.col("k") < b2))))
        children = [(Node(n.shards // 2, n.first), Node(n.shards - n.shards // 2, n.first + n.shards // 2)) for n in open_]
        below = [c for pair in children for c in pair if c.shards > 1]
        at = {id(c): i for i, c in enumerate(below)}
        moved = F.when(left, _per_leaf([at.get(id(a), -1) for a, _ in children])).otherwise(_per_leaf([at.get(id(b), -1) for _, b in children]))
        first = F.when(left, _per_leaf([a.first for a, _ in children])).otherwise(_per_leaf([b.first for _, b in children]))
        settled = F.col("leaf") < 0
        points = materialize(keyed.withColumns({"shard": F.when(settled, F.col("shard")).otherwise(first).cast("int"), "leaf": F.when(settled, F.lit(-1)).otherwise(moved).cast("int")}).drop("dim"), "level")
        open_ = below
    return points


def _narrow(rows: DataFrame, open_: list[Node], allowed: float, snap: float) -> None:
    """One pass of the search for the nodes' cuts. A cut may miss its goal by
    `allowed`, and by `snap` if that keeps equal texts together."""
    stage = _per_leaf([len(n.prefix) for n in open_])
    value = F.when(stage == 0, F.col("dim")).when(stage == 1, F.col("h")).otherwise(F.col("k"))
    p0, p1 = (_per_leaf([n.prefix[j] if len(n.prefix) > j else 0 for n in open_]) for j in (0, 1))
    lo, hi, step = _per_leaf([n.lo for n in open_]), _per_leaf([-1 if n.bound is not None else n.hi for n in open_]), _per_leaf([n.step for n in open_])
    searched = rows.withColumns({"at": value, "lo": lo, "hi": hi, "step": step}).where((F.col("at").between(F.col("lo"), F.col("hi"))) & ((stage < 1) | (F.col("dim") == p0)) & ((stage < 2) | (F.col("h") == p1)))
    sums: dict[int, list] = {}
    for r in searched.groupBy("leaf", F.expr("(at - lo) div step").alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
        sums.setdefault(r["leaf"], []).append((r["bin"], r["bytes"], r["rows"]))
    few = {}
    for i, n in enumerate(open_):
        if n.bound is not None:
            continue
        total, b, bytes_, count = n.before, WIDTH, 0, 0
        for b, bytes_, count in sorted(sums.get(i, [])):
            if total + bytes_ >= n.goal:
                break
            total += bytes_
        else:
            bytes_ = count = 0
        n.before = total
        lo_, hi_ = n.lo + b * n.step, min(n.hi, n.lo + (b + 1) * n.step - 1)
        alike = n.step == 1 and len(n.prefix) == len(KEYS)
        if bytes_ <= allowed or alike and count > FETCH:  # cut at the nearer end
            n.bound = [*n.prefix, lo_ if n.goal - total <= total + bytes_ - n.goal else hi_ + 1]
        elif n.step == 1 and len(n.prefix) == 1 and min(n.goal - total, total + bytes_ - n.goal) <= snap:  # one text: all of it to the nearer side
            n.bound = [*n.prefix, lo_ if n.goal - total <= total + bytes_ - n.goal else hi_ + 1]
        elif count <= FETCH:
            few[i] = (lo_, hi_)
        elif n.step == 1:  # one value is too heavy: go on within it
            n.prefix, n.lo, n.hi = [*n.prefix, lo_], 0, (1 << 62) - 1
        else:
            n.lo, n.hi = lo_, hi_
    if not few:
        return
    from_, to = (_per_leaf([few.get(i, (1, 0))[j] for i in range(len(open_))]) for j in (0, 1))
    found: dict[int, list] = {}
    for r in searched.where(F.col("at").between(from_, to)).select("leaf", F.array("dim", *KEYS).alias("keys"), "size").collect():
        found.setdefault(r["leaf"], []).append((r["keys"], r["size"]))
    for i in few:
        n, total = open_[i], open_[i].before
        ordered = sorted(found[i])
        upto = [total, *(total := total + bytes_ for _, bytes_ in ordered)]
        whole = [j for j in range(len(ordered) + 1) if j in (0, len(ordered)) or ordered[j][0][:2] != ordered[j - 1][0][:2]]
        if len(n.prefix) == len(KEYS) - 1:  # within one text, whose ends were too far
            whole = []
        after = min(whole or range(len(upto)), key=lambda j: abs(upto[j] - n.goal))
        if abs(upto[after] - n.goal) > snap:
            after = min(range(len(upto)), key=lambda j: abs(upto[j] - n.goal))
        n.bound = ordered[after][0] if after < len(ordered) else [*ordered[-1][0][:2], ordered[-1][0][2] + 1]


def kd_shards(docs: DataFrame, shards: int = 16, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row.

    size is the text's UTF-8 bytes plus 1 (null text: 1), the law is `bytes`:
    leaves hold near-equal sizes. With target_bytes the number of leaves is
    the total over it, rounded up. Dimensions are size and language (null
    language: before all others; equal texts of two languages are two groups), ties go by text, then by id. Identical rows
    may share a cut's side. slot counts a shard's rows from 0 without gaps,
    in no meaningful order. An empty table gives no rows; other columns are
    ignored.
    """
    text = F.col(text_col).cast("string")
    lang = F.rpad(F.substring(F.encode(F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "utf-8"), 1, 6), 6, F.lit(b"\x00"))
    points = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.encode(F.coalesce(text, F.lit("")), "utf-8")).alias("text_crc32"),
            F.conv(F.hex(lang), 16, 10).cast("long").alias("lang"),
            F.shiftrightunsigned(F.xxhash64(text), 2).alias("h"),
            F.shiftrightunsigned(F.xxhash64(F.col(id_col), text), 2).alias("k"),
        ),
        "points",
    )
    total, rows = points.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    parts = max(1, rows // max(1, shards) // SLOT_ROWS)
    placed = kd_tree(points.withColumn("log_size", F.floor(F.log2("size") * 1024).cast("long")), ["log_size", "lang"], shards).withColumn("part", (F.col("k") % parts).cast("int"))
    numbered = placed.select("doc_id", "size", "text_crc32", "shard", "part", (F.row_number().over(Window.partitionBy("shard", "part").orderBy("k", "doc_id")) - 1).alias("rank"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    starts = counts.select("shard", "part", F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return numbered.join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
