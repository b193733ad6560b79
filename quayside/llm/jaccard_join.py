"""N-gram Jaccard join by parity sketches (operator 7).

Every text becomes the set of its distinct word shingles, each a 64-bit hash.
A sketch keeps the parity of the hashes that fall into each of its cells: a
shingle in one set only flips one cell, so the Hamming distance of two
sketches is at most the symmetric difference of the sets. If the similarity
is t or more, sets of a and b shingles differ in D <= (a+b)(1-t)/(1+t)
shingles. Per size band, shingles are dealt by hash to d+1+s blocks, d being
the largest such D of the band: at least s+1 blocks agree entirely, so the XOR
of those blocks' hashes is equal (pigeonhole). Of its blocks a set leaves out
those with at most c shingles, where c is the largest value for which that
drops no more than r < s+1; of the agreeing blocks s+1-r are therefore sent by
both sides. A set that shares fewer blocks than that with all others has no
partner; one that shares fewer large blocks has none that small blocks miss.

Members of a large block are compared with its leader. What that leaves apart
meets by its rarest shingles (prefix filter, in the order of counts among these
sets); of the sets that share a shingle those of its largest component are not
paired with each other. Candidates pass size and Hamming bounds within the join
that makes them and are verified on the whole shingle arrays. Members that are
connected by a leader are not verified against each other: the components are
exact, the list of links isn't whole, and no number of links is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, release, shuffles_end_with_queries

#: Above this many ids the text scan is joined, not filtered by a broadcast set.
BROADCAST_IDS = 4_000_000
BROADCAST_PAIRS = 1_000_000
BROADCAST_SHINGLES = 4_000_000  # 32 MB
SKETCH_WORDS = 16  # least size of a parity sketch: 1,024 cells
BAND_BITS = 10  # of a signature: its size band
FOLD = 8  # words of the sketch that rows carry into a join of candidates
#: Members of blocks of up to so many are simply paired.
SMALL = 16
CACHE = 500_000
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, kept while the worker lives, up to CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles. bytes.lower() and bytes.split() act on
    ASCII letters and white space only, which is what the contract asks."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    if len(h) < n:
        whole = np.full(1, len(h), np.uint64)
        for x in h:
            whole = scramble(whole * _ODD[0] + x)
        return whole
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out += scramble(h[i : len(h) - n + 1 + i] + _ODD[i % 8]) * _ODD[i % 8]
    return np.unique(scramble(out))


class Bands:
    """Sizes up to `upper[j]` are of band j; `num`/`den` is the similarity."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        t = num / den
        first = 0
        while first < 64 and (first + 1) * den // num == first + 1:
            first += 1
        # sets of up to `first` shingles have no partner but equal sets
        upper = [first]
        while upper[-1] < 1 << 31:
            upper.append(max(upper[-1] + 1, int(upper[-1] / t / t)))
        if len(upper) > 1 << BAND_BITS:
            raise ValueError(f"a similarity of {num}/{den} has too many size bands")
        self.upper = np.array(upper)

    def differ(self, both: int) -> int:
        """Largest symmetric difference of sets with `both` shingles in all."""
        return both * (self.den - self.num) // (self.den + self.num)

    def blocks(self, band: int) -> tuple[int, int, int]:
        """(blocks, how many a set may leave out, how many partners share)."""
        d = self.differ(2 * int(self.upper[band]))
        spare, left_out = 1 + d // 4, 1 + d // 6
        return d + 1 + spare, left_out, spare + 1 - left_out

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size meets its partners."""
        j = int(np.searchsorted(self.upper, size))
        own = [j] if j else []
        return own + [j + 1] if (int(self.upper[j]) + 1) * self.num <= size * self.den else own


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    out = []
    for j in bands.of(len(s)):
        k, left_out, _ = bands.blocks(j)
        block = (scramble(s ^ _ODD[1]) % np.uint64(k)).astype(np.int64)
        filled = np.bincount(block, minlength=k)
        level = np.bincount(filled).cumsum()  # how many blocks hold at most c
        c = int(np.searchsorted(level, left_out, side="right")) - 1
        order = np.argsort(block, kind="stable")
        parity = np.zeros(k, np.uint64)
        full = np.flatnonzero(filled)
        starts = np.concatenate(([0], np.cumsum(filled[full])[:-1]))
        parity[full] = np.bitwise_xor.reduceat(scramble(s[order] ^ _ODD[2]), starts)
        sent = np.flatnonzero(filled > c).astype(np.uint64)
        mixed = scramble(parity[sent.astype(np.int64)] + scramble(sent * _ODD[3] + np.full(1, j, np.uint64) * _ODD[4]))
        out.append(mixed << np.uint64(BAND_BITS) | np.uint64(j))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a power of two of cells, as many as the set has shingles or
    more. Halves folded on each other are the sketch of half the width."""
    width = max(64 * SKETCH_WORDS, 1 << max(0, len(s) - 1).bit_length())
    cell = np.bincount((scramble(s ^ _ODD[5]) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(cell.astype(np.uint8)).view(np.int64)


def folded_sketch(marks: np.ndarray) -> np.ndarray:
    """The sketch of FOLD words that a wider one folds to."""
    return np.bitwise_xor.reduce(marks.reshape(-1, FOLD), axis=0)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[object, bytes]]:
    ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
    for i in range(len(ids)):
        yield ids[i].as_py(), texts[i].as_py() or b""


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)))


def _class_rows(n: int, num: int, den: int):
    def run(batches):
        hashes, bands = WordHashes(), Bands(num, den)
        for batch in batches:
            ids, size, h1, h2, sigs, held = [], [], [], [], [], 0
            for key, text in _texts(batch):
                s = shingle_set(text, hashes, n)
                ids.append(key)
                size.append(len(s))
                h1.append(int(np.bitwise_xor.reduce(scramble(s ^ _ODD[6])).view(np.int64)) if len(s) else 0)
                h2.append(int(scramble(s ^ _ODD[7]).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                sigs.append(signatures(s, bands))
                held += len(sigs[-1])
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), _lists(sigs)], ["doc_id", "n", "h1", "h2", "sigs"])
                    ids, size, h1, h2, sigs, held = [], [], [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), _lists(sigs)], ["doc_id", "n", "h1", "h2", "sigs"])

    return run


def _set_rows(n: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, sets, marks, held = [], [], [], 0

            def made():
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists([folded_sketch(m) for m in marks]), _lists(marks), _lists(sets)], ["node", "n", "fold", "marks", "shingles"])

            for key, text in _texts(batch):
                s = shingle_set(text, hashes, n)
                ids.append(key)
                sets.append(s)
                marks.append(sketch(s))
                held += len(s)
                if held > 1_000_000:
                    yield made()
                    ids, sets, marks, held = [], [], [], 0
            if ids:
                yield made()

    return run


def _side(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(F.col("node").alias(key), *[F.col(c).alias(f"{c}_{key}") for c in other.columns[1:]]), key)


def _with_arrays(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, ...), a written table, with shingles_a and shingles_b.
    Up to bounds that are checked, pairs and the arrays of side a (leaders are
    few) go to where the arrays of side b are read, and no array is shuffled."""
    arrays = sets.select("node", "shingles")
    ids = _held(pairs.select(F.col("a").alias("node")).distinct())
    firsts = arrays.join(ids, "node", "left_semi").withColumnsRenamed({"node": "a", "shingles": "shingles_a"})
    size = sets.select("node", "n").join(ids, "node", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    few = pairs.count() <= BROADCAST_PAIRS
    seconds = arrays.withColumnsRenamed({"node": "b", "shingles": "shingles_b"})
    met = seconds.join(F.broadcast(pairs) if few else pairs, "b")
    return met.join(F.broadcast(firsts) if size <= BROADCAST_SHINGLES else firsts, "a")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """A written table of the pairs (a, b) that are linked: sizes and whole
    sketches are compared first, then the shingles."""
    light = sets.select("node", "n", "marks")
    near = _side(_side(pairs, light, "a"), light, "b")

    def folded(own: str, other: str) -> Column:
        n = F.size(other)
        halves = F.zip_with(F.slice(own, F.lit(1), n), F.slice(own, n + 1, n), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) == 2 * n, halves).otherwise(F.col(own))

    near = near.withColumns({"marks_a": folded("marks_a", "marks_b"), "marks_b": folded("marks_b", "marks_a")})
    flipped = F.aggregate(F.zip_with("marks_a", "marks_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    flipped = F.when(F.size("marks_a") == F.size("marks_b"), flipped).otherwise(0)
    bound = F.floor((F.col("n_a") + F.col("n_b")) * (den - num) / (den + num))
    near = materialize(near.where((F.abs(F.col("n_a") - F.col("n_b")) <= bound) & (flipped <= bound)).drop("marks_a", "marks_b"), "near")
    common = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    out = materialize(_with_arrays(near, sets).where(common * den >= num * (F.col("n_a") + F.col("n_b") - common)).select("a", "b"), "links")
    release(near)
    return out


def _pairs_alike(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share an element, are of two
    components, and whose sizes and folded sketches allow a link; the tests are
    part of the join's condition, so far pairs never leave it. rows: (e, node,
    comp, minor); rows that are not minor, all of one component, are met by the
    minor ones only."""
    light = sets.select("node", "n", *[F.col("fold")[i].alias(f"f{i}") for i in range(FOLD)])
    rows = rows.join(F.broadcast(light) if light.count() <= BROADCAST_PAIRS // 2 else light, "node")
    carried = ["n", "comp", "minor", *[f"f{i}" for i in range(FOLD)]]
    x, y = (rows.select("e", F.col("node").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in carried]) for p in "ab")
    bound = F.floor((F.col("n_a") + F.col("n_b")) * (den - num) / (den + num))
    flipped = sum((F.bit_count(F.col(f"f{i}_a").bitwiseXOR(F.col(f"f{i}_b"))) for i in range(FOLD)), F.lit(0))
    near = (~F.col("minor_b") | (F.col("a") < F.col("b"))) & (F.col("comp_a") != F.col("comp_b")) & (F.abs(F.col("n_a") - F.col("n_b")) <= bound) & (flipped <= bound)
    return x.where("minor_a").join(y, "e").where(near).select("a", "b").distinct()


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs among the nodes (node, comp), of two components, that share one of
    their rarest shingles. A link needs num/den of either set in common, so the
    n - ceil(n num / den) + 1 first elements of both sets in one order meet.
    The order is the count among the nodes: what many share comes last and is
    rarely in a prefix."""
    own = sets.join(_held(nodes.select("node")), "node", "left_semi")
    held = materialize(own.select("node", "n", F.explode("shingles").alias("e")), "elements")
    counts = held.groupBy("e").agg(F.count("*").alias("c")).where("c > 1")
    rated = held.join(counts, "e", "left").select("node", "n", F.struct(F.coalesce("c", F.lit(1)).alias("c"), "e").alias("e"))
    take = (F.col("n") - F.ceil(F.col("n") * num / den) + 1).cast("int")
    first = rated.groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("e")).alias("all")).select("node", F.explode(F.slice("all", F.lit(1), take)).alias("e"))
    rare = materialize(first.where("e.c > 1").select("node", F.col("e.e").alias("e")).join(nodes, "node"), "prefixes")
    release(held)
    by_comp = rare.groupBy("e", "comp").agg(F.count("*").alias("c"))
    tops = by_comp.groupBy("e").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    rows = materialize(rare.join(tops, "e").select("e", "node", "comp", (F.col("comp") != F.col("top")).alias("minor")), "met")
    out = materialize(_pairs_alike(rows, sets, num, den), "rest")
    release(rare, rows)
    return out


def _band(sig: str) -> Column:
    return F.col(sig).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int").alias("band")


def _sharing(rows: DataFrame, bands: Bands) -> DataFrame:
    """(rep, band) of those that share as many blocks as partners of the band
    do. rows: (rep, band), one per block."""
    least = F.element_at(F.array(*[F.lit(bands.blocks(j)[2]) for j in range(len(bands.upper))]), F.col("band") + 1)
    return rows.groupBy("rep", "band").count().where(F.col("count") >= least).select("rep", "band")


def _links(pairs: DataFrame, sized: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Enough links among nodes that share blocks to connect all that is
    linked. pairs (a, b): blocks of two members; sized (sig, band, rep, c):
    members of larger ones.

    Blocks of at most SMALL members pair all of them, larger ones meet the
    member that shares most blocks with others. Blocks of one component are
    then settled; nodes that share enough of the others meet by their rarest
    shingles.
    """
    num, den = bands.num, bands.den
    x, y = (sized.where(F.col("c") <= SMALL).select("sig", F.col("rep").alias(p)) for p in "ab")
    near = x.join(y, "sig").where("a < b").select("a", "b").unionByName(pairs)  # at most SMALL / 2 rows a member
    large = sized.where(F.col("c") > SMALL)
    blocks = materialize(large.join(_sharing(large.select("rep", "band"), bands), ["rep", "band"], "left_semi").select("sig", "band", "rep"), "blocks")
    if blocks.isEmpty():
        return _linked(near.distinct(), sets, num, den)
    shared = blocks.join(blocks.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1"), "sig")
    rated = shared.groupBy("rep").agg(F.sum("c").alias("popular"))
    lead = blocks.join(rated, "rep").groupBy("sig").agg(F.max(F.struct("popular", (-F.col("rep")).alias("low"))).alias("m")).select("sig", (-F.col("m.low")).alias("leader"))
    stars = blocks.join(lead, "sig").where("rep <> leader").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b"))
    found = _linked(materialize(near.unionByName(stars).distinct(), "pairs"), sets, num, den)

    comps = materialize(connected_components(found), "comps").withColumnRenamed("node", "rep")
    named = materialize(blocks.join(comps, "rep", "left").select("sig", "band", "rep", F.coalesce("component", "rep").alias("comp")), "named")
    open_ = named.join(named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig"), "sig", "left_semi")
    nodes = materialize(open_.join(_sharing(open_.select("rep", "band"), bands), ["rep", "band"], "left_semi").select(F.col("rep").alias("node"), "comp").distinct(), "nodes")
    release(blocks, named)
    rest = _prefix_pairs(nodes, sets, num, den)
    return found.unionByName(_linked(rest, sets, num, den))


def _held(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A set of ids for a join: broadcast up to `most` rows."""
    return F.broadcast(ids) if ids.count() <= most else ids


def jaccard_components(docs: DataFrame, shingle: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs: links join texts
    whose shingle sets have intersection * den >= num * union.

    A null or blank text has an empty set, no links and itself as component.
    Fewer words than a shingle: the whole sequence is the one shingle. Rows
    with a null id count as texts but never name a component (they get their
    class's, or null). Rows that share an id are one document. Repeated rows
    each give a row. An empty table gives no rows; other columns are ignored.
    """
    with shuffles_end_with_queries(docs.sparkSession):
        return _components(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), shingle, num, den)


def _components(own: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    signed = materialize(own.mapInArrow(_class_rows(shingle, num, den), "doc_id long, n long, h1 long, h2 long, sigs array<long>"), "signed")
    key = ["n", "h1", "h2"]
    rows = materialize(signed.drop("sigs"), "rows")
    filled = signed.where("n > 0")
    reps = rows.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    # copies collapse before anything is compared
    leads = materialize(reps.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct(), "leads")
    sent = filled.join(_held(leads), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.explode("sigs").alias("sig"))
    # a block of any size is one row of partial sums; blocks of two are pairs already
    met = materialize(sent.groupBy("sig").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("c")).where("a <> b"), "met")
    wide = materialize(sent.join(_held(met.where("c > 2").select("sig"), BROADCAST_PAIRS), "sig", "left_semi").distinct(), "wide")
    two = met.where("c = 2").select("a", "b", _band("sig"))
    release(signed, leads)
    bands = Bands(num, den)
    ends = two.select(F.explode(F.array("a", "b")).alias("rep"), "band").unionByName(wide.select("rep", _band("sig")))
    able = materialize(_sharing(ends, bands), "able")
    held = wide.withColumn("band", _band("sig")).join(_held(able, BROADCAST_PAIRS), ["rep", "band"], "left_semi")
    sized = materialize(held.join(held.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1"), "sig"), "sized")
    few = _held(able, BROADCAST_PAIRS)
    ok = two.join(few.withColumnRenamed("rep", "a"), ["a", "band"], "left_semi").join(few.withColumnRenamed("rep", "b"), ["b", "band"], "left_semi")
    pairs = materialize(ok.select("a", "b").distinct(), "pairs")
    release(met, wide, able)

    ids = materialize(sized.select(F.col("rep").alias("doc_id")).unionByName(pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))).distinct(), "ids")
    sets = own.join(_held(ids), "doc_id", "left_semi").mapInArrow(_set_rows(shingle), "node long, n long, fold array<long>, marks array<long>, shingles array<long>")
    if not rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        sets = sets.dropDuplicates(["node"])
    sets = materialize(sets, "shingles")
    comps = connected_components(_links(pairs, sized, sets, bands))
    release(ids, sets, pairs, sized)

    named = rows.where("n > 0").select("doc_id", *key).join(reps, key).join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return named.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
