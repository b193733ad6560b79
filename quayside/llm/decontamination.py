"""Benchmark decontamination: n-gram seeds by rarity, then Smith-Waterman (operator 5).

Words are compared without case and punctuation. One scan finds, per document,
the positions of n-grams that occur in test items; document frequencies over
the whole corpus follow from it. Every n-gram of an item that some document
holds is a seed: to pick among neighbours by frequency may pick one that an
edit broke. One rare seed is enough, of common ones it takes two. Documents
with enough seeds of an item are read again and the passages around the seeds
aligned with the item; an alignment tolerates edits, insertions and gaps. Any
run of n unedited words holds a seed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Test items are compared in blocks of at most so many bytes, held by every task.
BLOCK_BYTES = 32 << 20
BROADCAST_IDS = 4_000_000
N, LEAST = 3, 0.5
#: An n-gram in more documents is common.
RARE_DOCS = 4096
MATCH, MISMATCH, GAP = 2, -1, -1
CACHE = 500_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normal(token: bytes) -> str:
    return "".join(c for c in token.decode("utf-8", "replace").lower() if c.isalnum())


class Vocabulary(dict):
    """Token -> its word's number from 1, 0 for words of no item, -1 for none."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __missing__(self, token: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        word = normal(token)
        n = self[token] = self.words.get(word, 0) if word else -1
        return n


class Block:
    """Test items as word numbers, with their n-grams in order."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.ids, self.words, self.items = n, [], {}, []
        for item, text in items:
            words = [w for w in map(normal, text.encode().split()) if w]
            if len(words) >= n:
                self.ids.append(item)
                self.items.append(np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.int64))
        coded = [self.codes(x) for x in self.items]
        self.grams = np.unique(np.concatenate(coded)) if coded else np.empty(0, np.int64)
        self.at = [np.searchsorted(self.grams, c) for c in coded]

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A 63-bit hash per n-gram, -1 where a word is of no item. Two n-grams
        of one hash would add seeds, and alignments that find nothing."""
        m = len(ids) - self.n + 1
        if m <= 0:
            return np.empty(0, np.int64)
        out, known = np.zeros(m, np.uint64), np.ones(m, bool)
        for i in range(self.n):
            out = (out ^ (out >> np.uint64(29))) * FACTOR + ids[i : m + i].astype(np.uint64)
            known &= ids[i : m + i] > 0
        return np.where(known, (out >> np.uint64(1)).astype(np.int64), -1)

    def numbers(self, raw: bytes, vocabulary: Vocabulary) -> np.ndarray:
        ids = np.fromiter(map(vocabulary.__getitem__, raw.split()), np.int64)
        return ids[ids >= 0]

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers of the items' n-grams in a text."""
        if not len(self.grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = self.codes(ids)
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        where = np.flatnonzero((self.grams[at] == codes) & (codes >= 0))
        return where, at[where]

    def seeds(self, frequency: np.ndarray) -> list[list[tuple[int, int]]]:
        """Per item, (n-gram, its position in the item) of those that occur."""
        return [sorted({(int(g), p) for p, g in enumerate(at) if frequency[g] > 0}) for at in self.at]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score and the end of the aligned text."""
    j = np.arange(len(text) + 1) * -GAP
    above, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        here = np.zeros(len(text) + 1, np.int64)
        here[1:] = np.maximum(0, above[:-1] + np.where(text == word, MATCH, MISMATCH))
        here = np.maximum(here, above + GAP)
        above = np.maximum.accumulate(here + j) - j  # gaps in the item
        top = int(above.argmax())
        if above[top] > best:
            best, end = int(above[top]), top
    return best, end


def best_passage(item: np.ndarray, text: np.ndarray, starts: list[int], least: float) -> tuple[float, int, int]:
    """Share of the item's full score, and the passage. starts: where the item
    would begin in the text, by each seed. A window that holds too few of the
    item's words to reach `least` isn't aligned."""
    m, best = len(item), (0.0, 0, 0)
    slack = m // 2 + 4
    starts = sorted(starts)
    first = 0
    for i in range(1, len(starts) + 1):
        if i < len(starts) and starts[i] - starts[i - 1] <= slack:
            continue
        lo, hi = max(0, starts[first] - slack), min(len(text), starts[i - 1] + m + slack)
        first, window = i, text[lo:hi]
        if np.isin(item, window).sum() < least * m:  # each match counts MATCH at most
            continue
        score, end = align(item, window)
        if score / (MATCH * m) > best[0]:
            # backwards from its end, the alignment ends where it began
            best = (score / (MATCH * m), lo + end - align(item[::-1], window[:end][::-1])[1], lo + end)
    return best


def _hits(block: Block):
    def run(batches):
        vocabulary = Vocabulary(block.words)
        for b in batches:
            ids, grams = [], []
            texts = b.column(1).cast(pa.binary())
            for i in range(b.num_rows):
                _, found = block.found(block.numbers(texts[i].as_py() or b"", vocabulary))
                if len(found):
                    ids.append(b.column(0)[i].as_py())
                    grams.append(np.unique(found).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.list_(pa.int64()))], ["doc_id", "grams"])

    return run


def needed(seeds: list[list[tuple[int, int]]], weight: np.ndarray) -> list[int]:
    """Per item, the weight of seeds it takes: 2, or all that it has."""
    return [min(2, int(weight[list({g for g, _ in found})].sum())) if found else 2 for found in seeds]


def _alignments(block: Block, seeds: list[list[tuple[int, int]]], weight: np.ndarray, least: float):
    of: dict[int, list[tuple[int, int]]] = {}
    for k, found in enumerate(seeds):
        for gram, p in found:
            of.setdefault(gram, []).append((k, p))
    enough = needed(seeds, weight)

    def run(batches):
        vocabulary = Vocabulary(block.words)
        for b in batches:
            out = []
            texts = b.column(1).cast(pa.binary())
            for i in range(b.num_rows):
                ids = block.numbers(texts[i].as_py() or b"", vocabulary)
                starts: dict[int, list[int]] = {}
                held: dict[int, set[int]] = {}
                for where, gram in zip(*map(np.ndarray.tolist, block.found(ids))):
                    for k, p in of.get(gram, ()):
                        starts.setdefault(k, []).append(where - p)
                        held.setdefault(k, set()).add(gram)
                for k, where in starts.items():
                    if weight[list(held[k])].sum() >= enough[k]:
                        share, lo, hi = best_passage(block.items[k], ids, where, least)
                        if share >= least:
                            out.append((b.column(0)[i].as_py(), block.ids[k], share, lo, hi))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "first_word", "end_word"])

    return run


def contaminations(docs: DataFrame, benchmark: DataFrame, n: int = N, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): one row per document
    and test item whose alignment reaches `least` of the item's full score.

    Null texts count as empty. Items with fewer than n words have no seed and
    match nothing; items with a null id are unused; items that repeat an id
    are one item each and may give it several rows. Repeated documents give
    repeated rows, of rows with a null id none can be named: they come out
    with a null doc_id. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    blocks = 1 + items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // block_bytes
    out = spark.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    for i in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()  # block_bytes at most, about
        block = Block([(r["item_id"], r["text"]) for r in held], n)
        hits = materialize(own.mapInArrow(_hits(block), "doc_id long, grams array<long>"), "hits")
        frequency = np.zeros(len(block.grams), np.int64)
        for r in hits.select(F.explode("grams").alias("gram")).groupBy("gram").count().collect():  # the block's n-grams at most
            frequency[r["gram"]] = r["count"]
        seeds = block.seeds(frequency)
        weight = np.where(frequency > RARE_DOCS, 1, 2)
        pairs = [(g, k, int(weight[g])) for k, found in enumerate(seeds) for g in sorted({g for g, _ in found})]
        if not pairs:
            continue
        table = spark.createDataFrame(pairs, "gram long, item int, weight int")
        enough = spark.createDataFrame(list(enumerate(needed(seeds, weight))), "item int, enough int")
        # a document's n-grams are distinct and few, so its seeds are counted in its own row
        row = F.monotonically_increasing_id()
        counted = hits.withColumn("row", row).select("doc_id", "row", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram").groupBy("row", "item").agg(F.sum("weight").alias("seeds"), F.first("doc_id").alias("doc_id"))
        ids = materialize(counted.join(F.broadcast(enough), "item").where("seeds >= enough").select("doc_id").distinct(), "ids")
        near = own.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, own["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
        out = out.unionByName(near.mapInArrow(_alignments(block, seeds, weight, least), "doc_id long, item_id long, score double, first_word long, end_word long"))
    return out
