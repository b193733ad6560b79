"""Quality classifier: histogram gradient-boosted trees (operator 3).

Trees are grown on quantile bins of document statistics with logistic loss,
then flattened into arrays of feature, threshold and children, which numpy
walks for all rows and trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compression import repeated_words

#: Most labelled rows that training takes, those of least id hash.
SAMPLE = 20_000
FEATURES = ("log_bytes", "words", "word_len", "unique", "symbols", "bars", "bangs", "upper", "digits", "periods", "other_ascii", "non_ascii", "lines", "line_words", "dup_lines", "repeated", "top_word", "ratio", "starts_upper", "short_lines", "max_line", "dup_line_bytes")
_SYMBOLS = b"#*$%&<>"


def document_statistics(raw: bytes, compressor: zstandard.ZstdCompressor) -> list[float]:
    size = max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = set(lines)
    m = max(1, len(lines))
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digits, space = by[65:91].sum(), by[48:58].sum(), by[9:14].sum() + by[32]
    symbols = by[list(_SYMBOLS)].sum()
    return [
        np.log1p(len(raw)), np.log1p(len(words)), (size - space) / n, len(counts) / n, symbols / size, by[124] / n, by[33] / n, upper / size, digits / size, by[46] / n,
        (by[33:127].sum() - by[97:123].sum() - upper - digits) / size, by[128:].sum() / size, np.log1p(len(lines)), n / m, 1 - len(distinct) / m if lines else 0.0, repeated_words(words) / n,
        max(counts.values(), default=0) / n, len(compressor.compress(raw)) / size, sum(w[:1].isupper() for w in words) / n, sum(len(x) < 40 for x in lines) / m, np.log1p(max(map(len, lines), default=0)),
        1 - sum(map(len, distinct)) / max(1, sum(map(len, lines))),
    ]


def _feature_matrix(texts: pa.Array, compressor) -> np.ndarray:
    return np.array([document_statistics(t.as_py() or b"", compressor) for t in texts.cast(pa.binary())]).reshape(len(texts), len(FEATURES))


@dataclass
class Forest:
    """All trees' nodes in one set of arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Forest:
    """No rows or one class only: a forest without trees that gives the
    smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # bin b: x <= edges[b]
        offset = np.arange(x.shape[1]) * bins
        raw = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)

            def grow(rows: np.ndarray, level: int) -> int:
                me = len(nodes)
                nodes.append([0, np.inf, me, me, rate * g[rows].sum() / (h[rows].sum() + l2)])
                if level == depth or len(rows) < 2 * least:
                    return me
                flat = (code[rows] + offset).ravel()
                total = x.shape[1] * bins
                gs, hs, ns = (np.bincount(flat, np.repeat(v[rows], x.shape[1]) if v is not None else None, total).reshape(-1, bins).cumsum(axis=1) for v in (g, h, None))
                g_all, h_all = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (g_all - gs) ** 2 / (h_all - hs + l2) - g_all**2 / (h_all + l2)
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    return me
                go = code[rows, f] <= b
                nodes[me][0], nodes[me][1] = f, edges[f][b]
                nodes[me][2] = grow(rows[go], level + 1)
                nodes[me][3] = grow(rows[~go], level + 1)
                return me

            roots.append(grow(np.arange(len(y)), 0))
            table = np.array(nodes)
            at = np.full(len(y), roots[-1])
            for _ in range(depth):
                f = table[at, 0].astype(int)
                at = np.where(x[np.arange(len(y)), f] <= table[at, 1], table[at, 2], table[at, 3]).astype(int)
            raw = raw + table[at, 4]
    table = np.array(nodes).reshape(-1, 5)
    return Forest(np.array(roots, int), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], base, depth)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """The bound is `sample` labelled rows; which ones depends on ids alone."""
    ids = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=3)
        for b in batches:
            x = _feature_matrix(b.column(2), compressor)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")
    # sample rows at most: ids are distinct, and of rows that share an id one stays
    got = picked.mapInArrow(run, "doc_id long, y double, x array<double>").groupBy("doc_id").agg(F.max(F.struct("x", "y")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    return train(np.array(got["x"].tolist()).reshape(len(got), len(FEATURES)), got["y"].to_numpy(float))


def score_column(text: Column, forest: Forest) -> Column:
    """The forest's probability of label 1, by whole texts in Arrow batches."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(forest.scores(_feature_matrix(texts, zstandard.ZstdCompressor(level=3))))

    return scored(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs.

    A null text is scored as an empty one, a null id is held out. Of labels,
    rows with a null id or label are unused and a repeated id counts as its
    greatest label. Without usable labels every score is 0.5. Repeated rows
    get equal scores. An empty table gives no rows; other columns are ignored.
    """
    forest = fit(docs, labels, sample, id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), score_column(F.col(text_col), forest).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
