"""Quality rules by compression bands (operator 9).

zstandard ratios of the whole document and of its fixed chunks; each must lie
in the band for its length. Repetitive text compresses below the band, random
or encoded text above it. Codes of few symbols, as hexadecimal ones, lie in the
band of prose; from MATCHED bytes on a ratio that is no less than the entropy
of single bytes tells them, as zstandard found nothing repeated. In shorter
texts these are not told from prose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (bytes from, least ratio, greatest ratio): frame overhead dominates short
#: texts. sf0.1's texts and chunks of quality 1 reach at most 1.134 from 64
#: bytes, 0.923 from 128, 0.744 from 256, 0.682 from 512, 0.580 from 1,024,
#: 0.521 from 2,048, 0.482 from 4,096 and 0.451 from 8,192; the rest is room
#: for other scripts.
BANDS = ((0, 0.0, 16.0), (64, 0.35, 1.25), (128, 0.45, 1.05), (256, 0.45, 0.86), (512, 0.42, 0.78), (1024, 0.40, 0.70), (2048, 0.40, 0.66), (4096, 0.38, 0.65), (8192, 0.34, 0.62), (32768, 0.30, 0.58))
MATCHED = 4096
CHUNK = 4096
#: A document fails if more than this share of its chunks is out of band.
BAD_CHUNKS = 0.2
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_NOT_STARTS = _SPACE + bytes(range(0x80, 0xC0))  # white space and UTF-8 continuation bytes
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks double"


def band(size: int, bands=BANDS) -> tuple[float, float]:
    return next((lo, hi) for start, lo, hi in reversed(bands) if size >= start)


def entropy(raw: bytes) -> float:
    """Bits per bit of independent bytes: what coding without matches reaches."""
    n = np.bincount(np.frombuffer(raw, np.uint8))
    share = n[n > 0] / len(raw)
    return float(-(share * np.log2(share)).sum() / 8)


def in_band(raw: bytes, compressor: zstandard.ZstdCompressor, bands=BANDS) -> tuple[float, bool]:
    ratio = len(compressor.compress(raw)) / max(1, len(raw))
    lo, hi = band(len(raw), bands)
    return ratio, not raw or lo <= ratio <= hi and (len(raw) < MATCHED or ratio < entropy(raw))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    triples = pairs[:-1] * len(seen) + ids[2:]
    _, at, count = np.unique(triples, return_inverse=True, return_counts=True)
    again = count[at] > 1
    held = np.zeros(len(ids), bool)
    for i in range(3):
        held[i : len(ids) - 2 + i] |= again
    return int(held.sum())


def statistics(raw: bytes) -> tuple[int, int, int, int, int]:
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(raw.translate(None, _NOT_STARTS)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _rows(bands, chunk: int, level: int):
    def run(batches):
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            out = []
            texts = batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                raw = texts[i].as_py() or b""
                ratio, fits = in_band(raw, compressor, bands)
                pieces = [raw[at : at + chunk] for at in range(0, len(raw), chunk)]
                bad = sum(not in_band(p, compressor, bands)[1] for p in pieces) / max(1, len(pieces))
                out.append((*statistics(raw), ratio if fits else -ratio, bad))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "bad_chunks"])

    return run


def compression_rules(docs: DataFrame, bands=BANDS, chunk: int = CHUNK, bad_chunks: float = BAD_CHUNKS, level: int = LEVEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    ratio, bad_chunks, in_bands, base_failed, kept) per row of docs.

    A null text counts as empty; an empty text is in band and fails the base
    rule. Rows are judged one by one, so ties and repeated rows need no rule;
    a null id stays null. An empty table gives no rows; other columns are
    ignored. One map over the scan: nothing is shuffled, memory is a batch.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_rows(bands, chunk, level), SCHEMA)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = (F.col("ratio") >= 0) & (F.col("bad_chunks") <= bad_chunks)
    return rows.withColumns({"in_bands": fits, "base_failed": failed}).withColumns({"kept": fits & ~failed, "ratio": F.abs("ratio")})
