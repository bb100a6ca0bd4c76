"""Statistics of whole texts, counted in Python over Arrow batches.

Words are maximal runs of anything but the six ASCII white-space characters. Every count is over
the whole text; memory is bounded by a batch and its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\r\x0b\x0c"
#: Base statistics first, then shares and shapes that the learners see besides.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHAPES = ["n_chars", "n_lines", "n_upper", "n_common_letters", "n_digits", "n_end_marks", "n_exclaims", "n_distinct_words", "n_long_words", "n_short_lines", "n_top_word"]


def repeated_words(words: list[bytes], window: int = 3) -> tuple[int, int, int]:
    """Words inside windows that occur twice or more; distinct words; occurrences of the commonest word."""
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if not len(seq):
        return 0, 0, 0
    top = int(np.bincount(seq).max())
    n, k = len(seq) - window + 1, len(ids)
    if n < 2:
        return 0, k, top
    code = seq[:n]
    for i in range(1, window):
        if k > 1 and int(code.max()) > (2**62) // k:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = code * k + seq[i : i + n]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0, k, top
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(seq), bool)
    for i in range(window):
        covered[i : i + n] |= twice
    return int(covered.sum()), k, top


def base_stats(text: str) -> tuple[int, ...]:
    """The values of BASE + SHAPES."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = text.split("\n")
    seen: set[str] = set()
    dups = short = full = 0
    for line in lines:
        if line and line.strip(_WHITE):
            full += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
            short += len(line) < 40
    repeat, distinct, top = repeated_words(words)
    upper = sum(map(raw.count, _UPPER))
    digits = sum(map(raw.count, _DIGITS))
    return (
        len(words),
        len(text) - sum(map(text.count, _WHITE)),
        sum(map(text.count, SYMBOLS)),
        dups,
        repeat,
        len(text),
        full,
        upper,
        sum(map(raw.count, _COMMON)),
        digits,
        raw.count(b"."),
        raw.count(b"!"),
        distinct,
        sum(len(w) > 16 for w in words),
        short,
        top,
    )


_UPPER = [bytes([c]) for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_COMMON = [bytes([c]) for c in b"aeinst"]
_DIGITS = [bytes([c]) for c in b"0123456789"]


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's text (null: no text), as longs."""
    names = BASE + SHAPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([base_stats(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} bigint" for n in names)]))


def shares():
    """Name -> Spark expression over the statistics, for the learners: rates that do not depend on length, and logs of sizes."""
    word, char, line = (F.greatest(F.lit(1.0), F.col(c).cast("double")) for c in ("n_words", "n_chars", "n_lines"))
    return {
        "log_words": F.log1p("n_words"),
        "mean_word": F.col("word_chars") / word,
        "symbol_share": F.col("n_symbols") / word,
        "dup_line_share": F.col("n_dup_lines") / line,
        "repeat_share": F.col("n_repeat_words") / word,
        "upper_share": F.col("n_upper") / char,
        "common_letter_share": F.col("n_common_letters") / char,
        "digit_share": F.col("n_digits") / char,
        "stop_rate": F.col("n_end_marks") / word,
        "exclaim_rate": F.col("n_exclaims") / word,
        "distinct_share": F.col("n_distinct_words") / word,
        "long_share": F.col("n_long_words") / word,
        "short_line_share": F.col("n_short_lines") / line,
        "line_words": F.log1p(F.col("n_words") / line),
        "top_share": F.col("n_top_word") / word,
    }
