"""Periodic runs: stretches of words in which one block repeats four times or more, found by counting matches at every lag.

At lag q the words that equal the word q places on are its matches. A stretch of period q is an island of matches, so it needs
lag counts of a certain size, and only lags that have them are scanned. Counts come from an exact autocorrelation by
FFT for frequent words (heavy) and from differences of positions for the rest (light).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidemark.llm.common import small_batches, table, texts

#: A run is at least so many words long, and so many of its periods.
LEAST, TIMES = 6, 4
WORD = r"[^\x20\x09-\x0D]+"


def lag_matches(ids: np.ndarray, most: int) -> np.ndarray:
    """For lags 0 to most, how many words equal the word that many places on (lag 0 is left at 0).

    A word with c places costs c^2 / 2 differences or one FFT of all n places; words beyond the balance are heavy. The
    spectra of heavy words are summed and transformed back once; sums are whole numbers far below the precision of doubles, so rounding makes them exact.
    """
    n = len(ids)
    out = np.zeros(most + 1, np.int64)
    counts = np.bincount(ids)
    size = 1 << (n + most).bit_length()
    heavy = counts > max(16, int((size * np.log2(size)) ** 0.5))
    if heavy.any():
        spectrum = np.zeros(size // 2 + 1)
        for w in np.flatnonzero(heavy):
            x = np.fft.rfft(ids == w, size)
            spectrum += x.real**2 + x.imag**2
        out += np.rint(np.fft.irfft(spectrum, size)[: most + 1]).astype(np.int64)
    place = np.argsort(ids, kind="stable")
    word = ids[place]
    place, word = place[~heavy[word]], word[~heavy[word]]
    first = np.arange(len(place))
    step = 1
    while len(first):  # those whose step-th next place of the same word exists and is near enough
        first = first[: np.searchsorted(first, len(place) - step)]
        gap = place[first + step] - place[first]
        near = (word[first + step] == word[first]) & (gap <= most)
        first = first[near]
        out += np.bincount(gap[near], minlength=most + 1)
        step += 1
    out[0] = 0
    return out


def _stretches(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[start, end) of the maximal stretches of true flags that are long enough."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    return [(int(a), int(b)) for a, b in zip(starts, ends) if b - a >= least]


def islands(ids: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """The maximal islands of at least `least` matches at lag q. Places are looked at in steps of q / 8 first: an island holds so many of them in a row."""
    n, step = len(ids) - q, max(1, q // 8)
    if step == 1:
        return _stretches(ids[:n] == ids[q:], least)
    out = []
    for a, b in _stretches(ids[:n:step] == ids[q::step], least // step):
        low, high = max(0, (a - 1) * step + 1), min(n, b * step)
        out += [(low + x, low + y) for x, y in _stretches(ids[low:high] == ids[low + q : high + q], least)]
    return out


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all maximal stretches of at least max(LEAST, TIMES * period) words, by start, then period.

    Matches at a multiple of a run's period inside the run are taken off the count of that lag: they form one island, the run
    itself, since a longer stretch of that period would have the run's period too. So ten thousand equal words are one scan.
    """
    n = len(ids)
    most = n // TIMES
    if n < LEAST:
        return []
    lags = np.arange(most + 1)
    need = np.maximum(LEAST, TIMES * lags) - lags
    left = lag_matches(ids, most)
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(left >= need):
        if q == 0 or left[q] < need[q]:
            continue
        for a, b in islands(ids, int(q), int(need[q])):
            start, end = a, b + int(q)
            if (start, end) in found:
                continue
            found[start, end] = int(q)
            again = np.arange(2 * q, min(most + 1, end - start), q)
            left[again] -= end - start - again
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay if of every run only the first period is kept, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


ADDED = ("n_words", "runs", "collapsed")
RUNS = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]), False)


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, runs (array of start, length, period, numbered from word 0) and collapsed, the text of the words that stay.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Each row is judged by itself, so repeated rows
    and null ids have no effect; other columns stay, and columns named n_words, runs or collapsed are replaced. Texts are whole, whatever their length; a row
    stays in its task and nothing is shuffled.
    """
    if text_col in ADDED:
        raise ValueError(f"{text_col} is the name of a result")
    kept = docs.drop(*ADDED)
    names = [*kept.columns, *ADDED]
    schema = StructType([*kept.schema.fields, StructField("n_words", LongType()), StructField("runs", RUNS), StructField("collapsed", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, offsets, parts, left = [], [0], [], []
            for text in texts(b, text_col):
                words = text.split()
                numbers: dict[bytes, int] = {}
                runs = find_runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64))
                n_words.append(len(words))
                parts += runs
                offsets.append(len(parts))
                left.append(collapse(words, runs).decode())
            flat = np.array(parts, np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"])
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words, pa.int64()), found, pa.array(left, pa.string())], names=names)

    small_batches(docs.sparkSession)
    return kept.mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """The query's texts: a tenth of the documents, by the CRC-32 of the id, end in a block of words that repeats. A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    mine = docs.select("doc_id", "text", (F.floor(h / 10)).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(WORD), 0)).alias("words"))
    n = F.size("words")
    some = mine.select("*", F.when(n > 0, n).alias("n")).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.col("n") - F.col("a")
    blocks = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(tail / F.col("p")).cast("int")))
    text = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), F.slice(blocks, F.lit(1), tail))
    return some.select("doc_id", F.when(F.col("n").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
