r"""op1: rules on single documents, and cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space between words ignored) and hashed; for each host
the distinct documents of a line are counted. A line in more than ``max_docs`` documents of a host is
removed from all of them but the first, by doc_id (null last) and a hash of the text. A document is depleted, and rejected, if
fewer than ``min_left_percent`` of its words stay. Each text is read once.

Null or empty text: all counts are 0 and the base rules fail. A null host is a host of its own. Rows equal in doc_id, text and host
are one document; other rows of one doc_id, and rows without one, are documents by their own texts. Columns of the input
other than the named ones are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import common
from moodtide.llm import textkit as tk

MAX_DOCS, MIN_LEFT_PERCENT = 10, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32()), ("line_no", pa.int32())]))


def _words_of_lines(t: tk.Texts) -> tuple[np.ndarray, ...]:
    """Hashes of the words, where each line's words begin, and the text of each line."""
    start, end = t.spans(tk.BLANK_SEPARATED)
    line_start, _, own = t.lines()
    return t.hashes(start, end), np.append(np.searchsorted(start, line_start), len(start)), own


def parsed(batches):
    """Counts of each document, and the hashes, words and numbers of its normalised lines."""
    for b in batches:
        for t in tk.slices(b.column("text")):
            counts = base_counts(t)
            h, begin, own = _words_of_lines(tk.Texts(t.data, t.offs, t.first, lower=True))
            full = np.flatnonzero(begin[1:] > begin[:-1])
            line = tk.run_hash(h, begin[full], begin[full + 1])
            number = full - np.searchsorted(own, own[full])
            rows = pa.StructArray.from_arrays([pa.array(line.view(np.int64)), pa.array(np.diff(begin)[full].astype(np.int32)), pa.array(number.astype(np.int32))], ["line", "words", "line_no"])
            lists = pa.ListArray.from_arrays(pa.array(tk.bounds(own[full], t.n).astype(np.int32)), rows)
            yield pa.record_batch([*(b.column(k).slice(t.first, t.n) for k in ("a", "r", "host")), *(pa.array(c.astype(np.int64)) for c in counts), lists], names=["a", "r", "host", *COUNTS, "lines"])


def base_counts(t: tk.Texts) -> list[np.ndarray]:
    """The counts COUNTS of each text of a slice."""
    start, end = t.spans(tk.BLANK_SEPARATED)
    h, own = t.hashes(start, end), t.owner(start)
    points = t.points()
    chars = np.append(0, np.cumsum(points[end] - points[start]))
    at = tk.bounds(own, t.n)
    symbols = np.append(0, np.cumsum(_SYMBOL[t.data]))
    # lines with a word, by their exact bytes
    ls, le, line_own = t.lines()
    full = np.searchsorted(start, le) > np.searchsorted(start, ls)
    ls, le, line_own = ls[full], le[full], line_own[full]
    _, distinct = tk.sorted_sets(t.hashes(ls, le), line_own, t.n)
    dup = np.bincount(line_own, minlength=t.n) - np.diff(distinct)
    # words in a 5-word window that the text holds twice
    w, first = tk.windows(h, own, 5)
    keyed = tk.mix(w + tk.mix(own[first].astype(np.uint64)))
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = np.zeros(len(h) + 5, np.int64)
    np.add.at(hit, first[twice], 1)
    np.add.at(hit, first[twice] + 5, -1)
    repeat = np.append(0, np.cumsum(np.cumsum(hit)[: len(h)] > 0))
    return [np.diff(at), np.diff(chars[at]), np.diff(symbols[t.offs]), dup, np.diff(repeat[at])]


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line, fa, fr): the lines of more than max_docs distinct documents of a host, and the first of these documents.

    Rows are first made distinct by document, then counted: no hot line meets in one task whole.
    """
    once = lines.groupBy("host", "line", "a", "r").agg(F.lit(1).alias("one"))
    return once.withColumn("place", common.row_place()).groupBy("host", "line").agg(F.count("*").alias("n"), F.min("place").alias("first")).where(F.col("n") > max_docs).drop("n")


def quality_rules(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left_percent: int = MIN_LEFT_PERCENT) -> tuple[DataFrame, DataFrame]:
    """The verdicts of docs(doc_id, text, host), and the removed lines (doc_id, line_no, words) of each distinct document."""
    common.ship(docs.sparkSession)
    slim = common.keyed(docs.select("doc_id", F.col(host).alias("host"), "text")).select("a", "r", F.coalesce("host", F.lit("\x00")).alias("host"), "text")
    schema = "a long, r long, host string, " + ", ".join(f"{c} long" for c in COUNTS) + ", lines array<struct<line: long, words: int, line_no: int>>"
    rows = common.written(slim.mapInArrow(parsed, schema), "parsed")
    lines = rows.select("a", "r", "host", F.inline("lines"))
    often = common.written(frequent_lines(lines, max_docs), "often")  # read again, so that a hot line's rows may be split
    removed = lines.join(often, ["host", "line"]).where(common.row_place() != F.col("first")).select("a", "r", "host", "line_no", "words")
    removed = removed.groupBy("a", "r", "host", "line_no").agg(F.max("words").alias("words"))  # equal rows are one document
    gone = removed.groupBy("a", "r", "host").agg(F.sum("words").alias("removed_words"), F.count("*").alias("removed_lines"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    doc_id = F.when(F.col("r") < 1 << 31, F.col("a")).alias("doc_id")
    kept = ~failed & (100 * left >= min_left_percent * F.col("n_words"))
    verdict = rows.drop("lines").join(gone, ["a", "r", "host"], "left").select(doc_id, *COUNTS, failed.alias("base_failed"), kept.alias("kept"), F.coalesce("removed_lines", F.lit(0)).alias("n_removed_lines"))
    return verdict, removed.select(doc_id, "line_no", "words")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"))[0]


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text, host) AS k, * FROM (SELECT DISTINCT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents)),
w AS (SELECT k, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (SELECT k, unnest(range(1, greatest(len(ws) - 3, 1))) AS i, ws FROM w),
keyed AS (SELECT k, i, array_to_string(ws[i : i + 4], ' ') AS g FROM grams),
again AS (SELECT k, i FROM keyed QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
repeated AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM again) GROUP BY 1),
lines AS (SELECT k, host, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
          FROM (SELECT k, host, unnest(string_split(text, chr(10))) AS line FROM d)),
full_lines AS (SELECT k, host, line, len(lw) AS words, array_to_string(lw, ' ') AS norm FROM lines WHERE len(lw) > 0),
dups AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY 1),
often AS (SELECT host, norm, min(k) AS first_k FROM full_lines GROUP BY 1, 2 HAVING count(DISTINCT k) > {MAX_DOCS}),
gone AS (SELECT k, sum(words) AS words, count(*) AS n FROM full_lines JOIN often USING (host, norm) WHERE k <> first_k GROUP BY 1),
base AS (SELECT k, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
         FROM w LEFT JOIN dups USING (k) LEFT JOIN repeated USING (k)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT documents.doc_id, judged.* EXCLUDE (k), NOT base_failed AND 100 * (n_words - coalesce(gone.words, 0)) >= {MIN_LEFT_PERCENT} * n_words AS kept, coalesce(gone.n, 0)::BIGINT AS n_removed_lines
FROM documents JOIN d ON documents.doc_id IS NOT DISTINCT FROM d.doc_id AND coalesce(source, chr(0)) = host AND coalesce(documents.text, '') = d.text
JOIN judged USING (k) LEFT JOIN gone USING (k)
"""
