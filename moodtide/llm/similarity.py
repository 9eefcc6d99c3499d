"""op6: n-gram Jaccard join of documents.

A set's elements are 5-word shingles of A-Z lower-cased words (fewer words: the whole sequence), linked at a Jaccard
similarity of at least 3/4, closed transitively; see :mod:`moodtide.llm.setsim`.

Null, empty and blank texts have no shingle and are components of their own. Rows of one doc_id are judged each by its own text. A
row without a doc_id links like others; its component is null if no linked row has one. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodtide.llm import common, setsim


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text)."""
    doc_id = F.when(F.col("r") < 1 << 31, F.col("a"))
    return setsim.classes(docs).select(doc_id.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are the first of their component, by doc_id (null last) and a hash of the text.

    Of rows equal in doc_id and text one stays. Rows without words stay, all of them.
    """
    a, r, n, rank = (common.fresh(docs, k) for k in ("a", "r", "n", "rank"))
    stays = setsim.classes(docs).where("stays").select(F.col("a").alias(a), F.col("r").alias(r), F.col("n").alias(n)).distinct()
    kept = common.keyed(docs, a, r).join(stays, [a, r])
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    order = F.row_number().over(Window.partitionBy(a, r).orderBy(F.xxhash64(*plain)))
    return kept.withColumn(rank, order).where((F.col(n) == 0) | (F.col(rank) == 1)).select(*docs.columns)


def op6_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COMPONENTS = r"""
s AS (SELECT DISTINCT k, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.k = x JOIN n b ON b.k = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT k, k AS o FROM n UNION SELECT r.k, l.y FROM r JOIN l ON l.x = r.o),
comp AS (SELECT k, min(o) AS component FROM r GROUP BY 1)"""
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS k, regexp_extract_all({_LOW.format('text')}, '[^\x20\x09-\x0D]+') AS ws FROM documents), {_COMPONENTS}
SELECT k AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, k) AS component_id FROM w LEFT JOIN n USING (k) LEFT JOIN comp USING (k)
"""
