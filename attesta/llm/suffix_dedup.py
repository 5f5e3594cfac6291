"""Repeated passages by sparse suffix arrays.

Only suffixes that begin at content-selected minimiser positions (see anchors) are retained, and of those only the ones
whose first `gram` words occur more than once. They are sorted, neighbours' common prefixes are compared, and matches are
extended to the left and right (see contexts); every passage of `window` or more words that occurs earlier (smaller id,
or the same document and an earlier start) is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.anchors import anchor_rows, entries, removed_digest
from attesta.llm.common import cut, drop_cut, texts_of
from attesta.llm.contexts import by_text, repeated_windows


def remove_passages(docs: DataFrame, *, window: int = 50, gram: int = 25, most: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of each document.

    A word goes if it is in a passage of `window` or more words that also starts earlier. Null or empty texts have no
    words. Rows without id are returned as they are and remove nothing. Rows that share an id count as one place. Other
    columns are ignored; an empty table gives no rows.
    """
    texts = texts_of(docs, id_col, text_col)
    known = texts.filter("id is not null")
    rows = cut(anchor_rows(known, window, gram), "anchors")
    found = entries(rows)
    count = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "counts")  # cut: else the join can't split a hot key
    places = found.join(count, "key").select(F.lit(0).alias("era"), "id", "place", F.ceil(F.col("c") / most).cast("int").alias("parts"))
    places = by_text(places)
    drop_cut(rows, count)
    runs = repeated_windows(known.select(F.lit(0).alias("era"), "id", "text"), places, window, gram)
    marked = known.join(runs.select("id", "runs"), "id", "left").unionByName(texts.filter("id is null"), allowMissingColumns=True)
    return removed_digest(marked, window)
