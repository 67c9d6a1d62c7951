"""Line dedup: explode normalised lines, hash them, count distinct documents per hash, drop lines over the threshold
and reassemble the rest by position.

Only (hash, document, position) rows are shuffled for counting, and only the positions of dropped lines travel back to
the texts. Counting is a partial aggregate, so a line shared by a third of all documents costs each task one row.

Defined results: a null or empty text is one empty line and comes back as ''; lines whose key is shorter than
``min_chars`` always stay; all lines of one document that hold a key stay or go together; rows that repeat a document
id count as one document per key, and each loses its own lines; an empty table gives no rows; extra columns pass through unchanged
(helper columns start with ``_ld_``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fold_ascii, pin, trimmed

# White space stripped at both ends of a line (fixed by the definition of a key).
STRIP = "\t\n\x0b\x0c\r "


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, id, doc, pos) of every line whose key has at least ``min_chars`` code points; ``doc`` is the text's hash."""
    lines = docs.select(F.col(id_col).alias("_ld_id"), F.xxhash64(text_col).alias("_ld_doc"),
                        F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("_ld_pos", "_ld_line"))
    key = fold_ascii(F.btrim("_ld_line", F.lit(STRIP)))
    return (lines.filter(F.char_length("_ld_line") >= min_chars)
                 .select("_ld_id", "_ld_doc", "_ld_pos", key.alias("_ld_key"))
                 .filter(F.char_length("_ld_key") >= min_chars)
                 .select(F.xxhash64("_ld_key").alias("_ld_h1"), F.xxhash64("_ld_key", F.lit(1)).alias("_ld_h2"),
                         "_ld_id", "_ld_doc", "_ld_pos"))


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                      min_docs: int = 3) -> DataFrame:
    """(id, doc, positions): the lines to drop of each document that loses any."""
    keys = line_keys(docs, id_col, text_col, min_chars)
    once = keys.select("_ld_h1", "_ld_h2", "_ld_id").distinct()
    # written out, so that the join below starts from plain shuffles and a frequent key can be split over tasks
    frequent = pin(once.groupBy("_ld_h1", "_ld_h2")
                       .agg(F.count("*").alias("_ld_n"), F.max("_ld_id").alias("_ld_keep"))
                       .filter(F.col("_ld_n") >= min_docs).drop("_ld_n"))
    return (keys.join(frequent, ["_ld_h1", "_ld_h2"])
                .filter(~F.col("_ld_id").eqNullSafe(F.col("_ld_keep")))
                .groupBy("_ld_id", "_ld_doc").agg(F.collect_set("_ld_pos").alias("_ld_drop")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                min_docs: int = 3, counts: bool = False) -> DataFrame:
    """The documents with ``text_col`` rewritten; with ``counts`` also ``n_lines`` and ``n_dropped``."""
    drop = dropped_positions(docs, id_col, text_col, min_chars, min_docs)
    joined = docs.join(drop, docs[id_col].eqNullSafe(drop["_ld_id"]) & (F.xxhash64(docs[text_col]) == drop["_ld_doc"]), "left")
    columns = docs.columns
    at = columns.index(text_col)
    fields = list(docs.schema.fields)
    if counts:
        fields += [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column(at), batch.column(len(columns))):
                text = text.as_py() or ""
                total, lost = text.count("\n") + 1, 0
                if gone.is_valid:
                    gone = set(gone.as_py())
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
                    lost = len(gone)
                texts.append(text)
                n_lines.append(total)
                n_dropped.append(lost)
            out = [batch.column(i) if i != at else pa.array(texts, batch.schema.field(at).type)
                   for i in range(len(columns))]
            if counts:
                out += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])
    return joined.select(*[docs[c] for c in columns], "_ld_drop").mapInArrow(trimmed(run), T.StructType(fields))
