"""Records of delimited text whose quoted cells may hold line breaks, for texts of any size.

A text is cut into blocks anywhere.  Whether a line break ends a record depends only on whether it stands inside quotes, which a
two-state automaton knows: every double quote changes its state, so a block's effect on it is the parity of its quotes.  A
prefix scan over the blocks (``running_values``) gives the state at each of them, and all true record ends are found in parallel; a second
scan numbers the records.  The result does not depend on the block size.

Defined results: doubled quotes inside a quoted cell change the state twice, as they should; a quote that is never closed
runs to the end of its text; one line break at the end of a text opens no record; a carriage return before a record's end is
dropped; a missing text has no records; rows that share an id, or have none, are texts of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterlight.functions import text
from quarterlight.operators.joins import running_values
from quarterlight.session import stored

BLOCK_CHARS = 1 << 20
#: Pieces of one block at most; a position is the block's number and the piece's.
PLACES = 1 << 31


def text_blocks(docs: DataFrame, content: str, size: int = BLOCK_CHARS) -> DataFrame:
    """Every row's other columns, ``_doc`` (one for each row), ``block_ix`` and ``block``."""
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(content) - 1) / size).cast("int")), lambda i: F.substring(F.col(content), i * size + 1, F.lit(size))
    )
    keyed = docs.filter(F.length(content) > 0).withColumn("_doc", F.monotonically_increasing_id())
    others = [c for c in keyed.columns if c != content]
    return keyed.select(*[F.col(f"`{c}`") for c in others], F.posexplode(cut).alias("block_ix", "block"))


def quoted_records(blocks: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, carry, record_no (from 0), record: of blocks (keys, carry, block_ix, block); keys name one text each.

    A group is the pieces of one record, so its size is that of a result row.
    """
    pieces = F.split("block", "\n")
    rows = blocks.select(*keys, *carry, "block_ix", F.size(pieces).alias("_n"), F.posexplode(pieces).alias("_pos", "_piece"))
    rows = rows.select(*keys, *carry, (F.col("block_ix").cast("bigint") * PLACES + F.col("_pos")).alias("_at"), "_piece", (F.col("_pos") < F.col("_n") - 1).alias("_breaks"))
    quotes = F.length("_piece") - F.length(F.replace(F.col("_piece"), F.lit('"'), F.lit("")))
    stated = running_values(rows, keys, "_at", sums={"_quotes": quotes}, block_rows=PLACES)
    ended = stated.withColumn("_ends", F.col("_breaks") & (F.col("_quotes") % 2 == 0))
    numbered = running_values(ended, keys, "_at", sums={"_closed": F.col("_ends").cast("int")}, block_rows=PLACES)
    numbered = numbered.withColumn("record_no", F.col("_closed") - F.col("_ends").cast("int"))
    kept = F.concat("_piece", F.when(F.col("_breaks") & ~F.col("_ends"), "\n").otherwise(""))
    grouped = numbered.groupBy(*keys, "record_no").agg(F.sort_array(F.collect_list(F.struct("_at", kept.alias("s")))).alias("_ps"), F.max("_ends").alias("_ends"), *[F.first(c).alias(c) for c in carry])
    joined = F.regexp_replace(F.array_join(F.transform("_ps", lambda p: p["s"]), ""), r"\r\z", "")
    return grouped.withColumn("record", joined).filter((F.col("record") != "") | F.col("_ends")).select(*keys, *carry, "record_no", "record")


def delimited_records(docs: DataFrame, content: str = "content", keys: tuple[str, ...] = ("doc_id",), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """keys, record_no, cells: split by the separator found in the first record of its text that is not blank."""
    # Stored, as the scans read the blocks again and must see the same numbers.
    blocks = stored(text_blocks(docs.select(*keys, content), content, block_chars), "blocks")
    records = quoted_records(blocks, ["_doc"], keys)
    filled = F.when(F.trim("record") != "", F.col("record_no"))
    heads = records.groupBy("_doc").agg(F.min_by("record", filled).alias("_head"))
    head = F.col("_head")
    separated = records.join(heads, "_doc").withColumn("_sep", F.when(head.contains("\t"), "\t").when(head.contains("|"), "|").otherwise(","))
    cells = F.when(F.col("_sep") == "\t", text.split_delimited(F.col("record"), "\t"))
    cells = cells.when(F.col("_sep") == "|", text.split_delimited(F.col("record"), "|")).otherwise(text.split_delimited(F.col("record"), ","))
    return separated.select(*keys, "record_no", cells.alias("cells"))
