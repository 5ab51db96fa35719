"""Line dedup over content-defined chunks of lines.

Lines here are lines with words; blank ones belong to the line before. Chunks of lines end where a
rolling hash over the hashes of the last two lines says so, so that lines put in before or after
a passage move no boundary inside it. Repeated chunks are found first, one row a chunk. The
edges of a repeated passage, and passages too short to hold a whole chunk, are found among the
chunks that stay by their pairs of neighbouring lines. Every text compared by hash is compared
by its bytes before anything is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlass.llm.common import keeping, landed

#: A chunk ends after a line if the rolling hash of it and the line before is 0 modulo this.
DIVISOR = 4
#: A line of this many words or more is a passage by itself.
LONG_LINE = 50
_PRIME = (1 << 61) - 1


def lines_of(text: bytes) -> list[tuple[int, int]]:
    """(start, end) in bytes of the lines with words, newlines left out."""
    found, at = [], 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            found.append((at, at + len(line)))
        at += len(line) + 1
    return found


def chunks_of(text: bytes) -> list[tuple[int, int]]:
    """(first, past the last) line of each content-defined chunk of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    chunks, start, before, lines = [], 0, 0, lines_of(text)
    for k, (a, b) in enumerate(lines):
        h = xxh64_intdigest(text[a:b]) % _PRIME
        if (before * 257 + h) % _PRIME % DIVISOR == 0 or k == len(lines) - 1:
            chunks.append((start, k + 1))
            start = k + 1
        before = h
    return chunks


def _chunk_rows(batches: Iterator) -> Iterator:
    """Of each text: its chunks' places and hashes, each with the pairs of lines that begin in it
    (the last one reaches into the next chunk) and its long lines; no text leaves."""
    import pyarrow as pa
    from xxhash import xxh3_64_intdigest

    unit = pa.struct([("h", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("units", pa.list_(unit))])
    for batch in batches:
        out: list[list] = [[] for _ in schema]
        for doc_id, th, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            text = value.as_py() or b""
            lines = lines_of(text)
            digest = lambda a, b: (h := xxh3_64_intdigest(text[a:b])) - (h >> 63 << 64)
            made = lambda a, b: (digest(a, b), a, b - a)
            for first, past in chunks_of(text):
                a, b = lines[first][0], lines[past - 1][1]
                units = [made(lines[k][0], lines[k + 1][1]) for k in range(first, min(past, len(lines) - 1))]
                units += [made(x, y) for x, y in lines[first:past] if y - x >= 2 * LONG_LINE - 1 and len(text[x:y].split()) >= LONG_LINE]
                row = (doc_id, th, a, b - a, past - first, digest(a, b), [dict(zip(("h", "at", "size"), u, strict=True)) for u in units])
                for column, x in zip(out, row, strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)


def _copies(pieces: DataFrame) -> DataFrame:
    """Of (h, doc_id, th, at, size): those whose hash and size stand in an earlier place, with it.
    The least place of each hash is found by counts with map-side combining; only what is repeated is
    joined with it."""
    place = F.struct("doc_id", "th", "at")
    firsts = landed(pieces.groupBy("h", "size").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").select("h", "size", "first"))
    return pieces.join(firsts, ["h", "size"]).where(place != F.col("first"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeated_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, at, end, first): the pieces to remove, with places in bytes of the UTF-8 text
    (``th`` is its hash, as rows under one id may hold several texts; ``end`` takes in the line's
    newline), and the place of the equal piece that stays.

    A piece is two neighbouring lines, or one long line, that stand at an earlier (doc_id, th,
    at) too. Chunks that repeat are taken out whole before pairs are compared; the first place of
    a pair is never inside such a copy, so nothing is missed by that.
    """
    rows = _texts(docs, id_col, text_col).where("doc_id is not null")
    kinds = "doc_id long, th long, at int, size int, n int, h long, units array<struct<h:long,at:int,size:int>>"
    chunks = landed(rows.mapInArrow(_chunk_rows, kinds))
    gone = landed(_copies(chunks.where("n > 1").select("h", "doc_id", "th", "at", "size")))
    marked = chunks.join(gone.select("doc_id", "th", "at", F.lit(True).alias("gone")).distinct(), ["doc_id", "th", "at"], "left")
    units = marked.select("doc_id", "th", F.col("at").alias("_at"), F.col("size").alias("_size"), "gone", F.explode("units").alias("u"))
    # Of a copied chunk only the pair that reaches out of it is compared.
    units = units.where("gone is null or u.at + u.size > _at + _size").select("u.h", "doc_id", "th", "u.at", "u.size")
    found = landed(gone.select("h", "doc_id", "th", "at", "size", "first").unionByName(_copies(units).select("h", "doc_id", "th", "at", "size", "first")))
    # The bytes of the copies and of what stays are cut from the texts, and compared.
    stays = found.select("h", "size", "first").distinct().select("h", "first.doc_id", "first.th", "first.at", "size", F.lit(True).alias("stays"))
    places = found.select("h", "doc_id", "th", "at", "size", F.lit(False).alias("stays")).unionByName(stays)
    spots = places.groupBy("doc_id", "th").agg(F.collect_set(F.struct("h", "at", "size", "stays")).alias("spots")).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    held = landed(
        rows.join(spots, (rows["doc_id"] == spots["_id"]) & (rows["th"] == spots["_th"]))
        .select("doc_id", "th", "text", F.explode("spots").alias("s"))
        .select(
            "s.h", "s.stays", "doc_id", "th", "s.at",
            F.least(F.col("s.at") + F.col("s.size") + 1, F.octet_length("text")).alias("end"),
            "s.size", F.substring(F.col("text").cast("binary"), F.col("s.at") + 1, F.col("s.size")).alias("piece"),
        )
    )
    kept = held.where("stays").select("h", "size", F.col("piece").alias("kept"), F.struct("doc_id", "th", "at").alias("first")).dropDuplicates(["h", "size"])
    return held.where("not stays").join(kept, ["h", "size"]).where("piece = kept").select("doc_id", "th", "at", "end", "first").distinct()


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _th, n, b, s): of each text with repeats, how many stretches go, their bytes, and the
    sorted stretches (at, size, first). Overlapping and touching pieces are one stretch."""
    pieces = repeated_pieces(docs, id_col, text_col)
    order = Window.partitionBy("doc_id", "th").orderBy("at", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = pieces.withColumn("new", F.when(F.col("at") <= reached, 0).otherwise(1))
    runs = begun.withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "th", "run")
    runs = runs.agg(F.min("at").alias("at"), (F.max("end") - F.min("at")).alias("size"), F.min_by("first", F.struct("at", "end")).alias("first"))
    per = runs.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    return per.agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.array_sort(F.collect_list(F.struct("at", "size", "first"))).alias("s"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_removed, removed_bytes, spans, firsts), one row per row of ``docs``: the stretches
    to remove as sorted (at, size) in bytes, and where the first piece of each stays (doc_id, at).

    A null or empty text has no lines; rows without an id keep all of theirs; repeated rows are
    one document, and texts that share an id are compared as texts of their own; extra columns
    are not read.
    """
    gone = _spans(docs, id_col, text_col)
    ids = _texts(docs, id_col, text_col).select("doc_id", "th")
    return ids.join(gone, (ids["doc_id"] == gone["_id"]) & (ids["th"] == gone["_th"]), "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("b", F.lit(0)).cast("long").alias("removed_bytes"),
        F.coalesce(F.transform("s", lambda x: F.struct(x["at"], x["size"])), F.array()).cast("array<struct<at:int,size:int>>").alias("spans"),
        F.coalesce(F.transform("s", lambda x: F.struct(x["first"]["doc_id"].alias("doc_id"), x["first"]["at"].alias("at"))), F.array()).cast("array<struct<doc_id:bigint,at:int>>").alias("firsts"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated stretches cut out of their texts, columns and rows unchanged."""

    def body(d: DataFrame) -> DataFrame:
        gone = _spans(d, id_col, text_col).select("_id", "_th", F.col("s").alias("_spans"))
        text = d[text_col].cast("string")
        joined = d.join(gone, (d[id_col].cast("long") == gone["_id"]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == gone["_th"]), "left")
        cleaned = F.when(gone["_spans"].isNull(), text).otherwise(without(text, gone["_spans"]))
        return joined.select(*[cleaned.alias(c) if c == text_col else d[c] for c in d.columns])

    return keeping(docs, (), body)


def without(text: Column, spans: Column) -> Column:
    """``text`` without ``spans``, a sorted array of (at, size) in bytes of its UTF-8 form."""
    raw = text.cast("binary")
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["at"] + s["size"]))
    ends = F.concat(F.transform(spans, lambda s: s["at"]), F.array(F.octet_length(text)))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(raw, a + 1, b - a).cast("string")), "")
