"""Fill-in-middle: documents rearranged so that a model learns to fill gaps.

A text is cut at two line ends into prefix, middle and suffix, and put out as
``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm);
a text that is empty or holds a mark itself stays plain. Cuts and form are
drawn from a digest of the seed and the id, so reruns agree.

The output is assembled by a secondary sort: each document becomes pieces of
at most CHUNK units (lines), keyed by (row, place in the output), and
``repartitionAndSortWithinPartitions`` brings them to their row's partition in
that order, where they stream into a digest: no task holds a text that was
cut up. Restoration reads the same output pieces with nothing but their
form's marks, numbers them by their place in the original and sorts again.
As the rows keep their partition, the second sort moves nothing.

A row is the unit of work, so equal ids, repeated rows and hot sources spread
evenly. Sorts spill to Spark's local disk.

Defined results: null text is the empty text (plain, 0 lines, digests of the
empty string); a null id is drawn as the word ``null``; repeated rows each give a
row; an empty table gives an empty one; only the two named columns are
read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

from pyspark import RDD
from pyspark.rdd import portable_hash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Order of the parts in the output of each form, and in the original.
ORDERS = {"psm": MARKS, "spm": (SUFFIX, PREFIX, MIDDLE)}
ORIGINAL = (PREFIX, MIDDLE, SUFFIX)
#: A piece holds whole units and ends with the unit that reaches so many characters;
#: a longer unit is divided.
CHUNK = 1 << 16
PARTITION_BYTES = 128 << 20

REPORT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())])


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    name = "null" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def plan(doc_id: int | None, text: str, seed: int = SEED, fim: int = FIM_PERCENT,
         spm: int = SPM_PERCENT) -> tuple[int, str, int, int]:
    """(units, form, characters before the middle, characters before the suffix)."""
    n = text.count("\n") + (text[-1:] not in ("", "\n"))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= fim:
        return n, "plain", 0, 0
    ends, at = sorted((h1 % (n + 1), h2 % (n + 1))), []
    done, place = 0, 0
    for end in ends:
        for _ in range(end - done):
            place = text.find("\n", place) + 1 or len(text)
        done = end
        at.append(place)
    return n, "spm" if h4 % 100 < spm else "psm", at[0], at[1]


def chunks(text: str, start: int, end: int) -> Iterator[str]:
    """text[start:end] in pieces of whole lines; lines beyond CHUNK are divided."""
    while start < end:
        stop = min(start + CHUNK, end)
        if stop < end:
            stop = text.rfind("\n", start, stop) + 1 or stop
        yield text[start:stop]
        start = stop


def pieces(row: int, doc_id: int | None, text: str | None, seed: int = SEED, fim: int = FIM_PERCENT,
           spm: int = SPM_PERCENT) -> Iterator[tuple]:
    """((row, place in the output), piece); place 0 holds id, units and form."""
    text = text or ""
    n, form, a, b = plan(doc_id, text, seed, fim, spm)
    yield (row, 0), (doc_id, n, form)
    if form == "plain":
        parts = [(0, len(text))]
    else:
        spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
        parts = [x for mark in ORDERS[form] for x in (mark, spans[mark])]
    place = 0
    for part in parts:
        for piece in [part] if isinstance(part, str) else chunks(text, *part):
            place += 1
            yield (row, place), piece


def assemble(sorted_pieces: Iterator[tuple]) -> Iterator[tuple]:
    """Streams the pieces of each row into the digest of its output, and passes
    them on numbered by (part, place) of the original: what is restored is read
    from the output and its form alone.

    ((row, part, place), piece); part -1 holds id, units, form and digest.
    """
    for row, group in groupby(sorted_pieces, lambda x: x[0][0]):
        digest, part, head = hashlib.sha256(), 0, None
        for (_, place), piece in group:
            if not place:
                head = piece
                continue
            digest.update(piece.encode())
            if head[2] != "plain" and piece in MARKS:
                part = ORIGINAL.index(piece)
            else:
                yield (row, part, place), piece
        yield (row, -1, 0), (*head, digest.hexdigest())


def restore(sorted_pieces: Iterator[tuple]) -> Iterator[tuple]:
    """A row of the report per document."""
    for _, group in groupby(sorted_pieces, lambda x: x[0][0]):
        digest, chars, head = hashlib.sha256(), [0, 0, 0], None
        for (_, part, _), piece in group:
            if part < 0:
                head = piece
                continue
            digest.update(piece.encode())
            chars[part] += len(piece)
        doc_id, n, form, out = head
        lengths = (None, None) if form == "plain" else (chars[0], chars[1])
        yield (doc_id, n, form, *lengths, out, digest.hexdigest())


def by_row(key: tuple) -> int:
    return portable_hash(key[0])


def assembled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, fim: int = FIM_PERCENT,
              spm: int = SPM_PERCENT, partitions: int | None = None) -> RDD:
    """Output pieces by row in output order, rows in one partition each.

    ``row`` numbers the rows of the input by its partitions, which are the same
    when a lost task runs again.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"),
                       F.col(text).alias("text")).rdd
    cut = rows.flatMap(lambda r: pieces(r[0], r[1], r[2], seed, fim, spm))
    return cut.repartitionAndSortWithinPartitions(partitions or _partitions(docs, text), by_row)


def _partitions(docs: DataFrame, text: str) -> int:
    """As many as the session shuffles into, more if a partition would get more
    than PARTITION_BYTES of text."""
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, form, output): the training texts. Each output is one value
    again, so this one holds a text at a time in memory."""
    def join(sorted_pieces):
        for _, group in groupby(sorted_pieces, lambda x: x[0][0]):
            _, head = next(group)
            yield head[0], head[2], "".join(piece for _, piece in group)
    out = assembled(docs, doc_id, text, **options).mapPartitions(join)
    return docs.sparkSession.createDataFrame(out, "doc_id bigint, form string, output string")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document with digests of the output and of the restored text."""
    outputs = assembled(docs, doc_id, text, **options)
    original = outputs.mapPartitions(assemble, preservesPartitioning=True)
    again = original.repartitionAndSortWithinPartitions(outputs.getNumPartitions(), by_row)
    return docs.sparkSession.createDataFrame(again.mapPartitions(restore), REPORT, verifySchema=False)
