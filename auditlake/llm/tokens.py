"""Encoding of a corpus with a public byte-level BPE vocabulary.

Short texts are encoded in one go. Long ones are cut into overlapping chunks that are
pre-tokenised in parallel; two neighbours are stitched at the first place of their overlap where
both see a pre-token begin after a character that is no white space (a run of white space looks
at what follows it). The pattern looks only ahead, so from such a place on both see the same
pre-tokens, and the pieces between stitches can be encoded on their own. Bytes of the pieces' ids,
put together, are the text again.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("AUDITLAKE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 1_024

_encoders: dict[int, object] = {}


def _encoder(ranks: bytes):
    """The encoding of a rank file's bytes, kept for the life of a Python worker."""
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def _rank_bytes(folder: str, name: str) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def _measure(ids: bool) -> tuple[str, Callable]:
    return ("array<int>", lambda x: x) if ids else ("bigint", len)


def _column(values: list, ids: bool) -> pa.Array:
    if not ids:
        return pa.array(values, pa.int64())
    import numpy as np

    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.fromiter((i for v in values for i in v), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encode_text(ids: bool, ranks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces the last column, a text, by its ids or their number; repeated texts of a batch are encoded once."""
    shape = _measure(ids)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks.value).encode_ordinary
        for batch in batches:
            seen: dict[str, object] = {}
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                text = text or ""
                if text not in seen:
                    seen[text] = shape(encode(text))
                out.append(seen[text])
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, _column(out, ids)], [*batch.schema.names[:-1], "_ids"])

    return run


def _cut(size: int, overlap: int):
    """(uid, id, text) to overlapping chunks (uid, id, k, chunk)."""

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                starts = range(0, len(text), size)
                named = batch.slice(i, 1).take(pa.array([0] * len(starts), pa.int32()))
                yield pa.RecordBatch.from_arrays([named.column(0), named.column(1), pa.array(range(len(starts)), pa.int32()), pa.array([text[s : s + size + overlap] for s in starts], pa.string())], ["_uid", "_id", "_k", "_chunk"])

    return run


def _pretokenise(size: int, overlap: int):
    """Adds where pre-tokens begin in the head and in the tail overlap of each chunk, as offsets of the text."""

    def run(batches):
        import regex

        pattern = regex.compile(PATTERN)
        for batch in batches:
            head, tail = [], []
            for k, chunk in zip(batch.column("_k").to_pylist(), batch.column("_chunk").to_pylist(), strict=True):
                begins = [b for m in pattern.finditer(chunk) if (b := m.start()) and not chunk[b - 1].isspace()]
                head.append([b + k * size for b in begins if b < overlap])
                tail.append([b + k * size for b in begins if b >= size])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, kind), pa.array(tail, kind)], [*batch.schema.names, "_head", "_tail"])

    return run


def _long_texts(long: DataFrame, ids: bool, ranks, size: int, overlap: int) -> DataFrame:
    """(_id, _ids) of the texts of more than one chunk; ``_uid`` tells texts of one id apart and goes with their pieces."""
    kind = _measure(ids)[0]
    of = f"_uid bigint, _id {long.schema['_id'].dataType.simpleString()}"
    chunks = long.select("_uid", "_id", "_text").mapInArrow(_cut(size, overlap), f"{of}, _k int, _chunk string")
    seen = chunks.repartition("_uid", "_k").mapInArrow(_pretokenise(size, overlap), f"{of}, _k int, _chunk string, _head array<bigint>, _tail array<bigint>")
    doc = Window.partitionBy("_uid")
    order = doc.orderBy("_k")
    stitched = (
        seen.withColumn("_from", F.when(F.col("_k") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("_head", F.lag("_tail").over(order)))))
        .withColumn("_to", F.lead("_from").over(order))
        .withColumn("_last", F.col("_k") == F.max("_k").over(doc))
        # The last stretches of a text may lie wholly in the overlap of the chunk before: those need no stitch.
        .withColumn("_whole", F.max(F.when(F.col("_from").isNull(), 1).otherwise(0)).over(doc) == 1)
    )
    begin = F.col("_from") - F.col("_k") * F.lit(size)
    length = F.when(F.col("_last"), F.lit(2**30)).otherwise(F.col("_to") - F.col("_from"))
    piece = F.when(F.col("_whole"), F.substring("_chunk", F.lit(1), F.lit(size))).otherwise(F.substring(F.col("_chunk"), (begin + 1).cast("int"), length.cast("int")))
    pieces = stitched.select("_uid", "_id", "_k", "_whole", piece.alias("_piece"))
    # A text whose chunks never meet at a common beginning (one endless run) is put together and encoded whole.
    done = pieces.where(~F.col("_whole")).select("_uid", "_id", "_k", "_piece").mapInArrow(_encode_text(ids, ranks), f"{of}, _k int, _ids {kind}")
    gathered = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_ids"))), lambda x: x["_ids"])) if ids else F.sum("_ids")
    stitched_ids = done.groupBy("_uid").agg(F.first("_id").alias("_id"), gathered.alias("_ids")).select("_id", "_ids")
    endless = pieces.where("_whole").groupBy("_uid").agg(F.first("_id").alias("_id"), F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("_k", "_piece"))), lambda x: x["_piece"])).alias("_text"))
    endless_ids = endless.select("_id", "_text").mapInArrow(_encode_text(ids, ranks), f"_id {long.schema['_id'].dataType.simpleString()}, _ids {kind}")
    return stitched_ids.unionByName(endless_ids)


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    out: str = "ids",
    count_only: bool = False,
    folder: str = TOKENIZER_DIR,
    vocabulary: str = BYTE_BPE_50K,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """(id, ids) of every row, or (id, number of ids) with ``count_only``.

    Null and empty texts have the empty list (0). Strings that look like special tokens are
    ordinary text. Repeated ids stay repeated, null ids stay null; other columns are ignored.
    ``folder`` names the tokenizer files; the vocabulary's ranks (under 1 MB whatever the data)
    travel to the executors as a broadcast, so they need no copy of the folder.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(_rank_bytes(folder, vocabulary))
    kind = _measure(not count_only)[0]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    size = F.coalesce(F.length("_text"), F.lit(0))
    short = rows.where(size <= chunk_chars).mapInArrow(_encode_text(not count_only, ranks), f"_id {id_type}, _ids {kind}")
    # The number only tells rows apart; it travels with the row's id and pieces and is never joined to another read.
    long = rows.where(size > chunk_chars).withColumn("_uid", F.monotonically_increasing_id())
    named = _long_texts(long, not count_only, ranks, chunk_chars, overlap_chars)
    return short.unionByName(named).select(F.col("_id").alias(id_col), F.col("_ids").alias(out))


def decode(ids: list[int], folder: str = TOKENIZER_DIR, vocabulary: str = BYTE_BPE_50K) -> str:
    """The text of a list of ids: the bytes of each, put together."""
    return _encoder(_rank_bytes(folder, vocabulary)).decode_bytes(ids).decode("utf-8")
