"""Encoding of a corpus with a public byte-level tokenizer, by overlapping chunks.

Every text is cut into windows of ``chunk`` characters that reach ``overlap`` characters into the next one.  Each
window is looked at by itself.  Between a sign that is no white space and a white space the pre-tokenizer always has a
boundary, whatever stood before, so there the boundaries of neighbouring windows resynchronise: a window owns the
text from the first such place at or after its own begin to the first at or after the next one's.  A window whose
overlap holds no such place hands its piece on, and the piece is stitched to the one before it.  Then the pieces are
encoded and their ids put in order.  Decoding concatenates the raw bytes of the ids.

Texts of more than ``block`` characters are cut twice in the same way: the JVM cuts blocks and spreads them over
tasks, and every block is cut into windows like any other text.  A run without white space is one piece however
long it is, because its pre-tokens may reach through all of it; it must fit into the memory of a task.

Defined cases: a null or empty text has an empty list of ids; special tokens' strings are ordinary text; lone
surrogates become the replacement sign; repeated documents are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK, OVERLAP, BLOCK = 2048, 256, 1 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
#: Fixed value: the published pre-tokenizer pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BOUNDARY = re.compile(r"(?<=\S)[ \n\r\t]")


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file; it goes to every task, so its size is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to go to every task")
    return data


@lru_cache(maxsize=4)
def encoder_of(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    return encoder_of(read_vocabulary(path))


def resync(text: str, at: int) -> int:
    """The first place at or after ``at`` where a blank or line end follows a sign that is no white space; the length if there is none."""
    m = _BOUNDARY.search(text, max(at, 1))
    return m.start() if m else len(text)


def encode_text(text: str | None, vocabulary: str = VOCABULARY) -> list[int]:
    """The ids of a text encoded whole."""
    if not text:
        return []
    return encoder(vocabulary).encode_ordinary(text)


def decode_ids(ids, vocabulary: str = VOCABULARY) -> bytes:
    e = encoder(vocabulary)
    return b"".join(e.decode_single_token_bytes(i) for i in ids)


def owned(window: str, no: int, last: bool, chunk: int, overlap: int) -> tuple[bool, str]:
    """(whether the piece opens at a boundary, the piece that window ``no`` owns).

    All windows but the first begin one sign before their chunk.
    """
    shift = 1 if no else 0
    begin = resync(window[: shift + overlap], shift) if no else 0
    opens = no == 0 or begin < min(len(window), shift + overlap)
    end = len(window) if last else resync(window, shift + chunk)
    if not last and end == len(window):  # no boundary in the overlap: the next window goes on with this run
        end = shift + chunk
    return opens, window[begin if opens else shift : end]


def pieces_of(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The text as pieces that can be encoded one by one: each window on its own, then stitched."""
    out: list[list[str]] = []
    last = (len(text) - 1) // chunk
    for no in range(last + 1):
        window = text[max(no * chunk - 1, 0) : (no + 1) * chunk + overlap]
        opens, piece = owned(window, no, no == last, chunk, overlap)
        if opens:
            out.append([piece])
        else:
            out[-1].append(piece)
    return ["".join(x) for x in out]


def _encoded(keys: list[pa.Array], texts: Sequence[str | None], names: list[str], e, chunk: int, overlap: int) -> pa.RecordBatch:
    """The keys beside the ids of the texts, put together without a Python object for each id."""
    ids, size = [], []
    for t in texts:
        own = [e.encode_to_numpy(p, disallowed_special=()) for p in pieces_of(t, chunk, overlap)] if t else []
        ids += own
        size.append(sum(map(len, own)))
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
    return pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*names, "ids"])


def encode_corpus(documents: DataFrame, key: str, text: str, *, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """(key, ids) of every document."""
    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    long = F.length("text") > block
    kind = documents.schema[key].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(sent.value)
        for b in batches:
            # an Arrow batch may hold many texts: the ids of some at a time stay below the offsets' range
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                yield _encoded([part.column(0)], part.column(1).to_pylist(), ["key"], e, chunk, overlap)

    whole = docs.where(~F.coalesce(long, F.lit(False))).mapInArrow(encode, f"key {kind}, ids array<int>")

    # the JVM cuts the blocks and spreads them over tasks; a block begins one sign before its own part
    last = F.floor((F.length("text") - 1) / block).cast("int")
    window = lambda i: F.substring("text", F.greatest(i * block, F.lit(1)), F.when(i == 0, block + overlap).otherwise(block + overlap + 1))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("no"), window(i).alias("window"), (i == last).alias("last")))
    blocks = docs.where(long).withColumn("doc", F.monotonically_increasing_id()).select("doc", "key", F.explode(cut).alias("c")).select("doc", "key", "c.*").repartition("doc", "no")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [owned(w, no, final, block, overlap) for no, w, final in zip(b["no"], b["window"], b["last"])]
            yield pd.DataFrame({"doc": b["doc"], "key": b["key"], "no": b["no"], "opened": [x for x, _ in found], "body": [x for _, x in found]})

    pieces = blocks.mapInPandas(own, f"doc bigint, key {kind}, no int, opened boolean, body string")
    # a block that does not open continues the run of the last one that does
    run = F.sum(F.col("opened").cast("int")).over(Window.partitionBy("doc").orderBy("no"))
    ordered = lambda c, what: F.transform(F.sort_array(F.collect_list(F.struct("no", what))), lambda x: x[what])
    runs = pieces.withColumn("run", run).groupBy("doc", "key", "run").agg(F.array_join(ordered("no", "body"), "").alias("text"), F.min("no").alias("no")).select("doc", "key", "no", "text").repartition("doc", "no")

    def encode_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(sent.value)
        for b in batches:
            for part in (b.slice(i, 8) for i in range(0, b.num_rows, 8)):
                yield _encoded([part.column(0), part.column(1), part.column(2)], part.column(3).to_pylist(), ["doc", "key", "no"], e, chunk, overlap)

    parts = runs.mapInArrow(encode_runs, f"doc bigint, key {kind}, no int, ids array<int>")
    joined = parts.groupBy("doc", "key").agg(F.flatten(ordered("no", "ids")).alias("ids")).select("key", "ids")
    return whole.unionByName(joined).withColumnRenamed("key", key)
