"""Token ids in files: concatenated ids in blocks, document boundaries as Elias-Fano codes.

The files are Parquet, so Spark's committer decides which attempt of a task counts. A row is a block of whole documents,
in ascending order of their keys:

``shard``, ``block``     order of the blocks
``doc_ids``              keys of its documents
``width``, ``ids``       bytes an id takes (2 where the vocabulary allows), and the ids, little-endian
``n_ids``                how many
``low_bits``, ``low``, ``high``, ``samples``  where each document begins: see ``elias_fano``

No block has a table of 64-bit offsets. What precedes a block is summed when reading: by block inside a shard, and over
shards, of which there are as many as write tasks.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from choicerank.llm.common import KEEP, held, slices, texts
from choicerank.llm.elias_fano import EliasFano

#: Ids in a block, unless one document has more.
BLOCK_IDS = 1_000_000

LAYOUT = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                    ("width", pa.int32()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("low_bits", pa.int32()),
                    ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
FIELDS = ("shard int, block int, doc_ids array<bigint>, width int, n_ids bigint, ids binary, low_bits int, "
          "low binary, high binary, samples binary")


class ChunkEncoder:
    """Encodes texts by a tokenizer whose pre-tokens never cross ASCII white space, chunk by chunk.

    Arrow cuts the texts of a batch and finds its distinct chunks; words met before are not encoded again. ``KEEP`` bounds
    what is remembered and changes no result. New words go to the tokenizer many in a string, and are told apart by the ids
    that end a word.
    """

    #: ASCII marks but the apostrophe, with which pre-tokens may begin.
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: Words in a string.
    RUN = 50
    #: Letters that no normalizer takes apart or joins with their neighbours.
    PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")
    #: Marks that may join an ASCII letter. The tokenizer composes before it lower-cases, and not all compose in both cases.
    JOINS = r"[\x{0300}-\x{036f}]"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        # Texts in which case may matter: a special token is one in its own case only.
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cased = "|".join([self.JOINS, *(f"(?i:{t})" for t in special)])
        self.words: dict[str, bytes] = {}  # other chunks under a space before them

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Of words of plain letters, each a pre-token."""
        out: list[bytes] = []
        runs = [words[i:i + self.RUN] for i in range(0, len(words), self.RUN)]
        found = self.tokenizer.encode_batch_fast([" ".join(run) for run in runs], add_special_tokens=False)
        for run, e in zip(runs, found):
            ids = np.array(e.ids, f"<u{self.width}")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(run) or ends[-1] != len(ids):  # a tokenizer that marks no ends
                out += self._encode(run)
                continue
            raw, at = ids.tobytes(), (ends * self.width).tolist()
            out += map(raw.__getitem__, map(slice, [0, *at], at))
        return out

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """A word and the marks after it are pre-tokens of their own; other chunks stay whole."""
        if len(self.words) + len(chunks) > 3 * KEEP:
            self.words.clear()
        words, marks = self.words, self.MARKS
        cores = [c.rstrip(marks) for c in chunks]
        plain, whole, simple = [], [], self.PLAIN.fullmatch
        for word in set(cores).difference(words):
            if simple(word):
                plain.append(word)
            elif word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha():  # else a mark could join its end
                whole.append(word)
        words.update(zip(plain, self._encode_words(plain)))
        words.update(zip(whole, self._encode(whole)))
        found = list(map(words.get, cores))
        tails = [c[len(core):] for c, core in zip(chunks, cores)]
        each = list(set(tails))
        tail = dict(zip(each, self._encode(each)))
        odd = [" " + c for c, ids in zip(chunks, found) if ids is None]
        fresh = list(set(odd).difference(words))
        words.update(zip(fresh, self._encode([c[1:] for c in fresh])))
        others = map(words.__getitem__, odd)
        return [next(others) if ids is None else ids + tail[t] if t else ids for ids, t in zip(found, tails)]

    def __call__(self, batch: pa.Array, end: int) -> list[bytes]:
        lower = pc.if_else(pc.match_substring_regex(batch, self.cased), batch, pc.ascii_lower(batch))
        cut = pc.ascii_split_whitespace(lower)
        chunks = cut.flatten().dictionary_encode()
        kind = f"<u{self.width}"
        ids = self.ids_of(chunks.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), kind)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        which = chunks.indices.to_numpy()
        many = sizes[which]
        ends = np.r_[0, np.cumsum(many)]
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], many)
        at += np.arange(len(at))
        raw, last = flat[at].tobytes(), end.to_bytes(self.width, "little")
        bounds = (ends[np.r_[0, np.cumsum(pc.list_value_length(cut).to_numpy())]] * self.width).tolist()
        return [raw[a:b] + last for a, b in zip(bounds, bounds[1:])]


def write_tokens(docs: DataFrame, folder: str, path: str, end: int, key: str = "doc_id", text: str = "text",
                 block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts, append ``end`` to each, and write them in ascending order of the key (a whole number).

    Null texts are empty, null keys come first, rows with equal keys are ordered by text. No rows, no files but the
    schema. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memory = held("files")
        if path not in memory:
            memory[path] = ChunkEncoder(path)
        encoder, shard = memory[path], TaskContext.get().partitionId()
        block, keys, ids, starts, total = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            code = EliasFano.of(np.array(starts), total)
            row = {"shard": shard, "block": block, "doc_ids": list(keys), "width": encoder.width, "n_ids": total,
                   "ids": b"".join(ids), "low_bits": code.low_bits, "low": code.low, "high": code.high,
                   "samples": code.samples}
            return pa.RecordBatch.from_pylist([row], schema=LAYOUT)

        for batch in batches:
            for part in slices(batch):
                for k, x in zip(part.column("key").to_pylist(), encoder(part.column("text"), end)):
                    n = len(x) // encoder.width
                    if keys and total + n > block_ids:
                        yield flush()
                        block, total = block + 1, 0
                        keys.clear(), ids.clear(), starts.clear()
                    keys.append(k), ids.append(x), starts.append(total)
                    total += n
        if keys:
            yield flush()

    rows = texts(docs, key, text).select(F.col(key).cast("bigint").alias("key"), "text")
    rows.repartitionByRange("key").sortWithinPartitions("key", "text").mapInArrow(run, FIELDS).write.parquet(folder)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FIELDS).parquet(folder)


def block_starts(blocks: DataFrame) -> DataFrame:
    """``shard``, ``block``, ``base``: ids before each block."""
    sizes = blocks.select("shard", "block", "n_ids")
    shards = (sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))
              .select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before")))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    return sizes.withColumn("inside", inside).join(shards, "shard").select(
        "shard", "block", (F.col("before") + F.col("inside")).alias("base"))


def boundaries(code: dict) -> np.ndarray:
    """Where the documents of a block begin, and its end."""
    n = len(code["doc_ids"])
    starts = EliasFano(n, code["low_bits"], code["low"], code["high"], code["samples"]).all()
    return np.append(starts, code["n_ids"])


def documents(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``start``, ``n_tokens``, ``ids_crc32``, read from the files."""
    blocks = read_blocks(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                at = boundaries(block)
                ids = np.frombuffer(block["ids"], f"<u{block['width']}").astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["doc_ids"], pa.int64()), pa.array([block["shard"]] * n, pa.int32()),
                     pa.array([block["block"]] * n, pa.int32()), pa.array(at[:-1], pa.int64()),
                     pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())],
                    ["key", "shard", "block", "inner", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(run, "key bigint, shard int, block int, inner bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(block_starts(blocks), ["shard", "block"]).select(
        F.col("key").alias(key), (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
