"""Best-fit packing planned on the histogram of lengths.

1. Texts become token ids in Arrow batches; each document ends with one
   end id, and only documents longer than the capacity are cut.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the
   size of the corpus) is packed best-fit decreasing over counts.  The plan is
   a list of runs: "ranks lo..hi of this length go to these sequences, so many
   to each, from this offset on".
3. Pieces get a rank within their length and take the planned slot by joining
   on (length, rank).  A length that holds many pieces is ranked in salted
   parts whose sizes are then summed up, so no task gets all pieces of a length.

Defined results: a null text is an empty one; an empty document is one piece
that holds the end id; a text of any length is encoded as a whole and cut into
pieces; repeated rows are packed as often as they occur; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.workspace import materialise

#: Word pieces whose ids a Python worker remembers; beyond that it starts anew.
CACHE_ENTRIES = 600_000
#: Bytes of text that are encoded together; a longer text is alone.
GROUP_BYTES = 8 << 20
#: New word pieces that go to the tokenizer as one text.
JOINED = 2_000
#: Pieces that one salted part of a length should hold.
PART_ROWS = 200_000

# Letters, marks and punctuation that NFC leaves alone and that have a one-to-one
# lower case; other characters are left to the tokenizer itself.
_PLAIN = r"^[\x21-\x7e¡-įı-ſ‐-‧]*$"
# Letters, then punctuation: two word pieces. With an apostrophe it might be more.
_SIMPLE = r"^\p{L}*[^\p{L}\p{N}\s']*$"

# The normaliser and word rule under which texts may be taken apart at white space.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("ids_crc32", T.LongType(), False),
    ]
)


@dataclass(frozen=True)
class Tokens:
    """Where the vocabulary file is and which id ends a document."""

    path: str
    end_id: int = 1


class ChunkTokenizer:
    """Ids of a column of texts.

    Where the vocabulary file says that texts are normalised character by
    character and never joined across white space, the ids of a text are those
    of its chunks, and a chunk of letters and punctuation has those of its two
    word pieces.  Chunks are split and counted as Arrow arrays, only distinct
    ones are looked at one by one, and pieces that are new go to the tokenizer
    many at a time, cut apart at the tokens that end a word.  Texts with unusual
    characters or with a special token go through the tokenizer whole, and so
    do all texts if the file has another normaliser or word rule.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES) -> None:
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model, self._special = rules["model"], [t["content"] for t in rules.get("added_tokens", [])]
        self.by_chunk = (
            rules.get("normalizer") == _NORMALIZER
            and rules.get("pre_tokenizer") == _PRE_TOKENIZER
            and rules.get("post_processor") is None
            and rules.get("truncation") is None
            and rules.get("padding") is None
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and not model.get("continuing_subword_prefix")
            and bool(model.get("end_of_word_suffix"))
            and not any(c.isspace() for t in self._special for c in t)
        )
        if self.by_chunk:
            suffix, vocab = model["end_of_word_suffix"], model["vocab"]
            self._ends = np.zeros(max(vocab.values()) + 1, bool)
            self._ends[[k for word, k in vocab.items() if word.endswith(suffix)]] = True
        self._entries = entries
        self._forget()

    def _forget(self) -> None:
        self._index: dict[str, int] = {"": 0}
        self._start, self._length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._ids, self._filled = np.zeros(4096, np.uint32), 0

    def _encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self._whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words that are one word piece each."""
        out: list[np.ndarray] = []
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            ids = self._encode_whole([" ".join(part)])[0]
            ends = np.flatnonzero(self._ends[ids]) + 1
            out += np.split(ids, ends[:-1]) if len(ends) == len(part) and ends[-1] == len(ids) else self._encode_whole(part)
        return out

    def _add(self, words: list[str], ids: list[np.ndarray]) -> None:
        first, count = len(self._index), len(words)
        lengths = np.array([len(x) for x in ids], np.int64)
        while first + count > len(self._start):
            self._start, self._length = np.concatenate((self._start, np.zeros_like(self._start))), np.concatenate((self._length, np.zeros_like(self._length)))
        while self._filled + lengths.sum() > len(self._ids):
            self._ids = np.concatenate((self._ids, np.zeros_like(self._ids)))
        self._start[first : first + count] = self._filled + np.cumsum(lengths) - lengths
        self._length[first : first + count] = lengths
        total = int(lengths.sum())
        self._ids[self._filled : self._filled + total] = np.concatenate([*ids, np.zeros(0, np.uint32)])
        self._filled += total
        self._index.update(zip(words, range(first, first + count), strict=True))

    def _places(self, pieces: pa.Array, one_word: bool) -> np.ndarray:
        """Places of the pieces' ids; new pieces are encoded first."""
        pieces = pieces.dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [p for p in distinct if p not in self._index]
        if new:
            self._add(new, (self._encode_words if one_word else self._encode_whole)(new))
        places = np.fromiter(map(self._index.__getitem__, distinct), np.int64, len(distinct))
        return places[np.asarray(pieces.indices)]

    def _chunk_places(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of both word pieces of each distinct chunk; mixed chunks are one piece."""
        lower = pc.utf8_lower(chunks)
        simple = pc.match_substring_regex(lower, _SIMPLE)
        mixed = pc.if_else(simple, "", lower)
        lower = pc.if_else(simple, lower, "")
        heads = pc.replace_substring_regex(lower, r"[^\p{L}]*$", "", max_replacements=1)
        tails = pc.replace_substring_regex(lower, r"^\p{L}*", "", max_replacements=1)
        first, second = self._places(heads, True), self._places(tails, True)
        return np.maximum(first, self._places(mixed, False)), second

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, each text followed by ``end_id``, and their n + 1 offsets."""
        texts = texts.cast(pa.large_string()).fill_null("")
        rows = len(texts)
        whole = np.full(rows, not self.by_chunk)
        if self.by_chunk:
            if len(self._index) > self._entries:
                self._forget()
            split = pc.ascii_split_whitespace(texts)
            chunks = split.flatten().dictionary_encode()
            code, distinct = np.asarray(chunks.indices), chunks.dictionary
            bounds = np.asarray(split.offsets).astype(np.int64)
            bounds = bounds - bounds[0]
            odd = pc.invert(pc.match_substring_regex(distinct, _PLAIN))
            for special in self._special:
                odd = pc.or_(odd, pc.match_substring(distinct, special))
            odd = np.asarray(odd.cast(pa.uint8())).astype(bool)
            if odd.any():
                whole = np.concatenate(([0], np.cumsum(odd[code])))
                whole = whole[bounds[1:]] > whole[bounds[:-1]]
                distinct = pc.if_else(pa.array(odd), "", distinct)
            first, second = self._chunk_places(distinct)
            # Two pieces a chunk, in order; those of a row are together.
            places = np.stack((first[code], second[code]), axis=1).reshape(-1)
            bounds = bounds * 2
        else:
            places, bounds = np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
        lengths = self._length[places]
        before = np.concatenate(([0], np.cumsum(lengths)))
        known = self._ids[np.repeat(self._start[places] - before[:-1], lengths) + np.arange(before[-1])]
        at = before[bounds]
        others = dict(zip(np.flatnonzero(whole).tolist(), self._encode_whole(texts.filter(pa.array(whole)).to_pylist()), strict=True)) if whole.any() else {}
        sizes = np.diff(at)
        for row, ids in others.items():
            sizes[row] = len(ids)
        offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
        out = np.full(offsets[-1], end_id, "<u4")
        taken = np.repeat(~whole, np.diff(at))
        start = np.repeat(offsets[:-1] - at[:-1], np.diff(at))
        out[(start + np.arange(len(known)))[taken]] = known[taken]
        for row, ids in others.items():
            out[offsets[row] : offsets[row] + len(ids)] = ids
        return out, offsets


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkTokenizer(path)


def groups(texts: pa.Array) -> Iterator[slice]:
    """Ranges of rows with about GROUP_BYTES of text each."""
    size = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64))
    first = 0
    while first < len(size):
        done = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, done + GROUP_BYTES, "right")))
        yield slice(first, last)
        first = last


def tokenize(docs: DataFrame, tokens: Tokens, capacity: int) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokens.path)
        for batch in batches:
            for rows in groups(batch.column(1)):
                ids, offsets = encoder.encode(batch.column(1)[rows], tokens.end_id)
                size = np.diff(offsets)
                many = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                length = np.minimum(capacity, size[row] - piece * capacity)
                at = offsets[row] + piece * capacity
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0)[rows].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, PIECES.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram; returns the runs and the number of sequences.

    A run is (length, rank_lo, rank_hi, first_sequence, per_sequence, offset):
    rank r goes to sequence first + (r - lo) // per at offset + ((r - lo) % per) * length.
    The work depends on the number of lengths and runs, not on the counts.
    """
    import bisect

    runs: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free ids -> ranges (first sequence, how many)
    sizes: list[int] = []  # sorted keys of room
    opened = 0

    def give(free: int, first: int, many: int) -> None:
        if free and many:
            if free not in room:
                room[free] = []
                bisect.insort(sizes, free)
            room[free].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                free = sizes[at]
                first, many = room[free].pop()
                if not room[free]:
                    del room[free]
                    sizes.pop(at)
            else:
                free = capacity
                first, many = opened, -(-left // (capacity // length))
                opened += many
            per = free // length
            full, rest = divmod(min(left, many * per), per)
            took = full * per + rest
            runs.append((length, rank, rank + took, first, per, capacity - free))
            give(free - per * length, first, full)
            if rest:
                give(free - rest * length, first + full, 1)
            give(free, first + full + bool(rest), many - full - bool(rest))
            rank, left = rank + took, left - took
    return runs, opened


def pack(docs: DataFrame, tokens: Tokens, capacity: int = 4096) -> DataFrame:
    """All pieces of ``docs`` with their place: PIECES plus sequence_id and offset."""
    spark = docs.sparkSession
    pieces = materialise(tokenize(docs, tokens, capacity), "pieces")  # stable, and tokenised once
    counts = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    runs, _ = plan_best_fit(counts, capacity)
    total = sum(counts.values())
    part_rows = max(1, min(PART_ROWS, total // (4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    plan = spark.createDataFrame(runs or [(0,) * 6], "length long, lo long, hi long, first long, per long, base long")
    parts = spark.createDataFrame([(k, -(-n // part_rows)) for k, n in counts.items()] or [(0, 1)], "length long, parts long")

    # Both broadcast tables have a row for each length (capacity at most) or run of the plan.
    salted = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "parts")).drop("parts")
    sizes = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "part"])
    placed = ranked.withColumn("rank", F.col("rank") + F.col("before")).join(
        F.broadcast(plan), (ranked.length == plan.length) & (F.col("rank") >= plan.lo) & (F.col("rank") < plan.hi)
    )
    k = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        pieces.length,
        "ids_crc32",
        (F.col("first") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(k, F.col("per")) * plan.length).cast("long").alias("offset"),
    )


