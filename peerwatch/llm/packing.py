"""Packing tokenised documents into windows of fixed length by non-negative least squares.

A document is cut into full windows and one rest shorter than a window. A task
takes its pieces in groups of bounded number and bytes. All that decides a
group's packing is the histogram of its lengths, `window` numbers: combinations
of two and three lengths that fill a window exactly are enumerated, their repeat
counts solved against the histogram by non-negative least squares, rounded down
and held to what is there, and the residual is packed greedily, again by counts.
Each piece then finds its place from its rank among the pieces of its length.

Only full sequences are closed there. The pieces of the others, few of a large
group, are dealt evenly over a second round of groups and packed the same way.
So nothing but these few crosses a shuffle, nothing is sent to all tasks, and
nothing that grows with the data reaches the driver or one task.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerwatch.llm.common import fresh, ship, table
from peerwatch.sources.staging import stage

WINDOW = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Words a task remembers with their ids.
REMEMBERED = 300_000
#: Bytes of ids in a batch that a task hands over.
BATCH_BYTES = 16 << 20
#: A stretch longer than this goes to the tokenizer whose time grows evenly with length.
LONG = 400
#: Pieces that a task packs together, and bytes of a task's columns that it holds at most, but for one batch.
GROUP = 1 << 15
GROUP_BYTES = 64 << 20
#: Repeat counts are settled when none would move by this much, or by a thousandth of the largest count of a length;
#: they are rounded down to whole ones, and what they leave is packed greedily.
SETTLED = 0.5
#: Combinations whose steps are looked at together.
STRIDE = 256

#: White space other than the space and the line feed, by Unicode.
_RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary never joins a word with a space that follows it, so a text
    falls apart before every space between two non-spaces, and words seen before
    are looked up. Unseen ones are encoded from the same vocabulary as ranks,
    long ones and texts with a special token by the reference tokenizer itself.
    """

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import base64
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary or public_tokenizers.path(VOCABULARY))
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.cut = re.compile(r"(?<=\S)(?= \S)")
        self.seen: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if len(word) > LONG:
            return self._whole(word)
        ids = array("I", self.quick.encode_ordinary(word)).tobytes()
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        if len(word) <= 40:
            self.seen[word] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self.special):
            return self._whole(text)
        if (
            "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
            or any(space in text for space in _RARE_SPACE)
        ):
            words = self.cut.split(text)
        else:
            words = text.replace(" ", "\x00 ").split("\x00") if "\x00" not in text else self.cut.split(text)
        seen = self.seen
        try:
            return b"".join([seen[word] for word in words])
        except KeyError:
            return b"".join([seen.get(word) or self._word(word) for word in words])


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID,
    vocabulary: str | None = None, ranks: str | None = None,
) -> DataFrame:
    """Documents tokenised, ended by `end_id` and cut: (doc_id, start, length, ids, doc_tokens).

    A NULL or empty text is the end id alone. Stage the result before it is read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary, ranks)
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for at, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    cut = ids[4 * start : 4 * (start + window)]
                    rows.append((at, start, len(cut) // 4, cut, total))
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield pack(batch.column(0), rows)
                    rows, held = [], 0
            if rows:
                yield pack(batch.column(0), rows)

    def pack(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        at, start, size, cut, total = zip(*rows)
        columns = [
            ids.take(pa.array(at)), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(cut, pa.binary()),
            pa.array(total, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens"])

    ship()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint"
    return rows.mapInArrow(run, schema)


def fit_repeats(histogram: np.ndarray, combinations: list[tuple[int, ...]], settled: float = SETTLED) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' lengths nearest to the histogram, in least squares.

    Coordinate descent: each step is the exact minimum along one combination,
    held at zero, and is taken if it moves the count by `settled` or more. It ends
    when no step does; each one lowers the squared distance by at least
    2 * settled**2, so it always ends.
    """
    x = np.zeros(len(combinations))
    if not combinations:
        return x
    left = histogram.astype(float)  # nothing has length 0, which fills up shorter combinations below
    deepest = max(map(len, combinations))
    members = np.array([c + (0,) * (deepest - len(c)) for c in combinations])
    norms = np.array([sum(c.count(length) for length in c) for c in combinations], float)
    moved = True
    while moved:
        moved = False
        for at in range(0, len(x), STRIDE):
            near = slice(at, at + STRIDE)
            steps = np.maximum(left[members[near]].sum(axis=1) / norms[near], -x[near])
            for i in (at + np.nonzero(np.abs(steps) >= settled)[0]).tolist():
                lengths = combinations[i]
                step = max(-x[i], sum(left[length] for length in lengths) / norms[i])
                if abs(step) >= settled:
                    moved = True
                    x[i] += step
                    for length in lengths:
                        left[length] -= step
    return x


def combinations(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[int, ...]]:
    """Pairs, then triples, of lengths present that fill a window exactly."""
    there = [length for length in range(1, window) if histogram[length]]
    present = set(there)
    pairs = [(window - a, a) for a in there if 2 * a <= window and window - a in present]
    triples = [
        (window - a - b, b, a)
        for i, a in enumerate(there)
        if 3 * a <= window
        for b in there[i:]
        if a + 2 * b <= window and window - a - b in present
    ]
    return pairs + triples


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences): every piece of the histogram in one place."""
    left = histogram.astype(np.int64).copy()
    chosen: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        kinds, each = np.unique(lengths, return_counts=True)
        times = int(min(times, (left[kinds] // each).min()))
        if times > 0:
            left[kinds] -= each * times
            chosen.append((lengths, times))

    take((window,), int(left[window])) if left[window] else None
    options = combinations(left, window)
    repeats = np.floor(fit_repeats(left, options, max(SETTLED, left.max() / 1000)) + 1e-6).astype(np.int64)
    for i in np.nonzero(repeats)[0].tolist():
        take(options[i], int(repeats[i]))
    while left.any():
        free, lengths, rest = window, [], left.copy()
        while free:
            fits = np.nonzero(rest[1 : free + 1])[0]
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            n = int(min(rest[length], free // length))
            lengths += [length] * n
            rest[length] -= n
            free -= n * length
        take(tuple(lengths), int(left.max()))
    return chosen


class Places:
    """Sequence and offset of the piece with a given length and rank, looked up in runs of the plan."""

    def __init__(self, chosen: list[tuple[tuple[int, ...], int]], window: int):
        used = np.zeros(window + 1, np.int64)
        runs = []
        first = 0
        for lengths, times in chosen:
            offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            for length in dict.fromkeys(lengths):
                at = offsets[np.array(lengths) == length]
                runs.append((length, int(used[length]), first, at))
                used[length] += len(at) * times
            first += times
        runs.sort(key=lambda run: run[:2])
        self.keys = np.array([length << 44 | low for length, low, _, _ in runs], np.int64)
        self.low = np.array([low for _, low, _, _ in runs], np.int64)
        self.first = np.array([first for _, _, first, _ in runs], np.int64)
        self.each = np.array([len(at) for *_, at in runs], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.each)))[:-1]
        self.offsets = np.concatenate([np.empty(0, np.int64), *[at for *_, at in runs]]).astype(np.int64)

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.keys, length << 44 | rank, side="right") - 1
        past = rank - self.low[run]
        each = self.each[run]
        return self.first[run] + past // each, self.offsets[self.at[run] + past % each]


def assign(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number, offset, and whether the sequence is full, of every piece of a group."""
    histogram = np.bincount(lengths, minlength=window + 1)
    order = np.argsort(lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths)) - (np.cumsum(histogram) - histogram)[lengths[order]]
    sequence, offset = Places(plan(histogram, window), window)(lengths, rank)
    return sequence, offset, np.bincount(sequence, lengths)[sequence] == window


def _place(pieces: DataFrame, window: int, last: bool, mark: str) -> DataFrame:
    """Pieces with sequence_id, offset and, in `mark`, whether their sequence stays open; in the last round none does.

    A task's sequence ids are its own: its number, the sequence's number within it, and the round.
    """
    names = pieces.columns
    at = names.index("length")

    def settle(held: list[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
        lengths = np.concatenate([b.column(at).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
        sequence, offset, full = assign(lengths, window)
        unsettled = pa.array(np.zeros(len(full), bool) if last else ~full)
        ids = pa.array((first + sequence) << 1 | last)
        begin = 0
        for batch in held:
            end = begin + len(batch)
            columns = [*batch.columns, *(c.slice(begin, len(batch)) for c in (ids, pa.array(offset), unsettled))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset", mark])
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 34
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                rows += len(batch)
                size += batch.nbytes
            if held and not last and (rows >= GROUP or size >= GROUP_BYTES):
                yield from settle(held, first)
                first += rows  # more than the sequences made of them
                held, rows, size = [], 0, 0
        if held:
            yield from settle(held, first)

    ship()
    schema = T.StructType([*pieces.schema.fields])
    for name, kind in (("sequence_id", T.LongType()), ("offset", T.LongType()), (mark, T.BooleanType())):
        schema = schema.add(name, kind)
    return pieces.mapInArrow(run, schema)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces with their (sequence_id, offset), written in the shared folder and read back.

    Offsets are gapless from 0 in every sequence; sequence ids are unique, not
    gapless. Needs the column length, from 1 to `window`, as `pieces` gives it;
    others pass through, but for sequence_id and offset, which may not be there.
    Documents repeated under one id are packed each; texts of any length are cut
    whole. No rows give no rows.
    """
    mark = fresh([*pieces.columns, "sequence_id", "offset"], "open")
    first = stage(_place(pieces, window, False, mark), "first", by=[mark])
    names = [*pieces.columns, "sequence_id", "offset"]
    left = first.where(F.col(mark)).select(*pieces.columns)
    groups = max(1, -(-left.count() // GROUP))
    second = stage(_place(left.repartition(groups), window, True, mark), "second")  # dealt evenly: no key, no hot group
    return first.where(~F.col(mark)).select(*names).unionByName(second.select(*names))


def pack_documents(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """The packed pieces with their ids: (doc_id, start, length, ids, doc_tokens, sequence_id, offset)."""
    return pack(pieces(docs, window=window, **how), window)


def pack_digests(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """As `pack_documents`, with the CRC-32 of a piece's ids in place of the ids."""
    cut = pieces(docs, window=window, **how).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut, window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_pack_nnls(spark, sf_dir: str) -> DataFrame:
    """All `documents` packed into windows of 1024 tokens."""
    return pack_digests(table(spark, sf_dir, "documents"))
