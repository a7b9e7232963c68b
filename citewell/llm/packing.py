"""Packing documents into fixed token windows: first-fit decreasing with a tournament tree.

Each document becomes token ids and one end id, cut into windows of
``capacity`` ids and a rest.  Pieces go to randomised groups (a hash of the
row's number and the position, so long documents, hot sources and repeated rows
spread evenly) and
each group is packed by itself: pieces by falling length, each into the first
bin with room, which a tournament tree over the bins' free room finds in
logarithmic time.  Groups hold about ``pieces_per_group`` pieces at any input
size; only piece records, never texts, are shuffled.

Byte-level BPE splits a text before every blank that precedes a visible
character, so ids are looked up chunk by chunk in a dictionary that a task keeps, bounded
and dropped with it, and the tokenizer runs once for each chunk it has not met; texts that hold a special
token's string go to the tokenizer whole.

Cases: null text is empty and yields the end id alone; empty tables give an
empty result; a repeated row is packed as often as it occurs; null ids stay
null; a very long text is encoded whole and cut into windows; further columns are ignored.  Ties in length go by id and start.
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import groups_for, lean, table, text_or_empty, written

CAPACITY = 1024
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_CUT = _PIECES + ", row long"
_CUT_NAMES = [x.split()[0] for x in _CUT.split(", ")]
_PACKED = _PIECES + ", sequence_id long, offset long"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: visible ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TokenIds(dict):
    """Ids, as little-endian bytes, of the pre-tokens met so far, by the tokenizer's own model; emptied when ``limit`` are held."""

    def __init__(self, tokenizer, limit: int):
        super().__init__()
        self.tokenize, self.limit, self.letters = tokenizer.model.tokenize, limit, _byte_letters()

    def of_letters(self, token: str) -> bytes:
        ids = [x.id for x in self.tokenize(token)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def of_text(self, token: str) -> bytes:
        plain = token.isascii() and token.isprintable()
        return self.of_letters(token.replace(" ", self.letters[32]) if plain else token.encode().decode("latin-1").translate(self.letters))

    def __missing__(self, token: str) -> bytes:
        made = self.of_text(token)
        if len(self) >= self.limit:
            self.clear()
        if len(token) <= 64:
            self[token] = made
        return made


_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_SIGNS = r"!-/:-@\[-`{-~"


class ChunkIds(dict):
    """Ids of the chunks met so far, each the ids of its pre-tokens in a row; emptied when ``limit`` chunks are held.

    A chunk of ASCII letters is one pre-token, and signs at its end are another;
    words are held here alone, as chunks, and other pre-tokens in ``tokens``.
    The standard library's expressions find the pre-tokens of further chunks of
    Latin letters, ASCII digits, signs and white space; a chunk that these do not
    use up goes by the tokenizer's own rule.
    """

    parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[{_SIGNS}]+|[ \t\n\r\f\v]+(?!\S)|[ \t\n\r\f\v]+")
    signs = string.punctuation

    def __init__(self, tokenizer, tokens: TokenIds, lead: str, limit: int):
        super().__init__()
        self.split, self.tokens = tokenizer.pre_tokenizer.pre_tokenize_str, tokens
        self.lead, self.limit = lead, limit
        self.lead_letter = lead and tokens.letters[32]

    def made(self, chunk: str) -> bytes:
        ascii_only = chunk.isascii()
        if chunk.isalpha():
            if ascii_only:
                return self.tokens.of_letters(self.lead_letter + chunk)
            if max(chunk) < "\u0250":
                return self.tokens.of_text(self.lead + chunk)
        word = chunk.rstrip(self.signs)
        if ascii_only and word.isalpha():
            return self[word] + self.tokens[chunk[len(word) :]]
        text = self.lead + chunk
        parts = self.parts.findall(text)
        if sum(map(len, parts)) == len(text):
            return b"".join(map(self.tokens.__getitem__, parts))
        return b"".join(self.tokens.of_letters(token) for token, _ in self.split(text))

    def __missing__(self, chunk: str) -> bytes:
        made = self.made(chunk)
        if len(self) >= self.limit:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = made
        return made


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers in bytes; made for one task and dropped with it."""

    def __init__(self, tokenizer_file: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        if self.tokenizer.normalizer is not None:
            raise ValueError("a normaliser could join what blanks separate; this encoder has none")
        tokens = TokenIds(self.tokenizer, limit // 2)
        self.after_blank = ChunkIds(self.tokenizer, tokens, " ", limit)
        self.first = ChunkIds(self.tokenizer, tokens, "", limit // 10)
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.odd_blank = re.compile(r" (?:\s|$)")
        self.cut = re.compile(r" (?=\S)")

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)
        chunks = self.cut.split(text) if self.odd_blank.search(text) else text.split(" ")
        return self.first[chunks[0]] + b"".join(map(self.after_blank.__getitem__, chunks[1:]))


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and CRC-32 of each window of ``capacity`` ids."""
    for at in range(0, len(ids), 4 * capacity):
        part = ids[at : at + 4 * capacity]
        yield at // 4, len(part) // 4, zlib.crc32(part)


def first_fit(lengths: Iterable[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each length, in the order given: the first bin with room takes it.

    ``room`` is a tournament tree: leaves are the bins' free room, each inner
    node the larger of its two children, so the walk from the root to the
    leftmost leaf with enough room takes as many steps as the tree has levels.
    """
    lengths = list(lengths)
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    placed = []
    for n in lengths:
        if n > capacity:
            raise ValueError(f"a piece of {n} does not fit {capacity}")
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < n:
                at += 1
        placed.append((at - leaves, capacity - room[at]))
        room[at] -= n
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return placed


def cut_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of every document, each id in exactly one: ``doc_id, start, length, ids_crc32, doc_tokens, row``; ``row`` numbers the documents."""
    end = end_id.to_bytes(4, "little")

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = Encoder(tokenizer_file), TaskContext.get().partitionId() << 32
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for start, length, crc in pieces_of(ids, capacity):
                    for column, value in zip(rows, (key, start, length, crc, len(ids) // 4, row), strict=True):
                        column.append(value)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], _CUT_NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(cut, _CUT)


def pack_pieces(pieces: DataFrame, groups: int, capacity: int = CAPACITY, seed: int = 7) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` by first-fit decreasing within each of ``groups`` randomised groups."""

    def pack(data: pa.Table) -> pa.Table:
        group = data.column("group")[0].as_py()
        data = data.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = first_fit(data.column("length").to_pylist(), capacity)
        data = data.drop_columns(["group", "row"])
        data = data.append_column("sequence_id", pa.array([(group << 32) + at for at, _ in placed], pa.int64()))
        return data.append_column("offset", pa.array([at for _, at in placed], pa.int64()))

    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("row", "start", F.lit(seed)), F.lit(groups)))
    return grouped.groupBy("group").applyInArrow(pack, _PACKED)


def pack_documents(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, pieces_per_group: int = 15_000
) -> DataFrame:
    """All documents in sequences of at most ``capacity`` ids.

    The narrow table of pieces is written once and counted; about
    ``pieces_per_group`` go to a group, so groups grow in number and not in size
    with the input.
    """
    pieces = written(cut_documents(docs, tokenizer_file, id_col, text_col, capacity, end_id), "pieces")
    return pack_pieces(pieces, groups_for(pieces.count(), pieces_per_group), capacity)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
