"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

A text is marked (a blank becomes the mark, one mark is put before it) and cut
into marked words: marks, then everything up to the next mark.  No piece crosses
a word's start, so the best segmentation of a text is that of its words, and
each different word is segmented once a batch.

The different words are sorted, which lays them out as the depth-first order of
a trie.  Walking it, the forward scores of the prefix a word shares with the
one before stay as they are and only the rest is computed.  The score at a
position is the best over the pieces that end there, found by a walk back
through a trie of reversed pieces.

Scores are the model's piece scores, summed: the segmentation rule of unigram
models.  Equal sums go to the longer last piece.  A character that no piece
covers becomes its bytes where the model has byte pieces, else the unknown
piece, at a score below every piece's.  Decoding joins the pieces, turns byte
pieces into bytes and takes the marks back.

Cases: null text is empty and has no pieces; empty tables give an empty result;
repeated rows give repeated rows; a text that holds the mark itself comes back
with blanks in its place, as with the public library; a very long text is segmented whole, word by word, and a word of any length
in time in proportion to it; of segmentations with equal scores the one whose last pieces are found first in the walk wins; null ids are like any
other; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import table, text_or_empty

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Pieces:
    """A model's vocabulary: scores of ordinary pieces, ids of byte pieces, the unknown id, and each id's text."""

    ids: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown: int
    texts: list[str | None]
    byte_of: dict[int, int]
    ends: dict = field(default_factory=dict)
    below: float = 0.0

    def __post_init__(self) -> None:
        for piece, found in self.ids.items():
            at = self.ends
            for c in reversed(piece):
                at = at.setdefault(c, {})
            at[""] = found
        self.below = min((s for _, s in self.ids.values()), default=0.0) - 10.0


def load(model_file: str) -> Pieces:
    """The vocabulary of a model file; control and unused pieces never match a text."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    ids, byte_of, texts = {}, {}, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        texts.append(None if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) else piece)
        if sp.is_byte(i):
            byte_of[i] = int(piece[3:5], 16)
        elif texts[-1] is not None:
            ids[piece] = (i, sp.get_score(i))
    by_byte = {b: i for i, b in byte_of.items()}
    return Pieces(ids, [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [], sp.unk_id(), texts, byte_of)


def marked_words(text: str) -> list[str]:
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def segment(words: Iterable[str], pieces: Pieces) -> dict[str, list[int]]:
    """The ids of each different word, in one depth-first walk over the sorted words' trie."""
    made: dict[str, list[int]] = {}
    before = ""
    best = [0.0]  # the best score of each prefix of the word at hand
    came = [0]  # where its last piece begins
    last = [-1]  # that piece's id, or -1 for a character without one
    for word in sorted(set(words)):
        shared = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], came[shared + 1 :], last[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, start, piece = best[end - 1] + pieces.below, end - 1, -1
            at = pieces.ends
            for i in range(end - 1, -1, -1):
                at = at.get(word[i])
                if at is None:
                    break
                found = at.get("")
                if found is not None and best[i] + found[1] >= top:
                    top, start, piece = best[i] + found[1], i, found[0]
            best.append(top)
            came.append(start)
            last.append(piece)
        ids: list[int] = []
        end = len(word)
        while end:
            if last[end] >= 0:
                ids.append(last[end])
            elif pieces.byte_ids:
                ids.extend(pieces.byte_ids[b] for b in reversed(word[came[end] : end].encode("utf-8", "surrogatepass")))
            else:
                ids.append(pieces.unknown)
            end = came[end]
        made[word] = ids[::-1]
        before = word
    return made


def decode(ids: Iterable[int], pieces: Pieces) -> str:
    """The text of a list of ids."""
    out: list[bytes] = []
    for i in ids:
        if i in pieces.byte_of:
            out.append(bytes([pieces.byte_of[i]]))
        elif i == pieces.unknown:
            out.append(" ⁇ ".encode())
        elif pieces.texts[i] is not None:
            out.append(pieces.texts[i].replace(MARK, " ").encode("utf-8", "surrogatepass"))
    text = b"".join(out).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode_batch(texts: list[str], pieces: Pieces, known: dict[str, list[int]], limit: int = 200_000) -> list[np.ndarray]:
    """Ids of each text; ``known`` keeps words of up to 64 characters for the next batch, emptied when it holds more than ``limit``."""
    words = [marked_words(t) for t in texts]
    if len(known) > limit:
        known.clear()
    new = {w for ws in words for w in ws} - known.keys()
    known.update(segment(new, pieces))
    ids = [np.array([i for w in ws for i in known[w]], np.int32) for ws in words]
    for w in new:
        if len(w) > 64:  # as of scripts without blanks, where they would fill the memory
            del known[w]
    return ids


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 4 << 20) -> DataFrame:
    """One row per document: ``doc_id, ids``; ``batch_chars`` of text at a time share a walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = load(model_file), {}
        for batch in batches:
            start, held, texts = 0, 0, []

            def made(upto: int) -> pa.RecordBatch:
                found = encode_batch(texts, pieces, known)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                values = np.concatenate(found) if found else np.empty(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                return pa.RecordBatch.from_arrays([batch.column(0).slice(start, upto - start), ids], ["doc_id", "ids"])

            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= batch_chars:
                    yield made(i + 1)
                    start, held, texts = i + 1, 0, []
            if texts:
                yield made(batch.num_rows)

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encoded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file)
        for batch in batches:
            texts = [decode(ids.as_py() or [], pieces) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: ``doc_id, n_pieces, ids_crc32, n_chars, exact``.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers;
    ``exact`` says whether decoding gives the text back.
    """
    import zlib

    schema = "doc_id long, n_pieces long, ids_crc32 long, n_chars long, exact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = load(model_file), {}
        shown: list[bytes] = [b"" if t is None else t.replace(MARK, " ").encode("utf-8", "surrogatepass") for t in pieces.texts]
        for i, b in pieces.byte_of.items():
            shown[i] = bytes([b])
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            texts = [x.as_py() for x in batch.column(1)]
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and held < 4 << 20:
                    held += len(texts[end])
                    end += 1
                for text, ids in zip(texts[at:end], encode_batch(texts[at:end], pieces, known), strict=True):
                    back = b"".join(map(shown.__getitem__, ids.tolist()))
                    values = (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(text), back[1:] == text.replace(MARK, " ").encode() if text else not back)
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                at = end
            arrays = [batch.column(0), *[pa.array(x, pa.int64()) for x in rows[:3]], pa.array(rows[3], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_pieces", "ids_crc32", "n_chars", "exact"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def op7_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
