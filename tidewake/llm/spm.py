"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the vocabulary holds a whitespace marker after another character,
so merges never cross from one marked word (a run of markers and the characters
up to the next marker) to the next. Each task therefore keeps a table of the
distinct marked words it has met, lets the library segment only those that are
new, and joins ids and decoded strings back to the texts by position. The table
is emptied at ``TABLE_ENTRIES`` words, which bounds its memory; an emptied word
is segmented again when it comes back, so results don't depend on the bound.

A text longer than ``PART_CHARS`` is worked on in parts that end before a marker, so
that only its ids and decoded text are held whole.

Nulls and empty texts give no ids and an empty decoded text; an empty table gives no
rows. Repeated rows and
repeated ids stay as they are, one result a row. Only the id and text columns
are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import slices

TABLE_ENTRIES = 400_000
PART_CHARS = 1 << 18
_CHUNK = re.compile(" +[^ ]*")
_BORDER = re.compile("[^ ](?= )")
_MARKER = "▁"


class ChunkTable:
    """Distinct marked words with their ids and decoded text."""

    def __init__(self, model_path: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        crossing = [p for p in map(self.model.id_to_piece, range(self.model.vocab_size())) if _MARKER in p.lstrip(_MARKER)]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers: {crossing[:3]}")
        lone = self.model.piece_to_id(_MARKER)
        if self.model.is_unknown(lone):
            raise ValueError("the vocabulary has no whitespace marker")
        #: A text's last space is a marked word without characters, which encode("") would not give.
        self.lone = [lone]
        self.entries = entries
        self.ids: dict[str, list[int]] = {}
        self.text: dict[str, str] = {}

    def learn(self, chunks: set[str]) -> None:
        """Segment the words that the table doesn't hold."""
        new = [c for c in chunks if c not in self.ids]
        if not new:
            return
        if len(self.ids) + len(new) > self.entries:
            self.ids.clear()
            self.text.clear()
            new = list(chunks)
        # The library puts one marker in front of a text and takes it off again.
        ids = self.model.encode([c[1:] for c in new], num_threads=1)
        ids = [i if c != " " else self.lone for c, i in zip(new, ids)]
        self.ids.update(zip(new, ids))
        self.text.update((c, " " + t) for c, t in zip(new, self.model.decode(ids, num_threads=1)))

    def parts(self, text: str | None) -> Iterator[list[str]]:
        """Marked words of a text in order, part by part; nothing for null or empty."""
        marked = " " + text.replace(_MARKER, " ") if text else ""
        at = 0
        while at < len(marked):
            end = at + PART_CHARS
            if end < len(marked):
                # A part ends where a marker follows another character.
                cut = _BORDER.search(marked, end)
                end = cut.end() if cut else len(marked)
            yield _CHUNK.findall(marked, at, end)
            at = end

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str]]:
        """Ids and decoded text of each text."""
        ids: list[list[np.ndarray]] = [[] for _ in texts]
        decoded: list[list[str]] = [[] for _ in texts]
        waiting, held = [], 0
        for i, text in enumerate(texts):
            for chunks in self.parts(text):
                waiting.append((i, chunks))
                held += len(chunks)
                if held >= PART_CHARS // 4:
                    self._join(waiting, ids, decoded)
                    waiting, held = [], 0
        self._join(waiting, ids, decoded)
        whole = [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.int32) for x in ids]
        return whole, ["".join(x)[1:] for x in decoded]

    def _join(self, waiting: list[tuple[int, list[str]]], ids: list[list[np.ndarray]], decoded: list[list[str]]) -> None:
        self.learn(set(chain.from_iterable(c for _, c in waiting)))
        for i, chunks in waiting:
            ids[i].append(np.array(list(chain.from_iterable(map(self.ids.__getitem__, chunks))), np.int32))
            decoded[i].append("".join(map(self.text.__getitem__, chunks)))


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text, as encode() and decode() of the library give them."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for first, end, _, _ in slices(texts):
                ids, decoded = table.encode(texts.slice(first, end - first).to_pylist())
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(lengths, out=offsets[1:])
                flat = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(first, end - first), pa.ListArray.from_arrays(offsets, flat), pa.array(decoded, pa.string())],
                    names=[id_col, "ids", "decoded"],
                )

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of ids and SHA-256 of the ids and of the decoded text."""
    return encoded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
