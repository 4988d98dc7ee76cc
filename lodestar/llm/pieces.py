"""SentencePiece ids by way of a table of distinct chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White-space marker, and the chunks that no piece crosses: a run of markers with what follows it.
MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
#: Characters of the longest chunk kept, and bytes a kept chunk takes besides its characters.
LONG, HELD = 64, 250


class ChunkTable:
    """Ids and decoded text of each distinct chunk seen, segmented once. The table keeps chunks of at most ``LONG`` characters, and starts anew beyond ``limit`` bytes.

    Longer chunks, such as sentences in scripts without spaces, hardly recur; they are segmented where they stand.
    """

    def __init__(self, model: str, limit: int = 96 << 20) -> None:
        import numpy as np
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names = list(map(self.sp.id_to_piece, range(self.sp.vocab_size())))
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("the chunk table needs a model whose pieces cross no white-space marker")
        self.limit = limit
        self.leads = np.array([p.startswith(MARK) for p in names])
        self.forget()

    def forget(self) -> None:
        self.size = 0
        self.ids: dict[str, str] = {}
        #: Decoded text of the chunks that do not decode to themselves with spaces for markers.
        self.odd: dict[str, str] = {}

    def learn(self, new: list[str]) -> None:
        """Segment new chunks. Those with one marker go to the library in one call, as words of one text, and the ids are cut where a piece leads with the marker."""
        self.size += sum(HELD + 8 * len(c) for c in new)
        plain = [c for c in new if len(c) > 1 and c.rfind(MARK) == 0]
        if plain:
            text = " ".join([c[1:] for c in plain])
            ids = self.sp.encode(text)
            cuts = self.leads[ids].nonzero()[0].tolist()
            if len(cuts) == len(plain) and self.sp.decode(ids) == text:
                names = list(map(str, ids))
                cuts.append(len(ids))
                self.ids.update(zip(plain, [" ".join(names[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)], strict=True))
                new = [c for c in new if c not in self.ids]
        for c in new:
            self.ids[c], decoded = self.segment(c)
            if decoded != c.replace(MARK, " "):
                self.odd[c] = decoded

    def segment(self, c: str) -> tuple[str, str]:
        """Ids and decoded text of one chunk."""
        # The library puts a first marker in front itself, but not of nothing, and takes it off again.
        ids = self.sp.encode(c[1:]) if c != MARK else [self.sp.piece_to_id(MARK)]
        return " ".join(map(str, ids)), " " + self.sp.decode(ids) if c != MARK else " "

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """``(number of ids, ids as text, decoded text)`` of a whole text, with the end id: chunks joined back in order of position."""
        end = str(self.sp.eos_id())
        if not text:
            return 1, end, ""
        marked = MARK + text.replace(" ", MARK)
        chunks = CHUNK.findall(marked)
        long: dict[str, tuple[str, str]] = {}
        try:
            ids = " ".join(map(self.ids.__getitem__, chunks))
        except KeyError:
            distinct = dict.fromkeys(chunks)
            if self.size > self.limit:
                self.forget()
            new = [c for c in distinct if c not in self.ids]
            long = {c: self.segment(c) for c in new if len(c) > LONG}
            self.learn([c for c in new if c not in long])
            ids = " ".join([long[c][0] if c in long else self.ids[c] for c in chunks])
        if long or self.odd and not self.odd.keys().isdisjoint(chunks):
            decoded = "".join([long[c][1] if c in long else self.odd.get(c) or c.replace(MARK, " ") for c in chunks])[1:]
        else:
            decoded = marked[1:].replace(MARK, " ")
        return ids.count(" ") + 2, f"{ids} {end}", decoded


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, ids, decoded)``: ids with an end id only, no sampling; decoded from the ids.

    Words are segmented once per distinct marked word and task, not once per occurrence: texts are
    cut before every run of white-space markers, distinct chunks go to the library, and their ids
    are joined back by position. The table stays with its task, as one table for the corpus would
    need a shuffled row per word occurrence, many times the text. Its size in bytes is bounded, and dropping
    it changes no id. A model with pieces that cross a marker is refused. Whole texts of any length; null is empty text, whose only id is the end id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [table.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(map(int, r[1].split())) for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """``encode`` with each document's ids and decoded text as digests: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

    The digests are taken in the task, so ids never travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                size, ids, decoded = table.encode(text)
                n.append(size)
                a.append(sha(ids))
                b.append(sha(decoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
