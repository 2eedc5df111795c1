"""Vector bin packing of tokenised examples.

Each task tokenises its rows and packs them as they come, from a window of waiting pieces. A sequence has three
limits at once: tokens, segments and loss-bearing tokens. The next piece is the one whose demand has the largest
dot product with what is left of the sequence, among those that fit; when none fits, the piece that leaves least is
cut to fill what is left. So only a task's last sequence is short, and no row is shuffled.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_LOADED: dict = {}
#: Runs of so many blanks go to the tokenizer itself: the fast encoder's pattern runs out of stack on about 15 times as many.
LONG_BLANK = 1 << 16
BLANKS = re.compile(r"\s{%d}" % (LONG_BLANK - 1) + r"\s")


class Tokens:
    """Ids of whole texts, as the tokenizer file gives them, its special tokens included.

    Where the same vocabulary lies beside the file as ranks, those encode texts without special tokens, as the
    faster of two equal ways.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        self.path, self.base, self.fast = path, None, _ranks(path)
        self.marks = tuple(t["content"] for t in given["added_tokens"])
        # bytes of each id: a byte-level vocabulary writes a byte as one character
        self.sizes = np.zeros(1 + max([*given["model"]["vocab"].values(), *(t["id"] for t in given["added_tokens"])]), np.int64)
        for token, i in given["model"]["vocab"].items():
            self.sizes[i] = len(token)
        for t in given["added_tokens"]:
            self.sizes[t["id"]] = len(t["content"].encode())

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not any(m in text for m in self.marks) and not (len(text) > LONG_BLANK and BLANKS.search(text)):
            try:
                return np.array(self.fast.encode_ordinary(text), "<u4")
            except (KeyboardInterrupt, SystemExit, GeneratorExit):
                raise
            except BaseException:  # noqa: BLE001 - the fast encoder's panics are no Exceptions; the other one takes any text
                pass
        if self.base is None:
            from tokenizers import Tokenizer

            self.base = Tokenizer.from_file(self.path)
        return np.array(self.base.encode(text, add_special_tokens=False).ids, "<u4")

    def bears(self, ids: np.ndarray, spans: list) -> np.ndarray:
        """Which ids begin within one of the byte ``spans`` (start, stop) of the text."""
        ends = np.cumsum(self.sizes[ids])
        begins = ends - self.sizes[ids]
        on = np.zeros(len(ids) + 1, np.int64)
        for start, stop in spans:
            a, b = np.searchsorted(begins, [start, stop])
            if b > a:
                on[a] += 1
                on[b] -= 1
        return np.cumsum(on[:-1]) > 0


def _ranks(path: str):
    """The same vocabulary as ranks, for a faster encoder, where such a file lies beside the tokenizer's own."""
    import base64
    import os

    import public_tokenizers
    import tiktoken

    path = path.removesuffix(".json") + ".tiktoken"
    if not path.endswith("byte_bpe_50k.tiktoken") or not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tokens(path: str) -> Tokens:
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


class Piece:
    """Consecutive ids of one document; ``bears`` says which bear loss (None: all)."""

    __slots__ = ("doc", "start", "ids", "total", "bears", "size", "loss")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int, bears: np.ndarray | None):
        self.doc, self.start, self.ids, self.total, self.bears = doc, start, ids, total, bears
        self.size = len(ids)
        self.loss = self.size if bears is None else int(bears.sum())

    def prefix(self, tokens: float, bearing: float) -> int:
        """How many of its first ids stay within both."""
        n = int(min(tokens, self.size))
        if self.bears is None:
            return int(min(n, bearing))
        return int(np.searchsorted(np.cumsum(self.bears[:n]), bearing, "right"))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        b = (None, None) if self.bears is None else (self.bears[:n], self.bears[n:])
        return Piece(self.doc, self.start, self.ids[:n], self.total, b[0]), Piece(self.doc, self.start + n, self.ids[n:], self.total, b[1])


class Packer:
    """Places pieces into sequences; keeps at most ``window`` waiting. ``limits``: tokens, segments, loss-bearing tokens."""

    def __init__(self, limits: tuple[int, int, int], window: int, emit):
        self.limits, self.window, self.emit, self.sequence = np.array(limits, float), window, emit, 0
        self.waiting: list[Piece] = []

    def add(self, piece: Piece) -> None:
        cap_tokens, _, cap_loss = self.limits
        while piece.size > cap_tokens or piece.loss > cap_loss:  # whole sequences of a long document need no choice
            full, piece = piece.cut(piece.prefix(cap_tokens, cap_loss))
            self.emit(full, self.sequence, 0)
            self.sequence += 1
        if piece.size:
            self.waiting.append(piece)
        if len(self.waiting) >= self.window:
            self.pack(self.window // 2)

    def pack(self, keep: int) -> None:
        cap_tokens, cap_segments, cap_loss = self.limits
        pieces = self.waiting
        size, loss = (np.array([getattr(p, k) for p in pieces], float) for k in ("size", "loss"))
        here = np.ones(len(pieces), bool)
        count = len(pieces)
        while count > keep:
            tokens, segments, bearing, offset = cap_tokens, cap_segments, cap_loss, 0
            while count and segments and tokens:
                fits = here & (size <= tokens) & (loss <= bearing)
                if fits.any():
                    # demand and what is left, each as a share of its limit
                    value = size * (tokens / cap_tokens**2) + segments / cap_segments**2 + loss * (bearing / cap_loss**2)
                    k = int(np.argmax(np.where(fits, value, -1)))
                    piece = pieces[k]
                    here[k] = False
                    count -= 1
                else:
                    k = int(np.argmin(np.where(here, size, np.inf)))
                    room = pieces[k].prefix(tokens, bearing)
                    if not room:
                        break
                    piece, pieces[k] = pieces[k].cut(room)
                    size[k], loss[k] = pieces[k].size, pieces[k].loss
                self.emit(piece, self.sequence, offset)
                offset += piece.size
                tokens -= piece.size
                segments -= 1
                bearing -= piece.loss
            self.sequence += 1
        self.waiting = [p for p, on in zip(pieces, here, strict=True) if on]

    def close(self) -> None:
        while self.waiting:
            self.pack(0)


def _pack_rows(path: str, end_id: int, limits: tuple[int, int, int], window: int):
    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def emit(p: Piece, sequence: int, offset: int):
            rows.append((p.doc, p.start, p.size, zlib.crc32(p.ids.tobytes()), p.total, first + sequence, offset, p.loss))

        def flush():
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in COLUMNS.split(", ")])

        tokens, packer, end = _tokens(path), Packer(limits, window, emit), np.array([end_id], "<u4")
        for batch in batches:
            masks = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), masks, strict=True):
                own = tokens.encode(text.as_py() or "")
                bears = None
                if spans is not None:
                    bears = tokens.bears(own, [(s["start"], s["stop"]) for s in spans])
                    bears = np.append(bears, bool(len(bears)) and bears[-1])
                ids = np.concatenate([own, end])
                packer.add(Piece(doc, 0, ids, len(ids), bears))
            yield flush()
        packer.close()
        yield flush()

    return run


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, end_id: int = 1,
    max_tokens: int = 2048, max_segments: int = 512, max_loss: int = 2048, window: int = 256,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens): a row for each piece.

    A document is its ids, special tokens in the text taken as such, and ``end_id``. ``loss_col`` names an array of
    (start, stop) byte spans of the text, those of replies in instruction data: ids that begin within one bear loss,
    and so does the end id after such an id; without the column, or where it is null, all ids do. No sequence exceeds
    ``max_tokens`` ids, ``max_segments`` pieces or ``max_loss`` loss-bearing ids (each 1 at least).

    ``tokenizer`` is a tokenizer file's path on every machine. A null text is empty and gives its end id alone. Rows
    with equal or null ids are separate documents. An empty table gives no rows; other columns are ignored. The same
    input files give the same sequences, also when a task is run again. A document is one row and so one task's work.
    """
    limits = (max_tokens, max_segments, max_loss)
    if min(limits) < 1:
        raise ValueError("limits are 1 at least")
    cols = [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")]
    if loss_col:
        cols.append(F.transform(loss_col, lambda s: F.struct(s["start"].cast("long").alias("start"), s["stop"].cast("long").alias("stop"))).alias("spans"))
    return docs.select(*cols).mapInArrow(lean(_pack_rows(tokenizer, end_id, limits, window)), COLUMNS)
