"""Vector bin packing of tokenised examples into fixed-length sequences.

An example demands three resources of a sequence: tokens, one segment, and loss-bearing tokens. Sequences are filled one at
a time; of the examples that fit, the one with the greatest dot product between its demand and the sequence's residual
capacity (each dimension weighted by its capacity) goes next. Work is streamed: a task holds a window of examples and packs
its own partition, so nothing is shuffled, memory is bounded by the window, and a rerun of a task gives the same sequences.

Where cutting is allowed, whole sequences are first cut from long examples, and a gap that no example fits is filled with
the head of the longest one. What is left at a partition's end goes to sequences of power-of-two lengths, so only a limit on
segments can leave padding.

Token ids are those of byte-level BPE, from the vocabulary of a tokenizers JSON file whose path is a parameter. Text that has
no two white-space characters side by side splits at its spaces into pieces that byte-level BPE never joins; the distinct
pieces of a batch are encoded once and gathered. Other texts are encoded whole. Ids are those of the tokenizers library
without added special tokens; special strings that a text itself holds have their ids, as there. The tests check this.

Defined cases: null text is empty text, of which the end id alone is packed; null and repeated ids are packed like others.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import sub_batches

#: How byte-level BPE splits text before merging.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that may stand beside other white space.
_SPACE = r"[\x09-\x0D \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WINDOW = 2048
BATCH_BYTES = 8 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segments int"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Batch encoder for a byte-level BPE vocabulary whose ids are its merge ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, special = whole["model"], {t["content"]: t["id"] for t in whole.get("added_tokens") or []}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(model["merges"])}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens=special)
        self.width = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.width[i] = len(token)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.bpe.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, length of each piece); a piece is read as it stands behind a space."""
        odd = [i for i, p in enumerate(pieces) if not p or p[0] in _SPACES or p[-1] in _SPACES]
        plain = pieces if not odd else ["x" if not p or p[0] in _SPACES or p[-1] in _SPACES else p for p in pieces]
        ids = self.encode(" " + " ".join(plain)) if plain else np.zeros(0, np.uint32)
        ends = np.cumsum([len(p.encode()) + 1 for p in plain])
        cuts = np.searchsorted(np.cumsum(self.width[ids]), ends, side="left") + 1
        lengths = np.diff(cuts, prepend=0)
        if odd:
            parts = np.split(ids, cuts[:-1])
            for i in odd:
                parts[i] = self.encode(" " + pieces[i])
            lengths = np.array([len(p) for p in parts])
            ids = np.concatenate(parts)
        return ids, lengths

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        slow = np.asarray(pc.match_substring_regex(texts, _SPACE + "{2}"))
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        for i in np.flatnonzero(slow):
            out[i] = self.encode(texts[i].as_py())
        fast = np.flatnonzero(~slow)
        if not len(fast):
            return out
        split = pc.split_pattern(texts.take(pa.array(fast)), " ")
        offsets = np.asarray(split.offsets)
        coded = split.flatten().dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        pieces = coded.dictionary.to_pylist()
        ids, lengths = self._encode_pieces(pieces)
        firsts = offsets[:-1] - offsets[0]
        heads = [self.encode(pieces[c]) for c in codes[firsts]]  # a text's first piece has no space before it
        codes[firsts] = len(pieces) + np.arange(len(firsts))
        ids = np.concatenate([ids, *heads])
        lengths = np.concatenate([lengths, [len(h) for h in heads]]).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        n = lengths[codes]
        ends = np.cumsum(n)
        flat = ids[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        for k, i in enumerate(fast):
            out[i] = flat[bounds[k] : bounds[k + 1]]
        return out


class Packer:
    """Fills sequences from a stream of examples. place(): (example, start, ids, sequence, offset) for each piece."""

    def __init__(self, tokens: int, segments: int, loss: int, cutting: bool):
        self.capacity = np.array([tokens, segments, loss], dtype=np.float64)
        self.tokens, self.cutting = tokens, cutting
        self.items: list[list] = []  # [example, start, ids, loss-bearing tokens]
        self.sequence = 0

    def add(self, example, ids: np.ndarray, loss: int) -> Iterator[tuple]:
        start = 0
        if self.cutting:
            share = loss / max(1, len(ids))
            whole = max(1, min(self.tokens, int(self.capacity[2] / share) if share else self.tokens))
            while len(ids) - start >= whole:
                yield example, start, ids[start : start + whole], self.sequence, 0, 1
                self.sequence += 1
                start += whole
            loss = round(share * (len(ids) - start))
        elif len(ids) > self.tokens or loss > self.capacity[2]:
            raise ValueError("an example exceeds a sequence and may not be cut")
        if start < len(ids):
            self.items.append([example, start, ids[start:].copy(), loss])
        if len(self.items) >= WINDOW:
            yield from self.flush(WINDOW // 8)

    def flush(self, keep: int = 0) -> Iterator[tuple]:
        """Fill sequences until at most keep examples are left."""
        need = np.array([[len(x[2]), 1, x[3]] for x in self.items], dtype=np.float64).reshape(-1, 3)
        alive = np.ones(len(self.items), bool)
        left, total = len(self.items), int(need[:, 0].sum())
        while left > keep:
            room = self.capacity.copy()
            if self.cutting and total < self.tokens:
                room[0] = 1 << (total.bit_length() - 1)
            offset, placed = 0, []
            while room[0] > 0 and left:
                fits = alive & (need <= room).all(axis=1)
                if fits.any():
                    score = np.where(fits, (need / self.capacity) @ (room / self.capacity), -1.0)
                    i = int(np.argmax(score))
                    example, start, ids, _ = self.items[i]
                    alive[i] = False
                    left -= 1
                    took = need[i].copy()
                elif self.cutting and room[1] >= 1 and room[2] >= 1:
                    i = int(np.argmax(np.where(alive, need[:, 0], -1.0)))
                    example, start, ids, loss = self.items[i]
                    n = int(min(room[0], len(ids), room[2] * len(ids) // max(1, loss)))
                    if n < 1:
                        break
                    took = np.array([n, 1, round(loss * n / len(ids))], dtype=np.float64)
                    self.items[i] = [example, start + n, ids[n:], loss - took[2]]
                    need[i] = [len(ids) - n, 1, loss - took[2]]
                    ids = ids[:n]
                    if n == len(self.items[i][2]) + n:
                        alive[i] = False
                        left -= 1
                else:
                    break
                placed.append((example, start, ids, offset))
                offset += len(ids)
                total -= len(ids)
                room -= took
            if not placed:
                raise ValueError("an example exceeds a sequence and may not be cut")
            for example, start, ids, at in placed:
                yield example, start, ids, self.sequence, at, len(placed)
            self.sequence += 1
        self.items = [x for x, on in zip(self.items, alive, strict=True) if on]


def response_share(text):
    """The share of a text behind its first line, as instruction data has its prompt there; all of a text of one line."""
    at, n = F.instr(text, "\n"), F.char_length(text)
    return F.when((at > 0) & (at < n), (n - at) / n).otherwise(F.lit(1.0))


def pack(docs: DataFrame, vocabulary: str | None = None, tokens: int = 2048, segments: int = 512, loss_tokens: int | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, cutting: bool = True) -> DataFrame:
    """Pieces of every document, each with its sequence and offset there.

    loss_col names the share (0 to 1) of a document's tokens that bear loss, all of them where it is None; loss_tokens limits
    their number in a sequence. sequence_id is the task's partition times 2^33 plus a count.
    """
    path = vocabulary or default_vocabulary()
    most = tokens if loss_tokens is None else loss_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = ByteBpe(path), Packer(tokens, segments, most, cutting)
        base = TaskContext.get().partitionId() << 33
        end = np.array([end_id], np.uint32)
        rows: list[tuple] = []

        def take(pieces) -> None:
            for (doc_id, n), start, ids, sequence, offset, count in pieces:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), n, base + sequence, offset, count))

        def out() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.int32()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segments"]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            rows.clear()
            return made

        for whole in batches:
            for b in sub_batches(whole, "text", BATCH_BYTES):
                shares = b.column("share").to_pylist()
                for doc_id, ids, share in zip(b.column("doc_id").to_pylist(), bpe.encode_batch(b.column("text")), shares, strict=True):
                    ids = np.concatenate([ids, end])
                    share = 1.0 if share is None else min(1.0, max(0.0, share))
                    take(packer.add((doc_id, len(ids)), ids, round(share * len(ids))))
                yield out()
        take(packer.flush())
        yield out()

    share = F.lit(1.0) if loss_col is None else F.col(loss_col).cast("double")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), share.alias("share")).mapInArrow(run, PIECES)
