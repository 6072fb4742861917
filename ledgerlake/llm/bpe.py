"""Token ids of whole texts from a byte-level BPE file of the ``tokenizers`` library."""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts with anything but ASCII, Latin letters and common typographic marks, or with white space other than
#: single spaces and line feeds between words, go to the library whole.
IRREGULAR = r"[^\n -~À-ÖØ-öø-ɏ‐-‧€]|[ \n][ \n]|[ \n]\z|\A[ \n]"
#: Where a run of signs follows a letter or digit; an apostrophe may start a contraction, so it starts no chunk.
BORDER = r"([\pL\pN])([^\pL\pN\s'])"
#: Chunks remembered in each of two generations.
MEMO_ENTRIES = 200_000
BATCH = 2048
MARK = "\x01"
#: Fixed values of byte-level BPE: the characters that stand for the bytes 0 to 255; bytes without a printable one follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELT = {b: b if b in _PRINTED else 256 + b - sum(p < b for p in _PRINTED) for b in range(256)}
LINE = f" {MARK}\n"


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    Byte-level BPE never merges across pre-tokens, and in a regular text a pre-token starts at each single
    space and line feed and where signs follow a letter or digit. So each different chunk (from one such
    place up to the next) is encoded by the library once and remembered, for at most MEMO_ENTRIES chunks; the
    new chunks of a batch are encoded together. Texts that are irregular or hold a special token's string are
    encoded whole. With ``special`` off, special tokens' strings are ordinary text. ``lead``, a single space or
    nothing, is put before every text but empty ones.
    """

    def __init__(self, path: str, special: bool = True, lead: str = ""):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.lead = lead
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that start with a space or line feed
        self.starts[[i for t, i in vocabulary.items() if t[0] in "ĠĊ"]] = True
        #: By chunk; one that doesn't start with a space starts with MARK in its place.
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, chunks: set[str]) -> None:
        signs = [c for c in chunks if c[0] == MARK and c[1] != "\n"]  # side by side, these could merge
        self.memo.update(zip(signs, self._whole([c[1:] for c in signs])))
        tokenize = self.tokenizer.model.tokenize  # a space and letters are one pre-token, so the model alone can take them
        plain = [c for c in chunks if c.isalpha()]
        for c in plain:
            ids = [i.id for i in tokenize("Ġ" + (c if c.isascii() else c.encode().decode("latin-1").translate(SPELT)))]
            self.memo[c] = struct.pack(f"<{len(ids)}I", *ids)
        words = list(chunks.difference(signs, plain))
        if not words:
            return
        spelt = [c[1:] if c[0] == MARK else " " + c for c in words]
        data = self._whole(["".join(spelt)])[0]
        starts = np.nonzero(self.starts[np.frombuffer(data, dtype="<u4")])[0] * 4
        if len(starts) == len(words):
            bounds = [*starts.tolist(), len(data)]
            self.memo.update(zip(words, [data[i:j] for i, j in zip(bounds, bounds[1:])]))
        else:
            self.memo.update(zip(words, self._whole(spelt)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; none for null."""
        out: list[bytes] = []
        for i in range(0, len(texts), BATCH):
            out += self._batch(texts[i : i + BATCH])
        return out

    def _batch(self, texts: list[str | None]) -> list[bytes]:
        held = pa.array(texts, pa.string())
        regular = pc.and_(pc.invert(pc.match_substring_regex(held, IRREGULAR)), pc.not_equal(pc.binary_length(held), 0))
        for name in self.special:
            regular = pc.and_(regular, pc.invert(pc.match_substring(held, name)))
        regular = pc.fill_null(regular, False)
        held = pc.binary_join_element_wise("", held.filter(regular), self.lead or "\n")
        held = pc.replace_substring(pc.replace_substring_regex(held, BORDER, rf"\1 {MARK}\2"), "\n", LINE)
        split = pc.split_pattern(pc.utf8_slice_codeunits(held, 1), " ")
        chunks = split.flatten().dictionary_encode()
        ids, ends = self._joined(chunks.dictionary.to_pylist(), chunks.indices.to_numpy(), split.offsets.to_numpy())
        parts = iter(zip([0, *ends], ends))
        skipped = 0 if self.lead else 4  # without a space there is a line feed before the text, which is no part of it
        out = []
        for text, r in zip(texts, regular.to_pylist()):
            if r:
                i, j = next(parts)
                out.append(ids[i + skipped : j])
            else:
                out.append(self._whole([self.lead + text])[0] if text else b"")
        return out

    def _joined(self, distinct: list[str], order: np.ndarray, offsets: np.ndarray) -> tuple[bytes, list[int]]:
        """(the ids of the chunks ``distinct[order]``, the bytes up to the end of each text), given where texts start in ``order``."""
        data = list(map(self.memo.get, distinct))
        missing = [c for c, d in zip(distinct, data) if d is None]
        if missing:
            if len(self.memo) + len(missing) > MEMO_ENTRIES:
                self.old, self.memo = self.memo, {c: d for c, d in zip(distinct, data) if d is not None}
            known = {c: self.old[c] for c in missing if c in self.old}
            self.memo.update(known)
            self._learn(set(missing).difference(known))
            data = list(map(self.memo.__getitem__, distinct))
        lengths = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) // 4
        starts = np.cumsum(lengths) - lengths
        spread = lengths[order]
        ends = np.r_[0, np.cumsum(spread)]
        flat = np.frombuffer(b"".join(data), dtype="<u4")
        ids = flat[np.repeat(starts[order] - ends[:-1], spread) + np.arange(ends[-1])]
        return ids.tobytes(), (ends[offsets[1:]] * 4).tolist()


#: Texts that a piece model may cut across single spaces, or that hold the sign that stands for a space.
PIECES_ACROSS = r"  |\A | \z|▁|\x00"


class PieceEncoder(Encoder):
    """Encodes texts as ``SentencePieceProcessor.encode(text)`` does, for a model that puts a space before each text.

    No piece of the model may have a space but at its start, or be of spaces only; then no merge crosses a single
    space, and each different chunk between spaces is encoded by the library once and remembered as above.
    Texts with other runs of spaces are encoded whole.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in self.pieces):
            raise ValueError("a piece of this model reaches across a space")
        self.memo, self.old = {}, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, dtype="<u4").tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def _learn(self, chunks: set[str]) -> None:
        new = list(chunks)
        self.memo.update(zip(new, self._whole(new)))

    def _batch(self, texts: list[str | None]) -> list[bytes]:
        held = pa.array(texts, pa.string())
        regular = pc.fill_null(pc.and_(pc.invert(pc.match_substring_regex(held, PIECES_ACROSS)), pc.not_equal(pc.binary_length(held), 0)), False)
        split = pc.split_pattern(held.filter(regular), " ")
        chunks = split.flatten().dictionary_encode()
        ids, ends = self._joined(chunks.dictionary.to_pylist(), chunks.indices.to_numpy(), split.offsets.to_numpy())
        parts = iter(zip([0, *ends], ends))
        return [ids[slice(*next(parts))] if r else self._whole([text])[0] if text else b"" for text, r in zip(texts, regular.to_pylist())]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The Encoder of ``path``, made once in each task of a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drops the worker's encoders with all that they remember: it stays for other tasks."""
    _encoders.clear()
